"""Secret scan by token efficiency.

Random strings take many tokens: a string with few characters per token under a vocabulary learned from prose is
reported, after known digests (hex of usual lengths) and identifiers (UUIDs, numbers, dates, words that the vocabulary knows)
are set aside. Three fixed patterns (assignments, access keys, hex runs) are always reported beside it.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, text_batches, unpacked

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A candidate string: unbroken, from the alphabets that keys are written in.
LEAST_CHARS = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_CHARS},}}")
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
#: Hex lengths of common digests.
DIGEST_CHARS = (32, 40, 56, 64, 96, 128)
#: Parts of an identifier: words, numbers, camel case, joined by _ - / or =.
IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[-_/=]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[-_/=]*")
LETTERS = re.compile(r"[A-Za-z]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def load(path: str):
    """The tiktoken encoding of a rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _known(s: str, encoding, max_chars_per_token: float) -> bool:
    """A digest, number or identifier of words that the vocabulary knows, which is not reported."""
    core = s.strip("-_=/+")
    if UUID.fullmatch(core) or len(core) in DIGEST_CHARS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", core):
        return True
    # Strings of one class are judged by their tokens like all others, but for numbers and dates.
    return bool(IDENTIFIER.fullmatch(core)) and all(_word(w.lower(), encoding, max_chars_per_token) for w in LETTERS.findall(core))


def _word(w: str, encoding, max_chars_per_token: float) -> bool:
    """A word of one token, or of few for its length, at the start of a text or after a space."""
    n = min(len(encoding.encode_ordinary(w)), len(encoding.encode_ordinary(" " + w)))
    return n == 1 or len(w) / n >= max_chars_per_token


def _outside(start: int, end: int, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The pieces of start to end that no span of taken covers."""
    out = []
    for a, b, _ in sorted(x for x in taken if x[0] < end and start < x[1]):
        out.append((start, a))
        start = max(start, b)
    return [(a, b) for a, b in [*out, (start, end)] if a < b]


def spans(text: str | None, encoding, max_chars_per_token: float = 2.2) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind."""
    text = text or ""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "key" in low:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    base = list(found)
    for m in CANDIDATE.finditer(text):
        for start, end in _outside(m.start(), m.end(), base):
            s = text[start:end]
            if end - start >= LEAST_CHARS and len(s) / len(encoding.encode_ordinary(s)) < max_chars_per_token and not _known(s, encoding, max_chars_per_token):
                found.append((start, end, 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, max_chars_per_token: float = 2.2) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every row of docs, in one pass without a shuffle.

    Offsets are code points, end exclusive, sorted by start and then in the order of KINDS. Null and empty texts have no
    spans. Of a candidate of the token test, what no span of a fixed pattern covers is tested. Repeated rows come out
    alike. An empty table gives an empty result. vocabulary is a tiktoken rank file that every executor has at that path.
    Other columns are not looked at.
    """
    text_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        encoding = load(path)
        for b in batches:
            got = [[{"kind": k, "start": s, "end": e} for s, e, k in spans(t, encoding, max_chars_per_token)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each span of found, the result of scan(), replaced by mark; overlapping spans are one.

    Null and empty texts, and texts without spans, stay as they are. found has one row for each id, or rows that repeat it with
    the same spans, as scan() gives for repeated rows; of other repeats one counts. A null id is an id. An empty table gives an
    empty result. Other columns, of any name, are passed on.
    """
    row, names = packed(docs)
    text = F.col("row").getField(text_col).cast("string")

    def put(acc, s):
        rest = F.greatest(s["start"], acc["at"])
        piece = F.when(s["end"] > acc["at"], F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.greatest(rest - acc["at"], F.lit(0))), F.when(s["start"] >= acc["at"], F.lit(mark)).otherwise(F.lit("")))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), piece.alias("out"))

    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))
    own = found.select(F.col("doc_id").alias("found_id"), "spans").dropDuplicates(["found_id"])
    out = docs.select(row).join(own, F.col("row").getField(id_col).eqNullSafe(F.col("found_id")), "left")
    new = F.when(F.size(F.coalesce("spans", F.array().cast("array<struct<kind:string,start:int,end:int>>"))) > 0, done).otherwise(text)
    return out.select(*[new.alias(c) if c == text_col else own for c, own in zip(names, unpacked(names), strict=True)])


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of scan()'s result."""

    def joined(a):
        return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digests(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
