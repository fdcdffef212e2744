"""Fill-in-middle: a text is cut at two places between tokens, and its middle part is moved to the end behind marks.

Each text is decoded to an array of code points. Tokens are runs of letters A-Z, a-z, and every other code point by itself, so a
token starts wherever two neighbours aren't both letters. The ranks of the cuts come from a hash of the id: the same at any
partitioning and any repetition. One pass over the documents, nothing is shuffled. The way back, restored(), is a column expression.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, quoted, text_batches, unpacked

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents of a hundred that are transformed, and of a hundred transformed ones those that start with the suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Code points of output that are handed on in one batch, about.
BATCH_CHARS = 2_000_000
NEW = ("n", "form", "prefix_chars", "middle_chars", "output")


def token_starts(points: np.ndarray) -> np.ndarray:
    """Where the tokens of a text's code points start."""
    folded = points | 0x20
    letter = (folded >= ord("a")) & (folded <= ord("z"))
    starts = np.ones(len(points), bool)
    starts[1:] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(starts)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers for a document; a null id draws those of the empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transform(doc_id: int | None, text: str, seed: int = 1, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = token_starts(points)
    n = len(starts)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= transformed or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    ends = np.append(starts, len(points))
    a, b = ends[sorted((h1 % (n + 1), h2 % (n + 1)))].tolist()
    prefix, middle, suffix = (points[i:j].tobytes().decode("utf-32-le", "surrogatepass") for i, j in ((0, a), (a, b), (b, len(points))))
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of. A text that holds a mark is never cut, so the three marks are the cuts."""
    parts = F.split(output, "|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))), -1)
    of = lambda *places: F.concat(*[F.get(parts, F.lit(i)) for i in places])
    return F.when(form == "psm", of(1, 3, 2)).when(form == "spm", of(2, 3, 1)).otherwise(output)


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
    transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """docs with the columns n (tokens), form (plain, psm, spm), prefix_chars, middle_chars (code points) and output.

    transformed documents of a hundred are cut, and of a hundred of these suffix_first start with the suffix. Texts that are null or
    empty, or hold a mark, stay plain, with null prefix_chars and middle_chars and the text as output (empty for null). The draws
    follow from seed and id alone: rows that repeat an id are cut at the same ranks if their texts have equally many tokens, repeated rows come out
    alike, and rows without an id share their draws. Very long texts are cut whole; a batch is bounded by the bytes of its texts. An
    empty table gives an empty result. Other columns are passed on; those with the names of the new ones, in any case, are replaced.
    """
    text_batches(docs.sparkSession)
    row, keep = packed(docs, NEW)
    own = docs.select(row, quoted(id_col).cast("long").alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("t"))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for b in batches:
            first, size, out = 0, 0, []
            for i, (doc_id, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2), strict=True)):
                out.append(transform(doc_id, text.as_py(), seed, transformed, suffix_first))
                size += len(out[-1][-1])
                if size > BATCH_CHARS or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(out)), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], names=["row", *NEW])
                    first, size, out = i + 1, 0, []

    schema = own.select("row").schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    done = own.mapInArrow(run, schema)
    return done.select(*unpacked(keep), *NEW)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = fill_in_middle(docs)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), tokens AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS t,
         CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM texts
), cuts AS (
  SELECT doc_id, text, t, len(t) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {TRANSFORMED} THEN 'plain'
              WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM tokens
), pieces AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(t[1:a], ''), '') AS p,
         coalesce(array_to_string(t[a + 1:b], ''), '') AS m, coalesce(array_to_string(t[b + 1:], ''), '') AS s
  FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                        WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces
"""
