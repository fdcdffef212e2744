"""BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a prefix is given by its last token alone: the rest is the encoding of the shorter prefix before it.
A token can be last if it ends the prefix and forms a stable pair with the last token of what comes before it, and
exactly one token does. The distinct words of a batch in sorted order are a depth-first walk of their trie, whose nodes
are the prefixes that the word before does not share. Last tokens are propagated from each node to the nodes below it,
one depth at a time for all branches together, by whole arrays; each shared prefix is worked out once. Pieces seen
before come from a cache that is bounded by bytes. Decoding takes the tokens of the ids from the vocabulary.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

END = "</w>"
#: The vocabulary file's pattern for words, with its white space written out.
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")

CONTROL = regex.compile("[\x1c-\x1f]")

#: Bytes that the pieces of a worker's cache take at most (about), before it starts anew, and those that each takes beside its text.
CACHE_BYTES, PIECE_BYTES = 100_000_000, 150
#: Bytes of the longest word that the arrays of a batch have room for; longer ones are walked on their own.
ARRAY_BYTES = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_chars() -> str:
    """The printable character that stands for each byte, by byte value."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


class _Table:
    """A fixed hash table from 64-bit keys to numbers of 0 or more, looked up by whole arrays."""

    def __init__(self, keys, values):
        keys, values = np.asarray(keys, np.uint64), np.asarray(values, np.int32)
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.values[at[left]] < 0
            self.keys[at[left[free]]] = keys[left[free]]
            self.values[at[left[free]]] = values[left[free]]
            # Of those that chose one free slot the last has it; the others move on.
            left = left[(self.values[at[left]] != values[left]) | (self.keys[at[left]] != keys[left])]
            at[left] = (at[left] + 1) & (len(self.values) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys; -1 for those that are not in the table."""
        at = self._slot(keys)
        out = self.values[at]
        left = np.nonzero((self.keys[at] != keys) & (out >= 0))[0]
        while len(left):
            at[left] = (at[left] + 1) & (len(self.values) - 1)
            out[left] = self.values[at[left]]
            left = left[(self.keys[at[left]] != keys[left]) & (out[left] >= 0)]
        return out


def _masked(packed: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes of packed ones, 8 at most."""
    return packed if n >= 8 else packed & np.uint64((1 << 8 * n) - 1)


class _Suffixes:
    """Tokens by the bytes that they end a prefix with, looked up for whole arrays of prefixes."""

    def __init__(self, tokens: dict[bytes, int]):
        self.most = max(map(len, tokens), default=0)
        self.packs = {t: [int.from_bytes(s[max(0, len(s) - 8 * j - 8) : len(s) - 8 * j], "big") for j in range((len(s) + 7) // 8)] for s, t in tokens.items()}
        size = max(tokens.values(), default=0) + 1
        self.pack = np.zeros((size, max(1, (self.most + 7) // 8)), np.uint64)
        for t, own in self.packs.items():
            self.pack[t, : len(own)] = own
        self.tables: list[_Table] = []
        for k in range(1, self.most + 1):
            #: Ending of k bytes -> 1 + its token, or 0 if it only ends longer ones.
            ends: dict[int, int] = {}
            for s, t in tokens.items():
                if len(s) >= k:
                    key = self._key([int.from_bytes(s[max(len(s) - k, len(s) - 8 * j - 8) : len(s) - 8 * j], "big") for j in range((k + 7) // 8)])
                    ends[key] = max(ends.get(key, 0), t + 1 if len(s) == k else 0)
            self.tables.append(_Table(list(ends), list(ends.values())))

    @staticmethod
    def _key(packs: list[int]) -> int:
        out = 0
        for x in packs:
            out = (out * 0xC2B2AE3D27D4EB4F + x) & (2**64 - 1)
        return out

    def find(self, packed: np.ndarray, w: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, length, token) of every token that ends a prefix; prefix i is the first end[i] bytes of word w[i].

        packed[w, e]: the 8 bytes before e, the later ones lower.
        """
        out, alive = [], np.arange(len(w))
        for k in range(1, self.most + 1):
            alive = alive[end[alive] >= k]
            if not len(alive):
                break
            parts = [_masked(packed[w[alive], end[alive] - 8 * j], k - 8 * j) for j in range((k + 7) // 8)]
            key = parts[0]
            for x in parts[1:]:
                key = key * np.uint64(0xC2B2AE3D27D4EB4F) + x
            got = self.tables[k - 1].find(key)
            token = got - 1
            hit = got > 0
            if k > 8:  # keys of more than 8 bytes are hashes
                for j, x in enumerate(parts):
                    hit &= self.pack[token, j] == x
            out.append((alive[hit], np.full(int(hit.sum()), k, np.int64), token[hit].astype(np.int64)))
            alive = alive[got >= 0]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


class WordBpe:
    """A byte-level BPE vocabulary with word ends, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        self.bytes_to_chars = dict(enumerate(_byte_chars()))
        #: Of each token the rank of the merge that makes it (-1: a symbol) and its two parts.
        self.rank, self.parts = [-1] * size, [(0, 0)] * size
        self.pair_rank: dict[tuple[int, int], int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            made = vocab[a + b]
            self.pair_rank[vocab[a], vocab[b]] = r
            self.rank[made], self.parts[made] = r, (vocab[a], vocab[b])
        # Tokens by their bytes: those inside a word, and those that end one. Only those that encode to themselves can occur.
        byte = {c: b for b, c in self.bytes_to_chars.items()}
        inner: dict[bytes, int] = {}
        final: dict[bytes, int] = {}
        self.length = np.zeros(size, np.int64)
        for t, i in vocab.items():
            ends = t.endswith(END) and len(t) > len(END)
            symbols = t[: -len(END)] if ends else t
            self.length[i] = len(symbols)
            if i not in self.special.values() and (self.rank[i] < 0 or self._whole(i)):
                (final if ends else inner)[bytes(byte[c] for c in symbols)] = i
        self.inner, self.final = _Suffixes(inner), _Suffixes(final)
        self.ranks, self.left, self.right = np.array(self.rank), *np.array(self.parts).T
        self.pairs = _Table([a << 32 | b for a, b in self.pair_rank], list(self.pair_rank.values()))
        self.strings = pa.array(self.token)
        self.forget()

    def forget(self) -> None:
        """Empties the cache: pieces -> number, and the ids of each number from starts on, counts of them. The empty piece has none."""
        self.cache: dict[str, int] = {"": 0}
        self.cached_bytes = 0
        self.ids, self.starts, self.counts = np.empty(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each pair: True if the symbols of a then b encode to exactly a, b.

        Undoes, latest first, the merges that made the pieces at the boundary; a merge across the boundary that
        ranks before the one undone would have come first. Of equal merges the left one comes first.
        """
        out = np.ones(len(a), bool)
        x, y, limit, at = a, b, np.full(len(a), 1 << 30), np.arange(len(a))
        while len(at):
            across = self.pairs.find((x << 32 | y).astype(np.uint64))
            bad = (across >= 0) & (across < limit)
            out[at[bad]] = False
            rx, ry = self.ranks[x], self.ranks[y]
            go = np.nonzero(~bad & ((rx >= 0) | (ry >= 0)))[0]
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            later = rx > ry
            limit = np.where(later, rx, ry + 1)
            x, y = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
        return out

    def _whole(self, token: int) -> bool:
        """True if the symbols of a token encode to that token: its own merge is the first to join its parts."""
        x, y = self.parts[token]
        limit = self.pair_rank[x, y]
        while True:
            if self.pair_rank.get((x, y), 1 << 30) < limit:
                return False
            rx, ry = self.rank[x], self.rank[y]
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                limit, x = min(limit, rx), self.parts[x][1]
            else:
                limit, y = min(limit, ry + 1), self.parts[y][0]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each) for distinct words without white space."""
        raw = [w.encode("utf-8") for w in words]
        counts, owner, found = np.zeros(len(words), np.int64), [], []
        short = np.array([i for i, r in enumerate(raw) if len(r) <= ARRAY_BYTES], np.int64)
        if len(short):
            order = short[np.argsort(np.array([raw[i] for i in short.tolist()], object), kind="stable")]
            ids, n = self._walk([raw[i] for i in order.tolist()])
            counts[order] = n
            owner.append(np.repeat(order, n))
            found.append(ids)
        for i, r in enumerate(raw):
            if len(r) > ARRAY_BYTES:
                ids = self._walk_long(r)
                counts[i] = len(ids)
                owner.append(np.full(len(ids), i))
                found.append(np.array(ids, np.int32))
        if not found:
            return np.empty(0, np.int32), counts
        return np.concatenate(found)[np.argsort(np.concatenate(owner), kind="stable")], counts

    def _walk(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of sorted distinct words of 1 to ARRAY_BYTES bytes."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        rows, most = np.arange(len(words)), int(n.max())
        grid = np.zeros((len(words), most), np.uint8)
        offset = np.cumsum(n) - n
        grid[np.repeat(rows, n), np.arange(int(n.sum())) - np.repeat(offset, n)] = np.frombuffer(b"".join(words), np.uint8)
        packed = np.zeros((len(words), most + 1), np.uint64)
        for e in range(most):
            packed[:, e + 1] = packed[:, e] << np.uint64(8) | grid[:, e]
        # Nodes of the trie: the prefixes of a word (but the whole of it) that are not prefixes of the word before.
        differs = np.ones((len(words), most + 1), bool)
        differs[1:, :most] = grid[1:] != grid[:-1]
        differs[0, 0] = True
        shared = differs.argmax(axis=1)
        shared = np.minimum(shared, np.minimum(n - 1, np.concatenate(([0], n[:-1] - 1))))
        fresh = n - 1 - shared
        w = np.repeat(rows, fresh)
        end = np.arange(int(fresh.sum())) - np.repeat(np.cumsum(fresh) - fresh, fresh) + shared[w] + 1
        at, k, token = self.inner.find(packed, w, end)
        cw, ce = w[at], end[at]
        by_depth = np.argsort(ce, kind="stable")
        cw, ce, k, token = cw[by_depth], ce[by_depth], k[by_depth], token[by_depth]
        cut = np.searchsorted(ce, np.arange(1, most + 2))
        last = np.zeros((most + 1, len(words)), np.int64)
        for e in range(1, most):
            s = slice(cut[e - 1], cut[e])
            own = np.full(len(words), -1, np.int64)
            cws, ks, ts = cw[s], k[s], token[s]
            ok = ks == e
            rest = np.nonzero(~ok)[0]
            ok[rest] = self.stable(last[e - ks[rest], cws[rest]], ts[rest])
            own[cws[ok]] = ts[ok]
            # A prefix shared with the word before has its last token from the word that the node belongs to.
            node = np.maximum.accumulate(np.where((shared < e) & (n > e), rows, 0))
            last[e] = own[node]
            if (last[e][n > e] < 0).any():
                raise ValueError("a prefix has no last token")
        at, k, token = self.final.find(packed, rows, n)
        ok = k == n[at]
        rest = np.nonzero(~ok)[0]
        ok[rest] = self.stable(last[(n[at] - k)[rest], at[rest]], token[rest])
        now = np.full(len(words), -1, np.int64)
        now[at[ok]] = token[ok]
        if (now < 0).any():
            raise ValueError("a word has no last token")
        ids, owner, left, live = [], [], n.copy(), rows
        while len(live):
            ids.append(now)
            owner.append(live)
            left = left - self.length[now]
            more = left > 0
            live, left = live[more], left[more]
            now = last[left, live]
        counts = np.bincount(np.concatenate(owner), minlength=len(words))
        # The tokens were found from the last to the first.
        order = np.argsort(np.concatenate(owner[::-1]), kind="stable")
        return np.concatenate(ids[::-1])[order].astype(np.int32), counts

    def _walk_long(self, word: bytes) -> list[int]:
        """The ids of one word of any length, by the last tokens of its prefixes; prefixes are looked up in pieces."""
        n, most = len(word), max(self.inner.most, self.final.most)
        found: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for start in range(0, n, 4096):
            stop, base = min(n, start + 4096), max(0, start - most)
            packed = np.zeros((1, stop - base + 1), np.uint64)
            x = 0
            for i in range(base, stop):
                x = (x << 8 | word[i]) & (2**64 - 1)
                packed[0, i + 1 - base] = x
            ends = np.arange(start + 1, stop + 1)
            for table, own in ((self.inner, ends[ends < n]), (self.final, ends[ends == n])):
                at, k, token = table.find(packed, np.zeros(len(own), np.int64), own - base)
                for e, kk, t in zip(own[at].tolist(), k.tolist(), token.tolist(), strict=True):
                    found[e].append((kk, t))
        last, known = [-1] * (n + 1), {}
        for e in range(1, n + 1):
            for k, t in reversed(found[e]):
                if k == e:
                    break
                pair = last[e - k], t
                if pair not in known:
                    known[pair] = bool(self.stable(np.array([pair[0]]), np.array([t]))[0])
                if known[pair]:
                    break
            else:
                raise ValueError("a prefix has no last token")
            last[e] = t
        ids = []
        while n:
            ids.append(last[n])
            n -= int(self.length[last[n]])
        return ids[::-1]

    def split(self, chunk: str) -> list[str]:
        """The words of a piece of lower-cased text without white space; a special token stands for itself."""
        return [chunk] if chunk in self.special else WORD.findall(chunk)

    def normal(self, text: str) -> str | list[str]:
        """The normal form of a text, to be cut at white space; the pieces themselves where that would cut them wrongly."""
        if "<|" in text or CONTROL.search(text):
            return self.chunks(text)
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def chunks(self, text: str) -> list[str]:
        """The pieces between white space of a text in its normal form. Special tokens are pieces of their own."""
        out = []
        for part in self.special_re.split(text) if self.special_re and "<|" in text else (text,):
            if part in self.special:
                out.append(part)
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                part = part.lower()
                # str.split takes \x1c-\x1f for white space; a special token's string made here is ordinary text.
                out += WORD.findall(part) if CONTROL.search(part) or self.special_re and "<|" in part else part.split()
        return out

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of distinct pieces, new ones added to the cache."""
        cache = self.cache
        out = np.fromiter((cache.get(c, -1) for c in pieces), np.int64, len(pieces))
        new = np.nonzero(out < 0)[0]
        if not len(new):
            return out
        own = [pieces[i] for i in new.tolist()]
        words: dict[str, int] = {}
        index, per = [], np.zeros(len(own), np.int64)
        special = {}
        for j, c in enumerate(own):
            if c.isalpha() and c.isascii():
                index.append(words.setdefault(c, len(words)))
                per[j] = 1
            elif c in self.special:
                special[j] = self.special[c]
            else:
                cut = WORD.findall(c)
                index += [words.setdefault(w, len(words)) for w in cut]
                per[j] = len(cut)
        ids, n = self.encode_words(list(words))
        index = np.array(index, np.int64)
        flat = ids[_ranges((np.cumsum(n) - n)[index], n[index])]
        counts = np.bincount(np.repeat(np.arange(len(own)), per), n[index], len(own)).astype(np.int64)
        if special:
            at = np.array(list(special))
            flat = np.insert(flat, (np.cumsum(counts) - counts)[at], list(special.values())).astype(np.int32)
            counts[at] = 1
        first = len(self.counts)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, flat])
        out[new] = np.arange(first, first + len(own))
        for j, c in enumerate(own):
            cache[c] = first + j
            self.cached_bytes += len(c) + PIECE_BYTES
        return out

    def encode_arrays(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets of each text in them)."""
        forms = [self.normal(t or "") for t in texts]
        if all(isinstance(f, str) for f in forms):
            cut = pc.utf8_split_whitespace(pa.array(forms, pa.large_string()))
        else:
            cut = pa.array([f.split() if isinstance(f, str) else f for f in forms], pa.large_list(pa.large_string()))
        coded = cut.values.dictionary_encode()
        pieces = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        counts = self.counts[pieces]
        ids = self.ids[_ranges(self.starts[pieces], counts)]
        ends = cut.offsets.to_numpy()
        offsets = np.concatenate(([0], np.cumsum(counts)))[ends]
        if self.cached_bytes > CACHE_BYTES:
            self.forget()
        return ids, offsets

    def decode_arrays(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of ids that lie one after the other: the tokens of the vocabulary, joined by a space."""
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), self.strings.take(pa.array(ids))), " ")

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids as int32 bytes, decoded text) of each text."""
        ids, offsets = self.encode_arrays(texts)
        decoded = self.decode_arrays(ids, offsets).to_pylist()
        return [(ids[a:b].tobytes(), d) for a, b, d in zip(offsets, offsets[1:], decoded, strict=False)]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i], ... starts[i] + counts[i] - 1 for each i, one after the other."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - before, counts)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row of docs, in one pass without a shuffle.

    vocabulary is a tokenizers JSON file that every executor has at that path. A null or empty text has no ids and
    decodes to the empty text. Ids of special tokens are given where their strings stand in a text. Very long words cost
    time in proportion to their length. Repeated rows come out alike. An empty table gives an empty result. Other
    columns are not looked at.
    """
    text_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = load(path)
        for b in batches:
            flat, offsets = bpe.encode_arrays(b.column(1).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, bpe.decode_arrays(flat, offsets).cast(pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode(ids: list[int], vocabulary: str | None = None) -> str:
    """The text of token ids, special tokens included."""
    token = load(vocabulary or default_vocabulary()).token
    return " ".join([token[i] for i in ids])


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode()'s result, and more of its columns."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), *more,
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digests(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
