"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Each task holds its texts as one array of code points.  Pre-tokens are found on
arrays of character classes; distinct ones, as ragged arrays of byte symbols,
are merged together: every round applies to each sequence the pair of lowest
rank it has, at all its places, until no sequence has a pair left; the symbols
that survive are the tokens.  A bounded cache keeps counts of pre-tokens
between rounds, so that memory does not grow with the corpus.  Spark streams
partitions through ``mapInArrow``; nothing is shuffled.

Defined results: null and empty texts have no bytes and no tokens; a special
token's string inside a text counts as that token (the library's default);
repeated rows come back repeated; columns other than id and text are ignored;
long texts are cut only where a token begins, so their counts are exact.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .ragged import DirectMap, batches, code_points, long_pieces, release, slice_hashes

LIMIT = 512
CHUNK = 1 << 20
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
SPACES = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def class_table() -> np.ndarray:
    """Character class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    classes = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    classes[list(SPACES)] = SPACE
    return classes


def byte_symbols() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def token_starts(codes: np.ndarray, classes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pre-tokens start: contractions, then letters, numbers or other
    signs with one space before them, then white space up to the last one.

    begins marks the first character of every text; texts do not see each other.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    run = begins.copy()
    run[0] = True
    run[1:] |= classes[1:] != classes[:-1]
    start = run.copy()
    # The last white space before something visible: a space joins it, another one stands alone.
    nxt = np.flatnonzero(run[1:] & ~begins[1:] & (classes[:-1] == SPACE)) + 1
    start[nxt - 1] = True
    start[nxt[codes[nxt - 1] == 0x20]] = False
    # An apostrophe alone, with s, t, m, d or re, ve, ll right behind it.
    quote = np.flatnonzero((codes[:-1] == 0x27) & start[:-1] & run[1:] & ~begins[1:] & (classes[1:] == LETTER))
    if len(quote):
        a = codes[quote + 1]
        b = np.where((quote + 2 < n), codes[np.minimum(quote + 2, n - 1)], 0)
        b = np.where((quote + 2 < n) & ~run[np.minimum(quote + 2, n - 1)], b, 0)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = np.zeros(len(quote), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        for chosen, length in ((quote[one], 2), (quote[two], 3)):
            start[chosen + 1] = False
            after = chosen + length
            start[after[after < n]] = True
    return np.flatnonzero(start)


class Vocabulary:
    """Merge ranks of a byte-level BPE .json file, for lookups by arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.byte_id = np.array([ids[c] for c in byte_symbols()], dtype=np.int64)
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order
        self.made = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        self.classes = class_table()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the number of merges if it is none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.made))

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that survive in each piece, all pieces merged in step."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = lengths.copy()
        symbols = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        none = len(self.made)
        while len(symbols) > 1:
            rank = np.full(len(symbols), none, np.int64)
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inside] = self.ranks(symbols[inside], symbols[inside + 1])
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(owner)])
            here = (rank == np.repeat(lowest, sizes)) & (rank < none)
            # Of overlapping places of one pair (aaa) every second counts, from the left.
            index = np.arange(len(here))
            since = index - np.maximum.accumulate(np.where(here, -1, index))
            take = np.flatnonzero(here & (since % 2 == 1))
            symbols[take] = self.made[rank[take]]
            np.subtract.at(counts, owner[take], 1)
            keep = np.repeat(lowest < none, sizes)  # sequences without a pair are done
            keep[take + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return counts


class Counter:
    """Counts tokens of texts; one for each Python worker."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.cache = DirectMap()
        self.split = re.compile("|".join(map(re.escape, self.vocabulary.special))) if self.vocabulary.special else None

    def pieces(self, texts: list[str | None], counts: np.ndarray) -> Iterator[tuple[int, str]]:
        """(row, piece) without special tokens, which are counted here."""
        for row, text in enumerate(texts):
            parts = self.split.split(text or "") if self.split else [text or ""]
            counts[row] += len(parts) - 1
            for part in parts:
                yield from ((row, x) for x in long_pieces(part, CHUNK) if x)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        counts = np.zeros(len(texts), np.int64)
        for held in batches(self.pieces(texts, counts), CHUNK):
            rows = np.array([r for r, _ in held])
            whole = "".join(x for _, x in held)
            codes = code_points(whole)
            first = np.cumsum([0, *(len(x) for _, x in held[:-1])])
            begins = np.zeros(len(codes), bool)
            begins[first] = True
            starts = token_starts(codes, self.vocabulary.classes[codes], begins)
            ends = np.r_[starts[1:], len(codes)]
            h = slice_hashes(codes, starts, ends)
            n, known = self.cache.get(h)
            if not known.all():
                missing = np.flatnonzero(~known)
                distinct, at, back = np.unique(h[missing], return_index=True, return_inverse=True)
                at = missing[at]
                new = self.vocabulary.count([whole[s:e].encode("utf-8", "surrogatepass") for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
                n[missing] = new[back]
                self.cache.put(distinct, new)
            sums = np.add.reduceat(n.astype(np.int64), np.searchsorted(starts, first))
            np.add.at(counts, rows, sums)
        return counts


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    path: the vocabulary file, at the same place on every executor.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for part in parts:
            n = counter(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])
            release()

    text = F.coalesce("text", F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return read.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
