"""Spelling variants by Bloom-guided neighbourhoods.

The vocabulary (words with their counts) is a written table.  Per word length
its words are hashed into a blocked Bloom filter, made of one 64-bit block per
word, whose bits Spark ors together; a filter is broadcast while it stays below
``MAX_FILTER_BYTES``, in parts and passes beyond.  Each word generates its
edits as numpy rows, a length at a time: all deletions, and all replacements by
a letter that sorts after the old one (an insertion is a deletion of the other
word, a replacement by an earlier letter one of the other word's).  Hashes of
edits follow from the word's own by adding and taking off terms.  Edits that the
filter of their length has shuffle, as strings, to the exact join with the vocabulary;
that removes false positives, so the result is exact.

Sizes: one row per occurrence leaves no task (counts are combined first); an
edit is a row only if the filter has it, which for edits that are no word is
once in some hundred; each filter takes ``BITS_PER_KEY`` bits a word.

Defined results for odd input: null or empty texts have no runs; a null doc_id
is hashed as the empty string; repeated rows count as often as they come;
ties of n go to the word that is least by code points; without any word that
qualifies the result is empty; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, lower_ascii, table
from .conversation_trie import CRC_TABLE, sql_crc32
from .ragged import mix

RUN = r"[A-Za-zÀ-ÿ]"
LOSE_EVERY = 31
LEAST_LENGTH = 7
LEAST_COUNT = 2
FACTOR = 10
BITS_PER_KEY = 24
BITS_IN_BLOCK = 5
MAX_FILTER_BYTES = 64 << 20
#: Edits hashed at once in a task.
BATCH_EDITS = 2_000_000
#: Blocks sent to the driver as one row.
PAGE = 4096
PRIME = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
TERMS = mix(np.arange(256, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(1))


def occurrences(docs: DataFrame) -> DataFrame:
    """Column word: every run that is long enough, after the deletion that its document and itself decide."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Shorter runs cannot qualify; greedy matches from the left are maximal runs.
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(f"{RUN}{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run")).select("doc_id", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % LOSE_EVERY == 0, lost).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n and len of the words that qualify."""
    words = occurrences(docs).groupBy("word").agg(F.count("*").alias("n"))
    length = F.length("word")
    return words.where((F.col("n") >= LEAST_COUNT) & (length >= LEAST_LENGTH)).withColumn("len", length)


def latin(words: pa.Array, length: int) -> np.ndarray:
    """Words of one length as rows of their code points (all below 256)."""
    return np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8).reshape(-1, length)


def powers(n: int) -> np.ndarray:
    p = np.full(n, PRIME, np.uint64)
    p[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(p)


def hashes(rows: np.ndarray) -> np.ndarray:
    """Sum of the letters' terms times powers of a prime, modulo 2**64, row by row."""
    with np.errstate(over="ignore"):
        return (TERMS[rows] * powers(rows.shape[1])).sum(axis=1, dtype=np.uint64)


def blocks_and_bits(h: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number and the bits that a key sets in it."""
    with np.errstate(over="ignore"):
        h = mix(h)
        block = (h >> np.uint64(32)) * np.uint64(n_blocks) >> np.uint64(32)
        g, bits = mix(h ^ PRIME), np.zeros(len(h), np.uint64)
        for k in range(BITS_IN_BLOCK):
            bits |= np.uint64(1) << ((g >> np.uint64(6 * k)) & np.uint64(63))
    return block.astype(np.int64), bits


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Which part of a filter that is too large as a whole a key belongs to."""
    with np.errstate(over="ignore"):
        return (mix(h + PRIME) % np.uint64(parts)).astype(np.int64)


def plan_filters(counts: dict[int, int], max_bytes: int) -> tuple[dict[int, tuple[int, int]], list[list[tuple[int, int]]]]:
    """Per length (parts, blocks a part); and the passes, each a list of (length, part) below the bound."""
    shapes, passes, room = {}, [], 0
    for length, n in sorted(counts.items()):
        blocks = max(1, -(-n * BITS_PER_KEY // 64))
        parts = -(-8 * blocks // max_bytes)
        shapes[length] = (parts, -(-blocks // parts))
        for part in range(parts):
            size = 8 * shapes[length][1]
            if not passes or size > room:
                passes.append([])
                room = max_bytes
            passes[-1].append((length, part))
            room -= size
    return shapes, passes


def build_filters(words: DataFrame, shapes: dict[int, tuple[int, int]], wanted: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """The filters of one pass; tasks make blocks, Spark ors them, pages of them come to the driver (below the bound)."""
    keep = set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, rows, _ in by_length(batch):
                h = hashes(rows)
                parts, n_blocks = shapes[length]
                part = part_of(h, parts)
                block, bits = blocks_and_bits(h, n_blocks)
                ok = np.isin(part, [p for at, p in keep if at == length])
                n = int(ok.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, length, np.int32)), pa.array(part[ok].astype(np.int32)), pa.array(block[ok]), pa.array(bits[ok].view(np.int64))], ["len", "part", "block", "bits"]
                )

    made = words.where(F.col("len").isin(sorted({at for at, _ in keep}))).select("word", "n", "len").mapInArrow(run, "len int, part int, block long, bits long")
    ored = made.groupBy("len", "part", "block").agg(F.bit_or("bits").alias("bits"))
    page = F.floor(F.col("block") / PAGE).cast("int")
    pages = ored.groupBy("len", "part", page.alias("page")).agg(F.collect_list("block").alias("block"), F.collect_list("bits").alias("bits"))
    filters = {(at, p): np.zeros(shapes[at][1], np.uint64) for at, p in wanted}
    for r in pages.toLocalIterator():
        filters[r["len"], r["part"]][np.asarray(r["block"])] = np.asarray(r["bits"], np.int64).view(np.uint64)
    return filters


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, words as rows of code points, their counts)."""
    lengths = batch.column("len").to_numpy()
    for length in np.unique(lengths):
        at = pa.array(np.flatnonzero(lengths == length))
        yield int(length), latin(batch.column("word").take(at), int(length)), batch.column("n").take(at).to_numpy()


def has(filters, shapes, length: int, h: np.ndarray) -> np.ndarray:
    """Which hashes the filters of this pass may hold; none if the length has no filter here."""
    found = np.zeros(len(h), bool)
    mine = [p for at, p in filters if at == length]
    if mine:
        parts, n_blocks = shapes[length]
        part = part_of(h, parts) if parts > 1 else np.zeros(len(h), np.int64)
        block, bits = blocks_and_bits(h, n_blocks)
        for p in mine:
            at = np.flatnonzero(part == p) if parts > 1 else slice(None)
            found[at] = (filters[length, p][block[at]] & bits[at]) == bits[at]
    return found


def _strings(rows: np.ndarray) -> pa.Array:
    """Rows of code points as strings; letters from 128 on take two bytes."""
    return pa.array([r.tobytes().decode("latin-1") for r in rows], pa.string())


def edits_in(filters, shapes, alphabet: np.ndarray, length: int, rows: np.ndarray):
    """(word number, edit as row) for the edits that the filters may hold: deletions, then replacements."""
    with np.errstate(over="ignore"):
        power, own = powers(length), TERMS[rows]
        terms = own * power
        before = np.cumsum(terms, axis=1, dtype=np.uint64)
        total = before[:, -1]
        # Deletion at i: what stands before i, and what follows moved down by one place.
        shorter = (before - terms) + (total[:, None] - before) * INVERSE
        # In a run of equal letters each deletion gives the same word; the first one counts.
        first = np.c_[np.ones(len(rows), bool), rows[:, 1:] != rows[:, :-1]]
        who, at = np.nonzero(first)
        ok = has(filters, shapes, length - 1, shorter[who, at])
        who, at = who[ok], at[ok]
        if len(who):
            left = np.arange(length - 1)
            yield who, rows[who[:, None], left + (left >= at[:, None])]
        if any(n == length for n, _ in filters):
            for letter in alphabet:
                who, at = np.nonzero(rows < letter)
                h = total[who] + (TERMS[letter] - own[who, at]) * power[at]
                ok = has(filters, shapes, length, h)
                who, at = who[ok], at[ok]
                if len(who):
                    made = rows[who].copy()
                    made[np.arange(len(who)), at] = letter
                    yield who, made


def candidates(words: DataFrame, held, shapes, alphabet: np.ndarray, lengths: list[int]) -> DataFrame:
    """word, n, edit: the pairs that the filters of one pass let through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = held.value
        for batch in batches:
            for length, every, counts in by_length(batch):
                step = max(1, BATCH_EDITS // (length * max(1, len(alphabet))))
                for a in range(0, len(every), step):
                    rows, n = every[a : a + step], counts[a : a + step]
                    for who, made in edits_in(filters, shapes, alphabet, length, rows):
                        yield pa.RecordBatch.from_arrays([_strings(rows[who]), pa.array(n[who]), _strings(made)], ["word", "n", "edit"])

    # Words of a length probe that length and the one below.
    probing = sorted({*lengths, *(x + 1 for x in lengths)})
    return words.where(F.col("len").isin(probing)).select("word", "n", "len").mapInArrow(run, "word string, n long, edit string")


def near_words(words: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """word, n, other, other_n: every near pair once, in one of its directions. ``words`` is a written table."""
    sc = words.sparkSession.sparkContext
    counts = {r["len"]: r["n"] for r in words.groupBy("len").agg(F.count("*").alias("n")).collect()}
    shapes, passes = plan_filters(counts, max_bytes)
    # At most 64 + 26 letters.
    letters = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count().where("c <> ''").collect()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), np.uint8)
    found = None
    for wanted in passes:
        held = sc.broadcast(build_filters(words, shapes, wanted))
        more = candidates(words, held, shapes, alphabet, [at for at, _ in wanted])
        found = more if found is None else found.unionByName(more)
    if found is None:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    return found.join(words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit").select("word", "n", F.col("edit").alias("other"), F.col("edit_n").alias("other_n"))


def _roots(words: DataFrame, place: Workspace) -> DataFrame:
    """word and root, by doubling the reach of each word's link.

    A form's n is ten times the word's, so a chain has no more links than n has
    digits, and the number of doublings follows from the largest n."""
    most = words.agg(F.max("n")).first()[0] or 1
    links = max(1, int(math.log10(most)) + 1)
    reach = words.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for k in range(math.ceil(math.log2(links)) if links > 1 else 0):
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reach = place.write(reach.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"roots-{k}")
    return reach


def group_variants(docs: DataFrame, place: Workspace, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary."""
    words = place.write(vocabulary(docs), "words")
    pairs = near_words(words, max_bytes)
    ways = [[F.col(c).alias(a) for c, a in zip(way, ("w", "wn", "o", "on"), strict=True)] for way in (("word", "n", "other", "other_n"), ("other", "other_n", "word", "n"))]
    edges = pairs.select(F.inline(F.array(*[F.struct(*way) for way in ways])))
    best = F.min(F.struct((-F.col("on")).alias("less"), F.col("o")))
    seen = edges.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(seen, "word", "left").withColumn("has", -F.col("best.less") >= FACTOR * F.col("n"))
    formed = place.write(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best.o")).alias("form"), F.when(F.col("has"), -F.col("best.less")).alias("form_n")),
        "forms",
    )
    linked = formed.join(_roots(formed, place), "word", "left")
    return linked.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"), Workspace(spark, "spelling"))


_UTF8 = "flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [CAST(192 + (ord(c) >> 6) AS BIGINT), CAST(128 + (ord(c) & 63) AS BIGINT)] END))"

OP11_SQL = rf"""
WITH RECURSIVE tab AS (
  SELECT {CRC_TABLE} AS t
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), distinct_runs AS (
  SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY 1, 2
), hashed AS (
  SELECT run, times, {sql_crc32(_UTF8, "tab.t")} AS h FROM distinct_runs, tab
), words AS MATERIALIZED (
  SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, CAST(sum(times) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING sum(times) >= 2 AND length(word) >= 7
), cut AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY 1
), formed AS MATERIALIZED (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN most >= 10 * n THEN (SELECT min(other) FROM near WHERE near.word = words.word AND other_n = most) END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n
  FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL
  SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.at WHERE formed.form IS NOT NULL
), root AS (
  SELECT chain.word, chain.at AS root FROM chain JOIN formed ON formed.word = chain.at WHERE formed.form IS NULL
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed JOIN root USING (word)
"""
