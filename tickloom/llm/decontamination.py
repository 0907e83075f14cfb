"""Benchmark decontamination with a broadcast set of normalised test n-grams.

Every test item becomes its windows of ``WINDOW`` consecutive words (an item of
fewer words is one window).  The distinct windows, keyed by the hash of their
first words, form the broadcast side of a hash join; each document is split
into words once, every position offers the hash of the words that start there,
and a hit of that hash is verified against all words of the window inside the
join condition, before a row leaves it.  All of it is built-in expressions.

Size of the broadcast: it grows with the benchmark only, never with the
corpus, and its bytes are counted first. Above ``MAX_BROADCAST_BYTES`` positions
and windows meet in a shuffled join by length and hash of the whole window; a
position is then a row of five numbers, no words, and only hits, gathered by
document, return to the words to be verified.

Defined results for odd input: a null or empty text has no words, hence no
hits; a null benchmark text gives no window; equal windows of several items
are one window with several items; an empty benchmark contaminates nothing;
rows that repeat a doc_id are judged text by text, and rows that repeat both
come back as often as they came in; extra columns are ignored by
:func:`find_hits` and kept by :func:`remove_documents` and :func:`remove_spans`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, table, text_key

WINDOW = 13
SEED = 3
#: Of the words of all windows together, which is what a broadcast ships.
MAX_BROADCAST_BYTES = 256 << 20
#: What separates words: all of ASCII but digits and letters (texts are lower-cased before).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the lower-cased text; an empty array for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _slices(items: Column, size: int) -> Column:
    """All runs of ``size`` consecutive elements; the whole array if it is shorter."""
    last = F.greatest(F.size(items) - size, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i + 1, size))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: (w_words, w_len, w_seed, items), items being the sorted ids as strings."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    return (
        items.select("item", F.explode(_slices(F.col("w"), window)).alias("w_words"))
        .groupBy("w_words")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select("w_words", F.size("w_words").alias("w_len"), F.least(F.size("w_words"), F.lit(SEED)).alias("w_q"), "items")
        .withColumn("w_seed", F.xxhash64("w_q", F.slice("w_words", F.lit(1), F.col("w_q"))))
    )


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, text_key, copies, n_words, n_hit, items, and
    the hit word ranges ``hits`` (array of start, end; end exclusive).

    One scan of the texts and one shuffle, of a row per document plus a row per
    verified occurrence.
    """
    wins = benchmark_windows(benchmark, window)
    # 32 bytes beside the letters of each word and item, for the places that rows and hash tables take.
    weight = F.octet_length(F.concat_ws("", "w_words", "items")) + 32 * (F.size("w_words") + F.size("items") + 2)
    sizes = wins.agg(F.sum(weight).alias("bytes"), F.collect_set("w_q").alias("q")).first()
    if (sizes["bytes"] or 0) > MAX_BROADCAST_BYTES:
        return _found_shuffled(docs, wins)
    split = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), words(F.col("text")).alias("w"))
    n = F.size("w")

    def seeds(q: int) -> Column:
        """(position, hash of the q words from there) for all positions."""
        at = F.sequence(F.lit(0), F.greatest(n - q, F.lit(0)))
        word = [lambda i, k=k: F.get("w", i + k) for k in range(q)]
        hashed = F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(q), F.array(*[g(i) for g in word])).alias("seed")))
        return F.when(n >= q, hashed).otherwise(F.array())

    # The row with at = -1 stands for the document itself, so that no second scan is needed.
    itself = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("long").alias("seed")))
    rows = split.select("doc_id", "text_key", "w", F.inline(F.concat(itself, *[seeds(q) for q in sorted(sizes["q"])])))
    same = (F.col("seed") == F.col("w_seed")) & (F.slice("w", F.col("at") + 1, F.col("w_len")) == F.col("w_words"))
    found = rows.join(F.broadcast(wins), same, "left").where((F.col("at") == -1) | F.col("w_len").isNotNull())
    per_doc = (
        found.select(
            "doc_id", "text_key", F.when(F.col("at") == -1, n).alias("n_words"), "items",
            F.when(F.col("at") >= 0, F.struct(F.col("at").alias("start"), (F.col("at") + F.col("w_len")).alias("end"))).alias("hit"),
        )
        .groupBy("doc_id", "text_key")
        .agg(
            F.count("n_words").alias("copies"),
            F.max("n_words").alias("n_words"),
            F.array_sort(F.collect_set("hit")).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )
    return _counted(per_doc)


def _counted(per_doc: DataFrame) -> DataFrame:
    # Hit words: the length of the union of the sorted ranges.
    union = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda s, h: F.struct(
            (s["n"] + F.greatest(h["end"] - F.greatest(h["start"], s["upto"]), F.lit(0))).alias("n"),
            F.greatest(h["end"], s["upto"]).alias("upto"),
        ),
    )
    return per_doc.select("doc_id", "text_key", "copies", "n_words", union["n"].alias("n_hit"), "items", "hits")


def _found_shuffled(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """The same for a benchmark that is too large to broadcast."""
    keyed = wins.select("w_words", "w_len", "items", F.xxhash64("w_len", "w_words").alias("w_hash"))
    lengths = sorted(r["w_len"] for r in wins.select("w_len").distinct().collect())  # no more than words in a window
    own = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), words(F.col("text")).alias("w"))
    n = F.size("w")

    def windows(size: int) -> Column:
        at = F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))
        made = F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(size).alias("w_len"), F.xxhash64(F.lit(size), F.slice("w", i + 1, size)).alias("w_hash")))
        return F.when(n >= size, made).otherwise(F.array())

    # Of rows that repeat id and text one is searched.
    once = own.dropDuplicates(["doc_id", "text_key"]) if lengths else own.limit(0)
    placed = once.select("doc_id", "text_key", F.inline(F.concat(*[windows(size) for size in lengths] or [F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("w_len"), F.lit(0).cast("long").alias("w_hash")))])))
    met = placed.join(keyed, ["w_len", "w_hash"]).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "w_len", "w_words", "items")).alias("met"))
    met = met.select(F.struct("doc_id").alias("__id"), F.col("text_key").alias("__key"), "met")
    sizes = own.groupBy("doc_id", "text_key").agg(F.count("*").alias("copies"), F.first("w").alias("w")).withColumn("__id", F.struct("doc_id")).withColumn("__key", F.col("text_key"))
    back = sizes.join(met, ["__id", "__key"], "left")
    sure = F.filter(F.coalesce("met", F.array().cast(met.schema["met"].dataType)), lambda m: F.slice("w", m["at"] + 1, m["w_len"]) == m["w_words"])
    per_doc = back.withColumn("met", sure).select(
        "doc_id", "text_key", "copies", n.alias("n_words"),
        F.array_sort(F.array_distinct(F.transform("met", lambda m: F.struct(m["at"].alias("start"), (m["at"] + m["w_len"]).alias("end"))))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("met", lambda m: m["items"])))).alias("items"),
    )
    return _counted(per_doc)


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """A document is contaminated if a twentieth of its words or more are hit."""
    return (n_hit > 0) & (20 * n_hit.cast("long") >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    hits = find_hits(docs, benchmark, window).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return hits.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = find_hits(docs, benchmark, window).where(contaminated(F.col("n_hit"), F.col("n_words")))
    bad = bad.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"]) & (text_key(docs["text"]) == bad["__key"]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents, with the hit words cut out of the text of those that have
    any (their other words, lower-cased, joined by spaces)."""
    hits = find_hits(docs, benchmark, window).where(F.col("n_hit") > 0)
    hits = hits.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("hits").alias("__hits"))
    joined = docs.join(hits, docs["doc_id"].eqNullSafe(hits["__id"]) & (text_key(docs["text"]) == hits["__key"]), "left")
    # Between two hits lies what follows the furthest end so far; hits are sorted by start.
    gaps = F.aggregate(
        F.concat("__hits", F.array(F.struct(F.size("__w").alias("start"), F.size("__w").alias("end")))),
        F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("upto")),
        lambda s, h: F.struct(
            F.when(h["start"] > s["upto"], F.concat(s["kept"], F.slice("__w", s["upto"] + 1, h["start"] - s["upto"]))).otherwise(s["kept"]).alias("kept"),
            F.greatest(h["end"], s["upto"]).alias("upto"),
        ),
    )
    cut = joined.withColumn("__w", words(F.col("text"))).withColumn("text", F.when(F.col("__hits").isNull(), F.col("text")).otherwise(F.array_join(gaps["kept"], " ")))
    return cut.select(*docs.columns)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), pos AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), hits AS (
  SELECT p.doc_id, p.i, win.n, win.item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM pos, (SELECT DISTINCT n FROM win) WHERE i + n - 1 <= len(w)) p
  JOIN win USING (n, g)
), words AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
