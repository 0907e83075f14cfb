"""Quality rules as a ledger of bits, and policies that read it.

Every rule is evaluated once, over one scan of the texts: its measurements are
kept as columns and its failure as one bit of ``failed``.  A policy is a
version and a mask of rules; applying one, comparing several or leaving a rule
out reads the ledger only, never a text.  Ablations first count the distinct
values of the masked bits (at most two to the number of rules rows leave a
task) and combine those.  All of it is built-in expressions; no row is
exploded and the ledger itself has no shuffle.

A document's repeated windows are found inside its row: windows of
``WINDOW`` words are hashed, and only where the distinct hashes are fewer than
the windows are they sorted with their positions, equal neighbours compared
word by word, and the union of their positions counted.

Defined results for odd input: a null or empty text has no words and no lines
and fails ``few_words`` alone; texts of fewer than ``WINDOW`` words have no
window; repeated rows are judged one by one and all returned; a null doc_id
stays null; extra columns, whatever their names, are kept by
:func:`keep_documents` and ignored by :func:`ledger`; an empty table gives an
empty ledger and ablations with counts of 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

WINDOW = 8
SPACES = r"[\x20\x09-\x0D]+"
VISIBLE = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
DIGITS = "[0-9]"
CURLY = "[{}]"
#: Characters that open a list item.
BULLETS = r"^[\x20\x09-\x0D]*[-*•]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_bullets", "n_cut_lines", "n_curly")

#: Name -> failure, as SQL over the measurements (all whole numbers, so that every engine agrees).
#: The position is the bit; new rules are added at the end and none is ever renumbered.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeat_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "digits": "10 * n_digits > 3 * word_chars",
    "bullets": "10 * n_bullets > 9 * n_lines",
    "cut_lines": "10 * n_cut_lines > 3 * n_lines",
    "curly": "20 * n_curly > n_words",
    "symbols_strict": "50 * n_symbols > n_words",
    "dup_lines_strict": "10 * n_dup_lines > n_lines",
}
BASE_RULES = ("few_words", "repeat_words")


@dataclass(frozen=True)
class Policy:
    """A version and the rules it applies; ``mask`` has their bits."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = list(RULES)
        return sum(1 << names.index(r) for r in set(self.rules))


POLICIES = {
    p.version: p
    for p in (
        Policy("base-1", BASE_RULES),
        Policy("web-1", (*BASE_RULES, "symbols", "dup_lines", "short_words", "long_words", "digits", "bullets", "cut_lines", "curly")),
        Policy("strict-1", tuple(RULES)),
    )
}
PRODUCTION = "web-1"


def _hash_windows(docs: DataFrame, size: int) -> DataFrame:
    """Adds ``__g``, a hash of every run of ``size`` words (a power of two) of
    ``__w``: pairs of words are hashed, pairs of those, and so on.  Each step
    is a projection of its own, so that no step is evaluated again in the next."""

    def pair(reach: int):
        return lambda h, i: F.xxhash64(h, F.get("__g", i + reach))

    docs, reach = docs.withColumn("__g", F.transform("__w", lambda x: F.xxhash64(x))), 1
    while reach < size:
        docs = docs.withColumn("__g", F.transform("__g", pair(reach)))
        reach *= 2
    # The last positions have no whole window.
    return docs.withColumn("__g", F.slice("__g", 1, F.greatest(F.size("__g") - (size - 1), F.lit(0))))


def _repeated(words: Column, windows: Column, size: int) -> Column:
    """Number of words inside windows that occur twice or more."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def same(a: Column, b: Column) -> Column:
        # Hashes first: the words are compared only where they agree.
        return F.coalesce((a["h"] == b["h"]) & (F.slice(words, a["i"] + 1, size) == F.slice(words, b["i"] + 1, size)), F.lit(False))

    # Equal windows stand side by side once sorted, so each repeats if it equals a neighbour.
    pairs = F.arrays_zip(placed.alias("a"), F.slice(placed, 2, F.greatest(F.size(placed) - 1, F.lit(0))).alias("b"))
    twins = F.filter(pairs, lambda p: same(p["a"], p["b"]))
    at = F.array_sort(F.array_distinct(F.flatten(F.transform(twins, lambda p: F.array(p["a"]["i"], p["b"]["i"])))))
    gone = F.aggregate(
        at,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda s, i: F.struct((s["n"] + i + size - F.greatest(i, s["upto"])).alias("n"), (i + size).alias("upto")),
    )
    return gone["n"]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with all measurements; the text itself is dropped."""
    t = F.col("__t")
    split = docs.withColumn("__t", F.coalesce(F.col(text), F.lit(""))).withColumns(
        {"__w": F.array_remove(F.split(t, SPACES), ""), "__l": F.filter(F.split(t, "\n"), lambda x: x.rlike(VISIBLE))}
    )
    hashed = _hash_windows(split, WINDOW)
    w, lines, g = F.col("__w"), F.col("__l"), F.col("__g")
    count = {
        "n_words": F.size(w),
        "word_chars": F.length(F.regexp_replace(t, SPACES, "")),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_repeated(w, g, WINDOW)),
        "n_lines": F.size(lines),
        "n_digits": F.regexp_count(t, F.lit(DIGITS)),
        "n_bullets": F.size(F.filter(lines, lambda x: x.rlike(BULLETS))),
        "n_cut_lines": F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))),
        "n_curly": F.regexp_count(t, F.lit(CURLY)),
    }
    # An inline of one struct: filters on measurements stay above it. Through projections the optimizer would put the
    # expressions of the arrays into the filter, and into the functions that run over their elements.
    kept_columns = [c for c in docs.columns if c != text]
    return hashed.select(*kept_columns, F.inline_outer(F.array(F.struct(*[v.cast("long").alias(k) for k, v in count.items()]))))


def bits(rules: dict[str, str] = RULES) -> Column:
    """The failures of all rules as bits of one long."""
    failed = F.lit(0).cast("long")
    for k, condition in enumerate(rules.values()):
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return failed


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed``: one row per document."""
    return measured(docs.select("doc_id", "text")).withColumn("failed", bits())


def kept(policy: Policy, failed: Column | None = None) -> Column:
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def verdicts(book: DataFrame, policies: list[Policy]) -> DataFrame:
    """The ledger with a column ``kept_<version>`` per policy."""
    return book.withColumns({f"kept_{p.version}": kept(p) for p in policies})


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """For every rule of the policy: documents that fail it, that fail it alone
    (kept if it were left out), and what is kept with and without it."""
    names = list(RULES)
    seen = book.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")).alias("b")).agg(F.count("*").alias("n"))
    none = F.sum(F.when(F.col("b") == 0, F.col("n")).otherwise(0))
    parts = [none.alias("kept")]
    for r in policy.rules:
        bit = F.lit(1 << names.index(r)).cast("long")
        parts += [F.sum(F.when(F.col("b").bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias(f"f_{r}"), F.sum(F.when(F.col("b") == bit, F.col("n")).otherwise(0)).alias(f"o_{r}")]
    total = seen.agg(*parts)
    # One row of sums becomes one row per rule.
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), zero(F.col(f"f_{r}")).alias("n_failed"), zero(F.col(f"o_{r}")).alias("n_only"), zero(F.col("kept")).alias("kept")) for r in policy.rules])
    return total.select(F.inline(rows)).select(F.lit(policy.version).alias("policy"), "rule", "n_failed", "n_only", "kept", (F.col("kept") + F.col("n_only")).alias("kept_without"))


def coverage(book: DataFrame, *by: str) -> DataFrame:
    """Per group the bits that any document fails, that all fail, and their number."""
    return book.groupBy(*by).agg(F.bit_or("failed").alias("any_failed"), F.bit_and("failed").alias("all_failed"), F.count("*").alias("n"))


def keep_documents(docs: DataFrame, policy: Policy = POLICIES[PRODUCTION]) -> DataFrame:
    """The documents that the policy keeps, with all their columns."""
    row = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").alias("__text"))
    return measured(row, "__text").where(kept(policy, bits())).select("__row.*")


def op13_quality_rules(spark, sf_dir: str) -> DataFrame:
    book = ledger(table(spark, sf_dir, "documents"))
    return book.select("doc_id", *MEASURES, "failed", (~kept(POLICIES["base-1"])).alias("base_failed"), kept(POLICIES[PRODUCTION]).alias("kept"))


def _sql() -> str:
    count = lambda p: f"CAST(len(regexp_extract_all(t, '{p}')) AS BIGINT)"
    bit = " | ".join(f"(CASE WHEN {c} THEN {1 << k} ELSE 0 END)" for k, c in enumerate(RULES.values()))
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS x FROM twice) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         {count(SYMBOLS)} AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines, {count(DIGITS)} AS n_digits,
         CAST(len(list_filter(l, lambda x: regexp_matches(x, '{BULLETS}'))) AS BIGINT) AS n_bullets,
         CAST(len(list_filter(l, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS BIGINT) AS n_cut_lines,
         {count(CURLY)} AS n_curly
  FROM d LEFT JOIN rep USING (doc_id)
), b AS (SELECT *, CAST({bit} AS BIGINT) AS failed FROM m)
SELECT *, (failed & {POLICIES["base-1"].mask}) <> 0 AS base_failed, (failed & {POLICIES[PRODUCTION].mask}) = 0 AS kept FROM b
"""


OP13_SQL = _sql()
