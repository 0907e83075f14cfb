"""Document fingerprints by Order MinHash.

A text's k-mers of words are numbered by occurrence, so that repeats count.
For each of SLOTS independent random orders (a 64-bit mix of k-mer and order)
two minimal numbered k-mers are selected, the one that is minimal in the order
and the one that is minimal in its reverse, put back into text order and hashed
as a pair: slots of two texts agree if their minimal k-mers agree and stand in
the same order, which makes the signature sensitive to edit distance and not to
the set of k-mers alone (Marcais et al. 2019).  In a random order the first and
the last are as likely to be any two k-mers as the first and the second, and
two texts agree in them just as often (both must be common to the texts, of all
k-mers of either), so these are the signatures of the two least k-mers in all
but name; but both ends are plain aggregates, and one pass finds them.

Everything is built-in expressions.  The words of a text are one array, its
k-mers packed longs (hash and position), sorted once to number repeats, then a
row each; generated code takes both ends of all orders over those rows, without
a shuffle of them, since the texts are dealt by their key before.

Likeness of two fingerprints is the share of equal slots.

Defined results: a null or empty text, or one of white space, has the empty
fingerprint; two empty fingerprints are alike (1), an empty one and another
are not (0); a text of fewer than K words is one k-mer; the next document is
that of the next larger (doc_id, hash of the text), nulls first, the first
after the last, so rows that repeat both share their next; a single document
is its own next; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, table, text_key

K = 2
SLOTS = 32
#: A packed long holds a position in its low bits and the hash above; the sign stays clear.
POSITION_BITS = 28
HASH_BITS = 35


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _packed(hashed: Column, position: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(hashed, 64 - HASH_BITS), POSITION_BITS).bitwiseOR(position.cast("long"))


def _position(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << POSITION_BITS) - 1))


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, POSITION_BITS)


def kmers(text: Column, k: int = K) -> Column:
    """Sorted packed longs: hash of the k words from each position, and the position."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")

    def made(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))
        full = F.transform(at, lambda i: _packed(F.xxhash64(*[F.get(w, i + j) for j in range(k)]), i))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.sort_array(full))

    return _let(words, made)


def numbered(packed: Column) -> Column:
    """The same k-mers, in no order: a k-mer's further occurrences (after the first) hashed together with their number."""

    def further(f: Column) -> Column:
        # Occurrences after the first lie together, by k-mer and position.
        n = F.size(f)

        def same(i: Column, j: Column) -> Column:
            return _hash(F.get(f, i)) == _hash(F.get(f, j))

        begin = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~same(i, i - 1))
        runs = _let(
            begin,
            lambda b: F.transform(b, lambda a, r: F.transform(F.sequence(a, F.coalesce(F.get(b, r + 1), n) - 1), lambda t: _packed(F.xxhash64(_hash(F.get(f, t)), t - a + 1), _position(F.get(f, t))))),
        )
        return F.when(n == 0, f).otherwise(F.flatten(runs))

    def made(s: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            return (i > 0) & (_hash(x) == _hash(F.get(s, i - 1)))

        return F.concat(F.filter(s, lambda x, i: ~again(x, i)), _let(F.filter(s, again), further))

    return _let(packed, made)


def _rank(x: Column, order: int) -> Column:
    """A k-mer's place in one of the orders, with its position below."""
    return _packed(F.xxhash64(_hash(x), F.lit(order)), _position(x))


def signatures(texts: DataFrame, keys: list[str], names: list[str], slots: int = SLOTS) -> DataFrame:
    """keys, and for each of the text columns ``names`` its fingerprint.

    keys: without nulls, and not two rows of different texts with equal keys.
    A row per k-mer, aggregated where it is made if texts are dealt by keys.
    """
    at = "__at"
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias(at), F.col(n).alias("__text")) for k, n in enumerate(names)]))
    rings = texts.select(*keys, parts.alias("__p")).select(*keys, F.col(f"__p.{at}").alias(at), numbered(kmers(F.col("__p.__text"))).alias("__ring"))
    rows = rings.select(*keys, at, F.explode_outer("__ring").alias("x"))
    ends = rows.groupBy(*keys, at).agg(*[f(_rank(F.col("x"), j)).alias(f"{n}{j}") for j in range(slots) for n, f in (("lo", F.min), ("hi", F.max))])

    def slot(j: int) -> Column:
        a, b = F.col(f"lo{j}"), F.col(f"hi{j}")
        pair = F.when(a == b, F.xxhash64(_hash(a))).when(_position(a) < _position(b), F.xxhash64(_hash(a), _hash(b))).otherwise(F.xxhash64(_hash(b), _hash(a)))
        return F.lpad(F.lower(F.hex(F.shiftrightunsigned(pair, 32))), 8, "0")

    prints = ends.select(*keys, at, F.when(F.col("lo0").isNull(), "").otherwise(F.concat(*[slot(j) for j in range(slots)])).alias("f"))
    return prints.groupBy(*keys).agg(*[F.first(F.when(F.col(at) == k, F.col("f")), ignorenulls=True).alias(n) for k, n in enumerate(names)])


def likeness(a: Column, b: Column, slots: int = SLOTS) -> Column:
    """Share of equal slots of two fingerprints."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.substr(a, i * 8 + 1, F.lit(8)) == F.substr(b, i * 8 + 1, F.lit(8))))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(same / F.lit(float(slots)))


def next_keys(keys: DataFrame, place: Workspace) -> DataFrame:
    """doc_id, text_key, n_chars, copies, and the next_id, next_key of the next row in order.

    keys: distinct (doc_id, text_key) with n_chars and copies.  Rows are dealt by ranges;
    within a range the next row is a lead, and the last row of a range takes
    the first of the next range (one row per range).
    """
    parts = keys.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("text_key")).withColumn("part", F.spark_partition_id())
    ranges = place.write(parts, "ranges")
    row = F.struct("doc_id", "text_key")
    within = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "text_key")
    led = ranges.withColumn("next", F.lead(row).over(within))
    first = ranges.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text_key")).alias("first"))
    order = Window.orderBy("part")
    heads = first.select(
        F.col("part"),
        F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"),
    )  # as many rows as there are ranges
    joined = led.join(F.broadcast(heads), "part")
    return joined.select(
        "doc_id", "text_key", "n_chars", "copies",
        F.when(F.col("next").isNotNull(), F.col("next.doc_id")).otherwise(F.col("head.doc_id")).alias("next_id"),
        F.coalesce("next.text_key", "head.text_key").alias("next_key"),
    )


KEYS = ["known", "id", "text_key"]


def _keyed(doc_id: Column) -> list[Column]:
    """A nullable id as two columns without nulls, so that joins and groups share one hash partitioning."""
    return [doc_id.isNotNull().alias("known"), F.coalesce(doc_id, F.lit(0)).alias("id")]


def compare(docs: DataFrame, place: Workspace) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    doc_id = F.col("doc_id").cast("long")
    read = docs.select(*_keyed(doc_id), text_key(F.col("text")).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    keys = docs.select(doc_id.alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))
    keys = keys.groupBy("doc_id", "text_key").agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    order = place.write(next_keys(keys, place), "order")
    # The beginning of each document goes to the one before it.
    owners = order.select(
        *[c.alias(f"own_{n}") for c, n in zip(_keyed(F.col("doc_id")), KEYS, strict=False)], F.col("text_key").alias("own_text_key"), "n_chars",
        *_keyed(F.col("next_id")), F.col("next_key").alias("text_key"),
    )
    head = F.substr("text", F.lit(1), F.floor(F.col("n_chars") / 4).cast("int"))
    heads = read.join(owners, KEYS).select(*[F.col(f"own_{n}").alias(n) for n in KEYS], head.alias("head")).dropDuplicates(KEYS)
    both = read.join(heads, KEYS)
    kept = F.length("text") - F.floor(F.length("text") / 4).cast("int")
    both = both.select(*KEYS, "text", F.concat(F.substr("text", F.lit(1), kept), F.col("head")).alias("edited"))
    prints = signatures(both, KEYS, ["text", "edited"]).withColumnsRenamed({"text": "fingerprint", "edited": "edited_fingerprint"})
    digests = both.select(*KEYS, F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256")).dropDuplicates(KEYS)
    held = place.write(digests.join(prints, KEYS), "prints")
    described = order.select(*_keyed(F.col("doc_id")), *order.columns).join(held, KEYS)
    other = held.select(F.col("known").alias("next_known"), F.col("id").alias("next_0"), F.col("text_key").alias("next_key"), F.col("fingerprint").alias("next_print"))
    named = described.withColumn("next_known", F.col("next_id").isNotNull()).withColumn("next_0", F.coalesce("next_id", F.lit(0)))
    paired = named.join(other, ["next_known", "next_0", "next_key"])
    return paired.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
    )


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents").select("doc_id", "text"), Workspace(spark, "fingerprints"))
