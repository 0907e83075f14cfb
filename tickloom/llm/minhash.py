"""Near-duplicate detection: SuperMinHash, banding, verification, union-find.

1. Sets.  Each text becomes its set of hashed word shingles (built-in
   expressions); documents with equal sets are one class, so exact copies cost
   one row from here on, however many there are.
2. Signatures.  SuperMinHash (Ertl 2017): every shingle has a random rank for
   each slot of a random permutation; level by level the shingles of all texts
   of an Arrow batch claim their next slot, and a text stops at the level that
   cannot lower any of its slots.
3. Candidates.  Two classes are candidates if a band of their signatures
   agrees.  With BANDS bands of ROWS slots a pair at the threshold of 0.8 is
   missed once in (1 - 0.8**5)**36, about 6e-7.
4. Links.  A bucket is not expanded into its pairs.  First each member is
   verified against the bucket's hub, the member with the most company.  Then
   buckets whose members are in several components still are compared in
   full, in blocks of bounded size with one matrix product each, and only
   links between components leave a block; so no candidate that could join
   two components is left out.  Both verify on the full shingle sets, rebuilt
   from the texts (64-bit hashes of the shingles).
5. Groups.  Links are contracted by union-find inside each task, then by
   alternating large-star and small-star rounds in Spark until nothing changes.

Hot groups: a class or bucket with a third of all rows appears only in
partially aggregated minima and in joins whose other side has one row per key,
which adaptive execution splits.  Nothing is collected but counts.  Every cut
of the lineage is a table in the shared folder.

Defined results: a null or empty text has no shingles and is its own
component; equal texts under several doc_ids are one component; rows that
repeat a doc_id all appear; a null doc_id is never the smallest id while
others are there (kept is then false).  :func:`deduplicate` leaves one row of
each component, and of a null or empty text's doc_id: that of the smallest
doc_id, then of the smallest hash of the text, and one of rows that repeat
both; extra columns pass through.  doc_id must be an integer, or a string of
one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, lower_ascii, table, text_key
from .ragged import U64, mix, release

WORDS = 5
PERCENT = 80
BANDS = 36
ROWS = 5
CHUNK = 1 << 18
#: Bounds of a block of a bucket (on average), and of the matrix columns held at once.
BLOCK_MEMBERS = 2048
BLOCK_SHINGLES = 1 << 19
COLUMNS = 4096
SPACES = r"[\x20\x09-\x0D]+"


def shingles(text: Column, size: int = WORDS) -> Column:
    """Distinct hashed shingles of ``size`` words; all words as one if there are fewer; none without words."""
    w = F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SPACES), "")

    def made(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0)))
        full = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < size, F.array(F.xxhash64(F.size(w), w))).otherwise(F.array_distinct(full))

    # transform over the single word array, so that it is computed once
    return F.element_at(F.transform(F.array(w), made), 1)


def signatures(values: np.ndarray, offsets: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash of each run values[offsets[i]:offsets[i + 1]] of distinct 64-bit hashes; runs are not empty."""
    n = len(offsets) - 1
    out = np.full(n * slots, np.inf)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    ranks = None
    for level in range(slots):
        for a in range(0, len(values), CHUNK):
            v, o = values[a : a + CHUNK], owner[a : a + CHUNK]
            with np.errstate(over="ignore"):
                x = mix(v + U64((0x9E3779B97F4A7C15 * (2 * level + 1)) % (1 << 64)))
                y = mix(x + U64(0xD1B54A32D192ED03))
            r = (x >> U64(11)).astype(np.float64) * 2.0**-53
            k = level + (y % U64(slots - level)).astype(np.int64)
            if ranks is None:
                slot = k
            else:
                p, i = ranks[a : a + CHUNK], np.arange(len(v))
                slot = p[i, k].astype(np.int64)
                p[i, k] = p[:, level]
                p[:, level] = slot
            np.minimum.at(out, o * slots + slot, r + level)
        if level + 1 == slots:
            break
        # Values of the next level are at least level + 1: early stop where no slot is above.
        open_ = out.reshape(n, slots).max(axis=1) > level + 1
        stay = open_[owner]
        if not stay.any():
            break
        if ranks is None:
            values, owner = values[stay], owner[stay]
            ranks = np.tile(np.arange(slots, dtype=np.uint16), (len(values), 1))
            with np.errstate(over="ignore"):
                first = (mix(mix(values + U64(0x9E3779B97F4A7C15)) + U64(0xD1B54A32D192ED03)) % U64(slots)).astype(np.int64)
            ranks[np.arange(len(values)), first] = 0
            ranks[:, 0] = first
        elif not stay.all():
            values, owner, ranks = values[stay], owner[stay], ranks[stay]
    return out.reshape(n, slots)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.view(np.uint64).reshape(len(signature), bands, rows)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * U64(0xA24BAED4963EE407)), parts.shape[:2]).copy()
        for r in range(rows):
            h = mix(h * U64(0x9FB21C651E98DF25) + parts[:, :, r])
    return h.view(np.int64)


def set_keys(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128 bits for each set, whatever the order of its elements; runs are not empty."""
    sizes = np.diff(offsets).astype(np.uint64)
    with np.errstate(over="ignore"):
        a = mix(np.add.reduceat(mix(values), offsets[:-1]) + sizes)
        b = mix(np.add.reduceat(mix(values ^ U64(0x5851F42D4C957F2D)), offsets[:-1]) ^ sizes)
    both = np.stack([a, b], axis=1).astype(">u8")
    return [row.tobytes() for row in both]


def described(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, n, node (the class of the set; null if it is empty), bands."""
    schema = "doc_id long, text_key long, n int, node binary, bands array<long>"
    out_type = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int32()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = part.column(2)
        n = np.diff(sets.offsets.to_numpy())
        values = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        full = np.flatnonzero(n)
        node: list[bytes | None] = [None] * len(n)
        held: list[np.ndarray | None] = [None] * len(n)
        if len(full):
            offsets = np.r_[0, np.cumsum(n[full])]
            hashes = band_hashes(signatures(values, offsets, bands * rows), bands, rows)
            for i, key, h in zip(full.tolist(), set_keys(values, offsets), hashes, strict=True):
                node[i], held[i] = key, h
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int32()), pa.array(node, pa.binary()), pa.array(held, pa.list_(pa.int64()))], schema=out_type)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            # Slices of rows with about CHUNK elements, so that memory follows the chunk, not the batch.
            upto = part.column(2).offsets.to_numpy()
            a = 0
            while a < len(part):
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + CHUNK, "right")) - 1)
                yield one(part.slice(a, b - a))
                a = b
            release()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), shingles(F.col("text"), size).alias("s"))
    return read.mapInArrow(run, schema)


def _contract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the links of one task: each node with its root."""
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for part in parts:
        for a, b in zip(part["a"], part["b"], strict=True):
            a, b = find(bytes(a)), find(bytes(b))
            if a != b:
                root[max(a, b)] = min(a, b)
    linked = [(x, find(x)) for x in root]
    linked = [(x, r) for x, r in linked if x != r]
    yield pd.DataFrame({"a": [x for x, _ in linked], "b": [r for _, r in linked]})


def components(links: DataFrame, place: Workspace, name: str) -> DataFrame:
    """node, root of every linked node but the roots, by large-star and small-star
    rounds (Kiveris et al. 2014) over links (a, b) contracted per task."""

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    edges = place.write(links.mapInPandas(_contract, "a binary, b binary"), f"{name}-0")
    before, k = state(edges), 0
    while True:
        k += 1
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every node with its smaller neighbours
        down = large.where(F.col("a") != F.col("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = place.write(small.where(F.col("a") != F.col("b")).distinct(), f"{name}-{k}")
        after = state(edges)
        place.drop(f"{name}-{k - 1}")
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    read = pairs.join(a, "a").join(b, "b").select("a", "b", shingles(F.col("text_a"), size).alias("x"), shingles(F.col("text_b"), size).alias("y"))
    both = read.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).cast("long").alias("i"))
    return both.where(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b")


def _apart(group: list[dict], percent: int) -> list[tuple[bytes, bytes]]:
    """Links between the roots in one block pair of a bucket.

    Overlaps of all members against those outside the largest root, as products
    of 0/1 matrices over the shingles that at least two members have.
    """
    names = sorted({bytes(m["root"]) for m in group})
    number = {r: i for i, r in enumerate(names)}
    root = np.array([number[bytes(m["root"])] for m in group])
    block = np.array([m["block"] for m in group])
    sizes = np.array([len(m["s"]) for m in group], np.int64)
    test = np.flatnonzero(root != np.bincount(root).argmax())
    values, inverse, often = np.unique(np.concatenate([m["s"] for m in group]), return_inverse=True, return_counts=True)
    column = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[inverse]
    owner = np.repeat(np.arange(len(group)), sizes)
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(test), len(group)), np.float32)
    for c in range(0, int(often[often > 1].size), COLUMNS):
        lo, hi = np.searchsorted(column, [c, c + COLUMNS])
        part = np.zeros((len(group), COLUMNS), np.float32)
        part[owner[lo:hi], column[lo:hi] - c] = 1
        shared += part[test] @ part.T
    i = shared.astype(np.int64)
    near = 100 * i >= percent * (sizes[test][:, None] + sizes[None, :] - i)
    near &= root[test][:, None] != root[None, :]
    if block.min() != block.max():  # pairs within a block are compared in that block's own group
        near &= block[test][:, None] != block[None, :]
    x, y = np.nonzero(near)
    links = {(min(a, b), max(a, b)) for a, b in zip(root[test][x].tolist(), root[y].tolist(), strict=True)}
    return [(names[a], names[b]) for a, b in sorted(links)]


def _across(left: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (ra, rb) between roots that share a bucket, every pair of members compared.

    left: bucket, node, n, root, and of the bucket: all (members), words (sum of n).
    A bucket is cut into blocks of bounded size; a group is a pair of blocks.
    """
    parts = F.ceil(F.greatest(F.col("all") / BLOCK_MEMBERS, F.col("words") / BLOCK_SHINGLES, F.lit(1.0))).cast("int")
    cut = left.withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = cut.join(texts, "node").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = rows.groupBy("bucket", F.least("block", "with").alias("bi"), F.greatest("block", "with").alias("bj"))
    groups = keyed.agg(F.collect_list(F.struct("root", "block", "text")).alias("g"))
    sets = groups.select(F.transform("g", lambda m: F.struct(m["root"].alias("root"), m["block"].alias("block"), shingles(m["text"], size).alias("s"))).alias("g"))

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            links = []
            for group in batch.column(0):
                members = group.values
                fields = {f: members.field(f) for f in ("root", "block")}
                s = members.field("s")
                rows = [{"root": fields["root"][i].as_py(), "block": fields["block"][i].as_py(), "s": s[i].values.to_numpy()} for i in range(len(members))]
                links += _apart(rows, percent)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], names=["ra", "rb"])

    return sets.mapInArrow(run, "ra binary, rb binary")


def _joined(links: DataFrame, roots: DataFrame, place: Workspace, name: str) -> DataFrame:
    """roots (node, root) after the links (ra, rb) between roots."""
    found = links.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    joined = components(found, place, f"{name}-roots").select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = roots.join(joined, roots["root"] == joined["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
    return place.write(moved, f"{name}-nodes")


def _order() -> Column:
    """Rows by doc_id, nulls last, then by text."""
    return F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")


def near_duplicates(docs: DataFrame, place: Workspace, size: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and first (boolean: the row, or one of equal rows, that stands for its component) of every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = place.write(described(docs, size, bands, rows), "described")
    # One row per class: its least document stands for it.
    classes = seen.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(_order()).alias("stands"))
    distinct = seen.where(F.col("node").isNotNull()).dropDuplicates(["node"]).select("node", "n", F.explode("bands").alias("bucket"))
    shared = distinct.groupBy("bucket").agg(F.count("*").alias("count"), F.min("node").alias("lo"), F.max("node").alias("hi")).where(F.col("lo") != F.col("hi"))
    members = place.write(distinct.join(shared.select("bucket", "count"), "bucket"), "members")
    # A member of many large buckets is near the middle of its group, hence a good hub.
    nodes = place.write(members.groupBy("node").agg(F.sum("count").alias("weight")), "nodes")

    wanted = classes.join(nodes, "node", "left_semi").select("node", F.col("stands.doc_id").alias("doc_id"), F.col("stands.text_key").alias("text_key"))
    same = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (text_key(docs["text"]) == wanted["text_key"])
    texts = place.write(docs.join(wanted, same).select("node", "text").dropDuplicates(["node"]), "texts")

    # Star: each member against the hub of its bucket.
    weighed = members.join(nodes, "node")
    hubs = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "node", "n")).alias("hub"))
    star = weighed.join(hubs, "bucket").where(F.col("node") != F.col("hub.node")).where(100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n"))
    star = star.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()
    links = place.write(_verified(star, texts, size, percent).select(F.col("a").alias("ra"), F.col("b").alias("rb")), "star-links")
    roots = _joined(links, nodes.select("node", F.col("node").alias("root")), place, "star")

    # Across: buckets whose members have several roots still.
    rooted = members.join(roots, "node")
    split = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("all"), F.sum("n").alias("words")).where(F.col("lo") != F.col("hi"))
    left = rooted.join(split.select("bucket", "all", "words"), "bucket")
    across = place.write(_across(left, texts, size, percent), "across-links")
    roots = _joined(across, roots, place, "across")

    # The least document of each component.
    roots = classes.select("node", "stands").join(roots, "node", "left").select("node", "stands", F.coalesce("root", "node").alias("root"))
    least = roots.groupBy("root").agg(F.min("stands").alias("least"))
    by_node = roots.join(least, "root").select("node", "least")
    found = seen.select("doc_id", "text_key", "n", "node").join(by_node, "node", "left")
    empty = F.col("node").isNull()
    own = F.when(empty, F.col("doc_id")).otherwise(F.col("least.doc_id"))
    first = empty | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key")))
    return found.select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"), first.alias("first"))


def kept(component_id: Column, doc_id: Column) -> Column:
    return doc_id.eqNullSafe(component_id)


def deduplicate(docs: DataFrame, place: Workspace, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all its columns."""
    found = near_duplicates(docs, place, size, percent)
    named = [F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")]
    counted = place.write(found.groupBy(*named).agg(F.bool_and("first").alias("first"), F.count("*").alias("n")), "counted")

    def among(rows: DataFrame, how: str) -> DataFrame:
        return docs.join(rows, docs["doc_id"].eqNullSafe(rows["__id"]) & (text_key(docs["text"]) == rows["__key"]), how)

    # Most rows are single; only the few that repeat both key and text are brought together, to leave one of them.
    gone = counted.where(~F.col("first") | (F.col("n") > 1)).select("__id", "__key")
    again = counted.where(F.col("first") & (F.col("n") > 1)).select("__id", "__key")
    one = among(again, "inner").dropDuplicates(["__id", "__key"]).select(*[docs[c] for c in docs.columns])
    return among(gone, "left_anti").unionByName(one)


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark, "minhash"), size=2)
    return found.select("doc_id", "n_shingles", "component_id", kept(F.col("component_id"), F.col("doc_id")).alias("kept"))
