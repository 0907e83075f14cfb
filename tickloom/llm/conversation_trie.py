"""Prefix trie of conversations: double arrays per shard, upper nodes merged.

A conversation is its path: one (hash, hash, words) per turn, the texts stay
behind.  Equal paths are put together first, with their number, least id and
the digest of their ids, so a conversation that many copy is one path.  The
distinct paths are dealt by range of their lexicographic order, so a shard
holds a contiguous piece of the trie however hot a prefix is; each task packs
its piece into BASE and CHECK arrays over dense turn ids, walks all its paths
through them and sums over subtrees.  Only the nodes on a shard's first and
last path can be in another shard, too; they are summed by node afterwards.

How shared nodes stay right without their descendants: a node in several
shards is always on the first path of all but the leftmost of them.  Every
shard counts it as its own, so each further shard gives back, along its first
path, one child of the parent, the words it took off ``saved_tokens``, and the
leaf that the leftmost shard saw if its last path ends there.

The digest of ids is a running SHA-256 over chunks of sorted ids (``1 << CHUNK``
ids at most), so a node where a third of all conversations end needs one small
buffer, not one row.

Bounds: a path is one row (about 20 bytes a turn); a shard has about
``SHARD_TURNS`` turns, or one path.  Nothing is broadcast.

Defined results for odd input: turns are ordered by turn (null first), then
role, then the MD5 of the text, so ties and repeated rows are separate turns in
a fixed order; null role or text is empty; rows without conv_id are no
conversation; negative ids keep SQL's remainder; extra columns are ignored; an
empty table has no nodes, not even a root.  Paths, and nodes of different
shards, are told apart by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, table
from .ragged import mix, release

SHARED_EVERY = 20
HEADS = 4
CHUNK = 10
SHARD_TURNS = 400_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
ROUNDS = 4
TRIES = 64

PATH_KEYS = "hi long, lo long"
NODE_SCHEMA = (
    "shard int, open boolean, depth long, hi long, lo long, parent_hi long, parent_lo long, parent_open boolean, parent_conv long, "
    "conv_id long, n_convs long, n_children long, n_leaves long, saved long, words long, leaf boolean, ends string"
)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its own turns in order: w, an array of (a, b, n)."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turn = F.struct(
        F.col("turn"), role.alias("role"), F.md5(text).alias("t"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), n_words(text).cast("int").alias("n")
    )
    listed = conversations.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("w"))
    return listed.select("conv_id", F.transform("w", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["n"].alias("n"))).alias("w"))


def rebuilt(own: DataFrame) -> DataFrame:
    """conv_id and path: the first h turns of the conversation it shares them with, then its own after h."""
    base = own.where(F.col("conv_id") % SHARED_EVERY == 0).select(F.col("conv_id").alias("base"), F.slice("w", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARED_EVERY).withColumn("h", h).join(base, "base", "left")
    none = F.slice("w", 1, 0)
    head = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    return joined.select("conv_id", F.concat(head, F.slice("w", F.col("h") + 1, F.greatest(F.size("w") - F.col("h"), F.lit(0)))).alias("path"))


def _digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by path and ids, to one row per path; the digest runs on from chunk to chunk."""
    at, held = None, None

    def row():
        return [*at, held[0], held[1], held[2].hexdigest()]

    for part in parts:
        done = []
        for hi, lo, n, conv, ids in zip(*[part.column(c).to_pylist() for c in ("hi", "lo", "n", "conv_id", "ids")], strict=True):
            if (hi, lo) == at:
                held[0], held[1] = held[0] + n, min(held[1], conv)
                held[2].update(b"," + ids.encode())
            else:
                if at is not None:
                    done.append(row())
                at, held = (hi, lo), [n, conv, hashlib.sha256(ids.encode())]
        if done:
            yield _batch(done)
    if at is not None:
        yield _batch([row()])


def _batch(rows: list[list]) -> pa.RecordBatch:
    names, kinds = ("hi", "lo", "n", "conv_id", "ends"), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def distinct_paths(paths: DataFrame) -> DataFrame:
    """One row per distinct path: path, n, conv_id (least), ends. ``paths`` is a written table with the keys."""
    chunks = paths.groupBy("hi", "lo", F.shiftright("conv_id", CHUNK).alias("chunk")).agg(
        F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids")
    )
    merged = chunks.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "chunk").mapInArrow(_digests, f"{PATH_KEYS}, n long, conv_id long, ends string")
    return merged.select("n", "conv_id", "ends").join(paths.select("conv_id", "path"), "conv_id")


class DoubleArray:
    """BASE and CHECK: the child of state s by turn t is BASE[s] + t if CHECK of that is s."""

    def __init__(self, parent: np.ndarray, label: np.ndarray, n_nodes: int):
        """Children are given parent by parent; node 0 is the root and node k + 1 is made by entry k."""
        first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]]) if len(parent) else np.zeros(0, np.int64)
        count = np.diff(np.r_[first, len(parent)])
        self.used = np.zeros(max(64, 2 * n_nodes), bool)
        self.used[0], self.top, self.low = True, 1, 1
        slot, base = np.zeros(n_nodes, np.int64), np.zeros(n_nodes, np.int64)
        # Wide families first, while there is room; only children take what is left.
        several = np.flatnonzero(count > 1)
        for k in several[np.argsort(-count[several], kind="stable")]:
            own = slice(first[k], first[k] + count[k])
            labels = label[own]
            start = self._place(np.sort(labels - labels.min()))
            base[parent[first[k]]] = start - labels.min()
            slot[1 + first[k] : 1 + first[k] + count[k]] = start + labels - labels.min()
        single = first[count == 1]
        free = np.flatnonzero(~self.used[: self.top])[: len(single)]
        free = np.r_[free, self.top + np.arange(len(single) - len(free))].astype(np.int64)
        slot[1 + single] = free
        base[parent[single]] = free - label[single]
        size = int(slot.max()) + 1
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.base[slot] = base
        self.check[slot[1:]] = slot[parent]

    def _place(self, offsets: np.ndarray) -> int:
        """A start where all offsets are free: among the first free slots, else behind all."""
        span = int(offsets[-1]) + 1
        at = self.low
        for _ in range(ROUNDS):
            free = at + np.flatnonzero(~self.used[at : min(self.top, at + 16 * TRIES)])[:TRIES]
            if not len(free):
                break
            self._room(int(free[-1]) + span)
            ok = ~self.used[free[:, None] + offsets].any(axis=1)
            if ok.any():
                return self._take(int(free[ok.argmax()]), offsets)
            at = int(free[-1]) + 1
        self._room(self.top + span)
        return self._take(self.top, offsets)

    def _room(self, size: int) -> None:
        if size > len(self.used):
            self.used = np.r_[self.used, np.zeros(size, bool)]

    def _take(self, start: int, offsets: np.ndarray) -> int:
        self.used[start + offsets] = True
        self.top = max(self.top, start + int(offsets[-1]) + 1)
        while self.low < self.top and self.used[self.low]:
            self.low += 1
        return start

    def child(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The children by label; -1 where there is none."""
        at = self.base[state] + label
        inside = (at >= 0) & (at < len(self.check))
        at = np.where(inside, at, 0)
        return np.where(inside & (self.check[at] == state) & (at > 0), at, -1)


def dense_ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Turns numbered by first appearance, so that siblings lie close together."""
    if not len(a):
        return np.zeros(0, np.int64)
    order = np.lexsort((b, a))
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(new) - 1
    seen = np.full(int(new.sum()), len(a), np.int64)
    np.minimum.at(seen, group, np.arange(len(a)))
    rank = np.empty(len(seen), np.int64)
    rank[np.argsort(seen)] = np.arange(len(seen))
    return rank[group]


def build(lengths: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> DoubleArray:
    """The trie of paths in lexicographic order: where a path leaves the one before it, nodes begin."""
    node, n = np.zeros(len(lengths), np.int64), 1
    parents, labels = [], []
    active, depth = np.flatnonzero(lengths > 0), 0
    while len(active):
        p, t = node[active], ids[starts[active] + depth]
        new = np.r_[True, (p[1:] != p[:-1]) | (t[1:] != t[:-1])]
        parents.append(p[new])
        labels.append(t[new])
        node[active] = n + np.cumsum(new) - 1
        n += int(new.sum())
        depth += 1
        active = active[lengths[active] > depth]
    none = [np.zeros(0, np.int64)]
    return DoubleArray(np.concatenate(parents or none), np.concatenate(labels or none), n)


def shard_nodes(shard: int, lengths, a, b, words, n, conv, ends) -> dict[str, np.ndarray]:
    """All nodes of one shard with what its own paths say of them."""
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    ids = dense_ids(a, b)
    trie = build(lengths, starts, ids)
    size = len(trie.check)
    big = np.iinfo(np.int64).max
    count, least, depth_of, words_of = np.zeros(size, np.int64), np.full(size, big), np.full(size, -1), np.zeros(size, np.int64)
    hi, lo = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
    count[0], least[0], depth_of[0] = n.sum(), conv.min(), 0
    is_open, state = np.zeros(size, bool), np.zeros(len(lengths), np.int64)
    is_open[0] = True
    levels, active, depth = [np.zeros(1, np.int64)], np.flatnonzero(lengths > 0), 0
    with np.errstate(over="ignore"):
        while len(active):
            at = starts[active] + depth
            came, went = state[active], trie.child(state[active], ids[at])
            assert (went > 0).all()
            np.add.at(count, went, n[active])
            np.minimum.at(least, went, conv[active])
            depth += 1
            depth_of[went], words_of[went] = depth, words[at]
            hi[went] = mix(hi[came] * np.uint64(0x9E3779B97F4A7C15) + a[at].view(np.uint64))
            lo[went] = mix(lo[came] * np.uint64(0xC2B2AE3D27D4EB4F) + b[at].view(np.uint64) + np.uint64(1))
            state[active] = went
            is_open[went[(active == 0) | (active == len(lengths) - 1)]] = True
            levels.append(went[np.r_[True, went[1:] != went[:-1]]])
            active = active[lengths[active] > depth]
    parent = trie.check
    children = np.bincount(np.concatenate([parent[x] for x in levels[1:]]), minlength=size) if len(levels) > 1 else np.zeros(size, np.int64)
    leaves, saved = (children == 0).astype(np.int64), (count - 1) * words_of
    for level in levels[:0:-1]:
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    end_of = np.full(size, -1, np.int64)
    end_of[state] = np.arange(len(lengths))
    x = np.concatenate(levels)
    up = np.maximum(parent[x], 0)
    root = x == 0
    return {
        "shard": np.full(len(x), shard, np.int32), "open": is_open[x], "depth": depth_of[x].astype(np.int64), "hi": hi[x].view(np.int64), "lo": lo[x].view(np.int64),
        "parent_hi": hi[up].view(np.int64), "parent_lo": lo[up].view(np.int64), "parent_open": is_open[up] & ~root, "parent_conv": np.ma.array(least[up], mask=root | is_open[up]),
        "conv_id": least[x], "n_convs": count[x], "n_children": children[x].astype(np.int64), "n_leaves": leaves[x], "saved": saved[x], "words": words_of[x],
        "leaf": children[x] == 0, "ends": ends.take(pa.array(end_of[x], mask=end_of[x] < 0)),
    }


def _shard(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All paths of one range, in order, to its nodes."""
    parts = [p for p in parts if p.num_rows]
    if not parts:
        return
    rows = pa.Table.from_batches(parts).combine_chunks()
    whole = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    path = whole(rows["path"])
    turns_ = path.flatten()
    value = lambda name: turns_.field(name).to_numpy(zero_copy_only=False)
    number = lambda name: rows[name].to_numpy()
    lengths = path.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    found = shard_nodes(TaskContext.get().partitionId(), lengths, value("a"), value("b"), value("n").astype(np.int64), number("n"), number("conv_id"), whole(rows["ends"]))
    masked = lambda v: pa.array(v.data, mask=np.ma.getmaskarray(v)) if isinstance(v, np.ma.MaskedArray) else pa.array(v) if isinstance(v, np.ndarray) else v
    made = pa.RecordBatch.from_arrays([masked(v) for v in found.values()], list(found))
    for at in range(0, made.num_rows, 50_000):
        yield made.slice(at, 50_000)
    del rows, path, turns_, found, made
    release()


def trie_nodes(conversations: DataFrame, place: Workspace) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 per node."""
    spark = conversations.sparkSession
    keyed = rebuilt(turns(conversations)).withColumns(
        {"hi": F.xxhash64(F.transform("path", lambda t: t["a"])), "lo": F.xxhash64(F.lit(1), F.transform("path", lambda t: t["b"]))}
    )
    paths = place.write(keyed, "paths")
    seqs = place.write(distinct_paths(paths), "distinct")
    n_turns = seqs.agg(F.sum(F.size("path"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_turns // SHARD_TURNS))
    shards = seqs.repartitionByRange(n, "path").sortWithinPartitions("path").mapInArrow(_shard, NODE_SCHEMA)
    nodes = place.write(shards, "nodes")

    node = ["hi", "lo"]
    by_node, down = Window.partitionBy(*node), Window.partitionBy("shard").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    shared = nodes.where("open").withColumns(
        {"k": F.row_number().over(by_node.orderBy("shard")), "was_leaf": F.max("leaf").over(by_node), "all_conv": F.min("conv_id").over(by_node)}
    )
    # What further shards give back lies on their first path, above the deepest node that is not theirs.
    again = shared.where("k > 1").select(
        "shard", *node,
        F.sum("words").over(down).alias("more_saved"),
        F.sum(F.when(F.col("was_leaf") & (F.col("k") == 2), 1).otherwise(0)).over(down).alias("less_leaves"),
        F.when(F.row_number().over(Window.partitionBy("shard").orderBy(F.col("depth").desc())) > 1, 1).otherwise(0).alias("less_children"),
    )
    fixed = shared.join(again, ["shard", *node], "left").na.fill(0, ["more_saved", "less_leaves", "less_children"])
    merged = fixed.groupBy(*node).agg(
        F.max("depth").alias("depth"), F.max("parent_hi").alias("parent_hi"), F.max("parent_lo").alias("parent_lo"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum(F.col("n_children") - F.col("less_children")).alias("n_children"), F.sum(F.col("n_leaves") - F.col("less_leaves")).alias("n_leaves"),
        F.sum(F.col("saved") + F.col("more_saved")).alias("saved"), F.max("ends").alias("ends"),
    )
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    above = merged.select(F.col("hi").alias("parent_hi"), F.col("lo").alias("parent_lo"), F.col("conv_id").alias("parent_conv_id"))
    upper = merged.join(above, ["parent_hi", "parent_lo"], "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id"))).select(*out)
    here = shared.select("shard", F.col("hi").alias("parent_hi"), F.col("lo").alias("parent_lo"), F.col("all_conv").alias("parent_conv_id"))
    edge = nodes.where("not open and parent_open").join(here, ["shard", "parent_hi", "parent_lo"]).select(*out)
    inner = nodes.where("not open and not parent_open").withColumnRenamed("parent_conv", "parent_conv_id").select(*out)
    whole = upper.unionByName(edge).unionByName(inner)
    return whole.select(*out[:-2], F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return trie_nodes(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), Workspace(spark, "trie"))


#: CRC-32 of a list of byte values, with its table (reflected polynomial 0xEDB88320) made on the spot.
CRC_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"


def sql_crc32(codes: str, tab: str) -> str:
    """SQL for the CRC-32 of a list of byte values; ``tab`` names the table's column."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda s, v: xor(s >> 8, {tab}[CAST((xor(s, v) & 255) + 1 AS BIGINT)])), 4294967295)"


OP12_SQL = rf"""
WITH tab AS (
  SELECT {CRC_TABLE} AS t
), own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS w
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), head AS (
  SELECT own.*, {sql_crc32("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))", "tab.t")} % 4 AS h FROM own, tab
), path AS (
  SELECT c.conv_id, list_concat(coalesce(b.w, [])[1:c.h], c.w[c.h + 1:]) AS w
  FROM head c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
), pre AS (
  SELECT conv_id, len(w) AS n, unnest(range(0, len(w) + 1)) AS depth, w FROM path
), node AS (
  SELECT w[1:depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM pre GROUP BY 1, 2
), kids AS (
  SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1
), own_values AS (
  SELECT node.k, depth, n_children IS NULL AS leaf,
         CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(node.k[depth].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved
  FROM node LEFT JOIN kids USING (k)
), sums AS (
  SELECT k[1:d] AS k, sum(CAST(leaf AS BIGINT)) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM own_values) GROUP BY 1
)
SELECT node.conv_id, node.depth, p.conv_id AS parent_conv_id, CAST(node.n_convs AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, node.ends_sha256
FROM node LEFT JOIN kids USING (k) JOIN sums USING (k) LEFT JOIN node p ON node.depth > 0 AND p.depth = node.depth - 1 AND p.k = node.k[1:node.depth - 1]
"""
