"""URL filters: listed rules, and a Bloom filter cascade for the listed hosts.

The blocklist is a table of hosts (column ``host``); a host is listed if it or
one of its parent domains is in it.  The cascade answers "is this key on the
list?" exactly for every key of the corpus, its hosts and their parent
domains, without a join of the pages and without shipping the list.  Level 0
encodes the listed keys of the corpus; the unlisted keys that it lets through
by mistake are encoded in level 1, the listed keys that level 1 then wrongly
excuses in level 2, and so on, until a level makes no mistake on the corpus's
complete key universe.  A key's answer is the parity of the first level that
lacks it.

The universe is the distinct keys (partially aggregated, so a host with a
third of all pages is one row per task), told listed from unlisted once, by
host; each level is one pass over it in Spark, which only returns the set words
of the level's bit array.  Keys are two 64-bit hashes.  A level's size follows
the number of keys it encodes, and all levels together are checked against
``MAX_BYTES`` before they are broadcast: beyond it the keys are split by hash
into as many blocks as bring each cascade below the bound, and the pages are
judged block by block.

Rules come first: the longest one that fits a URL decides (of equally long
ones the alphabetically first).  Rules are a small parameter (at most
``MAX_RULES``) and become one built-in expression.

Defined results: a null URL, or one without ``://``, has an empty host and path,
fits no rule and is not listed; equal rows get equal verdicts; repeated and
null hosts of the list and letters A-Z in it do not matter; an empty table or
list builds an empty cascade, which lists nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, lower_ascii, table
from .ragged import mix

#: The rules of the query (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The query's blocklist: these registered domains under each of the zones.
BLOCKED_NAMES = ("spam-farm", "casino-win", "cheap-pills", "adult-x", "ads-track", "free-bets")
ZONES = ("example.com", "example.net", "example.org")
MAX_RULES = 1000
BITS_PER_KEY = 12
HASHES = 6
MAX_BYTES = 64 << 20
MAX_LEVELS = 64


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    rule, verdict = None, None
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return rule, verdict


def _probes(keys: np.ndarray, level: int, n_bits: int) -> np.ndarray:
    """Bit positions (keys x HASHES) of keys, rows of two 64-bit hashes, in one level."""
    with np.errstate(over="ignore"):
        k = keys.astype(np.int64).view(np.uint64)
        salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
        h, step = mix(k[:, 0] + salt), mix(k[:, 1] ^ salt) | np.uint64(1)
        return (h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(n_bits)


@dataclass
class Level:
    n_bits: int
    words: np.ndarray  # uint64

    def has(self, keys: np.ndarray, level: int) -> np.ndarray:
        at = _probes(keys, level, self.n_bits)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


@dataclass
class Cascade:
    levels: list[Level]

    def listed(self, keys: np.ndarray) -> np.ndarray:
        """The parity of the first level that lacks each key."""
        answer = np.zeros(len(keys), bool)
        left = np.arange(len(keys))
        for k, level in enumerate(self.levels):
            left = left[level.has(keys[left], k)]
            answer[left] = k % 2 == 0
            if not len(left):
                break
        return answer


def _bits(n: int) -> int:
    return max(64, -(-n * BITS_PER_KEY // 64) * 64)


def _build_level(members: DataFrame, level: int, n: int) -> Level:
    """The bit array of the members: bits are or-ed in each task, then by word in Spark."""
    n_bits = _bits(n)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[int, int] = {}
        for part in parts:
            at = _probes(part[["a", "b"]].to_numpy(), level, n_bits).ravel()
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            order = np.argsort(word, kind="stable")
            word, bit = word[order], bit[order]
            if len(word):
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                yield pd.DataFrame({"word": word[first], "bits": np.bitwise_or.reduceat(bit, first).view(np.int64)})

    found = members.select("a", "b").mapInPandas(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(n_bits // 64, np.uint64)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return Level(n_bits, words)


def _passes(held):
    """A condition: the key (a, b) is in all levels so far."""

    @F.pandas_udf(T.BooleanType())
    def passes(a: pd.Series, b: pd.Series) -> pd.Series:
        keys, ok = np.stack([a.to_numpy(), b.to_numpy()], axis=1), np.ones(len(a), bool)
        for k, level in enumerate(held.value):
            ok &= level.has(keys, k)
        return pd.Series(ok)

    return passes


def _answers(held, block: int, blocks: int):
    """A condition: the cascade of one block lists one of the keys (array of a, b, a, b and so on)."""

    @F.pandas_udf(T.BooleanType())
    def listed(keys: pd.Series) -> pd.Series:
        sizes = keys.map(len).to_numpy() // 2
        flat = np.concatenate([np.asarray(k, np.int64) for k in keys]).reshape(-1, 2) if len(keys) else np.zeros((0, 2), np.int64)
        hit = held.value.listed(flat) & (flat[:, 0] % blocks == block)
        return pd.Series(np.bincount(np.repeat(np.arange(len(keys)), sizes), weights=hit, minlength=len(keys)) > 0)

    return listed


def build_cascade(universe: DataFrame) -> Cascade:
    """universe: a, b (longs, the key), listed (boolean), every key once."""
    sc = universe.sparkSession.sparkContext
    levels: list[Level] = []
    held = None  # the levels so far, while the next one is built
    left = universe.where("listed")
    while n := left.count():
        if len(levels) >= MAX_LEVELS:
            raise RuntimeError("a listed and an unlisted host agree in both hashes")
        levels.append(_build_level(left, len(levels), n))
        # The next level holds what this one lets through by mistake: keys of the other kind.
        other = universe.where(F.col("listed") == F.lit(len(levels) % 2 == 0))
        if held is not None:
            held.unpersist()
        held = sc.broadcast(list(levels))
        left = other.where(_passes(held)("a", "b"))
    if held is not None:
        held.unpersist()
    return Cascade(levels)


def domains(host: Column) -> Column:
    """A host and its parent domains; none for the empty host."""
    labels = F.split(host, r"\.")
    made = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(made)


def _key(host: Column) -> list[Column]:
    return [F.xxhash64(host), F.xxhash64(F.lit("second"), host)]


def keyed_universe(hosts: DataFrame, blocklist: DataFrame, place: Workspace, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, int]:
    """The written table of the corpus's keys (a, b, listed), and in how many blocks its cascades stay below the bound.

    hosts, blocklist: column host, repeated or not.
    """
    keys = hosts.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("host")).distinct()
    banned = blocklist.where(F.col("host").isNotNull()).select(lower_ascii(F.col("host")).alias("host")).distinct().withColumn("on", F.lit(True))
    a, b = _key(F.col("host"))
    known = keys.join(banned, "host", "left").select(a.alias("a"), b.alias("b"), F.col("on").isNotNull().alias("listed"))
    universe = place.write(known, "universe")
    n = universe.where("listed").count()
    # All levels together stay below four times level 0 at this number of bits.
    return universe, max(1, -(-4 * _bits(n) // 8 // max_bytes))


def block_cascade(universe: DataFrame, block: int, blocks: int) -> Cascade:
    return build_cascade(universe.where(F.pmod(F.col("a"), F.lit(blocks)) == block))


def apply_cascade(rows: DataFrame, cascade: Cascade, block: int = 0, blocks: int = 1, host: str = "host") -> tuple[DataFrame, object]:
    """(rows with ``listed``: whether the cascade's block lists one of their keys; the broadcast that they need)."""
    if not cascade.levels:
        return rows.withColumn("listed", F.lit(False)), None
    held = rows.sparkSession.sparkContext.broadcast(cascade)
    keys = F.flatten(F.transform(domains(F.col(host)), lambda d: F.array(*_key(d))))
    return rows.withColumn("__keys", keys).withColumn("listed", _answers(held, block, blocks)(F.col("__keys"))).drop("__keys"), held


def judged(pages: DataFrame, blocklist: DataFrame, place: Workspace, max_bytes: int = MAX_BYTES, host: str = "host") -> DataFrame:
    """pages with ``listed``. One block judges every page as it is read; several
    are built, broadcast, asked about the distinct hosts and released one after
    the other, and the hosts that they list join the pages."""
    universe, blocks = keyed_universe(pages.select(F.col(host).alias("host")), blocklist, place, max_bytes)
    if blocks == 1:
        return apply_cascade(pages, block_cascade(universe, 0, 1), host=host)[0]
    hosts = place.write(pages.select(F.col(host).alias("__host")).distinct(), "hosts")
    found = None
    for k in range(blocks):
        asked, held = apply_cascade(hosts, block_cascade(universe, k, blocks), k, blocks, "__host")
        mine = place.write(asked.where("listed").select("__host"), f"listed-{k}")
        if held is not None:
            held.unpersist()
        found = mine if found is None else found.unionByName(mine)
    listed = found.distinct().withColumn("listed", F.lit(True))
    return pages.join(listed, F.col(host) == F.col("__host"), "left").withColumn("listed", F.coalesce("listed", F.lit(False))).drop("__host")


def blocked_domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"{n}.{z}",) for n in BLOCKED_NAMES for z in ZONES], "host string")


def filter_urls(pages: DataFrame, blocklist: DataFrame, place: Workspace, rules=RULES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    read = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return judged(read, blocklist, place, max_bytes).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"))


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), blocked_domains(spark), Workspace(spark, "urls"))


OP9_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS t(what, h, p)
), best AS (
  SELECT u.page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(what, length(h || p)) AS verdict
  FROM u JOIN r ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)
  GROUP BY u.page_id
), banned AS (
  SELECT n || '.' || z AS b FROM (VALUES ('spam-farm'), ('casino-win'), ('cheap-pills'), ('adult-x'), ('ads-track'), ('free-bets')) AS x(n), (VALUES ('example.com'), ('example.net'), ('example.org')) AS y(z)
)
SELECT u.page_id, host, path, rule,
       coalesce(verdict, CASE WHEN EXISTS (FROM banned WHERE u.host = b OR ends_with(u.host, '.' || b)) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best USING (page_id)
"""
