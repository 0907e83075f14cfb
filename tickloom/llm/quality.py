"""Quality classifier learned from positives and unlabelled text.

Non-negative PU learning (Kiryo et al. 2017): with prior p of good text,
trusted positives P and unlabelled text U, a logistic model on binned text
features minimises  p R+(P) + max(0, R-(U) - p R-(P)).

U is every text that is not held out.  Spark writes their features once, counts
their distribution (from which the bins follow) and codes them; each step of
the fit is one pass over the codes that returns sums of losses and gradients at
a few points of a line, in whole numbers, so that no order of tasks changes
them.  What is sampled is P, at most ``SAMPLE`` labelled rows (a documented
bound, drawn by the hash of doc_id), and as many rows that only shape the
direction of steps (their second derivatives), not where the fit ends.

The class prior comes from P and U alone: a classifier of P against U is fitted
on one half of P; above any score the share of U that lies there is at least p
times the share of P, so the least ratio of both, on the other half of P,
estimates p.  The lower end of what chance allows is taken: with a prior above
the true one the negative part falls to zero before negatives are told apart,
with one below it good texts just score p over the true prior at most, so the
risk is given nine tenths of it.  Labels other than the positive ones are not
used.  Inputs of a score are the text's own features and nothing else.

Defined results: null and empty texts have the features of an empty text and
get a score as any other; equal texts have equal scores; rows that repeat
come back repeated; a null doc_id is not held out and is unlabelled text like
any other; contradicting labels of one doc_id count one by one, so that one
positive label makes a row trusted; without any positive row or any text all
scores are 0.5; extra columns pass through, but for one with the name of the
score, which is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, table
from .ragged import release

SAMPLE = 20_000
FOLDS = 5
THRESHOLD = 0.3
#: Edges of the features' bins: finer at the tails, where odd texts are.
QUANTILES = (0.005, 0.01, 0.02, 0.03, 0.05, 0.08, *np.arange(0.12, 0.9, 0.06), 0.92, 0.94, 0.95, 0.96, 0.97, 0.98, 0.99, 0.995)
BINS = len(QUANTILES)
#: Decay of the weights, times the number of positive rows: few of them say little.
DECAY = 5.0
STEPS = 12
#: Lengths of a step that one pass tries.
LENGTHS = (1.0, 0.5, 0.25, 0.125, 0.03)
#: The prior's ratio is taken at scores above which at least this share of P lies.
LEAST_SHARE = 0.2
#: Standard errors of P's share that the prior allows for, and the share of the estimate that the risk is given.
CHANCE = 3.0
SHARE = 0.9
#: Sums of losses and gradients are of whole numbers of these.
UNIT = 2.0**-24
CURVES = 500

_GROUPS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32,), "line": (10, 13), "high": range(128, 256),
    "stop": (46, 44, 59, 58), "shout": (33, 63), "pipe": (124,), "quote": (34, 39, 96), "bracket": (40, 41, 91, 93, 123, 125, 60, 62),
    "mark": (35, 36, 37, 38, 42, 43, 64, 94, 95, 126, 61, 47, 92), "dash": (45,),
}
FEATURES = (*_GROUPS, "log_bytes", "word_length", "long_words", "unique_words", "top_word", "line_length", "repeated_lines", "capitalised", "marked_words", "echoed_words", "short_lines", "byte_entropy", "compressed")


def text_features(text: str | None) -> list[float]:
    """Shares of character groups, and of word, line and repetition patterns, over the whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(len(raw), 1)
    out = [hist[list(g)].sum() / n for g in _GROUPS.values()]
    words = raw.split()
    k = max(len(words), 1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x]
    share = hist[hist > 0] / n
    # Compression is measured over all of the text, piece by piece, so that it means the same at any length.
    pieces = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
    packed = sum(len(zlib.compress(p, 1)) for p in pieces)
    out += [
        np.log1p(len(raw)),
        sum(map(len, words)) / k,
        sum(c for w, c in counts.items() if len(w) > 15) / k,
        len(counts) / k,
        max(counts.values(), default=0) / k,
        np.log1p(len(raw) / max(len(lines), 1)),
        1 - len(set(lines)) / max(len(lines), 1),
        sum(c for w, c in counts.items() if 65 <= w[0] <= 90) / k,
        sum(c for w, c in counts.items() if not (w[-1] >= 128 or 48 <= w[-1] <= 57 or 65 <= (w[-1] & 0xDF) <= 90)) / k,
        sum(map(bytes.__eq__, words, words[1:])) / k,
        sum(len(x) < 40 for x in lines) / max(len(lines), 1),
        float(-(share * np.log2(share)).sum()) if len(raw) else 0.0,
        packed / n,
    ]
    return [float(x) for x in out]


@F.pandas_udf(T.ArrayType(T.FloatType()))
def features_of(text: pd.Series) -> pd.Series:
    found = text.map(text_features)
    release()
    return found


def _rows(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float32) if len(column) else np.zeros((0, len(FEATURES)), np.float32)


@dataclass
class Model:
    edges: list[np.ndarray]
    weights: np.ndarray
    bias: float
    prior: float

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Column of the one-hot coding, for each row and feature."""
        return _codes(self.edges, x)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.weights[self.encode(x)].sum(axis=1) + self.bias, -30, 30)))


def _codes(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j].astype(np.float32)) + j * (BINS + 1) for j, e in enumerate(edges)], axis=1)


def bin_edges(features: DataFrame) -> list[np.ndarray]:
    """The quantiles of each feature over all rows, from exact counts of the
    values' leading 16 bits (a relative precision of 1/128)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = _rows(part["x"])
            top = x.view(np.uint32).astype(np.int64) >> 16
            key, n = np.unique(top + (np.arange(x.shape[1], dtype=np.int64) << 16), return_counts=True)
            yield pd.DataFrame({"feature": (key >> 16).astype(np.int32), "top": (key & 0xFFFF).astype(np.int32), "n": n.astype(np.int64)})

    # At most 2**15 values of each feature: they are not negative.
    held = features.select("x").mapInPandas(run, "feature int, top int, n long").groupBy("feature", "top").agg(F.sum("n").alias("n")).toPandas()
    edges = []
    for j in range(len(FEATURES)):
        one = held[held["feature"] == j].sort_values("top")
        upto = one["n"].to_numpy().cumsum()
        at = np.searchsorted(upto, np.array(QUANTILES) * upto[-1]).clip(0, len(upto) - 1)
        # The largest number with these leading bits.
        edges.append(np.unique(((one["top"].to_numpy()[at].astype(np.uint32) << 16) | 0xFFFF).view(np.float32)))
    return edges


class Unlabelled:
    """Sums over all unlabelled rows, each set of them one pass in Spark."""

    def __init__(self, codes: DataFrame, size: int):
        self.codes, self.size = codes, size
        self.rows = codes.count()

    def _sums(self, numbers) -> np.ndarray:
        """numbers(codes) -> vector, added up over the rows."""

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = 0
            for part in parts:
                if len(part):
                    raw = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1)
                    total = total + numbers(raw.astype(np.int64) + np.arange(raw.shape[1]) * (BINS + 1))
            if not np.isscalar(total):
                yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

        held = self.codes.mapInPandas(run, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(int(held["k"].max()) + 1)
        out[held["k"].to_numpy()] = held["v"].to_numpy(np.float64)
        return out

    def losses(self, thetas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean of softplus(f), and its gradient, at each of the thetas."""
        size = self.size

        def numbers(codes: np.ndarray) -> np.ndarray:
            out = []
            for theta in thetas:
                f = theta[:-1][codes].sum(axis=1) + theta[-1]
                g = np.rint(_sigmoid(f) / UNIT)
                flat = np.bincount(codes.ravel(), weights=np.repeat(g, codes.shape[1]), minlength=size)
                out += [[np.rint(np.logaddexp(0, f) / UNIT).sum()], flat, [g.sum()]]
            return np.concatenate(out).astype(np.int64)

        found = self._sums(numbers).reshape(len(thetas), -1) * UNIT / self.rows
        return found[:, 0], found[:, 1:]

    def histogram(self, theta: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Rows between the cuts of f."""

        def numbers(codes: np.ndarray) -> np.ndarray:
            f = theta[:-1][codes].sum(axis=1) + theta[-1]
            return np.bincount(np.searchsorted(cuts, f), minlength=len(cuts) + 1)

        return self._sums(numbers)


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _value(codes: np.ndarray, theta: np.ndarray) -> np.ndarray:
    return theta[:-1][codes].sum(axis=1) + theta[-1]


def _pull(codes: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
    return np.r_[np.bincount(codes.ravel(), weights=np.repeat(g, codes.shape[1]), minlength=size), g.sum()]


def _curvature(codes: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Mean second derivatives of softplus(f) over some rows."""
    size = len(theta)
    total = np.zeros((size, size))
    for a in range(0, len(codes), CURVES):
        c = codes[a : a + CURVES]
        x = np.zeros((len(c), size), np.float32)
        x[np.arange(len(c))[:, None], c] = 1
        x[:, -1] = 1
        s = _sigmoid(_value(c, theta))
        total += x.T @ (x * (s * (1 - s)).astype(np.float32)[:, None])
    return total / max(len(codes), 1)


def minimise(positive: np.ndarray, unlabelled: Unlabelled, shape: np.ndarray, prior: float | None, steps: int = STEPS) -> np.ndarray:
    """Weights and bias of the least risk: the non-negative PU risk with a
    prior, or of telling P from U without one.

    Newton steps; of the lengths tried the best one counts.  For the PU risk
    only lengths that leave R-(U) - p R-(P) above zero do: there the fit stops,
    since below only chance is fitted.
    """
    size, n = unlabelled.size, len(positive)
    decay = DECAY / n
    share = 1.0 if prior is None else prior
    theta = np.zeros(size + 1)
    if prior is not None:
        theta[-1] = np.log(prior / (1 - prior))

    def risks(thetas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Risk, its negative part and its gradient at each of the thetas."""
        loss, grad = unlabelled.losses(thetas)
        f = np.array([_value(positive, t) for t in thetas])
        plus, minus = np.logaddexp(0, -f).mean(axis=1), np.logaddexp(0, f).mean(axis=1)
        part = loss if prior is None else loss - prior * minus
        pulls = [(_sigmoid(x) - 1) if prior is None else np.full(n, -1.0) for x in f]
        grad = grad + share * np.array([_pull(positive, p, size) for p in pulls]) / n
        grad[:, :-1] += decay * thetas[:, :-1]
        return share * plus + np.maximum(part, 0) + decay / 2 * (thetas[:, :-1] ** 2).sum(axis=1), part, grad

    (risk,), _, (grad,) = risks(theta[None])
    for _ in range(steps):
        curve = _curvature(shape, theta) + (decay + 1e-6) * np.eye(size + 1)
        if prior is None:
            curve += _curvature(positive[: len(shape)], theta)
        step = -np.linalg.solve(curve, grad)
        thetas = theta + np.array(LENGTHS)[:, None] * step
        found, part, grads = risks(thetas)
        good = np.flatnonzero((part >= 0) & (found < risk))
        if not len(good):
            break
        best = good[np.argmin(found[good])]
        gained, risk, theta, grad = risk - found[best], found[best], thetas[best], grads[best]
        if gained < 1e-5:
            break
    return theta


def estimated_prior(positive: np.ndarray, unlabelled: Unlabelled, shape: np.ndarray) -> float:
    """The share of good text in U, from P and U."""
    learn, test = positive[::2], positive[1::2] if len(positive) > 1 else positive
    theta = minimise(learn, unlabelled, shape, None, steps=STEPS // 2)
    f = np.sort(_value(test, theta))
    # Cuts between the test half's values, down to all of it.
    cuts = np.unique(f[np.unique(np.linspace(0, len(f) * (1 - LEAST_SHARE), 200).astype(int))]) - 1e-9
    above = unlabelled.histogram(theta, cuts)[1:][::-1].cumsum()[::-1] / unlabelled.rows
    mine = 1 - np.searchsorted(f, cuts) / len(f)
    chance = CHANCE * np.sqrt(mine * (1 - mine) / len(f))
    return float(np.clip(SHARE * (above / (mine + chance)).min(), 0.01, 0.99))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, place: Workspace, sample: int = SAMPLE) -> Model:
    """Learn from the positive labels that are not held out, and from all texts that are not."""
    free = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    features = place.write(free.select("doc_id", features_of("text").alias("x")), "features")
    trusted = labels.where(F.col("doc_id").isNotNull() & (F.col("quality") == 1) & ~held_out(F.col("doc_id"))).select("doc_id").distinct()

    def drawn(rows: DataFrame, seed: int) -> DataFrame:
        """The rows with the least hashes. Most others go first, by a bound on the hash: every task would send its own least ones."""
        place_of = F.xxhash64("doc_id", F.lit(seed))
        n = rows.count()
        if n > 4 * sample:
            near = rows.where(place_of < int(-(1 << 63) + (1 << 64) * 2.0 * sample / n))
            rows = near if near.count() >= sample else rows
        return rows.orderBy(place_of, "doc_id").limit(sample)

    # Both are samples of a fixed size, which is the bound of what is broadcast and collected.
    mine = features.join(F.broadcast(drawn(trusted, 7)), "doc_id").select("x").toPandas()
    if not len(mine):
        return Model([], np.zeros(0), 0.0, 0.5)
    edges = bin_edges(features)

    @F.pandas_udf(T.BinaryType())
    def coded(x: pd.Series) -> pd.Series:
        rows = _codes(edges, _rows(x)) - np.arange(len(edges)) * (BINS + 1)
        return pd.Series([r.tobytes() for r in rows.astype(np.uint8)], dtype=object)

    unlabelled = Unlabelled(place.write(features.select(coded("x").alias("code")), "codes"), len(edges) * (BINS + 1))
    few = drawn(features, 8).select("x").toPandas()
    # The model must not depend on the order in which rows arrive.
    p, shape = (_codes(edges, x[np.lexsort(x.T)]) for x in (_rows(mine["x"]), _rows(few["x"])))
    p = p[np.random.default_rng(0).permutation(len(p))]
    prior = estimated_prior(p, unlabelled, shape)
    theta = minimise(p, unlabelled, shape, prior)
    place.drop()
    return Model(edges, theta[:-1], float(theta[-1]), prior)


def with_scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        scores = pd.Series(held.value.score(np.array([text_features(t) for t in text], np.float32).reshape(len(text), len(FEATURES))))
        release()
        return scores

    return docs.withColumn(name, score("text"))


def keep_good(docs: DataFrame, labels: DataFrame, place: Workspace, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the classifier does not reject, with all their columns."""
    scored = with_scores(docs, fit(docs, labels, place), "__score")
    return scored.where(F.col("__score") >= threshold).select(*docs.columns)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = with_scores(docs, fit(docs, labels, Workspace(spark, "quality")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
