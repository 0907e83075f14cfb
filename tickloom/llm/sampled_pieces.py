"""Sampled SentencePiece segmentations, and lossless decoding.

Encoding draws a segmentation of each text from the lattice of its pieces:
forward filtering sums the weights of all segmentations up to every position,
backward sampling walks from the end and picks each piece in proportion to
them.  A segmentation has the probability  prod exp(score / SCALE)  over all.
Random numbers depend on the row's key, the place in the text and the step, so
the same row is segmented alike in any batch, task or attempt.

No piece of such a vocabulary crosses from a word into the space after it
(checked when it is loaded), so the lattice of a text is the chain of the
lattices of its units (spaces and the word behind them).  Each Arrow batch is handled as ragged arrays: the lattices
of its distinct units are built and filtered together, position by position,
and all units of all texts are sampled together, step by step.

A character without a piece is written by the byte pieces of its UTF-8 form, as
is a literal lower one eighth block, which otherwise stands for a space; so
decoding gives every text back exactly.

Defined results: null and empty texts have no pieces and decode to the empty
text; equal texts under one key are segmented alike; rows that repeat come
back repeated; a null key is a key as any other; extra columns pass through
:func:`encode`; long texts are cut only between units, which changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .ragged import U64, SliceHashes, batches, code_points, long_pieces, mix, release, slice_hashes

SCALE = 2000.0
SEED = 1
CHUNK = 1 << 19
SPACE_MARK = "▁"
_FILTER_BITS = 22


class Pieces:
    """The vocabulary as arrays: hashes of pieces for lookup, weights, and bytes for decoding."""

    def __init__(self, path: str, scale: float = SCALE):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = []
        self.byte_id = np.zeros(256, np.int64)
        texts, ids, weights = [], [], []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_id[b] = i
                self.bytes_of.append(bytes([b]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                text = piece.replace(SPACE_MARK, " ")
                self.bytes_of.append(text.encode())
                texts.append(text)
                ids.append(i)
                weights.append(model.get_score(i) / scale)
        if crossing := [t for t in texts if any(a != " " and b == " " for a, b in zip(t, t[1:], strict=False))]:
            raise ValueError(f"pieces that reach from a word into the space after it: {crossing[:3]}")
        self.ids, self.weights = np.array(ids), np.array(weights)
        # All beginnings of pieces, with the piece that each is (or -1).
        row = {t: i for i, t in enumerate(texts)}
        begins = sorted({t[:k] for t in texts for k in range(1, len(t) + 1)})
        ends = np.cumsum([len(t) for t in begins])
        starts = ends - [len(t) for t in begins]
        hashes = slice_hashes(code_points("".join(begins)), starts, ends)
        order = np.argsort(hashes)
        self.hashes, self.row = hashes[order], np.array([row.get(t, -1) for t in begins])[order]
        self.longest = max(map(len, texts))
        self.byte_weight = float(min(weights)) - 1.0
        # First row of each slot of the leading hash bits, and how many rows share it.
        slot = self._slot(self.hashes)
        self.first = np.full(1 << _FILTER_BITS, -1, np.int32)
        self.first[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.most = int(np.bincount(slot).max())

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are beginnings of pieces, the piece that each is or -1)."""
        at = self.first[self._slot(hashes)]
        maybe = np.flatnonzero(at >= 0)
        at, wanted = at[maybe], hashes[maybe]
        for _ in range(1, self.most):
            at = np.where(self.hashes[at] < wanted, np.minimum(at + 1, len(self.hashes) - 1), at)
        good = self.hashes[at] == wanted
        return maybe[good], self.row[at[good]]

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U64(64 - _FILTER_BITS)).astype(np.int64)


class Lattices:
    """The lattices of distinct units, filtered forward.

    Node numbers run over the units' positions; an edge ends in a node.
    """

    def __init__(self, pieces: Pieces, codes: np.ndarray, lengths: np.ndarray):
        """codes: the units' characters in a row; lengths: how many each has, longest first.

        Nodes are numbered by place, then unit, so that edges sorted by their
        end lie in the order of the forward pass.
        """
        n, longest_unit = len(codes), int(lengths[0])
        unit = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        first = (np.cumsum(lengths) - lengths).astype(np.int32)
        place = np.arange(n, dtype=np.int32) - first[unit]
        room = lengths.astype(np.int32)[unit] - place
        # Units that reach each place, and where its nodes begin.
        reach = len(lengths) - np.searchsorted(lengths[::-1], np.arange(longest_unit + 1), "left")
        offset = np.concatenate([[0], np.cumsum(reach)]).astype(np.int32)
        n_nodes = int(offset[-1])
        starts, widths, rows = [], [], []
        longest = min(pieces.longest, longest_unit)
        hashed = SliceHashes(codes)
        at = np.arange(n, dtype=np.int32)
        for size in range(1, longest + 1):
            at = at[room[at] >= size]
            hit, row = pieces.find(hashed(at, at + size))
            at = at[hit]  # longer pieces can only begin where this much of one does
            whole = row >= 0
            starts.append(at[whole])
            widths.append(np.full(int(whole.sum()), size, np.int32))
            rows.append(row[whole])
        alone = np.ones(n, bool)
        alone[starts[0]] = False
        alone = np.flatnonzero(alone).astype(np.int32)  # characters that only bytes can write
        width = 1 + (codes[alone] >= 0x80).astype(np.int64) + (codes[alone] >= 0x800) + (codes[alone] >= 0x10000)
        # Long pieces first: they are the likely ones.
        row = np.concatenate([*rows[::-1], np.full(len(alone), -1)])
        weight = np.concatenate([pieces.weights[row[: len(row) - len(alone)]], pieces.byte_weight * width])
        start = np.concatenate([*starts[::-1], alone])
        u, from_ = unit[start], place[start]
        to = from_ + np.concatenate([*widths[::-1], np.ones(len(alone), np.int32)])
        self.units, self.last = len(lengths), offset[lengths] + np.arange(len(lengths))
        tip = offset[to] + u
        order = np.argsort(tip, kind="stable")
        tip, tail, self.row, weight, self.char = tip[order], (offset[from_] + u)[order], row[order], weight[order], start[order]
        head = np.flatnonzero(np.r_[True, tip[1:] != tip[:-1]])
        forward = np.full(n_nodes, -np.inf)
        forward[: len(lengths)] = 0.0
        # Forward filtering: all nodes at one place at a time.
        cuts = np.searchsorted(tip, offset[1:])
        heads = np.searchsorted(head, cuts)
        for a, b, i, j in zip(cuts[:-1], cuts[1:], heads[:-1], heads[1:], strict=True):
            forward[tip[head[i:j]]] = np.logaddexp.reduceat(forward[tail[a:b]] + weight[a:b], head[i:j] - a)
        share = np.exp(forward[tail] + weight - forward[tip])
        # One increasing array for all nodes: node number plus the cumulative share of its edges.
        total = np.cumsum(share)
        size = np.diff(np.r_[head, len(tip)])
        before = np.repeat(total[head] - share[head], size)
        self.ladder = tip + np.minimum(total - before, 1.0)
        self.ladder[head + size - 1] = tip[head] + 1.0
        self.tail = tail
        self.head = np.zeros(n_nodes, np.int64)
        self.head[tip[head]] = head

    def pick(self, node: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The edge into each node chosen by r in [0, 1)."""
        edge, goal = self.head[node], node + r
        more = np.flatnonzero(self.ladder[edge] <= goal)
        while len(more):
            edge[more] += 1
            more = more[self.ladder[edge[more]] <= goal[more]]
        return edge


class Sampler:
    """Encodes and decodes; one for each Python worker."""

    def __init__(self, path: str, scale: float = SCALE):
        self.pieces = Pieces(path, scale)

    def encode(self, texts: list[str | None], keys: np.ndarray) -> list[np.ndarray]:
        """Piece ids of every text; keys: one 64-bit integer for each."""
        found: list[list[np.ndarray]] = [[] for _ in texts]
        used = np.zeros(len(texts), np.int64)  # units of each text so far

        def cut() -> Iterator[tuple[int, str]]:
            for row, text in enumerate(texts):
                if text:
                    yield from ((row, p) for p in long_pieces(" " + text, CHUNK))

        for held in batches(cut(), CHUNK):
            rows = np.array([r for r, _ in held])
            codes = code_points("".join(p for _, p in held))
            first = np.cumsum([0, *(len(p) for _, p in held[:-1])])
            space = codes == 0x20
            begin = np.zeros(len(codes), bool)
            begin[1:] = space[1:] & ~space[:-1]
            begin[first] = True
            starts = np.flatnonzero(begin)
            ends = np.r_[starts[1:], len(codes)]
            piece = np.searchsorted(first, starts, side="right") - 1
            per_piece = np.bincount(piece, minlength=len(held))
            number = np.arange(len(starts)) - (np.cumsum(per_piece) - per_piece)[piece]
            shift = np.zeros(len(held), np.int64)
            for i, row in enumerate(rows.tolist()):
                shift[i] = used[row]
                used[row] += per_piece[i]
            ids, owner = self._sample(codes, starts, ends, keys[rows[piece]], number + shift[piece])
            upto = np.searchsorted(owner, np.cumsum(per_piece))
            for row, part in zip(rows.tolist(), np.split(ids, upto[:-1]), strict=True):
                found[row].append(part)
        return [np.concatenate(parts) if parts else np.zeros(0, np.int32) for parts in found]

    def _sample(self, codes, starts, ends, keys, number) -> tuple[np.ndarray, np.ndarray]:
        """(ids in text order, the unit each belongs to)."""
        _, at, which = np.unique(slice_hashes(codes, starts, ends), return_index=True, return_inverse=True)
        lengths = (ends - starts)[at]
        order = np.argsort(-lengths, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at, lengths, which = at[order], lengths[order], place[which]
        index = np.repeat(starts[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        units = codes[index]
        lattice = Lattices(self.pieces, units, lengths)
        with np.errstate(over="ignore"):
            seed = mix(keys.astype(np.int64).view(np.uint64) + mix(number.astype(np.uint64) + U64(0x632BE59BD9B4E019)))
        live = np.arange(len(starts))
        node = lattice.last[which]
        edges, owners = [], []
        step = 0
        while len(live):
            with np.errstate(over="ignore"):
                r = (mix(seed[live] + U64((0x9E3779B97F4A7C15 * (step + 1)) % (1 << 64))) >> U64(11)).astype(np.float64) * 2.0**-53
            edge = lattice.pick(node[live], r)
            edges.append(edge)
            owners.append(live)
            node[live] = lattice.tail[edge]
            live = live[node[live] >= lattice.units]
            step += 1
        edge, owner = np.concatenate(edges), np.concatenate(owners)
        back = np.repeat(np.arange(step), [len(x) for x in owners])
        order = np.lexsort((-back, owner))
        edge, owner = edge[order], owner[order]
        row = lattice.row[edge]
        plain = row >= 0
        if plain.all():
            return self.pieces.ids[row].astype(np.int32), owner
        # Byte pieces: one character, as many ids as it has bytes.
        odd = np.flatnonzero(~plain)
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in units[lattice.char[edge[odd]]].tolist()]
        count = np.ones(len(edge), np.int64)
        count[odd] = [len(x) for x in raw]
        ids = np.repeat(np.where(plain, self.pieces.ids[row], 0), count)
        ids[np.repeat(~plain, count)] = self.pieces.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return ids.astype(np.int32), np.repeat(owner, count)

    def decode(self, ids: np.ndarray) -> str:
        """The text whose pieces these are, without the space put before it."""
        return b"".join(map(self.pieces.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


def row_key(column: str = "doc_id", seed: int = SEED) -> Column:
    return F.xxhash64(F.col(column), F.lit(seed))


def encode(docs: DataFrame, path: str, key: Column | None = None, scale: float = SCALE) -> DataFrame:
    """docs with ``ids`` (array of int), the sampled pieces, and ``lossless``,
    whether decoding them gave the text back.

    path: the model file, at the same place on every executor; key: the row's
    key, an integer (default: the hash of doc_id).  Columns of docs with the
    names of the two new ones, or __key, are replaced.
    """
    keyed = docs.withColumn("__key", row_key() if key is None else key)
    docs = docs.drop("ids", "lossless", "__key")
    names = docs.columns
    made = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())])
    at = names.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(path, scale)
        for part in parts:
            size = np.cumsum(pc.fill_null(pc.utf8_length(part.column(at)), 0).to_numpy())
            a = 0
            # Small slices of rows go through and out at once: memory follows CHUNK and the longest text.
            while a < len(part):
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + CHUNK, "right")))
                rows = part.slice(a, b - a)
                texts = rows.column(at).to_pylist()
                ids = sampler.encode(texts, rows.column(len(names)).to_numpy())
                lossless = [sampler.decode(i) == (t or "") for i, t in zip(ids, texts, strict=True)]
                upto = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], lists, pa.array(lossless)], names=[*names, "ids", "lossless"])
                a = b
            release()

    return keyed.select(*names, "__key").mapInArrow(run, made)


def decode(ids: Column, path: str) -> Column:
    """The text of a column of ids (null for null)."""

    @F.pandas_udf(T.StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sampler = Sampler(path)
        for part in parts:
            yield part.map(lambda x: None if x is None else sampler.decode(np.asarray(x)))

    return run(ids)


def op1_sampled_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "lossless")
