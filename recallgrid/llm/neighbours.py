"""The k most similar vectors of every vector (problem 3): randomly rotated one-bit codes.

Vectors are normalised and sent as 16-bit floats. Centroids, fitted on a bounded sample, cut the sphere into cells; groups
of cells are blocks. Within its cell a vector's difference from the centre is rotated at random and kept as one bit per
dimension, 64 to an integer, with two correction scalars. A query's inner products are estimated from the packed bits alone:
first by counting the bits in which its own code differs, against the number that the angle it needs allows, then by counting
bits in the planes of the quantised query, with the scalars and a bound of the error. Only what reaches the query's k-th best
so far (or the least similarity asked for) is reranked by exact inner products.

A query goes only to the blocks that hold one of its ``probes`` nearest cells, with the list of these; where a least
similarity is asked for, cells that such neighbours hardly reach are left out. A block with many
vectors or many queries is divided into parts and slices by a hash, and each part meets each slice, so all of its vectors are
still compared. Of equal vectors (after the rounding to 16 bits) no more than k + 1, those with the smallest ids, can be
anybody's neighbours; the others are left out of the index before the shuffle, and stay queries where queries are given.

Defined results: of rows with one id the latest counts; a null, short, zero or not finite vector, or one of another model,
has no row; equal similarities go by the smaller id; the same id is never its own neighbour; further columns are ignored.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, FloatType, IntegerType, StringType, StructField, StructType, TimestampNTZType

DIMENSIONS = 64
#: Rows that the centroids are fitted on, chosen by a hash (a tenth more at most); rows of a cell; rows of a block.
SAMPLE, CELL_ROWS, BLOCK_ROWS = 40_000, 600, 80_000
#: Rows of a block at least, where a small table is to use all cores.
LEAST_BLOCK = 10_000
#: Vectors of the sample on which the number of cells to look into is tried.
TRIED = 2000
#: The most finer cells of a coarse one: with 5,000 coarse cells enough for three thousand million vectors, from where cells grow.
MOST_FINE = 1024
#: Vectors and queries of a task, about.
PART_ROWS, SLICE_ROWS = 120_000, 250_000
#: Standard deviations that a neighbour of the least similarity asked for may lie towards another cell; more where finer cells, which have more others beside them, are used.
BESIDE, BESIDE_FINE = 1.5, 2.0
#: Bits of an entry of a query; standard errors that the bound of the estimate allows for; standard deviations that counts of differing bits may be off.
LEVEL_BITS, ERRORS, FAR = 4, 2.5, 2.8
#: Rows that go through the centroids at once, and the most entries of a matrix of counts.
PANEL, ESTIMATES = 16_384, 400_000
SEED = 20240607
_HIT = StructType([StructField("a", StringType()), StructField("b", StringType()), StructField("similarity", FloatType())])


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, unit: bool = True) -> np.ndarray:
    """k-means: spherical for unit vectors, else by Euclidean distance."""
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        away = 0 if unit else (c * c).sum(1) / 2
        near = np.concatenate([(x[i : i + PANEL] @ c.T - away).argmax(1) for i in range(0, len(x), PANEL)])
        order = np.argsort(near, kind="stable")
        count = np.bincount(near, minlength=k)
        at, present = np.cumsum(count) - count, count > 0
        sums = np.zeros_like(c)
        sums[present] = np.add.reduceat(x[order], at[present], axis=0)
        size = np.linalg.norm(sums, axis=1, keepdims=True) if unit else count[:, None]
        c = np.where(size > 1e-6, sums / np.maximum(size, 1e-6), c).astype(np.float32)
    return c


class Cells:
    """The cells of the sphere: coarse centroids, and around each of them the same finer ones; cell i has centre coarse[i // f] + fine[i % f]."""

    def __init__(self, coarse: np.ndarray, fine: np.ndarray):
        self.coarse, self.fine = coarse, fine
        self.bias = ((fine * fine).sum(1) + 2 * coarse @ fine.T) / 2

    def __len__(self) -> int:
        return len(self.coarse) * len(self.fine)

    def centre(self, cell: int) -> np.ndarray:
        return self.coarse[cell // len(self.fine)] + self.fine[cell % len(self.fine)]

    def nearest(self, x: np.ndarray, probes: int, least: float = -2.0) -> np.ndarray:
        """The ``probes`` nearest cells of each row, the nearest first; where cells are finer, the square root of the refinement as many more.

        A vector of similarity ``least`` lies off the row in some direction; how far along the line from the nearest centre to
        another has a standard deviation of sqrt(1 - least^2) |line| / sqrt(dimensions - 1). Cells nearer than the nearest only
        beyond ``BESIDE`` of these are left out, as -1.
        """
        f = len(self.fine)
        to = x @ self.coarse.T
        p = min(len(self.coarse), probes if f == 1 else probes + 4)
        near = np.argpartition(-to, p - 1, axis=1)[:, :p] if p < len(self.coarse) else np.tile(np.arange(p), (len(x), 1))
        score = np.take_along_axis(to, near, 1)
        if f > 1:
            score = (score[:, :, None] + (x @ self.fine.T)[:, None, :] - self.bias[near]).reshape(len(x), -1)
            near = (near[:, :, None] * f + np.arange(f)).reshape(len(x), -1)
            p = min(near.shape[1], int(np.ceil(probes * np.sqrt(f))))
            if p < near.shape[1]:
                best = np.argpartition(-score, p - 1, axis=1)[:, :p]
                near, score = np.take_along_axis(near, best, 1), np.take_along_axis(score, best, 1)
        order = np.argsort(-score, axis=1, kind="stable")
        near, score = np.take_along_axis(near, order, 1), np.take_along_axis(score, order, 1)
        if least > 0 and near.shape[1] > 1:
            line = self.coarse[near // f] + self.fine[near % f]
            line = np.linalg.norm(line - line[:, :1], axis=2)
            near = np.where(least * (score[:, :1] - score) <= (BESIDE if f == 1 else BESIDE_FINE) * np.sqrt(max(1 - least**2, 0) / (x.shape[1] - 1)) * line, near, -1)
        return near


class Codes:
    """One cell's vectors as one-bit codes of their rotated differences from the centre, each packed into 64 bits, with correction scalars."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        rest = (x - centre) @ turn
        norm = np.linalg.norm(rest, axis=1)
        self.least, self.most = float(norm.min()), float(norm.max())
        self.code = packed(rest > 0)
        self.ones = np.bitwise_count(self.code).astype(np.float32)
        d = x.shape[1]
        share = np.maximum(np.abs(rest).sum(1) / np.maximum(norm, 1e-12) / np.sqrt(d), 1e-6)  # inner product of the unit difference with its own code
        self.scale = (norm / share / np.sqrt(d)).astype(np.float32)
        self.error = (ERRORS * norm * np.sqrt(np.maximum(1 - share**2, 0)) / share / np.sqrt(d - 1) + 1e-3).astype(np.float32)


def packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def most_bits() -> np.ndarray:
    """By the cosine needed, -1 to 1 in steps of 1/500: how many of the 64 bits may differ, ``FAR`` standard deviations above the mean at that angle."""
    share = np.arccos(np.linspace(-1, 1, 1001)) / np.pi
    return np.floor(DIMENSIONS * share + FAR * np.sqrt(DIMENSIONS * share * (1 - share)) + 0.5).clip(0, DIMENSIONS).astype(np.uint8)


class Queries:
    """Rotated queries, quantised to ``LEVEL_BITS`` bits an entry; each bit of all entries is one 64-bit plane."""

    def __init__(self, q: np.ndarray, turn: np.ndarray):
        self.q, self.turned = q, q @ turn
        self.low = self.turned.min(1)
        self.step = np.maximum(self.turned.max(1) - self.low, 1e-9) / (2**LEVEL_BITS - 1)
        level = np.rint((self.turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [packed(level & (1 << b)) for b in range(LEVEL_BITS)]
        self.total = self.turned.sum(1)

    def upper_bounds(self, i: np.ndarray, codes: Codes, j: np.ndarray, to_centre: np.ndarray) -> np.ndarray:
        """Of the inner products of queries ``i`` with vectors ``j`` of a cell: <x, q> = <centre, q> + <x - centre, q>, the last from the bits alone."""
        code = codes.code[j]
        counted = np.bitwise_count(code & self.planes[0][i]).astype(np.uint16)
        for b in range(1, LEVEL_BITS):
            counted += np.bitwise_count(code & self.planes[b][i]).astype(np.uint16) << b
        signed = 2 * (self.step[i] * counted + self.low[i] * codes.ones[j]) - self.total[i]
        return to_centre + codes.scale[j] * signed + codes.error[j]


def _true_at(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a sparse matrix whose rows are multiples of 8 long, eight entries at a time."""
    words = np.flatnonzero(mask.view(np.uint64))
    at = np.flatnonzero(mask.reshape(-1, 8)[words])
    flat = words[at >> 3] * 8 + (at & 7)
    i = flat // mask.shape[1]
    return i, flat - i * mask.shape[1]


def search(x: np.ndarray, homes: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, asked: np.ndarray, wanted: np.ndarray, cells: Cells, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, similarity) of up to ``k`` neighbours of each query among the ``x`` whose cell it wants.

    ``ids`` and ``qids`` are ranks of ids in one order, for ties and to leave out a vector's own row. ``asked`` and ``wanted``
    are queries and cells side by side, each query's nearest cell first. For every query and cell, the queries' own one-bit code
    is compared with all codes by counting the bits that differ; what is near enough for the query's k-th best so far gets an
    estimate from the bit planes with its error bound; what that leaves is reranked exactly.
    """
    turn, table = rotation(x.shape[1]), most_bits()
    order = np.argsort(homes, kind="stable")
    x, homes, ids = x[order], homes[order], ids[order]
    starts = {int(c): (int(s), int(s + n)) for c, s, n in zip(*np.unique(homes, return_index=True, return_counts=True))}
    queries = Queries(q, turn)
    best_s = np.full((len(q), k), least, dtype=np.float32)
    best_x = np.full((len(q), k), -1, dtype=np.int64)
    there = np.isin(wanted, np.fromiter(starts, dtype=wanted.dtype, count=len(starts)))
    asked, wanted = asked[there], wanted[there]
    place = np.arange(len(asked)) - np.searchsorted(asked, asked)
    codes: dict[int, Codes] = {}
    low = 0
    while (place >= low).any():
        high = max(1, 2 * low)
        now = np.flatnonzero((place >= low) & (place < high))
        now = now[np.argsort(wanted[now], kind="stable")]
        here, first = np.unique(wanted[now], return_index=True)
        new_q, new_x, new_s = [], [], []
        for c, members in zip(here.tolist(), np.split(asked[now], first[1:])):
            s, e = starts[c]
            centre = cells.centre(c)
            if c not in codes:
                codes[c] = Codes(x[s:e], centre, turn)
            own, mid, size = codes[c], centre @ turn, float(centre @ centre)
            to = q[members] @ centre
            # A vector at distance r from the centre needs the cosine (a + r^2 / 2) / (r b) between both differences; least over the cell's r.
            a = best_s[members, -1] - to - (1 - size) / 2
            b = np.sqrt(np.maximum(1 + size - 2 * to, 1e-9))
            r = np.clip(np.sqrt(np.maximum(2 * a, 0)), max(own.least, 1e-6), max(own.most, 1e-6))
            need = (a + r * r / 2) / (r * b) - 0.01
            can = need <= 1
            members, to, need = members[can], to[can], need[can]
            n = -(-(e - s) // 8) * 8
            code = np.zeros(n, np.uint64)
            code[: e - s] = own.code
            step = max(1, ESTIMATES // n)
            for at in range(0, len(members), step):
                m = members[at : at + step]
                bits = table[((np.clip(need[at : at + step], -1, 1) + 1) * 500).astype(np.int64)]
                differ = np.bitwise_count(packed(queries.turned[m] > mid)[:, None] ^ code)
                near = differ <= bits[:, None]
                near[:, e - s :] = False
                i, j = _true_at(near)
                if not len(i):
                    continue
                if len(i) * 32 > near.size:  # most pass: one product of matrices is the quicker rerank
                    exact = (q[m] @ x[s:e].T)[i, j]
                else:
                    good = queries.upper_bounds(m[i], own, j, to[at : at + step][i]) >= best_s[m[i], -1]
                    i, j = i[good], j[good]
                    exact = np.einsum("ij,ij->i", q[m[i]], x[s + j])
                good = (exact >= best_s[m[i], -1]) & (qids[m[i]] != ids[s + j])
                i, j, exact = i[good], j[good], exact[good]
                if len(i) > 4 * k * len(m):  # no more than k of a query's can stay
                    top = np.lexsort((ids[s + j], -exact, i))
                    top = top[np.arange(len(top)) - np.searchsorted(i[top], i[top]) < k]
                    i, j, exact = i[top], j[top], exact[top]
                new_q.append(m[i])
                new_x.append(s + j)
                new_s.append(exact)
        if new_q:
            _merge(best_x, best_s, np.concatenate(new_q), np.concatenate(new_x), np.concatenate(new_s), ids, k)
        low = high
    i, j = np.nonzero(best_x >= 0)
    return i, order[best_x[i, j]], best_s[i, j]


def _merge(best_x, best_s, new_q, new_x, new_s, ids, k) -> None:
    """Puts new neighbours into the queries' lists of the best, in place."""
    touched = np.unique(new_q)
    old_i, old_j = np.nonzero(best_x[touched] >= 0)
    q = np.concatenate([touched[old_i], new_q])
    v = np.concatenate([best_x[touched[old_i], old_j], new_x])
    s = np.concatenate([best_s[touched[old_i], old_j], new_s])
    order = np.lexsort((ids[v], -s, q))
    q, v, s = q[order], v[order], s[order]
    first = np.searchsorted(q, q, side="left")
    place = np.arange(len(q)) - first
    keep = place < k
    floor = best_s[touched, -1]
    counts = np.bincount(q[keep], minlength=len(best_s))[touched]
    best_x[touched], best_s[touched] = -1, np.where(counts < k, floor, -np.inf)[:, None]
    best_x[q[keep], place[keep]], best_s[q[keep], place[keep]] = v[keep], s[keep]


def usable(vectors: DataFrame, model: str, key: str = "memory_id", embedding: str = "embedding", created: str = "created_at", of_model: str = "model") -> DataFrame:
    """Rows ``(id, vec)``: each id's latest row, if usable, as normalised 16-bit floats.

    The vectors shrink before they are shuffled by id. Of rows of one moment the one of the largest bytes counts.
    """
    source = vectors.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(created).cast("timestamp_ntz").alias("at"), F.when((F.col(of_model) == model) & (F.size(embedding) == DIMENSIONS), F.col(embedding)).alias("v"))

    def pack(batches):
        for b in batches:
            v = b.column(2)
            out: list[bytes | None] = [None] * b.num_rows
            at = np.flatnonzero(~np.asarray(v.is_null()))
            if len(at):
                x = v.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIMENSIONS)
                with np.errstate(all="ignore"):
                    top = np.abs(x).max(1)
                    good = np.isfinite(top) & (top > 0)  # max gives NaN where one is
                    x = x / np.where(good, top, 1)[:, None]
                    x = np.where(good[:, None], x / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None], 0).astype("<f2")
                for i, row, ok in zip(at.tolist(), x, good.tolist()):
                    if ok:
                        out[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["id", "at", "vec"])

    packed = source.mapInArrow(pack, StructType([StructField("id", StringType()), StructField("at", TimestampNTZType()), StructField("vec", BinaryType())]))
    latest = packed.groupBy("id").agg(F.max(F.struct("at", "vec")).alias("m"))
    return latest.select("id", F.col("m.vec").alias("vec")).where("vec is not null")


class Index:
    """Cells and blocks, fitted on at most ``SAMPLE`` vectors (a tenth more at most); every vector is indexed.

    Cells go up with the number of vectors: coarse centroids as far as the sample carries them, then ever finer ones around
    each, fitted on the sample's differences from their centroid. Blocks, the units of a task, are groups of near cells. The
    sample tells how many vectors and queries a block gets; a block is cut into parts by vectors and slices by queries, and each
    part meets each slice, so a task's size doesn't depend on the number of vectors. A wrong guess changes sizes, not results.
    """

    def __init__(self, vectors: DataFrame, model: str, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS):
        n = max(vectors.count(), 1)
        rows = vectors.where((F.col("model") == model) & (F.size("embedding") == DIMENSIONS))
        wanted = F.pmod(F.xxhash64("memory_id", "created_at"), F.lit(n)) < SAMPLE
        sample = rows.where(wanted).select("embedding").limit(SAMPLE + SAMPLE // 10).toArrow()
        x = sample.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, DIMENSIONS)
        x = x[np.isfinite(x).all(1)]
        norm = np.linalg.norm(x, axis=1)
        x = x[(norm > 0) & np.isfinite(norm)]
        x /= np.linalg.norm(x, axis=1)[:, None]
        x = np.unique(x, axis=0)
        if not len(x):
            x = np.eye(1, DIMENSIONS, dtype=np.float32)
        coarse = fit_centroids(x, int(min(max(1, n // cell_rows), max(1, len(x) // 8))))
        refine = int(min(max(1, round(n / cell_rows / len(coarse))), MOST_FINE, len(x) // 8 + 1))
        fine = np.zeros((1, DIMENSIONS), np.float32)
        if refine > 1:
            home = np.concatenate([(x[i : i + PANEL] @ coarse.T).argmax(1) for i in range(0, len(x), PANEL)])
            fine = fit_centroids(x - coarse[home], refine, unit=False)
        self.cells, self.sample, self.rows = Cells(coarse, fine), x, n
        home = np.concatenate([self.cells.nearest(x[i : i + PANEL], 1)[:, 0] for i in range(0, len(x), PANEL)])
        self.share = np.bincount(home, minlength=len(self.cells)) / len(x)
        cores = vectors.sparkSession.sparkContext.defaultParallelism
        blocks = max(1, round(n / block_rows), min(2 * cores, n // LEAST_BLOCK))
        self.block_of = self._blocks(int(min(blocks, len(self.cells))))

    def _blocks(self, blocks: int) -> np.ndarray:
        """Cells to blocks of near cells: k-means of the sample again; what is too full is halved along its direction of largest spread.

        A single coarse cell that is still too full is divided among its finer cells.
        """
        f, c = len(self.cells.fine), self.cells.coarse
        load = self.share.reshape(-1, f).sum(1) + 1e-9
        full = load.sum() / blocks
        near = (c @ fit_centroids(self.sample, min(blocks, len(self.sample)), rounds=12).T).argmax(1)
        groups = [(load[near == g].sum(), np.flatnonzero(near == g)) for g in np.unique(near)]
        done: list[np.ndarray] = []
        while groups:
            weight, g = groups.pop()
            if len(g) == 1 or weight <= 2 * full:
                done.append(g)
                continue
            away = c[g] - c[g].mean(0)
            axis = np.linalg.svd(away, full_matrices=False)[2][0]
            g = g[np.argsort(away @ axis, kind="stable")]
            half = int(np.clip(np.searchsorted(np.cumsum(load[g]), load[g].sum() / 2), 1, len(g) - 1))
            groups += [(load[h].sum(), h) for h in (g[:half], g[half:])]
        out = np.zeros((len(c), f), dtype=np.int32)
        axis = np.linalg.svd(self.cells.fine, full_matrices=False)[2][0] if f > 1 else None
        n = 0
        for g in done:
            pieces = int(np.clip(round(load[g].sum() / full), 1, f)) if len(g) == 1 else 1
            if pieces == 1:
                out[g] = n
            else:
                out[g[0], np.argsort(self.cells.fine @ axis, kind="stable")] = n + np.arange(f) * pieces // f
            n += pieces
        return out.reshape(-1)

    def probes_for(self, k: int, recall: float) -> int:
        """Cells to look into so that ``recall`` of the ``k`` nearest are in them, tried on the sample: every ``TRIED``-th of it against all of it.

        Neighbours in the sample are farther away than those in all vectors, so the recall of all is rather higher. The number
        follows the cells, however many there are.
        """
        q = self.sample[:: max(1, len(self.sample) // TRIED)]
        near = np.empty((len(q), min(k + 1, len(self.sample))), dtype=np.int64)
        for i in range(0, len(q), 256):
            near[i : i + 256] = np.argpartition(-(q[i : i + 256] @ self.sample.T), near.shape[1] - 1, axis=1)[:, : near.shape[1]]
        homes = np.concatenate([self.cells.nearest(self.sample[i : i + PANEL], 1)[:, 0] for i in range(0, len(self.sample), PANEL)])
        own = near == (np.arange(len(q)) * max(1, len(self.sample) // TRIED))[:, None]
        probes = 8
        while probes < len(self.cells.coarse):
            looked = self.cells.nearest(q, probes)
            found = (homes[near][:, :, None] == looked[:, None, :]).any(2)
            if found[~own].mean() >= recall:
                break
            probes = probes * 5 // 4 + 1
        return min(probes, len(self.cells.coarse))

    def layout(self, probes: int, part_rows: int, slice_rows: int, asked: float, least: float = -2.0) -> tuple[np.ndarray, np.ndarray]:
        """Parts and slices of each block; ``asked`` is the share of the vectors that are queries."""
        blocks = int(self.block_of.max()) + 1
        rows = np.bincount(self.block_of, weights=self.share, minlength=blocks) * self.rows
        reached = np.zeros(blocks)
        for i in range(0, len(self.sample), PANEL):
            near = self.cells.nearest(self.sample[i : i + PANEL], probes, least)
            near = np.where(near < 0, blocks, self.block_of[near])
            near.sort(axis=1)
            fresh = np.concatenate([np.ones((len(near), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
            reached += np.bincount(near[fresh], minlength=blocks + 1)[:blocks]
        queries = reached / len(self.sample) * self.rows * asked
        return np.maximum(1, np.ceil(rows / part_rows)).astype(int), np.maximum(1, np.ceil(queries / slice_rows)).astype(int)


def _limited(x: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the k + 1 with the smallest ids; Spark cuts most of the others before the shuffle."""
    rank = F.row_number().over(W.partitionBy("vec").orderBy("id"))
    return x.withColumn("_rank", rank).where(F.col("_rank") <= k + 1).drop("_rank")


def _repeat(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, times[i] entries: i, and their numbers from 0."""
    at = np.repeat(np.arange(len(times)), times)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)


_ROUTED = StructType([StructField("id", StringType()), StructField("vec", BinaryType()), StructField("task", IntegerType()), StructField("home", IntegerType()), StructField("cells", BinaryType())])


def neighbours(index: Index, base: DataFrame, queries: DataFrame | None, k: int, probes: int, least: float = -2.0, asked: float = 1.0) -> DataFrame:
    """Rows ``(a, b, similarity)``: the ``k`` nearest ``b`` of every query ``a``, of similarity ``least`` or more.

    ``base`` and ``queries`` have ``(id, vec)``; ``asked`` is about the share of the base's number that the queries have. Without
    ``queries`` the rows that are left of ``base`` after its equal vectors are limited are the queries: all of them that can be
    in a mutual pair, so ``mutual`` of it is whole; a caller who wants every row's own list gives ``queries``.
    """
    cells, block_of, both = index.cells, index.block_of, queries is None
    parts, slices = index.layout(probes, PART_ROWS, SLICE_ROWS, asked, least)
    first = np.concatenate([[0], np.cumsum(parts * slices)]).astype(np.int64)

    def route(as_base: bool, as_query: bool):
        def run(batches):
            for b in batches:
                n = b.num_rows
                x = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype="<f2").reshape(-1, DIMENSIONS).astype(np.float32)
                near = cells.nearest(x, probes if as_query else 1, least).astype(np.int32)
                salt = np.fromiter((crc32(i.encode()) for i in b.column(0).to_pylist()), dtype=np.int64, count=n)
                at, task, home = [], [], []
                wanted: list[bytes | None] = []
                hb = block_of[near[:, 0]]
                if as_query:
                    blocks = np.where(near < 0, len(parts), block_of[near])
                    order = np.argsort(blocks, axis=1, kind="stable")
                    sorted_blocks, sorted_cells = np.take_along_axis(blocks, order, 1), np.take_along_axis(near, order, 1)
                    opens = np.concatenate([np.ones((n, 1), bool), sorted_blocks[:, 1:] != sorted_blocks[:, :-1]], axis=1)
                    starts = np.flatnonzero(opens)
                    lengths = np.diff(np.append(starts, opens.size))
                    used = sorted_blocks.ravel()[starts] < len(parts)
                    starts, lengths = starts[used], lengths[used]
                    who, block = starts // near.shape[1], sorted_blocks.ravel()[starts]
                    flat = sorted_cells.ravel().tobytes()
                    lists = [flat[4 * s : 4 * (s + m)] for s, m in zip(starts.tolist(), lengths.tolist())]
                    i, part = _repeat(parts[block])
                    own = (salt[who[i]] >> 8) % slices[block[i]]
                    at.append(who[i]), task.append(first[block[i]] + part * slices[block[i]] + own)
                    mine = as_base & (block[i] == hb[who[i]]) & (part == salt[who[i]] % parts[block[i]])  # the row of the base, too
                    home.append(np.where(mine, near[who[i], 0], -1))
                    wanted += [lists[j] for j in i.tolist()]
                if as_base:
                    i, piece = _repeat(slices[hb])
                    if as_query:
                        other = piece != (salt[i] >> 8) % slices[hb[i]]
                        i, piece = i[other], piece[other]
                    at.append(i), task.append(first[hb[i]] + salt[i] % parts[hb[i]] * slices[hb[i]] + piece), home.append(near[i, 0])
                    wanted += [None] * len(i)
                take = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate(task).astype(np.int32)), pa.array(np.concatenate(home).astype(np.int32)), pa.array(wanted, pa.binary())],
                    names=["id", "vec", "task", "home", "cells"],
                )

        return run

    base = _limited(base, k)
    rows = base.mapInArrow(route(True, both), _ROUTED)
    if not both:
        rows = rows.unionByName(queries.mapInArrow(route(False, True), _ROUTED))

    def within(batches):
        """One task's vectors and queries: at most about a part and a slice."""
        table = pa.Table.from_batches(list(batches), schema=to_arrow_schema(_ROUTED))
        ids = table.column("id").combine_chunks().dictionary_encode()
        names = ids.dictionary
        order = np.empty(len(names), dtype=np.int64)
        order[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))
        rank = order[ids.indices.to_numpy()] if len(names) else np.zeros(0, np.int64)
        home = table.column("home").to_numpy()
        lists = table.column("cells").combine_chunks()
        b, q = np.flatnonzero(home >= 0), np.flatnonzero(~np.asarray(lists.is_null()))
        if not len(b) or not len(q):
            return
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), dtype="<f2").reshape(-1, DIMENSIONS).astype(np.float32)
        lengths = pc.binary_length(lists.drop_null()).to_numpy() // 4
        wanted = np.frombuffer(b"".join(lists.drop_null().to_pylist()), dtype=np.int32)
        i, j, s = search(x[b], home[b], rank[b], x[q], rank[q], np.repeat(np.arange(len(q)), lengths), wanted, cells, k, least)
        ids = table.column("id").combine_chunks()
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[i])), ids.take(pa.array(b[j])), pa.array(s, pa.float32())], names=["a", "b", "similarity"])

    hits = rows.repartitionById(int(first[-1]), F.col("task")).mapInArrow(within, _HIT)
    best = F.row_number().over(W.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    return hits.withColumn("_rank", best).where(F.col("_rank") <= k).drop("_rank")


def mutual(pairs: DataFrame) -> DataFrame:
    """Rows ``(a, b, similarity)`` with a < b where each is among the other's neighbours."""
    way = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    return way.groupBy("a", "b").agg(F.count("*").alias("_n"), F.min("similarity").alias("similarity")).where("_n = 2").drop("_n")


def twentieth(key: Column) -> Column:
    """The stated query set of ids that aren't numbers: every id whose CRC-32 is divisible by 20."""
    return F.crc32(key) % 20 == 0
