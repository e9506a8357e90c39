"""The most similar vectors of every vector (problem 3).

Vectors are ordered several times: where a cosine is asked from a floor on, by the largest of randomly rotated axes, digit after digit
(cross-polytope hashing); else along Hilbert curves through projections to few dimensions. The orderings (curves) are cut into ranges;
within a range every vector meets the next ones along the curve, and the best of all curves are merged and ranked again on the exact
vectors. Windows follow the number of vectors, so a pair's chance to be met doesn't fall with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.arrays import attach, binary_column
from corpusloom.session import written

#: Vectors of the sample that fits the cuts of the ranges (the only thing that is fitted; every vector is ordered).
SAMPLE = 20_000
#: Neighbours from a floor on that a vector keeps of each range.
LEAST_KEPT = 32
#: With a floor windows hold at least this part of all vectors: about two digits of an ordering, however many vectors there are.
WINDOW_PART = 4096


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of the points x (n x d integers below 2**bits), d * bits at most 62.

    The axes are brought into the curve's transposed form bit by bit, from the highest: a set bit reflects the lower bits of the
    first axis, an unset one exchanges them with this axis; a Gray code then links the axes.
    """
    n, d = x.shape
    axes = [x[:, i].astype(np.int64) for i in range(d)]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(d):
            on = (axes[i] >> level) & 1 == 1
            swap = np.where(on, 0, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(on, low, swap)
            if i:
                axes[i] ^= swap
    for i in range(1, d):
        axes[i] ^= axes[i - 1]
    carried = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        carried ^= np.where((axes[d - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | (((axes[i] ^ carried) >> level) & 1)
    return key


class Curves:
    """`count` Hilbert orderings of unit vectors of length `dim`: each takes `axes` random orthogonal directions and a shift."""

    def __init__(self, dim: int, count: int, axes: int, bits: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bits, self.count = bits, count
        self.directions = [np.linalg.qr(rng.standard_normal((dim, axes)))[0].astype(np.float32) for _ in range(count)]
        self.shifts = rng.random((count, axes)).astype(np.float32)
        self.spread = np.float32(1 / np.sqrt(dim))

    def keys(self, unit: np.ndarray, k: int) -> np.ndarray:
        # Projections of unit vectors have this spread about 0; four of them on either side and a shift fill the cube.
        p = unit @ self.directions[k] / (8 * self.spread) + 0.5
        cells = np.clip((p + self.shifts[k] * 0.25) / 1.25, 0, 1 - 1e-6) * (1 << self.bits)
        return hilbert_keys(cells.astype(np.int64), self.bits)


class Polytopes:
    """`count` orderings of unit vectors of length `dim` by digits: each digit is the largest of some 32 randomly rotated axes, with its
    sign. Vectors of a high cosine share their first digits far more often than others do, in any number of dimensions."""

    def __init__(self, dim: int, count: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.count = count
        parts = np.array_split(np.arange(dim), max(1, round(dim / 32)))
        self.bits = int(2 * max(map(len, parts)) - 1).bit_length()
        digits = 36 // self.bits
        turns = -(-digits // len(parts))
        self.axes = [[[q[:, p] for p in parts] for q in (np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.float32) for _ in range(turns))] for _ in range(count)]
        self.axes = [[a for turn in own for a in turn][:digits] for own in self.axes]

    def keys(self, unit: np.ndarray, k: int) -> np.ndarray:
        key, rows = np.zeros(len(unit), np.int64), np.arange(len(unit))
        for axes in self.axes[k]:
            p = unit @ axes
            at = np.abs(p).argmax(axis=1)
            key = key << self.bits | 2 * at | (p[rows, at] < 0)
        return key


def unit_rows(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and normalised vectors of the usable rows: right length, no null or non-finite item, norm not zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)))
    flat = np.asarray(column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(at), dim)
    norm = np.sqrt((flat * flat).sum(axis=1))
    good = np.isfinite(norm) & (norm > 1e-12)
    return at[good], flat[good] / norm[good][:, None]


def coded(unit: np.ndarray) -> np.ndarray:
    """Vectors as bytes, each scaled by its largest item."""
    return np.rint(unit * (127 / np.abs(unit).max(axis=1))[:, None]).astype(np.int8)


def _ordering(curves: Curves | Polytopes, cuts: list[np.ndarray], dim: int, overlap: int, both_sides: bool):
    """(vec_id, v) -> for each range of each curve the rows that belong there, packed. A row in the first cell of a range also
    goes to the range before, so that windows cross the border; there it is only met, it meets nobody (flag 1). Where windows reach
    back too, rows of a last cell go to the range after in the same way."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            at, unit = unit_rows(batch.column(1), dim)
            ids = np.asarray(batch.column(0))[at].astype(np.int64)
            _, first = np.unique(ids, return_index=True)
            first = np.array([i for i in first.tolist() if int(ids[i]) not in seen], np.int64)
            if len(seen) < 1_000_000:  # copies leave a task once; later they meet by their id anyway
                seen.update(ids[first].tolist())
            at, unit, ids = at[first], unit[first], ids[first]
            if not len(at):
                continue
            code = coded(unit)
            unit = unit.astype(np.float32)
            regions, blobs = [], []
            for k in range(curves.count):
                key = curves.keys(unit, k)
                cell = np.searchsorted(cuts[k], key, side="right")
                home = cell // overlap
                again = np.flatnonzero((cell % overlap == 0) & (home > 0))
                after = np.flatnonzero(cell % overlap == overlap - 1) if both_sides else again[:0]
                rows = np.concatenate([np.arange(len(at)), again, after])
                where = np.concatenate([home, home[again] - 1, home[after] + 1])
                packed = np.empty((len(rows), 17 + dim), np.uint8)
                packed[:, :8] = key[rows].view(np.uint8).reshape(-1, 8)
                packed[:, 8:16] = ids[rows].view(np.uint8).reshape(-1, 8)
                packed[:, 16] = np.arange(len(rows)) >= len(at)
                packed[:, 17:] = code[rows].view(np.uint8)
                order = np.argsort(where, kind="stable")
                for block in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
                    regions.append(k << 40 | int(where[block[0]]))
                    blobs.append(packed[block].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(regions, pa.int64()), pa.array(blobs, pa.binary())], ["region", "rows"])

    return run


def _best_of(x: np.ndarray, value: np.ndarray, most: int) -> np.ndarray:
    """Which of the pairs (x, .) are among the `most` of largest value of their x."""
    if not len(x) or np.bincount(x).max() <= most:
        return np.ones(len(x), bool)
    order = np.lexsort((-value, x))
    own = x[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    good = np.empty(len(x), bool)
    good[order] = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x)))) < most
    return good


def _meeting(dim: int, window: int, k: int, floor: float | None):
    """A range of a curve -> its pairs (a < b): for each vector the k best it met in its window; with a floor the best LEAST_KEPT or k
    from there on, as only those can matter."""

    def run(key, table):
        rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), np.uint8).reshape(-1, 17 + dim)
        keys, ids = (np.ascontiguousarray(rows[:, s : s + 8]).view(np.int64).ravel() for s in (0, 8))
        order = np.lexsort((ids, keys))
        order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
        ids, own = ids[order], rows[order, 16] == 0
        v = rows[order, 17:].view(np.int8).astype(np.float32)
        v /= np.linalg.norm(v, axis=1)[:, None]
        step, out = min(512, window), []
        n = len(ids)
        for low in range(0, n, step):
            high, end = min(n, low + step), min(n, low + step + window)
            s = v[low:high] @ v[low:end].T
            if floor is not None:
                # Few reach the floor, so all else is asked of those alone. Of a dense cluster only the nearest of each vector, on
                # either side, can matter.
                x, y = np.divmod(np.flatnonzero(s.ravel() >= floor), s.shape[1])
                good = (y > x) & (y - x <= window) & own[low + x]
                x, y = x[good], y[good]
                good = _best_of(x, s[x, y], max(k, LEAST_KEPT)) | _best_of(y, s[x, y], max(k, LEAST_KEPT))
                x, y = x[good], y[good]
            else:
                i, j = np.arange(low, high)[:, None], np.arange(low, end)[None, :]
                s[(j <= i) | (j - i > window) | ~own[low:high, None]] = -2
                best = min(k, s.shape[1])
                y = np.argpartition(-s, best - 1, axis=1)[:, :best].ravel()
                x = np.repeat(np.arange(high - low), best)
                good = s[x, y] > -2
                x, y = x[good], y[good]
                t = np.argpartition(-s, min(k, s.shape[0]) - 1, axis=0)[: min(k, s.shape[0])]
                x2, y2 = t.ravel(), np.tile(np.arange(s.shape[1]), t.shape[0])
                good = s[x2, y2] > -2
                x, y = np.concatenate([x, x2[good]]), np.concatenate([y, y2[good]])
            if len(x):
                a, b = ids[low + x], ids[low + y]
                pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b]
                out.append(np.unique(pairs, axis=0))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return run


def _asking(dim: int, window: int, k: int, floor: float | None, every: int):
    """As _meeting, for the vectors whose identity is divisible by `every` only: each meets the window on both sides."""

    def run(key, table):
        rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), np.uint8).reshape(-1, 17 + dim)
        keys, ids = (np.ascontiguousarray(rows[:, s : s + 8]).view(np.int64).ravel() for s in (0, 8))
        order = np.lexsort((rows[:, 16], ids, keys))
        order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
        ids = ids[order]
        asked = np.flatnonzero((rows[order, 16] == 0) & (ids % every == 0))
        v = rows[order, 17:].view(np.int8).astype(np.float32)
        v /= np.linalg.norm(v, axis=1)[:, None]
        out = []
        for at in range(0, len(asked), 32):
            mine = asked[at : at + 32]
            low, high = max(0, mine[0] - window), min(len(ids), mine[-1] + window + 1)
            s = v[mine] @ v[low:high].T
            away = np.abs(np.arange(low, high)[None, :] - mine[:, None])
            s[(away == 0) | (away > window)] = -2
            if floor is not None:
                s[s < floor] = -2
            best = min(k, s.shape[1])
            y = np.argpartition(-s, best - 1, axis=1)[:, :best]
            good = np.take_along_axis(s, y, axis=1) > -2
            a = np.repeat(ids[mine], best)[good.ravel()]
            b = ids[low + y.ravel()[good.ravel()]]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b])
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return run


def _cosines():
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vs = []
            for c in ("v_a", "v_b"):
                flat = np.asarray(batch.column(c).flatten(), np.float64).reshape(batch.num_rows, -1)
                vs.append(flat / np.sqrt((flat * flat).sum(axis=1))[:, None])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((vs[0] * vs[1]).sum(axis=1))], ["a", "b", "cosine"])

    return run


def similar_vectors(
    rows: DataFrame, id_col: str, vector_col: str, dim: int, k: int = 5, least_cosine: float | None = None,
    curves: int = 12, axes: int = 3, window: int = 512, every: int | None = None,
) -> DataFrame:
    """id, neighbour, cosine, rank (1..k) for every usable vector, by cosine, then by id.

    Usable: length dim, no null or non-finite item, norm not zero; other rows, and rows without id, are neither asked nor found.
    Equal vectors are one vector on the curves and are all found (as links between rows) at the end. least_cosine is pushed
    down: a neighbour from there on is among the k nearest by others from there on, so nothing below need be kept. every: only
    vectors whose 64-bit identity it divides are asked, against all; their windows may then be wide. An empty table gives an empty
    result. With least_cosine windows grow with the rows (WINDOW_PART).
    """
    spark = rows.sparkSession
    base = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).filter(F.col("id").isNotNull() & (F.size("v") == dim))
    base = base.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    # A vector's identity: rows with equal vectors share it.
    base = base.withColumn("vec_id", F.xxhash64(F.col("v").cast("array<double>")))
    n = base.count()
    sample = base.select("vec_id", "v").filter(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // (SAMPLE // 2)))) == 0).limit(SAMPLE)
    at = sample.toArrow()
    _, unit = unit_rows(at.column("v"), dim)
    if least_cosine is None:
        made = Curves(dim, curves, min(axes, dim))
    else:
        made, window = Polytopes(dim, curves), max(window, -(-n // WINDOW_PART))
    overlap = 16
    ranges = max(1, round(n / (overlap * 2 * window)))
    inner = np.linspace(0, 1, ranges * overlap + 1)[1:-1]
    cuts = [np.quantile(made.keys(unit.astype(np.float32), c), inner, method="lower") if len(unit) else np.zeros(0, np.int64) for c in range(curves)]
    floor = None if least_cosine is None else least_cosine - 0.03  # more than the bytes can be off
    placed = base.select("vec_id", "v").mapInArrow(_ordering(made, cuts, dim, overlap, every is not None), "region long, rows binary")
    meet = _meeting(dim, window, 3 * k, floor) if every is None else _asking(dim, window, 3 * k, floor, every)
    pairs = placed.groupBy("region").applyInArrow(meet, "a long, b long").distinct()
    pairs = written(pairs, "met")
    exact = attach(pairs, base.groupBy("vec_id").agg(F.min(F.struct("v")).getField("v").alias("v")), "vec_id", "v", pairs.count())
    exact = exact.select("a", "b", "v_a", "v_b").mapInArrow(_cosines(), "a long, b long, cosine double")
    if least_cosine is not None:
        exact = exact.filter(F.col("cosine") >= least_cosine)
    exact = written(exact, "cosines")
    mine = F.lit(True) if every is None else F.pmod("a", F.lit(every)) == 0
    both = exact.unionByName(exact.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")).filter(mine)
    # Only the k best vectors of a vector can hold its k best rows.
    best = both.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).filter(F.col("rank") <= k).drop("rank")
    members = base.select("id", "vec_id")
    firsts = _first_members(members, k + 1)
    near = best.join(firsts.select(F.col("vec_id").alias("b"), "first"), "b").select("a", F.explode("first").alias("neighbour"), "cosine")
    same = firsts.filter(F.size("first") > 1).select(F.col("vec_id").alias("a"), F.explode("first").alias("neighbour"), F.lit(1.0).alias("cosine"))
    found = members.select("id", F.col("vec_id").alias("a")).filter(mine).join(near.unionByName(same), "a").filter("id <> neighbour")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")))
    return ranked.filter(F.col("rank") <= k).select("id", "neighbour", "cosine", "rank")


#: Vectors asked at a time by nearest_of: some megabytes for every task.
ASKED_AT_ONCE = 8_192


def nearest_of(rows: DataFrame, asked: DataFrame, id_col: str, vector_col: str, dim: int, k: int = 5) -> DataFrame:
    """id, neighbour, cosine, rank (1..k) of the vectors of `asked` (same columns) against all rows, exactly: the way for vectors that
    no curve brings together, as their nearest are hardly nearer than any other.

    The asked ones are taken ASKED_AT_ONCE at a time, in order of a hash; each row is compared with all of a block in one matrix product where it is
    read, and a batch of rows gives its own best k of each. Usable rows, ties and empty tables as in similar_vectors.
    """
    usable = lambda df: df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).filter(F.col("id").isNotNull() & (F.size("v") == dim))
    every, asked = usable(rows), usable(asked)
    kind = dict(every.dtypes)["id"]
    blocks = max(1, -(-asked.count() * 5 // (ASKED_AT_ONCE * 4)))  # filled to four fifths at the mean
    found = None
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()
        at, unit = unit_rows(part.column("v"), dim)
        ids = part.column("id").take(pa.array(at))
        best = every.mapInArrow(_scanning(ids, unit, dim, k + 1), f"id {kind}, neighbour {kind}, cosine double")
        best = best.filter("id <> neighbour")
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))).filter(F.col("rank") <= k)
        found = best if found is None else found.unionByName(best)
    return found


def _scanning(ids: pa.Array, asked: np.ndarray, dim: int, k: int):
    """(id, v) -> for each asked vector its k best of the batch, those as good as the last among them."""
    names = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids

    def run(batches):
        for batch in batches:
            at, unit = unit_rows(batch.column(1), dim)
            for low in range(0, len(at), 2048):
                s = asked @ unit[low : low + 2048].T
                m = min(k, s.shape[1])
                if not s.size:
                    continue
                edge = -np.partition(-s, m - 1, axis=1)[:, m - 1]
                x, y = np.nonzero(s >= edge[:, None])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(x)), batch.column(0).take(pa.array(at[low + y])), pa.array(s[x, y])], ["id", "neighbour", "cosine"])

    return run


def _first_members(members: DataFrame, k: int) -> DataFrame:
    """vec_id, first: its k least ids. Copies in excess of k are never needed as neighbours; each still is asked for its own."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for by in (["vec_id", "salt"], ["vec_id"]):
        w = Window.partitionBy(*by).orderBy("id")
        salted = salted.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).drop("n")
    return salted.groupBy("vec_id").agg(F.sort_array(F.collect_list("id")).alias("first"))
