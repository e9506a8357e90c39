"""Texts packed into training sequences of a fixed capacity (problem 8).

Only the histogram of sizes decides how sequences are made up: patterns of up to three sizes that fill the capacity exactly are
enumerated, non-negative least squares fits how often to repeat each so that the histogram is used up, the counts are rounded
down, and what is left is packed best fit, largest first. The plan is as small as the histogram; texts then take the places of
their size by rank, without meeting each other.
"""

from __future__ import annotations

import base64
import importlib.util
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import spread, written

TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_multi_50k.tiktoken"
CAPACITY = 512
#: Texts of one size that are ranked in one group, at the mean: there are as many groups as the rows ask for.
RANKED_AT_ONCE = 200_000
#: Sizes that patterns of three are made of, at most; where a collection has more, those that most tokens are in take part.
PATTERN_SIZES = 512


def load_encoding(folder: str = TOKENIZERS, ranks: str = RANKS):
    """A byte-level tokenizer from a file of ranks; the folder's module has the pattern that splits text before the merges."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("tokenizer_folder", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(os.path.join(folder, ranks), "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=merges, special_tokens={})


_ENCODINGS: dict = {}


def _sizing(folder: str, ranks: str, capacity: int):
    def run(batches):
        if (folder, ranks) not in _ENCODINGS:
            _ENCODINGS[folder, ranks] = load_encoding(folder, ranks)
        enc = _ENCODINGS[folder, ranks]
        for batch in batches:
            at, first, n, part = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                total = len(enc.encode_ordinary(t.encode("utf-8", "replace").decode()))
                for k, low in enumerate(range(0, max(1, total), capacity)):
                    at.append(i)
                    part.append(k)
                    first.append(low)
                    n.append(min(capacity, total - low))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(part, pa.int32()), pa.array(first, pa.int64()), pa.array(n, pa.int32())], ["id", "part_no", "first_token", "n_tokens"]
            )

    return run


def patterns(capacity: int, sizes: np.ndarray, often: np.ndarray | None = None) -> list[np.ndarray]:
    """Patterns of one, two and three of the sizes (non-decreasing) that fill the capacity exactly, as arrays with a column per item.
    often: the only sizes of which the two smaller of three may be, so that there are no more than their number squared."""
    have = np.zeros(capacity + 1, bool)
    have[sizes[(sizes > 0) & (sizes <= capacity)]] = True
    s = np.flatnonzero(have)
    one = np.array([[capacity]]) if have[capacity] else np.zeros((0, 1), int)
    two = np.array([[a, capacity - a] for a in s if a * 2 <= capacity and have[capacity - a]]).reshape(-1, 2)
    if often is not None:
        s = s[np.isin(s, often)]
    a, b = np.meshgrid(s, s, indexing="ij")
    c = capacity - a - b
    good = (a <= b) & (b <= c) & (c > 0)
    good[good] = have[c[good]]
    return [one, two, np.stack([a[good], b[good], c[good]], axis=1)]


def fit_repeats(groups: list[np.ndarray], histogram: np.ndarray, rounds: int = 3000) -> list[np.ndarray]:
    """Repeat counts x >= 0 that make the patterns use up the histogram best: accelerated projected gradients on the weighted
    squares. Large sizes weigh more, as small ones always find a place."""
    n = len(histogram)
    w = np.arange(n, dtype=float) / max(1, n - 1)
    scale = max(1.0, histogram.max(initial=0))
    h = histogram / scale

    def use(xs):
        out = np.zeros(n)
        for g, x in zip(groups, xs):
            for k in range(g.shape[1] if len(g) else 0):
                out += np.bincount(g[:, k], weights=x, minlength=n)
        return out

    def gradient(r):
        return [sum(r[g[:, k]] for k in range(g.shape[1])) if len(g) else np.zeros(0) for g in groups]

    # Largest eigenvalue by power iteration gives the step.
    v = [np.ones(len(g)) for g in groups]
    top = 1.0
    for _ in range(30):
        v = gradient(w * use(v))
        top = max(1e-12, float(np.sqrt(sum((x * x).sum() for x in v))))
        v = [x / top for x in v]
    x = [np.zeros(len(g)) for g in groups]
    y, t = [z.copy() for z in x], 1.0
    for _ in range(rounds):
        g = gradient(w * (use(y) - h))
        new = [np.maximum(0, a - b / top) for a, b in zip(y, g)]
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = [b + (t - 1) / t2 * (b - a) for a, b in zip(x, new)]
        moved = max((float(np.abs(b - a).max(initial=0)) for a, b in zip(x, new)), default=0.0)
        x, t = new, t2
        if moved < 1e-9:
            break
    return [z * scale for z in x]


def plan_packs(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(sizes of a sequence's items, number of such sequences): every item of the histogram has a place, no sequence is above the
    capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        left[size] += n
    left[0] = 0
    plan: list[tuple[tuple[int, ...], int]] = []
    sizes = np.flatnonzero(left)
    often = sizes[np.argsort(-(left * np.arange(capacity + 1))[sizes], kind="stable")[:PATTERN_SIZES]] if len(sizes) > PATTERN_SIZES else None
    groups = patterns(capacity, sizes, often)
    repeats = fit_repeats(groups, left.astype(float))
    ranked = sorted(((x, tuple(int(v) for v in p)) for g, xs in zip(groups, repeats) for p, x in zip(g, xs) if x > 0.5), reverse=True)
    for x, p in ranked:
        n = min(int(x), *(int(left[s]) // p.count(s) for s in p))
        if n > 0:
            plan.append((p, n))
            for s in p:
                left[s] -= n
    # The rest, best fit from the largest size down, for all items of a size at once. open_: space left -> kinds of sequences.
    open_: dict[int, list[list]] = {}
    for size in range(capacity, 0, -1):
        n = int(left[size])
        for space in sorted(k for k in open_ if k >= size):
            while n and open_.get(space):
                kind, count = open_[space].pop()
                m = min(n, count)
                if count > m:
                    open_[space].append([kind, count - m])
                open_.setdefault(space - size, []).append([(*kind, size), m])
                n -= m
        while n:
            each = min(n, capacity // size)
            m = n // each
            open_.setdefault(capacity - each * size, []).append([(size,) * each, m])
            n -= m * each
    for kinds in open_.values():
        plan.extend((kind, count) for kind, count in kinds if count)
    return plan


def _places(plan):
    """For each size: where ranges of ranks begin, and the first sequence and the slot of each range."""
    per_size: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for kind, n in plan:
        for slot, size in enumerate(kind):
            per_size.setdefault(size, []).append((taken.get(size, 0), base, slot))
            taken[size] = taken.get(size, 0) + n
        base += n
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows)) for s, rows in per_size.items()}


def _placing(places):
    def run(batches):
        for batch in batches:
            size, rank = (np.asarray(batch.column(c), np.int64) for c in ("n_tokens", "rank"))
            pack, slot = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size[size > 0]):
                at = np.flatnonzero(size == s)
                start, base, slots = places[int(s)]
                k = np.searchsorted(start, rank[at], side="right") - 1
                pack[at], slot[at] = base[k] + rank[at] - start[k], slots[k]
            none = size == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("part_no"), batch.column("first_token"), batch.column("n_tokens"), pa.array(pack, pa.int64(), mask=none), pa.array(slot.astype(np.int32), pa.int32(), mask=none)],
                ["id", "part_no", "first_token", "n_tokens", "sequence_id", "slot"],
            )

    return run


def pack_texts(texts: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """id, part_no, first_token, n_tokens, sequence_id, slot: the place of every text, sequences numbered from 0.

    A text above the capacity is cut into parts of just the capacity and a rest; no other is cut. Texts of no token take no place
    (null sequence_id), null texts have no row, repeated ids and texts each have their places.
    """
    if capacity < 1:
        raise ValueError("a sequence holds one token at least")
    rows = texts.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter(F.col("text").isNotNull())
    kind = dict(rows.dtypes)["id"]
    sized = spread(rows).mapInArrow(_sizing(folder, ranks, capacity), f"id {kind}, part_no int, first_token long, n_tokens int")
    sized = written(sized, "sizes")
    # Parts of just the capacity fill a sequence each and need no rank; the others of one size are ranked in groups whose number
    # follows that of the rows.
    rest = sized.filter(F.col("n_tokens") < capacity)
    most = rest.groupBy("n_tokens").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    salts = max(1, most // RANKED_AT_ONCE + 1)
    rest = rest.withColumn("salt", F.pmod(F.xxhash64("id", "part_no"), F.lit(salts)).cast("int"))
    w = Window.partitionBy("n_tokens", "salt")
    counts = rest.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    # A row for each size and group, numbered over the groups of a size: its own small table, joined by size and group.
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    histogram = {r["n_tokens"]: r["n"] for r in counts.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = plan_packs(histogram, capacity)
    places = _places(plan)
    first_full = sum(n for _, n in plan)
    ranked = rest.withColumn("r", F.row_number().over(w.orderBy("id", "part_no")) - 1).join(before, ["n_tokens", "salt"])
    ranked = ranked.select("id", "part_no", "first_token", "n_tokens", (F.col("before") + F.col("r")).alias("rank"))
    placed = ranked.mapInArrow(_placing(places), f"id {kind}, part_no int, first_token long, n_tokens int, sequence_id long, slot int")
    return placed.unionByName(_numbered(sized.filter(F.col("n_tokens") == capacity), first_full))


def _numbered(full: DataFrame, first: int) -> DataFrame:
    """Parts that fill a sequence each, numbered from `first` without a gap: within groups of their hash, and the groups by their counts."""
    groups = max(1, full.count() // RANKED_AT_ONCE + 1)
    full = full.withColumn("salt", F.pmod(F.xxhash64("id", "part_no"), F.lit(groups)).cast("int"))
    counts = sorted(full.groupBy("salt").agg(F.count("*").alias("n")).collect())  # one row for RANKED_AT_ONCE rows
    at, offsets = first, {}
    for r in counts:
        offsets[r["salt"]], at = at, at + r["n"]
    before = full.sparkSession.createDataFrame(list(offsets.items()), "salt int, before long")
    r = F.row_number().over(Window.partitionBy("salt").orderBy("id", "part_no")) - 1
    numbered = full.withColumn("r", r).join(before, "salt")
    return numbered.select("id", "part_no", "first_token", "n_tokens", (F.col("before") + F.col("r")).cast("long").alias("sequence_id"), F.lit(0).alias("slot"))
