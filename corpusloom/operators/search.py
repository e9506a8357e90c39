"""Search with one or several legs: ranking, normalisation and weighted fusion."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators.filters import Filter, filter_column
from corpusloom.operators.lexical import bm25_scores, searchable
from corpusloom.session import fresh_name

#: Weights of legs by vector name: fixed values.
WEIGHTS = {"text_dense": 0.5, "image_dense": 0.2, "bm25": 0.2}
EPSILON = 1e-8


@dataclass(frozen=True)
class SearchQuery:
    vector_name: str = ""
    vector: list[float] | None = None
    query_text: str = ""
    limit: int = 10
    score_threshold: float | None = None
    filter: Filter | None = None
    distance: str = "cosine"
    with_payload: bool = True

    def mode(self) -> str:
        """dense or lexical, from the name, or from what is given where there is none."""
        name = self.vector_name.strip().lower()
        if name == "bm25":
            return "lexical"
        if name in ("text_dense", "image_dense"):
            return "dense"
        if self.vector:
            return "dense"
        if not name and self.query_text.strip():
            return "lexical"
        raise ValueError(f"nothing to search {self.vector_name!r} with")

    def checked(self) -> SearchQuery:
        if self.limit < 1:
            raise ValueError("limit must be above zero")
        if self.mode() == "dense" and not self.vector:
            raise ValueError("a dense leg needs a vector")
        if self.mode() == "lexical" and not self.query_text.strip():
            raise ValueError("a lexical leg needs a text")
        return self


def expanded(queries: list[SearchQuery]) -> list[SearchQuery]:
    """With a bm25 leg added, if the first text_dense leg with a text has none beside it."""
    names = [q.vector_name.strip().lower() for q in queries]
    if "bm25" in names:
        return list(queries)
    base = next((q for q, n in zip(queries, names) if n == "text_dense" and q.query_text.strip()), None)
    return [*queries, replace(base, vector_name="bm25", vector=None)] if base else list(queries)


def leg_weights(queries: list[SearchQuery]) -> list[float]:
    """Weights that sum to one; legs that find nothing keep theirs."""
    raw = [max(0.0, WEIGHTS.get(q.vector_name.strip().lower(), 1.0)) for q in queries]
    total = sum(raw)
    return [w / total for w in raw] if total > 0 else [1 / len(raw)] * len(raw)


def run_leg(points: DataFrame, q: SearchQuery, id_col: str = "id", text_col: str | None = None) -> DataFrame:
    """id, score: the best `limit` rows of a leg, larger scores first, then the id. Distances count negatively. A lexical leg searches
    title, text, text of images and keywords together, as far as there are such columns, or text_col alone."""
    q = q.checked()
    keep = filter_column(q.filter, points.schema)
    if q.mode() == "lexical":
        name = text_col or fresh_name("searchable", points.columns)
        scored = bm25_scores(points if text_col else points.withColumn(name, searchable(points)), q.query_text, id_col, name, keep)
    else:
        rows = points if keep is None else points.filter(keep)
        value = V.score(F.col(f"`{q.vector_name.strip() or 'text_dense'}`"), V.vector(q.vector), q.distance)
        value = value if V.larger_is_better(q.distance) else -value
        scored = rows.select(F.col(f"`{id_col}`").alias("id"), value.alias("score")).filter(F.col("score").isNotNull())
    if q.score_threshold is not None:
        limit = q.score_threshold if q.mode() == "lexical" or V.larger_is_better(q.distance) else -q.score_threshold
        scored = scored.filter(F.col("score") >= F.lit(float(limit)))
    return scored.orderBy(F.desc("score"), "id").limit(q.limit)


def normalised(leg: DataFrame) -> DataFrame:
    """Scores scaled to the leg's own least and largest; a single row and a flat leg keep theirs."""
    w = Window.partitionBy()  # a leg holds `limit` rows
    least, most, n = F.min("score").over(w), F.max("score").over(w), F.count("*").over(w)
    flat = (n == 1) | (most - least <= EPSILON)
    return leg.withColumn("score", F.when(flat, F.col("score")).otherwise((F.col("score") - least) / (most - least + EPSILON)))


def fused(legs: list[DataFrame], weights: list[float], limit: int) -> DataFrame:
    """id, score: weighted sums over the legs that have the id, the best `limit` of them."""
    parts = [leg.select("id", (F.col("score") * F.lit(w)).alias("part")) for leg, w in zip(legs, weights)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def search(points: DataFrame, queries: list[SearchQuery], id_col: str = "id", text_col: str | None = None, payload: list[str] | None = None) -> DataFrame:
    """id, score, rank and, where wanted, payload columns of the fused legs; the first query's limit cuts the result."""
    if not queries:
        raise ValueError("no query")
    legs = expanded(queries)
    found = fused([normalised(run_leg(points, q, id_col, text_col)) for q in legs], leg_weights(legs), queries[0].limit)
    w = Window.orderBy(F.desc("score"), "id")  # at most `limit` rows
    found = found.withColumn("rank", F.row_number().over(w))
    if not (queries[0].with_payload and payload):
        return found
    rows = points.select(F.col(f"`{id_col}`").alias("id"), *[c for c in payload if c != "id"])
    return F.broadcast(found).join(rows, "id")


def exists(points: DataFrame, query: str, f: Filter, id_col: str = "id", text_col: str | None = None) -> DataFrame:
    """One row, found: whether a lexical search under the filter finds anything."""
    hit = run_leg(points, SearchQuery("bm25", None, query, 1, None, f), id_col, text_col)
    return hit.agg((F.count("*") > 0).alias("found"))


#: Query vectors that go to every task at most.
MOST_QUERIES = 10_000


def _top_of_batches(ids: np.ndarray, matrix: np.ndarray, k: int):
    norms = np.linalg.norm(matrix, axis=1)
    q = (matrix / np.where(norms > 0, norms, 1)[:, None]).T

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            flat = np.asarray(column.flatten(), np.float64).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, q.shape[0]))
            n = np.sqrt((flat * flat).sum(axis=1))
            good = np.flatnonzero(n > 0)
            s = (flat[good] / n[good][:, None]) @ q
            if not len(good):
                continue
            m = min(k, len(good))
            best = np.argpartition(-s, m - 1, axis=0)[:m]
            edge = np.take_along_axis(s, best, axis=0).min(axis=0)
            r, c = np.nonzero((s >= edge[None, :]) & (norms > 0)[None, :])  # ties at the edge stay, the id decides later
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[c]), batch.column(0).take(pa.array(good[r])), pa.array(s[r, c])], ["query_id", "id", "score"]
            )

    return run


def batch_topk(points: DataFrame, queries: DataFrame, k: int, dim: int, id_col: str = "id", vector_col: str = "text_dense") -> DataFrame:
    """query_id, id, score, rank: the k nearest by cosine of each query vector (query_id long, vector). Every batch of rows is one
    matrix product and gives its own best, so only k rows a query and batch are shuffled. Vectors of another length, with null
    items or without a norm are neither asked nor found."""
    usable = lambda c: (F.size(c) == dim) & ~F.exists(c, lambda x: x.isNull())
    asked = queries.select(F.col("query_id").cast("long"), "vector").filter(usable("vector")).limit(MOST_QUERIES + 1).collect()
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} query vectors; split them")
    kind = dict(points.dtypes)[id_col]
    ids = np.array([r[0] for r in asked], np.int64)
    matrix = np.array([r[1] for r in asked], np.float64).reshape(len(asked), dim)
    rows = points.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).filter(usable("v"))
    best = rows.mapInArrow(_top_of_batches(ids, matrix, k), f"query_id long, id {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
