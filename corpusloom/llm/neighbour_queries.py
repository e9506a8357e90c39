"""Queries of problem 3."""

from pyspark.sql import functions as F

from corpusloom.llm.neighbours import nearest_of, similar_vectors
from corpusloom.session import read_table

FIELDS = {"text_dense": 64, "image_dense": 48}


def p3_found(spark, d):
    points, out = read_table(spark, d, "points"), None
    for name, dim in FIELDS.items():
        near = similar_vectors(points, "id", name, dim, k=5, least_cosine=0.9)
        pairs = near.select(F.lit(name).alias("vector_name"), F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b"))
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def _asked(points):
    """A fiftieth of the rows, by the first 32 bits of their id's MD5."""
    return points.filter(F.pmod(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long"), F.lit(50)) == 0)


def p3_neighbours(spark, d):
    """The five most similar of a fiftieth of the vectors against all, whatever their cosine. Most of these are hardly nearer than
    any other vector, where curves can't tell them; so they are asked exactly."""
    points, out = read_table(spark, d, "points"), None
    for name, dim in FIELDS.items():
        near = nearest_of(points, _asked(points), "id", name, dim, k=5)
        rows = near.select(F.lit(name).alias("vector_name"), "id", "neighbour", F.col("rank").cast("long").alias("rank"), F.round("cosine", 6).alias("cosine"))
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours}


def _sql(name, dim):
    norm = "sqrt(list_sum(list_transform(v, lambda x: x * x)))"
    return f"""SELECT '{name}' AS vector_name, id, neighbour, rank, round(s, 6) AS cosine FROM (
 SELECT a.id, b.id AS neighbour, list_cosine_similarity(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS rank
 FROM (SELECT id, v FROM u_{name} WHERE ('0x' || substr(md5(id), 1, 8))::BIGINT % 50 = 0) a JOIN u_{name} b ON a.id <> b.id) WHERE rank <= 5""", (
        f"u_{name} AS (SELECT * FROM (SELECT id, {name}::DOUBLE[] AS v FROM points WHERE len({name}) = {dim}) WHERE {norm} > 1e-12)"
    )


_PARTS = [_sql(name, dim) for name, dim in FIELDS.items()]
SQL = {"p3_neighbours": f"WITH {', '.join(w for _, w in _PARTS)} " + " UNION ALL ".join(q for q, _ in _PARTS)}
