"""Queries on collections: each builds one in the shared folder and reads it back."""

from pyspark.sql import functions as F

from corpusloom.operators.collection import CollectionSchema, Collections, VectorConfig
from corpusloom.operators.filters import Condition, Filter
from corpusloom.session import fresh_path, read_table

COLUMNS = ("id", "lang", "page", "text_dense")


def _made(spark, d):
    """All points, then those on odd pages again with another page."""
    c = Collections(spark, fresh_path(spark, "collections"))
    c.ensure(CollectionSchema("points", [VectorConfig("text_dense", 64)]))
    p = read_table(spark, d, "points").select(*COLUMNS).withColumn("text_dense", F.when(F.size("text_dense") == 64, F.col("text_dense")))
    c.upsert("points", p)
    c.upsert("points", p.filter("page % 2 = 1").withColumn("page", F.col("page") + 1000))
    return c


def _shown(df):
    return df.select("id", "lang", "page", F.col("text_dense").isNotNull().alias("has_vector"))


def upsert_latest(spark, d):
    c = _made(spark, d)
    c.compact("points")
    return _shown(c.rows("points"))


def delete_by_filter(spark, d):
    c = _made(spark, d)
    c.delete_where("points", Filter(must=[Condition("lang", "eq", "en")], must_not=[Condition("page", "in", [2, 1001])]))
    return _shown(c.rows("points"))


def delete_by_ids(spark, d):
    c = _made(spark, d)
    c.delete_ids("points", read_table(spark, d, "points").filter("page = 2").select("id"))
    return _shown(c.rows("points"))


def exact_count(spark, d):
    c = _made(spark, d)
    n = [("all", c.count("points")), ("vi", c.count("points", Filter(must=[Condition("lang", "eq", "vi")])))]
    return spark.createDataFrame(n, "name string, n long")


def collection_lifecycle(spark, d):
    """Whether the collection exists before, after creation, after a second ensure, and after the drop."""
    c = Collections(spark, fresh_path(spark, "collections"))
    s = CollectionSchema("points", [VectorConfig("", 64), VectorConfig("image_dense", 48)])
    seen = [("before", c.exists("points"))]
    c.create(s)
    seen.append(("created", c.exists("points")))
    c.ensure(s)
    seen.append(("ensured", c.schema("points").vectors[0].name == "text_dense"))
    c.drop("points")
    return spark.createDataFrame([*seen, ("dropped", c.exists("points"))], "step string, there boolean")


QUERIES = {f.__name__: f for f in (upsert_latest, delete_by_filter, delete_by_ids, exact_count, collection_lifecycle)}
_P = "(SELECT id, lang, CASE WHEN page % 2 = 1 THEN page + 1000 ELSE page END AS page, coalesce(len(text_dense) = 64, false) AS has_vector FROM points)"
SQL = {
    "upsert_latest": f"SELECT * FROM {_P}",
    "delete_by_filter": f"SELECT * FROM {_P} WHERE NOT (coalesce(lang = 'en', false) AND NOT coalesce(page IN (2, 1001), false))",
    "delete_by_ids": f"SELECT * FROM {_P} WHERE id NOT IN (SELECT id FROM points WHERE page = 2)",
    "exact_count": "SELECT 'all' AS name, count(*) AS n FROM points UNION ALL SELECT 'vi', count(*) FROM points WHERE lang = 'vi'",
    "collection_lifecycle": "SELECT * FROM (VALUES ('before', false), ('created', true), ('ensured', true), ('dropped', false)) t(step, there)",
}
