import pytest
from pyspark.sql import functions as F

from corpusloom.operators.collection import CollectionSchema, Collections, VectorConfig
from corpusloom.operators.filters import Condition, Filter
from corpusloom.operators.ingest import batch_size, ingest, points_of_documents, tallies, verified
from corpusloom.operators.search import SearchQuery, run_leg

SCHEMA = CollectionSchema("c", [VectorConfig("text_dense", 2), VectorConfig("image_dense", 2)])
POINTS = [
    ("u1", [1.0, 0.0], None, "retrieval with words", "en"), ("10001", [0.0, 1.0], None, "pumps", "en"), ("u3", None, [1.0, 0.0], None, "en"),
    ("u4", [1.0, 1.0], [0.0, 1.0], "mixed", "en"), ("u5", [1.0, 0.5], None, "scanned page retrieval", "vi"),
]
KIND = "id string, text_dense array<float>, image_dense array<float>, text string, lang string"


@pytest.fixture
def store(spark, tmp_path):
    return Collections(spark, str(tmp_path))


def test_life_of_a_collection(spark, store):
    points = spark.createDataFrame(POINTS, KIND)
    store.create(SCHEMA)
    assert store.exists("c") and store.count("c") == 0
    store.upsert("c", points)
    store.upsert("c", points.limit(2))
    assert store.count("c") == 5
    vi = Filter(must=[Condition("lang", "eq", "vi")])
    assert run_leg(store.rows("c"), SearchQuery("bm25", query_text="scanned page retrieval", limit=10, filter=vi)).count() == 1
    store.delete_where("c", vi)
    assert store.count("c") == 4
    store.compact("c")
    assert store.count("c") == 4 and len(store._runs("c")) == 1
    store.delete_ids("c", spark.createDataFrame([("u1",), ("10001",), ("u3",), ("u4",), ("none",)], "id string"))
    assert store.count("c") == 0
    store.upsert("c", points.limit(1))
    assert [r["id"] for r in store.rows("c").collect()] == ["u1"]
    store.drop("c")
    assert not store.exists("c")


def test_errors(spark, store):
    store.ensure(SCHEMA)
    store.ensure(SCHEMA)
    with pytest.raises(ValueError):
        store.ensure(CollectionSchema("c", [VectorConfig("text_dense", 3)]))
    with pytest.raises(ValueError):
        store.create(SCHEMA)
    with pytest.raises(ValueError):
        store.delete_where("c", Filter())
    with pytest.raises(LookupError):
        store.count("other")
    with pytest.raises(Exception, match="text_dense must have 2 items"):
        store.upsert("c", spark.createDataFrame([("x", [1.0])], "id string, text_dense array<float>"))
    for bad in (CollectionSchema("d", []), CollectionSchema("d", [VectorConfig("v", 2, "EUCLID")]), CollectionSchema(" ", [VectorConfig("v", 2)])):
        with pytest.raises(ValueError):
            store.create(bad)


def test_ingest(spark, store):
    docs = spark.createDataFrame([("d1", "One two three four five six seven eight nine ten. ![x](a.png)", "en", "p"), ("d2", None, "en", "p"), ("d3", "# only a head", None, None)], "doc_id string, text string, lang string, source_path string")
    for _ in range(2):  # again: the same ids
        got = {r["doc_id"]: (r["n_points"], r["verified"]) for r in ingest(docs, store, "in").collect()}
    assert got == {"d1": (1, True), "d2": (0, False), "d3": (0, False)}
    assert [tuple(r) for r in tallies(points_of_documents(docs)).collect()] == [("d1", 1, 0)]
    assert verified(store.rows("in"), "d1", "seven eight").first()["found"] and not verified(store.rows("in"), "d1", " ").first()["found"]
    assert [batch_size(*a) for a in ((None, None), (0, 30), (500, 30))] == [20, 30, 200]


def test_writers_that_meet_lose_nothing(spark, tmp_path):
    """A run's number that another writer holds is passed over."""
    made = Collections(spark, str(tmp_path / "c"))
    made.create(CollectionSchema("x", [VectorConfig("text_dense", 2)]))
    rows = spark.createDataFrame([("a", [1.0, 2.0])], "id string, text_dense array<float>")
    assert made._fs.createNewFile(made._path(made._at("x", "_taken-1")))
    made.upsert("x", rows)
    made.upsert("x", rows.withColumn("id", F.lit("b")))
    assert made._runs("x") == [2, 3] and made.count("x") == 2
