import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators.filters import Condition, Filter, filtered
from corpusloom.operators.payload import payload_map, typed_payload
from corpusloom.operators.search import SearchQuery, batch_topk, expanded, fused, leg_weights, normalised, run_leg, search

POINTS = [("a", [1.0, 0.0], "red pump", "en", 1, ["x"]), ("b", [0.6, 0.8], "blue pump valve", "vi", 0, None), ("c", None, "pump pump red", "en", 2, []), ("d", [0.0, 0.0], None, None, None, ["x", "y"])]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(POINTS, "id string, text_dense array<float>, text string, lang string, page int, keywords array<string>")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_filters(points):
    assert sorted(ids(filtered(points, Filter(must_not=[Condition("lang", "eq", "en")])))) == ["b", "d"]
    assert sorted(ids(filtered(points, Filter(should=[Condition("page", "in", [0, 2]), Condition(" keywords ", "eq", "y")])))) == ["b", "c", "d"]
    assert ids(filtered(points, Filter(must=[Condition("nothing", "eq", "x")]))) == []
    assert ids(filtered(points, Filter(must=[Condition("page", "eq", "1")]))) == []
    assert len(ids(filtered(points, Filter()))) == 4


@pytest.mark.parametrize("c", [Condition("", "eq", "x"), Condition("a", "like", "x"), Condition("a", "eq", 1.5), Condition("a", "eq", None), Condition("a", "in", []), Condition("a", "in", ["x", 1]), Condition("a", "in", [True])])
def test_bad_conditions(c):
    with pytest.raises(ValueError):
        c.checked()


def test_decoding():
    assert Condition.decoded({"key": " k ", "operator": " eq ", "bool_value": False, "int_values": [1]}).checked() == Condition("k", "eq", False)
    assert Condition.decoded({"key": "k", "operator": "in", "string_values": ["a"]}).value == ["a"]


def test_modes_and_guards():
    assert [SearchQuery(n).mode() for n in (" BM25 ", "text_dense")] == ["lexical", "dense"]
    assert SearchQuery("", [1.0]).mode() == "dense" and SearchQuery("", query_text="x").mode() == "lexical"
    for q in (SearchQuery("other"), SearchQuery("text_dense"), SearchQuery("bm25", query_text=" "), SearchQuery("text_dense", [1.0], limit=0)):
        with pytest.raises(ValueError):
            q.checked()


def test_expansion_and_weights():
    base = SearchQuery("text_dense", [1.0], "words", limit=3, score_threshold=0.5)
    legs = expanded([SearchQuery("image_dense", [1.0]), base])
    assert [q.vector_name for q in legs] == ["image_dense", "text_dense", "bm25"] and legs[2].vector is None and legs[2].limit == 3 and legs[2].score_threshold == 0.5
    assert expanded([SearchQuery("text_dense", [1.0])])[-1].vector_name == "text_dense"
    assert leg_weights(legs[1:]) == pytest.approx([5 / 7, 2 / 7])


def test_legs(points):
    assert ids(run_leg(points, SearchQuery("text_dense", [1.0, 0.0], limit=5))) == ["a", "b"]  # no norm, no row
    assert ids(run_leg(points, SearchQuery("text_dense", [1.0, 0.0], limit=5, distance="euclid"))) == ["a", "b", "d"]
    assert ids(run_leg(points, SearchQuery("bm25", query_text="RED pump!", limit=5), text_col="text")) == ["a", "c", "b"]
    assert ids(run_leg(points, SearchQuery("text_dense", [1.0, 0.0], limit=5, score_threshold=0.7))) == ["a"]
    assert ids(search(points, [SearchQuery("text_dense", [1.0, 0.0], "blue", limit=2)])) == ["a", "b"]
    with pytest.raises(ValueError):
        search(points, [])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=0, max_size=6), st.randoms())
def test_fusion(spark, scores, rng):
    rows = [(f"p{i}", float(s)) for i, s in enumerate(scores)]
    leg = spark.createDataFrame(rows, "id string, score double")
    normal = [r["score"] for r in normalised(leg).collect()]
    if len(scores) > 1 and max(scores) - min(scores) > 1e-8:
        assert min(normal) == 0 and max(normal) <= 1
    else:
        assert sorted(normal) == sorted(scores)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    a, b = (fused([leg, spark.createDataFrame(r, "id string, score double")], [0.7, 0.3], 3).collect() for r in (rows, shuffled))
    assert [r["id"] for r in a] == [r["id"] for r in b]


def test_batch_topk(spark, points):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, [0.0, 0.0])], "query_id int, vector array<double>")
    got = sorted((r["query_id"], r["id"], r["rank"]) for r in batch_topk(points, q, 1, 2).collect())
    assert got == [(1, "a", 1), (2, "b", 1)]


def test_payload_round_trip(spark):
    m = {"doc_id": "d", "page": " 5", "chunk_index": "+7", "token_count": "x", "has_table": "T", "has_figure": "yes", "keywords": "a, b,", "created_at": "2026-03-28T12:00:00Z", "other": "z"}
    row = spark.createDataFrame([(m,)], "m map<string,string>").select(*typed_payload(F.col("m")))
    got = row.first()
    assert (got["page"], got["chunk_index"], got["token_count"], got["has_table"], got["has_figure"], got["keywords"], got["text"]) == (0, 7, 0, True, False, ["a", " b", ""], "")
    back = row.select(payload_map(row.columns).alias("m")).first()["m"]
    assert back == {"doc_id": "d", "chunk_index": "7", "has_table": "true", "keywords": "a, b,", "created_at": "2026-03-28T12:00:00Z"}


def test_index_and_searchable_text(spark):
    from corpusloom.operators.lexical import LexicalIndex, bm25_scores, searchable

    rows = [("a", None, "Red pump", None, ["valve"], 1), ("b", "Title", None, "scanned gasket", None, 2), ("c", None, None, None, None, 3), ("d", " ", "pump pump", "x", ["", "Gasket"], 4)]
    p = spark.createDataFrame(rows, "id string, section_title string, text string, ocr_text string, keywords array<string>, searchable int")
    assert set(ids(search(p, [SearchQuery("bm25", query_text="GASKET valve", limit=9)]))) == {"a", "b", "d"}
    whole = p.select("id", searchable(p).alias("st"))
    index = LexicalIndex(whole, "id", "st")
    for q in ("pump", "gasket valve", "none such", "", "pump title x"):
        assert {r["id"]: round(r["score"], 9) for r in index.scores(q).collect()} == {r["id"]: round(r["score"], 9) for r in bm25_scores(whole, q, "id", "st").collect()}
    assert LexicalIndex(whole.limit(0), "id", "st").scores("pump").count() == 0
