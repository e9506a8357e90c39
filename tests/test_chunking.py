import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import chunking as C
from corpusloom.operators.prefix import previous, running_last, running_sum, with_block

CFG = C.ChunkConfig(min_chars=10, min_tokens=3, max_tokens=8, similarity=0.5, overlap=1)


def chunk(text, v=(1.0, 0.0), images=()):
    return C.Chunk(text, list(images), np.array(v, np.float32))


def test_config_defaults():
    assert C.ChunkConfig(0, -1, None, 1.0, -3).effective() == C.ChunkConfig()


def test_stable_units():
    units, n = C.stable_units("# head. 12 % . Alpha beta gamma delta. Tiny one. ?. Epsilon zeta eta theta", CFG)
    assert units == ["Alpha beta gamma delta. Tiny one.", "Epsilon zeta eta theta"]
    assert (n["n_raw"], n["n_kept"], n["n_header"], n["n_numeric"], n["n_noise"], n["n_merged"]) == (5, 2, 1, 1, 0, 1)
    assert C.stable_units("ab cd ef gh. x", CFG)[0] == ["ab cd ef gh. x"]
    assert C.stable_units("", CFG) == ([], dict.fromkeys(C.COUNTS, 0))


def test_unit_kinds():
    kinds = [C.unit_kind(s, CFG, p) for s, p in (("#x", True), ("- -", True), ("1,5 %", True), ("a b", True), ("a b", False), ("++ == ~~", False), ("one two three four", True))]
    assert kinds == ["header", "header", "numeric", "fragment", "unit", "noise", "unit"]


def test_images_go_to_the_unit_before():
    chunks, _ = C.parse_document("![a](lost.png)\nOne two three four.\n![b]( b.png ) Five six seven eight.\n![c](c.png)", CFG)
    assert [(c.text, c.images) for c in chunks] == [("One two three four.", ["b.png"]), ("Five six seven eight.", ["c.png"])]


def test_merge_repair_split_overlap():
    merged = C.merge_similar([chunk("a b c"), chunk("d e f"), chunk("g h i"), chunk("j k l", (0.0, 1.0))], CFG)
    assert [m.text for m in merged] == ["a b c d e f", "g h i", "j k l"]  # nine tokens would be too many
    repaired = C.repair_short([chunk("a"), chunk("b", (0.0, 1.0)), chunk("long enough text here"), chunk("x"), chunk("another long enough text")], CFG)
    assert [r.text for r in repaired] == ["a b long enough text here x", "another long enough text"]
    assert np.allclose(repaired[0].vector, ((np.array([0.5, 0.5]) + [1, 0]) / 2 + [1, 0]) / 2)
    assert [r.text for r in C.repair_short([chunk("a"), chunk("b")], CFG)] == ["a b"]
    pieces = C.split_long([chunk("One two three four. Five six seven. Eight nine ten.", images=["i"])], CFG)
    assert [(p.text, p.images) for p in pieces] == [("One two three four. Five six seven.", []), ("Eight nine ten.", ["i"])]
    assert len(C.split_long([chunk("one " * 20)], CFG)) == 1
    assert [c.text for c in C.overlap_sentences([chunk("A b. C d."), chunk("E f"), chunk("G.")], 1)] == ["A b. C d.", "C d. E f", "E f G."]


def test_vectors_are_checked():
    kept, zero, odd = C.valid_vectors([chunk("z", (0, 0)), chunk("a", (1, 0)), chunk("b", (1, 0, 0)), C.Chunk("n")])
    assert ([k.text for k in kept], zero, odd) == (["a"], 2, 1)


def test_documents(spark):
    docs = spark.createDataFrame([(1, "One two three four five six seven eight nine. ![i](i.png)\n\n12 13"), (2, None), (3, "  "), (1, "x" * 50_000)], "doc_id int, text string")
    got = C.chunk_documents(docs).collect()
    assert sorted((r["doc_id"], r["chunk_index"]) for r in got) == [(1, 0), (1, 0)]
    assert C.chunk_documents(docs.limit(0)).count() == 0
    assert C.unit_counts(docs).count() == 4


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("xy"), st.one_of(st.none(), st.integers(-5, 5))), max_size=25), st.integers(1, 9))
def test_running_values(spark, rows, block):
    df = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(rows)], "k string, i long, v int")
    sums = running_sum(df, ["k"], "i", F.coalesce("v", F.lit(0)), "s", block)
    lasts = {r["i"]: r["l"] for r in running_last(df, ["k"], "i", F.col("v"), "l", block).collect()}
    before = {r["i"]: r["prev_v"] for r in previous(df, ["k"], "i", ["v"], block).collect()}
    seen = {"x": [], "y": []}
    want_s, want_l, want_p = {}, {}, {}
    for i, (k, v) in enumerate(rows):
        want_p[i] = seen[k][-1] if seen[k] else None
        seen[k].append(v)
        want_s[i] = sum(x or 0 for x in seen[k])
        want_l[i] = next((x for x in seen[k][::-1] if x is not None), None)
    assert {r["i"]: r["s"] for r in sums.collect()} == want_s and lasts == want_l and before == want_p


def test_semantic_groups(spark):
    rows = [(i, v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [0.0, 2.0], [1.0, 0.0]])]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    assert [r["group_no"] for r in C.semantic_groups(df, [], "i", "v", 0.5).orderBy("i").collect()] == [0, 0, 1, 1, 2]


@pytest.mark.parametrize("p, want", [(0, 1), (50, 2), (95, 3), (100, 4)])
def test_rank_percentile(spark, p, want):
    assert spark.range(1).select(C.rank_percentile(F.array(*map(F.lit, [1, 2, 3, 4])), p)).first()[0] == want


def test_blocks_of_sparse_order_numbers(spark):
    """Hashes and times as order numbers make no more blocks than dense numbers."""
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7_919_000_003 - 10**12).alias("i"), F.lit(1).alias("v"))
    assert with_block(df, "i", 100).select("__block").distinct().count() == 10
    got = running_sum(df, ["k"], "i", F.col("v"), "s", 100)
    assert got.groupBy("k").agg((F.count_distinct("s") == F.count("*")).alias("ok"), (F.max("s") == F.count("*")).alias("all")).filter("ok AND all").count() == 3
