import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.functions.models import embed_text, generate, hash_embedding, resize_nearest
from corpusloom.operators.chunking import simple_sentences, squeeze


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("see v1.2 now.", ["see", "2 now."]), ("Hi there...", ["Hi"]), ("Hello...", ["Hello..."]), ("  ", []), ("A b. C d! E", ["A b.", "C d!", "E"]), ("a 　b.\n\nc", ["a b.", "c"]),
    ],
)
def test_simple_sentences(spark, text, want):
    assert one(spark, T.simple_sentences(F.col("t")), t=text) == want == simple_sentences(text)


@pytest.mark.parametrize("text, header, numeric", [("# a", True, False), ("---", True, False), (" ", False, False), ("12.5 %", False, True), ("(3)", False, True), ("a1", False, False), ("...", False, False)])
def test_flags(spark, text, header, numeric):
    assert one(spark, T.is_header(F.col("t")), t=text) is header
    assert one(spark, T.is_numeric(F.col("t")), t=text) is numeric


def test_intent_and_overlap(spark):
    assert one(spark, T.overlap_text(F.col("t")), t=" Xin CHÀO,\tbạn (đó)! ") == "xin chao ban do"
    assert one(spark, T.overlap_ratio(F.col("a"), F.col("b")), a="one two", b="two three four") == 0.5
    assert one(spark, T.overlap_ratio(F.col("a"), F.col("b")), a="", b="x") == 0


@pytest.mark.parametrize("url, name", [("https://x.y/a/b.pdf?q=1", "b.pdf"), ("file:///tmp/c.md", "c.md"), ("https://x.y/", "downloaded_file"), ("d/e.txt", "e.txt"), (" ", "downloaded_file")])
def test_file_name(spark, url, name):
    assert one(spark, T.file_name(F.col("u")), u=url) == name


def test_object_key_and_session_ids(spark):
    assert one(spark, T.object_key(F.col("f"), F.col("u")), f="a/b/", u="https://h/x/y.png") == "b/y.png"
    assert [one(spark, T.is_safe_session_id(F.col("s")), s=s) for s in ("ok", "a/b", "..", " ", "a\\b")] == [True, False, False, False, False]


def test_time_progress_backoff(spark):
    assert one(spark, T.parse_rfc3339(F.col("s")), s="2026-03-28 12:00:00") is None
    assert one(spark, T.rfc3339(T.parse_rfc3339(F.col("s"))), s="2026-03-28T12:00:00Z") == "2026-03-28T12:00:00Z"
    assert one(spark, T.progress_bar(F.col("a"), F.col("b"), 8), a=3, b=8) == "[###-----] 37.5%"
    assert one(spark, T.progress_bar(F.col("a"), F.col("b"), 4), a=3, b=0) == "[----] 0.0%"
    assert [one(spark, T.backoff_ms(F.lit(300.0), F.col("n")), n=n) for n in (1, 2, 9)] == [300.0, 600.0, 5000.0]


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    df = spark.range(1).select(*[F.round(V.score(a, b, d), 6).alias(d) for d in V.DISTANCES], V.is_zero(F.array(F.lit(0.0))).alias("z"), V.cosine(a, F.array(F.lit(1.0))).alias("odd"))
    assert list(df.first()) == [0.96, 24.0, 1.414214, 2.0, True, None]
    with pytest.raises(ValueError):
        V.score(a, b, "EUCLID")


def test_models(spark):
    df = spark.createDataFrame([("one two",), ("one two",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(embed_text(16)("t")).collect()]
    assert got[0] == got[1] and abs(sum(x * x for x in got[0]) - 1) < 1e-6 and not any(got[2]) and not any(got[3])
    assert hash_embedding(["x"]).shape == (1, 64)
    assert [r[0] for r in df.select(generate(str.upper)("t")).collect()] == ["ONE TWO", "ONE TWO", None, ""]


def test_resize():
    assert resize_nearest(bytes(range(4)), 2, 2, 1, 4, 4) == bytes([0, 0, 1, 1, 0, 0, 1, 1, 2, 2, 3, 3, 2, 2, 3, 3])
    assert resize_nearest(b"", 0, 0, 3, 2, 1) == bytes(6)


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab.!? \n ", max_size=40))
def test_squeeze_is_idempotent(t):
    assert squeeze(squeeze(t)) == squeeze(t) and "  " not in squeeze(t)
