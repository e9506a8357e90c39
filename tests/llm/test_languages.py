import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm.languages import LANGUAGES, ByteModels, Scorer, detect_languages, label_language, languages_held, tokens, train, training_sample, units

TEXTS = {
    "en": "The pump feeds the cooling loop. A short report describes the wiring of the panel. However, the valve stops the motor at night.",
    "de": "Die Pumpe versorgt den Kühlkreislauf. Ein kurzer Bericht beschreibt die Verdrahtung. Das Ventil stoppt jedoch den Motor in der Nacht.",
    "fr": "La pompe alimente le circuit de refroidissement. Un bref rapport décrit le câblage du panneau. Cependant, la soupape arrête le moteur la nuit.",
    "es": "La bomba alimenta el circuito de refrigeración. Un informe breve describe el cableado del panel. Sin embargo, la válvula para el motor de noche.",
    "vi": "Máy bơm cấp nước cho vòng làm mát. Một báo cáo ngắn mô tả dây điện của bảng. Tuy nhiên, van dừng động cơ vào ban đêm.",
    "zh": "水泵为冷却回路供水。一份简短的报告描述了接线图。但是阀门在夜里停止电机。",
    "ja": "ポンプは冷却回路に水を送ります。短い報告書は配線図を説明します。しかし、弁は夜にモーターを止めます。",
    "hi": "पंप शीतलन परिपथ को पानी देता है। एक छोटी रिपोर्ट तारों का नक्शा बताती है। लेकिन वाल्व रात में मोटर रोकता है।",
}


@pytest.fixture(scope="module")
def models():
    return train([(k, t) for k, t in TEXTS.items()] * 3)


def test_labels(spark):
    cases = [("en", "en"), (" EN\n", "en"), ("en_GB", "en"), ("zh-Hans", "zh"), ("deu", "de"), ("ger", "de"), ("Vietnamese", "vi"), ("　fra ", "fr"), ("und", None), ("unknown", None), ("", None), (None, None), ("xx", None), ("english-x", "en")]
    df = spark.createDataFrame(cases, "label string, want string")
    assert all(r[0] == r[1] for r in df.select(label_language(F.col("label")), "want").collect())


def test_units_lose_nothing():
    for t in [*TEXTS.values(), "v1.2 of x. y!!\n\n- a\n- b", "", "...", "a\n"]:
        assert "".join(units(t)) == t
    assert tokens("Ab c1d 東京") == ["ab", "c", "d", "\0東", "東京"]


def test_code_lengths_are_a_distribution():
    """Over all next bytes behind the same context the chances never sum to more than one."""
    m = ByteModels({"en": {"abab": 3, "abc": 1}, "de": {"b": 1}})
    one = m.bits(["ab", "ac"])
    assert one.shape == (2, len(LANGUAGES) + 1) and one[0, 0] < one[1, 0]
    assert np.isfinite(one).all()
    bits = m.bits([f"a{chr(c)}" for c in range(97, 123)])[:, 0] - 0.0
    assert (2.0 ** -bits).sum() <= 1.0


def test_each_language_and_mixtures(models):
    s = Scorer(models)
    got = s.texts([*TEXTS.values(), TEXTS["en"] + " " + TEXTS["zh"] + TEXTS["en"], "", "12 34", TEXTS["de"] + "\nPage 3 of 9"])
    assert [LANGUAGES[m] for m, _, _ in got[:8]] == list(TEXTS)
    mixed = got[8][2]
    assert [LANGUAGES[m] for _, _, m, _, _ in mixed] == ["en", "zh", "en"] and all(w for *_, w in mixed)
    assert mixed[0][0] == 0 and all(a[1] == b[0] for a, b in zip(mixed, mixed[1:])) and 0.99 < mixed[1][3] <= 1
    assert got[9][:1] == (-1,) and got[10][0] == -1
    assert {LANGUAGES[m] for _, _, m, _, w in got[11][2] if w} == {"de"}


def test_a_mislabelled_text_does_not_spoil_its_label():
    m = train([(k, t) for k, t in TEXTS.items()] * 4 + [("de", TEXTS["en"])])
    assert LANGUAGES[Scorer(m).texts([TEXTS["en"]])[0][0]] == "en"


def test_table(spark, models):
    rows = [("a", TEXTS["fr"]), ("b", None), ("c", ""), ("a", TEXTS["fr"]), ("d", (TEXTS["en"] + " ") * 300), (None, TEXTS["hi"])]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "key string, text string, lang string")
    found = detect_languages(df, models)
    got = sorted((str(r["key"]), r["lang"], r["held"]) for r in found.withColumn("held", languages_held(found)).collect())
    assert [(k, lang) for k, lang, _ in got] == [("None", "hi"), ("a", "fr"), ("a", "fr"), ("b", None), ("c", None), ("d", "en")]
    assert got[0][2] == ["hi"] and got[3][2] == []
    assert detect_languages(df.limit(0), models).count() == 0
    sample = training_sample(spark.createDataFrame([("k1", TEXTS["en"], "English"), ("k2", TEXTS["de"], None), ("k3", None, "de")], "key string, text string, label string"))
    assert sample == [("en", TEXTS["en"])]
    assert training_sample(df.limit(0).withColumn("label", F.lit("en"))) == []
