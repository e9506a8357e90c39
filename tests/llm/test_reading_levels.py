import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.reading_levels import LevelModel, graded_sample, isotonic, reading_levels, sentences

EASY = ["the cat sat on the mat", "we look at a red cup", "the dog has a new ball", "put the box on the desk"]
MIDDLE = ["the intake pump records the outlet temperature", "the valve limits the pressure during the audit", "a damaged cable delays the reply queue"]
HARD = ["the institutional standardisation of metadata vocabularies approximates conventional assumptions", "probabilistic interpretation necessitates considerable sophistication notwithstanding uncertainty"]


def document(rng, grade):
    kinds = [EASY, MIDDLE, HARD]
    return " ".join(rng.choice(kinds[grade - 1] if rng.random() < 0.85 else kinds[1]).capitalize() + "." for _ in range(10))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(1, 3)), min_size=1, max_size=40))
def test_isotonic(points):
    x, y = (np.array(c, float) for c in zip(*points))
    xs, fit = isotonic(x, y)
    assert (np.diff(xs) > 0).all() and (np.diff(fit) >= -1e-12).all()
    at = fit[np.searchsorted(xs, x)]
    assert abs((at - y).sum()) < 1e-6  # pooled means keep the sum
    assert ((at - y) ** 2).sum() <= ((y.mean() - y) ** 2).sum() + 1e-9


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    docs = [(i, document(rng, 1 + i % 3), 1 + i % 3) for i in range(240)]
    noisy = [(t, g if rng.random() > 0.05 else rng.choice((1, 2, 3))) for _, t, g in docs[:160]]
    model = LevelModel(noisy)
    rest = docs[160:]
    df = spark.createDataFrame([(i, t, 9) for i, t, _ in rest] + [(900, None, 1), (901, "", 1), (902, "too short", 1), (903, (docs[0][1] + " ") * 500, 1)], "doc_id long, text string, grade int")
    got = {r["doc_id"]: r["grade"] for r in reading_levels(df, model).collect()}
    assert sum(got[i] == g for i, _, g in rest) >= 0.9 * len(rest) and set(got) == {i for i, _, _ in rest} | {903}
    assert reading_levels(df.limit(0), model).count() == 0


def test_few_and_no_labels(spark):
    assert LevelModel([]).levels(["one two three", ""])[1][1] == 1
    assert LevelModel([("the cat sat on the mat", 1)]).levels(["the cat sat"])[0][1] in (1, 2, 3)
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 2, "x"), (1, None, "y"), (2, 1, "z"), (1, 7, "w"), (1, 3, "v")], "doc_id long, grade int, grader string")
    assert graded_sample(docs, labels) == [("a b c", 2), ("a b c", 3)]
    assert sentences("One 12, two!\nA b. Three-four five six") == [["one", "0", ",", "two"], ["three-four", "five", "six"]]
