import collections

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.packing import TOKENIZERS, fit_repeats, load_encoding, pack_texts, patterns, plan_packs


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), max_size=20))
def test_plan_places_every_item(histogram):
    plan = plan_packs(histogram, 40)
    placed = collections.Counter()
    for kind, n in plan:
        assert n > 0 and sum(kind) <= 40
        for s in kind:
            placed[s] += n
    assert placed == collections.Counter(histogram)
    # Never worse than first fit by more than its known bound on the least possible number.
    assert sum(n for _, n in plan) <= 2 * -(-sum(s * n for s, n in histogram.items()) // 40) + 1


def test_patterns_and_fit():
    one, two, three = patterns(10, np.array([2, 3, 4, 5, 7]))
    assert len(one) == 0 and sorted(map(tuple, two)) == [(3, 7), (5, 5)] and sorted(map(tuple, three)) == [(2, 3, 5), (2, 4, 4), (3, 3, 4)]
    h = np.zeros(11)
    h[[3, 7, 5]] = 6, 6, 8
    x = fit_repeats(patterns(10, np.array([3, 5, 7])), h)
    assert np.allclose([v for g in x for v in g], [6, 4], atol=1e-3)


def test_a_perfect_histogram_wastes_nothing():
    assert sum(n for _, n in plan_packs({3: 60, 7: 60, 5: 40, 10: 7}, 10)) == 87


@pytest.mark.skipif(not __import__("os").path.exists(TOKENIZERS), reason="no tokenizers here")
def test_table(spark):
    enc = load_encoding()
    texts = ["one two three", "", None, "word " * 100, "<|endoftext|> x", "字" * 30, "a", "a", "a b"]
    df = spark.createDataFrame([(i if i < 8 else 7, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = pack_texts(df, "doc_id", "text", capacity=16).collect()
    sizes, used = collections.Counter(), collections.Counter()
    for r in got:
        sizes[r["id"]] += r["n_tokens"]
        used[r["sequence_id"]] += r["n_tokens"]
    want = collections.Counter()
    for i, t in enumerate(texts):
        if t is not None:
            want[i if i < 8 else 7] += len(enc.encode_ordinary(t))
    assert sizes == want and max(v for k, v in used.items() if k is not None) <= 16
    assert [r["sequence_id"] for r in got if r["n_tokens"] == 0] == [None]
    parts = sorted((r["part_no"], r["first_token"], r["n_tokens"]) for r in got if r["id"] == 3)
    assert [p[1] for p in parts] == [16 * k for k in range(len(parts))] and all(p[2] == 16 for p in parts[:-1])
    assert len({(r["sequence_id"], r["slot"]) for r in got if r["n_tokens"]}) == sum(r["n_tokens"] > 0 for r in got)
    assert pack_texts(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        pack_texts(df, "doc_id", "text", capacity=0)


def test_long_sequences_are_planned_in_bounds():
    import resource

    rng = np.random.default_rng(1)
    sizes, counts = np.unique(np.minimum(4095, rng.lognormal(6.3, 1.0, 200_000).astype(int) + 1), return_counts=True)
    plan = plan_packs(dict(zip(sizes.tolist(), counts.tolist())), 4096)
    n, tokens = sum(k for _, k in plan), int((sizes * counts).sum())
    assert tokens / (n * 4096) > 0.97
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1_500_000


@pytest.mark.skipif(not __import__("os").path.exists(TOKENIZERS), reason="no tokenizers here")
def test_one_size_holds_most_rows(spark, monkeypatch):
    import corpusloom.llm.packing as P

    monkeypatch.setattr(P, "RANKED_AT_ONCE", 7)
    df = spark.createDataFrame([(i, "a b c" if i % 3 else "word " * 40) for i in range(120)], "doc_id long, text string")
    got = pack_texts(df, "doc_id", "text", capacity=8).collect()
    used = collections.Counter()
    for r in got:
        used[r["sequence_id"]] += r["n_tokens"]
    assert max(used.values()) == 8 and sorted(used) == list(range(len(used)))
    assert len({(r["sequence_id"], r["slot"]) for r in got}) == len(got)
