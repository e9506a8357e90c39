import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.near_duplicates import BINS, SimilarTexts, bucket_pairs, components, normalised, shingles, sketches


def plain(text):
    return "".join(c for c in text.lower() if c.isalnum())


def similarity(a, b, width=5):
    x, y = ({t[i : i + width] for i in range(max(1, len(t) - width + 1))} for t in (plain(a), plain(b)))
    return len(x & y) / len(x | y)


def brute(rows, threshold):
    usable = [(i, t) for i, t in rows if i is not None and t is not None and len(t) >= 40 and plain(t)]
    return {tuple(sorted((i, j))) for k, (i, a) in enumerate(usable) for j, b in usable[k + 1 :] if i != j and similarity(a, b) >= threshold}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abÄ1é́-. 字", max_size=30), max_size=6))
def test_normalising_and_shingles(texts):
    codes, starts = normalised(texts)
    assert ["".join(map(chr, codes[a:b])) for a, b in zip(starts, starts[1:])] == [plain(t) for t in texts]
    h, of = shingles(codes, starts, 5)
    for i, t in enumerate(texts):
        p = plain(t)
        want = len({p[k : k + 5] for k in range(max(1, len(p) - 4))}) if p else 0
        assert (of == i).sum() == want == len(set(h[of == i].tolist()))


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 200, 200))
    h = np.concatenate([shared, a, shared, b, a[:1]])
    of = np.concatenate([np.zeros(800, int), np.ones(800, int), [3]])
    s = sketches(h, of, 4)
    assert (s[[0, 1, 3]] != 2**64 - 1).all() and (s[2] == 2**64 - 1).all() and s.shape == (4, BINS)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.08


def test_bucket_pairs():
    keys = np.array([[1 << 16 | 100, 7], [1 << 16 | 100, 9], [1 << 16 | 5000, 8], [2 << 16 | 100, 7], [1 << 16 | 100, 7]], np.uint64)
    assert {(int(x), int(y)) for a, b in bucket_pairs(keys, 0.7) for x, y in zip(a, b)} == {(7, 9)}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(60):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(8, 60)))
        rows.append((f"a{i}", t))
        for k in range(rng.randint(0, 3)):
            ws = t.split()
            for _ in range(rng.randint(0, 2)):
                ws[rng.randrange(len(ws))] = rng.choice(words)
            rows.append((f"a{i}-{k}", " ".join(ws).upper()))
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1] + "!!"), ("null", None), (None, rows[0][1]), ("empty", ""), ("marks", "-" * 80), ("short", "a" * 39), ("copy1", rows[0][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id string, text string, text_id string, similarity int")
    got = {(r["id_a"], r["id_b"]) for r in SimilarTexts(df, "id", "text", 0.7).pairs().collect()}
    want = brute(rows, 0.7)
    close = brute(rows, 0.78)
    assert close <= got <= want


def test_long_and_empty(spark):
    long = "lorem ipsum dolor " * 5000
    df = spark.createDataFrame([("a", long + "one"), ("b", long + "two"), ("c", "other words entirely " * 4)], "id string, text string")
    assert [tuple(r) for r in SimilarTexts(df, "id", "text", 0.7).pairs().collect()] == [("a", "b")]
    assert SimilarTexts(df.limit(0), "id", "text", 0.7).pairs().count() == 0
    with pytest.raises(ValueError):
        SimilarTexts(df, "id", "text", 0.2)


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(40)]
    loose = [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)]
    links = chain + loose
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["text_id"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from it "
    rows = [("a", base * 2 + "one"), ("b", base * 2 + "two"), ("c", base * 2 + "one"), ("d", "something else entirely, long enough to have a place here"), ("e", None)]
    got = {r["id"]: (r["group_id"], r["n_links"]) for r in SimilarTexts(spark.createDataFrame(rows, "id string, text string"), "id", "text", 0.7).groups().collect()}
    assert got == {"a": ("a", 1), "b": ("a", 1), "c": ("a", 1), "d": ("d", 0)}
