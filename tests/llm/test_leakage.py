import random

from corpusloom.llm import leakage
from corpusloom.llm.leakage import leaked_items, words

DOCS, ITEMS = "doc_id long, text string, item_id int, share int", "item_id int, text string, doc_id string"


def brute(docs, items, width):
    out = set()
    for i, t in items:
        a = words(t or "")
        grams = {tuple(a[k : k + width]) for k in range(len(a) - width + 1)}
        for d, u in docs:
            b = words(u or "")
            if any(tuple(b[k : k + width]) in grams for k in range(len(b) - width + 1)):
                out.add((d, i))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, 1, 2) for d, t in docs], DOCS), spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)


def cases():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)] + ["Ärger", "東京", "x_y"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 25)))) for i in range(20)] + [(98, None), (99, "")]
    docs = []
    for d in range(60):
        ws = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if d % 2:
            source = (rng.choice(items[:20])[1]).split()
            a = rng.randrange(len(source))
            ws[len(ws) // 2 : len(ws) // 2] = [w.upper() for w in source[a : a + rng.randint(1, 20)]]
        docs.append((d, ", ".join(ws)))
    return docs + [(100, None), (101, ""), (1, docs[1][1])], items


def test_against_brute_force(spark, monkeypatch):
    docs, items = cases()
    d, i = frames(spark, docs, items)
    for width in (1, 5, 15):
        want = brute(docs, items, width)
        got = leaked_items(d, i, width=width)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
        with monkeypatch.context() as m:
            m.setattr(leakage, "MOST_WORDS", 0)  # the way of many windows
            assert {(r["doc_id"], r["item_id"]) for r in leaked_items(d, i, width=width).collect()} == want


def test_share(spark):
    text = " ".join(f"t{k}" for k in range(20))
    d, i = frames(spark, [(1, "x " + " ".join(f"T{k}" for k in range(2, 18)) + " y")], [(7, text)])
    assert [tuple(r) for r in leaked_items(d, i).collect()] == [(1, 7, 16, 0.8)]
    assert leaked_items(d.limit(0), i).count() == 0 and leaked_items(d, i.limit(0)).count() == 0
