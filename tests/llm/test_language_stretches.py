"""Every text of points and documents, every stretch of it and every request has its language and confidence."""

from collections import Counter, defaultdict

from corpusloom.llm.language_queries import p5_found, p5_segments
from corpusloom.llm.languages import tokens
from corpusloom.session import read_table


def test_all_records_have_rows(spark, sf_dir):
    got = p5_segments(spark, sf_dir)
    assert got.columns == ["record_kind", "record_key", "first", "end", "lang", "confidence"]
    whole, stretches = {}, defaultdict(list)
    for r in got.collect():
        if r["first"] is None:
            assert (r["record_kind"], r["record_key"]) not in whole
            whole[r["record_kind"], r["record_key"]] = r
        else:
            stretches[r["record_kind"], r["record_key"]].append(r)
    points = [r for r in read_table(spark, sf_dir, "points").collect() if r["text"] is not None]
    texts = {("point", r["id"]): r["text"] for r in points} | {("document", str(r["doc_id"])): r["text"] for r in read_table(spark, sf_dir, "documents").collect()}
    requests = {r["uuid"] for r in read_table(spark, sf_dir, "process_requests").collect()}
    assert set(whole) == set(texts) | {("request", u) for u in requests}
    assert any(len(t) < 40 for (kind, _), t in texts.items() if kind == "point")
    for key, text in texts.items():
        ranges = sorted((r["first"], r["end"]) for r in stretches[key])
        assert bool(ranges) == (whole[key]["lang"] is not None) == bool(tokens(text)), key
        assert not ranges or (ranges[0][0] == 0 and ranges[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))), key
    assert all(0 <= r["confidence"] <= 1 for r in whole.values() if r["lang"]) and all(0 <= r["confidence"] <= 1 for s in stretches.values() for r in s)
    votes = defaultdict(Counter)
    for p in points:
        if len(p["text"]) >= 40 and (s := stretches["point", p["id"]]):
            n = Counter()
            for r in s:
                n[r["lang"]] += r["end"] - r["first"]
            votes[p["doc_id"]][max(n, key=n.get)] += 1
    for u in requests & set(votes):
        lang, n = votes[u].most_common(1)[0]
        row = whole["request", u]
        if 2 * n > votes[u].total():
            assert row["lang"] == lang
        assert row["confidence"] <= votes[u][row["lang"]] / votes[u].total() + 1e-6
    for r in p5_found(spark, sf_dir).filter("record_kind = 'request'").collect():
        assert whole["request", r["record_key"]]["lang"] == r["lang"]
