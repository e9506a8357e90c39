import random

import pyarrow as pa
import pytest

from corpusloom.llm import scans
from corpusloom.llm.scans import _Marks, corrections, folded, in_sequence, is_page_number, learnt_confusions, page_value, repair_scans, repaired, scan_decisions, vocabulary

BODY = ["the pump feeds the cool-", "ing loop and the valve", "stops the motor at night.", "3.1 Details", "12 13 14", "A real-", "time clock ru1es here."]


def page(n, title, body):
    return "\n".join([f"{title} Handbook 7", *body, "", f"- {n} -"])


@pytest.fixture(scope="module")
def tables(spark):
    names = ["Alpha", "Bravo", "Carol", "Delta", "Eagle", "Fargo", "Gamma", "Hotel"]
    rows = [(f"p{i}", "ocr_text", page(1, n, BODY) + "\n" + page(2, n, ["and it goes on."])) for i, n in enumerate(names * 3)]
    rows += [("null", "ocr_text", None), ("empty", "text", ""), ("p0", "text", "plain line of text."), ("more", "text", "open the va1ve.")]
    scanned = spark.createDataFrame([(i, f, t, 1) for i, f, t in rows], "id string, field_name string, text string, line_no int")
    clean = spark.createDataFrame([("the pump feeds the cooling loop and the valve stops the motor at night. A real-time clock rules here.",)] * 5 + [(None,)], "text string")
    return scanned, clean


def test_page_numbers_and_folding():
    assert all(map(is_page_number, ("3", "- 12 -", "[4]", "Page 1 of 240", "p. 2", "xiv", "iv")))
    assert not any(map(is_page_number, ("", "1 2 3", "3.1 x", "civil", "12.", "mix it")))
    assert folded("Rep0rt") == folded("report") and folded("42") == "0" and folded("Fie1d") == folded("field")


def test_corrections():
    usual = [("1", "l"), ("!", "i"), ("0", "o"), ("cl", "d")]
    assert "rules" in [w for w, _ in corrections("ru1es", usual)] and ("limits", 1) in list(corrections("l!mits", usual))
    assert "report" in [w for w, _ in corrections("rep0rt", usual)] and "resultado" in [w for w, _ in corrections("resultaclo", usual)]


def test_confusions_are_learnt(spark):
    right = ["valve", "motor", "cooling", "bearing", "pressure", "outlet", "sensor", "gateway", "schedule", "modern", "corner", "internal"]
    wrong = [w.replace("o", "0") for w in right if "o" in w] + [w.replace("rn", "m") for w in right if "rn" in w] + ["kestanox", "brekuvane", "wexdolon"]
    got = learnt_confusions(spark.createDataFrame([(w,) for w in wrong], "word string"), spark.createDataFrame([(w, 9) for w in right], "word string, n long"))
    assert set(got) == {("0", "o"), ("m", "rn")}
    assert learnt_confusions(spark.createDataFrame([], "word string"), spark.createDataFrame([], "word string, n long")) == []


def test_decisions(tables):
    scanned, clean = tables
    got = {(r["id"], r["field_name"], r["line_no"], r["kind"]) for r in scan_decisions(scanned, clean).collect()}
    lines = dict.fromkeys(["p0"], [])
    assert lines and {(n, k) for i, f, n, k in got if (i, f) == ("p3", "ocr_text")} == {
        (1, "furniture"), (10, "furniture"), (11, "furniture"), (14, "furniture"), (2, "hyphen"), (8, "misread")}
    assert not [g for g in got if g[:2] in (("null", "ocr_text"), ("empty", "text"), ("p0", "text"))]


def test_repair(tables):
    scanned, clean = tables
    d = scan_decisions(scanned, clean)
    got = {(r["id"], r["field_name"]): r["repaired"] for r in repair_scans(scanned, d).collect()}
    assert got["p1", "ocr_text"] == "the pump feeds the cooling loop and the valve stops the motor at night.\n\n3.1 Details\n\n12 13 14\n\nA real-time clock rules here.\n\nand it goes on."
    assert got["empty", "text"] == "" and ("null", "ocr_text") not in got
    assert repaired("a b\nc", []) == "a b c" and repaired("東\n京", []) == "東京"


def test_empty_tables(tables):
    scanned, clean = tables
    assert scan_decisions(scanned.limit(0), clean).count() == 0
    assert scan_decisions(scanned, clean.limit(0)).filter("kind = 'misread'").count() == 0
    assert not any(_Marks([(set(), set())]).marks(["some line of text"]))


def test_numbers_of_the_content_stay():
    marks = _Marks([(set(), set())]).marks
    assert not any(marks(["Results by year", "2024", "were better than before", "The end"], 3))
    assert not any(marks(["Table", "1500", "I", "III", "5", "of all"], 40))
    assert [page_value(x) for x in ("Page 12 of 30", "[7]", "xiv", "p. 3")] == [("d", 12), ("d", 7), ("r", 14), ("d", 3)]
    assert marks(["a b c.", "7", "goes on here."], 7) == [False, True, False]
    assert in_sequence(["x", "11", "y", "1500", "z", "12"], [1, 3, 5], [False] * 6, None, ()) == {1, 5}


def synthetic(n_docs, n_pages):
    r, rows, truth, content = random.Random(5), [], set(), set()
    words = "pump valve table module index vector cooling bearing panel cable gateway filter sensor record schedule".split()
    for d in range(n_docs):
        name = " ".join("".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(7)).capitalize() for _ in range(3))
        first = r.randint(1, 300)
        for p in range(1, n_pages + 1):
            body = [" ".join(r.choice(words) for _ in range(9)) + r.choice(["", " and", "."]) for _ in range(12)]
            header = name.replace("a", "o", 1) if r.random() < 0.15 else name
            lines = [header, *body[:6], *(["Results by year", "1500", "were better"] if d % 5 == 0 else []), *body[6:], str(p + first)]
            i = f"{d}-{p}"
            truth |= {(i, 1), (i, len(lines))}
            content |= {(i, 9)} if d % 5 == 0 else set()
            rows.append((i, "ocr_text", f"doc{d}", p, "\n".join(lines)))
    return rows, truth, content, " ".join(words)


@pytest.mark.parametrize("n_docs", [20, 400])
def test_headers_of_few_and_of_many_documents(spark, n_docs):
    rows, truth, content, words = synthetic(n_docs, 10)
    scanned = spark.createDataFrame(rows, "id string, field_name string, doc string, page int, text string")
    clean = spark.createDataFrame([(words,)] * 3, "text string")
    got = {(r["id"], r["line_no"]) for r in scan_decisions(scanned, clean).filter("kind = 'furniture'").collect()}
    assert len(got & truth) >= 0.95 * len(truth) and not got & content
    # Without documents lines that recur unchanged are still told.
    got = {(r["id"], r["line_no"]) for r in scan_decisions(scanned.drop("doc", "page"), clean).filter("kind = 'furniture'").collect()}
    assert sum(k in got for k in truth if k[1] == 1) >= 0.95 * len(truth) / 2


@pytest.mark.parametrize("sent", [None, 0])
def test_only_few_misread_words_are_broadcast(tables, monkeypatch, sent):
    """Words grow with the corpus, and more so in Python, which Spark's sizes don't tell: the driver would have to hold them."""
    scanned, clean = tables
    right = {tuple(r) for r in scan_decisions(scanned, clean).collect()}
    plans, write = {}, scans.written
    monkeypatch.setattr(scans, "written", lambda df, name: plans.update({name: df}) or write(df, name))
    if sent is not None:
        monkeypatch.setattr(scans, "SENT_WORDS", sent)
    out = scan_decisions(scanned, clean)
    joins = {name: df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") for name, df in (plans | {"out": out}).items()}
    assert {k: joins[k] for k in ("asked", "readings", "misread", "out")} == {"asked": 0, "readings": 0, "misread": 0, "out": int(sent is None)}
    assert {tuple(r) for r in out.collect()} == right


def test_vocabulary_takes_texts_apart_once(spark):
    texts = spark.createDataFrame([("Low-noise low-noise\nA  b's x--y l'eau-vive ΣΑΣ ",), ("low, low-noise. 東京 -a- 1st",), ("",), (None,)], "text string")
    got = vocabulary(texts)
    assert {r["word"]: r["n"] for r in got.collect()} == {
        "low-noise": 3, "low": 4, "noise": 3, "a": 2, "b's": 1, "x": 1, "y": 1, "l'eau-vive": 1, "l'eau": 1, "vive": 1, "σας": 1, "東京": 1, "1st": 1}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_lines_of_the_content_are_not_masked(monkeypatch):
    """Only lines whose words stand in a usual wording, but for two, are masked level by level."""
    asked, key = [], scans.line_key
    monkeypatch.setattr(scans, "line_key", lambda tokens, words: asked.append(tokens) or key(tokens, words))
    fixed = {folded(w) for w in "the handbook of pump and valve stops motor".split()}
    wording = " ".join(folded(w) for w in ("the", "handbook", "of")) + " *"
    marks = _Marks([(fixed, {wording}), (fixed, {wording})]).marks
    assert marks(["the valve stops the motor and pump"] * 3) == [False] * 3 and not asked
    assert marks(["The Handbook of Kestanox", "the valve stops the motor and pump"]) == [True, False] and asked


def test_usual_keys_are_those_of_each_level():
    rows = [(["a", "b", "0"], True), (["a", "x", "0"], False), (["a", "x", "0"], True), (["x", "y", "z"], True), (["0"], True), (["a", "b", "x", "y"], True)]
    levels = [{"a", "b"}, {"a"}, set()]
    right = {}
    for tokens, edge in rows:
        for level, fixed in enumerate(levels):
            if (k := scans.line_key(tokens, fixed)) is not None:
                e, n = right.get((level, k), (0, 0))
                right[level, k] = (e + edge, n + 1)
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([e for _, e in rows])], ["tokens", "edge"])
    (got,) = scans._usual_keys(levels)([batch])
    assert {(r["level"], r["key"]): (r["e"], r["n"]) for r in got.to_pylist()} == right and right[1, "a * 0"] == (2, 3)


def test_quick_looks_at_lines_lose_nothing():
    r = random.Random(3)
    signs = ["7", "12", "3.1", "|", ".", ",", " ", "  ", "\t", " ", "Pump", "a", ")", "”", "?", "。", "-", "¬", "²", "٣", "　", "n", "'", "’", "x's", "é", "東"]
    for _ in range(4_000):
        line = "".join(r.choices(signs, k=r.randint(1, 7)))
        tokens = [folded(t) for t in scans._KEY_TOKEN.findall(scans._OUTER_NUMBER.sub("", line))]
        assert scans.key_tokens(line) == tokens
        may = 0 < len(tokens) <= 9 and not scans._ROW.match(line) and not scans._HEADING.match(line) and not (scans._TERMINAL.search(line) or line.rstrip()[-1:] in scans.BREAKS)
        assert scans._may_run(line, tokens) == may
        (got,) = scans._line_rows(lambda lines, page, known: [False] * len(lines))([pa.RecordBatch.from_arrays([pa.array([v]) for v in (1, "text", 1, [0], line)], ["id", "field_name", "page", "known", "text"])])
        found, bare = list(scans._TOKEN.finditer(line)), bool(scans._CJK.search(line))
        ends = [(j == 0 and not line[: m.start()].strip()) or (j == len(found) - 1 and not line[m.end() :].strip(" " + scans.BREAKS)) for j, m in enumerate(found)]
        inner = [m.group().lower() for m, end in zip(found, ends) if not (end and bare)]
        assert got.column("words").to_pylist() == ([inner] if inner else [])


def test_only_forms_that_recur_in_their_document_move_on(tables, monkeypatch):
    scanned, clean = tables
    seen, write = {}, scans.written
    monkeypatch.setattr(scans, "written", lambda df, name: seen.update({name: write(df, name)}) or seen[name])
    rows = [(f"{d}{p}", "ocr_text", d, p, f"{d} Handbook\nquite other w{'abcdefgh'[p]}{d} words\nbody text here.") for d in ("Alpha", "Bravo") for p in range(1, 6)]
    got = scan_decisions(scanned.sparkSession.createDataFrame(rows, "id string, field_name string, doc string, page int, text string"), clean).filter("kind = 'furniture'")
    assert {(r["id"], r["line_no"]) for r in got.collect()} == {(i, 1) for i, *_ in rows} | {(i, 2) for i, *_ in rows}
    assert {r["key"].count("*") for r in seen["forms"].select("key").filter(f"key LIKE '{folded('quite')}%'").collect()} == {1} and seen["forms"].count() < seen["edges"].selectExpr("explode(keys)").count()
