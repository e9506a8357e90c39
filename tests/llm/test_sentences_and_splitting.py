import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.sentences import Lexicon, collection_lexicon, sentence_rows, split_sentences
from corpusloom.llm.splitting import TOKEN, n_tokens, oversized, pieces, split_oversized

LEX = Lexicon()
CASES = [
    ["The answer is ... unclear.", "Wait... the pump stops.", "config.yaml holds the limits.", "pH drops below 3.", "126 bolts hold it."],
    ["No. 173 vs. No. 186 is usual.", "See Fig. 384 for it.", "The U.S. edition lists 2 pages.", "It is wide (approx. 77.64 in.) now."],
    ["The parts (cf. Sec. 108.2) arrive at approx. 8 a.m. each day.", "Bring bolts, nuts, etc.", "The pump stops.", "Really?!", "(Both hoses are spare.)", "It ends."],
    ['"Is it ready?" asks the panel.', 'The log says "done." and nothing else.', "Does it run (really?) without it?", "Use a clamp (e.g. type B or C)."],
    ["Das gilt z. B. für die u. a. Bauteile.", "„Ist es bereit?“, fragt die Anzeige.", "Fragte sie: „Warum jetzt?“", "Nein."],
    ["« Est-il prêt ? » demande le panneau.", "La note dit : « Ne pas ouvrir. »", "Arrêtez le moteur !", "¡Cuidado!", "Véase la fig. 2 (p. ej. el eje) aquí."],
    ['Nhật ký ghi: "Không được mở."', "Khoan đã... Mirpe cần 107 giây.", "Hãy mang bu lông, v.v.", "Dịch vụ dừng."],
]
SOLID = [
    ["他问：“为什么？”", "实际上，它停了。", "“准备好了吗？”屏幕显示。", "见图3.1（备用件！）的说明。", "（都是备件。）", "真的吗？！"],
    ["「開けないでください。」と記録にあります。", "少し待って……あと235秒です。", "値は1.5から2.0に上がりました。"],
]


@pytest.mark.parametrize("want, glue", [(c, " ") for c in CASES] + [(c, "") for c in SOLID] + [(["रुकिए... उसे समय चाहिए।", '"मत खोलो!" पैनल कहता है।', "क्या यह तैयार है?"], " ")])
def test_boundaries(want, glue):
    text = glue.join(want)
    assert [text[a:b] for a, b in split_sentences(text, LEX)] == want


def test_paragraphs_and_edges():
    text = "Heading 1\n\nFirst line\ngoes on. Second.The third one　\n \t\n tail without end \n"
    assert [text[a:b] for a, b in split_sentences(text, LEX)] == ["Heading 1", "First line\ngoes on.", "Second.", "The third one", "tail without end"]
    assert split_sentences(None, LEX) == split_sentences(" \n", LEX) == split_sentences("", LEX) == []
    long = "One two three. " * 20_000
    assert len(split_sentences(long, LEX)) == 20_000


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='ab A.?!"()“”«» \n。字…1', max_size=60))
def test_spans_are_ordered_and_cover(text):
    spans = split_sentences(text, LEX)
    assert all(a < b for a, b in spans) and all(p[1] <= q[0] for p, q in zip(spans, spans[1:]))
    inside = {k for a, b in spans for k in range(a, b)}
    assert all(c.isspace() for k, c in enumerate(text) if k not in inside)


def test_lexicon_and_table(spark):
    rows = [(1, "See Fig. 5 of it. It ends.\n\niPhone starts this."), (2, None), (3, " "), (1, "One. Two.")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "chunk_id long, text string, end_pos int")
    got = sentence_rows(df, "chunk_id", "text")
    assert sorted((r["id"], r["end_pos"]) for r in got.collect()) == [(1, 4), (1, 9), (1, 17), (1, 26), (1, 47)]
    assert sentence_rows(df.limit(0), "chunk_id", "text").count() == 0
    many = spark.createDataFrame([("It is zzq. nine here. The pump ends.",)] * 80 + [("lower begins.",)] * 3, "text string")
    lex = collection_lexicon(many)
    assert lex.closing("zzq") < -3 and lex.closing("ends") == 2.0 and "lower" in lex.openers


def test_abbreviations_are_learnt_and_unlearnt(spark):
    rows = ["He met Gen. Grant there. They left.\n\nAnother ends here."] * 30 + ["The shop opens at 5 p.m. Tomorrow is fine.\n\nWe meet at 6 p.m."] * 80
    lex = collection_lexicon(spark.createDataFrame([(t,) for t in rows], "text string"))
    assert [("Use Gen. Grant.")[a:b] for a, b in split_sentences("Use Gen. Grant.", lex)] == ["Use Gen. Grant."]
    text = "It ends at 5 p.m. Tomorrow is fine."
    assert [text[a:b] for a, b in split_sentences(text, lex)] == ["It ends at 5 p.m.", "Tomorrow is fine."]
    # The same shares tell the same in a larger collection.
    assert lex.openers == collection_lexicon(spark.createDataFrame([(t,) for t in rows * 5], "text string")).openers == frozenset()


@pytest.mark.parametrize("n", [1, 3, 5, 6, 20, 200])
@pytest.mark.parametrize("left, right", ['""', "“”", "()", "«»", "„“"])
def test_no_cut_inside_what_a_sentence_goes_on_around(n, left, right):
    inner = " ".join(["The pump stops here."] * n)
    want = ["One stands before.", f"He said {left}{inner}{right} and left.", "It ends."]
    text = " ".join(want)
    assert [text[a:b] for a, b in split_sentences(text, LEX)] == want


def test_what_does_not_close_binds_nothing():
    for text in ('The 5" pipe fits. It is long. A 6" pipe fits too. It ends.', "It is ( open. It ends here. No more.", "1) First it is. 2) Then that. It ends."):
        assert len(split_sentences(text, LEX)) >= 3


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["Aa bb cc. ", "字字字。", "word ", "# Head\n\n", "\n\n", "Long one two three four five six seven. "]), max_size=25), st.integers(1, 12), st.integers(0, 3))
def test_pieces_fit_and_lose_nothing(parts, limit, overlap):
    text = "".join(parts)
    got = pieces(text, limit, overlap, LEX)
    assert "".join(text[p["first"] : p["end"]] for p in got) == text
    assert all(n_tokens(text[p["shared"] : p["end"]]) == p["size"] <= limit for p in got)
    assert all(q["shared"] <= q["first"] for q in got)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab c.é́字 \n", max_size=80), st.integers(1, 9), st.integers(0, 2))
def test_pieces_in_characters(text, limit, overlap):
    got = pieces(text, limit, overlap, LEX, "characters")
    assert "".join(text[p["first"] : p["end"]] for p in got) == text
    assert all(p["end"] - p["shared"] == p["size"] <= limit for p in got)


def test_characters_are_the_last_level():
    got = pieces("short " + "x" * 25, 10, 0, LEX, "characters")
    assert [p["level"] for p in got][:2] == [3, 4] and max(p["size"] for p in got) == 10
    assert {p["level"] for p in pieces("word " * 9, 4, 0, LEX)} == {0, 3}


def test_oversized_and_kinds(spark):
    chunks = spark.createDataFrame(
        [(1, "One two three. Four five six.", 1, 0), (2, "one two three four five six seven", 1, 0), (3, "short", 1, 0), (4, None, 1, 0), (5, "w " * 161, None, 0), (6, "", 9, 0), (7, "字" * 161, 2, 0)],
        "chunk_id long, text string, config_id int, max_tokens int",
    )
    configs = spark.createDataFrame([(1, 4, 1), (2, 0, -1)], "config_id int, max_chunk_tokens int, chunk_overlap_sentences int")
    assert sorted(r["chunk_id"] for r in oversized(chunks, configs).collect()) == [1, 2, 5, 7]
    got = split_oversized(chunks, configs, LEX).collect()
    assert {(r["chunk_id"], r["cut_kind"]) for r in got} == {(1, "between"), (2, "within"), (5, "within"), (7, "within")}
    assert [r["text"] for r in sorted(got, key=lambda r: r["piece_no"]) if r["chunk_id"] == 2] == ["one two three four ", "five six seven"]
    assert split_oversized(chunks.limit(0), configs, LEX).count() == 0
    assert [m.group() for m in TOKEN.finditer("a-b 東京x y")] == ["a-b", "東", "京", "x", "y"]


def test_overlap_is_shared():
    text = "A one two. B one two. C one two. D one two."
    got = pieces(text, 7, 1, LEX)
    assert [text[p["shared"] : p["end"]].strip() for p in got] == ["A one two. B one two.", "B one two. C one two.", "C one two. D one two."]
