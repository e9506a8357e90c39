"""Sentences with many possible ends inside."""

import random
import time

import pytest

from corpusloom.llm.sentences import Lexicon, _Paragraph, split_sentences

LEX = Lexicon()


@pytest.mark.parametrize("n", [35, 41, 60, 150])
@pytest.mark.parametrize("inner", [" .", " cf. x,"])
def test_a_sentence_over_many_ends_stays_whole(n, inner):
    want = ["One stands before.", "The pump" + inner * n + " stops here.", "It ends."]
    text = " ".join(want)
    assert [text[a:b] for a, b in split_sentences(text, LEX)] == want


def score(p, spans):
    at = {e: k for k, e in enumerate(p.ends)}
    cuts = [0, *[at[b] for _, b in spans]]
    return sum((p.opening(i) if i else 0.0) + p.span(i, j, p.first(i)) for i, j in zip(cuts, cuts[1:]))


def best_score(p):
    best = [0.0]
    for j in range(1, len(p.ends)):
        best.append(max(best[i] + (p.opening(i) if i else 0.0) + p.span(i, j, p.first(i)) for i in range(j)))
    return best[-1]


def test_no_other_cut_scores_more():
    dice = random.Random(3)
    for _ in range(60):
        text = "A" + "".join(dice.choices([" .", " cf. x", " ... b", " Go on.", " (", ")", ' "', " long word", " e.g."], [9, 9, 6, 1, 1, 1, 1, 4, 6], k=300))
        p = _Paragraph(text, 0, len(text), LEX)
        assert score(p, p.sentences()) == pytest.approx(best_score(p), abs=1e-6)


def test_long_leaders_take_no_quadratic_time():
    began = time.perf_counter()
    assert split_sentences("The pump" + " ." * 5_000 + " stops.", LEX)
    assert time.perf_counter() - began < 30
