"""Sentences of texts in many languages and scripts (problem 7).

Every end mark is a possible end, but for those inside a quotation or bracket that a sentence goes on around, at any length. A
semi-Markov dynamic program chooses among all ways to cut a paragraph into spans; a span is scored as a whole, by the word it opens
with, the word and mark it closes with, its quotations and brackets, and its length. How likely a word before a full stop ends a
sentence, and which words open sentences in small letters, is counted over the whole collection.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import spread, written

#: Abbreviations that a sentence seldom ends with (lower case, without the last full stop), for small collections: each counts like
#: LISTED full stops without an end of a sentence, and the collection's own counts are added. Fixed values.
ABBREVIATIONS = frozenset(
    "approx cf sec fig figs no nos vs dept max min e.g i.e u.s u.k a.m p.m mr mrs ms dr prof st inc ltd eq ch ref refs vol pp ed est "
    "z.b u.a d.h z b u d h nr ca abb tab kap abschn bzw vgl f ff str hr fr "
    "env art chap c.-à-d p.ex ex ej p.ej fig pág págs aprox cap n núm sr sra dña av tr tp ths ts gs".split()
)
#: Words before a full stop that end sentences about as often as not: fixed values.
OPEN_ENDED = frozenset("etc usw v.v v.d usf".split())
OPENING = "([{（［【《〈“„«「『‘"
CLOSING = ")]}）］】》〉”“»」』’"
_PAIR = dict(zip("([{（［【《〈“„«「『", ")]}）］】》〉””»」』"))
_MARK = re.compile(r"[.!?…。！？।॥‼⁇⁈⁉]+")
_BLANK_LINE = re.compile(r"\r?\n[^\S\n]*\n\s*")
_LAST_WORD = re.compile(r"[^\s(\[{（【\"“„«「『]+\Z")
_INTERESTING = re.compile(r"[.!?…。！？।॥‼⁇⁈⁉]+|[\"(\[{（［【《〈“„«「『)\]}）］】》〉”»」』’]")
_QUOTES = re.compile(r"[\"(\[{（［【《〈“„«「『]")
_ENDS_SENTENCES = frozenset(".!?…。！？।॥‼⁇⁈⁉")
LISTED, LISTED_OPEN = 60, 6
#: Full stops that an unknown word counts for as usual: many if it is seen without one too, as common words are.
USUAL, SELDOM_BARE = 20, 2
#: Words are told from the usual by counts from LEAST on, and by their share of all full stops, so that few are kept.
LEAST, LEAST_SHARE = 8, 1e-6
#: Share of a word's places at which it must begin a paragraph to be an opener in small letters, and such beginnings.
OPENER_SHARE, OPENERS = 0.1, 3


def closing_score(n: float, e: float, bare: float, usual: float) -> float:
    """Score of a full stop as an end, after a word with n full stops of which e end a paragraph, and `bare` places without one;
    usual: the share of full stops that end a paragraph. From 2 (as likely as after others) to -6 (never)."""
    k = USUAL if bare * 10 > n or e else SELDOM_BARE
    ratio = (e / usual + k) / (n + k)
    return max(-6.0, min(2.0, 2.0 + 8.0 * math.log10(2 * ratio)))


@dataclass(frozen=True)
class Lexicon:
    """What the collection tells of its words: (full stops, ends of paragraphs, places without) of those that end sentences less often
    than usual, and openers in small letters."""

    counts: dict = field(default_factory=dict)
    openers: frozenset = field(default_factory=frozenset)
    usual: float = 1 / 6

    def closing(self, word: str) -> float:
        n, e, bare = self.counts.get(word, (0, 0, 0))
        if word in ABBREVIATIONS or word.strip(".-") in ABBREVIATIONS:
            n += LISTED
        elif not n:
            return 2.0
        return closing_score(n, e, bare, self.usual)


_EDGE = "([{\"'“„«‘’”»)]},;:!?"


def _counting(batches):
    """(text) -> word, what (0 without a full stop, 1 with one, 2 with one at the end of a paragraph, 3 the first of a paragraph), n."""
    for batch in batches:
        plain, ends, firsts = Counter(), Counter(), Counter()
        for t in batch.column(0).to_pylist():
            for part in _BLANK_LINE.split(t) if "\n" in t else (t,):
                words = part.split()
                if words:
                    plain.update(words)
                    ends[words[-1]] += 1
                    firsts[words[0]] += 1
        out: list[Counter] = [Counter() for _ in range(4)]
        for w, n in plain.items():
            if len(w) <= 24:
                bare = w.lower().lstrip(_EDGE)
                stopped = bare.endswith(".") and not bare.endswith("..")
                bare = bare[:-1] if stopped else bare.rstrip(_EDGE)
                if bare and bare[0].isalpha():
                    out[stopped][bare] += n
        for w, n in ends.items():
            bare = w.lower().lstrip(_EDGE)
            if len(w) <= 24 and bare[:1].isalpha() and bare.endswith(".") and not bare.endswith(".."):
                out[2][bare[:-1]] += n
        for w, n in firsts.items():
            if len(w) <= 24 and w[0].islower():
                out[3][w.rstrip(_EDGE + ".")] += n
        rows = [(w, what, n) for what, c in enumerate(out) for w, n in c.items()]
        words, whats, ns = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(whats, pa.int32()), pa.array(ns, pa.int64())], ["word", "what", "n"])


def collection_lexicon(texts: DataFrame, text_col: str = "text") -> Lexicon:
    """Counts, over all texts, how often words stand before a full stop, how often that is the end of a paragraph, and how often they
    stand without; and which words without a capital begin paragraphs. Only words that differ from the usual are kept, and of those
    that are seldom before a full stop none, so their number is bounded."""
    texts = spread(texts.select(F.col(f"`{text_col}`").alias("text")).filter("text IS NOT NULL"))
    rows = texts.mapInArrow(_counting, "word string, what int, n long")
    of = lambda k, name: F.sum(F.when(F.col("what") == k, F.col("n")).otherwise(0)).alias(name)
    counts = written(rows.groupBy("word").agg(of(0, "bare"), of(1, "n"), of(2, "e"), of(3, "first")), "words")
    total = counts.agg(F.sum("n").alias("n"), F.sum("e").alias("e")).first()
    n, e = total["n"] or 0, total["e"] or 0
    usual = (e + 1) / (n + 6)
    # Twice as seldom at an end as usual, at least; the score decides by how much.
    seldom = counts.filter((F.col("n") >= max(LEAST, LEAST_SHARE * n)) & (F.col("e") * 2 < F.col("n") * usual))
    # Listed words are asked for too, as they may end sentences here.
    listed = counts.filter(F.col("word").isin(*sorted(ABBREVIATIONS)) & (F.col("n") > 0))
    kept = {r["word"]: (r["n"], r["e"], r["bare"]) for r in seldom.unionByName(listed).select("word", "n", "e", "bare").collect()}
    opening = (F.col("first") >= OPENERS) & (F.col("first") >= OPENER_SHARE * (F.col("bare") + F.col("n")))
    openers = counts.filter(opening & (F.col("first") >= LEAST_SHARE * n)).select("word").collect()
    return Lexicon(kept, frozenset(r["word"] for r in openers), usual)


def _caseless(c: str) -> bool:
    return unicodedata.category(c) in ("Lo", "Lm")


def _closes(opening: str, c: str) -> bool:
    return opening == c == '"' or _PAIR.get(opening) == c or (c == "”" and opening in "“„") or (c == "“" and opening == "„")


class _Paragraph:
    """Possible ends of a paragraph and what is needed to score spans between them."""

    def __init__(self, text: str, low: int, high: int, lexicon: Lexicon):
        self.text, self.low, self.high, self.lexicon = text, low, high, lexicon
        self.ends: list[int] = [low]
        self.marks: list[str] = [""]
        self.words: list[str] = [""]
        self.closed: list[str] = [""]
        self.depth: list[tuple[int, bool]] = [(0, False)]
        self._scan()

    def _held(self) -> tuple[list[int], list[int]]:
        """Where quotations and brackets begin and end (outermost ones, in order) that a sentence goes on around: all but those that
        open where a sentence may begin and close behind an end mark where another may. Pairs that don't close bind nothing."""
        text, low, high = self.text, self.low, self.high
        self.quotes: set[int] = set()  # straight quotation marks that belong to a pair
        if not _QUOTES.search(text, low, high):
            return [], []
        stack: list[tuple[str, int]] = []
        pairs: list[tuple[int, int]] = []
        for m in _INTERESTING.finditer(text, low, high):
            c, at = m.group(), m.start()
            if c[0] in _ENDS_SENTENCES:
                continue
            before, after = text[at - 1] if at > low else " ", text[at + 1] if at + 1 < high else " "
            opened = next((k for k in range(len(stack) - 1, -1, -1) if _closes(stack[k][0], c)), None)
            if c == '"':
                # As an opening one it stands before a word, as a closing one behind; what may be both takes turns.
                may_open, may_close = not after.isspace() and not before.isalnum(), not before.isspace()
                if opened is not None and may_close and not (may_open and before in "([{—–-"):
                    pass
                elif may_open or _caseless(before):
                    opened = None
                    stack.append((c, at))
                    continue
                else:
                    continue
            elif c in _PAIR and not (c == "“" and opened is not None):
                stack.append((c, at))
                continue
            if opened is not None:
                begin = stack[opened][1]
                del stack[opened:]
                if c == '"':
                    self.quotes |= {begin, at}
                if not self._stands_alone(begin, at):
                    pairs.append((begin, at))
        begins, ends = [], []
        for begin, end in sorted(pairs):
            if not ends or begin > ends[-1]:
                begins.append(begin)
                ends.append(end)
        return begins, ends

    def _stands_alone(self, begin: int, end: int) -> bool:
        text = self.text
        k = begin - 1
        while k >= self.low and (text[k].isspace() or text[k] in OPENING):
            k -= 1
        if k >= self.low and text[k] not in _ENDS_SENTENCES and text[k] not in CLOSING and text[k] != '"':
            return False
        k = end - 1
        while k > begin and (text[k].isspace() or text[k] in CLOSING or text[k] == '"'):
            k -= 1
        if text[k] not in _ENDS_SENTENCES:
            return False
        k = end + 1
        while k < self.high and (text[k] in CLOSING or text[k] == '"'):
            k += 1
        if k < self.high and not text[k].isspace():
            return False
        while k < self.high and text[k].isspace():
            k += 1
        return k >= self.high or text[k].isupper() or text[k].isdigit() or text[k] in OPENING or text[k] in '"¿¡-–—*•#|'

    def _scan(self) -> None:
        text, at, high = self.text, self.low, self.high
        begins, closes = self._held()
        stack: list[str] = []
        straight = False
        while m := _INTERESTING.search(text, at, high):
            at = m.start()
            c = text[at]
            if c == '"':
                straight ^= at in self.quotes
                at += 1
            elif c == "“" and stack and stack[-1] == "„":
                stack.pop()
                at += 1
            elif c in _PAIR:
                stack.append(c)
                at += 1
            elif c in CLOSING:
                if stack and _closes(stack[-1], c):
                    stack.pop()
                at += 1
            else:
                begin, at = at, m.end()
                closed = ""
                while at < high:
                    c, skip = text[at], 0
                    if c in "   " and at + 1 < high and text[at + 1] == "»" and stack and stack[-1] == "«":
                        c, skip = "»", 1
                    if c == '"' and straight and at in self.quotes:
                        straight = False
                    elif stack and (_PAIR[stack[-1]] == c or (c in "“”" and stack[-1] in "“„")):
                        stack.pop()
                    else:
                        break
                    closed += c
                    at += 1 + skip
                k = bisect_right(begins, begin) - 1
                if k < 0 or at > closes[k]:
                    self._note(begin, at, m.group(), closed, len(stack), straight)
        if self.ends[-1] < high:
            self.ends.append(high)
            self.marks.append("")
            self.words.append("")
            self.closed.append("")
            self.depth.append((len(stack), straight))

    def _note(self, begin: int, end: int, mark: str, closed: str, depth: int, straight: bool) -> None:
        text = self.text
        if end < self.high:
            c = text[end]
            dotted = mark[-1] in ".!?…" and not c.isspace()
            # Without white space a full stop ends a word only before a capital, or a script without capitals.
            if dotted and not (
                _caseless(c) or c in "¿¡(“„«「『（" or (c.isupper() and text[begin - 1 : begin].islower() and text[begin - 2 : begin].isalpha() and text[end + 1 : end + 2].islower())
                or (c == '"' and not straight) or (closed and c.isalpha()) or (mark[-1] in "!?" and c.isupper())
                or (text[begin - 1 : begin].isdigit() and c.isupper() and mark == ".")
            ):
                return
        m = _LAST_WORD.search(text, max(self.low, begin - 40), begin)
        self.ends.append(end)
        self.marks.append(mark)
        self.words.append(m.group().lower() if m else "")
        self.closed.append(closed)
        self.depth.append((depth, straight))

    def first(self, i: int) -> int:
        at = self.ends[i]
        while at < self.high and self.text[at].isspace():
            at += 1
        return at

    def closing(self, j: int) -> float:
        mark, word, closed = self.marks[j], self.words[j], self.closed[j]
        if "…" in mark or mark.startswith(".."):
            return -4.0
        if mark != ".":
            return 3.0
        if word in OPEN_ENDED:
            return 1.0
        bare = word.strip(".-")
        score = self.lexicon.closing(word)
        if score < 1.0:
            return score
        if len(bare) == 1 and bare.isalpha() and not _caseless(bare):
            return 0.5 if closed else -4.0
        if word.isdigit() and self.text[max(self.low, self.ends[j] - len(word) - 2) : self.ends[j] - len(word) - 1] in ("\n", ""):
            return -5.0  # the number of a list item
        return score

    def opening(self, i: int) -> float:
        at = self.first(i)
        if at >= self.high:
            return 0.0
        text = self.text
        c = text[at]
        if c in OPENING or c in '"¿¡-–—*•#|':
            return 1.0
        if c.isupper() or unicodedata.category(c) == "Lt":
            return 1.5
        if c.isdigit():
            return 0.0
        if _caseless(c):
            return 1.0
        word = re.match(r"\S+", text[at : at + 40]).group()
        if word in self.lexicon.openers or any(x.isupper() for x in word) or re.match(r"\w+\.\w", word):
            return 1.0
        return -6.0

    def span(self, i: int, j: int, start: int) -> float:
        """Score of the span between the ends i and j as a sentence, but for its opening; start: its first character."""
        text, end = self.text, self.ends[j]
        last = j == len(self.ends) - 1
        score = 0.0 if last else self.closing(j)
        if self.depth[i] != self.depth[j]:
            score -= 7.0
        closed = self.closed[j]
        if closed and not last:
            after = self.first(j)
            following = text[after]
            opened_first = text[start] in OPENING or text[start] == '"'
            if closed[-1] in ")]}）］】":
                score += 0.0 if opened_first else -8.0
            elif following == "と":
                score -= 8.0
            elif opened_first and (_caseless(following) or following.isdigit()):
                score -= 8.0
        n = end - start
        if n < 4:
            score -= 2.0
        elif n > 400:
            score -= 0.002 * (n - 400)
        return score

    def sentences(self) -> list[tuple[int, int]]:
        """(first character, end) of the best cut."""
        m = len(self.ends)
        firsts = [self.first(i) for i in range(m)]
        opens = [0.0] + [self.opening(i) for i in range(1, m)]
        best, back = [0.0] + [-1e18] * (m - 1), [0] * m
        before, top = [0.0] * m, [0.0] * m  # score of all that comes before a span that begins at i, and the best of these up to i
        for j in range(1, m):
            # A span scores what its end does at most, less what its length costs, and those further back are longer.
            most = self.closing(j) if j < m - 1 else 0.0
            for i in range(j - 1, -1, -1):
                bound = most - 0.002 * max(0, self.ends[j] - firsts[i] - 400)
                if top[i] + bound < best[j]:
                    break
                if before[i] + bound >= best[j] and (s := before[i] + self.span(i, j, firsts[i])) >= best[j]:
                    best[j], back[j] = s, i
            before[j] = best[j] + opens[j]
            top[j] = max(top[j - 1], before[j])
        out, j = [], m - 1
        while j > 0:
            out.append((firsts[back[j]], self.ends[j]))
            j = back[j]
        return out[::-1]


def split_sentences(text: str, lexicon: Lexicon) -> list[tuple[int, int]]:
    """(first, end) of every sentence, in characters from 0, end exclusive, without white space around. A blank line always ends one.
    None and blank texts have none."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    at = 0
    for m in [*_BLANK_LINE.finditer(text), None]:
        low, high = at, m.start() if m else len(text)
        at = m.end() if m else at
        while low < high and text[low].isspace():
            low += 1
        while high > low and text[high - 1].isspace():
            high -= 1
        if low < high:
            out.extend(_Paragraph(text, low, high, lexicon).sentences())
    return out


def _splitting(lexicon):
    def run(batches):
        for batch in batches:
            at, first, end, number, pieces = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for k, (a, b) in enumerate(split_sentences(t, lexicon)):
                    at.append(i)
                    first.append(a + 1)
                    end.append(b)
                    number.append(k)
                    pieces.append(t[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(first, pa.int32()), pa.array(end, pa.int32()), pa.array(pieces, pa.string())],
                ["id", "sentence_no", "start_pos", "end_pos", "sentence"],
            )

    return run


def sentence_rows(texts: DataFrame, id_col: str, text_col: str, lexicon: Lexicon | None = None) -> DataFrame:
    """id, sentence_no (from 0), start_pos and end_pos (from 1, inclusive), sentence. The lexicon is counted on the texts unless given.
    Rows with null or blank text give none; equal rows each give theirs."""
    lexicon = collection_lexicon(texts, text_col) if lexicon is None else lexicon
    rows = texts.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = dict(rows.dtypes)["id"]
    return spread(rows).mapInArrow(_splitting(lexicon), f"id {kind}, sentence_no int, start_pos int, end_pos int, sentence string")
