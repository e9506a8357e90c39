"""Text of scanned pages, repaired into paragraphs (problem 2).

Headers and footers are lines that recur, fuzzily, at the edges of pages: on neighbouring pages of their document, with digits and
one word masked, whatever the size of document and collection; or, for documents of a page or two, as wordings usual in the whole
collection. Letters that are misread for each other are folded before lines are compared. Page numbers are lines of a number that
goes on a sequence: of the text's other numbers, of its pages, or of the document's. Words broken at line ends are joined where the
collection's vocabulary knows the joined word. Which characters are misread for which is learnt from words that the clean texts don't
know and that one such confusion parts from a word they know well; such words are misread.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import spread, written

#: Least share of all words that a confusion explains, so that there are fewer confusions than its inverse; and distinct words.
CONFUSION_SHARE, CONFUSION_WORDS = 0.001, 2
#: Neighbouring pages on which a line must recur, and their share of the texts that begin within so many pages.
PAGES, PAGE_SHARE, NEAR_PAGES = 3, 0.3, 16
BREAKS = "-­‐¬"
#: Shares of the scanned texts in which a word must stand at page edges to be a fixed word of headers: with each of them lines are
#: masked anew, as the names of a document with many pages may pass the lower ones. And the share for a masked line.
WORD_SHARES, LINE_SHARE = (0.005, 0.015, 0.04), 0.002
EDGE = 2
#: Misread words, with what they were, up to which they are sent to all executors (some 20 MB as a hash table); more are shuffled.
SENT_WORDS = 100_000
#: Length of the first part of words that aren't broken: as long as any.
WHOLE = 1000

_ROMAN = r"(?=[ivxl])(?:x{0,3}|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_PAGE = re.compile(rf"\s*(?:[-–—\[(]+\s*)?(?:p(?:age|\.)?\s*)?(?:\d{{1,4}}|{_ROMAN})(?:\s*(?:of|/)\s*\d{{1,4}})?(?:\s*[-–—\])]+)?\s*\Z", re.IGNORECASE)
_ROW = re.compile(r"\s*\|?\s*[\d.,]+(?:[\s|]+[\d.,]+)+\s*\|?\s*\Z")
_HEADING = re.compile(r"\s*\d+(?:\.\d+)+\s+\S")
_OUTER_NUMBER = re.compile(r"\A\s*\d{1,4}\s{2,}|\s{2,}\d{1,4}\s*\Z")
_TERMINAL = re.compile(r"[.!?。！？।:;,，、][\"'”’»)\]）」]*\s*\Z")
#: Characters with which lines can end that _TERMINAL matches.
_LAST = frozenset(".!?。！？।:;,，、\"'”’»)]）」")
_KEY_TOKEN = re.compile(r"[^\W_]+(?:[!][^\W_]+)*|[|/()]")
_TOKEN = re.compile(r"!?[^\W_]+(?:[!'’̀-ͯ-]?[^\W_]+)*!?")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_TAIL = re.compile(r"[^\W_]+(?:[!'’-][^\W_]+)*\Z")
_HEAD = re.compile(r"[^\W_]+(?:[!'’-][^\W_]+)*")
_FOLD = str.maketrans("cf!o05q16b89", "etiaaSglhhhg")


@lru_cache(maxsize=200_000)
def folded(word: str) -> str:
    """A form that a word shares with its misreadings; numbers become 0."""
    if not any(c.isalpha() for c in word):
        return "0" if any(c.isdigit() for c in word) else word
    w = word.lower().replace("rn", "m").replace("cl", "d").replace("ii", "u").replace("rm", "nn")
    return w.translate(_FOLD).lower()


def key_tokens(line: str) -> list[str]:
    """Folded words of a line without a page number at its ends."""
    bare = line.strip()
    if bare[:1].isdigit() or bare[-1:].isdigit():
        line = _OUTER_NUMBER.sub("", line)
    return [folded(t) for t in _KEY_TOKEN.findall(line)]


def is_page_number(line: str) -> bool:
    """Whether a line has the form of a page number."""
    bare = line.strip()
    return 0 < len(bare) <= 24 and (bare[0].isdigit() or bare[0] in "-–—[(pPiIvVxXlL") and bool(_PAGE.match(line))


_NUMERAL = re.compile(r"\d{1,4}|[ivxl]+", re.IGNORECASE)
_LABEL = re.compile(r"\s*[-–—\[(]*\s*p(?:age|\.)?\s*\d", re.IGNORECASE)
#: Numerals as page numbers are set and others seldom: between dashes or brackets, or Roman in small letters.
_SET_APART = re.compile(r"\s*(?:[-–—\[(]+\s*(?:\d{1,4}|[ivxl]+)\s*[-–—\])]+|[ivxl]+)\s*\Z")


def page_value(line: str) -> tuple[str, int]:
    """Kind of numeral (d, r) and value of a line that has the form of a page number."""
    t = _NUMERAL.search(re.sub(r"(?i)p(?:age|\.)?\s*", "", line, count=1)).group()
    if t.isdigit():
        return "d", int(t)
    values = [{"i": 1, "v": 5, "x": 10, "l": 50}[c] for c in t.lower()]
    return "r", sum(-v if v < max(values[k:]) else v for k, v in enumerate(values))


def outer_numbers(line: str) -> list[int]:
    """Numbers set apart at a line's ends."""
    return [int(m.group()) for m in _OUTER_NUMBER.finditer(line)]


def in_sequence(lines: list[str], at: list[int], running: list[bool], page: int | None, known) -> set[int]:
    """Which of the lines `at`, of the form of page numbers, are some: labelled ones, those known from their document, those that go on
    the numbers before or after them (running lines that end in one among them), that are the text's own page or one it reaches, that
    stand beside a running line, or that are set apart as page numbers are (of one letter, at the text's ends or inside a paragraph)."""
    full = [k for k, x in enumerate(lines) if x.strip()]
    place = {k: p for p, k in enumerate(full)}
    numbers = []  # (line, kind, value) of all that may be one page's number, in order
    for k in full:
        if k in at:
            numbers.append((k, *page_value(lines[k])))
        elif running[k]:
            numbers.extend((k, "d", v) for v in outer_numbers(lines[k]))
    out = set()
    pages = 3 + len(at)  # a page or two of a text may have lost their number
    for n, (k, kind, v) in enumerate(numbers):
        if k not in at:
            continue
        before = [w for _, other, w in numbers[max(0, n - 2) : n] if other == kind]
        after = [w for _, other, w in numbers[n + 1 : n + 3] if other == kind]
        beside = [full[p] for p in (place[k] - 1, place[k] + 1) if 0 <= p < len(full)]
        inside = len(beside) == 2 and not (_TERMINAL.search(lines[beside[0]]) and k - 1 == beside[0] and k + 1 == beside[1])
        if (
            _LABEL.match(lines[k]) or k in known or any(v - w in (0, 1) for w in before) or any(w - v in (0, 1) for w in after)
            or (page is not None and 0 < page <= v < page + pages) or any(running[b] for b in beside)
            or (_SET_APART.match(lines[k]) and (len(beside) < 2 or inside or len(lines[k].strip()) > 1))
        ):
            out.add(k)
    return out


def _too_much(line: str) -> bool:
    """Whether a line is too long for a header or footer, or ends as sentences and broken words do."""
    return len(line) > 80 or line.count(" ") > 14 or line.rstrip()[-1:] in ".!?。！？।:;,，、" + BREAKS


def _may_run(line: str, tokens: list[str]) -> bool:
    """Whether a line can be a header or footer at all."""
    if not 0 < len(tokens) <= 9:
        return False
    bare = line.strip()
    if (bare[0].isdigit() or bare[0] in "|.,") and (_ROW.match(line) or _HEADING.match(line)):
        return False
    return bare[-1] not in BREAKS and not (bare[-1] in _LAST and _TERMINAL.search(line))


def edges(lines: list[str], full: list[int], numbers: list[int], page: int | None = None) -> list[bool]:
    """Lines near the edge of a page: the first and last of the text and those around page numbers, blank ones not counted. full,
    numbers: places of the lines that aren't blank, and of those that have the form of page numbers."""
    near = [False] * len(lines)
    sure = in_sequence(lines, numbers, [False] * len(lines), page, ()) if numbers else ()
    marks = [-1, len(full), *[p for p, k in enumerate(full) if k in sure]]
    for m in marks:
        for p in range(max(0, m - EDGE), min(len(full), m + EDGE + 1)):
            near[full[p]] = True
    return near


def _page_keys(tokens: list[str]) -> list[str]:
    """The forms in which a line may recur on the pages of its document: as it is, and with one of its words masked where two are left."""
    letters = [k for k, t in enumerate(tokens) if t[0].isalpha()]
    if not letters or (len(letters) == 1 and len(tokens[letters[0]]) < 3):
        return []
    forms = [tokens] + [[*tokens[:k], "*", *tokens[k + 1 :]] for k in letters if len(letters) > 2]
    return [" ".join(f) for f in forms]


def _edge_rows(batches):
    """(id, field_name, doc, page, text) -> of the lines that can be headers, footers or page numbers: their tokens (null for numbers),
    whether they stand at an edge, and the forms in which they may recur on other pages."""
    for batch in batches:
        at, numbers, tokens, edge, keys = [], [], [], [], []
        for i, (doc, page, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc", "page", "text")))):
            lines = t.split("\n")
            full = [k for k, x in enumerate(lines) if x.strip()]
            forms = [k for k in full if is_page_number(lines[k])]
            near = edges(lines, full, forms, page)
            passed = 0
            forms = set(forms)
            for k in full:
                line = lines[k]
                if k in forms:
                    kind, value = page_value(line)
                    # Numbers of one sequence are as far from their text's page; several in a text count its pages.
                    ks = [f"# {kind} {value - (page or 0) - n}" for n in {0, passed}] if doc is not None and near[k] else []
                    passed += 1
                    ts = None
                elif not _too_much(line) and _may_run(line, ts := key_tokens(line)):
                    ks = _page_keys(ts) if near[k] else []
                    ks = ks[:1] if doc is None else ks
                else:
                    continue
                at.append(i)
                numbers.append(k)
                tokens.append(ts)
                edge.append(near[k])
                keys.append(ks)
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c).take(take) for c in ("id", "field_name", "doc", "page")], pa.array(numbers, pa.int32()), pa.array(tokens, pa.list_(pa.string())), pa.array(edge, pa.bool_()), pa.array(keys, pa.list_(pa.string()))],
            ["id", "field_name", "doc", "page", "line", "tokens", "edge", "keys"],
        )


def _stretches(page) -> list:
    """Stretches of neighbouring pages that a page is in: two, half a stretch apart, so that those near a border meet as well."""
    half = NEAR_PAGES // 2
    return [F.concat(F.lit("a"), F.floor(page / NEAR_PAGES).cast("string")), F.concat(F.lit("b"), F.floor((page + half) / NEAR_PAGES).cast("string"))]


def recurring_lines(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """id, field_name, known: lines at page edges that recur on neighbouring pages of their document, by three texts at least and a
    share of those that begin there. Without documents, lines that recur without any change in three texts, mostly at edges.

    All is counted by document and stretch of pages, so neither size of document nor of collection matters; the forms of a hot
    document are summed where they are read. Most forms stand once or twice in their whole document: those are left out first, by
    counts of hashes of a document and form, which may let some more pass.
    """
    page = F.coalesce("page", F.lit(0))
    stretch = F.explode(F.array(*_stretches(page))).alias("stretch")
    n_texts = texts.filter("doc IS NOT NULL").select("doc", stretch).groupBy("doc", "stretch").agg(F.count("*").alias("n_texts"))
    edge = rows.filter("edge AND size(keys) > 0 AND doc IS NOT NULL").select("id", "field_name", "line", "doc", "page", F.explode("keys").alias("key"))
    forms = edge.withColumn("form", F.xxhash64("doc", "key"))
    often = forms.groupBy("form").agg(F.count("*").alias("n")).filter(F.col("n") >= PAGES).select("form")
    # The hashes that recur fit in a hash table of each task, so the many forms need no sort.
    each = written(forms.join(often.hint("shuffle_hash"), "form", "left_semi").drop("form"), "forms").select("id", "field_name", "line", "doc", stretch, "key")
    # Lines that recur within one text are counted once.
    once = each.dropDuplicates(["doc", "stretch", "key", "id", "field_name"])
    good = once.groupBy("doc", "stretch", "key").agg(F.count("*").alias("n")).join(n_texts, ["doc", "stretch"])
    good = good.filter((F.col("n") >= PAGES) & (F.col("n") >= PAGE_SHARE * F.col("n_texts"))).select("doc", "stretch", "key")
    found = each.join(good, ["doc", "stretch", "key"]).select("id", "field_name", "line")
    alone = rows.filter("doc IS NULL AND tokens IS NOT NULL").select("id", "field_name", "line", "edge", F.array_join("tokens", " ").alias("key"))
    kept = alone.filter("edge").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= PAGES)
    inner = alone.filter("NOT edge").groupBy("key").agg(F.count("*").alias("inner"))
    kept = kept.join(inner, "key", "left").filter(F.coalesce("inner", F.lit(0)) * 4 <= F.col("n")).select("key")
    found = found.unionByName(alone.filter("edge").join(kept, "key").select("id", "field_name", "line"))
    return found.groupBy("id", "field_name").agg(F.collect_set("line").alias("known"))


def line_key(tokens: list[str], words: set) -> str | None:
    """The line with all but fixed words masked; None if too little is fixed to tell a header by."""
    out = [t if t in words or not t[0].isalpha() else "*" for t in tokens]
    if (masked := out.count("*")) > 2:
        return None
    fixed = len([t for t in out if t[0].isalpha()])
    return " ".join(out) if fixed and masked <= fixed + 1 else None


def _usual_keys(levels: list[set]):
    """(tokens, edge) -> level, key, e, n: masked lines that may tell headers with each level's fixed words, how often they stand at
    edges and at all in a batch. levels: each holds the next one's words."""

    def run(batches):
        for batch in batches:
            e, n = Counter(), Counter()
            for tokens, edge in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for level, fixed in enumerate(levels):
                    # More than two masked words are too many, and the next levels mask as many.
                    if len([t for t in tokens if t not in fixed and t[0].isalpha()]) > 2:
                        break
                    if (key := line_key(tokens, fixed)) is not None:
                        n[level, key] += 1
                        e[level, key] += edge
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in n], pa.int32()), pa.array([k for _, k in n], pa.string()), pa.array([e[x] for x in n], pa.int64()), pa.array(list(n.values()), pa.int64())], ["level", "key", "e", "n"]
            )

    return run


class Furniture:
    """Headers, footers and page numbers of texts (id, field_name, doc, page, text).

    levels: wordings that are usual in the whole collection, for documents of few pages: fixed words and the masked lines that recur at
    page edges, both bounded by their shares. texts: the texts with the lines known from their own document's pages.
    """

    def __init__(self, texts: DataFrame):
        kind = dict(texts.dtypes)["id"]
        rows = texts.select("id", "field_name", "doc", "page", "text").mapInArrow(
            _edge_rows, f"id {kind}, field_name string, doc string, page int, line int, tokens array<string>, edge boolean, keys array<string>"
        )
        rows = written(rows, "edges")
        self.texts = texts.join(recurring_lines(rows, texts), ["id", "field_name"], "left")
        rows = rows.filter("tokens IS NOT NULL")
        n = max(1, texts.count())
        at_edge = rows.filter("edge")
        per_text = at_edge.select("id", F.explode(F.array_distinct("tokens")).alias("t")).filter(F.col("t").rlike(r"^\p{L}")).distinct()
        counts = per_text.groupBy("t").agg(F.count("*").alias("n"))
        often = [(r["t"], r["n"]) for r in counts.filter(F.col("n") >= max(3, WORD_SHARES[0] * n)).collect()]
        fixed = [{t for t, k in often if k >= max(3, share * n)} for share in WORD_SHARES]
        keys = rows.select("tokens", "edge").mapInArrow(_usual_keys(fixed), "level int, key string, e long, n long").groupBy("level", "key").agg(F.sum("e").alias("e"), F.sum("n").alias("n"))
        found = keys.filter((F.col("e") >= max(3, LINE_SHARE * n)) & (F.col("e") >= 0.6 * F.col("n"))).collect()
        self.levels = [(words, {r["key"] for r in found if r["level"] == level}) for level, words in enumerate(fixed)]


class _Marks:
    """Decides on the lines of one text; goes to the executors."""

    def __init__(self, levels):
        self.levels = levels
        self.told = {t for _, keys in levels for key in keys for t in key.split(" ")}

    def marks(self, lines: list[str], page: int | None = None, known=()) -> list[bool]:
        """Which lines are headers, footers or page numbers; known: places of those that the document's other pages tell."""
        running = [k in known and not is_page_number(line) or self._usual(line) for k, line in enumerate(lines)]
        numbers = [k for k, line in enumerate(lines) if is_page_number(line)]
        good = in_sequence(lines, numbers, running, page, known) if numbers else ()
        return [running[k] or k in good for k in range(len(lines))]

    def _usual(self, line: str) -> bool:
        """Whether a line has one of the collection's usual wordings."""
        if not line.strip() or is_page_number(line) or _too_much(line):
            return False
        ts = key_tokens(line)
        # More than two words that stand in no usual wording can't be masked away.
        if len([t for t in ts if t not in self.told]) > 2:
            return False
        return _may_run(line, ts) and any(self._recurs(ts, fixed, keys) for fixed, keys in self.levels)

    @staticmethod
    def _recurs(tokens: list[str], fixed: set, keys: set) -> bool:
        """Whether the masked line is known, as it is or with one fixed word masked too (a name may be fixed by a long document)."""
        if line_key(tokens, fixed) in keys:
            return True
        return any(t in fixed and line_key(tokens, fixed - {t}) in keys for t in set(tokens)) if len(tokens) > 2 else False


def split_words(lines: list[str], furniture: list[bool]):
    """(line, next content line, left part, right part, sure) of words broken at line ends: a hyphen that only a line end brings
    (sure), or one that may belong to the word."""
    content = [k for k, x in enumerate(lines) if x.strip() and not furniture[k]]
    for k, after in zip(content, content[1:]):
        line = lines[k].rstrip()
        if line[-1] not in BREAKS:
            continue
        left, right = _TAIL.search(line[:-1]), _HEAD.match(lines[after].lstrip())
        if left and right:
            yield k, after, left.group(), right.group(), line[-1] != "-"


def _line_rows(marked):
    """(id, field_name, page, known, text) -> what is to be decided of its lines (see scan_decisions): kind; of broken words the parts
    joined, as they are, and whether the hyphen belongs to them; words, the line that their rest is on and how long the first part is."""

    def run(batches):
        for batch in batches:
            at, numbers, kinds, parts, words, lefts, afters = [], [], [], [], [], [], []

            def note(i, k, kind, of=None, w=None, left=None, after=None):
                at.append(i)
                numbers.append(k + 1)
                kinds.append(kind)
                parts.append(of)
                words.append(w)
                lefts.append(left)
                afters.append(after)

            for i, (page, known, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page", "known", "text")))):
                lines = t.split("\n")
                marks = marked(lines, page, frozenset(known or ()))
                heads, tails = {}, {}
                for k, after, left, right, sure in split_words(lines, marks):
                    heads[after], tails[k] = right, left
                    belongs = right[0].isdigit() or right[0].isupper() or any(c.isdigit() for c in left)
                    note(i, k, "hyphen" if sure else "maybe", [left.lower() + right.lower(), f"{left}-{right}".lower(), "1" if belongs else ""])
                    note(i, k, "words", None, [left.lower() + right.lower()], len(left), after + 1)
                for k, line in enumerate(lines):
                    if marks[k]:
                        note(i, k, "furniture")
                    elif line.strip():
                        plain = line.isascii()
                        bare = not plain and bool(_CJK.search(line))
                        if bare or k in heads or k in tails:
                            found = list(_TOKEN.finditer(line))
                            inner = []
                            for j, m in enumerate(found):
                                first = j == 0 and not line[: m.start()].strip()
                                last = j == len(found) - 1 and not line[m.end() :].strip(" " + BREAKS)
                                if (first and k in heads) or (last and k in tails) or ((first or last) and bare):
                                    continue  # perhaps only a part of a word
                                inner.append(m.group().lower())
                        else:
                            inner = _TOKEN.findall(line.lower()) if plain else [w.lower() for w in _TOKEN.findall(line)]
                        if inner:
                            note(i, k, "words", None, inner, WHOLE, k + 1)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take), batch.column(1).take(take), pa.array(numbers, pa.int32()), pa.array(kinds, pa.string()),
                    pa.array(parts, pa.list_(pa.string())), pa.array(words, pa.list_(pa.string())), pa.array(lefts, pa.int32()), pa.array(afters, pa.int32()),
                ],
                ["id", "field_name", "line_no", "kind", "parts", "words", "left", "after"],
            )

    return run


def _by_shuffle(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast. Spark takes its size from files, where words need a tenth of their memory, and
    doesn't see that words become a hundred times as much when Python takes them apart; the driver would have to hold all of it."""
    return df.hint("merge")


def _gaps(word: str):
    """(rest, gap): the word with one or two of its characters left out at every place, as long as three are left."""
    for size in (1, 2):
        if len(word) - size >= 3:
            for k in range(len(word) - size + 1):
                yield f"{word[:k]}\0{word[k + size :]}", word[k : k + size]


def _gapped(batches):
    for batch in batches:
        words, rests, gaps = [], [], []
        for w in batch.column(0).to_pylist():
            if 4 <= len(w) <= 40:
                for rest, gap in _gaps(w):
                    words.append(w)
                    rests.append(rest)
                    gaps.append(gap)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(rests, pa.string()), pa.array(gaps, pa.string())], ["word", "rest", "gap"])


def learnt_confusions(unknown: DataFrame, vocab: DataFrame) -> list[tuple[str, str]]:
    """(misread, right) character sequences, the most usual first: (word) that no clean text has against (word, n) of the clean texts.

    An unknown word speaks for a confusion where undoing it gives a word the clean texts know well, and counts for each of its
    readings in equal parts. Confusions below CONFUSION_SHARE of all that words speak for are chance; what is collected is bounded by it.
    """
    schema = "word string, rest string, gap string"
    # Numbers and codes are no words, and what was meant are letters.
    asked = unknown.select("word").filter(~F.col("word").rlike(r"^\P{L}*$|\d{2}|-\d|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")).mapInArrow(_gapped, schema)
    right = vocab.filter("n >= 3").select("word").mapInArrow(_gapped, schema).select(F.col("word").alias("right"), "rest", F.col("gap").alias("meant")).filter(F.col("meant").rlike(r"^\p{L}+$"))
    pairs = asked.join(_by_shuffle(right), "rest").filter("gap <> meant AND (length(gap) = 1 OR length(meant) = 1 OR (substring(gap, 1, 1) <> substring(meant, 1, 1) AND substring(gap, -1) <> substring(meant, -1)))")
    # A longer gap that only carries along a common character is the shorter one at another place.
    pairs = pairs.filter("NOT (length(gap) = length(meant) AND length(gap) = 2 AND (substring(gap, 1, 1) = substring(meant, 1, 1) OR substring(gap, 2, 1) = substring(meant, 2, 1)))")
    pairs = written(pairs.select("word", "gap", "meant", "right").distinct(), "readings")
    shares = pairs.join(_by_shuffle(pairs.groupBy("word").agg(F.count("*").alias("k"))), "word").groupBy("gap", "meant").agg(F.sum(1 / F.col("k")).alias("weight"), F.count_distinct("word").alias("words"))
    total = shares.agg(F.sum("weight")).first()[0] or 0.0
    good = shares.filter((F.col("weight") >= CONFUSION_SHARE * total) & (F.col("words") >= CONFUSION_WORDS))
    return [(r["gap"], r["meant"]) for r in good.orderBy(F.desc("weight"), "gap", "meant").collect()]


def corrections(word: str, confusions: list[tuple[str, str]]):
    """(word with one or two confusions undone, place of the first)."""
    seen = {word}
    first = []
    for wrong, right in confusions:
        at = word.find(wrong)
        while at >= 0:
            new = word[:at] + right + word[at + len(wrong) :]
            if new not in seen:
                seen.add(new)
                first.append((new, at))
                yield new, at
            at = word.find(wrong, at + 1)
    if any(c.isdigit() or c == "!" for c in word):
        for half, at in first:
            for wrong, right in confusions:
                b = half.find(wrong)
                if b >= 0 and (new := half[:b] + right + half[b + len(wrong) :]) not in seen:
                    seen.add(new)
                    yield new, min(at, b)


def _correcting(confusions):
    """(word) -> word, right, at: what it may have been."""

    def run(batches):
        for batch in batches:
            words, news, ats = [], [], []
            for w in batch.column(0).to_pylist():
                if len(w) > 40 or not any(c.isalpha() for c in w):
                    continue
                for new, at in corrections(w, confusions):
                    if new.isalpha() or not new.isascii() or "-" in new or "'" in new:
                        words.append(w)
                        news.append(new)
                        ats.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(news, pa.string()), pa.array(ats, pa.int32())], ["word", "right", "at"])

    return run


def vocabulary(texts: DataFrame) -> DataFrame:
    """word, n: words of the clean texts in lower case, whole and at hyphens. Words have no blanks, so each piece between blanks is
    taken apart once, however often it stands there."""
    pieces = texts.select(F.explode(F.split("text", " ")).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    whole = pieces.select(F.explode(F.regexp_extract_all(F.lower("piece"), F.lit(r"([\p{L}\p{M}\p{N}]+(?:['’-][\p{L}\p{M}\p{N}]+)*)"), F.lit(1))).alias("word"), "n")
    parts = F.when(F.col("word").contains("-"), F.concat(F.array("word"), F.split("word", "-"))).otherwise(F.array("word"))
    return whole.select(F.explode(parts).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))


def scan_decisions(scanned: DataFrame, clean: DataFrame) -> DataFrame:
    """(id, field_name, text) and, where known, (doc, page) of scanned and (text) of clean texts -> id, field_name, line_no, kind
    (furniture, hyphen, misread), word, right (the word joined or corrected, else null). page is where the text begins; a null, or one
    below 1, is no page. A line may have several rows; null and empty texts have none."""
    facts = [F.col(c).cast(t) if c in scanned.columns else F.lit(None).cast(t).alias(c) for c, t in (("doc", "string"), ("page", "int"))]
    scanned = spread(scanned.filter(F.col("text").isNotNull()).select("id", "field_name", *facts, "text"))
    furniture = Furniture(scanned)
    kind = dict(scanned.dtypes)["id"]
    told = furniture.texts.select("id", "field_name", "page", "known", "text")
    marked = _Marks(furniture.levels)
    lines = written(told.mapInArrow(_line_rows(marked.marks), f"id {kind}, field_name string, line_no int, kind string, parts array<string>, words array<string>, left int, after int"), "lines")
    vocab = written(vocabulary(clean), "vocabulary")
    joined = vocab.select(F.col("word").alias("joined"), F.col("n").alias("n_joined"))
    kept = vocab.select(F.col("word").alias("kept"), F.col("n").alias("n_kept"))
    # Furniture has no parts, so its words are null.
    out = lines.filter("kind IN ('furniture', 'hyphen')").select("id", "field_name", "line_no", "kind", F.col("parts")[1].alias("word"), F.col("parts")[0].alias("right"))
    maybe = lines.filter("kind = 'maybe'").select("id", "field_name", "line_no", F.col("parts")[0].alias("joined"), F.col("parts")[1].alias("kept"), (F.col("parts")[2] == "1").alias("belongs"))
    maybe = maybe.join(_by_shuffle(joined), "joined", "left").join(_by_shuffle(kept), "kept", "left").fillna(0, ["n_joined", "n_kept"])
    broken = F.when(F.col("n_joined") != F.col("n_kept"), F.col("n_joined") > F.col("n_kept")).otherwise(~F.col("belongs"))
    maybe = maybe.filter(broken).select("id", "field_name", "line_no", F.lit("hyphen").alias("kind"), F.col("kept").alias("word"), F.col("joined").alias("right"))
    # Words of content lines, broken ones joined, each with the line that holds its first part and how long that part is.
    words = lines.filter("kind = 'words'").select("id", "field_name", "line_no", F.explode("words").alias("word"), "left", "after")
    known = vocab.select("word", "n")
    asked = words.select("word").distinct().join(_by_shuffle(known), "word", "left").fillna(0, ["n"])
    asked = written(asked, "asked")
    confusions = learnt_confusions(asked.filter("n = 0").select("word"), vocab)
    tried = asked.select("word").mapInArrow(_correcting(confusions), "word string, right string, at int")
    rights = tried.join(_by_shuffle(known.select(F.col("word").alias("right"), F.col("n").alias("n_right"))), "right").join(_by_shuffle(asked), "word")
    odd = F.col("word").rlike(r"[0-9!]")
    rights = rights.filter((F.col("n") * 200 <= F.col("n_right")) & (F.col("n_right") >= F.when(odd, 1).otherwise(3)))
    best = rights.groupBy("word").agg(F.max_by(F.struct("right", "at"), "n_right").alias("r")).select("word", "r.right", "r.at")
    best = written(best, "misread")
    best = F.broadcast(best) if best.count() <= SENT_WORDS else _by_shuffle(best)
    misread = words.join(best, "word").select(
        "id", "field_name", F.when(F.col("at") < F.col("left"), F.col("line_no")).otherwise(F.col("after")).alias("line_no"), F.lit("misread").alias("kind"), "word", "right"
    )
    return out.unionByName(maybe).unionByName(misread)


def repaired(text: str, decisions: list[tuple[int, str, str | None, str | None]]) -> str:
    """Continuous paragraphs: faulty lines removed, broken words joined, misread ones corrected, lines of a paragraph joined. Headings
    and rows of tables keep their lines."""
    drop, joins, fixes = set(), set(), {}
    for number, kind, word, right in decisions:
        if kind == "furniture":
            drop.add(number - 1)
        elif kind == "hyphen":
            joins.add(number - 1)
        else:
            fixes.setdefault(number - 1, {})[word] = right

    def fixed(k: int, line: str) -> str:
        if k not in fixes:
            return line

        def sub(m):
            right = fixes[k].get(m.group().lower())
            return m.group() if right is None else right.capitalize() if m.group()[0].isupper() else right

        return _TOKEN.sub(sub, line)

    paragraphs, now, blank = [], "", True
    glue = True
    for k, line in enumerate(text.split("\n")):
        if k in drop:
            continue
        if not line.strip():
            blank = True
            continue
        line = re.sub(r"[^\S\n]+", " ", fixed(k, line)).strip()
        own = bool(_ROW.match(line) or _HEADING.match(line))
        ended = not now or bool(re.search(r"[.!?。！？।][\"'”’»)\]）」]*\Z", now))
        if own or (now and blank and ended) or not now:
            if now:
                paragraphs.append(now)
            now = line
        elif glue:
            now += line
        else:
            now += ("" if _CJK.match(now[-1]) or _CJK.match(line[0]) else " ") + line
        glue = k in joins or (now[-1:] == "-" and now[-2:-1].isalpha())
        if k in joins:
            now = now[:-1]
        if own:
            paragraphs.append(now)
            now = ""
        blank = False
    return "\n\n".join([*paragraphs, now] if now else paragraphs)


def _repairing(batches):
    for batch in batches:
        out = []
        for t, ds in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            out.append(repaired(t, [(d["line_no"], d["kind"], d["word"], d["right"]) for d in ds or []]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["id", "field_name", "repaired"])


def repair_scans(scanned: DataFrame, decisions: DataFrame) -> DataFrame:
    """id, field_name, repaired of every scanned text that is not null."""
    per_text = decisions.groupBy("id", "field_name").agg(F.collect_list(F.struct("line_no", "kind", "word", "right")).alias("ds"))
    rows = scanned.filter(F.col("text").isNotNull()).join(per_text, ["id", "field_name"], "left")
    return rows.select("id", "field_name", "text", "ds").mapInArrow(_repairing, "id string, field_name string, repaired string")
