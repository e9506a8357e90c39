"""Pieces of texts that are larger than a limit (problem 4).

A hierarchy of separators: a text above the limit is taken apart at sections, a section above it at paragraphs, then sentences,
words and, where sizes are characters, at last characters; what fits stays whole. The parts are packed greedily, in order, and each
piece but the first begins with the last sentences of the piece before.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.sentences import Lexicon, collection_lexicon, split_sentences

#: Values that a config at or below zero stands for.
DEFAULT_TOKENS, DEFAULT_OVERLAP = 160, 1
_CJK = "぀-ヿ㐀-鿿"
TOKEN = re.compile(rf"[{_CJK}]|[^\s{_CJK}]+")
_SECTION = re.compile(r"(?m)^(?=#{1,6}\s|---+\s*$)")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_WORD = re.compile(rf"[{_CJK}]|[^\s{_CJK}]+\s*|\s+")


def n_tokens(text: str) -> int:
    """One for each kana or Han character and for each maximal run of other characters without white space."""
    return len(TOKEN.findall(text))


def token_count(text: Column) -> Column:
    """n_tokens as an expression; null for null."""
    return F.size(F.regexp_extract_all(text, F.lit(rf"(?U)([{_CJK}]|[^\s{_CJK}]+)"), F.lit(1)))


class Measure:
    """Sizes of stretches of a text, in tokens or in characters, without going through the text again."""

    def __init__(self, text: str, unit: str = "tokens"):
        if unit not in ("tokens", "characters"):
            raise ValueError(f"sizes are tokens or characters, not {unit!r}")
        self.text, self.unit = text, unit
        found = [m.span() for m in TOKEN.finditer(text)]
        self.starts, self.ends = [a for a, _ in found], [b for _, b in found]

    def __call__(self, low: int, high: int) -> int:
        if self.unit == "characters":
            return high - low
        return max(0, bisect_left(self.starts, high) - bisect_right(self.ends, low))

    def words(self, low: int, high: int, limit: int) -> list[tuple[int, int]]:
        """(place, level) of cuts that leave no more than the limit between: before words, and within a word above the limit alone,
        where no mark is torn from its letter."""
        cuts, last = [(low, 3)], low
        for m in _WORD.finditer(self.text, low, high):
            if self(last, m.end()) > limit and m.start() > last and not m.group().isspace():
                cuts.append((m.start(), 3))
                last = m.start()
            while self(last, m.end()) > limit:
                at = last + limit
                while at > last + 1 and unicodedata.combining(self.text[at]):
                    at -= 1
                cuts.append((at, 4))
                last = at
        return [*cuts, (high, 3)]


def parts(measure: Measure, limit: int, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first, end, level) of consecutive parts, each within the limit; level 0 section, 1 paragraph, 2 sentence, 3 words, 4
    characters: the separator that the part's end is. Parts leave nothing out, and none above words ends inside a sentence."""
    text = measure.text
    starts = [a for a, _ in spans]
    out: list[tuple[int, int, int]] = []

    def between(cut: int) -> bool:
        k = bisect_right(starts, cut - 1) - 1  # the last sentence that begins before the cut
        return k < 0 or spans[k][1] <= cut

    def take(low: int, high: int, level: int, end_level: int) -> None:
        if low >= high:
            return
        if measure(low, high) <= limit:
            out.append((low, high, end_level))
            return
        if level == 0:
            inner = [m.start() for m in _SECTION.finditer(text, low, high)]
        elif level == 1:
            inner = [m.end() for m in _PARAGRAPH.finditer(text, low, high)]
        elif level == 2:
            inner = starts[bisect_right(starts, low) : bisect_left(starts, high)]
        else:
            cuts = measure.words(low, high, limit)
            for k, ((a, _), (b, why)) in enumerate(zip(cuts, cuts[1:])):
                out.append((a, b, end_level if k == len(cuts) - 2 else why))
            return
        cuts = [low, *[c for c in inner if low < c < high and between(c)], high]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            take(a, b, level + 1, end_level if k == len(cuts) - 2 else level)

    take(0, len(text), 0, 0)
    return out


def pieces(text: str, limit: int, overlap: int, lexicon: Lexicon, unit: str = "tokens") -> list[dict]:
    """first, end (new text, end exclusive), shared (where the overlap begins), size and level of each piece.

    The overlap is the last `overlap` sentences of the piece before, fewer where they and a part don't fit the limit together.
    """
    measure = Measure(text, unit)
    spans = split_sentences(text, lexicon)
    starts = [a for a, _ in spans]
    todo = parts(measure, limit, spans)[::-1]
    out: list[dict] = []
    while todo:
        first, end, level = todo.pop()
        shared = first
        if out and overlap and out[-1]["level"] < 3:
            k = bisect_left(starts, first)
            mine = starts[max(bisect_left(starts, out[-1]["shared"]), k - overlap) : k][::-1]
            # A part that leaves no room for the overlap is taken apart at its sentences.
            inner = starts[bisect_right(starts, first) : bisect_left(starts, end)]
            if mine and inner and measure(mine[-1], end) > limit:
                cuts = [first, *inner, end]
                todo.extend([(a, b, 2 if b < end else level) for a, b in zip(cuts, cuts[1:])][::-1])
                first, end, level = todo.pop()
            for s in mine:
                if measure(s, end) > limit:
                    break
                shared = s
        while todo and measure(shared, todo[-1][1]) <= limit:
            _, end, level = todo.pop()
        out.append({"first": first, "end": end, "shared": shared, "size": measure(shared, end), "level": level})
    return out


LEVELS = ("section", "paragraph", "sentence", "word", "character")


def oversized(chunks: DataFrame, configs: DataFrame) -> DataFrame:
    """chunk_id, text, max_tokens, overlap of chunks above the limit of their config; an unknown config, and values that are null or
    not above zero, mean the defaults. Null texts have no tokens."""
    c = configs.select(
        "config_id",
        F.when(F.col("max_chunk_tokens") > 0, F.col("max_chunk_tokens")).alias("max_tokens"),
        F.when(F.col("chunk_overlap_sentences") > 0, F.col("chunk_overlap_sentences")).alias("overlap"),
    ).dropDuplicates(["config_id"])
    # Few configs go to every task by their measured size; many are joined by a shuffle.
    joined = chunks.select("chunk_id", "text", "config_id").join(c, "config_id", "left")
    joined = joined.select("chunk_id", "text", F.coalesce("max_tokens", F.lit(DEFAULT_TOKENS)).alias("max_tokens"), F.coalesce("overlap", F.lit(DEFAULT_OVERLAP)).alias("overlap"))
    return joined.filter(token_count(F.col("text")) > F.col("max_tokens"))


def _cutting(lexicon):
    def run(batches):
        for batch in batches:
            at, rows, within = [], [], []
            for i, (t, limit, overlap) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "max_tokens", "overlap")))):
                found = pieces(t, limit, overlap, lexicon)
                # Only a sentence above the limit is ever cut below the level of sentences.
                inside = any(p["level"] >= 3 for p in found)
                for k, p in enumerate(found):
                    at.append(i)
                    rows.append((k, p["first"] + 1, p["end"], p["shared"] + 1, p["size"], LEVELS[p["level"]], t[p["shared"] : p["end"]]))
                    within.append("within" if inside else "between")
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(within, pa.string()), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["chunk_id", "cut_kind", "piece_no", "start_pos", "end_pos", "shared_from", "n_tokens", "cut_at", "text"],
            )

    return run


def split_oversized(chunks: DataFrame, configs: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """Pieces of every chunk above its limit: chunk_id, cut_kind (within: some piece had to be cut at words, as a sentence alone is above the limit, else between),
    piece_no (from 0), start_pos and end_pos of its own text (from 1, inclusive; together they are the chunk), shared_from (where
    the overlap begins), n_tokens (overlap included, never above the limit), cut_at (the separator it ends at), text.
    """
    lexicon = collection_lexicon(chunks) if lexicon is None else lexicon
    kind = dict(chunks.dtypes)["chunk_id"]
    return oversized(chunks, configs).mapInArrow(
        _cutting(lexicon), f"chunk_id {kind}, cut_kind string, piece_no int, start_pos int, end_pos int, shared_from int, n_tokens int, cut_at string, text string"
    )
