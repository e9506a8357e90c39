"""Languages of texts and of the stretches within them (problem 5).

Per language a context tree of bytes, of variable order up to five, is counted on labelled texts and frozen. Prediction by partial
matching gives each byte its exact code length: the longest context seen is asked first, and an unseen byte pays the escape to
the next shorter one. A context never reaches beyond its word (for scripts without spaces: beyond the character before), so the
code length of a word is a number per language and words met before are looked up.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrays import mix64
from corpusloom.session import spread

LANGUAGES = ("en", "vi", "de", "fr", "es", "zh", "ja", "hi")
#: Three-letter codes (ISO 639-2, both forms) and English names of the languages: fixed values.
NAMES = {
    "en": ("eng", "english"),
    "vi": ("vie", "vietnamese"),
    "de": ("deu", "ger", "german"),
    "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish"),
    "zh": ("zho", "chi", "chinese"),
    "ja": ("jpn", "japanese"),
    "hi": ("hin", "hindi"),
}
ORDER = 5
#: Texts per language of the training sample, at most.
PER_LANGUAGE = 400
#: Bits by which a sentence must be shorter in another language than in the text's main one.
MARGIN = 12.0
#: Languages written in scripts of their own. To them a word of Latin letters is a name: it costs what the Latin language that
#: knows it best takes, and FOREIGN bits.
OWN_SCRIPT = ("zh", "ja", "hi")
FOREIGN = 3.0
_OWN = [LANGUAGES.index(x) for x in OWN_SCRIPT]

_CJK = r"぀-ヿ㐀-鿿"
_TOKEN = re.compile(rf"[{_CJK}]+|(?:(?![{_CJK}])[^\W\d_]|[̀-ͯऀ-ॣ॰-ॿ'’])+")
_IS_CJK = re.compile(rf"[{_CJK}]")
_CLOSING = r"[\"'”’»«)\]）】」』]*"
#: An end mark of scripts without spaces, or one before white space and no small letter or digit, or a line break.
_UNIT = re.compile(rf"(?:[^.!?。！？।\n]|[.!?]+(?!{_CLOSING}(?:\s+[^\sa-z0-9]|\s*\Z|[{_CJK}ऀ-ॿ])))*(?:[。！？।]+{_CLOSING}|[.!?]+{_CLOSING}|\n\s*|\Z)")
_TERMINAL = re.compile(rf"[.!?。！？।]{_CLOSING}\Z")
_BULLET = re.compile(r"\s*(?:[-*•–]|\d+[.)])(?:\s|\Z)")
_IMAGE = re.compile(r"!\[[^\]\n]*\]\([^)\n]*\)")
_LETTER = re.compile(r"[^\W\d_]")


def label_language(label: Column) -> Column:
    """The two-letter code that a label names, or null: by code, code with region or script, three-letter code or English name, in
    any case and with any white space around."""
    low = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    head = F.regexp_extract(low, r"^([a-z]+)(?:[-_].*)?$", 1)
    named = F.create_map(*[F.lit(x) for code in LANGUAGES for name in (code, *NAMES[code]) for x in (name, code)])
    return F.coalesce(named[low], named[head])


def units(text: str) -> list[str]:
    """Pieces of a text, each up to and with the next end mark or line break."""
    return [u for u in _UNIT.findall(text) if u]


def tokens(piece: str) -> list[str]:
    """Words; of scripts without spaces each character behind the one before it ('\\0' at the beginning). References to images hold none."""
    out = []
    if "![" in piece:
        piece = _IMAGE.sub(" ", piece)
    for t in _TOKEN.findall(piece.lower()):
        if _IS_CJK.match(t):
            out.extend(map("".join, zip("\0" + t, t)))
        else:
            out.append(t)
    return out


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words with a boundary before each, word number of each byte, and which bytes are scored."""
    parts, scored = [], []
    for w in words:
        if len(w) == 2 and _IS_CJK.match(w[1]):
            before, own = w[0].encode(), w[1].encode()
        else:
            before, own = b" ", w.encode("utf-8", "replace") + b" "
        parts.append(before + own)
        scored.append(b"\0" * len(before) + b"\1" * len(own))
    lengths = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64), np.repeat(np.arange(len(words)), lengths), np.frombuffer(b"".join(scored), np.uint8) == 1


def _contexts(codes: np.ndarray, word: np.ndarray, scored: np.ndarray):
    """For each order, from the longest: positions that have such a context, keys of the context and of context with byte."""
    n = len(codes)
    key = np.zeros(n, np.uint64)
    inside = np.ones(n, bool)
    per_order = []
    for k in range(ORDER + 1):
        if k:
            shifted, same = np.zeros(n, np.uint64), np.zeros(n, bool)
            shifted[k:], same[k:] = codes[:-k] + np.uint64(1), word[k:] == word[:-k]
            inside = inside & same
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + shifted)
        at = np.flatnonzero(inside & scored)
        context = key[at] + np.uint64(k)
        per_order.append((at, mix64(context), mix64(context ^ (codes[at] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))))
    return per_order[::-1]


class ByteModels:
    """Frozen context trees of all languages. counts: for each order, sorted keys with one column per language."""

    def __init__(self, word_counts: dict[str, Counter]):
        n = len(LANGUAGES)
        words = sorted({w for c in word_counts.values() for w in c})
        weight = np.zeros((len(words), n), np.float64)
        place = {w: i for i, w in enumerate(words)}
        for j, lang in enumerate(LANGUAGES):
            for w, c in word_counts.get(lang, {}).items():
                weight[place[w], j] = c
        self.orders = []
        codes, word, scored = _coded(words) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))
        for at, context, symbol in _contexts(codes, word, scored):
            symbols, first, of = np.unique(symbol, return_index=True, return_inverse=True)
            seen = np.zeros((len(symbols), n))
            np.add.at(seen, of, weight[word[at]])
            contexts, belongs = np.unique(context[first], return_inverse=True)
            total, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(total, belongs, seen)
            np.add.at(kinds, belongs, seen > 0)
            # Method C: a byte seen c times in T has c / (T + kinds), the escape has kinds / (T + kinds).
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2(total + kinds) - np.log2(kinds), 0)
                bits = np.where(seen > 0, np.log2((total + kinds)[belongs]) - np.log2(seen), np.inf)
            self.orders.append((symbols, bits.astype(np.float32), contexts, escape.astype(np.float32)))

    def bits(self, words: list[str]) -> np.ndarray:
        """Code lengths, one row per word and one column per language."""
        n = len(LANGUAGES)
        codes, word, scored = _coded(words)
        cost, open_ = np.zeros((len(codes), n), np.float32), np.repeat(scored[:, None], n, axis=1)
        for (at, context, symbol), (symbols, bits, contexts, escape) in zip(_contexts(codes, word, scored), self.orders):
            if not len(symbols):
                continue
            c = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            known = contexts[c] == context
            at, symbol, c = at[known], symbol[known], c[known]
            s = np.minimum(np.searchsorted(symbols, symbol), len(symbols) - 1)
            b = np.where((symbols[s] == symbol)[:, None], bits[s], np.inf)
            found = np.isfinite(b)
            mine = open_[at]
            cost[at] += np.where(mine, np.where(found, b, escape[c]), 0)
            open_[at] = mine & ~found
        cost += np.where(open_, 8, 0)  # no context knows the byte
        out = np.zeros((len(words), n), np.float32)
        np.add.at(out, word, cost)
        latin = np.fromiter((w[-1] < "\u0370" or "\u1e00" <= w[-1] < "\u1f00" for w in words), bool, len(words))
        best = np.delete(out, _OWN, axis=1).min(axis=1)
        out[np.ix_(latin, _OWN)] = best[latin, None] + FOREIGN
        return np.concatenate([out, ~latin[:, None]], axis=1)  # the last column counts words in a script of their own


class Scorer:
    """Scores batches of texts; words met before are looked up (up to a number of words, then from the start)."""

    def __init__(self, models: ByteModels, most_words: int = 400_000):
        self.models, self.most = models, most_words
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((0, len(LANGUAGES) + 1), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        place = self.place
        if len(place) > self.most:
            self.clear()
            place = self.place
        before = len(place)
        for w in words:
            if w not in place:
                place[w] = len(place)
        if len(place) > before:
            new = list(place)[before:]
            self.table = np.concatenate([self.table, self.models.bits(new)])
        return np.fromiter(map(place.__getitem__, words), np.int64, len(words))

    def texts(self, texts: list[str]) -> list[tuple[int, float, list[tuple[int, int, int, float, bool]]]]:
        """For each text: its main language (number, -1 without words), confidence, and its stretches: (first character, end,
        language, confidence, whether it holds a whole sentence)."""
        pieces, owner, words, count = [], [], [], []
        for i, t in enumerate(texts):
            for u in units(t):
                ts = tokens(u)
                pieces.append(u)
                owner.append(i)
                count.append(len(ts))
                words.extend(ts)
        n = len(LANGUAGES) + 1
        count_, owner_ = np.array(count, np.int64), np.array(owner, np.int64)
        per_word = self.table[at] if len(at := self.rows(words)) else np.zeros((0, n), np.float32)
        total = np.concatenate([np.zeros((1, n)), np.cumsum(per_word, axis=0, dtype=np.float64)])
        ends = np.cumsum(count_)
        cost = total[ends] - total[ends - count_] if len(count_) else np.zeros((0, n))
        # Units up to an end mark or a blank line make a sentence.
        stops = np.array([bool(_TERMINAL.search(u.rstrip())) or u.count("\n") > 1 for u in pieces], bool)
        whole = np.array([bool(_TERMINAL.search(u.rstrip())) for u in pieces], bool)
        # So does an item of a list, with or without an end mark.
        bullet = np.array([bool(_BULLET.match(u)) for u in pieces], bool)
        following = np.concatenate([bullet[1:] | (owner_[1:] != owner_[:-1]), [True]]) if len(pieces) else bullet
        stops |= following
        whole |= following & bullet
        lengths = np.array([len(u) for u in pieces], np.int64)
        letters = np.array([len(_LETTER.findall(u)) for u in pieces], np.int64)
        # A stretch of another language is given up to the text's main one unless it is sure (see _one).
        out = []
        bounds = np.searchsorted(owner_, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            low, high = bounds[i], bounds[i + 1]
            out.append(self._one(per_word[ends[low] - count_[low] : ends[high - 1]] if high > low else per_word[:0], cost[low:high], count_[low:high], stops[low:high], whole[low:high], lengths[low:high], letters[low:high]))
        return out

    @staticmethod
    def _one(words, cost, count, stops, whole, lengths, letters):
        if not count.sum():
            return -1, 0.0, []
        first = np.flatnonzero(np.concatenate([[True], stops[:-1]]))
        c, k, chars = np.add.reduceat(cost, first), np.add.reduceat(count, first), np.add.reduceat(letters, first)
        last = np.concatenate([first[1:], [len(count)]]) - 1
        done = whole[last]
        c[:, _OWN] += np.where(c[:, -1:] > 0, 0, 1e6)  # no such language without its script
        scripted = c[:, -1] > 0
        c, words, cost = c[:, :-1], words[:, :-1], cost[:, :-1]
        best = c.argmin(axis=1)
        share = np.bincount(best[k > 0], weights=chars[k > 0], minlength=len(LANGUAGES))
        main = int(share.argmax())
        lang = np.full(len(first), main)
        sure = np.zeros(len(first), bool)
        upto = np.cumsum(count)
        for s in np.flatnonzero((best != main) & (k > 0)):
            other = int(best[s])
            if scripted[s] and other not in _OWN:
                continue  # a running header before the end of a sentence in a script of its own
            # Headings and torn ends, which are no whole sentences, need more.
            if c[s, main] - c[s, other] < (MARGIN if done[s] else 4 * MARGIN):
                continue
            lines = slice(first[s], last[s] + 1)
            end = upto[last[s]]
            by_word = words[end - k[s] : end, main] - words[end - k[s] : end, other]
            if (by_word > 1).sum() < 2 or (by_word > 1).sum() < 2 * (by_word < -1).sum():
                continue
            gain, size = cost[lines, main] - cost[lines, other], count[lines]
            # A running header before a sentence is no part of it: every line, and the last in any case, must agree.
            # Short lines without an end mark, which may all be headers, don't count for it.
            solid = gain[(size > 4) | whole[lines]].sum() if len(gain) > 1 else gain[0]
            if gain[size > 0][-1] > 0 and (gain[size >= 4] > 0).all() and solid >= MARGIN:
                lang[s], sure[s] = other, done[s]
        sure[(lang == main) & done & (k > 0)] = True
        ends = np.cumsum(lengths)
        stretches = []
        change = np.flatnonzero(np.concatenate([[True], lang[1:] != lang[:-1]]))
        for a, b in zip(change, np.concatenate([change[1:], [len(lang)]])):
            gap = np.partition(c[a:b].sum(axis=0) - c[a:b, lang[a]].sum(), 1)[1] if k[a:b].sum() else 0.0
            start = int(ends[first[a]] - lengths[first[a]])
            stretches.append((start, int(ends[last[b - 1]]), int(lang[a]), _confidence(gap), bool(sure[a:b].any())))
        rest = np.partition(c.sum(axis=0) - c[:, main].sum(), 1)[1]
        return main, _confidence(rest), stretches


def _confidence(bits: float) -> float:
    """Chance of the language against its nearest rival, from the bits it saves."""
    return float(1 / (1 + 2.0 ** -min(60.0, max(-60.0, bits))))


def train(labelled: list[tuple[str, str]]) -> ByteModels:
    """Models from (language, text); a second round counts each stretch for the language that the first one finds it in."""
    counts: dict[str, Counter] = {}
    for lang, text in labelled:
        counts.setdefault(lang, Counter()).update(tokens(text))
    scorer = Scorer(ByteModels(counts))
    again: dict[str, Counter] = {}
    for (_, text), (_, _, stretches) in zip(labelled, scorer.texts([t for _, t in labelled])):
        for start, end, found, _, _ in stretches:
            again.setdefault(LANGUAGES[found], Counter()).update(tokens(text[start:end]))
    return ByteModels(again)


def training_sample(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """Some per_language texts of each label from (key, text, label), spread over the table by the key's hash."""
    rows = labelled.select("key", "text", label_language(F.col("label")).alias("lang")).filter(F.col("lang").isNotNull() & (F.length("text") >= 40))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    every = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, max(1, n // per_language))]) if sizes else None
    if every is None:
        return []
    some = rows.filter(F.pmod(F.xxhash64("key"), every[F.col("lang")]) == 0).select("lang", "text", F.xxhash64("key").alias("h"))
    taken: dict[str, list] = {}
    for r in some.limit(4 * per_language * len(sizes)).collect():
        taken.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return [(lang, t) for lang in sorted(taken) for _, t in sorted(taken[lang])[:per_language]]


_FOUND = "key string, lang string, confidence double, segments array<struct<first:int,end:int,lang:string,confidence:double,whole:boolean>>"


def _detecting(models, with_text):
    def run(batches):
        scorer = Scorer(models.value)
        kind = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("whole", pa.bool_())])
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                found = scorer.texts([t or "" for t in part.column(1).to_pylist()])
                langs = [LANGUAGES[m] if m >= 0 else None for m, _, _ in found]
                segments = [[{"first": a, "end": b, "lang": LANGUAGES[m], "confidence": c, "whole": w} for a, b, m, c, w in s] for _, _, s in found]
                columns = [part.column(0), pa.array(langs, pa.string()), pa.array([c for _, c, _ in found]), pa.array(segments, pa.list_(kind))]
                names = ["key", "lang", "confidence", "segments"]
                if with_text:
                    columns.insert(1, part.column(1))
                    names.insert(1, "text")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def detect_languages(texts: DataFrame, models: ByteModels, text: bool = False) -> DataFrame:
    """(key string, text) -> key, lang, confidence, segments (first: from 0, end: exclusive, lang, confidence, whole: it holds a
    sentence with its end mark). lang and segments are null and empty for null texts and texts without words. Repeated keys are
    kept; the whole text is read, whatever its length. text: the texts come along."""
    shared = texts.sparkSession.sparkContext.broadcast(models)
    kind = _FOUND.replace("lang string", "text string, lang string", 1) if text else _FOUND
    return spread(texts.select(F.col("key").cast("string"), "text")).mapInArrow(_detecting(shared, text), kind)


def languages_held(found: DataFrame) -> Column:
    """Languages of which the text holds a whole sentence, and its main one."""
    whole = F.transform(F.filter("segments", lambda s: s["whole"]), lambda s: s["lang"])
    return F.array_distinct(F.when(F.col("lang").isNull(), whole).otherwise(F.concat(F.array("lang"), whole)))
