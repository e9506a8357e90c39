"""Reading level of documents (problem 10).

Interpolated n-gram models of easy, middle and hard sentences are trained on graded documents: sentences begin with their
document's grade and move, round by round, to the model that needs the fewest bits for them. Every grade has its mixture of the kinds;
the surprisals of all sentences of a document under the mixtures say how likely each grade is, and the grade expected from them is the
document's difficulty, which isotonic regression maps to the graders' scale. The full model and those of the folds that the map is
fitted on are trained side by side, each in a task of its own.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.arrays import mix64

GRADES = (1, 2, 3)
#: Graded documents that are fitted, at most.
LABELLED = 2000
#: Texts of which surprisals are held at a time.
SLICE = 200
FOLDS = 4
ROUNDS = 4
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*|[,;:]")
_CUT = re.compile(r"\n+|(?<=[.!?])\s+")
WORDS_OF_DOCUMENT = re.compile(r"\w+")


def sentences(text: str) -> list[list[str]]:
    """Words and inner punctuation of the sentences of three words or more; numbers and codes are one symbol."""
    out = []
    for s in _CUT.split(text):
        ws = ["0" if any(c.isdigit() for c in w) else w for w in _WORD.findall(s.lower())]
        if len(ws) >= 3:
            out.append(ws)
    return out


class NGrams:
    """Trigram models of all kinds of sentences, interpolated with shorter ones down to a uniform floor. A history seen T times
    weighs T / (T + held)."""

    def __init__(self, vocabulary: dict[str, int], held: float = 5.0, floor: float = 1e-4):
        self.vocabulary, self.held, self.floor = vocabulary, held, floor

    def coded(self, sents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all sentences, two marks before and one after each; and the sentence of each."""
        get = self.vocabulary.get
        lengths = np.array([len(s) + 3 for s in sents], np.int64)
        flat = np.fromiter((x for s in sents for x in (1, 1, *(get(w, 0) for w in s), 2)), np.int64, int(lengths.sum()))
        return flat, np.repeat(np.arange(len(sents)), lengths)

    @staticmethod
    def _grams(flat: np.ndarray, of: np.ndarray):
        at = np.flatnonzero((np.arange(len(flat)) >= 2) & (np.roll(of, 2) == of)) if len(flat) else np.zeros(0, np.int64)
        x = flat.astype(np.uint64) + np.uint64(1)
        m = np.uint64(0x9E3779B97F4A7C15)
        histories = [np.zeros(len(at), np.uint64), mix64(x[at - 1] * m), mix64(mix64(x[at - 2] * m) ^ x[at - 1])]
        return at, [(h, mix64(h ^ (x[at] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k)))) for k, h in enumerate(histories)]

    def fit(self, sents: list[list[str]], weights: np.ndarray) -> NGrams:
        """weights: a row per sentence, a column per kind."""
        flat, of = self.coded(sents)
        at, grams = self._grams(flat, of)
        w = weights[of[at]] if len(at) else np.zeros((0, weights.shape[1]))
        self.tables = []
        for history, gram in grams:
            pair = []
            for key in (history, gram):
                keys, belongs = np.unique(key, return_inverse=True)
                total = np.zeros((len(keys), weights.shape[1]))
                np.add.at(total, belongs, w)
                pair += [keys, total]
            self.tables.append(pair)
        self.kinds = weights.shape[1]
        return self

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros((len(asked), values.shape[1]))
        i = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where((keys[i] == asked)[:, None], values[i], 0)

    def bits(self, sents: list[list[str]]) -> np.ndarray:
        """Surprisal of each sentence under each kind's model, in bits."""
        out = np.zeros((len(sents), self.kinds))
        if not sents:
            return out
        flat, of = self.coded(sents)
        at, grams = self._grams(flat, of)
        p = np.full((len(at), self.kinds), self.floor)
        for (history, gram), (hk, ht, gk, gt) in zip(grams, self.tables):
            t = self._look(hk, ht, history)
            lam = t / (t + self.held)
            p = (1 - lam) * p + lam * self._look(gk, gt, gram) / np.maximum(t, 1e-9)
        np.add.at(out, of[at], -np.log2(p))
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing steps through (x, y): pooled adjacent violators. Returns knots for np.interp."""
    order = np.argsort(x, kind="stable")
    xs, start = np.unique(x[order], return_index=True)
    sums, counts = np.add.reduceat(y[order], start), np.diff(np.append(start, len(x)))
    blocks: list[list[float]] = []
    for v, n in zip(sums, counts):
        blocks.append([v, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n2, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n2, blocks[-1][2] + k]
    return xs, np.concatenate([np.full(int(k), s / n) for s, n, k in blocks])


class LevelModel:
    """Models of the kinds of sentences, how often each grade has them, and the monotone map to grades. The map is fitted on
    difficulties that models trained without the document give it."""

    def __init__(self, graded: list[tuple[str, int]], folds: int = FOLDS):
        docs = [(sentences(t), GRADES.index(g)) for t, g in graded]
        docs = [(s, g) for s, g in docs if s]
        seen: dict[str, int] = {}
        for s, _ in docs:
            for w in {w for x in s for w in x}:
                seen[w] = seen.get(w, 0) + 1
        least = 3 if len(docs) >= 100 else 1
        vocabulary = {w: i + 3 for i, w in enumerate(sorted(w for w, n in seen.items() if n >= least))}
        every = [x for s, _ in docs for x in s]
        grade = np.array([g for s, g in docs for _ in s], np.int64)
        n = len(GRADES)
        kind = np.eye(n)[grade] if len(grade) else np.zeros((0, n))
        self.models = NGrams(vocabulary).fit(every, kind)
        # Three bits for the document's own grade, so that a wrong grade doesn't hold its sentences.
        for _ in range(ROUNDS):
            cost = self.models.bits(every) - 3.0 * kind_of(grade, n)
            self.models = NGrams(vocabulary).fit(every, np.eye(n)[cost.argmin(axis=1)] if len(every) else kind)
        counts = np.ones((n, n)) + 4 * np.eye(n)
        if len(every):
            np.add.at(counts, (grade, self.models.bits(every).argmin(axis=1)), 1)
        self.mix = counts / counts.sum(axis=1, keepdims=True)
        self.knots = (np.array([1.0, 3.0]), np.array([1.0, 3.0]))
        if folds and len(graded) >= 10 * folds:
            self.fit_map([held_out(graded, f, folds) for f in range(folds)])

    def fit_map(self, folds: list[list[tuple[float, int]]]) -> None:
        """The monotone map from (difficulty, grade) of documents that their difficulty's model has not seen."""
        scores, levels = (np.array([x[k] for f in folds for x in f], float) for k in (0, 1))
        if len(set(levels.tolist())) > 1:
            self.knots = isotonic(scores, levels)

    def _expected(self, bits: np.ndarray) -> float:
        """The grade to expect from the surprisals (a row for each sentence, a column for each kind) of a document."""
        log = np.log2(self.mix)[None, :, :] - bits[:, None, :]
        most = log.max(axis=2)
        total = (most + np.log2(np.exp2(log - most[:, :, None]).sum(axis=2))).sum(axis=0)
        p = np.exp2(total - total.max())
        return float((p * np.array(GRADES)).sum() / p.sum())

    def levels(self, texts: list[str]) -> list[tuple[float, int, float]]:
        """(difficulty, grade, mean bits per word under the model that fits best) of each text."""
        return [x for low in range(0, len(texts), SLICE) for x in self._levels(texts[low : low + SLICE])]

    def _levels(self, texts: list[str]) -> list[tuple[float, int, float]]:
        parts = [sentences(t) for t in texts]
        bits = self.models.bits([s for p in parts for s in p])
        words = np.array([len(s) for p in parts for s in p], float)
        out, low = [], 0
        for p in parts:
            b, w = bits[low : low + len(p)], words[low : low + len(p)]
            low += len(p)
            score = self._expected(b) if len(p) else float(GRADES[0])
            level = float(np.interp(score, *self.knots))
            out.append((score, int(np.clip(np.floor(level + 0.5), GRADES[0], GRADES[-1])), float(b.min(axis=1).sum() / w.sum()) if len(p) else 0.0))
        return out


def held_out(graded: list[tuple[str, int]], fold: int, folds: int) -> list[tuple[float, int]]:
    """(difficulty, grade) of a fold's documents by a model of the others; equal texts are in one fold."""
    of = [mix_text(t) % folds for t, _ in graded]
    rest = LevelModel([x for x, k in zip(graded, of) if k != fold], folds=0)
    mine = [x for x, k in zip(graded, of) if k == fold]
    return [(x[0], g) for x, (_, g) in zip(rest.levels([t for t, _ in mine]), mine)]


def trained(spark: SparkSession, graded: list[tuple[str, int]], folds: int = FOLDS) -> LevelModel:
    """LevelModel(graded), with the model and each fold trained in tasks of their own. graded is bounded (see graded_sample)."""
    if len(graded) < 10 * folds:
        return LevelModel(graded, folds)
    sent = spark.sparkContext.broadcast(graded)

    def train(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                made = LevelModel(sent.value, folds=0) if k == folds else held_out(sent.value, k, folds)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pickle.dumps(made)], pa.binary())], ["fold", "made"])

    rows = spark.range(0, folds + 1, 1, folds + 1).mapInArrow(train, "fold long, made binary").collect()
    made = {r["fold"]: pickle.loads(r["made"]) for r in rows}
    model = made.pop(folds)
    model.fit_map([made[k] for k in sorted(made)])
    return model


def mix_text(text: str) -> int:
    return int(mix64(np.array([zlib.crc32(text.encode("utf-8", "replace"))], np.uint64))[0] >> np.uint64(8))


def kind_of(grade: np.ndarray, n: int) -> np.ndarray:
    return np.eye(n)[grade] if len(grade) else np.zeros((0, n))


def graded_sample(documents: DataFrame, labels: DataFrame, most: int = LABELLED) -> list[tuple[str, int]]:
    """(text, grade) of up to `most` grades, spread by the document's hash; a document graded twice counts twice."""
    good = labels.filter(F.col("grade").isin(*GRADES)).select("doc_id", F.col("grade").cast("int").alias("grade"))
    every = max(1, good.count() // most)
    good = good.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    rows = documents.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(good.limit(2 * most)), "doc_id").collect()
    return [(r["text"], r["grade"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["grade"]))]


def _levelling(model, least_words: int):
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            keep = [i for i, t in enumerate(texts) if len(WORDS_OF_DOCUMENT.findall(t)) >= least_words]
            found = model.value.levels([texts[i] for i in keep])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array([x[1] for x in found], pa.int32()), pa.array([x[0] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())],
                ["doc_id", "grade", "difficulty", "bits_per_word"],
            )

    return run


def reading_levels(english: DataFrame, model: LevelModel, least_words: int = 40) -> DataFrame:
    """(doc_id, text) of English documents -> doc_id, grade, difficulty, bits_per_word. Documents below least_words (null and empty
    texts among them) have no row; repeated doc_ids keep theirs; whole texts are read."""
    shared = english.sparkSession.sparkContext.broadcast(model)
    kind = dict(english.dtypes)["doc_id"]
    return english.select("doc_id", "text").mapInArrow(_levelling(shared, least_words), f"doc_id {kind}, grade int, difficulty double, bits_per_word double")
