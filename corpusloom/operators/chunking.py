"""Documents into sentences, stable units, semantic chunks and their statistics.

A document is one row, so nothing is shuffled: each batch of rows is parsed, embedded and folded where it is read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.functions.models import hash_embedding
from corpusloom.functions.text import IMAGE_REF, SENTENCE
from corpusloom.operators.prefix import previous, running_sum
from corpusloom.session import spread

_WS = re.compile(r"[\t-\r \x85\xa0  -     　]+")
_SENTENCE = re.compile(SENTENCE)
_IMAGE = re.compile(IMAGE_REF)
_NUMERIC = re.compile(r"[\d .,:;%+/()\-]+")
COUNTS = ("n_raw", "n_kept", "n_header", "n_numeric", "n_noise", "n_merged")


@dataclass(frozen=True)
class ChunkConfig:
    """Limits of chunks; values that aren't above zero, and a similarity of one or more, mean the defaults."""

    min_chars: int = 20
    min_tokens: int = 8
    max_tokens: int = 160
    similarity: float = 0.85
    overlap: int = 1

    def effective(self) -> ChunkConfig:
        plain = ChunkConfig()
        return replace(self, **{k: getattr(plain, k) for k, v in vars(self).items() if v is None or v <= 0 or (k == "similarity" and v >= 1)})


@dataclass
class Chunk:
    text: str
    images: list[str] = field(default_factory=list)
    vector: np.ndarray | None = None


def squeeze(t: str) -> str:
    return _WS.sub(" ", t).strip(" ")


def n_tokens(t: str) -> int:
    s = squeeze(t)
    return s.count(" ") + 1 if s else 0


def simple_sentences(t: str) -> list[str]:
    s = squeeze(t)
    found = [x for x in (m[0].strip(" ") for m in _SENTENCE.findall(s)) if x]
    return found or ([s] if s else [])


def is_short(t: str, c: ChunkConfig) -> bool:
    return len(squeeze(t)) < c.min_chars or n_tokens(t) < c.min_tokens


def unit_kind(s: str, c: ChunkConfig, has_previous: bool) -> str:
    """What becomes of a sentence of a line: header, numeric and noise are dropped, a fragment joins the one before."""
    if s.startswith("#") or not s.strip("#- "):
        return "header"
    if _NUMERIC.fullmatch(s) and any(x.isdecimal() for x in s):
        return "numeric"
    if has_previous and (n_tokens(s) <= 3 or len(s) < c.min_chars // 2):
        return "fragment"
    if is_short(s, c) and not any(x.isalpha() for x in s):
        return "noise"
    return "unit"


def stable_units(line: str, c: ChunkConfig) -> tuple[list[str], dict[str, int]]:
    """Units of one line and the counts of what happened. A short first unit goes to the second, every other short one to the unit
    before it."""
    counts = dict.fromkeys(COUNTS, 0)
    units: list[str] = []
    for s in simple_sentences(line):
        counts["n_raw"] += 1
        kind = unit_kind(s, c, bool(units))
        if kind == "unit":
            units.append(s)
        elif kind == "fragment":
            units[-1] = f"{units[-1]} {s}"
            counts["n_merged"] += 1
        else:
            counts[f"n_{kind}"] += 1
    if len(units) > 1 and is_short(units[0], c):
        units[:2] = [f"{units[0]} {units[1]}"]
        counts["n_merged"] += 1
    out: list[str] = []
    for u in units:
        if out and is_short(u, c):
            out[-1] = f"{out[-1]} {u}"
            counts["n_merged"] += 1
        else:
            out.append(u)
    counts["n_kept"] = len(out)
    return out, counts


def parse_document(text: str, c: ChunkConfig) -> tuple[list[Chunk], dict[str, int]]:
    """Chunks of single units with their images, and the document's counts. Images of a line go to the unit before that line;
    those before any unit are lost."""
    chunks: list[Chunk] = []
    total = dict.fromkeys(COUNTS, 0)
    for line in text.split("\n"):
        images = [m.strip() for m in _IMAGE.findall(line)]
        if chunks:
            chunks[-1].images.extend(images)
        units, counts = stable_units(_IMAGE.sub("", line) if images else line, c)
        chunks.extend(Chunk(u) for u in units)
        for k, n in counts.items():
            total[k] += n
    return chunks, total


def valid_vectors(chunks: list[Chunk]) -> tuple[list[Chunk], int, int]:
    """Chunks with a vector of the first kept one's length and a norm; and how many had no norm, and another length."""
    kept: list[Chunk] = []
    zero = odd = 0
    for x in chunks:
        v = x.vector
        if v is None or not len(v) or np.linalg.norm(v.astype(np.float64)) < 1e-12:
            zero += 1
        elif kept and len(v) != len(kept[0].vector):
            odd += 1
        else:
            kept.append(x)
    return kept, zero, odd


def merge_similar(chunks: list[Chunk], c: ChunkConfig) -> list[Chunk]:
    """Neighbours at or above the similarity become one chunk while it stays within the tokens; its vector is the members' mean.
    Similarity is that of the two neighbours, whatever they were merged to."""
    groups: list[list[Chunk]] = []
    texts: list[str] = []
    for before, x in zip([None, *chunks], chunks):
        joined = squeeze(f"{texts[-1]} {x.text}") if texts else x.text
        if before is not None:
            a, b = before.vector.astype(np.float64), x.vector.astype(np.float64)
            similar = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= c.similarity
            if similar and (c.max_tokens <= 0 or n_tokens(joined) <= c.max_tokens):
                groups[-1].append(x)
                texts[-1] = joined
                continue
        groups.append([x])
        texts.append(x.text)
    return [Chunk(t, [i for x in g for i in x.images], np.mean([x.vector for x in g], axis=0)) for t, g in zip(texts, groups)]


def _joined(a: Chunk, b: Chunk) -> Chunk:
    """Two chunks as one; the vector is the plain mean of the two."""
    return Chunk(squeeze(f"{a.text} {b.text}"), [*a.images, *b.images], (a.vector + b.vector) / 2)


def repair_short(chunks: list[Chunk], c: ChunkConfig) -> list[Chunk]:
    """A short first chunk goes into the next until it isn't short; any other goes into the one before. The last one left may be short."""
    rest = list(chunks)[::-1]
    out: list[Chunk] = []
    while rest:
        x = rest.pop()
        if is_short(x.text, c) and out:
            out[-1] = _joined(out[-1], x)
        elif is_short(x.text, c) and rest:
            rest.append(_joined(x, rest.pop()))
        else:
            out.append(x)
    return out


def split_long(chunks: list[Chunk], c: ChunkConfig) -> list[Chunk]:
    """Chunks above the tokens are packed anew from their sentences; the pieces share the vector and the last has the images. A single
    long sentence stays."""
    if c.max_tokens <= 0:
        return chunks
    out: list[Chunk] = []
    for x in chunks:
        sentences = simple_sentences(x.text)
        if n_tokens(x.text) <= c.max_tokens or len(sentences) < 2:
            out.append(x)
            continue
        packed: list[str] = []
        for s in sentences:
            if packed and n_tokens(packed[-1]) + n_tokens(s) <= c.max_tokens:
                packed[-1] = f"{packed[-1]} {s}"
            else:
                packed.append(s)
        out.extend(Chunk(p, [], x.vector) for p in packed)
        out[-1].images = list(x.images)
    return out


def overlap_sentences(chunks: list[Chunk], n: int) -> list[Chunk]:
    """Each chunk begins with the last n sentences of the one before, which has its own overlap already."""
    out = list(chunks[:1])
    for x in chunks[1:]:
        head = " ".join(simple_sentences(out[-1].text)[-n:]) if n > 0 else ""
        out.append(Chunk(squeeze(f"{head} {x.text}"), x.images, x.vector))
    return out


#: Texts that a model gets at a time.
EMBEDDED_AT_ONCE = 2048


def chunk_texts(texts: list[str], c: ChunkConfig, embed: Callable[[list[str]], np.ndarray]) -> list[list[Chunk]]:
    """The whole way of documents: units, vectors (of all documents together), merge, repair, split, overlap."""
    parsed = [parse_document(t, c)[0] for t in texts]
    flat = [x for chunks in parsed for x in chunks]
    for low in range(0, len(flat), EMBEDDED_AT_ONCE):
        some = flat[low : low + EMBEDDED_AT_ONCE]
        for x, v in zip(some, embed([x.text for x in some])):
            x.vector = v
    return [overlap_sentences(split_long(repair_short(merge_similar(valid_vectors(chunks)[0], c), c), c), c.overlap) for chunks in parsed]


def chunk_text(text: str, c: ChunkConfig, embed: Callable[[list[str]], np.ndarray]) -> tuple[list[Chunk], dict[str, int]]:
    """Chunks of one document, and the counts of its units."""
    return chunk_texts([text], c, embed)[0], parse_document(text, c)[1]


def _chunking(c: ChunkConfig, embed):
    def run(batches):
        for batch in batches:
            at, index, texts, images, vectors = [], [], [], [], []
            for i, chunks in enumerate(chunk_texts([t or "" for t in batch.column(1).to_pylist()], c, embed)):
                for k, x in enumerate(chunks):
                    at.append(i)
                    index.append(k)
                    texts.append(x.text)
                    images.append(x.images)
                    vectors.append(np.asarray(x.vector, np.float32))
            take = pa.array(at, pa.int64())
            kept = [batch.column(n).take(take) for n in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take), pa.array(index, pa.int32()), pa.array(texts, pa.string()), pa.array(images, pa.list_(pa.string())),
                    pa.array(vectors, pa.list_(pa.float32())), pa.array([n_tokens(t) for t in texts], pa.int32()), *kept,
                ],
                ["doc_id", "chunk_index", "text", "image_paths", "vector", "n_tokens", *batch.schema.names[2:]],
            )

    return run


def chunk_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: ChunkConfig | None = None, embed: Callable | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, chunk_index (from 0), text, image_paths, vector, n_tokens, and the columns `keep` of the document. Null and blank texts
    give no chunk."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`") for c in keep])
    kinds = dict(rows.dtypes)
    schema = f"doc_id {kinds['doc_id']}, chunk_index int, text string, image_paths array<string>, vector array<float>, n_tokens int" + "".join(f", `{c}` {kinds[c]}" for c in keep)
    return spread(rows).mapInArrow(_chunking((config or ChunkConfig()).effective(), embed or hash_embedding), schema)


def _units(c: ChunkConfig):
    def run(batches):
        for batch in batches:
            at, line_no, unit_no, texts = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for k, line in enumerate((t or "").split("\n")):
                    for j, u in enumerate(stable_units(_IMAGE.sub("", line), c)[0]):
                        at.append(i)
                        line_no.append(k)
                        unit_no.append(j)
                        texts.append(u)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(line_no, pa.int32()), pa.array(unit_no, pa.int32()), pa.array(texts, pa.string())],
                ["doc_id", "line_no", "unit_no", "unit"],
            )

    return run


def stable_unit_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: ChunkConfig | None = None) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return spread(rows).mapInArrow(_units((config or ChunkConfig()).effective()), f"doc_id {dict(rows.dtypes)['doc_id']}, line_no int, unit_no int, unit string")


def _counting(c: ChunkConfig):
    def run(batches):
        for batch in batches:
            counts = [parse_document(t or "", c)[1] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[k] for x in counts], pa.int64()) for k in COUNTS]], ["doc_id", *COUNTS])

    return run


def unit_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: ChunkConfig | None = None) -> DataFrame:
    """Per document: raw, kept, dropped (header, numeric, noise) and merged sentences, over its lines."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return spread(rows).mapInArrow(_counting((config or ChunkConfig()).effective()), f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"{k} long" for k in COUNTS))


def semantic_groups(rows: DataFrame, keys: list[str], order: str, vector: str, threshold: float) -> DataFrame:
    """rows with group_no (from 0): a row whose cosine with the one before is under the threshold begins a group. Rows without a
    usable vector must be removed before."""
    joined = previous(rows, keys, order, [vector])
    new = F.when(V.cosine(F.col(f"prev_{vector}"), F.col(vector)) >= threshold, 0).otherwise(1)
    return running_sum(joined, keys, order, new, "group_no").withColumn("group_no", F.col("group_no") - 1).drop(f"prev_{vector}")


def rank_percentile(values: Column, p: int) -> Column:
    """The item at p percent of a sorted array, position cut to a whole number; 0 if it is empty."""
    n = F.size(values)
    at = F.lit(0) if p <= 0 else n - 1 if p >= 100 else F.floor((n - 1) * F.lit(p / 100.0)).cast("int")
    return F.when(n == 0, 0).otherwise(F.element_at(values, at + 1))


def percentiles_of_counts(df: DataFrame, keys: list[str], value: str, ps: tuple[int, ...]) -> DataFrame:
    """rank_percentile of a column per keys, from the counts of its distinct values, so no group is gathered: keys, n, p<p>, most."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), F.col("__n").alias("n"))))
    # Distinct values are few (token counts), so the array is bounded by their range.
    g = counts.groupBy(*keys).agg(pairs.alias("vs"), F.sum("__n").alias("n"))
    out = [F.col(k) for k in keys] + [F.col("n")]
    for p in ps:
        at = F.floor((F.col("n") - 1) * F.lit(p / 100.0))
        found = F.aggregate(
            "vs", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast(dict(df.dtypes)[value]).alias("v")),
            lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.coalesce(s["v"], F.when(s["seen"] + x["n"] > at, x["v"])).alias("v")),
        )
        out.append(found["v"].alias(f"p{p}"))
    out.append(F.element_at("vs", -1)["v"].alias("most"))
    return g.select(*out)
