"""From documents to points: chunks with text vectors, image vectors beside them, payload, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.chunking import ChunkConfig, chunk_documents
from corpusloom.operators.collection import CollectionSchema, Collections, VectorConfig
from corpusloom.operators.filters import Condition, Filter
from corpusloom.operators.prefix import running_sum
from corpusloom.operators.search import exists
from corpusloom.session import written

BATCH, MOST_BATCH = 20, 200


def batch_size(asked: int | None, configured: int | None = None) -> int:
    """The request's, else the configured one, else 20; never above 200."""
    n = next((x for x in (asked, configured) if x and x > 0), BATCH)
    return min(n, MOST_BATCH)


def points_of_documents(docs: DataFrame, config: ChunkConfig | None = None, images: DataFrame | None = None, embed=None) -> DataFrame:
    """docs (doc_id, text, lang, source_path) -> points. The id is a hash of document and chunk number, so ingesting again overwrites.
    images: image_path, image_vector, joined by each chunk's first image; chunks whose image has none keep their text vector."""
    chunks = chunk_documents(docs, "doc_id", "text", config, embed, keep=("lang", "source_path"))
    p = chunks.withColumn("image_path", F.try_element_at("image_paths", F.lit(1)))
    if images is not None:
        p = p.join(images.select("image_path", F.col("image_vector").alias("image_dense")), "image_path", "left")
    else:
        p = p.withColumn("image_dense", F.lit(None).cast("array<float>"))
    return p.select(
        F.xxhash64("doc_id", "chunk_index").cast("string").alias("id"), F.col("vector").alias("text_dense"), "image_dense", F.col("doc_id").cast("string").alias("doc_id"),
        "source_path", F.lit(0).alias("page"), F.lit("text").alias("modality"), F.lit("chunk").alias("unit_type"), "text", F.col("image_path"), "lang",
        F.lit(False).alias("has_table"), F.col("image_path").isNotNull().alias("has_figure"), "chunk_index", F.col("n_tokens").alias("token_count"),
    )


def tallies(points: DataFrame) -> DataFrame:
    """inserted and skipped points per document: a point without any vector is skipped."""
    has = F.coalesce(F.size("text_dense") > 0, F.lit(False)) | F.coalesce(F.size("image_dense") > 0, F.lit(False))
    return points.groupBy("doc_id").agg(F.count_if(has).alias("n_inserted"), F.count_if(~has).alias("n_skipped"))


def ingest(docs: DataFrame, collections: Collections, name: str, config: ChunkConfig | None = None, dim: int = 64) -> DataFrame:
    """Writes the documents' points to a collection (made if there is none) in one commit and gives doc_id, n_points, verified of the
    documents that were asked for: verified means that the collection now holds points of it."""
    collections.ensure(CollectionSchema(name, [VectorConfig("text_dense", dim), VectorConfig("image_dense", dim)]))
    collections.upsert(name, points_of_documents(docs, config))
    asked = docs.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    there = collections.rows(name, ("doc_id", asked)).groupBy("doc_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return asked.join(there, "doc_id", "left").select("doc_id", n.alias("n_points"), (n > 0).alias("verified"))


def verified(points: DataFrame, doc_id: str, first_text: str) -> DataFrame:
    """One row, found: a lexical search for the document's first chunk (or its id, if that is blank) meets one of its points."""
    return exists(points, first_text.strip() or doc_id, Filter(must=[Condition("doc_id", "eq", doc_id)]))


def upload(points: DataFrame, collections: Collections, schema: CollectionSchema, order: str, n: int | None = None) -> DataFrame:
    """One row, success, n_inserted, n_skipped, failed_batch: points (id, vectors, payload) by their order number (whole numbers, unique) in
    batches of n. Points without any vector are skipped. A batch with a vector of another length than the collection's fails: those
    before it stay, it and those after are not written. All good batches are one commit.
    """
    collections.ensure(schema)
    n, sizes = batch_size(n), {v.name: v.size for v in schema.checked().vectors if v.name in points.columns}
    has = F.lit(False)
    wrong = F.lit(False)
    for c, size in sizes.items():
        has = has | F.coalesce(F.size(c) > 0, F.lit(False))
        wrong = wrong | (F.coalesce(F.size(c), F.lit(0)) > 0) & (F.size(c) != size)
    good = running_sum(points.filter(has), [], order, F.lit(1), "__rank").withColumn("__batch", F.floor((F.col("__rank") - 1) / n).cast("long"))
    good = written(good.withColumn("__wrong", wrong), "upload")
    failed = good.agg(F.min(F.when(F.col("__wrong"), F.col("__batch"))), F.count("*")).first()
    kept = good if failed[0] is None else good.filter(F.col("__batch") < failed[0])
    collections.upsert(schema.name, kept.drop("__rank", "__batch", "__wrong"))
    inserted = failed[1] if failed[0] is None else min(failed[1], failed[0] * n)
    skipped = points.filter(~has).count()
    return points.sparkSession.createDataFrame([(failed[0] is None, inserted, skipped, failed[0])], "success boolean, n_inserted long, n_skipped long, failed_batch long")
