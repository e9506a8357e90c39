"""Queries on units, chunks, their vectors and statistics."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators.chunking import ChunkConfig, chunk_documents, percentiles_of_counts, semantic_groups, stable_unit_rows, unit_counts
from corpusloom.operators.prefix import running_sum
from corpusloom.plans import sqltext as Q
from corpusloom.session import read_table

CONFIG = ChunkConfig()


def _chunks(spark, d):
    return read_table(spark, d, "chunks").filter(F.col("text").isNotNull())


def semantic_groups_of_embeddings(spark, d):
    e = read_table(spark, d, "embeddings").select("vec_id", "embedding")
    return semantic_groups(e, [], "vec_id", "embedding", 0.05).select("vec_id", "group_no")


def vector_validation(spark, d):
    """Per modality: rows kept, and dropped without a norm or with another length than the first kept row's (by id)."""
    p = read_table(spark, d, "points").select("id", "modality", "text_dense", V.is_zero(F.col("text_dense")).alias("zero"))
    first = p.filter("NOT zero").groupBy("modality").agg(F.min_by(F.size("text_dense"), "id").alias("dim"))
    j = p.join(F.broadcast(first), "modality", "left")
    odd = ~F.col("zero") & (F.size("text_dense") != F.col("dim"))
    return j.groupBy("modality").agg(
        F.max("dim").cast("long").alias("dim"), F.count_if(~F.col("zero") & ~odd).alias("n_kept"), F.count_if("zero").alias("n_zero"), F.count_if(odd).alias("n_other_dim")
    )


def vector_mean_by_label(spark, d):
    e = read_table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def vector_norms(spark, d):
    e = read_table(spark, d, "embeddings")
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), V.is_zero(F.col("embedding")).alias("zero"))


def vector_config_inferred(spark, d):
    p = read_table(spark, d, "points")
    names = F.array(*[F.struct(F.lit(c).alias("name"), F.size(c).alias("size")) for c in ("text_dense", "image_dense")])
    v = p.select("id", F.explode(names).alias("v")).filter("v.size > 0")
    return v.groupBy("v.name").agg(F.min_by("v.size", "id").cast("long").alias("size"), F.lit("cosine").alias("distance"))


def token_percentiles(spark, d):
    c = _chunks(spark, d).select("config_id", T.token_count(F.col("text")).cast("long").alias("n_tokens"))
    return percentiles_of_counts(c, ["config_id"], "n_tokens", (50, 95))


def short_chunk_pct(spark, d):
    short = T.is_short(F.col("text"), CONFIG.min_chars, CONFIG.min_tokens)
    n = F.count("*")
    return _chunks(spark, d).groupBy("config_id").agg(n.alias("n"), F.count_if(short).alias("n_short"), F.round(100.0 * F.count_if(short) / n, 2).alias("pct"))


def chunk_samples(spark, d):
    """The first and last three chunks of each config, shortened; a chunk is never in both."""
    c = _chunks(spark, d).select("config_id", "chunk_id", T.shortened(F.col("text"), 80).alias("text"))
    up, down = Window.partitionBy("config_id").orderBy("chunk_id"), Window.partitionBy("config_id").orderBy(F.desc("chunk_id"))
    head = c.withColumn("n", F.row_number().over(up)).filter("n <= 3").select("config_id", "chunk_id", "text", F.lit("head").alias("part"))
    last = c.withColumn("n", F.row_number().over(down)).filter("n <= 3").select("config_id", "chunk_id", "text", F.lit("tail").alias("part"))
    return head.unionByName(last.join(head.select("config_id", "chunk_id"), ["config_id", "chunk_id"], "left_anti"))


def image_attach(spark, d):
    """Images go to the last line with text before their own; those with none before are lost."""
    lines = read_table(spark, d, "documents").filter(F.col("text").contains("![")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("rest", T.without_image_refs(F.col("line"))).withColumn("at", F.when(T.squeeze(F.col("rest")) != "", F.col("line_no")))
    before = F.last("at", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    refs = lines.withColumn("owner", before).select("doc_id", F.col("owner").cast("long").alias("line_no"), "line", F.col("line_no").alias("n")).filter("line_no IS NOT NULL")
    return refs.select("doc_id", "line_no", F.explode(T.image_refs(F.col("line"))).alias("image"))


def batch_numbering(spark, d):
    docs = read_table(spark, d, "documents").select("source", "doc_id")
    n = running_sum(docs, ["source"], "doc_id", F.lit(1), "n")
    return n.select("source", "doc_id", F.floor((F.col("n") - 1) / 20).cast("long").alias("batch_no"))


def chunk_numbering(spark, d):
    c = read_table(spark, d, "chunks").select("doc_id", "chunk_id")
    return running_sum(c, ["doc_id"], "chunk_id", F.lit(1), "n").select("doc_id", "chunk_id", (F.col("n") - 1).alias("chunk_index"))


def positional_zip(spark, d):
    """Chunks with the embedding at their place in the embeddings table; both sides number from 0."""
    c = read_table(spark, d, "chunks").select("chunk_id", (F.col("chunk_id") - 1).alias("vec_id"))
    return c.join(read_table(spark, d, "embeddings").select("vec_id", "label"), "vec_id").select("chunk_id", "vec_id", "label")


def image_vector_of_chunks(spark, d):
    """Points of text with the image vector of the same document and place, if there is one."""
    p = read_table(spark, d, "points")
    images = p.filter((F.size("image_dense") == 48)).groupBy("doc_id", "chunk_index").agg(F.min_by("image_dense", "id").alias("image_vector"))
    texts = p.filter(F.col("modality") == "text").select("id", "doc_id", "chunk_index")
    return texts.join(images, ["doc_id", "chunk_index"], "left").select("id", F.col("image_vector").isNotNull().alias("has_image"), F.round(V.norm(F.col("image_vector")), 4).alias("norm"))


def stable_units_of_documents(spark, d):
    return stable_unit_rows(read_table(spark, d, "documents"))


def unit_counts_of_documents(spark, d):
    return unit_counts(read_table(spark, d, "documents"))


def semantic_chunks(spark, d):
    out = chunk_documents(read_table(spark, d, "documents"), config=ChunkConfig(similarity=0.3))
    return out.select("doc_id", "chunk_index", "text", "n_tokens", F.size("image_paths").alias("n_images"), F.round(V.norm(F.col("vector")), 4).alias("norm"))


QUERIES = {
    f.__name__: f
    for f in (
        semantic_groups_of_embeddings, vector_validation, vector_mean_by_label, vector_norms, vector_config_inferred, token_percentiles, short_chunk_pct, chunk_samples, image_attach,
        batch_numbering, chunk_numbering, positional_zip, image_vector_of_chunks, stable_units_of_documents, unit_counts_of_documents, semantic_chunks,
    )
}

_COS = "list_cosine_similarity(embedding::DOUBLE[], prev::DOUBLE[])"
_NORM = "sqrt(list_sum(list_transform(text_dense::DOUBLE[], lambda x: x * x)))"
_TOK = f"(SELECT config_id, {Q.tokens('text')}::BIGINT AS t FROM chunks WHERE text IS NOT NULL)"
_SHORT = Q.short("text", CONFIG.min_chars, CONFIG.min_tokens)
_LOG = f"CASE WHEN length({Q.squeeze('text')}) <= 80 THEN {Q.squeeze('text')} ELSE substring({Q.squeeze('text')}, 1, 77) || '...' END"
_REF = r"'!\[[^\]]*\]\(([^)]+)\)'"
SQL = {
    "semantic_groups_of_embeddings": f"""SELECT vec_id, sum(CASE WHEN prev IS NOT NULL AND {_COS} >= CAST(0.05 AS DOUBLE) THEN 0 ELSE 1 END) OVER (ORDER BY vec_id)::BIGINT - 1 AS group_no
 FROM (SELECT vec_id, embedding, lag(embedding) OVER (ORDER BY vec_id) AS prev FROM embeddings)""",
    "vector_validation": f"""WITH p AS (SELECT id, modality, len(text_dense) AS n, CASE WHEN text_dense IS NULL OR len(text_dense) = 0 THEN true ELSE {_NORM} < 1e-12 END AS zero FROM points),
 f AS (SELECT modality, min_by(n, id) AS dim FROM p WHERE NOT zero GROUP BY modality)
 SELECT modality, max(dim)::BIGINT AS dim, count(*) FILTER (NOT zero AND n = dim) AS n_kept, count(*) FILTER (zero) AS n_zero, count(*) FILTER (NOT zero AND n <> dim) AS n_other_dim
 FROM p LEFT JOIN f USING (modality) GROUP BY modality""",
    "vector_mean_by_label": "SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, pos",
    "vector_norms": "SELECT vec_id, round(n, 6) AS norm, n < 1e-12 AS zero FROM (SELECT vec_id, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)",
    "vector_config_inferred": """SELECT name, min_by(n, id)::BIGINT AS size, 'cosine' AS distance FROM (SELECT id, 'text_dense' AS name, len(text_dense) AS n FROM points
 UNION ALL SELECT id, 'image_dense', len(image_dense) FROM points) WHERE n > 0 GROUP BY name""",
    "token_percentiles": f"""SELECT config_id, count(*) AS n, list_sort(list(t))[CAST(floor((count(*) - 1) * CAST(0.5 AS DOUBLE)) AS BIGINT) + 1] AS p50,
 list_sort(list(t))[CAST(floor((count(*) - 1) * CAST(0.95 AS DOUBLE)) AS BIGINT) + 1] AS p95, max(t) AS most FROM {_TOK} GROUP BY config_id""",
    "short_chunk_pct": f"""SELECT config_id, count(*) AS n, count(*) FILTER ({_SHORT}) AS n_short, round(CAST(100 AS DOUBLE) * count(*) FILTER ({_SHORT}) / count(*), 2) AS pct
 FROM chunks WHERE text IS NOT NULL GROUP BY config_id""",
    "chunk_samples": f"""SELECT config_id, chunk_id, {_LOG} AS text, CASE WHEN a <= 3 THEN 'head' ELSE 'tail' END AS part FROM
 (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY chunk_id) AS a, row_number() OVER (PARTITION BY config_id ORDER BY chunk_id DESC) AS b FROM chunks WHERE text IS NOT NULL) WHERE a <= 3 OR b <= 3""",
    "image_attach": f"""WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE contains(text, '!['))),
 a AS (SELECT *, CASE WHEN {Q.squeeze(f"regexp_replace(line, {_REF}, '', 'g')")} <> '' THEN n END AS t FROM l),
 o AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner FROM a)
 SELECT doc_id, owner AS line_no, unnest(list_transform(regexp_extract_all(line, {_REF}, 1), lambda x: trim(x))) AS image FROM o WHERE owner IS NOT NULL""",
    "batch_numbering": "SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS batch_no FROM documents",
    "chunk_numbering": "SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) - 1 AS chunk_index FROM chunks",
    "positional_zip": "SELECT chunk_id, vec_id, label FROM chunks JOIN embeddings ON vec_id = chunk_id - 1",
    "image_vector_of_chunks": """WITH i AS (SELECT doc_id, chunk_index, min_by(image_dense, id) AS v FROM points WHERE len(image_dense) = 48 GROUP BY doc_id, chunk_index)
 SELECT p.id, v IS NOT NULL AS has_image, round(sqrt(list_sum(list_transform(v::DOUBLE[], lambda x: x * x))), 4) AS norm FROM points p LEFT JOIN i USING (doc_id, chunk_index) WHERE modality = 'text'""",
}
