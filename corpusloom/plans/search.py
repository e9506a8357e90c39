"""Queries on retrieval: filters, payloads, dense and lexical legs, fusion."""

from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators.filters import Condition, Filter, filtered
from corpusloom.operators.lexical import LexicalIndex, bm25_scores, bm25_text, searchable
from corpusloom.operators.payload import payload_map, typed_payload
from corpusloom.operators.search import SearchQuery, batch_topk, exists, expanded, fused, leg_weights, normalised, run_leg, search
from corpusloom.plans import sqltext as Q
from corpusloom.session import read_table

TEXT_QUERY = "retrieval pressure cables during setup"
OCR_QUERY = "handbook chapter margin"


def _first_vector(spark, d):
    return read_table(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


def _embeddings(spark, d):
    return read_table(spark, d, "embeddings")


def _dense(distance):
    def query(spark, d):
        e = _embeddings(spark, d)
        leg = run_leg(e, SearchQuery("embedding", list(_first_vector(spark, d)), limit=10, distance=distance), "vec_id")
        shown = F.col("score") if V.larger_is_better(distance) else -F.col("score")
        return leg.select(F.col("id").alias("vec_id"), F.round(shown, 6).alias("score"))

    query.__name__ = f"dense_{distance}_topk"
    return query


def dense_filtered_topk(spark, d):
    f = Filter(must=[Condition("label", "in", [1, 2, 3])], must_not=[Condition("label", "eq", 2)])
    leg = run_leg(_embeddings(spark, d), SearchQuery("embedding", list(_first_vector(spark, d)), limit=10, filter=f), "vec_id")
    return leg.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def dense_threshold(spark, d):
    leg = run_leg(_embeddings(spark, d), SearchQuery("embedding", list(_first_vector(spark, d)), limit=1000, score_threshold=0.1), "vec_id")
    return leg.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def dense_batch_topk(spark, d):
    e = _embeddings(spark, d)
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return batch_topk(e, asked, 5, 64, "vec_id", "embedding").select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25_topk(spark, d):
    s = run_leg(read_table(spark, d, "documents"), SearchQuery("bm25", query_text=TEXT_QUERY, limit=20), "doc_id")
    return s.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_filtered_lang(spark, d):
    f = Filter(must=[Condition("lang", "eq", "en")])
    s = run_leg(read_table(spark, d, "documents"), SearchQuery("bm25", query_text=TEXT_QUERY, limit=20, filter=f), "doc_id")
    return s.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_all_scores(spark, d):
    s = bm25_scores(read_table(spark, d, "documents"), TEXT_QUERY, "doc_id")
    return s.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_indexed_topk(spark, d):
    """Points by their whole searchable text, from an inverted index; two searches read the words of one splitting."""
    p = read_table(spark, d, "points")
    index, out = LexicalIndex(p.withColumn("searchable", searchable(p)), "id", "searchable"), None
    for k, q in enumerate((TEXT_QUERY, OCR_QUERY)):
        top = index.scores(q).orderBy(F.desc("score"), "id").limit(20).select(F.lit(k).cast("long").alias("query_no"), "id", F.round("score", 6).alias("score"))
        out = top if out is None else out.unionByName(top)
    return out


def bm25_document_text(spark, d):
    p = read_table(spark, d, "points")
    return p.select("id", F.md5(bm25_text(F.col("section_title"), F.col("text"), F.col("ocr_text"), F.col("keywords"))).alias("bm25_text"))


def _points(spark, d):
    p = read_table(spark, d, "points")
    return p.withColumn("text_dense", F.when(F.size("text_dense") == 64, F.col("text_dense")))


def _legs(spark, d):
    p = _points(spark, d)
    vector = p.filter(F.col("text_dense").isNotNull() & ~V.is_zero(F.col("text_dense"))).agg(F.min_by("text_dense", "id")).first()[0]
    return p, expanded([SearchQuery("text_dense", list(vector), TEXT_QUERY, limit=25)])


def leg_minmax(spark, d):
    p, legs = _legs(spark, d)
    out = None
    for q in legs:
        leg = normalised(run_leg(p, q)).select(F.lit(q.vector_name).alias("leg"), "id", F.round("score", 6).alias("score"))
        out = leg if out is None else out.unionByName(leg)
    return out


def leg_weights_normalised(spark, d):
    rows = []
    for names in (["text_dense"], ["text_dense", "bm25"], ["text_dense", "image_dense", "bm25"], ["other", "bm25"]):
        for n, w in zip(names, leg_weights([SearchQuery(n) for n in names])):
            rows.append((",".join(names), n, round(w, 6)))
    return spark.createDataFrame(rows, "legs string, leg string, weight double")


def hybrid_fused(spark, d):
    p, legs = _legs(spark, d)
    found = fused([normalised(run_leg(p, q)) for q in legs], leg_weights(legs), legs[0].limit)
    return found.select("id", F.round("score", 6).alias("score"))


def hybrid_search(spark, d):
    p, legs = _legs(spark, d)
    found = search(p, legs[:1], payload=["doc_id", "lang", "page"])
    return found.select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "doc_id", "lang", F.col("page").cast("long").alias("page"))


def bool_filter_must_should_not(spark, d):
    f = Filter(
        must=[Condition("modality", "in", ["text", "scan"])],
        should=[Condition("lang", "eq", "en"), Condition("has_table", "eq", True), Condition("page", "in", [1, 2])],
        must_not=[Condition("unit_type", "eq", "table"), Condition("lang", "eq", "vi")],
    )
    return filtered(read_table(spark, d, "points"), f).select("id", "lang", "page", "unit_type")


def verify_probe(spark, d):
    docs = read_table(spark, d, "documents")
    f = Filter(must=[Condition("lang", "eq", "fr")])
    a = exists(docs, "la soupape de pression", f, "doc_id").select(F.lit("common").alias("probe"), "found")
    b = exists(docs, "zzzunseenword", f, "doc_id").select(F.lit("unseen").alias("probe"), "found")
    return a.unionByName(b)


def payload_from_map(spark, d):
    """Documents as maps of strings, parsed back; spaces and other words don't parse."""
    docs = read_table(spark, d, "documents")
    m = F.map_filter(
        F.create_map(
            F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("text"), F.col("text"), F.lit("lang"), F.col("lang"),
            F.lit("page"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string")),
            F.lit("chunk_index"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("string")),
            F.lit("has_table"), F.when(F.col("doc_id") % 5 == 0, F.lit("yes")).when(F.col("doc_id") % 5 == 1, F.lit("T")).otherwise(F.lit("false")),
            F.lit("keywords"), F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.coalesce("source", F.lit("")), F.lit(", x"))),
            F.lit("created_at"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            F.lit("bbox"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"x1":1,"y1":2,"x2":'), F.col("doc_id").cast("string"), F.lit(',"y2":4}'))).otherwise(F.lit('{"x1":1,"y1":2}')),
        ), lambda k, v: v.isNotNull())
    t = docs.select(m.alias("m")).select(*typed_payload(F.col("m")))
    return t.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", F.length("text").cast("long").alias("n"), F.col("page").cast("long").alias("page"), F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("token_count").cast("long").alias("token_count"), "has_table", "has_figure", F.array_join("keywords", "|").alias("keywords"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        (F.col("bbox.x1") + F.col("bbox.x2")).cast("long").alias("box"),
    )


def payload_to_map_flat(spark, d):
    p = read_table(spark, d, "points")
    m = payload_map(p.columns)
    return p.select("id", F.explode(m).alias("key", "value")).select("id", "key", F.md5("value").alias("value"))


QUERIES = {f"dense_{x}_topk": _dense(x) for x in V.DISTANCES} | {
    f.__name__: f
    for f in (
        dense_filtered_topk, dense_threshold, dense_batch_topk, bm25_topk, bm25_filtered_lang, bm25_all_scores, bm25_indexed_topk, bm25_document_text, leg_minmax, leg_weights_normalised,
        hybrid_fused, hybrid_search, bool_filter_must_should_not, verify_probe, payload_from_map, payload_to_map_flat,
    )
}

_E = "(SELECT vec_id, label, embedding::DOUBLE[] AS v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS q FROM embeddings)"
_SCORES = {
    "cosine": ("list_cosine_similarity(v, q)", "DESC"),
    "dot": ("list_inner_product(v, q)", "DESC"),
    "euclid": ("list_distance(v, q)", "ASC"),
    "manhattan": ("list_sum(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - q[i])))", "ASC"),
}


def _sql_dense(distance, where="true", limit=10):
    score, way = _SCORES[distance]
    return f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, label, {score} AS s FROM {_E}) WHERE {where} ORDER BY s {way}, vec_id LIMIT {limit}"


_TERMS = sorted(set(TEXT_QUERY.split()))


def _sql_bm25(table, id_col, text, where="true", asked=None):
    """Common table expression `scored` (id, s)."""
    _TERMS = asked or globals()["_TERMS"]
    return f"""tok AS (SELECT {id_col} AS id, ({where}) AS ok, list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ts FROM {table} WHERE {text} IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
tf AS (SELECT id, ok, len(ts) AS dl, term, len(list_filter(ts, lambda x: x = term)) AS f FROM tok, (SELECT unnest({_TERMS}) AS term)),
df AS (SELECT term, count(*) FILTER (f > 0) AS df FROM tf GROUP BY term),
scored AS (SELECT id, sum(ln(1 + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * f * CAST(2.2 AS DOUBLE) / (f + CAST(1.2 AS DOUBLE) * (1 - CAST(0.75 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))) AS s
 FROM tf JOIN df USING (term), st WHERE f > 0 AND ok GROUP BY id)"""


_B = lambda x: Q.blank_to_null(x)
_SEARCHABLE = f"nullif(concat_ws(chr(10), {_B('section_title')}, {_B('text')}, {_B('ocr_text')}, {_B(chr(97) + 'rray_to_string(keywords, chr(32))')}), '')"
_SEARCHED = f"(SELECT id, {_SEARCHABLE} AS st FROM points)"
_LEGS = f"""WITH pt AS (SELECT id, text, doc_id, lang, page, CASE WHEN len(text_dense) = 64 THEN text_dense::DOUBLE[] END AS v FROM points),
nz AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM pt WHERE v IS NOT NULL),
q AS (SELECT min_by(v, id) AS q FROM nz WHERE norm >= 1e-12),
dense AS (SELECT id, list_inner_product(v, q) / (norm * sqrt(list_sum(list_transform(q, lambda x: x * x)))) AS s FROM nz, q WHERE norm > 0 ORDER BY s DESC, id LIMIT 25),
{_sql_bm25(_SEARCHED, 'id', 'st')},
lex AS (SELECT id, s FROM scored ORDER BY s DESC, id LIMIT 25),
legs AS (SELECT 'text_dense' AS leg, 5.0::DOUBLE / 7 AS w, id, s FROM dense UNION ALL SELECT 'bm25', 2.0::DOUBLE / 7, id, s FROM lex),
norm AS (SELECT leg, w, id, CASE WHEN count(*) OVER p = 1 OR max(s) OVER p - min(s) OVER p <= 1e-8 THEN s ELSE (s - min(s) OVER p) / (max(s) OVER p - min(s) OVER p + 1e-8) END AS s
 FROM legs WINDOW p AS (PARTITION BY leg)),
fused AS (SELECT id, sum(w * s) AS s FROM norm GROUP BY id ORDER BY s DESC, id LIMIT 25)
"""
_MAP = []
for k in ("doc_id", "source_path", "modality", "unit_type", "text", "ocr_text", "image_path", "section_title", "lang", "parent_id"):
    _MAP.append(f"SELECT id, '{k}' AS key, {k} AS value FROM points WHERE {k} <> ''")
for k in ("page", "chunk_index", "token_count"):
    _MAP.append(f"SELECT id, '{k}', {k}::VARCHAR FROM points WHERE {k} <> 0")
for k in ("has_table", "has_figure"):
    _MAP.append(f"SELECT id, '{k}', 'true' FROM points WHERE {k}")
_MAP.append("SELECT id, 'keywords', array_to_string(keywords, ',') FROM points WHERE len(keywords) > 0")
_MAP.append("""SELECT id, 'bbox', '{"x1":' || bbox.x1 || ',"y1":' || bbox.y1 || ',"x2":' || bbox.x2 || ',"y2":' || bbox.y2 || '}' FROM points WHERE bbox.x1 + bbox.y1 + bbox.x2 + bbox.y2 IS NOT NULL""")
_MAP.append("SELECT id, 'created_at', strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') FROM points WHERE created_at IS NOT NULL")

SQL = {f"dense_{x}_topk": _sql_dense(x) for x in V.DISTANCES} | {
    "dense_filtered_topk": _sql_dense("cosine", "label IN (1, 3)"),
    "dense_threshold": _sql_dense("cosine", "s >= CAST(0.1 AS DOUBLE)", 1000),
    "dense_batch_topk": """SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank
 FROM (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) WHERE rank <= 5""",
    "bm25_topk": f"WITH {_sql_bm25('documents', 'doc_id', 'text')} SELECT id AS doc_id, round(s, 6) AS score FROM scored ORDER BY s DESC, id LIMIT 20",
    "bm25_filtered_lang": f"WITH {_sql_bm25('documents', 'doc_id', 'text', 'coalesce(lang = chr(101) || chr(110), false)')} SELECT id AS doc_id, round(s, 6) AS score FROM scored ORDER BY s DESC, id LIMIT 20",
    "bm25_all_scores": f"WITH {_sql_bm25('documents', 'doc_id', 'text')} SELECT id AS doc_id, round(s, 6) AS score FROM scored",
    "bm25_indexed_topk": f"""(WITH {_sql_bm25(_SEARCHED, 'id', 'st')} SELECT 0::BIGINT AS query_no, id, round(s, 6) AS score FROM scored ORDER BY s DESC, id LIMIT 20) UNION ALL
 (WITH {_sql_bm25(_SEARCHED, 'id', 'st', 'true', sorted(OCR_QUERY.split()))} SELECT 1::BIGINT AS query_no, id, round(s, 6) AS score FROM scored ORDER BY s DESC, id LIMIT 20)""",
    "bm25_document_text": f"SELECT id, md5(concat_ws(chr(10), {_B('section_title')}, {_B('text')}, {_B('ocr_text')}, {_B(chr(97) + 'rray_to_string(keywords, chr(32))')})) AS bm25_text FROM points",
    "leg_minmax": _LEGS + "SELECT leg, id, round(s, 6) AS score FROM norm",
    "leg_weights_normalised": """WITH w AS (SELECT * FROM (VALUES ('text_dense', 'text_dense', 0.5), ('text_dense,bm25', 'text_dense', 0.5), ('text_dense,bm25', 'bm25', 0.2),
 ('text_dense,image_dense,bm25', 'text_dense', 0.5), ('text_dense,image_dense,bm25', 'image_dense', 0.2), ('text_dense,image_dense,bm25', 'bm25', 0.2), ('other,bm25', 'other', 1.0), ('other,bm25', 'bm25', 0.2)) t(legs, leg, w))
 SELECT legs, leg, round(w::DOUBLE / sum(w::DOUBLE) OVER (PARTITION BY legs), 6) AS weight FROM w""",
    "hybrid_fused": _LEGS + "SELECT id, round(s, 6) AS score FROM fused",
    "hybrid_search": _LEGS + "SELECT id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, id) AS rank, doc_id, lang, page::BIGINT AS page FROM fused JOIN pt USING (id)",
    "bool_filter_must_should_not": """SELECT id, lang, page, unit_type FROM points WHERE coalesce(modality IN ('text', 'scan'), false)
 AND (coalesce(lang = 'en', false) OR coalesce(has_table, false) OR coalesce(page IN (1, 2), false)) AND NOT coalesce(unit_type = 'table', false) AND NOT coalesce(lang = 'vi', false)""",
    "verify_probe": f"""SELECT 'common' AS probe, count(*) > 0 AS found FROM documents WHERE lang = 'fr' AND regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}])(la|soupape|de|pression)($|[^\\p{{L}}\\p{{N}}])')
 UNION ALL SELECT 'unseen', false""",
    "payload_from_map": """SELECT doc_id, coalesce(lang, '') AS lang, length(coalesce(text, '')) AS n, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id END AS page,
 CASE WHEN doc_id % 2 = 0 AND n_chars IS NOT NULL THEN n_chars ELSE 0 END AS chunk_index, 0::BIGINT AS token_count, doc_id % 5 = 1 AS has_table, false AS has_figure,
 CASE WHEN doc_id % 7 = 0 THEN NULL ELSE replace(coalesce(source, '') || ', x', ',', '|') END AS keywords, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created_at,
 CASE WHEN doc_id % 2 = 0 THEN 1 + doc_id END AS box FROM documents""",
    "payload_to_map_flat": "SELECT id, key, md5(value) AS value FROM (" + " UNION ALL ".join(_MAP) + ")",
}
