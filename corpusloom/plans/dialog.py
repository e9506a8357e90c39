"""Queries on the conversational operators. Conversations are stood in for by chunks: one per document, turns in order of chunk_id,
questions and answers by turns."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import dialog as D
from corpusloom.operators.search import batch_topk
from corpusloom.plans import sqltext as Q
from corpusloom.session import read_table


def _turns(spark, d):
    c = read_table(spark, d, "chunks")
    role = F.when(F.col("chunk_id") % 2 == 0, F.when(F.col("chunk_id") % 4 == 0, " Assistant").otherwise("assistant")).otherwise("user")
    return c.select(F.col("doc_id").alias("conv_id"), F.col("chunk_id").alias("turn"), role.alias("role"), "text")


def intent_normalised(spark, d):
    t = _turns(spark, d).filter("text IS NOT NULL")
    return t.select("turn", F.md5(T.intent_text(F.col("text"))).alias("intent"), F.md5(T.overlap_text(F.col("text"))).alias("plain"))


def skip_retrieval(spark, d):
    image = F.when(F.col("turn") % 10 == 0, "img/a.png").when(F.col("turn") % 10 == 1, " ")
    return _turns(spark, d).select("turn", D.skips_retrieval(F.col("text"), image).alias("skips"))


def overlap_ratios(spark, d):
    docs = read_table(spark, d, "documents").filter("text IS NOT NULL AND title IS NOT NULL")
    return docs.select("doc_id", F.round(T.overlap_ratio(F.col("title"), F.col("text")), 6).alias("ratio"))


def last_assistant_message(spark, d):
    return D.last_assistant(_turns(spark, d), ["conv_id"]).select("conv_id", F.md5("last_assistant").alias("last_assistant"))


def accept_post(spark, d):
    """A document's text as the raw answer and several rewritten ones: blank, short, generic, repeated, unrelated ones and the whole text."""
    docs = read_table(spark, d, "documents")
    k = F.col("doc_id") % 6
    post = (F.when(k == 0, F.lit(" ")).when(k == 1, F.concat(F.lit("see "), "source")).when(k == 2, F.concat(F.lit("Xin chào, "), "text"))
            .when(k == 3, F.upper("title")).when(k == 4, F.lit("zq1 zq2 zq3 zq4")).otherwise(F.col("text")))
    rows = docs.filter("text IS NOT NULL").select("doc_id", F.col("text").alias("raw"), post.alias("post"), F.col("title").alias("last"))
    return D.judged_answers(rows).select("doc_id", "reason", F.md5(D.final_answer(F.col("raw"), F.col("post"), F.col("reason"))).alias("answer"))


def _hits(spark, d):
    e = read_table(spark, d, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = batch_topk(e, asked, 4, 64, "vec_id", "embedding")
    texts = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return hits.join(texts, "id", "left")


def context_merge(spark, d):
    m = D.merged_context(_hits(spark, d), ["query_id"])
    return m.select("query_id", "id", F.round("score", 6).alias("score"), F.md5("text").alias("text"))


def context_select(spark, d):
    docs = read_table(spark, d, "documents").filter("text IS NOT NULL")
    side = lambda m: F.when(F.col("doc_id") % m != 0, F.struct(((F.col("doc_id") % m) / m).alias("score"), F.concat(F.lit(f"{m} "), "title").alias("text")))
    image = F.when(F.col("doc_id") % 4 == 0, "img/x.png")
    c = D.selected_context(image, side(2), side(5), side(7))
    return docs.select("doc_id", c["text"].alias("context"), c["source"].alias("source"))


def prompt_assembly(spark, d):
    docs = read_table(spark, d, "documents").filter("text IS NOT NULL AND title IS NOT NULL")
    context = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("text"))
    return docs.select("doc_id", F.md5(D.prompt(F.lit("Answer briefly."), F.col("title"), context)).alias("prompt"))


def appended_turn_pairs(spark, d):
    turns = _turns(spark, d)
    pairs = turns.filter("text IS NOT NULL").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question")).withColumn("answer", F.concat(F.lit("re: "), "question"))
    return D.appended_turns(turns, pairs).select("conv_id", "turn", "role", F.md5("text").alias("text"))


def history_snapshot(spark, d):
    return D.history_until(_turns(spark, d), ["conv_id"], "turn", 5).select("conv_id", "turn", "role", F.col("back").cast("long").alias("back"))


def ordered_distinct_texts(spark, d):
    """Distinct trimmed texts of a conversation that aren't blank, at their first turn."""
    t = _turns(spark, d).select("conv_id", "turn", T.blank_to_null(F.col("text")).alias("text")).filter("text IS NOT NULL")
    return t.groupBy("conv_id", F.md5("text").alias("text")).agg(F.min("turn").alias("turn"))


QUERIES = {
    f.__name__: f
    for f in (intent_normalised, skip_retrieval, overlap_ratios, last_assistant_message, accept_post, context_merge, context_select, prompt_assembly, appended_turn_pairs, history_snapshot, ordered_distinct_texts)
}

_T = """(SELECT doc_id AS conv_id, chunk_id AS turn, CASE WHEN chunk_id % 4 = 0 THEN ' Assistant' WHEN chunk_id % 2 = 0 THEN 'assistant' ELSE 'user' END AS role, text FROM chunks)"""


def _ratio(a, b):
    x, y = Q.token_set(a), Q.token_set(b)
    return f"(CASE WHEN least(len({x}), len({y})) > 0 THEN CAST(len(list_intersect({x}, {y})) AS DOUBLE) / least(len({x}), len({y})) ELSE 0 END)"


_POST = """CASE doc_id % 6 WHEN 0 THEN ' ' WHEN 1 THEN 'see ' || source WHEN 2 THEN 'Xin chào, ' || text WHEN 3 THEN upper(title) WHEN 4 THEN 'zq1 zq2 zq3 zq4' ELSE text END"""
_HITS = """(SELECT query_id, b.vec_id AS id, score, rank, text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
 (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) b LEFT JOIN documents ON doc_id = b.vec_id WHERE rank <= 4)"""
_SIDE = lambda m: f"CASE WHEN doc_id % {m} <> 0 THEN CAST(doc_id % {m} AS DOUBLE) / {m} END"
SQL = {
    "intent_normalised": f"SELECT turn, md5({Q.intent('text')}) AS intent, md5({Q.overlap('text')}) AS plain FROM {_T} WHERE text IS NOT NULL",
    "skip_retrieval": f"SELECT turn, turn % 10 <> 0 AND (q = '' OR {Q.greets('q')}) AS skips FROM (SELECT turn, {Q.overlap(chr(99) + 'oalesce(text, chr(32))')} AS q FROM {_T})",
    "overlap_ratios": f"SELECT doc_id, round({_ratio('title', 'text')}, 6) AS ratio FROM documents WHERE text IS NOT NULL AND title IS NOT NULL",
    "last_assistant_message": f"SELECT conv_id, md5(max_by({Q.strip('text')}, turn)) AS last_assistant FROM {_T} WHERE lower(trim(role)) = 'assistant' AND {Q.blank_to_null('text')} IS NOT NULL GROUP BY conv_id",
    "accept_post": f"""WITH r AS (SELECT doc_id, text AS raw, {Q.strip(_POST)} AS post, {Q.blank_to_null('title')} AS last FROM documents WHERE text IS NOT NULL),
 v AS (SELECT *, CASE WHEN coalesce(post, '') = '' THEN 'empty_postprocess' WHEN {Q.tokens('post')} < 4 THEN 'too_short' WHEN {Q.generic(Q.overlap('post'))} THEN 'generic_reply'
 WHEN coalesce(lower(last) = lower(post), false) THEN 'duplicate_last_assistant' WHEN {_ratio('raw', 'post')} < CAST(0.08 AS DOUBLE) THEN 'low_overlap_with_raw_answer' ELSE 'accepted' END AS reason FROM r)
 SELECT doc_id, reason, md5(CASE WHEN reason = 'accepted' THEN post ELSE raw END) AS answer FROM v""",
    "context_merge": f"""WITH h AS (SELECT query_id, id, score, rank, {Q.strip('text')} AS t, text FROM {_HITS}),
 u AS (SELECT query_id, t, min(rank) AS r FROM h WHERE t <> '' GROUP BY query_id, t), j AS (SELECT query_id, string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r) AS text FROM u GROUP BY query_id)
 SELECT h.query_id, id, round(score, 6) AS score, md5(coalesce(j.text, h.text)) AS text FROM h LEFT JOIN j USING (query_id) WHERE rank = 1""",
    "context_select": f"""WITH s AS (SELECT doc_id, title, doc_id % 4 = 0 AS pic, {_SIDE(2)} AS a, {_SIDE(5)} AS b, {_SIDE(7)} AS c FROM documents WHERE text IS NOT NULL),
 n AS (SELECT *, CASE WHEN pic THEN CASE WHEN c >= CAST(0.55 AS DOUBLE) THEN 7 ELSE 0 END WHEN a >= CAST(0.55 AS DOUBLE) THEN 2 WHEN b >= CAST(0.55 AS DOUBLE) THEN 5 WHEN c >= CAST(0.55 AS DOUBLE) THEN 7 ELSE 0 END AS m FROM s)
 SELECT doc_id, CASE m WHEN 0 THEN '' ELSE coalesce(trim(m || ' ' || title), '') END AS context, CASE m WHEN 0 THEN '' WHEN 2 THEN 'new_query' WHEN 5 THEN 'current_query' ELSE 'multimodal_query' END AS source FROM n""",
    "prompt_assembly": f"""SELECT doc_id, md5({Q.strip("'Answer briefly. ' || CASE WHEN doc_id % 3 = 0 OR " + Q.blank_to_null('text') + " IS NULL THEN title ELSE title || chr(10) || chr(10) || 'Context:' || chr(10) || text END")}) AS prompt
 FROM documents WHERE text IS NOT NULL AND title IS NOT NULL""",
    "appended_turn_pairs": f"""WITH l AS (SELECT conv_id, max(turn) AS last, max_by(text, turn) FILTER (text IS NOT NULL) AS q FROM {_T} GROUP BY conv_id HAVING count(text) > 0)
 SELECT conv_id, turn, role, md5(text) AS text FROM {_T} UNION ALL SELECT conv_id, last + 1, 'user', md5(q) FROM l UNION ALL SELECT conv_id, last + 2, 'assistant', md5('re: ' || q) FROM l""",
    "history_snapshot": f"SELECT * FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM {_T}) WHERE back <= 5",
    "ordered_distinct_texts": f"SELECT conv_id, md5(t) AS text, min(turn) AS turn FROM (SELECT conv_id, turn, {Q.blank_to_null('text')} AS t FROM {_T}) WHERE t IS NOT NULL GROUP BY conv_id, t",
}
