"""The turn of a conversation as one query. Vectors stand for questions: a turn for every fiftieth one, asked by its own vector (the
rewritten question), by the next one (the question as it is) and, with an image, by the one after; documents are the texts behind them."""

from pyspark.sql import functions as F

from corpusloom.operators import chat as C
from corpusloom.operators import dialog as D
from corpusloom.plans import sqltext as Q
from corpusloom.session import read_table

LIMIT = 4
SYSTEM = "Answer briefly."


def _turns(spark, d):
    e = read_table(spark, d, "embeddings")
    docs = read_table(spark, d, "documents")
    t = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("turn_id"))
    return t.join(docs.select(F.col("doc_id").alias("turn_id"), F.col("title").alias("query"), F.col("source").alias("last_assistant")), "turn_id", "left").withColumn(
        "image_path", F.when(F.col("turn_id") % 150 == 0, "img/a.png")
    )


def _asked(spark, d):
    e = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    out = None
    for k, side in enumerate(C.SIDES):
        mine = e.withColumn("turn_id", F.col("vec_id") - k).filter("turn_id % 50 = 0" + (" AND turn_id % 150 = 0" if k == 2 else ""))
        rows = mine.select("turn_id", F.lit(side).alias("side"), F.lit("embedding").alias("vector_name"), "vector")
        out = rows if out is None else out.unionByName(rows)
    return out


def _points(spark, d):
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return read_table(spark, d, "embeddings").select("vec_id", "embedding").join(docs, "vec_id", "left")


def chat_retrieval(spark, d):
    """The merged context of every side of every turn."""
    sides = C.retrieved(_points(spark, d), _asked(spark, d), LIMIT, {"embedding": 64}, "vec_id")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}.score").alias("score"), F.col(f"{s}.text").alias("text"), F.col(s).isNotNull().alias("there")) for s in C.SIDES])).alias("x")
    return sides.select("turn_id", each).filter("x.there").select("turn_id", "x.side", F.round("x.score", 6).alias("score"), F.md5("x.text").alias("text"))


def chat_turns(spark, d):
    """From the question to the accepted answer; the rewritten answer is the question's own title where the turn is odd, else the prompt."""
    turns = _turns(spark, d)
    sides = C.retrieved(_points(spark, d), _asked(spark, d), LIMIT, {"embedding": 64}, "vec_id")
    out = C.answered(turns, sides, SYSTEM, post=lambda raw: F.when(F.col("turn_id") % 100 == 0, raw).otherwise(F.col("query")))
    return out.select("turn_id", "skipped", "source", F.md5("context").alias("context"), F.md5("prompt").alias("prompt"), "reason", F.md5("answer").alias("answer"))


def chat_history(spark, d):
    """The conversations after their turns: a question and an answer more for each."""
    turns = _turns(spark, d)
    history = read_table(spark, d, "chunks").select(F.xxhash64("doc_id").alias("conv_id"), F.col("chunk_id").alias("turn"), F.lit("user").alias("role"), "text").limit(0)
    pairs = turns.select(F.col("turn_id").alias("conv_id"), F.col("query").alias("question"), F.concat(F.lit("re: "), "query").alias("answer"))
    return D.appended_turns(history, pairs).select("conv_id", "turn", "role", F.md5("text").alias("text"))


def query_rewrites(spark, d):
    """Replies of a rewriting model: good ones, one field alone, a field that is no string, and no JSON at all."""
    docs = read_table(spark, d, "documents")
    k, title = F.col("doc_id") % 4, F.coalesce("title", F.lit(""))
    reply = (F.when(k == 0, F.to_json(F.struct(F.concat(F.lit(" "), title).alias("CurrentQuery"), F.upper(title).alias("NewQuery")))).when(k == 1, F.to_json(F.struct(title.alias("NewQuery"))))
             .when(k == 2, F.to_json(F.struct(F.lit(7).alias("CurrentQuery"), title.alias("NewQuery")))).otherwise(F.lit("no json")))
    r = C.rewritten(reply)
    return docs.select("doc_id", r["current_query"].alias("current_query"), r["new_query"].alias("new_query"))


QUERIES = {f.__name__: f for f in (chat_retrieval, chat_turns, chat_history, query_rewrites)}

_SIDES = f"""e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
asked AS (SELECT vec_id AS turn_id, 'new_query' AS side, v FROM e WHERE vec_id % 50 = 0 UNION ALL SELECT vec_id - 1, 'current_query', v FROM e WHERE (vec_id - 1) % 50 = 0
 UNION ALL SELECT vec_id - 2, 'multimodal_query', v FROM e WHERE (vec_id - 2) % 150 = 0),
hits AS (SELECT *, row_number() OVER (PARTITION BY turn_id, side ORDER BY s DESC, id) AS rank FROM (SELECT turn_id, side, e.vec_id AS id, list_cosine_similarity(e.v, asked.v) AS s FROM e, asked)),
top AS (SELECT hits.*, text, {Q.strip('text')} AS t FROM hits LEFT JOIN documents ON doc_id = id WHERE rank <= {LIMIT}),
scaled AS (SELECT *, CASE WHEN count(*) OVER w = 1 OR max(s) OVER w - min(s) OVER w <= 1e-8 THEN s ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w + 1e-8) END AS score FROM top WINDOW w AS (PARTITION BY turn_id, side)),
firsts AS (SELECT turn_id, side, t, min(rank) AS r FROM top WHERE t <> '' GROUP BY ALL),
joined AS (SELECT turn_id, side, string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r) AS text FROM firsts GROUP BY ALL),
sides AS (SELECT scaled.turn_id, scaled.side, score, coalesce(joined.text, scaled.text) AS text FROM scaled LEFT JOIN joined ON scaled.turn_id = joined.turn_id AND scaled.side = joined.side WHERE rank = 1)
"""
_QUERY = "coalesce(query, '')"
_TITLE = "coalesce(title, '')"


def _ratio(a, b):
    x, y = Q.token_set(a), Q.token_set(b)
    return f"(CASE WHEN least(len({x}), len({y})) > 0 THEN CAST(len(list_intersect({x}, {y})) AS DOUBLE) / least(len({x}), len({y})) ELSE 0 END)"


_PICK = "coalesce(trim({0}.text), '')"
SQL = {
    "chat_retrieval": f"WITH {_SIDES} SELECT turn_id, side, round(score, 6) AS score, md5(text) AS text FROM sides",
    "chat_turns": f"""WITH {_SIDES}, turns AS (SELECT vec_id AS turn_id, title AS query, source AS last, vec_id % 150 = 0 AS pic, {Q.overlap("coalesce(title, '')")} AS q FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE vec_id % 50 = 0),
 c AS (SELECT turns.*, NOT pic AND (q = '' OR {Q.greets('q')}) AS skipped,
  CASE WHEN NOT pic AND (q = '' OR {Q.greets('q')}) THEN '' WHEN pic THEN CASE WHEN m.score >= CAST(0.55 AS DOUBLE) THEN 'multimodal_query' ELSE '' END WHEN n.score >= CAST(0.55 AS DOUBLE) THEN 'new_query'
  WHEN u.score >= CAST(0.55 AS DOUBLE) THEN 'current_query' ELSE '' END AS source, n.text AS nt, u.text AS ut, m.text AS mt
  FROM turns LEFT JOIN sides n ON n.turn_id = turns.turn_id AND n.side = 'new_query' LEFT JOIN sides u ON u.turn_id = turns.turn_id AND u.side = 'current_query'
  LEFT JOIN sides m ON m.turn_id = turns.turn_id AND m.side = 'multimodal_query'),
 d AS (SELECT *, CASE source WHEN 'new_query' THEN coalesce(trim(nt), '') WHEN 'current_query' THEN coalesce(trim(ut), '') WHEN 'multimodal_query' THEN coalesce(trim(mt), '') ELSE '' END AS context FROM c),
 p AS (SELECT *, {Q.strip("'" + SYSTEM + " ' || " + _QUERY + " || CASE WHEN " + Q.blank_to_null('context') + " IS NULL THEN '' ELSE chr(10) || chr(10) || 'Context:' || chr(10) || context END")} AS prompt FROM d),
 a AS (SELECT *, coalesce({Q.strip("CASE WHEN turn_id % 100 = 0 THEN prompt ELSE query END")}, '') AS post, {Q.blank_to_null('last')} AS before FROM p),
 v AS (SELECT *, CASE WHEN post = '' THEN 'empty_postprocess' WHEN {Q.tokens('post')} < 4 THEN 'too_short' WHEN {Q.generic(Q.overlap('post'))} THEN 'generic_reply'
 WHEN coalesce(lower(before) = lower(post), false) THEN 'duplicate_last_assistant' WHEN {_ratio('prompt', 'post')} < CAST(0.08 AS DOUBLE) THEN 'low_overlap_with_raw_answer' ELSE 'accepted' END AS reason FROM a)
 SELECT turn_id, skipped, source, md5(context) AS context, md5(prompt) AS prompt, reason, md5(CASE WHEN reason = 'accepted' THEN post ELSE prompt END) AS answer FROM v""",
    "chat_history": """WITH t AS (SELECT vec_id AS conv_id, title AS q FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE vec_id % 50 = 0)
 SELECT conv_id, 1::BIGINT AS turn, 'user' AS role, md5(q) AS text FROM t UNION ALL SELECT conv_id, 2, 'assistant', md5('re: ' || q) FROM t""",
    "query_rewrites": f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN {Q.strip(_TITLE)} ELSE '' END AS current_query,
 CASE doc_id % 4 WHEN 0 THEN {Q.strip('upper(' + _TITLE + ')')} WHEN 1 THEN {Q.strip(_TITLE)} WHEN 2 THEN {Q.strip(_TITLE)} ELSE '' END AS new_query FROM documents""",
}
