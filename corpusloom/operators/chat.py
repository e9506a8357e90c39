"""Turns of conversations from question to answer, many at once: rewriting, retrieval from several sides, context, answer, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import dialog as D
from corpusloom.operators.messages import string_fields
from corpusloom.operators.search import EPSILON, batch_topk

#: Sides from which a turn's context may come: fixed values.
SIDES = ("new_query", "current_query", "multimodal_query")


def rewritten(reply: Column) -> Column:
    """struct(current_query, new_query) of a rewriting model's reply, a JSON object: its string fields, trimmed; blank where it has none."""
    fields = string_fields(reply)
    of = lambda k: F.coalesce(T.blank_to_null(F.try_element_at(fields, F.lit(k))), F.lit(""))
    return F.struct(of("CurrentQuery").alias("current_query"), of("NewQuery").alias("new_query"))


def with_history(turns: DataFrame, history: DataFrame) -> DataFrame:
    """turns (session_id, ...) with history: array of struct(role, content) of the session's earlier turns (session_id, turn, role, text), in
    order, for models that answer; an empty one where there is none."""
    said = history.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("h"))
    said = said.select("session_id", F.transform("h", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("history"))
    none = F.array().cast("array<struct<role:string,content:string>>")
    return turns.join(said, "session_id", "left").withColumn("history", F.coalesce("history", none))


def retrieved(points: DataFrame, asked: DataFrame, limit: int, dims: dict[str, int], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """turn_id and, for each of SIDES, struct(score, text) of its merged context, or null: asked has (turn_id, side, vector_name, vector).

    All vectors of one name are asked in one pass over the points; scores are scaled within each side of a turn, as in any search.
    """
    hits = None
    for name, dim in dims.items():
        mine = asked.filter((F.col("vector_name") == name) & F.col("vector").isNotNull())
        keyed = mine.select((F.col("turn_id") * len(SIDES) + F.array_position(F.array(*map(F.lit, SIDES)), F.col("side")) - 1).alias("query_id"), "vector")
        found = batch_topk(points, keyed, limit, dim, id_col, name)
        hits = found if hits is None else hits.unionByName(found)
    w = Window.partitionBy("query_id")
    least, most = F.min("score").over(w), F.max("score").over(w)
    scaled = F.when((F.count("*").over(w) == 1) | (most - least <= EPSILON), F.col("score")).otherwise((F.col("score") - least) / (most - least + EPSILON))
    hits = hits.withColumn("score", scaled)
    texts = points.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    merged = D.merged_context(hits.join(texts, "id"), ["query_id"], limit).withColumn("turn_id", F.floor(F.col("query_id") / len(SIDES)))
    side = F.pmod("query_id", F.lit(len(SIDES)))
    return merged.groupBy("turn_id").agg(*[F.max(F.when(side == k, F.struct("score", "text"))).alias(s) for k, s in enumerate(SIDES)])


def answered(turns: DataFrame, sides: DataFrame, system: str, answer=None, post=None) -> DataFrame:
    """turns (turn_id, query, image_path, last_assistant, ...) with context, source, prompt, raw, reason and answer. answer and post are
    functions of column expressions (the prompt and the turn; the raw answer), such as a model's UDF; without them the prompt comes back, and
    the raw answer is kept. Turns that skip retrieval have no context."""
    t = turns.join(sides, "turn_id", "left").withColumn("skipped", D.skips_retrieval(F.col("query"), F.col("image_path")))
    none = F.struct(F.lit("").alias("text"), F.lit("").alias("source"))
    chosen = F.when(F.col("skipped"), none).otherwise(D.selected_context(F.col("image_path"), *[F.col(s) for s in SIDES]))
    t = t.withColumn("__c", chosen).withColumn("context", F.col("__c.text")).withColumn("source", F.col("__c.source")).drop("__c", *SIDES)
    t = t.withColumn("prompt", D.prompt(F.lit(system), F.coalesce("query", F.lit("")), F.col("context")))
    t = t.withColumn("raw", answer(F.col("prompt")) if answer else F.col("prompt"))
    t = t.withColumn("post", post(F.col("raw")) if post else F.col("raw"))
    judged = D.judged_answers(t, "raw", "post", "last_assistant")
    return judged.withColumn("answer", D.final_answer(F.col("raw"), F.col("post"), F.col("reason")))
