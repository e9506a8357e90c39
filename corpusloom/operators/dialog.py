"""Conversational retrieval: intent gate, context, prompts, acceptance of answers, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: Least fused score of a context, and least overlap of a rewritten answer with the raw one: fixed values.
CONTEXT_SCORE, ANSWER_OVERLAP = 0.55, 0.08
SEPARATOR = "\n\n---\n\n"


def skips_retrieval(query: Column, image_path: Column) -> Column:
    """No image, and a question that is blank or holds a greeting anywhere, inside words too."""
    q = T.overlap_text(F.coalesce(query, F.lit("")))
    greets = F.lit(False)
    for g in T.GREETINGS:
        greets = greets | q.contains(g)
    return T.blank_to_null(image_path).isNull() & ((q == "") | greets)


def last_assistant(turns: DataFrame, keys: list[str], turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """keys, last_assistant: the trimmed text of the last assistant turn that isn't blank."""
    said = turns.filter((F.lower(F.trim(F.col(role))) == "assistant") & T.blank_to_null(F.col(text)).isNotNull())
    return said.groupBy(*keys).agg(F.max_by(T.blank_to_null(F.col(text)), turn).alias("last_assistant"))


def judged_answers(rows: DataFrame, raw: str = "raw", post: str = "post", last: str = "last") -> DataFrame:
    """rows with reason: why a rewritten answer is refused, or 'accepted'. Each text is normalised once, and its words are taken once."""
    made = rows.withColumn("__post", F.coalesce(T.blank_to_null(F.col(post)), F.lit(""))).withColumn("__plain", T.overlap_text(F.col("__post")))
    made = made.withColumn("__words", T.words_of_overlap(F.col("__plain"))).withColumn("__raw", T.words_of_overlap(T.overlap_text(F.coalesce(raw, F.lit("")))))
    generic = F.lit(False)
    for g in T.GENERIC_REPLIES:
        generic = generic | F.col("__plain").contains(g)
    p, before = F.col("__post"), T.blank_to_null(F.col(last))
    reason = (
        F.when(p == "", "empty_postprocess")
        .when(T.token_count(p) < 4, "too_short")
        .when(generic, "generic_reply")
        .when(F.coalesce(F.lower(before) == F.lower(p), F.lit(False)), "duplicate_last_assistant")
        .when(T.ratio_of_words(F.col("__raw"), F.col("__words")) < ANSWER_OVERLAP, "low_overlap_with_raw_answer")
        .otherwise("accepted")
    )
    return made.withColumn("reason", reason).drop("__post", "__plain", "__words", "__raw")


def final_answer(raw: Column, post: Column, verdict: Column) -> Column:
    return F.when(verdict == "accepted", T.blank_to_null(post)).otherwise(raw)


def merged_context(hits: DataFrame, keys: list[str], most: int = 100) -> DataFrame:
    """keys, id, score, text: the best hit with the distinct texts of all hits (rank up to `most`), in order of rank, joined."""
    ranked = hits.filter(F.col("rank") <= most)
    texts = F.array_sort(F.collect_list(F.struct("rank", F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("text"))))
    g = ranked.groupBy(*keys).agg(F.min_by(F.struct("id", "score", "text"), "rank").alias("base"), texts.alias("texts"))
    parts = F.array_distinct(F.filter(F.transform("texts", lambda x: x["text"]), lambda x: x.isNotNull() & (x != "")))
    text = F.when(F.size(parts) > 0, F.array_join(parts, SEPARATOR)).otherwise(F.col("base.text"))
    return g.select(*keys, "base.id", "base.score", text.alias("text"))


def selected_context(image_path: Column, new: Column, current: Column, multimodal: Column) -> Column:
    """struct(text, source) of the context that passes; the sides are structs (score, text) or null. With an image only the multimodal
    side counts; else the new question's, the current one's, then the multimodal side."""
    def take(side: Column, name: str) -> Column:
        return F.when(side["score"] >= CONTEXT_SCORE, F.struct(F.coalesce(F.trim(side["text"]), F.lit("")).alias("text"), F.lit(name).alias("source")))

    none = F.struct(F.lit("").alias("text"), F.lit("").alias("source"))
    pictured = F.coalesce(take(multimodal, "multimodal_query"), none)
    plain = F.coalesce(take(new, "new_query"), take(current, "current_query"), take(multimodal, "multimodal_query"), none)
    return F.when(T.blank_to_null(image_path).isNotNull(), pictured).otherwise(plain)


def prompt(system: Column, query: Column, context: Column) -> Column:
    asked = F.when(T.blank_to_null(context).isNull(), query).otherwise(F.concat(query, F.lit("\n\nContext:\n"), context))
    return F.regexp_replace(F.concat_ws(" ", system, asked), r"(?U)^\s+|\s+$", "")


def appended_turns(history: DataFrame, pairs: DataFrame) -> DataFrame:
    """history (conv_id, turn, role, text) with one more user and assistant turn for each of pairs (conv_id, question, answer)."""
    last = history.groupBy("conv_id").agg(F.max("turn").alias("last"))
    new = pairs.join(last, "conv_id", "left").select(
        "conv_id", F.explode(F.array(
            F.struct((F.coalesce("last", F.lit(0)) + 1).cast("long").alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text")),
            F.struct((F.coalesce("last", F.lit(0)) + 2).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text")))).alias("t"),
    )
    return history.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(new.select("conv_id", "t.turn", "t.role", "t.text"))


def history_until(turns: DataFrame, keys: list[str], turn: str, last: int) -> DataFrame:
    """The last `last` turns of each conversation (all, in order, is the table itself)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(turn))
    return turns.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= last)
