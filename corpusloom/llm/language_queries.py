"""Queries of problem 5."""

from pyspark.sql import functions as F

from corpusloom.llm.languages import detect_languages, label_language, languages_held, train, training_sample
from corpusloom.session import read_table, written


def language_models(spark, d):
    """Models trained on a bounded sample of the labelled texts of points and documents."""
    points, documents = read_table(spark, d, "points"), read_table(spark, d, "documents")
    sample = training_sample(points.select(F.col("id").alias("key"), "text", F.col("lang").alias("label")))
    sample += training_sample(documents.select(F.col("doc_id").cast("string").alias("key"), "text", F.col("lang").alias("label")))
    return train(sample)


def _found(spark, d, least):
    """Languages of the texts of points, from so many characters on, and of documents. main: the language of most of the characters;
    sure: the confidence of its surest stretch; long: the text has the 40 characters that a point needs to count for its request."""
    models = language_models(spark, d)
    points = read_table(spark, d, "points").filter(F.length("text") >= least)
    documents = read_table(spark, d, "documents").filter("text IS NOT NULL")
    keyed = points.select(F.to_json(F.struct(F.lit("point").alias("k"), "id", "lang", "doc_id", (F.length("text") >= 40).alias("long"))).alias("key"), "text").unionByName(
        documents.select(F.to_json(F.struct(F.lit("document").alias("k"), F.col("doc_id").cast("string").alias("id"), "lang")).alias("key"), "text")
    )
    found = detect_languages(keyed, models)
    key = F.from_json("key", "k string, id string, lang string, doc_id string, long boolean")
    main = F.element_at(
        F.array_sort(
            F.transform(F.array_distinct(F.transform("segments", lambda s: s["lang"])), lambda lang: F.struct(
                (-F.aggregate(F.filter("segments", lambda s: s["lang"] == lang), F.lit(0), lambda a, s: a + s["end"] - s["first"])).alias("n"), lang.alias("lang")))
        ), 1)["lang"]
    found = found.select(key.alias("key"), "lang", "confidence", "segments").withColumn("main", F.when(F.size("segments") > 0, main))
    sure = F.array_max(F.transform(F.filter("segments", lambda s: s["lang"] == F.col("main")), lambda s: s["confidence"]))
    return found.select("key.k", "key.id", F.col("key.lang").alias("label"), "key.doc_id", "key.long", "lang", "main", "confidence", sure.alias("sure"), "segments")


def _detected(spark, d):
    found = _found(spark, d, 40)
    return written(found.select("k", "id", "label", "doc_id", "main", "confidence", languages_held(found).alias("held")), "languages")


def p5_found(spark, d):
    found = _detected(spark, d)
    texts = found.select(F.col("k").alias("record_kind"), F.col("id").alias("record_key"), label_language(F.col("label")).alias("named"), F.explode("held").alias("lang"))
    own = texts.filter(F.col("named").isNull() | (F.col("named") != F.col("lang"))).drop("named")
    votes = found.filter((F.col("k") == "point") & F.col("doc_id").isNotNull()).groupBy("doc_id", "main").agg(F.count("*").alias("n"))
    top = votes.groupBy("doc_id").agg(F.max(F.struct("n", "main")).alias("best"), F.sum("n").alias("total"))
    top = top.filter((F.col("best.n") * 2 > F.col("total")) & F.col("best.main").isNotNull()).select("doc_id", F.col("best.main").alias("lang"))
    requests = read_table(spark, d, "process_requests").select(F.col("uuid").alias("doc_id"), label_language(F.col("lang")).alias("named"))
    asked = requests.join(top, "doc_id").filter(F.col("named").isNull() | (F.col("named") != F.col("lang")))
    asked = asked.select(F.lit("request").alias("record_kind"), F.col("doc_id").alias("record_key"), "lang")
    return own.unionByName(asked).distinct()


def p5_segments(spark, d):
    """Every text of points and documents with its language and confidence (first and end are null), and every stretch of it; and every
    request with the language that most of its points have. A request's confidence is their share times their mean confidence, so
    without a majority it is at most a half; points of fewer than 40 characters count only if it has no others. Texts without words,
    and requests without such texts, have no language."""
    found = _found(spark, d, 0).select("k", "id", "doc_id", "long", "lang", "main", "confidence", "sure", "segments")
    found = written(found, "stretches")
    keys, none = [F.col("k").alias("record_kind"), F.col("id").alias("record_key")], F.lit(None).cast("int")
    texts = found.select(*keys, none.alias("first"), none.alias("end"), "lang", "confidence")
    stretches = found.select(*keys, F.explode("segments").alias("s")).select("record_kind", "record_key", "s.first", "s.end", "s.lang", "s.confidence")
    points = found.filter((F.col("k") == "point") & F.col("doc_id").isNotNull())
    # First the sums over points that are long enough, then those over all.
    votes = points.groupBy("doc_id", "main").agg(*[f.alias(x) for p, c in (("l", F.col("long")), ("a", F.lit(True))) for x, f in ((f"n_{p}", F.count_if(c)), (f"s_{p}", F.sum(F.when(c, F.col("sure")))))])
    best = F.max(F.when(F.col("main").isNotNull(), F.struct("n_l", "n_a", "main", "s_l", "s_a")))
    top = votes.groupBy("doc_id").agg(best.alias("best"), F.sum("n_l").alias("t_l"), F.sum("n_a").alias("t_a"))
    share = F.when(F.col("best.n_l") > 0, F.col("best.s_l") / F.col("t_l")).otherwise(F.col("best.s_a") / F.col("t_a"))
    top = top.select(F.col("doc_id").alias("record_key"), F.col("best.main").alias("lang"), share.alias("confidence"))
    requests = read_table(spark, d, "process_requests").filter("uuid IS NOT NULL").select(F.col("uuid").alias("record_key")).distinct()
    asked = requests.join(top, "record_key", "left").select(F.lit("request").alias("record_kind"), "record_key", none.alias("first"), none.alias("end"), "lang", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return texts.unionByName(stretches).unionByName(asked).withColumn("confidence", F.round("confidence", 6))


QUERIES = {"p5_found": p5_found, "p5_segments": p5_segments}
SQL = {}
