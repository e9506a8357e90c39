"""Queries on the scalar text functions."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.plans import sqltext as Q
from corpusloom.session import read_table

CHARS, TOKENS = 20, 8


def _docs(spark, d):
    return read_table(spark, d, "documents").filter(F.col("text").isNotNull())


def text_normalised(spark, d):
    t = F.col("text")
    return _docs(spark, d).select(
        "doc_id", F.md5(T.squeeze(t)).alias("squeezed"), T.token_count(t).cast("long").alias("n_tokens"), F.md5(T.overlap_text(t)).alias("normalised"),
        F.size(T.token_set(t)).cast("long").alias("n_distinct"),
    )


def sentence_split(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.simple_sentences(F.col("text"))).alias("sentence_no", "sentence")).withColumn("sentence_no", F.col("sentence_no").cast("long"))


def sentence_flags(spark, d):
    s = sentence_split(spark, d)
    x = F.col("sentence")
    return s.select(
        "doc_id", "sentence_no", T.is_header(x).alias("header"), T.is_numeric(x).alias("is_numeric"), T.is_short(x, CHARS, TOKENS).alias("short"),
        T.is_noise(x, CHARS, TOKENS).alias("noise"), T.attaches(x, CHARS).alias("attaches"),
    )


def header_numeric_noise_counts(spark, d):
    f = sentence_flags(spark, d)
    n = F.count("*")
    return f.groupBy("doc_id").agg(
        n.alias("n_raw"), F.count_if("header").alias("n_header"), F.count_if("is_numeric").alias("n_numeric"), F.count_if("noise").alias("n_noise"),
        F.round(100.0 * F.count_if("header") / n, 2).alias("header_pct"),
    )


def tail_sentences(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(T.tail(T.simple_sentences(F.col("text")), 2), " | ").alias("tail"))


def image_refs(spark, d):
    t = F.col("text")
    rows = _docs(spark, d).filter(t.contains("!["))
    return rows.select("doc_id", F.array_join(T.image_refs(t), ",").alias("refs"), F.md5(T.without_image_refs(t)).alias("rest"))


def text_previews(spark, d):
    return _docs(spark, d).select("doc_id", T.preview(F.col("text"), 60).alias("preview"), T.shortened(F.col("text"), 40).alias("log_line"))


def keyword_join_split(spark, d):
    p = read_table(spark, d, "points").filter(F.size("keywords") > 0)
    joined = F.array_join("keywords", ",")
    return p.select("id", joined.alias("joined"), F.size(F.split(joined, ",")).cast("long").alias("n"))


def same_title_ignoring_case(spark, d):
    docs = read_table(spark, d, "documents")
    return docs.filter(F.lower("title") == F.lower(F.regexp_replace("title", "e", "E"))).groupBy("source").agg(F.count("*").alias("n"))


def file_names(spark, d):
    r = read_table(spark, d, "process_requests")
    return r.select("uuid", "requested_at", T.file_name(F.col("url_download")).alias("file_name"), T.object_key(F.concat(F.lit("data/uploads/"), "uuid"), F.col("url_download")).alias("object_key"), T.is_safe_session_id(F.col("uuid")).alias("safe"))


def rfc3339_round_trip(spark, d):
    p = read_table(spark, d, "points").filter(F.col("created_at").isNotNull())
    text = T.rfc3339(F.col("created_at"))
    return p.select("id", text.alias("created_text"), (T.parse_rfc3339(text) == F.date_trunc("second", "created_at")).alias("same"))


def progress_bars(spark, d):
    e = read_table(spark, d, "embed_results")
    return e.select("topic_name", "topic_partition", "msg_offset", T.progress_bar(F.col("item_count"), F.lit(7), 24).alias("bar"), T.backoff_ms(F.lit(300.0), F.col("item_count")).alias("backoff_ms"))


QUERIES = {f.__name__: f for f in (text_normalised, sentence_split, sentence_flags, header_numeric_noise_counts, tail_sentences, image_refs, text_previews, keyword_join_split, same_title_ignoring_case, file_names, rfc3339_round_trip, progress_bars)}

_SPLIT = f"""(SELECT doc_id, unnest(ss) AS sentence, unnest(range(len(ss))) AS sentence_no
 FROM (SELECT doc_id, {Q.sentences('text')} AS ss FROM documents WHERE text IS NOT NULL))"""
_FLAGS = f"""(SELECT doc_id, sentence_no, {Q.header('sentence')} AS header, {Q.numeric('sentence')} AS is_numeric, {Q.short('sentence', CHARS, TOKENS)} AS short,
 {Q.noise('sentence', CHARS, TOKENS)} AS noise, ({Q.numeric('sentence')} OR {Q.tokens('sentence')} <= 3 OR length({Q.squeeze('sentence')}) < {CHARS // 2}) AS attaches FROM {_SPLIT})"""
_TAIL = f"(SELECT doc_id, {Q.sentences('text')} AS ss FROM documents WHERE text IS NOT NULL)"
_NAME = "coalesce(nullif(regexp_extract(regexp_replace(regexp_replace(url_download, '[?#].*$', ''), '^(https?|file)://[^/]*', ''), '([^/]*)$', 1), ''), 'downloaded_file')"
SQL = {
    "text_normalised": f"""SELECT doc_id, md5({Q.squeeze('text')}) AS squeezed, {Q.tokens('text')}::BIGINT AS n_tokens, md5({Q.overlap('text')}) AS normalised,
 len({Q.token_set('text')})::BIGINT AS n_distinct FROM documents WHERE text IS NOT NULL""",
    "sentence_split": f"SELECT doc_id, sentence_no, sentence FROM {_SPLIT}",
    "sentence_flags": f"SELECT * FROM {_FLAGS}",
    "header_numeric_noise_counts": f"""SELECT doc_id, count(*) AS n_raw, count(*) FILTER (header) AS n_header, count(*) FILTER (is_numeric) AS n_numeric, count(*) FILTER (noise) AS n_noise,
 round(CAST(100.0 AS DOUBLE) * count(*) FILTER (header) / count(*), 2) AS header_pct FROM {_FLAGS} GROUP BY doc_id""",
    "tail_sentences": f"SELECT doc_id, array_to_string(CASE WHEN len(ss) <= 2 THEN ss ELSE ss[len(ss) - 1:] END, ' | ') AS tail FROM {_TAIL}",
    "image_refs": r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '!\[[^\]]*\]\(([^)]+)\)', 1), lambda x: trim(x)), ',') AS refs,
 md5(trim(regexp_replace(text, '!\[[^\]]*\]\(([^)]+)\)', '', 'g'))) AS rest FROM documents WHERE contains(text, '![')""",
    "text_previews": f"""SELECT doc_id, CASE WHEN length({Q.strip('text')}) <= 60 THEN {Q.strip('text')} ELSE substring({Q.strip('text')}, 1, 60) || '...' END AS preview,
 CASE WHEN length({Q.squeeze('text')}) <= 40 THEN {Q.squeeze('text')} ELSE substring({Q.squeeze('text')}, 1, 37) || '...' END AS log_line FROM documents WHERE text IS NOT NULL""",
    "keyword_join_split": "SELECT id, array_to_string(keywords, ',') AS joined, len(string_split(array_to_string(keywords, ','), ','))::BIGINT AS n FROM points WHERE len(keywords) > 0",
    "same_title_ignoring_case": "SELECT source, count(*) AS n FROM documents WHERE lower(title) = lower(replace(title, 'e', 'E')) GROUP BY source",
    "file_names": f"""SELECT uuid, requested_at, {_NAME} AS file_name, uuid || '/' || {_NAME} AS object_key, true AS safe FROM process_requests""",
    "rfc3339_round_trip": "SELECT id, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS created_text, true AS same FROM points WHERE created_at IS NOT NULL",
    "progress_bars": """SELECT topic_name, topic_partition, msg_offset, '[' || repeat('#', f) || repeat('-', 24 - f) || '] ' || printf('%.1f%%', r * 100) AS bar,
 least(CAST(5000 AS DOUBLE), CAST(300 AS DOUBLE) * pow(2, item_count - 1)) AS backoff_ms
 FROM (SELECT *, CAST(floor(r * 24 + CAST(0.5 AS DOUBLE)) AS INTEGER) AS f FROM (SELECT *, CAST(greatest(0, least(item_count, 7)) AS DOUBLE) / 7 AS r FROM embed_results))""",
}
