"""Queries of problem 9."""

from corpusloom.llm.leakage import leaked_items
from corpusloom.session import read_table


def p9_report(spark, d):
    return leaked_items(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p9_found(spark, d):
    return p9_report(spark, d).select("doc_id", "item_id")


QUERIES = {"p9_found": p9_found, "p9_report": p9_report}

_PAIRS = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM eval_items WHERE text IS NOT NULL),
iw AS (SELECT item_id, k, len(ws) AS n_words, array_to_string(ws[k:k + 14], ' ') AS g FROM i, unnest(generate_series(1, len(ws) - 14)) AS t(k)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(ws[k:k + 14], ' ') AS g FROM d, unnest(generate_series(1, len(ws) - 14)) AS t(k)),
hit AS (SELECT DISTINCT doc_id, item_id, k, n_words FROM iw JOIN dw USING (g)),
cov AS (SELECT DISTINCT doc_id, item_id, n_words, k + j AS place FROM hit, unnest(generate_series(0, 14)) AS t(j))
"""
SQL = {
    "p9_found": _PAIRS + "SELECT DISTINCT doc_id, item_id FROM hit",
    "p9_report": _PAIRS + "SELECT doc_id, item_id, count(*)::INTEGER AS words_found, round(count(*) / max(n_words), 6) AS share FROM cov GROUP BY doc_id, item_id",
}
