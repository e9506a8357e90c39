"""Queries on messages delivered more than once (problem 6)."""

from pyspark.sql import functions as F

from corpusloom.operators.delivery import deduplicated_replies, repeated_identifiers
from corpusloom.session import read_table


def p6_found(spark, d):
    return repeated_identifiers(read_table(spark, d, "embed_results")).select("correlation_id")


def p6_deduplicated(spark, d):
    out = deduplicated_replies(read_table(spark, d, "embed_results"))
    return out.select("message_id", "copies", "topic_name", "topic_partition", "msg_offset", "reply_status", "item_count", "replied_at")


QUERIES = {"p6_found": p6_found, "p6_deduplicated": p6_deduplicated}

# Unicode white space, as in the Java class; RE2 needs it spelled out.
_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _clean(x: str) -> str:
    return f"nullif(regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g'), '')"


_ID = f"coalesce({_clean('correlation_id')}, {_clean('msg_key')}, {_clean("headers['correlation_id']")})"

SQL = {
    "p6_found": f"SELECT correlation_id FROM (SELECT {_ID} AS correlation_id FROM embed_results) WHERE correlation_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "p6_deduplicated": f"""
WITH m AS (SELECT *, {_ID} AS message_id FROM embed_results),
r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY message_id) AS n FROM m
      WINDOW w AS (PARTITION BY message_id ORDER BY replied_at NULLS LAST, topic_name NULLS LAST, topic_partition NULLS LAST, msg_offset NULLS LAST))
SELECT message_id, CASE WHEN message_id IS NULL THEN 1 ELSE n END AS copies, topic_name, topic_partition, msg_offset, reply_status, item_count, replied_at
FROM r WHERE rn = 1 OR message_id IS NULL""",
}
