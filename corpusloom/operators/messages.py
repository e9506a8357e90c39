"""Messages: decoding, schemas of structured output, requests and their replies, sessions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import blank_to_null

#: Types of a structured output's fields: fixed values.
FIELD_TYPES = ("string", "number", "integer", "boolean", "object", "array")


def resolve_id(*candidates: Column) -> Column:
    """The first that is not blank, trimmed; process requests ask body, header, key, replies body, key, header."""
    return F.coalesce(*[blank_to_null(c) for c in candidates])


def strict_json(text: Column, schema: str, fields: list[str]) -> Column:
    """The struct of a JSON object, or null where it is malformed, holds other fields or goes on after the object."""
    keys = F.json_object_keys(text)
    known = F.size(F.array_except(keys, F.array(*[F.lit(f) for f in fields]))) == 0
    # As the only item of an array: nothing may follow the object.
    whole = F.size(F.from_json(F.to_json(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))), "array<string>")) == 1
    return F.when(whole & keys.isNotNull() & known, F.from_json(text, schema))


def lenient_json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def string_fields(text: Column) -> Column:
    """Map of the fields of a JSON object that are strings; other fields are left out."""
    values = F.from_json(text, "map<string,variant>")
    strings = F.map_filter(values, lambda k, v: F.schema_of_variant(v) == "STRING")
    return F.transform_values(strings, lambda k, v: F.variant_get(v, "$", "string"))


def output_schema(fields: dict[str, str] | None) -> dict | None:
    """JSON schema of a structured output. A value is a type name or a schema of its own as JSON; unknown types are strings; all fields
    are required and no others allowed; no field gives no schema."""
    properties: dict[str, dict] = {}
    for name, value in (fields or {}).items():
        name, value = name.strip(), (value or "").strip()
        if not name:
            continue
        own = None
        if value.startswith("{"):
            try:
                own = json.loads(value)
            except ValueError:
                own = None
        if isinstance(own, dict) and own:
            properties[name] = own
        else:
            properties[name] = {"type": value.lower() if value.lower() in FIELD_TYPES else "string"}
    if not properties:
        return None
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


def first_replies(requests: DataFrame, replies: DataFrame, seconds: int = 90) -> DataFrame:
    """Requests (cid, asked_at, ...) with their first reply (cid, replied_at, status) within the deadline, and what became of them:
    ok, failed, or timeout. Of equal times the status decides, by name; null cids match nothing.

    Time is cut into stretches as long as the deadline, and requests and replies of a cid and stretch stand in one sequence: a request's
    first reply follows it there, or is the first of the next stretch. So no request meets all replies, and a hot cid is many groups.
    """
    stretch = lambda c: F.floor(F.unix_micros(c) / F.lit(seconds * 1_000_000)).cast("long")
    r = replies.filter("cid IS NOT NULL AND replied_at IS NOT NULL").select("cid", "replied_at", F.lower(F.trim("status")).alias("status"))
    r = r.groupBy("cid", "replied_at").agg(F.min("status").alias("status"))
    reply = F.struct("replied_at", "status")
    asked = requests.select("cid", F.col("asked_at").alias("__at"), stretch("asked_at").alias("__stretch"), F.struct(*requests.columns).alias("__request"), F.lit(None).cast("struct<replied_at:timestamp,status:string>").alias("__reply"))
    told = r.select("cid", F.col("replied_at").alias("__at"), stretch("replied_at").alias("__stretch"), F.lit(None).cast(asked.schema["__request"].dataType).alias("__request"), reply.alias("__reply"))
    # From the last to the first; at the same time replies come before requests, which may have them.
    w = Window.partitionBy("cid", "__stretch").orderBy(F.desc("__at"), F.col("__request").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = asked.unionByName(told).withColumn("__next", F.last("__reply", ignorenulls=True).over(w)).filter(F.col("__request").isNotNull())
    first = r.groupBy("cid", (stretch("replied_at") - 1).alias("__stretch")).agg(F.min(reply).alias("__later"))
    met = met.join(first, ["cid", "__stretch"], "left").withColumn("m", F.when(F.col("cid").isNotNull(), F.coalesce("__next", "__later")))
    late = F.col("m.replied_at") > F.col("__at") + F.make_dt_interval(secs=F.lit(float(seconds)))
    met = met.withColumn("m", F.when(~late, F.col("m")))
    outcome = F.when(F.col("m").isNull(), "timeout").when(F.col("m.status") == "failed", "failed").otherwise("ok")
    return met.select("__request.*", F.col("m.replied_at").alias("replied_at"), outcome.alias("outcome"))


def sessions(events: DataFrame, user: str, ts: str, ttl_minutes: int = 30) -> DataFrame:
    """user, session_start, session_end (last event), n_events: events of a user with gaps under the time to live."""
    w = F.session_window(F.col(ts), f"{ttl_minutes} minutes")
    g = events.groupBy(user, w.alias("w")).agg(F.count("*").alias("n_events"), F.max(ts).alias("session_end"))
    return g.select(user, F.col("w.start").alias("session_start"), "session_end", "n_events")
