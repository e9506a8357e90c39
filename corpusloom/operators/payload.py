"""Payloads as maps of strings and as typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import parse_rfc3339, rfc3339

STRINGS = ("doc_id", "source_path", "modality", "unit_type", "text", "ocr_text", "image_path", "section_title", "lang", "parent_id")
INTEGERS = ("page", "chunk_index", "token_count")
BOOLEANS = ("has_table", "has_figure")
#: Spellings of booleans: fixed values.
TRUE, FALSE = ("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")


#: A box on a page; one that lacks a coordinate is none.
BOX = "x1 int, y1 int, x2 int, y2 int"


def _whole(box: Column) -> Column:
    return box["x1"].isNotNull() & box["y1"].isNotNull() & box["x2"].isNotNull() & box["y2"].isNotNull()


def typed_payload(m: Column) -> list[Column]:
    """Columns of a map of strings: what doesn't parse is 0, false or null; unknown keys are left out; keywords are split, not trimmed."""
    at = lambda k: m[k]
    out = [F.coalesce(at(k), F.lit("")).alias(k) for k in STRINGS]
    for k in INTEGERS:
        out.append(F.coalesce(F.when(at(k).rlike(r"^[+-]?[0-9]+$"), at(k).try_cast("int")), F.lit(0)).alias(k))
    for k in BOOLEANS:
        out.append(F.coalesce(at(k).isin(*TRUE), F.lit(False)).alias(k))
    out.append(F.when(F.coalesce(at("keywords"), F.lit("")) != "", F.split(at("keywords"), ",", -1)).alias("keywords"))
    out.append(parse_rfc3339(at("created_at")).alias("created_at"))
    box = F.from_json(at("bbox"), BOX)
    out.append(F.when(_whole(box), box).alias("bbox"))
    return out


def payload_map(columns: list[str]) -> Column:
    """The map of strings of typed columns. Empty strings, zeros, false, empty lists and nulls have no entry."""
    have = set(columns)
    pairs: list[Column] = []
    for k in STRINGS:
        if k in have:
            pairs += [F.lit(k), F.nullif(F.col(k), F.lit(""))]
    for k in INTEGERS:
        if k in have:
            pairs += [F.lit(k), F.when(F.col(k) != 0, F.col(k).cast("string"))]
    for k in BOOLEANS:
        if k in have:
            pairs += [F.lit(k), F.when(F.col(k), F.lit("true"))]
    if "keywords" in have:
        pairs += [F.lit("keywords"), F.when(F.size("keywords") > 0, F.array_join("keywords", ","))]
    if "created_at" in have:
        pairs += [F.lit("created_at"), rfc3339(F.col("created_at"))]
    if "bbox" in have:
        pairs += [F.lit("bbox"), F.when(_whole(F.col("bbox")), F.to_json("bbox"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
