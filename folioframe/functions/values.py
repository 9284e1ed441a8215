"""Dates, numbers, vectors, boxes, hashes, JSON and small array functions as Columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: inside a higher-order function a captured expression is computed anew for
    every element, a lambda's own variable is not."""
    return F.get(F.transform(F.array(value), use), 0)


def excel_date(serial: Column) -> Column:
    """A spreadsheet's serial number as ``YYYY-MM-DD`` or, with a time of day, ``YYYY-MM-DD HH:MM:SS``; null below 1.

    Serials up to 59 lie before the day that never was and are shifted by one.
    """
    day = F.floor(serial).cast("int")
    shift = day + F.when(day <= 59, 1).otherwise(0)
    date = F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), shift), "yyyy-MM-dd")
    seconds = F.round((serial - F.floor(serial)) * 86400).cast("int")
    time = F.format_string("%02d:%02d:%02d", (seconds / 3600).cast("int"), ((seconds % 3600) / 60).cast("int"), seconds % 60)
    return F.when(serial >= 1, F.when(serial - F.floor(serial) > 1e-4, F.concat_ws(" ", date, time)).otherwise(date))


def looks_like_date(text: Column) -> Column:
    """``YYYY-MM-DD`` or with slashes, anything after it; no check of the calendar."""
    return F.trim(text).rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}")


def cell_number(x: Column) -> Column:
    """A number as a cell shows it: whole numbers without a point, others with at most six decimals."""
    return F.when(x.isNotNull() & (x == F.floor(x)), F.format_string("%d", x.cast("bigint"))).when(x.isNotNull(), F.rtrim(F.rtrim(F.format_string("%.6f", x), F.lit("0")), F.lit(".")))


def similarity(distance: Column) -> Column:
    """100 at distance 0, falling by 50 per unit, never below 0."""
    return F.greatest(100.0 - 50.0 * distance, F.lit(0.0))


def rrf_score(vector_rank: Column, keyword_rank: Column) -> Column:
    """Weighted reciprocal rank fusion of two legs, about 100 for first in both; a missing rank adds nothing."""
    part = lambda w, r: F.coalesce(w / (60.0 + r), F.lit(0.0))
    return F.least(F.lit(100.0), 6100.0 * (part(F.lit(0.6), vector_rank) + part(F.lit(0.4), keyword_rank)))


def sigmoid(x: Column, middle: float, slope: float) -> Column:
    return 1.0 / (1.0 + F.exp(-slope * (x - middle)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return F.when(v.isNotNull(), let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def area(b: Column) -> Column:
    return b["width"] * b["height"]


def overlap(a: Column, b: Column) -> Column:
    """Area two boxes (x, y, width, height) share."""
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def contains(outer: Column, inner: Column, share: float = 0.8) -> Column:
    """More than this share of ``inner`` lies in ``outer``."""
    return F.when(area(inner) > 0, overlap(outer, inner) / area(inner) > share).otherwise(False)


def center_in(inner: Column, outer: Column) -> Column:
    cx, cy = inner["x"] + inner["width"] / 2, inner["y"] + inner["height"] / 2
    return (cx >= outer["x"]) & (cx <= outer["x"] + outer["width"]) & (cy >= outer["y"]) & (cy <= outer["y"] + outer["height"])


def content_hash(content: Column) -> Column:
    """SHA-256 of a content, for change detection and document ids."""
    return F.sha2(content, 256)


def path_hash(path: Column) -> Column:
    return F.md5(path)


def breadcrumbs(trail: Column) -> Column:
    return F.array_join(trail, " > ")


def last_breadcrumb(text: Column) -> Column:
    return F.element_at(F.split(text, " > "), -1)


def merge_headers(levels: Column) -> Column:
    """One name from the header cells of a column, top down: blanks and repeats of the level above skipped, joined by ``_``."""
    kept = F.aggregate(
        levels, F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isNull() | (F.trim(x) == "") | (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) == F.trim(x)), acc).otherwise(F.array_append(acc, F.trim(x))),
    )
    return F.array_join(kept, "_")


def map_get(m: Column, key: str, default: str) -> Column:
    return F.coalesce(m[key], F.lit(default))


def first_json_object(text: str | None) -> str | None:
    """The first balanced JSON object of a model's answer: fenced, bare, or else between the outermost braces."""
    if not text:
        return None
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", text, re.S)
    for part in ([fenced[1]] if fenced else []) + [text]:
        start = part.find("{")
        while start >= 0:
            try:
                return json.dumps(json.JSONDecoder().raw_decode(part[start:])[0], ensure_ascii=False)
            except ValueError:
                start = part.find("{", start + 1)
    return None


@F.pandas_udf(StringType())
def extract_json(text: pd.Series) -> pd.Series:
    return text.map(first_json_object)


# Type names and their aliases.
RELATION_ALIASES = {"依赖": "depends-on", "depends": "depends-on", "depends_on": "depends-on", "uses": "uses", "使用": "uses", "belongs_to": "belongs-to", "属于": "belongs-to", "part-of": "belongs-to", "co_occurrence": "co-occurrence", "共现": "co-occurrence", "contains": "contains", "包含": "contains", "compared_with": "compared-with", "对比": "compared-with"}
ENTITY_ALIASES = {"person": "Person", "人物": "Person", "people": "Person", "organization": "Organization", "organisation": "Organization", "组织": "Organization", "company": "Organization", "technology": "Technology", "技术": "Technology", "tool": "Technology", "concept": "Concept", "概念": "Concept"}


def _mapped(c: Column, names: dict[str, str]) -> Column:
    low = F.lower(F.trim(c))
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[low]


def relation_type(c: Column) -> Column:
    """The plain name of a relation type: aliases resolved, others in lower case, blank or null ``related-to``."""
    return F.coalesce(_mapped(c, RELATION_ALIASES), F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("related-to"))


def entity_type(c: Column) -> Column:
    """Person, Organization, Technology or Concept; anything unknown is a Concept."""
    return F.coalesce(_mapped(c, ENTITY_ALIASES), F.lit("Concept"))


GRAPH_ANSWER = "struct<entities:array<struct<name:string,type:string>>,relations:array<struct<from:string,to:string,type:string>>>"


def parse_graph_answer(text: Column) -> Column:
    """Entities and relations of a model's answer; null where it holds no JSON object."""
    return F.from_json(extract_json(text), GRAPH_ANSWER)
