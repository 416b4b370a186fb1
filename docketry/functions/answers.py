"""Model answers as columns: fenced or surrounded JSON, lists in several wrappings, sparse vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.text import strip


def unfenced(answer: Column) -> Column:
    """The text inside a code fence, or the text itself."""
    text = strip(F.coalesce(answer, F.lit("")))
    inside = F.regexp_replace(F.regexp_replace(text, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.when(text.startswith("```"), inside).otherwise(text)


def json_object(answer: Column) -> Column:
    """The answer's JSON object as text: the whole of it, or else from its first to its last brace; null without one."""
    text = unfenced(answer)

    def is_object(c: Column) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))

    block = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(is_object(text), text).when(is_object(block), block)


def items(answer: Column, item: str) -> Column:
    """array<item> of a list, of ``{"cases": [...]}``, or of one object; empty for anything else.  ``item``: a DDL type."""
    text = unfenced(answer)
    kind = F.coalesce(F.schema_of_variant(F.try_parse_json(text)), F.lit(""))
    wrapped = F.get_json_object(text, "$.cases")
    several = F.from_json(F.when(kind.startswith("ARRAY"), text).when(wrapped.startswith("["), wrapped), f"array<{item}>")
    single = F.from_json(F.when(kind.startswith("OBJECT") & ~F.coalesce(wrapped.startswith("["), F.lit(False)), text), item)
    found = F.when(several.isNotNull(), several).when(single.isNotNull(), F.array(single))
    return F.coalesce(F.filter(found, lambda x: x.isNotNull()), F.array().cast(f"array<{item}>"))


def sparse_vector(weights: Column) -> Column:
    """token -> weight of a JSON map; zeros go, anything that is no map is empty."""
    parsed = F.from_json(weights, "map<string,double>")
    return F.map_filter(F.coalesce(parsed, F.create_map().cast("map<string,double>")), lambda k, v: F.coalesce(v != 0, F.lit(False)))
