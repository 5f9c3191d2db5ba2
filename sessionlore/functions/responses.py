"""Columns over model responses in JSON.

Limits of the built-in JSON functions: a text with a repeated key does not
parse; numbers are written as the engine writes them (1.0 as 1); an object
or list in place of a text makes the item invalid, and an empty text of the
summary fields.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionlore.functions.text import col, strip

# Texts that stand for no content.
PLACEHOLDERS = ("", "none", "n/a", "no session notes available.", "no cinematic summary available.")
# Least lengths of both summary fields.
MIN_CHARS, MIN_CHARS_CHUNK = 80, 40


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID, ... ; null for a missing value."""
    return F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)


def as_text(value: Column) -> Column:
    """A JSON value as text: missing is empty, null is ``None``, booleans
    begin with a capital; null for an object or a list."""
    k = kind(value)
    return (
        F.when(value.isNull(), F.lit(""))
        .when(F.is_variant_null(value), F.lit("None"))
        .when(k.isin("OBJECT", "ARRAY"), F.lit(None).cast("string"))
        .when(k == "BOOLEAN", F.initcap(F.try_variant_get(value, "$", "string")))
        .otherwise(F.try_variant_get(value, "$", "string"))
    )


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def normalized(raw: Column | str) -> Column:
    """struct<session_notes_markdown, cinematic_summary_markdown,
    note_updates: array<struct<note_type, title, content, metadata>>>; null
    where the text is no JSON object. Updates without a type, title or
    content go; metadata that is no object becomes ``{}``."""
    value = F.try_parse_json(col(raw))
    text = lambda name: strip(F.coalesce(as_text(field(value, name)), F.lit("")))
    listed = field(value, "note_updates")
    items = F.when(kind(listed) == "ARRAY", F.try_variant_get(listed, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))
    part = lambda x, name: strip(F.coalesce(as_text(field(x, name)), F.lit("")))
    metadata = lambda x: F.when(kind(field(x, "metadata")) == "OBJECT", F.to_json(field(x, "metadata"))).otherwise(F.lit("{}"))
    update = lambda x: F.struct(part(x, "note_type").alias("note_type"), part(x, "title").alias("title"), part(x, "content").alias("content"), metadata(x).alias("metadata"))
    objects = F.filter(items, lambda x: F.coalesce(kind(x) == "OBJECT", F.lit(False)))
    whole = F.filter(F.transform(objects, update), lambda u: (u["note_type"] != "") & (u["title"] != "") & (u["content"] != ""))
    payload = F.struct(text("session_notes_markdown").alias("session_notes_markdown"), text("cinematic_summary_markdown").alias("cinematic_summary_markdown"), whole.alias("note_updates"))
    return F.when(kind(value) == "OBJECT", payload)


def is_placeholder(text: Column) -> Column:
    return F.lower(text).isin(*PLACEHOLDERS)


def has_content(payload: Column, min_chars: int | Column = MIN_CHARS) -> Column:
    """Whether both fields are long enough and no placeholder; false for null."""
    parts = [payload["session_notes_markdown"], payload["cinematic_summary_markdown"]]
    ok = [~is_placeholder(p) & (F.length(p) >= min_chars) for p in parts]
    return F.coalesce(ok[0] & ok[1], F.lit(False))


def least_chars(stage: Column) -> Column:
    return F.when(stage == "chunk", MIN_CHARS_CHUNK).otherwise(MIN_CHARS)


def corrected_metadata(metadata_json: Column | str, user_id: Column | str) -> Column:
    """The JSON object with ``manually_corrected`` and the corrector's id set;
    anything but an object starts from ``{}``. Keys come out sorted."""
    value = F.try_parse_json(col(metadata_json))
    old = F.when(kind(value) == "OBJECT", F.try_variant_get(value, "$", "map<string,variant>"))
    rest = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,variant>")), lambda k, _: ~k.isin("manually_corrected", "corrected_by_user_id"))
    user = F.coalesce(F.to_json(F.named_struct(F.lit("u"), col(user_id))), F.lit("{}"))
    own = F.create_map(F.lit("manually_corrected"), F.parse_json(F.lit("true")), F.lit("corrected_by_user_id"), F.coalesce(F.try_variant_get(F.parse_json(user), "$.u", "variant"), F.parse_json(F.lit("null"))))
    return F.to_json(F.to_variant_object(F.map_concat(rest, own)))
