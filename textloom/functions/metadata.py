"""Metadata transforms as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_ws

#: Target field and the document-information key it comes from.
INFO_KEYS = {
    "title": "/Title",
    "author": "/Author",
    "producer": "/Producer",
    "creator": "/Creator",
    "creation_date": "/CreationDate",
    "modification_date": "/ModDate",
    "keywords": "/Keywords",
    "rgid": "/rgid",
}
#: Labels that metric exports leave out.
DROPPED_LABELS = ("service.name", "deployment.environment")


def extract_metadata(info: Column, apple_keywords: Column | None = None) -> Column:
    """Struct of the fixed fields, stripped; missing ones are empty."""
    fields = [trim_ws(F.coalesce(F.try_element_at(info, F.lit(key)), F.lit(""))).alias(name) for name, key in INFO_KEYS.items()]
    empty = F.array().cast("array<string>")
    return F.struct(*fields, F.coalesce(apple_keywords if apple_keywords is not None else empty, empty).alias("apple_keywords"))


def normalize_map(info: Column) -> Column:
    """Keys in lower case, values stripped; of keys that collide the later wins.

    Written without a session setting: the last entry of each key is chosen.
    """
    entries = F.transform(F.map_entries(info), lambda e: F.struct(F.lower(e["key"]).alias("key"), trim_ws(e["value"]).alias("value")))

    def last_only(all_: Column) -> Column:
        return F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later["key"] == e["key"]))

    return F.map_from_entries(F.get(F.transform(F.array(entries), last_only), F.lit(0)))


def normalize_date(c: Column) -> Column:
    """A plain calendar date as a timestamp text; anything else as it is."""
    plain = F.regexp_like(c, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}$"))
    parsed = F.when(plain, F.try_to_timestamp(c, F.lit("yyyy-M-d")))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss"), c)


def normalize_document(dates: dict[str, Column], maps: dict[str, Column]) -> Column:
    """Date fields by ``normalize_date``, map fields by ``normalize_map``."""
    return F.struct(*(normalize_date(c).alias(n) for n, c in dates.items()), *(normalize_map(c).alias(n) for n, c in maps.items()))


def flatten_metadata(meta: Column) -> Column:
    """Map of ``meta_`` keys from a VARIANT object: nulls, empty texts, lists
    and objects go; scalars stay; lists lose null and empty members; nested
    objects become JSON text.  Values are given as JSON."""
    entries = F.map_entries(meta.cast("map<string,variant>"))

    def text(v: Column) -> Column:
        return F.to_json(v)

    def value(e: Column) -> Column:
        kind, v = F.schema_of_variant(e["value"]), e["value"]
        members = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.variant_get(x, "$", "string")).otherwise(F.when(F.schema_of_variant(x) != "VOID", text(x))))
        some = F.filter(members, lambda x: x.isNotNull() & (x != ""))
        listed = F.when(F.size(members) > 0, F.to_json(some))
        nested = F.when(kind != "OBJECT<>", text(v))
        scalar = F.when((kind != "VOID") & (text(v) != '""'), text(v))
        return F.when(kind.startswith("ARRAY"), listed).when(kind.startswith("OBJECT"), nested).otherwise(scalar)

    pairs = F.transform(entries, lambda e: F.struct(F.concat(F.lit("meta_"), e["key"]).alias("key"), value(e).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def flatten_strings(info: Column) -> Column:
    """The same for a plain string map: empty and null values go."""
    return F.transform_keys(F.map_filter(info, lambda k, v: v.isNotNull() & (v != "")), lambda k, v: F.concat(F.lit("meta_"), k))


def unprefixed(fields: Column) -> Column:
    """The ``meta_`` entries of a hit's fields, without the prefix."""
    return F.transform_keys(F.map_filter(fields, lambda k, v: k.startswith("meta_")), lambda k, v: F.substring(k, 6, 1 << 20))


def scrub_labels(attrs: Column) -> Column:
    return F.map_filter(attrs, lambda k, v: ~k.isin(*DROPPED_LABELS))
