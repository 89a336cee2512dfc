"""Differences between two copies of the same records, cell by cell.

Both sides are unpivoted to key-field-value rows, one side counting +1 and the other -1. Equal cells cancel in one aggregate; only what is left over is
taken apart and compared as numbers, instants or geometries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers this close are equal.
TOLERANCE = 1e-9
_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
_STRING = r'"(?:[^"\\]|\\.)*+"'
#: A type with its value, another string or a number of JSON.
_TOKEN = rf'"type":{_STRING}|{_STRING}|{_NUMBER}'
_FEATURE = "attributes map<string,variant>, geometry variant, _broken string"


def _cell(kind: str, text: Column, numbers: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"), (numbers if numbers is not None else F.lit(None)).cast("array<double>").alias("numbers"))


def _value_cell(field: Column, value: Column, instants: tuple[str, ...]) -> Column:
    """A JSON value as a comparable cell; null for null. Instants that cannot be read are compared as strings."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    at = F.unix_micros(F.try_to_timestamp(text))
    return (
        F.when(F.is_variant_null(value) | value.isNull(), F.lit(None))
        .when((kind == "STRING") & field.isin(*instants) & at.isNotNull(), _cell("instant", at.cast("string")))
        .when(kind == "STRING", _cell("string", text))
        .when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|FLOAT|DOUBLE|DECIMAL.*)$"), _cell("number", F.lit(""), F.array(F.try_variant_get(value, "$", "double"))))
        .otherwise(_cell("other", text))
    )


def _geometry_cell(geometry: Column) -> Column:
    """The whole value of an object: its types (letter case ignored), all its other text, and the numbers outside strings as numbers.

    The text of a variant has no blanks and its members in the order of their names. A geometry that is no object is compared as its text.
    """
    text = F.try_variant_get(geometry, "$", "string")
    # Strings are taken whole, so that their digits are no coordinates.
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    numbers = F.transform(F.filter(tokens, lambda t: ~t.startswith('"')), lambda t: t.cast("double"))
    strings = F.transform(F.filter(tokens, lambda t: t.startswith('"')), lambda t: F.when(t.startswith('"type":'), F.lower(t)).otherwise(t))
    shape = F.concat_ws(" ", F.array_join(strings, " "), F.regexp_replace(text, _TOKEN, "#"))
    is_object = F.schema_of_variant(geometry).startswith("OBJECT")
    return F.when(geometry.isNotNull() & ~F.is_variant_null(geometry), F.when(is_object, _cell("geometry", shape, numbers)).otherwise(_cell("text", text)))


def _differs(a: str, b: str) -> Column:
    one, two = F.col(a), F.col(b)
    near = (F.size(one["numbers"]) == F.size(two["numbers"])) & ~F.exists(F.zip_with(one["numbers"], two["numbers"], lambda x, y: F.abs(x - y) > TOLERANCE), lambda far: far)
    equal = (one["kind"] == two["kind"]) & (one["text"] == two["text"]) & (one["numbers"].isNull() | near)
    return (one.isNull() != two.isNull()) | (one.isNotNull() & two.isNotNull() & ~F.coalesce(equal, F.lit(False)))


def latest_records(rows: DataFrame, side: str, key: list[str], order: str, values: list[str]) -> DataFrame:
    """One record for each side and key: the copy delivered last; of copies delivered together the largest values."""
    last = F.max(F.struct(F.col(order), *[F.col(v) for v in values])).alias("last")
    return rows.groupBy(side, *key).agg(last).select(side, *key, *[F.col(f"last.{v}").alias(v) for v in values])


def unpivot_records(records: DataFrame, key: list[str]) -> DataFrame:
    """(key..., sign, field, value) of records with sign, change_type and feature (JSON text, parsed once).

    Field '' tells that the record exists, FEATURE that it has a feature, '?' is the text of a feature that is no JSON object. Attribute names are in
    upper case; of names that differ only in case the largest value counts. A value that is null has no row; others are JSON text without blanks,
    members in the order of their names.
    """
    text = F.col("feature")
    parsed = records.withColumn("json", F.from_json(text, _FEATURE, {"columnNameOfCorruptRecord": "_broken"}))
    json = F.col("json")
    broken = ~F.ltrim(text).startswith("{") | (json["_broken"].isNotNull() & json["attributes"].isNull() & json["geometry"].isNull())
    values = [
        (F.lit(""), F.lit("")),
        (F.lit("CHANGE_TYPE"), F.lower("change_type")),
        (F.lit("FEATURE"), F.when(text.isNotNull(), F.lit(""))),
        (F.lit("?"), F.when(broken, text)),
        (F.lit("GEOMETRY"), F.when(~broken & ~F.is_variant_null(json["geometry"]), F.to_json(json["geometry"]))),
    ]
    named = F.transform(
        F.when(~broken, F.coalesce(F.map_entries(json["attributes"]), F.array().cast("array<struct<key string, value variant>>"))),
        lambda e: F.struct(F.upper(e["key"]).alias("field"), F.when(~F.is_variant_null(e["value"]), F.to_json(e["value"])).alias("value")),
    )
    fixed = F.array(*[F.struct(f.alias("field"), v.alias("value")) for f, v in values])
    # A lateral view, not a join: the rows stay where their key is.
    cells = parsed.select(*key, "sign", F.explode(F.concat(fixed, F.coalesce(_largest(named), F.array().cast("array<struct<field string, value string>>")))).alias("c"))
    return cells.select(*key, "sign", "c.field", "c.value").filter("value is not null")


def _largest(named: Column) -> Column:
    """Of cells of one field those with the largest value; mostly every field is there once."""
    fields = F.transform(named, lambda c: c["field"])
    sorted_ = F.array_sort(named)
    last = F.filter(sorted_, lambda c, i: F.coalesce(F.get(sorted_, i + 1)["field"] != c["field"], F.lit(True)))
    return F.when(F.size(F.array_distinct(fields)) < F.size(fields), last).otherwise(named)


def _cell_of(field: Column, value: Column, instants: tuple[str, ...]) -> Column:
    """The value of a field as a comparable cell; null for null."""
    json = F.try_parse_json(value)
    return (
        F.when(value.isNull(), F.lit(None))
        .when(field.isin("", "CHANGE_TYPE", "FEATURE", "?"), _cell("text", value))
        .when(field == "GEOMETRY", _geometry_cell(json))
        .otherwise(_value_cell(field, json, instants))
    )


def record_differences(
    rows: DataFrame,
    key: list[str],
    side: str = "side",
    plus: str = "origin",
    minus: str = "replica",
    order: str = "exported_at",
    instants: tuple[str, ...] = ("EDITED_ON",),
) -> DataFrame:
    """(key..., diff_kind, field): `only_<plus>`, `only_<minus>` (field empty) and `value` for each field that differs.

    Nulls in the key are values of it. A feature that is null on one side only is the field FEATURE, and nothing else of it is compared; features that
    are no JSON objects are compared as text, field FEATURE. A missing attribute equals null; numbers within 1e-9 are equal; instants are compared as
    such; an empty string is not null. Sides other than the two are ignored. Repeats are combined before the shuffle; afterwards all is by key, so
    that unpivoting and both groupings share one partitioning.
    """
    sign = F.when(F.col(side) == plus, 1).when(F.col(side) == minus, -1)
    records = latest_records(rows.filter(F.col(side).isin(plus, minus)), side, key, order, ["change_type", "feature"])
    records = records.withColumn("sign", sign).drop(side).repartition(*key)
    cells = unpivot_records(records, key)
    # Most cells are the same on both sides and go away here.
    left = cells.groupBy(*key, "field", "value").agg(F.sum("sign").alias("net")).filter("net <> 0")
    sides = left.groupBy(*key, "field").agg(F.sum("net").alias("net"), F.max(F.when(F.col("net") > 0, F.col("value"))).alias("plus"), F.max(F.when(F.col("net") < 0, F.col("value"))).alias("minus"))
    compared = sides.select(*key, "field", "net", *[_cell_of(F.col("field"), F.col(v), instants).alias(n) for v, n in (("plus", "a"), ("minus", "b"))])
    open_ = compared.filter((F.col("net") != 0) | _differs("a", "b"))
    by_key = open_.groupBy(*key).agg(F.max(F.when(F.col("field") == "", F.col("net"))).alias("alone"), F.collect_set(F.when(F.col("field") != "", F.col("field"))).alias("fields"))
    no_feature = F.array_contains("fields", "FEATURE") | F.array_contains("fields", "?")
    shown = F.when(no_feature, F.array_union(F.filter("fields", lambda f: f == "CHANGE_TYPE"), F.array(F.lit("FEATURE")))).otherwise(F.col("fields"))
    kinds = (
        F.when(F.col("alone") > 0, F.array(F.struct(F.lit(f"only_{plus}").alias("k"), F.lit("").alias("f"))))
        .when(F.col("alone") < 0, F.array(F.struct(F.lit(f"only_{minus}").alias("k"), F.lit("").alias("f"))))
        .otherwise(F.transform(shown, lambda f: F.struct(F.lit("value").alias("k"), f.alias("f"))))
    )
    return by_key.select(*key, F.explode(kinds).alias("d")).select(*key, F.col("d.k").alias("diff_kind"), F.col("d.f").alias("field"))
