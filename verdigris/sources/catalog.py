"""Table and version catalogs: item rows, definition documents, field types, registry join."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Geometry codes of catalog items.
GEOMETRY_CODES = {1: "Point", 2: "MultiPoint", 3: "LineString", 4: "Polygon", 9: "MultiPoint"}
# Field types by the names of SQL columns; others are strings.
SQL_TYPES = {
    "smallint": "SMALLINTEGER", "int": "INTEGER", "integer": "INTEGER", "bigint": "INT64", "real": "FLOAT", "float": "DOUBLE", "double precision": "DOUBLE",
    "decimal": "DOUBLE", "numeric": "DOUBLE", "varchar": "STRING", "nvarchar": "STRING", "char": "STRING", "nchar": "STRING", "text": "STRING", "ntext": "STRING",
    "datetime": "DATE", "datetime2": "DATE", "timestamp": "DATE", "date": "DATEONLY", "time": "TIMEONLY", "uniqueidentifier": "GUID", "uuid": "GUID",
    "varbinary": "BLOB", "image": "BLOB", "bytea": "BLOB", "geometry": "GEOMETRY", "geography": "GEOMETRY",
}
# Field types by the last part of their names in definition documents; others are strings.
DOCUMENT_TYPES = {
    "smallinteger": "SMALLINTEGER", "integer": "INTEGER", "single": "FLOAT", "double": "DOUBLE", "string": "STRING", "date": "DATE", "oid": "OID", "geometry": "GEOMETRY",
    "blob": "BLOB", "raster": "RASTER", "guid": "GUID", "globalid": "GLOBALID", "xml": "XML", "biginteger": "INT64", "dateonly": "DATEONLY", "timeonly": "TIMEONLY",
}
SPARK_TYPES = {
    "SMALLINTEGER": T.ShortType(), "INTEGER": T.IntegerType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "DATE": T.TimestampNTZType(),
    "OID": T.LongType(), "GEOMETRY": T.BinaryType(), "BLOB": T.BinaryType(), "RASTER": T.BinaryType(), "GUID": T.StringType(), "GLOBALID": T.StringType(), "XML": T.StringType(),
    "INT64": T.LongType(), "DATEONLY": T.DateType(), "TIMEONLY": T.StringType(), "DATETIMEWITHOFFSET": T.TimestampType(),
}
# Columns of the storage that are no fields.
INTERNAL_FIELDS = frozenset(("sde_state_id", "gdb_geomattr_data"))
# Fixed value: the flag of versioned tables.
VERSIONED_FLAG = 8


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    alias: str | None = None
    nullable: bool = True
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    default: str | None = None

    def struct_field(self) -> T.StructField:
        extra = {k: v for k, v in (("alias", self.alias), ("length", self.length), ("precision", self.precision), ("scale", self.scale), ("default", self.default)) if v is not None}
        return T.StructField(self.name, SPARK_TYPES[self.type], self.nullable and self.type != "OID", {"type": self.type, **extra})


@dataclass(frozen=True)
class Definition:
    fields: tuple[Field, ...] = field(default_factory=tuple)
    srid: int | None = None
    shape_type: str | None = None

    def schema(self) -> T.StructType:
        return T.StructType([f.struct_field() for f in self.fields])


def sql_type(name: str) -> str:
    return SQL_TYPES.get(name.lower().split("(")[0].strip(), "STRING")


def document_type(name: str) -> str:
    return DOCUMENT_TYPES.get(re.sub(r"^.*fieldtype", "", name.strip().lower()), "STRING")


def shape_kind(name: str | None) -> str | None:
    """Point, MultiPoint, LineString or Polygon of a document's shape type, e.g. `...GeometryPolyline`."""
    if not name:
        return None
    last = re.sub(r"^.*geometry", "", name.strip().lower())
    return {"point": "Point", "multipoint": "MultiPoint", "polyline": "LineString", "line": "LineString", "polygon": "Polygon"}.get(last)


def split_physical_name(name: str) -> tuple[str, str]:
    """(schema, table): the last two parts of a dotted name, schema dbo where there is only one."""
    parts = name.split(".")
    return (parts[-2], parts[-1]) if len(parts) > 1 else ("dbo", parts[-1])


def tag(text: str, name: str) -> str | None:
    """Content of the first element of a name, without nesting of the same name."""
    m = re.search(rf"<{re.escape(name)}(?:\s[^>]*)?>(.*?)</{re.escape(name)}>", text, re.DOTALL)
    return m[1].strip() if m else None


def _blocks(text: str, name: str) -> list[str]:
    return re.findall(rf"<{re.escape(name)}(?:\s[^>]*)?>(.*?)</{re.escape(name)}>", text, re.DOTALL)


def _whole(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def parse_definition(document: str | None) -> Definition:
    """Fields, spatial reference and shape type of a definition document; without field-info elements plain fields count; nothing for null or empty."""
    if not document:
        return Definition()
    fields = []
    for block in _blocks(document, "GPFieldInfoEx") or _blocks(document, "Field"):
        name = tag(block, "Name")
        if not name:
            continue
        nullable = tag(block, "IsNullable")
        fields.append(
            Field(
                name,
                document_type(tag(block, "FieldType") or tag(block, "Type") or ""),
                tag(block, "AliasName"),
                nullable is None or nullable.lower() != "false",
                _whole(tag(block, "Length")),
                _whole(tag(block, "Precision")),
                _whole(tag(block, "Scale")),
                tag(block, "DefaultValue") or tag(block, "DefaultValueString"),
            )
        )
    return Definition(tuple(fields), _whole(tag(document, "LatestWKID")) or _whole(tag(document, "WKID")), shape_kind(tag(document, "ShapeType")))


def merge_fields(document: list[Field], live: list[Field], shape_field: str | None) -> list[Field]:
    """The document's fields in their order, then columns that only the live table has; letter case ignored; without the shape field and internal columns."""
    hidden = INTERNAL_FIELDS | ({shape_field.lower()} if shape_field else set())
    merged, seen = [], set()
    for one in (*document, *live):
        key = one.name.lower()
        if key not in seen and key not in hidden:
            seen.add(key)
            merged.append(one)
    return merged


def live_fields(rows: DataFrame) -> list[Field]:
    """Fields of a table that is there."""
    kinds = {type(v): k for k, v in SPARK_TYPES.items()} | {T.LongType: "INT64", T.StringType: "STRING", T.BinaryType: "BLOB"}
    return [Field(f.name, f.metadata.get("type") or kinds.get(type(f.dataType), "STRING"), f.metadata.get("alias"), f.nullable) for f in rows.schema.fields]


def projected_fields(columns: list[str], shape_field: str | None, wanted: list[str] | None = None) -> list[str]:
    """Columns of a feature: neither the shape and its computed parts (names with brackets) nor the state."""
    chosen = wanted or columns
    return [c for c in chosen if c.lower() != (shape_field or "").lower() and "(" not in c and ")" not in c and c.lower() != "sde_state_id"]


def to_feature(row, shape_field: str | None) -> dict:
    """A row as id, attributes and geometry; columns whose names begin with that of the shape field are its parts and left out of the attributes."""
    values = row.asDict()
    key = next((k for k in values if k.lower() == "objectid"), None)
    prefix = (shape_field or "\0").lower()
    attributes = {k: v for k, v in values.items() if not k.lower().startswith(prefix)}
    geometry = next((v for k, v in values.items() if k.lower() == prefix), None)
    return {"id": values.get(key) if key else None, "attributes": attributes, "geometry": geometry}


def list_tables(items: DataFrame, item_types: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, physical_name, schema_name, geometry_type, registration_id, is_versioned) of the tables and feature classes, by name.

    items(Type, Name, PhysicalName, DatasetSubtype1), item_types(UUID, Name), registry(registration_id, owner, table_name, object_flags). A table's name is
    the last part of its physical name. The registry is joined on owner.table against the physical name after its first dot.
    """
    kinds = item_types.filter(F.col("Name").isin("Table", "Feature Class")).select(F.col("UUID").alias("Type"), F.col("Name").alias("kind"))
    physical = F.upper("PhysicalName")
    rest = F.expr("substring(upper(PhysicalName), instr(PhysicalName, '.') + 1)")
    registered = registry.select("registration_id", F.upper(F.concat_ws(".", "owner", "table_name")).alias("registered"), "object_flags")
    codes = F.create_map(*[F.lit(x) for pair in GEOMETRY_CODES.items() for x in pair])
    joined = items.join(kinds, "Type").withColumn("rest", F.coalesce(rest, physical)).join(registered, F.col("rest") == F.col("registered"), "left")
    return joined.select(
        F.element_at(F.split("PhysicalName", r"\."), -1).alias("name"),
        F.col("PhysicalName").alias("physical_name"),
        F.when(F.instr("PhysicalName", ".") > 0, F.element_at(F.split("PhysicalName", r"\."), -2)).otherwise(F.lit("dbo")).alias("schema_name"),
        F.when(F.col("kind") == "Feature Class", F.try_element_at(codes, F.col("DatasetSubtype1"))).alias("geometry_type"),
        "registration_id",
        (F.coalesce(F.col("object_flags"), F.lit(0)).bitwiseAND(VERSIONED_FLAG) > 0).alias("is_versioned"),
    ).orderBy("name")


def list_versions(versions: DataFrame, server_time_zone: str | None = None) -> DataFrame:
    """The versions by name; times of a server's zone become UTC."""
    if server_time_zone and "creation_time" in versions.columns:
        versions = versions.withColumn("creation_time", F.to_utc_timestamp("creation_time", server_time_zone))
    return versions.orderBy("name")


def with_live(definition: Definition, rows: DataFrame, shape_field: str | None, versioned: bool, view: bool) -> Definition:
    """A view's fields are those it has, a versioned table's those of the document, any other's both."""
    if versioned and not view:
        return definition
    return replace(definition, fields=tuple(merge_fields([] if view else list(definition.fields), live_fields(rows), shape_field)))
