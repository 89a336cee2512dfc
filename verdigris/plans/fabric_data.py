"""A small versioned fabric derived from the driver's tables, by SQL text that both engines run."""

from __future__ import annotations

from pyspark.sql import SparkSession

from verdigris.operators.fabric import Fabric, FeatureTable
from verdigris.session import table

_EDITED = "CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 10000000 ELSE o_custkey END"

#: Each block may use the ones before it and the driver's tables.
BLOCKS = {
    "fab_states": """
SELECT CAST(n_nationkey + 1 AS BIGINT) AS state_id,
       CAST(CASE n_nationkey + 1 WHEN 1 THEN 0 WHEN 11 THEN 6 WHEN 16 THEN 8 WHEN 21 THEN 4 WHEN 24 THEN 0 ELSE n_nationkey END AS BIGINT) AS parent_state_id,
       CAST(CASE WHEN n_nationkey + 1 <= 10 THEN 1 WHEN n_nationkey + 1 <= 15 THEN 11 WHEN n_nationkey + 1 <= 20 THEN 16
            WHEN n_nationkey + 1 <= 23 THEN 21 ELSE 24 END AS BIGINT) AS lineage_name
FROM {nation}
UNION ALL SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)""",
    "fab_versions": """
SELECT CASE r_regionkey WHEN 0 THEN 'sde' WHEN 4 THEN 'sde' ELSE 'editor' END AS owner,
       CASE r_regionkey WHEN 0 THEN 'DEFAULT' WHEN 1 THEN 'V_A' WHEN 2 THEN 'V_B' WHEN 3 THEN 'V_ORPHAN' ELSE 'V_SHARED' END AS name,
       CASE r_regionkey WHEN 0 THEN NULL ELSE 'sde.DEFAULT' END AS parent_name,
       CAST(CASE r_regionkey WHEN 1 THEN 15 WHEN 2 THEN 20 WHEN 3 THEN 25 ELSE 10 END AS BIGINT) AS state_id
FROM {region}""",
    "fab_locks": "SELECT CAST(100 + r_regionkey AS INT) AS sde_id, CAST(22 AS BIGINT) AS state_id FROM {region} WHERE r_regionkey = 3",
    "fab_lineages": """
SELECT lineage_name, state_id AS lineage_id FROM {fab_states}
UNION SELECT CAST(1 AS BIGINT), state_id FROM {fab_states} WHERE state_id = 0
UNION SELECT CAST(11 AS BIGINT), state_id FROM {fab_states} WHERE state_id <= 6 OR state_id = 8
UNION SELECT CAST(16 AS BIGINT), state_id FROM {fab_states} WHERE state_id <= 8 AND state_id <> 3
UNION SELECT CAST(21 AS BIGINT), state_id FROM {fab_states} WHERE state_id <= 4
UNION SELECT CAST(24 AS BIGINT), state_id FROM {fab_states} WHERE state_id = 0""",
    "fab_base": "SELECT c_custkey AS objectid, c_name, c_nationkey, c_mktsegment, c_acctbal FROM {customer}",
    "fab_edits": f"""
SELECT o_orderkey, objectid, sde_state_id, is_insert, o_orderpriority, o_totalprice FROM (
  SELECT o_orderkey, o_orderpriority, o_totalprice, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS is_insert,
         {_EDITED} AS objectid, CAST(1 + o_orderkey % 25 AS BIGINT) AS sde_state_id,
         ROW_NUMBER() OVER (PARTITION BY {_EDITED}, o_orderkey % 25 ORDER BY o_orderkey) AS rn
  FROM {{orders}} WHERE o_orderkey % 3 = 0) t
WHERE rn = 1""",
    "fab_a": """
SELECT e.objectid, e.sde_state_id,
       CASE WHEN e.is_insert = 1 THEN concat('new#', CAST(e.o_orderkey AS VARCHAR(20))) ELSE c.c_name END AS c_name,
       c.c_nationkey AS c_nationkey,
       CASE WHEN e.is_insert = 1 OR e.o_orderkey % 4 <> 0 THEN e.o_orderpriority ELSE c.c_mktsegment END AS c_mktsegment,
       CASE WHEN e.is_insert = 1 OR e.o_orderkey % 4 <> 1 THEN e.o_totalprice ELSE c.c_acctbal END AS c_acctbal
FROM {fab_edits} e JOIN {customer} c ON c.c_custkey = e.objectid % 10000000""",
    "fab_d": """
SELECT objectid AS sde_deletes_row_id, sde_state_id, sde_state_id AS deleted_at FROM {fab_edits} WHERE is_insert = 0
UNION
SELECT CAST(1 + user_id % (SELECT COUNT(*) FROM {customer}) AS BIGINT),
       CAST(CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 + event_id % 25 END AS BIGINT), CAST(1 + event_id % 25 AS BIGINT)
FROM {events} WHERE event_id % 13 = 0""",
}
_DRIVER_TABLES = ("nation", "region", "customer", "orders", "events")
TABLE = "customers"


def load_fabric(spark: SparkSession, sf_dir: str) -> Fabric:
    frames = {t: table(spark, sf_dir, t) for t in _DRIVER_TABLES}
    for name, text in BLOCKS.items():
        used = {k: v for k, v in frames.items() if f"{{{k}}}" in text}
        frames[name] = spark.sql(text, **used)
    features = FeatureTable(TABLE, frames["fab_base"], frames["fab_a"], frames["fab_d"], 18)
    return Fabric(frames["fab_states"], frames["fab_lineages"], frames["fab_versions"], frames["fab_locks"], {TABLE: features})


def as_ctes() -> str:
    """The blocks as common table expressions, without the word WITH."""

    class Names(dict):
        def __missing__(self, key):
            return key

    return ",\n".join(f"{name} AS ({text.format_map(Names())})" for name, text in BLOCKS.items())
