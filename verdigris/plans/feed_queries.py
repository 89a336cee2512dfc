"""Queries of the versioned store over the delivered tables themselves: dirty, repeated, and with as many states as there are.

The copies of a key count once, the one delivered last. All sets of states are found by the forests of blocks, whatever the number of states.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import changes, compaction, versioned
from verdigris.operators.fabric import ROOT, Fabric, FeatureTable
from verdigris.operators.spreadtree import SpreadTree
from verdigris.session import cut_lineage, table
from verdigris.sources.store import without_stale_locks

TABLE = "a19"
_PAYLOAD = ("edit_seq", "val", "parcel_class", "area_m2")


def load_feed(spark: SparkSession, sf_dir: str) -> Fabric:
    """Table 19 with its states, versions, closure and locks. Of several deliveries of an add the largest edit_seq counts; a null edit_seq counts as 0."""
    names = ("sde_states", "sde_state_lineages", "sde_versions", "sde_state_locks", "a19", "d19")
    states, lineages, versions, locks, adds, deletes = (table(spark, sf_dir, n) for n in names)
    states = states.filter("state_id is not null").groupBy("state_id").agg(F.min("parent_state_id").alias("parent_state_id"), F.max("lineage_name").alias("lineage_name"))
    last = F.max_by("state_id", F.struct("loaded_at", "state_id")).alias("state_id")
    versions = versions.groupBy("owner", "name").agg(last, F.max_by("parent_name", F.struct("loaded_at", "state_id")).alias("parent_name"))
    row = F.max(F.struct(F.coalesce("edit_seq", F.lit(0)).alias("edit_seq"), *_PAYLOAD[1:])).alias("row")
    adds = adds.filter("objectid is not null and sde_state_id is not null").groupBy("objectid", "sde_state_id").agg(row).select("objectid", "sde_state_id", *[f"row.{c}" for c in _PAYLOAD])
    deletes = deletes.select("sde_deletes_row_id", "sde_state_id", "deleted_at").filter("sde_deletes_row_id is not null").distinct()
    features = FeatureTable(TABLE, adds.filter(F.col("sde_state_id") == ROOT).drop("sde_state_id"), adds.filter(F.col("sde_state_id") != ROOT), deletes, 19)
    members = lineages.select("lineage_name", "lineage_id").filter("lineage_name is not null and lineage_id is not null").distinct()
    return Fabric(states, members, versions, locks.groupBy("sde_id", "state_id").agg(F.max("lock_time").alias("lock_time")), {TABLE: features})


def _tips(fabric: Fabric) -> DataFrame:
    return fabric.versions.filter("state_id is not null").select(F.col("state_id").alias("state")).distinct()


def _locked(fabric: Fabric) -> DataFrame:
    return fabric.locks.filter("state_id is not null").select(F.col("state_id").alias("state")).distinct()


def _tree(fabric: Fabric) -> SpreadTree:
    return SpreadTree(fabric.states)


def _default(fabric: Fabric) -> DataFrame:
    return _tree(fabric).walk(fabric.tip("sde.DEFAULT"))


def _gone(fabric: Fabric) -> DataFrame:
    tree = _tree(fabric)
    return cut_lineage(tree.unreachable(_tips(fabric)).join(tree.branches(_locked(fabric)), "state", "left_anti"))


def _prefix(fabric: Fabric) -> DataFrame:
    """Of the versions whose tip reaches the root, beside it."""
    tree = _tree(fabric)
    return tree.prefix(cut_lineage(tree.rooted.select(F.col("node").alias("state")).join(_tips(fabric), "state", "left_semi")))


def _collapse(fabric: Fabric) -> DataFrame:
    """With the locks of every fortieth session; the other sessions are gone, so that their locks are stale."""
    live = fabric.locks.filter(F.col("sde_id") % 40 == 0).select("sde_id").distinct()
    fabric, tree = without_stale_locks(fabric, live, datetime(2100, 1, 1)), _tree(fabric)
    return tree.collapse_pairs(_tips(fabric), cut_lineage(tree.branches(_locked(fabric))))


_PLANS = {
    "feed_versioned_read": lambda f: versioned.read_states(f.tables[TABLE], _default(f)),
    "feed_closure_read": lambda f: versioned.read_closure(f, TABLE, "sde.DEFAULT"),
    "feed_changes": lambda f: changes.table_changes(f.tables[TABLE], _default(f)),
    "feed_walk": lambda f: _default(f).withColumnRenamed("state", "state_id"),
    "feed_preconditions": lambda f: compaction.preconditions(f.states, f.lineages, f.versions),
    "feed_missing_self_rows": lambda f: compaction.missing_self_rows(f.states, f.lineages),
    "feed_unreachable_states": lambda f: _tree(f).unreachable(_tips(f)).withColumnRenamed("state", "state_id"),
    "feed_locked_branches": lambda f: _tree(f).branches(_locked(f)).withColumnRenamed("state", "state_id"),
    "feed_prune_adds": lambda f: compaction.prune(f, _gone(f)).tables[TABLE].adds,
    "feed_prune_lineages": lambda f: compaction.prune(f, _gone(f)).lineages,
    "feed_graduable_prefix": lambda f: _prefix(f).withColumnRenamed("state", "state_id"),
    "feed_graduate_base": lambda f: compaction.graduate_table(f.tables[TABLE], _prefix(f)).table.base,
    "feed_collapse_plan": _collapse,
    "feed_closure_census": lambda f: _tree(f).census(f.states, f.lineages, f.versions),
}


def _query(plan):
    return lambda spark, sf_dir: plan(load_feed(spark, sf_dir))


QUERIES = {name: _query(plan) for name, plan in _PLANS.items()}

_COLUMNS = "objectid, edit_seq, val, parcel_class, area_m2"
_LOADED = f"""st AS (SELECT state_id, min(parent_state_id) AS parent_state_id, max(lineage_name) AS lineage_name FROM sde_states WHERE state_id IS NOT NULL GROUP BY state_id),
links AS (SELECT state_id AS node, parent_state_id AS parent FROM st),
ver AS (SELECT owner, name, arg_max(state_id, (loaded_at, state_id)) AS state_id FROM sde_versions GROUP BY owner, name),
lin AS (SELECT DISTINCT lineage_name, lineage_id FROM sde_state_lineages WHERE lineage_name IS NOT NULL AND lineage_id IS NOT NULL),
rows AS (SELECT objectid, sde_state_id, coalesce(edit_seq, 0) AS edit_seq, val, parcel_class, area_m2 FROM a19 WHERE objectid IS NOT NULL AND sde_state_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY objectid, sde_state_id ORDER BY coalesce(edit_seq, 0) DESC, val DESC NULLS LAST, parcel_class DESC NULLS LAST, area_m2 DESC NULLS LAST) = 1),
base AS (SELECT * FROM rows WHERE sde_state_id = 0),
adds AS (SELECT * FROM rows WHERE sde_state_id <> 0),
del AS (SELECT DISTINCT sde_deletes_row_id, sde_state_id, deleted_at FROM d19 WHERE sde_deletes_row_id IS NOT NULL),
tips AS (SELECT DISTINCT state_id AS s FROM ver WHERE state_id IS NOT NULL)"""
_DEFAULT = """chain AS (SELECT l.node AS s, l.parent AS p FROM links l JOIN ver v ON v.state_id = l.node WHERE v.owner = 'sde' AND v.name = 'DEFAULT' AND l.node <> 0
  UNION SELECT l.node, l.parent FROM chain c JOIN links l ON l.node = c.p WHERE c.p <> 0)"""
_SOUND = """sound(node, depth) AS (SELECT node, CAST(0 AS BIGINT) FROM links WHERE node = 0
  UNION ALL SELECT l.node, s.depth + 1 FROM links l JOIN sound s ON l.parent = s.node WHERE l.node <> 0)"""
_REACH = """reach AS (SELECT l.node AS s, l.parent AS p FROM links l JOIN tips t ON t.s = l.node WHERE l.node <> 0
  UNION SELECT l.node, l.parent FROM reach r JOIN links l ON l.node = r.p WHERE r.p <> 0)"""
_BRANCHES = """held AS (SELECT DISTINCT l.node, l.parent FROM links l JOIN sde_state_locks k ON k.state_id = l.node),
up AS (SELECT node AS s, parent AS p FROM held WHERE node <> 0 UNION SELECT l.node, l.parent FROM up u JOIN links l ON l.node = u.p WHERE u.p <> 0),
down AS (SELECT node AS s FROM held UNION SELECT l.node FROM down d JOIN links l ON l.parent = d.s WHERE l.node <> 0),
locked AS (SELECT s FROM up UNION SELECT s FROM down WHERE s <> 0)"""
_GONE = "gone AS (SELECT node AS s FROM links WHERE node <> 0 AND node NOT IN (SELECT s FROM reach) AND node NOT IN (SELECT s FROM locked))"
_PREFIX = """good AS (SELECT t.s FROM tips t JOIN sound n ON n.node = t.s WHERE t.s <> 0),
walks(tip, s, p) AS (SELECT g.s, l.node, l.parent FROM good g JOIN links l ON l.node = g.s
  UNION ALL SELECT w.tip, l.node, l.parent FROM walks w JOIN links l ON l.node = w.p WHERE w.p <> 0),
prefix AS (SELECT s FROM walks GROUP BY s HAVING count(DISTINCT tip) = (SELECT count(*) FROM good))"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join((_LOADED, *parts))


def _winners(states: str) -> str:
    return f"""SELECT {_COLUMNS} FROM (SELECT * FROM adds WHERE sde_state_id IN {states} QUALIFY row_number() OVER (PARTITION BY objectid ORDER BY sde_state_id DESC) = 1) a
WHERE NOT EXISTS (SELECT 1 FROM del d WHERE d.sde_deletes_row_id = a.objectid AND d.sde_state_id IN {states} AND d.sde_state_id > a.sde_state_id)"""


def _seen(states: str, markers: str = "true") -> str:
    return f"""SELECT {_COLUMNS} FROM base b WHERE objectid NOT IN (SELECT objectid FROM adds WHERE sde_state_id IN {states})
  AND objectid NOT IN (SELECT sde_deletes_row_id FROM del WHERE deleted_at IN {states} AND {markers}) UNION ALL {_winners(states)}"""


_CHAIN, _MEMBERS = "(SELECT s FROM chain)", "(SELECT s FROM members)"
SQL = {
    "feed_versioned_read": f"{_with(_DEFAULT)} {_seen(_CHAIN)}",
    "feed_closure_read": f"""{_with("tip AS (SELECT v.state_id AS s, st.lineage_name AS l FROM ver v JOIN st ON st.state_id = v.state_id WHERE owner = 'sde' AND name = 'DEFAULT')",
        "members AS (SELECT lineage_id AS s FROM lin JOIN tip ON l = lineage_name WHERE lineage_id <= s AND lineage_id <> 0)")} {_seen(_MEMBERS, "sde_state_id = 0")}""",
    "feed_changes": f"""{_with(_DEFAULT)} SELECT 'a19' AS table_name, coalesce(a.o, d.o) AS objectid, coalesce(a.s, d.s) AS state_id,
  CASE WHEN d.o IS NULL THEN 'insert' WHEN a.o IS NULL THEN 'delete' ELSE 'update' END AS change_type
FROM (SELECT objectid AS o, max(sde_state_id) AS s FROM adds WHERE sde_state_id IN {_CHAIN} GROUP BY 1)
  a FULL JOIN (SELECT sde_deletes_row_id AS o, max(sde_state_id) AS s FROM del WHERE sde_state_id IN {_CHAIN} GROUP BY 1) d ON a.o = d.o""",
    "feed_walk": f"{_with(_DEFAULT)} SELECT s AS state_id FROM chain",
    "feed_preconditions": f"""{_with()} SELECT * FROM (
  SELECT 'missing_root_state' AS violation, CAST(count(*) = 0 AS BIGINT) AS n FROM st WHERE state_id = 0
  UNION ALL SELECT 'missing_root_lineage', CAST(count(*) = 0 AS BIGINT) FROM lin WHERE lineage_name = 0 AND lineage_id = 0
  UNION ALL SELECT 'dangling_parent', count(*) FROM st WHERE parent_state_id <> 0 AND parent_state_id NOT IN (SELECT state_id FROM st)
  UNION ALL SELECT 'parent_not_before_child', count(*) FROM st WHERE parent_state_id <> 0 AND parent_state_id >= state_id
  UNION ALL SELECT 'repeated_parent_lineage', count(*) FROM (SELECT 1 FROM st GROUP BY parent_state_id, lineage_name HAVING count(*) > 1)
  UNION ALL SELECT 'dangling_tip', count(*) FROM ver WHERE state_id IS NOT NULL AND state_id NOT IN (SELECT state_id FROM st)) WHERE n > 0""",
    "feed_missing_self_rows": f"{_with()} SELECT state_id FROM st WHERE NOT EXISTS (SELECT 1 FROM lin WHERE lin.lineage_name = st.lineage_name AND lin.lineage_id = st.state_id)",
    "feed_unreachable_states": f"{_with(_REACH)} SELECT node AS state_id FROM links WHERE node <> 0 AND node NOT IN (SELECT s FROM reach)",
    "feed_locked_branches": f"{_with(_BRANCHES)} SELECT s AS state_id FROM locked",
    "feed_prune_adds": f"{_with(_REACH, _BRANCHES, _GONE)} SELECT * FROM adds WHERE sde_state_id NOT IN (SELECT s FROM gone)",
    "feed_prune_lineages": f"{_with(_REACH, _BRANCHES, _GONE)} SELECT * FROM lin WHERE lineage_id NOT IN (SELECT s FROM gone)",
    "feed_graduable_prefix": f"{_with(_SOUND, _PREFIX)} SELECT s AS state_id FROM prefix",
    "feed_graduate_base": f"""{_with(_SOUND, _PREFIX, f"won AS ({_winners('(SELECT s FROM prefix)')})")}
SELECT {_COLUMNS} FROM base WHERE objectid NOT IN (SELECT objectid FROM won) AND objectid NOT IN (
  SELECT sde_deletes_row_id FROM del WHERE sde_state_id IN (SELECT s FROM prefix) OR deleted_at IN (SELECT s FROM prefix)) UNION ALL SELECT * FROM won""",
    "feed_collapse_plan": f"""{_with(_SOUND, _BRANCHES.replace("k.state_id = l.node)", "k.state_id = l.node AND k.sde_id % 40 = 0)"), """fixed AS (SELECT 0 AS s UNION SELECT s FROM tips UNION SELECT s FROM locked
  UNION SELECT parent FROM links WHERE node <> 0 GROUP BY parent HAVING count(*) >= 2),
goes AS (SELECT l.node AS s, l.parent AS p FROM links l JOIN sound USING (node) WHERE l.node NOT IN (SELECT s FROM fixed) AND l.parent NOT IN (SELECT s FROM fixed)),
climb(s, above) AS (SELECT s, p FROM goes UNION ALL SELECT c.s, g.p FROM climb c JOIN goes g ON g.s = c.above)""")}
SELECT s AS state, above AS anchor FROM climb WHERE above NOT IN (SELECT s FROM goes)""",
    "feed_closure_census": f"""{_with(_SOUND, """held AS (SELECT v.owner, v.name, v.state_id AS tip, st.lineage_name FROM ver v JOIN st ON st.state_id = v.state_id JOIN sound n ON n.node = v.state_id WHERE v.state_id <> 0),
walks(owner, name, s, p) AS (SELECT h.owner, h.name, l.node, l.parent FROM held h JOIN links l ON l.node = h.tip
  UNION ALL SELECT w.owner, w.name, l.node, l.parent FROM walks w JOIN links l ON l.node = w.p WHERE w.p <> 0),
kept AS (SELECT h.owner, h.name, l.lineage_id AS s FROM held h JOIN lin l ON l.lineage_name = h.lineage_name WHERE l.lineage_id <= h.tip AND l.lineage_id <> 0)""")}
SELECT coalesce(w.owner, k.owner) AS owner, coalesce(w.name, k.name) AS name, count(*) FILTER (w.s IS NULL) AS n_over, count(*) FILTER (k.s IS NULL) AS n_under
FROM walks w FULL JOIN kept k ON w.owner = k.owner AND w.name = k.name AND w.s = k.s GROUP BY 1, 2""",
}
