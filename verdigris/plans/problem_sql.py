"""SQL twins of the general problems' queries, for DuckDB over the same tables."""

from __future__ import annotations

_TREE = """
links AS (SELECT state_id AS node, min(parent_state_id) AS parent FROM sde_states WHERE state_id IS NOT NULL GROUP BY state_id)
"""

_ORPHANS = """
WITH latest AS (
  SELECT state_id, removed_at FROM sde_states
  QUALIFY row_number() OVER (PARTITION BY state_id ORDER BY loaded_at DESC NULLS LAST, removed_at IS NOT NULL DESC) = 1),
refs AS (
  SELECT 'sde_state_locks' AS ref_table, CAST(sde_id AS VARCHAR) AS ref_key, state_id, lock_time AS t FROM sde_state_locks
  UNION ALL SELECT 'sde_versions', coalesce(owner, '') || '.' || coalesce(name, ''), state_id, creation_time FROM sde_versions
  UNION ALL SELECT 'sde_state_lineages', CAST(lineage_name AS VARCHAR), lineage_id, added_at FROM sde_state_lineages),
orphans AS (
  SELECT ref_table, ref_key, state_id, coalesce(strftime(t, '%Y-%m'), 'unknown') AS period FROM refs
  WHERE state_id IS NOT NULL AND state_id NOT IN (SELECT state_id FROM latest WHERE state_id IS NOT NULL AND removed_at IS NULL))
"""

_FEED = f"""
WITH RECURSIVE {_TREE},
tip AS (SELECT arg_max(state_id, (loaded_at, state_id)) AS s FROM sde_versions WHERE owner = 'sde' AND name = 'DEFAULT'),
chain AS (
  SELECT s FROM tip WHERE s IS NOT NULL AND s <> 0
  UNION SELECT up.node FROM chain JOIN links ON links.node = chain.s JOIN links up ON up.node = links.parent WHERE up.node <> 0),
newest AS (
  SELECT objectid, sde_state_id, max(edit_seq) AS edit_seq FROM a19 WHERE sde_state_id IN (SELECT s FROM chain) GROUP BY objectid, sde_state_id
  QUALIFY row_number() OVER (PARTITION BY objectid ORDER BY sde_state_id DESC) = 1),
shown AS (
  SELECT n.* FROM newest n WHERE NOT EXISTS (
    SELECT 1 FROM d19 d WHERE d.sde_deletes_row_id = n.objectid AND d.sde_state_id > n.sde_state_id AND d.sde_state_id IN (SELECT s FROM chain))),
base AS (SELECT objectid, max(edit_seq) AS edit_seq FROM a19 WHERE sde_state_id = 0 GROUP BY objectid),
base_shown AS (
  SELECT * FROM base WHERE objectid NOT IN (SELECT objectid FROM newest)
  AND objectid NOT IN (SELECT sde_deletes_row_id FROM d19 WHERE deleted_at IN (SELECT s FROM chain)))
"""

_ROWS = "sde_state_id AS key_id, count(*) AS n_rows, count(DISTINCT objectid) AS n_distinct FROM a19 WHERE sde_state_id IS NOT NULL GROUP BY sde_state_id"
_MEMBERS = "lineage_name AS key_id, count(*) AS n_rows, count(DISTINCT lineage_id) AS n_distinct FROM sde_state_lineages WHERE lineage_name IS NOT NULL GROUP BY lineage_name"

_FAULTS = f"""
WITH RECURSIVE {_TREE},
sound(node, depth) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM links WHERE node = 0
  UNION ALL SELECT l.node, s.depth + 1 FROM links l JOIN sound s ON l.parent = s.node WHERE l.node <> 0),
detached(node, ref, depth) AS (
  SELECT node, parent, CAST(1 AS BIGINT) FROM links WHERE parent IS NOT NULL AND node <> 0 AND parent NOT IN (SELECT node FROM links)
  UNION ALL SELECT l.node, d.ref, d.depth + 1 FROM links l JOIN detached d ON l.parent = d.node WHERE l.node <> 0),
knot AS (SELECT node, parent FROM links WHERE node NOT IN (SELECT node FROM sound) AND node NOT IN (SELECT node FROM detached) AND parent IS NOT NULL),
walk(start, node) AS (SELECT node, parent FROM knot UNION SELECT w.start, k.parent FROM walk w JOIN knot k ON k.node = w.node),
cycles AS (
  SELECT c.start AS node, min(w.node) AS smallest, count(*) AS length
  FROM walk c JOIN walk w ON w.start = c.start WHERE c.start = c.node GROUP BY c.start),
below(node, ref, depth) AS (
  SELECT k.node, c.smallest, CAST(1 AS BIGINT) FROM knot k JOIN cycles c ON k.parent = c.node WHERE k.node NOT IN (SELECT node FROM cycles)
  UNION ALL SELECT k.node, b.ref, b.depth + 1 FROM knot k JOIN below b ON k.parent = b.node),
tips AS (SELECT lineage_name, max(state_id) AS tip FROM sde_states WHERE lineage_name IS NOT NULL GROUP BY lineage_name),
chains(lineage_name, node) AS (
  SELECT t.lineage_name, t.tip FROM tips t JOIN sound s ON s.node = t.tip WHERE t.lineage_name IN (SELECT lineage_name FROM sde_state_lineages)
  UNION ALL SELECT c.lineage_name, l.parent FROM chains c JOIN links l ON l.node = c.node WHERE c.node <> 0)
SELECT 'cycle' AS kind, node AS node_id, smallest AS ref_id, length AS depth FROM cycles
UNION ALL SELECT 'below_cycle', node, ref, depth FROM below
UNION ALL SELECT 'detached', node, ref, depth FROM detached
UNION ALL SELECT DISTINCT 'foreign_lineage', c.lineage_name, c.lineage_id, s.depth
FROM sde_state_lineages c JOIN tips t ON t.lineage_name = c.lineage_name JOIN sound s ON s.node = c.lineage_id JOIN sound ts ON ts.node = t.tip
WHERE c.lineage_id <> 0 AND NOT EXISTS (SELECT 1 FROM chains h WHERE h.lineage_name = c.lineage_name AND h.node = c.lineage_id)
"""

_DIFFERENCES = r"""
WITH last AS (
  SELECT * FROM changed_features WHERE side IN ('origin', 'replica')
  QUALIFY row_number() OVER (PARTITION BY side, registration_id, objectid, state_id ORDER BY exported_at DESC, change_type DESC, feature DESC) = 1),
pairs AS (
  SELECT coalesce(o.registration_id, r.registration_id) AS registration_id, coalesce(o.objectid, r.objectid) AS objectid,
         coalesce(o.state_id, r.state_id) AS state_id, o.side IS NOT NULL AS has_o, r.side IS NOT NULL AS has_r,
         o.change_type AS co, r.change_type AS cr, o.feature AS fo, r.feature AS fr
  FROM (SELECT * FROM last WHERE side = 'origin') o FULL JOIN (SELECT * FROM last WHERE side = 'replica') r
  ON o.registration_id = r.registration_id AND o.objectid = r.objectid AND o.state_id = r.state_id),
cells AS (
  SELECT registration_id, objectid, state_id, s, upper(k) AS field, json_type(v) AS kind, v ->> '$' AS text
  FROM (SELECT *, json_extract(json_extract(f, '$.attributes'), '$."' || k || '"') AS v
        FROM (SELECT registration_id, objectid, state_id, s, f, unnest(json_keys(f, '$.attributes')) AS k
              FROM (SELECT registration_id, objectid, state_id, 'o' AS s, fo AS f FROM pairs WHERE fo IS NOT NULL AND fr IS NOT NULL
                    UNION ALL SELECT registration_id, objectid, state_id, 'r', fr FROM pairs WHERE fo IS NOT NULL AND fr IS NOT NULL)))
  WHERE json_type(v) <> 'NULL'),
both_sides AS (
  SELECT coalesce(a.registration_id, b.registration_id) AS registration_id, coalesce(a.objectid, b.objectid) AS objectid,
         coalesce(a.state_id, b.state_id) AS state_id, coalesce(a.field, b.field) AS field, a.kind AS ak, b.kind AS bk, a.text AS a, b.text AS b
  FROM (SELECT * FROM cells WHERE s = 'o') a FULL JOIN (SELECT * FROM cells WHERE s = 'r') b
  ON a.registration_id = b.registration_id AND a.objectid = b.objectid AND a.state_id = b.state_id AND a.field = b.field)
SELECT registration_id, objectid, state_id, CASE WHEN has_o THEN 'only_origin' ELSE 'only_replica' END AS diff_kind, '' AS field FROM pairs WHERE has_o <> has_r
UNION ALL SELECT registration_id, objectid, state_id, 'value', 'CHANGE_TYPE' FROM pairs WHERE has_o AND has_r AND lower(co) IS DISTINCT FROM lower(cr)
UNION ALL SELECT registration_id, objectid, state_id, 'value', 'FEATURE' FROM pairs WHERE has_o AND has_r AND (fo IS NULL) <> (fr IS NULL)
UNION ALL SELECT registration_id, objectid, state_id, 'value', 'GEOMETRY' FROM pairs WHERE fo IS NOT NULL AND fr IS NOT NULL AND (
  lower(fo ->> '$.geometry.type') IS DISTINCT FROM lower(fr ->> '$.geometry.type')
  OR coalesce(abs(CAST(fo ->> '$.geometry.coordinates[0]' AS DOUBLE) - CAST(fr ->> '$.geometry.coordinates[0]' AS DOUBLE)) > 1e-9, false)
  OR coalesce(abs(CAST(fo ->> '$.geometry.coordinates[1]' AS DOUBLE) - CAST(fr ->> '$.geometry.coordinates[1]' AS DOUBLE)) > 1e-9, false))
UNION ALL SELECT registration_id, objectid, state_id, 'value', field FROM both_sides WHERE a IS NULL OR b IS NULL OR CASE
  WHEN ak <> 'VARCHAR' AND bk <> 'VARCHAR' THEN abs(CAST(a AS DOUBLE) - CAST(b AS DOUBLE)) > 1e-9
  WHEN ak <> bk THEN true
  WHEN field = 'EDITED_ON' THEN CAST(a AS TIMESTAMPTZ) <> CAST(b AS TIMESTAMPTZ)
  ELSE a <> b END
"""

_PATHS = f"""{_FAULTS.rsplit("tips AS (", 1)[0]}
tree(node, kind, root_id, depth, path) AS (
  SELECT node, 'root', node, CAST(0 AS BIGINT), [node] FROM links WHERE node = 0 OR parent IS NULL
  UNION ALL SELECT node, 'detached', parent, CAST(1 AS BIGINT), [node] FROM links WHERE parent IS NOT NULL AND node <> 0 AND parent NOT IN (SELECT node FROM links)
  UNION ALL SELECT node, 'below', smallest, CAST(0 AS BIGINT), [node] FROM cycles
  UNION ALL SELECT l.node, t.kind, t.root_id, t.depth + 1, list_append(t.path, l.node) FROM links l JOIN tree t ON l.parent = t.node WHERE l.node <> 0 AND l.node NOT IN (SELECT node FROM cycles)),
around(start, here, path) AS (
  SELECT node, node, [node] FROM cycles
  UNION ALL SELECT a.start, l.parent, list_prepend(l.parent, a.path) FROM around a JOIN links l ON l.node = a.here WHERE l.parent <> a.start)"""

SQL = {
    "p2_found": f"{_ORPHANS} SELECT DISTINCT ref_table, ref_key, state_id, period FROM orphans",
    "p2_counts": f"{_ORPHANS} SELECT ref_table, period, count(*) AS n_rows, count(DISTINCT state_id) AS n_states FROM orphans GROUP BY ref_table, period",
    "p3_found": f"""{_FEED}
SELECT s.objectid, CASE WHEN b.objectid IS NULL THEN 'insert' ELSE 'update' END AS outcome, s.edit_seq FROM shown s LEFT JOIN base b ON b.objectid = s.objectid
UNION ALL SELECT objectid, 'delete', CAST(0 AS BIGINT) FROM base
WHERE objectid NOT IN (SELECT objectid FROM shown) AND objectid NOT IN (SELECT objectid FROM base_shown)""",
    "p3_rows": f"""{_FEED}
SELECT r.objectid, r.sde_state_id, r.edit_seq, r.val, r.parcel_class, r.area_m2
FROM (SELECT objectid, sde_state_id, edit_seq FROM shown UNION ALL SELECT objectid, CAST(0 AS BIGINT), edit_seq FROM base_shown) s
JOIN (SELECT * FROM a19 QUALIFY row_number() OVER (PARTITION BY objectid, sde_state_id, edit_seq ORDER BY val DESC NULLS LAST, parcel_class DESC NULLS LAST, area_m2 DESC NULLS LAST) = 1) r
  ON r.objectid = s.objectid AND r.sde_state_id = s.sde_state_id AND r.edit_seq = s.edit_seq""",
    "p5_hierarchy": f"""{_PATHS},
below_of AS (SELECT a AS node, count(*) AS n FROM (SELECT unnest(path[:-2]) AS a FROM tree) GROUP BY a),
tied AS (SELECT root_id, count(*) AS n FROM tree WHERE kind = 'below' GROUP BY root_id)
SELECT t.node AS node_id, t.kind, t.root_id, t.depth, coalesce(b.n, 0) AS n_descendants, array_to_string(t.path, '/') AS path
FROM tree t LEFT JOIN below_of b ON b.node = t.node WHERE t.node NOT IN (SELECT node FROM cycles)
UNION ALL SELECT c.node, 'cycle', c.smallest, c.length, d.n - 1, array_to_string(a.path, '/')
FROM cycles c JOIN tied d ON d.root_id = c.smallest JOIN (SELECT start, arg_max(path, len(path)) AS path FROM around GROUP BY start) a ON a.start = c.node""",

    "p4_found": f"""
SELECT 'a19' AS src_table, * FROM (SELECT {_ROWS}) WHERE n_rows * 200 >= (SELECT count(*) FROM a19)
UNION ALL SELECT 'sde_state_lineages', * FROM (SELECT {_MEMBERS}) WHERE n_rows * 200 >= (SELECT count(*) FROM sde_state_lineages)""",
    "p4_counts": f"SELECT 'a19' AS src_table, {_ROWS} UNION ALL SELECT 'sde_state_lineages', {_MEMBERS}",
    "p5_found": _FAULTS,
    "p5_descendants": f"""{_PATHS}
SELECT a AS node_id, node AS descendant_id FROM (SELECT unnest(path[:-2]) AS a, node FROM tree WHERE node NOT IN (SELECT node FROM cycles)) WHERE a NOT IN (SELECT node FROM cycles)
UNION ALL SELECT c.node, t.node FROM cycles c JOIN tree t ON t.kind = 'below' AND t.root_id = c.smallest WHERE t.node <> c.node""",
    "p6_found": _DIFFERENCES,
}
