"""SQL twins of the fabric queries, for DuckDB, written from the rules and independently of the operators."""

from __future__ import annotations

from verdigris.plans.fabric_data import as_ctes

_TIPS = {"DEFAULT": 10, "V_A": 15, "V_B": 20, "V_ORPHAN": 25}
_COLUMNS = "objectid, c_name, c_nationkey, c_mktsegment, c_acctbal"


def _walk(name: str, tip: int | str) -> str:
    """A recursive expression `name` (s, p) of the tip and its ancestors without 0."""
    return f"""{name} AS (SELECT state_id AS s, parent_state_id AS p FROM fab_states WHERE state_id = {tip} AND state_id <> 0
  UNION ALL SELECT st.state_id, st.parent_state_id FROM fab_states st JOIN {name} ON st.state_id = {name}.p WHERE {name}.p <> 0)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + as_ctes() + "".join(",\n" + p for p in parts)


def _in(name: str) -> str:
    return f"(SELECT s FROM {name})"


def _survivors(states: str, a: str = "fab_a", d: str = "fab_d") -> str:
    return f"""SELECT a.* FROM {a} a JOIN (SELECT objectid AS moid, MAX(sde_state_id) AS ms FROM {a} WHERE sde_state_id IN {states} GROUP BY objectid) m
  ON m.moid = a.objectid AND m.ms = a.sde_state_id
WHERE NOT EXISTS (SELECT 1 FROM {d} d WHERE d.sde_deletes_row_id = a.objectid AND d.sde_state_id IN {states} AND d.sde_state_id > a.sde_state_id)"""


def _visible(states: str, a: str = "fab_a", d: str = "fab_d") -> str:
    return f"""SELECT {_COLUMNS} FROM fab_base b
WHERE NOT EXISTS (SELECT 1 FROM {d} d WHERE d.sde_deletes_row_id = b.objectid AND d.deleted_at IN {states})
  AND NOT EXISTS (SELECT 1 FROM {a} a WHERE a.objectid = b.objectid AND a.sde_state_id IN {states})
UNION ALL SELECT {_COLUMNS} FROM ({_survivors(states, a, d)})"""


def _read(version: str, rest: str = "SELECT * FROM seen") -> str:
    return f"{_with(_walk('anc', _TIPS[version]), f'seen AS ({_visible(_in("anc"))})')} {rest}"


_OURS, _THEIRS = "(11, 12, 13, 14, 15)", "(7, 8, 9, 10)"


def _changes(states: str) -> str:
    return f"""SELECT 'customers' AS table_name, coalesce(a.oid, d.oid) AS objectid, coalesce(a.s, d.s) AS state_id,
  CASE WHEN d.oid IS NULL THEN 'insert' WHEN a.oid IS NULL THEN 'delete' ELSE 'update' END AS change_type
FROM (SELECT objectid AS oid, MAX(sde_state_id) AS s FROM fab_a WHERE sde_state_id IN {states} GROUP BY objectid) a
FULL JOIN (SELECT sde_deletes_row_id AS oid, MAX(sde_state_id) AS s FROM fab_d WHERE sde_state_id IN {states} GROUP BY sde_deletes_row_id) d ON a.oid = d.oid"""


_CHANGED = (f"ours AS ({_changes(_OURS)})", f"theirs AS ({_changes(_THEIRS)})")
_CLASH = """clash AS (SELECT o.table_name, o.objectid, o.change_type AS child_change, o.state_id AS child_state, t.change_type AS parent_change, t.state_id AS parent_state
  FROM ours o JOIN theirs t ON o.objectid = t.objectid)"""
_IMAGES = """images AS (SELECT k.objectid, c.c_name AS cn, p.c_name AS pn, b.c_name AS bn, c.c_mktsegment AS cs, p.c_mktsegment AS ps, b.c_mktsegment AS bs,
    c.c_acctbal AS cb, p.c_acctbal AS pb, b.c_acctbal AS bb, c.c_nationkey AS ck, p.c_nationkey AS pk, b.c_nationkey AS bk
  FROM clash k JOIN fab_a c ON c.objectid = k.objectid AND c.sde_state_id = k.child_state
  JOIN fab_a p ON p.objectid = k.objectid AND p.sde_state_id = k.parent_state JOIN fab_base b ON b.objectid = k.objectid
  WHERE k.child_change = 'update' AND k.parent_change = 'update')"""


def _field(name: str, c: str, p: str, b: str, money: bool = False) -> str:
    def text(v: str) -> str:
        return f"CAST(CAST(round(CAST({v} AS DOUBLE), 2) AS DECIMAL(18, 2)) AS VARCHAR)" if money else v

    return f"""SELECT objectid, '{name}' AS field, {text(c)} AS child_value, {text(p)} AS parent_value, {text(b)} AS base_value FROM images
WHERE {c} IS DISTINCT FROM {b} AND {p} IS DISTINCT FROM {b} AND {c} IS DISTINCT FROM {p}"""


_FIELDS = " UNION ALL ".join((_field("c_name", "cn", "pn", "bn"), _field("c_mktsegment", "cs", "ps", "bs"), _field("c_acctbal", "cb", "pb", "bb", True), _field("c_nationkey", "ck", "pk", "bk", True)))


def _merged(c: str, p: str, b: str, name: str) -> str:
    return f"CASE WHEN {p} IS DISTINCT FROM {b} AND {c} IS NOT DISTINCT FROM {b} THEN {p} ELSE {c} END AS {name}"


_FOUR = (("cn", "pn", "bn", "c_name"), ("ck", "pk", "bk", "c_nationkey"), ("cs", "ps", "bs", "c_mktsegment"), ("cb", "pb", "bb", "c_acctbal"))
_NO_CLASH = " AND ".join(f"NOT ({c} IS DISTINCT FROM {b} AND {p} IS DISTINCT FROM {b} AND {c} IS DISTINCT FROM {p})" for c, p, b, _ in _FOUR)
_PARENT_ONLY = " OR ".join(f"({p} IS DISTINCT FROM {b} AND {c} IS NOT DISTINCT FROM {b})" for c, p, b, _ in _FOUR)

_KNOWN_TIPS = "tips AS (SELECT DISTINCT state_id AS s FROM fab_versions WHERE name <> 'V_ORPHAN')"
_PREFIX = "(1, 2, 3, 4, 5, 6)"
_GONE = "(24, 25)"
_LOCKED = "(1, 2, 3, 4, 21, 22, 23)"


def _graduated() -> str:
    return f"""won AS ({_survivors(_PREFIX)}),
gone AS (SELECT DISTINCT sde_deletes_row_id AS oid FROM fab_d WHERE (sde_state_id IN {_PREFIX} OR deleted_at IN {_PREFIX}) AND sde_deletes_row_id NOT IN (SELECT objectid FROM won))"""


_SURVIVAL = """kids AS (SELECT parent_state_id AS p, count(*) AS c FROM fab_states WHERE state_id <> 0 GROUP BY parent_state_id),
fixed AS (SELECT 0 AS s UNION SELECT state_id FROM fab_versions UNION SELECT unnest([1, 2, 3, 4, 21, 22, 23]) UNION SELECT p FROM kids WHERE c >= 2),
goes AS (SELECT state_id AS s, parent_state_id AS p FROM fab_states WHERE state_id NOT IN (SELECT s FROM fixed) AND parent_state_id NOT IN (SELECT s FROM fixed)),
up(child, node) AS (SELECT s, p FROM goes UNION ALL SELECT u.child, g.p FROM up u JOIN goes g ON g.s = u.node)"""
_COLLAPSE = _SURVIVAL + """,
plan AS (SELECT child, node AS anchor FROM up WHERE node NOT IN (SELECT s FROM goes)),
runs AS (SELECT child AS s, anchor FROM plan UNION SELECT anchor, anchor FROM plan),
touch AS (SELECT objectid AS oid, anchor, sde_state_id AS s FROM fab_a JOIN runs ON s = sde_state_id
  UNION ALL SELECT sde_deletes_row_id, anchor, sde_state_id FROM fab_d JOIN runs ON s = sde_state_id),
last AS (SELECT oid, anchor, MAX(s) AS s FROM touch GROUP BY oid, anchor)"""

_RECONCILED = f"""{', '.join(_CHANGED)}, {_CLASH},
taken AS (SELECT t.* FROM theirs t),
left_a AS (SELECT * FROM fab_a a WHERE NOT (a.sde_state_id = 15 AND a.objectid IN (SELECT objectid FROM clash))),
left_d AS (SELECT * FROM fab_d d WHERE NOT (d.sde_state_id = 15 AND d.sde_deletes_row_id IN (SELECT objectid FROM clash))),
todo AS (SELECT * FROM taken WHERE NOT (change_type = 'update' AND objectid IN (SELECT objectid FROM left_a WHERE sde_state_id = 15)))"""
# With favor_edit, a clash keeps the child's rows; with merging, those without a field that both sides changed take the parent's values.
_FAVORED = f"""{', '.join(_CHANGED)}, {_CLASH}, {_IMAGES},
plain AS (SELECT * FROM theirs WHERE objectid NOT IN (SELECT objectid FROM clash)),
todo AS (SELECT * FROM plain WHERE NOT (change_type = 'update' AND objectid IN (SELECT objectid FROM fab_a WHERE sde_state_id = 15)))"""
_TAKEN = """SELECT a.objectid, CAST(15 AS BIGINT) AS sde_state_id, a.c_name, a.c_nationkey, a.c_mktsegment, a.c_acctbal
FROM fab_a a JOIN todo t ON t.objectid = a.objectid AND t.state_id = a.sde_state_id WHERE t.change_type <> 'delete'"""
_NEW_STATE = 26
_POSTED = f"""ours AS ({_changes(_OURS)}),
post_a AS (SELECT * FROM fab_a UNION ALL SELECT a.objectid, CAST({_NEW_STATE} AS BIGINT), a.c_name, a.c_nationkey, a.c_mktsegment, a.c_acctbal
  FROM fab_a a JOIN ours o ON o.objectid = a.objectid AND o.state_id = a.sde_state_id WHERE o.change_type <> 'delete'),
post_d AS (SELECT * FROM fab_d UNION ALL SELECT objectid, CAST({_NEW_STATE} AS BIGINT), CAST({_NEW_STATE} AS BIGINT) FROM ours WHERE change_type = 'delete')"""

_THREE = f"""child_rows AS ({_visible(_in('child_walk'))}), old_rows AS ({_visible('(1, 2, 3, 4, 5, 6)')}), parent_rows AS ({_visible(_in('parent_walk'))}),
touched AS (SELECT objectid FROM fab_a WHERE sde_state_id IN {_OURS} UNION SELECT sde_deletes_row_id FROM fab_d WHERE sde_state_id IN {_OURS} OR deleted_at IN {_OURS}),
images AS (SELECT t.objectid, c.objectid IS NOT NULL AS c, a.objectid IS NOT NULL AS a, p.objectid IS NOT NULL AS p,
    (c.c_name, c.c_nationkey, c.c_mktsegment, c.c_acctbal) AS cr, (a.c_name, a.c_nationkey, a.c_mktsegment, a.c_acctbal) AS ar, (p.c_name, p.c_nationkey, p.c_mktsegment, p.c_acctbal) AS pr
  FROM touched t LEFT JOIN child_rows c ON c.objectid = t.objectid LEFT JOIN old_rows a ON a.objectid = t.objectid LEFT JOIN parent_rows p ON p.objectid = t.objectid),
classes AS (SELECT objectid, CASE WHEN c = a AND (NOT c OR cr = ar) THEN 'drop' WHEN p = a AND (NOT p OR pr = ar) THEN CASE WHEN c THEN 'replay' ELSE 'delete' END
  WHEN c = p AND (NOT c OR cr = pr) THEN 'drop' WHEN c THEN 'conflict_add' ELSE 'conflict_delete' END AS outcome FROM images)"""

_CLOSURE_A, _CLOSURE_B = "(1, 2, 3, 4, 5, 6, 8, 11, 12, 13, 14, 15)", "(1, 2, 4, 5, 6, 7, 8, 16, 17, 18, 19, 20)"


def _closure_read(states: str) -> str:
    return f"""{_with()} SELECT {_COLUMNS} FROM fab_base b
WHERE NOT EXISTS (SELECT 1 FROM fab_d d WHERE d.sde_deletes_row_id = b.objectid AND d.sde_state_id = 0 AND d.deleted_at IN {states})
  AND NOT EXISTS (SELECT 1 FROM fab_a a WHERE a.objectid = b.objectid AND a.sde_state_id IN {states})
UNION ALL SELECT {_COLUMNS} FROM ({_survivors(states)})"""


_ALL_WALKS = """walks(owner, name, s, p) AS (SELECT v.owner, v.name, st.state_id, st.parent_state_id FROM fab_versions v JOIN fab_states st ON st.state_id = v.state_id
  UNION ALL SELECT w.owner, w.name, st.state_id, st.parent_state_id FROM walks w JOIN fab_states st ON st.state_id = w.p WHERE w.p <> 0)"""
_AT_STATE = f"""SELECT {_COLUMNS} FROM fab_base WHERE objectid NOT IN (SELECT objectid FROM fab_a WHERE sde_state_id IN {_PREFIX})
UNION ALL SELECT {_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY objectid ORDER BY sde_state_id DESC) AS rn FROM fab_a WHERE sde_state_id IN {_PREFIX}) WHERE rn = 1"""

SQL = {
    "versioned_read_default": _read("DEFAULT"),
    "versioned_read_v_a": _read("V_A"),
    "versioned_read_v_b": _read("V_B"),
    "versioned_read_v_orphan": _read("V_ORPHAN"),
    "versioned_read_filtered": _read("V_A", "SELECT * FROM seen WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'"),
    "versioned_read_projected": _read("V_B", "SELECT objectid, c_name FROM seen"),
    "versioned_read_topk": _read("V_A", "SELECT * FROM seen ORDER BY c_acctbal DESC, objectid LIMIT 25 OFFSET 5"),
    "versioned_read_default_order": _read("V_A", "SELECT * FROM seen ORDER BY objectid LIMIT 20 OFFSET 3"),
    "base_read": f"{_with()} SELECT * FROM fab_base WHERE c_nationkey < 5",
    "base_get_features": f"{_with()} SELECT * FROM fab_base WHERE objectid IN (1, 5, 700, 1000000000)",
    "base_count": f"{_with()} SELECT count(*) AS n_rows FROM fab_base",
    "all_versions_visible_signature": _with(*[x for v, t in _TIPS.items() for x in (_walk(f"anc_{v}", t), f"seen_{v} AS ({_visible(_in(f'anc_{v}'))})")])
    + " UNION ALL ".join(
        f" SELECT v.owner, v.name, s.* FROM fab_versions v, (SELECT count(*) AS n_rows, CAST(sum(objectid) AS BIGINT) AS sum_objectid, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS sum_cents FROM seen_{v}) s WHERE v.state_id = {t}"
        for v, t in _TIPS.items()
    ),
    "closure_read_v_a": _closure_read(_CLOSURE_A),
    "closure_read_v_b": _closure_read(_CLOSURE_B),
    "rows_at_state": f"{_with()} {_AT_STATE}",
    "feature_at_state": f"{_with()} SELECT * FROM ({_AT_STATE}) WHERE objectid = 7",
    "list_versions": f"{_with()} SELECT owner, name, parent_name, state_id FROM fab_versions ORDER BY name",
    "state_walks": f"{_with(_ALL_WALKS)} SELECT owner, name, s AS state_id FROM walks",
    "common_ancestors": f"""{_with(_ALL_WALKS)} SELECT a.name AS child, b.name AS parent,
  coalesce((SELECT max(x.s) FROM walks x JOIN walks y ON x.s = y.s WHERE x.name = a.name AND y.name = b.name), 0) AS ancestor FROM fab_versions a, fab_versions b""",
    "states_in_range": f"{_with(_walk('anc', 15))} SELECT s AS state_id FROM anc WHERE s > 6",
    "external_references": f"""{_with()} SELECT DISTINCT state FROM (
  SELECT l.lineage_id AS state FROM fab_versions v JOIN fab_states s ON s.state_id = v.state_id JOIN fab_lineages l ON l.lineage_name = s.lineage_name AND l.lineage_id <= v.state_id WHERE v.name <> 'V_A'
  UNION ALL SELECT state_id FROM fab_versions WHERE name <> 'V_A' UNION ALL SELECT parent_state_id FROM fab_states WHERE state_id NOT BETWEEN 1 AND 15) WHERE state BETWEEN 1 AND 15""",
    "changes_v_a": f"{_with(*_CHANGED)} SELECT * FROM ours",
    "changes_parent": f"{_with(*_CHANGED)} SELECT * FROM theirs",
    "changes_summary": f"{_with(*_CHANGED)} SELECT change_type, count(*) AS n_changes, count(DISTINCT table_name) AS n_tables FROM ours GROUP BY change_type",
    "changed_features": f"""{_with(_walk('anc', 15), f'seen AS ({_visible(_in("anc"))})', *_CHANGED)}
SELECT o.table_name, o.objectid, o.state_id, o.change_type, s.c_name, s.c_nationkey, s.c_mktsegment, s.c_acctbal FROM ours o LEFT JOIN seen s ON s.objectid = o.objectid AND o.change_type <> 'delete'""",
    "version_stats": f"{_with(_walk('anc', 15))} SELECT 'customers' AS table_name, (SELECT count(*) FROM fab_a WHERE sde_state_id IN {_in('anc')}) AS n_adds, (SELECT count(*) FROM fab_d WHERE sde_state_id IN {_in('anc')}) AS n_deletes",
    "count_changes": f"{_with()} SELECT (SELECT count(*) FROM fab_a WHERE sde_state_id IN {_OURS}) + (SELECT count(*) FROM fab_d WHERE sde_state_id IN {_OURS}) AS n_changes",
    "conflicts_rowlevel": f"{_with(*_CHANGED, _CLASH)} SELECT * FROM clash",
    "conflicts_fieldlevel": f"{_with(*_CHANGED, _CLASH, _IMAGES)} {_FIELDS}",
    "conflict_summary": f"{_with(*_CHANGED, _CLASH)} SELECT child_change || '-' || parent_change AS conflict_type, count(*) AS n_conflicts, count(DISTINCT table_name) AS n_tables FROM clash GROUP BY 1",
    "suggested_merges": f"{_with(*_CHANGED, _CLASH, _IMAGES)} SELECT objectid, {', '.join(_merged(*f) for f in _FOUR)} FROM images WHERE {_NO_CLASH} AND ({_PARENT_ONLY})",
    "changed_objectids_except": f"""{_with()} SELECT DISTINCT objectid FROM (
  SELECT {_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY objectid ORDER BY sde_state_id DESC) AS rn FROM fab_a WHERE sde_state_id IN {_OURS}) WHERE rn = 1
  EXCEPT SELECT {_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY objectid ORDER BY sde_state_id DESC) AS rn FROM fab_a WHERE sde_state_id IN {_THEIRS}) WHERE rn = 1)""",
    "deleted_objectids": f"{_with()} SELECT DISTINCT sde_deletes_row_id AS objectid FROM fab_d WHERE sde_state_id IN {_OURS} AND sde_deletes_row_id NOT IN (SELECT objectid FROM fab_a WHERE sde_state_id IN {_OURS})",
    "objectids_with_adds": f"{_with()} SELECT DISTINCT objectid FROM fab_a WHERE sde_state_id IN {_OURS}",
    "objectids_present_in_parent": f"{_with(_walk('anc', 10))} SELECT objectid FROM fab_base UNION SELECT objectid FROM fab_a WHERE sde_state_id IN {_in('anc')}",
    "classify_rebase": f"{_with(_walk('child_walk', 15), _walk('parent_walk', 10), _THREE)} SELECT * FROM classes",
    "graduable_prefix": f"{_with(_ALL_WALKS)} SELECT s AS state_id FROM walks WHERE name <> 'V_ORPHAN' GROUP BY s HAVING count(DISTINCT name) = 4",
    "graduable_prefix_pairs": f"{_with(_ALL_WALKS)} SELECT s AS state_id FROM walks WHERE name <> 'V_ORPHAN' GROUP BY s HAVING count(DISTINCT name) = 4",
    "unreachable_states": f"{_with(_ALL_WALKS)} SELECT state_id FROM fab_states WHERE state_id <> 0 AND state_id NOT IN (SELECT s FROM walks WHERE name <> 'V_ORPHAN')",
    "locked_branches": f"""{_with(_walk('anc', 22), "below(s) AS (SELECT CAST(22 AS BIGINT) UNION ALL SELECT st.state_id FROM fab_states st JOIN below b ON st.parent_state_id = b.s)")}
SELECT s AS state_id FROM anc UNION SELECT s FROM below""",
    "collapse_plan": f"{_with(_SURVIVAL)} SELECT child, node AS anchor FROM up WHERE node NOT IN (SELECT s FROM goes)",
    "closure_census": f"""{_with(_ALL_WALKS, "stored AS (SELECT DISTINCT v.owner, v.name, l.lineage_id AS s FROM fab_versions v JOIN fab_states st ON st.state_id = v.state_id JOIN fab_lineages l ON l.lineage_name = st.lineage_name WHERE l.lineage_id <= v.state_id AND l.lineage_id <> 0)")}
SELECT coalesce(w.owner, c.owner) AS owner, coalesce(w.name, c.name) AS name, count(*) FILTER (w.s IS NULL) AS n_over, count(*) FILTER (c.s IS NULL) AS n_under
FROM walks w FULL JOIN stored c ON w.owner = c.owner AND w.name = c.name AND w.s = c.s GROUP BY 1, 2""",
    "preconditions": f"""{_with()} SELECT 'repeated_parent_lineage' AS violation, count(*) AS n FROM (SELECT 1 FROM fab_states GROUP BY parent_state_id, lineage_name HAVING count(*) > 1) HAVING count(*) > 0""",
    "missing_self_rows": f"{_with()} SELECT state_id FROM fab_states s WHERE NOT EXISTS (SELECT 1 FROM fab_lineages l WHERE l.lineage_name = s.lineage_name AND l.lineage_id = s.state_id)",
    "graduate_base": f"{_with(_graduated())} SELECT * FROM fab_base WHERE objectid NOT IN (SELECT objectid FROM won) AND objectid NOT IN (SELECT oid FROM gone) UNION ALL SELECT {_COLUMNS} FROM won",
    "graduate_adds": f"{_with()} SELECT * FROM fab_a WHERE sde_state_id NOT IN {_PREFIX}",
    "graduate_deletes": f"{_with()} SELECT * FROM fab_d WHERE sde_state_id NOT IN {_PREFIX} AND deleted_at NOT IN {_PREFIX}",
    "prune_adds": f"{_with()} SELECT * FROM fab_a WHERE sde_state_id NOT IN {_GONE}",
    "prune_deletes": f"{_with()} SELECT * FROM fab_d WHERE sde_state_id NOT IN {_GONE} AND deleted_at NOT IN {_GONE}",
    "prune_lineages": f"{_with()} SELECT * FROM fab_lineages WHERE lineage_id NOT IN {_GONE}",
    "collapse_adds": f"""{_with(_COLLAPSE)} SELECT a.objectid, coalesce(r.anchor, a.sde_state_id) AS sde_state_id, a.c_name, a.c_nationkey, a.c_mktsegment, a.c_acctbal
FROM fab_a a LEFT JOIN runs r ON r.s = a.sde_state_id LEFT JOIN last l ON l.oid = a.objectid AND l.anchor = r.anchor WHERE r.anchor IS NULL OR l.s = a.sde_state_id""",
    "collapse_deletes": f"""{_with(_COLLAPSE)} SELECT d.sde_deletes_row_id, coalesce(r.anchor, d.sde_state_id) AS sde_state_id, coalesce(p.anchor, d.deleted_at) AS deleted_at
FROM fab_d d LEFT JOIN runs r ON r.s = d.sde_state_id LEFT JOIN last l ON l.oid = d.sde_deletes_row_id AND l.anchor = r.anchor LEFT JOIN plan p ON p.child = d.deleted_at WHERE r.anchor IS NULL OR l.s = d.sde_state_id""",
    "collapse_states": f"{_with(_COLLAPSE)} SELECT s.state_id, coalesce(p.anchor, s.parent_state_id) AS parent_state_id, s.lineage_name FROM fab_states s LEFT JOIN plan p ON p.child = s.parent_state_id WHERE s.state_id NOT IN (SELECT child FROM plan)",
    "collapse_lineages": f"{_with(_COLLAPSE)} SELECT DISTINCT l.lineage_name, coalesce(p.anchor, l.lineage_id) AS lineage_id FROM fab_lineages l LEFT JOIN plan p ON p.child = l.lineage_id",
    "reconcile_adds": f"""{_with(_RECONCILED)} SELECT * FROM left_a UNION ALL SELECT a.objectid, CAST(15 AS BIGINT), a.c_name, a.c_nationkey, a.c_mktsegment, a.c_acctbal
FROM fab_a a JOIN todo t ON t.objectid = a.objectid AND t.state_id = a.sde_state_id WHERE t.change_type <> 'delete'""",
    "reconcile_deletes": f"{_with(_RECONCILED)} SELECT * FROM left_d UNION ALL SELECT objectid, CAST(15 AS BIGINT), CAST(15 AS BIGINT) FROM todo WHERE change_type <> 'insert'",
    "reconcile_lineages": f"{_with()} SELECT * FROM fab_lineages UNION SELECT CAST(11 AS BIGINT), CAST(unnest([7, 8, 9, 10]) AS BIGINT)",
    "post_trim_visible": f"{_with(_walk('anc', 10), _POSTED, f'new_walk AS (SELECT s FROM anc UNION ALL SELECT CAST({_NEW_STATE} AS BIGINT))')} {_visible(_in('new_walk'), 'post_a', 'post_d')}",
    "rebase_visible": f"""{_with(_walk('child_walk', 15), _walk('parent_walk', 10), _THREE)}
SELECT * FROM child_rows WHERE objectid IN (SELECT objectid FROM classes WHERE outcome IN ('replay', 'conflict_add'))
UNION ALL SELECT * FROM parent_rows WHERE objectid NOT IN (SELECT objectid FROM classes WHERE outcome <> 'drop')""",
    "rebase_adds": f"""{_with(_walk('child_walk', 15), _walk('parent_walk', 10), _THREE)} SELECT * FROM fab_a
UNION ALL SELECT objectid, CAST({_NEW_STATE} AS BIGINT), c_name, c_nationkey, c_mktsegment, c_acctbal FROM (
  SELECT *, row_number() OVER (PARTITION BY objectid ORDER BY sde_state_id DESC) AS rn FROM fab_a WHERE sde_state_id IN {_in('child_walk')})
WHERE rn = 1 AND objectid IN (SELECT objectid FROM classes WHERE outcome IN ('replay', 'conflict_add'))""",
    "rebase_deletes": f"""{_with(_walk('child_walk', 15), _walk('parent_walk', 10), _THREE)} SELECT * FROM fab_d
UNION ALL SELECT objectid, CAST({_NEW_STATE} AS BIGINT), CAST({_NEW_STATE} AS BIGINT) FROM classes WHERE outcome IN ('delete', 'conflict_delete')""",
    "rebase_lineages": f"{_with(_walk('parent_walk', 10))} SELECT * FROM fab_lineages UNION ALL SELECT CAST({_NEW_STATE} AS BIGINT), s FROM (SELECT s FROM parent_walk UNION SELECT 0 UNION SELECT {_NEW_STATE})",
    "reconcile_merge_adds": f"""{_with(_FAVORED, f"merged AS (SELECT objectid, {', '.join(_merged(*x) for x in _FOUR)} FROM images WHERE {_NO_CLASH} AND ({_PARENT_ONLY}) UNION ALL SELECT objectid, 'merged', 0, 'none', 0.0 FROM images WHERE {_NO_CLASH} AND NOT ({_PARENT_ONLY}))")}
SELECT a.objectid, a.sde_state_id, {', '.join(f"CASE WHEN m.objectid IS NULL THEN a.{n} ELSE m.{n} END AS {n}" for *_, n in _FOUR)}
FROM fab_a a LEFT JOIN merged m ON m.objectid = a.objectid AND a.sde_state_id = 15 UNION ALL {_TAKEN}""",
    "reconcile_favor_edit_adds": f"{_with(_FAVORED)} SELECT * FROM fab_a UNION ALL {_TAKEN}",
    "reconcile_favor_edit_deletes": f"{_with(_FAVORED)} SELECT * FROM fab_d UNION ALL SELECT objectid, CAST(15 AS BIGINT), CAST(15 AS BIGINT) FROM todo WHERE change_type <> 'insert'",
    "post_visible": _read("V_A"),
    "post_deletes": f"""{_with(_walk('anc', 10), "closure AS (SELECT lineage_id AS s FROM fab_lineages WHERE lineage_name = 11 AND lineage_id <= 15 UNION SELECT s FROM anc)",
        "edits AS (SELECT objectid AS oid, max(sde_state_id) AS s FROM fab_a WHERE sde_state_id IN (SELECT s FROM closure) AND sde_state_id > 10 GROUP BY objectid)",
        "marks AS (SELECT sde_deletes_row_id AS oid, max(sde_state_id) AS s FROM fab_d WHERE sde_state_id IN (SELECT s FROM closure) AND sde_state_id > 10 GROUP BY sde_deletes_row_id)")}
SELECT * FROM fab_d UNION ALL SELECT oid, CAST(0 AS BIGINT), s FROM (SELECT * FROM edits UNION ALL SELECT * FROM marks WHERE oid NOT IN (SELECT oid FROM edits)) e
WHERE oid IN (SELECT objectid FROM fab_base) AND NOT EXISTS (SELECT 1 FROM fab_d d WHERE d.sde_deletes_row_id = e.oid AND d.sde_state_id = 0 AND d.deleted_at IN (SELECT s FROM closure))""",
    "shadow_markers": f"""{_with(f"edits AS (SELECT objectid AS oid, max(sde_state_id) AS s FROM fab_a WHERE sde_state_id IN {_CLOSURE_A} AND sde_state_id > 6 GROUP BY objectid)", f"marks AS (SELECT sde_deletes_row_id AS oid, max(sde_state_id) AS s FROM fab_d WHERE sde_state_id IN {_CLOSURE_A} AND sde_state_id > 6 GROUP BY sde_deletes_row_id)")}
SELECT oid AS sde_deletes_row_id, CAST(0 AS BIGINT) AS sde_state_id, s AS deleted_at FROM (SELECT * FROM edits UNION ALL SELECT * FROM marks WHERE oid NOT IN (SELECT oid FROM edits)) e
WHERE oid IN (SELECT objectid FROM fab_base) AND NOT EXISTS (SELECT 1 FROM fab_d d WHERE d.sde_deletes_row_id = e.oid AND d.sde_state_id = 0 AND d.deleted_at IN {_CLOSURE_A[:-1]}, 0))""",
    "revert_adds": f"{_with()} SELECT * FROM fab_a WHERE NOT (sde_state_id IN {_OURS} AND objectid BETWEEN 1 AND 199)",
    "revert_deletes": f"{_with()} SELECT * FROM fab_d WHERE NOT (sde_state_id IN {_OURS} AND sde_deletes_row_id BETWEEN 1 AND 199)",
}
