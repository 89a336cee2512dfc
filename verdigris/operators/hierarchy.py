"""Parent-child links to full hierarchies: ends of chains, depths, cycles, paths, descendants, ancestor tests.

Links are solved by weighted disjoint-set forests. Each block of a range partitioning joins its own links into trees whose members know their offset to
the tree's root, always the smaller tree below the larger. Only the tops' links to other blocks go on to the next level, with fewer blocks, until one
block is left. Where ids have no locality and a level hardly shrinks, the tops that a coin sends to another top are joined to it (random mates), which
takes away a part of them whatever the ids are. So one method serves any number of nodes, and a task holds the nodes of one block.

The levels form an index of parents: walks, climbs, paths and subtree sums go through it block by block, down from the last level to the first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.session import cut_lineage, shuffle_partitions

#: Nodes that one task solves at once.
BLOCK_NODES = 65_536
#: Fewer nodes are not worth a task of their own.
LEAST_NODES = 2_048
#: Ids of paths that a task writes at a time.
PATH_IDS = 2_000_000

_ROWS = ["node", "parent", "weight", "end_kind", "end_id", "end_steps"]
_LEVEL = "block long, node long, parent long, weight long, end_kind string, end_id long, end_steps long, up long, top long, steps long, tangled boolean, knot boolean"


def links_of(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """Distinct (node, parent). Null nodes are left out; of several parents of a node the smallest counts, a null one only if there is no other."""
    return rows.filter(F.col(node).isNotNull()).groupBy(F.col(node).cast("long").alias("node")).agg(F.min(F.col(parent).cast("long")).alias("parent"))


def join_block(node: np.ndarray, parent: np.ndarray, weight: np.ndarray, linked: np.ndarray):
    """(order, up, top, steps, tangled, knot) of the links of one block, as positions in the order of the sorted nodes.

    A disjoint-set forest with offsets: every link unites the sets of its ends, the smaller one below the larger, and tells how much deeper the one root
    is than the other. up is the parent within the block (a node without one is its own), top the last node that a chain reaches within the block and
    steps the sum of weights to it. A link within one set closes a cycle; its node is a knot, and the chains of that set, which never leave it, are tangled.
    """
    order = np.argsort(node, kind="stable")
    node, parent, weight, linked = node[order], parent[order], weight[order], linked[order]
    at = np.minimum(np.searchsorted(node, parent), len(node) - 1)
    within = linked & (node[at] == parent)
    root, offset, size = list(range(len(node))), [0] * len(node), [1] * len(node)
    knots: list[int] = []

    def find(x: int) -> int:
        """The root of a set; all nodes on the way are hung directly below it, with their offsets."""
        way = []
        while root[x] != x:
            way.append(x)
            x = root[x]
        total = 0
        for y in reversed(way):
            total += offset[y]
            root[y], offset[y] = x, total
        return x

    places = np.flatnonzero(within)
    for child, above, steps in zip(places.tolist(), at[places].tolist(), weight[places].tolist()):
        a, b = find(child), find(above)
        if a == b:
            knots.append(child)
            continue
        # How much deeper the root of the child's set is than that of the parent's.
        deeper = offset[above] + steps - offset[child]
        if size[a] > size[b]:
            root[b], offset[b] = a, -deeper
            size[a] += size[b]
        else:
            root[a], offset[a] = b, deeper
            size[b] += size[a]
    sets = np.array([find(x) for x in range(len(node))], dtype=np.int64)
    depth = np.array(offset, dtype=np.int64)
    ends = np.flatnonzero(~within)
    top_of = np.full(len(node), -1, dtype=np.int64)
    top_of[sets[ends]] = ends
    top = top_of[sets]
    tangled = top < 0
    top = np.where(tangled, np.arange(len(node)), top)
    knot = np.zeros(len(node), dtype=bool)
    knot[knots] = True
    return order, np.where(within, at, np.arange(len(node))), top, np.where(tangled, 0, depth - depth[top]), tangled, knot


def _whole(batches) -> pa.Table | None:
    """All rows of a partition, None if there are none."""
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found) if found else None


def _longs(rows: pa.Table, name: str) -> np.ndarray:
    """A column of longs, 0 for null."""
    return rows.column(name).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _solve_block(batches):
    rows = _whole(batches)
    if rows is None:
        return
    node, parent = _longs(rows, "node"), _longs(rows, "parent")
    linked = rows.column("parent").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    order, up, top, steps, tangled, knot = join_block(node, parent, _longs(rows, "weight"), linked)
    rows, node = rows.take(pa.array(order)), node[order]
    made = [pa.array(node[up]), pa.array(node[top]), pa.array(steps), pa.array(tangled), pa.array(knot)]
    names = [n for n in rows.column_names]
    yield from pa.table([*rows.columns, *made], names=[*names, "up", "top", "steps", "tangled", "knot"]).to_batches()


class _Index:
    """Rows (node, up, steps) of whole blocks; finds nodes and goes up from them within their blocks."""

    def __init__(self, node: np.ndarray, up: np.ndarray, steps: np.ndarray):
        order = np.argsort(node, kind="stable")
        self.order, self.node, self.steps = order, node[order], steps[order]
        self.up = np.searchsorted(self.node, up[order]) if len(node) else order

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Positions of nodes that are there."""
        return np.searchsorted(self.node, ids)

    def climb(self, at: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last position above each one that is at most `left` steps away, and the steps that remain; by powers of two."""
        start, lifts = self.steps[at], [self.up]
        while len(self.up) and (lifts[-1] != lifts[-1][lifts[-1]]).any() and len(lifts) < 62:
            lifts.append(lifts[-1][lifts[-1]])
        for lift in reversed(lifts):
            above = lift[at]
            at = np.where(start - self.steps[above] <= left, above, at)
        return at, left - (start - self.steps[at])

    def walks(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions below its top down to each one, one walk after another, and the offsets of the walks."""
        length, here = np.zeros(len(at), dtype=np.int64), at.copy()
        open_ = np.arange(len(at))
        while len(open_ := open_[self.up[here[open_]] != here[open_]]):
            length[open_] += 1
            here[open_] = self.up[here[open_]]
        offsets = np.concatenate([[0], np.cumsum(length)])
        out, place, here = np.empty(offsets[-1], dtype=np.int64), offsets[1:] - 1, at.copy()
        open_ = np.flatnonzero(length)
        left = length.copy()
        while len(open_):
            out[place[open_]] = here[open_]
            here[open_], place[open_], left[open_] = self.up[here[open_]], place[open_] - 1, left[open_] - 1
            open_ = open_[left[open_] > 0]
        return out, offsets


def _query(solve, schema: str):
    """For each partition: solve(index, rows of its queries), both as of `_asked`."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        rows = _whole(batches)
        if rows is None:
            return
        asks = rows.column("ask").combine_chunks().to_numpy(zero_copy_only=False)
        columns = {c: _longs(rows, c) for c in ("node", "up", "steps", "x", "y")}
        own, asked = ({c: v[m] for c, v in columns.items()} for m in (~asks, asks))
        for found in solve(_Index(own["node"], own["up"], own["steps"]), own, asked):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=names)

    return run


def _mark(index: _Index, _, asked: dict):
    """Query: label x, from a node on. Each node of the walks up to the tops, once, with a label."""
    label = {}
    up, at = index.up.tolist(), index.find(asked["node"]).tolist()
    for x, here in zip(asked["x"].tolist(), at):
        while here not in label:
            label[here] = x
            here = up[here]
    places = np.fromiter(label, dtype=np.int64, count=len(label))
    yield np.fromiter(label.values(), dtype=np.int64, count=len(label)), index.node[places]


def _climb(index: _Index, _, asked: dict):
    """Query: number x, to climb y steps from a node."""
    at, left = index.climb(index.find(asked["node"]), asked["y"])
    yield asked["x"], index.node[at], left


def _sum(index: _Index, own: dict, asked: dict):
    """Query: y more for a node. For every node the sum of its own 1 or x and of all below it in the block."""
    total = own["x"][index.order].copy()
    np.add.at(total, index.find(asked["node"]), asked["y"])
    total, up = total.tolist(), index.up.tolist()
    for here in np.argsort(-index.steps, kind="stable").tolist():
        if up[here] != here:
            total[up[here]] += total[here]
    yield index.node, np.array(total, dtype=np.int64)


@dataclass
class Level:
    """Solved rows of one level, in `parts` blocks or stars, and the ended tops that no other row of the next level leads to."""

    rows: DataFrame
    parts: int
    loose: DataFrame | None = None

    def ask(self, queries: DataFrame, solve, schema: str, own=None) -> DataFrame:
        """The answers to queries (node, x, y), each in the block of its node."""
        rows = self.rows.select("block", "node", "up", "steps", F.lit(False).alias("ask"), (own if own is not None else F.lit(1)).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
        asked = queries.join(self.rows.select("node", "block"), "node").select("block", "node", F.lit(None).cast("long").alias("up"), F.lit(None).cast("long").alias("steps"), F.lit(True).alias("ask"), "x", "y")
        return cut_lineage(rows.unionByName(asked).repartition(self.parts, "block").mapInArrow(_query(solve, schema), schema))

    @property
    def tops(self) -> DataFrame:
        return self.rows.filter("top = node and not tangled")

    @property
    def exits(self) -> DataFrame:
        """(node, out_parent, out_weight) of the tops whose link leads out of the block."""
        return self.tops.filter("parent is not null").select("node", F.col("parent").alias("out_parent"), F.col("weight").alias("out_weight"))


class Forest:
    """The levels of the links `rows` (node unique, parent, weight, and for those without parent their end)."""

    def __init__(self, rows: DataFrame, block_nodes: int = BLOCK_NODES):
        self.levels: list[Level] = []
        self._tasks, self._most = shuffle_partitions(rows.sparkSession), block_nodes
        rows = cut_lineage(rows.select(*_ROWS))
        count = rows.count()
        while True:
            blocks = max(1, math.ceil(count / block_nodes), min(self._tasks, count // min(block_nodes, LEAST_NODES)) if not self.levels else 1)
            self.levels.append(Level(self._blocks(rows, blocks), blocks))
            if blocks == 1:
                return
            before, (rows, count) = count, self._rise()
            if count > before // 2:
                self.levels.append(Level(self._stars(rows), max(1, math.ceil(count / block_nodes))))
                rows, count = self._rise()

    def _blocks(self, rows: DataFrame, blocks: int) -> DataFrame:
        spread = rows.repartition(1) if blocks == 1 else rows.repartitionByRange(blocks, "node")
        return cut_lineage(spread.select(F.spark_partition_id().cast("long").alias("block"), *_ROWS).mapInArrow(_solve_block, _LEVEL))

    def _stars(self, rows: DataFrame) -> DataFrame:
        """A level in which tops join the top that they lead to, if their own coin is tails and its coin heads or it has ended."""
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(len(self.levels))), F.lit(2)) == 1
        ended = rows.filter("parent is null").select(F.col("node").alias("parent"), F.lit(True).alias("settled"))
        marked = rows.join(ended, "parent", "left").join(rows.select(F.col("node").alias("parent"), F.lit(True).alias("known")), "parent", "left")
        joins = F.coalesce(F.col("known") & (F.col("parent") != F.col("node")) & coin(F.col("node")) & (F.col("settled").isNotNull() | ~coin(F.col("parent"))), F.lit(False))
        to = F.when(joins, F.col("parent")).otherwise(F.col("node"))
        return cut_lineage(
            marked.select(to.alias("block"), *_ROWS, to.alias("up"), to.alias("top"), F.when(joins, F.col("weight")).otherwise(F.lit(0)).cast("long").alias("steps"), F.lit(False).alias("tangled"), F.lit(False).alias("knot"))
        )

    def _rise(self) -> tuple[DataFrame, int]:
        """The tops of the last level as the rows of the next: links to the top of their parent, and the ended tops that such links lead to."""
        level = self.levels[-1]
        found = level.rows.select(F.col("node").alias("out_parent"), F.col("top").alias("next"), F.col("steps").alias("more"), F.col("tangled").alias("caught"))
        out = level.exits.join(found, "out_parent", "left")
        lost, caught = F.col("next").isNull(), F.coalesce(F.col("caught"), F.lit(False))
        ends = lost | caught
        moved = out.select(
            "node",
            F.when(~ends, F.col("next")).alias("parent"),
            F.when(~ends, F.col("out_weight") + F.col("more")).alias("weight"),
            F.when(lost, F.lit("detached")).when(caught, F.lit("tangled")).alias("end_kind"),
            F.when(ends, F.col("out_parent")).alias("end_id"),
            F.when(ends, F.col("out_weight")).alias("end_steps"),
        )
        rows = cut_lineage(moved.unionByName(level.tops.filter("parent is null").select(*_ROWS)))
        led_to = rows.filter("parent is not null").select(F.col("parent").alias("node")).distinct()
        ended = rows.filter("parent is null")
        level.loose = ended.join(led_to, "node", "left_anti").select("node", "end_kind", "end_id", "end_steps")
        kept = cut_lineage(rows.filter("parent is not null").unionByName(ended.join(led_to, "node", "left_semi").select(*_ROWS)))
        return kept, kept.count()

    def ends(self) -> DataFrame:
        """(node, kind, end_id, depth), kind `tangled` where a chain runs into a cycle."""
        found = None
        for level in reversed(self.levels):
            if found is None:
                # Of the last block, a link that leads out leads to no node at all.
                found = level.tops.select(
                    "node",
                    F.coalesce("end_kind", F.lit("detached")).alias("kind"),
                    F.coalesce("end_id", "parent").alias("end_id"),
                    F.coalesce("end_steps", "weight").alias("depth"),
                )
            else:
                found = found.unionByName(level.loose.toDF("node", "kind", "end_id", "depth"))
            tops = found.select(F.col("node").alias("top"), "kind", "end_id", "depth")
            joined = level.rows.select("node", "top", "steps", "tangled").join(tops, "top", "left")
            lost = F.col("tangled") | F.col("kind").isNull() | (F.col("kind") == "tangled")
            found = cut_lineage(
                joined.select(
                    "node",
                    F.when(lost, F.lit("tangled")).otherwise(F.col("kind")).alias("kind"),
                    F.when(~lost, F.col("end_id")).alias("end_id"),
                    F.when(~lost, F.col("steps") + F.col("depth")).alias("depth"),
                )
            )
        return found

    def marked(self, tips: DataFrame | None) -> DataFrame:
        """(label, node): all nodes on the chains of `tips` (node), label 0; without tips those on cycles, labelled by a node of their cycle."""
        starts = []
        for level in self.levels:
            if tips is None:
                starts.append(level.rows.filter("knot").select("node", F.col("node").alias("x")))
            else:
                starts.append(tips.select("node", F.lit(0).cast("long").alias("x")))
                tips = cut_lineage(level.rows.join(tips.select("node"), "node", "left_semi").select(F.col("top").alias("node")).distinct())
        above = None
        for level, start in zip(reversed(self.levels), reversed(starts)):
            if above is not None:
                start = start.unionByName(level.exits.join(above, "node").select(F.col("out_parent").alias("node"), F.col("label").alias("x")))
            above = level.ask(start.withColumn("y", F.lit(0).cast("long")), _mark, "label long, node long")
        return above

    def climbed(self, queries: DataFrame) -> DataFrame:
        """(x, node): the node `y` steps above the node of each query (x unique, node, y); there must be that many."""
        settled, open_ = [], queries.select("x", "node", "y")
        for level in self.levels:
            at = open_.join(level.rows.select("node", "top", "steps"), "node")
            at = cut_lineage(at) if level is not self.levels[-1] else at
            inside = (F.col("y") <= F.col("steps")) if level is not self.levels[-1] else F.lit(True)
            settled.append(at.filter(inside).select("x", "node", "y"))
            open_ = at.filter(~inside).select("x", F.col("top").alias("node"), (F.col("y") - F.col("steps")).alias("y"))
        done, within = [], None
        for level, start in zip(reversed(self.levels), reversed(settled)):
            if within is not None:
                # The rest of a climb ends within the link of its node, which begins with the way out of the block below.
                exits = within.join(level.exits, "node")
                passed = F.col("out_weight") <= F.col("y")
                short = exits.filter(~passed).select("x", "node", "y")
                start = start.unionByName(exits.filter(passed).select("x", F.col("out_parent").alias("node"), (F.col("y") - F.col("out_weight")).alias("y")))
            found = level.ask(start, _climb, "x long, node long, y long")
            done.append(found.filter("y = 0").select("x", "node"))
            rest = found.filter("y > 0")
            within = rest if within is None else cut_lineage(rest.unionByName(short))
        result = done[0]
        for more in done[1:]:
            result = result.unionByName(more)
        return result

    def subtree_sizes(self, weights: DataFrame | None = None) -> DataFrame:
        """(node, n): the number of nodes whose chain goes through the node, itself counted, or the sum of their weights (node, own); without cycles."""
        own = [weights]
        for level, above in zip(self.levels, self.levels[1:]):
            sizes = level.rows.withColumn("own", F.lit(1).cast("long")) if own[-1] is None else level.rows.join(own[-1], "node")
            own.append(cut_lineage(sizes.groupBy(F.col("top").alias("node")).agg(F.sum("own").alias("own"))))
        found = None
        for level, sizes in zip(reversed(self.levels), reversed(own)):
            more = level.rows.limit(0).select("node", F.col("steps").alias("y"))
            if found is not None:
                more = level.exits.join(found, "node").groupBy(F.col("out_parent").alias("node")).agg(F.sum("n").alias("y"))
            rows = level if sizes is None else Level(level.rows.join(sizes, "node"), level.parts)
            found = rows.ask(more.withColumn("x", F.lit(0).cast("long")).select("node", "x", "y"), _sum, "node long, n long", None if sizes is None else F.col("own"))
        return found

    def paths(self) -> DataFrame:
        """(node, path): the ids from the end of its chain down to each node that is not tangled."""
        link, parts = None, []
        for level in self.levels:
            rows = level.rows.select("block", "node", "up", "steps", F.array("node").alias("link")) if link is None else level.rows.select("block", "node", "up", "steps").join(link, "node")
            part = cut_lineage(rows.repartition(level.parts, "block").mapInArrow(_walk_links, "node long, part array<long>"))
            parts.append(part)
            if level is not self.levels[-1]:
                own = level.exits if link is None else level.exits.join(link, "node")
                own = own.select("node", "out_parent", F.array("node").alias("link") if link is None else F.col("link"))
                out = own.join(part.select(F.col("node").alias("out_parent"), "part"), "out_parent").select("node", F.concat("part", "link").alias("link"))
                ended = level.tops.filter("parent is null").select("node", F.array("node").alias("link"))
                # A link that leads to no node, or into a cycle, begins nowhere.
                lost = level.exits.join(out.select("node"), "node", "left_anti").select("node", F.array("node").alias("link"))
                link = cut_lineage(out.unionByName(ended).unionByName(lost))
        found = None
        for level, part in zip(reversed(self.levels), reversed(parts)):
            tops = level.tops.select("node", F.array("node").alias("path")) if found is None else found.unionByName(level.loose.select("node", F.array("node").alias("path")))
            joined = level.rows.filter("not tangled").select("node", "top").join(part, "node").join(tops.select(F.col("node").alias("top"), "path"), "top")
            found = joined.select("node", F.concat("path", "part").alias("path"))
            found = cut_lineage(found)
        return found


def _walk_links(batches):
    """(node, part): the links of the walk below the top of its block down to each node, joined; written in pieces of some million ids."""
    rows = _whole(batches)
    if rows is None:
        return
    node = _longs(rows, "node")
    index = _Index(node, _longs(rows, "up"), _longs(rows, "steps"))
    link = rows.column("link").combine_chunks().take(pa.array(index.order))
    ids, bounds = link.flatten().to_numpy(), np.concatenate([[0], np.cumsum(link.value_lengths().to_numpy())])
    length = np.diff(bounds)
    # A walk has at most as many ids as steps to the top.
    for piece in np.split(np.arange(len(node)), np.unique(np.searchsorted(np.cumsum(index.steps + 1), np.arange(PATH_IDS, int((index.steps + 1).sum()) + 1, PATH_IDS)))):
        if not len(piece):
            continue
        walk, offsets = index.walks(piece)
        sizes = length[walk]
        total = np.concatenate([[0], np.cumsum(sizes)])
        where = np.repeat(bounds[:-1][walk] - total[:-1], sizes) + np.arange(total[-1])
        yield pa.RecordBatch.from_arrays([pa.array(index.node[piece]), pa.ListArray.from_arrays(pa.array(total[offsets], pa.int32()), pa.array(ids[where]))], names=["node", "part"])


def _rows_of(links: DataFrame, ended, kind=None, end=None) -> DataFrame:
    """`links` as rows of a forest; where `ended` holds, a chain ends with `kind` at `end`."""
    return links.select(
        "node",
        F.when(~ended, F.col("parent")).alias("parent"),
        F.when(~ended, F.lit(1)).cast("long").alias("weight"),
        F.when(ended, kind if kind is not None else F.lit("root")).alias("end_kind"),
        F.when(ended, end if end is not None else F.col("node")).alias("end_id"),
        F.when(ended, F.lit(0)).cast("long").alias("end_steps"),
    )


def _ended(roots: tuple[int, ...]):
    return F.col("parent").isNull() | F.col("node").isin(*roots)


@dataclass
class Hierarchy:
    """All links (node, parent), the ends of their chains, and (label, node, smallest, length) of the nodes on cycles, None if there are none."""

    links: DataFrame
    ends: DataFrame
    members: DataFrame | None
    forest: Forest


def solve(links: DataFrame, roots: tuple[int, ...] = (0,), block_nodes: int = BLOCK_NODES) -> Hierarchy:
    """The ends of all chains, as in `resolve`."""
    forest = Forest(_rows_of(links, _ended(roots)), block_nodes)
    ends = forest.ends()
    tangled = cut_lineage(ends.filter("kind = 'tangled'").select("node").join(links, "node"))
    if tangled.isEmpty():
        return Hierarchy(links, ends, None, forest)
    around = forest.marked(None)
    sizes = around.groupBy("label").agg(F.min("node").alias("smallest"), F.count(F.lit(1)).alias("length"))
    members = cut_lineage(around.join(sizes, "label"))
    on = members.select("node", "smallest")
    below = tangled.join(on, "node", "left")
    caught = Forest(_rows_of(below, F.col("smallest").isNotNull(), F.lit("below"), F.col("smallest")), block_nodes).ends().join(on.select("node"), "node", "left_anti")
    found = ends.filter("kind <> 'tangled'").unionByName(caught).unionByName(members.select("node", F.lit("cycle").alias("kind"), F.col("smallest").alias("end_id"), F.col("length").alias("depth")))
    return Hierarchy(links, cut_lineage(found), members, forest)


def resolve(links: DataFrame, roots: tuple[int, ...] = (0,), block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(node, kind, end_id, depth) for each node of `links` (node unique, parent).

    kind `root`: the chain ends at a node of `roots` or one without parent, end_id, depth steps above. `detached`: it ends at a parent that is no
    node, end_id, depth steps above. `cycle`: the node is on a cycle of depth nodes, of which end_id is the smallest. `below`: the first node of
    such a cycle is depth steps above.
    """
    return solve(links, roots, block_nodes).ends


def _untied(tree: Hierarchy, roots: tuple[int, ...], block_nodes: int) -> Forest:
    """The forest in which the nodes on cycles are roots."""
    if tree.members is None:
        return tree.forest
    marked = tree.links.join(tree.members.select("node", "label"), "node", "left")
    return Forest(_rows_of(marked, _ended(roots) | F.col("label").isNotNull()), block_nodes)


def paths(tree: Hierarchy, roots: tuple[int, ...] = (0,), block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(node, path) of every node: the ids from the end of its chain down to it.

    A path begins at the root or parentless node, at the last known node of a detached chain, or at the first cycle member that the chain reaches.
    That of a node on a cycle goes once round it: it begins at the node's own child on the cycle.
    """
    found = _untied(tree, roots, block_nodes).paths()
    if tree.members is None:
        return found
    # Cut at its smallest node, a cycle is one path.
    cut = tree.links.join(tree.members.select("node", "smallest", "length"), "node")
    lines = Forest(_rows_of(cut, F.col("node") == F.col("smallest")), block_nodes).paths().join(tree.members.select("node", "smallest", "length"), "node")
    whole = lines.filter(F.size("path") == F.col("length")).select("smallest", F.col("path").alias("all"))
    round_it = lines.join(whole, "smallest").select("node", F.concat(F.slice("all", F.size("path") + 1, F.greatest(F.size("all") - F.size("path"), F.lit(1))), "path").alias("path"))
    return found.join(tree.members.select("node"), "node", "left_anti").unionByName(round_it)


def descendant_counts(tree: Hierarchy, roots: tuple[int, ...] = (0,), block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(node, n): the number of other nodes whose chain of parents goes through the node."""
    sizes = _untied(tree, roots, block_nodes).subtree_sizes()
    if tree.members is None:
        return sizes.select("node", (F.col("n") - 1).alias("n"))
    # All nodes on a cycle have each other and what is below any of them.
    on = sizes.join(tree.members.select("node", "label"), "node", "left")
    tied = on.filter("label is not null").groupBy("label").agg(F.sum("n").alias("all"))
    return on.join(tied, "label", "left").select("node", (F.coalesce("all", "n") - 1).alias("n"))


def descendants(found: DataFrame, ends: DataFrame) -> DataFrame:
    """(node, descendant): every node with each other node whose chain of parents goes through it, from the `paths` and `resolve` of all nodes.

    Of nodes on a cycle these are the others on it and all below it; no node is its own descendant.
    """
    on_path = found.select(F.explode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("above"), "node")
    # The path of a node below a cycle holds only the first member that it reaches.
    below = ends.filter("kind = 'below'").select("node", "end_id").join(found.select("node", F.col("path")[0].alias("first")), "node")
    members = ends.filter("kind = 'cycle'").select(F.col("node").alias("above"), "end_id")
    round_it = below.join(members, "end_id").filter("above <> first").select("above", "node")
    return on_path.unionByName(round_it).select(F.col("above").alias("node"), F.col("node").alias("descendant"))


def are_ancestors(pairs: DataFrame, tree: Hierarchy) -> DataFrame:
    """`pairs` (low, high, both reaching one root, and their depths low_depth, high_depth) with `above`: whether high is low or an ancestor of it."""
    numbered = cut_lineage(pairs.withColumn("__x", F.monotonically_increasing_id()))
    climb = F.col("low_depth") - F.col("high_depth")
    asked = numbered.filter(climb >= 0).select(F.col("__x").alias("x"), F.col("low").alias("node"), climb.alias("y"))
    reached = tree.forest.climbed(asked).select(F.col("x").alias("__x"), F.col("node").alias("__reached"))
    return numbered.join(reached, "__x", "left").withColumn("above", F.coalesce(F.col("__reached") == F.col("high"), F.lit(False))).drop("__x", "__reached")


def ancestors_of(links: DataFrame, tip: int | None, root: int = 0, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(state) of `tip` and all nodes above it, without `root`; a tip of null or `root` has none. A chain that cycles or leads nowhere ends there."""
    spark = links.sparkSession
    if tip is None or tip == root:
        return spark.createDataFrame([], "state long")
    tips = spark.createDataFrame([(int(tip),)], "node long")
    return chains_of(links, tips, root, block_nodes).select(F.col("node").alias("state")).unionByName(tips.select(F.col("node").alias("state"))).distinct()


def chains_of(links: DataFrame, tips: DataFrame, root: int = 0, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """Distinct (node) of `tips` (node) and all nodes above any of them, without `root`; tips that are no nodes are left out."""
    return Forest(_rows_of(links, _ended((root,))), block_nodes).marked(tips).select("node").filter(F.col("node") != root).distinct()


def full_hierarchy(rows: DataFrame, node: str, parent: str, root: int = 0, block_nodes: int = BLOCK_NODES, unrooted: bool = False) -> DataFrame:
    """(node_id, kind, root_id, depth, n_descendants, path) of every node, as `resolve`, `paths` and `descendant_counts` define them.

    Path and n_descendants are null where the chain does not reach `root`, unless `unrooted` asks for those of all nodes. Repeats of a node count once;
    an empty table gives no rows.
    """
    tree = solve(cut_lineage(links_of(rows, node, parent)), (root,), block_nodes)
    joined = tree.ends.join(paths(tree, (root,), block_nodes), "node", "left").join(descendant_counts(tree, (root,), block_nodes), "node", "left")
    shown = F.lit(True) if unrooted else (F.col("kind") == "root") & (F.col("end_id") == root)
    return joined.select(
        F.col("node").alias("node_id"),
        "kind",
        F.col("end_id").alias("root_id"),
        "depth",
        F.when(shown, F.coalesce("n", F.lit(0))).alias("n_descendants"),
        F.when(shown, F.col("path")).alias("path"),
    )


def all_descendants(rows: DataFrame, node: str, parent: str, root: int = 0, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(node_id, descendant_id) of every node, whether or not its chain reaches `root`."""
    tree = solve(cut_lineage(links_of(rows, node, parent)), (root,), block_nodes)
    found = cut_lineage(paths(tree, (root,), block_nodes))
    return descendants(found, tree.ends).select(F.col("node").alias("node_id"), F.col("descendant").alias("descendant_id"))


def hierarchy_faults(states: DataFrame, closure: DataFrame, root: int = 0, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """Distinct (kind, node_id, ref_id, depth): nodes on cycles, below cycles and detached, and closure rows that the tree contradicts.

    A closure row (lineage_name, lineage_id) is `foreign_lineage` if its member is neither the lineage's tip (the largest state of that lineage_name)
    nor an ancestor of it nor `root`, both reaching `root`. Closure rows with nulls, without tip or whose ends do not reach `root` are no cases.
    """
    tree = solve(cut_lineage(links_of(states, "state_id", "parent_state_id")), (root,), block_nodes)
    labels = {"cycle": "cycle", "below": "below_cycle", "detached": "detached"}
    faults = tree.ends.filter(F.col("kind").isin(*labels)).select(
        F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in labels.items()]).alias("kind"), F.col("node").alias("node_id"), F.col("end_id").alias("ref_id"), "depth"
    )
    tips = states.filter("lineage_name is not null and state_id is not null").groupBy("lineage_name").agg(F.max("state_id").alias("low"))
    reach = tree.ends.filter((F.col("kind") == "root") & (F.col("end_id") == root)).select("node", "depth")
    tips = tips.join(reach.select(F.col("node").alias("low"), F.col("depth").alias("low_depth")), "low")
    pairs = closure.filter("lineage_name is not null and lineage_id is not null").select("lineage_name", F.col("lineage_id").alias("high")).distinct()
    pairs = pairs.filter(F.col("high") != root).join(tips, "lineage_name").filter("high <> low")
    pairs = pairs.join(reach.select(F.col("node").alias("high"), F.col("depth").alias("high_depth")), "high")
    tested = are_ancestors(pairs, tree).filter("not above")
    foreign = tested.select(F.lit("foreign_lineage").alias("kind"), F.col("lineage_name").alias("node_id"), F.col("high").alias("ref_id"), F.col("high_depth").alias("depth"))
    return faults.unionByName(foreign)
