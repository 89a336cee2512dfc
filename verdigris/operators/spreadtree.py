"""The state tree as a table, for any number of states: the sets of states that reads, merging and compaction need, by forests of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators.hierarchy import BLOCK_NODES, Forest, Hierarchy, _ended, _rows_of, are_ancestors, chains_of, links_of, solve
from verdigris.session import cut_lineage

ROOT = 0


class BrokenLineageError(ValueError):
    code = "BROKEN_LINEAGE"


class SpreadTree:
    """What StateTree has, with tables (state) in place of lists and sets. Chains of states that cycle or lead nowhere never reach the root."""

    def __init__(self, states: DataFrame, block_nodes: int = BLOCK_NODES):
        self.links = cut_lineage(links_of(states, "state_id", "parent_state_id"))
        self._most, self._solved = block_nodes, None

    @property
    def solved(self) -> Hierarchy:
        if self._solved is None:
            self._solved = solve(self.links, (ROOT,), self._most)
        return self._solved

    @property
    def rooted(self) -> DataFrame:
        """(node, depth) of the states whose chain reaches the root, by it or a state without parent; without the root."""
        return self.solved.ends.filter((F.col("kind") == "root") & (F.col("node") != ROOT)).select("node", (F.col("depth") + (F.col("end_id") != ROOT).cast("long")).alias("depth"))

    def _tips(self, tips) -> DataFrame:
        """(node) of tips, a table (state) or numbers."""
        if isinstance(tips, DataFrame):
            return tips.select(F.col("state").alias("node")).filter(F.col("node").isNotNull() & (F.col("node") != ROOT)).distinct()
        return self.links.sparkSession.createDataFrame([(int(t),) for t in {*tips} if t is not None and t != ROOT], "node long")

    def walk(self, tip: int | None) -> DataFrame:
        """(state) of the tip and its ancestors without the root; a missing state or a cycle raises."""
        found = cut_lineage(self.reachable([tip]))
        if tip is not None and tip != ROOT:
            last = self.links.join(found.select(F.col("state").alias("node")), "node").filter(F.col("parent").isNull() | (F.col("parent") == ROOT))
            if last.isEmpty():
                raise BrokenLineageError(f"the chain of state {tip} breaks")
        return found

    def states_in_range(self, tip: int, ancestor: int) -> DataFrame:
        """(state) of the walk above `ancestor` and up to `tip`."""
        return self.walk(tip).filter((F.col("state") > ancestor) & (F.col("state") <= tip))

    def common_ancestor(self, child: int, parent: int) -> int:
        """The largest state that both walks share, else the root."""
        shared = self.walk(child).join(self.walk(parent), "state", "left_semi").agg(F.max("state")).first()[0]
        return ROOT if shared is None else int(shared)

    def reachable(self, tips) -> DataFrame:
        """(state) of all states on the chain of some tip; tips that are no states are left out."""
        return chains_of(self.links, self._tips(tips), ROOT, self._most).select(F.col("node").alias("state"))

    def unreachable(self, tips) -> DataFrame:
        every = self.links.filter(F.col("node") != ROOT).select(F.col("node").alias("state"))
        return every.join(self.reachable(tips), "state", "left_anti")

    def branches(self, locked) -> DataFrame:
        """(state) of the locked states with all their ancestors, without the root, and descendants."""
        # A lock of the root is one of all states.
        tips = cut_lineage(self.links.select("node").join(locked.select(F.col("state").alias("node")), "node", "left_semi"))
        marked = self.links.join(tips.withColumn("hit", F.lit(True)), "node", "left")
        ends = Forest(_rows_of(marked, _ended((ROOT,)) | F.col("hit").isNotNull(), F.when(F.col("hit"), F.lit("hit")).otherwise(F.lit("root"))), self._most).ends()
        below = ends.filter("kind = 'hit'").select(F.col("node").alias("state"))
        return below.unionByName(self.reachable(tips.select(F.col("node").alias("state")))).filter(F.col("state") != ROOT).distinct()

    def prefix(self, tips) -> DataFrame:
        """(state) of the states on the walk of every distinct tip; a tip at or off the root leaves none."""
        every = tips.select("state").filter("state is not null").distinct() if isinstance(tips, DataFrame) else self.links.sparkSession.createDataFrame([(int(t),) for t in {*tips}], "state long")
        n_tips = every.count()
        rows = self.links.join(self.rooted.select("node"), "node", "left_semi")
        counted = rows.join(every.select(F.col("state").alias("node"), F.lit(1).cast("long").alias("own")), "node", "left").select("node", F.coalesce("own", F.lit(0).cast("long")).alias("own"))
        sums = Forest(_rows_of(rows, _ended((ROOT,)) | (F.col("parent") == ROOT)), self._most).subtree_sizes(counted)
        return sums.filter((F.col("n") == n_tips) & (F.col("n") > 0)).select(F.col("node").alias("state"))

    def collapse_pairs(self, tips, locked: DataFrame) -> DataFrame:
        """(state, anchor) of the states that go: neither they nor their parents are the root, a tip, locked or a branch point."""
        fixed = self._tips(tips).union(locked.select("state")).union(self.links.groupBy("parent").agg(F.count_if(F.col("node") != ROOT).alias("c")).filter("c >= 2").select("parent"))
        fixed = fixed.union(self.links.sparkSession.createDataFrame([(ROOT,)], "node long")).distinct()
        own, above = fixed.select("node", F.lit(True).alias("stays")), fixed.select(F.col("node").alias("parent"), F.lit(True).alias("below_stays"))
        marked = self.links.join(self.rooted.select("node"), "node", "left_semi").join(own, "node", "left").join(above, "parent", "left")
        stays = F.col("stays").isNotNull() | F.col("below_stays").isNotNull() | F.col("parent").isNull()
        ends = Forest(_rows_of(cut_lineage(marked), stays), self._most).ends()
        return ends.filter("depth > 0").select(F.col("node").alias("state"), F.col("end_id").alias("anchor"))

    def without(self, gone: DataFrame) -> SpreadTree:
        """The tree without these states."""
        kept = self.links.join(gone.select(F.col("state").alias("node")), "node", "left_anti")
        return SpreadTree(kept.select(F.col("node").alias("state_id"), F.col("parent").alias("parent_state_id")), self._most)

    def census(self, states: DataFrame, lineages: DataFrame, versions: DataFrame) -> DataFrame:
        """(owner, name, n_over, n_under) of the versions whose tip reaches the root: members of its closure up to the tip that are not on its walk, and
        states of the walk that the closure lacks. Members are tested one by one, so no walk is written out.
        """
        depth = self.rooted
        named = states.select("state_id", "lineage_name").distinct()
        tips = versions.filter("state_id is not null").select("owner", "name", F.col("state_id").alias("low")).join(named.withColumnRenamed("state_id", "low"), "low")
        tips = tips.join(depth.select(F.col("node").alias("low"), F.col("depth").alias("low_depth")), "low")
        stored = tips.join(lineages.select("lineage_name", F.col("lineage_id").alias("high")).distinct(), "lineage_name").filter((F.col("high") <= F.col("low")) & (F.col("high") != ROOT))
        # Versions at one state share its tests.
        pairs = stored.select("low", "low_depth", "high").distinct().join(depth.select(F.col("node").alias("high"), F.col("depth").alias("high_depth")), "high")
        tested = are_ancestors(pairs, self.solved).filter("above").select("low", "high", F.lit(True).alias("above"))
        counted = stored.join(tested, ["low", "high"], "left").groupBy("owner", "name").agg(F.count_if(F.col("above").isNull()).alias("n_over"), F.count_if(F.col("above").isNotNull()).alias("n_in"))
        found = tips.select("owner", "name", "low_depth").join(counted, ["owner", "name"], "left")
        return found.select("owner", "name", F.coalesce("n_over", F.lit(0)).alias("n_over"), (F.col("low_depth") - F.coalesce("n_in", F.lit(0))).alias("n_under"))
