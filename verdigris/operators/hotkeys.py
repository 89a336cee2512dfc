"""Counts per key where a few keys hold most rows: dense accumulator arrays instead of groups.

Every input split, whose size has nothing to do with its keys, encodes its keys by a dictionary of its own and adds up an array over the codes by
bincount. The keys are cut into blocks by a hash; the split sends its array block by block, as sorted keys with their counts. A block's arrays are
summed in two rounds, by scattering them onto the dictionary of the block. So no task ever sees the rows of a key together, no task or driver holds the
whole dictionary, and any number of keys is counted in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.session import shuffle_partitions

#: Keys that a block of the accumulator arrays holds on average.
BLOCK_KEYS = 4096
#: Keys that a split holds at once; it then sends its arrays and begins new ones.
SPLIT_KEYS = 1_000_000
#: Least number of groups into which the arrays of all splits are first summed.
FAN_IN = 32
_BLOCKS = "block int, part int, keys array<long>, counts array<long>"
#: Fixed value: an odd multiplier that spreads neighbouring keys.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return (((keys.astype(np.uint64) * _SPREAD) >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)


def _scattered(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The dictionary of `keys` in ascending order and the sums of `counts` over its codes."""
    dictionary, codes = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(dictionary), dtype=np.int64)
    np.add.at(sums, codes, counts)
    return dictionary, sums


def _arrays(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The dictionary and accumulator array of a split, several if it has more than `most` keys."""
    keys, totals = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for batch in batches:
        values = batch.column(0).to_numpy()
        if not len(values):
            continue
        codes = np.minimum(np.searchsorted(keys, values), max(len(keys) - 1, 0))
        known = keys[codes] == values if len(keys) else np.zeros(len(values), dtype=bool)
        if known.any():
            totals += np.bincount(codes[known], minlength=len(keys))
        if not known.all():
            more, counts = np.unique(values[~known], return_counts=True)
            keys, totals = _scattered(np.concatenate([keys, more]), np.concatenate([totals, counts]))
            if len(keys) > most:
                yield keys, totals
                keys, totals = keys[:0], totals[:0]
    if len(keys):
        yield keys, totals


def _row(block: int, part: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    ends = pa.array([0, len(keys)], pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int64())) for v in (keys, counts)]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), *lists], names=["block", "part", "keys", "counts"])


def _flat(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(group.column(c).combine_chunks().flatten().to_numpy() for c in ("keys", "counts"))


def dense_counts(rows: DataFrame, key: str, n_keys: int, block_keys: int = BLOCK_KEYS, split_keys: int = SPLIT_KEYS) -> DataFrame:
    """(key, n): the number of rows for each non-null key. `n_keys`, which may be rough, sets the number of blocks and nothing else."""
    keys = rows.select(F.col(key).cast("long").alias("key")).filter("key is not null")
    blocks = max(1, math.ceil(n_keys / block_keys))
    # As many groups as a group has arrays.
    fan_in = max(FAN_IN, math.isqrt(shuffle_partitions(rows.sparkSession)))

    def accumulate(batches):
        part = TaskContext.get().partitionId() % fan_in
        for own, totals in _arrays(batches, split_keys):
            block = _block_of(own, blocks)
            order = np.argsort(block, kind="stable")
            starts = np.flatnonzero(np.diff(block[order], prepend=-1))
            for at in np.split(order, starts[1:]):
                yield _row(block[at[0]], part, own[at], totals[at])

    def add_up(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_row(group.column("block")[0].as_py(), group.column("part")[0].as_py(), *_scattered(*_flat(group)))])

    def decode(group: pa.Table) -> pa.Table:
        dictionary, sums = _scattered(*_flat(group))
        return pa.table([pa.array(dictionary), pa.array(sums)], names=["key", "n"])

    arrays = keys.mapInArrow(accumulate, _BLOCKS)
    halves = arrays.groupBy("block", "part").applyInArrow(add_up, _BLOCKS)
    return halves.groupBy("block").applyInArrow(decode, "key long, n long")


def _rough_keys(rows: DataFrame, key: str) -> tuple[int, int]:
    """(all rows, distinct keys about)."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.col(key)).alias("keys")).first()
    return found.n, found["keys"]


def key_counts(rows: DataFrame, key: str, counted: str, **sizes) -> DataFrame:
    """(key_id, n_rows, n_distinct) of every non-null key: all its rows, and its distinct non-null values of `counted`.

    Distinct pairs are spread by key and value, so a hot key's values are on all tasks; their number is again a dense count. Empty input: no rows.
    """
    _, n_keys = _rough_keys(rows, key)
    return _joined(rows, key, counted, dense_counts(rows, key, n_keys, **sizes), n_keys, sizes)


def heavy_key_counts(rows: DataFrame, key: str, counted: str, parts: int = 200, **sizes) -> DataFrame:
    """The key_counts of the keys that hold at least 1/`parts` of all rows, of which there are at most `parts`.

    Rows with a null key count among all rows. Distinct values are gathered for these keys only.
    """
    total, n_keys = _rough_keys(rows, key)
    heavy = dense_counts(rows, key, n_keys, **sizes).filter(F.col("n") * parts >= total).toPandas().astype("int64")
    spark = rows.sparkSession
    counts = spark.createDataFrame(heavy, "key long, n long") if len(heavy) else spark.createDataFrame([], "key long, n long")
    chosen = rows.filter(F.col(key).isin(sorted(heavy.key.tolist()))) if len(heavy) else rows.limit(0)
    return _joined(chosen, key, counted, counts, len(heavy), sizes)


def _joined(rows: DataFrame, key: str, counted: str, counts: DataFrame, n_keys: int, sizes: dict) -> DataFrame:
    pairs = rows.select(F.col(key).alias("pair_key"), F.col(counted).alias("pair_value")).filter("pair_key is not null and pair_value is not null").distinct()
    distinct = dense_counts(pairs, "pair_key", n_keys, **sizes).withColumnRenamed("n", "n_distinct")
    return counts.join(distinct, "key", "left").select(
        F.col("key").alias("key_id"), F.col("n").alias("n_rows"), F.coalesce("n_distinct", F.lit(0).cast("long")).alias("n_distinct")
    )
