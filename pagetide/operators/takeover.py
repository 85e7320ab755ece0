"""Which observations of a url are taken over when one must wait a while after another.

In the order of a url, an observation is taken over if it is made at least `wait` after the last one that was. That is a
walk, but its state is one time. Urls are walked side by side, as streams over sorted partitions. The rows of a hot url
are cut into blocks; a block first states, for any time of the last take-over before it, what that time is behind it. That is
a step function: the first row at or after time + wait is one of the block's rising maxima, and the chain from each
row on is followed once, backward. Chaining the functions of a url's blocks gives each its true start. So the number
of passes does not depend on how often a url is taken over.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.operators.skew import KeyedOrder

NEVER, UNTIMED = -(2**62), 2**62  # no take-over yet (the next row is one); a row without a time, which always is one


def steps(times: list[int], wait: int) -> tuple[list[int], list[int]]:
    """(times, ends) of a block: if the next take-over is due at T, the first i with T <= times[i] leads to ends[i].

    Beyond the last of `times` nothing is taken over.
    """
    n = len(times)
    ends = [0] * n
    rising: list[int] = []  # rows behind i that exceed all between, the nearest one last
    keys: list[int] = []  # their times with a minus sign, so that they ascend
    for i in range(n - 1, -1, -1):
        t = times[i]
        if t == UNTIMED:
            ends[i] = ends[i + 1] if i + 1 < n else NEVER
        else:
            # the nearest row at t + wait or later: the last one in `keys` that is not above -(t + wait)
            at = bisect_left(keys, -(t + wait) + 1) - 1
            ends[i] = ends[rising[at]] if at >= 0 else t
        while keys and -keys[-1] <= t:
            keys.pop()
            rising.pop()
        keys.append(-t)
        rising.append(i)
    out: tuple[list[int], list[int]] = ([], [])
    for i, key in zip(reversed(rising), reversed(keys), strict=True):
        if out[1] and out[1][-1] == ends[i]:
            out[0][-1] = -key
        else:
            out[0].append(-key)
            out[1].append(ends[i])
    return out


def after(state: int, wait: int, times: list[int], ends: list[int]) -> int:
    """The last take-over behind a block, from the one before it."""
    at = bisect_left(times, state + wait) if state != NEVER else 0
    return ends[at] if at < len(times) else state


def _micros(column: pa.Array, missing: int) -> list[int]:
    return column.cast(pa.int64()).fill_null(missing).to_pylist()


def _starts(hot_rows: DataFrame, key: str, order: str, at: str, wait: int) -> DataFrame:
    """The last take-over before each block: key, _blk, _start. At most as many rows as hot keys have blocks."""
    kind = hot_rows.schema[key].dataType.simpleString()

    def state(group_key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        ordered = group.sort_by(order)
        times, ends = steps(_micros(ordered[at], UNTIMED), wait)
        longs = pa.list_(pa.int64())
        return pa.table({
            key: pa.array([group_key[0].as_py()]), "_blk": pa.array([group_key[1].as_py()], pa.int32()),
            "_since": pa.array(_micros(ordered["_since"][:1], NEVER)), "times": pa.array([times], longs), "ends": pa.array([ends], longs),
        })

    def chain(group: pa.Table) -> pa.Table:
        ordered = group.sort_by("_blk")
        last, out = ordered["_since"][0].as_py(), []
        for times, ends in zip(ordered["times"].to_pylist(), ordered["ends"].to_pylist(), strict=True):
            out.append(last)
            last = after(last, wait, times, ends)
        return pa.table({key: ordered[key], "_blk": ordered["_blk"], "_start": pa.array(out, pa.int64())})

    blocks = hot_rows.select(key, "_blk", order, at, "_since").groupBy(key, "_blk").applyInArrow(
        state, f"{key} {kind}, _blk int, _since bigint, times array<bigint>, ends array<bigint>"
    )
    return blocks.groupBy(key).applyInArrow(chain, f"{key} {kind}, _blk int, _start bigint")


def take_over(rows: KeyedOrder, at: str, since: Column, wait: int, name: str) -> KeyedOrder:
    """Add the flag `name` to rows that are taken over: at least `wait` microseconds after the last one.

    `since` is when the key was taken over before these rows (NULL: never, so its first row is).
    """
    key, order = rows.key, rows.order
    df = rows.df.withColumn("_since", since).withColumn("_blk", F.col("_blk").cast("int"))
    if rows.hot.keys:
        # at most as many rows as there are blocks of hot keys
        starts = _starts(df.filter(rows.hot.has(F.col(key))), key, order, at, wait)
        df = df.join(F.broadcast(starts), [key, "_blk"], "left")
    else:
        df = df.withColumn("_start", F.lit(None).cast("bigint"))
    placed = df.repartition(key, "_blk").sortWithinPartitions(key, "_blk", order)
    schema = df.schema.add(name, "boolean")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, NEVER
        for batch in batches:
            taken = []
            times, since_, start = (_micros(batch.column(c), m) for c, m in ((at, UNTIMED), ("_since", NEVER), ("_start", UNTIMED)))
            keys, blocks = (batch.column(c).to_pylist() for c in (key, "_blk"))
            for k, b, t, s, own in zip(keys, blocks, times, since_, start, strict=True):
                if (k, b) != current:
                    current, last = (k, b), s if own == UNTIMED else own
                taken.append(last == NEVER or t >= last + wait)
                if taken[-1]:
                    last = NEVER if t == UNTIMED else t
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken, pa.bool_())], [*batch.schema.names, name])

    return rows._with(placed.mapInArrow(walk, schema).drop("_since", "_start"))
