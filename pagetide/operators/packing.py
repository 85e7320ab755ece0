"""Size-bounded shards of an ordered table: a line opens a new shard when it would overfill the current one.

The rule is a left-to-right pass, yet it runs in parallel. Rows are range-partitioned into blocks. What a block does
depends only on the bytes already in the shard that is open when the block begins, so each block first states its
answer for every possible number of such bytes (a step function). The answers are then chained, `fan_in` blocks per
task and level, which gives every block its true start; with it each block numbers its own rows. Only sizes travel,
never text, and no task holds more than `fan_in` step functions or one block of sizes.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.config import Pack
from pagetide.session import stage

STEPS = "child BIGINT, total BIGINT, lows ARRAY<BIGINT>, cuts ARRAY<BIGINT>, outs ARRAY<BIGINT>"


def _next_cuts(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(running totals, for each row j the row that opens the next shard if one begins at j)."""
    ends = np.cumsum(sizes)
    after = np.searchsorted(ends, ends - sizes + limit, side="right")
    return ends, np.maximum(after, np.arange(1, len(sizes) + 1))


def _compact(lows, cuts, outs):
    """Drop steps that start where the next one starts, or that repeat the step before."""
    last = np.append(lows[1:] != lows[:-1], True)
    lows, cuts, outs = lows[last], cuts[last], outs[last]
    new = np.append(True, (cuts[1:] != cuts[:-1]) | (outs[1:] != outs[:-1]))
    return lows[new], cuts[new], outs[new]


def step_function(sizes: np.ndarray, limit: int):
    """(total, lows, cuts, outs) of a non-empty block. With c bytes open at its begin, the last step i with
    lows[i] <= c opens cuts[i] shards and leaves outs[i] bytes in the last one. Below lows[0] no shard is opened and
    c + total bytes are open at the end."""
    ends, nxt = _next_cuts(sizes, limit)
    n = len(sizes)
    jump, last = np.append(nxt, n), np.arange(n + 1)
    count = np.append(np.ones(n, np.int64), 0)
    while (jump < n).any():  # follow all chains at once, doubling the stride
        last = np.where(jump < n, last[jump], last)
        count = count + count[jump]
        jump = jump[jump]
    left_open = ends[-1] - (ends - sizes)[last[:n]]
    lows = np.maximum(limit - ends + 1, 0)  # row j overfills once that many bytes are open
    first = np.append(True, lows[1:] < lows[:-1])
    rows = np.flatnonzero(first)[::-1]
    return int(ends[-1]), *_compact(lows[rows], count[rows], left_open[rows])


def run_step(step, carry: int) -> tuple[int, int]:
    """(shards opened, bytes open afterwards) of a block that begins with `carry` bytes open."""
    total, lows, cuts, outs = step
    i = int(np.searchsorted(lows, carry, side="right")) - 1
    return (0, carry + total) if i < 0 else (int(cuts[i]), int(outs[i]))


def join_steps(f, g):
    """The step function of two neighbouring blocks."""
    total, lows, cuts, outs = f
    g_total, g_lows, g_cuts, g_outs = g
    at = np.searchsorted(g_lows, outs, side="right") - 1
    open_more, hit = at >= 0, np.maximum(at, 0)
    f_cuts = cuts + np.where(open_more, g_cuts[hit], 0)
    f_outs = np.where(open_more, g_outs[hit], outs + g_total)
    shifted = np.maximum(g_lows - total, 0)  # where f opens nothing, g sees c + total
    below = shifted < lows[0]
    joined = (np.append(shifted[below], lows), np.append(g_cuts[below], f_cuts), np.append(g_outs[below], f_outs))
    return total + g_total, *_compact(*joined)


def number_rows(sizes: np.ndarray, limit: int, carry: int, shard: int) -> np.ndarray:
    """Shard number of each row of a block that begins with `carry` bytes in shard `shard`."""
    ends, nxt = _next_cuts(sizes, limit)
    opens = np.zeros(len(sizes), np.int64)
    row = int(np.searchsorted(ends, limit - carry, side="right"))
    while row < len(sizes):
        opens[row] = 1
        row = int(nxt[row])
    return shard + np.cumsum(opens)


def _read_steps(table: pa.Table) -> list:
    """(child, step function) in block order."""
    rows = table.sort_by("child").to_pylist()
    vector = lambda v: np.array(v, np.int64)
    return [(r["child"], (r["total"], vector(r["lows"]), vector(r["cuts"]), vector(r["outs"]))) for r in rows]


def _steps_table(child: int, step) -> pa.Table:
    total, *arrays = step
    longs = pa.list_(pa.int64())
    columns = [pa.array([child], pa.int64()), pa.array([total], pa.int64())]
    columns += [pa.array([a.tolist()], longs) for a in arrays]
    return pa.Table.from_arrays(columns, names=["child", "total", "lows", "cuts", "outs"])


def assign_shards(rows: DataFrame, pack: Pack = Pack()) -> DataFrame:
    """Shard number (from 1) per row of (seq, nbytes), rows taken in `seq` order; seq must be unique."""
    limit, fan = pack.max_bytes, pack.fan_in
    sizes = stage(rows.select(F.col("seq").cast("bigint"), F.col("nbytes").cast("bigint")), "sizes")
    blocks = max(1, -(-sizes.count() // pack.rows_per_block))
    ranged = sizes.repartitionByRange(blocks, "seq") if blocks > 1 else sizes.coalesce(1)
    block = F.spark_partition_id().cast("bigint")
    ranged = stage(ranged.withColumn("block", block), "blocks")

    def state(key, table):
        ordered = table.sort_by("seq")
        return _steps_table(key[0].as_py(), step_function(ordered["nbytes"].to_numpy(), limit))

    def combine(key, table):
        (_, step), *rest = _read_steps(table)
        for _, other in rest:
            step = join_steps(step, other)
        return _steps_table(key[0].as_py(), step)

    def descend(key, table):
        carry, shard = table["carry"][0].as_py(), table["shard"][0].as_py()
        out = []
        for child, step in _read_steps(table):
            out.append((child, carry, shard))
            opened, carry = run_step(step, carry)
            shard += opened
        return pa.table(dict(zip(("child", "carry", "shard"), map(list, zip(*out)))))

    def number(key, left, right):
        ordered = left.sort_by("seq")
        start = (right["carry"][0].as_py(), right["shard"][0].as_py())
        shards = number_rows(ordered["nbytes"].to_numpy(), limit, *start)
        return pa.table({"seq": ordered["seq"], "nbytes": ordered["nbytes"], "shard": pa.array(shards)})

    levels = [stage(ranged.groupBy("block").applyInArrow(state, STEPS), "steps")]
    width = blocks
    while width > fan:
        width = -(-width // fan)
        above = levels[-1].groupBy((F.col("child") / fan).cast("bigint").alias("up")).applyInArrow(combine, STEPS)
        levels.append(stage(above, "steps"))
    start = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    grouped = levels.pop().withColumn("up", F.lit(0)).withColumn("carry", start[0]).withColumn("shard", start[1])
    while True:
        entries = grouped.groupBy("up").applyInArrow(descend, "child BIGINT, carry BIGINT, shard BIGINT")
        if not levels:
            break
        below = levels.pop().withColumn("up", (F.col("child") / fan).cast("bigint"))
        grouped = below.join(entries.withColumnRenamed("child", "up"), "up")
    entries = entries.withColumnRenamed("child", "block")
    return (
        ranged.groupBy("block")
        .cogroup(entries.groupBy("block"))
        .applyInArrow(number, "seq BIGINT, nbytes BIGINT, shard BIGINT")
    )


def line_bytes(line: Column) -> Column:
    """Bytes of a text line with its line feed."""
    return (F.octet_length(line) + 1).cast("bigint")


def shard_manifest(assigned: DataFrame) -> DataFrame:
    """Per shard: bytes, rows, first and last seq. Shard 1 is always there, empty if the first line overfills it."""
    lines = assigned.select("shard", "nbytes", F.lit(1).alias("line"), "seq")
    opened = assigned.sparkSession.range(1).selectExpr(
        "CAST(1 AS BIGINT) AS shard", "CAST(0 AS BIGINT) AS nbytes", "0 AS line", "CAST(NULL AS BIGINT) AS seq"
    )
    return (
        lines.unionByName(opened)
        .groupBy("shard")
        .agg(
            F.sum("nbytes").alias("nbytes"),
            F.sum("line").alias("n_rows"),
            F.min("seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
        )
    )
