"""Joins and ordered scans that stay balanced when a single key holds a large share of the rows.

A heavy-hitter sketch names the few keys that matter. Only those keys are split; every other key takes the
plain path, so data without hot keys pays one pass over one narrow column and nothing else.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARE = 1_000  # a key is hot when it holds more than 1/SHARE of the rows, so there are fewer than SHARE hot keys
TRACKED = 10_000  # counters of the sketch; it misses no key above about 2/TRACKED of the rows
SALTS = 256  # pieces one hot key is cut into
SMALLEST = 100_000  # below this many rows for a key one task copes
SKETCHES = 256  # groups whose sketches are merged before the last task merges one sketch of each


@dataclass(frozen=True)
class Hot:
    """Hot values of one key column. At most SHARE of them, by construction."""

    keys: tuple = ()

    def has(self, col: Column) -> Column:
        if not self.keys:
            return F.lit(False)
        return F.coalesce(col.isin(*self.keys), F.lit(False))


def hot_keys(df: DataFrame, key: str | Column, smallest: int | None = None) -> Hot:
    """Keys that hold more than 1/SHARE of the rows and more than `smallest` rows (SMALLEST if not given).

    Each task of the input makes one sketch. They are merged in two levels, so that with n tasks no task merges more
    than max(SKETCHES, n / SKETCHES) of them.
    """
    col = F.col(key) if isinstance(key, str) else key
    groups = (
        df.select(col.alias("k"))
        .filter("k IS NOT NULL")
        .groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCHES)).alias("g"))
        .agg(F.expr(f"approx_top_k_accumulate(k, {TRACKED})").alias("sketch"), F.count("*").alias("n"))
    )
    merged = F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {TRACKED}), {SHARE})")
    # grouped by a constant: sketches of no rows at all cannot be combined
    row = groups.groupBy(F.lit("all")).agg(merged.alias("top"), F.sum("n").alias("n")).first()
    if row is None:
        return Hot()
    floor = max(SMALLEST if smallest is None else smallest, row["n"] // SHARE)
    return Hot(tuple(sorted(t["item"] for t in row["top"] or [] if t["count"] > floor)))


def spread_join(
    left: DataFrame, right: DataFrame, on: str, how: str, hot: Hot, spread_by: str | Column
) -> DataFrame:
    """left JOIN right ON one key, where the right side has one row per key.

    Rows of a hot key are spread over SALTS pieces by `spread_by`; the one matching right row is repeated for each
    piece. At most SHARE * SALTS right rows are added. `how` must not keep unmatched right rows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} is not a left-preserving join")
    if not hot.keys:
        return left.join(right, on, how)
    by = F.col(spread_by) if isinstance(spread_by, str) else spread_by
    piece = F.when(hot.has(F.col(on)), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    pieces = F.when(hot.has(F.col(on)), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = left.withColumn("_piece", piece)
    fanned = right.withColumn("_piece", F.explode(pieces))
    return salted.join(fanned, [on, "_piece"], how).drop("_piece")


class KeyedOrder:
    """Rows of each key in order, for looking at the row before and for running totals.

    A plain window sends all rows of one key to one task. For hot keys the order is cut into pieces of about
    equal size at quantiles of the order column; each piece is scanned on its own and gets what the pieces before
    it contribute from a table with at most SHARE * SALTS rows.
    """

    def __init__(self, df: DataFrame, key: str, order: str, hot: Hot):
        self.key, self.order, self.hot = key, order, hot
        if not hot.keys:
            self.df = df.withColumn("_blk", F.lit(0))
            return
        # one row per hot key, each with at most SALTS bounds
        bounds = (
            df.filter(hot.has(F.col(key)))
            .groupBy(key)
            .agg(F.percentile_approx(order, [i / SALTS for i in range(1, SALTS)], 10_000).alias("_bounds"))
        )
        # two levels, so that a row is compared with about 2 * sqrt(SALTS) bounds
        width = math.isqrt(SALTS) + 1
        rows = []
        for value, cuts in bounds.collect():
            fine = [cuts[i : i + width] for i in range(0, len(cuts), width)]
            rows.append((value, [group[-1] for group in fine], fine + [[]]))
        key_type, cut_type = bounds.schema[key].dataType, bounds.schema["_bounds"].dataType
        schema = T.StructType().add(key, key_type).add("_coarse", cut_type).add("_fine", T.ArrayType(cut_type))
        small = df.sparkSession.createDataFrame(rows, schema)
        passed = lambda cuts: F.size(F.filter(cuts, lambda cut: cut <= F.col(order)))
        self.df = (
            df.join(F.broadcast(small), key, "left")
            .withColumn("_group", passed(F.col("_coarse")))
            .withColumn(
                "_blk",
                F.when(F.col("_coarse").isNull(), 0).otherwise(
                    F.col("_group") * width + passed(F.element_at("_fine", F.col("_group") + 1))
                ),
            )
            .drop("_coarse", "_fine", "_group")
        )

    def _scan(self, name: str, value: Column, fold, summary: Column, merge, upto: int) -> KeyedOrder:
        """Add `name`: `fold` of `value` over the rows of the key up to this one (upto=0) or before it (upto=-1)."""
        start = Window.unboundedPreceding
        local = fold(value).over(
            Window.partitionBy(self.key, "_blk").orderBy(self.order).rowsBetween(start, upto)
        )
        if not self.hot.keys:
            return self._with(self.df.withColumn(name, local))
        # what all earlier pieces of the same key contribute: at most SHARE * SALTS rows
        pieces = Window.partitionBy(self.key).orderBy("_blk").rowsBetween(start, -1)
        carry = (
            self.df.filter(self.hot.has(F.col(self.key)))
            .groupBy(self.key, "_blk")
            .agg(summary.alias("_sum"))
            .select(self.key, "_blk", fold(F.col("_sum")).over(pieces).alias("_carry"))
        )
        joined = self.df.withColumn("_local", local).join(F.broadcast(carry), [self.key, "_blk"], "left")
        return self._with(joined.withColumn(name, merge(F.col("_local"), F.col("_carry"))).drop("_local", "_carry"))

    def before(self, value: Column, name: str, when: Column | None = None) -> KeyedOrder:
        """Add `name`: the value of the nearest earlier row of the key (for which `when` holds), or NULL."""
        held = value if when is None else F.when(when, value)
        latest = F.max_by(held, F.when(held.isNotNull(), F.col(self.order)))
        return self._scan(name, held, lambda c: F.last(c, ignorenulls=True), latest, F.coalesce, -1)

    def max_before(self, value: Column, name: str) -> KeyedOrder:
        """Add `name`: the largest value of the earlier rows of the key, or NULL."""
        return self._scan(name, value, F.max, F.max(value), F.greatest, -1)

    def running_sum(self, value: Column, name: str) -> KeyedOrder:
        """Add `name`: the sum of `value` over this row and the earlier rows of the key."""
        total = lambda local, carry: local + F.coalesce(carry, F.lit(0))
        return self._scan(name, value, F.sum, F.sum(value), total, 0)

    def _with(self, df: DataFrame) -> KeyedOrder:
        other = object.__new__(KeyedOrder)
        other.key, other.order, other.hot, other.df = self.key, self.order, self.hot, df
        return other

    def rows(self) -> DataFrame:
        return self.df.drop("_blk")
