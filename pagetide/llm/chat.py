"""Chat formatting: logged snapshots of a growing conversation collapse into the longest one, which is rendered.

A chat log often holds the same conversation after each turn. The prefix of a conversation up to a turn is identified
by rolling hashes: running sums of hashes of (position, role, text), kept in four 32-bit lanes. A conversation whose
last prefix hash occurs inside a longer conversation is a snapshot of it; an anti-join leaves the maximal ones. Of
identical conversations the smallest conv_id stays.

Rows are sorted once over the whole table, in ranges of about equal size, so a conversation with very many turns
lies in several ranges; sums are taken inside each range and carried over from a table with a row for each
conversation and range. Long conversations are rendered in parts of PART turns, so no row gathers an unbounded group.

Defined results: rows that are equal in all four columns are one turn. Turns are ordered by turn (nulls last), role and
text. A null role is "unknown", a null text is empty, rows with a null conv_id form one conversation. A "<|" in a text
becomes "< |", so texts cannot forge marks. An empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetide.session import stage

PART = 1024
LANES = ("s0", "s1", "s2", "s3")


def _ordered_turns(turns: DataFrame) -> DataFrame:
    """Distinct turns with `at`, their place in the order of the whole table, and `pid`, the range they lie in."""
    clean = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", "text"]
    placed = clean.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(
        placed.select("*", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("pid")), "turns"
    )


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, at, pos (from 1) and the lanes of the prefix that ends with this turn; `last` marks the end."""
    ranges = turns.groupBy("conv_id", "pid").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    ranges = ranges.select(
        F.col("conv_id").alias("c"), F.col("pid").alias("p"), "first",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("length"),
    )
    numbered = turns.join(ranges, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pid") == F.col("p"))).withColumn(
        "pos", F.col("at") - F.col("first") + F.col("before") + 1
    )
    halves = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), "pos", "role", "text")
        halves += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    hashed = stage(
        numbered.select("conv_id", "pid", "at", "pos", "length", *(h.alias(f"h{i}") for i, h in enumerate(halves))), "hashed"
    )
    inside = Window.partitionBy("conv_id", "pid").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    sums = hashed.groupBy("conv_id", "pid").agg(*(F.sum(f"h{i}").alias(f"t{i}") for i in range(4)))
    carry = sums.select(
        F.col("conv_id").alias("c"), F.col("pid").alias("p"),
        *(F.coalesce(F.sum(f"t{i}").over(earlier), F.lit(0)).alias(f"c{i}") for i in range(4)),
    )
    running = hashed.select("conv_id", "pid", "pos", "length", *(F.sum(f"h{i}").over(inside).alias(f"r{i}") for i in range(4)))
    return running.join(carry, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pid") == F.col("p"))).select(
        "conv_id", "pos", (F.col("pos") == F.col("length")).alias("last"),
        *((F.col(f"r{i}") + F.col(f"c{i}")).alias(f"s{i}") for i in range(4)),
    )


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id, length, copies: the conversations that are no prefix of a longer one, identical ones once."""
    ends = prefixes.filter("last").groupBy("pos", *LANES).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")
    )
    inner = prefixes.filter("NOT last").select("pos", *LANES).distinct()
    return ends.join(inner, ["pos", *LANES], "left_anti").select("conv_id", F.col("pos").alias("length"), "copies")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, part (from 0), n_turns (of the conversation), copies, text, for each maximal conversation."""
    turns = _ordered_turns(conversations)
    prefixes = stage(_prefixes(turns), "prefixes")
    kept = stage(maximal(prefixes), "maximal")
    piece = F.concat(
        F.lit("<|start|>"), F.replace("role", F.lit("<|"), F.lit("< |")), F.lit("\n"),
        F.replace("text", F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"),
    )
    per_range = turns.groupBy("conv_id", "pid").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    per_range = per_range.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    wanted = per_range.select(F.col("conv_id").alias("c"), "pid", "first", "before").join(
        kept, F.col("c").eqNullSafe(F.col("conv_id"))
    ).select("c", F.col("pid").alias("p"), "first", "before", "length", "copies")
    placed = turns.join(wanted, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pid") == F.col("p"))).select(
        "conv_id", (F.col("at") - F.col("first") + F.col("before")).alias("i"), "length", "copies", piece.alias("piece")
    )
    part = F.floor(F.col("i") / PART).cast("long")
    gathered = placed.groupBy("conv_id", part.alias("part")).agg(
        F.first("length").alias("n_turns"), F.first("copies").alias("copies"),
        F.sort_array(F.collect_list(F.struct("i", "piece"))).alias("pieces"),
    )
    return gathered.select("conv_id", "part", "n_turns", "copies", F.array_join("pieces.piece", "").alias("text"))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS LAST, role, text) AS l FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, count(*) AS copies, l FROM c GROUP BY l),
k AS (SELECT * FROM u WHERE NOT EXISTS (
  SELECT 1 FROM u v WHERE v.l[1] = u.l[1] AND len(v.l) > len(u.l) AND v.l[1:len(u.l)] = u.l)),
e AS (SELECT conv_id, copies, len(l) AS n_turns, unnest(l) AS x, unnest(range(len(l))) AS i FROM k)
SELECT conv_id, i // 1024 AS part, n_turns, copies, string_agg('<|start|>' || replace(x.r, '<|', '< |') || chr(10)
  || replace(x.t, '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY i) AS text
FROM e GROUP BY conv_id, part, n_turns, copies
"""
