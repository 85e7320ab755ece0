"""Combined Markdown documents.

A combined document is the ordered list of its pieces, one per entry: the first piece of a group starts with the
header, every other one with the separator. Joining the pieces of a group in order gives the document, and no task
ever holds a whole one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.config import Combine
from pagetide.operators.skew import hot_keys, spread_join


def render_entry(title: Column, url: Column, markdown: Column, combine: Combine = Combine()) -> Column:
    """Title, source line and Markdown text of one page."""
    return F.concat(
        F.lit("# "),
        F.coalesce(title, F.lit(combine.title_default)),
        F.lit("\n\n*Source: "),
        F.coalesce(url, F.lit(combine.url_default)),
        F.lit("*\n\n"),
        F.coalesce(markdown, F.lit("")),
        F.lit("\n"),
    )


def combine_entries(
    entries: DataFrame, generated_at: str, group: str, order: str = "seq", combine: Combine = Combine()
) -> DataFrame:
    """Pieces (group, order, piece) of one combined document per group, from title, url and markdown_content.

    `order` must be unique within a group.
    """
    totals = entries.groupBy(group).agg(F.min(order).alias("_first"), F.count("*").alias("_total"))
    rows = entries.select(
        group, order, render_entry(F.col("title"), F.col("url"), F.col("markdown_content"), combine).alias("_entry")
    )
    with_totals = spread_join(rows, totals, group, "inner", hot_keys(entries, group), order)
    header = F.concat(
        F.lit(f"# {combine.heading}\n*Generated on: {generated_at}*\n*Total entries: "),
        F.col("_total").cast("string"),
        F.lit("*\n\n"),
    )
    lead = F.when(F.col(order) == F.col("_first"), header).otherwise(F.lit(combine.separator))
    return with_totals.select(group, order, F.concat(lead, "_entry").alias("piece"))


def entry_counts(entries: DataFrame, group: str) -> DataFrame:
    """Number of entries per group."""
    return entries.groupBy(group).agg(F.count("*").alias("n_entries"))
