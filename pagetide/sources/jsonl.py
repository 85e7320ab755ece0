"""JSON Lines input that tolerates broken lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.functions.text import strip

STRICT = {"allowSingleQuotes": "false", "maxStringLen": "2147483647"}
FIELDS = ("url", "title", "markdown_content")


def read_entries(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(entries, skipped lines with a reason). Other columns, such as an order column, pass through.

    A line counts only if it is one whole JSON object with the key markdown_content; its value may be null. Text after
    the object breaks one of the two wrappings in which the line is parsed.
    """
    text = strip(F.col(line))
    in_list = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", STRICT)
    in_object = F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), "x map<string,string>", STRICT)
    rest = [c for c in lines.columns if c != line]
    parsed = lines.withColumn("_n", F.size(in_list)).withColumn("_o", in_object["x"])
    first_char = F.substring(text, 1, 1)
    reason = (
        F.when(F.coalesce(F.col("_n"), F.lit(0)) != 1, "invalid json")
        .when(F.col("_o").isNull(), F.when(first_char == "{", "invalid json").otherwise("not an object"))
        .when(~F.map_contains_key("_o", "markdown_content"), "no markdown_content")
    )
    checked = parsed.withColumn("reason", reason)
    good = checked.filter("reason IS NULL").select(*rest, *(_latest(f).alias(f) for f in FIELDS))
    return good, checked.filter("reason IS NOT NULL").drop("_n", "_o")


def _latest(field: str):
    """The value of a key; of equal keys the last one counts."""
    same = F.filter(F.map_entries("_o"), lambda e: e["key"] == field)
    return F.get(same, F.size(same) - 1)["value"]
