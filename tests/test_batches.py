"""Python steps on pages take slices of Arrow batches, so that memory does not grow with the batches."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.functions.batches import ROWS, SIZE, slices
from pagetide.operators import markdown
from pagetide.operators.parse import parse_pages

PAGE = "<title>t{0}</title><body><main><p>{0}</p></main><a href='/{0}'>x</a>"


def test_slices_hold_all_rows_in_order():
    text = pa.array(["x" * (SIZE // 2), "y" * (SIZE // 2), "z", None, "", "w" * 3 * SIZE, *["v"] * (2 * ROWS)])
    assert list(slices(text)) == [(0, 2), (2, 3), (5, 1), (6, ROWS), (6 + ROWS, ROWS)]
    assert list(slices(text.slice(5))) == [(0, 1), (1, ROWS), (1 + ROWS, ROWS)]
    assert list(slices(text.slice(0, 0))) == []


class _Observations:
    """Stands for a frame whose step in Python is called here."""

    columns = ["seq", "page_url", "is_json", "body"]
    schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("page_url", T.StringType()), T.StructField("is_json", T.BooleanType()), T.StructField("body", T.StringType())])

    def mapInArrow(self, run, schema):
        return run


def test_a_large_batch_of_pages_is_parsed_in_slices():
    n = 4 * ROWS + 1
    rows = [pa.array(range(n)), pa.array(["http://h/"] * n), pa.array([k == 7 for k in range(n)]), pa.array([PAGE.format(k) for k in range(n)])]
    batch = pa.RecordBatch.from_arrays(rows, _Observations.columns)
    out = list(parse_pages(_Observations())(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in out) == ROWS
    found = pa.Table.from_batches(out).to_pydict()
    assert found["seq"] == list(range(n))
    assert found["title"] == ["" if k == 7 else f"t{k}" for k in range(n)]
    assert [x and x[0]["url"] for x in found["links"]] == [[] if k == 7 else f"http://h/{k}" for k in range(n)]


def test_a_large_batch_becomes_markdown_in_slices(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda f: steps.append(f) or (lambda *columns: F.lit("")))
    markdown.markdown_of(F.col("h"), F.col("u"))
    n = 2 * ROWS + 5
    pages = pa.array([None if k == 3 else f"<p><a href='/{k}'>a</a></p>" for k in range(n)])
    out = list(steps[0](iter([(pages, pa.array(["http://h/"] * n))])))
    assert max(map(len, out)) == ROWS
    assert [x for part in out for x in part.to_pylist()] == ["" if k == 3 else f"[a](<http://h/{k}>)" for k in range(n)]
