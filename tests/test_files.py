"""Files with exact names and bytes, byte ranges, and lines in order."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pagetide.config import Chunk, Pack
from pagetide.operators import chunks, combine, packing
from pagetide.sources import files, sinks
from pagetide.sources.jsonl import read_entries

SPLITS = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get(SPLITS)
    spark.conf.set(SPLITS, "4096")
    yield
    spark.conf.set(SPLITS, old)


def test_lines_keep_their_order_over_splits(spark, small_splits, tmp_path):
    rng = random.Random(2)
    expected = []
    for name in ("a_2.txt", "a_10.txt", "b_1.txt", "a 3.txt", "empty.txt", "ü%.txt"):
        lines = ["é" * rng.choice([0, 1, 30, 3000]) + str(i) * rng.randrange(2) for i in range(0 if name == "empty.txt" else 200)]
        (tmp_path / name).write_text("".join(x + "\n" for x in lines) if name != "b_1.txt" else "\r\n".join(lines))
        expected += [(name, i, x) for i, x in enumerate(lines, 1)]
    while expected and expected[-1][2] == "":
        expected.pop()
    got = files.read_lines(spark, str(tmp_path)).withColumn("file", files.file_name(F.col("file"))).collect()
    found = {(r["file"], r["line"], r["value"]) for r in got}
    # an empty last line without a line feed is no line
    assert {x for x in expected if x[2] or x[1] < 200} <= found <= set(expected)
    ordered = sorted(got, key=lambda r: r["seq"])
    assert [r["seq"] for r in ordered] == list(range(1, len(got) + 1))
    names = list(dict.fromkeys(r["file"] for r in ordered))
    assert names == ["ü%.txt", "a 3.txt", "a_2.txt", "b_1.txt", "a_10.txt"]
    assert all(a["line"] + 1 == b["line"] for a, b in zip(ordered, ordered[1:]) if a["file"] == b["file"])


def test_shard_files_round_trip(spark, small_splits, tmp_path):
    rng = random.Random(3)
    rows = [(i * 2, "x" * rng.choice([0, 5, 200, 900])) for i in range(400)]
    lines = spark.createDataFrame(rows, "seq long, value string").repartition(5)
    pack = Pack(max_bytes=5_000, prefix="out", rows_per_block=50)
    assigned = packing.assign_shards(lines.select("seq", packing.line_bytes(F.col("value")).alias("nbytes")), pack)
    sinks.write_shard_files(lines, assigned, str(tmp_path / "f"), pack)
    manifest = {f"out_{r['shard']}.jsonl": r["nbytes"] for r in packing.shard_manifest(assigned).collect() if r["n_rows"]}
    assert {n: os.path.getsize(tmp_path / "f" / n) for n in os.listdir(tmp_path / "f") if not n.startswith(".")} == manifest
    again = files.read_lines(spark, str(tmp_path / "f")).orderBy("seq").collect()
    assert [r["value"] for r in again] == [v for _, v in rows]


def test_combined_files_and_byte_ranges(spark, hot_mode, tmp_path):
    rng = random.Random(4)
    rows = [(i, "big" if i % 4 else f"g{i % 3}", f"t{i}", None, "é\n" * rng.choice([0, 3, 400])) for i in range(120)]
    entries = spark.createDataFrame(rows, "seq long, site string, title string, url string, markdown_content string").repartition(4)
    pieces = combine.combine_entries(entries, "now", "site")
    sinks.write_combined_files(pieces, str(tmp_path), "site")
    text = {}
    for r in sorted(pieces.collect(), key=lambda r: r["seq"]):
        text[r["site"] + ".md"] = text.get(r["site"] + ".md", b"") + r["piece"].encode()
    assert {n: (tmp_path / n).read_bytes() for n in text} == text
    # ranges of files give the chunks of a table that holds the files
    whole = spark.createDataFrame([(k, bytearray(v)) for k, v in text.items()], "file string, body binary")
    chunk = Chunk(bytes=700, prefix="p%_")
    cut = files.read_chunks(spark, str(tmp_path), chunk, split=3_000)
    order = lambda df: sorted((r["file"], r["part"], r["name"], bytes(r["bytes"])) for r in df.collect())
    assert order(cut) == order(chunks.byte_chunks(whole, chunk, "file"))
    assert cut.rdd.getNumPartitions() > len(text)
    sinks.write_chunk_files(cut, str(tmp_path / "cut"), "file")
    assert b"".join((tmp_path / "cut" / "big.md" / n).read_bytes() for n in sorted(os.listdir(tmp_path / "cut" / "big.md"))) == text["big.md"]
    assert order(files.read_chunks(spark, str(tmp_path / "nothing"), chunk)) == []


def test_writer_refuses_torn_files_and_odd_names(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([(f, a, bytearray(b)) for f, a, b in r], "file string, at long, bytes binary")
    with pytest.raises(Exception, match="overlap or are missing"):
        files.write_named(rows(("a", 0, b"xx"), ("a", 3, b"y")), str(tmp_path))
    for name in ("../a", "/a", ".a", "a//b"):
        with pytest.raises(Exception, match="no name of a file"):
            files.write_named(rows((name, 0, b"x")), str(tmp_path))
    assert not [f for f in os.listdir(tmp_path) if not f.startswith(".")]
    files.write_named(rows(("a", 1, b"y"), ("a", 0, b"x"), ("e", 0, b"")), str(tmp_path))
    files.write_named(rows(("a", 0, b"new")), str(tmp_path))
    assert (tmp_path / "a").read_bytes() == b"new" and (tmp_path / "e").read_bytes() == b""
    with pytest.raises(ValueError, match="mounted"):
        files.write_named(rows(("a", 0, b"x")), "s3a://bucket/x")


def test_entries_in_line_order(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"markdown_content": "1"}\nbroken\n{"markdown_content": "2", "title": "T"}\n')
    good, skipped = read_entries(files.read_lines(spark, str(tmp_path)).drop("file", "line"))
    assert [(r["seq"], r["markdown_content"]) for r in good.orderBy("seq").collect()] == [(1, "1"), (3, "2")]
    assert [(r["seq"], r["reason"]) for r in skipped.collect()] == [(2, "invalid json")]


def test_small_files_share_tasks(spark, tmp_path):
    data = {f"f{k:03d}": bytes([k % 256]) * (k % 40) for k in range(600)} | {"large": bytes(range(250)) * 4_000}
    for name, raw in data.items():
        (tmp_path / name).write_bytes(raw)
    read = files.read_chunks(spark, str(tmp_path), Chunk(bytes=16))
    assert read.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism + 4
    found = {(r["file"], r["part"]): bytes(r["bytes"]) for r in read.collect()}
    assert found == {(n, at // 16 + 1): raw[at : at + 16] for n, raw in data.items() for at in range(0, len(raw), 16)}
