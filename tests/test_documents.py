import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetide.config import Chunk, Combine, Pack
from pagetide.operators import packing
from pagetide.operators.chunks import byte_chunks
from pagetide.operators.combine import combine_entries, entry_counts
from pagetide.sources import sinks
from pagetide.sources.jsonl import read_entries


def next_fit(sizes, limit, used=0, shard=1):
    out = []
    for size in sizes:
        if used + size > limit:
            shard, used = shard + 1, 0
        out.append(shard)
        used += size
    return out, shard, used


def test_step_functions_equal_next_fit():
    rng = random.Random(3)
    for _ in range(1500):
        limit = rng.randint(1, 40)
        sizes = [rng.randint(rng.choice([0, 1]), rng.choice([5, 60])) for _ in range(rng.randint(1, 50))]
        if rng.random() < 0.2:
            sizes = [rng.randint(1, 10)] * len(sizes)
        at = sorted(rng.sample(range(1, len(sizes)), min(rng.randint(0, 5), len(sizes) - 1)))
        steps = [packing.step_function(p, limit) for p in np.split(np.array(sizes), at)]
        whole = steps[0]
        for step in steps[1:]:
            whole = packing.join_steps(whole, step)
        for carry in (0, rng.randint(0, limit), rng.randint(0, limit + 70)):
            labels, shard, used = next_fit(sizes, limit, carry)
            assert packing.run_step(whole, carry) == (shard - 1, used)
            assert packing.number_rows(np.array(sizes), limit, carry, 1).tolist() == labels


@pytest.mark.parametrize(
    "sizes, limit, pack",
    [
        ([7, 3, 3, 9, 1, 5, 5, 20, 1], 10, {}),
        ([50, 1, 2], 10, {}),
        ([10, 10], 10, {}),
        ([4], 10, {}),
        ([random.Random(1).randint(1, 90) for _ in range(400)], 300, {"rows_per_block": 9, "fan_in": 3}),
        ([10] * 200, 95, {"rows_per_block": 7, "fan_in": 2}),
    ],
)
def test_shards(spark, sizes, limit, pack):
    rows = spark.createDataFrame([(i * 5 - 7, n) for i, n in enumerate(sizes)], "seq bigint, nbytes bigint").repartition(3)
    assigned = packing.assign_shards(rows, Pack(max_bytes=limit, **pack))
    labels, last, _ = next_fit(sizes, limit)
    assert [r["shard"] for r in assigned.orderBy("seq").collect()] == labels
    manifest = {r["shard"]: (r["nbytes"], r["n_rows"]) for r in packing.shard_manifest(assigned).collect()}
    assert sorted(manifest) == list(range(1, last + 1))
    for shard, (nbytes, n_rows) in manifest.items():
        mine = [s for s, k in zip(sizes, labels) if k == shard]
        assert (nbytes, n_rows) == (sum(mine), len(mine))


def test_empty_input_has_one_empty_shard(spark):
    none = spark.createDataFrame([], "seq bigint, nbytes bigint")
    assigned = packing.assign_shards(none, Pack())
    assert assigned.count() == 0
    assert [tuple(r)[:3] for r in packing.shard_manifest(assigned).collect()] == [(1, 0, 0)]


def test_shard_files(spark, tmp_path):
    lines = [json.dumps({"n": i, "t": "é" * (i % 9)}, ensure_ascii=False) for i in range(60)]
    frame = spark.createDataFrame(list(enumerate(lines)), "seq bigint, value string").repartition(4)
    assigned = packing.assign_shards(frame.select("seq", packing.line_bytes(F.col("value")).alias("nbytes")), Pack(max_bytes=200))
    sinks.write_shards(frame, assigned, str(tmp_path / "out"), Pack(prefix="corpus"))
    labels, last, _ = next_fit([len(x.encode()) + 1 for x in lines], 200)
    for shard in range(1, last + 1):
        (file,) = (tmp_path / "out" / f"shard=corpus_{shard}").glob("part-*")
        assert file.read_text("utf-8") == "".join(x + "\n" for x, k in zip(lines, labels) if k == shard)


@pytest.mark.parametrize("size", [1, 4, 7, 1000])
def test_chunks(spark, size, tmp_path):
    texts = ["", "abcd", "日本語テキスト", "x" * 4001]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, body string")
    got = byte_chunks(frame, Chunk(bytes=size, prefix="p%_"))
    for doc, text in enumerate(texts):
        parts = got.filter(F.col("doc_id") == doc).orderBy("part").collect()
        raw = text.encode()
        assert [bytes(p["bytes"]) for p in parts] == [raw[i : i + size] for i in range(0, len(raw), size)]
        assert [p["name"] for p in parts] == [f"p%_{i + 1:03d}.md" for i in range(len(parts))]
    binary = frame.select("doc_id", F.encode("body", "UTF-8").alias("body"))
    assert binary.transform(byte_chunks, Chunk(bytes=size)).count() == got.count()
    sinks.write_chunks(got, str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == got.count()


def test_chunks_of_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(bytes(range(256)) * 10)
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.md"))
    parts = byte_chunks(files, Chunk(bytes=1000), "path", "content").orderBy("part").collect()
    assert b"".join(bytes(p["bytes"]) for p in parts) == bytes(range(256)) * 10


GOOD = '{"url": "u", "title": "t", "markdown_content": "m"}'


@pytest.mark.parametrize(
    "line, expected",
    [
        (GOOD, ("u", "t", "m")),
        (f"  {GOOD}\t", ("u", "t", "m")),
        ('{"markdown_content": null, "title": 5}', (None, "5", None)),
        ('{"markdown_content": ""}', (None, None, "")),
        ('{"markdown_content": "a\\u00e9\\n", "x": {"y": [1, "}"]}}', (None, None, "aé\n")),
        ('{"url": "u"}', "no markdown_content"),
        (f"{GOOD} xyz", "invalid json"),
        (f"{GOOD} {GOOD}", "invalid json"),
        (f"{GOOD}, {GOOD}", "invalid json"),
        (f"{GOOD}]", "invalid json"),
        (f"{GOOD}]}}", "invalid json"),
        (f"{GOOD}}}", "invalid json"),
        ("{'markdown_content': 'm'}", "invalid json"),
        (GOOD[:-1], "invalid json"),
        ("", "invalid json"),
        (f"[{GOOD}]", "not an object"),
        ('"markdown_content"', "not an object"),
        ("5", "not an object"),
        ("null", "not an object"),
    ],
)
def test_json_lines(spark, line, expected):
    good, bad = read_entries(spark.createDataFrame([(1, line)], "seq int, value string"))
    entries = [(r["url"], r["title"], r["markdown_content"]) for r in good.collect()]
    reasons = [r["reason"] for r in bad.collect()]
    assert (entries, reasons) == (([], [expected]) if isinstance(expected, str) else ([expected], []))


def test_combined_document(spark, tmp_path, hot_mode):
    rows = [(i, "a" if i % 4 else "b", None if i % 5 == 0 else f"T{i}", None if i % 7 == 0 else f"u{i}", f"text {i}\nmore") for i in range(60)]
    frame = spark.createDataFrame(rows, "seq bigint, site string, title string, url string, markdown_content string").repartition(5)
    pieces = combine_entries(frame, "2024-01-31 00:00:00", "site")
    sinks.write_combined(pieces, str(tmp_path / "out"), "site", target_rows=7)
    for site in "ab":
        mine = [r for r in rows if r[1] == site]
        entries = [f"# {t or 'No Title'}\n\n*Source: {u or 'No URL'}*\n\n{m}\n" for _, _, t, u, m in mine]
        head = f"# Combined Markdown Content\n*Generated on: 2024-01-31 00:00:00*\n*Total entries: {len(mine)}*\n\n"
        expected = head + Combine().separator.join(entries)
        assert "".join(r["piece"] for r in pieces.filter(F.col("site") == site).orderBy("seq").collect()) == expected
        files = sorted((tmp_path / "out" / f"site={site}").glob("part-*"))
        assert "".join(f.read_text() for f in files) == expected
    assert {r["site"]: r["n_entries"] for r in entry_counts(frame, "site").collect()} == {"a": 45, "b": 15}
    sinks.write_combined(pieces.filter("false"), str(tmp_path / "none"), "site")
    assert not (tmp_path / "none").exists()


def test_records_as_json_lines(spark, tmp_path):
    frame = spark.createDataFrame([("u", None)], "url string, status int").withColumn(
        "crawled_at", F.lit("2025-05-07 13:44:35.675979").cast("timestamp_ntz")
    )
    sinks.write_records(frame.coalesce(1), str(tmp_path / "out"))
    (file,) = Path(tmp_path / "out").glob("part-*")
    assert json.loads(file.read_text()) == {"url": "u", "status": None, "crawled_at": "2025-05-07T13:44:35.675979"}
