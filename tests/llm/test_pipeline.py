"""The stages one after the other on the smallest tables."""

import corpus_pipeline
from pagetide.llm import decontaminate, pii
from pagetide.llm.shared import table


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for name, function in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stage(function(spark, docs, sf), name)
        assert docs.columns[: len(columns)] == columns
        assert 0.7 * before.count() <= docs.count() <= before.count()
        if name == "benchmark_decontamination":
            assert not decontaminate.report(docs, table(spark, sf, "benchmark")).filter("contaminated").count()
            clear = {v for r in docs.collect() for s, e, _ in pii.find(r["text"]) for v in [r["text"][s:e]]}
        if name == "pii_surrogates":
            assert not any(v in r["text"] for r in docs.collect() for v in clear)
    assert not docs.filter("NOT round_trip").count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_own_columns_with_clashing_names(spark):
    """Columns that are named like those inside the stages come out as they were; also for a text of several chunks."""
    extra = ("uid", "n_replaced", "decoded", "h", "k", "node", "component_id", "ids", "n_ids", "chunks", "round_trip")
    texts = ["Mail a.b@example.org now. " * 3, "word " * 12_000, None, ""]
    rows = [(i, t, "en", "s", len(t or ""), *(f"{c}{i}" for c in extra)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame(rows, schema)
    known = lambda df, names: {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}
    own = {i: tuple(f"{c}{i}" for c in extra) for i in range(4)}
    one = corpus_pipeline.near_dedup(spark, docs, "")
    assert one.columns == docs.columns and set(known(one, extra).items()) <= set(own.items())
    clear = corpus_pipeline.surrogates(spark, docs, "")
    assert clear.columns == docs.columns and known(clear, extra) == own
    assert "a.b@" not in known(clear, ["text"])[0][0]
    coded = corpus_pipeline.token_ids(spark, docs, "")
    names = [f"own_{c}" if c in ("ids", "n_ids", "chunks", "round_trip") else c for c in extra]
    assert known(coded, names) == own
    assert known(coded, ["round_trip"]) == {i: (True,) for i in range(4)} and known(coded, ["chunks"])[1][0] > 1


def test_ids_and_their_texts_take_one_python_worker_a_task(spark):
    """No task makes ids and decodes them at once: its two workers would stay idle on the executor for later stages."""
    docs = spark.createDataFrame([(i, f"a few words {i}") for i in range(20)], "doc_id long, text string")
    coded = corpus_pipeline.token_ids(spark, docs, "")
    assert coded._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert coded.filter("round_trip AND n_ids > 0").count() == 20
