"""Language identification with interpolated Kneser-Ney character models, one per language.

Characters are lower-cased letters; everything else is one space. 4-grams of all training texts are counted in Spark,
lower orders follow from them as continuation counts. The probabilities of all languages for a gram lie side by side
in sorted hash arrays. A text gets the language with the lowest cross-entropy per character. It is rejected
if that lies clearly above what training texts of the language reach (a threshold for each language, from all of them).

Defined results: a null text or one without a letter is `und`, with score 0, and is rejected. Rows without a language
are not learned from. Without any training row every text is `und`. Ties go to the alphabetically first language.
Repeated rows count as often as they occur. Whole texts are used, however long. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm import arrays, shared
from pagetide.session import stage

ORDER = 4
PAD, SPACE = 1, 32
CHARS = 1 << 18  # characters that numpy looks at together
PENDING = 250_000  # counted grams a task holds before it sends them on
SLACK = 1.0  # a text is rejected above q999 + SLACK * (q999 - median) of its language
U = np.uint64


@cache
def _letters() -> np.ndarray:
    """For each code point: 16 bits of the lower-case letter, or a space. Rare planes share codes."""
    out = np.full(0x110000, SPACE, np.uint16)
    for i in range(0x110000):
        if chr(i).isalpha():
            low = ord(chr(i).lower()[0])
            out[i] = low if low < 0x10000 else 0xE000 + low % 0x1000
    return out


def _grams(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first, end, packed 4-grams, and the row of each gram (counted from first). Every text is padded on the left."""
    letters = _letters()
    lo = 0
    while lo < len(texts):
        hi, n = lo, 0
        while hi < len(texts) and (hi == lo or n + len(texts[hi]) <= CHARS):
            n += len(texts[hi])
            hi += 1
        sizes = np.array([len(t) + 1 for t in texts[lo:hi]])
        raw = np.frombuffer((" ".join(texts[lo:hi]) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        c = letters[raw]
        row = np.repeat(np.arange(hi - lo), sizes)
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != SPACE) | (c[:-1] != SPACE)
        keep[0] = c[0] != SPACE
        c, row = c[keep].astype(U), row[keep]
        place = np.arange(len(c)) - np.searchsorted(row, np.arange(hi - lo))[row]  # in its own text
        gram = c.copy()
        for k in range(1, ORDER):
            before = np.full(len(c), PAD, U)
            before[k:] = c[:-k] if k < len(c) else 0
            before[place < k] = PAD
            gram |= before << U(16 * k)
        yield lo, hi, gram, row
        lo = hi


def _count(docs: DataFrame) -> DataFrame:
    """lang, gram, c over all training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        n = 0

        def flush():
            for lang, parts in held.items():
                gram, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                c = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(c)], ["lang", "gram", "c"]
                )

        for batch in shared.few_rows(batches):
            texts = shared.text_column(batch).to_pylist()
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for _, _, gram, _ in _grams(own):
                    keys, c = np.unique(gram, return_counts=True)
                    held.setdefault(lang, []).append((keys, c))
                    n += len(keys)
            if n > PENDING:
                yield from flush()
                held, n = {}, 0
        yield from flush()

    sent = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(run, "lang string, gram long, c long")
    return stage(sent.groupBy("lang", "gram").agg(F.sum("c").alias("c")), "grams")


@dataclass
class Model:
    langs: list[str]
    grams: arrays.HashArrays | None
    floor: np.ndarray  # log2 of the uniform part, for letters that were never seen

    def cost(self, gram: np.ndarray) -> np.ndarray:
        """Bits for each gram and language."""
        out = np.zeros((len(gram), len(self.langs)))
        left = np.arange(len(gram))
        for n in range(ORDER, -1, -1):
            if not n:
                out[left] -= self.floor
                break
            keys = gram[left] & U((1 << 16 * n) - 1) if n < 4 else gram[left]
            ids = self.grams.find(_key(keys, n, 0))
            hit = ids >= 0
            if hit.any():
                out[left[hit]] -= self.grams.values("log2", ids[hit])
            left, keys = left[~hit], keys[~hit]
            if not len(left):
                break
            ids = self.grams.find(_key(keys >> U(16), n, 1))
            known = ids >= 0  # the context is known, so the lower order has a weight
            if known.any():
                out[left[known]] -= self.grams.values("log2", ids[known])
        return out


def _key(keys: np.ndarray, n: int, kind: int) -> np.ndarray:
    """Hash of a gram (kind 0) or of a context (kind 1) of order n."""
    return shared.mix(shared.mix(keys) + U((2 * n + kind + 1) * 0x9E3779B97F4A7C15 % 2**64))


def fit(docs: DataFrame) -> Model:
    """Kneser-Ney models of all languages of the training rows (text, lang)."""
    spark = docs.sparkSession
    counts = {ORDER: _count(docs)}
    langs = sorted(r[0] for r in counts[ORDER].select("lang").distinct().collect())
    if not langs:
        return Model([], None, np.zeros(0))
    low = lambda n: F.col("gram").bitwiseAND(F.lit((1 << 16 * (n - 1)) - 1))
    for n in range(ORDER, 1, -1):  # continuation counts: in how many ways a gram is continued to the left
        counts[n - 1] = counts[n].groupBy("lang", low(n).alias("gram")).agg(F.count("*").alias("c"))
    named = F.array(*(F.lit(x) for x in langs))
    alphabet = {r[0]: r[1] for r in counts[1].groupBy("lang").count().collect()}
    floor = {x: 1.0 / (alphabet[x] + 1) for x in langs}
    lower, out = None, []
    for n in range(1, ORDER + 1):
        g = counts[n]
        d = {r["lang"]: max(0.1, r["n1"] / max(1, r["n1"] + 2 * r["n2"])) for r in g.groupBy("lang").agg(
            F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).collect()}
        pick = lambda values: F.element_at(F.create_map(*(F.lit(v) for kv in values.items() for v in kv)), F.col("lang"))
        context = F.shiftrightunsigned("gram", 16)
        # weight of the lower order after each context
        weights = g.groupBy("lang", context.alias("context")).agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
        weights = weights.withColumn("weight", pick(d) * F.col("kinds") / F.col("total"))
        grid = g.select("gram").distinct().select("gram", F.explode(named).alias("lang")).withColumn("context", context)
        p = grid.join(g, ["lang", "gram"], "left").join(weights, ["lang", "context"], "left")
        if n == 1:
            p = p.withColumn("lower", pick(floor))
        else:
            p = p.withColumn("low", low(n)).join(
                lower.select("lang", F.col("gram").alias("low"), F.col("p").alias("lower")), ["lang", "low"]
            )
        own = F.coalesce(F.greatest(F.col("c") - pick(d), F.lit(0.0)) / F.col("total"), F.lit(0.0))
        lower = stage(
            p.select("lang", "gram", (own + F.coalesce("weight", F.lit(1.0)) * F.col("lower")).alias("p")), f"order{n}"
        )
        # rows of the arrays: one log for each language
        side_by_side = lambda df, key, value: df.groupBy(key).agg(
            F.map_from_entries(F.collect_list(F.struct("lang", value.alias("v")))).alias("m")
        ).select(F.col(key).alias("gram"), F.lit(n).alias("n"), F.transform(named, lambda x: F.coalesce(F.element_at("m", x), F.lit(0.0))).alias("log2"))
        out.append(side_by_side(lower, "gram", F.log2("p")).withColumn("kind", F.lit(0)))
        out.append(side_by_side(weights, "context", F.log2("weight")).withColumn("kind", F.lit(1)))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    rows = stage(rows, "model")
    bits = arrays.piece_bits(rows.count())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gram, n, kind = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            h = np.zeros(len(gram), U)
            for o in range(1, ORDER + 1):
                for k in (0, 1):
                    own = (n == o) & (kind == k)
                    h[own] = _key(gram[own].view(U), o, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(arrays.piece_of(h, bits)), pa.array(h.view(np.int64)), b.column(3)], ["piece", "hash", "log2"]
            )

    def merge(group: pa.Table) -> dict[str, np.ndarray]:
        h = group.column("hash").to_numpy().view(U)
        logs = group.column("log2").combine_chunks().flatten().to_numpy().reshape(len(h), -1)
        order = np.argsort(h)
        return {"hash": h[order], "log2": logs[order].astype(np.float32)}

    placed = rows.select("gram", "n", "kind", "log2").mapInArrow(hashed, "piece long, hash long, log2 array<double>")
    found = arrays.write_pieces(placed, bits, shared.mounted_folder(spark, "langid"), merge)
    return Model(langs, found, np.log2([floor[x] for x in langs]))


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns of `keep` and n_chars, lang_pred, bits (cross-entropy of that language), score (confidence)."""
    schema = docs.select(*keep).schema.add("n_chars", "long").add("lang_pred", "string").add("bits", "double").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.few_rows(batches):
            texts = shared.text_column(batch).to_pylist()
            n = np.zeros(len(texts), np.int64)
            bits = np.zeros((len(texts), max(1, len(model.langs))))
            if model.langs:
                for lo, hi, gram, row in _grams(texts):
                    n[lo:hi] = np.bincount(row[(gram & U(0xFFFF)) != SPACE], minlength=hi - lo)
                    some, at = np.unique(gram, return_inverse=True)
                    cost = model.cost(some)
                    size = np.maximum(np.bincount(row, minlength=hi - lo), 1)
                    for k in range(len(model.langs)):
                        bits[lo:hi, k] = np.bincount(row, cost[at, k], minlength=hi - lo) / size
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(bits)), best]
            # the margin of a text grows with its length; 40 characters stand for all that more could add
            sure = 1 / np.exp2(-(bits - least[:, None]) * np.minimum(n, 40)[:, None]).sum(axis=1)
            known = n > 0
            names = np.array([*model.langs, "und"], object)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(n), pa.array(names[np.where(known, best, len(model.langs))], pa.string()),
                 pa.array(np.where(known, least, 0.0)), pa.array(np.where(known, sure, 0.0))],
                [*keep, "n_chars", "lang_pred", "bits", "score"],
            )

    return docs.select("text", *keep).mapInArrow(run, schema)


def limits(scored: DataFrame, model: Model) -> DataFrame:
    """lang_pred, most: the cross-entropy above which a text is rejected, from all training texts of a language.

    It lies beyond what these texts reach, and at least halfway from their median to that of letters drawn at random.
    """
    q = scored.filter("trained AND lang_pred <> 'und'").groupBy("lang_pred").agg(
        F.percentile_approx("bits", [0.5, 0.999], 10_000).alias("q")
    )
    random = F.element_at(F.create_map(*(F.lit(x) for pair in zip(model.langs, (-model.floor).tolist(), strict=True) for x in pair)), F.col("lang_pred"))
    median, high = F.element_at("q", 1), F.element_at("q", 2)
    return q.select("lang_pred", F.greatest(high + SLACK * (high - median), (median + random) / 2).alias("most"))


def identify(docs: DataFrame, training: DataFrame, trained) -> DataFrame:
    """doc_id, lang_pred, score, rejected and the other figures; `trained` marks the rows of docs that were learned from."""
    model = fit(training)
    scored = stage(score(docs.withColumn("trained", trained), model, "doc_id", "trained"), "scored")
    if not model.langs:
        return scored.withColumn("rejected", F.lit(True))
    most = limits(scored, model)  # a row for each language
    return scored.join(F.broadcast(most), "lang_pred", "left").withColumn(
        "rejected", (F.col("lang_pred") == "und") | (F.col("bits") > F.coalesce("most", F.lit(float("inf"))))
    )


def with_known_language(docs: DataFrame, training: DataFrame, trained) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns. Rows that share an id are judged one by one."""
    keyed = docs.select(shared.row_key(docs).alias("doc_id"), "text", trained.alias("_trained"))
    gone = stage(identify(keyed, training, F.col("_trained")).filter("rejected").select(F.col("doc_id").alias("_gone")).distinct(), "rejected")
    return shared.without(docs, gone)
