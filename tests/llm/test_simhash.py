"""Memory of the walk over a pair of trie nodes."""

import tracemalloc

import numpy as np
import pyarrow as pa

from pagetide.llm import simhash


def test_walk_holds_few_node_pairs():
    rng = np.random.default_rng(1)
    own = rng.integers(0, 2**64, 60_000, dtype=np.uint64)
    near = own ^ (np.uint64(1) << rng.integers(0, 64, len(own), dtype=np.uint64))
    leaves = np.unique(np.concatenate((own, near)))
    tracemalloc.start()
    links = sum(len(i) for i, _ in simhash._walk(leaves, leaves, True, 64, 2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links >= 60_000
    assert peak < 64 << 20


def test_walk_takes_less_than_16_mb():
    rng = np.random.default_rng(1)
    own = rng.integers(0, 2**64, 60_000, dtype=np.uint64)
    leaves = np.unique(np.concatenate((own, own ^ (np.uint64(1) << rng.integers(0, 64, len(own), dtype=np.uint64)))))
    assert peak_of(lambda: sum(len(i) for i, _ in simhash._walk(leaves, leaves, True, 64, 2))) < 16 << 20


def peak_of(work) -> int:
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_sets_of_few_texts_are_held_together():
    """Making the sets of 4 MB of text takes a few MB beside the text."""
    texts = pa.array([" ".join(f"w{(i * k) % 9973}" for k in range(500)) for i in range(1, 1601)], pa.large_string())
    assert texts.nbytes > 4 << 20

    def work():
        for h, n in simhash._members(texts, 5):
            simhash._majority(h, n, 1)
            simhash._parities(h, n)

    assert peak_of(work) < 8 << 20


def set_bits(rng, n, common):
    """Two sets of n hashes with this many in common, and their parities."""
    x, y = (rng.integers(0, 2**64, n, dtype=np.uint64) for _ in "ab")
    y[:common] = x[:common]
    h = np.concatenate((x, y))
    return simhash._parities(h, np.array([n, n]))


def test_parities_never_differ_in_more_bits_than_members():
    rng = np.random.default_rng(2)
    for n in (1, 31, 32, 33, 100, 129, 1000):
        for common in (0, n // 2, (9 * n) // 10, n):
            bits, words = set_bits(rng, n, common)
            assert words[0] == words[1] and 64 * words[0] >= 2 * n and len(bits) == words.sum()
            differ = int(np.bitwise_count(bits[: words[0]] ^ bits[words[0] :]).sum())
            assert differ <= 2 * (n - common) and (n < 100 or common > n // 2 or 9 * differ > 2 * n)


def family(spark, texts):
    """Texts with 100 words of one licence and 18 own ones each: no two are 0.8 similar, but all share much."""
    licence = " ".join(f"w{i}" for i in range(100))
    rows = [(k, licence + " " + " ".join(f"own{k}x{i}" for i in range(18))) for k in range(texts)]
    rows += [(texts + k, t + " end") for k, t in rows[:3]]  # similar to the first three
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_pairs_that_parities_tell_apart_are_not_written(spark, monkeypatch):
    """A family of texts that are just not similar costs rows in proportion to its size, not to its square."""
    staged, plain = {}, simhash.stage

    def counted(df, name, *more):
        out = plain(df, name, *more)
        staged.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "stage", counted)
    texts = 90
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(family(spark, texts)).collect()}
    assert got == {k: k % texts for k in range(texts + 3)}
    assert max(staged["pairs"][1:]) <= 12 * texts  # all pairs: 4,005
    assert sum(staged["candidates"]) <= 20  # only texts of these are fetched
