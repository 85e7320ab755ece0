"""Take-overs in blocks against a plain walk."""

import random
from datetime import datetime, timedelta

import pytest

from pagetide.config import Refresh
from pagetide.operators import registry as R
from pagetide.operators.takeover import NEVER, UNTIMED, after, steps
from pagetide.sources.registry import REGISTRY

T0 = datetime(2024, 1, 1)


def walked(times, state, wait):
    taken = []
    for t in times:
        taken.append(state == NEVER or t >= state + wait)
        if taken[-1]:
            state = NEVER if t == UNTIMED else t
    return taken, state


@pytest.mark.parametrize("wait", [1, 4, 30])
def test_step_functions_equal_a_walk(wait):
    rng = random.Random(wait)
    for _ in range(300):
        n, ordered = rng.randrange(1, 30), rng.random() < 0.5
        times = [rng.randrange(60) if rng.random() < 0.95 else UNTIMED for _ in range(n)]
        times = sorted(times) if ordered else times
        block = steps(times, wait)
        for state in (NEVER, *range(-wait, 70)):
            assert after(state, wait, *block) == walked(times, state, wait)[1], (times, state)


def test_a_thousand_take_overs(spark, hot_mode):
    """A url that is seen twice a day for a thousand refresh ages, beside others: one walk, however long it is."""
    rows = [("u", i, T0 + timedelta(hours=12 * i), "x", 200) for i in range(6000)]
    rows += [(f"v{i % 7}", 10_000 + i, T0 + timedelta(days=i), "x", 200) for i in range(70)]
    schema = "url string, seq bigint, observed_at timestamp_ntz, content_hash string, status int"
    old = spark.createDataFrame([("u", "x", None, T0, T0 - timedelta(days=1), 0, 200)], REGISTRY)

    def decided(some):
        """What is taken over, and how many jobs that took."""
        group = f"take-{hot_mode}-{len(some)}"
        spark.sparkContext.setJobGroup(group, group)
        frame = spark.createDataFrame(some, schema).repartition(5)
        found = {r["seq"] for r in R.decide(frame, old, Refresh("auto", 3)).filter("is_fresh").select("seq").collect()}
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    got, jobs = decided(rows)
    assert jobs < 100
    last, expected = {"u": T0 - timedelta(days=1)}, set()
    for url, seq, at, *_ in rows:
        if url not in last or at >= last[url] + timedelta(days=3):
            last[url] = at
            expected.add(seq)
    assert got == expected and len(got) > 1000
