"""Conversation repair against a plain table of best prefixes, and against all edits of short conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from pagetide.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, c string, n int, fault string"
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        marks = WORD.findall(text)
        kind = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def best_edits(rows):
    """(cost, audit, turns) by the best prefix of every state, turn by turn."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def inserted(states):
        for _ in range(3):
            for s, (cost, audit, out) in list(states.items()):
                t = follow[s]
                way = (cost + 3, audit + "I", [*out, name[t] + ":"])
                states[t] = min(states.get(t, way), way)
        return states

    states = {"": (0, "", [])}
    for (_, role, text), kind in zip(rows, faults(rows), strict=True):
        new = {}
        offer = lambda s, way: new.__setitem__(s, min(new.get(s, way), way))
        for s, (cost, audit, out) in inserted(states).items():
            offer(s, (cost + 4, audit + "D", out))
            if kind in ("blank", "duplicate"):
                continue
            extra = 3 * (kind == "truncated")
            offer(follow[s], (cost + 3 + extra, audit + "R", [*out, f"{name[follow[s]]}:{text}"]))
            if s + role[:1] in ("s", "u", "su", "ua", "au") and role:
                offer(role[:1], (cost + extra, audit + "K", [*out, f"{role}:{text}"]))
        states = new
    inserted(states)
    return min(states[s] for s in ("", "a") if s in states)


def expected(rows):
    kinds = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    first = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first))
    cost, audit, out = best_edits(rows)
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def by_conversation(rows):
    """Rows (conv_id, turn, role, text) with nulls as one space, in order."""
    space = lambda x: " " if x is None else x
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, space(role), space(text)))
    return {k: ordered(v) for k, v in out.items()}


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "c", 1, "x") for r in rows], SCHEMA).repartition(parts)


def results(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert frame.columns == ["conv_id", *NAMES] and len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def conversation(rng, conv, n):
    role = lambda i: rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ["user", "assistant"][i % 2]
    text = lambda: rng.choice(["Yes.", "No!", "why", "", " \n", "Fine. ", "A. b", "ok?", f"w{rng.random()}.", f"x{rng.random()}"])
    rows = [(conv, i, "system", "Be kind.") for i in range(rng.random() < 0.3)]
    rows += [(conv, i + (i > 5), role(i), text()) for i in range(n) if rng.random() < 0.95]
    return rows + [(conv, None, rng.choice(["tool", "", None, "user"]), rng.choice([None, "hm."])) for _ in range(rng.random() < 0.2)]


@pytest.fixture(scope="module")
def log():
    rng = random.Random(8)
    rows = [r for i in range(150) for r in conversation(rng, i, rng.randrange(1, 9))]
    rows += [r for i in range(3) for r in conversation(rng, 200 + i, 300)] + conversation(rng, None, 90)
    rows += rng.sample(rows, 30) + [(300, 0, "user", "one."), (301, None, None, None), (302, 5, "user", "é" * 2_000_000 + "."), (303, 1, "", "x.")]
    return rows + [(304, 2, "assistant", "again.")] * 40


@pytest.mark.parametrize("chunk", [64, 3])
def test_equals_best_prefixes(spark, log, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    assert results(repair.repair(table(spark, log))) == {k: expected(v) for k, v in by_conversation(log).items()}
    assert repair.repair(table(spark, log).filter("false")).collect() == []


def test_query(spark, log, tmp_path):
    """The registered query over damaged rows; conversations that lose all rows are still there."""
    hurt = []
    for conv, turn, role, text in log + [(k, 0, "user", "Hi.") for k in range(1000, 1100)]:
        space = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else space(role), re.sub("[.!?]", "", space(text)) if kind == 2 else "" if kind == 1 else space(text)
        hurt += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    given = log + [(k, 0, "user", "Hi.") for k in range(1000, 1100)]
    table(spark, given).write.parquet(f"{tmp_path}/conversations.parquet")
    got = results(queries.op11_conversation_repair(spark, str(tmp_path)))
    want = {k: expected([]) for k in {r[0] for r in given}} | {k: expected(v) for k, v in by_conversation(hurt).items()}
    assert got == want and any(not sum(x[:6]) and not x[6] for x in got.values())


def kinds_of(rows):
    short = {"blank": "b", "duplicate": "r", "truncated": "t", "": "k"}
    return tuple((r[1][:1], short[k], 1) for r, k in zip(rows, faults(rows), strict=True))


def test_search_equals_all_edits():
    rng = random.Random(2)
    form = re.compile(r"(s?(ua)+)?")
    for _ in range(120):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "c!", ""])) for i in range(rng.randrange(4))]
        kinds, best = faults(rows), None
        for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            for edits in itertools.product("DKua", repeat=len(rows)):
                if any(e != "D" and k in ("blank", "duplicate") for e, k in zip(edits, kinds, strict=True)):
                    continue
                cost = 3 * len("".join(gaps)) + sum({"D": 4, "K": 0}.get(e, 3) + 3 * (k == "truncated" and e != "D") for e, k in zip(edits, kinds, strict=True))
                left = "".join(g + ("" if e == "D" else r[1][0] if e == "K" else e) for g, e, r in zip(gaps, edits, rows)) + gaps[-1]
                if form.fullmatch(left):
                    audit = "".join("I" * len(g) + (e if e in "DK" else "R") for g, e in zip(gaps, edits)) + "I" * len(gaps[-1])
                    best = min(best or (cost, audit), (cost, audit))
        assert repair.search(kinds_of(rows), repair.BEGIN, repair.END) == best


def test_search_of_many_turns_stays_small():
    """The worst orders of roles are still proved fast."""
    for roles in ("u" * 64, "a" * 64, "s" * 64, "uuaa" * 16, "x" * 64, "auua" * 16):
        rows = [(i, {"u": "user", "a": "assistant", "s": "system"}.get(r, r), f"{i}" + "." * (i % 3 > 0)) for i, r in enumerate(roles)]
        assert repair.search(kinds_of(rows), repair.BEGIN, repair.END) == best_edits(rows)[:2]
