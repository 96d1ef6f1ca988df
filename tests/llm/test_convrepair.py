"""Conversation repair against a plain search, in pieces of any size, and the corner cases."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cohortflow.llm import convrepair
from cohortflow.llm.convrepair import Repair, accepted, combine, damaged, repair_conversations, repair_damaged, run_table

EMPTY = hashlib.sha256(b"").hexdigest()
VALID = re.compile(r"(s?(ua)+)?")
ROLE = {"u": "user", "a": "assistant"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def plain_faults(rows):
    """(fault of each row) by the first that counts."""
    seen, out = set(), []
    for _, _, role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """Least (cost, audit) by best-first search over (rows read, roles made so far as a state), with the turns it makes."""
    # state of the made roles: "" nothing, "s", "u" (waits for a), "a" (complete)
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, k, state, made = heapq.heappop(todo)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == len(rows) and state in ("", "a"):
            return cost, audit, list(made)
        for role in follow[state]:
            if role in ROLE:
                heapq.heappush(todo, (cost + 2, audit + "I", k, role, (*made, (ROLE[role], ""))))
        if k < len(rows):
            _, _, role, text = rows[k]
            heapq.heappush(todo, (cost + 3, audit + "D", k + 1, state, made))
            if faults[k] not in ("blank", "duplicate"):
                more = faults[k] == "truncated"
                for new in follow[state]:
                    if role[:1] == new:
                        heapq.heappush(todo, (cost + more, audit + "K", k + 1, new, (*made, (role, text))))
                    if new in ROLE:
                        heapq.heappush(todo, (cost + 2 + more, audit + "R", k + 1, new, (*made, (ROLE[new], text))))
    raise AssertionError("no repair")


def brute(rows, every):
    """Rows of the summary for conversations ``every``, from damaged rows."""
    out = []
    for conv in every:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults = plain_faults(own)
        cost, audit, made = plain_repair(own, faults)
        turns = [t for _, t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        text = "\n".join(f"{role}:{text}" for role, text in made)
        assert not made or VALID.fullmatch("".join(role[0] for role, _ in made))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def random_rows(rng, n_convs=60, most=14):
    texts = ["Hello.", "What?", "no end", "ok!  ", " ", "", "\t\n", "x . y", "Hello.", "é。", None]
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "tool", "u", "", "Assistant", None]
    rows = []
    for conv in [*range(n_convs), None]:
        for turn in range(rng.randrange(1, most)):
            rows.append((conv, rng.choice([turn, turn, turn, turn, 2 * turn, 3, None]), rng.choice(roles), rng.choice(texts)))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, key string, pos int, n int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, "own", 5, 6) for r in rows], schema)


@pytest.mark.parametrize("seed", range(3))
def test_tables_match_plain_search(seed):
    rng = random.Random(seed)
    for _ in range(300):
        symbols = "".join(rng.choice("suaSUAoOx") for _ in range(rng.randrange(0, 9)))
        rows = [(1, k, {"s": "system", "u": "user", "a": "assistant"}.get(x.lower(), "tool"), f"{k}.") for k, x in enumerate(symbols)]
        faults = ["blank" if x == "x" else "truncated" if x.isupper() else "" for x in symbols]
        want = plain_repair(rows, faults)[:2]
        assert accepted(run_table(symbols)) == want, symbols
        cuts = sorted(rng.randrange(len(symbols) + 1) for _ in range(3))
        parts = [symbols[a:b] for a, b in itertools.pairwise([0, *cuts, len(symbols)])]
        assert accepted(combine([run_table(p) for p in parts])) == want


def test_equal_tops_are_merged():
    assert len(convrepair.TOPS) == 6 and len(run_table("uaxoUSA" * 5)) <= 36


@pytest.mark.parametrize("piece_rows", [1 << 16, 3, 1])
def test_matches_brute_force(spark, piece_rows):
    """Whole conversations, and conversations in pieces of a few rows."""
    rows = random_rows(random.Random(piece_rows))
    docs = frame(spark, rows).repartition(3)
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = brute(clean, {r[0] for r in rows})
    repair = Repair(docs, piece_rows=piece_rows)
    assert sorted(map(tuple, repair.summary().collect()), key=str) == sorted(want, key=str)
    turns = {}
    for r in sorted(repair.turns().collect(), key=lambda r: (str(r["conv_id"]), r["pos"], r["place"])):
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, *_, sha in want:
        assert hashlib.sha256("\n".join(turns.get(conv, [])).encode()).hexdigest() == sha
    repair.discard()


def test_damage(spark):
    rows = random_rows(random.Random(9), 200, 6)
    got = sorted((tuple(r) for r in damaged(frame(spark, rows)).collect()), key=str)
    assert got == sorted(plain_damage(rows), key=str) and len(got) != len(rows)


def test_query_matches_brute_force(spark, sf_dir):
    from cohortflow.llm import registry

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in registry.op13_repair_conversations(spark, sf_dir).collect()]
    assert sorted(got, key=str) == sorted(brute(plain_damage(rows), {r[0] for r in rows}), key=str)


def test_conversations_that_lose_all_rows(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = repair_damaged(frame(spark, [(gone, 0, "user", "Hello.")])).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", EMPTY)]
    nameless = next(t for t in range(1000) if zlib.crc32(f" :{t}".encode()) % 20 == 0)
    assert [tuple(r) for r in repair_damaged(frame(spark, [(None, nameless, "user", "Hello.")])).collect()] == [(None, 0, 0, 0, 0, 0, 0, "", EMPTY)]


def test_hot_conversation_and_repeats(spark):
    """One conversation of many rows over several partitions, with a third of them alike."""
    rng = random.Random(4)
    rows = [(7, k, "user" if k % 2 == 0 else "assistant", f"turn {k}" + rng.choice(".. !?")) for k in range(3000)] + [(7, 11, "user", "same.")] * 1500
    rows += [(k, t, "user" if t % 2 == 0 else "assistant", f"{k} {t}.") for k in range(100, 160) for t in range(4)]
    want = brute(rows, {r[0] for r in rows})
    got = [tuple(r) for r in repair_conversations(frame(spark, rows).repartition(8)).collect()]
    assert sorted(got) == sorted(want)


def test_corners(spark):
    assert repair_conversations(frame(spark, []).limit(0)).count() == 0
    assert repair_damaged(frame(spark, []).limit(0)).count() == 0
    long = "word " * 300_000 + "end."
    rows = [("a", "1", "user", long), ("a", "x", "system", "Be kind."), ("a", "2", "assistant", long), (" ", "1", "user", "Hi."), (None, "1", "user", "Hi."), ("", "1", "assistant", "Hi.")]
    named = spark.createDataFrame(rows, "chat string, at string, who string, said string")
    out = {r["conv_id"]: r for r in repair_conversations(named, "chat", "at", "who", "said").collect()}
    assert (out["a"]["cost"], out["a"]["audit"], out["a"]["gaps"]) == (0, "KKK", 0)
    assert {k: r["audit"] for k, r in out.items() if k != "a"} == {" ": "KI", None: "KI", "": "IK"}
    assert out["a"]["repaired_sha256"] == hashlib.sha256(f"system:Be kind.\nuser:{long}\nassistant:{long}".encode()).hexdigest()
    keys = spark.range(1).select(convrepair.key_of(F.lit(None).cast("string")), convrepair.key_of(F.lit("0")), convrepair.key_of(F.lit(""))).first()
    assert len(set(keys)) == 3
