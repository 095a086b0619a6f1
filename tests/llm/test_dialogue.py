"""Conversation repair against a search over all edits, and the memory of the streaming search."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from terrane.llm import dialogue

LEGAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """(role, text, bad, truncated, fault) of rows (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        end = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        if not end:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "truncated" if end[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault in ("blank", "duplicate"), fault == "truncated", fault))
    return out


def brute(rows, most_inserted=4):
    """(cost, letters, repaired) of the cheapest of all edits with at most so many insertions."""
    marked, best = faults(rows), None
    per_row = []
    for role, text, bad, cut, _ in marked:
        ways = [(2, "D", None)]
        if not bad:
            ways += [(5 * cut, "K", (role, text)), (1 + 5 * cut, "R", ("user", text)), (1 + 5 * cut, "R", ("assistant", text))]
        per_row.append(ways)
    inserted = [[(5, "I", (r, "")) for r in combo] for n in range(3) for combo in itertools.product(("user", "assistant"), repeat=n)]
    for ways in itertools.product(*per_row):
        for gaps in itertools.product(inserted, repeat=len(rows) + 1):
            if sum(map(len, gaps)) > most_inserted:
                continue
            path = [*gaps[0], *itertools.chain.from_iterable([w, *g] for w, g in zip(ways, gaps[1:], strict=True))]
            if not LEGAL.fullmatch("".join(p[2][0][:1] or "?" for p in path if p[2])):
                continue
            found = sum(p[0] for p in path), "".join(p[1] for p in path), [p[2] for p in path if p[2]]
            best = found if best is None or found[:2] < best[:2] else best
    return best


def dynamic(rows):
    """The same by whole strings for each state, without a tree, for longer conversations."""
    states = {"": (0, "", [])}
    after = {"s": ("",), "u": ("", "s", "a"), "a": ("u",)}

    def offer(to, state, way):
        if state not in to or way[:2] < to[state][:2]:
            to[state] = way

    def insert(states):
        for role in ("user", "assistant"):
            for s in after[role[0]]:
                if s in states:
                    c, a, o = states[s]
                    offer(states, role[0], (c + 5, a + "I", [*o, (role, "")]))

    for role, text, bad, cut, _ in faults(rows):
        insert(states)
        new = {}
        for s, (c, a, o) in states.items():
            offer(new, s, (c + 2, a + "D", o))
            if not bad:
                for to, letter, cost, as_role in ((role[:1], "K", 0, role), ("u", "R", 1, "user"), ("a", "R", 1, "assistant")):
                    if to in after and s in after[to]:
                        offer(new, to, (c + cost + 5 * cut, a + letter, [*o, (as_role, text)]))
        states = new
    insert(states)
    return min((states[s] for s in ("", "a") if s in states), key=lambda w: w[:2])


def searched(rows):
    search, out, held = dialogue.Repair(), [], 0
    for role, text, bad, cut, _ in faults(rows):
        out.extend(search.push(text, role, bad, cut))
        held = max(held, len(search._letters(max(search.best.values(), key=lambda b: len(search._letters(b[1])))[1])))
    out.extend(search.finish())
    return search.cost, "".join(e for e, _ in out), [(role, row or "") for e, (row, role) in out if e != "D"], held


def talk(rng, n, roles=("user", "assistant", "system"), tidy=0.6):
    texts = ["Yes.", "No!", "Why?", "Well", "", " \n", "I see. ", "and then"]
    return [(k, ("user", "assistant")[k % 2] if rng.random() < tidy else rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{k}.") for k in range(n)]


@pytest.mark.parametrize("seed", range(25))
def test_search_against_all_edits(seed):
    rng = random.Random(seed)
    rows = talk(rng, rng.randint(0, 3), ("user", "assistant", "system", "tool", "User", ""), 0.2)
    cost, letters, kept, _ = searched(rows)
    assert (cost, letters, kept) == brute(rows)


@pytest.mark.parametrize("seed", range(60))
def test_search_against_whole_strings(seed):
    rng = random.Random(seed)
    rows = talk(rng, rng.randint(4, 60), ("user", "assistant", "system", "tool"), rng.choice([0, 0.5, 0.9]))
    assert searched(rows)[:3] == dynamic(rows)


@pytest.mark.parametrize("role", ["user", "assistant", "system", "both", "tool"])
def test_ties_over_long_runs(role):
    rows = [(k, ("user", "assistant")[k % 2] if role == "both" else role, f"t{k}" + "." * (k % 3 > 0)) for k in range(90)]
    assert searched(rows)[:3] == dynamic(rows)


def test_memory_stays_bounded():
    """What isn't decided stays short in a long conversation, so edits come out as it is read."""
    rng = random.Random(1)
    assert searched([(k, rng.choice(["user", "assistant", "assistant"]), f"t{k}" + "." * (rng.random() < 0.8)) for k in range(5000)])[3] < 250
    search, out = dialogue.Repair(), 0
    for k in range(2000):
        out += len(list(search.push(k, ("user", "assistant")[k % 2], False, False)))
    assert out > 1950


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def expected(rows, damaged):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in damaged if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        marks = [f[4] for f in faults(own)]
        cost, letters, kept = dynamic(own)
        turns = [r[0] for r in own if r[0] is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[marks.count(m) for m in ("blank", "duplicate", "truncated")],
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_query_on_awkward_rows(spark, tmp_path):
    from terrane.llm.queries import QUERIES

    rng = random.Random(5)
    rows = [(c, t, r, x) for c in range(40) for t, r, x in talk(rng, rng.randint(1, 9))]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (None, None, None, None), (None, 2, None, "x"), (50, None, "user", None), (50, 3, None, "Hm."),
             (51, 7, "user", "word " * 300_000), (51, 8, "assistant", "Long."), (52, 1, "user", "Twice."), (52, 1, "user", "Twice."), (52, 9, "assistant", "")]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "All of it goes."))
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                           T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in ("digest", "late", "fault", "copy", "_c", "blank")]])
    spark.createDataFrame([(*r, *["x"] * 6) for r in rows], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_dialogue_repair"](spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows, damage(rows))
    assert dialogue.reports(got.select("conv_id", got.gaps.alias("turn"), got.audit.alias("role"), got.audit.alias("text")).filter("false")).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Still there?"), (1, 3, "assistant", "Yes."), (1, 4, "assistant", ""), (2, 5, "assistant", "Hello.")]
    got = dialogue.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "step").collect()
    assert [tuple(r) for r in got] == [
        (1, 0, "K", 0, "system", "Be kind."), (1, 1, "D", 1, None, None), (1, 2, "K", 2, "user", "Still there?"), (1, 3, "K", 3, "assistant", "Yes."),
        (1, 4, "D", 4, None, None), (2, 0, "D", 5, None, None)]
