"""Conversation repair against a plain dynamic programme over whole conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidewell.llm import repair
from tidewell.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
PUT = {"": "u", "s": "u", "a": "u", "u": "a"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def least(rows):
    """(cost, audit, repaired) of rows (role, text, fault): the best of all ways, (cost, audit, lines) by state."""
    best = {"": (0, "", ())}

    def insert(best):
        for _ in range(3):
            for s, (cost, audit, lines) in list(best.items()):
                to = PUT[s]
                way = (cost + 3, audit + "I", lines + (("user:", "assistant:")[to == "a"],))
                if to not in best or way[:2] < best[to][:2]:
                    best[to] = way
        return best

    for role, text, fault in rows:
        now = {}

        def put(to, *way):
            if to not in now or way[:2] < now[to][:2]:
                now[to] = way

        for s, (cost, audit, lines) in insert(best).items():
            put(s, cost + 4, audit + "D", lines)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if (s, role[:1]) in NEXT:
                    put(NEXT[s, role[:1]], cost + more, audit + "K", lines + (f"{role}:{text}",))
                put(PUT[s], cost + 3 + more, audit + "R", lines + (f"{('user', 'assistant')[PUT[s] == 'a']}:{text}",))
        best = now
    cost, audit, lines = min(v for k, v in insert(best).items() if k in ("", "a"))
    return cost, audit, "\n".join(lines)


def expected(rows):
    convs = defaultdict(list)
    for r in damage(rows):
        convs[r[0]].append(r)
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted(convs[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, _, role, text in mine:
            last = re.search(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)", text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, said = least([(r[2], r[3], f) for r, f in zip(mine, faults)])
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]:
        n = rng.choice([1, 2, 5, 40, 200])
        roles = {7: ["system"], 8: ["tool"], 9: ["user"], 10: ["assistant"]}.get(conv, ["user", "assistant", "system", "tool", None, "", "superb"])
        for turn in range(n):
            # a turn holds one row, so that ties are equal rows
            text = rng.choice([f"Line {turn}.", f"Line {turn}", "same.", " \t", None, f"é\n{turn}! \n", "x" * 3000 + "?"]) if conv not in (7, 8) else f"line {turn}" + "." * (turn % 3 > 0)
            rows.append((conv, None if rng.random() < 0.02 and conv == 2 and turn == 5 else turn * rng.choice([1, 1, 1]) + (7 if conv == 3 else 0), rng.choice(roles), text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [3, 16, 4096])
def test_repair_by_brute_force(spark, chunk):
    rows = made(chunk)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("g", F.lit("mine")).withColumn("block", F.lit(1)).withColumn("conv", F.lit(2))
    assert got(repair.repair_report(df, chunk=chunk)) == expected(rows)


def test_repair_of_the_given_table(spark):
    df = table(spark, SMALL, "conversations")
    assert got(repair.repair_report(df)) == expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_chunks_that_never_converge(spark):
    """Rows of one role swap the states for ever, so every chunk depends on those behind it."""
    rows = [(1, k, "system", f"n{k}.") for k in range(301)] + [(2, k, "assistant", f"n{k}.") for k in range(300)] + [(3, k, "other", f"n{k}") for k in range(299)]
    assert len(repair._speculate("A" * 50)) > 1
    assert got(repair.repair_report(spark.createDataFrame(rows, SCHEMA), chunk=5)) == expected(rows)


def test_nothing_left(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "hi.")]
    assert got(repair.repair_report(spark.createDataFrame(rows, SCHEMA))) == expected(rows) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repaired_rows(spark):
    """The operator's own output: the repaired conversation, row by row."""
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", ""), (1, 2, "user", "Why?")]
    _, fixed = repair.edits(spark.createDataFrame(rows, SCHEMA))
    # two insertions cost what two new roles cost, and I comes before R
    assert [(r["role"], r["text"]) for r in fixed.orderBy("conv", "g", "place").collect()] == [("user", ""), ("assistant", "Hello."), ("user", "Why?"), ("assistant", "")]


def test_oracle_by_brute_force(spark):
    """The SQL, too, equals the plain programme, on rows that try every fault and role."""
    import duckdb

    rows = [r for r in made(5) if r[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.execute(repair.ORACLE).fetchall()
    assert sorted(got, key=str) == expected(rows)
