"""Conversation structure repair by rank-convergence parallel Viterbi.

A conversation's rows, in order, pass an automaton of four states (nothing yet, system, user, assistant); keeping,
re-roling, deleting and inserting cost what the contract says. The least cost from a state to the end, for all four
states, is a vector, computed from the end backwards. Long conversations are cut into chunks that run at the same time:
a chunk doesn't know the vector behind its end, so it starts from speculative ones, all that can occur up to a constant
(they are few), and goes on until those that are left differ by constants alone, which is after a few rows as a rule.
Chunks that didn't converge are fixed up from those behind them, twice as far in each pass. With the vectors known, each
chunk traces forward, the least letter first, from all four states, and the same passes stitch the traces.

Blank and repeated rows must go, change no state and so take no part in the chunks' vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.ranks import numbered

from .common import bounded_batches, rekeyed, saved

INITIALS = "sua"
FAULTS = ("", "blank", "duplicate", "truncated")
#: Costs by the contract; an undeleted truncated row adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, S, U, A = range(4)
#: What one row's initial does when kept, by state; and what a user or assistant that is put there does.
KEEPS = {(START, 0): S, (START, 1): U, (S, 1): U, (A, 1): U, (U, 2): A}
PUTS = {START: U, S: U, A: U, U: A}
SYMBOLS = [(initial, late) for late in (False, True) for initial in range(4)]


def _inserting(cost: list[int]) -> list[int]:
    """The least costs when rows may be inserted first."""
    cost = list(cost)
    for _ in range(3):
        cost = [min(c, INSERT + cost[PUTS[s]]) for s, c in enumerate(cost)]
    return cost


def _level(cost: list[int]) -> tuple[int, ...]:
    return tuple(c - min(cost) for c in cost)


def _ways(after: tuple[int, ...], symbol: tuple[int, bool], s: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state) of what may happen to a row, with the costs `after` it."""
    initial, late = symbol
    more = TRUNCATED if late else 0
    ways = [("D", DELETE + after[s], s)]
    if (s, initial) in KEEPS:
        to = KEEPS[s, initial]
        ways.append(("K", more + after[to], to))
    ways.append(("UA"[PUTS[s] == A], REROLE + more + after[PUTS[s]], PUTS[s]))
    return ways


class Machine:
    """All vectors that can occur (up to a constant), how rows change them, and the least edits they lead to."""

    def __init__(self):
        end = _level(_inserting([0, 10**6, 10**6, 0]))
        ids, todo = {end: 0}, [end]
        self.back: list[list[int]] = []  # vector after the row -> by symbol: vector before it
        self.edits: list[list[list[tuple[str, int]]]] = []  # ... -> by symbol, by state: (letters, state after the row)
        while todo:
            after = todo.pop(0)
            back, edits = [], []
            for symbol in SYMBOLS:
                here = _inserting([min(c for _, c, _ in _ways(after, symbol, s)) for s in range(4)])
                edits.append([self._edit(after, symbol, here, s) for s in range(4)])
                flat = _level(here)
                if flat not in ids:
                    ids[flat] = len(ids)
                    todo.append(flat)
                back.append(ids[flat])
            self.back.append(back)
            self.edits.append(edits)
        self.size = len(ids)
        self.steps = [np.array([row[k] for row in self.back]) for k in range(len(SYMBOLS))]
        self.at_end = {START: "", A: "", U: "a", S: "ua"}

    @staticmethod
    def _edit(after, symbol, here, s) -> tuple[str, int]:
        """Letters: D and K, U or A for a new role, u or a for an inserted row; D < insert < K < new role."""
        said = ""
        while True:
            ways = {letter: to for letter, cost, to in _ways(after, symbol, s) if cost == here[s]}
            if "D" in ways:
                return said + "D", s
            if INSERT + here[PUTS[s]] == here[s]:
                said, s = said + "ua"[PUTS[s] == A], PUTS[s]
                continue
            letter = "K" if "K" in ways else next(iter(ways))
            return said + letter, ways[letter]


MACHINE = Machine()
#: A row's code is a letter: its initial, or 3, plus four times its fault.
FIRST = ord("A")


def _symbols(codes: str) -> list[int]:
    """Symbols of a chunk's rows; -1 for those that must go."""
    return [(c - FIRST) % 4 + (4 if (c - FIRST) // 4 == 3 else 0) if (c - FIRST) // 4 in (0, 3) else -1 for c in codes.encode()]


def _speculate(codes: str) -> list[int]:
    """The vector before the chunk for each one after it; a single one if they have converged."""
    live = np.arange(MACHINE.size)
    one = None
    for k in reversed(_symbols(codes)):
        if k < 0:
            continue
        if one is None:
            live = MACHINE.steps[k][live]
            if (live == live[0]).all():
                one = int(live[0])
        else:
            one = MACHINE.back[one][k]
    return live.tolist() if one is None else [one]


def _vectors(symbols: list[int], after: int) -> list[int]:
    """The vector after each row of the chunk."""
    out = [0] * len(symbols)
    for i in range(len(symbols) - 1, -1, -1):
        out[i] = after
        if symbols[i] >= 0:
            after = MACHINE.back[after][symbols[i]]
    return out


def _leads(codes: str, after: int) -> list[int]:
    """The state after the chunk for each state before it; a single one if it is the same for all."""
    symbols = _symbols(codes)
    states = [START, S, U, A]
    for k, v in zip(symbols, _vectors(symbols, after)):
        if k >= 0:
            states = [MACHINE.edits[v][k][s][1] for s in states]
    return states if len(set(states)) > 1 else states[:1]


def _trace(codes: str, after: int, s: int, last: bool) -> tuple[list[str], int]:
    """Each row's letters, and the cost."""
    symbols = _symbols(codes)
    out, cost = [], 0
    for k, v in zip(symbols, _vectors(symbols, after)):
        if k < 0:
            said = "D"
        else:
            said, s = MACHINE.edits[v][k][s]
            if k >= 4 and said[-1] != "D":
                cost += TRUNCATED
        out.append(said)
    if last:
        out[-1] += MACHINE.at_end[s]
    letters = "".join(out)
    return out, cost + DELETE * letters.count("D") + INSERT * (letters.count("u") + letters.count("a")) + REROLE * (letters.count("U") + letters.count("A"))


def _illegal(codes: str, before: str | None) -> int:
    said = [(c - FIRST) % 4 for c in ((before or "") + codes).encode()]
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(said, said[1:]))


def _stitched(chunks: DataFrame, step: int, start: int) -> DataFrame:
    """chunks (conv, block, outward, way) with `given`, what comes in from the chunk at block + step; start at the end.

    way: an array, what goes out for each value that comes in, or a single one. In each pass those that still depend on
    what comes in look up the chunk twice as far away, so passes grow with the logarithm of a conversation's chunks.
    """
    const = F.when(F.size("way") == 1, F.col("way")).otherwise(F.array(F.get("way", F.lit(start))))
    now = saved(chunks.select("conv", "block", F.when(F.col("outward"), const).otherwise(F.col("way")).alias("way")))
    far = step
    while not (open_ := now.where("size(way) > 1")).isEmpty():
        there = now.select(F.col("conv").alias("_c"), (F.col("block") - far).alias("_b"), F.col("way").alias("_way"))
        moved = open_.join(there, (F.col("conv") == F.col("_c")) & (F.col("block") == F.col("_b")))
        moved = moved.select("conv", "block", F.transform("_way", lambda k: F.get("way", k)).alias("way"))
        now, far = saved(now.where("size(way) = 1").unionByName(moved)), far * 2
    there = now.select(F.col("conv").alias("_c"), (F.col("block") - step).alias("_b"), F.get("way", F.lit(0)).alias("given"))
    given = chunks.join(there, (F.col("conv") == F.col("_c")) & (F.col("block") == F.col("_b")), "left").drop("_c", "_b")
    return given.withColumn("given", F.coalesce("given", F.lit(start)))


def coded(rows: DataFrame, chunk: int) -> DataFrame:
    """(conv, conv_id, block, g0, first, last, codes, before, h): chunks of rows (conv_id, turn, role, text), saved.

    conv numbers the conversation; first and last mark its outermost chunks; before is the code of the row before the
    chunk; h holds two hashes of each row.
    """
    text = F.rtrim(F.regexp_replace("text", r"[\x09-\x0D]", " "))
    hashes = [F.xxhash64("conv_id", "role", "text").alias("h1"), F.xxhash64(F.lit("second"), "conv_id", "role", "text").alias("h2")]
    narrow = rows.select("conv_id", "turn", "role", (text == "").alias("blank"), (~F.substring(text, -1, 1).isin(".", "!", "?")).alias("late"), *hashes)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "h1", "h2", F.monotonically_increasing_id()]
    narrow = numbered(narrow.withColumn("_tw_row", order.pop()), [*order, F.col("_tw_row")], "g").drop("_tw_row")
    seen = narrow.where("not blank").groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.min("g").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # a text that fills a conversation is one key here; both sides are dealt out anew, so adaptive execution may split it
    told = narrow.join(rekeyed(seen, "_h1"), (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    fault = F.when(F.col("blank"), 1).when(F.coalesce(F.col("least") < F.col("g"), F.lit(False)), 2).when(F.col("late"), 3).otherwise(0)
    initial = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in INITIALS]), F.substring("role", 1, 1)), F.lit(0))
    initial = F.when(initial > 0, initial - 1).otherwise(3)
    code = F.char(F.lit(FIRST) + initial + 4 * fault)
    part = F.struct("g", code.alias("code"), F.struct("h1", "h2").alias("h"))
    chunks = told.groupBy("conv_id", F.floor(F.col("g") / chunk).alias("block")).agg(F.sort_array(F.collect_list(part)).alias("all"))  # `chunk` rows at most
    chunks = saved(chunks.select("conv_id", "block", F.get("all.g", F.lit(0)).alias("g0"), F.array_join("all.code", "").alias("codes"), F.col("all.h").alias("h")))
    ends = chunks.groupBy(F.col("conv_id").alias("_id")).agg(F.min("g0").alias("conv"), F.min("block").alias("_b0"), F.max("block").alias("_b1"))
    chunks = chunks.join(ends, F.col("conv_id").eqNullSafe(F.col("_id"))).withColumn("first", F.col("block") == F.col("_b0")).withColumn("last", F.col("block") == F.col("_b1"))
    return chunks.drop("_id", "_b0", "_b1")


def traced(chunks: DataFrame) -> DataFrame:
    """chunks (as from coded) with letters (an array, a row's edits each), cost and illegal."""
    chunks = saved(chunks)
    whole = chunks.where("first and last").withColumn("after", F.lit(0)).withColumn("state", F.lit(START)).withColumn("before", F.lit(None).cast("string"))
    cut = chunks.where("not (first and last)").select("conv", "block", "first", "last", "codes")
    if not cut.isEmpty():
        speculate = F.pandas_udf(lambda codes: codes.map(_speculate), "array<int>")
        leads = F.pandas_udf(lambda codes, after: pd.Series([_leads(c, a) for c, a in zip(codes, after)]), "array<int>")
        back = _stitched(cut.select("conv", "block", F.col("last").alias("outward"), speculate("codes").alias("way")), 1, 0)
        with_after = cut.join(back.select(F.col("conv").alias("_c"), F.col("block").alias("_b"), F.col("given").alias("after")), (F.col("conv") == F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")
        with_after = saved(with_after)
        on = _stitched(with_after.select("conv", "block", F.col("first").alias("outward"), leads("codes", "after").alias("way")), -1, START)
        more = with_after.select(F.col("conv").alias("_c"), F.col("block").alias("_b"), "after")
        more = more.join(on.select(F.col("conv").alias("_c2"), F.col("block").alias("_b2"), F.col("given").alias("state")), (F.col("_c") == F.col("_c2")) & (F.col("_b") == F.col("_b2")))
        ends = cut.select(F.col("conv").alias("_c3"), (F.col("block") + 1).alias("_b3"), F.substring("codes", -1, 1).alias("before"))
        more = more.join(ends, (F.col("_c") == F.col("_c3")) & (F.col("_b") == F.col("_b3")), "left").select("_c", "_b", "after", "state", "before")
        joined = chunks.join(more, (F.col("conv") == F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")
        whole = whole.unionByName(joined)

    @F.pandas_udf("letters array<string>, cost long, illegal long")
    def finish(codes: pd.Series, after: pd.Series, state: pd.Series, last: pd.Series, before: pd.Series) -> pd.DataFrame:
        done = [(*_trace(c, a, s, e), _illegal(c, b)) for c, a, s, e, b in zip(codes, after, state, last, before)]
        return pd.DataFrame(done, columns=["letters", "cost", "illegal"])

    return whole.withColumn("_f", finish("codes", "after", "state", "last", "before")).select(*chunks.columns, "_f.*")


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(conv, sha256) of rows (conv, g, said) sorted by conv and g, joined by newlines, as they come."""
    now, digest, done = None, None, []
    for pdf in batches:
        for conv, said in zip(pdf["conv"], pdf["said"]):
            if conv != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(said.encode("utf-8", "surrogatepass"))
        if done:
            yield pd.DataFrame(done, columns=["conv", "sha"])
            done = []
    if now is not None:
        yield pd.DataFrame([(now, digest.hexdigest())], columns=["conv", "sha"])


def edits(rows: DataFrame, chunk: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(chunks, repaired) of rows (conv_id, turn, role, text), no role or text null.

    chunks are as from traced. repaired: (conv_id, conv, g, place, role, text), the rows of the repaired conversations,
    inserted ones with the empty text; in order by conv, g, place.
    """
    chunks = saved(traced(coded(rows, chunk)))
    each = chunks.select("conv_id", "conv", "g0", F.posexplode(F.arrays_zip("letters", "h")))
    each = each.select("conv_id", "conv", (F.col("g0") + F.col("pos")).alias("g"), "col.letters", F.col("col.h.h1").alias("h1"), F.col("col.h.h2").alias("h2")).where("letters <> 'D'")
    key = [F.xxhash64("conv_id", "role", "text").alias("_h1"), F.xxhash64(F.lit("second"), "conv_id", "role", "text").alias("_h2")]
    texts = rows.select(*key, F.col("role").alias("_role"), F.col("text").alias("_text")).dropDuplicates(["_h1", "_h2"])
    each = each.join(texts, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    each = each.select("conv_id", "conv", "g", "_role", "_text", F.posexplode(F.split("letters", "")).alias("place", "letter")).where("letter <> 'D'")
    role = F.when(F.lower("letter") == "u", "user").when(F.lower("letter") == "a", "assistant").otherwise(F.col("_role"))
    return chunks, each.select("conv_id", "conv", "g", "place", role.alias("role"), F.when(F.col("letter").isin("u", "a"), "").otherwise(F.col("_text")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by the CRC of conv_id:turn; nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("kind")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_report(conversations: DataFrame, chunk: int = 4096) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A null conv_id is a conversation; null roles and texts count as one space, null turns come first and in no gap. Rows
    of one turn go by role, then by a hash of the text, so that equal ones are neighbours. A conversation with no rows
    left has zeros, an empty audit and the digest of ''. Texts may be very long; extra columns are not read; an empty
    table gives no rows. A conversation of many rows is worked on in chunks, but its digest is computed in one pass over
    its sorted rows, in bounded memory, since a digest can't be put together from parts.
    """
    bounded_batches(conversations.sparkSession)
    rows = damaged(conversations)
    chunks, repaired = edits(rows, chunk)
    count = lambda fault: F.sum(F.length("codes") - F.length(F.translate("codes", "".join(chr(FIRST + 4 * FAULTS.index(fault) + k) for k in range(4)), ""))).alias(fault)
    audit = F.translate(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", F.array_join("letters", "").alias("said")))), lambda x: x["said"]), ""), "UAua", "RRII")
    per = chunks.groupBy("conv_id").agg(F.min("conv").alias("conv"), *[count(f) for f in FAULTS[1:]], F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit"))
    lines = repaired.withColumn("said", F.concat("role", F.lit(":"), "text")).select("conv", "g", "place", "said")
    shas = lines.repartition("conv").sortWithinPartitions("conv", "g", "place").select("conv", "said").mapInPandas(_hashes, "conv long, sha string")
    wide = F.col("most").cast("decimal(38,0)") - F.col("least") + 1 - F.col("turns")
    gaps = rows.groupBy("conv_id").agg(F.max("turn").alias("most"), F.min("turn").alias("least"), F.count_distinct("turn").alias("turns"))
    gaps = gaps.select(F.col("conv_id").alias("_gid"), F.coalesce(F.least(wide, F.lit(2**63 - 1).cast("decimal(38,0)")), F.lit(0)).cast("long").alias("gaps"))
    per = per.join(shas.select(F.col("conv").alias("_conv"), "sha"), F.col("conv") == F.col("_conv"), "left").withColumnRenamed("conv_id", "_pid")
    all_ = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    all_ = all_.join(gaps, F.col("conv_id").eqNullSafe(F.col("_gid")), "left").join(per, F.col("conv_id").eqNullSafe(F.col("_pid")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return all_.select("conv_id", *[zero(c) for c in ("gaps", *FAULTS[1:], "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _oracle() -> str:
    """The same by recursion over rows in DuckDB: a state holds its cost in nine digits and its audit, so that the least
    text is the least audit of the least cost; a second recursion reads the rows off the audit."""
    add = lambda key, cost, letter: f"printf('%09d', CAST(left({key}, 9) AS BIGINT) + {cost}) || substr({key}, 10) || '{letter}'"
    put = lambda key: add(key, INSERT, "I")
    inserted = f"*, least(c3, {put('c2')}) AS d3 FROM (SELECT *, least(s2, {put('s0')}, {put('s1')}, {put('s3')}) AS c2, s3 AS c3 FROM"
    keep = lambda key: add(key, "late", "K")
    rerole = lambda key: add(key, f"{REROLE} + late", "R")
    when = lambda test, value: f"CASE WHEN {test} THEN {value} END"
    to_u = lambda edit: f"least({edit('s0')}, {edit('s1')}, {edit('d3')})"
    return f"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, conv_id::VARCHAR AS c, turn::VARCHAR AS t FROM conversations),
z AS (SELECT unnest(range(256))::BIGINT AS i),
z8 AS (SELECT i, list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM z),
crcs AS (SELECT list(v ORDER BY i) AS v FROM z8),
k AS (SELECT d.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(c, ' ') || ':' || coalesce(t, ' '), ''), lambda x: ord(x)::BIGINT)), lambda a, b: xor(a // 256, crcs.v[xor(a, b) % 256 + 1])), 4294967295) % 20 AS kind FROM d, crcs),
e AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, range(2) rep(n) WHERE kind <> 0 AND n < CASE WHEN kind = 3 THEN 2 ELSE 1 END),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_extract(text, '[^\\x20\\x09-\\x0D](?:[\\x20\\x09-\\x0D]*)$') AS last FROM e),
f AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last[1] NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS was
  FROM r),
g AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS goes, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS late FROM f),
s AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM g
  UNION ALL
  SELECT conv_id, i, {add('s0', DELETE, 'D')},
    least({add('s1', DELETE, 'D')}, {when("NOT goes AND ini = 's'", keep('s0'))}),
    least({add('d2', DELETE, 'D')}, {when("NOT goes AND ini = 'u'", to_u(keep))}, {when("NOT goes", to_u(rerole))}),
    least({add('d3', DELETE, 'D')}, {when("NOT goes AND ini = 'a'", keep('d2'))}, {when("NOT goes", rerole('d2'))})
  FROM (SELECT *, least(c2, {put('d3')}) AS d2 FROM (SELECT {inserted} (SELECT s.s0, s.s1, s.s2, s.s3, g.* FROM s JOIN g ON g.conv_id IS NOT DISTINCT FROM s.conv_id AND g.i = s.i + 1))))),
n AS (SELECT conv_id, count(*) AS n FROM g GROUP BY 1),
best AS (
  SELECT conv_id, CAST(left(w, 9) AS BIGINT) AS cost, substr(w, 10) AS audit
  FROM (SELECT conv_id, least(s0, d3) AS w FROM (SELECT {inserted} (SELECT s.* FROM s JOIN n ON n.conv_id IS NOT DISTINCT FROM s.conv_id AND n.n = s.i))))),
walk AS (
  SELECT conv_id, audit, 0 AS p, 0::BIGINT AS i, '' AS state, ''::VARCHAR AS said FROM best
  UNION ALL
  SELECT conv_id, audit, p, i, CASE letter WHEN 'D' THEN state WHEN 'K' THEN ini ELSE put[1] END,
    CASE letter WHEN 'D' THEN said ELSE said || CASE WHEN said = '' THEN '' ELSE chr(10) END || CASE letter WHEN 'K' THEN role || ':' || text WHEN 'R' THEN put || ':' || text ELSE put || ':' END END
  FROM (
    SELECT x.*, g.ini, g.role, g.text, CASE WHEN x.state = 'u' THEN 'assistant' ELSE 'user' END AS put
    FROM (SELECT conv_id, audit, p + 1 AS p, i + CASE WHEN audit[p + 1] = 'I' THEN 0 ELSE 1 END AS i, audit[p + 1] AS letter, state, said FROM walk WHERE p < length(audit)) x
    LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM x.conv_id AND g.i = x.i)),
fixed AS (SELECT conv_id, said FROM walk WHERE p = length(audit)),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND was || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM g GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN faults ON faults.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM a.conv_id
"""


ORACLE = _oracle()
