"""Secret scanning with character Markov models, in DataFrame functions only.

Known shapes (assignments, access keys, long hex) are found by pattern. On top, the log-likelihood ratio of two
first-order Markov models, one of random strings and one of ordinary identifiers, is summed along every long run of key
characters that is left; the stretches where it gains most are the added spans. Both models are counted by Spark from
labelled samples: matches of the patterns and generated digests on one side, the words around them on the other.

Time grows with a text's length (n log n for the offsets of many matches), also in one run of a megabyte.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_crc

#: The patterns of the base kinds, in their order; the value of an assignment is its group 1.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
RUN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
NAME = r"[A-Za-z0-9+/_-]{4,}={0,2}"
BREAKS = "/_-"  # where a word within a run ends
EDGE = 4  # a stretch that begins or ends so near its word's edge takes the rest of the word in
SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def running(lengths: Column) -> Column:
    """The running sums of an array of whole numbers by doubling: n log n steps, however long the array."""
    turns = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(lengths), F.lit(1)).cast("double"))).cast("int"))

    def back(acc: Column, i: Column, k: Column) -> Column:
        far = F.call_function("shiftleft", F.lit(1), k)
        return F.when(i >= far, F.get(acc, i - far)).otherwise(F.lit(0))

    return F.aggregate(turns, lengths, lambda acc, k: F.transform(acc, lambda x, i: x + back(acc, i, k)))


def _spans(df: DataFrame, text: str, pattern: str, kind: int, into: str, group: int = 0, least: int = 0, rest: str | None = None) -> DataFrame:
    """df with the array `into` of (start, kind, end, value) of the pattern's matches in the column text, offsets in
    code points, values under `least` dropped; and, if asked, `rest`, the text with those matches blanked out.

    Matches and the pieces between them alternate, so the running sums of their lengths give every offset. Steps are
    columns of their own, so that nothing is computed twice; a text without a match goes by all of them.
    """
    pat = F.lit(pattern)
    df = df.withColumn("_tw_hit", F.when(F.regexp_like(text, pat), F.regexp_extract_all(text, pat, F.lit(0))))
    df = df.withColumn("_tw_value", F.when(F.col("_tw_hit").isNotNull(), F.regexp_extract_all(text, pat, F.lit(group))) if group else F.col("_tw_hit"))
    df = df.withColumn("_tw_gap", F.when(F.col("_tw_hit").isNotNull(), F.split(text, pattern, -1)))
    df = df.withColumn("_tw_len", F.zip_with("_tw_gap", "_tw_hit", lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0))))
    df = df.withColumn("_tw_end", F.slice(running(F.col("_tw_len")), F.lit(1), F.size("_tw_hit")))
    df = df.withColumn("_tw_part", F.arrays_zip(F.col("_tw_hit").alias("hit"), F.col("_tw_value").alias("value"), F.col("_tw_end").alias("end")))
    span = lambda p: F.struct((p["end"] - F.length(p["hit"])).alias("start"), F.lit(kind).alias("kind"), p["end"].alias("end"), p["value"].alias("value"))
    df = df.withColumn(into, F.coalesce(F.transform(F.filter("_tw_part", lambda p: F.length(p["value"]) >= least), span), F.array().cast(SPANS)))
    if rest:
        blank = F.zip_with("_tw_hit", "_tw_value", lambda h, v: F.when(F.length(v) >= least, F.repeat(F.lit(" "), F.length(h))).otherwise(h))
        df = df.withColumn(rest, F.coalesce(F.array_join(F.zip_with("_tw_gap", blank, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), ""), F.col(text)))
    return df.drop("_tw_hit", "_tw_value", "_tw_gap", "_tw_len", "_tw_end", "_tw_part")


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """df with _tw_base, the base kinds' spans of the column text (leftmost and non-overlapping per kind, too short
    ones dropped), and _tw_rest, the text with all of them blanked out, as long as before."""
    df = _spans(df, text, ASSIGN, 0, "_tw_b0", 1, 6, rest="_tw_r0")
    df = _spans(_spans(df, text, ACCESS, 1, "_tw_b1"), text, HEX, 2, "_tw_b2")
    df = _spans(df, "_tw_r0", f"{ACCESS}|{HEX}", 2, "_tw_b3", rest="_tw_rest")
    return df.withColumn("_tw_base", F.concat("_tw_b0", "_tw_b1", "_tw_b2")).drop("_tw_b0", "_tw_b1", "_tw_b2", "_tw_b3", "_tw_r0")


def _evenly(parts: Column, most: int) -> Column:
    """At most `most` elements of an array, at even distances from its first to its last part."""
    return F.when(F.size(parts) <= most, parts).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(parts, F.floor(i * F.size(parts) / most).cast("int"))))


def _names(words: Column, most: int) -> Column:
    """Identifiers of three to six words each, as programmers write them: joined by _, - or /, in capitals by _, or
    written together with capitals; at most `most`, from places at even distances."""
    n = F.least(F.lit(most), F.floor(F.size(words) / 3)).cast("int")

    def name(i: Column) -> Column:
        some = F.slice(words, F.floor(i * F.size(words) / n).cast("int") + 1, 3 + F.pmod(i, F.lit(4)))
        low, style = F.transform(some, lambda w: F.lower(w)), F.pmod(i, F.lit(5))
        joined = F.array_join(F.transform(some, lambda w: F.initcap(w)), "")
        for k, sign in enumerate(BREAKS):
            joined = F.when(style == k, F.array_join(low, sign)).otherwise(joined)
        return F.when(style == len(BREAKS), F.array_join(F.transform(some, lambda w: F.upper(w)), "_")).otherwise(joined)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), name)).otherwise(F.array().cast("array<string>"))


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 20_000, chars: int = 32_000_000, each: int = 64, seed: str = "secret") -> DataFrame:
    """Labelled strings (random, value, n), n times each. The fit is bounded by its sample: documents are chosen by a
    hash, about `rows` with about `chars` characters at most, and each gives at most `each` strings of a kind.

    random: values that the base patterns match, and two digests a document (hex and base64). ordinary: the
    identifiers left when those matches are cut out, and names made of a text's words.
    """
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = picked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    share = min(rows / max(1, size["n"]), chars / max(1, size["chars"] or 0))
    if share < 1:
        picked = picked.where(id_crc(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))) < F.lit(int(2**32 * share)))
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    made = F.array(F.substring(digest, 1, 40), F.substring(F.base64(F.unhex(digest)), 1, 40))
    picked = base_spans(picked.repartition(F.col("id")), "text").select("id", "_tw_base", "_tw_rest")
    picked = picked.withColumn("words", F.regexp_extract_all("_tw_rest", F.lit("[A-Za-z]{2,20}"), F.lit(0))).withColumn("names", F.regexp_extract_all("_tw_rest", F.lit(NAME), F.lit(0)))
    drawn = F.transform(F.concat(made, _evenly(F.transform("_tw_base", lambda s: s["value"]), each)), lambda v: F.struct(F.lit(1).alias("random"), v.alias("value")))
    plain = F.transform(F.concat(_evenly(F.col("names"), each), _names(F.col("words"), each)), lambda v: F.struct(F.lit(0).alias("random"), v.alias("value")))
    return picked.select(F.explode(F.concat(drawn, plain)).alias("x")).groupBy("x.random", "x.value").agg(F.count(F.lit(1)).alias("n"))


def fit(labelled: DataFrame, even: float = 0.1) -> list[float]:
    """Log-likelihood ratios of the alphabet's transitions, row by row, from strings (random, value), n times each if there is a column n.

    A tenth of each model is the even distribution, which bounds what one unseen transition can say; with no samples
    every ratio is 0 and nothing is added. What comes to the driver is two counts per transition.
    """
    n = len(ALPHABET)
    labelled = labelled if "n" in labelled.columns else labelled.withColumn("n", F.lit(1))
    signs = labelled.where("length(value) > 1").select("random", "n", F.split("value", "").alias("signs"))
    most = F.size("signs") - 1
    pairs = signs.select("random", "n", F.explode(F.zip_with(F.slice("signs", F.lit(1), most), F.slice("signs", F.lit(2), most), lambda a, b: F.concat(a, b))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["all"] for r in pairs.where(F.regexp_like("pair", F.lit("^[A-Za-z0-9+/_=-]{2}$"))).groupBy("random", "pair").agg(F.sum("n").alias("all")).collect()}
    table = []
    for a in ALPHABET:
        logs = []
        for k in (1, 0):
            of = [counts.get((k, a + b), 0) for b in ALPHABET]
            logs.append([math.log((1 - even) * (c / sum(of) if any(of) else 1 / n) + even / n) for c in of])
        table += [r - o for r, o in zip(*logs)]
    return table


def _stretches(table: list[float], threshold: float) -> str:
    """SQL over a run s (start, value): an array of (start, end) within it, where the ratio gains `threshold` or more.

    One fold over the transitions keeps the gain since the last fall to zero and the most it has been; when it falls
    to zero, or by twice the threshold from its most, the stretch up to there is complete. What the fold holds: i (the
    character), word (start of its word), cur and since, best with since and upto, and what is found.
    """
    numbers, n = ",".join(f"{x:.5f}" for x in table), len(ALPHABET)
    codes = f"transform(split(s.value, ''), c -> instr('{ALPHABET}', c))"
    breaks = ", ".join(str(ALPHABET.index(c) + 1) for c in BREAKS)
    step = f"named_struct('r', element_at(split('{numbers}', ',')::array<double>, (a - 1) * {n} + b), 'ends', a IN ({breaks}))"
    steps = f"zip_with(slice({codes}, 1, length(s.value) - 1), slice({codes}, 2, length(s.value) - 1), (a, b) -> {step})"
    cur = "acc.cur + x.r"
    word = "if(x.ends, acc.i + 1, acc.word)"
    upto = f"if(x.ends AND acc.upto > acc.word AND acc.i - acc.upto BETWEEN 0 AND {EDGE}, acc.i, acc.upto)"
    found = f"if(acc.best >= {threshold!r}D, concat(acc.found, array(named_struct('start', acc.since0, 'end', {upto}))), acc.found)"
    since = f"greatest(if(acc.i + 1 - {word} <= {EDGE}, {word}, acc.i + 1), if(acc.best >= {threshold!r}D, {upto}, 0))"
    state = lambda *parts: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in zip(("i", "word", "cur", "since", "best", "since0", "upto", "found"), parts)) + ")"
    none = "cast(array() AS array<struct<start:int,end:int>>)"
    over = state("acc.i + 1", word, "0D", since, "0D", "0", "0", found)
    more = state("acc.i + 1", word, cur, "acc.since", cur, "acc.since", "acc.i + 2", "acc.found")
    same = state("acc.i + 1", word, cur, "acc.since", "acc.best", "acc.since0", upto, "acc.found")
    merge = f"CASE WHEN {cur} <= 0 OR acc.best - ({cur}) >= {2 * threshold!r}D THEN {over} WHEN {cur} > acc.best THEN {more} ELSE {same} END"
    last = f"if(acc.upto > acc.word AND acc.i + 1 - acc.upto <= {EDGE}, acc.i + 1, acc.upto)"
    end = f"if(acc.best >= {threshold!r}D, concat(acc.found, array(named_struct('start', acc.since0, 'end', {last}))), acc.found)"
    return f"aggregate({steps}, {state('0', '0', '0D', '0', '0D', '0', '0', none)}, (acc, x) -> {merge}, acc -> {end})"


def scan(docs: DataFrame, table: list[float], text_col: str = "text", threshold: float = 15.0, into: str = "_tw_spans") -> DataFrame:
    """docs with an array of (start, kind, end, value) sorted by start, then kind; every column kept.

    Null text counts as empty. Kind markov is added for each stretch of a run whose ratio reaches the threshold (in
    nats); runs are looked for where no base span is, and base spans always stay. Columns named _tw_* are replaced.
    """
    rows = base_spans(docs.withColumn("_tw_text", F.coalesce(F.col(text_col), F.lit(""))), "_tw_text")
    rows = _spans(rows, "_tw_rest", RUN, 3, "_tw_runs")
    cut = "named_struct('start', s.start + p.start, 'kind', 3, 'end', s.start + p.end, 'value', substring(s.value, p.start + 1, p.end - p.start))"
    rows = rows.withColumn("_tw_more", F.expr(f"flatten(transform(_tw_runs, s -> transform({_stretches(table, threshold)}, p -> {cut})))"))
    return rows.withColumn(into, F.array_sort(F.concat("_tw_base", "_tw_more"))).drop("_tw_text", "_tw_base", "_tw_rest", "_tw_runs", "_tw_more")


def scan_report(docs: DataFrame, **how) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    Spans read kind:start:end, by start and then kind, comma-joined; a text without spans has '' (and the digest
    of ''). Null text counts as empty; other columns are not read; an empty table gives no rows.
    """
    rows = scan(docs.select("doc_id", "text"), fit(samples(docs)), **how)
    names = "array({})".format(", ".join(f"'{k}'" for k in KINDS))
    said = f"array_join(transform({{}}, s -> concat(element_at({names}, s.kind + 1), ':', s.start, ':', s.end)), ',')"
    count = lambda k: F.expr(f"size(filter(_tw_spans, s -> s.kind = {k}))").cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(F.expr(said.format("filter(_tw_spans, s -> s.kind < 3)")).cast("binary"), 256).alias("base_sha256"), F.expr(said.format("_tw_spans")).alias("spans"), count(3).alias("n_markov"))
