"""The life of a catalogue: imports, candidate resolution, decisions, caches, governance, evidence bundles and lists."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.graph import components, saved
from tidewell.operators.momentum import at


def resolve_incoming(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming (row_no, platform, content_id, canonical, title, text, ...) with status, target and leader.

    A row without platform, or without title and text, is invalid and stays with a note. Others are looked up among
    existing (item_id, platform, content_id, canonical) by platform and id, then by URL: target is that item. Rows of a
    batch that share either with each other, and match nothing stored, are one new item; leader is its first row.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    note = F.when(F.col("platform").isNull(), "no platform").when(blank("title") & blank("text"), "no title and no text")
    rows = saved(incoming.withColumn("note", note))
    good = rows.where("note is null")
    by_id = existing.where("content_id is not null").groupBy(F.col("platform").alias("_p"), F.col("content_id").alias("_c")).agg(F.min("item_id").alias("_by_id"))
    by_url = existing.where("canonical is not null").groupBy(F.col("canonical").alias("_u")).agg(F.min("item_id").alias("_by_url"))
    found = good.join(by_id, (F.col("platform") == F.col("_p")) & (F.col("content_id") == F.col("_c")), "left").join(by_url, F.col("canonical") == F.col("_u"), "left")
    found = saved(found.select("row_no", "platform", "content_id", "canonical", F.coalesce("_by_id", "_by_url").alias("target")))
    free = found.where("target is null")
    links = []
    for keys in (["platform", "content_id"], ["canonical"]):
        some = free.dropna(subset=keys)
        first = some.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("row_no").alias("b"))
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(k) == F.col(f"_{k}"))
        links.append(some.join(first, same).select(F.col("row_no").alias("a"), "b"))
    roots = components(links[0].union(links[1]))
    placed = found.select("row_no", "target").join(roots, F.col("row_no") == F.col("node"), "left").select(F.col("row_no").alias("_r"), "target", F.when(F.col("target").isNull(), F.coalesce("root", "row_no")).alias("leader"))
    out = rows.join(placed, F.col("row_no") == F.col("_r"), "left").drop("_r")
    status = F.when(F.col("note").isNotNull(), "invalid").when(F.col("target").isNotNull(), "merged").when(F.col("leader") == F.col("row_no"), "new").otherwise("duplicate")
    return out.withColumn("status", status)


def resolve_candidates(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates (candidate_id, item_a, item_b, status) after decisions (candidate_id, action, decided_at): the first
    one of each that is pending counts (confirm, not_duplicate or ignore); what was decided before stays."""
    first = decisions.groupBy(F.col("candidate_id").alias("_c")).agg(F.min_by("action", "decided_at").alias("_action"))
    j = candidates.join(first, F.col("candidate_id") == F.col("_c"), "left")
    new = F.when(F.col("_action") == "confirm", "merged").when(F.col("_action") == "not_duplicate", "not_duplicate").when(F.col("_action").isNotNull(), "ignored")
    return j.select("candidate_id", "item_a", "item_b", F.when(F.col("status") == "pending", F.coalesce(new, "status")).otherwise(F.col("status")).alias("status"))


def new_pairs(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    """The pairs (item_a, item_b) that are not stored in either order, smaller id first."""
    ordered = lambda df: df.select(F.least("item_a", "item_b").alias("item_a"), F.greatest("item_a", "item_b").alias("item_b")).distinct()
    return ordered(pairs).join(ordered(stored), ["item_a", "item_b"], "left_anti")


def picks(decisions: DataFrame, scores: DataFrame) -> DataFrame:
    """The current decision of each topic (topic_id, status, decided_at) with the score it had when it was made: the
    latest of scores (topic_id, score, calculated_at) up to that moment."""
    last = decisions.groupBy("topic_id").agg(F.max_by("status", "decided_at").alias("status"), F.max("decided_at").alias("decided_at"))
    s = scores.select(F.col("topic_id").alias("_t"), "score", "calculated_at")
    j = last.join(s, (F.col("topic_id") == F.col("_t")) & (F.col("calculated_at") <= F.col("decided_at")), "left")
    return j.groupBy("topic_id", "status", "decided_at").agg(F.max_by("score", "calculated_at").alias("decision_score"))


def to_compute(items: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Items (item_id, text_hash) whose features of a version are not cached under that text (item_id, version, text_hash)."""
    return items.join(cache.where(F.col("version") == version).select("item_id", "text_hash").distinct(), ["item_id", "text_hash"], "left_anti")


def governed(members: DataFrame, acts: DataFrame) -> DataFrame:
    """Members (topic_id, item_id, space) after acts (kind, topic_id, item_id, to_topic, at): the last act on an item
    counts. move and split put one item into a topic and lock it there; merge puts a topic's other items into another
    one of the same space, and is refused across spaces. Columns: item_id, topic_id, locked."""
    own = acts.where(F.col("kind").isin("move", "split") & F.col("item_id").isNotNull()).groupBy(F.col("item_id").alias("_i")).agg(F.max_by("to_topic", "at").alias("_own"))
    whole = acts.where("kind = 'merge'").groupBy(F.col("topic_id").alias("_t")).agg(F.max_by("to_topic", "at").alias("_whole"))
    spaces = members.groupBy(F.col("topic_id").alias("_to")).agg(F.min("space").alias("_space"))
    whole = whole.join(spaces, F.col("_whole") == F.col("_to"), "left").drop("_to")
    j = members.join(own, F.col("item_id") == F.col("_i"), "left").join(whole, F.col("topic_id") == F.col("_t"), "left")
    return j.select("item_id", F.coalesce("_own", F.when(F.col("_space") == F.col("space"), F.col("_whole")), "topic_id").alias("topic_id"), F.col("_own").isNotNull().alias("locked"))


def topics_after(topics: DataFrame, acts: DataFrame, members: DataFrame) -> DataFrame:
    """Topics (topic_id, name) after acts (kind, topic_id, name, at): the last rename counts (a blank one doesn't), the last
    of watch and unwatch says whether it is watched, and members are counted anew from members (topic_id, item_id).
    Topics that only members know appear without a name. Columns: topic_id, name, watched, members."""
    named = acts.where((F.col("kind") == "rename") & (F.trim("name") != "")).groupBy(F.col("topic_id").alias("_n")).agg(F.max_by("name", "at").alias("_name"))
    watch = acts.where(F.col("kind").isin("watch", "unwatch")).groupBy(F.col("topic_id").alias("_w")).agg((F.max_by("kind", "at") == "watch").alias("_watched"))
    count = members.groupBy(F.col("topic_id").alias("_m")).agg(F.count_distinct("item_id").alias("_count"))
    j = topics.join(count, F.col("topic_id") == F.col("_m"), "full").withColumn("topic_id", F.coalesce("topic_id", "_m"))
    j = j.join(named, F.col("topic_id") == F.col("_n"), "left").join(watch, F.col("topic_id") == F.col("_w"), "left")
    return j.select("topic_id", F.coalesce("_name", "name").alias("name"), F.coalesce("_watched", F.lit(False)).alias("watched"), F.coalesce("_count", F.lit(0)).alias("members"))


def named_or_numbered(rows: DataFrame, asked: str, name: str, number: str) -> DataFrame:
    """Rows whose author's name or id holds what is asked, in any case."""
    some = asked.lower()
    return rows.where(F.coalesce(F.contains(F.lower(F.col(name)), F.lit(some)), F.lit(False)) | F.coalesce(F.contains(F.lower(F.col(number).cast("string")), F.lit(some)), F.lit(False)))


def page(rows: DataFrame, keys: list[Column], size: int, number: int = 1) -> DataFrame:
    """A page of rows in the order of keys, with total, how many rows there are in all."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    return rows.orderBy(*keys).offset(size * (number - 1)).limit(size).join(F.broadcast(total))


def until_day_end(stamp: Column, day: str) -> Column:
    """Whether a time is not after a bare day, that day included."""
    return stamp < F.date_add(F.to_date(F.lit(day)), 1)


def author_share(members: DataFrame) -> DataFrame:
    """(topic_id, max_share): the largest author's share of a topic's members; unknown authors count in the whole."""
    per = members.groupBy("topic_id", "author_id").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("topic_id").agg((F.max(F.when(F.col("author_id").isNotNull(), F.col("c"))) / F.sum("c")).alias("max_share"))


def last_known(rows: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Each key's last non-null value of each column, by order."""
    return rows.groupBy(key).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values])


def band(score: Column) -> Column:
    """low under 34, medium under 67, high from there; null for unknown."""
    return F.when(score < 34, "low").when(score < 67, "medium").when(score.isNotNull(), "high")


def by_evidence(quality: Column, effect: Column) -> list[Column]:
    """The order of patterns: better evidence first, then the larger effect."""
    rank = F.when(quality == "high", 0).when(quality == "medium", 1).when(quality == "low", 2).otherwise(3)
    return [rank.asc(), F.abs(effect).desc_nulls_last()]


def hot_queries(titles: DataFrame, phrase: Column, now: dt.datetime, asked: DataFrame, hours: int = 24, cooldown: int = 6) -> DataFrame:
    """(item_id, phrase): search phrases of the titles (item_id, title, published_at) of the last hours, newest first one
    per first eight characters, without those asked (phrase, asked_at) within the cooldown."""
    rows = titles.where((F.col("published_at") > at(now, hours=hours)) & (F.col("published_at") <= at(now))).withColumn("phrase", phrase).where("phrase is not null")
    cold = asked.where(F.col("asked_at") > at(now, hours=cooldown)).select("phrase").distinct()
    rows = rows.join(cold, "phrase", "left_anti")
    newest = F.struct("published_at", (-F.col("item_id")).alias("k"))
    return rows.groupBy(F.left("phrase", F.lit(8)).alias("_k")).agg(F.max_by(F.struct("item_id", "phrase"), newest).alias("r")).select("r.item_id", "r.phrase")


def evidence(parts: dict[str, tuple[DataFrame, int]], budget: int = 12_000) -> DataFrame:
    """The evidence bundle of each topic: topic_id, ref_id, line, kept.

    parts, the more important first: name -> (topic_id, line, rank columns as a sortable struct `k`), how many at most.
    The best of each part are numbered (name-1, name-2, ...). If a topic's lines are longer than the budget, the parts
    after the first lose their lower half, the last one first, and then what still does not fit from the end.
    """
    out = None
    for i, (name, (rows, most)) in enumerate(parts.items()):
        w = Window.partitionBy("topic_id").orderBy("k")
        some = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("topic_id", F.lit(i).alias("part"), "r", F.concat(F.lit(f"{name}-"), "r").alias("ref_id"), "line")
        out = some if out is None else out.unionByName(some)
    by = Window.partitionBy("topic_id")
    out = out.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("topic_id", "part"))).withColumn("lower", (F.col("part") > 0) & (F.col("r") > F.ceil(F.col("n") / 2)))
    out = out.withColumn("chars", F.length("line")).withColumn("all", F.sum("chars").over(by))
    order = Window.partitionBy("topic_id").orderBy("lower", "part", "r").rowsBetween(Window.unboundedPreceding, 0)
    return out.select("topic_id", "ref_id", "line", ((F.col("all") <= budget) | (F.sum("chars").over(order) <= budget)).alias("kept"))


def analysis_status(items: DataFrame, vectors: DataFrame, members: DataFrame, scores: DataFrame, trends: DataFrame) -> DataFrame:
    """One row on how far the analysis is, every count by the rule of the step that needs it.

    items (item_id, source, made, captured_at, published_at, author_id, likes): made marks demonstration data. vectors
    (item_id): the live ones of the active space. members (item_id, topic_id), scores (item_id, score), trends (topic_id,
    score): a null score counts as not scored. next_step names the first of collect, embed, cluster, score, trend that is
    not complete, or is null. One aggregate a table and two anti joins.
    """
    c = F.col
    n = items.agg(F.count(F.lit(1)).alias("contents"), F.count_distinct("source").alias("sources"), F.count_if("made").alias("_made"), F.max("captured_at").alias("latest"), F.count_if(c("published_at").isNull()).alias("without_time"), F.count_if(c("author_id").isNull()).alias("without_author"), F.count_if(c("likes").isNull()).alias("without_metric"))
    lacking = lambda other, name: items.select("item_id").join(other.select(c("item_id").alias("_o")).distinct(), c("item_id") == c("_o"), "left_anti").agg(F.count(F.lit(1)).alias(name))
    topics = members.agg(F.count_distinct("topic_id").alias("topics"))
    scored = scores.agg(F.count("score").alias("scored"))
    trended = trends.agg(F.count("score").alias("trended"))
    j = n
    for one in (lacking(vectors, "pending"), lacking(members, "unclustered"), topics, scored, trended):
        j = j.join(F.broadcast(one))  # one row each
    share = lambda part, whole: F.when(whole > 0, F.floor(part * 1000 / whole + 0.5) / 10)
    step = F.when(c("contents") == 0, "collect").when(c("pending") > 0, "embed").when(c("topics") == 0, "cluster").when(c("scored") == 0, "score").when(c("trended") < c("topics"), "trend")
    return j.select("contents", "sources", share(c("_made"), c("contents")).alias("made_share"), "latest", "without_time", "without_author", "without_metric", (c("contents") - c("pending")).alias("embedded"), "pending", "unclustered", "topics", share(c("scored"), c("contents")).alias("scored_share"), share(c("trended"), c("topics")).alias("trended_share"), step.alias("next_step"))


#: How an evidence bundle that is too long is cut down, step by step: parts lose their lower half until so few are left.
TRIMMING = (("representative", 1), ("burst", 1), ("pattern", 2), ("angle", 1))


def staged_evidence(parts: dict[str, tuple[DataFrame, int]], budget: int | Column = 12_000, excerpt: int = 80) -> DataFrame:
    """The evidence bundle of each topic, trimmed in stages: topic_id, ref_id, line, kept, trimmed, over.

    parts: name -> (topic_id, line, rank columns as a sortable struct `k`), how many at most; budget may depend on
    topic_id. While a topic's lines are
    longer than the budget, bursts are first cut to an excerpt, then parts are halved in the order of TRIMMING, each
    until its least number is reached; what is dropped keeps its line with kept false. trimmed says whether anything of the
    part was cut, over whether the bundle is too long even so. A topic's lines, `most` of each part, are one small group.
    """
    out = None
    for i, (name, (rows, most)) in enumerate(parts.items()):
        w = Window.partitionBy("topic_id").orderBy("k")
        some = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("topic_id", F.lit(name).alias("part"), "r", "line")
        out = some if out is None else out.unionByName(some)
    kind, out = dict(out.dtypes)["topic_id"], out.withColumn("budget", budget if isinstance(budget, Column) else F.lit(budget))

    def trim(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, most = pdf.sort_values(["part", "r"]).reset_index(drop=True), pdf["budget"].iloc[0]
        lines = {name: mine["line"].tolist() for name, mine in pdf.groupby("part")}
        n = {name: len(mine) for name, mine in lines.items()}
        short = [f"{x[:excerpt]}…" if len(x) > excerpt + 1 else x for x in lines.get("burst", [])]
        cut = False
        size = lambda: sum(len(x) for name, mine in lines.items() for x in (short if cut and name == "burst" else mine)[: n[name]])
        while size() > most:
            if not cut and short != lines.get("burst", []):
                cut = True
                continue
            part = next((name for name, least in TRIMMING if n.get(name, 0) > least), None)
            if part is None:
                break
            n[part] = -(-n[part] // 2)
        kept = pdf["r"] <= pdf["part"].map(n)
        line = [short[r - 1] if cut and p == "burst" else x for p, r, x in zip(pdf["part"], pdf["r"], pdf["line"])]
        trimmed = pdf["part"].map(lambda p: n[p] < len(lines[p]) or (cut and p == "burst"))
        return pd.DataFrame({"topic_id": pdf["topic_id"], "ref_id": pdf["part"] + "-" + pdf["r"].astype(str), "line": line, "kept": kept, "trimmed": trimmed, "over": size() > most})

    return out.groupBy("topic_id").applyInPandas(trim, f"topic_id {kind}, ref_id string, line string, kept boolean, trimmed boolean, over boolean")


def unknown_refs(refs: DataFrame, known: DataFrame) -> DataFrame:
    """References (topic_id, ref_id) that the topic's evidence (topic_id, ref_id) does not have."""
    return refs.distinct().join(known.select("topic_id", "ref_id").distinct(), ["topic_id", "ref_id"], "left_anti")
