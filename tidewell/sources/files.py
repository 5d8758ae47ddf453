"""Files in and out: delimited text, JSON, envelopes, feeds; header mapping; exports and reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.functions import text as T

#: Aliases of the canonical fields, the earliest that fits wins.
ALIASES = {
    "content_id": "contentid id itemid noteid awemeid targetid docid 内容id",
    "title": "title headline 标题 视频标题 笔记题目",
    "text": "text body content description 正文 视频描述 笔记正文",
    "url": "url link href 链接 分享链接",
    "author_id": "authorid userid uid 作者id 作者uid",
    "author_name": "author authorname nickname source 作者 博主昵称",
    "published_at": "publishedat pubdate createdtime created date 发布时间 发布日期",
    "content_type": "contenttype type objtype 类型",
    "platform": "platform lang 平台",
    "hashtags": "hashtags tags 标签 话题",
    "views": "views plays 播放量 阅读量 浏览量",
    "likes": "likes nchars 点赞数 点赞 赞",
    "comments": "comments 评论数 评论 条评论",
    "shares": "shares 分享数 转发",
    "favorites": "favorites 收藏数 收藏",
    "upvotes": "upvotes voteupcount 赞同数",
}
METRICS = ("views", "likes", "comments", "shares", "favorites", "upvotes")


def read_delimited(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str = ",") -> DataFrame:
    """Delimited text with a header. Rows that don't fit stay, with the whole line in _corrupt; names are trimmed."""
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("multiLine", True).option("escape", '"')
    if schema is not None:
        kind = schema if isinstance(schema, str) else schema.simpleString()[7:-1].replace(":", " ")
        reader = reader.option("columnNameOfCorruptRecord", "_corrupt").schema(f"{kind}, _corrupt string")
    df = reader.csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def read_json(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    return spark.read.option("multiLine", not lines).json(path)


def read_envelope(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Files of the form {name, platform, rows: [...]}, or with such a value a line: a row per element, with the
    envelope's name and platform."""
    df = spark.read.option("multiLine", not lines).json(path)
    return df.select(F.col("name").alias("envelope"), F.col("platform").alias("envelope_platform"), F.explode("rows").alias("row")).select("envelope", "envelope_platform", "row.*")


def manual_record(spark: SparkSession, record: dict, schema: str) -> DataFrame:
    """One record that somebody typed in, as a frame of the schema; names outside it and values of other types raise."""
    kind = StructType.fromDDL(schema)
    if bad := set(record) - set(kind.names):
        raise ValueError(f"fields not known: {sorted(bad)}")
    return spark.createDataFrame([tuple(record.get(n) for n in kind.names)], kind)


def two_shapes(rows: DataFrame) -> DataFrame:
    """Rows of JSON (raw) of two shapes, search results {type, id, title, voteup_count} and hot lists {target: {type, id,
    title}, detail_text}, as content_id (type:id), title, upvotes and heat; what a shape lacks is null."""
    at = lambda path: F.get_json_object("raw", path)
    both = lambda name: F.coalesce(at(f"$.target.{name}"), at(f"$.{name}"))
    key = F.when(both("id").isNotNull(), F.concat_ws(":", F.coalesce(both("type"), F.lit("unknown")), both("id")))
    return rows.select(key.alias("content_id"), both("title").alias("title"), T.parse_metric(at("$.voteup_count")).alias("upvotes"), T.parse_metric(F.regexp_replace(at("$.detail_text"), r"\s*热度$", "")).alias("heat"))


def read_feed(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """Items of XML feeds, or entries of Atom ones (tag="entry"): title, link, description, pubDate; those without a title
    and a link are left out."""
    if tag == "entry":
        df = spark.read.format("xml").option("rowTag", tag).schema("title string, link struct<_href: string>, summary string, content string, published string, updated string").load(path)
        df = df.select("title", F.col("link._href").alias("link"), F.coalesce("summary", "content").alias("description"), F.coalesce("published", "updated").alias("pubDate"))
    else:
        df = spark.read.format("xml").option("rowTag", tag).schema("title string, link string, description string, pubDate string, guid string").load(path)
    return df.where(F.coalesce("title", "link").isNotNull()).select("title", T.canonical_url(F.col("link")).alias("url"), T.strip_html(F.col("description")).alias("text"), T.utc_time(F.col("pubDate")).alias("published_at"))


def mapping(columns: list[str]) -> dict[str, str]:
    """Canonical field -> column, guessed from the header; a column serves one field only."""
    plain = {c: re.sub(r"\d+$", "", re.sub(r"[\s_\-]", "", c.lower())) for c in columns}
    out: dict[str, str] = {}
    for name, aliases in ALIASES.items():
        for alias in aliases.split():
            got = next((c for c, p in plain.items() if p == alias and c not in out.values()), None)
            if got is not None:
                out[name] = got
                break
    return out


def normalised(df: DataFrame, fields: dict[str, str] | None = None, zone: str | None = None) -> DataFrame:
    """Raw rows as canonical ones: cleaned texts, parsed metrics (unknown stays null), UTC times, canonical URLs."""
    got = fields or mapping(df.columns)
    col = lambda f: F.col(f"`{got[f]}`").cast("string") if f in got else F.lit(None).cast("string")
    clean = lambda f: F.nullif(F.trim(col(f)), F.lit(""))
    tags = T.hashtags(col("hashtags")) if "hashtags" in got else T.inline_hashtags(col("text"))
    return df.select(
        clean("content_id").alias("content_id"), clean("platform").alias("platform"), T.content_type(col("content_type")).alias("content_type"), clean("title").alias("title"), clean("text").alias("text"),
        T.canonical_url(col("url")).alias("url"), clean("author_id").alias("author_id"), clean("author_name").alias("author_name"), T.utc_time(col("published_at"), zone).alias("published_at"),
        tags.alias("hashtags"), *[T.parse_metric(col(m)).alias(m) for m in METRICS],
    )


def keyed_records(raw: DataFrame, fields: dict[str, str], text_col: str = "value") -> DataFrame:
    """Records as JSON text by a mapping (field -> key): a field takes its key's value, or, where a record lacks the key,
    that of the first key that is the same in another case. All values are texts; what is no JSON object gives nulls."""
    m = F.from_json(F.col(text_col), "map<string,string>")
    rows = raw.select(m.alias("_m")).withColumn("_e", F.map_entries("_m"))

    def field(key: str):
        other = F.get(F.filter("_e", lambda e: F.lower(e["key"]) == key.lower()), F.lit(0))["value"]
        return F.when(F.map_contains_key("_m", F.lit(key)), F.try_element_at("_m", F.lit(key))).otherwise(other)

    return rows.select(*[field(key).alias(name) for name, key in fields.items()])


def export(df: DataFrame, path: str, columns: list[str], allowed: set[str], kind: str = "csv", most: int | None = None) -> dict[str, int | bool]:
    """Writes allowed columns, up to `most` rows if asked, and tells how many rows there are and whether some are left out."""
    if bad := set(columns) - allowed:
        raise ValueError(f"columns not allowed: {sorted(bad)}")
    total = df.count()
    out = df.select(*columns)
    out = out.limit(most) if most is not None else out
    (out.write.mode("overwrite").option("header", True).csv if kind == "csv" else out.write.mode("overwrite").json)(path)
    return {"total": total, "truncated": most is not None and total > most}


def report(title: str, parts: dict[str, DataFrame], most: int = 20) -> str:
    """A Markdown report of the first rows of small result tables."""
    out = [f"# {title}"]
    for name, df in parts.items():
        rows = df.limit(most).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows]
    return "\n".join(out) + "\n"
