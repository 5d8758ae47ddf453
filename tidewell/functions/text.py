"""Column expressions that clean and read texts, metrics, dates and URLs; null for what isn't known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Aliases, parameters and word lists, as text.
UNKNOWN = "- -- — n/a na null none unknown 未知 无".split()
TRACKING = """
utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_name utm_cid utm_reader utm_social utm_viz_id
ga_source ga_medium ga_campaign gclid gclsrc dclid fbclid igshid igsh mibextid spm smid vd_source vd_sid
share_app_id share_link_id share_token _r r is_from_webapp sender_device sender_device_id web_id x_link_source
enter_from enter_method previous_page app_platform more_together_result_id xsec_token xsec_source share_from
spm_id_from pfrom share_source share_medium share_plat share_session_id unique_k up_id timestamp utm_psn utm_oi
oh_share_link weibo_id mod proxy_token ref ref_src ref_url source from sid cid_share scene
""".split()
CONTENT_TYPES = {
    "video": "video 视频 短视频", "image_post": "image imagepost image_post photo 图文 图片 笔记 note", "text_post": "text textpost text_post post 帖子 文字 微博",
    "question": "question 提问 问题", "answer": "answer 回答", "article": "article 文章 专栏",
}
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&hellip;": "…", "&mdash;": "—", "&middot;": "·"}
STOP_WORDS = (
    "the a an and or of to in on for with is are was were be been being this that these those it its as at by from not no yes do does did done "
    "can could should would will won't don't how what why when where who which"
).split()


def known(x: Column) -> Column:
    """The trimmed text, or null if it is empty or one of the words for unknown."""
    t = F.trim(x)
    return F.when((t != "") & ~F.lower(t).isin(UNKNOWN), t)


def parse_metric(x: Column) -> Column:
    """A count as written on a page: separators, one closing counter word, a plus sign, and units of 10^4 and 10^8."""
    s = F.regexp_replace(known(x), r"[,\s_]", "")
    s = F.regexp_replace(F.regexp_replace(s, "(次|个|条|人)$", ""), r"^\+", "")
    shape = r"^(\d+(?:\.\d+)?)(万|亿|w|W)?$"
    number, unit = F.regexp_extract(s, shape, 1).try_cast("double"), F.regexp_extract(s, shape, 2)
    value = number * F.when(unit.isin("万", "w", "W"), 10_000.0).when(unit == "亿", 100_000_000.0).otherwise(1.0)
    return F.floor(value + F.lit(0.5)).cast("long")


def content_type(x: Column) -> Column:
    """The content type of an alias, in any case; null for others."""
    t, out = F.lower(known(x)), F.lit(None).cast("string")
    for name, aliases in CONTENT_TYPES.items():
        out = F.when(t.isin(aliases.split()), name).otherwise(out)
    return out


def hashtags(x: Column) -> Column:
    """Tags of a text split at commas, white space and #, without repetitions in any case; the first spelling stays."""
    parts = F.filter(F.split(F.coalesce(known(x), F.lit("")), r"[,\s、，]+|#+"), lambda p: p != "")
    low = F.transform(parts, lambda p: F.lower(p))
    return F.filter(parts, lambda p, i: F.array_position(low, F.lower(p)) == i + 1)


def inline_hashtags(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"#([^#\s，,、。;；！!？?]+)"), F.lit(1)))


def canonical_url(x: Column) -> Column:
    """An http(s) URL with lower-case host, without default port, fragment, tracking parameters and closing slash.

    A URL without a scheme gets https if it looks like host/path. Other parameters keep their order.
    """
    t = F.trim(x)
    t = F.when(F.regexp_like(t, F.lit(r"^[\w-]+(\.[\w-]+)+/")), F.concat(F.lit("https://"), t)).otherwise(t)
    shape = r"^([Hh][Tt][Tt][Pp][Ss]?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    part = lambda i: F.regexp_extract(t, shape, i)
    scheme, host, path, params = F.lower(part(1)), F.lower(part(2)), part(3), part(4)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    kept = F.filter(F.split(params, "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(TRACKING))
    kept = F.transform(kept, lambda p: F.when(F.instr(p, "=") > 0, p).otherwise(F.concat(p, F.lit("="))))
    tail = F.when(F.size(kept) > 0, F.concat(F.when(path == "", "/").otherwise(path), F.lit("?"), F.array_join(kept, "&"))).otherwise(F.regexp_replace(path, "/$", ""))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, tail))


def plain_title(x: Column) -> Column:
    """Lower case without white space, punctuation and symbols."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[\s\p{P}\p{S}]+", "")


def fingerprint(platform: Column, author: Column, title: Column, published: Column) -> Column:
    """SHA-256 of platform, author, plain title and day; null without a platform or a title."""
    day = F.coalesce(F.date_format(published, "yyyy-MM-dd"), F.lit(""))
    parts = F.concat(platform, F.lit("|"), F.coalesce(author.cast("string"), F.lit("")), F.lit("|"), plain_title(title), F.lit("|"), day)
    return F.when(platform.isNotNull() & (plain_title(title) != ""), F.sha2(parts, 256))


def data_quality(platform: Column, content_id: Column, title: Column, text: Column, published: Column, author: Column, metrics: list[Column]) -> tuple[Column, Column]:
    """(quality, reasons): complete, partial, minimal or invalid, and what is missing, in a fixed order."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    body, measured = ~(blank(title) & blank(text)), F.coalesce(*metrics).isNotNull()
    has = [content_id.isNotNull(), published.isNotNull(), author.isNotNull(), measured]
    every, some = has[0] & has[1] & has[2] & has[3], has[0] | has[1] | has[2] | has[3]
    quality = F.when(platform.isNull() | ~body, "invalid").when(every, "complete").when(~some, "minimal").otherwise("partial")
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    missing = [(content_id.isNull(), "missing_platform_id"), (~body, "missing_body"), (empty(title), "missing_title"), (empty(text), "missing_text"), (~measured, "missing_metrics"), (author.isNull(), "missing_author"), (published.isNull(), "missing_published_at")]
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in missing]))
    return quality, F.when(platform.isNull(), F.array(F.lit("missing_platform_id"))).otherwise(reasons)


def utc_time(x: Column, zone: str | None = None) -> Column:
    """A written time as a UTC timestamp: epoch seconds or milliseconds, an explicit offset, or a local time of the
    declared zone (UTC if none); slashes and the marks 年月日 count as dashes. Impossible dates give null."""
    t = known(x)
    epoch = F.when(F.regexp_like(t, F.lit(r"^\d{9,11}$")), F.timestamp_seconds(t.try_cast("long"))).when(F.regexp_like(t, F.lit(r"^\d{12,17}$")), F.timestamp_millis(t.try_cast("long")))
    dashed = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[年月/]", "-"), "日", ""), "T", " ")
    offset = F.regexp_like(t, F.lit(r"(Z|[+-]\d{2}:?\d{2})$")) & F.regexp_like(t, F.lit(r"\d:\d"))
    zoned = F.when(offset, dashed.try_cast("timestamp"))
    local = F.when(~offset & F.regexp_like(t, F.lit(r"\D")), dashed.try_cast("timestamp_ntz")).cast("timestamp")
    return F.coalesce(epoch, zoned, F.to_utc_timestamp(local, zone or "UTC"))


def strip_html(x: Column) -> Column:
    """The text of a page: scripts and styles out, breaks and block ends as new lines, tags as spaces, entities read."""
    t = F.regexp_replace(F.regexp_replace(x, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<br\s*/?>", "\n"), r"(?i)</(p|div|li|h[1-6])>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, sign in ENTITIES.items():
        if entity != "&amp;":
            t = F.replace(t, F.lit(entity), F.lit(sign))
    codes = F.array_distinct(F.regexp_extract_all(t, F.lit(r"&#\d{1,7};"), F.lit(0)))

    def read(acc: Column, code: Column) -> Column:
        n = F.substring(code, 3, 7).cast("string")
        point = F.regexp_replace(n, ";", "").try_cast("int")
        sign = F.when((point > 0) & (point < 0x110000), F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise(" ")
        return F.replace(acc, code, sign)

    return F.replace(F.aggregate(codes, t, read), F.lit("&amp;"), F.lit("&"))


def squeeze(x: Column) -> Column:
    """White space made plain: tabs as spaces, runs of spaces as one, at most one empty line."""
    t = F.regexp_replace(F.regexp_replace(x, r"\r\n?", "\n"), "[\\t\\x0B\\f\\u00A0\\u200B]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), " {2,}", " "), r"\n{3,}", "\n\n")


def words(x: Column) -> Column:
    """Latin words of two characters or more, stop words left out."""
    found = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"[a-z0-9][a-z0-9'+.-]{1,23}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS))


def excerpt(x: Column, n: int = 80) -> Column:
    t = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("…"))).otherwise(t)


#: Booleans of a text: what a reader would notice. The lexicons are parameters of their language.
FEATURES = {
    "has_question": r"[?？]", "has_number": r"[0-9０-９]", "has_colon": r"[:：]", "has_strong_punctuation": r"[!！]{2,}|[?？]{2,}",
    "has_hashtag": r"#[^#\s]{1,40}", "has_list": r"(^|\n)\s*(\d+[.)]|[-–—])\s|\s[|•]\s", "has_money": r"[¥￥$€£]|\d+\s*(元|块钱|万元)", "has_all_caps": r"[A-Z]{4,}",
}


def features(x: Column) -> dict[str, Column]:
    t = F.coalesce(x, F.lit(""))
    return {k: F.regexp_like(t, F.lit(p)) for k, p in FEATURES.items()}


def lexicon_density(x: Column, lexicon: list[str], cap: int = 3) -> Column:
    """How many of the words a text holds, over cap, 1 at most."""
    hits = sum((F.contains(F.coalesce(x, F.lit("")), F.lit(w)).cast("int") for w in lexicon), F.lit(0))
    return F.least(F.lit(1.0), hits / cap)
