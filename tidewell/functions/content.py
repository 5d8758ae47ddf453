"""Column expressions that read and build content texts: cleaning, Han tokens, semantic texts, features by lexicon."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import known, squeeze, words

# Aliases, labels, stop characters, word lists and patterns, as text.
PLATFORMS = {
    "douyin": "douyin 抖音 dy tiktok", "xiaohongshu": "xiaohongshu 小红书 xhs rednote", "zhihu": "zhihu 知乎", "bilibili": "bilibili b站 bili", "weibo": "weibo 微博",
    "toutiao": "toutiao", "baidu": "baidu", "ithome": "ithome", "douban": "douban", "tieba": "tieba", "manual": "manual 手动 手工", "other": "other 其他",
}
PLATFORM_LABELS = {"douyin": "抖音", "xiaohongshu": "小红书", "zhihu": "知乎", "bilibili": "B站", "weibo": "微博", "toutiao": "今日头条", "baidu": "百度热搜", "ithome": "IT之家", "douban": "豆瓣", "tieba": "百度贴吧", "manual": "手动", "other": "其他"}
LEVEL_LABELS = {"high": "高", "medium": "中", "low": "低", "insufficient": "数据不足"}
STOP_CHARS = "的了是我你他她它你们我们他们这那也都就在有和跟对为至于把被让使从向于关于由於由于如果虽然但是所以因为而且并且或者及以及等等吗呢吧啊呀哦嗯呗啦呐是与不是会不会能不能要不要怎样怎么样如何可以可能应该必须需要非常真的太最更很挺蛮还又再才只就都还便即即立刻马上今天昨天明天现在之前之后时候东西事情问题感觉觉得认为知道明白了解看看试试想想说说做做用用东西方面"
TEMPLATE = "讨论 内容 分享 相关 话题 问题 建议 经验 攻略 视频 分析 教程 报告 使用 解决 怎么 办法 推荐 对比 评测 指南 清单 规划 技巧 方法 情况 进行 可以 应该 大家 东西 时候 文章 帖子 一下 一些 这个 那个 有什么 不知道 觉得 感觉 真的 是不是 为什么 如何".split()
REGIONS = "北京 上海 广州 深圳 杭州 成都 重庆 武汉 西安 南京 苏州 天津 长沙 郑州 青岛 厦门 合肥 佛山 东莞 昆明 大连 沈阳 哈尔滨 三亚 香港 澳门 台湾 日本 韩国 泰国 美国 欧洲 东南亚 省 市 县 国 城 村".split()
IDENTITIES = "大学生 研究生 博士生 宝妈 孕妇 上班族 打工人 应届生 应届 北漂 沪漂 深漂 程序员 产品经理 设计师 老师 医生 护士 女生 男生 女孩 男孩 情侣 夫妻 新手 小白 老手 中年 老年 00后 95后 90后 80后 学生党 工薪 租房 独居".split()
SEMANTIC = {
    "conflict_intensity": ("吵架 吵翻 撕 矛盾 冲突 开撕 互怼 怼 争 吵架了 翻脸 冷战", 3), "controversy": ("争议 三观 站哪边 谁对 错的是 不该 凭啥 凭什么 反感 离谱 接受不了 能接受吗", 3),
    "emotional_intensity": ("崩溃 破防 泪目 气死 笑死 感动 心酸 委屈 上头 炸了 无语 emo 破大防 窒息", 3), "identity_identification": ("大学生 宝妈 上班族 打工人 情侣 新手 小白 应届 北漂 沪漂 00后 95后 学生党 租房 独居", 2),
    "position_clarity": ("支持 反对 我站 不同意 同意 没错 就是 坚决 必须 绝对", 2), "counter_intuitive": ("没想到 万万没想到 居然 竟然 反转 真相 其实不是 别再 你以为 颠覆", 3),
    "utility": ("攻略 教程 步骤 方法 干货 清单 避坑 建议 指南 怎么选 怎么做 技巧 模板 公式", 3), "novelty": ("最新 首次 第一次 新出 新趋势 开始流行 正在流行 风向 新玩法", 3),
    "participation_threshold": ("评论区 你们觉得 来说说 投票 讨论 一起聊 你怎么看 留下 扣", 3),
}
PATTERNS = {
    "has_question_mark": r"[?？]",
    "has_number": r"[0-9０-９]|[一二两三四五六七八九十百千万亿零]+",
    "has_hashtag": r"#[^#\s]{1,40}#?",
    "has_explicit_comparison": r"还是|对比|相比|比较|哪个更|更值得|更划算|vs|VS|Vs|A还是B|PK|pk|优于|差距",
    "has_first_person": r"我们|本人|俺|咱|我的|我家|(?:^|[^\p{L}])我",
    "has_second_person": r"你们|您|宝子们|姐妹们|兄弟们|家人们|(?:^|[^\p{L}])你",
    "has_price_or_money": r"[¥￥$]|RMB|rmb|\d+(?:\.\d+)?\s*(?:元|块钱|块|万元|万亿|千元|千|毛|角|分)|(?:多少钱|价格|费用|花费|花了|花掉|工资|月薪|年薪|存款|预算|身价|打折|优惠|折)",
    "has_question_structure": r"(?m)到底|是不是|为什么|凭什么|怎么办|怎么了|难道|该不该|要不要|能不能|多少|哪种|哪个|还是|吗[?？。!！]?$|嘛[?？]?$",
    "has_colon": r"[:：]",
    "has_list_structure": r"(?m)(?:^|\n)\s*(?:\d+[.、)）]|[①②③④⑤⑥⑦⑧⑨⑩]|[一二三四五六七八九十]+[、.])|\s[·•|]\s|(?:^|\n)\s*[-–—]\s",
    "has_strong_punctuation": r"[!！]{2,}|[?？]{2,}|!!|🔥{2,}",
}
HOOKS = {"question": r"[?？]|到底|是不是|为什么|怎么办", "contrast": r"还是|对比|相比|哪个更|更值得|vs|VS", "list": r"(?:^|\n)\s*\d+[.、)）]|[①②③]"}
STRUCTURES = {"list": r"(?:^|\n)\s*(?:\d+[.、)）]|[①②③④⑤])", "guide": r"攻略|教程|步骤|指南|避坑", "qa": r"[?？].*\n|\n.*[?？]|回答|回复|问答"}
CLAIMS = {"percent": r"\d+\s*[%％]", "magnitude": r"\d+\s*(?:万|亿|千人|万人)", "authority": r"专家证明|研究表明|研究发现|权威机构|官方数据", "sample": r"\d+\s*人(?:投票|调研|实测)"}
HAN = r"\x{3400}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}"


def platform(x: Column) -> Column:
    """The platform of an alias, in any case and spacing; null for unknown words."""
    t, out = F.regexp_replace(F.lower(known(x)), r"\s+", ""), F.lit(None).cast("string")
    for name, aliases in PLATFORMS.items():
        out = F.when(t.isin(aliases.split()), name).otherwise(out)
    return out


def clean_id(x: Column) -> Column:
    """An id without the .0 of spreadsheets; null for empty and unknown ones."""
    t = F.trim(x)
    return F.when((t != "") & ~F.lower(t).isin("null", "none", "undefined", "n/a", "na", "-", "—", "未知", "无"), F.regexp_replace(t, r"\.0+$", ""))


def clean_url(x: Column) -> Column:
    """An http(s) URL as it is, host/path with https, null for anything else; 2,048 characters at most."""
    t = F.left(F.trim(x), F.lit(2048))
    return F.when(F.regexp_like(t, F.lit(r"(?i)^https?://")), t).when(F.regexp_like(t, F.lit(r"^[\w-]+(\.[\w-]+)+/")), F.concat(F.lit("https://"), t))


def inferred_type(url: Column, of: Column) -> Column:
    """The content type that the shape of a URL suggests on a platform; unknown if none."""
    has = lambda part: F.contains(F.lower(url), F.lit(part))
    at = F.when(url.isNull(), "unknown").when(has("video"), "video").when((of == "zhihu") & has("/question/"), "question").when((of == "zhihu") & has("/answer/"), "answer")
    return at.when((of == "zhihu") & (has("/p/") | has("zhuanlan")), "article").when((of == "xiaohongshu") & (has("/explore/") | has("/discovery/")), "image_post").otherwise("unknown")


def labelled(x: Column, labels: dict[str, str], other: Column | str) -> Column:
    """The label of a code; `other` for null and for codes without one."""
    out = other if isinstance(other, Column) else F.lit(other)
    for code, text in labels.items():
        out = F.when(x == code, text).otherwise(out)
    return out


def collapsed(x: Column) -> Column:
    """Three or more of one punctuation mark as one, longer dots as an ellipsis, ellipses as one."""
    t = F.regexp_replace(x, r"([!@#$%^&*()_+=\[\]{};':\"\\|,.<>/?~`\-])\1{2,}", "$1")
    t = F.regexp_replace(t, r"([。！？，、；：—])\1{2,}", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"\.{4,}", "…"), "…{3,}", "…")


def han_spaced(x: Column) -> Column:
    """A space between neighbouring Han, Kana and Hangul signs, and between these and letters or digits."""
    t = F.regexp_replace(F.regexp_replace(x, f"([A-Za-z0-9])([{HAN}])", "$1 $2"), f"([{HAN}])([A-Za-z0-9])", "$1 $2")
    return F.regexp_replace(t, f"([{HAN}])(?=[{HAN}])", "$1 ")


def match_query(x: Column) -> Column:
    """What a user typed as a match expression: Han terms as phrases, others as prefixes, all of them; null if nothing is left."""
    terms = F.transform(F.split(F.trim(x), r"\s+"), lambda t: F.trim(F.regexp_replace(t, r'["*(){}:^\-]', "")))
    terms = F.filter(terms, lambda t: F.regexp_like(t, F.lit(r"[\p{L}\p{N}]")))
    said = F.transform(terms, lambda t: F.concat(F.lit('"'), F.trim(han_spaced(t)), F.when(F.regexp_like(t, F.lit(f"[{HAN}]")), F.lit('"')).otherwise(F.lit('"*'))))
    return F.when(F.size(said) > 0, F.array_join(said, " AND "))


def han_pairs(x: Column) -> Column:
    """Neighbouring pairs of Han signs, without those of stop signs and of template words."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"[\x{4e00}-\x{9fff}]+"), F.lit(0))

    def pairs(run: Column) -> Column:
        signs = F.split(run, "")
        n = F.size(signs) - 1
        return F.zip_with(F.slice(signs, F.lit(1), n), F.slice(signs, F.lit(2), n), lambda a, b: F.concat(a, b))

    stop = sorted(set(STOP_CHARS))
    return F.filter(F.flatten(F.transform(runs, pairs)), lambda p: ~F.left(p, F.lit(1)).isin(stop) & ~F.right(p, F.lit(1)).isin(stop) & ~p.isin(TEMPLATE))


def tokens(x: Column) -> Column:
    """Han pairs, then Latin words."""
    return F.concat(han_pairs(x), words(x))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once a row, however often then names it: an expression is otherwise repeated at
    each of its uses, and those that nest multiply."""
    return F.get(F.transform(F.array(value), lambda x: then(x)), F.lit(0))


def semantic_text(kind: Column, title: Column, text: Column, transcript: Column, tags: Column, most: int = 2000) -> Column:
    """The text that is embedded: title, text, transcript (of videos and unknown kinds) and tags, one below the other,
    without parts that repeat others but for spaces and case; cut to about `most` characters, the first part and the tags
    being kept. Empty if there is nothing."""
    clean = lambda c: F.nullif(F.trim(collapsed(squeeze(F.coalesce(c, F.lit(""))))), F.lit(""))
    given = F.array_compact(F.array(clean(title), clean(text), F.when(kind.isin("video", "unknown"), clean(transcript))))
    keys = lambda a: F.transform(a, lambda p: F.lower(F.regexp_replace(p, r"\s+", "")))
    parts = once(given, lambda a: once(keys(a), lambda k: F.filter(a, lambda _, i: F.array_position(k, F.get(k, i)) == i + 1)))
    tag = F.array_join(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.concat(F.lit("#"), F.regexp_replace(t, "^#", ""))), " ")

    def cut(part: Column, used: Column, room: Column) -> Column:
        def said(left: Column) -> Column:
            fits, none = F.length(part) <= left, (part == "") | (left <= 8)
            text = F.when(none, "").when(fits, part).otherwise(F.concat(F.substring(part, F.lit(1), left), F.lit("…")))
            more = F.when(none, 0).when(fits, F.length(part) + 1).otherwise(left + 1)
            return F.struct(text.alias("text"), (used + more).alias("used"), ((left > 8) & fits).alias("goes_on"))

        return once(F.greatest(F.lit(0), F.lit(most) - used - room - 1), said)

    def shortened(s: Column) -> Column:
        first, tag = s["first"], s["tag"]
        room = F.when(tag != "", F.length(tag) + 1).otherwise(0)

        def joined(a: Column, b: Column) -> Column:
            text, used = F.when(a["goes_on"], b["text"]).otherwise(""), F.when(a["goes_on"], b["used"]).otherwise(a["used"])
            return F.array_join(F.filter(F.array(first, a["text"], text, F.when(used + F.length(tag) + 1 <= most, tag).otherwise("")), lambda p: p != ""), "\n")

        return once(cut(s["one"], F.length(first), room), lambda a: once(cut(s["two"], a["used"], room), lambda b: joined(a, b)))

    def chosen(s: Column) -> Column:
        whole = F.array_join(F.filter(F.array(s["first"], s["one"], s["two"], s["tag"]), lambda p: p != ""), "\n")
        return F.when(F.length(whole) <= most, whole).otherwise(shortened(s))

    named = lambda a: F.struct(*[F.coalesce(F.get(a, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(("first", "one", "two"))], tag.alias("tag"))
    return once(once(parts, named), chosen)


def angle_text(title: Column, text: Column, tags: Column) -> Column:
    """How a content puts its topic: the title, or the first sentence without one, and three tags at most."""
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    first = F.trim(F.regexp_extract(trimmed(text), r"^[^。！？!?\n]*[。！？!?\n]?", 0))
    core = F.left(F.when(trimmed(title) != "", trimmed(title)).otherwise(first), F.lit(120))
    said = F.array_join(F.transform(F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, 3), lambda t: F.concat(F.lit("#"), F.regexp_replace(t, "^#", ""))), " ")
    return F.array_join(F.filter(F.array(core, said), lambda p: p != ""), " ")


def hits(x: Column, lexicon: list[str]) -> Column:
    """How many of the words a text holds."""
    return sum((F.contains(x, F.lit(w)).cast("int") for w in lexicon), F.lit(0))


def content_features(title: Column, text: Column, published: Column) -> dict[str, Column]:
    """Thirteen booleans and four numbers of a content: what stands in title and text, their lengths, hour and weekday."""
    t = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    out = {k: F.regexp_like(t, F.lit(p)) for k, p in PATTERNS.items()}
    out |= {"has_region": hits(t, REGIONS) > 0, "has_identity_expression": hits(t, IDENTITIES) > 0}
    return out | {"title_length": F.length(F.coalesce(title, F.lit(""))), "text_length": F.length(F.coalesce(text, F.lit(""))), "publish_hour": F.hour(published), "publish_weekday": F.weekday(published) + 1}


def semantic_features(title: Column, text: Column) -> dict[str, Column]:
    """Ten densities from 0 to 1 by lexicon, and the kinds of hook and of structure."""
    t = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    out = {k: F.least(F.lit(1.0), hits(t, w.split()) / F.lit(float(cap))) for k, (w, cap) in SEMANTIC.items()}
    out["participation_threshold"] = F.greatest(out["participation_threshold"], F.when(F.regexp_like(t, F.lit(r"[?？]\s*$")), 0.6).otherwise(0.0))
    out["stance_taking_space"] = F.least(F.lit(1.0), out["controversy"] * 0.6 + out["position_clarity"] * 0.4)
    first = lambda kinds, rest: F.coalesce(*[F.when(F.regexp_like(t, F.lit(p)), F.lit(k)) for k, p in kinds.items()], rest)
    out["hook_type"] = first(HOOKS, F.when(F.regexp_like(F.left(t, F.lit(40)), F.lit(r"\d")), "number").when(F.length(t) <= 30, "opinion").otherwise("none"))
    out["content_structure"] = first(STRUCTURES, F.when(F.length(t) > 120, "narrative").otherwise("shortTake"))
    return out


def data_block(name: str, x: Column) -> Column:
    """A text as a marked block of data, with marks of its own made harmless."""
    t = F.regexp_replace(x, "【(/?DATA·[^】]{0,64})】", "〔$1〕")
    t = F.replace(F.replace(t, F.lit("【DATA·"), F.lit("〔DATA·")), F.lit("【/DATA·"), F.lit("〔/DATA·"))
    return F.concat(F.lit(f"【DATA·{name}】\n"), t, F.lit(f"\n【/DATA·{name}】"))


def evidence_hash(*parts: Column) -> Column:
    """A stable digest of evidence; leave out what the clock alone changes."""
    return F.concat(F.lit("ev-"), F.left(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), F.lit(32)))


def hot_phrase(x: Column) -> Column:
    """A hot title as a search phrase of at most 30 characters: at least four, some of them Han; null otherwise."""
    t = F.trim(F.regexp_replace(F.regexp_replace(x, r"[「」『』【】《》\"'（）()，。、；;：:!！?？…·\-—|]", " "), r"\s+", " "))
    p = F.trim(F.left(t, F.lit(30)))
    return F.when((F.length(p) >= 4) & F.regexp_like(p, F.lit(r"[\x{4e00}-\x{9fa5}]")), p)


