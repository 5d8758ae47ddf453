"""Registered queries over content texts. The given texts have no Han signs, so each title's letters are turned into some."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import content as C
from tidewell.functions import text as T
from tidewell.functions.stats import half_up
from tidewell.operators import intel as I
from tidewell.operators import search as X

from .views import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_LETTERS, _SIGNS = "abcdefghijklmnopqrstuvwxyz", "探店美食学习电脑手机旅行购物健身穿搭的是我在北京教"
_MORE = ["到底值不值得买?", "北京的大学生你们看看!!", "攻略:\n1. 步骤\n2. 方法", "对比评测 vs 价格 99 元", "我们崩溃了,居然反转", "评论区来说说吧?", "", "最新教程 #探店#美食 争议 支持"]
_SQL_H = "h AS (SELECT doc_id AS item_id, source, lang, text, translate(lower(left(split_part(text, '.', 1), 60)), '{}', '{}') AS title, CASE doc_id % 8 {} END AS extra FROM documents)".format(_LETTERS, _SIGNS, " ".join("WHEN {} THEN '{}'".format(i, m.replace("'", "''")) for i, m in enumerate(_MORE)))
_R6 = "floor(({}) * 1e6 + 0.5) / 1e6"


def _han(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    extra = F.element_at(F.array(*[F.lit(m) for m in _MORE]), (F.col("doc_id") % 8 + 1).cast("int"))
    return d.select(F.col("doc_id").alias("item_id"), "source", "lang", "text", F.translate(F.lower(F.left(F.split_part("text", F.lit("."), F.lit(1)), F.lit(60))), _LETTERS, _SIGNS).alias("title"), extra.alias("extra"))


def _list(words) -> str:
    return ", ".join("'{}'".format(w.replace("'", "''")) for w in words)


_PAIRS = f"list_filter(flatten(list_transform(regexp_extract_all(lower({{0}}), '[一-鿿]+'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))), lambda p: left(p, 1) NOT IN ({_list(sorted(set(C.STOP_CHARS)))}) AND right(p, 1) NOT IN ({_list(sorted(set(C.STOP_CHARS)))}) AND p NOT IN ({_list(C.TEMPLATE)}))"
_WORDS = f"list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9][a-z0-9''+.-]{{{{1,23}}}}'), lambda w: w NOT IN ({_list(T.STOP_WORDS)}))"


@query(f"WITH {_SQL_H} SELECT item_id, array_to_string(list_concat({_PAIRS.format('title || extra')}, {_WORDS.format('title || extra').replace('{{', '{').replace('}}', '}')}), ' ') AS tokens FROM h")
def han_tokens(spark, sf_dir):
    return _han(spark, sf_dir).select("item_id", F.array_join(C.tokens(F.concat("title", "extra")), " ").alias("tokens"))


_HC = "一-鿿㐀-䶿぀-ヿ가-힯"
_SPACE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '([A-Za-z0-9])([H])', '\\1 \\2', 'g'), '([H])([A-Za-z0-9])', '\\1 \\2', 'g'), '([H])([H])', '\\1 \\2', 'g'), '([H])([H])', '\\1 \\2', 'g')".replace("H", _HC)
_TERMS = "list_filter(list_transform(string_split_regex(trim({0}), '\\s+'), lambda t: trim(regexp_replace(t, '[\"*(){{}}:^\\-]', '', 'g'))), lambda t: regexp_matches(t, '[\\p{{L}}\\p{{N}}]'))"
_MATCH = "list_transform(" + _TERMS.format("extra").replace("{{", "{").replace("}}", "}") + ", lambda t: '\"' || trim(" + _SPACE.format("t") + ") || CASE WHEN regexp_matches(t, '[" + _HC + "]') THEN '\"' ELSE '\"*' END)"


@query(f"WITH {_SQL_H} SELECT item_id, {_SPACE.format('title')} AS spaced, CASE WHEN len({_MATCH}) > 0 THEN array_to_string({_MATCH}, ' AND ') END AS match FROM h")
def han_match_query(spark, sf_dir):
    """Titles as they are indexed, and what users type as match expressions."""
    return _han(spark, sf_dir).select("item_id", C.han_spaced(F.col("title")).alias("spaced"), C.match_query(F.col("extra")).alias("match"))


_HTOK = f"tok AS (SELECT item_id, field, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT item_id, field, list_filter(string_split_regex(lower({_SPACE.format('body')}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS w FROM (SELECT item_id, 'title' AS field, title || extra AS body FROM h UNION ALL SELECT item_id, 'author', source FROM h WHERE source IS NOT NULL)))"


@query(f"WITH {_SQL_H}, {_HTOK} SELECT a.item_id, a.field, count(*) AS n FROM tok a JOIN tok b ON a.item_id = b.item_id AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.token = '教' AND b.token = '程' GROUP BY 1, 2")
def search_han_phrase(spark, sf_dir):
    """Two Han signs one after the other, in an index of title and author."""
    h = _han(spark, sf_dir).select("item_id", C.han_spaced(F.concat("title", "extra")).alias("title"), C.han_spaced(F.col("source")).alias("author"))
    return X.phrase(X.tokens(h, ["title", "author"]), ["教", "程"])


def _re(p: str) -> str:
    return p.replace("'", "''")


_BOOLS = ", ".join([f"regexp_matches(t, '{_re(p)}') AS {k}" for k, p in C.PATTERNS.items()] + [f"({' OR '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in ws)}) AS {k}" for k, ws in (("has_region", C.REGIONS), ("has_identity_expression", C.IDENTITIES))])


@query(f"WITH {_SQL_H}, x AS (SELECT *, title || chr(10) || extra AS t, TIMESTAMP '2024-01-01' + INTERVAL (item_id) HOUR AS pub FROM h) SELECT item_id, {_BOOLS}, length(title) AS title_length, length(extra) AS text_length, hour(pub) AS publish_hour, isodow(pub) AS publish_weekday FROM x")
def content_features_han(spark, sf_dir):
    """All thirteen booleans and four numbers."""
    h = _han(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.col("item_id") * 3600))
    f = C.content_features(F.col("title"), F.col("extra"), F.col("at"))
    return h.select("item_id", *[(c.cast("long") if k[:3] != "has" else c).alias(k) for k, c in f.items()])


def _density(k: str) -> str:
    w, cap = C.SEMANTIC[k]
    return f"least(1.0, ({' + '.join(f'contains(t, {chr(39)}{x}{chr(39)})::INT' for x in w.split())}) / {cap}.0::DOUBLE)"


_DENS = ", ".join(f"{_R6.format(_density(k))} AS {k}" for k in C.SEMANTIC if k != "participation_threshold")
_HOOK = "CASE " + " ".join(f"WHEN regexp_matches(t, '{_re(p)}') THEN '{k}'" for k, p in C.HOOKS.items()) + " WHEN regexp_matches(left(t, 40), '\\d') THEN 'number' WHEN length(t) <= 30 THEN 'opinion' ELSE 'none' END"
_STRUCT = "CASE " + " ".join(f"WHEN regexp_matches(t, '{_re(p)}') THEN '{k}'" for k, p in C.STRUCTURES.items()) + " WHEN length(t) > 120 THEN 'narrative' ELSE 'shortTake' END"


@query(f"WITH {_SQL_H}, x AS (SELECT *, title || chr(10) || extra AS t FROM h) SELECT item_id, {_DENS}, {_R6.format('greatest(' + _density('participation_threshold') + ', CASE WHEN regexp_matches(t, ' + chr(39) + '[?？]' + chr(92) + 's*$' + chr(39) + ') THEN 0.6 ELSE 0.0 END)')} AS participation_threshold, {_R6.format('least(1.0, ' + _density('controversy') + ' * 0.6::DOUBLE + ' + _density('position_clarity') + ' * 0.4::DOUBLE)')} AS stance_taking_space, {_HOOK} AS hook_type, {_STRUCT} AS content_structure FROM x")
def semantic_features_han(spark, sf_dir):
    """All ten densities, hook and structure."""
    f = C.semantic_features(F.col("title"), F.col("extra"))
    return _han(spark, sf_dir).select("item_id", *[(c if k in ("hook_type", "content_structure") else half_up(c, 6)).alias(k) for k, c in f.items()])


_NAMES = ["抖音", "XHS", " Zhihu ", "B站", "微 博", "else", "未知", "其他"]
_WANT = ["douyin", "xiaohongshu", "zhihu", "bilibili", "weibo", None, None, "other"]


@query("WITH p AS (SELECT page_id, url, CASE page_id % 8 {} END AS platform FROM pages), u AS (SELECT *, CASE page_id % 4 WHEN 0 THEN url || '/question/1' WHEN 1 THEN regexp_replace(url, '^https?://', '') WHEN 2 THEN url || '/explore/' ELSE 'note ' || page_id END AS written FROM p), c AS (SELECT *, CASE WHEN regexp_matches(written, '(?i)^https?://') THEN written WHEN regexp_matches(written, '^[\\w-]+(\\.[\\w-]+)+/') THEN 'https://' || written END AS clean FROM u) SELECT page_id, platform, CASE page_id % 3 WHEN 0 THEN page_id::VARCHAR WHEN 1 THEN NULL ELSE 'x' || page_id END AS clean_id, clean AS clean_url, CASE WHEN clean IS NULL THEN 'unknown' WHEN contains(lower(clean), 'video') THEN 'video' WHEN platform = 'zhihu' AND contains(lower(clean), '/question/') THEN 'question' WHEN platform = 'zhihu' AND contains(lower(clean), '/answer/') THEN 'answer' WHEN platform = 'zhihu' AND (contains(lower(clean), '/p/') OR contains(lower(clean), 'zhuanlan')) THEN 'article' WHEN platform = 'xiaohongshu' AND contains(lower(clean), '/explore/') THEN 'image_post' ELSE 'unknown' END AS inferred, CASE platform {} ELSE '未知' END AS label FROM c".format(" ".join(f"WHEN {i} THEN {'NULL' if w is None else chr(39) + w + chr(39)}" for i, w in enumerate(_WANT)), " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.PLATFORM_LABELS.items())))
def clean_fields(spark, sf_dir):
    """Platforms by alias, ids, URLs, types by URL and labels, as an import writes them."""
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (k % 8 + 1).cast("int"))
    url = F.when(k % 4 == 0, F.concat("url", F.lit("/question/1"))).when(k % 4 == 1, F.regexp_replace("url", "^https?://", "")).when(k % 4 == 2, F.concat("url", F.lit("/explore/"))).otherwise(F.concat(F.lit("note "), k.cast("string")))
    id_ = F.when(k % 3 == 0, F.concat(F.lit(" "), k.cast("string"), F.lit(".0"))).when(k % 3 == 1, F.lit("N/A")).otherwise(F.concat(F.lit("x"), k.cast("string")))
    rows = p.select("page_id", C.platform(name).alias("platform"), C.clean_id(id_).alias("clean_id"), C.clean_url(url).alias("clean_url"))
    return rows.select("*", C.inferred_type(F.col("clean_url"), F.col("platform")).alias("inferred"), C.labelled(F.col("platform"), C.PLATFORM_LABELS, "未知").alias("label"))


@query("SELECT doc_id AS item_id, source || CASE WHEN doc_id % 5 >= 3 THEN '!' ELSE repeat('!', CAST(doc_id % 5 AS INT)) END || CASE WHEN doc_id % 7 >= 3 THEN '.' ELSE repeat('.', CAST(doc_id % 7 AS INT)) END || CASE WHEN doc_id % 4 >= 3 THEN '…' ELSE repeat('…', CAST(doc_id % 4 AS INT)) END || CASE WHEN doc_id % 6 >= 3 THEN '？' ELSE repeat('？', CAST(doc_id % 6 AS INT)) END || 'aaa' AS plain FROM documents")
def collapsed_punctuation(spark, sf_dir):
    marks = lambda sign, n: F.repeat(F.lit(sign), (F.col("doc_id") % n).cast("int"))
    written = F.concat("source", marks("!", 5), marks(".", 7), marks("…", 4), marks("？", 6), F.lit("aaa"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), C.collapsed(written).alias("plain"))


_NT = "CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand || ' goes on and on with some more words about it' END"


@query(f"""WITH p AS (SELECT p_partkey, trim(p_name) AS a, {_NT} AS b, CASE WHEN p_partkey % 2 = 0 THEN p_type || ' told at length, from its beginning to the very end' END AS c, '#' || p_type || ' #' || p_name AS tag FROM part),
q AS (SELECT *, list_filter([a, CASE WHEN lower(replace(b, ' ', '')) <> lower(replace(a, ' ', '')) THEN b END, c], lambda x: x IS NOT NULL) AS l FROM p), w AS (SELECT *, array_to_string(list_concat(l, [tag]), chr(10)) AS whole, length(tag) + 1 AS room, length(l[1]) AS used FROM q),
m AS (SELECT *, greatest(0, 80 - used - room - 1) AS left1 FROM w), n AS (SELECT *, CASE WHEN len(l) < 2 OR left1 <= 8 THEN '' WHEN length(l[2]) <= left1 THEN l[2] ELSE left(l[2], CAST(left1 AS INT)) || '…' END AS s1, used + CASE WHEN len(l) < 2 OR left1 <= 8 THEN 0 WHEN length(l[2]) <= left1 THEN length(l[2]) + 1 ELSE left1 + 1 END AS used1, left1 > 8 AND (len(l) < 2 OR length(l[2]) <= left1) AS goes FROM m),
o AS (SELECT *, greatest(0, 80 - used1 - room - 1) AS left2 FROM n), r AS (SELECT *, CASE WHEN NOT goes OR len(l) < 3 OR left2 <= 8 THEN '' WHEN length(l[3]) <= left2 THEN l[3] ELSE left(l[3], CAST(left2 AS INT)) || '…' END AS s2, used1 + CASE WHEN NOT goes OR len(l) < 3 OR left2 <= 8 THEN 0 WHEN length(l[3]) <= left2 THEN length(l[3]) + 1 ELSE left2 + 1 END AS used2 FROM o),
t AS (SELECT p_partkey, a, tag, CASE WHEN length(whole) <= 80 THEN whole ELSE array_to_string(list_filter([l[1], s1, s2, CASE WHEN used2 + length(tag) + 1 <= 80 THEN tag ELSE '' END], lambda x: x <> ''), chr(10)) END AS said FROM r)
SELECT p_partkey, said AS semantic_text, sha256(said) AS text_hash, a || ' ' || tag AS angle_text FROM t""")
def semantic_texts(spark, sf_dir):
    """The texts that are embedded, cut to 80 characters, their digests, and the angles' texts."""
    p, c = table(spark, sf_dir, "part"), F.col
    body = F.when(c("p_partkey") % 3 == 0, c("p_name")).otherwise(F.concat("p_brand", F.lit(" goes on and on with some more words about it")))
    told = F.when(c("p_partkey") % 2 == 0, F.concat("p_type", F.lit(" told at length, from its beginning to the very end")))
    tags = F.array("p_type", F.concat(F.lit("#"), "p_name"))
    rows = p.select("p_partkey", C.semantic_text(F.lit("video"), c("p_name"), body, told, tags, 80).alias("semantic_text"), C.angle_text(c("p_name"), body, tags).alias("angle_text"))
    return rows.withColumn("text_hash", F.sha2("semantic_text", 256))


@query(f"WITH {_SQL_H} SELECT item_id, '【DATA·item】' || chr(10) || replace(replace(CASE item_id % 3 WHEN 0 THEN extra || '【/DATA·item】' WHEN 1 THEN '【DATA·x】' || extra ELSE extra END, '【/DATA·item】', '〔/DATA·item〕'), '【DATA·x】', '〔DATA·x〕') || chr(10) || '【/DATA·item】' AS block, 'ev-' || left(sha256(item_id || '|' || coalesce(source, '') || '|' || extra), 32) AS hash FROM h")
def data_blocks(spark, sf_dir):
    """Texts as blocks of data, marks of their own made harmless, and the digest of an item's evidence."""
    k = F.col("item_id") % 3
    said = F.when(k == 0, F.concat("extra", F.lit("【/DATA·item】"))).when(k == 1, F.concat(F.lit("【DATA·x】"), "extra")).otherwise(F.col("extra"))
    return _han(spark, sf_dir).select("item_id", C.data_block("item", said).alias("block"), C.evidence_hash(F.col("item_id"), F.col("source"), F.col("extra")).alias("hash"))


_CLAIM = " UNION ALL ".join(f"SELECT conv_id, '{k}' AS kind, unnest(regexp_extract_all(said, '{p}')) AS claim FROM s WHERE role = 'assistant'" for k, p in C.CLAIMS.items())
_SAID = "s AS (SELECT conv_id, role, lower(text || CASE WHEN role = 'assistant' THEN ' ' || (turn % 4) * 10 || '% and ' || turn || '万, 研究表明' WHEN role = 'user' AND turn % 3 = 0 THEN ' 10% ' || turn + 1 || '万' ELSE '' END) AS said FROM conversations)"


@query(f"WITH {_SAID}, c AS (SELECT DISTINCT * FROM ({_CLAIM})) SELECT c.conv_id, kind, claim FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.conv_id = c.conv_id AND s.role <> 'assistant' AND contains(s.said, c.claim))")
def unsupported_claims(spark, sf_dir):
    """Percentages, magnitudes, authorities and samples that an assistant names and no other turn holds; the given texts
    hardly have any, so some are added to each turn."""
    t, c = F.col("turn"), table(spark, sf_dir, "conversations")
    more = F.when(F.col("role") == "assistant", F.concat(F.lit(" "), (t % 4 * 10).cast("string"), F.lit("% and "), t.cast("string"), F.lit("万, 研究表明"))).when((F.col("role") == "user") & (t % 3 == 0), F.concat(F.lit(" 10% "), (t + 1).cast("string"), F.lit("万"))).otherwise("")
    s = c.select("conv_id", "role", F.lower(F.concat("text", more)).alias("said"))
    named = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("claim"))
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("said", F.lit(p), F.lit(0)), named(k)) for k, p in C.CLAIMS.items()]))
    claims = s.where("role = 'assistant'").select("conv_id", F.explode(found).alias("x")).select("conv_id", "x.kind", "x.claim").distinct()
    others = s.where("role <> 'assistant'").select(F.col("conv_id").alias("_c"), F.col("said").alias("_said"))
    return claims.join(others, (F.col("conv_id") == F.col("_c")) & F.contains("_said", F.col("claim")), "left_anti")


@query(f"WITH {_SQL_H}, p AS (SELECT item_id, left(trim(regexp_replace(regexp_replace(title || extra, '[「」『』【】《》\"''（）()，。、；;：:!！?？…·\\-—|]', ' ', 'g'), '\\s+', ' ', 'g')), 30) AS p FROM h), q AS (SELECT item_id, trim(p) AS phrase FROM p WHERE length(trim(p)) >= 4 AND regexp_matches(trim(p), '[一-龥]')) SELECT item_id, phrase FROM (SELECT *, row_number() OVER (PARTITION BY left(phrase, 8) ORDER BY item_id) AS r FROM q) WHERE r = 1")
def hot_phrases_han(spark, sf_dir):
    """Titles as search phrases with Han signs, the first per first eight characters."""
    h = _han(spark, sf_dir).select("item_id", C.hot_phrase(F.concat("title", "extra")).alias("phrase")).where("phrase is not null")
    return h.groupBy(F.left("phrase", F.lit(8)).alias("k")).agg(F.min_by(F.struct("item_id", "phrase"), "item_id").alias("r")).select("r.item_id", "r.phrase")


_SIDED = f"{_SQL_H}, x AS (SELECT lang AS grp, toxic = 1 AS viral, title || chr(10) || extra AS t FROM h JOIN labels ON doc_id = item_id)"
_NUMBERS = [k for k in C.SEMANTIC if k != "participation_threshold"]
_LONG = " UNION ALL ".join(f"SELECT grp, viral, '{k}' AS feature, {_density(k)} AS v FROM x" for k in _NUMBERS)


@query(f"WITH {_SIDED}, l AS ({_LONG}), g AS (SELECT grp, feature, median(CASE WHEN viral THEN v END) AS a, median(CASE WHEN NOT viral THEN v END) AS b FROM l GROUP BY 1, 2 HAVING count(CASE WHEN viral THEN 1 END) >= 3 AND count(CASE WHEN NOT viral THEN 1 END) >= 3), d AS (SELECT *, {_R6.format('a - b')} AS delta FROM g) SELECT grp AS lang, feature, {_R6.format('a')} AS viral_median, {_R6.format('b')} AS control_median, delta, CASE WHEN delta > 0.1 THEN 'positive' WHEN delta < -0.1 THEN 'negative' ELSE 'none' END AS direction FROM d")
def semantic_compare(spark, sf_dir):
    """The semantic numbers of toxic and other documents, by language."""
    f = C.semantic_features(F.col("title"), F.col("extra"))
    h = _han(spark, sf_dir).join(table(spark, sf_dir, "labels"), F.col("item_id") == F.col("doc_id"))
    return I.semantic_compare(h.select("lang", (F.col("toxic") == 1).alias("viral"), *[f[k].alias(k) for k in _NUMBERS]), "lang", "viral", _NUMBERS)


@query(f"WITH {_SIDED}, k AS (SELECT grp, viral, {_HOOK} AS hook FROM x), n AS (SELECT grp, count(CASE WHEN viral THEN 1 END) AS nv, count(CASE WHEN NOT viral THEN 1 END) AS nc FROM k GROUP BY 1), t AS (SELECT grp, hook AS top, {_R6.format('count(CASE WHEN viral THEN 1 END) / CAST(max(nv) AS DOUBLE) - count(CASE WHEN NOT viral THEN 1 END) / CAST(max(nc) AS DOUBLE)')} AS delta FROM k JOIN n USING (grp) WHERE nv > 0 AND nc > 0 GROUP BY 1, 2) SELECT grp AS lang, top, delta FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY abs(delta) DESC, top) AS r FROM t) WHERE r = 1")
def hook_shares(spark, sf_dir):
    """The kind of hook whose share differs most between toxic and other documents, by language."""
    hook = C.semantic_features(F.col("title"), F.col("extra"))["hook_type"]
    h = _han(spark, sf_dir).join(table(spark, sf_dir, "labels"), F.col("item_id") == F.col("doc_id"))
    return I.categorical_share(h.select("lang", (F.col("toxic") == 1).alias("viral"), hook.alias("hook")), "lang", "viral", "hook")


@query("SELECT doc_id AS item_id, CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id AS VARCHAR) END AS first, CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN 2 ELSE 0 END AS n FROM documents")
def json_paths(spark, sf_dir):
    """A value at a dotted path, and an array, out of JSON that may be broken or hold something else: null and nothing then."""
    k, c = F.col("doc_id").cast("string"), F.col("doc_id")
    written = F.when(c % 3 == 0, F.lit('{"a": {"b": [')).when(c % 3 == 1, F.concat(F.lit('{"a": {"b": ['), k, F.lit(', 2]}}'))).otherwise(F.concat(F.lit('{"a": {"b": "'), k, F.lit('"}}')))
    rows = table(spark, sf_dir, "documents").select(c.alias("item_id"), written.alias("j"))
    first = F.coalesce(F.get_json_object("j", "$.a.b[0]"), F.get_json_object("j", "$.a.b"))
    return rows.select("item_id", first.alias("first"), F.coalesce(F.size(F.from_json(F.get_json_object("j", "$.a.b"), "array<string>")), F.lit(0)).alias("n"))


@query(f"WITH {_SQL_H}, t AS (SELECT source, unnest(regexp_extract_all(extra || ' #' || lang || ' #' || upper(lang), '#([^#\\s，,、。;；！!？?]+)', 1)) AS tag FROM h), l AS (SELECT source, lower(tag) AS tag, count(*) AS n FROM t GROUP BY 1, 2) SELECT source, tag, n, r FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, tag) AS r FROM l) WHERE r <= 5")
def top_hashtags(spark, sf_dir):
    """The five commonest tags of each source, in any case."""
    written = F.concat("extra", F.lit(" #"), "lang", F.lit(" #"), F.upper("lang"))
    tags = F.regexp_extract_all(written, F.lit(r"#([^#\s，,、。;；！!？?]+)"), F.lit(1))
    g = _han(spark, sf_dir).select("source", F.explode(tags).alias("tag")).groupBy("source", F.lower("tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source").orderBy(F.desc("n"), "tag")
    return g.withColumn("r", F.row_number().over(w).cast("long")).where("r <= 5")
