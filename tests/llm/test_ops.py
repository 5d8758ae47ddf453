"""The corpus operators against brute force, on small tables with nulls, ties, blanks, long texts and extra columns."""

import base64
import hashlib
import math
import random
import re
import string
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidewell.llm import exact_dedup, langid, lattice, maxent_lm, mixing, quality, secret_scan, sharding, simhash, spm
from tidewell.llm.common import table
from tidewell.llm.queries import TOKENIZERS, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew strong tea in the old stone tower near the quiet river"


def odd_rows():
    long = " ".join(f"word{k % 900}" for k in range(30_000))
    texts = [PROSE, PROSE.replace(" ", "  \t"), PROSE + " today", "", None, "   ", "\n\t", "Ünïcödé 日本語 😀", long, long, "x", "12345 67890", "PASSWORD = 'abcdef123'", PROSE]
    rows = [(k, t, ["en", "de", None][k % 3], ["a", "b", None][k % 3], None) for k, t in enumerate(texts)]
    return rows + [(3, "again", "en", "a", 1), (None, PROSE, None, None, 2), (0, PROSE, "en", "a", None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SMALL, "documents")


def clash(df):
    """df with columns that bear the names the operators give."""
    for name in ("keep_id", "kept", "fp", "root", "size", "target", "shard", "slot", "spans", "score", "label", "key", "token_ids", "count", "cell", "page"):
        df = df.withColumn(name, F.lit("mine"))
    return df


def groups_of(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(n)]


def test_exact_groups(odd):
    rows = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, *_ in odd_rows()]
    ids = defaultdict(list)
    for i, t in rows:
        ids[t].append(i)
    want = Counter((i, min(x for x in ids[t] if x is not None), len(ids[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    got = exact_dedup.exact_groups(clash(odd)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(ids) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_drop_exact(odd):
    got = exact_dedup.drop_exact(clash(odd))
    assert got.columns == clash(odd).columns
    assert sorted(len(t or "") for t in {re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in got.collect()}) == sorted(len(t) for t in {re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in odd_rows()})
    assert got.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in odd_rows()})


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_columns_of_any_name_and_type_stay(spark, odd):
    """Maps, which don't hash, and names that the operators use themselves."""
    df = odd.withColumn("m", F.create_map(F.lit("k"), F.col("text"))).withColumn("_tw_sha", F.lit(1)).withColumn("_tw_copies", F.lit("x")).withColumn("_tw_digest", F.lit(2.0)).withColumn("c0", F.lit("c")).withColumn("_tw_score", F.lit(0))
    labels = table(spark, SMALL, "labels")
    n = len(odd_rows())
    for got, rows in ((exact_dedup.drop_exact(df), 10), (simhash.drop_near(df), None), (mixing.mixed(df), None), (quality.keep_good(df, labels.where("false")), n)):
        assert got.columns == df.columns and got.dtypes == df.dtypes
        assert rows is None or got.count() == rows
        assert all(r["m"] == {"k": r["text"]} and (r["_tw_sha"], r["_tw_copies"], r["_tw_digest"], r["c0"]) == (1, "x", 2.0, "c") for r in got.collect())


def test_simhash(spark, docs, odd):
    for df in (docs, clash(odd)):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        fps = [fingerprint(t) for _, t in rows]
        root = groups_of(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
        least = defaultdict(list)
        for k, r in enumerate(root):
            least[r].append(rows[k][0])
        want = Counter((rows[k][0], f"{fps[k]:016x}", min(x for x in least[r] if x is not None)) for k, r in enumerate(root))
        assert Counter(tuple(r) for r in simhash.near_groups(df).select("doc_id", "fingerprint", "component_id").collect()) == want
        left = simhash.drop_near(df)
        assert left.columns == df.columns and left.count() == len(least)
        assert Counter(r.doc_id for r in left.collect()) == Counter(min(x for x in v if x is not None) for v in least.values())


def test_simhash_links_all_distances(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, size=40)
    fps = set(base.tolist())
    for b in base.tolist():
        for bits in ((1,), (63,), (0, 40), (31, 32, 33), (1, 2, 3), (60, 61, 62), (5, 6, 7, 8)):
            fps.add(int(np.int64(np.uint64(b & (2**64 - 1)) ^ np.uint64(sum(1 << x for x in bits)))))
    rows = sorted(fps)
    got = {tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame([(x,) for x in rows], "fp long")).collect()}
    want = {(a, b) for k, a in enumerate(rows) for b in rows[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want


def test_lattice(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 64))
    rows = [b + 0.18 * rng.normal(size=64) for b in base for _ in range(3)] + [base[0]] * 3
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(rows)]
    odd = [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] + [1.0] * 63), (1003, [None] + [1.0] * 63), (1004, []), (1005, [1.0, 0.0]), (1006, [1.0, 0.01])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("n", F.lit("mine"))
    x = np.array([v for _, v in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    root = groups_of(len(rows), list(zip(*np.nonzero(near))))
    got = {r.vec_id: r for r in lattice.near_vectors(df).collect()}
    found = sum(got[k].n_links for k in range(len(rows)))
    assert found <= near.sum() and found >= 0.98 * near.sum()
    assert np.mean([got[k].component_id == root[k] for k in range(len(rows))]) > 0.98
    for k in (1000, 1001, 1002, 1003, 1004):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert got[1005].n_links == got[1006].n_links == 1 and got[1006].component_id == 1005


@pytest.mark.parametrize("how", [lattice.plan(10), lattice.plan(1 << 30)])
def test_lattice_recall_at_the_threshold(how):
    rng, n = np.random.default_rng(2), 3000
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(n, 64))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    t = lattice.Tables(64, **how)
    a, b = t.cells(x), t.cells(y)
    assert ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1).mean() > 0.99


def test_lattice_tables_do_not_depend_on_the_number_of_vectors():
    assert len({str(lattice.plan(n)) for n in (0, 10, 1 << 22, (1 << 22) + 1, 1 << 30)}) == 1


def test_lattice_crowded_cell_in_blocks(spark):
    rows = [(k, [1.0, 0.001 * k, 0.0, 0.0]) for k in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = lattice.linked(df.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("vec"), F.lit(1).cast("long").alias("n")), block=20)
    per = {r.cid: r.n for r in got.groupBy("cid").agg(F.sum("n").alias("n")).collect()}
    assert per == {k: 89 for k in range(90)}


def test_language(spark, docs, odd):
    got = langid.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and np.mean([r.lang == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    model = langid.fit(docs)
    assert model.predict(None) == model.predict("12 34!") == ("und", 0.0, True) and model.predict("ßü")[0] != "und"
    said = langid.language_report(clash(odd)).collect()
    assert len(said) == len(odd_rows()) and {r.lang_pred for r in said if r.doc_id == 4} == {"und"}


def test_language_by_brute_force(spark, docs):
    """Each text's language from n-gram counts made one by one, weighted and compared with every centroid."""
    model = langid.fit(docs.where("doc_id % 2 = 0"), dims=256)

    def nearest(text):
        low = (text or "").lower()
        if not any(c.isalpha() for c in low):
            return "und", 0.0
        raw = b" " + b" ".join(bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in low.encode()).split()) + b" "
        tf = [0] * 256
        for k in range(len(raw) - 1):
            two = raw[k] << 8 | raw[k + 1]
            tf[(two * 2654435761 % 2**32) >> 24] += 1
            if k + 2 < len(raw):
                tf[((two << 8 | raw[k + 2]) * 2246822519 + 0x9E3779B9) % 2**32 >> 24] += 1
        v = [math.log(1 + n) * w for n, w in zip(tf, model.idf)]
        size = math.sqrt(sum(x * x for x in v))
        best = max(range(len(model.languages)), key=lambda j: sum(a * b for a, b in zip(model.vectors[j], v)))
        return model.languages[best], sum(a * b for a, b in zip(model.vectors[best], v)) / size

    rows = docs.limit(150).select("doc_id", "text", langid.identify(F.col("text"), model, spark).alias("x")).collect()
    for r in rows:
        lang, cosine = nearest(r.text)
        assert r.x.lang_pred == lang and r.x.score == pytest.approx(cosine, abs=1e-6) and r.x.rejected == (cosine < model.cutoff)
    assert np.allclose(np.linalg.norm(model.vectors, axis=1), 1)


def test_texts_of_an_unknown_language_are_rejected(spark):
    """With one language left out of the fit, its texts are rejected, and those of known languages are not."""
    df = table(spark, "/root/testdata/sf0.01", "documents")
    for lang in ("en", "fr"):
        got = langid.language_report(df.withColumn("lang", F.when(F.col("lang") != lang, F.col("lang")))).join(df.select("doc_id", (F.col("lang") == lang).alias("unknown")), "doc_id")
        share = {r.unknown: r.p for r in got.groupBy("unknown").agg(F.avg(F.col("rejected").cast("double")).alias("p")).collect()}
        assert share[True] > 0.97 and share[False] < 0.01


def test_language_sample_is_bounded(spark):
    """One language a row, or one that holds nearly all: the sample keeps near its parameter."""
    for dirty in (True, False):
        df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"), F.when(F.lit(dirty) | (F.col("id") < 5), F.concat(F.lit("l"), F.col("id").cast("string"))).otherwise("en").alias("lang"))
        model = langid.fit(df, dims=64, sample_rows=60, centroids=1)
        assert len(model.languages) < 120 and (dirty or set(model.languages) == {"en", "l0", "l1", "l2", "l3", "l4"})


def test_quality_fit_is_optimal():
    """The hinge loss and its dual meet, so no other weights do better; the indicators are those of a plain reading."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 60, 12)) for _ in range(80)]
    scale, y, cost = rng.normal(size=60), rng.choice([-1.0, 1.0], 80), rng.uniform(0.5, 1.5, 80)
    w, b = quality.coordinate_descent(rows, scale, y, cost, rounds=3000)
    x = np.zeros((80, 61))
    for k, r in enumerate(rows):
        x[k, r] = scale[r] / len(r) ** 0.5
    x[:, 60] = 1.0
    full = np.append(w, b)
    best = 0.5 * full @ full + (cost * np.maximum(0, 1 - y * (x @ full))).sum()
    for _ in range(300):
        other = full + rng.normal(scale=10.0 ** rng.uniform(-4, 0), size=61)
        assert 0.5 * other @ other + (cost * np.maximum(0, 1 - y * (x @ other))).sum() >= best - 1e-4
    text = "One two two, ONE two! x1 x1"
    t = re.findall(r"\w+|[^\w\s]+", text)
    low = [w.lower() for w in t]
    shape = ["Cs", "ls", "ls", ",", "Us", "ls", "!", "ls", "ls"]
    marked = [(shape[k], k > 0 and low[k] == low[k - 1], k > 1 and low[k] == low[k - 2]) for k in range(len(t))]
    n = len(set(low)) + len(set(zip(low, low[1:]))) + len(set(marked)) + len(set(zip(marked, marked[1:], marked[2:])))
    assert len(quality.features(text)) == n and len(quality.features(None)) == 0


def test_quality(spark, docs, odd):
    labels = table(spark, SMALL, "labels")
    more, known = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    got = quality.quality_report(more, known).join(known.where("quality is not null"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and np.mean([r.predicted == r.quality for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    only = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    said = quality.quality_report(clash(odd), only).collect()
    assert len(said) == len(odd_rows()) and {r.score for r in said} == {1.0}
    left = quality.keep_good(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(r.predicted for r in quality.quality_report(docs, labels).collect())


def plain_indicators(text):
    """The indicators' ids, n-gram by n-gram."""
    crc = lambda t: zlib.crc32(t.encode("utf-8", "surrogatepass"))
    m64 = 2**64 - 1

    def place(x):
        x = x * 0x9E3779B97F4A7C15 & m64
        return ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & m64) >> 46

    words = re.findall(r"\w+|[^\w\s]+", text or "")
    w, s, ids = [crc(t.lower()) for t in words], [], set()
    for k, t in enumerate(words):
        if not (t[0].isalnum() or t[0] == "_"):
            shape = t[:4]
        else:
            shape = "U" if t.isupper() else "l" if t.islower() else "C" if t[1:].islower() or len(t) == 1 else "d" if t.isdigit() else "m"
            shape += "1" if len(t) == 1 else "s" if len(t) < 12 else "w" if len(t) < 24 else "x"
        s.append(crc(shape) * 4 + (k > 0 and w[k] == w[k - 1]) + 2 * (k > 1 and w[k] == w[k - 2]))
    for k in range(len(words)):
        ids |= {place(w[k] + (1 << 40)), place(s[k] + (3 << 40))}
        if k:
            ids.add(place(w[k - 1] * 31 + w[k] + (2 << 40)))
        if k > 1:
            ids.add(place((s[k - 2] * 1009 + s[k - 1]) * 1009 + s[k] + (4 << 40)))
    return sorted(ids)


def plain_quality(docs, labels):
    """(doc_id, held_out, score) of rows (doc_id, text) by dictionaries and loops: log-count ratios, dual coordinate
    descent in the same order, a logistic curve over the margins of a fifth of the rows."""
    crc = lambda x: zlib.crc32(str(x).encode())
    known = {}
    for i, q in labels:
        if i is not None and q is not None:
            known[i] = min(q, known.get(i, q))
    train = sorted((i, np.array(plain_indicators(t), dtype=np.int32).tobytes(), plain_indicators(t)) for i, t in docs if crc(i) % 4 != 2 and i in known)
    rows, y = [r for *_, r in train], [1.0 if known[i] == 1 else -1.0 for i, *_ in train]
    up, n = y.count(1.0), len(y)
    seen = {k: Counter(f for r, l in zip(rows, y) if l == k for f in r) for k in (1.0, -1.0)}
    ratio = {f: math.log((seen[1.0][f] + 1) / (1 + up)) - math.log((seen[-1.0][f] + 1) / (1 + n - up)) for f in seen[1.0] | seen[-1.0] if seen[1.0][f] + seen[-1.0][f] >= 3}
    cost = [n / (2 * up) if l == 1 else n / (2 * (n - up)) for l in y]
    size = lambda r: max(1.0, len(r) ** 0.5)

    def descend(some):
        xs = [{f: ratio.get(f, 0.0) / size(rows[k]) for f in rows[k]} for k in some]
        w, b, alpha, draw = defaultdict(float), 0.0, [0.0] * len(some), np.random.default_rng(7)
        for _ in range(20):
            moved = 0.0
            for i in draw.permutation(len(some)):
                l = y[some[i]]
                g = l * (sum(w[f] * v for f, v in xs[i].items()) + b) - 1
                new = min(cost[some[i]], max(0.0, alpha[i] - g / (sum(v * v for v in xs[i].values()) + 1)))
                step = (new - alpha[i]) * l
                for f, v in xs[i].items():
                    w[f] += step * v
                b, moved, alpha[i] = b + step, max(moved, abs(new - alpha[i])), new
            if moved < 1e-4:
                break
        return lambda r: sum(w[f] * ratio.get(f, 0.0) for f in r) / size(r) + b

    fifth = [k for k in range(n) if k % 5 == 0]
    trial = descend([k for k in range(n) if k % 5])
    m, t = [trial(rows[k]) for k in fifth], [y[k] for k in fifth]
    hi, lo = (t.count(1.0) + 1) / (t.count(1.0) + 2), 1 / (t.count(-1.0) + 2)
    slope, shift = 1.0, 0.0
    for _ in range(200):  # Newton's steps on the softened log loss, with a small pull to slope 1
        g, h = [1e-3 * (slope - 1), 1e-3 * shift], [[1e-3, 0.0], [0.0, 1e-3]]
        for x, l, k in zip(m, t, fifth):
            p = 1 / (1 + math.exp(-(slope * x + shift)))
            for a, u in enumerate((x, 1.0)):
                g[a] += cost[k] * (p - (hi if l == 1 else lo)) * u
                for c, v in enumerate((x, 1.0)):
                    h[a][c] += cost[k] * p * (1 - p) * u * v
        det = h[0][0] * h[1][1] - h[0][1] * h[1][0]
        d = [(h[1][1] * g[0] - h[0][1] * g[1]) / det, (h[0][0] * g[1] - h[1][0] * g[0]) / det]
        scale = min(1.0, 5.0 / max(1e-9, max(map(abs, d))))
        slope, shift = slope - scale * d[0], shift - scale * d[1]
    model, slope = descend(list(range(n))), max(0.1, slope)
    return {i: (crc(i) % 4 == 2, 1 / (1 + math.exp(-(slope * model(plain_indicators(x)) + shift)))) for i, x in docs}


def test_quality_report_by_brute_force(spark, docs):
    labels = table(spark, SMALL, "labels")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(9_000_001, None), (9_000_002, "")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(rows[-2:], "doc_id long, text string"))
    want = plain_quality(rows, [(r.doc_id, r.quality) for r in labels.collect()])
    got = quality.quality_report(df, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        held, score = want[r.doc_id]
        assert r.held_out == held and r.score == pytest.approx(score, abs=2e-3)
        assert r.predicted == (score >= 0.7) or abs(score - 0.7) < 2e-3


def test_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.concatenate([rng.integers(100, 2000, 30), [k % 2]])) for k in range(300)]
    m = quality.fit_rows(rows, np.array([k % 2 for k in range(300)]))
    assert all((m.score(r) > 0.5) == bool(k % 2) for k, r in enumerate(rows))


def test_language_model(spark, docs, odd):
    for df in (docs, clash(odd)):
        rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in df.select("doc_id", "text").collect()]
        crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode())
        train = [w for i, w in rows if crc(i) % 10]
        c = Counter(x for w in train for x in w)
        total, distinct = sum(c.values()) + len(train), len(c) + 1
        log = lambda n: math.log10((n + 0.1) / (total + 0.1 * (distinct + 1)))
        want = sorted(((i is None, i or 0), crc(i) % 10 == 0, len(w) + 1, sum(x in c for x in w) + 1, total, round(sum(log(c[x]) for x in w) + log(len(train)), 4)) for i, w in rows)
        got = maxent_lm.lm_report(df).collect()
        assert sorted(((r.doc_id is None, r.doc_id or 0), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    # rare words' counts come by the join; with a small lexicon the sums must stay
    train_rows = docs.where("doc_id % 2 = 0").select("doc_id", "text")
    counts = maxent_lm.word_counts(train_rows)
    a, b = (maxent_lm.score(docs.select("doc_id", "text"), maxent_lm.lexicon(counts, train_rows.count(), most), maxent_lm.Weights.start(maxent_lm.lexicon(counts, train_rows.count(), most)), counts).toPandas().sort_values("doc_id") for most in (50, 200_000))
    assert np.allclose(a["base_score"], b["base_score"]) and (a["n_known"] == b["n_known"]).all()


def test_language_model_is_a_distribution(docs):
    """Over all words and the end, and one unseen word per ending, the probabilities after a word sum to one."""
    rows = docs.select("doc_id", "text")
    counts = maxent_lm.word_counts(rows)
    lex = maxent_lm.lexicon(counts, rows.count())
    words = [w for w in lex.index]
    b = maxent_lm.Batch([[w] for w in words], lex)
    w = maxent_lm.train(rows, lex, rounds=1)
    p = maxent_lm.log10_members(w, b)[::2]
    member = b.member[::2]
    other = member >= maxent_lm.TOP
    p[other] += b.log_count[::2][other] - lex.log_ending[member[other] - maxent_lm.TOP]
    end = maxent_lm.Batch([[]], lex)
    rest = sum(10 ** (maxent_lm.log10_members(w, _as(end, maxent_lm.TOP + e))[0] + math.log10(0.1) - lex.log_ending[e]) for e in range(maxent_lm.ENDINGS))
    assert (10**p).sum() + 10 ** maxent_lm.log10_members(w, end)[0] + rest == pytest.approx(1.0, abs=1e-4)


def test_language_model_learns_from_every_token(spark):
    """Each feature row that a training token uses has moved from its start."""
    texts = [" ".join(f"word{(k * 37 + j * j) % 500}" for j in range(30)) for k in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lex = maxent_lm.lexicon(maxent_lm.word_counts(rows), rows.count())
    w = maxent_lm.train(rows, lex)
    b = maxent_lm.Batch([maxent_lm.tokens(t) for t in texts], lex)
    for used, table in zip(maxent_lm._rows(w, b.features, b.member // maxent_lm.MEMBERS), (w.of_class, w.of_member)):
        assert (table[used] != 0).any(axis=2).all()


def test_language_model_beats_its_base(spark):
    """On held-out documents: in sum, and for nine in ten of them."""
    rows = maxent_lm.lm_report(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert np.mean([r.score >= r.base_score for r in rows]) >= 0.9


def test_language_model_score_by_brute_force(spark):
    """score token by token from the weights: a class, a member, and within a shared member the relative frequency."""
    texts = ["the cat saw the dog", "The dog", "", None, "ein Hund sah dich ünd mich", "unseen words here"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = maxent_lm.word_counts(rows.where("doc_id < 5"))
    lex = maxent_lm.lexicon(counts, 5, 3)
    own = {r.word: r.c for r in counts.collect()}
    rng, w = np.random.default_rng(0), maxent_lm.Weights.start(lex, 1 << 10)
    for part in (w.of_class, w.of_member):
        part += rng.normal(scale=0.3, size=part.shape).astype(np.float32)
    member = {word.decode(): int(lex.member[i]) for word, i in lex.index.items()}
    shared = lambda word: maxent_lm.TOP + zlib.crc32(word[-2:].encode()) % maxent_lm.ENDINGS
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    got = {r.doc_id: r.score for r in maxent_lm.score(rows, lex, w, counts).collect()}
    for k, text in enumerate(texts):
        said, past = 0.0, [0x51ED270B, 0x51ED270B]
        for word in [*(text or "").lower().split(), None]:
            m = 0 if word is None else member.get(word, shared(word))
            klass, within = divmod(m, maxent_lm.MEMBERS)
            two, one = past[-2:]
            f = np.array([[one * 2654435761], [((one * 2246822519 ^ two) * 3266489917) + 1], [two * 668265263 + 2]], dtype=object) & 0xFFFFFFFF
            rc, rm = maxent_lm._rows(w, f.astype(np.uint32), np.array([klass]))
            of_class = sum(w.of_class[r] for r in rc.ravel()) + w.of_class[-1]
            of_member = sum(w.of_member[r] for r in rm.ravel()) + w.of_member[len(w.of_member) - maxent_lm.CLASSES + klass]
            said += math.log10(softmax(of_class)[klass]) + math.log10(softmax(of_member)[within])
            if m >= maxent_lm.TOP:
                others = {x: n for x, n in own.items() if shared(x) == m and member.get(x, maxent_lm.TOP) >= maxent_lm.TOP}
                said += math.log10(own.get(word, 0) + 0.1) - math.log10(sum(others.values()) + 0.1 * (len(others) + 1))
            past.append(0x2545F491 if word is None else zlib.crc32(word.encode()))
        assert got[k] == pytest.approx(said, abs=1e-4)


def test_sums_of_runs():
    rng = np.random.default_rng(0)
    for most in (1, 3, 8, 9, 200):
        n = rng.integers(1, most + 1, 300)
        first = np.cumsum(n) - n
        x = rng.normal(size=(n.sum(), 5))
        assert np.allclose(maxent_lm._sums_of_runs(x, first, n), np.add.reduceat(x, first, axis=0))


def test_language_model_tables_grow():
    sizes = [maxent_lm.member_rows(n) for n in (0, 10**6, 10**8, 10**9, 10**13)]
    assert sizes == sorted(sizes) and sizes[2] == 1 << 15 and sizes[3] == 1 << 17 and sizes[-1] == 1 << 18
    lex = maxent_lm.Lexicon({}, np.zeros(1), np.zeros(1, np.int32), 0, 0, 0, 1, np.zeros(maxent_lm.ENDINGS), np.zeros(1, np.uint32))
    d = maxent_lm.Descent(maxent_lm.Weights.start(lex, 1 << 18))
    rows = np.array([5, 70_000, 5, 200_000, 4464])  # 70,000 and 4,464 share their low bits
    before = d.w.of_member.copy()
    d._apply(1, d.w.of_member, rows, np.ones((5, maxent_lm.MEMBERS), np.float32))
    assert np.flatnonzero((d.w.of_member != before).any(axis=1)).tolist() == [5, 4464, 70_000, 200_000] and d.seen[1][5] == 2


def _as(batch, member):
    batch.member = np.array([member])
    out = maxent_lm.Batch.__new__(maxent_lm.Batch)
    out.__dict__ = dict(batch.__dict__)
    batch.member = np.array([0])
    return out


def test_mixing(spark, docs, odd):
    for df in (docs, clash(odd)):
        rows = [(r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in df.select("source", "text").collect()]
        size = Counter()
        for s, n in rows:
            size[s] += n
        order = sorted(size, key=lambda s: (s is None, s or ""))
        weight, cap, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {s: 2.0 * n for s, n in size.items()}, 1.5 * sum(size.values())
        target, free = dict.fromkeys(order, 0.0), set(order)
        while True:
            rest = total - sum(cap[s] for s in order if s not in free)
            over = {s for s in free if rest * weight[s] / sum(weight[x] for x in free) > cap[s]}
            target = {s: rest * weight[s] / sum(weight[x] for x in free) if s in free else cap[s] for s in order}
            if not over:
                break
            free -= over
        got = mixing.mix_report(df).collect()
        source = df.select("doc_id", "source").distinct().collect()
        assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
        per = {s: r for s in order for r in [next(x for x in got if math.isclose(x.target, target[s], rel_tol=1e-9) or size[s] == 0)]}
        assert len(per) == len(order) and sum(1 for r in got for s in order if r.source_size == size[s]) >= len(rows)
        again = sorted(tuple(r) for r in mixing.mix_report(df.repartition(7)).select("size", "target", "taken").collect())
        assert again == sorted((r["size"], r.target, r.taken) for r in got) and source
        mix = mixing.mixed(df)
        assert mix.columns == df.columns and sum(r["size"] for r in mixing.mix_report(mix).select("size").collect()) == sum(r.taken for r in got)


def test_mixing_comes_near_its_targets(spark):
    """Each source's taken words, for many and for few sources at a time, joined by broadcast or by a shuffle."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    said = [sorted(tuple(r) for r in mixing.rated(docs, small=small).select("doc_id", "_tw_copies", "_tw_target").collect()) for small in (20_000, 0)]
    assert said[0] == said[1]
    per = mixing.mix_report(docs).groupBy("target", "source_size").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.sum(F.col("size") * F.col("size")).alias("squares")).collect()
    for r in per:  # a Bernoulli copy has a variance of a quarter at most
        assert abs(r.taken - r.target) <= 4 * math.sqrt(r.squares / 4)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    path = f"{TOKENIZERS}/piece_bpe_32k.model"
    return spm.Encoder(spm.Model.load(path), keep=500), sentencepiece.SentencePieceProcessor(model_file=path)


def test_sentencepiece(spark, docs, odd, pieces):
    ours, theirs = pieces
    rng = np.random.default_rng(3)
    texts = [r[1] for r in odd_rows()] + [r.text for r in docs.collect()] + ["a▁b", "\x00", " ", "   ", "a" * 3000, " " * 999 + "x", "<s></s><unk>", "��"]
    texts += ["".join(rng.choice(list("  abthe in▁😀\t\n=-_.{}()日本"), rng.integers(0, 60))) for _ in range(1500)]
    for at in range(0, len(texts), 97):  # several batches, with a small memory
        some = texts[at : at + 97]
        ids, n = ours.encode(some)
        ends = np.cumsum(n)
        for t, a, b in zip(some, ends - n, ends):
            want = theirs.encode(t or "")
            assert ids[a:b].tolist() == want
            assert spm.decode_ids(want, ours.m) == theirs.decode(want)
    got = spm.encode(clash(odd), f"{TOKENIZERS}/piece_bpe_32k.model", keep_text=True).collect()
    assert all(r.token_ids == theirs.encode(r.text or "") and r.round_trip and r.n_tokens == len(r.token_ids) and r.kept == "mine" for r in got)
    back = spm.decode(spm.encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model"), f"{TOKENIZERS}/piece_bpe_32k.model").join(docs.select("doc_id", F.col("text").alias("was")), "doc_id")
    assert back.where("text <> was").count() == 0 and back.count() == docs.count()


def test_sentencepiece_clashing_names(spark, odd, pieces):
    path = f"{TOKENIZERS}/piece_bpe_32k.model"
    df = odd.withColumn("_tw_text", F.lit("mine")).withColumn("x", F.lit(1)).withColumn("c0", F.lit(2)).withColumn("N_TOKENS", F.lit("old")).withColumn("Round_Trip", F.lit("old"))
    got = spm.encode(df, path)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "_tw_text", "x", "c0", "token_ids", "n_tokens", "round_trip"]
    want = Counter((i, tuple(pieces[1].encode(t or ""))) for i, t, *_ in odd_rows())
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in got.collect()) == want
    assert all((r["_tw_text"], r["x"], r["c0"]) == ("mine", 1, 2) for r in got.collect())
    back = spm.decode(spark.createDataFrame([(1, None), (2, []), (3, pieces[1].encode("a b"))], "k long, token_ids array<int>").withColumn("text", F.lit("old")), path)
    assert {r.k: r.text for r in back.collect()} == {1: None, 2: "", 3: "a b"}


def test_sentencepiece_long_segments(pieces):
    """Texts without spaces: right whole, and a megabyte in seconds. Rows of one character need the walk."""
    ours, theirs = pieces
    rng = random.Random(2)
    han = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(1_000_000))
    texts = [han, base64.b64encode(rng.randbytes(300_000)).decode(), "a" * 60_000, "abc" * 9_000, "=" * 5_001 + "." * 3_000, "é" * 300 + "x😀" * 600 + "\n" * 700]
    texts += ["".join(rng.choice(["a", "b", "the", "in", "▁", "=", "--", "日本", "😀"]) for _ in range(rng.randint(100, 900))) for _ in range(100)]
    for t in texts:
        began = time.time()
        assert ours.encode([t])[0].tolist() == theirs.encode(t) and time.time() - began < 60


def test_sharding(spark, docs, odd):
    for df in (docs, clash(odd)):
        got = sharding.shard_report(df, rows_a_slice=3).collect()
        rows = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in df.select("doc_id", "text").collect())
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == rows
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
            assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_by_brute_force(spark):
    """Each level's draws made again from the hash of key, node and seed."""
    tree = [sharding.Leaf(x.shard, x.region, x.rack, 1.0 + x.shard % 3) for x in sharding.layout(25)]

    def draw(key, name, weight, seed):
        h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42) if key is not None else 42
        h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), xxhash.xxh64_intdigest(name.encode(), h))
        return -math.log(((h >> 11) + 1) / (2.0**53 + 1)) / weight

    def descend(key, leaves, level=0, prefix="", seed=7):
        children = defaultdict(list)
        for x in leaves:
            children[f"{prefix}/{(x.region, x.rack, f's{x.shard}')[level]}"].append(x)
        name = min(children, key=lambda c: draw(key, c, sum(x.weight for x in children[c]), seed)) if len(children) > 1 else next(iter(children))
        return children[name][0].shard if level == 2 else descend(key, children[name], level + 1, name)

    ids = [None, 0, -1, 2**62, *range(1000, 1400)]
    df = spark.createDataFrame([(k,) for k in ids], "id long").select("id", sharding.shard_of(F.col("id"), tree, 7).alias("s"))
    assert {r.id: r.s for r in df.collect()} == {k: descend(k, tree) for k in ids}


def test_sharding_moves_little(spark):
    ids = spark.range(20_000)
    at = lambda tree: {r.id: r.s for r in ids.select("id", sharding.shard_of(F.col("id"), tree).alias("s")).collect()}
    a, b = at(sharding.layout(24)), at(sharding.layout(25))
    moved = [k for k in a if a[k] != b[k]]
    assert all(b[k] == 24 for k in moved) and 0.5 < len(moved) / (20_000 / 25) < 1.5
    assert max(Counter(a.values()).values()) < 1.2 * 20_000 / 24
    heavy = [sharding.Leaf(x.shard, x.region, x.rack, 2.0 if x.region == "r0" else 1.0) for x in sharding.layout(24)]
    c = at(heavy)
    assert all(c[k] < 8 for k in a if a[k] != c[k])  # only into the region whose weight grew
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), [])


KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def test_secrets(spark, docs):
    rng = np.random.default_rng(4)
    bits = ["password=", "Token : '", "api_key=abc", "APIKEY=\"x/y+z=1\"", "secret", "AKIA" + "Z9" * 9, "AKIAAKIA" + "B" * 14, "0123456789abcdef" * 2, "deadbeef", " ", "é😀", "\n", "passwd:=", "token=password=abcdefgh", "=", "'", "secretsecret=abcdef", "token=ab token=abcdef"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(600)] + [None, "", "k" * 5000]
    odd = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for df in (clash(odd), docs):
        text = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        for r in secret_scan.scan_report(df).collect():
            spans = sorted((m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(KINDS) for m in p.finditer(text[r.doc_id]) if ok(m))
            said = [f"{name}:{a}:{b}" for a, _, b, name in spans]
            assert hashlib.sha256(",".join(said).encode()).hexdigest() == r.base_sha256
            assert [s for s in r.spans.split(",") if s and not s.startswith("markov")] == said
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))


def test_markov_finds_random_strings(spark, docs):
    model = secret_scan.fit(secret_scan.samples(docs))
    one, two = "ghX8kQ2vLp9ZrT4mWc7YbN1sDf6", "Zx81Qp0LmN47vBt9Rr2Wc6Hd5"
    rows = [(1, f"use {one} here"), (2, "the internationalization_of_understandings went well"), (3, "see configuration-management-handbook for more"), (4, f"key {two} end")]
    rows += [(5, f"/srv/data/configuration/understanding/{one}"), (6, f"{one}/a_configuration/of_many_other_words/and_directory_names/without_meaning/{two}"), (7, "x" + "0123456789abcdef01234567" + two)]
    got = {r.doc_id: [x.value for x in r.s if x.kind == 3] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), model, into="s").collect()}
    assert got[1] == [one] and got[4] == [two] and got[2] == got[3] == []
    assert len(got[5]) == 1 and got[5][0].endswith(one) and len(got[6]) == 2 and got[6][1].endswith(two) and got[7] == [two]
    assert secret_scan.scan(docs, secret_scan.fit(secret_scan.samples(docs.limit(0))), into="s").count() == docs.count()


def test_markov_precision_and_recall(spark, docs):
    """Of labelled strings that the model never saw: at most 1 % of identifiers, at least 97 % of random keys."""
    rng = random.Random(5)
    words = "request user session handler configuration default value index buffer stream table column filter account balance update remove network timeout manager".split()
    signs = string.ascii_letters + string.digits
    rows = [(k, True, "".join(rng.choice(signs) for _ in range(rng.randint(20, 40)))) for k in range(1000)]
    for k in range(1000):
        some = [rng.choice(words) for _ in range(rng.randint(3, 6))]
        rows.append((k, False, ["_".join(some), "-".join(some), "/".join(some), "".join(map(str.title, some)), "_".join(map(str.upper, some))][k % 5]))
    df = spark.createDataFrame([(k, key, f"use {text} here") for k, key, text in rows], "doc_id long, key boolean, text string")
    said = secret_scan.scan(df, secret_scan.fit(secret_scan.samples(docs)), into="s").groupBy("key").agg(F.avg((F.size("s") > 0).cast("double")).alias("p"))
    share = {r.key: r.p for r in said.collect()}
    assert share[True] >= 0.97 and share[False] <= 0.01


def test_sample_of_secrets_is_bounded(spark):
    """Few long documents give few strings, and many give no more characters than asked for."""
    long = spark.createDataFrame([(k, " ".join(f"word{chr(97 + i % 26)}ing_{i}" for i in range(20_000))) for k in range(3)], "doc_id long, text string")
    rows = secret_scan.samples(long).agg(F.sum("n").alias("n"), F.max(F.length("value")).alias("most")).first()
    assert rows.n <= 3 * (2 + 64 + 64 + 64) and rows.most < 6 * 21
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("plain words here "), 20).alias("text"))
    some = secret_scan.samples(many, rows=300).where("random = 1").agg(F.sum("n")).first()[0]
    assert 2 * 200 < some < 2 * 400
    some = secret_scan.samples(many, chars=340 * 300).where("random = 1").agg(F.sum("n")).first()[0]
    assert 2 * 200 < some < 2 * 400


def test_secrets_in_very_long_texts(spark, docs):
    """A megabyte in one run, and 100,000 spans in one text, each in seconds."""
    rng, model = random.Random(1), secret_scan.fit(secret_scan.samples(docs))
    run = base64.b64encode(rng.randbytes(750_000)).decode()
    hexes = [rng.randbytes(12).hex() for _ in range(100_000)]
    for text, count in ((run, 1), ("é".join(hexes), 100_000)):
        began = time.time()
        s = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, into="s").first().s
        assert time.time() - began < 60 and (len(s) == count if count > 1 else sum(x.end - x.start for x in s) > 0.99 * len(text))


def test_markov_ratios(spark):
    """The table against a plain count of transitions."""
    rows = [(1, "aZ9aZ9"), (1, "Z9"), (0, "aaab"), (0, "b"), (0, "é!"), (1, None)]
    table = secret_scan.fit(spark.createDataFrame(rows, "random int, value string"))
    n = len(secret_scan.ALPHABET)
    for a in "aZ9b":
        for b in "aZ9b":
            p = []
            for k in (1, 0):
                pairs = [v[i : i + 2] for r, v in rows if r == k and v for i in range(len(v) - 1)]
                mine = sum(x[0] == a for x in pairs if x[0] in secret_scan.ALPHABET)
                p.append(0.9 * (pairs.count(a + b) / mine if mine else 1 / n) + 0.1 / n)
            assert table[secret_scan.ALPHABET.index(a) * n + secret_scan.ALPHABET.index(b)] == pytest.approx(math.log(p[0] / p[1]))


def test_empty_tables(spark):
    docs, vectors = spark.createDataFrame([], DOCS), spark.createDataFrame([], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (langid.language_report(docs), exact_dedup.exact_groups(docs), exact_dedup.drop_exact(docs), lattice.near_vectors(vectors), simhash.near_groups(docs), simhash.drop_near(docs), maxent_lm.lm_report(docs), quality.quality_report(docs, labels), mixing.mix_report(docs), mixing.mixed(docs), spm.encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model"), sharding.shard_report(docs), secret_scan.scan_report(docs)):
        assert df.count() == 0


def test_native_plans(docs):
    for df in (exact_dedup.exact_groups(docs), sharding.shard_report(docs), secret_scan.scan_report(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_queries_are_all_there():
    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 14))
