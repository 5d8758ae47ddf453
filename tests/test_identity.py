"""Topics from run to run and claims of angles, against plain loops."""

import random
from collections import defaultdict

import pytest

from tidewell.operators import identity as N


def test_claims_equal_a_loop(spark):
    for seed in range(3):
        rng = random.Random(seed)
        pairs = [(g, a, d, 10 - a % 4, round(rng.random(), 1)) for g in (1, 2, None) for a in range(12) for d in range(8) if rng.random() < 0.5]
        pairs = [((g or 0) * 100 + a, (g or 0) * 100 + d, g, n, s) for g, a, d, n, s in pairs]
        df = spark.createDataFrame([(g, a, d, n, s) for a, d, g, n, s in pairs], "g long, angle long, known long, members long, sim double")
        want = set()
        for g in (1, 2, None):
            mine, used = defaultdict(list), set()
            for a, d, gg, n, s in pairs:
                if gg == g:
                    mine[-n, a].append((-s, d))
            for (_, a), likes in sorted(mine.items()):
                free = [d for _, d in sorted(likes) if d not in used]
                if free:
                    used.add(free[0])
                    want.add((a, free[0]))
        assert {tuple(r) for r in N.claims(df, "g", "angle", "known", "members", "sim").collect()} == want
    assert N.claims(df.limit(0), "g", "angle", "known", "members", "sim").collect() == []


def loop(old, new, least):
    topics, locks, clusters = defaultdict(set), {}, defaultdict(set)
    for t, i, locked in old:
        topics[t].add(i)
        if locked:
            locks[i] = t
    for c, i in new:
        clusters[c].add(i)
    claimed, out, last = set(), {}, max(topics, default=-1)
    for c, mine in sorted(clusters.items(), key=lambda x: (-len(x[1]), x[0])):
        best = max(((len(mine & o) / len(mine | o), -t) for t, o in topics.items() if mine & o), default=(0, 0))
        if best[0] >= least and -best[1] not in claimed:
            claimed.add(-best[1])
            out[c] = (-best[1], "kept")
        else:
            last += 1
            out[c] = (last, "split" if best[0] >= least else "new")
    members = {i: (out[c][0], "automatic") for c, mine in clusters.items() for i in mine}
    members |= {i: (t, "manual") for i, t in locks.items()}
    used = {t for t, _ in out.values()}
    return out, members, {t: "active" if t in used else "inactive" for t in set(topics) | used}


@pytest.mark.parametrize("seed", [1, 2])
def test_identities_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    old = [(rng.choice([1, 2, 3, 9]), i, rng.random() < 0.1) for i in range(60)] + [(7, 200, True)]
    where = {i: t for t, i, _ in old}
    new = [({1: 11, 2: 12, 3: 13}.get(where.get(i), 14) + (20 if rng.random() < 0.4 else 0), i) for i in range(80) if rng.random() < 0.9]
    o = spark.createDataFrame(old + [(None, 1, True), (1, None, None)], "topic long, id long, locked boolean")
    n = spark.createDataFrame(new + [(None, 5), (50, None)], "cluster long, id long")
    clusters, members, topics = N.identities(o, n)
    want = loop(old, new, 0.3)
    assert {r.cluster: (r.topic, r.status) for r in clusters.collect()} == want[0]
    assert {s for _, s in want[0].values()} >= {"kept", "split"}
    assert {r.id: (r.topic, r.method) for r in members.collect()} == want[1]
    assert {r.topic: r.status for r in topics.collect()} == want[2] and "inactive" in want[2].values()


def test_identities_of_nothing(spark):
    o, n = spark.createDataFrame([], "topic long, id long, locked boolean"), spark.createDataFrame([(4, 1), (4, 2), (5, 3)], "cluster long, id long")
    clusters, members, topics = N.identities(o, n)
    assert sorted((r.cluster, r.topic, r.status) for r in clusters.collect()) == [(4, 0, "new"), (5, 1, "new")]
    clusters, members, topics = N.identities(spark.createDataFrame([(1, 1, True), (2, 2, None)], o.schema), n.limit(0))
    assert clusters.count() == 0 and [tuple(r) for r in members.collect()] == [(1, 1, "manual")] and {r.status for r in topics.collect()} == {"inactive"}
