import hashlib
import random

import numpy as np
import pytest

from tidewell.llm import centroids, jaccard, negatives

VECTORS = "vec_id long, embedding array<double>, label int, rank int, cluster string"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, x, label, 1, "c") for i, x, label in rows], VECTORS)


def codes(x):
    return [int(np.floor(256 * v)) for v in x]


def taking_part(x):
    return x is not None and all(v is not None and np.isfinite(v) and np.isfinite(256 * v) for v in x)


def test_empty_tables(spark):
    assert jaccard.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    none = rows_of(spark, [])
    assert negatives.hard_negatives(none).count() == 0 and centroids.cluster(none).count() == 0
    assert centroids.cluster(rows_of(spark, [(1, [1.0] * 63, 0), (2, None, 0), (3, [float("nan")] * 64, 0)])).count() == 0


def shingles(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def joined(texts, k):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    least = {i: i for i in sets}
    again = True
    while again:
        again = False
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and least[j] > least[i]:
                    least[j], again = least[i], True
    return {i: (len(s), least[i]) for i, s in sets.items()}


@pytest.mark.parametrize("k, part, heavy", [(5, 512, 1000), (2, 4, 20)])
def test_jaccard_join_against_brute_force(spark, k, part, heavy, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_PART", part)
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    monkeypatch.setattr(jaccard, "PART_ROWS", 500)
    r = random.Random(k)
    word = lambda: f"w{r.randint(0, 400)}"
    bases = [[word() for _ in range(n)] for n in (3, 12, 40, 90, 200)]
    passage = [word() for _ in range(60)]
    texts = {}
    for i in range(110):
        words = list(bases[i % 5] if i % 3 else [word() for _ in range(50)] + passage)
        for _ in range(r.choice([0, 0, 1, 2, 4, 9])):
            at = r.randrange(len(words) + 1)
            words[at : at + 1] = r.choice([[word()], [], [word(), word()]])
        texts[i] = " ".join(w.upper() if r.random() < 0.1 else w for w in words)
    texts |= {200: None, 201: "", 202: " \n\t", 203: "a b", 204: "A b", 205: "é " * 3000 + "x", 206: "é " * 3000 + "x"}
    wanted = joined(texts, k)
    frame = spark.createDataFrame([(i, t, "n", 3, b"h") for i, t in texts.items()] + [(7, texts[7], "m", 4, b"g")], "doc_id long, text string, node string, n_shingles int, head binary")
    out = jaccard.jaccard_groups(frame, k).collect()
    assert len(out) == len(texts) + 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == wanted
    assert len({c for _, c in wanted.values()}) < len(wanted) - 30


def test_no_similar_pair_loses_a_prefix():
    r = random.Random(3)
    for _ in range(3000):
        n = r.randint(1, 60)
        x = set(r.sample(range(10_000), n))
        y = set(x)
        for v in r.sample(sorted(x), r.randint(0, max(1, n // 4))):
            y.discard(v)
        y |= set(r.sample(range(10_000), r.randint(0, max(1, n // 4))))
        if y and 100 * len(x & y) >= 80 * len(x | y):
            heads = [set(sorted(s)[: jaccard._hash_prefix(len(s), 80)[0]]) for s in (x, y)]
            assert len(heads[0] & heads[1]) >= max(jaccard._hash_prefix(len(s), 80)[1] for s in (x, y))
            assert all(set(sorted(x, key=f)[: jaccard.spare(len(x), 80) + 1]) & set(sorted(y, key=f)[: jaccard.spare(len(y), 80) + 1]) for f in (int, lambda v: -v, lambda v: (v % 7, v)))


def mined(rows, every=50, positives=5, most=3):
    own = [(i, label, codes(x)) for i, x, label in rows if i is not None and label is not None and taking_part(x)]
    own = list({(i, label, tuple(c)) for i, label, c in own})
    out = []
    for a, label, q in own:
        if a % every:
            continue
        score = lambda c: sum(x * y for x, y in zip(q, c))
        others = [(-score(c), i, lab) for i, lab, c in own if i != a and len(c) == len(q)]
        for s, p, _ in sorted(o for o in others if o[2] == label)[:positives]:
            fit = sorted((t, n) for t, n, lab in others if lab != label and 50 * -s <= 100 * -t <= 95 * -s)
            out += [(a, p, rank, n, -s, -t) for rank, (t, n) in enumerate(fit[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale, group", [(1.0, 1 << 23), (1.0, 20_000), (1e6, 20_000), (1e150, 1 << 23)])
def test_hard_negatives_against_brute_force(spark, scale, group):
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 24))
    rows = [(i, (scale * (centres[i % 6] + r.normal(size=24) * 0.4)).tolist(), int(i % 6 if i % 3 else r.integers(0, 4))) for i in range(400)]
    rows += [(i, rows[0][1], i % 3) for i in range(400, 412)]  # ties
    rows += [(500, None, 1), (550, [None] * 24, 1), (600, [float("inf")] * 24, 2), (650, [1.0] * 24, None), (None, [1.0] * 24, 1), (700, [1.0, 2.0], 1), (701, [1.0, 3.0], 1), (702, [0.5, 1.5], 2), (750, [], 1), (751, [], 1), (-50, (rows[1][1]), 1)]
    rows += rows[:30]
    out = negatives.hard_negatives(rows_of(spark, rows), group_bytes=group, block_bytes=group)
    found = sorted(tuple(x) for x in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    if scale < 1e100:
        assert found == mined(rows) and len(found) > 30
    else:
        assert all(x[4] in ((1 << 63) - 1, -(1 << 63)) or abs(x[4]) < 1 << 63 for x in found)


def test_segments_bound_scores_and_spare_exact_ones():
    import pandas as pd

    r = np.random.default_rng(2)
    # runs of like components, which segments describe well
    centres = np.repeat(r.normal(size=(50, 16)) * 40, 4, axis=1)
    x = np.floor(centres[np.arange(4000) % 50] + r.normal(size=(4000, 64)) * 4)
    frame = pd.DataFrame({"dim": 64, "grp": 0, "vec_id": np.arange(4000), "at": np.arange(4000), "label": np.arange(4000) % 50, "codes": list(x)})
    rows = negatives.Rows(negatives._pack(frame))
    asks = negatives.Rows(negatives._pack(frame[:4]))
    scores = x[:4] @ x.T
    for (m, d), (a, b) in zip(rows.levels, asks.levels):
        assert (np.abs(scores - a @ m.T) <= b @ d.T + 1e-5 * np.outer(asks.norms, rows.norms)).all()
    assert [m.shape[1] for m, _ in rows.levels] == [1, 4, 16]
    for i in range(4):
        idx, bound = negatives.refine(rows, np.arange(4000), asks, i, [(-np.inf, np.inf)], 5)
        ((found, best),), scored = negatives.best_first(rows, idx, bound, asks, i, [(-(1 << 62), 1 << 62)], 5, float((x * x).sum(axis=1).max()))
        assert best.tolist() == sorted(scores[i].astype(int), reverse=True)[:5] and scored <= len(idx) < 1000


def clustered(rows, k, rounds, dim=64):
    own = [(i, codes(x)) for i, x, _ in rows if i is not None and x is not None and len(x) == dim and taking_part(x)]
    first = sorted(own, key=lambda v: (hashlib.sha256(f"2:{v[0]}".encode()).hexdigest(), v[1]))[:k]
    c = [v for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        at = [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in own]
        if turn < rounds:
            c = [[sum(col) // len(m) for col in zip(*m)] if (m := [v for (_, v), a in zip(own, at) if a == j]) else c[j] for j in range(len(c))]
    d = [far(v, c[a]) for (_, v), a in zip(own, at)]
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    most = (1 << 63) - 1
    total = lambda v: min(sum(min(x, most) for x in v), most)
    return sorted((i, a, min(x, most), total([y for y, b in zip(d, at) if b == a]), total(d), sha[a]) for (i, _), a, x in zip(own, at, d))


@pytest.mark.parametrize("scale, pack", [(1.0, 1 << 14), (0.01, 50), (1e9, 70), (1e200, 1 << 14)])
def test_clusters_against_brute_force(spark, scale, pack, monkeypatch):
    monkeypatch.setattr(centroids, "PACK_ROWS", pack)
    r = np.random.default_rng(9)
    rows = [(i, (scale * (r.normal(size=64) + (i % 4))).tolist(), 0) for i in range(150)]
    rows += [(i, rows[3][1], 0) for i in range(150, 160)] + rows[:5]
    rows += [(900, [1.0] * 63, 0), (901, [1.0] * 65, 0), (902, None, 0), (903, [None] * 64, 0), (904, [float("nan")] * 64, 0), (None, [1.0] * 64, 0), (905, [], 0)]
    out = centroids.cluster(rows_of(spark, rows), k=7, rounds=3)
    assert sorted(tuple(x) for x in out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()) == clustered(rows, 7, 3)


def test_fewer_vectors_than_centroids(spark):
    out = centroids.cluster(rows_of(spark, [(1, [0.5] * 64, 0), (2, [0.5] * 64, 0)])).collect()
    assert {r["cluster"] for r in out} == {0} and all(r["distance"] == r["inertia"] == 0 for r in out)


def test_dictionaries_are_lossless_and_merge_repeated_blocks():
    r = np.random.default_rng(1)
    for x in (np.floor(r.normal(size=(500, 64)) * 30), np.floor(r.normal(size=(9, 64)) * 30)[np.arange(600) % 9], np.zeros((3, 8)), np.floor(r.normal(size=(40, 6)) * 5)):
        blocks = centroids.dictionaries(x)
        assert sum(e.shape[1] for _, e, _ in blocks) == x.shape[1]
        for lo, e, c in blocks:
            assert (e[c] == x[:, lo : lo + e.shape[1]]).all()
    assert len(centroids.dictionaries(np.floor(r.normal(size=(9, 64)) * 30)[np.arange(6000) % 9])) == 1
