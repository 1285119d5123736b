import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import chat, decontaminate, language, lines, mixing, neardup, private, substrings, topk, toxicity
from tidewell.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, taken long, _t long"


def docs(spark, texts, lang=None, source="a"):
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), 5, 6) for i, t in enumerate(texts)], DOCS)


def vocabulary(seed, n=300):
    r = random.Random(seed)
    return r, ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(n)]


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_empty_tables(spark):
    none = empty(spark)
    assert mixing.mix_sources(none).count() == 0
    assert neardup.near_duplicates(none).count() == 0
    assert private.find_private(none).count() == 0
    assert lines.drop_repeated_lines(none).count() == 0
    assert substrings.repeated_substrings(none).count() == 0
    assert language.identify(none, language.fit_languages(none), ["doc_id"]).count() == 0
    assert decontaminate.find_leaks(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert chat.collapse_and_render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert topk.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_mixing_fills_like_vessels_and_cuts_exactly(spark):
    rows = [(i, "w " * (1 + i % 7), s) for i, s in enumerate(["a"] * 60 + ["b"] * 20 + ["c"] * 3 + [None] * 5)] + [(None, None, "a"), (7, "", "a"), (3, "x y", "a"), (3, "x y", "a")]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    weights, left, full = {"a": 1, "b": 2, "c": 3, None: 1}, dict.fromkeys(sizes), {}
    while True:
        level = (sum(sizes.values()) - sum(full.values())) / sum(w for s, w in weights.items() if s not in full)
        over = [s for s in left if s not in full and weights[s] * level > 3 * sizes[s]]
        if not over:
            break
        full |= {s: 3 * sizes[s] for s in over}
    for s in left:
        want = full.get(s, weights[s] * level)
        assert target[s] == pytest.approx(want) and taken[s] == int(target[s])


def test_top_k_against_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in r.normal(0, 0.2, 8)]) for i in range(400)]
    rows += [(500, None), (501, [1.0, float("nan")] + [0.0] * 6), (502, [None] * 8), (503, rows[7][1]), (504, rows[7][1]), rows[3]]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    codes = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v in rows if i not in (500, 501, 502)}
    for q in (0, 50, 350):
        want = sorted(((-int(codes[q] @ c), i) for i, c in codes.items() if i != q))[:5]
        assert [(-x["score"], x["vec_id"]) for x in sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])] == want



def best_of(rows, k=5):
    """query_id -> the k best (score, vec_id), by integers."""
    known = {(i, tuple(int(math.floor(256 * float(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v)}
    low, high = topk.LONG
    dot = lambda a, b: max(low, min(high, sum(x * y for x, y in zip(a, b))))
    return {q: [(-s, i) for s, i in sorted((-dot(v, w), j) for j, w in known if j != q and len(w) == len(v))[:k]] for q, v in known if q % 50 == 0}


@pytest.mark.parametrize("scale", [1.0, 2.0**18, 1e12, 1e200])
def test_top_k_of_wide_components_lengths_and_many_groups(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "PACK_ROWS", 32)
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in r.normal(0, scale, 4 + i % 2)]) for i in range(300)]
    rows += [(400 + i, rows[50][1]) for i in range(8)] + [(None, [1.0] * 4), (450, []), (500, []), (600, [1.0] * 4), (601, [math.inf] * 4), rows[50]]
    data = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, dim int")
    for sizes in ({}, {"group_bytes": 1, "block_bytes": 600, "n_pivots": 3})[scale != 1.0 :]:
        got = {}
        for x in sorted(topk.exact_top_k(data, **sizes).collect()):
            got.setdefault(x["query_id"], []).append((x["score"], x["vec_id"]))
        assert got == {q: found for q, found in best_of(rows).items() if found}
        assert all(len(f) == 5 for q, f in got.items() if q not in (450, 500))


def test_pivots_rule_out_candidates_without_loss():
    r = np.random.default_rng(7)
    x = np.floor(256 * (np.repeat(r.normal(0, 1, (20, 8)), 50, axis=0) + r.normal(0, 0.02, (1000, 8))))
    top = float((x * x).sum(axis=1).max())
    pivots = np.column_stack([x[::50], np.sqrt(np.maximum(top - (x[::50] ** 2).sum(axis=1), 0))])
    ids, ask = np.arange(1000), x[::40]
    best = topk.Best(ids[::40], np.full(25, -np.inf), 5)
    topk.search(best, (ask, topk.to_pivots(ask, pivots, top, False)), (ids, x, topk.to_pivots(x, pivots, top, True)), top)
    for i, q in enumerate(ids[::40]):
        assert sorted(zip((-best.scores[i]).tolist(), best.ids[i].tolist())) == sorted((-int(ask[i] @ x[j]), j) for j in ids if j != q)[:5]
    assert best.scored < 0.5 * 25 * 1000

def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(neardup, "HEAVY", 1000 if k == 2 else 5)
    r, words = vocabulary(3)
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(40)]
    texts = list(base)
    for _ in range(120):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w).upper() if r.random() < 0.2 else " ".join(w))
    texts += [None, "", "   ", "one", "One", "x" * 5000]
    got = {x["doc_id"]: x for x in neardup.near_duplicates(docs(spark, texts), k).collect()}
    sets, name = [shingles(t, k) for t in texts], list(range(len(texts)))
    for _ in range(9):
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and sets[j] and name[i] != name[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    name[i] = name[j] = min(name[i], name[j])
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(len(texts))] == [(len(s), n, n == i) for i, (s, n) in enumerate(zip(sets, name))]


def test_estimate_is_near_the_similarity():
    sets = [np.arange(1000, dtype=np.uint64), np.arange(100, 1100, dtype=np.uint64)]
    regs = neardup.registers([neardup.mix64(s) for s in sets], 1024)
    assert neardup.estimate(regs[:1], regs[1:], np.array([1000.0]), np.array([1000.0]))[0] == pytest.approx(900 / 1100, abs=0.06)
    both = neardup.registers([neardup.mix64(np.arange(1100, dtype=np.uint64))], 1024)
    assert (np.maximum(regs[0], regs[1]) == both[0]).all()


def test_components_of_chains_and_loops(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 30), (30, 40), (50, 50)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(links).collect()} == {i: 0 for i in range(1, 21)} | {40: 30}


REGEX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def private_by_regex(text):
    def fits(kind, m):
        digits = re.sub(r"[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
            return 16 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return {k: [m.span() for m in re.finditer(p, text) if fits(k, m[0])] for k, p in REGEX.items()}


def test_private_spans_equal_the_patterns():
    r = random.Random(4)
    bits = ["a", "@", ".", "b.c", "+1", "(", ") ", "-", " ", "555", "0174", "1.2.3.4", "256", "4994306639946210", "0846 2486 2295 2057", "é", "x_y%", "://", "\n", "%", "٣"]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        found = private.find_spans(text)
        assert {k: found[k] for k in REGEX} == private_by_regex(text), text


def test_private_more_spans(spark):
    assert private.find_spans("pay IBAN DE89 3704 0044 0532 0130 00 now, see https://u:p@x.org/a.")["iban"] == [(9, 36)]
    assert private.find_spans('token = "0b96a8c8d79c4a5085c9"')["secret"] == [(9, 29)]
    out = private.find_private(docs(spark, [None, "me@x.org", "me@x.org"])).orderBy("doc_id").collect()
    assert [x["spans"] for x in out] == ["", "email:0:8", "email:0:8"]
    assert out[1]["base_sha256"] == hashlib.sha256(b"email:0:8").hexdigest()


def test_language_of_single_mixed_and_empty_texts(spark):
    en, fr = "the house is on the hill and that was with this of them ", "le château est sur la colline avec des amis dans une ville "
    known = docs(spark, [en * i for i in range(1, 30)], "en").unionByName(docs(spark, [fr * i for i in range(1, 30)], "fr"))
    model = language.fit_languages(known)
    out = {r["doc_id"]: r for r in language.identify(docs(spark, [en, fr, en * 3 + fr, None, "", "12 34 !"]), model, ["doc_id"]).collect()}
    assert [out[i]["lang_pred"] for i in range(6)] == ["en", "fr", "en", "und", "und", "und"]
    assert out[0]["score"] == 1.0 and 0.5 < out[2]["score"] < 0.95 and out[3]["score"] == 0.0


@pytest.mark.parametrize("heavy", [1, 5, 1000])
def test_line_dedup(spark, heavy, monkeypatch):
    monkeypatch.setattr(lines, "HEAVY", heavy)
    texts = ["a\nb\nc", "x\na\n\nb\ny", "a\nb\nc", None, "", "z\nz\nz\nz", "a"]
    out = {r["doc_id"]: r for r in lines.drop_repeated_lines(docs(spark, texts)).collect()}
    assert [out[i]["text"] for i in range(7)] == ["a\nb\nc", "x\n\ny", "", None, "", "z", "a"]
    assert out[5]["n_removed"] == 3
    assert out[1]["n_removed"] == 2 and out[1]["n_runs"] == 1 and out[1]["taken"] == 5


@pytest.mark.parametrize("heavy", [1, 1000])
def test_line_dedup_of_a_long_line(spark, heavy, monkeypatch):
    monkeypatch.setattr(lines, "HEAVY", heavy)
    long, short = " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49))
    texts = [f"a\n{long}\nb", f"c\n{long}\nd", long, f"e\n{short}\nf", f"g\n{short}\nh", f"i\n{long}\n\n{long}"]
    out = {r["doc_id"]: r for r in lines.drop_repeated_lines(docs(spark, texts)).collect()}
    assert [out[i]["text"] for i in range(6)] == [texts[0], "c\nd", "", texts[3], texts[4], "i\n"]
    assert [(out[i]["n_removed"], out[i]["n_runs"]) for i in (0, 1, 2, 5)] == [(0, 0), (1, 1), (1, 1), (2, 1)]
    assert lines.drop_repeated_lines(docs(spark, texts), min_words=None).filter("n_removed > 0").count() == 0


@pytest.mark.parametrize(("hot", "crowded"), [(4096, 512), (2, 512), (4096, 1), (4096, 3)])
def test_substrings_against_brute_force(spark, hot, crowded, monkeypatch):
    monkeypatch.setattr(substrings, "MERGE_ROWS", 200)
    r, words = vocabulary(8)
    base = [" ".join(r.choice(words) for _ in range(r.randint(5, 300))) for _ in range(20)]
    texts = list(base)
    for _ in range(70):
        t = r.choice(base)
        if r.random() < 0.6:
            w = t.split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
        else:
            a = r.randrange(len(t))
            texts.append(r.choice(words) * 3 + t[a : a + r.randint(380, 480)] + " ".join(r.choice(words) for _ in range(50)))
    texts += ["a" * 1500, "ab" * 700, None, "", "x" * 400, "x" * 399]
    count, raw = Counter(), [(t or "").encode() for t in texts]
    for b in raw:
        count.update(b[p : p + 400] for p in range(len(b) - 399))
    got = {x["doc_id"]: x for x in substrings.repeated_substrings(docs(spark, texts).repartition(4), 400, hot, crowded).collect()}
    for i, b in enumerate(raw):
        gone = bytearray(len(b))
        for p in range(len(b) - 399):
            if count[b[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_loser_tree_merges_and_knows_prefixes():
    r = random.Random(2)
    runs = [sorted(bytes(r.choices(b"ab", k=r.randint(0, 12))) for _ in range(r.randint(0, 30))) for _ in range(7)]

    class Plain:
        def __init__(self, rows):
            self.rows, self.at, self.last = rows, 0, b""

        def next(self):
            if self.at == len(self.rows):
                return None
            text = self.rows[self.at]
            known = substrings._common(self.last, text, 0)
            self.at, self.last = self.at + 1, text
            return text, known

    plain, out, last = [Plain(x) for x in runs], [], b""
    heads = [list(x) for x in runs]
    for i, known in substrings.merge_runs(plain):
        text = heads[i].pop(0)
        assert not out or known == substrings._common(last, text, 0)
        out.append(text)
        last = text
    assert out == sorted(sum(runs, []))


def edit_distance_inside(item, window):
    row = [0] * (len(window) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, w in enumerate(window, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != w)))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark):
    r, words = vocabulary(6)
    items = [" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(12)]
    texts = [None, "", "nothing"]
    for _ in range(60):
        t = list(r.choice(items))
        for _ in range(r.randint(0, 12)):
            t[r.randrange(len(t))] = r.choice(["", "q", "zz"])
        texts.append(" ".join(r.choice(words) for _ in range(5)) + " " + "".join(t).upper() + "\n" + r.choice(words))
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, " ")], "item_id long, text string")
    want = set()
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            d = edit_distance_inside(decontaminate.normalize(item), decontaminate.normalize(t))
            if d <= decontaminate.error_budget(decontaminate.normalize(item)):
                want.add((i, k, d))
    for size in (10**6, 300):
        assert {tuple(x) for x in decontaminate.find_leaks(docs(spark, texts), bench, pass_chars=size).collect()} == want


def test_chat_collapse(spark):
    talk = lambda c, turns: [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(turns)]
    rows = talk(1, "ab") + talk(2, "abc") + talk(3, "abc") + talk(4, "abd") + talk(5, "b") + talk(5, "b") + [(None, 0, None, None)]
    out = {r["conv_id"]: r["chat"] for r in chat.collapse_and_render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {2, 4, 5, None}
    assert out[5] == "<|im_start|>user\nb<|im_end|>"
    long = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    assert [(r["part"], r["n_turns"]) for r in chat.collapse_and_render(long).orderBy("part").collect()] == [(i, 3000) for i in range(6)]


def test_toxicity_learns_a_lexicon():
    r, words = vocabulary(12)
    texts = [" ".join([r.choice(words) for _ in range(40)] + ["scum", "moron"][: i % 2]) for i in range(300)]
    slots = [s[w] for s, rows in toxicity.word_slots(pa.array(texts)) for w in rows]
    labels = np.array([i % 2 for i in range(300)])
    net = toxicity.fit(slots[:240], labels[:240], np.zeros(240, np.int64), np.ones(240))
    said = [net.logit(net.project(s), np.arange(len(s))) > net.thresholds[0] for s in slots[240:]]
    assert np.mean(np.array(said) == labels[240:]) > 0.95


def test_toxicity_steps_on_empty_and_short_texts():
    texts = ["", "vile", "", "vile trash", "fine day out here", "", "x"] * 4
    slots = [s[w] for s, rows in toxicity.word_slots(pa.array(texts)) for w in rows]
    labels = np.array([int("vile" in t) for t in texts])
    net = toxicity.fit(slots, labels, np.zeros(len(texts), np.int64), np.ones(len(texts)))
    z = np.array([net.logit(net.project(t), np.arange(len(t))) for t in slots])
    assert np.isfinite(z).all() and z[labels == 1].min() > z[labels == 0].max()
    toxicity.fit([s for s in slots if not len(s)], np.zeros(12, np.int64), np.zeros(12, np.int64), np.ones(12))


def test_toxicity_without_labels(spark):
    some = docs(spark, ["a b", None, ""])
    speech = language.fit_languages(some)
    net = toxicity.fit_toxicity(some, spark.createDataFrame([], "doc_id long, toxic int"), speech)
    out = toxicity.score(some, net, speech).collect()
    assert len(out) == 3 and all(0 <= r["score"] <= 1 for r in out)
