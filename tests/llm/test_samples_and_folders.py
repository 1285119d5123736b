import hashlib
import os

import numpy as np

from tidewell.llm import language, substrings, toxicity

DOCS = "doc_id long, text string, lang string, source string, toxic int"


def drawn(spark, monkeypatch, texts, labels, per_label):
    """Texts and labels that the classifier is fitted on: slots of words and label of each."""
    seen = {}

    def record(slots, toxic, spoken, stands):
        seen.update(n={v: int((toxic == v).sum()) for v in (0, 1)}, words={v: sorted(len(s) for s, t in zip(slots, toxic) if t == v) for v in (0, 1)}, stands=stands)
        return toxicity.TextCNN.fresh()

    monkeypatch.setattr(toxicity, "fit", record)
    docs = spark.createDataFrame([(i, t, "n", "s", 1) for i, t in enumerate(texts)], DOCS)
    toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), language.fit_languages(docs), per_label=per_label)
    return seen


def test_repeated_label_rows_leave_every_text(spark, monkeypatch):
    texts = [" ".join(["word"] * (i + 1)) for i in range(60)]
    labels = [(i, 1) for i in range(20) for _ in range(2000)] + [(i, 0) for i in range(20, 60)] + [(None, 1), (3, None)]
    seen = drawn(spark, monkeypatch, texts, labels, 100)
    assert seen["n"] == {1: 20, 0: 40} and seen["words"][1] == list(range(1, 21)) and np.allclose(seen["stands"], 1.0)


def test_copied_texts_count_once(spark, monkeypatch):
    texts = ["same text"] * 500 + [f"other {'w ' * i}" for i in range(30)]
    seen = drawn(spark, monkeypatch, texts, [(i, 1) for i in range(530)] + [(i, 0) for i in range(500, 530)], 40)
    assert seen["n"] == {1: 31, 0: 30}


def test_scores_of_odd_texts(spark):
    speech = language.fit_languages(spark.createDataFrame([], DOCS))
    net = toxicity.fit_toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, toxic int"), speech)
    assert toxicity.score(spark.createDataFrame([], DOCS), net, speech).count() == 0
    rows = [(1, None, "n", "s", 1), (1, "", "n", "s", 1), (None, "word " * 200_000, "n", "s", 1), (2, "x", None, None, None)]
    out = toxicity.score(spark.createDataFrame(rows, DOCS), net, speech).collect()
    assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out)


def test_blocks_lie_in_the_shared_folder(spark, monkeypatch):
    """Nothing is left in the warehouse or the catalog; a text larger than a block is one of its own."""
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 2000)
    warehouse = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    before = set(os.listdir(warehouse)) if os.path.isdir(warehouse) else set()
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(9000))
    rows = [(1, long, "n", "s", 1), (2, long[3000:3500], "n", "s", 1), (3, "short", "n", "s", 1)]
    out = {r["doc_id"]: r for r in substrings.repeated_substrings(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[1]["n_bytes"] == 9000 and out[1]["n_removed"] >= 500 and out[2]["n_removed"] == 500 and out[3]["n_removed"] == 0
    assert (set(os.listdir(warehouse)) if os.path.isdir(warehouse) else set()) == before
    assert not [t for t in spark.catalog.listTables() if "tidewell" in t.name]
    assert [n for n in os.listdir(spark.conf.get("spark.checkpoint.dir")) if n.startswith("substring-blocks")]


def labelled(spark, n):
    """Texts of which a fifth are toxic by one of 20 words, each row twice, with labels repeated."""
    r = np.random.default_rng(5)
    toxic = [int(i % 5 == 0) for i in range(n)]
    texts = [" ".join([*[f"{'abcdefghij'[k % 10] * 3}{'klmnopqrst'[k // 10]}" for k in r.integers(0, 100, 15)], f"vile{'abcdefghijklmnopqrst'[i % 20]}" if t else f"nr{'qrstuvwxyz'[i % 10]}"]) for i, t in enumerate(toxic)]
    docs = spark.createDataFrame([(i, t, "n", "s", 1) for i, t in enumerate(texts)] * 2, DOCS)
    return docs, spark.createDataFrame([*enumerate(toxic), *enumerate(toxic), (None, 1), (3, None)], "doc_id long, toxic int"), texts, toxic


def test_every_labelled_text_teaches(spark, monkeypatch):
    """No bound of a sample leaves a text out: each is in one shard, once, and the shards train or judge all of them."""
    docs, labels, texts, toxic = labelled(spark, 300)
    monkeypatch.setattr(toxicity, "PER_LABEL", 10)
    speech = language.fit_languages(docs)
    rows, n = toxicity.shards(docs, labels, speech, texts=50)
    found = rows.collect()
    assert n == 6 and len({r["shard"] for r in found}) == 6 and sum(r["toxic"] for r in found) == 60
    assert len(found) == len({r["h"] for r in found}) == len(set(texts)) == 300 and 30 < sum(r["held"] for r in found) < 90
    seen, cut = [], toxicity._cut
    monkeypatch.setattr(toxicity, "_cut", lambda bins: seen.append(sum(r["n"] for r in bins)) or cut(bins))
    net = toxicity.fit_on_all(docs, labels, speech, texts=50, steps=200)
    assert seen[0] == sum(r["held"] for r in found)
    out = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(docs, net, speech).collect()}
    assert np.mean([out[i] == bool(t) for i, t in enumerate(toxic)]) > 0.9
    again = toxicity.fit_on_all(docs.repartition(3), labels, speech, texts=50, steps=200)
    assert (again.embed == net.embed).all() and again.thresholds == net.thresholds


def test_a_round_moves_the_words_of_each_shard(spark):
    """A word that one shard has keeps that shard's step; a net comes back whole from its rows."""
    start = toxicity.pack(toxicity.TextCNN.fresh(), {})
    net, sums = toxicity.unpack(start)
    assert (toxicity.pack(net, sums) == start).all() and net.base == 0
    each = [(s, 1, h, np.full(3 * 4, 100 * s + h, "<u2").tobytes()) for s in (1, 2) for h in range(8)]
    rows = spark.createDataFrame(each, "shard int, toxic int, h long, slots binary").repartition(2, "shard").sortWithinPartitions("shard", "h")
    both, one = toxicity._round(rows, start, 5, 0.1, 1), toxicity._round(rows.filter("shard = 1"), start, 5, 0.1, 1)
    used = (one[: toxicity.BUCKETS] != start[: toxicity.BUCKETS]).any(axis=1)
    assert used.any() and (both[: toxicity.BUCKETS][used] == one[: toxicity.BUCKETS][used]).all()
    assert (both[200:208] != start[200:208]).any() and (toxicity._round(rows.filter("false"), start, 5, 0.1, 1) == start).all()


def test_fit_on_no_labels(spark):
    speech = language.fit_languages(spark.createDataFrame([], DOCS))
    net = toxicity.fit_on_all(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, toxic int"), speech)
    assert net.thresholds == {-1: 0.0} and net.base == 0


def test_op8_returns_the_text_without_planted_passages(spark, tmp_path):
    r = np.random.default_rng(8)
    words = ["".join(r.choice(list("abcdefgé"), r.integers(3, 12))) for _ in range(3000)]
    prose = lambda n: " ".join(r.choice(words, n))
    clean = [prose(150) for _ in range(30)]
    passages = [prose(k) for k in range(80, 110)]
    planted = [f"{prose(40)} é{p}{end} {prose(40)}" for p in passages for end in ("é", "è")]
    texts = [*clean, *planted]
    spark.createDataFrame([(i, t, "n", "s", 1) for i, t in enumerate(texts)], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = {x["doc_id"]: x for x in substrings.op8_substring_dedup(spark, str(tmp_path)).collect()}
    assert len(out) == len(texts) and min(len(p.encode()) for p in passages) >= 400
    for i, t in enumerate(texts):
        x, raw = out[i], t.encode()
        spans = [tuple(map(int, s.split(":"))) for s in x["spans"].split(",") if s]
        kept = b"".join(raw[a:b] for a, b in zip([0, *[s[1] for s in spans]], [*[s[0] for s in spans], len(raw)]))
        assert (x["n_bytes"], x["n_removed"], x["n_spans"]) == (len(raw), sum(b - a for a, b in spans), len(spans))
        assert x["kept_sha256"] == hashlib.sha256(kept).hexdigest() and x["text"] == kept.decode(errors="replace")
        if i < len(clean):
            assert x["text"] == t and not spans
        else:
            assert len(spans) == 1 and passages[(i - len(clean)) // 2].encode() in raw[slice(*spans[0])]
    # é and è share their first byte, so the cut of a repeated passage falls inside them
    assert all("�" in out[i]["text"] for i in range(len(clean), len(texts)))
