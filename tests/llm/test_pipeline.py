"""The stages of the corpus pipeline on small odd tables, and the pipeline against a plain version of its stages."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import language, lines, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _id int, score string, LANG_PRED int, n_removed string, c0 int, _t int, id int"
EN = ["the river", "was cold", "and the", "old boat", "went down", "slowly with", "three men", "who said", "nothing at", "all until", "morning came", "over hills"]
DE = ["der fluss", "war kalt", "und das", "alte boot", "ging langsam", "unter mit", "drei leuten", "die nichts", "sagten bis", "der morgen", "kam über", "die hügel"]
ITEM = "benchmark question about seventeen purple lanterns hanging above quiet harbour gates tonight"


def prose(parts, seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(parts) for _ in range(n))


def rows():
    texts = {i: ((EN, "en") if i % 2 else (DE, "de")) for i in range(40)}
    out = [(i, prose(p, i), lang, f"s{i % 3}") for i, (p, lang) in texts.items()]
    long = "\n".join(f"{prose(EN, 1000 + k, 40)} {k}" for k in range(300))
    passage = prose(EN, 77, 70)
    near = prose(EN, 501, 150)
    out += [(100, None, "en", "s0"), (101, "", "en", "s1"), (102, "12 34 !?", "en", None), (103, long, "en", "s2"), (104, f"{prose(EN, 8)} {ITEM} {prose(EN, 9)}", "en", "s0")]
    out += [(105, near, "en", "s0"), (106, near + " the end", "en", "s1"), (107, near, "en", "s2"), (107, near, "de", "s2"), (107, near, "de", "s2"), (None, prose(DE, 55), "de", "s1")]
    out += [(108, f"{prose(EN, 221)}\n{passage}\n{prose(EN, 222)}", "en", "s0"), (109, f"{prose(EN, 223)}\n{passage}\n{prose(EN, 224)}", "en", "s0")]
    return [(i, t, lang, s, len(t or ""), 1, "x", 2, "y", 3, 4, 5) for i, t, lang, s in out]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, " ")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables(spark, sf, name, stage):
    none = spark.createDataFrame([], COLUMNS)
    out = stage(spark, none, sf)
    assert out.count() == 0
    if name != "mixing":
        assert out.columns == none.columns


def test_each_stage_keeps_columns_and_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages, clean = dict(corpus_pipeline.STAGES), set(range(40))
    ids = lambda df: sorted((r[0] for r in df.select("doc_id").collect()), key=lambda i: (i is None, i))
    for name, gone in (("language", {100, 101, 102}), ("line_dedup", set()), ("near_duplicates", {106, 107}), ("decontamination", {104})):
        out = stages[name](spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        found = out.collect()
        assert clean <= {r["doc_id"] for r in found} and not gone & {r["doc_id"] for r in found}
        assert all((r["_id"], r["score"], r["LANG_PRED"], r["n_removed"], r["c0"], r["_t"], r["id"]) == (1, "x", 2, "y", 3, 4, 5) for r in found)
        if name == "line_dedup":
            # the long line and the repeated documents stay once; a document left without text goes
            text = {r["doc_id"]: r["text"] for r in found}
            assert text[108].count("\n") == 2 and text[109].count("\n") == 1 and 107 not in text and 105 in text
            assert all(r["n_chars"] == len(r["text"] or "") for r in found)
        elif name == "near_duplicates":
            assert None in ids(out) and 103 in ids(out)
        else:
            assert len(found) == docs.count() - docs.filter(F.col("doc_id").isin(list(gone))).count()


def test_one_row_stays_of_rows_with_one_id_and_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id = 107")
    for some in (docs, docs.orderBy(F.desc("lang"))):
        (row,) = corpus_pipeline.near_duplicate_stage(spark, some, sf).collect()
        assert row["lang"] == "de"
    (row,) = corpus_pipeline.near_duplicate_stage(spark, docs.select("doc_id", "text"), sf).collect()
    assert row["doc_id"] == 107


def test_the_pipeline_is_its_stages_one_after_another(spark, sf):
    out = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(range(40)) | {103, 105, 108, 109, None} == set(out)
    assert all(n >= 0 for n in out.values()) and sum(out.values()) > 0


def test_copies_do_not_push_a_language_out_of_the_sample(spark):
    copies = [(1, prose(EN, 5), "en")] * 3000 + [(2, prose(DE, 6), "de")]
    model = language.fit_languages(spark.createDataFrame(copies, "doc_id long, text string, lang string"), per_language=100)
    assert model.languages == ["de", "en"]
    assert model.infer(prose(EN, 9))[0] == "en" and model.infer(prose(DE, 10))[0] == "de"
    many = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"))
    assert 60 < language.sampled(many, "lang", 100).count() < 150


def test_names_of_columns_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "a b\nc d", 7, 8, "p"), (2, "x\na b\nc d", 9, 10, "q")], "doc_id long, text string, _t long, c1 int, n_runs string")
    out = {r["doc_id"]: r for r in lines.drop_repeated_lines(docs).collect()}
    assert (out[1]["_t"], out[1]["c1"], out[2]["_t"], out[2]["text"], out[2]["n_runs"], out[2]["n_removed"]) == (7, 8, 9, "x", 1, 2)
    kept = lines.drop_repeated_lines(docs, names=("a", "b", "c")).filter("doc_id = 2").first()
    assert (kept["n_runs"], kept["a"], kept["b"], kept["c"]) == ("q", 3, 2, 1)
    with pytest.raises(ValueError):
        language.identify(docs.withColumn("Score", F.lit(1)), language.fit_languages(docs.withColumn("lang", F.lit("en"))), ["doc_id", "Score"])


def test_line_counts_without_ansi(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        docs = spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string")
        assert {r["n_removed"] for r in lines.drop_repeated_lines(docs).collect()} == {0}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_sample_of_labelled_texts_is_bounded_by_words(spark, monkeypatch):
    texts = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("word other "), F.when(F.col("id") % 3 == 0, "trash ").otherwise(""), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    labels = texts.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("toxic"))
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda slots, toxic, *rest: seen.append((slots, toxic)))
    speech = language.fit_languages(texts.withColumn("lang", F.lit("en")))
    toxicity.fit_toxicity(texts.unionByName(texts), labels.unionByName(labels), speech)
    toxicity.fit_toxicity(texts, labels, speech, words_per_label=40)
    assert [len(s) for s, _ in seen][0] == 300 and seen[0][1].sum() == 100
    for label in (0, 1):
        words = sum(len(s) for s, y in zip(*seen[1]) if y == label)
        assert 40 <= words <= 44
