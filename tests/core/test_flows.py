import datetime as dt
import os
import zipfile

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidewell.functions.folders import names_in
from tidewell.operators import clean, windows
from tidewell.operators.quantiles import exact_quantiles
from tidewell.operators import quantiles
from tidewell.schema import K
from tidewell.sources import text
from tidewell.streaming import stats, upsert

DAY = dt.date(2024, 1, 1)
SALES = "ID_PRODUIT long, ID_SO long, date date, QUANTITE double"


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def run(spark, tmp_path, rows, batch):
    folder = f"{tmp_path}/in"
    spark.createDataFrame(rows, SALES).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SALES).parquet(folder)
    stats.stream_class_updates(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert names_in(spark, f"{tmp_path}/out/manifests")[-1] == f"{batch:020d}.json"


def test_only_changed_couples_are_written(spark, tmp_path):
    many = [(p, 1, DAY + dt.timedelta(i), float(i % 3)) for p in range(2000) for i in range(3)]
    run(spark, tmp_path, many, 0)
    run(spark, tmp_path, [(7, 1, DAY + dt.timedelta(10), 5.0)], 1)
    assert size_of(f"{tmp_path}/out/changes/1") * 4 < size_of(f"{tmp_path}/out/changes/0")
    now = {r["ID_PRODUIT"]: r for r in upsert.read_current(spark, f"{tmp_path}/out", K).collect()}
    assert len(now) == 2000 and now[7]["n"] == 4 and now[7]["somme"] == 8.0 and now[8]["n"] == 3


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string")
    upsert.upsert(frame([(1, "a"), (2, "a")]), 0, path, ["k"])
    upsert.upsert(frame([(2, "b"), (3, "b")]), 1, path, ["k"])
    wanted = {1: "a", 2: "b", 3: "b"}
    for _ in range(2):
        assert {r["k"]: r["v"] for r in upsert.read_current(spark, path, ["k"]).collect()} == wanted
        upsert.upsert(frame([(2, "b"), (3, "b")]), 1, path, ["k"])
    # a batch whose manifest was never written does not show
    frame([(9, "z")]).write.parquet(f"{path}/changes/2")
    assert upsert.read_current(spark, path, ["k"]).count() == 3
    with pytest.raises(ValueError):
        upsert.read_current(spark, str(tmp_path / "none"), ["k"])


def test_changes_are_merged_into_a_base(spark, tmp_path):
    path = str(tmp_path / "t")
    for number in range(8):
        upsert.upsert(spark.createDataFrame([(number % 3, number), (100 + number, number)], "k int, v int"), number, path, ["k"], merge_after=3)
    now = {r["k"]: r["v"] for r in upsert.read_current(spark, path, ["k"]).collect()}
    assert now == {0: 6, 1: 7, 2: 5} | {100 + i: i for i in range(8)}
    assert len(names_in(spark, f"{path}/changes")) < 8 and names_in(spark, f"{path}/bases")


def test_ingest_counts_what_it_leaves_out(spark, tmp_path):
    rows = [(1, 1, "2024", "2", "29", 1.0), (1, 1, "2023", "2", "29", 1.0), (1, 1, "2024.0", "1", "x", 1.0), (None, 1, "2024", "1", "1", 1.0), (1, None, "2024", "1", "1", 1.0), (1, None, "2024", "1", "1", None), (1, 1, "2017", "1", "1", 2.0)]
    raw = spark.createDataFrame(rows, "ID_PRODUIT int, ID_SO int, PARAM_ANNEE string, PARAM_MOIS string, PARAM_JOUR string, QUANTITE double")
    seen = Observation("seen")
    assert sorted(str(r["date"]) for r in clean.counted_ingest(raw, seen).collect()) == ["2024-02-29", "None", "None", "None"]
    assert seen.get == {"lignes": 7, "sans_produit": 2, "sans_so": 1, "dates_invalides": 3}
    raw.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stats.stream_ingest(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    assert stats.ingest_counts(query) == seen.get and spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_late_rows_are_counted(spark, tmp_path):
    at = lambda day, hour=0: dt.datetime(2024, 1, day, hour)
    for i, rows in enumerate([[(at(1), 1.0), (at(10), 1.0)], [(at(11), 1.0), (at(12), 1.0)], [(at(2), 5.0), (at(3), 5.0), (at(12, 1), 1.0)]]):
        df = spark.createDataFrame([(t, "a", 1, v) for t, v in rows], "ts timestamp, event_type string, user_id int, value double")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i == 0:
            schema = df.schema
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = stats.stream_daily_demand(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    assert stats.late_rows(query) == 2


def test_versions_in_force_join_no_couple(spark):
    day = lambda n: DAY + dt.timedelta(n)
    rows = spark.createDataFrame([(p, 1, day(i), float(i)) for p in (1, 2) for i in range(8)], SALES)
    versions = spark.createDataFrame([(1, 1, day(2), "a"), (1, 1, day(5), "b"), (3, 1, day(0), "c")], "ID_PRODUIT long, ID_SO long, date date, modele string")
    out = windows.version_in_force(rows, versions, ["modele"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert [(r["QUANTITE"], r["modele"], r["version"]) for r in out.orderBy("date").collect()] == [(float(i), "a" if i < 5 else "b", day(2 if i < 5 else 5)) for i in range(2, 7)]
    assert windows.version_in_force(rows, versions, ["modele"], inside=False).count() == 16


def test_table_of_a_database_is_read_in_ranges(spark):
    options = {"url": "jdbc:derby:memory:ranges;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.createDataFrame([(i, i % 5, DAY + dt.timedelta(i % 90), float(i)) for i in range(1, 1001)], SALES)
    rows.write.format("jdbc").options(**options).option("dbtable", "sales").mode("overwrite").save()
    for column, quoted in (("ID_PRODUIT", '"ID_PRODUIT"'), ("date", '"date"')):
        out = text.read_sales_jdbc(spark, options, table="sales", column=quoted, parts=4)
        assert out.rdd.getNumPartitions() == 4 and out.count() == 1000
    out = text.read_sales_jdbc(spark, options, table="sales", column='"ID_PRODUIT"', parts=4, predicate='"ID_SO" = 3').filter("QUANTITE > 500").select("ID_PRODUIT", "QUANTITE")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "QUANTITE,500" in plan.split("PushedFilters")[1] and "date" not in plan.split("ReadSchema")[1] and out.rdd.getNumPartitions() == 4
    assert sorted(out.collect()) == [(i, float(i)) for i in range(1, 1001) if i % 5 == 3 and i > 500]
    assert text.read_sales_jdbc(spark, options, table="sales", column='"ID_PRODUIT"', predicate='"ID_SO" = 9').count() == 0


def test_archives_are_read_in_portions(spark, tmp_path):
    lines = [f"{{A={i}, B={'x' * 40}}}" for i in range(5000)]
    with zipfile.ZipFile(tmp_path / "data_CENTRALE_12_3.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x_HIST.txt", ("\r\n".join(lines) + "\nbad �\n").encode() + b"{A=\xff}\n")
    out = text.read_kv_archives(spark, str(tmp_path), chars=1000)
    assert out.count() == 5001 and out.filter("ID_NOMENCLATURE = 12").count() == 5001
    assert out.select(F.sum(F.col("kv")["A"].try_cast("long"))).first()[0] == sum(range(5000))
    rows = spark.createDataFrame([(i % 3, f"{{A={i}}}") for i in range(90)], "ID_NOMENCLATURE int, line string")
    made = text.write_kv_archives(rows, F.col("line"), f"{tmp_path}/out", parts=2).collect()
    assert sum(r["lignes"] for r in made) == 90 and len(made) == 6
    again = text.read_kv_archives(spark, f"{tmp_path}/out", max_files=4)
    assert again.select("path").distinct().count() == 4
    assert {(r["ID_NOMENCLATURE"], r["count"]) for r in text.read_kv_archives(spark, f"{tmp_path}/out").groupBy("ID_NOMENCLATURE").count().collect()} == {(0, 30), (1, 30), (2, 30)}
    with pytest.raises(ValueError):
        text.write_kv_archives(rows, F.col("line"), "hdfs://store/x")


def test_quantiles_narrow_their_brackets(spark, monkeypatch):
    """A small bound of what is gathered makes the search go on by sketches."""
    import numpy as np

    monkeypatch.setattr(quantiles, "GATHER", 60)
    monkeypatch.setattr(quantiles, "SMALL", 10)
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=30_000), np.full(5000, 0.25), [1e9, -1e9]])
    probs = [0.0, 0.01, 0.5, 0.6, 0.77777, 0.999, 1.0]
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(4)
    assert np.allclose(exact_quantiles(df, {"x": (F.col("x"), probs)}, 500)["x"], np.quantile(x, probs), rtol=1e-12)
