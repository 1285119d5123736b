"""Key-value text, archives, payloads and sinks."""

from __future__ import annotations

import io
import json
import os
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.schema import K

#: Characters of an archive's text that are unpacked at a time, about.
ARCHIVE_CHARS = 1 << 22

def parse_kv(line: Column) -> Column:
    """Map of a ``{K=V, K=V}`` line, or null; pairs without = are dropped, the last of equal keys wins."""
    body = F.regexp_replace(F.trim(line), r"^\{|\}$", "")
    pairs = F.filter(F.split(body, r",\s+"), lambda p: F.instr(p, "=") > 0)
    pairs = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.substr(p, F.instr(p, "=") + 1)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.when(F.trim(line).rlike(r"^\{.*\}$"), F.map_from_entries(last))


def read_kv_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(parse_kv(F.col("value")).alias("kv")).filter("kv is not null")


def read_kv_archives(spark: SparkSession, path: str, max_files: int = 50, chars: int = ARCHIVE_CHARS) -> DataFrame:
    """Lines of the first ``max_files`` zip archives by name: of each, its history text.

    A task holds the compressed bytes of one archive (2 GB at most, Spark's bound of a value) and about
    ``chars`` characters of its text: the member is unpacked as a stream and its lines leave in
    portions.  Bytes that are no UTF-8 are replaced.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    first = files.select("path").orderBy("path").limit(max_files)

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    texts = [n for n in z.namelist() if n.lower().endswith(".txt")]
                    chosen = [n for n in texts if "HIST" in n] or [n for n in texts if not n.startswith("__")]
                    if chosen:
                        with z.open(chosen[0]) as raw, io.TextIOWrapper(raw, "utf-8", errors="replace") as lines:
                            while portion := lines.readlines(chars):
                                yield pd.DataFrame({"path": name, "value": [x.rstrip("\n") for x in portion]})

    lines = files.join(first, "path", "left_semi").select("path", "content").mapInPandas(unpack, "path string, value string")
    return lines.select("path", nomenclature(F.col("path")).alias("ID_NOMENCLATURE"), parse_kv(F.col("value")).alias("kv")).filter("kv is not null")


def write_kv_archives(df: DataFrame, line: Column, path: str, parts: int = 1) -> DataFrame:
    """Lines zipped by ID_NOMENCLATURE, in ``parts`` archives each, as data_CENTRALE_{nomenclature}_{part}.zip.

    Executors write to ``path`` as a local path, so it must be a file system that all of them mount.
    Lines stream into an archive, which gets its name when it is whole.  Returns path and lines of each.
    """
    scheme, folder = path.split(":", 1) if ":" in path else ("file", path)
    if scheme != "file":
        raise ValueError("archives can be written to a mounted file system only")
    folder = "/" + folder.lstrip("/")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        at, done, archive, member, hidden, count = None, [], None, None, "", 0

        def close() -> None:
            if archive:
                member.close()
                archive.close()
                name = f"{folder}/data_CENTRALE_{at[0]}_{at[1]}.zip"
                os.replace(hidden, name)
                done.append((name, count))

        for frame in frames:
            for nom, part, value in zip(frame["nom"], frame["part"], frame["value"]):
                if (nom, part) != at:
                    close()
                    at, count, hidden = (nom, part), 0, f"{folder}/.{uuid.uuid4().hex}"
                    archive = zipfile.ZipFile(hidden, "w", zipfile.ZIP_DEFLATED)
                    member = archive.open(f"HIST_{nom}_{part}.txt", "w", force_zip64=True)
                member.write(value.encode() + b"\n")
                count += 1
        close()
        yield pd.DataFrame(done, columns=["path", "lignes"])

    keyed = df.select(F.col("ID_NOMENCLATURE").alias("nom"), line.alias("value")).withColumn("part", F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int"))
    return keyed.repartition("nom", "part").sortWithinPartitions("nom", "part").mapInPandas(pack, "path string, lignes long")


def nomenclature(path: Column) -> Column:
    return F.regexp_extract(path, r"data_CENTRALE_(\d+)_(\d+)\.zip", 1).try_cast("int")


def file_number(path: Column) -> Column:
    return F.regexp_extract(path, r"data_CENTRALE_(\d+)_(\d+)\.zip", 2).try_cast("int")


def read_semicolon_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep=";", header=True, schema=schema)


def read_series_class(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, sep=";", header=True)
    if not {"ID_PRODUIT", "ID_SO", "classification"} <= set(df.columns):
        raise ValueError("a class file needs ID_PRODUIT, ID_SO and classification")
    return df.select(*[F.col(k).cast("long").alias(k) for k in K], "classification")


def read_sales_jdbc(spark: SparkSession, options: dict[str, str], query: str = "", table: str = "", column: str = "", parts: int = 8, predicate: str = "") -> DataFrame:
    """Rows of a database; address and credentials come from the caller.

    A ``query`` is pulled by one task.  A ``table`` is read in ``parts`` ranges of ``column`` (a number,
    date or timestamp), each a query of its own; their bounds are the column's extremes, which the database
    finds.  ``predicate`` (in the database's SQL) is part of every query; filters and selections of the result are
    pushed down, too.
    """
    source = spark.read.format("jdbc").options(**options)
    if query:
        return source.option("query", query).load()
    where = f" where {predicate}" if predicate else ""
    low, high = source.option("query", f"select min({column}) as lo, max({column}) as hi from {table}{where}").load().first()
    rows = spark.read.format("jdbc").options(**options).option("dbtable", f"(select * from {table}{where}) t" if where else table)
    if low is not None and parts > 1:
        rows = rows.option("partitionColumn", column).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", parts)
    return rows.load()


def write_semicolon_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def write_by_class(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("sb_class").parquet(path)


def sample_cache(spark: SparkSession, path: str, build, rebuild: bool = False) -> DataFrame:
    """Cached samples by class and split; built where they are missing or a rebuild is asked for."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if rebuild or not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").partitionBy("sb_class", "is_test").parquet(path)
    return spark.read.parquet(path)


def to_kv_line(df: DataFrame, cols: list[str]) -> Column:
    """``{K=V, …}`` of a row; null, NaN, infinite values and values with any of , = " { } are left out."""
    types = dict(df.dtypes)

    def part(c: str) -> Column:
        text = F.col(c).cast("string")
        ok = text.isNotNull() & ~text.rlike(r'[,="{}]')
        if types[c] in ("double", "float"):
            ok = ok & ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf")))
        return F.when(ok, F.concat(F.lit(f"{c}="), text))

    return F.concat(F.lit("{"), F.array_join(F.filter(F.array(*[part(c) for c in cols]), lambda x: x.isNotNull()), ", "), F.lit("}"))


def write_kv_text(df: DataFrame, line: Column, path: str) -> None:
    """All lines in one folder of text files, replaced each run."""
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def write_run_metadata(metrics: DataFrame, features: list[str], params: dict, history: DataFrame, path: str) -> None:
    """One JSON object for each row of ``metrics`` (a class), with parameters, features and the dates of the history."""
    span = history.agg(F.min("date").alias("date_min"), F.max("date").alias("date_max"))
    facts = {"features": F.array(*[F.lit(f) for f in features]), "params": F.lit(json.dumps(params, sort_keys=True))}
    metrics.crossJoin(F.broadcast(span)).withColumns(facts).write.mode("overwrite").json(path)


def read_json_table(spark: SparkSession, path: str, schema: str | None = None, lines: bool = True) -> DataFrame:
    """JSON objects by line, or with ``lines`` off one document per file; a schema saves a pass over the files."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def write_kv_by_nomenclature(df: DataFrame, line: Column, path: str) -> DataFrame:
    """Text files by nomenclature, replaced each run; returns the index of couples."""
    named = df.withColumn("ID_NOMENCLATURE", F.coalesce(F.col("ID_NOMENCLATURE").cast("string"), F.lit("unknown")))
    named.select("ID_NOMENCLATURE", line.alias("value")).write.mode("overwrite").partitionBy("ID_NOMENCLATURE").text(path)
    return named.select(*K, "ID_NOMENCLATURE").distinct().orderBy(*K)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """History rows of JSON requests; lists of unequal or no length give no rows."""
    schema = "LIST_HISTO array<map<string,string>>, LIST_QUANTITE array<string>, LIST_PARAMETRE array<string>, LIST_FUTURE array<map<string,string>>, ID_PRODUIT bigint, ID_SO bigint"
    return zip_history(spark.read.json(path, schema=schema))


def zip_history(requests: DataFrame) -> DataFrame:
    paired = requests.filter("size(LIST_HISTO) = size(LIST_QUANTITE) and size(LIST_HISTO) > 0")
    rows = paired.select(*K, F.explode(F.arrays_zip("LIST_HISTO", "LIST_QUANTITE")).alias("z"))
    day = F.try_to_date(F.col("z.LIST_HISTO")["DATE_IMPORT"], "dd/MM/yyyy")
    return rows.select(*K, day.alias("date"), F.greatest(F.coalesce(F.col("z.LIST_QUANTITE").try_cast("double"), F.lit(0.0)), F.lit(0.0)).alias("QUANTITE"), F.col("z.LIST_HISTO").alias("parametres"))


def forecast_json(df: DataFrame, value: str = "prediction") -> DataFrame:
    """Per couple, the JSON list of {date, value}, both as text, by date."""
    one = F.struct(F.col("date").alias("_d"), F.struct(F.date_format("date", "dd/MM/yyyy").alias("date"), F.col(value).cast("string").alias("value")).alias("o"))
    return df.groupBy(*K).agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["o"])).alias("forecast"))
