"""Readers and writers of records, pairs and reports."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

_VERSION = re.compile(r"_v(\d+)_")


def read_csv_strings(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header, every column a string, so that leading zeros stay."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def read_excel_strings(spark: SparkSession, path: str, chunk: int = 100_000) -> DataFrame:
    """A workbook's first sheet, every column a string.  A workbook is bounded by its format (1,048,576 rows)."""
    try:
        import pandas as pd

        frame = pd.read_excel(path, dtype=str)
    except ImportError as error:  # pandas needs an engine for workbooks
        raise RuntimeError("reading workbooks needs an Excel engine for pandas") from error
    schema = T.StructType([T.StructField(str(c), T.StringType()) for c in frame.columns])
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), schema)


def read_raw_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files of a folder as strings, with the name of each row's file as ``source_file``."""
    return spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file that holds one object or a list of them."""
    return spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database; needs the driver's jar on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def truthy(c: F.Column) -> F.Column:
    """Tolerant booleans of label files: true, 1 and 1.0 in any case; null stays null."""
    return F.lower(F.trim(c.cast("string"))).isin("true", "1", "1.0", "yes")


def read_labels(spark: SparkSession, path: str, a: str, b: str, label: str, ambiguous: str | None = None) -> DataFrame:
    """(id_a, id_b, label[, ambiguous]) of a label file, canonical, the last row of a pair."""
    rows = read_csv_strings(spark, path).where(F.col(a) != F.col(b))
    cols = [F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b"), truthy(F.col(label)).alias("label"), F.monotonically_increasing_id().alias("seq")]
    if ambiguous:
        cols.append(truthy(F.col(ambiguous)).alias("ambiguous"))
    value = F.struct("label", *(["ambiguous"] if ambiguous else []))
    return rows.select(*cols).groupBy("id_a", "id_b").agg(F.max_by(value, F.col("seq")).alias("v")).select("id_a", "id_b", "v.*")


def listing(spark: SparkSession, folder: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def latest_version(spark: SparkSession, folder: str, stem: str) -> str | None:
    """The newest ``<stem>_v<N>_<date>`` of a folder."""
    found = [(int(m[1]), n) for n in listing(spark, folder) if n.startswith(f"{stem}_v") and (m := _VERSION.search(n))]
    return f"{folder.rstrip('/')}/{max(found)[1]}" if found else None


def write_versioned(df: DataFrame, folder: str, stem: str, day: str, *sort: str) -> str:
    """Writes ``<stem>_v<N+1>_<date>``, sorted within partitions so that lookups skip row groups; returns the path."""
    found = [int(m[1]) for n in listing(df.sparkSession, folder) if n.startswith(f"{stem}_v") and (m := _VERSION.search(n))]
    path = f"{folder.rstrip('/')}/{stem}_v{max(found, default=0) + 1}_{day}"
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    return path


def content_hash(df: DataFrame) -> tuple[int, int]:
    """(rows, order-free hash) of a table, for manifests."""
    n, h = df.agg(F.count(F.lit(1)), F.expr(f"coalesce(bit_xor(xxhash64({', '.join(f'`{c}`' for c in df.columns)})), 0)")).first()
    return n, h


def write_run(folder: str, run_id: str, artifacts: dict[str, DataFrame]) -> dict:
    """Writes every artifact as Parquet below ``folder/run_id`` and a manifest with counts and hashes; returns it."""
    manifest: dict = {"run_id": run_id, "artifacts": {}}
    spark = next(iter(artifacts.values())).sparkSession
    for name, df in artifacts.items():
        path = f"{folder.rstrip('/')}/{run_id}/{name}"
        df.write.parquet(path)
        rows, digest = content_hash(spark.read.parquet(path))
        manifest["artifacts"][name] = {"path": path, "rows": rows, "hash": f"{digest & (1 << 64) - 1:016x}"}
    put_text(spark, f"{folder.rstrip('/')}/{run_id}/manifest.json", json.dumps(manifest, indent=1))
    return manifest


def modified(spark: SparkSession, path: str) -> int:
    """When a file was last written, in milliseconds."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).getModificationTime()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_manifest(spark: SparkSession, folder: str, run_id: str) -> dict:
    rows = spark.read.text(f"{folder.rstrip('/')}/{run_id}/manifest.json", wholetext=True).collect()
    return json.loads(rows[0][0])


def newest_run_with(spark: SparkSession, folder: str, artifact: str) -> str | None:
    """The last run, by id, whose manifest lists the artifact."""
    for run in sorted(listing(spark, folder), reverse=True):
        if "manifest.json" in listing(spark, f"{folder.rstrip('/')}/{run}") and artifact in read_manifest(spark, folder, run)["artifacts"]:
            return run
    return None


def write_review_batches(rows: DataFrame, folder: str, batch: str = "batch") -> None:
    """One CSV folder per review batch, and an index file (batch, rows) beside them."""
    counts = rows.groupBy(batch).agg(F.count(F.lit(1)).alias("rows")).orderBy(batch).collect()  # one row a batch
    put_text(rows.sparkSession, f"{folder.rstrip('/')}-index.csv", "batch,rows\n" + "".join(f"{r[batch]},{r['rows']}\n" for r in counts))
    rows.write.partitionBy(batch).option("header", True).csv(folder)


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(report, metric, value) of a folder of flat JSON reports, for trends."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").withColumn("report", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return raw.select("report", F.explode(F.from_json("value", "map<string,string>")).alias("metric", "value")).withColumn("value", F.expr("try_cast(value as double)")).where("value is not null")


def write_report(spark: SparkSession, folder: str, name: str, metrics: dict) -> None:
    """A report as flat JSON: numbers of nested groups get dotted names, so that ``read_reports`` finds every one."""

    def flat(prefix: str, value: object) -> dict:
        if isinstance(value, dict):
            return {k: v for key, x in value.items() for k, v in flat(f"{prefix}.{key}" if prefix else str(key), x).items()}
        return {prefix: value}

    put_text(spark, f"{folder.rstrip('/')}/{name}.json", json.dumps(flat("", metrics)))


def report_trend(reports: DataFrame, metric: str) -> DataFrame:
    """(report, value, change): one metric over all reports in the order of their names, with the change since the one before."""
    before = F.lag("value").over(Window.partitionBy("metric").orderBy("report"))  # one row a report
    return reports.where(F.col("metric") == metric).select("report", "value", (F.col("value") - before).alias("change"))
