"""Sources (S1-S4, S7): version tables in, typed and keyed.

Readers take an explicit schema where the format allows, push filters and
column pruning down to the file scan, and never route rows through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revisionlens.schemas import ARTICLES


def read_versions(spark: SparkSession, path: str, source: str | None = None, fmt: str = "parquet",
                  columns: dict[str, str] | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Load a version table and cast it to ``entry_id LONG, version INT,
    summary STRING, source STRING``.

    Keys and versions may be stored loosely (``"3"``, ``3.0``, ``"3.0"``); rows with one
    that is no whole number are left to :func:`rejected_versions`.
    ``columns`` maps input names to those four (e.g. ``{"conv_id": "entry_id"}``);
    ``source`` is added as a literal when the input has no such column.
    """
    df = _typed_versions(spark, path, source, fmt, columns, options)
    return df.filter("NOT _rejected").select(*ARTICLES.fieldNames())


def rejected_versions(spark: SparkSession, path: str, source: str | None = None, fmt: str = "parquet",
                      columns: dict[str, str] | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """The rows that :func:`read_versions` leaves out, with key and version as they were written."""
    df = _typed_versions(spark, path, source, fmt, columns, options)
    return df.filter("_rejected").select(F.col("_raw.entry_id"), F.col("_raw.version"), "summary", "source")


def _whole(name: str, to: str):
    """A loosely stored whole number as ``to``; NULL for any other value."""
    text, number = F.trim(F.col(name).cast("string")), F.col(name).cast("string").try_cast("double")
    return F.coalesce(text.try_cast(to), F.when(number == F.floor(number), number.try_cast(to)))


def _typed_versions(spark, path, source, fmt, columns, options) -> DataFrame:
    reader = spark.read.format(fmt)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    if fmt == "csv":
        reader = reader.option("header", "true")
    df = reader.load(path)
    for old, new in (columns or {}).items():
        df = df.withColumnRenamed(old, new)
    if source is not None:
        df = df.withColumn("source", F.lit(source))
    raw = F.struct(F.col("entry_id").cast("string").alias("entry_id"), F.col("version").cast("string").alias("version"))
    typed = df.select(_whole("entry_id", "long").alias("entry_id"), _whole("version", "int").alias("version"),
                      F.col("summary").cast("string").alias("summary"), F.col("source").cast("string").alias("source"), raw.alias("_raw"))
    bad = [F.col(c).isNull() & F.col(f"_raw.{c}").isNotNull() for c in ("entry_id", "version")]
    return typed.withColumn("_rejected", bad[0] | bad[1])


def read_bracketed_json(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """A file holding one JSON array with one object per line.

    Lines that are only ``[`` or ``]`` are skipped, a trailing comma is removed,
    the rest is parsed with ``schema``.  Returns ``(rows, rejects)``: lines that
    do not parse go to ``rejects`` with their text instead of failing the job.
    """
    lines = spark.read.text(path)
    body = lines.filter(~F.trim("value").isin("[", "]")).select(
        F.regexp_replace("value", ",$", "").alias("line"))
    with_bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = body.select("line", F.from_json("line", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    ok = F.trim("line").startswith("{") & F.col("r").isNotNull() & F.col("r._bad").isNull()
    return parsed.filter(ok).select(*[F.col("r")[f.name].alias(f.name) for f in schema.fields]), parsed.filter(~ok).select("line")


def pair_lookup(arcs: DataFrame, sentences: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: arcs of the given version pairs and the sentences of both versions.

    ``pairs`` has ``source, entry_id, version_x, version_y``; both lookups are
    semi joins on typed keys (pushed to the scan as runtime filters where the
    planner can).
    """
    keys = ["source", "entry_id", "version_x", "version_y"]
    a = arcs.join(pairs.select(*keys), keys, "left_semi")
    v = (pairs.select("source", "entry_id", F.explode(F.array("version_x", "version_y")).alias("version"))
              .distinct())
    s = sentences.join(v, ["source", "entry_id", "version"], "left_semi")
    return a, s


def list_tables(spark: SparkSession) -> DataFrame:
    """Names of the user tables and views of the current catalog."""
    rows = [(t.name, t.tableType, bool(t.isTemporary)) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, table_type string, is_temporary boolean")


def backlog_batch(articles: DataFrame, done_ids: DataFrame | None, n: int, start: int = 0) -> DataFrame:
    """All versions of the next ``n`` unfinished entry_ids (in id order,
    skipping the first ``start``).

    Finished ids leave by an anti join; the batch of ids is a bounded top-n
    (``orderBy.offset.limit``), then a semi join picks every version.
    """
    ids = articles.select("source", "entry_id").distinct()
    if done_ids is not None:
        keys = [c for c in ("source", "entry_id") if c in done_ids.columns]      # an id is finished within its source
        ids = ids.join(done_ids.select(*keys).distinct(), keys, "left_anti")
    batch = ids.orderBy("entry_id", "source").offset(start).limit(n)
    return articles.join(batch, ["source", "entry_id"], "left_semi")
