"""Sinks (S5, S6): results out as partitioned tables or JSON records."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revisionlens.sources import commits


def append_batch(df: DataFrame, path: str, batch_id: str | int, fmt: str = "parquet", partition_by: tuple[str, ...] = ("source",)) -> bool:
    """Append one batch of results, partitioned by source, exactly once.

    The batch is staged in a folder of its own under ``path``; the record of
    ``batch_id`` in the ledger makes it part of the table.  A batch that is in
    the ledger already is skipped (False), one that failed before its
    record left nothing that is read; so a retry never doubles rows.
    """
    spark, name = df.sparkSession, f"{batch_id}.json"
    if name in commits.names(spark, f"{path}/_ledger"):
        return False
    folder = f"batch-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(f"{path}/{folder}")
    record = {"folder": folder, "format": fmt, "schema": df.schema.json()}
    if commits.commit(spark, f"{path}/_ledger", name, json.dumps(record)):
        return True
    commits.delete(spark, f"{path}/{folder}")
    return False


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches of the ledger as one table (columns by name; a table without batches is an error)."""
    records = [json.loads(commits.text(spark, f"{path}/_ledger", n)) for n in commits.names(spark, f"{path}/_ledger")]
    if not records:
        raise ValueError(f"no batch in {path}")
    out = None
    groups: dict[tuple[str, str], list[str]] = {}
    for r in records:
        groups.setdefault((r["format"], r["schema"]), []).append(f"{path}/{r['folder']}")
    for (fmt, schema), folders in groups.items():
        reader = spark.read.format(fmt).schema(T.StructType.fromJson(json.loads(schema)))
        reader = reader.option("header", "true") if fmt == "csv" else reader
        for f in folders:
            d = reader.load(f)
            out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def pair_key(df: DataFrame) -> DataFrame:
    """Text key of a version pair: ``('source', entry_id, version_x, version_y)``."""
    return df.withColumn("key", F.format_string("('%s', %d, %d, %d)", "source", "entry_id", "version_x",
                                                "version_y"))


def export_pairs_json(records: DataFrame, path: str | None = None) -> DataFrame:
    """One JSON object ``{nodes, arcs}`` per version pair, keyed by the text
    of its key.  Written as JSON lines when ``path`` is given."""
    out = pair_key(records).select(
        "key", F.to_json(F.struct("nodes", "arcs"), {"ignoreNullFields": "false"}).alias("record"))
    if path is not None:
        out.write.mode("overwrite").json(path)
    return out
