"""Continuous matching and splitting (S8) with Structured Streaming.

New versions arrive as files in a landing folder.  A version can only be
matched together with its neighbours, so the job keeps two tables in hash
buckets of the entry: the versions that have arrived, and the results.

* A micro-batch adds its rows to the version table and finds the entries it
  touches.  Their versions are read from the touched buckets only.
* Results of touched entries are made anew; those of the other entries of a
  touched bucket are carried over from its last generation.  Buckets that
  aren't touched aren't read or written.
* A manifest names, per bucket, the generation to read.  Each batch writes its
  data to a generation of its own and then one manifest, which appears whole or not
  at all (``sources.commits``).  A batch that is run again finds its manifest and does
  nothing; one that failed before it left data that nothing reads.  A
  bucket without results any more has no generation in the manifest.

A late version needs no watermark: it touches its entry again.  A version that
arrives again replaces the earlier one (in one batch the larger text).

The manifest's size is bounded by the number of buckets; set it from the
corpus's size and keep it.  Progress lives in the checkpoint folder (the
cluster's shared ``spark.checkpoint.dir``).
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revisionlens.operators.matching import match_articles, match_sentences
from revisionlens.operators.text import split_sentences
from revisionlens.schemas import ARTICLES
from revisionlens.session import materialize
from revisionlens.sources import commits

#: A bucket's versions are rewritten into one generation when they lie in more than so many.
COMPACT_AFTER = 16


def _bucket(n: int):
    return F.pmod(F.xxhash64("source", "entry_id"), F.lit(n)).cast("int")


def _manifest(spark: SparkSession, out_path: str) -> tuple[str | None, dict]:
    """Name and content of the latest manifest: ``{"versions": {bucket: [generation, ..]}, "results": {bucket: generation}, "schema"}``."""
    found = commits.names(spark, f"{out_path}/_manifests")
    if not found:
        return None, {"versions": {}, "results": {}, "schema": None}
    return found[-1], json.loads(commits.text(spark, f"{out_path}/_manifests", found[-1]))


def _versions(spark: SparkSession, out_path: str, held: dict[str, list[str]], buckets: list[int]) -> DataFrame | None:
    """The arrived rows of some buckets with the generation's place in its bucket's list."""
    out = None
    by_generation: dict[tuple[str, int], list[str]] = {}
    for b in buckets:
        for place, g in enumerate(held.get(str(b), [])):
            by_generation.setdefault((g, place), []).append(f"{out_path}/versions/{g}/bucket={b}")
    for (_, place), paths in sorted(by_generation.items()):
        part = spark.read.schema(ARTICLES).parquet(*paths).withColumn("place", F.lit(place))
        out = part if out is None else out.unionByName(part)
    return out


def process_batch(spark: SparkSession, batch: DataFrame, epoch: int, out_path: str, mode: str = "match", lexicon: DataFrame | None = None, buckets: int = 64) -> bool:
    """One micro-batch: its rows into the version table, its entries' results anew, one manifest.

    ``mode``: ``match`` (arcs of consecutive versions) or ``split`` (sentences).
    False if the batch was committed before.
    """
    name = f"{epoch:020d}.json"
    if name in commits.names(spark, f"{out_path}/_manifests"):
        return False
    _, manifest = _manifest(spark, out_path)
    generation = f"{epoch:020d}-{uuid.uuid4().hex}"
    rows = materialize(batch.select(*ARTICLES.fieldNames()).filter("entry_id is not null and version is not null").withColumn("bucket", _bucket(buckets)), "batch")
    touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())          # at most ``buckets`` numbers
    if not touched:
        return commits.commit(spark, f"{out_path}/_manifests", name, json.dumps(manifest))

    # versions: the batch is one more generation; buckets with many are rewritten
    many = [b for b in touched if len(manifest["versions"].get(str(b), [])) >= COMPACT_AFTER]
    new = rows.drop("bucket").withColumn("place", F.lit(1 << 30))
    before = _versions(spark, out_path, manifest["versions"], touched)
    every = new if before is None else before.unionByName(new)
    latest = Window.partitionBy("source", "entry_id", "version").orderBy(F.desc("place"), F.desc("summary"))
    every = every.withColumn("rank", F.row_number().over(latest)).filter("rank = 1").drop("rank", "place").withColumn("bucket", _bucket(buckets))
    if many:
        every = materialize(every, "versions")
        stored = rows.filter(~F.col("bucket").isin(many)).unionByName(every.filter(F.col("bucket").isin(many)))
    else:
        stored = rows
    # dealt by bucket, so that files don't grow with tasks times buckets (large buckets are several files)
    stored.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{out_path}/versions/{generation}")
    for b in touched:
        manifest["versions"][str(b)] = [generation] if b in many else [*manifest["versions"].get(str(b), []), generation]

    # results of the touched entries anew, of the other entries of their buckets as they were
    ids = rows.select("source", "entry_id").distinct()
    todo = every.drop("bucket").join(ids, ["source", "entry_id"], "left_semi")
    if mode != "match":
        made = split_sentences(todo)
    elif lexicon is None:
        made = match_articles(todo, emptied=True)                        # reads them once
    else:
        todo = materialize(todo, "touched")
        made = match_sentences(materialize(split_sentences(todo), "touched-sentences"), lexicon, versions=todo)
    old = {b: manifest["results"][str(b)] for b in touched if manifest["results"].get(str(b))}
    if old:
        kept = spark.read.schema(made.schema).parquet(*[f"{out_path}/results/{g}/bucket={b}" for b, g in old.items()])
        made = made.unionByName(kept.join(ids, ["source", "entry_id"], "left_anti"))
    made.withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{out_path}/results/{generation}")
    full = commits.folders(spark, f"{out_path}/results/{generation}")
    for b in touched:
        manifest["results"][str(b)] = generation if f"bucket={b}" in full else None
    manifest["schema"] = made.schema.json()
    return commits.commit(spark, f"{out_path}/_manifests", name, json.dumps(manifest))


def start_continuous_matching(spark: SparkSession, landing_path: str, out_path: str, checkpoint: str | None = None, available_now: bool = True,
                              mode: str = "match", lexicon: DataFrame | None = None, buckets: int = 64, max_files: int | None = None):
    """Start the stream; ``available_now`` processes the backlog and stops.  ``max_files`` bounds a micro-batch."""
    ck = checkpoint or os.path.join(spark.conf.get("spark.checkpoint.dir"), "continuous-matching")
    reader = spark.readStream.schema(ARTICLES)
    stream = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(landing_path)

    def on_batch(batch: DataFrame, epoch: int) -> None:
        process_batch(batch.sparkSession, batch, epoch, out_path, mode, lexicon, buckets)

    w = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", ck)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_matches(spark: SparkSession, out_path: str) -> DataFrame:
    """The result table of the latest manifest."""
    _, manifest = _manifest(spark, out_path)
    if manifest["schema"] is None:
        raise ValueError(f"no batch in {out_path}")
    from pyspark.sql import types as T
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    paths = [f"{out_path}/results/{g}/bucket={b}" for b, g in manifest["results"].items() if g]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def drop_old_generations(spark: SparkSession, out_path: str) -> None:
    """Delete the generations that the latest manifest doesn't name, and all older manifests.  No batch or reader may run meanwhile."""
    name, manifest = _manifest(spark, out_path)
    used = {"versions": {g for gs in manifest["versions"].values() for g in gs}, "results": {g for g in manifest["results"].values() if g}}
    for kind, names in used.items():
        for g in commits.folders(spark, f"{out_path}/{kind}") - names:
            commits.delete(spark, f"{out_path}/{kind}/{g}")
    for old in commits.names(spark, f"{out_path}/_manifests"):
        if old != name:
            commits.delete(spark, f"{out_path}/_manifests/{old}")
