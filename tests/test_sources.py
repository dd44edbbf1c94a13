import os

from conftest import articles_df
from revisionlens.sources import readers as RD
from revisionlens.sources import sinks as SK
from revisionlens.session import checkpoint_dir


def test_bracketed_json_with_reject(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('[\n{"a": 1, "b": "x"},\n{"a": 2, "b": "y"},\nnot json,\n{"a": 3, "b": "z"}\n]\n')
    ok, bad = RD.read_bracketed_json(spark, str(p), spark.createDataFrame([], "a long, b string").schema)
    assert sorted(r.a for r in ok.collect()) == [1, 2, 3]
    assert [r.line for r in bad.collect()] == ["not json"]


def test_append_batch_is_exactly_once(spark, tmp_path):
    df = articles_df(spark, [(1, 0, "x."), (1, 1, "y.")])
    for fmt in ("parquet", "csv"):
        out = str(tmp_path / fmt)
        assert SK.append_batch(df, out, 1, fmt) and not SK.append_batch(df, out, 1, fmt)
        # a batch that failed before its record
        df.write.partitionBy("source").format(fmt).save(f"{out}/batch-lost")
        assert SK.append_batch(articles_df(spark, [(2, 0, "z.")]), out, 2, fmt)
        back = SK.read_batches(spark, out)
        assert sorted((r.entry_id, r.version, r.summary, r.source) for r in back.collect()) == [(1, 0, "x.", "t"), (1, 1, "y.", "t"), (2, 0, "z.", "t")]
        assert back.schema["entry_id"].dataType.typeName() == "long"


def test_two_writers_of_one_record(spark, tmp_path):
    from revisionlens.sources import commits
    folder = str(tmp_path / "ledger")
    assert commits.commit(spark, folder, "a", "first") and not commits.commit(spark, folder, "a", "second")
    assert commits.names(spark, folder) == ["a"] and commits.text(spark, folder, "a") == "first"


def test_backlog_batch_and_list_tables(spark):
    df = articles_df(spark, [(i, v, "x.") for i in range(10) for v in range(2)])
    done = spark.createDataFrame([(0,), (1,)], "entry_id long")
    b = RD.backlog_batch(df, done, n=3, start=1)
    assert sorted({r.entry_id for r in b.collect()}) == [3, 4, 5] and b.count() == 6
    df.createOrReplaceTempView("versions_tmp")
    assert "versions_tmp" in {r.name for r in RD.list_tables(spark).collect()}


def test_checkpoint_dir_is_read_from_session(spark):
    d = checkpoint_dir(spark)
    assert d == spark.conf.get("spark.checkpoint.dir") and os.path.isdir(d)


def test_bracketed_json_rejects_broken_lines(spark, tmp_path):
    from pyspark.sql import types as T
    from revisionlens.sources import readers as R
    p = tmp_path / "x.json"
    p.write_text('[\n{"a": 1, "b": "x"},\n{"a": 2, "b":\n{"a": "zz", "b": "y"},\n{"a": 3, "b": null}\n]\n')
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    ok, bad = R.read_bracketed_json(spark, str(p), schema)
    assert sorted(r.a for r in ok.collect()) == [1, 3] and bad.count() == 2


def test_backlog_is_keyed_by_source(spark):
    from revisionlens.sources import readers as R
    arts = spark.createDataFrame([(1, 0, "t", "a"), (1, 0, "t", "b")], "entry_id long, version int, summary string, source string")
    done = spark.createDataFrame([("a", 1)], "source string, entry_id long")
    assert [r.source for r in R.backlog_batch(arts, done, 5).collect()] == ["b"]


def test_checkpoint_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace as N
    import pytest
    from revisionlens.session import checkpoint_dir
    far = N(conf=N(get=lambda k, d=None: None), sparkContext=N(getCheckpointDir=lambda: None, master="spark://somewhere:7077"))
    with pytest.raises(RuntimeError):
        checkpoint_dir(far)


def test_loose_versions_and_rejects(spark, tmp_path):
    path = tmp_path / "versions.csv"
    path.write_text("entry_id,version,summary\n7,1.0,a\n8, 2 ,b\n9,x,c\n9007199254740993,3,d\n10,1.5,e\n11,,f\n")
    args = (spark, str(path), "s", "csv")
    assert [tuple(r)[:2] for r in RD.read_versions(*args).orderBy("summary").collect()] == [(7, 1), (8, 2), (9007199254740993, 3), (11, None)]
    assert sorted(tuple(r) for r in RD.rejected_versions(*args).collect()) == [("10", "1.5", "e", "s"), ("9", "x", "c", "s")]
