import pytest

from conftest import articles_df
from revisionlens.operators import matching as M
from revisionlens.operators import text as TX
from revisionlens.sources import commits
from revisionlens.streaming import continuous as CM

CM_MATERIALIZE = CM.materialize
COLUMNS = {"match": M.ARC_COLS, "split": ["source", "entry_id", "version", "sent_idx", "sentence"]}


def run(spark, tmp_path, batches, mode="match", **args):
    """Each batch lands and is processed by a run of the stream of its own."""
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    for rows in batches:
        articles_df(spark, rows).write.mode("append").parquet(landing)
        CM.start_continuous_matching(spark, landing, out, checkpoint=str(tmp_path / "ck"), mode=mode, **args).awaitTermination()
    return out, {tuple(r) for r in CM.read_matches(spark, out).select(*COLUMNS[mode]).collect()}


def batch_result(spark, rows, mode="match"):
    arts = articles_df(spark, rows)
    s = TX.split_sentences(arts)
    df = M.match_sentences(s, versions=arts) if mode == "match" else s
    return {tuple(r) for r in df.select(*COLUMNS[mode]).collect()}


FIRST = [(1, 0, "a b c. d e f."), (1, 2, "a b c. g h i."), (2, 0, "x y. z w."), (2, 1, "x y. q r."), (3, 0, "one two."), (3, 1, "one two. three.")]
LATE = [(1, 1, "a b c. d e f. late one.")]                                  # joins versions 0 and 2
THIRD = [(2, 1, "x y. other words."), (4, 0, "new entry."), (4, 1, "new entry. more.")]      # replaces a version, brings an entry


@pytest.mark.parametrize("mode", ["match", "split"])
def test_three_micro_batches_equal_one_batch(spark, tmp_path, mode):
    out, got = run(spark, tmp_path, [FIRST, LATE, THIRD], mode, buckets=3)
    rows = {(e, v): (e, v, t) for e, v, t in FIRST + LATE + THIRD}
    assert got == batch_result(spark, list(rows.values()), mode) and got
    assert len(commits.names(spark, f"{out}/_manifests")) == 3
    CM.drop_old_generations(spark, out)
    assert {tuple(r) for r in CM.read_matches(spark, out).select(*COLUMNS[mode]).collect()} == got


def test_a_bucket_that_becomes_empty_is_emptied(spark, tmp_path):
    out, got = run(spark, tmp_path, [[(1, 0, "a b."), (1, 1, "a b.")], [(1, 0, ""), (1, 1, "")]], buckets=2)
    assert got == set()
    out, got = run(spark, tmp_path / "again", [[(1, 0, "a b."), (1, 1, "a b."), (9, 0, "c."), (9, 1, "c.")], [(1, 0, ""), (1, 1, "")]], buckets=1)
    assert {r[1] for r in got} == {9}


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    arts = articles_df(spark, FIRST)
    assert CM.process_batch(spark, arts, 0, out, buckets=4)
    once = sorted(map(tuple, CM.read_matches(spark, out).select(*M.ARC_COLS).collect()), key=str)
    assert not CM.process_batch(spark, arts, 0, out, buckets=4)
    assert sorted(map(tuple, CM.read_matches(spark, out).select(*M.ARC_COLS).collect()), key=str) == once


def test_versions_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(CM, "COMPACT_AFTER", 2)
    batches = [[(1, v, f"a b c. part {v}.")] for v in range(5)]
    out, got = run(spark, tmp_path, batches, buckets=1)
    assert got == batch_result(spark, [r for b in batches for r in b])
    assert len(CM._manifest(spark, out)[1]["versions"]["0"]) <= 3


def test_a_batch_of_many_tasks_leaves_few_files(spark, tmp_path):
    import glob
    rows = [(e, v, f"a b c. part {v}.") for e in range(40) for v in range(3)]
    out = str(tmp_path / "out")
    assert CM.process_batch(spark, articles_df(spark, rows).repartition(8), 0, out, buckets=4)
    assert {tuple(r) for r in CM.read_matches(spark, out).select(*M.ARC_COLS).collect()} == batch_result(spark, rows)
    for kind in ("versions", "results"):
        assert len(glob.glob(f"{out}/{kind}/*/bucket=*/*.parquet")) <= 4


def test_a_batch_is_matched_by_articles(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(CM, "materialize", lambda df, name="table", *a, **k: (made.append(name), CM_MATERIALIZE(df, name, *a, **k))[1])
    assert CM.process_batch(spark, articles_df(spark, FIRST), 0, str(tmp_path / "out"), buckets=4)
    assert made == ["batch"]                   # neither the touched versions nor their sentences are written


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    assert "m6_matched_sentences" in E.queries()
