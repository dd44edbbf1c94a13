import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from revisionlens.session import checkpoint_dir
    s = (SparkSession.builder.master("local[4]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s


def sentences_df(spark, rows):
    """rows: (entry_id, version, [sentences])"""
    data = [("t", e, v, i, s) for e, v, sents in rows for i, s in enumerate(sents)]
    return spark.createDataFrame(data, "source string, entry_id long, version int, sent_idx int, sentence string")


def articles_df(spark, rows):
    """rows: (entry_id, version, summary)"""
    return spark.createDataFrame([(e, v, s, "t") for e, v, s in rows],
                                 "entry_id long, version int, summary string, source string")
