from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scriptorium import session
from scriptorium.operators.numbered import numbered


def test_numbers_follow_the_order(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("v"))
    got = numbered(df, [F.col("v").desc()], "rank").collect()
    values = sorted((r.v for r in got), reverse=True)
    assert sorted((r["rank"], r.v) for r in got) == list(enumerate(values, 1))
    assert numbered(df.limit(0), [F.col("v")], "rank").count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(ValueError, match="share"):
        session.ensure_checkpoint_dir(Session())


def test_a_checkpoint_can_be_dropped(spark):
    df = session.cut(spark.range(10))
    assert df.count() == 10
    session.drop_checkpoint(df)
    with pytest.raises(Exception, match="(?i)checkpoint|exist"):
        df.count()
