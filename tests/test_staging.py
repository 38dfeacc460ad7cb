"""Staged tables leave nothing behind but themselves."""

import glob
import time

from pyspark.sql import functions as F

from symweave.plans import staging


def shuffled(spark):
    return set(glob.glob(f"{spark.conf.get('spark.local.dir', '/tmp')}/blockmgr-*/*/shuffle_*"))


def test_shuffle_files_go_with_the_write(spark):
    before = shuffled(spark)
    df = spark.range(20_000).withColumn("key", F.xxhash64("id") % 7).repartition(4, "key")
    tables = [staging.staged(df, "held") for _ in range(3)]  # df is held, so no garbage collection takes its files
    end = time.time() + 10
    while (left := shuffled(spark) - before) and time.time() < end:
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(staging.CLEANUP) == "false"
    assert [t.count() for t in tables] == [20_000] * 3 and df.count() == 20_000
