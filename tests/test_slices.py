"""Slices of one hot key give the results of the whole key, in several tasks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sessionlore.operators import packets, slices

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "user_id long, received_at timestamp, arrival_no long, sequence int, outcome string, corrupt boolean"


@pytest.fixture(scope="module")
def rows(spark):
    rng, out, t = random.Random(11), [], 0
    for k in range(3000):
        t += rng.choice([20_000] * 20 + [1_499_999, 1_500_000, 30_000_000])
        out.append((rng.choice([1] * 9 + [2, None]), T0 + dt.timedelta(microseconds=t), k, (k * 3 + rng.randrange(3)) % 65536, rng.choice(["error"] * 4 + ["none"] * 3 + ["data"]), rng.random() < 0.1))
    return spark.createDataFrame(out, SCHEMA).cache()


def key(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("slice_us", [1_000_000, 60_000_000, 10**12])
def test_bursts(rows, slice_us):
    got = slices.with_bursts(rows, ["user_id"], slice_us=slice_us)
    assert key(got, "arrival_no", "burst") == key(packets.with_bursts(rows, ["user_id"]), "arrival_no", "burst")


@pytest.mark.parametrize("size", [1, 7, 500, 10**6])
def test_loss_and_quarantine(rows, size):
    by = slices.by_number("arrival_no", size)
    got = slices.loss_profile(rows, ["user_id"], by, limit=5, corrupt="corrupt")
    assert key(got, "user_id", "n_packets", "concealed", "corrupt", "frames") == key(packets.loss_profile(rows, ["user_id"], limit=5, corrupt="corrupt"), "user_id", "n_packets", "concealed", "corrupt", "frames")
    got = slices.quarantine(rows, ["user_id"], ["arrival_no"], by)
    assert key(got, "arrival_no", "failures", "action") == key(packets.quarantine(rows, ["user_id"], ["arrival_no"]), "arrival_no", "failures", "action")


def test_a_hot_key_is_in_several_tasks(spark, rows):
    hot = rows.withColumn("user_id", F.lit(1))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (slices.with_bursts(hot, ["user_id"], slice_us=10_000_000), slices.quarantine(hot, ["user_id"], ["arrival_no"], slices.by_number("arrival_no", 100))):
            tasks = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
            assert len(tasks) == 4 and max(r["count"] for r in tasks) < 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
