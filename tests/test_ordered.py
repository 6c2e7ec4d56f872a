"""Running sums and percentiles that no task holds whole, against brute force."""

import random
from collections import defaultdict
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekwise.functions.ordered import exact_percentile, running_before


def brute(data, digits):
    groups, out = defaultdict(list), {}
    for g, size, key in data:
        whole, digest = int(size), md5(key.encode()).hexdigest()
        band = whole if whole <= 1023 else 1013 + whole.bit_length()
        groups[g].append((-band, digest[:digits], -size, digest, key, size))
    for items in groups.values():
        before = 0.0
        for *_, key, size in sorted(items):
            out[key] = before
            before += size
    return out


@pytest.mark.parametrize("digits", [1, 2])
def test_running_sum_equals_brute_force_on_a_hot_group(spark, digits):
    rng = random.Random(3)
    data = [("hot" if i % 3 else f"g{i % 5}", float(rng.choice([1, 2, 2, 2, 50, 3000])), f"k{i}") for i in range(900)]
    df = spark.createDataFrame(data, "g string, size double, key string")
    got = {r.key: r.before for r in running_before(df, "g", "size", "key", {"size": "before"}, digits).collect()}
    assert got == brute(data, digits)


def test_stop_keeps_every_row_below_the_bound(spark):
    data = [("hot", float(i % 7 + 1), f"k{i}") for i in range(600)]
    df = spark.createDataFrame(data, "g string, size double, key string").withColumn("bound", F.lit(400.0))
    got = running_before(df, "g", "size", "key", {"size": "before"}, 1, stop=("before", "bound"))
    expect = {k: v for k, v in brute(data, 1).items() if v < 400}
    assert {r.key: r.before for r in got.filter("before < bound").collect()} == expect
    assert got.count() < len(data)


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("fanout", [2, 4096])
def test_percentile_equals_numpy(spark, share, fanout):
    rng = random.Random(5)
    values = [round(rng.uniform(-50, 5000), 2) for _ in range(150)] + [12.34] * 75 + [1e7]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert exact_percentile(df, "v", share, fanout=fanout) == pytest.approx(float(np.quantile(values, share)), abs=1e-6)


def test_percentile_of_four(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "v double")
    assert exact_percentile(df, "v", 0.8) == 5.6


def test_percentile_of_nothing(spark):
    assert exact_percentile(spark.createDataFrame([], "v double"), "v", 0.5) is None
