"""Reach of relays: one shuffle, repeated and missing stores counted right."""

import datetime as dt

from weekwise.streaming import live

W1, W2 = dt.date(2024, 1, 7), dt.date(2024, 1, 14)


def test_reach_takes_one_shuffle(spark):
    rows = [("a", W1, 1), ("a", W2, 1), ("a", W2, 2), ("a", W2, 2), ("b", W1, None), ("c", None, 3), (None, W1, 4)]
    bridge = spark.createDataFrame(rows, "relay_id string, wk_end_date date, store_id long")
    reach = live.relay_reach(bridge)
    assert reach.schema["n_stores"].dataType.simpleString() == "bigint"
    got = {r.relay_id: (r.n_stores, sorted(r.weeks)) for r in reach.collect()}
    assert got == {"a": (2, [W1, W2]), "b": (0, [W1]), "c": (1, []), None: (1, [W1])}
    assert reach._jdf.queryExecution().sparkPlan().toString().count("Aggregate") == 2  # partial and final
