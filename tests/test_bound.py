"""The lower bound on the plan against all schedules of small cases, and tied groups."""

import itertools
import random

import pytest
from frames import W1, W2, W3
from pyspark.sql import functions as F
from test_rebalance import P, limits, sched, weeks_of

from weekwise.functions.graph import connected_parts
from weekwise.functions.ordered import exact_percentiles, weighted_threshold
from weekwise.operators import rebalance, schedule

WEEKS = (W1, W2, W3)


def cheapest(rows, caps, nms, params=P):
    """Least objective over all schedules; rows are (relay, week, hours[, type[, pinned]])."""
    best = None
    free = [WEEKS if len(r) < 5 or not r[4] else (r[1],) for r in rows]
    for weeks in itertools.product(*free):
        cost = params.move_cost * sum(w != r[1] for w, r in zip(weeks, rows))
        for w in WEEKS:
            here = [r for r, at in zip(rows, weeks) if at == w]
            cost += params.over_penalty * max(0, sum(r[2] for r in here) - caps[w])
            market = sum(r[2] for r in here if len(r) > 3 and r[3] == "Neighborhood")
            cost += params.nm_over_penalty * max(0, market - nms[w])
        best = cost if best is None else min(best, cost)
    return best


def bound_of(spark, rows, caps, nms):
    return rebalance.objective_bound(sched(spark, *rows), limits(spark, caps, nms, weeks=WEEKS), P).first().bound


@pytest.mark.parametrize("seed", [0, 4, 5])
def test_bound_is_below_every_schedule(spark, seed):
    r = random.Random(seed)
    kinds = ["Large", "Neighborhood"]
    rows = [(f"r{i}", r.choice(WEEKS), r.randint(1, 9), r.choice(kinds), r.random() < 0.2) for i in range(5)]
    caps, nms = ({w: r.randint(0, 15) for w in WEEKS} for _ in range(2))
    found, best = bound_of(spark, rows, caps, nms), cheapest(rows, caps, nms)
    assert found <= best + 0.005, (rows, caps, nms)


def test_bound_is_reached_by_equal_units(spark):
    rows = [(f"r{i}", W1, 2) for i in range(5)]
    caps, nms = {W1: 4, W2: 4, W3: 4}, dict.fromkeys(WEEKS, 99)
    assert bound_of(spark, rows, caps, nms) == pytest.approx(cheapest(rows, caps, nms)) == 0.3


def test_bound_counts_a_shortage_of_all_caps(spark):
    rows = [("a", W1, 6), ("b", W2, 6), ("c", W3, 6)]
    caps, nms = dict.fromkeys(WEEKS, 2), dict.fromkeys(WEEKS, 99)
    assert bound_of(spark, rows, caps, nms) == cheapest(rows, caps, nms) == 120


def test_bound_of_an_empty_schedule(spark):
    empty = sched(spark, ("a", W1, 1)).limit(0)
    assert rebalance.objective_bound(empty, limits(spark, 5, weeks=WEEKS), P).first().bound == 0
    pinned = [("a", W1, 7, "Large", True)]
    assert bound_of(spark, pinned, dict.fromkeys(WEEKS, 5), dict.fromkeys(WEEKS, 99)) == 20


# -- tied groups ----------------------------------------------------------------


def groups(spark, *pairs):
    return spark.createDataFrame(pairs, "adjustment_group_id string, relay_id string")


def test_groups_with_a_common_relay_are_one_part(spark):
    parts = rebalance.group_parts(groups(spark, ("G", "a"), ("G", "b"), ("H", "b"), ("H", "c"), ("K", "d"), (None, "e")))
    assert {r.relay_id: r.group_part for r in parts.collect()} == {"a": "G", "b": "G", "c": "G", "d": "K"}


def test_plan_keeps_tied_groups_together(spark):
    """b is in two groups: with its first group alone, the plan would leave c behind."""
    member = groups(spark, ("G", "a"), ("G", "b"), ("H", "b"), ("H", "c"))
    rows = sched(spark, ("a", W1, 3, "Large", False, "G"), ("b", W1, 3, "Large", False, "G"), ("c", W1, 3, "Large", False, "H"), ("d", W1, 2))
    caps = limits(spark, {W1: 5, W2: 9, W3: 0}, weeks=WEEKS)
    alone = rebalance.rebalance(rows, caps, P)
    assert schedule.split_groups(alone, member).count() == 1
    tied = rebalance.rebalance(rows, caps, P, parts=rebalance.group_parts(member))
    assert {weeks_of(tied)[x] for x in "abc"} == {W2}
    got = {r.plan: r for r in schedule.group_sync_changes({"alone": alone, "tied": tied}, member).collect()}
    assert (got["tied"].before, got["tied"].after, got["tied"].split_weeks) == (0, 0, 0)
    assert got["alone"].after > 0 and got["alone"].split_weeks == 1


@pytest.mark.parametrize("seed", range(3))
def test_connected_parts(spark, seed):
    r = random.Random(seed)
    n = 120
    links = [(r.randrange(n), r.randrange(n)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(7, 7), (None, 3)]
    r.shuffle(links)
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = connected_parts(spark.createDataFrame(links, "a long, b long"))
    want = {x: root(x) for x in list(up)}  # a link without an end is none
    assert {x.node: x.part for x in got.collect()} == want


def test_connected_parts_of_nothing(spark):
    assert connected_parts(spark.createDataFrame([], "a long, b long")).count() == 0


# -- thresholds and percentiles ------------------------------------------------------


@pytest.mark.parametrize("fanout", [2, 256])
def test_weighted_threshold(spark, fanout):
    r = random.Random(fanout)
    rows = [(g, r.choice([0.1, 0.25, 0.25001, 3.0, 1e6]) * r.choice([1, 1, 2]), r.randint(1, 5)) for g in "abc" for _ in range(60)]
    wanted = {"a": 40, "b": 1, "c": 10_000}
    got = weighted_threshold(
        spark.createDataFrame(rows, "g string, v double, w int").selectExpr("g", "v", "CAST(w AS decimal(10,2)) AS w"),
        spark.createDataFrame(list(wanted.items()), "g string, wanted int").selectExpr("g", "CAST(wanted AS decimal(10,2)) AS wanted"),
        "g", "v", "w", "wanted", fanout,
    )

    def plain(g):
        total = 0
        for v, w in sorted((v, w) for k, v, w in rows if k == g):
            total += w
            if total >= wanted[g]:
                return v
        return None

    assert {x.g: x.threshold for x in got.collect()} == {g: plain(g) for g in wanted}


def test_percentile_outside_the_bracket_is_counted_in_full(spark):
    """A sketch as coarse as two entries leaves the rank out of its bracket; the value stays exact."""
    rows = [(float(i),) for i in range(2000)]
    df = spark.createDataFrame(rows, "v double").withColumn("none", F.lit(None).cast("double"))
    assert exact_percentiles(df, ["v", "none"], 0.37, accuracy=2) == [pytest.approx(0.37 * 1999), None]
