"""What every rebalanced schedule keeps, and the edges of the matching."""

import datetime as dt

import pytest
from frames import W1, W2, W3, W4
from pyspark.sql import functions as F

from weekwise.operators import master, rebalance, schedule
from weekwise.params import Params
from weekwise.session import materialize
from weekwise.sources import adapters

P = Params()
SCHEMA = (
    "relay_id string, store_id long, original_wk_end_date date, relay_hours double, store_type string, "
    "cannot_move boolean, adjustment_group_id string"
)


def sched(spark, *rows):
    """Rows (relay, week, hours[, type[, pinned[, group]]])."""
    full = [(r[0], 1, r[1], float(r[2]), *(list(r[3:]) + ["Large", False, "NO_GROUP"][len(r) - 3 :])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def limits(spark, total, nm=1e9, weeks=(W1, W2, W3, W4)):
    caps = total if isinstance(total, dict) else dict.fromkeys(weeks, total)
    nms = nm if isinstance(nm, dict) else dict.fromkeys(weeks, nm)
    return spark.createDataFrame(
        [(w, False, float(caps[w]), float(nms[w])) for w in weeks],
        "wk_end_date date, is_holiday boolean, total_cap double, nm_cap double",
    )


def weeks_of(df):
    return {r.relay_id: r.suggested_wk_end_date for r in df.collect()}


def test_week_exactly_at_cap_gives_nothing_up(spark):
    out = rebalance.rebalance(sched(spark, ("a", W1, 6), ("b", W1, 4)), limits(spark, 10), P)
    assert set(weeks_of(out).values()) == {W1}


def test_unit_that_fills_the_room_exactly_moves(spark):
    out = rebalance.rebalance(sched(spark, ("a", W1, 6), ("b", W1, 4)), limits(spark, {W1: 4, W2: 6, W3: 0, W4: 0}), P)
    assert weeks_of(out) == {"a": W2, "b": W1}


def test_unit_larger_than_any_room_stays(spark):
    out = rebalance.rebalance(sched(spark, ("a", W1, 6)), limits(spark, 5), P)
    assert weeks_of(out) == {"a": W1}


def test_pinned_unit_stays_unless_the_rule_is_off(spark):
    rows = sched(spark, ("a", W1, 6, "Large", True), ("b", W1, 1))
    caps = limits(spark, {W1: 1, W2: 6, W3: 6, W4: 6})
    assert weeks_of(rebalance.rebalance(rows, caps, P))["a"] == W1
    assert weeks_of(rebalance.rebalance(rows, caps, P, respect_hard=False))["a"] != W1


def test_group_members_in_a_week_move_together(spark):
    rows = sched(spark, ("a", W1, 3, "Large", False, "G"), ("b", W1, 3, "Large", False, "G"), ("c", W3, 3, "Large", False, "G"))
    out = weeks_of(rebalance.rebalance(rows, limits(spark, {W1: 1, W2: 8, W3: 3, W4: 8}), P))
    assert out["a"] == out["b"] != W1 and out["c"] == W3


def test_pinned_member_pins_its_group(spark):
    rows = sched(spark, ("a", W1, 3, "Large", True, "G"), ("b", W1, 3, "Large", False, "G"))
    caps = limits(spark, {W1: 1, W2: 8, W3: 8, W4: 8})
    assert set(weeks_of(rebalance.rebalance(rows, caps, P)).values()) == {W1}
    assert weeks_of(rebalance.rebalance(rows, caps, P, respect_groups=False))["b"] != W1


def test_market_work_moves_only_where_both_caps_have_room(spark):
    rows = sched(spark, ("a", W1, 5, "Neighborhood"), ("b", W1, 5, "Neighborhood"))
    out = weeks_of(rebalance.rebalance(rows, limits(spark, 100, {W1: 5, W2: 4, W3: 5, W4: 0}), P))
    assert sorted(out.values()) == [W1, W3]


def test_move_that_costs_more_than_it_saves_is_not_made(spark):
    dear = Params(move_cost=1000.0)
    out = rebalance.rebalance(sched(spark, ("a", W1, 6)), limits(spark, {W1: 5, W2: 9, W3: 9, W4: 9}), dear)
    assert weeks_of(out) == {"a": W1}


def test_missing_week_is_left_alone(spark):
    out = rebalance.rebalance(sched(spark, ("a", None, 6), ("b", W1, 9)), limits(spark, {W1: 1, W2: 9, W3: 0, W4: 0}), P)
    assert weeks_of(out) == {"a": None, "b": W2}
    assert schedule.moved(out).count() == 1


def test_nothing_to_do(spark):
    rows = sched(spark, ("a", W1, 1))
    assert rebalance.rebalance(rows.limit(0), limits(spark, 10), P).count() == 0
    assert weeks_of(rebalance.rebalance(rows, limits(spark, 10), P)) == {"a": W1}


def invariants(rows, caps, out):
    """Row count, hours, pins, weeks and the objective."""
    before = schedule.weekly_overage(schedule.weekly_load(rows, P), caps)
    after = schedule.weekly_overage(schedule.weekly_load(out, P, "suggested_wk_end_date"), caps)
    assert rows.count() == out.count()
    total = [df.agg(F.sum(F.col("relay_hours").cast("decimal(18,2)"))).first()[0] for df in (rows, out)]
    assert total[0] == total[1]
    assert out.filter("cannot_move AND suggested_wk_end_date <> original_wk_end_date").isEmpty()
    assert schedule.assignment_violations(out).isEmpty()
    for col in ("total_over", "nm_over"):
        worse = before.select("wk_end_date", F.col(col).alias("b")).join(
            after.select("wk_end_date", F.col(col).alias("a")), "wk_end_date"
        )
        assert worse.filter("a > b").isEmpty()
    cost = [
        schedule.schedule_objective(s, caps, P, "x").first().objective for s in (schedule.fallback_schedule(rows), out)
    ]
    assert cost[1] <= cost[0]
    return cost


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_invariants_on_the_adapter_tables(spark, scale):
    t = adapters.load_tables(spark, f"/root/testdata/{scale}")
    rows = materialize(
        master.instances(t, P, unique_keys=True).select(*schedule.REQUIRED, *schedule.OPTIONAL), "test-instances"
    )
    caps = materialize(
        schedule.thresholds_for(t, P, schedule.caps_from_load(schedule.weekly_load(rows, P))), "test-caps"
    )
    out = materialize(rebalance.rebalance(rows, caps, P), "test-out")
    again = rebalance.rebalance(rows, caps, P)
    before, after = invariants(rows, caps, out)
    assert after < before / 2
    assert out.exceptAll(again.select(out.columns)).isEmpty()


def test_one_week_with_a_third_of_all_rows(spark):
    """A hot week and one hot hour value, spread over hash buckets."""
    weeks = [W1 + dt.timedelta(days=7 * i) for i in range(20)]
    data = [(f"h{i}", W1, 5) for i in range(3000)] + [(f"r{i}", weeks[1 + i % 19], 1 + i % 9) for i in range(6000)]
    rows = materialize(sched(spark, *data), "hot")
    caps = limits(spark, 2600, weeks=weeks)
    out = materialize(rebalance.rebalance(rows, caps, P), "hot-out")
    before, after = invariants(rows, caps, out)
    assert before > 100_000 and after < before / 5


def test_only_weeks_with_an_excess_are_cut_into_units(spark, monkeypatch):
    """Weeks that can lose nothing, closed ones among them, are neither grouped nor joined with the moves."""
    kept = {}

    def stored(df, label):
        kept.setdefault(label, materialize(df, label))
        return kept[label] if label == "units" else materialize(df, label)

    monkeypatch.setattr(rebalance, "materialize", stored)
    rows = sched(spark, ("a", W1, 9), ("b", W2, 9), ("c", W2, 2, "Large", False, "G"), ("d", W3, 1), ("e", None, 1))
    caps = limits(spark, {W1: 1, W2: 5, W3: 4, W4: 9})
    out = rebalance.rebalance(rows, caps, P, open_from=F.lit(W2))
    assert {r.week for r in kept["units"].collect()} == {W2} and kept["units"].count() == 2
    assert weeks_of(out) == {"a": W1, "b": W4, "c": W2, "d": W3, "e": None}
    assert out.columns == [*rows.columns, "suggested_wk_end_date"]


@pytest.mark.parametrize(("more", "looked_at"), [([], [21, 1]), ([("neg", W1, -1)], [22, 22])])
def test_later_passes_look_only_at_units_within_the_excess(spark, monkeypatch, more, looked_at):
    """Unless hours are negative: an excess may then grow again."""
    seen, phase = [], rebalance._phase

    def spy(units, moves, state, params, nm, largest_first):
        if not nm:
            seen.append(units.count())
        return phase(units, moves, state, params, nm, largest_first)

    monkeypatch.setattr(rebalance, "_phase", spy)
    rows = sched(spark, ("big", W1, 9), *[(f"r{i}", W1, 4) for i in range(20)], *more)
    out = rebalance.rebalance(rows, limits(spark, {W1: 80, W2: 5, W3: 4, W4: 0}), P)
    assert set(weeks_of(out).values()) == {W1}
    assert seen == looked_at
