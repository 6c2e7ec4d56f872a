"""Move work out of overloaded weeks into weeks with room.

One excess hour costs far more than a move, so the aim is as few moves as
remove the excess. A unit is an instance, or the members of an adjustment
group that share a week. Overloaded weeks give up units largest first until
their excess is gone; laid end to end, these form one line of hours. The
free hours of the other weeks, laid end to end, form another. A unit moves
to the week whose stretch of free hours holds the unit's stretch whole.
Nothing is searched, no week receives more than its room, and each step is
an aggregation, a bucketed running sum or a bounded join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekwise.functions.columns import half_up, instance_key
from weekwise.functions.graph import connected_parts
from weekwise.functions.ordered import running_before, weighted_threshold
from weekwise.operators.schedule import fallback_schedule
from weekwise.params import Params
from weekwise.session import materialize

HOURS = "decimal(28,6)"
SUM = "decimal(38,6)"
CELLS = 1024


def group_parts(groups: DataFrame) -> DataFrame:
    """(relay_id, group_part): groups that share a relay are one part, named after its smallest group.

    A relay of two groups ties them together: if either moved alone, the
    other would lose its common week. Each relay links its groups to its
    smallest one, so links are as many as memberships.
    """
    members = groups.select("relay_id", "adjustment_group_id").dropna().distinct()
    least = members.groupBy("relay_id").agg(F.min("adjustment_group_id").alias("least"))
    parts = connected_parts(members.join(least, "relay_id"), "adjustment_group_id", "least")
    first = least.withColumnRenamed("least", "node")
    return first.join(parts, "node").select("relay_id", F.col("part").alias("group_part"))


def units_of(
    schedule: DataFrame, params: Params, respect_groups: bool, respect_hard: bool, parts: DataFrame | None = None
) -> DataFrame:
    """Instances with the key of the unit they move in: their group's, or with `parts` that of all tied groups."""
    alone = instance_key()
    group = F.col("adjustment_group_id")
    if parts is not None:
        schedule, group = schedule.join(parts, "relay_id", "left"), F.col("group_part")
    grouped = group.isNotNull() & (group != "NO_GROUP")
    with_group = F.concat_ws("_", group, F.date_format("suggested_wk_end_date", "yyyy-MM-dd"))
    pinned = F.coalesce("cannot_move", F.lit(False)) if respect_hard else F.lit(False)
    return schedule.withColumns(
        {
            "unit_key": F.when(grouped, with_group).otherwise(alone) if respect_groups else alone,
            "pinned": pinned | F.col("suggested_wk_end_date").isNull(),
            "is_nm": F.coalesce(F.col("store_type").isin(*params.nm_store_types), F.lit(False)),
        }
    ).drop("group_part")


def unit_table(rows: DataFrame) -> DataFrame:
    """One row per unit: week, hours, neighbourhood-market hours, size, and whether it may move."""
    hours = F.col("relay_hours").cast(HOURS)
    return (
        rows.filter(F.col("suggested_wk_end_date").isNotNull())
        .groupBy("unit_key")
        .agg(
            F.min("suggested_wk_end_date").alias("week"),
            F.sum(hours).cast(HOURS).alias("hours"),
            F.sum(F.when(F.col("is_nm"), hours).otherwise(F.lit(0).cast(HOURS))).cast(HOURS).alias("nm_hours"),
            F.count("*").alias("size"),
            (~F.max("pinned")).alias("movable"),
        )
    )


def row_load(rows: DataFrame) -> DataFrame:
    """Hours per week of the rows of units where they started.

    The rows of a unit share its week, so the units need not be built for it.
    """
    hours = F.col("relay_hours").cast(HOURS)
    return (
        rows.filter(F.col("suggested_wk_end_date").isNotNull())
        .groupBy(F.col("suggested_wk_end_date").alias("wk_end_date"))
        .agg(
            F.sum(hours).cast(SUM).alias("total"),
            F.sum(F.when(F.col("is_nm"), hours).otherwise(F.lit(0).cast(HOURS))).cast(SUM).alias("nm"),
        )
    )


def in_weeks(rows: DataFrame, weeks: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose week is, or with `left_anti` is not, among `weeks`: one row per week at most."""
    weeks = weeks.select(F.col("wk_end_date").alias("suggested_wk_end_date"))
    return rows.join(F.broadcast(weeks), "suggested_wk_end_date", how).select(rows.columns)


def week_state(load: DataFrame, moves: DataFrame | None, thresholds: DataFrame) -> DataFrame:
    """Excess and room per calendar week, after the moves so far.

    The load is corrected by what left and what came, so the units are not
    added up again. A week outside the calendar has no cap and neither.
    """
    if moves is not None:
        came = moves.groupBy(F.col("new_week").alias("wk_end_date")).agg(
            F.sum("hours").cast(SUM).alias("total"), F.sum("nm_hours").cast(SUM).alias("nm")
        )
        left = moves.groupBy(F.col("week").alias("wk_end_date")).agg(
            F.sum(-F.col("hours")).cast(SUM).alias("total"), F.sum(-F.col("nm_hours")).cast(SUM).alias("nm")
        )
        load = (
            load.unionByName(came)
            .unionByName(left)
            .groupBy("wk_end_date")
            .agg(F.sum("total").cast(SUM).alias("total"), F.sum("nm").cast(SUM).alias("nm"))
        )
    zero = F.lit(0).cast(SUM)

    def positive(diff: Column) -> Column:
        return F.greatest(zero, diff.cast(SUM))

    total, nm = F.coalesce("total", zero), F.coalesce("nm", zero)
    total_cap, nm_cap = F.col("total_cap").cast(SUM), F.col("nm_cap").cast(SUM)
    return thresholds.join(load, "wk_end_date", "left").select(
        "wk_end_date",
        positive(total - total_cap).alias("total_over"),
        positive(nm - nm_cap).alias("nm_over"),
        positive(total_cap - total).alias("total_slack"),
        positive(nm_cap - nm).alias("nm_slack"),
    )


def _phase(
    units: DataFrame, moves: DataFrame | None, state: DataFrame, params: Params, nm: bool, largest_first: bool
) -> tuple[DataFrame, DataFrame] | None:
    """Moves of one phase: unit, its hours, old and new week; None where there is no excess or no room.

    With them come the units, stored, that lie within the excess of their
    week. While excesses only shrink, later phases of this kind need no others:
    what moved away from before a unit has left the excess too.

    Free hours are laid out by week or, with `largest_first`, by size: a unit
    that straddles two weeks in one order may fit into one of them in the other.

    A unit that moved sits in a week within its caps, and no move takes a
    week beyond them, so it never moves again: `moves` are left out here.
    """
    measure, over_col, penalty = (
        ("nm_hours", "nm_over", params.nm_over_penalty) if nm else ("hours", "total_over", params.over_penalty)
    )
    slack = F.least("total_slack", "nm_slack") if nm else F.col("total_slack")
    excess, free = state.agg(F.sum(over_col), F.sum(slack)).first()
    if not excess or not free:
        return None
    penalty_c, cost_c = F.lit(str(penalty)).cast("decimal(10,4)"), F.lit(str(params.move_cost)).cast("decimal(10,4)")

    # Units that can pay for their move, in weeks with an excess.
    sources = state.filter(F.col(over_col) > 0).select(F.col("wk_end_date").alias("week"), F.col(over_col).alias("over"))
    may_go = units.filter(F.col("movable") & (F.col(measure) > 0) & (F.col(measure) * penalty_c > F.col("size") * cost_c))
    if not nm:
        # Work that counts against the market cap stays with its own phase.
        may_go = may_go.filter(F.col("nm_hours") == 0)
    may_go = may_go.join(sources, "week")
    if moves is not None:
        may_go = may_go.join(moves.select("unit_key"), "unit_key", "left_anti")

    totals = {"hours": "hours_before"} | ({"nm_hours": "nm_before"} if nm else {})
    before = "nm_before" if nm else "hours_before"
    ranked = running_before(
        may_go, "week", "hours", "unit_key", totals, params.prefix_hex_digits, stop=(before, "over")
    )
    left = F.col("over") - F.col(before)
    pays = F.least(F.col(measure), left) * penalty_c > F.col("size") * cost_c
    within = ranked.filter(left > 0).withColumn("pays", pays)
    within = materialize(within.select(*units.columns, "hours_before", "pays"), "within")
    leaving = within.filter("pays")

    # One row per week from here on, but for the units themselves.
    spans = leaving.groupBy("week").agg(F.max(F.col("hours_before") + F.col("hours")).alias("span"))
    earlier = Window.orderBy("week").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select("week", F.coalesce(F.sum("span").over(earlier), F.lit(0)).alias("offset"))
    room = state.select("wk_end_date", slack.alias("slack")).filter("slack > 0")
    layout = [F.desc("slack"), F.col("wk_end_date")] if largest_first else [F.col("wk_end_date")]
    upto = Window.orderBy(*layout).rowsBetween(Window.unboundedPreceding, 0)
    targets = room.withColumn("s1", F.sum("slack").over(upto)).select(
        F.col("wk_end_date").alias("new_week"), (F.col("s1") - F.col("slack")).alias("s0"), "s1"
    )

    # Both lines are cut into the same cells; a unit looks only at the target
    # weeks of the cell it starts in. Targets give at most one row per week
    # and CELLS more.
    cell_width = F.lit(max(1, math.ceil(free / CELLS)))
    cells = targets.withColumn(
        "cell",
        F.explode(
            F.sequence(F.floor(F.col("s0") / cell_width).cast("long"), F.floor(F.col("s1") / cell_width).cast("long"))
        ),
    )
    placed = (
        leaving.join(F.broadcast(offsets), "week")
        .withColumn("p0", F.col("offset") + F.col("hours_before"))
        .withColumn("cell", F.floor(F.col("p0") / cell_width).cast("long"))
    )
    fits = (F.col("s0") <= F.col("p0")) & (F.col("p0") + F.col("hours") <= F.col("s1"))
    found = placed.join(F.broadcast(cells), "cell").filter(fits)
    return found.select("unit_key", "week", "new_week", "hours", "nm_hours"), within.select(units.columns)


def rebalance(
    instances: DataFrame,
    thresholds: DataFrame,
    params: Params,
    passes: int = 3,
    respect_groups: bool = True,
    respect_hard: bool = True,
    open_from: Column | None = None,
    parts: DataFrame | None = None,
) -> DataFrame:
    """Suggested schedule: the instances with `suggested_wk_end_date`.

    A unit is an instance or, in one week, a group; with `parts` from
    `group_parts`, all groups tied by common relays, so that no group loses
    its common week. With `open_from`, weeks before that date are closed: they lose no work and
    get none, and their rows stay as they are.

    Each pass first relieves the neighbourhood-market cap, using weeks with
    room under both caps, then the total cap with the remaining units. Passes
    alternate between the two layouts of free hours and end early when
    neither moves anything. The units are computed once, those of the weeks
    that start with an excess: no move takes a week beyond its caps, so no
    other week ever loses work. From the second pass on only units within the
    excess of the first are looked at, unless hours are negative: then an
    excess may grow again. What each phase
    decides is a written table of its moves, so a lost executor costs one
    phase at most, and tables read back have a known size. Pass stored
    tables: both inputs are read often.
    """
    schedule = fallback_schedule(instances)
    rows = units_of(schedule, params, respect_groups, respect_hard, parts)
    if open_from is not None:
        # A row per week, read by every phase: the date, which may be a query over the work table, is found once.
        thresholds = materialize(thresholds.filter(F.col("wk_end_date") >= open_from), "open-weeks")
    load = materialize(row_load(in_weeks(units_of(schedule, params, respect_groups, respect_hard), thresholds)), "unit-load")
    start = materialize(week_state(load, None, thresholds), "weeks")
    units = materialize(unit_table(in_weeks(rows, start.filter("total_over > 0 OR nm_over > 0"))), "units")
    shrinking = units.filter("movable AND (hours < 0 OR nm_hours < 0 OR nm_hours > hours)").isEmpty()
    pools = {True: units, False: units}
    moves, idle = None, 0
    for i in range(passes):
        changed = False
        for nm in (True, False):
            state = start if moves is None else materialize(week_state(load, moves, thresholds), "weeks")
            found = _phase(pools[nm], moves, state, params, nm, largest_first=i % 2 == 1)
            if found is None:
                continue
            found, within = found
            if shrinking:
                pools[nm] = within
            found = materialize(found, "moves")
            if not found.isEmpty():
                moves = found if moves is None else moves.unionByName(found)
                changed = True
        idle = 0 if changed else idle + 1
        if idle == 2:  # neither layout moves anything
            break
    if moves is None:
        return schedule
    # Only weeks that lose work meet the moves; the others, most of a long history, pass as they are.
    losing = materialize(moves.select(F.col("week").alias("wk_end_date")).distinct(), "losing-weeks")
    moved = (
        in_weeks(rows, losing)
        .join(moves.select("unit_key", "new_week"), "unit_key", "left")
        .withColumn("suggested_wk_end_date", F.coalesce("new_week", "suggested_wk_end_date"))
    )
    return in_weeks(schedule, losing, "left_anti").unionByName(moved.select(schedule.columns))


def objective_bound(
    instances: DataFrame,
    thresholds: DataFrame,
    params: Params,
    respect_groups: bool = True,
    respect_hard: bool = True,
    open_from: Column | None = None,
    parts: DataFrame | None = None,
) -> DataFrame:
    """One row, `bound`: no schedule that moves units whole costs less.

    Each week sells its hours at a price between 0 and the penalty. Whatever
    the prices, a schedule costs at least what its units pay if each takes
    the cheaper of staying and moving at the move cost, less the price of the
    caps. A week's best price is where its leaving units first make up its excess,
    taken in the order of their cost per hour; `weighted_threshold` finds it in
    rounds of one aggregation. Market hours are priced first, then all hours
    beside them. If the caps of all weeks together are short of hours, the
    shortage is paid in full instead; the best of those readings is the bound.
    """
    rows = units_of(fallback_schedule(instances), params, respect_groups, respect_hard, parts)
    load = materialize(row_load(rows), "unit-load")
    over, market = F.lit(params.over_penalty), F.lit(params.nm_over_penalty)
    cost = F.col("size") * F.lit(params.move_cost)
    every = week_state(load, None, thresholds)
    open_weeks = thresholds if open_from is None else thresholds.filter(F.col("wk_end_date") >= open_from)
    closed = every.join(open_weeks.select("wk_end_date"), "wk_end_date", "left_anti")
    closed = closed.agg(F.coalesce(F.sum(F.col("total_over") * over + F.col("nm_over") * market), F.lit(0.0)).alias("closed"))
    state = week_state(load, None, open_weeks).withColumnRenamed("wk_end_date", "week")
    state = materialize(state, "weeks")
    units = materialize(unit_table(in_weeks(rows, open_weeks)), "units")
    may_go = units.filter("movable")

    def priced(excess: str, rows: DataFrame, weight: str, most: Column) -> DataFrame:
        """Price per week with an excess: where enough has left, or the penalty."""
        weeks = state.filter(F.col(excess) > 0)
        found = weighted_threshold(rows.join(F.broadcast(weeks.select("week")), "week", "left_semi"), weeks, "week", "ratio", weight, excess)
        return found.select("week", F.least(F.coalesce("threshold", most), most).alias("price"))

    of_market = may_go.filter("nm_hours > 0").withColumn("ratio", cost / F.col("nm_hours").cast("double"))
    market_price = priced("nm_over", of_market, "nm_hours", market).withColumnRenamed("price", "b")
    with_b = units.join(F.broadcast(market_price), "week", "left").withColumn("b", F.coalesce("b", F.lit(0.0)))
    left = F.greatest(F.lit(0.0), cost - F.col("b") * F.col("nm_hours").cast("double"))
    of_all = with_b.filter("movable AND hours > 0").withColumn("ratio", left / F.col("hours").cast("double"))
    price = priced("total_over", of_all, "hours", over).withColumnRenamed("price", "a")
    priced_units = with_b.join(F.broadcast(price), "week", "left").withColumn("a", F.coalesce("a", F.lit(0.0)))

    hours, nm_hours = F.col("hours").cast("double"), F.col("nm_hours").cast("double")
    readings = {"ab": (F.col("a"), F.col("b")), "a": (F.col("a"), F.lit(0.0)), "b": (F.lit(0.0), F.col("b"))}

    def paid(a: Column, b: Column) -> Column:
        stay = a * hours + b * nm_hours
        return F.coalesce(F.sum(F.when(F.col("movable"), F.least(stay, cost)).otherwise(stay)), F.lit(0.0))

    pays = priced_units.agg(
        *[paid(*ab).alias(f"pays_{name}") for name, ab in readings.items()],
        F.coalesce(F.sum("hours").cast("double"), F.lit(0.0)).alias("hours"),
        F.coalesce(F.sum("nm_hours").cast("double"), F.lit(0.0)).alias("nm_hours"),
    )
    caps = open_weeks.withColumnRenamed("wk_end_date", "week").join(price, "week", "left").join(market_price, "week", "left")
    a_cap = F.coalesce("a", F.lit(0.0)) * F.col("total_cap")
    b_cap = F.coalesce("b", F.lit(0.0)) * F.col("nm_cap")
    caps = caps.agg(
        *[F.coalesce(F.sum(e), F.lit(0.0)).alias(n) for n, e in {"a_cap": a_cap, "b_cap": b_cap, "cap": F.col("total_cap"), "nm": F.col("nm_cap")}.items()]
    )
    # One row each, put side by side by a sum.
    sums = pays.unionByName(caps, allowMissingColumns=True).unionByName(closed, allowMissingColumns=True)
    sums = sums.agg(*[F.sum(c).alias(c) for c in sums.columns])
    short = over * (F.col("hours") - F.col("cap"))
    nm_short = market * (F.col("nm_hours") - F.col("nm"))
    best = F.greatest(
        F.col("pays_ab") - F.col("a_cap") - F.col("b_cap"),
        F.col("pays_a") - F.col("a_cap") + nm_short,
        F.col("pays_b") - F.col("b_cap") + short,
        short + nm_short,
    )
    return sums.select(half_up(best + F.col("closed"), 2).alias("bound"))


def optimality_gap(cost: DataFrame, bound: DataFrame) -> DataFrame:
    """Objective, bound, and what lies between them, also as a share of the objective."""
    objective = F.col("objective")
    return cost.withColumn("bound", bound.select("bound").scalar()).select(
        "objective",
        "bound",
        half_up(objective - F.col("bound"), 2).alias("gap"),
        F.when(objective == 0, F.lit(0.0)).otherwise(half_up((objective - F.col("bound")) * 100 / objective, 4)).alias("gap_pct"),
    )


def move_candidates(instances: DataFrame, thresholds: DataFrame, params: Params) -> DataFrame:
    """What a movable instance of an overloaded week could do: stay for 0, or move at the move cost.

    Listing every (instance, week) pair would multiply the instances by the
    weeks. Each instance gets the number of weeks that could take it whole
    and the first and last of them. The free hours of the weeks are sorted
    once, with the first and last week so far; hours that occur are looked
    up there once each, however many instances have them.
    """
    rows = units_of(fallback_schedule(instances), params, respect_groups=False, respect_hard=True)
    state = materialize(week_state(row_load(rows), None, thresholds), "weeks")
    sources = state.filter(F.col("total_over") > 0).select(F.col("wk_end_date").alias("suggested_wk_end_date"))
    upto = Window.orderBy(F.desc("total_slack"), "wk_end_date").rowsBetween(Window.unboundedPreceding, 0)
    levels = state.filter(F.col("total_slack") > 0).select(
        "total_slack", F.min("wk_end_date").over(upto).alias("first_week"), F.max("wk_end_date").over(upto).alias("last_week")
    )
    # One row with a level per week: the weeks bound it.
    ladder = levels.agg(F.array_sort(F.collect_list(F.struct((-F.col("total_slack")).alias("below"), "first_week", "last_week"))))
    rows = (
        rows.filter(~F.col("pinned"))
        .join(F.broadcast(sources), "suggested_wk_end_date", "left_semi")
        .withColumn("need", F.col("relay_hours").cast(HOURS))
    )
    found = rows.select("need").distinct().withColumn("ladder", ladder.scalar())
    found = found.withColumn("n", F.size(F.filter("ladder", lambda x: -x["below"] >= F.col("need"))))
    reached = F.try_element_at("ladder", F.col("n"))
    found = found.select(
        "need",
        F.col("n").cast("long").alias("candidate_weeks"),
        F.when(F.col("n") > 0, reached["first_week"]).alias("first_week"),
        F.when(F.col("n") > 0, reached["last_week"]).alias("last_week"),
    )
    return rows.join(found, rows["need"].eqNullSafe(found["need"]), "left").select(
        "relay_id",
        "store_id",
        "original_wk_end_date",
        F.coalesce("candidate_weeks", F.lit(0)).alias("candidate_weeks"),
        "first_week",
        "last_week",
        F.lit(0.0).alias("stay_cost"),
        F.lit(params.move_cost).alias("move_cost"),
    )
