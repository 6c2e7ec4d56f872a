"""Plan shapes that matter at scale."""

import re

from weekwise.operators import master, rebalance
from weekwise.params import Params
from weekwise.plans import registry
from weekwise.plans.registry import QUERIES
from weekwise.session import FREED, TABLES, configure, materialize
from weekwise.sources import io


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_the_columns_used(spark, sf_dir):
    text = plan(QUERIES["request_frequency"](spark, sf_dir))
    customer = re.search(r"FileScan parquet \[([^\]]*)\][^\n]*customer", text).group(1)
    assert re.sub(r"#\d+L?", "", customer) == "c_custkey,c_mktsegment"


def test_filter_reaches_the_scan(spark, tmp_path):
    path = io.save_table(spark.range(10).selectExpr("id", "id % 3 AS relay_year"), str(tmp_path / "t"), ["relay_year"])
    text = plan(io.load_table(spark, path).filter("id > 4 AND relay_year = 1"))
    assert "GreaterThan(id,4)" in text and re.search(r"PartitionFilters: \[[^\]]*relay_year[^\]]*= 1", text)


def test_calendar_side_is_broadcast_by_size(spark, sf_dir):
    text = plan(QUERIES["holiday_flags"](spark, sf_dir))
    assert re.search(r"BroadcastHashJoin \[wk_end_date[^\n]*LeftOuter, BuildRight", text)


def test_relays_are_shuffled_once_for_the_store_join(spark, sf_dir):
    text = plan(QUERIES["relay_store_join"](spark, sf_dir))
    left = text.split("SortMergeJoin")[1].split("\n      +- ")[0]
    assert left.count("Exchange hashpartitioning") == 1


def test_deduplication_is_limited_before_the_shuffle(spark, sf_dir):
    text = plan(QUERIES["dedupe_instances"](spark, sf_dir))
    assert "WindowGroupLimit" in text


def test_top_k_takes_per_partition(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(QUERIES["top_risk"](spark, sf_dir))


def stored(spark, sf_dir, monkeypatch, name):
    """Labels of the tables that building a query stores."""
    labels = []

    def note(df, label):
        labels.append(label)
        return materialize(df, label)

    for module in (registry, rebalance):
        monkeypatch.setattr(module, "materialize", note)
    QUERIES[name](spark, sf_dir)
    return labels


def test_two_plans_share_their_instances(spark, sf_dir, monkeypatch):
    labels = stored(spark, sf_dir, monkeypatch, "group_sync_after_plan")
    assert labels.count("instances") == labels.count("thresholds") == 1


def test_stages_of_a_repeated_run_do_no_work(spark, sf_dir, monkeypatch):
    labels = stored(spark, sf_dir, monkeypatch, "resumed_stages")
    assert "instances" not in labels and labels.count("units") == 2


def test_dashboard_joins_the_scored_rows_once(spark, sf_dir, monkeypatch):
    assert stored(spark, sf_dir, monkeypatch, "dashboard_document").count("scored") == 1


def test_dashboard_joins_relays_and_stores_once(spark, sf_dir, monkeypatch):
    """The instances behind its savings come from the stored scored rows."""
    joins, join = [], master.relay_store_join

    def note(*args):
        joins.append(args)
        return join(*args)

    monkeypatch.setattr(master, "relay_store_join", note)
    assert stored(spark, sf_dir, monkeypatch, "dashboard_document").count("top-cost") == 1 and len(joins) == 1


def test_splits_of_the_planning_queries_are_bounded(spark, tmp_path):
    """What a task of a table query reads does not follow the table; corpus queries keep Spark's splits."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert configure(spark, TABLES).conf.get("spark.sql.files.maxPartitionBytes") == "8m"
    assert configure(spark).conf.get("spark.sql.files.maxPartitionBytes") == before or before == "8m"


def test_relays_without_a_group_are_left_out_before_the_count(spark, sf_dir):
    text = plan(QUERIES["group_sync_violations"](spark, sf_dir))
    assert "LeftSemi" in text


def test_objectives_of_both_schedules_come_from_week_pairs(spark, sf_dir, monkeypatch):
    """The suggested rows are read once and not written."""
    for name in ("schedule_objective", "cost_waterfall"):
        labels = stored(spark, sf_dir, monkeypatch, name)
        assert "suggested" not in labels and labels.count("week-pairs") == 1


def test_first_open_week_is_found_once(spark, sf_dir, monkeypatch):
    """Phases read a stored row per open week and not the work table for its last date."""
    read = []
    phase = rebalance._phase

    def note(units, moves, state, *args, **kwargs):
        read.append(state)
        return phase(units, moves, state, *args, **kwargs)

    monkeypatch.setattr(rebalance, "_phase", note)
    assert stored(spark, sf_dir, monkeypatch, "moved_relays").count("open-weeks") == 1 and read


def test_checks_store_only_the_columns_they_read(spark, sf_dir, monkeypatch):
    kept = {}

    def note(df, label):
        kept[label] = df.columns
        return materialize(df, label)

    monkeypatch.setattr(registry, "materialize", note)
    QUERIES["compliance_summary"](spark, sf_dir)
    assert not {"requested_move_wk", "status", "adjustment_group_id"} & set(kept["suggested"])


def test_relay_weeks_without_a_move_are_left_out_before_they_are_grouped(spark, sf_dir):
    text = plan(QUERIES["moves_by_dept"](spark, sf_dir))
    semi = text[text.index("LeftSemi") :]
    assert "HashAggregate" in text[: text.index("LeftSemi")] and "lineitem" in semi and "HashAggregate" not in semi.split("lineitem")[0]


def test_key_suffix_shuffles_its_rows_once_and_bare(spark):
    """One exchange for keys that fit a task; md5 and row text are made after it."""
    df = spark.createDataFrame([(str(i), f"G{i}") for i in range(20)], "instance_key string, adjustment_group_id string")
    above, below = plan(master.key_suffix(df, Params())).split("Exchange hashpartitioning")
    assert "md5" in above and "md5" not in below and "Exchange" not in below


def test_staged_queries_give_back_shuffle_files(spark, sf_dir):
    """Only they do, and their result can still be read twice."""
    (name,) = FREED
    kept = QUERIES["key_suffix"](spark, sf_dir)
    assert spark.conf.get(name) == "true"
    assert sorted(kept.collect()) == sorted(kept.collect())
    QUERIES["request_frequency"](spark, sf_dir)
    assert spark.conf.get(name, "false") == "false"
