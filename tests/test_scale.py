"""Work that must not grow with more than its input: sizes of plans, scans and tasks, next to the results."""
from __future__ import annotations

import random

from pyspark.sql import functions as F

from alertloom.functions import text
from alertloom.operators import cases, commands, prompts, scans
from alertloom.plans import catalog, q_prompts  # noqa: F401  (registers the queries)
from alertloom.plans.registry import QUERIES
from alertloom.plans.tables import Tables


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pieces_of_a_text_add_up(spark):
    rnd = random.Random(3)
    parts = ["ab", "Z", "  ", "\t", "12", "!?", "漢", "か", "Ａ", "é", "\x07", "😀", " x "]
    rows = [(i, *("".join(rnd.choice(parts) for _ in range(rnd.randrange(6))) for _ in range(2))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    milli = text.milli_tokens
    whole = milli(F.concat("a", F.lit("\n"), "b"))
    assert df.where(whole != milli(F.col("a")) + milli(F.col("b")) + text.TOKEN_WEIGHTS["space"]).count() == 0


def test_a_card_is_estimated_once(spark):
    rows = [(1, "h", "t", "2024-01-01", "slow 99% " * 60, "cause", "look " * 90, "restart 123, " * 40, 60), (2, "h", "t", "2024-01-01", "s", "c", "", "", None)]
    df = cases.fit_card(spark.createDataFrame(rows, "id long, host string, type string, occurred_on string, symptoms string, cause string, confirmation string, "
                                                    "action string, time_to_recover_sec long"), 100)
    got = {r.id: r for r in df.collect()}
    assert got[1].tokens <= 100 and got[1].action.endswith("…") and got[2].action == ""
    assert plan_of(df).count("regexp_replace") < 200


def test_history_is_sized_line_by_line(spark):
    """The most lines that fit stay, whether their sizes come with the block or not; a trimmed block is not built for every length."""
    rnd = random.Random(8)
    rows = [(i, i % 3 == 0, f"head {i}", ["a: b"] * (i % 4), ["a: c"], [rnd.choice([None, " ", f"I-{i} up  ", "x 1 " * 9]) for _ in range(i % 12)], ["m1", "m2"]) for i in range(60)]
    blocks = spark.createDataFrame(rows, "id int, is_group boolean, head string, raw_long array<string>, raw_short array<string>, history array<string>, members array<string>")
    got = prompts.trim_dynamic(blocks, 90)
    sized = prompts.trim_dynamic(blocks.withColumn("history_milli", F.transform("history", prompts.line_milli)), 90)
    assert sorted(got.collect()) == sorted(sized.collect())
    assert plan_of(got).count("older ones left out") < 8
    for n in range(1, 12):  # one line more would not have fitted
        longer = blocks.join(got.where("NOT short_payload AND dropped_history > 0").select("id", "dropped_history"), "id").where(f"size(history) = {n}").select(
            "id", text.estimate_tokens(prompts._dynamic(F.col("dropped_history") - 1, False, False)).alias("t"))
        assert longer.where("t <= 90").count() == 0


def test_shared_parts_are_estimated_before_they_meet_incidents(spark):
    """Sizes of documents come with the documents: what only needs sizes reads no text behind the join."""
    t = Tables(spark, "/root/testdata/sf0.001")
    fitted = prompts.fit_parts(q_prompts.parts_of(t), t.cfg).groupBy("name").agg(F.sum("tokens"))
    plan = plan_of(fitted)
    assert plan.index("Join Inner, (section_id") < plan.index("concat(<doc")
    spark.catalog.clearCache()


def test_a_frequent_key_is_not_dealt_to_one_task(spark):
    """Half of the rows share a command, some have none: the join deals none of them by the command."""
    rows = spark.range(6000).select("id", F.when(F.col("id") % 2 == 0, "df -h").when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.concat(F.lit("cat "), "id")).alias("command"))
    values = rows.groupBy("command").agg(F.count("*").alias("n")).withColumn("reason", F.concat(F.lit("r "), "command"))
    got = scans.join_by_count(rows, values, "command")
    assert got.columns == ["id", "command", "reason"]
    assert sorted(got.collect()) == sorted(rows.withColumn("reason", F.concat(F.lit("r "), "command")).collect())
    judged = commands.classify_commands(rows.withColumnRenamed("id", "check_id"))
    assert judged.count() == 6000 and "_deal" in plan_of(judged)
    spark.catalog.clearCache()


def test_filters_stay_above_settled_columns(spark):
    made = spark.range(4).select("id", F.regexp_replace(F.concat(F.lit("t "), F.col("id")), "t+", "u").alias("text")).repartition(3, "id")
    df = scans.settled(made, "text").where("text RLIKE '[12]' AND text RLIKE 'u'")
    assert sorted(r.text for r in df.collect()) == ["u 1", "u 2"]
    assert plan_of(df).count("regexp_replace") == 1


def test_findings_come_from_one_scan(spark):
    df = QUERIES["allow_findings"](Tables(spark, "/root/testdata/sf0.001"))
    assert df._jdf.queryExecution().withCachedData().toString().count("InMemoryRelation") >= 3
    spark.catalog.clearCache()


def test_a_task_parses_a_bounded_number_of_rows(spark):
    rows = spark.range(0, 2000, 1, 2)
    assert Tables(spark, "/root/testdata/sf0.001").spread(rows, 50).rdd.getNumPartitions() == 40
