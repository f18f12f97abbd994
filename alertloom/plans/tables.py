"""The driver's tables in Spark, with the adapter views on top."""
from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.operators import intake
from alertloom.plans import adapters
from alertloom.plans.dialect import Spark
from alertloom.session import prepare
from alertloom.settings import Settings

NAMES = ("events", "orders", "customer", "lineitem", "supplier", "part", "nation", "region", "documents", "pages",
         "conversations", "labels", "benchmark")


class Tables:
    """Lazily planned views over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = prepare(spark)
        self.path = str(path)
        self.cfg = Settings(root_host=adapters.ROOT)
        self.tag = uuid.uuid4().hex[:12]  # views of one session do not replace each other
        self.now = F.lit(adapters.NOW).cast("timestamp")

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        # times are stored without a zone and mean UTC, which is the session zone
        zoneless = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df

    def spread(self, df: DataFrame, per_task: int | None = None) -> DataFrame:
        """Rows over all cores where the files give fewer tasks than that: the test tables are single row groups. On tables of
        many files this changes nothing and shuffles nothing. Where a row is small but costs much, ``per_task`` bounds the rows of a
        task, so that a task does not grow with the table."""
        tasks = self.spark.sparkContext.defaultParallelism
        if per_task:
            tasks = max(tasks, -(-df.count() // per_task))
        return df.repartition(tasks, df.columns[0]) if df.rdd.getNumPartitions() < tasks else df

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("documents", "pages", "conversations"):
            return self.spread(self.raw(name))
        if name in NAMES:
            return self.raw(name)
        raise AttributeError(name)

    def _view(self, sql: str, **frames: DataFrame) -> DataFrame:
        for name, frame in (frames or {n: getattr(self, n) for n in NAMES if f"FROM {n}" in sql}).items():
            frame.createOrReplaceTempView(f"alertloom_{self.tag}_{name}")
            sql = sql.replace(f"FROM {name}", f"FROM alertloom_{self.tag}_{name}")
        return self.spark.sql(sql)

    def view(self, builder, *bases: str) -> DataFrame:
        return self._view(builder(Spark, *bases))

    @cached_property
    def arrivals(self) -> DataFrame:
        base = self.view(adapters.arrivals)
        return self._view(adapters.alerts_of(Spark, "base"), base=base)

    @cached_property
    def alerts(self) -> DataFrame:
        """Arrivals without the repeated deliveries."""
        return self.arrivals.where("external_id = CAST(seq AS STRING)")

    @cached_property
    def assigned(self) -> DataFrame:
        return intake.sessionize(self.alerts)

    @cached_property
    def rolled(self) -> DataFrame:
        return intake.incident_rollup(self.alerts)

    @cached_property
    def incidents(self) -> DataFrame:
        below = intake.skip_below_threshold(self.alerts).select(*self.rolled.columns)
        return self._view(adapters.state_of(Spark, "base"), base=self.rolled.unionByName(below)).drop("state0", "raw", "reopened")

    @cached_property
    def log(self) -> DataFrame:
        return self.view(adapters.events_log)

    @cached_property
    def analyses(self) -> DataFrame:
        return self._view(adapters.analyses(Spark), orders=self.spread(self.raw("orders")))

    @cached_property
    def cases(self) -> DataFrame:
        return self.view(adapters.cases)

    @cached_property
    def probes(self) -> DataFrame:
        return self.view(adapters.probe_results)

    @cached_property
    def polls(self) -> DataFrame:
        return self.view(adapters.poll_log)

    @cached_property
    def listings(self) -> DataFrame:
        return self.view(adapters.listings)

    @cached_property
    def rounds(self) -> DataFrame:
        return self.view(adapters.rounds)
