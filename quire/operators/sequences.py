"""Order-dependent operators: sessions, gaps, packing, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "island") -> DataFrame:
    """A running number of runs of equal values (null is a value) within each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.when(F.row_number().over(w) == 1, 0).otherwise((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"))
    return df.withColumn("_change", change).withColumn(out, F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def split_at_flags(df: DataFrame, keys: list[str], order: list[str], flag: Column, out: str = "part") -> DataFrame:
    """A running number that grows at each flagged row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.coalesce(flag.cast("int"), F.lit(0))).over(w))


def gaps(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, after, before, missing): steps of more than one between consecutive distinct numbers."""
    w = Window.partitionBy(*keys).orderBy(number)
    steps = df.select(*keys, number).distinct().withColumn("before", F.lead(number).over(w)).withColumnRenamed(number, "after")
    return steps.where("before > after + 1").withColumn("missing", (F.col("before") - F.col("after") - 1).cast("long"))


def greedy_pack(df: DataFrame, keys: list[str], order: str, size: str, budget: int, out: str = "chunk") -> DataFrame:
    """Consecutive rows in chunks of at most `budget`; a larger row is alone. A fold over each key's ordered rows."""
    state = F.struct(F.lit(-1).alias("chunk"), F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<o:bigint,c:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = (s["chunk"] < 0) | (s["used"] + x["s"] > budget)
        chunk = s["chunk"] + fresh.cast("int")
        return F.struct(chunk.alias("chunk"), F.when(fresh, x["s"]).otherwise(s["used"] + x["s"]).alias("used"), F.concat(s["out"], F.array(F.struct(x["o"].alias("o"), chunk.alias("c")))).alias("out"))

    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col(size).cast("long").alias("s")))).alias("_r"))
    return rows.select(*keys, F.explode(F.aggregate("_r", state, step, lambda s: s["out"])).alias("_x")).select(*keys, F.col("_x.o").alias(order), F.col("_x.c").alias(out))


def asof_preceding(df: DataFrame, keys: list[str], order: list[str], is_mark: Column, value: str, out: str) -> DataFrame:
    """The value of the last marked row before each row (not its own)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(F.when(is_mark, F.col(value)), ignorenulls=True).over(w))


def asof_following(df: DataFrame, keys: list[str], order: list[str], is_mark: Column, value: str, out: str) -> DataFrame:
    """The value of the first marked row after each row (not its own)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(out, F.first(F.when(is_mark, F.col(value)), ignorenulls=True).over(w))
