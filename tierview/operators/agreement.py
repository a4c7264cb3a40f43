"""Do two tiers hold the same rows where they overlap? Multiset digests, refined down to the rows that differ.

A tier's rows of a bucket of time are one digest: how many there are, and the sum and the exclusive or of their 64-bit
hashes, which do not depend on order and tell copies apart. Buckets whose digests are equal hold the same rows, but for
one chance in 2**64. Of a bucket that differs, the same is asked of the shares that its rows fall into by their hashes,
and only rows of shares that differ are compared as rows. So what is shuffled is a row for each bucket and task where
the tiers agree, and the rows of some shares where they do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierview.functions import sqltext
from tierview.functions.boundaries import Boundary
from tierview.operators.unify import cold_scan, hot_scan
from tierview.plans.mapping import MappingPlan

#: Shares of a bucket: rows of one bucket that differ cost the comparison of a 1024th of it each.
SHARES = 1024

#: Width of a bucket in the unit of the time column: days of dates, seconds of moments and of epochs.
WIDTHS = {"date": 1, "datetime": 86_400, "bigint": 86_400}


def overlap(
    hot: DataFrame, cold: DataFrame, plan: MappingPlan, start: Boundary | None = None, end: Boundary | None = None
) -> tuple[DataFrame, DataFrame]:
    """The rows of both tiers with ``start <= time < end``, in unified columns; without limits all that have a time."""

    def within(df: DataFrame, time: str, time_filter) -> DataFrame:
        kept = df.where(f"{time} IS NOT NULL")
        for op, limit in ((">=", start), ("<", end)):
            kept = kept if limit is None else kept.where(time_filter(op, limit))
        return kept

    ours = hot_scan(within(hot, sqltext.ident(plan.spec.time_column), plan.hot_time_filter), plan)
    theirs = cold_scan(within(cold, plan.time_rule.cold_expr, plan.cold_time_filter), plan)
    return ours, theirs


def bucket(time: Column, kind: T.DataType, width: int) -> Column:
    """The number of the bucket of ``width`` days, seconds or units, counted from 1970 or 0; also below it."""
    if isinstance(kind, T.DateType):
        unit = F.unix_date(time).cast("bigint")
    elif isinstance(kind, T.TimestampType):
        unit = F.floor(F.unix_micros(time) / F.lit(1_000_000)).cast("bigint")
    elif isinstance(kind, T.TimestampNTZType):
        day = time.cast("date")
        unit = F.unix_date(day).cast("bigint") * 86_400 + F.hour(time) * 3600 + F.minute(time) * 60 + F.floor(F.second(time))
    else:
        unit = time.cast("bigint")
    # ``div`` goes towards zero, a bucket towards minus infinity.
    below = (unit % F.lit(width) < 0).cast("bigint")
    return F.call_function("div", unit, F.lit(width).cast("bigint")) - below


def _marked(hot: DataFrame, cold: DataFrame, time: str, width: int) -> DataFrame:
    """Rows of both tiers as ``__row`` with ``__hot`` (1 or 0), ``__bucket`` and ``__hash``."""
    kind = hot.schema[time].dataType
    names = hot.columns

    def marked(df: DataFrame, ours: int) -> DataFrame:
        columns = [sqltext.column(c) for c in names]
        return df.select(
            F.lit(ours).alias("__hot"),
            bucket(sqltext.column(time), kind, width).alias("__bucket"),
            F.xxhash64(*columns).alias("__hash"),
            F.struct(*columns).alias("__row"),
        )

    return marked(hot, 1).union(marked(cold, 0))


def _digests(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows and digest of each tier for each key; ``__agrees`` where they are the same."""
    sums = []
    for name, ours in (("n_hot", 1), ("n_cold", 0)):
        mine = F.col("__hot") == ours
        own = F.when(mine, F.col("__hash"))
        sums += [F.count_if(mine).alias(name), F.sum(own.cast("decimal(20,0)")).alias(f"__sum{ours}"), F.bit_xor(own).alias(f"__xor{ours}")]
    same = (F.col("n_hot") == F.col("n_cold")) & F.col("__sum0").eqNullSafe(F.col("__sum1")) & F.col("__xor0").eqNullSafe(F.col("__xor1"))
    return rows.groupBy(*keys).agg(*sums).withColumn("__agrees", same)


def agreement(hot: DataFrame, cold: DataFrame, time: str, width: int) -> DataFrame:
    """Per bucket of time with rows in either tier: ``bucket``, ``n_hot``, ``n_cold`` and ``agrees``.

    Both frames have the same columns (:func:`overlap`). Rows are told by all columns; ``bucket`` is its first unit.
    """
    rows = _marked(hot, cold, time, width).select("__hot", "__bucket", "__hash")
    told = _digests(rows, "__bucket")
    first = F.coalesce(F.try_multiply("__bucket", F.lit(width)), F.lit(-(2**63)))
    return told.select(first.alias("bucket"), "n_hot", "n_cold", F.col("__agrees").alias("agrees"))


def differences(hot: DataFrame, cold: DataFrame, time: str, width: int, shares: int = SHARES) -> DataFrame:
    """The rows that one tier has more often than the other, with ``n_hot`` and ``n_cold``.

    Two rounds of digests come first, of buckets and of the shares of those that differ; each is joined to the rows on
    its keys, which Spark sends to all tasks where there are few and shuffles where there are many. A bucket that holds
    a third of all rows is spread over its shares, and copies are counted in each task before they are moved.
    """
    rows = _marked(hot, cold, time, width)
    share = F.pmod(F.xxhash64("__hash"), F.lit(shares)).cast("int")
    buckets = _digests(rows.select("__hot", "__bucket", "__hash"), "__bucket").where("NOT __agrees").select("__bucket")
    open_rows = rows.join(buckets, "__bucket", "left_semi").withColumn("__share", share)
    parts = _digests(open_rows.select("__hot", "__bucket", "__share", "__hash"), "__bucket", "__share")
    parts = parts.where("NOT __agrees").select("__bucket", "__share")
    left = open_rows.join(parts, ["__bucket", "__share"], "left_semi")
    counted = left.groupBy("__row").agg(F.count_if(F.col("__hot") == 1).alias("n_hot"), F.count_if(F.col("__hot") == 0).alias("n_cold"))
    return counted.where("n_hot <> n_cold").select("__row.*", "n_hot", "n_cold")
