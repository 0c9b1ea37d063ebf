"""Usage of external services: roll-up per stage and sliding rate windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rollup(log: DataFrame, keys: dict[str, str], duration: str, tokens: dict[str, str] | None = None) -> DataFrame:
    """Calls, total, mean and longest duration and summed tokens per group.

    ``keys`` and ``tokens`` name the output columns and the columns or expressions they come from (stage, model; prompt,
    output, total). Null keys form a group of their own; null tokens count nothing.
    """
    sums = [F.coalesce(F.sum(F.expr(c)), F.lit(0)).alias(n) for n, c in (tokens or {}).items()]
    return log.groupBy(*[F.expr(c).alias(n) for n, c in keys.items()]).agg(
        F.count("*").alias("calls"), F.round(F.sum(duration), 2).alias("total"), F.round(F.avg(duration), 4).alias("mean"), F.round(F.max(duration), 2).alias("longest"), *sums)


def successes(results: DataFrame, status: str, by: list[str] | None = None) -> DataFrame:
    """(n_results, n_success, n_failed) of a run, in all or by ``by``; a null status is a failure."""
    good = F.coalesce(F.col(status) == "success", F.lit(False))
    return results.groupBy(*(by or [])).agg(F.count("*").alias("n_results"), F.count(F.when(good, 1)).alias("n_success"), F.count(F.when(~good, 1)).alias("n_failed"))


def rate_window(log: DataFrame, time: str, key: str, tie: str, period: int = 60, most: int = 60) -> DataFrame:
    """Each call with the number of calls of its key in the ``period`` seconds up to it, and whether a limit of ``most`` was exceeded.

    Keys are independent; a window spans its period only, so a busy key costs its own rows once. Rows without time are left out.
    """
    seconds = F.unix_seconds(F.col(time).cast("timestamp"))
    frame = Window.partitionBy(key).orderBy("second").rangeBetween(-period, 0)
    df = log.filter(F.col(time).isNotNull()).select(F.col(tie), F.col(key), seconds.alias("second"))
    return df.withColumn("in_window", F.count("*").over(frame)).withColumn("over_limit", F.col("in_window") > most)
