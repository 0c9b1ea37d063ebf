"""Mixing sources to target weights by a low-discrepancy schedule.

Sizes are tokens of a public tokenizer. A source with ``n`` tokens that may be used ``r`` times offers n r tokens. The
mixture is as large as it can be with every source that has text at its share (or ``total`` tokens: sources that cannot
reach their share are then used up and the others share the rest by weight). The k-th slot goes to the source into
whose stretch of the cumulative weights the k-th point of the golden-ratio sequence falls; the j-th slot of a source
takes the j-th block of ``block`` tokens from its shuffled documents, which start over, in another order, up to ``r`` times.

Scale: sources are few and may hold half of all rows, so nothing is ordered inside a source as a whole: documents are
ordered in ``BINS`` hash bins per source and pass, and only the bins' totals are summed up; slots are ranked in blocks
of consecutive numbers in the same way.

Defined results
* documents without text tokens, without source, or of a source without target are not used;
* a source without text, or with a null or non-positive share or no repeats allowed, gets nothing; the shares of the others keep their proportions;
* no document is used more often than allowed; a source misses its quota by less than one document; empty tables give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.tokens import count_tokens
from plenum.runtime import cut

#: Hash bins of one source and pass, and slots numbered together.
BINS, STRETCH = 1024, 1 << 14
GOLDEN = 0.6180339887498949


def quotas(supply: dict[str, tuple[float, int, int]], total: float | None = None) -> dict[str, float]:
    """Tokens to take of each source from (share, tokens, repeats)."""
    live = {s: v for s, v in supply.items() if v[0] and v[0] > 0 and v[1] * v[2] > 0}
    if not live:
        return {}
    if total is None:
        weight = sum(v[0] for v in live.values())
        size = min(v[1] * v[2] * weight / v[0] for v in live.values())
        return {s: size * v[0] / weight for s, v in live.items()}
    out: dict[str, float] = {}
    rest, open_ = float(total), dict(live)
    while open_:
        weight = sum(v[0] for v in open_.values())
        short = {s: v for s, v in open_.items() if v[1] * v[2] < rest * v[0] / weight}
        for s, v in (short or open_).items():
            out[s] = min(v[1] * v[2], rest * v[0] / weight)
        if not short:
            break
        rest -= sum(out[s] for s in short)
        open_ = {s: v for s, v in open_.items() if s not in short}
    return out


def _running(df: DataFrame, group: list[str], bin_: str, order: list, value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the group's earlier rows, in bins."""
    totals = df.groupBy(*group, bin_).agg(F.sum(value).alias("_t"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.partitionBy(*group).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    inner = Window.partitionBy(*group, bin_).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(before, [*group, bin_]).withColumn(out, F.col("_before") + F.col("_inner")).drop("_before", "_inner")


def _sized(docs: DataFrame, targets: DataFrame) -> tuple[DataFrame, dict]:
    wanted = {r[0]: (r[1], r[2]) for r in targets.filter("source IS NOT NULL").select("source", "target_share", "max_repeats").limit(100_000).collect()}
    size = count_tokens(docs)
    size = cut(docs.filter("doc_id IS NOT NULL").select("doc_id", "source").join(targets.select("source"), "source", "left_semi").join(size, "doc_id").filter("n_tokens > 0"))
    have = {r[0]: r[1] for r in size.groupBy("source").agg(F.sum("n_tokens")).collect()}
    return size, {s: (w or 0.0, have.get(s, 0), r or 0) for s, (w, r) in wanted.items()}


def available(docs: DataFrame, targets: DataFrame) -> float:
    """Tokens of all documents whose source has a target, each counted once."""
    size = count_tokens(docs.filter("doc_id IS NOT NULL").join(targets.filter("source IS NOT NULL").select("source").distinct(), "source", "left_semi"))
    return float(size.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])


def mixture(docs: DataFrame, targets: DataFrame, total: float | None = None, block: int = 2048, seed: int = 1, _made: tuple | None = None) -> DataFrame:
    """(slot, source, block, place, doc_id, repeat, n_tokens): the mixture in order of ``slot`` and ``place``."""
    size, supply = _made or _sized(docs, targets)
    take = quotas(supply, total)
    spark = docs.sparkSession
    rows = [(s, float(q), int(min(supply[s][2], -(-q // supply[s][1])))) for s, q in take.items()]
    plan = F.broadcast(spark.createDataFrame(rows, "source string, quota double, passes int"))
    used = size.join(plan, "source").withColumn("repeat", F.explode(F.expr("sequence(0, passes - 1)")))
    mixed = F.xxhash64(F.lit(seed), "repeat", "doc_id")
    used = used.withColumn("_bin", (F.col("repeat") * BINS + F.pmod(mixed, F.lit(BINS))).cast("int")).withColumn("_o", F.xxhash64(mixed, F.lit(seed)))
    placed = _running(used, ["source"], "_bin", [F.col("_o"), F.col("doc_id")], "n_tokens", "start").filter("start < quota")
    blocks = placed.withColumn("block", F.floor(F.col("start") / block).cast("bigint"))
    # the schedule: enough points for every source's blocks
    slots = sum(int(q // block) + 2 for q in take.values())
    weight = sum(take.values()) or 1.0
    point = F.expr(f"pmod((id + 1) * {GOLDEN}D, 1D)")
    # from the top down, the first lower edge that the point reaches
    case, edge = F.lit(None).cast("string"), 1.0
    for s, q in sorted(take.items(), reverse=True):
        edge -= q / weight
        case = F.coalesce(case, F.when(point >= max(edge, 0.0) - 1e-12, F.lit(s)))
    reach = slots + 64 * max(len(take), 1)
    line = spark.range(reach).select("id", case.alias("source"), F.lit(1).alias("one")).filter("source IS NOT NULL")
    line = line.withColumn("_bin", F.floor(F.col("id") / STRETCH))
    ranked = _running(line, ["source"], "_bin", [F.col("id")], "one", "block").select(F.col("id").alias("slot"), "source", F.col("block").cast("bigint").alias("block"))
    # blocks beyond the points' reach, at the end of a source, follow the last slot
    out = blocks.join(ranked, ["source", "block"], "left")
    inside = Window.partitionBy("source", "block").orderBy("start")
    return out.withColumn("place", F.row_number().over(inside) - 1).select(F.coalesce("slot", F.lit(reach) + F.col("block")).alias("slot"), "source", "block", "place", "doc_id", "repeat", "n_tokens")


def shares(docs: DataFrame, targets: DataFrame, total: float | None = None, block: int = 2048) -> DataFrame:
    """(source, target_share, max_repeats, available, n_docs, used, times_used, actual_share): what each source contributes."""
    size, supply = made = _sized(docs, targets)
    got = mixture(docs, targets, total, block, _made=made).groupBy("source").agg(F.sum("n_tokens").alias("used"), F.countDistinct("doc_id").alias("n_docs"), (F.max("repeat") + 1).alias("times_used"))
    have = size.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    df = targets.filter("source IS NOT NULL").select("source", "target_share", "max_repeats").join(have, "source", "left").join(got, "source", "left").fillna(0, ["available", "used", "n_docs", "times_used"])
    whole = F.sum("used").over(Window.partitionBy())
    return df.withColumn("actual_share", F.when(whole > 0, F.col("used") / whole).otherwise(F.lit(0.0)))
