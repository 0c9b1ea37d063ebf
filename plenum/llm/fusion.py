"""Best representative of each duplicate group: Bayesian fusion with copy detection, field by field.

For each group, field and source the source's preferred record makes its claim. From the claims, in ``ROUNDS`` rounds:

* accuracy of a source: the mean posterior of the values it claims;
* dependence of two sources: the posterior that one copies the other, from how often they share false values, share
  the accepted value, or differ (shared false values speak for copying);
* vote of a claim: ln(N A / (1 - A)), times the probability that it was not copied from a source counted before it;
* posterior of a value: its votes and the prior of its rank, normalised over the values of its group and field.

Aliases have no single true value: each alias of a group is believed or not by itself, from the discounted votes
ln(A / (1 - A)) of the sources that offer it against a prior of ``ALIAS_PRIOR``.

The prior falls by ``prior`` a rank of the stated preference. With ``strict`` the fall is larger than any sum of votes, so
that the stated preference decides and the votes only grade it (this is what ``p7_found`` asks for); with a small one
the evidence can overrule the preference.

Scale: a group may hold a third of all rows, so records are first reduced to one claim a source by a partially
aggregated minimum; all that follows is as large as groups x fields x sources. The dependences of pairs of sources are
joined by the pair, whatever their number.

Defined results
* a group counts if at least two of its ids have a record; ids without record and records in no group are ignored;
* a field without a usable value (a description of its own; a confidence within 0..1) has no row;
* a null source is a source of its own; null times are earliest; ties end at the smaller id; rows repeated under one id count once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.own_text import with_own_description
from plenum.runtime import cut

#: False values assumed for a field, probability that a copier copies a value, and that two sources depend on each other beforehand.
FALSE_VALUES, COPY_RATE, COPY_PRIOR = 50, 0.8, 0.1
ROUNDS = 2
#: Log-odds that an alias is true before any source's vote.
ALIAS_PRIOR = -1.0
#: Accuracies stay within these bounds.
FLOOR, CEILING = 0.05, 0.95


def _members(records: DataFrame, groups: DataFrame) -> DataFrame:
    """The records of every group that has at least two."""
    df = groups.select("entity_id", "group_id").join(records.filter("entity_id IS NOT NULL"), "entity_id")
    ids = groups.select("entity_id", "group_id").join(records.select("entity_id"), "entity_id", "left_semi")
    sizes = ids.groupBy("group_id").agg(F.min("entity_id").alias("_lo"), F.max("entity_id").alias("_hi"))
    # cut: a plain side, so that adaptive execution may split the rows of a hot group
    return df.join(cut(sizes.filter("_lo <> _hi").select("group_id")), "group_id", "left_semi")


def claims(records: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, field_name, source, value, pref, entity_id): each source's claim; ``pref`` sorts the preferred one first."""
    cols = ["entity_id", "canonical_name", "description", "confidence", "source", "updated_at"]
    df = _members(with_own_description(records.select(*cols)), groups)
    sound = F.when(F.col("confidence").between(0, 1) & ~F.isnan("confidence"), F.col("confidence"))
    late = -F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(2**62)))
    text = F.col("own_description")
    least = F.lit(2.0)
    described = F.struct(F.lit("description").alias("field_name"), F.xxhash64(F.lower(text)).cast("string").alias("value"),
                         F.struct((-F.length(text)).cast("double").alias("p1"), F.coalesce(-sound, least).alias("p2"), late.alias("p3"), F.col("entity_id").alias("p4")).alias("pref"), text.isNotNull().alias("ok"))
    trusted = F.struct(F.lit("confidence").alias("field_name"), F.round(sound, 2).cast("string").alias("value"),
                       F.struct((-sound).alias("p1"), F.lit(0.0).alias("p2"), late.alias("p3"), F.col("entity_id").alias("p4")).alias("pref"), sound.isNotNull().alias("ok"))
    rows = df.select("group_id", F.coalesce("source", F.lit("")).alias("source"), F.explode(F.array(described, trusted)).alias("c")).filter("c.ok")
    best = rows.groupBy("group_id", "c.field_name", "source").agg(F.min(F.struct("c.pref", "c.value")).alias("b"))
    return best.select("group_id", "field_name", "source", "b.value", "b.pref", F.col("b.pref.p4").alias("entity_id"))


def _dependence(claimed: DataFrame, accuracy: DataFrame) -> DataFrame:
    """(s, t, dep): the posterior that the sources s < t depend on each other."""
    item = claimed.groupBy("group_id", "field_name").agg(F.sort_array(F.collect_list(F.struct("source", "value", "accepted"))).alias("cs"))
    pairs = item.select(F.explode(F.expr(
        "flatten(transform(cs, (x, i) -> transform(slice(cs, i + 2, size(cs)), y -> struct(x.source AS s, y.source AS t, "
        "CASE WHEN x.value <> y.value THEN 'differ' WHEN x.accepted THEN 'true' ELSE 'false' END AS kind))))")).alias("p")).select("p.*")
    stats = pairs.groupBy("s", "t").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(n) for k, n in (("true", "kt"), ("false", "kf"), ("differ", "kd"))])
    one = accuracy.select(F.col("source").alias("s"), F.col("accuracy").alias("a1"))
    two = accuracy.select(F.col("source").alias("t"), F.col("accuracy").alias("a2"))
    df = stats.join(one, "s").join(two, "t")
    both, c = F.col("a1") * F.col("a2"), COPY_RATE
    wrong = (1 - F.col("a1")) * (1 - F.col("a2")) / FALSE_VALUES
    differ = F.greatest(1 - both - wrong, F.lit(1e-6))
    mean = (F.col("a1") + F.col("a2")) / 2
    apart = F.col("kt") * F.log(both) + F.col("kf") * F.log(wrong) + F.col("kd") * F.log(differ)
    tied = F.col("kt") * F.log(mean * c + both * (1 - c)) + F.col("kf") * F.log((1 - mean) * c + wrong * (1 - c)) + F.col("kd") * F.log(differ * (1 - c))
    odds = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), apart - tied + math.log((1 - COPY_PRIOR) / COPY_PRIOR)))
    return df.select("s", "t", (1 / (1 + F.exp(odds))).alias("dep"))


def _free(claimed: DataFrame, dep: DataFrame, item: list[str]) -> DataFrame:
    """``claimed`` (``item``, source, accuracy, ...) with ``free``: the probability that a claim was not copied from one that counts before it.

    Within an item the more accurate source counts first; each pair of a claim and one before it meets the pair's dependence.
    """
    before = Window.partitionBy(*item).orderBy(F.desc("accuracy"), "source").rowsBetween(Window.unboundedPreceding, -1)
    df = claimed.withColumn("ahead", F.collect_list("source").over(before))
    pairs = df.select(*item, "source", F.explode("ahead").alias("other")).withColumns({"s": F.least("source", "other"), "t": F.greatest("source", "other")}).join(dep, ["s", "t"])
    free = pairs.groupBy(*item, "source").agg(F.exp(F.sum(F.log(1 - COPY_RATE * F.col("dep")))).alias("free"))
    return df.drop("ahead").join(free, [*item, "source"], "left").withColumn("free", F.coalesce("free", F.lit(1.0)))


def _fused(records: DataFrame, groups: DataFrame, prior: float, strict: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The accepted values, the sources' accuracies (source, accuracy) and dependences (s, t, dep)."""
    made = cut(claims(records, groups))
    sources = [r[0] for r in made.select("source").distinct().limit(4097).collect()]
    if len(sources) > 4096:
        raise ValueError("sources are a dimension of at most 4096 names; name fewer")
    # a prior stronger than all votes together
    most = len(sources) * (abs(math.log(FALSE_VALUES * CEILING / (1 - CEILING))) + 1)
    fall = most if strict else prior
    field = Window.partitionBy("group_id", "field_name")
    # distinct values are ranked by their best claim
    item = ["group_id", "field_name", "value"]
    per_value = Window.partitionBy(*item)
    df = made.withColumn("lead", F.min("pref").over(per_value)).withColumn("rank", F.dense_rank().over(field.orderBy("lead")) - 1)
    accuracy = cut(made.select("source").distinct().withColumn("accuracy", F.lit(0.8)))
    dep = None
    for last in [False] * ROUNDS + [True]:
        # accuracies: at most 4096 rows
        votes = df.join(F.broadcast(accuracy), "source").withColumn("vote", F.log(FALSE_VALUES * F.col("accuracy") / (1 - F.col("accuracy"))))
        counted = votes.withColumn("v", F.col("vote")) if dep is None else _free(votes, dep, item).withColumn("v", F.col("vote") * F.col("free")).drop("free")
        scored = counted.withColumn("votes", F.sum("v").over(per_value))
        scored = scored.withColumn("score", F.col("votes") - (F.lit(fall) * F.col("rank") if last else F.lit(min(fall, prior)) * F.col("rank")))
        top = F.max("score").over(field)
        # every value's share once, however many sources claim it
        weight = F.exp(F.col("score") - top)
        first = F.row_number().over(per_value.orderBy("pref")) == 1
        scored = scored.withColumn("w", weight).withColumn("first", first)
        scored = scored.withColumn("posterior", F.col("w") / F.sum(F.when(F.col("first"), F.col("w"))).over(field))
        if last:
            pick = F.row_number().over(field.orderBy(F.desc("score"), "lead"))
            won = scored.filter("first").withColumn("_r", pick).filter("_r = 1").select("group_id", "field_name", "entity_id", "value", "posterior", "votes")
            return won, accuracy, dep
        judged = cut(scored.withColumn("accepted", F.col("score") == top).select("group_id", "field_name", "source", "value", "accepted", "posterior"))
        accuracy = cut(judged.groupBy("source").agg(F.least(F.lit(CEILING), F.greatest(F.lit(FLOOR), F.avg("posterior"))).alias("accuracy")))
        dep = cut(_dependence(judged, accuracy))
    raise AssertionError


def fuse(records: DataFrame, groups: DataFrame, prior: float = 0.5, strict: bool = False) -> DataFrame:
    """(group_id, field_name, entity_id, value, posterior, votes): the accepted value of each field and the record it comes from."""
    return _fused(records, groups, prior, strict)[0]


def fused_aliases(records: DataFrame, groups: DataFrame, prior: float = 0.5) -> DataFrame:
    """(group_id, alias, n_sources, posterior, accepted): every alias that a group's records offer, case and blanks aside, and whether it is believed."""
    _, accuracy, dep = _fused(records, groups, prior, False)
    member = _members(records.select("entity_id", "aliases", "source"), groups)
    offered = member.select("group_id", F.coalesce("source", F.lit("")).alias("source"), F.explode("aliases").alias("a")).withColumn("alias", F.lower(F.trim(F.regexp_replace("a", r"\s+", " ")))).filter("alias <> ''")
    once = offered.select("group_id", "alias", "source").distinct().join(F.broadcast(accuracy), "source", "left").withColumn("accuracy", F.coalesce("accuracy", F.lit(0.5)))
    voted = _free(once, dep, ["group_id", "alias"]).withColumn("v", F.log(F.col("accuracy") / (1 - F.col("accuracy"))) * F.col("free"))
    per = voted.groupBy("group_id", "alias").agg(F.countDistinct("source").alias("n_sources"), (1 / (1 + F.exp(-(F.sum("v") + ALIAS_PRIOR)))).alias("posterior"))
    return per.withColumn("accepted", F.col("posterior") > 0.5)


def fused_records(records: DataFrame, groups: DataFrame, strict: bool = True) -> DataFrame:
    """One surviving record for each group: group_id, description and its origin, confidence and its origin."""
    won = fuse(records, groups, strict=strict)
    side = lambda f: won.filter(F.col("field_name") == f).select("group_id", F.col("entity_id").alias(f"{f}_from"))
    both = side("description").join(side("confidence"), "group_id", "full")
    text = records.select(F.col("entity_id").alias("description_from"), F.col("description"))
    trust = records.select(F.col("entity_id").alias("confidence_from"), F.col("confidence"))
    return both.join(text, "description_from", "left").join(trust, "confidence_from", "left").select("group_id", "description", "description_from", "confidence", "confidence_from")


def group_aliases(records: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, alias, n_records): every alias that a group's records offer and how many offer it; null and blank ones are none."""
    member = _members(records.select("entity_id", "aliases"), groups)
    rows = member.select("group_id", "entity_id", F.explode("aliases").alias("alias")).withColumn("alias", F.trim("alias")).filter("alias <> ''")
    return rows.groupBy("group_id", "alias").agg(F.countDistinct("entity_id").alias("n_records"))
