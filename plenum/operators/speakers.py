"""Speaker resolution against a registry: exact, then fuzzy with a role gate, then surname and role.

The registry is a snapshot: newcomers do not match each other, they are collapsed by their normalised name.

Defined results: a null or blank name matches nobody; of equal exact matches the first registry row (created_at, then
id) counts; two near equal fuzzy candidates need matching roles, else nobody matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions.text import canonical_speaker_id, fill_if_empty, normalize_name, surname
from plenum.operators.fuzzy import fuzzy_ratio_fast, similar_names

THRESHOLD, GAP, ROLE_GATE, ROLE_SURE = 85, 5, 50, 70


def match(names: DataFrame, registry: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(name, role, canonical_id, stage) for each distinct (name, role): stage exact, fuzzy, surname or null."""
    q = names.filter("name IS NOT NULL").select("name", "role").distinct().withColumn("norm", normalize_name(F.col("name"))).withColumn("qrole", F.nullif(F.lower("role"), F.lit("")))
    order = F.row_number().over(Window.partitionBy("norm").orderBy("created_at", "canonical_id"))
    reg = registry.filter("canonical_id IS NOT NULL AND name IS NOT NULL").select("canonical_id", F.col("name").alias("rname"), normalize_name(F.col("name")).alias("norm"), F.nullif(F.lower("role"), F.lit("")).alias("rrole"), "created_at")
    first = reg.withColumn("k", order).filter("k = 1").select("norm", F.col("canonical_id").alias("exact_id"))
    exact = q.join(first, "norm")
    left = q.join(first.select("norm"), "norm", "left_anti")
    # a second candidate matters within GAP of one at the threshold or above
    near = similar_names(left.select(F.col("norm").alias("name")), reg.select(F.col("norm").alias("name")), threshold - GAP)
    scored = left.join(near.withColumnRenamed("a", "norm"), "norm").join(reg.select(F.col("norm").alias("b"), "canonical_id", "rrole", "created_at"), "b")
    role = F.when(F.col("qrole").isNotNull() & F.col("rrole").isNotNull(), fuzzy_ratio_fast("qrole", "rrole"))
    scored = scored.withColumn("role_ratio", role).filter(f"role_ratio IS NULL OR role_ratio >= {ROLE_GATE}")
    place = Window.partitionBy("name", "role").orderBy(F.desc("ratio"), "created_at", "canonical_id")
    top = scored.withColumn("k", F.row_number().over(place)).withColumn("second", F.lead("ratio").over(place)).filter(F.col("k") == 1)
    open_ = F.col("second").isNotNull() & (F.col("ratio") - F.col("second") < GAP)
    judged = top.filter(F.col("ratio") >= threshold).withColumn("fuzzy_id", F.when(~open_ | (F.col("role_ratio") >= ROLE_SURE), F.col("canonical_id"))).select("name", "role", "fuzzy_id", F.lit(True).alias("judged"))
    on = F.col("name").eqNullSafe(F.col("_n")) & F.col("role").eqNullSafe(F.col("_r"))
    rest = left.join(judged.withColumnsRenamed({"name": "_n", "role": "_r"}), on, "left").drop("_n", "_r")
    # surname and role: only where nothing reached the threshold and a role is known
    tail = rest.filter("judged IS NULL AND qrole IS NOT NULL").withColumn("sur", surname(F.col("name"))).join(reg.withColumn("sur", surname(F.col("rname"))).filter("rrole IS NOT NULL").drop("norm"), "sur")
    tail = tail.withColumn("rr", fuzzy_ratio_fast("qrole", "rrole")).filter(f"rr >= {ROLE_SURE}")
    tail = tail.groupBy("name", "role").agg(F.min_by("canonical_id", F.struct("created_at", "canonical_id")).alias("surname_id")).withColumnsRenamed({"name": "_n", "role": "_r"})
    rest = rest.join(tail, on, "left")
    late = rest.select("name", "role", F.coalesce("fuzzy_id", "surname_id").alias("canonical_id"), F.when(F.col("fuzzy_id").isNotNull(), "fuzzy").when(F.col("surname_id").isNotNull(), "surname").alias("stage"))
    return exact.select("name", "role", F.col("exact_id").alias("canonical_id"), F.lit("exact").alias("stage")).unionByName(late)


def newcomers(matched: DataFrame) -> DataFrame:
    """(canonical_id, name): a new registry row for each normalised name that matched nobody."""
    new = matched.filter("canonical_id IS NULL").withColumn("norm", normalize_name(F.col("name"))).filter("norm <> ''")
    return new.groupBy("norm").agg(F.min("name").alias("name")).select(canonical_speaker_id(F.col("name")).alias("canonical_id"), "name")


def resolved(labels: DataFrame, registry: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``labels`` (session_id, name, role) with ``canonical_id`` and ``stage``; a name that matches nobody has the id of its newcomer, stage new."""
    cols = [c for c in labels.columns if c not in ("name", "role")]
    told = match(labels.select("name", "role"), registry, threshold).withColumnsRenamed({"name": "_n", "role": "_r"})
    df = labels.filter("name IS NOT NULL").join(told, F.col("name").eqNullSafe(F.col("_n")) & F.col("role").eqNullSafe(F.col("_r")))
    fresh = F.when(normalize_name(F.col("name")) != "", canonical_speaker_id(F.col("name")))
    return df.select(*cols, "name", "role", F.coalesce("canonical_id", fresh).alias("canonical_id"), F.when(F.col("canonical_id").isNotNull(), F.col("stage")).when(fresh.isNotNull(), "new").alias("stage"))


def registry_after(registry: DataFrame, met: DataFrame) -> DataFrame:
    """The registry once its people were met: ``met`` (canonical_id, name, title, role, party, chamber, session_id, at), any number of rows each.

    Sessions are added once; title, role, party and chamber are filled where they are empty, from the first meeting that
    gives them; people that the registry lacks are added, named by their smallest spelling. Null ids and sessions add nothing.
    """
    facts = ["title", "role", "party", "chamber"]
    seen = met.filter("canonical_id IS NOT NULL").select("canonical_id", "name", "session_id", "at", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in facts])
    told = seen.groupBy("canonical_id").agg(F.min("name").alias("_name"), F.array_sort(F.collect_set("session_id")).alias("_sessions"), *[F.expr(f"min_by({c}, struct(at, {c})) FILTER (WHERE {c} IS NOT NULL)").alias(f"_{c}") for c in facts], F.min("at").alias("_at"), F.max("at").alias("_last"))
    df = registry.join(told, "canonical_id", "full")
    none = F.array().cast("array<string>")
    sessions = F.array_union(F.coalesce("session_ids", none), F.coalesce("_sessions", none))
    out = {"name": F.coalesce("name", "_name"), "session_ids": sessions, "created_at": F.coalesce("created_at", "_at"), "updated_at": F.greatest("updated_at", "_last")}
    out |= {c: fill_if_empty(F.col(c), F.col(f"_{c}")) for c in facts}
    return df.select(*[out[c].alias(c) if c in out else F.col(c) for c in registry.columns])
