"""Tables on a shared folder: idempotent writes, insert-if-absent, keyed updates, cascading deletes, backfill.

Parquet tables have no MERGE: an update is a join with the new values and an overwrite of the partitions concerned.
Readers see the old or the new partition, never half of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.runtime import cut

S, I, D, TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampType()
_f = lambda **k: T.StructType([T.StructField(n, t) for n, t in k.items()])
#: The stored tables.
SCHEMAS: dict[str, T.StructType] = {
    "sessions": _f(session_id=S, date=T.DateType(), title=S, sitting_number=S, chamber=S, raw_transcript_json=S, created_at=TS),
    "videos": _f(id=S, video_id=S, session_id=S, platform=S, url=S, duration_seconds=I, created_at=TS, updated_at=TS),
    "speakers": _f(canonical_id=S, name=S, title=S, role=S, party=S, chamber=S, pronouns=S, aliases=T.ArrayType(S), session_ids=T.ArrayType(S), meta_data=T.MapType(S, S), created_at=TS, updated_at=TS),
    "agenda_items": _f(agenda_item_id=S, session_id=S, agenda_index=I, title=S, description=S, primary_speaker=S, created_at=TS),
    "transcript_sentences": _f(sentence_id=S, session_id=S, video_id=S, agenda_item_index=I, speech_block_index=I, sentence_index=I, speaker_id=S, speaker_name_original=S, speaker_name_normalized=S, full_text=S, timestamp_seconds=I, embedding=T.ArrayType(T.FloatType()), search_vector=S, created_at=TS),
    "entities": _f(entity_id=S, name=S, canonical_name=S, entity_type=S, entity_subtype=S, description=S, aliases=T.ArrayType(S), importance_score=D, confidence=D, embedding=T.ArrayType(T.FloatType()), source=S, source_ref=S, meta_data=T.MapType(S, S), created_at=TS, updated_at=TS),
    "mentions": _f(mention_id=S, entity_id=S, session_id=S, video_id=S, agenda_item_index=I, speech_block_index=I, sentence_index=I, timestamp_seconds=I, context=S, speaker_id=S, mention_type=S),
    "relationships": _f(relationship_id=S, source_entity_id=S, target_entity_id=S, relation=S, sentiment=S, confidence=D, evidence_quote=S, evidence_timestamp_seconds=I, session_id=S, video_id=S, agenda_item_index=I, speech_block_index=I, sentence_index=I, source=S, source_ref=S),
    "order_papers": _f(order_paper_id=S, session_title=S, session_date=T.DateType(), sitting_number=S, chamber=S, source_url=S, source_type=S, raw_content=S, created_at=TS, updated_at=TS),
}
#: What a session owns: its rows go when it goes. Edges are kept, their session is cleared.
OWNED, CLEARED = ["videos", "agenda_items", "transcript_sentences", "mentions"], ["relationships"]
#: Tables partitioned by session, in the order in which they are stored.
BY_SESSION = ["videos", "agenda_items", "transcript_sentences", "mentions", "relationships", "sessions"]


def create_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> None:
    """Empty tables with their schemas; existing ones are replaced."""
    for name in names or list(SCHEMAS):
        out = spark.createDataFrame([], SCHEMAS[name]).write.mode("overwrite")
        (out.partitionBy("session_id") if name in BY_SESSION else out).parquet(f"{folder}/{name}")


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of ``new`` whose key ``old`` lacks; null keys are never inserted, repeated ones once (first created_at)."""
    fresh = new.filter(F.col(key).isNotNull()).join(old.select(key), key, "left_anti")
    rest = [c for c in fresh.columns if c != key]
    return fresh.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("created_at", F.xxhash64(*rest))).alias("r")).select(key, "r.*")


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``df`` less the rows whose ``key`` is in ``gone``; null keys stay."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def cleared(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``df`` with ``key`` set to null where it is in ``gone``."""
    mark = gone.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_gone", F.lit(True))
    return df.join(mark, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone").select(df.columns)


def delete_sessions(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All ``tables`` after the sessions of ``gone`` (session_id) are deleted with what they own."""
    out = {}
    for name, df in tables.items():
        if name == "sessions" or name in OWNED:
            out[name] = without(df, gone, "session_id")
        elif name in CLEARED:
            out[name] = cleared(df, gone, "session_id")
        else:
            out[name] = df
    return out


def updated(df: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``df`` with the non-null columns of ``values`` (one row per key) taken over."""
    new = values.select(key, *[F.col(c).alias(f"_{c}") for c in values.columns if c != key])
    j = df.join(new, key, "left")
    return j.select(*[F.coalesce(f"_{c}", c).alias(c) if c in values.columns and c != key else F.col(c) for c in df.columns])


def write_sessions(df: DataFrame, path: str) -> None:
    """Write by session; a session written again replaces its own partition only, so a re-run changes nothing else."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)


def by_age(df: DataFrame, key: str) -> DataFrame:
    """``df`` in order of creation; equal times by key, rows without time first."""
    return df.orderBy("created_at", key)


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """``df`` with ``batch``: consecutive runs of ``size`` rows in order of ``key`` (unique), the last one shorter.

    The order is made by ranges: positions are counted inside a range and moved on by the sizes of the ranges before it,
    one row each, so no task holds the table.
    """
    n = max(1, df.sparkSession.sparkContext.defaultParallelism)
    ranged = cut(df.repartitionByRange(4 * n, key).withColumn("_p", F.spark_partition_id()))
    before = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    # one row a range
    before = before.select("_p", F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(key))).join(before, "_p")
    return placed.withColumn("batch", F.floor((F.col("_before") + F.col("_k") - 1) / size)).drop("_p", "_k", "_before")


def backfill(df: DataFrame, column: str, made, limit: int | None = None) -> DataFrame:
    """The rows whose ``column`` is null, at most ``limit``, with it made by ``made`` (DataFrame to DataFrame): run again to go on."""
    todo = df.filter(F.col(column).isNull())
    return made(todo.limit(limit) if limit else todo)


def backfill_report(df: DataFrame, done: str, batch: int) -> DataFrame:
    """(total, done, missing, success_percent, batches) of a column's backfill."""
    n, m = F.count("*"), F.count(done)
    return df.agg(n.alias("total"), m.alias("done"), (n - m).alias("missing"), F.coalesce(F.round(100 * m / F.nullif(n, F.lit(0)), 1), F.lit(0.0)).alias("success_percent"), F.ceil((n - m) / batch).cast("bigint").alias("batches"))
