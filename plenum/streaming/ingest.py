"""Structured Streaming: sessions ingested as they arrive, usage counted in event time.

A batch of sessions becomes rows of all tables: videos, speakers, agenda items, sentences, entities, mentions and
relationships, and last the sessions themselves, whose presence says that the rest is there. Every micro-batch is
idempotent: sessions that are stored are skipped (or, forced, deleted with all they own first), ids are hashes of natural
keys, so a batch run again after a failure writes the same rows.

Tables that a session owns are partitioned by it. Speakers and entities belong to no session: their next state is written
beside the present one and takes its place by a rename. Sessions without id are left out; null texts give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plenum.functions.text import agenda_item_id, normalize_name, time_to_seconds
from plenum.operators import graph, nested, speakers, store, transcript
from plenum.operators.dedup import unique_edges
from plenum.runtime import cut
from plenum.settings import Settings
from plenum.sources import providers

COUNTED = ["sessions", "videos", "agenda_items", "transcript_sentences", "speakers_created", "speakers_matched", "entities", "mentions", "relationships"]


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def replace_table(df: DataFrame, path: str) -> None:
    """Write the next state of a small table beside the present one, then put it in its place."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.next")
    (old, fs), (new, _) = _files(spark, path), _files(spark, f"{path}.next")
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"could not put {path}.next in the place of {path}")


def drop_sessions(spark: SparkSession, target: str, ids: DataFrame) -> None:
    """Delete all that the sessions of ``ids`` (session_id) own: their partition of every table. The ids are those of one batch."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for row in ids.filter("session_id IS NOT NULL").distinct().toLocalIterator():
        # the session itself goes first: what is half deleted counts as not stored
        for table in reversed(store.BY_SESSION):
            path, fs = _files(spark, f"{target}/{table}/session_id={escape(row[0])}")
            fs.delete(path, True)


def flat_sentences(fresh: DataFrame) -> DataFrame:
    """The sentences of ``fresh`` sessions in the columns of the transcript operators; ids are hashes of session and place."""
    n = nested.transcript_tables(fresh)
    at = lambda c, i: F.get(F.split(c, r"\."), F.lit(i)).cast("int")
    blocks = n["speech_blocks"].select("record_id", F.col("node_path").alias("parent_path"), F.col("speaker_name").alias("speaker_name_original"))
    items = n["agenda_items"].select("record_id", F.col("node_path").alias("_item"), "topic_title")
    df = n["sentences"].join(blocks, ["record_id", "parent_path"], "left").withColumn("_item", F.get(F.split("node_path", r"\."), F.lit(0))).join(items, ["record_id", "_item"], "left")
    video = fresh.select(F.col("session_id").alias("record_id"), "video_id") if "video_id" in fresh.columns else fresh.select(F.col("session_id").alias("record_id"), F.lit(None).cast("string").alias("video_id"))
    return df.join(video, "record_id", "left").select(
        F.left(F.sha2(F.concat_ws("|", "record_id", "node_path"), 256), F.lit(20)).alias("sentence_id"), F.col("record_id").alias("session_id"), "video_id", at("node_path", 0).alias("agenda_item_index"), at("node_path", 1).alias("speech_block_index"),
        at("node_path", 2).alias("sentence_index"), "speaker_name_original", "topic_title", F.col("text").alias("full_text"), time_to_seconds(F.col("start_time")).alias("timestamp_seconds"))


def tables_of(fresh: DataFrame, registry: DataFrame, entities: DataFrame, terms: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """What ``fresh`` sessions add: a frame for each table, ``speakers`` and ``entities`` as they are afterwards.

    ``terms`` is the dictionary of the default extraction (entity_id, entity_type, name).
    """
    flat = cut(flat_sentences(fresh))
    placed = cut(transcript.numbered(flat))
    facts = ["title", "role", "party"]
    listed = transcript.first_seen(flat).select("session_id", F.col("speaker_name_original").alias("name"), F.lit(None).cast("string").alias("role"))
    met = cut(speakers.resolved(listed, registry, settings.speaker_threshold))
    about = fresh.select("session_id", "chamber", F.col("created_at").alias("at"))
    seen = met.join(about, "session_id").withColumns({f: F.lit(None).cast("string") for f in facts if f not in met.columns})
    who = met.select("session_id", F.col("name").alias("speaker_name_original"), F.col("canonical_id").alias("speaker_id"))
    spoken = flat.join(who, ["session_id", "speaker_name_original"], "left")
    find = lambda members: providers.dictionary_entities(members, terms).select(*graph.ITEM, "chunk_index", "local_index", "entity_id", "entity_type", "name")
    kg = graph.extracted(placed, find, providers.cooccurrence, settings.chunk_size, settings.chunk_overlap)
    step = settings.chunk_size - settings.chunk_overlap
    found = cut(kg["found"])
    mentions = graph.mentions(found, placed, step).join(who.withColumnRenamed("speaker_name_original", "speaker"), ["session_id", "speaker"], "left").drop("speaker", "sentence_id")
    edges = graph.evidence(kg["relations"], placed, step).withColumnsRenamed({"source_id": "source_entity_id", "target_id": "target_entity_id", "relation_type": "relation"})
    keys = ["source_entity_id", "target_entity_id", "relation", "session_id"]
    edges = unique_edges(edges, keys, "confidence", "sentence_id").withColumn("relationship_id", F.left(F.sha2(F.concat_ws("|", *keys), 256), F.lit(16))).withColumn("source_ref", F.concat(F.lit("chunk_"), F.col("chunk_index").cast("string")))
    # first seen wins; what an edge names and no table has becomes a bare node
    named = graph.with_defaults(found.groupBy("entity_id").agg(F.min_by(F.struct("name", "entity_type"), F.struct("session_id", "chunk_index", "local_index")).alias("f")).select("entity_id", "f.*").withColumns({"aliases": F.lit(None).cast("array<string>"), "description": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")}))
    bare = graph.ensure_nodes(edges.select(F.col("source_entity_id").alias("source_id"), F.col("target_entity_id").alias("target_id")), entities.select("entity_id").unionByName(named.select("entity_id")))
    new = named.withColumn("canonical_name", F.col("name")).unionByName(bare.withColumn("canonical_name", F.col("name")), allowMissingColumns=True)
    new = new.join(entities.select("entity_id"), "entity_id", "left_anti").withColumn("source", F.lit("extraction"))
    video = fresh.filter("video_id IS NOT NULL").select("session_id", "video_id", F.col("video_id").alias("id"), F.lit("youtube").alias("platform"), "created_at") if "video_id" in fresh.columns else None
    items = nested.transcript_tables(fresh)["agenda_items"].select(F.col("record_id").alias("session_id"), F.col("position").alias("agenda_index"), F.col("topic_title").alias("title")).withColumn("agenda_item_id", agenda_item_id(F.col("session_id"), F.col("agenda_index")))
    rows = {
        "videos": video, "agenda_items": items, "mentions": mentions, "relationships": edges, "sessions": fresh.withColumn("date", F.col("session_date")),
        "transcript_sentences": spoken.withColumn("speaker_name_normalized", normalize_name(F.col("speaker_name_original"))),
    }
    out = {n: _shaped(df, n) for n, df in rows.items() if df is not None}
    out["speakers"] = speakers.registry_after(registry, seen)
    out["entities"] = entities.unionByName(_shaped(new, "entities"))
    out["met"], out["new_entities"] = met, new
    return out


def _shaped(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the stored table's columns and types; what it lacks is null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in store.SCHEMAS[name].fields])


def ingest_batch(batch: DataFrame, target: str, force: bool = False, terms: DataFrame | None = None, settings: Settings | None = None) -> dict[str, int]:
    """Store the sessions of ``batch`` (session_id, session_date, title, sitting_number, chamber, raw_transcript_json, created_at, perhaps video_id)
    and all that their transcripts say below ``target``; returns how many rows each step made.
    """
    spark, settings = batch.sparkSession, settings or Settings.read()
    if terms is None:
        terms = spark.createDataFrame([], "entity_id string, entity_type string, name string")
    old = _stored(spark, f"{target}/sessions", store.SCHEMAS["sessions"]).select("session_id")
    if force:
        drop_sessions(spark, target, batch.select("session_id").join(old, "session_id", "left_semi"))
        old = old.limit(0)
    fresh = cut(store.insert_absent(old, batch, "session_id"))
    registry = cut(_stored(spark, f"{target}/speakers", store.SCHEMAS["speakers"]))
    entities = cut(_stored(spark, f"{target}/entities", store.SCHEMAS["entities"]))
    made = tables_of(fresh, registry, entities, terms, settings)
    counts = dict.fromkeys(COUNTED, 0)
    for name in ("speakers", "entities"):
        replace_table(made[name], f"{target}/{name}")
    for name in store.BY_SESSION:
        if name in made:
            rows = cut(made[name])
            store.write_sessions(rows, f"{target}/{name}")
            counts[name] = rows.count()
    known = registry.select("canonical_id").distinct()
    people = made["met"].select("canonical_id").filter("canonical_id IS NOT NULL").distinct()
    counts["speakers_matched"] = people.join(known, "canonical_id", "left_semi").count()
    counts["speakers_created"] = people.join(known, "canonical_id", "left_anti").count()
    counts["entities"] = made["new_entities"].count()
    return counts


def ingest_sessions(spark: SparkSession, source: str, schema, target: str, checkpoint: str, force: bool = False, terms: DataFrame | None = None) -> StreamingQuery:
    """Ingest what lies in folder ``source`` (Parquet) and was not ingested yet, then stop; ``checkpoint`` remembers the files."""
    stream = spark.readStream.schema(schema).parquet(source)

    def one(df: DataFrame, _: int) -> None:
        ingest_batch(df, target, force, terms)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_windows(events: DataFrame, time: str, stage: str, value: str, size: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Calls and their total per stage and window of event time; rows later than ``late`` behind the newest are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), F.col(stage).alias("stage")).agg(F.count("*").alias("calls"), F.sum(value).alias("total")).select(
        F.col("window.start").alias("window_start"), "stage", "calls", "total")
