"""Knowledge graph from transcripts: extraction through providers, validation, location, edges and nodes.

Providers see one chunk at a time (``plenum.sources.providers``); everything around them is joins. Sentence numbers that
a provider returns are local to its chunk; ``located`` leads them to (block, sentence in block).

Defined results: mentions and edges whose sentence does not exist, whose endpoints are unknown or whose type, sentiment
or confidence is out of range do not survive (``rejected`` says why); null ids never match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.operators import transcript
from plenum.operators.transcript import CHUNK, OVERLAP

#: What the schemas allow.
ENTITY_TYPES = ["person", "organization", "place", "law", "concept", "event", "agenda_item", "procedural_step", "numeric_fact", "policy_position"]
RELATIONS = ["mentions", "supports", "opposes", "relates_to", "references", "introduces", "sponsors", "questions", "answers", "rebuts", "chairs", "speaks_on", "states"]
SENTIMENTS = ["positive", "negative", "neutral"]

ITEM = ["session_id", "agenda_item_index"]


def located(found: DataFrame, placed: DataFrame, step: int = CHUNK - OVERLAP) -> DataFrame:
    """``found`` (chunk_index, local_index, ...) with the place of its sentence; without such a sentence a row is dropped.

    The flat index of a sentence is chunk_index * step + local_index; ``sentence_index`` counts inside the block.
    """
    at = found.withColumn("flat_index", (F.col("chunk_index") * step + F.col("local_index")).cast("int"))
    places = placed.select(*ITEM, "flat_index", "speech_block_index", "sentence_index", "sentence_id", "video_id", "timestamp_seconds", "speaker_name_original", "full_text")
    return at.join(places, [*ITEM, "flat_index"])


def mentions(found: DataFrame, placed: DataFrame, step: int = CHUNK - OVERLAP) -> DataFrame:
    """One direct mention per entity and sentence, however many chunks saw it; the context is the sentence's first 200 letters."""
    at = located(found, placed, step).groupBy("entity_id", "sentence_id").agg(F.min(F.struct(*ITEM, "speech_block_index", "sentence_index", "video_id", "timestamp_seconds", F.left("full_text", F.lit(200)).alias("context"), F.col("speaker_name_original").alias("speaker"))).alias("m"))
    return at.select(F.left(F.sha2(F.concat_ws("|", "entity_id", F.col("sentence_id").cast("string")), 256), F.lit(16)).alias("mention_id"), "entity_id", "sentence_id", "m.*", F.lit("direct").alias("mention_type"))


def rejected(relations: DataFrame, chunk_entities: DataFrame, chunk_speakers: DataFrame) -> DataFrame:
    """``relations`` with ``reason``: null for a valid one, else the first rule it breaks.

    A source must be an entity or a speaker of the chunk, a target an entity of the chunk.
    """
    keys = [*ITEM, "chunk_index"]
    ents = chunk_entities.select(*keys, "entity_id").distinct()
    who = chunk_speakers.select(*keys, F.explode("speakers").alias("entity_id")).unionByName(ents).distinct()
    df = relations.join(who.withColumnRenamed("entity_id", "source_id").withColumn("_s", F.lit(True)), [*keys, "source_id"], "left")
    df = df.join(ents.withColumnRenamed("entity_id", "target_id").withColumn("_t", F.lit(True)), [*keys, "target_id"], "left")
    reason = F.when(F.col("_s").isNull(), "unknown source").when(F.col("_t").isNull(), "unknown target").when(~F.col("relation_type").isin(RELATIONS), "relation type")
    reason = reason.when(~F.col("sentiment").isin(SENTIMENTS), "sentiment").when(~F.coalesce(F.col("confidence"), F.lit(0.5)).between(0, 1), "confidence")
    return df.withColumn("reason", reason).drop("_s", "_t")


def invalid_entities(entities: DataFrame) -> DataFrame:
    """(entity_id, reason) of stored entities that break the schema: missing name, unknown type, confidence or importance out of range."""
    sound = lambda c: F.col(c).isNull() | (~F.isnan(c) & F.col(c).between(0, 1))
    reason = F.when(F.coalesce(F.trim("canonical_name"), F.lit("")) == "", "canonical_name").when(~F.coalesce(F.col("entity_type"), F.lit("")).isin(ENTITY_TYPES), "entity_type")
    reason = reason.when(~sound("confidence"), "confidence").when(~sound("importance_score"), "importance_score")
    return entities.select("entity_id", reason.alias("reason")).filter("reason IS NOT NULL")


def ensure_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes that edges name and ``nodes`` lacks: type unknown, named by their id."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("entity_id")).filter("entity_id IS NOT NULL").distinct()
    return ends.join(nodes.select("entity_id"), "entity_id", "left_anti").select("entity_id", F.col("entity_id").alias("name"), F.lit("unknown").alias("entity_type"))


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Get or create: an existing entity keeps its facts, of new ones the first seen counts; aliases are united."""
    cols = ["entity_id", "canonical_name", "entity_type"]
    every = old.select(*cols, "aliases", F.lit(0).alias("seen")).unionByName(new.select(*cols, "aliases", "seen"))
    facts = every.filter("entity_id IS NOT NULL").groupBy("entity_id").agg(F.min_by(F.struct("canonical_name", "entity_type"), F.struct("seen", "canonical_name")).alias("f"), F.min("seen").alias("first_seen"))
    names = every.select("entity_id", F.explode("aliases").alias("a")).filter("a IS NOT NULL").groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_set("a")), "|").alias("aliases"))
    return facts.join(names, "entity_id", "left").select("entity_id", "f.*", (F.col("first_seen") > 0).alias("created"), F.coalesce("aliases", F.lit("")).alias("aliases"))


def with_defaults(found: DataFrame) -> DataFrame:
    """Extracted entities with what a provider left out: confidence 0.5, no aliases, an empty description."""
    none = F.array().cast("array<string>")
    fill = {"confidence": F.coalesce("confidence", F.lit(0.5)), "aliases": F.coalesce("aliases", none), "description": F.coalesce("description", F.lit(""))}
    return found.withColumns({c: v for c, v in fill.items() if c in found.columns})


def extracted(placed: DataFrame, find: Callable[[DataFrame], DataFrame], relate: Callable[[DataFrame], DataFrame], size: int = CHUNK, overlap: int = OVERLAP) -> dict[str, DataFrame]:
    """All agenda items chunk by chunk: ``chunks`` with the speakers and entities before them, ``found`` entities, ``relations`` that keep the rules.

    ``find`` takes chunk members and names their entities (chunk_index, local_index, entity_id, ...), ``relate`` takes what was
    found. Chunks do not wait for each other: what earlier ones gave reaches a chunk as the column ``recent``.
    """
    keys = [*ITEM, "chunk_index"]
    found = find(transcript.chunk_members(placed, size, overlap))
    chunks = transcript.chunks(placed, size, overlap).join(transcript.recent_entities(found), keys, "left").withColumn("recent", F.coalesce("recent", F.lit("")))
    judged = rejected(relate(found), found.select(*keys, "entity_id").distinct(), chunks.select(*keys, "speakers"))
    return {"chunks": chunks, "found": found, "relations": judged.filter("reason IS NULL").drop("reason")}


def evidence(relations: DataFrame, placed: DataFrame, step: int = CHUNK - OVERLAP) -> DataFrame:
    """Relations with the sentence that shows them: place, second, and its text as the quote where a provider gave none."""
    at = located(relations, placed, step)
    quote = F.coalesce(F.col("evidence_quote"), F.col("full_text")) if "evidence_quote" in at.columns else F.col("full_text")
    return at.withColumn("evidence_quote", quote).withColumnRenamed("timestamp_seconds", "evidence_timestamp_seconds").withColumn("source", F.lit("extraction"))


def provenance(edges: DataFrame, session: str | None = None, video: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """The edges shown in a session, a video and between two seconds (each null: all), in order of session, video and second.

    Edges without a second are in no range of seconds and stand last in their video.
    """
    df = edges
    for column, value in (("session_id", session), ("video_id", video)):
        df = df if value is None else df.filter(F.col(column) == value)
    second = F.col("evidence_timestamp_seconds")
    df = df if first is None else df.filter(second >= first)
    df = df if last is None else df.filter(second <= last)
    return df.orderBy("session_id", "video_id", F.asc_nulls_last("evidence_timestamp_seconds"), "source_id", "target_id")
