"""Transcript algebra: delivered rows made unique, located, assembled, counted and cut into overlapping chunks.

All operators take DataFrames and return DataFrames; the shuffles are by sentence, by block or by agenda item.
Null session ids or indices group together; empty inputs give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions.text import time_to_seconds

#: Sentences of a chunk, and of two neighbouring chunks in common.
CHUNK, OVERLAP = 7, 2


def unique_rows(df: DataFrame, key: str, keep: str = "first") -> DataFrame:
    """One row per ``key``: the first or last delivered (created_at); rows without key are dropped."""
    pick = F.min_by if keep == "first" else F.max_by
    rest = [c for c in df.columns if c != key]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(pick(F.struct(*rest), F.struct("created_at", F.xxhash64(*[c for c in rest if c != "created_at"]))).alias("r")).select(key, "r.*")


def sentences(raw: DataFrame, blocks: DataFrame) -> DataFrame:
    """The flat sentence table: every sentence once, with its speaker's label and its second."""
    label = unique_rows(blocks, "block_id", "last").select("block_id", F.col("speaker_name").alias("speaker_name_original"), "topic_title")
    once = unique_rows(raw, "sentence_id")
    return once.join(label, "block_id", "left").select(
        "sentence_id", "session_id", "video_id", "agenda_item_index", "speech_block_index", "sentence_index", "speaker_name_original", "topic_title",
        F.col("text").alias("full_text"), time_to_seconds(F.col("start_time")).alias("timestamp_seconds"))


def block_text(flat: DataFrame) -> DataFrame:
    """Text of each speech block: its sentences in order, joined by a blank."""
    keys = ["session_id", "agenda_item_index", "speech_block_index"]
    place = F.struct("sentence_index", "sentence_id", F.coalesce("full_text", F.lit("")).alias("t"))
    return flat.groupBy(*keys).agg(F.min("speaker_name_original").alias("speaker_name"), F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["t"]), " ").alias("block_text"), F.count("*").alias("n_sentences"))


def agenda_text(flat: DataFrame) -> DataFrame:
    """Text of each agenda item: ``speaker: text`` of its blocks in order, joined by an empty line."""
    made = block_text(flat).withColumn("said", F.concat(F.coalesce("speaker_name", F.lit("")), F.lit(": "), "block_text"))
    return made.groupBy("session_id", "agenda_item_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("speech_block_index", "said"))), lambda x: x["said"]), "\n\n").alias("agenda_text"))


def numbered(flat: DataFrame) -> DataFrame:
    """``flat`` with ``flat_index``, the 0-based place of a sentence in its agenda item."""
    order = Window.partitionBy("session_id", "agenda_item_index").orderBy("speech_block_index", "sentence_index", "sentence_id")
    return flat.withColumn("flat_index", F.row_number().over(order) - 1)


def chunk_members(placed: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Every sentence once for each chunk that holds it, with ``chunk_index`` and ``local_index``; the tail chunk always stands."""
    step = size - overlap
    first = F.greatest(F.lit(0), F.ceil((F.col("flat_index") - (size - 1)) / step)).cast("int")
    last = F.floor(F.col("flat_index") / step).cast("int")
    return placed.withColumn("chunk_index", F.explode(F.sequence(first, last))).withColumn("local_index", F.col("flat_index") - F.col("chunk_index") * step)


def chunks(placed: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per chunk: its sentences, text, distinct speakers in order of name, and the previous chunk's speakers."""
    keys = ["session_id", "agenda_item_index", "chunk_index"]
    made = chunk_members(placed, size, overlap).groupBy(*keys).agg(
        F.count("*").alias("n_sentences"), F.sort_array(F.collect_set("speaker_name_original")).alias("speakers"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("local_index", F.coalesce("full_text", F.lit("")).alias("t")))), lambda x: x["t"]), " ").alias("chunk_text"))
    before = F.lag(F.array_join("speakers", ", ")).over(Window.partitionBy("session_id", "agenda_item_index").orderBy("chunk_index"))
    return made.withColumn("context_speakers", F.coalesce(before, F.lit("")))


def recent_entities(found: DataFrame, keep: int = 10) -> DataFrame:
    """For each chunk with entities, the last ``keep`` that earlier chunks of its agenda item gave, oldest first.

    ``found``: keys, chunk_index, local_index, entity_id. A chunk gives an entity once, where it is first named; what two
    chunks give stands twice. Each chunk hands on its last ``keep`` only, so nothing grows with the agenda item.
    """
    keys = ["session_id", "agenda_item_index"]
    once = found.groupBy(*keys, "chunk_index", "entity_id").agg(F.min("local_index").alias("at"))
    late = Window.partitionBy(*keys, "chunk_index").orderBy(F.desc("at"), F.desc("entity_id"))
    tail = once.withColumn("_r", -F.row_number().over(late)).filter(F.col("_r") >= -keep)
    per = tail.groupBy(*keys, "chunk_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "entity_id"))), lambda x: x["entity_id"]).alias("es"))
    before = Window.partitionBy(*keys).orderBy("chunk_index").rowsBetween(-keep, -1)
    gathered = F.slice(F.reverse(F.flatten(F.collect_list("es").over(before))), 1, keep)
    return per.select(*keys, "chunk_index", F.array_join(F.reverse(gathered), ",").alias("recent"))


def timeline(flat: DataFrame, sessions: DataFrame) -> DataFrame:
    """What each speaker label said: newest session first, then by second; ``place`` numbers it.

    Places are counted inside (label, session) and moved on by the sessions before, so a label is never one task's window.
    """
    s = unique_rows(sessions, "session_id").select("session_id", "session_date", "sitting_number")
    said = flat.filter("speaker_name_original IS NOT NULL").join(s, "session_id")
    inside = Window.partitionBy("speaker_name_original", "session_date", "session_id").orderBy(F.asc_nulls_last("timestamp_seconds"), "sentence_id")
    part = said.withColumn("_k", F.row_number().over(inside))
    counts = said.groupBy("speaker_name_original", "session_date", "session_id").agg(F.count("*").alias("_n"))
    newest = Window.partitionBy("speaker_name_original").orderBy(F.desc("session_date"), "session_id")
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("speaker_name_original", "session_id", "_before")
    return part.join(before, ["speaker_name_original", "session_id"]).select(
        "speaker_name_original", "session_date", "sitting_number", "timestamp_seconds", "sentence_id", "full_text", (F.col("_before") + F.col("_k")).cast("int").alias("place"))


def first_seen(flat: DataFrame) -> DataFrame:
    """(session_id, speaker_name_original, sentence_id): each label of a session and the sentence where it first stands, in order of speech."""
    place = F.struct("agenda_item_index", "speech_block_index", "sentence_index", "sentence_id")
    return flat.filter("speaker_name_original IS NOT NULL").groupBy("session_id", "speaker_name_original").agg(F.min_by("sentence_id", place).alias("sentence_id"))


def coverage(flat: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many sentences have text to search and how many have none, in all or by ``by``."""
    has = F.length(F.trim(F.coalesce("full_text", F.lit("")))) > 0
    aggs = [F.count(F.when(has, 1)).alias("with_text"), F.count(F.when(~has, 1)).alias("without_text")]
    return flat.groupBy(*by).agg(*aggs) if by else flat.agg(*aggs)


def snapshot(flat: DataFrame) -> DataFrame:
    """Each session as one nested JSON document again: agenda items, speech blocks, sentences in order."""
    s = F.struct(F.col("sentence_index").alias("i"), F.col("timestamp_seconds").alias("start_second"), F.col("full_text").alias("text"))
    b = flat.groupBy("session_id", "agenda_item_index", "speech_block_index").agg(F.min("speaker_name_original").alias("speaker_name"), F.min("topic_title").alias("topic_title"), F.array_sort(F.collect_list(s)).alias("sentences"))
    a = b.groupBy("session_id", "agenda_item_index").agg(F.min("topic_title").alias("topic_title"), F.array_sort(F.collect_list(F.struct("speech_block_index", "speaker_name", "sentences"))).alias("speech_blocks"))
    d = a.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("agenda_item_index", "topic_title", "speech_blocks"))).alias("agenda_items"))
    return d.select("session_id", F.to_json(F.struct("agenda_items"), {"ignoreNullFields": "false"}).alias("document"))
