"""Queries of the core operators over whole tables. ``oracles.py`` holds the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plenum.functions import prompts, similarity, text
from plenum.operators import dedup, graph, nested, searching, speakers, store, transcript, usage
from plenum.plans.oracles import DICTIONARY, EXISTING_BEFORE, FIRST_SECOND, GONE_DIGIT, KEYWORDS, LAST_SECOND, LIKE, MERGED_TERMS
from plenum.runtime import cut, table
from plenum.settings import Settings
from plenum.sources import html, providers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _flat(spark: SparkSession, base: str) -> DataFrame:
    return transcript.sentences(table(spark, base, "transcript_sentences"), table(spark, base, "speech_blocks"))


def _placed(spark: SparkSession, base: str) -> DataFrame:
    return transcript.numbered(_flat(spark, base))


# nested records ---------------------------------------------------------------------------------------------------------


@query
def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return nested.node_index(table(spark, base, "sessions"), table(spark, base, "order_papers"))


@query
def p5_agenda_items(spark: SparkSession, base: str) -> DataFrame:
    return nested.transcript_tables(table(spark, base, "sessions"))["agenda_items"]


@query
def p5_speech_blocks(spark: SparkSession, base: str) -> DataFrame:
    return nested.transcript_tables(table(spark, base, "sessions"))["speech_blocks"]


@query
def p5_sentences(spark: SparkSession, base: str) -> DataFrame:
    return nested.transcript_tables(table(spark, base, "sessions"))["sentences"]


@query
def p5_paper_speakers(spark: SparkSession, base: str) -> DataFrame:
    return nested.paper_tables(table(spark, base, "order_papers"))["paper_speakers"]


@query
def p5_paper_items(spark: SparkSession, base: str) -> DataFrame:
    return nested.paper_tables(table(spark, base, "order_papers"))["paper_items"]


# transcripts ------------------------------------------------------------------------------------------------------------


@query
def reconstruct_transcript(spark: SparkSession, base: str) -> DataFrame:
    cols = ["session_id", "agenda_item_index", "speech_block_index", "sentence_index", "sentence_id", "speaker_name_original", "full_text", "timestamp_seconds"]
    return _flat(spark, base).select(*cols).orderBy(*cols[:5])


@query
def speaker_timeline(spark: SparkSession, base: str) -> DataFrame:
    return transcript.timeline(_flat(spark, base), table(spark, base, "sessions"))


@query
def block_full_text(spark: SparkSession, base: str) -> DataFrame:
    return transcript.block_text(_flat(spark, base))


@query
def agenda_full_text(spark: SparkSession, base: str) -> DataFrame:
    return transcript.agenda_text(_flat(spark, base))


@query
def sentence_counts(spark: SparkSession, base: str) -> DataFrame:
    """Sentences, blocks, agenda items and speaker labels of each session."""
    return _flat(spark, base).groupBy("session_id").agg(
        F.count("*").alias("n_sentences"), F.countDistinct("agenda_item_index", "speech_block_index").alias("n_blocks"),
        F.countDistinct("agenda_item_index").alias("n_items"), F.countDistinct("speaker_name_original").alias("n_labels"))


@query
def session_snapshot(spark: SparkSession, base: str) -> DataFrame:
    return transcript.snapshot(_flat(spark, base))


@query
def chunk_windows(spark: SparkSession, base: str) -> DataFrame:
    return transcript.chunk_members(_placed(spark, base)).select("session_id", "agenda_item_index", "chunk_index", "local_index", "flat_index", "sentence_id")


@query
def chunk_context_lag(spark: SparkSession, base: str) -> DataFrame:
    """Chunks with their speakers and those of the chunk before."""
    df = transcript.chunks(_placed(spark, base))
    return df.select("session_id", "agenda_item_index", "chunk_index", "n_sentences", F.array_join("speakers", ", ").alias("speakers"), "context_speakers")


@query
def embedding_coverage(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "entities")
    return e.agg(F.count("embedding").alias("with_embedding"), F.count(F.when(F.col("embedding").isNull(), 1)).alias("without_embedding"))


@query
def coverage_by_session(spark: SparkSession, base: str) -> DataFrame:
    s = store.insert_absent(table(spark, base, "sessions").limit(0), table(spark, base, "sessions"), "session_id")
    per = transcript.coverage(_flat(spark, base), ["session_id"])
    return s.select("session_id", "session_date").join(per, "session_id").orderBy(F.desc("session_date"), "session_id")


@query
def backfill_report(spark: SparkSession, base: str) -> DataFrame:
    return store.backfill_report(table(spark, base, "entities"), "embedding", 100)


@query
def embedding_backfill(spark: SparkSession, base: str) -> DataFrame:
    """Vectors for the entities that have none, made from name and description by the offline provider."""
    said = F.concat(F.coalesce("canonical_name", F.lit("")), F.lit(" - "), F.coalesce("description", F.lit("")))
    e = table(spark, base, "entities").select("entity_id", "embedding", said.alias("embedding_text"))
    return store.backfill(e, "embedding", lambda d: providers.embed(d, "embedding_text")).select("entity_id", "embedding_text", F.size("embedding").alias("dimensions"))


# functions --------------------------------------------------------------------------------------------------------------


@query
def time_to_seconds(spark: SparkSession, base: str) -> DataFrame:
    t = table(spark, base, "transcript_sentences").select("start_time").distinct()
    return t.withColumn("seconds", text.time_to_seconds(F.col("start_time")))


@query
def seconds_to_time(spark: SparkSession, base: str) -> DataFrame:
    s = _flat(spark, base).filter("timestamp_seconds IS NOT NULL").select(F.col("timestamp_seconds").alias("seconds")).distinct()
    return s.withColumn("spelt", text.seconds_to_time(F.col("seconds")))


@query
def record_ids(spark: SparkSession, base: str) -> DataFrame:
    """Ids built from their parts, for sessions and order papers."""
    s = table(spark, base, "sessions").select(F.lit("session").alias("kind"), text.session_id(F.col("sitting_number"), F.col("session_date")).alias("built_id"))
    p = table(spark, base, "order_papers").select(F.lit("order_paper").alias("kind"), text.order_paper_id(F.col("chamber"), F.col("session_date")).alias("built_id"))
    a = table(spark, base, "speech_blocks").select(F.lit("agenda_item").alias("kind"), text.agenda_item_id(F.col("session_id"), F.col("agenda_item_index")).alias("built_id"))
    return s.unionByName(p).unionByName(a).groupBy("kind", "built_id").agg(F.count("*").alias("n"))


@query
def name_normalize(spark: SparkSession, base: str) -> DataFrame:
    n = table(spark, base, "speakers").select("name").unionByName(table(spark, base, "speech_blocks").select(F.col("speaker_name").alias("name"))).filter("name IS NOT NULL").distinct()
    return n.select("name", text.normalize_name(F.col("name")).alias("normalized"), text.normalize_name(F.col("name"), "word").alias("by_word"), text.surname(F.col("name")).alias("surname"), text.canonical_speaker_id(F.col("name")).alias("speaker_slug"))


@query
def fuzzy_ratio_pairs(spark: SparkSession, base: str) -> DataFrame:
    """The fuzzy ratio of every entity's two names."""
    e = table(spark, base, "entities").select("entity_id", F.lower("name").alias("a"), F.lower("canonical_name").alias("b"))
    return e.select("entity_id", similarity.fuzzy_ratio(F.col("a"), F.col("b")).alias("ratio"))


@query
def date_parse(spark: SparkSession, base: str) -> DataFrame:
    """Session dates written in three notations, and something that is no date, read again."""
    d = table(spark, base, "sessions").select("session_id", "session_date").distinct()
    spelt = F.array(F.date_format("session_date", "yyyy-MM-dd"), F.date_format("session_date", "d MMMM yyyy"), F.date_format("session_date", "MMMM d, yyyy"), F.lit("no date"))
    return d.select("session_id", F.posexplode(spelt).alias("notation", "spelt")).select("session_id", "notation", text.parse_date(F.col("spelt")).alias("iso_date"))


@query
def url_video_id(spark: SparkSession, base: str) -> DataFrame:
    v = table(spark, base, "transcript_sentences").select("video_id").filter("video_id IS NOT NULL").distinct()
    urls = F.array(F.concat(F.lit("https://example.invalid/watch?v="), "video_id", F.lit("&t=3s")), F.concat(F.lit("https://youtu.be/"), "video_id", F.lit("?t=3")), F.concat(F.lit("https://example.invalid/"), "video_id"))
    return v.select("video_id", F.posexplode(urls).alias("form", "url")).select("video_id", "form", text.video_id(F.col("url")).alias("found_id"))


@query
def filename_sanitize(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "order_papers")
    return p.select("order_paper_id", text.sanitize_filename(F.concat_ws("|", "session_title", "source_url")).alias("filename"))


@query
def segment_ids(spark: SparkSession, base: str) -> DataFrame:
    s = _flat(spark, base)
    order = Window.partitionBy("video_id", F.col("timestamp_seconds").isNull()).orderBy("sentence_id")
    return s.withColumn("k", F.row_number().over(order)).select("sentence_id", text.segment_id(F.col("video_id"), F.col("timestamp_seconds"), F.col("k")).alias("segment_id"))


@query
def truncated_json(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "sessions").select("session_id", "raw_transcript_json").distinct()
    return s.filter("raw_transcript_json IS NOT NULL").select("session_id", text.looks_truncated(F.col("raw_transcript_json")).alias("truncated"))


@query
def fill_if_empty(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "speakers")
    return s.select("canonical_id", text.fill_if_empty(F.col("role"), F.lit("Member")).alias("role"), text.fill_if_empty(F.col("title"), F.col("role")).alias("title"))


@query
def prompt_lines(spark: SparkSession, base: str) -> DataFrame:
    """Each agenda item as the numbered lines that a prompt shows."""
    df = _placed(spark, base)
    line = F.concat(F.lit("["), F.col("flat_index").cast("string"), F.lit("] "), F.coalesce("speaker_name_original", F.lit("")), F.lit(": "), F.coalesce("full_text", F.lit("")))
    return df.groupBy("session_id", "agenda_item_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("flat_index", line.alias("l")))), lambda x: x["l"]), "\n").alias("prompt"))


@query
def prompt_json(spark: SparkSession, base: str) -> DataFrame:
    """Each block as a JSON object of its sentences' texts keyed by sentence id."""
    df = _flat(spark, base)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("sentence_index", "sentence_id", F.coalesce("full_text", F.lit("")).alias("t")))), lambda x: F.struct(x["sentence_id"].cast("string").alias("id"), x["t"].alias("value")))
    return df.groupBy("session_id", "agenda_item_index", "speech_block_index").agg(rows.alias("r")).select("session_id", "agenda_item_index", "speech_block_index", prompts.keyed_json(F.col("r")).alias("prompt"))


@query
def entity_prompts(spark: SparkSession, base: str) -> DataFrame:
    """What an extraction service is asked for each chunk: speakers, those before, entities before, numbered sentences."""
    placed = _placed(spark, base)
    keys = ["session_id", "agenda_item_index", "chunk_index"]
    made = graph.extracted(placed, lambda members: providers.dictionary_entities(members, _terms(spark)), providers.cooccurrence)["chunks"].select(*keys, "speakers", "context_speakers", "recent")
    lines = transcript.chunk_members(placed).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("local_index").alias("index"), F.concat(F.col("timestamp_seconds").cast("string"), F.lit("s")).alias("start_time"), F.col("full_text").alias("text")))).alias("ls"), F.min("topic_title").alias("topic"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    asked = made.join(lines.withColumnsRenamed({k: f"_{k}" for k in keys}), on[0] & on[1] & on[2])
    return asked.select(*keys, prompts.entity_prompt(F.col("topic"), F.col("speakers"), F.col("context_speakers"), F.col("recent"), F.col("ls")).alias("prompt"))


@query
def transcript_requests(spark: SparkSession, base: str) -> DataFrame:
    """The request for each video's first ten minutes at half a frame a second."""
    v = table(spark, base, "transcript_sentences").select("video_id", "session_id").filter("video_id IS NOT NULL").distinct()
    s = transcript.unique_rows(table(spark, base, "sessions"), "session_id").select("session_id", "session_date", "chamber", "sitting_number")
    asked = prompts.transcript_prompt(F.col("session_date"), F.col("chamber"), F.col("sitting_number"), F.array().cast("array<string>"))
    url = F.concat(F.lit("https://example.invalid/watch?v="), "video_id")
    return v.join(s, "session_id").select("video_id", "session_id", prompts.video_request(asked, url, 0.5, None, text.end_second(F.lit(10).cast("bigint")), "low").alias("request"))


@query
def end_seconds(spark: SparkSession, base: str) -> DataFrame:
    """The last second to read of each session when as many minutes are wanted as its sitting number says."""
    s = table(spark, base, "sessions").select("session_id", F.expr("try_cast(sitting_number AS bigint)").alias("minutes")).distinct()
    return s.select("session_id", "minutes", text.end_second(F.col("minutes")).alias("end_second"))


@query
def paper_headers(spark: SparkSession, base: str) -> DataFrame:
    """Order papers' headers written as a service's answer and read back."""
    p = table(spark, base, "order_papers")
    answer = F.to_json(F.struct("session_title", "sitting_number", F.date_format("session_date", "yyyy-MM-dd").alias("session_date")))
    return nested.paper_headers(p.select("order_paper_id", answer.alias("answer")), "order_paper_id", "answer")


@query
def transcript_quarantine(spark: SparkSession, base: str) -> DataFrame:
    """Transcripts that cannot be stored, with the reason."""
    return nested.quarantined(table(spark, base, "sessions"))


@query
def html_links(spark: SparkSession, base: str) -> DataFrame:
    """Order papers written as a web page's table and read back."""
    p = table(spark, base, "order_papers").select("order_paper_id", "session_title", "source_url", "session_date")
    row = F.concat(F.lit('<tr><td><a href="'), F.coalesce("source_url", F.concat(F.lit("/files/"), "order_paper_id")), F.lit('">'), F.coalesce("session_title", F.lit("")), F.lit("</a></td><td> "), F.date_format("session_date", "d MMMM yyyy"), F.lit(" </td></tr>"))
    pages = p.select("order_paper_id", F.concat(F.lit('<html><nav><a href="/">x</a></nav><table class="table table-hover"><tr><th>Paper</th><th>Date</th></tr>'), row, F.lit("<tr><td>no link</td></tr></table></html>")).alias("html"))
    return html.paper_links(pages, "order_paper_id", "html", "https://example.invalid").select("order_paper_id", "title", "pdf_url", "session_date")


# speakers and entities --------------------------------------------------------------------------------------------------


def _labels(spark: SparkSession, base: str) -> DataFrame:
    """Labels of blocks (no role) and aliases of speakers (with their role)."""
    said = table(spark, base, "speech_blocks").select(F.col("speaker_name").alias("name"), F.lit(None).cast("string").alias("role"))
    listed = table(spark, base, "speakers").select(F.explode("aliases").alias("name"), "role")
    return said.unionByName(listed).distinct()


@query
def speaker_match(spark: SparkSession, base: str) -> DataFrame:
    return speakers.match(_labels(spark, base), table(spark, base, "speakers"))


@query
def paper_speaker_match(spark: SparkSession, base: str) -> DataFrame:
    """Speakers of order papers, with their roles, against the registry."""
    listed = nested.paper_tables(table(spark, base, "order_papers"))["paper_speakers"].select("name", "role")
    return speakers.match(cut(listed.distinct()), table(spark, base, "speakers"))


@query
def speaker_registry(spark: SparkSession, base: str) -> DataFrame:
    """The registry after all blocks' labels that match it exactly were met: sessions added, the chamber filled where it was empty."""
    reg = table(spark, base, "speakers").withColumn("session_ids", F.array_distinct(F.filter(F.coalesce("session_ids", F.array().cast("array<string>")), lambda x: x.isNotNull())))
    sessions = transcript.unique_rows(table(spark, base, "sessions"), "session_id").select("session_id", "chamber")
    exact = speaker_exact_match(spark, base)
    said = table(spark, base, "speech_blocks").select(F.col("speaker_name").alias("name"), "session_id", F.col("created_at").alias("at"))
    none = {c: F.lit(None).cast("string") for c in ("title", "role", "party")}
    met = said.join(exact, "name").join(sessions, "session_id").withColumns(none)
    out = speakers.registry_after(reg, met)
    return out.select("canonical_id", "chamber", F.array_join(F.array_sort("session_ids"), "|").alias("sessions"))


@query
def speaker_exact_match(spark: SparkSession, base: str) -> DataFrame:
    """The first stage alone: labels whose normalised form is a registry name's."""
    said = table(spark, base, "speech_blocks").select(F.col("speaker_name").alias("name"), F.lit(None).cast("string").alias("role")).distinct()
    return speakers.match(said, table(spark, base, "speakers")).filter("stage = 'exact'").select("name", "canonical_id")


@query
def hybrid_candidates(spark: SparkSession, base: str) -> DataFrame:
    return dedup.ranked(dedup.candidates(table(spark, base, "entities")))


@query
def resolve_pairs(spark: SparkSession, base: str) -> DataFrame:
    return dedup.pair_scores(table(spark, base, "entity_matches"))


@query
def dedup_statistics(spark: SparkSession, base: str) -> DataFrame:
    return dedup.statistics(dedup.pair_scores(table(spark, base, "entity_matches")), table(spark, base, "entities"))


@query
def metadata_values(spark: SparkSession, base: str) -> DataFrame:
    """Speakers by what their metadata give as origin, and how many metadata lack the key."""
    s = table(spark, base, "speakers")
    return s.groupBy(F.get_json_object("meta_data", "$.origin").alias("origin")).agg(F.count("*").alias("n"))


@query
def ingestion_counters(spark: SparkSession, base: str) -> DataFrame:
    """What an ingest of all tables counts: sessions, agenda items, blocks, sentences, labels, entities, sessions with a transcript."""
    flat = _flat(spark, base)
    counted = flat.agg(F.countDistinct("session_id").alias("sessions"), F.countDistinct("session_id", "agenda_item_index").alias("agenda_items"),
                       F.countDistinct("session_id", "agenda_item_index", "speech_block_index").alias("blocks"), F.count("*").alias("sentences"), F.countDistinct("speaker_name_original").alias("labels"))
    # each side is one row of counts
    said = table(spark, base, "sessions").agg(F.countDistinct(F.when(F.col("raw_transcript_json").isNotNull(), F.col("session_id"))).alias("with_transcript"))
    return counted.withColumn("_k", F.lit(1)).join(said.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query
def embedding_batches(spark: SparkSession, base: str) -> DataFrame:
    """Documents in batches of 100 in order of id, as a service takes them, with the letters of each batch."""
    d = table(spark, base, "documents").filter("doc_id IS NOT NULL").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("letters"))
    return store.batches(d, "doc_id", Settings.embedding_batch).groupBy("batch").agg(F.count("*").alias("n_docs"), F.sum("letters").alias("n_letters"), F.min("doc_id").alias("first_doc"))


@query
def dedup_components(spark: SparkSession, base: str) -> DataFrame:
    """Merged ids with the oldest record of all that is linked to them."""
    return dedup.survivors(table(spark, base, "entity_matches"), "entity1", "entity2", table(spark, base, "entities"))


@query
def entity_merge(spark: SparkSession, base: str) -> DataFrame:
    return dedup.merged(table(spark, base, "entities"), dedup_components(spark, base))


@query
def entity_marks(spark: SparkSession, base: str) -> DataFrame:
    """The map that the marked entities' metadata give back, chains followed."""
    e = table(spark, base, "entities")
    return dedup.roots(dedup.stored_map(dedup.marked(e, dedup_components(spark, base))))


@query
def vector_similarity(spark: SparkSession, base: str) -> DataFrame:
    """Cosine similarity of the two vectors of every match whose records both have one of full length."""
    e = table(spark, base, "entities").filter(f"size(embedding) = {Settings.embedding_dimensions}").select("entity_id", "embedding")
    m = table(spark, base, "entity_matches").select("match_id", "entity1", "entity2")
    both = m.join(e.select(F.col("entity_id").alias("entity1"), F.col("embedding").alias("x")), "entity1").join(e.select(F.col("entity_id").alias("entity2"), F.col("embedding").alias("y")), "entity2")
    return both.select("match_id", F.round(similarity.cosine(F.col("x"), F.col("y")), 5).alias("cosine"))


@query
def cosine_topk(spark: SparkSession, base: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    e = table(spark, base, "embeddings")
    return searching.nearest(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 64)


# graph ------------------------------------------------------------------------------------------------------------------


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DICTIONARY, "entity_id string, entity_type string, name string")


def _found(spark: SparkSession, base: str) -> DataFrame:
    return providers.dictionary_entities(transcript.chunk_members(_placed(spark, base)), _terms(spark)).select(
        "session_id", "agenda_item_index", "chunk_index", "local_index", "entity_id", "entity_type", "name")


@query
def mention_locate(spark: SparkSession, base: str) -> DataFrame:
    return graph.mentions(_found(spark, base), _placed(spark, base)).drop("mention_id")


@query
def mention_full_sentence(spark: SparkSession, base: str) -> DataFrame:
    """Mentions joined back to their sentences by the four location columns."""
    flat = _flat(spark, base)
    keys = ["session_id", "agenda_item_index", "speech_block_index", "sentence_index"]
    m = graph.mentions(_found(spark, base), _placed(spark, base)).select("entity_id", *keys)
    return m.join(flat.select(*keys, "sentence_id", "full_text", "speaker_name_original"), keys)


@query
def mention_counts(spark: SparkSession, base: str) -> DataFrame:
    """Mentions, sessions and first session of each entity."""
    m = graph.mentions(_found(spark, base), _placed(spark, base))
    return m.groupBy("entity_id").agg(F.count("*").alias("n_mentions"), F.countDistinct("session_id").alias("n_sessions"), F.min("session_id").alias("first_session"))


@query
def recent_entities(spark: SparkSession, base: str) -> DataFrame:
    return transcript.recent_entities(_found(spark, base))


def _relations(spark: SparkSession, base: str) -> DataFrame:
    return providers.cooccurrence(_found(spark, base))


@query
def relationship_validate(spark: SparkSession, base: str) -> DataFrame:
    """Relations from co-occurrence, and copies with a wrong end or type, judged by the rules."""
    rel = _relations(spark, base)
    wrong = rel.withColumn("source_id", F.lit("nobody")).unionByName(rel.withColumn("target_id", F.lit("nothing"))).unionByName(rel.withColumn("relation_type", F.lit("likes")))
    # a few break the rules on sentiment and confidence, by where they stand
    wrong = wrong.unionByName(rel.filter("local_index < 3").withColumn("sentiment", F.lit("glad"))).unionByName(rel.filter("local_index > 4").withColumn("confidence", F.lit(1.5)))
    found = cut(_found(spark, base).select("session_id", "agenda_item_index", "chunk_index", "entity_id").distinct())
    who = transcript.chunks(_placed(spark, base)).select("session_id", "agenda_item_index", "chunk_index", "speakers")
    judged = graph.rejected(rel.unionByName(wrong), found, who)
    return judged.groupBy("session_id", F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query
def relationship_unique(spark: SparkSession, base: str) -> DataFrame:
    """One edge per source, target, relation and session, with its sentence."""
    at = graph.located(_relations(spark, base), _placed(spark, base))
    return dedup.unique_edges(at, ["source_id", "target_id", "relation_type", "session_id"], "confidence", "sentence_id").select("source_id", "target_id", "relation_type", "session_id", "sentence_id", "speech_block_index", "sentence_index")


@query
def ensure_entities(spark: SparkSession, base: str) -> DataFrame:
    """Ids that match pairs name and the entity table lacks."""
    edges = table(spark, base, "entity_matches").select(F.col("entity1").alias("source_id"), F.col("entity2").alias("target_id"))
    return graph.ensure_nodes(edges, table(spark, base, "entities"))


@query
def entity_upsert(spark: SparkSession, base: str) -> DataFrame:
    """Every entity met again under its id, beside a new one of another id."""
    e = table(spark, base, "entities").select("entity_id", "canonical_name", "entity_type", "aliases")
    new = e.select("entity_id", F.upper("canonical_name").alias("canonical_name"), "entity_type", F.array("canonical_name").alias("aliases"), F.lit(1).alias("seen"))
    extra = e.select(F.concat(F.lit("new_"), "entity_id").alias("entity_id"), "canonical_name", "entity_type", "aliases", F.lit(2).alias("seen"))
    return graph.upserted(e, new.unionByName(extra))


@query
def invalid_entities(spark: SparkSession, base: str) -> DataFrame:
    return graph.invalid_entities(table(spark, base, "entities"))


@query
def relationship_remap(spark: SparkSession, base: str) -> DataFrame:
    """Match pairs as edges, both ends led to their roots, repeated edges and loops gone."""
    m = table(spark, base, "entity_matches").select("match_id", F.col("entity1").alias("source_id"), F.col("entity2").alias("target_id"), F.col("hybrid_score").alias("confidence"))
    led = dedup.remapped(m, cut(dedup_components(spark, base)), ["source_id", "target_id"])
    return dedup.unique_edges(led, ["source_id", "target_id"], "confidence", "match_id").select("match_id", "source_id", "target_id", "updates")


@query
def mention_remap(spark: SparkSession, base: str) -> DataFrame:
    """Mentions led to the survivors of merged entities, one per entity and sentence, with the number of mentions that met."""
    pairs = spark.createDataFrame(MERGED_TERMS, "a string, b string")
    born = _terms(spark).select("entity_id", F.lit(None).cast("timestamp").alias("created_at"))
    m = graph.mentions(_found(spark, base), _placed(spark, base)).select("entity_id", "sentence_id")
    led = dedup.remapped(m, cut(dedup.survivors(pairs, "a", "b", born)), ["entity_id"])
    return led.groupBy("entity_id", "sentence_id").agg(F.count("*").alias("n_mentions"), F.sum("updates").alias("updates"))


@query
def agenda_extraction(spark: SparkSession, base: str) -> DataFrame:
    """Per agenda item what the whole loop of chunks gives: chunks, entities found, relations that keep the rules."""
    kg = graph.extracted(_placed(spark, base), lambda members: providers.dictionary_entities(members, _terms(spark)), providers.cooccurrence)
    keys = ["session_id", "agenda_item_index"]
    n = kg["chunks"].groupBy(*keys).agg(F.count("*").alias("n_chunks"), F.count(F.when(F.col("recent") != "", 1)).alias("n_with_context"))
    e = kg["found"].groupBy(*keys).agg(F.countDistinct("entity_id").alias("n_entities"))
    r = kg["relations"].groupBy(*keys).agg(F.count("*").alias("n_relations"))
    return n.join(e, keys).join(r, keys, "left").select(*keys, "n_chunks", "n_with_context", "n_entities", F.coalesce("n_relations", F.lit(0)).alias("n_relations"))


@query
def relationship_provenance(spark: SparkSession, base: str) -> DataFrame:
    """Edges shown between two seconds, with their evidence, in order of session, video and second."""
    edges = graph.evidence(_relations(spark, base), _placed(spark, base))
    return graph.provenance(edges, first=FIRST_SECOND, last=LAST_SECOND).select("session_id", "video_id", "evidence_timestamp_seconds", "source_id", "target_id", "evidence_quote", "sentence_id", "chunk_index", "source")


@query
def entity_defaults(spark: SparkSession, base: str) -> DataFrame:
    """Entities with what was left out filled in."""
    e = graph.with_defaults(table(spark, base, "entities").select("entity_id", F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence"), "aliases", "description"))
    return e.select("entity_id", "confidence", F.size("aliases").alias("n_aliases"), "description")


@query
def speaker_first_seen(spark: SparkSession, base: str) -> DataFrame:
    return transcript.first_seen(_flat(spark, base))


# maintenance ------------------------------------------------------------------------------------------------------------


@query
def entities_by_age(spark: SparkSession, base: str) -> DataFrame:
    return store.by_age(table(spark, base, "entities").select("entity_id", "created_at"), "entity_id")


@query
def unspoken_lookup(spark: SparkSession, base: str) -> DataFrame:
    """Blocks of one placeholder label, and those without any: point lookups by value and by null."""
    b = table(spark, base, "speech_blocks").select("block_id", "session_id", "speaker_name")
    return searching.lookup(b, speaker_name="Unknown Speaker").unionByName(searching.lookup(b, speaker_name=None))


@query
def ingest_success(spark: SparkSession, base: str) -> DataFrame:
    """Per chamber the deliveries whose transcript is whole, and those that are broken off or missing."""
    s = table(spark, base, "sessions").select("chamber", F.when(text.looks_truncated(F.col("raw_transcript_json")), "failed").otherwise(F.when(F.col("raw_transcript_json").isNotNull(), "success")).alias("status"))
    return usage.successes(s, "status", ["chamber"])


@query
def cascade_delete(spark: SparkSession, base: str) -> DataFrame:
    """Rows left per table after sessions whose sitting number ends in a given digit are deleted."""
    s = table(spark, base, "sessions")
    gone = s.filter(F.endswith(F.coalesce("sitting_number", F.lit("")), F.lit(GONE_DIGIT))).select("session_id")
    tables = {"sessions": s.select("session_id"), "transcript_sentences": table(spark, base, "transcript_sentences").select("session_id"), "agenda_items": table(spark, base, "speech_blocks").select("session_id", "agenda_item_index").distinct(), "relationships": table(spark, base, "documents").select("session_id")}
    left = store.delete_sessions(tables, gone)
    out = None
    for name, df in sorted(left.items()):
        row = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.count("session_id").alias("n_with_session"))
        out = row if out is None else out.unionByName(row)
    return out


@query
def insert_if_absent(spark: SparkSession, base: str) -> DataFrame:
    """Sessions delivered from a day on, inserted where the earlier ones lack them."""
    s = table(spark, base, "sessions").select("session_id", "session_date", "title", "created_at")
    old, new = s.filter(F.col("session_date") < EXISTING_BEFORE), s
    return store.insert_absent(old, new, "session_id").select("session_id", "session_date", "title")


@query
def keyed_update(spark: SparkSession, base: str) -> DataFrame:
    """Entities whose confidence is taken over from their best match."""
    m = table(spark, base, "entity_matches").filter("entity1 IS NOT NULL").groupBy(F.col("entity1").alias("entity_id")).agg(F.max("hybrid_score").alias("confidence"))
    return store.updated(table(spark, base, "entities").select("entity_id", F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence")), m, "entity_id")


# search -----------------------------------------------------------------------------------------------------------------


@query
def keyword_search(spark: SparkSession, base: str) -> DataFrame:
    return searching.keyword(table(spark, base, "documents"), "doc_id", "text", KEYWORDS)


@query
def ilike_search(spark: SparkSession, base: str) -> DataFrame:
    return searching.pattern(table(spark, base, "documents"), "doc_id", "text", LIKE).select("doc_id")


@query
def lexeme_counts(spark: SparkSession, base: str) -> DataFrame:
    """Documents and hits of every lexeme of the sentences' inverted index."""
    found = searching.hits(_flat(spark, base), "sentence_id", "full_text")
    return found.groupBy("lexeme").agg(F.countDistinct("sentence_id").alias("n_docs"), F.count("*").alias("n_hits"))


@query
def search_vector_backfill(spark: SparkSession, base: str) -> DataFrame:
    """Text vectors for the sentences that have none: of freshly delivered ones, all."""
    s = _flat(spark, base).select("sentence_id", "full_text", F.lit(None).cast("string").alias("search_vector"))
    return store.backfill(s, "search_vector", lambda d: searching.text_vectors(d, "full_text")).select("sentence_id", "search_vector")


# usage ------------------------------------------------------------------------------------------------------------------


@query
def usage_rollup(spark: SparkSession, base: str) -> DataFrame:
    """Calls per stage and model; the events' counter stands for tokens of the prompt, their user for those of the answer."""
    prompt, output = "try_cast(get_json_object(props, '$.k') AS bigint)", "user_id"
    return usage.rollup(table(spark, base, "events"), {"stage": "event_type", "model": "CASE WHEN value < 50 THEN 'small' ELSE 'large' END"}, "value", {"prompt_tokens": prompt, "output_tokens": output, "total_tokens": f"{prompt} + {output}"})


@query
def rate_window(spark: SparkSession, base: str) -> DataFrame:
    return usage.rate_window(table(spark, base, "events"), "ts", "user_id", "event_id", 3600, 2)
