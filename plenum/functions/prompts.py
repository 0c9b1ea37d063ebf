"""What model services are asked: prompts and requests as Column expressions, one text per row.

Null parts are left out or shown as empty; every prompt asks for one JSON document and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Schemas of the answers, as Spark reads them.
TRANSCRIPT = "session_title string, agenda_items array<struct<topic_title:string,speech_blocks:array<struct<speaker_name:string,sentences:array<struct<start_time:string,text:string>>>>>>"
ENTITIES = "entities array<struct<entity_id:string,entity_type:string,name:string,canonical_name:string,aliases:array<string>,description:string,mentions:array<struct<sentence_index:int,context:string>>,confidence:double>>"
RELATIONS = "relationships array<struct<source_id:string,target_id:string,relation_type:string,sentiment:string,evidence:string,evidence_sentence_index:int,confidence:double>>"
DECISION = "decision string, reasoning string, merged_name string, merged_aliases array<string>"
ORDER_PAPER = "session_title string, sitting_number string, session_date string, speakers array<struct<name:string,title:string,role:string>>, agenda_items array<struct<topic_title:string,primary_speaker:string,description:string>>"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _lines(*parts: str | Column) -> Column:
    """The parts below each other; empty ones are left out."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.array_join(F.filter(F.array(*cols), lambda x: x.isNotNull() & (x != "")), "\n")


def _told(label: str, value: Column) -> Column:
    return F.when(_text(value) != "", F.concat(F.lit(f"{label}: "), _text(value)))


def _answer(schema: str) -> str:
    return f"Answer with one JSON object of this form and nothing else: {schema}"


def sentence_lines(sentences: Column) -> Column:
    """Numbered lines of an array of structs (index, start_time, text)."""
    return F.array_join(F.transform(sentences, lambda s: F.concat(F.lit("#"), s["index"].cast("string"), F.lit(" at "), _text(s["start_time"]), F.lit(" "), _text(s["text"]))), "\n")


def entity_prompt(title: Column, speakers: Column, context: Column, recent: Column, sentences: Column) -> Column:
    """Which people, bodies, places, laws and ideas does a chunk name?"""
    return _lines("Which entities does this part of a debate name? Give each one once, with the numbers of its sentences.", _told("Item", title), _told("Speakers", F.array_join(speakers, ", ")),
                  _told("Speakers before", context), _told("Entities named before", recent), sentence_lines(sentences), _answer(ENTITIES))


def relation_prompt(title: Column, entities: Column, sentences: Column) -> Column:
    """How do the entities of a chunk relate to each other?"""
    return _lines("Which of these entities and speakers relate to each other in this part of a debate? Quote the sentence that shows it.", _told("Item", title), _told("Entities", F.array_join(entities, ", ")), sentence_lines(sentences), _answer(RELATIONS))


def merge_prompt(older: Column, younger: Column, fuzzy: Column, vector: Column) -> Column:
    """Are two records the same thing? ``older`` and ``younger``: structs shown as JSON."""
    return _lines("Do these two records describe the same thing? Decide 'merge' or 'keep_separate'; for a merge give the name and aliases to keep.", _told("Older", F.to_json(older)), _told("Younger", F.to_json(younger)),
                  _told("Likeness of names", F.round(fuzzy, 2)), _told("Likeness of meaning", F.round(vector, 2)), _answer(DECISION))


def transcript_prompt(date: Column, chamber: Column, sitting: Column, known_speakers: Column) -> Column:
    """A session's video to a transcript by agenda item, speaker and sentence."""
    return _lines("Write down what is said in this recording of a session, by agenda item, speaker and sentence, each sentence with the time at which it begins (XhYmZs).", _told("Chamber", chamber), _told("Date", date), _told("Sitting", sitting),
                  _told("Speakers to expect", F.array_join(known_speakers, ", ")), _answer(TRANSCRIPT))


def paper_prompt(chamber: Column) -> Column:
    """An order paper's pages to its header, speakers and agenda items."""
    return _lines("Read this order paper: its title, sitting and date (YYYY-MM-DD), the people it names with title and office, and its agenda items in order.", _told("Chamber", chamber), _answer(ORDER_PAPER))


def video_request(prompt: Column, url: Column, fps: float = 0.5, start: Column | None = None, end: Column | None = None, quality: str | None = None) -> Column:
    """The JSON request for a video: frames a second, first and last second (null: the whole video), quality low, medium or high."""
    none = F.lit(None).cast("bigint")
    facts = F.struct(prompt.alias("prompt"), url.alias("url"), F.lit(float(fps)).alias("fps"), (none if start is None else start).alias("start_second"), (none if end is None else end).alias("end_second"), F.lit(quality).cast("string").alias("quality"))
    return F.to_json(facts)


def keyed_json(rows: Column) -> Column:
    """A JSON object from an array of structs (id, value): each id once, with its first value."""
    ids = F.array_distinct(F.transform(rows, lambda x: x["id"]))
    return F.to_json(F.map_from_arrays(ids, F.transform(ids, lambda i: F.get(F.filter(rows, lambda x: x["id"] == i), F.lit(0))["value"])))
