"""Deeply nested semi-structured records into flat tables with parent-child links.

One projection of higher-order functions per record: the text is parsed once to a VARIANT, nested ``transform``
calls attach ancestor positions, ``flatten`` joins the arrays and one ``inline`` per target table emits its rows.
Nothing is shuffled before the rows are flat.

Defined results
* null, empty, blank, broken-off and non-JSON texts give no row;
* byte-order marks, code fences, prose around the document, string-encoded documents, an outer
  ``{"transcript": ...}`` object and an outer one-element array are unwrapped;
* keys match whatever their spelling (case, ``_`` and ``-`` are ignored); the first non-null one counts;
* a single value where an array is expected is element 0; a null element keeps its position and gives no row;
* records delivered again give their rows once; any other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "array<struct<path:string,parent:string,pos:int,v:variant>>"
#: How often a document may be encoded as a string within a string.
ENCODINGS = 3


def _clean(s: str) -> str:
    """SQL: the document text in ``s`` without byte-order marks, white space, fences and prose around it."""
    trimmed = f"regexp_replace({s}, '^[\\\\s\\\\x{{FEFF}}\\\\x{{200B}}\\\\x{{00A0}}]+|[\\\\s\\\\x{{FEFF}}\\\\x{{200B}}\\\\x{{00A0}}]+$', '')"
    fenced = f"regexp_extract({s}, '(?s)```\\\\w*\\\\s*(.*?)\\\\s*```', 1)"
    inner = f"regexp_extract({s}, '(?s)[\\\\[{{].*[\\\\]}}]', 0)"
    return f"CASE WHEN try_parse_json({trimmed}) IS NOT NULL THEN {trimmed} WHEN try_parse_json({fenced}) IS NOT NULL THEN {fenced} ELSE {inner} END"


def _array(v: str) -> str:
    """SQL: variant ``v`` as an array; null is empty, any other single value is its only element."""
    return (
        f"coalesce(try_variant_get({v}, '$', 'array<variant>'), "
        f"CASE WHEN {v} IS NULL OR is_variant_null({v}) THEN CAST(array() AS array<variant>) ELSE array({v}) END)"
    )


def _get(v: str, *keys: str) -> str:
    """SQL: the first non-null member of object ``v`` under one of ``keys``, spelled in any way."""
    wanted = ", ".join(f"'{k}'" for k in keys)
    return (
        f"try_element_at(filter(map_entries(coalesce(try_variant_get({v}, '$', 'map<string,variant>'), CAST(map() AS map<string,variant>))), "
        f"e -> lower(regexp_replace(e.key, '[^A-Za-z0-9]', '')) IN ({wanted}) AND NOT is_variant_null(e.value)), 1).value"
    )


def _children(nodes: str, *keys: str, depth: int = 0) -> str:
    """SQL: the child nodes of all ``nodes`` under ``keys``, paths extended by the child's position."""
    n, c, i = f"n{depth}", f"c{depth}", f"i{depth}"
    return (
        f"flatten(transform(filter({nodes}, {n} -> {n}.v IS NOT NULL AND NOT is_variant_null({n}.v)), {n} -> transform({_array(_get(f'{n}.v', *keys))}, ({c}, {i}) -> "
        f"struct(concat_ws('.', {n}.path, CAST({i} AS string)) AS path, {n}.path AS parent, {i} AS pos, {c} AS v))))"
    )


def _present(nodes: str) -> str:
    return f"filter({nodes}, n -> n.v IS NOT NULL AND NOT is_variant_null(n.v))"


def document(text: str) -> Column:
    """The JSON document held by string column ``text`` as a VARIANT, or null."""
    s = _clean(f"`{text}`")
    return F.expr(f"try_parse_json({s})")


def _decoded(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``_doc``: the document with string encodings undone; null unless complete."""
    df = df.withColumn("_s", F.expr(_clean(f"`{text}`")))
    for _ in range(ENCODINGS):
        opened = "try_variant_get(try_parse_json(_s), '$', 'string')"
        again = _clean("_t")
        df = df.withColumn("_t", F.expr(f"CASE WHEN _s LIKE '\"%' THEN {opened} END"))
        # a string that holds a container is a document encoded once more; any other string is a value
        df = df.withColumn("_s", F.expr(f"CASE WHEN ltrim(_t) RLIKE '^\\\\x{{FEFF}}?\\\\s*(```|[\\\\[{{\"])' THEN {again} ELSE _s END")).drop("_t")
    return df.withColumn("_doc", F.expr("try_parse_json(_s)")).drop("_s")


def _roots(source: str) -> str:
    """SQL: top-level node array from the elements of ``source`` (an array<variant>)."""
    return f"transform({source}, (c, i) -> struct(CAST(i AS string) AS path, CAST(NULL AS string) AS parent, i AS pos, c AS v))"


def transcript_nodes(sessions: DataFrame, key: str = "session_id", text: str = "raw_transcript_json") -> DataFrame:
    """``key`` and the arrays ``items``, ``blocks``, ``sentences`` of nodes (path, parent, pos, v) of each transcript."""
    df = _decoded(sessions.select(F.col(key).alias("record_id"), F.col(text).alias("_text")).filter("_text IS NOT NULL"), "_text")
    # outer wrappers: an array around the session, an object "transcript" around it
    holds = _get("x", "agendaitems")
    wrapped = _get("x", "transcript")
    inner = f"transform({_array('_doc')}, x -> coalesce({wrapped}, x))"
    df = df.withColumn("_outer", F.expr(inner))
    df = df.withColumn("_agenda", F.expr(
        f"CASE WHEN exists(_outer, x -> {holds} IS NOT NULL) THEN {_array('filter(transform(_outer, x -> ' + holds + '), a -> a IS NOT NULL)[0]')} "
        f"WHEN exists(_outer, x -> {_get('x', 'speechblocks', 'topictitle')} IS NOT NULL) THEN _outer ELSE CAST(array() AS array<variant>) END"
    ))
    df = df.withColumn("items", F.expr(f"CAST({_roots('_agenda')} AS {NODES})"))
    df = df.withColumn("blocks", F.expr(f"CAST({_children('items', 'speechblocks')} AS {NODES})"))
    df = df.withColumn("sentences", F.expr(f"CAST({_children('blocks', 'sentences')} AS {NODES})"))
    return df.select("record_id", "items", "blocks", "sentences")


def paper_nodes(papers: DataFrame, key: str = "order_paper_id") -> DataFrame:
    """``key`` and the node arrays ``speakers`` and ``items`` of each order paper; items hold sub-items of any depth."""
    df = papers.select(F.col(key).alias("record_id"), F.col("speakers").alias("_a"), F.col("agenda_items").alias("_b"))
    df = _decoded(df, "_a").withColumnRenamed("_doc", "_da")
    df = _decoded(df, "_b")
    # rounds of the fold: at most one level per occurrence of the key
    df = df.withColumn("_rounds", F.expr("coalesce(regexp_count(lower(_b), 'sub[^a-z0-9]*items'), 0)"))
    broken = lambda d: f"CASE WHEN try_variant_get({d}, '$', 'string') RLIKE '^\\\\s*[\\\\[{{]' AND schema_of_variant({d}) = 'STRING' THEN NULL ELSE {d} END"
    unwrap = lambda d, k: f"coalesce({_get(d, k)}, {d})"
    df = df.withColumn("_da", F.expr(broken("_da"))).withColumn("_db", F.expr(broken("_doc")))
    df = df.withColumn("_da", F.expr(unwrap("_da", "speakers"))).withColumn("_db", F.expr(unwrap("_db", "agendaitems")))
    df = df.withColumn("speakers", F.expr(f"CAST({_roots(_array('_da'))} AS {NODES})"))
    df = df.withColumn("_top", F.expr(f"CAST({_roots(_array('_db'))} AS {NODES})"))
    step = _children("s.frontier", "subitems", depth=1)
    # breadth-first fold: the frontier's children become the next frontier until nothing is left
    df = df.withColumn("items", F.expr(
        f"aggregate(CASE WHEN _rounds > 0 THEN sequence(1, _rounds) ELSE CAST(array() AS array<int>) END, "
        f"CAST(struct(_top AS frontier, _top AS out) AS struct<frontier:{NODES},out:{NODES}>), "
        f"(s, k) -> CASE WHEN size(s.frontier) = 0 THEN s ELSE CAST(struct({step} AS frontier, concat(s.out, {step}) AS out) AS struct<frontier:{NODES},out:{NODES}>) END, "
        f"s -> s.out)"
    ))
    return df.select("record_id", "speakers", "items")


def _kind(array: str, kind: str) -> str:
    return f"transform({_present(array)}, n -> struct('{kind}' AS node_kind, n.path AS node_path))"


def node_index(sessions: DataFrame, papers: DataFrame) -> DataFrame:
    """One row (record_id, node_kind, node_path) for every nested node of transcripts and order papers."""
    t = transcript_nodes(sessions).selectExpr(
        "record_id", f"inline(concat({_kind('items', 'agenda_item')}, {_kind('blocks', 'speech_block')}, {_kind('sentences', 'sentence')}))")
    p = paper_nodes(papers).selectExpr("record_id", f"inline(concat({_kind('speakers', 'paper_speaker')}, {_kind('items', 'paper_item')}))")
    return t.distinct().unionByName(p.distinct())


def _text(v: str, *keys: str) -> str:
    return f"try_variant_get({_get(v, *keys)}, '$', 'string')"


def _flat(df: DataFrame, array: str, fields: dict[str, tuple[str, ...]], bare: str | None = None) -> DataFrame:
    """The rows of one target table; ``bare``: the field that takes a node which is a plain value."""
    cols = []
    for name, keys in fields.items():
        value = _text("n.v", *keys)
        if name == bare:
            value = f"coalesce({value}, CASE WHEN try_variant_get(n.v, '$', 'map<string,variant>') IS NULL THEN try_variant_get(n.v, '$', 'string') END)"
        cols.append(f"{value} AS {name}")
    made = f"transform({_present(array)}, n -> struct(n.path AS node_path, n.parent AS parent_path, n.pos AS position, {', '.join(cols)}))"
    return df.selectExpr("record_id", f"inline({made})").distinct()


def transcript_tables(sessions: DataFrame) -> dict[str, DataFrame]:
    """Tables agenda_items, speech_blocks, sentences; each row knows its record, path and parent's path."""
    n = transcript_nodes(sessions)
    return {
        "agenda_items": _flat(n, "items", {"topic_title": ("topictitle", "title")}),
        "speech_blocks": _flat(n, "blocks", {"speaker_name": ("speakername", "speaker"), "speaker_id": ("speakerid",)}, "speaker_name"),
        "sentences": _flat(n, "sentences", {"start_time": ("starttime",), "text": ("text",)}, "text"),
    }


def paper_tables(papers: DataFrame) -> dict[str, DataFrame]:
    """Tables paper_speakers and paper_items; sub-items carry the path of the item that holds them."""
    n = paper_nodes(papers)
    return {
        "paper_speakers": _flat(n, "speakers", {"name": ("name",), "title": ("title",), "role": ("role",)}, "name"),
        "paper_items": _flat(n, "items", {"topic_title": ("topictitle", "title"), "primary_speaker": ("primaryspeaker",), "description": ("description",)}, "topic_title"),
    }


def paper_headers(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(record_id, session_title, sitting_number, session_date) of order papers read by a service; a date that is none is null, as all is of a broken answer."""
    df = _decoded(answers.select(F.col(key).alias("record_id"), F.col(text).alias("_text")), "_text")
    cols = {"session_title": ("sessiontitle", "title"), "sitting_number": ("sittingnumber",), "_date": ("sessiondate", "date")}
    df = df.select("record_id", *[F.expr(_text("_doc", *keys)).alias(n) for n, keys in cols.items()])
    return df.withColumn("session_date", F.try_to_date("_date", "yyyy-MM-dd")).drop("_date")


def quarantined(sessions: DataFrame, key: str = "session_id", text: str = "raw_transcript_json") -> DataFrame:
    """(record_id, reason) of the transcripts that cannot be stored: ``empty``, ``no document`` (broken off or no JSON) or ``no agenda item``."""
    n = transcript_nodes(sessions.select(key, text), key, text).select("record_id", (F.size("items") > 0).alias("_items"))
    df = _decoded(sessions.select(F.col(key).alias("record_id"), F.col(text).alias("_text")), "_text").select("record_id", "_text", F.col("_doc").isNotNull().alias("_ok")).distinct()
    held = n.groupBy("record_id").agg(F.max("_items").alias("_items"))
    blank = F.trim(F.coalesce("_text", F.lit(""))) == ""
    reason = F.when(blank, "empty").when(~F.col("_ok"), "no document").when(~F.coalesce("_items", F.lit(False)), "no agenda item")
    return df.join(held, "record_id", "left").select("record_id", reason.alias("reason")).filter("reason IS NOT NULL").distinct()
