"""The SQL that DuckDB runs beside the core queries, and the parameters that both share."""

from __future__ import annotations

from plenum.functions.prompts import TRANSCRIPT
from plenum.functions.search import MEASURED, MEASURED_ONCE, MEASURED_TWICE, SHORT, STEP2, STEP3, STEP4, STOPWORDS, VOWEL
from plenum.functions.text import TITLES
from plenum.settings import Settings

KEYWORDS, LIKE = "clean water price", "%harbour%tax%"
GONE_DIGIT, EXISTING_BEFORE = "7", "2020-01-01"
FIRST_SECOND, LAST_SECOND = 60, 7200
#: Pairs of dictionary entities that are one thing: two chains.
MERGED_TERMS = [("clean_water", "water_board"), ("port_authority", "new_harbour"), ("new_harbour", "customs_house"), ("sugar_tax", "new_tariff"), ("finance_bill", "sugar_tax")]
DICTIONARY = [
    ("water_board", "organization", "water board"), ("port_authority", "organization", "port authority"), ("pension_fund", "organization", "pension fund"),
    ("housing_agency", "organization", "housing agency"), ("finance_bill", "law", "finance bill"), ("new_tariff", "law", "new tariff"), ("customs_house", "place", "customs house"),
    ("new_harbour", "place", "new harbour"), ("solar_power", "concept", "solar power"), ("sugar_tax", "concept", "tax on sugar"), ("fair_wage", "policy_position", "fair wage"), ("clean_water", "concept", "clean water"),
]


def _seconds(t: str) -> str:
    """SQL: seconds of ``t``."""
    h = f"CASE WHEN contains({t}, 'h') THEN split_part({t}, 'h', 1) END"
    rest = f"CASE WHEN contains({t}, 'h') THEN split_part({t}, 'h', 2) ELSE {t} END"
    m = f"CASE WHEN contains({rest}, 'm') THEN split_part({rest}, 'm', 1) END"
    tail = f"CASE WHEN contains({rest}, 'm') THEN split_part({rest}, 'm', 2) ELSE {rest} END"
    s = f"CASE WHEN contains({tail}, 's') THEN trim(replace({tail}, 's', '')) END"
    whole = "'^\\s*[+-]?[0-9]+\\s*$'"
    number = "'^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$'"
    return (
        f"CASE WHEN {t} IS NULL THEN NULL ELSE "
        f"(CASE WHEN {h} IS NULL THEN 0 WHEN regexp_matches({h}, {whole}) THEN CAST(trim({h}) AS BIGINT) END) * 3600 + "
        f"(CASE WHEN {m} IS NULL THEN 0 WHEN regexp_matches({m}, {whole}) THEN CAST(trim({m}) AS BIGINT) END) * 60 + "
        f"(CASE WHEN {s} IS NULL OR {s} = '' THEN 0 WHEN regexp_matches({s}, {number}) THEN CAST(floor(CAST({s} AS DOUBLE)) AS BIGINT) END) END"
    )


_BLOCKS = "b AS (SELECT block_id, arg_max(speaker_name, created_at) AS speaker_name_original, arg_max(topic_title, created_at) AS topic_title FROM speech_blocks WHERE block_id IS NOT NULL GROUP BY block_id)"
_SENT = "u AS (SELECT DISTINCT sentence_id, block_id, session_id, video_id, agenda_item_index, speech_block_index, sentence_index, start_time, text FROM transcript_sentences WHERE sentence_id IS NOT NULL)"
#: Common tables: f, the flat sentences; p, numbered; c, chunk members.
FLAT = f"{_BLOCKS}, {_SENT}, f AS (SELECT u.*, b.speaker_name_original, b.topic_title, u.text AS full_text, {_seconds('u.start_time')} AS timestamp_seconds FROM u LEFT JOIN b ON u.block_id = b.block_id)"
PLACED = f"{FLAT}, p AS (SELECT *, row_number() OVER (PARTITION BY session_id, agenda_item_index ORDER BY speech_block_index, sentence_index, sentence_id) - 1 AS flat_index FROM f)"
CHUNKS = f"{PLACED}, k AS (SELECT p.*, unnest(range(greatest(0, CAST(ceil((flat_index - 6) / 5.0) AS BIGINT)), flat_index // 5 + 1)) AS chunk_index FROM p), c AS (SELECT *, flat_index - 5 * chunk_index AS local_index FROM k)"
_DIC = ", ".join(f"('{i}', '{t}', '{n}')" for i, t, n in DICTIONARY)
_FLATTENED = "' ' || array_to_string(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' '"
FOUND = f"{CHUNKS}, d(entity_id, entity_type, name) AS (VALUES {_DIC}), t AS (SELECT *, {_FLATTENED.format('full_text')} AS flat FROM c), g AS (SELECT t.*, d.entity_id, d.entity_type, d.name FROM t JOIN d ON contains(t.flat, ' ' || d.name || ' '))"
_REL = f"{FOUND}, r AS (SELECT DISTINCT x.session_id, x.agenda_item_index, x.chunk_index, x.local_index, x.entity_id AS source_id, y.entity_id AS target_id FROM g x JOIN g y ON x.session_id IS NOT DISTINCT FROM y.session_id AND x.agenda_item_index IS NOT DISTINCT FROM y.agenda_item_index AND x.chunk_index = y.chunk_index AND x.local_index = y.local_index AND x.entity_id < y.entity_id)"


def _normalized(mode: str) -> str:
    """SQL: the folding of the titles over column ``s``, one common table per title."""
    steps = ["n0 AS (SELECT name, trim(lower(name)) AS s FROM names)"]
    for i, t in enumerate(TITLES, 1):
        once = f"CASE WHEN starts_with(s, '{t} ') THEN trim(substr(s, {len(t) + 1})) ELSE s END"
        steps.append(f"m{i} AS (SELECT name, {once} AS s FROM n{i - 1})")
        twice = f"CASE WHEN starts_with(s, '{t}') THEN trim(substr(s, {len(t) + 1})) ELSE s END" if mode == "reference" else "s"
        steps.append(f"n{i} AS (SELECT name, {twice} AS s FROM m{i})")
    out = "trim(regexp_replace(regexp_replace(s, '[^\\p{L}\\p{N}\\p{M}_\\s-]', '', 'g'), '\\s+', ' ', 'g'))"
    return ", ".join(steps) + f", norm AS (SELECT name, {out} AS v FROM n{len(TITLES)})"


_NAMES = "names AS (SELECT DISTINCT name FROM (SELECT name FROM speakers UNION ALL SELECT speaker_name FROM speech_blocks) WHERE name IS NOT NULL)"
_NORMS = f"ref AS (WITH {_normalized('reference')} SELECT * FROM norm), word AS (WITH {_normalized('word')} SELECT * FROM norm)"
def _closure(pairs: str, born: str) -> str:
    """SQL common tables: ``roots`` (old_id, root_id), every id that ``pairs`` (a, b) links with the oldest of ``born`` (id, made) among all it reaches."""
    return (
        f"es(a, b) AS (SELECT a, b FROM ({pairs}) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b UNION SELECT b, a FROM ({pairs}) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b), "
        f"born AS ({born}), reach(id, other) AS (SELECT a, a FROM es UNION SELECT r.id, es.b FROM reach r JOIN es ON es.a = r.other), "
        "oldest AS (SELECT reach.id AS old_id, first(other ORDER BY born.id IS NULL, made IS NOT NULL, made, other) AS root_id FROM reach LEFT JOIN born ON born.id = other GROUP BY 1), "
        "roots AS (SELECT * FROM oldest WHERE old_id <> root_id)"
    )


_PAIRS = "SELECT entity1 AS a, entity2 AS b FROM entity_matches"
_BORN = "SELECT entity_id AS id, min(created_at) AS made FROM entities WHERE entity_id IS NOT NULL GROUP BY 1"
_ROOTS = _closure(_PAIRS, _BORN)


def _lcs_ratio(a: str, b: str) -> str:
    """SQL: the fuzzy ratio of two texts, row by row of the table of common subsequences."""
    row = (f"list_reduce(list_filter(string_split({a}, ''), lambda q: q <> ''), lambda row, x: list_reduce(range(1, length({b}) + 1), lambda acc, j: list_append(acc, CASE WHEN substr({b}, j, 1) = x THEN coalesce(row[j - 1], 0) + 1 "
           f"ELSE greatest(row[j], coalesce(acc[-1], 0)) END), []::BIGINT[]), list_transform(range(1, length({b}) + 1), lambda j: 0::BIGINT))")
    return f"CAST(CASE WHEN length({a}) + length({b}) = 0 THEN 100 WHEN {a} = {b} THEN 100 ELSE round_even(200.0 * coalesce(list_max({row}), 0) / (length({a}) + length({b})), 0) END AS INT)"


def _stems(words: str) -> str:
    """SQL common tables: ``stems`` (word, stem) of the words of query ``words``, Porter's steps one table each."""
    has = lambda x, pattern: f"regexp_matches({x}, '{pattern}')"
    cut = lambda n: f"left(w, length(w) - {n})"

    def table(steps: dict[str, str], measure: str) -> str:
        cases = " ".join(f"WHEN ends_with(w, '{x}') THEN CASE WHEN {has(cut(len(x)), measure)} THEN {cut(len(x))} || '{to}' ELSE w END" for x, to in sorted(steps.items(), key=lambda p: -len(p[0])))
        return f"CASE {cases} ELSE w END"

    double = "(" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwx") + ")$"
    mended = f"CASE WHEN {has('v', '(at|bl|iz)$')} THEN v || 'e' WHEN {has('v', double)} THEN left(v, length(v) - 1) WHEN {has('v', SHORT)} THEN v || 'e' ELSE v END"
    steps = [
        f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut(2)} WHEN {has('w', '[^s]s$')} THEN {cut(1)} ELSE w END",
        f"CASE WHEN v IS NOT NULL THEN {mended} WHEN ends_with(w, 'eed') AND {has(cut(3), MEASURED)} THEN {cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'y') AND {has(cut(1), VOWEL)} THEN {cut(1)} || 'i' ELSE w END",
        table(STEP2, MEASURED), table(STEP3, MEASURED),
        f"CASE WHEN {has('w', '[st]ion$')} THEN CASE WHEN {has(cut(3), MEASURED_TWICE)} THEN {cut(3)} ELSE w END ELSE {table(dict.fromkeys(STEP4, ''), MEASURED_TWICE)} END",
        f"CASE WHEN ends_with(w, 'e') AND ({has(cut(1), MEASURED_TWICE)} OR ({has(cut(1), MEASURED_ONCE)} AND NOT {has(cut(1), SHORT)})) THEN {cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {has('w', MEASURED_TWICE)} THEN {cut(1)} ELSE w END",
    ]
    loose = f"CASE WHEN ends_with(w, 'eed') THEN NULL WHEN ends_with(w, 'ed') AND {has(cut(2), VOWEL)} THEN {cut(2)} WHEN ends_with(w, 'ing') AND {has(cut(3), VOWEL)} THEN {cut(3)} END"
    out = f"w0 AS (SELECT word, CASE WHEN starts_with(word, 'y') THEN 'Y' || substr(word, 2) ELSE word END AS w FROM ({words}))"
    for i, step in enumerate(steps):
        out += f", w{i + 1} AS (SELECT word, {step} AS w FROM (SELECT *, {loose} AS v FROM w{i}))"
    return out + f", stems AS (SELECT word, CASE WHEN regexp_matches(word, '^[a-z]{{3,}}$') THEN lower(w) ELSE word END AS stem FROM w{len(steps)})"


_STOP = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))
_LISTED = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"


def _lexemes(rows: str, key: str, text: str) -> str:
    """SQL common tables: ``lex`` (key, stem, pos) of the words of ``rows`` that are no stop words."""
    listed = _LISTED.format(text)
    return (f"ws AS (SELECT {key}, unnest({listed}) AS word, unnest(range(1, len({listed}) + 1)) AS pos FROM {rows}), {_stems('SELECT DISTINCT word FROM ws')}, "
            f"lex AS (SELECT {key}, stem, pos FROM ws JOIN stems USING (word) WHERE word NOT IN ({_STOP}))")


ORACLES: dict[str, str] = {
    "reconstruct_transcript": f"WITH {FLAT} SELECT session_id, agenda_item_index, speech_block_index, sentence_index, sentence_id, speaker_name_original, full_text, timestamp_seconds FROM f",
    "speaker_timeline": f"""WITH {FLAT}, s AS (SELECT DISTINCT session_id, session_date, sitting_number FROM sessions WHERE session_id IS NOT NULL)
        SELECT speaker_name_original, session_date, sitting_number, timestamp_seconds, sentence_id, full_text,
          CAST(row_number() OVER (PARTITION BY speaker_name_original ORDER BY session_date DESC, timestamp_seconds ASC NULLS LAST, sentence_id) AS INT) AS place
        FROM f JOIN s USING (session_id) WHERE speaker_name_original IS NOT NULL""",
    "block_full_text": f"""WITH {FLAT} SELECT session_id, agenda_item_index, speech_block_index, min(speaker_name_original) AS speaker_name,
        string_agg(coalesce(full_text, ''), ' ' ORDER BY sentence_index, sentence_id) AS block_text, count(*) AS n_sentences FROM f GROUP BY ALL""",
    "agenda_full_text": f"""WITH {FLAT}, bt AS (SELECT session_id, agenda_item_index, speech_block_index, coalesce(min(speaker_name_original), '') || ': ' || string_agg(coalesce(full_text, ''), ' ' ORDER BY sentence_index, sentence_id) AS said FROM f GROUP BY ALL)
        SELECT session_id, agenda_item_index, string_agg(said, chr(10) || chr(10) ORDER BY speech_block_index) AS agenda_text FROM bt GROUP BY ALL""",
    "sentence_counts": f"""WITH {FLAT} SELECT session_id, count(*) AS n_sentences, count(DISTINCT (agenda_item_index, speech_block_index)) AS n_blocks, count(DISTINCT agenda_item_index) AS n_items,
        count(DISTINCT speaker_name_original) AS n_labels FROM f GROUP BY session_id""",
    "chunk_windows": f"WITH {CHUNKS} SELECT session_id, agenda_item_index, CAST(chunk_index AS INT) AS chunk_index, CAST(local_index AS INT) AS local_index, CAST(flat_index AS INT) AS flat_index, sentence_id FROM c",
    "chunk_context_lag": f"""WITH {CHUNKS}, h AS (SELECT session_id, agenda_item_index, chunk_index, count(*) AS n_sentences, coalesce(string_agg(DISTINCT speaker_name_original, ', ' ORDER BY speaker_name_original), '') AS speakers FROM c GROUP BY ALL)
        SELECT session_id, agenda_item_index, CAST(chunk_index AS INT) AS chunk_index, n_sentences, speakers, coalesce(lag(speakers) OVER (PARTITION BY session_id, agenda_item_index ORDER BY chunk_index), '') AS context_speakers FROM h""",
    "embedding_coverage": "SELECT count(*) FILTER (WHERE embedding IS NOT NULL) AS with_embedding, count(*) FILTER (WHERE embedding IS NULL) AS without_embedding FROM entities",
    "coverage_by_session": f"""WITH {FLAT}, s AS (SELECT DISTINCT session_id, session_date FROM sessions WHERE session_id IS NOT NULL)
        SELECT session_id, session_date, count(*) FILTER (WHERE length(trim(coalesce(full_text, ''), ' ')) > 0) AS with_text, count(*) FILTER (WHERE length(trim(coalesce(full_text, ''), ' ')) = 0) AS without_text
        FROM f JOIN s USING (session_id) GROUP BY ALL""",
    "backfill_report": """SELECT count(*) AS total, count(embedding) AS done, count(*) - count(embedding) AS missing, round(100.0 * count(embedding) / count(*), 1)::DOUBLE AS success_percent,
        CAST(ceil((count(*) - count(embedding)) / 100.0) AS BIGINT) AS batches FROM entities""",
    "embedding_backfill": f"SELECT entity_id, coalesce(canonical_name, '') || ' - ' || coalesce(description, '') AS embedding_text, {Settings.embedding_dimensions} AS dimensions FROM entities WHERE embedding IS NULL",
    "time_to_seconds": f"SELECT start_time, {_seconds('start_time')} AS seconds FROM (SELECT DISTINCT start_time FROM transcript_sentences)",
    "seconds_to_time": f"""WITH {FLAT} SELECT seconds, CASE WHEN seconds >= 3600 THEN (seconds // 3600) || 'h' ELSE '' END || CASE WHEN seconds >= 60 THEN ((seconds % 3600) // 60) || 'm' ELSE '' END || (seconds % 60) || 's' AS spelt
        FROM (SELECT DISTINCT timestamp_seconds AS seconds FROM f WHERE timestamp_seconds IS NOT NULL)""",
    "record_ids": """WITH x AS (
        SELECT 'session' AS kind, 's_' || coalesce(nullif(sitting_number, ''), 'unknown') || '_' || strftime(session_date, '%Y_%m_%d') AS built_id FROM sessions
        UNION ALL SELECT 'order_paper', 'op_' || CASE WHEN chamber = 'house' THEN 'h' ELSE 's' END || '_' || strftime(session_date, '%Y_%m_%d') FROM order_papers
        UNION ALL SELECT 'agenda_item', session_id || '_a' || agenda_item_index FROM speech_blocks)
        SELECT kind, built_id, count(*) AS n FROM x GROUP BY ALL""",
    "name_normalize": f"""WITH {_NAMES}, {_NORMS} SELECT names.name, ref.v AS normalized, word.v AS by_word,
        coalesce(string_split_regex(trim(lower(names.name)), '\\s+')[-1], '') AS surname, replace(ref.v, ' ', '-') || '-' || left(sha256(ref.v), 8) AS speaker_slug
        FROM names JOIN ref USING (name) JOIN word USING (name)""",
    "fuzzy_ratio_pairs": """WITH n AS (SELECT entity_id, lower(name) AS a, lower(canonical_name) AS b FROM entities),
        l AS (SELECT entity_id, a, b, list_reduce(list_filter(string_split(coalesce(a, ''), ''), lambda q: q <> ''), lambda row, x:
                list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc, CASE WHEN substr(b, j, 1) = x THEN coalesce(row[j - 1], 0) + 1 ELSE greatest(row[j], coalesce(acc[-1], 0)) END), []::BIGINT[]),
                list_transform(range(1, length(b) + 1), lambda j: 0::BIGINT)) AS r FROM n)
        SELECT entity_id, CAST(CASE WHEN length(a) + length(b) = 0 THEN 100 ELSE round_even(200.0 * coalesce(list_max(r), 0) / (length(a) + length(b)), 0) END AS INT) AS ratio FROM l""",
    "date_parse": """WITH d AS (SELECT DISTINCT session_id, session_date FROM sessions) SELECT session_id, CAST(k AS INT) AS notation, CASE WHEN k < 3 THEN strftime(session_date, '%Y-%m-%d') END AS iso_date FROM d, (SELECT unnest([0, 1, 2, 3]) AS k)""",
    "url_video_id": """WITH v AS (SELECT DISTINCT video_id FROM transcript_sentences WHERE video_id IS NOT NULL) SELECT video_id, CAST(k AS INT) AS form, CASE WHEN k < 2 THEN video_id END AS found_id FROM v, (SELECT unnest([0, 1, 2]) AS k)""",
    "filename_sanitize": "SELECT order_paper_id, regexp_replace(concat_ws('|', session_title, source_url), '[<>:\"/\\\\|?*\\x00-\\x1F]', '_', 'g') AS filename FROM order_papers",
    "segment_ids": f"""WITH {FLAT}, x AS (SELECT *, row_number() OVER (PARTITION BY video_id, timestamp_seconds IS NULL ORDER BY sentence_id) AS k FROM f)
        SELECT sentence_id, CASE WHEN timestamp_seconds IS NOT NULL THEN video_id || '_' || lpad(timestamp_seconds::VARCHAR, 5, '0') ELSE video_id || '_00000_c' || substr(lpad(k::VARCHAR, 2, '0'), 1, 2) END AS segment_id FROM x""",
    "truncated_json": "SELECT session_id, NOT ends_with(regexp_replace(raw_transcript_json, '\\s+$', ''), '}') AS truncated FROM (SELECT DISTINCT session_id, raw_transcript_json FROM sessions) WHERE raw_transcript_json IS NOT NULL",
    "fill_if_empty": "SELECT canonical_id, coalesce(nullif(role, ''), 'Member', role) AS role, coalesce(nullif(title, ''), nullif(role, ''), title) AS title FROM speakers",
    "prompt_lines": f"""WITH {PLACED} SELECT session_id, agenda_item_index, string_agg('[' || flat_index || '] ' || coalesce(speaker_name_original, '') || ': ' || coalesce(full_text, ''), chr(10) ORDER BY flat_index) AS prompt FROM p GROUP BY ALL""",
    "prompt_json": f"""WITH {FLAT}, o AS (SELECT session_id, agenda_item_index, speech_block_index, '{{' || string_agg(to_json(sentence_id::VARCHAR)::VARCHAR || ':' || to_json(coalesce(full_text, ''))::VARCHAR, ',' ORDER BY sentence_index, sentence_id) || '}}' AS prompt FROM f GROUP BY ALL) SELECT * FROM o""",
    "html_links": "SELECT order_paper_id, CASE WHEN trim(coalesce(session_title, '')) = '' THEN 'Session Paper 1' ELSE trim(regexp_replace(session_title, '\\s+', ' ', 'g')) END AS title, coalesce(source_url, 'https://example.invalid/files/' || order_paper_id) AS pdf_url, strftime(session_date, '%Y-%m-%d') AS session_date FROM order_papers",
    "speaker_exact_match": f"""WITH names AS (SELECT DISTINCT name FROM (SELECT name FROM speakers UNION ALL SELECT speaker_name FROM speech_blocks) WHERE name IS NOT NULL), ref AS (WITH {_normalized('reference')} SELECT * FROM norm),
        reg AS (SELECT ref.v, arg_min(canonical_id, (created_at, canonical_id)) AS canonical_id FROM speakers JOIN ref USING (name) GROUP BY ref.v)
        SELECT x.name, reg.canonical_id FROM (SELECT DISTINCT speaker_name AS name FROM speech_blocks WHERE speaker_name IS NOT NULL) x JOIN ref USING (name) JOIN reg ON reg.v = ref.v""",
    "resolve_pairs": "SELECT match_id, entity1, entity2, CASE WHEN coalesce(fuzzy_score >= 0.85 OR vector_score >= 0.85 OR hybrid_score >= 0.80, false) THEN 'merge' ELSE 'keep_separate' END AS decision FROM entity_matches",
    "dedup_statistics": f"""WITH RECURSIVE d AS (SELECT *, coalesce(fuzzy_score >= 0.85 OR vector_score >= 0.85 OR hybrid_score >= 0.80, false) AS ok FROM entity_matches), {_closure("SELECT entity1 AS a, entity2 AS b FROM d WHERE ok", _BORN)}
        SELECT count(*) AS pairs_checked, count(*) FILTER (WHERE ok) AS matches_found, count(*) FILTER (WHERE NOT ok) AS kept_separate, (SELECT count(*) FROM roots) AS entities_merged FROM d""",
    "metadata_values": "SELECT json_extract_string(meta_data, '$.origin') AS origin, count(*) AS n FROM speakers GROUP BY 1",
    "ingestion_counters": f"""WITH {FLAT} SELECT count(DISTINCT session_id) AS sessions, count(DISTINCT (session_id, agenda_item_index)) AS agenda_items, count(DISTINCT (session_id, agenda_item_index, speech_block_index)) AS blocks,
        count(*) AS sentences, count(DISTINCT speaker_name_original) AS labels, (SELECT count(DISTINCT session_id) FROM sessions WHERE raw_transcript_json IS NOT NULL) AS with_transcript FROM f""",
    "embedding_batches": "SELECT k // 100 AS batch, count(*) AS n_docs, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_letters, min(doc_id) AS first_doc FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents WHERE doc_id IS NOT NULL) GROUP BY 1",
    "dedup_components": f"WITH RECURSIVE {_ROOTS} SELECT * FROM roots",
    "entity_merge": f"""WITH RECURSIVE {_ROOTS}, d AS (SELECT e.*, coalesce(r.root_id, e.entity_id) AS keep_id FROM entities e LEFT JOIN roots r ON r.old_id = e.entity_id WHERE e.entity_id IS NOT NULL),
        a AS (SELECT keep_id, string_agg(DISTINCT x, '|' ORDER BY x) AS aliases FROM (SELECT keep_id, unnest(CASE WHEN entity_id = keep_id THEN coalesce(aliases, []) ELSE list_append(coalesce(aliases, []), canonical_name) END) AS x FROM d) WHERE x IS NOT NULL GROUP BY keep_id),
        m AS (SELECT keep_id, arg_min(canonical_name, (entity_id <> keep_id, created_at, entity_id)) AS canonical_name, first(description ORDER BY -length(coalesce(description, '')), entity_id <> keep_id, entity_id) AS description,
          max(confidence) FILTER (WHERE NOT isnan(confidence)) AS confidence, max(importance_score) AS importance_score, coalesce(string_agg(DISTINCT entity_id, '|' ORDER BY entity_id) FILTER (WHERE entity_id <> keep_id), '') AS merged_ids FROM d GROUP BY keep_id)
        , kv AS (SELECT keep_id, created_at, entity_id, meta_data, unnest(json_keys(meta_data)) AS k FROM d WHERE meta_data IS NOT NULL),
        mv AS (SELECT keep_id, k, arg_max(json_extract_string(meta_data, '$.' || k), (created_at, entity_id)) AS v FROM kv GROUP BY ALL), md AS (SELECT keep_id, string_agg(k || '=' || v, '|' ORDER BY k || '=' || v) AS meta_data FROM mv GROUP BY 1)
        SELECT m.keep_id AS entity_id, canonical_name, description, confidence, importance_score, coalesce(a.aliases, '') AS aliases, coalesce(md.meta_data, '') AS meta_data, merged_ids FROM m LEFT JOIN a USING (keep_id) LEFT JOIN md USING (keep_id)""",
    "entity_marks": f"WITH RECURSIVE {_ROOTS} SELECT DISTINCT old_id, root_id FROM roots JOIN entities ON entity_id = old_id",
    "vector_similarity": """SELECT match_id, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 5) AS cosine FROM entity_matches JOIN entities x ON x.entity_id = entity1 JOIN entities y ON y.entity_id = entity2
        WHERE len(x.embedding) = 768 AND len(y.embedding) = 768 AND len(list_filter(x.embedding, lambda v: v <> 0)) > 0 AND len(list_filter(y.embedding, lambda v: v <> 0)) > 0
        UNION ALL SELECT match_id, 0.0 FROM entity_matches JOIN entities x ON x.entity_id = entity1 JOIN entities y ON y.entity_id = entity2
        WHERE len(x.embedding) = 768 AND len(y.embedding) = 768 AND (len(list_filter(x.embedding, lambda v: v <> 0)) = 0 OR len(list_filter(y.embedding, lambda v: v <> 0)) = 0)""",
    "hybrid_candidates": f"""WITH e AS (SELECT entity_id, entity_type, coalesce(created_at, TIMESTAMP '1970-01-01') AS made, CASE WHEN len(embedding) = 768 AND len(list_filter(embedding, lambda v: v <> 0)) > 0 THEN embedding::DOUBLE[] END AS v,
          list_distinct(list_transform(list_filter([canonical_name, name] || coalesce(aliases, []), lambda x: x IS NOT NULL), lambda x: lower(x))) AS ns FROM entities WHERE entity_id IS NOT NULL AND entity_type IS NOT NULL),
        p AS (SELECT x.entity_id AS keep_id, y.entity_id AS merge_id, coalesce(list_cosine_similarity(x.v, y.v), 0) AS vector, x.ns AS xs, y.ns AS ys FROM e x JOIN e y ON x.entity_type = y.entity_type AND (x.made, x.entity_id) < (y.made, y.entity_id)),
        n AS (SELECT keep_id, merge_id, vector, a, unnest(ys) AS b FROM (SELECT *, unnest(xs) AS a FROM p)),
        u AS (SELECT DISTINCT a, b FROM n WHERE vector >= 0.7 OR 1 - levenshtein(a, b) / (length(a) + length(b)) >= 0.75), l AS (SELECT a, b, {_lcs_ratio("a", "b")} / 100.0 AS r FROM u),
        f AS (SELECT keep_id, merge_id, vector, max(coalesce(r, 0)) AS fuzzy FROM n LEFT JOIN l USING (a, b) GROUP BY ALL)
        SELECT keep_id, merge_id, round(fuzzy, 4) AS fuzzy, round(vector, 4) AS vector, round(0.3 * fuzzy + 0.7 * vector, 4) AS hybrid FROM f WHERE fuzzy >= 0.85 OR vector >= 0.85 OR 0.3 * fuzzy + 0.7 * vector >= 0.8""",
    "recent_entities": f"""WITH {FOUND}, o AS (SELECT session_id, agenda_item_index, chunk_index, entity_id, min(local_index) AS first_at FROM g GROUP BY ALL), h AS (SELECT DISTINCT session_id, agenda_item_index, chunk_index FROM o),
        w AS (SELECT h.*, o.entity_id, o.chunk_index AS c, o.first_at, row_number() OVER (PARTITION BY h.session_id, h.agenda_item_index, h.chunk_index ORDER BY o.chunk_index DESC, o.first_at DESC, o.entity_id DESC) AS k
          FROM h LEFT JOIN o ON o.session_id IS NOT DISTINCT FROM h.session_id AND o.agenda_item_index IS NOT DISTINCT FROM h.agenda_item_index AND o.chunk_index < h.chunk_index)
        SELECT session_id, agenda_item_index, CAST(chunk_index AS INT) AS chunk_index, coalesce(string_agg(entity_id, ',' ORDER BY c, first_at, entity_id), '') AS recent FROM w WHERE k <= 10 GROUP BY ALL""",
    "mention_remap": f"""WITH RECURSIVE {FOUND}, {_closure("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in MERGED_TERMS) + ") q(a, b)", "SELECT entity_id AS id, NULL::TIMESTAMP AS made FROM d")},
        m AS (SELECT DISTINCT entity_id, sentence_id FROM g) SELECT coalesce(root_id, entity_id) AS entity_id, sentence_id, count(*) AS n_mentions, count(root_id) AS updates FROM m LEFT JOIN roots ON old_id = entity_id GROUP BY ALL""",
    "agenda_extraction": f"""WITH {_REL}, n AS (SELECT session_id, agenda_item_index, count(DISTINCT chunk_index) AS n_chunks FROM c GROUP BY ALL), e AS (SELECT session_id, agenda_item_index, count(DISTINCT entity_id) AS n_entities, min(chunk_index) AS lowest FROM g GROUP BY ALL),
        later AS (SELECT g.session_id, g.agenda_item_index, count(DISTINCT g.chunk_index) AS n_with_context FROM g JOIN e USING (session_id, agenda_item_index) WHERE g.chunk_index > e.lowest GROUP BY ALL), q AS (SELECT session_id, agenda_item_index, count(*) AS n_relations FROM r GROUP BY ALL)
        SELECT session_id, agenda_item_index, n_chunks, coalesce(n_with_context, 0) AS n_with_context, n_entities, coalesce(n_relations, 0) AS n_relations FROM n JOIN e USING (session_id, agenda_item_index) LEFT JOIN later USING (session_id, agenda_item_index) LEFT JOIN q USING (session_id, agenda_item_index)""",
    "relationship_provenance": f"""WITH {_REL} SELECT r.session_id, p.video_id, p.timestamp_seconds AS evidence_timestamp_seconds, r.source_id, r.target_id, p.full_text AS evidence_quote, p.sentence_id, CAST(r.chunk_index AS INT) AS chunk_index, 'extraction' AS source
        FROM r JOIN p ON p.session_id = r.session_id AND p.agenda_item_index = r.agenda_item_index AND p.flat_index = 5 * r.chunk_index + r.local_index WHERE p.timestamp_seconds BETWEEN {FIRST_SECOND} AND {LAST_SECOND}""",
    "entity_defaults": "SELECT entity_id, coalesce(CASE WHEN NOT isnan(confidence) THEN confidence END, 0.5) AS confidence, CAST(coalesce(len(aliases), 0) AS INT) AS n_aliases, coalesce(description, '') AS description FROM entities",
    "speaker_first_seen": f"""WITH {FLAT} SELECT session_id, speaker_name_original, first(sentence_id ORDER BY agenda_item_index NULLS FIRST, speech_block_index NULLS FIRST, sentence_index NULLS FIRST, sentence_id) AS sentence_id FROM f WHERE speaker_name_original IS NOT NULL GROUP BY ALL""",
    "entities_by_age": "SELECT entity_id, created_at FROM entities ORDER BY created_at, entity_id",
    "unspoken_lookup": "SELECT block_id, session_id, speaker_name FROM speech_blocks WHERE speaker_name IS NULL OR speaker_name = 'Unknown Speaker'",
    "ingest_success": """WITH x AS (SELECT chamber, raw_transcript_json IS NOT NULL AND ends_with(regexp_replace(raw_transcript_json, '\\s+$', ''), '}') AS ok FROM sessions)
        SELECT chamber, count(*) AS n_results, count(*) FILTER (WHERE ok) AS n_success, count(*) FILTER (WHERE NOT ok) AS n_failed FROM x GROUP BY 1""",
    "end_seconds": "SELECT DISTINCT session_id, try_cast(sitting_number AS BIGINT) AS minutes, CASE WHEN try_cast(sitting_number AS BIGINT) <> 0 THEN 60 * try_cast(sitting_number AS BIGINT) END AS end_second FROM sessions",
    "paper_headers": "SELECT order_paper_id AS record_id, session_title, sitting_number, session_date FROM order_papers",
    "transcript_requests": f"""WITH v AS (SELECT DISTINCT video_id, session_id FROM transcript_sentences WHERE video_id IS NOT NULL), s AS (SELECT session_id, min(session_date) AS d, min(chamber) AS c, min(sitting_number) AS n FROM sessions GROUP BY 1)
        SELECT video_id, session_id, to_json({{prompt: 'Write down what is said in this recording of a session, by agenda item, speaker and sentence, each sentence with the time at which it begins (XhYmZs).' || coalesce(chr(10) || 'Chamber: ' || nullif(c, ''), '') || coalesce(chr(10) || 'Date: ' || d::VARCHAR, '')
          || coalesce(chr(10) || 'Sitting: ' || nullif(n, ''), '') || chr(10) || 'Answer with one JSON object of this form and nothing else: {TRANSCRIPT}', url: 'https://example.invalid/watch?v=' || video_id, fps: 0.5::DOUBLE, end_second: 600, quality: 'low'}})::VARCHAR AS request FROM v JOIN s USING (session_id)""",
    "session_snapshot": f"""WITH {FLAT}, b1 AS (SELECT session_id, agenda_item_index, speech_block_index, min(speaker_name_original) AS speaker_name, min(topic_title) AS topic_title,
          list({{i: sentence_index, start_second: timestamp_seconds, text: full_text}} ORDER BY sentence_index, timestamp_seconds NULLS FIRST, full_text NULLS FIRST) AS sentences FROM f GROUP BY 1, 2, 3),
        a1 AS (SELECT session_id, agenda_item_index, min(topic_title) AS topic_title, list({{speech_block_index: speech_block_index, speaker_name: speaker_name, sentences: sentences}} ORDER BY speech_block_index) AS speech_blocks FROM b1 GROUP BY 1, 2)
        SELECT session_id, to_json({{agenda_items: list({{agenda_item_index: agenda_item_index, topic_title: topic_title, speech_blocks: speech_blocks}} ORDER BY agenda_item_index)}})::VARCHAR AS document FROM a1 GROUP BY 1""",
    "speaker_match": f"""WITH said AS (SELECT DISTINCT name, role FROM (SELECT speaker_name AS name, NULL AS role FROM speech_blocks UNION ALL SELECT unnest(aliases), role FROM speakers) WHERE name IS NOT NULL),
        names AS (SELECT name FROM said UNION SELECT name FROM speakers WHERE name IS NOT NULL), ref AS (WITH {_normalized('reference')} SELECT * FROM norm),
        q AS (SELECT said.name, role, v AS norm, nullif(lower(role), '') AS qrole FROM said JOIN ref USING (name)), reg AS (SELECT canonical_id, speakers.name AS rname, v AS norm, nullif(lower(role), '') AS rrole, created_at FROM speakers JOIN ref USING (name)),
        ex AS (SELECT norm, arg_min(canonical_id, (created_at, canonical_id)) AS exact_id FROM reg GROUP BY 1), rest AS (SELECT * FROM q WHERE norm NOT IN (SELECT norm FROM ex)),
        duo AS (SELECT rest.name, rest.role, rest.norm AS a, reg.norm AS b, qrole, rrole, canonical_id, created_at FROM rest JOIN reg ON 1 - levenshtein(rest.norm, reg.norm) / greatest(1, length(rest.norm) + length(reg.norm)) >= 0.7),
        l AS (SELECT a, b, {_lcs_ratio("a", "b")} AS r FROM (SELECT DISTINCT a, b FROM duo UNION SELECT DISTINCT qrole, rrole FROM rest, (SELECT DISTINCT rrole FROM reg WHERE rrole IS NOT NULL) WHERE qrole IS NOT NULL)),
        sc AS (SELECT duo.*, l.r AS ratio, m.r AS rr FROM duo JOIN l USING (a, b) LEFT JOIN l m ON m.a = qrole AND m.b = rrole WHERE l.r >= 80),
        ok AS (SELECT *, row_number() OVER w AS k, lead(ratio) OVER w AS second FROM sc WHERE rr IS NULL OR rr >= 50 WINDOW w AS (PARTITION BY name, role ORDER BY ratio DESC, created_at, canonical_id)),
        fz AS (SELECT name, role, CASE WHEN second IS NULL OR ratio - second >= 5 OR coalesce(rr >= 70, false) THEN canonical_id END AS fuzzy_id FROM ok WHERE k = 1 AND ratio >= 85),
        last AS (SELECT n, coalesce(string_split_regex(trim(lower(n)), '\\s+')[-1], '') AS sur FROM (SELECT name AS n FROM names)),
        st AS (SELECT rest.name, rest.role, arg_min(canonical_id, (created_at, canonical_id)) AS surname_id FROM rest JOIN last x ON x.n = rest.name JOIN last y ON y.sur = x.sur JOIN reg ON reg.rname = y.n JOIN l ON l.a = qrole AND l.b = rrole WHERE l.r >= 70 GROUP BY 1, 2)
        SELECT q.name, q.role, exact_id AS canonical_id, 'exact' AS stage FROM q JOIN ex USING (norm)
        UNION ALL SELECT rest.name, rest.role, CASE WHEN fz.name IS NOT NULL THEN fuzzy_id ELSE surname_id END, CASE WHEN fuzzy_id IS NOT NULL THEN 'fuzzy' WHEN fz.name IS NULL AND surname_id IS NOT NULL THEN 'surname' END
        FROM rest LEFT JOIN fz ON fz.name = rest.name AND fz.role IS NOT DISTINCT FROM rest.role LEFT JOIN st ON st.name = rest.name AND st.role IS NOT DISTINCT FROM rest.role""",
    "speaker_registry": f"""WITH names AS (SELECT DISTINCT name FROM (SELECT name FROM speakers UNION ALL SELECT speaker_name FROM speech_blocks) WHERE name IS NOT NULL), ref AS (WITH {_normalized('reference')} SELECT * FROM norm),
        first_of AS (SELECT ref.v, arg_min(canonical_id, (created_at, canonical_id)) AS canonical_id FROM speakers JOIN ref USING (name) GROUP BY ref.v),
        s AS (SELECT session_id, min(chamber) AS chamber FROM sessions WHERE session_id IS NOT NULL GROUP BY 1),
        met AS (SELECT f.canonical_id, b.session_id, nullif(s.chamber, '') AS chamber, b.created_at FROM speech_blocks b JOIN ref ON ref.name = b.speaker_name JOIN first_of f ON f.v = ref.v JOIN s USING (session_id)),
        g AS (SELECT canonical_id, first(chamber ORDER BY created_at NULLS FIRST, chamber) FILTER (WHERE chamber IS NOT NULL) AS c, list(DISTINCT session_id) AS ids FROM met GROUP BY 1)
        SELECT canonical_id, coalesce(nullif(chamber, ''), c, chamber) AS chamber, coalesce(array_to_string(list_sort(list_distinct(list_filter(coalesce(session_ids, []) || coalesce(ids, []), lambda x: x IS NOT NULL))), '|'), '') AS sessions FROM speakers LEFT JOIN g USING (canonical_id)""",
    "search_vector_backfill": f"""WITH {FLAT}, {_lexemes("f", "sentence_id", "full_text")}, per AS (SELECT sentence_id, stem, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS ps FROM lex GROUP BY ALL), v AS (SELECT sentence_id, string_agg(chr(39) || stem || chr(39) || ':' || ps, ' ' ORDER BY stem) AS x FROM per GROUP BY 1)
        SELECT sentence_id, coalesce(x, '') AS search_vector FROM f LEFT JOIN v USING (sentence_id)""",
    "cosine_topk": """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0 AND len(embedding) = 64), x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = 64),
        s AS (SELECT query_id, vec_id, round(1 - list_cosine_similarity(q.e, x.e), 6) + 0.0 AS distance FROM q, x), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM s)
        SELECT query_id, vec_id, distance, CAST(place AS INT) AS place FROM o WHERE place <= 20""",
    "mention_locate": f"""WITH {FOUND} SELECT DISTINCT entity_id, sentence_id, session_id, agenda_item_index, speech_block_index, sentence_index, video_id, timestamp_seconds, left(full_text, 200) AS context, speaker_name_original AS speaker, 'direct' AS mention_type FROM g""",
    "mention_full_sentence": f"""WITH {FOUND}, m AS (SELECT DISTINCT entity_id, session_id, agenda_item_index, speech_block_index, sentence_index FROM g)
        SELECT m.*, f.sentence_id, f.full_text, f.speaker_name_original FROM m JOIN f USING (session_id, agenda_item_index, speech_block_index, sentence_index)""",
    "mention_counts": f"WITH {FOUND} SELECT entity_id, count(DISTINCT sentence_id) AS n_mentions, count(DISTINCT session_id) AS n_sessions, min(session_id) AS first_session FROM g GROUP BY entity_id",
    "relationship_validate": f"""WITH {_REL}, z AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE local_index < 3) AS early, count(*) FILTER (WHERE local_index > 4) AS late FROM r GROUP BY session_id)
        SELECT session_id, reason, CASE reason WHEN 'sentiment' THEN early WHEN 'confidence' THEN late ELSE n END AS n FROM z, (SELECT unnest(['valid', 'unknown source', 'unknown target', 'relation type', 'sentiment', 'confidence']) AS reason)
        WHERE CASE reason WHEN 'sentiment' THEN early WHEN 'confidence' THEN late ELSE n END > 0""",
    "relationship_unique": f"""WITH {_REL}, w AS (SELECT r.source_id, r.target_id, 'relates_to' AS relation_type, r.session_id, p.sentence_id, p.speech_block_index, p.sentence_index,
          row_number() OVER (PARTITION BY r.source_id, r.target_id, r.session_id ORDER BY p.sentence_id) AS k
        FROM r JOIN p ON p.session_id = r.session_id AND p.agenda_item_index = r.agenda_item_index AND p.flat_index = 5 * r.chunk_index + r.local_index)
        SELECT source_id, target_id, relation_type, session_id, sentence_id, speech_block_index, sentence_index FROM w WHERE k = 1""",
    "ensure_entities": "SELECT id AS entity_id, id AS name, 'unknown' AS entity_type FROM (SELECT entity1 AS id FROM entity_matches UNION SELECT entity2 FROM entity_matches) WHERE id IS NOT NULL AND id NOT IN (SELECT entity_id FROM entities WHERE entity_id IS NOT NULL)",
    "entity_upsert": """WITH o AS (SELECT entity_id, canonical_name, entity_type, false AS created, list_distinct(list_filter(list_append(coalesce(aliases, []), canonical_name), lambda x: x IS NOT NULL)) AS al FROM entities
          UNION ALL SELECT 'new_' || entity_id, canonical_name, entity_type, true, list_distinct(list_filter(coalesce(aliases, []), lambda x: x IS NOT NULL)) FROM entities)
        SELECT entity_id, canonical_name, entity_type, created, array_to_string(list_sort(al), '|') AS aliases FROM o""",
    "invalid_entities": """WITH j AS (SELECT entity_id, CASE WHEN coalesce(trim(canonical_name), '') = '' THEN 'canonical_name'
          WHEN coalesce(entity_type, '') NOT IN ('person','organization','place','law','concept','event','agenda_item','procedural_step','numeric_fact','policy_position') THEN 'entity_type'
          WHEN confidence IS NOT NULL AND (isnan(confidence) OR confidence NOT BETWEEN 0 AND 1) THEN 'confidence'
          WHEN importance_score IS NOT NULL AND (isnan(importance_score) OR importance_score NOT BETWEEN 0 AND 1) THEN 'importance_score' END AS reason FROM entities)
        SELECT entity_id, reason FROM j WHERE reason IS NOT NULL""",
    "relationship_remap": f"""WITH RECURSIVE {_ROOTS}, l AS (SELECT match_id, coalesce(s.root_id, entity1) AS source_id, coalesce(t.root_id, entity2) AS target_id, CAST((s.root_id IS NOT NULL)::INT + (t.root_id IS NOT NULL)::INT AS INT) AS updates, hybrid_score
          FROM entity_matches LEFT JOIN roots s ON s.old_id = entity1 LEFT JOIN roots t ON t.old_id = entity2),
        k AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY hybrid_score DESC NULLS LAST, match_id) AS n FROM l)
        SELECT match_id, source_id, target_id, updates FROM k WHERE n = 1""",
    "cascade_delete": f"""WITH gone AS (SELECT DISTINCT session_id FROM sessions WHERE ends_with(coalesce(sitting_number, ''), '{GONE_DIGIT}') AND session_id IS NOT NULL),
        a AS (SELECT session_id FROM (SELECT DISTINCT session_id, agenda_item_index FROM speech_blocks))
        SELECT 'sessions' AS table_name, count(*) AS n_rows, count(session_id) AS n_with_session FROM sessions WHERE session_id IS NULL OR session_id NOT IN (SELECT session_id FROM gone)
        UNION ALL SELECT 'transcript_sentences', count(*), count(session_id) FROM transcript_sentences WHERE session_id IS NULL OR session_id NOT IN (SELECT session_id FROM gone)
        UNION ALL SELECT 'agenda_items', count(*), count(session_id) FROM a WHERE session_id IS NULL OR session_id NOT IN (SELECT session_id FROM gone)
        UNION ALL SELECT 'relationships', count(*), count(CASE WHEN session_id NOT IN (SELECT session_id FROM gone) THEN session_id END) FROM documents""",
    "insert_if_absent": f"""SELECT DISTINCT session_id, session_date, title FROM sessions WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT session_id FROM sessions WHERE session_date < DATE '{EXISTING_BEFORE}' AND session_id IS NOT NULL)""",
    "keyed_update": """SELECT e.entity_id, coalesce(m.h, CASE WHEN NOT isnan(e.confidence) THEN e.confidence END) AS confidence FROM entities e LEFT JOIN (SELECT entity1, max(hybrid_score) AS h FROM entity_matches GROUP BY entity1) m ON m.entity1 = e.entity_id""",
    "keyword_search": f"""WITH {_lexemes("documents", "doc_id", "text")}, q AS (SELECT * FROM (VALUES {', '.join(f"('{w}')" for w in KEYWORDS.split())}) t(word)), {_stems("SELECT word FROM q").replace("w0 AS", "z0 AS").replace("FROM w", "FROM z").replace(", w", ", z").replace("stems AS", "terms AS")},
        h AS (SELECT DISTINCT doc_id, terms.word, pos FROM lex JOIN terms ON lex.stem = terms.stem), al AS (SELECT doc_id FROM h GROUP BY 1 HAVING count(DISTINCT word) = {len(KEYWORDS.split())}),
        d AS (SELECT x.doc_id, abs(x.pos - y.pos) AS far FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.word < y.word), r AS (SELECT doc_id, 1 - product(1 - 0.1 / sqrt(1.005 + 0.05 * exp(far / 1.5 - 2))) FILTER (WHERE far BETWEEN 1 AND 100) AS x FROM d GROUP BY 1)
        SELECT doc_id, round(coalesce(x, 0), 6) AS rank FROM al LEFT JOIN r USING (doc_id) ORDER BY rank DESC, doc_id LIMIT 20""",
    "ilike_search": f"SELECT doc_id FROM documents WHERE text ILIKE '{LIKE}'",
    "lexeme_counts": f"""WITH {FLAT}, {_lexemes("f", "sentence_id", "full_text")} SELECT stem AS lexeme, count(DISTINCT sentence_id) AS n_docs, count(*) AS n_hits FROM lex GROUP BY 1""",
    "usage_rollup": """SELECT event_type AS stage, CASE WHEN value < 50 THEN 'small' ELSE 'large' END AS model, count(*) AS calls, round(sum(value), 2) AS total, round(avg(value), 4) AS mean, round(max(value), 2) AS longest, coalesce(sum(try_cast(json_extract_string(props, '$.k') AS BIGINT)), 0)::BIGINT AS prompt_tokens,
        coalesce(sum(user_id), 0)::BIGINT AS output_tokens, coalesce(sum(try_cast(json_extract_string(props, '$.k') AS BIGINT) + user_id), 0)::BIGINT AS total_tokens FROM events GROUP BY ALL""",
    "rate_window": """WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS second FROM events WHERE ts IS NOT NULL), w AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY second RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_window FROM e)
        SELECT event_id, user_id, second, in_window, in_window > 2 AS over_limit FROM w""",
}
