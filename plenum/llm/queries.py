"""Queries pN_... of the llm operators and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plenum.llm import components, fusion, language, mixing, names, near_copies, tokens, turns, vectors
from plenum.llm.own_text import PLACEHOLDERS, STOCK_ROWS
from plenum.runtime import cut, table


def _turn_tables(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, base, "transcript_sentences"), table(spark, base, "speech_blocks"), table(spark, base, "speakers")


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return turns.turn_ends(*_turn_tables(spark, base))


def p1_turns(spark: SparkSession, base: str) -> DataFrame:
    """The clean turns with speaker, times and text."""
    return turns.turns(*_turn_tables(spark, base))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return names.linked(table(spark, base, "speakers"), table(spark, base, "speech_blocks"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return vectors.neighbour_pairs(table(spark, base, "entities"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return components.connected_components(table(spark, base, "entity_matches"), "entity1", "entity2")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return near_copies.near_pairs(table(spark, base, "entities"))


def p4_classes(spark: SparkSession, base: str) -> DataFrame:
    """Each record's class of equal word sets and the number of other classes near it."""
    return near_copies.near_classes(table(spark, base, "entities"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    won = fusion.fuse(table(spark, base, "entities"), cut(p6_found(spark, base)), strict=True)
    return won.select("group_id", "field_name", "entity_id")


def p7_fused(spark: SparkSession, base: str) -> DataFrame:
    """The same groups where the sources' evidence may overrule the stated preference, with posteriors."""
    return fusion.fuse(table(spark, base, "entities"), cut(p6_found(spark, base)))


def p7_records(spark: SparkSession, base: str) -> DataFrame:
    return fusion.fused_records(table(spark, base, "entities"), cut(p6_found(spark, base)))


def p7_aliases(spark: SparkSession, base: str) -> DataFrame:
    return fusion.group_aliases(table(spark, base, "entities"), cut(p6_found(spark, base)))


def p7_fused_aliases(spark: SparkSession, base: str) -> DataFrame:
    """Which aliases of a group its sources make believed."""
    return fusion.fused_aliases(table(spark, base, "entities"), cut(p6_found(spark, base)))


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    return tokens.encode(table(spark, base, "documents"))


def p8_round_trip(spark: SparkSession, base: str) -> DataFrame:
    """Every document's text as its ids decode to it."""
    return tokens.decode(tokens.encode(table(spark, base, "documents")))


def p9_filled(spark: SparkSession, base: str) -> DataFrame:
    """The shares of a mixture of all the tokens that there are: capped sources are used up, the others share the rest."""
    docs, targets = table(spark, base, "documents"), table(spark, base, "mix_targets")
    return mixing.shares(docs, targets, total=mixing.available(docs, targets))


def p9_mixture(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mixture(table(spark, base, "documents"), table(spark, base, "mix_targets"))


def p9_shares(spark: SparkSession, base: str) -> DataFrame:
    return mixing.shares(table(spark, base, "documents"), table(spark, base, "mix_targets"))


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return language.corrected_labels(table(spark, base, "documents"), table(spark, base, "lang_samples"))


def p10_documents(spark: SparkSession, base: str) -> DataFrame:
    """Every language of every document, with its confidence."""
    return language.document_languages(table(spark, base, "documents"), table(spark, base, "lang_samples"))


def p10_segments(spark: SparkSession, base: str) -> DataFrame:
    return language.document_segments(table(spark, base, "documents"), table(spark, base, "lang_samples"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_turns, p2_found, p3_found, p4_found, p4_classes, p6_found, p7_found, p7_fused, p7_records, p7_aliases, p7_fused_aliases, p8_ids, p8_round_trip, p9_mixture, p9_shares, p9_filled, p10_found, p10_documents, p10_segments)
}

_PLACEHOLDERS = ", ".join(f"'{p}'" for p in PLACEHOLDERS)
#: Common table o: records with a description of their own, ``own``.
_OWN = f"""n AS (SELECT *, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS t FROM entities WHERE entity_id IS NOT NULL),
    h AS (SELECT *, CASE WHEN regexp_matches(t, '[\\p{{L}}\\p{{N}}]') AND regexp_replace(lower(t), '[ .!]+$', '') NOT IN ({_PLACEHOLDERS}) THEN t END AS d FROM n),
    w AS (SELECT lower(d) AS k, unnest(list_append(list_distinct(regexp_extract_all(lower(canonical_name), '[\\p{{L}}\\p{{N}}]+')), '')) AS w FROM h WHERE d IS NOT NULL),
    v AS (SELECT k, w, count(*) AS c FROM w GROUP BY ALL),
    st AS (SELECT k FROM (SELECT k, max(c) FILTER (WHERE w = '') AS n, coalesce(max(c) FILTER (WHERE w <> ''), 0) AS m FROM v GROUP BY k) WHERE n >= {STOCK_ROWS} AND m <= greatest(1, n / 2.0)),
    o AS (SELECT *, CASE WHEN lower(d) NOT IN (SELECT k FROM st) THEN d END AS own FROM h)"""
_GROUPS = """e AS (
          SELECT entity1 AS a, entity2 AS b FROM entity_matches WHERE entity1 IS NOT NULL AND entity2 IS NOT NULL
          UNION SELECT entity2, entity1 FROM entity_matches WHERE entity1 IS NOT NULL AND entity2 IS NOT NULL),
        ids AS (SELECT entity1 AS id FROM entity_matches WHERE entity1 IS NOT NULL UNION SELECT entity2 FROM entity_matches WHERE entity2 IS NOT NULL),
        r(id, other) AS (SELECT id, id FROM ids UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
        g AS (SELECT id AS entity_id, min(other) AS group_id FROM r GROUP BY id)"""

ORACLES: dict[str, str] = {
    "p3_found": """WITH x AS (SELECT entity_id AS id, embedding::DOUBLE[] AS e FROM entities WHERE len(embedding) = 768 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
        s AS (SELECT q.id AS a, x.id AS b, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.e, x.e), 6) DESC, x.id) AS k FROM x q JOIN x ON q.id <> x.id)
        SELECT DISTINCT least(a, b) AS entity_id_a, greatest(a, b) AS entity_id_b FROM s WHERE k <= 5""",
    "p4_found": f"""WITH {_OWN}, s AS (SELECT entity_id, list_distinct(regexp_extract_all(lower(concat_ws(' ', canonical_name, description, array_to_string(aliases, ' '))), '[\\p{{L}}\\p{{N}}]+')) AS ws FROM o WHERE own IS NOT NULL),
        j AS (SELECT x.entity_id AS a, y.entity_id AS b, len(list_intersect(x.ws, y.ws)) AS c, len(x.ws) + len(y.ws) AS t FROM s x JOIN s y ON x.entity_id < y.entity_id AND least(len(x.ws), len(y.ws)) >= 0.7 * greatest(len(x.ws), len(y.ws)))
        SELECT a AS entity_id_a, b AS entity_id_b FROM j WHERE c >= 0.7 * (t - c) - 1e-9""",
    "p4_classes": f"""WITH {_OWN}, s AS (SELECT entity_id, list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', canonical_name, description, array_to_string(aliases, ' '))), '[\\p{{L}}\\p{{N}}]+'))) AS ws FROM o WHERE own IS NOT NULL),
        c AS (SELECT ws, min(entity_id) AS rep, count(*) AS copies FROM s WHERE len(ws) > 0 GROUP BY 1),
        j AS (SELECT x.rep, len(list_intersect(x.ws, y.ws)) AS c, len(x.ws) + len(y.ws) AS t FROM c x JOIN c y ON x.rep <> y.rep AND least(len(x.ws), len(y.ws)) >= 0.7 * greatest(len(x.ws), len(y.ws))),
        l AS (SELECT rep, count(*) AS links FROM j WHERE c >= 0.7 * (t - c) - 1e-9 GROUP BY 1)
        SELECT s.entity_id, c.rep AS class_id, c.copies, coalesce(l.links, 0) AS links FROM s JOIN c USING (ws) LEFT JOIN l ON l.rep = c.rep""",
    "p6_found": f"WITH RECURSIVE {_GROUPS} SELECT entity_id, group_id FROM g",
    "p7_found": f"""WITH RECURSIVE {_GROUPS}, {_OWN}, m AS (SELECT g.group_id, o.*, CASE WHEN NOT isnan(confidence) AND confidence BETWEEN 0 AND 1 THEN confidence END AS c,
          count(*) OVER (PARTITION BY g.group_id) AS size FROM g JOIN o ON o.entity_id = g.entity_id),
        f AS (SELECT group_id, 'description' AS field_name, entity_id, row_number() OVER (PARTITION BY group_id ORDER BY length(own) DESC, c DESC NULLS LAST, updated_at DESC NULLS LAST, entity_id) AS k FROM m WHERE size > 1 AND own IS NOT NULL
          UNION ALL SELECT group_id, 'confidence', entity_id, row_number() OVER (PARTITION BY group_id ORDER BY c DESC, updated_at DESC NULLS LAST, entity_id) FROM m WHERE size > 1 AND c IS NOT NULL)
        SELECT group_id, field_name, entity_id FROM f WHERE k = 1""",
    "p7_aliases": f"""WITH RECURSIVE {_GROUPS}, m AS (SELECT g.group_id, x.entity_id, x.aliases, count(*) OVER (PARTITION BY g.group_id) AS size FROM g JOIN entities x ON x.entity_id = g.entity_id),
        a AS (SELECT group_id, entity_id, trim(unnest(aliases)) AS alias FROM m WHERE size > 1)
        SELECT group_id, alias, count(DISTINCT entity_id) AS n_records FROM a WHERE alias <> '' GROUP BY ALL""",
    "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
ORACLES["p7_records"] = f"""WITH RECURSIVE w AS ({ORACLES["p7_found"]}), d AS (SELECT group_id, entity_id FROM w WHERE field_name = 'description'), c AS (SELECT group_id, entity_id FROM w WHERE field_name = 'confidence')
    SELECT coalesce(d.group_id, c.group_id) AS group_id, x.description, d.entity_id AS description_from, y.confidence, c.entity_id AS confidence_from
    FROM d FULL JOIN c USING (group_id) LEFT JOIN entities x ON x.entity_id = d.entity_id LEFT JOIN entities y ON y.entity_id = c.entity_id"""
