"""Keyword, pattern and vector search over whole tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.functions.search import beginning, lexemes, matches, placed_words, query_terms, rank_all, stem, vector_text
from plenum.runtime import received, ship

#: Query vectors that one pass over the table serves.
QUERY_BLOCK = 4096
#: Shares that a query's finds are ranked in before they meet.
SHARES = 32


def keyword(docs: DataFrame, key: str, text: str, query: str, top: int = 20) -> DataFrame:
    """The ``top`` rows that hold the stems of all terms of ``query``, by rank (``rank_all``), then key. A query of stop words finds nothing."""
    terms = query_terms(query)
    stems = list(dict.fromkeys(docs.sparkSession.range(1).select(*[stem(F.lit(t)).alias(f"t{i}") for i, t in enumerate(terms)]).first())) if terms else []
    df = docs.select(key, text)
    for s in stems:  # before any word is cut to its stem
        df = df.filter(F.contains(F.lower(text), F.lit(beginning(s))))
    # bound once: the filter and the rank both read it
    df = df.withColumn("vector", F.explode(F.array(lexemes(F.col(text))))).filter(matches(F.col("vector"), stems))
    return df.select(key, F.round(rank_all(F.col("vector"), stems), 6).alias("rank")).orderBy(F.desc("rank"), key).limit(top)


def pattern(docs: DataFrame, key: str, text: str, like: str) -> DataFrame:
    """The rows whose text matches ``like`` in any case."""
    return docs.filter(F.col(text).ilike(like)).select(key, text)


def lookup(df: DataFrame, **equal: object) -> DataFrame:
    """The rows whose columns have the given values; a value None finds the rows where the column is null."""
    for column, value in equal.items():
        df = df.filter(F.col(column).isNull() if value is None else F.col(column) == value)
    return df


def text_vectors(df: DataFrame, text: str, out: str = "search_vector") -> DataFrame:
    """``df`` with the text vector of ``text`` in ``out``; a null text has an empty one."""
    return df.withColumn(out, vector_text(lexemes(F.col(text))))


def hits(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lexeme, position) of every word that is no stop word; each distinct word is cut to its stem once."""
    words = docs.select(key, F.explode(placed_words(F.col(text))).alias("x")).select(key, F.col("x.lexeme").alias("word"), F.col("x.position").alias("position"))
    stems = words.select("word").distinct().withColumn("lexeme", stem(F.col("word")))
    return words.join(stems, "word").select(key, "lexeme", "position")


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(lexeme, key, positions): the inverted index of a text column."""
    return hits(docs, key, text).groupBy("lexeme", key).agg(F.sort_array(F.collect_list("position")).alias("positions"))


def nearest(table: DataFrame, queries: DataFrame, key: str, vector: str, dim: int, top: int = 20) -> DataFrame:
    """(query_id, key, distance, place): the ``top`` nearest rows of every query vector by cosine distance, exactly.

    The queries are taken in blocks of ``QUERY_BLOCK``, each broadcast (its size is bounded by that) and multiplied with every
    batch of the table; only the best of a batch leave it. Vectors that are null, of another length or zero take no part;
    at distances equal to six decimals the smaller key is nearer.
    """
    spark = table.sparkSession
    usable = lambda df: df.select(key, vector).filter(f"size({vector}) = {dim} AND exists({vector}, x -> x <> 0) AND forall({vector}, x -> x IS NOT NULL)")
    kind = table.schema[key].dataType.simpleString()
    it, block, parts = usable(queries).toLocalIterator(prefetchPartitions=True), [], []

    def flush(rows):
        ids = np.array([r[0] for r in rows])
        q = np.array([r[1] for r in rows], "f8")
        q /= np.linalg.norm(q, axis=1)[:, None]
        sent = ship(spark, (ids, q))
        parts.append(usable(table).mapInArrow(_near(sent, dim, top), f"query_id {kind}, {key} {kind}, distance double"))

    for row in it:
        block.append(row)
        if len(block) == QUERY_BLOCK:
            flush(block)
            block = []
    if block:
        flush(block)
    if not parts:
        return spark.createDataFrame([], f"query_id {kind}, {key} {kind}, distance double, place int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", key))), 1, top)
    # first the best of each share of the batches, then of those: no group holds more than its share's batches
    part = found.groupBy("query_id", F.pmod(F.xxhash64(key), F.lit(SHARES)).alias("_s")).agg(best.alias("b")).select("query_id", F.explode("b").alias("x")).select("query_id", "x.*")
    return part.groupBy("query_id").agg(best.alias("b")).select("query_id", F.posexplode("b").alias("place", "x")).select("query_id", f"x.{key}", "x.distance", (F.col("place") + 1).alias("place"))


def _near(sent, dim: int, top: int):
    def run(batches):
        qid, q = received(sent)
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)
            x /= np.linalg.norm(x, axis=1)[:, None]
            by = np.argsort(ids, kind="stable")
            far = np.round(1 - q @ x[by].T, 6)
            order = np.argsort(far, axis=1, kind="stable")[:, :top]
            names = ids[by]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, order.shape[1])), pa.array(names[order].ravel()), pa.array(np.take_along_axis(far, order, 1).ravel() + 0.0)], names=["query_id", b.schema.names[0], "distance"])

    return run
