"""Providers of what models do elsewhere: embeddings, extraction, resolution. Each is called once per Arrow batch.

The defaults need no network: embeddings are hashed word counts, entities come from a dictionary of terms, relations from
co-occurrence in a sentence, pairs are resolved by the thresholds. A service is plugged in by a callable of the same shape;
``retrying`` asks again after a failure, an ``Allowance`` per lane keeps all workers together within the service's limit.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.settings import Settings

Embedder = Callable[[list[str]], list[list[float]]]


def hashed_embedder(dim: int = Settings.embedding_dimensions) -> Embedder:
    """Unit vectors of signed hashed word counts: the same text has the same vector on every run."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim), "f4")
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n == 0, 1, n)).tolist()

    return embed


def retrying(call: Callable, attempts: int = 3, pause: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` tried up to ``attempts`` times, waiting ``pause`` x attempt between them."""

    def run(*args, **kw):
        for n in range(1, attempts + 1):
            try:
                return call(*args, **kw)
            except Exception:
                if n == attempts:
                    raise
                sleep(pause * n)

    return run


class Allowance:
    """A bucket that holds up to ``most`` tokens and gains ``rate`` a second; ``take`` waits for what is missing."""

    def __init__(self, rate: float, most: float = 1.0, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.most, self.clock, self.sleep = rate, most, clock, sleep
        self.level, self.filled_at = most, clock()

    def take(self, tokens: float = 1.0) -> float:
        """Seconds waited. The level may fall below nought; the wait makes up for it."""
        now = self.clock()
        self.level = min(self.most, self.level + self.rate * (now - self.filled_at)) - tokens
        self.filled_at = now
        wait = max(0.0, -self.level / self.rate)
        if wait:
            self.sleep(wait)
        return wait


def lanes_of(calls: int, period: float, cores: int) -> tuple[int, float]:
    """(lanes, rate of each): so many partitions may call at once that all together stay within ``calls`` per ``period``.

    Each lane starts with one token; the rest of the calls is what the lanes gain within a period.
    """
    lanes = max(1, min(cores, calls // 2))
    return lanes, max(calls - lanes, 1) / (period * lanes)


def embed(df: DataFrame, text: str, embedder: Embedder | None = None, batch: int = 32, out: str = "embedding") -> DataFrame:
    """``df`` with the vector of ``text`` in ``out``; the provider gets ``batch`` texts a call, null texts have no vector."""
    use = embedder or hashed_embedder(Settings.read().embedding_dimensions)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            todo = [i for i, t in enumerate(texts) if t is not None]
            made: list = [None] * len(texts)
            for s in range(0, len(todo), batch):
                part = todo[s : s + batch]
                for i, v in zip(part, use([texts[i] for i in part])):
                    made[i] = v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float32()))], names=[*b.schema.names, out])

    kept = df.drop(out)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [f"{out} array<float>"])
    return kept.mapInArrow(run, schema)


def responses(df: DataFrame, prompt: str, call: Callable[[list[str]], list[str]], out: str = "response", batch: int = 8, limit: tuple[int, float] | None = None) -> DataFrame:
    """``df`` with a provider's JSON answer to each ``prompt`` (documents, transcripts, extraction, resolution); null prompts have none.

    A failed batch is tried again; answers that are no complete JSON are null, to be asked for again by the next run.
    ``limit`` (calls, seconds) holds for all workers together: the rows go through as many lanes as ``lanes_of`` allows.
    """
    lanes, rate = lanes_of(*limit, df.sparkSession.sparkContext.defaultParallelism) if limit else (0, 0.0)

    def run(batches: Iterator[pa.RecordBatch]):
        ask, allowance = retrying(call), Allowance(rate) if limit else None
        for b in batches:
            asked = b.column(b.schema.get_field_index(prompt)).to_pylist()
            todo = [i for i, t in enumerate(asked) if t is not None]
            said: list = [None] * len(asked)
            for s in range(0, len(todo), batch):
                part = todo[s : s + batch]
                if allowance is not None:
                    allowance.take()
                for i, v in zip(part, ask([asked[i] for i in part])):
                    said[i] = v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], names=[*b.schema.names, out])

    kept = df.drop(out)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [f"{out} string"])
    answered = (kept.repartition(lanes) if lanes else kept).mapInArrow(run, schema)
    return answered.withColumn(out, F.when(F.expr(f"try_parse_json({out})").isNotNull(), F.col(out)))


def dictionary_entities(members: DataFrame, terms: DataFrame) -> DataFrame:
    """Entities by dictionary: every chunk sentence that holds a term (as whole words, in any case). ``terms``: entity_id, entity_type, name.

    The dictionary is bounded by its measured size; it is broadcast below 8 MB, else both sides meet on the term's first word.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("full_text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)
    flat = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    texts = members.withColumn("_flat", flat).withColumn("_w", F.explode(F.array_distinct(words)))
    spelt = F.array_join(F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{N}]+"), 0), " ")
    dic = terms.select("entity_id", "entity_type", "name", spelt.alias("_n")).withColumn("_w", F.split_part("_n", F.lit(" "), F.lit(1)))
    from plenum.runtime import input_bytes

    if input_bytes(dic) <= 8 << 20:
        dic = F.broadcast(dic)
    return texts.join(dic, "_w").filter(F.contains(F.col("_flat"), F.concat(F.lit(" "), F.col("_n"), F.lit(" ")))).drop("_flat", "_w", "_n")


def cooccurrence(found: DataFrame) -> DataFrame:
    """Relations by co-occurrence: in a chunk sentence, each entity with those of greater id named in it (sentences are short, so lists are)."""
    keys = ["session_id", "agenda_item_index", "chunk_index", "local_index"]
    per = found.groupBy(*keys).agg(F.sort_array(F.collect_set("entity_id")).alias("es"))
    pairs = F.expr("flatten(transform(es, (a, i) -> transform(slice(es, i + 2, size(es)), b -> struct(a AS source_id, b AS target_id))))")
    return per.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*", F.lit("relates_to").alias("relation_type"), F.lit("neutral").alias("sentiment"), F.lit(0.5).alias("confidence"))
