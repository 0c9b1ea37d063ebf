"""Encoding of a whole corpus with a public byte-level BPE vocabulary, on the JVM.

Each text is cut into words by the vocabulary's pattern; only *distinct* words are encoded. A word's bytes become a
chain of symbols, and ``aggregate`` folds ranked merges over it: the pair of least rank is replaced everywhere, left to
right, until no pair has a rank. The rank map is a literal, an array of small maps addressed by a checksum of the
key, so that a lookup does not scan 50,000 entries. The encoded words go back to the documents by a join whose smaller
side is broadcast only if its measured size is below ``broadcast_bytes``; otherwise both sides are shuffled.

Defined results
* null and empty texts have no ids: an empty list (token count 0);
* rows repeated under one id with one text give one row; a null id is kept as a row of its own per text;
* a text may have up to 2^27 words, a word up to 2^19 ids; both are encoded whole; all other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.runtime import cut

#: Where the vocabulary files lie; a parameter, never copied.
TOKENIZERS = os.environ.get("PLENUM_TOKENIZERS", "/opt/tokenizers")
#: The public split pattern, its white-space class spelled for Java.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)
#: Small maps the rank map is spread over.
BUCKETS = 8192
#: An encoded vocabulary up to this measured size is broadcast.
BROADCAST_BYTES = 48 << 20


def _printable() -> dict[str, int]:
    """The vocabulary file's letters for the 256 bytes: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + n)] = b
    return letters


@lru_cache(maxsize=4)
def _ranks(path: str) -> str:
    """JSON of an array of maps: a pair of symbols or a single byte's symbol to the id that it makes."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    letters, vocab = _printable(), model["vocab"]
    symbol = lambda token: f"x{letters[token]:02X}" if len(token) == 1 else str(vocab[token])
    entries = {symbol(c): vocab[c] for c in letters}
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        entries[f"{symbol(left)}_{symbol(right)}"] = vocab[left + right]
    spread: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for key, made in entries.items():
        spread[zlib.crc32(key.encode()) % BUCKETS][key] = made
    return json.dumps(spread, separators=(",", ":"))


@lru_cache(maxsize=4)
def _pieces(path: str) -> str:
    """JSON of an array: the bytes of each id as hex digits."""
    ranks = {int(n): base64.b64decode(t) for t, n in (line.split() for line in open(path, "rb"))}
    return json.dumps([ranks.get(n, b"").hex().upper() for n in range(max(ranks) + 1)], separators=(",", ":"))


def words(text: Column) -> Column:
    """The words of ``text`` in order, as the vocabulary's pattern cuts them."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), 0)


def _encode(word: str, ranks: str) -> str:
    """SQL: the ids of string column ``word``."""
    look = lambda key: f"_r[CAST(crc32(CAST({key} AS binary)) % {BUCKETS} AS int)][{key}]"
    pairs = f"transform(slice(y, 1, greatest(size(y) - 1, 0)), (p, i) -> struct({look('concat(p, ' + chr(39) + '_' + chr(39) + ', y[i + 1])')} AS made, p AS l, y[i + 1] AS r))"
    least = f"transform(array(split(substring(s.w, 2, length(s.w) - 2), '><')), y -> array_min(filter({pairs}, q -> q.made IS NOT NULL)))[0]"
    step = (
        f"CASE WHEN s.over THEN s ELSE transform(array({least}), b -> CASE WHEN b IS NULL THEN struct(s.w AS w, true AS over) "
        f"ELSE struct(replace(s.w, concat('<', b.l, '><', b.r, '>'), concat('<', CAST(b.made AS string), '>')) AS w, false AS over) END)[0] END"
    )
    chain = f"regexp_replace(hex(CAST({word} AS binary)), '(..)', '<x$1>')"
    folded = f"aggregate(slice(sequence(0, octet_length({word})), 2, greatest(octet_length({word}) - 1, 0)), struct({chain} AS w, false AS over), (s, k) -> {step}, s -> s.w)"
    last = f"transform(split(substring(z, 2, length(z) - 2), '><'), t -> CASE WHEN t LIKE 'x%' THEN {look('t')} ELSE CAST(t AS int) END)"
    # the literal stands once in the plan, bound to _r
    return f"transform(array({ranks}), _r -> transform(array({folded}), z -> {last})[0])[0]"


def encode_words(distinct: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``distinct`` (word) with ``word_ids``."""
    literal = _ranks(f"{folder}/{vocabulary}.json").replace("\\", "\\\\").replace("'", "\\'")
    ranks = f"from_json('{literal}', 'array<map<string,int>>')"
    return distinct.withColumn("word_ids", F.expr(_encode("word", ranks)))


def _coded(docs: DataFrame, key: str, text: str, vocabulary: str, folder: str, broadcast_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The documents (doc, h) and their words (doc, h, pos, word_ids)."""
    base = docs.select(F.col(key).alias("doc"), F.col(text).alias("_text")).withColumn("h", F.xxhash64("_text"))
    flat = base.select("doc", "h", F.posexplode(words(F.col("_text"))).alias("pos", "word"))
    # one vocabulary for all documents; the cut gives its true size and keeps the fold from running twice
    distinct = base.select(F.explode(words(F.col("_text"))).alias("word")).distinct()
    # a small table of heavy rows: spread over all cores
    spread = distinct.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, "word")
    coded = cut(encode_words(spread, vocabulary, folder))
    size = coded.select(F.sum(F.octet_length("word") + 4 * F.size("word_ids") + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        coded = F.broadcast(coded)
    return base.select("doc", "h"), flat.join(coded, "word").select("doc", "h", "pos", "word_ids")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS,
           broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(``key``, ``ids``) of every document."""
    base, coded = _coded(docs, key, text, vocabulary, folder, broadcast_bytes)
    # one long a token, place above id: sorts as it stands, and a list of longs is the smallest thing to move
    flat = coded.select("doc", "h", "pos", F.posexplode("word_ids").alias("sub", "id"))
    code = F.shiftleft(F.col("pos").cast("bigint"), 36) + F.shiftleft(F.col("sub").cast("bigint"), 17) + F.col("id")
    # documents without words keep a row
    rows = flat.select("doc", "h", code.alias("c")).unionByName(base.select("doc", "h", F.lit(None).cast("bigint").alias("c")))
    whole = rows.groupBy("doc", "h").agg(F.array_sort(F.array_distinct(F.collect_list("c"))).alias("cs"))
    ids = F.expr(f"transform(cs, c -> CAST(c & {(1 << 17) - 1}L AS int))")
    return whole.select(F.col("doc").alias(key), ids.alias("ids"))


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS,
                 broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(``key``, ``n_tokens``) of every document that has an id; ids are taken as unique."""
    base, coded = _coded(docs, key, text, vocabulary, folder, broadcast_bytes)
    rows = coded.select("doc", F.size("word_ids").cast("bigint").alias("n")).unionByName(base.select("doc", F.lit(0).cast("bigint").alias("n")))
    return rows.filter("doc IS NOT NULL").groupBy("doc").agg(F.sum("n").alias("n_tokens")).withColumnRenamed("doc", key)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(``key``, ``text``) from ids: the pieces' bytes concatenated and read as UTF-8; an empty list gives an empty text."""
    pieces = f"from_json('{_pieces(f'{folder}/{vocabulary}.tiktoken')}', 'array<string>')"
    return encoded.select(key, F.expr(f"decode(unhex(array_join(transform(`{ids}`, i -> {pieces}[i]), '')), 'UTF-8')").alias("text"))
