"""Entity deduplication: candidate pairs by fuzzy and vector scores, resolution, transitive merging, remapping.

Candidates are pairs of one type, older first, with fuzzy >= 0.85, vector >= 0.85 or 0.3 fuzzy + 0.7 vector >= 0.80.
Exactly: a pair below fuzzy 0.85 must have vector >= 5/7, which blocked matrix products find tile by tile; pairs at or
above it come from comparing the counts of letters of all names of both tiles. Only pairs that pass leave a task. A type's tiles bound the memory of a task
whatever the type's size; the work for the largest type stays quadratic, as the definition asks.

Defined results: a missing, wrongly sized or zero vector scores 0; null names and aliases are ignored; pairs need both
ids; equal times are ordered by id; every id of a group, however long its chains, is led to the group's oldest record.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.operators.fuzzy import alike, lcs
from plenum.runtime import cut

FUZZY, VECTOR, HYBRID = 0.85, 0.85, 0.80
#: Entities of a tile, and of those rows and pairs of names that are taken up at once.
TILE, ROWS, MET = 30_000, 512, 4_000_000
#: Partitions of the ranked pairs, and what stands for no number.
STRATA, NONE = 64, 2**31 - 1
#: Error of a product of unit vectors in single precision.
SINGLE = 5e-6
#: Salted shares of one vertex.
SALTS = 16
_PAIR = "left_id string, right_id string, fuzzy double, vector double"


def _names(df: DataFrame) -> DataFrame:
    every = F.concat(F.array("canonical_name", "name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return df.withColumn("names", F.array_distinct(F.transform(F.filter(every, lambda x: x.isNotNull()), F.lower)))


def _best(a: list[str], b: list[str], need: float = 0.0) -> float:
    best = 0.0
    for x in a:
        for y in b:
            total = len(x) + len(y)
            if total == 0:
                return 1.0
            bound = 2 * min(len(x), len(y)) / total
            if bound > best and bound >= need - 0.006:
                best = max(best, round(200 * lcs(x, y) / total) / 100)
                if best == 1.0:
                    return best
    return best


def _unit_free(packed: list[bytes | None], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled by powers of two, and their lengths; what is missing is 0 with length 1."""
    x = np.zeros((len(packed), dim), "f4")
    for i, p in enumerate(packed):
        if p is not None:
            raw = zlib.decompress(p)
            planes = np.frombuffer(raw, "u1").reshape(-1, dim)
            x[i] = np.ascontiguousarray(planes.T).view("f2" if len(planes) == 2 else "f4").ravel()
    norm = np.empty(len(packed))
    for k in range(0, len(x), 1000):
        part = x[k : k + 1000]
        part[:] = np.ldexp(part, -np.frexp(np.abs(part).max(axis=1, initial=0))[1][:, None])
        norm[k : k + 1000] = np.sqrt((part.astype("f8") ** 2).sum(1))
    return x, np.where(norm == 0, 1.0, norm)


def _runs(starts: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, places): the places ``starts[i]``, ``starts[i] + 1``, ... of each i, ``many[i]`` of them."""
    i = np.repeat(np.arange(len(many)), many)
    return i, starts[i] + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)


class _Alike:
    """Which records of ``second`` have a name alike to one of a record of ``first``, and the best ratio; ``own``: both are the same records."""

    def __init__(self, names: pa.ListArray, first: np.ndarray, second: np.ndarray, own: bool):
        holder = pc.list_parent_indices(names).to_numpy()
        spelled = names.flatten().dictionary_encode()
        code, text = spelled.indices.to_numpy(), spelled.dictionary.to_pylist()
        self.own, self.width = own, len(second)
        sides = []
        for rows in (first, second):
            at = np.full(len(names), -1)
            at[rows] = np.arange(len(rows))
            mine = at[holder] >= 0
            used, name = np.unique(code[mine], return_inverse=True)
            sides.append((at[holder][mine], name, [text[k] for k in used]))
        (self.x, self.name, a), (y, other, b) = sides
        i, j, q = alike(a, None if own else b, int(FUZZY * 100))
        if own:
            same = np.arange(len(a))
            i, j, q = np.concatenate([i, j, same]), np.concatenate([j, i, same]), np.concatenate([q, q, np.full(len(a), 100)])
        order = np.argsort(i, kind="stable")
        self.j, self.q = j[order], q[order]
        self.near = np.bincount(i, minlength=len(a))
        self.near_at = np.cumsum(self.near) - self.near
        order = np.argsort(other, kind="stable")
        self.y, self.held = y[order], np.bincount(other, minlength=len(b))
        self.held_at = np.cumsum(self.held) - self.held
        weight = np.bincount(i, self.held[j], len(a)) if len(i) else np.zeros(len(a))
        # pairs met, by the record of ``first``
        self.upto = np.cumsum(np.bincount(self.x, weight[self.name], len(first)))

    def best(self, s: int, e: int) -> np.ndarray:
        """Ratios of the records ``s:e`` of ``first`` with all of ``second``, 0 where no names are alike."""
        out = np.zeros((e - s) * self.width, np.uint8)
        o = slice(*np.searchsorted(self.x, (s, e)))
        i, at = _runs(self.near_at[self.name[o]], self.near[self.name[o]])
        x, j, q = self.x[o][i], self.j[at], self.q[at]
        i, at = _runs(self.held_at[j], self.held[j])
        x, y, q = x[i], self.y[at], q[i].astype(np.uint8)
        if self.own:
            later = y > x
            x, y, q = x[later], y[later], q[later]
        # the best is written last
        order = np.argsort(q, kind="stable")
        out[((x - s) * self.width + y)[order]] = q[order]
        return out.reshape(e - s, self.width)


def _tile(dim: int):
    """One pair of tiles: all pairs alike by name or by vector, with both similarities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        ids = t.column("entity_id").to_pylist()
        names = t.column("names").combine_chunks()
        texts = None
        first, second = (np.flatnonzero(t.column(c).to_numpy()) for c in ("is_first", "is_second"))
        within = len(first) == len(second) and bool((first == second).all())
        left_x, left_n = _unit_free(t.column("vec").take(pa.array(first)).to_pylist(), dim)
        right_x, right_n = (left_x, left_n) if within else _unit_free(t.column("vec").take(pa.array(second)).to_pylist(), dim)
        age = np.empty(len(ids), np.int64)
        created = t.column("created").to_pylist()
        age[sorted(range(len(ids)), key=lambda i: (created[i], ids[i]))] = np.arange(len(ids))
        named = _Alike(names, first, second, within)
        text = pa.array(ids, pa.string())
        met: set | None = set() if len(set(ids)) < len(ids) else None  # only where ids are repeated in the table
        s = 0
        while s < len(first):
            e = max(s + 1, min(s + ROWS, int(np.searchsorted(named.upto, (named.upto[s - 1] if s else 0) + MET, "right"))))
            best = named.best(s, e)
            sim = left_x[s:e] @ right_x.T
            sim *= (1 / left_n[s:e]).astype("f4")[:, None]
            sim *= (1 / right_n).astype("f4")[None]
            i, j = np.nonzero((best > 0) | (sim >= 5 / 7 - 2 * SINGLE))
            if within:
                i, j = i[j > i + s], j[j > i + s]
            v, f, a, b = sim[i, j].astype("f8"), best[i, j] / 100, first[s + i], second[j]
            # where single precision may round to another result, the product is taken in double precision
            unsure = (f == 0) | (_near_half(v) | _near_half(0.3 * f + 0.7 * v))
            at = np.flatnonzero(unsure & (sim[i, j] != 0))
            for k in (at[p : p + 4096] for p in range(0, len(at), 4096)):
                v[k] = np.einsum("ij,ij->i", left_x[s + i[k]].astype("f8"), right_x[j[k]].astype("f8")) / (left_n[s + i[k]] * right_n[j[k]])
            keep = np.ones(len(a), bool)
            for k in np.flatnonzero(f == 0):
                if v[k] < 5 / 7 - 1e-9:
                    keep[k] = False
                    continue
                texts = texts or names.to_pylist()
                f[k] = _best(texts[a[k]], texts[b[k]], 0.0 if v[k] >= VECTOR else (HYBRID - 0.7 * v[k]) / 0.3)
                keep[k] = v[k] >= VECTOR or 0.3 * f[k] + 0.7 * v[k] >= HYBRID
            older = age[a] < age[b]
            a, b = np.where(older, a, b), np.where(older, b, a)
            if met is not None:
                for k in np.flatnonzero(keep):
                    row = (ids[a[k]], ids[b[k]], f[k], round(v[k], 4))
                    keep[k] = row[0] != row[1] and row not in met
                    met.add(row)
            yield pa.RecordBatch.from_arrays([text.take(pa.array(a[keep])), text.take(pa.array(b[keep])), pa.array(f[keep]), pa.array(v[keep])], names=["left_id", "right_id", "fuzzy", "vector"])
            s = e

    return run


def _near_half(v: np.ndarray) -> np.ndarray:
    """Where a number changed by ``SINGLE`` may have other four decimals."""
    return np.abs(np.abs(v * 1e4) % 1 - 0.5) <= SINGLE * 1e4


def candidates(entities: DataFrame, dim: int = 768) -> DataFrame:
    """(keep_id, merge_id, fuzzy, vector, hybrid): every pair that passes one of the thresholds."""
    df = _names(entities.filter("entity_id IS NOT NULL AND entity_type IS NOT NULL")).withColumn("created", F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(0)))
    good = F.expr(f"size(embedding) = {dim} AND exists(embedding, x -> x <> 0) AND forall(embedding, x -> x IS NOT NULL)")
    sizes = F.broadcast(df.groupBy("entity_type").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")))  # one row a type
    packed = df.join(sizes, "entity_type").select("entity_type", "entity_id", "created", "names", "tiles", F.pmod(F.xxhash64("entity_id"), F.col("tiles")).cast("int").alias("t"), F.when(good, F.col("embedding")).alias("embedding"))
    packed = packed.mapInArrow(_pack, "entity_type string, entity_id string, created bigint, names array<string>, tiles int, t int, vec binary")
    # each entity once for every pair of tiles that its tile is in
    spread = packed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"ti": F.least("t", "o"), "tj": F.greatest("t", "o")})
    routed = spread.select("entity_type", "ti", "tj", "entity_id", "created", "names", (F.col("t") == F.col("ti")).alias("is_first"), (F.col("t") == F.col("tj")).alias("is_second"), "vec")
    found = routed.groupBy("entity_type", "ti", "tj").applyInArrow(_tile(dim), _PAIR)
    return found.select(F.col("left_id").alias("keep_id"), F.col("right_id").alias("merge_id"), F.round("fuzzy", 4).alias("fuzzy"), F.round("vector", 4).alias("vector"), F.round(0.3 * F.col("fuzzy") + 0.7 * F.col("vector"), 4).alias("hybrid"))


def ranked(pairs: DataFrame) -> DataFrame:
    """Candidates, the highest hybrid score first, equal ones by their ids."""
    # sampling for the bounds of an orderBy would compute all pairs twice; the scores' bounds are known
    scores = [c for c in ("fuzzy", "vector", "hybrid") if c in pairs.columns]
    # four decimals: they are shuffled as whole numbers, which take less room; no number is one that no score is
    whole = pairs.withColumns({c: F.when(F.isnan(c), NONE).otherwise(F.round(F.col(c) * 10000).cast("int")) for c in scores}).withColumn("_at", _stratum(F.col("hybrid")))
    order = whole.repartitionById(STRATA, "_at").sortWithinPartitions("_at", F.desc("hybrid"), "keep_id", "merge_id").drop("_at")
    return order.withColumns({c: F.when(F.col(c) == NONE, F.lit(float("nan"))).otherwise(F.col(c) / 10000) for c in scores})


def _stratum(whole: Column) -> Column:
    """0 for the highest scores, in ten-thousandths, up to ``STRATA`` - 1; three quarters of the strata are those of pairs alike by name alone."""
    low, high, side, hybrid = 0.2, 0.36, STRATA // 8, whole / 10000
    place = F.when(hybrid >= high, side * (1 - hybrid) / (1 - high)).when(hybrid >= low, side + (STRATA - 2 * side) * (high - hybrid) / (high - low)).otherwise(STRATA - side + side * (low - hybrid))
    # no number counts as the highest one, as in orderBy; missing ones come last
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(STRATA - 1), F.floor(place).cast("int"))), F.lit(STRATA - 1))


def _pack(batches):
    """``embedding`` as ``vec``: its bytes by significance, compressed; in half precision where nothing is lost."""
    for b in batches:
        lists = b.column("embedding")
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("f4")
        held = np.asarray(lists.is_valid())
        rows = flat.reshape(int(held.sum()), -1) if len(flat) else flat.reshape(0, 1)
        with np.errstate(over="ignore"):
            half = rows.astype("f2")
        packed = iter([zlib.compress(np.ascontiguousarray((h if (h == r).all() else r).view("u1").reshape(len(r), -1).T).tobytes(), 1) for r, h in zip(rows, half)])
        vec = pa.array([next(packed) if ok else None for ok in held], pa.binary())
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in b.schema.names if n != "embedding"), vec], names=[*(n for n in b.schema.names if n != "embedding"), "vec"])


def pair_scores(matches: DataFrame) -> DataFrame:
    """The stored match scores with the decision of the threshold rule: merge or keep_separate."""
    ok = (F.col("fuzzy_score") >= FUZZY) | (F.col("vector_score") >= VECTOR) | (F.col("hybrid_score") >= HYBRID)
    return matches.select("match_id", "entity1", "entity2", F.when(F.coalesce(ok, F.lit(False)), "merge").otherwise("keep_separate").alias("decision"))


def stored_map(entities: DataFrame) -> DataFrame:
    """(old_id, new_id) of the entities whose metadata say what they were merged into."""
    into = F.get_json_object("meta_data", "$.merged_into")
    return entities.select(F.col("entity_id").alias("old_id"), into.alias("new_id")).filter("old_id IS NOT NULL AND new_id IS NOT NULL AND old_id <> new_id")


def statistics(decided: DataFrame, entities: DataFrame) -> DataFrame:
    """(pairs_checked, matches_found, kept_separate, entities_merged) of decided pairs; of a group all but its survivor are merged."""
    merge = F.col("decision") == "merge"
    gone = survivors(decided.filter(merge), "entity1", "entity2", entities).agg(F.count("*").alias("entities_merged"))
    counts = decided.agg(F.count("*").alias("pairs_checked"), F.count(F.when(merge, 1)).alias("matches_found"), F.count(F.when(~merge, 1)).alias("kept_separate"))
    # each side is one row of counts
    return counts.withColumn("_k", F.lit(1)).join(gone.withColumn("_k", F.lit(1)), "_k").drop("_k")


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with ``m``, the least of u and its neighbours; a hub's minimum is taken and given back in salted shares."""
    salted = edges.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    part = salted.groupBy("u", "_s").agg(F.min("v").alias("_m"))
    whole = part.groupBy("u").agg(F.least("u", F.min("_m")).alias("m"), F.collect_set("_s").alias("_ss"))
    return salted.join(whole.select("u", "m", F.explode("_ss").alias("_s")), ["u", "_s"]).select("u", "v", "m")


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def linked(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(id, group): every id that a pair links to a smaller one, with the smallest id linked directly or indirectly.

    Large and small stars in turn: a vertex leads its larger neighbours, then its smaller ones, to the least of them, until
    every edge ends at its group's least id. The rounds grow with the logarithm of the longest chain; no link is dropped.
    """
    ends = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before, now = None, _print_of(edges)
    while now != before:
        both = edges.select(F.explode(F.expr("array(struct(u, v), struct(v AS u, u AS v))")).alias("e")).select("e.*")
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _with_least(large)
        edges = cut(small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        before, now = now, _print_of(edges)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group"))


def survivors(pairs: DataFrame, a: str, b: str, entities: DataFrame) -> DataFrame:
    """(old_id, root_id): every id merged away and the oldest record of its group (created_at, then id); ids without record are the youngest."""
    led = cut(linked(pairs, a, b))
    every = led.unionByName(led.select(F.col("group").alias("id"), "group").distinct())
    born = entities.filter("entity_id IS NOT NULL").groupBy(F.col("entity_id").alias("id")).agg(F.min("created_at").alias("born"), F.lit(0).alias("known"))
    aged = every.join(born, "id", "left")
    root = aged.groupBy("group").agg(F.min_by("id", F.struct(F.coalesce("known", F.lit(1)), F.col("born").isNull(), "born", "id")).alias("root_id"))
    return every.join(root, "group").filter("id <> root_id").select(F.col("id").alias("old_id"), "root_id")


def roots(mapping: DataFrame) -> DataFrame:
    """(old_id, root_id) of a stored map (old_id, new_id), one parent each: chains followed to their end by pointer doubling."""
    cur = cut(mapping.select("old_id", F.col("new_id").alias("root_id")))
    while True:
        up = cur.select(F.col("old_id").alias("root_id"), F.col("root_id").alias("next"))
        nxt = cut(cur.join(up, "root_id", "left").select("old_id", F.coalesce("next", "root_id").alias("root_id"), F.col("next").isNotNull().alias("moved")))
        if nxt.filter("moved").isEmpty():
            return nxt.select("old_id", "root_id")
        cur = nxt.select("old_id", "root_id")


def _facts_of(meta: str) -> Column:
    return F.coalesce(F.from_json(F.col(meta), "map<string,string>"), F.create_map().cast("map<string,string>"))


def merged(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row per surviving entity: its own name, all names as aliases, longest description, highest confidence and importance,
    metadata united (the younger record's value counts), merged ids."""
    df = entities.filter("entity_id IS NOT NULL").join(mapping.select(F.col("old_id").alias("entity_id"), "root_id"), "entity_id", "left").withColumn("keep_id", F.coalesce("root_id", "entity_id"))
    own = F.col("entity_id") == F.col("keep_id")
    more = F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.when(own, F.array().cast("array<string>")).otherwise(F.array("canonical_name"))))
    alias = df.select("keep_id", F.explode(more).alias("alias")).filter("alias IS NOT NULL").groupBy("keep_id").agg(F.array_join(F.sort_array(F.collect_set("alias")), "|").alias("aliases"))
    meta = df.select("keep_id", "created_at", "entity_id", F.explode(_facts_of("meta_data")).alias("k", "v")).groupBy("keep_id", "k").agg(F.max_by("v", F.struct("created_at", "entity_id")).alias("v"))
    meta = meta.groupBy("keep_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "k", "v"))), "|").alias("meta_data"))
    sound = F.when(~F.isnan("confidence"), F.col("confidence"))
    facts = df.groupBy("keep_id").agg(
        F.min_by("canonical_name", F.struct(~own, "created_at", "entity_id")).alias("canonical_name"),
        F.min_by("description", F.struct(-F.length(F.coalesce("description", F.lit(""))), ~own, "entity_id")).alias("description"),
        F.max(sound).alias("confidence"), F.max("importance_score").alias("importance_score"),
        F.array_join(F.sort_array(F.collect_set(F.when(~own, F.col("entity_id")))), "|").alias("merged_ids"))
    return facts.join(alias, "keep_id", "left").join(meta, "keep_id", "left").select(
        F.col("keep_id").alias("entity_id"), "canonical_name", "description", "confidence", "importance_score", F.coalesce("aliases", F.lit("")).alias("aliases"), F.coalesce("meta_data", F.lit("")).alias("meta_data"), "merged_ids")


def renamed(survived: DataFrame, decisions: DataFrame) -> DataFrame:
    """``survived`` (see ``merged``) with what a resolution decided: ``decisions`` (keep_id, merged_name, merged_aliases, one row a survivor).

    A new name leaves the old one among the aliases; aliases that a decision lists replace the united ones; nulls decide nothing.
    """
    said = decisions.select(F.col("keep_id").alias("entity_id"), "merged_name", "merged_aliases")
    df = survived.join(said, "entity_id", "left")
    name = F.coalesce(F.nullif("merged_name", F.lit("")), F.col("canonical_name"))
    listed = F.when(F.size("merged_aliases") > 0, F.col("merged_aliases")).otherwise(F.filter(F.split("aliases", r"\|"), lambda x: x != ""))
    kept = F.when(name != F.col("canonical_name"), F.array_union(listed, F.array("canonical_name"))).otherwise(listed)
    return df.withColumn("aliases", F.array_join(F.array_sort(F.array_distinct(kept)), "|")).withColumn("canonical_name", name).select(survived.columns)


def marked(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """All entities; the metadata of those merged away name their survivor under ``merged_into``."""
    df = entities.join(mapping.select(F.col("old_id").alias("entity_id"), F.col("root_id").alias("_into")), "entity_id", "left")
    told = F.to_json(F.map_concat(F.map_filter(_facts_of("meta_data"), lambda k, v: k != "merged_into"), F.create_map(F.lit("merged_into"), F.col("_into"))))
    return df.withColumn("meta_data", F.when(F.col("_into").isNotNull(), told).otherwise(F.col("meta_data"))).select(entities.columns)


def remapped(edges: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """``edges`` with each of ``columns`` led to its root; ``updates`` counts the columns that changed."""
    df = edges.withColumn("updates", F.lit(0))
    for c in columns:
        df = df.join(mapping.select(F.col("old_id").alias(c), F.col("root_id").alias(f"_{c}")), c, "left")
        df = df.withColumn("updates", F.col("updates") + F.col(f"_{c}").isNotNull().cast("int")).withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return df


def unique_edges(edges: DataFrame, keys: list[str], confidence: str, tie: str) -> DataFrame:
    """One edge per ``keys``: the most confident, then the one with the smallest ``tie``."""
    best = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(confidence), tie)
    return edges.withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k")
