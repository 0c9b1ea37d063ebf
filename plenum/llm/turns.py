"""Speech transcripts into clean speaker turns.

1. Text: time marks, annotations and speaker labels at a sentence's head are told from speech. Fillers are classified token
   by token: boosted trees judge a word or phrase by how it stands (set off by marks before or after it, how often words of
   its form are), not by what it is; they learn from the hesitations of a fixed list against all other
   words, and judge the hesitations and set phrases in each context. A sentence with no word left does not count.
2. Labels: block labels and head labels are normalised by ``names.Registry``; a head label holds until the next or the block's end.
3. Order: spoken second, block, sentence; a sentence without time takes the time of the one before it in its block
   (the first: of the next; a block without any: of the block before).
4. Boundaries: gradient-boosted trees give each two adjacent sentences log-odds that a turn ends between them, from the labels
   as they are typed (equal, alike, surname, initials, kind), gaps and context (block, head label, the label two sentences
   back, a question before). They never see whom the registry finds, which is what they are trained on: at most
   ``TRAIN_PAIRS`` adjacent pairs (smallest hashes) whose speakers it knows. The registry's finding joins as further log-odds
   of ``KNOWN``, which outweigh the trees; where it does not know one of the speakers, the trees decide alone.

Scale: one shuffle by block, one by agenda item; sentences never leave the JVM but for distinct labels. The filler model is
fitted on counts of the ``FORMS`` most frequent word forms.

Defined results
* null, empty and filler-only texts do not count; sentences delivered again count once (smallest delivery time);
* sentences without a block row belong to a member nobody identified; null session or item indices group together;
* an agenda item is ordered in one task, spilling to disk if it must; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.names import Registry
from plenum.runtime import cut, release

TRAIN_PAIRS, TREES, DEPTH = 20_000, 24, 3
#: Log-odds of what the registry knows: more than all trees together can give.
KNOWN = 40.0
#: Log-odds that a form of the list is a filler, beside what the filler model says.
LISTED = 2.5
#: Word forms that the filler model is fitted on, the most frequent ones.
FORMS = 2000

#: Hesitations, and set phrases that may be fillers.
HESITATIONS, PHRASES = r"um+|uh+|er+|erm+|ah+|hm+|mhm+|eh", ["you know", "i mean"]
FILLERS = rf"(?:{HESITATIONS}|{'|'.join(PHRASES)})"
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?"
_SPELT = r"(?:\d+\s?h\s?)?\d+\s?m\s?\d+(?:\.\d+)?\s?s"
TIME_MARK = rf"(?:\[\s*(?:{_CLOCK}|{_SPELT})\s*\]|\(\s*(?:{_CLOCK}|{_SPELT})\s*\)|\b(?:{_CLOCK})(?:\s+(?:-|–|-->)(?=\s))?)"
ANNOTATION = r"(?:\[[^\]:]*(?:\d+:\d+)?\](?!\s*:|\s+—)|<[^<>]*>|\{[^{}]*\}|\*[^*]*\*|♪[^♪]*♪?|--\s*[^-]+\s*--|\((?![^()]*\d)[^()]*\)(?!\s*:|\s+—))"
_HEAD = r"^(>>\s*)?(\[[^\]]{1,80}\]|[^:—\[\]]{1,80}?)(?:\s*:|\s+—)(?:\s+(.*))?$"


def seconds(time: Column) -> Column:
    """Whole seconds of a spoken time in any of the notations ``1h2m3s``, ``0h 2m 3s``, ``0M10S``, ``[2m3s]``, ``1:02:03``, ``2:03``, ``3s``; else null."""
    t = F.regexp_replace(F.lower(time), r"[\s\[\]()]", "")
    spelt = t.rlike(r"^(?=\d)(\d+h)?(\d+m)?(\d+(\.\d+)?s)?$")
    part = lambda u: F.coalesce(F.nullif(F.regexp_extract(t, rf"(\d+)(?:\.\d+)?{u}", 1), F.lit("")).cast("bigint"), F.lit(0))
    clock = t.rlike(r"^\d+:\d{1,2}(:\d{1,2})?(\.\d+)?$")
    p = F.split(F.regexp_replace(t, r"\..*$", ""), ":")
    of_clock = F.aggregate(F.when(clock, p).otherwise(F.array().cast("array<string>")), F.lit(0).cast("bigint"), lambda a, x: a * 60 + x.cast("bigint"))
    return F.when(spelt, part("h") * 3600 + part("m") * 60 + part("s")).when(clock, of_clock)


def _without(text: Column, *patterns: str) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, " ")
    return text


def clean(text: Column, fillers: str = FILLERS) -> Column:
    """``text`` without time marks, annotations and ``fillers``, white space and stray commas tidied."""
    t = _without(text, TIME_MARK, ANNOTATION)
    t = F.regexp_replace(t, rf"(?i)(?<![\p{{L}}\p{{N}}'’]){fillers}(?![\p{{L}}\p{{N}}'’])(?:\.\.\.|…|,|\s+—)?", " ")
    t = F.regexp_replace(t, r"\s+", " ")
    t = F.regexp_replace(t, r"\s+([,.;:!?])", "$1")
    return F.trim(F.regexp_replace(t, r"^[\s,;.…—-]+", ""))


_MARKS = ",.;:!?…—-"
_MARK = f"[{_MARKS}]"


def _units(text: Column) -> Column:
    """The words of ``text``, and its set phrases, as structs (form, before, after): set off by a mark before, after?"""
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    split = F.filter(F.split(F.lower(_without(text, TIME_MARK, ANNOTATION)), r"\s+"), lambda w: w != "")
    # every word is read once
    read = F.transform(split, lambda w: F.struct(F.regexp_replace(w, r"[^\p{L}'’]", "").alias("form"), F.right(w, F.lit(1)).isin(*_MARKS).alias("ends"), w.isin("—", "–", "-", "--").alias("dash")))

    def made(words: Column) -> Column:
        unit = lambda form, i, j: F.struct(
            form.alias("form"), F.coalesce(F.get(words, i - 1)["ends"], F.lit(True)).alias("before"), (F.get(words, j)["ends"] | F.coalesce(F.get(words, j + 1)["dash"], F.lit(True))).alias("after"))
        single = F.transform(words, lambda w, i: unit(w["form"], i, i))
        double = F.transform(words, lambda w, i: F.when(w["form"].isin(*[p.split(" ")[0] for p in PHRASES]), unit(F.concat(w["form"], F.lit(" "), F.coalesce(F.get(words, i + 1)["form"], F.lit(""))), i, F.least(i + 1, F.size(words) - 1))))
        return F.concat(single, F.filter(double, lambda u: u["form"].isin(*PHRASES)))

    return once(read, made)


class FillerModel:
    """Boosted trees on how words stand; ``pattern`` is the regular expression of all that they take for fillers."""

    #: What holds without any data: what is mostly set off is a filler, what mostly is not is a word.
    PRIOR = [(b, a, share, share / 2, share / 3, y) for b in (0, 1) for a in (0, 1) for share, y in ((0.5, 1), (0.9, 1), (0.05, 0), (0.0, 0))]

    def __init__(self, rows: list[tuple]):
        """``rows``: (form, n, n of those set off only before, only after, on both sides)."""
        x, y, w = [r[:-1] for r in self.PRIOR], [r[-1] for r in self.PRIOR], [3.0] * len(self.PRIOR)
        self.forms: dict[str, list[list[float]]] = {}
        for form, n, nb, na, nba in rows:
            if not form:
                continue
            counts = {(0, 0): n - nb - na - nba, (1, 0): nb, (0, 1): na, (1, 1): nba}
            about = [(na + nba + 1) / (n + 4), (nb + nba + 1) / (n + 4), nba / (n + 4)]
            self.forms[form] = [[b, a, *about] for b, a in counts]
            if form not in PHRASES:
                for (b, a), k in counts.items():
                    if k:
                        x.append((b, a, *about))
                        y.append(int(re.fullmatch(HESITATIONS, form) is not None))
                        w.append(float(min(k, 200)))
        self.trees = BoostedTrees(np.array(x, float), np.array(y, float), np.array(w), trees=6, depth=2)

    def is_filler(self, form: str, before: bool, after: bool) -> bool:
        """Is this listed form a filler where it stands so? A form that was never counted is judged as one that is set off every other time."""
        seen = self.forms.get(form) or [[b, a, 0.5, 0.25, 0.2] for b in (0, 1) for a in (0, 1)]
        row = next(r for r in seen if (r[0], r[1]) == (int(before), int(after)))
        return bool(self.trees.score(np.array([row], float))[0] + LISTED > 0)

    def pattern(self) -> str:
        ahead = {True: rf"(?=\s*(?:{_MARK}|$))", False: rf"(?!\s*(?:{_MARK}|$))"}
        behind = {True: rf"(?<=^\s{{0,3}}|{_MARK}\s{{0,3}})", False: rf"(?<!^\s{{0,3}}|{_MARK}\s{{0,3}})"}
        known = [f for f in self.forms if re.fullmatch(HESITATIONS, f)]
        parts = []
        for shape, forms in [(HESITATIONS, known or ["um"])] + [(p, [p]) for p in PHRASES]:
            yes = [(b, a) for b in (False, True) for a in (False, True) if 2 * sum(self.is_filler(f, b, a) for f in forms) >= len(forms)]
            if len(yes) == 4:
                parts.append(f"(?:{shape})")
            else:
                parts += [f"{behind[b]}(?:{shape}){ahead[a]}" for b, a in yes]
        # a pattern that nothing meets, if nothing is a filler
        return f"(?:{'|'.join(parts)})" if parts else r"(?!)"


def filler_model(scanned: DataFrame) -> FillerModel:
    """The filler classifier of the sentences of ``scanned``: one count of all words' contexts, of which ``FORMS`` forms reach the driver."""
    units = scanned.select(F.explode(_units(F.col("_t"))).alias("u")).select("u.*")
    told = lambda b, a: F.count(F.when((F.col("before") == b) & (F.col("after") == a), 1))
    per = units.groupBy("form").agg(F.count("*").alias("n"), told(True, False).alias("nb"), told(False, True).alias("na"), told(True, True).alias("nba"))
    candidate = F.col("form").isin(PHRASES) | F.col("form").rlike(f"^({HESITATIONS})$")
    rows = per.orderBy(F.desc(candidate), F.desc("n"), "form").limit(FORMS).collect()
    return FillerModel(sorted(tuple(r) for r in rows))


def _scanned(sentences: DataFrame) -> DataFrame:
    """Each sentence once, with its second, a possible head label and what follows it."""
    cols = ["block_id", "session_id", "agenda_item_index", "speech_block_index", "sentence_index", "start_time", "text"]
    once = sentences.filter("sentence_id IS NOT NULL").groupBy("sentence_id").agg(F.min_by(F.struct(*cols), F.struct("created_at", *cols[:5])).alias("r")).select("sentence_id", "r.*")
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s\x{FEFF}\x{200B}\x{00A0}]+", " "))
    # marks before the label
    lead = F.regexp_replace(text, rf"^(?:\s|{TIME_MARK}|{ANNOTATION})+", "")
    df = once.withColumn("_t", F.when(lead == "", text).otherwise(lead))
    head = F.nullif(F.trim(F.regexp_extract("_t", _HEAD, 2)), F.lit(""))
    df = df.withColumn("head", F.when(F.size(F.split(head, " ")) <= 9, head)).withColumn("marked", (F.regexp_extract("_t", _HEAD, 1) != "") | F.col("head").startswith("["))
    return df.withColumn("rest", F.regexp_extract("_t", _HEAD, 3)).withColumn("sec", seconds(F.col("start_time")))


# gradient-boosted trees -------------------------------------------------------------------------------------------------

FEATURES = ["label_equal", "label_alike", "surname", "initial", "kind_same", "block", "gap", "label_here", "back", "asked"]


class BoostedTrees:
    """Logistic boosting of small trees on numeric features; ``sql`` scores without Python."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = 0.4):
        self.base = float(np.log((w @ y + 1) / (w @ (1 - y) + 1)))
        score, self.trees = np.full(len(y), self.base), []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = w * (y - p), w * p * (1 - p)
            tree = self._grow(x, g, h, np.arange(len(y)), depth, rate)
            self.trees.append(tree)
            score = score + self._apply(tree, x)

    def _grow(self, x, g, h, at, depth, rate):
        leaf = rate * float(g[at].sum() / (h[at].sum() + 1.0))
        if depth == 0 or len(at) < 2:
            return leaf
        best, gain = None, 1e-9
        whole = g[at].sum() ** 2 / (h[at].sum() + 1.0)
        for f in range(x.shape[1]):
            v = x[at, f]
            for t in np.unique(np.quantile(v, np.linspace(0, 1, 9)))[:-1]:
                left = at[v <= t]
                if 0 < len(left) < len(at):
                    gl, hl = g[left].sum(), h[left].sum()
                    gr, hr = g[at].sum() - gl, h[at].sum() - hl
                    won = gl**2 / (hl + 1.0) + gr**2 / (hr + 1.0) - whole
                    if won > gain:
                        best, gain = (f, float(t)), won
        if best is None:
            return leaf
        f, t = best
        side = x[at, f] <= t
        return f, t, self._grow(x, g, h, at[side], depth - 1, rate), self._grow(x, g, h, at[~side], depth - 1, rate)

    def _apply(self, tree, x):
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, t, a, b = tree
        return np.where(x[:, f] <= t, self._apply(a, x), self._apply(b, x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(self._apply(t, x) for t in self.trees)

    def sql(self, names: list[str]) -> str:
        def of(tree) -> str:
            if isinstance(tree, float):
                return f"{tree!r}D" if "e" not in repr(tree) else f"CAST('{tree!r}' AS double)"
            f, t, a, b = tree
            return f"CASE WHEN {names[f]} <= {t!r}D THEN {of(a)} ELSE {of(b)} END"

        return " + ".join([of(self.base), *(f"({of(t)})" for t in self.trees)])


def _prior() -> tuple[np.ndarray, np.ndarray]:
    """What holds without any data: a turn goes on where labels are equal, or surname and initials fit."""
    x, y = [], []
    for equal in (0, 1):
        for surname in (0, 1):
            for initial in (0, 1):
                for kind in (0, 1):
                    for block in (0, 1):
                        x.append([equal, 1.0 if equal else 0.3, surname, initial, kind, block, 5, 0, 0, 0])
                        y.append(0 if equal or (surname and initial) else 1)
    return np.array(x, float), np.array(y, float)


def boundary_model(pairs: DataFrame) -> BoostedTrees:
    """Trees trained on a bounded sample of ``pairs`` (features, certain, differ) whose speakers the registry knows."""
    rows = pairs.filter("certain").orderBy(F.xxhash64("sentence_id"), "sentence_id").limit(TRAIN_PAIRS).select(*[F.col(f).cast("double") for f in FEATURES], F.col("differ").cast("double")).toArrow()
    rows = np.column_stack([c.to_numpy() for c in rows.columns]) if rows.num_rows else np.zeros((0, len(FEATURES) + 1))
    x, y = _prior()
    w = np.full(len(y), max(0.5, 0.0005 * len(rows)))
    if len(rows):
        x, y, w = np.vstack([x, rows[:, :-1]]), np.r_[y, rows[:, -1]], np.r_[w, np.ones(len(rows))]
    return BoostedTrees(x, y, w)


def labelled(sentences: DataFrame, blocks: DataFrame, speakers: DataFrame) -> DataFrame:
    """The sentences that count, with second, clean text and the speaker's key: ``who``, ``form``, ``kind``, ``s``, ``init``."""
    scanned = cut(_scanned(sentences))
    said = blocks.filter("block_id IS NOT NULL").groupBy("block_id").agg(F.max_by("speaker_name", F.struct("created_at", "speaker_name")).alias("block_label"))
    df = scanned.join(said, "block_id", "left")
    df = cut(df)
    of_blocks = df.select("session_id", F.col("block_label").alias("label"), F.lit(1).alias("n"))
    of_heads = df.select("session_id", F.col("head").alias("label"), F.lit(0).alias("n"))
    uses = cut(of_blocks.unionByName(of_heads).filter("label IS NOT NULL").groupBy("label", "session_id").agg(F.sum("n").cast("bigint").alias("n")))
    reg = Registry(speakers, uses)
    known = reg.resolve(uses.select("label", "session_id"))
    surnames = reg.people.select(F.col("s").alias("_s"), F.lit(True).alias("real")).distinct()
    known = known.join(surnames, F.col("s") == F.col("_s"), "left")
    # the label as it is typed, but for case and white space
    key = F.struct("who", "form", "kind", "s", F.substring(F.coalesce("inits", F.lit("")), 1, 1).alias("init"), F.lower(F.trim(F.regexp_replace("label", r"\s+", " "))).alias("typed"))
    known = cut(known.select("label", "session_id", key.alias("key"), F.coalesce("real", F.lit(False)).alias("real")))
    names = lambda pre: known.select(F.col("label").alias(f"{pre}_l"), F.col("session_id").alias(f"{pre}_i"), F.col("key").alias(f"{pre}_key"), F.col("real").alias(f"{pre}_real"))
    on = lambda pre, col: F.col(col).eqNullSafe(F.col(f"{pre}_l")) & F.col("session_id").eqNullSafe(F.col(f"{pre}_i"))
    df = df.join(names("h"), on("h", "head"), "left").join(names("b"), on("b", "block_label"), "left").drop("h_l", "h_i", "b_l", "b_i")
    named = F.col("h_key.who").isNotNull() | F.col("h_key.kind").isin("presiding", "number")
    shaped = F.col("head").rlike(r"^\[?[\p{Lu}]") & F.col("h_real")
    nobody = (F.col("h_key.kind") == "nobody") & F.col("head").rlike(r"\p{L}{2}")
    accepted = F.coalesce(F.col("h_key").isNotNull() & (named | shaped | nobody | (F.col("marked") & F.col("h_key.kind").isin("person", "org", "office"))), F.lit(False))
    df = df.withColumn("label", accepted).withColumn("h_key", F.when(accepted, F.col("h_key")))
    words = clean(F.when(accepted, F.coalesce("rest", F.lit(""))).otherwise(F.col("_t")), filler_model(scanned).pattern())
    df = df.withColumn("clean_text", words)
    inside = Window.partitionBy("session_id", "block_id").orderBy("sentence_index", "sentence_id")
    back, ahead = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    nobody_key = F.struct(F.lit(None).cast("string").alias("who"), F.lit("nobody").alias("form"), F.lit("nobody").alias("kind"), F.lit(None).cast("string").alias("s"), F.lit("").alias("init"), F.lit("").alias("typed"))
    df = df.withColumn("key", F.coalesce(F.last("h_key", True).over(back), F.col("b_key"), nobody_key))
    df = df.withColumn("sec", F.coalesce(F.last("sec", True).over(back), F.first("sec", True).over(ahead)))
    item = Window.partitionBy("session_id", "agenda_item_index").orderBy("speech_block_index", "sentence_index", "sentence_id").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("sec", F.coalesce("sec", F.last("sec", True).over(item), F.lit(0)))
    return df.filter(F.col("clean_text").rlike(r"[\p{L}\p{N}]")).select(
        "sentence_id", "session_id", "agenda_item_index", "speech_block_index", "sentence_index", "block_id", "sec", "clean_text", "label", "key.*")


def _pairs(df: DataFrame) -> DataFrame:
    """``df`` with the features of each sentence and the one before it in its agenda item, and what the registry says of the two."""
    order = Window.partitionBy("session_id", "agenda_item_index").orderBy("sec", "speech_block_index", "sentence_index", "sentence_id")
    fields = ["who", "form", "kind", "s", "init", "typed", "block_id", "sec", F.col("clean_text").rlike(r"\?\W*$").alias("asks")]
    df = df.withColumn("_p", F.lag(F.struct(*fields)).over(order)).withColumn("_pp", F.lag("typed", 2).over(order))
    fixed = lambda who, kind: F.col(who).isNotNull() | F.col(kind).isin("presiding", "nobody", "number", "office")
    key = lambda pre: F.coalesce(F.col(f"{pre}who"), F.col(f"{pre}form"))
    fits = (F.col("s") == F.col("_p.s")) & ((F.col("init") == F.col("_p.init")) | (F.col("init") == "") | (F.col("_p.init") == ""))
    certain = F.coalesce(fixed("who", "kind") & fixed("_p.who", "_p.kind"), F.lit(False)) & F.col("_p").isNotNull()
    num = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    same_office = (F.col("kind") == F.col("_p.kind")) & F.col("kind").isin("presiding", "nobody")
    longest = F.greatest(F.length("typed"), F.length("_p.typed"))
    return df.withColumns({
        "first": F.col("_p").isNull(), "certain": certain, "differ": 1 - num((key("") == key("_p.")) | same_office),
        "label_equal": num(F.col("typed") == F.col("_p.typed")), "label_alike": F.when(longest > 0, 1 - F.levenshtein("typed", "_p.typed") / longest).otherwise(F.lit(1.0)),
        "surname": num(F.col("s") == F.col("_p.s")), "initial": num(fits), "kind_same": num(F.col("kind") == F.col("_p.kind")), "block": num(F.col("block_id") == F.col("_p.block_id")),
        "gap": F.coalesce(F.col("sec") - F.col("_p.sec"), F.lit(0)), "label_here": num(F.col("label")), "back": num(F.col("typed") == F.col("_pp")), "asked": num(F.col("_p.asks"))}).drop("_p", "_pp")


def turn_sentences(sentences: DataFrame, blocks: DataFrame, speakers: DataFrame, known: float = KNOWN) -> DataFrame:
    """Every sentence that counts with the number of its ``turn`` inside its agenda item; ``known`` 0 leaves all to the trees."""
    df = cut(_pairs(labelled(sentences, blocks, speakers)))
    release(df.sparkSession)
    odds = F.expr(boundary_model(df).sql(FEATURES)) + F.when(F.col("certain"), known * (2 * F.col("differ") - 1)).otherwise(0.0)
    df = df.withColumn("ends", F.when(F.col("first"), F.lit(1)).otherwise((odds > 0).cast("int")))
    order = Window.partitionBy("session_id", "agenda_item_index").orderBy("sec", "speech_block_index", "sentence_index", "sentence_id")
    return df.withColumn("turn", F.sum("ends").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def turns(sentences: DataFrame, blocks: DataFrame, speakers: DataFrame) -> DataFrame:
    """(session_id, agenda_item_index, turn, speaker, start_second, end_second, n_sentences, first_sentence_id, last_sentence_id, text)."""
    df = turn_sentences(sentences, blocks, speakers)
    place = F.struct("sec", "speech_block_index", "sentence_index", "sentence_id")
    made = df.groupBy("session_id", "agenda_item_index", "turn").agg(
        F.min_by(F.coalesce("who", "form"), place).alias("speaker"), F.min("sec").alias("start_second"), F.max("sec").alias("end_second"), F.count("*").alias("n_sentences"),
        F.min_by("sentence_id", place).alias("first_sentence_id"), F.max_by("sentence_id", place).alias("last_sentence_id"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "clean_text"))), lambda x: x["clean_text"]), " ").alias("text"))
    return made


def turn_ends(sentences: DataFrame, blocks: DataFrame, speakers: DataFrame) -> DataFrame:
    """(first_sentence_id, last_sentence_id) of every clean turn."""
    df = turn_sentences(sentences, blocks, speakers)
    place = F.struct("sec", "speech_block_index", "sentence_index", "sentence_id")
    made = df.groupBy("session_id", "agenda_item_index", "turn").agg(F.min_by("sentence_id", place).alias("first_sentence_id"), F.max_by("sentence_id", place).alias("last_sentence_id"))
    return made.select("first_sentence_id", "last_sentence_id")
