"""Variant spellings of names typed by people: which spellings name the same person or organisation.

1. Every distinct spelling is read once: titles, post-nominals, offices and brackets go, reordered parts are put in
   order, initials split; what names an office, a number or nobody is set apart.
2. Misspelt tokens: a prefix-filtered set-similarity join on the tokens' padded trigrams. Tokens keep only their rarest
   trigrams (as many as the edits allowed could spoil, plus one), meet on them, and are verified by edit distance. A token may
   stand for a more frequent one: for one at least ``TIMES`` as frequent as such, for any other if of the given
   names that are written with it ``SHARED`` are written with the other as well (for given names: of the surnames).
3. Short forms of given names are learned from the tables: two given names that stand with one surname in a row and its
   aliases, or a given name unknown for a surname where one person of that surname attended (``short_forms``).
4. Candidates are verified by soft weighted token similarity: each token counts by its inverse frequency, so that rare
   tokens count more, and as far as its partner is like it. Organisations meet on rare tokens; words that are missing on both
   sides speak against them, initials stand for the words that they begin (``org_variants``). People meet on their corrected
   surname; what the label says is weighed token by token (``resolve``), and the best one is taken if no other is as good.
5. What stays open (initials, surnames alone) is settled by who attended the session.

Scale: everything is per distinct spelling or token and joins on tokens, people or sessions; labels go back to their
blocks by one join. Frequent surnames are no hot group: candidates are bounded by the people of that surname.

Defined results
* null, empty and wordless labels, numbers, offices and placeholders name nobody;
* null elements and duplicates among aliases and sessions are ignored; of rows repeated under one id the first counts;
* a surname alone needs exactly one attending person of that surname; initials that fit several attending people name nobody;
* two or more initials after a word, without a comma, are an organisation's (people's stand before the surname or after a comma).
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.runtime import cut, release

EDITS, TIMES, SHARED = 2, 4, 0.75
#: Least similarity of two spellings of one organisation, how far behind any other one must be, and the share of weight in equal words.
ALIKE, CLEAR, EXACT = 0.75, 0.1, 0.4

#: Titles, post-nominals, words that begin an office, words that mark an organisation.
TITLES = set("the hon honourable honorable rt right dr mr mrs ms miss mx sir dame lord lady prof professor senator sen rev reverend madam madame mdm mister".split())
POSTNOMINALS = set("mp mps kc qc sc jp obe mbe cbe phd esq jr sr bss witness".split())
OFFICES = set("minister ministers member attorney leader deputy independent government opposition backbencher parliamentary clerk president speaker chairman chairperson chair chairwoman secretary solicitor prime premier senator whip witness".split())
PRESIDING = {"speaker", "president", "chair", "chairman", "chairperson", "chairwoman"}
NOBODY = set("unknown unidentified unnamed inaudible crowd audience several voices voice members member person speaker an name not caught some all honourable hon a male female various gallery public".split())
ORGANISATION = set("trust company federation association union cooperative chamber council board society institute agency authority corporation limited bank party group commission committee foundation guild league university college".split())
#: Abbreviations inside names of organisations.
SHORT = {"fed": "federation", "assoc": "association", "assn": "association", "coop": "cooperative", "co-op": "cooperative", "co": "company", "ltd": "limited", "corp": "corporation", "inst": "institute", "soc": "society", "auth": "authority", "dept": "department", "univ": "university"}
SMALL_WORDS = set("the of and for in at on de la limited".split())
#: How often a short form must be met, and from where on it need not look like the full one; letters that words of one stem share.
SUPPORT, PLENTY, ATTENDED, STEM = 2, 6, 4, 4
#: What a label's token counts for a person: the name itself, a short form of it, its initial; no middle initial known.
SHORTENED, INITIAL, OPEN = 0.95, 0.8, 0.5
_INITIALS = re.compile(r"(?<=[^\W\d_]{2})\s+((?:[^\W\d_]\.\s?(?:(?:&|and|of|the)\s?)?){2,})(?=\s|$)")

PARSED = "label string, kind string, given string, inits string, surname string, comma boolean, words array<string>"


def fold(s: str) -> str:
    """Lower case without marks."""
    return "".join(c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", s).casefold()) if not unicodedata.combining(c))


def _stem(w: str) -> str:
    w = SHORT.get(w, w)
    return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w


def parse(label: str | None) -> tuple:
    """(kind, given, initials, surname, comma, words); kind: person, org, presiding, number, office or nobody."""
    none = ("nobody", None, None, None, False, [])
    if label is None:
        return none
    s = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", label)).strip().lstrip("> ").rstrip(" :—–-").strip()
    if m := re.fullmatch(r"\[(.*)\]", s):
        s = m[1].strip()
    low = fold(s)
    if m := re.fullmatch(r"(?:speaker|member|person|voice)[ _#-]*0*(\d+)", low):
        return ("number", m[1], None, None, False, [])
    bare = re.findall(r"[^\W\d_]+", re.sub(r"\(.*?\)", " ", low))
    core = [w for w in bare if w not in TITLES]
    if not core and not any(w in TITLES for w in bare):
        return none
    if len(core) == 1 and core[0] in PRESIDING:
        return ("presiding", None, None, None, False, [])
    if not core or all(w in NOBODY for w in core):
        return none
    if core[0] in OFFICES:
        return ("office", None, None, None, False, core)
    # organisations keep what stands in brackets, except a role; initials become one token
    brief = _INITIALS.search(low) if "," not in low and bare[0] not in TITLES - {"the"} else None
    if brief and re.sub(r"\W", "", brief[1]) in POSTNOMINALS:
        brief = None
    initials = ["=" + "".join(sorted(re.findall(r"([^\W\d_])\.", brief[1])))] if brief else []
    text = low[: brief.start()] + " " + low[brief.end() :] if brief else low
    words = [w.replace("'", "").replace("’", "") for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", text)]
    full = [SHORT.get(w, w) for w in words]
    if words and (initials or any(w in ORGANISATION for w in full)) and not (words[0] in TITLES - {"the"}):
        kept = sorted({_stem(w) for w in full if w not in SMALL_WORDS and w not in POSTNOMINALS} | set(initials))
        return ("org", None, None, None, False, kept)
    s = re.sub(r"\(.*?\)", " ", s)
    parts = [p.strip() for p in s.split(",") if p.strip()]
    kept_parts = []
    for p in parts:
        ws = re.findall(r"[^\W\d_]+", fold(p))
        joined = "".join(ws)
        # "K.C." follows a name; "K. C." are initials
        if kept_parts and ((joined in POSTNOMINALS and " " not in p) or (ws and ws[0] in OFFICES)):
            continue
        kept_parts.append(p)
    comma = len(kept_parts) == 2
    order = [kept_parts[1], kept_parts[0]] if comma else kept_parts
    tokens: list[tuple[str, bool]] = []
    for raw in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?", " ".join(order)):
        t = fold(raw.rstrip(".")).replace("'", "").replace("’", "")
        tokens.append((t, len(t) == 1 or (len(t) <= 3 and raw.endswith(".") and raw[:-1].isupper())))
    # initials glued to a surname look like titles: "DR.Lee"
    glued = re.match(r"[A-Z]{1,3}\.[^\W\d_]{2}", " ".join(order))
    while tokens and tokens[0][0] in TITLES and not glued:
        tokens.pop(0)
    dotted = re.findall(r"(?:[^\W\d_]\.){2,}", s)
    while len(tokens) > 1 and (tokens[-1][0] in POSTNOMINALS):
        tokens.pop()
    if len(tokens) > 2 and dotted and all(i for _, i in tokens[-2:]) and "".join(t for t, _ in tokens[-2:]) in POSTNOMINALS:
        tokens = tokens[:-2]
    if not tokens:
        return none
    if comma:
        last_words = re.findall(r"[^\W\d_]+", fold(kept_parts[0]))
        surname = last_words[-1] if last_words else tokens[-1][0]
        rest = tokens[: len(tokens) - len([w for w in last_words if w not in TITLES])] if last_words else tokens[:-1]
    else:
        surname, rest = tokens[-1][0], tokens[:-1]
    if len(surname) < 2:
        return none
    given = next((t for t, i in rest if not i), None)
    inits = "".join(t if i else t[0] for t, i in rest)
    return ("person", given, inits, surname, comma, [])


def _parse_batches(batches):
    for batch in batches:
        labels = batch.column(0).to_pylist()
        cols = list(zip(*(parse(x) for x in labels))) if labels else [[]] * 6
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(cols, types)], names=["label", "kind", "given", "inits", "surname", "comma", "words"])


def read_labels(labels: DataFrame) -> DataFrame:
    """``labels`` (label, n), distinct, with what each spelling says."""
    # few bytes, much work: spread over all cores
    spread = labels.repartition(4 * labels.sparkSession.sparkContext.defaultParallelism, "label")
    parsed = spread.select("label").mapInArrow(_parse_batches, PARSED)
    return labels.join(parsed, "label").select("label", "n", "kind", "given", "inits", "surname", "comma", "words")


def _trigrams(token: Column) -> Column:
    padded = F.concat(F.lit("^^"), token, F.lit("$$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(token) + 2), lambda i: F.concat("role", F.lit(":"), F.substring(padded, i, F.lit(3)))))


def _allowed(token: Column, far: Column, other: Column) -> Column:
    """Is ``other`` within the edits that a token of this length may have? Swapped letters count as one."""
    swapped = (F.length(token) == F.length(other)) & (F.array_sort(F.split(token, "")) == F.array_sort(F.split(other, "")))
    return far <= F.when(F.length(token) >= 6, EDITS).when((F.length(token) >= 4) & swapped, 2).otherwise(1)


def token_variants(tokens: DataFrame) -> DataFrame:
    """(role, token, to, n, to_n, far, sim): the more frequent tokens that a token may be a misspelling of. ``tokens``: role, token, n, fixed (no misspelling)."""
    long = tokens.filter("length(token) >= 3")
    grams = long.select("role", "token", "n", "fixed", F.explode(_trigrams(F.col("token"))).alias("g"))
    freq = grams.groupBy("g").agg(F.count("*").alias("gn"))
    # an edit spoils at most three trigrams, swapped letters four: what survives shows in the rarest of one more
    ranked = grams.join(freq, "g").withColumn("r", F.row_number().over(Window.partitionBy("role", "token").orderBy("gn", "g")))
    prefix = cut(ranked.filter(F.col("r") <= F.when(F.length("token") < 6, 5).otherwise(3 * EDITS + 1)).select("role", "token", "n", "fixed", "g"))
    rare = prefix.filter("NOT fixed").drop("fixed")
    often = prefix.select("g", F.col("token").alias("to"), F.col("n").alias("to_n"))
    met = rare.join(often, "g").filter("token <> to AND (to_n > n OR (to_n = n AND to < token))").filter(F.abs(F.length("token") - F.length("to")) <= EDITS).select("role", "token", "to", "n", "to_n").distinct()
    swapped = (F.length("token") == F.length("to")) & (F.array_sort(F.split("token", "")) == F.array_sort(F.split("to", "")))
    near = met.withColumn("far", F.levenshtein("token", "to")).filter(_allowed(F.col("token"), F.col("far"), F.col("to"))).withColumn("far", F.when(swapped, 1).otherwise(F.col("far")))
    return near.withColumn("sim", 1 - F.col("far") / F.greatest(F.length("token"), F.length("to")))


def short_forms(parsed: DataFrame, spelt: DataFrame, uses: DataFrame, attended: DataFrame) -> DataFrame:
    """(short, full): given names that stand for another one, as the tables show it.

    A row of the registry with both under one surname counts twice; so does a surname of which one attended ``ATTENDED``
    sessions or more, and the other all of these; a session counts once if a label gives a name that no
    row has with the surname while all rows of that surname that attended have one other. ``SUPPORT`` must be reached, and
    names that share neither their first letter nor two letters in a row need ``PLENTY``. Names within the edits of a
    misspelling are left to the correction, unless they differ twice and are met ``PLENTY`` times.
    """
    whole = parsed.filter("kind = 'person' AND length(given) > 1").select("label", "given", "surname")
    rows = spelt.select("canonical_id", "label").join(whole, "label").select("canonical_id", "given", "surname").distinct()
    rows = cut(rows)
    other = rows.select("canonical_id", "surname", F.col("given").alias("full"))
    one = rows.join(other, ["canonical_id", "surname"]).filter("given <> full").groupBy("given", "full").agg((2 * F.countDistinct("canonical_id")).alias("k"))
    there = cut(rows.join(attended, "canonical_id").select("surname", "session_id", F.col("given").alias("full")).distinct())
    said = uses.join(whole, "label").select("given", "surname", "session_id").distinct().join(rows.select("surname", "given").distinct(), ["surname", "given"], "left_anti")
    alone = said.join(there, ["surname", "session_id"]).groupBy("given", "surname", "session_id").agg(F.min("full").alias("full"), F.max("full").alias("_most")).filter("full = _most")
    two = alone.groupBy("given", "full").agg(F.count("*").alias("k"))
    # a name whose sessions are all among those of another one with its surname
    met = there.join(there.select("surname", "session_id", F.col("full").alias("given")), ["surname", "session_id"])
    inside = met.groupBy("surname", "given", "full").agg(F.count("*").alias("c"))
    size = inside.filter("given = full").select("surname", "given", F.col("c").alias("size"))
    three = inside.filter("given <> full").join(size, ["surname", "given"]).filter((F.col("c") == F.col("size")) & (F.col("size") >= ATTENDED)).groupBy("given", "full").agg((2 * F.count("*")).alias("k"))
    # short plans: what the driver keeps of a plan grows with its square
    one, three = cut(one.unionByName(two)), cut(three)
    number = cut(rows.groupBy("given").agg(F.count("*").alias("rn")))
    # a misspelling in a row or two with its origin is no short form, nor has it any
    twice = number.select(F.col("given").alias("full"), F.col("rn").alias("fn"))
    typos = rows.join(other, ["canonical_id", "surname"]).filter("given <> full").groupBy("given", "full").agg(F.count("*").alias("c")).filter("c <= 2").join(number, "given").join(twice, "full")
    typos = typos.filter(_allowed(F.col("given"), F.levenshtein("given", "full"), F.col("full")) & (F.length("given") >= 5) & (F.col("fn") >= 2 * F.col("rn"))).select("given").distinct()
    typos = cut(typos)
    both = one.unionByName(three).groupBy("given", "full").agg(F.sum("k").alias("k")).filter(F.col("k") >= SUPPORT)
    both = both.join(typos, "given", "left_anti").join(typos.withColumnRenamed("given", "full"), "full", "left_anti")
    both = both.join(number, "given", "left").join(twice, "full")
    shape = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))
    like = (F.left("given", F.lit(1)) == F.left("full", F.lit(1))) | F.arrays_overlap(shape(F.col("given")), shape(F.col("full")))
    far = F.levenshtein("given", "full")
    apart = ~_allowed(F.col("given"), far, F.col("full")) | ((F.col("k") >= PLENTY) & (far >= 2))
    # the longer one is the full one, unless the shorter is met in many rows and the longer in less than half as many
    rn, longer, even = F.coalesce("rn", F.lit(0)), F.length("full") > F.length("given"), F.length("full") == F.length("given")
    fuller = (longer & ((2 * F.col("fn") >= rn) | (F.col("k") < PLENTY))) | (even & (F.col("fn") > rn)) | (~longer & ~even & (F.col("fn") > 2 * rn) & (F.col("k") >= PLENTY))
    kept = both.filter(apart & (like | (F.col("k") >= PLENTY)) & fuller)
    # a name that fits several times as often elsewhere was met by chance
    most = F.max("k").over(Window.partitionBy("given"))
    return kept.withColumn("_m", most).filter("5 * k >= _m").select(F.col("given").alias("short"), "full")


def org_variants(orgs: DataFrame) -> DataFrame:
    """(org, to): the more frequent word set of the same organisation. ``orgs``: org (sorted words), n."""
    brief = F.col("org").startswith("=")
    spelt_out = _spelt_out(orgs.filter(brief), orgs.filter(~brief))
    orgs = orgs.filter(~brief)
    words = orgs.select("org", F.explode(F.split("org", " ")).alias("w"))
    weight = words.groupBy("w").agg(F.log(1 + F.lit(float(orgs.count())) / F.count("*")).alias("idf"))
    words = words.join(weight, "w")
    every = Window.partitionBy("org")
    before = F.coalesce(F.sum("idf").over(every.orderBy(F.desc("idf"), "w").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("idf").over(every)
    # similar sets have EXACT of either weight in words that are equal, so they meet on a word before the rest falls below that
    words = cut(words.select("org", "w", "idf", (before <= (1 - EXACT) * total + 1e-9).alias("rare")))
    sets = orgs.join(words.groupBy("org").agg(F.collect_list(F.struct("w", "idf")).alias("ws"), F.sum("idf").alias("total")), "org")
    rare = words.filter("rare").select("org", "w")
    met = rare.join(rare.select(F.col("org").alias("to"), "w"), "w").filter("org <> to").select("org", "to").distinct()
    met = met.join(sets, "org").join(sets.select(F.col("org").alias("to"), F.col("n").alias("to_n"), F.col("ws").alias("to_ws"), F.col("total").alias("to_total")), "to")
    met = met.filter("to_n > n OR (to_n = n AND to < org)")
    stem = f"length(x.w) > {STEM} AND length(y.w) > {STEM} AND left(x.w, {STEM}) = left(y.w, {STEM})"
    near = ("CASE WHEN x.w = y.w THEN 1D WHEN least(length(x.w), length(y.w)) >= 4 AND levenshtein(x.w, y.w) <= CASE WHEN length(x.w) >= 6 THEN 2 ELSE 1 END "
            f"THEN 1 - levenshtein(x.w, y.w) / greatest(length(x.w), length(y.w)) WHEN {stem} THEN 0.5D ELSE 0D END")
    fit = lambda a, b: F.expr(f"transform({a}, x -> struct(x.idf AS idf, array_max(transform({b}, y -> {near})) AS fit))")
    met = met.withColumn("one", fit("ws", "to_ws")).withColumn("two", fit("to_ws", "ws"))
    # a word that each side lacks is another place or trade, not another spelling
    met = met.filter("NOT exists(one, x -> x.fit = 0) OR NOT exists(two, x -> x.fit = 0)")
    common = "aggregate({}, 0D, (acc, x) -> acc + x.idf * x.fit)"
    met = met.select("org", "to", (F.expr(f"{common.format('one')} + {common.format('two')}") / (F.col("total") + F.col("to_total"))).alias("alike")).filter(F.col("alike") >= ALIKE)
    best = Window.partitionBy("org").orderBy(F.desc("alike"), "to")
    met = met.withColumn("r", F.row_number().over(best)).withColumn("next", F.lead("alike").over(best))
    found = cut(met.filter((F.col("r") == 1) & (F.col("next").isNull() | (F.col("next") < F.col("alike") - CLEAR))).select("org", "to"))
    # what is a variant itself leads on to its own origin; each step leads to a more frequent one
    found = cut(found.unionByName(spelt_out))
    for _ in range(2):
        found = found.join(found.select(F.col("org").alias("to"), F.col("to").alias("end")), "to", "left").select("org", F.coalesce("end", "to").alias("to"))
    return found


def _spelt_out(brief: DataFrame, orgs: DataFrame) -> DataFrame:
    """(org, to): sets with initials, and the one set of organisations that has all their other words and whose further words begin with the initials."""
    words = orgs.select(F.col("org").alias("to"), "n", F.split("org", " ").alias("to_ws"), F.explode(F.split("org", " ")).alias("w"))
    often = words.groupBy("w").agg(F.count("*").alias("wn"))
    # the first token is the initials: "=" sorts before letters
    said = brief.select("org", F.substring(F.split("org", " ")[0], 2, 9).alias("letters"), F.slice(F.split("org", " "), 2, 99).alias("ws")).filter("size(ws) > 0")
    # met on the rarest word
    rare = said.select("org", F.explode("ws").alias("w")).join(often, "w").groupBy("org").agg(F.min_by("w", F.struct("wn", "w")).alias("w"))
    met = said.join(rare, "org").join(words, "w").filter("size(array_except(ws, to_ws)) = 0")
    begun = F.array_join(F.array_sort(F.transform(F.array_except("to_ws", "ws"), lambda w: F.left(w, F.lit(1)))), "")
    return met.filter(begun == F.col("letters")).groupBy("org").agg(F.max_by("to", F.struct("n", "to")).alias("to"))


def _with_fulls(df: DataFrame, given: str, shorts: DataFrame) -> DataFrame:
    """``df`` with ``fulls``: the given names that its given name may stand for; null where it is no short form."""
    return df.join(shorts.groupBy(F.col("short").alias(given)).agg(F.collect_set("full").alias("fulls")), given, "left")


def corrected(parsed: DataFrame, shorts: DataFrame) -> DataFrame:
    """``parsed`` labels with parts in order and misspelt tokens replaced: adds ``g`` (given), ``s`` (surname), ``org``, and how like the tokens are (``g_sim``, ``s_sim``)."""
    people = parsed.filter("kind = 'person'")
    plain = people.filter("NOT comma AND given IS NOT NULL")
    sides = plain.select(F.explode(F.array(F.struct(F.col("given").alias("token"), F.lit(1).alias("first"), "n"), F.struct(F.col("surname").alias("token"), F.lit(0).alias("first"), "n"))).alias("x")).select("x.*")
    lean = cut(sides.groupBy("token").agg(((F.sum(F.col("first") * F.col("n")) + 0.5) / (F.sum((1 - F.col("first")) * F.col("n")) + 0.5)).alias("lean")))
    one, two = lean.select(F.col("token").alias("given"), F.col("lean").alias("l1")), lean.select(F.col("token").alias("surname"), F.col("lean").alias("l2"))
    df = parsed.join(one, "given", "left").join(two, "surname", "left")
    turn = (F.col("kind") == "person") & ~F.col("comma") & (F.length("inits") == 1) & (F.col("l2") > 6 * F.col("l1")) & (F.col("l2") > 2)
    df = df.withColumn("_g", F.when(turn, F.col("surname")).otherwise(F.col("given"))).withColumn("_s", F.when(turn, F.col("given")).otherwise(F.col("surname")))
    df = df.withColumn("inits", F.when(turn, F.substring("surname", 1, 1)).otherwise(F.col("inits"))).drop("l1", "l2", "given", "surname")
    df = cut(df.withColumnsRenamed({"_g": "given", "_s": "surname"}))
    tokens = df.select("n", F.expr(
        "inline(concat(array(struct('g' AS role, given AS token), struct('s' AS role, surname AS token)), transform(words, w -> struct('o' AS role, w AS token))))"), "kind")
    tokens = tokens.filter("token IS NOT NULL AND token NOT LIKE '=%' AND kind IN ('person', 'org')").groupBy("role", "token").agg(F.sum("n").alias("n"))
    # short forms are no misspellings
    listed = shorts.select(F.lit("g").alias("role"), F.col("short").alias("token"), F.lit(True).alias("fixed")).distinct()
    near = cut(token_variants(tokens.join(listed, ["role", "token"], "left").withColumn("fixed", F.coalesce("fixed", F.lit(False)))))
    # a token about as frequent as its origin must be written with little that its origin is not written with
    pairs = cut(df.filter("kind = 'person' AND given IS NOT NULL").groupBy("given", "surname").agg(F.sum("n").alias("pn")))
    partner = pairs.select(F.lit("s").alias("role"), F.col("surname").alias("token"), F.col("given").alias("with")).unionByName(pairs.select(F.lit("g").alias("role"), F.col("given").alias("token"), F.col("surname").alias("with")))
    sure = F.col("to_n") >= TIMES * F.col("n")
    held = near.filter(~sure).join(partner, ["role", "token"]).join(partner.select("role", F.col("token").alias("to"), "with", F.lit(1).alias("also")), ["role", "to", "with"], "left")
    held = held.groupBy("role", "token", "to").agg(F.count("*").alias("wn"), F.count("also").alias("an")).filter(F.col("an") >= SHARED * F.col("wn")).select("role", "token", "to")
    near = cut(near.filter(sure).unionByName(near.filter(~sure).join(held, ["role", "token", "to"], "left_semi")))
    # what is a misspelling itself is no origin of another one
    near = near.join(near.select("role", F.col("token").alias("to")).distinct(), ["role", "to"], "left_anti")
    # the likelier origin: frequent, and few edits away
    best = Window.partitionBy("role", "token").orderBy(F.desc(F.log("to_n") - 4 * F.col("far")), "to")
    near = cut(near.withColumn("r", F.row_number().over(best)))
    # the pairs that are written often decide between several corrections
    first = near.filter("role = 's' AND r = 1").select(F.col("token").alias("surname"), F.col("to").alias("s_to"), F.col("sim").alias("s_sim"))
    df = cut(df.join(first, "surname", "left").withColumn("s", F.coalesce("s_to", "surname")).withColumn("s_sim", F.coalesce("s_sim", F.lit(1.0))).drop("s_to"))
    options = df.filter("given IS NOT NULL").select("given", "s").distinct().join(near.filter("role = 'g'").select(F.col("token").alias("given"), F.col("to").alias("g_to"), "r", "sim"), "given")
    options = options.join(pairs.select(F.col("given").alias("g_to"), F.col("surname").alias("s"), "pn"), ["g_to", "s"], "left")
    pick = options.groupBy("given", "s").agg(F.max_by(F.struct("g_to", F.col("sim").alias("g_sim")), F.struct(F.col("pn").isNotNull(), "sim", F.coalesce("pn", F.lit(0)), -F.col("r"))).alias("x")).select("given", "s", "x.*")
    df = df.join(pick, ["given", "s"], "left").withColumn("g", F.coalesce("g_to", "given")).withColumn("g_sim", F.coalesce("g_sim", F.lit(1.0))).drop("g_to")
    words = df.filter("kind = 'org'").select("label", F.explode("words").alias("token")).join(near.filter("role = 'o' AND r = 1").select("token", "to"), "token", "left")
    orgs = words.groupBy("label").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("to", "token"))), " ").alias("org"))
    orgs = cut(orgs)
    same = org_variants(cut(orgs.join(df.select("label", "n"), "label").groupBy("org").agg(F.sum("n").alias("n"))))
    orgs = orgs.join(same, "org", "left").select("label", F.coalesce("to", "org").alias("org"))
    return df.join(orgs, "label", "left")


class Registry:
    """People and organisations of a speakers table, and how labels name them."""

    def __init__(self, speakers: DataFrame, uses: DataFrame):
        """``uses``: every label in use (label, session_id, n); a null label names nobody."""
        cols = ["name", "role", "party", "chamber", "title", "aliases", "session_ids"]
        sp = speakers.filter("canonical_id IS NOT NULL").groupBy("canonical_id").agg(F.min_by(F.struct(*cols), F.struct("created_at", F.xxhash64(*cols))).alias("r")).select("canonical_id", "r.*")
        self.rows = sp.select("canonical_id", "role", "party", "chamber", "title")
        spelt = sp.select("canonical_id", F.explode(F.concat(F.array(F.struct(F.col("name").alias("label"), F.lit(1).alias("own"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("label"), F.lit(0).alias("own"))))).alias("x")).select("canonical_id", "x.*").filter("label IS NOT NULL")
        self.spelt = spelt
        used = uses.filter("label IS NOT NULL").select("label", "n").unionByName(spelt.select("label", F.lit(2).cast("bigint").alias("n")))
        distinct = cut(used.groupBy("label").agg(F.sum("n").alias("n")))
        self.attended = sp.select("canonical_id", F.explode("session_ids").alias("session_id")).filter("session_id IS NOT NULL").distinct()
        parsed = cut(read_labels(distinct))
        self.shorts = cut(short_forms(parsed, spelt, uses.filter("label IS NOT NULL").select("label", "session_id"), self.attended))
        release(sp.sparkSession)
        self.read = cut(corrected(parsed, self.shorts))
        release(sp.sparkSession)
        self.members = cut(self._members())
        # who stands for whom: one row for each person or organisation and each session of any of its rows
        self.present = cut(self.members.join(self.attended, "canonical_id").select("who", "session_id").distinct())
        self.people = cut(self._people())
        release(sp.sparkSession)

    def _forms(self) -> DataFrame:
        return self.spelt.join(self.read, "label")

    def _members(self) -> DataFrame:
        """(canonical_id, who)."""
        forms = cut(self._forms().select("canonical_id", "own", "n", "kind", "g", "s", "inits", "org"))
        orgs = forms.filter("kind = 'org'").groupBy("canonical_id").agg(F.max_by("org", F.struct("own", "n")).alias("o"))
        orgs = orgs.select("canonical_id", F.concat(F.lit("o:"), "o").alias("who"))
        full = forms.filter("kind = 'person' AND g IS NOT NULL AND length(g) > 1").join(orgs, "canonical_id", "left_anti")
        full = _with_fulls(full, "g", self.shorts)
        stands = F.array_distinct(F.concat(F.array("g"), F.coalesce("fulls", F.array().cast("array<string>"))))
        wide = full.select("canonical_id", "own", "n", "s", F.explode(stands).alias("base"), "g", F.col("fulls").isNotNull().alias("short"))
        seen = wide.filter("base = g").groupBy("base", "s").agg(F.sum("n").alias("pn"), F.countDistinct("canonical_id").alias("rn"))
        # a short form stands for the longer name that occurs with the surname; the longer name for itself
        scored = wide.join(seen, ["base", "s"], "left").withColumn("fit", F.coalesce(F.when(F.col("short") & (F.col("base") == F.col("g")), F.lit(0)).otherwise(F.col("pn")), F.lit(-1)))
        per = scored.groupBy("canonical_id", "base", "s").agg(F.count("*").alias("k"), F.max("fit").alias("fit"), F.max("own").alias("own"))
        named = per.groupBy("canonical_id").agg(F.max_by(F.struct("base", "s"), F.struct("k", F.col("fit") > 0, "own", "fit", "base")).alias("p"))
        named = named.select("canonical_id", F.concat_ws(" ", F.lit("p:"), "p.base", "p.s").alias("who"))
        known = cut(orgs.unionByName(named))
        # rows with initials only: the person of that surname and those initials, sessions and roles deciding
        rest = forms.filter("kind = 'person' AND (g IS NULL OR length(g) <= 1)").join(known, "canonical_id", "left_anti")
        rest = cut(rest.groupBy("canonical_id").agg(F.max_by(F.struct("s", "inits"), F.struct(F.length("inits"), "own", "n")).alias("f")).select("canonical_id", "f.s", "f.inits"))
        mids = forms.filter("kind = 'person' AND length(inits) > 1").join(known, "canonical_id").groupBy("who").agg(F.max_by(F.substring("inits", 2, 1), F.col("n")).alias("mid"))
        person = known.filter("who LIKE 'p:%'").select("canonical_id", "who", F.element_at(F.split("who", " "), 2).alias("base"), F.element_at(F.split("who", " "), 3).alias("s")).join(mids, "who", "left")
        who = person.select("who", "base", "s", "mid").distinct()
        fits = (F.length("inits") == 0) | (F.substring("inits", 1, 1) == F.substring("base", 1, 1))
        same_mid = F.col("mid").isNull() | (F.length("inits") < 2) | (F.substring("inits", 2, 1) == F.col("mid"))
        cand = cut(rest.join(who, "s").filter(fits & same_mid).select("canonical_id", "who", (F.col("mid").isNotNull() & (F.length("inits") > 1)).cast("int").alias("exact_mid")))
        theirs = known.join(self.attended, "canonical_id").select("who", "session_id").distinct()
        size = theirs.groupBy("who").agg(F.count("*").alias("wn"))
        mine = self.attended.groupBy("canonical_id").agg(F.count("*").alias("rn"))
        common = cand.join(self.attended, "canonical_id").join(theirs, ["who", "session_id"]).groupBy("canonical_id", "who").agg(F.count("*").alias("cn"))
        facts = ["role", "party", "chamber", "title"]
        about = known.join(self.rows, "canonical_id").groupBy("who").agg(*[F.collect_set(F.nullif(F.col(c), F.lit(""))).alias(f"{c}s") for c in facts])
        score = cand.join(common, ["canonical_id", "who"], "left").join(size, "who", "left").join(mine, "canonical_id", "left").join(about, "who", "left").join(self.rows, "canonical_id")
        inside = F.coalesce(F.col("cn") / F.least("rn", "wn"), F.lit(0.0))
        agree = sum((F.when(F.array_contains(f"{c}s", F.col(c)), w).when(F.col(c).isNotNull() & (F.col(c) != "") & (F.size(f"{c}s") > 0), -w).otherwise(0.0) for c, w in (("role", 2.0), ("party", 1.0), ("chamber", 1.0), ("title", 0.5))), F.lit(0.0))
        sessions = F.when(F.col("rn").isNull() | F.col("wn").isNull(), 0.0).otherwise(F.when(inside >= 0.999, F.least(F.lit(4.0), F.least("rn", "wn").cast("double"))).otherwise(-6.0 * (1 - inside)))
        score = score.withColumn("score", sessions + agree + F.col("exact_mid"))
        top = Window.partitionBy("canonical_id").orderBy(F.desc("score"), "who")
        chosen = score.withColumn("r", F.row_number().over(top)).withColumn("next", F.lead("score").over(top)).filter("r = 1 AND score > -2.5 AND (next IS NULL OR score > next)").select("canonical_id", "who")
        chosen = cut(chosen)
        alone = rest.join(chosen, "canonical_id", "left_anti").select("canonical_id", F.concat_ws(" ", F.lit("i:"), "inits", "s").alias("who"))
        nameless = self.rows.select("canonical_id").join(known, "canonical_id", "left_anti").join(rest, "canonical_id", "left_anti").select("canonical_id", F.concat(F.lit("x:"), "canonical_id").alias("who"))
        return known.unionByName(chosen).unionByName(alone).unionByName(nameless)

    def _people(self) -> DataFrame:
        """(who, base, s, mid, init): how a person may be named."""
        df = self.members.select("who").distinct().filter("who LIKE 'p:%' OR who LIKE 'i:%'")
        df = df.withColumn("x", F.element_at(F.split("who", " "), 2)).withColumn("s", F.element_at(F.split("who", " "), -1))
        forms = self._forms().filter("kind = 'person' AND length(inits) > 1").join(self.members, "canonical_id")
        mids = forms.groupBy("who").agg(F.max_by(F.substring("inits", 2, 1), F.col("n")).alias("mid"))
        df = df.join(mids, "who", "left")
        return df.select("who", "s", F.when(F.col("who").startswith("p:"), F.col("x")).alias("base"), F.substring("x", 1, 1).alias("init"), "mid")

    def resolve(self, labels: DataFrame) -> DataFrame:
        """``labels`` (label, session_id), distinct, with ``kind``, ``who`` (null: nobody known), ``form`` and surname ``s``."""
        df = labels.join(self.read.select("label", "kind", "given", "g", "s", "g_sim", "s_sim", "inits", "org"), "label")
        names = df.filter("kind = 'person'")
        # every token weighs by its inverse frequency among the people; an initial by that of all who begin with it
        people = self.people
        total = F.lit(float(max(1, people.count())))
        weigh = lambda c, out: people.groupBy(c).agg(F.log(1 + total / F.count("*")).alias(out))
        names = names.withColumn("init", F.nullif(F.substring(F.coalesce("inits", F.lit("")), 1, 1), F.lit("")))
        names = names.join(weigh("s", "ws"), "s").join(weigh("base", "wb").withColumnRenamed("base", "g"), "g", "left").join(weigh("init", "wi"), "init", "left")
        given = F.coalesce(F.when(F.col("g").isNotNull(), F.coalesce("wb", F.log(1 + total))), F.when(F.col("init").isNotNull(), F.coalesce("wi", F.log(1 + total))), F.lit(0.0))
        middle = F.when((F.length("inits") > 1), F.log(F.lit(27.0)) / 4).otherwise(F.lit(0.0))
        same = F.when(F.col("mid").isNull(), OPEN).when(F.substring("inits", 2, 1) == F.col("mid"), 1.0).otherwise(0.0)
        # soft weighted similarity of the label's tokens to the person's
        alike = lambda fit: (F.col("ws") * F.col("s_sim") + F.col("wg") * fit + F.col("wm") * same) / (F.col("ws") + F.col("wg") + F.col("wm"))
        names = _with_fulls(names.withColumn("wg", given).withColumn("wm", middle), "g", self.shorts)
        # the surname is equal after correction. Three joins, each on all that the label says, so that no surname's labels meet all its people
        kept = ["label", "session_id", "who"]
        stands = F.array_distinct(F.concat(F.array("g"), F.coalesce("fulls", F.array().cast("array<string>"))))
        whole = names.filter("g IS NOT NULL").withColumn("base", F.explode(stands)).join(people.drop("init"), ["s", "base"])
        named = F.col("base") == F.col("g")
        clash = (F.length("inits") > 1) & F.col("mid").isNotNull() & (F.substring("inits", 2, 1) != F.col("mid"))
        whole = whole.select(*kept, F.when(named, 3).when(~clash, 2).otherwise(1).alias("level"), alike(F.when(named, F.col("g_sim")).otherwise(F.lit(SHORTENED))).alias("fit"))
        brief = names.filter("length(inits) > 0").join(people, ["s", "init"])
        brief = brief.filter("g IS NULL OR base IS NULL").select(*kept, F.when(~clash, 2).otherwise(1).alias("level"), alike(F.lit(INITIAL)).alias("fit"))
        alone = names.filter("g IS NULL AND length(inits) = 0").join(people.join(self.present, "who").select("s", "session_id", "who", "mid"), ["s", "session_id"])
        alone = alone.select(*kept, F.lit(0).alias("level"), alike(F.lit(0.0)).alias("fit"))
        cand = cut(whole.unionByName(brief).unionByName(alone))
        cand = cand.join(self.present.withColumn("there", F.lit(1)), ["who", "session_id"], "left").withColumn("there", F.coalesce("there", F.lit(0)))
        # a full name needs no attendance; of several, one that attended is meant; a surname alone must have attended
        rank = F.struct((F.col("level") == 3).cast("int").alias("a"), "there", F.round("fit", 6).alias("fit"))
        order = Window.partitionBy("label", "session_id").orderBy(F.desc(rank), "who")
        cand = cand.withColumn("rank", rank).withColumn("next", F.lead(rank).over(order)).withColumn("r", F.row_number().over(order)).filter("r = 1")
        clear = F.col("next").isNull() | (F.col("next") < F.col("rank"))
        allowed = (F.col("level") >= 2) | (F.col("there") == 1)
        person = cand.filter(clear & allowed).select(F.col("label").alias("_l"), F.col("session_id").alias("_i"), F.col("who").alias("_p"))
        orgs = self.members.filter("who LIKE 'o:%'").select(F.col("who").alias("_o")).distinct()
        df = df.join(person, F.col("label").eqNullSafe(F.col("_l")) & F.col("session_id").eqNullSafe(F.col("_i")), "left").drop("_l", "_i")
        df = df.withColumn("_k", F.concat(F.lit("o:"), "org")).join(orgs, F.col("_k") == F.col("_o"), "left")
        form = F.when(F.col("kind") == "person", F.concat_ws(" ", F.lit("f:"), F.coalesce("g", "inits"), "s")).when(F.col("kind") == "org", F.col("_k")).when(F.col("kind") == "number", F.concat(F.lit("n:"), "given")).when(F.col("kind") == "presiding", F.lit("presiding")).otherwise(F.lit("nobody"))
        return df.select("label", "session_id", "kind", F.coalesce("_p", "_o").alias("who"), form.alias("form"), "s", "inits", "g")


def linked(speakers: DataFrame, blocks: DataFrame) -> DataFrame:
    """(key_a, key_b): pairs of speakers rows, and of blocks and speakers rows, of one person or organisation."""
    said = blocks.filter("block_id IS NOT NULL").select("block_id", "session_id", F.col("speaker_name").alias("label"), "created_at").filter("label IS NOT NULL")
    said = said.groupBy("block_id").agg(F.max_by(F.struct("session_id", "label"), F.struct("created_at", "label")).alias("b")).select("block_id", "b.*")
    said = cut(said)
    uses = cut(said.groupBy("label", "session_id").agg(F.count("*").alias("n")))
    reg = Registry(speakers, uses)
    named = cut(reg.resolve(uses.select("label", "session_id")).filter("who IS NOT NULL").select("label", "session_id", "who"))
    named = named.withColumnsRenamed({"label": "_l", "session_id": "_i"})
    there = said.join(named, F.col("label").eqNullSafe(F.col("_l")) & F.col("session_id").eqNullSafe(F.col("_i"))).select("block_id", "who")
    one = reg.members.select("who", F.concat(F.lit("speaker:"), "canonical_id").alias("x"))
    two = reg.members.select("who", F.concat(F.lit("speaker:"), "canonical_id").alias("y"))
    rows = one.join(two, "who").filter("x < y").select("x", "y")
    cross = there.join(one, "who").select(F.concat(F.lit("block:"), F.col("block_id").cast("string")).alias("y"), "x")
    both = rows.unionByName(cross)
    return both.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()
