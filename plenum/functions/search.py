"""Full-text vectors and queries: stemmed lexemes with positions, all-terms match, rank.

Words are cut to their stems by Porter's algorithm of 1980; stop words have no lexeme, but count as positions. Null texts
have an empty vector; words of one or two letters and words in other alphabets stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English words without weight in a search.
STOPWORDS = set("i me my we our ours you your he him his she her it its they them their what which who whom this that these those am is are was were be been being have has had do does did a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split())

#: Porter's steps 2, 3 and 4, a suffix and what takes its place.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
         "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

# a word as runs of vowels and consonants; a y is a vowel unless it begins the word
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
MEASURED, MEASURED_ONCE, MEASURED_TWICE = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}"
VOWEL, SHORT = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _cut(w: Column, n: int) -> Column:
    return F.left(w, F.greatest(F.length(w) - n, F.lit(0)))


def _replaced(w: Column, table: dict[str, str], measure: str) -> Column:
    """The longest suffix of ``table`` replaced if what stands before it is long enough."""
    out = w
    for suffix in sorted(table, key=len):
        before = _cut(w, len(suffix))
        out = F.when(F.endswith(w, F.lit(suffix)), F.when(before.rlike(measure), F.concat(before, F.lit(table[suffix]))).otherwise(w)).otherwise(out)
    return out


def _plural(w: Column) -> Column:
    return F.when(F.endswith(w, F.lit("sses")) | F.endswith(w, F.lit("ies")), _cut(w, 2)).when(w.rlike("[^s]s$"), _cut(w, 1)).otherwise(w)


def _past(w: Column) -> Column:
    mended = lambda b: F.when(b.rlike("(at|bl|iz)$"), F.concat(b, F.lit("e"))).when(b.rlike(r"([^aeiouylsz])\1$"), _cut(b, 1)).when(b.rlike(SHORT), F.concat(b, F.lit("e"))).otherwise(b)
    loose = lambda n: F.when(_cut(w, n).rlike(VOWEL), _with(_cut(w, n), mended)).otherwise(w)
    return F.when(F.endswith(w, F.lit("eed")), F.when(_cut(w, 3).rlike(MEASURED), _cut(w, 1)).otherwise(w)).when(F.endswith(w, F.lit("ed")), loose(2)).when(F.endswith(w, F.lit("ing")), loose(3)).otherwise(w)


def _final_y(w: Column) -> Column:
    return F.when(F.endswith(w, F.lit("y")) & _cut(w, 1).rlike(VOWEL), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _fourth(w: Column) -> Column:
    plain = _replaced(w, dict.fromkeys(STEP4, ""), MEASURED_TWICE)
    return F.when(w.rlike("[st]ion$"), F.when(_cut(w, 3).rlike(MEASURED_TWICE), _cut(w, 3)).otherwise(w)).otherwise(plain)


def _fifth(w: Column) -> Column:
    return F.when(F.endswith(w, F.lit("e")) & (_cut(w, 1).rlike(MEASURED_TWICE) | (_cut(w, 1).rlike(MEASURED_ONCE) & ~_cut(w, 1).rlike(SHORT))), _cut(w, 1)).otherwise(w)


def _double_l(w: Column) -> Column:
    return F.when(F.endswith(w, F.lit("ll")) & w.rlike(MEASURED_TWICE), _cut(w, 1)).otherwise(w)


def stem(word: Column) -> Column:
    """Porter's stem of a lower-case word."""
    steps = [_plural, _past, _final_y, lambda w: _replaced(w, STEP2, MEASURED), lambda w: _replaced(w, STEP3, MEASURED), _fourth, _fifth, _double_l]
    # a y at the head is a consonant
    out = F.regexp_replace(word, "^y", "Y")
    for step in steps:
        out = _with(out, step)
    return F.when(word.rlike("^[a-z]{3,}$"), F.lower(out)).otherwise(word)


def placed_words(text: Column) -> Column:
    """The words of ``text`` with their 1-based positions, stop words left out but counted."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)
    placed = F.transform(words, lambda w, i: F.struct(w.alias("lexeme"), (i + 1).alias("position")))
    return F.filter(placed, lambda x: ~x["lexeme"].isin(sorted(STOPWORDS)))


def lexemes(text: Column) -> Column:
    """The stems of the words of ``text`` with their positions (see ``placed_words``)."""
    return F.transform(placed_words(text), lambda x: F.struct(stem(x["lexeme"]).alias("lexeme"), x["position"].alias("position")))


def vector_text(vector: Column) -> Column:
    """A vector in the notation of text search tables: ``'lexeme':1,5 'other':2``, in order of lexemes."""
    names = F.array_sort(F.array_distinct(F.transform(vector, lambda x: x["lexeme"])))
    places = lambda n: F.array_join(F.transform(F.filter(vector, lambda x: x["lexeme"] == n), lambda x: x["position"].cast("string")), ",")
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("':"), places(n))), " ")


def query_terms(text: str) -> list[str]:
    """The words of a plain query, stop words left out, each once."""
    import re

    return list(dict.fromkeys(w for w in re.findall(r"[^\W_]+", text.lower()) if w not in STOPWORDS))


def beginning(stem: str) -> str:
    """What every word of a stem begins with: the rules change the last two letters at most."""
    return stem[:-2] if len(stem) > 3 else stem[:1]


def _is(stem: str) -> Callable[[Column], Column]:
    return lambda x: x["lexeme"] == stem


def _distances(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.abs(x - y))))


def matches(vector: Column, stems: list[str]) -> Column:
    """Are all ``stems`` among the lexemes? A query without terms matches nothing."""
    out = F.lit(bool(stems))
    for s in stems:
        out = out & F.exists(vector, _is(s))
    return out


def rank(vector: Column, stem: str) -> Column:
    """Rank of one stem with n hits: 0.1 (1 + 1/4 + ... + 1/n^2) over pi^2/6."""
    hits = F.size(F.filter(vector, _is(stem)))
    harmonic = F.aggregate(F.slice(F.sequence(F.lit(0), hits), 2, F.greatest(hits, F.lit(1))), F.lit(0.0), lambda s, j: s + 1.0 / (j * j))
    return 0.1 * harmonic / 1.64493406685


def rank_all(vector: Column, stems: list[str]) -> Column:
    """Rank of a query whose stems must all be there: one as in ``rank``; of several, every pair of their places adds by nearness.

    A pair d words apart (up to 100) weighs 0.1 / sqrt(1.005 + 0.05 e^(d / 1.5 - 2)); weights join as 1 - (1 - a)(1 - b).
    """
    if not stems:
        return F.lit(0.0)
    if len(stems) == 1:
        return rank(vector, stems[0])
    missed = F.lit(1.0)
    places = [F.transform(F.filter(vector, _is(s)), lambda x: x["position"]) for s in stems]
    for i in range(len(stems)):
        for j in range(i):
            near = F.filter(_distances(places[i], places[j]), lambda d: (d > 0) & (d <= 100))
            missed = missed * F.aggregate(near, F.lit(1.0), lambda s, d: s * (1 - 0.1 / F.sqrt(1.005 + 0.05 * F.exp(d / 1.5 - 2))))
    return 1 - missed
