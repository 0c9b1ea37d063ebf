"""Scalar text, time and identifier functions as Column expressions; nothing here leaves the JVM.

Null in, null out unless stated. Every function works on any length of text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles removed from a speaker's name, in the order in which they are tried.
TITLES = ["hon.", "honourable", "the honourable", "the hon.", "dr.", "dr", "mr.", "mr", "mrs.", "mrs", "ms.", "ms", "miss", "sir", "dame", "prof.",
          "professor", "senator", "sen.", "mp", "k.c.", "kc", "rev.", "rev"]
#: The date notations that are read.
DATE_FORMATS = ["yyyy-MM-dd", "d MMMM yyyy", "MMMM d, yyyy"]


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def time_to_seconds(text: Column) -> Column:
    """Seconds of ``XhYmZs``: hours, minutes and seconds are read in that order, fractions dropped.

    A part without a unit counts nothing (``30`` is 0, ``1m30`` is 60); empty text is 0; malformed text is null.
    """
    hours = F.when(F.contains(text, F.lit("h")), F.split_part(text, F.lit("h"), F.lit(1)))
    rest = F.when(hours.isNotNull(), F.split_part(text, F.lit("h"), F.lit(2))).otherwise(text)
    minutes = F.when(F.contains(rest, F.lit("m")), F.split_part(rest, F.lit("m"), F.lit(1)))
    tail = F.when(minutes.isNotNull(), F.split_part(rest, F.lit("m"), F.lit(2))).otherwise(rest)
    secs = F.when(F.contains(tail, F.lit("s")), _strip(F.regexp_replace(tail, "s", "")))
    whole = r"^\s*[+-]?\d+\s*$"
    number = r"^[+-]?(\d+\.?\d*|\.\d+)$"
    h = F.when(hours.isNull(), 0).when(hours.rlike(whole), _strip(hours).cast("bigint"))
    m = F.when(minutes.isNull(), 0).when(minutes.rlike(whole), _strip(minutes).cast("bigint"))
    s = F.when(secs.isNull() | (secs == ""), 0).when(secs.rlike(number), secs.cast("double").cast("bigint"))
    return F.when(text.isNotNull(), h * 3600 + m * 60 + s)


def seconds_to_time(seconds: Column) -> Column:
    """``XhYmZs`` of whole seconds; minutes are shown whenever hours are."""
    s = seconds.cast("bigint")
    hours, minutes, secs = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"))).otherwise(""),
                    F.when((hours > 0) | (minutes > 0), F.concat(minutes.cast("string"), F.lit("m"))).otherwise(""), secs.cast("string"), F.lit("s"))


def normalize_name(name: Column, mode: str = "reference") -> Column:
    """A speaker's name for comparison: lower case, titles stripped once each in order, punctuation dropped.

    ``reference`` strips a title wherever the name begins with its letters (``drake`` loses ``dr``), twice in one step;
    ``word`` strips whole words only.
    """
    start = _strip(F.lower(name))
    titles = F.array(*[F.lit(t) for t in TITLES])

    def cut(n: Column, t: Column, sep: str) -> Column:
        return F.when(F.startswith(n, F.concat(t, F.lit(sep))), _strip(F.substr(n, F.length(t) + 1))).otherwise(n)

    if mode == "reference":
        bare = F.aggregate(titles, start, lambda n, t: cut(cut(n, t, " "), t, ""))
    else:
        bare = F.aggregate(titles, start, lambda n, t: cut(n, t, " "))
    return _strip(F.regexp_replace(F.regexp_replace(bare, r"(?U)[^\w\s-]", ""), r"(?U)\s+", " "))


def surname(name: Column) -> Column:
    """The last word in lower case; empty for a blank name."""
    return F.coalesce(F.try_element_at(F.split(_strip(F.lower(name)), r"\s+"), F.lit(-1)), F.lit(""))


def session_id(sitting_number: Column, date: Column) -> Column:
    """``s_{sitting|unknown}_{yyyy_MM_dd}``; an empty sitting is unknown."""
    return F.concat(F.lit("s_"), F.coalesce(F.nullif(sitting_number, F.lit("")), F.lit("unknown")), F.lit("_"), F.date_format(date, "yyyy_MM_dd"))


def agenda_item_id(session: Column, index: Column) -> Column:
    return F.concat(session, F.lit("_a"), index.cast("string"))


def order_paper_id(chamber: Column, date: Column) -> Column:
    return F.concat(F.lit("op_"), F.when(chamber == "house", "h").otherwise("s"), F.lit("_"), F.date_format(date, "yyyy_MM_dd"))


def canonical_speaker_id(name: Column) -> Column:
    """The name's slug and eight digits of its hash: the same on every run."""
    n = normalize_name(name)
    return F.concat(F.replace(n, F.lit(" "), F.lit("-")), F.lit("-"), F.left(F.sha2(n, 256), F.lit(8)))


def video_id(url: Column) -> Column:
    """What follows ``v=`` up to ``&``, else what follows ``youtu.be/`` up to ``?``, else null."""
    after = lambda mark, end: F.split_part(F.split_part(url, F.lit(mark), F.lit(2)), F.lit(end), F.lit(1))
    return F.when(F.contains(url, F.lit("v=")), after("v=", "&")).when(F.contains(url, F.lit("youtu.be/")), after("youtu.be/", "?"))


def absolute_url(base: str, url: Column) -> Column:
    return F.when((url == "") | F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit(base), url))


def parse_date(text: Column) -> Column:
    """ISO date of text in one of three notations, else null."""
    t = _strip(text)
    return F.date_format(F.coalesce(*[F.try_to_date(t, f) for f in DATE_FORMATS]), "yyyy-MM-dd")


def sanitize_filename(name: Column) -> Column:
    # fixed value: the characters that no file name may have
    return F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1F]', "_")


def end_second(minutes: Column) -> Column:
    """The second at which the first ``minutes`` of a video end; null for none or zero: the whole video."""
    return F.when(minutes != 0, minutes * 60)


def context(text: Column, length: int = 200) -> Column:
    return F.left(text, F.lit(length))


def fill_if_empty(old: Column, new: Column) -> Column:
    """``old`` unless it is null or empty and ``new`` is not."""
    return F.coalesce(F.nullif(old, F.lit("")), F.nullif(new, F.lit("")), old)


def looks_truncated(json: Column) -> Column:
    """Does the text not end with a closing brace?"""
    return ~F.endswith(F.regexp_replace(json, r"\s+$", ""), F.lit("}"))


def segment_id(video: Column, second: Column, occurrence: Column) -> Column:
    """``{video}_{second, five digits}``, without second ``{video}_00000_cNN``."""
    plain = F.concat(video, F.lit("_"), F.lpad(F.coalesce(second, F.lit(0)).cast("string"), 5, "0"))
    return F.when(second.isNotNull(), plain).otherwise(F.concat(plain, F.lit("_c"), F.lpad(occurrence.cast("string"), 2, "0")))
