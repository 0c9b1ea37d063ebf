"""Which records have a description of their own.

A description is none of a record's own when it is null, blank, without any letter or digit, one of the usual
placeholders, or stock text: the same text, in any case and spacing, at several unrelated records. Records under one
text are unrelated when no word stands in the names of more than half of them (of two or three: in more than one).
The counts cover all rows; a text that a third of all rows share is pre-aggregated before every shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.runtime import cut

#: Placeholders, in lower case, final stops removed.
PLACEHOLDERS = ["unknown", "none", "null", "nil", "n/a", "na", "tbd", "tba", "todo", "to be done", "see above", "see below", "not available",
                "no description", "no description available", "description", "placeholder", "nan", "undefined"]
#: Rows that a text must stand at before it can be stock.
STOCK_ROWS = 3
SPACE = r"[\p{IsWhite_Space}]+"


def squeezed(text: Column) -> Column:
    """``text`` trimmed, white-space runs reduced to one blank."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def tokens(text: Column) -> Column:
    """The distinct lower-cased runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0))


def with_own_description(records: DataFrame, description: str = "description", name: str = "canonical_name") -> DataFrame:
    """``records`` with ``own_description``: the squeezed text, null where it is none of the record's own."""
    text = squeezed(F.col(description))
    bare = F.regexp_replace(F.lower(text), r"[ .!]+$", "")
    df = records.withColumn("own_description", F.when(text.rlike(r"[\p{L}\p{N}]") & ~bare.isin(PLACEHOLDERS), text))
    df = df.withColumn("_h", F.xxhash64(F.lower("own_description")))
    seen = df.filter("own_description IS NOT NULL")
    marked = seen.select("_h", F.explode(F.concat(F.array(F.lit("")), F.coalesce(tokens(F.col(name)), F.array().cast("array<string>")))).alias("w"))
    counts = marked.groupBy("_h", "w").count()
    per = counts.groupBy("_h").agg(F.max(F.when(F.col("w") == "", F.col("count"))).alias("n"), F.coalesce(F.max(F.when(F.col("w") != "", F.col("count"))), F.lit(0)).alias("m"))
    stock = cut(per.filter(F.col("n") >= STOCK_ROWS).filter(F.col("m") <= F.greatest(F.lit(1), F.col("n") / 2)).select("_h", F.lit(True).alias("_stock")))
    df = df.join(stock, "_h", "left")
    return df.withColumn("own_description", F.when(F.col("_stock").isNull(), F.col("own_description"))).drop("_h", "_stock")
