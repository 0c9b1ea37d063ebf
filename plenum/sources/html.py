"""Order papers from web pages: links and dates out of table rows, without leaving the JVM.

Defined results: pages without a ``table-hover`` table, header rows, rows with fewer than two cells or without a link give
nothing; an empty title is numbered; an unreadable date is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.text import absolute_url, parse_date


def _plain(html: Column) -> Column:
    text = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for mark, sign in (("&amp;", "&"), ("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(mark), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def paper_links(pages: DataFrame, page: str, html: str, base_url: str, keep: list[str] | None = None) -> DataFrame:
    """(page, row, title, pdf_url, session_date) of every row of the page's table, plus the columns in ``keep``."""
    keep = keep or []
    table = F.regexp_extract(html, r'(?is)<table[^>]*class="[^"]*\btable-hover\b[^"]*"[^>]*>(.*?)</table>', 1)
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    df = pages.select(page, *keep, F.posexplode(rows).alias("row", "tr")).filter("row > 0")
    df = df.withColumn("cells", F.regexp_extract_all("tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1)).filter("size(cells) >= 2")
    first = F.get("cells", F.lit(0))
    df = df.withColumn("href", F.regexp_extract(first, r'(?is)<a\s[^>]*href\s*=\s*"([^"]*)"', 1)).withColumn("a", F.regexp_extract(first, r"(?is)<a\s[^>]*href[^>]*>(.*?)</a>", 1))
    df = df.filter(first.rlike(r"(?is)<a\s[^>]*href"))
    title = F.coalesce(F.nullif(_plain(F.col("a")), F.lit("")), F.concat(F.lit("Session Paper "), F.col("row").cast("string")))
    return df.select(page, *keep, "row", title.alias("title"), absolute_url(base_url, F.replace("href", F.lit("&amp;"), F.lit("&"))).alias("pdf_url"), parse_date(_plain(F.get("cells", F.lit(1)))).alias("session_date"))

