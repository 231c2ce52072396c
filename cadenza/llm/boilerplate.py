"""Boilerplate lines by their frequency within a site.

For each host, the number of its pages that contain a line is divided by the number of its pages; lines over the ratio
are boilerplate and dropped from the host's pages. All of it is built-in SQL. Only hashes of lines are shuffled for the
counts, after a partial count in each task, so neither a hot host nor a hot line meets in one task; the lines of a host
over the ratio are fewer than its lines a page divided by the ratio, so they fit in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import merged_with, written

#: A line on more than this share of a host's pages is boilerplate ...
MAX_RATIO = 0.05
#: ... if at least so many of the host's pages have it.
MIN_PAGES = 4
#: Boilerplate lines of all hosts that are broadcast at most: 16 bytes each.
BROADCAST_LINES = 500_000


def page_lines(html: Column) -> Column:
    """The visible lines of a page: scripts, styles, comments and tags removed, block tags as line breaks, blanks trimmed."""
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")
    text = F.regexp_replace(text, r"(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|td|th|table|nav|article|section|header|footer|title|head|body|html|pre|blockquote)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    text = F.regexp_replace(text, r"[ \t\r]*\n[ \t\r]*", "\n")
    return F.trim(F.regexp_replace(text, r"\n{2,}", "\n"), F.lit(" \t\r\n"))


def host_of(url: Column) -> Column:
    """The lower-cased host of an address, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _key(line: Column) -> Column:
    """A 128-bit name of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit("line")).alias("b"))


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _line_keys() -> Column:
    return F.array_distinct(F.transform(F.filter("__lines", lambda x: x != ""), _key))


def boilerplate(pages: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    """``pages`` has columns __host and __keys (names of lines). Returns one row for each host that has boilerplate: __host, __drop (names of its lines)."""
    # The outer form, as for the other Spark adds a filter that works out all lines a second time.
    counted = pages.select("__host", F.explode_outer("__keys").alias("k")).where("k is not null").groupBy("__host", "k").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy("__host").agg(F.count("*").alias("total"))
    return counted.join(totals, "__host").where(F.col("n") > max_ratio * F.col("total")).groupBy("__host").agg(F.collect_list("k").alias("__drop"))


def drop_boilerplate(pages: DataFrame, *, host: Column, text_col: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, count_col: str | None = None, distinct_texts: bool = False, max_loss: float = 1.0) -> DataFrame:
    """``pages`` with the boilerplate lines of each host taken out of ``text_col``; ``count_col``, if given, gets the number of lines dropped.

    Lines are what stands between newlines; two are equal if all their characters are. Empty lines are never
    boilerplate. A line counts once for each page row that has it, however often; repeated rows count as pages. A ratio
    equal to the limit keeps the line. Null and empty hosts are one host; null text stays null, and counts as a page
    without lines. Texts are taken whole, however long. All other columns stay, whatever their names; one named as
    ``count_col`` is replaced.

    What copies of one page share is its text, not boilerplate. With ``distinct_texts`` equal texts of a host count as
    one page. A page that would lose more than the share ``max_loss`` of its characters, line breaks apart, stays whole:
    it is a copy, perhaps an edited one, of other pages.
    """
    text = F.col(f"`{text_col}`")
    dealt = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.coalesce(host, F.lit("")).alias("__host"), F.split(text, "\n", -1).alias("__lines"), text.alias("__text"))
    counted = dealt.select("__host", _line_keys().alias("__keys"), *([_key(F.col("__text")).alias("__text")] if distinct_texts else []))
    if distinct_texts:  # only names of lines and texts are shuffled
        counted = counted.groupBy("__host", "__text").agg(F.first("__keys").alias("__keys"))
    known = written(boilerplate(counted, max_ratio, min_pages), "boilerplate")
    # Few enough lines go to the pages; beyond that, pages go to their host's lines, and Spark splits a host of many pages.
    few = (known.agg(F.sum(F.size("__drop") + 1).alias("n")).first()["n"] or 0) <= BROADCAST_LINES
    joined = dealt.join(F.broadcast(known) if few else merged_with(known), "__host", "left")
    here = F.array_intersect(F.transform("__lines", _key), F.col("__drop"))
    left = _let(here, lambda gone: F.when(F.size(gone) > 0, F.filter("__lines", lambda x: (x == "") | ~F.array_contains(gone, _key(x)))).otherwise(F.col("__lines")))
    cut = F.when(F.col("__drop").isNull() | F.col("__lines").isNull(), F.col("__lines")).otherwise(left)
    if max_loss < 1:
        size = lambda lines: F.length(F.array_join(lines, ""))
        cut = _let(cut, lambda x: F.when(size("__lines") - size(x) > max_loss * size("__lines"), F.col("__lines")).otherwise(x))
    out = joined.withColumn("__left", cut)
    columns = [F.when(F.col("__text").isNotNull(), F.array_join("__left", "\n")).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in pages.columns if c != count_col]
    count = [F.coalesce(F.size("__lines") - F.size("__left"), F.lit(0)).cast("long").alias(count_col)] if count_col else []
    return out.select(*columns, *count)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    shown = pages.select("page_id", host_of(F.col("url")).alias("host"), page_lines(F.col("html")).alias("text"))
    return drop_boilerplate(shown, host=F.col("host"), text_col="text", count_col="n_dropped")


ORACLE = r"""
WITH a AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
 regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g'), '(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|td|th|table|nav|article|section|header|footer|title|head|body|html|pre|blockquote)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM pages),
p AS (SELECT page_id, host, trim(regexp_replace(regexp_replace(t, '[ \t\r]*\n[ \t\r]*', chr(10), 'g'), '\n{2,}', chr(10), 'g'), ' ' || chr(9) || chr(13) || chr(10)) AS text FROM a),
l AS (SELECT page_id, host, i, string_split(text, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM p)),
n AS (SELECT host, line, count(DISTINCT page_id) AS n FROM l WHERE line <> '' GROUP BY host, line),
h AS (SELECT host, count(*) AS total FROM p GROUP BY host),
b AS (SELECT host, line FROM n JOIN h USING (host) WHERE n >= 4 AND n > 0.05::DOUBLE * total),
k AS (SELECT page_id, string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE b.line IS NULL) AS text, count(b.line) AS n_dropped FROM l LEFT JOIN b ON l.host = b.host AND l.line = b.line GROUP BY page_id)
SELECT p.page_id, p.host, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n_dropped, 0) AS n_dropped FROM p LEFT JOIN k USING (page_id)
"""
