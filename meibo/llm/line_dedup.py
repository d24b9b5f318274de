"""Boilerplate lines of a site: lines that a large share of a host's pages repeat.

For each host, the pages that hold a line are divided by the pages of the host. Lines above the
ratio go. Lines travel as 128-bit digests, so no text is shuffled before the last join.

A null URL belongs to the host ``''``; a null or empty page has no lines. Equal rows count as
pages of their own and get equal results. A line counts once for a page however often it stands
there, and all its places go. A page keeps its lines' order. An empty table gives an empty result.

A script, style or comment that is not closed hides the rest of its page, as in a browser. A ``<`` begins a tag
only when a ``>`` comes before the next ``<``. So every character is looked at a bounded number of times,
however long and broken a page is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meibo.operators.staging import stage

MAX_RATIO = 0.3
#: A line on one page repeats nothing. With 1 here, every page that is alone on its host would lose all its lines.
MIN_PAGES = 2
#: Parts of each frequent line in the join with its pages.
SALTS = 16

HIDDEN = r"(?is)<script(?:[\s/][^<>]*)?>.*?(?:</script[^<>]*>|\z)|<style(?:[\s/][^<>]*)?>.*?(?:</style[^<>]*>|\z)|<!--.*?(?:-->|\z)"
BLOCKS = r"(?i)</?(p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|nav|header|footer|article|section|aside|main|table|tr|td|th|title|head|body|html|form|blockquote|pre|hr)([\s/][^<>]*)?>"
TAGS = r"<[^<>]*>"
#: Where lines end; the white space around a line belongs to none.
BREAKS = r"[ \t\r]*\n[ \t\r\n]*"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def text_lines(text: Column) -> Column:
    """The non-empty lines, without white space at their ends."""
    # The same as a split at BREAKS, but a long run of spaces is passed once.
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    return F.filter(lines, lambda x: x != "")


def html_text(html: Column) -> Column:
    """Visible text of a page, each block element on lines of its own."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n")
    return F.regexp_replace(F.regexp_replace(shown, BLOCKS, "\n"), TAGS, "")


def _without(lines: Column, places: Column) -> Column:
    """``lines`` without those at the given places (from 1), in time that grows with the lines."""
    kept = F.array_except(F.sequence(F.lit(1), F.size(lines)), places)
    return F.when(F.size(lines) == 0, lines).otherwise(F.transform(kept, lambda place: F.get(lines, place - 1)))


def drop_site_lines(
    pages: DataFrame,
    host: Column,
    lines: Column,
    carry: list[str],
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``page`` (a struct of the columns to carry), ``host``, ``n_lines``, ``n_dropped``, ``clean_text``.

    ``lines`` is an array of strings. The content key joins a page with its dropped places; pages
    of one host with the same lines share them.
    """
    columns = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("page")
    rows = stage(
        pages.select(columns, host.alias("host"), lines.alias("lines")).withColumn(
            "key", F.unhex(F.md5(F.concat_ws("\n", "host", "lines")))
        ),
        "page-lines",
    )
    digests = F.transform("lines", lambda x: F.unhex(F.md5(x.cast("binary"))))
    counts = (
        rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.md5(x.cast("binary"))))).alias("line"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n_pages"))
        .where(F.col("n_pages") >= min_pages)
    )
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    frequent = (
        counts.join(totals, "host")
        .where(F.col("n_pages") > max_ratio * F.col("host_pages"))
        .select("host", F.unhex("line").alias("line"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    places = (
        rows.select("host", "key", F.posexplode(digests).alias("place", "line"))
        .withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        .join(frequent, ["host", "line", "salt"], "left_semi")
        .groupBy("key")
        .agg(F.collect_set(F.col("place") + 1).alias("places"))
    )
    joined = rows.join(places, "key", "left").withColumn(
        "places", F.coalesce("places", F.array().cast("array<int>"))
    )
    return joined.select(
        "page",
        "host",
        F.size("lines").alias("n_lines"),
        F.size("places").alias("n_dropped"),
        F.array_join(_without(F.col("lines"), F.col("places")), "\n").alias("clean_text"),
    )


def drop_site_lines_of_html(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", carry: list[str] | None = None, **options
) -> DataFrame:
    """The same for raw pages; all columns but the raw page are carried, unless ``carry`` names them."""
    if carry is None:
        carry = [c for c in pages.columns if c != html_col]
    return drop_site_lines(
        pages, host_of(F.col(f"`{url_col}`")), text_lines(html_text(F.col(f"`{html_col}`"))), carry, **options
    )
