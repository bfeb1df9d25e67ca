"""Operator 10: boilerplate lines by their frequency within a site.

For each host the pages that hold a line are counted and divided by the host's pages; lines above a ratio are
boilerplate there and are dropped from its pages. Lines are counted as pairs of 64-bit hashes, once for each
page and after partial sums within a task, so a hot host or line is a sum like any other. A host has at most
(lines a page) / ratio such lines, so they are kept as one short array for each host and looked up page by
page; whether that table is broadcast is left to the planner, which knows its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomweave.runtime import write_table

RATIO, LEAST_PAGES = 0.05, 5
#: A list of up to so many lines is walked through.
SHORT = 64
WORD = r"[^\\x20\\x09-\\x0D]"


def host_of(url: str) -> Column:
    """The host part of a URL column, lower case; null if there is none."""
    found = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


def _hashes(line: str) -> str:
    return f"struct(xxhash64({line}) as a, xxhash64(1, {line}) as b)"


def _among(values: str, value: str) -> str:
    """SQL: whether ``value`` is in the sorted array ``values``; long ones are searched by halving."""
    steps = ", ".join(str(1 << k) for k in reversed(range(31)))
    reached = f"aggregate(array({steps}), 0, (at, s) -> if(s <= size({values}) and coalesce(get({values}, at + s - 1) <= v, false), at + s, at))"
    return f"get(transform(array({value}), v -> if(size({values}) <= {SHORT}, array_contains({values}, v), coalesce(get({values}, {reached} - 1) = v, false))), 0)"


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host (null: its own host), lines: hashes of the lines with a word that more than ``ratio`` of a host's rows hold, and ``least_pages`` of them at least."""
    rows = pages.select(F.col(host).cast("string").alias("host"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    total = rows.groupBy("host").agg(F.count("*").alias("pages"))
    lines = rows.select("host", F.expr(rf"inline(array_distinct(transform(filter(split(t, '\\n'), x -> x rlike '{WORD}'), x -> {_hashes('x')})))"))
    held = lines.groupBy("host", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    near = held.join(total.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    return near.where(F.col("n") > F.col("pages") * F.lit(ratio)).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("lines"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, report: bool = True) -> DataFrame:
    """All rows and columns of ``pages``, with ``text`` without boilerplate, and, with ``report``, _lines and
    _dropped (lines before, lines dropped).

    A null text stays null; blank lines are never dropped; a text can end up empty; repeated rows count as
    pages each; an empty table stays empty.
    """
    found, _ = write_table(boilerplate(pages, host, text, ratio, least_pages), "boilerplate")
    known = found.select(F.col("host").alias("_host"), F.col("lines").alias("_bad"))
    # the input's columns travel in one struct, so that no name can clash
    own = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("row"), pages[host].cast("string").alias("h"), pages[text].cast("string").alias("t"))
    split = own.join(known, own["h"].eqNullSafe(known["_host"]), "left").withColumn("all", F.expr(r"split(t, '\\n')"))
    kept = split.withColumn("kept", F.expr(f"if(_bad is null, all, filter(all, x -> not ({_among('_bad', _hashes('x'))} and x rlike '{WORD}')))"))
    columns = [F.array_join("kept", "\n").alias(c) if c == text else F.col("row")[c].alias(c) for c in pages.columns]
    counts = [F.coalesce(F.size("all"), F.lit(0)).cast("bigint").alias("_lines"), F.coalesce(F.size("all") - F.size("kept"), F.lit(0)).cast("bigint").alias("_dropped")]
    return kept.select(*columns, *(counts if report else []))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("_lines")).cast("bigint").alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(F.col("_dropped")).cast("bigint").alias("n_dropped"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP10_SQL = rf"""
with pages as (select doc_id, source as host, text, string_split(text, chr(10)) as ls from documents),
total as (select host, count(*) as pages from pages group by host),
held as (
  select host, line, count(*) as n from (select distinct doc_id, host, unnest(ls) as line from pages) where regexp_matches(line, '[^\x20\x09-\x0D]') group by host, line),
bad as (select h.host, line from held h join total t on t.host is not distinct from h.host where n >= {LEAST_PAGES} and n > pages * cast({RATIO} as double)),
lists as (select host, list(line) as bad from bad group by host),
kept as (select doc_id, text, ls, case when b.bad is null then ls else list_filter(ls, lambda x: not list_contains(b.bad, x)) end as ks from pages p left join lists b on b.host is not distinct from p.host)
select doc_id, cast(coalesce(len(ls), 0) as bigint) as n_lines, cast(coalesce(len(ls) - len(ks), 0) as bigint) as n_dropped, case when text is not null then md5(array_to_string(ks, chr(10))) end as text_md5
from kept
"""
