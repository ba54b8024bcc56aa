"""Line dedup by site-relative frequency (DataFrame functions only).

A line is boilerplate on a host if it stands in more than ``ratio`` of the host's pages and in at least
``least_pages`` of them.  Only (host, line hash) pairs are shuffled to count; the text is not.  The sum of a page's
distinct lines bounds the boilerplate: a host with L distinct lines a page on average has fewer than L / ratio such
lines, so they fit in one sorted array a host.

Those arrays are written and their size is summed up.  Up to SENT_BYTES, the usual case, they go to every task and no text is shuffled; beyond, rows
meet them in a join on (host, part), where a host has parts in proportion to its pages if it is one of the few hot ones.

A page's lines are held against the array by a hash intersection first; only pages with a hit look up each line, by binary
search, so time is linear in the text, however many lines a page or a host has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm._graph import shared

#: Share of a host's pages above which a line is boilerplate.
RATIO = 0.1
#: Pages of a host that must have the line; small hosts have no boilerplate below it.
LEAST_PAGES = 3
#: Boilerplate of all hosts together that is sent to every task.
SENT_BYTES = 8 << 20
#: Parts of all hot hosts together; a hot host has at least 1 / HOT of all pages.
PARTS, HOT = 4096, 1024


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """128 bits of the trimmed line as a string, which arrays compare by hashing; empty lines have none."""
    line = F.trim(line)
    return F.when(line != "", F.concat(F.hex(F.xxhash64(line)), F.lit("."), F.hex(F.xxhash64(F.lit(7), line))))


def boilerplate(docs: DataFrame, *, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, pages, keys): the sorted keys of each host's boilerplate lines.  docs: host, text.

    Null hosts are one host.  A page counts once for a line that it repeats; pages that repeat count each.  Null texts are pages without
    lines.  Hosts without boilerplate have no row, an empty table gives an empty one.
    """
    pages = docs.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    keys = F.array_distinct(F.array_compact(F.transform(lines_of(F.col("text")), line_key)))
    counts = docs.select("host", F.explode(keys).alias("k")).groupBy("host", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    found = counts.join(pages.withColumnRenamed("host", "host_"), F.col("host").eqNullSafe(F.col("host_")))
    found = found.where(F.col("n") > ratio * F.col("pages"))
    return found.groupBy("host").agg(F.first("pages").alias("pages"), F.sort_array(F.collect_list("k")).alias("keys"))


def _within(sorted_keys: Column, key: Column) -> Column:
    """Whether a sorted array has the key, by binary search: from the greatest power of two down, as far as the key isn't passed."""
    powers = F.filter(F.array(*[F.lit(1 << i) for i in reversed(range(31))]), lambda p: p <= F.size(sorted_keys))
    step = lambda at, p: F.when((at + p <= F.size(sorted_keys)) & (F.try_element_at(sorted_keys, at + p) <= key), at + p).otherwise(at)
    return F.aggregate(powers, F.lit(0), step, lambda at: (at > 0) & (F.try_element_at(sorted_keys, at) == key))


def dedup_lines(docs: DataFrame, *, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, sent_bytes: int = SENT_BYTES, hot: int = HOT) -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, its text without its host's boilerplate lines, and counts.

    docs needs doc_id and text and the column named by ``host``.  Added: kept_text, n_lines, n_dropped.
    Lines are split at newlines and compared without outer spaces; empty lines are never dropped.

    A null text stays null with 0 lines; an empty text is one empty line.  Rows with a null host form one host.
    Repeated rows count as pages of their own.  An empty table gives an empty table.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(host).cast("string").alias("host"))
    found = shared(boilerplate(rows.select("host", F.col("row.text").alias("text")), ratio=ratio, least_pages=least_pages))
    size = found.agg(F.sum(40 * F.size("keys") + 40)).first()[0] or 0
    small = found.select(F.col("host").alias("host_"), "keys")
    if size <= sent_bytes:
        both = rows.join(F.broadcast(small), F.col("host").eqNullSafe(F.col("host_")), "left")
    else:
        total = docs.count()
        # hot hosts: ``hot`` at most, with their parts
        parts = {r["host"]: max(1, round(r["pages"] / total * PARTS)) for r in found.where(F.col("pages") * hot >= total).select("host", "pages").collect()}
        n_parts = F.lit(1)
        for name, n in parts.items():
            n_parts = F.when(F.col("host").eqNullSafe(F.lit(name)), n).otherwise(n_parts)
        spread = found.select(F.col("host").alias("host_"), "keys", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part_"))
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("row.doc_id", F.length("row.text")), n_parts).cast("int"))
        both = dealt.join(spread, F.col("host").eqNullSafe(F.col("host_")) & (F.col("part") == F.col("part_")), "left")
    lines = lines_of(F.col("row.text"))
    hit = F.arrays_overlap(F.array_compact(F.transform(lines, line_key)), "keys")
    kept = F.when(F.coalesce(hit, F.lit(False)), F.filter(lines, lambda x: ~F.coalesce(_within(F.col("keys"), line_key(x)), F.lit(False)))).otherwise(lines)
    return both.withColumn("kept", kept).select(
        "row",
        F.array_join("kept", "\n").alias("kept_text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(lines) - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )
