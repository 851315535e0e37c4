"""Site-relative line frequency: boilerplate lines of a host, found and dropped.

A line's ratio is the pages of its host that contain it over all pages of that
host.  Lines above `max_ratio`, on `min_pages` pages at least, are boilerplate.
DataFrame functions only: lines are counted with map-side combine on
(host, fingerprint: 64 bits of a quick hash, for looking up, and 128 of SHA-256), and the set to drop per host is an array whose length
is at most the mean number of distinct lines a page over max_ratio, whatever the size
of the host.  That table joins the pages on host: broadcast when its measured size is
small, else as a shuffle join whose hot hosts are split by salting (each host's array
is copied to every salt), so no host meets in one task.

Edge cases: a null text stays null and counts as a page without lines; blank lines
are never dropped; pages with a null host form one host; repeated rows count once
each; other columns are kept, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import free_name, stored


@dataclass(frozen=True)
class LineRules:
    """max_ratio: share of a host's pages beyond which a line is boilerplate; min_pages:
    pages it must be on; max_broadcast_lines: size up to which the set is broadcast;
    salts: parts of a host in the join beyond that."""

    max_ratio: float = 0.1
    min_pages: int = 5
    max_broadcast_lines: int = 200_000
    salts: int = 32


def _second(line: Column) -> Column:
    """128 bits of SHA-256: no two lines that anyone can find share them."""
    return F.substring(F.unhex(F.sha2(line, 256)), 1, 16)


def _print(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), _second(line).alias("b"))


def url_host(url: Column) -> Column:
    """The lower-case host of a URL; null where there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _blank(line: Column) -> Column:
    return F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) == 0


def boilerplate_lines(pages: DataFrame, host: Column, text: Column, rules: LineRules = LineRules()) -> DataFrame:
    """(host, a, b): fingerprints of each host's boilerplate lines."""
    flat = pages.select(F.coalesce(host.cast("string"), F.lit("\0none")).alias("host"), text.alias("text"))
    totals = flat.groupBy("host").agg(F.count("*").alias("pages"))
    line = (
        flat.select("host", F.explode(F.array_distinct(_lines(F.col("text")))).alias("line"))
        .filter(~_blank(F.col("line")))
        .select("host", F.xxhash64("line").alias("a"), _second(F.col("line")).alias("b"))
    )
    # the least count that any host could need keeps single lines out of the join below
    counts = line.groupBy("host", "a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= rules.min_pages)
    return (
        counts.join(totals, "host")
        .filter(F.col("n") > F.lit(rules.max_ratio) * F.col("pages"))
        .select("host", "a", "b")
    )


def drop_boilerplate(pages: DataFrame, host: Column, text: str = "text", rules: LineRules = LineRules(), dropped: str | None = None) -> DataFrame:
    """pages with boilerplate lines taken out of `text`; other columns and all rows stay.
    dropped: name of a column to add (in place of one so named) with the number of lines taken out."""
    found = stored(boilerplate_lines(pages, host, F.col(text), rules), "boilerplate")
    sets = found.groupBy("host").agg(F.collect_set(F.struct("a", "b")).alias("set"))
    key, salt, held, seen = (free_name(pages, f"line_{x}") for x in ("host", "salt", "set", "seen"))
    sets = sets.select(F.col("host").alias(key), F.col("set").alias(held))
    left = pages.withColumn(key, F.coalesce(host.cast("string"), F.lit("\0none")))
    if found.count() <= rules.max_broadcast_lines:
        joined = left.join(F.broadcast(sets), key, "left")
    else:
        left = left.withColumn(salt, F.pmod(F.xxhash64(text), F.lit(rules.salts)).cast("int"))
        sets = sets.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(rules.salts - 1))))
        joined = left.join(sets, [key, salt], "left").drop(salt)
    lines = _lines(F.col(text))
    # which of the page's lines share half a fingerprint with the set: by hashing, once a page
    suspects = F.array_intersect(F.transform(lines, lambda x: F.xxhash64(x)), F.transform(F.col(held), lambda x: x["a"]))
    joined = joined.withColumn(seen, suspects)
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(seen), F.xxhash64(x)) | _blank(x) | ~F.array_contains(F.col(held), _print(x)))
    cleaned = F.when(F.col(held).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    named = {text: cleaned}
    out = joined
    if dropped:
        out = out.withColumn(dropped, F.coalesce(F.size(lines) - F.when(F.col(held).isNull(), F.size(lines)).otherwise(F.size(kept)), F.lit(0)).cast("long"))
    out = out.withColumns(named)
    own = [c for c in pages.columns if not dropped or c.lower() != dropped.lower()]
    return out.select(*[F.col(f"`{c}`") for c in own], *([dropped] if dropped else []))
