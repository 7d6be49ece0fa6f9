"""Line dedup by distinct-site spread (operator 2, native).

A line found on many sites is boilerplate (menus, notices, licence lines). Each line of a document is hashed; a row for
each line hash and site is left by a distinct aggregation, and hashes with too few such rows are ruled out by their
number of rows. For the rest, HyperLogLog sketches of sites are built per line hash and part of the sites and merged by
aggregation. Lines whose estimate is within the sketch's error of the threshold get exact distinct counts; the others
are decided by the estimate. Boilerplate lines are then removed from every document by their positions.

Only DataFrame functions run here. A common line meets partial aggregation before every shuffle but the one that joins
lines with boilerplate: both sides of that join are exchanged as they are, so adaptive execution can split it. Boilerplate
hashes are the only table written on the way. Nothing is broadcast by hint.

Defined results: lines are split at \\n and compared after trimming spaces. Lines of fewer than ``min_chars`` characters
are never boilerplate; with the default, any line that isn't blank can be. A null text stays null (0 lines); an empty text has one
empty line. A document that loses all lines keeps an empty text. A null site counts as one site of its own. Repeated rows
of a site add nothing to the spread. Rows are never dropped, and all other columns, whatever their names, are kept; the
two counts are added under the names asked for and replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrolens.llm.common import fresh, materialise

#: From so many distinct sites on, a line is boilerplate.
MIN_SITES = 8
#: Blank lines are none.
MIN_CHARS = 1
LG_K = 12
#: Five standard errors of a sketch of 2**12 registers (1.04 / sqrt(4096) each).
BAND = 5 * 1.04 / 2 ** (LG_K / 2)
#: Parts of a line's sites that are sketched separately.
PARTS = 8


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keys(docs: DataFrame, text_col: str, site_col: str, min_chars: int) -> DataFrame:
    """A row for each line that may be boilerplate: d0, d1 (the text's identity), site, at (its place in the text), line (its hash)."""
    text = F.col(f"`{text_col}`")
    exploded = docs.where(text.isNotNull()).select(
        F.xxhash64(text).alias("d0"),
        F.xxhash64(F.lit(1), text).alias("d1"),
        F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col(f"`{site_col}`")), F.lit("null"))).alias("site"),
        F.posexplode(F.transform(_lines(text), lambda x: F.when(F.length(F.trim(x)) >= min_chars, F.xxhash64(F.trim(x))))).alias("at", "line"),
    )
    return exploded.where(F.col("line").isNotNull())


def spread(keys: DataFrame, min_sites: int) -> DataFrame:
    """Hashes (line) of lines found on ``min_sites`` sites or more."""
    # A row for each line and site, whatever the number of copies; equal plans of it are exchanged once.
    sites = keys.select("line", "site").distinct()
    several = sites.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("line")
    wide = sites.join(several, "line", "left_semi")
    sketched = (
        wide.groupBy("line", F.pmod(F.col("site"), F.lit(PARTS)).alias("part"))
        .agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
        .groupBy("line")
        .agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    )
    sure = sketched.where(F.col("estimate") > min_sites * (1 + BAND)).select("line")
    near = sketched.where(F.abs(F.col("estimate") - min_sites) <= min_sites * BAND).select("line")
    exact = wide.join(near, "line", "left_semi").groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("line")
    return sure.unionByName(exact)


def dedup_lines(
    docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, n_lines_col: str = "__n_lines", n_removed_col: str = "__n_removed"
) -> DataFrame:
    """All rows and columns of docs, with the boilerplate lines taken out of the text, and two counts (long): lines, and lines removed."""
    keys = line_keys(docs, text_col, site_col, min_chars)
    boilerplate = materialise(spread(keys, min_sites), "boilerplate")
    gone = keys.select("d0", "d1", "at", "line").join(boilerplate, "line").groupBy("d0", "d1").agg(F.collect_set("at").alias("gone"))
    d0, d1, places = fresh(docs, "__d0"), fresh(docs, "__d1"), fresh(docs, "__gone")
    text, out = F.col(f"`{text_col}`"), F.col(places)
    lines = _lines(text)
    # Places that stay, in order; array_except looks them up by hash, so long texts take linear time.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out)
    cleaned = F.concat_ws("\n", F.transform(stay, lambda i: F.get(lines, i)))
    joined = docs.withColumns({d0: F.xxhash64(text), d1: F.xxhash64(F.lit(1), text)}).join(gone.toDF(d0, d1, places), [d0, d1], "left")
    counts = {n_lines_col: F.when(text.isNull(), 0).otherwise(F.size(lines)), n_removed_col: F.when(out.isNotNull(), F.size(out)).otherwise(0)}
    kept = [c for c in docs.columns if c not in counts]
    return joined.select(
        *[F.when(out.isNotNull(), cleaned).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in kept],
        *[n.cast("long").alias(c) for c, n in counts.items()],
    )
