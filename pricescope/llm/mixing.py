"""Mixing sources to target weights by Pareto order sampling. DataFrame operations only.

Each source's target is a number of words. A document's expected number of copies is proportional to its weight (equal
weights unless given), at most ``max_copies``, and such that the source's expected words are its target. The whole part is
allocated for certain; the rest is the document's inclusion probability p. Documents are ranked by ``odds(u) / odds(p)``, u being
an even hash of the row, and the first in this order are taken: a sample of fixed size with unequal probabilities.

A target is in words and documents differ in size, so each source is sampled in classes of size (words between two powers of
two), the largest first. A class has the words that its documents are expected to give, and what the classes before it gave too few or
too many. Its documents are taken in order of rank while their words fit; the group of ranks at which they run out is taken with the
probability that its words are still missing, decided once for the class, and the difference goes to the next class. Inside a class no
document is taken before one of a lower rank; what is left open in the end is about the size of the smallest documents.

A source is never sorted: words are summed by class and range of rank (``RANK_RANGES`` of them), and a class ends between two
ranges. Ranks use MD5, so that other engines can repeat them.

Defined cases: null texts have no words; a null source is a source, the last in order; equal rows have one rank and are taken
together; sources without words have target 0; weights are rounded to eighths and lie between 1/8 and 8, null is 1; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricescope.llm.common import WORD, Scratch

#: Ranges of rank in which the words of a source's class of size are summed.
RANK_RANGES = 1 << 14
#: The table of sources is broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_SOURCES = 50_000


def targets(sizes: DataFrame, max_copies: int = 3) -> DataFrame:
    """Add weight and target to (source, source_size).

    Sources by code point weigh 1, 2, 3, 1, ... and share the sum of all sizes. A source's target stops at
    ``max_copies`` times its size; what is above is shared again by weight. In the end the sources below their cap
    have target = weight * level. Sources are capped in order of cap / weight as long as the level, had they not been
    capped, would put them above it.

    The windows order the table of sources, one row each, in one task: sources are collections of documents, thousands at
    most. Where they are many (web hosts, say), mix groups of them.
    """
    ranked = sizes.selectExpr("source", "source_size", "1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight", f"{max_copies} * source_size AS cap")
    ordered = ranked.selectExpr(
        "*",
        "sum(source_size) OVER () AS total",
        "row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place",
        "coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_before",
        "sum(weight) OVER (ORDER BY cap / weight DESC, source DESC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS weight_from_here",
    )
    judged = ordered.selectExpr("*", "(total - capped_before) * weight >= cap * weight_from_here AS is_capped")
    first_open = "min(CASE WHEN NOT is_capped THEN struct(place, (total - capped_before) / weight_from_here AS level) END) OVER ()"
    return judged.selectExpr("*", f"{first_open} AS open").selectExpr("source", "source_size", "weight", "CASE WHEN is_capped THEN cast(cap AS double) ELSE weight * open.level END AS target")


def expected_copies(classes: DataFrame, sources: DataFrame, max_copies: int) -> DataFrame:
    """(source, weight_class, whole, p, odds): copies for certain, and the probability and odds of one more, for each source and weight.

    With w the weight, a document is expected min(max_copies, w * level) times; the level makes the expected words of the source its
    target. The largest weights are capped as long as the level, had they not been, would put them above the cap.
    """
    joined = classes.join(sources.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    summed = joined.selectExpr(
        "*",
        f"target - coalesce(sum({max_copies} * words) OVER (PARTITION BY source ORDER BY weight_class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_words",
        "sum(words * weight_class) OVER (PARTITION BY source ORDER BY weight_class ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS weighed",
    )
    judged = summed.selectExpr("*", f"open_words * weight_class >= {max_copies} * weighed AS is_capped")
    level = judged.selectExpr("*", "max(CASE WHEN NOT is_capped THEN struct(weight_class, open_words / weighed AS level) END) OVER (PARTITION BY source) AS open")
    expected = level.selectExpr("source", "weight_class", "words", f"CASE WHEN weighed = 0 THEN 0D WHEN is_capped THEN {max_copies}D ELSE weight_class * open.level END AS expected")
    return expected.selectExpr("source", "weight_class", "floor(expected) AS whole", "expected - floor(expected) AS p").selectExpr("*", "p / (1 - p) AS odds")


def slim_columns(weight: Column | None, seed: int) -> list[Column]:
    """doc_id, source, size, weight_class, size_class (binary digits of the size), and u, an even number in (0, 1) that is the same in every run."""
    eighths = F.lit(8) if weight is None else F.coalesce(F.greatest(F.lit(1), F.least(F.lit(64), F.round(weight * 8))), F.lit(8))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    hashed = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text)).cast("binary"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return [F.col("doc_id"), F.col("source"), size.alias("size"), eighths.cast("int").alias("weight_class"), F.length(F.bin(size)).alias("size_class"), even(hashed).alias("u")]


def even(digest: Column) -> Column:
    """An even number in (0, 1) from a digest in hex."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def ranked_rows(slim: DataFrame, copies: DataFrame) -> DataFrame:
    """The slim rows with their class's copies and odds, their rank, and its range. Without odds a row isn't ranked.

    A class ends near rank 1, where u is p: ranges are the narrower, the nearer to it.
    """
    joined = slim.join(broadcast_small(copies.selectExpr("source AS s", "weight_class AS w", "whole", "odds")), slim["source"].eqNullSafe(F.col("s")) & (F.col("weight_class") == F.col("w")))
    rank = F.try_divide(F.col("u") / (1 - F.col("u")), F.col("odds"))
    beyond = F.col("rank") / (1 + F.col("rank")) * 2 - 1
    return joined.drop("s", "w").withColumn("rank", rank).withColumn("rank_range", F.floor((F.cbrt(beyond) + 1) * (RANK_RANGES // 2)))


def fill(missing: Column, classes: Column) -> Column:
    """(left, cuts) after all classes of a source: the words left open, and by class the number of its ranges of rank that are taken.

    ``classes`` has (size_class, expected, v, words of its ranges in order, their sums up to each), the largest class first. v is even in (0, 1).
    """

    def take(acc: Column, c: Column) -> Column:
        open_words = acc["left"] + c["expected"]
        fits = F.size(F.filter(c["upto"], lambda x: x <= open_words))
        given = F.coalesce(F.get(c["upto"], fits - 1), F.lit(0)).cast("double")
        following = F.coalesce(F.get(c["words"], fits), F.lit(0)).cast("double")
        more = (following > 0) & (open_words - given > c["v"] * following)
        left = open_words - given - F.when(more, following).otherwise(0.0)
        return F.struct(left.alias("left"), F.concat(acc["cuts"], F.array(F.struct(c["size_class"].alias("size_class"), (fits + more.cast("int")).alias("taken")))).alias("cuts"))

    start = F.struct(missing.cast("double").alias("left"), F.array().cast("array<struct<size_class: int, taken: int>>").alias("cuts"))
    return F.aggregate(classes, start, take)


def plan_mix(docs: DataFrame, max_copies: int = 3, seed: int = 20, weight: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The slim table of documents (written to the shared folder), that of copies by weight, and that of sources with the last range of rank taken of each class."""
    scratch = Scratch(docs.sparkSession, "mix")
    slim = scratch.table(docs.select(*slim_columns(weight, seed)), "sizes")
    classes = scratch.table(slim.groupBy("source", "weight_class", "size_class").agg(F.sum("size").alias("words")), "classes")
    sources = scratch.table(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), max_copies), "sources")
    copies = scratch.table(expected_copies(classes.groupBy("source", "weight_class").agg(F.sum("words").alias("words")), sources, max_copies), "copies")

    # By class of size: the words expected beyond whole copies, and those of each range of rank.
    chances = classes.join(copies.selectExpr("source AS s", "weight_class AS w", "p"), F.col("source").eqNullSafe(F.col("s")) & (F.col("weight_class") == F.col("w")))
    expected = chances.groupBy("source", "size_class").agg(F.sum(F.col("words") * F.col("p")).alias("expected"))
    ranked = ranked_rows(slim, copies).where("rank IS NOT NULL AND size > 0")
    by_range = ranked.groupBy("source", "size_class", "rank_range").agg(F.sum("size").alias("words"))
    by_range = scratch.table(by_range.selectExpr("*", "sum(words) OVER (PARTITION BY source, size_class ORDER BY rank_range) AS upto"), "ranges")
    place = F.struct("rank_range", "words", "upto")
    ranges = by_range.groupBy(F.col("source").alias("s"), F.col("size_class").alias("c")).agg(F.sort_array(F.collect_list(place)).alias("ranges"))
    joined = expected.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("size_class") == F.col("c")))
    v = even(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("source", F.lit("")), "size_class").cast("binary")))
    described = F.struct("size_class", "expected", v.alias("v"), F.col("ranges.words").alias("words"), F.col("ranges.upto").alias("upto"), F.col("ranges.rank_range").alias("ranges"))
    by_source = joined.groupBy("source").agg(F.sort_array(F.collect_list(described), asc=False).alias("classes"))
    filled = by_source.select("source", fill(F.lit(0.0), F.col("classes"))["cuts"].alias("cuts"), "classes")
    last = F.zip_with("classes", "cuts", lambda c, cut: F.struct(c["size_class"].alias("size_class"), F.coalesce(F.get(c["ranges"], cut["taken"] - 1), F.lit(-1)).alias("last")))
    cuts = filled.select(F.col("source").alias("s"), F.map_from_entries(last).alias("last"))
    plan = sources.select(F.col("source").alias("plan_source"), "source_size", "target").join(cuts, F.col("plan_source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = scratch.table(plan, "plan")
    scratch.keep("sizes", "copies", "plan")
    return slim, copies, plan


def broadcast_small(table: DataFrame) -> DataFrame:
    """Broadcast a table with one row for each source or class if it has few rows, counted first; else leave the join to shuffle."""
    return F.broadcast(table) if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else table


def _with_copies(slim: DataFrame, copies: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of ``slim``, their source's plan, and how often each is taken."""
    ranked = ranked_rows(slim, copies)
    joined = ranked.join(broadcast_small(plan), ranked["source"].eqNullSafe(F.col("plan_source")))
    taken = F.col("rank").isNotNull() & (F.col("size") > 0) & F.coalesce(F.col("rank_range") <= F.try_element_at("last", F.col("size_class")), F.lit(False))
    return joined.withColumn("copies", (F.col("whole") + taken.cast("long")).cast("long"))


def mix(docs: DataFrame, max_copies: int = 3, seed: int = 20, weight: Column | None = None) -> DataFrame:
    """One slim row for each row of ``docs``: its words, its source's size and target, and the copies that the mix takes."""
    slim, copies, plan = plan_mix(docs, max_copies, seed, weight)
    return _with_copies(slim, copies, plan).select("doc_id", "source", "size", "source_size", "target", "copies")


def mix_documents(docs: DataFrame, max_copies: int = 3, seed: int = 20, weight: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it, with the columns of ``docs``.

    Ranks are recomputed beside the text, and compared with the sources' thresholds: the texts aren't shuffled while
    the table of sources is small.
    """
    _, copies, plan = plan_mix(docs, max_copies, seed, weight)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    measured = docs.select(row.alias("__row"), *slim_columns(weight, seed))
    joined = _with_copies(measured, copies, plan)
    repeated = joined.select("__row", F.explode(F.sequence(F.lit(1), F.lit(max_copies))).alias("copy"), "copies")
    return repeated.where("copy <= copies").select("__row.*")
