"""Near-duplicate documents by one-permutation MinHash with optimal densification.

A document's set is its distinct shingles of ``shingle`` words. Two documents are linked if the Jaccard similarity of their
sets is at least ``percent`` / 100, which is confirmed on the full sets; a group is a connected component of links.

1. Documents with equal sets (128-bit hash) become one node, named by the smallest doc_id: copies are never paired.
2. One hash of each shingle gives all BANDS x ROWS bins (one permutation): a bin holds the smallest hash that falls
   into it. An empty bin takes the value of a full one, chosen by a hash of the bin and the attempt (optimal
   densification), so each bin agrees with a probability equal to the similarity. Nodes with an equal band
   share a bucket. At similarity 0.8 a pair shares no band with a probability of (1 - 0.8^6)^48 = 5e-7.
3. Candidates in a bucket are a star: each node is paired with the bucket's centre, its smallest node.
4. A star misses pairs of two leaves. As long as a bucket without its former centres has nodes of several components, the
   leaf with most links so far becomes its next centre, paired with the leaves of other components (``STAR_ROUNDS``).
5. What then remains is settled exactly: the nodes of such buckets are paired by a prefix filter (two sets this similar
   share one of their rarest shingles, in a common order by frequency), if of different components.

Sets and buckets are written to the shared folder, links and components are tables; nothing is collected. Every join in which
one key may hold many rows (copies of one text, a large bucket, the root of a large component, a frequent shingle) deals the
rows of such a key to several tasks, see ``spread_join``.

Defined cases: null texts and texts without words have an empty set and no links; fewer words than a shingle are one
shingle; rows that share a doc_id are one document, linked by whichever of their texts is similar; rows without a doc_id
are linked with nothing and kept; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricescope.llm.common import Scratch, hot_keys, pieces, spread_join, utf8_bytes
from pricescope.llm.segments import LOWER_CODES, find_words, hash_runs, mix, multipliers

BANDS, ROWS = 48, 6
STAR_ROUNDS = 2
#: Attempts after which an empty bin takes the next full one.
ATTEMPTS = 4096


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text, one text after another, and where each text's begin (n + 1)."""
    starts, lengths, first_word = find_words(data, offsets)
    words = hash_runs(data, starts, lengths, LOWER_CODES)
    factors = multipliers(size)
    n_words = np.diff(first_word)
    n_shingles = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    first = np.concatenate([[0], np.cumsum(n_shingles)])
    owner = np.repeat(np.arange(len(n_words)), n_shingles)
    begin = np.arange(int(first[-1])) - first[owner] + first_word[owner]
    total = np.full(len(begin), size, np.uint64)
    end = first_word[owner + 1]
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for k in range(size):
        total += np.where(begin + k < end, padded[begin + k] * factors[k], np.uint64(0))
    hashes = mix(total)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        hashes[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return hashes[fresh], kept[first]


def band_keys(hashes: np.ndarray, first: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """texts x bands: a hash of each band of the densified signature, the band's number included. Empty sets have zeros."""
    bins, n = bands * rows, len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    place = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    lead = np.ones(len(hashes), bool)
    lead[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    values, full = np.zeros((n, bins), np.uint64), np.zeros((n, bins), bool)
    values[owner[lead], place[lead]], full[owner[lead], place[lead]] = hashes[lead], True
    open_rows = np.flatnonzero(full.any(1) & ~full.all(1))
    row, column = np.nonzero(~full[open_rows])
    row = open_rows[row]
    numbers = np.arange(bins, dtype=np.uint64)
    for attempt in range(ATTEMPTS):
        if not len(row):
            break
        choice = ((mix(numbers * np.uint64(1 << 20) + np.uint64(attempt + 1)) >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        source = choice[column]
        found = full[row, source]
        values[row[found], column[found]] = values[row[found], source[found]]
        row, column = row[~found], column[~found]
    for r, c in zip(row.tolist(), column.tolist(), strict=True):
        have = np.flatnonzero(full[r])
        values[r, c] = values[r, have[np.searchsorted(have, c) % len(have)]]
    total = np.tile(np.arange(bands, dtype=np.uint64), (n, 1))
    for k, factor in enumerate(multipliers(rows)):
        total += values[:, k::rows] * factor
    keys = mix(total)
    keys[~full.any(1)] = 0
    return keys


def _in_pieces(texts: pa.Array, size: int):
    data, offsets = utf8_bytes(texts)
    for a, b in pieces(offsets):
        yield shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def profile(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n (size of the set), k1 and k2 (hash of the set), bands."""

    @F.arrow_udf("struct<n: bigint, k1: bigint, k2: bigint, bands: array<bigint>>")
    def sketch(texts: pa.Array) -> pa.Array:
        parts = []
        for hashes, first in _in_pieces(texts, shingle):
            sizes = np.diff(first)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (mix(hashes), mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))]
            k1, k2 = (s[first[1:]] - s[first[:-1]] for s in sums)
            keys = band_keys(hashes, first)
            columns = [pa.array(sizes, pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), _lists(keys.ravel(), np.arange(len(sizes) + 1) * keys.shape[1])]
            parts.append(pa.StructArray.from_arrays(columns, ["n", "k1", "k2", "bands"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))]))

    return docs.select("doc_id", sketch("text").alias("s")).select("doc_id", "s.*")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and its set, as sorted hashes."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def collect(texts: pa.Array) -> pa.Array:
        parts = [_lists(hashes, first) for hashes, first in _in_pieces(texts, shingle)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    return docs.select("doc_id", collect("text").alias("set"))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node with a link, the root being the smallest node of its connected component.

    Alternates the large-star and small-star steps until the edges stay the same; each is one join and one aggregation.
    """
    edges = scratch.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop("edges", but_last=True)
        scratch.drop("lowest", "large")
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = scratch.table(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), "lowest")
        joined = spread_join(both.where("v > u"), lowest.drop("n"), ["u"], hot_keys(lowest, ["u"], scratch), "v")
        large = scratch.table(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        lowest = scratch.table(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "lowest")
        small = spread_join(large, lowest.drop("n"), ["u"], hot_keys(lowest, ["u"], scratch), "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.table(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b"))
    sizes = sets.select("doc_id", F.size("set").alias("n"))
    pairs = scratch.table(pairs, "pairs")
    hot = hot_keys(pairs.groupBy("a").agg(F.count("*").alias("n")), ["a"], scratch)
    near = spread_join(pairs, sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a")), ["a"], hot, "b").join(sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b")), "b")
    near = near.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "n_a", "n_b")
    shared = spread_join(near, left, ["a"], hot, "b").join(right, "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("total"), F.size(F.array_intersect("set_a", "set_b")).alias("shared"))
    return shared.where(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b").distinct()


def prefix_pairs(rest: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs of ``rest`` (node, comp) of different components that share one of their rarest shingles: no similar pair is missed.

    Shingles are ordered by frequency, rarest first. With sets of n and m, a similar pair shares at least
    t / (1 + t) (n + m) of them; so the first one that it shares stands early enough in both for so many to follow. A row
    (node, shingle) with f shingles from there on has partners of at most f (1 + t) / t - n shingles. Of a pair, the smaller set (by
    node, if equal) is looked up, so of it only rows are kept whose partners may be as large as itself: in a crowd that shares a
    passage but is less similar than t, none are.
    """
    tokens = sets.join(rest, F.col("doc_id") == F.col("node")).select("node", "comp", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    known = scratch.table(tokens.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "shingles")
    # A shingle that one node alone has pairs nothing, but takes its place among the rarest.
    common = spread_join(tokens, known.withColumnRenamed("n", "df"), ["shingle"], hot_keys(known, ["shingle"], scratch), "node")
    rank = F.expr("row_number() OVER (PARTITION BY node ORDER BY df, shingle)")
    held = common.withColumn("rank", rank + F.col("n") - F.expr("count(*) OVER (PARTITION BY node)"))
    follow = F.col("n") - F.col("rank") + 1
    most = F.floor((100 + percent) * follow / percent + 1e-6) - F.col("n")
    prefix = held.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("node", "comp", "n", "shingle", most.alias("most"))
    prefix = scratch.table(prefix, "prefix")
    smaller = prefix.where("most >= n").select("shingle", F.col("node").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("n_b"), F.col("most").alias("most_b"))
    hot = hot_keys(smaller.groupBy("shingle").agg(F.count("*").alias("n")), ["shingle"], scratch)
    joined = spread_join(smaller, prefix, ["shingle"], hot, "b")
    ordered = (F.col("n_b") < F.col("n")) | ((F.col("n_b") == F.col("n")) & (F.col("b") < F.col("node")))
    fits = (F.col("n_b") <= F.col("most")) & (F.col("n") <= F.col("most_b")) & (100 * F.col("n_b") >= percent * F.col("n"))
    return joined.where(ordered & fits & (F.col("comp") != F.col("comp_b"))).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def find_groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept (the component's smallest doc_id stays)."""
    docs, scratch = docs.select("doc_id", "text"), Scratch(docs.sparkSession, "dedup")
    prof = scratch.table(profile(docs, shingle), "profile")
    usable = prof.where("n > 0 AND doc_id IS NOT NULL")
    nodes = scratch.table(usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "nodes")

    # Buckets of two nodes or more, with their centre.
    keyed = usable.join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    keyed = keyed.groupBy("doc_id", "k1", "k2").agg(F.first("bands").alias("bands"))
    buckets = keyed.select(F.explode("bands").alias("key"), F.col("doc_id").alias("node"))
    centres = buckets.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last"), F.count("*").alias("n")).where("centre < last").drop("last")
    centres = scratch.table(centres, "centres")
    hot = hot_keys(centres, ["key"], scratch)
    live = scratch.table(spread_join(buckets, centres.drop("n"), ["key"], hot, "node"), "buckets")
    wanted = live.select("node").distinct()
    sets = scratch.table(full_sets(docs.join(wanted, F.col("doc_id") == F.col("node"), "left_semi"), shingle), "sets")

    pairs = live.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = scratch.table(confirm(pairs, sets, percent, scratch).unionByName(_twins(usable, nodes, scratch)), "links")
    roots = components(links, scratch)
    live = live.where("node <> centre").drop("centre")
    for _ in range(STAR_ROUNDS - 1):
        live, split = _unsettled(live, roots, hot, scratch)
        if not split:
            break
        degree = links.select(F.col("a").alias("node")).unionAll(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
        ranked = live.join(degree, "node", "left").select("key", "node", "comp", F.coalesce("degree", F.lit(0)).alias("degree"))
        best = ranked.groupBy("key").agg(F.max(F.struct("degree", -F.col("node"), "comp")).alias("best")).selectExpr("key", "-best.col2 AS centre", "best.comp AS centre_comp")
        star = scratch.table(spread_join(live, best, ["key"], hot, "node"), "star")
        pairs = star.where("comp <> centre_comp").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        fresh = confirm(pairs, sets, percent, scratch)
        links = scratch.table(links.unionByName(fresh), "links")
        roots = components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), scratch)
        live = star.where("node <> centre").select("key", "node")
    live, split = _unsettled(live, roots, hot, scratch)
    if split:
        rest = scratch.table(live.select("node", "comp").distinct(), "rest")
        fresh = confirm(prefix_pairs(rest, sets, percent, scratch), sets, percent, scratch)
        links = scratch.table(links.unionByName(fresh), "links")
        roots = components(links, scratch)

    named = nodes.join(roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("k1", "k2", F.coalesce("root", "node").alias("root"))
    copies = hot_keys(nodes, ["k1", "k2"], scratch)
    known = spread_join(usable.select("doc_id", "n", "k1", "k2"), named, ["k1", "k2"], copies, "doc_id").select("doc_id", "n", "root")
    alone = prof.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("root"))
    out = scratch.table(known.unionByName(alone), "groups")
    scratch.keep("groups")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("root"), F.lit(True)).alias("kept"))


def _twins(usable: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between the nodes of different texts of one doc_id."""
    several = usable.groupBy("doc_id").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low <> high").select("doc_id")
    found = usable.join(several, "doc_id").join(nodes.drop("n"), ["k1", "k2"]).select("doc_id", "node").distinct()
    found = scratch.table(found, "twins")
    first = found.groupBy("doc_id").agg(F.min("node").alias("a"))
    return found.join(first, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def _unsettled(live: DataFrame, roots: DataFrame, hot: DataFrame | None, scratch: Scratch) -> tuple[DataFrame, bool]:
    """The buckets (key, node, comp) that hold several components, and whether there are any."""
    labelled = live.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    labelled = scratch.table(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    found = scratch.table(spread_join(labelled, mixed, ["key"], hot, "node", "left_semi"), "mixed")
    return found, not found.isEmpty()


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each group, that of the smallest doc_id, with the columns of ``docs``.

    Of several rows of that doc_id the one with the smallest text stays. Rows without words or without a doc_id all stay.
    """
    groups = find_groups(docs, shingle, percent)
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    again = groups.where("kept AND n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__again"))
    if again.isEmpty():
        return kept
    same = F.col("doc_id") == F.col("__again")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = kept.join(again, same, "left_semi").groupBy("doc_id").agg(F.min_by(row, F.coalesce("text", F.lit(""))).alias("__row")).select("__row.*")
    return kept.join(again, same, "left_anti").unionByName(one)
