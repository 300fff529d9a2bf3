"""Merkle manifest of a table: a tree of SHA-256 hashes over each group's rows in order, and a tree over the groups.

Inner nodes hash up to ``fanout`` consecutive children (digests as hex text); the last run of a level may be shorter, and is hashed
as it is, without padding.

Rows are sorted by ranges into partitions, and a partition's rows of one group have consecutive indexes, known from counts by
partition. Each partition keeps a mountain range: one open run of nodes for each level. A run that fills up to a multiple
of the fanout, or to the end of its level, becomes a node of the next level (a carry). Runs that begin or end in another
partition can't be completed: their nodes are the peaks that a partition emits, at most two runs a level. Peaks are merged
level by level, as small tables. For proofs a partition builds its own runs again and gets those at its edges, a few
for each level; so no node travels to more than the partitions it belongs to, and no table of all nodes is joined.

Defined cases: rows without a group are a group, the first; rows without a key come first in theirs, equal keys go by leaf;
equal rows are leaves of their own; an empty table gives an empty result. Groups (languages, say) are a list: their
roots are numbered in one task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricescope.llm.common import Scratch

FANOUT = 8
NODE = "grp string, level int, idx bigint, width bigint, hash string"
#: Rows of a partition, about: its part of the tree and its proofs are in memory at once.
PART_ROWS = 20_000


def node(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def leaf_hash(values: list[Column]) -> Column:
    """The hash of a row's values: ``-`` for null, else the bytes of the value's text, a colon and the text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


class MountainRange:
    """The nodes over consecutive leaves of a tree with ``total`` leaves.

    ``records`` are the runs completed here, as (level, run, children); ``peaks`` the nodes whose run isn't, as (level, index,
    nodes on the level, hash). The root is a peak.
    """

    def __init__(self, total: int, fanout: int):
        self.fanout, self.widths = fanout, [total]
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] // fanout))
        self.runs: list[list[str]] = [[] for _ in self.widths]
        self.next = [0] * len(self.widths)
        self.records: list[tuple[int, int, list[str]]] = []
        self.peaks: list[tuple[int, int, int, str]] = []

    def push(self, level: int, index: int, digest: str) -> None:
        self.runs[level].append(digest)
        self.next[level] = index + 1
        if self.widths[level] > 1 and ((index + 1) % self.fanout == 0 or index + 1 == self.widths[level]):
            self.close(level)

    def close(self, level: int) -> None:
        """End the open run: carry it if it began here, else emit its nodes."""
        run, end = self.runs[level], self.next[level]
        first = end - len(run)
        self.runs[level] = []
        if first % self.fanout or self.widths[level] == 1 or (end % self.fanout and end != self.widths[level]):
            self.peaks += [(level, first + i, self.widths[level], digest) for i, digest in enumerate(run)]
        else:
            self.records.append((level, first // self.fanout, run))
            self.push(level + 1, first // self.fanout, node(run))

    def finish(self) -> None:
        """Emit the runs still open."""
        for level, run in enumerate(self.runs):
            if run:
                self.close(level)


def _climb(leaves: pa.Table, span: pa.Table, fanout: int) -> MountainRange:
    """The mountain range over a partition's leaves of one group; ``span`` has one row."""
    start, total = span["start"][0].as_py(), span["total"][0].as_py()
    mountains = MountainRange(total, fanout)
    for i, digest in enumerate(leaves.sort_by("place")["leaf"].to_pylist()):
        mountains.push(0, start + i, digest)
    mountains.finish()
    return mountains


def merge_peaks(peaks: DataFrame, levels: int, fanout: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """From (grp, level, idx, width, hash): the runs that no partition completed, (grp, level, run, children), and the roots (grp, root)."""
    runs, roots, made = [], [], None
    for level in range(levels + 1):
        here = peaks.where(F.col("level") == level).select("grp", "idx", "width", "hash")
        here = here if made is None else here.unionByName(made)
        roots.append(here.where("width = 1").select("grp", F.col("hash").alias("root")))
        children = F.transform(F.sort_array(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"]).alias("children")
        grouped = here.where("width > 1").groupBy("grp", "width", F.floor(F.col("idx") / fanout).alias("run")).agg(children)
        table = scratch.table(grouped, "runs")
        runs.append(table.select("grp", F.lit(level).alias("level"), "run", "children"))
        made = table.select("grp", F.col("run").alias("idx"), F.ceil(F.col("width") / fanout).alias("width"), F.sha2(F.array_join("children", ""), 256).alias("hash"))
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    return union(runs), union(roots)


def tree_height(n: int, fanout: int) -> int:
    height = 0
    while n > 1:
        n, height = -(-n // fanout), height + 1
    return height


@dataclass
class Manifest:
    """A tree over a table's rows: ``rows`` by partition and place, with key and leaf; ``spans`` of indexes by partition and group; the
    ``runs`` that no partition completed; and for each group its root and the way from there to the root of all (``groups``).
    """

    rows: DataFrame
    spans: DataFrame
    runs: DataFrame
    groups: DataFrame
    height: int
    fanout: int
    key: str
    extra: list[str]


def build_manifest(docs: DataFrame, group: str, key: str, fields: list[str], extra: dict[str, Column] | None = None, fanout: int = FANOUT) -> Manifest:
    """Hash the ``fields`` of all rows, and build the tree of each group in order of ``key``. ``extra`` columns come along."""
    scratch = Scratch(docs.sparkSession, "merkle")
    extra = extra or {}
    grp = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("grp")
    leaves = docs.select(grp, F.col(f"`{key}`").alias("key"), leaf_hash([F.col(f"`{c}`") for c in fields]).alias("leaf"), *[e.alias(f"extra_{n}") for n, e in extra.items()])
    leaves = scratch.table(leaves.withColumn("id", F.monotonically_increasing_id()), "leaves")

    # Ranges of rows; equal rows go by the place where they were read, so that they don't meet in one partition.
    order = ["grp", "key", "leaf", "id"]
    n_parts = max(1, -(-leaves.count() // PART_ROWS))
    placed = leaves.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).drop("id")
    placed = scratch.table(placed.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "placed")
    scratch.drop("leaves")
    counted = placed.groupBy("part", "grp").agg(F.count("*").alias("n"))
    spans = scratch.table(counted.selectExpr("part", "grp", "n", "sum(n) OVER (PARTITION BY grp ORDER BY part) - n AS start", "sum(n) OVER (PARTITION BY grp) AS total"), "spans")

    def peaks(rows: pa.Table, span: pa.Table) -> pa.Table:
        return _node_table(span, _climb(rows, span, fanout).peaks, NODE)

    found = _by_part(rows_of(placed), spans).applyInArrow(peaks, NODE)
    found = scratch.table(found, "peaks")
    height = tree_height(spans.agg(F.coalesce(F.max("total"), F.lit(0))).head()[0], fanout)
    runs, subroots = merge_peaks(found, height, fanout, scratch)
    subroots = scratch.table(subroots, "subroots")

    # The tree over the groups: their roots are its leaves. ``above`` has each group's runs up to the root.
    numbered = subroots.selectExpr("grp AS name", "root AS hash", "row_number() OVER (ORDER BY grp) - 1 AS idx", "count(*) OVER () AS width", "'' AS grp", "0 AS level")
    numbered = scratch.table(numbered, "groups")
    top_height = tree_height(numbered.count(), fanout)
    top_runs, roots = merge_peaks(numbered.drop("name"), top_height, fanout, scratch)
    climbed = numbered.select("name", "idx", F.explode(F.sequence(F.lit(0), F.lit(top_height))).alias("l")).where(F.col("l") < top_height)
    on_way = climbed.select("name", F.col("l").alias("level"), _at("l", fanout).alias("node"), F.floor(_at("l", fanout) / fanout).alias("run")).join(top_runs.select("level", "run", "children"), ["level", "run"])
    ways = on_way.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("level", "node", "children"))).alias("above"))
    tops = numbered.select("grp", "name", F.col("hash").alias("subroot")).join(ways, "name", "left").join(roots, "grp")
    tops = scratch.table(tops.drop("grp").withColumnRenamed("name", "grp"), "tops")
    scratch.drop("peaks", "subroots", "groups")
    return Manifest(placed, spans, runs, tops, height, fanout, key, list(extra))


def rows_of(placed: DataFrame) -> DataFrame:
    return placed.select("part", "grp", "place", "leaf")


def _by_part(rows: DataFrame, others: DataFrame):
    return rows.groupBy("part", "grp").cogroup(others.groupBy("part", "grp"))


def _at(level: str, fanout: int) -> Column:
    """The index of a leaf's node on a level."""
    return F.floor(F.col("idx") / F.pow(F.lit(fanout), F.col(level))).cast("bigint")


def _node_table(span: pa.Table, found: list[tuple[int, int, int, str]], schema: str) -> pa.Table:
    columns = list(zip(*found, strict=True)) or [()] * 4
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return pa.table([pa.array([span["grp"][0].as_py()] * len(found), pa.string()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)


def inner_nodes(manifest: Manifest) -> DataFrame:
    """(grp, level, idx, hash) of all inner nodes of the groups' trees: those that partitions completed, and those over their edges.

    A group's name follows an equals sign; the group of rows without one has none.
    """
    fanout = manifest.fanout

    def records(rows: pa.Table, span: pa.Table) -> pa.Table:
        return _node_table(span, [(level + 1, run, len(children), node(children)) for level, run, children in _climb(rows, span, fanout).records], NODE)

    own = _by_part(rows_of(manifest.rows), manifest.spans).applyInArrow(records, NODE).drop("width")
    merged = manifest.runs.select("grp", (F.col("level") + 1).alias("level"), F.col("run").alias("idx"), F.sha2(F.array_join("children", ""), 256).alias("hash"))
    return own.unionByName(merged)


def prove(manifest: Manifest) -> DataFrame:
    """A row for each row of the table: key, ``extra`` columns, leaf, subroot (of the group), root, and proof.

    A proof is an array of (before, after) from the leaf's level up to the root: the hex digests of the siblings on both sides,
    one after another.
    """
    placed, spans, fanout = manifest.rows, manifest.spans, manifest.fanout
    # The runs that lie across a partition's edges: on each level those of its first and of its last row.
    ends = spans.select("part", "grp", F.explode(F.array("start", F.col("start") + F.col("n") - 1)).alias("idx"))
    ends = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(manifest.height))).alias("level"))
    ends = ends.select("part", "grp", "level", F.floor(_at("level", fanout) / fanout).alias("run")).distinct()
    edges = ends.join(manifest.runs, ["grp", "level", "run"]).groupBy("part", "grp").agg(F.collect_list(F.struct("level", "run", "children")).alias("edges"))
    frames = spans.join(edges, ["part", "grp"], "left").join(manifest.groups, "grp")

    fields_out = [f for f in placed.schema if f.name in ("key", "leaf") or f.name.startswith("extra_")]
    step = T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])
    schema = T.StructType([*fields_out, T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType()), T.StructField("proof", T.ArrayType(step))])
    carried = [f.name for f in fields_out]

    def climb(rows: pa.Table, frame: pa.Table) -> pa.Table:
        span = frame.to_pylist()[0]
        rows = rows.sort_by("place")
        mountains = _climb(rows, frame, fanout)
        known = {(level, run): children for level, run, children in mountains.records}
        known |= {(e["level"], e["run"]): e["children"] for e in span["edges"] or []}
        highest = len(mountains.widths) - 1
        split = lambda children, i: ("".join(children[: i % fanout]), "".join(children[i % fanout + 1 :]))
        above = [split(a["children"], a["node"]) for a in span["above"] or []]
        ways: dict[tuple[int, int], list[tuple[str, str]]] = {}

        def way(level: int, index: int) -> list[tuple[str, str]]:
            if level == highest:
                return above
            if (level, index) not in ways:
                ways[level, index] = [split(known[level, index // fanout], index), *way(level + 1, index // fanout)]
            return ways[level, index]

        before, after, ends = [], [], [0]
        for i in range(span["start"], span["start"] + span["n"]):
            for b, a in way(0, i):
                before.append(b)
                after.append(a)
            ends.append(len(before))
        steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
        n = rows.num_rows
        columns = [*[rows[c].combine_chunks() for c in carried], pa.array([span["subroot"]] * n, pa.string()), pa.array([span["root"]] * n, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)]
        return pa.table(columns, [f.name for f in schema])

    proven = _by_part(placed, frames).applyInArrow(climb, schema)
    return proven.select(F.col("key").alias(manifest.key), *[F.col(f"extra_{n}").alias(n) for n in manifest.extra], "leaf", "subroot", "root", "proof")


def proof_text(proof: Column) -> Column:
    """All siblings' digests of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def folded_root(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))
