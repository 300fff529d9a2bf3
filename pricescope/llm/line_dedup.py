"""Line deduplication across documents: two Bloom filters find the lines that may repeat, and only these are shuffled.

A line's key is the line without white space at its ends and with A to Z lower-cased. Keys of at least ``min_chars`` code points
that several documents hold are kept in the smallest doc_id only; there all their lines stay.

1. Each task sets two bits for every key in the filter of keys seen once, and in the filter of keys seen twice for those that
   it meets in a second document. It sends the bits that it set, cut into segments of ``SEGMENT_BITS``; a segment's parts meet in
   one task, and what is once in two parts is twice. The filters have ``BITS`` bits a line of the input, so a segment takes
   the same memory at every size, and the filter of keys seen once never exists as a whole.
2. Only the filter of keys seen twice is broadcast, folded to at most ``FILTER_BYTES``. Beyond (about 10^8 lines) folding lets
   more lines pass as suspects; it can't lose a repeat.
3. Suspects alone are shuffled, as SHA-256 digests of their keys, first summed inside each task: a digest's smallest and largest
   doc_id confirm the repeat and choose the document that keeps it. Digests of many documents are dealt to several tasks.
4. Documents get the digests that they lose by a join on doc_id. Only texts that may lose a line are shuffled for it: a bitmap of
   hashed doc_ids, of at most ``FILTER_BYTES``, tells the others, which are passed on as they are read.

Defined cases: a null or empty text has one empty line; equal rows, and rows with one doc_id, are one document; a row without
doc_id can't be ordered, so it loses no line and repeats none; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricescope.llm.common import Scratch, hot_keys, pieces, spread_join, utf8_bytes
from pricescope.llm.segments import IS_SPACE, LOWER_CODES, find_lines, hash_runs, mix

#: Bits for each line of the input, hash functions, and bits of one segment of the filters.
BITS, HASHES, SEGMENT_BITS = 16, 2, 1 << 22
#: Bits in one row of the folded filter; ``bitmap_or_agg`` works on bitmaps of this size.
ROW_BITS = 1 << 15
#: Bound of what is broadcast: the filter of keys seen twice, and the bitmap of documents that lose lines.
FILTER_BYTES = 32 << 20
#: Keys that a task gathers before it sends their bits.
FLUSH = 1 << 21
SPACE = " \t\n\v\f\r"


def line_keys(data: np.ndarray, offsets: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and 64-bit hash of each key of at least ``min_chars`` code points; a text's equal keys count once."""
    starts, lengths, first = find_lines(data, offsets)
    solid = np.flatnonzero(~IS_SPACE[data])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, starts + lengths)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    full = np.flatnonzero(high > low)
    begin, end = solid[low[full]], solid[high[full] - 1] + 1
    wanted = chars[end] - chars[begin] >= min_chars
    full, begin, end = full[wanted], begin[wanted], end[wanted]
    owner = np.searchsorted(first, full, "right") - 1
    hashes = hash_runs(data, begin, end - begin, LOWER_CODES)
    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(owner[order]) != 0) | (np.diff(hashes[order]) != 0)
    keep = order[fresh]
    return owner[keep], begin[keep], (end - begin)[keep], hashes[keep]


def positions(hashes: np.ndarray, n_bits: int) -> list[np.ndarray]:
    """The bits of each hash in a filter of ``n_bits``, a power of two: one array for each hash function."""
    return [mix(hashes + np.uint64(0xD1B54A32D192ED03 * (j + 1) & (1 << 64) - 1)) & np.uint64(n_bits - 1) for j in range(HASHES)]


def count_lines(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def filter_size(n_lines: int) -> int:
    """Bits of the filters for so many lines: a power of two."""
    return max(SEGMENT_BITS, 1 << (max(1, n_lines * BITS) - 1).bit_length())


def partial_filters(texts: DataFrame, n_bits: int, min_chars: int) -> DataFrame:
    """(segment, once, twice): the bits that each task sets, as 32-bit places inside the segment."""

    def cut(bits: np.ndarray) -> dict[int, bytes]:
        bits = np.unique(bits)
        owner = (bits // np.uint64(SEGMENT_BITS)).astype(np.int64)
        segments, begin = np.unique(owner, return_index=True)
        places = (bits % np.uint64(SEGMENT_BITS)).astype("<u4")
        return {int(s): places[b:e].tobytes() for s, b, e in zip(segments, begin, np.append(begin, len(bits))[1:], strict=True)}

    def send(gathered: list[np.ndarray]) -> pa.RecordBatch:
        hashes, times = np.unique(np.concatenate(gathered), return_counts=True)
        once, twice = (cut(np.concatenate(positions(h, n_bits))) for h in (hashes, hashes[times > 1]))
        return pa.record_batch([pa.array(list(once), pa.int64()), pa.array(list(once.values()), pa.binary()), pa.array([twice.get(s, b"") for s in once], pa.binary())], ["segment", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, n = [], 0
        for batch in batches:
            data, offsets = utf8_bytes(batch.column(0))
            for low, high in pieces(offsets):
                inner = offsets[low : high + 1]
                hashes = line_keys(data[inner[0] : inner[-1]], inner - inner[0], min_chars)[3]
                gathered.append(hashes)
                n += len(hashes)
                if n >= FLUSH:
                    yield send(gathered)
                    gathered, n = [], 0
        if n:
            yield send(gathered)

    return texts.mapInArrow(run, "segment bigint, once binary, twice binary")


def repeat_filter(texts: DataFrame, n_bits: int, min_chars: int) -> np.ndarray:
    """The filter of keys seen twice, folded to at most FILTER_BYTES, as bytes."""
    rows = min(n_bits, FILTER_BYTES * 8) // ROW_BITS

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
        for seen, again in zip(parts["once"], parts["twice"], strict=True):
            bits = np.frombuffer(seen, "<u4")
            twice[bits[once[bits]]] = True
            once[bits] = True
            twice[np.frombuffer(again, "<u4")] = True
        packed = np.packbits(twice, bitorder="little").reshape(-1, ROW_BITS // 8)
        used = np.flatnonzero(packed.any(axis=1))
        first = int(parts["segment"].iloc[0]) * (SEGMENT_BITS // ROW_BITS)
        return pd.DataFrame({"row": (first + used) % rows, "bits": [packed[i].tobytes() for i in used]})

    merged = partial_filters(texts, n_bits, min_chars).groupBy("segment").applyInPandas(merge, "row bigint, bits binary")
    out = np.zeros((rows, ROW_BITS // 8), np.uint8)
    for row, bits in merged.groupBy("row").agg(F.bitmap_or_agg("bits").alias("bits")).toLocalIterator():
        out[row] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def suspects(docs: DataFrame, twice: np.ndarray, min_chars: int) -> DataFrame:
    """(digest, doc_id) of the keys that the filter lets pass, once for each row of ``docs``."""
    n_bits = len(twice) * 8
    shared = docs.sparkSession.sparkContext.broadcast(twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        for batch in batches:
            data, offsets = utf8_bytes(batch.column(1))
            for low, high in pieces(offsets):
                inner = offsets[low : high + 1]
                part = data[inner[0] : inner[-1]]
                owner, begin, length, hashes = line_keys(part, inner - inner[0], min_chars)
                passed = np.ones(len(hashes), bool)
                for bits in positions(hashes, n_bits):
                    passed &= (filled[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1 == 1
                at = np.flatnonzero(passed)
                digests = [hashlib.sha256(part[b : b + n].tobytes().lower()).digest() for b, n in zip(begin[at], length[at], strict=True)]
                ids = batch.column(0).take(pa.array(owner[at] + low))
                yield pa.record_batch([pa.array(digests, pa.binary()), ids], ["digest", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, f"digest binary, doc_id {docs.schema['doc_id'].dataType.simpleString()}")


def lines_to_drop(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, gone): the SHA-256 digests of the keys whose lines each document loses; documents that lose none have no row."""
    scratch = Scratch(docs.sparkSession, "lines")
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    lines = known.agg(F.coalesce(F.sum(count_lines(F.col("text"))), F.lit(0))).head()[0]
    twice = repeat_filter(known.select("text"), filter_size(lines), min_chars)
    suspected = scratch.table(suspects(known, twice, min_chars), "suspects")
    ends = suspected.groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    repeated = scratch.table(ends.where("keeper < last").drop("last"), "repeated")
    joined = spread_join(suspected, repeated.drop("n"), ["digest"], hot_keys(repeated, ["digest"], scratch), by="doc_id")
    lists = scratch.table(joined.where("doc_id > keeper").groupBy("doc_id").agg(F.collect_set("digest").alias("gone")), "lists")
    scratch.keep("lists")
    return lists


@F.arrow_udf(T.StructType([T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())]))
def _edited(texts: pa.Array, gone: pa.Array, min_chars: pa.Array) -> pa.Array:
    dropped, kept = [], []
    for text, digests, least in zip(texts.to_pylist(), gone.to_pylist(), min_chars.to_pylist(), strict=True):
        if text is None:
            dropped.append(0)
            kept.append(None)
            continue
        lines, lost = text.split("\n"), set(digests)
        stay = []
        for line in lines:
            key = line.strip(SPACE)
            if len(key) < least or hashlib.sha256(key.encode().lower()).digest() not in lost:
                stay.append(line)
        dropped.append(len(lines) - len(stay))
        kept.append("\n".join(stay))
    return pa.StructArray.from_arrays([pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["n_dropped", "kept"])


def _marked(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """(__row, touched) for each row of ``docs``; where touched is false, the document isn't in ``lists``."""
    n_bits = min(FILTER_BYTES * 8, max(ROW_BITS, 1 << (max(1, lists.count() * BITS) - 1).bit_length()))
    bit = lambda key: F.pmod(F.xxhash64(key), F.lit(n_bits))
    rows = lists.select(bit("doc_id").alias("bit")).groupBy(F.floor(F.col("bit") / ROW_BITS).alias("__bits_of"))
    bitmap = rows.agg(F.bitmap_construct_agg(F.col("bit") % ROW_BITS).alias("__bits"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")).withColumn("__bit", bit("__row.doc_id"))
    joined = row.join(F.broadcast(bitmap), F.floor(F.col("__bit") / ROW_BITS) == F.col("__bits_of"), "left")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__bit") % ROW_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1
    return joined.select("__row", F.coalesce(is_set & F.col("__row.doc_id").isNotNull(), F.lit(False)).alias("touched"))


def edit_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(__row, n_lines, n_dropped, kept) for each row of ``docs``: the row, its lines, those that it loses, and the text of the others."""
    lists = lines_to_drop(docs, min_chars)
    marked = _marked(docs, lists)
    joined = marked.where("touched").join(lists, F.col("__row.doc_id") == F.col("doc_id"), "left")
    lost = _edited(F.col("__row.text"), F.coalesce("gone", F.array().cast("array<binary>")), F.lit(min_chars))
    edited = joined.select("__row", lost.alias("edited")).select("__row", "edited.n_dropped", "edited.kept")
    untouched = marked.where("NOT touched").select("__row", F.lit(0).cast("bigint").alias("n_dropped"), F.col("__row.text").alias("kept"))
    text = F.coalesce("__row.text", F.lit(""))
    return untouched.unionByName(edited).select("__row", count_lines(text).alias("n_lines"), "n_dropped", F.coalesce("kept", F.lit("")).alias("kept"))


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """The rows of ``docs`` without the lines that a document with a smaller doc_id holds too."""
    edited = edit_lines(docs, min_chars)
    return edited.select(*[F.when(F.col("__row.text").isNotNull(), F.col("kept")).alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
