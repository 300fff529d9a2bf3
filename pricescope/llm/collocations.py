"""Phrase collocations: merged count-min sketches bound the counts of word sequences, exact counts of those that may be frequent follow.

Texts are lower-cased (A to Z), cut into pieces at punctuation and line ends, and pieces into words. A phrase is a sequence of words
inside a piece; everything is counted by language.

1. Count-min sketches. Each task counts hashes of its phrases in ``DEPTH`` rows of counters, which stop at ``min_count``: a sum
   can only be too large, so no phrase that is frequent is lost. Tasks' sketches are cut into segments, which are added up in
   one task each; what is left of a counter is one bit: below ``min_count`` or not. The first sketch counts single words and
   pairs, the second longer phrases whose pairs all passed the first. The counters grow with the text up to
   ``MAX_WIDTH``; beyond, more phrases pass than are frequent, which costs time, never a phrase.
2. Exact counts of the phrases that pass, and whose shorter parts pass: added up inside a task, then by phrase.
   Each of these tasks takes many files, so that there are ``TASKS_PER_CORE`` sketches and tables of counts for each core, whatever
   the input: what is shuffled grows with the phrases, not with the files that they stand in.
3. Scores. A phrase of m words with count a, cut into parts with counts l and r in a language of n words, scores
   ``floor(1000 * a * n / (l * r))``; its lowest-scoring cut counts, the shortest first part at ties. Parts of a frequent phrase
   are frequent, so their counts are in the same table. A phrase goes if it lies inside a longer one with nearly its count.

Phrases inside a task are told apart by 64-bit hashes of their words, mixed with the language's; beyond, by their text. Two
different frequent phrases of one task would have to share a hash to be added up as one (odds of 3e-8 for a million of them).

Defined cases: a null text is empty; a null language is ``und``; equal rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricescope.llm.common import Scratch, hot_keys, pieces, spread_join, utf8_bytes
from pricescope.llm.segments import LOWER_CODES, find_words, hash_runs, mix

#: Rows of counters, counters in one segment, and the bounds of a row's counters; text bytes for each counter below the bound.
DEPTH, SEGMENT, MIN_WIDTH, MAX_WIDTH, BYTES_PER_COUNTER = 2, 1 << 15, 1 << 18, 1 << 26, 128
TASKS_PER_CORE = 2
#: Phrases that a task counts before it sends them.
FLUSH = 400_000
LONGEST = 5

#: What ends a piece (``.,;:!?`` and the bytes 0A to 0D), and what separates words inside it.
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPARATORS = BREAKS.copy()
SEPARATORS[[0x20, 0x09]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and hash of each word (the hash of its text's language is mixed in), its piece (a number that rises), and each text's first word."""
    starts, lengths, first = find_words(data, offsets, SEPARATORS)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    ended = np.concatenate([[0], np.cumsum(BREAKS[data])])
    return starts, lengths, mix(hash_runs(data, starts, lengths, LOWER_CODES) ^ langs[owner]), ended[starts] + owner, first


def extend(hashes: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the phrases of ``length`` words, from those one word shorter. Only phrases inside a piece mean anything."""
    return mix(hashes[: len(words) - length + 1] * np.uint64(0x9E3779B97F4A7C15) + words[length - 1 :])


def counters(hashes: np.ndarray, width: int) -> list[np.ndarray]:
    """Each hash's counter in each row, counted on from row to row."""
    return [((hashes >> np.uint64(32 * j)) & np.uint64(width - 1)).astype(np.int64) + j * width for j in range(DEPTH)]


def passes(sketch: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    """Whether all counters of a hash are full; ``sketch`` has one bit a counter."""
    out = np.ones(len(hashes), bool)
    for place in counters(hashes, width):
        out &= (sketch[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return out


def dealt(texts: DataFrame) -> DataFrame:
    """The texts in few partitions of many files: each adds up on its own before anything is shuffled."""
    return texts.coalesce(texts.sparkSession.sparkContext.defaultParallelism * TASKS_PER_CORE)


def sketch_width(n_bytes: int) -> int:
    """Counters in a row for texts of so many bytes: a power of two."""
    return min(MAX_WIDTH, max(MIN_WIDTH, 1 << (max(1, n_bytes // BYTES_PER_COUNTER) - 1).bit_length()))


def frequent_starts(words: np.ndarray, piece: np.ndarray, width: int, sketches: list[np.ndarray], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, hashes, inside, passed) for each length of phrase: ``inside`` marks those inside a piece, ``passed`` those of them that all sketches let pass.

    Without a sketch for a length, a phrase passes if its parts do.
    """
    hashes, passed = words, None
    for length in range(1, longest + 1):
        if length > len(words):
            return
        if length > 1:
            hashes = extend(hashes, words, length)
        n = len(hashes)
        inside = piece[:n] == piece[length - 1 :]
        ok = inside.copy() if passed is None else inside & passed[:n] & passed[1 : n + 1]
        sketch = sketches[0 if length <= 2 else 1] if len(sketches) > (length > 2) else None
        if sketch is not None:
            at = np.flatnonzero(ok)
            ok[at] = passes(sketch, hashes[at], width)
        yield length, hashes, inside, ok
        passed = ok


def _language_hashes(langs: pa.Array) -> np.ndarray:
    data, offsets = utf8_bytes(langs)
    return hash_runs(data, offsets[:-1], np.diff(offsets))


def build_sketch(texts: DataFrame, width: int, min_count: int, known: list) -> np.ndarray:
    """One bit for each counter, full or not. Without ``known`` sketches of words and pairs, with the first of longer phrases that may be frequent."""
    kind = np.uint8 if min_count <= 255 else np.uint32
    full = np.iinfo(kind).max if kind is np.uint8 else min_count
    lengths = (3, LONGEST) if known else (1, 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(DEPTH * width, kind)
        sketches = [s.value for s in known]
        for batch in batches:
            langs = _language_hashes(batch.column(0))
            data, offsets = utf8_bytes(batch.column(1))
            for low, high in pieces(offsets):
                inner = offsets[low : high + 1]
                words, piece = word_hashes(data[inner[0] : inner[-1]], inner - inner[0], langs[low:high])[2:4]
                for length, hashes, inside, ok in frequent_starts(words, piece, width, sketches, lengths[1]):
                    if length < lengths[0]:
                        continue
                    for place in counters(hashes[ok if known else inside], width):
                        used, times = np.unique(place, return_counts=True)
                        table[used] = np.minimum(table[used].astype(np.int64) + times, full).astype(kind)
        cut = table.reshape(-1, SEGMENT)
        used = np.flatnonzero(cut.any(axis=1))
        for begin in range(0, len(used), 64):
            some = used[begin : begin + 64]
            yield pa.record_batch([pa.array(some), pa.array([cut[i].tobytes() for i in some], pa.binary())], ["segment", "counts"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SEGMENT, np.int64)
        for counts in parts["counts"]:
            total += np.frombuffer(counts, kind)
        return pd.DataFrame({"segment": parts["segment"].iloc[:1], "bits": [np.packbits(total >= min_count, bitorder="little").tobytes()]})

    parts = dealt(texts).mapInArrow(count, "segment bigint, counts binary")
    out = np.zeros((DEPTH * width // SEGMENT, SEGMENT // 8), np.uint8)
    for segment, bits in parts.groupBy("segment").applyInPandas(add, "segment bigint, bits binary").toLocalIterator():
        out[segment] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def exact_counts(texts: DataFrame, width: int, sketches: list) -> DataFrame:
    """(lang, size, phrase, n) of the phrases that may be frequent, added up by task, and the number of words by language as the phrase of size 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [s.value for s in sketches]
        totals: dict[str, int] = {}
        found: dict[int, list] = {}

        def send() -> pa.RecordBatch:
            rows = [*((lang, 0, "", n) for lang, n in totals.items()), *found.values()]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            totals.clear()
            found.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "size", "phrase", "n"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            langs = _language_hashes(batch.column(0))
            data, offsets = utf8_bytes(batch.column(1))
            for low, high in pieces(offsets):
                inner = offsets[low : high + 1]
                part = data[inner[0] : inner[-1]]
                starts, lengths, words, piece, first = word_hashes(part, inner - inner[0], langs[low:high])
                for name, n in zip(names[low:high], np.diff(first), strict=True):
                    totals[name] = totals.get(name, 0) + int(n)
                for length, hashes, _, ok in frequent_starts(words, piece, width, bits, LONGEST):
                    at = np.flatnonzero(ok)
                    keys, where, times = np.unique(hashes[at], return_index=True, return_counts=True)
                    for key, i, n in zip(keys.tolist(), at[where].tolist(), times.tolist(), strict=True):
                        # A hash of another length may be equal: the length is part of the key.
                        row = found.get(key * 8 + length)
                        if row is None:
                            spelled = b" ".join(part[s : s + m].tobytes().lower() for s, m in zip(starts[i : i + length], lengths[i : i + length], strict=True))
                            found[key * 8 + length] = [names[low + int(np.searchsorted(first, i, "right")) - 1], length, spelled.decode(), n]
                        else:
                            row[3] += n
                if len(found) >= FLUSH:
                    yield send()
        yield send()

    return dealt(texts).mapInArrow(run, "lang string, size int, phrase string, n bigint")


def part_text(phrase, low, high):
    """The words ``low`` to ``high`` (from 1) of a phrase."""
    return F.array_join(F.slice(F.split(phrase, " "), low, high - low + 1), " ")


def count_phrases(docs: DataFrame, min_count: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """(lang, size, phrase, n) of all phrases of 1 to LONGEST words that occur ``min_count`` times; size 0 has each language's number of words."""
    scratch = scratch or Scratch(docs.sparkSession, "phrases")
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    width = sketch_width(texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0])
    sketches: list = []
    for _ in range(2):
        sketches.append(context.broadcast(build_sketch(texts, width, min_count, list(sketches))))
    counted = exact_counts(texts, width, sketches).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return scratch.table(counted.where(f"size = 0 OR n >= {min_count}"), "counts")


def score_phrases(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score) of the phrases of two words and more: that of their lowest-scoring cut."""
    candidates = counts.where("size >= 2").select("lang", "phrase", "size", F.col("n").alias("a"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    sides = F.array(F.struct(F.lit("l").alias("side"), part_text(F.col("phrase"), F.lit(1), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), part_text(F.col("phrase"), F.col("k") + 1, F.col("size")).alias("part")))
    parts = scratch.table(cuts.select("lang", "phrase", "a", "size", "k", F.explode(sides).alias("p")).select("lang", "phrase", "a", "size", "k", "p.side", "p.part"), "parts")
    hot = hot_keys(parts.groupBy("lang", "part").agg(F.count("*").alias("n")), ["lang", "part"], scratch)
    known = counts.where("size >= 1").select("lang", F.col("phrase").alias("part"), F.col("n").alias("count"))
    found = spread_join(parts, known, ["lang", "part"], hot, by="phrase")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("count")))
    pairs = found.groupBy("lang", "phrase", "size", "a", "k").agg(of("l").alias("l"), of("r").alias("r"))
    totals = counts.where("size = 0").select("lang", F.col("n").alias("n"))
    scored = pairs.join(totals, "lang").withColumn("score", F.expr("cast(1000 AS decimal(38, 0)) * cast(a AS decimal(38, 0)) * cast(n AS decimal(38, 0)) div (cast(l AS decimal(38, 0)) * cast(r AS decimal(38, 0)))"))
    lowest = scored.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score")


def without_parts(scored: DataFrame, counts: DataFrame, percent: int = 100) -> DataFrame:
    """The scored phrases that don't lie inside a longer frequent phrase with ``percent`` of their count."""
    spans = "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"
    inner = counts.where("size >= 3").select("lang", F.explode(F.expr(spans)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    return scored.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True))).drop("longer")


def find_collocations(docs: DataFrame, top: int = 2000, min_count: int = 100, percent: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score, count and phrase."""
    scratch = Scratch(docs.sparkSession, "phrases")
    counts = count_phrases(docs, min_count, scratch)
    scored = scratch.table(without_parts(score_phrases(counts, scratch), counts, percent), "scored")
    scratch.keep("scored")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
