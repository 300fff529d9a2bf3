"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts and documents are normalised alike: A to Z lower-cased, words separated by ASCII characters that are neither
letters nor digits. In the automaton every word of the benchmark stands as two characters (other words as two that no pattern
holds), so that it has few nodes and few ways on from each; its patterns are every window of ``size`` consecutive item words (a shorter item is one window). Each document
is scanned once, and hits are mapped back to offsets in the original text.

Workers get the normalised items and build the automaton, of at most ``BLOCK_WORDS`` words of them: about 170 MB. A larger
benchmark is cut into blocks (a longer item into overlapping parts); each is a scan of the texts that writes only the spans
found, by a 128-bit hash of the text, and these are joined to the documents in the end. Texts are never rewritten.

Defined cases: a null or empty text has no words and no hits; items without words have no windows; windows that several
items share count for each of them; a null item id is named ``null``; repeated rows are judged alike; an empty benchmark
leaves every document clean.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain, repeat

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricescope.llm.common import Scratch, hot_keys, spread_join

#: Item words (and so windows, at most) in one automaton; a window takes about 1,100 bytes in each Python worker.
BLOCK_WORDS = 150_000
#: First code points of a word's two characters, and what stands for a word that no item has.
HIGH, LOW, OTHER = 0x4000, 0x100, "\x01\x01"
#: Texts with hits that are broadcast to the documents where there are several blocks; beyond, they are joined by shuffle.
BROADCAST_TEXTS = 20_000
SPANS = "array<struct<item: string, first: bigint, last: bigint>>"
HITS = f"struct<n_words: bigint, spans: {SPANS}>"

#: What every byte of a text becomes: bytes of word characters stay (A to Z in lower case), others are a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
RUN = re.compile(rb"[^ ]+")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def windows(words: list[bytes], size: int):
    """(first word, words) of every window of an item."""
    for i in range(max(1, len(words) - size + 1) if words else 0):
        yield i, words[i : i + size]


def item_blocks(benchmark: DataFrame, size: int):
    """(item, normalised text) in blocks of BLOCK_WORDS words. The rows come to the driver partition by partition."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def parts(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            words = normal_words(t)
            step = max(1, BLOCK_WORDS // 4)
            rows.append([b" ".join(words[i : i + step + size - 1]).decode() for i in range(0, max(1, len(words) - size + 1), step)] if words else [])
        return pa.array(rows, pa.list_(pa.string()))

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.explode(parts("text")).alias("part")).distinct()
    block, used = [], 0
    for row in named.toLocalIterator():
        words = row["part"].count(" ") + 1
        if block and used + words > BLOCK_WORDS:
            yield block
            block, used = [], 0
        block.append((row["item"], row["part"]))
        used += words
    if block:
        yield block


class Scanner:
    """The automaton over the words of a block of items. Frequent words get the codes that are found first."""

    def __init__(self, block: list[tuple[str, str]], size: int):
        texts = [(item, text.encode().split(b" ")) for item, text in block]
        counts = Counter(w for _, words in texts for w in words)
        base = math.isqrt(len(counts)) + 1
        self.codes = {w: chr(HIGH + i // base) + chr(LOW + i % base) for i, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w)))}
        found: dict[str, tuple[int, set[str]]] = {}
        for item, words in texts:
            for _, window in windows(words, size):
                found.setdefault("".join([self.codes[w] for w in window]), (len(window), set()))[1].add(item)
        self.automaton = ahocorasick.Automaton()
        for window, (length, items) in found.items():
            self.automaton.add_word(window, (length, tuple(sorted(items))))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int, int]]]:
        """The number of words, and (item, first word, last word) of every run of overlapping or adjoining windows of an item."""
        words = normal_words(text)
        if not words or not self.codes:
            return len(words), []
        open_span: dict[str, list[int]] = {}
        spans = []
        for at, (length, items) in self.automaton.iter("".join(map(self.codes.get, words, repeat(OTHER)))):
            end = at // 2
            first = end - length + 1
            for item in items:
                span = open_span.get(item)
                if span and span[0] <= first <= span[1] + 1:
                    span[1] = max(span[1], end)
                else:
                    spans.append((item, span := [first, end]))
                    open_span[item] = span
        return len(words), [(item, *span) for item, span in spans]


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` with column ``__hits``: the number of words, and spans of words by item."""
    blocks = item_blocks(benchmark, size)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return docs.withColumn("__hits", _scan_block(docs, first, size)(F.col("text")))
    scratch = Scratch(docs.sparkSession, "decontaminate")
    found = None
    for block in chain([first, second], blocks):
        texts = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("__h1"), F.xxhash64(F.lit(1), "text").alias("__h2"), _scan_block(docs, block, size)(F.col("text"))["spans"].alias("spans"))
        part = scratch.table(texts.where(F.size("spans") > 0).groupBy("__h1", "__h2").agg(F.first("spans").alias("spans")), "spans")
        found = part if found is None else found.unionByName(part)
    spans = scratch.table(found.groupBy("__h1", "__h2").agg(F.flatten(F.collect_list("spans")).alias("__spans")), "all")
    scratch.keep("all")
    counted = docs.withColumn("__n", _scan_block(docs, [], size)(F.col("text"))["n_words"]).withColumn("__h1", F.xxhash64("text")).withColumn("__h2", F.xxhash64(F.lit(1), "text"))
    if spans.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
        joined = counted.join(F.broadcast(spans), ["__h1", "__h2"], "left")
    else:
        copies = hot_keys(counted.groupBy("__h1", "__h2").agg(F.count("*").alias("n")), ["__h1", "__h2"], scratch)
        joined = spread_join(counted, spans, ["__h1", "__h2"], copies, "doc_id", "left")
    none = F.array().cast(SPANS)
    return joined.withColumn("__hits", F.struct(F.col("__n").alias("n_words"), F.coalesce("__spans", none).alias("spans"))).drop("__n", "__h1", "__h2", "__spans")


def _scan_block(docs: DataFrame, block: list[tuple[str, str]], size: int):
    held = docs.sparkSession.sparkContext.broadcast(block)
    made: dict[str, Scanner] = {}

    @F.arrow_udf(HITS)
    def scan(texts: pa.Array) -> pa.Array:
        scanner = made.get("scanner") or made.setdefault("scanner", Scanner(held.value, size))
        rows = []
        for t in texts:
            n, spans = scanner.scan(t.as_py())
            rows.append({"n_words": n, "spans": [{"item": s, "first": a, "last": b} for s, a, b in spans]})
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("item", pa.string()), ("first", pa.int64()), ("last", pa.int64())])))]))

    return scan


def count_hit(spans: list[dict]) -> int:
    """Words inside at least one span."""
    total, reach = 0, -1
    for first, last in sorted((s["first"], s["last"]) for s in spans):
        total += max(0, last - max(first, reach + 1) + 1)
        reach = max(reach, last)
    return total


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """One row for each document: words, words hit, and the items found (sorted as strings)."""

    @F.arrow_udf(T.LongType())
    def hit(hits: pa.Array) -> pa.Array:
        return pa.array([count_hit(spans) if spans else 0 for spans in pc.struct_field(hits, "spans").to_pylist()], pa.int64())

    hits = find_hits(docs.select("doc_id", "text"), benchmark, size)
    return hits.select(
        "doc_id",
        F.col("__hits.n_words").alias("n_words"),
        hit("__hits").alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform("__hits.spans", lambda s: s["item"]))).alias("items"),
    )


def original_spans(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Every hit as a row: doc_id, item, and where it starts and ends (exclusive) in the original text, in characters."""

    @F.arrow_udf("array<struct<item: string, start: bigint, end: bigint>>")
    def place(texts: pa.Array, hits: pa.Array) -> pa.Array:
        rows = []
        for t, h in zip(texts, hits, strict=True):
            spans, out = (h.as_py() or {}).get("spans") or [], []
            if spans:
                raw = t.as_py().encode()
                at = [m.span() for m in RUN.finditer(raw.translate(NORMAL))]
                out = [{"item": s["item"], "start": len(raw[: at[s["first"]][0]].decode()), "end": len(raw[: at[s["last"]][1]].decode())} for s in spans]
            rows.append(out)
        return pa.array(rows, pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

    hits = find_hits(docs.select("doc_id", "text"), benchmark, size)
    return hits.select("doc_id", F.inline(place("text", "__hits")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` that contain no window of the benchmark, with the columns of ``docs``."""
    kept = find_hits(docs, benchmark, size).where(F.size("__hits.spans") == 0)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
