"""A document's quality from a linear-chain conditional random field over its lines.

Every line is good or bad. A line's evidence is what it looks like (``FEATURES``) and what its neighbours look like; the
chain also scores equal labels side by side. Forward-backward gives each line's probability to be good, and the
mean of these, weighted by the lines' length in bytes, is the document's score.

The model is fitted to documents whose lines all get the document's label. It is fitted on the driver, to at most
``max_rows`` documents of each label, those with the smallest hash of their id, and to at most ``max_lines`` of their lines
of each label (a document of more than a hundredth of these isn't fitted to); everything else runs on executors.

Defined cases: a null or empty text is one empty line; labels that are neither 0 nor 1 are ignored, and of several labels
of a document the lowest counts; of several texts of a doc_id the smallest is fitted to; without documents of both labels
every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricescope.llm.common import pieces, utf8_bytes
from pricescope.llm.segments import find_lines, find_words, hash_runs

#: Labelled documents of either label to fit to, at most.
MAX_ROWS = 1500
#: Lines of either label to fit to, at most; a document of more than a hundredth of them isn't fitted to.
MAX_LINES = 400_000
STEPS = 150
PENALTY = 1e-3

FEATURES = ["empty", "short", "log_length", "upper", "digit", "symbol", "bar", "exclaim", "stop", "wide", "word_length", "echo", "repeated_line", "ends_sentence"]


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, np.int32)
    table[list(chars.encode())] = 1
    return table


_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1
_WIDE = np.zeros(256, np.int32)
_WIDE[0xC0:] = 1
CLASSES = {"upper": _UPPER, "digit": _DIGIT, "symbol": _class("#*$%&<>@^~=+{}[]\\_"), "bar": _class("|"), "exclaim": _class("!?"), "stop": _class(".,;:"), "wide": _WIDE}


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line (lines x FEATURES), the lines' lengths, and each text's first line (n + 1)."""
    starts, lengths, first = find_lines(data, offsets)
    ends = starts + lengths
    full = np.maximum(lengths, 1)
    out = np.zeros((len(starts), len(FEATURES)), np.float32)
    put = {name: i for i, name in enumerate(FEATURES)}
    out[:, put["empty"]] = lengths == 0
    out[:, put["short"]] = (lengths > 0) & (lengths < 20)
    out[:, put["log_length"]] = np.log1p(lengths) / 5
    for name, table in CLASSES.items():
        total = np.concatenate([[0], np.cumsum(table[data])])
        out[:, put[name]] = (total[ends] - total[starts]) / full

    # Words that equal one of the three before them in their line.
    word_starts, word_lengths, _ = find_words(data, offsets)
    line_of = np.searchsorted(starts, word_starts, "right") - 1
    # An empty line may share its start with the line behind it; words belong to the last of these.
    hashes = hash_runs(data, word_starts, word_lengths)
    echo = np.zeros(len(hashes), bool)
    for lag in (1, 2, 3):
        echo[lag:] |= (hashes[lag:] == hashes[:-lag]) & (line_of[lag:] == line_of[:-lag])
    words = np.bincount(line_of, minlength=len(starts))
    out[:, put["echo"]] = np.bincount(line_of, echo, minlength=len(starts)) / np.maximum(words, 1)
    out[:, put["word_length"]] = np.minimum(lengths / np.maximum(words, 1), 40) / 10

    # Lines that occurred before in their text.
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    line_hash = hash_runs(data, starts, lengths)
    order = np.lexsort((line_hash, text_of))
    again = (text_of[order][1:] == text_of[order][:-1]) & (line_hash[order][1:] == line_hash[order][:-1]) & (lengths[order][1:] > 0)
    out[order[1:][again], put["repeated_line"]] = 1
    last = np.zeros(len(starts), np.uint8)
    last[lengths > 0] = data[ends[lengths > 0] - 1]
    out[:, put["ends_sentence"]] = np.isin(last, list(b".!?\"'):;"))
    return out, lengths, first


def with_neighbours(features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, the previous line's, the next line's, and whether there is no such line."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    edges = np.zeros((len(features), 3), np.float32)
    before[first[:-1]], after[first[1:] - 1] = 0, 0
    edges[first[:-1], 0], edges[first[1:] - 1, 1], edges[:, 2] = 1, 1, 1
    return np.hstack([features, before, after, edges])


def chain(evidence: np.ndarray, first: np.ndarray, bad: float, good: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages as log-odds of good over bad, for every line of every text.

    ``bad`` and ``good`` are the scores of two bad and of two good lines side by side. The forward message holds the
    line's own evidence, the backward message doesn't.
    """
    lines = np.diff(first)
    order = np.argsort(-lines, kind="stable")
    begin, count = first[:-1][order], lines[order]
    forward, backward = evidence.astype(np.float64), np.zeros(len(evidence))
    ends = begin + count - 1
    # Texts with more than t lines, for t = 1, 2, ...
    active = np.searchsorted(-count, -np.arange(2, (count[0] if len(count) else 1) + 1), "right")
    for t, n in enumerate(active, 1):
        here = begin[:n] + t
        d = forward[here - 1]
        forward[here] += np.logaddexp(0, good + d) - np.logaddexp(bad, d)
        here = ends[:n] - t
        g = evidence[here + 1] + backward[here + 1]
        backward[here] = np.logaddexp(0, good + g) - np.logaddexp(bad, g)
    return forward, backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -x))


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bad: float
    good: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        features, lengths, first = line_features(data, offsets)
        evidence = ((with_neighbours(features, first) - self.centre) / self.scale) @ self.weights
        forward, backward = chain(evidence, first, self.bad, self.good)
        weight = np.maximum(lengths, 1)
        return np.add.reduceat(_sigmoid(forward + backward) * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def fit(features: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Model | None:
    """Maximum likelihood with a quadratic penalty, by Adam. Either label has the same total weight."""
    if len(set(labels.tolist())) < 2:
        return None
    x = with_neighbours(features, first)
    centre, scale = x.mean(0), x.std(0)
    centre[-1], scale[scale < 1e-6] = 0, 1
    x = (x - centre) / scale
    lines = np.diff(first)
    y = np.repeat(labels, lines).astype(np.float64)
    of_label = np.bincount(labels, minlength=2)
    weight = np.repeat(1 / of_label[labels] / lines, lines)
    inner = np.ones(len(x), bool)
    inner[first[1:] - 1] = False
    inner = np.flatnonzero(inner)
    theta = np.zeros(x.shape[1] + 2)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        bad, good = theta[-2:]
        evidence = x @ theta[:-2]
        forward, backward = chain(evidence, first, bad, good)
        gradient = np.empty_like(theta)
        gradient[:-2] = x.T @ (weight * (y - _sigmoid(forward + backward)))
        d, g = forward[inner], evidence[inner + 1] + backward[inner + 1]
        total = np.logaddexp(np.logaddexp(bad, g), np.logaddexp(d, d + good + g))
        gradient[-2] = np.sum(weight[inner] * ((1 - y[inner]) - np.exp(bad - total)))
        gradient[-1] = np.sum(weight[inner] * (y[inner] - np.exp(d + good + g - total)))
        gradient -= PENALTY * theta
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        theta += 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model(centre, scale, theta[:-2], float(theta[-2]), float(theta[-1]))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_lines: int = MAX_LINES) -> Model | None:
    """Fit to documents that aren't held out; what the driver gets is bounded by ``max_rows`` and ``max_lines``."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).withColumn("h", F.xxhash64("doc_id"))
    chosen = [one.where(F.col("quality") == q).orderBy("h", "doc_id").limit(max_rows) for q in (0, 1)]
    sample = chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("chosen_id"), "quality", "h")

    @F.arrow_udf("struct<lines: array<int>, features: array<float>>")
    def measure(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            raw = np.frombuffer((text or "").encode(), np.uint8)
            features, lengths, _ = line_features(raw, np.array([0, len(raw)]))
            rows.append({"lines": lengths.astype(np.int32), "features": features.ravel()})
        return pa.array(rows, pa.struct([("lines", pa.list_(pa.int32())), ("features", pa.list_(pa.float32()))]))

    # At most 2 x max_rows ids.
    matched = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("chosen_id"))
    texts = matched.groupBy("h", "doc_id", "quality").agg(F.min("text").alias("text"))
    counted = texts.withColumn("n_lines", F.coalesce(F.length("text") - F.length(F.translate("text", "\n", "")), F.lit(0)) + 1)
    summed = counted.where(100 * F.col("n_lines") <= max_lines).withColumn("total", F.expr("sum(n_lines) OVER (PARTITION BY quality ORDER BY h, doc_id)"))
    held = summed.where(F.col("total") <= max_lines)
    rows = held.select("h", "doc_id", "quality", measure("text").alias("m")).select("h", "doc_id", "quality", F.size("m.lines").alias("n"), "m.features").toPandas()
    rows = rows.sort_values(["h", "doc_id", "n"], kind="stable")
    if not len(rows):
        return None
    features = np.concatenate([np.asarray(f, np.float32) for f in rows["features"]]).reshape(-1, len(FEATURES))
    return fit(features, np.concatenate([[0], np.cumsum(rows["n"].to_numpy())]), rows["quality"].to_numpy())


def score_of(text: Column, model: Model | None) -> Column:
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        data, offsets = utf8_bytes(texts)
        parts = [model.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in pieces(offsets)]
        return pa.array(np.concatenate([np.empty(0), *parts]), pa.float64())

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_lines: int = MAX_LINES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, whether its label was kept from the model, and its score."""
    model = train(docs, labels, max_rows, max_lines)
    return docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score_of(F.col("text"), model).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = MAX_ROWS, max_lines: int = MAX_LINES) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with the columns of ``docs``."""
    model = train(docs, labels, max_rows, max_lines)
    scored = docs.withColumn("__score", score_of(F.col("text"), model)).where(F.col("__score") >= threshold)
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns])
