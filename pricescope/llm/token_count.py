"""Token counts by a Viterbi search that keeps only the best score and its number of pieces.

An Aho-Corasick automaton enumerates the vocabulary's pieces in a word. Every place in the word keeps the best score of
the pieces up to it, and how many these are. Ties go as in the common unigram tokenizers: candidates for a place come in
order of where they start, and a later one wins only with a strictly higher score. Where no piece of one character fits,
the character is unknown at the lowest score less 10; unknown characters side by side are one piece, which is
spelled in its UTF-8 bytes if the vocabulary has byte pieces.

Words start at spaces, which are written U+2581; one stands before the first word, too. The vocabulary is read on the driver
and broadcast (its size is that of the file). Two kinds of files are taken:

* a unigram model (SentencePiece, or the JSON of the ``tokenizers`` library): its pieces and log-probabilities as they are;
* a SentencePiece BPE model: its scores are ranks of merges, no log-probabilities. Pieces get the log-probability that Zipf's
  law gives their rank, -log(rank) - log(H), H being the harmonic number of the vocabulary's size. Nothing is fitted: this
  is a unigram reading of a public vocabulary, whose counts are near those of the file's own tokenizer, not equal to them.

The names of control pieces (``<unk>``, ``<s>``, ``</s>``) and byte pieces match nothing in a text, as in SentencePiece.

Defined cases: a null or empty text has no tokens; runs of spaces give words of a space alone; texts are counted whole.
"""

from __future__ import annotations

import json
import math

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A public BPE vocabulary of 32,000 pieces with byte fallback.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CONTROL = {"<unk>", "<s>", "</s>"}
BYTES = {f"<0x{b:02X}>" for b in range(256)}
UNKNOWN_PENALTY = 10.0
#: Scores of pieces that a BPE model never merges.
UNUSED = -1e8
#: Words whose counts a worker remembers.
REMEMBERED = 400_000


def load_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """Pieces and log-probabilities of a file, in order of their ids."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        if model.get("type") != "Unigram":
            raise ValueError(f"{path} is no unigram model")
        return [(piece, score) for piece, score in model["vocab"]]
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    return zipf_scores(found) if _is_ranks(found) else found


def _is_ranks(vocabulary: list[tuple[str, float]]) -> bool:
    """Whether the scores are whole numbers that count down, as ranks of merges do (unused pieces have a very low one)."""
    scores = [score for piece, score in vocabulary if piece not in CONTROL | BYTES and score > UNUSED]
    return len(scores) > 1 and all(score == int(score) for score in scores) and all(b < a for a, b in zip(scores, scores[1:], strict=False))


def zipf_scores(vocabulary: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """The pieces with the log-probabilities that Zipf's law gives the order of their scores; unused, control and byte pieces come last."""
    own = lambda x: (x[0] in CONTROL | BYTES or x[1] <= UNUSED, -x[1])
    place = {piece: i for i, (piece, _) in enumerate(sorted(vocabulary, key=own), 1)}
    rest = math.log(sum(1 / i for i in range(1, len(vocabulary) + 1)))
    return [(piece, -math.log(place[piece]) - rest) for piece, _ in vocabulary]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        every = {piece for piece, _ in vocabulary}
        self.bytes = every >= BYTES
        self.pieces = every - CONTROL - (BYTES if self.bytes else set())
        self.unknown = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece and piece in self.pieces:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.known: dict[str, int] = {}

    def spelled(self, run: str) -> int:
        return 1 if run in self.pieces or not self.bytes else len(run.encode())

    def word(self, word: str) -> int:
        """Pieces of one word, its leading space included."""
        n = len(word)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self.automaton):
            for end, found in self.automaton.iter(word):
                ending[end].append(found)
        # For each place: the best score, the pieces up to it, and where a run of unknown characters before it began.
        best, count, run = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        for end in range(1, n + 1):
            score, start, single = None, 0, False
            for length, own in sorted(ending[end - 1], reverse=True):
                single |= length == 1
                if score is None or best[end - length] + own > score:
                    score, start = best[end - length] + own, end - length
            if not single and (score is None or best[end - 1] + self.unknown > score):
                best[end], count[end] = best[end - 1] + self.unknown, count[end - 1]
                run[end] = run[end - 1] if run[end - 1] >= 0 else end - 1
            else:
                best[end] = score
                count[end] = count[start] + 1 + (self.spelled(word[run[start] : start]) if run[start] >= 0 else 0)
        return count[n] + (self.spelled(word[run[n] :]) if run[n] >= 0 else 0)

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:
            words = words[1:]
        known, total = self.known, 0
        for w in words:
            n = known.get(w)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = self.word(SPACE + w)
                if len(w) < 100:
                    known[w] = n
            total += n
        return total


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, characters and tokens."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary if vocabulary is not None else load_vocabulary())
    made: dict[str, Counter] = {}

    @F.arrow_udf(T.LongType())
    def tokens(texts: pa.Array) -> pa.Array:
        counter = made.get("counter") or made.setdefault("counter", Counter(held.value))
        return pa.array([counter.text(t.as_py()) for t in texts], pa.int64())

    return docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), tokens("text").alias("n_tokens"))
