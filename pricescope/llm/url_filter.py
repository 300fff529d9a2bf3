"""URL filters: a bit-parallel automaton for many wildcard rules.

A rule is a glob over the canonical URL ``.host/path``: ``*`` stands for any characters but ``/``, ``**`` for any
characters, ``?`` for one character but ``/``. All rules are packed one behind another into 64-bit words, one bit for each
prefix of a rule; a byte of the URL moves all of them at once (Shift-And, with bits that stay where a wildcard
stands). A batch of URLs is matched column by column in numpy.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; of the rules that fit,
the longest decides, and of equally long ones the first in the list; where none fits, the default verdict holds.
URLs of any length are matched whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricescope.llm.common import ascii_lower, pieces, utf8_bytes

#: Cells of the byte matrix that one group of URLs makes.
CELLS = 4 << 20


@dataclass(frozen=True)
class Rule:
    name: str
    glob: str
    verdict: str


def site_rule(verdict: str, name: str) -> Rule:
    """A rule ``host/path`` for the host, all its subdomains, and paths that start with the rule's."""
    host, _, path = name.partition("/")
    literal = "".join(f"\\{c}" if c in "*?\\" else c for c in f"{host}/{path}")
    return Rule(name, f"*.{literal}**", verdict)


def parse_glob(glob: str) -> list[str | int]:
    """Bytes as numbers, wildcards as ``*``, ``**`` and ``?``; a backslash takes the next character literally."""
    tokens: list[str | int] = []
    at = 0
    while at < len(glob):
        c = glob[at]
        if c == "\\" and at + 1 < len(glob):
            at += 1
            tokens += glob[at].encode()
        elif c == "*":
            double = glob[at : at + 2] == "**"
            tokens.append("**" if double else "*")
            at += double
        elif c == "?":
            tokens.append("?")
        else:
            tokens += c.encode()
        at += 1
    return tokens


@dataclass
class Automaton:
    """start, moves[byte], stays[byte]: words of bits. ends: for each rule, the word and bit of its last state."""

    start: np.ndarray
    moves: np.ndarray
    stays: np.ndarray
    ends: list[tuple[int, int]]


def build(rules: list[Rule]) -> Automaton:
    parsed = [parse_glob(r.glob) for r in rules]
    states = [1 + sum(t not in ("*", "**") for t in tokens) for tokens in parsed]
    words = max(1, -(-sum(states) // 64))
    start = np.zeros(words, np.uint64)
    moves, stays = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    ends, base = [], 0
    not_slash = np.arange(256) != ord("/")
    for tokens, n in zip(parsed, states, strict=True):
        bit = base
        start[bit >> 6] |= np.uint64(1) << np.uint64(bit & 63)
        for t in tokens:
            here = np.uint64(1) << np.uint64(bit & 63)
            if t == "**":
                stays[:, bit >> 6] |= here
            elif t == "*":
                stays[not_slash, bit >> 6] |= here
            else:
                bit += 1
                here = np.uint64(1) << np.uint64(bit & 63)
                if t == "?":
                    moves[not_slash, bit >> 6] |= here
                else:
                    moves[t, bit >> 6] |= here
        ends.append((bit >> 6, bit & 63))
        base += n
    return Automaton(start, moves, stays, ends)


def match(automaton: Automaton, data: np.ndarray, offsets: np.ndarray, order: list[int]) -> np.ndarray:
    """For each text the number of the rule that decides, or -1. ``order``: the rules from weakest to strongest."""
    n, words = len(offsets) - 1, len(automaton.start)
    best = np.full(n, -1, np.int64)
    lengths = np.diff(offsets)
    by_length = np.argsort(lengths, kind="stable")
    at = 0
    while at < n:
        # Texts of like length together, so that the matrix is hardly larger than the texts.
        size = max(1, min(n - at, 65_536))
        while size > 1 and size * max(1, int(lengths[by_length[at + size - 1]])) * max(1, words // 8) > CELLS:
            size //= 2
        rows = by_length[at : at + size]
        at += size
        state = np.tile(automaton.start, (size, 1))
        for i in range(int(lengths[rows[-1]])):
            live = int(np.searchsorted(lengths[rows], i, "right"))
            now = data[offsets[rows[live:]] + i]
            old = state[live:]
            shifted = old << np.uint64(1)
            shifted[:, 1:] |= old[:, :-1] >> np.uint64(63)
            state[live:] = (shifted & automaton.moves[now]) | (old & automaton.stays[now])
        for r in order:
            word, bit = automaton.ends[r]
            best[rows[(state[:, word] >> np.uint64(bit)) & np.uint64(1) == 1]] = r
    return best


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null where none fits) and ``verdict`` (columns of these names are replaced)."""
    automaton = build(rules)
    order = sorted(range(len(rules)), key=lambda r: (len(rules[r].name), -r))
    names = [r.name for r in rules]
    verdicts = [r.verdict for r in rules]

    @F.arrow_udf("struct<rule: string, verdict: string>")
    def judge(urls: pa.Array) -> pa.Array:
        data, offsets = utf8_bytes(urls)
        found = [np.empty(0, np.int64)]
        for low, high in pieces(offsets, 16 << 20):
            found.append(match(automaton, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], order))
        which = np.concatenate(found)
        index = pa.array(which, mask=which < 0)
        rule = pa.array(names, pa.string()).take(index)
        verdict = pa.array(verdicts, pa.string()).take(index).fill_null(default)
        return pa.StructArray.from_arrays([rule, verdict], ["rule", "verdict"])

    parts = r"(?s)://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    split = pages.withColumns({"host": ascii_lower(F.regexp_extract(text, parts, 1)), "path": F.regexp_extract(text, parts, 2)})
    judged = split.withColumn("__judged", judge(F.concat(F.lit("."), F.col("host"), F.col("path"))))
    return judged.withColumns({"rule": F.col("__judged.rule"), "verdict": F.col("__judged.verdict")}).drop("__judged")
