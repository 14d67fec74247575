"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

The entropy of each window of a candidate string is kept up by counts: moving the window by one
character changes two counts. Sums are whole numbers, so a window has one value however it was
reached. Candidates that an allow-list knows are suppressed; what the fixed patterns find stays.

Defined edge cases: a null text counts as an empty one and has no span; texts are scanned whole,
in time proportional to their length; equal rows get equal rows; an empty table stays empty;
other columns pass through, and columns named like the new ones are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import quoted, texts_of, with_columns_from

KINDS = ("assign", "access", "hex", "entropy")

# The base patterns.
ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_HINTS = ("passw", "secret", "token", "api_key", "apikey")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32


@dataclass(frozen=True)
class CharClass:
    """A character class with the window and the entropy (bits a character) from which a window counts."""

    name: str
    members: str
    window: int
    bits: float


# Classes, candidates, allow-list.
CLASSES = (
    CharClass("hex", "0123456789abcdefABCDEF", 20, 3.0),
    CharClass("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 20, 3.9),
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
ALLOWED = (
    r"[0-9_/=+-]+",  # numbers, dates, rules
    r"[A-Za-z_/=+-]+",  # words, paths and identifiers without a digit
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUID
    r"(?:[a-z]+[/_-])+[a-z0-9]{1,12}",  # a path or slug
    r".*(?:EXAMPLE|example|PLACEHOLDER|placeholder).*",
)
UNIT = 1 << 20


def entropies(text: str, window: int) -> Iterable[tuple[int, int]]:
    """(start, n * H in 1/UNIT bits) of every window, by incremental counts."""
    cost = [0] + [round(c * math.log2(c) * UNIT) for c in range(1, window + 1)]
    full, counts, total = cost[window], {}, 0
    for i, ch in enumerate(text):
        if i >= window:
            old = text[i - window]
            c = counts[old]
            total += cost[c - 1] - cost[c]
            counts[old] = c - 1
        c = counts.get(ch, 0)
        total += cost[c + 1] - cost[c]
        counts[ch] = c + 1
        if i >= window - 1:
            yield i - window + 1, full - total


class Scanner:
    def __init__(self, classes: Iterable[CharClass] = CLASSES, allowed: Iterable[str] = ALLOWED, literals: Iterable[str] = ()) -> None:
        self.classes = tuple(classes)
        self.runs = [re.compile(f"[{re.escape(c.members)}]{{{c.window},}}") for c in self.classes]
        self.allowed = re.compile("|".join(f"(?:{a})" for a in allowed)) if allowed else None
        self.literals = frozenset(literals)
        least = min([ACCESS_LEAST, *(c.window for c in self.classes)])
        word = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-")
        self.is_word = bytes(97 if b in word else 32 for b in range(256))
        self.long_run = b"a" * least

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, kind) of the fixed patterns; leftmost, not overlapping within a kind."""
        low = text.lower()
        spans = []
        if any(h in low for h in ASSIGN_HINTS):
            spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        # both other patterns need a run that this looks for in one pass over the bytes
        if self.long_run in text.encode("utf-8", "surrogatepass").translate(self.is_word):
            spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
            spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
            spans += self.high_entropy(text, spans)
        return sorted(spans, key=lambda s: (s[0], s[2], s[1]))

    def high_entropy(self, text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Unions of windows over the threshold, class by class, without those inside a known span."""
        found: list[tuple[int, int]] = []
        for candidate in CANDIDATE.finditer(text):
            word, at = candidate[0], candidate.start()
            if word in self.literals or self.allowed and self.allowed.fullmatch(word):
                continue
            for kind, runs in zip(self.classes, self.runs, strict=True):
                least = round(kind.bits * kind.window * UNIT)
                for run in runs.finditer(word):
                    for start, bits in entropies(run[0], kind.window):
                        if bits >= least:
                            found.append((at + run.start() + start, at + run.start() + start + kind.window))
        merged: list[list[int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        return [(a, b, 3) for a, b in merged if not any(s <= a and b <= e for s, e, _ in known)]


SPANS = T.StructType().add("spans", T.ArrayType(T.StructType().add("kind", T.StringType(), False).add("start", T.IntegerType(), False).add("end", T.IntegerType(), False), False), False)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each maximal run of covered characters replaced by ``[secret]``."""
    out, done = [], 0
    for a, b, _ in spans:
        if b <= done:
            continue
        if a >= done and (a > done or not out):
            out += [text[done:a], "[secret]"]
        done = b
    return "".join([*out, text[done:]])


def scan(docs: DataFrame, scanner: Callable[[], Scanner] = Scanner) -> DataFrame:
    """``docs`` with ``spans`` (kind, start, end in code points), by start, then kind as in KINDS."""

    def make():
        s = scanner()
        return lambda batch: {"spans": [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in s.base(t)] for t in texts_of(batch)]}

    return with_columns_from(docs, SPANS, make)


def redacted(docs: DataFrame, scanner: Callable[[], Scanner] = Scanner) -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced and ``n_chars`` counted anew where it is there."""
    fields = T.StructType([f for f in docs.schema if f.name in ("text", "n_chars")])
    counted = "n_chars" in fields.names

    def make():
        s = scanner()

        def step(batch: pa.RecordBatch) -> dict:
            nulls = batch.column(batch.schema.get_field_index("text")).is_null().to_pylist()
            clean = [redact(t, s.base(t)) for t in texts_of(batch)]
            out = {"text": [None if n else c for n, c in zip(nulls, clean, strict=True)]}
            if counted:
                was = batch.column(batch.schema.get_field_index("n_chars")).to_pylist()
                out["n_chars"] = [w if n else len(c) for n, c, w in zip(nulls, clean, was, strict=True)]
            return out

        return step

    return with_columns_from(docs, fields, make).select(*quoted(docs.columns))
