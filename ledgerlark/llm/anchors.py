"""Content-defined anchors: which 50-byte windows may occur elsewhere, and where equal ones meet.

Every window of ``length`` bytes has an anchor: the smallest hash of the grams of GRAM bytes in it.
Equal windows have equal anchors, so a window whose anchor no other document has occurs in none.
Neighbouring windows mostly share an anchor, so few hashes stand for a text.
"""

from __future__ import annotations

import numpy as np

from .words import mixed

GRAM = 16


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of each 16 bytes that follow one another."""
    if len(b) < GRAM:
        return np.empty(0, np.uint64)
    eight = np.ndarray((len(b) - 7,), "<u8", np.ascontiguousarray(b), strides=(1,))
    a = eight[: len(b) - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
    a ^= a >> np.uint64(29)
    a += eight[8:]
    a *= np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(32)
    a *= np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(29))


def window_anchors(b: np.ndarray, length: int) -> np.ndarray:
    """The anchor of each window, by its first byte."""
    h = gram_hashes(b)
    width = length - GRAM + 1
    if len(h) < width:
        return np.empty(0, np.uint64)
    span = 1
    while 2 * span <= width:
        h = np.minimum(h[: len(h) - span], h[span:])
        span *= 2
    if span < width:
        h = np.minimum(h[: len(h) - (width - span)], h[width - span :])
    return h


def anchors(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Per text, the distinct anchors of its windows, spread over all 64 bits."""
    out = []
    for t in texts:
        a = window_anchors(np.frombuffer(t, np.uint8), length)
        out.append(np.unique(mixed(a[np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))])) if len(a) else a)
    return out
