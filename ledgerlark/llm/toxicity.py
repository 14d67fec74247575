"""Toxicity: a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel counts common subsequences of three characters, each weighted down by the length that
it spans in either string, so a word still resembles an insult when characters are put between its
letters. Landmarks are words of labelled texts of both kinds: those that tell the kinds apart best,
without words that the ones before them already span. A text's row has, for each landmark, the
largest and the (damped) sum of a power of the kernel values (a kernel too) over its words;
multiplied by the inverse root of the landmarks' own matrix it is the text's Nystroem features. A linear machine with squared hinge loss separates labelled texts and their sentences,
which have their text's label and together its weight, and a logistic curve turns a text's margin
into a score.

Every kernel value counts, however small; only a word that has no subsequence of three characters in
common with a landmark has value 0. Letters spelled one by one are read as one word.

Defined edge cases: null, empty and blank texts have no words and get the score of a text without
any insult; repeated rows are scored alike; without labels of both kinds every score is 0; an empty
table gives no row; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices
from .quality_net import chosen, sigmoid
from .shared import written

LONGEST = 24


@dataclass(frozen=True)
class Settings:
    #: Landmarks from toxic and from other texts.
    landmarks: tuple[int, int] = (96, 16)
    decay: float = 0.8
    #: The power of the kernel, a kernel too, whose values are taken.
    power: int = 4
    #: The machine is fitted on at most so many labelled texts, those with the smallest hashes of their doc_id ...
    max_rows: int = 10_000
    #: ... and at most so many of all their sentences, those with the smallest hashes of doc_id and place.
    max_sentences: int = 20_000
    #: Least texts that a landmark occurs in, and how much of its squared norm (1) others may not span.
    least: int = 3
    apart: float = 0.3
    penalty: float = 1.0
    #: Distinct words whose kernel values a task keeps.
    known: int = 200_000


def coded(words: list[str], width: int) -> np.ndarray:
    """The characters of words of ``width``, one word a row."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32).reshape(-1, width)


def kernel(s: np.ndarray, t: np.ndarray, decay: float) -> np.ndarray:
    """The subsequence kernel of length 3 of each pair of rows of characters; padding matches nothing."""
    pairs, n, m = len(s), s.shape[1], t.shape[1]
    same = (s[:, :, None] == t[:, None, :]).transpose(1, 2, 0).astype(np.float32) * np.float32(decay * decay)
    last = np.ones((n + 1, m + 1, pairs), np.float32)
    decay = np.float32(decay)
    for _ in range(2):
        now = np.zeros((n + 1, m + 1, pairs), np.float32)
        for a in range(1, n + 1):
            row = np.zeros(pairs, np.float32)
            for b in range(1, m + 1):
                row = decay * row + same[a - 1, b - 1] * last[a - 1, b - 1]
                now[a, b] = decay * now[a - 1, b] + row
        last = now
    return np.einsum("abp,abp->p", same, last[:n, :m])


#: Three or more words of one character each, read as one word.
SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
SENTENCE_END = r"[.!?]\s|\n"
#: Marks that count for nothing around a word or between its letters.
MARKS = "\"'.,;:!?()[]{}<>#*$%&|-_~`+=/@^"
DROPPED = str.maketrans("", "", MARKS)


def cleaned(tokens: list[str]) -> list[str]:
    return [t if t.isalnum() else t.translate(DROPPED) for t in tokens]


def pieces(word: str) -> list[str]:
    """A longer word in overlapping pieces."""
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word), LONGEST // 2)]


def spelled(low: str) -> list[str]:
    """Words that are spelled letter by letter."""
    return ["".join(m[0].split()) for m in SPELLED.finditer(low)]


def words_of(text: str) -> list[str]:
    """Lower-case words without marks, those spelled letter by letter once more as one."""
    low = text.lower()
    return [p for w in cleaned(low.split() + spelled(low)) for p in pieces(w)]


class Features:
    """Every kernel value of a word with the landmarks, none left out.

    The kernel is a product of two vectors of subsequences, and only those of the landmarks count: a
    table has, for each of them, the landmarks it occurs in with its weights, and a word's own
    subsequences are looked up in it.
    """

    def __init__(self, landmarks: list[str], s: Settings) -> None:
        self.s, self.names = s, landmarks
        k = len(landmarks)
        self.alphabet = np.unique([ord(c) for w in landmarks for c in w] or [0])
        self.base = len(self.alphabet) + 1
        rows: dict[int, dict[int, float]] = {}
        for i, w in enumerate(landmarks):
            at = self.places(coded([w], len(w)))[0].tolist()
            for x, y, z in combinations(range(len(w)), 3):
                found = rows.setdefault((at[x] * self.base + at[y]) * self.base + at[z], {})
                found[i] = found.get(i, 0.0) + s.decay ** (z - x + 1)
        # the place of each subsequence's landmarks and weights in two flat arrays
        triples = sorted(rows)
        self.row = np.full(self.base**3, len(triples), np.int32)
        self.row[triples] = np.arange(len(triples))
        self.count = np.array([*(len(rows[t]) for t in triples), 0])
        self.first = np.cumsum(self.count) - self.count
        self.landmark = np.array([i for t in triples for i in rows[t]], np.int64)
        self.weight = np.array([v for t in triples for v in rows[t].values()])
        table = np.zeros((len(triples), k))
        table[np.repeat(np.arange(len(triples)), self.count[:-1]), self.landmark] = self.weight
        raw = table.T @ table
        self.own = np.sqrt(np.diag(raw))
        self.gram = (raw / np.maximum(np.outer(self.own, self.own), 1e-9)) ** s.power
        values, vectors = np.linalg.eigh((self.gram + self.gram.T) / 2)
        self.whiten = vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        #: The powers of the values of known tokens; the first row is of none.
        self.rows, self.used, self.long = np.zeros((1, len(self.names)), np.float32), 1, {}

    @property
    def size(self) -> int:
        return 2 * len(self.names)

    def places(self, codes: np.ndarray) -> np.ndarray:
        """1 and up for the landmarks' characters, 0 for others."""
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, 0).astype(np.int32)

    def values(self, words: list[str]) -> np.ndarray:
        """The kernel values of the words with each landmark."""
        k = len(self.names)
        out = np.zeros((len(words), k), np.float32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths[lengths >= 3]).tolist():
            x, y, z = np.array(list(combinations(range(n), 3))).T
            weight, of = self.s.decay ** (z - x + 1), np.nonzero(lengths == n)[0]
            step = max(1, 1_000_000 // len(x))
            for i in range(0, len(of), step):
                w = of[i : i + step]
                codes = coded([words[j] for j in w.tolist()], n)
                at = self.places(codes)
                row = self.row[(at[:, x] * self.base + at[:, y]) * self.base + at[:, z]]
                r, c = np.nonzero(self.count[row])
                if not len(r):
                    continue
                hit = row[r, c]
                many = self.count[hit]
                entry = np.repeat(self.first[hit] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                sums = np.bincount(np.repeat(r, many) * k + self.landmark[entry], self.weight[entry] * np.repeat(weight[c], many), len(w) * k).reshape(-1, k)
                some = np.nonzero(sums.any(1))[0]
                out[w[some]] = sums[some] / (self.norms(codes[some], weight)[:, None] * self.own)
        return out

    def norms(self, codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The root of each word's kernel with itself; without a letter twice, every subsequence is another one."""
        out = np.full(len(codes), np.sqrt((weight * weight).sum()))
        ordered = np.sort(codes, axis=1)
        twice = np.flatnonzero((ordered[:, 1:] == ordered[:, :-1]).any(1))
        if len(twice):
            out[twice] = np.sqrt(kernel(codes[twice], codes[twice], self.s.decay))
        return out

    def near(self, words: list[str]) -> dict[str, np.ndarray]:
        """The powers of the kernel values of the words that have one other than 0."""
        return {w: v**self.s.power for w, v in zip(words, self.values(words), strict=True) if v.any()}

    def learn(self, tokens: list[str]) -> None:
        """Keeps the powers of the kernel values of new tokens; a longer one's pieces are kept under numbers of their own."""
        for j in range(0, len(tokens), 100_000):
            part = tokens[j : j + 100_000]
            words = cleaned(part)
            long = [i for i, n in enumerate(map(len, words)) if n > LONGEST]
            if long:
                cut = {part[i]: pieces(words[i]) for i in long}
                for i in long:
                    words[i] = ""
                new = sorted({p for ps in cut.values() for p in ps}.difference(self.known, part))
                self.keep(new, new)
            self.keep(part, words)
            if long:
                self.long |= {t: [self.known[p] for p in ps] for t, ps in cut.items()}

    def keep(self, tokens: list[str], words: list[str]) -> None:
        raw = self.values(words)
        some = raw.any(1)
        kept = int(some.sum())
        if self.used + kept > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(kept, len(self.rows)), len(self.names)), np.float32)])
        powers = raw = raw[some]
        for _ in range(self.s.power - 1):
            powers = powers * raw
        self.rows[self.used : self.used + kept] = powers
        self.known.update(zip(tokens, np.where(some, self.used - 1 + np.cumsum(some), 0).tolist(), strict=True))
        self.used += kept

    def pooled(self, texts: list[str]) -> np.ndarray:
        """For each text and landmark the largest power of its words' values, and their sum."""
        out = np.zeros((len(texts), 2, len(self.names)))
        if self.used > self.s.known:
            self.clear()
        lows = [t.lower() for t in texts]
        cut = [low.split() for low in lows]
        first = np.cumsum([0, *map(len, cut)])
        codes, tokens = pd.factorize(np.array([t for c in cut for t in c], object))
        # words spelled letter by letter are looked for where three letters follow one another
        one = np.fromiter(map(len, tokens), np.int64, len(tokens))[codes] == 1 if len(codes) else np.zeros(0, bool)
        runs = np.flatnonzero(one[:-2] & one[1:-1] & one[2:])
        more = {d: spelled(lows[d]) for d in set((np.searchsorted(first, runs, "right") - 1).tolist())}
        self.learn([t for t in dict.fromkeys([*tokens, *(w for ws in more.values() for w in ws)]) if t not in self.known])
        number = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        for d in range(len(texts)):
            at = number[codes[first[d] : first[d + 1]]]
            extra = [n for w in more.get(d, ()) for n in self.long.get(w, [self.known[w]])]
            if self.long:
                extra += [n for t in cut[d] if t in self.long for n in self.long[t]]
            if extra:
                at = np.concatenate([at, np.array(extra, np.int64)])
            at = at[at > 0]
            for i in range(0, len(at), 4096):
                rows = self.rows[at[i : i + 4096]]
                np.maximum(out[d, 0], rows.max(0), out=out[d, 0])
                out[d, 1] += rows.sum(0, dtype=np.float64)
        return out

    def of(self, texts: list[str]) -> np.ndarray:
        """The Nystroem features of each text."""
        x = self.pooled(texts)
        x[:, 1] = np.log1p(x[:, 1])
        return (x @ self.whiten).reshape(len(texts), -1)


def landmarks(rows: DataFrame, s: Settings) -> list[str]:
    """Words of both kinds of texts, those that tell them apart best by log-likelihood first, without what others span.

    ``rows`` has text and label.
    """
    trimmed = F.translate("w", MARKS, "")
    words = rows.select("label", F.explode(F.array_distinct(F.split(F.lower("text"), "\\s+"))).alias("w")).select("label", trimmed.alias("w")).where(f"length(w) between 3 and {LONGEST // 2 * 2 - 8}")
    n = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    counts = words.groupBy("w").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).where(F.col("a") + F.col("b") >= s.least)
    share = lambda c, label: (F.col(c) + 0.5) / (n.get(label, 0) + 1)
    gain = lambda c, one, other: F.round(F.col(c) * F.log(one / other), 6).alias("gain")
    toxic, calm = share("a", 1), share("b", 0)
    # a few times as many as there will be landmarks: a fixed number of words
    best = [[r[0] for r in counts.select("w", g).where("gain > 0").orderBy(F.desc("gain"), "w").limit(4 * k).collect()] for g, k in zip((gain("a", toxic, calm), gain("b", calm, toxic)), s.landmarks, strict=True)]
    return sorted({w for words, k in zip(best, s.landmarks, strict=True) for w in apart(words, k, s)})


def apart(words: list[str], most: int, s: Settings) -> list[str]:
    """Of words in order of merit, those of which the ones before leave enough unexplained (a pivoted Cholesky step each)."""
    if not words:
        return []
    gram = Features(words, s).gram
    rest, taken, factor = np.diag(gram).copy(), [], np.zeros((len(words), most))
    for i in range(len(words)):
        if len(taken) < most and rest[i] >= s.apart:
            factor[:, len(taken)] = (gram[:, i] - factor @ factor[i]) / np.sqrt(rest[i])
            rest = rest - factor[:, len(taken)] ** 2
            taken.append(words[i])
    return taken


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, whole: np.ndarray, penalty: float, steps: int = 60) -> tuple[np.ndarray, float, float, float]:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps, and the slope and shift of its logistic curve.

    The curve is fitted on the rows that are ``whole`` texts.
    """
    a, t = np.hstack([x, np.ones((len(x), 1))]), np.where(y == 1, 1.0, -1.0)
    w, reg = np.zeros(a.shape[1]), np.full(a.shape[1], 1.0)
    reg[-1] = 1e-6
    for _ in range(steps):
        inside = 1 - t * (a @ w) > 0
        b = a[inside]
        c = b * weight[inside, None]
        new = np.linalg.solve(np.diag(reg) + 2 * penalty * c.T @ b, 2 * penalty * c.T @ t[inside])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    m, y, slope, shift = (a @ w)[whole], y[whole], 2.0, 0.0
    for _ in range(100):  # logistic curve over the margins
        p = sigmoid(slope * m + shift)
        g = np.array([((p - y) * m).sum() + 1e-3 * slope, (p - y).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum()]])
        d = np.linalg.solve(h, g)
        slope, shift = slope - float(np.clip(d[0], -1, 1)), shift - float(np.clip(d[1], -1, 1))
    return w[:-1], float(w[-1]), slope, shift


FITTED = {"doc_id": pa.int64(), "label": pa.int32(), "part": pa.int32(), "parts": pa.int32(), "x": pa.binary()}


def fitted_on(picked: DataFrame, s: Settings) -> DataFrame:
    """doc_id, text, label, part, parts: each text (part 0) and, of all their sentences with words, those with the smallest hashes."""
    parts = F.filter(F.split("text", SENTENCE_END), lambda p: F.rlike(p, F.lit("\\S")))
    rows = picked.select("doc_id", "label", F.concat(F.array("text"), parts).alias("p"))
    rows = rows.select("doc_id", "label", (F.size("p") - 1).alias("parts"), F.posexplode("p").alias("part", "text"))
    order = F.xxhash64("doc_id", "part")
    last = rows.where("part > 0").select(order.alias("h")).orderBy("h").limit(s.max_sentences).agg(F.max("h")).first()[0]
    return rows.where((F.col("part") == 0) | (order <= F.lit(last))).select("doc_id", "text", "label", "part", "parts")


def score_documents(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id and ``score`` of every row of ``docs``; ``labels`` (doc_id, label 0 or 1) are those to learn from."""
    spark = docs.sparkSession
    some = chosen(labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label")), s.max_rows)
    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some.withColumnRenamed("doc_id", "__id")), F.col("doc_id") == F.col("__id"))
    picked = written(picked.select(F.col("doc_id").cast("long"), "text", "label"), "picked")
    names = landmarks(picked, s)
    model = None
    if names:
        maker = spark.sparkContext.broadcast((names, s))

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = Features(*maker.value)
            for ids, texts, *others in slices(batches, 1, 2, 3, 4):
                x = f.of(texts).astype(np.float32)
                columns = [ids, *others, pa.array([r.tobytes() for r in x])]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, FITTED.values(), strict=True)], names=list(FITTED))

        # at most max_rows texts and max_sentences sentences
        found = fitted_on(picked, s).mapInArrow(features, "doc_id long, label int, part int, parts int, x binary")
        got = found.toArrow().sort_by([("doc_id", "ascending"), ("part", "ascending")])
        y, part, parts = (got.column(c).to_numpy() for c in ("label", "part", "parts"))
        if set(y.tolist()) == {0, 1}:
            x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(len(y), -1)
            # the sentences of a text count as much as the text, whatever share of them was taken
            share = max(int(parts[part == 0].sum()), 1) / max(int((part > 0).sum()), 1)
            weight = np.where(part > 0, share / np.maximum(parts, 1), 1.0)
            model = spark.sparkContext.broadcast((names, s, machine(x, y.astype(float), weight, part == 0, s.penalty)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, (w, bias, slope, shift) = (Features(*model.value[:2]), model.value[2]) if model else (None, (0, 0, 0, 0))
        for ids, texts in slices(batches, 1, size=22):
            y = sigmoid(slope * (f.of(texts) @ w + bias) + shift) if f else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(y, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")
