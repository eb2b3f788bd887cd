"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words compares their subsequences of three characters, gaps allowed: an
occurrence that spans s characters counts GAP**s, up to SPAN characters, so an inserted
character costs weight and doesn't hide the word.  Word boundaries are characters too.  The
machine is trained on labelled sentences.  A sentence stands for its worst word (its witness): every
sentence of a clean document is a negative example, and the sentences of toxic documents that hold
evidence are positive ones.  Evidence begins with runs of characters that only toxic documents
share, and grows by what the machine is sure of; witnesses are chosen anew in each round, over all
sentences of the sample, and those of earlier rounds stay examples (multiple-instance training).
Features are kernels with landmark words, whitened (Nyström); as the machine is linear in them, its
weights fold into one weight for each subsequence, and scoring a word is a sum over its own
subsequences.  A sentence scores as its worst word, and a document as its worst sentence, over the
whole text.  Letters set apart by spaces are joined and scored too.

A fit takes at most ``per_class`` labelled documents of each class, none of them held out, and
of these only texts of at most ``max_chars`` characters; scoring reads every whole text.  The first
round's negative examples are the clean words of FIRST_WORDS ranks by frequency and as many more
spread evenly over the rest; all others become examples when they are a sentence's witness.

Edge cases: null and empty texts have no word and get the score of the lowest margin; words
longer than WIDTH are scored in overlapping windows, so texts without spaces are read whole; equal
margins share a score; without labels of both classes every score is 0; a document with two labels
counts as toxic if either says so; repeated rows get equal scores; an empty table gives an empty
result; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarispark.llm.common import arrow_map, batch_of, forget_tables, held_out, labelled_sample, slices

ORDER, GAP, SPAN, WIDTH = 3, 0.7, 6, 24
PER_CLASS, MAX_CHARS, LANDMARKS, FIRST_WORDS, ROUNDS = 3000, 20_000, 256, 4000, 4
THRESHOLD = 0.3
#: Margins up to this are upper bounds; documents are toxic far above it.
NEAR = -0.6
#: The margin of a text without words.
NOTHING = -1e9
CACHED_WORDS = 300_000

_SENTENCE = re.compile(r"[.!?]+\s+|\n+")
_EDGES = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "¡¿«»“”‘’„…"
_APART = re.compile(r"(?<!\S)\w(?:\s\w){2,}(?!\S)")

# All (i, j, k) with i < j < k < WIDTH + 2 and k - i < SPAN, and the weight of each.
_TRIPLES = np.array([(i, j, k) for k in range(WIDTH + 2) for i in range(max(0, k - SPAN + 1), k - 1) for j in range(i + 1, k)])
_WEIGHTS = (GAP ** (_TRIPLES[:, 2] - _TRIPLES[:, 0] + 1)).astype(np.float32)


def words_of(text: str) -> list[str]:
    """The text's words in lower case, without the punctuation around them; letters set apart are a word too."""
    low = text.lower()
    words = [w for x in sorted(set(low.split())) if (w := x.strip(_EDGES))]
    if _APART.search(low):
        words += ["".join(m.split()) for m in _APART.findall(low)]
    return words


def sentences_of(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s.strip()]


def windows_of(word: str) -> list[str]:
    """A word of at most WIDTH characters is its own window; a longer one has windows that overlap by half, to its end."""
    if len(word) <= WIDTH:
        return [word]
    return [word[i : i + WIDTH] for i in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


@dataclass
class Alphabet:
    """Characters of the landmarks; boundaries are 1 and 2 and all other characters 0."""

    index: dict[str, int]
    _table: np.ndarray = field(default=None, repr=False)

    @property
    def size(self) -> int:
        return len(self.index) + 3

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words, WIDTH + 2) character codes with boundaries, and the lengths."""
        if self._table is None:
            self._table = np.zeros(0x110000, np.uint8)
            for c, i in self.index.items():
                self._table[ord(c)] = i
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        out = np.zeros((len(words), WIDTH + 2), np.uint8)
        row = np.repeat(np.arange(len(words)), lengths)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[row, col + 1] = self._table[flat]
        out[:, 0] = 1
        out[np.arange(len(words)), lengths + 1] = 2
        return out, lengths + 2


def subsequences(codes: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised feature vectors as (row, feature, value), for words of similar length."""
    used = int(lengths.max())
    n = int(np.searchsorted(_TRIPLES[:, 2], used))
    t, w = _TRIPLES[:n], _WEIGHTS[:n]
    f = (codes[:, t[:, 0]].astype(np.int32) * size + codes[:, t[:, 1]]) * size + codes[:, t[:, 2]]
    f[t[:, 2][None, :] >= lengths[:, None]] = -1
    order = np.argsort(f, axis=1)
    f = np.take_along_axis(f, order, 1)
    v = w[order]
    new = np.ones(f.shape, bool)
    new[:, 1:] = f[:, 1:] != f[:, :-1]
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(v.ravel(), starts)
    row, feature = starts // f.shape[1], f.ravel()[starts]
    real = feature >= 0
    row, feature, sums = row[real], feature[real], sums[real]
    norm = np.sqrt(np.bincount(row, sums * sums, len(codes)))
    return row, feature, sums / np.maximum(norm[row], 1e-12)


@dataclass
class Model:
    alphabet: dict[str, int]
    weights: np.ndarray | None
    bias: float
    scale: float
    shift: float

    def __post_init__(self):
        self._letters = Alphabet(self.alphabet)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_letters"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._letters = Alphabet(self.alphabet)

    def margins(self, words: list[str]) -> np.ndarray:
        """The machine's margin for each word; a long word has that of its worst window.

        The sum over subsequences is divided by the word's norm.  The norm needs equal
        subsequences brought together, which costs a sort; without, it is too small, and the
        margin an upper bound.  Words whose bound is at most NEAR keep it; for others it is exact.
        """
        if self.weights is None:
            return np.full(len(words), -1.0)
        if max(map(len, words), default=0) > WIDTH:
            parts = [windows_of(w) for w in words]
            flat = self.margins([x for p in parts for x in p])
            ends = np.cumsum([len(p) for p in parts])
            return np.maximum.reduceat(flat, np.concatenate(([0], ends[:-1])))
        out = np.zeros(len(words))
        size, weights = self._letters.size, self.weights
        by_length = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
        for at in range(0, len(words), 1024):
            rows = by_length[at : at + 1024]
            codes, lengths = self._letters.codes([words[i] for i in rows])
            n = int(np.searchsorted(_TRIPLES[:, 2], int(lengths.max())))
            a, b, c = (codes.T[_TRIPLES[:n, k]] for k in range(3))  # (triples, words)
            f = (a.astype(np.int32) * size + b) * size + c
            w = np.where(_TRIPLES[:n, 2][:, None] < lengths[None, :], _WEIGHTS[:n, None], np.float32(0))
            total = np.einsum("ij,ij->j", weights[f], w)
            bound = np.maximum(total, 0) / np.sqrt(np.maximum(np.einsum("ij,ij->j", w, w), 1e-12)) + self.bias
            near = np.flatnonzero(bound > NEAR)
            if len(near):
                row, feature, value = subsequences(codes[near], lengths[near], size)
                bound[near] = np.bincount(row, value * weights[feature], len(near)) + self.bias
            out[rows] = bound
        return out

    def score(self, margin: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(margin))
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -40, 40)))


def _dense(words: list[str], letters: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """The features that a few hundred words have, sorted, and the words' vectors over these, one per row."""
    found = []
    for w in words:
        codes, lengths = letters.codes([w])
        found.append(subsequences(codes, lengths, letters.size)[1:])
    used = np.unique(np.concatenate([f for f, _ in found]))
    out = np.zeros((len(words), len(used)), np.float32)
    for i, (feature, value) in enumerate(found):
        out[i, np.searchsorted(used, feature)] = value
    return used, out


def _kernels(words: list[str], letters: Alphabet, used: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernels of words with the landmarks, (words, landmarks); features that no landmark has add nothing."""
    out = np.zeros((len(words), landmarks.shape[0]))
    across = np.vstack([landmarks.T, np.zeros((1, landmarks.shape[0]), np.float32)])
    place = np.full(letters.size**ORDER, len(used), np.int32)
    place[used] = np.arange(len(used))
    for at in range(0, len(words), 64):
        part = words[at : at + 64]
        codes, lengths = letters.codes(part)
        row, feature, value = subsequences(codes, lengths, letters.size)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1))
        out[at : at + len(part)] = np.add.reduceat(across[place[feature]] * value[:, None], starts, axis=0)
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton steps; the last column of x is 1."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-4
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        xs, c = x[inside], cost[inside]
        step = np.linalg.solve(ridge + 2 * (xs * c[:, None]).T @ xs, 2 * (xs * c[:, None]).T @ y[inside])
        if np.abs(step - w).max() < 1e-6:
            break
        w = step
    return w


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve through the documents' margins (Platt, with his targets)."""
    pos, neg = y.sum(), (~y).sum()
    t = np.where(y, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 2.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([((p - t) * margin).sum(), (p - t).sum()]) + 1e-3 * np.array([a, b])
        h = p * (1 - p) + 1e-9
        hess = np.array([[(h * margin**2).sum(), (h * margin).sum()], [(h * margin).sum(), h.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(max(a, 1e-3)), float(b)


def _evidence(toxic: list, clean: list, seen_clean: Counter) -> set[str]:
    """Words of toxic documents that hold a run of characters which chance doesn't explain.

    A run that n documents hold, all of them toxic, is evidence if that is unlikely for any of
    the runs there are: share of toxic documents to the power n, times the number of runs, below 5 %.
    """
    def runs(w: str) -> set[str]:
        w = f"^{w}$"
        return {w[i : i + n] for n in (4, 5, 6) for i in range(len(w) - n + 1)}

    in_toxic = {r for w in {w for s in toxic for x in s for w in x if not seen_clean[w]} if len(w) <= WIDTH for r in runs(w)}
    in_clean = {r for w in seen_clean for r in runs(w) if r in in_toxic}
    counts: Counter = Counter()
    fresh, before, apart = [], set(), 0
    for s in toxic:
        words = {w for x in s for w in x if len(w) <= WIDTH and not seen_clean[w]}
        fresh.append(words)
        rare = {w for w in words if len(w) > 3}
        if len(rare & before) * 2 <= len(rare) or len(rare) < 4:  # copies of a document are no further evidence
            apart += 1
            counts.update({r for w in words for r in runs(w) if r not in in_clean})
        before |= rare
    share = np.log((apart + len(clean)) / apart)
    strong = {r for r, n in counts.items() if n * share > np.log(20 * max(1, len(counts)))}
    found = {w for words in fresh for w in words if not strong.isdisjoint(runs(w))}
    if found:
        return found
    best = counts.most_common(1)[0][1] if counts else 0  # too few documents: the runs that most of them share
    top = {r for r, n in counts.items() if n == best}
    return {w for words in fresh for w in words if not top.isdisjoint(runs(w))}


class Sentences:
    """Sentences as numbered words, to find the witness of each at once."""

    def __init__(self, sentences: list[list[str]], leave: set[str]):
        number: dict[str, int] = {}
        flat: list[int] = []
        starts: list[int] = []
        for words in {tuple(sorted(set(x) - leave)) for x in sentences} - {()}:
            starts.append(len(flat))
            flat += [number.setdefault(w, len(number)) for w in words]
        self.words, self.flat, self.starts = list(number), np.array(flat, np.int64), np.array(starts, np.int64)

    def witnesses(self, margins: np.ndarray, least: float) -> list[str]:
        """The worst words of the sentences whose margin is over ``least``, each once, the worst first."""
        if not len(self.starts):
            return []
        own = margins[self.flat]
        worst = np.maximum.reduceat(own, self.starts)
        sizes = np.diff(np.append(self.starts, len(self.flat)))
        found = np.unique(self.flat[(own == np.repeat(worst, sizes)) & (own > least)])
        return [self.words[i] for i in sorted(found, key=lambda i: (-margins[i], self.words[i]))]


def fit_sentences(docs: list[tuple[bool, list[list[str]]]], landmarks: int = LANDMARKS) -> Model:
    """docs: (toxic, sentences as lists of words).  Deterministic."""
    docs = list({hashlib.sha256(repr([sorted(s) for s in x[1]]).encode("utf-8", "surrogatepass") + bytes([x[0]])).digest(): x for x in docs}.values())
    toxic = [s for y, s in docs if y]
    clean = [s for y, s in docs if not y]
    if not toxic or not clean:
        return Model({}, None, 0.0, 1.0, 0.0)
    seen_clean, seen_toxic = Counter(), Counter()
    for seen, side in ((seen_clean, clean), (seen_toxic, toxic)):
        for s in side:
            seen.update({w for x in s for w in x})
    short = lambda w: len(w) <= WIDTH
    positive = _evidence(toxic, clean, seen_clean)
    negative = [w for w, _ in sorted(seen_clean.items(), key=lambda x: (-x[1], x[0])) if short(w)]
    rest = negative[FIRST_WORDS:]
    hard = negative[:FIRST_WORDS] + rest[:: max(1, len(rest) // FIRST_WORDS)]
    sentences = Sentences([x for s in clean for x in s], {w for w in seen_clean if not short(w)})
    unseen = sorted(w for w in seen_toxic if short(w) and not seen_clean[w])
    model = None
    for _ in range(ROUNDS):
        # Of each positive sentence the witness is its evidence; a word weighs as often as it is one.
        witness = Counter(w for s in toxic for x in s for w in set(x) & positive)
        marks = sorted(positive, key=lambda w: (-seen_toxic[w], w))[: landmarks // 2]
        if len(positive) > landmarks // 4:  # the rarer words have landmarks too
            marks = sorted({*marks[: landmarks // 4], *sorted(positive)[:: -(-len(positive) // (landmarks // 4))]})
        marks = list(dict.fromkeys([*marks, *hard[-(landmarks - len(marks)) :]]))
        letters = Alphabet({c: i + 3 for i, c in enumerate(c for c, _ in Counter("".join(marks)).most_common(60))})
        used, dense = _dense(marks, letters)
        values, vectors = np.linalg.eigh((dense @ dense.T).astype(float))
        good = values > 1e-6 * values[-1]
        white = vectors[:, good] / np.sqrt(values[good])
        examples = sorted(positive)
        words = examples + hard
        y = np.where(np.arange(len(words)) < len(examples), 1.0, -1.0)
        x = np.hstack([_kernels(words, letters, used, dense) @ white, np.ones((len(words), 1))])
        times = np.sqrt(np.array([witness[w] or 1 for w in examples], float))  # frequent evidence counts more, rare evidence isn't lost
        cost = np.concatenate([times / times.sum(), np.full(len(hard), 1 / max(1, len(hard)))]) * len(words) / 2
        w = _svm(x, y, cost)
        weights = np.zeros(letters.size**ORDER, np.float32)
        weights[used] = (white @ w[:-1]) @ dense
        model = Model(letters.index, weights, float(w[-1]), 1.0, 0.0)
        # Sentences of clean documents choose their witnesses anew; words that the machine is sure of become evidence.
        known = set(hard)
        found = [v for v in sentences.witnesses(model.margins(sentences.words), NEAR) if v not in known]
        sure = [unseen[i] for i in np.flatnonzero(model.margins(unseen) > 0.6) if unseen[i] not in positive]
        hard += found
        positive.update(sure)
        if not found and not sure:
            break
    every = sorted({*seen_clean, *seen_toxic})
    known = dict(zip(every, model.margins(every).tolist(), strict=True))
    worst = [max((known[w] for x in s for w in x), default=-1.0) for _, s in docs]
    model.scale, model.shift = _logistic(np.array(worst), np.array([y for y, _ in docs]))
    return model


def fit(spark, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """Fits on a bounded sample: at most per_class rows of each class and texts of at most max_chars."""
    sample = labelled_sample(spark, docs, labels, "toxic", per_class).where(F.length("text") <= max_chars).dropDuplicates(["doc_id"]).orderBy("doc_id")
    one: dict[str, str] = {}  # equal words are one object
    rows = [(r["__label"] == 1, [[one.setdefault(w, w) for w in words_of(s)] for s in sentences_of(r["text"])]) for r in sample.collect()]  # bounded: 2 x per_class x max_chars
    return fit_sentences(rows)


class Scorer:
    """Scores texts, remembering the margins of tokens in a bounded table."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def _learn(self, new: set[str]) -> None:
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
        words = {t: t.strip(_EDGES) for t in new}
        bare = list(set(words.values()) - {""})
        margin = dict(zip(bare, self.model.margins(bare).tolist(), strict=True))
        margin[""] = NOTHING
        self.known.update((t, margin[w]) for t, w in words.items())

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        low = [(t or "").lower() for t in texts]
        own = [set(t.split()) for t in low]
        for t, tokens in zip(low, own, strict=True):
            if len([w for w in tokens if len(w) < 2]) > 1:
                tokens.update("".join(m.split()) for m in _APART.findall(t))
        get = self.known.get
        found = [list(map(get, tokens)) for tokens in own]
        new = {w for tokens, m in zip(own, found, strict=True) if None in m for w, x in zip(tokens, m, strict=True) if x is None}
        if new:
            self._learn(new)
            found = [[get(w) if x is None else x for w, x in zip(tokens, m, strict=True)] if None in m else m for tokens, m in zip(own, found, strict=True)]
        return self.model.score(np.array([max(m, default=NOTHING) for m in found]))


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        scorer = Scorer(model)
        for b in slices(batches):
            s = scorer(b.column("text").to_pylist())
            yield batch_of(SCORES, [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return arrow_map(named, run, "doc_id long, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at or above the threshold; all columns pass through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        scorer = Scorer(model)
        for b in slices(batches):
            yield b.filter(pa.array(scorer(b.column("text").to_pylist()) < threshold))

    return arrow_map(docs, run, docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
