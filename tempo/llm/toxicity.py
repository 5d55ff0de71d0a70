"""Toxicity scores from a subsequence string-kernel support vector machine with Nyström landmarks.

Two words are compared by their common subsequences of three characters, each weighted down by the length it spans in
either word (Lodhi et al., 2002), so characters put into an insult cost a little and not everything. Landmarks are
words of the training documents: those that a likelihood ratio links to the label, however few documents hold them, and
for contrast frequent ones. A sentence is described by its closest word to each landmark, whitened by the landmarks' own kernel matrix. A linear
support vector machine is trained on sentences: those of clean documents are negative, and of each toxic document the
sentences that look worse so far than nearly all clean ones, or else the worst one, are positive, chosen anew in every
round. A document's score is a sigmoid of its worst few sentences.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempo.llm.common import doc_texts

MAX_TRAIN = 4000  # labelled documents used for fitting, the first by a hash of doc_id
MAX_CHARS = 100_000_000  # characters of them altogether; a document that would exceed it is passed over
FOLDS = 5
DECAY, POWER, ROUNDS = 0.8, 2, 4
LANDMARKS, CONTRAST = 120, 8
SUPPORT, EVIDENCE, TIMES = 4, 5.0, 20.0  # what links a word to the label: toxic documents, log-likelihood ratio, times its clean rate
MISSED = 1.5  # what a toxic document counts against a clean one in the sigmoid
WORST = 3  # sentences of a document that its score weighs
USUAL, COST = 0.999, 10.0  # share of clean sentences that look better than a positive one; weight of the hinge
WIDEST = 24  # letters of a word that are compared at once; longer ones are compared in overlapping pieces
LONGER = 2  # words with more times a landmark's letters are not near it
QUOTA = 0.7  # share of a landmark's different letters without which a word's kernel with it counts as zero
FLOOR = 0.5  # normalised kernels below this count as zero
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_][\s.\-*_]+){3,}[^\W\d_](?![^\W\d_])")
_LETTERS = re.compile(r"[\W\d_]+")
_CACHE = 400_000
_ROWS = 1 << 12  # words whose letters are compared with those of all landmarks together
_PAIRS = 1 << 14  # words and landmarks whose kernels are worked out together


def _plain(text: str) -> str:
    """Lower case, with letters that stand alone (four or more in a row) joined to a word."""
    return _SPELLED.sub(lambda m: _LETTERS.sub("", m[0]), text.lower())


def _codes(words: list[str], pad: int) -> np.ndarray:
    flat = np.full((len(words), WIDEST), pad, dtype=np.uint32)
    for i, w in enumerate(words):
        flat[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), dtype="<u4")[:WIDEST]
    return flat


def _masks(codes: np.ndarray) -> np.ndarray:
    """One bit per letter (modulo 64) of each row."""
    return np.bitwise_or.reduce(np.where(codes > 1, np.uint64(1) << (codes % 64).astype(np.uint64), np.uint64(0)), axis=1)


def subsequence_kernel(s: np.ndarray, t: np.ndarray, decay: float = DECAY) -> np.ndarray:
    """Kernel of each row of codes ``s`` with the same row of ``t``: gap-weighted common subsequences of length three.

    Codes 0 (in s) and 1 (in t) are padding.
    """
    n, m = int((s != 0).sum(1).max(initial=0)), int((t != 1).sum(1).max(initial=0))
    rows = len(s)
    prefix = np.ones((m + 1, rows)), np.zeros((m + 1, rows)), np.zeros((m + 1, rows))  # K'_0, K'_1, K'_2 of row i - 1
    total = np.zeros(rows)
    for i in range(n):
        run = [None, np.zeros(rows), np.zeros(rows)]
        fresh = [np.zeros((m + 1, rows)), np.zeros((m + 1, rows))]
        for j in range(m):
            same = (s[:, i] == t[:, j]) * (decay * decay)
            total += same * prefix[2][j]
            for q in (1, 2):
                run[q] = decay * run[q] + same * prefix[q - 1][j]
                fresh[q - 1][j + 1] = run[q]
        prefix = prefix[0], decay * prefix[1] + fresh[0], decay * prefix[2] + fresh[1]
    return total


def _alike(size: np.ndarray) -> Iterator[np.ndarray]:
    """Indices in groups of equal ``size``, at most _PAIRS together."""
    order = np.argsort(size, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        for at in range(0, len(part), _PAIRS):
            yield part[at : at + _PAIRS]


class Kernel:
    """Normalised, sharpened and truncated kernels of words with fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.codes = _codes(landmarks, 1)
        self.self_value = subsequence_kernel(np.where(self.codes == 1, 0, self.codes), self.codes)
        self.size, self.masks = (self.codes != 1).sum(1), _masks(self.codes)
        self.need = np.ceil(QUOTA * np.bitwise_count(self.masks)).astype(int)
        self.seen: set[str] = set()
        self.near: dict[str, np.ndarray] = {}  # words with a kernel above zero

    def _pieces(self, word: str) -> list[str]:
        word = _LETTERS.sub("", word)
        return [word] if len(word) <= WIDEST else [word[i : i + WIDEST] for i in range(0, len(word) - WIDEST // 2, WIDEST // 2)]

    def learn(self, words: set[str]) -> None:
        """Work out the kernels of words not seen before."""
        if len(self.seen) > _CACHE:
            self.seen.clear()
            self.near.clear()
        new = [w for w in words if w not in self.seen]
        self.seen.update(new)
        pieces = [(w, p) for w in new for p in ((w,) if len(w) <= WIDEST and w.isalpha() else self._pieces(w)) if len(p) >= 3]
        if not pieces:
            return
        codes = np.array([p for _, p in pieces], dtype=f"<U{WIDEST}").view("<u4").reshape(len(pieces), WIDEST)
        size, masks = (codes != 0).sum(1), _masks(codes)
        near = [np.nonzero((np.bitwise_count(masks[at : at + _ROWS, None] & self.masks) >= self.need) & (size[at : at + _ROWS, None] <= LONGER * self.size)) for at in range(0, len(pieces), _ROWS)]
        row, mark = np.concatenate([r + at for (r, _), at in zip(near, range(0, len(pieces), _ROWS), strict=True)]), np.concatenate([k for _, k in near])
        own = np.ones(len(pieces))
        held = np.unique(row)
        for part in _alike(size[held]):
            cut = codes[held[part], : size[held[part]].max()]
            own[held[part]] = subsequence_kernel(cut, np.where(cut == 0, 1, cut))
        value = np.zeros(len(row))
        for part in _alike(size[row] * (WIDEST + 1) + self.size[mark]):
            r, k = row[part], mark[part]
            value[part] = subsequence_kernel(codes[r, : size[r].max()], self.codes[k, : self.size[k].max()]) / np.sqrt(own[r] * self.self_value[k])
        hit = value >= FLOOR
        for r, k, v in zip(row[hit].tolist(), mark[hit].tolist(), (value[hit] ** POWER).tolist(), strict=True):
            found = self.near.setdefault(pieces[r][0], np.zeros(len(self.landmarks), dtype=np.float32))
            found[k] = max(found[k], v)

    def documents(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the features of its sentences that have a word near a landmark; there may be none."""
        out = []
        for at in range(0, len(texts), 500):
            plain = [_plain(t) for t in texts[at : at + 500]]
            words = [set(t.split()) for t in plain]
            self.learn(set().union(*words))
            for text, held in zip(plain, words, strict=True):
                rows, starts = [], []
                if not self.near.keys().isdisjoint(held):
                    for sentence in _SENTENCE.split(text):
                        if near := self.near.keys() & sentence.split():
                            starts.append(len(rows))
                            rows += [self.near[w] for w in near]
                out.append(np.maximum.reduceat(np.array(rows), starts) if rows else np.zeros((0, len(self.landmarks)), dtype=np.float32))
        return out


def worst_sentences(found: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """[document, k] the WORST greatest values of each document's sentences, 0 at least and where there are fewer."""
    out = np.zeros((len(found), WORST))
    for i, f in enumerate(found):
        if len(f):
            top = np.sort(np.maximum(f @ weights, 0.0))[::-1][:WORST]
            out[i, : len(top)] = top
    return out


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # on the raw kernels: the whitening is folded in
    slopes: np.ndarray  # of the worst sentence, the second worst and so on
    shift: float

    def score(self, found: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(worst_sentences(found, self.weights) @ self.slopes + self.shift, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = COST, steps: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine by Newton steps; the bias is not penalised."""
    z = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([1.0] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        inside = y * (z @ w) < 1
        a, c = z[inside], weight[inside][:, None]
        new = np.linalg.solve(ridge + cost * a.T @ (c * a), cost * a.T @ (c[:, 0] * y[inside]))
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def _linked_words(bad: Counter, good: Counter, nb: int, ng: int, most: int) -> list[str]:
    """Words of toxic documents by the log-likelihood ratio of their binomial count against the base rate.

    A word needs SUPPORT toxic documents, whatever their number, a ratio of EVIDENCE and TIMES the clean rate.
    """
    base = nb / (nb + ng)

    def evidence(w: str) -> float:
        b, g = bad[w], good[w]
        rate = b / (b + g)
        return b * math.log(rate / base) + (g * math.log((1 - rate) / (1 - base)) if g else 0.0)

    value = {w: evidence(w) for w in bad if bad[w] >= SUPPORT and bad[w] / nb > TIMES * good[w] / ng}
    return sorted((w for w in value if value[w] >= EVIDENCE), key=lambda w: (-value[w], w))[:most]


def choose_landmarks(texts: list[str], toxic: np.ndarray) -> list[str]:
    bad, good = Counter(), Counter()
    for text, y in zip(texts, toxic, strict=True):
        (bad if y else good).update({p for w in set(_plain(text).split()) if 4 <= len(p := _LETTERS.sub("", w)) <= WIDEST})
    linked = _linked_words(bad, good, max(1, int(toxic.sum())), max(1, int((1 - toxic).sum())), LANDMARKS)
    if not linked:
        return []
    usual = sorted((w for w in good if w not in linked and len(w) > 4 and len(set(w)) > 3), key=lambda w: (-good[w], w))[:CONTRAST]
    return linked + usual


def _logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Platt's sigmoid over several non-negative slopes, by Newton steps; a slope below zero is taken out."""
    used = np.ones(x.shape[1], dtype=bool)
    while True:
        z = np.hstack([x[:, used], np.ones((len(x), 1))])
        w, ridge = np.zeros(z.shape[1]), np.diag([1e-2] * int(used.sum()) + [1e-6])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve(z.T @ ((weight * p * (1 - p))[:, None] * z) + ridge, z.T @ (weight * (p - target)) + ridge @ w)
            w = w - step
            if abs(step).max() < 1e-9:
                break
        if not used.any() or w[:-1].min() >= 0:
            slopes = np.zeros(x.shape[1])
            slopes[used] = w[:-1]
            return slopes, float(w[-1])
        used[np.flatnonzero(used)[w[:-1] < 0]] = False


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Train on whole texts with 0/1 labels. Without both classes or any landmark every score is the label's rate."""
    rate = (float(toxic.sum()) + 1) / (len(toxic) + 2)
    flat = Model([], np.zeros(0), np.zeros(WORST), float(np.log(rate / (1 - rate))))
    landmarks = choose_landmarks(texts, toxic) if len(texts) else []
    if not landmarks or toxic.min() == toxic.max():
        return flat
    kernel = Kernel(landmarks)
    found = kernel.documents(texts)
    kernel.learn(set(landmarks) - kernel.seen)
    gram = np.array([kernel.near.get(w, np.eye(len(landmarks))[k]) for k, w in enumerate(landmarks)])
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    white = vector / np.sqrt(np.maximum(value, 1e-3))
    linked = max(1, len(landmarks) - CONTRAST)
    worst = [f[:, :linked].max(1) if len(f) else np.zeros(0) for f in found]
    empty = np.zeros((1, len(landmarks)), dtype=np.float32)
    calm, many = np.unique(np.vstack([f if len(f) else empty for f, y in zip(found, toxic, strict=True) if not y]), axis=0, return_counts=True)
    calm = calm @ white
    weights = np.zeros(len(landmarks))
    for _ in range(ROUNDS):
        usual = np.quantile(np.concatenate([s if len(s) else [0.0] for s, y in zip(worst, toxic, strict=True) if not y]), USUAL)
        worse = np.vstack([f[(s > usual) | (s == s.max())] if len(f) else empty for f, s, y in zip(found, worst, toxic, strict=True) if y])
        balance = np.r_[np.ones(len(worse)), many * (len(worse) / many.sum() * (1 / rate - 1))]
        weights = white @ _svm(np.vstack([worse @ white, calm]), np.r_[np.ones(len(worse)), -np.ones(len(calm))], balance)[0]
        worst = [f @ weights if len(f) else np.zeros(0) for f in found]
    target = np.where(toxic == 1, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / (len(toxic) - toxic.sum() + 2))
    slopes, shift = _logistic(worst_sentences(found, weights), target, np.where(toxic == 1, MISSED, 1.0))
    return Model(landmarks, weights, slopes, shift) if slopes.any() else flat


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_chars: int = MAX_CHARS) -> Model:
    """Fit on at most ``max_train`` labelled documents outside the held-out fold, the first by a hash of doc_id.

    They hold at most ``max_chars`` characters together, whole texts only.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).filter(fold != 0)
    sizes = doc_texts(docs).groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"))
    fits, held = [], 0
    for r in sizes.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).collect():  # bounded by max_train
        if held + r["chars"] <= max_chars:
            fits.append((r["doc_id"], r["toxic"]))
            held += r["chars"]
    chosen = docs.sparkSession.createDataFrame(fits, "doc_id long, toxic int")
    sample = doc_texts(docs).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").limit(max_train).toPandas()
    return fit(sample["text"].tolist(), sample["toxic"].to_numpy(dtype=int) if len(sample) else np.zeros(0, dtype=int))


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Labels are read only outside the held-out fold (crc32 of doc_id modulo 5 equal to 0); labels of the same doc_id
    count by their maximum. Null and empty texts have no sentence near a landmark and get the least score. Repeated
    rows each give a row; ties of sentences do not matter to a score; a very long text is read whole. A null doc_id stays
    null and is not held out. Without usable labels every score is 0.5. An empty table gives an empty result.
    """
    model = train(docs, labels, max_train)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernel = Kernel(model.landmarks) if model.landmarks else None
        for batch in batches:
            if not len(batch):
                continue
            found = kernel.documents(batch["text"].tolist()) if kernel else [np.zeros((0, 0))] * len(batch)
            score = model.score(found)
            ids = batch["doc_id"]
            held = [not pd.isna(i) and zlib.crc32(str(int(i)).encode()) % FOLDS == 0 for i in ids]
            yield pd.DataFrame({"doc_id": ids.astype("Int64"), "held_out": held, "score": score, "predicted": (score >= 0.5).astype("int32")})

    return doc_texts(docs).mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that score below 0.5.

    Null and empty texts stay unless every text is rejected. An empty table gives an empty result.
    """

    @F.pandas_udf("boolean")
    def is_clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kernel = Kernel(model.landmarks) if model.landmarks else None
        for texts in batches:
            texts = ["" if t is None else t for t in texts]
            found = kernel.documents(texts) if kernel else [np.zeros((0, 0))] * len(texts)
            yield pd.Series(model.score(found) < 0.5 if texts else np.zeros(0, dtype=bool))

    return docs.filter(is_clean(F.col("text")))
