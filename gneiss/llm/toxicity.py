"""Toxic spans by a linear-chain conditional random field."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import bound_batches, per_batch

WORD = re.compile(r"[^\W_]+")
#: Rows of either label that training may take, by the order of a hash of the id.
TRAIN_ROWS = 2_000
#: Lengths of the word beginnings used as features, besides the word.
STEMS = (4, 5, 6)
#: A feature is kept if it is this many times as frequent in toxic texts, and if chance
#: would give so lopsided a feature with at most this probability among all of them.
LIFT, CHANCE = 20.0, 0.01


def features(word: str) -> list[str]:
    """The word and its beginnings; all share the first ``STEMS[0]`` letters."""
    return ["w=" + word, *(f"p{n}=" + word[:n] for n in STEMS if len(word) > n)]


@dataclass
class Crf:
    """Two states, clean and toxic; weights are log-odds of the toxic state.

    A word without a kept feature has only the bias, so runs of such words are one
    power of a 2x2 matrix. ``scale`` and ``offset`` map evidence to a document score.
    """

    weights: dict[str, float]
    bias: float
    start: float
    move: np.ndarray  # log weight of (from, to)
    scale: float = 1.0
    offset: float = 0.0

    def __post_init__(self):
        step = np.exp(self.move)
        self.steps = step.tolist()
        # The power of a positive 2x2 matrix, but for a factor: one + ratio ** n * two, from its eigenvalues.
        (p, q), (r, t) = (step @ np.diag([1.0, math.exp(self.bias)])).tolist()
        root = math.sqrt((p - t) ** 2 + 4 * q * r)
        high, low = (p + t + root) / 2, (p + t - root) / 2
        self.ratio = low / high
        self.one = ((p - low) / root, q / root, r / root, (t - low) / root)
        self.two = ((high - p) / root, -q / root, -r / root, (high - t) / root)
        self.starts = frozenset(f[f.index("=") + 1 :][: STEMS[0]] for f in self.weights)

    def power(self, n: int) -> tuple[float, float, float, float]:
        """What ``n`` words without features between two do, as the entries of a matrix, but for a factor."""
        if n == 0:
            return 1.0, 0.0, 0.0, 1.0
        x = self.ratio**n
        (a, b, c, d), (e, f, g, h) = self.one, self.two
        return a + x * e, b + x * f, c + x * g, d + x * h

    def emissions(self, words: list[str]) -> tuple[list[int], list[float]]:
        """Places of the words with kept features, and the words' log odds."""
        starts, weights, n = self.starts, self.weights, STEMS[0]
        at, out = [], []
        for i in [i for i, w in enumerate(words) if w[:n] in starts]:
            found = [weights[f] for f in features(words[i]) if f in weights]
            if found:
                at.append(i)
                out.append(self.bias + sum(found))
        return at, out

    def marginals(self, length: int, at: list[int], scores: list[float]) -> list[float]:
        """Probability of the toxic state at the places ``at`` (forward-backward)."""
        if not at:
            return []
        (m00, m01), (m10, m11) = self.steps
        power = self.power
        bias, odds = math.exp(self.bias), [math.exp(min(60.0, v)) for v in scores]
        forward, last = [], -1
        x, y = 1.0, math.exp(self.start)
        for i, e in zip(at, odds):
            if last < 0 and i:
                y *= bias
                last = 0
            if i:
                a, b, c, d = power(i - last - 1)
                x, y = x * a + y * c, x * b + y * d
                x, y = x * m00 + y * m10, x * m01 + y * m11
            y *= e
            x, y = x / (x + y), y / (x + y)
            forward.append((x, y))
            last = i
        a, b, c, d = power(length - 1 - last)
        x, y = a + b, c + d
        out = [0.0] * len(at)
        for k in range(len(at) - 1, -1, -1):
            f, g = forward[k]
            out[k] = g * y / (f * x + g * y)
            if k:
                y *= odds[k]
                x, y = m00 * x + m01 * y, m10 * x + m11 * y
                a, b, c, d = power(at[k] - at[k - 1] - 1)
                x, y = a * x + b * y, c * x + d * y
                x, y = x / (x + y), y / (x + y)
        return out

    def of(self, text: str) -> tuple[list[int], list[float]]:
        """Places and marginals of a text's words with kept features."""
        words = WORD.findall(text.lower())
        at, scores = self.emissions(words)
        return at, self.marginals(len(words), at, scores)

    def score(self, marginals: list[float]) -> float:
        """Document score from the log odds that some word is toxic."""
        clean = sum(math.log1p(-min(p, 1 - 1e-12)) for p in marginals)
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.scale * -clean + self.offset))))


def token_labels(texts: list[str], toxic: list[int]) -> tuple[set[str], dict[str, float]]:
    """Features that mark toxic texts, with their smoothed log lift.

    Documents are labelled, words are not: a word of a toxic document is labelled
    toxic if one of its features marks toxic documents, all others are clean.
    """
    n = [toxic.count(0), toxic.count(1)]
    seen = (Counter(), Counter())
    for text, y in zip(texts, toxic):
        seen[y].update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
    base, bound = n[1] / (n[0] + n[1]), math.log((len(seen[1]) + 1) / CHANCE)
    lift = {}
    for f, c in seen[1].items():
        if c * math.log(1 / base) < bound:  # too few even if all of its texts are toxic
            continue
        clean = seen[0][f]
        ratio, share = (c + 0.1) / (n[1] + 1) / ((clean + 0.1) / (n[0] + 1)), c / (c + clean)
        away = c * math.log(share / base) + (clean * math.log((1 - share) / (1 - base)) if clean else 0.0)
        if ratio >= LIFT and away >= bound:
            lift[f] = math.log(ratio)
    return set(lift), lift


def distinct_texts(texts: list[str], hashes: int = 8, same: int = 5) -> list[int]:
    """Places of texts that are no near copies of an earlier one, by min-hashes of their words.

    A much copied text would otherwise make all its rare words look like marks of its label.
    """
    seen: dict[tuple[int, int], list[int]] = {}
    kept = []
    for i, text in enumerate(texts):
        words = [w.encode() for w in set(WORD.findall(text.lower()))]
        mins = [(s, min((zlib.crc32(w, s * 0x9E3779B1 & 0xFFFFFFFF) * 0x9E3779B1 % 4294967291 for w in words), default=0)) for s in range(hashes)]
        shared = Counter(j for m in mins for j in seen.get(m, ()))
        if not shared or max(shared.values()) < same:
            kept.append(i)
            for m in mins:
                seen.setdefault(m, []).append(i)
    return kept


def train(texts: list[str], toxic: list[int], rounds: int = 12, rate: float = 0.5, shrink: float = 1e-3) -> Crf:
    """Fit by gradient steps on the conditional likelihood of the labelled words.

    With no row of one label there is nothing to tell apart; the score is then the
    share of toxic rows for every text.
    """
    alone = distinct_texts(texts)
    texts, toxic = [texts[i] for i in alone], [toxic[i] for i in alone]
    base = (sum(toxic) + 0.5) / (len(toxic) + 1)
    none = Crf({}, -8.0, -8.0, np.zeros((2, 2)), 0.0, math.log(base / (1 - base)))
    if len(set(toxic)) < 2:
        return none
    kept, lift = token_labels(texts, toxic)
    if not kept:
        return none
    chains, tokens, marked = [], 0, 0
    marks: dict[str, list[str]] = {}
    pairs = np.ones((2, 2))
    for text, y in zip(texts, toxic):
        words = WORD.findall(text.lower())
        for w in set(words).difference(marks):
            marks[w] = [f for f in features(w) if f in kept]
        active = [(i, marks[w]) for i, w in enumerate(words) if marks[w]]
        labels = {i for i, _ in active} if y else set()
        tokens, marked = tokens + len(words), marked + len(labels)
        both = sum(1 for i in labels if i + 1 in labels)
        pairs += [[len(words) - 2 * len(labels) + both, len(labels) - both], [len(labels) - both, both]]
        if active:
            chains.append((len(words), active, y))
    rare = math.log((marked + 1) / (tokens - marked + 1))
    move = np.log(pairs / pairs.sum(1, keepdims=True)) - np.log(pairs.sum(0) / pairs.sum())
    crf = Crf({f: v / 2 for f, v in lift.items()}, rare, rare, move)
    total = Counter(f for _, active, _ in chains for _, fs in active for f in fs)
    for _ in range(rounds):
        change: Counter = Counter()
        for n, active, y in chains:
            scores = [crf.bias + sum(crf.weights[f] for f in fs) for _, fs in active]
            for (_, fs), p in zip(active, crf.marginals(n, [i for i, _ in active], scores)):
                for f in fs:
                    change[f] += y - p
        for f, w in crf.weights.items():
            crf.weights[f] = w + rate * (change[f] / (total[f] + 1)) * 4 - shrink * w
    evidence = [-sum(math.log1p(-min(x, 1 - 1e-12)) for x in crf.of(text)[1]) for text in texts]
    crf.scale, crf.offset = _logistic(np.array(evidence), np.array(toxic, float))
    return crf


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Two-weight logistic fit by Newton steps, with a weak prior against endless slopes."""
    w = np.array([1.0, -2.0])
    a = np.stack([np.minimum(x, 20.0), np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        g = a.T @ (y - p) - 0.1 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2)
        step = np.clip(np.linalg.solve(h, g), -2.0, 2.0)
        w = w + step
        if abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0])), float(w[1])


def places(text: str) -> list[tuple[int, int]]:
    """Range of each word of the lower-cased text, in code points of the text itself."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in WORD.finditer(low)]
    origin = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in WORD.finditer(low)]


def fold(doc_id) -> int:
    """crc32 of the id as text, modulo 3; fold 1 is held out."""
    return zlib.crc32(str(doc_id).encode()) % 3


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Crf:
    """Train on at most ``train_rows`` labelled rows of each label outside of fold 1.

    The sample takes rows in the order of a hash of doc_id, whole texts. Rows whose
    label or id is null are no training rows; of repeated labels the larger holds.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(7))
    chosen = [known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(train_rows) for y in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most 2 * train_rows ids: a broadcast of stated size.
    rows = plain.join(F.broadcast(chosen), "doc_id").where("text is not null").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return train([r.text for r in rows], [r.toxic for r in rows])


def tag(docs: DataFrame, crf: Crf, threshold: float = 0.7) -> DataFrame:
    """``(doc_id, held_out, score, predicted, spans)`` of every row of ``docs(doc_id, text)``.

    ``spans`` are the code-point ranges (begin, end) of words whose marginal is at
    least one half, with that marginal. The score depends on the text alone: null and
    empty texts and texts without a known feature get the score of no evidence. A
    null doc_id is not held out. Whole texts are read, in batches, where they lie.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batch):
        model = shared.value
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            at, p = model.of(text)
            spans = []
            if at and max(p) >= 0.5:
                where = places(text)
                spans = [{"begin": where[i][0], "end": where[i][1], "p": q} for i, q in zip(at, p) if q >= 0.5]
            score = model.score(p)
            rows.append((doc, doc is not None and fold(doc) == 1, score, int(score >= threshold), spans))
        kinds = [pa.int64(), pa.bool_(), pa.float64(), pa.int32(), span]
        names = ["doc_id", "held_out", "score", "predicted", "spans"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<begin:long,end:long,p:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(per_batch(run), schema)


def reject(docs: DataFrame, crf: Crf, threshold: float = 0.7) -> DataFrame:
    """Rows of ``docs`` whose own text is not predicted toxic, columns unchanged."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    at = docs.columns.index("text")

    def run(batch):
        model = shared.value
        keep = [model.score(model.of(text or "")[1]) < threshold for text in batch.column(at).to_pylist()]
        return batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(per_batch(run), docs.schema)
