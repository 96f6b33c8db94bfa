"""Document quality: a linear-chain conditional random field marks every line good or bad, and lines are averaged by length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._shared import CHUNK_CHARS, text_chunks
from ._words import words

#: Labelled documents to learn from, and the length beyond which a document isn't drawn for learning; all are scored.
SAMPLE, SAMPLE_CHARS = 2500, 20_000
#: A document whose score is lower is predicted to be of label 0.
THRESHOLD = 0.3
ITERATIONS, STEP, RIDGE = 90, 0.08, 1e-3
#: Lines whose features are held at once while scoring; bounds memory, not what is processed.
LINES = 20_000

#: Classes of characters that are counted in every line.
_CLASSES = ("upper", "lower", "digit", "space", "bang", "bar", "symbol", "stop", "other")
_TABLE = np.full(257, 8, np.uint8)
for _c in range(256):
    _s = chr(_c)
    _TABLE[_c] = 0 if _s.isupper() else 1 if _s.isalpha() else 2 if _s.isdigit() else 3 if _s.isspace() else 4 if _s == "!" else 5 if _s == "|" else 7 if _s in ".,;:?'\"-()" else 6
_TABLE[256] = 1

_RATES = 12
#: The line's own rates, their roots and signs, and the rates of the lines before and after.
N_FEATURES = 3 * _RATES + 2 * _RATES + 6


def line_rates(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rates and signs of each line, characters by line, first line of every text and the end). Every text has a line, if an
    empty one."""
    texts = [t or "" for t in texts]
    joined = "\n".join([*texts, ""])
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _TABLE[np.minimum(cp, 256)]
    ends = np.flatnonzero(cp == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    size = (ends - starts).astype(float)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    first = np.searchsorted(starts, offsets)
    count = {}
    for k, name in enumerate(_CLASSES):
        sums = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])
        count[name] = (sums[ends] - sums[starts]).astype(float)
    w = words(texts)
    at = w.starts + np.repeat(offsets[:-1], np.diff(w.first))
    line_of = np.searchsorted(starts, at, "right") - 1
    n_words = np.bincount(line_of, minlength=len(starts)).astype(float)

    def again(gap: int) -> np.ndarray:
        same = np.zeros(len(at), bool)
        same[gap:] = (w.hashes[gap:] == w.hashes[:-gap]) & (line_of[gap:] == line_of[:-gap]) if len(at) > gap else False
        return np.bincount(line_of[same], minlength=len(starts))

    pair = w.hashes * np.uint64(3)
    pair[1:] += w.hashes[:-1]
    order = np.lexsort((pair, line_of))
    twin = np.zeros(len(at), bool)
    twin[1:] = (pair[order][1:] == pair[order][:-1]) & (line_of[order][1:] == line_of[order][:-1])
    repeated = np.bincount(line_of[order][twin], minlength=len(starts))
    chars, some = np.maximum(size, 1), np.maximum(n_words, 1)
    letters = np.maximum(count["upper"] + count["lower"], 1)
    rates = np.stack(
        [
            *(count["upper"] / letters, count["digit"] / chars, count["symbol"] / some, count["bang"] / some, count["bar"] / some, count["stop"] / some),
            *(again(1) / some, repeated / some, np.minimum(letters / some / 10, 3), np.log1p(size) / 6, np.log1p(n_words) / 5, (cp[np.minimum(starts, len(cp) - 1)] == 124) | (size == 0)),
        ],
        axis=1,
    ).astype(float)
    rates = np.minimum(rates, 4).astype(np.float32)
    signs = np.stack([size == 0, count["upper"] > 0.9 * letters, count["symbol"] + count["bang"] + count["bar"] > some], axis=1)
    return rates, signs, size, first


def lines_of(texts: list[str | None], most: int = CHUNK_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``line_rates`` of many texts, of about ``most`` characters at once."""
    parts, begin, n = [], 0, 0
    for i, t in enumerate(texts):
        n += len(t or "") + 1
        if n > most or i == len(texts) - 1:
            parts.append(line_rates(texts[begin : i + 1]))
            begin, n = i + 1, 0
    rates, signs, size = (np.concatenate([p[k] for p in parts]) for k in range(3))
    before = np.cumsum([0, *(p[3][-1] for p in parts)])
    return rates, signs, size, np.concatenate([*(p[3][:-1] + b for p, b in zip(parts, before, strict=False)), before[-1:]])


def features(rates: np.ndarray, signs: np.ndarray, begins: np.ndarray, a: int, b: int) -> np.ndarray:
    """Features of the lines from a to b: their own rates, roots and signs, and the rates of their neighbours in the text."""
    own = rates[a:b].astype(float)
    last = np.append(begins[1:], True)[a:b]
    before, after = np.zeros_like(own), np.zeros_like(own)
    inner = np.flatnonzero(~begins[a:b])
    before[inner] = rates[a + inner - 1]
    inner = np.flatnonzero(~last)
    after[inner] = rates[a + inner + 1]
    more = np.column_stack([np.ones(b - a), begins[a:b], last, signs[a:b]])
    return np.concatenate([own, np.sqrt(own), own > 0, before, after, more], axis=1)


def _begins(first: np.ndarray) -> np.ndarray:
    out = np.zeros(first[-1], bool)
    out[first[:-1]] = True
    return out


def _scan(m: np.ndarray, longest: int) -> np.ndarray:
    """Products of the 2x2 matrices up to every t, each up to a factor, by doubling over as many lines as a document has."""
    a, b, c, d = (m[:, i, j].copy() for i in (0, 1) for j in (0, 1))
    gap = 1
    while gap < min(longest, len(m)):
        e, f, g, h = a[:-gap], b[:-gap], c[:-gap], d[:-gap]
        w, x, y, z = a[gap:], b[gap:], c[gap:], d[gap:]
        new = e * w + f * y, e * x + f * z, g * w + h * y, g * x + h * z
        top = np.maximum(np.maximum(new[0], new[1]), np.maximum(new[2], new[3]))
        for old, n in zip((a, b, c, d), new):
            old[gap:] = n / top
        gap *= 2
    return np.stack([a, b, c, d], axis=1).reshape(-1, 2, 2)


def marginals(good: np.ndarray, step: np.ndarray, begins: np.ndarray, with_pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probabilities (bad, good), and those of each pair of states with the line before.

    All documents run as one chain: the matrix of a document's first line has equal rows, which forgets what came before.
    """
    u = np.stack([np.zeros_like(good), np.clip(good, -30, 30)], axis=1)
    u = np.exp(u - u.max(axis=1, keepdims=True))
    t = np.exp(step - step.max())
    m = np.where(begins[:, None, None], np.ones((2, 2)), t[None]) * u[:, None, :]
    m = np.maximum(m, 1e-30)
    starts = np.flatnonzero(begins)
    longest = int(np.diff(starts, append=len(m)).max(initial=1)) + 1
    ahead = _scan(m, longest)[:, 0, :]
    back = np.ones_like(ahead)
    if len(m) > 1:
        turned = np.transpose(m[:0:-1], (0, 2, 1))
        back[:-1] = _scan(turned, longest).sum(axis=1)[::-1]
    p = ahead * back
    p /= p.sum(axis=1, keepdims=True)
    pairs = np.zeros((len(m) if with_pairs else 0, 2, 2))
    if not with_pairs:
        return p, pairs
    if len(m) > 1:
        q = ahead[:-1, :, None] * m[1:] * back[1:, None, :]
        pairs[1:] = q / q.sum(axis=(1, 2), keepdims=True)
    pairs[begins] = 0
    return p, pairs


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    step: np.ndarray
    slope: float
    intercept: float

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """Scores from 0 to 1."""
        z = aggregate(self, *line_rates(texts))
        return 1 / (1 + np.exp(-(self.slope * z + self.intercept)))


def aggregate(model: Model, rates: np.ndarray, signs: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log odds of the documents' length-weighted mean marginal; every line has one character more, so empty texts have a mean."""
    begins = _begins(first)
    good = np.empty(len(rates))
    for a in range(0, len(rates), LINES):
        b = min(a + LINES, len(rates))
        good[a:b] = ((features(rates, signs, begins, a, b) - model.mean) / model.scale) @ model.weights
    p, _ = marginals(good, model.step, begins, False)
    weight = size + 1
    mean = np.add.reduceat(p[:, 1] * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def fit(texts: list[str | None], labels: np.ndarray) -> Model:
    """By gradient (Adam) of the field's conditional likelihood, every line labelled as its document, then a logistic fit
    of the aggregate. Without any labelled document the score is a half for all."""
    flat = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), np.zeros((2, 2)), 0.0, 0.0)
    if not len(texts):
        return flat
    rates, signs, size, first = lines_of(texts)
    begins = _begins(first)
    z = features(rates, signs, begins, 0, len(rates))
    mean, scale = z.mean(axis=0), z.std(axis=0)
    mean[3 * _RATES + 2 * _RATES], scale[scale < 1e-9] = 0, 1
    z -= mean
    z /= scale
    y = np.repeat(labels.astype(int), np.diff(first))
    # A document counts as one, however many lines it has; both classes count alike.
    share = np.repeat(1 / np.diff(first), np.diff(first))
    balance = np.where(y == 1, 0.5 / max(labels.mean(), 1e-3), 0.5 / max(1 - labels.mean(), 1e-3))
    c = share * balance / len(texts)
    theta = np.zeros(N_FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((len(z), 2, 2))
    rows = np.flatnonzero(~begins)
    seen[rows, y[rows - 1], y[rows]] = 1
    for i in range(1, ITERATIONS + 1):
        p, pairs = marginals(z @ theta[:-4], theta[-4:].reshape(2, 2), begins)
        g = np.concatenate([z.T @ (c * (p[:, 1] - y)), c @ (pairs - seen).reshape(-1, 4)]) + RIDGE * np.concatenate([theta[:-4], 10 * theta[-4:]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= STEP * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
    model = Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), 1.0, 0.0)
    s = aggregate(model, rates, signs, size, first)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps, with a little ridge for classes that separate
        q = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        r, h = q - labels, np.maximum(q * (1 - q), 1e-9)
        grad = np.array([r @ s + 0.1 * (a - 1), r.sum() + 0.1 * b])
        hess = np.array([[(h * s) @ s + 0.1, h @ s], [h @ s, h.sum() + 0.1]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    model.slope, model.intercept = float(max(a, 0.0)), float(b)
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text, mod 5; rows of remainder 0 are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From ``sample`` labelled documents of the learning folds at most, drawn by a hash of their id; ids that have both
    labels are left out. Only these texts, of bounded number and length, come to the driver."""
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("a"), F.max("quality").alias("b")).where("a = b")
    known = known.where(fold(F.col("doc_id")) != 0).select("doc_id", F.col("a").alias("quality"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).collect()
    return fit([r["text"] for r in rows], np.array([r["quality"] for r in rows], float))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= THRESHOLD, else 0) by the texts alone; columns of these
    names are replaced, all others stay. Null text scores as an empty one. Whole texts are scored, rows independently, so
    repeated rows have equal scores; an empty table gives no row."""
    rows = docs.drop("score", "predicted")
    names = rows.columns
    at = names.index("text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for a, b, texts in text_chunks(batch.column(at)):
                score[a:b] = model.documents(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*names, "score", "predicted"])

    return rows.mapInArrow(run, schema)
