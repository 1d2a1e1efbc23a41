"""Toxicity by a linear-chain conditional random field over words.

Words of a document form chains, one a sentence: they end at line ends and after ``. ! ?``, however long.
Each word has one of two states, clean or toxic. A word's emission is the sum of the weights of its hashed features (the
word itself, its beginnings of 3 to 8 bytes, its end), a 2x2 matrix holds the transition scores.
Forward-backward gives every word's marginal of the toxic state; a document's score is a logistic
function of the log of its expected number of toxic words and of its best marginal, calibrated on
document labels. Spans of words with a marginal of ``SPAN_AT`` or more are the offending offsets.

Fit, on about ``FIT_ROWS`` labelled documents chosen by a hash of doc_id (a bound on labelled rows):
word labels come from document labels. A feature's weight of evidence is the log ratio of the
shares of toxic and of clean documents that have it, if its log-likelihood ratio clears
2 log(number of features); words of toxic documents whose best feature reaches ``EVIDENCE`` are
labelled toxic, all others clean. The field is then trained on these
word labels by gradient ascent of the penalised conditional likelihood.

Defined cases: a null or empty text, or one without words, gets the score of a document without
any toxic word; with no labelled rows of both kinds every score is 0. Repeated rows are scored
alike; labels that are null or name absent documents teach nothing; of repeated labels of an id the
largest counts. Whole texts are scored. Other columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquarry.llm import bytescan as bs
from pixelquarry.llm.ppm_language import fold
from pixelquarry.llm.sampling import id_hash, last_hash
from pixelquarry.session import ship

FIT_ROWS = 2000
FEATURES = 1 << 18
#: Least weight of evidence of a toxic word's best feature.
EVIDENCE = 1.5
SPAN_AT = 0.5
CACHE_WORDS = 300_000
ALERT = 0.3

SAMPLE = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("toxic", pa.int32())])
OUT = "doc_id long, score double, n_toxic_words long, spans string"

#: Bytes of words: ASCII letters, digits and apostrophe, and all bytes of other characters.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 0x27, *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?\n"]] = True


def lowered(buf: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 capitals lowered; lengths and offsets stay as they are."""
    out = _LOWER[buf]
    latin = np.concatenate(([False], buf[:-1] == 0xC3)) & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)
    out[latin] += 0x20
    return out


def hashed(key: bytes) -> int:
    """FNV-1a, folded to a feature number."""
    h = 0xCBF29CE484222325
    for b in key:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return (h ^ h >> 29) % FEATURES


def features(word: bytes) -> list[int]:
    """The hashed features of a word."""
    out = [b"=" + word] + [b"^" + word[:n] for n in range(3, min(8, len(word)) + 1)]
    if len(word) > 4:
        out.append(b"$" + word[-4:])
    return [hashed(x) for x in dict.fromkeys(out)]


@dataclass
class Words:
    """The words of a pack: spans, documents, hashes, and which of them begin a chain."""

    begins: np.ndarray
    ends: np.ndarray
    docs: np.ndarray
    hashes: np.ndarray
    opens: np.ndarray
    low: np.ndarray

    @classmethod
    def of(cls, pack: bs.Pack) -> Words:
        low = lowered(pack.buf)
        begins, ends = bs.spans_of(_WORD[low])
        docs = pack.doc_of(begins)
        stops = np.concatenate(([0], np.cumsum(_BREAK[low])))[begins] if len(begins) else np.zeros(0, np.int64)
        opens = np.ones(len(begins), bool)
        opens[1:] = (docs[1:] != docs[:-1]) | (stops[1:] != stops[:-1])
        return cls(begins, ends, docs, bs.span_hashes(low, begins, ends), opens, low)

    def spelled(self, i: int) -> bytes:
        return self.low[self.begins[i] : self.ends[i]].tobytes()


def marginals(
    emission: np.ndarray, opens: np.ndarray, transition: np.ndarray, start: float, with_pairs: bool = False
) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginal of the toxic state of every word, and the expected number of each pair of states in turn.

    ``emission`` is the score of toxic over clean. Chains of equal rank are run in lockstep.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    first = np.flatnonzero(opens)
    length = np.diff(np.append(first, n))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    weight = np.exp(np.clip(emission, -30, 30))
    t = np.exp(transition)
    fwd, bwd = np.ones((n, 2)), np.ones((n, 2))
    for j in range(length[0]):
        at = first[: alive[j]] + j
        if j:
            f = fwd[at - 1] @ t
        else:
            f = np.tile([1.0, np.exp(start)], (len(at), 1))
        f[:, 1] *= weight[at]
        fwd[at] = f / f.sum(axis=1, keepdims=True)
    for j in range(length[0] - 2, -1, -1):
        at = first[: alive[j + 1]] + j
        b = bwd[at + 1].copy()
        b[:, 1] *= weight[at + 1]
        b = b @ t.T
        bwd[at] = b / b.sum(axis=1, keepdims=True)
    both = fwd * bwd
    toxic = both[:, 1] / both.sum(axis=1)
    if not with_pairs:
        return toxic, None
    inner = np.flatnonzero(~opens)
    left, right = fwd[inner - 1], bwd[inner]
    right[:, 1] *= weight[inner]
    total = ((left @ t) * right).sum(axis=1)
    return toxic, t * (left.T @ (right / total[:, None]))


_remembered: dict[str, dict[int, float]] = {}


@dataclass
class Field:
    """Weights of the field and of the calibration."""

    weights: np.ndarray
    bias: float
    transition: np.ndarray
    start: float
    calibration: np.ndarray  # intercept, log expected toxic words, best marginal's log odds
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def emissions(self, words: Words) -> np.ndarray:
        """Emission of every word; each distinct word is looked at once and remembered."""
        kinds, where, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        cache = _remembered.get(self.name)
        if cache is None or len(cache) > CACHE_WORDS:
            _remembered.clear()  # a worker remembers words for one field at a time
            cache = _remembered[self.name] = {}
        out = np.empty(len(kinds))
        for i, (h, w) in enumerate(zip(kinds.tolist(), where.tolist(), strict=True)):
            e = cache.get(h)
            if e is None:
                e = cache[h] = float(self.weights[features(words.spelled(w))].sum()) + self.bias
            out[i] = e
        return out[inverse]

    def read(self, words: Words) -> np.ndarray:
        return marginals(self.emissions(words), words.opens, self.transition, self.start)[0]

    def scores(self, toxic: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-(_evidence(toxic, docs, n) @ self.calibration)))


def _evidence(toxic: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    best = np.full(n, 1e-6)
    np.maximum.at(best, docs, np.clip(toxic, 1e-6, 1 - 1e-6))
    total = bs.per_doc(np.where(toxic > 0.05, toxic, 0.0), docs, n)
    return np.stack((np.ones(n), np.log1p(total), np.log(best / (1 - best)) / 4), axis=1)


def _ratio(c1: np.ndarray, n1: float, c0: np.ndarray, n0: float) -> np.ndarray:
    """Log-likelihood ratio statistic of two shares being equal."""
    p = (c1 + c0) / (n1 + n0)
    part = lambda c, e: np.where(c > 0, c * np.log(np.maximum(c, 1e-9) / np.maximum(e, 1e-9)), 0.0)
    return 2 * (part(c1, n1 * p) + part(c0, n0 * p) + part(n1 - c1, n1 * (1 - p)) + part(n0 - c0, n0 * (1 - p)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Penalised, weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (weight * (y - p)) - ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(
    texts: list[str], labels: list[int], toxic_share: float | None = None, rounds: int = 40, rate: float = 0.5, ridge: float = 1e-4
) -> Field | None:
    """The field of a bounded sample of texts and document labels.

    ``toxic_share`` is the share of label 1 among all labelled rows, for the calibration of a
    sample that is drawn by label.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return None
    (_, _, pack), = bs.slices(pa.array(texts, pa.large_string()), most=1 << 40)
    words = Words.of(pack)
    kinds, where, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    # features of all distinct words, end to end
    of_kind = [np.array(features(words.spelled(int(w))), np.int32) for w in where]
    owner = np.repeat(np.arange(len(of_kind)), [len(fs) for fs in of_kind])
    flat = np.concatenate(of_kind) if of_kind else np.zeros(0, np.int32)
    first = np.searchsorted(owner, np.arange(len(kinds) + 1))
    del of_kind
    # how many toxic and clean documents have each feature
    pairs = np.unique(words.docs * len(kinds) + inverse)
    doc, kind = pairs // len(kinds), pairs % len(kinds)
    n = first[kind + 1] - first[kind]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[kind], n)
    has = np.unique(np.repeat(doc, n) * FEATURES + flat[at])
    c1, c0 = (np.bincount(has[y[has // FEATURES] == k] % FEATURES, minlength=FEATURES).astype(float) for k in (1, 0))
    n1, n0 = y.sum(), (1 - y).sum()
    sure = (_ratio(c1, n1, c0, n0) >= 2 * np.log(max(2, (c1 > 0).sum()))) & (c1 > 0)
    gain = np.where(sure, np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1)), -9.0)
    best = np.full(len(kinds), -9.0)
    np.maximum.at(best, owner, gain[flat])
    label = (best[inverse] >= EVIDENCE) & (y[words.docs] == 1)
    # maximum conditional likelihood by gradient ascent with per-weight step sizes
    used, flat = np.unique(flat, return_inverse=True)
    w = np.zeros(len(used))
    head = np.array([-3.0, 0.0, 0.0, 0.0, 0.0, 0.0])  # bias, start, transition by row
    grown_w, grown_h = np.full(len(used), 1e-6), np.full(6, 1e-6)
    inner = np.flatnonzero(~words.opens)
    true_pairs = np.zeros((2, 2))
    np.add.at(true_pairs, (label[inner - 1].astype(int), label[inner].astype(int)), 1)
    for _ in range(rounds):
        emission = (np.bincount(owner, weights=w[flat], minlength=len(kinds)) + head[0])[inverse]
        toxic, pairs = marginals(emission, words.opens, head[2:].reshape(2, 2), head[1], with_pairs=True)
        gap = label - toxic
        by_kind = np.bincount(inverse, weights=gap, minlength=len(kinds))
        g = np.bincount(flat, weights=by_kind[owner], minlength=len(used)) - ridge * len(y) * w
        gh = np.array([gap.sum(), gap[words.opens].sum(), *(true_pairs - pairs).ravel()]) - ridge * len(y) * head
        grown_w += g * g
        grown_h += gh * gh
        w += rate * g / np.sqrt(grown_w)
        head += rate * gh / np.sqrt(grown_h)
    weights = np.zeros(FEATURES, np.float32)
    weights[used] = w
    out = Field(weights, float(head[0]), head[2:].reshape(2, 2), float(head[1]), np.zeros(3))
    share = y.mean() if toxic_share is None else toxic_share
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    out.calibration = _logistic(_evidence(out.read(words), words.docs, len(y)), y, weight)
    _remembered.clear()
    return out


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Field | None:
    """Train on about ``rows`` labelled documents; both inputs may be filtered to the rows to learn from."""
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two rows
    if not totals.get(0) or not totals.get(1):  # labels are 0 or 1
        return None
    chosen = marked.where(id_hash() <= F.when(F.col("toxic") == 1, last_hash(rows // 2, totals[1])).otherwise(last_hash(rows // 2, totals[0])))
    toxic_share = totals[1] / (totals[0] + totals[1])
    # about `rows` labelled rows, a fixed bound: their ids are broadcast, and one task sees their texts
    sample = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = pa.Table.from_batches(batches, SAMPLE).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        model = train(seen.column("text").to_pylist(), seen.column("toxic").to_pylist(), toxic_share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)])], ["model"])

    ship(documents.sparkSession)
    return pickle.loads(sample.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).repartition(1).mapInArrow(run, "model binary").first()[0])


def score(documents: DataFrame, model: Field | None) -> DataFrame:
    """(doc_id, score, n_toxic_words, spans) of every document."""
    spark = documents.sparkSession
    ship(spark)
    # FEATURES weights, a fixed size
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for begin, end, pack in bs.slices(batch.column("text")):
                score, hits, spans = np.zeros(pack.n), np.zeros(pack.n, np.int64), [""] * pack.n
                if m is not None:
                    words = Words.of(pack)
                    toxic = m.read(words)
                    score = m.scores(toxic, words.docs, pack.n)
                    at = np.flatnonzero(toxic >= SPAN_AT)
                    hits = np.bincount(words.docs[at], minlength=pack.n).astype(np.int64)
                    point = np.concatenate(([0], np.cumsum((pack.buf & 0xC0) != 0x80)))
                    for d in np.flatnonzero(hits):
                        own = at[words.docs[at] == d] if len(at) < 64 else at[slice(*np.searchsorted(words.docs[at], [d, d + 1]))]
                        base = point[pack.first[d]]
                        spans[d] = ",".join(f"{b}:{e}" for b, e in zip(point[words.begins[own]] - base, point[words.ends[own]] - base, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[begin:end], pa.array(score), pa.array(hits), pa.array(spans)],
                    ["doc_id", "score", "n_toxic_words", "spans"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, OUT)


def toxicity(documents: DataFrame, labels: DataFrame, held_out: int = 2, parts: int = 4) -> DataFrame:
    """Fit on the labels of the other folds, score every document, and say which were held out."""
    model = fit(documents, labels.where(fold(parts=parts) != held_out))
    return score(documents, model).select(
        "doc_id", F.coalesce(fold(parts=parts) == held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= ALERT).cast("int").alias("predicted"), "n_toxic_words", "spans",
    )
