"""Quality classifier by positive-unlabelled learning.

Only trusted positives (documents labelled good) and unlabelled web text are
used; no document labelled bad enters training.

* Features are shares of character classes, punctuation, word and line shapes, counted
  over the whole text with numpy in Arrow batches.
* The class prior (share of good documents in the unlabelled text) is estimated
  first: a positive-against-unlabelled classifier ranks held-back halves, and the
  smallest ratio of unlabelled to positive mass above a threshold, less a margin, is the prior.
* A small network minimises the non-negative unbiased risk
  prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives));
  where the bracket is negative the step goes the other way.

The model is fitted on a bounded sample: at most ``sample`` positives and
``sample`` unlabelled documents, those whose hashed id is smallest.  Every document is
scored, each row on its own, so a hot source needs no care.

Edge cases: NULL text is empty; empty texts are scored too (all shares 0); very
long texts are read whole; repeated rows get equal scores; with fewer than four positives or
unlabelled rows every score is 0.5; an empty table gives an empty result; extra
columns are ignored.  A document with a good and a bad label isn't a trusted positive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import Rolling, byte_values, narrow, text_chunks, word_hashes, words

SAMPLE = 10_000
MARGIN = 0.03
PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS = np.zeros(256, np.uint8)  # 0: other control bytes
_CLASS[128:] = 1
_CLASS[[9, 11, 12, 13, 32]] = 2
_CLASS[10] = 3
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 4, 5, 6
_CLASS[PUNCTUATION] = 7 + np.arange(len(PUNCTUATION))
N_CLASSES = 7 + len(PUNCTUATION)


def _per_row(values, off):
    """Sums of the values between neighbouring offsets."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[off[1:]] - total[off[:-1]]


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of features for each text."""
    n = len(off) - 1
    size = np.diff(off)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * N_CLASSES + _CLASS[buf], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(float)
    s, e, wrow = words(buf, off)
    woff = np.searchsorted(wrow, np.arange(n + 1))
    n_words = np.maximum(np.diff(woff), 1)
    upper = np.concatenate([[0], np.cumsum(_CLASS[buf] == 5)])
    lower = np.concatenate([[0], np.cumsum((_CLASS[buf] == 6) | (_CLASS[buf] == 1))])
    n_upper, n_lower, length = upper[e] - upper[s], lower[e] - lower[s], (e - s).astype(float)
    h = word_hashes(buf, s, e)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (wrow[1:] == wrow[:-1])
    order = np.lexsort((h, wrow))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (wrow[order][1:] != wrow[order][:-1])
    ends = np.union1d(np.flatnonzero(buf == 10), off[1:]).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    keep = ends > starts
    lrow = np.searchsorted(off, starts[keep], "right") - 1
    lh = Rolling(byte_values(buf)).spans(starts[keep] + (buf[starts[keep]] == 10), ends[keep]) if keep.any() else np.zeros(0, np.uint64)
    lorder = np.lexsort((lh, lrow))
    same = np.zeros(len(lh), bool)
    same[1:] = (lh[lorder][1:] == lh[lorder][:-1]) & (lrow[lorder][1:] == lrow[lorder][:-1])
    loff = np.searchsorted(lrow, np.arange(n + 1))
    n_lines = np.maximum(np.diff(loff), 1)
    mean = _per_row(length, woff) / n_words
    letters = np.maximum(kinds[:, 5] + kinds[:, 6] + kinds[:, 1], 1)
    return np.column_stack([
        np.log1p(size), np.log1p(np.diff(woff)), kinds[:, 5] / letters, kinds[:, 4] / np.maximum(size, 1), kinds[:, 1] / np.maximum(size, 1),
        kinds[:, 2] / np.maximum(size, 1), kinds[:, 7:] / n_words[:, None], mean, np.sqrt(np.maximum(_per_row(length**2, woff) / n_words - mean**2, 0)),
        _per_row(n_upper + n_lower == 0, woff) / n_words, _per_row((n_upper > 1) & (n_lower == 0), woff) / n_words,
        _per_row(again, woff) / n_words, _per_row(fresh, woff) / n_words, _per_row(same, loff) / n_lines, np.log1p(n_words / n_lines)])


def _features_of(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, buf, off in text_chunks(batch):
                x = features(buf, off)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(list(x))], names=["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id long, x array<double>")


class Net:
    """One hidden layer; scores are log odds."""

    def __init__(self, x: np.ndarray, hidden: int, rng):
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        d = x.shape[1]
        self.w = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.m = [np.zeros_like(p) for p in self.w]
        self.v = [np.zeros_like(p) for p in self.w]
        self.t = 0

    def scaled(self, x):
        return np.clip((x - self.mean) / self.std, -6, 6)

    def odds(self, x):
        return np.tanh(self.scaled(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def step(self, z, grad, rate):
        """One Adam step on scaled rows ``z`` with the loss's slope ``grad`` at each row's score."""
        hid = np.tanh(z @ self.w[0] + self.w[1])
        back = grad[:, None] * self.w[2] * (1 - hid**2)
        self.t += 1
        for i, g in enumerate([z.T @ back + 1e-4 * self.w[0], back.sum(0), hid.T @ grad + 1e-4 * self.w[2], np.array([grad.sum()])]):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.w[i] -= rate * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, hidden: int = 24, steps: int = 1000, size: int = 256, rate: float = 3e-3, seed: int = 0) -> Net:
    """Minimise the non-negative risk; with ``prior`` None plain positive-against-unlabelled logistic loss."""
    rng = np.random.default_rng(seed)
    net = Net(unlabelled, hidden, rng)
    zp, zu = net.scaled(positive), net.scaled(unlabelled)
    for _ in range(steps):
        p, u = zp[rng.integers(0, len(zp), size)], zu[rng.integers(0, len(zu), size)]
        z = np.vstack([p, u])
        f = np.tanh(z @ net.w[0] + net.w[1]) @ net.w[2] + net.w[3]
        fp, fu = f[:size], f[size:]
        if prior is None:
            grad = np.concatenate([-_sigmoid(-fp), _sigmoid(fu)]) / size
        else:
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            if negative >= 0:
                grad = np.concatenate([prior * (-_sigmoid(-fp) - _sigmoid(fp)), _sigmoid(fu)]) / size
            else:
                grad = -np.concatenate([-prior * _sigmoid(fp), _sigmoid(fu)]) / size
        net.step(z, grad, rate)
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, margin: float = MARGIN, seed: int = 0) -> float:
    """Share of positives in the unlabelled rows: the least ratio of masses above a threshold, less ``margin``.

    Each half is ranked by a classifier fitted on the other.  The ratio bounds the
    prior from above, and the non-negative risk bears a prior that is a little too small
    much better than one too large, so the margin is taken off.
    """
    found = []
    for a in (0, 1):
        net = fit_nnpu(positive[a::2], unlabelled[a::2], None, hidden=8, steps=400, seed=seed)
        p, u = np.sort(net.odds(positive[1 - a :: 2])), np.sort(net.odds(unlabelled[1 - a :: 2]))
        at = np.quantile(p, np.linspace(0, 0.5, 51))
        found.append(((1 - np.searchsorted(u, at) / len(u)) / (1 - np.searchsorted(p, at) / len(p))).min())
    return float(np.clip(np.mean(found) - margin, 0.01, 0.99))


def held_out(key: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Fit on documents that aren't held out; returns (network or None, prior)."""
    ids = narrow(docs).select("doc_id").filter(~held_out() & F.col("doc_id").isNotNull()).distinct()
    good = (labels.filter("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).filter("q = 1")
            .join(ids, "doc_id").select("doc_id", F.lit(1).alias("kind")))
    first = F.xxhash64("doc_id"), "doc_id"
    chosen = good.orderBy(*first).limit(sample).unionByName(ids.withColumn("kind", F.lit(0)).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(sample))
    rows = _features_of(narrow(docs).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")).join(F.broadcast(chosen), "doc_id")
    got = sorted(rows.select("doc_id", "kind", "x").collect(), key=lambda r: (r["kind"], r["doc_id"], r["x"]))  # at most 2 * sample rows
    p, u = (np.array([r["x"] for r in got if r["kind"] == k]) for k in (1, 0))
    if len(p) < 4 or len(u) < 4:
        return None, 0.5
    rng = np.random.default_rng(1)
    p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    prior = estimate_prior(p, u)
    return fit_nnpu(p, u, prior), prior


def score(docs: DataFrame, net: Net | None) -> DataFrame:
    """(doc_id, score): the chance that a document is good."""
    docs = narrow(docs)
    if net is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, buf, off in text_chunks(batch):
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(_sigmoid(net.odds(features(buf, off))))], names=["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    net, _ = train(docs, labels, sample)
    return score(docs, net).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The documents, all columns, that score at least ``threshold``; each row is decided in place, without a shuffle.

    With fewer than four trusted or four unlabelled training rows there is no model, and every document stays, whatever the threshold.
    """
    net, _ = train(docs, labels, sample)
    if net is None:
        return docs

    def run(batches):
        for batch in batches:
            for lo, hi, buf, off in text_chunks(batch):
                good = _sigmoid(net.odds(features(buf, off))) >= threshold
                yield batch.slice(lo, hi - lo).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
