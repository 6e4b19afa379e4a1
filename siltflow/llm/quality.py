"""Quality classifier learnt from trusted positives and unlabelled text: non-negative positive-unlabelled risk."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Most trusted positives, and most unlabelled documents, that a model is fitted to; taken in the order of a hash of doc_id.
SAMPLE = 5000
SEED = 29
#: Statistics before the byte shares.
N_STATS = 14
N_FEATURES = N_STATS + 256


def featurise(text: str | None) -> np.ndarray:
    """Statistics of a whole text and the square roots of its byte shares; zeros for a null, empty or blank text."""
    out = np.zeros(N_FEATURES)
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return out
    n = len(words)
    size = len(raw)
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = share[65:91].sum()
    lower = share[97:123].sum()
    letters = upper + lower + share[128:].sum()
    lengths = np.fromiter(map(len, words), np.int64, n)
    same = sum(map(bytes.__eq__, words[1:], words[:-1]))
    distinct = len(set(words))
    pairs = len(set(zip(words[1:], words[:-1], strict=True)))
    out[:N_STATS] = (
        np.log1p(n) / 10,
        min(20.0, lengths.mean()) / 20,
        min(20.0, lengths.std()) / 20,
        same / n,
        distinct / n,
        (pairs + 1) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1000, len(lines)) / max(1, n),
        upper / max(1e-9, letters),
        letters,
        share[48:58].sum(),
        share[33:48].sum() + share[58:65].sum() + share[91:97].sum() + share[123:127].sum(),
        share[124],
        1.0,
    )
    out[N_STATS:] = np.sqrt(share)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)


def _adam(grad, dim: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(dim), np.zeros(dim), np.zeros(dim)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(p: np.ndarray, u: np.ndarray, l2: float = 1e-3) -> float:
    """Share of positives in u, by the best bin of a positive-against-unlabelled classifier's held-back scores.

    Over a threshold c that only positives exceed, the share of u above c is the prior times the share of p above c. The bound's
    slack is that of the empirical distributions.
    """
    if len(p) < 20 or len(u) < 20:
        return 0.5
    hp, hu = len(p) // 2, len(u) // 2
    a, b = np.concatenate([p[:hp], u[:hu]]), np.r_[np.ones(hp), np.zeros(hu)]
    weight = np.r_[np.full(hp, 0.5 / hp), np.full(hu, 0.5 / hu)]
    w = _adam(lambda w: a.T @ (weight * (sigmoid(a @ w) - b)) + l2 * w, a.shape[1], 400, 0.05)
    sp, su = np.sort(p[hp:] @ w), np.sort(u[hu:] @ w)
    cuts = np.unique(np.concatenate([sp, su]))
    qp = 1 - np.searchsorted(sp, cuts, "left") / len(sp)
    qu = 1 - np.searchsorted(su, cuts, "left") / len(su)
    slack = np.sqrt(np.log(200) / (2 * len(sp))) + np.sqrt(np.log(200) / (2 * len(su)))
    ok = qp > 0
    best = np.argmin((qu[ok] + slack) / qp[ok])
    return float(np.clip(qu[ok][best] / qp[ok][best], 0.02, 0.98))


def nn_risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float, l2: float) -> np.ndarray:
    """Of prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) under the logistic loss; where the second part is negative, the
    step goes against it instead, as the non-negative estimator prescribes."""
    zp, zu = p @ w, u @ w
    sp, su = sigmoid(zp), sigmoid(zu)
    g_pos = p.T @ (sp - 1) * (prior / len(p))
    g_neg = u.T @ su / len(u) - p.T @ sp * (prior / len(p))
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return (g_pos + g_neg if negative >= 0 else -g_neg) + l2 * w


class Model:
    """Linear scores of standardised features; `prior` is the estimated share of positives among unlabelled text."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, w: np.ndarray, prior: float):
        self.mean, self.std, self.w, self.prior = mean, std, w, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return sigmoid(np.c_[z, np.ones(len(z))] @ self.w)


def fit(p: np.ndarray, u: np.ndarray, steps: int = 800, rate: float = 0.04, l2: float = 1e-4) -> Model:
    """Features of trusted positives and of unlabelled documents to a model. Without either, all scores are one half."""
    if not len(p) or not len(u):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1), 0.5)
    mean, std = _standard(u)

    def z(x):
        return np.c_[np.clip((x - mean) / std, -8, 8), np.ones(len(x))]

    zp, zu = z(p), z(u)
    prior = class_prior(zp, zu)
    return Model(mean, std, _adam(lambda w: nn_risk_gradient(w, zp, zu, prior, l2), zp.shape[1], steps, rate), prior)


def held_out(col: str = "doc_id"):
    """crc32 of the decimal doc_id, modulo 3, is 1; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample_features(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features of the documents of at most SAMPLE ids."""

    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    got = map_texts(got, lambda: lambda texts: {"x": [featurise(t).tobytes() for t in texts]}, "x binary").collect()
    got = sorted((r["doc_id"], bytes(r["x"])) for r in got)
    order = np.random.default_rng(SEED).permutation(len(got))
    return np.array([np.frombuffer(got[i][1]) for i in order]).reshape(-1, N_FEATURES)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` trusted positives (labels.quality = 1) and as many unlabelled documents, none of them held out."""
    free = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id").distinct()
    good = labels.where("doc_id is not null and quality = 1").where(~held_out()).select("doc_id").distinct()
    first = F.xxhash64(F.lit(SEED), "doc_id")
    p_ids = good.join(free, "doc_id", "left_semi").orderBy(first, "doc_id").limit(sample)
    u_ids = free.orderBy(F.xxhash64(F.lit(SEED + 1), "doc_id"), "doc_id").limit(sample)
    return fit(_sample_features(docs, p_ids), _sample_features(docs, u_ids))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text. No shuffle: the model is a few kilobytes.

    A null text is the empty text, which has the score of all-zero features; repeated rows have equal scores; an empty table
    gives no rows; columns other than doc_id and text are not read.
    """

    def scores(texts: list) -> dict:
        x = model.score(np.stack([featurise(t) for t in texts]))
        return {"score": x, "predicted": (x >= 0.5).astype(np.int32)}

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return map_texts(rows, lambda: scores, "score double, predicted int", ("doc_id", "held_out"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with a score of at least one half, all their columns as they are, whatever their names. Null, empty and
    blank texts have the score of all-zero features, so they go or stay together; equal rows too; an empty table gives no rows."""

    @F.pandas_udf("double")
    def scores(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack([featurise(t) for t in text]))) if len(text) else pd.Series([], dtype=float)

    return docs.where(scores(F.col("text")) >= 0.5)
