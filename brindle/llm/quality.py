"""A quality classifier from trusted positives and unlabelled text.

Documents become numbers that describe form, never source or language: shares
of bytes, repetition of words and lines, lengths.  A linear model is fitted to
the non-negative unbiased risk of positive-unlabelled learning: the risk of
calling trusted documents bad, plus that of calling unlabelled ones good less
the part that positives hidden among them account for, never below zero.  The
share of positives, the class prior, is estimated first, from the same two
kinds of text alone; labels of bad documents are not used.

The fit and the prior see a bounded sample: about `most_rows` trusted and as
many unlabelled documents, drawn by a hash.  Every text is scored whole, in one
pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit

_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "space": b" \t", "line": b"\n\r", "high": bytes(range(128, 256)),
} | {f"mark {chr(b)}": bytes([b]) for b in range(33, 127) if not chr(b).isalnum()}
_CLASS_OF = np.zeros(256, np.int64)
for _k, _members in enumerate(_CLASSES.values(), 1):
    _CLASS_OF[list(_members)] = _k
FEATURES = [
    "other", *_CLASSES, "log words", "log bytes", "word length", "distinct words", "repeats of the word before", "most frequent word",
    "repeated 4-grams", "repeated lines", "words per line", "words ending in a mark", "words without letters", "all marks", "empty", "capital words",
]
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


def _per(sums: np.ndarray, count: np.ndarray) -> np.ndarray:
    return sums / np.maximum(count, 1)


def _runs(key: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the number of keys, of distinct keys and of the most frequent one."""
    if not len(key):
        return (np.zeros(n),) * 3
    order = np.lexsort((key, text))
    k, t = key[order], text[order]
    new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])])
    size = np.diff(np.r_[new, len(k)])
    top = np.zeros(n)
    np.maximum.at(top, t[new], size)
    return np.bincount(t, minlength=n).astype(float), np.bincount(t[new], minlength=n).astype(float), top


def features(column: pa.Array) -> np.ndarray:
    """One row of `FEATURES` for each text; null is the empty text."""
    out = [np.zeros((0, len(FEATURES)))]
    for a, b, data, offsets in textkit.text_chunks(column, textkit.SMALL_BYTES):
        n, size = b - a, np.diff(offsets)
        text_of_byte = np.repeat(np.arange(n), size)
        shares = np.bincount(text_of_byte * (len(_CLASSES) + 1) + _CLASS_OF[data], minlength=n * (len(_CLASSES) + 1)).reshape(n, -1)
        shares = np.sqrt(_per(shares, size[:, None]))
        starts, ends, first = textkit.word_spans(data, offsets)
        words = textkit.word_hashes(data, starts, ends)
        count = np.diff(first)
        text = np.repeat(np.arange(n), count)
        total, distinct, top = _runs(words, text, n)
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
        grams, begin = textkit.gram_hashes(words, first, 4)
        g_total, g_distinct, _ = _runs(grams, np.repeat(np.arange(n), np.diff(begin)), n)
        lines = _line_hashes(data, offsets)
        l_total, l_distinct, _ = _runs(lines[0], lines[1], n)
        marks = _MARK[data]
        many = np.concatenate([[0], np.cumsum(marks)])
        in_word = many[ends] - many[starts]
        upper = (data >= 65) & (data <= 90)
        rest = [
            np.log1p(count), np.log1p(size), _per(np.bincount(text, ends - starts, n), count), _per(distinct, total), _per(np.bincount(text, same, n), count),
            _per(top, total), _per(g_total - g_distinct, g_total), _per(l_total - l_distinct, l_total), np.log1p(_per(total, l_total)),
            _per(np.bincount(text, marks[ends - 1] if len(ends) else None, n), count), _per(np.bincount(text, in_word == ends - starts, n), count),
            _per(np.bincount(text_of_byte, marks, n), size), (count == 0).astype(float), _per(np.bincount(text, upper[starts] if len(starts) else None, n), count),
        ]
        out.append(np.column_stack([shares, *rest]))
    return np.concatenate(out)


def _line_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of non-empty lines, and the text that each is in."""
    inner = data != 10
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    left, right = np.ones(len(data), bool), np.ones(len(data), bool)
    left[1:], right[:-1] = ~inner[:-1], ~inner[1:]
    starts = np.flatnonzero(inner & (left | edge[:-1]))
    ends = np.flatnonzero(inner & (right | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    return textkit.word_hashes(data, starts, ends), np.repeat(np.arange(len(offsets) - 1), np.diff(first))


class Model:
    """A linear model over standardised features; scores are probabilities of label 1."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weight: np.ndarray, bias: float, prior: float):
        self.mean, self.spread, self.weight, self.bias, self.prior = mean, spread, weight, bias, prior

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -5, 5)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weight + self.bias, -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, default: float = 0.5) -> float:
    """Share of positives among unlabelled documents, from trusted positives and unlabelled ones.

    Above any score there are at least as many unlabelled documents as the share
    times the part of the positives there, and about as many where hardly
    anything but positives is.  So the share is the least ratio of the two parts
    over all scores that a tenth of the positives reach, each raised by one
    standard error.  The scores of one half come from a model of the other, both
    ways, so none is of a document that the model has seen.
    """
    if min(len(positive), len(unlabelled)) < 4:
        return default
    rng = np.random.default_rng(3)
    halves = [(lambda at: (x[at[::2]], x[at[1::2]]))(rng.permutation(len(x))) for x in (positive, unlabelled)]
    found = []
    for k in (0, 1):
        model = fit(halves[0][k], halves[1][k], default, steps=400)
        p, u = model.score(halves[0][1 - k]), model.score(halves[1][1 - k])
        at = np.quantile(p, np.linspace(0, 0.9, 46))[:, None]
        share_p, share_u = (p >= at).mean(1), (u >= at).mean(1)
        error = np.sqrt((1 - share_p) / share_p / len(p)) + np.sqrt((1 - share_u) / np.maximum(share_u, 1 / len(u)) / len(u))
        found.append((share_u / share_p * (1 + error)).min())
    return float(np.clip(np.mean(found), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05, decay: float = 1e-5) -> Model:
    """Minimises the non-negative unbiased risk with logistic loss by Adam over the whole sample.

    While the estimated risk of negatives is below zero, the step goes up that
    risk instead, which is what keeps the model from explaining noise.
    """
    both = np.concatenate([positive, unlabelled])
    model = Model(both.mean(0), both.std(0) + 1e-6, np.zeros(both.shape[1]), 0.0, prior)
    p, u = model.design(positive), model.design(unlabelled)
    theta, m, v = (np.zeros(p.shape[1] + 1) for _ in range(3))
    p1, u1 = (np.column_stack([x, np.ones(len(x))]) for x in (p, u))
    soft = lambda z: np.logaddexp(0, z)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        zp, zu = p1 @ theta, u1 @ theta
        negative = soft(zu).mean() - prior * soft(zp).mean()
        g_pos = -prior * (p1.T @ sig(-zp)) / len(p1)
        g_neg = (u1.T @ sig(zu)) / len(u1) - prior * (p1.T @ sig(zp)) / len(p1)
        g = g_pos + g_neg if negative >= 0 else -g_neg
        g = g + decay * np.r_[theta[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (1 - t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weight, model.bias = theta[:-1], float(theta[-1])
    return model


def _drawn(hash_: Column, share: float) -> Column:
    """True for about so large a share of uniform 64-bit hashes."""
    return hash_ < F.lit(min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))) if share < 1 else F.lit(True)


def train(
    docs: DataFrame, labels: DataFrame, training: str, most_rows: int = 10_000,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Model | None:
    """The model from the positive labels that the SQL predicate `training` over the id admits; None without one.

    Rows that agree in id and text count once; null ids, labels of unknown ids
    and null labels do not count.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(
        f"({training}) and doc_id is not null and label = 1"
    ).select("doc_id").distinct()
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    trusted, every = known.count(), given.count()
    # about `most_rows` ids
    picked = known.where(_drawn(F.xxhash64("doc_id", F.lit(17)), most_rows / max(trusted, 1))).withColumn("trusted", F.lit(True))
    key = F.xxhash64("doc_id", "text", F.lit(18))
    roles = F.array_compact(F.array(F.col("trusted"), F.when(_drawn(key, most_rows / max(every, 1)), F.lit(False))))
    sample = given.join(F.broadcast(picked), "doc_id", "left").select(key.alias("key"), "text", F.explode(roles).alias("positive")).dropDuplicates(["key", "positive"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["positive", "x"])

    rows = sample.select("text", "positive").mapInArrow(run, "positive boolean, x binary").toPandas()
    if not rows["positive"].any() or rows["positive"].all():
        return None
    # in an order of their own, so that sums do not depend on who came first
    rows = rows.sort_values(["positive", "x"], kind="stable")
    x = np.frombuffer(b"".join(rows["x"]), np.float64).reshape(len(rows), len(FEATURES))
    positive = rows["positive"].to_numpy(bool)
    return fit(x[positive], x[~positive], estimate_prior(x[positive], x[~positive]))


def score_quality(docs: DataFrame, model: Model | None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with `score` (0 to 1, higher: label 1 likelier) and `predicted` (1 if score >= threshold).

    Null and empty texts are scored as documents without words.  Without a
    model every score is `threshold`, so nothing is rejected for want of labels.
    Columns of these names in `docs` are replaced; rows stay as they are,
    repeated ones get equal scores, and no rows give none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        if sent.value is None:
            return texts.map(lambda _: threshold)
        # whole texts, some hundred at a time
        import pandas as pd

        out = [sent.value.score(features(pa.array(texts.iloc[a : a + 500], pa.large_string(), from_pandas=True))) for a in range(0, len(texts), 500)]
        return pd.Series(np.concatenate(out) if out else [], dtype=float)

    return docs.withColumn("score", score(F.col(text_col).cast("string"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
