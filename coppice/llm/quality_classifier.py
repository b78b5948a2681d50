"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

A pass over whole texts counts characters, words and lines and transforms the counts to near-Gaussian features.
Class moments (count, sum, outer products) add up over all labelled training rows; the driver shrinks the two
covariances and factors them once. Scores are the logistic of the difference of the Mahalanobis log-densities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import narrowed, table, text_bytes

FEATURES = (
    "log_words", "log_word_length", "upper", "symbol", "pipe", "mark", "digit", "stop",
    "repeat_next", "distinct", "line_words", "wide",
)
#: Weight of the pooled diagonal in each class covariance.
SHRINKAGE = 0.1
#: Added to every variance: features are of order one.
RIDGE = 1e-3
THRESHOLD = 0.3

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_MULTIPLIERS = np.random.default_rng(17).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def _of(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _of(bytes(range(65, 91))), _of(b"0123456789")
_SYMBOL, _PIPE, _MARK, _STOP = _of(b"#*$%&<>"), _of(b"|"), _of(b"!?"), _of(b".,;:")
_LETTER = _of(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC2, 0xF5)))


def statistics(text: bytes) -> list[float]:
    """The features of one whole text in UTF-8. Counts are smoothed, so the empty text has features, too."""
    c = np.frombuffer(text, np.uint8)
    space = _SPACE[c]
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate(([True], space[:-1]))) if len(c) else np.empty(0, np.int64)
    words = len(starts)
    chars = int(inside.sum())
    hist = np.bincount(c, minlength=256)
    count = lambda which: int(hist[which].sum())
    letters = count(_LETTER)
    lines = int(hist[10]) + 1
    repeats, distinct = 0, words
    if words > 1:
        at = np.flatnonzero(inside)
        first = np.searchsorted(at, starts)
        place = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
        coded = (c[at].astype(np.uint64) + np.uint64(1)) * _MULTIPLIERS[place & 63] * (np.uint64(2) * (place >> 6).astype(np.uint64) + np.uint64(1))
        hashes = np.add.reduceat(coded, first)
        repeats = int((hashes[1:] == hashes[:-1]).sum())
        whole = words - words % 512
        distinct = 0  # of each window of 512 words and of the shorter one at the end
        for window in (hashes[:whole].reshape(-1, 512), hashes[None, whole:]):
            if window.size:
                ordered = np.sort(window, axis=1)
                distinct += int((ordered[:, 1:] != ordered[:, :-1]).sum()) + len(ordered)
    ratio = lambda a, b, k=4.0: (a / (b + k)) ** 0.5
    return [
        np.log1p(words), np.log((chars + 20.0) / (words + 4.0)), ratio(count(_UPPER), letters, 20.0), ratio(count(_SYMBOL), words), ratio(count(_PIPE), words),
        ratio(count(_MARK), words), ratio(count(_DIGIT), chars, 20.0), ratio(count(_STOP), words), ratio(repeats, words), (distinct + 4.0) / (words + 4.0) / (1 + np.log1p(min(words, 512)) / 20),
        np.log((words + 5.0) / (lines + 1.0)), ratio(letters - count(_of(bytes(range(65, 91)) + bytes(range(97, 123)))), letters, 20.0),
    ]


def _features(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        x = [statistics(t) for t in text_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])


def _moments(batches: Iterator) -> Iterator:
    import pandas as pd

    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        for label, rows in pdf.groupby("label")["x"]:
            x = np.column_stack([np.ones(len(rows)), np.stack(rows.to_numpy())])
            total[label] = total.get(label, 0) + x.T @ x
    if total:
        yield pd.DataFrame({"label": list(total), "m": [m.ravel() for m in total.values()]})


def _added(pdf):
    import pandas as pd

    rows = sorted(map(tuple, pdf["m"]))
    return pd.DataFrame({"label": pdf["label"].iloc[:1], "m": [np.sum(rows, axis=0)]})


class Discriminant:
    """Class means and Cholesky factors of the shrunk covariances; plain arrays of a fixed small size."""

    def __init__(self, moments: dict[int, np.ndarray], shrinkage: float = SHRINKAGE, ridge: float = RIDGE):
        self.base = (moments[1][0, 0] / sum(m[0, 0] for m in moments.values())) if 1 in moments else (0.0 if moments else 0.5)
        self.classes = []
        if len(moments) < 2:
            return
        n = {c: m[0, 0] for c, m in moments.items()}
        mean = {c: m[0, 1:] / n[c] for c, m in moments.items()}
        cov = {c: m[1:, 1:] / n[c] - np.outer(mean[c], mean[c]) for c, m in moments.items()}
        pooled = sum(n[c] * cov[c] for c in n) / sum(n.values())
        target = np.diag(np.diag(pooled)) + ridge * np.eye(len(pooled))
        for c in (0, 1):
            a = max(shrinkage, len(pooled) / (len(pooled) + n[c]))
            low = np.linalg.cholesky((1 - a) * cov[c] + a * target)
            self.classes.append((mean[c], np.linalg.inv(low), 2 * np.log(np.diag(low)).sum(), np.log(n[c] / sum(n.values()))))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.base)
        g = [-0.5 * (((x - mean) @ inv.T) ** 2).sum(axis=1) - 0.5 * logdet + prior for mean, inv, logdet, prior in self.classes]
        return np.round(1 / (1 + np.exp(np.clip(g[0] - g[1], -700, 700))), 9)


def fit(features: DataFrame, labels: DataFrame, **params) -> Discriminant:
    """features: doc_id, x. labels: doc_id, label; other labels than 0 and 1 and null ids are left out."""
    rows = features.join(labels.where(F.col("label").isin(0, 1)), "doc_id").select(F.col("label").cast("int").alias("label"), "x")
    sums = rows.mapInPandas(_moments, "label int, m array<double>").groupBy("label").applyInPandas(_added, "label int, m array<double>")
    side = len(FEATURES) + 1
    return Discriminant({r["label"]: np.array(r["m"]).reshape(side, side) for r in sums.collect()}, **params)


def _scored(model: Discriminant, x_at: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = batch.column(x_at)
            scores = model.score(np.array(x.flatten()).reshape(batch.num_rows, -1)) if batch.num_rows else np.empty(0)
            kept = [batch.column(i) for i in range(batch.num_columns) if i != x_at]
            names = [n for i, n in enumerate(batch.schema.names) if i != x_at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], [*names, "score"])

    return run


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, Discriminant]:
    features = table(
        narrowed(docs, doc_id=id_col, text=text_col)
        .select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .mapInArrow(_features, "doc_id long, x array<double>"),
        "quality-features",
    )
    train = narrowed(labels, doc_id=id_col, label=label_col).where(~held_out())
    return features, fit(features, train)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``, repeated rows too.

    Null and empty texts have the features of no words. Rows of unknown, null or repeated ids are scored like any
    other; each label row of a repeated id counts in the fit. With labels of one class, or none, every score is the
    base rate (0.5 without labels). Only id and text are read. An empty table gives an empty result.
    """
    features, model = _model(docs, labels, id_col, text_col, label_col)
    return (
        features.mapInArrow(_scored(model, 1), "doc_id long, score double")
        .select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, with their columns, that the classifier does not reject; scores and filters in one pass."""
    _, model = _model(docs, labels, "doc_id", "text", "quality")
    at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            x = [statistics(t) for t in text_bytes(batch.column(at))]
            if x:
                yield batch.filter(_arrow(model.score(np.array(x)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def _arrow(mask: np.ndarray):
    import pyarrow as pa

    return pa.array(mask)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
