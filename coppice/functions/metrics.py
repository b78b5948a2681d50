"""Classification metrics of confusions. A confusion is built from groups that each predict one class."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .criteria import total

OBJECTIVES = ("precision", "recall", "f1", "fbeta", "accuracy")
AVERAGES = ("binary", "micro", "macro", "weighted")


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def argmax(counts: Sequence[Column]) -> Column:
    """The class with the largest count, the lowest of equal ones; 0 without rows."""
    best, at = counts[0], F.lit(0)
    for i, c in enumerate(counts[1:], 1):
        best, at = F.greatest(best, c), F.when(c > best, F.lit(i)).otherwise(at)
    return at


@dataclass(frozen=True)
class Confusion:
    tp: tuple[Column, ...]
    fp: tuple[Column, ...]
    fn: tuple[Column, ...]
    support: tuple[Column, ...]
    total: Column


def confusion(groups: Sequence[tuple[Column, Sequence[Column]]]) -> Confusion:
    """groups: (predicted class, counts by true class)."""
    k = len(groups[0][1])
    tp = tuple(total([F.when(p == c, counts[c]).otherwise(0) for p, counts in groups]) for c in range(k))
    predicted = [total([F.when(p == c, total(counts)).otherwise(0) for p, counts in groups]) for c in range(k)]
    support = tuple(total([counts[c] for _, counts in groups]) for c in range(k))
    fp = tuple(predicted[c] - tp[c] for c in range(k))
    fn = tuple(support[c] - tp[c] for c in range(k))
    return Confusion(tp, fp, fn, support, total(support))


def averaged(cm: Confusion, average: str, f: Callable[[Column, Column, Column], Column], pos_label: int = 1) -> Column:
    """binary: the positive class, 0 if there is no such class; micro: pooled counts; macro: over all classes."""
    k = range(len(cm.tp))
    if average == "binary":
        return f(cm.tp[pos_label], cm.fp[pos_label], cm.fn[pos_label]) if pos_label in k else F.lit(0.0)
    if average == "micro":
        return f(total(cm.tp), total(cm.fp), total(cm.fn))
    each = [f(cm.tp[c], cm.fp[c], cm.fn[c]) for c in k]
    if average == "macro":
        return total(each) / len(each)
    if average == "weighted":
        return safe_div(total([cm.support[c] * each[c] for c in k]), cm.total)
    raise ValueError(f"average must be one of {AVERAGES}, got {average!r}")


def metric(cm: Confusion, objective: str | Callable[[Confusion], Column], average: str = "binary", pos_label: int = 1, beta: float = 1.0) -> Column:
    """A callable gets the confusion and returns a column; larger is better."""
    if callable(objective):
        return objective(cm)
    b = float(beta) ** 2
    forms = {
        "precision": lambda tp, fp, fn: safe_div(tp, tp + fp),
        "recall": lambda tp, fp, fn: safe_div(tp, tp + fn),
        "f1": lambda tp, fp, fn: safe_div(2.0 * tp, 2.0 * tp + fp + fn),
        "fbeta": lambda tp, fp, fn: safe_div((1 + b) * tp, (1 + b) * tp + b * fn + fp),
    }
    if objective == "accuracy":
        return safe_div(total(cm.tp) * 1.0, cm.total)
    if objective not in forms:
        raise ValueError(f"objective must be one of {OBJECTIVES}, got {objective!r}")
    return averaged(cm, average, forms[objective], pos_label)
