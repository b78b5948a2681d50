"""A plain-Python tree with the same rules, on lists; what the Spark fit is compared with."""

from __future__ import annotations

import hashlib
import math
import statistics


def finite(v):
    return v is not None and math.isfinite(v)


def edges_of(values, n_bins):
    v = sorted(x for x in values if finite(x))
    return [v[min(i * len(v) // n_bins, len(v) - 1)] for i in range(1, n_bins)] if v else []


def code_of(edges, v):
    return sum(e <= v for e in edges) if finite(v) else None


def folds_of(ids, k, seed):
    n = len(ids)
    k = min(max(k, 2), n)
    order = sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{n}:{i}".encode()).hexdigest(), i))
    size, longer = divmod(n, k)
    out = {}
    for place, i in enumerate(order):
        cut = longer * (size + 1)
        out[i] = place // (size + 1) if place < cut else longer + (place - cut) // size
    return out, k


def impurity(ys, kind):
    n = len(ys)
    if not n:
        return 0.0
    if kind in ("gini", "entropy"):
        shares = [ys.count(c) / n for c in set(ys)]
        return 1 - sum(p * p for p in shares) if kind == "gini" else -sum(p * math.log2(p) for p in shares)
    if kind == "mae":
        m = statistics.median(ys)
        return sum(abs(y - m) for y in ys) / n
    return max(sum(y * y for y in ys) / n - (sum(ys) / n) ** 2, 0.0)


def metric(groups, k, name, average, pos, beta):
    """groups: (predicted class, validation labels)."""
    tp, fp, fn, sup = ([0] * k for _ in range(4))
    for c, ys in groups:
        for y in ys:
            sup[y] += 1
            if y == c:
                tp[c] += 1
            else:
                fp[c] += 1
                fn[y] += 1
    div = lambda a, b: a / b if b > 0 else 0.0
    b2 = beta * beta if name == "fbeta" else 1.0
    f = {"precision": lambda t, p, n: div(t, t + p), "recall": lambda t, p, n: div(t, t + n)}.get(name, lambda t, p, n: div((1 + b2) * t, (1 + b2) * t + b2 * n + p))
    if name == "accuracy":
        return div(sum(tp), sum(sup))
    if average == "binary":
        return f(tp[pos], fp[pos], fn[pos]) if pos < k else 0.0
    if average == "micro":
        return f(sum(tp), sum(fp), sum(fn))
    each = [f(tp[c], fp[c], fn[c]) for c in range(k)]
    return sum(each) / k if average == "macro" else div(sum(s * e for s, e in zip(sup, each)), sum(sup))


def reduce_scores(s, how, frac=0.1, eps=1e-12, lam=1.0):
    s = sorted(s)
    mean, std = sum(s) / len(s), statistics.pstdev(s)
    if how == "median":
        return statistics.median(s)
    if how == "trimmed_mean":
        cut = min(int(len(s) * frac), (len(s) - 1) // 2)
        kept = s[cut : len(s) - cut]
        return sum(kept) / len(kept)
    return {"mean": mean, "signal_to_noise": mean / (std + eps), "mean_minus_lambda_std": mean - lam * std}[how]


def majority(ys):
    return min(range(max(ys) + 1), key=lambda c: (-ys.count(c), c)) if ys else 0


def fit(x, y, *, categorical=(), k_classes=0, criterion="gini", objective=None, average="binary", pos=1, beta=1.0, mode="strict", style="threshold", max_depth=8,
        min_split=2, min_leaf=1, min_gain=0.0, n_bins=8, folds=5, seed=42, how="mean"):
    """A nested dict: {'n', 'value'} or {'rule', 'left', 'right'}; row ids are positions."""
    d = len(x[0])
    every = range(len(x))
    whole = {f: edges_of([x[i][f] for i in every], n_bins) for f in range(d) if f not in categorical}

    def grow(ids, depth):
        ys = [y[i] for i in ids]
        leaf = {"n": len(ids), "value": [ys.count(c) / len(ys) for c in range(k_classes)] if k_classes else sum(ys) / len(ys)}
        if len(ids) < max(min_split, 2) or depth >= max_depth or min(ys) == max(ys):
            return leaf
        fold, k = folds_of(ids, folds, seed)
        found = []
        own = {f: edges_of([x[i][f] for i in ids], n_bins) for f in range(d) if f not in categorical}
        for f in range(d):
            cat = f in categorical
            cut = style == "threshold" and not cat
            base = (whole if mode == "fast" else own).get(f)
            states = sorted({x[i][f] if cat else code_of(base, x[i][f]) for i in ids if finite(x[i][f])})
            for s in states:
                if cut and mode == "fast" and s >= len(base):
                    continue
                scores = []
                for g in range(k):
                    e = base if mode == "fast" or cat else edges_of([x[i][f] for i in ids if fold[i] != g], n_bins)

                    def left(i):
                        if not finite(x[i][f]):
                            return False
                        c = x[i][f] if cat else code_of(e, x[i][f])
                        return c <= s if cut else c == s

                    use = [i for i in ids if mode == "strict" or finite(x[i][f])]
                    val, train = [i for i in use if fold[i] == g], [i for i in use if fold[i] != g]
                    vl, vr = [y[i] for i in val if left(i)], [y[i] for i in val if not left(i)]
                    if not vl or not vr:
                        continue
                    if objective:
                        tl, tr = [y[i] for i in train if left(i)], [y[i] for i in train if not left(i)]
                        if not tl or not tr:
                            continue
                        m = lambda groups: metric(groups, k_classes, objective, average, pos, beta)
                        scores.append(m([(majority(tl), vl), (majority(tr), vr)]) - m([(majority(tl + tr), vl + vr)]))
                    else:
                        n = len(val)
                        scores.append(impurity(vl + vr, criterion) - (len(vl) * impurity(vl, criterion) + len(vr) * impurity(vr, criterion)) / n)
                if scores:
                    score = reduce_scores(scores, how)
                    if math.isfinite(score):
                        found.append((-round(score, 12), f, s, score))
        if not found or min(found)[3] <= min_gain:
            return leaf
        _, f, s, _ = min(found)
        if f in categorical:
            rule = ("cat", f, s)
            goes = lambda i: x[i][f] == s
        else:
            e = (whole if mode == "fast" else own)[f]
            hi = e[s] if s < len(e) else math.inf
            lo = -math.inf if style == "threshold" or s == 0 else e[s - 1]
            if style == "threshold" and math.isinf(hi):
                return leaf
            rule = ("num", f, lo, hi)
            goes = lambda i: finite(x[i][f]) and lo <= x[i][f] < hi
        a, b = [i for i in ids if goes(i)], [i for i in ids if not goes(i)]
        if min(len(a), len(b)) < max(min_leaf, 1):
            return leaf
        return {"rule": rule, "left": grow(a, depth + 1), "right": grow(b, depth + 1)}

    return grow(list(every), 0)
