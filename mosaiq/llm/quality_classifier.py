"""A quality classifier of sparse rules.

Statistics of the whole text are Spark columns. Shallow trees are grown on a bounded sample of
labelled rows; every path from a root to a node is a rule, a conjunction of limits on statistics.
A lasso logistic regression keeps few of the rules, and those become one Spark column expression,
so scoring is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words_column

#: Labelled rows that a model is fitted on, at most; chosen by a hash of the id.
SAMPLE = 20_000
TREES, DEPTH, BINS, LEAST_ROWS = 60, 3, 32, 12
#: Lasso penalties tried on a fifth of the sample, strongest first.
PENALTIES = (0.02, 0.01, 0.005, 0.002)

STATISTICS = ("log_words", "mean_word", "longest_word", "symbol_share", "upper_share", "digit_share", "sign_share", "stop_share", "bar_share", "short_share", "distinct_share", "repeat_share", "ending_share", "dup_line_share", "line_words")


def statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row_id and STATISTICS of every row, from its whole text; all 0 for null and empty texts."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.select("doc_id", "text", words_column(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0).alias("lines"))
    df = df.select("*", F.size("w").alias("n"), F.transform("w", lambda x: F.length(x)).alias("lengths"), F.greatest(F.length("text"), F.lit(1)).alias("chars"))
    share = lambda part, whole: part / F.greatest(whole, F.lit(1))
    without = lambda signs: F.col("chars") - F.greatest(F.length(F.translate("text", signs, "")), F.lit(0))
    counted = lambda signs: F.when(F.length("text") > 0, without(signs)).otherwise(0)
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    values = {
        "log_words": F.log1p(F.col("n").cast("double")),
        "mean_word": share(F.aggregate("lengths", F.lit(0), lambda a, x: a + x), F.col("n")),
        "longest_word": F.coalesce(F.array_max("lengths"), F.lit(0)).cast("double"),
        "symbol_share": share(counted("#*$%&<>|"), F.col("chars")),
        "upper_share": share(counted(upper), F.col("chars")),
        "digit_share": share(counted(digits), F.col("chars")),
        "sign_share": share(counted("!?;:=@/\\_~^+\"'()[]{}-"), F.col("chars")),
        "stop_share": share(counted(".,"), F.col("n")),
        "bar_share": share(counted("|!"), F.col("n")),
        "short_share": share(F.size(F.filter("lengths", lambda x: x <= 3)), F.col("n")),
        "distinct_share": share(F.size(F.array_distinct("w")), F.col("n")),
        "repeat_share": share(F.size(F.filter("w", lambda x, i: (i > 0) & (F.get(F.col("w"), i - 1) == x))), F.col("n")),
        "ending_share": share(F.size(F.filter("w", lambda x: x.endswith(".") | x.endswith("!") | x.endswith("?"))), F.col("n")),
        "dup_line_share": share(F.size("lines") - F.size(F.array_distinct("lines")), F.size("lines")),
        "line_words": share(F.col("n"), F.size("lines")),
    }
    return df.select("doc_id", F.monotonically_increasing_id().alias("row_id"), *(F.coalesce(values[k].cast("double"), F.lit(0.0)).alias(k) for k in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """Limits on statistics: (index, above, value) means > value if above, else <= value."""

    limits: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for i, above, value in self.limits:
            out &= x[:, i] > value if above else x[:, i] <= value
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for i, above, value in self.limits:
            out = out & (F.col(STATISTICS[i]) > F.lit(value) if above else F.col(STATISTICS[i]) <= F.lit(value))
        return out


@dataclass
class Model:
    """A logistic score over the rules with a weight."""

    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + sum((w * r.holds(x) for r, w in self.rules), np.zeros(len(x)))

    def column(self) -> Column:
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))


def _grow(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, features: np.ndarray, path: tuple, out: list[Rule], fit: np.ndarray) -> None:
    """Split rows by the largest drop of squared error; add each node's path to out and its mean to fit."""
    fit[rows] = residual[rows].mean()
    if len(path) == DEPTH or len(rows) < 2 * LEAST_ROWS:
        return
    best, choice = 1e-9, None
    total, n = residual[rows].sum(), len(rows)
    for f in features:
        if not len(edges[f]):
            continue
        b = binned[rows, f]
        left_n = np.cumsum(np.bincount(b, minlength=len(edges[f]) + 1))[:-1]
        left = np.cumsum(np.bincount(b, residual[rows], len(edges[f]) + 1))[:-1]
        ok = (left_n >= LEAST_ROWS) & (n - left_n >= LEAST_ROWS)
        gain = np.where(ok, left**2 / np.maximum(left_n, 1) + (total - left) ** 2 / np.maximum(n - left_n, 1) - total**2 / n, 0)
        at = int(np.argmax(gain))
        if gain[at] > best:
            best, choice = float(gain[at]), (int(f), at)
    if choice is None:
        return
    f, at = choice
    value = float(edges[f][at])
    for above in (False, True):
        part = rows[(x[rows, f] > value) == above]
        deeper = (*path, (f, above, value))
        out.append(Rule(tuple(sorted(deeper))))
        _grow(x, binned, edges, residual, part, features, deeper, out, fit)


def extract_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """Paths of boosted trees, each grown on half of the rows and some of the statistics."""
    rng = np.random.default_rng(seed)
    edges = []
    for column in x.T:
        values = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        edges.append(values[values < column.max()])
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    score, rules = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), []
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-score))
        rows = np.sort(rng.choice(len(y), max(2 * LEAST_ROWS, len(y) // 2), replace=len(y) < 4 * LEAST_ROWS))
        features = np.sort(rng.choice(x.shape[1], x.shape[1] * 2 // 3, replace=False))
        found: list[Rule] = []
        _grow(x, binned, edges, residual, np.unique(rows), features, (), found, np.zeros(len(y)))
        rules += found
        leaves = [r for r in found if len(r.limits) == DEPTH or not any(set(r.limits) < set(o.limits) for o in found)]
        for r in leaves:
            hold = r.holds(x)
            if hold.any():
                score[hold] += 0.3 * np.clip(residual[hold].mean() / 0.15, -2, 2)
    kept, seen = [], set()
    for r in dict.fromkeys(rules):
        mask = r.holds(x).tobytes()
        if mask not in seen:
            seen.add(mask)
            kept.append(r)
    return kept


def lasso(holds: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights of a logistic regression on centred 0/1 columns, by accelerated proximal steps."""
    mean = holds.mean(axis=0)
    a = holds - mean
    step = 4.0 / max(1e-9, float(np.linalg.norm(a.T @ a / len(y), 2)) + 1.0)
    w, b = np.zeros(a.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, u, t = w.copy(), b, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(a @ v + u))) - y
        w2 = v - step * (a.T @ error) / len(y)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = u - step * float(error.mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, u = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b - float(mean @ w), w


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of the labelled rows; with one class only, or none, a constant."""
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.5
        return Model(float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    rules = extract_rules(x, y)
    if not rules:
        return Model(float(np.log(y.mean() / (1 - y.mean()))))
    holds = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64)
    test = np.arange(len(y)) % 5 == 4
    losses = []
    for penalty in PENALTIES:
        b, w = lasso(holds[~test], y[~test], penalty)
        z = holds[test] @ w + b
        losses.append(float(np.mean(np.logaddexp(0, z) - y[test] * z)))
    b, w = lasso(holds, y, PENALTIES[int(np.argmin(losses))])
    return Model(b, [(r, float(k)) for r, k in zip(rules, w, strict=True) if k])


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs.

    held_out is a condition on the column doc_id; labels of rows where it holds are not used.
    Null and empty texts have statistics of 0 and a score like others; a null id has no label;
    several labels of an id are all used, null ones not. Without labels the score is 0.5. Rows
    are never merged; other columns are ignored; an empty table gives an empty result.
    """
    rows = materialize(statistics(docs, id_col, text_col), "quality-statistics").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where(F.col("label").isNotNull()).where(~F.coalesce(held_out, F.lit(False)))
    labelled = materialize(rows.join(known, "doc_id").select("label", "row_id", F.xxhash64("doc_id").alias("key"), *STATISTICS), "quality-labelled")
    # Rows far beyond the sample's share of the hash range are left out before the sort, so that tasks send few.
    share = min(1.0, 1.25 * sample / max(1, labelled.count()))
    near = labelled.where(F.pmod("key", F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    chosen = near.orderBy(F.pmod("key", F.lit(1 << 20)), "key", "row_id", "label").limit(sample).select("label", *STATISTICS).toPandas()
    model = fit(chosen[list(STATISTICS)].to_numpy(np.float64), (chosen["label"] > 0).to_numpy(np.float64))
    scored = rows.select("doc_id", "held_out", model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
