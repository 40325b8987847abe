"""A quality classifier made of rules: paths of small trees over text statistics, weighted by a lasso logistic regression
and compiled into one Spark column.

Nothing but the statistics goes into a score. The model is fitted on the driver from at most `max_rows` labelled rows,
those whose ids hash lowest (a bounded sample; all else runs over all rows).

Nulls: a null text has the statistics of an empty one, and a score. Rows with a null label or id don't take part in the
fit; several labels of one id count as the largest, and of several texts of one id that with the least statistics. With
labels of one kind, or none, the score is their share (0.5). Repeated rows are scored each; texts of any length are read
whole; other columns stay, whatever their names. An empty table gives no rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 6000
STATISTICS = ("log_chars", "word_length", "symbols", "pipes", "exclamations", "capitals", "digits", "distinct_words", "repeats", "line_words", "distinct_lines", "stops")


def with_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with a column `_s`: the statistics, as a struct of doubles."""
    return _statistics(docs, text_col).select("doc.*", "_s")


def _statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """(doc, _s): the whole rows, so that no column's name can clash, and their statistics."""
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    base = held.withColumn("_t", F.coalesce(F.col("doc")[text_col], F.lit(""))).withColumn("_w", F.split(F.regexp_replace(F.trim("_t"), r"[\s]+", " "), " ")).withColumn("_l", F.split("_t", "\n"))
    n = F.greatest(F.length("_t"), F.lit(1)).cast("double")
    words = F.size("_w").cast("double")

    def share(marks: str) -> Column:
        return (F.length("_t") - F.length(F.translate("_t", marks, ""))) / n

    repeats = F.size(F.filter(F.col("_w"), lambda w, i: (i > 0) & (w == F.get(F.col("_w"), i - 1))))
    columns = {
        "log_chars": F.log1p(F.length("_t").cast("double")),
        "word_length": n / words,
        "symbols": share("*$%&#@^~<>{}[]=_\\/"),
        "pipes": share("|"),
        "exclamations": share("!?"),
        "capitals": F.regexp_count("_t", F.lit(r"\p{Lu}")) / n,
        "digits": share("0123456789"),
        "distinct_words": F.size(F.array_distinct("_w")) / words,
        "repeats": repeats / words,
        "line_words": words / F.size("_l"),
        "distinct_lines": F.size(F.array_distinct("_l")) / F.size("_l").cast("double"),
        "stops": share(".") * n / words,
    }
    row = F.struct(*(columns[k].cast("double").alias(k) for k in STATISTICS))
    # generated, not projected: a filter on the score is pushed through a projection, and then each condition of each rule computes its statistic anew
    return base.select("doc", F.explode(F.array(row)).alias("_s"))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, whether above, threshold) hold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, at in self.conditions:
            v = x[:, STATISTICS.index(name)]
            out &= (v > at) if above else (v <= at)
        return out

    def column(self, statistics: Column) -> Column:
        out = F.lit(True)
        for name, above, at in self.conditions:
            v = statistics[name]
            out = out & ((v > F.lit(at)) if above else (v <= F.lit(at)))
        return out


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z = z + weight * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, statistics: Column) -> Column:
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(statistics), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(x: np.ndarray, gradient: np.ndarray, rows: np.ndarray, features: np.ndarray, depth: int, path: tuple, out: list[tuple[tuple, np.ndarray]], least: int) -> None:
    """Splits rows where the squared error of the gradient falls most; each node but the root goes to out."""
    if path:
        out.append((path, rows))
    if depth == 0 or len(rows) < 2 * least:
        return
    best, g = (1e-9, None, None), gradient[rows]
    for f in features:
        v = x[rows, f]
        order = np.argsort(v, kind="stable")
        vs, left = v[order], np.cumsum(g[order])
        k = np.arange(1, len(rows))
        gain = left[:-1] ** 2 / k + (left[-1] - left[:-1]) ** 2 / (len(rows) - k) - left[-1] ** 2 / len(rows)
        gain[(vs[1:] <= vs[:-1]) | (k < least) | (k > len(rows) - least)] = 0
        if len(gain) and gain.max() > best[0]:
            j = int(gain.argmax())
            best = (gain[j], f, float((vs[j] + vs[j + 1]) / 2))
    _, f, at = best
    if f is None:
        return
    above = x[rows, f] > at
    for side in (False, True):
        _grow(x, gradient, rows[above == side], features, depth - 1, (*path, (STATISTICS[f], side, at)), out, least)


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 24, depth: int = 3, rate: float = 0.3, penalty: float = 0.002, seed: int = 7) -> Model:
    """Boosted trees on random halves of rows and statistics give the rules; proximal gradient descent their weights."""
    if not len(y) or y.min() == y.max():
        share = min(0.99, max(0.01, float(y.mean()))) if len(y) else 0.5
        return Model(math.log(share / (1 - share)), ())
    draw = np.random.default_rng(seed)
    z, rules = np.full(len(y), math.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        rows = draw.permutation(len(y))[: max(2, len(y) // 2)]
        features = draw.permutation(len(STATISTICS))[: -(-len(STATISTICS) // 2)]
        nodes: list[tuple[tuple, np.ndarray]] = []
        gradient = y - 1 / (1 + np.exp(-z))
        _grow(x, gradient, rows, features, depth, (), nodes, max(3, len(y) // 400))
        for path, _ in nodes:
            rule = Rule(path)
            rules[rule] = None
        leaves = [p for p, _ in nodes if not any(q[: len(p)] == p and len(q) > len(p) for q, _ in nodes)]
        for path in leaves:
            on = Rule(path).holds(x)
            p = 1 / (1 + np.exp(-z[on]))
            z[on] += rate * float(np.clip(gradient[on].sum() / max(1e-6, (p * (1 - p)).sum()), -4, 4))
    kept, a, seen = [], [], set()
    for rule in rules:
        on = rule.holds(x)
        if (key := on.tobytes()) not in seen and 0 < on.sum() < len(y):
            seen.add(key)
            kept.append(rule)
            a.append(on)
    if not kept:
        return Model(math.log(y.mean() / (1 - y.mean())), ())
    a = np.column_stack(a).astype(float)
    step = 4 / (np.linalg.norm(np.column_stack([np.ones(len(y)), a]), 2) ** 2 / len(y))
    w = np.zeros(a.shape[1])
    b = b_ahead = math.log(y.mean() / (1 - y.mean()))
    ahead, t = w, 1.0
    for _ in range(1500):
        e = 1 / (1 + np.exp(-(b_ahead + a @ ahead))) - y
        new = ahead - step * (a.T @ e) / len(y)
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * penalty)
        new_b = b_ahead - step * e.mean()
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead, b_ahead = new + (before - 1) / t * (new - w), new_b + (before - 1) / t * (new_b - b)
        w, b = new, new_b
    return Model(float(b), tuple((r, float(v)) for r, v in zip(kept, w) if abs(v) > 1e-6))


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Model:
    """A model from at most max_rows of the labels given (rows to be held out must be taken away before)."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    some = one.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), F.col("id") == F.col("_id"))  # max_rows rows at most
    each = _statistics(known, "text").select("doc._id", F.col("doc._y").cast("double").alias("_y"), "_s")
    rows = each.groupBy("_id", "_y").agg(F.min("_s").alias("_s")).select("_id", "_y", "_s.*").toPandas().sort_values("_id")
    return fit(rows[list(STATISTICS)].to_numpy(float), rows["_y"].to_numpy(float))


def with_score(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with the columns score and predicted (1 from `threshold`) besides, in the place of any of these names."""
    scored = _statistics(docs, text_col).select("doc", model.column(F.col("_s")).alias("score"))
    return scored.select(*(F.col("doc")[c].alias(c) for c in docs.columns if c not in ("score", "predicted")), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(id_col: Column) -> Column:
    """Whether an id is kept from the fit: CRC-32 of its text modulo 4 is 2. A null id is kept from it too."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))
