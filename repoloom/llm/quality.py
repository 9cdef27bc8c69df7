"""Quality classifier: tree paths as rules over text statistics, lasso weights, compiled to Spark columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_type, keyed, texts_of

SAMPLE = 20_000
TREES = 40
DEPTH = 3
BINS = 48
RATE = 0.3
PENALTY = 0.0015
ACCEPT = 0.7
STATISTICS = ("chars", "words", "word_length", "upper", "digit", "symbol", "other", "marks", "symbol_words", "odd_words", "capital_words",
              "distinct", "top_word", "stop_like", "lines", "line_length", "distinct_lines", "line_ends", "spread")


def statistics(text: str) -> list[float]:
    """The values of STATISTICS for a whole text; an empty one has zeros.

    Counts of characters come from one histogram of the bytes, the others
    from the words and the lines; shares are of what they count over.
    """
    data = text.encode()
    words = data.split()
    if not words:
        return [float(len(text))] + [0.0] * (len(STATISTICS) - 1)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, n = max(1, len(data)), len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    upper, digit, lower = seen[65:91].sum(), seen[48:58].sum(), seen[97:123].sum()
    plain = seen[[44, 46, 39, 45, 63, 34]].sum()
    symbol = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum() - plain
    inner = sum(counts[w] for w in counts if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:?'\")")
    odd = sum(counts[w] for w in counts if not any(97 <= c <= 122 or c >= 128 for c in w))
    capital = sum(counts[w] for w in counts if w.isupper() and len(w) > 1)
    short = sum(c for w, c in counts.items() if len(w) <= 3)
    joined = n - 1 + sum(map(len, words))
    return [
        float(len(text)), float(n), (joined - n + 1) / n, upper / max(1, upper + lower), digit / size, symbol / size, seen[128:].sum() / size,
        plain / n, inner / n, odd / n, capital / n, len(counts) / n, max(counts.values()) / n, short / n, float(len(lines)),
        n / len(lines), len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in b".?!\"'" for x in lines) / len(lines),
        float(np.count_nonzero(seen)) / np.log2(size + 1),
    ]


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one double for each of STATISTICS) of every row; a null text counts as empty."""
    rows = keyed(docs, id_col, text_col)

    def measured(batches):
        for batch in batches:
            values = np.array([statistics(text) for _, text in texts_of([batch])], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in values.T)], names=["id", *STATISTICS])

    return rows.mapInArrow(measured, f"id {id_type(rows)}, " + ", ".join(f"{s} double" for s in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]


def _grow(codes: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, curve: np.ndarray, rows: np.ndarray, path: Rule, depth: int, out: dict, step: np.ndarray) -> None:
    """Split `rows` where the gain is greatest; every node below is a rule in `out`, leaves move `step`."""
    best, total_g, total_h = None, slope[rows].sum(), curve[rows].sum()
    if depth and len(rows) >= 40:
        for f, cut in enumerate(edges):
            g = np.bincount(codes[rows, f], slope[rows], len(cut) + 1).cumsum()[:-1]
            h = np.bincount(codes[rows, f], curve[rows], len(cut) + 1).cumsum()[:-1]
            gain = np.where((h > 1) & (total_h - h > 1), g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1), -1)
            if len(gain) and (best is None or gain.max() > best[0]):
                best = gain.max(), f, int(gain.argmax())
    if best is None or best[0] <= total_g**2 / (total_h + 1) + 1e-3:
        step[rows] = total_g / (total_h + 1)
        return
    _, f, at = best
    low = codes[rows, f] <= at
    for part, side in ((rows[low], True), (rows[~low], False)):
        rule = (*path, (f, side, float(edges[f][at])))
        out[rule] = None
        _grow(codes, edges, slope, curve, part, rule, depth - 1, out, step)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """Paths of boosted trees: conjunctions of (statistic, at most / over, bound)."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    margin, rules = np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        _grow(codes, edges, y - p, p * (1 - p), np.arange(len(y)), (), depth, rules, step)
        margin += RATE * step
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, f] <= bound) == low for f, low, bound in rule])


def lasso(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of the logistic regression with an L1 penalty, by accelerated proximal steps."""
    centre = x.mean(axis=0)
    z = x - centre
    rate = 4 / max(1e-9, np.linalg.norm(z.T @ z / len(y), 2) + 1)
    weights = before = np.zeros(x.shape[1] + 1)
    pull = 1.0
    for _ in range(rounds):
        faster = (1 + np.sqrt(1 + 4 * pull**2)) / 2
        at = weights + (pull - 1) / faster * (weights - before)
        error = 1 / (1 + np.exp(-(at[0] + z @ at[1:]))) - y
        moved = at - rate * np.concatenate(([error.mean()], z.T @ error / len(y)))
        moved[1:] = np.sign(moved[1:]) * np.maximum(np.abs(moved[1:]) - rate * penalty, 0)
        weights, before, pull = moved, weights, faster
    return float(weights[0] - centre @ weights[1:]), weights[1:]


@dataclass(frozen=True)
class RuleModel:
    """A logistic model: an intercept and weighted rules."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The score as a column over the columns of STATISTICS."""
        def one(rule: Rule, weight: float) -> Column:
            tests = [F.col(STATISTICS[f]) <= bound if low else F.col(STATISTICS[f]) > bound for f, low, bound in rule]
            return F.when(reduce(lambda a, b: a & b, tests), F.lit(weight)).otherwise(F.lit(0.0))

        margin = reduce(lambda a, b: a + b, [one(*r) for r in self.rules], F.lit(self.intercept))
        return 1 / (1 + F.exp(-margin))

    def plain_score(self, x: np.ndarray) -> np.ndarray:
        """The same score for rows of statistics on the driver."""
        margin = self.intercept + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Rules from boosted trees, then lasso weights; those of weight zero are left out.

    Without labels every score is 1/2; with labels of one kind there are no
    rules and the score is the share of that kind, smoothed by one row each.
    """
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(share / (1 - share))), ())
    rules = tree_rules(x, y)
    if not rules:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))), ())
    intercept, weights = lasso(np.stack([holds(r, x) for r in rules], axis=1).astype(float), y)
    return RuleModel(intercept, tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose label is never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> RuleModel:
    """A model of labels(id, label) on at most `sample` labelled documents that are not held out.

    The sample is that of the least hashes of the ids, so it is the same in
    every run; a document with several labels has their majority, null labels
    and labels without a document are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(id_col)).groupBy(F.col(id_col).alias("_of")).agg(
        (F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("_y"))
    drawn = known.orderBy(F.xxhash64(F.lit(17), "_of"), "_of").limit(sample)
    # at most `sample` rows of two numbers: a proven bound
    joined = docs.select(id_col, text_col).join(F.broadcast(drawn), F.col(id_col) == F.col("_of"))
    rows = text_statistics(joined.select(F.struct(F.col("_of"), F.col("_y")).alias("k"), F.col(text_col).alias("t")), "k", "t")
    got = rows.select("id._of", "id._y", *STATISTICS).toPandas().drop_duplicates("_of").sort_values("_of")
    return fit(got[list(STATISTICS)].to_numpy(float), got["_y"].to_numpy(float))


def quality_scores(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, null and empty texts too; no input but the text counts."""
    scored = text_statistics(docs, id_col, text_col).withColumn("score", model.score())
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: RuleModel, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The rows of docs that score at least `accept`, unchanged and in the same columns."""
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text_col).alias("t"))
    kept = text_statistics(whole, "row", "t").where(model.score() >= accept)
    return kept.select(*[F.col(f"id.{c}").alias(c) for c in docs.columns])
