"""Quality classifier: a sparse rule ensemble in column expressions (operator 2).

Statistics of a text are Spark columns.  On a bounded sample of labelled rows boosted trees
are grown; their paths are conjunctive rules, and logistic weights with a lasso penalty keep
a few of them.  The rules kept are compiled to one Spark column, so that scoring runs no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import trees
from tessera.llm.common import least_by_hash, remainder

#: One test of a rule: feature, whether at most (else above), threshold.
Test = tuple[str, bool, float]
MAX_LABELLED = 20_000
_SPACE = r"[\x20\x09-\x0D]+"


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, *,
                    limit: int = MAX_LABELLED) -> DataFrame:
    """Documents (doc_id, text) with column ``label``; at most ``limit`` labels, those of the
    least hashes of their ids, so that each label is as likely to be taken.  Rows without an id
    or a label are no use and left out; of several labels of one id the least counts."""
    known = (labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna()
             .groupBy("doc_id").agg(F.min("label").alias("label")))
    picked = least_by_hash(known, "doc_id", limit)
    # Broadcast: the limit bounds it.
    return documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def statistics(df: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """Add the statistics that rules test; null text counts as empty.  Returns their names too."""
    counted = df.withColumn("_t", F.coalesce(text, F.lit(""))).withColumn(
        "_w", F.filter(F.split("_t", _SPACE), lambda w: w != ""))
    t = F.col("_t")

    def hits(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)).cast("double")

    counted = counted.select(
        *df.columns, F.size("_w").cast("double").alias("_n"),
        F.size(F.array_distinct("_w")).cast("double").alias("_distinct"),
        F.length("_t").cast("double").alias("_chars"),
        hits(r"\p{Lu}").alias("_upper"),
        hits(r"(?<!\S)(\S++)(?=\s+\1(?!\S))").alias("_adjacent"),
        hits(r"[#*$%&<>~^=_{}\\@]").alias("_symbols"),
        hits(r"\|").alias("_bars"), hits(r"!").alias("_shouts"),
        hits(r"[.,;:?]").alias("_marks"), hits(r"[0-9]").alias("_digits"),
        hits(r"\n").alias("_breaks"))
    n = F.greatest("_n", F.lit(1.0))
    made = {
        "log_words": F.log1p("_n"), "chars_per_word": F.col("_chars") / n,
        "distinct_share": F.col("_distinct") / n, "upper_per_word": F.col("_upper") / n,
        "adjacent_share": F.col("_adjacent") / n, "symbols_per_word": F.col("_symbols") / n,
        "bars_per_word": F.col("_bars") / n, "shouts_per_word": F.col("_shouts") / n,
        "marks_per_word": F.col("_marks") / n, "digits_per_word": F.col("_digits") / n,
        "breaks_per_word": F.col("_breaks") / n,
    }
    return counted.select(*df.columns, *(c.alias(f"s_{k}") for k, c in made.items())), \
        [f"s_{k}" for k in made]


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[float, tuple[Test, ...]], ...]

    def score(self) -> Column:
        """Probability of label 1 as one expression over the statistics."""
        z = F.lit(self.intercept)
        for weight, tests in self.rules:
            holds = F.lit(True)
            for name, below, threshold in tests:
                test = F.col(name) <= threshold if below else F.col(name) > threshold
                holds = holds & test
            z = z + F.when(holds, F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-z))


def paths(node: trees.Node, names: list[str], above: tuple[Test, ...] = ()) -> set[tuple[Test, ...]]:
    """Conjunctions from the root to every other node of a tree."""
    out = {above} if above else set()
    if node.feature >= 0:
        name, at = names[node.feature], node.threshold
        out |= paths(node.left, names, (*above, (name, True, at)))
        out |= paths(node.right, names, (*above, (name, False, at)))
    return out


def fit(x: np.ndarray, y: np.ndarray, names: list[str], *, rounds: int = 24, depth: int = 3,
        penalty: float = 5e-4) -> RuleModel:
    """Rules from boosted trees, weighted by a lasso; without both classes a constant."""
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if not len(y) or y.min() == y.max():
        return RuleModel(prior, ())
    _, grown = trees.boost(x, y, rounds=rounds, depth=depth)
    rules = sorted(set().union(*(paths(t, names) for t in grown)))
    column = {name: i for i, name in enumerate(names)}
    holds = np.ones((len(y), len(rules)))
    for j, tests in enumerate(rules):
        for name, below, at in tests:
            low = x[:, column[name]] <= at
            holds[:, j] *= low if below else ~low
    intercept, weights = trees.lasso_logistic(holds, y, penalty)
    kept = tuple((float(w), rules[j]) for j, w in enumerate(weights) if w)
    return RuleModel(float(intercept), kept)


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", *,
          limit: int = MAX_LABELLED) -> RuleModel:
    """Fit on at most ``limit`` labelled rows; only their statistics reach the driver."""
    sample, names = statistics(labelled_sample(documents, labels, label, limit=limit))
    rows = sample.select("doc_id", "label", *names).orderBy("doc_id").toPandas()
    return fit(rows[names].to_numpy(float).reshape(-1, len(names)),
               rows["label"].to_numpy(float), names)


def classify(documents: DataFrame, labels: DataFrame, *, folds: int = 5, held: int = 0,
             threshold: float = 0.3, limit: int = MAX_LABELLED) -> DataFrame:
    """Score every document; labels are learnt from outside the held-out fold only."""
    model = train(documents, labels.filter(remainder("doc_id", folds) != held), limit=limit)
    counted, _ = statistics(documents.select("doc_id", "text"))
    return counted.select(
        "doc_id", F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out"),
        model.score().alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
