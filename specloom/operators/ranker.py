"""Learning to rank on Spark ML: features, labels, training, cross-validation, promotion."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions import scoring as S
from specloom.operators.feedback import kfold
from specloom.operators.metrics import OVERALL, ndcg_metrics
from specloom.operators.ranking import minmax, topk
from specloom.session import cut_lineage

FEATURES = ["dense_score", "bm25_score_normalized", "cross_encoder_score", "recency_score", "category_match",
            "keyword_overlap", "historical_acceptance_rate"]


def attach_scores(candidates: DataFrame, tables: dict[str, DataFrame], defaults: dict[str, float]) -> DataFrame:
    """Left-join channel scores (query, doc, score) onto (query, doc); a missing score takes its default."""
    out = candidates
    for name, scores in tables.items():
        renamed = scores.select("query", "doc", F.col("score").alias(name))
        out = out.join(renamed, ["query", "doc"], "left").withColumn(name, F.coalesce(name, F.lit(float(defaults[name]))))
    return out


def ltr_features(candidates: DataFrame, tables: dict[str, DataFrame], queries: DataFrame, corpus: DataFrame,
                 rates: DataFrame, year: int, lexicon=None) -> DataFrame:
    """The seven ranking features of each (query, doc) candidate.

    ``tables`` has ``dense``, ``bm25`` and ``cross`` score tables; ``corpus(doc, category, keywords,
    last_amended)``; ``rates(doc, rate)``.
    """
    c = attach_scores(candidates.select("query", "doc"), tables, {"dense": 0.0, "bm25": 0.0, "cross": -10.0})
    c = minmax(c, ["query"], "bm25", "bm25_score_normalized")
    c = c.join(queries.select("query", "text"), "query").join(corpus, "doc").join(rates.select("doc", "rate"), "doc", "left")
    return c.select(
        "query", "doc", F.col("dense").alias("dense_score"), "bm25_score_normalized", F.col("cross").alias("cross_encoder_score"),
        S.recency("last_amended", year).alias("recency_score"), S.category_match("text", "category", lexicon).alias("category_match"),
        S.keyword_overlap("text", "keywords").alias("keyword_overlap"), F.coalesce("rate", F.lit(0.0)).alias("historical_acceptance_rate"))


def graded_labels(candidates: DataFrame, gold: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query, doc, label): 3 for the gold record, 1 for its category, else 0; gold joins every pool."""
    pool = candidates.select("query", "doc").unionByName(gold.select("query", "doc")).distinct()
    about = corpus.select("doc", "category")
    right = gold.join(about, "doc").select("query", F.col("doc").alias("_g"), F.col("category").alias("_gc"))
    label = F.when(F.col("doc") == F.col("_g"), 3).when(F.col("category") == F.col("_gc"), 1).otherwise(0)
    return pool.join(about, "doc").join(right, "query").select("query", "doc", label.alias("label"))


def assemble(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


@dataclass
class ListwiseRanker:
    """A linear ranker trained on the order of whole result lists."""

    features: list[str]
    coefficients: list[float]

    def score(self):
        return sum((F.col(f) * float(c) for f, c in zip(self.features, self.coefficients)), F.lit(0.0))


def lambda_gradients(x: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LambdaRank for one list: gradient and curvature (features x features) of the pairwise logistic loss, each pair of unequal
    labels weighted by what swapping the two changes in the list's NDCG. Documents of one score stand in their given order."""
    n = len(x)
    place = np.empty(n, np.int64)
    place[np.argsort(-scores, kind="stable")] = np.arange(n)
    discount, gain = 1 / np.log2(place + 2), 2.0 ** labels - 1
    ideal = (np.sort(gain)[::-1] / np.log2(np.arange(n) + 2)).sum()
    better, worse = np.nonzero(labels[:, None] > labels[None, :])
    if not len(better) or not ideal:
        return np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))
    change = np.abs((gain[better] - gain[worse]) * (discount[better] - discount[worse])) / ideal
    wrong = 1 / (1 + np.exp(np.clip(scores[better] - scores[worse], -500, 500)))
    apart = x[better] - x[worse]
    return -(apart * (change * wrong)[:, None]).sum(0), (apart * (change * wrong * (1 - wrong))[:, None]).T @ apart


def train_listwise(train: DataFrame, features: list[str] = FEATURES, rounds: int = 20, ridge: float = 1e-3, most: int = 2000) -> ListwiseRanker:
    """Fit a linear ranker by LambdaRank with Newton steps: each round sums the gradients and curvatures of all lists.

    A list is the candidate pool of one query, so its pairs are bounded by the pool; a query with more than ``most`` candidates is an
    error and not cut. Only features x features numbers come to the driver in a round. Features are scaled to unit deviation.
    """
    pools = train.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("doc", F.col("label").cast("double").alias("label"), F.array(*[F.col(f).cast("double") for f in features]).alias("x")))).alias("rows"))
    too_long = F.raise_error(F.concat(F.lit("a candidate pool has rows: "), F.col("n").cast("string")))
    pools = pools.select(F.when(F.col("n") <= most, F.col("rows.label")).otherwise(too_long).alias("labels"), F.flatten("rows.x").alias("x"))
    pools = cut_lineage(pools.repartition(train.sparkSession.sparkContext.defaultParallelism))
    spread = train.agg(*[F.stddev_pop(f).alias(f) for f in features]).first()
    scale = np.array([spread[f] or 1.0 for f in features])
    k = len(features)
    weights = np.zeros(k)
    for _ in range(rounds):
        now = weights.copy()

        def sums(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            gradient, curve, lists = np.zeros(k), np.zeros((k, k)), 0
            for b in batches:
                for labels, x in zip(b["labels"], b["x"]):
                    x = np.asarray(x, np.float64).reshape(-1, k) / scale
                    g, c = lambda_gradients(x, np.asarray(labels), x @ now)
                    gradient, curve, lists = gradient + g, curve + c, lists + 1
            yield pd.DataFrame({"i": np.arange(k * k + k + 1), "v": np.concatenate([gradient, curve.ravel(), [lists]])})

        total = np.zeros(k * k + k + 1)
        for r in pools.mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            total[r["i"]] = r["v"]
        lists = max(1.0, total[-1])
        gradient, curve = total[:k] / lists + ridge * weights, total[k:-1].reshape(k, k) / lists
        step = np.linalg.solve(curve + max(ridge, 0.1 * np.trace(curve) / k) * np.eye(k), gradient)
        weights = weights - step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return ListwiseRanker(list(features), (weights / scale).tolist())


def train_ranker(train: DataFrame, kind: str = "linear", features: list[str] = FEATURES, seed: int = 42):
    """Fit graded labels from the features: ridge regression, boosted trees with ``kind="trees"`` (both pointwise: every row is used
    once), or with ``kind="listwise"`` a linear ranker by LambdaRank over each query's pool."""
    if kind == "listwise":
        return train_listwise(train, features)
    rows = assemble(train, features).select("features", F.col("label").cast("double").alias("label"))
    if kind == "trees":
        return GBTRegressor(maxIter=20, maxDepth=4, stepSize=0.1, seed=seed).fit(rows)
    return LinearRegression(regParam=0.01).fit(rows)


def score_ranker(model, df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    if isinstance(model, ListwiseRanker):
        return df.withColumn("score", model.score())
    return model.transform(assemble(df, features)).withColumnRenamed("prediction", "score").drop("features")


def path_shares(node, features: list[str]) -> Column:
    """What each feature's splits add on a row's way down a tree, as an array in the order of ``features``: per split the child's
    mean less the node's. The tree becomes one nested condition over the feature columns."""
    def walk(at, shares: tuple[float, ...]) -> Column:
        if not at.getClass().getSimpleName().startswith("Internal"):
            return F.array(*[F.lit(v) for v in shares])
        split = at.split()
        f = split.featureIndex()

        def child(to) -> Column:
            return walk(to, tuple(v + (to.prediction() - at.prediction()) if i == f else v for i, v in enumerate(shares)))

        return F.when(F.col(features[f]) <= split.threshold(), child(at.leftChild())).otherwise(child(at.rightChild()))

    return walk(node, (0.0,) * len(features))


def contribution_base(model) -> float:
    """The score of a row before any feature counts: a tree model's weighted root means, a linear model's intercept."""
    if isinstance(model, ListwiseRanker):
        return 0.0
    if hasattr(model, "trees"):
        return float(sum(w * t._java_obj.rootNode().prediction() for w, t in zip(model.treeWeights, model.trees)))
    return float(model.intercept)


def feature_contributions(model, df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """(query, doc, feature, contribution); a row's contributions and ``contribution_base`` sum to its score.

    Linear rankers: coefficient times value. Boosted trees: path attribution, all trees as column expressions (features are
    continuous), so rows never leave the JVM.
    """
    if hasattr(model, "trees"):
        ways = [path_shares(t._java_obj.rootNode(), features).alias(f"_t{i}") for i, t in enumerate(model.trees)]
        rows = df.select("query", "doc", *ways)
        value = lambda i: sum((F.col(f"_t{j}")[i] * float(w) for j, w in enumerate(model.treeWeights)), F.lit(0.0))
    else:
        rows, value = df, lambda i: F.col(features[i]) * float(model.coefficients[i])
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), value(i).alias("contribution")) for i, f in enumerate(features)])
    return rows.select("query", "doc", F.explode(parts).alias("p")).select("query", "doc", "p.feature", "p.contribution")


def cross_validate(labelled: DataFrame, k: int, seed: int = 42, kind: str = "linear") -> DataFrame:
    """(fold, ndcg_5) with whole queries held out; one distributed fit per fold."""
    folds = cut_lineage(kfold(labelled, "query", k, seed))
    out = []
    for i in range(k):
        model = train_ranker(folds.filter(F.col("fold") != i), kind)
        held = score_ranker(model, folds.filter(F.col("fold") == i))
        ranked = topk(held, ["query"], ["-score", "doc"], 5)
        queries = held.select("query").distinct().withColumn("kind", F.lit("all"))
        gold = held.filter(F.col("label") == 3).select("query", "doc")
        m = ndcg_metrics(queries, ranked, gold).filter(F.col("kind") == OVERALL)
        out.append(m.select(F.lit(i).alias("fold"), "ndcg_5"))
    return reduce(DataFrame.unionByName, out)


def cv_summary(folds: DataFrame, value: str) -> DataFrame:
    return folds.agg(F.count(F.lit(1)).alias("folds"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"))


def promotion_decision(runs: DataFrame, min_improvement: float = 0.0) -> DataFrame:
    """Gate of ``runs(candidate, baseline, cv_mean, cv_std)``: required score, its driver, promoted or not."""
    bound = F.col("cv_mean") - F.col("cv_std")
    required = F.greatest("baseline", bound)  # greatest skips NULL, so no CV means the baseline alone
    driver = F.when(bound.isNull(), "baseline_only").when(F.col("baseline") >= bound, "baseline").otherwise("cv_lower_bound")
    return runs.withColumn("required", required).withColumn("driver", driver).withColumn(
        "promoted", F.col("candidate") >= F.col("required") + min_improvement).withColumn("margin", F.col("candidate") - F.col("required"))


def retrain_decision(runs: DataFrame, min_queries: int = 10) -> DataFrame:
    """Cycle decision of ``runs(distinct_queries, candidate, current)``; equal or better replaces."""
    reason = (F.when(F.col("distinct_queries") < min_queries, "insufficient_data").when(F.col("current").isNull(), "first_run_auto_promotion")
              .when(F.col("candidate") >= F.col("current"), "candidate_equal_or_better").otherwise("candidate_worse"))
    return runs.withColumn("reason", reason).withColumn(
        "promoted", F.col("reason").isin("first_run_auto_promotion", "candidate_equal_or_better"))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, r) in one pass over the data; a constant column correlates only with itself."""
    spread = [F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]
    shared = [F.covar_pop(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)]
    one = df.agg(*spread, *shared)

    def cell(i: int, j: int) -> Column:
        product = F.when((F.col(f"s_{i}") >= 1e-9) & (F.col(f"s_{j}") >= 1e-9), F.col(f"s_{i}") * F.col(f"s_{j}"))
        r = F.coalesce(F.col(f"c_{i}_{j}") / product, F.lit(1.0 if i == j else 0.0))
        return F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), F.round(r, 6).alias("r"))

    n = range(len(cols))
    return one.select(F.explode(F.array(*[cell(i, j) for i in n for j in n])).alias("x")).select("x.*")


def label_stats(train: DataFrame) -> DataFrame:
    """One row: rows per label and smallest, largest and mean number of candidates per query."""
    per = train.groupBy("query").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("label") == v).alias(f"l{v}") for v in (0, 1, 3)])
    return per.agg(*[F.sum(f"l{v}").alias(f"label_{v}") for v in (0, 1, 3)], F.count(F.lit(1)).alias("queries"),
                   F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.round(F.avg("n"), 6).alias("mean_size"))
