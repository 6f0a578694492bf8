"""Purged cross-validation: splitters as long frames of positions, and scoring with Spark ML.

Labels are (symbol, pos, us, t1) with gapless pos from 0 in time order. A split is
(symbol, fold, role, pos); folds are few, so their bounds are a small side.
"""

from __future__ import annotations

import statistics as st

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.windows import as_of, numbered


def positions(labels: DataFrame) -> DataFrame:
    """labels with pos, their place in time order from 0."""
    return numbered(labels, "pos", ["us"], F.floor(F.col("us") / (86_400_000_000 * 32)), 0)


def get_train_times(labels: DataFrame, tests: DataFrame) -> DataFrame:
    """labels that overlap no closed test interval (symbol, lo, hi). Test intervals are merged first, so each label meets one range at most."""
    w = Window.partitionBy("symbol").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    t = tests.withColumn("_m", F.max("hi").over(w)).withColumn("_new", F.when(F.col("_m").isNull() | (F.col("lo") > F.col("_m")), 1).otherwise(0))
    t = t.withColumn("_g", F.sum("_new").over(Window.partitionBy("symbol").orderBy("lo"))).groupBy("symbol", "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return labels.join(t, (labels["symbol"] == t["symbol"]) & (labels["us"] <= t["hi"]) & (labels["t1"] >= t["lo"]), "left_anti")


def get_embargo_times(times: DataFrame, pct: float) -> DataFrame:
    """(symbol, us, embargo_us): the time int(n * pct) places later, the last one at the end. times: (symbol, pos, us)."""
    n = times.groupBy("symbol").agg(F.count("*").alias("_n"), F.max("us").alias("_last"))
    later = times.select("symbol", F.col("pos").alias("_at"), F.col("us").alias("embargo_us"))
    step = times.join(n, "symbol").withColumn("_at", F.col("pos") + F.floor(F.col("_n") * F.lit(pct)))
    out = step.join(later, ["symbol", "_at"], "left")
    return out.select("symbol", "us", F.coalesce("embargo_us", "_last").alias("embargo_us"))


def fold_of(pos: Column, n: Column, k: int) -> Column:
    """The contiguous fold of a position; the first n % k folds have one more."""
    size, rest = F.floor(n / k), n % k
    cut = rest * (size + 1)
    return F.when(pos < cut, F.floor(pos / (size + 1))).otherwise(rest + F.floor((pos - cut) / F.greatest(size, F.lit(1)))).cast("int")


def folded(labels: DataFrame, k: int) -> DataFrame:
    n = labels.groupBy("symbol").agg(F.count("*").alias("_n"))
    return labels.join(n, "symbol").withColumn("fold", fold_of(F.col("pos"), F.col("_n"), k))


def kfold(labels: DataFrame, k: int) -> DataFrame:
    """Naive contiguous folds: every other row trains."""
    f = folded(labels, k)
    train = f.withColumn("_test", F.col("fold")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("fold <> _test")
    cols = ["symbol", "fold", "role", "pos"]
    return f.withColumn("role", F.lit("test")).select(cols).unionByName(train.withColumn("role", F.lit("train")).select(cols))


def purged_kfold(labels: DataFrame, k: int = 3, embargo: float = 0.0) -> DataFrame:
    """Contiguous test folds; training rows end by the fold's start, or begin after its last end and the embargo.

    Test rows never train, also where a label has no span. labels without t1 raise an error.
    """
    f = folded(labels, k)
    bounds = f.groupBy("symbol", "fold").agg(F.min("us").alias("_lo"), F.max("t1").alias("_hi"), F.min("pos").alias("_a"), F.max("pos").alias("_b"), F.max("_n").alias("_n"))
    # where the fold's last end falls: the number of starts before it
    starts = labels.groupBy("symbol", "us").agg((F.max("pos") + 1).alias("_r"))
    right = as_of(bounds.select("symbol", "fold", F.col("_hi").alias("us")), starts, ["_r"], exact=False).select("symbol", "fold", F.coalesce("_r", F.lit(0)).alias("_r"))
    bounds = bounds.join(right, ["symbol", "fold"]).withColumn("_from", F.col("_r") + F.floor(F.col("_n") * F.lit(embargo)))
    all_ = labels.select("symbol", "pos", "t1").join(bounds, "symbol")
    test = (F.col("pos") >= F.col("_a")) & (F.col("pos") <= F.col("_b"))
    train = ~test & ((F.col("t1") <= F.col("_lo")) | (F.col("pos") >= F.col("_from")))
    return all_.withColumn("role", F.when(test, "test").when(train, "train")).where("role IS NOT NULL").select("symbol", "fold", "role", "pos")


def purged_walk_forward(labels: DataFrame, k: int = 6, embargo: float = 0.01, min_train: float = 0.4) -> DataFrame:
    """Test blocks over the rows after the first min_train share; training rows lie before the embargo and end before the test starts."""
    n = labels.groupBy("symbol").agg(F.count("*").alias("_n"))
    l = labels.join(n, "symbol").withColumn("_f", F.floor(F.col("_n") * F.lit(min_train)))  # noqa: E741
    l = l.withColumn("_fold", F.when(F.col("pos") >= F.col("_f"), fold_of(F.col("pos") - F.col("_f"), F.col("_n") - F.col("_f"), k)))  # noqa: E741
    bounds = l.where("_fold IS NOT NULL").groupBy("symbol", F.col("_fold").alias("fold")).agg(F.min("us").alias("_lo"), F.min("pos").alias("_a"), F.max("pos").alias("_b"), F.max("_n").alias("_m"))
    b = l.join(bounds, "symbol")
    test = (F.col("pos") >= F.col("_a")) & (F.col("pos") <= F.col("_b"))
    train = (F.col("pos") < F.col("_a") - F.floor(F.col("_m") * F.lit(embargo))) & (F.col("t1") < F.col("_lo"))
    out = b.withColumn("role", F.when(test, "test").when(train, "train")).where("role IS NOT NULL").select("symbol", "fold", "role", "pos")
    whole = out.groupBy("symbol", "fold").agg(F.countDistinct("role").alias("_k")).where("_k = 2")
    return out.join(whole.select("symbol", "fold"), ["symbol", "fold"], "left_semi")


def overlap_audit(labels: DataFrame, k: int = 5, embargo: float = 0.01) -> DataFrame:
    """(symbol, protocol, mean_train, contaminated, pct): training labels that overlap their fold's span, naive and purged."""
    out = None
    for name, split in (("naive", kfold(labels, k)), ("purged", purged_kfold(labels, k, 0.0)), ("purged_embargo", purged_kfold(labels, k, embargo))):
        s = split.join(labels.select("symbol", "pos", "us", "t1"), ["symbol", "pos"])
        span = s.where("role = 'test'").groupBy("symbol", "fold").agg(F.min("us").alias("_lo"), F.max("t1").alias("_hi"))
        hit = F.when((F.col("us") < F.col("_hi")) & (F.col("t1") > F.col("_lo")), 1).otherwise(0)
        folds = s.where("role = 'train'").join(span, ["symbol", "fold"]).groupBy("symbol", "fold").agg(F.count("*").alias("n"), F.sum(hit).alias("bad"))
        one = folds.groupBy("symbol").agg(F.avg("n").alias("mean_train"), F.sum("bad").alias("contaminated"), F.avg(F.col("bad") / F.col("n")).alias("pct")).withColumn("protocol", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("symbol", "protocol", "mean_train", "contaminated", "pct")


def make_classifier(seed: int = 0, trees: int = 300, features: str = "features", label: str = "y", weight: str = "weight") -> RandomForestClassifier:
    """A forest of shallow-feature trees: one feature a split, entropy, heavy leaves; class balance goes into the weights.

    Leaves hold 5 % of the weight at least, so trees have 20 leaves at most; depth is bounded by 19 splits for that alone.
    """
    return RandomForestClassifier(featuresCol=features, labelCol=label, weightCol=weight, numTrees=trees, featureSubsetStrategy="1", impurity="entropy", minWeightFractionPerNode=0.05, subsamplingRate=0.6, maxDepth=19, seed=seed)


def assembled(data: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="features").transform(data)


def balanced(data: DataFrame, weight: str = "weight") -> DataFrame:
    """data with weights multiplied so that classes weigh the same."""
    c = data.groupBy("y").agg(F.sum(weight).alias("_c"))
    n = data.agg(F.sum(weight).alias("_t"), F.countDistinct("y").alias("_k")).first()
    return data.join(c, "y").withColumn(weight, F.col(weight) * F.lit(n["_t"] / n["_k"]) / F.col("_c")).drop("_c")


def fold_frames(data: DataFrame, split: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) of one fold; data: (symbol, pos, features...)."""
    s = split.where(F.col("fold") == fold)
    return tuple(data.join(s.where(F.col("role") == role).select("symbol", "pos"), ["symbol", "pos"], "left_semi") for role in ("train", "test"))


def score_expr(scoring: str) -> Column:
    """The weighted score of predictions with columns probability, prediction, y and weight."""
    if scoring == "accuracy":
        return F.sum(F.when(F.col("prediction") == F.col("y"), F.col("weight")).otherwise(0.0)) / F.sum("weight")
    if scoring != "neg_log_loss":
        raise ValueError(f"unknown scoring: {scoring}")
    p = F.get(vector_to_array("probability"), F.col("y").cast("int"))
    return F.sum(F.col("weight") * F.log(F.greatest(F.least(p, F.lit(1 - 1e-15)), F.lit(1e-15)))) / F.sum("weight")


def cv_score(classifier, data: DataFrame, names: list[str], split: DataFrame, scoring: str = "neg_log_loss") -> list[float]:
    """One score for each fold; folds are jobs of their own."""
    data = assembled(data, names)
    folds = sorted(r["fold"] for r in split.select("fold").distinct().collect())
    out = []
    for fold in folds:
        train, test = fold_frames(data, split, fold)
        out.append(classifier.fit(balanced(train)).transform(test).agg(score_expr(scoring)).first()[0])
    return out


def compare_cv(classifier, data: DataFrame, names: list[str], labels: DataFrame, k: int = 5, embargo: float = 0.01, scoring: str = "neg_log_loss") -> dict[str, dict[str, float]]:
    """Naive, purged, and purged with embargo: mean, std, min and max of the fold scores."""


    splits = {"naive": kfold(labels, k), "purged": purged_kfold(labels, k), "purged_embargo": purged_kfold(labels, k, embargo)}
    out = {}
    for name, split in splits.items():
        s = cv_score(classifier, data, names, split, scoring)
        out[name] = {"mean": st.mean(s), "std": st.stdev(s) if len(s) > 1 else float("nan"), "min": min(s), "max": max(s)}
    return out


def oof_predict_proba(classifier, data: DataFrame, names: list[str], split: DataFrame) -> DataFrame:
    """(symbol, pos, p): probability of class 1 out of fold, for tested rows; a row tested twice has its last fold's."""
    data = assembled(data, names)
    out = None
    for fold in sorted(r["fold"] for r in split.select("fold").distinct().collect()):
        train, test = fold_frames(data, split, fold)
        p = classifier.fit(balanced(train)).transform(test).select("symbol", "pos", F.lit(fold).alias("fold"), F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("symbol", "pos").agg(F.max_by("p", "fold").alias("p"))
