"""Model operators: random forest train (M1, ``forest.py``), cross-validation
(M2), scoring (M3), feature assembly (M6), importance and versioned save (M7),
plus drift (A18), retrain trigger (A19), quality (A20) and dataset profile
(A23).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import byte_entropy
from .forest import ForestModel, train

FEATURES = list(C.MODEL_FEATURES)


def model_features(df: DataFrame) -> dict[str, Column]:
    """The 10 model features from flow-state columns (see ``flows.flow_state``)."""
    hour = F.hour("wall_ts")
    return {
        "Connection_Count": F.col("n"), "Duration": F.col("duration"), "Rate": F.round("rate", 4),
        "Unique_Ports": F.col("unique_ports"),
        "Is_Port_Scan": (F.col("unique_ports") > C.UNIQUE_PORT_THRESHOLD).cast("int"),
        "Is_Night": ((hour >= C.NIGHT_START_HOUR) | (hour <= C.NIGHT_END_HOUR)).cast("int"),
        "Payload_Entropy": (F.col("payload_entropy") if "payload_entropy" in df.columns
                            else byte_entropy("payload") if "payload" in df.columns else F.lit(0.0)),
        "Packet_Size": F.col("packet_size"), "Connection_Interval": F.col("connection_interval"),
        "SYN_Count": F.col("syn_count"),
    }


def assemble(df: DataFrame, cols=FEATURES, out: str = "features") -> DataFrame:
    """M6: missing columns and nulls -> 0, then one vector column."""
    filled = df.select("*", *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(f"_f_{c}")
                              for c in cols])
    return VectorAssembler(inputCols=[f"_f_{c}" for c in cols], outputCol=out).transform(filled).drop(*[f"_f_{c}" for c in cols])


def class_weights(df: DataFrame, label: str = "Label") -> dict[float, float]:
    """Balanced class weights n / (classes * n_class), from one small aggregate."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}     # one row a class
    if None in counts:
        raise ValueError("a label is null")
    return {value: sum(counts.values()) / (len(counts) * n) for value, n in counts.items()}


#: Row groups by key hash in which a label's rows are dealt out; a label is never one task's work.
FOLD_CHUNKS = 64


def stratified_split(df: DataFrame, key: str, train_fraction: float = 0.75, seed: int = 42, label: str = "Label"):
    """75/25 split of each label: within row groups by key hash, the first rows in seeded hash order train."""
    group = Window.partitionBy(label, F.pmod(F.xxhash64(key), F.lit(FOLD_CHUNKS)))
    rank = F.row_number().over(group.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key))
    placed = df.withColumn("_train", rank <= F.round(F.count(F.lit(1)).over(group) * train_fraction))
    return placed.filter("_train").drop("_train"), placed.filter("NOT _train").drop("_train")


def train_forest(train_rows: DataFrame, **kw) -> ForestModel:
    """M1: 200 trees, depth 20, min 2 rows per leaf, balanced weights, seed 42."""
    data = _filled(train_rows.withColumn("Label", F.col("Label").cast("double")))
    return train(data, [f"_f_{c}" for c in FEATURES], class_weights(data), **kw)


def _filled(df: DataFrame) -> DataFrame:
    return df.select("*", *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(f"_f_{c}")
                            for c in FEATURES])


def predict(model: ForestModel, df: DataFrame) -> DataFrame:
    """M3 core: prediction and threat probability x 100."""
    out = model.with_votes(_filled(df), "probability")
    likeliest = F.array_position("probability", F.array_max("probability")) - 1
    return (out.withColumn("prediction", likeliest.cast("double")).withColumn("threat_prob", F.col("probability")[1] * 100)
            .drop(*[f"_f_{c}" for c in FEATURES]))


def threat_type(is_threat: Column) -> Column:
    """M3: port-scan > entropy above 5 > high-frequency."""
    return (F.when(~is_threat, "Normal Traffic").when(F.col("Is_Port_Scan") == 1, "Stealth Reconnaissance")
            .when(F.col("Payload_Entropy") > 5.0, "Malicious Payload Delivery")
            .otherwise("High-Frequency Anomalous Traffic"))


def forest_scores(model: ForestModel, df: DataFrame) -> DataFrame:
    """Verdict step 3 columns (``_ml_threat``, ``_ml_conf``, ``_ml_type``) on flow-state rows."""
    cols = model_features(df)
    staged = df.select("*", *[c.alias(n) for n, c in cols.items() if n not in df.columns])
    p = predict(model, staged)
    t = F.col("prediction") == 1.0
    return (p.withColumn("_ml_threat", t).withColumn("_ml_conf", F.col("threat_prob"))
            .withColumn("_ml_type", threat_type(t))
            .drop("probability", "prediction", "threat_prob"))


def quality(pred: DataFrame, label: str = "Label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall, F1 and the 2x2 confusion counts (zero division -> 0)."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    c = pred.agg(F.count_if((y == 0) & (p == 0)).alias("TN"), F.count_if((y == 0) & (p == 1)).alias("FP"),
                 F.count_if((y == 1) & (p == 0)).alias("FN"), F.count_if((y == 1) & (p == 1)).alias("TP"))
    tot = F.col("TN") + F.col("FP") + F.col("FN") + F.col("TP")
    prec = F.when(F.col("TP") + F.col("FP") > 0, F.col("TP") / (F.col("TP") + F.col("FP"))).otherwise(F.lit(0.0))
    rec = F.when(F.col("TP") + F.col("FN") > 0, F.col("TP") / (F.col("TP") + F.col("FN"))).otherwise(F.lit(0.0))
    f1 = F.when(F.col("TP") > 0, 2 * F.col("TP") / (2 * F.col("TP") + F.col("FP") + F.col("FN"))).otherwise(F.lit(0.0))
    return c.select("TN", "FP", "FN", "TP",
                    F.round(F.when(tot > 0, (F.col("TP") + F.col("TN")) / tot).otherwise(F.lit(0.0)), 4).alias("accuracy"),
                    F.round(prec, 4).alias("precision"), F.round(rec, 4).alias("recall"), F.round(f1, 4).alias("f1_score"))


def with_folds(df: DataFrame, folds: int, key: str, seed: int, label: str = "Label") -> DataFrame:
    """``fold`` 0..folds-1, dealt out in hash order within each label, so that labels split evenly."""
    order = Window.partitionBy(label, F.pmod(F.xxhash64(key), F.lit(FOLD_CHUNKS))).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.withColumn("fold", F.pmod(F.row_number().over(order), F.lit(folds)))


def cross_validate(data: DataFrame, folds: int = 5, seed: int = 42, key: str = "packet_id", **kw) -> DataFrame:
    """M2: k-fold accuracy, mean and std. One fit a fold, class weights from its training part alone."""
    from ..session import checkpoint
    parts = checkpoint(with_folds(data, folds, key, seed))

    def accuracy(i: int) -> float:
        model = train_forest(parts.filter(F.col("fold") != i), **kw)
        hit = predict(model, parts.filter(F.col("fold") == i)).agg(F.avg((F.col("prediction") == F.col("Label")).cast("double"))).first()[0]
        return float(hit or 0.0)

    with ThreadPoolExecutor(2) as pool:         # folds overlap: a fit's last levels leave executors idle
        scores = list(pool.map(accuracy, range(folds)))
    mean = sum(scores) / folds
    std = (sum((x - mean) ** 2 for x in scores) / folds) ** 0.5
    return data.sparkSession.range(1).select(F.lit(mean).alias("cv_accuracy_mean"), F.lit(std).alias("cv_accuracy_std"), F.lit(folds).alias("folds"))


def feature_importance(model: ForestModel) -> list[tuple[str, float]]:
    """M7: ranked importances of the forest."""
    return sorted(zip(FEATURES, model.importances()), key=lambda t: -t[1])


def save_versioned(model: ForestModel, base_path: str, version: str) -> str:
    """M7: each training run writes a new version folder; earlier versions stay."""
    path = f"{base_path.rstrip('/')}/{version}"
    model.save(path)
    return path


def drift_ratio(pred: DataFrame, is_threat: str = "is_threat", bucket: Column | None = None) -> DataFrame:
    """Threats / predictions (0 when none), overall or per bucket."""
    ratio = F.coalesce(F.avg(F.col(is_threat).cast("double")), F.lit(0.0)).alias("drift_ratio")
    n = F.count(F.lit(1)).alias("predictions")
    if bucket is None:
        return pred.agg(n, ratio)
    return pred.groupBy(bucket.alias("bucket")).agg(n, ratio)


def retrain_trigger(log: DataFrame, last_trained_row: int, row_id: str = "row_id",
                    min_new: int = C.RETRAIN_MIN_NEW_ROWS) -> DataFrame:
    """At least ``min_new`` rows logged since the last training watermark."""
    return (log.filter(F.col(row_id) > last_trained_row)
            .agg(F.count(F.lit(1)).alias("new_rows"))
            .withColumn("retrain", F.col("new_rows") >= min_new))


def dataset_profile(df: DataFrame, cols=FEATURES, label: str = "Label") -> tuple[DataFrame, DataFrame]:
    """Label shares and per-feature mean, sample std, min, max (unpivoted)."""
    shares = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    one = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in cols
                   for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    stats = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}__{n}").alias(n) for n in ("mean", "std", "min", "max")])
        for c in cols])).alias("kv")).select("kv.*")
    return shares, stats
