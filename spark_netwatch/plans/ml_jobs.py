"""Registered model jobs: M1-M7, A18-A20, A23.

Training data: per-packet model features (D1) labelled by the cascade's
verdict (D4, models off).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..operators import classify, isoforest, ml
from ..operators.forest import ForestModel
from ..session import checkpoint, ensure_checkpoint_dir
from .dpi_jobs import CLS_COLS  # noqa: F401
from .flow_jobs import d1_feature_vector
from .registry import job, v, w
from .sqlgen import classify_sql
from .verdict_jobs import VERDICT_BASE, run_verdicts


def training_set(spark, sf):
    vd = run_verdicts(spark, sf)
    feats = ml.model_features(vd)
    return vd.select("packet_id", "ts_us", *[c.alias(n) for n, c in feats.items()],
                     F.col("is_threat").cast("int").alias("Label"))


def _fit(spark, sf):
    """(data, train, test, model): trained once an application and data folder, then read from the saved files."""
    name = f"{spark.sparkContext.applicationId}-{hashlib.md5(sf.encode()).hexdigest()}"
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/netwatch-forest-{name}"
    try:
        model = ForestModel.load(spark, f"{base}/model/v1")
    except Exception as e:      # not saved yet; whatever else is wrong comes up again below
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
        training_set(spark, sf).write.mode("overwrite").parquet(f"{base}/data")
        train, _ = ml.stratified_split(spark.read.parquet(f"{base}/data"), "packet_id")
        ml.save_versioned(ml.train_forest(train), f"{base}/model", "v1")
        model = ForestModel.load(spark, f"{base}/model/v1")
    data = spark.read.parquet(f"{base}/data")
    return data, *ml.stratified_split(data, "packet_id"), model


@job("M1_forest_train")
def m1_train(spark, sf):
    _, _, test, model = _fit(spark, sf)
    return ml.quality(ml.predict(model, test))


@job("M2_forest_cv")
def m2_cv(spark, sf):
    return ml.cross_validate(checkpoint(training_set(spark, sf)))


@job("M3_forest_scores")
def m3_scores(spark, sf):
    data, _, _, model = _fit(spark, sf)
    p = ml.predict(model, data)
    t = F.col("prediction") == 1.0
    return p.select("packet_id", "prediction", "threat_prob", ml.threat_type(t).alias("threat_type"))


@job("M7_feature_importance")
def m7_importance(spark, sf):
    _, _, _, model = _fit(spark, sf)
    ranked = ml.feature_importance(model)
    return spark.createDataFrame([(i + 1, n, imp) for i, (n, imp) in enumerate(ranked)], "rank int, feature string, importance double")


def _iso(spark, sf):
    data = checkpoint(training_set(spark, sf))
    return data, isoforest.train_isolation(data, "ts_us")


@job("M4_isolation_train")
def m4_iso_train(spark, sf):
    data, model = _iso(spark, sf)
    trees = model.feature.shape[0]
    rows = [(t, int((model.size[t] > 0).sum()), int(((model.feature[t] < 0) & (model.size[t] > 0)).sum()), float(model.offset))
            for t in range(trees)]
    return spark.createDataFrame(rows, "tree int, nodes int, leaves int, offset double")


@job("M5_isolation_scores")
def m5_iso_scores(spark, sf):
    data, model = _iso(spark, sf)
    s = isoforest.score_isolation(model, data)
    return s.select("packet_id", "iso_decision", F.col("_iso_anom").alias("anomaly"), F.col("_iso_conf").alias("confidence"))




def _d1_sql():
    from .registry import ORACLE
    return ORACLE["D1_feature_vector"]


FEATS_SQL = ", ".join(f"CAST({c} AS DOUBLE)" for c in ml.FEATURES)


@job("M6_feature_assembly", f"SELECT packet_id, [{FEATS_SQL}] AS features FROM ({_d1_sql()})")
def m6_assembly(spark, sf):
    from pyspark.ml.functions import vector_to_array
    d1 = d1_feature_vector(spark, sf)
    return ml.assemble(d1).select("packet_id", vector_to_array("features").alias("features"))


@job("A18_drift_ratio", VERDICT_BASE + """SELECT strftime(wall_ts, '%Y-%m-%d') AS bucket, CAST(count(*) AS BIGINT) AS predictions,
  COALESCE(avg(CASE WHEN is_threat THEN 1.0 ELSE 0.0 END), 0.0) AS drift_ratio FROM vd GROUP BY 1""")
def a18_drift(spark, sf):
    return ml.drift_ratio(run_verdicts(spark, sf), bucket=F.date_format("wall_ts", "yyyy-MM-dd"))


@job("A19_retrain_trigger", w("raw_event_log") + """SELECT CAST(count(*) AS BIGINT) AS new_rows, count(*) >= 50 AS retrain
FROM raw_event_log WHERE row_id > (SELECT max(row_id) * 995 // 1000 FROM raw_event_log)""")
def a19_trigger(spark, sf):
    """The last run's watermark stands at 99.5 % of the log."""
    log = v(spark, sf, "raw_event_log")
    return ml.retrain_trigger(log, (log.agg(F.max("row_id")).first()[0] or 0) * 995 // 1000)


@job("A20_model_quality", f"""WITH p AS ({classify_sql('documents', 'text', 'doc_id')})
SELECT CAST(count(*) FILTER (WHERE toxic = 0 AND NOT is_threat) AS BIGINT) AS TN,
  CAST(count(*) FILTER (WHERE toxic = 0 AND is_threat) AS BIGINT) AS FP,
  CAST(count(*) FILTER (WHERE toxic = 1 AND NOT is_threat) AS BIGINT) AS FN,
  CAST(count(*) FILTER (WHERE toxic = 1 AND is_threat) AS BIGINT) AS TP,
  round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE (toxic = 1) = is_threat) / count(*) ELSE 0.0 END, 4) AS accuracy,
  round(CASE WHEN count(*) FILTER (WHERE is_threat) > 0 THEN count(*) FILTER (WHERE toxic = 1 AND is_threat) / count(*) FILTER (WHERE is_threat) ELSE 0.0 END, 4) AS precision,
  round(CASE WHEN count(*) FILTER (WHERE toxic = 1) > 0 THEN count(*) FILTER (WHERE toxic = 1 AND is_threat) / count(*) FILTER (WHERE toxic = 1) ELSE 0.0 END, 4) AS recall,
  round(CASE WHEN count(*) FILTER (WHERE toxic = 1 AND is_threat) > 0 THEN 2.0 * count(*) FILTER (WHERE toxic = 1 AND is_threat)
    / (2 * count(*) FILTER (WHERE toxic = 1 AND is_threat) + count(*) FILTER (WHERE toxic = 0 AND is_threat) + count(*) FILTER (WHERE toxic = 1 AND NOT is_threat)) ELSE 0.0 END, 4) AS f1_score
FROM p JOIN labels USING (doc_id)""")
def a20_quality(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    pred = classify.classify_text(docs, "text").select("doc_id", F.col("is_threat").cast("int").alias("prediction"))
    return ml.quality(pred.join(labels, "doc_id").withColumnRenamed("toxic", "Label"))


PROFILE_SRC = f"SELECT * FROM ({_d1_sql()})"


@job("A23_dataset_profile", "WITH d AS (" + PROFILE_SRC + ")\nSELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, "
    f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM d" for c in ml.FEATURES) + ")")
def a23_profile(spark, sf):
    d1 = d1_feature_vector(spark, sf)
    _, stats = ml.dataset_profile(d1, label="Is_Port_Scan")
    return stats.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max")


@job("A23_label_share", VERDICT_BASE + "SELECT CAST(is_threat AS INTEGER) AS Label, CAST(count(*) AS BIGINT) AS rows FROM vd GROUP BY 1")
def a23_labels(spark, sf):
    """Shares of the training label, the cascade's verdict."""
    shares, _ = ml.dataset_profile(training_set(spark, sf))
    return shares
