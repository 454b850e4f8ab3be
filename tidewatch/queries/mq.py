"""Model-quality queries on labelled documents (two classes) and line items (three classes)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import mq, truth
from tidewatch.plans.runs import ModelQuality
from tidewatch.queries.common import r, table, text_time, tidy
from tidewatch.spec import ModelQualitySpec

MULTI = {"problem_type": "multiclass", "label_column": "label", "prediction_column": "prediction"}
BINARY = {
    "problem_type": "binary",
    "label_column": "quality",
    "prediction_column": "prediction",
    "probability_columns": ["score"],
    "positive_label": 1,
    "baseline_metrics": {"accuracy": 0.95, "mq/f1_macro": 0.60, "auc": 0.55, "unknown": 0.5},
    "degradation_thresholds": {"accuracy": 0.05, "mq/f1_macro": 0.02},
}
AS_OF = datetime(2001, 8, 1)
LOOKBACK = "1000d"


def multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    step = F.col("l_quantity").cast("bigint") % 3
    guess = F.when(step == 0, F.col("l_returnflag")).when(step == 1, F.lit("A")).otherwise("R")
    missing = F.col("l_orderkey") % 19 == 0
    return items.select(
        F.col("l_returnflag").alias("label"),
        F.when(~missing, guess).alias("prediction"),
        (F.col("l_extendedprice") / 100000.0).alias("score"),
    )


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    score = F.least(F.col("n_chars") / 20000.0, F.lit(1.0))
    return documents.join(labels, "doc_id").select(
        "quality", score.alias("score"), (score > 0.05).cast("int").alias("prediction")
    )


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mq.confusion_counts(multi(spark, sf_dir), "label", "prediction")


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mq.confusion_matrix(_cells(spark, sf_dir))


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = mq.summary_scores(mq.class_scores(mq.class_counts(_cells(spark, sf_dir))))
    return tidy(scores.unpivot([], scores.columns, "metric", "value"), "metric", "value")


def per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = mq.measure(multi(spark, sf_dir), ModelQualitySpec.from_dict(MULTI))
    return tidy(metrics.where(F.col("subject") != "all"), "name", "value")


def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = multi(spark, sf_dir).select("score", (F.col("label") == "R").alias("positive"))
    return tidy(mq.auc_of(rows), "auc")


def auc_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heavily tied scores: 50 distinct quantities rank all line items."""
    items = table(spark, sf_dir, "lineitem")
    rows = items.select((F.col("l_quantity") / 50).alias("score"), (F.col("l_discount") > 0.05).alias("positive"))
    return tidy(mq.auc_of(rows), "auc")


def _analysis(spark: SparkSession, sf_dir: str):
    return ModelQuality().compute({"predictions": binary(spark, sf_dir)}, BINARY)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_analysis(spark, sf_dir).metrics, "name", "value")


def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_analysis(spark, sf_dir).details["baseline_delta"], "metric", "baseline", "current", "delta")


def degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_analysis(spark, sf_dir).violations, "type", "subject", "value", "reference", "threshold")


def outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).outcome


def empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No line item has a negative quantity: a run without predictions is skipped, not a success."""
    nothing = binary(spark, sf_dir).join(table(spark, sf_dir, "lineitem").where("l_quantity < 0").select(F.lit(1).alias("none")), F.lit(True), "left_semi")
    return ModelQuality().compute({"predictions": nothing}, BINARY).outcome


def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result document, opened again: its outcome and the sizes of its parts."""
    predictions = {"predictions": multi(spark, sf_dir)}
    document = ModelQuality().compute(predictions, MULTI).payload(spark)
    return document.select(
        F.get_json_object("document", "$.monitor_type").alias("monitor_type"),
        F.get_json_object("document", "$.problem_type").alias("problem_type"),
        F.get_json_object("document", "$.outcome.outcome").alias("outcome"),
        F.json_array_length(F.get_json_object("document", "$.metrics")).cast("bigint").alias("metrics"),
        F.json_array_length(F.get_json_object("document", "$.confusion_matrix")).cast("bigint").alias("cells"),
        F.aggregate(
            F.from_json(F.get_json_object("document", "$.confusion_matrix"), "array<struct<n:bigint>>"),
            F.lit(0).cast("bigint"),
            lambda acc, cell: acc + cell["n"],
        ).alias("pairs"),
    )


def metric_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics_ = mq.measure(multi(spark, sf_dir), ModelQualitySpec.from_dict(MULTI))
    return tidy(mq.payload_view(metrics_), "section", "class", "metric", "value")


def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics_ = mq.measure(binary(spark, sf_dir), ModelQualitySpec.from_dict(BINARY))
    return tidy(mq.constraints(metrics_, 0.05), "metric", "baseline", "threshold")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as captured predictions."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("inference_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_orderstatus").alias("prediction"),
    )


def late_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as labels that arrive on their ship date."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("inference_id"),
        F.col("l_shipdate").cast("timestamp").alias("label_ts"),
        F.col("l_returnflag").alias("label"),
    )


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.join_truth(captures(spark, sf_dir), late_labels(spark, sf_dir), AS_OF, LOOKBACK)


def gt_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _truth(spark, sf_dir)
    return joined.select("inference_id", "prediction", "label", text_time("label_ts").alias("label_ts"))


def gt_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(truth.coverage(_truth(spark, sf_dir)), "captured", "matched", "coverage", "outcome", "severity")


def gt_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's rows from stored tables: orders whose sixty days have passed."""
    rows = truth.settled_truth(captures(spark, sf_dir), late_labels(spark, sf_dir), AS_OF, "60d")
    return rows.select("inference_id", "prediction", text_time("ts").alias("ts"), "label", text_time("label_ts").alias("label_ts"))


def labelled(spark: SparkSession, sf_dir: str, min_coverage: float) -> ModelQuality:
    """A run that joins its labels itself; a finished order predicts R, an open one N."""
    guess = F.when(F.col("prediction") == "F", "R").when(F.col("prediction") == "O", "N").otherwise("A")
    inputs = {"predictions": captures(spark, sf_dir).withColumn("prediction", guess), "labels": late_labels(spark, sf_dir)}
    config = {
        "problem_type": "multiclass", "label_column": "truth", "prediction_column": "prediction", "labels_input": "labels",
        "lookback": LOOKBACK, "as_of": AS_OF.isoformat(), "min_coverage": min_coverage,
        "baseline_metrics": {"accuracy": 0.9}, "degradation_thresholds": {"accuracy": 0.05},
    }
    return ModelQuality().compute(inputs, config)


def _ended(run) -> DataFrame:
    """A run's outcome as a row beside its metrics."""
    return run.outcome.select(F.concat_ws("/", F.lit("outcome"), "outcome", "severity").alias("name"), F.col("violation_count").cast("double").alias("value"))


def labelled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = labelled(spark, sf_dir, 0.3)
    return tidy(run.metrics.where(F.col("subject").isin("all", "ground_truth")).select("name", "value").union(_ended(run)), "name", "value")


def insufficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage below the floor: neither pass nor fail, and nothing is violated."""
    run = labelled(spark, sf_dir, 0.999)
    return tidy(run.metrics.where("subject = 'ground_truth'").select("name", "value").union(_ended(run)), "name", "value")


QUERIES = {
    "mq_labelled": labelled_metrics,
    "mq_insufficient": insufficient,
    "gt_settled": gt_settled,
    "mq_confusion": confusion,
    "mq_scalars": scalars,
    "mq_per_class": per_class,
    "mq_auc": auc,
    "mq_auc_ties": auc_ties,
    "mq_metrics_binary": metrics,
    "mq_baseline_delta": baseline_delta,
    "mq_degradation": degradation,
    "mq_outcome": outcome,
    "mq_empty": empty,
    "mq_payload": payload,
    "mq_metric_view": metric_view,
    "mq_constraints": constraints,
    "gt_join": gt_join,
    "gt_coverage": gt_coverage,
}

_MULTI = """
WITH pred AS (
  SELECT l_returnflag AS label, l_extendedprice / 100000.0::DOUBLE AS score,
         CASE WHEN l_orderkey % 19 = 0 THEN NULL
              WHEN CAST(l_quantity AS BIGINT) % 3 = 0 THEN l_returnflag
              WHEN CAST(l_quantity AS BIGINT) % 3 = 1 THEN 'A' ELSE 'R' END AS prediction
  FROM lineitem),
"""
_BINARY = """
WITH pred AS (
  SELECT CAST(quality AS VARCHAR) AS label, least(n_chars / 20000.0::DOUBLE, 1.0) AS score,
         CASE WHEN least(n_chars / 20000.0::DOUBLE, 1.0) > 0.05 THEN '1' ELSE '0' END AS prediction
  FROM documents JOIN labels USING (doc_id)),
"""
_SCORES = """
cells AS (SELECT label, prediction, count(*) AS n FROM pred WHERE label IS NOT NULL AND prediction IS NOT NULL GROUP BY 1, 2),
classes AS (SELECT label AS class FROM cells UNION SELECT prediction FROM cells),
per AS (
  SELECT class,
    coalesce((SELECT sum(n) FROM cells WHERE label = class), 0) AS actual,
    coalesce((SELECT sum(n) FROM cells WHERE prediction = class), 0) AS predicted,
    coalesce((SELECT sum(n) FROM cells WHERE label = class AND prediction = class), 0) AS hits
  FROM classes),
scores AS (
  SELECT class, actual, hits,
    CASE WHEN predicted = 0 THEN 0.0 ELSE hits / predicted::DOUBLE END AS precision,
    CASE WHEN actual = 0 THEN 0.0 ELSE hits / actual::DOUBLE END AS recall,
    CASE WHEN actual + predicted = 0 THEN 0.0 ELSE 2 * hits / (actual + predicted)::DOUBLE END AS f1
  FROM per),
scalars AS (
  SELECT 'accuracy' AS metric, sum(hits) / sum(actual)::DOUBLE AS value FROM scores
  UNION ALL SELECT 'precision_macro', avg(precision) FROM scores
  UNION ALL SELECT 'recall_macro', avg(recall) FROM scores
  UNION ALL SELECT 'f1_macro', avg(f1) FROM scores)"""


def _auc_sql(score: str, positive: str) -> str:
    return f"""
sc AS (SELECT {score} AS s, CASE WHEN {positive} THEN 1 ELSE 0 END AS y FROM %s),
fq AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM sc WHERE s IS NOT NULL GROUP BY s),
rk AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM fq),
auc AS (SELECT sum(p::DOUBLE * (below + n / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n)::DOUBLE) AS auc FROM rk)"""


_AUC = _auc_sql("score", "label = '1'") % "pred"
_ALL_BINARY = f"""{_BINARY} {_SCORES}, {_AUC},
metrics AS (SELECT metric, value FROM scalars UNION ALL SELECT 'auc', auc FROM auc),
bl AS (SELECT * FROM (VALUES ('accuracy', 0.95::DOUBLE, 0.05::DOUBLE), ('mq/f1_macro', 0.60, 0.02), ('auc', 0.55, NULL), ('unknown', 0.5, NULL))
       t(metric, baseline, threshold)),
delta AS (SELECT bl.metric, baseline, value AS current, value - baseline AS delta, threshold
          FROM bl JOIN metrics ON replace(bl.metric, 'mq/', '') = metrics.metric),
bad AS (SELECT * FROM delta WHERE current < baseline - threshold)
"""
_PER_CLASS = "\n UNION ALL ".join(
    f"SELECT class, '{m}' AS metric, {m} AS value FROM scores" for m in ("precision", "recall", "f1")
)
_GT = f"""
WITH cap AS (SELECT o_orderkey AS inference_id, o_orderdate AS ts, o_orderstatus AS prediction FROM orders
             WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 1000 DAY AND o_orderdate <= TIMESTAMP '{AS_OF}'),
lab AS (SELECT l_orderkey, l_shipdate AS label_ts, l_returnflag AS label,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_returnflag DESC) AS rn
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '{AS_OF}'),
joined AS (SELECT inference_id, prediction, label, label_ts FROM cap LEFT JOIN lab ON inference_id = l_orderkey AND rn = 1 AND label_ts >= ts)
"""

_LABELLED = f"""{_GT}, pred AS (SELECT label, CASE prediction WHEN 'F' THEN 'R' WHEN 'O' THEN 'N' ELSE 'A' END AS prediction FROM joined), {_SCORES},
c AS (SELECT count(*)::DOUBLE AS captured, count(label_ts)::DOUBLE AS matched, count(label_ts) / count(*)::DOUBLE AS coverage FROM joined),
gt AS (SELECT 'mq/captured' AS name, captured AS value FROM c UNION ALL SELECT 'mq/matched', matched FROM c UNION ALL SELECT 'mq/coverage', coverage FROM c)
"""


def _labelled_end(floor: float) -> str:
    return f"""SELECT CASE WHEN coverage < {floor} THEN 'outcome/skipped_insufficient_data/warn'
        WHEN value < 0.85 THEN 'outcome/succeeded_with_violations/warn' ELSE 'outcome/succeeded/info' END,
        CASE WHEN coverage >= {floor} AND value < 0.85 THEN 1.0 ELSE 0.0 END::DOUBLE FROM c, scalars WHERE metric = 'accuracy'"""


ORACLES = {
    "mq_labelled": f"""{_LABELLED} SELECT 'mq/' || metric AS name, {r('value')} AS value FROM scalars UNION ALL SELECT name, {r('value')} FROM gt
        UNION ALL SELECT 'mq/rows_dropped', (count(*) FILTER (label IS NULL))::DOUBLE FROM pred UNION ALL {_labelled_end(0.3)}""",
    "mq_insufficient": f"{_LABELLED} SELECT name, {r('value')} AS value FROM gt UNION ALL {_labelled_end(0.999)}",
    "gt_settled": f"""WITH j AS (SELECT o_orderkey, o_orderstatus, o_orderdate, l_shipdate, l_returnflag,
            row_number() OVER (PARTITION BY o_orderkey, o_orderstatus, o_orderdate ORDER BY l_shipdate DESC NULLS LAST, l_returnflag DESC) AS place
          FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 60 DAY)
        SELECT o_orderkey AS inference_id, o_orderstatus AS prediction, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts,
          l_returnflag AS label, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS label_ts
        FROM j WHERE place = 1 AND o_orderdate + INTERVAL 60 DAY < TIMESTAMP '{AS_OF}'""",
    "mq_confusion": f"""{_MULTI} {_SCORES}
        SELECT a.class AS label, b.class AS prediction, coalesce(n, 0)::BIGINT AS n
        FROM classes a CROSS JOIN classes b LEFT JOIN cells ON cells.label = a.class AND cells.prediction = b.class""",
    "mq_scalars": f"{_MULTI} {_SCORES} SELECT metric, {r('value')} AS value FROM scalars",
    "mq_per_class": f"""{_MULTI} {_SCORES}, pc AS ({_PER_CLASS})
        SELECT 'mq/' || metric || '_per_class/' || class AS name, {r('value')} AS value FROM pc""",
    "mq_auc": f"{_MULTI} {_auc_sql('score', chr(39).join(['label = ', 'R', ''])) % 'pred'} SELECT {r('auc')} AS auc FROM auc",
    "mq_auc_ties": f"WITH {_auc_sql('l_quantity / 50', 'l_discount > 0.05::DOUBLE') % 'lineitem'} SELECT {r('auc')} AS auc FROM auc",
    "mq_metrics_binary": f"""{_ALL_BINARY} SELECT 'mq/' || metric AS name, {r('value')} AS value FROM metrics
        UNION ALL SELECT 'mq/rows_dropped', {r("count(*) FILTER (label IS NULL OR prediction IS NULL)::DOUBLE")} FROM pred""",
    "mq_baseline_delta": f"""{_ALL_BINARY} SELECT metric, {r('baseline')} AS baseline, {r('current')} AS current,
        {r('delta')} AS delta FROM delta""",
    "mq_degradation": f"""{_ALL_BINARY} SELECT 'degradation' AS type, metric AS subject, {r('current')} AS value,
        {r('baseline')} AS reference, {r('threshold')} AS threshold FROM bad""",
    "mq_outcome": f"""{_ALL_BINARY} SELECT 'mq' AS analyser,
        CASE WHEN count(*) > 0 THEN 'succeeded_with_violations' ELSE 'succeeded' END AS outcome,
        CASE WHEN count(*) = 0 THEN 'info' WHEN count(*) >= 2 THEN 'alert' ELSE 'warn' END AS severity,
        count(*)::BIGINT AS violation_count FROM bad""",
    "mq_empty": """SELECT 'mq' AS analyser, CASE WHEN count(*) = 0 THEN 'skipped_no_input' ELSE 'succeeded' END AS outcome,
        'info' AS severity, 0::BIGINT AS violation_count FROM lineitem WHERE l_quantity < 0""",
    "mq_payload": f"""{_MULTI} {_SCORES} SELECT 'MQ' AS monitor_type, 'multiclass' AS problem_type, 'succeeded' AS outcome,
        (5 + 3 * (SELECT count(*) FROM classes))::BIGINT AS metrics, ((SELECT count(*) FROM classes) * (SELECT count(*) FROM classes))::BIGINT AS cells,
        sum(n)::BIGINT AS pairs FROM cells""",
    "mq_metric_view": f"""{_MULTI} {_SCORES}, pc AS ({_PER_CLASS})
        SELECT 'scalar' AS section, NULL::VARCHAR AS class, metric, {r('value')} AS value FROM scalars
        UNION ALL SELECT 'scalar', NULL, 'rows_dropped', {r("count(*) FILTER (label IS NULL OR prediction IS NULL)::DOUBLE")} FROM pred
        UNION ALL SELECT 'per_class', class, metric, {r('value')} FROM pc""",
    "mq_constraints": f"{_ALL_BINARY} SELECT metric, {r('value')} AS baseline, 0.05::DOUBLE AS threshold FROM metrics",
    "gt_join": f"{_GT} SELECT inference_id, prediction, label, strftime(label_ts, '%Y-%m-%d %H:%M:%S') AS label_ts FROM joined",
    "gt_coverage": f"""{_GT}, c AS (SELECT count(*) AS captured, count(label_ts) AS matched FROM joined)
        SELECT captured::BIGINT AS captured, matched::BIGINT AS matched,
          {r('CASE WHEN captured = 0 THEN 0.0 ELSE matched / captured::DOUBLE END')} AS coverage,
          CASE WHEN captured = 0 THEN 'skipped_no_input' WHEN matched / captured::DOUBLE < 0.3 THEN 'skipped_insufficient_data'
               ELSE 'succeeded' END AS outcome,
          CASE WHEN captured > 0 AND matched / captured::DOUBLE < 0.3 THEN 'warn' ELSE 'info' END AS severity FROM c""",
}
