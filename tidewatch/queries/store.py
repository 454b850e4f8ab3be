"""Source and sink queries: write with the engine, read back, compare with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.rollup import standard_metrics as standard_rows
from tidewatch.plans.job import Monitor, RunContext, run_all
from tidewatch.plans.runs import Bias, DataQuality, ModelQuality
from tidewatch.queries import bias, dq, mq
from tidewatch.queries.common import OUTCOMES_SQL, outcomes, r, scratch, table, tidy
from tidewatch.sources.readers import read_inputs, read_raw_csv, read_snapshot
from tidewatch.sources.sinks import METRIC_TABLE_SCHEMA, FAILURE_SCHEMA, MonitorStore, latest_rows

RAW_SCHEMA = "id bigint, price double, priority string, note string, label string"


def parquet_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = read_inputs(spark, {n: f"{sf_dir}/{n}.parquet" for n in ("orders", "lineitem")})
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("input"), "rows") for n, df in inputs.items()]
    return counts[0].unionByName(counts[1])


def jsonl_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as JSON lines and read with a given schema."""
    path = scratch(spark, "snapshot")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    orders.write.json(path)
    snapshot = read_snapshot(spark, path, orders.schema)
    return tidy(snapshot, "o_orderkey", "o_totalprice", "o_orderpriority")


def csv_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw CSV with leading blanks, ``?`` for missing values and dotted labels, cleaned on reading."""
    key = F.col("o_orderkey")
    lines = table(spark, sf_dir, "orders").select(
        F.concat_ws(
            ", ",
            key.cast("string"),
            F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string"),
            F.when(key % 5 == 0, "?").otherwise(F.col("o_orderpriority")),
            F.when(key % 7 == 0, "?").otherwise("ok"),
            F.concat(F.col("o_orderstatus"), F.when(key % 2 == 0, ".").otherwise("")),
        ).alias("value")
    )
    path = scratch(spark, "raw")
    lines.write.text(path)
    return tidy(read_raw_csv(spark, path, RAW_SCHEMA, ["id", "price", "priority", "label"], "label"), "id", "price", "priority", "label")


def _monitors(spark: SparkSession, sf_dir: str) -> list[Monitor]:
    current, baseline = dq.windows(spark, sf_dir)

    def context(analyser: str) -> RunContext:
        return RunContext(f"run-{analyser}", analyser, "orders", "prod", image_digest="sha256:0", git_sha="0" * 7)

    bias_config = {**bias.BASE, "methods": bias.DISTRIBUTION, "thresholds": {"CI": 0.1}}
    return [
        Monitor(DataQuality(), context("dq"), {"current": current, "baseline": baseline}, dq.CONFIG),
        Monitor(ModelQuality(), context("mq"), {"predictions": mq.binary(spark, sf_dir)}, mq.BINARY),
        Monitor(Bias(), context("bias"), {"dataset": bias.dataset(spark, sf_dir)}, bias_config),
        # asks for a label column that line items do not have
        Monitor(ModelQuality(), context("shadow"), {"predictions": mq.binary(spark, sf_dir)}, {**mq.BINARY, "label_column": "no_such_label"}),
    ]


def _stored(spark: SparkSession, sf_dir: str) -> MonitorStore:
    """The store of one run of the job."""
    store = MonitorStore(scratch(spark, "store"))
    run_all(spark, store, _monitors(spark, sf_dir), parallel=4)
    return store


def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four monitors side by side, one of them broken: its failure stays its own."""
    stored = _stored(spark, sf_dir).outcomes(spark)
    return stored.select("run_id", "analyser_type", "outcome", "severity", "violation_count")


def job_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stored(spark, sf_dir).read(spark, "metrics", METRIC_TABLE_SCHEMA)
    picked = rows.where(F.col("metric_name") != "RunDurationSeconds")
    return tidy(picked, "analyser_type", "metric_name", "name", "value", "unit")


def job_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stored(spark, sf_dir).read(spark, "failures", FAILURE_SCHEMA)
    return rows.select("analyser_type", "outcome", "exception_class", F.col("message").contains("no_such_label").alias("named"))


def job_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result documents and provenance of the runs that succeeded."""
    store = _stored(spark, sf_dir)
    documents = spark.read.text(store.path("results")).select(
        "analyser", F.get_json_object("value", "$.outcome.outcome").alias("outcome"),
        F.get_json_object("value", "$.outcome.violation_count").cast("bigint").alias("violation_count"),
    )
    provenance = spark.read.json(store.path("provenance")).select("analyser", "git_sha")
    return documents.join(provenance, "analyser")


def outcome_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome rows written twice, the second time with a later end: one row per run is read."""
    path = scratch(spark, "outcomes")
    rows = outcomes(spark, sf_dir).withColumn("ended_at", F.coalesce("ended_at", "started_at"))
    rows.write.parquet(path)
    rows.withColumn("ended_at", F.col("ended_at") + F.expr("INTERVAL 1 MINUTE")).withColumn(
        "outcome", F.lit("succeeded")
    ).where(F.col("project") == "proj-3").write.mode("append").parquet(path)
    latest = latest_rows(spark.read.parquet(path), ["run_id", "analyser_type"], "ended_at")
    return latest.select("run_id", "analyser_type", "outcome")


def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard metrics of all runs, appended by day and read back summed."""
    path = scratch(spark, "metrics")
    rows = standard_rows(outcomes(spark, sf_dir).withColumn("duration_seconds", F.lit(0.0)))
    rows.withColumn("dt", F.to_date("ts")).write.partitionBy("dt").parquet(path)
    back = spark.read.parquet(path)
    return tidy(back.groupBy(F.col("dt").cast("string").alias("dt"), "metric_name").agg(F.sum("value").alias("value")), "dt", "metric_name", "value")


QUERIES = {
    "parquet_inputs": parquet_inputs,
    "jsonl_snapshot": jsonl_snapshot,
    "csv_clean": csv_clean,
    "job_outcomes": job_outcomes,
    "job_metrics": job_metrics,
    "job_failures": job_failures,
    "job_documents": job_documents,
    "outcome_table": outcome_table,
    "metric_table": metric_table,
}


def _nested(name: str, sql: str) -> str:
    return f"{name} AS ({sql})"


_RUNS = ", ".join(
    [
        _nested("o_dq", dq.ORACLES["dq_outcome"]),
        _nested("o_mq", mq.ORACLES["mq_outcome"]),
        _nested(
            "o_bias",
            f"""WITH {bias._report_sql(bias.DISTRIBUTION)}, c AS (SELECT count(*) AS n FROM rep WHERE metric = 'CI' AND abs(value) > 0.1)
            SELECT 'bias' AS analyser, CASE WHEN n > 0 THEN 'succeeded_with_violations' ELSE 'succeeded' END AS outcome,
            CASE WHEN n > 0 THEN 'warn' ELSE 'info' END AS severity, n::BIGINT AS violation_count FROM c""",
        ),
    ]
)
_ALL = f"""WITH {_RUNS}, runs AS (SELECT * FROM o_dq UNION ALL BY NAME SELECT * FROM o_mq UNION ALL BY NAME SELECT * FROM o_bias
  UNION ALL SELECT 'shadow', 'failed_unhandled', 'alert', 0)"""

ORACLES = {
    "parquet_inputs": """SELECT 'orders' AS input, count(*)::BIGINT AS rows FROM orders
        UNION ALL SELECT 'lineitem', count(*)::BIGINT FROM lineitem""",
    "jsonl_snapshot": f"SELECT o_orderkey, {r('o_totalprice')} AS o_totalprice, o_orderpriority FROM orders",
    "csv_clean": f"""SELECT o_orderkey AS id, {r('round(o_totalprice, 2)')} AS price, o_orderpriority AS priority, o_orderstatus AS label
        FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0""",
    "job_outcomes": f"""{_ALL} SELECT 'run-' || analyser AS run_id, analyser AS analyser_type, outcome, severity,
        violation_count::BIGINT AS violation_count FROM runs""",
    "job_metrics": f"""{_ALL}, m AS ({dq.ORACLES['dq_metrics']}), q AS ({mq.ORACLES['mq_metrics_binary']}), b AS ({bias.ORACLES['bias_pretraining']})
        SELECT 'dq' AS analyser_type, 'MetricValue' AS metric_name, name, value, 'None' AS unit FROM m
        UNION ALL SELECT 'mq', 'MetricValue', name, value, 'None' FROM q
        UNION ALL SELECT 'bias', 'MetricValue', concat_ws('/', facet, stage, metric), value, 'None' FROM b WHERE value IS NOT NULL
        UNION ALL SELECT analyser, 'RunCount', 'RunCount', 1.0, 'Count' FROM runs
        UNION ALL SELECT analyser, 'ViolationCount', 'ViolationCount', violation_count, 'Count' FROM runs
        UNION ALL SELECT analyser, 'Severity', 'Severity', CASE severity WHEN 'info' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, 'None'
          FROM runs""",
    "job_failures": """SELECT 'shadow' AS analyser_type, 'failed_unhandled' AS outcome, 'PySparkKeyError' AS exception_class, true AS named
        FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0""",
    "job_documents": f"""{_ALL} SELECT analyser, outcome, violation_count::BIGINT AS violation_count, '0000000' AS git_sha FROM runs WHERE analyser <> 'shadow'""",
    "outcome_table": f"""{OUTCOMES_SQL} SELECT run_id, analyser_type, CASE WHEN project = 'proj-3' THEN 'succeeded' ELSE outcome END AS outcome FROM outcomes""",
    "metric_table": f"""{OUTCOMES_SQL}, m AS (
        SELECT started_at, 'RunCount' AS metric_name, 1 AS v FROM outcomes UNION ALL SELECT started_at, 'RunDurationSeconds', 0 FROM outcomes
        UNION ALL SELECT started_at, 'ViolationCount', violation_count FROM outcomes
        UNION ALL SELECT started_at, 'Severity', CASE severity WHEN 'info' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END FROM outcomes)
        SELECT strftime(started_at, '%Y-%m-%d') AS dt, metric_name, {r('sum(v)::DOUBLE')} AS value FROM m GROUP BY 1, 2""",
}
