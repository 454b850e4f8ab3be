"""Registry queries: customers are projects, their orders are model versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import registry
from tidewatch.plans.baseline import BaselineWorkflow, GroupedMonitor
from tidewatch.queries.common import scratch, table
from tidewatch.session import written
from tidewatch.sources.sinks import REGISTRY_SCHEMA, MonitorStore

MONITORS = ("bias", "data_quality", "explainability", "model_quality", "shadow")
REQUIRED = ["dq", "mq", "bias"]


def _project(key: str) -> Column:
    return F.concat(F.lit("proj-"), F.col(key).cast("string")).alias("project")


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest per order; which artifacts it lists follows from the order key."""
    key = F.col("o_orderkey")
    names = ("training_snapshot", "evaluation_results", "predictions", "model")
    entries = [F.struct(F.lit(n).alias("key"), F.concat(F.lit("input/"), F.lit(n)).alias("value")) for n in names]
    present = F.array_compact(F.array(*[F.when(key % (i + 4) != 0, e) for i, e in enumerate(entries)]))
    return table(spark, sf_dir, "orders").select(
        _project("o_custkey"), key.cast("string").alias("model_version"), F.map_from_entries(present).alias("artifacts")
    )


def config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five monitor settings per customer."""
    key = F.col("c_custkey")
    settings = F.array(
        *[
            F.struct(
                F.lit(m).alias("monitor"), ((key + i) % 6 != 0).alias("enabled"), ((key + i) % 4 == 0).alias("required")
            )
            for i, m in enumerate(MONITORS)
        ]
    )
    return table(spark, sf_dir, "customer").select(_project("c_custkey"), F.inline(settings))


def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = registry.gate(manifests(spark, sf_dir), config(spark, sf_dir))
    return gated.select(
        "project",
        "model_version",
        "status",
        "message",
        F.size("warnings").cast("bigint").alias("warnings"),
        F.array_join("monitors_to_run", ",").alias("monitors_to_run"),
    )


def required_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items report analyser results of their order; some analysers never report."""
    number, quantity = F.col("l_linenumber"), F.col("l_quantity")
    names = F.array(*[F.lit(a) for a in ("dq", "mq", "bias", "explain")])
    outcome = (
        F.when(quantity < 30, "succeeded").when(quantity < 45, "ok").when(quantity < 48, "succeeded_with_violations")
        .otherwise("failed_handled")
    )
    results = table(spark, sf_dir, "lineitem").select(
        F.lit("proj").alias("project"),
        F.col("l_orderkey").cast("string").alias("model_version"),
        F.get(names, (number % 4).cast("int")).alias("analyser"),
        outcome.alias("outcome"),
    )
    versions = table(spark, sf_dir, "orders").select(
        F.lit("proj").alias("project"), F.col("o_orderkey").cast("string").alias("model_version")
    )
    return registry.check_results(versions, results, REQUIRED)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions evaluated by their gate, finished orders approved."""
    return table(spark, sf_dir, "orders").select(
        _project("o_custkey"),
        F.col("o_orderkey").cast("string").alias("model_version"),
        F.when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected").alias("status"),
        F.concat(F.lit("baselines/"), F.col("o_orderkey").cast("string")).alias("baseline_prefix"),
        F.create_map(F.lit("dq"), F.lit("ok")).alias("analysers"),
        F.lit("manifest.json").alias("manifest_uri"),
        F.col("o_orderdate").cast("timestamp").alias("evaluated_at"),
        F.lit("exec").alias("execution_id"),
    )


def registry_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append early versions, then all of them, the overlap with another status: first write wins."""
    store = MonitorStore(scratch(spark, "registry"))
    candidates = _candidates(spark, sf_dir)
    store.append_registry(spark, candidates.where(F.col("evaluated_at") < F.lit("1998-01-01").cast("timestamp")))
    late = candidates.withColumn("status", F.lit("late"))
    return store.append_registry(spark, late.unionByName(late)).select("project", "model_version", "status")


def _endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        _project("o_custkey"), F.col("o_orderkey").cast("string").alias("model_version")
    )


def activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _candidates(spark, sf_dir).join(
        table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "O").select(
            F.col("o_orderkey").cast("string").alias("model_version")
        ),
        "model_version",
        "left_semi",
    )
    active = registry.activation(_endpoints(spark, sf_dir), known)
    return active.select("project", "model_version", "activate", "baseline_prefix", "reason")


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.active_endpoints(_endpoints(spark, sf_dir), _candidates(spark, sf_dir))


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "orders").select(
        F.format_string("proj-%d/v%d/config.json", "o_custkey", "o_orderkey").alias("key")
    )
    return registry.latest_versions(objects)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest JSON per order, broken in one of several ways for most order keys."""
    key = F.col("o_orderkey")
    text = F.concat(
        F.lit('{"schema_version": "'),
        F.when(key % 16 == 1, "2").otherwise("1"),
        F.lit('", "project": "'),
        F.when(key % 16 == 2, "").otherwise(F.concat(F.lit("proj-"), F.col("o_custkey").cast("string"))),
        F.lit('", "model_version": "'),
        key.cast("string"),
        F.lit('", "produced_at": "'),
        F.when(key % 16 == 3, "yesterday").otherwise("2024-01-02T03:04:05Z"),
        F.lit('", "provenance": {"git_sha": "abc"'),
        F.when(key % 16 == 4, "").otherwise(', "pipeline_run_id": "r1"'),
        F.when(key % 16 == 5, ', "user": "x"').otherwise(""),
        F.lit('}, "artifacts": '),
        F.when(key % 16 == 6, "{}").when(key % 16 == 7, '{"model": 7}').otherwise('{"model": "input/model"}'),
        F.when(key % 16 == 8, ', "extra": 1').otherwise(""),
        F.when(key % 16 == 9, "").otherwise("}"),
    )
    return table(spark, sf_dir, "orders").select(key.alias("id"), text.alias("document"))


def manifest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = registry.check_manifests(documents(spark, sf_dir))
    return checked.select("id", "problem", "manifest.project", F.element_at("manifest.artifacts", "model").alias("model"))


def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the rows that monitors of their order read."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    quantity, part = F.col("l_quantity"), F.col("l_partkey")
    return joined.select(
        _project("o_custkey"),
        F.col("l_orderkey").cast("string").alias("model_version"),
        F.when(F.col("l_tax") >= 0.01, F.col("l_tax")).alias("tax"),
        (quantity > 25).alias("label"),
        (F.pmod(part, F.lit(10)) < F.when(quantity > 25, 8).otherwise(3)).alias("prediction"),
        (F.col("l_returnflag") == "R").alias("facet"),
        F.col("l_linestatus").alias("variant"),
    )


def fleet_monitors(spark: SparkSession, sf_dir: str) -> dict[str, GroupedMonitor]:
    """The five kinds of monitors as aggregates over an order's line items, which are joined once for all of them."""
    rows = written(_line_items(spark, sf_dir), "line-items")
    label, prediction, facet = F.col("label"), F.col("prediction"), F.col("facet")
    share = lambda where: F.avg(F.when(where, label.cast("int")))
    return {
        "data_quality": GroupedMonitor(rows, {"completeness": F.count("tax") / F.count("*")}, {"completeness": lambda m: m < 0.75}),
        "model_quality": GroupedMonitor(rows, {"accuracy": F.avg((label == prediction).cast("int"))}, {"accuracy": lambda m: m < 0.6}, 2),
        "bias": GroupedMonitor(rows, {"dpl": share(facet) - share(~facet)}, {"dpl": lambda m: F.abs(m) > 0.9}, 2),
        "explainability": GroupedMonitor(rows, {"rows": F.count("*")}, {}),
        "shadow": GroupedMonitor(rows.where("variant = 'F'"), {"agreement": F.avg((label == prediction).cast("int"))}, {"agreement": lambda m: m < 0.5}),
    }


def baseline_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders from their manifests to the registry; a second run finds nothing left to do."""
    store = MonitorStore(scratch(spark, "baseline"))
    known = manifests(spark, sf_dir)
    known = known.withColumn("problem", F.when(F.col("model_version").cast("bigint") % 50 == 3, "not a JSON object"))
    monitors = fleet_monitors(spark, sf_dir)
    flow = BaselineWorkflow(store, monitors, "run-1")
    flow.run(known, config(spark, sf_dir))
    BaselineWorkflow(store, monitors, "run-2").run(known, config(spark, sf_dir))
    rows = store.inserted(spark, "registry", REGISTRY_SCHEMA).join(flow.decisions(spark).drop("status", "analysers", "baseline_prefix", "manifest_uri"), registry.VERSION)
    ended = F.transform(F.sort_array(F.map_entries("analysers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select(
        "project", "model_version", "status", "message", F.array_join(ended, ",").alias("analysers"),
        F.array_join("missing", ",").alias("missing"), F.array_join("skipped", ",").alias("skipped"),
        F.array_join("unplanned", ",").alias("unplanned"), "execution_id",
    )


QUERIES = {
    "baseline_workflow": baseline_workflow,
    "gate_status": gate_status,
    "required_check": required_check,
    "registry_append": registry_append,
    "activation": activation,
    "active_endpoints": active,
    "latest_version": latest_version,
    "manifest_validate": manifest_validate,
}

_NEEDS = """
needs AS (SELECT * FROM (VALUES ('bias', 0, ['training_snapshot', 'evaluation_results', 'model']),
  ('data_quality', 1, ['training_snapshot', 'evaluation_results']), ('explainability', 2, ['training_snapshot', 'model']),
  ('model_quality', 3, ['training_snapshot', 'predictions', 'model']), ('shadow', 4, []::VARCHAR[])) t(monitor, i, needed))"""

ORACLES = {
    "baseline_workflow": f"""WITH {_NEEDS},
      man AS (SELECT 'proj-' || o_custkey AS project, o_orderkey AS k, o_orderkey % 50 = 3 AS broken,
        list_filter([CASE WHEN o_orderkey % 4 <> 0 THEN 'training_snapshot' END, CASE WHEN o_orderkey % 5 <> 0 THEN 'evaluation_results' END,
          CASE WHEN o_orderkey % 6 <> 0 THEN 'predictions' END, CASE WHEN o_orderkey % 7 <> 0 THEN 'model' END], lambda v: v IS NOT NULL) AS present FROM orders),
      cfg AS (SELECT 'proj-' || c_custkey AS project, monitor, needed, (c_custkey + i) % 4 = 0 AS required
        FROM customer, needs WHERE (c_custkey + i) % 6 <> 0),
      chk AS (SELECT k, broken, monitor, required, NOT list_has_all(present, needed) AS lacks FROM man LEFT JOIN cfg USING (project)),
      gated AS (SELECT k, any_value(broken) AS broken, coalesce(bool_or(lacks AND required), false) AS failed, count(*) FILTER (lacks) AS n FROM chk GROUP BY k),
      item AS (SELECT l_orderkey AS k, l_linestatus = 'F' AS serving, (l_tax >= 0.01)::INT AS tax, (l_quantity > 25)::INT AS label, l_returnflag = 'R' AS facet,
        (l_quantity > 25) = (l_partkey % 10 < CASE WHEN l_quantity > 25 THEN 8 ELSE 3 END) AS hit FROM lineitem),
      m AS (SELECT k, count(*) AS c, count(*) FILTER (serving) AS s, avg(tax) AS complete, avg(hit::INT) AS accuracy, avg(hit::INT) FILTER (serving) AS agreement,
        avg(label) FILTER (facet) - avg(label) FILTER (NOT facet) AS dpl FROM item GROUP BY k),
      ran AS (SELECT chk.k, monitor, CASE
          WHEN coalesce(c, 0) = 0 OR (monitor = 'shadow' AND s = 0) THEN 'skipped_no_input'
          WHEN monitor IN ('model_quality', 'bias') AND c < 2 THEN 'skipped_insufficient_data'
          WHEN coalesce(CASE monitor WHEN 'data_quality' THEN complete < 0.75 WHEN 'model_quality' THEN accuracy < 0.6
            WHEN 'bias' THEN abs(dpl) > 0.9 WHEN 'shadow' THEN agreement < 0.5 END, false) THEN 'succeeded_with_violations'
          ELSE 'succeeded' END AS outcome, required
        FROM chk JOIN gated USING (k) LEFT JOIN m ON m.k = chk.k WHERE NOT failed AND NOT gated.broken AND NOT lacks),
      ended AS (SELECT k, string_agg(monitor || '=' || outcome, ',' ORDER BY monitor) AS analysers,
        string_agg(monitor || ' (' || outcome || ')', ', ' ORDER BY monitor) FILTER (required AND outcome <> 'succeeded') AS bad,
        string_agg(monitor, ',' ORDER BY monitor) FILTER (required AND outcome LIKE 'skipped%') AS skipped FROM ran GROUP BY k)
      SELECT project, man.k::VARCHAR AS model_version, CASE WHEN man.broken OR failed OR bad IS NOT NULL THEN 'rejected' ELSE 'approved' END AS status,
        CASE WHEN man.broken THEN 'Gate logic error: not a JSON object' WHEN failed THEN 'Baseline gating failed: ' || n || ' required artifact(s) missing'
          WHEN bad IS NULL THEN 'All required analysers passed' ELSE 'Required analysers failed: ' || bad END AS message,
        coalesce(analysers, '') AS analysers, '' AS missing, coalesce(skipped, '') AS skipped, '' AS unplanned, 'run-1' AS execution_id
      FROM man JOIN gated USING (k) LEFT JOIN ended ON ended.k = man.k""",
    "gate_status": f"""WITH {_NEEDS},
      man AS (SELECT 'proj-' || o_custkey AS project, o_orderkey::VARCHAR AS model_version,
        list_filter([CASE WHEN o_orderkey % 4 <> 0 THEN 'training_snapshot' END, CASE WHEN o_orderkey % 5 <> 0 THEN 'evaluation_results' END,
          CASE WHEN o_orderkey % 6 <> 0 THEN 'predictions' END, CASE WHEN o_orderkey % 7 <> 0 THEN 'model' END], lambda v: v IS NOT NULL) AS present FROM orders),
      cfg AS (SELECT 'proj-' || c_custkey AS project, monitor, needed, (c_custkey + i) % 4 = 0 AS required
        FROM customer, needs WHERE (c_custkey + i) % 6 <> 0),
      chk AS (SELECT man.project, model_version, monitor, required, NOT list_has_all(present, needed) AS missing
        FROM man LEFT JOIN cfg ON man.project = cfg.project),
      agg AS (SELECT project, model_version, coalesce(bool_or(missing AND required), false) AS failed,
        count(*) FILTER (missing) AS warnings,
        coalesce(string_agg(monitor, ',' ORDER BY monitor) FILTER (NOT missing), '') AS plan FROM chk GROUP BY project, model_version)
      SELECT project, model_version, CASE WHEN failed THEN 'rejected' WHEN warnings > 0 THEN 'approved_with_warnings' ELSE 'approved' END AS status,
        CASE WHEN failed THEN 'Baseline gating failed: ' || warnings || ' required artifact(s) missing' ELSE 'Baseline gating passed' END AS message,
        warnings::BIGINT AS warnings, CASE WHEN failed THEN '' ELSE plan END AS monitors_to_run FROM agg""",
    "required_check": """WITH res AS (SELECT l_orderkey AS k, (['dq', 'mq', 'bias', 'explain'])[l_linenumber % 4 + 1] AS analyser,
        CASE WHEN l_quantity < 30 THEN 'succeeded' WHEN l_quantity < 45 THEN 'ok' WHEN l_quantity < 48 THEN 'succeeded_with_violations'
          ELSE 'failed_handled' END AS outcome FROM lineitem),
      worst AS (SELECT k, analyser, coalesce(max(outcome) FILTER (outcome NOT IN ('ok', 'succeeded')), max(outcome)) AS outcome FROM res GROUP BY k, analyser),
      req AS (SELECT o_orderkey AS k, i, a FROM orders, (VALUES (1, 'dq'), (2, 'mq'), (3, 'bias')) t(i, a)),
      st AS (SELECT req.k, i, CASE WHEN outcome IS NULL THEN a || ' (missing)' WHEN outcome NOT IN ('ok', 'succeeded') THEN a || ' (' || outcome || ')' END AS p
        FROM req LEFT JOIN worst ON req.k = worst.k AND req.a = worst.analyser),
      f AS (SELECT k, string_agg(p, ', ' ORDER BY i) AS p FROM st GROUP BY k)
      SELECT 'proj' AS project, k::VARCHAR AS model_version, CASE WHEN p IS NULL THEN 'approved' ELSE 'rejected' END AS status,
        CASE WHEN p IS NULL THEN 'All required analysers passed' ELSE 'Required analysers failed: ' || p END AS message,
        p IS NULL AS all_required_ok FROM f""",
    "registry_append": """SELECT 'proj-' || o_custkey AS project, o_orderkey::VARCHAR AS model_version,
        CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'late' WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'rejected' END AS status FROM orders""",
    "activation": """SELECT 'proj-' || o_custkey AS project, o_orderkey::VARCHAR AS model_version, o_orderstatus = 'F' AS activate,
        CASE WHEN o_orderstatus = 'F' THEN 'baselines/' || o_orderkey END AS baseline_prefix,
        CASE WHEN o_orderstatus = 'O' THEN 'Model version ' || o_orderkey || ' not found in baseline registry for project proj-' || o_custkey
          WHEN o_orderstatus <> 'F' THEN 'Baseline rejected' END AS reason FROM orders""",
    "active_endpoints": """SELECT 'proj-' || o_custkey AS project, o_orderkey::VARCHAR AS model_version FROM orders WHERE o_orderstatus = 'F'""",
    "latest_version": """SELECT 'proj-' || o_custkey AS project, max(o_orderkey) AS version,
        'proj-' || o_custkey || '/v' || max(o_orderkey) || '/config.json' AS key FROM orders GROUP BY o_custkey""",
    "manifest_validate": """SELECT o_orderkey AS id,
        CASE o_orderkey % 16 WHEN 1 THEN 'unsupported schema_version' WHEN 2 THEN 'project is missing or empty' WHEN 3 THEN 'produced_at is no timestamp'
          WHEN 4 THEN 'provenance.pipeline_run_id is missing or empty' WHEN 5 THEN 'unknown provenance field' WHEN 6 THEN 'artifacts are missing or empty'
          WHEN 7 THEN 'artifacts hold a value that is no text' WHEN 8 THEN 'unknown field' WHEN 9 THEN 'not a JSON object' END AS problem,
        CASE WHEN o_orderkey % 16 NOT BETWEEN 1 AND 9 THEN 'proj-' || o_custkey END AS project,
        CASE WHEN o_orderkey % 16 NOT BETWEEN 1 AND 9 THEN 'input/model' END AS model FROM orders""",
}
