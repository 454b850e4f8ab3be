"""Baseline gate, result check, registry and activation, as set operations over a whole fleet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = ["project", "model_version"]

# Artifacts each monitor needs, other spellings of monitor names, accepted outcomes of a
# required analyser, supported manifest version, message formats.
NEEDED_ARTIFACTS = {
    "model_quality": ["training_snapshot", "predictions", "model"],
    "data_quality": ["training_snapshot", "evaluation_results"],
    "bias": ["training_snapshot", "evaluation_results", "model"],
    "explainability": ["training_snapshot", "model"],
    "shadow": [],
}
ALIASES = {"mq": "model_quality", "dq": "data_quality", "explain": "explainability"}
ACCEPTED_RESULTS = ("ok", "succeeded")
MANIFEST_VERSION = "1"
GATE_FAILED = "Baseline gating failed: %d required artifact(s) missing"
GATE_PASSED = "Baseline gating passed"
RESULTS_FAILED = "Required analysers failed: %s"
RESULTS_PASSED = "All required analysers passed"
NOT_FOUND = "Model version %s not found in baseline registry for project %s"
REJECTED = "Baseline rejected"

_MANIFEST_FIELDS = ("schema_version", "project", "model_version", "produced_at", "provenance", "artifacts")
_PROVENANCE_FIELDS = ("git_sha", "pipeline_run_id")


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _names(monitor: str) -> list[str]:
    return [monitor] + [alias for alias, target in ALIASES.items() if target == monitor]


def gate(manifests: DataFrame, config: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Gate every ``(project, model_version)`` manifest against its project's monitor settings.

    Returns status, message, warnings and the monitors to run. ``config`` holds one row
    ``(project, monitor, enabled, required)`` per monitor; a project's monitors are folded into one
    short array, so a manifest meets one config row. Which kinds of monitor lack artifacts depends on the
    manifest alone and is worked out once per manifest. An unknown monitor needs nothing and passes. ``keep`` names
    further columns of the manifests that the rows keep.
    """
    bit = F.lit(0)  # each kind of monitor is one bit, unknown kinds are none
    mask = F.lit(0)
    for i, (kind, needed) in enumerate(NEEDED_ARTIFACTS.items()):
        bit = F.when(F.col("monitor").isin(_names(kind)), F.lit(1 << i)).otherwise(bit)
        absent = reduce(lambda x, y: x | y, [~F.array_contains("present", n) for n in needed], F.lit(False))
        mask = mask.bitwiseOR(F.when(absent, F.lit(1 << i)).otherwise(F.lit(0)))
    monitors = config.where("enabled").groupBy("project").agg(
        F.sort_array(F.collect_list(F.struct("monitor", "required", bit.alias("bit")))).alias("monitors")
    )
    no_monitors = F.array().cast("array<struct<monitor:string,required:boolean,bit:int>>")
    joined = (
        manifests.withColumn("present", F.map_keys("artifacts"))
        .withColumn("lacking", mask)
        .join(monitors, "project", "left")
        .withColumn("monitors", F.coalesce("monitors", no_monitors))
    )
    lacks = F.col("lacking")
    split = joined.select(
        *VERSION,
        *keep,
        "present",
        F.filter("monitors", lambda m: m["bit"].bitwiseAND(lacks) != 0).alias("missing"),
        F.filter("monitors", lambda m: m["bit"].bitwiseAND(lacks) == 0).alias("runnable"),
    ).withColumn("failed", F.exists("missing", lambda m: m["required"]))
    expected = F.create_map(
        *[
            F.lit(text)
            for kind, needed in NEEDED_ARTIFACTS.items()
            for name in _names(kind)
            for text in (name, ", ".join(needed))
        ]
    )
    warnings = F.transform(
        "missing",
        lambda m: F.concat(
            F.when(m["required"], "Required").otherwise("Optional"),
            F.lit(" monitor "),
            m["monitor"],
            F.lit(" missing artifacts: expected "),
            F.try_element_at(expected, m["monitor"]),
            F.lit("; present "),
            F.array_join("present", ", "),
        ),
    )
    count = F.size("missing")
    return split.select(
        *VERSION,
        F.when(F.col("failed"), "rejected").when(count > 0, "approved_with_warnings").otherwise("approved").alias("status"),
        F.when(F.col("failed"), F.format_string(GATE_FAILED, count)).otherwise(GATE_PASSED).alias("message"),
        warnings.alias("warnings"),
        F.when(F.col("failed"), _texts([])).otherwise(F.col("runnable.monitor")).alias("monitors_to_run"),
        *keep,
    )


def check_results(versions: DataFrame, results: DataFrame, required: Sequence[str]) -> DataFrame:
    """Approve each version whose required analysers all ended ``ok`` or ``succeeded``.

    ``results`` holds ``(project, model_version, analyser, outcome)``; of repeated results of one analyser
    a rejected one counts. Conditional aggregates per required analyser combine map-side; nothing is
    collected into lists.
    """
    outcome, accepted = F.col("outcome"), F.col("outcome").isin(*ACCEPTED_RESULTS)
    worst = [
        F.coalesce(
            F.max(F.when((F.col("analyser") == name) & ~accepted, outcome)),
            F.max(F.when((F.col("analyser") == name) & accepted, outcome)),
        ).alias(f"outcome_{i}")
        for i, name in enumerate(required)
    ]
    pivoted = results.groupBy(*VERSION).agg(*worst)
    joined = versions.select(*VERSION).join(pivoted, VERSION, "left")
    problems = [
        F.when(
            F.col(f"outcome_{i}").isNull(), F.lit(f"{name} (missing)")
        ).when(
            ~F.col(f"outcome_{i}").isin(*ACCEPTED_RESULTS), F.concat(F.lit(f"{name} ("), f"outcome_{i}", F.lit(")"))
        )
        for i, name in enumerate(required)
    ]
    failures = F.concat_ws(", ", *problems)
    passed = failures == ""
    return joined.select(
        *VERSION,
        F.when(passed, "approved").otherwise("rejected").alias("status"),
        F.when(passed, RESULTS_PASSED).otherwise(F.format_string(RESULTS_FAILED, failures)).alias("message"),
        passed.alias("all_required_ok"),
    )


def new_registry_rows(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows to append: versions the registry does not hold yet, the earliest evaluation of each."""
    rest = [c for c in candidates.columns if c not in (*VERSION, "evaluated_at")]
    first = F.min_by(F.struct(*rest), "evaluated_at").alias("row")
    once = candidates.groupBy(*VERSION).agg(F.min("evaluated_at").alias("evaluated_at"), first)
    unpacked = once.select(*VERSION, "evaluated_at", "row.*").select(*candidates.columns)
    return unpacked.join(registry.select(*VERSION), VERSION, "left_anti")


def activation(endpoints: DataFrame, registry: DataFrame) -> DataFrame:
    """Whether monitoring of each endpoint's model version may start, and if not, why."""
    rows = registry.select(*VERSION, "status", "baseline_prefix", "analysers", F.lit(True).alias("found"))
    joined = endpoints.join(rows, VERSION, "left")
    found = F.coalesce("found", F.lit(False))
    active = found & F.coalesce(F.col("status") == "approved", F.lit(False))
    return joined.select(
        *endpoints.columns,
        active.alias("activate"),
        F.when(active, F.col("baseline_prefix")).alias("baseline_prefix"),
        F.when(active, F.col("analysers")).alias("analysers"),
        F.when(~found, F.format_string(NOT_FOUND, "model_version", "project")).when(~active, REJECTED).alias("reason"),
    )


def active_endpoints(endpoints: DataFrame, registry: DataFrame) -> DataFrame:
    approved = registry.where(F.col("status") == "approved").select(*VERSION)
    return endpoints.join(approved, VERSION, "left_semi")


def latest_versions(objects: DataFrame, key: str = "key") -> DataFrame:
    """The newest ``<project>/v<N>/...`` object per project, N compared as a number."""
    parsed = objects.select(
        F.regexp_extract(key, r"^(.+)/v(\d+)/", 1).alias("project"),
        F.regexp_extract(key, r"^(.+)/v(\d+)/", 2).try_cast("bigint").alias("version"),
        F.col(key).alias("key"),
    ).where("version IS NOT NULL")
    newest = F.max(F.struct("version", "key")).alias("newest")
    return parsed.groupBy("project").agg(newest).select("project", "newest.version", "newest.key")


def check_manifests(documents: DataFrame, column: str = "document") -> DataFrame:
    """Parse manifest JSON: ``(document, manifest, problem)`` with a null problem for a valid one.

    Nothing may be unknown, empty or of another type than text; ``schema_version`` may be left out. Each
    document is parsed once into a variant and once into its field map; the tests look at those.
    """
    text = F.col(column)
    fields = ["schema_version", "project", "model_version", "produced_at"]
    members = "map<string,variant>"
    parsed = documents.withColumn("__tree", F.try_parse_json(text))
    opened = parsed.withColumn("__top", F.try_variant_get("__tree", "$", members))
    top = F.col("__top")
    opened = opened.select(
        *documents.columns,
        F.map_keys(top).alias("__keys"),
        F.struct(*[_text_of(F.try_element_at(top, F.lit(f))).alias(f) for f in fields]).alias("__text"),
        F.try_element_at(top, F.lit("schema_version")).isNotNull().alias("__versioned"),
        F.try_variant_get(F.try_element_at(top, F.lit("provenance")), "$", members).alias("__provenance"),
        F.try_variant_get(F.try_element_at(top, F.lit("artifacts")), "$", members).alias("__artifacts"),
    )
    provenance = F.col("__provenance")
    typed = opened.withColumn(
        "__manifest",
        F.struct(
            F.when(F.col("__versioned"), F.col("__text.schema_version")).otherwise(MANIFEST_VERSION).alias("schema_version"),
            F.col("__text.project").alias("project"),
            F.col("__text.model_version").alias("model_version"),
            F.col("__text.produced_at").try_cast("timestamp").alias("produced_at"),
            F.struct(
                *[_text_of(F.try_element_at(provenance, F.lit(f))).alias(f) for f in _PROVENANCE_FIELDS]
            ).alias("provenance"),
            F.transform_values("__artifacts", lambda _, v: _text_of(v)).alias("artifacts"),
        ),
    )

    def unknown(keys: Column, allowed: Sequence[str]) -> Column:
        return F.coalesce(F.size(F.array_except(keys, _texts(allowed))) > 0, F.lit(False))

    def empty(path: str) -> Column:
        return F.coalesce(F.length(F.col(f"__manifest.{path}")) == 0, F.lit(True))

    artifacts = F.col("__manifest.artifacts")
    tests = [
        ("not a JSON object", F.col("__keys").isNull()),
        ("unknown field", unknown(F.col("__keys"), _MANIFEST_FIELDS)),
        ("unsupported schema_version", ~F.col("__manifest.schema_version").eqNullSafe(MANIFEST_VERSION)),
        *[(f"{name} is missing or empty", empty(name)) for name in ("project", "model_version")],
        ("produced_at is no timestamp", F.col("__manifest.produced_at").isNull()),
        ("unknown provenance field", unknown(F.map_keys("__provenance"), _PROVENANCE_FIELDS)),
        *[(f"provenance.{name} is missing or empty", empty(f"provenance.{name}")) for name in _PROVENANCE_FIELDS],
        ("artifacts are missing or empty", ~F.coalesce(F.size(artifacts) > 0, F.lit(False))),
        ("artifacts hold a value that is no text", F.exists(F.map_values(artifacts), lambda v: v.isNull())),
    ]
    problem = reduce(
        lambda found, test: F.coalesce(found, F.when(test[1], F.lit(test[0]))), tests, F.lit(None).cast("string")
    )
    checked = typed.withColumn("problem", problem)
    manifest = F.when(F.col("problem").isNull(), F.col("__manifest"))
    return checked.select(*documents.columns, "problem", manifest.alias("manifest"))


def _text_of(value: Column) -> Column:
    """The text of a variant that holds text, null for any other kind."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def read_manifests(documents: DataFrame, column: str = "document") -> tuple[DataFrame, DataFrame]:
    """``(manifests, rejects)``: valid manifests as typed rows, the others with their problem."""
    checked = check_manifests(documents, column)
    valid = checked.where("problem IS NULL").select("manifest.*")
    return valid, checked.where("problem IS NOT NULL").select(column, "problem")
