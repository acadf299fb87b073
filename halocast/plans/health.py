"""Health of the whole store as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from halocast import rules
from halocast.functions.geo import round6, valid_coordinates
from halocast.operators import catalog as cat, stats


def store_facts(catalog: DataFrame, errors: DataFrame, inventory: DataFrame, vectors: DataFrame, as_of: str) -> DataFrame:
    """All that the checks ask, as one row; each table is scanned once.

    The rows of the four tables become counts under keys: catalogue rows and vectors under their profile, paths of the catalogue
    and of the listing under the path, errors under their type. One aggregation brings together what belongs together, a
    second one counts over it. Recurring error types come as an array, there are few types.
    """
    zero = F.lit(0)
    quality = F.col("data_quality_score").cast("decimal(24,12)")
    none = F.lit(None).cast("decimal(24,12)")

    def entry(kind: str, key: Column, left=zero, right=zero, pathless=zero, invalid=zero, empty=zero, score=none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), left.cast("bigint").alias("left"),
                        right.cast("bigint").alias("right"), pathless.cast("bigint").alias("pathless"),
                        invalid.cast("bigint").alias("invalid"), empty.cast("bigint").alias("empty"), score.alias("score"))

    one, has_path = F.lit(1), F.coalesce(F.col("parquet_path") != "", F.lit(False))
    by_profile = entry("profile", F.col("profile_id"), one, zero, F.when(has_path, 0).otherwise(1),
                       F.when(valid_coordinates(), 0).otherwise(1), zero, quality)
    by_path = F.when(has_path, entry("path", F.col("parquet_path"), one))
    since = lambda days: F.to_timestamp_ntz(F.lit(as_of)) - F.make_dt_interval(F.lit(days))
    recent = F.when(F.col("occurred_at") > since(1), 1).otherwise(0)
    rows = reduce(DataFrame.unionByName, [
        catalog.select(F.explode(F.array_compact(F.array(by_profile, by_path))).alias("e")),
        vectors.select(entry("profile", F.col("profile_id"), zero, one).alias("e")),
        inventory.select(entry("path", F.col("path"), zero, one, empty=F.when(F.col("length") == 0, 1).otherwise(0)).alias("e")),
        errors.where(F.col("occurred_at") > since(7)).select(entry("error", F.col("error_type"), one, recent).alias("e")),
    ]).select("e.*")
    counts = ["left", "right", "pathless", "invalid", "empty"]
    keyed = rows.groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in counts], F.sum("score").alias("score"), F.count("score").alias("scored"))

    def of(kind: str, column: str, where=None) -> Column:
        test = F.col("kind") == kind
        return F.coalesce(F.sum(F.when(test if where is None else test & where, F.col(column))), zero)

    often = (F.col("kind") == "error") & (F.col("left") > rules.ERRORS_PER_TYPE)
    return keyed.agg(
        of("profile", "left").alias("total"), of("profile", "pathless").alias("pathless"), of("profile", "invalid").alias("invalid"),
        F.round(F.sum("score") / F.sum("scored"), 6).cast("double").alias("avg_quality"),
        F.count(F.when((F.col("kind") == "profile") & (F.col("left") > 1), 1)).alias("duplicates"),
        of("profile", "right").alias("vectors"),
        of("path", "left", F.col("right") == 0).alias("missing"), of("path", "right").alias("files"), of("path", "empty").alias("empty"),
        of("error", "right").alias("recent"),
        F.array_sort(F.collect_list(F.when(often, F.struct(F.col("key").alias("error_type"), F.col("left").alias("n"))))).alias("recurring"),
    ).withColumn("orphans", F.when(F.col("total") > 0, 1 - (F.col("total") - F.col("pathless")) / F.col("total")).otherwise(0.0))


def health_issues(catalog: DataFrame, errors: DataFrame, inventory: DataFrame,
                  vectors: DataFrame, as_of: str) -> DataFrame:
    """Every check that fails, with its severity, value and advice; thresholds are fixed values.

    All checks look at one row of facts, for which each table is read once.
    """
    facts = store_facts(catalog, errors, inventory, vectors, as_of)

    def check(kind: str, severity: str, value, test: Column, subject=F.lit("")) -> Column:
        value = F.col(value) if isinstance(value, str) else value
        return F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), subject.alias("subject"),
                        round6(value.cast("double")).alias("value"), F.coalesce(test, F.lit(False)).alias("failed"))

    c = F.col
    gap = c("vectors") - c("total")
    checks = F.array(
        check("no_data", "warning", "total", c("total") == 0),
        check("high_error_rate", "warning", "recent", c("recent") > rules.ERRORS_24H_WARN),
        check("orphaned_records", "moderate", "orphans", c("orphans") > rules.ORPHAN_LIMIT),
        check("no_parquet_files", "warning", "files", c("files") == 0),
        check("corrupt_parquet_files", "moderate", "empty", c("empty") > 0),
        check("embedding_db_mismatch", "moderate", gap, F.abs(gap) > c("total") * rules.MISMATCH_LIMIT),
        check("missing_parquet_files", "moderate", "missing", c("missing") > 0),
        check("duplicate_profiles", "moderate", "duplicates", c("duplicates") > 0),
        check("invalid_coordinates", "moderate", "invalid", c("invalid") > 0),
        check("high_error_rate_24h", "warning", "recent", c("recent") > rules.ERRORS_24H_HIGH),
        check("low_average_quality", "warning", "avg_quality", c("avg_quality") < rules.LOW_QUALITY))
    recurring = F.transform("recurring", lambda r: check("recurring_error_pattern", "moderate", r["n"], F.lit(True), r["error_type"]))
    issues = facts.select(F.inline(F.concat(checks, recurring))).where("failed").drop("failed")
    advice = rules.table(catalog.sparkSession, list(rules.RECOMMENDATIONS.items()),
                         "type, recommendation")
    return issues.join(F.broadcast(advice), "type", "left").withColumn(
        "recommendation", F.coalesce("recommendation", F.lit("")))


# fixed values: the repairs, in the order in which they are applied, and the issue each answers (none: always)
REPAIRS = [
    ("mark_orphans", "orphaned_records"), ("mark_missing_levels", "missing_parquet_files"), ("latest_per_profile", "duplicate_profiles"),
    ("drop_invalid_coordinates", "invalid_coordinates"), ("default_quality", None)]


def repair_plan(issues: DataFrame) -> DataFrame:
    """(step, repair, wanted): which repairs the issues call for, as data."""
    steps = rules.table(issues.sparkSession, [(i, name, kind or "") for i, (name, kind) in enumerate(REPAIRS)], "step, repair, type")
    found = issues.select("type").distinct().withColumn("_found", F.lit(True))
    return steps.join(found, "type", "left").select(
        "step", "repair", ((F.col("type") == "") | F.coalesce("_found", F.lit(False))).alias("wanted"))


def repair_catalog(catalog: DataFrame, missing: DataFrame, plan: DataFrame, key: str = "profile_id", order: str = "seq") -> DataFrame:
    """The next version of the catalogue: the wanted repairs of the plan, applied in its order.

    ``missing`` holds the rows whose level files are gone. The plan is read as one row, inside the same job; rows without a
    wanted repair stay as they are. Nothing is deleted from the store: the result is published as a new version.
    """
    wants = {name: plan.agg(F.max(F.when(F.col("repair") == name, F.col("wanted")))).scalar() for name, _ in REPAIRS}

    orphan = cat.is_orphan() & wants["mark_orphans"]
    kept = F.map_filter(F.col("raw_metadata"), lambda k, v: k != "status") if "raw_metadata" in catalog.columns else None
    plain = F.create_map().cast("map<string,string>")
    noted = F.map_concat(F.coalesce(kept, plain) if kept is not None else plain, F.create_map(F.lit("status"), F.lit("orphaned")))
    marked = catalog.withColumns({
        "data_quality_score": F.when(orphan, F.least("data_quality_score", F.lit(0.2))).otherwise(F.col("data_quality_score")),
        "raw_metadata": F.when(orphan, noted).otherwise(F.col("raw_metadata") if kept is not None else F.lit(None))})
    flags = missing.select(key).distinct().withColumn("_gone", F.lit(True))
    gone = F.coalesce("_gone", F.lit(False)) & wants["mark_missing_levels"]
    marked = marked.join(flags, key, "left").withColumns({
        "data_quality_score": F.when(gone, F.col("data_quality_score") * 0.5).otherwise(F.col("data_quality_score")),
        "parquet_path": F.when(~gone, F.col("parquet_path"))}).drop("_gone")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    fine = (F.col("_rank") == 1) | ~wants["latest_per_profile"]
    placed = valid_coordinates() | ~wants["drop_invalid_coordinates"]
    score = F.when(wants["default_quality"], F.coalesce("data_quality_score", F.lit(rules.NO_DATA_SCORE))).otherwise(F.col("data_quality_score"))
    return marked.withColumn("_rank", rank).where(fine & placed).drop("_rank").withColumn("data_quality_score", score)


def recommendations(issues: DataFrame) -> DataFrame:
    """Advice for a set of issues: by severity, by type, or that all is well."""
    counts = issues.agg(
        F.count(F.when(F.col("severity") == "critical", 1)).alias("critical"),
        F.count(F.when(F.col("severity") == "moderate", 1)).alias("moderate"),
        F.count(F.when(F.col("recommendation") != "", 1)).alias("typed"))
    critical = F.col("critical") > 0
    many = F.col("moderate") > rules.MODERATE_ISSUES_LIMIT
    advice = rules.SEVERITY_ADVICE
    general = F.filter(F.array(
        F.when(critical, advice["critical"]), F.when(many, advice["moderate"]),
        F.when(~critical & ~many & (F.col("typed") == 0), advice["none"])), lambda x: x.isNotNull())
    return counts.select(F.explode(general).alias("recommendation")).unionByName(
        issues.filter("recommendation <> ''").select("recommendation").distinct())


def health_report(catalog: DataFrame, errors: DataFrame, inventory: DataFrame,
                  vectors: DataFrame, as_of: str) -> DataFrame:
    """Issues, metrics, tiers and error counts as (section, name, value) rows."""
    issues = health_issues(catalog, errors, inventory, vectors, as_of).select(
        F.lit("issue").alias("section"),
        F.concat_ws(":", "type", F.when(F.col("subject") != "", F.col("subject"))).alias("name"),
        "value")
    metrics = stats.catalog_metrics(catalog, as_of)
    names = metrics.columns
    metric_rows = metrics.select(F.inline(F.array(*[
        F.struct(F.lit("metric").alias("section"), F.lit(c).alias("name"),
                 F.col(c).cast("double").alias("value")) for c in names])))
    tiers = stats.quality_tiers(catalog).select(
        F.lit("quality").alias("section"), F.col("quality_tier").alias("name"),
        F.col("count").cast("double").alias("value"))
    error_rows = stats.error_stats(errors, as_of).select(
        F.lit("error").alias("section"), F.col("error_type").alias("name"),
        F.col("count").cast("double").alias("value"))
    return reduce(DataFrame.unionByName, [issues, metric_rows, tiers, error_rows])
