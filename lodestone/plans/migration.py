"""From archives to findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import archives, checks, rules, symbols
from ..staging import stage


def scan(found: DataFrame, limits: archives.Limits = archives.Limits()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, facts, summary) of archives (archive_id, content).

    Each archive is accepted or rejected whole; summary has one row for each, with totals or with its first error.
    """
    files, summary = archives.validate(found, limits)
    facts = stage(symbols.facts(files), "facts")
    bad = stage(symbols.scan_errors(facts), "unscanned")
    kept = stage(facts.join(bad, "archive_id", "left_anti"), "facts")
    summary = summary.alias("s").join(bad.select("archive_id", F.col("error_type").alias("scan_error")), "archive_id", "left")
    summary = summary.withColumn("error", F.coalesce("error_type", "scan_error")).drop("error_type", "scan_error")
    return rules.findings(kept), kept, summary


def rule_counts(findings: DataFrame) -> DataFrame:
    """(rule_id, severity, n, files)."""
    return findings.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.countDistinct("archive_id", "relative_path").alias("files"))


def label_problems(fixtures: DataFrame, labels: DataFrame, lines: DataFrame, headings: DataFrame) -> DataFrame:
    """(problem, fixture_id, file): labels of unknown files or beyond a file's end, repeated labels, files of odd length, unknown headings.

    lines is (fixture_id, file, line_count).
    """
    files = fixtures.select("fixture_id", F.explode("python_files").alias("file"))
    key = ["fixture_id", "file"]
    named = lambda df, problem: df.select(F.lit(problem).alias("problem"), *key)
    out = named(checks.missing_from(labels, files, key), "unknown_file")
    out = out.unionByName(named(checks.missing_from(files, lines, key), "missing_file"))
    out = out.unionByName(named(lines.where("line_count not between 30 and 200"), "line_count"))
    out = out.unionByName(named(labels.join(lines, key).where("start_line > line_count"), "line_outside_file"))
    out = out.unionByName(named(checks.duplicates(labels, [*key, "start_line", "rule_id"]), "repeated_label"))
    unknown = checks.missing_from(labels.select(F.col("gold_heading").alias("heading_path")), headings, ["heading_path"])
    lost = labels.join(unknown, F.col("gold_heading") == F.col("heading_path"), "left_semi")
    return out.unionByName(named(lost, "unknown_heading")).distinct()


def label_summary(labels: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: labels by kind, files and their lengths, headings."""
    a = labels.agg(F.count_if("expected").alias("positive_label_count"), F.count_if(~F.col("expected")).alias("negative_label_count"), F.countDistinct("gold_heading").alias("gold_heading_count"))
    b = lines.agg(F.countDistinct("fixture_id").alias("fixture_count"), F.count("*").alias("python_file_count"), F.min("line_count").alias("min_python_loc"), F.max("line_count").alias("max_python_loc"))
    return a.crossJoin(b)  # one row each
