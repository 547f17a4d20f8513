"""Integrity rules over chunks. Every rule gives findings: severity, place, message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import MAX_CHUNK_CHARS, TRUNCATION_MARK, strip_end

#: The forms of stable ids.
CONTROLLER_ID = r"^ctrl::[^:\s\[\]'\"/\\]+::[^:\s\[\]'\"/\\]+$"
ENDPOINT_ID = r"^ep::[^:\s\[\]'\"/\\]+::[^:\s\[\]'\"/\\{}]+$"
DB_ID = r"^db::[^:\s\[\]'\"/\\]+::[^:\s\[\]'\"/\\]+$"
NEAR_CAP = 0.8


def _missing(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def _ids(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def _rules(rows: DataFrame, place: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """One pass over the rows for all rules: each row gives an array of its findings."""
    made = F.array(*[F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message"))) for severity, message, when in rules])
    return rows.select(F.col(place).alias("place"), F.explode(F.filter(made, lambda f: f.isNotNull())).alias("f")).select("f.severity", "place", "f.message")


def sizes(chunks: DataFrame) -> DataFrame:
    cut = strip_end(F.col("content")).endswith(TRUNCATION_MARK.strip())
    return _rules(chunks, "node_id", [("error", "truncated", cut), ("warn", "near the cap", ~cut & (F.char_length("content") >= NEAR_CAP * MAX_CHUNK_CHARS))])


def endpoints(chunks: DataFrame) -> DataFrame:
    rules = [
        ("error", "endpoint_id missing", _missing("endpoint_id")),
        ("error", "endpoint_id malformed", ~_missing("endpoint_id") & ~F.col("endpoint_id").rlike(ENDPOINT_ID)),
        ("error", "controller_id missing", _missing("controller_id")),
        ("error", "controller_id malformed", ~_missing("controller_id") & ~F.col("controller_id").rlike(CONTROLLER_ID)),
        ("error", "repo missing", _missing("repo")),
        ("warn", "feature empty", F.size(_ids("feature")) == 0),
        ("error", "route missing", _missing("route")),
        ("warn", "db_ids empty", F.size(_ids("db_ids")) == 0),
    ]
    plain = _rules(chunks, "node_id", rules)
    bad = chunks.select(F.col("node_id").alias("place"), F.explode(F.filter(_ids("db_ids"), lambda d: ~d.rlike(DB_ID))).alias("d"))
    return plain.unionByName(bad.select(F.lit("error").alias("severity"), "place", F.concat(F.lit("db_ids malformed: "), "d").alias("message")))


def databases(chunks: DataFrame) -> DataFrame:
    fields = [("error", f"{c} missing", _missing(c)) for c in ("store", "type", "db_collection", "db_id")]
    return _rules(chunks, "node_id", [*fields, ("error", "db_id malformed", ~_missing("db_id") & ~F.col("db_id").rlike(DB_ID))])


def controllers(chunks: DataFrame) -> DataFrame:
    rules = [
        ("error", "controller_id missing", _missing("controller_id")),
        ("error", "controller_id malformed", ~_missing("controller_id") & ~F.col("controller_id").rlike(CONTROLLER_ID)),
        ("warn", "used_by empty", F.size(_ids("used_by")) == 0),
    ]
    return _rules(chunks, "node_id", rules)


def hubs(chunks: DataFrame) -> DataFrame:
    return _rules(chunks, "node_id", [("error", "feature empty", F.size(_ids("feature")) == 0)])


def _of(chunks: DataFrame, doc_type: str) -> DataFrame:
    return chunks.where(F.col("doc_type") == doc_type)


def references(chunks: DataFrame) -> DataFrame:
    """Rules across chunks: dangling and one-sided links, unreferenced databases, features without hubs. Malformed ids neither
    refer to anything nor are referred to."""
    ep, ctrl, db = _of(chunks, "endpoint"), _of(chunks, "controller-context"), _of(chunks, "db-collection")
    to_ctrl = ep.where(F.col("controller_id").rlike(CONTROLLER_ID) & ~_missing("endpoint_id")).select(F.col("node_id").alias("place"), "controller_id", "endpoint_id")
    to_db = ep.select(F.col("node_id").alias("place"), F.explode(_ids("db_ids")).alias("db_id")).where(F.col("db_id").rlike(DB_ID))
    back = ctrl.select(F.col("node_id").alias("place"), "controller_id", F.explode(_ids("used_by")).alias("endpoint_id"))
    known = ctrl.select("controller_id").distinct()
    used = chunks.where(F.col("doc_type").isin("endpoint", "technical-hub")).select(F.explode(_ids("feature")).alias("feature")).distinct()

    def finding(rows: DataFrame, severity: str, place: str, text: str, value: str) -> DataFrame:
        return rows.select(F.lit(severity).alias("severity"), F.col(place).alias("place"), F.concat(F.lit(text), F.col(value)).alias("message"))

    def without_hub(kind: str) -> DataFrame:
        return used.join(_of(chunks, kind).select(F.explode(_ids("feature")).alias("feature")).distinct(), "feature", "left_anti")

    parts = [
        finding(to_ctrl.join(known, "controller_id", "left_anti"), "error", "place", "no controller ", "controller_id"),
        finding(to_db.join(db.select("db_id").distinct(), "db_id", "left_anti"), "error", "place", "no database ", "db_id"),
        finding(back.join(ep.where(F.col("endpoint_id").rlike(ENDPOINT_ID)).select("endpoint_id").distinct(), "endpoint_id", "left_anti"), "warn", "place", "no endpoint ", "endpoint_id"),
        finding(to_ctrl.join(known, "controller_id", "left_semi").join(back.select("controller_id", "endpoint_id").distinct(), ["controller_id", "endpoint_id"], "left_anti"), "error", "place", "not listed by ", "controller_id"),
        finding(back.join(to_ctrl.select("controller_id", "endpoint_id").distinct(), ["controller_id", "endpoint_id"], "left_anti"), "warn", "place", "lists, but is not used by ", "endpoint_id"),
        finding(db.where(~_missing("db_id")).join(to_db.select("db_id").distinct(), "db_id", "left_anti"), "warn", "node_id", "unreferenced ", "db_id"),
        finding(without_hub("feature-hub"), "warn", "feature", "no feature hub for ", "feature"),
        finding(without_hub("technical-hub"), "error", "feature", "no technical hub for ", "feature"),
    ]
    return reduce(DataFrame.unionByName, parts)


def check(chunks: DataFrame) -> DataFrame:
    """All rules."""
    hub = chunks.where(F.col("doc_type").isin("feature-hub", "technical-hub"))
    parts = [sizes(chunks), endpoints(_of(chunks, "endpoint")), databases(_of(chunks, "db-collection")), controllers(_of(chunks, "controller-context")), hubs(hub), references(chunks)]
    return reduce(DataFrame.unionByName, parts)


def passes(chunks: DataFrame, strict: bool = True) -> bool:
    """The gate behind an ingest: false if strict and any finding is an error."""
    return not strict or check(chunks).where("severity = 'error'").limit(1).count() == 0
