"""Decisions about groups: checks of a file and of each decision, before anything is written."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIONS = ("CONFIRM", "CHANGE_PREFERRED", "REJECT", "DEFER")
EVENTS = {"CONFIRM": "DUPLICATE_GROUP_CONFIRMED", "CHANGE_PREFERRED": "DUPLICATE_GROUP_PREFERRED_CHANGED", "REJECT": "DUPLICATE_GROUP_REJECTED", "DEFER": "DUPLICATE_GROUP_DEFERRED"}
TOP = {"schema_version", "report_id", "catalog_revision", "generated_at", "decisions"}
ENTRY = {"group_id", "decision", "preferred_file_id", "reviewed_at"}


class DecisionError(ValueError):
    pass


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise DecisionError(what)


def _text(value: object, start: str = "") -> bool:
    return isinstance(value, str) and re.match(start, value, re.DOTALL) is not None


def check_file(data: object, revision: str | None = None) -> list[dict]:
    """The decisions of a parsed file whose form is right; ``revision``: that of the catalogue now.

    A group that is decided twice in one file is refused.
    """
    _need(isinstance(data, dict) and set(data) == TOP, "top-level fields")
    _need(data["schema_version"] == 1 and not isinstance(data["schema_version"], bool), "schema_version")
    _need(_text(data["report_id"], "rpt_"), "report_id")
    _need(_text(data["catalog_revision"], ".") and _text(data["generated_at"], "."), "catalog_revision or generated_at")
    _need(isinstance(data["decisions"], list), "decisions")
    for d in data["decisions"]:
        _need(isinstance(d, dict) and set(d) <= ENTRY and {"group_id", "decision", "reviewed_at"} <= set(d), "fields of a decision")
        _need(_text(d["group_id"], "dup_") and d["decision"] in ACTIONS and _text(d["reviewed_at"], "."), "values of a decision")
        best = d.get("preferred_file_id")
        _need(_text(best, "fil_") if best is not None else d["decision"] != "CHANGE_PREFERRED", "preferred_file_id")
    groups = [d["group_id"] for d in data["decisions"]]
    _need(len(groups) == len(set(groups)), "a group is decided twice")
    _need(revision is None or data["catalog_revision"] == revision, "the catalogue has changed since the report")
    return data["decisions"]


def first_failures(decisions: DataFrame, groups: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """``decisions`` with failure: the first reason against each, or null.

    decisions: group_id, decision, preferred_file_id. groups: group_id, status,
    proposed_preferred_file_id. members: group_id, file_id. files: file_id, linked
    (has an active track). An import goes ahead only if no row has a failure.
    """
    best = F.col("preferred_file_id")
    j = decisions.join(groups.select("group_id", F.col("status").alias("__status"), F.col("proposed_preferred_file_id").alias("__proposed")), "group_id", "left")
    j = j.join(files.select(F.col("file_id").alias("preferred_file_id"), F.col("linked").alias("__linked")), "preferred_file_id", "left")
    j = j.join(members.select("group_id", F.col("file_id").alias("preferred_file_id"), F.lit(True).alias("__member")).distinct(), ["group_id", "preferred_file_id"], "left")
    change = F.col("decision") == "CHANGE_PREFERRED"
    failure = (
        F.when(F.col("__status").isNull(), "UNKNOWN_GROUP")
        .when(best.isNotNull() & F.col("__linked").isNull(), "UNKNOWN_FILE")
        .when(F.col("__status") != "REVIEW_REQUIRED", "ALREADY_RESOLVED")
        .when(change & F.col("__member").isNull(), "NOT_A_MEMBER")
        .when(change & ~F.col("__linked"), "NO_ACTIVE_TRACK")
        .when((F.col("decision") == "CONFIRM") & F.col("__proposed").isNull(), "NOTHING_PROPOSED")
    )
    return j.withColumn("failure", failure).select(*decisions.columns, "failure")


def spanning_groups(members: DataFrame, moved: DataFrame, kept: DataFrame) -> DataFrame:
    """group_id of groups with records on both sides of a split; moved and kept have file_id."""
    sides = moved.select("file_id", F.lit(True).alias("moved")).unionByName(kept.select("file_id", F.lit(False).alias("moved")))
    return members.join(sides, "file_id").groupBy("group_id").agg(F.bool_or("moved").alias("a"), F.bool_and("moved").alias("b")).where("a and not b").select("group_id")
