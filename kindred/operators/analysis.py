"""Detection and analysis of groups as calls over the whole catalogue."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import evidence as E
from kindred.functions import quality as Q
from kindred.operators import candidates, commands, groups
from kindred.operators.resolve import public_id

MATCHER_VERSION = "1"


def set_key(members: DataFrame) -> DataFrame:
    """group_id, key: equal for groups of the same files."""
    ids = F.transform(F.array_sort(F.collect_set("file_id")), lambda x: x.cast("string"))
    return members.groupBy("group_id").agg(F.sha2(F.array_join(ids, "\x1f"), 256).alias("key"))


def detect(records: DataFrame, known: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups of present records that are candidates of each other: all groups, all members, and the ids detected now.

    records: is_present and what blocking reads. known: group_id, status,
    matcher_version and what else a group has. A component whose files are just
    those of a known group is that group; others become new ones.
    """
    found = groups.connected_components(candidates.linking_pairs(records.where("is_present")))
    keys = set_key(found)
    old = set_key(members).groupBy("key").agg(F.min("group_id").alias("old"))
    named = keys.withColumnRenamed("group_id", "component").join(old, "key", "left").select("component", "old", F.coalesce("old", public_id("dup", F.col("key"))).alias("group_id"))
    fresh = named.where("old is null")
    rows = fresh.select("group_id", F.lit("DETECTED").alias("status"), F.lit(MATCHER_VERSION).alias("matcher_version"))
    of = found.withColumnRenamed("group_id", "component").join(fresh.select("component", "group_id"), "component").select("group_id", "file_id")
    return known.unionByName(rows, allowMissingColumns=True), members.unionByName(of), named.select("group_id")


def classify_pairs(pairs: DataFrame, auto: float = 0.985, review: float = 0.93) -> DataFrame:
    """``pairs`` (same_bytes, version_state, sound) with classification and confidence."""
    return pairs.withColumn("c", E.classify(F.col("same_bytes"), F.col("version_state"), F.col("sound"), auto, review)).select("*", "c.classification", "c.confidence").drop("c")


def analyze(known: DataFrame, members: DataFrame, evidence_of: Callable[[DataFrame], DataFrame], quality: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups with status, confidence and proposed_preferred_file_id anew, and the classified pairs.

    Only groups that no person has decided, and that have two files or more, are
    touched. ``evidence_of`` adds same_bytes, version_state and sound to pairs of
    group_id, left_id and right_id. quality: file_id, intact, suspicion, score, lossless,
    clipped, complete; a file without a row is never proposed.
    """
    open_ = known.where(F.col("status").isin(*commands.ANALYZABLE)).select("group_id")
    mine = members.join(open_, "group_id", "left_semi")
    pairs = classify_pairs(evidence_of(groups.member_pairs(mine.select("group_id", "file_id"))))
    status = groups.group_status(pairs).withColumnRenamed("status", "_status").withColumnRenamed("confidence", "_confidence")
    order = Q.preference(*(F.col(c) for c in ("intact", "suspicion", "score", "lossless", "clipped", "complete")))
    best = groups.preferred(mine.join(quality, "file_id"), order).withColumnRenamed("preferred_file_id", "_best")
    out = known.join(status, "group_id", "left").join(best, "group_id", "left")
    old = lambda c: F.col(c) if c in known.columns else F.lit(None)
    hit = F.col("_status").isNotNull()
    out = out.withColumns({"status": F.coalesce("_status", "status"), "confidence": F.coalesce(F.col("_confidence"), old("confidence")), "proposed_preferred_file_id": F.when(hit, F.col("_best")).otherwise(old("proposed_preferred_file_id"))})
    return out.drop("_status", "_confidence", "_best"), pairs


@dataclass
class Run:
    groups: DataFrame
    members: DataFrame
    pairs: DataFrame
    change: commands.Change
    detected: int
    analyzed: int
    consolidated: int


def run(records: DataFrame, known: DataFrame, members: DataFrame, tracks: DataFrame, links: DataFrame, evidence_of: Callable[[DataFrame], DataFrame], quality: DataFrame) -> Run:
    """Detection, analysis, and the consolidation of groups that need no review."""
    groups.checkpoint_folder(records.sparkSession)
    found, of, now = detect(records, known, members)
    found, of = found.checkpoint(), of.checkpoint()
    analyzed = found.where(F.col("status").isin(*commands.ANALYZABLE)).count()
    judged, pairs = analyze(found, of, evidence_of, quality)
    judged, pairs = judged.checkpoint(), pairs.checkpoint()
    sure = judged.where("status = 'AUTO_CONFIRMED'").select("group_id", F.col("proposed_preferred_file_id").alias("preferred_file_id"))
    evidence = pairs.select("group_id", F.col("left_id").alias("left_file_id"), F.col("right_id").alias("right_file_id"), "classification")
    change, n = commands.consolidate(sure, of, evidence, tracks, links, records)
    return Run(judged, of, pairs, change, now.count(), analyzed, n)
