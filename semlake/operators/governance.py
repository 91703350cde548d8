"""Governance as table operators: roles, permissions, lifecycle states, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Role names from least to most.
ROLES = ("viewer", "editor", "steward", "admin")


def rank(role: Column) -> Column:
    out = F.lit(0)
    for k, r in enumerate(ROLES):
        out = F.when(role == r, k).otherwise(out)
    return out


def resolve_users(requests: DataFrame, users: DataFrame, governs: DataFrame) -> DataFrame:
    """requests: (request, user_id): role and governed graphs; an unknown user is a viewer."""
    g = governs.groupBy("user_id").agg(F.array_sort(F.collect_set("graph")).alias("governs"))
    out = requests.join(users, "user_id", "left").join(g, "user_id", "left")
    return out.withColumn("role", F.coalesce("role", F.lit("viewer"))).withColumn("governs", F.coalesce("governs", F.array().cast("array<string>")))


def can_write(role: Column, governs: Column, targets: Column) -> Column:
    """Admins always; stewards if there are targets and every one is theirs."""
    return F.when(role == "admin", True).when(role == "steward", (F.size(targets) > 0) & F.forall(targets, lambda t: F.array_contains(governs, t))).otherwise(False)


def can_propose(role: Column) -> Column:
    return role.isin("editor", "steward", "admin")


def can_review(role: Column, governs: Column, target: Column) -> Column:
    return (role == "admin") | ((role == "steward") & F.array_contains(governs, target))


def current_state(states: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """(asset, state): the latest state of each asset."""
    return states.groupBy("asset").agg(F.max_by("state", F.struct("at", "state")).alias("state"))


def available_transitions(assets: DataFrame, workflow: DataFrame) -> DataFrame:
    """assets: (asset, state, role); workflow: (source, target, least_role): (asset, target) that the role may take."""
    return assets.join(F.broadcast(workflow), F.col("state") == F.col("source")).where(rank(F.col("role")) >= rank(F.col("least_role"))).select("asset", "target")


def validate_transitions(requests: DataFrame, workflow: DataFrame) -> DataFrame:
    """requests: (request, state, target, role): code 200, 400 (no such step) or 403 (role too low)."""
    w = F.broadcast(workflow.withColumnRenamed("target", "to"))
    out = requests.join(w, (F.col("state") == F.col("source")) & (F.col("target") == F.col("to")), "left")
    return out.select("request", F.when(F.col("source").isNull(), 400).when(rank(F.col("role")) < rank(F.col("least_role")), 403).otherwise(200).alias("code"))


def record_changes(events: DataFrame, most: int | None = None) -> DataFrame:
    """Events as change records; a page may cut the detail to `most` characters."""
    return events if most is None else events.withColumn("detail", F.substring("detail", 1, most))


def changelog_recent(changes: DataFrame, limit: int) -> DataFrame:
    """changes: (change, at, actor, graph): newest first, graphs joined by |."""
    return changes.groupBy("change", "at", "actor").agg(F.array_join(F.array_sort(F.collect_set("graph")), "|").alias("graphs")).orderBy(F.desc("at"), F.desc("change")).limit(limit)


def entity_history(changes: DataFrame, text: str, limit: int = 50) -> DataFrame:
    return changes.where(F.col("detail").contains(text)).orderBy(F.desc("at"), F.desc("change")).limit(limit)
