"""Who may see and change which layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = {"READ": ("READ", "WRITE", "ADMIN"), "WRITE": ("WRITE", "ADMIN"), "ADMIN": ("ADMIN",)}


def token_layers(subject: Column, roles: Column) -> Column:
    """Default and public, the subject's own, one for each group, and two more for administrators."""
    base = F.array(F.lit("default"), F.lit("public"))
    own = F.when(subject.isNotNull() & (subject != ""), F.array(subject)).otherwise(F.array().cast("array<string>"))
    groups = F.transform(F.filter(roles, lambda r: F.startswith(r, F.lit("group:"))), lambda r: F.replace(r, F.lit("group:"), F.lit("layer_")))
    admin = F.array_contains(roles, "admin") | F.array_contains(roles, "vector_ops")
    more = F.when(admin, F.array(F.lit("restricted"), F.lit("admin"))).otherwise(F.array().cast("array<string>"))
    return F.array_union(F.array_union(base, own), F.array_union(groups, more))


def like_pattern(pattern: Column) -> Column:
    """Stars become the wildcard of LIKE; a stored wildcard means the same."""
    return F.replace(pattern, F.lit("*"), F.lit("%"))


def public_layers(layers: DataFrame, permissions: DataFrame) -> DataFrame:
    """Live system layers that everybody may read."""
    live = layers.filter((F.col("type") == "SYSTEM") & ~F.col("is_soft_deleted"))
    anyone = permissions.filter(like_pattern(F.col("role_pattern")) == "%").select("layer_id").distinct()
    return live.join(anyone, live["id"] == anyone["layer_id"], "left_semi").select("id", "name")


def resolve_layers(roles: DataFrame, layers: DataFrame, permissions: DataFrame, mapping: DataFrame | None = None, level: str | None = None) -> DataFrame:
    """(user_id, layer_id) for roles (user_id, role) by exact name or pattern, with the public layers.

    Grants are first brought down to live layers, the workspace's and the asked level, and to
    distinct patterns; roles to distinct ones. Exact grants join by equality; only
    patterns with a wildcard are tried by LIKE, and only on roles that begin as the pattern does before its
    first wildcard: each role gives its beginnings of the lengths that patterns have, and those join by equality.
    """
    live = layers.filter(~F.col("is_soft_deleted")).select(F.col("id").alias("layer_id"))
    if mapping is not None:
        live = live.join(mapping.select("layer_id"), "layer_id", "left_semi")
    grants = permissions if level is None else permissions.filter(F.col("access_level").isin(*LEVELS[level]))
    grants = grants.join(live, "layer_id", "left_semi").select("layer_id", "role_pattern").distinct()
    names = roles.select("role").distinct()
    wild = F.contains("role_pattern", F.lit("*")) | F.contains("role_pattern", F.lit("%")) | F.contains("role_pattern", F.lit("_"))
    exact = grants.join(names, F.col("role_pattern") == F.col("role")).select("role", "layer_id")
    loose = grants.filter(wild).withColumn("p", like_pattern(F.col("role_pattern")))
    loose = loose.withColumn("begin", F.regexp_extract("p", r"^[^%_\\]*", 0))
    # One row: no more lengths than the longest pattern has characters.
    lengths = loose.agg(F.collect_set(F.length("begin")).alias("lengths"))
    begins = names.join(F.broadcast(lengths), F.lit(True)).select("role", F.explode(F.filter("lengths", lambda n: n <= F.length("role"))).alias("n"))
    begins = begins.select("role", F.substring("role", F.lit(1), F.col("n")).alias("begin"))
    by_pattern = begins.join(loose, "begin").filter(F.expr("role LIKE p")).select("role", "layer_id")
    own = roles.join(exact.unionByName(by_pattern).distinct(), "role").select("user_id", "layer_id")
    public = public_layers(layers, permissions).agg(F.collect_set("id").alias("ids"))
    # The set of public layers is one row.
    everyone = roles.select("user_id").distinct().join(public, F.lit(True)).select("user_id", F.explode("ids").alias("layer_id"))
    return own.unionByName(everyone).distinct()


def layer_permissions(layers: DataFrame, permissions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every grant of the layers that a workspace is mapped to: (workspace_id, name, role_pattern, access_level)."""
    named = layers.select(F.col("id").alias("layer_id"), "name")
    return permissions.join(named, "layer_id").join(mapping, "layer_id").select("workspace_id", "name", "role_pattern", "access_level")


def may_write(users: DataFrame, permissions: DataFrame, layer_id: str) -> DataFrame:
    """``allowed``: a grant to write or more for anyone or for the user."""
    grants = permissions.filter((F.col("layer_id") == layer_id) & F.col("access_level").isin(*LEVELS["WRITE"])).select("role_pattern").distinct()
    anyone = grants.filter(F.col("role_pattern").isin("*", "%")).limit(1).count() > 0
    named = users.join(grants, F.concat(F.lit("user:"), "user_id") == F.col("role_pattern"), "left")
    return named.select("user_id", (F.col("role_pattern").isNotNull() | F.lit(anyone)).alias("allowed"))


def quota(layers: DataFrame, delta: Column | None = None) -> DataFrame:
    """``used_after`` (never below 0) and ``exceeded``."""
    after = F.greatest(F.lit(0).cast("long"), F.col("storage_used_bytes") + (F.lit(0) if delta is None else delta))
    return layers.withColumn("used_after", after).withColumn("exceeded", F.col("used_after") >= F.col("storage_quota_bytes"))
