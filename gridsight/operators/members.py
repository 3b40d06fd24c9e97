"""Members, roles and permissions. Tokens, keys and secrets never pass through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import elapsed_ms, format_interval_ms_days, time_elapsed

# The policies a role may hold.
POLICIES = [
    "org.manage", "org.modify", "org.delete", "org.manageUsers", "org.billing", "workspace.manage",
    "workspace.modify", "workspace.read", "workspace.manageIntegrations", "workspace.manageClusters",
    "workspace.deployJob",
]


def member_profiles(profiles: DataFrame, orgs: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Each member with the current organisation and workspace."""
    org = orgs.select(F.col("id").alias("org_id"), F.col("name").alias("org_name"), F.col("slug_id").alias("org_slug"))
    space = workspaces.select(F.col("id").alias("workspace_id"), F.col("name").alias("workspace_name"))
    return profiles.join(org, "org_id").join(space, "workspace_id").select(
        "member_id", "org_id", "org_name", "org_slug", "workspace_id", "workspace_name", "web_theme", "desktop_theme"
    )


def member_policies(roles: DataFrame, member_roles: DataFrame) -> DataFrame:
    """The known policies of each role a member holds, spelled as in the fixed list."""
    known = F.create_map(*[F.lit(part) for name in POLICIES for part in (name.lower(), name)])
    return (
        member_roles.join(roles, "role_id")
        .select("member_id", "subject_type", "subject_id", F.explode(F.split("access_policies", ":")).alias("raw"))
        .withColumn("policy", F.try_element_at(known, F.lower("raw")))
        .filter(F.col("policy").isNotNull())
        .drop("raw")
    )


def permission_matrix(profiles: DataFrame, policies: DataFrame) -> DataFrame:
    """Whether each member may view or manage the workspace, or manage the organisation.

    A role counts only for the workspace or organisation the member is in.
    Policies are reduced to one row per member and subject before the join.
    """

    def holds(*names: str) -> Column:
        return F.bool_or(F.col("policy").isin(*names))

    held = policies.groupBy("member_id", "subject_type", "subject_id").agg(
        holds("workspace.manage", "workspace.read").alias("views"),
        holds("workspace.manage").alias("manages"),
        holds("org.manage").alias("manages_org"),
    )
    here = profiles.select("member_id", "org_id", "workspace_id").join(held, "member_id", "left")
    in_workspace = (F.col("subject_type") == "workspace") & (F.col("subject_id") == F.col("workspace_id"))
    in_org = (F.col("subject_type") == "org") & (F.col("subject_id") == F.col("org_id"))

    def granted(where: Column, flag: str) -> Column:
        return F.coalesce(F.bool_or(where & F.col(flag)), F.lit(False))

    return here.groupBy("member_id", "org_id", "workspace_id").agg(
        granted(in_workspace, "views").alias("can_view"),
        granted(in_workspace, "manages").alias("can_manage"),
        granted(in_org, "manages_org").alias("can_manage_org"),
    )


def org_key_validity(orgs: DataFrame, now: Column) -> DataFrame:
    """Time left until the API key of each organisation lapses."""
    lapse = F.timestamp_add("DAY", F.col("validity_days"), F.col("dt_created"))
    left = elapsed_ms(now, lapse)
    return orgs.select(
        F.col("id").alias("org_id"),
        "name",
        F.when(left > 0, format_interval_ms_days(left)).otherwise(F.lit("0 days")).alias("time_left"),
    )


def unexpired_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    """Members whose sign-in token is still good; the token itself is dropped."""
    return tokens.filter(F.col("expiry") > now).select("member_id", "expiry")


def workspaces_with_age(workspaces: DataFrame, now: Column) -> DataFrame:
    """Workspaces of each organisation with their age."""
    return workspaces.select(
        "org_id",
        F.col("id").alias("workspace_id"),
        "name",
        F.concat(time_elapsed("dt_created", now), F.lit(" ago")).alias("created"),
    )


def login_directory(members: DataFrame, user_login: DataFrame, login: DataFrame) -> DataFrame:
    """The sign-in providers of each member."""
    providers = login.select(F.col("id").alias("login_id"), "provider_id")
    people = members.select(F.col("id").alias("member_id"), "name", "email")
    return user_login.join(providers, "login_id").join(people, "member_id").select(
        "member_id", "name", "email", "provider_id"
    )
