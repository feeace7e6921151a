"""Keys, scopes, memberships, accounts and tenant isolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom import session


def attribute_batches(batches: DataFrame, api_keys: DataFrame, scope: str = "ingest") -> DataFrame:
    """Adds project, scopes and a refusal reason from the hash of the API key.

    Unknown and revoked keys look the same.
    """
    live = api_keys.filter(F.col("revoked_at").isNull()).select("key_hash", "project_id", "scopes")
    hashed = batches.withColumn("key_hash", F.sha2(F.col("api_key"), 256))
    joined = session.lookup_join(hashed, live, ["key_hash"], [F.col("batch_id")])
    refused = F.when(F.col("project_id").isNull(), "unauthenticated").when(
        ~F.array_contains("scopes", scope), "out_of_scope"
    )
    return joined.drop("key_hash", "api_key").withColumn("refused", refused)


def split_authorised(attributed: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.col("refused").isNull()
    return attributed.filter(ok).drop("refused", "scopes"), attributed.filter(~ok)


def tenant_view(df: DataFrame, project_id: str | None) -> DataFrame:
    """Rows of one tenant; without a tenant, none."""
    if not project_id:
        return df.limit(0)
    return df.filter(F.col("project_id") == project_id)


def foreign_rows(df: DataFrame, project_id: str | None) -> DataFrame:
    """Rows a write for this tenant must not contain."""
    if not project_id:
        return df
    return df.filter(~F.col("project_id").eqNullSafe(F.lit(project_id)))


def checked_write(df: DataFrame, project_id: str | None) -> DataFrame:
    """The frame, with a failure for any row of another tenant.

    The guard is a filter, so no later projection takes it away.
    """
    own = F.col("project_id").eqNullSafe(F.lit(project_id)) & F.lit(bool(project_id))
    return df.filter(F.when(own, True).otherwise(F.raise_error(F.lit("row belongs to another tenant")).cast("boolean")))


def isolation_audit(
    tables: dict[str, DataFrame], projects: DataFrame, references: dict[str, tuple[DataFrame, str, DataFrame]]
) -> DataFrame:
    """Per table its rows, those without a project and those of an unknown one; per reference those that leave their project.

    ``references`` names (table, column, target table with ``id``): a reference
    crosses when its id is found in other projects and not in its own. Counts are
    partial sums; a target's ids meet once per project, whatever they are sent as.
    """
    known = projects.select(F.col("project_id").alias("_known")).distinct()
    if session.within(known, session.BROADCAST_ROW_BOUND):
        known = F.broadcast(known)
    found = []
    for name, df in tables.items():
        # One row per project is left to be looked up.
        counted = df.groupBy("project_id").agg(F.count("*").alias("n"))
        marked = counted.join(known, F.col("project_id") == F.col("_known"), "left")
        found.append(marked.agg(
            F.lit(name).alias("subject"), _sum("n").alias("checked"),
            _sum(F.when(F.col("project_id").isNull(), F.col("n"))).alias("without_project"),
            _sum(F.when(F.col("project_id").isNotNull() & F.col("_known").isNull(), F.col("n"))).alias("foreign"),
        ))
    for name, (df, column, target) in references.items():
        sent = df.filter(F.col(column).isNotNull()).groupBy("project_id", F.col(column).alias("id")).agg(F.count("*").alias("n"))
        homes = target.groupBy("id").agg(F.collect_set("project_id").alias("homes"))  # few projects share an id
        placed = sent.join(homes, "id", "left")
        crosses = F.col("homes").isNotNull() & ~F.coalesce(F.array_contains("homes", F.col("project_id")), F.lit(False))
        found.append(placed.agg(
            F.lit(name).alias("subject"), _sum("n").alias("checked"),
            _sum(F.when(F.col("project_id").isNull(), F.col("n"))).alias("without_project"),
            _sum(F.when(crosses, F.col("n"))).alias("foreign"),
        ))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _sum(c) -> Column:
    return F.coalesce(F.sum(c), F.lit(0).cast("bigint"))


def visible_projects(projects: DataFrame, members: DataFrame, user_id: str | None = None) -> DataFrame:
    """Projects of each user, oldest membership first."""
    mine = members if user_id is None else members.filter(F.col("user_id") == user_id)
    held = mine.select("project_id", "user_id", "role", F.col("created_at").alias("member_since"))
    return session.lookup_join(held, projects, ["project_id"], [F.col("user_id")], how="inner").orderBy(
        "user_id", "member_since", "project_id"
    )


def rows_of_member(facts: DataFrame, members: DataFrame, user_id: str) -> DataFrame:
    """Facts of the projects one user belongs to."""
    mine = members.filter(F.col("user_id") == user_id).select("project_id").distinct()
    if session.within(mine, session.BROADCAST_ROW_BOUND):
        mine = F.broadcast(mine)
    return facts.join(mine, "project_id", "left_semi")


def key_listing(api_keys: DataFrame) -> DataFrame:
    """Keys in creation order with their status; never the hash."""
    status = F.when(F.col("revoked_at").isNull(), "active").otherwise("revoked")
    return api_keys.select(
        "project_id", "id", "key_prefix", "label", "scopes", status.alias("status"), "created_at"
    ).orderBy("project_id", "created_at", "id")


def revoke_keys(
    api_keys: DataFrame,
    at: Column,
    project_id: str,
    label: str | None = None,
    by_user: str | None = None,
    members: DataFrame | None = None,
) -> DataFrame:
    """Next version of the key table: matching live keys get a revocation time.

    Without a label all keys of the project are rotated out. Acting for a user
    needs that user's membership.
    """
    hit = (F.col("project_id") == project_id) & F.col("revoked_at").isNull()
    if label is not None:
        hit = hit & (F.col("label") == label)
    if by_user is not None:
        allowed = members.filter(
            (F.col("user_id") == by_user) & (F.col("project_id") == project_id)
        )
        hit = hit & F.lit(session.within(allowed, 0) is False)
    return api_keys.withColumn("revoked_at", F.when(hit, at).otherwise(F.col("revoked_at")))


def oldest_live_keys(api_keys: DataFrame) -> DataFrame:
    """The first surviving key of each project."""
    order = Window.partitionBy("project_id").orderBy("created_at", "id")
    live = api_keys.filter(F.col("revoked_at").isNull())
    return live.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == 1).drop("_n")


def grant_memberships(members: DataFrame, grants: DataFrame, users: DataFrame) -> DataFrame:
    """Upsert of roles by email; an email shared by several users grants nothing.

    ``grants`` holds ``project_id, email, role, granted_at``; the latest grant
    of a pair wins and a first grant sets the creation time.
    """
    single = users.groupBy(F.lower("email").alias("email")).agg(
        F.count("*").alias("n"), F.min("id").alias("user_id")
    ).filter("n = 1").drop("n")
    wanted = grants.withColumn("email", F.lower("email")).join(single, "email")
    rows = members.select(
        "project_id", "user_id", "role", "created_at", F.lit(0).alias("rank"), F.col("created_at").alias("at")
    ).unionByName(
        wanted.select(
            "project_id", "user_id", "role", F.col("granted_at").alias("created_at"),
            F.lit(1).alias("rank"), F.col("granted_at").alias("at"),
        )
    )
    seq = F.struct("rank", "at")
    return rows.groupBy("project_id", "user_id").agg(
        F.max_by("role", seq).alias("role"), F.min_by("created_at", seq).alias("created_at")
    )


def ambiguous_emails(users: DataFrame) -> DataFrame:
    return users.groupBy(F.lower("email").alias("email")).agg(F.count("*").alias("users")).filter("users > 1")


def fold_accounts(
    sign_ins: DataFrame, allowed: DataFrame | None = None, known: DataFrame | None = None
) -> DataFrame:
    """Accounts from a log of sign-ins (``subject, email, verified, name, avatar_url, kind, at``).

    The first verified sign-in creates the account, later ones refresh it;
    sign-outs raise the session version. An allowlist of emails gates only
    subjects that have no account yet.
    """
    verified = sign_ins.filter((F.col("kind") == "sign_in") & F.col("verified"))
    if allowed is not None:
        listed = allowed.select(F.lower("email").alias("_allowed")).distinct()
        if session.within(listed, session.BROADCAST_ROW_BOUND):
            listed = F.broadcast(listed)
        marked = verified.join(listed, F.lower("email") == F.col("_allowed"), "left")
        opened = marked.filter(F.col("_allowed").isNotNull()).groupBy("subject").agg(
            F.min("at").alias("opened_at")
        )
        if known is not None:
            early = known.select("subject", F.lit("1970-01-01").cast("timestamp").alias("opened_at"))
            opened = opened.unionByName(early).groupBy("subject").agg(F.min("opened_at").alias("opened_at"))
        verified = verified.join(opened, "subject").filter(F.col("at") >= F.col("opened_at"))
    accounts = verified.groupBy("subject").agg(
        F.min("at").alias("created_at"),
        F.max("at").alias("last_login_at"),
        F.min_by(F.coalesce(F.nullif("name", F.lit("")), F.col("email")), "at").alias("first_label"),
        F.max_by("email", "at").alias("email"),
        F.max_by("name", "at").alias("name"),
        F.max_by("avatar_url", "at").alias("avatar_url"),
    )
    outs = sign_ins.filter(F.col("kind") == "sign_out").groupBy("subject").agg(F.count("*").alias("outs"))
    return accounts.join(outs, "subject", "left").select(
        "subject", "email", "name", "avatar_url", "created_at", "last_login_at",
        F.concat("first_label", F.lit("'s project")).alias("project_name"),
        F.coalesce("outs", F.lit(0)).alias("session_version"),
    )


def personal_projects(accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The project and the owner membership each new account starts with."""
    owned = accounts.withColumn("project_id", F.sha2(F.col("subject"), 256))
    projects = owned.select("project_id", F.col("project_name").alias("name"), "created_at")
    members = owned.select(
        "project_id", F.col("subject").alias("user_id"), F.lit("owner").alias("role"), "created_at"
    )
    return projects, members


def purge_tenants(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of deleted projects."""
    ids = gone.select("project_id").distinct()
    if session.within(ids, session.BROADCAST_ROW_BOUND):
        ids = F.broadcast(ids)
    return {n: df.join(ids, "project_id", "left_anti") for n, df in tables.items()}
