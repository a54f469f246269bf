"""Row-level rules: who may read, add, change and delete rows of each table.

Four shapes: members of the firm, administrators, administrators or partners, and
the row's own user. An action without a rule is denied. Membership is a semi-join
with a one-user side, so it costs no shuffle of the guarded table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIONS = ("select", "insert", "update", "delete")

#: The rule of each table for select, insert, update and delete.
RULES: dict[str, tuple[str | None, str | None, str | None, str | None]] = {
    "profiles": ("firm", None, "own", None),
    "user_roles": ("firm", "admin", "admin", "admin"),
    "clients": ("firm", "firm", "firm", "admin_or_partner"),
    "matters": ("firm", "firm", "firm", "admin_or_partner"),
    "matter_stages": ("firm", "firm", "firm", "firm"),
    "matter_parties": ("firm", "firm", "firm", "firm"),
    "document_types": ("firm", "admin", "admin", "admin"),
    "matter_documents": ("firm", "firm", "firm", "firm"),
    "document_versions": ("firm", "firm", None, None),
    "documents": ("firm", "firm", "firm", "firm"),
    "redline_suggestions": ("firm", "firm", "firm", "firm"),
    "matter_notes": ("firm", "firm", None, None),
    "matter_tasks": ("firm", "firm", "firm", "firm"),
    "ai_chat_threads": ("firm", "firm", None, None),
    "ai_chat_messages": ("firm", "firm", None, None),
    "support_requests": ("own_or_admin", "own", "admin", None),
    "objects": ("firm", "firm", "firm", "firm"),
}

OWNER = {"profiles": "id", "support_requests": "user_id"}


def is_firm_member(profiles: DataFrame, user_id) -> DataFrame:
    """One row (id) if the user has a profile, else none."""
    return profiles.filter(F.col("id") == user_id).select("id").limit(1)


def has_role(user_roles: DataFrame, user_id, *roles: str) -> DataFrame:
    """One row (user_id) if the user holds any of the roles, else none."""
    return user_roles.filter((F.col("user_id") == user_id) & F.col("role").isin(*roles)).select("user_id").limit(1)


def _where(rows: DataFrame, grant: DataFrame) -> DataFrame:
    """All rows if ``grant`` has a row, else none: a semi-join on a constant."""
    return rows.join(F.broadcast(grant.select(F.lit(1).alias("_g"))), F.lit(1) == F.col("_g"), "left_semi")


def secure(rows: DataFrame, table: str, user_id, profiles: DataFrame, user_roles: DataFrame, action: str = "select") -> DataFrame:
    """The rows of ``table`` on which the user may do ``action``."""
    if table not in RULES:
        raise ValueError(f"no rules for table {table}")
    rule = RULES[table][ACTIONS.index(action)]
    if rule is None or user_id is None:
        return rows.filter(F.lit(False))
    if rule == "firm":
        return _where(rows, is_firm_member(profiles, user_id))
    if rule in ("admin", "admin_or_partner"):
        return _where(rows, has_role(user_roles, user_id, *rule.split("_or_")))
    own = rows.filter(F.col(OWNER[table]) == user_id)
    if rule == "own":
        return own
    other = rows.filter(~F.col(OWNER[table]).eqNullSafe(F.lit(user_id)))
    return own.unionByName(_where(other, has_role(user_roles, user_id, "admin")))
