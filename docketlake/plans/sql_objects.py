"""The engine's functions and guarded tables as objects of a SQL session.

``define_functions`` gives SQL three functions over the session's tables: the table
function ``match_documents`` and the predicates ``is_firm_member`` and ``has_role``.
``define_guarded`` gives a view for each table and action that its rules allow; a view
shows the rows on which the user named by the variable ``auth_uid`` may do the action.
All of it is plain SQL that Catalyst takes apart: filters given as arguments reach the
scan, and a user without a right reads nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.operators.retrieval import MATCH_COUNT, MATCH_THRESHOLD
from docketlake.operators.security import ACTIONS, OWNER, RULES

USER = "auth_uid"
#: columns of a match, those that the rows have
MATCHED = ("id", "content", "metadata", "matter_id", "document_type_id")


def _kind(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def define_functions(spark: SparkSession, chunks: DataFrame, profiles: DataFrame, user_roles: DataFrame) -> None:
    """Defines match_documents, is_firm_member, has_role and cosine_similarity for the session.

    The tables become the views ``chunk_rows``, ``profile_rows`` and ``role_rows``. A query
    vector of another length than a row's, and null, zero and non-finite vectors, have no
    similarity; ``match_count`` below 1 and a null query give no rows.
    """
    for rows, name in ((chunks, "chunk_rows"), (profiles, "profile_rows"), (user_roles, "role_rows")):
        rows.createOrReplaceTempView(name)
    size = "sqrt(aggregate({0}, 0D, (s, x) -> s + x * x))"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
        RETURN CASE WHEN size(a) = size(b) THEN nanvl(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), {size.format("a")} * {size.format("b")}), CAST(NULL AS DOUBLE)) END""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION is_firm_member(_user_id {_kind(profiles, "id")}) RETURNS BOOLEAN
        RETURN EXISTS (SELECT 1 FROM profile_rows WHERE id = _user_id)""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION has_role(_user_id {_kind(user_roles, "user_id")}, _role STRING) RETURNS BOOLEAN
        RETURN EXISTS (SELECT 1 FROM role_rows WHERE user_id = _user_id AND role = _role)""")
    shown = [c for c in MATCHED if c in chunks.columns]
    columns = ", ".join(f"{c} {_kind(chunks, c)}" for c in shown)
    names = ", ".join(shown)
    arguments, where = "", "true"
    for column, argument in (("matter_id", "filter_matter_id"), ("document_type_id", "filter_document_type_id")):
        if column in chunks.columns:
            arguments += f", {argument} {_kind(chunks, column)} DEFAULT NULL"
            where += f" AND ({argument} IS NULL OR {column} = {argument})"
    if "is_precedent" in chunks.columns:
        arguments += ", precedent_only BOOLEAN DEFAULT false"
        where += " AND (NOT precedent_only OR is_precedent)"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION match_documents(query_embedding ARRAY<DOUBLE>, match_threshold DOUBLE DEFAULT {MATCH_THRESHOLD}, match_count INT DEFAULT {MATCH_COUNT}{arguments})
        RETURNS TABLE ({columns}, similarity DOUBLE)
        RETURN SELECT {names}, similarity FROM (
            SELECT {names}, similarity, row_number() OVER (ORDER BY similarity DESC, id) AS place FROM (
                SELECT {names}, cosine_similarity(embedding, query_embedding) AS similarity FROM chunk_rows WHERE {where})
            WHERE similarity > match_threshold)
        WHERE place <= match_count""")


def predicate(table: str, action: str) -> str | None:
    """The SQL condition of a rule on a row of ``table``; None where nobody may."""
    rule = RULES[table][ACTIONS.index(action)]
    member = {"firm": f"is_firm_member({USER})", "admin": f"has_role({USER}, 'admin')", "admin_or_partner": f"(has_role({USER}, 'admin') OR has_role({USER}, 'partner'))"}
    if rule in member:
        return member[rule]
    own = f"{OWNER.get(table)} = {USER}"
    return {"own": own, "own_or_admin": f"({own} OR has_role({USER}, 'admin'))", None: None}[rule]


def define_guarded(spark: SparkSession, tables: Mapping[str, DataFrame]) -> list[str]:
    """Defines views named by action and table (``select_clients``); returns their names.

    Needs the functions of ``define_functions``. An action that no rule allows has a view
    without rows. Inserts have no rows to show: see ``insertable``.
    """
    unknown = set(tables) - set(RULES)
    if unknown:
        raise ValueError(f"no rules for table {', '.join(sorted(unknown))}")
    _variable(spark)
    made = []
    for table, rows in tables.items():
        rows.createOrReplaceTempView(f"all_{table}")
        for action in ACTIONS:
            if action != "insert":
                spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {action}_{table} AS SELECT * FROM all_{table} WHERE {predicate(table, action) or 'false'}")
                made.append(f"{action}_{table}")
    return made


def _variable(spark: SparkSession) -> None:
    kind = spark.table("profile_rows").schema["id"].dataType.simpleString()
    spark.sql(f"DECLARE OR REPLACE VARIABLE {USER} {kind} DEFAULT NULL")


def as_user(spark: SparkSession, user_id) -> None:
    """Names the session's user; None: nobody. Queries hold the user of the time they were made."""
    spark.sql(f"SET VARIABLE {USER} = :user", args={"user": user_id})


def insertable(table: str, new: DataFrame) -> DataFrame:
    """The new rows that the session's user may add to ``table``."""
    return new.filter(F.expr(predicate(table, "insert") or "false"))
