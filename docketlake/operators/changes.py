"""Changes of tables as DataFrames: what a table is after inserts, updates and deletes.

Each takes the rows before and returns the rows after, so one write makes a change
whole. ``docketlake.sources.store`` writes them as snapshots.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions.text import none_if_empty
from docketlake.schema import DEFAULT_STAGES, FOREIGN_KEYS, TOUCHED


def keyed_id(*parts: str | Column) -> Column:
    """An id in the form of a UUID that follows from its parts (texts or columns).

    The same parts give the same id, so a task or job that runs again makes no new row.
    """
    told = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.regexp_replace(F.md5(F.concat_ws("/", *told)), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")


def with_ids(new: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """New rows with an id each; those that have one keep it. ``keys`` tell the rows apart."""
    made = keyed_id(table, *map(F.col, keys))
    return new.withColumn("id", F.coalesce(F.col("id").cast("string"), made) if "id" in new.columns else made)


def insert(rows: DataFrame, new: DataFrame, optional: Sequence[str] = (), table: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with new ones; empty strings in optional columns become null.

    With a table and keys, new rows without an id get one.
    """
    for c in optional:
        new = new.withColumn(c, none_if_empty(F.col(c)))
    return rows.unionByName(with_ids(new, table, keys) if table else new, allowMissingColumns=True)


def stages_for(matters: DataFrame) -> DataFrame:
    """The stages of new matters: the first in progress, the others not started."""
    names = F.array(*map(F.lit, DEFAULT_STAGES))
    out = matters.select(F.col("id").alias("matter_id"), F.posexplode(names).alias("sort_order", "name"))
    return out.select("matter_id", "name", "sort_order", F.when(F.col("sort_order") == 0, "in_progress").otherwise("not_started").alias("status"))


def update(rows: DataFrame, where: Column, values: Mapping[str, Column], touch: Column | None = None) -> DataFrame:
    """Columns set where the condition holds; ``touch`` goes into updated_at there."""
    hit = F.coalesce(where, F.lit(False))
    new = dict(values) | ({"updated_at": touch} if touch is not None else {})
    return rows.withColumns({c: F.when(hit, v.cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in new.items()})


def update_table(table: str, rows: DataFrame, where: Column, values: Mapping[str, Column], now: Column) -> DataFrame:
    """``update`` as the store does it: tables that keep updated_at get it refreshed."""
    return update(rows, where, values, now if table in TOUCHED else None)


def set_stage_status(rows: DataFrame, where: Column, status: Column, now: Column) -> DataFrame:
    """Status and its time of completion: now if complete, else none."""
    return update(rows, where, {"status": status, "completed_at": F.when(status == "complete", now)})


def delete(rows: DataFrame, where: Column) -> DataFrame:
    return rows.filter(~F.coalesce(where, F.lit(False)))


def delete_by_path(chunks: DataFrame, path: str) -> DataFrame:
    """All chunks of one stored file go, by the path in their JSON metadata."""
    return delete(chunks, F.get_json_object("metadata", "$.storage_path") == path)


def replace_where(rows: DataFrame, where: Column, new: DataFrame) -> DataFrame:
    """Rows that match go, new ones come, in one change."""
    return delete(rows, where).unionByName(new, allowMissingColumns=True)


def replace_pending(suggestions: DataFrame, version_id, new: DataFrame) -> DataFrame:
    """A version's pending suggestions give way to new ones; decided ones stay."""
    return replace_where(suggestions, (F.col("document_version_id") == version_id) & (F.col("status") == "pending"), new)


def replace_role(user_roles: DataFrame, user_id, new: DataFrame) -> DataFrame:
    return replace_where(user_roles, F.col("user_id") == user_id, new)


def find_or_create(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], defaults: Mapping[str, Column], table: str | None = None) -> DataFrame:
    """Rows, and one new row for each wanted key that has none; with a table, it gets an id."""
    missing = wanted.select(*keys, *[c for c in wanted.columns if c not in keys]).dropDuplicates(list(keys)).join(rows.select(*keys), list(keys), "left_anti")
    made = missing.select(*keys, *[v.alias(c) for c, v in defaults.items()])
    made = with_ids(made, table, keys) if table else made
    return rows.unionByName(made, allowMissingColumns=True)


def insert_missing(rows: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert that leaves keys alone that are already there."""
    return rows.unionByName(new.dropDuplicates(list(keys)).join(rows.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def cascade(children: DataFrame, parents: DataFrame, on: str, key: str = "id") -> DataFrame:
    """Children whose parent is there, or that name none."""
    held = children.join(parents.select(F.col(key).alias("_key")), F.col(on) == F.col("_key"), "left_semi")
    return held.unionByName(children.filter(F.col(on).isNull()))


def set_null(children: DataFrame, parents: DataFrame, on: str, key: str = "id") -> DataFrame:
    """Children, with the reference cleared where the parent is gone."""
    side = parents.select(F.col(key).alias("_key")).distinct()
    return children.join(side, F.col(on) == F.col("_key"), "left").withColumn(on, F.when(F.col("_key").isNotNull(), F.col(on))).drop("_key").select(*children.columns)


def after_deletion(tables: Mapping[str, DataFrame], table: str, where: Column) -> dict[str, DataFrame]:
    """All tables after rows of one are deleted and every foreign key has acted."""
    out = dict(tables)
    out[table] = delete(out[table], where)
    changed, order = {table}, list(FOREIGN_KEYS)
    for child in order:  # parents stand before their children
        for on, parent, rule in FOREIGN_KEYS[child]:
            if parent in changed and child in out:
                out[child] = (set_null if rule == "set null" else cascade)(out[child], out[parent], on)
                if rule == "cascade":
                    changed.add(child)
    return out


def profile_of_signup(users: DataFrame) -> DataFrame:
    """Profiles of new users (id, email, raw_user_meta_data as JSON)."""
    return users.select("id", "email", F.get_json_object("raw_user_meta_data", "$.full_name").alias("full_name"))


def upload_path(matter_id: Column, document_id: Column, version: Column, name: Column) -> Column:
    return F.format_string("%s/%s/v%d-%s", matter_id, document_id, version, name)


def precedent_path(type_id: Column, millis: Column, name: Column) -> Column:
    return F.format_string("precedent/%s/%d-%s", type_id, millis, name)
