"""Chat threads: which thread a request belongs to, and the turns it leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.operators.changes import keyed_id

#: Fixed texts: titles of new threads.
QUESTIONS = "Matter Q&A"


def intake_title(type_name: Column) -> Column:
    return F.concat(F.lit("Draft intake: "), type_name)


def resolve_threads(threads: DataFrame, requests: DataFrame, now: Column, title: Column | str = QUESTIONS) -> tuple[DataFrame, DataFrame]:
    """(threads with the new ones, requests with their thread_id).

    A request (request_id, thread_id, matter_id, user_id) that names a thread keeps it.
    One that names only a matter opens a thread, whose id follows from the request's, so
    a repeated job opens no second one. Without a matter nothing is kept: no thread.
    """
    opens = F.col("thread_id").isNull() & F.col("matter_id").isNotNull()
    held = F.when(F.col("matter_id").isNotNull(), F.coalesce("thread_id", keyed_id("thread", F.col("request_id"))))
    new = requests.filter(opens).select(held.cast(threads.schema["id"].dataType).alias("id"), "matter_id", (F.lit(title) if isinstance(title, str) else title).alias("title"), F.col("user_id").alias("created_by"), now.alias("created_at"))
    known = new.join(threads.select("id"), "id", "left_anti")
    return threads.unionByName(known, allowMissingColumns=True), requests.withColumn("thread_id", held)


def append_turns(messages: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Messages, and the user's and then the assistant's turn of each request with a thread.

    ``requests`` has request_id, thread_id, question and reply; a null reply leaves the
    user's turn alone, as after a failed completion. The turns of one request are a
    microsecond apart, so they sort in order.
    """
    turn = lambda n, role, text: F.struct(F.lit(role).alias("role"), text.alias("content"), (now + F.expr(f"INTERVAL {n} MICROSECOND")).alias("created_at"))
    both = requests.filter("thread_id IS NOT NULL").select("request_id", "thread_id", F.explode(F.array(turn(0, "user", F.col("question")), turn(1, "assistant", F.col("reply")))).alias("t"))
    rows = both.filter("t.content IS NOT NULL").select(keyed_id("turn", F.col("request_id"), F.col("t.role")).alias("id"), "thread_id", "t.role", "t.content", "t.created_at")
    return messages.unionByName(rows.join(messages.select("id"), "id", "left_anti"), allowMissingColumns=True)
