"""Conversations: history windows, rewrite test, references, summary triggers and fallback summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that point back, and words that join questions; fixed values.
PRONOUNS = ["这个", "那个", "它", "他", "她", "上次", "刚才", "前者", "后者"]
CONJUNCTIONS = ["并且", "还有", "同时", "以及", "另外", "和", "与"]


def last_messages(df: DataFrame, session: str, at: str, id_col: str, n: int = 3) -> DataFrame:
    """The n latest messages of every session with place 1 for the latest; ties go to the larger id.

    The window keeps n rows per session and task before the shuffle, so a session of a third of all rows is no burden.
    """
    order = Window.partitionBy(session).orderBy(F.col(at).desc_nulls_last(), F.col(id_col).desc())
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def with_earlier(df: DataFrame, session: str, at: str, id_col: str) -> DataFrame:
    """Adds has_earlier: whether the session has a question before this one; ties of time go by id.

    Only the first question of each session is looked up, so that no session is ordered as a whole.
    """
    first = df.groupBy(F.col(session).alias("__s")).agg(F.min(F.struct(F.col(at).alias("a"), F.col(id_col).alias("i"))).alias("__first"))
    joined = df.join(first, F.col(session).eqNullSafe(F.col("__s")), "left")
    return joined.withColumn("has_earlier", F.col("__first.i") != F.col(id_col)).drop("__s", "__first")


def needs_rewrite(query: Column, has_earlier: Column, least: int = 5) -> Column:
    """Whether a question points back, joins two questions, or follows others and isn't very short."""
    words = F.array(*[F.lit(w) for w in PRONOUNS + CONJUNCTIONS])
    text = F.coalesce(query, F.lit(""))
    return F.exists(words, lambda w: F.contains(text, w)) | (has_earlier & (F.length(text) >= least))


def summary_due(df: DataFrame, session: str, threshold: int = 20) -> DataFrame:
    """session, n_messages, n_summaries: how many summaries a session's messages have triggered by their number."""
    counted = df.groupBy(session).agg(F.count(F.lit(1)).alias("n_messages"))
    return counted.where(F.col("n_messages") >= threshold).withColumn("n_summaries", F.floor(F.col("n_messages") / threshold).cast("int"))


def fallback_summary(df: DataFrame, session: str, role: str, content: str, at: str, id_col: str, recent: int = 20, topics: int = 5) -> DataFrame:
    """session, summary: first 60 characters of the last topics the user raised in the recent messages, joined."""
    latest = last_messages(df, session, at, id_col, recent).where((F.col(role) == "user") & (F.length(content) > 10))
    order = Window.partitionBy(session).orderBy("place")
    kept = latest.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= topics)
    lists = kept.groupBy(session).agg(F.sort_array(F.collect_list(F.struct((-F.col("__n")).alias("n"), F.substring(content, 1, 60).alias("t")))).alias("__l"))
    return lists.select(session, F.array_join(F.transform("__l", lambda x: x["t"]), "; ").alias("summary"))
