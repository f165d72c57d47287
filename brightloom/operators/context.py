"""Context for an answer: messages that are referred to, recent summaries, and the sections put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions.text import strip, truncated

# Headings of the sections, the mark of a reference, and what stands for a question of nothing but references; fixed values.
SECTIONS = {"system": "[System]", "summary": "[对话摘要]", "references": "[引用消息]", "documents": "[文档]", "user": "[用户]"}
REFERENCE = r"@msg-([a-zA-Z0-9-]+)"
ONLY_REFERENCES = "请参考上述引用消息回答。"


def without_references(text: Column) -> Column:
    return strip(F.regexp_replace(text, REFERENCE, ""))


def references(df: DataFrame, id_col: str, session: str, text: str, history: DataFrame, message_id: str, content: str) -> DataFrame:
    """<id_col>, place, <message_id>, <content>: the messages a text refers to that its session holds, in order of reference.

    An equi-join on session and message, whose keys are as many as there are messages, so that long sessions are no hot keys.
    """
    named = df.select(id_col, session, F.posexplode(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))).alias("place", message_id))
    return named.join(history.select(session, message_id, content), [session, message_id]).select(id_col, "place", message_id, content)


def recent_lines(df: DataFrame, session: str, at: str, id_col: str, text: str, n: int = 3) -> DataFrame:
    """session, lines: the n newest texts of every session, the oldest first, each after a dash; null texts don't count.

    The window keeps n rows a session and task before the shuffle.
    """
    order = Window.partitionBy(session).orderBy(F.col(at).desc_nulls_last(), F.col(id_col).desc())
    newest = df.where(F.length(text) > 0).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n)
    lists = newest.groupBy(session).agg(F.sort_array(F.collect_list(F.struct((-F.col("__n")).alias("n"), F.col(text).alias("t")))).alias("__l"))
    return lists.select(session, F.array_join(F.transform("__l", lambda x: F.concat(F.lit("- "), x["t"])), "\n").alias("lines"))


def document_lines(ranked: DataFrame, query: str, place: str, source: str, content: str, score: str, most: int = 200) -> DataFrame:
    """query, lines: the documents of a query in order of place, with source and score, each cut to ``most`` characters."""
    line = F.concat(
        F.col(place), F.lit(". "), F.coalesce(F.col(source), F.lit("unknown")), F.lit(" (score: "),
        F.replace(F.format_number(F.coalesce(F.col(score), F.lit(0.0)), 2), F.lit(","), F.lit("")), F.lit("): "), F.coalesce(truncated(F.col(content), most), F.lit("")),
    )
    lists = ranked.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), line.alias("l")))).alias("__l"))
    return lists.select(query, F.array_join(F.transform("__l", lambda x: x["l"]), "\n").alias("lines"))


def merged(system: Column, summary: Column, refers: Column, documents: Column, user: Column) -> Column:
    """The sections that hold anything, a blank line between; the user's words, without references, come last."""

    def section(name: str, body: Column) -> Column:
        return F.when(F.length(body) > 0, F.concat(F.lit(SECTIONS[name] + "\n"), body))

    words = F.coalesce(without_references(user), F.lit(""))
    asked = F.when((words == "") & (F.length(refers) > 0), ONLY_REFERENCES).otherwise(words)
    return F.concat_ws(
        "\n\n", section("system", system), section("summary", summary), section("references", refers), section("documents", documents),
        F.concat(F.lit(SECTIONS["user"] + "\n"), asked),
    )
