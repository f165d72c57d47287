"""Decisions, action items and topics of meeting lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions.text import let, strip

# Words of decisions, topics and priorities; fixed values.
DECISIONS = ["决定", "确定", "决议", "定下来", "就这样", "达成一致", "一致同意", "最终方案", "最终决定", "拍板", "敲定", "定夺", "decided", "decision", "agreed", "conclusion", "resolved"]
TOPICS = ["议题", "讨论", "关于", "汇报", "议题：", "主题：", "专题", "agenda", "topic", "discussion", "regarding", "第一", "第二", "第三", "首先", "其次", "最后"]
URGENT = ["紧急", "尽快", "立刻", "马上", "今天", "urgent", "asap", "立即", "上线", "发布", "deadline", "截止", "bug", "故障", "事故"]
LATER = ["有空", "抽空", "考虑", "或许", "maybe", "later", "以后", "优化", "nice to have", "不急", "慢慢"]
# Deadlines, tried in this order; fixed values.
DEADLINES = [
    "(今天|明天|后天|大后天)", "(本周[一二三四五六日天]|下周[一二三四五六日天])", "(本?周[一二三四五六日天])", "([0-9]{1,2}月[0-9]{1,2}[日号])",
    r"([0-9]{1,2}\.[0-9]{1,2})", "([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2})", r"([0-9]{1,2}/[0-9]{1,2})\s*[之前]", r"(?:截止|DDL|deadline)[：:]?\s*(\S{2,20})", r"(?:by|before)\s+(\S{2,20})",
]
# Who is to do what, in patterns of owner and task, and words that are no owner; fixed values.
ACTIONS = [
    r"(.+?)需要[：:]?\s*(.+)", r"(.+?)负责[：:]?\s*(.+)", r"(.+?)跟进[：:]?\s*(.+)", r"(.+?)来做[：:]?\s*(.+)", r"(.+?)去[做干搞弄][：:]?\s*(.+)",
    r"待办[：:]?\s*(.+?)\s*[-–—]\s*(.+)", r"任务[：:]?\s*(.+?)\s*[-–—]\s*(.+)", r"action\s*(?:item)?[：:]\s*(.+?)\s*[-–—]\s*(.+)",
    r"(.+?)\s+will\s+(.+)", r"(.+?)\s+should\s+(.+)", r"@(\S+?)\s+(.+)", r"^[-*•0-9.\s]*(\S{1,10})[：:]\s+(.+)",
]
NO_OWNERS = ["i", "we", "you", "they", "he", "she", "it", "我", "我们", "你们", "他们", "她", "它", "大家", "自己", "某人", "谁", "有人"]


def holds_any(text: Column, words: list[str]) -> Column:
    return let(F.lower(text), lambda low: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)))


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """<id_col>, line_no, line: stripped lines that aren't empty."""
    rows = df.select(id_col, F.posexplode(F.split(text_col, "\r?\n")).alias("line_no", "line"))
    return rows.withColumn("line", strip(F.col("line"))).where(F.length("line") > 0)


def deadline(text: Column) -> Column:
    """By the first pattern that occurs anywhere, or null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in DEADLINES])


def priority(text: Column) -> Column:
    return F.when(holds_any(text, URGENT), "high").when(holds_any(text, LATER), "low").otherwise("medium")


def marked_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines that decide something or open a topic, with deadline and priority."""
    rows = lines(df, id_col, text_col)
    rows = rows.withColumn("is_decision", holds_any(F.col("line"), DECISIONS)).withColumn("is_topic", holds_any(F.col("line"), TOPICS))
    return rows.where("is_decision or is_topic").select("*", deadline(F.col("line")).alias("deadline"), priority(F.col("line")).alias("priority"))


def action_items(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """<id_col>, owner, task, line_no, deadline, priority: each owner's tasks once, from the first line that names them.

    Every pattern is tried on every line. Owners of more than 20 characters and words that are no owner, tasks of fewer than
    two characters, and null texts give no rows; the deadline is that of the line.
    """

    def found(pattern: str, number: int) -> Column:
        # what stands between owner and task is sought first: where it is missing, a pattern that begins anywhere tries every place
        between = re.sub(r"^\(\.\+\?\)|\(\.\+\)$", "", pattern)
        action = F.struct(
            F.lit(number).alias("no"), strip(F.regexp_replace(strip(F.regexp_extract("line", pattern, 1)), r"^[-*•0-9]+[.、．)\s]*", "")).alias("owner"),
            strip(F.regexp_extract("line", pattern, 2)).alias("task"),
        )
        return F.when(F.col("line").rlike(between), action)

    actions = F.array_compact(F.array(*[found(p, i) for i, p in enumerate(ACTIONS)]))
    rows = lines(df, id_col, text_col).select(id_col, "line_no", "line", F.explode(actions).alias("a"))
    rows = rows.select(id_col, "line_no", "line", "a.no", "a.owner", "a.task")
    rows = rows.where((F.length("task") >= 2) & F.length("owner").between(1, 20) & ~F.lower("owner").isin(NO_OWNERS))
    first = rows.groupBy(id_col, "owner", "task").agg(F.min(F.struct("line_no", "no", "line")).alias("f"))
    return first.select(id_col, "owner", "task", "f.line_no", deadline(F.col("f.line")).alias("deadline"), priority(F.col("task")).alias("priority"))
