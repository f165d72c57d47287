import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from brightloom.functions import text as T
from brightloom.operators import chunking, context, graph, meetings, retrieval, summary, tables


def one(spark, expr, schema, *values):
    return spark.createDataFrame([values], schema).select(expr).first()[0]


@pytest.mark.parametrize(
    "value,want", [("short", "short"), ("a" * 12, "a" * 10 + "..."), ("abcdefg hijk", "abcdefg..."), ("ab. defg. xyz", "ab. defg..."), ("abcdefgh\nij k", "abcdefgh..."), ("a b" + "c" * 20, "a bccccccc..."), (None, None)]
)
def test_truncated(spark, value, want):
    assert one(spark, T.truncated(F.col("t"), 10), "t string", value) == want


def test_json_score_and_numbers(spark):
    rows = [('{"s": 0.8}', 0.8), ('so: {"s": 1} then', 1.0), ("nothing", 0.5), ("{broken", 0.5), (None, 0.5), ('{"x": 1}', 0.5)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string")
    assert [r["s"] for r in df.select("i", T.json_score(F.col("t"), "s").alias("s")).orderBy("i").collect()] == [r[1] for r in rows]
    assert one(spark, T.first_number(F.col("t")), "t string", "about 12.50 kg") == 12.5 and one(spark, T.first_number(F.col("t")), "t string", "none") is None


def test_nfkc(spark):
    texts = ["ＡＢ①", "é", "ﬁ", None, ""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.nfkc(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == [unicodedata.normalize("NFKC", t) if t is not None else None for t in texts]


def aligned(text, wanted):
    if not 0 < wanted < len(text):
        return 0
    for d in range(max(10, int(wanted * 0.3))):
        for at in (wanted + d, wanted - d):
            if 0 < at < len(text) and text[at] in "。！？.!?\n":
                return at + 1
    return wanted


def test_aligned_overlap_equals_a_plain_search(spark):
    texts = ["", "abc", "x" * 100, "One. Two! " * 12, "句子在这里。" * 20, "y" * 44 + "." + "y" * 60, "y" * 55 + ".z." + "y" * 60, "z" * 37 + "\n" + "z" * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking.aligned_overlap(F.col("t"), 50).alias("a")).orderBy("i")
    assert [r["a"] for r in df.collect()] == [aligned(t, 50) for t in texts]


def test_overlap_points_to_the_chunk_before(spark):
    df = spark.createDataFrame([(1, 0, "x" * 60), (1, 1, "x" * 60), (1, 2, "x" * 500)], "id int, chunk_index int, chunk string")
    got = chunking.with_overlap(df, 50).orderBy("chunk_index").collect()
    assert [(r["overlap_ratio"], r["near_duplicate_of"]) for r in got] == [(0.0, None), (round(50 / 60, 3), 0), (0.1, None)]


def test_token_chunks_are_a_round_trip(spark):
    public = pytest.importorskip("public_tokenizers")
    text = "The quick brown fox jumps over the lazy dog. " * 40
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "hi")], "id int, t string")
    path = public.path("byte_bpe_50k.tiktoken")
    got = chunking.token_chunks(df, "id", "t", path, public.PATTERN, 64, 0).orderBy("id", "chunk_index").collect()
    assert "".join(r["chunk"] for r in got if r["id"] == 1) == text and {r["id"] for r in got} == {1, 4} and max(r["n_tokens"] for r in got) == 64
    over = chunking.token_chunks(df, "id", "t", path, public.PATTERN, 64, 16).where("id = 1").orderBy("chunk_index").collect()
    assert all(b["chunk"].startswith(a["chunk"][-20:].lstrip()[:0]) for a, b in zip(over, over[1:])) and sum(r["n_tokens"] for r in over) > sum(r["n_tokens"] for r in got if r["id"] == 1)
    with pytest.raises(ValueError):
        chunking.token_chunks(df, "id", "t", path, public.PATTERN, 8, 8)


def test_map_chunks_cover_the_text(spark):
    text = "".join(f"Sentence number {i} stands here. " for i in range(400))
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, ""), (5, "x" * 7000)], "id int, t string")
    got = chunking.map_chunks(df, "id", "t").orderBy("id", "chunk_index").collect()
    mine = [r["chunk"] for r in got if r["id"] == 1]
    assert len(mine) > 3 and all(len(c) <= 3000 for c in mine) and all(c.endswith(".") for c in mine)
    at = 0
    for c in mine:  # each begins before the end of the one before
        begin = text.index(c, max(0, at - 260))
        assert begin <= at
        at = begin + len(c)
    assert at >= len(text.rstrip()) and {r["id"] for r in got} == {1, 2, 5}
    assert chunking.map_chunks(df, "id", "t", most=2).where("id = 1").count() == 2


def test_summaries_put_together(spark):
    s = "array<string>"
    assert one(spark, summary.assembled(F.col("s"), "bullet"), f"s {s}", [" a. ", "b."]) == "• a.\n• b."
    assert one(spark, summary.trimmed(F.col("t"), 20, F.lit(True)), "t string", "First one here. Second one.") == "First one here."
    assert one(spark, summary.trimmed(F.col("t"), 20, F.lit(True)), "t string", "abc. " + "x" * 30) == "abc. " + "x" * 15 + "..."
    assert one(spark, summary.trimmed(F.col("t"), 8, F.lit(False)), "t string", "这是第一句话。这是第二") == "这是第一句话。"
    assert one(spark, summary.key_points(F.col("s"), F.lit(True)), f"s {s}", ["x" * 130] + list("abcdef")) == ["x" * 120 + "...", "a", "b", "c", "d"]
    text = "Head\n```py\nx = 1\n```\nkeep `y`\n| a | b |\n|---|---|\n| 1 | 2 |\nend"
    assert one(spark, summary.without_blocks(F.col("t")), "t string", text) == "Head\n[代码块已省略]\nkeep `y`\n[表格: 2行 × 2列]end"
    assert one(spark, summary.without_blocks(F.col("t")), "t string", None) is None and one(spark, summary.without_blocks(F.col("t")), "t string", "plain") == "plain"
    assert one(spark, summary.compression(F.lit("ab"), F.col("t")), "t string", "abcdefg") == round(2 / 7, 4)


def grounded(answer, place, source):
    if place < 0:
        return False
    snippet = re.sub(r"\s+", " ", answer[max(0, place - 50) : place + 150]).strip()
    source = re.sub(r"\s+", " ", source).strip()
    if len(snippet) < 5:
        return True
    held = {j for n in (5, 4, 3) for i in range(len(snippet) - n + 1) if snippet[i : i + n] in source for j in range(i, i + n)}
    return len(held) / len(snippet) >= 0.3


def test_grounding_equals_a_plain_search(spark):
    source = "The rule engine merged the quarterly figures under heavy load."
    answers = [
        ("The rule engine merged the figures [1] today.", 1), ("Completely made up words about zebras and giraffes dancing in Budapest [1].", 1), ("See [1-3] the quarterly figures.", 2),
        ("no mark the rule engine", 1), ("[1]", 1), ("Zzz yyy xxx [12] and [1].", 1), ("规则引擎合并了季度数字[1]。", 1),
    ]
    df = spark.createDataFrame([(i, a, n, source) for i, (a, n) in enumerate(answers)], "i int, a string, n int, s string")
    at = retrieval.marker_place(F.col("a"), F.col("n"))
    got = df.select("i", at.alias("at"), retrieval.grounded(F.col("a"), at, F.col("s")).alias("g")).orderBy("i").collect()
    assert [r["at"] for r in got] == [35, 71, 4, -1, 0, 21, 11]
    assert [r["g"] for r in got] == [grounded(a, r["at"], source) for (a, _), r in zip(answers, got)]


def test_context(spark):
    history = spark.createDataFrame([("s1", "m-1", "first"), ("s1", "m-2", None), ("s2", "m-3", "other")], "session string, message_id string, content string")
    asked = spark.createDataFrame([(1, "s1", "@msg-m-2 and @msg-m-1 please"), (2, "s1", "see @msg-m-3"), (3, None, "@msg-m-1"), (4, "s1", None)], "id int, session string, t string")
    got = context.references(asked, "id", "session", "t", history, "message_id", "content").orderBy("id", "place").collect()
    assert [(r["id"], r["place"], r["message_id"], r["content"]) for r in got] == [(1, 0, "m-2", None), (1, 1, "m-1", "first")]
    whole = context.merged(F.lit("rules"), F.lit(None).cast("string"), F.lit("@msg-1: x"), F.lit(""), F.col("t"))
    assert one(spark, whole, "t string", "@msg-1 ") == "[System]\nrules\n\n[引用消息]\n@msg-1: x\n\n[用户]\n请参考上述引用消息回答。"
    assert one(spark, context.merged(F.lit(""), F.lit("- a"), F.lit(""), F.lit("1. d"), F.col("t")), "t string", "hi @msg-a") == "[对话摘要]\n- a\n\n[文档]\n1. d\n\n[用户]\nhi"
    rows = spark.createDataFrame([("s", i, f"m{i}", None if i == 3 else f"t{i}") for i in range(5)], "session string, at int, id string, t string")
    assert context.recent_lines(rows, "session", "at", "id", "t", 3).first()["lines"] == "- t1\n- t2\n- t4"


def test_action_items(spark):
    text = "李雷负责：写报告 周五前\nBob will fix the bug by Friday\nBob will fix the bug by Friday\n我需要休息一下\nTODO nothing\n@amy check logs\n\n- 王芳: 更新文档"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    got = {(r["owner"], r["task"]): (r["line_no"], r["deadline"], r["priority"]) for r in meetings.action_items(df, "id", "t").collect()}
    assert got["李雷", "写报告 周五前"] == (0, "周五", "medium") and got["Bob", "fix the bug by Friday"] == (1, "Friday", "high")
    assert got["amy", "check logs"][0] == 5 and got["王芳", "更新文档"][0] == 7 and not [o for o, _ in got if o in ("我", "we")]


def test_cleaning(spark):
    df = spark.createDataFrame([(1, "a", 1.0, "x"), (2, "a", None, None), (3, "a", 3.0, "y"), (4, None, None, "y"), (5, None, 7.0, "x"), (6, "b", None, "x")], "id int, g string, v double, c string")
    got = {r["id"]: r["v"] for r in tables.imputed(df, "v", ["g"]).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 3.0, 4: 7.0, 5: 7.0, 6: None}
    assert {r["id"]: r["c"] for r in tables.imputed_common(df, "c").collect()}[2] == "x" and tables.imputed(df, "v", []).where("v is null").count() == 0
    empty = tables.imputed_common(df.limit(0), "c")
    assert empty.count() == 0 and empty.columns == df.columns
    issues = tables.profile_issues(tables.profile(df.withColumn("n", F.lit(None).cast("string")), ["g", "v", "c", "n"]))
    assert {(r["column"], r["issue"], r["severity"]) for r in issues.collect()} == {("g", "missing", "high"), ("v", "missing", "high"), ("c", "missing", "medium"), ("n", "missing", "high"), ("n", "empty", "high")}
    assert tables.severity_counts(issues).first().asDict() == {"high": 4, "medium": 1, "low": 0, "total": 5} and tables.severity_counts(issues.limit(0)).first()["total"] == 0
    nested = spark.createDataFrame([(1, ("a", ("b",)))], "id int, m struct<x: string, y: struct<z: string>>")
    assert tables.flattened(nested, "m").columns == ["id", "m_x", "m_y"]


def test_local_context(spark):
    found = spark.createDataFrame([("q", f"n{i}", i) for i in range(7)] + [("p", "lonely", 1)], "query string, name string, rank int")
    entities = spark.createDataFrame([(f"n{i}", None, "d" * 400) for i in range(7)], "name string, type string, description string")
    edges = spark.createDataFrame([("n0", f"m{i:02d}", None) for i in range(20)] + [("z", "n1", "back")], "source string, target string, description string")
    reports = spark.createDataFrame([(f"n{i}", f"report {i % 4}") for i in range(7)], "name string, report string")
    got = {r["query"]: r["context"] for r in graph.local_context(found, "query", entities, edges, reports).collect()}
    assert got["q"].count("- **") == 5 and got["q"].count("→") == 10 and got["q"].count("report ") == 3 and "d" * 301 not in got["q"]
    assert got["p"] == "## Entities\n- **lonely** (N/A)" and math.isclose(len(graph.local_context(found, "query", entities, edges, reports, tokens=10).where("query = 'q'").first()["context"]), 20)
