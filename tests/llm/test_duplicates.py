import pytest

from brightloom.llm.duplicates import count_copies, duplicate_records

SCHEMA = "cand_id bigint, content string, source string, digest string, rep_id int"


def rows(spark, data):
    return spark.createDataFrame([(i, c, s, "x", 7) for i, c, s in data], SCHEMA)


def found(spark, data):
    out = duplicate_records(rows(spark, data), "cand_id", ["content", "source"]).collect()
    return {(r["rep_id"], r["copies"]) for r in out}


SAME = [
    ("The rule engine, again.", "  the RULE​ engine\n again !"),
    ("校验了入职手册。", "校验了 入职手册"),
    ("title: A b; owner: C; pages: -1.5", '{"owner": "c", "pages": "-1.5", "title": "A B"}'),
    ("title=A | owner=B", "owner: b\ntitle: a"),
    ("ＡＢＣ１２", "abc12"),
    ("偏差为−10.2秒", "偏差为 -10.2 秒。"),
    ("Re-Check of covid-19, 3-5 days.", "re check of COVID 19 35 days"),
    ("area=ops | pages=-3", '{\n "pages": "-3",\n "area": "ops"\n}'),
]
OTHER = [
    ("moved by 13.3", "moved by 133"),
    ("moved by -13.3", "moved by 13.3"),
    ("偏差为-10.2秒", "偏差为10.2秒"),
    ("ずれは−10秒", "ずれは10秒"),
    ("页数: -45; 状态: open", "页数: 45; 状态: open"),
    ("-5 points", "5 points"),
    ("owner: A; reviewer: B", "owner: B; reviewer: A"),
    ("pages: 5; no: 6", "pages: 6; no: 5"),
]


@pytest.mark.parametrize("a,b", SAME)
def test_same(spark, a, b):
    assert found(spark, [(4, a, "es"), (2, b, " ES.")]) == {(2, 2)}


@pytest.mark.parametrize("a,b", OTHER)
def test_other(spark, a, b):
    assert found(spark, [(1, a, "es"), (2, b, "es")]) == set()


def test_null_source_equals_only_null(spark):
    data = [(1, "x y", None), (2, "X  y", None), (3, "x y", ""), (4, None, "a"), (5, None, "a"), (6, "", "a"), (7, "…", "a")]
    assert found(spark, data) == {(1, 2), (4, 2), (6, 2)}


def test_hot_record_and_empty_table(spark):
    data = [(i, ["Hot record.", f"cold {i}"][i % 3 > 0], "es") for i in range(300)]
    assert found(spark, data) == {(0, 100)}
    all_rows = count_copies(rows(spark, data), "cand_id", ["content", "source"])
    assert all_rows.count() == 201 and all_rows.where("collided").count() == 0
    assert found(spark, []) == set()
