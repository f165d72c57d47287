import re
import time
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brightloom.llm.splitting import split_oversized

LIMIT, OVERLAP = 60, 10


def pieces(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").selectExpr("id", "text", "1 as piece", "2 as part")
    out = {}
    for r in split_oversized(df, "id", "text", LIMIT, OVERLAP).collect():
        out.setdefault(r["id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["piece_no"]) for k, v in out.items()}


def longest_run(text):
    edge = lambda c: c.isspace() or unicodedata.category(c)[0] in "PZ"
    return max((len(list(r)) for r in re.split("\x00", "".join("\x00" if edge(c) else c for c in text))), default=0)


def check(text, rows):
    assert [r["piece_no"] for r in rows] == list(range(rows[0]["piece_count"]))
    whole, at = "", 0
    for r in rows:
        assert len(r["piece"]) == r["n_chars"] <= LIMIT
        assert r["start_pos"] == at - r["overlap"]
        assert text[r["start_pos"] : r["start_pos"] + r["n_chars"]] == r["piece"]
        whole += r["piece"][r["overlap"] :]
        at = len(whole)
    assert whole == text
    assert any(r["cut"] == "forced" for r in rows) == (longest_run(text) > LIMIT)


TEXTS = [
    "One sentence here. " * 20,
    "a" * 61,
    "a" * 60 + " b",
    "x" * 500,
    "第一句话在这里。第二句话也在这里，逗号之后还有。" * 6,
    "line one\r\nline two\r\n" * 12,
    "para\n\n" * 30 + "z" * 80,
    "word " * 11 + "q" * 58 + " end",
    "😀" * 130,
]


def test_pieces(spark):
    got = pieces(spark, TEXTS)
    for i, text in enumerate(TEXTS):
        check(text, got[i])


def test_natural_boundaries(spark):
    cuts = [r["cut"] for r in pieces(spark, [TEXTS[0]])[0]]
    assert set(cuts[:-1]) == {"sentence"} and cuts[-1] == "end"


def test_within_the_limit_null_and_empty(spark):
    assert pieces(spark, ["short", "", None, "b" * LIMIT]) == {}
    with pytest.raises(ValueError):
        split_oversized(spark.createDataFrame([(1, "a")], "id int, text string"), "id", "text", 10, 9)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab 。,.\n\r中é́", min_size=61, max_size=400), min_size=1, max_size=12))
def test_any_text(spark, texts):
    got = pieces(spark, texts)
    for i, text in enumerate(texts):
        check(text, got[i])


def test_time_grows_with_the_size_of_an_item(spark, tmp_path):
    base = "One sentence stands here, and another follows it. 第一句话在这里，第二句也在。\n\n"
    taken = []
    for n in (100_000, 2_000_000, 4_000_000):
        spark.range(1).select("id", F.substring(F.repeat(F.lit(base), n // 60), 1, n).alias("text")).write.parquet(f"{tmp_path}/{n}")
        began = time.perf_counter()
        out = split_oversized(spark.read.parquet(f"{tmp_path}/{n}"), "id", "text").agg(F.sum(F.col("n_chars") - F.col("overlap")), F.max("n_chars")).first()
        taken.append(time.perf_counter() - began)
        assert out[0] == n and out[1] <= 1000
    assert taken[2] < 2 * taken[1] + 3


def test_starts_over_many_blocks(spark):
    text = "".join(f"{i:05d} " for i in range(3000))
    check(text, pieces(spark, [text])[0])
