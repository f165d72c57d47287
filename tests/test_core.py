import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brightloom.functions import text as T
from brightloom.functions import vectors as V
from brightloom.operators import chunking, conversation, graph, meetings, retrieval, search, summary, tables
from brightloom.plans.registry import Entry, Registry, check_columns, pipeline, refine
from brightloom.runtime import ensure_checkpoint_dir, looked_up
from brightloom.sources import files
from brightloom.streaming import events as streams


def one(spark, expr, schema, *values):
    return spark.createDataFrame([values], schema).select(expr).first()[0]


@pytest.mark.parametrize("value,lines", [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n\n", 2)])
def test_line_count(spark, value, lines):
    assert one(spark, T.line_count(F.col("t")), "t string", value) == lines


def test_text_functions(spark):
    def f(expr, value):
        return one(spark, expr(F.col("t")), "t string", value)

    assert f(T.token_estimate, "你好 two words!") == int(1.5 * 2 + 1.3 * 2 + 0.5)
    assert [f(T.language, x) for x in ("你好吗好", "plain text", "Grüße", " ", None)] == ["zh", "en", "unknown", "unknown", "unknown"]
    assert f(T.keywords, "Index 索引任务 index a") == ["index", "索引", "引任", "任务"]
    assert f(T.citations, "x [3] [1-2][9] [4,5] [1-99]") == [1, 2, 3, 4, 5, 9, 99]
    assert f(T.normalise, "Ａ\r\nb​﻿") == "A\nb"
    assert f(T.strip_html, "<p>a <b>b</b></p>\n c") == "a b c"
    assert f(T.strip_markdown, "# H\n\n- a **b** [c](d)\n") == "H\na b c"
    assert f(T.slug, "..a b/c?.txt") == "a_b_c_.txt"
    assert f(T.sentences, "One two. 三四五六。 x\nlast line") == ["One two.", "三四五六。", "last line"]


def test_more_text_functions(spark):
    df = spark.createDataFrame([("abcdef", "xxabcde"), ("ab", "ab"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(T.gram_coverage(F.col("a"), F.col("b"))).collect()] == [pytest.approx(2 / 3), 0.0, None]
    names = spark.createDataFrame([("kb_1",), ("_kb",), ("ab",), (None,), ("a" * 64,)], "n string")
    assert [r[0] for r in names.select(T.is_namespace(F.col("n"))).collect()] == [True, False, False, False, False]
    numbers = spark.createDataFrame([(1994,), (3999,), (0,), (4,)], "n int")
    assert [r[0] for r in numbers.select(T.roman(F.col("n"))).collect()] == ["MCMXCIV", "MMMCMXCIX", None, "IV"]
    e = spark.createDataFrame([("rule engine 索引",), ("索引 ENGINE, rule!",), ("",), (None,)], "t string").select(V.hashed_embedding(F.col("t"), 16)).collect()
    assert e[0][0] == e[1][0] and abs(sum(x * x for x in e[0][0]) - 1) < 1e-9 and set(e[2][0]) == {0.0} and e[3][0] is None


def test_jaccard(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (None, ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 0.0, None]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(V.norm(F.col("a")), V.cosine(F.col("a"), F.col("b")), V.euclidean_similarity(F.col("a"), F.col("b")), V.is_zero(F.col("a")), V.unit(F.col("a"))).collect()
    assert tuple(got[0][:4]) == (5.0, 0.96, pytest.approx(1 / (1 + math.sqrt(2))), False) and got[1][1] == 0.0 and got[1][3]
    assert got[0][4] == [0.6, 0.8] and got[1][4] == [0.0, 0.0]


@pytest.mark.parametrize("metric,block", [("cosine", 4096), ("dot", 4096), ("euclidean", 4096), ("cosine", 2), ("dot", 1)])
def test_top_k_equals_brute_force(spark, metric, block, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "ROWS", 32_768 if block > 2 else 13)
    rng = np.random.default_rng(42)
    x = rng.normal(size=(60, 8)).round(1)
    x[9] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(98, None), (99, [1.0])], "id int, v array<double>")
    q = df.where("id % 20 = 0").selectExpr("id as query_id", "v as query_vector")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in search.top_k(df, "id", "v", q, 5, metric).collect()}
    for a in (0, 20, 40):
        s = search._scores(x[a : a + 1], x, metric)[0].round(9)
        for rank, i in enumerate(sorted(range(60), key=lambda i: (-s[i], i))[:5], 1):
            assert got[a, rank] == (i, pytest.approx(s[i]))
    assert search.top_k(df, "id", "v", q.limit(0), 5).count() == 0 and search.top_k(df.limit(0), "id", "v", q, 5).count() == 0


def test_dedup_hits_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, " a ", 0.5), (2, "a", 0.9), (3, "a", 0.9), (4, "b", None), (5, None, 0.1), (6, None, 0.2)], "id int, t string, s double")
    assert sorted(r["id"] for r in search.dedup_hits(df, "t", "s", "id").collect()) == [2, 4, 6]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab .\n。", max_size=200), min_size=1, max_size=40), st.integers(5, 40))
def test_recursive_split_loses_nothing_visible(spark, texts, size):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = df.select("id", chunking.recursive_pieces(F.col("t"), size, chunking.SEPARATORS["text"])).collect()
    for i, got in rows:
        assert all(len(c) <= size for c in got)
        # only separators between chunks go
        assert "".join(c for c in "".join(got) if c in "ab") == "".join(c for c in texts[i] if c in "ab")


def test_recursive_split_takes_the_strongest_separator_that_fits(spark):
    text = "Alpha beta. Gamma delta.\n\nOne two three. Four five.\n\n" + "x" * 45 + "\n\nEnd."
    df = spark.createDataFrame([(1, text), (2, "short one"), (3, " \n "), (4, None), (5, "")], "id int, t string")
    got = {r["id"]: r["p"] for r in df.select("id", chunking.recursive_pieces(F.col("t"), 30, chunking.SEPARATORS["text"]).alias("p")).collect()}
    assert got == {1: ["Alpha beta. Gamma delta.", "One two three. Four five.", "x" * 30, "x" * 15, "End."], 2: ["short one"], 3: [], 4: [], 5: []}
    merged = chunking.recursive_chunks(df, "id", "t", 30, 16).where("id = 1").orderBy("chunk_index").collect()
    assert [r["chunk"] for r in merged] == ["Alpha beta. Gamma delta.", "One two three. Four five.", "x" * 30 + "\n" + "x" * 15 + "\nEnd."]


def test_chunks(spark):
    text = "First one. Second one.\n\nThird " + "x" * 40
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, t string")
    fixed = chunking.fixed_chunks(df, "id", "t", 20, 5).orderBy("chunk_index").collect()
    assert "".join(r["chunk"][5 if r["chunk_index"] else 0 :] for r in fixed) == text and [r["start_pos"] for r in fixed] == [15 * i for i in range(len(fixed))]
    assert [r["chunk"] for r in chunking.paragraph_chunks(df, "id", "t").collect()] == ["First one. Second one.", "Third " + "x" * 40]
    c = chunking.with_context(chunking.sentence_chunks(df, "id", "t"), "id").orderBy("chunk_index").collect()
    assert c[1]["context_prefix"] == "First one." and c[1]["context_suffix"].startswith("Third")
    s = chunking.chunk_stats(chunking.fixed_chunks(df, "id", "t", 20, 5), "id").first()
    assert (s["n_chunks"], s["max_chars"], s["min_chars"]) == (len(fixed), 20, len(fixed[-1]["chunk"]))
    assert chunking.recursive_chunks(df, "id", "t", 30).count() >= 2
    with pytest.raises(ValueError):
        chunking.fixed_chunks(df, "id", "t", 5, 5)


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k int, v string")
    assert sorted(tables.upsert(old, new, ["k"]).collect(), key=str) == sorted([(1, "a"), (None, "n"), (2, "B"), (3, "C"), (None, "N")], key=str)
    assert {r["k"] for r in tables.delete(old, new, ["k"]).collect()} == {1, None}
    changed = tables.updated(old, F.col("k") == 1, {"v": F.lit("z"), "k": F.lit(9)}, {"v"}).collect()
    assert ("z" in {r["v"] for r in changed}) and 9 not in {r["k"] for r in changed}
    assert [r["k"] for r in tables.page(old.where("k is not null"), [F.desc("k")], 1, 1).collect()] == [1]
    assert tables.group_copies(spark.createDataFrame([(1, "a "), (2, "a"), (3, None), (4, None)], "i int, t string"), "t", "i").count() == 2


def test_profile(spark):
    df = spark.createDataFrame([("1", "2024-01-02", "x", None), ("2", "2024-02-03", "1.5", "n/a"), ("x", "2024-03-04", "2", ""), ("4", None, "7", "NULL"), ("5", "2024-05-06", "y", None), ("6", "", "3", None)], "a string, b string, c string, d string")
    got = {r["column"]: (r["dtype"], r["null_count"]) for r in tables.profile(df, df.columns).collect()}
    assert got == {"a": ("integer", 0), "b": ("datetime", 2), "c": ("mixed_numeric_string", 0), "d": ("empty_or_null", 6)}


def test_streaks_and_breaker_agree(spark, tmp_path):
    random.seed(1)
    rows = [(f"k{i % 3}", i, random.random() < 0.7) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, seq int, bad boolean")
    runs = tables.streaks(df, "key", "seq", F.col("bad"), stretches=7)
    want, run = [], {}
    for k, i, bad in [*rows, *[(f"k{j}", 999 + j, False) for j in range(3)]]:
        if bad:
            run.setdefault(k, []).append(i)
        elif run.get(k):
            want.append((k, len(run[k]), run[k][0]))
            run[k] = []
    assert sorted(map(tuple, runs.collect())) == sorted(want)
    runs = runs.where("n_failures >= 5").groupBy("key").count()
    df.coalesce(1).write.parquet(str(tmp_path / "outcomes"))
    stream = streams.stream_table(spark, str(tmp_path / "outcomes"))
    out = streams.breaker_states(stream, "key", "bad")
    query = out.writeStream.outputMode("update").format("memory").queryName("opened").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["key"]: r["n_opened"] for r in spark.table("opened").collect() if r["n_opened"]}
    assert got == {r["key"]: r["count"] for r in runs.collect()}


@pytest.mark.parametrize("most", [10_000, 2])
def test_contains_names(spark, most):
    docs = spark.createDataFrame([(1, "the old archive of rules"), (2, "nothing"), (3, None), (4, "")], "id int, t string")
    names = spark.createDataFrame([("old archive",), ("of",), ("rules",), ("archives",), (None,), ("",)], "n string")
    assert {(r["id"], r["n"]) for r in tables.contains_names(docs, "t", names, "n", most).collect()} == {(1, "old archive"), (1, "of"), (1, "rules")}


def test_trend(spark):
    df = spark.createDataFrame([(f"d{i}", v) for i, v in enumerate([10.0, 20.0, 0.0, 5.0, 9.0, 30.0])], "day string, v double")
    got = tables.trend(df, "day", "v").orderBy("day").collect()
    assert [r["change_pct"] for r in got] == [0.0, 100.0, -100.0, 0.0, 80.0, 233.33] and [r["trend"] for r in got[-2:]] == ["down", "up"]


def test_budget_equals_brute_force(spark):
    random.seed(4)
    rows = [(q, i, "w " * random.randint(1, 60), random.choice([None, 0.1, 0.5, 0.9])) for i in range(120) for q in [i % 4]]
    df = spark.createDataFrame(rows, "q int, id int, c string, s double")
    got = {r["q"]: r["chosen"] for r in retrieval.within_budget(df, "q", "c", "s", "id", 4, 80, 30).collect()}
    for q in range(4):
        left, chosen = 80, []
        for _, i, c, s in sorted([r for r in rows if r[0] == q], key=lambda r: (-(r[3] if r[3] is not None else -1), r[1]))[:30]:
            tokens = int(1.3 * len(c.split()))
            if not chosen or (len(chosen) < 4 and tokens <= left):
                chosen.append(i)
                left = max(0, left - tokens)
        assert got[q] == chosen


def test_budget_considers_all_candidates(spark):
    random.seed(9)
    rows = [(i % 2, i, "w " * random.choice([5, 9, 40, 70, 100]), random.choice([0.1, 0.5, 0.9, None])) for i in range(900)]
    rows += [(2, 2000 + i, "w " * 30, 0.9) for i in range(40)] + [(2, 3000, "w", 0.1), (3, 4000, None, None), (4, 5000, "w " * 500, 0.5), (4, 5001, "", 0.4)]
    df = spark.createDataFrame(rows, "q int, id int, c string, s double")
    got = {r["q"]: r["chosen"] for r in retrieval.within_budget(df, "q", "c", "s", "id", 4, 80).collect()}
    for q in range(5):
        left, chosen = 80, []
        for _, i, c, s in sorted([r for r in rows if r[0] == q], key=lambda r: (-(r[3] if r[3] is not None else -1), r[1])):
            tokens = int(1.3 * len((c or "").split()))
            if not chosen or (len(chosen) < 4 and tokens <= left):
                chosen.append(i)
                left = max(0, left - tokens)
        assert got[q] == chosen
    assert 3000 in got[2]  # the forty-first of its query


def test_cache_split(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, k string")
    cache = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert {r["i"]: r["is_cached"] for r in tables.cache_split(df, "k", cache).collect()} == {1: True, 2: False, 3: False}


def test_rerank_cut_fills_up(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.1, 0.9, None, 0.2, 0.3])], "q int, id int, s double")
    assert [r["id"] for r in retrieval.rerank_cut(df, "q", "s", "id", 4).orderBy("place").collect()] == [1, 4, 3, 0]


def test_confidence(spark):
    df = spark.createDataFrame([(0.8, 4, 2, 2, "a" * 120), (None, 0, 0, 0, "I cannot answer")], "top double, used int, grounded int, cited int, a string")
    got = [r[0] for r in df.select(retrieval.confidence(*[F.col(c) for c in df.columns])).collect()]
    assert got == [round((0.8 + 0.5 + 0.85 + 0.9 + 0.7) / 5, 2), round((0.05 + 0.05 + 0.15 + 0.1 + 0.2) / 5, 2)]


def test_conversation(spark):
    rows = [("s", f"m{i}", "user" if i % 2 else "assistant", f"message number {i}", i) for i in range(9)]
    df = spark.createDataFrame(rows, "s string, id string, role string, c string, at int")
    assert [r["id"] for r in conversation.last_messages(df, "s", "at", "id", 2).orderBy("place").collect()] == ["m8", "m7"]
    assert conversation.summary_due(df, "s", 4).first()["n_summaries"] == 2 and conversation.summary_due(df, "s", 10).count() == 0
    assert conversation.fallback_summary(df, "s", "role", "c", "at", "id", 5, 5).first()["summary"] == "message number 5; message number 7"
    assert one(spark, conversation.needs_rewrite(F.col("q"), F.lit(False)), "q string", "那个呢") and not one(spark, conversation.needs_rewrite(F.col("q"), F.lit(False)), "q string", "plain words")


def test_components_equal_brute_force(spark):
    random.seed(7)
    edges = [(f"n{random.randint(0, 80)}", f"n{random.randint(0, 80)}") for _ in range(45)] + [(f"p{i}", f"p{i + 1}") for i in range(30)] + [(None, "x"), ("y", None)]
    parent = {}

    def root(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "source string, target string")).collect()}
    groups = {}
    for n in parent:
        groups.setdefault(root(n), []).append(n)
    assert got == {n: min(g) for g in groups.values() for n in g}


def test_a_hub_and_a_giant_component(spark):
    edges = [("hub", f"n{i:04d}") for i in range(3000)] + [(f"n{i:04d}", f"o{i:04d}") for i in range(3000)]
    got = graph.components(spark.createDataFrame(edges, "source string, target string"))
    assert got.count() == 6001 and got.select("component").distinct().collect() == [("hub",)]
    chain = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60)], "source string, target string")
    with pytest.raises(RuntimeError):
        graph.components(chain, rounds=1)


def test_looked_up_with_hot_missing_and_null_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else "lost" if i % 3 == 1 else None if i % 2 else f"k{i}") for i in range(600)], "i int, k string")
    unique = spark.createDataFrame([("hot", 1), ("k2", 2), ("other", 3)], "k string, v int")
    got = looked_up(rows, "k", unique, 10)
    want = {(r["i"], r["k"], r["v"]) for r in rows.join(unique, "k", "left").collect()}
    assert {(r["i"], r["k"], r["v"]) for r in got.collect()} == want and got.count() == 600


def test_no_folder_of_one_machine_on_a_cluster():
    class Context:
        master = "yarn"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()
        getConf = lambda self: {}

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(type("Session", (), {"sparkContext": Context(), "conf": {}})())


def test_graph(spark):
    units = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, "c"), (2, "b"), (2, "a"), (3, "z"), (None, "q")], "u int, e string")
    assert {tuple(r) for r in graph.co_occurrence(units, "u", "e").collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}
    assert graph.components(graph.co_occurrence(units, "u", "e", 2)).select("component").distinct().count() == 1
    edges = spark.createDataFrame([("a", "b"), ("c", "d"), ("d", "a")], "source string, target string")
    assert graph.neighbourhood(edges, spark.createDataFrame([("a",), ("a",)], "n string"), "n").count() == 2


def test_large_units_give_all_their_pairs(spark):
    rows = [("big", f"e{i:03d}") for i in range(90)] + [("small", f"e{i:03d}") for i in (3, 40, 77)] + [("other", f"e{i:03d}") for i in range(80, 110)] + [("big", "e003"), ("big", None), (None, "e001")]
    got = {(r["source"], r["target"]): r["weight"] for r in graph.co_occurrence(spark.createDataFrame(rows, "u string, e string"), "u", "e", 7).collect()}
    held = {}
    for u, e in set(rows):
        if u and e:
            held.setdefault(u, []).append(e)
    assert got == Counter((a, b) for es in held.values() for a in es for b in es if a < b)


def test_summary(spark):
    texts = ["The key finding is that load fell by 40 percent in March.", "A filler line stands here.", "The key finding is that load fell by 40 percent in March again.", "Costs rose in all other regions.", "End of the text is near."]
    assert summary.ranked_sentences(texts, 3) == sorted(set(summary.ranked_sentences(texts, 3))) and not {0, 2} <= set(summary.ranked_sentences(texts, 3))
    df = spark.createDataFrame([(1, " ".join(texts)), (2, None), (3, "")], "id int, t string")
    best = summary.heuristic_summary(df, "id", "t").orderBy("sentence_no").collect()
    assert [r["sentence_no"] for r in best][:1] == [0] and len(best) == 3 and best[0]["score"] == 3 * 2 + 2 + 1 + 1.5 + 2
    assert summary.ranked_summary(df, "id", "t", most=2).count() >= 2
    assert summary.ranked_summary(df, "id", "t", by="terms").count() >= 2


def test_terms_equal_a_dense_matrix():
    texts = ["The cat sat on the mat.", "The cat sat there.", "A dog, a cat.", "...", "the mat the cat"]
    graph = summary._Terms(texts)
    terms = [[*w, *map(" ".join, zip(w, w[1:]))] for w in (re.findall("[a-z]+", t.lower()) for t in texts)]
    names = sorted({x for t in terms for x in t})
    held = np.array([sum(n in t for t in terms) for n in names])
    x = np.array([[t.count(n) for n in names] for t in terms]) * (np.log((1 + len(texts)) / (1 + held)) + 1)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    sim = x @ x.T
    np.fill_diagonal(sim, 0)
    y = np.array([1.0, -2.0, 0.5, 3.0, 1.5])
    assert np.allclose(graph.times(y), sim @ y) and all(np.allclose(graph.row(i), sim[i]) for i in range(5))
    degree = sim.sum(axis=1)
    degree[degree == 0] = 1
    walk = np.linalg.solve(np.eye(5) - 0.85 * sim / degree, np.full(5, 0.03))
    assert np.allclose(summary._walk_scores(graph, 0.85), walk)
    assert summary.ranked_sentences(["..."], 3, by="terms") == [0] and summary.ranked_sentences([], 3, by="terms") == []


def plainly_ranked(texts, n):
    """One dense graph of all sentences."""
    sets = [set(re.findall(r"[a-z]+", t.lower())) for t in texts]
    sim = np.array([[len(a & b) / len(a | b) if i != j and a | b else 0.0 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    step, rank = sim / (sim.sum(axis=1, keepdims=True) + 1e-12), np.full(len(texts), 1 / len(texts))
    for _ in range(50):
        old, rank = rank, 0.15 / len(texts) + 0.85 * step.T @ rank
        if np.abs(rank - old).max() < 1e-6:
            break
    rank = np.round(rank, 12)
    chosen = [int(np.argmax(rank))]
    while len(chosen) < n:
        closest = sim[:, chosen].max(axis=1)
        worth = np.where(closest >= 0.75, -np.inf, 0.7 * rank - 0.3 * closest)
        worth[chosen] = -np.inf
        if not np.isfinite(worth.max()):
            break
        chosen.append(int(np.argmax(worth)))
    return sorted(chosen)


def test_long_texts_are_ranked_whole(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    texts = [" ".join(["The", *rng.choice(words, rng.integers(4, 16))]).capitalize() + "." for _ in range(450)]
    texts[440] = texts[20]  # the same sentence in what was another part
    want = plainly_ranked(texts, 148)
    assert summary.ranked_sentences(texts, 148) == want and not {20, 440} <= set(want)
    got = summary.ranked_summary(spark.createDataFrame([(1, " ".join(texts))], "id int, t string"), "id", "t").collect()
    assert sorted(r["sentence_no"] for r in got) == want and {r["sentence"] for r in got} <= set(texts)
    monkeypatch.setattr(summary, "CELLS", 5000)  # nothing is kept, and blocks are a few rows
    assert summary.ranked_sentences(texts, 148) == want and summary.ranked_sentences([], 3) == []


def test_meetings(spark):
    df = spark.createDataFrame([(1, "我们决定明天上线\n  \nnothing here\nTopic: maybe later by Friday")], "id int, t string")
    got = meetings.marked_lines(df, "id", "t").orderBy("line_no").collect()
    assert [(r["is_decision"], r["deadline"], r["priority"]) for r in got] == [(True, "明天", "high"), (False, "Friday", "low")]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿One\ntwo".encode())
    (tmp_path / "b.md").write_bytes("中文内容在此".encode("gbk"))
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "d.log").write_bytes(b"a\x00b")
    (tmp_path / "e.txt").write_bytes(b"y" * 500)
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.load_documents(spark, str(tmp_path), 100).collect()}
    assert (got["a.txt"]["content"], got["a.txt"]["line_count"], got["a.txt"]["encoding_used"]) == ("One\ntwo", 2, "utf-8")
    assert (got["b.md"]["content"], got["b.md"]["encoding_used"], got["b.md"]["file_type"]) == ("中文内容在此", "gbk", "markdown")
    assert [got[n]["error"] for n in ("c.exe", "d.log", "e.txt")] == ["unsupported file type", "not a text file", "file too large"]
    assert all(got[n]["content"] is None for n in ("c.exe", "d.log", "e.txt"))


def test_payloads(spark):
    assert one(spark, files.jsonp_body(F.col("t")), "t string", 'cb({"a": 1});') == '{"a": 1}'
    links = one(spark, files.html_links(F.col("t")), "t string", '<h3><a class="x" href="/u">A <b>b</b></a></h3>')
    assert [tuple(r) for r in links] == [("/u", "A b")]
    quotes = one(spark, files.quote_fields(F.col("t")), "t string", 'var hq_str_sh600000="n,1.5,2";\nvar hq_str_sz1="";')
    assert [(r["code"], r["fields"]) for r in quotes] == [("sh600000", ["n", "1.5", "2"]), ("sz1", [""])]
    got = one(spark, files.sse_events(F.col("t")), "t string", "id: 3\r\nevent: done\r\ndata: a\r\ndata: b\r\n\r\ndata: c\r\n")
    assert [tuple(r) for r in got] == [("3", "done", "a\nb"), (None, "message", "c")]
    assert one(spark, files.key_value_pairs(F.col("t")), "t string", "姓名：张三，年龄: 30; 姓名：李四") == {"姓名": "张三", "年龄": "30"}


def test_table_evolution_and_log(spark, tmp_path):
    path = str(tmp_path / "m")
    files.append(spark.createDataFrame([(1, "a")], "id int, k string"), path, ["k"])
    files.append(spark.createDataFrame([(2, "b", 0.5)], "id int, k string, v double"), path, ["k"])
    got = {r["id"]: (r["v"], r["w"]) for r in files.read_table(spark, path, {"id": "int", "v": "double", "w": "string"}).collect()}
    assert got == {1: (None, None), 2: (0.5, None)}
    rec = json.loads(files.log_records(spark.createDataFrame([(1, "a", "m")], "id int, k string, msg string"), "INFO", "call", "msg", ["k"], ["id"]).first()[0])
    assert rec == {"level": "INFO", "event": "call", "message": "m", "context": {"k": "a"}, "data": {"id": 1}}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 24:02d}:15:00", i % 3, ["x", "y"][i % 2], float(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, at string, u int, kind string, v double").withColumn("ts", F.col("at").cast("timestamp_ntz")).drop("at")
    df.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = streams.stream_table(spark, str(tmp_path / "e"), 1)
    batch = streams.windowed(df, "ts", "kind", "v", "2 hours", "1 hour")
    assert sorted(streams.final_state(streams.windowed(stream, "ts", "kind", "v", "2 hours", "1 hour", "30 days")).collect()) == sorted(batch.collect())
    assert streams.run_to_table(streams.once(stream, "ts", "u", "30 days")).count() == 3
    fired = streams.run_to_table(streams.summary_triggers(stream.withColumn("s", F.col("kind")), "s", 10))
    assert sorted((r["s"], r["trigger_no"]) for r in fired.collect()) == [(k, n) for k in "xy" for n in (1, 2, 3, 4)]


def test_registry_pipeline_and_loop(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    r = Registry()
    r.register(Entry("double", lambda d: d.withColumn("a", F.col("a") * 2), "twice the value", ["times two"], {"a": "int"}))
    r.register(Entry("drop", lambda d, n: d.limit(n), "first rows"))
    assert r.names() == ["double", "drop"] and r.search("please make it times two") == ["double"] and r.call("drop", df, n=1).count() == 1
    with pytest.raises(TypeError):
        r.call("double", df.withColumn("a", F.lit("x")))
    with pytest.raises(ValueError):
        r.register(Entry("drop", lambda d: d))
    check_columns(df, {"a": "int"})
    assert [x[0] for x in pipeline(lambda d: d.where("a > 1"), lambda d: d.withColumn("a", F.col("a") + 1))(df).collect()] == [3]
    out, scores = refine(df, lambda d: d.withColumn("a", F.col("a") * 2), lambda d: d.agg(F.avg("a")).first()[0] / 10, enough=0.5, most=5)
    assert scores == [0.15, 0.3, 0.6] and out.agg(F.sum("a")).first()[0] == 12
