import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brightloom.llm.leakage import Patterns, leaked_passages

ITEM = "Contract Jizesk obliges Trihayaend to answer Braehum callers within 85 minutes. Neither Niagor nor Krizebril kept the Louskial keys."
ITEMS = [(1, ITEM), (2, "按杼霁章程，小组须在4分钟内回复岑鹤眠的2842封来信。岑砚秋把9832份砚屿图纸移交库房，另有75份留在东楼。"), (3, None), (4, ""), (5, "tiny12345"), (6, "!?")]


def leaks(spark, docs, items=ITEMS, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' as doc", "'y' as folded", "1 as item_id")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]) for r in leaked_passages(d, i, **kw).collect()}


def test_planted(spark):
    half = ITEM[: len(ITEM) * 11 // 20]
    docs = [
        (1, "Before. " + ITEM.upper().replace(" ", "\n") + " After."), (2, "x " + half + " y"), (3, ITEM.replace("answer", "northern")), (4, "Contract A obliges B to answer"),
        (5, None), (6, ""), (7, "前文。" + ITEMS[1][1].replace("，", " , ") + "后文。"), (8, "z" * 5000 + ITEM + "z" * 5000 + ITEMS[1][1]), (9, "it says TINY-12345 here"),
    ]
    assert leaks(spark, docs) == {(1, 1), (2, 1), (3, 1), (7, 2), (8, 1), (8, 2), (9, 5)}
    assert leaks(spark, docs, block_bytes=64) == leaks(spark, docs)


@pytest.mark.parametrize("n", [1, 4, 40, 4000])
def test_a_text_under_many_ids_gives_all_of_them(spark, n):
    items = [(k, ITEM if k % 2 else ITEM.upper().replace(" ", "  ")) for k in range(n)]
    for block_bytes in (64, 4_000_000):
        assert leaks(spark, [(1, "x " + ITEM + " y"), (2, "other")], items, block_bytes=block_bytes) == {(1, k) for k in range(n)}


def test_variants_of_one_text_are_all_found(spark):
    names = ["Braehum", "Kalmost", "Verring", "Ollinda", "Tessamy", "Quorvan", "Hulbert", "Jannick"]
    items = [(k, ITEM.replace("Braehum", name)) for k, name in enumerate(names)]
    assert leaks(spark, [(1, ITEM)], items) == {(1, k) for k in range(len(names))}
    for rare in (1, 3, 100):
        assert leaks(spark, [(1, ITEM)], items, block_bytes=64, batch_bytes=1, rare=rare) == {(1, k) for k in range(len(names))}


def test_half_in_a_part_that_other_items_share(spark):
    tails = ["Neither Niagor nor Krizebril kept the Louskial keys.", "Some forty crates stood open near the eastern gate.", "Nobody asked who had paid for the new signal lamps.", "A clerk wrote the whole matter down in green ink."]
    head = "Contract Jizesk obliges Trihayaend to answer Braehum callers within 85 minutes of each call. "
    others = [(k + 10, f"Passage {k} of another book {k * k} speaks about quite other {'x' * k} matters.") for k in range(40)]
    assert leaks(spark, [(1, head)], [*enumerate(head + t for t in tails), *others]) == {(1, k) for k in range(4)}


def test_style_is_no_leak(spark):
    style = [(k, f"Every {n} log older than {k} days goes to the great hall, where {n} folders are kept for {n[::-1]}.") for k, n in enumerate(["Abcdef", "Ghijkl", "Mnopqr", "Stuvwx", "Yzabcd"])]
    assert leaks(spark, [(1, "Every Zzzzzz log older than 9 days goes to the great hall, where Zzzzzz folders are kept for Zzzzzz.")], style) == set()


def test_empty_tables(spark):
    assert leaks(spark, []) == set() and leaks(spark, [(1, ITEM)], []) == set()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=6, max_size=14), min_size=1, max_size=5), st.lists(st.text("abc", max_size=60), min_size=1, max_size=6))
def test_search_equals_brute_force(items, texts):
    m = 5
    items = list(dict.fromkeys(items))
    p = Patterns([x.encode() for x in items], m)
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    end = np.cumsum([len(t) for t in texts]).astype(np.int64)
    begin = end - np.array([len(t) for t in texts])
    where, window = p.occurrences(data, begin, end)
    got = {(int(w), int(p.item[k]), int(p.offset[k])) for w, k in zip(where, window)}
    want = {
        (int(b) + i, j, o) for b, t in zip(begin, texts) for i in range(len(t) - m + 1) for j, x in enumerate(items) for o in range(len(x) - m + 1) if t[i : i + m] == x[o : o + m]
    }
    assert got == want
