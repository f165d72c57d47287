import pytest

from brightloom.llm import pairs as P

Q = {"en": "What happens to the quarterly figures when the rule engine restarts?", "zh": "季度数字由谁负责？", "de": "Warum meldete das Handbuch einen Engpass im Pilotbetrieb?"}
A = {
    "en": ["The rule engine merged the figures under heavy load. The cache was dropped after the rollback.", "For the figures there is one rule: the engine waits 9 minutes and then goes on.\n- the figures\n- the minutes", "Sorry for the slow reply. The engine kept them.[2]"],
    "zh": ["季度数字由甄棣负责，审计日志只读取其中20条。索引任务校验了会议记录。", "普通成员无法直接操作，管理员可以。规则引擎压缩了切片。", "规则引擎先等待9分钟，再处理发布清单。\n```\nkbctl status\n```"],
    "de": ["Das Handbuch meldete einen Engpass seit der Umstellung. Der Dienst lief mit hoher Last.", "Der Suchdienst ersetzte das Glossar ohne Rückfrage und die Auswertung lief."],
}
CASES = [
    (Q["en"], "", "empty"), (Q["en"], None, "empty"), (Q["en"], " \n​", "empty"), (Q["en"], "<p></p>", "empty"), (Q["zh"], "（空）", "empty"), (Q["en"], "N/A", "empty"), (Q["en"], "```\n```", "empty"),
    (Q["en"], "The rule engine merged the figures. The cache was dropp", "truncated"), (Q["zh"], "审计日志校验了会议记录。索引任务因为", "truncated"), (Q["en"], "It kept them all.\n1. the figures\n2.", "truncated"),
    (Q["en"], 'The engine kept them.\n{"step": 1, "target": "the qu', "truncated"), (Q["en"], "The engine kept them.\n```python\nfor row in rows:\n    total = total + int(", "truncated"),
    (Q["en"], "I'm sorry, but I am not able to answer this question. Please contact your administrator.", "refusal"), (Q["zh"], "很遗憾，这个问题我不便作答。您可以换个话题再问。", "refusal"),
    (Q["en"], Q["en"].upper(), "copied"), (Q["zh"], f"“{Q['zh']}”", "copied"), (Q["zh"], f"您的问题是：{Q['zh']}", "copied"),
    (Q["en"], A["zh"][0], "other_language"), (Q["zh"], A["de"][0], "other_language"), (Q["en"] + " Please answer in German.", A["en"][0], "other_language"),
    (Q["en"] + " Please answer in German.", A["de"][0], None), (Q["zh"] + "请用英文回答。", A["en"][1], None), (Q["en"], "42", None), (Q["zh"], "共37条", None), (Q["en"], "No", None),
    (Q["en"], A["en"][1], None), (Q["en"], A["en"][2], None), (Q["zh"], A["zh"][1], None), (Q["zh"], A["zh"][2], None), (Q["en"], Q["en"] + " " + A["en"][0], None), (Q["en"], A["en"][0] + " https://docs.example.invalid/kb/1", None),
]


def training():
    out = []
    for i in range(160):
        lang = ["en", "zh", "de"][i % 3]
        out.append((Q[lang], A[lang][i // 3 % len(A[lang])]))
        if i % 8 == 0:
            out.append((Q["en"], "I cannot help with that request. Feel free to ask me something else!"))
            out.append((Q["zh"], "抱歉，我无法回答这个问题，请联系管理员。"))
            out.append((Q["zh"], ["是", "不需要", "共37条"][i % 3]))
    return out


@pytest.fixture(scope="module")
def field():
    return P.train(training())


@pytest.mark.parametrize("query,content,defect", CASES, ids=lambda x: str(x)[:24])
def test_defects(field, query, content, defect):
    assert P.coverage(field, query, content)[0] == defect


def test_gradient_fits_its_labels(field):
    pairs = P.with_made_defects([(q, c) for q, c in training() if not P._doubtful(q, c)])
    right = sum(field.tags(p) == p.labels() for p in pairs)
    assert right >= 0.97 * len(pairs)


def test_held_out_defects_are_found(field):
    """Made in other words, or at other places, than those trained on."""
    made = {
        "refusal": [(Q["en"], "Regrettably I cannot answer this one."), (Q["zh"], "对不起，这个请求我不能答复。"), (Q["en"], "No puedo contestar a esta pregunta.")],
        "copied": [(Q["de"], "Frage: " + Q["de"]), (Q["en"], Q["en"] + " " + Q["en"]), (Q["zh"], Q["zh"] * 2)],
        "truncated": [(Q["en"], A["en"][0][:-9]), (Q["zh"], A["zh"][1][:-4]), (Q["de"], A["de"][1][:-12])],
        "other_language": [(Q["de"], A["en"][0]), (Q["en"], A["de"][1]), (Q["zh"], A["en"][1])],
    }
    for defect, pairs in made.items():
        assert [P.coverage(field, q, c)[0] for q, c in pairs] == [defect] * len(pairs)


def test_long_responses_are_trained_on_in_stretches():
    long = P.Pair(Q["en"], " ".join(A["en"][0] for _ in range(100)), None)
    assert len(long.clauses) > 64 and P.Field.fit([long]).tags(long) == [P.ANSWER] * len(long.clauses)
    assert P.Field.fit([]).tags(P.Pair("a", "One. Two.")) == [0, 0]


def test_viterbi_equals_brute_force(field):
    import itertools

    p = P.Pair(Q["en"], "One thing is done. I cannot answer that. Das ist nicht so. And then the")
    emit = [v @ field.weights[f] for f, v in p.features]

    def score(tags):
        return sum(e[t] for e, t in zip(emit, tags)) + field.moves[len(P.LABELS)][tags[0]] + sum(field.moves[a][b] for a, b in zip(tags, tags[1:]))

    best = max(itertools.product(range(len(P.LABELS)), repeat=len(emit)), key=score)
    assert abs(score(tuple(field.tags(p))) - score(best)) < 1e-9


def test_operator(spark):
    rows = [(f"m{i}", q, c) for i, (q, c) in enumerate(training())] + [("e1", None, None), ("e2", None, "Some answer that is whole."), ("e3", "", "x. " * 5000), ("e1", None, None)]
    df = spark.createDataFrame(rows, "message_id string, query string, content string").selectExpr("*", "1 as id", "2 as q", "3 as defect")
    got = P.broken_pairs(df, "message_id", "query", "content").select("message_id", "defect").collect()
    assert [r["defect"] for r in got if r["message_id"] == "e1"] == ["empty", "empty"]
    assert not [r for r in got if r["message_id"] in ("e2", "e3")]
    assert P.broken_pairs(df, "message_id", "query", "content", only_broken=False).count() == len(rows)
    assert P.broken_pairs(df.limit(0), "message_id", "query", "content").count() == 0
