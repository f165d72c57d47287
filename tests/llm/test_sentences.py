import pytest

from brightloom.llm import sentences as S

CASES = [
    ["Dr. Rosk met L. V. Calloway of Bexley Ltd. at 4 p.m. ", "The ratio fell from 5.56 to 1.4."],
    ["Some inputs, e.g. the sheet, were merged.", "It needs v3.6.19 and docs.example.invalid/kb?p=18."],
    ['"Did the console finish?" asked Osk. ', 'Halli said, "It is ready. We can start now." ', "Next one."],
    ["The cache... well, it ranked. ", "Done… 🎉 ", "See No. 38 and Fig. 5.[9] ", "(All of it.) ", "End."],
    ["# A heading\n\n", "Text begins here and\nwraps. ", "More.\n\n", "- first item. With two\n", "2) second item\n", "- third"],
    ["谁丢弃了会议记录？", "（提示模板覆盖了它。）", "“索引任务好了吗？”卞栖迟问。", "邹棣说：“已经恢复。可以上线。”", "重排环节……好像压缩了。"],
    ["「もう終わりましたか。」と担当者が聞いた。", "比率は3.5%まで下がりました。"],
    ["ระบบกฎเก็บรายงาน ", "งานจัดทำดัชนีตรวจเอกสาร\n", "ระบบกฎข้ามส่วน"],
    ["高负载下审计日志处理了记录 ", "祝渡指出它已完成　", "结束了"],
    ["Dr. Threlk prüfte z. B. die Tabelle Nr. 7. ", "Am 3. März lag sie bei 4,5. ", "„Läuft er?“, fragte Elke."],
    ["« Est-ce terminé ? » demanda Sanne. ", "Voir l'art. 9 et la fig. 9. ", "Quelle surprise ! ", "M. Pavo a noté."],
    ["Нужны копии, т. е. дубли, за май. ", "«Готово?» — спросила Веста."],
    ["“끝났나요?” 하고 담당자가 물었다. ", "정말 곤란하다! ", "끝."],
    ["डॉ. राव आए। ", "क्या संस्करण 2.1 तैयार है?"],
    ["It ended.", "The next began."],
]


@pytest.fixture(scope="module")
def model():
    return S.train(["".join(c) for c in CASES] * 3), set()


@pytest.mark.parametrize("parts", CASES, ids=lambda p: p[0][:18])
def test_units(model, parts):
    text, want, at = "".join(parts), [], 0
    for p in parts:
        want.append(at)
        at += len(p)
    assert S.starts(text, *model) == want


def test_model_agrees_with_teacher_on_other_texts(model):
    text = "The pilot ran. It merged 57 of 30 records! Is it true?! Mr. Vale said so.\n\n1. one\n2. two\n\nLast."
    found = S.places(text, model[1])
    assert S.decode([s for _, s in found], model[0]) == [S.teach(s) for _, s in found]


def test_viterbi_equals_brute_force():
    import itertools

    signatures = [s for _, s in S.places("One. two Three. Four! five. Six", set())]
    weights = {("t", False, True, False): -0.3, ("t", True, True, False): 0.9, ("t", True, False, False): -0.2}
    weights |= {f: (hash(str(f)) % 100) / 50 - 1 for s in signatures for f in S.features(s)}

    def score(tags):
        last, total = False, 0.0
        for s, t in zip(signatures, tags):
            total += weights.get(("t", last, t, False), 0) + (sum(weights.get(f, 0) for f in S.features(s)) if t else 0)
            last = t
        return total

    best = max(itertools.product([False, True], repeat=len(signatures)), key=score)
    assert abs(score(S.decode(signatures, dict(weights))) - score(best)) < 1e-9


def test_operator(spark):
    rows = [(1, "﻿  First one. Second one."), (2, None), (3, ""), (4, " \n "), (5, "x" * 50_000 + ". Then."), (1, "﻿  First one. Second one.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as start_pos", "2 as u")
    got = sorted((r["doc_id"], r["sentence_no"], r["start_pos"]) for r in S.sentence_units(df, "doc_id", "text").collect())
    assert got == [(1, 1, 3), (1, 1, 3), (1, 2, 14), (1, 2, 14), (5, 1, 0), (5, 2, 50_002)]
    assert S.sentence_units(df.limit(0), "doc_id", "text").count() == 0


def test_marks_taken_out_are_the_tags():
    text = "索引任务压缩了切片。缓存已清空！\n“已经恢复。可以上线。”\n\n没有标点 的一段"
    bare, ends = S.unpunctuated(text)
    assert bare.startswith("索引任务压缩了切片 缓存已清空\n已经恢复 可以上线") and [bare[i : i + 2] for i in sorted(ends)] == ["缓存", "已经", "可以", "没有"]
    pairs = list(S.tagged(text, set()))
    assert len(pairs) == 2 and sum(pairs[1][1]) == 3  # the paragraph without marks is left out


def test_held_out_documents():
    subjects, verbs, objects = ["索引任务", "提示模板", "审计日志", "上传网关", "缓存"], ["压缩了", "覆盖了", "跳过了", "清空了"], ["会议记录", "报价单", "切片", "权限名单"]
    clauses = [a + b + c for a in subjects for b in verbs for c in objects]
    texts = ["".join(clauses[(i * 7 + j * 11) % 80] + "。！？"[(i + j) % 3] for j in range(6)) for i in range(60)]
    weights = S.train(texts[:40])
    for text in texts[40:]:
        for signatures, truth in S.tagged(text, set()):
            assert S.decode(signatures, weights) == truth


def test_abbreviations_are_counted_over_all_documents(spark):
    rows = [(i, f"It took approx. {i} days. Then it ended. See vol. two and so on.") for i in range(30)] + [(99, None), (98, "")]
    assert S.abbreviations(spark.createDataFrame(rows, "doc_id int, text string"), "text") == {"approx", "vol"}
    assert S.abbreviations(spark.createDataFrame([], "doc_id int, text string"), "text") == set()
