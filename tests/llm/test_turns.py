import pytest

from brightloom.llm.turns import speaker_turns

PEOPLE = "Mira Threlk (Backend), Osk Rosk ; Jorun Quarles"
CASES = {
    "clock": "[00:00:13] Mira Threlk: One.\n[00:00:20] [inaudible]\n[00:00:40] ROSK: Two\nand more.\n[00:00:30] @mira.threlk: Um, one again.\n[00:01:00] Osk R.: You know.\n[00:01:10] Jorun: Three.",
    "srt": "1\r\n00:00:13,000 --> 00:00:15,000\r\nThrelk, Mira: One.\r\n\r\n2\r\n00:00:30,000 --> 00:00:31,000\r\nM. Threlk: one again.\r\n\r\n3\r\n00:00:40,000 --> 00:00:41,000\r\nosk  rosk: Two and more.\r\n\r\n4\r\n00:01:10,000 --> 00:01:11,000\r\nQuarles: Three.",
    "vtt": "WEBVTT\n\n00:00:13.000 --> 00:00:15.000\n<v Mira Threlk [PM]>One.</v>\n\n00:00:16.000 --> 00:00:17.000\n♪ music ♪\n\n00:00:40.000 --> 00:00:41.000\n<v Osk>Two.</v>\n\n00:01:10.000 --> 00:01:11.000\n<v Jorun>Three.</v>",
    "block": "Mira  00:00:13\nOne.\n\nOsk Rosk  00:00:40\n*coughs* Two.\n\n00:00:50\n(crosstalk)\n\nJorun Quarles  00:01:10\nThree.",
    "bold": "**Mira Threlk** (0:13): One.\n**Rosk** (0:40): Two\nlines.\n(0:50) [laughter]\n**Jorun** (1:10): Three.",
    "dash": "(00:13) Mira — One.\n(00:40) Osk — Two.\n(00:45) Jorun — Hmm.\n(01:10) Jorun — Three.",
    "plain": "Mira: One.\n(crosstalk)\nOsk: Two.\nNote: the quota is 500.\nJorun Quarles: Three.",
}


def turns(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id int, t string, a string").selectExpr("*", "1 as speaker", "2 as __id", "3 as __no")
    out = speaker_turns(df, "id", "t", "a", **kw).orderBy("id", "turn_no").collect()
    return [(r["id"], r["turn_no"], r["speaker"], r["text"]) for r in out]


@pytest.mark.parametrize("layout", CASES)
def test_layouts(spark, layout):
    got = turns(spark, [(1, CASES[layout], PEOPLE)])
    assert [(n, s) for _, n, s, _ in got] == [(1, "Mira Threlk"), (2, "Osk Rosk"), (3, "Jorun Quarles")]
    assert got[2][3] == "Three." and "um" not in got[0][3].lower()


def test_chinese_names(spark):
    text = "亓老师：嗯，好。\n小樊：（笑声）第一句。\n樊 听澜(测试)：那个，第二句。\n客人：听见了。\n晏予墨 ：【掌声】完。\n晏：无人。"
    got = turns(spark, [(1, text, "亓犀（后端） , 樊听澜、晏予墨，晏棣")])
    assert [s for _, _, s, _ in got] == ["亓犀", "樊听澜", "客人", "晏予墨", "晏"]
    assert got[1][3] == "第一句。 第二句。"


def test_captions_that_roll(spark):
    cue = "{n}\n00:00:0{n},000 --> 00:00:0{n},900\nMira: {t}\n\n"
    text = cue.format(n=1, t="the quick brown fox jumps") + cue.format(n=2, t="brown fox jumps over the dog") + cue.format(n=3, t="and more")
    assert turns(spark, [(1, text, None)]) == [(1, 1, "Mira", "the quick brown fox jumps over the dog and more")]


def test_pauses(spark):
    text = "".join(f"[00:00:{s:02d}] Mira: Word {s}.\n" for s in (1, 3, 5, 7, 50, 52))
    assert len(turns(spark, [(1, text, None)])) == 1
    assert len(turns(spark, [(1, text, None)], pause_factor=3.0)) == 2


def test_edge_rows(spark):
    rows = [(1, None, None), (2, "", "A"), (3, "Um.", None), (None, "A: x", None), (4, "A: hi", ""), (4, "A: hi", ""), (5, "no speaker here at all", None)]
    assert turns(spark, rows) == [(4, 1, "A", "hi")]
    assert turns(spark, []) == []


def test_stamps_after_a_long_preamble(spark):
    preamble = "Meeting notes\nDate: 2025-01-06\nPlace: hall\nAgenda\n1. budget\n2. plans\n\n"
    text = preamble + "[00:01] Ann Lee: Hello there.\n[00:05] Bo Kim: We start now.\n[00:09] Ann Lee: Fine (00:03)."
    df = spark.createDataFrame([(1, text, "Ann Lee, Bo Kim")], "meeting_id bigint, meeting_transcript string, attendees string")
    got = speaker_turns(df, "meeting_id", "meeting_transcript", "attendees").orderBy("turn_no").collect()
    assert [(r["speaker"], r["start_s"]) for r in got] == [("Ann Lee", 1.0), ("Bo Kim", 5.0), ("Ann Lee", 9.0)]
