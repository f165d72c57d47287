"""Problem 3: meeting transcripts into clean, ordered speaker turns.

The headers of a transcript's layout are marked and its entries split, cleaned and named after the attendee list
by built-in string and array functions. The entries of a meeting are then swept in order of their times, freed
of what a rolling caption repeats, and joined into turns; meetings are partitioned by id once, when repeated rows
are dropped, and everything after that stays in that partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions.text import let

TIME = r"(?:\d{1,3}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?"
NAME = r"@?[\p{L}][^\n:：，。！？!?；;“”\"<>\[\]*—]{0,40}(?:\[[^\]\n]{1,20}\])?"
# Words that open a remark as a name would; fixed values.
NOT_NAMES = [
    "note", "notes", "nb", "ps", "remark", "warning", "attention", "todo", "action", "decision", "summary", "agenda",
    "example", "question", "answer", "update", "important", "reminder", "result", "reason", "http", "https",
    "注", "注意", "备注", "附注", "说明", "提示", "提醒", "例如", "比如", "结论", "总之", "问题", "议题", "决定", "时间", "地点", "补充",
]
# Sounds and remarks of the transcriber that stand in round brackets; fixed values.
SOUNDS = (
    "笑|笑声|大笑|轻笑|停顿|掌声|鼓掌|杂音|噪音|听不清|不清楚|咳嗽|沉默|音乐|铃声|叹气|重叠|多人说话|"
    "laugh(?:s|ing|ter)?|applause|inaudible|unintelligible|unclear|pause|silence|music|noise|cough(?:s|ing)?|crosstalk|"
    "sigh(?:s|ing)?|door closes|door opens|phone rings|background noise|clears throat|overlapping"
)
LASTING = r"(?:[ \t]*(?:for )?\d+(?:\.\d+)?[ \t]*(?:s|sec|secs|seconds|min|秒|分钟)?)?"
ANNOTATION = (
    rf"(?i:\[\s*(?:{SOUNDS}){LASTING}\s*\])|"
    r"\[(?![^\]\n]*\d)[^\]\n]{1,40}\]|【[^】\n]{1,40}】|(?<!\*)\*(?!\*)[\p{L} ]{1,30}\*(?!\*)|[♪♫]+(?:[^♪♫\n]{0,60}[♪♫]+)?|<(?!/?v\b)/?[\p{L} ]{1,20}>"
    rf"|(?i:[（(]\s*(?:{SOUNDS}){LASTING}\s*[)）])"
)
# Fillers; fixed values.
FILLER_LATIN = r"(?i)(?=[uehmay])(?<![\p{L}\p{N}'-])(?:u+h*m+|u+h+|e+r+m*|h+m+|m+h+m*|ah+|you know)(?![\p{L}\p{N}'-])(?:\.{2,}|…|[,.])?[ \t]*"
FILLER_HAN = r"(?<=^|[，。！？；：…、\s])(?:嗯+|呃+|额+|唔+|哦+|啊+|那个|这个|就是说)(?:[…，。、.,]+|$)\s*"
# Titles that follow or precede a Chinese family name; fixed values.
TITLES = ["老师", "工", "总", "经理", "主任", "先生", "女士", "博士", "教授", "同学", "姐", "哥"]
FORENAMES = ["小", "老", "阿"]


def _text(transcript: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(transcript, r"\r\n?", "\n"), r"^\x{FEFF}", "")


def layout_of(text: Column) -> Column:
    """cue (captions), clock ([time] ...), bold (**name** (time)), dash ((time) name - ...), block, or plain.

    Lines of the whole transcript are looked at, however long what stands before the first entry; of square and round
    brackets around a time at the beginning of a line the more frequent decide.
    """
    square = F.regexp_count(text, F.lit(rf"(?m)^[ \t]*\[{TIME}\]"))
    round_ = F.regexp_count(text, F.lit(rf"(?m)^[ \t]*\({TIME}\)"))
    return (
        F.when(text.rlike(rf"(?m)^[ \t]*{TIME}[ \t]*-->[ \t]*{TIME}"), "cue")
        .when(text.rlike(rf"(?m)^\*\*[^\n*]+\*\*[ \t]*\({TIME}\)"), "bold")
        .when((square > 0) & (square >= round_), "clock")
        .when(round_ > 0, "dash")
        .when(text.rlike(rf"(?m)^[^\n]*[ \t]{TIME}[ \t]*$\n"), "block")
        .otherwise("plain")
    )


def _marked(text: Column, layout: Column) -> Column:
    """The text with every entry as \\x01 time \\x02 name \\x03 words."""
    cue = F.regexp_replace(text, rf"(?m)^(?:[^\n]{{0,12}}\n)?^[ \t]*({TIME})[ \t]*-->[^\n]*\n", "\x01$1\x02\x03")
    cue = F.regexp_replace(cue, r"\x03<v(?:\.[^ >]*)?[ \t]+([^>\n]*)>", "$1\x03")
    cue = F.regexp_replace(cue, rf"\x03({NAME})[ \t]*[:：]", "$1\x03")
    cue = F.regexp_replace(cue, r"</?[vc](?:[ .][^>\n]*)?>", "")
    clock = F.regexp_replace(text, rf"(?m)^[ \t]*\[({TIME})\][ \t]*", "\x01$1\x02\x03")
    clock = F.regexp_replace(clock, rf"\x03({NAME})[ \t]*[:：]", "$1\x03")
    bold = F.regexp_replace(text, rf"(?m)^(?:\*\*([^\n*]+)\*\*)?[ \t]*\(({TIME})\)[ \t]*[:：]?", "\x01$2\x02$1\x03")
    dash = F.regexp_replace(text, rf"(?m)^[ \t]*\(({TIME})\)[ \t]*", "\x01$1\x02\x03")
    dash = F.regexp_replace(dash, rf"\x03({NAME})[ \t]+[—–-][ \t]+", "$1\x03")
    block = F.regexp_replace(text, rf"(?m)^(?:([^\n]*?)[ \t]+)?({TIME})[ \t]*$\n?", "\x01$2\x02$1\x03")
    not_names = "|".join(NOT_NAMES)
    plain = F.regexp_replace(text, rf"(?m)^(?!(?i:{not_names})[ \t]*[:：])({NAME})[ \t]*[:：](?!//)", "\x01\x02$1\x03")
    # a line of its own in brackets between named entries belongs to nobody
    plain = F.regexp_replace(plain, rf"(?m)^[ \t]*(?:{ANNOTATION})[ \t]*$", "\x01\x02\x03")
    by_layout = {"cue": cue, "clock": clock, "bold": bold, "dash": dash, "block": block}
    marked = reduce(lambda rest, k: F.when(layout == k, by_layout[k]).otherwise(rest), by_layout, plain)
    return marked


def _seconds(time: Column) -> Column:
    parts = F.reverse(F.split(F.translate(time, ",", "."), ":"))
    return F.when(
        F.length(time) > 0,
        F.get(parts, F.lit(0)).cast("double")
        + F.get(parts, F.lit(1)).cast("double") * 60
        + F.coalesce(F.get(parts, F.lit(2)).cast("double"), F.lit(0.0)) * 3600,
    )


def clean_words(words: Column) -> Column:
    """The words of an entry without annotations and fillers, on one line and single-blanked.

    What only some entries have is sought with a plain class of characters first, where that is cheaper.
    """
    han = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}，。、；：！？（）…“”]"

    def single(text: Column) -> Column:
        return F.regexp_replace(text, r"[\s\p{Z}]+", " ")

    def unbroken(text: Column) -> Column:
        return F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, rf"(?<={han})[ \t]*\n+[ \t]*(?={han})", "")).otherwise(text)

    def unannotated(text: Column) -> Column:
        return F.when(text.rlike(r"[\[【*♪♫<（(]"), F.regexp_replace(text, ANNOTATION, " ")).otherwise(text)

    def unfilled(text: Column) -> Column:
        once = F.regexp_replace(text, FILLER_HAN, "")
        bare = F.when(text.rlike("[嗯呃额唔哦啊那这就]"), F.regexp_replace(once, FILLER_HAN, "")).otherwise(text)  # twice, for fillers in a row
        return let(bare, lambda t: F.when(t.rlike("[a-zA-Z]"), F.regexp_replace(t, FILLER_LATIN, "")).otherwise(t))

    def steps(text: Column, *each) -> Column:  # noqa: ANN002
        return text if not each else let(each[0](text), lambda t: steps(t, *each[1:]))

    return steps(words, unbroken, unannotated, lambda t: F.trim(single(t)), unfilled, lambda t: F.trim(single(t)))


def _plain_name(label: Column) -> Column:
    """A name without @, role and doubled blanks, in lower case; blanks between Chinese characters go."""
    label = F.regexp_replace(label, r"^[\s\p{Z}]*@|[（(\[][^（()\]）]*[)）\]][\s\p{Z}]*$|\*\*", "")
    label = F.regexp_replace(label, r"(?<=\p{L})[._](?=\p{L})", " ")
    label = F.trim(F.regexp_replace(label, r"[\s\p{Z}]+", " "))
    return F.lower(F.regexp_replace(label, r"(?<=\p{IsHan}) (?=\p{IsHan})", ""))


def attendee_names(attendees: Column) -> Column:
    """The distinct names of an attendee list without roles, single-blanked, in their spelling."""
    listed = F.split(F.regexp_replace(attendees, r"^[\s\[\"']+|[\s\]\"']+$", ""), r"[\"']?\s*[,，、;；\n|/]\s*[\"']?")
    names = F.transform(
        listed,
        lambda n: F.trim(F.regexp_replace(F.regexp_replace(n, r"[（(\[][^）)\]]*[)）\]]", ""), r"[\s\p{Z}]+", " ")),
    )
    return F.array_distinct(F.filter(names, lambda n: F.length(n) > 0))


def _whole_forms(key: Column) -> Column:
    """How a label may write a whole name, given in lower case."""
    words = F.split(key, " ")
    rest = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), " ")
    last = F.element_at(words, -1)
    many = F.array(
        key, F.concat(last, F.lit(", "), rest), F.concat(last, F.lit(","), rest), F.concat(last, F.lit(" "), rest),
        F.translate(key, " ", ""),
    )
    return F.when(F.instr(key, " ") > 0, many).otherwise(F.array(key))


def _partial_forms(key: Column) -> Column:
    """How a label may write part of a name: first or last name, initials, family name with a title."""
    words = F.split(key, " ")
    first, last = F.get(words, F.lit(0)), F.element_at(words, -1)
    initial, final = F.left(first, F.lit(1)), F.left(last, F.lit(1))
    latin = [
        first, last, F.concat(first, F.lit(" "), final, F.lit(".")), F.concat(first, F.lit(" "), final),
        F.concat(initial, F.lit(". "), last), F.concat(initial, F.lit(" "), last),
        F.concat(initial, F.lit(". "), final, F.lit(".")), F.concat(initial, final),
    ]
    family, given = F.left(key, F.lit(1)), F.substring(key, 2, 10)
    han = [
        given, *[F.concat(family, F.lit(t)) for t in TITLES], *[F.concat(F.lit(t), family) for t in FORENAMES],
        *[F.concat(key, F.lit(t)) for t in TITLES],
    ]
    return (
        F.when(key.rlike(r"^\p{IsHan}{2,6}$"), F.array(*han))
        .when(F.instr(key, " ") > 0, F.array(*latin))
        .otherwise(F.array().cast("array<string>"))
    )


def _entries(df: DataFrame, id_col: str, transcript: str, attendees: str) -> DataFrame:
    """One row per entry that has words: __id, __layout, __place, __at, __speaker, __words."""
    once = (
        df.select(F.col(id_col).alias("__id"), F.col(transcript).alias("__raw"), F.col(attendees).alias("__list"))
        .where(F.col("__id").isNotNull() & (F.length("__raw") > 0))
        # a stated number of partitions: the work per byte is too high for small ones to be merged
        .repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__id")
        .dropDuplicates(["__id"])
    )
    names = F.coalesce(attendee_names(F.col("__list")), F.array().cast("array<string>"))
    keyed = once.withColumn("__text", _text(F.col("__raw"))).withColumn(
        "__people", F.transform(names, lambda n: F.struct(n.alias("name"), _plain_name(n).alias("key")))
    )

    def forms(of) -> Column:  # noqa: ANN001
        return F.flatten(
            F.transform(
                "__people",
                lambda p: F.transform(of(p["key"]), lambda f: F.struct(f.alias("form"), p["name"].alias("name"))),
            )
        )

    marked = keyed.select(
        "__id",
        layout_of(F.col("__text")).alias("__layout"),
        "__text",
        forms(_whole_forms).alias("__whole"),
        forms(_partial_forms).alias("__partial"),
    ).withColumn("__marked", _marked(F.col("__text"), F.col("__layout")))

    def entry(piece: Column) -> Column:
        """Time, label and words of a piece; worked out once, as they are part of what is exploded."""
        return let(
            F.split(piece, "[\x02\x03]", 3),
            lambda head: F.struct(
                _seconds(F.get(head, F.lit(0))).alias("at"),
                F.regexp_replace(F.get(head, F.lit(1)), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("label"),
                clean_words(F.get(head, F.lit(2))).alias("words"),
            ),
        )

    entries = let(F.split("__marked", "\x01"), lambda pieces: F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), entry))
    spoken = F.filter(entries, lambda e: e["words"].rlike(r"[\p{L}\p{N}]"))

    def named(forms: Column) -> Column:
        def of(e: Column) -> Column:
            return F.struct(e["at"].alias("at"), _speaker(e["label"], forms["whole"], forms["partial"]).alias("speaker"), e["words"].alias("words"))

        return F.transform("__spoken", of)

    # the forms are bound once, or they would be made again for every entry
    known = F.struct(F.col("__whole").alias("whole"), F.col("__partial").alias("partial"))
    rows = marked.select("__id", "__layout", "__whole", "__partial", spoken.alias("__spoken"))
    split = rows.select("__id", "__layout", F.posexplode(let(known, named)).alias("__place", "e"))
    return split.select("__id", "__layout", "__place", F.col("e.at").alias("__at"), F.col("e.speaker").alias("__speaker"), F.col("e.words").alias("__words"))


def _speaker(label: Column, whole: Column, partial: Column) -> Column:
    """The one attendee a label fits, wholly or else partly, or else the label as written."""

    def of(key: Column) -> Column:
        def fits(forms: Column) -> Column:
            return F.array_distinct(F.transform(F.filter(forms, lambda f: f["form"] == key), lambda f: f["name"]))

        def part(found: Column) -> Column:
            return F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(label)

        return let(fits(whole), lambda found: F.when(F.size(found) > 0, F.get(found, F.lit(0))).otherwise(let(fits(partial), part)))

    return F.when(label == "", "").otherwise(let(_plain_name(label), of))


def speaker_turns(
    df: DataFrame,
    id_col: str,
    transcript: str,
    attendees: str,
    pause_factor: float | None = None,
    least_overlap: int = 12,
) -> DataFrame:
    """One row per turn: <id_col>, turn_no (from 1), speaker, text, start_s, n_entries.

    Entries are ordered by their start; ties and entries without times keep their place. In captions, words that
    repeat the end of the entry before (the longest suffix that is a prefix, of at least least_overlap characters)
    are taken off. A turn ends where the speaker changes. With pause_factor it also ends at a calibrated pause: a
    step between two entries longer than that many times the meeting's median step. Entries of nothing but fillers
    or annotations are no turn and part none. A label that fits no attendee, or several, stays as written; words
    without label go to the speaker before them, or to the empty name. Null and empty transcripts, null ids and
    transcripts without any words give no rows; a null or empty attendee list leaves all labels as written; rows
    with the same id are one meeting, of which one row is read.
    """
    rows = _entries(df, id_col, transcript, attendees)
    order = Window.partitionBy("__id").orderBy(F.col("__at").asc_nulls_first(), "__place")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.withColumn("__before", F.lag("__words").over(order)).withColumn(
        "__step", F.col("__at") - F.lag("__at").over(order)
    ).withColumn(
        "__speaker", F.coalesce(F.last(F.when(F.col("__speaker") != "", F.col("__speaker")), True).over(upto), F.lit(""))
    )
    reach = F.least(F.length("__before"), F.length("__words"))
    longest = F.get(
        F.filter(
            F.sequence(reach, F.lit(least_overlap), F.lit(-1)),
            lambda k: F.right(F.col("__before"), k) == F.left(F.col("__words"), k),
        ),
        F.lit(0),
    )
    may_repeat = (
        (F.col("__layout") == "cue")
        & (reach >= least_overlap)
        & F.contains(F.col("__before"), F.left(F.col("__words"), F.lit(least_overlap)))
    )
    swept = swept.withColumn("__overlap", F.when(may_repeat, longest)).withColumn(
        "__words",
        F.when(F.col("__overlap").isNotNull(), F.ltrim(F.substr("__words", F.col("__overlap") + 1))).otherwise(F.col("__words")),
    ).where(F.col("__words").rlike(r"[\p{L}\p{N}]"))
    opens = F.lag("__speaker").over(order).isNull() | (F.lag("__speaker").over(order) != F.col("__speaker"))
    if pause_factor is not None:
        usual = F.percentile("__step", 0.5).over(Window.partitionBy("__id"))
        opens = opens | F.coalesce(F.col("__step") > usual * float(pause_factor), F.lit(False))
    numbered = swept.withColumn("__opens", opens.cast("int")).withColumn("__no", F.sum("__opens").over(upto))
    turns = numbered.groupBy("__id", "__no").agg(
        F.array_sort(F.collect_list(F.struct("__at", "__place", "__words", "__speaker"))).alias("__own")
    )
    return turns.select(
        F.col("__id").alias(id_col),
        F.col("__no").cast("bigint").alias("turn_no"),
        F.get("__own", F.lit(0))["__speaker"].alias("speaker"),
        F.array_join(F.transform("__own", lambda e: e["__words"]), " ").alias("text"),
        F.get("__own", F.lit(0))["__at"].alias("start_s"),
        F.size("__own").alias("n_entries"),
    )
