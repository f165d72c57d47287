"""Problem 5: items above a size limit, cut at natural boundaries with an overlap.

One regular expression does the cutting. Its alternatives are ordered by the strength of the boundary they
end at, each with a bounded quantifier; the last resort cuts inside a run of characters. The overlap is
looked back for in the parts before, with array functions, so that a text is never scanned again from its
start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions.text import let

#: Parts whose sizes are summed at once for the starts of the parts after them.
BLOCK = 128
EDGE = r"[\s\p{Z}\p{P}]"
PARAGRAPH = r"(?:\r\n|\n|\r)[ \t]{0,2}(?:\r\n|\n|\r(?!\n))"
LINE = r"(?:\r\n|\n|\r(?!\n))"
SENTENCE = r"[.!?。！？…।؟][\p{Pe}\p{Pf}\"']{0,3}(?:\s|(?<=[。！？…\p{Pe}\p{Pf}])(?!\p{Pe}))"
CLAUSE = r"(?:[，；：、،]|[,;:](?=\s))"
BLANK = r"[\s\p{Z}]"
UNSPLIT = r"(?![\p{M}\x{200D}\x{FE00}-\x{FE0F}])"


def piece_pattern(limit: int, overlap: int) -> str:
    """The alternatives for the first piece (the whole limit) and for the others (limit less overlap)."""

    def alternatives(room: int) -> str:
        half = room // 2
        ends = [
            rf".{{1,{room}}}\z",
            rf".{{{half},{room - 6}}}{PARAGRAPH}",
            rf".{{{half},{room - 2}}}{LINE}",
            rf".{{{half},{room - 6}}}{SENTENCE}",
            rf".{{{half},{room - 1}}}{CLAUSE}",
            rf".{{{half},{room - 1}}}{BLANK}(?!\n)",
            rf".{{0,{room - 1}}}{EDGE}(?<!\r(?=\n))",
            rf"[^\s\p{{Z}}\p{{P}}]{{1,{limit}}}(?={EDGE}|\z)",
            rf".{{1,{room}}}{UNSPLIT}",
            rf".{{1,{room}}}",
        ]
        return "|".join(ends)

    return rf"(?s)\A(?:{alternatives(limit)})|{alternatives(limit - overlap)}"


def parts_of(text: Column, limit: int, overlap: int) -> Column:
    """Array of consecutive parts that together are the text, none of them overlapping."""
    return F.regexp_extract_all(text, F.lit(piece_pattern(limit, overlap)), F.lit(0))


def _block_starts(sizes: Column) -> Column:
    """The sum of the sizes before every BLOCK of them, so that a running sum takes no more than a block's steps an element."""
    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(sizes) - 1, F.lit(0)) / BLOCK).cast("int"))
    totals = F.transform(blocks, lambda b: F.aggregate(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda total, n: total + n))
    return F.aggregate(totals, F.array(F.lit(0)), lambda starts, n: F.array_append(starts, F.element_at(starts, -1) + n))


def split_oversized(
    df: DataFrame, id_col: str, text_col: str, limit: int = 1000, overlap: int = 100
) -> DataFrame:
    """Pieces of every text longer than limit code points: one row per piece, in order.

    Columns: <id_col>, piece_no (from 0), start_pos (0-based, of the piece with its overlap), piece,
    n_chars, overlap (code points shared with the piece before), cut (how the piece ends: paragraph, line,
    sentence, clause, blank, mark, forced or end) and piece_count. A piece never exceeds limit; its overlap
    is shorter than asked for only where the unbreakable run after it needs the room or the text before is
    shorter. Null and empty texts and texts within the limit give no rows; a repeated id gives its pieces
    once per row.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be shorter than half of the limit")
    cut_in = (
        df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
        .where(F.length("__text") > limit)
        .select("__id", parts_of(F.col("__text"), limit, overlap).alias("__parts"))
    )

    def pieces(sizes: Column) -> Column:
        """Each part with where it starts, what leads into it and what follows."""
        return let(_block_starts(sizes), lambda before_block: F.transform("__parts", lambda part, i: one(part, i, sizes, before_block)))

    def one(part: Column, i: Column, sizes: Column, before_block: Column) -> Column:
        def at(j: Column) -> Column:
            return F.coalesce(F.get("__parts", j), F.lit(""))

        block = F.floor(i / BLOCK).cast("int")
        in_block = F.aggregate(F.slice(sizes, block * BLOCK + 1, i - block * BLOCK), F.lit(0), lambda total, n: total + n)
        wanted = F.least(F.lit(overlap), F.lit(limit) - F.length(part))
        return F.struct(
            part.alias("part"),
            F.right(F.concat(at(i - 2), at(i - 1)), wanted).alias("lead"),
            at(i + 1).alias("next"),
            F.get("__parts", i + 1).isNull().alias("last"),
            (F.get(before_block, block) + in_block).alias("start"),
        )

    rows = cut_in.select(
        "__id",
        F.size("__parts").alias("piece_count"),
        F.posexplode(let(F.transform("__parts", lambda p: F.length(p)), pieces)).alias("piece_no", "p"),
    )
    part, following = F.col("p.part"), F.col("p.next")
    inside = ~part.rlike(EDGE + r"\z") & ~following.rlike(r"\A" + EDGE)
    cut = (
        F.when(F.col("p.last"), "end")
        .when(inside, "forced")
        .when(part.rlike(PARAGRAPH + r"\z"), "paragraph")
        .when(part.rlike(r"[\r\n]\z"), "line")
        .when(part.rlike(r"(?s)" + SENTENCE + r"\z"), "sentence")
        .when(part.rlike(CLAUSE + r"\z"), "clause")
        .when(part.rlike(BLANK + r"\z"), "blank")
        .otherwise("mark")
    )
    piece = F.concat("p.lead", "p.part")
    return rows.select(
        F.col("__id").alias(id_col),
        F.col("piece_no").cast("int").alias("piece_no"),
        (F.col("p.start") - F.length("p.lead")).cast("bigint").alias("start_pos"),
        piece.alias("piece"),
        F.length(piece).alias("n_chars"),
        F.length("p.lead").alias("overlap"),
        cut.alias("cut"),
        "piece_count",
    )
