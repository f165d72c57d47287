"""Text expressions: pure functions from columns to a column, evaluated inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"
WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
NARROW = "".join(chr(0x21 + i) for i in range(94)) + " "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without blanks of any kind at both ends; null stays null."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalise(text: Column) -> Column:
    """One kind of line end, narrow forms, no zero-width characters, byte-order marks or soft hyphens."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.translate(text, WIDE, NARROW)
    return F.regexp_replace(text, r"[\x{200b}-\x{200d}\x{feff}\x{ad}]", "")


def nfkc(text: Column) -> Column:
    """Compatibility forms folded and characters composed (NFKC), which no built-in function does; in Arrow batches."""

    @F.pandas_udf("string")
    def fold(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.str.normalize("NFKC")

    return fold(text)


def line_count(text: Column) -> Column:
    """Line feeds, and one for a last line without one; 0 for the empty text."""
    ends = F.regexp_count(text, F.lit("\n"))
    return ends + F.when((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)


def han_count(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, HAN, ""))


def token_estimate(text: Column) -> Column:
    """int(1.5 Han characters + 1.3 Latin words + 0.5 other visible characters), without a tokenizer."""
    han = han_count(text)
    words = F.regexp_count(text, F.lit("[a-zA-Z]+"))
    letters = F.length(text) - F.length(F.regexp_replace(text, "[a-zA-Z]", ""))
    blanks = F.length(text) - F.length(F.regexp_replace(text, r"\s", ""))
    other = F.length(text) - han - letters - blanks
    return F.floor(han * F.lit(1.5) + words * F.lit(1.3) + other * F.lit(0.5)).cast("int")


def language(text: Column, share: float = 0.3) -> Column:
    """zh above the share of Han among visible characters, en if all letters are ASCII, else unknown."""
    visible = F.length(F.regexp_replace(text, r"[ \n]", ""))
    blank = text.isNull() | (F.length(strip(text)) == 0)
    return (
        F.when(blank, "unknown")
        .when(han_count(text) > visible * share, "zh")
        .when(~text.rlike(r"[\p{L}&&[^\x00-\x7F]]"), "en")
        .otherwise("unknown")
    )


def keywords(text: Column, most: int = 20) -> Column:
    """Lower-case Latin words of two or more letters, then pairs of neighbouring Han characters, distinct, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]{2,})"), F.lit(1))
    none = F.array().cast("array<string>")

    def pairs(han: Column) -> Column:
        return F.when(
            F.length(han) > 1, F.transform(F.sequence(F.lit(1), F.length(han) - 1), lambda i: F.substr(han, i, F.lit(2)))
        ).otherwise(none)

    both = F.concat(words, let(F.regexp_replace(text, rf"(?!{HAN})(?s:.)", ""), pairs))
    return F.slice(F.array_distinct(both), 1, most)


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; 0 where both are empty, null where one is null."""
    union = F.size(F.array_union(a, b))
    return F.when(a.isNull() | b.isNull(), None).when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def citations(text: Column, longest: int = 50) -> Column:
    """Cited numbers of [n], [a-b] and [a,b], distinct and in order; a range of more than longest counts its ends."""
    marks = F.regexp_extract_all(text, F.lit(r"\[([0-9]{1,6}(?:(?:-|,)[0-9]{1,6})*)\]"), F.lit(1))

    def numbers(mark: Column) -> Column:
        ends = F.transform(F.split(mark, "-"), lambda x: F.get(F.split(x, ","), F.lit(0)).cast("int"))
        low, high = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
        is_range = (F.size(ends) == 2) & (high >= low) & (high - low <= longest)
        each = F.transform(F.split(mark, "[-,]"), lambda x: x.cast("int"))
        return F.when(is_range, F.sequence(low, F.when(is_range, high).otherwise(low))).otherwise(each)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(marks, numbers))))


def strip_html(html: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def strip_markdown(text: Column) -> Column:
    """Without fences, heading marks, list marks, emphasis and link targets; blank lines collapsed."""
    text = F.regexp_replace(text, r"```[^\n]*", "")
    text = F.regexp_replace(text, r"\[([^\]\n]*)\]\([^)\n]*\)", "$1")
    text = F.regexp_replace(text, r"(^|\n)[ \t]*(#{1,6}|[-*+]|[0-9]+\.)[ \t]+", "$1")
    text = F.regexp_replace(text, r"[*_`]", "")
    return strip(F.regexp_replace(text, r"\n{2,}", "\n"))


def sentences(text: Column) -> Column:
    """Portable split: runs up to an end mark or line end, stripped, of more than three characters."""
    parts = F.regexp_extract_all(text, F.lit(r"[^.!?。！？\n]+[.!?。！？]*"), F.lit(0))
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > 3)


def slug(name: Column) -> Column:
    """A file name of word characters, dots and hyphens, of at most 100 characters."""
    name = F.regexp_replace(name, r"[^0-9A-Za-z_.\-]+", "_")
    name = F.regexp_replace(name, "_+", "_")
    return F.substring(F.regexp_replace(name, r"^[._]+|[._]+$", ""), 1, 100)


def grams(text: Column, n: int = 4) -> Column:
    """The distinct runs of n characters of a text without blanks, in lower case."""
    def runs(bare: Column) -> Column:
        size = F.length(bare)
        each = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substr(bare, i, F.lit(n)))
        return F.when(size >= n, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    return let(F.lower(F.regexp_replace(text, r"\s+", "")), runs)


def gram_coverage(text: Column, source: Column, n: int = 4) -> Column:
    """Share of a text's runs of n characters that its source has; 0 for a text without any, null where one is null."""
    share = let(
        grams(text, n),
        lambda mine: F.when(F.size(mine) == 0, 0.0).otherwise(F.size(F.array_intersect(mine, grams(source, n))) / F.size(mine)),
    )
    return F.when(text.isNull() | source.isNull(), None).otherwise(share)


def is_namespace(name: Column) -> Column:
    """3 to 63 letters, digits, hyphens and underscores, with a letter or digit at both ends."""
    return F.coalesce(name.rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]{1,61}[A-Za-z0-9]$"), F.lit(False))


def roman(number: Column) -> Column:
    """Roman numerals of 1 to 3999; null outside."""
    values = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
    parts, left = [], number
    for v, letters in values:
        parts.append(F.repeat(F.lit(letters), F.floor(left / v).cast("int")))
        left = left % v
    return F.when((number >= 1) & (number <= 3999), F.concat(*parts))


def last_place(text: Column, mark: str) -> Column:
    """0-based place of the last occurrence of a mark, -1 if there is none."""
    lead = F.regexp_extract(text, rf"(?s)^(.*){re.escape(mark)}", 1)
    return F.when(F.contains(text, F.lit(mark)), F.length(lead)).otherwise(-1)


def truncated(text: Column, most: int, marks: tuple[str, ...] = ("\n", "。", ".", " "), least: float = 0.6, suffix: str = "...") -> Column:
    """A text of at most ``most`` characters and the suffix, cut before the last of the first mark that stands late enough."""

    def cut(head: Column) -> Column:
        at = F.coalesce(*[F.when(last_place(head, m) >= int(most * least), last_place(head, m)) for m in marks], F.lit(most))
        return F.concat(F.left(head, at), F.lit(suffix))

    return F.when(F.length(text) > most, let(F.left(text, F.lit(most)), cut)).otherwise(text)


def first_number(text: Column) -> Column:
    """The first unsigned number of a text, or null."""
    return F.nullif(F.regexp_extract(text, r"([0-9]+\.?[0-9]*)", 1), F.lit("")).try_cast("double")


def json_score(raw: Column, field: str, default: float = 0.5) -> Column:
    """A number of a JSON object, or of the widest braces in a text around one, or the default."""

    def read(text: Column) -> Column:
        return F.when(F.try_parse_json(text).isNotNull(), F.get_json_object(text, f"$.{field}").try_cast("double"))

    return F.coalesce(read(raw), read(F.regexp_extract(raw, r"(?s)(\{.*\})", 1)), F.lit(default))
