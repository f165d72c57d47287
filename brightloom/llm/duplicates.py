"""Problem 4: records that differ only in formatting, collapsed with their number of copies.

A text is brought to a canonical form with built-in string functions only, its 128-bit digest is the
grouping key, and counts are combined on the map side before the shuffle. A second, independent digest and
the length guard against collisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions.text import let

# Full-width ASCII variants (U+FF01..U+FF5E) and the ideographic blank, folded to ASCII.
WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
NARROW = "".join(chr(0x21 + i) for i in range(94)) + " "

INVISIBLE = r"[\p{Cf}\x{FE00}-\x{FE0F}]"
# What doesn't count: all but letters, digits, marks and symbols; but the point between digits does, and the hyphen
# before a digit, unless a digit or a letter of a script that sets blanks stands before it.
SPACED = r"[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]]"
DROPPED = rf"[^\p{{L}}\p{{N}}\p{{M}}\p{{S}}.-]|[=|<>`^~]|(?<!\p{{N}})\.|\.(?!\p{{N}})|-(?!\p{{N}})|(?<={SPACED})-"
# A field begins with its name, one word, followed by a colon or an equals sign.
NAME = r"""["']?[\p{L}_][\p{L}\p{N}_-]*["']?\s*[:=](?!//)"""
FIELD = r"""["']?([\p{L}_][\p{L}\p{N}_-]*)["']?\s*[:=](?!//)"""


def _folded(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.translate(text, WIDE + "−", NARROW + "-")), INVISIBLE, "")


def _squeezed(text: Column) -> Column:
    """Only what counts as content: letters, digits, marks, symbols, minus signs and decimal points."""
    return F.regexp_replace(text, DROPPED, "")


def canonical_text(text: Column) -> Column:
    """Canonical form of prose or of a record of named fields; null stays null.

    A text that opens with a field and has at least two is a record: its (name, value) pairs are ordered,
    so field order and notation (JSON, ``name: value``, ``name=value``) do not count. A field name is one
    word. Blanks, invisible characters, case and punctuation do not count; a decimal point between digits
    and a minus sign before a digit do.
    """

    def record(folded: Column) -> Column:
        names = F.regexp_extract_all(folded, F.lit(FIELD), F.lit(1))
        parts = F.split(folded, FIELD)
        pairs = F.zip_with(
            names,
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda n, v: F.concat(_squeezed(n), F.lit("\x1f"), _squeezed(v)),
        )
        return F.when(F.size(names) >= 2, F.concat(F.lit("\x1d"), F.array_join(F.array_sort(pairs), "\x1e"))).otherwise(_squeezed(folded))

    # only a text that opens with a field is taken apart
    opens = rf"^[^\p{{L}}\p{{N}}\p{{M}}_-]*?{NAME}"
    return let(_folded(text), lambda folded: F.when(folded.rlike(opens), record(folded)).otherwise(_squeezed(folded)))


def with_digest(df: DataFrame, columns: list[str], digest: str = "digest") -> DataFrame:
    """Adds <digest> (16 bytes), <digest>_check (64 bits, another hash) and <digest>_size.

    Null and every text are told apart: null equals only null in that column.
    """
    forms = [F.coalesce(F.concat(F.lit("+"), canonical_text(F.col(c))), F.lit("-")) for c in columns]
    key = F.concat_ws("\x1c", *forms)
    return (
        df.withColumn("__canonical", key)
        .withColumn(digest, F.unhex(F.md5("__canonical")))
        .withColumn(f"{digest}_check", F.xxhash64("__canonical"))
        .withColumn(f"{digest}_size", F.length("__canonical"))
        .drop("__canonical")
    )


def count_copies(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """One row per distinct record: rep_id (smallest id), copies (its rows), collided (digest shared).

    Two records whose 128-bit digests are equal but whose check hash or length differ are kept apart by
    the grouping key, and both are marked collided. Rows with a null id count as copies, and a record whose
    ids are all null has a null rep_id. Repeated rows count each time. An empty table gives no rows.
    """
    slim = df.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)])
    keyed = with_digest(slim, [f"__c{i}" for i in range(len(columns))])
    counted = keyed.groupBy("digest", "digest_check", "digest_size").agg(
        F.min("__id").alias("rep_id"), F.count(F.lit(1)).alias("copies")
    )
    shared = counted.groupBy("digest").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return counted.join(shared, "digest", "left").select(
        "digest", "rep_id", "copies", F.col("__n").isNotNull().alias("collided")
    )


def duplicate_records(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """rep_id and copies of every record with at least two copies."""
    slim = df.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)])
    keyed = with_digest(slim, [f"__c{i}" for i in range(len(columns))])
    return (
        keyed.groupBy("digest", "digest_check", "digest_size")
        .agg(F.min("__id").alias("rep_id"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select("rep_id", "copies")
    )
