"""Chunks of documents: fixed, by paragraph, by sentence and recursive, with their statistics and context."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions.text import last_place, let, sentences, strip

# Separators by kind of document, strongest first; fixed values.
SEPARATORS = {
    "text": ["\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", "；", "; ", " ", ""],
    "markdown": ["\n## ", "\n### ", "\n#### ", "\n\n", "\n", "。", ". ", " ", ""],
    "code": ["\ndef ", "\nclass ", "\nasync def ", "\n# ", "\n// ", "\n\n", "\n", "; ", " ", ""],
    "html": ["\n</section>", "\n</article>", "\n</div>", "\n</p>", "\n<br>", "\n\n", "\n", "。", ". ", " ", ""],
}


def fixed_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """<id_col>, chunk_index, start_pos, chunk: windows of size characters, each overlap before the last one's end.

    The last chunk is the first to reach the end of the text. Null and empty texts give no rows.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be shorter than the size")
    step = size - overlap
    n = F.length(text_col)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step).cast("int"))
    rows = df.where(n > 0).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("chunk_index") * step
    return rows.select(id_col, "chunk_index", start.alias("start_pos"), F.substr(text_col, start + 1, F.lit(size)).alias("chunk"))


def _exploded(df: DataFrame, id_col: str, parts: Column, name: str) -> DataFrame:
    return df.select(id_col, F.posexplode(parts).alias("chunk_index", name))


def paragraph_chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """<id_col>, chunk_index, chunk: stripped parts between blank lines, without empty ones."""
    parts = F.transform(F.split(text_col, r"\r?\n\s*\r?\n"), strip)
    return _exploded(df, id_col, F.filter(parts, lambda p: F.length(p) > 0), "chunk")


def sentence_chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """<id_col>, chunk_index, chunk by portable end marks."""
    return _exploded(df, id_col, sentences(F.col(text_col)), "chunk")


def with_context(chunks: DataFrame, id_col: str, longest: int = 200) -> DataFrame:
    """Adds context_prefix and context_suffix: the chunks before and after, at most longest characters of each."""
    order = Window.partitionBy(id_col).orderBy("chunk_index")
    return chunks.withColumn("context_prefix", F.substring(F.lag("chunk").over(order), 1, longest)).withColumn(
        "context_suffix", F.substring(F.lead("chunk").over(order), 1, longest)
    )


def aligned_overlap(chunk: Column, wanted: int) -> Column:
    """Where an overlap of about ``wanted`` characters ends with a sentence: after the end mark nearest to it, within three
    tenths of it and at least ten characters, the later one first; 0 for a chunk that isn't longer than wanted."""
    reach = max(10, int(wanted * 0.3))
    n = F.length(chunk)

    def nearest(text: Column) -> Column:
        steps = F.sequence(F.lit(-(reach - 1)), F.lit(reach - 1))
        ends = F.filter(
            steps, lambda d: (d + wanted > 0) & (d + wanted < n) & F.contains(F.lit("。！？.!?\n"), F.substr(text, d + wanted + 1, F.lit(1)))
        )
        best = F.array_min(F.transform(ends, lambda d: F.struct(F.abs(d).alias("far"), (-d).alias("later"))))
        return F.coalesce(F.lit(wanted + 1) - best["later"], F.lit(wanted))

    return F.when((n > wanted) & (wanted > 0), let(chunk, nearest)).otherwise(0)


def with_overlap(chunks: DataFrame, overlap: int, alike: float = 0.5) -> DataFrame:
    """Adds overlap_ratio, to three decimals, and near_duplicate_of: the chunk before, where that is alike enough, or null."""
    ratio = F.when(F.col("chunk_index") > 0, F.round(aligned_overlap(F.col("chunk"), overlap) / F.greatest(F.length("chunk"), F.lit(1)), 3)).otherwise(0.0)
    return chunks.withColumn("overlap_ratio", ratio).withColumn(
        "near_duplicate_of", F.when((F.col("chunk_index") > 0) & (F.col("overlap_ratio") >= alike), F.col("chunk_index") - 1)
    )


def token_chunks(df: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str, size: int = 256, overlap: int = 32) -> DataFrame:
    """<id_col>, chunk_index, n_tokens, chunk: windows of size tokens, each overlap before the last one's end.

    ranks_path and pattern: a public tokenizer's ranks file, which all executors must reach, and how it splits words. A
    window that cuts a character shows U+FFFD there. Null and empty texts give no rows; texts are encoded whole.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be shorter than the size")

    @F.pandas_udf("array<struct<n_tokens: int, chunk: string>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoder = tiktoken.Encoding(ranks_path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            out = []
            for text in batch:
                ids = encoder.encode_ordinary(text)
                last = max(0, -(-(len(ids) - size) // (size - overlap)))
                windows = [ids[i * (size - overlap) :][:size] for i in range(last + 1)]
                out.append([{"n_tokens": len(w), "chunk": encoder.decode(w)} for w in windows])
            yield pd.Series(out)

    rows = df.where(F.length(text_col) > 0).select(id_col, F.posexplode(cut(F.col(text_col))).alias("chunk_index", "c"))
    return rows.select(id_col, "chunk_index", "c.n_tokens", "c.chunk")


def map_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 3000, overlap: int = 200, most: int | None = None) -> DataFrame:
    """<id_col>, chunk_index, chunk: windows that end after the strongest mark in their last overlap characters.

    Each begins overlap characters before the end of the one before, until one reaches the end of the text; most bounds their
    number, as a caller with a budget wants, else the whole text is cut. Null and empty texts give no rows.
    """
    marks = ["\n\n", "。", ". ", "\n", "！", "？", "! ", "? "]
    n = F.length(text_col)
    kind = "array<struct<a: int, b: int>>"

    def end_of(start: Column) -> Column:
        def after_mark(tail: Column) -> Column:
            places = F.coalesce(*[F.when(last_place(tail, m) > 0, last_place(tail, m)) for m in marks])
            return F.coalesce(start + (size - overlap) + places + 1, start + size)

        return F.when(start + size >= n, n).otherwise(let(F.substr(text_col, start + (size - overlap) + 1, F.lit(overlap)), after_mark))

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        end = end_of(at)
        return F.when(at >= n, state).otherwise(
            let(end, lambda e: F.struct(F.when(e >= n, n).otherwise(e - overlap).alias("at"), F.array_append(state["spans"], F.struct(at.alias("a"), e.alias("b"))).alias("spans")))
        )

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(n / (size - 2 * overlap)).cast("int")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))
    spans = F.aggregate(F.slice(steps, 1, most) if most else steps, start, step)["spans"]
    rows = df.where(n > 0).select(id_col, text_col, F.posexplode(spans).alias("chunk_index", "s"))
    return rows.select(id_col, "chunk_index", strip(F.substr(text_col, F.col("s.a") + 1, F.col("s.b") - F.col("s.a"))).alias("chunk"))


def chunk_stats(chunks: DataFrame, id_col: str) -> DataFrame:
    """Per document: n, total, smallest, largest, average and median (one decimal) and 95th percentile of chunk sizes."""
    sized = chunks.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("chunk")).alias("total_chars"),
        F.min(F.length("chunk")).alias("min_chars"), F.max(F.length("chunk")).alias("max_chars"),
        F.round(F.avg(F.length("chunk")), 1).alias("avg_chars"), F.sort_array(F.collect_list(F.length("chunk"))).alias("s"),
    )
    n = F.col("n_chunks")
    low, high = F.floor((n - 1) / 2).cast("int"), F.ceil((n - 1) / 2).cast("int")
    return sized.select(
        "*", F.round((F.get("s", low) + F.get("s", high)) / 2, 1).alias("median_chars"),
        F.get("s", F.least(F.floor(n * F.lit(0.95)), n - 1).cast("int")).alias("p95_chars"),
    ).drop("s")


def _pieces_at(separator: str, size: int) -> str:
    """A pattern for the pieces of a text between separators: as many as fit in size together, else one that is too long.

    Separators between pieces are skipped; the empty one cuts anywhere.
    """
    if not separator:
        return rf"(?s)(.{{1,{size}}})"
    end = rf"(?={re.escape(separator)}|\z)"
    return rf"(?s)(?:{re.escape(separator)})*+(.{{1,{size}}}{end}|.+?{end})"


def recursive_pieces(text: Column, size: int, separators: list[str]) -> Column:
    """Array of the pieces of a text: by the strongest separator, and those that are still too long by the next.

    One pass of the pattern engine per separator, over what is left too long; blank texts have none, a text that fits is one.
    """

    def divided(separator: str) -> Callable[[Column], Column]:
        pattern = F.lit(_pieces_at(separator, size))
        return lambda p: F.when(F.length(p) > size, F.regexp_extract_all(p, pattern, F.lit(1))).otherwise(F.array(p))

    parts = F.when(F.length(strip(text)) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    for separator in separators:
        parts = F.flatten(F.transform(parts, divided(separator)))
    return parts


def _merged(chunks: Column, smallest: int) -> Column:
    """Chunks below smallest characters joined to the one before, each on a line of its own."""

    def joined(all_chunks: Column) -> Column:
        n = F.size(all_chunks)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        opens = F.filter(places, lambda i: (i == 0) | (F.length(F.get(all_chunks, i)) >= smallest))

        def from_each(starts: Column) -> Column:
            ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(n))
            return F.zip_with(starts, F.slice(ends, 1, F.size(starts)), lambda a, b: F.array_join(F.slice(all_chunks, a + 1, b - a), "\n"))

        return let(opens, from_each)

    return let(chunks, joined)


def recursive_chunks(
    df: DataFrame, id_col: str, text_col: str, size: int = 500, smallest: int = 20, kind: str = "text"
) -> DataFrame:
    """<id_col>, chunk_index, chunk: greedy pieces by the strongest separators that fit.

    A chunk below smallest characters joins the one before, on a line of its own. Null and blank texts give no
    rows; a text is split whole, by built-in functions alone.
    """
    pieces = recursive_pieces(F.col(text_col), size, SEPARATORS[kind])
    return _exploded(df, id_col, _merged(F.filter(pieces, lambda p: F.length(p) > 0), smallest), "chunk")
