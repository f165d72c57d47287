"""From candidates to a cited context: deduplication, rerank cut, token budget, rendering and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions.text import citations, jaccard, keywords, let, strip, token_estimate, token_set

# Phrases of an unsure answer; fixed values.
UNSURE = [
    "无法回答", "没有足够信息", "不确定", "可能", "无法确定", "资料不足", "缺少信息",
    "i cannot answer", "insufficient", "uncertain", "no information", "not clear",
]
# Patterns of a declined answer; fixed values.
DECLINED = r"我无法回答|没有足够.*信息|根据现有资料.*无法|I cannot answer|insufficient information|cannot be answered"


def best_by_document(candidates: DataFrame, query: str, doc: str, score: str, id_col: str) -> DataFrame:
    """One row per query and document, the best scored; ties go to the smaller id; rows without document all stay."""
    with_doc = candidates.where(F.col(doc).isNotNull())
    order = F.struct(F.coalesce(F.col(score), F.lit(float("-inf"))), -F.col(id_col))
    best = with_doc.groupBy(F.col(query).alias("__q"), F.col(doc).alias("__d")).agg(F.max_by(F.struct(*candidates.columns), order).alias("r"))
    return best.select("r.*").unionByName(candidates.where(F.col(doc).isNull()))


def rerank_cut(candidates: DataFrame, query: str, score: str, id_col: str, top_n: int = 5, least: float = 0.3) -> DataFrame:
    """The top_n of every query: those of at least ``least`` first, filled up with the best of the others; place from 1.

    Null scores come last; ties go to the smaller id.
    """
    good = F.coalesce(F.col(score) >= least, F.lit(False))
    order = Window.partitionBy(query).orderBy(good.desc(), F.col(score).desc_nulls_last(), id_col)
    return candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_n)


def keyword_bonus(df: DataFrame, query_text: str, content: str, score: str, boost: float = 0.15) -> DataFrame:
    """Adds boosted: the score and boost times the share of the query's keywords that the content holds."""
    wanted = keywords(F.col(query_text))
    hits = F.size(F.filter(wanted, lambda w: F.contains(F.lower(content), w)))
    bonus = F.when(F.size(wanted) > 0, F.least(F.lit(boost), F.lit(boost) * hits / F.size(wanted))).otherwise(0.0)
    return df.withColumn("boosted", F.coalesce(F.col(score), F.lit(0.0)) + F.coalesce(bonus, F.lit(0.0)))


def within_budget(
    candidates: DataFrame, query: str, content: str, score: str, id_col: str, most: int = 8, tokens: int = 3000, pool: int | None = None
) -> DataFrame:
    """query, chosen: the ids taken greedily by score until ``most`` are taken, skipping what exceeds the token budget.

    The first is always taken; ties go to the smaller id. All candidates of a query are considered, or with ``pool`` so many
    of the best. Of those of one size no more than ``most`` can be taken and none above the budget but the first, so that what
    is gathered of a query is bounded, however many candidates it has.
    """
    order = [F.col(score).desc_nulls_last(), F.col(id_col)]
    rank = F.struct(F.col(score).isNull().alias("n"), (-F.col(score)).alias("s"), F.col(id_col).alias("id"), F.coalesce(token_estimate(F.col(content)), F.lit(0)).alias("t"))
    slim = candidates
    if pool is not None:
        slim = slim.withColumn("__n", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("__n") <= pool)
    ranked = slim.select(query, F.col(score).alias("__score"), F.col(id_col).alias("__id"), rank.alias("c"))
    alike = Window.partitionBy(query, "c.t").orderBy(F.col("__score").desc_nulls_last(), "__id")
    kept = ranked.where(F.col("c.t") <= tokens).withColumn("__n", F.row_number().over(alike)).where(F.col("__n") <= most).select(query, "c")
    both = kept.unionByName(ranked.groupBy(query).agg(F.min("c").alias("c")))
    lists = both.groupBy(query).agg(F.array_sort(F.collect_set("c")).alias("__list"))
    kind = candidates.schema[id_col].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{kind}>").alias("ids"), F.lit(tokens).alias("left"))

    def take(state: Column, c: Column) -> Column:
        fits = (F.size(state["ids"]) == 0) | ((F.size(state["ids"]) < most) & (c["t"] <= state["left"]))
        return F.struct(
            F.when(fits, F.array_append(state["ids"], c["id"])).otherwise(state["ids"]).alias("ids"),
            F.when(fits, F.greatest(state["left"] - c["t"], F.lit(0))).otherwise(state["left"]).alias("left"),
        )

    return lists.select(query, F.aggregate("__list", start, take)["ids"].alias("chosen"))


def context_blocks(candidates: DataFrame, query: str, place: str, title: str, content: str, score: str) -> DataFrame:
    """query, context: numbered blocks with title and relevance, in order of place, a blank line between."""
    head = F.format_string("[%d] (%s | %d%%)\n", F.col(place), F.coalesce(F.col(title), F.lit("-")), F.round(F.coalesce(F.col(score), F.lit(0.0)) * 100).cast("int"))
    block = F.concat(head, F.coalesce(F.col(content), F.lit("")))
    rows = candidates.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), block.alias("b")))).alias("__b"))
    return rows.select(query, F.array_join(F.transform("__b", lambda x: x["b"]), "\n\n").alias("context"))


def cited_chunks(answers: DataFrame, id_col: str, content: str, query: str, ranked: DataFrame, place: str) -> DataFrame:
    """answers joined by their cited numbers with the candidates of those places for the same query."""
    cited = answers.select(id_col, query, F.explode(citations(F.col(content))).alias(place))
    return cited.join(ranked, [query, place], "inner")


def overlap(df: DataFrame, a: str, b: str) -> Column:
    return jaccard(token_set(F.col(a)), token_set(F.col(b)))


def confidence(top: Column, used: Column, grounded: Column, cited: Column, answer: Column) -> Column:
    """Mean of five signals, to two decimals: best score, coverage, sureness, length and grounding."""
    coverage = F.when((used > 0) & (cited > 0), grounded / used).when(used > 0, 0.2).otherwise(0.05)
    low = F.lower(answer)
    unsure = F.exists(F.array(*[F.lit(u) for u in UNSURE]), lambda u: F.contains(low, u))
    length = F.when(F.length(answer) < 30, 0.1).when(F.length(answer) < 100, 0.5).otherwise(0.9)
    ground = F.when(grounded > 0, F.least(F.lit(0.95), 0.5 + grounded * 0.1)).otherwise(0.2)
    total = F.when(used > 0, F.coalesce(top, F.lit(0.0))).otherwise(0.05) + coverage + F.when(unsure, 0.15).otherwise(0.85) + length + ground
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(total / 5, 2)))


def merged_sources(first: DataFrame, second: DataFrame, query: str, doc: str) -> DataFrame:
    """Rows of first, then those of second whose document first doesn't have; rows without document all stay."""
    seen = first.where(F.col(doc).isNotNull()).select(query, doc).distinct()
    return first.unionByName(second.join(seen, [query, doc], "left_anti"))


def marker_place(answer: Column, number: Column) -> Column:
    """0-based place in an answer of the mark [n], or of the first [a-b] that spans n; -1 if there is none."""

    def spans(mark: Column) -> Column:
        low, high = F.regexp_extract(mark, r"^\[([0-9]{1,6})-", 1).cast("int"), F.regexp_extract(mark, r"-([0-9]{1,6})\]$", 1).cast("int")
        return (low <= number) & (number <= high)

    ranges = F.filter(F.regexp_extract_all(answer, F.lit(r"(\[[0-9]{1,6}-[0-9]{1,6}\])"), F.lit(1)), spans)
    exact = F.instr(answer, F.concat(F.lit("["), number.cast("string"), F.lit("]")))
    return F.when(exact > 0, exact).otherwise(F.coalesce(F.instr(answer, F.get(ranges, F.lit(0))), F.lit(0))) - 1


def grounded(answer: Column, place: Column, source: Column, before: int = 50, after: int = 150, least: float = 0.3) -> Column:
    """Whether the words around a place of an answer come from a source: runs of three characters or more that both hold
    cover ``least`` of them. A mark that isn't there is not grounded, a snippet of less than five characters is."""
    start = F.greatest(place - before, F.lit(0))
    snippet = strip(F.regexp_replace(F.substr(answer, start + 1, place + after - start), r"\s+", " "))
    whole = strip(F.regexp_replace(source, r"\s+", " "))

    def covered(s: Column, w: Column) -> Column:
        n = F.length(s)
        hits = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.contains(w, F.substr(s, i, F.lit(3))))

        def share(h: Column) -> Column:
            def held(i: Column) -> Column:
                near = F.slice(h, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))
                return F.exists(near, lambda x: x)

            return F.size(F.filter(F.sequence(F.lit(1), n), held)) / n

        return F.when(n < 5, True).otherwise(let(hits, share) >= least)

    return F.when(place < 0, False).otherwise(let(F.struct(snippet.alias("s"), whole.alias("w")), lambda x: covered(x["s"], x["w"])))


def feedback_coverage(pairs: DataFrame, id_col: str, answer: str, source: str, head: int = 50, least: float = 0.6) -> DataFrame:
    """<id_col>, n_sources, n_found, coverage, passed: how many sources' first characters an answer holds."""
    hit = F.coalesce(F.contains(F.col(answer), F.left(F.col(source), F.lit(head))), F.lit(False))
    counted = pairs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_sources"), F.count_if(hit).alias("n_found"))
    return counted.withColumn("coverage", F.round(F.col("n_found") / F.col("n_sources"), 6)).withColumn("passed", F.col("coverage") >= least)
