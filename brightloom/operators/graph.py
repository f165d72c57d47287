"""Graphs as edge tables: building by co-occurrence, neighbourhoods, communities and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightloom.runtime import cut, hot_keys, looked_up


def co_occurrence(df: DataFrame, unit: str, entity: str, most_per_unit: int = 50) -> DataFrame:
    """source, target, weight: pairs of entities named in the same unit, source before target.

    A unit of more than most_per_unit entities is cut into parts of about so many by a hash, and every two parts meet
    under a key of their own, so that all its pairs are counted and no task takes a unit whole. Null units and entities
    don't count.
    """
    once = df.where(F.col(entity).isNotNull() & F.col(unit).isNotNull()).select(F.col(unit).alias("u"), F.col(entity).alias("e")).distinct()
    sizes = once.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    sized = once.join(sizes, "u")
    small = sized.where((F.col("n") > 1) & (F.col("n") <= most_per_unit)).groupBy("u").agg(F.sort_array(F.collect_list("e")).alias("l"))
    at = F.transform(F.sequence(F.lit(0), F.size("l") - 2), lambda i: F.struct(i.alias("i")))
    pairs = small.select("l", F.explode(at).alias("x")).select(
        F.get("l", F.col("x.i")).alias("source"), F.explode(F.slice("l", F.col("x.i") + 2, F.size("l"))).alias("target")
    )
    parts = F.ceil(F.col("n") / most_per_unit).cast("int")
    large = sized.where(F.col("n") > most_per_unit).select("u", "e", F.pmod(F.xxhash64("e"), parts).cast("int").alias("own"), F.sequence(F.lit(0), parts - 1).alias("others"))
    first = large.select("u", F.col("own").alias("a"), F.explode("others").alias("b"), F.col("e").alias("source"))
    second = large.select("u", F.explode("others").alias("a"), F.col("own").alias("b"), F.col("e").alias("target"))
    crossed = first.join(second, ["u", "a", "b"]).where("source < target").select("source", "target")
    links = pairs.unionByName(crossed)
    return links.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def neighbourhood(edges: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """Edges with one of the names at either end: a union of two semi joins instead of a join on OR."""
    wanted = names.select(F.col(name).alias("__n")).distinct()
    at_source = edges.join(wanted, edges["source"] == wanted["__n"], "left_semi")
    at_target = edges.join(wanted, edges["target"] == wanted["__n"], "left_semi")
    return at_source.unionByName(at_target).distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, component: connected components, named by their smallest node.

    Every round moves each node to the smallest label around it and then to that label's own label, so that a path
    of n nodes takes about log n rounds; lineage is cut each round. Labels that not even ``rounds`` rounds settle raise an
    error. A node of very many edges, or the label of a giant component, is no hot key: see ``looked_up``. Loops and
    repeated edges don't matter; null ends are left out.
    """
    both = edges.where("source is not null and target is not null").select("source", "target")
    both = cut(both.unionByName(both.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct())
    hubs = cut(hot_keys(both, "target"))
    labels = cut(both.select(F.col("source").alias("node")).distinct().withColumn("component", F.col("node")))
    for _ in range(rounds):
        around = looked_up(both, "target", labels.withColumnRenamed("node", "target"), hot=hubs).groupBy("source").agg(F.min("component").alias("near"))
        moved = cut(
            labels.alias("l").join(around.alias("a"), F.col("l.node") == F.col("a.source"), "left").select(
                "node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component")
            )
        )
        jump = moved.select(F.col("node").alias("__at"), F.col("component").alias("next")).withColumnRenamed("__at", "component")
        stepped = cut(looked_up(moved, "component", jump).select("node", "old", F.least("component", F.coalesce("next", "component")).alias("component")))
        labels = stepped.select("node", "component")
        if not stepped.where("old != component").limit(1).count():
            return labels
    raise RuntimeError(f"the components have not settled in {rounds} rounds")


def top_entities(df: DataFrame, query: str, query_text: str, names: DataFrame, name: str, k: int = 10) -> DataFrame:
    """query, name, hits, rank: entities by the number of the query's words that their name holds, those with any.

    Words of queries and names meet in an equi-join; ties go to the name in order.
    """
    words = df.select(query, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(query_text), F.lit("([a-z0-9]{3,})"), F.lit(1)))).alias("w")).distinct()
    parts = names.select(name, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9]{3,})"), F.lit(1)))).alias("w")).distinct()
    hits = words.join(parts, "w").groupBy(query, name).agg(F.count(F.lit(1)).alias("hits"))
    order = Window.partitionBy(query).orderBy(F.desc("hits"), name)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def local_context(
    found: DataFrame, query: str, entities: DataFrame, edges: DataFrame, reports: DataFrame, most: tuple[int, int, int] = (5, 10, 3), tokens: int = 2000
) -> DataFrame:
    """query, context: what a graph knows about the entities found for each query, of at most 2 * tokens characters.

    found has query, name and rank; entities name, type, description; edges source, target, description; reports name and
    report. The first entities by rank are described, then the first relations at either end of any of them by name, then
    the reports. Each limit is a window that keeps so many rows a query and task.
    """

    def first(rows: DataFrame, order: list, n: int, line: Column, part: int, head: Column) -> DataFrame:
        at = Window.partitionBy(query).orderBy(*order)
        numbered = rows.withColumn("__n", F.row_number().over(at)).where(F.col("__n") <= n)
        return numbered.select(query, F.struct(F.lit(part).alias("part"), F.col("__n").alias("n"), head.alias("head"), line.alias("line")).alias("x"))

    described = first(
        found.join(entities, "name", "left"), [F.col("rank"), F.col("name")], most[0],
        F.concat(F.lit("- **"), F.col("name"), F.lit("** ("), F.coalesce("type", F.lit("N/A")), F.lit(")"), F.coalesce(F.concat(F.lit("\n  "), F.left("description", F.lit(300))), F.lit(""))),
        0, F.lit("## Entities\n"),
    )
    ends = found.select(query, "name")
    near = ends.join(edges, F.col("name") == F.col("source")).unionByName(ends.join(edges, F.col("name") == F.col("target"))).drop("name").distinct()
    related = first(
        near, [F.col("source"), F.col("target")], most[1],
        F.concat(F.lit("- "), F.col("source"), F.lit(" → "), F.col("target"), F.lit(": "), F.coalesce(F.left("description", F.lit(200)), F.lit(""))), 1, F.lit("\n## Relations\n"),
    )
    told = first(ends.join(reports, "name").select(query, "report").distinct(), [F.col("report")], most[2], F.left("report", F.lit(500)), 2, F.lit("\n## Reports\n"))
    lists = described.unionByName(related).unionByName(told).groupBy(query).agg(F.array_sort(F.collect_list("x")).alias("l"))
    lines = F.transform("l", lambda x: F.when(x["n"] == 1, F.concat(x["head"], x["line"])).otherwise(x["line"]))
    return lists.select(query, F.left(F.array_join(lines, "\n"), F.lit(2 * tokens)).alias("context"))
