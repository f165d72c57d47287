"""Exact nearest neighbours of a stated query set, in blocks, by matrix products inside the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions.text import strip

#: Query vectors that are sent to every task at once; more queries meet the table block by block.
BLOCK = 4096
#: Rows that are scored at once.
ROWS = 32_768


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "dot":
        return q @ x.T
    if metric == "cosine":
        nq, nx = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
        return (q / np.where(nq < 1e-10, 1, nq)[:, None]) @ (x / np.where(nx < 1e-10, 1, nx)[:, None]).T
    square = (q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :] - 2 * q @ x.T
    return 1 / (1 + np.sqrt(np.maximum(square, 0)))


def top_k(
    df: DataFrame,
    id_col: str,
    vector_col: str,
    queries: DataFrame,
    k: int,
    metric: str = "cosine",
    min_score: float | None = None,
    same: str | None = None,
) -> DataFrame:
    """query_id, <id_col>, score, rank: the k best of every query, of them those of at least min_score.

    queries has query_id, query_vector and, with ``same``, query_<same>: only rows that agree with the query in
    that column are ranked. The limit comes before the score floor, and ranks count what passes the floor. Ties go
    to the smaller id. Null vectors and vectors of another size than the query's are no candidates; null or empty
    query vectors find nothing; empty tables give no rows. Of every ROWS rows k are kept a query and shuffled. Up to BLOCK
    queries are sent to the tasks, more meet the table in blocks, part against part.
    """
    keys = ["query_id", "query_vector", *([f"query_{same}"] if same else [])]
    wanted = queries.select(*keys).where(F.size("query_vector") > 0)
    n_queries = wanted.count()
    kind, query_kind = df.schema[id_col].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    slim = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), *([F.col(same).alias("s")] if same else [])).where(F.size("v") > 0)

    def best(asked: pd.DataFrame, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """The k best of the rows for each of the queries."""
        rows = rows.sort_values("id", kind="stable")
        lengths = rows["v"].map(len)
        for size, part in asked.groupby(asked["query_vector"].map(len)):
            mine = rows[lengths == size]
            if not len(mine):
                continue
            x, ids = np.stack(mine["v"]).astype(np.float64), mine["id"].to_numpy()
            for a in range(0, len(part), 256):
                some = part.iloc[a : a + 256]
                s = _scores(np.stack(some["query_vector"]).astype(np.float64), x, metric)
                if same:
                    s = np.where(some[f"query_{same}"].to_numpy()[:, None] == mine["s"].to_numpy()[None, :], s, -np.inf)
                s = np.round(s, 9)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(s, top, axis=1)
                r, c = np.nonzero(np.isfinite(value))
                yield pd.DataFrame({"query_id": some["query_id"].to_numpy()[r], id_col: ids[top[r, c]], "score": value[r, c]})

    fields = f"query_id {query_kind}, `{id_col}` {kind}, score double"
    if n_queries <= BLOCK:
        sent = df.sparkSession.sparkContext.broadcast(wanted.toPandas())

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            for batch in batches:
                held.append(batch)
                if sum(map(len, held)) >= ROWS:
                    yield from best(sent.value, pd.concat(held))
                    held = []
            if held:
                yield from best(sent.value, pd.concat(held))

        found = slim.mapInPandas(score, fields)
    else:  # every block of queries meets every block of rows under a key of their own
        blocks, row_blocks = -(-n_queries // BLOCK), max(1, -(-slim.count() // ROWS))

        def dealt(rows: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
            number = F.pmod(F.xxhash64(key, F.lit(own)), F.lit(n_own)).alias(own)
            return rows.select("*", number, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

        asked = dealt(wanted, "query_id", "q", blocks, "r", row_blocks).groupBy("q", "r")
        known = dealt(slim, "id", "r", row_blocks, "q", blocks).groupBy("q", "r")

        def meet(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            parts = list(best(asked, rows)) if len(asked) and len(rows) else []
            return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], id_col: [], "score": []})

        found = asked.cogroup(known).applyInPandas(meet, fields)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked if min_score is None else ranked.where(F.col("score") >= min_score)


def dedup_hits(df: DataFrame, text: str, score: str, id_col: str) -> DataFrame:
    """One row per stripped text, the one of the best score; ties and null scores go to the smaller id.

    The digest of the text is the key, and the best row is found by partial aggregation, so that a text held by
    a large part of the rows is combined before the shuffle. A null text is a text of its own.
    """
    best = F.max_by(F.struct(*df.columns), F.struct(F.coalesce(F.col(score), F.lit(float("-inf"))), (-F.col(id_col)).alias("i")))
    return df.groupBy(F.md5(strip(F.col(text))).alias("__key")).agg(best.alias("__row")).select("__row.*")
