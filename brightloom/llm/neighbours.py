"""Problem 2: the most similar vectors of every vector, by additive quantisation.

A vector is the sum of one codeword from each of several full-dimensional codebooks. The codebooks are fitted on a
bounded sample: each on what the ones before leave over, then all together by least squares. Encoding is a beam
search over the codebooks; the first one or two codes are the cell a vector lies in, and the best hypotheses of
the same beam are the cells a query looks into. In a cell, candidates are scored with lookup tables of the query
and the stored norms, and the best of them are reranked exactly.

Vectors that are equal are searched once and share the result. Cells are numbered so that similar ones follow each
other, and the index is stored by groups of such cells in the folder that all executors share. A task has a bounded
part of a group's vectors as queries and reads the other groups in place, so that what is moved and stored does not
grow with the number of cells that a query looks into. The index is removed when the search has ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.runtime import cut, remove_folder, shared_folder


#: Similar cells that are stored and read together.
GROUP = 8


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has the size, only finite values and any that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@F.pandas_udf(T.BinaryType())
def unit_bytes(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The vector divided by its length, as 32-bit floats; in between, 64 bits keep tiny and huge values whole."""
    for batch in vectors:
        if not len(batch):
            yield pd.Series([], dtype=object)
            continue
        x = np.stack([np.asarray(v, dtype=np.float64) for v in batch])
        x /= np.abs(x).max(axis=1, keepdims=True)
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        yield pd.Series([r.tobytes() for r in x])


def matrix(values, size: int) -> np.ndarray:  # noqa: ANN001
    return np.frombuffer(b"".join(values), dtype=np.float32).reshape(-1, size)


def _clusters(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k centres of x by Lloyd's rounds; centres without points start anew at a far point."""
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.empty(len(x), dtype=np.int64)
        far = np.empty(len(x), dtype=np.float32)
        half = (centres**2).sum(axis=1) / 2
        for a in range(0, len(x), 8192):
            d = half - x[a : a + 8192] @ centres.T
            near[a : a + 8192] = d.argmin(axis=1)
            far[a : a + 8192] = d.min(axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres).astype(np.float32)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            centres[empty] = x[np.argsort(far)[-len(empty) :]]
    return centres


def _line(c: np.ndarray) -> np.ndarray:
    """The rows of c in an order in which neighbours are similar: halved at the median of their main direction, again and again."""
    if len(c) < 3:
        return np.arange(len(c))
    centred = c - c.mean(axis=0)
    along = np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")
    half = len(c) // 2
    return np.concatenate([along[:half][_line(c[along[:half]])], along[half:][_line(c[along[half:]])]])


class Codebooks:
    """Additive codebooks: the first ``cell_levels`` of them make up the cell; cells of similar number are similar."""

    def __init__(self, books: list[np.ndarray], cell_levels: int):
        self.books, self.cell_levels = books, cell_levels
        self.place = [np.argsort(_line(b)) for b in books[:cell_levels]]
        self.cross = {(a, b): books[a] @ books[b].T for b in range(len(books)) for a in range(b)}
        self.half = [(c**2).sum(axis=1) / 2 for c in books]

    @classmethod
    def fit(cls, x: np.ndarray, sizes: list[int], cell_levels: int, beam: int, seed: int = 7) -> Codebooks:
        rng = np.random.default_rng(seed)
        books, left = [], x.copy()
        for k in sizes:
            c = _clusters(left, k, rng)
            d = (c**2).sum(axis=1) / 2
            for a in range(0, len(left), 8192):
                left[a : a + 8192] -= c[(d - left[a : a + 8192] @ c.T).argmin(axis=1)]
            books.append(c)
        found = cls(books, cell_levels)
        # all residual codebooks together, for the codes that the beam chooses
        codes = np.concatenate([found.encode(x[a : a + 512], beam)[0] for a in range(0, len(x), 512)])
        rest = x - sum(books[m][codes[:, m]] for m in range(cell_levels))
        widths = [len(b) for b in books[cell_levels:]]
        at = np.concatenate([[0], np.cumsum(widths)])
        normal = np.zeros((at[-1], at[-1]), dtype=np.float64)
        right = np.zeros((at[-1], x.shape[1]), dtype=np.float64)
        for i in range(len(widths)):
            ci = codes[:, cell_levels + i]
            np.add.at(right, at[i] + ci, rest)
            for j in range(len(widths)):
                np.add.at(normal, (at[i] + ci, at[j] + codes[:, cell_levels + j]), 1.0)
        solved = np.linalg.solve(normal + np.eye(at[-1]), right + np.concatenate(books[cell_levels:]))
        fitted = [solved[at[i] : at[i + 1]].astype(np.float32) for i in range(len(widths))]
        return cls([*books[:cell_levels], *fitted], cell_levels)

    def encode(self, x: np.ndarray, beam: int, levels: int | None = None, looks: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the best hypothesis, squared norm of its sum, and the best cells, by beam search.

        looks: how many cells are wanted, where that is more than the beam; the beam is so wide up to the cell only.
        """
        n = len(x)
        levels = levels or len(self.books)
        cost = np.zeros((n, 1), dtype=np.float32)  # |sum|^2 / 2 - x.sum of each hypothesis
        codes = np.zeros((n, 1, 0), dtype=np.int32)
        cells = None
        for m in range(levels):
            k = len(self.books[m])
            step = self.half[m] - x @ self.books[m].T
            total = cost[:, :, None] + step[:, None, :]
            for j in range(m):
                total = total + self.cross[j, m][codes[:, :, j]]
            flat = total.reshape(n, -1)
            width = min(max(beam, looks) if m < self.cell_levels else beam, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            score = np.take_along_axis(flat, best, axis=1)
            order = np.argsort(score, axis=1, kind="stable")
            best, cost = np.take_along_axis(best, order, axis=1), np.take_along_axis(score, order, axis=1)
            parent, code = best // k, best % k
            kept = np.take_along_axis(codes, parent[:, :, None], axis=1) if m else np.zeros((n, width, 0), dtype=np.int32)
            codes = np.concatenate([kept, code[:, :, None].astype(np.int32)], axis=2)
            if m == self.cell_levels - 1:
                cells = codes.copy()
                cost, codes = cost[:, :beam], codes[:, :beam]
        top = codes[:, 0]
        near = x * 0 + sum(self.books[m][top[:, m]] for m in range(levels))
        return top, (near**2).sum(axis=1), cells

    def cell_number(self, codes: np.ndarray) -> np.ndarray:
        number = np.zeros(codes.shape[:-1], dtype=np.int64)
        for m in range(self.cell_levels):  # a group of cells never lies across two codes of the level before
            number = number * (-(-len(self.books[m]) // GROUP) * GROUP) + self.place[m][codes[..., m]]
        return number


def plan_sizes(n: int, per_cell: int, residual_levels: int, sample: int) -> tuple[list[int], int]:
    """Sizes of the codebooks for n vectors, and how many of them make the cell."""
    cells = max(1, n // per_cell)
    most = max(1, sample // 16)  # a centre needs some sampled vectors
    if cells <= most:
        return [cells] + [256] * residual_levels, 1
    first = min(most, int(np.ceil(np.sqrt(cells))))
    return [first, min(most, -(-cells // first))] + [256] * residual_levels, 2


def _stored(column: pa.ChunkedArray, dtype: str, length: int) -> np.ndarray:
    """A binary column whose values all hold ``length`` numbers of dtype, as a table of numbers."""
    rows = [np.frombuffer(c.buffers()[2], dtype=dtype).reshape(-1, length)[c.offset : c.offset + len(c)] for c in column.chunks if len(c)]
    return np.concatenate(rows) if rows else np.empty((0, length), dtype=dtype)


def _batches(folder: str, near: int, columns: list[str], rows: int) -> Iterator[pa.Table]:
    """What the stored index holds of a group of cells, a bounded number of rows at a time, in the same order for all tasks."""
    files, path = fs.FileSystem.from_uri(folder)
    found = files.get_file_info(fs.FileSelector(f"{path}/near={near}", allow_not_found=True))
    for name in sorted(f.path for f in found if f.path.endswith(".parquet")):
        with files.open_input_file(name) as opened:
            for batch in pq.ParquetFile(opened).iter_batches(batch_size=rows, columns=columns, use_threads=False):
                yield pa.Table.from_batches([batch])


class _Nearest:
    """The best items found so far of each query of a task, and what a further one must reach to be among them."""

    def __init__(self, n: int, keep: int, least: float):
        self.keep, self.low, self.held = keep, np.full(n, least - 1e-6, dtype=np.float32), 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, dtype=np.int64), np.empty(0, dtype="V16"), np.empty(0, dtype=np.float32))]

    def add(self, at: np.ndarray, value: np.ndarray, hashes: np.ndarray, may: Callable[[np.ndarray], np.ndarray]) -> None:
        """Cosines of the queries ``at`` and of all items of ``hashes``; may: which items are candidates of some of these queries.

        Only where an item reaches a query's limit it matters which are its candidates.
        """
        row = np.flatnonzero(value.max(axis=1) >= self.low[at])
        if not len(row):
            return
        at, value = at[row], np.where(may(row), value[row], np.float32(-2))
        hit = np.flatnonzero(value >= self.low[at][:, None])
        if len(hit) > self.keep * len(at):  # the best of these items alone set a limit to the others
            self.low[at] = np.maximum(self.low[at], np.partition(value, -self.keep, axis=1)[:, -self.keep])
            hit = np.flatnonzero(value >= self.low[at][:, None])
        row, column = hit // len(hashes), hit % len(hashes)
        self.parts.append((at[row], hashes[column], value[row, column]))
        self.held += len(hit)
        if self.held > 2_000_000:
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, hash of the item and cosine of the first ``keep``, best first."""
        query, item, cosine = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((item.view(">u8").reshape(-1, 2)[:, 0], -cosine, query))
        query, item, cosine = query[order], item[order], cosine[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)  # among those of the query
        last = place == self.keep - 1
        self.low[query[last]] = np.maximum(self.low[query[last]], cosine[last])
        kept = place < self.keep
        self.parts, self.held = [(query[kept], item[kept], cosine[kept])], 0
        return self.parts[0]


def most_similar(
    vectors: DataFrame,
    id_col: str,
    vector_col: str,
    queries: DataFrame | None = None,
    query_id: str = "id",
    query_vector: str = "vector",
    k: int = 10,
    least: float = -1.0,
    size: int = 64,
    probes: int = 10,
    rerank: int = 320,
    per_cell: int = 1024,
    residual_levels: int = 4,
    beam: int = 10,
    sample: int = 40_000,
    block: int = 16_384,
) -> DataFrame:
    """The k most similar vectors, by cosine, of every vector and of every query: is_query, id, neighbour, cosine, place.

    is_query tells the queries' rows (true) from those of the vectors themselves (false), which are no neighbours
    of their own. Neighbours below the cosine ``least`` are left out. Vectors that are null, of another size, all
    zero or not finite match nothing; rows with the same id count once; null ids are left out; ties go to the
    smaller id; an empty table gives no rows. probes: cells a query looks into, and
    1.6 times the root of the number of cells where that is more; rerank: candidates of a cell that
    are scored exactly; sample: vectors the codebooks are fitted on; block: most rows of one side in a task. Every
    vector is indexed; what the probes miss is the loss of accuracy.
    """
    spark = vectors.sparkSession

    def ready(df: DataFrame, key: str, vector: str, is_query: bool) -> DataFrame:
        rows = df.select(F.col(key).cast("string").alias("id"), F.col(vector).alias("v"))
        rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"), size))
        return rows.select(F.lit(is_query).alias("is_query"), "id", unit_bytes("v").alias("vec"))

    given = ready(vectors, id_col, vector_col, False)
    if queries is not None:
        given = given.unionByName(ready(queries, query_id, query_vector, True))
    given = given.withColumn("h", F.unhex(F.md5("vec")))
    # ids meet by the hash of their vector; the vector itself is read again where it is needed, so that it is moved but twice
    rows = cut(given.groupBy("is_query", "id").agg(F.min("h").alias("h")))
    n = rows.where("not is_query").count()
    fields = "is_query boolean, id string, neighbour string, cosine double, place int"
    if not n:
        return spark.createDataFrame([], fields)
    held = rows.select("is_query", "h").distinct()
    drawn = F.xxhash64("h")
    items = held.where("not is_query")
    last = items.select(drawn.alias("drawn")).orderBy("drawn").limit(sample).agg(F.max("drawn")).first()[0]
    chosen = given.where(~F.col("is_query") & (drawn <= last)).join(items.where(drawn <= last).select("h"), "h", "left_semi")
    chosen = chosen.groupBy("h").agg(F.any_value("vec").alias("vec")).orderBy(drawn, "h").select("vec").toPandas()
    x = matrix(chosen["vec"], size)
    sizes, cell_levels = plan_sizes(n, per_cell, residual_levels, len(x))
    looks = max(probes, int(np.ceil(1.6 * np.sqrt(np.prod(sizes[:cell_levels])))))
    books = Codebooks.fit(x, sizes, cell_levels, beam)
    sent = spark.sparkContext.broadcast(books)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = sent.value
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch.iloc[a : a + 1024]
                codes, norms, _ = books.encode(matrix(part["vec"], size), beam)
                cell = books.cell_number(codes)
                yield pd.DataFrame(
                    {
                        "is_query": part["is_query"].to_numpy(), "h": part["h"].to_numpy(), "vec": part["vec"].to_numpy(),
                        "codes": [c.tobytes() for c in codes.astype(np.int32)], "norm": norms, "cell": cell, "near": cell // GROUP,
                    }
                )

    # the index: every distinct vector once, by groups of cells, where all tasks can read it
    index = (
        given.groupBy("is_query", "h").agg(F.any_value("vec").alias("vec")).join(held, ["is_query", "h"], "left_semi")
        .mapInPandas(encoded, "is_query boolean, h binary, vec binary, codes binary, norm float, cell bigint, near bigint")
    )
    folder = shared_folder(spark)
    try:
        stored = index.hint("rebalance", "near").sortWithinPartitions("near", "cell").write.partitionBy("near")
        stored.option("parquet.enable.dictionary", "false").parquet(folder, compression="uncompressed")
        groups = spark.read.schema("near bigint").parquet(folder).groupBy("near").count().collect()
        units = [(near, b, blocks) for near, rows_of in sorted(groups) for blocks in [-(-rows_of // block)] for b in range(blocks)]

        def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for near, part, parts in batch.itertuples(index=False):
                    yield _searched(sent.value, folder, near, part, parts, size, k, least, beam, looks, rerank, block)

        work = spark.sparkContext.parallelize(units, len(units)).toDF("near bigint, part int, parts int")
        hits = cut(work.mapInPandas(searched, "is_query boolean, h binary, found binary, cosine array<float>"))
    finally:
        remove_folder(spark, folder)
    return _expanded(rows, hits, k, least)


def _searched(
    books: Codebooks, folder: str, near: int, part: int, parts: int, size: int, k: int, least: float, beam: int, looks: int, rerank: int, block: int
) -> pd.DataFrame:
    """A row for each query of a part of a group: the hashes of what its cells hold that is nearest, one after the other, and the cosines."""
    mine, seen = [], 0
    for table in _batches(folder, near, ["is_query", "h", "vec"], block):
        mine.append(table.take(np.flatnonzero((seen + np.arange(len(table))) % parts == part)))
        seen += len(table)
    mine = pa.concat_tables(mine)
    x = _stored(mine["vec"], "f4", size)
    levels = books.cell_levels
    cells = np.concatenate([books.cell_number(books.encode(x[a : a + 1024], beam, levels, looks)[2])[:, :looks] for a in range(0, len(x), 1024)])
    asked, asker = cells.ravel(), np.repeat(np.arange(len(x)), cells.shape[1])
    order = np.argsort(asked, kind="stable")
    asked, asker = asked[order], asker[order]
    nearest = _Nearest(len(x), k + 1, least)
    for other in sorted(np.unique(asked // GROUP), key=lambda g: (abs(g - near), g)):  # the likeliest first
        for items in _batches(folder, other, ["is_query", "h", "vec", "codes", "norm", "cell"], block):
            items = items.filter(pc.invert(items["is_query"]))
            cell, y = items["cell"].to_numpy(), _stored(items["vec"], "f4", size)
            hashes, half = _stored(items["h"], "V16", 1)[:, 0], items["norm"].to_numpy() / 2
            codes = _stored(items["codes"], "i4", len(books.books))
            for c in np.unique(cell):
                askers = asker[np.searchsorted(asked, c) : np.searchsorted(asked, c, side="right")]
                if not len(askers):
                    continue
                here = cell == c
                y_c, half_c, hashes_c, keep = y[here], half[here], hashes[here], min(rerank, int(here.sum()))
                coded = sum(b[codes[here, m]] for m, b in enumerate(books.books))
                for a in range(0, len(askers), 256):
                    q = x[askers[a : a + 256]]

                    def may(row: np.ndarray, q=q, coded=coded, half_c=half_c, keep=keep) -> np.ndarray:  # noqa: ANN001
                        """The items of the best scores; a query's table entries add up to its product with the sum of the codewords."""
                        score = half_c - q[row] @ coded.T
                        return score <= np.partition(score, keep - 1, axis=1)[:, keep - 1 : keep]

                    nearest.add(askers[a : a + 256], q @ y_c.T, hashes_c, may)
    query, item, cosine = nearest.best()
    first = np.flatnonzero(np.diff(query, prepend=-1))
    ends = np.append(first[1:], len(query))
    found = mine.take(query[first])
    return pd.DataFrame({
        "is_query": found["is_query"].to_numpy(), "h": found["h"].to_pandas(),
        "found": pd.Series([item[a:b].tobytes() for a, b in zip(first, ends)], dtype=object),
        "cosine": pd.Series([cosine[a:b] for a, b in zip(first, ends)], dtype=object),
    })


def _expanded(rows: DataFrame, hits: DataFrame, k: int, least: float) -> DataFrame:
    """From distinct vectors to ids: every holder of a query vector gets the first k holders of the vectors found."""
    by_id = Window.partitionBy("found").orderBy("holder")
    holders = (
        rows.where("not is_query")
        .select(F.col("h").alias("found"), F.col("id").alias("holder"))
        .withColumn("rank", F.row_number().over(by_id))
        .where(F.col("rank") <= k + 1)
        .drop("rank")
    )
    nearest = Window.partitionBy("is_query", "h").orderBy(F.desc("cosine"), "holder")
    # what the cells found of a query meets packed; vectors that tie with the last one all stay, as their holders decide
    best = (
        hits.repartition("is_query", "h")
        .select("is_query", "h", F.col("found").alias("all"), F.posexplode("cosine").alias("i", "cosine"))
        .select("is_query", "h", F.substring("all", F.col("i") * 16 + 1, F.lit(16)).alias("found"), F.col("cosine").cast("double").alias("cosine"))
        .where(F.round("cosine", 6) >= least)
        .withColumn("rank", F.rank().over(Window.partitionBy("is_query", "h").orderBy(F.desc("cosine"))))
        .where(F.col("rank") <= k + 1)
        .drop("rank")
    )
    lists = (
        best.join(holders, "found")
        .withColumn("rank", F.row_number().over(nearest))
        .where(F.col("rank") <= k + 1)
        .groupBy("is_query", "h")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "holder", "cosine"))).alias("near"))
    )
    own = F.filter("near", lambda x: F.col("is_query") | (x["holder"] != F.col("id")))
    return (
        rows.select("is_query", "id", "h")
        .join(lists, ["is_query", "h"])
        .select("is_query", "id", F.posexplode(F.slice(own, 1, k)).alias("place", "x"))
        .select(
            "is_query", "id", F.col("x.holder").alias("neighbour"), F.col("x.cosine").alias("cosine"), (F.col("place") + 1).cast("int").alias("place")
        )
    )
