"""Problem 8: passages of evaluation items that appear, wholly or partly, in documents.

Wu-Manber search for all windows of all items at once. Texts are folded by built-in functions to the bytes of
their letters and digits. A shift table over blocks of three bytes says how far a window may move on without
missing an occurrence; where it may not move, the hash of its last block selects the item windows that
can be there, narrowed by a hash of the window, and the bytes themselves are compared. Runs of confirmed windows
are joined, and an item counts as leaked where neighbouring runs hold enough of it. What many items have in common
is style rather than content, so a byte of an item weighs the less the more items hold the windows over it, and
never nothing; how many hold a window is counted over all items, by one aggregation.

Items of equal folded text are one pattern, and their ids come back by a join. The patterns are the bounded side:
they are collected in blocks of at most ``block_bytes`` folded bytes, and a task searches each batch of documents
for one block after the other. Documents are read and folded once, and never shuffled, grouped or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.llm.duplicates import NARROW, WIDE
from brightloom.runtime import cut

BLOCK = 3
TABLE_BITS = 18
LANE = 1024


def folded(text: Column) -> Column:
    """The UTF-8 bytes of the letters and digits, lower case, in narrow forms."""
    return F.encode(F.regexp_replace(F.lower(F.translate(text, WIDE, NARROW)), r"[^\p{L}\p{N}]", ""), "UTF-8")


def _slots(b0: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    code = (b0.astype(np.uint32) << 16) | (b1.astype(np.uint32) << 8) | b2
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)).astype(np.int64)


def _hashes(data: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(m):
        h = h * np.uint64(1099511628211) + data[at + j].astype(np.uint64) + np.uint64(1)
    return h


class Patterns:
    """The windows of m bytes of a block of items, with the tables that find them; weights: one per byte of the items.

    anchors: the windows that are sought, of all windows of the items one after the other; all, if not given.
    """

    def __init__(self, items: list[bytes], m: int, weights: np.ndarray | None = None, anchors: np.ndarray | None = None):
        self.m = m
        self.sizes = np.array([len(x) for x in items], dtype=np.int64)
        self.data = np.frombuffer(b"".join(items), dtype=np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.weight = np.ones(len(self.data), dtype=np.float32) if weights is None else weights
        total = np.concatenate([[0.0], np.cumsum(self.weight, dtype=np.float64)])
        self.whole = total[self.starts + self.sizes] - total[self.starts]
        self.heaviest = np.array([self.weight[a : a + n].max() if n else 1.0 for a, n in zip(self.starts, self.sizes)])
        counts = np.maximum(self.sizes - m + 1, 0)
        item = np.repeat(np.arange(len(items), dtype=np.int32), counts)
        offset = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        start = self.starts[item] + offset
        self.spare = np.zeros(len(items))  # the weight of the bytes that no anchor of an item covers
        if anchors is not None:
            item, offset, start = item[anchors], offset[anchors], start[anchors]
            edge = np.zeros(len(self.data) + 1, dtype=np.int32)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + m, -1)
            bare = np.concatenate([[0.0], np.cumsum(np.where(np.cumsum(edge[:-1]) > 0, 0.0, self.weight))])
            self.spare = bare[self.starts + self.sizes] - bare[self.starts]
        self.shift = np.full(1 << TABLE_BITS, m - BLOCK + 1, dtype=np.uint8 if m < 256 else np.int32)
        for j in range(m - BLOCK + 1):  # the last block, at distance 0, comes last and wins
            at = start + j
            np.minimum.at(self.shift, _slots(self.data[at], self.data[at + 1], self.data[at + 2]), m - BLOCK - j)
        # windows ordered by the bucket of their last block, then by a hash of the window
        key = self._keys(self.data, start)
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.offset = key[order], item[order], offset[order]

    def _keys(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        last = at + self.m - BLOCK
        bucket = _slots(data[last], data[last + 1], data[last + 2]).astype(np.uint64)
        return (bucket << np.uint64(44)) | (_hashes(data, at, self.m) >> np.uint64(20))

    def occurrences(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in data and numbers of the item windows there; texts lie at begin..end."""
        m = self.m
        lanes = np.maximum(end - begin - m + 1, 0)
        n_lanes = -(-lanes // LANE)
        text = np.repeat(np.arange(len(begin)), n_lanes)
        number = np.arange(n_lanes.sum()) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes)
        pos = begin[text] + number * LANE
        stop = np.minimum(pos + LANE, end[text] - m + 1)
        hits = []
        while len(pos):
            last = pos + m - BLOCK
            shift = self.shift[_slots(data[last], data[last + 1], data[last + 2])]
            hits.append(pos[shift == 0])
            pos = pos + np.maximum(shift, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        at = np.sort(np.concatenate(hits)) if hits else np.empty(0, dtype=np.int64)
        if not len(at):
            return at, at
        key = self._keys(data, at)
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        n = high - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        where = np.repeat(at, n)
        window = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = self.starts[self.item[window]] + self.offset[window]
        same = np.ones(len(where), dtype=bool)
        for j in range(m):
            same &= data[where + j] == self.data[first + j]
        return where[same], window[same]


def share_held(pos: np.ndarray, offset: np.ndarray, m: int, weight: np.ndarray, reach: float) -> tuple[float, int, int]:
    """Largest share of an item's weight in neighbouring runs, and where these begin and end in the text.

    pos and offset: of the confirmed windows of one item in one text, ordered by pos. Runs are neighbours while
    no more than reach times the item lies between them.
    """
    best, size = (0.0, 0, 0), len(weight)
    parts = np.flatnonzero(np.diff(pos) > reach * size + m) + 1
    for p, o in zip(np.split(pos, parts), np.split(offset, parts)):
        held = np.zeros(size + 1, dtype=np.int32)
        np.add.at(held, o, 1)
        np.add.at(held, o + m, -1)
        share = float(weight[np.cumsum(held[:-1]) > 0].sum() / weight.sum())
        if share > best[0]:
            best = (share, int(p[0]), int(p[-1] + m))
    return best


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a batch of folded texts, and where each begins and ends."""
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(values if values is not None else b"", dtype=np.uint8), offsets[:-1], offsets[1:]


def _all_windows(data: np.ndarray, begin: int, end: int, patterns: Patterns, items: np.ndarray) -> Iterator[tuple]:
    """(item, positions, offsets) of all windows of each of the items that the text at begin..end holds, ordered by position."""
    m = patterns.m
    at = np.arange(begin, end - m + 1)
    hashes = _hashes(data, at, m)
    for i in items.tolist():
        own = patterns.starts[i] + np.arange(patterns.sizes[i] - m + 1)
        mine = _hashes(patterns.data, own, m)
        order = np.argsort(mine, kind="stable")
        low, high = np.searchsorted(mine, hashes, "left", order), np.searchsorted(mine, hashes, "right", order)
        hit = np.flatnonzero(high > low)
        n = high[hit] - low[hit]
        pos = np.repeat(at[hit], n)
        offset = order[np.repeat(low[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        same = np.ones(len(pos), dtype=bool)
        for j in range(m):
            same &= data[pos + j] == patterns.data[own[offset] + j]
        yield i, pos[same], offset[same]


def _search(data: np.ndarray, begin: np.ndarray, end: np.ndarray, patterns: Patterns, reach: float, least: float) -> Iterator[tuple]:
    """(text, item, share, first byte, last byte) of the items that the texts at begin..end hold enough of."""
    m = patterns.m
    where, window = patterns.occurrences(data, begin, end)
    if not len(where):
        return
    pair = np.searchsorted(end, where, "right") * len(patterns.sizes) + patterns.item[window]
    pair, n = np.unique(pair, return_counts=True)
    text, item = pair // len(patterns.sizes), pair % len(patterns.sizes)
    # so many anchors, and all that no anchor covers, could make up the share
    enough = n * m * patterns.heaviest[item] + patterns.spare[item] >= least * patterns.whole[item]
    text, item = text[enough], item[enough]
    for t, a, b in zip(*_runs(text)):
        for i, pos, offset in _all_windows(data, int(begin[t]), int(end[t]), patterns, item[a:b]):
            weight = patterns.weight[patterns.starts[i] : patterns.starts[i] + patterns.sizes[i]]
            share, start, stop = share_held(pos, offset, m, weight, reach)
            if share >= least:
                yield int(t), i, share, start - int(begin[t]), stop - int(begin[t])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of the runs of an ordered array, and where each begins and ends."""
    first = np.flatnonzero(np.concatenate([[True], np.diff(values) != 0])) if len(values) else np.empty(0, dtype=np.int64)
    return values[first], first, np.append(first[1:], len(values))


def _weighed(texts: DataFrame, m: int) -> DataFrame:
    """Adds held: for every window of a text how many of all the texts hold it, in order of the windows."""
    each = texts.select("key", "folded", F.explode(F.sequence(F.lit(0), F.col("size") - m)).alias("at"))
    each = each.select("key", "at", F.xxhash64(F.substring("folded", F.col("at") + 1, F.lit(m))).alias("w"))
    holders = each.select("key", "w").distinct().groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    held = each.join(holders, "w").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("held"))
    return texts.join(held, "key").select("key", "folded", F.transform("held", lambda x: x["n"]).alias("held"))


def _patterns(rows: list, m: int, n_texts: int, rare: int, least: float) -> tuple[Patterns, list]:
    """A block of items with a weight for each of their bytes, and the keys of the items.

    A window that one text alone holds weighs 1, one that all hold 0.05, by the logarithm of the number of its holders
    between; a byte weighs as the lightest window over it. Anchors are the windows of up to ``rare`` holders, and all
    windows of the items whose other windows could make up the share ``least`` on their own.
    """
    weights, anchors = [], []
    for r in rows:
        held = np.array(r["held"], dtype=np.float64)
        weight = np.maximum(0.05, 1 - np.log(held) / np.log(n_texts + 1)).astype(np.float32)
        padded = np.concatenate([np.full(m - 1, 2, dtype=np.float32), weight, np.full(m - 1, 2, dtype=np.float32)])
        weights.append(np.lib.stride_tricks.sliding_window_view(padded, m).min(axis=1))
        common = np.concatenate([np.zeros(m - 1, dtype=bool), held > rare, np.zeros(m - 1, dtype=bool)])
        covered = np.lib.stride_tricks.sliding_window_view(common, m).any(axis=1)
        anchors.append((held <= rare) | (weights[-1][covered].sum() >= least * weights[-1].sum()))
    return Patterns([bytes(r["folded"]) for r in rows], m, np.concatenate(weights), np.concatenate(anchors)), [r["key"] for r in rows]


def leaked_passages(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 15,
    least: float = 0.4,
    reach: float = 1.0,
    rare: int = 3,
    block_bytes: int = 4_000_000,
    batch_bytes: int = 16_000_000,
) -> DataFrame:
    """One row per document and item of which the document reproduces at least the share ``least``.

    Columns: <doc_id>, <item_id>, share (of the weight of the item's letters and digits), first_byte and last_byte (of
    the runs in the folded document). Layout, case and punctuation don't count. An exchanged word or character takes
    the windows across it away, so half of an item with a few exchanges still holds 0.4 of it. window: bytes of a
    confirmed run (5 Chinese characters or 15 Latin letters). Items of fewer than two windows are searched with
    windows of 7 bytes, and items without at least 8 bytes of letters or digits can't be told from chance and give no
    rows. All ids that hold the same text give rows. Null ids and null or empty texts on either side give no rows; a
    repeated document gives its rows once per repetition, a repeated item counts once. Very long documents are searched
    whole. Windows that more than ``rare`` items hold are not sought where the others suffice to find an item, but count
    in its share. block_bytes bounds the patterns that a task holds, batch_bytes the documents it searches at once (a
    longer one is searched alone). None of the three changes the result.
    """
    spark = documents.sparkSession
    kind = documents.schema[doc_id].dataType.simpleString()
    item_kind = items.schema[item_id].dataType.simpleString()
    docs = documents.where(F.col(doc_id).isNotNull() & (F.length(doc_text) > 0)).select(
        F.col(doc_id).alias("doc"), folded(F.col(doc_text)).alias("folded")
    )
    known = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), folded(F.col(item_text)).alias("folded"))
    known = known.where(F.octet_length("folded") >= 8).select("item", F.md5("folded").alias("key"), "folded")
    texts = cut(known.groupBy("key").agg(F.any_value("folded").alias("folded")).withColumn("size", F.octet_length("folded")))
    empty = docs.limit(0).select(
        F.col("doc").alias(doc_id), F.lit(None).cast(item_kind).alias(item_id), F.lit(0.0).alias("share"),
        F.lit(0).cast("bigint").alias("first_byte"), F.lit(0).cast("bigint").alias("last_byte"),
    )
    sent = []
    for low, high, m in ((2 * window, None, window), (8, 2 * window, 7)):
        those = texts.where((F.col("size") >= low) & (F.col("size") < high if high else F.lit(True)))
        some = those.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
        if not some["n"]:
            continue
        blocks = -(-some["bytes"] // block_bytes)
        weighed = _weighed(those, m).withColumn("b", F.pmod(F.xxhash64("key"), F.lit(blocks)))
        weighed = cut(weighed) if blocks > 1 else weighed
        for b in range(blocks):
            rows = weighed.where(F.col("b") == b).collect()
            if rows:
                sent.append(spark.sparkContext.broadcast(_patterns(rows, m, some["n"], rare, least)))
    if not sent:
        return empty

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begin, end = _texts(batch.column(1))
            rows = []
            for block in sent:
                patterns, keys = block.value
                a = 0
                while a < len(begin):
                    to = max(a + 1, int(np.searchsorted(end, begin[a] + batch_bytes, "right")))
                    rows += [(t + a, keys[i], *found) for t, i, *found in _search(data, begin[a:to], end[a:to], patterns, reach, least)]
                    a = to
                if len(sent) > 1:  # the next block takes its place
                    vars(block).pop("_value", None)
            if rows:
                at, *columns = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(columns[0]), pa.array(columns[1], pa.float64()),
                     pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                    names=["doc", "key", "share", "first_byte", "last_byte"],
                )

    found = docs.mapInArrow(search, f"doc {kind}, key string, share double, first_byte bigint, last_byte bigint")
    ids = known.select("key", "item").distinct()
    return found.join(ids, "key").select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "share", "first_byte", "last_byte")
