"""Problem 7: documents of varying length in containers of fixed capacity.

Documents are measured by a public tokenizer inside the tasks. Items are dealt at random into blocks of a bounded
number of items; each block is filled in the order of arrival and then improved by local search: documents are
moved, exchanged one for one or two for one between underfull containers, each step increasing the sum of squared
fills, until containers empty. What is still underfull is dealt into new, fewer blocks and searched again. No
block grows with the data, and full containers never move again.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.runtime import cut

_ENCODERS: dict[str, object] = {}


def _encoder(path: str):  # noqa: ANN202
    """The tokenizer of a ranks file, loaded once in each Python worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding(
            path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _ENCODERS[path]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_count(text: Column, ranks_path: str) -> Column:
    """Number of tokens of a text; null for null. Texts are encoded whole, whatever their length."""

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(ranks_path).encode_ordinary
        for batch in texts:
            yield batch.map(lambda t: None if t is None else len(encode(t))).astype("Int64")

    return count(text)


class Bins:
    """Containers of one block: the size of each item, the container it lies in and the fill of each."""

    def __init__(self, sizes: np.ndarray, bins: np.ndarray, capacity: int):
        self.size, self.bin, self.capacity = sizes, bins.copy(), capacity
        self.fill = np.bincount(bins, weights=sizes).astype(np.int64) if len(bins) else np.zeros(0, np.int64)

    @classmethod
    def filled(cls, sizes: np.ndarray, capacity: int) -> Bins:
        """Each item, as it arrives, into the fullest container it fits in; rooms is a bitmap of free rooms."""
        at_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        rooms, n = 0, 0
        bins = np.zeros(len(sizes), dtype=np.int64)
        for i, s in enumerate(sizes.tolist()):
            fitting = rooms >> s
            if fitting:
                room = s + (fitting & -fitting).bit_length() - 1
                b = at_room[room].pop()
                if not at_room[room]:
                    rooms &= ~(1 << room)
            else:
                b, room, n = n, capacity, n + 1
            bins[i] = b
            at_room[room - s].append(b)
            rooms |= 1 << (room - s)
        return cls(sizes, bins, capacity)

    def _put(self, item: int, to: int) -> None:
        self.fill[self.bin[item]] -= self.size[item]
        self.fill[to] += self.size[item]
        self.bin[item] = to

    def improve(self, full: int, passes: int) -> None:
        """Local search among the containers filled less than full, until a pass changes nothing."""
        for _ in range(passes):
            open_bins = np.flatnonzero((self.fill > 0) & (self.fill < full))
            if len(open_bins) < 2:
                return
            items = np.flatnonzero(np.isin(self.bin, open_bins))
            changed = False
            for donor in open_bins[np.argsort(self.fill[open_bins], kind="stable")]:
                for item in items[self.bin[items] == donor]:
                    changed |= self._place(int(item), int(donor), items)
            if not changed:
                return

    def _place(self, item: int, donor: int, items: np.ndarray) -> bool:
        """Moves item out of donor, or exchanges it, where that raises the sum of squared fills most."""
        s = int(self.size[item])
        where = self.bin[items]
        other = (where != donor) & (self.fill[where] >= self.fill[donor]) & (self.fill[where] < self.capacity)
        theirs = items[other]
        if not len(theirs):
            return False
        at = self.bin[theirs]
        room = self.capacity - self.fill[at]
        fits = room >= s
        if fits.any():  # a move, into the container it fills best
            self._put(item, int(at[fits][np.argmin(room[fits])]))
            return True
        # one for one: a smaller item comes back; the best exchange moves most into the fuller container
        gain = s - self.size[theirs]
        good = (gain > 0) & (gain <= room)
        best, value = -1, 0
        if good.any():
            score = np.where(good, gain * (self.fill[at] - self.fill[donor] + gain), -1)
            best = int(np.argmax(score))
            value = int(score[best])
        pair = self._two_for_one(s, donor, theirs, at, room, value)
        if pair is not None:
            first, second, to = pair
            self._put(item, to)
            self._put(first, donor)
            self._put(second, donor)
            return True
        if best >= 0:
            to = int(at[best])
            self._put(int(theirs[best]), donor)
            self._put(item, to)
            return True
        return False

    def _two_for_one(self, s: int, donor: int, theirs: np.ndarray, at: np.ndarray, room: np.ndarray, value: int):  # noqa: ANN202
        """Two neighbours in size of one container for the item, if better than value and donor takes them."""
        order = np.lexsort((self.size[theirs], at))
        t, b, r = theirs[order], at[order], room[order]
        best = None
        for step in (1, 2):
            if len(t) <= step:
                break
            both = self.size[t[:-step]] + self.size[t[step:]]
            gain = s - both
            good = (b[:-step] == b[step:]) & (gain > 0) & (gain <= r[:-step])
            if good.any():
                score = np.where(good, gain * (self.fill[b[:-step]] - self.fill[donor] + gain), -1)
                k = int(np.argmax(score))
                if score[k] > value:
                    value, best = int(score[k]), (int(t[k]), int(t[k + step]), int(b[k]))
        return best


def _searcher(r: int, capacity: int, full: int, passes: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What is done with one block in round r."""

    def search(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("row").reset_index(drop=True)
        sizes = block["n_tokens"].to_numpy(dtype=np.int64)
        if r == 0:
            bins = Bins.filled(sizes, capacity)
        else:
            bins = Bins(sizes, pd.factorize(block["container"])[0].astype(np.int64), capacity)
        bins.improve(full, passes)
        number = block["block"].iloc[0] if len(block) else 0
        block["container"] = [f"{r}-{number}-{b}" for b in bins.bin]
        block["fill"] = bins.fill[bins.bin]
        return block.drop(columns=["block"])

    return search


def pack(
    df: DataFrame,
    id_col: str,
    text_col: str,
    capacity: int = 1024,
    ranks_path: str | None = None,
    block_items: int = 4096,
    full_share: float = 0.995,
    rounds: int = 4,
    passes: int = 12,
) -> DataFrame:
    """One row per piece: container, <id_col>, piece_no, n_pieces, start_token, n_tokens.

    Only a document of more than capacity tokens is divided, into pieces of capacity tokens and a rest. Documents
    whose text is null, empty or without any token take no room and give no row; repeated rows are packed each
    time. capacity, block_items, full_share (the fill from which a container is left alone), rounds (of dealing
    anew) and passes (of the local search) are parameters of the search; none of them drops a document.
    """
    path = ranks_path or default_ranks()
    kind = df.schema[id_col].dataType.simpleString()
    sized = cut(
        df.select(F.col(id_col).alias("id"), token_count(F.col(text_col), path).alias("tokens"))
        .where("tokens > 0")
        .withColumn("n_pieces", F.ceil(F.col("tokens") / capacity).cast("int"))
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
        .select(
            "id", "n_pieces", "piece_no",
            (F.col("piece_no") * capacity).cast("bigint").alias("start_token"),
            F.least(F.lit(capacity), F.col("tokens") - F.col("piece_no") * capacity).cast("int").alias("n_tokens"),
        )
        .withColumn("row", F.monotonically_increasing_id())
    )
    columns = f"id {kind}, n_pieces int, piece_no int, start_token bigint, n_tokens int"
    whole = sized.where(F.col("n_tokens") == capacity).select(
        F.concat(F.lit("w-"), F.col("row").cast("string")).alias("container"), *[c.split()[0] for c in columns.split(", ")]
    )
    full = int(capacity * full_share)
    left = sized.where(F.col("n_tokens") < capacity).withColumn("container", F.lit(None).cast("string"))
    done = [whole]
    n_left = left.count()
    for r in range(rounds):
        if not n_left:
            break
        blocks = max(1, -(-n_left // block_items))
        # items of one container stay together; those without one are dealt one by one
        dealt = left.withColumn(
            "block", F.pmod(F.xxhash64(F.coalesce(F.col("container"), F.col("row").cast("string")), F.lit(r)), F.lit(blocks))
        )

        searched = cut(
            dealt.repartition(min(blocks, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block")
            .groupBy("block")
            .applyInPandas(_searcher(r, capacity, full, passes), columns + ", row bigint, container string, fill bigint")
        )
        last = r == rounds - 1 or blocks == 1
        kept = searched if last else searched.where(F.col("fill") >= full)
        done.append(kept.select("container", *[c.split()[0] for c in columns.split(", ")]))
        if last:
            break
        left = searched.where(F.col("fill") < full).drop("fill")
        n_left = left.count()
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("id", id_col)
