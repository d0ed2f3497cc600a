"""Filling containers of fixed capacity by multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.common import col
from assaylake.llm.tokens import TOKENIZERS, VOCABULARY, token_counter

CAPACITY = 2048
#: Containers that one block fills; a block's items are partitioned together, so this and the number of items bound memory
#: and time, and what a block leaves unused is shared by that many containers.
BLOCK_CONTAINERS = 256
#: Items of one block at most: each holds two rows of a number for every container, 64 MB in all at 256 containers.
BLOCK_ITEMS = 16_384


def difference(sizes: Sequence[int], m: int) -> np.ndarray:
    """Partition ``sizes`` into ``m`` sets of nearly equal sums; the set of each item.

    Karmarkar and Karp's method for many sets: every item begins as a partial partition with one filled
    set. Again and again the two partial partitions with the largest spread are merged, the largest set
    of one with the smallest of the other, and only differences to the smallest sum are kept. The sets are
    read off the tree of merges from the root downwards.
    """
    n = len(sizes)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    sums: dict[int, np.ndarray] = {}
    heap = []
    for i, s in enumerate(sizes):
        v = np.zeros(m, dtype=np.int64)
        v[0] = s
        sums[i] = v
        heap.append((-int(s) if m > 1 else 0, i))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    for node in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        place = np.empty(m, dtype=np.int32)
        place[order] = np.arange(m, dtype=np.int32)
        merges.append((a, b, place))
        sums[node] = both
        heapq.heappush(heap, (-int(both[0]), node))
    where = {2 * n - 2: np.arange(m)}
    for node in range(2 * n - 2, n - 1, -1):
        a, b, place = merges[node - n]
        to = where.pop(node)[place]
        where[a], where[b] = to, to[::-1]
    return np.array([where[i][0] for i in range(n)])


def settle(sizes: np.ndarray, to: np.ndarray, m: int, capacity: int) -> bool:
    """Bring sets that differencing left slightly too full below the capacity, in place; whether all fit then.

    An item of a set that is too full is moved or exchanged for a smaller one of a set with room,
    with the least difference that suffices.
    """
    load = np.bincount(to, weights=sizes, minlength=m).astype(np.int64)
    for k in np.argsort(-load):
        while load[k] > capacity:
            over, best = load[k] - capacity, None
            room = capacity - load[to]
            for a in np.flatnonzero(to == k):
                gain = sizes[a] - sizes
                fits = np.flatnonzero((gain >= over) & (gain <= room))
                if len(fits):
                    b = fits[np.argmin(gain[fits])]
                    if best is None or gain[b] < best[0]:
                        best = (gain[b], a, b)
            if best is None:
                free = np.argmax(np.where(np.arange(m) == k, -1, capacity - load))
                moved = [a for a in np.flatnonzero(to == k) if over <= sizes[a] <= capacity - load[free]]
                if not moved:
                    return False
                a = min(moved, key=lambda i: sizes[i])
                load[k] -= sizes[a]
                load[free] += sizes[a]
                to[a] = free
                continue
            gain, a, b = best
            load[k] -= gain
            load[to[b]] += gain
            to[a], to[b] = to[b], to[a]
    return True


def fill(sizes: Sequence[int], capacity: int) -> tuple[np.ndarray, int]:
    """Containers for items of at most ``capacity``: (container of each item, number of containers).

    The number begins at the least possible one; sets that differencing leaves too full exchange items
    with others, and if some set still exceeds the capacity the number rises.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    if not len(sizes):
        return np.zeros(0, dtype=np.int64), 0
    m, tries = max(int(-(-sizes.sum() // capacity)), int((2 * sizes > capacity).sum())), 0
    while True:
        # As many sets as items always fit.
        to = difference(sizes, m) if m < len(sizes) else np.arange(len(sizes))
        if settle(sizes, to, m, capacity):
            return to, m
        tries += 1
        m += 1 + tries // 4


def pack(docs: DataFrame, row_id: str, text: str, capacity: int = CAPACITY, block_containers: int = BLOCK_CONTAINERS, block_items: int = BLOCK_ITEMS, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(row id, part, n_parts, start_token, n_tokens, container_id) for all documents.

    Containers hold at most ``capacity`` tokens. Only a document that is longer is split, into full
    containers of its own and a rest that is packed like any item. Items are packed in blocks of the rows
    as they are read, without a shuffle, so a task holds one block of at most ``block_items`` items at a time and wastes part of one
    container at the end of each block. Container ids name task, block and number, and are the same if the task is run again.

    Documents without tokens (NULL or empty text) need no container: one row with n_tokens 0 and a NULL
    container. Very long documents are split whatever their length; ties and repeated rows are items
    like any other, an empty table gives no rows, further columns are ignored.
    """
    rows = docs.select(col(row_id).alias("id"), col(text).alias("text"))
    schema = f"id {dict(docs.dtypes)[row_id]}, part int, n_parts int, start_token bigint, n_tokens bigint, container_id string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(folder, vocabulary)
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        names = ["id", "part", "n_parts", "start_token", "n_tokens", "container_id"]
        block, items, load = 0, [], 0

        def close() -> pd.DataFrame:
            to, _ = fill([x[4] for x in items], capacity)
            return pd.DataFrame([(*x, f"{task}-{block}-{k}") for x, k in zip(items, to, strict=True)], columns=names)

        for pdf in batches:
            whole = []
            for i, t in zip(pdf["id"], pdf["text"], strict=True):
                n = count(t) if isinstance(t, str) else 0
                if n == 0:
                    whole.append((i, 0, 1, 0, 0, None))
                    continue
                full, rest = divmod(n, capacity) if n > capacity else (0, n)
                n_parts = full + bool(rest)
                whole.extend((i, k, n_parts, k * capacity, capacity, f"{task}-{block}-{len(items)}-f{k}") for k in range(full))
                if rest:
                    items.append((i, full, n_parts, full * capacity, rest))
                    load += rest
                if load >= block_containers * capacity or len(items) >= block_items:
                    yield close()
                    block, items, load = block + 1, [], 0
            if whole:
                yield pd.DataFrame(whole, columns=names)
        if items:
            yield close()

    out = rows.mapInPandas(run, schema)
    return out.withColumnRenamed("id", row_id) if row_id != "id" else out


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, and the share of the containers' room that is used."""
    used = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"))
    return used.agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), (F.sum("tokens") / (F.count(F.lit(1)) * F.lit(capacity))).alias("used_share"))
