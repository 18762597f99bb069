"""Problem 7: filling fixed-capacity containers with items.

Items are spread over shards by the leading bits of a hash; the number of shards is a
power of two, so that a growing corpus splits shards in two and leaves the rest alone. A
shard has SHARD items at most on average, so the work of one task is bounded.

In a shard the Karmarkar-Karp multiway differencing method deals the items to windows:
it keeps a heap of partial partitions and merges the two with the largest imbalances in
opposing order, largest window with smallest. The window count starts at what the sizes
need at least and rises while a window exceeds the capacity, the items being differenced
anew each time. Near-equal windows are no tight ones where a window holds few items, so
the count is bounded by what best-fit decreasing needs for the same shard; where
differencing cannot keep the capacity with that many windows, the best-fit windows are
taken. No shard so uses more containers than the better of both.

An item larger than the container is cut into full containers and a remainder, which is
packed like any other item; no other item is cut.

Nulls: a null id is skipped; null or blank text has no size and takes no container. Ids
are taken to be unique; of repeated rows the largest counts. An empty table gives an
empty packing.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.hashing import by_value, hash_number
from plumbline.llm.words import word_count

SHARD = 4000
CLASSES = 1000
_PLACED = "container_class string, shard int, window int, doc_id bigint, piece int, size bigint"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Deals items (by number) to ``k`` windows with near-equal sums, by Karmarkar-Karp.

    A partial partition is its windows that hold anything, by descending sum; a window
    is a node of a binary tree whose leaves are items.
    """
    if k <= 1 or len(sizes) <= 1:
        return [list(range(len(sizes)))] + [[] for _ in range(max(k, 1) - 1)]
    children: list[tuple[int, int]] = []
    n = len(sizes)
    heap = [(-size, i, np.array([size], np.int64), np.array([i], np.int64)) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, sum_a, node_a = heapq.heappop(heap)
        _, _, sum_b, node_b = heapq.heappop(heap)
        meet = len(sum_a) + len(sum_b) - k  # windows that both hold, when laid in opposing order
        if meet > 0:
            a, b = len(sum_a) - meet, len(sum_b) - meet
            first = n + len(children)
            children.extend(zip(node_a[a:].tolist(), node_b[b:][::-1].tolist(), strict=True))
            sums = np.concatenate([sum_a[:a], sum_b[:b], sum_a[a:] + sum_b[b:][::-1]])
            nodes = np.concatenate([node_a[:a], node_b[:b], np.arange(first, first + meet)])
        else:
            sums, nodes = np.concatenate([sum_a, sum_b]), np.concatenate([node_a, node_b])
        at = np.argsort(-sums, kind="stable")
        sums, nodes = sums[at], nodes[at]
        heapq.heappush(heap, (-(int(sums[0]) - (int(sums[-1]) if len(sums) == k else 0)), order, sums, nodes))
        order += 1
    windows = []
    for node in heap[0][3].tolist():
        items, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack.extend(children[x - n])
        windows.append(items)
    return windows + [[] for _ in range(k - len(windows))]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows by best-fit decreasing: each item goes where it leaves the least room."""
    windows: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        space, n = room.pop(at) if at < len(room) else (capacity, len(windows))
        if n == len(windows):
            windows.append([])
        windows[n].append(i)
        insort(room, (space - sizes[i], n))
    return windows


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of item numbers, none above the capacity. No item may be larger than it."""
    found = best_fit(sizes, capacity)
    low, high = -(-sum(sizes) // capacity), len(found)

    def dealt(k: int) -> list[list[int]] | None:
        windows = differencing(sizes, k)
        return windows if max(sum(sizes[i] for i in w) for w in windows) <= capacity else None

    if not sizes or (windows := dealt(high)) is None:
        return found
    found = windows
    while low < high:  # the smallest count, if more windows never make the fullest one fuller
        middle = (low + high) // 2
        if (windows := dealt(middle)) is None:
            low = middle + 1
        else:
            found, high = windows, middle
    return [w for w in found if w]


def pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "piece"])
    capacity = int(rows["capacity"].iloc[0])
    sizes = rows["size"].astype("int64").tolist()
    window = np.zeros(len(sizes), np.int32)
    for n, items in enumerate(pack(sizes, capacity)):
        window[items] = n
    return rows.assign(window=window)[["container_class", "shard", "window", "doc_id", "piece", "size"]]


def sized(documents: DataFrame, size=word_count) -> DataFrame:
    """(doc_id, size) of the whole text in words, or as another column function counts; documents without size are left out."""
    sizes = documents.where("doc_id is not null").select("doc_id", size("text").alias("size")).where("size > 0")
    return sizes.groupBy("doc_id").agg(F.max("size").alias("size"))


def pieces(items: DataFrame, classes: DataFrame) -> DataFrame:
    """(container_class, capacity, doc_id, piece, size, pieces): items, those above the capacity cut.

    ``classes``: (container_class, capacity), one row per class and at most CLASSES of
    them; classes without a positive capacity are skipped. They become literals, so that
    items times classes needs neither a join nor a shuffle.
    """
    known = classes.where("capacity > 0 and container_class is not null").orderBy("container_class").limit(CLASSES + 1).collect()
    if len(known) > CLASSES:
        raise ValueError(f"more than {CLASSES} container classes")
    if not known:
        return items.where("false").select(F.lit("").alias("container_class"), F.lit(0).cast("bigint").alias("capacity"), "doc_id", F.lit(0).alias("piece"), "size", F.lit(0).alias("pieces"))
    each = items.withColumn("class", F.explode(F.array(*[F.struct(F.lit(r[0]).alias("container_class"), F.lit(int(r[1])).cast("bigint").alias("capacity")) for r in known])))
    count = F.ceil(F.col("size") / F.col("capacity")).cast("int")
    cut = each.select("class.*", "doc_id", "size").withColumn("pieces", count).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    size = F.when(F.col("piece") < F.col("pieces") - 1, F.col("capacity")).otherwise(F.col("size") - F.col("capacity") * (F.col("pieces") - 1))
    return cut.select("container_class", "capacity", "doc_id", "piece", size.cast("bigint").alias("size"), "pieces")


def packing(items: DataFrame, classes: DataFrame, seed: str = "packing", shard_size: int = SHARD) -> DataFrame:
    """(container_class, container, doc_id, piece, size): where each piece lies.

    Pieces that fill a container alone need no packing; their containers are named
    after the item. ``items``: distinct (doc_id, size > 0).
    """
    bits = (max(1, -(-items.count() // shard_size)) - 1).bit_length()  # 2^bits shards
    each = pieces(items, classes).withColumn("shard", F.shiftright(hash_number(seed, F.col("doc_id")), 48 - bits).cast("int"))
    full = F.concat(F.lit("full-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string"))
    out = ["container_class", "container", "doc_id", "piece", "size"]
    whole = each.where("size = capacity").withColumn("container", full).select(*out)
    dealt = each.where("size < capacity").select("container_class", "capacity", "shard", "doc_id", "piece", "size").groupBy("container_class", "shard").applyInPandas(pack_shard, _PLACED)
    return dealt.withColumn("container", F.concat_ws("-", "shard", "window")).select(*out).unionByName(whole)


def fill(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """Per class: containers, pieces, size, the fullest container and the share of the space that is filled."""
    per = placed.groupBy("container_class", "container").agg(F.count("*").alias("pieces"), F.sum("size").alias("size"))
    total = per.groupBy("container_class").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("size").alias("size"), F.max("size").alias("fullest"))
    return total.join(classes, "container_class").withColumn("filled", F.col("size") / (F.col("containers") * F.col("capacity")))


def oversized(placed: DataFrame) -> DataFrame:
    """(container_class, doc_id): items that the packing had to cut."""
    return placed.where("piece > 0").select("container_class", "doc_id").distinct()


by_value()
