"""Sharding by bytes: Karmarkar-Karp differencing over groups that must stay together.

Equal texts are one indivisible group. Groups of one size can stand for each other, so the
partition is made on the table of sizes and their numbers of groups: T bytes have at most
sqrt(2 T) sizes, however many groups there are. Sizes are taken from large to small. The
largest groups, and later the sizes with few groups, are differenced one by one together
with the sums so far; many groups of one size go where there is room. So what a large
group leaves uneven is filled by all smaller ones. A group finds its shard by its place
among those of its size.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline import skew
from ledgerline.llm.common import ORDER_BITS, order_chunk, require, shuffle_order, text_of
from ledgerline.session import stage

#: Groups that are differenced at once: the heap and the tree of one step.
GROUPS_PER_BLOCK = 20_000


def differencing(parts: Sequence[Sequence[int]], k: int) -> tuple[list[list[int]], list[int]]:
    """Karmarkar-Karp over partial partitions of k sums each.

    Returns for each part the final subset of each of its positions, and the final sums.
    Ties break by the order of the parts.
    """
    if not parts:
        return [], [0] * k
    # a node: (its sums from large to small, left child, left's positions, right child, right's positions)
    nodes: list[tuple] = []
    heap = []
    for i, sums in enumerate(parts):
        order = sorted(range(k), key=lambda p, s=sums: (-s[p], p))
        nodes.append(([sums[p] for p in order], None, order, None, None))
        heap.append((sums[order[-1]] - sums[order[0]], i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = nodes[a][0], nodes[b][0]
        joined = [x[p] + y[k - 1 - p] for p in range(k)]  # large meets small
        order = sorted(range(k), key=lambda p: (-joined[p], p))
        sums = [joined[p] for p in order]
        nodes.append((sums, a, order, b, [k - 1 - p for p in order]))
        heapq.heappush(heap, (sums[-1] - sums[0], len(nodes) - 1))
    root = heap[0][1]
    labels: dict[int, list[int]] = {root: list(range(k))}
    final: list[list[int]] = [[] for _ in parts]
    for at in range(root, -1, -1):
        own = labels.pop(at)
        _, left, to_left, right, to_right = nodes[at]
        if left is None:
            final[at] = [0] * k
            for p, label in zip(to_left, own, strict=True):
                final[at][p] = label
            continue
        for child, to in ((left, to_left), (right, to_right)):
            below = [0] * k
            for p, label in zip(to, own, strict=True):
                below[p] = label
            labels[child] = below
    return final, list(nodes[root][0])


def fill(sums: list[int], size: int, count: int) -> list[int]:
    """Numbers of ``count`` groups of one size that go to each sum so that the least become level; the sums are raised."""
    order = sorted(range(len(sums)), key=lambda p: (sums[p], p))
    room, below = 0, size * count
    for n, p in enumerate(order, 1):  # the level up to which the n least sums can be filled
        room += sums[p]
        level = (room + below) // n
        if n == len(order) or level <= sums[order[n]]:
            break
    dealt = [max(0, (level - x) // size) for x in sums]
    left = count - sum(dealt)
    heap = [(x + size * d, p) for p, (x, d) in enumerate(zip(sums, dealt, strict=True))]
    heapq.heapify(heap)
    for _ in range(left):
        x, p = heap[0]
        dealt[p] += 1
        heapq.heapreplace(heap, (x + size, p))
    for p, d in enumerate(dealt):
        sums[p] += size * d
    return dealt


def deal_sizes(sizes: Sequence[int], counts: Sequence[int], k: int, per_block: int) -> list[list[int]]:
    """For sizes from large to small, the numbers of their groups in each of k shards."""
    sums = [0] * k
    dealt = [[0] * k for _ in sizes]
    waiting: list[int] = []
    first = True

    def settle() -> None:
        if not waiting:
            return
        final, _ = differencing([sums] + [[sizes[i]] + [0] * (k - 1) for i in waiting], k)
        shard = {label: p for p, label in enumerate(final[0])}  # the sums so far keep their shards
        for i, to in zip(waiting, final[1:], strict=True):
            dealt[i][shard[to[0]]] += 1
            sums[shard[to[0]]] += sizes[i]
        waiting.clear()

    for i, count in enumerate(counts):
        if len(waiting) + count > per_block or (count > k and not first):
            settle()
            first = False
        if count <= (per_block if first else k):
            waiting.extend([i] * count)
        else:
            dealt[i] = fill(sums, sizes[i], count)
    settle()
    return dealt


def _deal(k: int, per_block: int):
    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bytes", ascending=False)
        sizes = pdf["bytes"].tolist()
        dealt = deal_sizes(sizes, pdf["groups"].tolist(), k, per_block)
        return pd.DataFrame({"bytes": sizes, "upto": [list(accumulate(d)) for d in dealt]})
    return deal


def balance(groups: DataFrame, k: int, per_block: int = GROUPS_PER_BLOCK, parts_per_block: int | None = None) -> DataFrame:
    """``digest, bytes`` (one row per group, bytes above 0) to ``digest, shard``; ``parts_per_block`` has no meaning any more."""
    if per_block < 1:
        raise ValueError("blocks need room")
    groups = stage(groups.select("digest", "bytes", F.conv(F.substring(F.hex("digest"), 1, ORDER_BITS // 4), 16, 10).cast("long").alias("__order")), "groups")
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("groups"))
    dealt = stage(sizes.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(_deal(k, per_block), "bytes long, upto array<long>"), "dealt")
    placed = skew.running(groups.withColumn("__one", F.lit(1).cast("long")), ["bytes"], ["__order", "digest"], order_chunk("__order", groups.count()), {"__place": ("sum", "__one")})
    return placed.join(dealt, "bytes").select("digest", F.size(F.filter("upto", lambda upto: upto < F.col("__place"))).alias("shard"))


def shard_by_bytes(docs: DataFrame, k: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's shard 0..k-1, equal texts together, and its place in the shard.

    Size: UTF-8 bytes plus 1, so that empty documents are spread too. Null text counts as
    empty and goes with the empty texts. Rows with equal ids are separate documents. The
    groups get their shard by ``balance``: the largest shard is near a fair share, or the
    one of the largest group if that is more. Slots count from 0 in each shard without gaps, in a fixed order. An
    empty table gives no rows. Columns other than id and text are not read.
    """
    require(docs, doc_id, text)
    value = text_of(text)
    facts = stage(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(value) + 1).cast("long").alias("size"),
                              F.crc32(value.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(value, 256)).alias("digest"),
                              shuffle_order(F.col(doc_id)).alias("__order")), "sizes")
    groups = facts.groupBy("digest").agg(F.sum("size").alias("bytes"))
    placed = facts.join(balance(groups, k), "digest")
    rows = facts.count()
    counted = skew.running(placed.withColumn("__one", F.lit(1).cast("long")), ["shard"], ["__order", "doc_id", "text_crc32", "digest"], order_chunk("__order", rows),
                           {"__upto": ("sum", "__one")})
    return counted.select("doc_id", "size", "text_crc32", "shard", (F.col("__upto") - 1).alias("slot"), F.hex("digest").alias("group_digest"))
