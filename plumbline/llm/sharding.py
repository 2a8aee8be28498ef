"""Byte-balanced sharding by Karmarkar-Karp differencing.

Rows with equal texts form one indivisible group. Every group starts as a
partial partition, its bytes in one part and the others empty. The two partial
partitions of largest spread are combined in opposite order, largest part with
smallest, until one is left: largest differencing, generalised to ``n_shards``
parts. To run on a cluster the differencing is a tree: groups are dealt into
bundles of about ``fan_in``, each bundle is differenced in its own task, and
what is left of the bundles (one partial partition each) is bundled and
differenced again, until one is left. Only those per-bundle sums move upwards.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.runtime import cut, stored

from .columns import clear_of, column, columns, fresh

#: Bytes a row takes besides its text.
ROW_BYTES = 16
#: Partial partitions that one task differences.
FAN_IN = 4096


def difference(partials: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine all rows of ``partials`` (n x parts) by largest differencing.

    Returns the sums of the final parts, largest first, and ``place`` (n x
    parts): the final part into which each part of each row goes. Ties in
    spread go to the row of smaller index, so equal input gives equal output.
    """
    n, parts = partials.shape
    order = np.argsort(-partials, axis=1, kind="stable")
    sums = list(np.take_along_axis(partials, order, 1))
    children: list[tuple[int, int, np.ndarray] | None] = [None] * n
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joined = sums[a] + sums[b][::-1]
        turn = np.argsort(-joined, kind="stable")
        joined = joined[turn]
        children.append((a, b, turn))
        sums.append(joined)
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-int(joined[0] - joined[-1]), len(sums) - 1))
    root = heap[0][1]
    place: list[np.ndarray | None] = [None] * len(sums)
    place[root] = np.arange(parts)
    for node in range(root, n - 1, -1):
        a, b, turn = children[node]
        back = np.empty(parts, np.int64)
        back[turn] = place[node]
        place[a], place[b] = back, back[::-1]
        place[node] = None
    final = np.empty((n, parts), np.int64)
    for i in range(n):
        final[i, order[i]] = place[i]
    return sums[root], final


def assign_groups(groups: DataFrame, n_shards: int, fan_in: int = FAN_IN) -> DataFrame:
    """(k1, k2, shard) of each group of ``groups`` (k1, k2, bytes)."""
    n = groups.count()
    bundles = max(1, math.ceil(n / fan_in))

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "k1", "k2"], ascending=[False, True, True])
        partials = np.zeros((len(pdf), n_shards), np.int64)
        partials[:, 0] = pdf["bytes"]
        sums, place = difference(partials)
        out = pdf[["k1", "k2", "bundle"]].assign(part=place[:, 0])
        out["sums"] = [None] * len(out)
        out.iat[0, out.columns.get_loc("sums")] = sums.tolist()
        return out

    dealt = groups.withColumn("bundle", F.pmod(F.xxhash64("k1", "k2", F.lit("bundle")), F.lit(bundles)))
    leaves = cut(dealt.repartition(max(1, bundles // 4), "bundle").groupBy("bundle").applyInPandas(leaf, "k1 long, k2 long, bundle long, part long, sums array<long>"))
    placed = leaves.select("k1", "k2", "bundle", "part")
    level = leaves.where("sums is not null").select(F.col("bundle").alias("node"), "sums")
    while bundles > 1:
        bundles = math.ceil(bundles / fan_in)

        def inner(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("node")
            sums, place = difference(np.array(pdf["sums"].tolist(), np.int64))
            out = pdf[["node", "parent"]].assign(place=place.tolist())
            out["sums"] = [None] * len(out)
            out.iat[0, out.columns.get_loc("sums")] = sums.tolist()
            return out

        joined = cut(level.withColumn("parent", F.pmod(F.xxhash64("node", F.lit("parent")), F.lit(bundles))).groupBy("parent").applyInPandas(inner, "node long, parent long, place array<long>, sums array<long>"))
        moves = joined.select(F.col("node").alias("bundle"), "parent", "place")
        placed = placed.join(moves, "bundle").select("k1", "k2", F.col("parent").alias("bundle"), F.expr("place[cast(part as int)]").alias("part"))
        level = joined.where("sums is not null").select(F.col("parent").alias("node"), "sums")
    return placed.select("k1", "k2", F.col("part").cast("int").alias("shard"))


def keyed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, k1, k2) of each row and its columns ``keep``; equal texts have equal keys, null is a text of its own.

    ``keep`` must name none of the columns that are made here.
    """
    text = F.col("text")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.when(text.isNull(), F.lit(0)).otherwise(F.lit(1)), text).alias("k2"),
        *(column(c) for c in keep),
    )


def slots(rows: DataFrame, lanes: int = 64) -> DataFrame:
    """``rows`` with ``slot``: gapless from 0 within each shard, by lane, then doc_id and content.

    A shard's rows are counted in ``lanes`` lanes by a hash of the row, so that
    a shard that holds a third of all rows is numbered by many tasks; the
    lanes' offsets come from a table of shards times lanes.
    """
    laned = rows.withColumn("lane", F.pmod(F.xxhash64("doc_id", "k1"), F.lit(lanes)).cast("int"))
    sizes = laned.groupBy("shard", "lane").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "lane").orderBy("doc_id", "k1", "k2")
    numbered = laned.withColumn("within", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "lane"]).withColumn("slot", (F.col("offset") + F.col("within")).cast("long")).drop("lane", "offset", "within")


def shard(docs: DataFrame, n_shards: int = 40, fan_in: int = FAN_IN, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row of ``docs`` (doc_id, text), in ``n_shards`` byte-balanced shards, with its columns ``keep``.

    A row's size is the UTF-8 bytes of its text plus 16. Rows with equal texts
    share a shard; null texts are one group and count as no bytes, with the
    checksum of an empty text. A null doc_id stays null and is numbered first.
    Repeated rows each get a slot; other columns are ignored; an empty table
    gives no rows. Shard numbers say nothing of size order.
    """
    rows = cut(keyed(docs, keep))
    groups = cut(rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes")))
    placed = assign_groups(groups, n_shards, fan_in)
    return slots(rows.join(placed, ["k1", "k2"])).select("doc_id", "size", "text_crc32", "shard", "slot", *(column(c) for c in keep))


ADDED = ("size", "text_crc32", "shard", "slot")


def sharded(docs: DataFrame, n_shards: int = 40, fan_in: int = FAN_IN) -> DataFrame:
    """``docs`` with all of its columns, and ``size``, ``text_crc32``, ``shard`` and ``slot`` as ``shard`` gives them.

    A column of ``docs`` that has one of these names is called ``<name>_input``.
    Rows are numbered as they are written to the shared folder, so that texts
    move once, to meet their shards, and not with every step of the differencing.
    """
    row = fresh("_row", docs)
    given = stored(clear_of(docs, ADDED).withColumn(row, F.monotonically_increasing_id()))
    found = shard(given, n_shards, fan_in, (row,)).select(column(row), *ADDED)
    return given.join(found, row).select(*(c for c, name in zip(columns(given), given.columns) if name != row), *ADDED)
