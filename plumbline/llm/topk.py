"""Exact top-k by inner product, over an impact-ordered score-at-a-time index.

Vectors are quantised to integers. An index block holds up to ``BLOCK`` of them
as posting segments: all vectors of the block with one integer value (the
impact) in one dimension. Segments are processed by descending size of impact,
each adding its contribution to the accumulators of a whole block of queries.
Between levels of impact, what the open segments can still change is bounded
for each pair, by Cauchy-Schwarz on the vector's open components and by the
next impact times the query's absolute sum. Processing stops only once these
bounds prove that few vectors can still be among the best k; those possible
members are rescored exactly from the stored vectors. A task holds up to
``BLOCKS_HELD`` index blocks and lets the blocks of queries stream past; a query
takes its k-th best score so far along to the next block. Ties go to the
smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.runtime import cut

BLOCK, QUERY_BLOCK = 4096, 512
#: Index blocks that one task holds while all queries pass.
BLOCKS_HELD = 16
#: Shares of a block's postings after which the bounds are tried, and the share of pairs that may be left to rescore.
TRIES, LEFT = (0.4, 0.55, 0.7, 0.85), 0.1
_LOWEST = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, factor: int = 64) -> DataFrame:
    """(row, vec_id, vec) of the rows that take part: floor(factor * x) of each component, as array<long>.

    Vectors that are null, or hold a null or non-finite component, and rows
    without a vec_id take no part. A component whose product doesn't fit in a
    long fails the job, as SQL would. Rows that repeat a vec_id all take part:
    ``row`` numbers the rows, and is fixed as the table is written.
    """
    scaled = F.transform("embedding", lambda x: F.lit(float(factor)) * x.cast("double"))
    good = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    taken = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & good)
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) >= 9.2e18, F.raise_error(F.lit("a component is beyond a long"))).otherwise(F.floor(x)).cast("bigint"))
    return cut(taken.select(F.monotonically_increasing_id().alias("row"), "vec_id", whole.alias("vec")))


def postings(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments (dims, impacts, ends) by descending size of impact, and their members (rows of ``matrix``). Zeros aren't posted."""
    row, dim = np.nonzero(matrix)
    value = matrix[row, dim]
    order = np.lexsort((row, dim, value, -np.abs(value)))
    row, dim, value = row[order], dim[order], value[order]
    new = np.flatnonzero((np.diff(value, prepend=0) != 0) | (np.diff(dim, prepend=-1) != 0))
    return dim[new], value[new], np.append(new[1:], len(row)).astype(np.int64), row.astype(np.int32)


def first_k(q: np.ndarray, v: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores of each ``q``, ties to smaller ``v``; by q, then rank."""
    order = np.lexsort((v, -score, q))
    return order[np.arange(len(q)) - np.searchsorted(q[order], q[order], "left") < k]


def _largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _wide(rows: np.ndarray, matrix: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best`` for components whose scores need more than a machine word on the way; a score beyond a long raises."""
    scores = matrix.astype(object) @ queries.T.astype(object)
    v, q = np.nonzero(rows[:, None] != query_rows[None, :])
    values = scores[v, q]
    if any(not -(1 << 63) <= x < 1 << 63 for x in values):
        raise OverflowError("a score is beyond a long")
    score = values.astype(np.int64)
    top = first_k(q, v, score, k)
    return q[top], v[top], score[top]


def best(rows: np.ndarray, matrix: np.ndarray, index: tuple, query_rows: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(query places, vector places, scores) of each query's best k in one block, and the share of postings processed.

    A query's own row is no candidate. ``least``: scores that a candidate has to
    reach, by query; of what doesn't, some may be left out. Ties go to earlier rows of ``matrix``.
    """
    n, nq, width = len(rows), len(query_rows), max(1, matrix.shape[1])
    if not n or not nq:
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.int64), 1.0
    if width * n * _largest(matrix) * _largest(queries) >= 1 << 62:
        limit = math.isqrt((1 << 61) // (width * n))
        plain_v, plain_q = (np.abs(x).max(1, initial=0) <= limit for x in (matrix, queries))
        found = []
        for vs, qs, far in ((plain_v, plain_q, False), (~plain_v, plain_q, True), (np.ones(n, bool), ~plain_q, True)):
            at, of = np.flatnonzero(vs), np.flatnonzero(qs)
            part = _wide(rows[at], matrix[at], query_rows[of], queries[of], k) if far else best(rows[at], matrix[at], postings(matrix[at]), query_rows[of], queries[of], k, None if least is None else least[of])[:3]
            found.append((of[part[0]], at[part[1]], part[2]))
        q, v, score = (np.concatenate(x) for x in zip(*found))
        top = first_k(q, v, score, k)
        return q[top], v[top], score[top], 1.0
    dims, impacts, ends, members = index
    kind = np.int64 if width * _largest(matrix) * _largest(queries) >= 1 << 31 else np.int32
    columns = np.ascontiguousarray(queries.T.astype(kind))
    scores = np.zeros((n, nq), kind)
    by_row = np.argsort(rows)
    own = np.searchsorted(rows[by_row], query_rows)
    own_q = np.flatnonzero((own < n) & (rows[by_row[np.minimum(own, n - 1)]] == query_rows))
    own_v = by_row[own[own_q]]
    length, total = np.sqrt((queries.astype(float) ** 2).sum(1)), np.abs(queries).sum(1)
    rest = (matrix.astype(float) ** 2).sum(1)
    tries, begin = [t * len(members) for t in TRIES], 0
    for s in range(len(ends)):
        m = members[begin : ends[s]]
        scores[m] += columns[dims[s]] * kind(impacts[s])
        rest[m] -= float(impacts[s]) ** 2
        begin = int(ends[s])
        level_done = s + 1 < len(ends) and abs(impacts[s + 1]) < abs(impacts[s])
        if tries and begin >= tries[0] and level_done and (n > k or least is not None):
            tries = [t for t in tries if t > begin]
            bound = np.minimum(np.sqrt(np.maximum(rest, 0))[:, None] * length, float(abs(impacts[s + 1])) * total) * (1 + 1e-9) + 1e-6
            floor = np.full(nq, -np.inf) if least is None else least.astype(float) - 1e-6 - np.abs(least) * 1e-9
            if n > k:
                low = scores - bound
                low[own_v, own_q] = -np.inf
                floor = np.maximum(floor, np.partition(low, n - k, axis=0)[n - k])
            possible = scores + bound >= floor
            possible[own_v, own_q] = False
            if possible.mean() <= LEFT:
                v, q = np.nonzero(possible)
                exact = np.empty(len(v), np.int64)
                for at in range(0, len(v), 1 << 18):
                    part = slice(at, at + (1 << 18))
                    exact[part] = np.einsum("ij,ij->i", matrix[v[part]], queries[q[part]])
                top = first_k(q, v, exact, k)
                return q[top], v[top], exact[top], begin / len(members)
    keys = scores.astype(np.int64) * n + np.arange(n - 1, -1, -1)[:, None]
    keys[own_v, own_q] = _LOWEST
    top = np.argpartition(keys, n - k, axis=0)[n - k :] if n > k else np.repeat(np.arange(n)[:, None], nq, 1)
    q = np.repeat(np.arange(nq)[None, :], len(top), 0).ravel()
    v = top.ravel()
    keep = keys[v, q] > _LOWEST
    q, v = q[keep], v[keep]
    score = scores[v, q].astype(np.int64)
    order = first_k(q, v, score, k)
    return q[order], v[order], score[order], 1.0


def _matrix(vectors: pd.Series) -> np.ndarray:
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _packed(matrix: np.ndarray) -> bytes:
    """The matrix in the narrower of two types; ``_unpacked`` tells them by the length."""
    return matrix.astype(np.int32 if _largest(matrix) < 1 << 31 else np.int64).tobytes()


def _unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(data, np.int64 if n * width and len(data) == 8 * n * width else np.int32).astype(np.int64).reshape(n, width)


#: One schema for index blocks (query false) and query blocks (query true), which travel together. ``own`` holds, of
#: query blocks, the vectors' rows that are the queries themselves, and ``rows`` the queries' own numbers.
_ROWS = "{0} long, query boolean, rows binary, ids binary, own binary, matrix binary, width int, dims binary, impacts binary, ends binary, members binary"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")][1:]


def _block(pdf: pd.DataFrame, key: str, indexed: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["vec_id", "row"])
    matrix = _matrix(pdf["vec"])
    segments: list[bytes | None] = [None] * 4
    if indexed:
        dims, impacts, ends, members = postings(matrix)
        segments = [dims.astype(np.int32).tobytes(), impacts.astype(np.int64).tobytes(), ends.tobytes(), members.tobytes()]
    own = None if indexed else pdf["own"].to_numpy(np.int64).tobytes()
    values = [pdf[key].iloc[0], not indexed, pdf["row"].to_numpy(np.int64).tobytes(), pdf["vec_id"].to_numpy(np.int64).tobytes(), own, _packed(matrix), matrix.shape[1], *segments]
    return pd.DataFrame([values], columns=[key, *_NAMES])


def build_index(vectors: DataFrame, n: int) -> DataFrame:
    """One row per block of about ``BLOCK`` of the ``n`` rows of ``vectors`` (row, vec_id, vec): posting segments, and the vectors themselves."""
    blocks = max(1, -(-n // BLOCK))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(lambda pdf: _block(pdf, "block", True), _ROWS.format("block"))


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of one group after another: its index blocks, then the query blocks, each of which meets all of them."""
    group, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in ("group", *_NAMES)}
            if row["group"] != group:
                group, held = row["group"], []
            rows, ids = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids"))
            matrix = _unpacked(row["matrix"], len(rows), row["width"])
            if not row["query"]:
                held.append((rows, ids, matrix, (np.frombuffer(row["dims"], np.int32), *(np.frombuffer(row[c], np.int64) for c in ("impacts", "ends")), np.frombuffer(row["members"], np.int32))))
                continue
            q = v = score = row_of = np.empty(0, np.int64)
            own, least = np.frombuffer(row["own"], np.int64), None
            for block_rows, block_ids, block, index in held:
                width = max(block.shape[1], matrix.shape[1])
                sides = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (block, matrix))
                stored, queries = sides
                bq, bv, bs, _ = best(block_rows, stored, index, own, queries, k, least)
                q, v, score, row_of = (np.concatenate(x) for x in ((q, bq), (v, block_ids[bv]), (score, bs), (row_of, block_rows[bv])))
                top = first_k(q, v, score, k)
                q, v, score, row_of = q[top], v[top], score[top], row_of[top]
                least = np.full(len(rows), _LOWEST // 2)
                count = np.bincount(q, minlength=len(rows))
                full = np.flatnonzero(count == k)
                least[full] = score[np.cumsum(count)[full] - 1]
            yield pa.RecordBatch.from_arrays([pa.array(rows[q]), pa.array(ids[q]), pa.array(v), pa.array(row_of), pa.array(score)], ["query", "query_id", "vec_id", "row", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of ``vectors`` for each row of ``queries`` (both row, vec_id, vec; see ``quantised``).

    A query's own row is no candidate, but other rows of its vec_id are; shorter
    vectors count as padded with zeros; ties go to the smaller vec_id; with
    fewer than ``k`` candidates all are returned; empty tables give no rows; a
    score beyond a long fails the job. Every block of queries meets every block
    of the index once: query blocks are sent to each group of index blocks, and
    a group gives back at most ``k`` rows a query.
    """
    queries = cut(queries.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec", F.col("row").alias("own")))
    n, nq = vectors.count(), queries.count()
    blocks, qblocks = max(1, -(-n // BLOCK)), max(1, -(-nq // QUERY_BLOCK))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    groups = max(-(-blocks // BLOCKS_HELD), min(blocks, 2 * cores))
    packed = queries.withColumn("qblock", F.pmod(F.xxhash64("row"), F.lit(qblocks))).groupBy("qblock").applyInPandas(lambda pdf: _block(pdf, "qblock", False), _ROWS.format("qblock"))
    sent = packed.drop("qblock").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")))
    index = build_index(vectors, n).withColumn("group", F.pmod("block", F.lit(groups))).drop("block")
    both = index.unionByName(sent).repartition(min(groups, 20_000), "group").sortWithinPartitions("group", "query")
    found = both.mapInArrow(lambda batches: _search(batches, k), "query long, query_id long, vec_id long, row long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id"), F.col("row"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
