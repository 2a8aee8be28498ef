"""SimHash near-duplicates, linked through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight bytes at eight positions. Two fingerprints that
differ in at most two bits differ in at most two bytes, so they share at least
six positional bytes: the guaranteed minimum. Single bytes have only 256 values,
so their posting lists would grow with the square of the corpus; the index
therefore posts fingerprints under the bytes of four positions at once. Of four
two-byte blocks at least two are equal, so the six pairs of blocks as keys miss
no link, and a list is 2^24 times shorter than one of a single byte. Pairs that
meet in a list are tallied over all eight positions, those below the minimum
are dropped, and the rest are verified bit by bit.

Lists longer than ``cap`` (families of near copies) give no pairs. Their
fingerprints are linked exactly through midpoints instead: two fingerprints
differ in at most two bits just when some word lies within one bit of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.runtime import broadcast_if_small, cut

from .arrow import slices, texts
from .components import connected_components

SEED, SHINGLE, MAX_BITS = 42, 3, 2
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The fingerprint of a text: each bit by strict majority over its shingles' hashes; 0 without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    stops = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), stops.tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp) of each row of ``docs`` (doc_id, text), fp as a signed long; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t) for t in texts(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text_key"), pa.array(found)], ["doc_id", "text_key", "fp"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, text_key long, fp long")


def _block(i: int):
    return F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))


def _shared_bytes(x):
    """How many of the eight positional bytes are equal, given the exclusive or."""
    total = F.lit(0)
    for i in range(8):
        total = total + (F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(0xFF)) == 0).cast("int")
    return total


def links(distinct: DataFrame, cap: int = 64) -> DataFrame:
    """Edges (a, b) between ``node``s whose fingerprints ``fp`` (distinct) differ in at most two bits, transitively complete.

    Pairs from short posting lists are given as they are. Members of a long list
    are linked to the smallest node that shares a midpoint with them, which
    leaves the same components.
    """
    keys = [F.struct(F.lit(k).alias("table"), (F.shiftleft(_block(i), 16) + _block(j)).alias("value")) for k, (i, j) in enumerate(combinations(range(4), 2))]
    postings = distinct.select("node", "fp", F.explode(F.array(*keys)).alias("key")).select("node", "fp", "key.table", "key.value")
    size = postings.groupBy("table", "value").agg(F.count("*").alias("n")).where("n > 1")
    lists = cut(postings.join(size, ["table", "value"]))
    short, long_ = lists.where(F.col("n") <= cap).drop("n"), lists.where(F.col("n") > cap)
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    pairs = (
        short.alias("l")
        .join(short.alias("r"), (F.col("l.table") == F.col("r.table")) & (F.col("l.value") == F.col("r.value")) & (F.col("l.node") > F.col("r.node")))
        .where((_shared_bytes(x) >= 8 - MAX_BITS) & (F.bit_count(x) <= MAX_BITS))
        .select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
    )
    middles = long_.select("node", "fp").distinct().select("node", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("middle"))
    hub = middles.groupBy("middle").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = middles.join(hub, "middle").where("node <> b").select(F.col("node").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, cap: int = 64) -> DataFrame:
    """(doc_id, text_key, fp, part, component_id) of each row of ``docs`` (doc_id, text).

    part is the component's smallest fingerprint, component_id the smallest doc_id reachable over links of at most two
    bits, the row itself included. Equal fingerprints are collapsed first, so
    exact copies and ties cost one posting, however many there are. Null or
    blank texts have fingerprint zero, linked like any other. Rows without a
    doc_id are linked too; where no row of a component has one, its id is null.
    Repeated rows give repeated rows; other columns are ignored.
    """
    prints = cut(fingerprints(docs))
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = cut(groups.select("fp", "least", F.col("fp").alias("node")))
    parts = connected_components(links(nodes, cap))
    labelled = nodes.join(parts, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("part"))
    least = labelled.groupBy("part").agg(F.min("least").alias("component_id"))
    by_print = labelled.join(least, "part").select("fp", "part", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "text_key", "fp", "part", "component_id")


def keep_representatives(docs: DataFrame, cap: int = 64) -> DataFrame:
    """One row of ``docs`` for each component of near duplicates, with all of its columns.

    The row with the component's smallest doc_id stays (of several texts with
    that id, the one of the smallest hash; of repeated rows, one).
    """
    rows = cut(near_duplicates(docs, cap).groupBy("part", "doc_id", "text_key").agg(F.count("*").alias("copies")))
    first = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("kept"))
    best = first.select(F.col("kept.doc_id").alias("_kept_id"), F.col("kept.text_key").alias("_kept_key"))
    # found again by id and text, not by component, of which one may be large
    met = rows.join(best, F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("text_key") == F.col("_kept_key")), "left")
    is_kept = F.col("_kept_key").isNotNull()
    judged = cut(met.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), (is_kept & (F.col("copies") == 1)).alias("_once"), is_kept.alias("_kept")))
    same = docs["doc_id"].eqNullSafe(judged["_id"]) & (F.xxhash64(docs["text"]) == judged["_key"])
    once = docs.join(broadcast_if_small(judged.where("not _once")), same, "left_anti")
    repeated = judged.where("_kept and not _once")
    if repeated.isEmpty():
        return once
    more = docs.join(broadcast_if_small(repeated), same, "left_semi")
    return once.unionByName(more.dropDuplicates(["doc_id", "text"]))
