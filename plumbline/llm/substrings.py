"""Substring dedup by content-defined chunking.

A gear rolling hash runs over a text's UTF-8 bytes; the hash of a place depends
on the ``WINDOW`` bytes before it alone. A chunk ends where the hash is the
maximum among ``REACH`` places on either side, so boundaries depend on nearby
content only, and an insertion moves no boundary beyond its neighbourhood. In
text with a short period the maxima are equal, once a period; of these, the
ones ``REACH`` bytes apart or more are taken from the left. They are whole
periods apart, so chunks within such a stretch are alike wherever it begins and
however long it is. Chunks have about ``REACH`` bytes at least, and an end inside
a character moves behind it. Chunks are compared by 128-bit digest. A run of
neighbouring chunks that all stand earlier in the corpus, with ``MIN_WORDS``
words or more, is a repeated passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.runtime import cut

from .arrow import slices, texts
from .columns import columns, fresh

#: Bytes that the rolling hash sees, and places on either side that a boundary has to exceed.
WINDOW, REACH = 16, 24
#: A passage counts as repeated from so many words on.
MIN_WORDS = 20
#: One random value for each byte: successive outputs of a 64-bit mixer.
GEAR = np.random.Generator(np.random.PCG64(20_240_229)).integers(0, 1 << 64, 256, np.uint64)


def gear_hashes(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The gear hash behind each byte: the sum of its window's gear values, each doubled once per byte since. ``window``: a power of two."""
    h = GEAR[data]
    width = 1
    while width < window:  # a window of twice the width is the same window, and the one before it shifted
        older = np.zeros_like(h)
        older[width:] = h[:-width]
        h = h + (older << np.uint64(width))
        width *= 2
    return h * np.uint64(0x9E3779B97F4A7C15)


def _ahead(h: np.ndarray, reach: int) -> np.ndarray:
    """The maximum of the next ``reach`` values behind each place; 0 beyond the end."""
    best, width = np.append(h[1:], np.uint64(0)), 1
    while width < reach:  # two windows that overlap or touch make a wider one
        step = min(width, reach - width)
        wider = best.copy()
        wider[: len(h) - step] = np.maximum(best[: len(h) - step], best[step:])
        best, width = wider, width + step
    return best


def boundaries(data: np.ndarray, window: int = WINDOW, reach: int = REACH) -> np.ndarray:
    """Ends of the chunks of ``data``, the last byte's included; none for no bytes."""
    n = len(data)
    if n <= 2 * reach:
        return np.full(min(n, 1), n, np.int64)
    h = gear_hashes(data, window)
    peak = (h >= _ahead(h, reach)) & (h >= _ahead(h[::-1], reach)[::-1])
    peak[:reach] = peak[max(0, n - reach) :] = False
    ends = np.flatnonzero(peak) + 1
    if (np.diff(ends) < reach).any():  # equal maxima close together: keep those that are ``reach`` apart
        kept = [-reach]
        for end in ends.tolist():
            if end - kept[-1] >= reach:
                kept.append(end)
        ends = np.array(kept[1:], np.int64)
    return np.append(ends, n)


CHUNKS = "row long, doc_id long, nth int, start int, stop int, first_word int, end_word int, hi long, lo long"


def chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk of each row of ``docs`` (row, doc_id, text): its byte and word ranges, and its digest in two longs.

    A chunk's words are those that begin in it; words are runs without ASCII white space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = np.zeros(256, bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        for batch in slices(batches, "text", 4 << 20):
            parts: list[list[np.ndarray]] = []
            digests: list[bytes] = []
            for k, text in enumerate(texts(batch, "text")):
                data = np.frombuffer(text, np.uint8)
                stop = boundaries(data)
                if not len(stop):
                    continue
                for _ in range(3):  # no end inside a character
                    stop[:-1] += (data[stop[:-1]] & 0xC0) == 0x80
                start = np.append(0, stop[:-1])
                white = space[data]
                begins = np.cumsum(~white & np.append(True, white[:-1]))
                digests += [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(start.tolist(), stop.tolist())]
                parts.append([np.full(len(stop), k), np.arange(len(stop)), start, stop, np.append(0, begins[stop[:-1] - 1]), begins[stop - 1]])
            if not parts:
                continue
            owner, nth, start, stop, first, end = (np.concatenate(x) for x in zip(*parts))
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            ids = [batch.column(c).cast(pa.int64()).take(pa.array(owner)) for c in ("row", "doc_id")]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(x.astype(np.int32)) for x in (nth, start, stop, first, end)), pa.array(both[:, 0]), pa.array(both[:, 1])], [x.split()[0] for x in CHUNKS.split(", ")])

    return docs.select("row", "doc_id", "text").mapInArrow(run, CHUNKS)


def _row_key(docs: DataFrame) -> Column:
    return F.xxhash64("doc_id", "text")


def passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, doc_id, spans) of the rows of ``docs`` (doc_id, text) that hold passages which also stand elsewhere.

    A row is known by doc_id and ``row``, a hash of id and text. A span is a run of neighbouring repeated
    chunks of ``min_words`` words or more, with the smallest doc_id that holds
    one of its chunks; the first holder's own span is given too, with its own id.
    A run that stands here first only in part is given in several spans.
    Digests are counted with partial aggregation, and the repeated ones are
    joined back in a join that can be split where a digest is hot; only
    repeated chunks are gathered, per document.
    """
    pieces = chunks(docs.withColumn("row", _row_key(docs)))
    held = pieces.groupBy("hi", "lo").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "nth")).alias("first"), F.count("*").alias("n"))
    # written first, so that the join reads its large side straight from a shuffle, and a hot digest's part of it can be split
    repeated = cut(held.where("n > 1").select("hi", "lo", F.col("first.doc_id").alias("first_doc_id"), F.struct("first.row", "first.nth").alias("home")))
    found = pieces.join(repeated, ["hi", "lo"]).withColumn("is_home", (F.col("row") == F.col("home.row")) & (F.col("nth") == F.col("home.nth")) & F.col("doc_id").eqNullSafe(F.col("first_doc_id")))
    gathered = found.groupBy("row", "doc_id").agg(F.array_sort(F.collect_set(F.struct("nth", "start", "stop", "first_word", "end_word", "first_doc_id", "is_home"))).alias("pieces"))
    # places in ``pieces`` where a run of neighbours begins, and the end of the last; then the same within a kept run, for parts
    # of equal is_home. Each piece is looked at a fixed number of times, so a text of many pieces takes no more than its length.
    runs = """transform(breaks, (b, j) -> slice(pieces, b + 1, coalesce(get(breaks, j + 1), size(pieces)) - b))"""
    breaks = "filter(sequence(0, size({0}) - 1), i -> i = 0 or {1})"
    begun = gathered.withColumn("breaks", F.expr(breaks.format("pieces", "pieces[i].nth <> pieces[i - 1].nth + 1")))
    kept = begun.withColumn("runs", F.expr(f"filter({runs}, r -> element_at(r, -1).end_word - r[0].first_word >= {int(min_words)})"))
    parted = kept.withColumn("runs", F.expr("transform(runs, r -> struct(r, " + breaks.format("r", "r[i].is_home <> r[i - 1].is_home") + " as at))"))
    part = """struct(p[0].start as start, element_at(p, -1).stop as stop, p[0].first_word as first_word, element_at(p, -1).end_word as end_word,
        array_min(transform(p, x -> x.first_doc_id)) as first_doc_id, p[0].is_home as is_home)"""
    spans = parted.select("row", "doc_id", F.expr(f"flatten(transform(runs, x -> transform(transform(x.at, (b, j) -> slice(x.r, b + 1, coalesce(get(x.at, j + 1), size(x.r)) - b)), p -> {part})))").alias("spans"))
    return spans.where(F.size("spans") > 0)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_spans, repeated_words, removable_words, first_doc_ids, spans) of each row of ``docs`` (doc_id, text).

    ``repeated_words`` are in passages that also stand elsewhere (in another
    document, or again in the same); ``removable_words`` leaves out those of
    which this is the first place. ``first_doc_ids`` has, sorted, for each span
    the smallest id that holds one of its chunks; holders of one passage may name
    different ids where more of the text around it is shared by some of them.
    Null and empty texts hold none; rows without a doc_id come last in
    order and are compared like any; repeated rows give repeated rows, all of
    them first places if one is; other columns are ignored.
    """
    rows = docs.select("doc_id", _row_key(docs).alias("row"))
    found = passages(docs.select("doc_id", "text"), min_words).withColumnRenamed("doc_id", "_id").withColumnRenamed("row", "_row")
    same = (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    words = "aggregate({}, 0L, (acc, s) -> acc + s.end_word - s.first_word)"
    return rows.join(found, same, "left").select(
        "doc_id",
        F.expr("cast(coalesce(size(spans), 0) as long)").alias("n_spans"),
        F.expr("coalesce(" + words.format("spans") + ", 0L)").alias("repeated_words"),
        F.expr("coalesce(" + words.format("filter(spans, s -> not s.is_home)") + ", 0L)").alias("removable_words"),
        F.expr("coalesce(array_sort(array_distinct(transform(spans, s -> s.first_doc_id))), cast(array() as array<bigint>))").alias("first_doc_ids"),
        F.expr("coalesce(transform(spans, s -> named_struct('start', s.start, 'stop', s.stop, 'first_word', s.first_word, 'end_word', s.end_word, 'first_doc_id', s.first_doc_id, 'is_home', s.is_home)), array())").alias("spans"),
    )


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with all columns, each repeated passage kept only at its first place; a text of nothing else becomes empty.

    Rows that repeat id and text are first places together, so all of them stay.
    """
    row, their_id, their_row, cuts = (fresh(c, docs) for c in ("_row", "_cut_id", "_cut_row", "_cuts"))
    found = passages(docs.select("doc_id", "text"), min_words)
    found = found.select(F.col("doc_id").alias(their_id), F.col("row").alias(their_row), F.expr("transform(filter(spans, s -> not s.is_home), s -> struct(s.start, s.stop))").alias(cuts)).where(F.size(cuts) > 0)
    keyed = docs.withColumn(row, _row_key(docs))
    met = keyed.join(found, (keyed[row] == found[their_row]) & keyed["doc_id"].eqNullSafe(found[their_id]), "left")
    pieces = F.expr(
        f"""array_join(transform(sequence(0, size({cuts})), i -> decode(substring(encode(text, 'UTF-8'),
        case when i = 0 then 1 else {cuts}[i - 1].stop + 1 end,
        (case when i = size({cuts}) then octet_length(text) else {cuts}[i].start end) - (case when i = 0 then 0 else {cuts}[i - 1].stop end)), 'UTF-8')), '')"""
    )
    return met.withColumn("text", F.when(F.col(cuts).isNull(), F.col("text")).otherwise(pieces)).select(columns(docs))
