"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` turns the corpus into index segments: each row holds, for some
documents, every term's sorted list of word positions. Segments are built where
the documents lie, and stored; any number of test sets can then be sought in
them. ``search`` takes a bounded block of test items. In every segment it takes
each window's rarest term, moves that term's positions to where the window
would begin, and intersects them with the moved lists of the other terms, from
rare to frequent, until nothing is left or the phrase stands. Proximity matches
come from the same lists. There is no shuffle: the test set goes to the
segments, in blocks of a checked size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.runtime import broadcast_if_small, cut, stored

from .arrow import slices, texts, word_table

#: Words of a window, and text bytes of the test items that are broadcast at once.
WINDOW = 13
BLOCK_BYTES = 4 << 20
#: Text bytes of a segment, and candidate places that are intersected at once.
SEGMENT_BYTES, OPEN = 4 << 20, 1_000_000
#: Proximity: this many of an item's rarest words, all within this many words.
NEAR = (3, 13)
_WORDS = word_table()
_END = b"\x00"  # never a word; stands behind each document

#: ``steps`` are the differences of all terms' positions, list after list; ``ends`` says where each list ends.
INDEX_SCHEMA = "segment long, doc_ids array<long>, text_keys array<long>, starts array<int>, n_words array<int>, terms array<binary>, ends array<int>, steps binary"
Items = list[tuple[str | None, list[bytes]]]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def index_segment(batch: pa.RecordBatch) -> list:
    """The values of one index segment over the documents of ``batch`` (doc_id, text, text_key), ``segment`` aside."""
    words = (b" " + _END + b" ").join(x.translate(_WORDS) for x in [*texts(batch, "text"), b""]).split()
    codes = {t: i for i, t in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(codes.__getitem__, words), np.int32, len(words))
    del words
    end = codes.get(_END, -1)
    stops = np.flatnonzero(ids == end)
    starts = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
    counts = np.bincount(ids, minlength=len(codes))
    order = np.argsort(ids.astype(np.uint16) if len(codes) < 65_536 else ids, kind="stable").astype(np.int32)
    if end >= 0:  # the places between documents are no term's
        first = int(counts[:end].sum())
        order = np.delete(order, slice(first, first + int(counts[end])))
        counts[end] = 0
        names = [t for t in codes if t != _END]
        counts = np.delete(counts, end)
    else:
        names = list(codes)
    return [batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("text_key").to_pylist(), starts, stops - starts, names, np.cumsum(counts), np.diff(order, prepend=0).astype(np.int32).tobytes()]


_TYPES = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]


def build_index(docs: DataFrame) -> DataFrame:
    """Index segments over ``docs`` (doc_id, text), stored in the shared folder; any number of searches can read them.

    Null texts have no words; null doc_ids stay null; repeated rows are indexed
    each; other columns are ignored; an empty table has no segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SEGMENT_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(index_segment(batch), _TYPES)], _COLUMNS[1:])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    built = keyed.mapInArrow(run, INDEX_SCHEMA.partition(", ")[2])
    return stored(built.withColumn("segment", F.monotonically_increasing_id()).select(_COLUMNS))


_COLUMNS = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]


class Windows:
    """The windows of a block of items: their first words' places in the items' concatenated words, their lengths and items."""

    def __init__(self, items: Items, width: int):
        self.names = [x for x, _ in items]
        self.words = [w for _, ws in items for w in ws]
        sizes = np.array([len(ws) for _, ws in items], np.int64)
        spans = np.minimum(width, sizes)
        counts = np.where(sizes > 0, sizes - spans + 1, 0)
        self.owner = np.repeat(np.arange(len(items)), counts)
        within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        self.begins = (np.cumsum(sizes) - sizes)[self.owner] + within
        self.lengths = spans[self.owner]
        self.width = width

    def places(self, some: np.ndarray) -> np.ndarray:
        """Places of the words of some windows, one row each; a short window repeats its first word."""
        step = np.arange(self.width)
        return self.begins[some, None] + np.where(step < self.lengths[some, None], step, 0)


class Segment:
    """One index segment, read back: each term's slot, and the positions of slot s in ``positions[first[s]:ends[s]]``."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        def numbers(column: str) -> np.ndarray:
            return batch.column(column)[row].values.to_numpy(zero_copy_only=False).astype(np.int64)

        self.starts, self.sizes, self.ends = numbers("starts"), numbers("n_words"), numbers("ends")
        self.positions = np.cumsum(np.frombuffer(batch.column("steps")[row].as_py(), np.int32).astype(np.int64))
        self.slot = {t: i for i, t in enumerate(batch.column("terms")[row].as_py())}
        self.first = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        self.counts = self.ends - self.first
        self.length = int(self.starts[-1] + self.sizes[-1] + 1) if len(self.starts) else 0
        # all lists in one: a list's positions lie between its slot's number times the length and the next one's
        self.keys = np.repeat(np.arange(len(self.counts)), self.counts) * self.length + self.positions

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, "right") - 1

    def list_of(self, term: bytes) -> np.ndarray:
        i = self.slot.get(term)
        return self.positions[:0] if i is None else self.positions[self.first[i] : self.ends[i]]

    def holds(self, slots: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each position is in the list of its slot."""
        wanted = slots * self.length + positions
        at = np.searchsorted(self.keys, wanted)
        return self.keys[np.minimum(at, len(self.keys) - 1)] == wanted

    def phrases(self, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its first word) of each occurrence."""
        nothing = np.empty(0, np.int64)
        if not len(self.keys) or not len(w.begins):
            return nothing, nothing
        slots = np.fromiter((self.slot.get(t, -1) for t in w.words), np.int64, len(w.words))
        lacking = np.concatenate([[0], np.cumsum(slots < 0)])
        whole = np.flatnonzero(lacking[w.begins + w.lengths] == lacking[w.begins])
        found = []
        for at in range(0, len(whole), OPEN // w.width):
            found += self._intersect(w, slots, whole[at : at + OPEN // w.width])
        return (np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])) if found else (nothing, nothing)

    def _intersect(self, w: Windows, slots: np.ndarray, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        places = w.places(some)
        frequency = self.counts[slots[places]]
        order = np.argsort(frequency, axis=1, kind="stable")  # from the rarest term on
        rarest = np.take_along_axis(frequency, order[:, :1], 1)[:, 0]
        held = np.cumsum(rarest)
        start = 0
        while start < len(some):  # so that about ``OPEN`` candidates are open at once
            stop = max(start + 1, int(np.searchsorted(held, (held[start - 1] if start else 0) + OPEN, "right")))
            n = rarest[start:stop]
            row = np.repeat(np.arange(start, stop), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            anchor = places[row, order[row, 0]]
            begin = self.positions[self.first[slots[anchor]] + nth] - (anchor - places[row, 0])
            keep = (begin >= 0) & (begin + w.lengths[some[row]] <= self.length)
            row, begin = row[keep], begin[keep]
            for k in range(1, w.width):
                if not len(row):
                    break
                place = places[row, order[row, k]]
                keep = self.holds(slots[place], begin + (place - places[row, 0]))
                row, begin = row[keep], begin[keep]
            if len(row):
                yield some[row], begin
            start = stop

    def near(self, words: list[bytes], span: int) -> np.ndarray:
        """Documents (by place) in which ``words`` all stand within ``span`` words."""
        lists = [self.list_of(t) for t in words]
        if not lists or not all(map(len, lists)):
            return np.empty(0, np.int64)
        begin = np.concatenate(lists)
        doc = self.document(begin)
        end = np.minimum(begin + span, self.starts[doc] + self.sizes[doc])
        good = np.ones(len(begin), bool)
        for x in lists:
            good &= np.searchsorted(x, end) > np.searchsorted(x, begin)
        return np.unique(doc[good])


RESULT_SCHEMA = "segment long, ordinal int, doc_id long, text_key long, n_words long, hits array<struct<first_word:int,end_word:int>>, items array<string>, near_items array<string>"
_RESULT = [x.split()[0] for x in RESULT_SCHEMA.split(", ")]
_HITS = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32())]))


def search_segment(batch: pa.RecordBatch, row: int, windows: Windows, near: list[tuple[str, list[bytes]]], span: int) -> pa.RecordBatch:
    """The documents of one segment (a row of ``batch``) with what they hold; see ``RESULT_SCHEMA``."""
    x = Segment(batch, row)
    window, begin = x.phrases(windows)
    hits: list[list] = [[] for _ in x.starts]
    items_of: list[set[str]] = [set() for _ in x.starts]
    near_of: list[set[str]] = [set() for _ in x.starts]
    if len(begin):
        edge = np.zeros(x.length + 1, np.int32)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + windows.lengths[window], -1)
        inside = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
        for s, e in np.flatnonzero(np.diff(inside)).reshape(-1, 2):
            d = int(x.document(s))
            hits[d].append({"first_word": int(s - x.starts[d]), "end_word": int(e - x.starts[d])})
        for d, k in np.unique(np.stack([x.document(begin), windows.owner[window]], 1), axis=0):
            if windows.names[k] is not None:
                items_of[d].add(windows.names[k])
    for name, words in near:
        for d in x.near(words, span):
            near_of[d].add(name)
    n = len(x.starts)
    columns = [pa.array([batch.column("segment")[row].as_py()] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), batch.column("doc_ids")[row].values, batch.column("text_keys")[row].values, pa.array(x.sizes), pa.array(hits, _HITS), pa.array([sorted(v) for v in items_of], pa.list_(pa.string())), pa.array([sorted(v) for v in near_of], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, _RESULT)


def term_counts(index: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """How often each of ``terms`` (of a bounded block of items) stands in the corpus; reads the lists' lengths, not the lists."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for row in range(batch.num_rows):
                ends = batch.column("ends")[row].values.to_numpy(zero_copy_only=False)
                counts = np.diff(ends, prepend=0)
                for term, n in zip(batch.column("terms")[row].as_py(), counts.tolist()):
                    if term in sent.value:
                        held[term] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["term", "n"])

    found = index.select("terms", "ends").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r["term"]): r["n"] for r in found.collect()}


def rarest_words(index: DataFrame, items: Items, terms: int) -> list[tuple[str, list[bytes]]]:
    """Of each item with an id, its ``terms`` distinct words that are rarest in the corpus (ties by bytes); items with a word that the corpus lacks among them are left out."""
    counts = term_counts(index, {w for _, ws in items for w in ws})
    chosen = ((name, sorted(set(ws), key=lambda t: (counts.get(t, 0), t))[:terms]) for name, ws in items if name is not None)
    return [(name, ws) for name, ws in chosen if all(t in counts for t in ws)]


def search(index: DataFrame, items: Items, width: int = WINDOW, proximity: tuple[int, int] | None = None) -> DataFrame:
    """For each indexed document: word ranges inside occurrences of items' windows, those items, and items near.

    ``items``: (id, words), a bounded block; those without an id count for the
    ranges alone. ``proximity``: (terms, span) reports as near the items whose
    so many rarest words (in the corpus) all stand within so many words.
    """
    near = rarest_words(index, items, proximity[0]) if proximity else []
    sent: Broadcast = index.sparkSession.sparkContext.broadcast((items, near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(sent.value[0], width)
        for batch in batches:
            for row in range(batch.num_rows):
                yield search_segment(batch, row, windows, sent.value[1], proximity[1] if proximity else 0)

    return index.mapInArrow(run, RESULT_SCHEMA)


def item_blocks(bench: DataFrame, limit: int) -> Iterator[Items]:
    """The items of ``bench`` (item_id, text) in blocks of about ``limit`` bytes; those without a word take no part."""
    block, held = [], 0
    for row in bench.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        words = words_of(row["text"])
        if words:
            block.append((row["item_id"], words))
            held += len(row["text"])
        if held >= limit:
            yield block
            block, held = [], 0
    if block:
        yield block


def united(hits: list[dict]) -> list[dict]:
    """Word ranges, sorted, with those that overlap or touch made one."""
    out: list[dict] = []
    for x in sorted(hits, key=lambda x: x["first_word"]):
        if out and out[-1]["end_word"] >= x["first_word"]:
            out[-1]["end_word"] = max(out[-1]["end_word"], x["end_word"])
        else:
            out.append(dict(x))
    return out


def find_in(index: DataFrame, bench: DataFrame, width: int = WINDOW, proximity: tuple[int, int] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document of a stored ``index`` with what ``bench`` (item_id, text) it holds; see ``RESULT_SCHEMA``.

    The test set is sought in blocks of ``block_bytes``. With several, what each
    block finds is written before the next is sought, and the blocks' word
    ranges are united per document.
    """
    blocks = item_blocks(bench, block_bytes)
    head, second = next(blocks, []), next(blocks, None)
    if second is None:
        return search(index, head, width, proximity)
    every = search(index, [], width).select("segment", "ordinal", "doc_id", "text_key", "n_words")
    some = None
    for block in (b for first in ([head, second], blocks) for b in first):
        found = cut(search(index, block, width, proximity).where("size(hits) + size(near_items) > 0").select("segment", "ordinal", "hits", "items", "near_items"))
        some = found if some is None else some.unionByName(found)
    gathered = some.groupBy("segment", "ordinal").agg(F.flatten(F.collect_list("hits")).alias("hits"), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(2, "hits", pa.array([united(x) for x in batch.column("hits").to_pylist()], _HITS))

    merged = gathered.mapInArrow(run, gathered.schema)
    met = every.join(merged, ["segment", "ordinal"], "left")
    return met.select(*_RESULT[:5], *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("hits", "array<struct<first_word:int,end_word:int>>"), ("items", "array<string>"), ("near_items", "array<string>"))))


def find_items(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """``find_in`` over an index that is built of ``docs`` (doc_id, text).

    Null texts have no words; null doc_ids stay null; repeated rows give
    repeated rows; other columns are ignored; with an empty test set nothing is
    hit; items without an id hit words but aren't named.
    """
    return find_in(build_index(docs), bench, **how)


def contamination(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """``find_items`` with the number of hit words and the verdict: a hit word, and hit words at least a twentieth of all."""
    n_hit = F.expr("aggregate(hits, 0L, (acc, x) -> acc + x.end_word - x.first_word)")
    return find_items(docs, bench, **how).withColumn("n_hit", n_hit).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def decontaminate(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all of their columns."""
    bad = cut(contamination(docs, bench, **how).where("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct())
    same = docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs["text"]) == bad["_bad_key"])
    return docs.join(broadcast_if_small(bad), same, "left_anti")
