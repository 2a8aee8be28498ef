"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

The kernel counts the common subsequences of two strings, each weighted down by
the characters it spans, so an insult with gaps or inserted characters stays
close to the plain one. Landmarks are strings that mark toxic training rows. A
sentence is described by its words' largest kernel values with each landmark,
mapped by the inverse root of the landmarks' own kernel matrix, and a linear
machine on that decides. Labels belong to documents, so training is
multiple-instance: every sentence of a clean document is a negative example,
while in a toxic document only the sentences that the machine itself finds
most toxic are positive ones. A document's score is a logistic link, fitted on
whole documents, from the machine's margins for its three most toxic words, how
many words are on the toxic side, and its length.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from plumbline.plans.runtime import cut

from .arrow import release, slices
from .columns import clear_of

#: Labelled rows, and bytes of their texts, that training may use of each label; the rows of smallest hash are taken.
TRAIN_ROWS, TRAIN_BYTES = 1500, 32 << 20
#: Landmarks; length of subsequences; weight of each character spanned; kernel values below the floor count as none.
LANDMARKS, ORDER, DECAY, FLOOR = 48, 3, 0.7, 0.45
#: Evidence that a landmark needs: the likelihood ratio statistic of its share of the words of toxic and of clean rows,
#: at least so much and at least this part of the best one's; and how many times the share has to be.
EVIDENCE, PART, RATIO = 40.0, 0.03, 3.0
#: A longer string takes the place of one inside it that has so little more evidence.
CLOSE = 0.7
#: A sentence of a toxic row that comes so close to a landmark is a positive example from the start.
PLAIN = 0.9
#: Words longer than this are looked at in overlapping windows.
LONGEST = 24
#: Distinct words a task remembers at a time; what is forgotten is computed again.
REMEMBERED = 150_000

_SENTENCE = re.compile(r"[.!?]+\s|\n")
_SPELLED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_MARKS = {c: None for c in range(0x21, 0x7F) if not chr(c).isalnum()}


def words_of(sentence: str) -> list[str]:
    """The words of a sentence in lower case; letters spelled out one by one are joined to one word."""
    found = sentence.lower().split()
    if _SPELLED.search(sentence):
        found += [re.sub(r"\s", "", m[0]) for m in _SPELLED.finditer(sentence.lower())]
    return found


def kernel(words: list[str], landmark: str, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The gap-weighted subsequence kernel of each word with ``landmark``, for subsequences of ``order`` characters."""
    n, width, length = len(words), max(map(len, words), default=0), len(landmark)
    codes = np.zeros((width, n), np.int32)
    for i, w in enumerate(words):
        codes[: len(w), i] = [ord(c) for c in w]
    total = np.zeros(n)
    # open_[i][b]: common subsequences of i characters within the word so far and landmark[:b], counted to both ends
    open_ = np.zeros((order, length + 1, n))
    open_[0] = 1.0
    for a in range(width):
        before = open_.copy()
        match = [codes[a] == ord(c) for c in landmark]
        for b in range(length):
            total += np.where(match[b], decay * decay * before[order - 1, b], 0.0)
        for i in range(1, order):
            closed = np.zeros(n)
            for b in range(length):
                closed = decay * closed + np.where(match[b], decay * decay * before[i - 1, b], 0.0)
                open_[i, b + 1] = decay * before[i, b + 1] + closed
    return total


def common_length(codes: np.ndarray, landmark: str) -> np.ndarray:
    """Length of the longest common subsequence of each column of ``codes`` (characters x words) with ``landmark``, bit-parallel."""
    full = np.uint32((1 << len(landmark)) - 1)
    state = np.full(codes.shape[1], full, np.uint32)
    masks: dict[int, int] = {}
    for i, c in enumerate(landmark):
        masks[ord(c)] = masks.get(ord(c), 0) | 1 << i
    for row in codes:
        met = np.zeros(len(row), np.uint32)
        for code, mask in masks.items():
            met[row == code] = mask
        hit = state & met
        state = ((state + hit) | (state & ~met)) & full
    return len(landmark) - np.bitwise_count(state)


def _pieces(word: str) -> list[str]:
    """The word without ASCII marks, between signs for its start and end, in windows if it is long; none if under three letters are left."""
    word = word.translate(_MARKS)
    if len(word) < 3:
        return []
    word = f"^{word}$"
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


@dataclass
class Features:
    """Kernel values of words with the landmarks, as shares of each landmark's own."""

    landmarks: list[str]

    def __post_init__(self) -> None:
        self.own = [float(kernel([z], z)[0]) for z in self.landmarks]

    def of(self, words: list[str]) -> dict[str, np.ndarray]:
        """Values of the words that come near any landmark; near means all but one of its characters in order (two, of eight or more)."""
        stripped = [(w, p) for w in words for p in _pieces(w)]
        found: dict[str, np.ndarray] = {}
        for at in range(0, len(stripped), 1 << 16):
            self._some(stripped[at : at + (1 << 16)], found)
        return found

    def _some(self, stripped: list[tuple[str, str]], found: dict[str, np.ndarray]) -> None:
        if not stripped:
            return
        pieces = [p for _, p in stripped]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.int32)
        codes = np.zeros((int(lengths.max()), len(pieces)), np.int32)
        first = np.cumsum(lengths) - lengths
        column = np.repeat(np.arange(len(pieces)), lengths)
        codes[np.arange(len(flat)) - first[column], column] = flat
        bits = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (flat & 63).astype(np.uint64)), first)
        for j, z in enumerate(self.landmarks):
            need = max(3, len(z) - 1 - (len(z) >= 8))
            mask = np.uint64(sum(1 << b for b in {ord(c) & 63 for c in z}))
            lack = int(mask).bit_count() - np.bitwise_count(bits & mask)
            some = np.flatnonzero((lack <= len(z) - need) & (lengths >= need))
            if not len(some):
                continue
            some = some[common_length(codes[:, some], z) >= need]
            if not len(some):
                continue
            values = np.minimum(1.0, kernel([pieces[i] for i in some], z) / self.own[j])
            for i, v in zip(some, values):
                if v >= FLOOR:
                    vector = found.setdefault(stripped[i][0], np.zeros(len(self.landmarks)))
                    vector[j] = max(vector[j], v)


@dataclass
class Model:
    """What scoring needs; a few kilobytes whatever the corpus."""

    landmarks: list[str]
    root: np.ndarray  # inverse root of the landmarks' kernel matrix
    weights: np.ndarray
    bias: float
    link: np.ndarray  # of the document's features, then a constant

    def margins(self, features: np.ndarray) -> np.ndarray:
        return features @ (self.root @ self.weights) + self.bias

    def score(self, features: np.ndarray) -> np.ndarray:
        """Scores from rows of ``document_features``."""
        return 1 / (1 + np.exp(-np.clip(features @ self.link[:-1] + self.link[-1], -50, 50)))


def document_features(margins: dict[str, float], words: list[str], least: float) -> list[float]:
    """The three largest margins of distinct words, the words with margins above 0 and all words (by logarithm).

    ``margins``: of the words that come near a landmark; the others have ``least``.
    """
    near = [w for w in words if w in margins]
    top = sorted((margins[w] for w in set(near)), reverse=True)[:3]
    top = [max(x, least) for x in top] + [least] * (3 - len(top))
    return [*top, float(np.log1p(sum(margins[w] > 0 for w in near))), float(np.log1p(len(words)))]


def _flat(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces' characters one after another; of each, its piece and where that ends."""
    lengths = np.fromiter(map(len, pieces), np.int32, len(pieces))
    flat = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.repeat(np.arange(len(pieces), dtype=np.int32), lengths), np.repeat(np.cumsum(lengths, dtype=np.int32), lengths)


def _grams(flat: np.ndarray, last: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where strings of ``k`` characters begin that stay inside a piece, and a hash of each."""
    at = np.flatnonzero(np.arange(len(flat), dtype=np.int32) + k <= last).astype(np.int32)
    code = np.zeros(len(at), np.uint64)
    for j in range(k):
        code *= np.uint64(0x9E3779B97F4A7C15)
        code += flat[at + j]
    return at, code


def choose_landmarks(toxic: Iterable[set[str]], clean: Iterable[set[str]], n: int = LANDMARKS) -> list[str]:
    """Strings of four to eight characters (marks of word ends included) that tell the words of toxic rows from those of clean ones.

    Candidates that no clean row holds and that begin a word come first, then by likelihood ratio, of equal ones the longest; a longer string with nearly the evidence replaces a shorter one. One
    is passed over if most of the words that it stands in hold a chosen one.
    """
    counts: list[Counter[str]] = [Counter(), Counter()]
    for c, docs in zip(counts, (toxic, clean)):
        for d in docs:
            c.update(p for w in d for p in _pieces(w))
    if not counts[0]:
        return []
    total = [sum(c.values()) for c in counts]
    own = sorted(counts[0])  # a string that no toxic row holds is no candidate, so only these pieces' are listed
    weight = [np.fromiter((c[p] for p in own), float, len(own)) for c in counts]
    rest = sorted(counts[1].keys() - counts[0].keys())
    rest_weight = np.fromiter((counts[1][p] for p in rest), float, len(rest))
    del counts
    flat, owner, last = _flat(own)
    candidates: list[tuple[float, float, int, str]] = []
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for k in range(4, 9):
        at, code = _grams(flat, last, k)
        known, first, group = np.unique(code, return_index=True, return_inverse=True)
        a, c = (np.bincount(group, w[owner[at]], len(known)) for w in weight)
        for i in range(0, len(rest), 1 << 15):
            flat_, owner_, last_ = _flat(rest[i : i + (1 << 15)])
            at_, code_ = _grams(flat_, last_, k)
            place = np.minimum(np.searchsorted(known, code_), max(0, len(known) - 1))
            met = known[place] == code_ if len(known) else np.zeros(len(code_), bool)
            c += np.bincount(place[met], rest_weight[i + owner_[at_[met]]], len(known))
        share = (a + c) / sum(total)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.where(a > 0, a * np.log(a / (total[0] * share)), 0) + np.where(c > 0, c * np.log(c / (total[1] * share)), 0))
        good = np.flatnonzero((a / total[0] > RATIO * c / max(1, total[1])) & (ratio > EVIDENCE))
        good = good[np.argsort(-ratio[good], kind="stable")][:2000]
        by_group = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group))
        for g in good:
            members = owner[at[by_group[(ends[g - 1] if g else 0) : ends[g]]]]
            start = at[first[g]]
            text = "".join(map(chr, flat[start : start + k].tolist()))
            candidates.append((bool(c[g] == 0) + (text[0] == "^"), round(float(ratio[g]), 3), k, text))
            held[text] = (members, weight[0][members])
    chosen: list[str] = []
    explained = np.zeros(len(own), bool)
    least = PART * max((x[1] for x in candidates), default=0)
    for _, evidence, _, g in sorted(candidates, reverse=True):
        if len(chosen) == n:
            break
        if evidence < least:
            continue
        g = max((x for x in candidates if g in x[3] and x[1] >= CLOSE * evidence), key=lambda x: (x[2], x[1]))[3]
        members, weights = held[g]
        if weights[explained[members]].sum() < 0.5 * weights.sum():
            chosen.append(g)
            explained[members] = True
    return chosen


def linear_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> tuple[np.ndarray, float]:
    """Weights and bias of least squared hinge loss, by Newton steps on the examples inside the margin. y: 1 or -1."""
    rows = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(rows.shape[1])
    ridge = np.diag(np.append(np.ones(x.shape[1]), 1e-6))
    for _ in range(50):
        open_ = y * (rows @ w) < 1
        r, k = rows[open_], (c * weight)[open_]
        new = np.linalg.solve(ridge + (r * k[:, None]).T @ r, (r * k[:, None]).T @ y[open_])
        if np.allclose(new, w, atol=1e-9):
            break
        w = 0.5 * w + 0.5 * new if _ > 20 else new
    return w[:-1], float(w[-1])


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, toxic) rows; without both labels, or without a telling string, it scores the toxic share."""
    share = (sum(t for _, t in rows) + 0.5) / (len(rows) + 1) if rows else 0.01
    flat = Model([], np.zeros((0, 0)), np.zeros(0), 0.0, np.array([0.0] * 5 + [min(-0.1, float(np.log(share / (1 - share))))]))
    sentences = [[[sys.intern(w) for w in words_of(s)] for s in _SENTENCE.split(text)] for text, _ in rows]
    toxic = np.array([t for _, t in rows], bool)
    if not len(rows) or toxic.all() or not toxic.any():
        return flat

    def words_with(label: bool) -> Iterator[set[str]]:
        return ({w for s in d for w in s} for d, t in zip(sentences, toxic) if t == label)

    landmarks = choose_landmarks(words_with(True), words_with(False))
    if not landmarks:
        return flat
    features = Features(landmarks)
    known = features.of(sorted({w for d in sentences for s in d for w in s}))
    gram = np.array([kernel(landmarks, z) for z in landmarks])
    gram /= np.sqrt(np.outer(np.diag(gram), np.diag(gram)))
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T

    x, owner = [], []
    for k, d in enumerate(sentences):
        vs = [np.max([known[w] for w in s if w in known], axis=0) for s in d if any(w in known for w in s)]
        x += [np.zeros(len(landmarks)), *vs]
        owner += [k] * (1 + len(vs))
    x, owner = np.array(x), np.array(owner)
    mapped = x @ root
    margin = x.sum(1)
    first = np.searchsorted(owner, np.arange(len(rows)))
    for turn in range(4):
        top = np.maximum.reduceat(margin, first)
        positive = toxic[owner] & ((margin >= top[owner]) | (margin > 0) & (turn > 0) | (x.max(1) >= PLAIN)) & x.any(1)
        negative = ~toxic[owner]
        used = positive | negative
        y = np.where(positive, 1.0, -1.0)[used]
        if not positive.any():
            return flat
        weight = np.where(y > 0, 1 / positive.sum(), 1 / negative.sum()) * 100
        weights, bias = linear_machine(mapped[used], y, weight)
        margin = mapped @ weights + bias
    of_word = {w: float(m) for w, m in zip(known, np.array(list(known.values())) @ (root @ weights) + bias)}
    design = np.array([document_features(of_word, [w for s in d for w in s], bias) + [1.0] for d in sentences])
    goal = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    link = np.zeros(design.shape[1])
    ridge = np.diag([1.0] * 5 + [1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ link, -40, 40)))
        curve = (design * (p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(curve, design.T @ (goal - p) - ridge @ link)
        link = link + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return Model(landmarks, root, weights, bias, link)


def held_out(doc_id: str = "doc_id"):
    """True for ids whose text's CRC-32 is divisible by five; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, limit_bytes: int = TRAIN_BYTES) -> list[tuple[str, int]]:
    """At most ``limit`` rows and ``limit_bytes`` bytes of each label that aren't held out.

    Rows are taken by the smallest hashes of their ids, whole texts only; one
    that doesn't fit any more is passed over. Several labels of a document count
    as the worst, and of several texts with its id the first by text stands.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    chosen = [known.where(f"toxic = {t}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for t in (0, 1)]
    some = chosen[0].unionByName(chosen[1])
    met = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").where("text is not null")
    rows = cut(met.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")))
    held, fitting = [0, 0], []
    for r in rows.select("doc_id", "toxic", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if held[r["toxic"]] + r["n"] <= limit_bytes:
            held[r["toxic"]] += r["n"]
            fitting.append(r["doc_id"])
    return [(r["text"], r["toxic"]) for r in rows.where(F.col("doc_id").isin(fitting)).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    """``fit`` on ``training_rows``; what that took of the driver's memory is given back."""
    model = fit(training_rows(docs, labels, limit))
    release()
    return model


class Scorer:
    """Scores texts one slice after another, remembering the kernel values of words it has met."""

    def __init__(self, model: Model):
        self.model, self.features = model, Features(model.landmarks)
        self.seen: set[str] = set()
        self.near: dict[str, float] = {}

    def of(self, rows: list[str]) -> tuple[np.ndarray, list[list[str]]]:
        """(scores, words) of texts."""
        words = [words_of(text) for text in rows]
        if len(self.seen) > REMEMBERED:
            self.seen, self.near = set(), {}
        new = set().union(*words) - self.seen
        self.seen |= new
        if self.model.landmarks and (found := self.features.of(sorted(new))):
            self.near.update(zip(found, self.model.margins(np.array(list(found.values()))).tolist()))
        return self.model.score(np.array([document_features(self.near, ws, self.model.bias) for ws in words])), words

    def worst_sentence(self, text: str) -> str:
        margins = ((max((self.near[w] for w in words_of(s) if w in self.near), default=self.model.bias), s.strip()) for s in _SENTENCE.split(text))
        return max(margins, key=lambda x: x[0])[1]


def _rows(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column("text").to_pylist()]


ADDED = ("score", "predicted", "worst_sentence")


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the columns ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) and ``worst_sentence`` (of predicted rows).

    Whole texts are read; null and empty ones score as texts without any telling
    word. A column of ``docs`` that has one of these names is called ``<name>_input``.
    """
    given = clear_of(docs, ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches, "text", 2 << 20):
            rows = _rows(batch)
            scores, _ = scorer.of(rows)
            worst = [scorer.worst_sentence(text) if score >= 0.5 else None for text, score in zip(rows, scores)]
            columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(worst, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *ADDED])

    schema = StructType([*given.schema, StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("worst_sentence", StringType())])
    return given.mapInArrow(run, schema)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that ``model`` doesn't predict toxic, with all of their columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches, "text", 2 << 20):
            yield batch.filter(pa.array(scorer.of(_rows(batch))[0] < 0.5))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, worst_sentence) of each row of ``docs`` (doc_id, text).

    Trained on ``labels`` (doc_id, toxic) of rows that aren't held out. A null
    doc_id stays null; repeated rows give repeated rows; other columns are
    ignored; with no usable labels every text scores alike, below 0.5.
    """
    model = train(docs, labels, limit)
    found = with_scores(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted", "worst_sentence")
