import random

import numpy as np

from plumbline.llm import substrings

from .helpers import awkward, documents, empty


def words(rng, n):
    return [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))][0]


def test_gear_and_boundaries_are_what_they_say():
    data = np.frombuffer(words(random.Random(1), 300).encode(), np.uint8)
    h = substrings.gear_hashes(data)
    mask = (1 << 64) - 1
    for i in (0, 5, 15, 16, 200):
        total = sum(int(substrings.GEAR[data[i - j]]) << j for j in range(min(16, i + 1))) & mask
        assert total * 0x9E3779B97F4A7C15 & mask == int(h[i])
    n, r = len(data), substrings.REACH
    assert substrings.boundaries(data).tolist() == [i + 1 for i in range(r, n - r) if h[i] > max(h[i - r : i]) and h[i] > max(h[i + 1 : i + 1 + r])] + [n]
    assert substrings.boundaries(data[:10]).tolist() == [10] and not len(substrings.boundaries(data[:0]))


def test_an_insertion_moves_boundaries_only_nearby():
    text = words(random.Random(2), 400).encode()
    at = len(text) // 2
    a = substrings.boundaries(np.frombuffer(text, np.uint8))
    b = substrings.boundaries(np.frombuffer(text[:at] + b"inserted" + text[at:], np.uint8))
    reach = substrings.REACH + substrings.WINDOW
    assert [x for x in a if x < at - reach] == [x for x in b if x < at - reach]
    assert [x + 8 for x in a if x > at + reach] == [x for x in b if x > at + 8 + reach]


def test_planted_passages_are_found_and_clean_documents_left(spark):
    rng = random.Random(3)
    passage = words(rng, 52)
    texts = [(i, words(rng, rng.randint(80, 300))) for i in range(60)]
    planted = {7, 20, 41}
    texts = [(i, f"{t[: i * 3]} {passage} {t[i * 3 :]}" if i in planted else t) for i, t in texts]
    texts.append((60, words(rng, 30)))
    texts.append((61, texts[60][1]))
    rows = {r.doc_id: r for r in substrings.repeats(documents(spark, texts)).collect()}
    assert len(rows) == 62 and {i for i, r in rows.items() if r.n_spans} == planted | {60, 61}
    assert {i for i, r in rows.items() if r.removable_words} == {20, 41, 61}
    assert all(rows[i].first_doc_ids == [7] for i in planted)
    cleaned = {r.doc_id: r.text for r in substrings.deduplicated(documents(spark, texts)).collect()}
    middle = " ".join(passage.split()[12:40])
    assert middle in cleaned[7] and middle not in cleaned[20] and middle not in cleaned[41]
    assert all(cleaned[i] == t for i, t in texts if i not in planted | {61}) and cleaned[61] == ""
    whole = dict(texts)
    for s in rows[20].spans:
        assert whole[20].encode()[s.start : s.stop].decode() in whole[7]


def test_awkward_tables(spark):
    assert substrings.repeats(empty(spark)).count() == 0
    rows = substrings.repeats(awkward(spark)).collect()
    assert len(rows) == 10 and substrings.deduplicated(awkward(spark)).count() == 10


def test_repeats_of_a_short_period_are_found(spark):
    rng = random.Random(4)
    units = ["der ", "Of Of ", "hello,\n", "да ", "привет! "]
    texts = [(10 * k + i, f"{words(rng, 40 + 7 * i)} {unit * n} {words(rng, 30)}") for k, unit in enumerate(units) for i, n in enumerate((60, 75))]
    texts.append((99, words(rng, 300)))
    rows = {r.doc_id: r for r in substrings.repeats(documents(spark, texts)).collect()}
    assert {i for i, r in rows.items() if r.n_spans} == {i for i, _ in texts} - {99}
    cleaned = {r.doc_id: r.text for r in substrings.deduplicated(documents(spark, texts)).collect()}
    for i, text in texts:
        assert cleaned[i].split()[:40] == text.split()[:40] and cleaned[i].split()[-30:] == text.split()[-30:]


def test_a_passage_around_an_older_quote_is_found(spark):
    rng = random.Random(6)
    left, quote, right = words(rng, 25), words(rng, 26), words(rng, 25)
    passage = f"{left} {quote} {right}"
    texts = [(1, f"{words(rng, 40)} {quote} {words(rng, 40)}"), (2, f"{words(rng, 40)} {passage} {words(rng, 40)}"), (3, f"{words(rng, 40)} {passage} {words(rng, 40)}")]
    rows = {r.doc_id: r for r in substrings.repeats(documents(spark, texts)).collect()}
    assert rows[2].repeated_words == rows[3].repeated_words >= 2 * substrings.MIN_WORDS > rows[2].removable_words > 0
    assert [s.is_home for s in rows[2].spans] == [True, False, True] and rows[3].removable_words == rows[3].repeated_words


def brute_runs(texts, min_words):
    """{doc: [(start, stop)]}: byte ranges of runs of chunks that stand elsewhere too, from the chunks alone."""
    pieces, places = {}, {}
    for i, t in texts:
        data = (t or "").encode()
        stops = substrings.boundaries(np.frombuffer(data, np.uint8)).tolist()
        pieces[i] = list(zip([0, *stops[:-1]], stops))
        for a, b in pieces[i]:
            places.setdefault(data[a:b], []).append((i, a))
    out = {}
    for i, t in texts:
        data, run = (t or "").encode(), []
        for a, b in [*pieces[i], (None, None)]:
            if a is not None and len(places[data[a:b]]) > 1:
                run.append((a, b))
            else:
                if run and words_begun(data, run[0][0], run[-1][1]) >= min_words:
                    out.setdefault(i, []).append((run[0][0], run[-1][1]))
                run = []
    return out


def words_begun(data, start, stop):
    return sum(data[k : k + 1].strip() != b"" and (k == 0 or data[k - 1 : k].strip() == b"") for k in range(start, stop))


def test_spans_equal_brute_force_on_shared_passages(spark):
    rng = random.Random(11)
    pool = [words(rng, rng.randint(15, 90)) for _ in range(12)]
    texts = [(i, " ".join(x for _ in range(rng.randint(1, 4)) for x in (words(rng, rng.randint(0, 60)), rng.choice(pool)))) for i in range(70)] + [(100, None), (101, "")]
    expected = brute_runs(texts, 20)
    found = {}
    for r in substrings.repeats(documents(spark, texts), 20).collect():
        parts = [(s.start, s.stop) for s in r.spans]
        whole = []
        for a, b in parts:  # parts of one run touch
            if whole and whole[-1][1] == a:
                whole[-1] = (whole[-1][0], b)
            else:
                whole.append((a, b))
        if whole:
            found[r.doc_id] = whole
        assert r.n_spans == len(r.spans) and r.repeated_words == sum(s.end_word - s.first_word for s in r.spans)
    assert found == expected and len(found) > 40


def test_clashing_columns_stay(spark):
    rng = random.Random(5)
    shared = words(rng, 60)
    docs = spark.createDataFrame([(i, f"{words(rng, 30)} {shared}", f"r{i}", i, f"c{i}") for i in range(4)], "doc_id long, text string, _row string, _cuts long, `_cut.id` string")
    out = substrings.deduplicated(docs)
    assert out.columns == docs.columns and sorted((r.doc_id, r["_row"], r["_cuts"], r["_cut.id"]) for r in out.collect()) == [(i, f"r{i}", i, f"c{i}") for i in range(4)]
