import hashlib
import random
import re

import numpy as np
import pytest

from conceptlink.llm import decontam

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER).decode())


def brute(docs, items, width=10):
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add("" if name is None else str(name))
    out = {}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for i in range(len(w)):
            for n in {len(x) for x in windows}:
                names = windows.get(tuple(w[i : i + n])) if i + n <= len(w) else None
                if names:
                    hit.update(range(i, i + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc_id] = (len(w), len(hit), len(found), digest, bool(hit))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "a", "Ünd", "straße", "x1", "Y"] + ["".join(rng.choice("abcé") for _ in range(3)) for _ in range(40)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(f"i{k}", fresh(rng.choice([1, 4, 9, 10, 11, 30]))) for k in range(25)]
    docs = []
    for k in range(80):
        w = fresh(rng.choice([0, 1, 9, 40, 300]))
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(items)[1]
            at, lo = rng.randint(0, len(w)), rng.randint(0, len(item))
            w[at:at] = item[lo : lo + rng.choice([3, 9, 10, 25])]
        docs.append((k, "".join(x + rng.choice([" ", "-", ".\n"]) for x in w)))
    docs += [(80, None), (81, ""), (82, "!!!")]
    return docs, [(n, " ".join(t)) for n, t in items] + [("none", None), ("empty", ""), (None, " ".join(items[0][1]) + " extra words here")]


@pytest.mark.parametrize("limit", [32 << 20, 400])
def test_equals_brute_force(spark, limit):
    docs, items = corpus(4)
    df = spark.createDataFrame([(i, t, i, [1]) for i, t in docs], "doc_id long, text string, n_words long, spans array<int>")
    test = spark.createDataFrame(items, "item_id string, text string")
    rows = decontam.find_contamination(df, test, broadcast_bytes=limit).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
    assert got == brute(docs, items)


def test_empty_tables_repeated_rows_and_null_ids(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    docs = spark.createDataFrame([(None, "a b"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert not any(r.contaminated for r in decontam.find_contamination(docs, none).collect())
    items = spark.createDataFrame([("q", "B C"), ("r", "A b")], "item_id string, text string")
    rows = decontam.find_contamination(docs, items).collect()
    assert sorted((str(r.doc_id), r.n_hit, tuple(r.items)) for r in rows) == [("1", 3, ("q", "r")), ("1", 3, ("q", "r")), ("None", 2, ("r",))]
    assert decontam.find_contamination(docs.limit(0), items).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one x two y three"), (2, "one x x x x two three"), (3, "three two one")], "doc_id long, text string")
    items = spark.createDataFrame([("q", "one two three")], "item_id string, text string")
    rows = decontam.find_contamination(docs, items, near=5).collect()
    assert {r.doc_id for r in rows if r.near_items} == {1, 3} and not any(r.items for r in rows)


def test_phrases_stay_inside_documents():
    hashes = np.array([7, 2**63, 7, 2**63, 2**63], np.uint64)
    terms, often, places = decontam.postings_of(hashes)
    assert terms.tolist() == [7, 2**63] and often.tolist() == [2, 3] and places.tolist() == [0, 2, 1, 3, 4]
    index = decontam.PositionalIndex(terms, often, places, np.array([0, 1, 1, 3, 5]), np.array([7, 2**63, 5], np.uint64))
    assert index.phrase((0, 1)).tolist() == [] and index.phrase((1, 0)).tolist() == [1] and index.phrase((1, 1)).tolist() == [3]
    assert index.phrase((0, 2)).tolist() == []


def test_terms_that_agree_in_their_first_bits_are_told_apart():
    hashes = np.array([9, 8, 9, 8, 2**40, 9], np.uint64)
    terms, often, places = decontam.postings_of(hashes)
    assert terms.tolist() == [8, 9, 2**40] and often.tolist() == [2, 3, 1] and places.tolist() == [1, 3, 0, 2, 5, 4]


def test_the_stored_index_is_asked_more_than_once(spark):
    docs, items = corpus(9)
    index = decontam.build_index(spark.createDataFrame(docs, "doc_id long, text string"), "text", {"doc_id": "doc_id"})
    want = brute(docs, items[:12]), brute(docs, items[12:])
    for some, truth in zip((items[:12], items[12:]), want, strict=True):
        got = decontam.search_index(index, some, ["doc_id"], 10).collect()
        assert {r.doc_id: (r.n_words, sum(s.hi - s.lo for s in r.spans), len(r["items"])) for r in got} == {i: t[:3] for i, t in truth.items()}
