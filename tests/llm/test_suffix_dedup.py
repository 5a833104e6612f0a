import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conceptlink.llm.queries import op1_suffix_array_dedup
from conceptlink.llm.suffix_dedup import refine_buckets, remove_repeated


def brute(texts, length):
    seen = {}
    for t in texts:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(np.sum(np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1))
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    fresh = lambda k: "".join(rng.choice("abcdé fghßij") for _ in range(k))
    shared = [fresh(rng.randint(200, 700)) for _ in range(6)]
    texts = [None, "", "x" * 3000, "ab" * 900, fresh(399), fresh(20_000)]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.3:
            texts.append(fresh(rng.randint(0, 900)))
        elif kind < 0.7:
            s = rng.choice(shared)
            cut = rng.randint(0, 60)
            texts.append(fresh(rng.randint(0, 500)) + s[cut : len(s) - rng.randint(0, 60)] + fresh(rng.randint(0, 500)))
        elif kind < 0.85:
            t = list(rng.choice([x for x in texts if x]))
            t[rng.randrange(len(t))] = "z"
            texts.append("".join(t))
        else:
            texts.append(rng.choice(texts))
    return texts


@pytest.mark.parametrize("limit", [4096, 2])
def test_equals_brute_force(spark, limit):
    texts = corpus(limit)
    df = spark.createDataFrame([(i, t, i, 1) for i, t in enumerate(texts)], "doc_id long, text string, core int, block int")
    rows = remove_repeated(df, bucket_limit=limit, keep=("core",)).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got == dict(enumerate(brute(texts, 400)))
    assert all(r.core == r.doc_id for r in rows)


def test_empty_repeated_rows_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert remove_repeated(spark.createDataFrame([], schema)).count() == 0
    t = "".join(random.Random(1).choice("abcdef ") for _ in range(500))
    rows = remove_repeated(spark.createDataFrame([(None, t), (None, t), (1, t[:450]), (2, t[:399])], schema)).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in rows) == [(399, 0), (450, 450), (500, 500), (500, 500)]


def test_refinement_keeps_groups_and_distances_apart():
    a, b = b"x" * 50 + b"abcdefghij" * 50, b"y" * 50 + b"abcdefghij" * 50
    same = refine_buckets([a, b], np.array([0, 0]), np.array([50, 50]), 400)
    assert same[0].sum() == same[1].sum() == 101 and not same[0][:50].any()
    assert not any(x.any() for x in refine_buckets([a, b], np.array([0, 1]), np.array([50, 50]), 400))
    assert not any(x.any() for x in refine_buckets([a, b], np.array([0, 0]), np.array([50, 51]), 400))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"\0", b"a", b"ab", b"aab", b"\xff"]), max_size=25).map(b"".join), min_size=1, max_size=6))
def test_refinement_equals_brute_force(texts):
    """Windows of six bytes of texts with repeats, ends and zero bytes; a window meets those at its own distance."""
    got = refine_buckets(texts, np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), 6)
    for k, t in enumerate(texts):
        want = [any(u[i : i + 6] == t[i : i + 6] for j, u in enumerate(texts) if j != k and i + 6 <= len(u)) for i in range(max(0, len(t) - 5))]
        assert got[k].tolist() == want


def test_passages_below_the_removed_length_are_told(spark):
    """Passages of over 50 words below 400 bytes: the query tells them and removes none of their bytes."""
    rng = random.Random(9)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    over, under, longer = fresh(60), fresh(45), fresh(120)
    texts = [f"{fresh(30)} {x} {fresh(20)}" for x in (over, over, under, under, longer, longer)] + [fresh(200), "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in remove_repeated(df, passages=(200, 51)).collect()}
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in rows.items()}
    assert got == dict(enumerate(brute(texts, 400)))
    assert [rows[i].n_passages for i in range(9)] == [1, 1, 0, 0, 1, 1, 0, 0, 0]
    assert all(rows[i].n_removed == 0 and len(over) <= rows[i].passage_bytes < 400 for i in (0, 1))
    assert all(rows[i].n_removed >= 400 and rows[i].passage_bytes >= rows[i].n_removed for i in (4, 5))


@pytest.mark.parametrize("limit", [4096, 2])
def test_removal_is_the_same_with_passages(spark, limit):
    texts = corpus(limit + 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = remove_repeated(df, bucket_limit=limit, passages=(200, 51)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == dict(enumerate(brute(texts, 400)))


def test_query_tells_repeated_passages_of_over_50_words(spark, tmp_path):
    rng = random.Random(10)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = fresh(60)
    texts = [f"{fresh(30)} {passage} {fresh(20)}", f"{fresh(9)} {passage} {fresh(40)}", fresh(120)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op1_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert [(rows[i].n_removed, rows[i].n_passages) for i in range(3)] == [(0, 1), (0, 1), (0, 0)]


def test_stretches_of_few_words_stay(spark):
    rng = random.Random(7)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    long, short = fresh(60), fresh(40)
    texts = [f"{fresh(30)} {long} {fresh(20)}", f"{fresh(10)} {long} {fresh(9)}", f"{fresh(30)} {short} {fresh(20)}", f"{fresh(10)} {short} {fresh(9)}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in remove_repeated(df, length=200, least_words=51).collect()}
    assert all(rows[i].n_spans == 1 and long not in rows[i].kept and rows[i].n_removed >= len(long) for i in (0, 1))
    assert all(rows[i].kept == texts[i] and rows[i].n_removed == 0 for i in (2, 3))
