"""Quality classifier, language-model scores and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from conceptlink.llm import lm_score, quality

DATA = "/root/testdata/sf0.01"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality.score_quality(docs, labels, keep=("lang",)).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    truth = [(r.quality, rows[r.doc_id]) for r in labels.collect() if rows[r.doc_id].held_out]
    right = sum(q == r.predicted for q, r in truth)
    assert right >= 0.93 * len(truth)
    good, bad = ([r.score for q, r in truth if q == k] for k in (1, 0))
    assert sum(g > b for g in good for b in bad) > 0.97 * len(good) * len(bad)


def test_held_out_labels_are_never_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    fold = "pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2"
    turned = labels.selectExpr("doc_id", f"case when {fold} then 1 - quality else quality end as quality")
    a, b = ({r.doc_id: r.score for r in quality.score_quality(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_quality_edge_cases(spark):
    rows = [(None, None), (1, ""), (2, "a b"), (2, "a b"), (3, "x " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([(2, None)], "doc_id long, quality int")
    assert {r.score for r in quality.score_quality(df, none).collect()} == {0.5}
    assert quality.score_quality(df, none).count() == 5
    assert quality.score_quality(df.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (3, 1)], "doc_id long, quality int")
    assert quality.score_quality(df, one).count() == 5


def test_word_vectors_and_pooling_by_hand():
    body = np.frombuffer(b"aa bb %% aa", np.uint8)
    bucket, row, capitals = quality.tokens_of(body, np.array([0, 5, 11]))
    assert row.tolist() == [0, 0, 1, 1] and bucket[0] == bucket[3] and not capitals.any()
    vectors = np.random.default_rng(0).normal(size=(quality.BUCKETS, quality.DIMS)).astype(np.float32)
    got = quality.pooled(body, np.array([0, 5, 11]), vectors)
    assert np.allclose(got[0, : quality.DIMS], vectors[bucket[:2]].mean(axis=0), atol=1e-6)
    assert np.allclose(got[1, quality.DIMS : 2 * quality.DIMS], vectors[bucket[2:]].std(axis=0), atol=1e-5)


def test_temperature_sharpens_or_softens_to_the_truth():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4))
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.Network(x, y, epochs=20)
    p = net.score(x)
    for lo in (0.1, 0.4, 0.7):
        some = (p > lo) & (p < lo + 0.2)
        assert abs(p[some].mean() - y[some].mean()) < 0.08


# ---------------------------------------------------------------- language model


def lm_tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER)) + [None]


def lm_corpus():
    rng = random.Random(6)
    sets = [[f"{a}{i}{b}" for i in range(60)] for a, b in (("en", "ly"), ("Fr", "ique"), ("de", "ßt"))]
    texts = [None, "", " \n", "One"]
    for _ in range(160):
        words = rng.choice(sets)
        texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))))
    return [(i, t) for i, t in enumerate(texts)]


def test_base_scores_equal_brute_force_and_the_model_is_better(spark):
    rows = lm_corpus()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter(w for i, t in rows if not held[i] for w in lm_tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lm_score.score_texts(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")).collect()}
    for i, t in rows:
        words = lm_tokens(t)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), abs=1e-6)
    some = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in some) > 0.95 * sum(r.base_score for r in some)
    assert all(r.score < 0 for r in some)


def lm_history(rng, n):
    words = rng.integers(0, 2**64, 40, dtype=np.uint64)
    return [words[rng.integers(0, 40, n)] for _ in range(3)]


def test_probabilities_of_a_small_vocabulary_sum_to_one():
    """Every known token and one unseen token per member, in any history, by brute force."""
    rng = np.random.default_rng(2)
    weights = rng.normal(size=(lm_score.ROWS, lm_score.CLASSES)).astype(np.float32)
    words = [f"w{i}".encode() for i in range(3000)]
    hashes = rng.integers(0, 2**64, len(words), dtype=np.uint64)
    endings, counts = rng.integers(0, lm_score.ENDINGS, len(words)), rng.integers(1, 50, len(words))
    order = np.argsort(-counts, kind="stable")
    top = order[: lm_score.FREQUENT]
    tokens, types = np.bincount(endings, counts, lm_score.ENDINGS), np.bincount(endings, minlength=lm_score.ENDINGS)
    np.subtract.at(tokens, endings[top], counts[top])
    np.subtract.at(types, endings[top], 1)
    model = {"frequent": hashes[top], "weights": weights, "tokens": tokens, "types": types, "ends": 7, "discount": 0.4, "n": int(counts.sum()) + 7, "v": 3001}
    # one unseen token for each member of endings
    unseen = rng.integers(0, 2**64, lm_score.ENDINGS, dtype=np.uint64)
    for history in (rng.integers(0, 2**64, 3, dtype=np.uint64) for _ in range(3)):
        one = lm_score.Sequence.__new__(lm_score.Sequence)
        one.words = np.concatenate((hashes, unseen))
        n = len(one.words) + 1
        one.local, one.place = np.arange(n), np.full(n, 9)
        one.word = np.append(one.words, lm_score.END_WORD)
        one.history = [np.full(n, h) for h in history]
        known = np.concatenate((counts, np.zeros(lm_score.ENDINGS, np.int64)))
        _, score = lm_score.scores_of(one, model, np.concatenate((endings, np.arange(lm_score.ENDINGS))), known)
        assert (10.0**score).sum() == pytest.approx(1, abs=2e-3)


def test_draws_follow_the_softmax_and_observed_counts_are_exact():
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(lm_score.ROWS, lm_score.CLASSES)).astype(np.float32)
    rows = lm_score.feature_rows(lm_history(rng, 1), None)
    logits = lm_score.logits_of(weights, rows)
    assert np.allclose(logits[0], sum(weights[int(r[0])] for r in rows), atol=1e-5)
    draws = lm_score.drawn(np.repeat(logits, 200_000, axis=0), rng.random(200_000, dtype=np.float32))
    share = np.bincount(draws, minlength=lm_score.CLASSES) / len(draws)
    want = np.exp(logits[0]) / np.exp(logits[0]).sum()
    assert np.abs(share - want).max() < 0.004
    likely = lm_score.likelihoods(weights, [r.repeat(64) for r in rows], np.arange(64))
    assert np.allclose(likely, np.log(want), atol=1e-4)
    words = rng.integers(0, 2**64, 50, dtype=np.uint64)
    row = {"words": words.tobytes(), "sizes": [4000, 0, 2000], "tokens": lm_score.in_planes(rng.integers(0, 50, 6000))}
    sequence, numbers = lm_score.Sequence(row), np.append(rng.integers(0, lm_score.END, 50), lm_score.END)
    seen, met = (np.zeros(lm_score.ROWS * lm_score.CLASSES, np.int32) for _ in range(2))
    lm_score.feature_counts(sequence, numbers, None, seen, met)
    want = Counter()
    begins = [0, 4001, 4002]
    for i, w in enumerate(sequence.local.tolist()):
        first = max(b for b in begins if b <= i)
        back = [np.array([sequence.word[i - k] if i - k >= first else lm_score.START], np.uint64) for k in (1, 2, 3)]
        c, m = divmod(int(numbers[w]), lm_score.MEMBERS)
        want.update((int(r[0]), c) for r in lm_score.feature_rows(back, None))
        want.update((int(r[0]), m) for r in lm_score.feature_rows(back, np.array([c])))
    got = seen.reshape(lm_score.ROWS, -1)
    assert {(int(r), int(c)): int(got[r, c]) for r, c in zip(*np.nonzero(got), strict=True)} == dict(want)
    assert met.sum() == 3 * len(sequence)


def test_held_out_documents_beat_the_base_by_a_tenth(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    some = [r for r in lm_score.score_texts(docs).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in some)
    assert sum(r.score for r in some) / tokens > sum(r.base_score for r in some) / tokens + 0.1


def test_language_model_edge_cases(spark):
    schema = "doc_id long, text string"
    assert lm_score.score_texts(spark.createDataFrame([], schema)).count() == 0
    rows = lm_score.score_texts(spark.createDataFrame([(None, None), (None, "a a"), (5, "b"), (5, "b")], schema)).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 2, 2, 3]


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    clean = max((r for r in rows if r.lang == "en" and 600 < r.n_chars < 3000 and "|" not in r.text), key=lambda r: r.n_chars)
    words = clean.text.split(" ")
    words[len(words) // 2] = "altered"
    more = [(10_001, clean.text), (10_002, " ".join(words))]
    # a passage of 55 words in two good documents that share nothing else
    passage = " ".join(max((r for r in rows if r.lang == "en" and r.doc_id != clean.doc_id), key=lambda r: r.n_chars).text.split()[:55])
    hosts = [r for r in rows if r.lang == "en" and 1500 < r.n_chars < 9000 and r.doc_id != clean.doc_id][:8]
    halves = [(r.text[: len(r.text) // 2], r.text[len(r.text) // 2 :]) for r in hosts]
    more += [(10_010 + k, f"{halves[k][0]} {passage} {halves[k - 1][1]}") for k in range(len(hosts))]
    kept = docs.unionByName(spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in more], docs.schema))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = kept
        if name == "suffix-array dedup":
            assert sum(passage in r.text for r in before.collect()) >= 2
        kept = corpus_pipeline.materialize(stage(spark, before, "/root/testdata/sf0.001"), "test")
        assert kept.columns == list(corpus_pipeline.COLUMNS), name
        seen.append({r.doc_id for r in kept.collect()})
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert len(seen[0] & set(good)) >= 0.93 * len(good)
    assert clean.doc_id in seen[1] or not {10_001, 10_002} & seen[1]
    assert not {10_001, 10_002} & seen[1]
    assert seen[2] == seen[1] and seen[3] <= seen[2]
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert all(passage not in t for t in texts.values())
    done = corpus_pipeline.STAGES[4][1](spark, kept, "/root/testdata/sf0.001")
    assert {r.doc_id for r in done.select("doc_id").collect()} == seen[3]
