import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conceptlink.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = packing.Encoder(PATH)


def ids(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abZé1 \n\t'.,!%*#  ß<|>")) | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_pieces_encode_as_the_whole_text(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(min_codepoint=32, max_codepoint=0x250), min_size=1, max_size=12))
def test_single_pieces_encode_as_the_tokenizer_does(text):
    for piece in (text, " " + text, "".join(c for c in text if c.isalpha()) or "a"):
        assert np.frombuffer(ENCODER.piece(piece), "<u4").tolist() == ids(piece)


def test_special_tokens_keep_their_ids_and_generations_turn(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    encoder = packing.Encoder(PATH)
    assert ids("a <|endoftext|> b") == [64, 220, 50256, 275]
    for text in ("a <|endoftext|> b", "a<|endoftext|>b  <|endoftext|>", "<|endoftext|> it's  they're ", "a b c d e f g a b c", "x" * 5000, " lead", "'s 'll don't."):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids(text)
        assert len(encoder.known) <= 3 and len(encoder.known.older) <= 3


def filled(plan, counts, capacity):
    """Expands a plan's ranges and checks that every sequence is gapless and in bounds."""
    sequences, used = {}, {}
    for length, first, n, base, offset in plan.ranges:
        used.setdefault(length, []).append(first)
    ranges = np.array(sorted(plan.ranges), np.int64).reshape(-1, 5)
    for length in np.flatnonzero(counts):
        mine = ranges[ranges[:, 0] == length]
        for rank in range(counts[length]):
            r = mine[np.searchsorted(mine[:, 1], rank, "right") - 1]
            nth = rank - r[1]
            sequences.setdefault(int(r[3] + nth // r[2]), []).append((int(r[4] + nth % r[2] * length), int(length)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) == plan.sequences
    return plan.sequences


def fewest(lengths, capacity):
    """The optimum by search over multisets, for tiny instances."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= lengths[i] and room not in rooms[:k]:
                go(i + 1, [*rooms[:k], room - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_never_costs_a_sequence(lengths):
    capacity = 20
    counts = np.bincount(lengths, minlength=capacity + 1) if lengths else np.zeros(capacity + 1, np.int64)
    best = fewest(lengths, capacity)
    assert best <= filled(packing.pack_histogram(counts, capacity), counts, capacity) <= best + 1
    for a in np.flatnonzero(counts)[::-1][:1]:
        found = packing.dominant(counts, int(a), capacity)
        if found:
            left = list(lengths)
            for x in found[0]:
                left.remove(x)
            assert 1 + fewest(left, capacity) == best


@pytest.mark.parametrize("seed", range(4))
def test_large_histograms_are_nearly_full(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(np.clip(rng.lognormal(5, 1.2, 20_000), 1, 1024).astype(int), minlength=1025)
    n = filled(packing.pack_histogram(counts, 1024), counts, 1024)
    least = -(-int((counts * np.arange(1025)).sum()) // 1024)
    assert n <= least * 1.005 + 1


def test_documents(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(6))
    texts = [None, "", "one", "one"] + [" ".join(word() for _ in range(rng.choice([3, 50, 400, 2500]))) for _ in range(60)]
    rows = [(i if i != 7 else None, t, 5) for i, t in enumerate(texts)]
    done = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, piece int"), PATH).collect()
    whole = {}
    for r in done:
        whole.setdefault(r.doc_id, []).append(r)
    for doc_id, text, _ in rows:
        want = np.array([*ids(text or ""), 2], "<u4")
        first = len(want) % 1024 or 1024
        cuts = [0, *range(first, len(want) + 1, 1024)]
        got = sorted(whole[doc_id], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in got] == [(k, a, b - a) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert [r.ids_crc32 for r in got] == [zlib.crc32(want[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
    sequences = {}
    for r in done:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
