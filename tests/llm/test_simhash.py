import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from conceptlink.llm import simhash

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(prints, radius=3):
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_documents_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé") for _ in range(4)) for _ in range(300)]
    texts = [None, "", " \t\n", "One", "one two", "A b", "a  B "]
    while len(texts) < 120:
        if rng.random() < 0.5:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))))
        else:
            w = rng.choice([t for t in texts if t and len(t) > 50] or ["x y z w"]).split()
            w[rng.randrange(len(w))] = "Changed"
            texts.append("\n".join(w))
    prints = [fingerprint(t) for t in texts]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.link_near_duplicates(df).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == roots(prints)


@pytest.mark.parametrize("limit", [4096, 3, 1])
def test_crowded_cells_lose_no_link(spark, limit):
    rng = random.Random(limit)
    prints = []
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(25):
            for _ in range(rng.randint(0, 3)):
                at ^= 1 << rng.randrange(64)
            prints.append(at)
    prints = list(dict.fromkeys(prints))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    found = simhash.components(simhash.near_links(df, 3, limit)).collect()
    root = {r.node % (1 << 64): r.root % (1 << 64) for r in found}
    want, have = {}, {}
    for p, r in zip(prints, roots(prints), strict=True):
        want.setdefault(r, set()).add(p)
        have.setdefault(root.get(p, p), set()).add(p)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_manhattan_distance_is_a_lower_bound_and_links_span():
    rng = np.random.default_rng(1)
    for width in (1, 4):
        a, b = (rng.integers(0, 2**64, (500, width), dtype=np.uint64) for _ in range(2))
        bound = np.abs(simhash.popcounts(a) - simhash.popcounts(b)).sum(axis=1)
        assert (bound <= simhash.differing(a, b)).all() and (bound > 0).any()
    chain = np.array([(1 << k) - 1 for k in range(40)], np.uint64).reshape(-1, 1)
    assert len(simhash.links_within(chain, 3)) == 39


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert simhash.link_near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "q r s t u v")]
    got = simhash.link_near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted(str(r.component_id) for r in got) == ["4", "4", "4", "None"]


@pytest.mark.parametrize("limit", [2048, 4])
def test_similar_texts_are_linked_and_others_are_not(spark, limit):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    rows, group = [], {}
    for g in range(30):
        base = fresh(rng.randint(150, 400))
        for _ in range(3):
            copy = list(base)
            for _ in range(max(1, len(copy) // 150)):  # a similarity of about 0.93
                copy[rng.randrange(len(copy))] = rng.choice(words)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    for _ in range(40):  # half of the text is shared: a similarity of about 0.33
        base = rng.choice(rows)[1].split()
        group[len(rows)] = -len(rows)
        rows.append((len(rows), " ".join(base[: len(base) // 2] + fresh(len(base) // 2))))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "one two")]
    got = {r.doc_id: r.component_id for r in simhash.link_similar(spark.createDataFrame(rows, "doc_id long, text string"), cell_limit=limit).collect()}
    first = {}
    for i, g in group.items():
        first.setdefault(g, i)
    wrong = [i for i, g in group.items() if got[i] != first[g]]
    assert len(wrong) <= 1
    assert got[len(rows) - 2] == len(rows) - 3 and got[len(rows) - 1] == len(rows) - 1


def test_crowded_cells_lose_no_similar_pair(spark):
    """Pairs at about 0.9 whose cells all count as crowded are found like any other."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(300)]
        copy = list(base)
        for at in rng.sample(range(300), 3):
            copy[at] = "changed"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    got = simhash.link_similar(spark.createDataFrame(rows, "doc_id long, text string"), cell_limit=1).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got)


@pytest.mark.parametrize("limit", [2048, 3])
def test_similar_texts_around_the_threshold_equal_brute_force(spark, limit):
    rng = random.Random(limit)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    texts = []
    for g in range(80):
        base = [rng.choice(words) for _ in range(rng.choice([8, 13, 40, 150, 400]) if g else 150)]
        for _ in range(2 if g else 40):
            copy = list(base)
            for at in rng.sample(range(len(copy)), round(len(copy) * rng.uniform(0.002, 0.016))):
                copy[at] = rng.choice(words)
            texts.append(" ".join([*copy, *(rng.choice(words) for _ in range(rng.choice([0, 1, len(copy) // 12])))]))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.link_similar(rows, cell_limit=limit).collect()}
    assert [got[i] for i in range(len(texts))] == label
    assert 20 < len(set(label)) < len(texts) - 40


def test_blocks_of_a_group_are_all_compared(spark):
    """Ten pairs in one group: the middle links to one text, the others are found block by block."""
    words = [" ".join(f"w{i // 2}x{k}" for k in range(30)) + f" {i}" for i in range(20)]
    df = spark.createDataFrame([(w,) for w in words], "_text string")
    numbers = [r.number for r in df.mapInArrow(simhash._sets(5), "number long, node binary, set array<long>").collect()]
    groups = spark.createDataFrame([(n, min(numbers)) for n in numbers], "number long, root long")
    chain = spark.createDataFrame([(min(numbers), n) for n in numbers if n != min(numbers)], "a long, b long")
    assert simhash.similar_links(groups, chain, df, 5, 0.8, most=3).count() == 10


def test_shingles_of_texts_of_all_lengths_are_told_apart():
    column = pa.array(["a b c d e f", "b c d e f", "a b c", "A  B\tc", "", None, "a b c d e"])
    sets = [set(x.tolist()) for x in simhash.shingle_sets(column, 5)]
    assert [len(x) for x in sets] == [2, 1, 1, 1, 0, 0, 1]
    assert sets[1] < sets[0] and sets[6] < sets[0] and sets[2] == sets[3] and not sets[2] & sets[0]


@pytest.mark.parametrize("similarity", [0.8, 0.82, 0.85])
def test_every_pair_at_the_threshold_is_found(spark, similarity):
    """Pairs whose sets have just this similarity, with crowded cells forced: recall is one."""
    rng = random.Random(round(100 * similarity))
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    rows = []
    for i in range(60):
        n = rng.choice([60, 300, 900])
        base = [rng.choice(words) for _ in range(n)]
        more = int((n - 4) / similarity) - (n - 4)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + [rng.choice(words) for _ in range(more)]))]
    got = simhash.link_similar(spark.createDataFrame(rows, "doc_id long, text string"), cell_limit=1).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got)
