"""Benchmark decontamination with a stored positional inverted index.

The index is a table of segments, each the postings of the tokens of a few megabytes of whole documents:
every term (its 64-bit hash) with the sorted positions of its tokens.  It is partitioned by documents, so
a frequent term is split over all segments and building it needs no shuffle.  It is written to the shared
folder once and can be asked again and again.  A phrase is answered from the postings alone: its terms are
taken from the rarest on, their lists are shifted by the term's place in the phrase and intersected; what
is left are the starts of exact matches.  Proximity queries intersect the same lists with a tolerance.
The benchmark travels to the tasks as one broadcast value if it is at most ``broadcast_bytes`` long; a
longer one is asked in blocks of items of that size, one after the other, and the hits are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, PrefixHash, arrow_bytes, bound_batches, carried_name, lowered, materialize, mix, portions, tidy, word_spans

SEED_TERM = 21
PORTION = 1 << 22


def words_of(text: str | None) -> list[bytes]:
    body, offsets = arrow_bytes(pa.array([text], pa.string()))
    body = lowered(body)
    start, end, _ = word_spans(body, offsets, ALNUM_WORD)
    data = body.tobytes()
    return [data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def term_hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words; their lengths are part of them."""
    return mix(PrefixHash(body, SEED_TERM).of(start, end) + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Phrases:
    """The test side: distinct windows of term numbers and the items that have them."""

    def __init__(self, items: list[tuple[str, str | None]], width: int) -> None:
        terms: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[int]] = {}
        self.items = [("" if name is None else str(name)) for name, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [terms.setdefault(w, len(terms)) for w in words_of(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                windows.setdefault(tuple(ids[i : i + width]), set()).add(k)
        self.windows = list(windows)
        self.owners = [sorted(x) for x in windows.values()]
        at = np.concatenate(([0], np.cumsum([len(t) for t in terms]))).astype(np.int64)
        body = np.frombuffer(b"".join(terms), np.uint8)
        self.hashes = term_hashes(body, at[:-1], at[1:]) if terms else np.zeros(0, np.uint64)
        #: Term numbers of each window, shorter ones filled up with their first term.
        self.table = np.array([w + w[:1] * (width - len(w)) for w in self.windows], np.int64).reshape(len(windows), width)

    def present(self, index: PositionalIndex) -> list[int]:
        """Windows all of whose terms occur in the index."""
        return np.flatnonzero((index.sizes[self.table] > 0).all(axis=1)).tolist() if len(self.windows) else []


class PositionalIndex:
    """Postings of one segment: for each of the asked terms the sorted positions of its tokens.

    Positions run on through the segment; ``bounds`` are the first positions of the documents.
    """

    def __init__(self, terms: np.ndarray, counts: np.ndarray, places: np.ndarray, bounds: np.ndarray, asked: np.ndarray) -> None:
        at = np.minimum(np.searchsorted(terms, asked), max(0, len(terms) - 1))
        found = terms[at] == asked if len(terms) else np.zeros(len(asked), bool)
        cuts = np.concatenate(([0], np.cumsum(counts)))
        self.first = cuts[at] if len(terms) else np.zeros(len(asked), np.int64)
        self.sizes = np.where(found, counts[at], 0) if len(terms) else np.zeros(len(asked), np.int64)
        self.places, self.bounds = places, bounds

    def postings(self, term: int) -> np.ndarray:
        return self.places[self.first[term] : self.first[term] + self.sizes[term]]

    def _within(self, starts: np.ndarray, length: int) -> np.ndarray:
        starts = starts[starts >= 0]
        limit = self.bounds[np.searchsorted(self.bounds, starts, "right")]
        return starts[starts + length <= limit]

    def phrase(self, terms: tuple[int, ...]) -> np.ndarray:
        """Positions at which the terms stand one after the other in one document."""
        sizes = [int(self.sizes[t]) for t in terms]
        if not min(sizes):
            return np.zeros(0, np.int64)
        order = sorted(range(len(terms)), key=sizes.__getitem__)
        starts = self.postings(terms[order[0]]) - order[0]
        for place in order[1:]:
            listed = self.postings(terms[place]) - place
            at = np.searchsorted(listed, starts)
            at[at == len(listed)] = 0
            starts = starts[listed[at] == starts]
            if not len(starts):
                return starts
        return self._within(starts, len(terms))

    def proximity(self, terms: tuple[int, ...], span: int) -> np.ndarray:
        """Positions of the rarest term around which all terms stand within ``span`` tokens of one document.

        A match is a stretch of ``span`` tokens that holds every term at least once.
        """
        distinct = sorted(set(terms), key=lambda t: int(self.sizes[t]))
        rarest = self.postings(distinct[0])
        found = np.zeros(len(rarest), bool)
        doc = np.searchsorted(self.bounds, rarest, "right")
        lo_doc, hi_doc = self.bounds[doc - 1], self.bounds[doc]
        for shift in range(span):
            lo = np.maximum(rarest - shift, lo_doc)
            hi = np.minimum(rarest - shift + span, hi_doc)
            ok = np.ones(len(rarest), bool)
            for t in distinct[1:]:
                listed = self.postings(t)
                ok &= np.searchsorted(listed, lo) < np.searchsorted(listed, hi)
            found |= ok
        return rarest[found]


def postings_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct terms, how often each occurs, and the positions term by term."""
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    # sorted by the hash's first bits and the position; runs of one hash are the terms
    places = (np.sort(hashes >> bits << bits | np.arange(len(hashes), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    terms = hashes[places]
    if (terms[1:] < terms[:-1]).any():  # two terms agree in those bits
        places = np.argsort(hashes, kind="stable")
        terms = hashes[places]
    cut = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, np.int64)
    return terms[cut], np.diff(np.append(cut, len(terms))), places


def _indexed(columns: list[str]):
    """Segments: the rows' ``columns`` as lists, words by document, and the postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            body, offsets = arrow_bytes(batch.column("_text"))
            body = lowered(body)
            for lo, hi in portions(offsets, PORTION):
                at = offsets[lo : hi + 1]
                start, end, row = word_spans(body[at[0] : at[-1]], at - at[0], ALNUM_WORD)
                counts = np.bincount(row, minlength=hi - lo)
                terms, often, places = postings_of(term_hashes(body[at[0] : at[-1]], start, end))
                # positions as distances within a term
                gaps = np.diff(places, prepend=0)
                first = np.cumsum(often) - often
                gaps[first] = places[first]
                whole = lambda c, lo=lo, n=hi - lo: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c.slice(lo, n))
                values = [counts.astype("<i4").tobytes(), terms.tobytes(), packed(often), packed(gaps)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task << 32 | number], pa.int64()), *(whole(batch.column(c)) for c in columns), *(pa.array([v], pa.binary()) for v in values)],
                    names=["segment", *columns, "words", "terms", "counts", "gaps"],
                )
                number += 1

    return run


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 to 2**31, compressed, all low bytes first, then the higher ones."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel().astype(np.int64)


def read_segment(row: dict, asked: np.ndarray) -> PositionalIndex:
    often = unpacked(row["counts"])
    gaps = unpacked(row["gaps"])
    total, first = np.cumsum(gaps), np.cumsum(often) - often
    places = total - np.repeat(total[first] - gaps[first], often) if len(gaps) else gaps
    bounds = np.concatenate(([0], np.cumsum(np.frombuffer(row["words"], "<i4"), dtype=np.int64)))
    return PositionalIndex(np.frombuffer(row["terms"], np.uint64), often, places, bounds, asked)


def _matched(phrases_of, near: int | None, kept: list[str]):
    """One row per document of each segment: its place there, ``kept`` columns, and what was found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = phrases_of()
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("segment", "words", "terms", "counts", "gaps")}
                index = read_segment(row, phrases.hashes)
                n = len(index.bounds) - 1
                items: list[set[int]] = [set() for _ in range(n)]
                close: list[set[int]] = [set() for _ in range(n)]
                edge = np.zeros(int(index.bounds[-1]) + 1, np.int64)
                for w in phrases.present(index):
                    terms, owners = phrases.windows[w], phrases.owners[w]
                    starts = index.phrase(terms)
                    if len(starts):
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + len(terms), -1)
                        for d in np.unique(np.searchsorted(index.bounds, starts, "right") - 1):
                            items[d].update(owners)
                    if near is not None:
                        for d in np.unique(np.searchsorted(index.bounds, index.proximity(terms, near), "right") - 1):
                            close[d].update(owners)
                hit = np.cumsum(edge[:-1]) > 0
                step = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
                spans: list[list[dict]] = [[] for _ in range(n)]
                for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
                    d = int(np.searchsorted(index.bounds, a, "right")) - 1
                    while a < b:  # a run of hits may go on in the next document
                        upto = min(b, int(index.bounds[d + 1]))
                        if a < upto:
                            spans[d].append({"lo": a - int(index.bounds[d]), "hi": upto - int(index.bounds[d])})
                        a, d = upto, d + 1
                names = lambda found: pa.array([sorted({phrases.items[i] for i in x}) for x in found], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["segment"]] * n, pa.int64()), pa.array(range(n), pa.int32()), *(batch.column(c)[k].values for c in kept)]
                    + [pa.array(np.diff(index.bounds)), pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))]
                    + [names(items), names(close)],
                    names=["segment", "doc", *kept, "n_words", "spans", "items", "near_items"],
                )

    return run


def build_index(docs: DataFrame, text_col: str, stored: dict[str, str]) -> DataFrame:
    """Writes and returns the segments of an index over ``text_col``.

    ``stored`` names the columns that a segment carries for its documents (new name: column); a null text has no words.
    """
    bound_batches(docs.sparkSession)
    names = list(stored)
    extra = [] if "_text" in names else [F.col(text_col).cast("string").alias("_text")]
    base = docs.select(*(F.col(c).alias(n) for n, c in stored.items()), *extra)
    types = dict(base.dtypes)
    schema = "segment long, " + "".join(f"`{c}` array<{types[c]}>, " for c in names) + "words binary, terms binary, counts binary, gaps binary"
    return materialize(base.mapInArrow(tidy(_indexed(names)), schema), "postings")


def search_index(index: DataFrame, block: list[tuple[str, str]], kept: list[str], width: int, near: int | None = None) -> DataFrame:
    """One row per indexed document: segment, doc (its place there), ``kept`` columns, n_words, spans, items and near_items."""
    shared = index.sparkSession.sparkContext.broadcast(block)
    cached: list[Phrases] = []

    def phrases_of() -> Phrases:
        if not cached:
            cached.append(Phrases(shared.value, width))
        return cached[0]

    types = {f.name: f.dataType.elementType.simpleString() for f in index.schema if f.name in kept}
    schema = "segment long, doc int, " + "".join(f"`{c}` {types[c]}, " for c in kept) + HIT_SCHEMA
    return index.mapInArrow(tidy(_matched(phrases_of, near, kept)), schema)


HIT_SCHEMA = "n_words long, spans array<struct<lo:int,hi:int>>, items array<string>, near_items array<string>"


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    near: int | None = None,
    broadcast_bytes: int = 32 << 20,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Which words of each document lie in a window of ``width`` words of a benchmark item.

    One row per document: the id, ``keep`` columns, n_words, spans (ranges of hit word places),
    items (ids with an exact window, sorted), near_items (ids with all words of a window within
    ``near`` tokens, if asked for), n_hit, n_items, items_sha256 and contaminated.  An item of fewer
    words is one window; one without words has none.  Null texts have no words; null item ids count
    as the empty name; repeated rows are judged alike; an empty benchmark hits nothing.  A kept column
    that is named like one made here gets ``_in`` behind its name.
    """
    # a kept text is the one that is indexed
    named = {f"_c{i}": c for i, c in enumerate((id_col, *(c for c in keep if c != text_col)))}
    named |= {"_text": text_col} if text_col in keep else {}
    names = list(named)
    test = items.select(F.col(item_id_col).cast("string").alias("name"), F.col(item_text_col).cast("string").alias("text"))
    index = build_index(docs, text_col, named)
    merged = None
    for block, last in item_blocks(test, broadcast_bytes):
        if last and merged is None:
            merged = search_index(index, block, names, width, near)
            break
        found = search_index(index, block, [], width, near).where("size(items) > 0 or size(near_items) > 0")
        found = materialize(found, "hits")
        merged = found if merged is None else merged.unionByName(found)
        if last:
            merged = _merged_blocks(search_index(index, [], names, width).drop("spans", "items", "near_items"), merged)
    spans = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["hi"] - x["lo"])
    done = merged.select(
        *names, "n_words", "spans", "items", "near_items", spans.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
    )
    made = ("n_words", "spans", "items", "near_items", "n_hit", "n_items", "items_sha256", "contaminated")
    named = {n: c if n == "_c0" else carried_name(c, made) for n, c in named.items()}
    return done.withColumn("contaminated", F.col("n_hit") > 0).withColumnsRenamed(named)


def item_blocks(test: DataFrame, most: int) -> Iterator[tuple[list[tuple[str, str]], bool]]:
    """The items in blocks of about ``most`` bytes, and whether it is the last; one at a time is on the driver."""
    size = test.agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))), F.count("*")).first()
    n = max(1, -(-int(size[0] or 0) // most))
    number = F.pmod(F.xxhash64("name", "text"), F.lit(n))
    for k in range(n):
        yield [(r.name, r.text) for r in (test if n == 1 else test.where(number == k)).collect()], k == n - 1


def _merged_blocks(documents: DataFrame, hits: DataFrame) -> DataFrame:
    """The documents with what all blocks of items found in them."""
    together = hits.groupBy("segment", "doc").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("_all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
    )
    last = lambda acc: F.element_at(acc, -1)
    joined = F.aggregate(
        "_all",
        F.slice("_all", 1, 1),
        lambda acc, x: F.when(
            x["lo"] <= last(acc)["hi"],
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(last(acc)["lo"].alias("lo"), F.greatest(last(acc)["hi"], x["hi"]).alias("hi"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    found = together.select("segment", "doc", joined.alias("spans"), "items", "near_items")
    empty = {"spans": "array<struct<lo:int,hi:int>>", "items": "array<string>", "near_items": "array<string>"}
    done = documents.join(found, ["segment", "doc"], "left")
    return done.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in empty.items()})
