"""URL rules in a sorted digest array: memory-mapped 64-bit keys, binary search, full strings to confirm.

A rule is a host and a path prefix; it fits the host, all its subdomains and all paths that begin
with the prefix.  A url's candidates are its host suffixes joined with its path cut to the lengths
that rule paths have; each candidate's xxhash64 is looked up in the sorted array by vectorised binary
search, and where the digest is there the stored string is compared.  The array travels as bytes in
one broadcast value if it has at most ``broadcast_bytes``; each worker maps it from a file of its own
that is unlinked at once.  A larger set of rules is joined by digest and string instead.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ASCII_LOWER, ASCII_UPPER, row_key


class DigestArray:
    """Rule strings by digest: keys, the strings' offsets, verdicts and the strings, in one file."""

    def __init__(self, data: bytes) -> None:
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            n, self.n_lengths = (int(x) for x in np.memmap(f, "<u8", "r", 0, (2,)))
            self.lengths = np.memmap(f, "<u8", "r", 16, (self.n_lengths,)).tolist() if self.n_lengths else []
            at = 16 + 8 * self.n_lengths
            self.keys = np.memmap(f, "<u8", "r", at, (n,)) if n else np.zeros(0, np.uint64)
            self.offsets = np.memmap(f, "<u8", "r", at + 8 * n, (n + 1,))
            self.blocked = np.memmap(f, "u1", "r", at + 16 * n + 8, (n,)) if n else np.zeros(0, np.uint8)
            tail = at + 17 * n + 8
            size = int(self.offsets[-1])
            self.strings = np.memmap(f, "u1", "r", tail, (size,)) if size else np.zeros(0, np.uint8)

    @staticmethod
    def build(rules: list[tuple[str, str, str]], digest=xxhash.xxh64_intdigest) -> bytes:
        """``rules``: (host, path, verdict); of repeated rules one stays, block before allow."""
        verdicts: dict[bytes, int] = {}
        for host, path, verdict in rules:
            text = (host + path).encode()
            verdicts[text] = max(verdicts.get(text, 0), int(verdict == "block"))
        rows = sorted((digest(text), text) for text in verdicts)
        lengths = sorted({len(path) for _, path, _ in rules})
        sizes = np.cumsum([0, *(len(t) for _, t in rows)])
        parts = [np.array([len(rows), len(lengths), *lengths], "<u8"), np.array([k for k, _ in rows], "<u8"), sizes.astype("<u8")]
        parts += [np.array([verdicts[t] for _, t in rows], "u1")]
        return b"".join([p.tobytes() for p in parts] + [t for _, t in rows])

    def find(self, texts: list[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """The place of each text in the array, or -1."""
        found = np.full(len(texts), -1, np.int64)
        if not len(self.keys) or not texts:
            return found
        probe = np.fromiter(map(digest, texts), np.uint64, len(texts))
        at = np.searchsorted(self.keys, probe)
        there = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == probe))
        for k in there.tolist():
            place = int(at[k])
            while place < len(self.keys) and self.keys[place] == probe[k]:  # strings that share a digest lie side by side
                if self.string(place) == texts[k]:
                    found[k] = place
                    break
                place += 1
        return found

    def string(self, place: int) -> bytes:
        return self.strings[int(self.offsets[place]) : int(self.offsets[place + 1])].tobytes()


def host_and_path(url_col: str) -> tuple:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    there = F.instr(url, "://") > 0
    rest = F.when(there, F.expr(f"substring(coalesce(cast(`{url_col}` as string), ''), instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, ASCII_UPPER, ASCII_LOWER), path


def candidates(host: str, path: str, lengths: list[int]) -> Iterator[str]:
    """Host suffixes at label bounds, each with the path cut to each length; the longest first."""
    if not host:
        return
    cuts = [path[:n] for n in sorted(lengths, reverse=True) if n <= len(path)]
    at = 0
    while True:
        for cut in cuts:
            yield host[at:] + cut
        at = host.find(".", at) + 1
        if not at:
            return


def _probed(load, url_names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array: DigestArray = load()
        for batch in batches:
            texts, owner = [], []
            hosts, paths = (batch.column(c).to_pylist() for c in url_names)
            for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                for text in candidates(host, path, array.lengths):
                    texts.append(text)
                    owner.append(k)
            found = array.find([t.encode() for t in texts])
            best = [(-1, -1)] * batch.num_rows  # length of the rule, place
            for k in np.flatnonzero(found >= 0).tolist():
                best[owner[k]] = max(best[owner[k]], (len(texts[k]), int(found[k])))
            rule = [array.string(p).decode() if p >= 0 else None for _, p in best]
            verdict = ["block" if p >= 0 and array.blocked[p] else "allow" if p >= 0 else None for _, p in best]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=[*batch.schema.names, "rule", "_verdict"],
            )

    return run


def judge_urls(
    df: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    otherwise: str = "allow",
    broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """One row per input row: id, url, host, path, rule (host and path, or null) and verdict.

    ``rules`` has the columns host, path and verdict (allow or block); of the rules that fit the one
    with the longest string wins, and urls without any get ``otherwise``: what no list holds is
    allowed.  Null urls, and those without ``://``, have an empty host and path and no rule; rules
    with a null are left out; repeated urls are judged each; an empty table stays empty.
    """
    host, path = host_and_path(url_col)
    urls = df.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), host.alias("host"), path.alias("path"))
    clean = rules.select("host", "path", "verdict").dropna()
    size = clean.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 17)).first()[0] or 0
    if size <= broadcast_bytes:
        data = DigestArray.build([tuple(r) for r in clean.collect()])
        shared = df.sparkSession.sparkContext.broadcast(data)
        kept: list[DigestArray] = []

        def load() -> DigestArray:
            if not kept:
                kept.append(DigestArray(shared.value))
            return kept[0]

        kind = dict(urls.dtypes)["_id"]
        schema = f"_id {kind}, _url string, host string, path string, rule string, _verdict string"
        judged = urls.mapInArrow(_probed(load, ("host", "path")), schema)
    else:
        judged = _joined(urls, clean)
    return judged.select(
        F.col("_id").alias(id_col), F.col("_url").alias(url_col), "host", "path", "rule", F.coalesce("_verdict", F.lit(otherwise)).alias("verdict")
    )


def _joined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by a join of candidates with rules on digest and string, for large sets of rules."""
    rules = rules.groupBy(F.concat("host", "path").alias("rule")).agg(
        F.max("verdict").alias("_verdict"), F.first(F.length("path")).alias("_n")
    )
    lengths = rules.select("_n").distinct().agg(F.collect_set("_n").alias("_lengths"))  # path lengths, not rules
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    cuts = F.filter("_lengths", lambda n: n <= F.length("path"))
    tried = F.flatten(F.transform(suffixes, lambda h: F.transform(cuts, lambda n: F.concat(h, F.substr("path", F.lit(1), n)))))
    keyed = urls.select(*row_key("_id", "_url"), "*")
    probes = (
        keyed.where("host <> ''").join(F.broadcast(lengths)).select("_k1", "_k2", F.explode(F.array_distinct(tried)).alias("rule"))
    )
    rules, probes = (x.withColumn("_digest", F.xxhash64("rule")) for x in (rules, probes.distinct()))
    hits = probes.join(rules, ["_digest", "rule"]).groupBy("_k1", "_k2")
    best = hits.agg(F.max(F.struct(F.length("rule").alias("_length"), "rule", "_verdict")).alias("_best"))
    done = keyed.join(best, ["_k1", "_k2"], "left")
    return done.select("_id", "_url", "host", "path", F.col("_best.rule").alias("rule"), F.col("_best._verdict").alias("_verdict"))
