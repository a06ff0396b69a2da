"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF
shingles, banded, verified by weighted Jaccard similarity.

A document is its shingles of five words; a shingle weighs its count times its
inverse document frequency, ``ln(n / df) / ln(1 / share)`` (1 for a shingle in
``share`` of the documents; the scale changes no similarity). Document
frequencies are taken over distinct texts, so a family of equal texts does not
lower its own weights, and kept in a table of ``1 << DF_BITS`` hash buckets,
whatever the corpus, so that every task can hold it. Shingles of one bucket
share its count: a shingle's frequency is never taken too low, and too high by
as many documents as hold the others of its bucket.

Each of ``bands * rows`` samples draws one (shingle, level) pair such that two
documents agree with the probability of their weighted Jaccard similarity.
Documents that agree in all samples of a band are candidates; ``links`` pairs
them without all pairs and every pair is verified on the whole texts.

Scale: equal texts are one item (by digest), so a text copied a million times
is sampled but never compared; sketches are narrow; only texts of candidates
are compared. Bands and joins on them tolerate hot keys (partial aggregation,
joins that Spark may split).

Defined cases: null texts are empty; equal texts are one class, the empty text
included; a text of one to four words is one shingle; documents without words
are linked to nothing else; rows that share a ``doc_id`` are told apart by
``part``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tally.llm.chunk_dedup import number_parts
from tally.llm.common import pack, ship, stage, stage_as_is, unpack
from tally.llm.links import link_classes
from tally.llm.textkernel import mix64, shingles, slices, span_hashes, words

_SHINGLE_BITS = 44
#: Buckets of document frequencies, and those counted in one row.
DF_BITS = 21
_STRIPE_BITS = 12
_SLICE = 1 << 18
#: Buckets of a document's sign: the weights of its shingles by their last bits.
MASSES = 128


def weighted_rows(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (44 bits) of every row in order, their counts and
    every row's first one."""
    starts, ends, first = words(data, offsets)
    h, first = shingles(span_hashes(data, starts, ends), first, k)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(first))
    key = np.sort(row << np.uint64(_SHINGLE_BITS) | h >> np.uint64(64 - _SHINGLE_BITS))
    if not len(key):
        return key, key.astype(np.int64), np.zeros(len(offsets), np.int64)
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(head, len(key)))
    key = key[head]
    first = np.searchsorted(key >> np.uint64(_SHINGLE_BITS), np.arange(len(offsets), dtype=np.uint64))
    return key & np.uint64((1 << _SHINGLE_BITS) - 1), count, first


def _bucket(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(_SHINGLE_BITS - DF_BITS)).astype(np.int64)


def frequent_shingles(texts: DataFrame, n_docs: int, share: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of shingles (sorted) and in how many distinct texts they are:
    document frequencies of all shingles, frequent or not. ``n_docs`` and
    ``share`` only bear on the weights made of them."""
    stripe = 1 << _STRIPE_BITS

    def rows(stripes: list[int], counts: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(stripes, pa.int32()), pa.array(
            [c.astype(np.uint32).tobytes() for c in counts], pa.binary())], ["stripe", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << DF_BITS, np.uint32)
        for batch in batches:
            for _, data, offsets in slices(batch.column(0), _SLICE):
                shingle, _, first = weighted_rows(data, offsets, k)
                # Sorted by document and shingle, so the shingles of a bucket are neighbours.
                bucket = _bucket(shingle)
                new = np.ones(len(bucket), bool)
                new[1:] = bucket[1:] != bucket[:-1]
                new[first[:-1][np.diff(first) > 0]] = True
                np.add.at(total, bucket[new], np.uint32(1))
        total = total.reshape(-1, stripe)
        some = np.flatnonzero(total.any(axis=1)).tolist()
        yield from (rows(some[at:at + 256], total[some[at:at + 256]]) for at in range(0, len(some), 256))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                here = np.frombuffer(counts, np.uint32)
                total[at] = total[at] + here if at in total else here
        for at, here in total.items():
            yield rows([at], [here])

    # Copies are counted once.
    found = (texts.dropDuplicates().mapInArrow(count, "stripe int, counts binary").repartition("stripe")
             .mapInArrow(add, "stripe int, counts binary").toPandas())
    df = np.zeros(1 << DF_BITS, np.uint32)
    for at, counts in zip(found["stripe"], found["counts"]):
        df[at * stripe:(at + 1) * stripe] = np.frombuffer(counts, np.uint32)
    bucket = np.flatnonzero(df).astype(np.int32)
    return bucket, df[bucket]


class Weights:
    """TF-IDF weights from the document frequencies of the shingles' buckets."""

    def __init__(self, bucket: np.ndarray, df: np.ndarray, n_docs: int, share: float) -> None:
        self.idf = None
        if len(bucket):
            self.idf = np.ones(1 << DF_BITS, np.float32)
            self.idf[bucket] = np.maximum(np.log(n_docs / df) / np.log(1 / share), 1e-3)

    def __call__(self, shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
        weight = count.astype(np.float64)
        return weight if self.idf is None else weight * self.idf[_bucket(shingle)]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At 65,536 mid-points: quantiles of the Gamma(2, 1) distribution (by
    Newton steps on its distribution function 1 - (1 + x) exp(-x)), their
    logarithms, and the mid-points themselves."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.sqrt(2 * p) + p
    for _ in range(40):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-12), 1e-6)
    return x.astype(np.float32), np.log(x).astype(np.float32), p.astype(np.float32)


def sample(shingle: np.ndarray, weight: np.ndarray, first: np.ndarray, samples: int) -> np.ndarray:
    """Sample identities (rows x samples, 32 bits each) by improved consistent
    weighted sampling; rows must not be empty.

    Per shingle and sample r, c are Gamma(2, 1) and beta uniform, all from one
    hash; t = floor(ln w / r + beta), and the least ln c - r (t - beta + 1)
    wins. The winner is told by its shingle and t.
    """
    r_of, ln_c_of, beta_of = _tables()
    ln_w = np.log(weight).astype(np.float32)
    plain = not ln_w.any()
    out = np.empty((len(first) - 1, samples), np.uint32)
    for s in range(samples):
        x = (shingle + np.uint64(s * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        r = r_of[x & np.uint64(0xFFFF)]
        beta = beta_of[x >> np.uint64(16) & np.uint64(0xFFFF)]
        value = ln_c_of[x >> np.uint64(32) & np.uint64(0xFFFF)]
        identity = x ^ x >> np.uint64(29)
        if plain:
            value = value - r * (1 - beta)
        else:
            t = np.floor(ln_w / r + beta)
            value = value - r * (t - beta + 1)
            identity = identity + (t.astype(np.int64).view(np.uint64) * np.uint64(0xA0761D6478BD642F))
        # Sortable bits of the value above, the identity below.
        bits = value.view(np.int32)
        bits = np.where(bits < 0, ~bits, bits | np.int32(-(1 << 31))).view(np.uint32)
        packed = bits.astype(np.uint64) << np.uint64(32) | identity & np.uint64(0xFFFFFFFF)
        out[:, s] = np.minimum.reduceat(packed, first[:-1]) & np.uint64(0xFFFFFFFF)
    return out


def band_keys(identity: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band (rows x bands)."""
    rows, samples = identity.shape
    parts = identity.reshape(rows, bands, samples // bands).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15),
                          (rows, bands)).copy()
    for j in range(parts.shape[2]):
        key = mix64(key ^ parts[:, :, j] + np.uint64(j))
        key *= np.uint64(0xD6E8FEB86659FD93)
    return key.view(np.int64)


def sketches(parts: DataFrame, weights: Weights, *, k: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, part, digest, keys, sign`` of ``parts`` (``doc_id, part,
    text``); ``sign`` is the weight of the shingles in each of ``MASSES`` buckets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(batch.column(2), _SLICE):
                n = len(offsets) - 1
                shingle, count, first = weighted_rows(data, offsets, k)
                full = np.flatnonzero(np.diff(first) > 0)
                mass = np.zeros(n * MASSES, np.float32)
                if len(full):
                    weight = weights(shingle, count)
                    place = np.repeat(np.arange(n), np.diff(first)) * MASSES + (shingle % np.uint64(MASSES)).astype(np.int64)
                    mass = np.bincount(place, weight, n * MASSES).astype(np.float32)
                    found = sample(shingle, weight, np.append(first[full], first[-1]), bands * rows)
                    keys = band_keys(found, bands)
                else:
                    keys = np.zeros((0, bands), np.int64)
                ends = np.zeros(n + 1, np.int32)
                ends[full + 1] = bands
                raw = data.tobytes()
                digests = [hashlib.blake2b(raw[offsets[i]:offsets[i + 1]], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(digests, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys.ravel())),
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * MASSES), pa.array(mass))],
                    ["doc_id", "part", "digest", "keys", "sign"])

    return parts.select("doc_id", "part", "text").mapInArrow(
        scan, "doc_id long, part int, digest binary, keys array<long>, sign array<float>")


def possible_similarity(similarity: float):
    """Which documents of two blocks of signs may be so similar: what they share
    is at most the sum of the least weights of every bucket."""

    def possible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty((len(a), len(b)), bool)
        total = b.sum(axis=1)
        for i in range(len(a)):
            low = np.minimum(a[i], b).sum(axis=1)
            out[i] = low >= (similarity - 1e-4) * (a[i].sum() + total - low)
        return out

    return possible


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least weights over sum of greatest, of sorted distinct shingles."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    top = a[1].sum() + b[1].sum() - low
    return float(low / top) if top > 0 else 0.0


def near_classes(parts: DataFrame, *, k: int = 5, similarity: float = 0.8, share: float = 0.1, bands: int = 10,
                 rows: int = 3) -> DataFrame:
    """``doc_id, part, class_id, class_part, class_size`` of every row of
    ``parts``: the class is told by its smallest (``doc_id``, ``part``)."""
    ship("tally.llm.textkernel", __name__)
    texts = parts.select("text")
    n_docs = max(1, texts.count())
    weights = Weights(*frequent_shingles(texts, n_docs, share, k), n_docs, share)
    sketch = stage_as_is(sketches(parts, weights, k=k, bands=bands, rows=rows), "sketches")
    # One item per distinct text; its id is the smallest document's, or a hash where that is no number of its own.
    first = F.col("_first")
    own = first["doc_id"].isNotNull() & (first["part"] == 0)
    items = stage(sketch.groupBy("digest").agg(F.min(F.struct("doc_id", "part")).alias("_first"),
                                               F.any_value("keys").alias("keys"), F.any_value("sign").alias("sign"))
                  .select("digest", F.when(own, first["doc_id"]).otherwise(
                      F.xxhash64("digest", first["doc_id"])).alias("id"),
                          first["doc_id"].alias("doc_id"), first["part"].alias("part"), "keys", "sign"), "items")
    members = items.select("id", F.explode("keys").alias("key"))

    texts_of: list[DataFrame] = []  # of all items that met another, from the first call on

    def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        shingle, count, _ = weighted_rows(raw, np.array([0, len(raw)]), k)
        return shingle, weights(shingle, count)

    def linked(found: list[str]):
        of = lru_cache(maxsize=None)(lambda i: vector(found[i]))
        return lambda i, j: weighted_jaccard(of(i), of(j)) >= similarity - 1e-9

    def fetch(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        place = items.select("id", F.col("doc_id").alias("_d"), F.col("part").alias("_p")).join(wanted, "id")
        return stage(parts.select("doc_id", "part", "text").join(
            place, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("part") == F.col("_p")))
            .select("id", "text"), "candidate-texts")

    def measure(pairs: DataFrame) -> DataFrame:
        if not texts_of:
            texts_of.append(fetch(pairs))
        found = texts_of[0]
        both = (pairs.join(found.select(F.col("id").alias("b"), F.col("text").alias("_tb")), "b")
                .join(found.select(F.col("id").alias("a"), F.col("text").alias("_ta")), "a"))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last: tuple[str, tuple[np.ndarray, np.ndarray]] | None = None
            for batch in batches:
                away = []
                for i in range(batch.num_rows):
                    ta = batch.column(2)[i].as_py()
                    if last is None or last[0] != ta:
                        last = ta, vector(ta)
                    away.append(1 - weighted_jaccard(last[1], vector(batch.column(3)[i].as_py())))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(away, pa.float64())],
                                                 ["a", "b", "d"])

        return both.select("a", "b", "_ta", "_tb").mapInArrow(compare, "a long, b long, d double")

    # One minus the weighted Jaccard similarity is a metric.
    classes = link_classes(members, measure, 1 - similarity, possible=possible_similarity(similarity), linked=linked,
                           signs=lambda: items.select("id", "sign").join(
                               texts_of[0].select("id", F.coalesce("text", F.lit("")).alias("item")), "id"))
    rooted = (items.select("digest", "id").join(classes, "id", "left")
              .select("digest", F.coalesce("root", "id").alias("root")))
    placed = sketch.select("doc_id", "part", "digest").join(rooted, "digest")
    heads = placed.groupBy("root").agg(F.min(F.struct("doc_id", "part")).alias("_head"),
                                       F.count(F.lit(1)).alias("class_size"))
    # Written, so that the join shuffles both sides anew and may split a hot class.
    heads = stage(heads, "class-heads")
    return placed.join(heads, "root").select("doc_id", "part", F.col("_head.doc_id").alias("class_id"),
                                             F.col("_head.part").alias("class_part"), "class_size")


def find_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """``doc_id, class_id, class_size, kept`` of every row of ``docs``; one
    row of a class is kept, the smallest."""
    return near_classes(number_parts(docs), **parameters).select(
        "doc_id", "class_id", "class_size",
        (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("part") == F.col("class_part"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """One document of each class, with all columns."""
    parts = number_parts(pack(docs), "rest")
    extra = near_classes(parts.select("doc_id", "part", "text"), **parameters).filter(
        ~(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("part") == F.col("class_part")))).select(
        F.col("doc_id").alias("_id"), F.col("part").alias("_p"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_p"))
    return unpack(parts.join(extra, same, "left_anti"), docs.columns)
