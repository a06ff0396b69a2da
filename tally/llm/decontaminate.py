"""Benchmark decontamination by latent semantic retrieval.

1. Passages of ``PASSAGE`` words are TF-IDF vectors over hashed words; the
   document frequencies come from all passages of the corpus.
2. A randomised SVD of the passage matrix X: every task adds ``X'(X W)`` of its
   passages for one random matrix W, the sums (``features`` x ``rank``, whatever
   the corpus) give the leading right singular vectors by the Nyström formula.
3. Every document is a run of blocks of ``BLOCK`` words in the latent space
   (scaled by the singular values); windows of blocks, as long as an item and
   one block more, are compared with the items by cosine.
4. Beside the cosine, whatever it is, a stretch of text as long as an item is a
   candidate where it shares ``shared`` runs of ``GRAM`` words with the item,
   or as few as a verbatim copy of the item may (every lost or replaced word
   breaks ``GRAM`` runs at most), so no verbatim passage depends on the latent
   space.
5. Candidates are checked on the words themselves: the longest common
   subsequence of the item and the window with a margin, and whether the
   item's answer (its ``answer`` column, else its last sentence) stands there.
   A document holds an item when ``verbatim`` of the item's words are common,
   or ``paraphrase`` of them and the answer is found.

Scale: three scans of the texts and no shuffle of them; what is summed has a
fixed size. Items are a stated query set and go to the tasks in blocks of
``items_per_scan``; every block is compared with all rows.

Defined cases: null and empty texts hold nothing; very long texts are searched
whole; an item under ``min_words`` words is held where all its words stand side
by side; null and empty item texts are not searched; of windows of equal score
the first is reported; repeated rows give a row each; an empty corpus or
benchmark gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tally.llm.chunk_dedup import number_parts
from tally.llm.common import pack, ship, unpack
from tally.llm.textkernel import mix64, sequence_hashes, slices, span_hashes, words

BLOCK = 16
PASSAGE = 64
GRAM = 3
BUCKETS = 1 << 16
_RESULT = ("doc_id long, part int, item_id long, lcs int, item_words int, first_word long, answer_found boolean, "
           "verbatim boolean")
_SENTENCE = re.compile(r"[.!?…]\s+|\n+")
_FIXED = float(1 << 16)


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a slice and every row's first word."""
    starts, ends, first = words(data, offsets)
    return span_hashes(data, starts, ends), first


def grid(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows cut into runs of ``size`` words: word indices (runs x size), which
    of them are real, and every row's first run."""
    runs = -(-np.diff(first) // size)
    run_first = np.concatenate([[0], np.cumsum(runs)])
    begin = (np.arange(run_first[-1]) - np.repeat(run_first[:-1], runs)) * size + np.repeat(first[:-1], runs)
    at = begin[:, None] + np.arange(size)
    real = at < np.repeat(first[1:], runs)[:, None]
    return np.where(real, at, 0), real, run_first


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def _feature(h: np.ndarray, n: int) -> np.ndarray:
    return (h % np.uint64(n)).astype(np.int64)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """For every word bucket the passages that hold it, and their number last."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                h, first = text_words(data, offsets)
                if not len(h):
                    continue
                at, real, _ = grid(first, PASSAGE)
                total[BUCKETS] += len(at)
                key = np.sort(np.where(real, _bucket(h)[at], BUCKETS), axis=1)
                new = np.ones_like(real)
                new[:, 1:] = key[:, 1:] != key[:, :-1]
                total[:BUCKETS] += np.bincount(key[new & (key < BUCKETS)], minlength=BUCKETS)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

    rows = (texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
            .toPandas())
    total = np.zeros(BUCKETS + 1, np.int64)
    total[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return total


def _dense(h: np.ndarray, at: np.ndarray, real: np.ndarray, idf: np.ndarray, features: int) -> np.ndarray:
    """Normalised TF-IDF rows of passages over the hashed features."""
    weight = np.where(real, idf[_bucket(h)][at], 0)
    sign = np.where(h >> np.uint64(20) & np.uint64(1), 1.0, -1.0)[at]
    slot = _feature(h, features)[at] + (np.arange(len(at)) * features)[:, None]
    x = np.bincount(slot.ravel(), (weight * sign).ravel(), len(at) * features).reshape(len(at), features)
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    return x.astype(np.float32)


def latent_basis(texts: DataFrame, idf: np.ndarray, *, features: int, rank: int, seed: int,
                 extra: int = 16) -> np.ndarray:
    """Right singular vectors over singular values (features x rank) of all
    passages, by one distributed pass."""
    width = rank + extra
    probe = np.random.default_rng(seed).standard_normal((features, width)).astype(np.float32)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features, width))
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                h, first = text_words(data, offsets)
                if not len(h):
                    continue
                at, real, _ = grid(first, PASSAGE)
                for i in range(0, len(at), 1024):
                    x = _dense(h, at[i:i + 1024], real[i:i + 1024], idf, features)
                    total += x.T @ (x @ probe)
        # Fixed point: sums do not depend on the order of the tasks.
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(features * width)), pa.array(np.rint(total * _FIXED).ravel().astype(np.int64))],
            ["cell", "v"])

    rows = texts.mapInArrow(multiply, "cell long, v long").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    z = np.zeros(features * width)
    z[rows["cell"].to_numpy()] = rows["v"].to_numpy() / _FIXED
    z = z.reshape(features, width)
    core = probe.T.astype(np.float64) @ z
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > max(value.max(), 0) * 1e-9
    if not good.any():
        return np.zeros((features, rank), np.float32)
    half = z @ (vector[:, good] / np.sqrt(value[good]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)  # the passages' Gram matrix is about u s² u'
    keep = s[:rank] > s[0] * 1e-6
    basis = np.zeros((features, rank), np.float32)
    basis[:, :keep.sum()] = u[:, :rank][:, keep] / s[:rank][keep]
    return basis


def latent_blocks(h: np.ndarray, at: np.ndarray, real: np.ndarray, idf: np.ndarray,
                  basis: np.ndarray) -> np.ndarray:
    """Latent vectors of runs of words (not normalised)."""
    out = np.empty((len(at), basis.shape[1]), np.float32)
    sign = np.where(h >> np.uint64(20) & np.uint64(1), 1.0, -1.0)
    weight = (idf[_bucket(h)] * sign).astype(np.float32)
    slot = _feature(h, len(basis))
    for i in range(0, len(at), 512):
        a = at[i:i + 512]
        w = np.where(real[i:i + 512], weight[a], np.float32(0))
        out[i:i + 512] = np.matmul(w[:, None, :], basis[slot[a]])[:, 0, :]
    return out


class Item:
    """A benchmark item ready for the checks."""

    def __init__(self, item_id: int, text: str, answer: str | None, basis: np.ndarray, idf: np.ndarray) -> None:
        self.item_id = item_id
        raw = np.frombuffer(text.encode(), np.uint8)
        h, first = text_words(raw, np.array([0, len(raw)]))
        self.words = h.tolist()
        at, real, _ = grid(first, max(1, len(h)))
        self.vector = latent_blocks(h, at, real, idf, basis)[0] if len(h) else np.zeros(basis.shape[1], np.float32)
        self.vector = self.vector / max(float(np.linalg.norm(self.vector)), 1e-12)
        self.blocks = -(-(len(h) + BLOCK - 1) // BLOCK)
        if answer is None:
            sentences = [s for s in _SENTENCE.split(text.strip()) if s.strip()]
            answer = sentences[-1] if sentences else ""
        raw = np.frombuffer(answer.encode(), np.uint8)
        self.answer = text_words(raw, np.array([0, len(raw)]))[0].tolist()
        self.masks = lcs_masks(self.words)
        self.answer_masks = lcs_masks(self.answer)


class ItemGrams:
    """Runs of ``q`` words of a block of items: sorted hashes, and for each the
    items and places that have it."""

    def __init__(self, q: int, members: list[tuple[int, Item]], need: list[int]) -> None:
        self.q = q
        sizes = [len(x.words) for _, x in members]
        item = np.repeat([k for k, _ in members], [n - q + 1 for n in sizes])
        place = np.concatenate([np.arange(n - q + 1) for n in sizes])
        grams = []
        for _, x in members:
            at = np.arange(len(x.words) - q + 1)
            grams.append(sequence_hashes(np.array(x.words, np.uint64), at, at + q))
        order = np.argsort(np.concatenate(grams), kind="stable")
        self.item, self.place = item[order], place[order]
        self.hash, begin = np.unique(np.concatenate(grams)[order], return_index=True)
        self.first = np.append(begin, len(order))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hash >> np.uint64(44)).astype(np.int64)] = True
        last = max(k for k, _ in members) + 1
        self.length, self.need = np.zeros(last, np.int64), np.zeros(last, np.int64)
        for (k, x), n in zip(members, need):
            self.length[k], self.need[k] = len(x.words), n

    def candidates(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, items, first words) of the stretches that share enough runs;
        the first word is where the item would begin, perhaps before its row."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        at = np.flatnonzero(np.arange(len(h)) + self.q <= first[1:][row])
        gram = sequence_hashes(h, at, at + self.q)
        maybe = self.seen[(gram >> np.uint64(44)).astype(np.int64)]
        at, gram = at[maybe], gram[maybe]
        slot = np.minimum(np.searchsorted(self.hash, gram), len(self.hash) - 1)
        hit = self.hash[slot] == gram
        at, slot = at[hit], slot[hit]
        many = self.first[slot + 1] - self.first[slot]
        entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[slot], many)
        at, item = np.repeat(at, many), self.item[entry]
        start, row = at - self.place[entry], row[at]
        width = len(h) + int(self.length.max()) + 1
        key = (row * len(self.length) + item) * width + at
        order = np.argsort(key, kind="stable")
        key, row, item, start = key[order], row[order], item[order], start[order]
        enough = np.searchsorted(key, key + self.length[item]) - np.arange(len(key)) >= self.need[item]
        found = np.unique(np.stack([row[enough], item[enough], start[enough]]), axis=1)
        return found[0], found[1], found[2]


def item_grams(items: list[Item], *, verbatim: float, shared: int, min_words: int) -> list[ItemGrams]:
    """The look-ups of a block: items of ``min_words`` words and more by at most
    ``GRAM`` words, so few that a verbatim copy must hold one such run; shorter
    items by all their words."""
    families: dict[int, list[tuple[int, Item, int]]] = {}
    for k, x in enumerate(items):
        n = len(x.words)
        q, need = n, 1
        if n >= min_words:
            lost = n - math.ceil(verbatim * n - 1e-9)
            q = max(1, min(GRAM, n // (lost + 1)))
            need = max(1, min(shared, n - q + 1 - q * lost))
        families.setdefault(q, []).append((k, x, need))
    return [ItemGrams(q, [m[:2] for m in members], [m[2] for m in members]) for q, members in families.items()]


def lcs_masks(pattern: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def lcs_length(masks: dict[int, int], n: int, text: list[int]) -> int:
    """Longest common subsequence with the pattern of ``masks`` (``n`` words),
    a row of the table at a time as one integer."""
    full = (1 << n) - 1
    row = full
    for w in text:
        m = masks.get(w)
        if m:
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def search(texts: DataFrame, items: list[Item], idf: np.ndarray, basis: np.ndarray, *, cosine: float,
           verbatim: float, paraphrase: float, answer_share: float, margin: int, shared: int,
           min_words: int) -> DataFrame:
    """Rows of ``_RESULT`` for one block of items against all texts."""
    long_items = [x for x in items if len(x.words) >= min_words]
    sizes = sorted({x.blocks for x in long_items})
    groups = [(s, [x for x in long_items if x.blocks == s]) for s in sizes]
    vectors = [np.stack([x.vector for x in g]).T.astype(np.float32) for _, g in groups]
    grams = item_grams(items, verbatim=verbatim, shared=shared, min_words=min_words)

    def near(h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, Item, int, int]]:
        """(row, item, first word, end) of the windows above the cosine."""
        at, real, run_first = grid(first, BLOCK)
        latent = latent_blocks(h, at, real, idf, basis)
        total = np.concatenate([np.zeros((1, latent.shape[1])), np.cumsum(latent, axis=0, dtype=np.float64)])
        run_end = np.repeat(run_first[1:], np.diff(run_first))
        at = np.arange(len(latent))
        for (size, members), vector in zip(groups, vectors):
            window = (total[np.minimum(at + size, run_end)] - total[at]).astype(np.float32)
            window /= np.maximum(np.sqrt((window * window).sum(axis=1, keepdims=True)), 1e-12)
            runs, hits = np.nonzero(window @ vector >= cosine)
            rows = np.searchsorted(run_first, runs, "right") - 1
            begin = first[rows] + (runs - run_first[rows]) * BLOCK
            low = np.maximum(begin - margin, first[rows])
            high = np.minimum(begin + size * BLOCK + margin, first[rows + 1])
            for r, k, a, b in zip(rows.tolist(), hits.tolist(), low.tolist(), high.tolist()):
                yield r, members[k], a, b

    def alike(h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, Item, int, int]]:
        """The same of the stretches that share runs of words with an item."""
        for family in grams:
            rows, hits, start = family.candidates(h, first)
            spare = np.where(family.length[hits] < min_words, 0, margin)
            low = np.maximum(start - spare, first[rows])
            high = np.minimum(start + family.length[hits] + spare, first[rows + 1])
            for r, k, a, b in zip(rows.tolist(), hits.tolist(), low.tolist(), high.tolist()):
                yield r, items[k], a, b

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0), batch.column(1)
            found: list[dict] = []
            for row, data, offsets in slices(batch.column(2)):
                h, first = text_words(data, offsets)
                if not len(h):
                    continue
                best: dict[tuple[int, int], tuple] = {}
                for r, x, a, b in itertools.chain(near(h, first), alike(h, first)):
                    text, n = h[a:b].tolist(), len(x.words)
                    common = lcs_length(x.masks, n, text)
                    if common < (paraphrase * n if n >= min_words else n):
                        continue
                    told = bool(x.answer) and lcs_length(x.answer_masks, len(x.answer), text) >= answer_share * len(x.answer)
                    exact = common >= verbatim * n
                    if exact or told:
                        score = (common, told, -a)
                        if score > best.get((r, x.item_id), ((-1,),))[0]:
                            best[r, x.item_id] = (score, n, exact)
                found += [{"doc_id": ids[row + r].as_py(), "part": parts[row + r].as_py(), "item_id": item, "lcs": score[0], "item_words": n,
                           "first_word": int(-score[2] - first[r]), "answer_found": score[1], "verbatim": exact}
                          for (r, item), (score, n, exact) in best.items()]
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema(
                [("doc_id", pa.int64()), ("part", pa.int32()), ("item_id", pa.int64()), ("lcs", pa.int32()), ("item_words", pa.int32()),
                 ("first_word", pa.int64()), ("answer_found", pa.bool_()), ("verbatim", pa.bool_())]))

    return texts.mapInArrow(scan, _RESULT)


def find_leaks(docs: DataFrame, benchmark: DataFrame, **rules) -> DataFrame:
    """Documents (``doc_id``, ``text``) that hold benchmark items (``item_id``,
    ``text``, perhaps ``answer``): ``doc_id, item_id, lcs, item_words,
    first_word`` (of the best window), ``answer_found, verbatim``; a row of its
    own for each of several rows that share a ``doc_id``."""
    return leaks(docs.select("doc_id", F.lit(0).alias("part"), "text"), benchmark, **rules).drop("part")


def leaks(parts: DataFrame, benchmark: DataFrame, *, features: int = 1024, rank: int = 128, seed: int = 5,
               cosine: float = 0.35, verbatim: float = 0.8, paraphrase: float = 0.6, answer_share: float = 0.8,
               margin: int = 8, min_words: int = 5, shared: int = 2, items_per_scan: int = 4096) -> DataFrame:
    """``find_leaks`` for rows told apart by ``doc_id`` and ``part``; the result
    has both."""
    ship("tally.llm.textkernel", __name__)
    spark: SparkSession = parts.sparkSession
    texts = parts.select("text")
    total = document_frequencies(texts)
    passages = max(1, int(total[BUCKETS]))
    # Smoothed, and zero for a word in every passage.
    idf = np.log((1.0 + passages) / (1.0 + total[:BUCKETS]))
    basis = latent_basis(texts, idf, features=features, rank=rank, seed=seed)
    out = spark.createDataFrame([], _RESULT)
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    block: list[Item] = []
    both = parts.select(F.col("doc_id").cast("long").alias("doc_id"), "part", "text")
    rules = {"cosine": cosine, "verbatim": verbatim, "paraphrase": paraphrase, "answer_share": answer_share,
             "margin": margin, "shared": shared, "min_words": min_words}
    stated = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer"))
    for r in stated.filter(F.col("text").isNotNull()).toLocalIterator():
        item = Item(r.item_id, r.text, r.answer, basis, idf)
        if item.words:
            block.append(item)
        if len(block) == items_per_scan:
            out = out.unionByName(search(both, block, idf, basis, **rules))
            block = []
    if block:
        out = out.unionByName(search(both, block, idf, basis, **rules))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **rules) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item. Rows that share a
    ``doc_id`` (or have none) are told apart by ``part``, so the clean ones stay."""
    rows = number_parts(pack(docs), "rest")
    bad = leaks(rows, benchmark, **rules).select(F.col("doc_id").alias("_id"), F.col("part").alias("_p")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_p"))
    return unpack(rows.join(bad, same, "left_anti"), docs.columns)
