"""Counting quotient filters against counters, exact dedup against brute force."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tally.llm.exact_dedup import drop_copies, find_copies
from tally.llm.quotient_filter import CountingQuotientFilter as Filter
from tests_llm import cases


def _filter(rng, bits, n):
    values = [rng.randrange(1 << bits) for _ in range(n)]
    values += rng.choices(values, k=n) if values else []
    return values, Filter.of(np.array(values, np.uint64), bits)


@pytest.mark.parametrize("seed", range(12))
def test_filter_counts_are_exact(seed):
    rng = random.Random(seed)
    bits = rng.choice([4, 6, 11, 40, 64])
    values, made = _filter(rng, bits, rng.choice([0, 1, 5, 40, 700]))
    back = Filter.from_bytes(made.to_bytes())
    for f in (made, back):
        assert dict(zip(*(x.tolist() for x in f.items()))) == Counter(values)
    for v in set(values) | {rng.randrange(1 << bits) for _ in range(50)}:
        assert back.count(v) == Counter(values)[v]


def test_filter_holds_large_counts_in_narrow_slots():
    values, counts = np.array([3, 4, 9, 15], np.uint64), np.array([1, 2, 1_000_000, 255], np.uint64)
    f = Filter.of(values, 4, counts)
    assert [x.tolist() for x in f.items()] == [values.tolist(), counts.tolist()]
    assert [f.count(v) for v in (3, 4, 9, 15, 0)] == [1, 2, 1_000_000, 255, 0]


@pytest.mark.parametrize("seed", range(6))
def test_filters_of_any_sizes_merge_without_loss(seed):
    rng = random.Random(seed)
    bits = rng.choice([5, 12, 60])
    parts = [_filter(rng, bits, rng.choice([0, 3, 50, 900])) for _ in range(5)]
    whole = Filter.merge([f for _, f in parts])
    assert dict(zip(*(x.tolist() for x in whole.items()))) == Counter(v for values, _ in parts for v in values)
    halves = Filter.merge([Filter.merge([f for _, f in parts[:2]]), Filter.merge([f for _, f in parts[2:]])])
    assert whole.to_bytes() == halves.to_bytes()


def _expected(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        text = text or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((-len(text), doc_id is None, doc_id or 0, doc_id, i))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:3])
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), k == 0, sha) for k, m in enumerate(members)]
    return Counter(out)


def _rows(seed=3):
    rng = random.Random(seed)
    texts = [cases.prose(rng, rng.randint(1, 12)) for _ in range(40)] + ["", " \t\n\x0b\x0c\r ", "é ü", "éü", cases.LONG]
    rows = [(rng.randint(0, 60), t.replace(" ", rng.choice([" ", "  ", "\n", ""])))
            for t in rng.choices(texts, k=150)] + [(i, "the very same text") for i in range(100, 180)]
    return rows + [(7, None), (None, None), (None, "é ü"), (5, "twice"), (5, "twice")]


@pytest.mark.parametrize("bits", [8, 64])  # at 8 bits many texts share a fingerprint
def test_exact_dedup_equals_brute_force(spark, bits):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = find_copies(docs, bits=bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == _expected(rows)


def test_copies_beyond_the_broadcast_bound_are_joined_by_shuffle(spark, monkeypatch):
    import tally.llm.exact_dedup as module
    monkeypatch.setattr(module, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(module, "SHARD_ROWS", 8)
    rows = _rows(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, find_copies(docs, bits=10).collect())) == _expected(rows)


def test_exact_dedup_edge_cases(spark):
    docs = cases.docs(spark)
    assert Counter(map(tuple, find_copies(docs).collect())) == _expected([r[:2] for r in cases.rows()])
    kept = drop_copies(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in cases.rows()})
    assert find_copies(cases.empty(spark)).count() == 0 and drop_copies(cases.empty(spark)).count() == 0
