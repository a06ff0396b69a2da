import os
import random

import numpy as np
import pytest

import corpus_pipeline
from tally.llm.line_dedup import edit_distance
from tally.llm.minhash_dedup import Weights, weighted_jaccard, weighted_rows
from tally.llm.mixing import mix_sources
from tally.llm.queries import QUERIES
from tests_llm import cases

SF_SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_chat_format": ["conv_id", "donor_id", "n_prompt_turns", "prompt", "chosen", "rejected", "chosen_mask",
                        "rejected_mask", "trainable"],
    "op2_minhash_dedup": ["doc_id", "class_id", "class_size", "kept"],
    "op3_decontaminate": ["doc_id", "item_id", "lcs", "item_words", "first_word", "answer_found", "verbatim"],
    "op4_mixing": ["doc_id", "size", "source_size", "target", "taken", "source"],
    "op5_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op6_warc_audit": ["file", "offset", "status", "length", "digest", "found_length", "found_digest"],
    "op7_html_extract": ["page_id", "url", "text", "n_chars"],
    "op8_line_dedup": ["doc_id", "n_lines", "n_removed", "n_near"],
    "op9_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          "base_failed", "kept", "lost_words"],
    "op10_chunk_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op11_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op12_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op13_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"]}


@pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="driver data not present")
def test_every_query_runs_over_its_table(spark):
    assert list(COLUMNS) == list(QUERIES)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").count()
    for name, query in QUERIES.items():
        out = query(spark, SF_SMALL)
        assert out.columns == COLUMNS[name]
        n = out.count()
        if name.split("_")[0] in ("op2", "op4", "op5", "op8", "op9", "op10", "op11"):
            assert n == docs, name
        elif name == "op7_html_extract":
            assert n == pages
        elif name != "op6_warc_audit":  # fifty pages may hold no damage
            assert n > 0, name


@pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="driver data not present")
def test_queries_match_their_sql(spark):
    from oracle_check import compare
    names = ["op1_chat_format", "op4_mixing", "op6_warc_audit", "op11_exact_dedup", "op12_hard_negatives",
             "op13_vector_codes"]
    assert {k: v[0] for k, v in compare(spark, SF_SMALL, names, verbose=False).items()} == {k: "ok" for k in names}


def _edges(rng):
    """Documents with junk, repeated lines, near copies and benchmark passages."""
    items = [cases.prose(rng, 25) + " item" + str(k) for k in range(4)]
    common = "A line that many of the documents share, word for word."
    docs = []
    for i in range(60):
        lines = [cases.prose(rng, rng.randint(15, 40)) for _ in range(4)]
        if i % 5 == 0:
            lines.insert(1, common)
        if i % 9 == 4:
            lines.insert(2, items[i % 4])
        docs.append("\n".join(lines))
    docs += [docs[3], docs[7].replace(" ", " x", 1), docs[11].replace("\n", " "), "too short", None, "",
             "again and again " * 30]
    docs += [" ".join(docs[k].replace("\n", " ").split()[:-3] + ["new", "end", "words"]) for k in (1, 2)]
    return items, docs


def _vector(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    shingle, count, _ = weighted_rows(raw, np.array([0, len(raw)]), 5)
    return shingle, count.astype(float)


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _brute_force(items, docs):
    """doc id to text after the first four stages."""
    kept = {}
    for i, t in enumerate(docs):
        words = (t or "").split()
        windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
        covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
        if len(words) >= 20 and 100 * len(covered) <= 30 * len(words):
            kept[i] = t
    seen: list[bytes] = []
    for i, t in kept.items():
        out = []
        for line in t.split("\n"):
            raw = line.strip().encode()
            same = raw and any(raw == s or min(len(raw), len(s)) >= 32 and edit_distance(raw, s, 1) <= 1 for s in seen)
            if raw:
                seen.append(raw)
            if not same:
                out.append(line)
        kept[i] = "\n".join(out)
    vectors = {i: _vector(t) for i, t in kept.items()}
    root = {i: i for i in kept}
    for i in kept:
        for j in kept:
            if j < i and (kept[i] == kept[j] or weighted_jaccard(vectors[i], vectors[j]) >= 0.8):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    kept = {i: t for i, t in kept.items() if root[i] == i}
    return {i: t for i, t in kept.items()
            if not any(_lcs(x.split(), t.split()) >= 0.8 * len(x.split()) for x in items)}


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    items, docs = _edges(rng)
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(docs)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near-duplicates", "decontamination", "mixing"]
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        frame.write.parquet(str(tmp_path / f"stage{k}"))
        frame = spark.read.parquet(str(tmp_path / f"stage{k}"))
    want = _brute_force(items, docs)
    got = {r.doc_id: r for r in frame.collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) and r.source == f"s{i % 3}" for i, r in got.items())
    expected = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in want.items()], schema)
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, run.collect())) == sorted(map(str, mix_sources(expected).select(*run.columns).collect()))


def test_pipeline_over_awkward_and_empty_tables(spark, tmp_path):
    bench = spark.createDataFrame([(1, "some words that no document holds at all"), (2, None)], "item_id long, text string")
    for name, docs in (("full", cases.docs(spark)), ("none", cases.empty(spark))):
        d = str(tmp_path / name)
        docs.write.parquet(f"{d}/documents.parquet")
        bench.write.parquet(f"{d}/benchmark.parquet")
        frame = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, d)
            assert frame.columns == docs.columns
        out = corpus_pipeline.run(spark, d)
        assert (out.count() > 0) == (name == "full")
