import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tally.llm.chat_format import conversations, format_preferences, swapped_replies
from tally.llm.decontaminate import find_leaks, drop_leaks, lcs_length, lcs_masks
from tally.llm.html_extract import default_model, extract_main_text, main_text, marginals, parse, train
from tally.llm.page_templates import labelled_pages
from tally.llm.quality_rules import keep_good, quality_rules, text_stats
from tally.llm.textkernel import lines, slices, words
from tally.llm.warc_audit import audit, collection_root, merkle_levels, write_order
from tests_llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Kernel.

def test_words_and_lines_never_cross_rows():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\t\x0bé") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None]
    for limit in (1, 40, 1 << 20):
        got_words, got_lines = [], []
        for row, data, offsets in slices(pa.array(texts), limit):
            raw = data.tobytes()
            starts, ends, first = words(data, offsets)
            for i in range(len(offsets) - 1):
                got_words.append([raw[a:b].decode() for a, b in zip(starts[first[i]:first[i + 1]],
                                                                    ends[first[i]:first[i + 1]])])
            got_lines += [(row + r, n, raw[a:b].decode()) for a, b, r, n in zip(*lines(data, offsets))]
        assert got_words == [WORD.findall(t or "") for t in texts]
        assert got_lines == [(i, k, s.strip(" \n\t\x0b")) for i, t in enumerate(texts)
                             for k, s in enumerate((t or "").split("\n")) if WORD.search(s)]


# Quality rules.

def _stats(text: str) -> tuple:
    found = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(found[i:i + 8]) for i in range(len(found) - 7))
    covered = {i + j for i in range(len(found) - 7) if windows[tuple(found[i:i + 8])] > 1 for j in range(8)}
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@pytest.mark.parametrize("seed", range(4))
def test_counts_against_brute_force(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "é#", " ", "\t", "\n", "a b c d a b c d e\n"])
                     for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", "\n", "x\n\n"]
    for _, data, offsets in slices(pa.array(texts)):
        s = text_stats(data, offsets)
        got = list(zip(*(s[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                 "n_repeat_words"))))
        assert got == [_stats(t) for t in texts]


def test_frequent_lines_reject_depleted_documents_only(spark):
    rng = random.Random(2)
    boiler = [cases.prose(rng, 15) for _ in range(16)]
    rows = []
    for i in range(120):
        own = cases.prose(rng, 60)
        rows.append((i, own + "\n" + boiler[0].upper().replace(" ", "  "), "x"))  # one common line: fine
    for i in range(120, 420):  # four common lines and little else
        rows.append((i, "\n".join(rng.sample(boiler, 4)) + "\n" + cases.prose(rng, 5), "x"))
    copied = cases.prose(rng, 50) + "\n" + cases.prose(rng, 50)
    rows += [(i, copied, "x") for i in range(500, 600)]  # many copies of one text are one document
    rows += [(i, "\n".join(rng.sample(boiler, 4)), "y") for i in range(600, 605)]  # rare on this host
    rows += [(700, "a b c", "x"), (701, "one two three four five six seven eight " * 9, "x"), (702, None, None)]
    out = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"),
                                              min_docs=20, host_share=0.02).collect()}
    assert len(out) == len(rows)
    assert all(out[i].kept and out[i].lost_words == 15 for i in range(120))
    assert all(not out[i].kept and not out[i].base_failed and out[i].lost_words == 60 for i in range(120, 420))
    assert all(out[i].kept and out[i].lost_words == 0 for i in range(500, 605) if i in out)
    assert all(out[i].base_failed and not out[i].kept for i in (700, 701, 702))


def test_documents_that_share_most_lines_all_count(spark):
    rng = random.Random(9)
    boiler = [cases.prose(rng, 25) for _ in range(8)]
    # Few own words beside eight lines that all have in common.
    rows = [(i, "\n".join([*boiler, cases.prose(rng, 12)]), "x") for i in range(30)]
    rows += [(40, "\n".join([boiler[0], *[cases.prose(rng, 25) for _ in range(2)]]), "x")]  # 50 of 75 words left
    rows += [(41, boiler[0] + "\n" + cases.prose(rng, 8), "x")]  # short, one common line
    rows += [(42, "\n".join([*boiler[:4], cases.prose(rng, 30)]), "x")]  # loses 100 of 130 words
    out = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")
                                              ).collect()}
    assert all(not out[i].kept and out[i].lost_words == 200 for i in range(30))
    assert [(out[i].kept, out[i].lost_words) for i in (40, 41, 42)] == [(True, 25), (True, 25), (False, 100)]


def test_frequent_lines_leave_the_kept_texts(spark):
    rng = random.Random(5)
    header, footer = cases.prose(rng, 9), cases.prose(rng, 12)
    own = {i: [cases.prose(rng, 40), "", cases.prose(rng, 40)] for i in range(60)}
    rows = [(i, "\n".join([header.upper(), *own[i], "  " + footer, ""]), "x", i) for i in own]
    rows += [(90, "\n".join([header, *own[0]]), "y", 90)]  # rare on this host
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, gone int").repartition(3)
    out = keep_good(df)
    assert out.columns == df.columns
    assert {r.doc_id: (r.text, r.gone) for r in out.collect()} == {
        **{i: ("\n".join([*own[i], ""]), i) for i in own}, 90: ("\n".join([header, *own[0]]), 90)}


# Chat format.

def _chat(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key int")


def test_preferences_share_a_prompt_and_mask_the_assistant(spark):
    u, a = "user", "assistant"
    pair = spark.createDataFrame([
        (1, [("system", "s"), (u, "q"), (a, "x"), (u, "more"), (a, "yes")], [("system", "s"), (u, "q"), (a, "y")]),
        (2, [(u, "q"), (a, "x")], [(u, "q"), (a, "x")]), (3, [(u, "q")], [(u, "q"), (a, "<|end|>")]),
        (4, [(a, None), (None, "t")], None), (5, [], [])],
        "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r.id: r for r in format_preferences(pair, "id").collect()}
    one = got[1]
    assert one.n_prompt_turns == 2 and one.prompt == "<|system|>\ns\n<|end|>\n<|user|>\nq\n<|end|>\n"
    assert [one.chosen[s.start:s.end] for s in one.chosen_mask] == ["x\n<|end|>", "yes\n<|end|>"]
    assert [one.rejected[s.start:s.end] for s in one.rejected_mask] == ["y\n<|end|>"] and one.trainable
    assert one.chosen.startswith("<|assistant|>\nx") and "<|user|>\nmore" in one.chosen
    assert (got[2].n_prompt_turns, got[2].chosen, got[2].trainable) == (2, "", False)
    assert got[3].chosen == "" and got[3].rejected == "<|assistant|>\n< |end|>\n<|end|>\n" and not got[3].trainable
    assert got[4].chosen == "<|assistant|>\n\n<|end|>\n<|unknown|>\nt\n<|end|>\n" and got[4].rejected == ""
    assert got[5].prompt == "" and got[5].n_prompt_turns == 0


def test_conversations_and_swapped_replies(spark):
    rows = [(i, t, "assistant" if t % 2 else "user", f"{i} {t}", 0) for i in range(5) for t in range(i + 1)]
    rows += [(None, 0, "user", "lost", 0), (7, 0, None, None, 0), (8, 1, "assistant", "b", 0), (8, 1, "assistant", "a", 0)]
    told = conversations(_chat(spark, rows).repartition(3))
    assert {r.conv_id: [x.text for x in r.turns] for r in told.collect()}[8] == ["a", "b"]
    pairs = {r.conv_id: r for r in swapped_replies(told).collect()}
    assert set(pairs) == {1, 2, 3, 4, 8} and pairs[8].donor_id == 1 and pairs[2].donor_id == 3
    assert [x.text for x in pairs[4].chosen] == ["4 0", "4 1", "4 2", "4 3"]
    assert [x.text for x in pairs[4].rejected] == ["4 0", "4 1", "4 2", "b"]
    assert format_preferences(swapped_replies(conversations(_chat(spark, []))), "conv_id").count() == 0


def test_every_conversation_finds_a_donor(spark):
    """Whatever the ids; and rejected may leave at any reply."""
    rows = [(i * 100_003, t, "assistant" if t % 2 else "user", f"{i} {t}", 0) for i in range(700) for t in range(6)]
    told = conversations(_chat(spark, rows).repartition(3))
    for earlier in (False, True):
        pairs = swapped_replies(told, earlier=earlier).collect()
        assert {r.conv_id for r in pairs} == {i * 100_003 for i in range(700)}
        assert all(r.donor_id != r.conv_id for r in pairs) and len({r.donor_id for r in pairs}) == 700
        out = format_preferences(swapped_replies(told, earlier=earlier), "conv_id").collect()
        lengths = {r.n_prompt_turns for r in out}
        assert lengths == ({1, 3, 5} if earlier else {5})
        for r in out:
            n = (6 - r.n_prompt_turns + 1) // 2
            assert r.trainable and len(r.chosen_mask) == n and len(r.rejected_mask) == 1
            want = [f"{r.conv_id // 100_003} {t}\n<|end|>" for t in range(r.n_prompt_turns, 6) if t % 2]
            assert [r.chosen[m.start:m.end] for m in r.chosen_mask] == want
    one = conversations(_chat(spark, rows[:6] + [(5, 0, "user", "no reply", 0)]))
    assert swapped_replies(one).count() == 0


# WARC audit.

def _pages(spark, n=700):
    rng = random.Random(3)
    rows = [(i, f"http://h{i % 3}/{i}", "<p>" + cases.prose(rng, rng.randint(0, 300)), i) for i in range(n)]
    rows += [(None, None, None, 0), (None, "u", "", 0), (5, "http://h2/5", rows[5][2], 0), (n, "long", cases.LONG, 0)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, idx int")


def test_audit_finds_the_damage_and_reads_little_else(spark):
    from tally.llm.common import stage
    records = stage(write_order(_pages(spark)), "records")
    assert records.count() == 704 and audit(records, records).count() == 0
    ends = records.groupBy("file").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e"))
    assert ends.filter("n <> e").count() == 0
    rows = sorted(records.collect(), key=lambda r: (r.file, r.offset))
    rng = random.Random(4)
    hit = rng.sample(rows, 6)
    bad = {(r.file, r.offset): ("missing" if k < 2 else "corrupt") for k, r in enumerate(hit)}
    other = [(r.file, r.offset, r.length, "0" * 64 if (r.file, r.offset) in bad else r.digest) for r in rows
             if bad.get((r.file, r.offset)) != "missing"] + [("crawl-x", 0, 9, "f" * 64)]
    other = spark.createDataFrame(other, "file string, offset long, length long, digest string")
    out = {(r.file, r.offset): r.status for r in audit(records, other, range_bytes=4096, fanout=4).collect()}
    assert out == {**bad, ("crawl-x", 0): "extra"}
    nodes = merkle_levels(records, levels=3, range_bytes=4096, fanout=4)
    same = merkle_levels(records.repartition(5), levels=3, range_bytes=4096, fanout=4)
    assert collection_root(nodes[-1]) == collection_root(same[-1])
    none = records.limit(0)
    assert audit(none, none).count() == 0
    assert {r.status for r in audit(none, records).collect()} == {"extra"}


# Page text.

def test_model_generalises_to_new_pages():
    model = dict(default_model())
    good = total = 0
    for html, blocks in labelled_pages(250, seed=99):
        tree = parse(html)
        odds = marginals(tree, model)
        told = [(t, o > 0) for t, o in zip(tree.text, odds) if t is not None]
        assert [t for t, _ in told] == [t for t, _ in blocks]
        good += sum(a[1] == b[1] for a, b in zip(told, blocks))
        total += len(blocks)
    assert good > 0.985 * total


def test_messages_give_exact_marginals():
    import itertools
    import math
    from tally.llm.html_extract import _edge, features
    model = train(labelled_pages(20, seed=2), rounds=40)
    tree = parse("<body><div class=ad>Buy now</div><article><p>One two. Three.<p>Four</article><nav><a>x</a></nav>")
    n = len(tree.tag)
    own = [sum(model.get(f, 0.0) for f in fs) for fs in features(tree)]
    mass = [[0.0, 0.0] for _ in range(n)]
    for s in itertools.product((-1, 1), repeat=n):
        p = math.exp(sum(s[i] * own[i] / 2 for i in range(n))
                     + sum(model.get("pull " + _edge(tree, i), 0.0) * s[i] * s[tree.parent[i]] for i in range(1, n)))
        for i in range(n):
            mass[i][s[i] > 0] += p
    assert marginals(tree, model) == pytest.approx([math.log(b / a) for a, b in mass], abs=1e-6)


def test_markup_is_read_as_browsers_do(spark):
    html = ("<html><head><title>t</title></head><body><nav><a href=x>Home</a> <a href=y>News</a></nav><article>"
            "<h1>A &amp; B&nbsp;c</h1><p>One<b>two</b>  three,<br>four &#233;.<p>Second <!-- no --> paragraph, that "
            "goes on for a while and ends here.<script>if (a < b) '</p>'</script></article>"
            "<footer>&copy; Someone</footer>")
    model = dict(default_model())
    want = "A & B c Onetwo three, four é. Second paragraph, that goes on for a while and ends here."
    assert main_text(html, model) == want
    long = "<article>" + "".join(f"<p>Paragraph number {i} is here, with some words.</p>" for i in range(5000)) + "</article>"
    deep = "<div>" * 3000 + "<p>Deep down there is a text, still.</p>"
    rows = [(1, "u", html, 0), (1, "u", html, 0), (2, None, None, 0), (3, "u", "", 0), (None, "u", long, 0),
            (5, "u", deep, 0), (6, "u", "<a href='x <p \"", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = extract_main_text(df).collect()
    assert len(out) == 7 and [r.text for r in out if r.page_id == 1] == [want, want]
    assert all(r.text == "" and r.n_chars == 0 for r in out if r.page_id in (2, 3))
    assert [r.text.count("Paragraph number") for r in out if r.page_id is None] == [5000]
    assert all(r.n_chars == len(r.text) for r in out)
    assert extract_main_text(df.limit(0)).count() == 0


# Decontamination.

def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(5)
    for _ in range(500):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 20))] for _ in range(2))
        assert lcs_length(lcs_masks(a), len(a), b) == _lcs(a, b)


def _word_list(rng, n):
    return [cases.prose(rng, 1) + rng.choice(["", "a", "st", "ri"]) for _ in range(n)]


def test_leaks_and_paraphrases_are_found_and_clean_documents_left(spark):
    rng = random.Random(6)
    items = [" ".join(_word_list(rng, rng.randint(12, 60))) + ".\nThe answer is " + " ".join(_word_list(rng, 4))
             for _ in range(20)]
    docs, want = [], {}
    for i in range(400):
        body = _word_list(rng, rng.randint(50, 500))
        if i % 8 == 0:
            item = items[i // 8 % 20].split()
            if i % 16 == 0:  # a paraphrase: a word in ten changes, the answer stays
                item = [w if k >= len(item) - 4 or rng.random() > 0.1 else "other" for k, w in enumerate(item)]
            at = rng.randint(0, len(body))
            body[at:at] = item
            want[i] = i // 8 % 20
        docs.append((i, " ".join(body), 0, 0))
    docs += [(900, None, 0, 0), (901, "", 0, 0), (902, items[3], 0, 0), (902, items[3], 0, 0),
             (903, " ".join(_word_list(rng, 20000)) + " " + items[4], 0, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int, lcs int").repartition(3)
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (52, "w w")], "item_id long, text string")
    out = find_leaks(df, bench).collect()
    got = defaultdict(set)
    for r in out:
        got[r.doc_id].add(r.item_id)
    assert {i: {k} for i, k in want.items()} | {902: {3}, 903: {4}} == got
    assert len([r for r in out if r.doc_id == 902]) == 2
    kept = drop_leaks(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - set(got)
    blocks = find_leaks(df, bench, items_per_scan=7).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, out))
    assert find_leaks(df.limit(0), bench).count() == 0 and find_leaks(df, bench.limit(0)).count() == 0


def test_verbatim_passages_need_no_latent_space(spark):
    """With no cosine at all, every document is found of which brute force over
    all windows finds an item that lost at most a fifth of its words."""
    rng = random.Random(9)
    items = [" ".join(_word_list(rng, n)) for n in (5, 7, 10, 13, 15, 19, 25, 40, 59)]
    docs, want = [], set()
    for i in range(300):
        body, k = _word_list(rng, rng.choice([0, 3, 60, 700])), i % 12
        if k < len(items):
            item = items[k].split()
            for at in rng.sample(range(len(item)), rng.choice([0, len(item) // 10, len(item) // 5])):
                item[at] = rng.choice(["other", ""])
            at = rng.randint(0, len(body))
            body[at:at] = [w for w in item if w]
            want.add((i, k))
        docs.append((i, " ".join(body)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(df, bench, cosine=2.0).collect() if r.verbatim}
    assert got >= want
    for i, k in got - want:
        item, words = items[k].split(), docs[i][1].split()
        assert any(_lcs(item, words[a:a + len(item) + 16]) >= 0.8 * len(item) for a in range(len(words)))


def test_recall_by_kind_and_length(spark):
    """Share of planted items found, by share of words kept and length."""
    rng = random.Random(12)
    items = [_word_list(rng, n) for n in [12] * 40 + [20] * 40 + [45] * 40]
    docs, kinds = [], {}
    for kept in (1.0, 0.82, 0.7, 0.63):
        for k, item in enumerate(items):
            lost = set(rng.sample(range(len(item) - 3), int(len(item) * (1 - kept))))
            body = _word_list(rng, 500)
            at = rng.randint(0, len(body))
            body[at:at] = [f"x{rng.randrange(99)}" if j in lost else w for j, w in enumerate(item)]
            kinds[len(docs)] = (kept, k)
            docs.append((len(docs), " ".join(body)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(x), " ".join(x[-3:])) for k, x in enumerate(items)],
                                  "item_id long, text string, answer string")
    found = {(r.doc_id, r.item_id) for r in find_leaks(df, bench).collect()}
    share = defaultdict(list)
    for i, (kept, k) in kinds.items():
        share[kept, len(items[k])].append((i, k) in found)
    share = {k: sum(v) / len(v) for k, v in share.items()}
    assert all(v == 1.0 for (kept, _), v in share.items() if kept > 0.8), share
    assert all(v >= 0.95 for v in share.values()), share


def test_short_items_and_few_documents(spark):
    docs = spark.createDataFrame([(1, "It is the red house here"), (2, "the house is red"), (3, "yes"), (4, None),
                                  (5, "first words of an item " + " ".join(f"w{i}" for i in range(50)))],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the red house"), (2, "yes"), (3, ""), (4, "first words of an item"), (5, "red the")],
                                  "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()} == {(1, 1), (3, 2), (5, 4)}


def test_awkward_rows(spark):
    docs, none, n = cases.docs(spark), cases.empty(spark), len(cases.rows())
    out = quality_rules(docs).collect()
    assert len(out) == n and {r.doc_id: r.n_words for r in out}[6] == 30000
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out if r.kept)
    for op in (quality_rules, keep_good):
        assert op(none).count() == 0
    bench = spark.createDataFrame([(1, cases.rows()[1][1])], "item_id long, text string")
    assert {r.doc_id for r in find_leaks(docs, bench).collect()} >= {1, 2}


def test_clean_rows_that_share_an_id_with_a_leak_stay(spark):
    rng = random.Random(8)
    items = [" ".join(_word_list(rng, 30)) for _ in range(3)]
    clean = [" ".join(_word_list(rng, 80)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(clean[:36])]
    rows += [(7, items[0]), (None, items[1]), (None, clean[36]), (7, clean[37])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    kept = [(r.doc_id, r.text) for r in drop_leaks(df.repartition(3), bench).collect()]
    assert sorted(kept, key=str) == sorted((r for r in rows if r[1] not in items), key=str)


def test_replica_of_repeated_and_missing_ids(spark):
    """Only the records that were damaged are reported, whatever the ids."""
    from tally.llm.queries import damaged
    hit = [i for i in range(200) if (i * 31 + 7) % 97 == 5]
    lost = [i for i in range(200) if (i * 31 + 7) % 97 == 11]
    rows = [(i, f"u{i}", f"<p>page {i}</p>") for i in range(200)]
    rows += [(3, "again", "<p>other</p>"), (3, "again", "<p>other</p>"), (3, "u", None)]
    rows += [(None, f"n{i}", "<p>none</p>") for i in range(4)] + [(None, None, None)] * 2
    rows += [(hit[0], "second", "<p>second</p>")]
    out = audit(*damaged(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert sorted(r.status for r in out) == sorted(["corrupt"] * (len(hit) + 1) + ["missing"] * len(lost))
