"""Small documents with every awkward case, and helpers."""

import random

LONG = " ".join(f"w{i}" for i in range(30000))
EXTRA = ["part", "key", "id", "root", "_id", "host", "size", "kept", "label"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["an", "be", "co", "du", "el"]) for _ in range(rng.randint(1, 4)))
                    for _ in range(n))


def rows() -> list[tuple]:
    """doc_id, text, lang, source, n_chars and columns with clashing names."""
    rng = random.Random(1)
    base = prose(rng, 120)
    texts = [
        (1, base, "a"), (2, base, "b"), (3, None, "a"), (4, "", "a"), (5, "  \n\t ", None), (6, LONG, "a"),
        (7, base.replace(" el ", " xx ", 1), "a"), (8, "one two three", "b"), (None, prose(rng, 60), "a"),
        (None, prose(rng, 60), None), (9, prose(rng, 80), None), (9, prose(rng, 80), None), (10, "é ü ñ " * 9, "b"),
        (11, prose(rng, 40) + "\n" + base[:300] + "\n" + prose(rng, 40), "b"),
        (12, "Same line that stands here twice, word for word.\n" * 4, "c")]
    texts.append(texts[0])  # a repeated row
    return [(i, t, "en", s, len(t or ""), *range(len(EXTRA))) for i, t, s in texts]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in EXTRA)


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
