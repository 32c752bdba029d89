import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, size string, score int"


def phrase(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Groups of exact and noisy copies, shared passages, nulls, empty, blank, long and periodic texts, repeated rows and keys."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = [phrase(rng, rng.randint(1, 60), words) for _ in range(40)]
    passage = phrase(rng, 70, words)
    for base in (phrase(rng, 50, words), phrase(rng, 24, words), phrase(rng, 9, words)):
        texts += [base, base, base.upper()]
        for _ in range(14):
            copy = base.split()
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append("  ".join(copy))
    texts += [phrase(rng, 5, words) + " " + passage + "\n" + phrase(rng, 6, words) for _ in range(25)]
    texts += [None, None, "", "", " \n\t ", "x", "x", "Ünïcode ß", "one two three", "ab " * 900, "ab " * 500, "a" * 3000, phrase(rng, 9000, words)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None, "hot", "hot", "hot"]), 1, 2, "clash", 3) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[5], None, None, None, 1, None, 2), (None, None, None, None, None, 1, None, 2), (7, "another text with the key of a row", "en", "s1", 1, 1, "", 1)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
