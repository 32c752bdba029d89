import random

from shoplens.llm import decontaminate


def least_edits(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        old, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            old, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, old + (p != c))
        best = min(best, row[-1])
    return best


def test_distance_as_dynamic_programming():
    rng = random.Random(2)
    for _ in range(200):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        edits, end = decontaminate.distance(pattern, text)
        assert edits == least_edits(pattern, text)
        assert edits == len(pattern) or least_edits(pattern, text[:end]) == edits


def test_items_within_budget_are_found(spark, odd, odd_rows, nothing):
    rng = random.Random(3)
    item = "the quick brown fox jumps over the lazy dog while nobody at all is watching it"
    items = [(1, item), (2, "too short"), (3, None), (4, ""), (None, "another quite long test item that stands in no text whatsoever"), (1, item)]
    texts = []
    for k in range(200):
        copy = list(item)
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([[], ["z"], ["z", copy[at]]])
        texts.append((k, "Before. " + "".join(copy).upper().replace(" ", rng.choice([" ", "\n", "  "])) + " after", 1))
    docs = spark.createDataFrame([*texts, (500, None, 1), (501, "", 1), (502, "x " * 50000, 1), (0, texts[0][1], 1)], "doc_id long, text string, distance int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(docs, bench)
    budget = int(0.08 * len(item))
    expected = sorted(k for k, t, _ in [*texts, texts[0]] if least_edits(item, decontaminate.normal(t)) <= budget)
    rows = found.collect()
    assert 20 < len(set(expected)) < 200
    assert sorted(r.doc_id for r in rows if r.item_id == 1) == sorted(expected * 2) and {r.item_id for r in rows} == {1}
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({*range(200), 500, 501, 502} - set(expected))
    assert decontaminate.contaminated(nothing, bench).collect() == []
    assert decontaminate.contaminated(odd, bench.limit(0)).collect() == [] and decontaminate.without_leaks(odd, bench.limit(0)).count() == len(odd_rows)


def test_short_items_stand_between_word_borders(spark):
    bench = spark.createDataFrame([(1, "What is 17 times 23?"), (2, "Cat"), (3, " "), (4, "C++")], "item_id long, text string")
    texts = ["so, WHAT is  17 times\n23?", "what is 17 times 234", "what is 17 times 23?x", "concatenate the cats", "concat, a cat.", "c++", "c++11 or c+", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted((r.doc_id, r.item_id, r.distance, r.end) for r in decontaminate.contaminated(docs, bench).collect())
    assert found == [(0, 1, 0, 24), (2, 1, 0, 20), (4, 2, 0, 13), (5, 4, 0, 3), (6, 4, 0, 3)]
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()) == [1, 3, 7, 8]
