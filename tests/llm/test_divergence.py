"""The source divergence audit against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shoplens.llm import divergence
from shoplens.llm.common import Tables


def brute(rows, min_docs):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in df[lang].items() if n >= min_docs)
        of = {s: counts[lang, s] for g, s in groups if g == lang}
        total = {s: sum(c[t] for t in kept) for s, c in of.items()}
        share = lambda n, all_: 1 + 1000000000 * (n + 5) // (all_ + 5 * len(kept))
        p = {s: [share(c[t], total[s]) for t in kept] for s, c in of.items()}
        q = [share(sum(c[t] for c in of.values()), sum(total.values())) for t in kept]
        pairs = sorted((-sum(abs(a - b) for a, b in zip(p[source], p[s])), s.encode(), s) for s in of if s != source)
        terms = sorted((b - a, t.encode(), t) for a, b, t in zip(p[source], q, kept) if of[source][t] and a > b)[:50]
        out += [(lang, source, part, name, -value, rank) for part, found in (("pair", pairs), ("term", terms)) for rank, (value, _, name) in enumerate(found, 1)]
    return sorted(out)


def found(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, df.collect()))


def texts(rng, n):
    """Few words for many documents, ties, a source with half of all rows, nulls, empty and long texts, upper case, repeats."""
    words = ["alpha", "Beta", "beta", "Éa", "éa", "x1y", "don't", "zz", "İK", "ß", "漢字"] + [f"w{c}" for c in "abcdefghij"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice([text, text, text, None, "", "123 \n"]), rng.choice(["en", "en", "fr", None, ""]), rng.choice(["hot", "hot", "a", "b", None, "é", "z"])))
    return rows + [(" ".join(rng.choice(words) for _ in range(20000)), "en", "long"), ("once only", "solo", "s"), (None, "mute", "s1"), ("", "mute", "s2")] + rows[:3]


@pytest.mark.parametrize("min_docs, spill, bucket", [(3, 1 << 19, 4096), (3, 12, 2), (30, 40, 5), (10**6, 50, 4096)])
def test_as_plain_python(spark, min_docs, spill, bucket):
    rows = texts(random.Random(min_docs), 300)
    docs = spark.createDataFrame([(*r, "clash", i, i) for i, r in enumerate(rows)], "text string, lang string, source string, term string, value long, rank long").repartition(4)
    assert found(divergence.audit(docs, Tables("test"), min_docs=min_docs, spill=spill, bucket_terms=bucket)) == brute(rows, min_docs)


def test_odd_and_empty_tables(spark, odd, odd_rows, nothing):
    assert found(divergence.audit(odd, Tables("test"), min_docs=2)) == brute([(r[1], r[2], r[3]) for r in odd_rows], 2)
    assert found(divergence.audit(nothing, Tables("test"))) == []


def test_spills_merge_to_the_same_stripes(spark, odd):
    whole, small = (divergence.stripes(odd.coalesce(1), spill=spill) for spill in (1 << 30, 5))
    assert small.count() > whole.count()
    as_rows = lambda df: sorted((r.lang, r.term, sorted((e.source, e.n) for e in r.counts)) for r in divergence.merged(df, 1).collect())
    assert as_rows(whole) == as_rows(small)


def test_shares_are_exact_for_large_counts():
    for total, terms in ((8 * 10**15, 10**9), (7, 1), (0, 3), (10**12 + 7, 12345)):
        counts = np.array([0, 1, total // 3, total])
        assert divergence.shares(counts, total, terms).tolist() == [1 + 1000000000 * (int(c) + 5) // (total + 5 * terms) for c in counts]
