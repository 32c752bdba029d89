"""Registered queries against their SQL, and the pipeline's stages against plain versions."""

import os
import random
import subprocess
import sys

import duckdb
import pytest

import corpus_pipeline
from shoplens.llm import decontaminate, queries

FOLDER = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def normal(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_as_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    found = queries.QUERIES[name](spark, FOLDER)
    assert sorted(found.columns) == sorted(columns)
    assert normal(found.columns, map(tuple, found.collect())) == normal(columns, cursor.fetchall())


def test_stages_as_plain_versions(spark, tmp_path):
    """On planted rows: bad texts go, one near copy stays, repeats go, leaks go, and the mix follows."""
    from test_jaccard import brute as components
    from test_suffix import brute as repeats

    rng = random.Random(8)
    real = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    words = real[0][1].split()
    base, passage = " ".join(rng.choice(words) for _ in range(150)), " ".join(rng.choice(words) for _ in range(90))
    rows = real + [(9000, base, "en", "src0", len(base)), (9001, base + " one more", "en", "src1", len(base) + 9), (9002, base, "en", "src0", len(base))]
    for i in range(3):
        text = f"{real[i][1].split()[0]} start{i} " + passage + " " + " ".join(rng.choice(words) for _ in range(60))
        rows.append((9010 + i, text, "en", "src2", len(text)))
    rows.append((9020, " ".join(rng.choice(words) for _ in range(80)) + " " + items[0][1].upper(), "en", "src1", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{number}")
        after = spark.read.parquet(f"{folder}/{number}")
        assert after.columns == docs.columns
        kept.append((sorted(map(tuple, docs.collect()), key=repr), sorted(map(tuple, after.collect()), key=repr)))
        docs = after
    quality_of = {r.doc_id: r.quality for r in labels.collect()}
    ids = [{r[0] for r in after} for _, after in kept]
    right = [(r[0] in ids[0]) == (quality_of[r[0]] == 1) for r in real if r[0] in quality_of]
    assert sum(right) / len(right) > 0.95 and {9000, 9001, 9002, 9010, 9011, 9012, 9020} <= ids[0]
    before, after = kept[1]
    assert {r[0] for r in after} == {k for k, n, c in components(before) if k == c} and ids[1] >= {9000} and not ids[1] & {9001, 9002}
    before, after = kept[2]
    assert [r[1] for r in after] == repeats(before, corpus_pipeline.PASSAGE)[1] and all(passage not in r[1] for r in after)
    before, after = kept[3]
    leaky = {r[0] for r in before if any(decontaminate.normal(t) in decontaminate.normal(r[1]) for _, t in items)}
    assert 9020 in leaky and {r[0] for r in before} - {r[0] for r in after} >= leaky and len(before) - len(after) <= len(leaky) + 2
    before, after = kept[4]
    copies = {r: after.count(r) for r in set(before)}
    assert sum(copies.values()) == len(after) and max(copies.values()) <= 3 and corpus_pipeline.ORACLE_SQL is None


def test_passages_of_just_over_50_words_go(spark):
    """Of short words, so that none has 400 bytes."""
    from test_suffix import brute as repeats

    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 6))) for _ in range(500)]
    draw = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [draw(n) for n in (51, 52, 55, 58, 60)]
    assert all(200 < len(p) < 400 for p in passages)
    rows = [(10 * i + j, f"{draw(30)} {p} {draw(20 + j)}", "en", "src0", 1) for i, p in enumerate(passages) for j in range(2)]
    rows += [(100 + i, draw(80) + " " + " ".join(passages[0].split()[:20]), "en", "src1", 1) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r for r in corpus_pipeline.no_repeated_passages(spark, docs, FOLDER).collect()}
    assert [found[r[0]].text for r in rows] == repeats(rows, 200)[1] and all(r.n_chars == len(r.text) for r in found.values())
    assert not any(p in r.text for p in passages for r in found.values()) and found[100].text == rows[-2][1]


def test_an_empty_corpus_gives_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        assert docs.collect() == []


def test_entry_works_without_the_corpus_operators(tmp_path):
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 200 and not any(k.startswith('op') and k[2:3].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_stages_on_odd_rows(spark, odd, odd_rows, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows and keys, and further columns with clashing names."""
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    whole = sorted(map(tuple, odd.collect()), key=repr)
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, odd, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        after = spark.read.parquet(f"{tmp_path}/{number}")
        assert after.columns == odd.columns, name
        rows = [tuple(r) for r in after.collect()]
        if name == "suffix-array dedup":
            assert len(rows) == len(odd_rows) and sorted(r[0] or -1 for r in rows) == sorted(r[0] or -1 for r in odd_rows)
            assert all(r[1] is None or r[4] == len(r[1]) for r in rows)
        else:
            assert set(rows) <= set(whole), name
            assert name == "mixing sources to target weights" or all(rows.count(r) <= whole.count(r) for r in set(rows))
