"""Byte-level BPE against the library that the rank file belongs to."""

import hashlib
import random
import struct
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from shoplens.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def expected(library, rows):
    out = []
    for key, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((key, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_texts():
    rng = random.Random(3)
    pool = "aZé 1٣!'st\n\t\x1c\x85 　_漢字՘½Ⅷ​힣'll're😀\U0001f600𝔘\U000323b0࢏\U00011de1ßü,.-"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += ["a" * 5000, "ab" * 700, "-" * 900, "é" * 300, "漢" * 400, " " * 700 + "x", "\n" * 600, "".join(rng.choice("etaoinshrdlu") for _ in range(4000))]
    return texts + ["<|endoftext|> <|endoftext|>", "ÃÂ" * 200, "1" * 300, "\x00\x01\x7f", " the  the\n\nthe"]


def test_odd_rows_as_the_library(spark, odd_rows, odd, nothing, library):
    rows = [(r[0], r[1]) for r in odd_rows]
    found = bpe.digests(odd, PATH, public_tokenizers.PATTERN)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == expected(library, rows)
    assert bpe.digests(nothing, PATH, public_tokenizers.PATTERN).collect() == []


def test_characters_long_words_and_control_strings(spark, library):
    rows = list(enumerate(odd_texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    encoded = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    assert sorted(map(tuple, encoded.collect())) == [(i, library.encode_ordinary(t)) for i, t in rows]
    assert {r.doc_id: bytes(r.bytes) for r in bpe.decode(encoded, PATH).collect()} == {i: t.encode() for i, t in rows}


def test_keys_of_another_kind_and_empty_ids(spark):
    docs = spark.createDataFrame([("a", "one two"), (None, None)], "name string, body string")
    encoded = bpe.encode(docs, PATH, public_tokenizers.PATTERN, key="name", text="body")
    assert {r.name: bytes(r.bytes) for r in bpe.decode(encoded, PATH, key="name").collect()} == {"a": b"one two", None: b""}


def test_small_slices_give_the_same(spark, odd, library, odd_rows):
    ranks = bpe.read_ranks(PATH)
    slices = bpe.sliced(odd.where("doc_id is not null"), ranks, public_tokenizers.PATTERN, slice_bytes=500)
    assert slices.count() > 20
    found = {}
    for batch in bpe.folded(slices, ranks).toArrow().to_batches():
        for keys, texts in bpe._ids(batch, ranks):
            for key, ids in zip(keys.to_pylist(), texts):
                found.setdefault(key, []).append(ids.tolist())
    wanted = {}
    for row in odd_rows:
        if row[0] is not None:
            wanted.setdefault(row[0], []).append(library.encode_ordinary(row[1] or ""))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in wanted.items()}


def test_every_piece_merges_from_its_two_parts(library):
    """The parts that each rank is folded from give the piece, and the heap gives the library's ids for every piece."""
    ranks = bpe.read_ranks(PATH)
    pieces = bpe.pieces_of(ranks)
    found = bpe.merges(ranks)
    assert len(found) == len(ranks) - 256 and all(pieces[a] + pieces[b] == pieces[rank] and max(a, b) < rank or min(len(pieces[a]), len(pieces[b])) == 1 for rank, (a, b) in found.items())
    rng = random.Random(6)
    for piece in rng.sample(sorted(ranks), 300):
        assert bpe.heap_merged(piece * 3, ranks) == library._core_bpe.encode_single_piece(piece * 3)


def test_ranked_substrings_in_bounded_memory():
    """Work arrays hold a part of the words, so 2 MB of distinct words take little more than their ranks."""
    substrings = bpe.Substrings(bpe.read_ranks(PATH))
    rng = random.Random(8)
    few = [b"", *("".join(rng.choices("etaoinshrdlu \u00e9", k=rng.randint(1, 30))).encode() for _ in range(2000)), b""]
    for words in ([], [b""], few):
        (borders, ranks), (whole_borders, whole_ranks) = substrings.of(words, 700), substrings.of(words, 1 << 40)
        assert np.array_equal(borders, whole_borders) and np.array_equal(ranks, whole_ranks) and len(borders) == len(words) + 1
    alone = [substrings.of([word])[1].tolist() for word in few]
    assert [ranks[a:b].tolist() for a, b in zip(borders, borders[1:])] == alone
    many = ["".join(rng.choices("qxzjkvw", k=20)).encode() for _ in range(100_000)]
    tracemalloc.start()
    substrings.of(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_query_on_its_table(spark, library):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op11_byte_bpe"](spark, folder).collect()), key=repr) == expected(library, rows)
