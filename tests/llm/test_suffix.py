import collections
import hashlib

import pytest

from shoplens.llm import suffix


def brute(rows, length):
    counts = collections.Counter()
    for row in rows:
        raw = (row[1] or "").encode()
        counts.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out, kept_texts = [], []
    for row in rows:
        raw = (row[1] or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if counts[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(raw, gone) if not y)
        runs = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((row[0], len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
        kept_texts.append(None if row[1] is None else kept.decode("utf-8", "ignore"))
    return sorted(out, key=repr), kept_texts


@pytest.mark.parametrize("length,frequent,group", [(400, 256, 9), (60, 256, 9), (60, 3, 100_000), (60, 2, 3), (150, 2, 5), (400, 2, 2)])
def test_removal_as_brute_force(odd, odd_rows, monkeypatch, length, frequent, group):
    """Also with middles frequent in a batch, and with groups too large for a task."""
    monkeypatch.setattr(suffix, "GROUP_ROWS", group)
    found = suffix.remove_repeats(odd, length=length, frequent=frequent)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(odd_rows, length)[0]


def test_texts_lose_exactly_the_repeats(odd, odd_rows):
    kept = suffix.without_repeats(odd, length=60)
    assert kept.columns == odd.columns
    expected = sorted(((r[0], t, *r[2:]) for r, t in zip(odd_rows, brute(odd_rows, 60)[1])), key=repr)
    assert sorted(map(tuple, kept.collect()), key=repr) == expected


def test_empty_table(nothing):
    assert suffix.remove_repeats(nothing).collect() == []


@pytest.mark.parametrize("length", [60, 400])
def test_remaining_text_beside_the_digests(odd, odd_rows, length):
    found = suffix.remove_repeats(odd, length=length, kept="text").collect()
    wanted, texts = brute(odd_rows, length)
    assert sorted((tuple(r)[:5] for r in found), key=repr) == wanted
    assert sorted(((r.doc_id, r.text) for r in found), key=repr) == sorted(((row[0], t or "") for row, t in zip(odd_rows, texts)), key=repr)
