"""Byte-level BPE: ranked merges folded by Spark's higher-order functions over the byte arrays of distinct words.

Texts are cut by the tokenizer's pattern; every slice of texts becomes one row with the byte arrays of its distinct words
and the texts as numbers of words. A byte array is a string with one character per symbol, at first one per byte.

A piece of the vocabulary has one merge: the two parts that are left when the pieces of lower rank have been merged inside it.
Whenever the library joins two parts to a piece, nothing has crossed the piece's ends before, so these are its two parts,
both of lower rank. Merges in order of rank, each at all its places from left to right, therefore give the library's result.
``aggregate`` folds the merges of a word's ranked substrings over its byte array, and a literal map gives the parts of every
rank. The map is two arrays with the rank as index, because Spark looks through a map's keys one after the other.

Decoding joins the bytes of the ids. Words of more than LONG bytes would cost a fold the square of their length; the task
merges them with a heap instead.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import ODD, byte_slices

SLICE_BYTES = 1 << 21
WORK_BYTES = 1 << 18
LONG = 256
FIRST = 0xE000  # symbol n is the character FIRST + n; there are no surrogates from there on
# Letters and numbers that Unicode has had since version 17, later than the library that the ranks belong to.
LATER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6
187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81
1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E
2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a file with a base64 piece and its rank in every line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"{path}: {len(missing)} single bytes have no rank")
    if max(ranks.values()) + FIRST > 0x10FFFF:
        raise ValueError(f"{path}: ranks must stay below {0x110000 - FIRST}")
    return ranks


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """The pattern's matches in a text, by the Unicode version of the ranks' library.

    Texts of the basic plane, nearly all, are matched by ``re`` with the classes written out as ranges, which is several
    times as fast as ``regex``.
    """
    import regex

    later = "".join("-".join(f"{chr(int(end, 16))}" for end in span.split("-")) for span in LATER.split())
    known = pattern
    for kind in (r"\p{L}", r"\p{N}"):
        known = known.replace(kind, f"[{kind}--[{later}]]")
    exact = regex.compile("(?V1)" + known).findall
    plane = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    ranges = {}
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        runs = [m.span() for m in regex.finditer(f"(?V1)[{kind}--[{later}]]+", plane)]
        ranges[kind] = "".join(f"\\u{ord(plane[a]):04x}-\\u{ord(plane[b - 1]):04x}" for a, b in _unbroken(runs, plane))
    usual = pattern.replace(r"[^\s\p{L}\p{N}]", "[^" + "".join(ranges.values()) + "]").replace(r"\S", f"[^{ranges[chr(92) + 's']}]")
    for kind, written in ranges.items():
        usual = usual.replace(kind, f"[{written}]")
    if r"\p" in usual:
        return exact
    usual, astral = re.compile(usual).findall, re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: usual(text) if text.isascii() or not astral(text) else exact(text)


def _unbroken(runs: list[tuple[int, int]], plane: str) -> Iterator[tuple[int, int]]:
    """Runs in ``plane``, which leaves the surrogates out, cut where they stand."""
    gap = plane.index("\ue000")
    for a, b in runs:
        yield from [(a, gap), (gap, b)] if a < gap < b else [(a, b)]


def merges(ranks: Mapping[bytes, int]) -> dict[int, tuple[int, int]]:
    """Both parts of every rank that merging can reach."""
    found = {}
    for piece, rank in ranks.items():
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            joined = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:])]
            least = min(joined)
            if least >= rank:
                break
            at = joined.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            found[rank] = ranks[parts[0]], ranks[parts[1]]
    return found


def rank_map(ranks: Mapping[bytes, int]) -> Column:
    """Two literal arrays by rank: the two symbols that are merged, and the symbol that they become."""
    found = merges(ranks)
    size = max(ranks.values()) + 1
    parts = ["".join(chr(FIRST + x) for x in found.get(rank, ())) for rank in range(size)]
    whole = [chr(FIRST + rank) for rank in range(size)]
    text = lambda values: F.split(F.lit(",".join(values)), ",")  # noqa: E731 - constant folding turns each into one literal
    return F.struct(text(parts).alias("parts"), text(whole).alias("whole"))


def merged(word: Column, ranked: Column, known: Column) -> Column:
    """The word's symbols after the merges of the given ranks, in order of rank."""
    return F.aggregate(ranked, word, lambda symbols, rank: F.replace(symbols, F.get(known["parts"], rank), F.get(known["whole"], rank)))


def heap_merged(word: bytes, ranks: Mapping[bytes, int]) -> list[int]:
    """The same merges for a word of any length: pairs wait in a heap by rank and place."""
    ends, after, before = list(range(1, len(word) + 1)), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    alive = [True] * len(word)
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        right = after[at]
        if right < len(word):
            rank = ranks.get(word[at : ends[right]])
            if rank is not None:
                heap.append((rank, at, ends[right])) if not ready else heapq.heappush(heap, (rank, at, ends[right]))

    ready = False
    for i in range(len(word)):
        offer(i)
    heapq.heapify(heap)
    ready = True
    while heap:
        _, at, end = heapq.heappop(heap)
        if not alive[at] or after[at] >= len(word) or ends[after[at]] != end:
            continue  # one side has been merged since
        right = after[at]
        alive[right], ends[at], after[at] = False, end, after[right]
        if after[at] < len(word):
            before[after[at]] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    return [ranks[word[i : ends[i]]] for i in range(len(word)) if alive[i]]


def _nested(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """List array of one list per row."""
    borders = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(borders), pa.array(np.concatenate(rows) if rows else [], kind))


class Substrings:
    """Finds the ranked substrings of many words at once, by the hashes of their bytes.

    Two strings with one hash would add a rank whose parts the word does not hold, or holds rightly, so nothing is lost.
    """

    def __init__(self, ranks: Mapping[bytes, int]):
        mergeable = merges(ranks)
        self.longest = max(map(len, ranks))
        hashes = {}
        for piece, rank in ranks.items():
            if rank in mergeable:
                value = 0
                for byte in piece:
                    value = (value * int(ODD) + byte + 1) & (2**64 - 1)
                hashes[value] = rank
        self.hashes = np.array(sorted(hashes), np.uint64)
        self.ranks = np.array([hashes[h] for h in sorted(hashes)], np.int64)
        self.seen = np.zeros(1 << 22, bool)  # a first look at 22 bits spares most searches
        self.seen[self.hashes >> np.uint64(42)] = True

    def of(self, words: list[bytes], work_bytes: int = WORK_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """Borders and ranks: every word's ranks, each once, lowest first. Words are looked at in parts of about ``work_bytes``,
        as the work arrays have some hundred bytes per byte."""
        part = np.cumsum([len(w) for w in words], dtype=np.int64) // work_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(words)]
        borders, ranks, total = [np.zeros(1, np.int32)], [np.zeros(0, np.int32)], 0
        for start, stop in zip(cuts, cuts[1:]):
            border, rank = self._of(words[start:stop])
            borders.append((border[1:] + total).astype(np.int32))
            ranks.append(rank.astype(np.int32))
            total += len(rank)
        return np.concatenate(borders), np.concatenate(ranks)

    def _of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.repeat(np.cumsum(sizes), sizes)
        owner = np.repeat(np.arange(len(words)), sizes)
        at, value = np.arange(len(data)), np.zeros(len(data), np.uint64)
        found = [np.zeros(0, np.int64)]
        for length in range(1, self.longest + 1):
            value = value * ODD + data[at + length - 1]
            hit = np.flatnonzero(self.seen[value >> np.uint64(42)])
            place = np.minimum(np.searchsorted(self.hashes, value[hit]), max(len(self.hashes) - 1, 0))
            same = self.hashes[place] == value[hit] if len(self.hashes) else np.zeros(0, bool)
            found.append(owner[at[hit[same]]] << 32 | self.ranks[place[same]])
            inside = at + length < ends[at]
            at, value = at[inside], value[inside]
            if not len(at):
                break
        each = np.sort(np.concatenate(found))
        each = each[np.diff(each, prepend=-1) > 0]
        return np.searchsorted(each, np.arange(len(words) + 1) << 32), each & 0xFFFFFFFF


def sliced(docs: DataFrame, ranks: Mapping[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows of slices: keys, lengths in words, word numbers, the distinct words as symbols, their ranks, and the long words.

    A word number n names word n of ``words``, a negative one entry ~n of ``long``. A word that is a piece itself is its symbol.
    """
    substrings = Substrings(ranks)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern)
        symbol = {b: chr(FIRST + ranks[bytes([b])]) for b in range(256)}
        for batch in batches:
            for part in byte_slices(batch, "text", slice_bytes):
                numbers: dict[str, int] = {}
                words, ranked, long, found, sizes = [], [], [], [], []
                for value in part["text"].to_pylist():
                    each = split(value) if value else []
                    for word in set(each).difference(numbers):
                        raw = word.encode()
                        if len(raw) > LONG:
                            long.append(raw)
                            numbers[word] = ~(len(long) - 1)
                            continue
                        whole = ranks.get(raw)
                        words.append(raw.decode("latin-1").translate(symbol) if whole is None else chr(FIRST + whole))
                        ranked.append(raw if whole is None else b"")
                        numbers[word] = len(words) - 1
                    found.append(np.fromiter(map(numbers.__getitem__, each), np.int32, len(each)))
                    sizes.append(len(each))
                borders, each_rank = substrings.of(ranked)
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                columns = [
                    one(part["key"]), one(pa.array(sizes, pa.int32())), pa.array([np.concatenate(found).tobytes()], pa.binary()), one(pa.array(words, pa.string())),
                    one(pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(each_rank, pa.int32()))), one(pa.array(long, pa.binary())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["keys", "sizes", "numbers", "words", "ranked", "long"])

    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    return chosen.mapInArrow(cut, f"keys array<{kind}>, sizes array<int>, numbers binary, words array<string>, ranked array<array<int>>, long array<binary>")


def folded(slices: DataFrame, ranks: Mapping[bytes, int]) -> DataFrame:
    """The slices with the merged symbols of every distinct word; the literal rank map stands in the plan once."""
    every = lambda known: F.zip_with("words", "ranked", lambda word, ranked: merged(word, ranked, known))
    return slices.withColumn("words", F.get(F.transform(F.array(rank_map(ranks)), every), F.lit(0))).drop("ranked")


def _ids(batch: pa.RecordBatch, ranks: Mapping[bytes, int]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Keys of every slice and the ids of its texts, one array per text."""
    for row in range(batch.num_rows):
        words = batch["words"][row].values
        borders = np.concatenate(([0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64))))
        symbols = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32) - np.uint32(FIRST)
        long = [np.array(heap_merged(word.as_py(), ranks), np.uint32) for word in batch["long"][row]]
        for word in long[::-1]:  # ~n counts from the end
            symbols, borders = np.concatenate((symbols, word)), np.append(borders, borders[-1] + len(word))
        numbers = np.frombuffer(batch["numbers"][row].as_py(), np.int32)
        sizes = np.diff(borders)
        ends = np.cumsum(batch["sizes"][row].values.to_numpy())
        texts = []
        for start, stop in zip([0, *ends.tolist()], ends.tolist()):
            each = numbers[start:stop]
            size = sizes[each]
            at = np.arange(size.sum()) + np.repeat(borders[:-1][each] - np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size, size)
            texts.append(symbols[at])
        yield batch["keys"][row].values, texts


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (array of int) of every row, without special tokens; special strings inside a text are plain text.

    A null or empty text has no ids. Repeated rows and keys, null ones too, each give their own row; an empty table gives
    none; other columns are not read. A task holds a slice of SLICE_BYTES of texts, or one longer text.
    """
    ranks = read_ranks(path)
    slices = folded(sliced(docs, ranks, pattern, key, text), ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in _ids(batch, ranks):
                yield pa.RecordBatch.from_arrays([keys, _nested(texts, pa.uint32()).cast(pa.list_(pa.int32()))], names=[key, "ids"])

    return slices.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def pieces_of(ranks: Mapping[bytes, int]) -> list[bytes]:
    """The bytes of every id; ids without a piece have none."""
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pieces


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and bytes: the pieces of every row's ids, joined. Null or no ids give no bytes; ids outside the ranks are refused."""
    pieces = pieces_of(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(batch.num_rows):
                part = batch.slice(start, 1)
                raw = b"".join(map(pieces.__getitem__, part["ids"][0].as_py() or []))
                yield pa.RecordBatch.from_arrays([part["key"], pa.array([raw], pa.binary())], names=[key, "bytes"])

    chosen = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return chosen.mapInArrow(run, f"`{key}` {chosen.schema['key'].dataType.simpleString()}, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 (bytes decoded from those
    ids) of every row, computed where the ids are, so that only digests leave the task."""
    ranks = read_ranks(path)
    slices = folded(sliced(docs, ranks, pattern, key, text), ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(ranks)
        for batch in batches:
            for keys, texts in _ids(batch, ranks):
                ids_sha = [hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in texts]
                bytes_sha = [hashlib.sha256(b"".join(map(pieces.__getitem__, ids.tolist()))).hexdigest() for ids in texts]
                columns = [keys, pa.array([len(ids) for ids in texts], pa.int64()), pa.array(ids_sha), pa.array(bytes_sha)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return slices.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
