"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of e edits is cut into e + 1 pieces. Wherever the item stands with at most e edits, one
piece stands unchanged, so an automaton over all pieces finds every candidate place in one walk over a text. Myers'
bit-parallel distance, one machine operation per text character on integers as long as the item, decides. Items of fewer
than SHORTEST characters have no budget and count only between word borders, so that no part of a longer word is a match.
Items and texts are compared in lower case with white space runs as one space.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shoplens.llm.common import byte_slices

ERROR_RATE = 0.08
SHORTEST = 24
BLOCK_CHARS = 4 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


@dataclass(frozen=True)
class Item:
    id: object
    text: str
    budget: int
    bordered: bool = False

    def stands(self, text: str, at: int) -> bool:
        """Whether a word of the text neither begins before nor ends after the item at this place."""
        end = at + len(self.text)
        before = at > 0 and text[at - 1].isalnum() and self.text[0].isalnum()
        after = end < len(text) and text[end].isalnum() and self.text[-1].isalnum()
        return not before and not after

    def pieces(self) -> list[tuple[int, str]]:
        """budget + 1 pieces of about equal length, with their offsets."""
        parts, n = self.budget + 1, len(self.text)
        borders = [n * i // parts for i in range(parts + 1)]
        return [(a, self.text[a:b]) for a, b in zip(borders, borders[1:])]


def distance(pattern: str, text: str) -> tuple[int, int]:
    """Least edits between the pattern and any substring of the text, and where the first such substring ends."""
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    up, down, now, best, end = full, 0, len(pattern), len(pattern), 0
    for i, c in enumerate(text, 1):
        same = masks.get(c, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        more, less = (down | ~(horizontal | up)) & full, up & horizontal
        if more & top:
            now += 1
        elif less & top:
            now -= 1
        if now < best:
            best, end = now, i
        more, less = (more << 1) & full, (less << 1) & full
        up, down = (less | ~(vertical | more)) & full, more & vertical
    return best, end


class Finder:
    """All items of a block behind one automaton over their pieces."""

    def __init__(self, items: list[Item]):
        import ahocorasick

        self.items = items
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, item in enumerate(items):
            for offset, piece in item.pieces():
                places[piece].append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[Item, int, int]]:
        """Item, distance and end (in the normal form of the text) of the best place of every item within its budget."""
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (length, found) in self.automaton.iter(text):
            for i, offset in found:
                starts[i].add(end + 1 - length - offset)
        for i, found in starts.items():
            item, best = self.items[i], None
            if item.bordered:
                at = next((at for at in sorted(found) if item.stands(text, at)), None)
                if at is not None:
                    yield item, 0, at + len(item.text)
                continue
            at = text.find(item.text)
            if at >= 0:
                yield item, 0, at + len(item.text)
                continue
            for low, high in windows(sorted(found), item.budget):
                begin = max(0, low - item.budget)
                edits, end = distance(item.text, text[begin : high + len(item.text) + item.budget])
                if edits <= item.budget and (best is None or edits < best[0]):
                    best = edits, begin + end
            if best:
                yield item, *best


def windows(starts: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Sorted starts within the budget of each other are looked at together."""
    low = high = starts[0]
    for start in starts[1:]:
        if start - high > budget:
            yield low, high
            low = start
        high = start
    yield low, high


def item_blocks(benchmark: DataFrame, key: str, text: str, rate: float, shortest: int) -> Iterator[list[Item]]:
    """Items in blocks of bounded size; the driver holds them as parts of the plan."""
    block, size = [], 0
    for row in benchmark.select(F.col(key).alias("key"), F.col(text).alias("text")).orderBy("key", "text").toLocalIterator():
        found = normal(row["text"])
        if not found:
            continue
        short = len(found) < shortest
        block.append(Item(row["key"], found, 0 if short else int(rate * len(found)), short))
        size += len(found)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(
    docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, shortest: int = SHORTEST,
    key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """key, item_key, distance and end of every (row, item) where the item stands with at most rate * length edits.

    Items of fewer than ``shortest`` characters are searched without edits, between word borders; null and empty ones are
    nowhere. Null and empty texts hold nothing. Repeated rows and items each give their own rows, null keys stay null. Other
    columns are not read. Empty tables give no rows. ``end`` counts characters of the normal form. Items beyond
    BLOCK_CHARS are searched in further passes.
    """
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kinds = [chosen.schema["key"].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()]
    schema = f"`{key}` {kinds[0]}, `{item_key}` {kinds[1]}, distance int, end bigint"
    item_type = to_arrow_type(benchmark.schema[item_key].dataType)
    spark, out = docs.sparkSession, None
    for block in item_blocks(benchmark, item_key, item_text, rate, shortest):

        def run(batches: Iterator[pa.RecordBatch], block: list[Item] = block) -> Iterator[pa.RecordBatch]:
            finder = Finder(block)
            names = [key, item_key, "distance", "end"]
            for batch in batches:
                types = [batch.schema.field("key").type, item_type, pa.int32(), pa.int64()]
                for part in byte_slices(batch, "text"):
                    rows = [
                        (k, item.id, edits, end)
                        for k, t in zip(part["key"].to_pylist(), part["text"].to_pylist()) for item, edits, end in finder.matches(normal(t))
                    ]
                    columns = list(zip(*rows)) if rows else [(), (), (), ()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, types)], names=names
                    )

        found = chosen.mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, shortest: int = SHORTEST,
    text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The input's rows and columns without the rows that hold a test item, short ones too, as contaminated() finds it; no row
    moves."""
    for block in item_blocks(benchmark, item_key, item_text, rate, shortest):

        def run(batches: Iterator[pa.RecordBatch], block: list[Item] = block) -> Iterator[pa.RecordBatch]:
            finder = Finder(block)
            for batch in batches:
                for part in byte_slices(batch, text):
                    yield part.filter(pa.array([next(finder.matches(normal(t)), None) is None for t in part[text].to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
