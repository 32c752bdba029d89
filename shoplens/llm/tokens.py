"""Token counts: lengths only, from a public tokenizer, in Arrow batches.

Texts are split at ASCII white space, a boundary that the tokenizers served here never cross, so a text has the sum of
its pieces' counts. Within a batch every distinct piece is encoded once, in calls of about equal bytes, and the counts
of recent short pieces are remembered. Nothing but integers leaves the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import byte_slices, utf8

CALL_BYTES = 1 << 18
REMEMBERED = 1 << 18
LONG_PIECE = 64


def encoder(path: str) -> Callable[[Sequence[str]], list[int]]:
    """Counts of several strings by the library that the file belongs to, without begin, end or added special tokens."""
    if not path.endswith(".json"):
        raise ValueError(f"{path}: only .json vocabularies drop the white space at which texts are split")
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    probe = len(tokenizer.encode("a b\nc\td", add_special_tokens=False))
    if probe != sum(len(tokenizer.encode(x, add_special_tokens=False)) for x in "abcd"):
        raise ValueError(f"{path}: white space is part of its tokens, so texts can't be split there")
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]


def _learn(pieces: set[bytes], counts: dict[bytes, int], encode: Callable[[Sequence[str]], list[int]]) -> None:
    """Encode pieces in calls of about CALL_BYTES each."""
    call: list[bytes] = []
    size = 0
    for piece in pieces:
        call.append(piece)
        size += len(piece) + 8
        if size >= CALL_BYTES:
            counts.update(zip(call, encode([x.decode("utf-8", "replace") for x in call])))
            call, size = [], 0
    if call:
        counts.update(zip(call, encode([x.decode("utf-8", "replace") for x in call])))


def token_counts(docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row.

    A null or empty text has 0 bytes and 0 tokens; repeated rows and keys, null ones too, each give their own row;
    an empty table gives none. Special strings inside a text count as the library counts them by default. Columns
    other than key and text are not read. The task holds one Arrow batch and at most REMEMBERED short pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, counts = encoder(path), {}
        for batch in batches:
            for part in byte_slices(batch, "text"):
                data, offsets = utf8(part["text"])
                raw = data.tobytes()
                split = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                if len(counts) > REMEMBERED:
                    counts.clear()
                new = set().union(*split).difference(counts)
                _learn(new, counts, encode)
                tokens = np.array([sum(map(counts.__getitem__, x)) for x in split], np.int64)
                for piece in new:
                    if len(piece) > LONG_PIECE:
                        del counts[piece]
                yield pa.RecordBatch.from_arrays(
                    [part["key"], pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)],
                    names=[key, "n_bytes", "n_tokens", "over_limit"],
                )

    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
