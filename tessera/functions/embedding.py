"""What stands between texts and an embedding model: batches, inputs over the model's context, answers out of order.

A model is a function that takes a list of texts and gives (index, vector) pairs in any order, or raises InputTooLong.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

Model = Callable[[list[str]], Sequence[tuple[int, Sequence[float]]]]
#: Texts sent at once, and the characters under which a text is not cut any further.
BATCH, LEAST_CHARS = 16, 64


class InputTooLong(ValueError):
    """The texts are over the model's context."""


class InvalidResponse(ValueError):
    """The answer does not have one vector for each text."""


def reassemble(answer: Sequence[tuple[int | None, Sequence[float] | None]], n: int) -> list[Sequence[float]]:
    """The vectors by their index: n of them, each index once and in range."""
    if len(answer) != n:
        raise InvalidResponse(f"{len(answer)} vectors for {n} texts")
    out: list[Sequence[float] | None] = [None] * n
    for index, vector in answer:
        if index is None or not 0 <= index < n:
            raise InvalidResponse(f"no text has the index {index}")
        if out[index] is not None:
            raise InvalidResponse(f"two vectors have the index {index}")
        if vector is None:
            raise InvalidResponse(f"no vector at {index}")
        out[index] = vector
    return out


def embed_texts(model: Model, texts: list[str], least: int = LEAST_CHARS) -> list[Sequence[float]]:
    """A vector for each text. A batch that is too long is halved; a single text is cut to its first half until it fits."""
    if not texts:
        return []
    try:
        return reassemble(model(texts), len(texts))
    except InputTooLong:
        if len(texts) > 1:
            middle = len(texts) // 2
            return embed_texts(model, texts[:middle], least) + embed_texts(model, texts[middle:], least)
    text = texts[0]
    while len(text) > least:
        text = text[: len(text) // 2]
        try:
            return reassemble(model([text]), 1)
        except InputTooLong:
            continue
    raise InputTooLong(f"a text of {len(texts[0])} characters is too long even when cut to {len(text)}")


def embedder(model: Model, batch: int = BATCH):
    """An Arrow stage (id, text) -> (id, embedding); a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                vectors = embed_texts(model, [t or "" for t in part.column(1).to_pylist()])
                flat = [np.asarray(v, np.float32) for v in vectors]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(flat, pa.list_(pa.float32()))], ["id", "embedding"])

    return run
