"""Caller-supplied functions, run over Arrow batches: token counts, embeddings, completions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 384
#: Characters of texts that an embedding function gets at once; a longer text comes alone.
PORTION_CHARS = 1_000_000


def token_counter(count: Callable[[str], int]):
    """A column function from any counter of one text; a null text has no tokens."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: count(t) if t else 0)

    return counted


def hashed_vector(text: str, size: int = SIZE) -> np.ndarray:
    """Unit vector from a chain of SHA-256 digests read as big-endian 16-bit integers."""
    state, raw = hashlib.sha256(text.encode()).digest(), b""
    while len(raw) < 2 * size:
        raw += state
        state = hashlib.sha256(state).digest()
    v = np.frombuffer(raw[: 2 * size], ">i2").astype(np.float64) / 32768 * 0.1
    return v / max(np.linalg.norm(v), 1e-12)


def _portions(texts: pd.Series) -> Iterator[list[str]]:
    """The texts of a batch in order, at most PORTION_CHARS characters at once or one text; null texts are empty."""
    own, chars = [], 0
    for t in texts:
        t = t or ""
        if own and chars + len(t) > PORTION_CHARS:
            yield own
            own, chars = [], 0
        own.append(t)
        chars += len(t)
    if own:
        yield own


def embedder(embed: Callable[[list[str]], np.ndarray]):
    """A column function from any function of a list of texts to an array of vectors. The function gets
    PORTION_CHARS characters of a batch at once, so what it holds does not grow with the texts of a batch."""

    @F.pandas_udf("array<float>")
    def embedded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([v for own in _portions(texts) for v in np.asarray(embed(own), np.float32)], dtype=object)

    return embedded


def test_embedding(column):
    return embedder(lambda texts: np.stack([hashed_vector(t) for t in texts]))(column)


def completions(df: DataFrame, prompt_col: str, complete: Callable[[list[str]], list[str]]) -> DataFrame:
    """Adds `answer`: what a completion function makes of each batch of prompts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(answer=complete(pdf[prompt_col].tolist()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{kinds}, answer string")


def chunk_table(cut: Callable[[str], list[str]]):
    """A table function (number, of, chunk) from any function that cuts a text into chunks."""

    class Chunks:
        def eval(self, text: str):
            found = cut(text)
            for i, c in enumerate(found):
                yield i, len(found), c

    return F.udtf(Chunks, returnType="number int, of int, chunk string")
