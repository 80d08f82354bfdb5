"""Embedding models by name.

A model is registered under the name that records and queries carry; it is
loaded once per Python worker and given batches of texts.  Names without a
registered model go to the hashing embedder, which needs none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import terms
from textloom.sources.catalogs import DEFAULT_DENSE

#: An embedder is given a batch of texts and gives their vectors, a row each.
Embedder = Callable[[pd.Series], np.ndarray]
_EMBEDDERS: dict[str, Callable[[], Embedder]] = {}
DIMENSIONS = 64
#: Terms whose slot a worker remembers.
CACHE_TERMS = 100_000


def register_embedder(name: str, load: Callable[[], Embedder]) -> None:
    _EMBEDDERS[name] = load


#: Gives the places of the rows that have a vector, and their vectors, a row each.
Reader = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def hashed(dimensions: int = DIMENSIONS) -> Reader:
    """Counts of a text's terms in hashed slots, to unit length; texts without terms have none."""
    slots: dict[str, int] = {}

    def slot(term: str) -> int:
        found = slots.get(term)
        if found is None:
            if len(slots) >= CACHE_TERMS:
                slots.clear()
            found = slots[term] = int(hashlib.md5(term.encode()).hexdigest()[:6], 16) % dimensions
        return found

    def run(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
        terms = words.flatten().dictionary_encode()
        places = np.fromiter(map(slot, terms.dictionary.to_pylist()), dtype=np.int64, count=len(terms.dictionary))
        at = np.repeat(np.arange(len(words)) * dimensions, sizes) + places[terms.indices.to_numpy()]
        n = np.bincount(at, minlength=len(words) * dimensions).reshape(-1, dimensions)[sizes > 0]
        return np.flatnonzero(sizes), n / np.sqrt((n * n).sum(axis=1, dtype=float))[:, None]

    return run


def given(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors that are there as lists; null ones are left out."""
    flat = vectors.flatten().to_numpy()
    at = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    return at, flat.reshape(len(at), -1) if len(at) else np.zeros((0, 0))


def readable(text: Column, model: str | None = None) -> tuple[Column, Callable[[], Reader]]:
    """What the named model (by default the default one) reads of ``text``, and
    its reader, to be made once in a task."""
    load = _EMBEDDERS.get(model or DEFAULT_DENSE)
    if load is None:
        return terms(text), hashed

    def reader() -> Reader:
        embedder = load()
        return lambda texts: (np.arange(len(texts)), np.asarray(embedder(texts.to_pandas()), dtype=float))

    return F.coalesce(text, F.lit("")), reader


def embed(text: Column, model: str | None = None) -> Column:
    """Vectors of ``text`` by the named model (by default the default one)."""
    column, reader = readable(text, model)

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read = reader()
        for batch in batches:
            at, x = read(batch)
            sizes, has = np.zeros(len(batch) + 1, dtype=np.int32), np.zeros(len(batch), dtype=bool)
            has[at] = True
            sizes[1:][at] = x.shape[1] if len(at) else 0
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(x.ravel()), mask=pa.array(~has))

    return run(column)
