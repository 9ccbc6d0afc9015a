"""Texts to vectors by a model that every worker loads once, batch by batch."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

MODEL = "intfloat/multilingual-e5-small"
#: Texts of one call of the model.
BATCH = 256

#: Vectors of a list of texts.
Encoder = Callable[[list[str]], "list[list[float]]"]
#: Loads an encoder, or gives None where there is no model at hand.
Loader = Callable[[], "Encoder | None"]


def fastembed(model: str = MODEL) -> Loader:
    """The optional package of that name."""

    def load() -> Encoder | None:
        try:
            from fastembed import TextEmbedding
        except ImportError:
            return None
        made = TextEmbedding(model)
        return lambda texts: [[float(x) for x in v] for v in made.embed(texts)]

    return load


def loaded(load: Loader, name: str) -> Encoder | None:
    """The encoder of a worker process, loaded on its first use."""
    kept = sys.__dict__.setdefault("_logloom_encoders", {})
    if name not in kept:
        kept.clear()
        kept[name] = load()
    return kept[name]


def embedded(texts: DataFrame, load: Loader, name: str, text: str = "text", vec: str = "vec", batch: int = BATCH) -> DataFrame | None:
    """texts with a column of vectors, null for a null text; None where the driver finds no model.

    The driver only probes; the model runs in the workers, on ``batch`` texts
    at a time.  Executors need what the driver has.
    """
    if load() is None:
        return None
    schema = texts.schema.simpleString()[len("struct<") : -1]
    columns = [*texts.columns, vec]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch].copy()
                said = part[text].notna()
                encode = encode or loaded(load, name)
                found = iter(encode(part.loc[said, text].tolist()) if said.any() else [])
                part[vec] = [[float(x) for x in next(found)] if s else None for s in said]
                yield part[columns]

    return texts.mapInPandas(run, f"{schema},{vec}:array<double>")
