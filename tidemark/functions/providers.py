"""Classifiers of frames as plug-ins: any object with a classify method, run where the rows are."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import pixels


class Provider(Protocol):
    """classify gets rows of frames and returns one label and confidence each; it may raise."""

    def classify(self, frames: pd.DataFrame) -> list[tuple[str, float]]: ...


class Unsorted:
    """Leaves every frame unsorted."""

    def classify(self, frames: pd.DataFrame) -> list[tuple[str, float]]:
        return [("unsorted", 0.0)] * len(frames)


class ByPixels:
    """Labels from the pixels alone, which local_class has found as columns before."""

    def classify(self, frames: pd.DataFrame) -> list[tuple[str, float]]:
        return list(zip(frames["__label"], frames["__conf"], strict=True))


PROVIDERS = {"none": Unsorted, "pixels": ByPixels}


def classify(frames: DataFrame, name: str, fallback: str = "none", tasks: int | None = None) -> DataFrame:
    """Adds label and conf by the named provider (unknown names get the fallback); a batch that fails goes to the fallback.

    tasks bounds how many run at a time. Write the result before using it twice: calls may cost.
    """
    provider, other = PROVIDERS.get(name, PROVIDERS[fallback])(), PROVIDERS[fallback]()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields) + ", label string, conf double"
    columns = frames.columns
    if isinstance(provider, ByPixels) or isinstance(other, ByPixels):
        named = pixels.local_class(frames).select(*columns, F.col("label").alias("__label"), F.col("conf").alias("__conf"))
    else:
        named = frames

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                found = provider.classify(batch)
            except Exception:  # noqa: BLE001  a provider is foreign code
                found = other.classify(batch)
            yield batch[columns].assign(label=[x[0] for x in found], conf=[float(x[1]) for x in found])

    return (named.repartition(tasks) if tasks else named).mapInPandas(run, schema)
