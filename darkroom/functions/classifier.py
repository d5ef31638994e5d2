"""Image classifiers by name: a model is loaded once in each Python worker and answers batches of images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An answer: category, whether the shot is ephemeral, why, and how sure the model is.
ANSWER = "category string, ephemeral boolean, reason string, confidence float"
#: A model takes images and gives an answer, or None, for each.
Model = Callable[[list], list]
#: Images that a model is asked about together.
BATCH = 32

_LOADERS: dict[str, Callable[[], Model]] = {}
_LOADED: dict[str, Model] = {}


def register(name: str, load: Callable[[], Model]) -> None:
    """Makes a classifier known to this driver. load() runs in the workers, so what it needs must be there or in its closure."""
    _LOADERS[name] = load


def names() -> list[str]:
    return sorted(_LOADERS)


def _stub() -> Model:
    return lambda images: [("unknown", False, "", 0.0)] * len(images)


register("stub", _stub)


def classified(df: DataFrame, name: str = "stub", image_col: str = "rgba") -> DataFrame:
    """df with vlm, the named model's answer to each row's image. A missing image, or no answer, gives null; a confidence
    is cut to 0 and 1."""
    if name not in _LOADERS:
        raise ValueError(f"no classifier {name!r}; known are {', '.join(names())}")
    load, key = _LOADERS[name], name

    @F.pandas_udf(ANSWER)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from darkroom.functions import classifier

        model = classifier._LOADED.get(key) or classifier._LOADED.setdefault(key, load())
        for images in batches:
            out = [(None, None, None, None)] * len(images)
            there = [i for i, x in enumerate(images) if x is not None]
            for k in range(0, len(there), BATCH):
                some = there[k : k + BATCH]
                for i, answer in zip(some, model([images.iloc[j] for j in some])):
                    if answer is not None:
                        category, ephemeral, reason, confidence = answer
                        out[i] = (str(category), bool(ephemeral), str(reason), min(1.0, max(0.0, float(confidence))))
            yield pd.DataFrame(out, columns=["category", "ephemeral", "reason", "confidence"]).astype({"confidence": "float32"})

    answer = F.col("_answer")
    return df.withColumn("_answer", of(F.col(image_col))).withColumn("vlm", F.when(answer["category"].isNotNull(), answer)).drop("_answer")
