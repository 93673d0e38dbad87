"""Person models: a backend makes spans of texts, and runs over Arrow batches, loaded once per Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, functions as F

from ..functions import rules, spans


class NerBackend(Protocol):
    """A model. find() gives (start, end, label, score) for each text; labels are the model's own."""

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]: ...


def model_spans(text: Column, load: Callable[[], NerBackend], keep: tuple[str, ...] = ("PER", "PERSON")) -> Column:
    """SPANS of a model, to be passed to Detector.detect(). load runs once in each worker.

    Places are checked against the text, the text is cut out anew, scores are rounded to two digits.
    """
    @F.pandas_udf(spans.SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            texts = [t if isinstance(t, str) else "" for t in s]
            yield pd.Series([
                [
                    {"start": a, "end": b, "src": rules.SRC["ner"], "ord": i, "entity_type": label, "score": round(float(score), 2), "source": "ner", "text": t[a:b]}
                    for i, (a, b, label, score) in enumerate(found)
                    if label in keep and 0 <= a < b <= len(t)
                ]
                for t, found in zip(texts, model.find(texts), strict=True)
            ])

    return run(text)
