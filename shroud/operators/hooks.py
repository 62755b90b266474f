"""User-code hooks (D49): a detector over Arrow batches.

``predict_factory()`` runs once per task (load the model there) and returns
``predict(texts: list[str]) -> list[list[(entity_type, start, end, score)]]``
with code-point offsets.  Failures are isolated per document (L05): the texts of
a failing batch are tried one by one, and only those that fail alone get no
spans and an ``error`` message.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shroud.functions.spans import SPAN_ARRAY


def model_detect(df: DataFrame, predict_factory: Callable[[], Callable], text_col: str = "text",
                 out: str = "model_spans") -> DataFrame:
    schema = T.StructType(df.schema.fields + [T.StructField(out, SPAN_ARRAY), T.StructField("error", T.StringType())])

    def spans_of(text, hits):
        return [{"entity_type": e, "start": int(s), "end": int(n), "score": float(sc), "raw_txt": text[int(s):int(n)]}
                for (e, s, n, sc) in hits]

    def run(it):
        predict = predict_factory()
        for pdf in it:
            texts = [t if isinstance(t, str) else "" for t in pdf[text_col]]
            try:
                spans = [spans_of(t, hits) for t, hits in zip(texts, predict(texts), strict=True)]
                err = [None] * len(texts)
            except Exception:  # find the document that fails, keep the others
                spans, err = [], []
                for t in texts:
                    try:
                        spans.append(spans_of(t, predict([t])[0]))
                        err.append(None)
                    except Exception as exc:
                        spans.append([])
                        err.append(f"{type(exc).__name__}: {exc}")
            yield pdf.assign(**{out: pd.Series(spans, dtype=object), "error": pd.Series(err, dtype=object)})

    return df.mapInPandas(run, schema)


def python_regex_predictor(patterns: dict[str, str]) -> Callable[[], Callable]:
    """A small example predictor: Python ``re`` patterns per entity type
    (used to cross-check the native extractor)."""

    def factory():
        import re

        compiled = [(e, re.compile(p)) for e, p in patterns.items()]

        def predict(texts):
            return [[(e, m.start(), m.end(), 1.0) for e, rx in compiled for m in rx.finditer(t)] for t in texts]

        return predict

    return factory
