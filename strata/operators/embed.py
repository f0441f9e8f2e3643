"""Text -> fixed-width vector, as a distributed batch job.

Default encoder: JVM-side feature hashing (lower-case whitespace tokens, term
counts in ``dim`` buckets of their md5, L2-normalised) with ``pyspark.ml``
transformers: a map-only plan over whole texts, no Python worker. A pluggable ``encoder(list[str]) ->
ndarray`` (e.g. an ONNX text model) runs in ``mapInPandas`` in batches of
``batch_size`` texts, loaded once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.config import EMBED_BATCH_SIZE, EMBED_DIM_TEXT

Encoder = Callable[[list[str]], np.ndarray]
_ENCODERS: dict[str, Encoder] = {}


def hashing_embed(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = EMBED_DIM_TEXT) -> DataFrame:
    """EMB1 default: hashed term-frequency vector of the whole text, L2-normalised,
    as ``array<float>``. Null text is embedded like ``''`` (all zeros)."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"), lambda t: t != "")
    slot = lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dim).cast("string")
    toks = df.withColumn("_strata_tok", F.transform(words, slot))
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(dim)], "_strata_tok", "_strata_tf")
    tf = counter.transform(toks)
    nv = Normalizer(inputCol="_strata_tf", outputCol="_strata_vec", p=2.0).transform(tf)
    return nv.withColumn(out_col, vector_to_array("_strata_vec", "float32")).drop(
        "_strata_tok", "_strata_tf", "_strata_vec"
    )


def register_encoder(name: str, factory: Callable[[], Encoder]) -> None:
    """Make an encoder available to Python workers by name (factory runs once per worker)."""
    _FACTORIES[name] = factory


_FACTORIES: dict[str, Callable[[], Encoder]] = {}


def _get_encoder(name: str) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = _FACTORIES[name]()
    return _ENCODERS[name]


def encoder_embed(
    df: DataFrame,
    key_col: str,
    text_col: str,
    encoder: Encoder | str,
    dim: int,
    batch_size: int = EMBED_BATCH_SIZE,
    out_col: str = "embedding",
) -> DataFrame:
    """EMB1 with a pluggable encoder: ``(key, embedding array<float>)``, one row
    out per row in, texts encoded ``batch_size`` at a time inside each task."""
    key_type = df.schema[key_col].dataType.simpleString()
    enc = encoder

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = _get_encoder(enc) if isinstance(enc, str) else enc
        for pdf in batches:
            texts = pdf[text_col].fillna("").astype(str).tolist()
            vecs = []
            for i in range(0, len(texts), batch_size):
                vecs.extend(np.asarray(f(texts[i : i + batch_size]), dtype=np.float32))
            yield pd.DataFrame({key_col: pdf[key_col].to_numpy(), out_col: [v.tolist() for v in vecs]})

    return df.select(key_col, text_col).mapInPandas(run, f"`{key_col}` {key_type}, `{out_col}` array<float>")


def embed_text(df: DataFrame, key_col: str, text_col: str, encoder: Encoder | str | None = None, dim: int = EMBED_DIM_TEXT) -> DataFrame:
    """EMB1/EMB3: ``(key, embedding)`` for the ``(key, text)`` projection of ``df``."""
    if encoder is None:
        return hashing_embed(df.select(key_col, text_col), text_col, dim=dim).select(key_col, "embedding")
    return encoder_embed(df, key_col, text_col, encoder, dim)
