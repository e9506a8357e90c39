"""Models behind interfaces: deterministic stand-ins for embedding and generation."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")


def hash_embedding(texts: list[str | None], dim: int = 64) -> np.ndarray:
    """Unit vectors from hashed words with signs; equal texts have equal vectors, and a text without words has the zero vector."""
    out = np.zeros((len(texts), dim), np.float32)
    seen: dict[str, tuple[int, int]] = {}
    for i, t in enumerate(texts):
        for w in _WORD.findall((t or "").lower()):
            if (h := seen.get(w)) is None:
                c = zlib.crc32(w.encode())
                h = seen[w] = (c % dim, 1 if (c >> 16) & 1 else -1)
            out[i, h[0]] += h[1]
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norms > 0, norms, 1)


def image_embedding(images: list[bytes | None], dim: int = 64) -> np.ndarray:
    """Unit vectors from the mean levels of equal stretches of the bytes."""
    out = np.zeros((len(images), dim), np.float32)
    for i, b in enumerate(images):
        if b:
            a = np.frombuffer(b, np.uint8).astype(np.float32) + 1
            out[i] = [p.mean() if len(p) else 0 for p in np.array_split(a, dim)]
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norms > 0, norms, 1)


def embed_text(dim: int = 64, model: Callable[[list], np.ndarray] | None = None):
    """Arrow UDF text -> array<float>. The model is made once for each Python worker's batch iterator."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            made = (model or (lambda x: hash_embedding(x, dim)))(texts.tolist())
            yield pd.Series(list(made))

    return run


def embed_image(dim: int = 64, model: Callable[[list], np.ndarray] | None = None):
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for images in batches:
            yield pd.Series(list((model or (lambda x: image_embedding(x, dim)))(images.tolist())))

    return run


def generate(model: Callable[[str], str] | None = None):
    """Arrow UDF prompt -> text; without a model the prompt comes back."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield prompts if model is None else prompts.map(model, na_action="ignore")

    return run


def resize_nearest(pixels: bytes, width: int, height: int, channels: int, to_width: int, to_height: int) -> bytes:
    """Nearest-neighbour resize of interleaved pixels: row i of the result is row i * height // to_height; an empty image is black."""
    if not pixels or width <= 0 or height <= 0:
        return bytes(to_width * to_height * channels)
    a = np.frombuffer(pixels, np.uint8).reshape(height, width, channels)
    rows = np.arange(to_height) * height // to_height
    cols = np.arange(to_width) * width // to_width
    return a[rows][:, cols].tobytes()
