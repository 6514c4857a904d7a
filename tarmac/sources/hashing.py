"""Perceptual hashes of image files. Decoding needs an image library, which is optional; hashes can also come in as a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


SIDE, KEEP = 32, 8  # fixed values: size that an image is reduced to, and of the low frequencies kept


def _cosines(n: int) -> np.ndarray:
    """Matrix of the cosine transform of n values."""
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    return 2 * np.cos(np.pi * k * (2 * i + 1) / (2 * n))


def reduced(grey: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Means over a grid of side x side cells; cells of a small image may repeat a pixel."""
    for axis in (0, 1):
        at = np.linspace(0, grey.shape[axis], side + 1).astype(int)
        grey = np.stack([np.take(grey, range(a, max(b, a + 1)), axis=axis, mode="clip").mean(axis=axis) for a, b in zip(at[:-1], at[1:], strict=True)], axis=axis)
    return grey


def cosine_hash(grey: np.ndarray) -> int:
    """64 bits: which of the lowest frequencies of the reduced image lie above their median, row by row."""
    c = _cosines(SIDE)
    low = (c @ reduced(np.asarray(grey, float)) @ c.T)[:KEEP, :KEEP]
    return int("".join("1" if b else "0" for b in (low > np.median(low)).ravel()), 2)


def decoder() -> Callable[[bytes], np.ndarray]:
    """Bytes to a grey array, by an image library if there is one."""
    try:
        import io

        from PIL import Image
    except ImportError as e:
        raise RuntimeError("no image library here; give hashes as a column instead") from e
    return lambda data: np.asarray(Image.open(io.BytesIO(data)).convert("L"), dtype=float)


def hashes(spark: SparkSession, folder: str, decode: Callable[[bytes], np.ndarray] | None = None) -> DataFrame:
    """path, b0..b3 (16-bit bands) of the image files in a folder; files that can't be decoded have null bands."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = decode or decoder()
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    v = cosine_hash(read(content))
                    out.append((path, *((v >> 16 * i) & 0xFFFF for i in range(4))))
                except Exception:  # whatever a decoder raises on a damaged file
                    out.append((path, None, None, None, None))
            yield pd.DataFrame(out, columns=["path", "b0", "b1", "b2", "b3"]).astype({f"b{i}": "Int32" for i in range(4)})

    return files.mapInPandas(run, "path string, b0 int, b1 int, b2 int, b3 int")
