"""Seams for models, with defaults that need none: hashed embeddings, a router over providers, a clustering for diagnosis."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 64


def _hashed(dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        import zlib

        for b in batches:
            out = []
            for t in b["_text"]:
                v = np.zeros(dim)
                for w in re.findall(r"\w+", (t or "").casefold()):
                    h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                    v[h % dim] += 1.0 if h >> 31 else -1.0
                n = np.linalg.norm(v)
                out.append((v / n if n else v).tolist())
            yield pd.DataFrame({"_id": b["_id"], "embedding": out})

    return run


def embed(df: DataFrame, id_col: str, text_col: str = "text", model: Callable | None = None, dim: int = DIM) -> DataFrame:
    """(id, embedding) of unit length. ``model`` maps a list of texts to vectors and runs in batches on the executors; without one, words are hashed to signed buckets. A text without words gets a zero vector."""
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    if model is None:
        run = _hashed(dim)
    else:

        def run(batches):
            for b in batches:
                v = np.asarray(model([t or "" for t in b["_text"]]), dtype=float)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                yield pd.DataFrame({"_id": b["_id"], "embedding": (v / np.where(n > 0, n, 1)).tolist()})

    return src.mapInPandas(run, f"_id {kind}, embedding array<double>").withColumnRenamed("_id", id_col)


class Router:
    """Calls providers in order of preference, keeps to the one that answered last, retries with growing pauses.

    ``providers`` maps names to functions from a prompt to a text. PermissionError is not retried. A validator's
    refusal counts as a failure of that provider.
    """

    def __init__(self, providers: dict[str, Callable[[str], str]], retries: int = 2, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep):
        self.providers, self.retries, self.pause, self.sleep = providers, retries, pause, sleep
        self.current: str | None = None

    def call(self, prompt: str, valid: Callable[[str], bool] | None = None) -> str:
        order = sorted(self.providers, key=lambda n: n != self.current) if self.current else list(self.providers)
        errors = []
        for name in order:
            for turn in range(self.retries + 1):
                try:
                    text = self.providers[name](prompt)
                    if valid is not None and not valid(text):
                        raise ValueError("the answer was refused")
                    self.current = name
                    return text
                except PermissionError as e:
                    errors.append(f"{name}: {e}")
                    break
                except Exception as e:
                    errors.append(f"{name}: {e}")
                    if turn < self.retries:
                        self.sleep(min(8.0, self.pause * 2**turn))
        raise RuntimeError("no provider answered: " + "; ".join(errors) if errors else "there is no provider")


def average_linkage(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters by average linkage over cosine distance, numbered by first member."""
    n = len(x)
    v = x / np.where((m := np.linalg.norm(x, axis=1, keepdims=True)) > 0, m, 1)
    d = 1 - v @ v.T
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    for _ in range(n - max(1, min(k, n))):
        a, b = divmod(int(d.argmin()), n)
        a, b = min(a, b), max(a, b)
        row = (d[a] * size[a] + d[b] * size[b]) / (size[a] + size[b])
        d[a], d[:, a] = row, row
        d[a, a] = d[b] = d[:, b] = np.inf
        size[a] += size[b]
        label[label == b] = a
    return np.unique(label, return_inverse=True)[1]
