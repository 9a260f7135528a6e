"""Cutting oversized texts into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1200, 120

#: A boundary lies at the end of a match. From the strongest to the weakest; a table has rows before sentences.
_BREAKS = {
    "block": re.compile(r"\n[^\S\n]*\n\s*"),
    "line": re.compile(r"\r?\n|\r"),
    "sentence": re.compile(r"[.!?…](?:[\"'”’)\]]*)\s+|[。！？]+[」』”’）]*"),
    "clause": re.compile(r"[;:,]\s+|[；：，、]+|\s[–—-]\s+"),
}
_ORDER = {"table": ("block", "line", "clause"), "figure": ("block", "line", "sentence", "clause"), "": ("block", "sentence", "line", "clause")}
_WORD = re.compile(r"\S+")


def _token_ends(text: str) -> np.ndarray:
    """Starts of all words but the first, from prefix sums over the lengths of words and gaps."""
    lengths = np.fromiter((len(x) for x in re.split(r"(\s+)", text)), dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    return offsets[2:-1:2]


def split_points(text: str, level: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, kind of end) of the pieces of ``text``; consecutive ones overlap by at most ``overlap`` characters.

    A piece ends at the last boundary of the strongest kind in its second half, else at the last one of any kind
    beyond the overlap, else at the last word boundary, else after exactly ``limit`` characters (moved back so that no combining mark is cut off).
    The next piece begins at a sentence or, failing that, a word within the last ``overlap`` characters.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    order = _ORDER.get((level or "").lower(), _ORDER[""])
    ends = {k: [m.end() for m in _BREAKS[k].finditer(text)] for k in order}
    ends["word"] = _token_ends(text).tolist()
    pieces, start = [], 0
    while True:
        if n - start <= limit:
            pieces.append((start, n, "end"))
            return pieces
        least = start + max(limit // 2, overlap + 1)
        last = 0
        for name in order:
            b = ends[name]
            k = bisect_right(b, start + limit) - 1
            if k >= 0 and b[k] >= least:
                end, kind = b[k], name
                break
            if k >= 0 and b[k] > max(last, start + overlap):
                last, kind = b[k], name
        else:
            end = last
        if not end:
            b = ends["word"]
            k = bisect_right(b, start + limit) - 1
            if k >= 0 and b[k] > start + overlap:
                end, kind = b[k], "word"
            else:
                import unicodedata

                end, kind = start + limit, "hard"
                while end > start + overlap + 1 and unicodedata.combining(text[end]):
                    end -= 1
        pieces.append((start, end, kind))
        start = end
        for kind in ("sentence", "line", "word") if kind != "hard" else ():
            b = ends.get(kind, [])
            k = bisect_left(b, end - overlap)
            if k < len(b) and pieces[-1][0] < b[k] < end:
                start = b[k]
                break
        else:
            start = max(end - overlap, pieces[-1][0] + 1)


def _split(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for uid, level, text in zip(b["_uid"], b["_level"], b["_text"]):
                body = text.strip()
                lead = len(text) - len(text.lstrip())
                points = split_points(body, level, limit, overlap)
                for k, (s, e, kind) in enumerate(points):
                    rows.append((uid, k, len(points), s + lead, e + lead, 0 if k == 0 else points[k - 1][1] - s, kind, body[s:e]))
            yield pd.DataFrame(rows, columns=["_uid", "piece_no", "n_pieces", "start_char", "end_char", "overlap", "ends_at", "piece"])

    return run


def split_oversized(df: DataFrame, id_col: str = "chunk_uid", text_col: str = "text", level_col: str = "level", hierarchy_col: str = "hierarchy", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: id, piece_no, n_pieces, start_char, end_char, overlap, ends_at, piece.

    The level says which boundaries are natural; where a row has none, its place in the hierarchy does. The text without white space at both ends is what must fit. Short texts never leave the JVM. A null text
    gives no row, a blank one a single empty piece; rows repeated with the same id and text count once.
    Offsets are code points in the text as stored. Columns other than those named are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and below the limit")
    level = F.col(level_col).cast("string") if level_col in df.columns else F.lit(None).cast("string")
    if hierarchy_col in df.columns and "level" in getattr(df.schema[hierarchy_col].dataType, "names", []):
        level = F.coalesce(level, F.col(f"{hierarchy_col}.level"))
    src = df.select(F.col(id_col).alias("_uid"), level.alias("_level"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    big = src.where(F.length("_text") > limit).groupBy("_uid", "_text").agg(F.max("_level").alias("_level"))
    kind = src.schema["_uid"].dataType.simpleString()
    schema = f"_uid {kind}, piece_no int, n_pieces int, start_char int, end_char int, overlap int, ends_at string, piece string"
    cut = big.select("_uid", "_level", "_text").mapInPandas(_split(limit, overlap), schema)
    body = F.regexp_replace("_text", r"(?U)^\s+|\s+$", "")
    lead = F.length("_text") - F.length(F.regexp_replace("_text", r"(?U)^\s+", ""))
    whole = src.where(F.length("_text") <= limit).select("_uid", "_text").distinct()
    whole = whole.select("_uid", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.when(body == "", 0).otherwise(lead).alias("start_char"), (F.when(body == "", 0).otherwise(lead) + F.length(body)).alias("end_char"), F.lit(0).alias("overlap"), F.lit("end").alias("ends_at"), body.alias("piece"))
    return cut.unionByName(whole).withColumnRenamed("_uid", id_col)
