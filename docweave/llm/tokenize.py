"""Token ids of a whole corpus by a public byte-level tokenizer, each shared stretch of text encoded once.

Texts are cut where a rolling hash over their characters says so, so equal stretches are cut alike wherever
they stand. Each distinct stretch is encoded once and joined back to its places. At every seam the last
pieces before it and the first pieces behind it are decoded and encoded again together, over a widening
stretch, until a piece boundary of the new encoding falls on one of the stored encoding; from there on both agree.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: A cut follows a character where the hash of the WINDOW characters up to it has its low MASK_BITS bits unset.
WINDOW, MASK_BITS, LEAST, MOST = 16, 8, 64, 4096
#: Pieces at the end of a stretch whose boundaries the next stretch may move ("'" + "ll" needs two; one is spare).
TAIL = 3
#: Pieces at the head of a stretch that are kept with their lengths for finding agreement.
HEAD = 12
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def cuts(text: str) -> list[int]:
    """Ends of the stretches of ``text``, chosen by its content alone; the last is its length."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    code = (code + np.uint64(1)) * _MIX
    code ^= code >> np.uint64(29)
    powers = np.full(WINDOW, _ODD, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)[::-1]
    rolled = np.zeros(n - WINDOW + 1, dtype=np.uint64)
    for k in range(WINDOW):
        rolled += code[k : n - WINDOW + 1 + k] * powers[k]
    rolled ^= rolled >> np.uint64(32)
    marks = np.flatnonzero((rolled & np.uint64((1 << MASK_BITS) - 1)) == 0) + WINDOW
    ends, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST or m == n:
            if m > last:
                ends.append(m)
            last = m
    return ends


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_padding()
    t.no_truncation()
    return t


def _pieces(enc, most: int | None = None) -> tuple[list[int], list[int]]:
    """Of each piece (a match of the splitting pattern): how many ids it ends at, and the character it ends at."""
    words, n = enc.word_ids, len(enc.ids)
    ends = [i for i in range(1, n) if words[i] != words[i - 1]]
    ends.append(n)
    return ends, [enc.token_to_chars(i - 1)[1] for i in (ends if most is None else ends[:most])]


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    for b in batches:
        ids, ords, hashes, texts = [], [], [], []
        for i, t in zip(b["_id"], b["_text"]):
            start = 0
            for k, end in enumerate(cuts(t)):
                s = t[start:end]
                ids.append(i)
                ords.append(k)
                hashes.append(xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass")))
                texts.append(s)
                start = end
        yield pd.DataFrame({"_id": ids, "_ord": np.array(ords, dtype=np.int32), "_hash": hashes, "_piece": texts})


def _encoder(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _tokenizer(path)
        for b in batches:
            ids, heads, head_chars, tails = [], [], [], []
            for e in tok.encode_batch(b["_piece"].tolist(), add_special_tokens=False):
                ends, chars = _pieces(e, HEAD)
                ids.append(e.ids)
                heads.append(ends[:HEAD])
                head_chars.append(chars)
                tails.append(len(e.ids) - (ends[-TAIL - 1] if len(ends) > TAIL else 0))
            yield pd.DataFrame({"_hash": b["_hash"], "_ids": ids, "_head": heads, "_chars": head_chars, "_tail": np.array(tails, dtype=np.int32)})

    return run


def join_encodings(tok, parts: list[tuple]) -> list[int]:
    """The ids of the joined text from the encodings of its stretches, each (ids, head ends, head characters, tail)."""
    out, tail = list(parts[0][0]), parts[0][3]
    for ids, head, chars, own_tail in parts[1:]:
        at = len(out) - tail
        left = tok.decode(out[at:], skip_special_tokens=False)
        known = dict(zip((len(left) + c for c in chars), head))
        upto = head[-1]
        again = tok.encode(left + tok.decode(ids[:upto], skip_special_tokens=False), add_special_tokens=False)
        ends, marks = _pieces(again)
        # the last TAIL pieces of the window may still change with what follows, unless nothing is left out
        trusted = len(ends) if upto == len(ids) else len(ends) - TAIL
        found = next((k for k in range(trusted) if marks[k] in known and len(ids) - known[marks[k]] >= own_tail), None)
        if found is not None:
            del out[at:]
            out += again.ids[: ends[found]]
            out += ids[known[marks[found]] :]
            tail = own_tail
        else:
            again = tok.encode(left + tok.decode(ids, skip_special_tokens=False), add_special_tokens=False)
            ends, _ = _pieces(again)
            del out[at:]
            out += again.ids
            tail = len(again.ids) - (ends[-TAIL - 1] if len(ends) > TAIL else 0)
    return out


def _joiner(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _tokenizer(path)
        for b in batches:
            out = []
            for parts in b["_parts"]:
                parts = sorted(parts, key=lambda p: p["_ord"])
                out.append(join_encodings(tok, [(np.asarray(p["_ids"]).tolist(), np.asarray(p["_head"]).tolist(), np.asarray(p["_chars"]).tolist(), int(p["_tail"])) for p in parts]))
            yield pd.DataFrame({"_id": b["_id"], "_n": b["_n"], "_out": out})

    return run


def encode_corpus(df: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``id_col`` and the list of token ids of ``text_col``, as if each text had been encoded as a whole.

    A null or empty text gives an empty list; a null id or a repeated id keeps its row. ``tokenizer_file`` must
    be readable under this path on every executor. Other columns are ignored, whatever their names.
    A stretch that occurs in a third of all rows is encoded once; the join that spreads it is split by
    adaptive execution, and its partial aggregation happens before the shuffle.
    """
    src = df.select(F.col(id_col).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # rows are told apart by a digest of id and text: repeated ids with other texts stay apart, repeated rows are counted
    row = F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("_key").cast("string"), F.lit("\x00")), F.col("_text")), 256)
    full = src.where(F.length("_text") > 0).select(F.struct(row.alias("d"), F.col("_key").alias("k")).alias("_id"), "_text")
    flat = full.select(F.to_json("_id").alias("_id"), "_text")
    schema = "_id string, _ord int, _hash binary, _piece string"
    # texts are cut once and hold their stretches by hash; the few bytes beside each stretch are what is read twice
    pieces = materialize(flat.mapInPandas(_stretches, schema), "token-stretches")
    coded = pieces.groupBy("_hash").agg(F.first("_piece").alias("_piece"))
    coded = coded.mapInPandas(_encoder(tokenizer_file), "_hash binary, _ids array<int>, _head array<int>, _chars array<int>, _tail int")
    places = pieces.groupBy("_id", "_ord", "_hash").agg(F.count(F.lit(1)).alias("_n"))
    parts = places.join(coded, "_hash").groupBy("_id").agg(F.max("_n").alias("_n"), F.collect_list(F.struct("_ord", "_ids", "_head", "_chars", "_tail")).alias("_parts"))
    joined = parts.mapInPandas(_joiner(tokenizer_file), "_id string, _n bigint, _out array<int>")
    key = F.from_json("_id", full.schema["_id"].dataType)["k"]
    joined = joined.select(key.alias(id_col), F.col("_out").alias(out_col), F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")).alias("_copy")).drop("_copy")
    empty = src.where(F.length("_text") == 0).select(F.col("_key").alias(id_col), F.array().cast("array<int>").alias(out_col))
    return joined.unionByName(empty)


def decode_corpus(df: DataFrame, tokenizer_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and the text that each list of ids stands for; an empty or null list gives an empty text, repeated rows stay repeated."""
    src = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("_ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _tokenizer(tokenizer_file)
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "text": tok.decode_batch([np.asarray(i).tolist() for i in b["_ids"]], skip_special_tokens=False)})

    return src.mapInPandas(run, f"_id {src.schema['_id'].dataType.simpleString()}, text string").withColumnRenamed("_id", id_col)
