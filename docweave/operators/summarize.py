"""Prompts, extractive summaries where no model is plugged in, and their reduction in groups.

A model is a function from a prompt to a text; ``extractive_summaries`` is the default and needs none.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .evaluate import joined_sources

#: Limits of a prompt in tokens and characters, chunks of a prompt, size of a group.
TOKENS, RESERVED, CHUNK_CHARS, CHUNKS, GROUP = 4096, 400, 1200, 8, 4
#: Words of a document that have a row of bytes when its summaries are grouped; 255 at most, so that a byte holds their sum.
COMMON = 255
#: What a merging prompt asks for, by style.
REDUCE_STYLES = {"concise": "Merge the summaries into a few sentences.", "bullet": "Merge the summaries into a list of points.", "detailed": "Merge the summaries into full paragraphs."}


def section_prompts(chunks: DataFrame) -> DataFrame:
    """(document_id, section, n, prompt, fits): the longest chunks of each section, each cut to CHUNK_CHARS, and whether a model would take them.

    The limit of chunks is the prompt's own; the window keeps only that many rows per partition before the shuffle.
    """
    c = chunks.where("text is not null and hierarchy.section_id is not null and not coalesce(context_only, false)").select("document_id", F.col("hierarchy.section_id").alias("section"), "chunk_uid", "text").distinct()
    k = F.row_number().over(Window.partitionBy("document_id", "section").orderBy(F.desc(F.length("text")), "chunk_uid"))
    c = c.withColumn("_k", k).where(F.col("_k") <= CHUNKS)
    cut = F.when(F.length("text") > CHUNK_CHARS, F.concat(F.rtrim(F.substring("text", 1, CHUNK_CHARS)), F.lit(" ..."))).otherwise(F.col("text"))
    g = c.groupBy("document_id", "section").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("_k", cut.alias("t")))).alias("_t"), F.sum(F.least(F.length("text"), F.lit(CHUNK_CHARS + 4))).alias("_c"))
    return g.select("document_id", "section", "n", F.array_join(F.transform("_t", lambda x: x["t"]), "\n").alias("prompt"), (F.ceil(F.col("_c") / 3) <= TOKENS - RESERVED).alias("fits"))


def extractive_summaries(summaries: DataFrame, sources: DataFrame, k: int = 2) -> DataFrame:
    """(id, summary): the k source sentences that share most words with the query, in their order; ties to the earlier one."""
    s = joined_sources(sources).join(summaries.select("id", "query"), "id")
    q = T.metric_tokens(F.col("query"))
    parts = F.transform(T.sentences(F.col("source")), lambda t, i: F.struct((-F.size(F.array_intersect(T.metric_tokens(t), q))).alias("s"), i.alias("i"), t.alias("t")))
    best = F.array_sort(F.transform(F.slice(F.array_sort(parts), 1, k), lambda x: F.struct(x["i"], x["t"])))
    return s.select("id", F.array_join(F.transform(best, lambda x: x["t"]), " ").alias("summary"))


def group_similar(ids: list[str], words: Iterable[set], size: int = GROUP) -> list[list[int]]:
    """Groups of ``size`` around the smallest id left, of those nearest to it, ties to the smaller id.

    Texts that share words with the anchor are counted by the word: those of a common word by its row of bytes, those of others by
    its list. Where they do not fill the group, the smallest ids left do. The counts are made again each time half of the texts are grouped.
    """
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    code: dict[str, int] = {}
    coded = [np.fromiter((code.setdefault(w, len(code)) for w in x), dtype=np.int64, count=len(x)) for x in words]
    names, out = len(code), []
    del code
    while order:
        n = len(order)
        texts = [coded[i] for i in order]
        lengths = np.array([len(x) for x in texts])
        token, text = np.concatenate(texts), np.repeat(np.arange(n), lengths)
        held = np.bincount(token, minlength=names)
        # no more rows than a byte can count
        common = np.flatnonzero(held > max(n / 32, 1))
        common = common[np.argsort(-held[common], kind="stable")][:COMMON]
        row = np.full(names, -1)
        row[common] = np.arange(len(common))
        rows = np.zeros((len(common), n), dtype=np.uint8)
        often = row[token] >= 0
        rows[row[token[often]], text[often]] = 1
        rare = ~often & (held[token] > 1)
        by_word = np.argsort(token[rare], kind="stable")
        holders = text[rare][by_word]
        ends = np.cumsum(np.bincount(token[rare], minlength=names))
        # a text that is grouped gets no share of anything
        sizes, free, left = lengths.astype(np.float64), np.ones(n, dtype=bool), n
        bytes_, whole = np.empty(n, dtype=np.uint8), np.empty(n)
        for anchor in range(n):
            if not free[anchor]:
                continue
            if 2 * left <= n and n > 64:
                break
            mine = texts[anchor]
            free[anchor], sizes[anchor] = False, np.inf
            group, shared = [anchor], None
            if len(mine):
                at = row[mine]
                lists = [holders[ends[w - 1] if w else 0 : ends[w]] for w in mine[(at < 0) & (held[mine] > 1)].tolist()]
                shared = np.bincount(np.concatenate(lists), minlength=n) if lists else np.zeros(n, dtype=np.int64)
                bytes_.fill(0)
                for k in at[at >= 0].tolist():
                    np.add(bytes_, rows[k], out=bytes_)
                shared += bytes_
                np.add(sizes, len(mine), out=whole)
                np.subtract(whole, shared, out=whole)
                near = np.divide(shared, whole, out=whole)
                while len(group) < size:
                    i = int(near.argmax())
                    if near[i] <= 0:
                        break
                    group.append(i)
                    near[i], free[i], sizes[i] = 0.0, False, np.inf
            if len(group) < size and left > len(group):
                for i in np.flatnonzero(free)[: size - len(group)].tolist():
                    group.append(i)
                    free[i], sizes[i] = False, np.inf
            left -= len(group)
            out.append([order[i] for i in group])
        order = [i for i, x in zip(order, free) if x]
    return out


def _first_sentence(text: str) -> str:
    return text.split(". ")[0].rstrip(".") + "."


def _reduce(key, b):
    now, level, rows = dict(zip(b["id"], b["summary"])), 0, []
    if len(now) > GROUP:
        while len(now) > 1:
            level += 1
            ids = sorted(now)
            groups = group_similar(ids, (set(now[i].lower().split()) for i in ids))
            now = {ids[g[0]]: " ".join(_first_sentence(now[ids[k]]) for k in sorted(g)) for g in groups}
            rows.append((key[0], level, len(groups), None))
        final = next(iter(now.values()))
    else:
        # few summaries are merged at once, without rounds
        final = " ".join(_first_sentence(now[i]) for i in sorted(now)) if len(now) > 1 else next(iter(now.values()), None)
    return pd.DataFrame([*rows, (key[0], level + 1, 1, final)], columns=["document_id", "level", "n_groups", "final"])


def reduce_summaries(summaries: DataFrame) -> DataFrame:
    """(document_id, level, n_groups, final): the rounds by which a document's summaries become one; up to GROUP of them are merged at once."""
    return summaries.groupBy("document_id").applyInPandas(_reduce, "document_id string, level int, n_groups int, final string")


def reduce_prompts(summaries: DataFrame, styles: dict[str, str] | None = None) -> DataFrame:
    """(scope, style, n, prompt): the summaries (scope, community, summary) of a scope as blocks headed by their community, for each style of merging."""
    block = F.concat(F.lit("[Community "), "community", F.lit("]\n"), F.trim("summary"))
    g = summaries.where("trim(summary) <> ''").groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("community", block.alias("b")))).alias("_b"))
    style = F.explode(F.array(*[F.struct(F.lit(k).alias("style"), F.lit(v).alias("task")) for k, v in (styles or REDUCE_STYLES).items()])).alias("_s")
    return g.select("scope", "n", "_b", style).select("scope", F.col("_s.style").alias("style"), "n", F.concat("_s.task", F.lit("\n\n"), F.array_join(F.transform("_b", lambda x: x["b"]), "\n\n")).alias("prompt"))
