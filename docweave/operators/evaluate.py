"""Grounded metrics of summaries against their sources, and decisions on them.

Summaries are rows (id, summary, query); sources rows (id, source_id, text, group). Words, sentences and named-like tokens are made once
per text by Column functions; overlaps are sizes of array intersections. Nothing leaves the JVM but the longest common subsequence.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: A sentence is supported from this share of its words on; thresholds of the gate; lengths that draw a warning.
SUPPORTED, LEAST_OVERLAP, LEAST_ROUGE_L, SHORT, LONG = 0.5, 0.30, 0.15, 40, 400


def _share(part, whole):
    return F.when(F.size(whole) > 0, F.size(F.array_intersect(whole, part)) / F.size(whole))


def joined_sources(sources: DataFrame) -> DataFrame:
    """(id, source): the texts of a summary's sources in order, a summary's own and so bounded."""
    s = sources.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("source_id", "text"))).alias("_s"))
    return s.select("id", F.array_join(F.transform("_s", lambda x: x["text"]), " ").alias("source"))


def overlap_metrics(summaries: DataFrame, sources: DataFrame) -> DataFrame:
    """Per summary: lexical overlap, consistency of named-like words and of numbers and dates, relevance to the query, coverage of it.

    A summary without names or numbers is consistent; without a query, the first 20 source words in order stand for it.
    """
    r = summaries.join(joined_sources(sources), "id").select(
        "id", T.word_count(F.col("summary")).alias("n_words"), T.vocabulary(F.col("summary")).alias("_v"), T.vocabulary(F.col("source")).alias("_sv"), T.named_like(F.col("summary")).alias("_e"), T.named_like(F.col("source")).alias("_se"),
        T.numbers_and_dates(F.col("summary")).alias("_n"), T.numbers_and_dates(F.col("source")).alias("_sn"), T.metric_tokens(F.col("summary")).alias("_w"), T.metric_tokens(F.col("query")).alias("_q"), T.vocabulary(F.col("query")).alias("_qv"),
    )
    target = F.when(F.size("_qv") > 0, F.col("_qv")).otherwise(F.slice(F.array_sort("_sv"), 1, 20))
    return r.select(
        "id", "n_words", F.coalesce(_share(F.col("_sv"), F.col("_v")), F.lit(0.0)).alias("lexical_overlap"), F.coalesce(_share(F.col("_se"), F.col("_e")), F.lit(1.0)).alias("entity_consistency"),
        F.coalesce(_share(F.col("_sn"), F.col("_n")), F.lit(1.0)).alias("number_date_consistency"), _share(F.col("_w"), F.col("_q")).alias("query_relevance"), F.coalesce(_share(F.col("_v"), target), F.lit(1.0)).alias("qa_coverage"),
    )


def sentence_citations(summaries: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, sentence_index, source_id, score, citation_score): the source that shares most of each sentence's words, ties to the smaller id,
    and the best share of a source that has an id, for only such a source can be cited."""
    s = summaries.select("id", F.posexplode(T.sentences(F.col("summary"))).alias("sentence_index", "_t")).select("id", "sentence_index", T.metric_tokens(F.col("_t")).alias("_w"))
    b = sources.select("id", "source_id", T.metric_tokens(F.col("text")).alias("_s"))
    score = F.coalesce(_share(F.col("_s"), F.col("_w")), F.lit(0.0))
    best = s.join(b, "id").groupBy("id", "sentence_index").agg(F.min(F.struct((-score).alias("s"), F.col("source_id").isNull().alias("n"), "source_id")).alias("_b"), F.max(F.when(F.col("source_id").isNotNull(), score)).alias("citation_score"))
    return best.select("id", F.col("sentence_index").cast("bigint").alias("sentence_index"), F.col("_b.source_id").alias("source_id"), (-F.col("_b.s")).alias("score"), "citation_score")


def sentence_support(summaries: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, sentence_index, source_id, score): the source that shares most of each sentence's words, ties to the smaller id."""
    return sentence_citations(summaries, sources).drop("citation_score")


def support_metrics(support: DataFrame) -> DataFrame:
    """Per summary: share of supported sentences, sources cited, and of ``sentence_citations`` also the share of sentences that can be traced
    to a source with an id, null where none can."""
    ok = F.col("score") >= SUPPORTED
    more = []
    if "citation_score" in support.columns:
        cited = F.count_if(F.col("citation_score") >= SUPPORTED)
        more = [F.when(cited > 0, cited / F.count(F.lit(1))).alias("citation_coverage")]
    return support.groupBy("id").agg(F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("sentence_support"), F.countDistinct(F.when(ok, F.col("source_id"))).alias("n_cited"), *more)


def redundancy(summaries: DataFrame) -> DataFrame:
    """(id, redundancy): 1 less the largest Jaccard similarity of two sentences of a summary; 1 where there are fewer than two."""
    s = summaries.select("id", F.transform(T.sentences(F.col("summary")), T.metric_tokens).alias("_s"))
    later = lambda x, i: F.aggregate(F.slice("_s", i + 2, F.greatest(F.size("_s") - i - 1, F.lit(0))), F.lit(0.0), lambda m, y: F.greatest(m, F.when(F.size(F.array_union(x, y)) > 0, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)))
    most = F.aggregate(F.transform("_s", later), F.lit(0.0), lambda m, y: F.greatest(m, y))
    return s.select("id", (F.lit(1.0) - most).alias("redundancy"))


def evidence_diversity(sources: DataFrame) -> DataFrame:
    """(id, diversity): distinct groups by sources, 1 for a single source, null where no source has a group."""
    g = sources.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("group").alias("g"))
    return g.select("id", F.when(F.col("g") == 0, None).when(F.col("n") == 1, 1.0).otherwise(F.col("g") / F.col("n")).alias("diversity"))


def _ngrams(c, n: int):
    w = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)
    return w if n == 1 else F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))


def rouge_n(pairs: DataFrame, n: int) -> DataFrame:
    """(id, f) of candidate against reference: clipped matches of n-grams, harmonic mean of precision and recall."""
    side = lambda c: pairs.where(F.size(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)) >= n).select("id", F.explode(_ngrams(F.col(c), n)).alias("g")).groupBy("id", "g").agg(F.count(F.lit(1)).alias("n"))
    a, b = side("candidate"), side("reference")
    both = a.join(b.withColumnRenamed("n", "m"), ["id", "g"]).groupBy("id").agg(F.sum(F.least("n", "m")).alias("hit"))
    na, nb = a.groupBy("id").agg(F.sum("n").alias("na")), b.groupBy("id").agg(F.sum("n").alias("nb"))
    r = pairs.select("id").join(both, "id", "left").join(na, "id", "left").join(nb, "id", "left")
    return r.select("id", F.when(F.col("hit") > 0, F.lit(2.0) * F.col("hit") / (F.col("na") + F.col("nb"))).otherwise(0.0).alias("f"))


def lcs_length(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return row[-1]


def rouge_l(pairs: DataFrame) -> DataFrame:
    """(id, f) by the longest common subsequence of words."""
    import re

    def run(batches):
        for b in batches:
            out = []
            for x, y in zip(b["candidate"], b["reference"]):
                x, y = (re.findall("[a-z0-9]+", (t or "").lower()) for t in (x, y))
                n = lcs_length(x, y) if x and y else 0
                out.append(2.0 * n / (len(x) + len(y)) if n else 0.0)
            yield pd.DataFrame({"id": b["id"], "f": out})

    return pairs.select("id", "candidate", "reference").mapInPandas(run, f"id {pairs.schema['id'].dataType.simpleString()}, f double")


def gate_metrics(summaries: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per summary with every metric ``decide`` looks at; null where one cannot be had."""
    m = overlap_metrics(summaries, sources).join(support_metrics(sentence_citations(summaries, sources)), "id", "left")
    return m.join(redundancy(summaries), "id", "left").join(evidence_diversity(sources), "id", "left")


def decide(metrics: DataFrame) -> DataFrame:
    """Status and the step to take: what fails decides where to start again, a warning asks for review.

    Repeated sentences and sources of one group only warn; a metric that is null decides nothing.
    """
    low = lambda c, t: F.coalesce(F.col(c) < t, F.lit(False))
    ground = low("lexical_overlap", LEAST_OVERLAP) | low("qa_coverage", LEAST_OVERLAP) | low("query_relevance", LEAST_OVERLAP)
    prompt = low("entity_consistency", LEAST_OVERLAP) | low("number_date_consistency", 1.0) | low("sentence_support", LEAST_OVERLAP) | (low("citation_coverage", LEAST_OVERLAP) if "citation_coverage" in metrics.columns else F.lit(False))
    # against a reference text, what says too little of it is merged again
    merge = low("rouge_l", LEAST_ROUGE_L) if "rouge_l" in metrics.columns else F.lit(False)
    warn = (F.col("n_words") < SHORT) | (F.col("n_words") > LONG) | low("redundancy", LEAST_OVERLAP) | (low("diversity", 1.0) if "diversity" in metrics.columns else F.lit(False))
    status = F.when(ground | prompt | merge, "FAIL").when(warn, "WARN").otherwise("PASS")
    action = F.when(status == "PASS", "accept").when(status == "WARN", "review").when(ground, "retry_retrieval").when(prompt, "retry_prompt").otherwise("retry_reduce")
    return metrics.select("*", status.alias("status"), action.alias("action"))


def simple_decision(metrics: DataFrame, least_rouge_l: float = LEAST_ROUGE_L, least_bertscore: float = 0.80, least_overlap: float = LEAST_OVERLAP) -> DataFrame:
    """The metrics with ``passed`` and ``reason``: against a reference text by ``rouge_l`` and ``bertscore``, where those columns hold a value, else by lexical overlap."""
    low = lambda c, t: F.coalesce(F.col(c) < t, F.lit(False)) if c in metrics.columns else F.lit(False)
    against = F.lit(False)
    for c in ("rouge_l", "bertscore"):
        against = against | F.col(c).isNotNull() if c in metrics.columns else against
    faults = [(against & low("rouge_l", least_rouge_l), "ROUGE-L below threshold"), (against & low("bertscore", least_bertscore), "BERTScore F1 below threshold"), (~against & low("lexical_overlap", least_overlap), "Lexical overlap below threshold")]
    reason = F.concat_ws("; ", *[F.when(f, t) for f, t in faults])
    return metrics.select("*", (reason == "").alias("passed"), F.when(reason == "", "Quality check passed").otherwise(reason).alias("reason"))
