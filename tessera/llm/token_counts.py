"""Token counts: an exact histogram of encoded lengths with suffix sums.

Documents are aggregated by encoded length before anything else, so what is
summed along the lengths is one row per different length.  Sums along the
lengths run in two levels (blocks of lengths, then within a block), so no
task holds the whole histogram.  From the sums at the largest length up to a
limit follow, for every context limit, the total, the truncated total and
the share of documents that fit.

Defined cases: null text counts as empty (length 0); ids are not used; no
documents give no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.common import id_and_text, ship, written

ship(__name__)

BLOCK = 1024


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """One row per input row: doc_id, n_tokens."""
    def work(frames):
        ranks = bpe.load_ranks(path)
        for frame in frames:
            n = [len(ids) for ids in bpe.encode_texts(frame["text"].tolist(), ranks)]
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "n_tokens": n})

    return id_and_text(docs).mapInPandas(work, "doc_id long, n_tokens long")


def length_histogram(counted: DataFrame) -> DataFrame:
    """One row per different length, taken as a context limit: n_tokens, n_docs, docs_fitting (this long at most),
    docs_longer, tokens_fitting, tokens_longer (totals of those documents), truncated_total (all documents cut to
    this length) and quantile (share of documents this long at most)."""
    sizes = written(counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")).select(
        "n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"),
        F.expr(f"n_tokens div {BLOCK}").alias("block")), "lengths")
    blocks = sizes.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    longer = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(longer), F.lit(0)).alias(f"{c}_after") for c in "dt"],
                           *[F.sum(c).over(every).alias(f"{c}_all") for c in "dt"])
    rest = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    summed = sizes.join(blocks, "block").withColumn(
        "docs_longer", F.col("d_after") + F.coalesce(F.sum("n_docs").over(rest), F.lit(0))).withColumn(
        "tokens_longer", F.col("t_after") + F.coalesce(F.sum("tokens").over(rest), F.lit(0)))
    fit, tok = F.col("d_all") - F.col("docs_longer"), F.col("t_all") - F.col("tokens_longer")
    return summed.select("n_tokens", "n_docs", fit.alias("docs_fitting"), "docs_longer", tok.alias("tokens_fitting"),
                         "tokens_longer", (tok + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_total"),
                         (fit / F.col("d_all")).alias("quantile"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """One row per given limit: limit, docs_fitting, truncated_total. Limits need not be lengths that occur."""
    totals = histogram.agg(*[F.struct(
        F.coalesce(F.sum(F.when(F.col("n_tokens") <= x, F.col("n_docs"))), F.lit(0)).alias("docs_fitting"),
        F.coalesce(F.sum(F.least("n_tokens", F.lit(x)) * F.col("n_docs")), F.lit(0)).alias("truncated_total")).alias(f"l{i}")
        for i, x in enumerate(limits)])
    return totals.select(F.explode(F.array(*[F.struct(F.lit(int(x)).cast("long").alias("limit"), f"l{i}.docs_fitting", f"l{i}.truncated_total")
                                             for i, x in enumerate(limits)])).alias("r")).select("r.*")


def quantile_length(histogram: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least this share of the documents does not exceed: one row, n_tokens."""
    return histogram.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))
