"""Host-level quality rules.

1. Per document (one pass over whole texts): counts, and which rules it fails.
2. Per host: documents and failures, summed map-side before the shuffle. The
   hosts' failure rates give an empirical Beta prior by the method of moments
   (of a beta-binomial, hosts being of different sizes); a host's rate is shrunk to (failures + alpha) / (documents + alpha + beta).
3. Hosts whose shrunk rate is over ``host_limit`` are rejected, and their verdict
   is joined back to the documents. A host's verdict is repeated ``salts`` times
   and the documents are dealt over the copies, so a hot host is many tasks.

A document is kept if it fails no rule and its host isn't rejected.

Defined results: a null or empty text has no words, so it fails; documents with a
null host form one host; repeated rows count one by one; an empty table gives no
row; columns besides ``doc_id``, ``text`` and the host column are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.llm import common

SPACE = " \t\n\v\f\r"       # what separates words
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter"]
STEP = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(words: list[bytes], width: int = 8) -> int:
    """Words inside a run of ``width`` words that the text has twice or more. Runs
    are compared by 64-bit hashes within their text."""
    if len(words) <= width:
        return 0
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    run = np.zeros(n, np.uint64)
    for k in range(width):
        run = run * STEP + one[k:k + n]
    order = np.sort(run)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(again):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.isin(run, again))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def text_counts(text: str | None) -> tuple[int, ...]:
    """The values named in COUNTS."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeat_words(words), len(lines),
            sum(map(bytes.__eq__, words[1:], words)))


def document_counts(docs: DataFrame, host: str) -> DataFrame:
    """(doc_id, host, *COUNTS) of every document."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [text_counts(t.as_py()) for t in batch.column(2)]
            cols = list(zip(*counts)) or [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols)],
                                             names=["doc_id", "host", *COUNTS])

    return docs.select("doc_id", F.col(host).cast("string").alias("host"), "text").mapInArrow(
        run, "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))


def failed_rules() -> dict[str, str]:
    """Each rule's condition for failing, over COUNTS; whole numbers only."""
    return {
        "base_failed": "n_words < 20 or 100 * n_repeat_words > 30 * n_words",
        "symbols_failed": "10 * n_symbols > n_words",
        "lines_failed": "2 * n_dup_lines > n_lines",
        "stutter_failed": "10 * n_stutter > 3 * n_words",
        "word_length_failed": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    }


def host_totals(scored: DataFrame) -> DataFrame:
    """(host, host_docs, host_failed) from documents with ``host`` and ``failed``."""
    return scored.groupBy("host").agg(F.count("*").alias("host_docs"),
                                      F.sum(F.col("failed").cast("long")).alias("host_failed"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean m and weight alpha + beta of the hosts' Beta prior, by the moments of a
    beta-binomial: the rates' mean square from m is v (1 - h) + m (1 - m) h, where v is
    the prior's variance and h the mean of 1 / documents, so a small host's chance
    doesn't count as spread. The weight is m (1 - m) / v - 1, held between 1 and 1e6
    (all hosts alike, or no host of two documents to tell)."""
    rate = F.col("host_failed") / F.col("host_docs")
    m, s, h = hosts.agg(F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("host_docs"))).first()
    if m is None:
        return 0.0, 1.0
    v = (s - m * (1 - m) * h) / (1 - h) if h < 1 else 0.0
    return m, min(max(m * (1 - m) / v - 1, 1.0), 1e6) if v > 1e-12 else 1e6


def host_verdicts(hosts: DataFrame, host_limit: float) -> DataFrame:
    """Adds ``host_rate``, shrunk towards the prior, and ``host_rejected``."""
    m, weight = beta_prior(hosts)
    shrunk = (F.col("host_failed") + F.lit(m * weight)) / (F.col("host_docs") + F.lit(weight))
    return hosts.select("*", shrunk.alias("host_rate"), (shrunk > F.lit(host_limit)).alias("host_rejected"))


def quality_rules(docs: DataFrame, host: str = "source", host_limit: float = 0.5, salts: int = 32) -> DataFrame:
    """Counts, failed rules, the host's rate and verdict, and ``kept``, per document."""
    rules = failed_rules()
    scored = document_counts(docs, host).withColumns({k: F.expr(v) for k, v in rules.items()})
    scored = common.saved(scored.withColumn("failed", F.expr(" or ".join(rules))), "quality")
    hosts = host_verdicts(common.saved(host_totals(scored), "hosts"), host_limit)
    copies = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(salts)).cast("int"))
    joined = left.alias("d").join(copies.alias("h"), (F.col("d.salt") == F.col("h.salt"))
                                  & F.col("d.host").eqNullSafe(F.col("h.host")))
    return joined.select("d.doc_id", "d.host", *COUNTS, *rules, "host_docs", "host_failed", "host_rate", "host_rejected",
                         (~F.col("failed") & ~F.col("host_rejected")).alias("kept"))
