"""Line dedup by overlapping windows of three lines, with DataFrame functions only.

Every three consecutive lines of a text are a window, known by two 64-bit hashes.
A window that some document has earlier (smaller doc_id, or the same document and
an earlier line) is a later occurrence; the lines that later occurrences cover are
removed, once each where windows overlap. Windows without a word are no match, so
blank lines between paragraphs stay.

The first place of a window is a ``min``, combined map-side, so a window that a
third of all documents has is no hot group; the join that marks the later ones
takes only windows seen twice, and its shuffles can be split by Spark.

Defined results: texts of fewer than three lines have no window and stay; a null
text stays null, with 0 lines; null doc_ids come after all others; rows with the
same doc_id and text are one document, none of them later than another; an empty
table gives no row; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.llm import common

WIDTH = 3


def later_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, starts): per document, the first lines of its windows that
    are later occurrences. ``docs`` has doc_id, text_key and lines."""
    line = lambda k: F.expr(f"lines[i + {k}]")
    windows = (docs.filter(f"size(lines) >= {WIDTH}")
               .select("doc_id", "text_key", "lines", F.explode(F.expr(f"sequence(0, size(lines) - {WIDTH})")).alias("i"))
               .select("doc_id", "text_key", "i", *[line(k).alias(f"l{k}") for k in range(WIDTH)])
               .filter(F.concat(*[f"l{k}" for k in range(WIDTH)]).rlike(r"[^\x20\x09-\x0D]"))
               .select("doc_id", "text_key", "i", F.xxhash64("l0", "l1", "l2").alias("h1"),
                       F.xxhash64(F.lit("second"), "l2", "l1", "l0").alias("h2")))
    windows = common.saved(windows, "line-windows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "i").alias("place")
    firsts = (windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
              .filter("first < last"))
    firsts = common.saved(firsts.select("h1", "h2", "first"), "line-firsts")
    return (windows.join(firsts, ["h1", "h2"]).filter(F.col("first") < place)
            .groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("i")).alias("starts")))


def dedup_lines(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_lines, n_removed, text, *keep) with ``text`` as it is left; ``keep``
    names columns of ``docs`` to go along."""
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"),
                    F.struct(F.lit(None).cast("int").alias("none"), *keep).alias("others"))
    later = later_windows(d.select("doc_id", "text_key", F.split("text", "\n", -1).alias("lines")).filter("lines is not null"))
    cover = ", ".join(f"s + {k}" for k in range(WIDTH))
    d = (d.alias("d")
         .join(later.alias("r"), F.expr("d.doc_id <=> r.doc_id and d.text_key = r.text_key"), "left")
         .select("d.*", F.split("text", "\n", -1).alias("lines"),
                 F.expr(f"array_distinct(flatten(transform(starts, s -> array({cover}))))").alias("gone")))
    kept = "array_except(sequence(0, size(lines) - 1), gone)"
    return d.select("doc_id", F.expr("case when text is null then 0 else size(lines) end").cast("long").alias("n_lines"),
                    F.expr("case when gone is null then 0 else size(gone) end").cast("long").alias("n_removed"),
                    F.expr(f"case when gone is null then text else array_join(transform({kept}, i -> lines[i]), '\n') "
                           "end").alias("text"), *[F.col("others")[c].alias(c) for c in keep])
