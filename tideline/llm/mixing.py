"""Operator 6: mix sources to target weights by hash-threshold histograms.

Every document hashes to 60 bits.  A source takes whole passes over its
documents while its target allows, and the rest of the target as the documents
whose hash lies under a threshold, so budgets nest: a larger budget only adds
documents.  The threshold is found from histograms of words by (source, hash
bucket): the bucket in which the running sum passes the budget is the boundary,
and only that bucket is counted again at the next finer level.  No document is
ever sorted; the only windows run over at most ``2**LEVEL_BITS`` buckets a
source and over the list of sources.

Everything is DataFrame operations.  A hot source is summed map-side, one row
for each bucket and task, before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, free_name, materialize, table, whole_text

HASH_BITS = 60
LEVEL_BITS = 12
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long")


def doc_hash(doc_id: Column, text: Column) -> Column:
    """The leading 60 bits of the id's MD5; where the id is null, of ``text:`` and the text."""
    named = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), text))
    return F.conv(F.substring(F.md5(named), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Targets are ``min(max_repeat * source_size, level * weight)``; the level is
    the one at which they sum to ``share`` of all words, which is where sharing
    an excess again and again by weight ends.  With the sources in the order in
    which a rising level reaches their caps, the level is
    ``(total - caps before) / (weights from here on)`` at the first source that
    it doesn't lift above its cap.  Sources are a dimension, so these windows
    see one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumns({
        "weight": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")),
        "cap": (max_repeat * F.col("source_size")).cast("double"),
        "total": share * F.sum("source_size").over(everything),
    })
    return (
        ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"])
        .select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))
    )


def thresholds(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``source, source_size, target, passes, cut`` from ``source, size, hash``.

    A document is taken ``passes`` times, and once more where ``hash < cut``.
    The last boundary holds documents of one hash value; they are in where that
    brings the source nearer to its target.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(
        source_targets(totals, weights, share, max_repeat).withColumn("passes", F.coalesce(F.least(F.lit(max_repeat), F.floor(F.try_divide("target", "source_size"))), F.lit(max_repeat)).cast("int")),
        "mix-targets",
    )
    bounds = targets.select(F.col("source").alias("s"), F.lit(0).cast("long").alias("prefix"), (F.col("target") - F.col("passes") * F.col("source_size")).alias("left"))
    for low in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        running = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bounds = (
            sized.join(bounds, sized["source"].eqNullSafe(bounds["s"]) & (F.shiftright("hash", low + LEVEL_BITS) == F.col("prefix")))
            .groupBy("s", "left", F.shiftright("hash", low).alias("bucket"))
            .agg(F.sum("size").alias("words"))
            .withColumn("upto", F.sum("words").over(running))
            .where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left")))
            .select("s", F.col("bucket").alias("prefix"), (F.col("left") - (F.col("upto") - F.col("words"))).alias("left"), "words")
        )
    cuts = bounds.select("s", F.when(F.col("words") - F.col("left") < F.col("left"), F.col("prefix") + 1).otherwise(F.col("prefix")).alias("cut"))
    return targets.join(cuts, targets["source"].eqNullSafe(cuts["s"]), "left").drop("s")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(whole_text(text_col)).alias("size"), doc_hash(F.col(id_col), whole_text(text_col)).alias("hash")
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies``, a row for each document.

    A null text has size 0; a null source is a source of its own, last in order;
    documents of one id are taken or left together, and so are those without an id
    that have one text; an empty table gives no rows.
    Other columns of ``docs`` are not read.
    """
    sized = materialize(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    cuts = materialize(thresholds(sized, **settings).withColumnRenamed("source", "of"), "mix-cuts")
    copies = F.col("passes") + F.when(F.col("hash") < F.col("cut"), 1).otherwise(0)
    return sized.join(cuts, sized["source"].eqNullSafe(cuts["of"])).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.cast("int").alias("copies")
    )


def repeat_to_mix(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (0 to 2 times), with the same columns.

    Nulls, ties and repeated rows count as in ``mix_sources``; an empty table stays empty.
    """
    sized = _sized(docs, "doc_id", "text", "source")
    cuts = materialize(thresholds(materialize(sized.drop("doc_id"), "mix-sizes"), **settings), "mix-cuts")
    of, passes, cut, copy = (free_name(docs, f"__{n}") for n in ("of", "passes", "cut", "copy"))
    cuts = cuts.select(F.col("source").alias(of), F.col("passes").alias(passes), F.col("cut").alias(cut))
    times = F.col(passes) + F.when(doc_hash(docs["doc_id"], whole_text()) < F.col(cut), 1).otherwise(0)
    return (
        docs.join(cuts, docs["source"].cast("string").eqNullSafe(cuts[of]))
        .withColumn(copy, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
        .select(*[docs[c] for c in docs.columns])
    )


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST(CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap,
         CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM ranked),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
lv AS (SELECT arg_min(level, (cap / weight, rank)) AS level FROM levels WHERE level * weight <= cap),
targets AS (
  SELECT source, source_size, least(cap, coalesce(lv.level * weight, cap)) AS target FROM levels, lv),
passed AS (
  SELECT *, CAST(CASE WHEN source_size = 0 THEN 2 ELSE least(2, floor(target / source_size)) END AS INTEGER) AS passes FROM targets),
running AS (
  SELECT s.source, s.h, sum(s.size) AS words, sum(sum(s.size)) OVER (PARTITION BY s.source ORDER BY s.h) AS upto FROM sized s GROUP BY s.source, s.h),
taken_hash AS (
  SELECT r.source, r.h, CASE WHEN r.upto <= p.target - p.passes * p.source_size
      OR (r.upto - r.words <= p.target - p.passes * p.source_size
          AND r.upto - (p.target - p.passes * p.source_size) < (p.target - p.passes * p.source_size) - (r.upto - r.words)) THEN 1 ELSE 0 END AS more
  FROM running r JOIN passed p ON r.source IS NOT DISTINCT FROM p.source)
SELECT s.doc_id, s.size, p.source_size, p.target, CAST(s.size * (p.passes + t.more) AS BIGINT) AS taken, CAST(p.passes + t.more AS INTEGER) AS copies
FROM sized s JOIN passed p ON s.source IS NOT DISTINCT FROM p.source
JOIN taken_hash t ON s.source IS NOT DISTINCT FROM t.source AND s.h = t.h
"""
