"""Mixing sources to target weights by systematic sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, limit: int = 2) -> DataFrame:
    """Share ``budget`` x all sizes among sources by weight, none above ``limit`` x its own size.

    ``sizes``: one row per source (``source``, ``source_size``). Sources by code point, null last,
    take the weights in turn. Sources fill up in the order of limit / weight; before each one the
    common level is (what is left) / (weights left), and the first source that stays below its
    limit at that level fixes the level for itself and all after it.
    """
    by_name, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    full = F.col("source_size") * limit
    before = Window.orderBy(full / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_rows) * F.lit(budget) - F.coalesce(F.sum(full).over(before), F.lit(0))
    level = left / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    return (
        sizes.withColumn("w", w)
        .withColumn("level", level)
        .withColumn("below", full / F.col("w") > F.col("level"))
        .withColumn("fixed", F.max(F.when(F.col("below"), F.col("level"))).over(all_rows))
        .select("source", "source_size", F.when(F.col("below"), F.col("w") * F.col("fixed")).otherwise(full.cast("double")).alias("target"))
    )


def systematic_mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, limit: int = 2, salts: int = 32) -> DataFrame:
    """Copies of each document so that every source comes near its target.

    Adds ``size`` (words), ``source_size``, ``target``, ``copies`` and ``taken`` (copies x size).
    Every document of a source expects target / source_size copies; their prefix sum within the
    source, plus one offset drawn from ``seed`` and the source's name, gives a copy at each integer
    it crosses. Documents stand in the order of (root of size, salt, size, doc_id), so each stretch
    of sizes gets its share. The prefix sum is rank x rate, and the rank is taken in pieces
    (source, root, salt) with the pieces' counts summed aside: a hot source is many tasks.

    Null or empty text: size 0, taken 0. Null sources form one source, the last. Repeated rows
    count each; ties in every ordering column are equal rows. An empty table gives an empty result.
    Columns of the same names as the added ones are replaced; other columns pass through.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    piece = ["source", "_root", "_salt"]
    sized = (
        docs.select(*[c for c in docs.columns if c not in added])
        .withColumn("size", word_count(F.col("text")))
        .withColumn("_root", F.floor(F.sqrt(F.col("size").cast("double"))))
        .withColumn("_salt", F.coalesce(F.pmod(F.col("doc_id"), F.lit(salts)), F.lit(-1)))
    )
    pieces = sized.groupBy(*piece).agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_s"))
    targets = source_targets(pieces.groupBy("source").agg(F.sum("_s").alias("source_size")), weights, budget, limit)
    earlier = Window.partitionBy("source").orderBy("_root", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("")))), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
    pieces = (
        pieces.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_u", offset)
        .alias("p")
        .join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
        .select(*[F.col(f"p.{c}").alias(f"{c}_p") for c in piece], "_before", "source_size", "target", "_u")
    )
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(*piece).orderBy("size", "doc_id"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor(rate * F.col("_rank") + F.col("_u")) - F.floor(rate * (F.col("_rank") - 1) + F.col("_u"))
    keep = [c for c in docs.columns if c not in added]
    return (
        sized.join(pieces, F.col("source").eqNullSafe(F.col("source_p")) & (F.col("_root") == F.col("_root_p")) & (F.col("_salt") == F.col("_salt_p")))
        .withColumn("_rank", rank)
        .withColumn("copies", crossed.cast("long"))
        .select(*keep, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def emit_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row per copy; documents without a copy go."""
    return mixed.where("copies > 0").withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY floor(sqrt(size::DOUBLE)), coalesce(((doc_id % 32) + 32) % 32, -1), size, doc_id NULLS FIRST) AS r FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM weighed WINDOW b AS (ORDER BY source_size * 2 / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), fixed AS (
  SELECT *, source_size * 2 / w::DOUBLE > level AS below, max(CASE WHEN source_size * 2 / w::DOUBLE > level THEN level END) OVER () AS f FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN below THEN w * f ELSE (source_size * 2)::DOUBLE END AS target,
         ('0x' || substr(md5('17:' || coalesce(source, '')), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS u FROM fixed
), crossed AS (
  SELECT r.*, t.source_size, t.target, (CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END) AS rate, u
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
"""

OP8_SQL = (
    MIX_SQL.format(docs="documents")
    + "SELECT doc_id, size, source_size, target, ((floor(rate * r + u) - floor(rate * (r - 1) + u))::BIGINT * size)::BIGINT AS taken FROM crossed"
)
