"""Mixing sources to target weights, no source beyond its largest number of epochs.

Every source gets its weight's share of a budget of words. A source whose share is above its
cap (``EPOCHS`` times its words) is clamped there, and what it leaves is shared again by the
weights of the others, until no source is above its cap. Each round is one aggregate over the
table of sources: with the clamped ones out, all others stand at weight times one level, so the
level is all that a round has to find, and it only rises.

A source whose target is 1.4 times its words gives each of its documents once as a whole and
then 0.4 of its words: documents in a seeded order, the last of them in part. The order is that
of a hash of seed, id and text. Words are summed by the first digits of the hash, so where the
order is cut is known without sorting a source; only documents with those digits are ordered.

Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import stored

#: A source gives at most this many times its words.
EPOCHS = 2
#: Words of the mix as a share of all words.
PERCENT = 150
#: Weights of the sources in order of their names, repeated.
WEIGHTS = (3, 1, 2)
SEED = "mix-1"

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the order that one step of the search for the cut reads.
DIGITS = 3


def word_count(text: str = "text") -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(seed: str) -> Column:
    """A document's place in its source's order. Rows that repeat an id and a text are ties."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                          F.lit("|"), F.coalesce("text", F.lit(""))))


def numbered(sources: DataFrame, column: str = "source") -> DataFrame:
    """(column, nth): the distinct values numbered from 0 by code point, null last. Ranges are
    numbered by themselves; only the ranges' sizes are summed up in one place."""
    last = F.col(column).isNull()
    ranged = sources.select(column).distinct().repartitionByRange(last, column) \
        .withColumn("_range", F.spark_partition_id())
    ranged = stored(ranged, "sources")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("_range").orderBy(last, column)
    return ranged.withColumn("place", F.row_number().over(inside) - 1).join(sizes, "_range") \
        .select(column, (F.col("before") + F.col("place")).alias("nth"))


def weighted(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, weight) with the weights dealt out in turn."""
    turn = F.pmod("nth", F.lit(len(weights))).cast("int")
    return numbered(sources).select(
        "source", F.get(F.array(*map(F.lit, weights)), turn).cast("bigint").alias("weight"))


def water_level(sources: DataFrame, budget: float, epochs: int = EPOCHS) -> float:
    """The level at which min(level * weight, epochs * source_size) sums up to the budget.
    Infinite when all sources together cannot reach it, and all of them give their caps."""
    cap = F.col("source_size") * epochs
    level = 0.0
    while True:
        above = F.lit(level) * F.col("weight") > cap
        full, free = sources.agg(F.sum(F.when(above, cap)),
                                 F.sum(F.when(~above, F.col("weight")))).first()
        if not free:
            return float("inf") if budget > (full or 0) else level
        now = (budget - (full or 0)) / free
        if now <= level:
            return level
        level = now


def targets(sizes: DataFrame, weights: DataFrame, percent: int = PERCENT,
            epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from (source, size) of documents."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = totals.join(weights, totals.source.eqNullSafe(weights.source)) \
        .select(totals.source, "source_size", "weight")
    totals = stored(totals, "sources")
    words = totals.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(totals, words * percent / 100, epochs)
    cap = (F.col("source_size") * epochs).cast("double")
    return totals.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap))


def _before(*keys: str) -> Window:
    return Window.partitionBy("source", *keys[:-1]).orderBy(keys[-1]).rowsBetween(
        Window.unboundedPreceding, -1)


def _cut(rows: DataFrame, bounds: DataFrame, taken: str, digits: str, small: bool) -> DataFrame:
    """``bounds`` (source, rest) led on by one step: the digits at which ``rest`` words of the
    source are reached, and what is left of it there."""
    sums = rows.groupBy("source", digits).agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(_before(digits)), F.lit(0)))
    found = sums.alias("s").join(F.broadcast(bounds.alias("b")) if small else bounds.alias("b"),
                                 F.expr("s.source <=> b.source AND s.before < b.rest"
                                        " AND s.before + s.words >= b.rest"))
    return found.select("s.source", F.col(f"s.{digits}").alias(taken),
                        (F.col("b.rest") - F.col("s.before")).alias("rest"))


def mix(docs: DataFrame, weights: DataFrame | None = None, percent: int = PERCENT,
        epochs: int = EPOCHS, seed: str = SEED, broadcast_rows: int = 100_000) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, repeats, part) of every row: the mix
    holds the document ``repeats`` times as a whole and once its first ``part`` words, together
    ``taken`` words.

    ``weights`` is (source, weight), whole numbers above 0; sources that it lacks take no part.
    By default weights are dealt out to the sources in order. A source's ``taken`` sums up to
    its target rounded to a whole number. Null texts have no words; a null source is a source;
    rows that repeat an id are rows of their own, and if text and size agree too they are ties
    that any of them may win. No words give targets of 0, no rows no rows.
    """
    rows = docs.select("doc_id", "source", word_count().alias("size"), draw(seed).alias("_draw"))
    rows = stored(rows, "sizes")
    plan = targets(rows, weights if weights is not None else weighted(rows), percent, epochs)
    plan = plan.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0,
               F.expr("floor(target + 0.5) DIV source_size")).otherwise(0).alias("repeats"),
        F.when(F.col("source_size") > 0,
               F.expr("floor(target + 0.5) % source_size")).otherwise(0).alias("rest"))
    plan = stored(plan, "plan")
    small = plan.limit(broadcast_rows + 1).count() <= broadcast_rows

    # Where each source's order is cut: by the first digits, then by the next among those.
    first, second = (F.substring("_draw", 1 + i * DIGITS, DIGITS) for i in range(2))
    rows = rows.withColumns({"_d1": first, "_d2": second})
    at1 = stored(_cut(rows, plan.filter("rest > 0").select("source", "rest"), "_c1", "_d1", small),
                 "cuts")

    def met(left, right, also=""):
        right = F.broadcast(right) if small else right
        return left.alias("r").join(right.alias("c"), F.expr(f"r.source <=> c.source{also}"))

    among = met(rows, at1, " AND r._d1 = c._c1").select("r.*")
    at2 = stored(_cut(among, at1.select("source", "rest"), "_c2", "_d2", small), "cuts")
    both = at1.select("source", "_c1").join(
        at2.withColumnRenamed("source", "_s"), F.expr("source <=> _s")).drop("_s")

    left = (F.broadcast(plan) if small else plan).alias("p")
    out = rows.alias("r").join(left, F.expr("r.source <=> p.source")).select(
        "r.*", "p.source_size", "p.target", "p.repeats")
    out = out.alias("r").join((F.broadcast(both) if small else both).alias("c"),
                              F.expr("r.source <=> c.source"), "left") \
        .select("r.*", "_c1", "_c2", "rest")
    place, cut = F.concat("_d1", "_d2"), F.concat("_c1", "_c2")
    here = out.filter(place == cut)
    order = Window.partitionBy("source").orderBy("_draw", "doc_id").rowsBetween(
        Window.unboundedPreceding, -1)
    here = here.withColumn("part", F.greatest(F.lit(0), F.least(
        "size", F.col("rest") - F.coalesce(F.sum("size").over(order), F.lit(0)))))
    others = out.filter(cut.isNull() | (place != cut)).withColumn(
        "part", F.when(place < cut, F.col("size")).otherwise(0))
    return others.unionByName(here).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("repeats") * F.col("size") + F.col("part")).cast("bigint").alias("taken"),
        "repeats", F.col("part").cast("bigint").alias("part"))


def expand(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """(doc_id, copy, text): the mix's texts, whole ones numbered from 1 and then the part, its
    words joined by single blanks. ``docs`` and ``mixed`` go by doc_id, unique and not null."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    part = F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), " ")
    takes = F.concat(F.array_repeat("text", F.col("repeats").cast("int")),
                     F.when(F.col("part") > 0, F.array(part)).otherwise(F.array()))
    joined = docs.select("doc_id", "text").join(
        mixed.filter("taken > 0").select("doc_id", "repeats", "part"), "doc_id")
    return joined.select("doc_id", F.posexplode(takes).alias("copy", "text")) \
        .withColumn("copy", F.col("copy") + 1)


#: The same mix in one statement, for sources of one machine.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS draw
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS k FROM sources),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources) * 150 / 100
             - coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING
                                                   AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM filled),
planned AS (
  SELECT source, source_size,
         least(weight * (SELECT min_by(level, k) FROM levels WHERE level * weight <= 2 * source_size),
               CAST(2 * source_size AS DOUBLE)) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target,
         CAST(floor(p.target + 0.5) AS BIGINT) AS wanted,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE
         wanted // source_size * size + greatest(0, least(size, wanted % source_size - before)) END
         AS BIGINT) AS taken
FROM placed
"""
