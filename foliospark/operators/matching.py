"""Which texts can match which, found by equal keys instead of by comparing all pairs.

Each rule of matching has keys that a matching pair shares: a gram for texts inside others, a
segment that stays in place for texts with few edits, three characters in order for texts that
run through others. Keys meet in equi-joins, and what they bring together is verified there, so
every function gives exactly the pairs (query, text) of its rule. A pair that shares several keys
comes several times; callers that put rules together take distinct pairs once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: Texts up to this length are keyed by three characters in order, longer ones by two.
IN_ORDER_CHARS = 24
_EPS = 1e-9


def _grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters; none in shorter texts."""
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(text) - (size - 1)),
        lambda i: text.substr(i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def within(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(query, text) of every text that contains the query; both sides distinct, not empty.

    A query of up to three characters is its own key; a longer one is looked up by the rarest
    of its trigrams, and not at all when one of them occurs nowhere.
    """
    query, text = F.col("query"), F.col("text")
    keys = queries.select("query", F.explode(F.when(
        F.length(query) <= GRAM, F.array(query)).otherwise(_grams(query, GRAM))).alias("gram"))
    wanted = keys.select("gram").distinct()
    postings = texts.select("text", F.explode(F.concat(*(
        _grams(text, n) for n in range(1, GRAM + 1)))).alias("gram")).join(
        wanted, "gram", "left_semi")
    sizes = postings.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = keys.join(sizes, "gram", "left").groupBy("query").agg(
        F.min_by("gram", "n").alias("gram"), F.bool_or(F.col("n").isNull()).alias("missing"))
    return rarest.filter("NOT missing").join(postings, "gram").filter(
        F.contains("text", F.col("query"))).select("query", "text")


def _part(i: Column, length: Column, edits: Column) -> tuple[Column, Column]:
    """(start from 0, characters) of segment i when ``length`` characters are cut into
    ``edits + 1`` even segments, the longer ones last."""
    base = F.floor(length / (edits + 1)).cast("int")
    short = edits + 1 - length % (edits + 1)
    return (i * base + F.greatest(F.lit(0), i - short),
            base + F.when(i >= short, 1).otherwise(0))


def _edits(ratio: float, longer: Column) -> Column:
    return F.floor(F.lit(ratio) * longer + _EPS).cast("int")


def _numbers(low: Column, high: Column) -> Column:
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def similar(queries: DataFrame, texts: DataFrame, ratio: float,
            most_gap: int | None = None) -> DataFrame:
    """(query, text) of every pair that differs by an edit at least and by ``ratio`` of the
    longer text's characters in edits at most; ``most_gap`` bounds the difference in length.

    With at most t edits, one of a text's t + 1 segments stands unchanged in the query, moved
    by as many places as the edits before it insert or delete: |move| + |gap - move| <= t. The
    lengths of both sides fix t, so length, t, segment and its characters are the key. Keys of
    a text grow with the square of its length, the query's with the cube: names, not pages.
    """
    text, query = F.col("text"), F.col("query")
    length = F.length(text)
    spread = F.floor(length / (1 - ratio) + _EPS).cast("int")
    cut = F.explode(_numbers(F.greatest(F.lit(1), _edits(ratio, length)), _edits(ratio, spread)))
    cuts = texts.select("text", length.alias("length"), cut.alias("edits"))

    def segment(i: Column) -> Column:
        start, size = _part(i, F.col("length"), F.col("edits"))
        return F.struct(i.alias("part"), text.substr(start + 1, size).alias("chars"))

    indexed = cuts.select("text", "length", "edits", F.inline(F.transform(
        F.sequence(F.lit(0), F.col("edits")), segment)))

    # Only lengths that occur, which are few however many texts there are.
    lengths = sorted(r[0] for r in texts.select(length).distinct().collect())
    own = F.length(query)
    asked = queries.select("query", own.alias("own"), F.explode(F.filter(
        F.lit(lengths).cast("array<int>"),
        lambda n: (n >= F.ceil(own * (1 - ratio) - _EPS)) & (n * (1 - ratio) <= own + _EPS)
        & (F.abs(n - own) <= (own + n if most_gap is None else most_gap)))).alias("length"))
    asked = asked.withColumn("edits", _edits(ratio, F.greatest("own", "length"))) \
        .withColumn("gap", F.col("own") - F.col("length")) \
        .filter("edits >= 1 AND abs(gap) <= edits")

    def probes(i: Column) -> Column:
        start, size = _part(i, F.col("length"), F.col("edits"))
        first = F.greatest(F.lit(0), start - F.floor((F.col("edits") - F.col("gap")) / 2))
        last = F.least(F.col("own") - size, start + F.floor((F.col("edits") + F.col("gap")) / 2))
        found = F.transform(_numbers(first.cast("int"), last.cast("int")),
                            lambda at: query.substr(at + 1, size))
        return F.transform(F.array_distinct(found),
                           lambda chars: F.struct(i.alias("part"), chars.alias("chars")))

    probed = asked.select("query", "length", "edits", F.inline(F.flatten(F.transform(
        F.sequence(F.lit(0), F.col("edits")), probes))))
    met = probed.join(indexed, ["length", "edits", "part", "chars"])
    near = F.call_function("levenshtein", query, text, F.col("edits"))
    return met.filter(near >= 1).select("query", "text")


def is_subsequence(short: Column, text: Column) -> Column:
    matched = F.aggregate(
        F.split(text, ""), F.lit(0),
        lambda at, ch: at + F.when(short.substr(at + 1, F.lit(1)) == ch, 1).otherwise(0))
    return matched == F.length(short)


def in_order(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(query, text) of every text that has the query's characters in their order, with others
    between them or not; queries of three characters at least.

    A text of up to ``IN_ORDER_CHARS`` characters is keyed by all its triples of characters in
    order, a longer one by its pairs, of which there are no more than pairs of characters; the
    query by its first, middle and last one. A pair that meets has to pass the set of
    characters before the characters are followed one by one.
    """
    query, text = F.col("query"), F.col("text")
    chars, n = F.split(text, ""), F.length(text)

    def at(i: Column) -> Column:
        return text.substr(i, F.lit(1))

    triples = F.flatten(F.flatten(F.transform(_numbers(F.lit(1), n - 2), lambda i: F.transform(
        _numbers(i + 1, n - 1), lambda j: F.transform(
            F.sequence(j + 1, n), lambda k: F.concat(at(i), at(j), at(k)))))))
    # A long text's pairs: each character with the characters behind its first occurrence.
    far = F.flatten(F.transform(F.array_distinct(chars), lambda c: F.transform(
        F.array_distinct(F.split(text.substr(F.instr(text, c) + 1, n), "")),
        lambda d: F.concat(c, d))))
    keys = F.when(n <= IN_ORDER_CHARS, F.array_distinct(triples)).otherwise(far)
    indexed = texts.filter(n >= 3).select("text", F.explode(keys).alias("key"))
    middle = query.substr(F.floor((F.length(query) + 1) / 2).cast("int"), F.lit(1))
    first, last = F.left(query, F.lit(1)), F.right(query, F.lit(1))
    asked = queries.filter(F.length(query) >= 3).select("query", F.explode(F.array(
        F.concat(first, middle, last), F.concat(first, last))).alias("key"))
    return asked.join(indexed, "key").filter(
        (F.length(query) <= n) & (F.call_function("translate", query, text, F.lit("")) == "")
        & is_subsequence(query, text)).select("query", "text")
