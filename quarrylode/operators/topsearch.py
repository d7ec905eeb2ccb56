"""The best document of each query without scoring all: bounds tell which ones cannot win.

A query's rare terms and their heaviest postings give one good document, and its whole score is a
floor. Terms that together cannot reach the floor name no candidates: a document that has only those
loses. So the postings of common terms are joined for documents alone that may still win. The floor
and the bounds only decide how much is read, never what comes out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylode.operators.stored import stored
from quarrylode.operators.textindex import TextIndex

#: Terms of a query that the first guess reads, the rarest.
RAREST = 8
#: What sums in another order may differ by, and ties told by rounded scores.
MARGIN = 1e-5

Kinds = dict[str, tuple[str, ...]]


def summed(parts: DataFrame, kinds: Kinds, *more: Column) -> DataFrame:
    """parts(qid, key, field, part) -> qid, key, score: of each kind its best field, kinds added up.

    One shuffle, summed before it."""
    sums = [F.coalesce(F.sum(F.when(F.col("field") == f, F.col("part"))), F.lit(0.0)).alias(f"_{f}") for fs in kinds.values() for f in fs]
    score = reduce(lambda a, b: a + b, [F.array_max(F.array(*[F.col(f"_{f}") for f in fs])) for fs in kinds.values()])
    return parts.groupBy("qid", "key").agg(*sums, *more).withColumn("score", score).drop(*[f"_{f}" for fs in kinds.values() for f in fs])


def known_terms(queries: DataFrame, index: TextIndex) -> DataFrame:
    """qid, field, token, df, worth (what one unit of impact adds), most (what the term adds at most)."""
    asked = queries.groupBy("qid", "field", "token").agg(F.sum("weight").alias("weight"))
    worth = F.col("weight") * F.col("idf")
    return asked.join(index.terms, ["field", "token"]).select("qid", "field", "token", "df", worth.alias("worth"), (worth * F.col("top")).alias("most"))


def whole_scores(pairs: DataFrame, known: DataFrame, index: TextIndex, kinds: Kinds, extra: DataFrame) -> DataFrame:
    """pairs(qid, key) with their scores by all terms; each pair looks up its own postings."""
    found = pairs.join(known, "qid").join(index.postings, ["field", "token", "key"]).select("qid", "key", "field", (F.col("worth") * F.col("impact")).alias("part"))
    return summed(found.unionByName(extra.join(pairs, ["qid", "key"], "left_semi")), kinds)


def floors(known: DataFrame, index: TextIndex, kinds: Kinds, extra: DataFrame) -> DataFrame:
    """qid, floor: the whole score of one promising document, so no more than the best score."""
    place = Window.partitionBy("qid").orderBy("df", "field", "token")
    rare = known.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= RAREST)
    parts = rare.join(index.champions, ["field", "token"]).select("qid", "key", "field", (F.col("worth") * F.col("impact")).alias("part"))
    guess = summed(parts.unionByName(extra), kinds).groupBy("qid").agg(F.max_by("key", F.struct("score", "key")).alias("key"))
    return whole_scores(guess, known, index, kinds, extra).select("qid", F.col("score").alias("floor"))


def split_terms(known: DataFrame, floor: DataFrame, kinds: Kinds) -> DataFrame:
    """known with floor, essential, and slack: what the terms that are not essential add at most.

    Those with many postings for little score go first. A token's bound is that of its best field of
    a kind, since only one field counts. Without a floor all terms are essential."""
    kind = reduce(lambda c, k: F.when(F.col("field").isin(*kinds[k]), F.lit(k)).otherwise(c), kinds, F.lit(None).cast("string"))
    held = known.join(floor, "qid", "left").withColumns({"kind": kind, "floor": F.coalesce("floor", F.lit(0.0))})
    token = Window.partitionBy("qid", "kind", "token")
    held = held.withColumns({"bound": F.max("most").over(token), "read": F.sum("df").over(token), "_first": F.row_number().over(token.orderBy("field")) == 1})
    # a query's terms are one name's: a few dozen rows
    order = Window.partitionBy("qid").orderBy(F.col("bound") / F.col("read"), "kind", "token").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    held = held.withColumn("_upto", F.sum(F.when(F.col("_first"), F.col("bound")).otherwise(0.0)).over(order))
    held = held.withColumn("essential", F.col("_upto") + MARGIN >= F.col("floor"))
    slack = F.coalesce(F.max(F.when(~F.col("essential"), F.col("_upto"))).over(Window.partitionBy("qid")), F.lit(0.0))
    return held.withColumn("slack", slack).drop("kind", "bound", "read", "_first", "_upto")


def contenders(queries: DataFrame, index: TextIndex, kinds: Kinds, extra: DataFrame) -> DataFrame:
    """qid, key, score of all documents that may be a query's best, its best and ties among them.

    queries(qid, field, token, weight): weights are positive. extra(qid, key, score): what documents
    have besides, from other clauses. kinds: the index's fields by kind; of a kind the best field counts.
    """
    kinds = kinds | {"extra": ("extra",)}
    extra = extra.select("qid", "key", F.lit("extra").alias("field"), F.col("score").alias("part"))
    known = stored(known_terms(queries, index))
    split = split_terms(known, floors(known, index, kinds, extra), kinds)
    parts = split.filter("essential").join(index.postings, ["field", "token"]).select("qid", "key", "field", (F.col("worth") * F.col("impact")).alias("part"), "floor", "slack")
    pairs = summed(parts.unionByName(extra, allowMissingColumns=True), kinds, F.max("floor").alias("floor"), F.max("slack").alias("slack"))
    # a document with nothing but what it has besides is kept: its query's bounds are not beside it
    alive = pairs.filter(F.col("floor").isNull() | (F.col("score") + F.col("slack") + MARGIN >= F.col("floor"))).select("qid", "key")
    return whole_scores(stored(alive), known, index, kinds, extra)
