"""The best document by bounds is that of scoring all; common terms are hardly read."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylode.operators.textindex import TextIndex
from quarrylode.operators.topsearch import contenders, floors, known_terms, split_terms

KINDS = {"name": ("long", "short"), "grams": ("grams",)}
NO_EXTRA = "qid long, key string, score double"


@pytest.fixture(scope="module")
def skewed(spark):
    """600 names of two common words out of four and two rare ones; 60 queries, some with a word unknown."""
    rng = random.Random(5)
    common, rare = ["north", "south", "east", "west"], [f"r{i}" for i in range(400)]
    names = [(f"k{i:03}", rng.sample(common, 2) + rng.sample(rare, 2)) for i in range(600)]
    index = TextIndex.build(spark.createDataFrame(names, "key string, words array<string>"), "key", {"long": F.col("words"), "short": F.slice("words", 1, 3), "grams": F.transform("words", lambda w: F.left(w, F.lit(2)))}).written()
    asked = []
    for q in range(60):
        words = list(rng.choice(names)[1]) if q % 3 else rng.sample(common, 3)
        words[q % 3] = f"x{q}" if q % 5 == 0 else words[q % 3]
        asked += [(q, f, w[:2] if f == "grams" else w, x) for w in set(words) for f, x in (("long", 3.0), ("short", 2.0), ("grams", 0.5))]
    return index, spark.createDataFrame(asked, "qid long, field string, token string, weight double")


def plain(index, queries, extra):
    """All scores: each query's best with its ties."""
    by_field = {(r["qid"], r["key"], r["field"]): r["score"] for r in index.scores(queries).collect()}
    pairs = {(q, k) for q, k, _ in by_field} | {(r["qid"], r["key"]) for r in extra}
    best = {}
    for q, k in pairs:
        score = sum(max(by_field.get((q, k, f), 0.0) for f in fs) for fs in KINDS.values())
        score += sum(r["score"] for r in extra if (r["qid"], r["key"]) == (q, k))
        best.setdefault(q, []).append((round(score, 6), k))
    return {q: {x for x in found if x[0] == max(found)[0]} for q, found in best.items()}


def winners(rows):
    best = {}
    for r in rows:
        best.setdefault(r["qid"], []).append((round(r["score"], 6), r["key"]))
    return {q: {x for x in found if x[0] == max(found)[0]} for q, found in best.items()}


def test_best_and_ties_are_those_of_all_scores(spark, skewed):
    index, queries = skewed
    extra = spark.createDataFrame([(1, "k007", 9.0), (2, "k008", 0.5), (2, "k008", 0.25), (99, "k001", 1.0), (3, "nowhere", 500.0)], NO_EXTRA)
    found = contenders(queries, index, KINDS, extra).collect()
    assert winners(found) == plain(index, queries, extra.collect())
    assert len({(r["qid"], r["key"]) for r in found}) == len(found)


def test_common_terms_are_read_for_few_documents(spark, skewed):
    index, queries = skewed
    queries = queries.filter("qid % 3 > 0")  # those that ask for a name that is there
    kinds = KINDS | {"extra": ("extra",)}
    none = spark.createDataFrame([], "qid long, key string, field string, part double")
    known = known_terms(queries, index)
    split = split_terms(known, floors(known, index, kinds, none), kinds)
    every, read = known.agg(F.sum("df")).first()[0], split.filter("essential").agg(F.sum("df")).first()[0]
    probes = contenders(queries, index, KINDS, spark.createDataFrame([], NO_EXTRA)).select("qid", "key").join(known, "qid").count()
    assert (read + probes) * 10 < every


def test_nothing_asked_nothing_known_nothing_indexed(spark, skewed):
    index, queries = skewed
    none = spark.createDataFrame([], NO_EXTRA)
    assert contenders(queries.limit(0), index, KINDS, none).count() == 0
    assert contenders(queries.withColumn("token", F.lit("unknown")), index, KINDS, none).count() == 0
    assert contenders(queries.withColumn("token", F.lit(None).cast("string")), index, KINDS, none).count() == 0
    empty = TextIndex(index.postings.limit(0), index.terms.limit(0), index.champions.limit(0))
    only = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0)], NO_EXTRA)
    assert {(r["key"], r["score"]) for r in contenders(queries, empty, KINDS, only).collect()} >= {("b", 3.0)}


def test_many_equal_documents_all_stay(spark):
    """Ties of the best score are never told apart by the bounds."""
    docs = spark.createDataFrame([(f"k{i:02}", ["same", "words"]) for i in range(50)] + [("other", ["same"])], "key string, words array<string>")
    index = TextIndex.build(docs, "key", {"long": F.col("words")})
    queries = spark.createDataFrame([(1, "long", "same", 1.0), (1, "long", "words", 1.0)], "qid long, field string, token string, weight double")
    found = contenders(queries, index, {"name": ("long",)}, spark.createDataFrame([], NO_EXTRA)).collect()
    assert {r["key"] for r in found if r["key"] != "other"} == {f"k{i:02}" for i in range(50)}
