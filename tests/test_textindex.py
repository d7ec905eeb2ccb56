"""Fuzzy terms against a plain edit distance, short words and long ones."""

import random

from pyspark.sql import functions as F

from quarrylode.operators.textindex import edits_allowed, expand_fuzzy


def distance(a, b):
    """Letters put in, left out or changed, neighbours swapped (each letter edited once)."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def edited(rng, word, n):
    for _ in range(n):
        i, kind = rng.randrange(max(1, len(word))), rng.randrange(4)
        word = {0: word[:i] + word[i + 1 :], 1: word[:i] + rng.choice("abc") + word[i:], 2: word[:i] + rng.choice("abc") + word[i + 1 :], 3: word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :]}[kind]
    return word or "a"


def test_fuzzy_terms_are_those_of_the_plain_distance(spark):
    rng, asked, terms = random.Random(3), set(), set()
    for size in (1, 2, 3, 4, 5, 6, 8, 12, 38, 39, 40, 41, 42, 43, 60):
        for _ in range(5):
            word = "".join(rng.choice("abcdefgh") for _ in range(size))
            asked.add(word)
            terms |= {edited(rng, word, k) for k in (0, 1, 1, 1, 2, 2, 2, 2, 3)}
    vocabulary = spark.createDataFrame([("f", w) for w in terms], "field string, token string")
    queries = spark.createDataFrame([(w, "f", w, 1.0) for w in asked], "qid string, field string, token string, weight double")
    got = {(r["qid"], r["token"]) for r in expand_fuzzy(queries, vocabulary).collect()}
    allowed = {w: 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2 for w in asked}
    assert got == {(a, b) for a in asked for b in terms if abs(len(a) - len(b)) <= 2 and distance(a, b) <= allowed[a]}
    assert spark.createDataFrame([("abc",)], "w string").select(edits_allowed(F.col("w"))).first()[0] == 1


def test_a_very_long_word_is_no_burden(spark):
    word = "x" * 2000 + "y" * 3000
    vocabulary = spark.createDataFrame([("f", word[:100] + "z" + word[100:]), ("f", word[::-1])], "field string, token string")
    queries = spark.createDataFrame([(1, "f", word, 1.0)], "qid long, field string, token string, weight double")
    assert [len(r["token"]) for r in expand_fuzzy(queries, vocabulary).collect()] == [5001]
