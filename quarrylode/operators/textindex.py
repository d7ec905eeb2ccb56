"""Text search over company names: analyzers, postings, BM25, fuzzy terms, n-grams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylode.operators.stored import stored

#: Words that the name analyzer drops.
STOP = ("inc", "llc", "ltd", "corp", "co", "pty", "limited", "holding", "holdings", "company", "services", "service")
#: BM25's usual parameters.
K1, B = 1.2, 0.75
#: Letters from which a word meets others by its pieces, and their number.
LONG, PIECES = 40, 5
#: Postings of a term that give a search its first good guess.
CHAMPIONS = 16
ACCENTS, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def name_tokens(c: Column) -> Column:
    """Lower-case words without stop words, accents folded; repeats are kept."""
    words = F.split(F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTS, PLAIN), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP))


def grams(c: Column, low: int = 3, high: int = 5) -> Column:
    """All runs of 3 to 5 letters or digits inside a word."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= low)
    cut = lambda w, n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))
    sizes = F.sequence(F.lit(low), F.lit(high))
    return F.flatten(F.transform(words, lambda w: F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.length(w)), lambda n: cut(w, n)))))


def _champions(postings: DataFrame) -> DataFrame:
    """By buckets, so that no task sorts or holds the postings of a common term."""
    bucket = F.pmod(F.xxhash64("key"), F.lit(CHAMPIONS))
    best = postings.groupBy("field", "token", bucket.alias("b")).agg(F.max(F.struct("impact", "key")).alias("p"))
    return best.select("field", "token", "p.key", "p.impact")


@dataclass
class TextIndex:
    """postings(field, token, key, impact), terms(field, token, df, idf, top) and, for each term, its
    champions(field, token, key, impact): the postings that weigh most, one of each of CHAMPIONS hash
    buckets. A term adds weight x idf x impact to a score, and top is the highest impact it has."""

    postings: DataFrame
    terms: DataFrame
    champions: DataFrame

    @staticmethod
    def build(docs: DataFrame, key: str, fields: dict[str, Column]) -> TextIndex:
        """fields: name -> array of tokens. One explode, then aggregates by (field, token)."""
        listed = F.array(*[F.struct(F.lit(n).alias("field"), t.alias("tokens")) for n, t in fields.items()])
        each = docs.select(F.col(key).alias("key"), F.inline(listed))
        each = each.withColumn("dl", F.size("tokens")).filter("dl > 0")
        stats = each.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
        counted = each.select("field", "key", "dl", F.explode("tokens").alias("token")).groupBy("field", "token", "key", "dl").agg(F.count(F.lit(1)).alias("tf"))
        # stats has one row for each field of the index
        impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        postings = counted.join(F.broadcast(stats.drop("n")), "field").select("field", "token", "key", impact.alias("impact"))
        seen = postings.groupBy("field", "token").agg(F.count(F.lit(1)).alias("df"), F.max("impact").alias("top"))
        idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        terms = seen.join(F.broadcast(stats.drop("avgdl")), "field").select("field", "token", "df", idf.alias("idf"), "top")
        return TextIndex(postings, terms, _champions(postings))

    def written(self) -> TextIndex:
        """The index in stored tables, for searches that read it more than once."""
        postings = stored(self.postings)
        return TextIndex(postings, stored(self.terms), stored(_champions(postings)))

    def scores(self, queries: DataFrame) -> DataFrame:
        """queries(qid, field, token, weight) -> qid, field, key, score: weighted BM25 sums."""
        part = F.col("weight") * F.col("idf") * F.col("impact")
        known = queries.join(self.terms, ["field", "token"])
        return known.join(self.postings, ["field", "token"]).groupBy("qid", "field", "key").agg(F.sum(part).alias("score"))


def edits_allowed(token: Column) -> Column:
    """By length: none up to 2 characters, one up to 5, two above."""
    return F.when(F.length(token) <= 2, 0).when(F.length(token) <= 5, 1).otherwise(2)


def expand_fuzzy(queries: DataFrame, terms: DataFrame, prefix: int = 0) -> DataFrame:
    """queries(qid, field, token, weight) with near vocabulary terms, less weight for more edits. A
    swap of neighbouring letters is one edit, as it is one for the deletion keys.

    Only distinct query tokens meet the vocabulary, blocked by field and by deletion keys: words
    within d edits share a string that d deletions make of either, so no other pair is compared.
    Words above LONG letters have too many of these; they meet by a fifth of the asked word instead:
    two edits, each of two neighbours at most, leave one of five pieces as it is, moved by two at
    most. Both ways are exact.
    """
    asked = queries.select("field", F.col("token").alias("asked")).distinct()
    left = asked.select("field", "asked", F.explode(_asked_keys(F.col("asked"))).alias("k")).distinct()
    right = terms.select("field", "token", F.explode(_term_keys(F.col("token"))).alias("k")).distinct()
    near = left.join(right, ["field", "k"]).select("field", "asked", "token").distinct()
    near = near.withColumn("edits", _edits(F.col("asked"), F.col("token"))).filter(F.col("edits") <= edits_allowed(F.col("asked")))
    if prefix:
        near = near.filter(F.left("asked", F.lit(prefix)) == F.left("token", F.lit(prefix)))
    less = 1 - F.col("edits") / F.least(F.length("asked"), F.length("token"))
    return queries.withColumnRenamed("token", "asked").join(near, ["field", "asked"]).select("qid", "field", "token", (F.col("weight") * less).alias("weight"))


def _swaps(token: Column) -> Column:
    at = F.filter(F.sequence(F.lit(1), F.length(token)), lambda i: i < F.length(token))
    return F.transform(at, lambda i: F.concat(F.left(token, i - 1), F.substr(token, i + 1, F.lit(1)), F.substr(token, i, F.lit(1)), F.substr(token, i + 2)))


def _edits(a: Column, b: Column) -> Column:
    """Edits up to 2, more for more: letters put in, left out or changed, neighbours swapped."""
    within = lambda x, most: F.nullif(F.levenshtein(x, b, most), F.lit(-1))
    plain = within(a, 2)
    swapped = 1 + F.array_min(F.transform(_swaps(a), lambda x: within(x, 1)))
    twice = F.when(F.length(a) == F.length(b), F.when(F.arrays_overlap(_swaps(a), _swaps(b)), 2))
    return F.when(plain <= 1, plain).otherwise(F.least(plain, swapped, twice))


def _piece(word: Column, n: Column, i: Column, moved: Column) -> Column:
    """The i-th fifth of a word of n letters, read from a word in which it has moved."""
    start = F.floor(n * i / PIECES)
    size = F.floor(n * (i + 1) / PIECES) - start
    at = (start + moved + 1).cast("int")
    return F.when(at >= 1, F.concat_ws(":", n.cast("string"), i.cast("string"), F.substr(word, at, size.cast("int"))))


def _asked_keys(a: Column) -> Column:
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: _piece(a, F.length(a), i, F.lit(0)))
    return F.when(F.length(a) <= LONG, _deletions(a)).otherwise(pieces)


def _term_keys(b: Column) -> Column:
    """Deletion keys for asked words that are not long, pieces for those that are."""
    none, moves = F.array().cast("array<string>"), F.sequence(F.lit(-2), F.lit(2))
    sizes = F.filter(F.transform(moves, lambda k: F.length(b) + k), lambda n: n > LONG)
    of = lambda n: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.transform(moves, lambda k: _piece(b, n, i, k))))
    return F.concat(F.when(F.length(b) <= LONG + 2, _deletions(b)).otherwise(none), F.array_compact(F.flatten(F.transform(sizes, of))))


def _deletions(token: Column) -> Column:
    one = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.left(t, i - 1), F.substr(t, i + 1)))
    first = F.when(F.length(token) > 2, one(token)).otherwise(F.array().cast("array<string>"))
    second = F.when(F.length(token) > 4, F.flatten(F.transform(first, one))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(token), first, second))
