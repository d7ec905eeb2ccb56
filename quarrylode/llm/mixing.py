"""Mixing sources to target weights, natively: fixed-length blocks of tokens, drawn by index.

The words of a source, in a hashed order of its documents, are one long sequence cut into blocks
of a fixed number of words. The words that the mix wants from a source are slots, one for a block
each; slot j belongs to pass j div blocks, and a pseudorandom permutation of the block indices,
another for each pass, says which block it takes. The last slot takes the first words of its block
only, so that a source gives its target to the word. Every slot is dealt to an output shard by its
hash: the counts of a shard's sources are multinomial, given each source's total.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylode.llm.common import WORD, table, unit_hash, written

BLOCK, ROUNDS, CHUNK, OUT_SHARDS = 512, 24, 4096, 64
#: Rows of a bucket of a source, in which documents are put in order; buckets at least.
BUCKET_ROWS, BUCKETS = 1 << 14, 64
#: A table of sources of at most so many rows is broadcast; a longer one is joined by shuffling.
BROADCAST_SOURCES = 10_000


def _flip(x: Column, i: Column, n: Column, key: Sequence[Column]) -> Column:
    other = F.pmod(F.pmod(F.xxhash64(*key, i), n) - x, n)
    return F.when(F.xxhash64(*key, i, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)


def permuted(x: Column, n: Column, *key: Column, rounds: int = ROUNDS, inverse: bool = False) -> Column:
    """A permutation of 0..n-1, chosen by key: swap-or-not rounds, each its own inverse."""
    steps = F.sequence(F.lit(rounds - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(rounds - 1))
    return F.aggregate(steps, x.cast("long"), lambda a, i: _flip(a, i, n, key))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """From (source, words): each source's weight and target, one row a source.

    Sources by code point, null last, weigh weights[0], weights[1], ... and again from the start.
    They share share x all words by weight; no target exceeds most x its source's words, and the
    excess goes to the others by weight until none is above: those with the least room for their
    weight are filled first, so one pass in that order finds the level of the rest.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("room", F.col("words") * F.lit(float(most)))
    by_room = Window.orderBy(F.col("room") / F.col("weight"), "rank")
    filled = ranked.withColumn("given", F.coalesce(F.sum("room").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    filled = filled.withColumn("left_weight", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
    everywhere = Window.partitionBy()
    filled = filled.withColumn("level", (F.sum("words").over(everywhere) * F.lit(float(share)) - F.col("given")) / F.col("left_weight"))
    filled = filled.withColumn("full", F.col("room") <= F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("room") / F.col("weight"), "rank", "level"))).over(everywhere)["level"]
    return filled.select("source", "rank", "words", "weight", F.when(F.col("full"), F.col("room")).otherwise(F.least(level * F.col("weight"), F.col("room"))).alias("target"))


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c), F.lit("null"))


class Mix:
    """The plan of a mix: sources (one row each), rows (placed documents), slots and takes."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 17):
        self.block, self.seed = block, seed
        sized = docs.select(
            F.col(doc_id).alias("doc_id"),
            _key(F.col(source).cast("string")).alias("key"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
        buckets = max(BUCKETS, docs.count() // BUCKET_ROWS)
        sized = written(sized.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(buckets)).cast("int")))
        pieces = sized.groupBy("key", "bucket").agg(F.sum("size").alias("piece"))
        totals = pieces.groupBy("key").agg(F.sum("piece").alias("words"))
        totals = totals.withColumn("source", F.when(F.col("key") != "null", F.expr("substring(key, 2)")))
        targets = source_targets(totals, weights, share, most).withColumn("key", _key(F.col("source")))
        n, size = F.lit(block), F.col("words")
        targets = targets.withColumn("wanted", F.least(F.floor(F.col("target") + 0.5), F.floor(size * F.lit(most))).cast("long"))
        targets = targets.withColumn("blocks", F.ceil(size / n).cast("long")).withColumn("last", size - (F.col("blocks") - 1) * n)
        targets = targets.withColumn("passes", F.when(size > 0, F.floor(F.col("wanted") / size)).otherwise(0).cast("long"))
        self.sources = written(targets.withColumn("rest", F.col("wanted") - F.col("passes") * size))
        facts = self.sources.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("wanted"), F.lit(0)).alias("wanted")).first()
        self.small = F.broadcast if facts["n"] <= BROADCAST_SOURCES else (lambda df: df)
        self.tasks = math.ceil(facts["wanted"] / block / (8 * CHUNK)) + 1
        before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = pieces.select("key", "bucket", F.coalesce(F.sum("piece").over(before), F.lit(0)).alias("start"))
        inside = Window.partitionBy("key", "bucket").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "size")
        upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        self.rows = sized.withColumn("inner", upto - F.col("size")).join(starts, ["key", "bucket"]).select("doc_id", "key", "size", (F.col("start") + F.col("inner")).alias("start"))

    def slots(self, out_shards: int = OUT_SHARDS) -> DataFrame:
        """key, slot, pass, block, words, out_shard: the whole mix, one row for a block taken."""
        n, L = F.col("blocks"), F.lit(self.block)
        s = self.sources.filter("words > 0").select("key", "blocks", "last", "passes", "rest")
        in_rest = F.ceil(F.col("rest") / L) + F.when(F.col("rest") > 0, 1).otherwise(0)
        s = s.withColumn("n_slots", F.col("passes") * n + F.least(in_rest, n))
        s = s.withColumn("odd", permuted(n - 1, n, F.lit(self.seed), F.col("key"), F.col("passes"), inverse=True))
        s = s.filter("n_slots > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_slots") - 1) / CHUNK).cast("long"))))
        s = s.repartition(self.tasks, "key", "chunk")  # a fixed number: the rows are few but long to unroll
        s = s.withColumn("slot", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("n_slots")) - 1)))
        s = s.withColumn("pass", F.floor(F.col("slot") / n).cast("long")).withColumn("k", F.pmod("slot", n))
        s = s.withColumn("block", permuted(F.col("k"), n, F.lit(self.seed), F.col("key"), F.col("pass")))
        full = F.when(F.col("block") == n - 1, F.col("last")).otherwise(L)
        taken_before = F.col("k") * L - F.when(F.col("k") > F.col("odd"), L - F.col("last")).otherwise(0)
        words = F.when(F.col("pass") < F.col("passes"), full).otherwise(F.greatest(F.lit(0), F.least(full, F.col("rest") - taken_before)))
        shard = F.floor(unit_hash(F.lit(self.seed), F.lit("out"), F.col("key"), F.col("slot")) * out_shards).cast("int")
        return s.select("key", "slot", "pass", "block", words.cast("long").alias("words"), (F.col("pass") < F.col("passes")).alias("whole"), shard.alias("out_shard")).filter("words > 0")

    def draws(self, out_shards: int = OUT_SHARDS) -> DataFrame:
        """key, out_shard, n: how many slots of each source an output shard draws. They are
        multinomial given the sources' totals, which are not left to chance: a draw of the totals
        too would miss the targets of small sources and take a document more than twice."""
        return self.slots(out_shards).groupBy("key", "out_shard").agg(F.count(F.lit(1)).alias("n"))

    def takes(self) -> DataFrame:
        """doc_id, key, size, taken: blocks joined to slots by index and summed over a document."""
        L = F.lit(self.block)
        drawn = self.slots().groupBy("key", "block").agg(
            F.count_if("whole").alias("times"), F.coalesce(F.sum(F.when(~F.col("whole"), F.col("words"))), F.lit(0)).alias("head")
        )
        pieces = self.rows.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / L).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / L).cast("long"))))
        pieces = pieces.withColumn("from", F.greatest(F.col("start") - F.col("block") * L, F.lit(0))).withColumn("to", F.least(F.col("start") + F.col("size") - F.col("block") * L, L))
        got = (F.col("to") - F.col("from")) * F.coalesce("times", F.lit(0)) + F.greatest(F.lit(0), F.least(F.col("to"), F.coalesce("head", F.lit(0))) - F.col("from"))
        # both sides grow with the input, though the plan's estimates do not show it
        taken = pieces.join(drawn.hint("merge"), ["key", "block"], "left").groupBy("key", "start", "doc_id", "size").agg(F.sum(got).cast("long").alias("taken"))
        return taken.select("doc_id", "key", "size", "taken").unionByName(self.rows.filter("size = 0").select("doc_id", "key", "size", F.lit(0).cast("long").alias("taken")))


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, **options) -> DataFrame:
    """docs as the mix has them, columns unchanged: each as often as its words are taken.

    A document whose words are taken x times (0 to 2) is kept floor(x) times and once more with
    probability x - floor(x), by its hash. Equal rows share what they take.
    """
    takes = Mix(docs, doc_id, text, source, seed=seed, **options).takes()
    shares = takes.groupBy(F.col("doc_id").alias("_ql_id"), F.col("size").alias("_ql_size")).agg((F.sum("taken") / F.count(F.lit(1)) / F.greatest(F.col("_ql_size"), F.lit(1))).alias("_ql_times"))
    sized = docs.withColumn("_ql_n", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))
    copies = F.floor(F.col("_ql_times") + unit_hash(F.lit(seed), F.lit("copy"), F.col("_ql_id"))).cast("int")
    joined = sized.join(shares, sized[doc_id].eqNullSafe(F.col("_ql_id")) & (F.col("_ql_n") == F.col("_ql_size")))
    return joined.filter(copies > 0).withColumn("_ql_copy", F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """Words of every document that a mix of 150% of all words takes, sources weighing 5, 2, 1.

    A null text has size 0; an empty table gives no rows.
    """
    mix = Mix(table(spark, sf_dir, "documents"))
    facts = mix.sources.select("key", F.col("words").cast("long").alias("source_size"), "target")
    return mix.takes().join(mix.small(facts), "key").select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")
