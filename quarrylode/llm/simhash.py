"""Near-duplicates by SimHash, joined on a grid of segment bit counts.

A fingerprint of 64 bits maps to the bit counts of its 16 segments of 4 bits. Two fingerprints that
differ in d bits differ by at most d in the sum of |count - count|, so those within 2 bits are
within Manhattan distance 2, and two such points of the integer grid have a common grid point
within distance 1 of either. Each fingerprint is filed under its own cell and those one step away
(at most 33), and only fingerprints that meet in a cell are compared bit by bit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylode.llm.common import forget, swept, table, written
from quarrylode.llm.components import connected_components

WORDS, SEED, SEGMENTS = 3, 42, 16
#: Cells of more fingerprints are not paired up; the exact way in close_in_crowds() takes them.
CROWD = 32
#: Near copies: words of a shingle, and the share of different shingles in common (a fraction).
SHINGLE, SIMILAR = 5, (4, 5)
#: Texts sampled to tell frequent shingles, and how many of those are known to every task.
ORDER_SAMPLE, ORDERED = 20_000, 100_000
#: Members of a crowded cell that all of it is compared with, those its centre is told from, and sides of the blocks of what is left.
ROUNDS, SAMPLED, BLOCK = 3, 24, 512
#: Ids of at most so many rows are broadcast, so that texts need not be shuffled for them.
BROADCAST_ROWS = 1_000_000
#: Hashes whose bits are counted at once, and texts that are shingled at once.
STEP, TEXTS = 1 << 15, 256
#: Links are verified in parts: the sets of a part's ends are such a share of all sets, or have so many shingles.
SHARE, LEAST = 0.25, 4 << 20


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 (seed 42) of a text's word shingles, repeats included, A-Z lower-cased.

    Fewer words than a shingle make one shingle; no word makes none.
    """
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(tokens) - words + 1].tolist()
    return np.fromiter([digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist())], np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """A signed 64-bit number whose bits are set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), STEP):
        bits = np.unpackbits(np.ascontiguousarray(hashes[k : k + STEP]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of a text's word shingles; zero for a text without words."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, doc_id: str, text: str, words: int = WORDS) -> DataFrame:
    """doc_id, fp (signed long), row by row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t.as_py(), words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def cell(fp: Column) -> Column:
    """The bit counts of a fingerprint's 16 segments, 4 bits each, in one long."""
    ones, twos = F.lit(0x5555555555555555), F.lit(0x3333333333333333)
    a, b = fp.bitwiseAND(ones), F.shiftrightunsigned(fp, 1).bitwiseAND(ones)
    pairs = a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))
    return pairs.bitwiseAND(twos) + F.shiftrightunsigned(pairs, 2).bitwiseAND(twos)


def cells_around(c: Column) -> Column:
    """A cell and all cells one step away, in an array."""
    near = [c]
    for i in range(SEGMENTS):
        count, step = F.shiftrightunsigned(c, 4 * i).bitwiseAND(F.lit(15)), F.lit(1 << (4 * i))
        near += [F.when(count < 4, c + step), F.when(count > 0, c - step)]
    return F.array_compact(F.array(*near))


def close_in_crowds(fps: DataFrame) -> DataFrame:
    """Links of fingerprints within 2 bits without pairing: both are within 1 bit of a common
    value. At most 65 fingerprints are within 1 bit of a value; each is linked to their smallest."""
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])
    met = fps.select("fp", F.explode(near).alias("middle")).groupBy("middle").agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    return met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a <> b").distinct()


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links that connect all fingerprints within 2 bits of each other. fps: distinct."""
    filed = fps.select("fp", F.explode(cells_around(cell(F.col("fp")))).alias("cell"))
    filed = filed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("cell"))).filter("n > 1")
    met = written(filed)
    few = met.filter(F.col("n") <= CROWD).groupBy("cell").agg(F.array_sort(F.collect_list("fp")).alias("all"))
    pairs = few.select("all", F.explode("all").alias("a")).select("a", F.explode(F.filter("all", _close)).alias("b"))
    crowds = met.filter(F.col("n") > CROWD).select("fp").distinct()
    out = written(pairs.unionByName(close_in_crowds(crowds)).distinct())
    forget(met)
    return out


def _close(b: Column) -> Column:
    return (b > F.col("a")) & (F.bit_count(b.bitwiseXOR(F.col("a"))) <= 2)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fp, component_id for every row of docs.

    Fingerprints that differ in 2 bits or fewer are linked; component_id is the smallest doc_id of
    all rows that links reach. Null and empty texts have fingerprint zero, linked like any other;
    null ids never are a component's id unless all of its ids are null; repeated rows are kept.
    """
    rows = written(fingerprints(docs, doc_id, text, words))
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(classes.select("fp")))
    classes = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = classes.join(firsts, "root").select(F.col("fp").alias("_ql_fp"), "component_id")
    return rows.join(by_fp, rows["fp"] == F.col("_ql_fp")).select("doc_id", "fp", "component_id")


def shingle_set(text: str | None) -> np.ndarray:
    """The different five-word shingles of a text, hashed, in order of their hashes."""
    return np.unique(shingle_hashes(text, SHINGLE))


def sketch(hashes: np.ndarray) -> bytes:
    """How many hashes of a set fall into each of 64 parts, 255 at most. Where two sets' counts
    differ by d in all, the sets differ in d members or more."""
    return np.minimum(np.bincount((hashes >> np.uint64(58)).astype(np.int64), minlength=64), 255).astype(np.uint8).tobytes()


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(k, TEXTS) for b in batches for k in range(0, b.num_rows, TEXTS))


def frequent_shingles(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the shingles met most in a sample of the texts.

    They only set the order in which prefix() takes shingles. Any order links the same texts.
    """
    part = max(1, docs.count() // ORDER_SAMPLE)
    some = docs.select(F.col(text).alias("text")).filter(F.pmod(F.xxhash64("text", F.lit(part)), F.lit(part)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            found = [shingle_set(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found or [np.empty(0, np.uint64)]).view(np.int64))], ["h"])

    counts = some.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    top = counts.orderBy(F.desc("n"), "h").limit(ORDERED).collect()
    hashes, n = np.array([r["h"] for r in top], np.int64).view(np.uint64), np.array([r["n"] for r in top], np.int64)
    order = np.argsort(hashes)
    return hashes[order], n[order]


def prefix(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rarest shingles of a set, one more than it may lack of a set that is similar.

    Sets in one order of all shingles whose prefixes have none in common are less similar.
    """
    n, rank = len(hashes), np.zeros(len(hashes), np.int64)
    if len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], hashes), len(frequent[0]) - 1)
        rank = np.where(frequent[0][at] == hashes, frequent[1][at], 0)
    least = -(-SIMILAR[0] * n // SIMILAR[1])
    return hashes[np.lexsort((hashes, rank))[: n - least + 1]]


def shingled(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_hash, id (a hash of the set of shingles), n (its size), fp (the fingerprint),
    sketch and prefix."""
    names = ["doc_id", "text_hash", "id", "n", "fp", "sketch", "prefix"]
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *[T.StructField(k, T.LongType()) for k in names[1:5]], T.StructField("sketch", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))])
    frequent = frequent_shingles(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in _sliced(batches):
            sets = [shingle_set(t.as_py()) for t in b.column(2)]
            ids = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            cut = [prefix(x, frequent).view(np.int64) for x in sets]
            marks = [fingerprint(t.as_py()) for t in b.column(2)]
            columns = [pa.array(ids), pa.array([len(x) for x in sets], pa.int64()), pa.array(marks, pa.int64()), pa.array([sketch(x) for x in sets], pa.binary()), pa.array(cut, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).mapInArrow(run, schema)


def _sizes_fit(a: Column, b: Column) -> Column:
    return SIMILAR[1] * F.least(a, b) >= SIMILAR[0] * F.greatest(a, b)


def _places_fit(na: Column, ia: Column, nb: Column, ib: Column) -> Column:
    """Whether sets of na and nb shingles can be similar if the first one in common is at places ia
    and ib of their prefixes. Similar sets pass at their first common shingle, if not at others."""
    return sum(SIMILAR) * F.least(na - ia, nb - ib) >= SIMILAR[0] * (na + nb)


def sketches_fit(links: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) whose sets can be similar as far as sizes and sketches tell, hashes ta, tb of
    their texts, and the sizes na, nb."""

    @F.arrow_udf("long")
    def apart(x: pa.Array, y: pa.Array) -> pa.Array:
        counts = [np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(-1, 64).astype(np.int64) for v in (x, y)]
        return pa.array(np.abs(counts[0] - counts[1]).sum(1))

    side = lambda k: classes.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"), F.col("text_hash").alias(f"t{k}"))
    both = links.join(side("a"), "a").join(side("b"), "b").filter(_sizes_fit(F.col("na"), F.col("nb")))
    may = (sum(SIMILAR)) * F.col("apart") <= (SIMILAR[1] - SIMILAR[0]) * (F.col("na") + F.col("nb"))
    return both.select("a", "b", "ta", "tb", "na", "nb", apart("sa", "sb").alias("apart")).filter(may).select("a", "b", "ta", "tb", "na", "nb")


def verified(links: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of classes whose texts share SIMILAR or more of their five-word shingles.

    Only the texts of linked classes that their sketches leave are read, one for each class. Links are
    verified in parts, each deleted with its sets before the next, so however many links there are, the
    disk holds the sets of a share of all classes.
    """
    links = swept(written(sketches_fit(links, classes)))
    out = [_verified_part(part, texts) for part in _parts(links, F.col("na") + F.col("nb"), ["a", "b"], classes)]
    forget(links)
    return reduce(DataFrame.unionByName, out)


def _parts(rows: DataFrame, size: Column, by: list[str], classes: DataFrame) -> list[DataFrame]:
    """rows, a table of written(), in parts by a hash, so that what their sets have, in all size of
    shingles, is SHARE of what all classes have, or LEAST."""
    all_, own = (df.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0] for df, c in ((classes, F.col("n")), (rows, size)))
    parts = max(1, math.ceil(own / max(SHARE * all_, LEAST)))
    return [rows.filter(F.pmod(F.xxhash64(*by), F.lit(parts)) == k) for k in range(parts)]


def _verified_part(links: DataFrame, texts: DataFrame) -> DataFrame:
    ends = links.select(F.col("a").alias("id"), F.col("ta").alias("text_hash")).unionByName(links.select(F.col("b").alias("id"), F.col("tb").alias("text_hash")))
    linked = written(ends.distinct())
    sets = written(_sets(linked, texts))
    both = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")).join(_small(links.select("a", "b")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    out = swept(written(both.filter(SIMILAR[1] * common >= SIMILAR[0] * (F.size("sa") + F.size("sb") - common)).select("a", "b")))
    forget(linked, sets)
    return out


def _sets(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """id, s: the sets of shingles of ids (id, text_hash), a table of written()."""

    @F.arrow_udf("array<long>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_py()).view(np.int64) for t in texts], pa.list_(pa.int64()))

    return texts.join(_small(ids), "text_hash").dropDuplicates(["id"]).select("id", of(F.col("text")).alias("s"))


def centre(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that over half of the sets have, or two of them, and for each how many of the sets differ in
    it from the centre, the set of those that over half have; for those in the centre it is -1 less that number."""
    hashes, n = np.unique(np.concatenate(sets), return_counts=True)
    in_, known = 2 * n > len(sets), (2 * n > len(sets)) | (n > 1)
    return hashes[known], np.where(in_, n - len(sets) - 1, n)[known]


def differences(hashes: np.ndarray, known: np.ndarray, often: np.ndarray) -> np.ndarray:
    """What only a set or only the centre() has, in one order for all sets: the rarest differences first."""
    mid = known[often < 0]
    out = np.concatenate([np.setdiff1d(hashes, mid, assume_unique=True), np.setdiff1d(mid, hashes, assume_unique=True)])
    rank = np.zeros(len(out), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, out), len(known) - 1)
        rank = np.where(known[at] == out, np.where(often[at] < 0, -1 - often[at], often[at]), 0)
    return out[np.lexsort((out, rank))]


def _apart(open_: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """lead, id, n, root, d, cut: what members of crowded cells have that their family's centre has not, or
    the other way round: how many (d), and the first of them. Cells with the same lead, their member of
    the smallest hash, are a family, as the cells of near copies have nearly the same members."""

    @F.arrow_udf("struct<h:array<long>,often:array<long>>")
    def mid(families: pa.Array) -> pa.Array:
        found = [centre([np.asarray(s, np.int64).view(np.uint64) for s in f]) for f in families.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([n for _, n in found], pa.list_(pa.int64()))], names=["h", "often"])

    @F.arrow_udf("struct<d:long,cut:array<long>>")
    def told(sets: pa.Array, h: pa.Array, often: pa.Array) -> pa.Array:
        d, cut = [], []
        for s, known, n in zip(sets, h, often, strict=True):
            s, known, n = (x.values.to_numpy() for x in (s, known, n))
            found = differences(s.view(np.uint64), known.view(np.uint64), n)
            d.append(len(found))
            # a similar set lacks (1 - SIMILAR) / SIMILAR of this one's size at most, and has the other differences too
            cut.append(found[: len(s) * (SIMILAR[1] - SIMILAR[0]) // SIMILAR[0] + 1].view(np.int64))
        return pa.StructArray.from_arrays([pa.array(d, pa.int64()), pa.array(cut, pa.list_(pa.int64()))], names=["d", "cut"])

    leads = written(open_.groupBy("cell").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id"))["id"].alias("lead")))
    rows = written(open_.join(_small(leads), "cell").select("lead", "id", "n", "root").distinct())
    some = rows.groupBy("lead").agg(F.array(*[F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id", "n")) for k in range(SAMPLED)]).alias("some"))
    some = written(some.select("lead", F.explode(F.array_distinct("some")).alias("s")).select("lead", "s.id", "s.n").distinct())

    def with_sets(part: DataFrame, then) -> DataFrame:
        ids = written(part.select("id").distinct())
        named = written(classes.select("id", "text_hash").join(_small(ids), "id"))
        sets = written(_sets(named, texts))
        out = swept(written(then(part.join(sets, "id"))))
        forget(ids, named, sets)
        return out

    mids = [with_sets(part, lambda x: x.groupBy("lead").agg(F.collect_list("s").alias("sets")).select("lead", mid("sets").alias("c"))) for part in _parts(some, F.col("n"), ["lead"], classes)]
    centres = reduce(DataFrame.unionByName, mids)
    away = lambda x: x.join(centres, "lead").select("lead", "id", "n", "root", told("s", "c.h", "c.often").alias("f")).select("lead", "id", "n", "root", "f.d", "f.cut")
    out = [with_sets(part, away) for part in _parts(rows, F.col("n"), ["lead", "id"], classes)]
    forget(leads, rows, some, *mids)
    return reduce(DataFrame.unionByName, out)


def _across(open_: DataFrame, classes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b), and pairs (a, b) to be verified, of members of crowded cells from different groups.

    Sets similar to each other differ in few members, and what they differ in is what one of them alone
    has among the differences from a centre, whatever set that is. So sets with few differences are
    similar to the one with the fewest (links), and all other similar ones have differences in common:
    they meet by the rarest of these, like sets by their prefixes. A cell of more than BLOCK sets is
    compared in blocks of BLOCK by BLOCK."""
    whole, part = sum(SIMILAR), SIMILAR[1] - SIMILAR[0]
    apart = _apart(open_, classes, texts).withColumn("slack", part * F.col("n") - whole * F.col("d"))
    most = written(apart.groupBy("lead").agg(F.max(F.struct("slack", "id")).alias("most")).select("lead", F.col("most.slack").alias("top"), F.col("most.id").alias("mid")))
    apart = apart.join(_small(most), "lead").withColumn("sure", F.col("slack") + F.col("top") >= 0)
    sure = written(apart.filter("sure and id <> mid").select(F.least("id", "mid").alias("a"), F.greatest("id", "mid").alias("b")).distinct())
    # sets that are not linked have slacks below zero in sum, which tells how many differences must be common
    common = F.greatest(F.lit(1), F.ceil(F.when(F.col("sure"), F.col("top") - F.col("slack")).otherwise(-F.col("top") - F.col("slack")) / (2 * whole)))
    first = F.slice("cut", 1, F.greatest(F.lit(0), F.col("d") - common + 1).cast("int"))
    filed = apart.select("lead", "id", "n", "root", "d", "slack", "sure", F.posexplode(first).alias("at", "e"))
    filed = filed.select(F.xxhash64("lead", "e").alias("cell"), "id", "n", "root", "d", "slack", "sure", "at")
    met = written(filed.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("cell"))).filter("m > 1"))

    def fits(a, b) -> Column:
        new = (b["id"] > a["id"]) & (a["root"] != b["root"]) & ~(a["sure"] & b["sure"]) & _sizes_fit(a["n"], b["n"])
        return new & (2 * whole * F.least(a["d"] - a["at"], b["d"] - b["at"]) >= -a["slack"] - b["slack"])

    each = F.struct("id", "n", "root", "d", "slack", "sure", "at")
    few = met.filter(F.col("m") <= CROWD).groupBy("cell").agg(F.collect_list(each).alias("all"))
    pairs = few.select("all", F.explode("all").alias("a")).select("a", F.explode(F.filter("all", lambda b: fits(F.col("a"), b))).alias("b"))
    crowds = met.filter(F.col("m") > CROWD).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("long"))
    own, all_ = F.pmod(F.xxhash64("id"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    side = lambda k, i, j: crowds.select("cell", each.alias(k), own.alias(i), all_.alias(j))
    more = side("a", "i", "j").join(side("b", "j", "i"), ["cell", "i", "j"]).filter(fits(F.col("a"), F.col("b")))
    return sure, pairs.select("a.id", "b.id").toDF("a", "b").unionByName(more.select("a.id", "b.id").toDF("a", "b")).distinct()


def simhash_links(rows: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): classes (id) whose fingerprints (fp, of rows) are equal or meet in the grid within two
    bits, and whose texts are similar: a fingerprint alone may be decided by one repeated line."""
    marks = written(rows.select("id", "fp").distinct())
    first = marks.groupBy("fp").agg(F.min("id").alias("first"))
    equal = marks.join(first, "fp").select(F.col("first").alias("a"), F.col("id").alias("b"))
    side = lambda k: first.select(F.col("fp").alias(k), F.col("first").alias(f"id_{k}"))
    grid = links(first.select("fp"))
    near = grid.join(side("a"), "a").join(side("b"), "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    found = swept(verified(equal.unionByName(near).filter("a <> b").distinct(), classes, texts))
    forget(marks, grid)
    return found


def similar_links(classes: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): links that connect all classes (id, text_hash, n, sketch, prefix) similar to each other,
    among them known ones, whose pairs are not compared again.

    Similar ones meet in the cell of a shingle of their prefixes. In cells of up to CROWD all are
    compared. In larger ones that links do not connect, all are compared with ROUNDS of the cell, and
    what is still unconnected by what tells it from the cell's centre. Groups that are known go on as one link for each member.
    """
    filed = classes.select("id", "n", F.posexplode("prefix").alias("at", "cell"))
    filed = filed.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("cell")))
    met = swept(written(filed.filter("m > 1")))
    few = met.filter(F.col("m") <= CROWD).groupBy("cell").agg(F.collect_list(F.struct("id", "n", "at")).alias("all"))
    fits = lambda b: (b["id"] > F.col("a.id")) & _sizes_fit(b["n"], F.col("a.n")) & _places_fit(F.col("a.n"), F.col("a.at"), b["n"], b["at"])
    pairs = few.select("all", F.explode("all").alias("a")).select("a", F.explode(F.filter("all", fits)).alias("b"))
    new = pairs.select("a.id", "b.id").toDF("a", "b").distinct().join(known, ["a", "b"], "left_anti")
    found = verified(new, classes, texts).unionByName(known)
    crowds = met.filter(F.col("m") > CROWD)
    if crowds.isEmpty():
        return found
    if ROUNDS:
        found, open_ = _grouped(crowds, found)
        chosen = [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id", "root")) for k in range(ROUNDS)]
        pivots = _small(written(open_.groupBy("cell").agg(F.array(*chosen).alias("pivots"))))
        tried = open_.join(pivots, "cell").select("id", "root", F.explode("pivots").alias("p")).filter("root <> p.root")
        tried = tried.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()
        found = found.unionByName(verified(tried, classes, texts))
    found, open_ = _grouped(crowds, found)
    if open_.isEmpty():
        return found
    sure, pairs = _across(open_, classes, texts)
    return found.unionByName(sure).unionByName(verified(pairs, classes, texts))


def _grouped(crowds: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of every class to the root of its group, and the rows, with their roots, of crowded
    cells that have more than one group."""
    roots = written(connected_components(links))
    named = written(crowds.join(roots, crowds["id"] == roots["node"], "left").select("cell", "id", "n", "at", "m", F.coalesce("root", "id").alias("root")))
    cells = named.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("cell")
    return roots.filter("node <> root").toDF("a", "b"), named.join(_small(written(cells)), "cell")


def alike_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, component_id for every row: groups of texts linked by a similarity of 0.8 or more of
    their different five-word shingles. Texts of equal sets are one class; links are looked for by
    fingerprints on the grid first, then by prefixes, which find all that are left. Nulls and repeated rows as in near_duplicates()."""
    each = swept(written(shingled(docs, doc_id, text)))
    classes = written(each.groupBy("id").agg(F.min("doc_id").alias("low"), F.min("text_hash").alias("text_hash"), *[F.first(k).alias(k) for k in ("n", "sketch", "prefix")]))
    rows = swept(written(each.select("doc_id", "id", "fp")))  # prefixes and sketches are in the classes
    forget(each)
    texts = docs.select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    roots = connected_components(similar_links(classes, texts, simhash_links(rows, classes, texts)))
    named = classes.join(roots, classes["id"] == roots["node"], "left").select("id", "low", F.coalesce("root", "id").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_id = named.join(lows, "root").select(F.col("id").alias("_ql_key"), "component_id")
    return rows.join(by_id, rows["id"] == F.col("_ql_key")).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near copies: of each group of alike_groups() the row with the smallest id.

    A row with a null id stays only if all ids of its group are null. Rows that share an id count
    as one document: one of them stays if any does.
    """
    found = written(alike_groups(docs, doc_id, text))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = written(found.groupBy("doc_id").agg(F.count_if(stays).alias("n")).withColumnRenamed("doc_id", "_ql_id"))
    gone = _small(ids.filter("n = 0").select("_ql_id"))
    left = docs.join(gone, docs[doc_id].eqNullSafe(F.col("_ql_id")), "left_anti")
    return left if ids.filter("n > 1").isEmpty() else left.dropDuplicates([doc_id])


def _small(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has few rows, else to be joined by shuffling."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
