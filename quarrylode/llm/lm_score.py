"""Language-model scores by stupid backoff over n-gram counts of the whole corpus.

The score of word w after a context v is (c(vw) - own) / c(v), where own is the document's own
count, so that a document does not vouch for itself; where no other document has vw, it is 0.4 times
the score after the context without its first word, and c(w) / N without any. A document's score is
the mean log10 over its words, the first one after a start mark.

Documents are first put into batches of a million words or so, their words as short numbers. Each batch gives a count table of its n-grams of all orders: one row for a key however
often the batch has it, so a key has at most one row a batch and none is hot. The tables are
partitioned by the keys' hashes and summed there by a window over the key; what the other batches
have of each key goes back to its batch, in the order of the keys and without them, and is joined by
batch to the documents, whose scores are summed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylode.llm.common import table, written

BACKOFF, ORDER = 0.4, 2
#: Words of a batch (a document is never cut), bytes of text for a task that sums counts, words kept in a cache.
BATCH, BUCKET_BYTES, CACHE = 1 << 20, 16 << 20, 1 << 18
#: Pieces of the key space for each of those tasks, so that hashing deals them out evenly; tasks at most.
PIECES, TASKS = 8, 1 << 15
START = np.uint64(0x9E3779B97F4A7C15)


def mixed(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = v * np.uint64(0x9E3779B185EBCA87) ^ w
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def encoded(rows: DataFrame, batch_words: int = BATCH) -> DataFrame:
    """From (doc, text): batch, docs, lengths (words and start mark of each), words (their
    hashes, most frequent first) and tokens (numbers of words, compressed), a row for each batch."""
    kind = rows.schema["doc"].dataType
    schema = T.StructType(
        [T.StructField("batch", T.LongType()), T.StructField("docs", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.IntegerType())),
         T.StructField("words", T.ArrayType(T.LongType())), T.StructField("tokens", T.BinaryType())]
    )

    def row(number: int, docs: list[pa.Array], seqs: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(s) for s in seqs], np.int32)
        words, which, n = np.unique(np.concatenate(seqs), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        tokens = pa.Codec("zstd").compress(np.ascontiguousarray(place[which].view(np.uint8).reshape(-1, 4).T).tobytes(), asbytes=True)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        held = pa.concat_arrays(docs)
        cols = [pa.array([number]), one(held), one(pa.array(lengths)), one(pa.array(words[order].view(np.int64))), pa.array([tokens], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = _Hashes(), TaskContext.get().partitionId() << 32
        docs, seqs, size = [], [], 0
        for b in batches:
            first = 0
            for i, t in enumerate(b.column(1)):
                tokens = (t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                seqs.append(np.fromiter([START, *[hashes[w] for w in tokens]], np.uint64, len(tokens) + 1))
                size += len(tokens) + 1
                if size >= batch_words:
                    yield row(number, [*docs, b.column(0).slice(first, i + 1 - first)], seqs)
                    docs, seqs, size, first, number = [], [], 0, i + 1, number + 1
            docs.append(b.column(0).slice(first))
        if seqs:
            yield row(number, docs, seqs)

    return rows.mapInArrow(run, schema)


def _list(rows: pa.RecordBatch, column: str, i: int) -> np.ndarray:
    return rows.column(column).slice(i, 1).flatten().to_numpy(zero_copy_only=False)


class _Batch:
    """A batch read back: words (hashes), tokens (their numbers in a row), at (the place of each in
    its document, 0 for the start mark) and lengths."""

    def __init__(self, rows: pa.RecordBatch, i: int):
        self.words, self.lengths = _list(rows, "words", i), _list(rows, "lengths", i)
        n = int(self.lengths.sum())
        raw = np.frombuffer(pa.Codec("zstd").decompress(rows.column("tokens")[i].as_py(), decompressed_size=4 * n, asbytes=True), np.uint8)
        self.tokens = np.ascontiguousarray(raw.reshape(4, -1).T).view(np.int32).ravel()
        starts = np.cumsum(self.lengths) - self.lengths
        self.at = np.arange(n, dtype=np.int32) - np.repeat(starts.astype(np.int32), self.lengths)

    def levels(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(places, keys, counts, number of the key at each place) of the n-grams of each order."""
        yield np.arange(len(self.tokens), dtype=np.int32), self.words, np.bincount(self.tokens, minlength=len(self.words)), self.tokens
        seq = self.words.view(np.uint64)[self.tokens] if order > 1 else None
        gram = seq
        for k in range(1, order):
            gram = np.concatenate([gram[:1], mixed(gram[:-1], seq[1:])])
            places = np.flatnonzero(self.at >= k).astype(np.int32)
            names, which, n = np.unique(gram[places].view(np.int64), return_inverse=True, return_counts=True)
            yield places, names, n, which.astype(np.int32)


def count_tables(batches: DataFrame, order: int, bits: int) -> DataFrame:
    """piece, batch, keys, counts: the n-grams of each batch, sorted, by the high bits of their keys."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i in range(b.num_rows):
                keys, n = (np.concatenate(x) for x in zip(*((names, n) for _, names, n, _ in _Batch(b, i).levels(order)), strict=True))
                by = np.argsort(keys, kind="stable")
                keys, n = keys[by], n[by]
                piece = (keys >> (64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)
                cuts = np.r_[0, np.flatnonzero(np.diff(piece)) + 1, len(keys)].astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (keys, n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(piece[cuts[:-1]]), pa.array([b.column("batch")[i].as_py()] * (len(cuts) - 1), pa.int64()), *lists], names=["piece", "batch", "keys", "counts"])

    return batches.mapInArrow(run, "piece int, batch long, keys array<long>, counts array<int>")


def other_counts(tables: DataFrame, tasks: int) -> DataFrame:
    """batch, piece, others: what the other batches have of each key of a batch, sorted by key."""
    rows = tables.repartition(tasks, "piece").select("piece", "batch", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("counts").alias("n"))))
    summed = rows.select("piece", "batch", "key", (F.sum("n").over(Window.partitionBy("piece", "key")) - F.col("n")).alias("others"))
    lists = summed.groupBy("piece", "batch").agg(F.sort_array(F.collect_list(F.struct("key", "others"))).alias("all"))
    return lists.select("batch", "piece", F.col("all.others").alias("others"))


def scored(held: pa.RecordBatch, found: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document of a batch, given what other batches have of its keys: the sum of log10,
    and how many words are scored by their own counts, still to be divided by the number of words."""
    batch = _Batch(held, 0)
    levels = list(batch.levels(order))
    alone = batch.at > 0
    keys = np.concatenate([names for _, names, _, _ in levels])
    found = found.sort_by("piece").combine_chunks()
    counts = np.empty(len(keys), np.int64)
    counts[np.argsort(keys, kind="stable")] = found["others"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    del keys
    doc = np.repeat(np.arange(len(batch.lengths), dtype=np.int32), batch.lengths)
    deepest = np.minimum(batch.at, order - 1)
    best, start, context = np.zeros(len(doc)), 0, None
    for k, (places, names, n, which) in enumerate(levels):
        every = counts[start : start + len(names)] + n
        start += len(names)
        count = np.zeros(len(doc), np.int64)
        count[places] = every[which]
        if k:
            code = doc[places] * np.int64(len(names)) + which
            by = np.argsort(code)
            first = np.flatnonzero(np.r_[True, np.diff(code[by]) != 0][: len(by)])
            own = np.empty(len(code), np.int64)
            own[by] = np.repeat(np.diff(np.r_[first, len(code)]), np.diff(np.r_[first, len(code)]))
            other = count[places] - own
            places, other = places[other > 0], other[other > 0]
            best[places] = np.log10(other / context[places - 1]) + (deepest[places] - k) * math.log10(BACKOFF)
            alone[places] = False
        else:
            best = np.log10(count) + deepest * math.log10(BACKOFF)
        context = count
    best[batch.at == 0] = 0.0
    return np.bincount(doc, weights=best, minlength=len(batch.lengths)), np.bincount(doc[alone], minlength=len(batch.lengths))


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, order: int = ORDER, batch_words: int = BATCH) -> DataFrame:
    """doc_id, n_words, score: one row for each id; rows that share an id count as one document's
    parts, each with its own words not vouching for it. Without a word (null or empty texts) the
    score is null. Words are runs of anything but white space, A-Z lower-cased. Other columns are
    not read; an empty table gives no rows.

    Batches are what tasks read in order, so docs should come from storage, where a task that is run
    again reads the same rows; write what a shuffle has made first."""
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = min(TASKS, math.ceil(max(1, size) / bucket_bytes))
    # one shuffle of the batches serves both the count tables and the join: fewer partitions than the session's would be dealt anew
    held = encoded(rows, batch_words).repartition(max(tasks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "batch")
    counts = other_counts(count_tables(held, order, math.ceil(math.log2(tasks * PIECES)) if tasks > 1 else 0), tasks)
    kind = rows.schema["doc"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("alone", T.LongType())])

    def run(batch: pa.Table, found: pa.Table) -> pa.Table:
        row = batch.combine_chunks().to_batches()[0]
        sums, alone = scored(row, found, order)
        return pa.table([row.column("docs").flatten(), pa.array(_list(row, "lengths", 0).astype(np.int64) - 1), pa.array(sums), pa.array(alone)], names=schema.names)

    parts = written(held.groupBy("batch").cogroup(counts.groupBy("batch")).applyInArrow(run, schema))
    n = parts.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    each = parts.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum(F.col("total") - F.col("alone") * math.log10(max(n, 1))).alias("total"))
    return each.select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.col("total") / F.col("n_words")).alias("score"))


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document against all others."""
    return score_documents(table(spark, sf_dir, "documents"))
