"""Tokens of two tokenizers aligned by the bytes they cover, and how often ids end together.

Both tokenizers cut a text's bytes without gaps. A token points to the token farthest to the right
that shares a byte with it: the other tokenizer's token that has its last byte, if that one ends
later. Tokens that end together end their component; the pointers of all others lead there. Successors
are doubled (next = next[next]) for all tokens of many texts at once until nothing changes, so every
token knows the terminal token of its component, which labels the group, after a number of rounds that
grows with the logarithm of the longest group.

Neither tokenizer joins bytes across a space between two other characters, so texts are cut there, and
each piece of a batch of texts is encoded and aligned once, however often the batch has it. Pairs of
ids are counted for each batch, summed by Spark, compared with the highest count of their B id and
joined back to the batches.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylode.llm.common import table, written

TOKENIZERS = "/opt/tokenizers"
#: Bytes of text in a batch (a document is never cut) and pieces that are encoded at once.
BATCH, SLICE = 8 << 20, 1 << 13
#: Bits of an id pair that hold the B id.
B_BITS = 32

CUT = re.compile(r"(?<=\S)(?= \S)")
#: A space beside other white space, where a piece may not end; runs of \x1c to \x1f count as such.
WIDE = re.compile(r"\s |\s$| \s")


def byte_level() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: printable Latin-1 characters
    stand for themselves, the other bytes for those from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Bytes:
    """Tokenizer A, byte-level: encode() gives ids, bytes[id] what a token covers."""

    def __init__(self, source: bytes):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(source.decode())
        self.model.encode_special_tokens = True
        byte, special, known = byte_level(), self.model.get_added_tokens_decoder(), self.model.get_vocab()
        self.bytes = [b""] * (max(known.values()) + 1)
        for name, i in known.items():
            self.bytes[i] = name.encode() if i in special else bytes(byte[c] for c in name)

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return [x.ids for x in self.model.encode_batch_fast(pieces, add_special_tokens=False)]


class Pieces:
    """Tokenizer B, which puts a space before each text itself, so that pieces come without theirs."""

    def __init__(self, source: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=source)
        named = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.bytes = [bytes([int(s[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", s) else s.replace("▁", " ").encode() for s in named]

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return self.model.encode([p[1:] for p in pieces], num_threads=1)


def models_of(sources: list[bytes]) -> tuple[Bytes, Pieces]:
    """Both tokenizers, loaded once in the life of a Python worker: made anew for every task they would
    leave its memory in pieces."""
    held = sys.modules.setdefault("quarrylode_models", SimpleNamespace(known={}))
    key = tuple(hashlib.sha256(s).digest() for s in sources)
    if key not in held.known:
        held.known = {key: (Bytes(sources[0]), Pieces(sources[1]))}
    return held.known[key]


def cut(text: str) -> list[str]:
    """Pieces of a text that begins with a space, each of which begins with one: between two
    characters that are not white space, a space begins a piece."""
    return CUT.split(text) if WIDE.search(text) else [" " + p for p in text[1:].split(" ")]


def components(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The number, among A's tokens, of the terminal token of each token's component; A's tokens come
    first, then B's. Both cover the same bytes; their ends ascend."""
    n = len(ends_a)
    a, b = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
    after = np.concatenate([np.where(ends_b[a] == ends_a, np.arange(n), n + a), b])
    while True:
        twice = after[after]
        if np.array_equal(twice, after):
            return after
        after = twice


class Aligned:
    """Pieces of texts, encoded by both tokenizers and aligned: n_a, n_b, n_groups and the groups'
    text for each, and the pairs of ids that end together, a row of codes with the pieces' starts."""

    def __init__(self, pieces: list[str], a: Bytes, b: Pieces):
        self.n_a, self.n_b, self.n_groups, self.whole = (np.zeros(len(pieces), np.int64) for _ in range(4))
        self.groups: list[str] = []
        codes, sizes = [], []
        for at in range(0, len(pieces), SLICE):
            some = pieces[at : at + SLICE]
            ids = [[], []]
            for which, model in enumerate((a, b)):
                for piece, found in zip(some, model.encode(some), strict=True):
                    ids[which].append(found if b"".join([model.bytes[i] for i in found]) == piece.encode("utf-8", "surrogatepass") else None)
            whole = np.array([x is not None and y is not None for x, y in zip(*ids, strict=True)])
            ids = [[x if ok else [] for x, ok in zip(side, whole, strict=True)] for side in ids]
            links, size = self._slice(at, ids, a, b)
            self.whole[at : at + SLICE] = whole
            codes.append(links)
            sizes.append(size)
        self.codes = np.concatenate([*codes, np.empty(0, np.int64)])
        self.sizes = np.concatenate([*sizes, np.empty(0, np.int64)])

    def _slice(self, at: int, ids: list[list[list[int]]], a: Bytes, b: Pieces) -> tuple[np.ndarray, np.ndarray]:
        counts = [np.array([len(x) for x in side], np.int64) for side in ids]
        flat = [np.fromiter((i for x in side for i in x), np.int64) for side in ids]
        ends = [np.cumsum(np.array([len(x) for x in model.bytes], np.int64)[tokens]) for tokens, model in zip(flat, (a, b), strict=True)]
        last = components(*ends)
        n = len(ends[0])
        terminal = np.unique(last)
        first_a, first_b = np.searchsorted(last[:n], terminal), np.searchsorted(last[n:], terminal)
        last_b = np.r_[first_b[1:], len(ends[1])][: len(terminal)] - 1
        codes = (flat[0][terminal] << B_BITS) | flat[1][last_b]
        owner = np.repeat(np.arange(len(counts[0])), counts[0])[terminal]
        sizes = np.bincount(owner, minlength=len(counts[0]))
        names = [list(map(str, tokens.tolist())) for tokens in flat]
        from_a, from_b = first_a.tolist(), first_b.tolist()
        texts = [",".join(names[0][i : k + 1]) + "|" + ",".join(names[1][j : m + 1]) for i, k, j, m in zip(from_a, terminal.tolist(), from_b, last_b.tolist(), strict=True)]
        cuts = np.r_[0, np.cumsum(sizes)].tolist()
        self.groups += [";".join(texts[s:e]) for s, e in zip(cuts, cuts[1:])]
        for kept, values in ((self.n_a, counts[0]), (self.n_b, counts[1]), (self.n_groups, sizes)):
            kept[at : at + len(values)] = values
        return codes, sizes


def _packed(values: np.ndarray) -> bytes:
    """32-bit numbers, compressed by planes of their bytes."""
    return pa.Codec("zstd").compress(np.ascontiguousarray(values.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes(), asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, decompressed_size=4 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.int32).ravel()


DOC = [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("groups", T.StringType())]


def encoded(docs: DataFrame, kind: T.DataType, tokenizers: str, batch_bytes: int, digest: bool) -> DataFrame:
    """A row for each batch of documents: what is known of each (docs, and the columns of DOC), the
    pieces it has (seq, sizes of each document's part), the pairs of each piece (links, by number,
    with their sizes) and the batch's pairs (codes, ascending) with their counts."""
    sources = docs.sparkSession.sparkContext.broadcast([Path(tokenizers, name).read_bytes() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")])
    fields = [("batch", T.LongType()), ("docs", T.ArrayType(kind)), *((n, T.ArrayType(k)) for n, k in DOC), ("parts", T.ArrayType(T.IntegerType())), ("seq", T.BinaryType()),
              ("sizes", T.BinaryType()), ("n_pieces", T.LongType()), ("links", T.BinaryType()), ("n_links", T.LongType()), ("codes", T.ArrayType(T.LongType())), ("counts", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def row(number: int, held: list[pa.Array], seqs: list[np.ndarray], pieces: list[str], models) -> pa.RecordBatch:
        found = Aligned(pieces, *models)
        bad = found.whole == 0
        seqs = [np.empty(0, np.int32) if bad[s].any() else s for s in seqs]
        parts = np.array([len(s) for s in seqs], np.int32)
        sums = [[int(per[s].sum()) for s in seqs] for per in (found.n_a, found.n_b, found.n_groups)]
        told = (lambda t: hashlib.sha256(t.encode()).hexdigest() if t else "") if digest else str
        texts = [told(";".join([found.groups[i] for i in s.tolist()])) for s in seqs]
        seq = np.concatenate([*seqs, np.empty(0, np.int32)])
        codes, which = np.unique(found.codes, return_inverse=True)
        times = np.bincount(seq, minlength=len(pieces))
        counts = np.bincount(which, weights=np.repeat(times, found.sizes), minlength=len(codes)).astype(np.int64)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        cols = [pa.array([number]), one(pa.concat_arrays(held)), *(one(pa.array(x, pa.int64())) for x in sums), one(pa.array(texts, pa.string())), one(pa.array(parts)),
                pa.array([_packed(seq)], pa.binary()), pa.array([_packed(found.sizes)], pa.binary()), pa.array([len(pieces)]), pa.array([_packed(which)], pa.binary()), pa.array([len(which)]),
                one(pa.array(codes)), one(pa.array(counts))]
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = models_of(sources.value)
        number = TaskContext.get().partitionId() << 32
        held, seqs, pieces, size = [], [], {}, 0
        name = pieces.setdefault
        for b in batches:
            first = 0
            for i, t in enumerate(b.column(1)):
                text = t.as_py() or ""
                seqs.append(np.array([name(p, len(pieces)) for p in cut(" " + text)] if text else [], np.int32))
                size += len(text)
                if size >= batch_bytes:
                    yield row(number, [*held, b.column(0).slice(first, i + 1 - first)], seqs, list(pieces), models)
                    held, seqs, size, first, number = [], [], 0, i + 1, number + 1
                    pieces.clear()
            held.append(b.column(0).slice(first))
        if seqs:
            yield row(number, held, seqs, list(pieces), models)

    return docs.mapInArrow(run, schema)


def pair_counts(batches: DataFrame) -> DataFrame:
    """code, n, best: how often each pair of ids is linked in all batches, and whether no pair with
    the same B id is linked more often. Sums and maxima are pre-aggregated before they are shuffled."""
    pairs = batches.select(F.inline(F.arrays_zip(F.col("codes").alias("code"), F.col("counts").alias("n")))).groupBy("code").agg(F.sum("n").alias("n"))
    pairs = written(pairs.filter("n > 0").withColumn("b", F.col("code").bitwiseAND(F.lit((1 << B_BITS) - 1))))
    highest = pairs.groupBy("b").agg(F.max("n").alias("highest"))
    return pairs.join(highest, "b").select("code", "n", (F.col("n") == F.col("highest")).alias("best"))


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, batch_bytes: int = BATCH, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (`a1,a2|b1;a3|b2,b3`: ids of A and B in order, or with
    digest the SHA-256 of that), n_links, n_best (links that are a B id's most frequent, ties
    included) and count_sum (of the links' counts in the whole table), a row for each row.

    A encodes a space and the text, B the text. Null and empty texts, and those whose tokens' bytes
    are not the text's, have no tokens: zeros and an empty string. Repeated rows count each; long
    texts are never cut; other columns are not read; an empty table gives no rows. tokenizers: the
    folder of the two files, read by the driver and shipped to the tasks (3 MB)."""
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    kind = rows.schema["doc"].dataType
    batches = written(encoded(rows, kind, tokenizers, batch_bytes, digest))
    keys = batches.select(F.col("batch").alias("of"), F.explode("codes").alias("code"))
    joined = keys.join(pair_counts(batches), "code")
    counts = joined.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("code", "n", "best"))).alias("all")).select("of", F.col("all.code").alias("linked"), F.col("all.n").alias("n"), F.col("all.best").alias("best"))
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(*f) for f in DOC), *(T.StructField(n, T.LongType()) for n in ("n_links", "n_best", "count_sum"))])

    def run(batch: pa.Table, found: pa.Table) -> pa.Table:
        held = batch.combine_chunks().to_batches()[0]
        take = lambda name, x=held: x.column(name).slice(0, 1).flatten()
        codes, parts = take("codes").to_numpy(), take("parts").to_numpy()
        n, best = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        if found.num_rows:
            answer = found.combine_chunks().to_batches()[0]
            at = np.searchsorted(codes, take("linked", answer).to_numpy())
            n[at] = take("n", answer).to_numpy()
            best[at] = take("best", answer).to_numpy(zero_copy_only=False)
        links = _unpacked(held["links"][0].as_py(), held["n_links"][0].as_py())
        sizes = _unpacked(held["sizes"][0].as_py(), held["n_pieces"][0].as_py())
        seq = _unpacked(held["seq"][0].as_py(), int(parts.sum()))
        piece = np.repeat(np.arange(len(sizes)), sizes)
        edges = np.r_[0, np.cumsum(parts)]

        def sums(values: np.ndarray) -> np.ndarray:
            per = np.zeros(len(sizes), np.int64)
            np.add.at(per, piece, values)
            total = np.r_[0, np.cumsum(per[seq])]
            return total[edges[1:]] - total[edges[:-1]]

        return pa.table([take("docs"), *(take(name) for name, _ in DOC), pa.array(sums(np.ones(len(links), np.int64))), pa.array(sums(best[links])), pa.array(sums(n[links]))], names=schema.names)

    return batches.groupBy("batch").cogroup(counts.groupBy("of")).applyInArrow(run, schema)


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens under two tokenizers."""
    found = align(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
