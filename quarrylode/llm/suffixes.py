"""Repeated byte strings removed, by a distributed difference-cover suffix sort.

Only strings of H bytes matter, so suffixes are sorted by their first H bytes. Positions fall into
three classes, floor(p / s) mod 3, for letters of s bytes, nine of which cover H. Triples of letters
at positions of classes 1 and 2, the difference cover, are sorted and named; triples of those names
are sorted and named in turn, which orders the sampled suffixes, as nine letters cover all H bytes.
The rest is merged: a suffix of class 0 meets those of class 1 by its first letter and the name of
what follows, those of class 2 by two letters and the name after them. In each sorted list equal
neighbours are one string, which all but its earliest place repeat; as each class meets itself and
both others in one of the three lists, the earliest place of all classes is known.

Texts are handled in batches. What a batch sorts it first makes unique, and deals out by key to
buckets; a bucket sorts what it gets of all batches and answers each in the order of its keys. So
however often a string occurs it is one row a batch, and no task holds more than a batch or a bucket.

Before that, text that no other place can repeat is told apart. A window of H bytes is owned by its
leftmost gram of smallest hash; equal windows are owned by equal grams at equal places. Consecutive
windows of one owner are a block; equal blocks (128 bits of hash) hold the same windows, so all but
the first of them are repeats, and a block is sorted only if another block shares its gram.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute, which a worker may not have loaded)
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylode.llm.common import bucketed, forget, swept, table, written

#: Bytes of a repeat, of a gram, of a batch of texts, of text for each bucket, and windows looked at together.
H, GRAM, BATCH, BUCKET, STEP = 100, 24, 8 << 20, 16 << 20, 1 << 18
#: Parts of the windows, by their grams, that are sorted one after another: the disk holds one of them.
PARTS = 2
#: How hard rows of letters, the most of what is shuffled, are compressed.
LEVEL = 3
BASE = np.uint64(0x9E3779B97F4A7C15)
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
#: Ids that are null come after all others.
LAST = (1 << 63) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out, dtype=np.uint64)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size bytes from each place on, put together from those of powers of two."""
    n = len(data) - size + 1
    out, done, length = None, 0, 1
    part, factor = data.astype(np.uint64) + np.uint64(1), int(BASE)
    while length <= size:
        if size & length:
            piece = part[done : done + n]
            out = piece if out is None else out * np.uint64(factor) + piece
            done += length
        if 2 * length <= size:
            part = part[:-length] * np.uint64(factor) + part[length:]
        factor, length = factor * factor % (1 << 64), 2 * length
    return _mixed(out)


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    length = 1
    while 2 * length <= width:
        x, length = f(x[:-length], x[length:]), 2 * length
    return f(x[: len(x) - (width - length)], x[width - length :]) if width > length else x


def blocks(data: np.ndarray, ends: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """start, windows, gram and digest of the blocks of texts that follow one another and end at ends."""
    out = []
    valid = np.ones(len(data), bool)
    for back in range(1, min(size, len(data) + 1)):
        valid[np.maximum(ends - back, 0)] = False
    width = size - gram + 1
    forth, back = _powers(int(BASE), STEP + size), _powers(pow(int(BASE), -1, 1 << 64), STEP + size)
    for at in range(0, len(data) - size + 1, STEP):
        h = gram_hashes(data[at : at + STEP + size - 1], gram)
        least = _sliding(h, width, np.minimum)
        pad = np.zeros(width - 1, np.uint64)
        mark = _sliding(np.concatenate([pad, least, pad]), width, np.maximum) == h
        chosen = np.flatnonzero(mark)
        own = np.cumsum(mark)[: len(least)] - mark[: len(least)]  # the first chosen place not before each window
        late = np.flatnonzero(h[chosen[own]] != least)
        while len(late):
            own[late] += 1
            late = late[h[chosen[own[late]]] != least[late]]
        ok = valid[at : at + len(least)]
        edge = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (ok[1:] != ok[:-1])])
        n = np.diff(np.r_[edge, len(least)])
        edge, n = edge[ok[edge]], n[ok[edge]]
        owner = chosen[own[edge]]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * forth[: len(h)], dtype=np.uint64)])
        digest = _mixed((sums[edge + n + size - gram] - sums[edge]) * back[edge]) ^ _mixed(np.uint64(size) * n.astype(np.uint64) + (owner - edge).astype(np.uint64))
        out.append((edge + at, n, h[owner], digest))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))


def _pack(values: np.ndarray) -> bytes:
    """64-bit numbers, compressed by planes of their bytes; their number goes first."""
    values = np.ascontiguousarray(values)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd").compress(planes, asbytes=True)


def _unpack(data: bytes, kind=np.int64) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[8:], decompressed_size=8 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(kind).ravel()


def _rising(values: np.ndarray) -> bytes:
    """As _pack, for numbers that mostly rise a little."""
    return _pack(np.diff(values.astype(np.int64), prepend=np.int64(0)))


def _risen(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data))


def _rows(words: np.ndarray, width: int) -> bytes:
    """Rows of big-endian words, of which width bytes count, compressed row by row: sorted rows share
    their beginnings."""
    raw = np.ascontiguousarray(words.astype(">u8").view(np.uint8).reshape(len(words), -1)[:, :width])
    return len(words).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(raw.tobytes(), asbytes=True)


def _words(data: bytes, width: int) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[8:], decompressed_size=n * width, asbytes=True), np.uint8).reshape(n, width)
    return np.concatenate([raw, np.zeros((n, -width % 8), np.uint8)], axis=1).view(">u8").astype(np.uint64).reshape(n, -(-width // 8))


def _at(data: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """The width bytes from each place on as rows of big-endian words."""
    n = -(-width // 8)
    raw = np.lib.stride_tricks.sliding_window_view(data, 8 * n)[places]
    words = np.ascontiguousarray(raw).view(">u8").astype(np.uint64).reshape(len(places), n)
    if width % 8:
        words[:, -1] &= np.uint64((1 << 64) - (1 << 64 - 8 * (width % 8)))
    return words


def _prefix(words: np.ndarray, width: int) -> np.ndarray:
    out = words[:, : -(-width // 8)].copy()
    if width % 8:
        out[:, -1] &= np.uint64((1 << 64) - (1 << 64 - 8 * (width % 8)))
    return out


def _different(places: list[np.ndarray]) -> np.ndarray:
    """The numbers that any of the arrays has, in order."""
    mark = np.zeros(max((int(x.max()) for x in places if len(x)), default=-1) + 1, bool)
    for x in places:
        mark[x] = True
    return np.flatnonzero(mark)


def _cut_out(data: np.ndarray, windows: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    """The text that windows of h bytes cover, and their places in it."""
    cover = np.zeros(len(data) + 1, np.int32)
    cover[windows] = 1
    cover = np.cumsum(cover[:-1])
    used = cover > np.r_[np.zeros(min(h, len(data)), np.int32), cover[:-h]]  # a window begins at one of the last h places
    return data[used], (np.cumsum(used) - 1)[windows]


def _kept(text: np.ndarray) -> list[bytes]:
    return [pa.Codec("zstd").compress(text.tobytes(), asbytes=True), _pack(np.array([len(text)]))]


def _whole(row: pa.RecordBatch) -> np.ndarray:
    size = int(_unpack(row["size"][0].as_py())[0])
    return np.frombuffer(pa.Codec("zstd").decompress(row["text"][0].as_py(), decompressed_size=size, asbytes=True), np.uint8)


def _changes(rows: np.ndarray) -> np.ndarray:
    return np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)][: len(rows)]


def _order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their columns, the first one first; equal rows in any order. Later columns are
    only looked at for rows that earlier ones leave equal, and sorted as numbers of one word."""
    order = np.argsort(columns[0])
    new = np.r_[True, columns[0][order][1:] != columns[0][order][:-1]][: len(order)]
    for column in columns[1:]:
        at = np.flatnonzero(~(new & np.r_[new[1:], True][: len(new)]))
        if not len(at):
            break
        value, group = column[order[at]], np.cumsum(new)[at]
        by = np.argsort(value)
        rank = np.empty(len(at), np.int64)
        rank[by] = np.cumsum(np.r_[True, value[by][1:] != value[by][:-1]])
        key = (group << 32) + rank
        by = np.argsort(key)
        order[at] = order[at][by]
        new[at] = np.r_[True, key[by][1:] != key[by][:-1]]
    return order


def _unique(keys: np.ndarray, buckets: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of different rows by bucket, each row's number among them, and their buckets, which a
    hash of the first lead columns decides. Rows are told apart by their hash; if two different rows
    share one, by sorting."""
    mix = bucket = np.zeros(len(keys), np.uint64)
    for k, column in enumerate(keys.T, 1):
        mix = _mixed(mix * BASE + column)
        bucket = mix if k == lead else bucket
    order = np.argsort(mix)
    if (same := mix[order][1:] == mix[order][:-1]).any() and (same & _changes(keys[order])[1:]).any():
        order = _order([mix, *keys.T])
    new = _changes(keys[order])
    first, number = order[new], np.cumsum(new) - 1
    by = (bucket[first] >> np.uint64(33)).astype(np.int64) % buckets
    again = _order([by, *keys[first].T])  # sorted rows of a bucket share their beginnings, which compresses them
    place = np.empty(len(again), np.int64)
    place[again] = np.arange(len(again))
    which = np.empty(len(order), np.int64)
    which[order] = place[number]
    return first[again], which, by[again]


class _Keys:
    """A batch's keys made unique: which of them each place has, and the least id they have here."""

    def __init__(self, keys: np.ndarray, lead: int, buckets: int, ids: np.ndarray | None = None):
        first, self.which, self.by = _unique(keys, buckets, lead)
        self.rows, self.ids = keys[first], None
        if ids is not None:
            self.ids = np.full(len(first), LAST)
            np.minimum.at(self.ids, self.which, ids)

    def dealt(self, pack, tag: int = 0) -> list[dict]:
        """The keys and ids of each bucket that gets any."""
        cuts = np.r_[np.flatnonzero(np.r_[True, self.by[1:] != self.by[:-1]][: len(self.by)]), len(self.by)].tolist()
        ids = lambda s, e: _pack(self.ids[s:e]) if self.ids is not None else None
        return [{"bucket": int(self.by[s]), "tag": tag, "keys": pack(self.rows[s:e]), "ids": ids(s, e)} for s, e in zip(cuts[:-1], cuts[1:])]


DEALT = T.ArrayType(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("tag", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("ids", T.BinaryType())]))
ARROW_DEALT = pa.list_(pa.struct([("bucket", pa.int32()), ("tag", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary())]))


def _columns(rows: np.ndarray) -> bytes:
    parts = [_pack(c) for c in rows.T]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _from_columns(data: bytes) -> np.ndarray:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(_unpack(data[at + 4 : at + 4 + n], np.uint64))
        at += 4 + n
    return np.stack(out, axis=1)


def _answered(dealt: DataFrame, buckets: int, read, answer, fields: int) -> DataFrame:
    """batch, tag, bucket and so many columns: what answer(keys, ids) says of every batch's keys."""
    names = [f"a{k}" for k in range(fields)]
    schema = T.StructType([T.StructField("of", T.LongType()), T.StructField("tag", T.IntegerType()), T.StructField("bucket", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in names)])

    def run(group: pa.Table) -> pa.Table:
        out = []
        for tag in sorted(set(group["tag"].to_pylist())):
            rows = group.filter(pa.compute.equal(group["tag"], tag))
            keys = [read(k.as_py(), tag) for k in rows["keys"]]
            ids = [_unpack(k.as_py()) for k in rows["ids"]] if rows["ids"].null_count == 0 else None
            cuts = np.cumsum([0, *map(len, keys)])
            found = answer(np.concatenate(keys), np.concatenate(ids) if ids else None, rows["bucket"][0].as_py())
            for k, batch in enumerate(rows["batch"].to_pylist()):
                out.append((batch, tag, rows["bucket"][0].as_py(), *(_rising(x[cuts[k] : cuts[k + 1]]) for x in found)))
        return pa.table([pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * fields], strict=True)], names=schema.names)

    rows = dealt.select("batch", F.inline("dealt"))
    return rows.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, schema)


def _collected(found: pa.Table, tag: int, field: str) -> np.ndarray:
    rows = found.filter(pa.compute.equal(found["tag"], tag)).sort_by("bucket")
    return np.concatenate([*(_risen(x.as_py()) for x in rows[field]), np.empty(0, np.int64)]).astype(np.int64)


def _sorted_groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows, and the number of the group of equal rows of each in that order."""
    order = _order([*keys.T])
    return order, np.cumsum(_changes(keys[order])) - 1


def _earlier(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of sorted rows, those that an equal one with a smaller id has: 1, else 0."""
    order, group = _sorted_groups(keys)
    least = np.full(group[-1] + 1 if len(group) else 0, LAST)
    np.minimum.at(least, group, ids[order])
    out = np.empty(len(keys), np.int64)
    out[order] = least[group] < ids[order]
    return out


def _names(order: np.ndarray, sorted_rows: np.ndarray, bucket: int) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = (bucket << 32) + np.cumsum(_changes(sorted_rows)) - 1
    return out


def _repeats(which: np.ndarray, ids: np.ndarray, rows: np.ndarray, earlier: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Of places in order, those whose string also starts earlier: in a smaller id, here or in
    another batch, or earlier in the same row."""
    order = _order([which, rows, np.arange(len(which))])
    again = np.zeros(len(which), bool)
    same = (which[order][1:] == which[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    again[order[1:][same]] = True
    return again | (earlier[which] > 0) | (ids > least[which])


class Repeats:
    """The rounds, for repeats of h bytes; see the module."""

    def __init__(self, h: int, gram: int, batch: int, buckets: int):
        if h < 64:
            raise ValueError("repeats have 64 bytes at least: nine letters of an eighth must cover them")
        self.h, self.gram, self.batch, self.buckets, self.s = h, gram, batch, buckets, h // 8
        #: what the third of three names still has to tell for h, h - s and h - 2s bytes
        self.rest = [h - 6 * self.s, h - 7 * self.s, h - 8 * self.s]

    def held(self, docs: DataFrame) -> DataFrame:
        """A row for each batch: ids, sizes and text of its documents, and its blocks with their keys."""
        kind = docs.schema["doc"].dataType
        schema = T.StructType(
            [T.StructField("batch", T.LongType()), T.StructField("docs", T.ArrayType(kind)), T.StructField("bytes", T.ArrayType(T.LongType())), T.StructField("size", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in ("text", "start", "n", "which", "least", "row", "id")), T.StructField("dealt", DEALT)]
        )

        def row(number: int, ids: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
            raw, sizes = b"".join(texts), np.array([len(t) for t in texts], np.int64)
            start, n, gram, digest = blocks(np.frombuffer(raw, np.uint8), np.cumsum(sizes)[sizes > 0], self.h, self.gram)
            docs = pa.concat_arrays(ids)
            rows = np.searchsorted(np.cumsum(sizes), start, "right")
            known = docs.cast(pa.int64()).fill_null(LAST).to_numpy()[rows]
            keys = _Keys(np.stack([gram, digest], axis=1), 1, self.buckets, known)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            packed = [pa.Codec("zstd").compress(raw, asbytes=True), _rising(start), _pack(n), _pack(keys.which), _pack(keys.ids), _rising(rows), _rising(known)]
            return pa.RecordBatch.from_arrays([pa.array([number]), one(docs), one(pa.array(sizes)), pa.array([len(raw)]), *(pa.array([x], pa.binary()) for x in packed), pa.array([keys.dealt(_columns)], ARROW_DEALT)], names=schema.names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
            for b in batches:
                first = 0
                for i, t in enumerate(b.column(1)):
                    texts.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
                    size += len(texts[-1])
                    if size >= self.batch:
                        yield row(number, [*ids, b.column(0).slice(first, i + 1 - first)], texts)
                        ids, texts, size, first, number = [], [], 0, i + 1, number + 1
                ids.append(b.column(0).slice(first))
            if texts:
                yield row(number, ids, texts)

        return docs.mapInArrow(run, schema)

    def _mapped(self, rows: DataFrame, emit) -> DataFrame:
        """batch and dealt: the keys that emit(row of a batch) makes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    row = b.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([row["batch"], pa.array([emit(row)], ARROW_DEALT)], names=["batch", "dealt"])

        return rows.mapInArrow(run, T.StructType([T.StructField("batch", T.LongType()), T.StructField("dealt", DEALT)]))

    def _joined(self, rows: DataFrame, found: DataFrame, then, names: list[str], dealt: bool = False) -> DataFrame:
        """batch, binary columns, and with dealt the next keys, as then(row of a batch, its answers) gives them."""
        more = [T.StructField("dealt", DEALT)] if dealt else []
        schema = T.StructType([T.StructField("batch", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in names), *more])

        def run(batch: pa.Table, answers: pa.Table) -> pa.Table:
            row = batch.combine_chunks().to_batches()[0]
            kinds = [pa.binary()] * len(names) + [ARROW_DEALT] * dealt
            return pa.table([row["batch"], *(pa.array([x], k) for x, k in zip(then(row, answers), kinds, strict=True))], names=schema.names)

        return rows.groupBy("batch").cogroup(found.groupBy("of")).applyInArrow(run, schema)

    def contested(self, held: DataFrame) -> DataFrame:
        """For each batch: copied (start and windows of blocks that stand earlier), and of the blocks to
        be sorted: their text, and place, batch window, row and id of each window."""

        def answer(keys: np.ndarray, ids: np.ndarray, _: int) -> tuple[np.ndarray]:
            order, group = _sorted_groups(keys)
            grams = np.cumsum(_changes(keys[order][:, :1])) - 1
            kinds = np.bincount(grams[_changes(keys[order])])
            out = np.empty(len(keys), np.int64)
            out[order] = 2 * (kinds[grams] > 1)
            return (out + _earlier(keys, ids),)

        found = _answered(held, self.buckets, lambda data, _: _from_columns(data), answer, 1)

        def then(row: pa.RecordBatch, answers: pa.Table) -> list:
            start, rows, ids = (_risen(row[c][0].as_py()) for c in ("start", "row", "id"))
            n, which, least = (_unpack(row[c][0].as_py()) for c in ("n", "which", "least"))
            bits = _collected(answers, 0, "a0")
            copy = _repeats(which, ids, rows, bits & 1, least)
            sort = np.flatnonzero(~copy & (bits[which] > 1))
            data = np.frombuffer(pa.Codec("zstd").decompress(row["text"][0].as_py(), decompressed_size=row["size"][0].as_py(), asbytes=True), np.uint8)
            window = np.repeat(start[sort] - np.r_[0, np.cumsum(n[sort])[:-1]], n[sort]) + np.arange(int(n[sort].sum())) if len(sort) else np.empty(0, np.int64)
            text, place = _cut_out(data, window, self.h)
            block = np.repeat(np.arange(len(sort)), n[sort])
            keys = self._halves(text, place, block)[0]
            state = (place, window, rows[sort][block], ids[sort][block], block)
            return [_rising(start[copy]), _pack(n[copy]), *_kept(text), *map(_rising, state), keys.dealt(_columns)]

        known = held.select("batch", "size", "text", "start", "n", "which", "least", "row", "id")
        return self._joined(known, found, then, ["copied", "copied_n", "text", "size", "place", "window", "row", "id", "block"], dealt=True)

    def _halves(self, text: np.ndarray, place: np.ndarray, block: np.ndarray) -> tuple[_Keys, np.ndarray, np.ndarray]:
        """Keys of the least grams of both halves of the windows, which each window has, and their hash. A key counts
        once for the windows of a block that follow one another: they all differ."""
        if not len(place):
            return _Keys(np.empty((0, 1), np.uint64), 1, self.buckets, np.empty(0, np.int64)), np.empty(0, np.int64), np.empty(0, np.uint64)
        h, width = gram_hashes(text, self.gram), self.h - self.gram + 1
        half = width // 2
        pair = _mixed(_sliding(h, half, np.minimum)[place] * BASE + _sliding(h, width - half, np.minimum)[place + half])
        first = np.r_[True, (pair[1:] != pair[:-1]) | (block[1:] != block[:-1])]
        keys = _Keys(pair[first][:, None], 1, self.buckets)
        keys.ids = np.bincount(keys.which, minlength=len(keys.rows))
        return keys, keys.which[np.cumsum(first) - 1], pair

    def narrowed(self, rows: DataFrame, part: int, parts: int) -> DataFrame:
        """Of one part of the windows, those whose halves' least grams another place has, with their text."""

        def answer(keys: np.ndarray, times: np.ndarray, _: int) -> tuple[np.ndarray]:
            order, group = _sorted_groups(keys)
            out = np.empty(len(keys), np.int64)
            out[order] = np.bincount(group, weights=times[order])[group] > 1
            return (out,)

        found = _answered(rows, self.buckets, lambda data, _: _from_columns(data), answer, 1)

        def then(row: pa.RecordBatch, answers: pa.Table) -> list[bytes]:
            text, state = _whole(row), [_risen(row[c][0].as_py()) for c in ("place", "window", "row", "id", "block")]
            _, which, pair = self._halves(text, state[0], state[4])
            keep = (_collected(answers, 0, "a0")[which] > 0) & ((pair >> np.uint64(7)) % np.uint64(parts) == part)
            text, place = _cut_out(text, state[0][keep], self.h)
            return [*_kept(text), _rising(place), *(_rising(x[keep]) for x in state[1:4])]

        known = rows.select("batch", "text", "size", "place", "window", "row", "id", "block")
        return self._joined(known, found, then, ["text", "size", "place", "window", "row", "id"])

    def _text(self, row: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([_whole(row), np.zeros(10 * self.s, np.uint8)])

    def _sampled(self, row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the windows, the places of classes 1 and 2 that their comparison needs, and those whose triples need names."""
        place, s = _risen(row["place"][0].as_py()), self.s
        kind = place // s % 3
        sample = _different([place[kind > 0], place[kind < 2] + s, place[kind != 1] + 2 * s])
        return place, sample, _different([sample, sample + 3 * s, sample + 6 * s])

    def _triples(self, row: pa.RecordBatch) -> _Keys:
        words = _at(self._text(row), self._sampled(row)[2], 3 * self.s)
        return _Keys(words, self.rest[1] // 8, self.buckets)

    def named(self, rows: DataFrame) -> DataFrame:
        """Names of the sampled triples of letters, those of their beginnings beside them."""
        dealt = self._mapped(rows.select("batch", "text", "size", "place"), lambda row: self._triples(row).dealt(lambda k: _rows(k, 3 * self.s)))

        def answer(keys: np.ndarray, _: None, bucket: int) -> tuple[np.ndarray, ...]:
            order, _ = _sorted_groups(keys)
            return tuple(_names(order, x[order], bucket) for x in (keys, _prefix(keys, self.rest[0]), _prefix(keys, self.rest[1])))

        found = _answered(dealt, self.buckets, lambda data, _: _words(data, 3 * self.s), answer, 3)

        def then(row: pa.RecordBatch, answers: pa.Table) -> list[bytes]:
            keys, (place, sample, places) = self._triples(row), self._sampled(row)
            whole, more, less = (_collected(answers, 0, f"a{k}")[keys.which] for k in range(3))
            one, two, three = (np.searchsorted(places, sample + 3 * self.s * k) for k in range(3))
            few = _at(self._text(row), sample + 6 * self.s, 8)[:, 0] >> np.uint64(64 - 8 * self.rest[2]) if self.rest[2] else np.zeros(len(sample), np.uint64)
            ids, own = np.full(len(sample), LAST), place // self.s % 3 > 0
            ids[np.searchsorted(sample, place[own])] = _risen(row["id"][0].as_py())[own]  # only windows count
            # a beginning before what it begins, so that sorted keys are sorted by all of them
            suffixes = _Keys(np.stack([whole[one], whole[two], few.astype(np.int64), less[three], more[three]], axis=1).astype(np.uint64), 3, self.buckets, ids)
            return [_pack(suffixes.which), _pack(suffixes.ids), suffixes.dealt(_columns)]

        return self._joined(rows.select("batch", "text", "size", "place", "id"), found, then, ["which", "least"], dealt=True)

    def ranked(self, rows: DataFrame, named: DataFrame) -> DataFrame:
        """Of the sampled windows, which are repeats of sampled ones; ranks by h - s and h - 2s bytes."""
        def answer(keys: np.ndarray, ids: np.ndarray, bucket: int) -> tuple[np.ndarray, ...]:
            order, _ = _sorted_groups(keys)
            return _earlier(keys, ids), *(_names(order, keys[order][:, :k], bucket) for k in (4, 3))

        found = _answered(named, self.buckets, lambda data, _: _from_columns(data), answer, 3)

        def then(row: pa.RecordBatch, answers: pa.Table) -> list[bytes]:
            place, sample, _ = self._sampled(row)
            every, least = _unpack(row["which"][0].as_py()), _unpack(row["least"][0].as_py())
            ids, rows_ = _risen(row["id"][0].as_py()), _risen(row["row"][0].as_py())
            earlier, longer, shorter = (_collected(answers, 0, f"a{k}") for k in range(3))
            own = np.flatnonzero(place // self.s % 3 > 0)
            which = every[np.searchsorted(sample, place[own])]
            gone = np.zeros(len(place), np.int64)
            gone[own] = _repeats(which, ids[own], rows_[own], earlier, least)
            return [_pack(gone), _pack(longer[every]), _pack(shorter[every]), *(row[n][0].as_py() for n in ("text", "size", "place", "window", "row", "id"))]

        kept = named.select(F.col("batch").alias("b"), "which", "least")
        return self._joined(rows.join(kept, F.col("b") == F.col("batch")).drop("b"), found, then, ["gone", "longer", "shorter", "text", "size", "place", "window", "row", "id"])

    def _merged(self, row: pa.RecordBatch) -> Iterator[tuple[np.ndarray, _Keys]]:
        """The two lists in which class 0 meets class 1 and class 2: their windows and their keys."""
        place, sample, _ = self._sampled(row)
        ids, data = _risen(row["id"][0].as_py()), self._text(row)
        for letters, other, ranks in ((1, 2, "longer"), (2, 1, "shorter")):
            own = np.flatnonzero(place // self.s % 3 != other)
            rank = _unpack(row[ranks][0].as_py(), np.uint64)[np.searchsorted(sample, place[own] + letters * self.s)]
            keys = np.concatenate([_at(data, place[own], letters * self.s), rank[:, None]], axis=1)
            yield own, _Keys(keys, keys.shape[1], self.buckets, ids[own])

    def repeats(self, rows: DataFrame) -> DataFrame:
        """For each batch the windows that are repeats, of those that were sorted."""

        def emit(row: pa.RecordBatch) -> list[dict]:
            return [x for tag, (_, keys) in enumerate(self._merged(row)) for x in keys.dealt(lambda k: _rows(k, 8 * k.shape[1]), tag)]

        dealt = self._mapped(rows.select("batch", "longer", "shorter", "text", "size", "place", "id"), emit)
        widths = [8 * (-(-k * self.s // 8) + 1) for k in (1, 2)]
        found = _answered(dealt, self.buckets, lambda data, tag: _words(data, widths[tag]), lambda keys, ids, _: (_earlier(keys, ids),), 1)

        def then(row: pa.RecordBatch, answers: pa.Table) -> list[bytes]:
            ids, rows_ = _risen(row["id"][0].as_py()), _risen(row["row"][0].as_py())
            gone = _unpack(row["gone"][0].as_py()) > 0
            for tag, (own, keys) in enumerate(self._merged(row)):
                gone[own] |= _repeats(keys.which, ids[own], rows_[own], _collected(answers, tag, "a0"), keys.ids)
            return [_rising(_risen(row["window"][0].as_py())[gone])]

        return self._joined(rows, found, then, ["windows"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_bytes: int = H, gram: int = GRAM, batch_bytes: int = BATCH, bucket_bytes: int = BUCKET, parts: int = PARTS) -> DataFrame:
    """doc_id, n_bytes, spans (start and length of what goes, in bytes) and kept (the other bytes).

    A byte goes if a string of min_bytes that covers it also starts in a row of a smaller id, or
    earlier in its own row; the rows are judged as they came. A row for each row; ids are whole
    numbers, null ones after all others; rows that share an id do not judge each other. Null and empty
    texts have no bytes, texts shorter than min_bytes stay whole; texts of any length are one piece of
    a batch. Other columns are not read; an empty table gives no rows."""
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    of = Repeats(min_bytes, gram, batch_bytes, math.ceil(max(1, size) / bucket_bytes))
    # buckets by batch: the texts are joined twice with what is found, and never shuffled
    held = bucketed(of.held(rows), max(of.buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "batch")
    contested = swept(written(of.contested(held)))
    found = contested.select(F.col("batch").alias("of"), "copied", "copied_n")
    for part in range(parts):
        narrowed = swept(written(of.narrowed(contested, part, parts)))
        named = swept(written(of.named(narrowed)))
        ranked = swept(written(of.ranked(narrowed, named)))
        forget(narrowed, named)
        gone = swept(written(of.repeats(ranked)))
        forget(ranked)
        found = found.join(gone.select(F.col("batch").alias("of"), F.col("windows").alias(f"windows{part}")), "of")
    kind = rows.schema["doc"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("kept", T.BinaryType())])

    def run(batch: pa.Table, gone: pa.Table) -> pa.Table:
        row, known = batch.combine_chunks().to_batches()[0], gone.combine_chunks().to_batches()[0]
        data = pa.Codec("zstd").decompress(row["text"][0].as_py(), decompressed_size=row["size"][0].as_py(), asbytes=True)
        windows = np.concatenate([_risen(known[f"windows{part}"][0].as_py()) for part in range(parts)])
        start = np.concatenate([_risen(known["copied"][0].as_py()), windows])
        length = np.concatenate([_unpack(known["copied_n"][0].as_py()), np.ones(len(windows), np.int64)]) + min_bytes - 1
        cover = np.zeros(len(data) + 1, np.int32)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + length, -1)
        sizes = row["bytes"].slice(0, 1).flatten().to_numpy()
        ends = np.cumsum(sizes)
        out = np.cumsum(cover[:-1]) > 0
        cut = np.zeros(len(data) + 1, bool)
        cut[ends] = cut[0] = True  # a run ends where its text ends
        edge = np.r_[False, out, False]
        begins = np.flatnonzero(edge[1:-1] & (~edge[:-2] | cut[:-1]))
        stops = np.flatnonzero(edge[1:-1] & (~edge[2:] | cut[1:])) + 1
        owner = np.searchsorted(ends, begins, "right")
        lists = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(sizes)))]
        spans = pa.StructArray.from_arrays([pa.array(begins - (ends - sizes)[owner]), pa.array(stops - begins)], names=SPAN.names)
        raw = np.frombuffer(data, np.uint8)
        kept = [raw[e - n : e][~out[e - n : e]].tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]
        return pa.table([row["docs"].slice(0, 1).flatten(), pa.array(sizes), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), spans), pa.array(kept, pa.binary())], names=schema.names)

    return held.select("batch", "docs", "bytes", "size", "text").groupBy("batch").cogroup(found.groupBy("of")).applyInArrow(run, schema)


def op12_suffixes(spark, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 100 bytes that also start earlier."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.reduce("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
