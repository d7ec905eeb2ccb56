"""Periodic runs of words: a suffix automaton whose tree of suffix links is kept as link-cut paths.

Words are appended one by one. The states on the way from the new prefix to the root are the
suffixes of the text read so far, and a path of them that was last recoloured together ended last at
the same word. Access walks over those paths: one of colour c whose longest string has L words says
that the L words before the new end stood d = end - c words earlier as well. If d <= L the two
occurrences touch, which is a square; the L + d words they cover are a stretch with smallest period
d that goes as far left as it can, and its last report goes as far right as it can: a run.

Most words of plain text cannot be in a run's later periods, where every word has occurred within
the last period and a third of the stretch is at least a period. Only the stretches that this leaves,
with a margin to their left, are appended to an automaton; nothing is lost by it (see _stretches).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylode.llm.common import table

#: A run has at least so many words, and so many times its period.
WORDS, TIMES = 6, 4
#: Rounds that narrow stretches down; what they leave is read by the automaton, be it more or less.
ROUNDS = 12

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


class Paths:
    """The tree of suffix links as paths of one colour each, every path a splay tree by depth. The
    colour of a path stands at the root of its splay tree; node 0 is none."""

    def __init__(self):
        self.up, self.left, self.right, self.colour = [0, 0], [0, 0], [0, 0], [0, 0]

    def add(self, parent: int) -> int:
        for field, value in ((self.up, parent), (self.left, 0), (self.right, 0), (self.colour, 0)):
            field.append(value)
        return len(self.up) - 1

    def splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        top, p = x, up[x]
        while p and (left[p] == top or right[p] == top):
            top, p = p, up[p]
        self.colour[x] = self.colour[top]
        while up[x] != p:
            y = up[x]
            z = up[y]
            if z != p:  # zig-zig turns the parent first, zig-zag the node twice
                self._turn(y if (left[z] == y) == (left[y] == x) else x)
            self._turn(x)

    def _turn(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if left[y] == x:
            b = left[y] = right[x]
            right[x] = y
        else:
            b = right[y] = left[x]
            left[x] = y
        if b:
            up[b] = y
        up[y], up[x] = x, z
        if z:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x

    def split_above(self, q: int) -> int:
        """A new node right above q, in q's path: what q's shorter strings become when a state is cloned."""
        self.splay(q)
        x = self.add(q)
        b = self.left[x] = self.left[q]
        if b:
            self.up[b] = x
        self.left[q] = x
        return x

    def access(self, x: int, colour: int) -> Iterator[tuple[int, int]]:
        """(deepest node, former colour) of each path on the way to the root, which becomes one path."""
        up, right, below = self.up, self.right, 0
        while x:
            self.splay(x)
            yield x, self.colour[x]
            if right[x]:
                self.colour[right[x]] = self.colour[x]
            right[x] = below
            below, x = x, up[x]
        self.colour[below] = colour


def squares(ids: list[int], words: int = WORDS, times: int = TIMES) -> dict[tuple[int, int], int]:
    """(start, period) to last word of every stretch with that smallest period of at least so many
    words and periods; neither end can be extended within ids."""
    paths, found = Paths(), {}
    link, length, after = [0, 0], [0, 0], [{}, {}]
    state = 1
    for i, w in enumerate(ids, 1):  # ends count from 1: colour 0 means never
        p, state = state, paths.add(0)
        link.append(0)
        length.append(i)
        after.append({})
        while p and w not in after[p]:
            after[p][w] = state
            p = link[p]
        parent = 1
        if p:
            parent = q = after[p][w]
            if length[q] != length[p] + 1:
                parent = paths.split_above(q)
                link.append(link[q])
                length.append(length[p] + 1)
                after.append(dict(after[q]))
                link[q] = parent
                while p and after[p].get(w) == q:
                    after[p][w] = parent
                    p = link[p]
        link[state] = paths.up[state] = parent
        for x, colour in paths.access(state, i):
            if colour:
                far, size = i - colour, length[x]
                if far <= size and size + far >= words and size >= (times - 1) * far:
                    found[i - far - size, far] = i - 1
    return found


def _stretches(ids: np.ndarray, words: int, times: int) -> list[tuple[int, int]]:
    """(begin, end) of all that may hold runs. The words of a run after its first period q have each
    occurred at most q words earlier, and there are (times - 1) * q of them: a word whose last
    occurrence is further away than that share of the stretch around it ends the stretch."""
    n = len(ids)
    by = np.argsort(ids, kind="stable")
    far = np.full(n, n + 1)
    same = ids[by[1:]] == ids[by[:-1]]
    far[by[1:][same]] = (by[1:] - by[:-1])[same]
    least = min(max(words - q, (times - 1) * q) for q in range(1, words + 1))
    on = far <= n // times
    for _ in range(ROUNDS):
        edges = np.flatnonzero(np.diff(np.r_[False, on, False]))
        begins, ends = edges[::2], edges[1::2]
        sizes = ends - begins
        before = int(sizes.sum())
        sizes[sizes < least] = 0
        on &= far <= _placed(n, begins, ends - begins, sizes // (times - 1))
        if int(on.sum()) == before:
            break
    edges = np.flatnonzero(np.diff(np.r_[False, on, False]))
    return [(max(0, b - (e - b) // (times - 1)), e) for b, e in zip(edges[::2].tolist(), edges[1::2].tolist()) if e - b >= least]


def _placed(n: int, begins: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values at the places of their stretches, zero elsewhere."""
    steps = np.zeros(n + 1, np.int64)
    steps[begins] += values
    steps[begins + sizes] -= values  # no stretch begins where another ends
    return np.cumsum(steps[:-1])


def runs(words: list, least: int = WORDS, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words, by start, then period."""
    if len(words) < least:
        return []
    number: dict = {}
    name = number.setdefault
    listed = [name(w, len(number)) for w in words]
    ids, found = np.array(listed, np.int64), set()
    for begin, end in _stretches(ids, least, times):
        for (start, period), last in squares(listed[begin:end], least, times).items():
            start, last = start + begin, last + begin
            while start and listed[start - 1] == listed[start - 1 + period]:  # a stretch may cut a run of its neighbour
                start -= 1
            while last + 1 < len(listed) and listed[last + 1] == listed[last + 1 - period]:
                last += 1
            found.add((start, last - start + 1, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = WORDS, times: int = TIMES) -> DataFrame:
    """doc_id, runs (start, length, period, in words, by start, then period) and collapsed: the text
    without the words of any run after its first period, joined by one space.

    A row for each row, which a task reads alone, whatever its length; null and empty texts have no
    runs and collapse to the empty text, repeated rows get equal results. Other columns are not read.
    """
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, collapsed = [], []
            for t in b.column(1):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                found.append(runs(words, least, times))
                if found[-1]:
                    kept = np.ones(len(words), bool)
                    for start, length, period in found[-1]:
                        kept[start + period : start + length] = False
                    words = [words[i] for i in np.flatnonzero(kept).tolist()]
                collapsed.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            sizes = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            flat = np.array([r for one in found for r in one], np.int64).reshape(-1, 3)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=RUN.names)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(sizes, structs), pa.array(collapsed, pa.string())], schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _with(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def repeated_words(text: Column, doc_id: Column) -> Column:
    """The text whose words from a on repeat the first p of them where crc32 of the id, h, is
    divisible by 10: a = g % n, p = 1 + floor((n - a) / (3 + g % 8)), g = floor(h / 10)."""
    h = F.crc32(doc_id.cast("string").cast("binary"))

    def made(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        return _with(g % n, lambda a: _with(F.floor((n - a) / (g % 8 + 3)) + 1, lambda p: F.transform(words, lambda w, i: F.when(i >= a, F.get(words, (a + (i - a) % p).cast("int"))).otherwise(w))))

    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(h % 10 == 0, _with(split, lambda words: F.when(F.size(words) > 0, F.array_join(made(words), " ")).otherwise(F.lit("")))).otherwise(text)


def op11_periodic(spark, sf_dir: str) -> DataFrame:
    """The runs of every document, a tenth of which are made periodic first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", repeated_words(F.col("text"), F.col("doc_id")).alias("text"))
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat_ws("", F.transform(lines, lambda s: F.concat(s, F.lit("\n"))))
    found = find_runs(docs).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
