"""Benchmark decontamination by latent semantic retrieval and exact checks.

Terms are the words of the benchmark's items; their document frequencies are counted over all
documents. A randomised SVD of the TF-IDF passages of all items and of all documents, its products
summed by Spark, gives a latent space. Every passage of every document is
compared there with every part of an item, in matrix products over a batch of documents; those of a
high enough cosine are candidates, and only they are verified, by the longest common subsequence of
words and by the item's answer, its rarest words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylode.llm.common import forget, table, written
from quarrylode.llm.suffixes import _pack, _unpack

WORD = re.compile(r"[^\W_]+")
#: Words of half a passage; a passage is two neighbouring halves, so passages overlap by one.
HALF = 16
#: Dimensions of the latent space and more of the sketch; terms of passages multiplied at once.
DIMENSIONS, MORE, PIECE = 96, 16, 8192
#: Terms in more than this share of documents carry no weight in the latent space. Items whose words
#: are on average no rarer than that are searched by their words instead.
COMMON = 0.1
#: A candidate: cosine, and share of the latent length that the passage covers, both of a part of
#: the item; parts have a passage's words at most.
COSINE, COVER = 0.4, 0.3
#: A leak: share of the item's words in the longest common subsequence, and of its answer's words.
OVERLAP, ANSWER = 0.5, 0.5
#: Items, and bytes of them, compared in one pass over the documents.
ITEMS, ITEM_BYTES = 20_000, 64 << 20
#: Texts read together, and numbers in one product of passages and parts.
TEXTS, PRODUCT = 256, 1 << 21


#: Latin-1 with a space for each character that is of no word.
LATIN = bytes(c if WORD.match(chr(c)) else 32 for c in range(256))


def words(text: str | None) -> list[str]:
    text = (text or "").lower()
    try:
        return text.encode("latin-1").translate(LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORD.findall(text)


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over the words of a."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if m := places.get(w):
            hit = row & m
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal numbers begins and ends."""
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)
    return starts, np.append(starts[1:], len(x))[: len(starts)]


@dataclass
class Index:
    """The items of a block in the latent space; what tasks need to search it."""

    ids: list
    items: list[list[str]]
    terms: dict[str, int]
    weight: np.ndarray
    rarity: np.ndarray
    latent: np.ndarray | None = None
    vectors: np.ndarray | None = None
    length: np.ndarray | None = None
    owner: np.ndarray | None = None
    answers: list[list[str]] = field(default_factory=list)
    #: Terms of each answer, filled up with the number of all terms, and how many of them a leak needs.
    asked: np.ndarray | None = None
    needed: np.ndarray | None = None
    common: dict[int, np.ndarray] = field(default_factory=dict)

    def ask(self) -> None:
        """The answer of each item: its rarest third of words. Items of common words, as those leaked
        into many documents are, are kept with their terms: latent vectors do not tell them."""
        for i, ws in enumerate(self.items):
            rare = sorted(set(ws), key=lambda w: (-self.rarity[self.terms[w]], w))
            self.answers.append(rare[: max(1, len(rare) // 3)])
            own = self.terms_of(ws)
            if self.rarity[own].mean() < -math.log(COMMON):
                self.common[i] = np.unique(own)
        self.asked = np.full((len(self.items), max(map(len, self.answers))), len(self.terms))
        for i, answer in enumerate(self.answers):
            self.asked[i, : len(answer)] = self.terms_of(answer)
        self.needed = np.array([ANSWER * len(a) for a in self.answers])

    def terms_of(self, tokens: list[str]) -> np.ndarray:
        """The term of each token, -1 for none."""
        return np.fromiter(map(self.terms.get, tokens, repeat(-1)), np.int32, len(tokens))

    def placed(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(places, terms) of the tokens that carry weight."""
        at = self.terms_of(tokens)
        places = np.flatnonzero(at >= 0)
        places = places[self.weight[at[places]] > 0]
        return places, at[places]

    def search(self, texts: list[np.ndarray]) -> list[list[tuple[int, float, int]]]:
        """For each text, given by its terms, the (item, cosine, place) of candidate passages."""
        found: list[list[tuple[int, float, int]]] = [self._by_words(at) for at in texts]
        doc, item, cosine, place = self._by_vectors(texts)
        for s, e in zip(*_runs(doc), strict=True):
            keep = self._answered(texts[doc[s]], item[s:e])
            found[doc[s]] += zip(item[s:e][keep].tolist(), cosine[s:e][keep].tolist(), place[s:e][keep].tolist(), strict=True)
        return found

    def _answered(self, at: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Which items' answers a whole text has enough words of; no passage of it has more."""
        there = np.zeros(len(self.terms) + 1, bool)
        there[at] = True  # an unknown term's -1 is the last place, as is the filling's
        there[-1] = False
        return there[self.asked[items]].sum(1) >= self.needed[items]

    def _by_words(self, at: np.ndarray) -> list[tuple[int, float, int]]:
        """Places of items of common words: all whose surroundings, as leaks() reads them, have
        enough words of the item for the common subsequence. No cosine tells them apart."""
        found, starts = [], np.arange(0, len(at), HALF)
        for i, own in self.common.items():
            n, mark = len(self.items[i]), np.zeros(len(self.terms) + 1, bool)
            mark[own] = True  # an unknown term's -1 is the last place
            sums = np.concatenate([[0], np.cumsum(mark[at])])
            there = sums[np.minimum(starts + 2 * HALF + n, len(at))] - sums[np.maximum(starts - n, 0)]
            found += [(i, 0.0, int(p)) for p in starts[there >= OVERLAP * n]]
        return found

    def _by_vectors(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(texts, items, cosines, places), by text, of the passages near a part of an item."""
        sizes = np.array([len(at) for at in texts], np.int64)
        halves = -(-sizes // HALF) + 1  # one more: the last half of a text has no neighbour
        first, begin = np.cumsum(halves) - halves, np.cumsum(sizes) - sizes
        at = np.concatenate([*texts, np.empty(0, np.int32)])
        places = np.flatnonzero((at >= 0) & (self.weight[at] > 0))
        doc = np.repeat(np.arange(len(texts)), sizes)[places]
        half = first[doc] + (places - begin[doc]) // HALF
        cut = _runs(half)[0]
        half = half[cut]
        rows, out = max(64, PRODUCT // len(self.owner)), []
        for k in range(0, len(half), rows):
            own = half[k : k + rows + 1]  # and the one after, for the last passage
            ends = np.append(cut, len(places))[[k, k + len(own)]]
            sums = np.add.reduceat(self.latent[at[places[ends[0] : ends[1]]]], cut[k : k + len(own)] - ends[0], axis=0)
            passages = sums.copy()
            follows = np.flatnonzero(own[1:] == own[:-1] + 1)
            passages[follows] += sums[follows + 1]
            passages = passages[:rows]
            norm = np.sqrt((passages**2).sum(1)) + 1e-12
            dots = passages @ self.vectors.T
            p, i = np.divmod(np.flatnonzero(dots >= COVER * self.length), len(self.owner))
            near = dots[p, i] >= COSINE * norm[p]
            p, i = p[near], i[near]
            d = doc[cut[k + p]]
            out.append((d, self.owner[i], dots[p, i] / norm[p], (own[p] - first[d]) * HALF))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 4

    def leaks(self, texts: list[str | None]) -> list[list[dict]]:
        """The items that each text leaks, with cosine, overlap and answer, best passage each."""
        split = [words(t) for t in texts]
        return [self._verified(tokens, found) for tokens, found in zip(split, self.search([self.terms_of(x) for x in split]), strict=True)]

    def _verified(self, tokens: list[str], found: list[tuple[int, float, int]]) -> list[dict]:
        best: dict[int, tuple[float, float, float]] = {}
        for i, cosine, at in found:
            item, answer = self.items[i], self.answers[i]
            near = tokens[max(0, at - len(item)) : at + 2 * HALF + len(item)]
            seen = set(near)
            given = sum(w in seen for w in answer) / len(answer)
            if given < ANSWER:
                continue
            overlap = common_length(item, near) / len(item)
            if overlap >= OVERLAP and (overlap, cosine) > best.get(i, (0.0, 0.0))[:2]:
                best[i] = (overlap, cosine, given)
        return [{"item_id": self.ids[i], "overlap": o, "cosine": c, "answer": g} for i, (o, c, g) in sorted(best.items())]


#: A row of passages(): of some texts in order, the different terms of each passage, by passage, and how
#: often it has them; how many each passage has; how many passages each text has.
PASSAGES = T.StructType([T.StructField(n, T.BinaryType()) for n in ("term", "times", "size", "held")])


def counted(texts: list[list[str]], terms: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A row of passages() for texts given by their words."""
    sizes = np.array([len(ws) for ws in texts], np.int64)
    held, begin = -(-sizes // (2 * HALF)), np.cumsum(sizes) - sizes
    at = np.fromiter(map(terms.get, chain.from_iterable(texts), repeat(-1)), np.int64, sizes.sum())
    passage = np.repeat(np.cumsum(held) - held, sizes) + (np.arange(len(at)) - np.repeat(begin, sizes)) // (2 * HALF)
    key, times = np.unique((passage * len(terms) + at)[at >= 0], return_counts=True)
    passage, term = np.divmod(key, len(terms))
    return term, times, np.bincount(passage, minlength=held.sum()), held


def passages(docs: DataFrame, text: str, terms: dict[str, int]) -> DataFrame:
    """The terms of all passages of all documents, TEXTS documents in a row at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, TEXTS):
                row = counted([words(t) for t in b.column(0).slice(k, TEXTS).to_pylist()], terms)
                yield pa.RecordBatch.from_arrays([pa.array([_pack(x)], pa.binary()) for x in row], PASSAGES.names)

    return docs.select(F.col(text).alias("text")).mapInArrow(run, PASSAGES)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(_unpack(c[i].as_py()) for c in b.columns)


def _frequencies(rows: DataFrame, terms: int) -> tuple[int, dict[int, int]]:
    """Documents, and how many have each term: at most a row for a term comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, np.zeros(terms, np.int64)
        for term, _, size, held in _read(batches):
            n += len(held)
            doc = np.repeat(np.repeat(np.arange(len(held)), held), size)
            seen += np.bincount(np.unique(doc * terms + term) % terms, minlength=terms)
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, there], pa.int32()), pa.array(np.r_[n, seen[there]], pa.int64())], ["term", "n"])

    found = {r["term"]: r["n"] for r in rows.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found.pop(-1, 0), found


def _product(rows: DataFrame, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A basis for the TF-IDF passages A of rows, each of length one: partial products, summed by term."""
    width, scaled = basis.shape[1], (weight[:, None] * basis).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, there = np.zeros(basis.shape), np.zeros(len(weight), bool)
        for term, times, size, _ in _read(batches):
            on = weight[term] > 0
            passage, term, times = (x[on] for x in (np.repeat(np.arange(len(size)), size), term, times))
            there[term] = True
            starts, ends = _runs(passage)
            square = np.add.reduceat((times * weight[term]) ** 2, starts) if len(starts) else starts
            # a term as often as a passage has it, so that sums need no factors
            bounds = np.r_[0, np.cumsum(times)]
            term, starts, ends = np.repeat(term, times), bounds[starts], bounds[ends]
            cuts = [*np.flatnonzero(np.diff(starts // PIECE, prepend=-1)).tolist(), len(starts)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                s, e = starts[i], ends[j - 1]
                sums = np.add.reduceat(scaled[term[s:e]], starts[i:j] - s, axis=0) / square[i:j, None].astype(np.float32)
                order = np.argsort(term[s:e], kind="stable")
                first = _runs(term[s:e][order])[0]
                total[term[s:e][order[first]]] += np.add.reduceat(sums[np.repeat(np.arange(j - i), ends[i:j] - starts[i:j])[order]], first, axis=0)
        total *= weight[:, None]
        found = np.flatnonzero(there)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * width, pa.int32()), pa.array(total[found].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), lists], ["term", "x"])

    sums = rows.mapInArrow(run, "term int, x array<double>").groupBy("term").agg(F.array(*[F.sum(F.col("x")[i]) for i in range(width)]).alias("x"))
    out = np.zeros_like(basis)
    for r in sums.collect():
        out[r["term"]] = r["x"]
    return out


def fit_index(docs: DataFrame, items: list[tuple], text: str = "text") -> Index | None:
    """The index of a block of (id, text) items; None if no item has a word."""
    texts = [(k, words(t)) for k, t in items]
    texts = [(k, ws) for k, ws in texts if ws]
    if not texts:
        return None
    terms = {w: i for i, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
    own = written(passages(docs, text, terms))
    n, seen = _frequencies(own, len(terms))
    share = np.array([(seen.get(i, 0) + 1) / (n + 2) for i in range(len(terms))])
    weight = np.where((share <= COMMON) | (n < 1 / COMMON), -np.log(share), 0.0)
    index = Index([k for k, _ in texts], [ws for _, ws in texts], terms, weight, -np.log(share))
    index.ask()
    asked = [tuple(map(_pack, counted([ws for _, ws in texts[k : k + TEXTS]], terms))) for k in range(0, len(texts), TEXTS)]
    rows = own.unionByName(docs.sparkSession.createDataFrame(asked, PASSAGES))
    width = min(DIMENSIONS + MORE, len(terms))
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((len(terms), width)))[0]
    basis = np.linalg.qr(_product(rows, weight, basis))[0]
    # A'A by its product with the basis (Nystrom): as near as a further pass would bring the basis itself
    product = _product(rows, weight, basis)
    forget(own)
    values, turn = np.linalg.eigh((basis.T @ product + product.T @ basis) / 2)
    some = values > 1e-9 * max(values.max(), 1e-9)
    latent = np.linalg.svd(product @ (turn[:, some] / np.sqrt(values[some])), full_matrices=False)[0][:, :DIMENSIONS]
    index.latent = (weight[:, None] * latent).astype(np.float32)
    parts = [(i, part) for i, (_, ws) in enumerate(texts) for part in np.array_split(ws, math.ceil(len(ws) / (2 * HALF)))]
    index.owner = np.array([i for i, _ in parts])
    vectors = np.zeros((len(parts), latent.shape[1]), np.float32)
    for k, (_, part) in enumerate(parts):
        _, t = index.placed(part.tolist())
        vectors[k] = index.latent[t].sum(0)
    index.length = np.sqrt((vectors**2).sum(1)) + 1e-9
    index.vectors = vectors / index.length[:, None]
    return index


def leaked(text: Column, index: Index, id_type: str) -> Column:
    """array<struct<item_id, overlap, cosine, answer>>: the items that a text column leaks."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = T.ArrayType(T.StructType.fromDDL(f"item_id {id_type}, overlap double, cosine double, answer double"))

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([x for k in range(0, len(texts), TEXTS) for x in index.leaks(texts.slice(k, TEXTS).to_pylist())], to_arrow_type(kind))

    return run(text)


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = ITEMS) -> DataFrame:
    """docs with leaks, the items found in each whole text (empty for null and empty texts).

    Items are read in blocks of their ids' hashes, of bounded size each; a block costs one pass.
    An item without words is never found; one with a null id is found as such; repeated items
    count once. A column leaks of docs is replaced. Rows are kept one for one.
    """
    id_type = benchmark.schema[item_id].dataType.simpleString()
    found = docs.withColumn("leaks", F.array().cast(f"array<struct<item_id:{id_type},overlap:double,cosine:double,answer:double>>"))
    size = benchmark.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0)).alias("bytes")).first()
    blocks = max(1, math.ceil(size["n"] / block * 1.2), math.ceil(size["bytes"] / ITEM_BYTES))
    for k in range(blocks):
        part = benchmark.filter(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == k).select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
        items = sorted({(r["i"], r["t"] or "") for r in part.collect()}, key=lambda x: (x[0] is None, str(x[0]), x[1]))
        if index := fit_index(docs, items, text):
            found = found.withColumn("leaks", F.concat("leaks", leaked(F.col(text), index, id_type)))
    return found


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id and item_id of every leak, with the shares that verify it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("x"))
    return found.select("doc_id", "x.item_id", "x.overlap", "x.cosine", "x.answer")
