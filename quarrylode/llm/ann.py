"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard of vectors.

Largest inner product is smallest distance once every vector gets one more component that brings
all to one length, and queries a zero there. In each shard the graph starts with random edges; a
greedy search from the centre proposes neighbours for every vector, and relaxed distance pruning
keeps those that no kept neighbour is much closer to. Queries run a beam search in every shard;
their scores are exact, on the original vectors. Equal vectors are one point of the graph.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylode.llm.common import table, written

#: Vectors of a shard, queries of a block: what one task holds.
SHARD, QUERY_BLOCK = 8192, 4096
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX = 24, 48, 96, 1.2
STEP = 1024
SALTS = 64


class Graph:
    """A directed graph over the vectors of one shard."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray | None = None, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX):
        length = (vectors.astype(np.float64) ** 2).sum(1)
        top = float(length.max()) if len(vectors) else 0.0
        self.points = np.concatenate([vectors, np.sqrt(np.maximum(top - length, 0.0))[:, None]], 1).astype(np.float32)
        self.degree, n = degree, len(vectors)
        centre = self.points.mean(0) if n else None
        self.entry = int(np.argmin(((self.points - centre) ** 2).sum(1))) if n else 0
        if edges is not None:
            self.edges = edges
            return
        rng = np.random.default_rng(n)
        self.edges = rng.integers(0, max(n, 1), (n, degree)).astype(np.int32)
        self.edges[self.edges == np.arange(n)[:, None]] = -1
        if n <= degree + 1:
            full = np.tile(np.arange(n, dtype=np.int32), (n, 1))
            full[np.arange(n), np.arange(n)] = -1
            self.edges = np.pad(full, ((0, 0), (0, max(0, degree - n))), constant_values=-1)
            return
        for a in (1.0, relax):
            order = rng.permutation(n)
            for k in range(0, n, STEP):
                self._insert(order[k : k + STEP], beam, a)

    def _insert(self, block: np.ndarray, beam: int, relax: float) -> None:
        found, _ = self.search(self.points[block], beam)
        self.edges[block] = self._prune(block, np.concatenate([found, self.edges[block]], 1), relax)
        into, source = self.edges[block].ravel(), np.repeat(block, self.degree)
        into, source = into[into >= 0], source[into >= 0]
        order = np.argsort(into, kind="stable")
        into, source = into[order], source[order]
        nodes, first, n = np.unique(into, return_index=True, return_counts=True)
        most = 3 * self.degree
        for k in range(0, len(nodes), STEP):
            part, width = nodes[k : k + STEP], int(min(n[k : k + STEP].max(), most))
            more = np.full((len(part), width), -1, np.int32)
            for i, (f, c) in enumerate(zip(first[k : k + STEP], n[k : k + STEP], strict=True)):
                more[i, : min(c, width)] = source[f : f + min(c, width)]
            both = np.concatenate([self.edges[part], more], 1)
            used = (both >= 0).sum(1)
            small = used <= self.degree
            if small.any():
                packed = np.take_along_axis(both[small], np.argsort(both[small] < 0, axis=1, kind="stable"), 1)
                self.edges[part[small]] = packed[:, : self.degree]
            if (~small).any():
                self.edges[part[~small]] = self._prune(part[~small], both[~small], relax)

    def _prune(self, block: np.ndarray, candidates: np.ndarray, relax: float) -> np.ndarray:
        """Of each vector's candidates, nearest first, those that no kept one is closer to by the
        relaxed factor."""
        at = self.points[block]
        near = self.points[candidates]
        d = ((near - at[:, None]) ** 2).sum(2)
        d[(candidates < 0) | (candidates == block[:, None])] = np.inf
        order = np.argsort(d, axis=1, kind="stable")
        d, candidates = np.take_along_axis(d, order, 1), np.take_along_axis(candidates, order, 1)
        near = np.take_along_axis(near, order[:, :, None], 1)
        length = (near**2).sum(2)
        apart = np.maximum(length[:, :, None] + length[:, None] - 2 * np.matmul(near, near.transpose(0, 2, 1)), 0)
        alive, rows = np.isfinite(d), np.arange(len(block))
        kept = np.full((len(block), self.degree), -1, np.int32)
        for r in range(self.degree):
            pick = alive.argmax(1)
            some = alive[rows, pick]
            if not some.any():
                break
            kept[some, r] = candidates[rows, pick][some]
            alive &= ~((relax * relax * apart[rows, pick] <= d) | (candidates == candidates[rows, pick][:, None])) | ~some[:, None]
        return kept

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query (points with their added component), nearest first: indices (-1
        for none) and squared distances less the query's length."""
        found, far = np.full((len(queries), beam), -1, np.int32), np.full((len(queries), beam), np.inf, np.float32)
        for k in range(0, len(queries), STEP):
            found[k : k + STEP], far[k : k + STEP] = self._beam(queries[k : k + STEP].astype(np.float32), beam)
        return found, far

    def _beam(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        length = (self.points**2).sum(1)
        ids, d = np.full((len(q), beam), -1, np.int32), np.full((len(q), beam), np.inf, np.float32)
        done = np.ones((len(q), beam), bool)
        ids[:, 0], d[:, 0], done[:, 0] = self.entry, length[self.entry] - 2 * q @ self.points[self.entry], False
        while True:
            rows = np.flatnonzero(~done.all(1))
            if not len(rows):
                return ids, d
            pick = np.argmin(np.where(done[rows], np.inf, d[rows]), 1)
            done[rows, pick] = True
            new = self.edges[ids[rows, pick]]
            nd = length[new] - 2 * np.einsum("ard,ad->ar", self.points[new], q[rows])
            sorted_new = np.sort(new, 1)
            twice = np.zeros(new.shape, bool)
            if (sorted_new[:, 1:] == sorted_new[:, :-1]).any():
                first = (new[:, :, None] == new[:, None]).argmax(2)
                twice = first != np.arange(new.shape[1])
            old = (new[:, :, None] == ids[rows][:, None]).any(2)
            nd[(new < 0) | old | twice] = np.inf
            all_d = np.concatenate([d[rows], nd], 1)
            all_i = np.concatenate([ids[rows], np.where(np.isfinite(nd), new, -1)], 1)
            all_done = np.concatenate([done[rows], ~np.isfinite(nd)], 1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            ids[rows], d[rows], done[rows] = (np.take_along_axis(x, order, 1) for x in (all_i, all_d, all_done))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, vec (doubles): rows that take part. Null vectors, zero ones, those with null or
    non-finite components and those without the commonest length do not."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("id"), v.alias("vec")).filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vec") == (sizes["n"] if sizes else 0))


def build_index(rows: DataFrame, keep: int, shard: int = SHARD) -> DataFrame:
    """shard, at, vec, ids, edges: the graphs' points; ids are the smallest ids with that vector.

    Ids are first cut to keep in salted parts of a vector's rows, so that a vector that very many
    rows share is no task of its own; keep ids of equal vectors are all that a result can hold.
    """
    salted = Window.partitionBy("vec", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy("id")
    first = rows.withColumn("rn", F.row_number().over(salted)).filter(F.col("rn") <= keep)
    points = written(first.groupBy("vec").agg(F.slice(F.array_sort(F.collect_list("id")), 1, keep).alias("ids")))
    shards = max(1, math.ceil(points.count() / shard))
    placed = points.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int"))
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("at", T.IntegerType()), *[points.schema[c] for c in ("vec", "ids")], T.StructField("edges", T.ArrayType(T.IntegerType()))])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(key=[x[0] for x in pdf["ids"]]).sort_values("key").reset_index(drop=True)
        graph = Graph(np.stack(pdf["vec"].to_numpy()))
        return pd.DataFrame({"shard": pdf["shard"], "at": np.arange(len(pdf), dtype=np.int32), "vec": pdf["vec"], "ids": pdf["ids"], "edges": list(graph.edges)})

    return written(placed.groupBy("shard").applyInPandas(build, schema))


def search_index(index: DataFrame, queries: DataFrame, keep: int, beam: int = SEARCH_BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """q, id, score: for each vec of queries the keep best ids of every shard.

    Queries go in blocks to every shard, so a task holds one shard and one block.
    """
    shards = index.agg(F.max("shard")).first()[0]
    shards = 0 if shards is None else shards + 1
    blocks = max(1, math.ceil(queries.count() / block))
    asked = queries.select(F.col("vec").alias("q")).withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(shards - 1, 0)))))
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("q", T.ArrayType(T.DoubleType())), T.StructField("id", kind), T.StructField("score", T.DoubleType())])

    def run(points: pd.DataFrame, wanted: pd.DataFrame) -> Iterable[pd.DataFrame]:
        if not len(points) or not len(wanted):
            return pd.DataFrame({"q": [], "id": [], "score": []})
        points = points.sort_values("at").reset_index(drop=True)
        vectors, q = np.stack(points["vec"].to_numpy()), np.stack(wanted["q"].to_numpy())
        graph = Graph(vectors, np.stack(points["edges"].to_numpy()).astype(np.int32))
        found, _ = graph.search(np.concatenate([q, np.zeros((len(q), 1))], 1), max(beam, 2 * keep))
        out_q, out_id, out_s = [], [], []
        for i, hit in enumerate(found):
            hit = hit[hit >= 0]
            exact = vectors[hit] @ q[i] if len(hit) else np.empty(0)
            rows = sorted((-s, k) for h, s in zip(hit[np.argsort(-exact)][:keep], np.sort(-exact)[:keep] * -1, strict=True) for k in points["ids"][h])[:keep]
            out_q += [q[i]] * len(rows)
            out_id += [k for _, k in rows]
            out_s += [-s for s, _ in rows]
        return pd.DataFrame({"q": out_q, "id": out_id, "score": out_s})

    return asked.groupBy("shard", "block").cogroup(copies.groupBy("shard", "block")).applyInPandas(lambda wanted, points: run(points, wanted), schema)


def nearest(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each query row.

    A query is no candidate of its own; ties go to the smaller id; ids are taken to be unique.
    """
    rows = written(usable(vectors.withColumn("_ql_query", is_query), vec_id, embedding))
    chosen = vectors.filter(is_query).select(F.col(vec_id).alias("id")).distinct()
    asking = written(rows.join(chosen, "id", "left_semi"))
    index = build_index(rows, k + 1)
    hits = search_index(index, asking.select("vec").distinct(), k + 1)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    top = hits.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k + 1)
    lists = top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("hits"))
    joined = asking.join(lists, asking["vec"] == lists["q"]).select(F.col("id").alias("query_id"), F.slice(F.filter("hits", lambda h: h["id"] != F.col("id")), 1, k).alias("hits"))
    return joined.select("query_id", F.posexplode("hits").alias("p", "h")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("h.id").alias("vec_id"), (-F.col("h.s")).alias("score"))


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings for every one whose vec_id divides by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
