"""Exact top-k search by inner product with MaxScore over impact-ordered postings.

Each component of a vector is a term. Within a shard of vectors a term's posting list is ordered
by impact and cut into bands, each with a bound. For a query, the bands that no vector outside
them could do without are essential: a vector found in none of them stays below the k-th best
score so far, as the bounds of the non-essential bands prove. Vectors of essential bands are
candidates; their other terms are probed in order of bound, and a candidate goes as soon as its
score so far and the bounds of what is left fall below the threshold. Shards are merged by a
window over each query's k best of every shard. A block of queries and a shard meet by a shuffle,
in tasks of bounded size: nothing is broadcast or passes through the driver.

Scores are whole numbers: components become ``floor(scale * x)``. Vectors that are null or hold a
null, NaN or infinity take no part, nor do rows without an id; shorter vectors count as padded with
zeros. Rows that bear the query's own id are no candidates of it; other repeated rows are each a
candidate, ties go to smaller ids. Query rows of one id are one query, by the least of their vectors.
Few rows give fewer than k results, no rows none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gleaner.llm.common import dealt, documents

#: Vectors of a shard and queries of a block, bands of a posting list, terms probed between two tests.
SHARD, BANDS, STEP = 8192, 32, 8
FOUND = "query_id long, vec_id long, score long"


def whole_vectors(df: DataFrame, scale: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    cells = F.transform(x, lambda c: F.floor(scale * c.cast("double")).cast("long"))
    return df.where(F.col(key).isNotNull() & x.isNotNull() & finite).select(F.col(key).cast("long").alias("id"), cells.alias("cells"))


def _rows(cells: pd.Series) -> np.ndarray:
    out = np.zeros((len(cells), max(map(len, cells))), np.int64)
    for i, x in enumerate(cells):
        out[i, : len(x)] = x
    return out


class Shard:
    """Vectors with impact-ordered postings for every term."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray):
        n, width = cells.shape
        # Products of doubles are exact below 2**53; larger cells take 64-bit integers.
        self.ids, self.kind = ids, np.float64 if n and np.abs(cells).max(initial=0) < 1 << 20 else np.int64
        self.rows = np.ascontiguousarray(cells.astype(self.kind))
        self.columns = np.ascontiguousarray(self.rows.T)
        order = np.argsort(cells, axis=0, kind="stable").T.copy()  # each term's postings, ascending
        self.cuts = np.linspace(0, n, BANDS + 1).astype(int)
        self.order = order
        ranked = np.take_along_axis(self.columns, order, 1)
        self.low, self.high = (ranked[:, 0], ranked[:, -1]) if n else (np.zeros(width), np.zeros(width))
        # Beyond its j top bands a term adds at most edge[:, j] to low (or takes at most that from high).
        self.edge_up = np.stack([ranked[:, self.cuts[BANDS - j] - 1] - self.low if self.cuts[BANDS - j] else np.zeros(width) for j in range(BANDS)] + [np.zeros(width)], 1)
        self.edge_down = np.stack([self.high - ranked[:, min(self.cuts[j], n - 1)] for j in range(BANDS)] + [np.zeros(width)], 1)

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the shard's k best vectors for the query."""
        width = len(self.low)
        q = np.pad(q.astype(self.kind), (0, max(0, width - len(q))))[:width]
        if np.abs(q).max(initial=0) >= 1 << 20:
            q = q.astype(np.int64)
        n, weight, up = len(self.ids), np.abs(q), q > 0
        base = (q * np.where(up, self.low, self.high)).sum()
        edges = weight[:, None] * np.where(up[:, None], self.edge_up, self.edge_down)
        by_bound = np.argsort(-edges[:, 0], kind="stable")
        heads = np.concatenate([self.order[t, -4 * k :] if up[t] else self.order[t, : 4 * k] for t in by_bound[:4]]) if width else np.arange(n)
        heads = np.unique(heads)
        heads = heads[self.ids[heads] != query_id]
        first = self.rows[heads] @ q
        least = np.partition(first, len(first) - k)[len(first) - k] if len(first) >= k else None
        found = np.ones(n, bool) if least is None or not width else self._essential(edges, base, least, up)
        candidates = np.flatnonzero(found & (self.ids != query_id))
        partial = np.full(len(candidates), base, np.result_type(base, self.kind))
        left = edges[:, 0].sum()
        for i in range(0, width, STEP):
            terms = by_bound[i : i + STEP]
            shift = np.where(up[terms], self.low[terms], self.high[terms])
            cells = self.columns[terms] if len(candidates) == n else self.columns[np.ix_(terms, candidates)]
            partial = partial + q[terms] @ (cells - shift[:, None])
            left -= edges[terms, 0].sum()
            if len(partial) >= k:
                reached = np.partition(partial, len(partial) - k)[len(partial) - k]  # what is left adds nothing below zero
                least = reached if least is None else max(least, reached)
            if least is not None:
                stay = partial + left >= least
                if not stay.all():
                    candidates, partial = candidates[stay], partial[stay]
        best = np.lexsort((self.ids[candidates], -partial))[:k]
        return self.ids[candidates[best]], partial[best].astype(np.int64)

    def _essential(self, edges: np.ndarray, base, least, up: np.ndarray) -> np.ndarray:
        """Which vectors the essential bands hold.

        As many bands of every term are taken as bring what the rest can give below the threshold;
        then terms give back their last bands, cheapest first, as far as the rest stays below it.
        """
        totals = base + edges.sum(0)
        level = int(np.argmax(totals < least)) if (totals < least).any() else BANDS
        taken = np.full(len(edges), level)
        if 0 < level and totals[level] < least:
            back = edges[:, level - 1] - edges[:, level]
            order = np.argsort(back, kind="stable")
            taken[order[np.cumsum(back[order]) + totals[level] < least]] -= 1
        mask = np.zeros(len(self.ids), bool)
        for t in np.flatnonzero(taken):
            mask[self.order[t, self.cuts[BANDS - taken[t]] :] if up[t] else self.order[t, : self.cuts[taken[t]]]] = True
        return mask


def top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k best vectors of every query; both have (id, cells) as :func:`whole_vectors` gives them."""
    queries = queries.groupBy("id").agg(F.min("cells").alias("cells"))
    shards = -(-vectors.count() // SHARD) or 1
    blocks = -(-queries.count() // SHARD) or 1
    slot = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = vectors.select(slot(shards).alias("shard"), every(blocks).alias("block"), "id", "cells")
    right = queries.select(every(shards).alias("shard"), slot(blocks).alias("block"), "id", "cells")

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((3, 0), np.int64)]
        if len(rows) and len(asked):
            shard = Shard(rows["id"].to_numpy(np.int64), _rows(rows["cells"]))
            for query_id, q in zip(asked["id"], asked["cells"]):
                ids, scores = shard.search(int(query_id), np.asarray(q, np.int64), k)
                out.append(np.stack([np.full(len(ids), query_id, np.int64), ids, scores]))
        return pd.DataFrame(np.concatenate(out, 1).T, columns=["query_id", "vec_id", "score"])

    pair = ["shard", "block"]
    found = dealt(left, *pair).groupBy(*pair).cogroup(dealt(right, *pair).groupBy(*pair)).applyInPandas(search, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(documents(spark, sf_dir, "embeddings"), 256)
    return top_k(vectors.where("id % 50 = 0"), vectors, 5)


OP3_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) c from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, v.vec_id, list_inner_product(q.c, v.c)::bigint score
  from v q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0)
select query_id, r::int "rank", vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) r from s) where r <= 5
"""
