"""Embedding near-duplicates: a hierarchical navigable small-world graph per shard.

Vectors are compared within one label.  Equal vectors are collapsed first, so a group of copies is
one node however large it is.  The nodes of a label are dealt into shards: of ``SHARD`` nodes up to
``SHARDS`` shards, then as many as ``BYTES`` of vectors a shard ask for, so that few pairs of shards
meet however large a label is.  Each shard gets a graph, built once and kept as one row.  Then every shard is searched with the vectors
of every shard of its label, both ways in one task per pair of shards.  A search that ends with a
full beam of near vectors is repeated with a beam twice as wide, and all searches of a pair of
shards are widened until an audit of its recall against brute force passes.  Found pairs are
verified by cosine in double precision.  A task returns link counts and a spanning forest of its
links, never the pairs themselves, and the forests' components are joined with Spark.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

SHARD = 4096
SHARDS = 64
BYTES = 64 << 20
#: Links of a node above the ground level; twice as many on it.
LINKS = 12
#: Beam while building, and the first one while searching.
BEAM = 48
#: Vectors audited per search of a shard, and the recall that they must reach.
AUDITED, RECALL = 128, 0.99
#: Share of the audited vectors whose nearest neighbour a search must meet, links or not.
NEAREST = 0.95
BLOCK = 256


class Graph:
    """Small-world graph over unit vectors; nodes stand in descending order of their level."""

    def __init__(self, x: np.ndarray, seed: int = 11):
        n = len(x)
        level = np.floor(-np.log(1.0 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        self.x, level = np.ascontiguousarray(x[self.order], np.float32), level[self.order]
        self.sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
        self.links = [np.full((size, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k, size in enumerate(self.sizes)]
        done = min(n, 1)
        while done < n:
            end = min(n, done + min(done, BLOCK))
            for size in self.sizes:  # a block has one level
                if done < size < end:
                    end = size
            self._insert(done, end, int(level[done]))
            done = end

    def __getstate__(self):
        """Without the vectors, which the shard has beside the graph."""
        return {k: v for k, v in self.__dict__.items() if k != "x"}

    def _insert(self, first: int, end: int, level: int) -> None:
        new = np.arange(first, end)
        q = self.x[first:end]
        at = np.zeros((len(new), 1), np.int64)
        for k in range(len(self.links) - 1, -1, -1):
            if self.sizes[k] <= 0 or first == 0:
                continue
            if k > level:
                at, _ = self._beam(q, at, k, 4, min(first, self.sizes[k]))
                continue
            found, sims = self._beam(q, at, k, BEAM, first)
            at = found[:, :4]
            near = q @ q.T
            np.fill_diagonal(near, -np.inf)
            few = min(len(new), self.links[k].shape[1])
            own = np.argpartition(-near, few - 1, axis=1)[:, :few]
            found = np.concatenate([found, new[own]], 1)
            sims = np.concatenate([sims, np.take_along_axis(near, own, 1)], 1)
            found[~np.isfinite(sims)] = -1
            chosen = self._choose(found, sims, LINKS)
            self.links[k][new, :LINKS] = chosen
            self._link_back(k, chosen, new)

    def _choose(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates those that are nearer to the row than to one chosen before, then the nearest rest."""
        order = np.argsort(-np.where(ids >= 0, sims, -np.inf), axis=1, kind="stable")[:, : 2 * BEAM]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        sims = np.where(ids >= 0, sims, -np.inf)
        vectors = self.x[np.maximum(ids, 0)]
        between = np.matmul(vectors, vectors.transpose(0, 2, 1))
        picked, closest = np.zeros(ids.shape, bool), np.full(ids.shape, -np.inf, np.float32)
        for c in range(ids.shape[1]):
            take = (ids[:, c] >= 0) & (sims[:, c] > closest[:, c]) & (picked.sum(1) < most)
            picked[:, c] = take
            closest[take] = np.maximum(closest[take], between[take, c])
        rank = np.argsort(np.where(picked, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, rank, 1)
        if out.shape[1] < most:
            out = np.concatenate([out, np.full((len(out), most - out.shape[1]), -1, out.dtype)], 1)
        return out

    def _link_back(self, k: int, chosen: np.ndarray, new: np.ndarray) -> None:
        rows, _ = np.nonzero(chosen >= 0)
        to, source = chosen[chosen >= 0], new[rows]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        targets, begin, size = np.unique(to, return_index=True, return_counts=True)
        width = self.links[k].shape[1]
        place = np.arange(len(to)) - np.repeat(begin, size)
        more = np.full((len(targets), int(size.max(initial=0))), -1, np.int64)
        more[np.repeat(np.arange(len(targets)), size), place] = source
        ids = np.concatenate([self.links[k][targets].astype(np.int64), more], 1)
        twice = np.sort(ids, 1)
        ids = np.where(np.concatenate([np.zeros((len(ids), 1), bool), twice[:, 1:] == twice[:, :-1]], 1), -1, twice)
        for a in range(0, len(targets), BLOCK):
            part = slice(a, a + BLOCK)
            sims = np.einsum("rwd,rd->rw", self.x[np.maximum(ids[part], 0)], self.x[targets[part]])
            self.links[k][targets[part]] = self._choose(ids[part], sims, width)

    def _beam(self, q: np.ndarray, entry: np.ndarray, level: int, beam: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of each query, best first; -1 and -inf fill what was not found."""
        links, r = self.links[level], len(q)
        ids = np.full((r, max(beam, entry.shape[1])), -1, np.int64)
        ids[:, : entry.shape[1]] = np.where(entry < limit, entry, -1)
        ids[:, 0] = np.where(ids[:, 0] < 0, 0, ids[:, 0])
        sims = np.where(ids >= 0, np.einsum("rwd,rd->rw", self.x[np.maximum(ids, 0)], q), -np.inf).astype(np.float32)
        seen = np.zeros((r, limit + 1), bool)
        seen[np.arange(r)[:, None], ids] = True
        open_ = ids >= 0
        width = ids.shape[1]
        many = max(1, width // 16)  # nodes that a row opens at once
        while True:
            waiting = np.where(open_, sims, -np.inf)
            rows = np.flatnonzero(waiting.max(1) > -np.inf)
            if not len(rows):
                break
            waiting = waiting[rows]
            pick = np.argmax(waiting, 1)[:, None] if many == 1 else np.argpartition(-waiting, many - 1, axis=1)[:, :many]
            good = np.take_along_axis(waiting, pick, 1) > -np.inf
            at = rows[:, None]
            open_[at, pick] &= ~good
            to = links[np.maximum(ids[at, pick], 0)].astype(np.int64)
            to = np.where(good[:, :, None] & (to >= 0) & (to < limit), to, limit).reshape(len(rows), -1)
            to.sort(axis=1)
            to[:, 1:][to[:, 1:] == to[:, :-1]] = limit
            fresh = ~seen[at, to] & (to < limit)
            seen[at, to] = True
            near = np.full(to.shape, -np.inf, np.float32)
            r_at, c_at = np.nonzero(fresh)
            near[r_at, c_at] = np.einsum("nd,nd->n", self.x[to[r_at, c_at]], q[rows[r_at]])
            all_ids = np.concatenate([ids[rows], np.where(fresh, to, -1)], 1)
            all_sims = np.concatenate([sims[rows], near], 1)
            all_open = np.concatenate([open_[rows], fresh], 1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[rows], sims[rows], open_[rows] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_sims, all_open))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.zeros((len(q), 1), np.int64)
        for k in range(len(self.links) - 1, 0, -1):
            at, _ = self._beam(q, at, k, 4, self.sizes[k])
        return self._beam(q, at, 0, beam, self.sizes[0])

    def within(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs whose similarity is least or more, as far as the audited beams find them."""
        n, beam = self.sizes[0], min(BEAM, self.sizes[0])
        audited = np.unique(np.linspace(0, len(q) - 1, min(AUDITED, len(q))).astype(int))
        near = [self.x @ q[i] for i in audited]
        wanted = {k * n + int(j) for k, x in enumerate(near) for j in np.flatnonzero(x >= least)}
        first = np.array([np.argmax(np.where(x > 1 - 1e-6, -2.0, x)) for x in near])  # the nearest that is not the vector itself
        while beam < n and len(audited):  # the audited queries alone find the beam, with which all are searched once
            query, node = self._ranged(q[audited], 0, beam, least)
            nearest = (self.search(q[audited], beam)[0] == first[:, None]).any(1).mean()
            if len(wanted & set((query * n + node).tolist())) >= RECALL * len(wanted) and nearest >= NEAREST:
                break
            beam = min(n, 2 * beam)
        pairs = [self._ranged(q[a : a + BLOCK], a, beam, least) for a in range(0, len(q), BLOCK)]
        query, node = (np.concatenate(z) for z in zip(*pairs))
        return query, node

    def _ranged(self, q: np.ndarray, shift: int, beam: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        ids, sims = self.search(q, beam)
        rows, cols = np.nonzero(sims >= least)
        query, node = [rows + shift], [ids[rows, cols]]
        full = np.flatnonzero(sims[:, -1] >= least)
        if len(full) and beam < self.sizes[0]:
            keep = ~np.isin(rows, full)
            query, node = [query[0][keep]], [node[0][keep]]
            a, b = self._ranged(q[full], 0, min(self.sizes[0], 4 * beam), least)
            query.append(full[a] + shift)
            node.append(b)
        return np.concatenate(query), np.concatenate(node)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node that each of n nodes is joined to by the edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _verified(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    keep = np.zeros(len(a), bool)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    for i in range(0, len(a), 1 << 16):
        p, q = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
        keep[i : i + (1 << 16)] = np.einsum("nd,nd->n", x[p], y[q]) / (nx[p] * ny[q]) >= least
    return a[keep], b[keep]


def _links(left: dict, right: dict | None, least: float) -> pd.DataFrame:
    """Link counts (node, null, n) and forest edges (node, root, 0) of a pair of shards, or of one shard with itself."""
    slack = least - 1e-4  # the graphs hold single precision
    x, ids, times = left["x"].astype(float), left["ids"], left["times"]
    own = right is None
    right = right or left
    y, to, to_times = right["x"].astype(float), right["ids"], right["times"]
    a, node = right["graph"].within(_unit(x), slack)
    b = right["graph"].order[node]
    if not own:
        c, node = left["graph"].within(_unit(y), slack)
        a, b = np.concatenate([a, left["graph"].order[node]]), np.concatenate([b, c])
    else:
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    both = np.sort(a.astype(np.int64) * len(y) + b)
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    a, b = _verified(x, y, both // max(1, len(y)), both % max(1, len(y)), least)
    if own:
        counts = np.bincount(a, to_times[b], minlength=len(ids)) + np.bincount(b, times[a], minlength=len(ids))
        names, root = ids, _forest(a, b, len(ids))
    else:
        counts = np.concatenate([np.bincount(a, to_times[b], minlength=len(ids)), np.bincount(b, times[a], minlength=len(to))])
        names, root = np.concatenate([ids, to]), _forest(a, b + len(ids), len(ids) + len(to))
    have, joined = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({"a": np.concatenate([names[have], names[joined]]), "b": np.concatenate([np.zeros(len(have), np.int64), names[root[joined]]]), "n": np.concatenate([counts[have], np.zeros(len(joined))]).astype(np.int64)})


def linked(vectors: DataFrame, least: float = 0.93, shard: int = SHARD) -> DataFrame:
    """(vec_id, n_links, component_id) per row of vectors (vec_id, embedding, label).

    A node is a kind of vector (label, length, components), named by a number of its own, so rows
    with one vec_id and different labels or vectors stay apart; a row's component_id is the smallest
    vec_id of its component.  An empty table gives an empty result.  Vectors without a label, null vectors, zero vectors and those with null or non-finite components
    link with nothing; neither do vectors of different lengths.  Equal vectors of one label are
    linked, repeated rows too.  Other columns are not looked at.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    sound = rows.where(valid).withColumn("dim", F.size("embedding"))
    kinds = scratch.keep(sound.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times")).withColumn("node", F.monotonically_increasing_id()))
    n = F.count("*")
    sizes = kinds.groupBy("label", "dim").agg(F.greatest(F.least(F.ceil(n / shard), F.lit(SHARDS)), F.ceil(n * F.col("dim") * 4 / BYTES)).cast("int").alias("shards"))
    dealt = kinds.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    label = dict(kinds.dtypes)["label"]

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rep", "node"], kind="stable")
        x = np.stack(rows["embedding"].to_numpy())
        data = {"x": x, "ids": rows["node"].to_numpy(), "times": rows["times"].to_numpy(), "graph": Graph(_unit(x.astype(float)))}
        return pd.DataFrame({"label": rows["label"].iloc[:1], "dim": rows["dim"].iloc[:1], "shards": rows["shards"].iloc[:1], "shard": rows["shard"].iloc[:1], "data": [pickle.dumps(data, 5)]})

    graphs = scratch.keep(dealt.groupBy("label", "dim", "shards", "shard").applyInPandas(build, f"label {label}, dim int, shards int, shard int, data binary"))
    pairs = F.expr("transform(sequence(0, shards - 1), s -> struct(least(s, shard) as i, greatest(s, shard) as j))")
    met = graphs.select("label", "dim", F.inline(pairs), "shard", "data")

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        data = [pickle.loads(d) for d in rows.sort_values("shard")["data"]]
        for d in data:
            d["graph"].x = np.ascontiguousarray(_unit(d["x"].astype(float))[d["graph"].order])
        return _links(data[0], data[1] if len(data) > 1 else None, least)

    found = scratch.keep(met.groupBy("label", "dim", "i", "j").applyInPandas(match, "a long, b long, n long"))
    counts = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = scratch.keep(components(found.where("n = 0").select("a", "b"), scratch))
    least_ids = roots.join(kinds.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    roots = roots.join(least_ids, "component").select("node", "component_id")
    named = scratch.keep(
        kinds.join(counts, "node", "left").join(roots, "node", "left").select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    scratch.drop(graphs, found, kinds)
    out = rows.withColumn("valid", valid).join(named, F.col("valid") & (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def query(spark, sf_dir):
    from .common import read

    return linked(read(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
