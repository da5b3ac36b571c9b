"""Embedding near-duplicates on a robust-pruned flat graph."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import Scratch, connected_components, forest

LINK = 0.98
#: Vectors from which centroids are fitted, and rows that a shard should have.
SAMPLE_ROWS, SHARD_ROWS = 20_000, 1_500
#: Rows of a shard that one task searches for.
QUERY_ROWS = 4_000
#: Candidates of the local lists, out-degree, and slack of robust pruning.
CANDIDATES, DEGREE, ALPHA = 48, 24, 1.2
#: Beam of the greedy search, and how far below the link threshold its range expands.
BEAM, MARGIN = 24, 0.02
#: Vectors compared with all others to audit recall.
AUDIT_ROWS = 256


@dataclass
class Centroids:
    """Unit centroids of each label; a bounded model, made from a bounded sample."""

    by_label: dict[int, np.ndarray]

    def nearest(self, label: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home and second shard of unit rows (the same twice if there is one)."""
        centres = self.by_label.get(label)
        if centres is None or len(centres) < 2:
            zero = np.zeros(len(rows), np.int32)
            return zero, zero
        near = np.argpartition(-(rows @ centres.T), 1, axis=1)[:, :2]
        sims = np.take_along_axis(rows @ centres.T, near, axis=1)
        swap = sims[:, 0] < sims[:, 1]
        near[swap] = near[swap][:, ::-1]
        return near[:, 0].astype(np.int32), near[:, 1].astype(np.int32)


def fit_centroids(sample: dict[int, np.ndarray], counts: dict[int, int], shard_rows: int = SHARD_ROWS, rounds: int = 8) -> Centroids:
    """k-means on the unit sphere per label; centroids within the link radius are merged.

    Merging keeps a tight ball of copies in one shard, however many rows it has.
    """
    out = {}
    for label, rows in sample.items():
        k = min(max(1, -(-counts[label] // shard_rows)), max(1, len(rows) // 4))
        picks = np.random.default_rng(17).permutation(len(rows))[:k]
        centres = rows[np.sort(picks)]
        for _ in range(rounds if k > 1 else 0):
            own = np.argmax(rows @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, rows)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
        keep: list[int] = []
        for i in range(len(centres)):
            if not keep or (centres[keep] @ centres[i]).max() < 0.9:
                keep.append(i)
        out[label] = centres[keep]
    return Centroids(out)


def robust_prune(points: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-neighbours of each point from its candidates, nearest first; -1 fills up.

    A candidate goes if a chosen neighbour is ``alpha`` times nearer to it than the
    point is. All points of the block are pruned in step.
    """
    out = np.full((len(near), degree), -1, np.int64)
    for at in range(0, len(near), 128):
        c = near[at : at + 128]
        mine = points[at : at + 128] if len(points) == len(near) else None
        vec = points[np.maximum(c, 0)]
        to_me = 1 - np.einsum("bd,bcd->bc", mine, vec)
        between = 1 - vec @ vec.swapaxes(1, 2)
        alive = c >= 0
        for slot in range(degree):
            some = alive.any(1)
            if not some.any():
                break
            pick = np.argmin(np.where(alive, to_me, np.inf), axis=1)
            rows = np.flatnonzero(some)
            out[at + rows, slot] = c[rows, pick[rows]]
            alive[rows] &= alpha * between[rows, pick[rows]] > to_me[rows]
            alive[rows, pick[rows]] = False
    return out


def local_lists(points: np.ndarray, candidates: int = CANDIDATES, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust-pruned adjacency over the points of one shard."""
    n = len(points)
    c = min(candidates, n - 1)
    if c <= 0:
        return np.full((n, 1), -1, np.int64)
    near = np.empty((n, c), np.int64)
    for at in range(0, n, 512):
        sims = points[at : at + 512] @ points.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2
        near[at : at + 512] = np.argpartition(-sims, c - 1, axis=1)[:, :c]
    return robust_prune(points, near, min(degree, c), alpha)


class FlatGraph:
    """Union of adjacency lists over the points of one search shard, with its medoid."""

    def __init__(self, points: np.ndarray, edges: tuple[np.ndarray, np.ndarray]):
        self.points = points
        a = np.concatenate([edges[0], edges[1]])
        b = np.concatenate([edges[1], edges[0]])
        pairs = np.unique(a * len(points) + b)
        a, self.to = pairs // len(points), pairs % len(points)
        self.begin = np.searchsorted(a, np.arange(len(points) + 1))
        mean = points.mean(0)
        self.medoid = int(np.argmax(points @ mean))

    def around(self, q: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of each query with the neighbours of its node."""
        sizes = self.begin[nodes + 1] - self.begin[nodes]
        total = int(sizes.sum())
        step = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.repeat(q, sizes), self.to[np.repeat(self.begin[nodes], sizes) + step]

    def in_range(self, queries: np.ndarray, link: float, beam: int, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, similarity) found at ``link - margin`` or nearer.

        Greedy search from the medoid and the query's own point over the ``beam`` best nodes seen,
        until all of them are expanded, then expansion of all that is in range. A round looks at beams and
        neighbours only, not at all points. No list may lead from one tight group to another in
        range, so what the search did not see is compared in blocks.
        """
        n, m = len(self.points), len(queries)
        own, width = np.arange(m), min(beam, n)
        seen, expanded = np.zeros((m, n), bool), np.zeros((m, n), bool)
        hits: list[tuple[np.ndarray, ...]] = []  # all seen in range
        # The beam of each query, and whether its nodes are expanded; what a round adds is merged row by row.
        top, node, done = np.full((m, width), -2.0), np.zeros((m, width), np.int64), np.ones((m, width), bool)

        def see(q, nodes, distinct=True):
            """Pairs not seen before, and their similarities."""
            new = np.flatnonzero(~seen[q, nodes])
            if not distinct:
                new = new[np.unique(q[new] * n + nodes[new], return_index=True)[1]]
            q, nodes = q[new], nodes[new]
            seen[q, nodes] = True
            parts = [np.einsum("id,id->i", self.points[queries[q[at : at + 50_000]]], self.points[nodes[at : at + 50_000]]) for at in range(0, len(q), 50_000)]
            sims = np.concatenate(parts or [np.empty(0)])
            near = sims >= link - margin
            hits.append((q[near], nodes[near], sims[near]))
            return q, nodes, sims

        def merge(q, nodes, sims):
            """Put pairs, in the order of queries, into the beams they are good enough for."""
            good = sims > top.min(1)[q]
            q, nodes, sims = q[good], nodes[good], sims[good]
            if not len(q):
                return
            rows, begin, sizes = np.unique(q, return_index=True, return_counts=True)
            at = np.repeat(np.arange(len(rows)), sizes), width + np.arange(len(q)) - np.repeat(begin, sizes)
            shape = len(rows), width + int(sizes.max())
            wide = np.full(shape, -2.0), np.zeros(shape, np.int64), np.ones(shape, bool)
            for held, more, new in zip((top, node, done), wide, (sims, nodes, False)):
                more[:, :width], more[at] = held[rows], new
            best = np.argpartition(-wide[0], width - 1, axis=1)[:, :width]
            for held, more in zip((top, node, done), wide):
                held[rows] = np.take_along_axis(more, best, 1)

        for start in (np.full(m, self.medoid), queries):
            merge(*see(own, start))
        for _ in range(4 * beam):
            rows = np.flatnonzero(~done.all(1))
            if not len(rows):
                break
            pick = np.argmax(np.where(done[rows], -3, top[rows]), axis=1)
            nodes = node[rows, pick]
            done[rows, pick] = expanded[rows, nodes] = True
            merge(*see(*self.around(rows, nodes)))
        at = 0
        while at < len(hits):
            q, nodes = (np.concatenate([x[k] for x in hits[at:]]) for k in range(2))
            at, new = len(hits), ~expanded[q, nodes]
            q, nodes = q[new], nodes[new]
            expanded[q, nodes] = True
            for k in range(0, len(q), 10_000):
                see(*self.around(q[k : k + 10_000], nodes[k : k + 10_000]), distinct=False)
        for k in range(0, m, 512):
            sims = self.points[queries[k : k + 512]] @ self.points.T
            q, nodes = np.nonzero((sims >= link - 1e-4) & ~seen[k : k + 512])
            hits.append((q + k, nodes, sims[q, nodes]))
        q, nodes, sims = (np.concatenate(x) for x in zip(*hits))
        near = sims >= link - 1e-4
        return q[near], nodes[near], sims[near]


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    sizes = np.unique(pc.list_value_length(column).to_numpy())
    if len(sizes) > 1:
        raise ValueError(f"vectors of lengths {sizes[0]} and {sizes[1]} cannot be compared")
    rows = pc.list_flatten(column).to_numpy().astype(np.float64).reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _blocks(batches, unit: bool = True) -> dict | None:
    """All rows of one (label, shard, block) group, in the order of vec_id."""
    table = pa.Table.from_batches(list(batches)).sort_by([("vec_id", "ascending")]).combine_chunks()
    out = {n: table.column(n).to_numpy() for n in table.column_names if n not in ("embedding", "neighbours")}
    out["points"] = _unit(table.column("embedding"))
    if "neighbours" in table.column_names:
        out["neighbours"] = table.column("neighbours").to_pylist()
    return out


def representatives(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, embedding, copies)``: usable vectors, equal ones of a label once."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & some)
    return rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")).select("vec_id", "label", "embedding", "copies")


def build(reps: DataFrame, centroids: Centroids, scratch: Scratch, counts: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """Members ``(label, shard, block, blocks, home, other, ...)`` of overlapping shards, and the union of their adjacency lists."""
    shared = reps.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch.column(1).to_numpy(zero_copy_only=False)
            points = _unit(batch.column(2))
            home, other = np.zeros(len(label), np.int32), np.zeros(len(label), np.int32)
            for one in np.unique(label).tolist():
                at = label == one
                home[at], other[at] = shared.value.nearest(one, points[at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(other)], [*batch.schema.names, "home", "other"])

    placed = reps.mapInArrow(assign, "vec_id long, label long, embedding array<double>, copies long, home int, other int")
    members = placed.withColumn("shard", F.explode(F.array_distinct(F.array("home", "other"))))
    members = scratch.cut(members)

    def lists(table: pa.Table) -> pa.Table:
        at = _blocks(table.to_batches())
        ids, near = at["vec_id"], local_lists(at["points"])
        found = [ids[row[row >= 0]].tolist() for row in near]
        return pa.table({"vec_id": pa.array(ids), "neighbours": pa.array(found, pa.list_(pa.int64()))})

    shards = members.select("label", "shard", "vec_id", "embedding").groupBy("label", "shard")
    adjacency = shards.applyInArrow(lists, "vec_id long, neighbours array<long>")
    graph = adjacency.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))
    return members, scratch.cut(graph)


def near_duplicates(vectors: DataFrame, link: float = LINK, audit_rows: int = AUDIT_ROWS, least_recall: float = 0.9) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``vectors(vec_id, embedding, label)``.

    Vectors of equal, non-null label link at cosine ``link`` or more in double
    precision; every reported link is verified so. ``n_links`` counts the other rows linked
    directly, ``component_id`` is the smallest vec_id reachable. Vectors that are
    null, empty, zero or hold null or non-finite components, and rows without label or
    id, link with nothing: no links, their own id, kept.

    Equal vectors are searched once and weighted. Each vector lies in the shards of its two
    nearest centroids. Lists are built and robust-pruned per shard, united per vector, and
    each shard searches the united graph among its members from its medoid, expanding
    everything in range, and compares what that left out, so links inside a shard are exact;
    a pair that shares two shards counts in the smaller one. A shard above
    ``QUERY_ROWS`` is searched in blocks of queries. Links come out as counts and
    spanning forests, never as all pairs of a group.

    Pairs that share no shard are not compared, so the result audits itself: for ``audit_rows`` vectors of least hash the
    links found are held against a comparison with all rows, and a recall below ``least_recall``
    raises an error instead of giving a result.
    Vectors of differing length in one label cannot be compared and raise an error.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    reps = scratch.cut(representatives(vectors))
    counts = {r[0]: r[1] for r in reps.groupBy("label").count().collect()}
    rows = reps.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("label", "embedding").collect()
    sample: dict[int, list] = {}
    for r in rows:
        sample.setdefault(r[0], []).append(r[1])
    units = {k: (x := np.array(v, np.float64)) / np.linalg.norm(x, axis=1, keepdims=True) for k, v in sample.items()}
    members, graph = build(reps, fit_centroids(units, counts), scratch, counts)

    sizes = members.groupBy("label", "shard").count().select("label", "shard", F.ceil(F.col("count") / QUERY_ROWS).cast("int").alias("blocks"))
    searched = members.join(graph, "vec_id").join(sizes, ["label", "shard"])
    searched = searched.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def search(table: pa.Table) -> pa.Table:
        at = _blocks(table.to_batches())
        ids, points, blocks, block = at["vec_id"], at["points"], int(at["blocks"][0]), int(at["block"][0])
        position = {v: i for i, v in enumerate(ids.tolist())}
        src = [(i, position[v]) for i, row in enumerate(at["neighbours"]) for v in row if v in position]
        src = np.array(src, np.int64).reshape(-1, 2)
        graph = FlatGraph(points, (src[:, 0], src[:, 1]))
        mine = np.flatnonzero(ids % blocks == block)
        links, others = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        a, b = [], []
        shard = int(at["shard"][0])
        step = max(32, 4_000_000 // max(1, len(ids)))
        for k in range(0, len(mine), step):
            part = mine[k : k + step]
            q, y, _ = graph.in_range(part, link, BEAM, MARGIN)
            q = part[q]
            exact = np.concatenate([np.einsum("id,id->i", points[q[s : s + 500_000]], points[y[s : s + 500_000]]) for s in range(0, len(q), 500_000)] or [np.empty(0)])
            good = (exact >= link) & (q != y)
            q, y = q[good], y[good]
            # The smallest shard that both have; shard lists hold one or two entries.
            hq, oq, hy, oy = at["home"][q], at["other"][q], at["home"][y], at["other"][y]
            first = np.full(len(q), np.iinfo(np.int32).max)
            for s in (hq, oq):
                first = np.minimum(first, np.where((s == hy) | (s == oy), s, first))
            others += np.bincount(q[first == shard], minlength=len(ids))
            links += np.bincount(q, weights=np.where(first == shard, at["copies"][y], 0), minlength=len(ids)).astype(np.int64)
            if len(q):
                nodes, root = forest(q, y)
                a.append(nodes[nodes != root])
                b.append(root[nodes != root])
        root = np.arange(len(ids))
        if a:
            nodes, low = forest(np.concatenate(a), np.concatenate(b))
            root[nodes] = low
        return pa.table({"vec_id": pa.array(ids[mine]), "links": pa.array(links[mine]), "others": pa.array(others[mine]), "near": pa.array(ids[mine]), "root": pa.array(ids[root[mine]])})

    found = searched.groupBy("label", "shard", "block").applyInArrow(search, "vec_id long, links long, others long, near long, root long")
    found = scratch.cut(found)
    edges = found.where("near <> root").select(F.col("near").alias("a"), F.col("root").alias("b"))
    classes = connected_components(edges, scratch)
    per_rep = found.groupBy("vec_id").agg(F.sum("links").alias("links"), F.sum("others").alias("others"))
    done = reps.join(per_rep, "vec_id").withColumn("n", F.col("links") + F.col("copies") - 1)
    recall = audited_recall(done.select("vec_id", F.col("others").alias("n")).join(audit(reps, link, audit_rows), "vec_id"))
    if recall < least_recall:
        raise RuntimeError(f"the audit found {recall:.3f} of the links; {least_recall} are asked for")
    done = done.join(classes, F.col("vec_id") == F.col("node"), "left").select("label", "embedding", "n", F.coalesce("component", "vec_id").alias("c"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = out.join(done, ["label", "embedding"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id"))
    kept = F.coalesce(F.col("vec_id") == component, F.lit(True))
    return out.select("vec_id", F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def audit(reps: DataFrame, link: float = LINK, audit_rows: int = AUDIT_ROWS) -> DataFrame:
    """``(vec_id, exact)``: exact links of ``audit_rows`` representatives with others, compared with all in blocks; copies do not count."""
    chosen = reps.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(audit_rows).collect()
    queries: dict[int, list] = {}
    for r in chosen:
        queries.setdefault(r.label, []).append((r.vec_id, r.copies, r.embedding))
    shared = reps.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        totals: dict[int, int] = {}
        units = {k: _unit(pa.array([e for _, _, e in v])) for k, v in shared.value.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch.column(1).to_numpy(zero_copy_only=False)
            points = _unit(batch.column(2))
            for one, asked in shared.value.items():
                at = label == one
                hits = (points[at] @ units[one].T >= link).sum(0)
                for (vec, _, _), n in zip(asked, hits.tolist()):
                    totals[vec] = totals.get(vec, 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], ["vec_id", "n"])

    return reps.mapInArrow(run, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("exact"))


def audited_recall(pairs: DataFrame) -> float:
    """Links found over links that exist, of rows (n, exact); 1 if none has a link."""
    found, exist = pairs.agg(F.sum(F.least("n", "exact")), F.sum("exact")).first()
    return found / exist if exist else 1.0
