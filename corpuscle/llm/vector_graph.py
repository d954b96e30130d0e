"""Embedding near-dedup over robust-pruned flat graphs.

Equal vectors become one node. Nodes are dealt to overlapping shards around centroids; each shard builds a flat
graph whose adjacency lists are robust-pruned. Lists of shards that share nodes are united. Every vector then
searches its home shard: greedily from the medoid alone, and from there over all neighbours within the range. Links
are verified in double precision. A sample of vectors is compared with all others to audit recall; where it falls
short the shards are made to overlap more.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import release, stage
from .components import components

THRESHOLD = 0.95
#: Vectors that centroids are fitted on at most: those of the smallest hashes.
FIT_ROWS = 20_000
#: Nodes that a home shard holds on average, and shards that hold a node.
SHARD, OVERLAP = 1024, 6
#: Centroids at most, and up to how many are kept in one level; cells beyond, cells a vector is compared with, rows to fit a centroid.
MOST, ONE_LEVEL, COARSE, PROBES, FIT_EACH = 65_536, 2048, 256, 8, 16
#: Rows compared with all centroids at a time.
BLOCK = 1024
#: Nodes in one graph, and vectors that search it in one task, at most; fuller shards are dealt to several.
GRAPH, QUERIES = 8192, 4096
#: Neighbours kept, candidates they are pruned from, and how much farther a neighbour's neighbour must be to be dropped.
DEGREE, CANDIDATES, ALPHA = 24, 48, 1.2
BEAM, SLACK = 24, 0.05
#: Links that leave a task go out one by one for a vector with so many of them there at most, else as a count.
LISTED = 64
#: Bytes of centroids that every task gets at most.
CENTER_BYTES = 64 << 20
#: An audit compares the vectors whose ids AUDIT_EACH divides with all others, in rounds that end once LINKED of them have links to others.
AUDIT_EACH, AUDITED, LINKED = 100, (512, 1536, 6144), 100
#: The share of a linked vector's links to find on average, how often to try, and the share below which there is no result.
RECALL, TRIES, REQUIRED = 0.99, 3, 0.9
_log = logging.getLogger(__name__)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; scaled by their largest part first, so that none over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centroids(sample: np.ndarray, k: int, seed: int = 5, rounds: int = 8) -> np.ndarray:
    """k unit centroids of unit vectors by spherical k-means, in blocks of BLOCK rows."""
    rng = np.random.default_rng(seed)
    out = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        sums = np.zeros_like(out)
        for at in range(0, len(sample), BLOCK):
            part = sample[at : at + BLOCK]
            np.add.at(sums, (part @ out.T).argmax(axis=1), part)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        out = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), out)
    return out


def _nearest(sims: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n largest values of each row, largest first."""
    top = np.argpartition(-sims, n - 1, axis=1)[:, :n] if n < sims.shape[1] else np.tile(np.arange(sims.shape[1]), (len(sims), 1))
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, axis=1), axis=1, kind="stable"), axis=1)


class Index:
    """Centroids in one level, or in cells: a vector is then compared with the centroids of its PROBES nearest cells alone."""

    def __init__(self, fine: np.ndarray, coarse: np.ndarray | None = None, cells: np.ndarray | None = None) -> None:
        self.fine, self.coarse = fine.astype(np.float32), None if coarse is None else coarse.astype(np.float32)
        if coarse is not None:
            order = np.argsort(cells, kind="stable")
            self.fine, self.starts = self.fine[order], np.searchsorted(cells[order], np.arange(len(coarse) + 1))

    def __len__(self) -> int:
        return len(self.fine)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest centroids of unit vectors, nearest first, in blocks of rows."""
        x = x.astype(np.float32)
        out = np.zeros((len(x), n), np.int64)
        for at in range(0, len(x), BLOCK):
            part = x[at : at + BLOCK]
            out[at : at + BLOCK] = _nearest(part @ self.fine.T, n) if self.coarse is None else self._probed(part, n)
        return out

    def _probed(self, x: np.ndarray, n: int) -> np.ndarray:
        cells = _nearest(x @ self.coarse.T, min(PROBES, len(self.coarse)))
        best = np.full((len(x), n), -1, np.int64)
        sims = np.full((len(x), n), -2.0, np.float32)
        for cell in np.unique(cells):
            rows = np.flatnonzero((cells == cell).any(axis=1))
            first, end = self.starts[cell], self.starts[cell + 1]
            if first == end:
                continue
            every = np.concatenate([sims[rows], x[rows] @ self.fine[first:end].T], axis=1)
            ids = np.concatenate([best[rows], np.broadcast_to(np.arange(first, end), (len(rows), end - first))], axis=1)
            top = _nearest(every, n)
            sims[rows], best[rows] = np.take_along_axis(every, top, axis=1), np.take_along_axis(ids, top, axis=1)
        return np.where(best < 0, best[:, :1], best)


def fit(nodes: DataFrame, rows: int, fit_rows: int) -> Index:
    """Centroids for a shard of SHARD nodes each, at most MOST and of CENTER_BYTES in all, fitted on rows of the smallest hashes.

    Up to ONE_LEVEL centroids come from fit_rows rows at most. More are fitted in cells around coarse centroids, each in
    a task of its own on about FIT_EACH rows a centroid, so that the driver holds no more than the centroids.
    """
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(fit_rows).select("embedding").toPandas()
    sample = _unit(np.stack(sample.embedding.to_numpy()))
    k = min(MOST, max(1, CENTER_BYTES // (4 * sample.shape[1])), max(1, -(-rows // SHARD)))
    if k <= ONE_LEVEL:
        return Index(centroids(sample, k))
    coarse = centroids(sample, COARSE)
    wanted = min(1.0, k * FIT_EACH / rows)

    def to_cells(batches):
        for pdf in batches:
            if len(pdf):
                cell = Index(coarse).nearest(_unit(np.stack(pdf.embedding.to_numpy())), 1)[:, 0]
                yield pd.DataFrame({"cell": cell, "part": pdf.node.to_numpy() % 8, "embedding": pdf.embedding})

    def fit_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        found = centroids(_unit(np.stack(pdf.embedding.to_numpy())), max(1, len(pdf) // FIT_EACH))
        return pd.DataFrame({"cell": pdf.cell.iloc[0], "center": list(found)})

    some = nodes.where(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 30)) < int(wanted * (1 << 30))).select("node", "embedding")
    dealt = some.mapInPandas(to_cells, "cell long, part long, embedding array<double>")
    fitted = dealt.groupBy("cell", "part").applyInPandas(fit_cell, "cell long, center array<double>").toPandas()  # about MOST rows
    return Index(np.stack(fitted.center.to_numpy()), coarse, fitted.cell.to_numpy())


class FlatGraph:
    """Adjacency lists over unit vectors; built from near candidates by robust pruning, with edges both ways, or given."""

    def __init__(self, x: np.ndarray, edges: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.x = x.astype(np.float32)
        self.links = self._both_ways(*edges) if edges else self._connect(self._prune(*self._candidates()))
        mean = self.x.mean(axis=0)
        self.medoid = int((self.x @ mean).argmax())

    def _candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """For each node its CANDIDATES nearest others, nearest first, and their cosines."""
        n = len(self.x)
        m = min(CANDIDATES, n - 1)
        near, sims = np.zeros((n, m), np.int64), np.zeros((n, m), np.float32)
        for at in range(0, n, 1024):
            s = self.x[at : at + 1024] @ self.x.T
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
            top = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < n - 1 else np.argsort(-s, axis=1)[:, :m]
            own = np.take_along_axis(s, top, axis=1)
            order = np.argsort(-own, axis=1)
            near[at : at + 1024] = np.take_along_axis(top, order, axis=1)
            sims[at : at + 1024] = np.take_along_axis(own, order, axis=1)
        return near, sims

    def _prune(self, near: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Robust pruning: the nearest candidate left is kept and drops those that it is nearer to by ALPHA; -1 pads."""
        n, m = near.shape
        out = np.full((n, min(DEGREE, m)), -1, np.int64)
        for at in range(0, n, 512):
            c, s = near[at : at + 512], sims[at : at + 512]
            v = self.x[c]
            between = np.sqrt(np.maximum(2 - 2 * np.einsum("bid,bjd->bij", v, v), 0))
            away = np.sqrt(np.maximum(2 - 2 * s, 0))
            left = np.ones(c.shape, bool)
            rows = np.arange(len(c))
            for k in range(out.shape[1]):
                first = left.argmax(axis=1)
                some = left[rows, first]
                out[at : at + len(c), k] = np.where(some, c[rows, first], -1)
                left &= ~(ALPHA * between[rows, first] <= away)
                left[rows, first] = False
        return out

    def _connect(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, neighbours) of the kept edges and their reverses; a chain through all nodes keeps the graph whole."""
        a, b, chain = np.repeat(np.arange(len(self.x)), kept.shape[1]), kept.ravel(), np.arange(len(self.x) - 1)
        return self._both_ways(np.concatenate([a[b >= 0], chain]), np.concatenate([b[b >= 0], chain + 1]))

    def _both_ways(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.x)
        both = np.unique(np.concatenate([a * n + b, b * n + a]))
        return np.searchsorted(both // n, np.arange(n + 1)), both % n

    def _neighbours(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in nodes, neighbour) of every neighbour."""
        starts, ends = self.links
        lens = starts[nodes + 1] - starts[nodes]
        back = np.repeat(np.arange(len(nodes)), lens)
        at = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(starts[nodes], lens)
        return back, ends[at]

    def within(self, q: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs with a cosine of at least low that a search from the medoid meets."""
        q = q.astype(np.float32)
        n, rows = len(self.x), np.arange(len(q))
        seen = np.zeros((len(q), n), bool)
        beam = np.full((len(q), BEAM), self.medoid, np.int64)
        near = np.full((len(q), BEAM), -2.0, np.float32)
        near[:, 0] = q @ self.x[self.medoid]
        done = np.ones((len(q), BEAM), bool)
        done[:, 0] = False
        seen[:, self.medoid] = True
        met = [(rows, np.full(len(q), self.medoid), near[:, 0].copy())]
        while True:  # each step expands a node that was not expanded before
            best = np.where(done, -3.0, near).argmax(axis=1)
            act = np.flatnonzero(~done[rows, best])
            act = act[near[act, best[act]] < low] if len(act) else act  # what is in range is expanded below
            if not len(act):
                break
            done[act, best[act]] = True
            back, to = self._neighbours(beam[act, best[act]])
            who = act[back]
            fresh = ~seen[who, to]
            who, to = who[fresh], to[fresh]
            seen[who, to] = True
            sims = np.einsum("ij,ij->i", q[who], self.x[to])
            met.append((who, to, sims))
            at = np.searchsorted(who, act)  # who is sorted: the new nodes of a query lie together
            width = int(np.bincount(who, minlength=len(q)).max()) if len(who) else 0
            if width:
                place = np.arange(len(who)) - np.repeat(at, np.diff(np.append(at, len(who))))
                slot = np.searchsorted(act, who)
                more, more_sims = np.zeros((len(act), width), np.int64), np.full((len(act), width), -3.0, np.float32)
                more[slot, place], more_sims[slot, place] = to, sims
                every = np.concatenate([near[act], more_sims], axis=1)
                top = np.argpartition(-every, BEAM - 1, axis=1)[:, :BEAM]
                near[act] = np.take_along_axis(every, top, axis=1)
                beam[act] = np.take_along_axis(np.concatenate([beam[act], more], axis=1), top, axis=1)
                flags = np.concatenate([done[act], more_sims < -2.5], axis=1)
                done[act] = np.take_along_axis(flags, top, axis=1)
        who, to, sims = (np.concatenate(x) for x in zip(*met))
        found = [(who[sims >= low], to[sims >= low])]
        while len(found[-1][0]):  # range expansion: every neighbour of what lies in range
            who, to = found[-1]
            step_who, step_to = [], []
            for at in range(0, len(who), 1 << 16):
                back, nodes = self._neighbours(to[at : at + (1 << 16)])
                mine = who[at : at + (1 << 16)][back]
                fresh = ~seen[mine, nodes]
                pair = np.unique(mine[fresh] * n + nodes[fresh])
                mine, nodes = pair // n, pair % n
                seen[mine, nodes] = True
                hit = np.einsum("ij,ij->i", q[mine], self.x[nodes]) >= low
                step_who.append(mine[hit])
                step_to.append(nodes[hit])
            found.append((np.concatenate(step_who), np.concatenate(step_to)))
        return tuple(np.concatenate(x) for x in zip(*found))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _graph_of(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    nodes = pdf[pdf.is_node].drop_duplicates("node").sort_values("node")
    return nodes, _unit(np.stack(nodes.embedding.to_numpy())) if len(nodes) else np.zeros((0, 1))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """The adjacency list of each node of a shard."""
    nodes, x = _graph_of(pdf)
    if len(nodes) < 2:
        return pd.DataFrame({"node": nodes.node, "near": [np.zeros(0, np.int64)] * len(nodes)})
    starts, ends = FlatGraph(x).links
    ids = nodes.node.to_numpy()
    return pd.DataFrame({"node": ids, "near": [ids[ends[a:b]] for a, b in zip(starts[:-1], starts[1:])]})


_FOUND = "node long, links long, degree long, root long, many long, other long, own_size long, other_size long, blind long"


def _search(threshold: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each vector at home here: how many rows and nodes it links with, and the smallest node its links lead to in this graph.

        Links between vectors that both search this graph and lie in it are counted for both ends here; no other
        task meets them. Of the others, those of a vector with at most LISTED here go out as (node, other), as the other
        end's search may miss them or find them too. A vector with more (many) sends their number alone: it is in the thick
        of a cluster, where searches don't miss what they can see. A link is blind if the other end's search cannot see it,
        as its home shard lacks this node; no task but this one meets it, and it counts for both ends here. So a task
        sends a number of rows in proportion to its nodes, however many links they have.
        """
        pdf = pd.concat(list(parts), ignore_index=True)
        nodes, x = _graph_of(pdf)
        queries = pdf[~pdf.is_node]
        if not len(queries) or not len(nodes):
            return
        ids, sizes = nodes.node.to_numpy(), nodes["size"].to_numpy()
        graph = None
        if len(nodes) > 1:  # the lists of all shards together, as far as they lead to nodes of this one
            lists = nodes.near.to_list()
            a = np.repeat(np.arange(len(ids)), [0 if v is None else len(v) for v in lists])
            b = np.concatenate([np.zeros(0, np.int64), *[v for v in lists if v is not None]])
            at = np.minimum(np.searchsorted(ids, b), len(ids) - 1)
            held = ids[at] == b
            graph = FlatGraph(x, (a[held], at[held]))
        q_ids, q, q_sizes = queries.node.to_numpy(), _unit(np.stack(queries.embedding.to_numpy())), queries["size"].to_numpy()
        every = np.unique(np.concatenate([ids, q_ids]))
        place, q_place = np.searchsorted(every, ids), np.searchsorted(every, q_ids)
        own = np.full(len(q_ids), -1)
        at = np.minimum(np.searchsorted(ids, q_ids), len(ids) - 1)
        own[ids[at] == q_ids] = at[ids[at] == q_ids]
        asks = np.full(len(ids), -1)  # the query that a node is, if it searches here
        asks[own[own >= 0]] = np.flatnonzero(own >= 0)
        inner = np.zeros((len(q_ids), len(q_ids)), bool)
        root = np.arange(len(every))
        home, held_in = nodes.home.to_numpy(), np.stack(queries.shards.to_numpy())
        links, degree, many = (np.zeros(len(q_ids), np.int64) for _ in range(3))
        blind_links, blind_degree = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for start in range(0, len(q_ids), 512):
            part, outer = slice(start, start + 512), []
            who, to = graph.within(q[part], threshold - SLACK) if graph else (np.arange(len(q_ids[part])), np.zeros(len(q_ids[part]), np.int64))
            for k in range(0, len(who), 1 << 18):
                i, j = who[k : k + (1 << 18)] + start, to[k : k + (1 << 18)]
                true = np.einsum("ij,ij->i", q[i], x[j]) >= threshold  # in double precision
                true &= ids[j] != q_ids[i]
                i, j = i[true], j[true]
                root = _joined(root, q_place[i], place[j])
                both = (own[i] >= 0) & (asks[j] >= 0)
                inner[i[both], asks[j[both]]] = True
                outer.append((i[~both], j[~both]))
            i, j = (np.concatenate(x) for x in zip(*outer)) if outer else (np.zeros(0, np.int64),) * 2
            blind = ~(held_in[i] == home[j][:, None]).any(axis=1)
            full = np.bincount(i, minlength=len(q_ids)) > LISTED
            few = ~full[i]
            if few.any():
                yield _rows(node=q_ids[i[few]], other=ids[j[few]], own_size=q_sizes[i[few]], other_size=sizes[j[few]], blind=blind[few])
            many += full
            i, j, blind = i[~few], j[~few], blind[~few]
            np.add.at(links, i, sizes[j])
            np.add.at(degree, i, 1)
            np.add.at(blind_links, j[blind], q_sizes[i[blind]])
            np.add.at(blind_degree, j[blind], 1)
        inner |= inner.T.copy()
        links += np.array([q_sizes[row].sum() for row in inner], np.int64)
        degree += inner.sum(axis=1)
        moved = np.flatnonzero(root != np.arange(len(every)))
        extra = moved[~np.isin(moved, q_place)]
        yield _rows(node=q_ids, links=links, degree=degree, root=every[root[q_place]], many=many)
        some = np.flatnonzero(blind_degree)
        if len(some):
            yield _rows(node=ids[some], links=blind_links[some], degree=blind_degree[some])
        if len(extra):
            yield _rows(node=every[extra], links=np.zeros(len(extra), np.int64), degree=np.zeros(len(extra), np.int64), root=every[root[extra]])

    return run


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The roots once the links a-b are added."""
    return _roots(len(root), root[a], root[b])[root]


def _rows(**columns: np.ndarray) -> pd.DataFrame:
    """A frame of _FOUND; columns that aren't given are null."""
    n = len(columns["node"])
    return pd.DataFrame({c: pd.array(columns[c].astype(np.int64) if c in columns else [None] * n, dtype="Int64") for c in (x.split()[0] for x in _FOUND.split(", "))})


def _counts(found: DataFrame) -> DataFrame:
    """(node, links, degree): rows and other nodes that a node links with, each link once, whichever end's search met it.

    A listed link counts for its other end too, unless that end has many links of its own and can see this one.
    """
    many = found.where("many > 0").select(F.col("node").alias("other")).distinct().withColumn("other_many", F.lit(True))
    listed = found.where("other is not null").select("node", "other", "own_size", "other_size", "blind").join(many, "other", "left")
    forth = listed.select("node", "other", F.col("other_size").alias("size"))
    back = listed.where("blind = 1 or other_many is null").select(F.col("other").alias("node"), F.col("node").alias("other"), F.col("own_size").alias("size"))
    pairs = forth.union(back).distinct()  # at most twice LISTED for each node and task
    each = found.where("other is null and links is not null").select("node", "links", "degree")
    each = each.union(pairs.select("node", "size", F.lit(1).cast("long")))
    return stage(each.groupBy("node").agg(F.sum("links").alias("links"), F.sum("degree").alias("degree")), "counts")


def _assign(centers, overlap: int, graphs: np.ndarray, blocks: np.ndarray):
    """Rows for the graphs that hold a node, with its home shard, and for those that a vector searches, with the shards that hold it."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = _unit(np.stack(pdf.embedding.to_numpy()))
            near = centers.value.nearest(x, overlap)
            pdf = pdf.assign(home=near[:, 0], shards=list(near))
            ids = pdf.node.to_numpy()
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            out = []
            for k in range(near.shape[1]):
                for block in range(int(blocks[near[:, k]].max()) if blocks is not None else 1):
                    mine = np.flatnonzero(blocks[near[:, k]] > block)
                    shard = near[mine, k]
                    out.append(pdf.iloc[mine].assign(shard=shard, graph=(mixed[mine] % graphs[shard].astype(np.uint64)).astype(np.int64), block=block, is_node=True, shards=None))
            home = near[:, 0]
            for graph in range(int(graphs[home].max())):
                mine = np.flatnonzero(graphs[home] > graph)
                block = ((mixed[mine] // np.uint64(7919)) % blocks[home[mine]].astype(np.uint64)).astype(np.int64)
                out.append(pdf.iloc[mine].assign(shard=home[mine], graph=graph, block=block, is_node=False))
            yield pd.concat(out)[["shard", "graph", "block", "is_node", "home", "shards", "node", "size", "embedding"]]

    return run


def _homes(centers, overlap: int):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                near = centers.value.nearest(_unit(np.stack(pdf.embedding.to_numpy())), overlap)
                yield pd.DataFrame({"shard": near.ravel(), "home": (np.arange(near.size) % near.shape[1] == 0).astype(np.int64)})

    return run


def _find_links(nodes: DataFrame, centers: Index, overlap: int, threshold: float) -> DataFrame:
    """Rows of _FOUND for each node and graph it searched or was linked in, and for links that leave a task, up to LISTED for each."""
    known = nodes.sparkSession.sparkContext.broadcast(centers)  # at most CENTER_BYTES
    fill = nodes.select("embedding").mapInPandas(_homes(known, overlap), "shard long, home long")
    graphs, blocks = np.ones(len(centers), np.int64), np.ones(len(centers), np.int64)
    for row in fill.groupBy("shard").agg(F.count(F.lit(1)).alias("held"), F.sum("home").alias("home")).collect():  # a row for each centroid
        graphs[row.shard], blocks[row.shard] = -(-row.held // GRAPH), max(1, -(-row.home // QUERIES))
    schema = "shard long, graph long, block long, is_node boolean, home long, shards array<long>, node long, size long, embedding array<double>"
    dealt = stage(nodes.select("node", "size", "embedding").mapInPandas(_assign(known, overlap, graphs, blocks), schema), "shards")
    built = dealt.where("is_node and block = 0").groupBy("shard", "graph").applyInPandas(_build, "node long, near array<long>")
    united = stage(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    held = dealt.where("is_node").join(united, "node")
    rows = held.unionByName(dealt.where("not is_node").withColumn("near", F.lit(None).cast("array<long>")))
    found = stage(rows.groupBy("shard", "graph", "block").applyInPandas(_search(threshold), _FOUND), "found")
    release(dealt)
    release(united)
    return found


def _audit(nodes: DataFrame, counts: DataFrame, threshold: float) -> tuple[float, int]:
    """The share of its links to other nodes that was found for a linked node on average, and how many linked nodes were seen.

    Nodes whose id AUDIT_EACH divides are compared with all nodes, in blocks, and then some picked by hash, as many as
    all AUDITED, until LINKED of them have a link or all are through. Where none of them has one, nodes for which links
    were found are compared too, AUDITED[0] at most. (1, 0) means that there is nothing to measure: none was found either.
    """
    order, shares = F.xxhash64("node", F.lit(3)), []
    divided = F.col("node") % AUDIT_EACH == 0
    asked = stage(numbered(nodes.where(divided).select("node", "embedding"), order, "node", name="place"), "audited")
    others = nodes.where(~divided).select("node", "embedding").orderBy(order, "node").limit(sum(AUDITED))
    asked = stage(asked.unionByName(numbered(others, order, "node", name="place").withColumn("place", F.col("place") + asked.count())), "audited")
    total, first, sizes = asked.count(), 0, iter(AUDITED)
    while first < total and len(shares) < LINKED:
        size = next(sizes, sum(AUDITED))
        shares += _shares(nodes, asked.where(F.col("place").between(first, first + size - 1)), counts, threshold)
        first += size
    if not shares:
        linked = counts.where("degree > 0").orderBy(order, "node").limit(AUDITED[0]).select("node")
        shares += _shares(nodes, nodes.join(linked, "node"), counts, threshold)
    return (float(np.mean(shares)) if shares else 1.0), len(shares)


def _shares(nodes: DataFrame, asked: DataFrame, counts: DataFrame, threshold: float) -> list[float]:
    """For each of asked (a block that fits in memory) with links to others: the share of them that counts have."""
    block = asked.select("node", "embedding").toPandas()
    if not len(block):
        return []
    known = nodes.sparkSession.sparkContext.broadcast((block.node.to_numpy(), _unit(np.stack(block.embedding.to_numpy()))))

    def count(batches):
        q_ids, q = known.value
        degree = np.zeros(len(q_ids), np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                hit = q @ _unit(np.stack(part.embedding.to_numpy())).T >= threshold
                degree += hit.sum(axis=1) - (hit & (q_ids[:, None] == part.node.to_numpy()[None, :])).sum(axis=1)
        some = np.flatnonzero(degree)
        yield pd.DataFrame({"node": q_ids[some], "degree": degree[some]})

    true = nodes.select("node", "embedding").mapInPandas(count, "node long, degree long").groupBy("node").agg(F.sum("degree").alias("true"))
    both = true.join(counts.select("node", "degree"), "node", "left").toPandas().fillna(0)
    return list(np.minimum(both.degree, both.true) / both.true)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP, fit_rows: int = FIT_ROWS) -> DataFrame:
    """vectors (vec_id, embedding) -> (vec_id, n_links, component_id, kept), a row for each row.

    Rows link where the cosine is at least threshold; no other link is made, and a shard overlap that finds less
    than RECALL of an audited sample is raised, TRIES times at most; below REQUIRED an error is raised. A link counts
    for both ends, whichever end's search met it. component_id is the smallest vec_id reachable.
    A vector that is null, empty, zero, or holds a null or non-finite part links with nothing, as do vectors of
    different lengths and null ids. A repeated row links with its copies. An empty table gives no rows.
    """
    parts = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists(parts, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists(parts, lambda v: v != 0)
    good = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False))
    rows = vectors.select("vec_id", F.when(good, parts).alias("embedding"))
    keyed = rows.withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64("embedding", F.lit(1)))
    alone = keyed.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    keyed = stage(keyed.where("embedding is not null"), "vectors")
    nodes = stage(
        keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("size"), F.any_value("embedding").alias("embedding")), "nodes"
    )
    found = counts = None
    for row in nodes.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect():  # a row for each length
        same = nodes.where(F.size("embedding") == row.n)
        centers = fit(same, row.rows, fit_rows)
        wide = overlap
        for attempt in range(TRIES):
            own = _find_links(same, centers, min(wide, len(centers)), threshold)
            own_counts = _counts(own)
            recall, linked = _audit(same, own_counts, threshold)
            if not linked:
                _log.warning("no audited vector has a link and none was found: recall cannot be measured")
            _log.info("recall %.4f over %d linked vectors with an overlap of %d", recall, linked, wide)
            if recall >= RECALL or wide >= len(centers):
                break
            wide *= 2
        if recall < REQUIRED:
            raise RuntimeError(f"only {recall:.4f} of the links of {linked} audited vectors were found, with an overlap of {min(wide, len(centers))}")
        if recall < RECALL:
            _log.warning("recall %.4f over %d linked vectors is below %.2f", recall, linked, RECALL)
        own = own.where("root is not null").select("node", "root")
        found = own if found is None else found.unionByName(own)
        counts = own_counts if counts is None else counts.unionByName(own_counts)
    if found is None:
        return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    roots = components(found.where("root != node").select(F.col("node").alias("a"), F.col("root").alias("b")))
    told = stage(
        nodes.select("k1", "k2", "node", "size")
        .join(counts.select("node", "links"), "node", "left")
        .join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
        .select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id")),
        "told",
    )
    linked = keyed.select("vec_id", "k1", "k2").join(told, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
