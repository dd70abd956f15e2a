"""Exact inner-product top-k by dual cover trees.

Candidates and queries are dealt into blocks by their nearest pivot, so that a block is a region; a region with
more rows than a block has is dealt out by a hash of the ids.  Pivots are taken farthest first from a sample of at
most ``PIVOT_SAMPLE`` rows, one a block and at most ``PIVOTS``; they decide which rows lie together and never what is
found.  For each block a cover tree is built once: a node is a center and the radius that covers its rows; its
children's centers are taken farthest first, its own center among them, until they cover the rows within a fraction
of the radius or the fan-out is reached; rows go to the nearest.

A query block is first searched in the candidate block whose center promises most, which gives every query a kth
score to beat.  Of all other pairs of blocks only those go on, with their trees, whose bound below reaches the worst
of these scores; the centers and radii alone decide that.  Each pair that is left is one row of a table and one
search: pairs of nodes are visited from the most promising one, and left out when

    q . c  +  |q| R  +  |c| r  +  r R  <  the worst kth score among the node's queries

(centers q, c; radii r, R), as no pair of rows below them can score more.  Leaves are compared by one matrix
product of whole numbers, exact in doubles; two trees whose scores may leave the range where that holds, or where
a score and a rank fit into one number, are compared in Python's whole numbers, on the same walk.  At the end each
query's best rows of all blocks are ranked.

Vectors in many dimensions without clusters leave little to prune; then a search costs the matrix
products and nothing is lost.

Defined cases: vectors that are null, empty or hold a null or non-finite component (also one that is not finite
when counted in 1/``scale``), and rows without an id, take no part; components of any other size count, exactly; a
score beyond 64 bits ranks by its value and is null, ``over`` (1 or -1) says on which side it is; vectors of different length are not compared; ties go to the smaller id; rows with the query's
id are not its candidates, rows that repeat an id and a vector count once; fewer candidates than ``k`` give
all; vector lengths beyond the ``PIVOT_DIMS`` most frequent are dealt into blocks by hash alone; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oppflow.llm.tables import written

CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 1024
LEAF, FAN_OUT, SHRINK = 128, 32, 0.6
#: Most pivots of a vector length, rows they are chosen from, and vector lengths that have some.
PIVOTS, PIVOT_SAMPLE, PIVOT_DIMS = 1024, 8192, 16
#: Blocks whose centers and radii travel in one row, on average.
CHUNK_BLOCKS = 1024
_RANK_BITS = 20


class Tree:
    """Rows in tree order and nodes (first row, end row, center row, radius, first child, children)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, nodes: np.ndarray):
        self.ids, self.vectors, self.nodes = ids, vectors, nodes
        with np.errstate(over="ignore"):
            self.norms = np.sqrt((vectors * vectors).sum(axis=1))

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> Tree:
        x = vectors.astype(np.float64)
        order = np.arange(len(ids))
        nodes: list[list[float]] = []

        def far(rows: np.ndarray, center: int) -> np.ndarray:
            with np.errstate(over="ignore"):
                return np.sqrt(((x[rows] - x[center]) ** 2).sum(axis=1))

        with np.errstate(over="ignore", invalid="ignore"):
            middle = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
        todo = [(0, len(ids), middle)]  # first row, end row, center; children follow breadth first
        nodes.append([0, len(ids), middle, 0, 0, 0])
        at = 0
        while at < len(nodes):
            low, high, center = todo[at]
            rows = order[low:high]
            nearest = far(rows, center)
            radius = float(nearest.max(initial=0.0))
            nodes[at][3] = radius
            if len(rows) > LEAF and 0 < radius < np.inf:
                owner, centers = np.zeros(len(rows), dtype=np.int64), [center]
                while len(centers) < FAN_OUT and nearest.max() > SHRINK * radius:
                    centers.append(int(rows[nearest.argmax()]))
                    apart = far(rows, centers[-1])
                    closer = apart < nearest
                    owner[closer] = len(centers) - 1
                    nearest = np.where(closer, apart, nearest)
                by_owner = np.argsort(owner, kind="stable")
                order[low:high] = rows[by_owner]
                sizes = np.bincount(owner, minlength=len(centers))
                nodes[at][4], nodes[at][5] = len(nodes), int((sizes > 0).sum())
                for size, child in zip(sizes.tolist(), centers):
                    if size:
                        nodes.append([low, low + size, child, 0, 0, 0])
                        todo.append((low, low + size, child))
                        low += size
            at += 1
        table = np.array(nodes, dtype=np.float64)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        table[:, 2] = place[table[:, 2].astype(np.int64)]
        return cls(ids[order], x[order], table)


class _Best:
    """The best k rows of each query so far, score and rank in one 64-bit number."""

    #: Scores of smaller size than this go with the rank of a candidate of its block.
    LIMIT = 1 << (62 - _RANK_BITS)
    _NOTHING = np.iinfo(np.int64).min

    def __init__(self, queries: Tree, candidates: Tree, k: int):
        self.queries, self.candidates, self.k = queries, candidates, k
        self.rank = np.empty(len(candidates.ids), dtype=np.int64)  # smaller ids win ties
        self.rank[np.argsort(candidates.ids, kind="stable")] = np.arange(len(self.rank))[::-1]
        self.best = np.full((len(queries.ids), k), self._NOTHING)

    def worst(self, low: int, high: int) -> int | None:
        """The least kth score of the queries, None if one has fewer."""
        worst = int(self.best[low:high].min())
        return None if worst == self._NOTHING else worst >> _RANK_BITS

    def compare(self, low: int, high: int, first: int, end: int) -> None:
        q, c = self.queries, self.candidates
        score = np.rint(q.vectors[low:high] @ c.vectors[first:end].T).astype(np.int64)
        found = (score << _RANK_BITS) + self.rank[first:end]
        found[q.ids[low:high, None] == c.ids[None, first:end]] = self._NOTHING
        every = np.concatenate([self.best[low:high], found], axis=1)
        self.best[low:high] = np.partition(every, every.shape[1] - self.k, axis=1)[:, -self.k:]

    def kth(self) -> list[int | None]:
        """Every query's kth score, None if it has fewer."""
        return [self.worst(at, at + 1) for at in range(len(self.queries.ids))]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        by_rank = np.empty_like(self.rank)
        by_rank[self.rank] = np.arange(len(self.rank))
        for query, found in zip(self.queries.ids.tolist(), np.sort(self.best, axis=1)[:, ::-1].tolist()):
            for value in found:
                if value != self._NOTHING:
                    at = by_rank[value & ((1 << _RANK_BITS) - 1)]
                    yield query, int(self.candidates.ids[at]), value >> _RANK_BITS


class _BestOfAnySize(_Best):
    """The same in Python's whole numbers."""

    def __init__(self, queries: Tree, candidates: Tree, k: int):
        self.queries, self.candidates, self.k = queries, candidates, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in queries.ids]  # (less the score, id), best first
        whole = lambda x: [[int(v) for v in row] for row in x.tolist()]
        self.q, self.c = whole(queries.vectors), whole(candidates.vectors)

    def worst(self, low: int, high: int) -> int | None:
        if any(len(f) < self.k for f in self.found[low:high]):
            return None
        return min(-f[-1][0] for f in self.found[low:high])

    def compare(self, low: int, high: int, first: int, end: int) -> None:
        ids = self.candidates.ids[first:end].tolist()
        for at in range(low, high):
            own, mine = self.q[at], int(self.queries.ids[at])
            more = [(-sum(map(mul, own, row)), i) for i, row in zip(ids, self.c[first:end]) if i != mine]
            self.found[at] = nsmallest(self.k, self.found[at] + more)

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for query, found in zip(self.queries.ids.tolist(), self.found):
            for less, at in found:
                yield query, at, -less


def _upper(products: np.ndarray, q_norm: float, q_radius: float, c_norms: np.ndarray, c_radii: np.ndarray) -> np.ndarray:
    """The most that two rows can score that lie within the radii of centers with these products and norms."""
    with np.errstate(over="ignore", invalid="ignore"):
        bound = products + q_norm * c_radii + c_norms * q_radius + q_radius * c_radii
        # More than the bound can be off by rounding; what is no number bounds nothing.
        bound = bound + 1e-3 + 1e-12 * (q_norm + q_radius) * (c_norms + c_radii)
    return np.where(np.isnan(bound), np.inf, bound)


def search(queries: Tree, candidates: Tree, k: int) -> list[tuple[int, int, int]]:
    """(query id, candidate id, score) of each query's best k candidates of the tree."""
    return list(best_of(queries, candidates, k).rows())


def best_of(queries: Tree, candidates: Tree, k: int, floors: np.ndarray | None = None) -> _Best:
    """Each query's best k candidates of the tree; those that score less than the query's floor may be missing."""
    largest = [float(np.abs(t.vectors).max(initial=0.0)) for t in (queries, candidates)]
    small = largest[0] * largest[1] * queries.vectors.shape[1] < _Best.LIMIT
    best = (_Best if small else _BestOfAnySize)(queries, candidates, k)
    q_nodes, c_nodes = queries.nodes, candidates.nodes

    def bounds(q: int, nodes: np.ndarray) -> np.ndarray:
        at, centers = int(q_nodes[q, 2]), nodes[:, 2].astype(np.int64)
        with np.errstate(over="ignore", invalid="ignore"):
            products = candidates.vectors[centers] @ queries.vectors[at]
        return _upper(products, queries.norms[at], q_nodes[q, 3], candidates.norms[centers], nodes[:, 3])

    def children(nodes: np.ndarray, node: int) -> np.ndarray:
        first, count = int(nodes[node, 4]), int(nodes[node, 5])
        return np.arange(first, first + count) if count else np.array([node])

    todo = [(0, 0, np.inf)]
    while todo:
        q, c, bound = todo.pop()
        low, high = int(q_nodes[q, 0]), int(q_nodes[q, 1])
        worst = best.worst(low, high)
        if worst is not None and bound < worst or floors is not None and bound < floors[low:high].min():
            continue
        if not q_nodes[q, 5] and not c_nodes[c, 5]:
            best.compare(low, high, int(c_nodes[c, 0]), int(c_nodes[c, 1]))
            continue
        # Split the wider node first; of its pairs the most promising is visited first.
        split_q = q_nodes[q, 5] and (not c_nodes[c, 5] or q_nodes[q, 3] > c_nodes[c, 3])
        pairs = []
        for below in children(q_nodes, q) if split_q else [q]:
            of = np.array([c]) if split_q else children(c_nodes, c)
            pairs += [(int(below), int(n), float(b)) for n, b in zip(of, bounds(int(below), c_nodes[of]))]
        todo += sorted(pairs, key=lambda p: p[2])
    return best


def _floor(score: int | None) -> float:
    """A double that is at most the score."""
    try:
        return -np.inf if score is None else float(np.nextafter(float(score), -np.inf))
    except OverflowError:  # beyond all doubles
        return -np.inf if score < 0 else float(np.finfo(np.float64).max)


def _ranked(score: int) -> tuple[int | None, int, str | None]:
    """A score as a 64-bit number, or null with the side it is on and a text that sorts like it."""
    if -(1 << 63) <= score < 1 << 63:
        return score, 0, None
    # Sums of products of doubles have fewer than 640 digits.
    return None, 1 if score > 0 else -1, f"{score + 10**640:0641d}"


def farthest_first(x: np.ndarray, count: int) -> np.ndarray:
    """At most ``count`` rows of ``x``, each as far as can be from those before it."""
    chosen, nearest = [0], np.full(len(x), np.inf)
    while len(chosen) < min(count, len(x)):
        with np.errstate(over="ignore", invalid="ignore"):
            nearest = np.fmin(nearest, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        if not nearest.max() > 0:
            break
        chosen.append(int(nearest.argmax()))
    return x[chosen]


def _in_cells(vectors: DataFrame, candidate_block: int, query_block: int) -> DataFrame:
    """``vectors`` written with the number of the nearest pivot as ``cell`` and, among as many pivots as there are query
    blocks, as ``q_cell``."""
    sizes = vectors.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).orderBy(
        F.desc("n"), "dim"
    ).limit(PIVOT_DIMS).collect()
    counts = {
        r["dim"]: [max(1, min(PIVOTS, -(-n // size))) for n, size in ((r["n"], candidate_block), (r["q"], query_block))]
        for r in sizes
    }
    first = Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id", "vector")
    chosen = vectors.where(F.col("dim").isin(list(counts))).withColumn("_at", F.row_number().over(first)).where(
        F.col("_at") <= PIVOT_SAMPLE // max(1, len(counts))
    ).select("dim", "vector").collect()
    pivots = {
        dim: farthest_first(np.array([r["vector"] for r in chosen if r["dim"] == dim]), max(many))
        for dim, many in counts.items()
    }

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, q_cell = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            for dim, rows in batch.groupby("dim").indices.items():
                if dim in pivots:
                    x, near = np.array(batch["vector"].iloc[rows].tolist()), pivots[dim]
                    with np.errstate(over="ignore", invalid="ignore"):
                        apart = np.nan_to_num((near * near).sum(axis=1) - 2 * (x @ near.T), nan=np.inf)
                    many, q_many = counts[dim]
                    cell[rows], q_cell[rows] = apart[:, :many].argmin(axis=1), apart[:, :q_many].argmin(axis=1)
            yield batch.assign(cell=cell, q_cell=q_cell)

    return written(vectors.mapInPandas(
        cells, "id long, dim int, vector array<double>, is_query boolean, cell long, q_cell long"
    ), "vectors_in_cells")


_TREE = ["ids", "vectors", "nodes"]


def _trees(vectors: DataFrame, cell: str, rows: int, name: str) -> DataFrame:
    """One row per block: its tree, center and radius.  Blocks have at most about ``rows`` rows of one cell."""
    sizes = vectors.groupBy("dim", cell).agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    blocked = vectors.join(sizes, ["dim", cell]).select(
        "dim", "id", "vector", (F.shiftleft(cell, 32) + part).alias("block")
    )

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        tree = Tree.build(group["id"].to_numpy(), np.array(group["vector"].tolist()))
        _, _, center, radius, _, _ = tree.nodes[0]
        return pd.DataFrame({
            "dim": group["dim"].iloc[:1], "block": group["block"].iloc[:1],
            "ids": [tree.ids.astype("<i8").tobytes()], "vectors": [tree.vectors.astype("<f8").tobytes()],
            "nodes": [tree.nodes.astype("<f8").tobytes()],
            "center": [tree.vectors[int(center)].astype("<f8").tobytes()], "radius": [radius],
        })

    return written(blocked.groupBy("dim", "block").applyInPandas(
        build, "dim int, block long, ids binary, vectors binary, nodes binary, center binary, radius double"
    ), name)


def _chunks(candidates: DataFrame) -> DataFrame:
    """Centers and radii of candidate blocks, many blocks to a row: ``dim, blocks, centers, radii``."""
    chunks = -(-candidates.count() // CHUNK_BLOCKS)
    dealt = candidates.select("dim", "block", "center", "radius").withColumn(
        "_chunk", F.pmod(F.xxhash64("block"), F.lit(max(1, chunks)))
    )

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "dim": group["dim"].iloc[:1], "blocks": [group["block"].to_numpy().astype("<i8").tobytes()],
            "centers": [b"".join(group["center"])], "radii": [group["radius"].to_numpy().astype("<f8").tobytes()],
        })

    return dealt.groupBy("dim", "_chunk").applyInPandas(pack, "dim int, blocks binary, centers binary, radii binary")


def _met(regions: DataFrame, chunks: DataFrame, pick, out: str) -> DataFrame:
    """``dim, q_block`` and what ``pick(row, blocks, products, bounds)`` makes of a query block and a chunk."""
    names = [c.strip().split(" ")[0] for c in out.split(",")]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                centers = np.frombuffer(row.centers, dtype="<f8").reshape(-1, row.dim)
                own = np.frombuffer(row.q_center, dtype="<f8")
                with np.errstate(over="ignore", invalid="ignore"):
                    products, norms = centers @ own, np.sqrt((centers * centers).sum(axis=1))
                    norm = float(np.sqrt((own * own).sum()))
                bounds = _upper(products, norm, row.q_radius, norms, np.frombuffer(row.radii, dtype="<f8"))
                made = pick(row, np.frombuffer(row.blocks, dtype="<i8"), products, bounds)
                if len(made[0]):
                    yield pd.DataFrame(dict(zip(names, made))).assign(dim=row.dim, q_block=row.q_block)[
                        ["dim", "q_block", *names]
                    ]

    return regions.join(chunks, "dim").mapInPandas(look, f"dim int, q_block long, {out}")


def first_blocks(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``dim, q_block, block``: for every query block the candidate block whose center scores most with its own."""
    def pick(row, blocks, products, bounds):
        at = [int(np.nan_to_num(products, nan=-np.inf).argmax())]
        return blocks[at], np.nan_to_num(products[at])

    regions = queries.select("dim", F.col("block").alias("q_block"), F.col("center").alias("q_center"),
                             F.col("radius").alias("q_radius"))
    best = _met(regions, chunks, pick, "block long, product double")
    return best.groupBy("dim", "q_block").agg(F.max_by("block", F.struct("product", "block")).alias("block"))


def open_pairs(queries: DataFrame, chunks: DataFrame, firsts: DataFrame) -> DataFrame:
    """``dim, q_block, block`` of the pairs that can hold a result, but for those searched first."""
    def pick(row, blocks, products, bounds):
        return (blocks[(bounds >= row.floor) & (blocks != row.first)],)

    regions = queries.select("dim", F.col("block").alias("q_block"), F.col("center").alias("q_center"),
                             F.col("radius").alias("q_radius"))
    known = firsts.select("dim", "q_block", F.col("block").alias("first"), "floor")
    return _met(regions.join(known, ["dim", "q_block"]), chunks, pick, "block long")


def _tree(dim: int, ids: bytes, vectors: bytes, nodes: bytes) -> Tree:
    x = np.frombuffer(vectors, dtype="<f8").reshape(-1, dim)
    return Tree(np.frombuffer(ids, dtype="<i8"), x, np.frombuffer(nodes, dtype="<f8").reshape(-1, 6))


_FOUND = ["query_id", "vec_id", "score", "over", "digits"]
_FOUND_TYPE = "array<struct<query_id:bigint,vec_id:bigint,score:bigint,over:int,digits:string>>"


def top_k(
    df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = 256, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score, over``: the ``k`` best candidates of every query, all rows but its own.

    Components are counted in whole 1/``scale``, rounded down.  ``is_query`` may use the column ``id``.
    """
    value = lambda x: x.cast("double")
    odd = lambda x: x.isNull() | F.isnan(value(x)) | (F.abs(value(x) * scale) == float("inf"))
    # Doubles from 2^52 on are whole, and may be too large for floor()'s 64 bits.
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    column = F.col(f"`{vector_col}`")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), column.alias("_v")).where(
        F.col("id").isNotNull() & F.col("_v").isNotNull() & (F.size("_v") > 0) & ~F.exists("_v", odd)
    )
    vectors = rows.select(
        "id", F.size("_v").alias("dim"), F.transform("_v", lambda x: whole(value(x) * scale)).alias("vector")
    ).dropDuplicates(["id", "vector"]).withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    celled = _in_cells(vectors, candidate_block, query_block)
    candidates = _trees(celled, "cell", candidate_block, "candidate_trees")
    queries = _trees(celled.where("is_query"), "q_cell", query_block, "query_trees")
    chunks = written(_chunks(candidates), "regions")
    own = queries.select("dim", F.col("block").alias("q_block"), *[F.col(c).alias(f"q_{c}") for c in _TREE])
    other = candidates.select("dim", "block", *_TREE)

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                floors = None if r.floors is None else np.frombuffer(r.floors, dtype="<f8")
                best = best_of(
                    _tree(r.dim, r.q_ids, r.q_vectors, r.q_nodes), _tree(r.dim, r.ids, r.vectors, r.nodes), k, floors
                )
                kth = np.array([_floor(s) for s in best.kth()]) if floors is None else np.array([])
                found = [(q, c, *_ranked(score)) for q, c, score in best.rows()]
                yield pd.DataFrame({
                    "dim": [r.dim], "q_block": [r.q_block], "block": [r.block],
                    "floors": [kth.astype("<f8").tobytes()], "floor": [float(kth.min(initial=np.inf))],
                    "found": [[dict(zip(_FOUND, f)) for f in found]],
                })

    def searches(pairs: DataFrame) -> DataFrame:
        return pairs.join(own, ["dim", "q_block"]).join(other, ["dim", "block"]).select(
            "dim", "q_block", "block", "floors", *[f"q_{c}" for c in _TREE], *_TREE
        ).mapInPandas(searched, f"dim int, q_block long, block long, floors binary, floor double, found {_FOUND_TYPE}")

    firsts = written(searches(first_blocks(queries, chunks).withColumn("floors", F.lit(None).cast("binary"))), "first_blocks")
    pairs = written(open_pairs(queries, chunks, firsts), "open_pairs", narrow=True)
    others = searches(pairs.join(firsts.select("dim", "q_block", "floors"), ["dim", "q_block"]))
    best = firsts.select(F.inline("found")).unionByName(others.select(F.inline("found")))
    order = Window.partitionBy("query_id").orderBy(
        F.col("over").desc(), F.col("score").desc(), F.col("digits").desc(), "vec_id"
    )
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score", "over"
    )
