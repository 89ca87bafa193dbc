"""Exact top-k inner products with a KD-tree per shard.

Vectors become integers floor(scale * x).  Rows are dealt by a hash of their id into shards of bounded size; a shard is a KD-tree
made by median splits of its widest coordinate, every node with a tight bounding box.  The largest inner product that a box
allows with a query is sum(max(q*low, q*high)); nodes are visited best first and a search ends when the best bound left is
below the kth score so far.  Ties go to the smaller id, so a bound equal to the kth score is still visited.

Queries are a stated set, and go block by block against every shard.  The first round searches one shard per block; its kth
score is propagated to the second round, which searches all other shards and returns only what reaches it.  The second round is
dealt as cells of a band of blocks and a group of shards, so that a block is sent once for each group and a shard once for each
band, and not once for each pair of them; a cell keeps the best of each query from shard to shard.  No join may be broadcast:
nothing that grows with the tables passes through the driver, which gets their counts only.

Defined cases: null vectors, vectors holding null or non-finite components and rows with a null id take no part, either as
queries or as candidates; vectors of a length other than the longest common one raise an error; repeated rows are candidates
one by one (a query skips every row with its own id), and of queries that
share an id the smallest vector is asked; fewer than k candidates give fewer rows; empty tables give no rows.
Scores are exact: 64-bit floats where every sum stays below 2**53, Python integers elsewhere; a score beyond a long is an error.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, trimmed, written

#: Rows in a shard and in a block of queries (about), and rows in a leaf.
SHARD, BLOCK, LEAF = 8192, 1024, 64
#: Shards in a group, and bytes of 64-bit numbers and queries in a band (about).
GROUP, BAND_BYTES, BAND = 16, 32 << 20, 32768
_PACK = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("width", T.IntegerType()), T.StructField("data", T.BinaryType()), T.StructField("bits", T.IntegerType()), T.StructField("exact", T.BooleanType())])


class Tree:
    """Nodes as arrays: children (or a leaf's slice of rows) and the tight box of each node."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order, self.left, self.right, self.rows, low, high = np.arange(len(ids)), [], [], [], [], []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            lo, hi, parent, side = stack.pop()
            node = len(self.rows)
            if parent >= 0:
                (self.left, self.right)[side][parent] = node
            own = x[order[lo:hi]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            self.left.append(-1)
            self.right.append(-1)
            self.rows.append((lo, hi))
            spread = high[-1] - low[-1]
            axis = int(np.argmax(spread))
            if hi - lo > LEAF and spread[axis] > 0:
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(own[:, axis], mid)]
                stack += [(lo, lo + mid, node, 0), (lo + mid, hi, node, 1)]
        self.ids, self.x, self.low, self.high = ids[order], x[order], np.array(low), np.array(high)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries, nodes): the largest inner product each box allows."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(self, q: np.ndarray, own: int, bound: np.ndarray, k: int, floor, best: list[tuple] | None = None) -> list[tuple]:
        """The best (score, -id) of one query, at most k, none below floor; floor is the kth score known from elsewhere, best a
        heap of what trees before this one gave."""
        best = [] if best is None else best
        queue = [(-bound[0], 0)]
        while queue:
            reach, node = heapq.heappop(queue)
            least = best[0][0] if len(best) == k else floor
            if least is not None and -reach < max(least, floor if floor is not None else least):
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(queue, (-bound[child], child))
                continue
            lo, hi = self.rows[node]
            scores = self.x[lo:hi] @ q
            if least is not None:
                at = np.flatnonzero(scores >= least)
            else:
                at = np.arange(hi - lo)
            for i in at.tolist():
                if self.ids[lo + i] != own and (floor is None or scores[i] >= floor):
                    found = (scores[i], -self.ids[lo + i])
                    if len(best) < k:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
        return best


def integers(df: DataFrame, key: str, vector: str, scale: int = 1024) -> DataFrame:
    """(id, v): the rows that take part, with floor(scale * x) as doubles."""
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    big = F.transform(F.col(vector), lambda x: x.cast("double") * F.lit(float(scale)))
    safe = F.forall(F.col(vector), lambda x: F.abs(x) < 2**52 / scale)
    return df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).where(fine).select(F.col(key).cast("long").alias("id"), F.when(safe, v).otherwise(big).alias("v"))


def _packed(df: DataFrame, parts: int) -> DataFrame:
    """One row a part: ids and vectors as one block of bytes.  A part holds a bounded number of rows, dealt by hash."""

    def pack(table: pa.Table) -> pa.Table:
        ids, v = (table.column(c).combine_chunks() for c in ("id", "v"))
        width = pc.max(pc.list_value_length(v)).as_py()
        if pc.min(pc.list_value_length(v)).as_py() != width:
            raise ValueError("vectors differ in length")
        ids = ids.to_numpy()
        order = np.argsort(ids, kind="stable")
        x = np.floor(v.flatten().to_numpy().reshape(-1, width)[order])
        most = np.abs(x).max(initial=0)
        bits = 16 if most < 2**15 else 32 if most < 2**31 else 64
        data = x.astype({16: np.int16, 32: np.int32, 64: np.float64}[bits]).tobytes()
        own = [[table.column("part")[0].as_py()], [ids[order]], [width], [data], [bits], [bool(most < 2**22) and width < 2**8]]
        return pa.table([pa.array(c, t) for c, t in zip(own, (pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.int32(), pa.bool_()), strict=True)], names=_PACK.names)

    return df.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).groupBy("part").applyInArrow(pack, _PACK)


def _matrix(data: bytes, width: int, bits: int, exact: bool) -> np.ndarray:
    x = np.frombuffer(data, {16: np.int16, 32: np.int32, 64: np.float64}[bits]).reshape(-1, width)
    return x.astype(np.float64) if exact else np.array([[int(c) for c in row] for row in x.tolist()], dtype=object).reshape(-1, width)


_HIT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


class _Block:
    """A block of queries in a cell, and the best of each query so far."""

    def __init__(self, r: dict):
        self.part, self.ids, self.width, self.exact, self.raw = r["part"], r["ids"], r["width"], r["exact"], (r["data"], r["width"], r["bits"])
        floors = dict(r["floors"] or [])
        self.floors, self.best, self.of = [floors.get(i) for i in self.ids], [[] for _ in self.ids], {}

    def queries(self, exact: bool) -> np.ndarray:
        if exact not in self.of:
            self.of[exact] = _matrix(*self.raw, exact)
        return self.of[exact]

    def meet(self, r: dict, trees: dict, k: int) -> None:
        if self.width != r["width"]:
            raise ValueError("vectors differ in length")
        exact = r["exact"] and self.exact
        if exact not in trees:
            trees[exact] = Tree(np.array(r["ids"], np.int64), _matrix(r["data"], r["width"], r["bits"], exact))
        tree, q = trees[exact], self.queries(exact)
        bounds = tree.bounds(q)
        for i, own in enumerate(self.ids):
            tree.search(q[i], own, bounds[i], k, self.floors[i], self.best[i])


def _searched(blocks: DataFrame, trees: DataFrame, cells: int, k: int, skip: int = 0) -> DataFrame:
    """(query_id, vec_id, score) of blocks (cell, and floors by query) and trees of the same cell, at most k a query and cell.

    A cell's blocks come first and are held, then its trees one by one.  skip: a block passes over the tree numbered its own
    number modulo skip."""

    @trimmed
    def run(batches):
        cell, held = None, []

        def ended():
            out = [(own, -int(v), int(s)) for b in held for own, best in zip(b.ids, b.best, strict=True) for s, v in best]
            for lo in range(0, len(out), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out[lo : lo + (1 << 16)]], pa.int64()) for j in range(3)], names=_HIT.names)

        for batch in batches:
            for n in range(batch.num_rows):
                (r,) = batch.slice(n, 1).to_pylist()
                if r["cell"] != cell:
                    yield from ended()
                    cell, held = r["cell"], []
                if not r["tree"]:
                    held.append(_Block(r))
                    continue
                made: dict = {}
                for b in held:
                    if not skip or r["part"] != b.part % skip:
                        b.meet(r, made, k)
        yield from ended()

    own = ["cell", "tree", *_PACK.names, "floors"]
    both = blocks.withColumn("tree", F.lit(False)).select(own).unionByName(trees.withColumns({"tree": F.lit(True), "floors": F.lit(None).cast("map<bigint,bigint>")}).select(own))
    # Twice as many partitions as cells, as a hash deals them.
    return both.repartition(2 * cells, "cell").sortWithinPartitions("cell", "tree", "part").mapInArrow(run, _HIT)


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query; at most k hits a query and shard come in, and Spark keeps k per task before its shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row of `queries` against every row of `vectors`."""
    rows = written(integers(vectors, key, vector, scale), "vectors")
    asked = written(integers(queries, key, vector, scale).groupBy("id").agg(F.min("v").alias("v")), "queries")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    n_asked = asked.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-n_asked // BLOCK))
    trees, block = written(_packed(rows, shards), "shards"), written(_packed(asked, blocks), "blocks")
    dropped(rows, asked)
    # A block's first shard; shards that are nobody's first stay where they are.
    firsts = min(shards, blocks)
    first = block.withColumns({"cell": F.col("part") % F.lit(shards), "floors": F.lit(None).cast("map<bigint,bigint>")})
    hits = written(_searched(first, trees.where(F.col("part") < firsts).withColumn("cell", F.col("part")), firsts, k), "hits")
    # The kth score of a query with k hits bounds all other shards.
    kth = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    owner = kth.withColumn("part", F.pmod(F.xxhash64(F.col("query_id")), F.lit(blocks)).cast("int"))
    floors = owner.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "kth"))).alias("floors"))
    bands = max(1, -(-n_asked // max(BLOCK, min(BAND, BAND_BYTES // (8 * max(1, width or 1))))))
    groups = min(shards, max(-(-shards // GROUP), 2 * vectors.sparkSession.sparkContext.defaultParallelism))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = block.join(floors.hint("merge"), "part", "left").withColumn("group", each(groups)).withColumn("cell", F.col("part") % bands * groups + F.col("group"))
    asked_of = trees.withColumn("band", each(bands)).withColumn("cell", F.col("band") * groups + F.col("part") % groups)
    later = _searched(asking, asked_of, bands * groups, k, shards)
    return _best(hits.unionByName(later), k).select("query_id", "rank", "vec_id", "score")
