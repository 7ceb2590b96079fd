"""Approximate nearest neighbours by inner product: a neighbour graph from NN-descent, and greedy search on it.

Rows are first gathered into nodes, one for each different vector, which keep the smallest ids that hold it: no answer of
`most` rows can need more, so a vector that a third of the rows share is one node and none of its rows is lost. Vectors get
one more component that makes their lengths equal, so the nearest by inner product is the nearest by angle, whatever
lengths they have; queries get a zero there.

Building. Pivots (a bounded sample, see PIVOTS) deal nodes into overlapping cells, whose members find their first neighbours
among each other. Then NN-descent: the members of a node's list and those that list it (LISTED of them, drawn by hash) are
introduced to each other, as far as one of the two is new in that list; each keeps its nearest DEGREE. Lists are
an edge table; each round is a join of edges with nodes, a join by block of the lists with the vectors that they name, and
a merge. A block is a group of near nodes of bounded size, so a vector travels once for each block that names it, not
once for each list.

Searching. A query starts at its own node if the index has one, else at its nearest pivots. It asks the blocks of the nodes
that it wants to see; a block scores them, follows their neighbours inside itself while they are better than what the query
has (its best BEAM nodes), and answers with what it found and with the better nodes' neighbours in other blocks, which are
asked next. The search ends when nobody asks any more. At last scores are computed in double precision on the original
vectors, summed in the order of their components.

Defined results: rows with a null id take no part, nor do vectors that are null, empty, zero or hold null or non-finite
components; shorter vectors count as followed by zeros; rows that share id and vector are one; a query's own id is never
among its answers; ties go to the smaller id; an empty table gives no rows.

Bounds: pivots and their cells' counts on the driver (PIVOTS rows), cells of CELL_MOST and blocks of BLOCK nodes in a task (larger
ones are split by hash), GROUP queries of one vector together, CHUNK askers of a block in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, few, staged

#: Neighbours in a node's list, and how many of those that list it are introduced in a round.
DEGREE, LISTED = 24, 16
#: Rounds of NN-descent at most; it ends earlier when under ENOUGH of the edges were new in the last one.
ROUNDS, ENOUGH = 4, 0.05
#: One pivot for CELL nodes, PIVOTS at most; a node is in the cells of its PROBES nearest ones.
CELL, PIVOTS, PROBES, CELL_MOST = 256, 4096, 4, 2048
#: Nodes of a block at most.
BLOCK = 12288
#: What a query keeps in sight, and its rounds at most (each one follows paths inside blocks as far as they lead).
BEAM, HOPS = 128, 24
#: Nodes that a block follows up together.
STEP = 16
#: Queries with the same vector in one search; askers of a block in one task.
GROUP, CHUNK = 1000, 4096
#: Nodes of a query's last list that are scored again in double precision, beyond the number asked for.
SPARE = 20


def numbers(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id long, vec array<double>) of the rows that take part, each once."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    out = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[vec_col].cast("array<double>").alias("vec"))
    return out.where(F.col("vec_id").isNotNull() & F.forall("vec", fine) & F.exists("vec", lambda x: x != 0)).distinct()


def padded(vec: Column, dim: int) -> Column:
    return F.concat(vec, F.array_repeat(F.lit(0.0), F.lit(dim) - F.size(vec)))


def nodes_of(rows: DataFrame, most: int) -> tuple[DataFrame, int, int, float]:
    """(node, vec, ids: the most + 1 smallest) for each different vector; nodes, components, greatest squared length."""
    dim = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    own = rows.select("vec_id", padded(F.col("vec"), dim).alias("vec")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for keys in (["vec", "salt"], ["vec"]):  # a hot vector is cut down in many tasks first
        own = own.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("n") <= most + 1)
    own = own.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = staged(own.select(F.monotonically_increasing_id().alias("node"), "vec", "ids"), "nodes")
    length = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    seen = nodes.agg(F.count("*"), F.max(length)).first()
    return nodes, seen[0], dim, seen[1] or 0.0


def level(vec: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that makes their lengths equal."""
    return np.column_stack([vec, np.sqrt(np.maximum(0.0, longest - (vec * vec).sum(1)))]).astype(np.float32)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, max(1, rows.shape[1]), dtype=np.int32)), pa.array(rows.ravel(), kind))


def dealt(nodes: DataFrame, pivots: np.ndarray, blocks: int, dim: int, longest: float) -> DataFrame:
    """node, near (the levelled vector), home (nearest of the first `blocks` pivots), cells (PROBES nearest pivots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                near = level(matrix(part["vec"], dim), longest)
                score = near @ pivots.T
                probes = min(PROBES, len(pivots))
                cells = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
                yield pa.RecordBatch.from_arrays([part["node"], lists(near, pa.float32()), pa.array(score[:, :blocks].argmax(1), pa.int64()), lists(cells, pa.int64())], names=["node", "near", "home", "cells"])

    return nodes.select("node", "vec").mapInArrow(run, "node long, near array<float>, home long, cells array<long>")


def split(rows: DataFrame, key: str, most: int) -> DataFrame:
    """rows with `key` cut into shares of about `most` rows, by the hash of their node."""
    shares = rows.groupBy(key).agg(F.ceil(F.count("*") / most).alias("shares")).withColumnRenamed(key, "whole")
    both = rows.join(F.broadcast(shares), F.col(key) == F.col("whole"))  # a row for each pivot
    return both.withColumn(key, F.col(key) * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("shares"))).drop("whole", "shares")


EDGE = "u long, ub long, v long, vb long, score float"


def edges(u: np.ndarray, ub: np.ndarray, v: np.ndarray, vb: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table([pa.array(u, pa.int64()), pa.array(ub, pa.int64()), pa.array(v, pa.int64()), pa.array(vb, pa.int64()), pa.array(score, pa.float32())], names=["u", "ub", "v", "vb", "score"])


def first_edges(dim: int, degree: int):
    """The nearest nodes of each member of a cell within it."""

    def run(table: pa.Table) -> pa.Table:
        node, block, near = table["node"].to_numpy(), table["block"].to_numpy(), matrix(table["near"], dim + 1)
        k = min(degree, len(node) - 1)
        if k < 1:
            return edges(*[np.empty(0, np.int64)] * 4, np.empty(0, np.float32))
        score = near @ near.T
        np.fill_diagonal(score, -np.inf)
        best = np.argpartition(-score, k - 1, axis=1)[:, :k]
        u, v = np.repeat(np.arange(len(node)), k), best.ravel()
        return edges(node[u], block[u], node[v], block[v], score[u, v])

    return run


def nearest(found: DataFrame, degree: int) -> DataFrame:
    """The `degree` best edges of each node; an edge is fresh if every row of it is."""
    once = found.repartition("u").groupBy("u", "v").agg(F.first("ub").alias("ub"), F.first("vb").alias("vb"), F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("score"), "v"))
    return once.withColumn("place", place).where(F.col("place") <= degree).select("u", "ub", "v", "vb", "score", "fresh")


def introduced(dim: int, degree: int):
    """Edges between members of the same list of a block that are better than what the nearer end has."""

    def run(key: tuple, lists_: pa.Table, vectors: pa.Table) -> pa.Table:
        vectors = vectors.sort_by("w")
        node, block, least = (vectors[c].to_numpy() for c in ("w", "wb", "least"))
        near = matrix(vectors["near"], dim + 1)
        lists_ = lists_.sort_by("u")
        owner, member, fresh = lists_["u"].to_numpy(), np.searchsorted(node, lists_["v"].to_numpy()), lists_["fresh"].to_numpy().astype(bool)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[starts, len(owner)])
        column = np.arange(len(owner)) - np.repeat(starts, sizes)
        row = np.repeat(np.arange(len(starts)), sizes)
        grid, news = np.full((len(starts), sizes.max()), -1), np.zeros((len(starts), sizes.max()), bool)
        grid[row, column], news[row, column] = member, fresh
        pairs, scores = [np.empty(0, np.int64)], [np.empty(0, np.float32)]
        for at in range(0, len(grid), 256):
            g, f = grid[at : at + 256], news[at : at + 256]
            x = near[g]
            s = x @ x.transpose(0, 2, 1)
            good = (f[:, :, None] | f[:, None, :]) & (g >= 0)[:, :, None] & (g >= 0)[:, None, :] & (g[:, :, None] != g[:, None, :]) & (s > least[g][:, :, None])
            i, j, k = np.nonzero(good)
            pairs.append(g[i, j] * len(node) + g[i, k])
            scores.append(s[i, j, k])
        pair, at = np.unique(np.concatenate(pairs), return_index=True)
        score = np.concatenate(scores)[at]
        order = np.lexsort((-score, pair // len(node)))
        pair, score = pair[order], score[order]
        a, b = pair // len(node), pair % len(node)
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
        place = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
        keep = place < degree
        return edges(node[a[keep]], block[a[keep]], node[b[keep]], block[b[keep]], score[keep])

    return run


def both_ways(graph: DataFrame, turn: int) -> DataFrame:
    """Each node's list and LISTED of those that list it, so that nodes in nobody's list are found too."""
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("v", F.lit(turn)), "v"))
    listed = graph.select(F.col("v").alias("u"), F.col("vb").alias("ub"), F.col("u").alias("v"), F.col("ub").alias("vb"), "fresh")
    listed = listed.withColumn("place", place).where(F.col("place") <= LISTED).drop("place")
    return graph.select("u", "ub", "v", "vb", "fresh").unionByName(listed)


def descend(graph: DataFrame, nodes: DataFrame, dim: int, degree: int, turn: int) -> DataFrame:
    """One round of NN-descent: neighbours of neighbours meet."""
    members = both_ways(graph, turn)
    moving = F.max("fresh").over(Window.partitionBy("u"))  # in a list without anyone new all have met
    members = members.withColumn("moving", moving).where("moving").drop("moving")
    least = graph.groupBy("u").agg(F.when(F.count("*") >= degree, F.min("score")).otherwise(float("-inf")).cast("float").alias("least"))
    known = nodes.select("node", "near").join(least, F.col("node") == F.col("u"), "left").select("node", "near", F.coalesce("least", F.lit(float("-inf")).cast("float")).alias("least"))
    wanted = members.select("ub", "v", "vb").distinct().join(known, F.col("v") == F.col("node")).select("ub", "v", "vb", "near", "least").toDF("to", "w", "wb", "near", "least")
    # members' lists and their vectors meet by block
    new = members.select("ub", "u", "v", "fresh").groupBy("ub").cogroup(wanted.groupBy("to")).applyInArrow(introduced(dim, degree), EDGE)
    old = graph.withColumn("fresh", F.lit(False))
    return nearest(old.unionByName(new.withColumn("fresh", F.lit(True))), degree)


class Index:
    """nodes (node, vec, ids), graph (block, node, near, next, next_block) and pivots (node, block, near) of a table."""

    def __init__(self, rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 20):
        self.most = most
        self.nodes, self.count, self.dim, self.longest = nodes_of(numbers(rows, id_col, vec_col), most)
        if not self.count:
            return
        dim, degree = self.dim, max(DEGREE, most)
        chosen = self.nodes.orderBy(F.xxhash64("node"), "node").limit(min(PIVOTS, -(-self.count // CELL)))
        chosen = chosen.toPandas()  # a bounded sample
        pivots = level(np.array(chosen["vec"].tolist(), float), self.longest)
        homes = max(1, min(len(pivots), -(-self.count // BLOCK)))
        placed = dealt(self.nodes, pivots, homes, dim, self.longest)
        self.placed = placed = staged(split(staged(placed, "dealt"), "home", BLOCK).withColumnRenamed("home", "block"), "placed")
        cells = split(placed.select("node", "block", "near", F.explode("cells").alias("cell")), "cell", CELL_MOST)
        graph = cells.groupBy("cell").applyInArrow(first_edges(dim, degree), EDGE)
        graph = staged(nearest(graph.withColumn("fresh", F.lit(True)), degree), "graph")
        for turn in range(ROUNDS):
            before, graph = graph, staged(descend(graph, placed, dim, degree, turn), "graph")
            discard(before)
            if (graph.agg(F.avg(F.col("fresh").cast("int"))).first()[0] or 0) < ENOUGH:
                break
        self.edges = graph
        lists_ = both_ways(graph, ROUNDS).groupBy("u").agg(F.collect_list("v").alias("next"), F.collect_list("vb").alias("next_block"))
        none = F.array().cast("array<long>")
        self.graph = staged(placed.join(lists_, F.col("node") == F.col("u"), "left").select("block", "node", "near", F.coalesce("next", none).alias("next"), F.coalesce("next_block", none).alias("next_block")), "index")
        at = {r.node: r.block for r in placed.join(F.broadcast(placed.sparkSession.createDataFrame([(int(x),) for x in chosen["node"]], "p long")), F.col("node") == F.col("p")).select("node", "block").collect()}
        self.pivots = chosen["node"].to_numpy(), np.array([at[x] for x in chosen["node"]]), pivots

    def search(self, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """query_id, rank, vec_id, score: the `most` nearest that the search finds for each query."""
        asked = numbers(queries, id_col, vec_col)
        if not self.count:
            return asked.sparkSession.createDataFrame([], ANSWER)
        dim = self.dim
        # in the index's components: what a query has beyond them meets zeros
        asked = asked.withColumn("vec", F.slice(padded(F.col("vec"), dim), 1, dim)) if dim else asked
        same = asked.groupBy("vec", F.floor(F.col("vec_id") / GROUP).alias("part")).agg(F.sort_array(F.collect_set("vec_id")).alias("askers"))
        own = self.nodes.select("node", F.col("vec").alias("own"))
        units = same.join(own, F.col("vec") == F.col("own"), "left").select(F.monotonically_increasing_id().alias("unit"), "vec", "askers", "node")
        units = staged(units, "units")
        state = staged(self.starts(units), "search")
        for _ in range(HOPS):
            if state.where(F.size("wanted") > 0).isEmpty():
                break
            before, state = state, staged(self.hop(state), "search")
            discard(before)
        return self.ranked(units, state)

    def starts(self, units: DataFrame) -> DataFrame:
        """Each unit's first asks: its own node, else its nearest pivots."""
        nodes, blocks, near = self.pivots
        dim, probes = self.dim, min(PROBES, len(nodes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                vec = np.column_stack([matrix(b["vec"], dim), np.zeros(b.num_rows)]).astype(np.float32)
                best = np.argpartition(-(vec @ near.T), probes - 1, axis=1)[:, :probes]
                rows = []
                for unit, x, own, block, row in zip(b["unit"].to_pylist(), vec, b["node"].to_pylist(), b["block"].to_pylist(), best, strict=True):
                    first = [(block, own)] if own is not None else [(int(blocks[i]), int(nodes[i])) for i in row]
                    rows.append((unit, x, -np.inf, [], [], None, None, None))
                    rows += [(unit, x, -np.inf, None, None, k, [i for at, i in first if at == k], None) for k in {at for at, _ in first}]
                yield batch(rows, STATE)

        at = self.placed.select(F.col("node").alias("own"), "block")
        return units.select("unit", "vec", "node").join(at, F.col("node") == F.col("own"), "left").select("unit", "vec", "node", "block").mapInArrow(run, STATE)

    def hop(self, state: DataFrame) -> DataFrame:
        """Blocks answer what they are asked; units take the answers in and say what they ask next."""
        waiting = F.coalesce(F.size("wanted") > 0, F.lit(False))
        asks = state.where(waiting).select("unit", "near", "least", "block", "wanted", "seen")
        shares = few(asks.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).alias("shares")).withColumnRenamed("block", "whole"))
        same = F.col("block") == F.col("whole")
        asks = asks.join(shares, same).withColumn("chunk", F.pmod(F.xxhash64("unit"), F.col("shares"))).drop("whole", "shares")
        index = self.graph.join(shares, same).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).select(F.col("block").alias("own_block"), "chunk", "node", "near", "next", "next_block")
        told = asks.groupBy("block", "chunk").cogroup(index.groupBy("own_block", "chunk")).applyInArrow(answered(self.dim), REPLY)
        none = F.lit(None)
        kept = state.where(~waiting).select("unit", "near", "found", "scores", "block", "seen", none.cast("array<long>").alias("out"), none.cast("array<long>").alias("out_block"))
        both = kept.unionByName(told.withColumn("near", none.cast("array<float>")))
        return both.repartition("unit").sortWithinPartitions("unit").mapInArrow(taken_in, STATE)

    def ranked(self, units: DataFrame, state: DataFrame) -> DataFrame:
        """The nearest rows of the nodes that each unit found, scored in double precision, for each of its askers."""
        most = self.most
        seen = state.select(F.col("unit").alias("u"), F.explode(F.slice("found", 1, most + SPARE)).alias("n"))  # null but in a unit's own row
        seen = seen.join(self.nodes, F.col("n") == F.col("node")).select("u", F.col("vec").alias("own"), "ids")
        score = F.aggregate(F.zip_with("vec", "own", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        scored = units.join(seen, F.col("unit") == F.col("u")).select("unit", "askers", score.alias("score"), F.explode("ids").alias("vec_id"))
        best = scored.withColumn("place", F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= most + 1)
        best = best.groupBy("unit").agg(F.first("askers").alias("askers"), F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
        each = best.select(F.explode("askers").alias("query_id"), "best")
        rest = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, most)
        return each.select("query_id", F.posexplode(rest).alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


ANSWER = "query_id long, rank int, vec_id long, score double"
#: What a search knows: for each unit a row with its vector and what it found, nearest first; for each block that it has been
#: to or goes to next, a row with the nodes that it wants there and a bit for each of the block's nodes that it has seen.
STATE = "unit long, near array<float>, least float, found array<long>, scores array<float>, block long, wanted array<long>, seen binary"
REPLY = "unit long, found array<long>, scores array<float>, block long, seen binary, out array<long>, out_block array<long>"
KINDS = {"long": pa.int64(), "float": pa.float32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<float>": pa.list_(pa.float32())}


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def answered(dim: int):
    """What a block has for those that ask it: walks from the wanted nodes over its own, as long as they are near enough."""

    def run(key: tuple, asks: pa.Table, index: pa.Table) -> pa.Table:
        index = index.sort_by("node")
        node, near = index["node"].to_numpy(), matrix(index["near"], dim + 1)
        following, blocks = index["next"].combine_chunks(), index["next_block"].combine_chunks()
        sizes = np.diff(following.offsets.to_numpy())
        shape = (len(node), max(1, sizes.max(initial=1)))
        cell = np.repeat(np.arange(len(node)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids, there = np.full(shape, -1), np.full(shape, -1)
        ids[cell], there[cell] = following.flatten().to_numpy(), blocks.flatten().to_numpy()
        at = np.minimum(np.searchsorted(node, ids), len(node) - 1)
        local = node[at] == ids
        rows = []
        vectors = matrix(asks["near"], dim + 1)
        for unit, q, least, wanted, seen in zip(asks["unit"].to_pylist(), vectors, asks["least"].to_pylist(), asks["wanted"].to_pylist(), asks["seen"].to_pylist(), strict=True):
            seen = np.zeros(len(node), bool) if seen is None else np.unpackbits(np.frombuffer(seen, np.uint8), count=len(node)).astype(bool)
            front = np.searchsorted(node, np.array(wanted))
            front = front[~seen[front]]
            found, scores, todo = np.empty(0, int), np.empty(0, np.float32), np.empty(0, bool)
            outs, out_blocks = [np.empty(0, int)], [np.empty(0, int)]
            while len(front):
                seen[front] = True
                found, scores, todo = np.r_[found, front], np.r_[scores, near[front] @ q], np.r_[todo, np.ones(len(front), bool)]
                if len(found) > BEAM:
                    best = np.argpartition(-scores, BEAM - 1)[:BEAM]
                    found, scores, todo = found[best], scores[best], todo[best]
                    least = max(least, float(scores[-1]))  # argpartition leaves the least of them there
                front = found[:0]
                while len(front) == 0:
                    good = np.flatnonzero(todo & (scores >= least))
                    if len(good) == 0:
                        break
                    good = good[np.argsort(-scores[good], kind="stable")[:STEP]]
                    todo[good] = False
                    step = found[good]
                    inside = local[step]
                    outs.append(ids[step][~inside])
                    out_blocks.append(there[step][~inside])
                    front = np.unique(at[step][inside])
                    front = front[~seen[front]]
            best = np.argsort(-scores, kind="stable")
            out, first = np.unique(np.concatenate(outs), return_index=True)
            known = out >= 0
            rows.append((unit, node[found[best]], scores[best], key[0].as_py(), np.packbits(seen).tobytes(), out[known], np.concatenate(out_blocks)[first][known]))
        return pa.Table.from_batches([batch(rows, REPLY)])

    return run


def taken_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by unit: its own, those of blocks that it asked nothing this time, and the answers that it got."""

    def closed(unit: int, rows: list[tuple]) -> Iterator[tuple]:
        near = next(r[0] for r in rows if r[0] is not None)
        found, first = np.unique(np.concatenate([r[1] for r in rows if r[1] is not None]), return_index=True)
        scores = np.concatenate([r[2] for r in rows if r[2] is not None])[first]
        order = np.lexsort((found, -scores))[:BEAM]
        least = scores[order[-1]] if len(order) >= BEAM else -np.inf
        yield unit, near, least, found[order], scores[order], None, None, None
        seen, wanted = {r[3]: r[4] for r in rows if r[3] is not None}, {}
        outs = [r for r in rows if r[5] is not None and len(r[5])]
        if outs:
            out, first = np.unique(np.concatenate([r[5] for r in outs]), return_index=True)
            block = np.concatenate([r[6] for r in outs])[first]
            new = ~np.isin(out, found, assume_unique=True)
            out, block = out[new], block[new]
            wanted = {int(b): out[block == b] for b in np.unique(block)}
        for b in seen.keys() | wanted.keys():
            yield unit, near if b in wanted else None, least, None, None, b, wanted.get(b), seen.get(b)

    unit, rows, done = None, [], []
    for b in batches:
        columns = [b[c] for c in ("near", "found", "scores", "block", "seen", "out", "out_block")]
        plain = {3, 4}
        for i, own in enumerate(b["unit"].to_pylist()):
            if own != unit:
                if rows:
                    done += closed(unit, rows)
                unit, rows = own, []
            rows.append(tuple((c[i].as_py() if k in plain else c[i].values.to_numpy()) if c[i].is_valid else None for k, c in enumerate(columns)))
            if len(done) >= 500:
                yield batch(done, STATE)
                done = []
    if rows:
        done += closed(unit, rows)
    if done:
        yield batch(done, STATE)


def nearest_neighbours(queries: DataFrame, rows: DataFrame, most: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the `most` nearest of rows for each of queries."""
    return Index(rows, id_col, vec_col, most).search(queries, id_col, vec_col)
