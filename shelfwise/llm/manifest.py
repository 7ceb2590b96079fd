"""A Merkle manifest of a dataset: a digest for each row, trees of eight over them, a proof for each row.

Leaves are native expressions: SHA-256 over id, source, language, character count and text, each `-` if null, else its
count of UTF-8 bytes, a colon and itself. The leaves of a language ascend by id; runs of eight nodes become the digest of
their joined hex digests until one is left, its subroot. The subroots, by language (null first), likewise give the root.

The trees are built as an associative monoid. A fragment is a sparse forest: unresolved nodes keyed by (tree, level, index).
How many nodes a run has follows from the tree's count of leaves, so a fragment replaces a run by its parent as soon as
all of it is there, wherever the pieces came from; a finished tree becomes a leaf of the tree of subroots. Each task folds
the rows of its files; then fragments of neighbouring ranges merge, FAN at a time, until one is left (a tree reduction on
DataFrames, as Spark's own merges fragments that are no neighbours and leaves the last to the driver). A fragment of
neighbours holds at most seven nodes a level at each edge of its range. Resolved runs above BLOCK_LEVEL are written; joins
hand them down as paths to blocks of 8^BLOCK_LEVEL leaves, and each block folds its own rows again for the proofs.

Verification: the leaf of a tampered text (A-Z lower-cased) is folded with the original siblings; it verifies if the root
comes out.

Defined results: null and empty fields differ; a row without an id comes first in its language; rows that share an id are
ordered by their leaves, so equal rows stand together; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, lower_ascii, staged

ARITY = 8
#: Proofs are made for aligned blocks of ARITY ** BLOCK_LEVEL leaves of a tree.
BLOCK_LEVEL = 4
#: Fragments that merge in one task of the reduction.
FAN = 16
#: The tree of subroots.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(docs: DataFrame, text: Column) -> Column:
    return F.sha2(F.concat(*[field(docs[c]) for c in FIELDS[:-1]], field(text)), 256)


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def nodes_at(n: int, level: int) -> int:
    """Nodes on a level of a tree of n leaves."""
    return -(-n // ARITY**level)


class Forest:
    """Unresolved nodes of any trees, and the runs of level `block` and above that were resolved. sizes: leaves of each tree,
    TOP's own included."""

    def __init__(self, trees: int, block: int = BLOCK_LEVEL):
        self.block, self.sizes = block, {TOP: trees}
        self.open: dict[tuple[int, int, int], dict[int, str]] = defaultdict(dict)
        self.closed: list[tuple[int, int, int, list[str]]] = []

    def add(self, tree: int, leaves: int, level: int, index: int, node: str) -> None:
        self.sizes[tree] = leaves
        while True:
            width = nodes_at(self.sizes[tree], level)
            if width == 1 and tree == TOP:
                self.open[tree, level, 0][0] = node
                return
            if width == 1:  # the tree is done; its subroot is a leaf of the tree of subroots
                tree, level, index = TOP, 0, tree
                continue
            parent = index // ARITY
            run = self.open[tree, level, parent]
            run[index] = node
            if len(run) < min(ARITY, width - ARITY * parent):
                return
            children = [run[i] for i in sorted(run)]
            del self.open[tree, level, parent]
            if tree == TOP or level >= self.block:
                self.closed.append((tree, level, parent, children))
            level, index, node = level + 1, parent, digest("".join(children))

    def unresolved(self) -> Iterator[tuple[int, int, int, int, str]]:
        for (tree, level, _), run in self.open.items():
            for index, node in run.items():
                yield tree, self.sizes[tree], level, index, node


FRAGMENT = "part long, tree long, leaves long, level int, index long, node string, children array<string>"


def fragment_rows(forests: dict[int, Forest]) -> pa.RecordBatch:
    rows = [(p, *x, None) for p, f in forests.items() for x in f.unresolved()]
    rows += [(p, t, f.sizes[t], level, parent, None, children) for p, f in forests.items() for t, level, parent, children in f.closed]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=[x.split()[0] for x in FRAGMENT.split(", ")])


def first_fragments(leaves: DataFrame, trees: int, block: int) -> DataFrame:
    """A fragment for each range of leaves and task that reads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests: dict[int, Forest] = {}
        for b in batches:
            for part, tree, n, index, node in zip(*[b[c].to_pylist() for c in ("part", "tree", "leaves", "index", "leaf")], strict=True):
                forests.setdefault(part, Forest(trees, block)).add(tree, n, 0, index, node)
            for p, f in forests.items():  # resolved runs need not wait
                if len(f.closed) > 1000:
                    done, f.closed = f.closed, []
                    done_only = Forest(trees, block)
                    done_only.sizes, done_only.closed = f.sizes, done
                    yield fragment_rows({p: done_only})
        yield fragment_rows(forests)

    return leaves.mapInArrow(run, FRAGMENT)


def merged(fragments: DataFrame, trees: int, block: int) -> DataFrame:
    """Fragments of FAN neighbouring ranges as one."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        forest = Forest(trees, block)
        for _, tree, n, level, index, node, _ in zip(*[c.to_pylist() for c in table.columns], strict=True):
            forest.add(tree, n, level, index, node)
        return pa.Table.from_batches([fragment_rows({key[0].as_py(): forest})])

    return fragments.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInArrow(run, FRAGMENT)


def numbered_leaves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, leaf, tampered, part, tree, leaves, index: each leaf's place in the tree of its language, from one range sort; the
    ranges)."""
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), leaf(docs, docs["text"]).alias("leaf"),
        F.when(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0, leaf(docs, lower_ascii(docs["text"]))).alias("tampered"),
        F.monotonically_increasing_id().alias("tie"),  # parts equal rows, so that no range need hold all of them
    )
    order = ["lang", "doc_id", "leaf", "tie"]
    place = F.monotonically_increasing_id()
    rows = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("place", place), "leaves")
    part = F.shiftright("place", 33)
    runs = rows.groupBy(part.alias("part"), "lang").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    # a row for each range and language: ranges ascend by language
    every = Window.orderBy(F.col("lang").asc_nulls_first())
    runs = staged(runs.select("*", (F.dense_rank().over(every) - 1).cast("long").alias("tree"), F.sum("n").over(Window.partitionBy("lang")).alias("leaves"), (F.sum("n").over(Window.partitionBy("lang").orderBy("part")) - F.col("n")).alias("before")).withColumnRenamed("part", "own_part").withColumnRenamed("lang", "own_lang"), "runs")
    placed = rows.withColumn("part", part).join(few(runs), (F.col("part") == F.col("own_part")) & F.col("lang").eqNullSafe(F.col("own_lang")))
    placed = placed.select("doc_id", "leaf", "tampered", "part", "tree", "leaves", (F.col("before") + F.col("place") - F.col("first")).alias("index"))
    return placed, runs


def forest_runs(leaves: DataFrame, trees: int, parts: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(resolved runs above the blocks, the root) by merging fragments until one is left."""
    found = []
    now = staged(first_fragments(leaves, trees, block), "fragments")
    while True:
        found.append(now.where("children is not null"))
        if parts <= 1:
            break
        parts = -(-parts // FAN)
        now = staged(merged(now.where("children is null"), trees, block), "fragments")
    runs = found[0]
    for x in found[1:]:
        runs = runs.unionByName(x)
    return runs.select("tree", "level", F.col("index").alias("parent"), "children"), now.where(f"children is null and tree = {TOP}").select("level", F.col("node").alias("root"))


def depth(n: Column) -> Column:
    """Levels above n leaves: how often they are cut to an eighth, rounded up, before one is left."""
    return sum(((n > ARITY**k).cast("int") for k in range(21)), F.lit(0))


def paths(runs: DataFrame, root: DataFrame, sizes: DataFrame, trees: int, longest: int, block: int) -> DataFrame:
    """tree, block, subroot, root, path: for each block of leaves the siblings above it, a (left, right) for each level."""
    pair = "array<struct<left:string,right:string>>"

    def opened(nodes: DataFrame, runs: DataFrame) -> DataFrame:
        """The children of nodes (tree, level, index, node, path and more)."""
        more = [c for c in nodes.columns if c not in ("tree", "level", "index", "node", "path")]
        both = nodes.join(runs.select(F.col("tree").alias("t"), F.col("level").alias("l"), "parent", "children"), (F.col("tree") == F.col("t")) & (F.col("index") == F.col("parent")) & (F.col("level") == F.col("l") + 1))
        side = lambda a, n: F.array_join(F.slice("children", a, n), "")
        steps = both.select("*", F.posexplode("children").alias("i", "child"))
        here = F.struct(side(F.lit(1), F.col("i")).alias("left"), side(F.col("i") + 2, F.lit(ARITY)).alias("right"))
        return steps.select("tree", F.col("l").alias("level"), (F.col("parent") * ARITY + F.col("i")).alias("index"), F.col("child").alias("node"), F.concat(F.array(here), "path").alias("path"), *more)

    top, level = runs.where(f"tree = {TOP}"), 0
    while ARITY**level < trees:
        level += 1
    now = root.select(F.lit(TOP).cast("long").alias("tree"), F.lit(level).alias("level"), F.lit(0).cast("long").alias("index"), F.col("root").alias("node"), F.array().cast(pair).alias("path"), "root")
    for _ in range(level):
        now = opened(now, top)
    now = now.join(sizes, F.col("index") == F.col("t_tree")).select(F.col("index").alias("tree"), depth(F.col("leaves")).alias("level"), F.lit(0).cast("long").alias("index"), "node", "path", "root", F.col("node").alias("subroot"))
    low, level = runs.where(f"tree <> {TOP}"), 0
    while ARITY**level < longest:
        level += 1
    for k in range(level, block, -1):
        now = opened(now.where(F.col("level") == k), low.where(F.col("level") == k - 1)).unionByName(now.where(F.col("level") < k))
    return now.select("tree", F.col("index").alias("block"), "level", "subroot", "root", "path")


PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs_of(block: int):
    """The proofs of one block of leaves: its lower levels from its own leaves, the rest from the path above it."""

    def prove(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        top = above.to_pylist()[0]
        rows = rows.sort_by("index")
        ids, leaves, tampered = (rows[c].to_pylist() for c in ("doc_id", "leaf", "tampered"))
        levels = [leaves]
        for _ in range(min(block, top["level"])):
            now = levels[-1]
            levels.append([digest("".join(now[i : i + ARITY])) for i in range(0, len(now), ARITY)])
        sides = []
        for now in levels[:-1]:
            runs = [now[i : i + ARITY] for i in range(0, len(now), ARITY)]
            sides.append([("".join(run[:j]), "".join(run[j + 1 :])) for run in runs for j in range(len(run))])
        rest = [(p["left"], p["right"]) for p in top["path"]]
        rest_text = "".join(a + b for a, b in rest)
        proofs, roots = [], []
        for i, own in enumerate(leaves):
            own = tampered[i] or own
            at, said = i, []
            for side in sides:
                left, right = side[at]
                said += left, right
                own = digest(left + own + right)
                at //= ARITY
            for left, right in rest:
                own = digest(left + own + right)
            proofs.append(digest("".join(said) + rest_text))
            roots.append(own)
        n = len(ids)
        return pa.table([pa.array(ids, pa.int64()), leaves, [top["subroot"]] * n, [top["root"]] * n, proofs, roots, [r == top["root"] for r in roots]], names=[x.split()[0] for x in PROVED.split(", ")])

    return prove


def merkle_manifest(docs: DataFrame, block: int = BLOCK_LEVEL) -> DataFrame:
    leaves, ranges = numbered_leaves(docs)
    seen = ranges.agg(F.max("tree").alias("tree"), F.max("own_part").alias("part"), F.max("leaves").alias("leaves")).first()
    if seen.tree is None:
        return docs.sparkSession.createDataFrame([], PROVED)
    trees = seen.tree + 1
    runs, root = forest_runs(leaves, trees, seen.part + 1, block)
    sizes = ranges.select(F.col("tree").alias("t_tree"), "leaves").distinct()
    above = paths(runs, root, sizes, trees, seen.leaves, block)
    blocks = leaves.select("doc_id", "leaf", "tampered", "tree", F.floor(F.col("index") / ARITY**block).alias("block"), "index")
    return blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(proofs_of(block), PROVED)
