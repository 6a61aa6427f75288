"""Near-duplicate vectors by random-projection trees with overlapping halves, which part no link.

Vectors are only compared within a label. Equal vectors are one class first. On a bounded sample several trees are grown
for each label, and the one that leaves the fewest pairs is taken: a node projects its unit vectors on some random
directions and cuts where the halves have the fewest pairs. Linked vectors are at most twice ``MARGIN`` apart, and so are
their projections; all within ``MARGIN`` of a cut go to both halves, so that every link lies whole in some leaf. A node
whose best cut would spare too few pairs, because most of it is that close to the cut, stays a leaf of any size:
vectors spread over many dimensions, and cliques of near copies, are compared in full. Every vector is then sent down
its tree. Within a leaf all pairs are compared, in blocks of bounded size, by cosine in double precision; of the leaves
that a pair shares only the first counts it, so links need not be listed to be counted. Each block reports how often its
vectors are linked and the edges of a spanning forest of its links, whose union gives the groups.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite numbers, and those without label, link
with nothing; vectors of different length in one label never link; rows that repeat a vec_id are rows of their own; an
empty table gives no rows. The result has the columns named below only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import components, map_arrow, send_package, small_batches, written

COSINE = 0.98
TREES = 5  # trees grown for a label, of which the best is used
SAMPLE = 40_000
LEAF = 300  # vectors that a leaf is meant to get
SAMPLE_LEAF = 12  # sampled vectors that a leaf keeps at least
# Half the largest distance of linked unit vectors, with room for rounding.
MARGIN = math.sqrt((1 - COSINE) / 2) + 1e-9
DIRECTIONS = 16  # tried for a cut
PAIRS_LEFT = 0.75  # most pairs that a cut may leave, as a share of the node's
PAIRS_AT_ONCE = 100_000
BLOCK = 2_000  # vectors of a block; two blocks are compared by one task


@dataclass
class Node:
    direction: np.ndarray | None = None
    low: float = 0.0  # from here on a vector goes to the right half
    high: float = 0.0  # up to here it goes to the left half
    left: Node | None = None
    right: Node | None = None
    leaf: int = -1
    pairs: int = 0  # of sampled vectors, in all leaves below


def best_cut(sample: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, float] | None:
    """Direction and place of the cut that leaves the fewest pairs in the overlapping halves; none if those are too many.

    Half of the directions lead from one vector of the sample to another, along which it is spread most."""
    n, half = len(sample), DIRECTIONS // 2
    ends = random.integers(n, size=(2, DIRECTIONS - half))
    directions = np.concatenate([random.normal(size=(half, sample.shape[1])), sample[ends[0]] - sample[ends[1]]])
    sizes = np.linalg.norm(directions, axis=1)
    directions = directions[sizes > 1e-6] / sizes[sizes > 1e-6, None]
    least, best = PAIRS_LEFT, None
    for direction in directions:
        at = np.sort(sample @ direction)
        cuts = np.quantile(at, np.linspace(0.1, 0.9, 33))
        left = np.searchsorted(at, cuts + MARGIN, side="right") / n
        right = 1 - np.searchsorted(at, cuts - MARGIN, side="left") / n
        share = left**2 + right**2
        k = int(np.argmin(share))
        if share[k] <= least:
            least, best = share[k], (direction, float(cuts[k]))
    return best


def grow(sample: np.ndarray, smallest: int, random: np.random.Generator, leaves: list[int]) -> Node:
    """A tree over unit vectors; ``leaves`` counts those given out."""
    if len(sample) > 2 * smallest and (cut := best_cut(sample, random)):
        direction, low, high = cut[0], cut[1] - MARGIN, cut[1] + MARGIN
        at = sample @ direction
        left, right = (grow(part, smallest, random, leaves) for part in (sample[at <= high], sample[at >= low]))
        return Node(direction, low, high, left, right, pairs=left.pairs + right.pairs)
    leaves[0] += 1
    return Node(leaf=leaves[0] - 1, pairs=len(sample) ** 2)


def leaves_of(vectors: np.ndarray, node: Node) -> list[list[int]]:
    """Leaves that each vector reaches."""
    out: list[list[int]] = [[] for _ in range(len(vectors))]
    stack = [(node, np.arange(len(vectors)))]
    while stack:
        node, rows = stack.pop()
        if not len(rows):
            continue
        if node.leaf >= 0:
            for r in rows.tolist():
                out[r].append(node.leaf)
            continue
        at = vectors[rows] @ node.direction
        stack += [(node.left, rows[at <= node.high]), (node.right, rows[at >= node.low])]
    return out


def unit(raw: bytes) -> np.ndarray:
    vector = np.frombuffer(raw, dtype="<f4").astype(np.float64)
    return vector / math.sqrt(float(vector @ vector))


def can_link() -> Column:
    """Whether a row's vector can link with any other."""
    there = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return F.coalesce(there & whole, F.lit(False))


def packed_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector as bytes) of the vectors that can link."""
    rows = embeddings.filter(can_link())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            vectors = [np.asarray(v.values.to_numpy(zero_copy_only=False), dtype="<f4") + np.float32(0) for v in batch.column("embedding")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([v.tobytes() for v in vectors], pa.binary())], names=["vec_id", "label", "vector"]
            )

    schema = f"vec_id long, label {dict(rows.dtypes)['label']}, vector binary"
    return map_arrow(rows.withColumn("embedding", F.col("embedding").cast("array<float>")), pack, schema)


def build_forest(classes: DataFrame, trees: int = TREES, seed: int = 7) -> dict[tuple, list[Node]]:
    """The best of ``trees`` trees by label and vector length, grown on the ``SAMPLE`` vectors of smallest hash. Every tree
    keeps all links together, so one is enough."""
    sample = classes.orderBy(F.xxhash64("vector"), "node").limit(SAMPLE).select("label", "vector").collect()
    drawn: dict[tuple, list[np.ndarray]] = {}
    for r in sample:
        drawn.setdefault((r.label, len(r.vector)), []).append(unit(bytes(r.vector)))
    total = classes.count()
    share = min(1.0, len(sample) / max(1, total))
    forest = {}
    for key, vectors in sorted(drawn.items()):
        random = np.random.default_rng([seed, len(vectors), key[1]])
        smallest = max(SAMPLE_LEAF, int(LEAF * share))
        grown = (grow(np.array(vectors), smallest, random, [0]) for _ in range(trees))
        forest[key] = [min(grown, key=lambda tree: tree.pairs)]
    return forest


def in_leaves(classes: DataFrame, forest: dict[tuple, list[Node]]) -> DataFrame:
    """One row for each leaf a class reaches, with all its leaves by tree."""
    sent = classes.sparkSession.sparkContext.broadcast(forest)
    trees = max((len(t) for t in forest.values()), default=1)
    label = dict(classes.dtypes)["label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            labels, raw = batch.column("label").to_pylist(), batch.column("vector").to_pylist()
            reached: list[list[list[int]]] = [[] for _ in raw]
            kinds: dict[tuple, list[int]] = {}
            for i, (l, v) in enumerate(zip(labels, raw, strict=True)):
                kinds.setdefault((l, len(v)), []).append(i)
            for kind, rows in kinds.items():
                vectors = np.array([unit(raw[i]) for i in rows])
                for tree in sent.value.get(kind) or [Node(leaf=0)] * trees:
                    for i, found in zip(rows, leaves_of(vectors, tree), strict=True):
                        reached[i].append(found)
            take, tree_of, leaf_of, codes = [], [], [], []
            for i, by_tree in enumerate(reached):
                code = [t << 32 | leaf for t, found in enumerate(by_tree) for leaf in sorted(found)]
                for t, found in enumerate(by_tree):
                    for leaf in found:
                        take.append(i)
                        tree_of.append(t)
                        leaf_of.append(leaf)
                        codes.append(code)
            at = pa.array(take, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(at) for c in ("label", "vector", "node", "copies")] + [pa.array(tree_of, pa.int32()), pa.array(leaf_of, pa.int64()), pa.array(codes, pa.list_(pa.int64()))],
                names=["label", "vector", "node", "copies", "tree", "leaf", "leaves"],
            )

    return map_arrow(
        classes.select("label", "vector", "node", "copies"), run, f"label {label}, vector binary, node long, copies long, tree int, leaf long, leaves array<long>"
    )


def counted_here(a: np.ndarray, b: np.ndarray, here: int) -> np.ndarray:
    """Of pairs with rows of leaf codes ``a`` and ``b`` (ascending, padded by -1 and -2), those whose first common code is
    ``here``."""
    first = np.ones(len(a), dtype=bool)
    for column in range(a.shape[1]):
        earlier = first & (a[:, column] >= 0) & (a[:, column] < here)
        if earlier.any():
            first[earlier] &= ~(b[earlier] == a[earlier, column][:, None]).any(axis=1)
    return first


def padded(lists: list, fill: int) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists), default=1)), fill, dtype=np.int64)
    for i, values in enumerate(lists):
        out[i, : len(values)] = values
    return out


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number connected with each of ``n`` by pairs (a, b)."""
    labels = np.arange(n)
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


# A row counts links of a node (``other`` is the node itself) or is an edge (no links counted).
REPORT = "node long, links long, other long"


def compare_block(group: pd.DataFrame) -> pd.DataFrame:
    """Links of one block with itself or with another: counts for each vector and spanning edges."""
    here = int(group["tree"].iloc[0]) << 32 | int(group["leaf"].iloc[0])
    nodes_out, links_out, others_out = [], [], []
    for _, part in group.groupby(group["vector"].map(len)):
        part = part.sort_values("node")
        same = (part["low"] == part["high"]).all()
        nodes, copies = part["node"].to_numpy(), part["copies"].to_numpy()
        vectors = np.array([unit(bytes(v)) for v in part["vector"]])
        side = (part["block"] == part["high"]).to_numpy() if not same else np.zeros(len(part), dtype=bool)
        left = np.flatnonzero(~side) if not same else np.arange(len(part))
        right = np.flatnonzero(side) if not same else left
        leaves_a, leaves_b = padded(list(part["leaves"]), -1), padded(list(part["leaves"]), -2)
        links, pairs_a, pairs_b = np.zeros(len(part), dtype=np.int64), [], []
        for start in range(0, len(left), 500):
            rows = left[start : start + 500]
            i, j = np.nonzero(vectors[rows] @ vectors[right].T >= COSINE)
            i, j = rows[i], right[j]
            if same:
                i, j = i[i < j], j[i < j]
            parts = range(0, len(i), PAIRS_AT_ONCE)
            first = [counted_here(leaves_a[i[k : k + PAIRS_AT_ONCE]], leaves_b[j[k : k + PAIRS_AT_ONCE]], here) for k in parts]
            first = np.concatenate([np.zeros(0, dtype=bool), *first])
            i, j = i[first], j[first]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            root = least_labels(len(part), i, j)
            held = np.flatnonzero(root != np.arange(len(part)))
            pairs_a.append(held)
            pairs_b.append(root[held])
        counted = np.flatnonzero(links)
        nodes_out.append(nodes[counted])
        links_out.append(links[counted])
        others_out.append(nodes[counted])
        a, b = (np.concatenate(p) if p else np.zeros(0, dtype=np.int64) for p in (pairs_a, pairs_b))
        root = least_labels(len(part), a, b)
        held = np.flatnonzero(root != np.arange(len(part)))
        nodes_out.append(nodes[held])
        links_out.append(np.zeros(len(held), dtype=np.int64))
        others_out.append(nodes[root[held]])
    return pd.DataFrame({"node": np.concatenate(nodes_out), "links": np.concatenate(links_out), "other": np.concatenate(others_out)})


def link_vectors(embeddings: DataFrame, trees: int = TREES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = embeddings.sparkSession
    send_package(spark)
    rows = embeddings.withColumn("vec_id", F.col("vec_id").cast("long")).select("vec_id", "label", "embedding")
    packed = written(packed_vectors(rows), "vectors")
    # Classes of equal vectors are named by a number of their own, as ids may repeat.
    classes = packed.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.withColumn("node", F.xxhash64("label", "vector")), "classes")
    placed = written(in_leaves(classes, build_forest(classes, trees)), "leaves")
    leaf = ["label", "tree", "leaf"]
    large = placed.groupBy(*leaf).count().filter(F.col("count") > BLOCK)
    large = large.select(*leaf, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(large, leaf, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    # A block meets itself and every other block of its leaf, each two in one task.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")
    # Dealt out by the pair of blocks: the join's partitions by leaf would keep all pairs of a leaf in one task.
    dealt = dealt.repartition(*leaf, "low", "high")
    report = written(dealt.groupBy(*leaf, "low", "high").applyInPandas(compare_block, REPORT), "links")
    groups = components(report.filter("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = report.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(links, "node", "left").join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    least = named.groupBy("group").agg(F.min("least").alias("component"))
    named = named.join(least, "group").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id"))
    found = packed.select("vec_id", F.xxhash64("label", "vector").alias("node")).join(written(named, "named"), "node").drop("node")
    # Rows that can link with nothing stand for themselves.
    alone = rows.filter(~can_link()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = found.select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
