"""Near-duplicate embeddings: spherical k-means cells and blocked cosine products.

Equal vectors of one label form a class first. Class vectors go to the cell of
their nearest centroid, and as halo to every lower-numbered cell that a linked
partner may lie in: partners are at most ``sqrt(2 - 2 * cosine)`` apart, so a
vector whose distance from the bisector of two centroids is larger has no
partner beyond it. So each linked pair meets in exactly one cell and none is
lost. The number of cells grows with the root of the number of vectors. How much
that saves depends on the vectors: where they spread evenly in many dimensions
the halo grows with the cells, and about a third of all pairs of a label is
compared at any size. A cell's rows are dealt into blocks of ``BLOCK_ROWS``, and
each pair of blocks is compared in one task, whatever the size of the cell.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cowrie.llm.common import connected_components, drop, small_batches, stash

#: Vectors that the centroids are fitted on, about; twice the cells where that is more.
FIT_ROWS = 20_000
#: The number of cells is the root of so many times the class vectors of the largest label.
CELL_FACTOR = 1
#: Rows of a block, and of a product within it.
BLOCK_ROWS, PRODUCT_ROWS = 4_096, 1_024
_ROUNDS, _NUMBERS = 8, 4_000_000


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long lists as rows of numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision of equally long rows, and which rows have one."""
    x = rows
    top = np.abs(x).max(1, initial=0.0)
    good = np.isfinite(top) & (top > 0)
    x = np.where(good[:, None], x, 1.0) / np.where(good, top, 1.0)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None], good


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows; empty cells keep their centroid."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    step = max(1, _NUMBERS // max(1, len(centroids)))
    for _ in range(_ROUNDS):
        own = np.concatenate([(x[i : i + step] @ centroids.T).argmax(1) for i in range(0, len(x), step)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        centroids = np.where((size > 1e-9)[:, None], sums / np.maximum(size, 1e-9)[:, None], centroids)
    return np.unique(centroids, axis=0)


def cells_of(x: np.ndarray, centroids: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each unit row, and (row, cell) of its halo: lower cells within reach."""
    dots = x @ centroids.T
    own = dots.argmax(1)
    mine, of = np.unique(own, return_inverse=True)
    gap = np.sqrt(np.maximum(2 - 2 * centroids[mine] @ centroids.T, 1e-18))
    behind = (dots[np.arange(len(x)), own][:, None] - dots) / gap[of]
    return own, *np.nonzero((behind <= reach + 1e-9) & (np.arange(len(centroids))[None, :] < own[:, None]))


def _assign(centroids: np.ndarray | None, reach: float):
    """Cells of each class vector: its own (owner) and lower ones within reach (halo)."""
    most = max(1, _NUMBERS // (1 if centroids is None else len(centroids)))

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, most):
                batch = whole.slice(start, most)
                c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                dims = c["embedding"].value_lengths().to_numpy()
                fits = np.nonzero(dims == (0 if centroids is None else centroids.shape[1]))[0]
                rest = np.setdiff1d(np.arange(len(dims)), fits)
                at, cell, owner = [rest], [np.zeros(len(rest), np.int64)], [np.ones(len(rest), bool)]
                if len(fits):
                    own, row, other = cells_of(unit(matrix(c["embedding"].take(pa.array(fits))))[0], centroids, reach)
                    at += [fits, fits[row]]
                    cell += [own, other]
                    owner += [np.ones(len(own), bool), np.zeros(len(row), bool)]
                at = np.concatenate(at)
                taken = [c[n].take(pa.array(at)) for n in ("class", "label", "n", "embedding")]
                yield pa.RecordBatch.from_arrays(
                    [*taken, pa.array(dims[at], pa.int32()), pa.array(np.concatenate(cell), pa.int32()), pa.array(np.concatenate(owner), pa.bool_())],
                    names=["class", "label", "n", "embedding", "dim", "cell", "owner"],
                )

    return run


def _products(cosine: float):
    """Links of one pair of blocks: per class its linked rows, and edges that span its links."""

    def run(table: pa.Table) -> pa.Table:
        x, _ = unit(matrix(table["embedding"]))
        ids, n, block = (table[c].to_numpy() for c in ("class", "n", "block"))
        i, j = table["bi"][0].as_py(), table["bj"][0].as_py()
        a, b = np.nonzero(block == i)[0], np.nonzero(block == j)[0]
        links = []
        for s in range(0, len(a), PRODUCT_ROWS):
            for t in range(s if i == j else 0, len(b), PRODUCT_ROWS):
                p, q = np.nonzero(x[a[s : s + PRODUCT_ROWS]] @ x[b[t : t + PRODUCT_ROWS]].T >= cosine)
                p, q = a[p + s], b[q + t]
                once = p < q if i == j else np.ones(len(p), bool)
                links.append(np.stack([p[once], q[once]]))
        p, q = np.concatenate(links, 1) if links else np.zeros((2, 0), np.int64)
        counts = np.zeros(len(ids), np.int64)
        np.add.at(counts, p, n[q])
        np.add.at(counts, q, n[p])
        least = ids.copy()
        while len(p):  # the least class reachable within the pair of blocks
            was = least.copy()
            np.minimum.at(least, p, least[q])
            np.minimum.at(least, q, least[p])
            if (was == least).all():
                break
        hit = np.nonzero(counts)[0]
        return pa.table({"class": pa.array(ids[hit], pa.int64()), "root": pa.array(least[hit], pa.int64()), "linked": pa.array(counts[hit], pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """One row per vector: ``key``, ``n_links``, ``component_id`` and ``kept``.

    Vectors of equal, non-null labels (and equal lengths) are linked if their
    cosine in double precision is at least ``cosine``. ``n_links`` counts the
    other vectors linked directly, equal ones included; ``component_id`` is the
    least key reachable; ``kept`` marks the row whose key it is. Null, empty and
    zero vectors, those with null or non-finite components and those without a
    label link with nothing. Rows that repeat, or share a key, count as vectors of
    their own. A row without a key links like any other; its group's
    ``component_id`` is the least key that the group has, null if it has none, and
    in that case the row is kept. Columns other than the three named are ignored;
    an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(key).alias("vec"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    e = F.col("embedding")
    sound = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    sound = sound & ~F.exists(e, bad) & F.exists(e, lambda v: v != 0)
    ok = rows.where(F.coalesce(sound, F.lit(False)))
    # classes are numbered, as keys may be null or repeat
    classes = ok.groupBy("label", "embedding").agg(F.min("vec").alias("least"), F.count("*").alias("n"))
    classes = stash(classes.withColumn("class", F.monotonically_increasing_id()))

    largest = classes.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    cells = math.isqrt(CELL_FACTOR * largest[0])
    centroids = None
    if cells > 1:
        wanted = max(FIT_ROWS, 2 * cells)
        drawn = F.pmod(F.xxhash64("embedding", F.lit("fit")), F.lit(1 << 30)) < int(min(1.0, wanted / largest[1]) * (1 << 30))
        sample = classes.where(drawn).select("embedding", F.size("embedding").alias("dim")).toArrow()
        dims = Counter(sample["dim"].to_pylist())
        if dims:
            dim = max(dims, key=lambda d: (dims[d], -d))
            x = unit(matrix(sample.filter(pa.compute.equal(sample["dim"], dim))["embedding"]))[0]
            centroids = spherical_kmeans(x[np.lexsort(x.T)], cells)

    kind = classes.schema["embedding"].dataType.simpleString()
    label_kind = classes.schema["label"].dataType.simpleString()
    assigned = stash(classes.select("label", "embedding", "n", "class").mapInArrow(_assign(centroids, math.sqrt(2 - 2 * cosine)), f"class long, label {label_kind}, n long, embedding {kind}, dim int, cell int, owner boolean"))
    cell = ["label", "dim", "cell"]
    sizes = assigned.groupBy(*cell).agg(F.count_if("owner").alias("own"), F.count_if(~F.col("owner")).alias("halo"))
    own, halo = (F.ceil(F.col(c) / BLOCK_ROWS).cast("int") for c in ("own", "halo"))
    spread = F.pmod(F.xxhash64("class"), F.when(F.col("owner"), own).otherwise(halo)).cast("int")
    dealt = assigned.join(sizes, cell).where(own > 0).withColumn("block", F.when(F.col("owner"), spread).otherwise(own + spread))
    met = F.when(F.col("owner"), own + halo).otherwise(own)  # own blocks come first
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
    pairs = pairs.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    found = stash(pairs.select("class", "n", "embedding", "block", *cell, "bi", "bj").groupBy(*cell, "bi", "bj").applyInArrow(_products(cosine), "class long, root long, linked long"))

    roots = connected_components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("class").agg(F.sum("linked").alias("linked"))
    member = classes.join(linked, "class", "left").join(roots, F.col("class") == F.col("node"), "left")
    member = stash(member.select("label", "embedding", "least", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "class").alias("root")))
    drop(assigned, found, roots, classes)
    groups = member.groupBy("root").agg(F.min("least").alias("component_id"))
    member = member.join(groups, "root")
    out = rows.where(F.coalesce(sound, F.lit(False))).join(member, ["label", "embedding"]).select("vec", "n_links", "component_id")
    alone = rows.where(~F.coalesce(sound, F.lit(False))).select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component_id"))
    return out.union(alone).select(F.col("vec").alias(key), "n_links", "component_id", F.col("vec").eqNullSafe(F.col("component_id")).alias("kept"))
