"""Embeddings of drugs: propagated SVD, PCA, kernel components, factorisation, walks; ridge for unseen drugs.

Long profiles become one sparse vector per drug only at the boundary of Spark's own linear
algebra, whose Gram matrices are summed over partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import PCA, StandardScaler, Word2Vec
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.functions.hashing import content_hash, hash_slot, hashed_rank
from pairlens.operators import graph
from pairlens.plans.worktables import WorkTables


def dense_columns(profiles: DataFrame, item: str) -> DataFrame:
    """Adds ``place`` (from 0) of each item in hashed order, and ``n_items``."""
    items = profiles.select(item).distinct().withColumn("h", content_hash(F.col(item)))
    return profiles.join(hashed_rank(items, [], "h", "place", "n_items").select(item, "place", "n_items"), item)


def row_vectors(profiles: DataFrame, row: str, item: str, value: str) -> DataFrame:
    """``row, features``: one sparse vector per row of the long matrix."""
    placed = dense_columns(profiles, item)
    entries = placed.groupBy(row).agg(F.max("n_items").cast("int").alias("n"), F.sort_array(F.collect_list(F.struct(F.col("place").cast("int").alias("i"), F.col(value).cast("double").alias("x")))).alias("e"))  # a row's own entries
    build = F.udf(lambda n, e: SparseVector(n, [s["i"] for s in e], [s["x"] for s in e]), VectorUDT())
    return entries.select(row, build("n", "e").alias("features"))


def svd_embedding(profiles: DataFrame, row: str, item: str, value: str, k: int, train_rows: DataFrame | None = None) -> DataFrame:
    """``row, embedding``: each row's product with the first k right singular vectors.

    With ``train_rows`` the vectors are fitted on those rows only and applied to all, so
    nothing leaks from the others.  k shrinks to what the training rows allow.
    """
    vectors = row_vectors(profiles, row, item, value)
    fit_on = vectors if train_rows is None else vectors.join(train_rows, row, "left_semi")
    rows = fit_on.select("features").rdd.map(lambda r: OldVectors.fromML(r["features"])).persist(StorageLevel.MEMORY_AND_DISK)
    matrix = RowMatrix(rows)
    n_rows, n_cols = matrix.numRows(), matrix.numCols()
    k = max(1, min(k, n_cols - 1, n_rows - 1))
    v = matrix.computeSVD(k, computeU=False).V.toArray()  # items x k
    rows.unpersist()
    places = F.broadcast(vectors.sparkSession.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "place bigint, axis array<double>"))  # items x k, as on the driver
    parts = dense_columns(profiles, item).join(places, "place").select(row, value, "axis")
    sums = parts.groupBy(row).agg(*(F.sum(F.col(value) * F.get("axis", F.lit(i))).alias(f"x{i}") for i in range(k)))
    return sums.select(row, F.array(*(f"x{i}" for i in range(k))).alias("embedding"))


#: Axes beyond the wanted ones in a block of directions, blocks of a basis at most, and its bytes.
SPARE, MAX_BLOCKS, BASIS_BYTES = 10, 12, 256 << 20
#: Largest residual of an axis, as a share of the largest eigenvalue, and passes over the rows after which none is expected.
RESIDUAL, MAX_PASSES = 1e-9, 300


def _basis_block(new: np.ndarray, basis: np.ndarray | None, scale: float) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to ``basis``."""
    for _ in range(2):
        if basis is not None:
            new = new - basis @ (basis.T @ new)
        left, size, _ = np.linalg.svd(new, full_matrices=False)
        new = left[:, size > 1e-12 * scale]
        scale = 1.0
    return new


def leading_axes(apply, n: int, k: int) -> np.ndarray:
    """The k leading eigenvectors (n x k) of a symmetric operator without negative eigenvalues.

    Block Krylov: each pass ``apply`` multiplies one block of directions; the axes are the best
    in the space of all blocks.  It ends once every axis's residual is negligible.  A full basis starts
    anew from its best axes and the next block.  Signs are such that the largest entry is positive.
    """
    width = min(n, k + SPARE)
    most = max(3, min(MAX_BLOCKS, BASIS_BYTES // (16 * n * width)))
    block = _basis_block(np.random.default_rng(7).normal(size=(n, width)), None, 1.0)
    basis, image = np.zeros((n, 0)), np.zeros((n, 0))
    for _ in range(MAX_PASSES):
        new = apply(block)
        basis, image = np.concatenate([basis, block], axis=1), np.concatenate([image, new], axis=1)
        inner = basis.T @ image
        values, mix = np.linalg.eigh((inner + inner.T) / 2)
        values, mix = values[::-1], mix[:, ::-1]
        best = basis @ mix[:, :k]
        residual = np.linalg.norm(image @ mix[:, :k] - best * values[:k], axis=0).max()
        block = _basis_block(new, basis, max(values[0], 1e-300))
        if residual <= RESIDUAL * values[0] or not block.shape[1]:
            return best * np.where(np.take_along_axis(best, np.abs(best).argmax(axis=0)[None, :], axis=0) < 0, -1.0, 1.0)
        if basis.shape[1] + block.shape[1] > most * width:
            kept = mix[:, : 2 * width]
            basis, image = basis @ kept, image @ kept
    raise RuntimeError(f"no axes within {MAX_PASSES} passes: residual {residual / values[0]:.1e}")


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and values of all rows' entries, and where each row begins."""
    lists = batch.column("places")
    n = lists.value_lengths().to_numpy()
    return lists.flatten().to_numpy(), batch.column("values").flatten().to_numpy(), np.cumsum(n) - n


#: Genes whose sums are one row, on their way from the tasks.
GENES = 1024


def _gram(start: DataFrame, directions: np.ndarray, tables: WorkTables) -> np.ndarray:
    """T'T times the directions (genes x some), T being the rows of ``start``: sums of tasks, added up by pieces of genes."""
    shared = start.sparkSession.sparkContext.broadcast(directions)
    n, width = directions.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, width))
        for batch in batches:
            if batch.num_rows:
                places, values, first = _entries(batch)
                rows = np.add.reduceat(shared.value[places] * values[:, None], first, axis=0)
                back = np.repeat(rows, np.diff(first, append=len(places)), axis=0) * values[:, None]
                order = np.argsort(places, kind="stable")
                found, at = np.unique(places[order], return_index=True)
                total[found] += np.add.reduceat(back[order], at, axis=0)
        at = [i for i in range(0, n, GENES) if total[i : i + GENES].any()]
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array([total[i : i + GENES].tobytes() for i in at], pa.binary())], names=["at", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, piece in zip(batch.column("at").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                pieces[at] = pieces.get(at, 0) + np.frombuffer(piece)
        yield pa.record_batch([pa.array(list(pieces), pa.int32()), pa.array([p.tobytes() for p in pieces.values()], pa.binary())], names=["at", "sums"])

    schema, out = "at int, sums binary", np.zeros((n, width))
    for r in start.mapInArrow(sums, schema).repartition("at").mapInArrow(added, schema).collect():  # genes x directions
        piece = np.frombuffer(r["sums"]).reshape(-1, width)
        out[r["at"] : r["at"] + len(piece)] = piece
    shared.destroy()
    tables.free()
    return out


def filled_svd(profiles: DataFrame, ppi: DataFrame, rounds: int, k: int, tables: WorkTables, keep: float = 1.0, restart: float = 0.0) -> DataFrame:
    """``drug, embedding``: ``svd_embedding`` of the profiles after ``rounds`` of F <- keep * (F propagated) + restart * X.

    The filled profiles are X L', L being the rounds over the network; so their products with
    directions are those of the sparse X with directions that went over the network, and the
    filled values, nearly all of (drug, gene), are never made.  Every drug counts; the driver holds
    the network and a basis of genes.  A network too large for that is joined, and the long rows are saved.
    """
    weights = tables.save(graph.row_normalised(ppi), "weights")
    net = graph.network(weights)
    if net is None:
        long = graph.diffuse(profiles, weights, keep, restart, rounds, tables) if restart else graph.propagate(profiles, ppi, rounds, tables)
        return svd_embedding(tables.save(long, "filled"), "drug", "gene", "x", k)
    spark = profiles.sparkSession
    genes = spark.createDataFrame(pd.DataFrame({"gene": net.genes, "place": np.arange(len(net.genes), dtype=np.int32)}), "gene bigint, place int")
    inside = profiles.select("drug", F.col("gene").cast("bigint").alias("gene"), F.col("x").cast("double").alias("x")).join(genes, "gene")
    entries = inside.groupBy("drug").agg(F.collect_list(F.struct("place", "x")).alias("e"))  # a row's own entries
    start = tables.save(entries.select("drug", F.col("e.place").alias("places"), F.col("e.x").alias("values")), "start")
    schema = T.StructType([start.schema["drug"], T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    n_rows = start.count()
    if not n_rows:
        return spark.createDataFrame([], schema)
    back = net.transposed()
    reached = start.select(F.explode("places").alias("place")).distinct().toArrow().column("place").to_numpy()  # at most the genes
    held = np.zeros((len(net.genes), 1))
    held[reached] = 1
    n_cols = np.count_nonzero(net.spread(held, rounds, keep, restart))
    k = max(1, min(k, n_cols - 1, n_rows - 1))
    axes = leading_axes(lambda z: net.spread(_gram(start, back.spread(z, rounds, keep, restart), tables), rounds, keep, restart), len(net.genes), k)
    shared = spark.sparkContext.broadcast(back.spread(axes, rounds, keep, restart))

    def embedded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                places, values, first = _entries(batch)
                rows = np.add.reduceat(shared.value[places] * values[:, None], first, axis=0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
                yield pa.record_batch([batch.column("drug"), lists], names=["drug", "embedding"])

    return start.mapInArrow(embedded, schema)


def pca_embedding(vectors: DataFrame, row: str, vector: str, k: int) -> DataFrame:
    """``row, embedding``: principal components after scaling every dimension to unit deviation and centring."""
    base = vectors.select(row, array_to_vector(vector).alias("raw"))
    scaled = StandardScaler(withMean=True, withStd=True, inputCol="raw", outputCol="features").fit(base).transform(base)
    return PCA(k=k, inputCol="features", outputCol="p").fit(scaled).transform(scaled).select(row, vector_to_array("p").alias("embedding"))


def nonnegative_factors(profiles: DataFrame, row: str, item: str, value: str, rank: int, rounds: int = 8) -> DataFrame:
    """``row, embedding``: non-negative factors of the long matrix by alternating least squares."""
    rows = profiles.select(row).distinct().withColumn("h", content_hash(F.col(row)))
    placed = dense_columns(profiles, item).join(hashed_rank(rows, [], "h", "row_place", "_n").select(row, "row_place"), row)
    data = placed.select(F.col("row_place").cast("int").alias("u"), F.col("place").cast("int").alias("i"), F.col(value).cast("float").alias("r"), row)
    model = ALS(rank=rank, maxIter=rounds, nonnegative=True, implicitPrefs=True, userCol="u", itemCol="i", ratingCol="r", seed=42).fit(data)
    return data.select("u", row).distinct().join(model.userFactors.withColumnRenamed("id", "u"), "u").select(row, F.col("features").cast("array<double>").alias("embedding"))


def walk_embedding(edges: DataFrame, tables: WorkTables, walks: int = 4, length: int = 8, dim: int = 16, seed: int = 42) -> DataFrame:
    """``gene, vector``: Word2Vec on uniform random walks over ``src, dst``.

    All walks take each step at once: a hash of the walk and the step picks one of the
    current gene's neighbours by place, through an equi-join.
    """
    placed = tables.save(hashed_rank(edges.withColumn("h", content_hash(F.col("src"), F.col("dst"), seed=seed)), ["src"], "h", "place", "deg").select("src", "place", "deg", "dst"), "edges")
    degree = placed.groupBy("src").agg(F.max("deg").alias("deg"))
    state = degree.select(F.col("src").alias("at"), F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk")).select(F.concat_ws("-", "at", "walk").alias("id"), "at", F.array(F.col("at").cast("string")).alias("path"))
    for step in range(length - 1):
        pick = state.join(degree, F.col("at") == F.col("src")).select("id", "at", "path", hash_slot(content_hash(F.col("id"), F.lit(step), seed=seed), F.col("deg")).alias("place"))
        moved = pick.join(placed, (pick["at"] == placed["src"]) & (pick["place"] == placed["place"]))
        state = tables.save(moved.select("id", F.col("dst").alias("at"), F.concat("path", F.array(F.col("dst").cast("string"))).alias("path")), "walks")
    model = Word2Vec(vectorSize=dim, minCount=1, windowSize=5, maxIter=1, seed=seed, inputCol="path", outputCol="v").fit(state)
    return model.getVectors().select(F.col("word").cast("bigint").alias("gene"), vector_to_array("vector").alias("vector"))


def mean_vectors(profiles: DataFrame, gene_vectors: DataFrame) -> DataFrame:
    """``drug, vector``: elementwise mean of the vectors of each drug's genes."""
    joined = profiles.join(gene_vectors, "gene").select("drug", F.posexplode("vector").alias("i", "x"))
    means = joined.groupBy("drug", "i").agg(F.avg("x").alias("x"))
    return means.groupBy("drug").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))  # one entry per dimension


def _products(batches):
    """The rows of X'[X Y], summed over all batches of a task."""
    total = None
    for pdf in batches:
        if len(pdf):
            x = np.stack(pdf["features"].to_numpy()).astype(float)
            part = x.T @ np.concatenate([x, np.stack(pdf["vector"].to_numpy()).astype(float)], axis=1)
            total = part if total is None else total + part
    if total is not None:
        yield pd.DataFrame({"i": range(len(total)), "row": list(total)})


def _row_sum(column: str):
    """Elementwise sum of arrays of one length."""
    add = lambda acc, x: F.when(F.size(acc) == 0, x).otherwise(F.zip_with(acc, x, lambda a, b: a + b))
    return [F.aggregate(F.collect_list(column), F.array().cast("array<double>"), add).alias(column)]  # one array per task


def ridge_map(features: DataFrame, known: DataFrame, key: str, alpha: float = 1.0) -> DataFrame:
    """``key, vector, is_known``: known vectors as they are, others predicted by ridge regression.

    ``features`` and ``known`` hold dense arrays of one length each.  A task sums the products
    X'[X Y] of its rows, Spark adds them up; only these (dimensions squared) reach the driver.
    """
    train = features.join(known, key).select("features", "vector")
    sums = train.mapInPandas(_products, "i int, row array<double>").groupBy("i").agg(*_row_sum("row")).collect()  # dimensions of the features; each row's sum
    if not sums:
        return features.select(key, F.lit(None).cast("array<double>").alias("vector"), F.lit(False).alias("is_known"))
    both = np.array([r["row"] for r in sorted(sums, key=lambda r: r["i"])])
    d = len(both)
    w = np.linalg.solve(both[:, :d] + alpha * np.eye(d), both[:, d:])
    m = w.shape[1]
    columns = [F.aggregate(F.zip_with("features", F.array(*(F.lit(float(x)) for x in w[:, j])), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x) for j in range(m)]
    predicted = features.select(key, F.array(*columns).alias("predicted"))
    return predicted.join(known, key, "left").select(key, F.coalesce("vector", "predicted").alias("vector"), F.col("vector").isNotNull().alias("is_known"))


#: Landmarks of the kernel components, at most; they reach every task.
MAX_LANDMARKS = 1024


def kernel_components(vectors: DataFrame, row: str, vector: str, k: int, tables: WorkTables, gamma: float | None = None, landmarks: int = 256) -> DataFrame:
    """``row, embedding``: principal components under the kernel exp(-gamma |x - y|^2).

    The kernel matrix of all rows grows with their square, so each row is described by its
    kernel values against ``landmarks`` rows, the first in hashed order; with as many
    landmarks as rows the result is exact, up to the sign of each component.  Every row is
    embedded.  ``gamma`` is 1 / dimensions unless given.  Null vectors, and those of another
    length than the first landmark's, are left out; an empty table gives no rows.
    """
    if not 1 <= landmarks <= MAX_LANDMARKS:
        raise ValueError(f"landmarks must lie between 1 and {MAX_LANDMARKS}")
    rows = vectors.select(row, F.col(vector).cast("array<double>").alias("vector")).dropna().filter(F.size("vector") > 0)
    chosen = rows.withColumn("h", content_hash(F.col(row))).orderBy("h").limit(landmarks).select("vector").collect()  # at most MAX_LANDMARKS rows
    schema = T.StructType([rows.schema[row], T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    if not chosen:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = len(chosen[0]["vector"])
    marks = np.array([r["vector"] for r in chosen if len(r["vector"]) == dims])
    g = 1.0 / dims if gamma is None else gamma

    def kernel(x: np.ndarray) -> np.ndarray:
        square = (x * x).sum(axis=1)[:, None] - 2 * x @ marks.T + (marks * marks).sum(axis=1)
        return np.exp(-g * np.maximum(square, 0))

    values, axes = np.linalg.eigh(kernel(marks))
    kept = values > 1e-10 * values[-1]
    root = axes[:, kept] / np.sqrt(values[kept])

    def features(batches):
        for pdf in batches:
            x = np.stack(pdf["vector"].to_numpy()) if len(pdf) else np.zeros((0, dims))
            yield pd.DataFrame({row: pdf[row], "f": list(kernel(x) @ root)})

    mapped = rows.filter(F.size("vector") == dims).mapInPandas(features, T.StructType([rows.schema[row], T.StructField("f", T.ArrayType(T.DoubleType()))]))
    base = tables.save(mapped, "features").select(row, array_to_vector("f").alias("raw"))
    if base.limit(2).count() < 2:
        return base.select(row, F.array(F.lit(0.0)).alias("embedding"))  # a single row is its own centre
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="features").fit(base).transform(base)
    return PCA(k=min(k, root.shape[1]), inputCol="features", outputCol="p").fit(centred).transform(centred).select(row, vector_to_array("p").alias("embedding"))
