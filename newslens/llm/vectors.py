"""Near-duplicate embeddings by product quantisation, with an exact rerank.

Unit vectors are dealt to inverted lists by their nearest coarse centroid, and their residuals are coded by
subspace. A query looks into every list that can hold a partner: a vector within distance r lies beyond the
bisector of two centroids only if the query is within r of it. In a list, table lookups give the distance
to the coded vector; what is farther than r and the vector's coding error is left out, and the
rest is compared by the cosine in double precision. Both bounds hold by the triangle inequality, so the
model decides the cost and never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newslens.llm.components import components, unite
from newslens.llm.groups import by_key
from newslens.llm.stored import stored

BLOCK = 2048  # vectors of a list compared in one task with as many queries
PAIRS = 1 << 15  # pairs compared exactly at a time


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(points @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)


def cluster(points: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's rounds from evenly picked points; empty ones stay where they are."""
    centres = points[np.linspace(0, len(points) - 1, min(n, len(points))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(points, centres)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


@dataclass
class Quantiser:
    """Coarse centroids (lists x dimensions) and codebooks (subspaces x codes x their dimensions)."""

    coarse: np.ndarray
    books: list[np.ndarray]

    def spans(self) -> list[tuple[int, int]]:
        ends = np.cumsum([b.shape[1] for b in self.books])
        return list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))

    @cached_property
    def between(self) -> np.ndarray:
        """Distances of all coarse centroids from each other."""
        squares = (self.coarse**2).sum(axis=1)
        return np.sqrt(np.maximum(squares[:, None] + squares - 2 * self.coarse @ self.coarse.T, 0))

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of every vector."""
        lists = nearest(units, self.coarse)
        residual = units - self.coarse[lists]
        codes = np.stack([nearest(residual[:, a:b], book) for (a, b), book in zip(self.spans(), self.books, strict=True)], axis=1)
        decoded = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        return lists, codes.astype(np.uint8), np.sqrt(((residual - decoded) ** 2).sum(axis=1))

    def probes(self, units: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """All (vector, list) in which a partner within ``reach`` can be."""
        apart = np.maximum(2 - 2 * (units @ self.coarse.T) + ((self.coarse**2).sum(axis=1) - 1), 0)
        own = nearest(units, self.coarse)
        low = apart[np.arange(len(units)), own]
        return np.nonzero(apart - low[:, None] <= 2 * reach * self.between[own] + 1e-6)

    def tables(self, units: np.ndarray, of: int) -> np.ndarray:
        """Squared distances of each query's residual to all codes, by query, subspace and code."""
        residual = units - self.coarse[of]
        out = np.full((len(units), len(self.books), max(len(b) for b in self.books)), np.inf)
        for m, ((a, b), book) in enumerate(zip(self.spans(), self.books, strict=True)):
            out[:, m, : len(book)] = ((residual[:, None, a:b] - book[None]) ** 2).sum(axis=2)
        return out


def fit(sample: np.ndarray, lists: int, subspaces: int, codes: int) -> Quantiser:
    coarse = cluster(sample, lists)
    residual = sample - coarse[nearest(sample, coarse)]
    width = -(-sample.shape[1] // subspaces)
    return Quantiser(coarse, [
        cluster(np.ascontiguousarray(residual[:, a:a + width]), codes) for a in range(0, sample.shape[1], width)
    ])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return balanced(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width))


def balanced(vectors: np.ndarray) -> np.ndarray:
    """The rows times powers of two that bring their largest components near 1, so that no square overflows."""
    most = np.abs(vectors).max(axis=1, initial=0)
    return np.ldexp(vectors, -np.frexp(most)[1][:, None])


def _coded(classes: DataFrame, model: Quantiser, width: int, reach: float, queries: bool) -> DataFrame:
    """Index rows in their list, or query rows in every list to probe."""
    shared = classes.sparkSession.sparkContext.broadcast((model.coarse, model.books))  # bounded by the parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Quantiser(*shared.value)
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(a, BLOCK)
                vectors = _matrix(batch.column(2), width)
                units = vectors / np.sqrt((vectors**2).sum(axis=1))[:, None]
                if queries:
                    row, lists = model.probes(units, reach)
                    codes, error = pa.nulls(len(row), pa.binary()), pa.nulls(len(row), pa.float64())
                else:
                    lists, found, missed = model.encode(units)
                    row, codes, error = np.arange(len(units)), pa.array([c.tobytes() for c in found], pa.binary()), pa.array(missed)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(lists.astype(np.int32)), codes, error],
                    names=[*batch.schema.names, "list", "codes", "error"],
                )

    kinds = dict(classes.dtypes)
    return classes.select("cid", "label", "vector", "copies").mapInArrow(
        run, f"cid bigint, label {kinds['label']}, vector {kinds['vector']}, copies bigint, list int, codes binary, error double"
    )


def compare(model: Quantiser, of: int, index: pd.DataFrame, queries: pd.DataFrame, least: float, reach: float):
    """Of one list: links of each query, weighted by copies, and edges that connect what is linked."""
    def matrix(frame):
        vectors = balanced(np.stack(frame["vector"].to_numpy()).astype(np.float64))
        return vectors, np.sqrt((vectors**2).sum(axis=1))

    (y, y_norm), (x, x_norm) = matrix(index), matrix(queries)
    codes = np.frombuffer(b"".join(index["codes"]), np.uint8).reshape(len(index), -1)
    within = (reach + index["error"].to_numpy() + 1e-6) ** 2
    y_id, x_id = index["cid"].to_numpy(), queries["cid"].to_numpy()
    copies = index["copies"].to_numpy()
    nodes, where = np.unique(np.concatenate([y_id, x_id]), return_inverse=True)
    labels, links = np.arange(len(nodes)), np.zeros(len(x_id), np.int64)
    step = max(1, (1 << 18) // max(len(y_id), 1))
    for a in range(0, len(x_id), step):
        tables = model.tables(x[a:a + step] / x_norm[a:a + step, None], of)
        far = np.zeros((len(tables), len(y_id)))
        for m in range(codes.shape[1]):
            far += tables[:, m, :][:, codes[:, m]]
        q, k = np.nonzero(far <= within[None, :])
        q = q + a
        other = x_id[q] != y_id[k]
        q, k = q[other], k[other]
        for b in range(0, len(q), PAIRS):
            i, j = q[b:b + PAIRS], k[b:b + PAIRS]
            cosine = np.einsum("ij,ij->i", x[i], y[j]) / (x_norm[i] * y_norm[j])
            i, j = i[cosine >= least], j[cosine >= least]
            np.add.at(links, i, copies[j])
            labels = unite(labels, where[len(y_id) + i], where[j])
    moved = np.flatnonzero(labels != np.arange(len(nodes)))
    found = np.flatnonzero(links)
    return x_id[found], links[found], nodes[moved], nodes[labels[moved]]


def _dealt(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Index and query rows of every list, in pairs of blocks of about ``BLOCK`` rows each."""
    sizes = index.groupBy("label", "list").agg(F.count("*").alias("n")).select(
        F.col("label").alias("of_label"), F.col("list").alias("of_list"), F.ceil(F.col("n") / BLOCK).cast("int").alias("iblocks")
    )
    asked = queries.groupBy("label", "list").agg(F.count("*").alias("n")).select(
        "label", "list", F.ceil(F.col("n") / BLOCK).cast("int").alias("qblocks")
    )
    both = stored(asked.join(sizes, (F.col("label") == F.col("of_label")) & (F.col("list") == F.col("of_list"))).select(
        "of_label", "of_list", "iblocks", "qblocks"
    ), "lists")

    def deal(rows, own, others, is_query):
        joined = rows.join(both, (rows["label"] == both["of_label"]) & (rows["list"] == both["of_list"]))
        mine = F.pmod(F.xxhash64("cid"), F.col(own)).cast("int")
        return joined.select(
            "cid", "label", "vector", "copies", "list", "codes", "error", F.lit(is_query).alias("is_query"), mine.alias("mine"),
            F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias("other"),
        ).select(
            "cid", "vector", "copies", "list", "codes", "error", "is_query",
            F.xxhash64("label", "list", F.col("other" if is_query else "mine"), F.col("mine" if is_query else "other")).alias("pair"),
        )

    rows = deal(index, "iblocks", "qblocks", False).unionByName(deal(queries, "qblocks", "iblocks", True))
    return rows.repartition("pair").sortWithinPartitions("pair", "is_query")


def near_duplicates(
    vectors: DataFrame, least: float = 0.98, key: str = "vec_id", column: str = "embedding", label: str = "label",
    sample_rows: int = 20_000, list_rows: int = 1024, max_lists: int = 1024, subspaces: int = 8, codes: int = 32,
) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row: vectors of one label at cosine ``least`` or more are linked.

    The quantiser is fitted on ``sample_rows`` distinct vectors, the smallest by a hash, and holds about one
    list per ``list_rows`` of a label's vectors, ``max_lists`` at most; every vector is indexed and every
    vector is a query. Equal vectors of a label are one class and count as so many links. Only vectors of one length are
    compared; shorter ones are filled up with zeros, which no cosine sees, and are a label of their own. Vectors that are
    null, zero, or hold null or non-finite components, or have no label, link with nothing: no links, their own
    component. Components are compared as they come, floats or doubles of any size. ``component_id`` is the smallest key
    that links reach; null keys count for no minimum, and where it is null the row counts as kept. Empty
    input gives no rows.
    """
    kind = "float" if dict(vectors.dtypes)[column] == "array<float>" else "double"
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(column).cast(f"array<{kind}>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    sound = F.coalesce(finite & F.exists("vector", lambda v: v != 0) & F.col("label").isNotNull(), F.lit(False))
    rows = rows.withColumn("width", F.when(sound, F.size("vector")))
    width = rows.agg(F.max("width")).first()[0]
    good, bad = rows.filter("width is not null"), rows.filter("width is null")
    filled = F.concat("vector", F.array_repeat(F.lit(0).cast(kind), (width or 0) - F.col("width")))
    good = good.select(
        "id", F.concat_ws(":", "width", F.col("label").cast("string")).alias("label"),
        F.when(F.col("width") == (width or 0), F.col("vector")).otherwise(filled).alias("vector"),
    )
    alone = bad.select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")
    )
    if not width:
        return alone.withColumnRenamed("id", key)
    classes = stored(
        good.groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("id").alias("least")).withColumn(
            "cid", F.monotonically_increasing_id()
        ), "classes",
    )
    per_label = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    chosen = classes.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(sample_rows).collect()
    sample = balanced(np.array([r["vector"] for r in chosen], np.float64))
    sample /= np.sqrt((sample**2).sum(axis=1))[:, None]
    model = fit(sample, max(1, min(max_lists, per_label // list_rows)), subspaces, codes)
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
    coarse, books = model.coarse, model.books
    shared = vectors.sparkSession.sparkContext.broadcast((coarse, books))

    def run(frames):
        model = Quantiser(*shared.value)

        def work(frame):
            for _, pair in frame.groupby("pair", sort=False):
                asks = pair["is_query"].to_numpy()
                if asks.all() or not asks.any():
                    continue
                ids, links, a, b = compare(model, int(pair["list"].iloc[0]), pair[~asks], pair[asks], least, reach)
                yield pd.DataFrame({"a": np.concatenate([ids, a]), "links": np.concatenate([links, np.zeros(len(a), np.int64)]), "b": np.concatenate([ids, b])})

        yield from by_key(frames, "pair", work)

    pairs = _dealt(_coded(classes, model, width, reach, False), _coded(classes, model, width, reach, True))
    found = stored(pairs.mapInPandas(run, "a bigint, links bigint, b bigint"), "links")
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    grouped = components(found.select("a", "b"))
    labelled = classes.join(links, classes["cid"] == links["a"], "left").drop("a").join(
        grouped, F.col("cid") == grouped["node"], "left"
    ).withColumn("root", F.coalesce("component", "cid"))
    smallest = labelled.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"))
    judged = labelled.join(smallest, labelled["root"] == smallest["of"]).select(
        F.col("label").alias("of_label"), F.col("vector").alias("of_vector"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    judged_rows = good.join(judged, (good["label"] == judged["of_label"]) & (good["vector"] == judged["of_vector"])).select(
        "id", "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept")
    )
    return judged_rows.unionByName(alone).withColumnRenamed("id", key)
