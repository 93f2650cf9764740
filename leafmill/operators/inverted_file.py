"""Approximate neighbours by an inverted file: vectors stored by coarse cell.

The centres of the cells are trained on a bounded sample of the corpus, every vector is
stored in the folder of its nearest centre, and a query reads only the cells whose centres
are nearest to it. How many that are follows from a recall target: when the index is built,
the exact neighbours of a sample of queries are found by one scan, and of each the rank of
its cell among the centres, as its query sees them, is kept. The share of neighbours within
the first cells is the recall that so many cells give.

An index covers the changes of a store up to the number it is called by. Rows that came
later or got another vector are searched exactly beside it, and deleted ones are left out,
so it is never wrong about what is there, only slower until it is built again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import store
from leafmill.operators.frames import broadcast_if_small
from leafmill.operators.hits import QUERY_LIMIT, blocked_hits, rank_hits
from leafmill.operators.search import RESULTS, _unit_rows, _vectors, cosine_kernel, knn

ROWS_PER_CELL = 500
MOST_CELLS = 4096  # a larger corpus has more rows per cell
SAMPLE_PER_CELL = 32  # rows that train a cell; all together stay on the driver
ROUNDS = 8
PROBED = 400  # sampled queries that measure the recall
TARGET = 0.95
SHARES = 1 << 30
INDEX = "index"


def sample(rows: DataFrame, n: int, total: int, salt: int) -> DataFrame:
    """About n of the rows, the same whenever they are asked for: those of the least hash of the id."""
    chosen = F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(SHARES))
    return rows if n >= total else rows.where(chosen < int(SHARES * n / total))


def centres(vectors: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of cells of unit vectors, by rounds of assignment and mean.

    A cell that loses all its vectors takes the vector that is farthest from its centre.
    """
    chance = np.random.default_rng(0)
    found = vectors[chance.choice(len(vectors), min(cells, len(vectors)), replace=False)]
    for _ in range(rounds):
        near, at = _nearest(vectors, found)
        sums = np.zeros_like(found)
        np.add.at(sums, at, vectors)
        empty = np.flatnonzero(np.bincount(at, minlength=len(found)) == 0)
        sums[empty] = vectors[np.argsort(near)[: len(empty)]]
        norms = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        found = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-30)[:, None], found)
    return found


def _nearest(vectors: np.ndarray, found: np.ndarray, rows: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    parts = [vectors[i : i + rows] @ found.T for i in range(0, len(vectors), rows)]
    return np.concatenate([p.max(1) for p in parts]), np.concatenate([p.argmax(1) for p in parts])


def _ranked_cells(queries: pd.Series, found: np.ndarray) -> np.ndarray:
    """Cells from the nearest to the farthest, per query."""
    return np.argsort(-(_unit_rows(queries, found.shape[1]) @ found.T), axis=1, kind="stable")


def cell_of(vector: Column, found: np.ndarray) -> Column:
    """The nearest cell; -1 for a vector of another dimension than the centres'."""

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), -1, np.int32)
        at = np.flatnonzero(vectors.str.len() == found.shape[1])
        if len(at):
            out[at] = _nearest(_unit_rows(vectors.iloc[at], found.shape[1]), found)[1]
        return pd.Series(out)

    return nearest(vector)


def build_index(corpus: DataFrame, path: str, id_col: str = "id", vector: str = "embedding", cells: int | None = None, k: int = RESULTS) -> None:
    """Write the index of a corpus: every usable vector by cell, the centres, and the ranks of true neighbours.

    The centres are trained on ``SAMPLE_PER_CELL`` sampled rows per cell, the recall is
    measured with ``PROBED`` sampled queries. Vectors of another dimension than most, which
    no trained cell fits, are a cell of their own that is always read.
    """
    spark = corpus.sparkSession
    rows = _vectors(corpus, id_col, vector, "id")
    sizes = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim, n = (sizes[0]["dim"], sizes[0]["count"]) if sizes else (0, 0)
    cells = cells or min(MOST_CELLS, max(1, n // ROWS_PER_CELL))
    usual = rows.where(F.size("embedding") == dim)
    trained = sample(usual, SAMPLE_PER_CELL * cells, n, 0).toPandas().sort_values("id")  # bounded by MOST_CELLS
    found = centres(_unit_rows(trained["embedding"], dim), cells) if len(trained) else np.zeros((0, dim))
    named = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(found)], "cell int, centre array<double>")
    named.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    located = rows.withColumn("cell", cell_of(F.col("embedding"), found) if len(found) else F.lit(-1))
    # a cell that holds a third of the rows is shared out over several files
    located.repartitionByRange("cell", F.xxhash64("id")).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    asked = sample(usual, PROBED, n, 1).select(F.col("id").alias("query_id"), "embedding")
    true = knn(rows, asked, k, exclude_self=True).select("query_id", "id")
    homes = read_cells(spark, path, rows.schema["id"].dataType.simpleString()).select("id", "cell").join(broadcast_if_small(true), "id")

    @F.pandas_udf("array<int>")
    def order(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(np.argsort(_ranked_cells(vectors, found), axis=1).astype(np.int32)))

    placed = asked.select("query_id", order("embedding").alias("order")) if len(found) else asked.select("query_id", F.array(F.lit(0)).alias("order"))
    ranks = homes.where("cell >= 0").join(placed, "query_id").groupBy(F.get("order", F.col("cell")).alias("rank")).agg(F.count("*").alias("neighbours"))
    ranks.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")


def read_cells(spark: SparkSession, path: str, id_type: str, wanted: set[int] | None = None) -> DataFrame:
    """The stored vectors, or those of some cells, whose folders alone are then listed."""
    reader = spark.read.schema(f"id {id_type}, embedding array<float>, cell int").option("basePath", f"{path}/cells")
    if wanted is None:
        return reader.parquet(f"{path}/cells")
    there = [n for n in store.folder_names(spark, f"{path}/cells") if n.startswith("cell=") and int(n[5:]) in wanted]
    if not there:
        return spark.createDataFrame([], f"id {id_type}, embedding array<float>, cell int")
    return reader.parquet(*(f"{path}/cells/{n}" for n in sorted(there)))


@dataclass
class Index:
    """What a search needs beside the stored vectors: a few rows per cell."""

    path: str
    centres: np.ndarray
    ranks: np.ndarray  # neighbours that were found in the cell of each rank

    def probes(self, target: float) -> int:
        """The least number of cells that had this share of the sampled neighbours; all cells for a target of 1."""
        share = np.cumsum(self.ranks) / max(1, self.ranks.sum())
        if target >= 1 or not self.ranks.sum():
            return len(self.centres)
        return int(np.searchsorted(share, target) + 1)


def load_index(spark: SparkSession, path: str) -> Index:
    found = spark.read.schema("cell int, centre array<double>").parquet(f"{path}/centres").orderBy("cell").toPandas()
    ranks = spark.read.schema("rank int, neighbours long").parquet(f"{path}/ranks").toPandas()
    counts = np.zeros(len(found), np.int64)
    counts[ranks["rank"].to_numpy(int)] = ranks["neighbours"].to_numpy()
    table = np.array(found["centre"].to_list(), float) if len(found) else np.zeros((0, 0))
    return Index(path, table, counts)


def search_index(
    index: Index,
    queries: DataFrame,
    k: int = RESULTS,
    target: float = TARGET,
    query_id: str = "query_id",
    vector: str = "embedding",
    id_type: str = "string",
    exclude_self: bool = False,
    query_limit: int = QUERY_LIMIT,
    without: DataFrame | None = None,
) -> DataFrame:
    """``query_id, id, score, distance, rank`` of the k nearest rows in the cells that the target asks for.

    Few queries (at most ``query_limit``, checked) travel to the cells, of which only those
    that some query wants are read, and no vector is shuffled. More queries meet the cells
    in blocks of bounded size, whatever the cell where they want all of them. ``without`` has
    ids that are no hits.
    """
    spark = queries.sparkSession
    asked = _vectors(queries, query_id, vector, "query_id")
    probes, kernel = index.probes(target), cosine_kernel(exclude_self)

    def rows(cells: set[int] | None = None) -> DataFrame:
        found = read_cells(spark, index.path, id_type, cells)
        return found if without is None else found.join(broadcast_if_small(without.select("id")), "id", "left_anti")

    batch = asked.limit(query_limit + 1).toPandas()  # bounded by the limit
    if len(batch) > query_limit and probes >= len(index.centres):  # all cells are as one: a query is copied per block of rows, not per cell
        hits = blocked_hits(rows().withColumn("cell", F.lit(0)), asked.withColumn("cell", F.lit(0)), kernel, k, ["cell"])
    elif len(batch) > query_limit:
        wanted = asked.select("query_id", "embedding", F.explode(_probed(index, probes)).alias("cell"))
        hits = blocked_hits(rows(), wanted, kernel, k, ["cell"])
    else:
        hits = _few(rows, batch, index, probes, kernel, k, asked)
    return hits.withColumn("distance", F.round(1 - F.col("score"), 6))


def _cells_of(vectors: pd.Series, found: np.ndarray, probes: int) -> list[np.ndarray]:
    """The cells that each query wants; a query of another dimension only that of the others."""
    out = [np.array([-1], np.int32)] * len(vectors)
    at = np.flatnonzero(vectors.str.len() == found.shape[1])
    if len(at) and len(found):
        ranked = _ranked_cells(vectors.iloc[at], found)[:, :probes]
        for i, cells in zip(at.tolist(), ranked, strict=True):
            out[i] = np.append(cells, -1).astype(np.int32)
    return out


def _probed(index: Index, probes: int) -> Column:
    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        return pd.Series(_cells_of(vectors, index.centres, probes))

    return cells("embedding")


def _few(rows: Callable[[set[int]], DataFrame], batch: pd.DataFrame, index: Index, probes: int, kernel, k: int, asked: DataFrame) -> DataFrame:
    cells = _cells_of(batch["embedding"], index.centres, probes) if len(batch) else []
    wanting: dict[int, list[int]] = {}
    for at, own in enumerate(cells):
        for cell in own.tolist():
            wanting.setdefault(cell, []).append(at)

    def scored(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            best = []
            for cell, members in block.groupby("cell"):
                some = batch.iloc[wanting.get(cell, [])]
                members = members.sort_values("id", kind="stable")
                if not len(some):
                    continue
                scores = kernel(members, some)
                keep = min(k, len(members))
                floor = np.partition(scores, len(members) - keep, axis=1)[:, len(members) - keep] - 1e-5
                q, c = np.nonzero((scores >= floor[:, None]) & np.isfinite(scores))
                values = np.round(scores[q, c], 6) + 0.0
                best.append(pd.DataFrame({"query_id": some["query_id"].to_numpy()[q], "id": members["id"].to_numpy()[c], "score": values}))
            if best:
                hits = pd.concat(best).sort_values(["query_id", "score", "id"], ascending=[True, False, True])
                yield hits[hits.groupby("query_id").cumcount() < k]

    kind, members = asked.schema["query_id"].dataType.simpleString(), rows(set(wanting))
    schema = f"query_id {kind}, id {members.schema['id'].dataType.simpleString()}, score double"
    return rank_hits(members.mapInPandas(scored, schema), k)


# ---- the index of a store -------------------------------------------------------


def _indexes(spark: SparkSession, root: str, number: int) -> list[int]:
    at = store.snapshot_path(root, number)
    found = [n for n in store.folder_names(spark, at) if n.startswith(f"{INDEX}-")]
    return sorted(int(n.split("-")[1]) for n in found if store.exists(spark, f"{at}/{n}/ranks/_SUCCESS"))


def index_store(spark: SparkSession, root: str, key: str = "id", vector: str = "embedding") -> int:
    """Index the newest snapshot with all its changes; the number of the last of these."""
    number = store.snapshots(spark, root)[-1]
    last = store.next_change(spark, root, number) - 1
    path = f"{store.snapshot_path(root, number)}/{INDEX}-{last:08d}"
    build_index(store.read_store(spark, root, number, key=key), path, key, vector)
    return last


def search_store(
    spark: SparkSession, root: str, queries: DataFrame, k: int = RESULTS, target: float = TARGET, key: str = "id", vector: str = "embedding", **options
) -> DataFrame:
    """The k nearest rows of the newest snapshot, by its newest index and exactly in what came later.

    A store without an index is searched exactly.
    """
    number = store.snapshots(spark, root)[-1]
    known = _indexes(spark, root, number)
    if not known:
        return knn(store.read_store(spark, root, number, key=key), queries, k, corpus_id=key, vector=vector, **options)
    covered = known[-1]
    id_type = store.store_schema(spark, root, number)[key].dataType.simpleString()
    index = load_index(spark, f"{store.snapshot_path(root, number)}/{INDEX}-{covered:08d}")
    batches, gone, patched = ([c for c in store.changes(spark, root, number, kind) if c > covered] for kind in (store.BATCH, store.DELETED, store.PATCH))
    late, without = [], []
    if batches:
        late.append(store.read_store(spark, root, number, batches, key).select(F.col(key).alias("id"), F.col(vector).alias("embedding")))
    if gone:
        paths = [store.change_path(root, number, store.DELETED, c) for c in gone]
        without.append(spark.read.schema(f"`{key}` {id_type}").parquet(*paths).select(F.col(key).alias("id")))
    if patched:
        paths = [store.change_path(root, number, store.PATCH, c) for c in patched]
        given = spark.read.schema(f"`{key}` {id_type}, `{vector}` array<float>").parquet(*paths).where(F.col(vector).isNotNull())
        moved = given.groupBy(F.col(key).alias("id")).agg(F.max_by(vector, store.change_number(store.PATCH)).alias("embedding"))
        held = moved.join(read_cells(spark, index.path, id_type).select("id"), "id", "left_semi")
        late.append(held.join(without[0], "id", "left_anti") if without else held)
        without.append(moved.select("id"))
    left_out = without[0].union(without[1]) if len(without) == 2 else without[0] if without else None
    hits = search_index(index, queries, k, target, vector=vector, id_type=id_type, without=left_out, **options)
    for rows in late:
        hits = hits.unionByName(knn(rows, queries.withColumnRenamed(vector, "embedding"), k, **options))
    if not late:
        return hits
    return rank_hits(hits.select("query_id", "id", "score").distinct(), k).withColumn("distance", F.round(1 - F.col("score"), 6))
