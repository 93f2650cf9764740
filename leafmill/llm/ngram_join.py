"""Similarity join of texts by the Jaccard similarity of their five-word shingles.

Candidates come from an LSH forest. Each of ``TREES`` trees labels a text with a row of
min-hashes; texts that share a prefix of their labels are candidates. Prefixes are
shortened until the chance that a pair just at the threshold shares one in some tree
reaches the target recall, and further wherever the trie is sparse, since few texts
share the shorter prefix there. Crowded prefixes keep the guaranteed depth and are cut
into tiles of bounded size.

Within a tile the rest of the signatures rejects pairs that are far below the threshold.
What remains links texts into clusters, and in each cluster all pairs are verified
exactly on their shingle sets, again tile by tile. Equal texts are one node throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm.spark import bounded_batches, components, grouped, shuffle_parts, stored, tiles
from leafmill.llm.words import mix, segments, shingle_hashes, slices
from leafmill.operators.frames import broadcast_if_small

THRESHOLD = 0.8
RECALL = 0.99
TREES = 16
LABEL = 8  # min-hashes in a tree's label
SPARSE = 16  # texts at a trie node that may be shortened further
EXTRA = 2  # levels that sparse nodes are shortened by, at most
SLACK = 0.2  # estimates this far below the threshold are rejected; five standard errors
TILE = 512  # texts in a block
TILE_CHARS = 16 << 20  # characters in a block of the verification
LAST_ID = (1 << 63) - 1


def node_of(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))


def depth_for(threshold: float, recall: float, trees: int = TREES, label: int = LABEL) -> int:
    """The longest prefix that still finds a pair at the threshold with the target recall."""
    for depth in range(label, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def signatures(docs: DataFrame, id_col: str, text_col: str, levels: list[int]) -> DataFrame:
    """(at, node, chars, prefixes, signature) of each row.

    ``prefixes`` holds, tree by tree, a hash of the label's prefix at each level;
    ``signature`` one byte of each min-hash. Both are empty for texts without words.
    """
    hashes = TREES * LABEL
    seeds = mix(np.arange(2 * hashes, dtype=np.uint64) + np.uint64(77))
    factors = (seeds[:hashes] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    shifts = (seeds[hashes:] >> np.uint64(32)).astype(np.uint32)

    def sign(texts: list[str]) -> tuple[list, list]:
        shingles, counts = shingle_hashes(texts)
        filled = np.flatnonzero(counts)
        if not len(filled):
            return [[]] * len(texts), [b""] * len(texts)
        starts = (np.cumsum(counts) - counts)[filled]
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.empty((len(filled), hashes), np.uint32)
        work = np.empty_like(x)
        for j in range(hashes):
            np.multiply(x, factors[j], out=work)
            np.add(work, shifts[j], out=work)
            least[:, j] = np.minimum.reduceat(work, starts)
        keys = np.empty((len(filled), TREES, len(levels)), np.uint64)
        for tree in range(TREES):
            path = np.full(len(filled), tree + 1, np.uint64)
            for d in range(max(levels)):
                path = mix(path ^ mix(least[:, tree * LABEL + d].astype(np.uint64)))
                if d + 1 in levels:
                    keys[:, tree, levels.index(d + 1)] = path
        flat = keys.reshape(len(filled), -1).astype(np.int64)
        low = least.astype(np.uint8)
        prefixes, signed = [[]] * len(texts), [b""] * len(texts)
        for row, i in enumerate(filled.tolist()):
            prefixes[i], signed[i] = flat[row], low[row].tobytes()
        return prefixes, signed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch.column(2).to_pylist()):
                prefixes, signed = sign(part)
                at, node = (batch.column(i).slice(done, len(part)) for i in (0, 1))
                done += len(part)
                yield pa.RecordBatch.from_arrays(
                    [at, node, pa.array(map(len, part), pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(signed, pa.binary())],
                    ["at", "node", "chars", "prefixes", "signature"],
                )

    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("at"),
        node_of(F.col(text_col)).alias("node"),
        F.col(text_col).alias("text"),
    )
    return rows.mapInArrow(run, "at long, node binary, chars long, prefixes array<bigint>, signature binary")


def leaves(texts: DataFrame, levels: list[int]) -> DataFrame:
    """(node, leaf, size): the trie node of each tree in which a text meets others.

    The deepest level is the guaranteed one; a shallower level is taken where its node
    holds ``SPARSE`` texts at most.
    """
    names = [f"p{d}" for d in levels]
    width = len(levels)
    trees = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(*(F.element_at("prefixes", t * width + i + 1).alias(n) for i, n in enumerate(names))),
    )
    rows = texts.where(F.size("prefixes") > 0).select("node", F.explode(trees).alias("t")).select("node", "t.*")
    counts = rows.groupBy(*names).agg(F.count("*").alias(f"n{levels[-1]}"))
    for i, d in reversed(list(enumerate(levels[:-1]))):
        counts = counts.withColumn(f"n{d}", F.sum(f"n{levels[-1]}").over(Window.partitionBy(*names[: i + 1])))
    leaf, size = F.col(names[-1]), F.col(f"n{levels[-1]}")
    for d, name in reversed(list(zip(levels[:-1], names[:-1], strict=True))):
        leaf = F.when(F.col(f"n{d}") <= SPARSE, F.col(name)).otherwise(leaf)
        size = F.when(F.col(f"n{d}") <= SPARSE, F.col(f"n{d}")).otherwise(size)
    shared = counts.select(names[-1], leaf.alias("leaf"), size.alias("size")).where("size > 1")
    return rows.select("node", names[-1]).join(shared, names[-1]).select("node", "leaf", "size")


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least index of each row's component, for a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(1)
        new = np.minimum(near, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def likely_links(met: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that connect all texts of a tile whose signatures agree well enough."""
    least = threshold - SLACK

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "tile"):
            nodes = group.column("node").to_pylist()
            if len(nodes) < 2:
                continue
            signed = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(nodes), -1)
            step = max(1, (1 << 23) // signed.size)
            same = np.concatenate([(signed[i : i + step, None, :] == signed[None]).mean(2) for i in range(0, len(nodes), step)])
            roots = _roots((same - 1 / 256) / (1 - 1 / 256) >= least)
            far = np.flatnonzero(roots != np.arange(len(nodes)))
            if len(far):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nodes[i] for i in far], pa.binary()), pa.array([nodes[i] for i in roots[far]], pa.binary())], ["a", "b"]
                )

    dealt = met.select("node", F.explode(tiles(F.col("leaf"), F.col("size"), F.col("node"), TILE)).alias("t"))
    rows = dealt.select("node", "t.tile").join(texts.select("node", "signature"), "node")
    rows = rows.repartition(shuffle_parts(met.sparkSession), "tile").sortWithinPartitions("tile")
    return rows.mapInArrow(link, "a binary, b binary")


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets share."""
    n = len(sets)
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    common = times > 1  # values of one set only add nothing
    number = np.cumsum(common) - 1
    use = common[place]
    column, owner = number[place[use]], owner[use]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((n, n), np.float32)
    width = 4096
    for first in range(0, int(common.sum()), width):
        a, b = np.searchsorted(column, (first, first + width))
        table = np.zeros((n, width), np.float32)
        table[owner[a:b], column[a:b] - first] = 1
        shared += table @ table.T
    return shared


def verified(clusters: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(node, links, root) per tile: exact links of each text, and the least text it is joined to.

    ``clusters`` has node, at, chars and root, one row per text with likely links.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "tile"):
            first = {n: i for i, n in reversed(list(enumerate(group.column("node").to_pylist())))}  # repeated rows once
            nodes, picked = list(first), list(first.values())
            block = np.array(group.column("block").to_pylist())[picked]
            diagonal = bool(group.column("diagonal")[0].as_py())
            texts = group.column("text").to_pylist()
            sets = []
            for part in slices(texts[i] for i in picked):
                hashes, counts = shingle_hashes(part)
                sets += [np.unique(hashes[a:b]) for a, b in segments(counts)]
            sizes = np.array([len(s) for s in sets], float)
            shared = _shared_counts(sets)
            union = sizes[:, None] + sizes[None] - shared
            linked = shared >= threshold * union - 1e-6
            linked &= (block[:, None] == block[None]) if diagonal else (block[:, None] != block[None])
            np.fill_diagonal(linked, False)
            roots = _roots(linked)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.binary()), pa.array(linked.sum(1), pa.int64()), pa.array([nodes[i] for i in roots], pa.binary())],
                ["node", "links", "root"],
            )

    sizes = clusters.groupBy("root").agg(F.count("*").alias("n"), F.sum("chars").alias("c"))
    sizes = sizes.select("root", F.greatest(F.col("n"), F.col("c") * (TILE / TILE_CHARS)).alias("size"))
    members = clusters.join(sizes, "root").select("node", "at", "root", "size")
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("at"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    found = rows.join(broadcast_if_small(members), "at").where(node_of(F.col("text")) == F.col("node"))
    dealt = found.select("node", "text", F.explode(tiles(F.col("root"), F.col("size"), F.col("node"), TILE)).alias("t"))
    dealt = dealt.select("node", "text", "t.*").repartition(shuffle_parts(docs.sparkSession), "tile").sortWithinPartitions("tile", "node")
    return dealt.mapInArrow(verify, "node binary, links long, root binary")


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """(doc_id, text_id, copies, class_id, links): one row per row of the input.

    ``text_id`` is the least id among rows of equal text and ``copies`` their number,
    ``links`` the number of other texts whose shingle sets have a Jaccard similarity of
    at least the threshold, ``class_id`` the least id of all rows joined by equal texts
    and links. ``first`` marks the row that stands for its class. Nulls are empty texts; empty texts equal each other and link to nothing.
    Repeated rows are copies, null ids come after all others, an empty table gives no
    rows, other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    deepest = depth_for(threshold, recall)
    levels = list(range(max(1, deepest - EXTRA), deepest + 1))
    signed = stored(signatures(docs, id_col, text_col, levels), "signatures")
    texts = stored(
        signed.groupBy("node").agg(
            F.min("at").alias("at"),
            F.count("*").alias("copies"),
            F.first("chars").alias("chars"),
            F.first("prefixes").alias("prefixes"),
            F.first("signature").alias("signature"),
        ),
        "texts",
    )
    likely = components(likely_links(leaves(texts, levels), texts, threshold))
    roots = likely.select("root").distinct().select(F.col("root").alias("node"), "root")
    clusters = likely.union(roots).join(texts.select("node", "at", "chars"), "node")
    found = stored(verified(stored(clusters, "clusters"), docs, id_col, text_col, threshold), "verified")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = (
        texts.select("node", "at", "copies")
        .join(links, "node", "left")
        .join(joined, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    everyone = joined.union(joined.select(F.col("root").alias("node"), "root").distinct())
    heads = everyone.join(texts.select("node", "at"), "node").groupBy("root").agg(F.min(F.struct("at", "node")).alias("head"))
    known = known.join(heads, "root", "left").withColumn("head", F.coalesce("head", F.struct("at", "node")))
    known = known.select(
        "node",
        F.col("at").alias("text_at"),
        "copies",
        F.col("head.at").alias("class_at"),
        (F.col("head.node") == F.col("node")).alias("head"),
        F.coalesce("links", F.lit(0)).alias("links"),
    )
    rows = signed.select("at", "node").join(known, "node")

    def back(name: str) -> Column:
        return F.when(F.col(name) != LAST_ID, F.col(name))

    return rows.select(
        back("at").alias("doc_id"),
        back("text_at").alias("text_id"),
        "copies",
        back("class_at").alias("class_id"),
        "links",
        "node",
        (F.col("head") & (F.col("at") == F.col("text_at"))).alias("first"),
    )


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the least id of each class, with all their columns, one row per class.

    Rows that repeat both id and text of the one that stays go as well.
    """
    rows = stored(classes(docs, id_col, text_col), "classes")
    going = rows.where("not first").select(F.col("doc_id").alias("going_id"), F.col("node").alias("going_node")).distinct()
    kept = docs.join(
        broadcast_if_small(going),
        F.col(id_col).eqNullSafe(F.col("going_id")) & (node_of(F.col(text_col)) == F.col("going_node")),
        "left_anti",
    )
    again = rows.groupBy("doc_id", "node").count().where("count > 1").select(F.col("doc_id").alias("again_id")).distinct()
    if again.isEmpty():
        return kept
    repeated = F.col(id_col).eqNullSafe(F.col("again_id"))
    once = kept.join(again, repeated, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(again, repeated, "left_anti").unionByName(once)
