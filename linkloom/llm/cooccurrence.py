"""Items that appear together: a blocked Gram matrix of the basket-by-item incidence matrix.

Baskets become sparse binary rows. Each block of records contributes the product of its transpose with itself; its
entries leave the block summed, cut by the blocks that the two items fall in. Partial products of one pair of item
blocks are summed across record blocks, and counts are set against what the marginals (the diagonal) lead to expect.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.operators.arrays import column, flat, list_array, mixed
from linkloom.runtime import partitions, ship, stage, table

MAX_ITEMS = 100
#: Parts into which the pairs of one item are split when its count is joined to them.
SALTS = 8
RECORD_BLOCK = 1 << 18  # elements of the incidence matrix in a block of records
PENDING = 1 << 21  # summed entries of a pair of item blocks that are held before they are compacted


def transpose_product(starts: np.ndarray, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """X'X of the sparse binary matrix with rows ``codes[starts[i]:starts[i+1]]`` (ascending): its upper triangle with the diagonal, as (row, column, count)."""
    sizes = np.diff(starts)
    keys = [codes.astype(np.int64) * width + codes]  # the diagonal
    for k in np.unique(sizes[sizes > 1]):
        rows = starts[:-1][sizes == k]
        left, right = np.triu_indices(k, 1)
        step = max(1, (1 << 22) // len(left))
        for at in range(0, len(rows), step):
            x = codes[rows[at : at + step, None] + np.arange(k)].astype(np.int64)
            keys.append((x[:, left] * width + x[:, right]).ravel())
    found, n = np.unique(np.concatenate(keys), return_counts=True)
    return found // width, found % width, n


def summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of sparse matrices given as (row id, column id, count)."""
    a, b, n = (np.concatenate(x) for x in zip(*parts))
    terms, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    keys, where = np.unique(codes[: len(a)].astype(np.int64) * len(terms) + codes[len(a) :], return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, where, n)
    return terms[keys // len(terms)], terms[keys % len(terms)], total


def gram(rows: DataFrame, basket: str, item: str, max_items: int = MAX_ITEMS, least: int = 1) -> DataFrame:
    """(a, b, n) with a <= b: in how many baskets a and b both are; n of (a, a) is in how many a is; (null, null, n) counts the baskets.

    Baskets are the values of ``basket`` with their distinct items (integers); one with more than ``max_items`` items
    is left out everywhere. Pairs found together in fewer than ``least`` baskets are left out, the diagonal isn't.
    Nulls are neither basket nor item. Repeated rows count once. An empty input gives an empty result; other columns
    aren't read.

    A basket that is far too large never reaches one task: the rank limit is applied within each map task first, and
    ``max_items`` + 1 distinct items out of one task prove it as well as all of them.
    """
    spark = rows.sparkSession
    ship(spark)
    blocks = max(4, math.ceil(math.sqrt(4 * partitions(spark))))
    place = F.row_number().over(Window.partitionBy("basket").orderBy("item"))
    limited = (
        rows.select(F.col(basket).cast("long").alias("basket"), F.col(item).cast("long").alias("item"))
        .filter("basket is not null and item is not null")
        .distinct()
        .withColumn("place", place)
        .filter(F.col("place") <= max_items + 1)
        .select("basket", "item")
    )

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def product(record: np.ndarray, items: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.append(np.flatnonzero(np.append(True, record[1:] != record[:-1])), len(record))
            sizes = np.diff(starts)
            kept = np.repeat(sizes <= max_items, sizes)
            items, sizes = items[kept], sizes[sizes <= max_items]
            if not len(items):
                return
            starts = np.concatenate([[0], np.cumsum(sizes)])
            terms, codes = np.unique(items, return_inverse=True)
            a, b, n = transpose_product(starts, codes, len(terms))
            block = (mixed(terms) % np.uint64(blocks)).astype(np.int64)
            at = block[a] * blocks + block[b]
            order = np.argsort(at, kind="stable")
            ids, cuts = np.unique(at[order], return_index=True)
            cuts = np.append(cuts, len(order))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(ids, -1).astype(np.int32)), *(pa.concat_arrays([list_array(x[order].astype(np.int64), cuts), pa.array([[y]], pa.list_(pa.int64()))]) for x, y in ((terms[a], 0), (terms[b], 0), (n, len(sizes))))],
                names=["block", "a", "b", "n"],
            )

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:  # in order of basket, then item
            held.append((column(batch, "basket").to_numpy(), column(batch, "item").to_numpy()))
            if sum(len(r) for r, _ in held) >= RECORD_BLOCK:
                record, items = (np.concatenate(x) for x in zip(*held))
                cut = np.searchsorted(record, record[-1])  # the last basket may go on in the next batch
                yield from product(record[:cut], items[:cut]) if cut else ()
                held = [(record[cut:], items[cut:])]
        if held:
            record, items = (np.concatenate(x) for x in zip(*held))
            if len(record):
                yield from product(record, items)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(block: int, parts: list) -> Iterator[pa.RecordBatch]:
            a, b, n = summed(parts)
            kept = (n >= least) | (a == b)
            for at in range(0, kept.sum(), 1 << 16):
                cut = [x[kept][at : at + (1 << 16)] for x in (a, b, n)]
                ids = [pa.array(x, mask=np.full(len(x), block < 0)) for x in cut[:2]]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(cut[2])], names=["a", "b", "n"])

        now, held, size = None, [], 0
        for batch in batches:
            for r in range(batch.num_rows):
                block = batch.column("block")[r].as_py()
                if block != now and held:
                    yield from done(now, held)
                    held, size = [], 0
                now = block
                held.append(tuple(flat(batch.column(c).slice(r, 1)) for c in "abn"))
                size += len(held[-1][0])
                if size > PENDING and len(held) > 1:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > PENDING // 2:
                        size = 0  # mostly distinct: compact again only after as much has come in
        if held:
            yield from done(now, held)

    return (
        limited.sortWithinPartitions("basket", "item")
        .mapInArrow(products, "block int, a array<long>, b array<long>, n array<long>")
        .repartition(partitions(spark), "block")
        .sortWithinPartitions("block")
        .mapInArrow(sums, "a long, b long, n long")
    )


def pair_counts(rows: DataFrame, basket: str, item: str, max_items: int = MAX_ITEMS, least: int = 5) -> DataFrame:
    """(a_id, b_id, n_ab, n_a, n_b, n_baskets) with a_id < b_id of the pairs in at least ``least`` baskets. For the rest see :func:`gram`.

    How much more often than chance a pair comes is n_ab * n_baskets / (n_a * n_b).
    """
    g = stage(gram(rows, basket, item, max_items, least), "gram")
    n = g.filter("a is null").agg(F.sum("n")).first()[0] or 0
    alone = g.filter("a = b").select(F.col("a").alias("id"), F.col("n").alias("alone"))
    # an item that goes with very many others has its pairs split by these
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    left = alone.select(F.col("id").alias("a"), F.col("alone").alias("n_a"), every.alias("salt_a"))
    right = alone.select(F.col("id").alias("b"), F.col("alone").alias("n_b"), every.alias("salt_b"))
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    pairs = g.filter("a < b").withColumn("salt_a", salt("b")).withColumn("salt_b", salt("a")).join(left, ["a", "salt_a"]).join(right, ["b", "salt_b"])
    return pairs.select(F.col("a").alias("a_id"), F.col("b").alias("b_id"), F.col("n").alias("n_ab"), "n_a", "n_b", F.lit(n).cast("long").alias("n_baskets"))


def content_links(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("id").isNotNull() & F.col("link_type").isin("wikilink", "markdown")).select("source_id", "target_id")


def linked_together(edges: DataFrame) -> DataFrame:
    return pair_counts(content_links(edges), "source_id", "target_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = linked_together(table(spark, sf_dir, "edges"))
    often = F.col("n_ab").cast("decimal(19,0)") * F.col("n_baskets") >= F.lit(20).cast("decimal(2,0)") * (F.col("n_a").cast("decimal(18,0)") * F.col("n_b").cast("decimal(18,0)"))
    return pairs.filter(often).select("a_id", "b_id")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs in at least five baskets, with the figures from which their lift follows."""
    return linked_together(table(spark, sf_dir, "edges"))


_BASKETS = """
WITH x AS (SELECT DISTINCT source_id s, target_id t FROM edges
  WHERE id IS NOT NULL AND source_id IS NOT NULL AND target_id IS NOT NULL AND link_type IN ('wikilink', 'markdown')),
k AS (SELECT * FROM x WHERE s IN (SELECT s FROM x GROUP BY s HAVING count(*) <= 100)),
f AS (SELECT t, count(*) n FROM k GROUP BY t),
n AS (SELECT count(DISTINCT s) n FROM k),
p AS (SELECT l.t a, r.t b, count(*) c FROM k l JOIN k r ON l.s = r.s AND l.t < r.t GROUP BY ALL HAVING count(*) >= 5)
"""
P3_SQL = _BASKETS + "SELECT a AS a_id, b AS b_id FROM p JOIN f fa ON fa.t = a JOIN f fb ON fb.t = b, n WHERE p.c * n.n >= 20 * fa.n * fb.n"
P3_PAIRS_SQL = _BASKETS + "SELECT a AS a_id, b AS b_id, p.c AS n_ab, fa.n AS n_a, fb.n AS n_b, n.n AS n_baskets FROM p JOIN f fa ON fa.t = a JOIN f fb ON fb.t = b, n"
