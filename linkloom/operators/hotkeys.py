"""Per-key results where a few keys hold most rows: dense accumulator arrays instead of grouping rows by key.

1. Every input split (equal ones: the rows are hashed on their own id) dictionary-encodes its keys and accumulates
   counts with ``bincount`` and sums with a scatter-add into dense arrays over the local dictionary.
2. The arrays leave the split cut into blocks, a block being a hash class of keys. A key, however hot, is one entry
   per split from here on.
3. Blocks are summed across splits by a streaming reduction: a block dictionary is made of the parts and the arrays
   are scatter-added into it.

Nothing depends on how the rows spread over the keys: the work of step 1 is even by construction, and what step 3 gets
is bounded by (distinct keys in a split) x (splits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.arrays import chunks, column, flat, list_array, mixed
from linkloom.runtime import partitions, ship

#: Rows that a split encodes at once, and entries that a block may hold before it is compacted (or twice what was left then).
CHUNK_ROWS = 1 << 20
PENDING = 1 << 21


def dense_key_aggregate(rows: DataFrame, roles: dict[str, str], sums: list[str] | None = None, blocks: int | None = None, prefix: str = "") -> DataFrame:
    """Count (and sum) the rows of every key of every role.

    ``roles``: role name to integer key column. ``sums``: names of integer columns to add up. Result: ``key_role``,
    ``key`` (long), ``n`` and ``sum_<column>`` of each in ``sums``. The names in the result can be led by ``prefix``.

    Null keys are no keys and give no row. A null value adds nothing. An empty input gives an empty result. Repeated
    rows count as often as they occur: deduplicate first where that isn't meant. Other columns of ``rows``, whatever
    their names, aren't read. Sums wrap as 64-bit integers.
    """
    ship(rows.sparkSession)
    sums = sums or []
    parts = partitions(rows.sparkSession)
    blocks = blocks or 4 * parts
    names = list(roles)
    picked = rows.select(
        *[F.col(c).cast("long").alias(f"k{i}") for i, c in enumerate(roles.values())],
        *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(f"v{i}") for i, c in enumerate(sums)],
    )
    width = len(sums) + 1
    arrays = ", ".join(f"a{i} array<long>" for i in range(width))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, CHUNK_ROWS):
            values = [column(part, f"v{i}").to_numpy() for i in range(width - 1)]
            for role in range(len(names)):
                keys = column(part, f"k{role}")
                live = keys.is_valid().to_numpy(zero_copy_only=False)
                if not live.any():
                    continue
                local = keys.drop_null().dictionary_encode()
                codes, terms = local.indices.to_numpy(), local.dictionary.to_numpy()
                dense = [np.bincount(codes, minlength=len(terms)).astype(np.int64)]
                for v in values:
                    total = np.zeros(len(terms), np.int64)
                    np.add.at(total, codes, v[live])
                    dense.append(total)
                block = (mixed(terms) % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                ids, starts = np.unique(block[order], return_index=True)
                starts = np.append(starts, len(order))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), role, np.int32)), pa.array(ids.astype(np.int32)), list_array(terms[order], starts)] + [list_array(d[order], starts) for d in dense],
                    names=["role", "block", "terms", *[f"a{i}" for i in range(width)]],
                )

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compact(held: list[list[np.ndarray]]) -> list[np.ndarray]:
            terms, codes = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            out = [terms]
            for i in range(width):
                total = np.zeros(len(terms), np.int64)
                np.add.at(total, codes, np.concatenate([h[i + 1] for h in held]))
                out.append(total)
            return out

        def rows_of(role: int, held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            done = compact(held)
            for at in range(0, len(done[0]), 1 << 16):
                cut = [x[at : at + (1 << 16)] for x in done]
                yield pa.RecordBatch.from_arrays([pa.array([names[role]] * len(cut[0])), *map(pa.array, cut)], names=["key_role", "key", "n", *[f"sum_{c}" for c in sums]])

        now, held, n, most = None, [], 0, PENDING
        for b in batches:
            roles_, blocks_ = b.column("role").to_numpy(), b.column("block").to_numpy()
            lists = [b.column(c) for c in ("terms", *[f"a{i}" for i in range(width)])]
            for r in range(b.num_rows):
                at = (int(roles_[r]), int(blocks_[r]))
                if at != now and held:
                    yield from rows_of(now[0], held)
                    held, n, most = [], 0, PENDING
                now = at
                held.append([flat(x.slice(r, 1)) for x in lists])
                n += len(held[-1][0])
                if n > most:
                    held = [compact(held)]
                    n = len(held[0][0])
                    most = max(PENDING, 2 * n)  # so that the work stays in proportion to what comes in
        if held:
            yield from rows_of(now[0], held)

    found = (
        picked.mapInArrow(encode, f"role int, block int, terms array<long>, {arrays}")
        .repartition(parts, "role", "block")
        .sortWithinPartitions("role", "block")
        .mapInArrow(reduce, "key_role string, key long, n long" + "".join(f", sum_{c} long" for c in sums))
    )
    return found.select(*[F.col(c).alias(prefix + c) for c in found.columns]) if prefix else found


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row per edge id, hashed on it: equal splits whatever the keys are.

    A row without an id is no edge. Rows of one id are the same but for ``indexed_at``; should they ever differ
    elsewhere, each column's greatest value counts, so that the result doesn't depend on row order. Link types are kept
    as ``is_content`` (1 for wikilink and markdown), which lets the aggregation run on fixed-width buffers.
    """
    return (
        edges.filter(F.col("id").isNotNull())
        .select("id", "source_id", "target_id", F.col("link_type").isin("wikilink", "markdown").cast("int").alias("is_content"))
        .groupBy("id")
        .agg(F.max("source_id").alias("source_id"), F.max("target_id").alias("target_id"), F.coalesce(F.max("is_content"), F.lit(0)).alias("is_content"))
    )


def key_counts(edges: DataFrame) -> DataFrame:
    """(key_role, node_id, n_edges, n_content) of every source and target of the edge table."""
    found = dense_key_aggregate(distinct_edges(edges), {"source": "source_id", "target": "target_id"}, ["is_content"])
    return found.select("key_role", F.col("key").alias("node_id"), F.col("n").alias("n_edges"), F.col("sum_is_content").alias("n_content"))


def heavy_keys(edges: DataFrame, share: int = 100) -> DataFrame:
    """(key_role, node_id) of the keys that hold at least one ``share``-th of all distinct edges.

    Edges with a null key count into the total. The total comes from the same accumulators, as the count of a role
    that all edges share.
    """
    from linkloom.runtime import stage

    once = distinct_edges(edges).withColumn("any", F.lit(0))
    counts = stage(dense_key_aggregate(once, {"source": "source_id", "target": "target_id", "": "any"}), "key-counts")
    total = counts.filter("key_role = ''").agg(F.sum("n")).first()[0] or 0
    return counts.filter("key_role <> ''").filter(F.col("n") * share >= F.lit(total)).select("key_role", F.col("key").alias("node_id"))
