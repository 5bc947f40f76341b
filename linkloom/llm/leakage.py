"""Evaluation texts in training text: suffix arrays over shards of the corpus, searched for every evaluation suffix.

A shard is a run of documents of bounded length in words. Its suffix array orders all its word suffixes as deep as the
longest evaluation item; a binary search of each evaluation suffix gives the range of suffixes that share its first
words, and extending these gives the longest verbatim match and its place. Shards are built inside the map tasks that
read them, so the corpus is never shuffled; only matches are. Evaluation items are searched in chunks of bounded size, and
what a suffix matches is gone through in slices, so memory depends neither on their number nor on how the texts repeat.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.runtime import ship, spread, stage, table

LEAST_WORDS = 12
SHARD_WORDS = 1 << 19
#: Bytes of evaluation text that are collected and broadcast at once; more is taken in chunks of about this size.
CHUNK_BYTES = 16 << 20
#: Suffixes searched at once, and (suffix, place) pairs looked at at once.
BLOCK, SLICE = 1 << 15, 1 << 18
_WORD = re.compile(r"[^\W_]+")
_INDEX: dict[str, EvalIndex] = {}


def words(text: str | None) -> list[str]:
    """Runs of letters or digits in lower case."""
    return _WORD.findall(text.lower()) if text else []


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """The positions of ``codes`` in order of the (up to) ``depth`` codes that begin there, by prefix doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < depth:
        key = rank * (len(codes) + 2)
        key[:-k] += rank[k:]
        order = np.argsort(key, kind="stable")
        step = key[order]
        fresh = np.empty(len(codes), np.int64)
        fresh[order] = np.cumsum(np.append(True, step[1:] != step[:-1]))
        rank = fresh
        if rank[order[-1]] == len(codes):
            break
        k *= 2
    return order


def ranges(codes: np.ndarray, order: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``queries`` the range of ``order`` whose suffixes begin with it. ``codes`` ends in padding as long as a row."""
    width = np.arange(queries.shape[1])

    def search(right: bool) -> np.ndarray:
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(order), np.int64)
        while (open_ := lo < hi).any():
            at = np.flatnonzero(open_)
            mid = (lo[at] + hi[at]) // 2
            d = codes[order[mid][:, None] + width] - queries[at]
            first = d[np.arange(len(at)), np.argmax(d != 0, axis=1)]
            up = (first <= 0) if right else (first < 0)
            lo[at[up]], hi[at[~up]] = mid[up] + 1, mid[~up]
        return lo

    return search(False), search(True)


class EvalIndex:
    """The evaluation items as one run of word numbers, with the suffixes that are long enough to be looked for."""

    def __init__(self, items: list[tuple[int, str | None]], least: int):
        texts = [(i, w) for i, t in items if i is not None and len(w := words(t)) >= least]
        self.least = least
        self.vocabulary = list(dict.fromkeys(x for _, w in texts for x in w))
        number = {x: i for i, x in enumerate(self.vocabulary)}
        self.item = np.array([i for i, w in texts for _ in w], np.int64)
        self.words = np.array([number[x] for _, w in texts for x in w], np.int64)
        self.place = np.array([k for _, w in texts for k in range(len(w))], np.int64)
        self.left = np.array([len(w) - k for _, w in texts for k in range(len(w))], np.int64)
        self.starts = np.flatnonzero(self.left >= least) if texts else np.zeros(0, np.int64)
        self.depth = max((len(w) for _, w in texts), default=0)

    def matches(self, docs: list[int], texts: list[list[str]], offsets: list[int]) -> tuple[np.ndarray, ...]:
        """(item, doc, words in common, place in item, place in doc) of the longest match of each pair in the shard; ``offsets``: words of the document before each text."""
        none = tuple(np.zeros(0, np.int64) for _ in range(5))
        flat = [x for t in texts for x in t]
        if not flat or not len(self.starts):
            return none
        coded = pa.array(flat, pa.string()).dictionary_encode()
        size = len(coded.dictionary)
        known = pc.fill_null(pc.index_in(pa.array(self.vocabulary), coded.dictionary), -1).to_numpy().astype(np.int64)
        ends = np.cumsum([len(t) for t in texts])
        # one separator after each text, all different, so that no match goes over it
        codes = np.insert(coded.indices.to_numpy().astype(np.int64), ends, size + np.arange(len(texts)))
        doc = np.repeat(np.arange(len(texts)), np.diff(np.append(0, ends)) + 1)
        begin = np.append(0, ends[:-1]) + np.arange(len(texts))
        mine = known[self.words]
        order = suffix_array(codes, self.depth)
        padded = np.append(codes, np.full(max(self.depth, self.least), -2))
        before = np.append(-3, codes[:-1])  # the word before each place
        width = np.arange(self.least)
        ids, off = np.array(docs, np.int64), np.array(offsets, np.int64)
        best = none
        for k in range(0, len(self.starts), BLOCK):
            starts = self.starts[k : k + BLOCK]
            queries = mine[starts[:, None] + width]
            live = (queries >= 0).all(axis=1)
            starts, queries = starts[live], queries[live]
            if not len(starts):
                continue
            lo, hi = ranges(padded, order, queries)
            starts, lo, hi = starts[hi > lo], lo[hi > lo], hi[hi > lo]
            for at, pos in self._pairs(starts, lo, hi, order, before, mine):
                length = np.full(len(at), self.least)
                grow = np.arange(len(at))
                while len(grow):
                    grow = grow[length[grow] < self.left[at[grow]]]
                    grow = grow[mine[at[grow] + length[grow]] == padded[pos[grow] + length[grow]]]
                    length[grow] += 1
                d = doc[pos]
                new = (self.item[at], ids[d], length, self.place[at], pos - begin[d] + off[d])
                best = _longest(tuple(np.concatenate(x) for x in zip(best, new)))
        return best

    def _pairs(self, starts: np.ndarray, lo: np.ndarray, hi: np.ndarray, order: np.ndarray, before: np.ndarray, mine: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(suffix, place) of the matches that can't be made longer to the left, as the others are parts of these, in slices.

        The places in a range are sorted by the word before them, so those with the word that the suffix has before it
        are a range too, and are left out without being looked at.
        """
        if not len(starts):
            return
        first, one, of = np.unique(lo, return_index=True, return_inverse=True)  # suffixes with the same first words share a range
        size = hi[one] - first
        base = np.cumsum(size) - size
        places = order[np.repeat(first - base, size) + np.arange(size.sum())]
        span = int(max(before.max(initial=0), mine.max(initial=0))) + 8
        key = np.repeat(np.arange(len(first)) * span, size) + before[places] + 4
        by = np.argsort(key, kind="stable")
        key, places = key[by], places[by]
        a, z = base[of], base[of] + size[of]
        inside = self.place[starts] > 0
        same = of * span + np.where(inside, mine[starts - 1], -4) + 4  # no word, or none of the shard's, is before no place
        u, v = np.searchsorted(key, same), np.searchsorted(key, same, side="right")
        v = np.where(inside & (mine[starts - 1] >= 0), v, u)
        head = np.concatenate([a, v])
        n = np.concatenate([u - a, z - v])
        suffix = np.concatenate([starts, starts])
        head, suffix, n = head[n > 0], suffix[n > 0], n[n > 0]
        total = np.cumsum(n)
        for k in range(0, int(total[-1]) if len(n) else 0, SLICE):
            x = np.arange(k, min(k + SLICE, int(total[-1])))
            at = np.searchsorted(total, x, side="right")
            yield suffix[at], places[head[at] + x - (total[at] - n[at])]


def _longest(found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Of (item, doc, words, place in item, place in doc) the longest of each item and doc, the first of equal ones."""
    keep = np.lexsort((found[4], found[3], -found[2], found[1], found[0]))
    found = tuple(x[keep] for x in found)
    first = np.append(True, (found[0][1:] != found[0][:-1]) | (found[1][1:] != found[1][:-1])) if len(keep) else np.zeros(0, bool)
    return tuple(x[first] for x in found)


def leaked_passages(docs: DataFrame, items: DataFrame, least: int = LEAST_WORDS, shard_words: int = SHARD_WORDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(item_id, doc_id, n_words, item_word, doc_word): the longest run of words that an item and a document share, if it has ``least`` words or more.

    Places are counted in words from 0; of equally long runs the first in the item, then in the document counts.
    Null ids, null, empty and blank texts and items of fewer words than ``least`` match nothing. Items with the same
    text each have their rows. Repeated rows change nothing. Texts of any length are searched whole: one longer than a
    shard is cut into windows that overlap by the length of the longest item. Empty tables give an empty result;
    other columns aren't read. Items beyond ``chunk_bytes`` of text are searched in several passes over the documents,
    each with the items of one hash class; an item is never cut.
    """
    ship(docs.sparkSession)
    known = items.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    if chunks > 1:
        known = stage(known.withColumn("chunk", F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks))), "eval-items")
    picked = spread(docs.select("doc_id", "text").filter("doc_id is not null and text is not null"), "doc_id")
    parts = [_passages(picked, known.filter(F.col("chunk") == k) if chunks > 1 else known, least, shard_words) for k in range(chunks)]
    best = F.max(F.struct("n_words", (-F.col("item_word")).alias("i"), (-F.col("doc_word")).alias("d"))).alias("best")
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("item_id", "doc_id")
        .agg(best)
        .select("item_id", "doc_id", F.col("best.n_words"), (-F.col("best.i")).alias("item_word"), (-F.col("best.d")).alias("doc_word"))
    )


def _passages(picked: DataFrame, items: DataFrame, least: int, shard_words: int) -> DataFrame:
    """The matches in each shard of ``picked`` (doc_id, text) with ``items`` (item_id, text), which are broadcast."""
    shared = picked.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in items.select("item_id", "text").collect()])
    token = uuid.uuid4().hex

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _INDEX.get(token)
        if index is None:  # once a worker
            _INDEX.clear()
            index = _INDEX[token] = EvalIndex(shared.value, least)

        def found(ids: list[int], texts: list[list[str]], offsets: list[int]) -> Iterator[pa.RecordBatch]:
            cols = index.matches(ids, texts, offsets)
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["item_id", "doc_id", "n_words", "item_word", "doc_word"])

        if not len(index.starts):
            return
        ids, texts, offsets, n = [], [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(text)
                step = max(1, shard_words - index.depth)
                for k in range(0, max(len(w) - index.depth, 0) + 1, step):
                    part = w[k : k + shard_words] if len(w) > shard_words else w
                    if len(part) >= least:
                        ids.append(doc)
                        texts.append(part)
                        offsets.append(k)
                        n += len(part)
                    if n >= shard_words:
                        yield from found(ids, texts, offsets)
                        ids, texts, offsets, n = [], [], [], 0
                    if part is w:
                        break
        if texts:
            yield from found(ids, texts, offsets)

    return picked.mapInArrow(search, "item_id long, doc_id long, n_words long, item_word long, doc_word long")


def without_leaks(docs: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the documents that hold a passage of an item; a row with a null id can't be named and stays."""
    found = leaked_passages(docs, items, least).select(F.col("doc_id").alias("__leaked")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("__leaked"), "left_anti")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("item_id", "doc_id")


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are left once all with a passage of an evaluation item are gone."""
    return without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id")


_LEAKS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) i FROM d WHERE len(w) >= 12)),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) i FROM e WHERE len(w) >= 12)),
x AS (SELECT DISTINCT item_id, doc_id FROM dg JOIN eg USING (g))
"""
P7_SQL = _LEAKS + "SELECT item_id, doc_id FROM x"
P7_KEPT_SQL = _LEAKS + "SELECT doc_id FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM x)"
