"""Encoding with a byte-level BPE vocabulary by prefix dynamic programming.

A token sequence is what BPE makes of its bytes if and only if every two neighbours are what BPE makes of theirs. So
each byte prefix of a piece has one last token: the one that ends there and may follow the last token of the prefix
before it. Storing that token for every prefix gives the ids by walking back, and makes two things exact and cheap:
appending (the stored prefixes stay as they are) and encoding again after an edit (all pieces away from it stay).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.runtime import ship, spread, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pattern looks at most this many characters past the end of a match ("'" before "re").
LOOKAHEAD = 3
#: Pieces whose ids a worker remembers, and the longest of them in characters.
MEMO, MEMO_CHARS = 1 << 17, 64


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.width = max(ranks.values()) + 1
        #: every suffix of a token: its own id, or -1 if it isn't a token
        self.ends: dict[bytes, int] = {}
        for t in ranks:
            for k in range(len(t)):
                self.ends[t[k:]] = ranks.get(t[k:], -1)
        self._pairs: dict[int, bool] = {}
        self._memo: dict[str, tuple[int, ...]] = {}

    @classmethod
    def parse(cls, data: bytes) -> Vocabulary:
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())})

    def merged(self, data: bytes) -> list[int]:
        """BPE by its definition, merging the pair of lowest rank until none is left; for short inputs."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((self.ranks.get(parts[i] + parts[i + 1], self.width), i) for i in range(len(parts) - 1))
            if best[0] == self.width:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` may stand after ``last``; -1 stands for the start of a piece."""
        key = (last + 1) * self.width + token
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= MEMO * 8:
                self._pairs.clear()
            both = [token] if last < 0 else [last, token]
            known = self._pairs[key] = self.merged(b"".join(self.bytes_of[t] for t in both)) == both
        return known

    def extend(self, data: bytes, last: list[int]) -> None:
        """Continue ``last``, the last token of each prefix of ``data``, from the length it has to all of ``data``."""
        ends, follows = self.ends, self.follows
        for i in range(len(last) + 1, len(data) + 1):
            for k in range(i - 1, -1, -1):
                token = ends.get(data[k:i])
                if token is None:
                    raise ValueError("no valid token ends here; the vocabulary lacks single bytes")
                if token >= 0 and follows(last[k - 1] if k else -1, token):
                    last.append(token)
                    break
            else:
                raise ValueError("no valid token ends here")

    def ids(self, last: list[int]) -> list[int]:
        out, i = [], len(last)
        while i:
            out.append(last[i - 1])
            i -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def piece(self, text: str) -> tuple[int, ...]:
        known = self._memo.get(text)
        if known is None:
            last: list[int] = []
            self.extend(text.encode(), last)
            known = tuple(self.ids(last))
            if len(text) <= MEMO_CHARS:
                if len(self._memo) >= MEMO:
                    self._memo.clear()
                self._memo[text] = known
        return known

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for p in _SPLIT.findall(text):
            out.extend(self.piece(p))
        return out


_SPLIT = regex.compile(PATTERN)


class Encoding:
    """A text with the prefix tables of its pieces: appends and edits encode again only what they touch."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text = vocabulary, ""
        self.pieces: list[tuple[int, int, list[int]]] = []  # start, end, last token of each byte prefix
        self.append(text)

    def _table(self, piece: str, old: tuple[str, list[int]] | None) -> list[int]:
        last: list[int] = []
        data = piece.encode()
        if old and piece.startswith(old[0]):
            last = list(old[1])
        self.vocabulary.extend(data, last)
        return last

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of ``text[start:end]``."""
        text = self.text[:start] + new + self.text[end:]
        keep = 0
        while keep < len(self.pieces) and self.pieces[keep][1] + LOOKAHEAD <= start:
            keep += 1
        at = self.pieces[keep - 1][1] if keep else 0
        shift = len(new) - (end - start)
        later = {p[0] + shift: i for i, p in enumerate(self.pieces) if p[0] >= end}
        old = {p[0]: (self.text[p[0] : p[1]], p[2]) for p in self.pieces[keep:] if p[0] <= start}
        done = self.pieces[:keep]
        rest: list[tuple[int, int, list[int]]] = []
        while at < len(text):
            if at >= start + len(new) and at in later:  # from here on the split is the old one
                rest = [(a + shift, b + shift, t) for a, b, t in self.pieces[later[at] :]]
                break
            m = _SPLIT.match(text, at)
            done.append((at, m.end(), self._table(m.group(), old.get(at))))
            at = m.end()
        self.text, self.pieces = text, done + rest

    def ids(self) -> list[int]:
        return [i for _, _, last in self.pieces for i in self.vocabulary.ids(last)]


_LOADED: dict[int, Vocabulary] = {}


def _vocabulary(data: bytes) -> Vocabulary:
    """One per Python worker, kept from task to task."""
    key = hash(data)
    if key not in _LOADED:
        _LOADED[key] = Vocabulary.parse(data)
    return _LOADED[key]


def encode_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the token ids of each text, without special tokens, the texts as they are stored.

    An empty and a null text have an empty list. Rows with a null id and repeated rows come out like any others; an
    empty table gives an empty result; other columns aren't read. The strings of special tokens are ordinary text.
    Texts of any length are encoded whole, in time proportional to their length.

    The vocabulary file is read on the driver and broadcast; its size is that of the file, checked to be under 16 MB.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as f:
        data = f.read()
    if len(data) > 16 << 20:
        raise ValueError("the vocabulary is too large to broadcast")
    shared = spark.sparkContext.broadcast(data)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                cut = b.slice(at, 512)
                ids = [v.encode(t) if t else [] for t in cut.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    picked = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id")
    return picked.mapInArrow(encode, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids array<int>")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))
