"""Texts that were decoded with the wrong encoding: learn from twins what went wrong, then find and undo it elsewhere.

1. Stretches. One pass over the documents gives the distinct words and pairs of words that aren't all ASCII, with the
   number of documents that hold them. All but the last step works on these, so a word costs the same however often
   it is written.
2. Twins. Stretches are joined on what is left of them without non-ASCII characters, each with the most frequent form of
   its group; words are also joined, each with all others, on the bytes that one is written in and the other was read from.
3. Alignment. Between the ASCII characters that a pair of twins shares, the runs of other characters are aligned. A
   transformation "bytes of A read as B" explains the pair if it turns the clean runs into the garbled ones, exactly.
   Most pairs have several explanations, so transformations are taken greedily, each for the pairs that those before it
   leave unexplained, as long as there are enough of these. Only transformations found so are ever tried.
4. Application. They are undone on every distinct word. A word counts as garbled if undoing gives much likelier text
   than it has now; likelihood is that of pairs of neighbouring characters. So that garbled text doesn't vouch for
   itself, words that could be garbled by the counts over the distinct texts are left out of the counts over all documents.
   Characters that a learned way of reading makes of bytes it can't read count by themselves: there is nothing to undo;
   such a word is restored from a clean twin that a learned transformation turns into just it.
5. The garbled words are joined back to the documents that hold them.
"""

from __future__ import annotations

import codecs
import hashlib
import math
import unicodedata
import zlib
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.operators.arrays import flat, list_array
from linkloom.runtime import partitions, ship, spread, stage, table

#: What text may have been written in, and what it may have been read as. Alignment decides among them.
WRITTEN = ("utf-8", "cp1252", "cp1250", "cp1251", "koi8-r", "cp866", "mac_roman", "cp437", "cp850", "cp932", "euc_jp", "gbk", "big5", "cp949", "iso8859-5", "iso8859-2", "mac_cyrillic")
READ = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859-2", "iso8859-5", "iso8859-15", "koi8-r", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp852", "cp866", "gbk", "cp932", "euc_jp", "big5", "cp949", "utf-8")
#: Distinct pairs of twins that must show a transformation and nothing before it: this many, and this share of all pairs that have an explanation.
LEAST_PAIRS, LEAST_PAIR_SHARE = 2, 0.0005
#: ASCII letters and digits that words with the same bytes share, or these and bytes beyond ASCII: shorter ones meet by chance.
LEAST_ASCII, LEAST_BYTES = 4, 6
#: Bits of the hash of a pair of characters. Tables hold the pairs that occur, 12 bytes each, so this bounds what is broadcast.
SLOT_BITS = 24
#: Bits of the table of garbled words' hashes, one bit a slot, which is broadcast: 8 MB.
WORD_BITS = 26
#: Least hashes of texts that are kept of a word to count its distinct texts.
TEXTS = 32
#: Distinct stretches that a task holds before it passes them on.
HELD = 1 << 18
#: Log likelihood that undoing must gain, and what an unseen pair of characters counts as.
LEAST_GAIN, UNSEEN = 9.0, 0.1
#: What an origin that UTF-8 explains to the last byte has in advance of others that are enough of a gain, as chance hardly makes such bytes.
STRICT = 6.0
#: How much a pair counts that chance alone would bring together; of undone text, the share of the usual count of its
#: block's characters that each of its characters must have, and the share of its pairs that may be unseen.
BACK_OFF, LEAST_SHARE, MOST_UNSEEN = 0.02, 0.001, 0.25
#: Parts into which the documents of one garbled word are split.
SALTS = 16

#: Words end at blanks, no-break spaces among ASCII characters included; elsewhere these may be the remains of a letter.
_WORD = regex.compile(r"(?:[^ \t\r\n\xa0]|(?<=[^\x00-\x7f])\xa0|\xa0(?=[^\x00-\x7f\xa0]))+")
_RUN = regex.compile(r"[^\x00-\x7f]+")
_CONTROL = regex.compile(r"[\x00-\x1f]")
#: The sign that stands for bytes that couldn't be read, whatever the encoding.
REPLACED = "\ufffd"


_TABLES: dict[str, tuple[str, dict[int, int]]] = {}


def _table(codec: str) -> tuple[str, dict[int, int]]:
    """Of a Windows code page, the characters of all bytes and the bytes of these characters; undefined bytes pass as control characters, as careless readers have it."""
    got = _TABLES.get(codec)
    if got is None:
        chars = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256))
        got = _TABLES[codec] = (chars, {ord(c): b for b, c in enumerate(chars)})
    return got


def read_as(data: bytes, codec: str) -> str:
    """Decode as careless readers do; what can't be decoded is replaced."""
    if codec.startswith("cp125"):
        return codecs.charmap_decode(data, "replace", _table(codec)[0])[0]
    return data.decode(codec, "replace")


def bytes_read(text: str, codec: str) -> bytes | None:
    """The bytes that :func:`read_as` makes ``text`` of; None if there are none."""
    try:
        if codec.startswith("cp125"):
            return codecs.charmap_encode(text, "strict", _table(codec)[1])[0]
        return text.encode(codec)
    except UnicodeEncodeError:
        return None


def garble(text: str, written: str, read: str) -> str | None:
    """``text`` written in one encoding and read in another; None if it can't be written so."""
    try:
        return read_as(text.encode(written), read)
    except UnicodeEncodeError:
        return None


def undo(text: str, written: str, read: str) -> str | None:
    """The text that reads as ``text`` by this mistake; None if there is none."""
    data = bytes_read(text, read)
    if data is None:
        return None
    try:
        out = data.decode(written)
    except UnicodeDecodeError:
        return None
    return out if out != text else None


def spoilt_by(reads: list[str]) -> str:
    """The characters that these ways of reading make of bytes that mean nothing to them: control characters that no one writes, and the replacement character."""
    out = {REPLACED}
    for codec in reads:
        for b in range(0x80, 0x100):
            out |= {c for c in read_as(bytes([b]), codec) if unicodedata.category(c) == "Cc" and c > "\x7f" and c != "\x85"}
    return "".join(sorted(out))


def _slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a.astype(np.uint64) << np.uint64(21)) | b.astype(np.uint64)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _slot(a: int, b: int) -> int:
    return (((a << 21) | b) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - SLOT_BITS)


def _seen(text: str) -> np.ndarray:
    """The slots of the distinct characters beyond ASCII and of the pairs of neighbours with one of them. A character alone is a pair with NUL, which no text holds."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = (c[1:] > 127) | (c[:-1] > 127)
    signs = c[c > 127]
    return np.unique(np.concatenate([_slots(c[:-1][high], c[1:][high]), _slots(signs, np.zeros(len(signs), np.uint32))]))


def block_of(c: int) -> int:
    """The run of Unicode that a character is counted in: 128 code points, or all of the East Asian ones and what is above them."""
    return min(c, 0x2E80) >> 7


class Counts:
    """Sparse counts by slot, the number of units counted, and the greatest count of a character in each block."""

    def __init__(self, slots: np.ndarray, n: np.ndarray, units: int, tops: dict[int, int]):
        self.slots, self.n, self.units, self.tops = slots, n, max(1, units), tops

    def of(self, a: int, b: int) -> int:
        """The count, at most the number of units."""
        s = _slot(a, b)
        i = int(np.searchsorted(self.slots, s))
        return min(int(self.n[i]), self.units) if i < len(self.slots) and self.slots[i] == s else 0


def counted(words: DataFrame, units: int, weight: str, kept: Callable[[str, Undoer | None], str], first: Broadcast | None = None) -> Counts:
    """How often each character and pair of neighbours is found in ``kept`` of the words (form), each as often as the column ``weight`` says.

    Tasks sum up sparse arrays, which are
    summed by slot ranges in a distributed reduction; the driver gets one table, bounded by the number of slots.
    """
    shift = SLOT_BITS - 6

    def compact(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        s, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.zeros(len(s), np.int64)
        np.add.at(total, at, np.concatenate([p[1] for p in parts]))
        return s, total

    def batch(block: int, s: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        whole = np.array([0, len(s)])
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), list_array(s.astype(np.int64), whole), list_array(n, whole)], names=["block", "slots", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        tops: dict[int, int] = {}
        size = 0
        u = Undoer(*first.value) if first else None
        for b in batches:
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rest = kept(word, u)
                if rest.isascii():
                    continue
                s = _seen(f" {rest} ")
                for c in {ord(c) for c in rest if c > "\x7f"}:
                    tops[c] = tops.get(c, 0) + n
                held.append((s, np.full(len(s), n, np.int64)))
                size += len(s)
            if size > 1 << 20:
                held = [compact(held)]
                size = len(held[0][0])
        if held:
            s, n = compact(held)
            cuts = np.searchsorted(s, np.arange(65) << shift)
            for i in np.flatnonzero(np.diff(cuts)):
                yield batch(int(i), s[cuts[i] : cuts[i + 1]], n[cuts[i] : cuts[i + 1]])
        if tops:
            yield batch(64, np.array(list(tops)), np.array(list(tops.values())))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for i in range(b.num_rows):
                k = b.column(0)[i].as_py()
                part = (flat(b.column(1).slice(i, 1)), flat(b.column(2).slice(i, 1)))
                sums[k] = compact([sums[k], part]) if k in sums else part
        for k, (s, n) in sums.items():
            yield batch(k, s, n)

    kind = "block int, slots array<long>, n array<long>"
    got = {r[0]: (np.array(r[1], np.int64), np.array(r[2], np.int64)) for r in words.select("form", weight).mapInArrow(count, kind).repartition(min(64, partitions(words.sparkSession)), "block").mapInArrow(add, kind).collect()}
    tops: dict[int, int] = {}
    for c, n in zip(*got.pop(64, (np.zeros(0, np.int64),) * 2)):
        tops[block_of(int(c))] = max(tops.get(block_of(int(c)), 0), int(n))
    parts = [got[k] for k in sorted(got)]
    slots = np.concatenate([p[0] for p in parts]).astype(np.uint32) if parts else np.zeros(0, np.uint32)
    return Counts(slots, np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64), units, tops)


def _tokens(text: str) -> list[str]:
    return text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")


def _words(token: str) -> list[str]:
    """The words that aren't all ASCII in what stands between two blanks."""
    return [token] if "\xa0" not in token else [w for w in _WORD.findall(token) if not w.isascii()]


def distinct_of(mins: np.ndarray) -> int:
    """How many distinct hashes there are, by the least ``TEXTS`` of them: exact for fewer, about a sixth off otherwise."""
    if len(mins) < TEXTS:
        return len(mins)
    return max(TEXTS, int((TEXTS - 1) / ((float(mins[-1]) + 2.0**63) / 2.0**64)))


def stretches(docs: DataFrame) -> DataFrame:
    """(form, n, texts): the distinct words, and pairs of words, with some character that isn't ASCII; how many documents
    hold them, and of words in how many distinct texts they are.

    Pairs hold a blank, words don't. The empty form stands for all documents. Tasks sum up before the shuffle, so a
    stretch that a third of all documents hold is one row from each. Distinct texts are counted by the least hashes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        texts: dict[str, list[int]] = {}

        def rows() -> pa.RecordBatch:
            mins = [texts.get(x, ()) for x in held]
            return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64()), pa.array([sorted(m)[:TEXTS] for m in mins], pa.list_(pa.int64()))], names=["form", "n", "mins"])

        def saw(word: str, h: int) -> None:
            got = texts.get(word)
            if got is None:
                texts[word] = [h]
            elif len(got) < TEXTS:
                if h not in got:
                    insort(got, h)
            elif h < got[-1] and h not in got:
                got.pop()
                insort(got, h)

        for b in batches:
            for text, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[""] = held.get("", 0) + 1
                saw("", h)
                if text.isascii():
                    continue
                t = _tokens(text)
                words: set[str] = set()
                pairs: set[str] = set()
                for i, w in enumerate(t):
                    if not w.isascii():
                        words.update(_words(w))
                        if i:
                            pairs.add(f"{t[i - 1]} {w}")
                        if i + 1 < len(t):
                            pairs.add(f"{w} {t[i + 1]}")
                for x in words:
                    held[x] = held.get(x, 0) + 1
                    saw(x, h)
                for x in pairs:
                    held[x] = held.get(x, 0) + 1
                if len(held) > HELD:
                    yield rows()
                    held.clear()
                    texts.clear()
        yield rows()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, mins = None, 0, np.zeros(0, np.int64)
        for b in batches:
            forms, counts, lists = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            starts, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            out: list[tuple[str, int, int]] = []
            for i, form in enumerate(forms):
                own = values[starts[i] : starts[i + 1]]
                if form != now:
                    if now is not None:
                        out.append((now, n, min(n, distinct_of(mins))))
                    now, n, mins = form, counts[i], own
                else:
                    n += counts[i]
                    mins = np.union1d(mins, own)[:TEXTS]
            yield _form_rows(out)
        if now is not None:
            yield _form_rows([(now, n, min(n, distinct_of(mins)))])

    parts = docs.select("text", F.xxhash64("text").alias("h")).mapInArrow(count, "form string, n long, mins array<long>")
    return parts.repartition(partitions(docs.sparkSession), "form").sortWithinPartitions("form").mapInArrow(merge, "form string, n long, texts long")


def _form_rows(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["form", "n", "texts"])


def twins(forms: DataFrame, least_ascii: int = LEAST_ASCII) -> DataFrame:
    """(clean, other, weight) of stretches that are the same without their non-ASCII characters; ``clean`` is the most frequent form, ``weight`` how frequent.

    Each form is held against the one clean form of its group, so the work grows with the number of forms. Only here are
    twins found whose garbled form lost bytes; :func:`same_bytes` has all others.
    """
    keyed = forms.withColumn("bare", F.regexp_replace("form", r"[^\x00-\x7f]", ""))
    keyed = keyed.filter(F.length(F.regexp_replace("bare", "[^0-9A-Za-z]", "")) >= least_ascii)
    top = keyed.groupBy("bare").agg(F.max(F.struct("weight", F.col("form").alias("f"))).alias("top"), F.count("*").alias("forms")).filter("forms > 1").select("bare", F.col("top.f").alias("clean"), F.col("top.weight").alias("weight"))
    return keyed.drop("weight").join(top, "bare").filter("form <> clean").select("clean", F.col("form").alias("other"), "weight")


def same_bytes(forms: DataFrame) -> DataFrame:
    """(clean, other, weight): each word with each other word that some encoding reads from the bytes that some encoding writes it in, and is no more frequent.

    An encoding writes or reads only one word as given bytes, so a group has no more members than there are encodings.
    Both orders of a pair come out where both are possible. Groups are formed by a hash of the bytes, and alignment is exact.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys: list[int] = []
            words: list[str] = []
            sides: list[int] = []
            weights: list[int] = []
            for word, weight in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by: dict[bytes, int] = {}
                for codec in WRITTEN:
                    try:
                        data = word.encode(codec)
                    except UnicodeEncodeError:
                        continue
                    by[data] = by.get(data, 0) | 1
                for codec in READ:
                    data = bytes_read(word, codec)
                    if data is not None:
                        by[data] = by.get(data, 0) | 2
                letters = sum(c.isalnum() and c < "\x80" for c in word)
                for data, side in by.items():
                    if letters >= LEAST_ASCII or letters + sum(x > 127 for x in data) >= LEAST_BYTES:
                        keys.append(int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True))
                        words.append(word)
                        sides.append(side)
                        weights.append(weight)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.string()), pa.array(sides, pa.int32()), pa.array(weights, pa.int64())], names=["key", "word", "side", "weight"])

    words = forms.select("form", "weight").filter(~F.col("form").contains(" ")).repartition(partitions(forms.sparkSession))
    groups = words.mapInArrow(spell, "key long, word string, side int, weight long").groupBy("key").agg(F.collect_list(F.struct("word", "side", "weight")).alias("of")).filter(F.size("of") > 1)
    a = groups.select("of", F.explode("of").alias("a")).filter("a.side <> 2")
    pairs = a.select("a", F.explode("of").alias("b")).filter("b.side <> 1 and a.word <> b.word and a.weight >= b.weight")
    return pairs.select(F.col("a.word").alias("clean"), F.col("b.word").alias("other"), F.col("a.weight").alias("weight")).distinct()


def fewest(shown: list[tuple[list[int], int]], least: int, share: float) -> list[tuple[int, int]]:
    """(way, pairs) of the fewest ways, taken greedily, that explain the pairs of ``shown`` (ways that explain them, number of pairs).

    Each way must be the one explanation, beside those taken before it, of ``least`` pairs and of ``share`` of all. Of ways
    that explain as many, the one with the least number counts.
    """
    left = [(frozenset(ways), n) for ways, n in shown]
    bound = max(least, share * sum(n for _, n in left))
    taken: list[tuple[int, int]] = []
    while left:
        votes: dict[int, int] = {}
        for ways, n in left:
            for w in ways:
                votes[w] = votes.get(w, 0) + n
        best = min(votes, key=lambda w: (-votes[w], w))
        if votes[best] < bound:
            break
        taken.append((best, votes[best]))
        left = [x for x in left if best not in x[0]]
    return taken


def learned(forms: DataFrame, least: int = LEAST_PAIRS, share: float = LEAST_PAIR_SHARE) -> list[tuple[str, str]]:
    """(written, read) of the transformations that pairs of twins show, most shown first.

    What comes to the driver is the number of pairs for each set of transformations that explain a pair: as many rows as
    there are ways for encodings to agree, which is no matter of the corpus. The result is no longer than the product of
    the two lists of encodings.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, dict[str, frozenset[int]]] = {}

        def ways(text: str) -> dict[str, frozenset[int]]:
            """What ``text`` can turn into, and by which transformations."""
            got = memo.get(text)
            if got is None:
                if len(memo) > 1 << 14:
                    memo.clear()
                into: dict[str, set[int]] = {}
                for w, written in enumerate(WRITTEN):
                    try:
                        data = text.encode(written)
                    except UnicodeEncodeError:
                        continue
                    for r, read in enumerate(READ):
                        if read != written:
                            into.setdefault(read_as(data, read), set()).add(w * len(READ) + r)
                got = memo[text] = {k: frozenset(v) for k, v in into.items() if k != text}
            return got

        for b in batches:
            rows: list[tuple[str, int, list[int], str]] = []
            for clean, other, weight in zip(*(c.to_pylist() for c in b.columns)):
                x, z = _RUN.findall(clean), _RUN.findall(other)
                # runs are aligned between the ASCII characters; where some were swallowed or set free, whole stretches are
                changed = [(p, q) for p, q in zip(x, z) if p != q] if len(x) == len(z) else [(clean, other)]
                known: frozenset[int] | None = None
                for p, q in sorted(changed, key=lambda c: len(c[0])):
                    by = ways(p).get(q, frozenset())
                    known = by if known is None else known & by
                    if not known:
                        break
                if known:
                    rows += [(other, weight, sorted(known), f"{p}\u0000{q}") for p, q in changed]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.string()))], names=["other", "weight", "ways", "shown"])

    forms = forms.filter("form <> ''").select("form", F.when(F.col("texts") > 0, F.col("texts")).otherwise(F.col("n")).alias("weight"))
    found = twins(forms).unionByName(same_bytes(forms)).repartition(partitions(forms.sparkSession)).mapInArrow(align, "other string, weight long, ways array<int>, shown string")
    # of the twins of a garbled form the most frequent one is what was written; the others are mostly garbled themselves
    first = F.rank().over(Window.partitionBy("other").orderBy(F.col("weight").desc()))
    sets = found.withColumn("rank", first).filter("rank = 1").select("ways", "shown").distinct().groupBy("ways").count().collect()
    return [(WRITTEN[w // len(READ)], READ[w % len(READ)]) for w, _ in fewest([(r["ways"], r["count"]) for r in sets], least, share)]


class Undoer:
    """Finds garbled words with the learned transformations and the counts of character pairs."""

    def __init__(self, ways: list[tuple[str, str]], counts: Counts, clean: Counts | None = None):
        """``counts`` are those over the distinct texts, by which words are in doubt; ``clean`` those of all documents without such words."""
        self.ways: dict[str, list[str]] = {}  # by what it was read as, so that bytes are taken once
        for w, r in ways:
            self.ways.setdefault(r, []).append(w)
        self.spoilt = regex.compile(f"[{spoilt_by([r for _, r in ways])}]")
        self.counts = (counts, counts if clean is None else clean)
        self.pairs: tuple[dict[str, tuple[float, float, bool]], ...] = ({}, {})
        self.usual: tuple[tuple[set[str], set[str]], ...] = ((set(), set()), (set(), set()))

    def steps(self, text: str) -> Iterator[tuple[str, str]]:
        """(written, text) of each distinct text that ``text`` may have been; those written in UTF-8 under this name."""
        seen: dict[bytes, set[str]] = {}
        given = {text}
        for read, written in self.ways.items():
            data = bytes_read(text, read)
            if data is None:
                continue
            done = seen.setdefault(data, set())
            for w in written:
                if w in done:
                    continue
                done.add(w)
                try:
                    out = data.decode(w)
                except UnicodeDecodeError:
                    continue
                if out not in given or w == "utf-8" and out != text:
                    given.add(out)
                    yield w, out

    def _pair(self, pair: str, k: int) -> tuple[float, float, bool]:
        """Of two neighbouring characters, by the k-th counts: the log likelihood as they stand, without the document
        they are in; as what was written; whether they are seen anywhere. Pairs of frequent characters that chance could
        have kept apart count as a little seen when they stand in a text."""
        got = self.pairs[k].get(pair)
        if got is None:
            if len(self.pairs[k]) > 1 << 18:
                self.pairs[k].clear()
            a, b = (32 if c in "\t\r\n" else ord(c) for c in pair)
            if a < 128 and b < 128:
                got = (0.0, 0.0, True)
            else:
                n, docs = self.counts[k].of(a, b), self.counts[k].units
                share = [self.counts[k].of(c, 0) / docs if c > 127 else 1.0 for c in (a, b)]
                here = max(n - 1, 0) + BACK_OFF * docs * share[0] * share[1]
                got = (math.log((here + UNSEEN) / docs), math.log((n + UNSEEN) / docs), n > 0)
            self.pairs[k][pair] = got
        return got

    def _usual(self, text: str, k: int) -> bool:
        """Whether all characters of ``text`` are frequent enough, by the k-th counts, for it to have been written."""
        good, bad = self.usual[k]
        if not bad.isdisjoint(text):
            return False
        counts = self.counts[k]
        for char in set(text).difference(good):
            if char > "\x7f" and counts.of(ord(char), 0) < max(2, LEAST_SHARE * counts.tops.get(block_of(ord(char)), 0)):
                bad.add(char)
                return False
            good.add(char)
        return True

    def now(self, word: str, k: int = 1) -> float:
        """The log likelihood of ``word`` as it stands."""
        return sum(self._pair(word[i : i + 2], k)[0] for i in range(len(word) - 1))

    def then(self, word: str, floor: float, k: int = 1) -> float:
        """The log likelihood of ``word`` as what was written, if above ``floor``; of rare characters or too many unseen pairs it can't be made."""
        if not self._usual(word, k):
            return -math.inf
        total, high, unseen = 0.0, 0, 0
        for i in range(len(word) - 1):
            _, log, seen = self._pair(word[i : i + 2], k)
            if log:
                total += log
                if total <= floor:
                    return -math.inf
                high += 1
                unseen += not seen
        return total if unseen <= high * MOST_UNSEEN else -math.inf

    def origins(self, core: str) -> Iterator[tuple[str, bool, bool]]:
        """(text, strict, plain) of what ``core`` may have been; strict if all its bytes are UTF-8, which text of another encoding hardly is by chance; plain if nothing else is needed to explain it."""
        for w, out in self.steps(core):
            strict = w == "utf-8"
            more = [(out, strict)]
            if strict:  # garbled twice or more
                more += [(x, v == "utf-8") for v, x in self.steps(out)]
            for x, plain in more:
                if x == core or self.spoilt.search(x) and x is not out or _CONTROL.search(x):
                    continue
                yield x, strict, plain

    def doubtful(self, word: str) -> bool:
        """Whether ``word``, with the signs around it at its ends, could be garbled: some origin is likelier, however little, or strict. Too little evidence is no doubt."""
        now = self.now(word, 0)
        return self._telling(word) and any(self.then(word[0] + x + word[-1], -math.inf if strict else now, 0) > -math.inf for x, strict, _ in self.origins(word[1:-1]))

    def undoubted(self, word: str) -> str:
        """``word`` without the runs that could be garbled; nothing if it could be as a whole."""
        if self.doubtful(f" {word} "):
            return ""
        out, at = [], 0
        for a, z, signs in self._runs(word):
            if self.doubtful(signs):
                out += [word[at:a], " "]
                at = z
        return "".join(out) + word[at:]

    @staticmethod
    def _telling(word: str) -> bool:
        """Whether ``word`` has two signs beyond ASCII, or three letters beside one."""
        return len(word.encode("ascii", "ignore")) < len(word) - 1 or sum(c.isalpha() and c < "\x80" for c in word) >= 3

    @staticmethod
    def _runs(word: str) -> Iterator[tuple[int, int, str]]:
        """(from, to, signs) of the runs within a word, with the signs around them."""
        for r in _RUN.finditer(word):
            a, z = r.span()
            if z - a < len(word):
                yield a, z, (word[a - 1] if a else " ") + r.group() + (word[z] if z < len(word) else " ")

    def best(self, word: str) -> tuple[float, str] | None:
        """(advance, text) of the likeliest way to undo ``word``, if it gains enough. ``word`` has the signs around it at its ends."""
        left, core, right = word[0], word[1:-1], word[-1]
        now, among = self.now(word), self.now(word, 0)
        got: tuple[float, str] | None = None
        if now < -LEAST_GAIN:
            for x, strict, plain in self.origins(core):
                gain = self.then(left + x + right, now + LEAST_GAIN) - now
                ahead = gain + STRICT * plain
                if gain > LEAST_GAIN and (got is None or ahead > got[0]) and (strict or self.then(left + x + right, among, 0) > -math.inf):
                    got = (ahead, x)
        return got

    def judged(self, word: str) -> tuple[bool, bool, str]:
        """(garbled, sure, text) of a word: whether it is garbled, whether it is enough evidence by itself, and what it was.

        A word of one sign with hardly a letter beside it is too little evidence: it is undone where others in the text
        are garbled, and otherwise left.
        """
        spoilt = self.spoilt.search(word) is not None
        sure = spoilt or self._telling(word)
        got = self.best(f" {word} ")
        if got:
            return True, sure, got[1]
        out, at, hit = [], 0, spoilt
        for a, z, signs in self._runs(word):
            got = self.best(signs)
            if got:
                hit = True
                out += [word[at:a], got[1]]
                at = z
        return hit, sure, "".join(out) + word[at:]


def garbled_words(live: DataFrame) -> DataFrame:
    """(form, sure, new) of the distinct garbled words of ``live`` (text), by the transformations that its twins show."""
    spark = live.sparkSession
    forms = stage(stretches(live), "stretches")
    docs, texts = (forms.filter("form = ''").select("n", "texts").first() or (0, 0))
    ways = learned(forms)
    words = stage(forms.filter("form <> ''").filter(~F.col("form").contains(" ")).repartition(partitions(spark), "form"), "words")
    first = spark.sparkContext.broadcast((ways, counted(words, texts, "texts", lambda w, u: w)))
    shared = spark.sparkContext.broadcast((*first.value, counted(words, docs, "n", lambda w, u: u.undoubted(w), first)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = Undoer(*shared.value)
        for b in batches:
            rows = [(w, *got[1:]) for w in b.column(0).to_pylist() if (got := u.judged(w))[0]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.string())], names=["form", "sure", "new"])

    judged = words.select("form").mapInArrow(judge, "form string, sure boolean, new string")
    return stage(judged.join(from_twins(forms, ways), "form", "left").select("form", "sure", F.coalesce("clean", "new").alias("new")), "garbled")


def from_twins(forms: DataFrame, ways: list[tuple[str, str]]) -> DataFrame:
    """(form, clean) of the words that lost bytes, so that nothing can be undone, but whose clean twin becomes just them by a learned transformation."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            rows = [(other, clean) for clean, other in pairs if any(garble(clean, w, r) == other for w, r in ways)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["form", "clean"])

    words = forms.filter("form <> ''").filter(~F.col("form").contains(" ")).withColumn("bare", F.regexp_replace("form", r"[^\x00-\x7f]", ""))
    words = words.filter(F.length(F.regexp_replace("bare", "[^0-9A-Za-z]", "")) >= LEAST_ASCII)
    lost = F.col("form").contains(REPLACED)
    whole = words.filter(~lost).groupBy("bare").agg(F.max_by("form", F.struct("texts", "form")).alias("clean"))
    return words.filter(lost).select("bare", F.col("form").alias("other")).join(whole, "bare").select("clean", "other").mapInArrow(align, "form string, clean string")


def _word_slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << WORD_BITS) - 1)


def _bitmap(words: DataFrame) -> np.ndarray:
    """One bit for the hash of each word (form), packed. Pages of it are put together by a distributed reduction; the driver gets the one table of fixed size."""
    page = 1 << (WORD_BITS - 9)  # bytes: 64 pages

    def pages(slots: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in np.unique(slots >> (WORD_BITS - 6)):
            bits = np.zeros(page * 8, np.uint8)
            bits[slots[slots >> (WORD_BITS - 6) == i] & (page * 8 - 1)] = 1
            yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["page", "bits"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = [np.fromiter((_word_slot(w) for w in b.column(0).to_pylist()), np.int64, b.num_rows) for b in batches]
        if slots:
            yield from pages(np.unique(np.concatenate(slots)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = np.frombuffer(bits, np.uint8)
                held[i] = held[i] | got if i in held else got
        for i, got in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([got.tobytes()], pa.binary())], names=["page", "bits"])

    kind = "page int, bits binary"
    out = np.zeros(page * 64, np.uint8)
    for r in words.select("form").mapInArrow(mark, kind).repartition(min(64, partitions(words.sparkSession)), "page").mapInArrow(merge, kind).toLocalIterator():
        out[r[0] * page : (r[0] + 1) * page] = np.frombuffer(r[1], np.uint8)
    return out


def damaged(live: DataFrame, garbled: DataFrame) -> DataFrame:
    """(doc_id, form, sure, new): the garbled words of each document, each once.

    Documents are read once more; a table of hashes lets through hardly any word but the garbled ones, which alone are
    joined. The documents of a word are salted, as one word may be in a third of them.
    """
    spark = live.sparkSession
    bits = spark.sparkContext.broadcast(_bitmap(garbled))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for b in batches:
            ids: list[int] = []
            forms: list[str] = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text.isascii():
                    continue
                for token in {t for t in _tokens(text) if not t.isascii()}:
                    for w in _words(token):
                        hit = known.get(w)
                        if hit is None:
                            if len(known) > HELD:
                                known.clear()
                            s = _word_slot(w)
                            hit = known[w] = bool(bits.value[s >> 3] >> (7 - (s & 7)) & 1)
                        if hit:
                            ids.append(i)
                            forms.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forms, pa.string())], names=["doc_id", "form"])

    found = live.select("doc_id", "text").mapInArrow(search, "doc_id long, form string").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    salted = garbled.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.join(salted, ["form", "salt"]).select("doc_id", "form", "sure", "new")


def _live(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return spread(docs.select("doc_id", "text").filter("doc_id is not null and text is not null and text <> ''"), "doc_id")


def damaged_documents(docs: DataFrame) -> DataFrame:
    """(doc_id) of the documents with a garbled word, once each. For what counts and what doesn't see :func:`repaired_texts`."""
    live = _live(docs)
    return damaged(live, garbled_words(live)).filter("sure").select("doc_id").distinct()


def repaired_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_garbled, text) of the documents in which a garbled word is found, with these words restored where they can be.

    Null ids, null, empty, blank and ASCII texts give no row. Repeated rows come out as often as they are there. Texts
    are read whole. Other columns aren't read; an empty table gives an empty result. What is broadcast is two tables of
    counts of character pairs, a table of hashes and the list of transformations, all of bounded size. A document that
    holds only words of one sign with hardly a letter beside it, garbled or not, isn't taken as garbled.
    """
    live = _live(docs)
    fixes = damaged(live, garbled_words(live)).groupBy("doc_id").agg(F.max("sure").alias("sure"), F.collect_set(F.struct("form", "sure", "new")).alias("fixes")).filter("sure").select("doc_id", "fixes")

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, int, str]] = []
            for i, text, fixes in zip(*(c.to_pylist() for c in b.columns)):
                by = {f["form"]: f for f in fixes}
                n = sure = 0

                def new(m: regex.Match) -> str:
                    nonlocal n, sure
                    f = by.get(m.group())
                    if f is None:
                        return m.group()
                    n += 1
                    sure += f["sure"]
                    return f["new"]

                text = _WORD.sub(new, text)
                if sure:
                    rows.append((i, n, text))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "n_garbled", "text"])

    return live.join(fixes, "doc_id").select("doc_id", "text", "fixes").mapInArrow(mend, "doc_id long, n_garbled long, text string")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_documents(table(spark, sf_dir, "documents"))


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled documents with their text restored where possible."""
    return repaired_texts(table(spark, sf_dir, "documents"))
