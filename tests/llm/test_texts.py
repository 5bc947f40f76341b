"""Look-alikes, token encoding, leakage and repair of wrongly decoded text."""

import base64
import random
import re
import unicodedata

import numpy as np
import pytest
import tiktoken

from linkloom.llm import leakage as L
from linkloom.llm import lookalikes as A
from linkloom.llm import mojibake as M
from linkloom.llm import tokens as K

NODE = "id long, type string, name string, path string, seen_at timestamp, value string"
EDGE = "id long, dst_key string, raw_link string, space string"


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Ａbc", "Abc", True), ("é", "é", True), ("ｶﾞ", "ガ", True), ("ﬁn", "fin", True), ("a​b", "ab", True), ("a b", "a b", True), ("a‑b", "a-b", True),
        ("аbс", "abc", True), ("ё", "ë", True), ("ǘ", "ǘ", True), ("ệ", "ệ", True), ("Abc", "abc", False), ("e", "é", False),
        ("x²", "x2", False), ("l", "I", False), ("ß", "ss", False), ("は", "ハ", False),
        ("й", "и\u0306", True), ("ベ", "へ\u3099", True), ("ｶﾞ", "力\u3099", True), ("ﺐ", "ب", True), ("ά", "á", True), ("x²", "х²", True), ("σ", "o", False), ("ด", "ค", False), ("І", "l", False),
    ],
)
def test_look(spark, a, b, same):
    nodes = spark.createDataFrame([(1, "note", "x", a, None, ""), (2, "note", "y", b, None, "")], NODE)
    got = A.look_alike_cases(nodes, spark.createDataFrame([], EDGE)).filter("field_name = 'path'").collect()
    assert [tuple(r) for r in got] == ([("path", 1, 2)] if same and a != b else [])


def test_letters_of_many_scripts(spark):
    letters = A.letters_by_rule(spark)
    for pair in ("аa", "оo", "ΡP", "ρp", "υu", "օo", "ᎪA", "ⲞO", "ꓐB", "ⵔO", "סo", "力カ", "ჿo", "𐐬o"):
        assert letters[pair[0]] == pair[1]
    fixed = {c for old, _ in A.LOOK_ALIKE for c in old}
    assert all(c.lower() == c or to.lower() != to or not to.isascii() for c, to in letters.items())  # capitals stay capitals
    tests = [A.regex.compile(rf"\p{{Script={n}}}") for n in A._SCRIPTS]
    seen = set()
    for c, to in letters.items():  # letters of one script stay apart
        if c not in fixed:
            own = next((k for k, t in enumerate(tests) if t.match(c)), None)
            assert own is None or (own, to) not in seen
            seen.add((own, to))
    assert not any(c in letters for c in "0123456789lIоο"[:12])


def test_look_alike_cases(spark):
    nodes = spark.createDataFrame(
        [
            (1, "note", "Café", "d/Café.md", None, ""), (2, "note", "Cafe\u0301", "d/Cafe\u0301.md", None, ""), (3, "asset", "d/Café.md", "d/Café.md", None, ""),
            (4, "tag", "#x", None, None, ""), (5, "tag", "#х", None, None, ""), (6, "phantom", "#x", None, None, ""), (7, "note", None, None, None, ""), (None, "note", "q", "q", None, ""),
            (1, "note", "Café", "d/Café.md", None, ""),
        ],
        NODE,
    )
    edges = spark.createDataFrame(
        [(10, "phantom:name:c", "[[Сafé|x]]", ""), (10, "phantom:name:c", "[[Сafé|x]]", ""), (11, "phantom:name:c", "[t](d/Café.md#h)", ""), (12, "note:path:z", "[[Café]]", ""), (13, "phantom:name:c", None, ""), (None, "phantom:name:c", "[[Café]]", ""), (14, None, "[[Café]]", ""), (15, "phantom:name:c", "[[cafe]]", "")],
        EDGE,
    )
    got = sorted(tuple(r) for r in A.look_alike_cases(nodes, edges).collect())
    assert got == [("name", 4, 5), ("path", 1, 2), ("raw_link", 10, 1), ("raw_link", 10, 2), ("raw_link", 11, 1), ("raw_link", 11, 2)]
    assert A.look_alike_cases(nodes.limit(0), edges.limit(0)).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    with open(K.VOCABULARY, "rb") as f:
        return K.Vocabulary.parse(f.read())


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_encoding(vocabulary, reference):
    rng = random.Random(1)
    alphabet = "ab' sretvlmdXYZ\n\t12é　の🙂.,!-<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["<|endoftext|>", "a" * 5000, " " * 300 + "x", "\r\n", "﻿#"]
    for t in texts:
        assert vocabulary.encode(t) == reference.encode_ordinary(t)


def test_appends_and_edits(vocabulary, reference):
    rng = random.Random(9)
    alphabet = "ab' srevlm\n12é の"
    for _ in range(300):
        e = K.Encoding(vocabulary, "".join(rng.choice(alphabet) for _ in range(20)))
        for _ in range(4):
            i = rng.randint(0, len(e.text))
            e.replace(i, min(len(e.text), i + rng.randint(0, 4)), "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 4))))
            assert e.ids() == reference.encode_ordinary(e.text)
            e.append(rng.choice(alphabet))
            assert e.ids() == reference.encode_ordinary(e.text)


def test_prefix_tables(vocabulary):
    last: list[int] = []
    vocabulary.extend(b"unbelievably", last)
    for k in range(1, 13):
        assert vocabulary.ids(last[:k]) == vocabulary.merged(b"unbelievably"[:k])


def test_encode_texts(spark, reference):
    rows = [(1, "Grüße, 世界", "z"), (2, "", "z"), (3, None, "z"), (None, "x", "z"), (1, "Grüße, 世界", "z")]
    got = [(r.doc_id, r.ids) for r in K.encode_texts(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()]
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(got, key=key) == sorted([(i, reference.encode_ordinary(t) if t else []) for i, t, _ in rows], key=key)
    assert K.encode_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, 400)
    order = L.suffix_array(x, 400)
    suffixes = [tuple(x[i:]) for i in order]
    assert suffixes == sorted(suffixes)


def brute(docs, items, least):
    out = {}
    for d, t in docs:
        for i, u in items:
            a, b = re.findall(r"[^\W_]+", (t or "").lower()), re.findall(r"[^\W_]+", (u or "").lower())
            best = 0
            for p in range(len(b)):
                for q in range(len(a)):
                    k = 0
                    while p + k < len(b) and q + k < len(a) and b[p + k] == a[q + k]:
                        k += 1
                    best = max(best, k)
            if best >= least and d is not None and i is not None:
                out[i, d] = best
    return out


def test_leaks(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "C", "dé", "1"])
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 12)))) for i in range(6)] + [(6, None), (7, ""), (8, "a"), (None, "a b a b a")]
    items.append((9, items[0][1]))
    docs = [(d, "".join(word() + rng.choice([" ", "-", "\n", "**", " · "]) for _ in range(rng.randint(0, 60)))) for d in range(12)] + [(12, None), (13, ""), (14, items[0][1].upper() + "!")]
    docs += [(None, items[0][1]), docs[0]]
    want = brute(docs, items, 4)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for shard in (10**6, 25):  # the latter cuts most documents into windows
        got = {(r.item_id, r.doc_id): r.n_words for r in L.leaked_passages(d, i, 4, shard).collect()}
        assert got == want
    kept = sorted(r.doc_id for r in L.without_leaks(d, i, 4).filter("doc_id is not null").collect())
    assert kept == sorted(x for x, _ in docs if x is not None and x not in {b for _, b in want})
    assert L.leaked_passages(d.limit(0), i, 4).count() == 0 and L.leaked_passages(d, i.limit(0), 4).count() == 0


def test_leaks_in_chunks_and_slices(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: rng.choice("ab")
    items = [(i, " ".join(word() for _ in range(rng.randint(4, 20)))) for i in range(8)] + [(8, "a " * 30)]
    docs = [(d, " ".join(word() for _ in range(rng.randint(0, 50)))) for d in range(10)] + [(10, "a " * 80), (11, "b a " * 40)]
    want = brute(docs, items, 4)
    monkeypatch.setattr(L, "SLICE", 7)
    monkeypatch.setattr(L, "BLOCK", 5)
    index = L.EvalIndex(items, 4)
    found = index.matches([d for d, _ in docs], [L.words(t) for _, t in docs], [0] * len(docs))
    assert {(int(i), int(d)): int(n) for i, d, n, *_ in zip(*found)} == want
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.item_id, r.doc_id): r.n_words for r in L.leaked_passages(d, i, 4, chunk_bytes=60).collect()}  # several passes
    assert got == want


def test_leaks_of_one_word_repeated():
    index = L.EvalIndex([(1, "a " * 300), (2, "b c " * 200)], 12)
    texts = [["a"] * 200_000, ["b", "c"] * 100_000, ["a"] * 11]
    found = index.matches([1, 2, 3], texts, [0, 0, 0])
    assert [tuple(map(int, x[:3])) for x in zip(*found)] == [(1, 1, 300), (2, 2, 400)]
    assert sum(len(at) for at, _ in _all_pairs(index, texts)) < 500_000  # not words times words


def _all_pairs(index, texts):
    flat = [x for t in texts for x in t]
    number = {x: i for i, x in enumerate(dict.fromkeys(flat))}
    codes = np.array([number[x] for x in flat])
    mine = np.array([number.get(index.vocabulary[w], -1) for w in index.words])
    order = L.suffix_array(codes, index.depth)
    padded = np.append(codes, np.full(index.depth, -2))
    lo, hi = L.ranges(padded, order, mine[index.starts[:, None] + np.arange(index.least)])
    return index._pairs(index.starts[hi > lo], lo[hi > lo], hi[hi > lo], order, np.append(-3, codes[:-1]), mine)


CLEAN = [
    "The façade’s gravel near the café cost 20 € — “quite” a sum for {n}.", "Später müssen wir die Küche und die Größe {n} prüfen.", "Según {n}, el jardín y la montaña están en otoño.",
    "Почему книга учёта {n} не готова вчера вечером.", "Les élèves de {n} préfèrent la forêt où naît l’été.", "次の作業は図書の目録 {n} のリンクを直すことです。",
]


def test_repair(spark):
    names = ["Astor", "Belim", "Corvan", "Delmar", "Evist", "Fornel"]
    docs = [(i, CLEAN[i % 6].format(n=names[(i // 6) % 6])) for i in range(240)]
    ways = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("cp1252", "mac_roman"), ("utf-8", "cp1251")]
    bad = {}
    for k, (w, r) in enumerate(ways):
        for j in (0, 1, 2, 4):
            i = 1000 + k * 10 + j
            bad[i] = CLEAN[j].format(n=names[k])
            docs.append((i, M.garble(bad[i], w, r)))
    docs += [(2000, "R�sum�"), (2001, None), (2002, ""), (2003, "plain"), (None, "cafÃ©"), (2004, "ATENÇÃO: NÃO MOVER"), (2005, "ｶﾞｲﾄﾞ naïve ½ α → β"), (2006, "x y")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_garbled string")
    got = {r.doc_id: r.text for r in M.repaired_texts(df).collect()}
    assert set(got) == {*bad, 2000}
    assert sum(got[i] == t for i, t in bad.items()) >= 0.8 * len(bad)
    assert M.repaired_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [True, False])
@pytest.mark.parametrize("way", [("utf-8", "cp1252"), ("cp1252", "mac_roman")])
def test_garbled_text_does_not_vouch_for_itself(spark, monkeypatch, copies, way):
    monkeypatch.setattr(M, "learned", lambda docs: [way])
    docs = [(i, f"{CLEAN[i % 5]} {i}".replace("{n}", "Astor")) for i in range(400)]
    bad = [(1000 + i, M.garble(f"{CLEAN[4 if copies else (1, 2, 4)[i % 3]]} {0 if copies else i}", *way)) for i in range(200)]
    df = spark.createDataFrame(docs + bad, "doc_id long, text string")
    assert sorted(r.doc_id for r in M.repaired_texts(df).collect()) == [i for i, _ in bad]


def test_every_form_is_aligned(spark):
    words = ["карточка", "почтовый", "вечером"]
    garbled = [M.garble(w, "cp1251", "koi8-r") for w in words]
    texts = [w for w in words] + [g for g in garbled for _ in range(3)] + ["überall écrit"] * 5  # no ASCII letter, and the garbled form is the frequent one
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert ("cp1251", "koi8-r") in M.learned(M.stretches(docs))


def test_codecs():
    for codec in M.READ:
        data = bytes(range(256)) if not codec.startswith(("gbk", "cp9", "euc", "big", "utf")) else "漢字 é".encode(codec if codec in ("utf-8", "gbk", "big5") else "utf-8", "replace")
        text = M.read_as(data, codec)
        if "�" not in text:
            assert M.bytes_read(text, codec) == data
    assert M.undo(M.garble("naïve café", "utf-8", "cp1252"), "utf-8", "cp1252") == "naïve café"
    assert unicodedata.name(M.undo("Ã©", "utf-8", "latin-1")) == "LATIN SMALL LETTER E WITH ACUTE"
    assert base64.b64encode(M.bytes_read("\x9dÃ", "cp1252")) == b"ncM="


def test_fewest_ways():
    assert M.fewest([([1, 2], 5), ([2, 3], 4), ([3], 1), ([4], 2)], 2, 0.0) == [(2, 9), (4, 2)]
    assert M.fewest([([1], 1000), ([2], 2)], 2, 0.01) == [(1, 1000)]  # evidence in proportion to all there is
    assert M.fewest([], 2, 0.0) == []


def test_stretches_count_documents_and_texts(spark):
    docs = [(i, "é à\xa0b\té") for i in range(5)] + [(9, f"é{'x' * 3} 漢") for _ in range(2)] + [(10, "plain")] + [(20 + i, f"ß {i}") for i in range(200)]
    got = {r.form: (r.n, r.texts) for r in M.stretches(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got["é"] == (5, 1) and got["à\xa0b"] == (5, 1) and got["漢"] == (2, 1) and got["éxxx 漢"] == (2, 0)
    assert got[""][0] == 208 and got["ß"][0] == 200 and 100 < got["ß"][1] <= 200


def test_lost_bytes_are_restored_from_twins(spark):
    lost = M.garble("Schlüssel", "cp1252", "utf-8")
    docs = [(i, f"Der Schlüssel liegt unter der Matte {i}, die größte Küche") for i in range(20)] + [(100 + i, f"Der {lost} {M.garble('Küchentür größte', 'cp1252', 'utf-8')} {i}") for i in range(3)]
    docs += [(200 + i, "Küchentür größte") for i in range(4)]
    got = {r.doc_id: r.text for r in M.repaired_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {100 + i: f"Der Schlüssel Küchentür größte {i}" for i in range(3)}


def test_bitmap_and_long_words(spark):
    words = spark.createDataFrame([(f"é{i}",) for i in range(300)], "form string")
    bits = M._bitmap(words)
    slots = {M._word_slot(f"é{i}") for i in range(300)}
    assert int(np.unpackbits(bits).sum()) == len(slots) and all(bits[s >> 3] >> (7 - (s & 7)) & 1 for s in slots)
    long = "Größe " * 20_000 + "ungewÃ¶hnlich"
    docs = [(1, long), (1, long), (2, "é" * 100_000), (3, "​"), (4, "�")] + [(10 + i, f"Die Größe ist ungewöhnlich {i}") for i in range(50)] + [(100 + i, f"GrÃ¶Ã\x9fe ungewÃ¶hnlich {i}") for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in M.damaged_documents(df).collect()) == [1, 4, 100, 101, 102]
    assert sorted(r.doc_id for r in M.repaired_texts(df).collect()) == [1, 1, 4, 100, 101, 102]
