"""Texts that look the same but are stored differently.

Signs are first mapped to one look: no signs without ink, one kind of blank and hyphen, ordinary width, ligatures taken
apart, look-alike letters of other scripts as Latin ones. The mapped values are grouped in SQL under the UNICODE
collation, which takes canonically equal ways to store an accent as the same and tells apart accents, letter case and
raised digits. Each class has its least member as the canonical one, which is joined back to the members.
"""

from __future__ import annotations

import unicodedata

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.incremental import latest_rows
from linkloom.runtime import stage, table

#: Letters that a reader can't tell from a Latin one, each list followed by the Latin letters. Other letters
#: come from the rule in :func:`letters_by_rule`; these are what it misses, and the start of what it may not contradict.
LOOK_ALIKE = (
    ("АВЕКМНОРСТУХЅІЈԚԜҮӀ", "ABEKMHOPCTYXSIJQWYI"),  # Cyrillic capitals
    ("аеорсухѕіјһԁԛԝӏѵ", "aeopcyxsijhdqwlv"),  # Cyrillic
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),  # Greek capitals
    ("ονϲϳ", "ovcj"),  # Greek
    ("ՕՍօսհոցզ", "OUouhngq"),  # Armenian
    ("ɡɑ", "ga"),  # Latin letters of phonetics
)
#: Signs without ink: format controls and the fillers and selectors that aren't among them.
_NO_INK = r"[\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}]"
_BLANK = r"[\p{Z}\t\n\x{0B}\f\r\x{85}]"
_HYPHEN = r"[\x{2010}-\x{2012}\x{FE63}\x{FF0D}]"


#: Forms that stand for several signs, or for a letter by its place in a word: ligatures, digraphs, Hebrew and Arabic presentation forms.
_JOINED = r"\x{0132}\x{0133}\x{01C4}-\x{01CC}\x{01F1}-\x{01F3}\x{FB00}-\x{FB06}\x{FB13}-\x{FB17}\x{FB1D}-\x{FDFB}\x{FE70}-\x{FEFC}\x{FF9E}\x{FF9F}"
#: Left out of the search for look-alikes for their number: Han, Hangul and Tangut, which are no look-alikes of letters.
_MANY = ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0xF900, 0xFB00), (0x17000, 0x18D09), (0x20000, 0x110000))
_SCRIPTS = ("Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Cherokee", "Coptic", "Georgian", "Katakana", "Hiragana", "Lisu", "Tifinagh", "Deseret", "Canadian_Aboriginal", "Osage", "Warang_Citi")

#: Parts into which the links to one phantom are split, as a third of all may be to one.
SALTS = 8


def letters_by_rule(spark: SparkSession) -> dict[str, str]:
    """Letters of other scripts and the letter that each is confused with, by the skeletons of ICU's spoof checker, beside the fixed ones.

    A letter goes to the one ASCII letter of its case and skeleton; if no ASCII letter has its skeleton, to the letter of
    another script that is the skeleton. Letters of one script stay apart: of several that would become the same letter
    only the first does, after those that are fixed. Digits, signs and letters with accents aren't mapped: the latter
    follow from their base letter.
    """
    fixed = dict(pair for old, new in LOOK_ALIKE for pair in zip(old, new, strict=True))
    every = (chr(c) for a, b in zip((0x41, *(m[1] for m in _MANY)), (m[0] for m in _MANY)) for c in range(a, b))
    found = [c for c in every if unicodedata.category(c) in ("Lu", "Ll", "Lo") and unicodedata.normalize("NFD", c) == c]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeleton = dict(zip(found, checker.getSkeleton("\n".join(found)).split("\n"), strict=True))
    tests = [(n, regex.compile(rf"\p{{Script={n}}}")) for n in _SCRIPTS]
    script = lambda c: next((n for n, t in tests if t.match(c)), "")
    ascii_ = [c for c in found if c < "\x80"]
    used = {(script(c), to) for c, to in fixed.items()}
    out: dict[str, str] = {}
    for c, s in skeleton.items():
        own = script(c)
        if not own or own == "Latin" or c in fixed or len(s) != 1 or unicodedata.normalize("NFKC", c) != c:
            continue
        near, kind = [a for a in ascii_ if skeleton[a] == s], unicodedata.category(c)
        fits = [a for a in near if (a == s if kind == "Lo" else unicodedata.category(a) == kind)]
        to = fits[0] if len(fits) == 1 else s if not near and unicodedata.category(s) == kind and script(s) != own else None
        if to is not None and (own, to) not in used:
            used.add((own, to))
            if own == "Katakana":
                out[to] = c  # kana have voiced forms to be composed, so they stay
            else:
                out[c] = to
    return fixed | out


def _tables(letters: dict[str, str]) -> tuple[str, str]:
    """(from, to) of single signs without accents: width, and look-alike letters."""
    one: dict[str, str] = {}
    for cp in range(0xFF01, 0xFFEF):
        flat = unicodedata.normalize("NFKC", chr(cp))
        if flat != chr(cp) and len(flat) == 1 and cp not in (0xFF9E, 0xFF9F) and unicodedata.category(chr(cp)) not in ("Cf", "Cn"):
            one[chr(cp)] = flat
    one |= letters
    one = {c: one.get(x, x) for c, x in one.items()}
    return "".join(one), "".join(one.values())


def _icu(method: str, text: Column, flag: bool) -> Column:
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), text, F.lit(flag))


def with_look(rows: DataFrame, text: str, letters: dict[str, str]) -> DataFrame:
    """``rows`` with ``look``: the column ``text`` with every sign in the one form that stands for its look.

    Step by step, so that no step is worked out twice. ASCII texts need hardly any.
    """
    old, new = _tables(letters)
    look, high = F.col("look"), F.col("__high")
    rows = rows.withColumn("look", F.translate(F.col(text), "\t\n\x0b\f\r", "     ")).withColumn("__high", F.col(text).rlike(r"[^\x00-\x7F]"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(look, _NO_INK, ""), _BLANK, " "), _HYPHEN, "-")
    rows = rows.withColumn("look", F.when(high, plain).otherwise(look))
    # only the forms that join signs are taken apart by compatibility, as that would lower raised digits too
    parts = F.regexp_extract_all(look, F.lit(f"[{_JOINED}]+|[^{_JOINED}]+"), 0)
    apart = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"[{_JOINED}]"), _icu("decompose", p, True)).otherwise(p)), "")
    rows = rows.withColumn("look", F.when(high & look.rlike(f"[{_JOINED}]"), apart).otherwise(look))
    # letters are mapped without their accents, which are then put on again in canonical order
    mapped = _icu("compose", F.translate(_icu("decompose", look, False), old, new), False)
    return rows.withColumn("look", F.when(high, mapped).otherwise(look)).drop("__high")


def link_target(raw: Column) -> Column:
    """The target that a raw link names: before ``|`` in ``[[ ]]`` or inside ``( )``, cut at the first ``#``."""
    wiki = F.substring_index(F.regexp_extract(raw, r"(?s)\[\[(.*?)\]\]", 1), "|", 1)
    inner = F.when(raw.startswith("[["), wiki).otherwise(F.regexp_extract(raw, r"(?s)\]\((.*?)\)", 1))
    return F.substring_index(inner, "#", 1)


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"\.md\z", "")


def _forms(side: Column, look: Column) -> Column:
    """The looks under which a row of a side is known: a link's target without ``.md``, a note's text with and without, any other as it is."""
    return F.when(side == "link", F.array(_bare(look))).when(side == "note", F.array_distinct(F.array(look, _bare(look)))).otherwise(F.array(look))


def canonical_members(rows: DataFrame, across: str = "link") -> DataFrame:
    """Rows of (space, side, id, value) with ``canonical`` and ``look``, as far as their look joins them to another row.

    Within one ``space`` the rows whose values look the same form a class. Kept are classes with two different values,
    in the space ``across`` those with two different sides; ``canonical`` is the least value of the class in byte order. Null and empty
    values, and values without any ink, look like nothing. Repeated rows stay repeated. An empty table gives an empty
    result.
    """
    spark = rows.sparkSession
    looks = with_look(rows.select("space", "side", "id", "value"), "value", letters_by_rule(spark))
    looks = looks.withColumn("look", F.explode(_forms(F.col("side"), F.col("look")))).filter("trim(look) <> ''")
    looks = stage(looks, "looks")
    classes = spark.sql(
        """
        SELECT space, collate(look, 'UNICODE') AS class, min(value) AS canonical
        FROM {looks} GROUP BY space, collate(look, 'UNICODE')
        HAVING CASE WHEN space = {across} THEN min(side) <> max(side) ELSE min(value) <> max(value) END
        """,
        looks=looks,
        across=across,
    )
    return spark.sql(
        """
        SELECT l.space, l.side, l.id, l.value, c.canonical, CAST(c.class AS STRING COLLATE UTF8_BINARY) AS look
        FROM {looks} l JOIN {classes} c ON l.space = c.space AND collate(l.look, 'UNICODE') = c.class
        """,
        looks=looks,
        classes=classes,
    )


def _cases(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(space, side, id, value) of all texts that are to be held against each other. In space ``link`` the id of side ``link`` is null, as links with one target share a row."""
    last = latest_rows(nodes, "id", "seen_at", ["type", "name", "path"])
    col = F.col
    own = last.select(
        F.when(col("type").isin("note", "asset"), F.concat(F.lit("path:"), "type")).when(col("type").isin("tag", "phantom"), F.concat(F.lit("name:"), "type")).alias("space"),
        F.lit("node").alias("side"),
        "id",
        F.when(col("type").isin("note", "asset"), col("path")).otherwise(col("name")).alias("value"),
    ).filter("space is not null and value is not null")
    notes = last.filter(col("type") == "note")
    forms = notes.select(F.lit("link").alias("space"), F.lit("note").alias("side"), "id", F.explode(F.array_distinct(F.array("name", "path"))).alias("value")).filter("value is not null")
    targets = links.select(F.lit("link").alias("space"), F.lit("link").alias("side"), F.lit(None).cast("long").alias("id"), col("target").alias("value")).distinct()
    return own.unionByName(forms).unionByName(targets)


def _phantom_links(edges: DataFrame) -> DataFrame:
    """(id, target) of the distinct edges to phantoms."""
    links = edges.filter(F.col("id").isNotNull() & F.col("dst_key").startswith("phantom:")).groupBy("id").agg(F.max("raw_link").alias("raw_link"))
    return links.select("id", link_target(F.col("raw_link")).alias("target")).filter("target <> ''")


def look_alike_cases(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(field_name, left_id, right_id), as TESTDATA.md defines the cases of problem 4.

    Null ids, names, paths and raw links give no case. Of the rows of a node the latest counts; repeated rows and edges
    of one id count once. Other columns aren't read; empty tables give an empty result. Texts are compared whole.
    """
    links = stage(_phantom_links(edges), "phantom-links")
    members = stage(canonical_members(_cases(nodes, links)), "look-alike")
    twins = members.filter("space <> 'link'").select("space", "canonical", "id", "value")
    a, b = twins.alias("a"), twins.alias("b")
    pairs = a.join(b, (F.col("a.space") == F.col("b.space")) & (F.col("a.canonical") == F.col("b.canonical")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.value") != F.col("b.value")))
    same = pairs.select(F.substring_index("a.space", ":", 1).alias("field_name"), F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"))
    notes = members.filter("space = 'link' and side = 'note'").select("canonical", F.col("id").alias("right_id"))
    named = members.filter("space = 'link' and side = 'link'").select("canonical", F.col("value").alias("target"))
    met = named.join(notes, "canonical").select("target", "right_id").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = links.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    ends = salted.join(met, ["target", "salt"]).select(F.lit("raw_link").alias("field_name"), F.col("id").alias("left_id"), "right_id")
    return same.unionByName(ends)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_cases(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges"))


def _sql_look(x: str) -> str:
    """The same for an engine without decomposition: the fixed letters, with accents by a table made by rule, joined forms by name."""
    letters = dict(pair for old, new in LOOK_ALIKE for pair in zip(old, new, strict=True))
    one = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFF9E)} | letters
    for c in map(chr, [*range(0x370, 0x530), *range(0x1F00, 0x2000)]):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and base in letters and len(flat := unicodedata.normalize("NFC", letters[base] + "".join(marks))) == 1:
            one[c] = flat
    one = {c: one.get(f, f) for c, f in one.items() if len(f) == 1}
    for c in map(chr, [*range(0xFB00, 0xFB07), 0x132, 0x133, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), 0xFF9E, 0xFF9F]):
        x = f"replace({x}, '{c}', '{unicodedata.normalize('NFKC', c)}')"
    x = f"regexp_replace(regexp_replace(regexp_replace({x}, '{_NO_INK}', '', 'g'), '{_BLANK}', ' ', 'g'), '{_HYPHEN}', '-', 'g')"
    old, new = ("".join(t).replace("'", "''") for t in (one, one.values()))
    return f"nfc_normalize(translate(nfc_normalize({x}), '{old}', '{new}'))"


P4_SQL = rf"""
WITH n AS (SELECT * FROM nodes WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY seen_at DESC NULLS LAST, type DESC, name DESC NULLS LAST, path DESC NULLS LAST) = 1),
v AS (SELECT id, type, CASE WHEN type IN ('note', 'asset') THEN 'path' ELSE 'name' END f, CASE WHEN type IN ('note', 'asset') THEN path ELSE name END v FROM n),
w AS (SELECT id, type, f, v, {_sql_look("v")} l FROM v WHERE v IS NOT NULL),
same AS (SELECT a.f AS field_name, a.id AS left_id, b.id AS right_id FROM w a JOIN w b ON a.type = b.type AND a.l = b.l AND a.id < b.id AND a.v <> b.v WHERE trim(a.l) <> ''),
e AS (SELECT id, max(raw_link) r FROM edges WHERE id IS NOT NULL AND dst_key LIKE 'phantom:%' GROUP BY id),
t AS (SELECT id, split_part(CASE WHEN starts_with(r, '[[') THEN split_part(regexp_extract(r, '\[\[(.*?)\]\]', 1, 's'), '|', 1)
  ELSE regexp_extract(r, '\]\((.*?)\)', 1, 's') END, '#', 1) t FROM e),
u AS (SELECT t, regexp_replace({_sql_look("t")}, '\.md$', '') l FROM (SELECT DISTINCT t FROM t WHERE t <> '')),
k AS (SELECT id, {_sql_look("x")} l FROM (SELECT id, unnest([name, path]) x FROM n WHERE type = 'note') WHERE x IS NOT NULL),
m AS (SELECT id, l FROM k UNION SELECT id, regexp_replace(l, '\.md$', '') FROM k)
SELECT field_name, left_id, right_id FROM same
UNION ALL SELECT DISTINCT 'raw_link', t.id, m.id FROM t JOIN u USING (t) JOIN m ON m.l = u.l WHERE trim(u.l) <> ''
"""
