"""SQL for the graph queries, for an engine that knows nothing of this package. Made of small pieces, as macros would be."""

from __future__ import annotations

_N = """n AS (SELECT * FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seen_at DESC NULLS LAST, node_key DESC,
  type DESC, name DESC, path DESC NULLS LAST, exists_flag DESC, mtime DESC NULLS LAST, node_ord DESC) = 1)"""
_E = "e AS (SELECT * FROM edges WHERE id IS NOT NULL AND dst_key IS NOT NULL AND src_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at) = 1)"
_G = f"WITH {_N}, {_E}"
_WS = r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _name(p: str) -> str:
    return f"regexp_extract({p}, '([^/]*)$', 1)"


def _note(p: str) -> str:
    return rf"lower(regexp_replace({_name(p)}, '\.[^.]*$', ''))"


def _no_ext(p: str) -> str:
    return rf"regexp_replace({p}, '\.[^./]*$', '')"


def _no_md(p: str) -> str:
    return rf"regexp_replace({p}, '(?i)\.md$', '')"


def _folder(p: str) -> str:
    return f"CASE WHEN contains({p}, '/') THEN regexp_extract({p}, '^(.*)/[^/]*$', 1) ELSE '.' END"


def _clean(p: str) -> str:
    """For paths that don't begin with a slash."""
    parts = f"list_transform(list_filter(string_split({p}, '/'), lambda x: x <> '' AND x <> '.'), lambda x: [x])"
    up = "CASE WHEN b[1] = '..' AND len(a) > 0 AND a[len(a)] <> '..' THEN a[1:len(a) - 1] ELSE list_concat(a, b) END"
    return f"array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), {parts}), lambda a, b: {up}), '/')"


def _inner(raw: str) -> str:
    return rf"regexp_replace(regexp_replace({raw}, '^\[\[', ''), '\]\]$', '')"


def _before(raw: str) -> str:
    return f"split_part({_inner(raw)}, '|', 1)"


def _sub(x: str) -> str:
    return f"regexp_extract({x}, '(#.*)$', 1)"


def _alias(raw: str) -> str:
    return rf"regexp_extract({_inner(raw)}, '^[^|]*(\|.*)$', 1)"


def _url(raw: str) -> str:
    return rf"regexp_extract({raw}, '^.*?\]\((.*?)\)?$', 1)"


def _text(raw: str) -> str:
    return rf"regexp_extract({raw}, '^\[(.*?)\]\(', 1)"


def _pointed(raw: str, kind: str, path: str) -> str:
    wiki = f"'[[' || {_no_md(path)} || {_sub(_before(raw))} || {_alias(raw)} || ']]'"
    md = f"CASE WHEN lower(split_part({_url(raw)}, '#', 1)) LIKE '%.md' THEN '.md' ELSE '' END"
    mark = rf"regexp_extract({raw}, '^(.*?\]\()', 1) || {_no_md(path)} || {md} || {_sub(_url(raw))} || ')'"
    return f"CASE WHEN {kind} = 'wikilink' THEN {wiki} ELSE {mark} END"


def _bare_raw(raw: str, kind: str) -> str:
    t = f"CASE WHEN {kind} = 'wikilink' THEN split_part({_before(raw)}, '#', 1) ELSE split_part({_url(raw)}, '#', 1) END"
    return f"(({t}) <> '' AND NOT contains({t}, '/'))"


_FILES = f"""
note AS (SELECT path, node_ord, {_note('path')} k FROM n WHERE type = 'note'),
asset AS (SELECT path, node_ord, lower({_name('path')}) k FROM n WHERE type = 'asset'),
nn AS (SELECT k, count(*) c, max(path) one, max(CASE WHEN NOT contains(path, '/') THEN path END) root FROM note GROUP BY k),
an AS (SELECT k, count(*) c, max(path) one, max(CASE WHEN NOT contains(path, '/') THEN path END) root FROM asset GROUP BY k),
np AS (SELECT k, arg_max(path, node_ord) path FROM (SELECT lower(path) k, path, node_ord FROM note UNION SELECT lower({_no_ext('path')}), path, node_ord FROM note) GROUP BY k),
ap AS (SELECT lower(path) k, arg_max(path, node_ord) path FROM asset GROUP BY 1)"""
_OCC = f"""
o AS (SELECT DISTINCT * FROM occurrences),
w AS (SELECT *, CASE WHEN is_relative THEN {_clean(f"({_folder('src_path')}) || '/' || target")} WHEN target LIKE '/%' THEN substr(target, 2) ELSE target END way FROM o),
l AS (SELECT *, CASE WHEN is_relative THEN (way = '..' OR way LIKE '../%') WHEN is_basename OR target = '' OR link_type NOT IN ('wikilink', 'markdown') THEN false
      ELSE ({_clean("regexp_replace(target, '^/', '')")} || '/') LIKE '../%' END AS esc FROM w)"""
_R = f"""WITH {_N}, {_FILES}, {_OCC},
r AS (SELECT l.*, CASE
   WHEN link_type IN ('tag', 'frontmatter') THEN 'tag:name:' || lower(target)
   WHEN target = '' THEN 'note:path:' || src_path
   WHEN is_basename THEN coalesce('note:path:' || CASE WHEN nn.c = 1 THEN nn.one ELSE nn.root END, 'asset:path:' || CASE WHEN an.c = 1 THEN an.one ELSE an.root END, 'phantom:name:' || lower(target))
   ELSE coalesce('note:path:' || p0.path, 'note:path:' || p1.path, 'asset:path:' || ap.path, 'phantom:name:' || lower({_no_md(_name('way'))})) END AS dst_key,
   link_type IN ('wikilink', 'markdown') AND is_basename AND target <> '' AND CASE WHEN nn.k IS NOT NULL THEN nn.c > 1 AND nn.root IS NULL ELSE coalesce(an.c > 1 AND an.root IS NULL, false) END AS ambiguous
  FROM l LEFT JOIN nn ON l.is_basename AND nn.k = lower(l.target) LEFT JOIN an ON l.is_basename AND an.k = lower(l.target)
  LEFT JOIN np p0 ON NOT l.is_basename AND p0.k = lower(l.way) LEFT JOIN np p1 ON NOT l.is_basename AND p1.k = lower(l.way) || '.md' LEFT JOIN ap ON NOT l.is_basename AND ap.k = lower(l.way))
"""
_LINKS = f"""
src AS (SELECT node_key AS src_key, path AS file FROM n WHERE exists_flag),
x AS (SELECT e.*, src.file, {_bare_raw('raw_link', 'link_type')} AS bare FROM e JOIN src USING (src_key) WHERE link_type IN ('wikilink', 'markdown'))"""


def _hub(side: str, prefix: str) -> str:
    return f"hub AS (SELECT {side} k FROM e WHERE {side} LIKE '{prefix}%' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _conflicts(kind: str) -> str:
    return f"""{_G}, f AS (SELECT lower(name) k, min_by(name, (path, name)) AS name, list_sort(list(path)) AS paths, count(*) c FROM n WHERE type = '{kind}' AND exists_flag GROUP BY 1)
SELECT name, paths FROM f WHERE c > 1"""


def _two_hop(near: str, far: str, prefix: str, keep_via: str = "true", keep_target: str = "true") -> str:
    return f"""{_G}, {_hub(near, prefix)},
v AS (SELECT DISTINCT {far} via FROM e JOIN hub ON e.{near} = hub.k),
p AS (SELECT DISTINCT v.via, e.{near} t FROM e JOIN v ON e.{far} = v.via, hub WHERE e.{near} <> hub.k),
q AS (SELECT p.via, p.t, a.node_ord, row_number() OVER (PARTITION BY p.via ORDER BY b.path NULLS FIRST, b.name, p.t) pos FROM p JOIN n a ON a.node_key = p.via JOIN n b ON b.node_key = p.t
  WHERE ({keep_via.replace('@', 'a.')}) AND ({keep_target.replace('@', 'b.')})),
s AS (SELECT *, dense_rank() OVER (ORDER BY node_ord, via) vp FROM q WHERE pos <= 10)
SELECT via AS via_key, CAST(vp AS INTEGER) AS via_pos, CAST(pos AS INTEGER) AS pos, t AS target_key FROM s WHERE vp <= 100"""


_PATH_OK = "@path IS NULL OR NOT (@path LIKE 'assets/%' OR @path LIKE 'inbox/%')"
_TAG_OK = "lower(@name) <> '#idea'"
_VIA_OK = f"CASE WHEN @type = 'tag' THEN {_TAG_OK} WHEN @type IN ('note', 'asset') THEN {_PATH_OK} ELSE true END"

_LINES = rf"""
d AS (SELECT doc_id, string_split(text, chr(10)) ls FROM documents WHERE text IS NOT NULL),
d2 AS (SELECT doc_id, ls, CASE WHEN {_trim('ls[1]')} = '---' THEN coalesce(list_position(list_transform(ls[2:], lambda x: {_trim('x')}), '---'), 0) ELSE 0 END fm FROM d),
ln AS (SELECT doc_id, fm, unnest(ls) l, unnest(generate_series(1, len(ls))) i FROM d2),
body AS (SELECT *, {_trim('l')} LIKE '```%' fence FROM ln WHERE i > CASE WHEN fm > 0 THEN fm + 1 ELSE 0 END),
par AS (SELECT *, sum(CAST(fence AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) s FROM body),
c AS (SELECT doc_id, i, regexp_replace(l, '`[^`]*(?:`|$)', '', 'g') l FROM par WHERE NOT fence AND s % 2 = 0)"""
_NOT_TAG = r"\x{00}-\x{20}" + _WS + r"""''"!#$%&()*+,.:;<=>?@^{|}~\[\]\\`\x{2000}-\x{206F}\x{2E00}-\x{2E7F}"""
_WIKI = rf"""WITH {_LINES},
x AS (SELECT doc_id, i, unnest(regexp_extract_all(l, '(?s)\[\[(.*?)\]\]', 1)) w FROM c),
y AS (SELECT *, split_part(w, '|', 1) nm FROM x)
SELECT doc_id, CAST(i AS BIGINT) AS line, '[[' || w || ']]' AS raw_link, {_no_md("split_part(nm, '#', 1)")} AS target, {_sub('nm')} AS subpath FROM y WHERE nm <> ''"""
_MARK = rf"""WITH {_LINES},
x AS (SELECT doc_id, i, unnest(regexp_extract_all(l, '(?s)\[\[|\[.*?\]\(.*?\)')) m FROM c),
y AS (SELECT *, {_trim(_url('m'))} u FROM x WHERE m <> '[[')
SELECT doc_id, CAST(i AS BIGINT) AS line, m AS raw_link, {_no_md("split_part(u, '#', 1)")} AS target, {_sub('u')} AS subpath FROM y
WHERE split_part(u, '#', 1) <> '' AND NOT (u LIKE 'http://%' OR u LIKE 'https://%')"""
_TAGS = rf"""WITH {_LINES},
x AS (SELECT doc_id, i, regexp_replace(regexp_replace(l, '(?s)\[.*?\]\(.*?\)', '', 'g'), '(?s)\[\[.*?\]\]', '', 'g') l FROM c),
y AS (SELECT doc_id, i, unnest(regexp_extract_all(l, '(?:^|[{_WS}])#([^{_NOT_TAG}\p{{Nd}}/][^{_NOT_TAG}]*)', 1)) t FROM x WHERE NOT ({_trim('l')} LIKE '# %' OR {_trim('l')} = '#')),
z AS (SELECT doc_id, i, list_filter(string_split(regexp_replace(t, '/+$', ''), '/'), lambda p: p <> '') ps FROM y)
SELECT doc_id, CAST(i AS BIGINT) AS line, unnest(list_transform(generate_series(1, len(ps)), lambda k: '#' || array_to_string(ps[1:k], '/'))) AS target FROM z"""
_FRONT = rf"""WITH {_LINES},
f AS (SELECT doc_id, i, regexp_replace(l, '\r$', '') l FROM ln WHERE fm > 0 AND i BETWEEN 2 AND fm),
k AS (SELECT doc_id, i, trim(regexp_extract(l, '^tags:(.*)$', 1)) v FROM f WHERE regexp_matches(l, '^tags:( |$)')),
one AS (SELECT doc_id, i, unnest(string_split(regexp_replace(v, '^\[|\]$', '', 'g'), ',')) t FROM k WHERE v <> ''),
z AS (SELECT k.doc_id, k.i, min(f.i) AS stop FROM k LEFT JOIN f ON f.doc_id = k.doc_id AND f.i > k.i AND NOT regexp_matches(f.l, '^ *- ') WHERE k.v = '' GROUP BY ALL),
many AS (SELECT f.doc_id, f.i, regexp_extract(f.l, '^ *- (.*)$', 1) t FROM f JOIN z ON f.doc_id = z.doc_id AND f.i > z.i AND f.i < coalesce(z.stop, 1 << 30)),
b AS (SELECT doc_id, i, string_split(regexp_replace(regexp_replace(trim(t), '^[''"]|[''"]$', '', 'g'), '^#', ''), '/') ps FROM (FROM one UNION ALL FROM many) WHERE trim(t) <> '')
SELECT doc_id, CAST(i AS BIGINT) AS line, unnest(list_transform(generate_series(1, len(ps)), lambda n: '#' || array_to_string(ps[1:n], '/'))) AS target FROM b"""
_HEAD = rf"""WITH d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\r$', '')) ls FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
d2 AS (SELECT doc_id, ls, CASE WHEN {_trim('ls[1]')} = '---' THEN coalesce(list_position(list_transform(ls[2:], lambda x: {_trim('x')}), '---'), 0) ELSE 0 END fm FROM d),
ln AS (SELECT doc_id, fm, len(ls) z, unnest(ls) l, unnest(generate_series(1, len(ls))) i FROM d2),
b AS (SELECT * FROM ln WHERE i > CASE WHEN fm > 0 THEN fm + 1 ELSE 0 END AND NOT (i = z AND l = '')),
f AS (SELECT doc_id, min(i) a FROM b WHERE {_trim('l')} <> '' GROUP BY 1)
SELECT b.doc_id, CAST(i - a + 1 AS INTEGER) AS pos, l AS line FROM b JOIN f USING (doc_id) WHERE i BETWEEN a AND a + 2"""
_SNIP = rf"""WITH {_LINES},
x AS (SELECT doc_id, i, unnest(regexp_extract_all(l, '(?s)\[\[(.*?)\]\]', 1)) w FROM c),
y AS (SELECT *, split_part(w, '|', 1) nm FROM x),
t AS (SELECT doc_id, list_transform(ls, lambda x: regexp_replace(x, '\r$', '')) ls FROM d)
SELECT y.doc_id, {_no_md("split_part(nm, '#', 1)")} AS target, CAST(greatest(i - 1, 1) AS INTEGER) AS line_start, CAST(least(i + 1, len(ls)) AS INTEGER) AS line_end,
 array_to_string(ls[greatest(i - 1, 1):least(i + 1, len(ls))], chr(10)) AS lines FROM y JOIN t USING (doc_id) WHERE nm <> ''"""

# path links of the occurrences and the file that each means
_PATHS = f"""WITH {_N}, {_FILES}, {_OCC},
q AS (SELECT l.*, p0.path a, p1.path b, ap.path c, coalesce(p0.path, p1.path, ap.path) AS hit, p0.path IS NULL AND p1.path IS NULL AS is_asset FROM l
  LEFT JOIN np p0 ON p0.k = lower(l.way) LEFT JOIN np p1 ON p1.k = lower(l.way) || '.md' LEFT JOIN ap ON ap.k = lower(l.way)
  WHERE link_type IN ('wikilink', 'markdown') AND target <> '' AND NOT is_basename)"""
_SIMPLE = f"""{_PATHS},
s AS (SELECT q.*, coalesce(CASE WHEN is_asset THEN lower({_name('hit')}) ELSE {_note('hit')} END, '') AS key FROM q WHERE hit IS NOT NULL AND NOT esc),
s2 AS (SELECT s.*, CASE WHEN is_asset THEN an.c ELSE nn.c END AS cnt, CASE WHEN is_asset THEN an.root ELSE nn.root END AS root FROM s LEFT JOIN nn ON nn.k = key LEFT JOIN an ON an.k = key WHERE NOT (is_asset AND nn.k IS NOT NULL))"""
_SKIP = f"""SELECT DISTINCT src_path AS file, raw_link, CASE WHEN is_asset THEN {_name('hit')} ELSE regexp_replace({_name('hit')}, '\\.[^.]*$', '') END AS basename,
 CASE WHEN is_asset THEN (SELECT list_sort(list(path)) FROM asset WHERE k = key) ELSE (SELECT list_sort(list(path)) FROM note WHERE k = key) END AS candidates
FROM s2 WHERE cnt > 1 AND root IS NULL"""
_REPAIR = f"""{_PATHS},
keys AS (SELECT lower(path) k FROM note UNION SELECT regexp_replace(lower(path), '\\.md$', '') FROM note),
byname AS (SELECT lower({_no_md(_name('path'))}) bk, count(*) c, list_sort(list(path)) ps FROM note GROUP BY 1),
t AS (SELECT q.*, {_name('target')} AS bn, byname.c AS cands, byname.ps FROM q LEFT JOIN keys ON keys.k = lower(way) LEFT JOIN byname ON bk = lower({_name('target')}) WHERE esc OR keys.k IS NULL)"""
_LOST = _REPAIR.replace(
    "o AS (SELECT DISTINCT * FROM occurrences)",
    f"o AS (SELECT DISTINCT * REPLACE (CASE WHEN link_type IN ('wikilink', 'markdown') AND target <> '' THEN 'gone/' || {_name('target')} ELSE target END AS target, false AS is_relative, false AS is_basename) FROM occurrences)",
)

_MOVED = f"""mv AS (SELECT path, node_key, type, name, 'kitchen/' || substr(path, 9) AS dest FROM n WHERE type IN ('note', 'asset') AND path LIKE 'recipes/%'),
af AS (SELECT n.node_key, n.type, n.path, coalesce(mv.dest, n.path) AS newp, mv.dest FROM n LEFT JOIN mv USING (node_key) WHERE n.exists_flag AND n.type IN ('note', 'asset')),
ky AS (SELECT *, CASE WHEN type = 'asset' THEN lower({_name('newp')}) ELSE {_note('newp')} END AS key, CASE WHEN type = 'asset' THEN lower({_name('path')}) ELSE {_note('path')} END AS old FROM af),
cnt AS (SELECT type, key, count(*) c, max(CASE WHEN NOT contains(newp, '/') THEN 1 ELSE 0 END) AS post, max(CASE WHEN dest IS NOT NULL THEN 1 ELSE 0 END) AS arrived FROM ky GROUP BY ALL),
pre AS (SELECT type, old AS key, max(CASE WHEN NOT contains(path, '/') THEN 1 ELSE 0 END) AS pre FROM ky GROUP BY ALL),
fin AS (SELECT ky.*, cnt.arrived = 1 AS arrived, cnt.c > 1 AND NOT (cnt.post = 1 AND coalesce(pre.pre, 0) = 1) AS unsafe FROM ky JOIN cnt USING (type, key) LEFT JOIN pre USING (type, key))"""
_ADD = f"""ad AS (SELECT DISTINCT 'archive/' || name || '.md' AS path FROM n WHERE type = 'note' AND path LIKE 'recipes/%'),
ac AS (SELECT {_note('path')} k, count(*) c FROM ad GROUP BY 1),
hit AS (SELECT 'note:path:' || nn.one AS dst_key, nn.one FROM ac JOIN nn ON nn.k = ac.k WHERE nn.c = 1 AND contains(nn.one, '/'))"""


def _moved_outgoing() -> str:
    """The links within the notes of folders that sort before ``n``, which go below ``old``."""
    aimed = f"CASE WHEN link_type = 'wikilink' THEN split_part({_before('raw_link')}, '#', 1) ELSE split_part({_url('raw_link')}, '#', 1) END"
    up = "regexp_replace(repeat('../', len(a) - c) || array_to_string(b[c + 1:], '/'), '/$', '')"
    kept = f"CASE WHEN lower(split_part({_url('raw_link')}, '#', 1)) LIKE '%.md' THEN CASE WHEN lower(way) LIKE '%.md' THEN way ELSE way || '.md' END ELSE regexp_replace(way, '[.]md$', '') END"
    return f"""{_G}, {_OCC},
mv AS (SELECT path AS p0, 'old/' || path AS p1 FROM n WHERE type IN ('note', 'asset') AND contains(path, '/') AND path < 'n'),
af AS (SELECT coalesce(mv.p1, path) AS np FROM n LEFT JOIN mv ON p0 = path WHERE type = 'note' AND exists_flag),
na AS (SELECT {_note('np')} k, count(*) c, max(np) one, max(CASE WHEN NOT contains(np, '/') THEN np END) root FROM af GROUP BY 1),
was AS (SELECT mv.p0 AS sp, e.raw_link AS rl, min(t.path) AS was FROM e JOIN mv ON e.src_key = 'note:path:' || mv.p0 JOIN n t ON t.node_key = e.dst_key WHERE t.path IS NOT NULL GROUP BY 1, 2),
s AS (SELECT l.* EXCLUDE (way), mv.p1 AS ns FROM l JOIN mv ON mv.p0 = l.src_path WHERE link_type IN ('wikilink', 'markdown')),
wh AS (SELECT s.*, coalesce(g.p1, was) AS now, g.p1 AS went FROM s JOIN was ON sp = src_path AND rl = raw_link LEFT JOIN mv g ON g.p0 = was WHERE NOT is_relative AND target <> ''),
r0 AS (SELECT *, {_clean(f"({_folder('src_path')}) || '/' || ({aimed})")} AS aim FROM s WHERE is_relative),
r1 AS (SELECT r0.*, coalesce(m1.p1, regexp_replace(m2.p1, '[.]md$', ''), aim) AS to_ FROM r0 LEFT JOIN mv m1 ON m1.p0 = aim LEFT JOIN mv m2 ON m2.p0 LIKE '%.md' AND {_no_ext('m2.p0')} = aim),
r2 AS (SELECT *, string_split({_folder('ns')}, '/') AS a, string_split(to_, '/') AS b FROM r1),
r3 AS (SELECT *, len(list_filter(generate_series(1, least(len(a), len(b))), lambda i: a[1:i] = b[1:i])) AS c FROM r2),
r4 AS (SELECT *, CASE WHEN len(a) > c THEN {up} ELSE './' || array_to_string(b[c + 1:], '/') END AS way FROM r3)
SELECT file, raw_link, new_link, occ_ord FROM (
SELECT src_path AS file, raw_link, {_pointed('raw_link', 'link_type', 'now')} AS new_link, occ_ord FROM wh JOIN na ON na.k = {_note('target')}
  WHERE is_basename AND CASE WHEN c = 1 THEN one ELSE root END IS DISTINCT FROM now
UNION ALL SELECT src_path, raw_link, {_pointed('raw_link', 'link_type', 'now')}, occ_ord FROM wh WHERE NOT is_basename AND went IS NOT NULL
UNION ALL SELECT src_path, raw_link, CASE WHEN link_type = 'wikilink' THEN '[[' || regexp_replace(way, '[.]md$', '') || {_sub(_before('raw_link'))} || {_alias('raw_link')} || ']]'
  ELSE split_part(raw_link, '](', 1) || '](' || {kept} || {_sub(_url('raw_link'))} || ')' END, occ_ord FROM r4) WHERE new_link <> raw_link"""


def _convert_md() -> str:
    raw = "raw_link"
    alias = f"regexp_replace({_alias(raw)}, '^\\|', '')"
    target, sub = f"split_part({_before(raw)}, '#', 1)", _sub(_before(raw))
    ext = f"regexp_extract({target}, '(\\.[^./]*)$', 1)"
    note = f"({ext} = '' OR lower({target}) LIKE '%.md' OR lower({_name(target)}) IN (SELECT lower(regexp_replace({_name('path')}, '\\.md$', '')) FROM note))"
    text = f"CASE WHEN {alias} <> '' THEN {alias} WHEN {target} = '' THEN {sub} ELSE {_name(target)} || {sub} END"
    url = f"CASE WHEN {target} = '' AND {sub} <> '' THEN {sub} WHEN {note} AND NOT lower({target}) LIKE '%.md' THEN {target} || '.md' || {sub} ELSE {target} || {sub} END"
    return f"WITH {_N}, {_FILES}, o AS (SELECT DISTINCT * FROM occurrences) SELECT src_path AS file, raw_link, '[' || ({text}) || '](' || ({url}) || ')' AS new_link, occ_ord FROM o WHERE link_type = 'wikilink'"


def _convert_wiki() -> str:
    url, text = _url("raw_link"), _text("raw_link")
    target, sub = f"split_part({url}, '#', 1)", _sub(url)
    path = _no_md(target)
    name = _name(path)
    plain = f"({text} = {name} OR ({sub} <> '' AND {text} = {name} || {sub}))"
    own = f"'[[' || {sub} || CASE WHEN {text} = {sub} THEN '' ELSE '|' || {text} END || ']]'"
    new = f"CASE WHEN {target} = '' THEN {own} ELSE '[[' || {path} || {sub} || CASE WHEN {plain} THEN '' ELSE '|' || {text} END || ']]' END"
    return f"SELECT DISTINCT src_path AS file, raw_link, {new} AS new_link, occ_ord FROM (SELECT DISTINCT * FROM occurrences) WHERE link_type = 'markdown' AND {url} <> '' AND NOT ({url} LIKE 'http://%' OR {url} LIKE 'https://%')"


SQL = {
    "stats_counts": f"""{_G} SELECT count(*) FILTER (type = 'note') AS notes_total, count(*) FILTER (type = 'note' AND exists_flag) AS notes_exists, count(*) FILTER (type = 'tag') AS tags_total,
  count(*) FILTER (type = 'phantom') AS phantoms_total, count(*) FILTER (type = 'asset') AS assets_total, (SELECT count(*) FROM e) AS edges_total FROM n""",
    "basename_conflicts": _conflicts("note"),
    "asset_conflicts": f"""{_G}, a AS (SELECT {_folder('path')} || '/attachment' || regexp_extract(path, '[.][^./]*$') AS path FROM n WHERE type = 'asset' AND exists_flag),
f AS (SELECT {_name('path')} AS name, list_sort(list(path)) AS paths, count(*) c FROM a GROUP BY lower({_name('path')}), 1) SELECT min(name) AS name, list_sort(flatten(list(paths))) AS paths FROM f GROUP BY lower(name) HAVING sum(c) > 1""",
    "phantoms_list": f"{_G} SELECT name FROM n WHERE type = 'phantom'",
    "backlinks_of_hub": f"""{_G}, {_hub('dst_key', 'note:')} SELECT node_key, type, name, path, exists_flag FROM n WHERE node_key IN (SELECT src_key FROM e JOIN hub ON e.dst_key = hub.k)
  ORDER BY path NULLS FIRST, name LIMIT 100""",
    "outgoing_of_hub": f"""{_G}, {_hub('src_key', 'note:')} SELECT node_key, type, name, path, exists_flag FROM n WHERE type <> 'tag' AND node_key IN (SELECT dst_key FROM e JOIN hub ON e.src_key = hub.k WHERE e.dst_key <> hub.k)""",
    "leaf_tags": f"""{_G}, t AS (SELECT e.src_key, list_distinct(list(n.name)) ts FROM e JOIN n ON n.node_key = e.dst_key WHERE n.type = 'tag' GROUP BY 1)
SELECT src_key, list_sort(list_filter(ts, lambda x: len(list_filter(ts, lambda y: starts_with(y, x || '/'))) = 0)) AS tags FROM t""",
    "twohop_of_tag": _two_hop("dst_key", "src_key", "tag:"),
    "twohop_of_note": _two_hop("src_key", "dst_key", "note:", _VIA_OK, _PATH_OK),
    "twohop_all": f"""{_G}, x AS (SELECT DISTINCT src_key s, dst_key d FROM e), f AS (SELECT s, d FROM x QUALIFY row_number() OVER (PARTITION BY d ORDER BY s) <= 11),
p AS (SELECT x.s entry, x.d via, f.s target, row_number() OVER (PARTITION BY x.s, x.d ORDER BY f.s) pos FROM x JOIN f ON f.d = x.d AND f.s <> x.s)
SELECT entry, via, CAST(pos AS INTEGER) AS pos, target FROM p WHERE pos <= 10""",
    "order_links": """SELECT 'note:path:orders/' || o_orderkey || '.md' AS src_key, 'note:path:customers/' || o_custkey || '.md' AS dst_key FROM orders
UNION ALL SELECT 'note:path:orders/' || l_orderkey || '.md', 'note:path:parts/' || l_partkey || '.md' FROM lineitem JOIN orders ON o_orderkey = l_orderkey
UNION ALL SELECT 'note:path:orders/' || l_orderkey || '.md', 'phantom:name:' || l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey
UNION ALL SELECT 'note:path:orders/' || o_orderkey || '.md', unnest(['tag:name:#status', 'tag:name:#status/' || lower(o_orderstatus)]) FROM orders""",
    "projected_stats": """WITH li AS (SELECT l_partkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM part) AS notes_total, (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM part) AS notes_exists,
 3 + (SELECT count(DISTINCT lower(o_orderstatus)) FROM orders) + (SELECT count(DISTINCT lower(c_mktsegment)) FROM customer) + (SELECT count(DISTINCT lower(p_brand)) FROM part) AS tags_total,
 (SELECT count(DISTINCT l_suppkey) FROM li) AS phantoms_total, 0 AS assets_total,
 3 * (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM li) + 2 * (SELECT count(*) FROM customer) + 2 * (SELECT count(*) FROM part) AS edges_total""",
    "twohop_orders": """WITH x AS (SELECT DISTINCT l_orderkey s, l_partkey d FROM lineitem JOIN orders ON o_orderkey = l_orderkey), f AS (SELECT s, d FROM x QUALIFY row_number() OVER (PARTITION BY d ORDER BY s) <= 11),
p AS (SELECT x.s entry, x.d via, f.s target, row_number() OVER (PARTITION BY x.s, x.d ORDER BY f.s) pos FROM x JOIN f ON f.d = x.d AND f.s <> x.s)
SELECT entry, via, CAST(pos AS INTEGER) AS pos, target FROM p WHERE pos <= 10""",
    "exclude_paths_nullsafe": f"{_G} SELECT node_key FROM n WHERE {_PATH_OK.replace('@', '')}",
    "exclude_tags": f"{_G} SELECT node_key FROM n WHERE type = 'tag' AND {_TAG_OK.replace('@', '')}",
    "exclude_vias": f"{_G} SELECT node_key FROM n WHERE {_VIA_OK.replace('@', '')}",
    "doc_wikilinks": _WIKI,
    "doc_markdown_links": _MARK,
    "nested_tag_expansion": _TAGS,
    "frontmatter_tags": _FRONT,
    "head_lines": _HEAD,
    "snippet_lines": _SNIP,
    "resolve_priority": f"{_R} SELECT src_path, occ_ord, raw_link, dst_key, ambiguous FROM r WHERE NOT esc",
    "ambiguous_links_first5": f"{_R} SELECT DISTINCT src_path, raw_link, walk_ord, occ_ord FROM r WHERE esc OR ambiguous ORDER BY walk_ord, occ_ord, src_path, raw_link LIMIT 5",
    "root_priority": f"WITH {_N}, {_FILES} SELECT k AS key, c AS n_files, CASE WHEN c = 1 THEN one ELSE root END AS means FROM nn",
    "orphans_anti": f"{_G} SELECT node_key FROM n WHERE type <> 'note' AND node_key NOT IN (SELECT dst_key FROM e)",
    "incoming_counts": f"{_G} SELECT dst_key, count(*) AS n FROM e WHERE src_key <> dst_key GROUP BY 1",
    "delete_phantomize": f"""{_G}, g AS (SELECT node_key, path, node_ord pos FROM n WHERE path LIKE 'inbox/%'),
h AS (SELECT DISTINCT e.dst_key FROM e JOIN g t ON t.node_key = e.dst_key LEFT JOIN g s ON s.node_key = e.src_key WHERE e.src_key <> e.dst_key AND (s.pos IS NULL OR s.pos > t.pos))
SELECT path, node_key IN (SELECT dst_key FROM h) AS phantomed FROM g""",
    "add_promote_phantom": f"""{_G}, a AS (SELECT 'archive/' || name || '.md' AS path, node_ord FROM n WHERE type = 'phantom' AND NOT contains(name, '/')),
b AS (SELECT path, 'phantom:name:' || {_note('path')} AS phantom, node_ord FROM a),
c AS (SELECT phantom, arg_min(path, node_ord) AS path FROM b GROUP BY 1)
SELECT path, phantom FROM c WHERE phantom IN (SELECT node_key FROM n WHERE type = 'phantom')""",
    "add_rewrites": f"""{_G}, {_FILES}, {_LINKS}, {_ADD}
SELECT * FROM (SELECT file, raw_link, {_pointed('raw_link', 'link_type', 'one')} AS new_link, occ_ord FROM x JOIN hit USING (dst_key) WHERE bare) WHERE new_link <> raw_link""",
    "movedir_rewrites": f"""{_G}, {_LINKS}, {_MOVED}
SELECT * FROM (SELECT file, raw_link, {_pointed('raw_link', 'link_type', 'coalesce(dest, path)')} AS new_link, occ_ord FROM x JOIN fin ON fin.node_key = x.dst_key
 WHERE file NOT IN (SELECT path FROM mv) AND CASE WHEN dest IS NOT NULL THEN NOT bare OR key <> old OR unsafe ELSE arrived AND unsafe AND bare END) WHERE new_link <> raw_link""",
    "moved_outgoing_rewrites": _moved_outgoing(),
    "simplify_plan": f"""{_SIMPLE} SELECT * FROM (SELECT src_path AS file, raw_link, {_pointed('raw_link', 'link_type', _name('hit'))} AS new_link, occ_ord FROM s2 WHERE cnt = 1 OR root = hit) WHERE new_link <> raw_link""",
    "simplify_skipped": f"{_SIMPLE} {_SKIP}",
    "repair_plan": f"""{_REPAIR} SELECT * FROM (SELECT src_path AS file, raw_link, {_pointed('raw_link', 'link_type', "(bn || '.md')")} AS new_link, occ_ord FROM t WHERE esc OR coalesce(cands, 0) < 2) WHERE new_link <> raw_link""",
    "repair_on_disk": f"""{_REPAIR} SELECT * FROM (SELECT src_path AS file, raw_link, {_pointed('raw_link', 'link_type', "(bn || '.md')")} AS new_link, occ_ord FROM t
 WHERE (esc OR coalesce(cands, 0) < 2) AND (esc OR way NOT IN (SELECT path FROM n WHERE path IS NOT NULL))) WHERE new_link <> raw_link""",
    "repair_skipped": f"{_LOST} SELECT DISTINCT src_path AS file, raw_link, min(bn) AS basename, min(ps) AS candidates FROM t WHERE NOT esc AND cands >= 2 GROUP BY 1, 2",
    "convert_to_markdown": _convert_md(),
    "convert_to_wikilink": _convert_wiki(),
    "disambiguate_hub": f"""{_G}, {_LINKS}, {_hub('dst_key', 'note:')}, hp AS (SELECT k, substr(k, 11) AS path FROM hub)
SELECT * FROM (SELECT file, raw_link, {_pointed('raw_link', 'link_type', 'hp.path')} AS new_link, occ_ord FROM x, hp WHERE ((dst_key = hp.k AND bare) OR dst_key = 'phantom:name:' || {_note('hp.path')}) AND file <> hp.path) WHERE new_link <> raw_link""",
}
