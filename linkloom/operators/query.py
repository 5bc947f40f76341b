"""Queries over the graph: entries, neighbours at one and two hops, texts around them, figures and findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions.globs import Excludes
from linkloom.functions.paths import file_name, lower, note_name, trim
from linkloom.operators.extract import content_lines, frontmatter_end
from linkloom.operators.graph import Graph

#: Limits that hold where none is given.
MAX_BACKLINKS, MAX_VIAS, MAX_TARGETS = 100, 100, 10
#: Files that the message of an ambiguous name lists.
NAMED = 100
_SHOWN = ["type", "name", "path", "exists_flag"]


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Entry:
    """Where a query starts: exactly one of the four."""

    file: str | None = None
    tag: str | None = None
    phantom: str | None = None
    name: str | None = None


def find_entry(g: Graph, entry: Entry) -> Row:
    """The node of an entry, by a filter on its key or, for a name, by the same precedence that links have."""
    given = [k for k in ("file", "tag", "phantom", "name") if getattr(entry, k)]
    if len(given) != 1:
        raise QueryError("exactly one of file, tag, phantom and name must be given")
    kind, value = given[0], getattr(entry, given[0])
    key = F.lit(value)
    if kind == "file":
        found = g.nodes.filter(F.col("node_key").isin(f"note:path:{value}", f"asset:path:{value}")).orderBy(F.col("type").desc()).limit(1).collect()
        if not found:
            raise QueryError(f"file not found in index: {value}")
        return found[0]
    if kind in ("tag", "phantom"):
        name = value if kind == "phantom" or value.startswith("#") else f"#{value}"
        found = g.nodes.filter(F.col("node_key") == F.concat(F.lit(f"{kind}:name:"), lower(F.lit(name)))).limit(1).collect()
        if not found:
            raise QueryError(f"{kind} not found: {value}")
        return found[0]
    same = F.when(F.col("type") == "asset", lower(F.col("name")) == lower(key)).when(F.col("type") == "note", lower(F.col("name")) == lower(key)).otherwise(F.lit(False))
    tagged = (F.col("type") == "tag") & (lower(F.col("name")) == lower(F.concat(F.lit("#"), F.regexp_replace(key, r"\A#", ""))))
    ghost = (F.col("type") == "phantom") & (lower(F.col("name")) == lower(key))
    rank = F.when(F.col("type") == "note", 0).when(F.col("type") == "asset", 1).when(F.col("type") == "phantom", 2).otherwise(3)
    rows = g.nodes.filter(same | tagged | ghost).withColumn("rank", rank)
    best = rows.agg(F.min("rank")).first()[0]
    if best is not None:
        level = rows.filter(F.col("rank") == best).withColumn("root", F.coalesce(~F.col("path").contains("/"), F.lit(False)))
        first = level.orderBy(F.col("root").desc(), F.coalesce("path", "name")).limit(NAMED + 1).collect()
        root = [x for x in first if x.root]
        if len(first) == 1 or len(root) == 1:
            return (root if len(first) > 1 else first)[0]
        shown = sorted(x.path or x.name for x in first[:NAMED]) + ["..."] * (len(first) > NAMED)
        raise QueryError(f"ambiguous name: {value} ({', '.join(shown)})")
    raise QueryError(f"not found: {value}")


def _neighbours(g: Graph, edges: DataFrame, other: str, ex: Excludes) -> DataFrame:
    near = edges.select(F.col(other).alias("node_key")).distinct()
    return near.join(g.nodes, "node_key").filter(ex.keeps_path(F.col("path"))).select("node_key", *_SHOWN)


def _in_order() -> list[Column]:
    return [F.col("path").asc_nulls_first(), F.col("name").asc()]


def backlinks(g: Graph, key: str, limit: int = MAX_BACKLINKS, ex: Excludes = Excludes()) -> DataFrame:
    """The notes that link to a node, itself included if it does."""
    return _neighbours(g, g.edges.filter(F.col("dst_key") == key), "src_key", ex).orderBy(*_in_order()).limit(limit if limit > 0 else MAX_BACKLINKS)


def outgoing(g: Graph, key: str, ex: Excludes = Excludes()) -> DataFrame:
    """The notes, assets and phantoms that a note links to, itself left out."""
    out = g.edges.filter((F.col("src_key") == key) & (F.col("dst_key") != key))
    return _neighbours(g, out, "dst_key", ex).filter("type <> 'tag'").orderBy(*_in_order())


def leaf_tags(tags: Column) -> Column:
    """The tags of an array that aren't ancestors of another, in order."""
    return F.sort_array(F.filter(tags, lambda x: ~F.exists(tags, lambda y: y.startswith(F.concat(x, F.lit("/"))))))


def note_tags(g: Graph, ex: Excludes = Excludes(), key: str | None = None) -> DataFrame:
    """(src_key, tags): of each note, or of one, its tags without their ancestors."""
    own = g.edges if key is None else g.edges.filter(F.col("src_key") == key)
    tags = g.nodes.filter("type = 'tag'").filter(ex.keeps_tag(F.col("name"))).select(F.col("node_key").alias("dst_key"), "name")
    return own.select("src_key", "dst_key").distinct().join(tags, "dst_key").groupBy("src_key").agg(F.collect_set("name").alias("t")).select("src_key", leaf_tags(F.col("t")).alias("tags"))


def _top(paths: DataFrame, g: Graph, vias: int, per_via: int, ex: Excludes, by: list[str]) -> DataFrame:
    """Of (``by``, via_key, target_key) the first targets of each via, then the first vias that have one."""
    n = g.nodes.select("node_key", "type", "name", "path", "exists_flag", "node_ord")
    seen = n.filter(ex.keeps_path(F.col("path"))).select([F.col(c).alias(f"target_{c}") for c in ("node_key", *_SHOWN)]).withColumnRenamed("target_node_key", "target_key")
    via = n.filter(ex.keeps_via(F.col("type"), F.col("name"), F.col("path"))).select([F.col(c).alias(f"via_{c}") for c in ("node_key", "name", "node_ord")]).withColumnRenamed("via_node_key", "via_key")
    rows = paths.distinct().join(via, "via_key").join(seen, "target_key")
    rn = F.row_number().over(Window.partitionBy(*by, "via_key").orderBy(F.col("target_path").asc_nulls_first(), "target_name", "target_key"))
    first = rows.withColumn("pos", rn).filter(F.col("pos") <= per_via)
    rank = F.dense_rank().over(Window.partitionBy(*by).orderBy("via_node_ord", "via_key"))
    return first.withColumn("via_pos", rank).filter(F.col("via_pos") <= vias)


def two_hop(g: Graph, key: str, max_vias: int = MAX_VIAS, per_via: int = MAX_TARGETS, ex: Excludes = Excludes()) -> DataFrame:
    """(via_key, pos, target_key, ...): what shares a neighbour with the entry.

    From a note over what it links to, to all that link there too; from anything else over the notes that link to it,
    to all that these link to. The entry is no target, but may be its own via. A non-positive limit is the default.
    """
    vias_, per_via_ = (max_vias if max_vias > 0 else MAX_VIAS), (per_via if per_via > 0 else MAX_TARGETS)
    near, far = ("src_key", "dst_key") if key.startswith("note:") else ("dst_key", "src_key")
    seed = g.edges.filter(F.col(near) == key).select(F.col(far).alias("via_key")).distinct()
    paths = g.edges.select(F.col(far).alias("via_key"), F.col(near).alias("target_key")).filter(F.col("target_key") != key).join(seed, "via_key")
    return _top(paths.withColumn("entry", F.lit(key)), g, vias_, per_via_, ex, ["entry"])


def two_hop_all(edges: DataFrame, per_via: int = MAX_TARGETS) -> DataFrame:
    """(entry, via, pos, target) of every entry and via of (src, dst): the first ``per_via`` other sources of each via.

    The targets of a via are the same for all its entries but for the entry itself. So each via keeps its first
    ``per_via`` + 1 sources, which a group limit cuts before the shuffle, and these are joined to its entries: a hub
    costs its degree times the limit, not its degree squared.
    """
    once = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    rn = F.row_number().over(Window.partitionBy("dst").orderBy("src"))
    first = once.withColumn("rn", rn).filter(F.col("rn") <= per_via + 1).groupBy("dst").agg(F.sort_array(F.collect_list("src")).alias("tops"))
    near = once.join(first, "dst").select(F.col("src").alias("entry"), F.col("dst").alias("via"), F.slice(F.filter("tops", lambda x: x != F.col("src")), 1, per_via).alias("tops"))
    return near.select("entry", "via", F.posexplode("tops").alias("p", "target")).select("entry", "via", (F.col("p") + 1).cast("int").alias("pos"), "target")


def heads(notes: DataFrame, n: int) -> DataFrame:
    """(path, pos, line): the first ``n`` lines of each note, after frontmatter and blank lines."""
    lines = F.transform(content_lines(F.col("content")), lambda x: F.regexp_replace(x, r"\r\z", ""))
    rows = notes.filter("path is not null and content is not null").select("path", lines.alias("all"))
    end = frontmatter_end(F.col("all"))
    body = F.slice(F.col("all"), F.when(end > 0, end + 2).otherwise(F.lit(1)), F.size("all"))
    body = F.when(F.try_element_at(body, F.lit(-1)) == "", F.slice(body, F.lit(1), F.greatest(F.size(body) - 1, F.lit(0)))).otherwise(body)
    rows = rows.select("path", body.alias("body"))
    start = F.array_position(F.transform("body", lambda x: trim(x) != ""), True)
    cut = F.when(start > 0, F.slice(F.col("body"), start.cast("int"), F.lit(n))).otherwise(F.array().cast("array<string>"))
    return rows.select("path", F.posexplode(cut).alias("p", "line")).select("path", (F.col("p") + 1).cast("int").alias("pos"), "line")


def snippets(edges: DataFrame, notes: DataFrame, context: int) -> DataFrame:
    """(dst_key, source, line_start, line_end, lines): the text around each link, with ``context`` lines before and after.

    ``edges`` has (dst_key, source, line_start, line_end, occ_ord). Links without a known line have no snippet.
    """
    lines = notes.filter("path is not null and content is not null").select(F.col("path").alias("source"), F.transform(content_lines(F.col("content")), lambda x: F.regexp_replace(x, r"\r\z", "")).alias("all"))
    rows = edges.filter("line_start is not null and line_end is not null").join(lines, "source")
    a = F.greatest(F.col("line_start") - context, F.lit(1))
    z = F.least(F.col("line_end") + context, F.size("all"))
    return rows.filter(F.col("line_start") <= F.size("all")).select("dst_key", "source", "occ_ord", a.alias("line_start"), z.alias("line_end"), F.slice("all", a, z - a + 1).alias("lines"))


def stats(g: Graph) -> DataFrame:
    """One row of counts, the nodes in one pass."""
    n = g.nodes.agg(
        F.count_if(F.col("type") == "note").alias("notes_total"),
        F.count_if((F.col("type") == "note") & F.col("exists_flag")).alias("notes_exists"),
        F.count_if(F.col("type") == "tag").alias("tags_total"),
        F.count_if(F.col("type") == "phantom").alias("phantoms_total"),
        F.count_if(F.col("type") == "asset").alias("assets_total"),
    )
    e = g.edges.agg(F.count("*").alias("edges_total"))
    return n.join(e)  # one row and one row


def conflicts(g: Graph, kind: str = "note") -> DataFrame:
    """(name, paths): the files of a kind that share a name, by its lower-case form."""
    files = g.nodes.filter((F.col("type") == kind) & F.col("exists_flag"))
    pairs = files.groupBy(lower(F.col("name")).alias("key")).agg(F.sort_array(F.collect_list(F.struct("path", "name"))).alias("f")).filter(F.size("f") > 1)
    return pairs.select("key", F.element_at("f", 1)["name"].alias("name"), F.transform("f", lambda x: x["path"]).alias("paths")).orderBy("key").drop("key")


def phantoms(g: Graph) -> DataFrame:
    return g.nodes.filter("type = 'phantom'").select("name").orderBy("name")


def resolve_link(g: Graph, source: str, link: str) -> Row:
    """What a link as written in ``source`` means: the target of the occurrence that reads so. Raises if there is none."""
    from linkloom.operators.extract import occurrences
    from linkloom.operators.resolve import probed, resolved

    spark = g.nodes.sparkSession
    if not g.nodes.filter(F.col("node_key") == f"note:path:{source}").limit(1).collect():
        raise QueryError(f"source not in index: {source}")
    text = spark.createDataFrame([(source, link, 0)], "path string, content string, walk_ord long")
    occ = occurrences(text)
    same = [r.occ_ord for r in occ.orderBy((F.col("raw_link") != link).cast("int"), "occ_ord").limit(1).collect()]
    if not same:
        raise QueryError(f"not a link: {link}")
    one = probed(occ.filter(F.col("occ_ord") == same[0]))
    asked = one.select("space", "key").first()
    # of the files only those matter that the name or path can stand for, of the edges those of the source
    base = lower(file_name(F.col("path")))
    last = (asked["key"] or "").rsplit("/", 1)[-1]
    near = (base == last) | (base == f"{last}.md") | (lower(note_name(F.col("path"))) == last)
    hit = resolved(one.select(occ.columns), g.notes().filter(near), g.assets().filter(near))
    own = g.edges.filter(F.col("src_key") == f"note:path:{source}").select("src_key", "dst_key", F.coalesce("subpath", F.lit("")).alias("subpath"))
    found = (
        hit.select("src_key", "dst_key", "subpath")
        .join(own.distinct(), ["src_key", "dst_key", "subpath"])
        .join(g.nodes, F.col("dst_key") == F.col("node_key"))
        .select(*_SHOWN, "subpath")
        .limit(1)
        .collect()
    )
    if not found:
        raise QueryError(f"link not found in source: {link} in {source}")
    return found[0]
