"""The fixed schemas of the graph and of the tables that lead to it, as DDL."""

NODES = "node_key string, type string, name string, path string, exists_flag boolean, mtime long, node_ord long"
EDGES = "src_key string, dst_key string, link_type string, raw_link string, subpath string, line_start int, line_end int, occ_ord long"
FILES = "path string, content string, mtime long, walk_ord long"
EDGE_COLUMNS = ["src_key", "dst_key", "link_type", "raw_link", "subpath", "line_start", "line_end", "occ_ord"]
NODE_COLUMNS = ["node_key", "type", "name", "path", "exists_flag", "mtime", "node_ord"]
