"""Types of the node table and of readings."""

from __future__ import annotations

import pyarrow as pa

__all__ = ["LINK", "NODES", "NODES_SQL", "READING", "READING_SQL"]

_ATTR = pa.struct([("ns", pa.string()), ("name", pa.string()), ("value", pa.string())])
NODES = pa.schema([
    ("page_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("sib_idx", pa.int32()), ("elem_idx", pa.int32()), ("pre", pa.int32()), ("post", pa.int32()),
    ("node_type", pa.int16()), ("ns", pa.string()), ("tag", pa.string()), ("attrs", pa.list_(_ATTR)), ("attr", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
    ("path", pa.list_(pa.int32())), ("path_tags", pa.list_(pa.string())), ("fragment_of", pa.int32()),
])
NODES_SQL = (
    "page_id bigint, node_id int, parent_id int, depth int, sib_idx int, elem_idx int, pre int, post int, node_type smallint, ns string, tag string, "
    "attrs array<struct<ns: string, name: string, value: string>>, attr map<string, string>, text string, path array<int>, path_tags array<string>, fragment_of int"
)
_FEED = pa.struct([("url", pa.string()), ("title", pa.string()), ("kind", pa.string())])
LINK = pa.struct([("text", pa.string()), ("href", pa.string())])
READING = pa.struct([
    *((f, pa.string()) for f in ("title", "description", "author", "site_name", "published", "modified", "canonical_url", "image", "language", "robots")),
    ("feeds", pa.list_(_FEED)), ("schema_types", pa.list_(pa.string())), ("content", pa.string()), ("length", pa.int64()), ("low_confidence", pa.bool_()), ("score", pa.float64()), ("error", pa.string()),
])
READING_SQL = (
    "title string, description string, author string, site_name string, published string, modified string, canonical_url string, image string, language string, robots string, "
    "feeds array<struct<url: string, title: string, kind: string>>, schema_types array<string>, content string, length bigint, low_confidence boolean, score double, error string"
)
