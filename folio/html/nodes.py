"""The node table: one row per node of each page, with interval positions and ancestor paths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.html.tree import ELEMENT, Tree, parse
from folio.schema import NODES, NODES_SQL
from folio.session import spread

__all__ = ["html_nodes", "node_rows"]


def node_rows(page_id: int, tree: Tree) -> list[tuple]:
    """Rows in document order; template contents follow with ``fragment_of`` set and a tree of their own."""
    rows: list[list] = []
    roots = [(0, None)] + [(f, t) for t, f in tree.content.items()]
    pre = 0
    for root, owner in roots:
        stack = [(root, 0, -1, 0, [], [])]
        while stack:
            node, depth, sib, elem, path, tags = stack.pop()
            if node < 0:
                rows[-node - 1][7] = pre
                pre += 1
                continue
            attrs = [(None, k, v) for k, v in tree.attrs[node]]
            plain: dict[str, str] = {}
            for _, k, v in attrs:
                plain.setdefault(k, v)
            rows.append([page_id, node, tree.parent[node] if tree.parent[node] >= 0 else None, depth, sib, elem, pre, 0, tree.kind[node], tree.ns[node], tree.tag[node],
                         [{"ns": n, "name": k, "value": v} for n, k, v in attrs], list(plain.items()), tree.text[node], path, tags, owner])
            pre += 1
            stack.append((-len(rows), 0, 0, 0, [], []))
            below, names = [node, *path], [tree.tag[node] or "", *tags]
            e = sum(tree.kind[k] == ELEMENT for k in tree.kids[node])
            for s in range(len(tree.kids[node]) - 1, -1, -1):
                kid = tree.kids[node][s]
                stack.append((kid, depth + 1, s, e if tree.kind[kid] == ELEMENT else 0, below, names))
                if tree.kind[kid] == ELEMENT:
                    e -= 1
    return rows


def html_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Node table of all pages with an id; null and empty pages have the implied html, head and body.

    ``elem_idx`` counts element siblings from 1 (0 for other nodes); ``path`` and ``path_tags`` list ancestors, nearest first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list = []
            for i, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += node_rows(i, parse(html))
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return spread(pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint"), html_col)).mapInArrow(run, NODES_SQL)


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(NODES)], schema=NODES)
