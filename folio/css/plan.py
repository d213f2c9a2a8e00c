"""Selectors over the node table: compiled to joins on page and node ids, so Catalyst plans them.

Tests of one element are columns; combinators and nested selectors are semi- and anti-joins
with an equality on ``page_id`` and a node id, never a comparison of all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.css.match import _CONTROLS
from folio.css.parse import Complex, Compound, parse_selector

__all__ = ["select_nodes"]

_ID = ["page_id", "node_id"]


def select_nodes(nodes: DataFrame, selector: str) -> DataFrame:
    """Rows of the elements that match, outside template contents. Ids compare with case (the case-blind ids of old documents need a tree)."""
    elements = nodes.where("node_type = 1 and fragment_of is null")
    return _list(elements, nodes, parse_selector(selector))


def _list(elements: DataFrame, nodes: DataFrame, members) -> DataFrame:
    found = None
    for c in members:
        one = _complex(elements, nodes, c).select(*_ID)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return elements.where(F.lit(False))
    return elements.join(found.distinct() if len(members) > 1 else found, _ID, "left_semi")


def _complex(elements: DataFrame, nodes: DataFrame, c: Complex) -> DataFrame:
    out = _compound(elements, nodes, c.parts[0][1])
    for comb, compound in c.parts[1:]:
        right = _compound(elements, nodes, compound)
        if comb == ">":
            out = right.join(out.select("page_id", F.col("node_id").alias("parent_id")), ["page_id", "parent_id"], "left_semi")
        elif comb == " ":
            up = right.select(*_ID, F.explode("path").alias("up")).join(out.select("page_id", F.col("node_id").alias("up")), ["page_id", "up"], "left_semi")
            out = right.join(up.select(*_ID).distinct(), _ID, "left_semi")
        elif comb == "+":
            out = right.join(out.select("page_id", "parent_id", (F.col("elem_idx") + 1).alias("elem_idx")), ["page_id", "parent_id", "elem_idx"], "left_semi")
        else:
            first = out.groupBy("page_id", "parent_id").agg(F.min("elem_idx").alias("_first"))
            out = right.join(first, ["page_id", "parent_id"]).where("elem_idx > _first").select(*right.columns)
    return out


def _attr(name: str) -> Column:
    return F.try_element_at(F.col("attr"), F.lit(name))


def _attr_column(name: str, op: str, want: str | None, flag: str) -> Column:
    value = _attr(name)
    if not op:
        return value.isNotNull()
    w = F.lit(want)
    if flag == "i":
        value, w = F.lower(value), F.lit(want.lower())
    if op == "=":
        return value == w
    if op == "|=":
        return (value == w) | F.startswith(value, F.concat(w, F.lit("-")))
    if not want:
        return F.lit(False)
    if op == "~=":
        return F.array_contains(F.split(value, "[ \t\n\f\r]+"), w) & F.lit(not any(x in want for x in " \t\n\f\r"))
    return {"^=": F.startswith, "$=": F.endswith, "*=": F.contains}[op](value, w)


def _state(name: str) -> Column:
    tag = F.col("tag")
    has = lambda a: _attr(a).isNotNull()
    writable = tag.isin("input", "textarea") & ~has("readonly") & ~has("disabled")
    return {
        "root": F.col("depth") == 1, "scope": F.col("depth") == 1, "any-link": tag.isin("a", "area", "link") & has("href"), "link": tag.isin("a", "area", "link") & has("href"),
        "disabled": tag.isin(*_CONTROLS) & has("disabled"), "enabled": tag.isin(*_CONTROLS) & ~has("disabled"), "checked": (tag == "input") & has("checked") | (tag == "option") & has("selected"),
        "required": has("required"), "optional": tag.isin("input", "select", "textarea") & ~has("required"), "read-write": writable, "read-only": ~writable,
        "placeholder-shown": has("placeholder") & (F.coalesce(_attr("value"), F.lit("")) == ""), "defined": F.lit(True),
    }.get(name, F.lit(False))


def _compound(elements: DataFrame, nodes: DataFrame, compound: Compound) -> DataFrame:
    out = elements
    for test in compound.tests:
        kind = test[0]
        if kind == "tag":
            out = out.where(F.col("tag") == test[1])
        elif kind == "id":
            out = out.where(_attr("id") == test[1])
        elif kind == "class":
            out = out.where(F.array_contains(F.split(_attr("class"), "[ \t\n\f\r]+"), test[1]))
        elif kind == "attr":
            out = out.where(_attr_column(*test[1:]))
        elif kind == "pseudo" and test[1] == "empty":
            full = nodes.where("node_type = 1 or (node_type = 3 and text <> '')").select("page_id", F.col("parent_id").alias("node_id")).distinct()
            out = out.join(full, _ID, "left_anti")
        elif kind == "pseudo":
            out = out.where(_state(test[1]))
        elif kind in ("is", "not"):
            out = out.join(_list(elements, nodes, test[1]).select(*_ID), _ID, "left_semi" if kind == "is" else "left_anti")
        elif kind == "has":
            found = None
            for c in test[1]:
                one = _anchors(elements, nodes, c)
                found = one if found is None else found.unionByName(one)
            out = out.join(found.distinct(), _ID, "left_semi")
        elif kind in ("nth", "only"):
            out = out.join(_structural(elements, nodes, test), _ID, "left_semi")
        else:
            out = out.where(F.lit(False))
    return out


def _anchors(elements: DataFrame, nodes: DataFrame, c: Complex) -> DataFrame:
    """(page_id, node_id) from which a relative selector finds something; each compound is followed backwards."""
    cur = elements.select(*_ID, "parent_id", "elem_idx", "path").join(_compound(elements, nodes, c.parts[-1][1]).select(*_ID), _ID, "left_semi")
    full = elements.select(*_ID, "parent_id", "elem_idx", "path")
    for k in range(len(c.parts) - 1, -1, -1):
        comb = c.parts[k][0]
        if comb == ">":
            near = cur.select("page_id", F.col("parent_id").alias("node_id"))
        elif comb == " ":
            near = cur.select("page_id", F.explode("path").alias("node_id"))
        elif comb == "+":
            near = full.join(cur.select("page_id", "parent_id", (F.col("elem_idx") - 1).alias("elem_idx")), ["page_id", "parent_id", "elem_idx"], "left_semi").select(*_ID)
        else:
            last = cur.groupBy("page_id", "parent_id").agg(F.max("elem_idx").alias("_last"))
            near = full.join(last, ["page_id", "parent_id"]).where("elem_idx < _last").select(*_ID)
        near = near.distinct()
        if k == 0:
            return near.select(*_ID)
        cur = full.join(near, _ID, "left_semi").join(_compound(elements, nodes, c.parts[k - 1][1]).select(*_ID), _ID, "left_semi")
    return near


def _structural(elements: DataFrame, nodes: DataFrame, test: tuple) -> DataFrame:
    """Ids of the elements at the wanted place among their siblings."""
    of_type = test[1] if test[0] == "only" else test[2]
    keys = ["page_id", "parent_id", *(["tag", "ns"] if of_type else [])]
    own = elements
    if test[0] == "nth" and test[3].of:
        own = _list(elements, nodes, test[3].of)
    by = Window.partitionBy(*keys)
    if test[0] == "only":
        return own.withColumn("_n", F.count("*").over(by)).where("_n = 1").select(*_ID)
    order = F.col("elem_idx").desc() if test[1] else F.col("elem_idx")
    n = test[3]
    d = F.col("_n") - n.b
    want = d == 0 if not n.a else (d % n.a == 0) & (d / n.a >= 0)
    return own.withColumn("_n", F.row_number().over(by.orderBy(order))).where(want).select(*_ID)
