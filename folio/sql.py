"""The functions that a query in SQL can use."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folio.css.match import Matcher
from folio.functions.charset import _decode
from folio.functions.url import _join, _parts
from folio.html.tree import parse
from folio.operators.reading import _reader, _udf
from folio.session import prepare

__all__ = ["register"]


def register(spark: SparkSession) -> None:
    """read_page(html, url), css_select(html, selector), visible_text(html), serialize_html(html), url_join(base, text), url_parts(text), decode_body(raw, content_type)."""
    prepare(spark)

    @F.arrow_udf("array<string>")
    def css_select(html: pa.Array, selector: pa.Array) -> pa.Array:
        known: dict = {}
        out = []
        for h, s in zip(html.to_pylist(), selector.to_pylist()):
            if s is None:
                out.append(None)
                continue
            if s not in known:
                known[s] = Matcher(s)
            tree = parse(h)
            out.append([tree.text_of(n) for n in known[s].all(tree)])
        return pa.array(out, pa.list_(pa.string()))

    for name, f in {"read_page": _reader(True, True, None), "css_select": css_select, "visible_text": _udf("visible"), "serialize_html": _udf("serialize"), "url_join": _join, "url_parts": _parts, "decode_body": _decode}.items():
        spark.udf.register(name, f)
