"""Crawl rules: groups of a robots file as rows, and the longest matching rule. Parsing is a query; only the exact wildcard search is Python."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.text import ascii_lower
from folio.session import hot_join

__all__ = ["path_matches", "robots_allows", "robots_rules"]

_TRIM = r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$"


def robots_rules(files: DataFrame) -> DataFrame:
    """(origin, agent, pattern, allowed, ord): one row for each rule and agent of its group.

    ``files``: (origin, body). A run of agent lines shares the rules after it; a bare ``Disallow:`` is no rule.
    Files that are null or hold no rule give no row.
    """
    rows = files.select("origin", F.posexplode(F.split("body", "\n")).alias("n", "line"))
    line = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", r"\r$", ""), "#.*$", ""), _TRIM, "")
    rows = rows.withColumn("line", line).where(F.contains("line", F.lit(":")))
    rows = rows.select("origin", "n", ascii_lower(F.regexp_replace(F.substring_index("line", ":", 1), _TRIM, "")).alias("field"), F.regexp_replace(F.regexp_replace("line", r"^[^:]*:", ""), _TRIM, "").alias("value"))
    rows = rows.where(F.col("field").isin("user-agent", "allow", "disallow"))
    by = Window.partitionBy("origin").orderBy("n")
    agent = F.col("field") == "user-agent"
    # an agent line that follows a rule opens a new group
    opens = agent & (F.lag(agent).over(by).isNull() | ~F.lag(agent).over(by))
    rows = rows.withColumn("grp", F.sum(opens.cast("int")).over(by))
    agents = rows.where(agent).select("origin", "grp", ascii_lower(F.col("value")).alias("agent"))
    rules = rows.where(~agent & ~((F.col("field") == "disallow") & (F.col("value") == ""))).select("origin", "grp", "n", F.col("value").alias("pattern"), (F.col("field") == "allow").alias("allowed"))
    return rules.join(agents, ["origin", "grp"]).select("origin", "agent", "pattern", "allowed", F.col("n").alias("ord"))


def _match(pattern: str, path: str) -> bool:
    """``*`` is any run; each piece is looked for from the left and never given back; a closing ``$`` is the end."""
    anchored = pattern.endswith("$")
    pieces = (pattern[:-1] if anchored else pattern).split("*")
    if not path.startswith(pieces[0]):
        return False
    at = len(pieces[0])
    for piece in pieces[1:]:
        found = path.find(piece, at)
        if found < 0:
            return False
        at = found + len(piece)
    return not anchored or at == len(path) or len(pieces) > 1 and not pieces[-1]


@F.arrow_udf(T.BooleanType())
def _matches(pattern: pa.Array, path: pa.Array) -> pa.Array:
    return pa.array([None if a is None or b is None else _match(a, b) for a, b in zip(pattern.to_pylist(), path.to_pylist())], pa.bool_())


def path_matches(pattern: Column, path: Column) -> Column:
    """Plain prefixes stay native; patterns with marks go to the exact search."""
    plain = ~F.contains(pattern, F.lit("*")) & ~F.endswith(pattern, F.lit("$"))
    return F.when(plain, F.startswith(path, pattern)).otherwise(_matches(F.when(~plain, pattern), path))


def robots_allows(requests: DataFrame, rules: DataFrame, user_agent: str) -> DataFrame:
    """``requests`` with ``allowed``: by the longest rule (in bytes) of the group that names the agent, else of ``*``; an allowing rule
    wins a tie; without a rule all is allowed.

    ``requests``: origin, path and any others. ``rules`` as from ``robots_rules``: a few rows per origin.
    """
    ua = user_agent.lower()
    own = rules.withColumn("specific", (F.col("agent") != "*") & F.contains(F.lit(ua), F.col("agent"))).where("specific or agent = '*'")
    own = own.withColumn("best", F.max("specific").over(Window.partitionBy("origin"))).where("specific = best").select("origin", "pattern", F.col("allowed").alias("_allows"))
    # one array of rules per origin: a request is joined once, whatever its origin's number of rules
    sets = own.groupBy("origin").agg(F.collect_list(F.struct(F.octet_length("pattern").alias("size"), F.col("_allows").alias("allows"), "pattern")).alias("_rules"))
    # an origin may hold a large part of all requests
    joined = hot_join(requests, sets, ["origin"], "path", how="left")
    marked = lambda r: F.contains(r["pattern"], F.lit("*")) | F.endswith(r["pattern"], F.lit("$"))
    verdict = lambda r: F.struct(r["size"].alias("size"), r["allows"].alias("allows"))
    plain = F.array_max(F.transform(F.filter("_rules", lambda r: ~marked(r) & F.startswith(F.col("path"), r["pattern"])), verdict))
    best = F.greatest(plain, _longest(F.col("path"), F.filter("_rules", marked)))  # nulls are passed over
    return joined.withColumn("allowed", F.coalesce(best["allows"], F.lit(True))).drop("_rules")


_VERDICT = pa.struct([("size", pa.int32()), ("allows", pa.bool_())])


@F.arrow_udf(T.StructType([T.StructField("size", T.IntegerType()), T.StructField("allows", T.BooleanType())]))
def _longest(path: pa.Array, rules: pa.Array) -> pa.Array:
    """Of the rules with marks that match, the longest, an allowing one first; null if none does."""
    out = []
    for p, rs in zip(path.to_pylist(), rules.to_pylist()):
        hits = [(r["size"], r["allows"]) for r in rs or () if p is not None and _match(r["pattern"], p)]
        out.append(dict(zip(("size", "allows"), max(hits))) if hits else None)
    return pa.array(out, _VERDICT)
