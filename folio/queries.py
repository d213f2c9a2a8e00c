"""Registry of the core's queries; their SQL is in ``folio.oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import cases
from folio.css.match import css_count, css_select
from folio.css.plan import select_nodes
from folio.functions import charset, cookies, robots, site, text, url
from folio.functions.modules import resolve_specifier
from folio.html.nodes import html_nodes
from folio.operators import clock, corpus, dom, navigation, reading
from folio.operators.sites import host_of, page_sites
from folio.operators.timestamps import normalise_timestamps
from folio.oracles import ADDRESSES, COOKIES, EDGES, GLOBS, HOSTS, ROBOTS, SELECTORS, oracle_sql
from folio.session import prepare, spread, stage, table
from folio.sources.pages import page_list, route_responses, scrape_records
from folio.streaming.reader import tumbling_counts

__all__ = ["oracle_sql", "queries", "read_pages"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return f(prepare(spark), lambda name: table(spark, d, name))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    _QUERIES[f.__name__] = run
    return run


# ---- timestamps (problem 3)


def _timestamps(t) -> DataFrame:
    meta, sites = t("page_meta"), t("sites")
    values = meta.where("page_id is not null").select("page_id", F.explode(F.create_map(F.lit("published"), F.col("published"), F.lit("modified"), F.col("modified"))).alias("field", "value"))
    place = page_sites(t("pages"), t("render_report"), sites)
    return normalise_timestamps(values.where("value is not null").join(place, "page_id", "left"), sites)


@query
def p3_found(spark, t):
    """Dates of publication and change that name one instant, in seconds since 1970 UTC."""
    return _timestamps(t).where("utc_s is not null").select("page_id", "field", "utc_s").distinct()


@query
def p3_states(spark, t):
    """Every given date with the format it was read in and what became of it."""
    return _timestamps(t).select("page_id", "field", "value", "format", "utc_s", "state")


# ---- readings


@query
def read_pages(spark, t):
    """The reading of every page: metadata, article in Markdown, its length and confidence."""
    r = reading.read_page(F.col("html"), F.col("url"))
    return spread(t("pages")).select("page_id", "url", r.alias("r")).select("page_id", "url", "r.*")


@query
def read_json(spark, t):
    """One JSON record per page: its reading, or the error."""
    r = reading.read_page(F.col("html"), F.col("url"), images=False, with_links=False)
    rows = spread(t("pages")).select("page_id", "url", r.alias("r"))
    return rows.select("page_id", scrape_records(F.col("url"), F.col("r.error"), title=F.col("r.title"), content=F.col("r.content"), length=F.col("r.length"), low_confidence=F.col("r.low_confidence")).alias("record"))


@query
def page_metadata(spark, t):
    """Title, dates, canonical address, language and types as the page itself states them."""
    r = reading.read_page(F.col("html"), F.lit(None).cast("string"))
    out = spread(t("pages")).select("page_id", r.alias("r"))
    return out.select("page_id", "r.title", "r.published", "r.modified", "r.canonical_url", "r.language", F.array_join("r.schema_types", ",").alias("schema_types"))


@query
def source_or_rendered(spark, t):
    """Which markup is read: that which scripts left, or what the server sent where scripts emptied the page."""
    r = lambda c: reading.read_page(F.col(c), F.col("url"))
    rows = spread(t("pages")).select("page_id", r("html").alias("a"), r("source_html").alias("b"), F.octet_length("html").alias("size"))
    report = t("render_report").groupBy("page_id").agg(F.max("scripts_run").alias("scripts_run"), F.max("status").alias("status"))
    rows = rows.join(report, "page_id", "left")
    less = (F.col("a.length") < 500) | (2 * F.col("a.length") < F.col("b.length"))
    swap = F.coalesce((F.col("scripts_run") > 0) & less & (F.col("b.length") > F.col("a.length")), F.lit(False))
    length = F.when(swap, F.col("b.length")).otherwise(F.col("a.length"))
    content = F.when(swap, F.col("b.content")).otherwise(F.col("a.content"))
    blocked = F.when(length < 200, charset.block_reason(F.col("status"), F.col("size")))
    return rows.select("page_id", swap.alias("from_source"), length.alias("length"), blocked.alias("blocked"), F.when(blocked.isNotNull() & (F.trim(content) == ""), F.concat(F.lit("_Blocked: "), blocked, F.lit("._\n"))).otherwise(content).alias("content"))


@query
def page_links(spark, t):
    """Absolute links of every page, the first of each address."""
    rows = spread(t("pages")).select("page_id", F.posexplode(reading.links(F.col("html"), F.col("url"))).alias("n", "link"))
    return rows.select("page_id", F.col("n").cast("bigint").alias("n"), "link.href")


@query
def links_capped(spark, t):
    """The first 200 links of each page that lead somewhere: no fragments, no scripts."""
    rows = spread(t("pages")).select("page_id", F.explode(reading.links(F.col("html"), F.col("url"), limit=200, strict=True)).alias("link"))
    return rows.select("page_id", "link.text", "link.href")


@query
def page_assets(spark, t):
    """What every page pulls in, each address once."""
    return spread(t("pages")).select("page_id", F.explode(reading.assets(F.col("source_html"), F.col("url"))).alias("a")).select("page_id", "a.url", "a.kind", "a.rel")


@query
def page_prefetch(spark, t):
    """Scripts worth fetching early."""
    return spread(t("pages")).select("page_id", F.explode(reading.prefetch(F.col("source_html"), F.col("url"))).alias("url"))


@query
def serialized(spark, t):
    """Every page as its tree writes it."""
    return spread(t("pages")).select("page_id", reading.serialize(F.col("html")).alias("html"))


@query
def visible_text(spark, t):
    """Text of each page's body without scripts, and the same collapsed."""
    rows = spread(t("pages")).select("page_id", reading.visible_text(F.col("html")).alias("text"))
    return rows.select("page_id", "text", text.clean(F.col("text")).alias("collapsed"))


@query
def consent_free_text(spark, t):
    """Visible characters of each page without consent dialogs, by the ids and classes their vendors use."""
    nodes = stage(html_nodes(t("pages")).select("page_id", "node_id", "node_type", "tag", "attr", "path", "path_tags", "pre", "text"), "nodes")
    pattern = r"(?i)onetrust|optanon|ot-sdk|cookielaw|didomi|usercentrics|osano|trustarc|iubenda|cookie-?(banner|consent|notice|bar|law|policy|modal|popup|dialog|wall)|consent-?(banner|modal|manager|dialog|wall|popup|overlay)|gdpr|privacy-?(banner|modal|wall)"
    marked = nodes.where((F.col("node_type") == 1) & (F.try_element_at("attr", F.lit("class")).rlike(pattern) | F.try_element_at("attr", F.lit("id")).rlike(pattern)) & ~F.col("tag").isin("html", "body", "head", "link", "meta", "script", "style", "img", "input"))
    skip = ["script", "style", "noscript", "template", "svg", "head"]
    texts = nodes.where((F.col("node_type") == 3) & ~F.arrays_overlap("path_tags", F.array(*map(F.lit, skip))))
    inside = texts.select("page_id", "node_id", F.explode("path").alias("up")).join(marked.select("page_id", F.col("node_id").alias("up")), ["page_id", "up"], "left_semi").select("page_id", "node_id").distinct()
    kept = texts.join(inside, ["page_id", "node_id"], "left_anti")
    whole = kept.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda x: x["text"]), "").alias("text"))
    return whole.select("page_id", F.char_length(text.clean(F.col("text"))).cast("bigint").alias("characters"))


# ---- nodes and selectors


@query
def nodes(spark, t):
    """The node table of all pages."""
    return html_nodes(t("pages")).select("page_id", "node_id", "parent_id", "depth", "sib_idx", "pre", "post", "node_type", "tag", "text")


@query
def element_counts(spark, t):
    """Elements by tag over all pages, of tags that no rule repeats."""
    found = html_nodes(t("pages")).where("node_type = 1 and tag in ('div', 'h1', 'h2', 'h3', 'h4', 'ul', 'ol', 'li', 'blockquote', 'figure', 'nav', 'header', 'footer', 'aside', 'main', 'article', 'section', 'img', 'pre')")
    return found.groupBy("tag").agg(F.count("*").alias("elements"))


@query
def head_titles(spark, t):
    """Title of each page from the node table: the first title in the head."""
    n = stage(html_nodes(t("pages")).where("get(path_tags, 0) = 'head' or get(path_tags, 0) = 'title'"), "nodes")
    titles = n.where("node_type = 1 and tag = 'title' and get(path_tags, 0) = 'head'").groupBy("page_id").agg(F.min_by("node_id", "pre").alias("parent_id"))
    words = n.where("node_type = 3").join(titles, ["page_id", "parent_id"]).select("page_id", F.trim("text").alias("title"))
    return words


@query
def subtree_text(spark, t):
    """Characters of text below each article, main and section, from intervals."""
    n = stage(html_nodes(t("pages")).select("page_id", "node_id", "node_type", "tag", "path", "text"), "nodes")
    roots = n.where("node_type = 1 and tag in ('article', 'main', 'section')").select("page_id", "node_id", "tag")
    texts = n.where("node_type = 3").select("page_id", F.explode("path").alias("node_id"), F.char_length("text").alias("n"))
    return roots.join(texts, ["page_id", "node_id"], "left").groupBy("page_id", "node_id", "tag").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("characters"))


def _selection(name: str, selector: str):
    def run(spark, t):
        return spread(t("pages")).select("page_id", css_count(F.col("html"), selector).cast("bigint").alias("elements"))

    run.__name__, run.__doc__ = f"select_{name}", f"Elements of each page that match ``{selector}``."
    return query(run)


for _name, (_selector, _) in SELECTORS.items():
    _selection(_name, _selector)


def _plan(name: str, selector: str):
    def run(spark, t):
        nodes = html_nodes(t("pages"))
        if ":empty" not in selector:  # text nodes count there alone
            nodes = nodes.where("node_type = 1").drop("text")
        return select_nodes(stage(nodes, "nodes"), selector).select("page_id", "node_id", "tag", "pre")

    run.__name__, run.__doc__ = f"nodes_{name}", f"Rows of the node table that match ``{selector}``, as joins."
    return query(run)


for _name, _selector in {
    "descendant": "main p a", "child": "ul > li", "adjacent": "h1 + div", "sibling": "h2 ~ p", "nth": "li:nth-child(2n+1)", "last_of_type": "p:last-of-type", "not": "div:not([class])", "is": ":is(h1, h2, h3)",
    "has": "section:has(> h3)", "empty": "div:empty", "root": ":root", "attr_prefix": "a[href^='/t/']", "list": "nav li, footer p", "link": "a:any-link", "never": "p:hover",
}.items():
    _plan(_name, _selector)


@query
def selected_text(spark, t):
    """Texts of sub-headings, in order."""
    return spread(t("pages")).select("page_id", F.posexplode(css_select(F.col("html"), "h2, h3")).alias("n", "text")).select("page_id", "n", text.clean(F.col("text")).alias("text"))


@query
def nearest_ancestors(spark, t):
    """The three nearest ancestors of each table cell."""
    return html_nodes(t("pages")).where("tag = 'td'").select("page_id", "node_id", F.slice("path_tags", 1, 3).alias("above"))


@query
def element_siblings(spark, t):
    """Neighbouring elements of each sub-heading: the elements before and after it."""
    from pyspark.sql import Window

    w = Window.partitionBy("page_id", "parent_id").orderBy("elem_idx")
    e = html_nodes(t("pages")).where("node_type = 1").withColumn("before", F.lag("tag").over(w)).withColumn("after", F.lead("tag").over(w))
    return e.where("tag = 'h2'").select("page_id", "node_id", "before", "after")


@query
def dom_children(spark, t):
    """Element children of each body, in order."""
    n = stage(html_nodes(t("pages")), "nodes")
    return dom.children(n.where("node_type = 1"), n.where("tag = 'body'")).select("page_id", "node_id", "tag", "elem_idx")


@query
def dom_descendants(spark, t):
    """Elements below each list."""
    n = stage(html_nodes(t("pages")).where("node_type = 1"), "nodes")
    return dom.descendants(n, n.where("tag in ('ul', 'ol')")).groupBy("page_id", "ancestor_id").agg(F.count("*").alias("elements"))


@query
def dom_ancestors(spark, t):
    """Ancestors of each link, nearest first."""
    return dom.ancestors(html_nodes(t("pages")).where("tag = 'a'"))


@query
def dom_closest(spark, t):
    """Nearest block that each link stands in."""
    return html_nodes(t("pages")).where("node_type = 1 and tag = 'a'").select("page_id", "node_id", dom.closest(["p", "li", "td", "div"]).alias("block"))


@query
def dom_contains(spark, t):
    """Figures and what of their captions they contain, by intervals within a page."""
    n = stage(html_nodes(t("pages")).where("node_type = 1 and tag in ('figure', 'figcaption')").select("page_id", "node_id", "tag", "pre", "post"), "nodes")
    pairs = n.where("tag = 'figure'").alias("a").join(n.where("tag = 'figcaption'").alias("b"), F.expr("a.page_id = b.page_id")).where(dom.contains())
    return pairs.select("a.page_id", F.col("a.node_id").alias("figure"), F.col("b.node_id").alias("caption"))


@query
def dom_text(spark, t):
    """Text of each headline and of each body as shown."""
    n = stage(html_nodes(t("pages")).select("page_id", "node_id", "node_type", "tag", "pre", "text", "path", "path_tags"), "nodes")
    heads = dom.text_content(n, n.where("tag = 'h1'")).withColumn("of", F.lit("h1"))
    bodies = dom.rendered_text(n, n.where("tag = 'body'")).withColumn("of", F.lit("body"))
    return heads.unionByName(bodies).select("page_id", "node_id", "of", text.clean(F.col("text")).alias("text"))


@query
def meta_tags(spark, t):
    """What each page's meta elements declare."""
    return dom.meta_tags(html_nodes(t("pages")))


@query
def candidates(spark, t):
    """Blocks of each page that were scored for the article."""
    return spread(t("pages")).select("page_id", F.explode(reading.scored_blocks(F.col("html"))).alias("c")).select("page_id", "c.*")


@query
def sql_functions(spark, t):
    """The registered functions from SQL."""
    from folio.sql import register

    register(spark)
    t("pages").createOrReplaceTempView("folio_pages")
    return spark.sql("select page_id, size(css_select(html, 'li')) as items, url_parts(url).host as host, url_join(url, '/x?y#z') as target from folio_pages")


# ---- markup by expressions


@query
def page_title(spark, t):
    """Title as written, and without the site's name."""
    raw = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    title = text.clean(F.replace(F.replace(F.replace(raw, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&")))
    return t("pages").where("html is not null").select("page_id", title.alias("title"), text.strip_site_suffix(title).alias("headline"))


@query
def html_lang(spark, t):
    """Language that the html element states, if any."""
    lang = F.regexp_extract("html", r'(?i)<html[^>]*\slang="([^"]*)"', 1)
    return t("pages").where("html is not null").select("page_id", F.when(F.trim(lang) != "", lang).alias("lang"))


@query
def script_inventory(spark, t):
    """Scripts of each page: all, those that would run, those fetched, structured data."""
    tags = F.regexp_extract_all("source_html", F.lit(r"(?i)<script[^>]*>"), F.lit(0))
    kind = lambda s: F.lower(F.regexp_extract(s, r'(?i)type="([^"]*)"', 1))
    runs = F.filter(tags, lambda s: kind(s).isin("", "text/javascript", "application/javascript", "module"))
    count = lambda c: F.size(c).cast("bigint")
    return t("pages").where("source_html is not null").select(
        "page_id", count(tags).alias("scripts"), count(runs).alias("run"), count(F.filter(tags, lambda s: F.contains(s, F.lit("src=")))).alias("external"), count(F.filter(tags, lambda s: kind(s) == "application/ld+json")).alias("structured")
    )


@query
def seed_score(spark, t):
    """Prose score of each document's text."""
    return t("documents").select("doc_id", F.round(text.seed_score(F.coalesce("text", F.lit(""))), 4).alias("score"))


@query
def strip_site_suffix(spark, t):
    """Document titles without a closing site name."""
    return t("documents").where("title is not null").select("doc_id", text.strip_site_suffix(F.concat(F.col("title"), F.lit(" - "), F.coalesce("source", F.lit("")))).alias("title"))


@query
def truncate_chars(spark, t):
    """The first 300 characters of each text, cut at a word."""
    clean = F.regexp_replace("text", "[ \t\r\n]+", " ")
    return t("documents").where("text is not null").select("doc_id", text.truncate_chars(clean, 300).alias("summary"))


@query
def front_matter(spark, t):
    """YAML head of each page's metadata."""
    m = t("page_meta")
    size = F.char_length(F.coalesce("description", F.lit("")))
    return m.select("page_id", text.front_matter(*(F.col(c) for c in ("title", "author", "site_name", "published", "canonical_url", "description")), size, size < 50).alias("head"))


# ---- hosts and addresses


@query
def domain_counts(spark, t):
    """Pages by registrable domain."""
    return t("pages").groupBy(site.registrable_domain(host_of(F.col("url"))).alias("domain")).agg(F.count("*").alias("pages"))


@query
def host_site_relation(spark, t):
    """How the address that was asked for relates to the one that answered."""
    final = t("render_report").groupBy("page_id").agg(F.min("final_url").alias("final_url"))
    rows = t("pages").select("page_id", "url").join(final, "page_id")
    return rows.select("page_id", site.site_relation(F.col("url"), F.col("final_url")).alias("relation"), site.same_site(host_of(F.col("url")), host_of(F.col("final_url"))).alias("same_site"))


@query
def url_policy(spark, t):
    """Whether addresses may be fetched: those of responses, and test cases of each kind."""
    cases = spark.createDataFrame([(a,) for a in ADDRESSES], "url string")
    rows = t("responses").select("url").distinct().unionByName(cases)
    return rows.select("url", site.policy_error(F.col("url"), deny=["packet-notes.example"], v6=False).alias("error"))


@query
def url_policy_v6(spark, t):
    """The same with the longer addresses, which take an Arrow stage."""
    rows = t("responses").select("final_url").distinct()
    return rows.select("final_url", site.policy_error(F.col("final_url"), allow=["example"]).alias("error"))


@query
def tracker_flag(spark, t):
    """Hosts that only measure, advertise or chat."""
    cases = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    return t("pages").select(host_of(F.col("url")).alias("host")).distinct().unionByName(cases).select("host", site.is_tracker(F.col("host")).alias("tracker"))


@query
def url_resolved(spark, t):
    """Canonical addresses made absolute."""
    rows = t("page_meta").where("canonical_url is not null").join(t("pages").select("page_id", "url"), "page_id")
    return rows.select("page_id", url.url_join(F.col("url"), F.col("canonical_url")).alias("canonical"))


@query
def url_parts(spark, t):
    """Parts of final addresses."""
    rows = t("render_report").select("page_id", url.url_parts(F.col("final_url")).alias("u")).distinct()
    return rows.select("page_id", "u.scheme", "u.host", "u.path", "u.query")


@query
def page_site(spark, t):
    """Site of each page by the host of its final address."""
    return page_sites(t("pages"), t("render_report"), t("sites"))


@query
def robots_rules(spark, t):
    """Rules of a robots file at every site."""
    files = t("sites").select(F.col("site").alias("origin"), F.lit(ROBOTS).alias("body"))
    return robots.robots_rules(files).select("origin", "agent", "pattern", "allowed", F.col("ord").cast("bigint").alias("ord"))


@query
def robots_verdict(spark, t):
    """Whether each page's address may be visited."""
    files = t("sites").select(F.col("site").alias("origin"), F.lit(ROBOTS).alias("body"))
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?#]*)", 1)
    requests = t("pages").select("page_id", F.regexp_replace(host_of(F.col("url")), r"^www\.", "").alias("origin"), path.alias("path"))
    return robots.robots_allows(requests, robots.robots_rules(files), "examplebot/2.0").select("page_id", "path", "allowed")


@query
def glob_match(spark, t):
    """Addresses that fit patterns."""
    rows = t("pages").select("url").distinct()
    patterns = F.array(*map(F.lit, GLOBS))
    return rows.select("url", F.explode(F.filter(patterns, lambda p: text.glob_matches(F.col("url"), p))).alias("pattern"))


# ---- cookies and responses


def _jars(t) -> DataFrame:
    own = F.transform(F.filter("headers", lambda h: F.lower(h["name"]) == "set-cookie"), lambda h: h["value"])
    return t("responses").where("response_id is not null").groupBy("response_id").agg(F.min(own).alias("writes")).withColumn("jar", F.array_join("writes", "; "))


@query
def cookie_pairs(spark, t):
    """Cookies of each response as pairs in order."""
    return _jars(t).select("response_id", F.posexplode(cookies.cookie_pairs(F.col("jar"))).alias("n", "p")).select("response_id", F.col("n").cast("bigint").alias("n"), "p.name", "p.value")


@query
def cookie_fingerprint(spark, t):
    """Jars in comparable form, and how many responses have each."""
    return _jars(t).where("jar <> ''").groupBy(cookies.cookie_fingerprint(F.col("jar")).alias("fingerprint")).agg(F.count("*").alias("responses"))


@query
def cookie_candidates(spark, t):
    """Hosts and paths that a cookie of each address could belong to."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?#]*)", 1)
    rows = t("responses").select("url").distinct()
    return rows.select("url", F.array_join(cookies.domain_candidates(host_of(F.col("url"))), " ").alias("domains"), F.array_join(cookies.path_candidates(path), " ").alias("paths"))


@query
def cookie_writes(spark, t):
    """Jars after the writes of test cases and of responses."""
    cases = spark.createDataFrame([(k, j, w) for k, (j, w) in enumerate(COOKIES)], "id bigint, jar string, writes array<string>")
    rows = _jars(t).select("response_id", F.lit("s=1").alias("jar"), "writes").unionByName(cases.select((-1 - F.col("id")).alias("response_id"), "jar", "writes"))
    return rows.select("response_id", cookies.set_cookie(F.col("jar"), F.col("writes")).alias("jar"))


@query
def content_type_charset(spark, t):
    """Charset that each response declares."""
    return t("responses").select("response_id", charset.content_type_charset(charset.header(F.col("headers"), "Content-Type")).alias("charset")).distinct()


@query
def content_kind(spark, t):
    """Kind of each response and whether the pipeline can read it."""
    kind = charset.content_kind(charset.header(F.col("headers"), "content-type"), F.col("raw"))
    return t("responses").select("response_id", kind.alias("kind"), charset.is_readable(kind).alias("readable")).distinct()


@query
def meta_charset(spark, t):
    """Charset that the markup declares."""
    value = F.regexp_extract(F.substring("html", 1, 8192), r'(?i)<meta\s+charset="?([^">\s]+)', 1)
    return t("pages").where("html is not null").select("page_id", F.when(value != "", F.lower(value)).alias("charset"))


@query
def decoded_bodies(spark, t):
    """Raw bodies decoded by sniffing, against the text that was kept."""
    rows = t("responses").where("raw is not null").select("response_id", "body", charset.decode_body(F.col("raw"), charset.header(F.col("headers"), "content-type")).alias("d"))
    return rows.select("response_id", "d.charset", (F.col("d.text") == F.col("body")).alias("same"), F.char_length("d.text").alias("characters")).distinct()


@query
def body_limit(spark, t):
    """Bodies cut at 1000 bytes."""
    head, cut = charset.body_limit(F.encode("body", "utf-8"), 1000)
    return t("responses").where("body is not null").select("response_id", F.octet_length(head).cast("bigint").alias("kept"), cut.alias("cut")).distinct()


@query
def block_reason(spark, t):
    """Refusals by status."""
    sizes = t("pages").select("page_id", F.octet_length("html").alias("size"))
    rows = t("render_report").select("page_id", "status").distinct().join(sizes, "page_id")
    return rows.select("page_id", "status", charset.block_reason(F.col("status"), F.col("size")).alias("reason"))


@query
def canned_routes(spark, t):
    """Canned answers for each address."""
    routes = spark.createDataFrame([(1, "/api/json", 200, "application/json", "{}"), (2, "/api/", 200, "text/plain", "ok"), (3, "trois", 404, "text/html", "")], "ord int, pattern string, status int, content_type string, body string")
    return route_responses(t("responses").select("url").distinct(), routes)


@query
def listed_pages(spark, t):
    """Addresses of a list, blanks and remarks left out."""
    lines = t("pages").select(F.explode(F.array(F.concat(F.lit("  "), F.col("url"), F.lit(" ")), F.lit(""), F.concat(F.lit("# "), F.col("url")))).alias("value"))
    return page_list(lines)


# ---- reports and reads


@query
def scrape_outcomes(spark, t):
    """Every page with its record's kind: what was read, or why not."""
    r = t("render_report").groupBy("page_id").agg(F.max("status").alias("status"), F.min("content_kind").alias("content_kind"))
    rows = t("pages").select("page_id", "url").join(r, "page_id", "left")
    error = F.when(F.col("content_kind").isNull(), "no response").when(~charset.is_readable(F.col("content_kind")), F.concat(F.lit("not readable: "), F.col("content_kind"))).when(F.col("status") >= 400, F.concat(F.lit("status "), F.col("status").cast("string")))
    return rows.select("page_id", scrape_records(F.col("url"), error, kind=F.col("content_kind")).alias("record"))


@query
def batch_summary(spark, t):
    """Pages, time and failures of the whole batch, each page once."""
    r = t("render_report").groupBy("page_id").agg(F.max("total_ms").alias("ms"), F.max(F.coalesce(F.size("errors") > 0, F.lit(False))).alias("bad"))
    ms = F.greatest(F.sum("ms"), F.lit(1))
    return r.agg(F.count("*").alias("pages"), ms.alias("total_ms"), F.round(F.count("*") * 1000.0 / ms, 3).alias("pages_per_s"), F.count_if("bad").alias("failed"))


@query
def report_errors(spark, t):
    """Shapes of errors in the reports, by pages that show them."""
    rows = t("render_report").where("errors is not null").select("page_id", F.explode("errors").alias("e")).select("page_id", text.error_signature(F.col("e")).alias("signature")).distinct()
    return rows.groupBy("signature").agg(F.count("*").alias("pages"))


@query
def corpus_classify(spark, t):
    """Class of every read, deliveries counted once."""
    reads = corpus.dedup_deliveries(t("corpus_row"))
    return reads.select("read_id", corpus.classify(F.coalesce("text", F.lit(0)), F.coalesce("chrome_text", F.lit(0)), F.col("failure").isNotNull()).alias("class"))


@query
def corpus_class_counts(spark, t):
    """Reads and share by class."""
    return corpus.class_counts(corpus.dedup_deliveries(t("corpus_row")))


@query
def corpus_errors(spark, t):
    """The fifteen most frequent shapes of errors."""
    return corpus.error_counts(corpus.dedup_deliveries(t("corpus_row")))


@query
def corpus_failures(spark, t):
    """The eight most frequent reasons of refusals."""
    return corpus.top_failures(corpus.dedup_deliveries(t("corpus_row")))


@query
def latency_median_p90(spark, t):
    """Median and ninth decile of successful reads by site."""
    return corpus.latency(corpus.dedup_deliveries(t("corpus_row")), ["site"]).select("site", "reads", F.round("median_ms", 1).alias("median_ms"), "p90_ms")


@query
def read_medians(spark, t):
    """Median time of each page's successful reads, the first of each page left out as warm-up."""
    reads = corpus.dedup_deliveries(t("corpus_row")).where("status = 200 and ms is not null")
    return corpus.run_medians(reads, ["page_id"], "read_id", "ms")


@query
def fetch_patterns(spark, t):
    """Responses that patterns of address and kind would catch."""
    kind = charset.content_kind(charset.header(F.col("headers"), "content-type"), F.col("raw"))
    rows = t("responses").select("response_id", "url", kind.alias("kind")).distinct()
    hit = text.fetch_pattern_matches(F.col("url"), F.col("kind"), F.lit("*/api/*"), F.lit("JSON"))
    return rows.where(hit).select("response_id")


@query
def late_reads(spark, t):
    """Reads by site and days that they arrived late."""
    days = F.floor((F.unix_seconds(F.col("arrived_at").cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))) / 86400)
    return t("corpus_row").where("read_id is not null").groupBy("site", days.alias("days")).agg(F.countDistinct("read_id").alias("reads"))


@query
def feed_kinds(spark, t):
    """Feeds that pages declare, by kind."""
    return t("page_meta").where("feeds is not null").select("page_id", F.explode("feeds").alias("f")).groupBy("f.kind").agg(F.count("*").alias("feeds"), F.countDistinct("f.url").alias("addresses"))


@query
def schema_types(spark, t):
    """Declared types, by pages."""
    return t("page_meta").where("schema_types is not null").select("page_id", F.explode("schema_types").alias("type")).groupBy("type").agg(F.countDistinct("page_id").alias("pages"))


# ---- clock, chains, modules, windows


def _timers(t) -> DataFrame:
    delay = F.pmod(F.col("event_id") * 37, F.lit(15_000)).cast("bigint")
    return t("events").select("user_id", F.col("event_id").alias("timer_id"), delay.alias("delay_ms"), (F.col("event_type") == "view").alias("repeat"), F.when(F.col("event_type") == "error", "idle").otherwise("timeout").alias("kind"))


@query
def timer_fire_order(spark, t):
    """Timers that fire once, in the order of a virtual clock."""
    once = _timers(t).withColumn("repeat", F.lit(False))
    off = t("events").where("event_type = 'signup'").select("user_id", F.col("event_id").alias("timer_id"))
    out = clock.fire_order(once, off, keys=["user_id"])
    return out.select("user_id", "timer_id", "due_ms", F.col("rank").cast("bigint").alias("rank"))


@query
def timer_intervals(spark, t):
    """Firings of all repeating timers up to the horizon, which alone ends them: no budget per user does."""
    out = clock.fire_order(_timers(t).where("repeat"), max_fired=None, keys=["user_id"])
    return out.groupBy("user_id", "timer_id").agg(F.count("*").alias("fired"), F.max("due_ms").alias("last_ms"))


@query
def admitted_requests(spark, t):
    """Requests of each page within its budget."""
    return clock.admitted_requests(t("responses").select("page_id", "response_id").distinct(), ["page_id"], ["response_id"])


@query
def redirect_hops(spark, t):
    """Where chains of addresses end within three hops."""
    starts = spark.createDataFrame([(a,) for a, _ in EDGES], "start string")
    edges = spark.createDataFrame(EDGES, "url string, target string")
    return navigation.follow(starts, edges, 3).select("start", "url", F.col("hops").cast("bigint").alias("hops"), "stopped")


@query
def report_navigation(spark, t):
    """Pages whose scripts asked for another address, followed through the reports."""
    edges = t("render_report").where("requested_navigation is not null").select("url", F.col("requested_navigation").alias("target"))
    return navigation.follow(edges.select(F.col("url").alias("start")), edges, 5)


@query
def import_targets(spark, t):
    """Addresses that an import map gives to specifiers, for every page."""
    text_ = '{"imports": {"app": "/static/app.js", "lib/": "/static/lib/"}}'
    spec = F.explode(F.array(F.lit("app"), F.lit("lib/x.js"), F.lit("other")))
    rows = t("pages").select("page_id", "url", spec.alias("specifier"))
    return rows.select("page_id", "specifier", resolve_specifier(F.lit(text_), F.col("url"), F.col("specifier"), F.col("url")).alias("target"))


@query
def script_imports(spark, t):
    """Addresses that module sources name."""
    return spread(t("pages")).select("page_id", F.explode(reading.imports(F.col("source_html"))).alias("specifier"))


@query
def event_windows(spark, t):
    """Events by hour and type."""
    out = tumbling_counts(t("events"), "ts", ["event_type"])
    return out.select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start_s"), "event_type", "events")


# ---- cases


def _cases(spark, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query
def selector_cases(spark, t):
    """Ids of what each selector matches on one page, by the matcher."""
    page = _cases(spark, [(cases.SELECTOR_PAGE,)], "html string")
    found = page.select(*(css_select(F.col("html"), s, "html").alias(f"s{k}") for k, s in enumerate(cases.SELECTORS)))
    each = F.array(*(F.struct(F.lit(s).alias("selector"), F.col(f"s{k}").alias("found")) for k, s in enumerate(cases.SELECTORS)))
    ids = F.array_join(F.transform("c.found", lambda x: F.regexp_extract(x, 'id="([^"]*)"', 1)), " ")
    return found.select(F.explode(each).alias("c")).select("c.selector", ids.alias("ids"))


@query
def selector_join_cases(spark, t):
    """The same for combinators and structure, as joins over the node table."""
    nodes = stage(html_nodes(_cases(spark, [(1, cases.SELECTOR_PAGE)], "page_id bigint, html string")), "nodes")
    out = None
    for s in cases.SELECTORS_JOINED:
        one = select_nodes(nodes, s).select(F.lit(s).alias("selector"), F.try_element_at("attr", F.lit("id")).alias("id"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def markdown_cases(spark, t):
    """Markdown of each kind of block and inline element."""
    rows = _cases(spark, [r[:2] for r in cases.MARKDOWN], "name string, html string")
    return rows.select("name", reading.markdown(F.col("html"), F.lit("https://d.example/a/p")).alias("markdown"))


@query
def url_join_cases(spark, t):
    """Relative references against their bases."""
    rows = _cases(spark, [(k, *r[:2]) for k, r in enumerate(cases.JOINS)], "n bigint, base string, text string")
    return rows.select("n", url.url_join(F.col("base"), F.col("text")).alias("url"))


@query
def url_part_cases(spark, t):
    """Parts of addresses."""
    rows = _cases(spark, [(k, r[0]) for k, r in enumerate(cases.PARTS)], "n bigint, text string").withColumn("p", url.url_parts(F.col("text")))
    return rows.select("n", "p.scheme", "p.host", "p.path", "p.query", "p.fragment")


@query
def body_cases(spark, t):
    """Charset and text of bodies: marks, headers, meta elements, guesses."""
    rows = _cases(spark, [(r[0], bytearray(r[1]), r[2]) for r in cases.BODIES], "name string, raw binary, content_type string").withColumn("d", charset.decode_body(F.col("raw"), F.col("content_type")))
    return rows.select("name", "d.charset", "d.text")


@query
def kind_cases(spark, t):
    """Content kinds, declared and sniffed."""
    rows = _cases(spark, [(r[0], bytearray(r[1]), r[2]) for r in cases.KINDS], "name string, raw binary, content_type string")
    return rows.select("name", charset.content_kind(F.col("content_type"), F.col("raw")).alias("kind"))


@query
def refresh_cases(spark, t):
    """Targets of meta refreshes."""
    rows = _cases(spark, [r[:2] for r in cases.REFRESH], "name string, html string")
    return rows.select("name", reading.refresh_target(F.col("html"), F.lit("https://d.example/a/p")).alias("target"))


@query
def page_refreshes(spark, t):
    """Prompt refreshes that pages state, with the page that each leads to, if it is listed."""
    pages = t("pages")
    found = spread(pages).select("page_id", reading.refresh_target(F.coalesce("html", "source_html"), F.col("url")).alias("target")).where("target is not null")
    return found.join(pages.select(F.col("page_id").alias("target_id"), F.col("url").alias("target")), "target", "left").select("page_id", "target", "target_id")


@query
def link_cases(spark, t):
    """Links and early scripts of one page."""
    page = _cases(spark, [(cases.LINKS[0], "https://d.example/a/p")], "html string, url string")
    strict = page.select(F.lit("strict").alias("what"), F.posexplode(F.transform(reading.links(F.col("html"), F.col("url"), limit=200, strict=True), lambda x: x["href"])).alias("n", "href"))
    early = page.select(F.lit("prefetch").alias("what"), F.posexplode(reading.prefetch(F.col("html"), F.col("url"))).alias("n", "href"))
    return strict.unionByName(early).select("what", F.col("n").cast("bigint").alias("n"), "href")


@query
def module_cases(spark, t):
    """Addresses that module sources import."""
    rows = _cases(spark, [r[:2] for r in cases.MODULES], "name string, source string")
    return rows.select("name", F.array_join(reading.imports(F.col("source")), " ").alias("imports"))


@query
def metadata_cases(spark, t):
    """One field of the metadata of each head."""
    rows = _cases(spark, [r[:3] for r in cases.METADATA], "name string, html string, field string").withColumn("r", reading.read_page(F.col("html"), F.lit("https://d.example/a/p")))
    fields = sorted({r[2] for r in cases.METADATA})
    return rows.select("name", F.coalesce(*(F.when(F.col("field") == f, F.col(f"r.{f}")) for f in fields)).alias("value"))


@query
def tree_cases(spark, t):
    """Bodies as the tree builder makes them of loose markup."""
    rows = _cases(spark, [r[:2] for r in cases.NODES], "name string, html string")
    return rows.select("name", F.regexp_extract(reading.serialize(F.col("html")), "(?s)<body>(.*)</body>", 1).alias("body"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)
