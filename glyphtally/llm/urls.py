"""URL filters with redirect equivalence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, small, table

#: Rules: hosts (with all their subdomains) and URL expressions that are blocked; URLs by expression that are allowed whatever else holds.
BLOCK_HOSTS = ("tionble.example.org", "therhe.example.org")
BLOCK_PATTERNS = (r"^[a-z]+://([^/?#]*\.)?(spam-farm|cheap-pills|free-bets|adult-x|casino-win|ads-track)\.", r"[?&]ref=x(&|$)", r"/(casino|adult|malware)/")
ALLOW_PATTERNS = (r"^https://[^/?#]+/en/[0-9]*0([./?#]|$)",)
#: Query parameters that name no other page.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid|mc_[a-z]+|session(id)?)"


def normal(url: Column) -> Column:
    """The key of a URL: no scheme, user, fragment, default port, tracking parameters or final slash; host in lower case, parameters as they come."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    u = F.regexp_replace(u, r"^//", "")
    rest = F.regexp_extract(u, r"^[^/?]*(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^([^/?]*)", 1)), r"^[^@]*@", ""), r":(80|443)$", "")
    rest = F.regexp_replace(rest, rf"([?&]){TRACKING}=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"&+", "&"), r"\?&", "?")
    rest = F.regexp_replace(F.regexp_replace(rest, r"[?&]+$", ""), r"/+$", "")
    return F.concat(F.regexp_replace(host, r"\.$", ""), rest)


def without_dots(path: Column) -> Column:
    """path without its . and .. segments (RFC 3986, 5.2.4)."""
    segments = F.split(F.regexp_replace(path, r"(^|/)(\.\.?)$", "$1$2/"), "/", -1)

    def step(acc, x):
        up = F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        return F.when(x == ".", acc).when(x == "..", up).otherwise(F.concat(acc, F.array(x)))

    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")).otherwise(path)


def resolve(link: Column, base: Column) -> Column:
    """The URL that a reference on the page base means (RFC 3986, 5.2.2), without its fragment; one with a scheme of its own stays as it is."""
    link = F.regexp_replace(F.trim(F.regexp_replace(link, "&amp;", "&")), "#.*$", "")
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:"

    def parts(u):
        rest = F.regexp_replace(u, scheme, "")
        return F.regexp_extract(u, scheme, 0), F.regexp_extract(rest, r"^//[^/?#]*", 0), F.regexp_extract(rest, r"^(?://[^/?#]*)?([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)?", 1)

    own, host, path, query = parts(link)
    base_scheme, base_host, base_path, base_query = parts(F.trim(base))
    folder = F.when((base_host != "") & (base_path == ""), "/").otherwise(F.regexp_extract(base_path, r"^(.*/)?", 0))
    return (
        F.when(own != "", F.concat(own, host, without_dots(path), query))
        .when(host != "", F.concat(base_scheme, host, without_dots(path), query))
        .when(path == "", F.concat(base_scheme, base_host, base_path, F.when(query != "", query).otherwise(base_query)))
        .when(path.startswith("/"), F.concat(base_scheme, base_host, without_dots(path), query))
        .otherwise(F.concat(base_scheme, base_host, without_dots(F.concat(folder, path)), query))
    )


def links(pages: DataFrame) -> DataFrame:
    """(src, dst) URLs: what pages give as their canonical address or as where they redirect to."""
    tags = F.regexp_extract_all("html", F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), 1)
    tag = F.col("tag")
    attr = lambda name: F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*[\"']?([^\"'>]*?)[\"'/]?(?:[\s>]|\"|')", 1)
    target = (
        F.when(tag.rlike(r"(?i)^<link") & tag.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b"), attr("href"))
        .when(tag.rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract(tag, r"(?i)url\s*=\s*['\"]?([^'\">\s]+)", 1))
        .when(tag.rlike(r"(?i)property\s*=\s*[\"']?og:url\b"), attr("content"))
    )
    # most pages have no such tag: a quick test before the tags are parsed
    low = F.lower("html")
    may = reduce(lambda a, b: a | b, [low.contains(x) for x in ("canonical", "refresh", "og:url")])
    found = pages.where(may & F.col("url").isNotNull()).select("url", F.explode(tags).alias("tag")).select("url", target.alias("target")).where("target <> ''")
    # mail addresses and scripts are no pages
    return found.select(F.col("url").alias("src"), resolve(F.col("target"), F.col("url")).alias("dst")).where(F.col("dst").rlike("(?i)^https?://"))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(url, r"^(https?://)(www|m)\.", "$1")


def bare_path(url: Column) -> Column:
    return F.regexp_replace(url, r"^([^?#]*?)(\.html|/)([?#].*)?$", "$1$3")


def implied(pages: DataFrame) -> DataFrame:
    """(src, dst) URLs of redirects that follow from pages themselves, for a crawl that kept none.

    A host that begins with www. or m. redirects to the one without; from there, a path that ends in .html or a slash to
    the one without. Pages with the same article have the least of their URLs as the canonical one. The articles' hashes
    are counted before and after the shuffle; pages whose article nobody shares are dropped before they are joined.
    """
    u = F.col("url")
    first, second = bare_host(u), bare_path(bare_host(u))
    hops = F.filter(F.array(F.struct(u.alias("src"), first.alias("dst")), F.struct(first.alias("src"), second.alias("dst"))), lambda x: x["src"] != x["dst"])
    article = F.regexp_extract("html", r"(?s)<article\b[^>]*>(.*?)</article>", 1)
    keyed = cut(pages.where("url IS NOT NULL").select("url", F.when(article != "", F.md5(article)).alias("article"), hops.alias("hops")))
    shared = cut(keyed.where("article IS NOT NULL").groupBy("article").agg(F.min("url").alias("dst"), F.count("*").alias("n")).where("n > 1").select("article", "dst"))
    same = keyed.join(small(shared), "article").select(F.col("url").alias("src"), "dst").where("src <> dst")
    return keyed.select(F.inline("hops")).union(same)


def matches(url: Column, hosts=(), patterns=()) -> Column:
    host = F.lower(F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1), r"\.$", ""))
    tests = [(host == h) | host.endswith("." + h) for h in hosts] + [url.rlike(p) for p in patterns]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False)) if tests else F.lit(False)


def decide(pages: DataFrame, redirects: DataFrame | None = None, block_hosts=BLOCK_HOSTS, block_patterns=BLOCK_PATTERNS, allow_patterns=ALLOW_PATTERNS) -> DataFrame:
    """(page_id, url, node, root, decision) of each row of pages.

    Nodes are normalised URLs. Edges are the pages' canonical links, refreshes and og:url, and redirects (src, dst), if
    given; their connected components are aliases. A page whose URL matches an allow rule is "allow", whatever else
    holds; else one whose URL, or that of any alias on pages or in an edge, matches a block rule is "block"; all others
    are "keep". An allow rule speaks for the URLs it matches, not for their aliases. root is the least node of the
    component, the node itself where it has no edges.

    Rows with a null url are kept, with null node and root; null or empty html has no links; an empty url is a node.
    Repeated rows and ids come back as often as they are. Columns other than page_id, url and html aren't looked at.
    An empty table gives no rows. Only nodes with edges go through the components' rounds, by numbers.
    """
    src = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = links(src)
    if redirects is not None:
        edges = edges.union(redirects.select(F.col("src").cast("string"), F.col("dst").cast("string")))
    bad = lambda u: matches(u, block_hosts, block_patterns)
    a, b = F.col("src"), F.col("dst")
    named = cut(edges.where("src IS NOT NULL AND dst IS NOT NULL").select(normal(a).alias("a"), bad(a).alias("a_bad"), normal(b).alias("b"), bad(b).alias("b_bad")).distinct())
    # numbers of the rows as they are written: no two nodes share one
    ends = cut(named.selectExpr("a AS node", "a_bad AS bad").union(named.selectExpr("b", "b_bad")).groupBy("node").agg(F.max("bad").alias("bad")).withColumn("id", F.monotonically_increasing_id()))
    number = lambda c: ends.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
    roots = components(named.select("a", "b").distinct().join(number("a"), "a").join(number("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    member = ends.join(roots.withColumnRenamed("node", "id"), "id")
    least = member.groupBy("root").agg(F.min("node").alias("name"))
    alias = cut(member.join(least, "root").select("node", "name", F.col("bad").alias("edge_bad")))
    nodes = src.select("page_id", "url", normal(F.col("url")).alias("node"), bad(F.col("url")).alias("bad"), matches(F.col("url"), (), allow_patterns).alias("good"))
    own = nodes.groupBy("node").agg(F.max("bad").alias("bad"))
    both = own.join(alias, "node", "full").select("node", F.coalesce("name", "node").alias("name"), (F.coalesce("bad", F.lit(False)) | F.coalesce("edge_bad", F.lit(False))).alias("bad"))
    any_bad = both.groupBy("name").agg(F.max("bad").alias("bad"))
    groups = both.drop("bad").join(any_bad, "name").where("node IS NOT NULL").select(F.col("node").alias("_n"), F.col("name").alias("root"), F.col("bad").alias("_bad"))
    out = nodes.join(groups, F.col("node") == F.col("_n"), "left")
    decision = F.when(F.col("good"), "allow").when(F.col("_bad"), "block").otherwise("keep")
    return out.select("page_id", "url", "node", "root", decision.alias("decision"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' own links, and the redirects that implied() finds: the tables have no others."""
    pages = table(spark, sf_dir, "pages")
    return decide(pages, implied(pages))


def _normal(u: str) -> str:
    u = rf"regexp_replace(regexp_replace(trim({u}), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    host = rf"regexp_replace(regexp_replace(lower(regexp_extract({u}, '^([^/?]*)', 1)), '^[^@]*@', ''), ':(80|443)$', '')"
    rest = rf"regexp_replace(regexp_extract({u}, '^[^/?]*(.*)$', 1), '([?&]){TRACKING}=[^&]*', '\1', 'g')"
    return rf"{host} || regexp_replace(regexp_replace(regexp_replace(regexp_replace({rest}, '&+', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', ''), '/+$', '')"


def _bad(u: str) -> str:
    host = rf"lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)', 1))"
    return "(" + " OR ".join([f"{host} = '{h}' OR suffix({host}, '.{h}')" for h in BLOCK_HOSTS] + [f"regexp_matches({u}, '{p}')" for p in BLOCK_PATTERNS]) + ")"


#: The tables' pages have no canonical links and no refreshes of their own, which the last line checks; the edges are those of implied().
SQL = rf"""
WITH RECURSIVE p AS (SELECT page_id, url, html, regexp_extract(html, '(?s)<article\b[^>]*>(.*?)</article>', 1) AS article, regexp_replace(url, '^(https?://)(www|m)\.', '\1') AS u1 FROM pages),
q AS (SELECT *, regexp_replace(u1, '^([^?#]*?)(\.html|/)([?#].*)?$', '\1\3') AS u2 FROM p),
c AS (SELECT article, min(url) AS u FROM p WHERE article <> '' GROUP BY article HAVING count(*) > 1),
d AS (SELECT url AS a, u1 AS b FROM q UNION ALL SELECT u1, u2 FROM q UNION ALL SELECT url, u FROM q JOIN c USING (article)),
e AS (SELECT DISTINCT {_normal("a")} AS a, {_normal("b")} AS b FROM d),
g AS (SELECT node, bool_or(bad) AS bad FROM (SELECT {_normal("a")} AS node, {_bad("a")} AS bad FROM d UNION ALL SELECT {_normal("b")}, {_bad("b")} FROM d) GROUP BY node),
r(node, root) AS (SELECT node, node FROM g UNION SELECT x.b, r.root FROM r JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) x ON x.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node),
k AS (SELECT root, bool_or(bad) AS bad FROM m JOIN g USING (node) GROUP BY root)
SELECT page_id, url, z.node, m.root, CASE WHEN {" OR ".join(f"regexp_matches(url, '{x}')" for x in ALLOW_PATTERNS)} THEN 'allow' WHEN k.bad THEN 'block' ELSE 'keep' END AS decision
FROM (SELECT page_id, url, {_normal("url")} AS node FROM pages) z JOIN m ON m.node = z.node JOIN k ON k.root = m.root
WHERE NOT (SELECT bool_or(regexp_matches(lower(html), 'rel\s*=\s*["'']?canonical|http-equiv\s*=\s*["'']?refresh|og:url')) FROM pages)
"""
