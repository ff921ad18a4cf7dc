"""Queries over clicks, robots rules, links and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as u
from ..operators import clicks, graph, robots
from ..sources.readers import packed_html, page_html
from .book import Book, Tables

#: The driver's tables have no click log: events name the query, pages the URL.
CLICKS_SQL = r"""
clicks AS (SELECT e.event_type AS query, p.url FROM events e JOIN pages p ON e.user_id = p.page_id),
counts AS (SELECT regexp_extract(url, '^\s*(?:http|https|ftp|file|jar)://([^/?#:]*)', 1) AS host, query, count(*) AS cnt FROM clicks GROUP BY ALL)"""
#: A rule table by part of the host, as none comes with the pages.
SITES_SQL = """
hosts AS (SELECT DISTINCT regexp_extract(url, '://([^/]*)', 1) AS host FROM pages),
sites AS (SELECT host, CASE CAST(len(host) AS BIGINT) % 4 WHEN 0 THEN ['/en'] WHEN 1 THEN ['*.html$', '*page='] WHEN 2 THEN ['/de/', 'feed$'] END AS rules FROM hosts),
split AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'Y' END AS disabled, regexp_extract(url, '://([^/]*)', 1) AS host,
                 CASE WHEN regexp_extract(url, '://[^/]*(.*)$', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/]*(.*)$', 1) END AS path FROM pages),
judged AS (
  SELECT s.*, coalesce(len(list_filter(sites.rules, lambda r: CASE
      WHEN starts_with(r, '/') THEN starts_with(s.path, r)
      WHEN starts_with(r, '*') AND ends_with(r, '$') THEN ends_with(s.path, r[2:len(r) - 1])
      WHEN starts_with(r, '*') THEN contains(s.path, r[2:]) ELSE ends_with(s.path, r[:len(r) - 1]) END)) > 0, false) AS is_disabled
  FROM split s LEFT JOIN sites USING (host))"""
LINKS_SQL = r"""
a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(<a.*?href=")(.*?)(")', 0)) AS whole, unnest(regexp_extract_all(html, '(<a.*?href=")(.*?)(")', 2)) AS link FROM pages),
n AS (SELECT page_id, replace(replace(replace(url, 'https:', 'http:'), 'www.', ''), ' ', '') AS b, replace(replace(replace(link, 'https:', 'http:'), 'www.', ''), ' ', '') AS l FROM a WHERE NOT contains(whole, 'mailto:')),
links AS (SELECT DISTINCT page_id, lower(regexp_replace(CASE WHEN starts_with(l, '//') THEN 'http:' || l
   WHEN starts_with(l, '/') THEN regexp_extract(b, '^([^/]*//[^/]*)', 1) || l WHEN contains(l, '://') THEN l ELSE regexp_replace(b, '/$', '') || '/' || l END, '/$', '')) AS link FROM n)"""
#: Suppliers link to the parts that they sold, parts that were returned link back: the others have no links.
EDGES_SQL = "edges AS (SELECT l_suppkey AS src, -1 - l_partkey AS dst FROM lineitem UNION SELECT -1 - l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')"


def click_table(t: Tables) -> DataFrame:
    return t.events.join(t.pages, F.col("user_id") == F.col("page_id")).select(F.col("event_type").alias("query"), "url")


def site_table(t: Tables) -> DataFrame:
    host, _ = u.split_host_path("url")
    kind = F.length("site") % 4
    rules = F.when(kind == 0, "Disallow: /en").when(kind == 1, "Disallow: *.html$\nDisallow: *page=").when(kind == 2, "Disallow: /de/\nDisallow: feed$")
    return t.pages.select(host.alias("site")).distinct().withColumn("robots", rules)


def flagged_pages(t: Tables) -> DataFrame:
    return t.pages.select("page_id", "url", F.when(F.col("page_id") % 3 == 0, "Y").alias("disabled"))


def edge_table(t: Tables) -> DataFrame:
    part = -1 - F.col("l_partkey")
    one = t.lineitem.select(F.col("l_suppkey").alias("src"), part.alias("dst"))
    return one.union(t.lineitem.where("l_returnflag = 'R'").select(part, "l_suppkey")).distinct()


def _pagerank_sql(rounds: int) -> str:
    steps = [f"""r{i} AS (SELECT v.id, v.is_source, (1 - 0.9) / (SELECT count(*) FROM nodes) + 0.9 * (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE NOT is_source) / (SELECT count(*) FROM nodes)
       + 0.9 * coalesce(x.s, 0) AS rank FROM nodes v LEFT JOIN (SELECT e.dst AS id, sum(r.rank / d.deg) AS s FROM edges e JOIN r{i - 1} r ON r.id = e.src JOIN deg d ON d.src = e.src GROUP BY e.dst) x USING (id))""" for i in range(1, rounds + 1)]  # fmt: skip
    return f"""WITH {EDGES_SQL}, deg AS (SELECT src, count(*) AS deg FROM edges GROUP BY src),
nodes AS (SELECT id, id IN (SELECT src FROM deg) AS is_source FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges)),
r0 AS (SELECT id, is_source, CASE WHEN is_source THEN 1.0 / (SELECT count(*) FROM deg) ELSE 0.0 END AS rank FROM nodes), {", ".join(steps)}
SELECT id, round(rank, 9) AS rank FROM r{rounds}"""


def _hits_sql(rounds: int) -> str:
    steps = [f"""h{i} AS (SELECT v.id, CAST(coalesce(a.s, 0) AS BIGINT) AS auth, CAST(coalesce(b.s, 0) AS BIGINT) AS hub FROM h{i - 1} v
      LEFT JOIN (SELECT e.dst AS id, sum(h.hub) AS s FROM edges e JOIN h{i - 1} h ON h.id = e.src GROUP BY e.dst) a USING (id)
      LEFT JOIN (SELECT e.src AS id, sum(h.auth) AS s FROM edges e JOIN h{i - 1} h ON h.id = e.dst GROUP BY e.src) b USING (id))""" for i in range(1, rounds + 1)]  # fmt: skip
    return f"WITH {EDGES_SQL}, h0 AS (SELECT id, 1 AS auth, 1 AS hub FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges)), {', '.join(steps)} SELECT id, auth, hub FROM h{rounds}"


def register(book: Book) -> None:
    book.add("f1_parse_clicks", lambda t: clicks.parse_clicks(t.pages.select(F.concat("url", F.when(F.col("page_id") % 5 == 0, "").otherwise("\t"), F.when(F.col("page_id") % 7 == 0, "").otherwise(F.lit("x"))).alias("value"))),
             "SELECT url AS query, 'x' AS url FROM pages WHERE page_id % 5 <> 0 AND page_id % 7 <> 0")
    book.add("a2_host_query_counts", lambda t: clicks.host_query_counts(click_table(t)), f"WITH {CLICKS_SQL} SELECT * FROM counts")
    book.add("f3_min_clicks", lambda t: clicks.host_query_counts(click_table(t)).where("cnt >= 100"), f"WITH {CLICKS_SQL} SELECT * FROM counts WHERE cnt >= 100")
    book.add("a3_best_query_per_host", lambda t: clicks.best_query_per_host(click_table(t), 10),
             f"WITH {CLICKS_SQL} SELECT host, query, cnt FROM counts WHERE cnt >= 10 QUALIFY row_number() OVER (PARTITION BY host ORDER BY cnt DESC, query) = 1")
    book.add("t1_secondary_sort", lambda t: clicks.queries_in_order(click_table(t)), f"WITH {CLICKS_SQL} SELECT host, query, cnt, row_number() OVER (PARTITION BY host ORDER BY query) AS place FROM counts")
    book.add("e2_url_host", lambda t: t.pages.select("page_id", u.url_host("url").alias("host")), r"SELECT page_id, regexp_extract(url, '^\s*(?:http|https|ftp|file|jar)://([^/?#:]*)', 1) AS host FROM pages")

    book.add("e3_split_host_path", lambda t: t.pages.select("page_id", u.split_host_path("url")[0].alias("host"), u.split_host_path("url")[1].alias("path")),
             "SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS host, regexp_extract(url, '://[^/]*(.*)$', 1) AS path FROM pages")
    book.add("e5_row_key", lambda t: t.pages.select("page_id", u.row_key("url").alias("row_key")), "SELECT page_id, md5(url) AS row_key FROM pages")
    book.add("j1_robots_disabled", lambda t: robots.robots_disabled(flagged_pages(t), site_table(t)).select("page_id", "host", "is_disabled"), f"WITH {SITES_SQL} SELECT page_id, host, is_disabled FROM judged")
    book.add("s7_robots_changes", lambda t: robots.robots_changes(flagged_pages(t), site_table(t)),
             f"WITH {SITES_SQL} SELECT md5(url) AS row_key, url, CASE WHEN is_disabled THEN 'put' ELSE 'delete' END AS op FROM judged WHERE is_disabled <> (disabled IS NOT NULL)")
    book.add("s7_apply_changes", lambda t: robots.apply_changes(flagged_pages(t), robots.robots_changes(flagged_pages(t), site_table(t))).select("page_id", "disabled"),
             f"WITH {SITES_SQL} SELECT page_id, CASE WHEN is_disabled THEN 'Y' END AS disabled FROM judged")
    book.add("j1_duplicate_sites", lambda t: robots.duplicate_sites(site_table(t).union(site_table(t).where("site like 'm.%'"))),
             f"WITH {SITES_SQL} SELECT host AS site, CAST(2 AS BIGINT) AS n FROM hosts WHERE host LIKE 'm.%'")
    book.add("s8_packed_pages", lambda t: t.pages.select("page_id", F.md5(page_html(packed_html("html"))).alias("page")), "SELECT page_id, md5(html) AS page FROM pages")
    book.add("e7_links_per_page", lambda t: t.pages.select("page_id", F.size(u.anchors("html")).cast("long").alias("n")),
             """SELECT page_id, CAST(len(list_filter(regexp_extract_all(html, '(<a.*?href=")(.*?)(")', 0), lambda x: NOT contains(x, 'mailto:'))) AS BIGINT) AS n FROM pages""")  # fmt: skip
    book.add("e6_extract_links", lambda t: graph.extract_links(t.pages), f"WITH {LINKS_SQL} SELECT * FROM links")
    book.add("e6_dot_segments", lambda t: t.pages.select("page_id", u.remove_dot_segments(F.concat("url", F.lit("/a/./b/../c"))).alias("url")))
    book.add("f4_site_scope", lambda t: t.pages.select("page_id", u.url_host("url").alias("host")).where(u.in_site("host", "ththon.example", "spam")),
             r"SELECT page_id, host FROM (SELECT page_id, regexp_extract(url, '^\s*(?:http|https)://([^/?#:]*)', 1) AS host FROM pages) WHERE contains(host, 'ththon.example') AND NOT contains(host, '.ththon.example') AND NOT contains(host, 'spam')")
    book.add("a5_link_ids", lambda t: graph.build_link_ids(graph.extract_links(t.pages)), f"WITH {LINKS_SQL} SELECT row_number() OVER (ORDER BY link) - 1 AS id, link AS url FROM (SELECT DISTINCT link FROM links)")
    book.add("g3_build_graph", lambda t: graph.build_graph(graph.extract_links(t.pages), graph.build_link_ids(graph.extract_links(t.pages).where("page_id % 2 = 0"))),
             f"WITH {LINKS_SQL}, ids AS (SELECT row_number() OVER (ORDER BY link) - 1 AS id, link FROM (SELECT DISTINCT link FROM links WHERE page_id % 2 = 0)) SELECT DISTINCT page_id AS src, id AS dst FROM links JOIN ids USING (link)")
    book.add("a4_adjacency", lambda t: graph.adjacency_text(edge_table(t)),
             f"WITH {EDGES_SQL} SELECT CAST(src AS VARCHAR) || chr(9) || string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS value FROM edges GROUP BY src")
    book.add("g1_pagerank", lambda t: graph.pagerank(edge_table(t), max_iter=4, tol=0.0).select("id", F.round("rank", 9).alias("rank")), _pagerank_sql(4))
    book.add("g2_hits", lambda t: graph.hits(edge_table(t)), _hits_sql(3))
    book.add("t4_top_pagerank", lambda t: graph.top_nodes(graph.pagerank(edge_table(t), max_iter=4, tol=0.0).select("id", F.round("rank", 9).alias("rank")), "rank"), _pagerank_sql(4) + " ORDER BY rank DESC, id LIMIT 30")
