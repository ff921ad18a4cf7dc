"""Link graphs: extraction, numbering, adjacency, PageRank and HITS."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.url import anchors, normalize_url, remove_dot_segments
from ..storage import cut_lineage
from .ordered import numbered


def extract_links(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", dot_segments: bool = False) -> DataFrame:
    """page_id, link: the distinct normalized links of each page."""
    links = F.array_distinct(F.transform(anchors(html), lambda x: normalize_url(F.col(url), x)))
    out = pages.select(F.col(page_id).alias("page_id"), F.explode(links).alias("link"))
    return out.withColumn("link", remove_dot_segments("link")).distinct() if dot_segments else out


def build_link_ids(links: DataFrame, link: str = "link") -> DataFrame:
    """id, url: distinct URLs numbered from 0 in order.

    Ranges of URLs are numbered apart and shifted by the totals of those before, so that no task holds them all.
    """
    return numbered(links.select(F.col(link).alias("url")).distinct(), "url", name="id").select("id", "url")


def build_graph(links: DataFrame, ids: DataFrame) -> DataFrame:
    """src, dst: page_id and the number of each link that is known; others are dropped, self links stay."""
    return links.join(ids.select(F.col("url").alias("link"), F.col("id").alias("dst")), "link").select(F.col("page_id").alias("src"), "dst").distinct()


#: Targets in a piece of an adjacency list.
PIECE = 1 << 16


def adjacency(edges: DataFrame, piece: int = PIECE) -> DataFrame:
    """id, piece, nbrs: each source's targets in order, those of a hub in pieces of about ``piece`` by hash, so that no list is unbounded."""
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_n"))
    placed = edges.withColumnRenamed("src", "id").join(degree, "id")
    own = F.pmod(F.xxhash64("dst"), F.ceil(F.col("_n") / piece)).cast("int")
    return placed.groupBy("id", own.alias("piece")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))


def adjacency_text(edges: DataFrame, piece: int = PIECE) -> DataFrame:
    """A line a source (a piece of one): id, tab, targets joined by spaces."""
    return adjacency(edges, piece).select(F.concat_ws("\t", F.col("id").cast("string"), F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ")).alias("value"))


def pagerank(edges: DataFrame, n: int | None = None, n0: int | None = None, alpha: float = 0.9, max_iter: int = 15, tol: float = 0.005) -> DataFrame:
    """id, rank. Sources start with 1/n0, pure targets with 0; rank of nodes without links is shared by all.

    A round is one join of edges (with out-degree, stored once) with ranks and one sum by target; the mass of dangling nodes is
    a scalar. It ends after max_iter rounds or when the mean relative change of nodes that had rank is below tol.
    """
    spark = edges.sparkSession
    out = edges.groupBy("src").agg(F.count("*").alias("deg"))
    links = cut_lineage(edges.join(out, "src").select("src", "dst", "deg"))
    nodes = links.select(F.col("src").alias("id")).union(links.select(F.col("dst").alias("id"))).distinct()
    sources = links.select(F.col("src").alias("id")).distinct().withColumn("is_source", F.lit(True))
    nodes = cut_lineage(nodes.join(sources, "id", "left").select("id", F.coalesce("is_source", F.lit(False)).alias("is_source")))
    counts = nodes.agg(F.count("*").alias("n"), F.sum(F.col("is_source").cast("long")).alias("n0")).first()
    n, n0 = n or counts["n"], n0 or counts["n0"]
    if not counts["n"]:
        return spark.createDataFrame([], f"id {dict(edges.dtypes)['src']}, rank double")
    ranks = nodes.select("id", "is_source", F.when(F.col("is_source"), 1.0 / n0).otherwise(0.0).alias("rank"))
    for _ in range(max_iter):
        incoming = links.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("_in"))
        lost = ranks.where(~F.col("is_source")).agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        base = (1 - alpha) / n + alpha * lost / n
        moved = cut_lineage(ranks.join(incoming, "id", "left").select("id", "is_source", F.col("rank").alias("_was"), (F.lit(base) + alpha * F.coalesce("_in", F.lit(0.0))).alias("rank")))
        change = moved.where("_was > 0").agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("_was")) / F.col("_was")), F.lit(0.0))).first()[0]
        ranks = moved.drop("_was")
        if change / n0 < tol:
            break
    return ranks.select("id", "rank")


def hits(edges: DataFrame, iterations: int = 3) -> DataFrame:
    """id, auth, hub after rounds that each use the scores of the round before, all 1 at first, not normalized."""
    nodes = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    scores = cut_lineage(nodes.select("id", F.lit(1).cast("long").alias("auth"), F.lit(1).cast("long").alias("hub")))
    for _ in range(iterations):
        auth = edges.join(scores.select(F.col("id").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("auth"))
        hub = edges.join(scores.select(F.col("id").alias("dst"), "auth"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("auth").alias("hub"))
        zero = F.lit(0).cast("long")
        scores = cut_lineage(scores.select("id").join(auth, "id", "left").join(hub, "id", "left").select("id", F.coalesce("auth", zero).alias("auth"), F.coalesce("hub", zero).alias("hub")))
    return scores


def top_nodes(scores: DataFrame, column: str, n: int = 30) -> DataFrame:
    """The n highest, ties by id."""
    return scores.orderBy(F.desc(column), "id").limit(n)
