"""Queries of the text index, the as-of owner by ranges, and the graph operators, over the given tables; each with SQL of its own.

The graph of pages: a host leads to each link of its pages, a link to the next one of its page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapperlake.operators import nesting, scan
from mapperlake.operators.components import Reach, strong_components
from mapperlake.operators.kernels import cut, cut_path
from mapperlake.operators.textindex import TextIndex
from mapperlake.streaming.maintained import MaintainedClosure

#: What is looked for: pieces of words, phrases, signs, words in other cases, two that no text has, and one too short for the index.
NEEDLES = ["License", "LICENSE", "permission is", "the", "tion on", "http", "@example", "mente", "ción", "über", "schen", "eaux", "ôt", "0123", "...", "and the", "st th", ". The ", "zzqqzzqq", "no such words anywhere", "qu"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def k_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of documents that hold one of NEEDLES in any case, by an index over all documents."""
    index = TextIndex.build(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return index.search(NEEDLES).select("needle", F.col("key").alias("doc_id"), "line")


def k_asof_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of documents with the last line at or before it, of its document, that starts with an upper-case T."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).select("doc_id", "line", F.startswith("t", F.lit("T")).alias("starts"))
    return scan.last_in_group(lines, "doc_id", ["line"], F.when(F.col("starts"), F.col("line"))).select("doc_id", "line", "owner")


#: Tags that are blocks in pages.
BLOCKS = "html|head|body|nav|ul|li|div|article|footer"
_EVENT = rf"</?(?:{BLOCKS})\b[^>]*>|<a href=\"[^\"]*\""


def k_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of pages with the block it stands in and that block's place among the page's tags."""
    events = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_EVENT), F.lit(0))).alias("k", "tag"))
    step = F.when(F.startswith("tag", F.lit("</")), -1).when(F.startswith("tag", F.lit("<a ")), 0).otherwise(1)
    about = F.struct(F.regexp_extract("tag", "^<([a-z]+)", 1).alias("name"), F.col("k").alias("at"))
    found = nesting.enclosing(events, "page_id", "k", step, about).where(F.startswith("tag", F.lit("<a ")))
    return found.select("page_id", "k", F.regexp_extract("tag", '"(.*)"', 1).alias("href"), F.col("block.name").alias("block"), F.col("block.at").alias("block_at"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst of the graph of pages."""
    links = F.regexp_extract_all("html", F.lit(r"""href=["']([^"']+)"""), F.lit(1))
    pages = _table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"), links.alias("links"))
    held = pages.select("host", F.posexplode("links").alias("k", "dst"), "links")
    before = F.when(F.col("k") > 0, F.get("links", F.col("k") - 1)).otherwise(F.col("host"))
    return held.select(F.explode(F.array_distinct(F.array("host", before))).alias("src"), "dst").distinct()


def k_components_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongly connected component of every host and link, named by its least member."""
    return strong_components(page_links(spark, sf_dir))


_reach: dict[tuple[str, str], tuple[DataFrame, Reach]] = {}


def page_reach(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Reach]:
    """The links of the graph of pages and what they reach, once for each application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _reach:
        _reach.clear()
        links = cut(page_links(spark, sf_dir))
        _reach[key] = links, Reach(links)
    return _reach[key]


def k_reach_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hosts and links each host and link leads to."""
    return page_reach(spark, sf_dir)[1].counts()


def k_reach_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each host of a blog leads to, from the bitmaps, and whether it leads back."""
    links, reach = page_reach(spark, sf_dir)
    found = reach.members(links.where(F.startswith("src", F.lit("blog."))).select(F.col("src").alias("node")))
    return reach.reaches(found.select("source", "target", F.col("target").alias("a"), F.col("source").alias("b"))).select("source", "target", F.col("reaches").alias("returns"))


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of edges between users: a user signs up to one of three further ones, or to one before; any other event of the two ends that. With the week they fall in."""
    k = F.get_json_object("props", "$.k").cast("int")
    to = F.col("user_id") + F.when(k > 95, -20).otherwise(1 + k % 3)
    at = F.struct("ts", "event_id")
    week = F.floor(F.datediff("ts", F.lit("2024-01-01")) / 7).cast("int")
    return _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("src"), to.cast("string").alias("dst"), (F.col("event_type") == "signup").alias("added"), at.alias("at"), week.alias("week"))


def k_maintained_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of the users' edges after the last week, kept up to date week by week."""
    changes = cut(event_changes(spark, sf_dir))
    kept = MaintainedClosure(spark, cut_path(spark, "closure"))
    for week in [r[0] for r in changes.select("week").distinct().orderBy("week").collect()]:  # a row a week
        kept.apply(changes.where(F.col("week") == week).drop("week"), week)
    return kept.pairs()


_LINKS = r"""p AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract_all(html, 'href=["'']([^"'']+)', 1) AS l FROM pages),
e AS (SELECT DISTINCT * FROM (SELECT host AS src, unnest(l) AS dst FROM p UNION ALL SELECT unnest(l[:-2]), unnest(l[2:]) FROM p) WHERE dst IS NOT NULL AND src IS NOT NULL),
r(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM r JOIN e ON b = src),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"""

QUERIES: dict[str, tuple[Callable, str]] = {
    "k_search_index": (
        k_search_index,
        f"""SELECT needle, doc_id, line::INTEGER AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents),
        (SELECT unnest([{", ".join("'" + n + "'" for n in NEEDLES)}]) AS needle) WHERE contains(lower(t), lower(needle))""",
    ),
    "k_asof_owner": (
        k_asof_owner,
        """SELECT doc_id, line::INTEGER AS line, (max(CASE WHEN t LIKE 'T%' THEN line END) OVER (PARTITION BY doc_id ORDER BY line))::INTEGER AS owner
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents)""",
    ),
    "k_enclosing": (
        k_enclosing,
        rf"""WITH t AS (SELECT page_id, unnest(m) AS tag, unnest(range(len(m)))::INTEGER AS k FROM (SELECT page_id, regexp_extract_all(html, '</?(?:{BLOCKS})\b[^>]*>|<a href="[^"]*"') AS m FROM pages)),
        d AS (SELECT *, CASE WHEN tag LIKE '</%' THEN -1 WHEN tag LIKE '<a %' THEN 0 ELSE 1 END AS step, sum(CASE WHEN tag LIKE '</%' THEN -1 WHEN tag LIKE '<a %' THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY k) AS depth FROM t),
        o AS (SELECT l.page_id, l.k, l.tag, max(b.k) AS at FROM d l LEFT JOIN d b ON b.page_id = l.page_id AND b.k < l.k AND b.step = 1 AND NOT EXISTS (SELECT 1 FROM d c WHERE c.page_id = l.page_id AND c.k > b.k AND c.k < l.k AND c.depth < b.depth) WHERE l.step = 0 GROUP BY ALL)
        SELECT o.page_id, o.k, regexp_extract(o.tag, '"(.*)"', 1) AS href, regexp_extract(b.tag, '^<([a-z]+)', 1) AS block, o.at AS block_at FROM o LEFT JOIN d b ON b.page_id = o.page_id AND b.k = o.at""",
    ),
    "k_components_directed": (k_components_directed, f"WITH RECURSIVE {_LINKS} SELECT node, least(node, (SELECT min(x.b) FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a = node)) AS component FROM n"),
    "k_reach_counts": (k_reach_counts, f"WITH RECURSIVE {_LINKS} SELECT node, count(b) AS n_reached FROM n LEFT JOIN r ON a = node GROUP BY node"),
    "k_reach_members": (k_reach_members, f"WITH RECURSIVE {_LINKS} SELECT a AS source, b AS target, EXISTS (SELECT 1 FROM r y WHERE y.a = r.b AND y.b = r.a) AS returns FROM r WHERE a LIKE 'blog.%'"),
    "k_maintained_closure": (
        k_maintained_closure,
        """WITH RECURSIVE c AS (SELECT user_id AS src, user_id + CASE WHEN k > 95 THEN -20 ELSE 1 + k % 3 END AS dst, event_type = 'signup' AS added, ts, event_id FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
        e AS (SELECT src, dst FROM (SELECT src, dst, added, row_number() OVER (PARTITION BY src, dst ORDER BY ts DESC, event_id DESC) AS n FROM c) WHERE n = 1 AND added),
        r(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM r JOIN e ON b = src) SELECT a::VARCHAR AS source, b::VARCHAR AS target FROM r""",
    ),
}
