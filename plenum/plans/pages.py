"""Rows out of pages: outlines, calendars of meetings, narrative chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions.text import dutch_date_text
from plenum.operators.relops import spread
from plenum.plans.registry import query
from plenum.sources.chunks import narrative_chunks
from plenum.sources.html import calendar, nodes

TAGS = ["a", "li", "ul", "p", "h1", "div", "article", "nav", "b", "br", "script", "title"]


@query(
    "WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--(.|\\n)*?-->', '', 'g'), '(<script[^>]*>)(.|\\n)*?(</script>)', '\\1\\3', 'g') AS html FROM pages), c AS ("
    + " UNION ALL ".join(f"SELECT page_id, '{t}' AS tag, len(regexp_extract_all(html, '(?i)<{t}[\\s>/]')) AS n FROM p" for t in TAGS)
    + ") SELECT page_id, tag, n FROM c WHERE n > 0"
)
def page_tags(t):
    """How many elements of each kind a page has; what stands in scripts and comments is none."""
    rows = nodes(spread(t.pages), "page_id", "html").filter(F.col("tag").isin(TAGS))
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query()
def page_outline(t):
    """Every element and text of every page with its depth and the place of what it stands in."""
    rows = nodes(spread(t.pages), "page_id", "html")
    return rows.select("page_id", "at", "tag", F.size("within").alias("depth"), F.try_element_at("within", F.lit(-1)).alias("parent"), "href", F.md5("text").alias("text_hash"))


@query("""WITH d AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS p, o_orderkey % 5 AS v FROM orders)
SELECT o_custkey AS page_id, CAST(o_orderkey AS VARCHAR) AS meeting, 'Commissie ' || p || CASE WHEN v IN (1, 2) THEN ' — Startberaad & gesprek' ELSE '' END AS name, 'Commissie ' || p AS committee, CASE WHEN v < 4 THEN 'zaal ' || o_orderkey % 9 END AS location,
CASE WHEN v IN (1, 2) THEN 'Startberaad & gesprek' END AS subtitle, CASE WHEN v <> 3 THEN CAST(CAST(d AS TIMESTAMP) + to_hours(CASE WHEN v = 2 THEN 0 ELSE 9 + o_orderkey % 3 END) AS VARCHAR) END AS start FROM d""")
def calendar_meetings(t):
    """The meetings of calendar pages: a page for each customer, its cards nested in days, some without a place, a time or a day; later cards, addresses and
    boilerplate in between don't leak into a meeting."""
    v, day = F.col("o_orderkey") % 5, F.to_date("o_orderdate")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    number = F.col("o_orderkey").cast("string")
    place = F.when(v < 4, text("<span>(zaal ", (F.col("o_orderkey") % 9).cast("string"), ")</span>")).otherwise("")
    subtitle = F.when(v.isin(1, 2), "<em>Startberaad &amp; gesprek</em>").otherwise("")
    when = F.when(v != 3, text("<p>Maandag ", dutch_date_text(day), "</p>")).otherwise("")
    hour = (9 + F.col("o_orderkey") % 3).cast("string")
    time = F.when(v != 2, text("<p>", hour, ":00 - ", hour, ":45</p>")).otherwise("")
    again = text("<p>griffie@stad.nl</p><a href='/Agenda/Index/", number, "'><b>Naar de agenda</b></a>")
    card = text("<div class=card><h3><a href=\"/Agenda/Index/", number, "\">Commissie ", F.col("o_orderpriority"), "</a></h3>", place, subtitle, when, time, again, "</div>")
    pages = t.orders.select("o_custkey", text("<li class='day'>", card, "<p>dinsdag</p></li>").alias("card")).groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_join(F.collect_list("card"), "\n").alias("cards"))
    html = F.concat(F.lit("<html><body><script>var a = \"<a href='/Agenda/Index/9'>\";</script><ul>"), "cards", F.lit("</ul><br><a href='/Agenda/Index/'>alle</a></body></html>"))
    found = calendar(pages.select("page_id", html.alias("html")))
    return found.select("page_id", "meeting", "name", "committee", "location", "subtitle", F.col("start").cast("string").alias("start"))


@query()
def narratives(t):
    """Chunks of every document's narrative: paragraphs under headings, tables left out."""
    made = F.concat(F.lit("# Inleiding\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n## Verder\n\n"), "text", F.lit("\n\nSLOTWOORD\n\n"), F.coalesce("source", F.lit("")))
    return narrative_chunks(spread(t.documents.select("doc_id", F.coalesce("source", F.lit("")).alias("name"), made.alias("text"))), "doc_id", "name", "text")
