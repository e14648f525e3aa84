"""Documents and pages: lengths, duplicates, boilerplate, attribution, extraction and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions.text import attribution, word_set
from plenum.plans.registry import query
from plenum.sources.chunks import recursive_chunks
from plenum.sources.html import page_links

BUCKET = "CASE WHEN {n} = 0 THEN 'empty' WHEN {n} < 200 THEN '<200' WHEN {n} < 1000 THEN '200-999' WHEN {n} < 5000 THEN '1000-4999' ELSE '5000+' END"


@query(f"SELECT {BUCKET.format(n='length(text)')} AS bucket, count(*) AS n, min(length(text)) AS least, max(length(text)) AS most FROM documents GROUP BY 1")
def length_histogram(t):
    n = F.length("text")
    return t.documents.groupBy(F.expr(BUCKET.format(n="length(text)")).alias("bucket")).agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"))


@query("""WITH g AS (SELECT md5(trim(text, E' \\t\\n\\r')) AS h, count(*) AS c FROM documents GROUP BY 1) SELECT CAST(sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) AS BIGINT) AS groups_, CAST(sum(c - 1) AS BIGINT) AS surplus, round(sum(c - 1) * 1.0 / sum(c), 6) AS rate FROM g""")
def duplicate_rate(t):
    g = t.documents.groupBy(F.md5(F.regexp_replace("text", r"^[ \t\n\r]+|[ \t\n\r]+$", "")).alias("h")).agg(F.count("*").alias("c"))
    return g.agg(F.sum(F.when(F.col("c") > 1, 1).otherwise(0)).alias("groups_"), F.sum(F.col("c") - 1).alias("surplus"), F.round(F.sum(F.col("c") - 1) / F.sum("c"), 6).alias("rate"))


@query("SELECT lang, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY 1")
def type_shares(t):
    total = t.documents.count()
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.count("*") / F.lit(total), 6).alias("share"))


@query("""WITH d AS (SELECT doc_id, lang, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x FROM documents), w AS (SELECT doc_id, count(DISTINCT w) AS words FROM (SELECT doc_id, unnest(regexp_extract_all(lower(x), '[\\pL\\pN_]+')) AS w FROM d) WHERE length(w) >= 3 GROUP BY 1),
n AS (SELECT lang, length(x) AS n, length(regexp_replace(x, '[^\\pL]', '', 'g')) AS alpha, coalesce(words, 0) AS words FROM d LEFT JOIN w USING (doc_id)) SELECT lang, round(avg(CASE WHEN n < 50 OR alpha < 0.5 * n OR words < 8 THEN 1.0 ELSE 0 END), 6) AS rate FROM n GROUP BY 1""")
def boilerplate_rate(t):
    """The share of texts that say nothing: short ones, those with few letters, and those of fewer than eight different words of three characters or more."""
    x = F.regexp_replace("text", r"^\s+|\s+$", "")
    n, alpha = F.length("x"), F.length(F.regexp_replace("x", r"[^\p{L}]", ""))
    words = F.size(F.array_distinct(F.regexp_extract_all(F.lower("x"), F.lit(r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_]{3,}"), F.lit(0))))
    rows = t.documents.select("lang", x.alias("x")).select("lang", F.when((n < 50) | (alpha < 0.5 * n) | (words < 8), 1.0).otherwise(0.0).alias("empty"))
    return rows.groupBy("lang").agg(F.round(F.avg("empty"), 6).alias("rate"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS numbers, regexp_extract(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+') AS mail FROM documents")
def extracted_facts(t):
    return t.documents.select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("numbers"), F.regexp_extract("text", "[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", 0).alias("mail"))


@query("SELECT doc_id, substr(text, 1, 200) || CASE WHEN length(text) > 200 THEN '…' ELSE '' END AS short, CASE WHEN length(text) < 500 THEN 'skip' WHEN length(text) < 3000 THEN 'excerpt' WHEN length(text) <= 30000 THEN 'direct' ELSE 'extract' END AS tier FROM documents")
def summary_tiers(t):
    n = F.length("text")
    return t.documents.select("doc_id", F.concat(F.substring("text", 1, 200), F.when(n > 200, "…").otherwise("")).alias("short"), F.when(n < 500, "skip").when(n < 3000, "excerpt").when(n <= 30000, "direct").otherwise("extract").alias("tier"))


@query("SELECT l.toxic, l.quality, count(*) AS n, count(d.doc_id) AS known FROM labels l LEFT JOIN documents d USING (doc_id) GROUP BY 1, 2")
def label_coverage(t):
    d = t.documents.select("doc_id", F.lit(1).alias("there"))
    return t.labels.join(d, "doc_id", "left").groupBy("toxic", "quality").agg(F.count("*").alias("n"), F.count("there").alias("known"))


def audited(chunks, docs):
    """doc_id, chunk_index, match, words of every chunk as stored; one whose document isn't there is missing. docs: doc_id, text."""
    both = chunks.join(docs, "doc_id", "left")
    return both.select("doc_id", "chunk_index", attribution(F.col("content"), F.col("text")).alias("match"), F.size(word_set(F.col("content"))).alias("words"))


@query()
def attribution_audit(t):
    """The class of every chunk against the whole document that it names."""
    docs = t.documents.select("doc_id", "text")
    return audited(recursive_chunks(docs, "doc_id", "text"), docs)


@query()
def document_chunks(t):
    return recursive_chunks(t.documents.select("doc_id", "text"), "doc_id", "text")


@query()
def page_outlinks(t):
    return page_links(t.pages)


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS n FROM pages")
def page_titles(t):
    return t.pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length("html").alias("n"))
