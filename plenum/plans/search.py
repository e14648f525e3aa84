"""Retrieval: nearest vectors, keyword search, rank fusion, filters and context."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.functions.text import jaccard, word_set
from plenum.operators.relops import distinct_on, ranked, spread, top_n
from plenum.operators.shared import written
from plenum.plans.registry import query

QUERY_WORDS = ["the", "of", "and"]  # terms of the example question
WORDS_SQL = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))"


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest_vectors(vectors, query_vector, k, least=0.15, condition=None):
    """Exact cosine top-k over unit vectors; score at least `least`, ids break ties. A one-row query side rides along as a literal."""
    rows = vectors if condition is None else vectors.filter(condition)
    scored = rows.select("vec_id", "label", F.round(dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query_vector])), 5).alias("score"))
    return scored.filter(F.col("score") >= least).orderBy(F.desc("score"), "vec_id").limit(k)


def _vector(t, vec_id=0):
    """The query's vector; without it, one that is like none."""
    found = t.embeddings.filter(F.col("vec_id") == vec_id).first()
    return found.embedding if found else []


KNN = "SELECT e.vec_id, e.label, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


@query(f"SELECT * FROM ({KNN}) WHERE score >= 0.15 ORDER BY score DESC, vec_id LIMIT 10")
def vector_top_k(t):
    return nearest_vectors(t.embeddings, _vector(t), 10)


@query(f"SELECT * FROM ({KNN}) WHERE label = 3 AND score >= -1 ORDER BY score DESC, vec_id LIMIT 10")
def filtered_vector_top_k(t):
    return nearest_vectors(t.embeddings, _vector(t), 10, -1, F.col("label") == 3)


@query(f"""WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents) SELECT doc_id, len(list_intersect(w, ['the', 'of', 'and'])) AS hits FROM d WHERE len(list_intersect(w, ['the', 'of', 'and'])) >= 2""")
def term_or_filter(t):
    """Documents with two or more distinct terms."""
    hits = F.size(F.array_intersect(word_set(F.col("text")), F.array(*[F.lit(w) for w in QUERY_WORDS])))
    return t.documents.select("doc_id", hits.alias("hits")).filter("hits >= 2")


def postings(docs, terms):
    """doc_id, n (words), hit (the terms among them): every text is split once; what is kept of it is small."""
    words = F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), "")
    rows = spread(docs.select("doc_id", "text")).select("doc_id", words.alias("w"))
    return rows.select("doc_id", F.size("w").alias("n"), F.filter("w", lambda x: x.isin(terms)).alias("hit"))


def bm25(docs, terms, k1=1.2, b=0.75):
    """doc_id, score of the terms. Only the terms' postings leave a document, so nothing else is shuffled."""
    rows = written(postings(docs, terms))
    total = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean")).first()
    posts = rows.select("doc_id", "n", F.explode("hit").alias("term")).groupBy("doc_id", "n", "term").agg(F.count("*").alias("tf"))
    df = {r.term: r.df for r in posts.groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row for each query term
    idf = {w: _idf(total.docs, df.get(w, 0)) for w in terms}
    weight = F.coalesce(*[F.when(F.col("term") == w, F.lit(x)) for w, x in idf.items()])
    part = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.lit(float(total.mean or 1))))
    return posts.groupBy("doc_id").agg(F.round(F.sum(part), 5).alias("score"))


def _idf(n, df):
    import math

    return math.log(1 + (n - df + 0.5) / (df + 0.5))


BM25 = """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d),
p AS (SELECT doc_id, len(w) AS n, term, count(*) AS tf FROM d, unnest(w) AS u(term) WHERE term IN ('the', 'of', 'and') GROUP BY 1, 2, 3),
f AS (SELECT term, ln(1 + ((SELECT docs FROM s) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p GROUP BY 1),
k AS (SELECT doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / (SELECT mean FROM s)))), 5) AS score FROM p JOIN f USING (term) GROUP BY 1)"""


@query(BM25 + " SELECT doc_id, score FROM k ORDER BY score DESC, doc_id LIMIT 20")
def keyword_top_k(t):
    return bm25(t.documents, QUERY_WORDS).orderBy(F.desc("score"), "doc_id").limit(20)


def fuse(lists, k=60):
    """Reciprocal rank fusion of lists (id, place from 0): the sum of 1 / (k + place); the first list breaks ties."""
    rows = None
    for order, df in enumerate(lists):
        own = df.select("id", "place", F.lit(order).alias("list"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("place"))), 8).alias("score"), F.min(F.struct("list", "place")).alias("first")).select("id", "score", F.col("first.list").alias("first_list"), F.col("first.place").alias("first_place"))


@query(BM25.replace("WITH d", f"WITH knn AS (SELECT * FROM ({KNN}) WHERE vec_id IN (SELECT doc_id FROM documents)), v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS place, 0 AS list FROM (SELECT * FROM knn WHERE score >= 0.15 ORDER BY score DESC, vec_id LIMIT 30)), d")
       + """, b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS place, 1 AS list FROM (SELECT * FROM k ORDER BY score DESC, doc_id LIMIT 30)), u AS (SELECT * FROM v UNION ALL SELECT * FROM b)
SELECT id, round(sum(1.0 / (60 + place)), 8) AS score, min(list) AS first_list, arg_min(place, list) AS first_place FROM u GROUP BY 1""")
def hybrid_fusion(t):
    """Vector and keyword lists of 30, fused: a document's vector has the document's id."""
    vectors = t.embeddings.join(t.documents.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return fuse([placed(nearest_vectors(vectors, _vector(t), 30), "vec_id"), placed(bm25(t.documents, QUERY_WORDS).orderBy(F.desc("score"), "doc_id").limit(30), "doc_id")])


def placed(best, key):
    """A short list by score with its places from 0."""
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1).select(F.col(key).alias("id"), "place")


@query(f"WITH k AS (SELECT vec_id, label, CASE WHEN vec_id % 50 = 7 THEN NULL ELSE score END AS score FROM ({KNN})), n AS (SELECT *, (SELECT count(*) FROM k WHERE score >= 0.15) AS strong FROM k) SELECT vec_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC NULLS LAST, vec_id) AS rn FROM n WHERE score IS NULL OR score >= CASE WHEN strong >= 3 THEN 0.15 ELSE 0.10 END) WHERE rn = 1")
def relaxed_quality_floor(t):
    """A floor of 0.15; where under three rows pass, 0.10. Rows without a score pass. Of a document (a label) the best row stays."""
    score = F.round(dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in _vector(t)])), 5)
    rows = t.embeddings.select("vec_id", "label", F.when(F.col("vec_id") % 50 != 7, score).alias("score"))
    return distinct_on(floored(rows), ["label"], [F.col("score").desc_nulls_last(), F.col("vec_id")])


def floored(rows, floor=0.15, lower=0.10, least=3):
    strong = rows.filter(F.col("score") >= floor).limit(least).count()
    return rows.filter(F.col("score").isNull() | (F.col("score") >= (floor if strong >= least else lower)))


@query(f"WITH k AS (SELECT * FROM ({KNN}) WHERE score >= 0.3), f AS (SELECT * FROM k WHERE label = 3), u AS (SELECT *, 0 AS stage FROM f UNION ALL SELECT *, 1 FROM k WHERE (SELECT count(*) FROM f) < 5) SELECT vec_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY stage) rn FROM u) WHERE rn = 1 ORDER BY score DESC, vec_id LIMIT 25")
def filtered_with_fallback(t):
    """Hits of a filter; if there are under five, those without it as well."""
    q = _vector(t)
    found = nearest_vectors(t.embeddings, q, 25, 0.3, F.col("label") == 3)
    return found if found.count() >= 5 else nearest_vectors(t.embeddings, q, 25, 0.3)


def hits(docs, terms, mode="any", condition=None):
    """doc_id, hits: documents with all or any of the terms, under a condition on their other columns."""
    rows = docs if condition is None else docs.filter(condition)
    n = F.size(F.array_distinct("hit"))
    found = spread(rows).select("doc_id", F.filter(F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), ""), lambda x: x.isin(terms)).alias("hit"))
    return found.select("doc_id", n.alias("hits")).filter(F.col("hits") >= (len(terms) if mode == "all" else 1))


W3 = "d AS (SELECT doc_id, lang, source, {w} AS w FROM documents)".format(w=WORDS_SQL)


@query(f"WITH {W3}, s AS (SELECT doc_id, 0 AS stage FROM d WHERE lang = 'en' AND len(list_intersect(w, ['the', 'of', 'and'])) = 3 UNION ALL SELECT doc_id, 1 FROM d WHERE len(list_intersect(w, ['the', 'of', 'and'])) = 3 UNION ALL SELECT doc_id, 2 FROM d WHERE len(list_intersect(w, ['that', 'avec'])) >= 1) SELECT doc_id, min(stage) AS stage FROM s GROUP BY 1")
def query_cascade(t):
    """All terms under a filter, then all terms, then any of the longer ones: each document by its first stage."""
    stages = [hits(t.documents, QUERY_WORDS, "all", F.col("lang") == "en"), hits(t.documents, QUERY_WORDS, "all"), hits(t.documents, ["that", "avec"])]
    rows = None
    for i, df in enumerate(stages):
        own = df.select("doc_id", F.lit(i).alias("stage"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("doc_id").agg(F.min("stage").alias("stage"))


@query(f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM ({KNN})), u AS (SELECT vec_id, score, 0 AS stream FROM k WHERE label IN (1, 2) AND rn <= 4 UNION ALL SELECT vec_id, score, 1 FROM k WHERE label IN (2, 3) AND rn <= 6), f AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY stream) AS pick FROM u) SELECT vec_id, stream, score FROM f WHERE pick = 1")
def multi_stream(t):
    """Streams of the best of several kinds; what two streams have belongs to the first."""
    q = F.array(*[F.lit(float(x)) for x in _vector(t)])
    scored = t.embeddings.select("vec_id", "label", F.round(dot(F.col("embedding"), q), 5).alias("score"))
    stream = lambda labels, n, i: top_n(scored.filter(F.col("label").isin(labels)), ["label"], [F.desc("score"), F.col("vec_id")], n).select("vec_id", "score", F.lit(i).alias("stream"))
    both = stream([1, 2], 4, 0).unionByName(stream([2, 3], 6, 1))
    return distinct_on(both, ["vec_id"], [F.col("stream")]).select("vec_id", "stream", "score")


@query(f"WITH {W3}, p AS (SELECT unnest(['en', 'fr', 'nl']) AS party), h AS (SELECT party, doc_id, lang = party AS own, len(list_intersect(w, ['the', 'la', 'les'])) AS hits FROM d, p WHERE len(list_intersect(w, ['the', 'la', 'les'])) > 0), m AS (SELECT *, bool_or(own) OVER (PARTITION BY party) AS any_own FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY party ORDER BY hits DESC, doc_id) AS rn FROM m WHERE own OR NOT any_own) SELECT party, doc_id, hits FROM r WHERE rn <= 5")
def party_comparison(t):
    """Five fragments of each party: its own ones, or any where it has none."""
    found = hits(t.documents, ["the", "la", "les"]).join(t.documents.select("doc_id", "lang"), "doc_id")
    rows = found.withColumn("party", F.explode(F.array(*[F.lit(p) for p in ("en", "fr", "nl")]))).withColumn("own", F.col("lang") == F.col("party"))
    some = {r.party for r in rows.filter("own").select("party").distinct().collect()}  # of the parties asked for
    kept = rows.filter(F.col("own") | ~F.col("party").isin(list(some)))
    return top_n(kept, ["party"], [F.desc("hits"), F.col("doc_id")], 5).select("party", "doc_id", "hits")


@query(f"WITH {W3}, x AS (SELECT doc_id, 1.0 AS rank FROM documents WHERE source LIKE '%1%' UNION ALL SELECT doc_id, round(len(list_intersect(w, ['the', 'of', 'and'])) / 4.0, 6) FROM d WHERE len(list_intersect(w, ['the', 'of', 'and'])) > 0) SELECT doc_id, max(rank) AS rank FROM x GROUP BY 1 ORDER BY rank DESC, doc_id LIMIT 50")
def site_search(t):
    """Hits of names, ranked 1, and of texts: the best of each item, fifty in all."""
    names = t.documents.filter(F.col("source").contains("1")).select("doc_id", F.lit(1.0).alias("rank"))
    texts = hits(t.documents, QUERY_WORDS).select("doc_id", F.round(F.col("hits") / 4.0, 6).alias("rank"))
    return names.unionByName(texts).groupBy("doc_id").agg(F.max("rank").alias("rank")).orderBy(F.desc("rank"), "doc_id").limit(50)


@query("""WITH a AS (SELECT o_orderkey AS id, o_custkey AS c, CAST(o_orderdate AS DATE) AS d FROM orders), r AS (SELECT a.id, b.id AS other, 0 AS relation FROM a JOIN a b ON a.c = b.c AND a.d = b.d AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.id) <= 10
UNION ALL SELECT a.id, b.id, 1 FROM a JOIN a b ON a.c = b.c AND year(a.d) = year(b.d) AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.id) <= 10)
SELECT id, other, min(relation) AS relation FROM r GROUP BY 1, 2""")
def related_documents(t):
    """Ten documents of the same meeting, and ten of the same subject and year: the first relation wins. The first eleven of a group are enough for all its
    documents, so they don't meet in pairs."""
    d = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.to_date("o_orderdate").alias("d"), F.year("o_orderdate").alias("y"))

    def relatives(keys, relation):
        first = top_n(d.select(*keys, F.col("id").alias("other")), keys, [F.col("other")], 11).groupBy(*keys).agg(F.array_sort(F.collect_list("other")).alias("first"))
        others = F.slice(F.filter("first", lambda x: x != F.col("id")), 1, 10)
        return d.join(first, keys).select("id", F.explode(others).alias("other"), F.lit(relation).alias("relation"))

    return relatives(["c", "d"], 0).unionByName(relatives(["c", "y"], 1)).groupBy("id", "other").agg(F.min("relation").alias("relation"))


@query("""WITH f AS (SELECT o_orderkey, year(o_orderdate) AS y, round(o_totalprice / 600000, 6) AS score FROM orders WHERE o_orderpriority <> '5-LOW' AND o_totalprice / 600000 >= 0.5), r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY score DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY y) AS n FROM f)
SELECT y, o_orderkey, score, greatest(n - 5, 0) AS more FROM r WHERE rn <= 5""")
def decision_timeline(t):
    """Of each year the five best decisions from a score of 0.5 on, and how many more there are."""
    f = t.orders.filter("o_orderpriority <> '5-LOW' and o_totalprice / 600000 >= 0.5").select(F.year("o_orderdate").cast("long").alias("y"), "o_orderkey", F.round(F.col("o_totalprice") / 600000, 6).alias("score"))
    n = f.groupBy("y").agg(F.greatest(F.count("*") - 5, F.lit(0)).alias("more"))
    return top_n(f, ["y"], [F.desc("score"), F.col("o_orderkey")], 5).join(n, "y").select("y", "o_orderkey", "score", "more")


@query("""WITH a AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, substr(text, 1, 300) AS shown, n FROM a WHERE rn <= 3""")
def fragment_batch(t):
    """The first three fragments of each document, and how many it has."""
    n = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"))
    return top_n(t.conversations, ["conv_id"], [F.col("turn")], 3).join(n, "conv_id").select("conv_id", "turn", F.substring("text", 1, 300).alias("shown"), "n")


@query("""SELECT year(o_orderdate) AS y, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS place, count(*) OVER (PARTITION BY year(o_orderdate)) AS n, o_orderkey, left(o_orderpriority || ' ' || o_custkey, 300) AS shown FROM orders""")
def timeline_groups(t):
    """What happened in each year in order, with the beginning of its text: a row for each, as a year may hold a third of all."""
    rows = t.orders.select(F.year("o_orderdate").cast("long").alias("y"), "o_orderdate", "o_orderkey", F.left(F.concat_ws(" ", "o_orderpriority", F.col("o_custkey").cast("string")), F.lit(300)).alias("shown"))
    placed = ranked(rows, ["y"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return placed.select("y", (F.col("place") + 1).alias("place"), F.col("members").alias("n"), "o_orderkey", "shown")


@query("""WITH m AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS bb, o_orderdate FROM orders)
SELECT o_orderkey, bb, row_number() OVER w AS place, first_value(o_orderkey) OVER w AS newest FROM m WINDOW w AS (PARTITION BY coalesce(bb, -o_orderkey - 1) ORDER BY o_orderdate DESC, o_orderkey)""")
def number_fold(t):
    """Every document with the newest one of its reference number and its place behind it; those without a number stay apart."""
    m = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("bb"), "o_orderdate")
    w = Window.partitionBy(F.coalesce("bb", -F.col("o_orderkey") - 1)).orderBy(F.desc("o_orderdate"), "o_orderkey")
    return m.select("o_orderkey", "bb", F.row_number().over(w).alias("place"), F.first("o_orderkey").over(w).alias("newest"))


@query("""WITH s AS (SELECT doc_id, lang, round(length(text) / 20000.0 - CASE WHEN length(text) < 200 OR text LIKE '%dank%' THEN 0.2 ELSE 0 END, 6) AS score FROM documents) SELECT doc_id, lang, score FROM s ORDER BY score DESC, doc_id DESC LIMIT 40""")
def demoted_scores(t):
    """Short and polite texts are demoted, then the best are taken, the newest of equal ones first."""
    low = (F.length("text") < 200) | F.col("text").contains("dank")
    return t.documents.select("doc_id", "lang", F.round(F.length("text") / 20000.0 - F.when(low, 0.2).otherwise(0.0), 6).alias("score")).orderBy(F.desc("score"), F.desc("doc_id")).limit(40)


@query("""WITH c AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents), p AS (SELECT *, floor(i * 1.0 * least(n, 100) / n) AS slot FROM c) SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, slot ORDER BY i) rn FROM p) WHERE rn = 1""")
def stride_sample(t):
    """At most 100 documents of each source, evenly spaced: a sampling operator. A source of any size is numbered by ranges."""
    slot = lambda i: F.floor(i * F.least("members", F.lit(100)) / F.col("members"))
    c = ranked(t.documents.select("doc_id", "source"), ["source"], [F.col("doc_id")])
    return c.filter((F.col("place") == 0) | (slot(F.col("place")) != slot(F.col("place") - 1))).select("source", "doc_id")


@query("""WITH r AS (SELECT event_id, user_id, event_type IN ('purchase', 'signup') AS yes, value FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY yes DESC, value DESC, event_id) AS rn FROM r) SELECT user_id, event_id FROM k WHERE yes OR rn <= 5""")
def relevance_min_keep(t):
    """What was judged relevant, filled up to five of each question by score."""
    yes = F.col("event_type").isin("purchase", "signup")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("yes"), F.desc("value"), "event_id"))
    return t.events.withColumn("yes", yes).withColumn("rn", rn).filter("yes or rn <= 5").select("user_id", "event_id")


@query("""WITH n AS (SELECT lower(p_name) AS k, p_partkey, p_type, p_size FROM part) SELECT k, p_partkey, p_type FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN p_type = 'PROMO' THEN 0 ELSE 1 END, nullif(p_size, 1) DESC NULLS LAST, p_partkey) rn FROM n) WHERE rn = 1""")
def preferred_entity(t):
    """For each name the entity of the preferred type, else the one of most mentions, unknown numbers last."""
    n = t.part.select(F.lower("p_name").alias("k"), "p_partkey", "p_type", F.nullif(F.col("p_size"), F.lit(1)).alias("size"))
    return distinct_on(n, ["k"], [F.when(F.col("p_type") == "PROMO", 0).otherwise(1), F.col("size").desc_nulls_last(), F.col("p_partkey")]).select("k", "p_partkey", "p_type")


#: How many fragments a class of question gets.
TOP_K = {"financieel": 12, "vergelijking": 25, "tijdlijn": 50, "feit": 10}


@query("""WITH q AS (SELECT o_orderkey, o_orderkey % 5 AS v FROM orders) SELECT o_orderkey, ['financieel', 'vergelijking', 'tijdlijn', 'feit', 'financieel'][1 + v] AS class, CAST([12, 25, 50, 10, 12][1 + v] AS INT) AS k, CASE v WHEN 0 THEN 'VVD' WHEN 1 THEN 'D66' END AS party, CASE v WHEN 2 THEN '2018-01-01' END AS van FROM q""")
def routed_questions(t):
    """Class, number of fragments, party and period of every question, by its words."""
    from plenum.functions.text import party_in_query, spoken_period
    from plenum.plans.values import chosen

    q = chosen("o_orderkey", ["Wat kost dit de VVD aan begroting?", "vergelijk D66 en wonen", "hoe ontwikkelde de haven zich sinds 2018", "wie is burgemeester?", "jaarrekening en lasten"])
    low = F.lower(q)
    kind = F.when(low.rlike("begroting|jaarrekening|lasten|kost"), "financieel").when(low.rlike("vergelijk|verschil"), "vergelijking").when(low.rlike("ontwikkel|tijdlijn|sinds"), "tijdlijn").otherwise("feit")
    k = F.create_map(*[F.lit(v) for kv in TOP_K.items() for v in kv])[kind]
    return t.orders.select("o_orderkey", kind.alias("class"), k.alias("k"), party_in_query(q).alias("party"), spoken_period(q, F.to_date("o_orderdate"))["van"].cast("string").alias("van"))


@query(f"SELECT label, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) rn FROM ({KNN})) WHERE rn = 1")
def keep_first_per_group(t):
    """The best vector of each label."""
    scored = t.embeddings.select("vec_id", "label", F.round(dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in _vector(t)])), 5).alias("score"))
    return distinct_on(scored, ["label"], [F.desc("score"), F.col("vec_id")]).select("label", "vec_id", "score")


@query(f"""WITH k AS (SELECT * FROM ({KNN}) ORDER BY score DESC, vec_id LIMIT 40), c AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total FROM k)
SELECT vec_id, label, CASE WHEN n > 0.35 * total THEN 'document' WHEN n > 1 THEN 'section' ELSE 'fragment' END AS tier FROM c""")
def hierarchical_tiers(t):
    """A label with over 35 % of the hits is read whole, one with several by section, others by fragment."""
    hits = nearest_vectors(t.embeddings, _vector(t), 40, -1)
    n, total = F.count("*").over(Window.partitionBy("label")), F.count("*").over(Window.partitionBy())
    return hits.select("vec_id", "label", F.when(n > 0.35 * total, "document").when(n > 1, "section").otherwise("fragment").alias("tier"))


@query(f"""WITH k AS (SELECT * FROM ({KNN}) ORDER BY score DESC, vec_id LIMIT 50), n AS (SELECT count(*) AS c FROM k GROUP BY label)
SELECT round(-sum((c / 50.0) * log2(c / 50.0)), 6) AS entropy, count(*) AS labels FROM n""")
def retrieval_diversity(t):
    counts = nearest_vectors(t.embeddings, _vector(t), 50, -1).groupBy("label").count()
    p = F.col("count") / 50.0
    return counts.agg(F.round(-F.sum(p * F.log2(p)), 6).alias("entropy"), F.count("*").alias("labels"))


@query(f"""WITH d AS (SELECT doc_id, source, {WORDS_SQL} AS w FROM documents), s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) rn FROM d)
SELECT a.source, a.doc_id AS a, b.doc_id AS b, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) * 1.0 / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END, 6) AS similarity
FROM s a JOIN s b ON a.source = b.source AND b.rn = a.rn + 1""")
def neighbour_similarity(t):
    """Word-set similarity of each document with the next one of its source."""
    next_ = F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))
    pairs = t.documents.select("source", F.col("doc_id").alias("a"), next_.alias("b")).filter("b is not null")  # ids only: texts meet by joins
    sets = spread(t.documents.select("doc_id", "text")).select("doc_id", word_set(F.col("text")).alias("w"))
    both = pairs.join(sets.withColumnRenamed("doc_id", "a"), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("w").alias("v")), "b")
    return both.select("source", "a", "b", F.round(jaccard(F.col("w"), F.col("v")), 6).alias("similarity"))


def mmr(rows, k: int, weight: float = 0.6):
    """Greedy choice of each document's sentences: relevance against likeness to those chosen. At most 50 candidates a document."""
    best = top_n(rows, ["doc_id"], [F.desc("score"), F.col("pos")], 50, "place")
    each = best.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "pos", "score", "words"))).alias("x"))
    each = each.select("doc_id", *[F.col("x").getField(c).alias(c) for c in ("pos", "score", "words")])

    def picked(scores: list[float], sets: list[set]) -> list[int]:
        left, out, near = list(range(len(scores))), [], [0.0] * len(scores)  # near: the likeness to the likest one chosen
        while left and len(out) < k:
            r = max(left, key=lambda i: (weight * scores[i] - (1 - weight) * near[i], -i))
            out.append(r)
            left.remove(r)
            for i in left:
                shared = len(sets[i] & sets[r])
                near[i] = max(near[i], shared / (len(sets[i]) + len(sets[r]) - shared) if shared else 0.0)
        return out

    def choose(batches):
        for b in batches:
            own, places, order = [], [], []
            for i, (pos, scores, words) in enumerate(zip(b["pos"], b["score"], b["words"], strict=True)):
                at = pos.as_py()
                chosen = picked(scores.as_py(), [set(w) for w in words.as_py()])
                own += [i] * len(chosen)
                places += [at[c] for c in chosen]
                order += range(1, len(chosen) + 1)
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(own, pa.int64())), pa.array(places, pa.int32()), pa.array(order, pa.int32())], ["doc_id", "pos", "chosen"])

    return each.mapInArrow(choose, "doc_id long, pos int, chosen int")


@query()
def mmr_sentences(t):
    """Five varied sentences of each document; a sentence's relevance is its share of the document's words."""
    rows = spread(t.documents.select("doc_id", "text")).select("doc_id", "text", F.size(word_set(F.col("text"))).alias("all"))  # once a text, not once a sentence
    rows = rows.select("doc_id", "all", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("pos", "s"))
    rows = rows.select("doc_id", "all", "pos", word_set(F.col("s")).alias("words"))
    share = F.when(F.col("all") > 0, F.round(F.size("words") / F.col("all"), 8)).otherwise(0.0)  # a text may have no words
    return mmr(rows.select("doc_id", "pos", "words", share.alias("score")), 5)
