"""The queries of this folder, over their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from plenum.llm import decontaminate, langid, lm, merkle, mixing, packing, partenum, quality, secrets, spelling, token_counts, toxicity, warc
from plenum.llm.common import table


def op1_secret_ownership(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op2_counterfactual_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_divergence_quality(spark, sf_dir):
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op4_partenum_components(spark, sf_dir):
    return partenum.jaccard_components(table(spark, sf_dir, "documents"))


def op5_prefix_decontamination(spark, sf_dir):
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc_round_trip(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_pseudo_likelihood(spark, sf_dir):
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op8_trie_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op9_compression_language(spark, sf_dir):
    return langid.predict(table(spark, sf_dir, "documents"))


def op10_column_generation_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_butterfly_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_systematic_mixture(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.group_variants(table(spark, sf_dir, "documents"))


ALL = [op1_secret_ownership, op2_counterfactual_toxicity, op3_divergence_quality, op4_partenum_components, op5_prefix_decontamination, op6_warc_round_trip, op7_pseudo_likelihood, op8_trie_token_counts, op9_compression_language, op10_column_generation_packing, op11_butterfly_manifest, op12_systematic_mixture, op13_spelling_variants]

#: The archives' records follow from the pages alone.
OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
     r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN response END AS refers_to
FROM r
"""

#: crc32 by its table of 256 values, over the bytes of a text's hexadecimal form.
CRC_SQL = """
steps AS (SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b)),
crc AS (SELECT list(c ORDER BY b) AS t FROM steps)
"""


def crc_sql(text: str) -> str:
    """SQL of crc32 of an expression; crc must be among the tables read."""
    value = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {value}), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295)"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _leaf_sql(text: str) -> str:
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    return f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: Trees level by level; sources make up a tree of their own, named by one sign that no source's tree has.
OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL},
leaves AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf_sql("text")} AS leaf,
                  CASE WHEN {crc_sql("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS now
           FROM documents, crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
nodes AS (SELECT tree, 0 AS level, place AS i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed
          UNION ALL
          SELECT tree, level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM nodes WHERE n > 1 GROUP BY tree, level, i // 16),
subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, i, subroot AS h, count(*) OVER () AS n FROM subroots
         UNION ALL
         SELECT level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM tops WHERE n > 1 GROUP BY level, i // 16),
every AS (SELECT * FROM nodes UNION ALL SELECT '/', level, i, h, n FROM tops),
sides AS (SELECT tree, level, i, n,
                 coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                 coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
          FROM every),
climb AS (SELECT tree AS own, place AS id, tree, 0 AS level, place AS i, coalesce(now, leaf) AS h, '' AS proof FROM placed
          UNION ALL
          SELECT own, id, CASE WHEN s.n > 1 THEN c.tree ELSE '/' END, CASE WHEN s.n > 1 THEN c.level + 1 ELSE 0 END,
                 CASE WHEN s.n > 1 THEN c.i // 16 ELSE (SELECT r.i FROM subroots r WHERE r.tree = c.tree) END,
                 CASE WHEN s.n > 1 THEN sha256(before || c.h || after) ELSE c.h END, CASE WHEN s.n > 1 THEN proof || before || after ELSE proof END
          FROM climb c JOIN sides s ON s.tree = c.tree AND s.level = c.level AND s.i = c.i WHERE s.n > 1 OR c.tree <> '/'),
ends AS (SELECT own, id, h, proof FROM climb c JOIN sides s ON s.tree = c.tree AND s.level = c.level AND s.i = c.i WHERE c.tree = '/' AND s.n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, e.h AS folded_root, e.h = root AS verified
FROM placed p JOIN subroots s ON s.tree = p.tree JOIN ends e ON e.own = p.tree AND e.id = p.place, (SELECT h AS root FROM tops WHERE n = 1)
"""

OP12_SQL = r"""
WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sizes GROUP BY source),
levels AS (SELECT *, (1.5 * (sum(source_size) OVER ())::DOUBLE - coalesce(2 * sum(source_size) OVER earlier, 0)::DOUBLE) / (sum(weight) OVER later)::DOUBLE AS level
           FROM sources WINDOW earlier AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                               later AS (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
final AS (SELECT max(level) AS level FROM levels),
targets AS (SELECT source, source_size, CASE WHEN weight * f.level > 2 * source_size THEN 2.0 * source_size ELSE weight * f.level END::DOUBLE AS target,
                   ('0x' || substr(md5('mix' || coalesce(':' || source, '')), 1, 8))::BIGINT % 1073741824 AS first
            FROM sources, final f),
placed AS (SELECT doc_id, size, source_size, target, first, CASE WHEN source_size > 0 THEN round(target / source_size * 1073741824) ELSE 0 END::BIGINT AS each,
                  row_number() OVER (PARTITION BY s.source ORDER BY size DESC, doc_id NULLS FIRST) - 1 AS place
           FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (SELECT *, ((first + place % 1073741824 * each) % 1073741824 + each) // 1073741824 AS copies FROM placed)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM taken
"""

#: Near words by the texts that are left when one code point goes: at the same place of both, or of the longer one only.
OP13_SQL = rf"""
WITH RECURSIVE {CRC_SQL},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
counted AS (SELECT run, n, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL), crc),
worn AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM counted),
words AS (SELECT word, sum(n)::BIGINT AS n FROM worn WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, k, left(word, k) || substr(word, k + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS k FROM words)),
pairs AS (SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
          UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.rest
          UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.rest),
best AS (SELECT p.word, count(*) AS n_near, arg_min(near, (-w.n, near)) AS near, max(w.n) AS most FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN near END AS form, CASE WHEN most >= 2 * w.n THEN most END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
paths AS (SELECT word, coalesce(form, word) AS at, form FROM forms
          UNION ALL
          SELECT s.word, f.form, f.form FROM paths s JOIN forms f ON f.word = s.at WHERE s.form IS NOT NULL AND f.form IS NOT NULL),
ends AS (SELECT s.word, s.at AS root FROM paths s JOIN forms f ON f.word = s.at WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN ends e ON e.word = f.word
"""


def queries():
    return {f.__name__: f for f in ALL}


def oracle_sql():
    return {"op6_warc_round_trip": OP6_SQL, "op11_butterfly_manifest": OP11_SQL, "op12_systematic_mixture": OP12_SQL, "op13_spelling_variants": OP13_SQL}
