"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, covertree, langid, mixing, neardup, packing, pii, quality, relative, suffix, treaps, urls
from .common import crc_mod


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op3_cover_tree_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(_read(spark, sf_dir, "embeddings"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.detect(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return docs.select("doc_id", *(count(k).alias(f"n_{k}") for k in pii.KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op6_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_sparse_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = suffix.repeated_passages(_read(spark, sf_dir, "documents"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return spans.groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("end") - F.col("start")).alias("n_words"), line.alias("spans"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = langid.langid(_read(spark, sf_dir, "documents"))
    return docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op10_weighted_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treaps.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_relative_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = relative.remove_copied(_read(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = align.align(_read(spark, sf_dir, "documents"))
    text = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return docs.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", text.alias("groups_sha256"))


_ALL = (
    op1_best_fit_packing, op2_quality_classifier, op3_cover_tree_near_dedup, op4_ngram_jaccard_join, op5_pii, op6_anisotropic_ann, op7_sparse_suffix_dedup,
    op8_url_filter, op9_language_id, op10_weighted_mixing, op11_treap_search, op12_relative_lz_dedup, op13_token_alignment,
)
QUERIES = {f.__name__: f for f in _ALL}

#: Reachability over a table link(a, b) that has both directions: least(node, root).
_REACH = """reach AS (SELECT a AS node, a AS root FROM link UNION SELECT l.b, r.root FROM reach r JOIN link l ON l.a = r.node),
 least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"""
_HOST = r"coalesce(translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_TOKENS = r"regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op3_cover_tree_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.9), {_REACH}
 SELECT v.vec_id AS vec_id, (SELECT count(*) FROM link WHERE a = v.vec_id) AS n_links, coalesce(root, v.vec_id) AS component_id, coalesce(root, v.vec_id) = v.vec_id AS kept FROM v LEFT JOIN least ON node = v.vec_id""",
    "op4_ngram_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM w, LATERAL unnest(range(1, greatest(2, len(w) - 3))) t(i) WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
 link AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)), {_REACH}
 SELECT d.doc_id AS doc_id, coalesce(root, d.doc_id) AS class_id, (SELECT count(*) FROM link WHERE a = d.doc_id) AS n_links, coalesce(root, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN least ON node = d.doc_id""",
    "op7_sparse_suffix_dedup": f"""WITH w AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
 g AS (SELECT doc_id, i - 1 AS s, md5(array_to_string(w[i : i + 49], ' ')) AS g FROM w, LATERAL unnest(range(1, len(w) - 48)) t(i)),
 r AS (SELECT g FROM g GROUP BY g HAVING count(DISTINCT doc_id) > 1),
 h AS (SELECT doc_id, s, s - coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -1000000) > 50 AS new FROM g WHERE g IN (SELECT g FROM r)),
 k AS (SELECT doc_id, s, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM h),
 p AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS z FROM k GROUP BY doc_id, k)
 SELECT doc_id, count(*) AS n_spans, CAST(sum(z - a) AS BIGINT) AS n_words, string_agg(a || ':' || z, ',' ORDER BY a) AS spans FROM p GROUP BY doc_id""",
    "op11_treap_search": r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
 q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
 qt AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
 n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
 a AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
 w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, a GROUP BY term),
 s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score
   FROM qt JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), a GROUP BY ALL),
 r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
 SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    "op12_relative_lz_dedup": r"""WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
 g AS (SELECT doc_id, i AS s, md5(array_to_string(w[i : i + 12], ' ')) AS g FROM w, LATERAL unnest(range(1, len(w) - 11)) t(i)),
 m AS (SELECT g, min(doc_id) AS m FROM g GROUP BY g),
 gone AS (SELECT DISTINCT doc_id, s + k AS i FROM (SELECT doc_id, s FROM g JOIN m USING (g) WHERE doc_id > m), LATERAL unnest(range(0, 13)) x(k)),
 word AS (SELECT doc_id, w[i] AS word, i FROM w, LATERAL unnest(range(1, len(w) + 1)) t(i)),
 k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
 SELECT w.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id""",
    # of links in pages, canonical ones that are whole addresses
    "op8_url_filter": rf"""WITH RECURSIVE u AS (SELECT page_id, url, coalesce(html, '') AS html, {_HOST.format("url")} AS host,
   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) t(v, h, p)),
 j AS (SELECT page_id, host, path, url, html, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS said
   FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
 c AS (SELECT url, regexp_extract(regexp_extract(regexp_replace(html, '{urls.HIDDEN}', '', 'g'), '{urls.CANONICAL.replace("'", "''")}'), '(?i)\shref\s*=\s*["'']?([^"''\s>]+)', 1) AS href FROM j WHERE contains(url, '://')),
 l AS (SELECT url, replace(href, '&amp;', '&') AS href FROM c WHERE contains(href, '://')),
 w0 AS (SELECT DISTINCT url AS a, regexp_replace(url, '(?s)#.*', '') AS x FROM (SELECT url FROM j UNION ALL SELECT href FROM l) WHERE contains(url, '://')),
 w1 AS (SELECT a, split_part(x, '?', 1) || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(x, '(?s)^[^?]*\?(.*)', 1), '&'),
   lambda q: NOT regexp_matches(q, '(?s)^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$')), '&'), ''), '') AS b FROM w0),
 w2 AS (SELECT a, b, 'https://' || regexp_replace(regexp_replace({_HOST.format("b")}, ':(80|443)$', ''), '^(www|m)\.', '') || regexp_replace(b, '(?s)^.*?://[^/?#]*', '') AS c FROM w1),
 w3 AS (SELECT *, regexp_extract(split_part(c, '?', 1), '^(https://[^/]*)', 1)
   || regexp_replace(regexp_replace(regexp_extract(split_part(c, '?', 1), '(?s)^https://[^/]*(.*)', 1), '/+$', ''), '(?i)(/index)?\.html?$', '') || regexp_extract(c, '(?s)^[^?]*(\?.*)', 1) AS d FROM w2),
 step AS (SELECT a, b FROM w3 UNION SELECT b, c FROM w3 UNION SELECT c, d FROM w3 UNION SELECT url, href FROM l),
 link AS (SELECT a, b FROM step WHERE a <> b UNION SELECT b, a FROM step WHERE a <> b), {_REACH},
 n AS (SELECT j.*, coalesce(root, url) AS comp FROM j LEFT JOIN least ON node = url),
 g AS (SELECT comp, min(said) AS via FROM n WHERE url IS NOT NULL GROUP BY comp)
 SELECT page_id, host, path, rule, coalesce(said, via, 'allow') AS verdict FROM n LEFT JOIN g USING (comp)""",
}
