"""The registered queries of this folder: thin digests over the operators' own results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bisected_search, crosspolytope, ctw, divergence, langid, licenses, packing, secrets_scan, sentencepiece_codec, simhash, spotsigs, toxicity, vafile
from .common import id_remainder, table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = id_remainder(F.col("doc_id"), 7) == 2
    return ctw.score(docs, ~out).withColumn("held_out", out)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    encoded = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), path)
    digest = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                            F.get("ends", F.size("ends") - 1).cast("long").alias("last_end"))
    kept = ("doc_id", "ids", "n_tokens", "ids_sha256", "last_end")
    return sentencepiece_codec.decode(digest, path, kept).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "last_end")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), lambda i: id_remainder(i, 5) != 0)
    scored = docs.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), toxicity.scorer(docs, model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda f: f["base"])
    count = lambda kind: F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    return found.select("doc_id", *map(count, secrets_scan.KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector, from cells first and exact vectors after."""
    return vafile.top_k(vafile.quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, k=5)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = id_remainder(F.col("doc_id"), 3) == 1
    model = langid.train(docs.where(~out).select("doc_id", "text", "lang"))
    scored = docs.select("doc_id", out.alias("held_out"), langid.predictor(docs, model)(F.col("text")).alias("p"))
    return scored.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = spotsigs.edited_comparison(table(spark, sf_dir, "documents"))
    return both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spotsigs.fingerprint(F.col("hashes")).alias("fingerprint"),
                       spotsigs.fingerprint(F.col("edited_hashes")).alias("edited_fingerprint"), "near_edited", "near_next")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item, from an index in bisected order."""
    return bisected_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth, by cosine."""
    return crosspolytope.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's words stray from its language's other sources, and its most telling terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_sentencepiece, op3_toxicity, op4_secret_scan, op5_topk_search, op6_packing, op7_language_id,
                                   op8_license_scan, op9_spotsigs, op10_simhash, op11_ranked_search,
                                   op12_cross_polytope, op13_source_divergence)}

ORACLE_SQL = {
    "op5_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_ranked_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ), t AS (SELECT no, term, count(*) AS tf FROM (SELECT no, unnest(terms) AS term FROM d) GROUP BY ALL),
        s AS (SELECT count(*) AS total, sum(len(terms)) AS length FROM d WHERE len(terms) > 0),
        w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * total + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term, total),
        i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        m AS (SELECT no, doc_id, 50 + (50 * len(terms) * total) // length AS m FROM d, s WHERE len(terms) > 0),
        r AS (
            SELECT item_id, t.no, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
            FROM i JOIN w USING (term) JOIN t USING (term) JOIN m ON m.no = t.no GROUP BY item_id, t.no, doc_id
        ), o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
    """,
    "op13_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS no, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
        ), t AS (SELECT no, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT no) >= 10),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
        s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
        p AS (
            SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.total + 2 * v.v) AS BIGINT) AS p,
                CAST(1 + (1000000000::HUGEINT * (k.n + 2)) // (v.total + 2 * v.v) AS BIGINT) AS q
            FROM s JOIN v ON v.lang = s.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
        ), r AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS BIGINT) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
            GROUP BY ALL
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
        ), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
        SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10
    """,
}
