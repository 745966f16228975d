"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arc_to_warc, bit_sliced, chunk_fingerprints, dart_minhash, entropy_mix, kneser_ney, license_rules, nbest_pieces, page_blocks, prefix_trie, spelling_variants, toxicity, vantage_trees
from .common import table


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: payload_bytes, payload_digest, record_type, refers_to as read back from the WARC files."""
    return arc_to_warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: size, source_size, target (of its source), taken (words), and its rate and copies."""
    mixed = entropy_mix.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = (F.col("__size") * F.col("__copies")).cast("long")
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken.alias("taken"), F.col("__rate").alias("rate"), F.col("__copies").alias("copies"))


def op3_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query and rank: vec_id and score of its 10 nearest."""
    return vantage_trees.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, base places with the first and last, labels and score."""
    found = license_rules.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.col("__base.start")
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.size("__base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("__base.label")), ",").alias("base_labels"),
        F.array_join("__labels", ",").alias("labels"),
        F.col("__score").alias("score"),
        F.size("__detections").cast("long").alias("n_detections"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, score, predicted, and how many sentences offend."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    score = F.col("__toxicity")
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("__offending").cast("long").alias("n_offending"))


def op6_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its fingerprint, that of the edited text, and how much of it they and the next document's hold."""
    return chunk_fingerprints.fingerprint_and_edit(table(spark, sf_dir, "documents"))


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: class_id (smallest doc_id of its near-duplicate class) and whether it is the one to keep."""
    found = dart_minhash.near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_words", "keeper")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: perplexity, the limit of its language, and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = kneser_ney.classify(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", F.col("__perplexity").alias("perplexity"), F.col("__limit").alias("threshold"), F.col("__keep").alias("keep"))


def op9_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces of the best segmentation (number, score, digest), the n best scores with a digest of what each
    changes in the best, and whether decoding gives the text."""
    coded = nbest_pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), with_pieces=False)
    return coded.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "n_pieces", "piece_score", "nbest_scores", F.transform("nbest_changes", lambda x: F.sha2(F.to_json(x), 256)).alias("nbest_digests"), "pieces_sha256", "round_trip")


def op10_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: the article's text and its code points."""
    return page_blocks.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars", "n_blocks", "n_kept")


def op11_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query and rank: vec_id and score of the 20 highest integer inner products."""
    return bit_sliced.top_scores(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per word: its form, root, counts and number of near words."""
    return spelling_variants.group_variants(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per node of the trie of rebuilt conversations: members, children, leaves, what sharing saves, and who ends there."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_arc_to_warc, op2_entropy_mix, op3_vantage_trees, op4_license_rules, op5_toxicity, op6_chunk_fingerprints, op7_dart_minhash, op8_kneser_ney, op9_nbest_pieces, op10_page_blocks, op11_bit_sliced, op12_spelling_variants, op13_prefix_trie)
    return {f.__name__: f for f in named}


def _crc32_sql(text: str) -> str:
    """The CRC-32 of a string of Latin letters, digits and colons as an SQL expression, by the polynomial's table."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0xEDB88320 * (n & 1)
        table.append(n)
    codes = f"list_transform(string_split({text}, ''), lambda c: unicode(c))"
    read = f"flatten(list_transform({codes}, lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + u // 64, 128 + u % 64] END))"
    start = f"list_prepend(4294967295::BIGINT, list_transform({read}, lambda b: b::BIGINT))"
    return f"xor(list_reduce({start}, lambda c, b: xor(list_extract({table}::BIGINT[], 1 + (xor(c, b) & 255)), c >> 8)), 4294967295)"


def oracle_sql() -> dict[str, str]:
    return {
        "op11_bit_sliced": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
                       WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
            s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 20
        """,
        "op12_spelling_variants": f"""
            WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
            seen AS (SELECT run, {_crc32_sql("doc_id::VARCHAR || ':' || run")} AS h FROM runs WHERE length(run) >= 6),
            spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM seen),
            words AS MATERIALIZED (SELECT word, count(*) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
            keys AS MATERIALIZED (SELECT word, n, word AS key, 0 AS i FROM words UNION ALL SELECT word, n, substr(word, 1, i - 1) || substr(word, i + 1), i FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
            near AS MATERIALIZED (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM keys a JOIN keys b USING (key) WHERE a.word <> b.word AND (a.i = b.i OR length(a.word) <> length(b.word))),
            best AS MATERIALIZED (SELECT word, n, count(*) AS n_near, arg_min(near, {{'less': -near_n, 'near': near}}) AS form, max(near_n) AS form_n FROM near GROUP BY word, n),
            forms AS MATERIALIZED (SELECT word, form, form_n FROM best WHERE form_n >= 5 * n),
            led AS (SELECT word, form AS root FROM forms UNION ALL SELECT led.word, forms.form FROM led JOIN forms ON led.root = forms.word),
            ends AS (SELECT word, root FROM led WHERE root NOT IN (SELECT word FROM forms))
            SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.form_n
            FROM words w LEFT JOIN best b ON w.word = b.word LEFT JOIN forms f ON w.word = f.word LEFT JOIN ends e ON w.word = e.word
        """,
        "op13_prefix_trie": f"""
            WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS nth, said, size FROM
                       (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL)),
            c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
            rebuilt AS (SELECT c.conv_id, t.nth, t.said, t.size FROM c JOIN t ON t.conv_id = c.base AND t.nth <= c.h UNION ALL SELECT c.conv_id, t.nth + 9, t.said, t.size FROM c JOIN t ON t.conv_id = c.conv_id AND t.nth > c.h),
            path AS MATERIALIZED (SELECT conv_id, row_number() OVER w AS depth, md5(string_agg(said, '' ORDER BY nth) OVER w) AS node, size FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY nth ROWS UNBOUNDED PRECEDING)
                     UNION ALL SELECT conv_id, 0, 'root', 0 FROM c),
            node AS MATERIALIZED (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved FROM path GROUP BY node, depth),
            up AS MATERIALIZED (SELECT DISTINCT a.node, b.node AS parent FROM path a JOIN path b ON a.conv_id = b.conv_id AND a.depth = b.depth + 1),
            children AS (SELECT parent AS node, count(*) AS n_children FROM up GROUP BY parent),
            below AS (SELECT DISTINCT a.node, b.node AS under FROM path a JOIN path b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
            sums AS (SELECT below.node, sum(n.saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves FROM below JOIN node n ON n.node = below.under LEFT JOIN children k ON k.node = below.under GROUP BY below.node),
            ends AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM path JOIN (SELECT conv_id, max(depth) AS depth FROM path GROUP BY conv_id) USING (conv_id, depth) GROUP BY node)
            SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
            FROM node n JOIN sums s ON s.node = n.node LEFT JOIN children k ON k.node = n.node LEFT JOIN ends e ON e.node = n.node LEFT JOIN up u ON u.node = n.node LEFT JOIN node p ON p.node = u.parent
        """,
        "op1_arc_to_warc": """
            WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
            m AS (SELECT payload_digest, min(page_id) AS keeper FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1)
            SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
                   CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
            FROM p LEFT JOIN m USING (payload_digest)
        """,
    }
