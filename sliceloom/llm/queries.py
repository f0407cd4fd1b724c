"""One query for each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceloom.llm import centroids, decontamination, embeddings, fingerprints, minhash, mixing, packing, prefixes, quality, repeats, secrets, sharding, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_min_max_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op5_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op6_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, table(spark, sf_dir, "labels")).select(F.col("_0").alias("doc_id"), "kept", "bad", "toxic", "weak_bad", "weak_toxic")


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "source", "copies", "position", "positions")


def op11_partial_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster(table(spark, sf_dir, "embeddings")))


def op12_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.rebuilt_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kd_sharding": op1_kd_sharding,
    "op2_secret_links": op2_secret_links,
    "op3_min_max_hash": op3_min_max_hash,
    "op4_scaled_sketch": op4_scaled_sketch,
    "op5_block_anchors": op5_block_anchors,
    "op6_metric_range_join": op6_metric_range_join,
    "op7_certified_packing": op7_certified_packing,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_weak_quality": op9_weak_quality,
    "op10_curriculum_mix": op10_curriculum_mix,
    "op11_partial_distance": op11_partial_distance,
    "op12_benchmark_windows": op12_benchmark_windows,
    "op13_prefix_trie": op13_prefix_trie,
}

_REACH = """reach AS (SELECT id, id AS root FROM node UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.id WHERE e.b > r.root)"""



def _lloyd(rounds: int = 3) -> str:
    """SQL of op11: the rounds written out."""
    near = """SELECT vec_id, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
        SELECT v.vec_id, c.k, list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v CROSS JOIN c{r} c) GROUP BY vec_id"""
    out = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE len(embedding) = 64),
        v AS (SELECT vec_id, list_transform(x, lambda y: CAST(floor(64 * y) AS BIGINT)) AS v FROM e WHERE len(list_filter(x, lambda y: isfinite(y))) = 64),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, v AS c FROM v QUALIFY k < 16)"""
    for r in range(rounds):
        out += f""", a{r} AS ({near.format(r=r)}),
        m{r} AS (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{r} JOIN v USING (vec_id)) GROUP BY k, j),
        n{r} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM m{r} GROUP BY k),
        c{r + 1} AS (SELECT o.k, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN n{r} n ON n.k = o.k)"""
    return out + f""", a AS ({near.format(r=rounds)})
        SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a JOIN c{rounds} c ON c.k = a.k"""


ORACLES: dict[str, str] = {
    "op11_partial_distance": _lloyd(),
    "op12_benchmark_windows": """
        WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        v AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS v FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM iw WHERE len(w) > 0)),
        lengths AS (SELECT DISTINCT n FROM v),
        p AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS v FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, lengths WHERE len(w) >= n)),
        met AS (SELECT p.doc_id, p.i, p.n, v.item_id FROM p JOIN v ON p.n = v.n AND p.v = v.v),
        hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i + unnest(generate_series(0, n - 1)) AS j FROM met) GROUP BY doc_id),
        item AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY doc_id)
        SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)""",
    "op3_min_max_hash": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        k AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        edge AS (SELECT a, b FROM k JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
        node AS (SELECT doc_id AS id FROM documents), """
    + _REACH
    + """, c AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op5_block_anchors": """
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        v AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS v FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM w WHERE len(w) >= 50)),
        f AS (SELECT v, min(doc_id) AS least FROM v GROUP BY v),
        g AS (SELECT DISTINCT doc_id, i + unnest(generate_series(0, 49)) AS j FROM v JOIN f USING (v) WHERE least < doc_id),
        k AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM w),
        r AS (SELECT k.doc_id, count(g.j) AS gone, string_agg(x, ' ' ORDER BY j) FILTER (g.j IS NULL) AS kept FROM k LEFT JOIN g USING (doc_id, j) GROUP BY k.doc_id)
        SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id)""",
    "op6_metric_range_join": """
        WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
        edge AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.e, q.e) >= 0.9),
        node AS (SELECT vec_id AS id FROM embeddings), """
    + _REACH
    + """, c AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM edge GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op8_warc_revisits": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        o AS (SELECT d, max(page_id) AS original FROM p WHERE n >= 1000 GROUP BY d)
        SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN p.n >= 1000 AND o.original <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN p.n >= 1000 AND o.original <> p.page_id THEN o.original END AS refers_to
        FROM p LEFT JOIN o ON p.d = o.d""",
}
