"""The queries of the corpus operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clustering import cluster_vectors
from .common import documents, fold
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .hard_negatives import mine_hard_negatives
from .language import identify_language
from .line_dedup import drop_recurring_lines
from .ngram_join import ngram_join
from .packing import pack_documents
from .pitman_yor import score_texts
from .shard import shard_documents
from .sstable import read_sstables, write_sstables
from .topk import top_k
from .url_reputation import judge_urls
from .vectors import whole_vectors


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the installed package of public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_sstables(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))
    return read_sstables(manifest, with_ids=False)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir)).drop("class_id")


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge_urls(pages, labels).select("page_id", "host", "path", "rule", "verdict", "n_labelled")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = drop_recurring_lines(documents(spark, sf_dir))
    return clean.select("doc_id", "n_lines", "n_dropped", F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), fold(F.col("doc_id")) == 1)


def op8_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(documents(spark, sf_dir), benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, vec_id, label = spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id"), F.col("label").cast("long")
    moved = F.when(F.coalesce(vec_id % 7 == 0, F.lit(False)), (label + 1) % 10).otherwise(label)
    return mine_hard_negatives(vectors, vec_id % 50 == 0, moved)


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 256)
    return top_k(vectors.where("id % 50 = 0"), vectors, 5)


def op13_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sstable, op2_ngram_join, op3_url_reputation, op4_packing, op5_language, op6_line_dedup, op7_pitman_yor, op8_kd_sharding, op9_exact_dedup, op10_decontaminate,
        op11_hard_negatives, op12_exact_topk, op13_annulus_clusters,
    )
}

# Vectors of SQL: components that are null or not finite drop out with their vector.
_WHOLE = """
    v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(SCALE * x::DOUBLE)::BIGINT) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))"""
_PRODUCT = "coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda z: coalesce(z[1] * z[2], 0))), 0)::BIGINT"


def _cluster_sql(rounds: int = 10) -> str:
    """The rounds as a chain of tables: centroids c<n>, the cluster of each vector a<n>."""

    def assigned(n: int) -> str:
        return f"""
        a{n} AS MATERIALIZED (
            SELECT r, vec_id, e, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
            FROM (SELECT r, vec_id, v.e, cluster, list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM w v, c{n} c)
            GROUP BY r, vec_id, e)"""

    def moved(n: int) -> str:
        return f"""
        c{n + 1} AS MATERIALIZED (
            SELECT cluster, coalesce(m, c.e) AS e
            FROM c{n} c LEFT JOIN (
                SELECT cluster, list(q ORDER BY i) AS m
                FROM (SELECT cluster, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS q FROM (SELECT cluster, unnest(e) AS x, unnest(range(1, 65)) AS i FROM a{n}) GROUP BY cluster, i)
                GROUP BY cluster) USING (cluster))"""

    steps = "".join(f",{assigned(n)},{moved(n)}" for n in range(rounds)) + f",{assigned(rounds)}"
    return f"""
        WITH {_WHOLE.replace("SCALE", "1024")},
        w AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, e FROM v WHERE len(e) = 64),
        c0 AS MATERIALIZED (
            SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1)::INT AS cluster, e FROM w QUALIFY cluster < 8){steps},
        named AS (SELECT cluster, sha256(array_to_string(e, ',')) AS centroid_sha256 FROM c{rounds})
        SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
               sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
        FROM a{rounds} JOIN named USING (cluster)"""


SQL: dict[str, str] = {
    "op11_hard_negatives": f"""
        WITH {_WHOLE.replace("SCALE", "256")},
        n AS MATERIALIZED (SELECT vec_id, e, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l FROM v WHERE label IS NOT NULL),
        s AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.l = b.l AS same, {_PRODUCT} AS score
            FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        p AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
               id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3""",
    "op12_exact_topk": f"""
        WITH {_WHOLE.replace("SCALE", "256")}
        SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_PRODUCT} DESC, b.vec_id)::INT AS rank,
               b.vec_id, {_PRODUCT} AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
        QUALIFY rank <= 5""",
    "op13_annulus_clusters": _cluster_sql(),
    "op2_ngram_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x20\x09-\x0D]+') AS w FROM documents),
        grams AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM words WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 75 * (s.n + t.n - c)),
        reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT a, y FROM reach JOIN links ON b = x),
        lowest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM lowest LEFT JOIN sizes USING (doc_id)""",
    "op9_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op10_decontaminate": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        starts AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g, least(len(w), 10) AS n FROM starts),
        lengths AS (SELECT DISTINCT n FROM windows),
        places AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words JOIN lengths ON len(w) >= n)),
        found AS (SELECT doc_id, item_id, i, places.n FROM places JOIN windows USING (g, n)),
        hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
        owners AS (
            SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN owners USING (doc_id)""",
    "op3_url_reputation": r"""
        WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
        split AS (
            SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        known AS (
            SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
            FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
        named AS (
            SELECT host, n, bad, regexp_replace(host, ':[0-9]*$', '') AS name
            FROM (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM split LEFT JOIN known USING (page_id) GROUP BY host)),
        labelled AS (
            SELECT *, regexp_matches(name, '^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$') AS ip, string_split(name, '.') AS w,
                   array_to_string(w[-2:], '.') IN ('ac.uk', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'com.au', 'com.br', 'com.cn', 'gov.uk', 'net.au', 'org.au', 'org.uk') AS two
            FROM named),
        hosts AS (
            SELECT host, n, bad, CASE WHEN ip THEN 'ip' WHEN two THEN array_to_string(w[-2:], '.') ELSE w[-1] END AS suffix,
                   CASE WHEN ip THEN name WHEN two THEN array_to_string(w[-3:], '.') ELSE array_to_string(w[-2:], '.') END AS domain
            FROM labelled),
        domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
        suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
        total AS (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 10) AS p FROM suffixes),
        levels AS (
            SELECT 'h' AS l, domain AS above, n::DOUBLE AS n, bad::DOUBLE AS bad FROM hosts UNION ALL SELECT 'd', suffix, n, bad FROM domains
            UNION ALL SELECT 's', '', n, bad FROM suffixes),
        groups AS (
            SELECT l, count(*) - 1 AS free, sum(n) AS n, sum(bad) / sum(n) * (1 - sum(bad) / sum(n)) AS chance, sum(n * n) / sum(n) AS nn,
                   sum(bad * bad / n) - sum(bad) * sum(bad) / sum(n) AS squares
            FROM levels WHERE n > 0 GROUP BY l, above HAVING count(*) > 1),
        moments AS (SELECT l, sum(squares - chance * free) AS excess, sum(chance * (n - nn - free)) AS room FROM groups GROUP BY l),
        weights AS (
            SELECT coalesce(max(m) FILTER (l = 'h'), 1000) AS mh, coalesce(max(m) FILTER (l = 'd'), 1000) AS md, coalesce(max(m) FILTER (l = 's'), 1000) AS ms
            FROM (SELECT l, CASE WHEN excess > 0 AND room > 0 THEN least(1000.0, greatest(1.0, room / excess - 1)) ELSE 1000.0 END AS m FROM moments)),
        by_suffix AS (SELECT suffix, (bad + p * ms) / (n + ms) AS ps FROM suffixes, total, weights),
        by_domain AS (SELECT domain, (bad + ps * md) / (n + md) AS pd FROM domains JOIN by_suffix USING (suffix), weights),
        ab AS (SELECT host, n, bad + pd * mh AS a, n - bad + (1 - pd) * mh AS b FROM hosts JOIN by_domain USING (domain), weights),
        bounds AS (
            SELECT host, n, a / (a + b) + sqrt(a * b / (a + b + 1)) / (a + b)
                   * (-1.645 + 2 * (b - a) * sqrt(a + b + 1) / ((a + b + 2) * sqrt(a * b)) * (1.645 * 1.645 - 1) / 6) AS bound FROM ab),
        rules(rule, says) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'), ('example.net/de/8', 'block'), ('org/es/', 'block')),
        fits AS (
            SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(says, length(rule)) AS says
            FROM split JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
                 AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(says, CASE WHEN bound > 0.4 THEN 'block' ELSE 'allow' END) AS verdict, n AS n_labelled
        FROM split JOIN bounds USING (host) LEFT JOIN fits USING (page_id)""",
}
