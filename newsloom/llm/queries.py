"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bpe, collocations, exact_dedup, filter_audit, fingerprint, hyper_minhash, licenses, mixing, sharding, simhash, substring_dedup, toxicity, warc
from newsloom.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).drop("url")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_successors(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hyper_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyper_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is, on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_substring_dedup, op3_exact_dedup, op4_licenses, op5_simhash, op6_mixing, op7_warc, op8_fingerprint, op9_bpe, op10_toxicity, op11_collocations, op12_filter_audit, op13_hyper_minhash, pipeline)}


SQL = {
    "op2_substring_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
        g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM s JOIN d USING (doc_id)),
        r AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS low FROM g) WHERE low < doc_id),
        c AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS gone FROM r GROUP BY doc_id),
        k AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN c USING (doc_id))
        SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
               sha256(coalesce((SELECT string_agg(x.v, ' ' ORDER BY x.j) FROM (SELECT unnest(w) AS v, unnest(range(1, len(w) + 1)) AS j) x
                                WHERE NOT list_contains(gone, x.j)), '')) AS kept_sha256
        FROM k""",
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op6_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   md5('42:' || coalesce(doc_id::VARCHAR, '')) AS o
            FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS n FROM d GROUP BY source
        ), w AS (
            SELECT source, source_size, ([3, 1, 2])[n % 3 + 1] AS weight, source_size * 2 AS cap FROM s
        ), x AS (
            SELECT *, 3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                   sum(weight) OVER (a ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
            FROM w WINDOW a AS (ORDER BY cap::DOUBLE / weight::DOUBLE ASC, source ASC NULLS LAST)
        ), y AS (
            SELECT *, rest::DOUBLE * weight::DOUBLE >= cap::DOUBLE * 2 * weights::DOUBLE AS clamped FROM x
        ), t AS (
            SELECT source, source_size, CASE WHEN clamped THEN cap::DOUBLE ELSE least(cap::DOUBLE,
                first(rest::DOUBLE / (weights::DOUBLE * 2)) OVER (ORDER BY clamped ASC, cap::DOUBLE / weight::DOUBLE ASC, source ASC NULLS LAST) * weight) END AS target
            FROM y
        ), r AS (
            SELECT d.*, source_size, target, floor(target + 0.5)::BIGINT AS cut,
                   sum(size) OVER (PARTITION BY d.source ORDER BY o, size ROWS UNBOUNDED PRECEDING) - size AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, round(target, 6) AS target,
               (CASE WHEN source_size > 0 THEN cut // source_size ELSE 0 END * size
                + least(size, greatest(0, cut - CASE WHEN source_size > 0 THEN cut // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
        FROM r""",
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
        q AS (SELECT *, n >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY h) AS again, max(page_id) OVER (PARTITION BY h) AS last FROM p)
        SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN last END AS refers_to
        FROM q""",
    "op12_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                     (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
                     + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), min(doc_id) OVER (PARTITION BY t) IS NOT NULL)::INT AS mask
              FROM d LEFT JOIN l USING (doc_id)),
        h AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, mask),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
        o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
        s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o),
        b AS (SELECT *, 1 << (ascii(filter_order[step]) - 65) AS own, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INT AS before FROM s),
        r AS (SELECT part, filter_order, step, own,
                     coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS removed,
                     coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
                     coalesce(sum(good) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
              FROM h, b GROUP BY ALL)
        SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r""",
    "op13_hyper_minhash": r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 3), ' ')) AS h FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS l, b.doc_id AS r, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT l, r FROM p JOIN n x ON x.doc_id = l JOIN n y ON y.doc_id = r WHERE 100 * k >= 80 * (x.n + y.n - k)),
        both_ways AS (SELECT l AS a, r AS b FROM e UNION SELECT r, l FROM e),
        reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT reach.node, b FROM reach JOIN both_ways ON a = other),
        c AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON node = d.doc_id""",
    "op11_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(p) AS piece FROM d)),
        t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
        i AS (SELECT lang, unnest(list_zip(w, w[2:], w[3:], w[4:])) AS z FROM w),
        g AS (SELECT lang, unnest([z[1], z[1] || ' ' || z[2], z[1] || ' ' || z[2] || ' ' || z[3], z[1] || ' ' || z[2] || ' ' || z[3] || ' ' || z[4]]) AS phrase FROM i),
        f AS (SELECT lang, len(string_split(phrase, ' ')) AS k, string_split(phrase, ' ') AS words, f FROM (SELECT lang, phrase, count(*) AS f FROM g WHERE phrase IS NOT NULL GROUP BY ALL HAVING count(*) >= 30)),
        cuts AS (SELECT c.lang, c.k, c.words, c.f AS a, j.j, x.f AS l, y.f AS r, (2000000 * c.f::HUGEINT) // (x.f + y.f)::HUGEINT AS score
                 FROM f c, (SELECT unnest([1, 2, 3]) AS j) j, f x, f y WHERE c.k > j.j AND x.lang = c.lang AND x.words = list_slice(c.words, 1, j.j) AND y.lang = c.lang AND y.words = list_slice(c.words, j.j + 1, c.k)),
        s AS (SELECT lang, k, words, a, arg_min({'l': l, 'r': r, 'score': score}, score * 10 + j) AS cut FROM cuts GROUP BY ALL),
        o AS (SELECT c.lang, list_slice(c.words, q.q, q.q + m.m - 1) AS words, max(c.f) AS longer FROM f c, (SELECT unnest([1, 2, 3]) AS q) q, (SELECT unnest([2, 3]) AS m) m WHERE m.m < c.k AND q.q + m.m - 1 <= c.k GROUP BY ALL),
        z AS (SELECT s.lang, array_to_string(s.words, ' ') AS phrase, a, cut.l AS l, cut.r AS r, cut.score::BIGINT AS score FROM s LEFT JOIN o ON o.lang = s.lang AND o.words = s.words WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT)
        SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z JOIN t ON t.lang = z.lang QUALIFY rank <= 2000""",
}
