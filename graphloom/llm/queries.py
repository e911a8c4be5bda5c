"""The queries of the operators over the driver's tables, and their SQL."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import scan
from graphloom.llm.bpe import Vocabulary
from graphloom.llm.decontam import find_hits, is_contaminated
from graphloom.llm.embed_dedup import near_dups
from graphloom.llm.jaccard_join import near_classes
from graphloom.llm.langid import fit_languages, identify
from graphloom.llm.line_dedup import dedup_lines
from graphloom.llm.quality import fit_quality, score_quality
from graphloom.llm.secret_scan import scan_secrets
from graphloom.llm.substring_dedup import repeated_passages
from graphloom.llm.token_counts import count_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256: encoded, then decoded from the ids."""

    def make():
        v = Vocabulary.load(path)
        names = {i: str(i) for i in v.tokens}

        def work(texts: pa.Array) -> list:
            n, ids_sha, text_sha = [], [], []
            for k in range(0, len(texts), 500):
                for ids in v.encode_all(texts.slice(k, 500).to_pylist()):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(v.decode(ids).encode()).hexdigest())
            return [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]

        return work

    return scan.append_columns(docs, "text", "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)


def op2_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(docs, path or public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op3_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, path or public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, counts=True).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("text_sha256"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(table(spark, sf_dir, "embeddings"), scan.Scratch(spark))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), scan.Scratch(spark))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "score", "predicted")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = identify(docs.select("doc_id", "text"), fit_languages(docs))
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"), "lang_pred", "score")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), words=50).drop("removable")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    told = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda x: x["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_bpe, op3_token_counts, op4_line_dedup, op5_embedding_dedup, op6_jaccard_join, op7_quality, op8_language, op9_substring_dedup, op10_secrets)}

ORACLE_SQL = {
    "op1_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, dw.n, p FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op5_embedding_dedup": """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
k AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
r(id, x) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.id, k.b FROM r JOIN k ON r.x = k.a)
SELECT e.vec_id, (SELECT count(*) FROM k WHERE k.a = e.vec_id) AS n_links, c.m AS component_id, e.vec_id = c.m AS kept
FROM e JOIN (SELECT id, min(x) AS m FROM r GROUP BY id) c ON c.id = e.vec_id""",
    "op6_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(5, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(id, x) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, l.b FROM r JOIN l ON r.x = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.m AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(x) AS m FROM r GROUP BY id) c ON c.id = d.doc_id""",
    "op4_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents),
w AS (SELECT doc_id, p, line AS a, lead(line) OVER o AS b, lead(line, 2) OVER o AS c FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS k FROM w WHERE c IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM r WHERE k > 1),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.p) AS n_removed, coalesce(string_agg(CASE WHEN g.p IS NULL THEN line END, chr(10) ORDER BY l.p), '') AS t FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.p = g.p GROUP BY l.doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(t) AS text_sha256 FROM k""",
}
