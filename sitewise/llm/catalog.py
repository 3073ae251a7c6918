"""The corpus queries, one per operator, over whole tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from sitewise.llm.common import ascii_lower
from sitewise.llm.decontaminate import contamination
from sitewise.llm.html_extract import extract_pages
from sitewise.llm.jaccard_join import jaccard_classes
from sitewise.llm.license_scan import scan_licenses
from sitewise.llm.line_dedup import drop_frequent_lines
from sitewise.llm.merkle import digest, encoded, folded, merkle_manifest, siblings
from sitewise.llm.quality_rules import judge_quality
from sitewise.llm.secret_scan import BASE as BASE_SECRETS
from sitewise.llm.secret_scan import scan_secrets
from sitewise.llm.sentencepiece import Pieces, with_round_trip
from sitewise.llm.sql import MANIFEST, SECRETS
from sitewise.llm.substring_dedup import cut_repeats
from sitewise.llm.toxicity import held_out, learn, score_toxicity
from sitewise.llm.url_filter import host_of, judge_urls
from sitewise.llm.whitening import whiten

QUERIES = {}
ORACLE = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op7_line_dedup(spark, d):
    out = drop_frequent_lines(table(spark, d, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE["op7_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), exploded AS (
    SELECT doc_id, r, parts[i] AS line, i,
           translate(trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines, unnest(range(1, len(parts) + 1)) u(i)
), bad AS (
    SELECT k FROM exploded WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10
)
SELECT e.doc_id, count(*) AS n_lines, count(b.k) AS n_dropped,
       sha256(coalesce(string_agg(e.line, chr(10) ORDER BY e.i) FILTER (WHERE b.k IS NULL), '')) AS kept_sha256
FROM exploded e LEFT JOIN bad b ON e.k = b.k
GROUP BY e.r, e.doc_id
"""


@query
def op10_license_scan(spark, d):
    return scan_licenses(table(spark, d, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


@query
def op1_quality_rules(spark, d):
    """The trusted target is every document labelled as good."""
    trusted = table(spark, d, "labels").where("quality = 1").select("doc_id")
    out = judge_quality(table(spark, d, "documents"), trusted)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"
    )


@query
def op8_decontaminate(spark, d):
    out = contamination(table(spark, d, "documents"), table(spark, d, "benchmark"), window=10)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


_TERMS = r"""[x FOR x IN string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> '']"""

ORACLE["op8_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS w FROM documents),
b AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
phrases AS (
    SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS p
    FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) WHERE len(w) > 0
), lens AS (SELECT DISTINCT len(p) AS n FROM phrases),
starts AS (
    SELECT r, i, n, list_slice(w, i, i + n - 1) AS p FROM d, lens, unnest(range(1, len(w) - n + 2)) u(i)
), hits AS (SELECT s.r, s.i, s.n, p.item_id FROM starts s JOIN phrases p ON s.p = p.p),
words AS (
    SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, n FROM hits), unnest(range(0, n)) u(k) GROUP BY r
), items AS (
    SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hits GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def toxicity_model(spark, docs, d):
    """Learned from labelled rows that are not held out."""
    labels = table(spark, d, "labels").where(~held_out(F.col("doc_id")))
    return learn(docs, labels)


@query
def op9_toxicity(spark, d):
    docs = table(spark, d, "documents")
    scored = score_toxicity(docs, toxicity_model(spark, docs, d), threshold=0.7)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


#: Names in hosts which put the host on the list.
LISTED = r"(^|[.])(ads|adult|casino|cheap|free|spam)-"


@query
def op2_url_filter(spark, d):
    """The list: every host of the pages with a listed name in it."""
    pages = table(spark, d, "pages")
    hosts = pages.where(F.contains("url", F.lit("://"))).select(host_of(F.col("url")).alias("key"))
    out = judge_urls(pages, hosts.where(F.col("key").rlike(LISTED)))
    return out.select("page_id", "host", "path", "rule", "verdict")


ORACLE["op2_url_filter"] = r"""
WITH r AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END || '#' AS rest FROM pages
), c AS (
    SELECT page_id, rest, list_min([x FOR x IN [instr(rest, '/'), instr(rest, '?'), instr(rest, '#')] IF x > 0]) AS cut,
           list_min([x FOR x IN [instr(rest, '?'), instr(rest, '#')] IF x > 0]) AS stop
    FROM r
), h AS (
    SELECT page_id, translate(left(rest, cut - 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           substring(rest, cut, stop - cut) AS path
    FROM c
), rules(what, h, p) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
           ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
    SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(what, length(r.h || r.p)) AS what
    FROM h, rules r WHERE (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY page_id
)
SELECT page_id, host, path, rule,
       coalesce(what, CASE WHEN regexp_matches(host, '(^|[.])(ads|adult|casino|cheap|free|spam)-') THEN 'block' ELSE 'allow' END)
         AS verdict
FROM h LEFT JOIN best USING (page_id)
"""


@query
def op6_html_extract(spark, d):
    return extract_pages(table(spark, d, "pages")).select("page_id", "url", "text", "n_chars")


#: Where the public vocabularies are; never part of the repository.
PIECES = os.environ.get("SITEWISE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


@query
def op4_sentencepiece(spark, d):
    out = with_round_trip(table(spark, d, "documents").select("doc_id", "text"), Pieces.load(PIECES))
    return out.select("doc_id", "n_tokens", "ids", "exact")


@query
def op3_jaccard_join(spark, d):
    out = jaccard_classes(table(spark, d, "documents"), percent=75, size=5)
    return out.select("doc_id", "n_shingles", "component_id")


@query
def op5_suffix_dedup(spark, d):
    out = cut_repeats(table(spark, d, "documents").select("doc_id", "text"), size=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept_bytes"), 256).alias("kept_sha256"))


@query
def op11_merkle_manifest(spark, d):
    """Rows whose id's checksum 5 divides are tampered with: their text is lower-cased."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    changed = digest(*(encoded(F.col(c)) for c in fields[:-1]), encoded(ascii_lower(F.col("text"))))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.unhex(changed))
    out = merkle_manifest(table(spark, d, "documents"), fields=fields, keep={"tampered": tampered})
    found = F.coalesce(F.lower(F.hex("tampered")), F.col("leaf"))
    return out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        folded(found, F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE["op11_merkle_manifest"] = MANIFEST


@query
def op12_embedding_whitening(spark, d):
    out = whiten(table(spark, d, "embeddings"))
    rows = out.select(
        "vec_id", "n", F.col("deviation").try_cast("bigint").alias("deviation"), "explained", "identity_error",
        F.posexplode("whitened").alias("at", "whitened"),
    )
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
        F.col("explained")[F.col("at")].alias("explained"), "identity_error",
    )


@query
def op13_secret_scan(spark, d):
    out = scan_secrets(table(spark, d, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in BASE_SECRETS]

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    return out.select(
        "doc_id", *map(count, kinds), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"),
    )


ORACLE["op13_secret_scan"] = SECRETS
