"""Registered queries over the documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import experiments, similar
from ledgerloom.operators.scratch import Scratch
from ledgerloom.plans import sql_text as X
from ledgerloom.sources.tables import read_table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


def text_statistics(spark, folder):
    flat = T.ascii_lower(T.collapse_white_space(F.col("text")))
    return _docs(spark, folder).where("text is not null").select("doc_id", T.word_count(F.col("text")).alias("words"), F.length(flat).alias("flat_chars"), T.sha256_tag(flat).alias("flat_hash"))


def changed_by_normal_form(spark, folder):
    return _docs(spark, folder).where("text is not null").where(T.nfkc(F.col("text")) != F.col("text")).select("doc_id")


def control_characters(spark, folder):
    """Documents with control or direction signs, once marks of direction stand for hyphens and a bell for every seventh document's first exclamation mark."""
    spoiled = F.regexp_replace("text", "-", "\u200e")
    spoiled = F.when(F.col("doc_id") % 7 == 0, F.regexp_replace(spoiled, "!", "\x07")).otherwise(F.when(F.col("doc_id") % 7 < 3, spoiled).otherwise(F.col("text")))
    return _docs(spark, folder).select("doc_id", spoiled.alias("t")).select("doc_id", F.col("t").rlike(T.CONTROL).alias("control"), F.col("t").rlike(T.BIDI).alias("direction")).where("control or direction")


def mail_addresses(spark, folder):
    """Addresses of mail and telephone numbers in the ledger's texts, as they are looked for in what is made public."""
    own = read_table(spark, folder, "source_ledger").select("id", "captured_text").distinct()
    own = own.select("id", F.regexp_count("captured_text", F.lit(T.EMAIL)).alias("addresses"), F.regexp_count("captured_text", F.lit(T.PHONE)).alias("numbers"))
    return own.groupBy("id").agg(F.max("addresses").alias("addresses"), F.max("numbers").alias("numbers")).where("addresses > 0 or numbers > 0")


def document_copies(spark, folder):
    own = _docs(spark, folder).where("text is not null").select("doc_id", T.ascii_lower(T.collapse_white_space(F.col("text"))).alias("t")).where("t <> ''")
    return own.groupBy(F.sha2("t", 256).alias("text_hash")).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc")).where("documents > 1")


def shingle_statistics(spark, folder):
    return similar.shingle_statistics(_docs(spark, folder), "text")


def near_duplicate_documents(spark, folder):
    """One row per document with enough words: its class, and the number of classes that are near-duplicates of it."""
    pairs, members = similar.similar_classes(_docs(spark, folder), Scratch(spark), "doc_id", "text")
    degree = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("links"))
    return members.join(degree, "class", "left").select(F.col("id").alias("doc_id"), "class", F.coalesce("links", F.lit(0)).alias("links"))


def source_manifest(spark, folder):
    """Two manifests of the documents: the texts as they are, without those of every eleventh document, and the texts without white space at their ends, without those of every thirteenth."""
    own = _docs(spark, folder).where("text is not null").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")
    return experiments.manifest_difference(own.where("doc_id % 11 <> 0").select("path", F.sha2("text", 256).alias("sha256")), own.where("doc_id % 13 <> 0").select("path", F.sha2(T.strip_white_space(F.col("text")), 256).alias("sha256")))


def sources_by_language(spark, folder):
    own = _docs(spark, folder).select(F.coalesce(F.lower("lang"), F.lit("?")).alias("lang"), "doc_kind", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return own.groupBy("lang", "doc_kind").agg(F.count("*").alias("documents"), F.sum("n").cast("bigint").alias("chars"))


QUERIES = {f.__name__: f for f in (text_statistics, changed_by_normal_form, control_characters, mail_addresses, document_copies, shingle_statistics, near_duplicate_documents, source_manifest, sources_by_language)}

_WS = "[\\x09-\\x0d\\x20\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_FLAT = f"trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WS}', ' ', 'g'))"
_LOW = f"lower(trim(regexp_replace(text, '{_WS}', ' ', 'g')))"
SQL = {
    "changed_by_normal_form": f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND ({X.nfkc('text')}) <> text",
    "text_statistics": f"WITH t AS (SELECT doc_id, {_FLAT} AS f FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(CASE WHEN f = '' THEN 0 ELSE len(string_split(f, ' ')) END AS INTEGER) AS words, CAST(length(f) AS INTEGER) AS flat_chars, 'sha256:' || sha256(f) AS flat_hash FROM t",
    "control_characters": "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN replace(replace(text, '-', chr(8206)), '!', chr(7)) WHEN doc_id % 7 < 3 THEN replace(text, '-', chr(8206)) ELSE text END AS t FROM documents), c AS (SELECT doc_id, regexp_matches(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]') AS control, regexp_matches(t, '[\\x{61c}\\x{200e}\\x{200f}\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}]') AS direction FROM t) SELECT * FROM c WHERE control OR direction",
    "mail_addresses": "WITH c AS (SELECT id, len(regexp_extract_all(' ' || captured_text, '[^A-Za-z0-9_](?:[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\\.[A-Za-z]{2,})(?:[^A-Za-z0-9_]|$)')) AS addresses, len(regexp_extract_all(regexp_replace(' ' || captured_text, '([^0-9 .()-])', '\\1\\1', 'g'), '[^A-Za-z0-9_](?:\\+?[0-9][0-9 .()\\-]{7,}[0-9])(?:[^A-Za-z0-9_]|$)')) AS numbers FROM source_ledger) SELECT id, max(addresses) AS addresses, max(numbers) AS numbers FROM c GROUP BY id HAVING max(addresses) > 0 OR max(numbers) > 0",
    "document_copies": f"WITH t AS (SELECT doc_id, {_FLAT} AS f FROM documents WHERE text IS NOT NULL) SELECT sha256(f) AS text_hash, count(*) AS documents, min(doc_id) AS first_doc FROM t WHERE f <> '' GROUP BY f HAVING count(*) > 1",
    "shingle_statistics": f"WITH w AS (SELECT doc_id, string_split({_LOW}, ' ') AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) AS n FROM w WHERE len(w) >= 5) SELECT count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_shingles, CAST(max(n) AS BIGINT) AS most_in_a_row FROM s WHERE n > 0",
    "near_duplicate_documents": f"""
WITH w AS (SELECT doc_id, string_split(lower(regexp_replace(trim(text), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')), ' ') AS k, string_split({_LOW}, ' ') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY array_to_string(k, ' ')) AS class, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS g FROM w WHERE len(k) >= 30),
c AS (SELECT class, g, len(g) AS n FROM d WHERE doc_id = class),
s AS (SELECT class, n, unnest(g) AS x FROM c),
p AS (SELECT a.class AS a, b.class AS b, count(*) AS shared, any_value(a.n) + any_value(b.n) AS total FROM s a JOIN s b ON a.x = b.x AND a.class < b.class GROUP BY ALL HAVING count(*) >= 0.9 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
e AS (SELECT a AS class FROM p UNION ALL SELECT b FROM p),
l AS (SELECT class, count(*) AS links FROM e GROUP BY class)
SELECT d.doc_id, d.class, coalesce(l.links, 0) AS links FROM d LEFT JOIN l USING (class)
""",
    "source_manifest": f"WITH d AS (SELECT doc_id, concat_ws('/', source, CAST(doc_id AS VARCHAR)) AS path, text FROM documents WHERE text IS NOT NULL), e AS (SELECT path, text AS e FROM d WHERE doc_id % 11 <> 0), a AS (SELECT path, regexp_replace(text, '^{_WS}|{_WS}$', '', 'g') AS a FROM d WHERE doc_id % 13 <> 0), s AS (SELECT path, CASE WHEN a IS NULL THEN 'missing' WHEN e IS NULL THEN 'extra' WHEN e <> a THEN 'modified' END AS state FROM e FULL JOIN a USING (path)) SELECT * FROM s WHERE state IS NOT NULL",
    "sources_by_language": "SELECT coalesce(lower(lang), '?') AS lang, doc_kind, count(*) AS documents, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars FROM documents GROUP BY ALL",
}
