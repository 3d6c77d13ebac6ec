"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, conversations, decontamination, embedding_dedup, jaccard_join, lexical, line_dedup, quality, substring_dedup, suffix_dedup, suffix_tree_lm, token_counts, warc
from tidemark.llm.storage import checkpoint, new_folder, remove, scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_read(spark, sf_dir, "embeddings"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), keep_text=False).drop("kept", "spans")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), keep=False, keep_decoded=False).drop("ids", "decoded")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), keep=False).drop("kept")


def op7_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(_read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(_read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_lines(_read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "kept_sha256")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    with scratch(spark) as stored:
        found = conversations.report(conversations.repair(stored(conversations.cut(conversations.damaged(rows))))).withColumnRenamed("conv_id", "id")
        every = rows.select("conv_id").distinct()
        whole = every.join(found, every["conv_id"].eqNullSafe(found["id"]), "left").drop("id")
        return checkpoint(whole.na.fill(0).na.fill({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("uri"), F.encode("html", "UTF-8").alias("payload"))
    with scratch(spark) as stored:
        path = new_folder(spark)
        warc.write_archives(pages, path)
        records = warc.resolved(stored(warc.read_archives(spark, path, keep_payloads=False)))
        remove(spark, path)
        found = records.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("of_id").cast("long").alias("refers_to"), "status")
        return checkpoint(found)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_bpe": op5_bpe,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_suffix_tree_lm": op7_suffix_tree_lm,
    "op8_token_counts": op8_token_counts,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_warc": op12_warc,
    "op13_lexical_search": op13_lexical_search,
}

#: The same rows by comparing everything with everything, where SQL can say it. Words are runs of other signs than white space.
WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

SQL2 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS least FROM reach GROUP BY 1), degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(vec_id, least), vec_id) AS component_id, vec_id = coalesce(least(vec_id, least), vec_id) AS kept FROM v LEFT JOIN least USING (vec_id) LEFT JOIN degree USING (vec_id)"""

SQL4 = f"""WITH d AS (SELECT doc_id, coalesce({WORDS}, []) AS ws FROM documents), w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
windows AS (SELECT doc_id, p, array_to_string(ws[p : p + 12], ' ') AS piece FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM d WHERE len(ws) >= 13)),
firsts AS (SELECT piece, min(doc_id) AS first FROM windows GROUP BY 1), gone AS (SELECT DISTINCT doc_id, p + k AS p, true AS gone FROM (SELECT doc_id, p, unnest(range(0, 13)) AS k FROM windows JOIN firsts USING (piece) WHERE first < doc_id)),
kept AS (SELECT doc_id, count(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (gone IS NULL), '') AS kept FROM w LEFT JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

SQL6 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), x1 AS (SELECT doc_id, unnest(range(0, length(h) // 2)) AS p, unnest(regexp_extract_all(h, '..')) AS s1 FROM d),
x2 AS (SELECT *, s1 || lead(s1, 1) OVER w AS s2 FROM x1 WINDOW w AS (PARTITION BY doc_id ORDER BY p)), x4 AS (SELECT *, s2 || lead(s2, 2) OVER w AS s4 FROM x2 WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
x8 AS (SELECT *, s4 || lead(s4, 4) OVER w AS s8 FROM x4 WINDOW w AS (PARTITION BY doc_id ORDER BY p)), x16 AS (SELECT *, s8 || lead(s8, 8) OVER w AS s16 FROM x8 WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
x32 AS (SELECT *, s16 || lead(s16, 16) OVER w AS s32 FROM x16 WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
b AS (SELECT doc_id, p, s1 AS byte, s32 || lead(s16, 32) OVER w || lead(s2, 48) OVER w AS piece FROM x32 WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
firsts AS (SELECT piece, min(doc_id) AS first FROM b WHERE piece IS NOT NULL GROUP BY 1),
reached AS (SELECT doc_id, p, byte, max(CASE WHEN first < doc_id THEN p END) OVER (PARTITION BY doc_id ORDER BY p) AS last FROM b LEFT JOIN firsts USING (piece)),
marked AS (SELECT doc_id, p, byte, coalesce(p < last + 50, false) AS gone FROM reached),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM marked),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS kept FROM runs GROUP BY 1)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

SQL9 = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce({WORDS.replace("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p : p + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), least AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(doc_id, least), doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)"""

# One row for each conversation and number of turns that are read: the cheapest (cost, audit, text) for each state of the roles.
_plus = lambda s, cost, letter, line="''": f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': {s}.t || {line}}} END"  # noqa: E731
_said = lambda role, text="text": f"chr(10) || {role} || ':' || {text}"  # noqa: E731
_keep = lambda s, initial: f"CASE WHEN alive AND substr(role, 1, 1) = '{initial}' THEN {_plus(s, '5 * cut', 'K', _said('role'))} END"  # noqa: E731
_role = lambda s, role: f"CASE WHEN alive THEN {_plus(s, '1 + 5 * cut', 'R', _said(chr(39) + role + chr(39)))} END"  # noqa: E731
_more = lambda s, role: _plus(s, 5, "I", f"chr(10) || '{role}:'")  # noqa: E731
_best = lambda *x: f"list_min(list_filter([{', '.join(x)}], lambda v: v IS NOT NULL))"  # noqa: E731

SQL11 = rf"""WITH RECURSIVE bits AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS tbl FROM (SELECT unnest(range(0, 256)) AS n)),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1]))) % 20 AS k FROM conversations, bits),
hurt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM raw WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS final FROM hurt),
marked AS (SELECT *, CASE WHEN final = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, substr(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1, 1) || substr(role, 1, 1) AS pair FROM placed),
turns AS (SELECT conv_id, i, role, text, fault IN ('', 'truncated') AS alive, (fault = 'truncated')::BIGINT AS cut FROM marked),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY 1),
open AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s1, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s2, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s3 FROM counts
UNION ALL SELECT conv_id, i, s0, s1, s2, s3 FROM (SELECT conv_id, i, {_best(_plus("e0", 2, "D"))} AS s0, {_best(_plus("e1", 2, "D"), _keep("e0", "s"))} AS s1,
{_best(_plus("e2", 2, "D"), _keep("e0", "u"), _keep("e1", "u"), _keep("e3", "u"), _role("e0", "user"), _role("e1", "user"), _role("e3", "user"))} AS s2, {_best(_plus("e3", 2, "D"), _keep("e2", "a"), _role("e2", "assistant"))} AS s3
FROM (SELECT *, s0 AS e0, s1 AS e1, {_best("s3", _more("b2", "assistant"))} AS e3, b2 AS e2 FROM (SELECT o.conv_id, t.i, s0, s1, s3, {_best("s2", _more("s0", "user"), _more("s1", "user"), _more("s3", "user"))} AS b2, role, text, alive, cut FROM open o JOIN turns t ON t.conv_id IS NOT DISTINCT FROM o.conv_id AND t.i = o.i + 1)))),
ends AS (SELECT o.conv_id, {_best("s0", "s3", _more("s2", "assistant"), _plus("s1", 10, "II", "chr(10) || 'user:' || chr(10) || 'assistant:'"))} AS e FROM open o JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id AND c.n = o.i)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(substr(e.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ends x ON x.conv_id IS NOT DISTINCT FROM a.conv_id"""

SQL12 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p),
digits AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: a[((('0x' || h[i // 4 * 5 + 1 : i // 4 * 5 + 5])::BIGINT >> (15 - i % 4 * 5)) & 31) + 1]), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, 'ok' AS status FROM d, digits"""

TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL13 = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS doc, {TERMS} AS ts FROM documents WHERE text IS NOT NULL), h AS (SELECT * FROM d WHERE len(ts) > 0),
tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(ts) AS term FROM h) GROUP BY 1, 2), totals AS (SELECT count(*)::BIGINT AS n, sum(len(ts))::BIGINT AS l FROM h),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, n),
asked AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
sizes AS (SELECT doc, doc_id, 100 - 50 + (50 * len(ts) * n) // l AS m FROM h, totals),
scores AS (SELECT item_id, doc, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN sizes USING (doc) GROUP BY 1, 2)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50"""

ORACLE: dict[str, str] = {"op2_embedding_dedup": SQL2, "op4_substring_dedup": SQL4, "op6_suffix_dedup": SQL6, "op9_jaccard_join": SQL9, "op11_conversation_repair": SQL11, "op12_warc": SQL12, "op13_lexical_search": SQL13}
