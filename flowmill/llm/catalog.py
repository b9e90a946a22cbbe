"""The operators of this subpackage as named queries, next to the SQL they are checked against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.llm import (
    ann, chat, fingerprint, jaccard, licenses, mixing, packing, periods, quality, separators, superkmers, warc, whitening,
)
from flowmill.llm.common import table

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 14 + length(role) END
    + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]|\[\\*ROLE=|\[\\*/ROLE\]'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op2_chat_format", OP2_SQL)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(turns))


OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


@query("op5_warc_revisits", OP5_SQL)
def warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(warc.resolve(table(spark, sf_dir, "pages")))
    records = warc.join_revisits(warc.read_archives(files, payload=False))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_mix_sources")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@query("op10_fingerprints")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_report(table(spark, sf_dir, "documents"))


@query("op1_pack_pow2")
def pack_pow2(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op7_quality_pu")
def quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _values(rows) -> str:
    quoted = ["('{}', '{}')".format(n, t.replace("'", "''")) for n, t in rows]
    return f"(VALUES {', '.join(quoted)}) v(license, text)"


OP8_SQL = f"""
WITH known AS (SELECT sha256({licenses.sql_canonical('text')}) AS digest, min(license) AS license
  FROM {_values(licenses.TEXTS)} GROUP BY 1),
notice AS (SELECT sha256({licenses.sql_canonical('text')}) AS digest, min(license) AS license
  FROM {_values(licenses.NOTICES)} GROUP BY 1),
line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
found AS (SELECT line.doc_id, count(*) AS n, min(license) AS license
  FROM line JOIN notice ON sha256({licenses.sql_canonical('line')}) = notice.digest GROUP BY 1),
doc AS (SELECT doc_id, sha256({licenses.sql_canonical('text')}) AS digest FROM documents)
SELECT doc.doc_id, doc.digest, known.license, coalesce(found.n, 0) AS n_notices, found.license AS notice
FROM doc LEFT JOIN known USING (digest) LEFT JOIN found USING (doc_id)
"""


@query("op8_license_digests", OP8_SQL)
def license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, notices = (spark.createDataFrame(list(rows), "license string, text string") for rows in (licenses.TEXTS, licenses.NOTICES))
    found = licenses.scan(table(spark, sf_dir, "documents"), known, notices)
    return found.select("doc_id", "digest", "license", "n_notices", "notice")


@query("op3_separator_counts")
def separator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return separators.count_tokens(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query("op6_kmeans_tree")
def kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.filter(F.col("vec_id") % 20 == 0))


@query("op4_jaccard_components")
def jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.join(table(spark, sf_dir, "documents"), k=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


OP11_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM doc WHERE len(w) >= 20)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY words ORDER BY doc_id, s) AS nth FROM win) WHERE nth > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM again),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM doc),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY word.i) AS text
  FROM word ANTI JOIN covered ON word.doc_id = covered.doc_id AND word.i = covered.i GROUP BY 1)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""


@query("op11_super_kmers", OP11_SQL)
def super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.report(table(spark, sf_dir, "documents"))


@query("op12_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


# CRC-32 of a short text, byte by byte from its definition
_CRC = """list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))"""

OP13_SQL = rf"""
WITH said AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, xor({_CRC}, 4294967295) AS h FROM documents),
shape AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM said),
doc AS (SELECT doc_id, n, CASE WHEN a < n THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END])
  ELSE w END AS w FROM shape),
word AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM doc),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
isle AS (SELECT doc_id, p, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS isle, i FROM pair),
stretch AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM isle GROUP BY doc_id, p, isle HAVING count(*) + p >= greatest(24, 3 * p)),
run AS (SELECT doc_id, start, length, min(p) AS period FROM stretch GROUP BY ALL),
best AS (SELECT doc_id, start, length, period FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
  ORDER BY length::DECIMAL(38, 18) / period DESC, start, period) AS nth FROM run) WHERE nth = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.i) AS text FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM doc LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op13_periodic_runs", OP13_SQL)
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.report(table(spark, sf_dir, "documents"), rewrite=True)
