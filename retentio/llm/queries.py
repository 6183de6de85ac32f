"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import with_token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_token_counts(docs, tokenizer("byte_bpe_50k.json")).drop("text")


@query("""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
                  regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size,
             first(doc_id ORDER BY length(text) DESC, doc_id) AS keep_id FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import verdicts

    return verdicts(table(spark, sf_dir, "documents"))


@query()
def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import round_trip

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, tokenizer("word_bpe_49k.json")).drop("text")


@query()
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query()
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


@query("""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
                  lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0') AS bits FROM documents),
p AS (SELECT doc_id, n_bytes, depth, left(bits, depth) AS prefix FROM d, (SELECT unnest(range(0, 61)) AS depth)),
s AS (SELECT prefix, depth, sum(n_bytes) AS shard_bytes, count(*) AS shard_docs FROM p GROUP BY prefix, depth
      HAVING sum(n_bytes) <= 2097152 OR count(*) = 1)
SELECT p.doc_id, p.n_bytes, p.prefix AS shard_id, p.depth::INT AS depth, s.shard_bytes::BIGINT AS shard_bytes, s.shard_docs
FROM p JOIN s USING (prefix, depth)
QUALIFY row_number() OVER (PARTITION BY p.doc_id ORDER BY depth) = 1
""")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign

    return assign(table(spark, sf_dir, "documents"))


#: a conversation that consists of control strings, formatted beside the table
CONTROL = """
SELECT cast(-7 AS BIGINT) AS conv_id, cast(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text
FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)
"""


@query("""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(text, '<', '<\\'), '[', '[\\') AS body FROM c),
a AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '') AS loss,
             sum(length(body) + length(role) + 10) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM a
""")
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import as_messages, digests, format_trees

    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(CONTROL))
    return digests(format_trees(as_messages(told)))


@query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, with_scores

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_scores(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")


@query()
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import fit, report

    docs = table(spark, sf_dir, "documents")
    return report(docs, fit(docs))


#: the rules that op11 judges by
URL_RULES = """
SELECT host, path, verdict FROM VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
       ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS t(host, path, verdict)
"""


@query("""
WITH r(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM s),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT *, (SELECT arg_max({'rule': rhost || rpath, 'verdict': verdict}, length(rhost || rpath)) FROM r
                 WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS best FROM u)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM m
""")
def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages"), spark.sql(URL_RULES))


def _crc32(text: str) -> str:
    """DuckDB: CRC-32 of a string's UTF-8 bytes, bit by bit."""
    byte = f"('0x' || substr(hex(encode({text})), (2 * j + 1)::INT, 2))::BIGINT"
    step = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({text}))), lambda j: {byte})), lambda c, b: {step}))"


@query(f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                              coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
c AS (SELECT *, {_crc32('k')} % 20 AS code FROM raw),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
             CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS again FROM c),
o AS (SELECT *, regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS body,
             sha256(length(role)::VARCHAR || ':' || role || text) AS digest FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest, again) AS i,
             row_number() OVER (PARTITION BY conv_id, digest ORDER BY turn NULLS FIRST, again) > 1 AS seen FROM o),
r AS (SELECT *, left(role, 1) AS ini, CASE WHEN body = '' THEN 'blank' WHEN seen THEN 'duplicate'
             WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f),
n AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM r),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n_rows FROM n GROUP BY conv_id),
-- states: 0 start, 1 after system, 2 after user, 3 after assistant; up to two inserts lead from one to another
ins(q, q2, more, letters, turns) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
    (0, 2, 3, 'I', chr(10) || 'user:'), (1, 2, 3, 'I', chr(10) || 'user:'), (3, 2, 3, 'I', chr(10) || 'user:'), (2, 3, 3, 'I', chr(10) || 'assistant:'),
    (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
keep(q, ini, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
path AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, {{'cost': 0, 'audit': '', 'told': ''}} AS best FROM counts
  UNION ALL
  SELECT conv_id, i + 1, q3, min(best) FROM (
    SELECT p.conv_id, p.i, e.q3, {{'cost': p.best.cost + ins.more + e.cost, 'audit': p.best.audit || ins.letters || e.letter,
                                   'told': p.best.told || ins.turns || e.turns}} AS best
    FROM path p JOIN ins ON ins.q = p.q JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1,
    LATERAL (SELECT 'D' AS letter, 4 AS cost, ins.q2 AS q3, '' AS turns
      UNION ALL SELECT 'K', CASE WHEN r.fault = 'truncated' THEN 3 ELSE 0 END, k.q2, chr(10) || r.role || ':' || r.text
        FROM keep k WHERE k.q = ins.q2 AND k.ini = r.ini AND r.fault NOT IN ('blank', 'duplicate')
      UNION ALL SELECT 'R', CASE WHEN r.fault = 'truncated' THEN 6 ELSE 3 END, CASE WHEN ins.q2 = 2 THEN 3 ELSE 2 END,
        chr(10) || CASE WHEN ins.q2 = 2 THEN 'assistant:' ELSE 'user:' END || r.text WHERE r.fault NOT IN ('blank', 'duplicate')) e)
  GROUP BY conv_id, i, q3),
done AS (SELECT p.conv_id, min({{'cost': p.best.cost + ins.more, 'audit': p.best.audit || ins.letters, 'told': p.best.told || ins.turns}}) AS best
         FROM path p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n_rows = p.i JOIN ins ON ins.q = p.q
         WHERE ins.q2 IN (0, 3) GROUP BY p.conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(d.best.cost, 0)::BIGINT AS cost,
       coalesce(d.best.audit, '') AS audit, sha256(coalesce(substr(d.best.told, 2), '')) AS repaired_sha256
FROM ids LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM ids.conv_id
""")
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damaged, report

    return report(damaged(table(spark, sf_dir, "conversations")))


@query(f"""
WITH low AS (SELECT row_number() OVER () AS row, doc_id, md5(coalesce(text, '')) AS digest,
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
d AS (SELECT row, doc_id, digest, regexp_extract_all(body, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM low),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM benchmark),
dw AS (SELECT row, unnest(words) AS word FROM d), bw AS (SELECT unnest(words) AS word FROM b),
known AS (SELECT word, {_crc32('word')} % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
ds AS (SELECT bucket, count(*) AS n FROM dw JOIN known USING (word) GROUP BY bucket),
bs AS (SELECT bucket, count(*) AS n FROM bw JOIN known USING (word) GROUP BY bucket),
g AS (SELECT ds.bucket, floor(1000.0::DOUBLE * ln(((coalesce(bs.n, 0) + 1) * ((SELECT sum(n) FROM ds) + 10000)::DOUBLE)
                                                  / ((ds.n + 1) * ((SELECT coalesce(sum(n), 0) FROM bs) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM ds LEFT JOIN bs USING (bucket)),
w AS (SELECT row, sum(gain)::DOUBLE AS total, count(*) AS n FROM dw JOIN known USING (word) JOIN g USING (bucket) GROUP BY row),
s AS (SELECT d.row, d.doc_id, d.digest, len(d.words)::BIGINT AS n_features, coalesce(floor(w.total / w.n), 0)::BIGINT AS weight,
             (('0x' || left(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS share
      FROM d LEFT JOIN w USING (row)),
t AS (SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln(share)))::BIGINT AS score, n_features >= 20 AS fit FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST, digest) AS place, count(*) FILTER (fit) OVER () AS n FROM t)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 10 * n // 100 THEN place END AS rank FROM k
""")
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
