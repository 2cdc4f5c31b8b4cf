"""One query for each operator, over its whole table, with production parameters; and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesframe.llm import fingerprint, htmlmain, licenses, mixing, neardup, ogg, quality, spm, substring, tables, toxicity, training

PER_CLASS = 20_000  # training label rows of each class, at most


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(frame: DataFrame, n: int, r: int) -> DataFrame:
    return frame.select("doc_id", F.coalesce(training.remainder("doc_id", n) == r, F.lit(False)).alias("held_out"), "score", "predicted")


def op1_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    weights = mixing.tempered_weights(docs)
    return mixing.mix(docs, weights).select("doc_id", "source", *mixing.OUT)


def op2_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = training.labelled(docs, _table(spark, sf_dir, "labels"), label="quality", per_class=PER_CLASS, skip=(4, 2))
    model = quality.fit(rows)
    return _held_out(quality.score(docs, model, keep=["doc_id"]), 4, 2)


def op3_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "n_matches")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.round_trip(_table(spark, sf_dir, "documents"), spm.load(spm.MODEL_PATH))


def op5_fm_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(_table(spark, sf_dir, "documents"))


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.digests(_table(spark, sf_dir, "documents"))


def op7_toxicity_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = training.labelled(docs, _table(spark, sf_dir, "labels"), label="toxic", per_class=PER_CLASS, skip=(5, 0))
    return _held_out(toxicity.score(docs, toxicity.fit(rows), keep=["doc_id"]), 5, 0)


def op8_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    matched = fingerprint.links(docs)
    tables.release(spark)  # before the texts are dealt
    return fingerprint.compare_neighbours(docs, matched=matched)


def op9_tensor_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classify(_table(spark, sf_dir, "documents"))


def op10_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(_table(spark, sf_dir, "pages"), htmlmain.default_model())


QUERIES = {f.__name__: f for f in (op1_pfair_mix, op2_quality_qda, op3_license_rules, op4_sentencepiece, op5_fm_substring, op6_ogg_media, op7_toxicity_nb, op8_minhash_fingerprints, op9_tensor_minhash, op10_html_crf)}

_OP1_SQL = """
WITH RECURSIVE counted AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
shared AS (SELECT source, n, pow(n, 0.7) / sum(pow(n, 0.7)) OVER () * (1000 - count(*) OVER ()) AS x FROM counted),
whole AS (SELECT source, 1 + CAST(floor(x) AS BIGINT) AS a, row_number() OVER (ORDER BY floor(x) - x, source NULLS FIRST) AS place, 1000 - sum(1 + CAST(floor(x) AS BIGINT)) OVER () AS spare FROM shared),
weights AS (SELECT source, CAST(a + CASE WHEN place <= spare THEN 1 ELSE 0 END AS BIGINT) AS a, row_number() OVER (ORDER BY source NULLS FIRST) AS k FROM whole),
total AS (SELECT CAST(sum(a) AS BIGINT) AS d, list(a ORDER BY k) AS av, list(k ORDER BY k) AS ks FROM weights),
slots(t, sent, k) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(av, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM total
  UNION ALL
  SELECT t + 1, list_transform(ks, lambda k: sent[k] + CASE WHEN k = best THEN 1 ELSE 0 END), best
  FROM (
    SELECT t, sent, ks, list_min(list_transform(list_filter(ks, lambda k: (sent[k] * d) // av[k] <= t + 1), lambda k: (((sent[k] + 1) * d + av[k] - 1) // av[k]) * 100000 + k)) % 100000 AS best
    FROM slots, total WHERE t < d - 1
  )
),
turns AS (SELECT k, t AS slot, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS turn FROM slots WHERE t >= 0),
ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, md5(coalesce(text, ''))) - 1 AS r FROM documents
),
placed AS (SELECT r.doc_id, r.source, r.r // 8 AS mix_block, r.r % 8 AS mix_offset, w.a, w.k, d FROM ranked r JOIN weights w ON r.source IS NOT DISTINCT FROM w.source, total)
SELECT doc_id, source, CAST((mix_block // a) * d + slot AS BIGINT) AS mix_slot, mix_block, mix_offset,
  CAST((mix_block * d) // a AS BIGINT) AS mix_release, CAST(((mix_block + 1) * d + a - 1) // a AS BIGINT) AS mix_deadline,
  CAST(((mix_block // a) * d + slot) * 8 + mix_offset AS BIGINT) AS mix_position
FROM placed p JOIN turns t ON t.k = p.k AND t.turn = p.mix_block % p.a
"""


def _op3_sql() -> str:
    """Sentences by regular expressions, known ones numbered, and rules tried in order on the sequence as one string."""
    mark = {name: chr(0x100 + k) for k, (name, _) in enumerate(licenses.SENTENCES)}
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(s)}, {quoted(mark[name])}, {quoted(name)})" for name, s in licenses.SENTENCES)
    left = "seq"
    for k, (_, steps) in enumerate(licenses.RULES):
        left = f"replace({left}, {quoted(''.join(mark[x] for x in steps))}, {quoted(chr(0x2000 + k))})"
    rules = ", ".join(f"({quoted(chr(0x2000 + k))}, {quoted(name)})" for k, (name, _) in enumerate(licenses.RULES))
    return f"""
WITH known(sentence, mark, name) AS (VALUES {known}), rules(mark, licence) AS (VALUES {rules}),
cut AS (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '([.!?;:])[ \\t\\f\\x0B\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM cut),
plain AS (SELECT doc_id, i, regexp_replace(trim(regexp_replace(regexp_replace(lower(s), '["'',;:*#‘’“”]', ' ', 'g'), '\\s+', ' ', 'g')), '[ .!?]+$', '') AS s FROM lines),
hits AS (SELECT doc_id, string_agg(mark, '' ORDER BY i) AS seq, string_agg(name, ',' ORDER BY i) AS sentence_ids FROM plain JOIN known ON s = sentence GROUP BY doc_id),
found AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licenses, count(*) AS n FROM (SELECT doc_id, unnest(string_split({left}, '')) AS c FROM hits) JOIN rules ON c = mark GROUP BY doc_id)
SELECT d.doc_id, coalesce(h.sentence_ids, '') AS sentence_ids, coalesce(f.licenses, '') AS licenses, CAST(coalesce(f.n, 0) AS BIGINT) AS n_matches
FROM documents d LEFT JOIN hits h USING (doc_id) LEFT JOIN found f USING (doc_id)
"""


_OP9_SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
),
grams AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM tokens
  )
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, to_id) AS (SELECT a, b FROM ends UNION SELECT r.id, e.b FROM reach r JOIN ends e ON r.to_id = e.a),
least_id AS (SELECT id, min(to_id) AS m FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, coalesce(m, d.doc_id) >= d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_id ON id = d.doc_id
"""


_OP5_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i+34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM windows SEMI JOIN again USING (h)),
gone_lists AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(ks), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN ks IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ks, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone_lists USING (doc_id)
"""


ORACLE_SQL: dict[str, str] = {"op5_fm_substring": _OP5_SQL, "op9_tensor_minhash": _OP9_SQL, "op1_pfair_mix": _OP1_SQL, "op3_license_rules": _op3_sql()}
