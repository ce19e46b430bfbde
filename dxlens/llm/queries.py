"""The registered queries over the test tables and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dxlens.llm import ann, decontaminate, divergence, langid, licenses, line_dedup, mixing, runs, simhash, substring_dedup, token_files, toxicity, warc
from dxlens.llm.common import WORD_PATTERN, read
from dxlens.llm.subwords import held_out

QUERIES = {}
ORACLE_SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL["op1_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, u.i AS i, u.line AS line,
         regexp_replace(translate(u.line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, j: {'i': j, 'line': x})) AS u
        FROM documents)),
held AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.doc_id, l.i, l.line, h.k IS NOT NULL AND l.doc_id <> h.last AS gone
  FROM lines l LEFT JOIN held h ON l.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_and_index(read(spark, sf_dir, "pages"), min_revisit_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op2_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
h AS (SELECT page_id, top, strlen(body) AS payload_bytes, sha1(body) AS hex FROM p),
d AS (
  SELECT page_id, top, payload_bytes,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest
  FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


# the water level in closed form: sources sorted by the level at which they reach
# their cap; the sources before the first one that stays open are capped
ORACLE_SQL["op4_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source),
c AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total, 3.0::DOUBLE * source_size / w AS reach,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM s),
l AS (SELECT arg_min((total - capped) / open_w::DOUBLE, reach) FILTER ((total - capped) / open_w::DOUBLE <= reach) AS level FROM c),
t AS (SELECT source, source_size, least(cap::DOUBLE, w * level) AS target FROM c, l),
f AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 1e-6)::BIGINT // source_size ELSE 0 END AS passes FROM t),
o AS (
  SELECT d.doc_id, d.size, f.source_size, f.target, f.passes, floor(f.target + 1e-6)::BIGINT - f.passes * f.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, (passes * size + greatest(0, least(size, rest - pos)))::BIGINT AS taken FROM o
"""


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle_words=4, max_bits=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "distance", F.col("start").alias("match_start"), F.col("stop").alias("match_stop"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score",
                      (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(read(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL["op3_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d),
h AS (SELECT doc_id, i, sha256(array_to_string(words[i:i + 19], ' ')) AS k FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM h) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM r, range(20) AS t(o)),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) FILTER (g.i IS NULL) AS text, count(g.i) AS n_removed
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


@query
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


TOKENIZER_FILE = "word_bpe_49k.json"
END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER_FILE))


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_files.write_store(read(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return token_files.read_ids(store).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read(spark, sf_dir, "documents"), min_docs=10, top_terms=10)


ORACLE_SQL["op13_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS number, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT number, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT number) >= 10),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
grid AS (
  SELECT g.lang, g.source, k.term, k.lang_n, coalesce(n.n, 0) AS n
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
priced AS (
  SELECT s.*, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v.v) AS p,
         1 + (1000000000::HUGEINT * (lang_n + 2)) // (v.lang_total + 2 * v.v) AS q
  FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total FROM grid) s JOIN v ON s.lang = v.lang),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN priced x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN priced y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM priced WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value,
       row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank
FROM terms QUALIFY rank <= 10
"""


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, chosen by crc32 of the id, a tail of the words repeats with a period.

    A null id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN), 0))
    planted = (docs.select("doc_id", "text", F.expr("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) div 10").alias("g"), words.alias("words"))
               .withColumn("a", F.expr("IF(size(words) > 0, g % size(words), 0)"))
               .withColumn("p", F.expr("1 + (size(words) - a) div (3 + g % 8)")))
    tail = "transform(words, (w, i) -> IF(i < a, w, words[CAST(a + (i - a) % p AS INT)]))"
    return planted.select("doc_id", F.expr(f"IF(size(words) > 0, array_join({tail}, ' '), text)").alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.periodic_runs(with_planted_periods(read(spark, sf_dir, "documents")), min_words=24, min_exponent=3)
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                      F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                      F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                      F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(read(spark, sf_dir, "documents"))
    named = "array_sort(array_distinct(transform({}, x -> x.label)))"
    starts = F.expr("transform(base, x -> x.start)")
    return out.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
                      F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                      F.expr(f"array_join({named.format('base')}, ',')").alias("base_labels"),
                      F.expr("array_join(array_sort(array_union(transform(base, x -> x.label), "
                             "transform(filter(matches, x -> x.verified), x -> x.label))), ',')").alias("labels"),
                      F.round("score", 6).alias("score"))


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(str(v) if isinstance(v, (int, list)) else f"'{v}'" for v in r) + ")" for r in rows) + ")"


def _license_sql(anchors: int = 8, slack: int = 8, min_share: float = 0.5) -> str:
    """The scan as joins: postings by word, alignments by a range join, phrases by list slices."""
    split = [[w.decode() for w in licenses.split_words(t.text.encode())] for t in licenses.TEMPLATES]
    phrase = [(t, p.split()) for t, template in enumerate(licenses.TEMPLATES) for p in template.phrases]
    place = [next(i for i in range(len(split[t])) if split[t][i:i + len(p)] == p) for t, p in phrase]
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
tpl AS (SELECT * FROM {_values([(i, t.label) for i, t in enumerate(licenses.TEMPLATES)])} AS x(t, label)),
tw AS (SELECT * FROM {_values([(t, i, w) for t, words in enumerate(split) for i, w in enumerate(words)])} AS x(t, place, word)),
ph AS (SELECT * FROM {_values([(t, at, p) for (t, p), at in zip(phrase, place)])} AS x(t, place, phrase)),
bp AS (SELECT * FROM {_values([(p.split(), label) for p, label in licenses.BASE])} AS x(phrase, label)),
w AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM d),
wt AS (
  SELECT v.word, round(1000000 * (1 + ln((1 + (SELECT count(*) FROM d))::DOUBLE / (1 + count(DISTINCT w.r)))))::BIGINT AS weight
  FROM (SELECT DISTINCT word FROM tw) v LEFT JOIN w ON w.word = v.word GROUP BY v.word),
an AS (
  SELECT t, word, weight FROM (SELECT DISTINCT t, word FROM tw) JOIN wt USING (word)
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY weight DESC, word) <= {anchors}),
tot AS (SELECT t, sum(weight) AS total FROM an GROUP BY t),
hits AS (SELECT DISTINCT w.r, an.t, w.i - tw.place AS a, an.word, an.weight FROM w JOIN an ON an.word = w.word JOIN tw ON tw.t = an.t AND tw.word = an.word),
win AS (
  SELECT r, t, a, sum(weight) AS held FROM (
    SELECT DISTINCT s.r, s.t, s.a, h.word, h.weight
    FROM (SELECT DISTINCT r, t, a FROM hits) s JOIN hits h ON h.r = s.r AND h.t = s.t AND h.a BETWEEN s.a AND s.a + {slack})
  GROUP BY r, t, a),
seen AS (
  SELECT win.r, win.t, win.a, held::DOUBLE / total AS share,
         held >= {min_share} * total AND bool_and(len(list_filter(range(greatest(0, win.a + ph.place - {slack}), win.a + ph.place + {2 * slack + 1}),
                                                                 lambda x: d.words[x + 1 : x + len(ph.phrase)] = ph.phrase)) > 0) AS verified
  FROM win JOIN tot USING (t) JOIN ph USING (t) JOIN d ON d.r = win.r
  GROUP BY win.r, win.t, win.a, held, total),
best AS (
  SELECT r, label, coalesce(max(share) FILTER (verified), max(share) / 2) AS score, bool_or(verified) AS verified
  FROM seen JOIN tpl USING (t) GROUP BY r, t, label),
base AS (
  SELECT d.r, x.i AS start, bp.label
  FROM w AS x JOIN bp ON x.word = bp.phrase[1] JOIN d ON d.r = x.r AND d.words[x.i + 1 : x.i + len(bp.phrase)] = bp.phrase),
b AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
      FROM base GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
      FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM best WHERE verified) GROUP BY r),
s AS (SELECT r, max(score) AS score FROM best GROUP BY r)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(s.score, 0) END::DOUBLE, 6) AS score
FROM d LEFT JOIN b ON b.r = d.r LEFT JOIN l ON l.r = d.r LEFT JOIN s ON s.r = d.r
"""


ORACLE_SQL["op11_license_scan"] = _license_sql()
