"""The registered queries of this package and the SQL that must give the same rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, exact_dedup, html_extract, language_model, licenses, line_dedup, periodic_runs, sentencepiece_lattice, sharding, simhash, spelling, toxicity, warc
from tickloom.llm.common import hex_of, read
from tickloom.sources.session import new_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(rf"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, list_aggregate(w[i:i + least(len(w), 10) - 1], 'string_agg', ' ') AS win, least(len(w), 10) AS m
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
occ AS (
  SELECT doc_id, i, m, list_aggregate(w[i:i + m - 1], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM win))),
real AS (SELECT occ.doc_id, occ.i, occ.m, win.item_id FROM occ JOIN win USING (win, m)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM real) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM real) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op1_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate.decontaminate(read(spark, d, "documents"), read(spark, d, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query()
def op2_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("""
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents
""")
def op3_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, d, "documents"))


@query()
def op4_simhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, d, "documents"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


@query()
def op5_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    return sentencepiece_lattice.round_trip(spark, read(spark, d, "documents"))


@query()
def op6_html_extract(spark: SparkSession, d: str) -> DataFrame:
    return html_extract.extract(read(spark, d, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query()
def op7_lm_scoring(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    learned = docs.where(~language_model.held_out())
    counts = language_model.count_words(learned)
    scored = language_model.score(docs, counts, language_model.train(learned, counts))
    return scored.withColumn("held_out", language_model.held_out())


@query()
def op8_sharding(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    placed = sharding.shard(docs)
    return placed.select(
        "doc_id",
        F.col("_size").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
s AS (SELECT key, max(doc_id) AS stays FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.stays AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
""")
def op9_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


def _spelled(c: str) -> str:
    """SQL for a line of single-blank-separated words with common spellings; blanks are doubled so that neighbours both match."""
    out = f"replace(' ' || {c} || ' ', ' ', '  ')"
    for other, common in licenses.SPELLINGS.items():
        out = f"replace({out}, ' {other} ', ' {common} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _known_sql() -> str:
    known = {" ".join(filter(None, map(licenses.canonical_line, text.split("\n")))): licence for licence, text in licenses.known_texts()}
    return ", ".join(f"('{text}', '{licence}')" for text, licence in known.items())


@query(rf"""
WITH known(canonical, licence) AS (VALUES {_known_sql()}),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
w AS (SELECT doc_id, pos, trim(regexp_replace(lower(line), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS words FROM l
  WHERE NOT regexp_matches(line, '(?i)^[^\p{{L}}\p{{N}}_]*(copyright|\(c\)|©|all rights reserved)')),
c AS (SELECT doc_id, pos, {_spelled('words')} AS canonical FROM w WHERE words <> ''),
t AS (SELECT doc_id, string_agg(canonical, ' ' ORDER BY pos) AS canonical FROM c GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS names FROM c JOIN known USING (canonical) GROUP BY doc_id)
SELECT d.doc_id, k.licence, CAST(coalesce(n.n, 0) AS BIGINT) AS n_notices, coalesce(n.names, '') AS notice_licences
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN known k ON k.canonical = t.canonical LEFT JOIN n ON n.doc_id = d.doc_id
""")
def op10_license_scan(spark: SparkSession, d: str) -> DataFrame:
    found = licenses.scan(read(spark, d, "documents"), licenses.known_digests(spark))
    names = F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["licence"])))
    return found.select("doc_id", "licence", F.size("notices").cast("long").alias("n_notices"), F.concat_ws(",", names).alias("notice_licences"))


@query(rf"""
WITH RECURSIVE
tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
run AS (
  SELECT doc_id, w, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents)
  WHERE length(w) >= 7 GROUP BY doc_id, w),
coded AS (SELECT w, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM run),
hashed AS (
  SELECT w, k, xor(4294967295, list_reduce(list_transform(range(1, len(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), CAST(4294967295 AS BIGINT))) AS h FROM coded, tab),
made AS (SELECT CASE WHEN h % 31 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, k FROM hashed),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
gap AS (SELECT DISTINCT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM gap a JOIN gap b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gap a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gap a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, struct_pack(a := -m, b := other)) AS other FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
led AS (SELECT word, word AS root, form AS step FROM f UNION ALL SELECT led.word, f.word, f.form FROM led JOIN f ON f.word = led.step)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN (SELECT word, root FROM led WHERE step IS NULL) USING (word)
""")
def op11_spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    return spelling.variants(spelling.count_words(read(spark, d, "documents"), plant=True))


@query("""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS stays FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = stays THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> stays THEN stays END AS refers_to FROM f
""")
def op12_warc(spark: SparkSession, d: str) -> DataFrame:
    folder = new_path(spark, "archives")
    warc.write_archives(read(spark, d, "pages"), folder)
    records = warc.read_archives(spark, folder).where("problem is null")
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    full = F.col("type") == "response"
    return records.select(
        page("record_id").alias("page_id"),
        F.when(full, F.octet_length("payload")).otherwise(F.col("fields")["x-payload-length"].try_cast("long")).cast("long").alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.substring(F.col("fields")["warc-payload-digest"], 8, 64)).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(~full, page(F.col("fields")["warc-refers-to"])).alias("refers_to"),
    )


@query()
def op13_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    docs = periodic_runs.with_planted_periods(read(spark, d, "documents"))
    found = periodic_runs.periodic_runs(docs, "doc_id")
    # runs come by start, then period, so the first of equal exponents is the one to report
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda x, r: F.when(r["length"] * x["period"] > x["length"] * r["period"], r).otherwise(x))
    rows = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    found = found.withColumn("_best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(rows, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
