"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.llm import (
    centroids,
    chunk_dedup,
    decontam,
    fingerprints,
    periodic_runs,
    sentencepiece_lattice,
    simhash_dedup,
    source_mix,
    suffix_dedup,
    token_counts,
    toxicity,
    url_filter,
    warc,
)
from tickwise.llm.common import cut, table

QUERIES = {}
SQL: dict[str, str] = {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f
    return add


def tokenizer(name: str) -> str:
    """Where the installed package of public tokenizer files keeps ``name``."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _hex(col: str):
    return F.lower(F.lpad(F.hex(col), 16, "0"))


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = sentencepiece_lattice.model_pieces(tokenizer("piece_bpe_32k.model"))
    encoded = sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), pieces)
    return sentencepiece_lattice.decode(encoded, pieces).select(
        "doc_id", F.size("ids").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
         ("net/es/", "block"), ("net/fr/", "block")]


# The small labelled table of the url classifier: invented urls, fixed values.
BLOCKED = """casino-royal.example.com/en/ free-bets.example.net/win/now bets-online.example.org/de/31 poker-bonus.example.com/fr/
    spam-farm.example.org/en/12 link-farm.example.net/es/4 seo-spam.example.com/page/7 cheap-pills.example.com/buy
    www.cheap-pills.example.net/fr/9 online-pharmacy.example.org/pills/ viagra-shop.example.com/en/2 adult-x.example.net/video/3
    adult-cams.example.org/live xxx-tube.example.com/de/8 porn-hub.example.net/es/1 sex-chat.example.org/en/5
    free-money.example.com/claim quick-loans.example.net/apply win-prizes.example.org/lottery lottery-winner.example.com/fr/6
    phishing-login.example.net/account/verify account-verify.example.org/login warez-download.example.com/crack
    torrent-free.example.net/movies hot-singles.example.org/meet replica-watches.example.com/sale crypto-double.example.net/invest
    bad-ads.example.org/click malware-host.example.com/exe clickbait-farm.example.net/en/77""".split()
ALLOWED = """www.example.com/ www.example.org/en/12 example.net/de/31.html blog.example.com/fr/8 blog.garden.example.org/es/404/
    m.news.example.net/en/25 m.theatre.example.com/de/498 docs.example.org/guide/start.html library.example.net/catalog/17
    university.example.com/physics/ www.museum.example.org/fr/1204 weather.example.net/es/88 recipes.example.com/en/575
    www.theories.example.net/en/685 history.example.org/de/252.html maps.example.com/city/9 shop.example.net/books/33
    forum.gardening.example.org/en/770 static.example.com/fr/317.html api.example.net/v1/status blog.tions.example.com/en/43552
    www.theorem.example.org/es/30548.html m.others.example.com/fr/22530/ nation.example.net/en/46951 thinking.example.org/de/10773/
    health.example.com/es/27308/ science.example.net/fr/2840 travel.example.org/en/36318 sports.example.com/de/4599
    kids.example.net/es/64""".split()


@query("op2_url_filter")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame([("https://" + u, 1) for u in BLOCKED] + [("https://" + u, 0) for u in ALLOWED],
                                     "url string, blocked int")
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, RULES), labelled)


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2).select(
        "doc_id", _hex("fp").alias("fingerprint"), "component_id")


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.dedup(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


@query("op6_benchmark_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_suffix_array_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), length=400, keep_text=False).drop("kept", "carried")


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query("op9_warc_merkle_audit")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica in which some records rotted, vanished or appeared."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rotten = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    replica = (pages.withColumn("html", rotten).where(F.expr("page_id % 2503 <> 1250"))
               .withColumn("page_id", F.expr("case when page_id % 2003 = 11 then -page_id else page_id end")))
    file = F.expr("abs(page_id) div 1000")
    found = warc.audit(warc.layout(pages, file), warc.layout(replica, file))
    return found.withColumnRenamed("id", "page_id")


SQL["op9_warc_merkle_audit"] = """
WITH replica_pages AS (
  SELECT CASE WHEN page_id % 2003 = 11 THEN -page_id ELSE page_id END AS page_id, url,
         CASE WHEN page_id % 97 = 13 THEN '~' || substring(html, 2) ELSE html END AS html
  FROM pages WHERE page_id % 2503 <> 1250),
bodies AS (
  SELECT 0 AS replica, page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
  UNION ALL SELECT 1, page_id, coalesce(url, ''), coalesce(html, '') FROM replica_pages),
records AS (
  SELECT replica, page_id, abs(page_id) // 1000 AS file,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
         || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
         || CAST(strlen(html) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || html
         || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM bodies),
hashed AS (SELECT replica, page_id, file, strlen(record) AS length, sha256(record) AS digest FROM records),
laid AS (
  SELECT *, row_number() OVER w - 1 AS seq, sum(length) OVER w - length AS start
  FROM hashed WINDOW w AS (PARTITION BY replica, file ORDER BY page_id, digest ROWS UNBOUNDED PRECEDING)),
a AS (SELECT * FROM laid WHERE replica = 0), b AS (SELECT * FROM laid WHERE replica = 1)
SELECT a.file AS file, a.seq AS seq, a.page_id AS page_id, CAST(a.start AS BIGINT) AS "offset", a.length AS length,
       a.digest AS digest,
       CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.file IS NOT DISTINCT FROM a.file AND b.seq = a.seq AND b.digest = a.digest
                         AND b.start = a.start) THEN 'intact'
            WHEN EXISTS (SELECT 1 FROM b WHERE b.file IS NOT DISTINCT FROM a.file
                         AND b.page_id IS NOT DISTINCT FROM a.page_id AND b.digest = a.digest)
            THEN 'moved'
            WHEN EXISTS (SELECT 1 FROM b WHERE b.file IS NOT DISTINCT FROM a.file
                         AND b.page_id IS NOT DISTINCT FROM a.page_id) THEN 'corrupt'
            ELSE 'missing' END AS status
FROM a
UNION ALL
SELECT b.file, b.seq, b.page_id, CAST(b.start AS BIGINT), b.length, b.digest, 'extra'
FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.file IS NOT DISTINCT FROM b.file AND a.page_id IS NOT DISTINCT FROM b.page_id)
"""


@query("op10_document_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(fingerprints.edited_against_next(table(spark, sf_dir, "documents")))
    radius = 3
    counts = found.groupBy("fp").agg(F.count("*").alias("n"))
    asked = found.where("doc_id % 20 = 0").select("fp").distinct()
    near = (fingerprints.within(counts, asked, radius).join(counts, "fp")
            .groupBy(F.col("query").alias("fp")).agg(F.sum("n").alias("n_within_3")))
    return found.join(near, "fp", "left").select(
        "doc_id", "n_chars", "edited_sha256", _hex("fp").alias("fingerprint"),
        _hex("edited_fp").alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.col("doc_id") % 20 == 0, F.col("n_within_3")).alias("n_within_3"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text; one id in ten gets a folded end (the words from one on repeat a period)."""
    docs = table(spark, sf_dir, "documents")
    folded = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h")).selectExpr("doc_id", """
        case when h % 10 = 0 and text rlike '[^ \\\\x09-\\\\x0D]' then array_join(
            transform(array(regexp_extract_all(text, '[^ \\\\x09-\\\\x0D]+', 0)), w -> array_join(
                transform(sequence(0, size(w) - 1), i -> w[int(
                    case when i < (h div 10) % size(w) then i
                         else (h div 10) % size(w) + (i - (h div 10) % size(w))
                              % (1 + (size(w) - (h div 10) % size(w)) div (3 + (h div 10) % 8)) end)]), ' ')), '')
        else text end as text""")
    found = periodic_runs.periodic_runs(folded, least=6, exponent=4)
    top = F.expr("get(array_sort(runs, (a, b) -> case when a.length <> b.length then int(sign(b.length - a.length)) "
                 "when a.start <> b.start then int(sign(a.start - b.start)) else int(sign(a.period - b.period)) end), 0)")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return (found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256")))


@query("op12_centroid_clustering")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.described(*centroids.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64,
                                                  seed=1))


@query("op13_source_mix")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"), weights=[3, 1, 2], share_percent=150, epochs=2, fills=2, seed=1)


def _beginning_sql(i: int, rows: str, rest: str) -> str:
    """One step of the seeded sample: what is taken from the beginning of ``rows`` and what is left of ``rest``."""
    return f"""sums{i} AS (
  SELECT n, place, sum(sum(size)) OVER (PARTITION BY n ORDER BY place) AS words FROM {rows} GROUP BY n, place),
step{i} AS (
  SELECT r.n, r.rest AS most, coalesce(max(s.place), '') AS upto, r.rest - coalesce(max(s.words), 0) AS rest
  FROM {rest} r LEFT JOIN sums{i} s ON s.n = r.n AND s.words <= r.rest GROUP BY r.n, r.rest),
rows{i + 1} AS (
  SELECT d.* FROM {rows} d JOIN step{i} s USING (n) WHERE d.place > s.upto AND d.size <= s.rest AND d.size > 0)"""


# The level by the closed form: in order of the level that clamps them, the first k sources are clamped
# where the level that the rest would share is not below the last of theirs.
SQL["op13_source_mix"] = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+')) AS BIGINT) AS size,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS place
  FROM documents),
sums AS (
  SELECT row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n, source, CAST(sum(size) AS HUGEINT) AS source_size
  FROM sized GROUP BY source),
sources AS (SELECT *, CAST([3, 1, 2][n % 3 + 1] AS HUGEINT) AS weight FROM sums),
ordered AS (
  SELECT *, row_number() OVER w AS k, sum(source_size) OVER w AS clamped_size, sum(weight) OVER w AS clamped_weight,
         sum(source_size) OVER () * 150 AS words, sum(weight) OVER () AS weights
  FROM sources WINDOW w AS (ORDER BY 2.0 * source_size / weight, n ROWS UNBOUNDED PRECEDING)),
levels AS (
  SELECT 0 AS k, max(words) AS words, max(weights) AS weights FROM ordered
  UNION ALL SELECT k, words - 200 * clamped_size, weights - clamped_weight FROM ordered),
level AS (
  SELECT l.words AS words, l.weights AS weights FROM levels l LEFT JOIN ordered o ON o.k = l.k + 1
  WHERE l.weights > 0 AND o.weight * l.words < o.source_size * 200 * l.weights ORDER BY l.k LIMIT 1),
plan AS (
  SELECT n, source, source_size, weight * words >= source_size * 200 * weights AS clamped, weight, words, weights
  FROM sources, level),
targets AS (
  SELECT n, source, source_size,
         CASE WHEN clamped THEN CAST(2 * source_size AS DOUBLE)
              ELSE CAST(weight * words AS DOUBLE) / CAST(100 * weights AS DOUBLE) END AS target,
         CASE WHEN clamped THEN 2 ELSE (weight * words // (100 * weights)) // source_size END AS whole,
         CASE WHEN clamped THEN 0 ELSE (weight * words // (100 * weights)) % source_size END AS rest
  FROM plan),
rows0 AS (SELECT s.*, t.n FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
{_beginning_sql(0, "rows0", "targets")},
{_beginning_sql(1, "rows1", "step0")},
{_beginning_sql(2, "rows2", "step1")}
SELECT r.doc_id AS doc_id, r.source AS source, r.size AS size, CAST(t.source_size AS BIGINT) AS source_size,
       t.target AS target,
       CAST(t.whole + CASE WHEN r.place <= a.upto OR (r.place <= b.upto AND r.size <= b.most AND r.size > 0)
                           OR (r.place <= c.upto AND r.size <= c.most AND r.size > 0) THEN 1 ELSE 0 END AS BIGINT) AS repeats,
       CAST(r.size * (t.whole + CASE WHEN r.place <= a.upto OR (r.place <= b.upto AND r.size <= b.most AND r.size > 0)
                                OR (r.place <= c.upto AND r.size <= c.most AND r.size > 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rows0 r JOIN targets t USING (n) JOIN step0 a USING (n) JOIN step1 b USING (n) JOIN step2 c USING (n)
"""
