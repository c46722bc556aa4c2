"""Registered queries of the pipeline's operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscreen.llm import decontam, html_tree, language, lexical, licenses, mixing, quality, quotation, runs, simhash, suffix, topk, urls

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, tuple[Run, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def wrap(run: Run) -> Run:
        QUERIES[name] = (run, sql)
        return run

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUOTE_SQL = r"""
WITH RECURSIVE messages AS MATERIALIZED (
    SELECT *, row_number() OVER () AS msg FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
), raws AS (
    SELECT conv_id, turn, msg, unnest(string_split_regex(coalesce(text, ''), '\r\n|\r|\n')) AS raw,
        generate_subscripts(string_split_regex(coalesce(text, ''), '\r\n|\r|\n'), 1) AS line
    FROM messages
), lines AS (
    SELECT conv_id, turn, msg, line, regexp_replace(raw, '^((?:[ \t]*>)+)[ \t]?', '') AS content,
        length(regexp_replace(regexp_extract(raw, '^((?:[ \t]*>)+)[ \t]?', 1), '[^>]', '', 'g')) AS level
    FROM raws
), marked AS (
    SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY msg ORDER BY line) THEN 0 ELSE 1 END AS fresh FROM lines
), numbered AS (
    SELECT *, sum(fresh) OVER (PARTITION BY msg ORDER BY line) AS run FROM marked
), passages AS MATERIALIZED (
    SELECT conv_id, turn, msg, run, level, string_agg(content, chr(10) ORDER BY line) AS content FROM numbered GROUP BY ALL
), parts AS (
    SELECT *, list_concat([content], string_split(content, chr(10)), string_split_regex(content, '\n[ \t]*\n')) AS texts FROM passages
), keys AS MATERIALIZED (
    SELECT DISTINCT conv_id, turn, msg, run, level, part, part = trim(regexp_replace(lower(content), '\s+', ' ', 'g')) AS whole FROM (
        SELECT *, trim(regexp_replace(lower(unnest(texts)), '\s+', ' ', 'g')) AS part FROM parts)
    WHERE part <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL
), originals AS (
    SELECT conv_id, part, min(turn) AS original FROM keys WHERE level = 0 GROUP BY ALL
), votes AS (
    SELECT k.conv_id, k.turn, msg, run, level, original, count(*) AS n, max(whole::INT) AS whole
    FROM keys k JOIN originals o ON k.conv_id = o.conv_id AND k.part = o.part AND original < k.turn WHERE level > 0 GROUP BY ALL
), links AS MATERIALIZED (
    SELECT conv_id, turn, msg, run, level, arg_max(original, (whole, n, original)) AS original FROM votes GROUP BY ALL
), by_message AS MATERIALIZED (
    SELECT conv_id, turn, msg, count(*) AS n_linked, arg_max(original, (-level, original)) AS parent FROM links GROUP BY ALL
), parents AS MATERIALIZED (
    SELECT conv_id, turn, max(parent) AS parent FROM by_message GROUP BY ALL
), chain AS (
    SELECT conv_id, turn, parent AS root, 1 AS depth FROM parents
    UNION ALL SELECT c.conv_id, c.turn, p.parent, depth + 1 FROM chain c JOIN parents p ON c.conv_id = p.conv_id AND c.root = p.turn
), roots AS (
    SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM chain GROUP BY ALL
), own AS (
    SELECT msg, coalesce(string_agg(content, chr(10) ORDER BY run) FILTER (level = 0), '') AS text,
        count(*) FILTER (level > 0) AS n_quotes, max(level) AS max_level
    FROM passages GROUP BY msg
)
SELECT m.conv_id, m.turn, m.role, regexp_replace(o.text, '^\s+|\s+\z', '', 'g') AS text, n_quotes, coalesce(n_linked, 0) AS n_linked, max_level,
    parent AS parent_turn, coalesce(root, m.turn) AS root_turn, coalesce(depth, 0)::BIGINT AS depth
FROM messages m JOIN own o USING (msg) LEFT JOIN by_message b ON m.msg = b.msg LEFT JOIN roots r ON m.conv_id = r.conv_id AND m.turn = r.turn
"""


@query("op1_quotation_linking", QUOTE_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.threads(table(spark, sf_dir, "conversations"))


TOPK_SQL = """
WITH finite AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scores AS (
    SELECT q.vec_id AS query_id, r.vec_id,
        list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM finite q JOIN finite r ON q.vec_id % 50 = 0 AND q.vec_id != r.vec_id AND len(q.v) = len(r.v)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scores QUALIFY rank <= 5
"""


@query("op2_topk_search", TOPK_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: The list that pages are judged by (fixed values): host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

URL_SQL = r"""
WITH rules(r_host, r_path, verdict) AS (VALUES %s),
parsed AS (
    SELECT page_id, url,
        coalesce(translate(regexp_extract(url, '(?s)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
)
SELECT page_id, host, path,
    (SELECT max_by(r_host || r_path, length(r_host || r_path)) FROM rules
        WHERE (host = r_host OR suffix(host, '.' || r_host)) AND prefix(path, r_path)) AS rule,
    coalesce((SELECT max_by(verdict, length(r_host || r_path)) FROM rules
        WHERE (host = r_host OR suffix(host, '.' || r_host)) AND prefix(path, r_path)), 'allow') AS verdict
FROM parsed
""" % ", ".join(str(r) for r in URL_RULES)


@query("op3_url_filters", URL_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


@query("op4_benchmark_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_GRAMS = ", ".join(
    f"({', '.join('NULL' if v is None else repr(v) if isinstance(v, str) else str(v) for v in row)})"
    for row in licenses.template_rows(licenses.PHRASES, licenses.NOTICES)
)
LICENSE_SQL = rf"""
WITH words AS (
    SELECT doc_id, unnest(w) AS d0, generate_subscripts(w, 1) - 1 AS pos FROM (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
), grams AS (
    SELECT *, lead(d0) OVER near AS d1, lead(d0, 2) OVER near AS d2 FROM words WINDOW near AS (PARTITION BY doc_id ORDER BY pos)
), known(w1, w2, w3, template, label, phrase, place, grams) AS (VALUES {_GRAMS}),
votes AS (
    SELECT doc_id, template, label, phrase, grams, pos - place AS diagonal, bit_or(1::BIGINT << place) AS mask
    FROM grams JOIN known ON d0 = w1 AND d1 = w2 AND (w3 IS NULL OR d2 = w3) GROUP BY ALL
), apart AS (
    SELECT *, CASE WHEN NOT phrase AND diagonal - lag(diagonal) OVER near <= {licenses.DRIFT} THEN 0 ELSE 1 END AS apart
    FROM votes WINDOW near AS (PARTITION BY doc_id, template ORDER BY diagonal)
), copies AS (
    SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS copy FROM apart
), spans AS (
    SELECT doc_id, label, phrase, min(diagonal) AS start, bit_count(bit_or(mask)) / grams AS share
    FROM copies GROUP BY doc_id, template, label, phrase, grams, copy
), found AS (
    SELECT doc_id, count(*) FILTER (phrase AND share = 1) AS n_base, min(start) FILTER (phrase AND share = 1) AS first_word,
        max(start) FILTER (phrase AND share = 1) AS last_word,
        array_to_string(list_sort(list(DISTINCT label) FILTER (phrase AND share = 1)), ',') AS base_labels,
        array_to_string(list_sort(list(DISTINCT label) FILTER (share >= CASE WHEN phrase THEN 1 ELSE {licenses.COVERAGE} END)), ',') AS labels,
        max(share) AS score
    FROM spans GROUP BY doc_id
), counted AS (SELECT doc_id, count(*) AS n_words FROM words GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
    coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM documents LEFT JOIN counted USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op5_license_scan", LICENSE_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH rows AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), by_source AS (
    SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_docs FROM rows GROUP BY source
), weighed AS (
    SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS weight,
        sum(source_size) OVER () AS total
    FROM by_source
), levels AS (
    SELECT *,
        coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, source ASC NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS closed,
        sum(weight) OVER (ORDER BY source_size / weight, source ASC NULLS LAST
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open
    FROM weighed
), level AS (
    SELECT max(l) AS level FROM (
        SELECT (1.5::DOUBLE * total - closed) / open AS l, weight, source_size FROM levels) WHERE l * weight < 2 * source_size
), goals AS (
    SELECT source, source_size, source_docs,
        least((2 * source_size)::DOUBLE, coalesce(level * weight, (2 * source_size)::DOUBLE)) AS target,
        ceil(source_docs / ceil(sqrt((SELECT count(*) FROM rows))))::BIGINT AS shards
    FROM levels, level
), drawn AS (
    SELECT r.doc_id, g.source, size, source_size, target, shards,
        ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS draw
    FROM rows r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source
), dealt AS (
    SELECT *, draw % shards AS shard FROM drawn
), shard AS (
    SELECT source, shard, source_size, target, sum(size)::BIGINT AS shard_size, round(target / 64)::BIGINT AS seats
    FROM dealt GROUP BY ALL
), quotients AS (
    SELECT source, shard, seats, shard_size / (2 * k + 1) AS q, k
    FROM shard, range(0, (SELECT max(ceil(2 * target / 64) + 4)::BIGINT FROM shard)) t(k)
    WHERE k <= 2 * ceil(shard_size / 64) + 4 AND source_size > 0
), won AS (
    SELECT source, shard, count(*) AS won FROM (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY q DESC, shard, k) AS r FROM quotients)
    WHERE r <= seats GROUP BY ALL
), quota AS (
    SELECT s.source, s.shard, shard_size, least(coalesce(won, 0) * 64, 2 * shard_size) AS quota
    FROM shard s LEFT JOIN won w ON s.source IS NOT DISTINCT FROM w.source AND s.shard = w.shard
), placed AS (
    SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY draw, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS till
    FROM dealt
)
SELECT doc_id, p.source, size, source_size, target,
    (greatest(least(till, quota) - (till - size), 0) + greatest(least(till, quota - shard_size) - (till - size), 0))::BIGINT AS taken
FROM placed p JOIN quota q ON p.source IS NOT DISTINCT FROM q.source AND p.shard = q.shard
"""


@query("op6_source_mixing", MIX_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(table(spark, sf_dir, "documents"))


@query("op8_html_extraction")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(table(spark, sf_dir, "pages"))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


LEXICAL_SQL = rf"""
WITH rows AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), docs AS MATERIALIZED (
    SELECT r, doc_id, len(w)::BIGINT AS n, w FROM rows WHERE len(w) > 0
), totals AS (
    SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM docs
), items AS MATERIALIZED (
    SELECT DISTINCT item_id, list_sort(list_distinct(regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS terms FROM benchmark
), postings AS MATERIALIZED (
    SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM docs) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight
    FROM (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term), totals
), impacts AS (
    SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS impact
    FROM postings JOIN weights USING (term), totals
), scored AS (
    SELECT item_id, terms, r, doc_id, sum(impact)::BIGINT AS score
    FROM (SELECT item_id, terms, unnest(terms) AS term FROM items) JOIN impacts USING (term) GROUP BY ALL HAVING sum(impact) > 0
)
SELECT item_id, row_number() OVER (PARTITION BY item_id, terms ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scored QUALIFY rank <= {lexical.DEPTH}
"""


@query("op11_lexical_search", LEXICAL_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _broken(rule: quality.Rule) -> str:
    value, whole = (rule.measure, "1") if rule.of is None else (f"100 * {rule.measure}", rule.of)
    low = [] if rule.low is None else [f"{value} < {rule.low} * {whole}"]
    high = [] if rule.high is None else [f"{value} > {rule.high} * {whole}"]
    return f"({' OR '.join(low + high)})"


_FAILED = ", ".join(f"CASE WHEN {_broken(r)} THEN '{r.name}' END" for r in quality.RULES)
QUALITY_SQL = rf"""
WITH rows AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS lines
    FROM documents
), words AS (
    SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM rows
), near AS (
    SELECT *, lead(word) OVER o AS second, lead(word, 2) OVER o AS third FROM words WINDOW o AS (PARTITION BY r ORDER BY i)
), found AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, word, second, third) AS n FROM near WHERE third IS NOT NULL
), covered AS (
    SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM found, range(0, 3) t(k) WHERE n > 1 GROUP BY r
), stops AS (
    SELECT r, count(*) AS n_stop_words FROM words WHERE lower(replace(word, 'İ', '#')) IN ({", ".join(f"'{x}'" for x in quality.STOP_WORDS)}) GROUP BY r
), line AS (
    SELECT r, unnest(lines) AS line FROM rows
), by_line AS (
    SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
        count(*) FILTER (substr(ltrim(line, ' '), 1, 1) IN ('-', '*', '•')) AS n_bullet_lines
    FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), measured AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_lines, 0) AS n_lines,
        coalesce(n_bullet_lines, 0) AS n_bullet_lines
    FROM rows LEFT JOIN by_line USING (r) LEFT JOIN covered USING (r) LEFT JOIN stops USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {" OR ".join(_broken(r) for r in quality.BASE)} AS base_failed,
    concat_ws(',', {_FAILED}) AS failed, NOT ({" OR ".join(_broken(r) for r in quality.RULES)}) AS kept
FROM measured
"""


@query("op12_quality_rules", QUALITY_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents")).withColumn("failed", F.array_join("failed", ","))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed", "kept")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where in a tenth of the documents, by a checksum of the id, the words go round from a place on."""
    words = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.withColumns({"h": h, "g": F.floor(h / 10)}).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    n = F.size("w")
    a = F.when(n > 0, F.col("g") % n)
    around = chosen.withColumns({"a": a.cast("int"), "p": (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")})
    planted = F.transform("w", lambda x, i: F.when(i >= F.col("a"), F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))).otherwise(x))
    return around.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.size("w") > 0), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


RUNS_SQL = r"""
WITH crc AS MATERIALIZED (
    SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), texts AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        CASE WHEN doc_id IS NOT NULL THEN
            xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) END AS h
    FROM documents, crc
), placed AS (
    SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM texts
), planted AS MATERIALIZED (
    SELECT *, CASE WHEN h % 10 = 0 AND n > 0
        THEN list_transform(range(n), lambda i: w[CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) ELSE i END + 1]) ELSE w END AS v
    FROM placed
), words AS MATERIALIZED (
    SELECT r, n, unnest(v) AS word, generate_subscripts(v, 1) - 1 AS i FROM planted
), pairs AS (
    SELECT a.r, b.i - a.i AS q, a.i FROM words a JOIN words b ON a.r = b.r AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
), islands AS (
    SELECT r, q, min(i) AS start, count(*) + q AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island
    HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS MATERIALIZED (
    SELECT * FROM islands x WHERE NOT EXISTS (
        FROM islands y WHERE y.r = x.r AND y.q < x.q AND y.start <= x.start AND y.start + y.length >= x.start + x.length)
), by_text AS (
    SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed FROM runs GROUP BY r
), best AS (
    SELECT r, start, length, q FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / q DESC, start, q) = 1
), dropped AS (
    SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM runs
), collapsed AS (
    SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (r, i) GROUP BY r
)
SELECT doc_id, n AS n_words, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, floor(1000 * length / q)::BIGINT AS exponent_milli,
    sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM planted LEFT JOIN by_text USING (r) LEFT JOIN best USING (r) LEFT JOIN collapsed USING (r)
"""


@query("op13_periodic_runs", RUNS_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(with_planted_runs(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    milli = F.call_function("div", 1000 * F.col("best.length"), F.col("best.period"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        milli.alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
