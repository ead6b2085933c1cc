"""The operators' registered queries, each over its whole table, and SQL twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm import ann, chat, langid, mixing, neardup, packing, quality, repeats, tokens, vectorcodes, warc, whiten, wrapper
from callscope.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


@query
def op1_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch_dir(spark, "warc")
    warc.write_archives(pages, path)
    records = scratch_dir(spark, "warc-records")
    warc.read_archives(spark, path).write.parquet(records)
    return warc.resolve(spark.read.parquet(records)).select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"), "error"
    )


ORACLES["op1_warc_zstd"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE octet_length(encode(html)) >= 100 GROUP BY d)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN coalesce(first, page_id) = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN coalesce(first, page_id) <> page_id THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM p LEFT JOIN f ON p.d = f.d
"""


def page_evidence(pages: DataFrame) -> DataFrame:
    """Markup language, address suffix and host of the page that shows a document, whose id its address ends with."""
    address = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    number = F.nullif(F.regexp_extract(address, r"/([0-9]{1,18})(?:\.html)?/?$", 1), F.lit(""))
    top = F.substring_index(wrapper.host_of("url"), ".", -1)
    suffix = F.when(F.length(top) == 2, top).otherwise(F.coalesce(F.nullif(F.regexp_extract(address, r"^/([a-z]{2})/", 1), F.lit("")), top))
    found = pages.select(
        number.cast("long").alias("_number"),
        F.struct(
            "page_id",
            langid.language_code(F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z-]+)""", 1)).alias("markup"),
            suffix.alias("suffix"),
            wrapper.host_of("url").alias("host"),
        ).alias("page"),
    )
    return found.where("_number is not null").groupBy("_number").agg(F.min("page").alias("page")).select("_number", "page.markup", "page.suffix", "page.host")


@query
def op2_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    path = scratch_dir(spark, "language-votes")
    langid.with_likelihoods(docs, model, "text", ["doc_id", "lang", "source"]).write.parquet(path)
    pages = page_evidence(table(spark, sf_dir, "pages"))
    rows = spark.read.parquet(path).join(pages, F.col("doc_id") == F.col("_number"), "left").select(
        "doc_id",
        F.coalesce("markup", langid.language_code("lang")).alias("_declared"),
        F.col("suffix").alias("_suffix"),
        F.coalesce("host", "source").alias("_host"),
        "_likelihoods", "_vote", "_words",
    )
    path = scratch_dir(spark, "language-evidence")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    return langid.fuse(rows, rows).select(
        "doc_id", "language", "posterior", "text_language", F.col("_declared").alias("declared"), F.col("_suffix").alias("suffix"), F.col("_host").alias("host"), "kept"
    )


@query
def op3_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op4_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


@query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.sizes(table(spark, sf_dir, "documents"))
    return mixing.mix(sizes, sizes).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


ORACLES["op6_source_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
l(n, level) AS (
  SELECT 0, 1.5::DOUBLE * sum(source_size) / sum(weight) FROM w
  UNION ALL
  SELECT n + 1, (SELECT (1.5::DOUBLE * sum(source_size) - 2.0::DOUBLE * coalesce(sum(source_size) FILTER (WHERE 2.0::DOUBLE * source_size < weight * level), 0))
    / sum(weight) FILTER (WHERE NOT 2.0::DOUBLE * source_size < weight * level) FROM w)
  FROM l WHERE n < 50),
t AS (SELECT w.*, CASE WHEN 2.0::DOUBLE * source_size < weight * level THEN 2.0::DOUBLE * source_size ELSE weight * level END AS target
  FROM w, (SELECT arg_max(level, n) AS level FROM l)),
r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST('0x' || md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), ''))[1:13] AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target, rate, CAST(floor(rate) + CAST(draw < rate - floor(rate) AS INT) AS BIGINT) AS copies,
  CAST(size * (floor(rate) + CAST(draw < rate - floor(rate) AS INT)) AS BIGINT) AS taken
FROM r
"""


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


@query
def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op8_minhash_neardup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w),
c AS (SELECT list_sort(sh) AS sh, min(doc_id) AS class_id FROM s WHERE len(sh) > 0 GROUP BY 1),
u AS (SELECT class_id, len(sh) AS n, unnest(sh) AS g FROM c),
p AS (
  SELECT a.class_id AS a, b.class_id AS b FROM u a JOIN u b ON a.g = b.g AND a.class_id <> b.class_id
  GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(a, root) AS (SELECT class_id, class_id FROM c UNION SELECT r.a, p.b FROM r JOIN p ON r.root = p.a),
m AS (SELECT a, min(root) AS root FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.root, s.doc_id) AS component_id,
  coalesce(m.root, s.doc_id) = s.doc_id AS kept, coalesce(c.class_id, s.doc_id) AS class_id
FROM s LEFT JOIN c ON list_sort(s.sh) = c.sh LEFT JOIN m ON m.a = c.class_id
"""


@query
def op9_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], rows.schema)
    return chat.digests(chat.format_trees(chat.as_replies(rows.union(more)))).select(
        F.when(F.col("tree") != "", F.col("tree")).cast("long").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


def _turns_sql() -> str:
    """Lengths of the marks around a turn come from the template; every control string gets one character more."""
    marks = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in chat.MARKS.items())
    control = r"<\\*(?:/?s>|</?SYS>>)|\[\\*(?:/?INST\]|/?ROLE\]|/TURN\])"
    escaped = lambda x: f"length({x}) + len(regexp_extract_all({x}, '{control}'))"
    return f"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(n, r)),
t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (WHERE r = '{chat.LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY n) FILTER (WHERE r = '{chat.LOSS_ROLE}'), '')) AS loss_sha256,
  CAST(sum({escaped('x')} + CASE r {marks} ELSE {sum(map(len, chat.OTHER))} + {escaped('r')} END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


ORACLES["op9_reply_trees"] = _turns_sql()


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "code", F.col("error").cast("long").alias("error"), F.col("label_error").cast("long").alias("label_error"), "codebooks_sha256"
    )


def _codes_sql(parts: int = vectorcodes.PARTS, entries: int = vectorcodes.ENTRIES, rounds: int = vectorcodes.ROUNDS) -> str:
    """Every round as two tables: the parts with their nearest entry, and the entries' new places."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT p.row, p.part, any_value(p.y) AS y, min(list_sum(list_transform(list_zip(p.y, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {entries} + c.entry) AS best
  FROM p JOIN c{k} c ON p.part = c.part GROUP BY p.row, p.part)""")
        if k < rounds:
            steps.append(f"""
m{k} AS (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y
  FROM (SELECT part, best % {entries} AS entry, i, sum(y[i])::HUGEINT AS s, count(*) AS n FROM a{k}, range(1, 1 + (SELECT max(len(y)) FROM p)) r(i) GROUP BY ALL)
  GROUP BY part, entry),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.y, c.y) AS y FROM c{k} c LEFT JOIN m{k} m ON m.part = c.part AND m.entry = c.entry)""")
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor({vectorcodes.SCALE} * CAST(x AS DOUBLE)) AS HUGEINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT row, vec_id, part, x[part * (len(x) // {parts}) + 1 : (part + 1) * (len(x) // {parts})] AS y FROM v, range({parts}) r(part)),
c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, y
  FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries})),{",".join(steps)},
e AS (
  SELECT row, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN e ON v.row = e.row, h
"""


ORACLES["op12_vector_codes"] = _codes_sql()


@query
def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents")).drop("spans")


ORACLES["op13_repeated_passages"] = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT row, i, array_to_string(ws[i : i + 34], ' ') AS win FROM (SELECT row, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
t AS (SELECT win FROM g GROUP BY win HAVING count(*) > 1),
r AS (SELECT DISTINCT row, unnest(range(i, i + 35)) AS pos FROM g SEMI JOIN t ON g.win = t.win),
w AS (SELECT row, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
k AS (SELECT row, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM w ANTI JOIN r ON w.row = r.row AND w.pos = r.pos GROUP BY row)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.row = k.row
"""
