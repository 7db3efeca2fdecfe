"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, language_id, license_scan, line_dedup, ngram_join, packing, periodic_runs, prefix_trie, quality_crf, quality_rules,
    sentence_pieces, suffix_dedup, token_files,
)
from .common import cut, ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STATEMENTS: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"))
    return token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "carried.doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("starts").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "item_id", "n_grams", "n_found", (F.col("n_found") / F.col("n_grams")).alias("containment"))


STATEMENTS["op9_decontaminate"] = r"""
WITH split AS (
  SELECT doc_id AS id, 0 AS kind, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT item_id, 1, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') FROM benchmark
), grams AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM split
), sizes AS (SELECT id AS item_id, count(*) AS n_grams FROM grams WHERE kind = 1 GROUP BY id),
found AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_found FROM grams i JOIN grams d ON d.g = i.g AND d.kind = 0 AND i.kind = 1 GROUP BY ALL
)
SELECT doc_id, item_id, n_grams, n_found, n_found / n_grams AS containment FROM found JOIN sizes USING (item_id) WHERE 5 * n_found >= 4 * n_grams
"""


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.zip_with("starts", "ends", lambda a, b: F.concat_ws("-", a, b)), ",")
    chars = F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return out.select("doc_id", "n_units", "n_repeated", chars.alias("n_removed"), spans.alias("removed"), F.sha2("kept", 256).alias("kept_sha256"))


STATEMENTS["op7_line_dedup"] = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS units FROM documents),
each AS (SELECT doc_id, unnest(units) AS unit, unnest(range(len(units))) AS nth FROM docs),
placed AS (
  SELECT *, coalesce(sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
    trim(regexp_replace(lower(unit), '[\x20\x09-\x0D]+', ' ', 'g')) AS normal
  FROM each
), grouped AS (
  SELECT *, sum((normal = '')::INT) OVER (PARTITION BY doc_id ORDER BY nth) AS par FROM placed
), pars AS (
  SELECT doc_id, par, string_agg(normal, ' ' ORDER BY nth) AS normal FROM grouped WHERE normal <> '' GROUP BY ALL HAVING count(*) > 1
), ranked AS (
  SELECT *, len(string_split(normal, ' ')) >= 15 AS long, row_number() OVER w > 1 AS later, count(*) OVER (PARTITION BY normal) > 1 AS again
  FROM grouped WINDOW w AS (PARTITION BY normal ORDER BY doc_id, nth)
), ranked_pars AS (
  SELECT *, row_number() OVER w > 1 AS later, count(*) OVER (PARTITION BY normal) > 1 AS again
  FROM pars WHERE len(string_split(normal, ' ')) >= 15 WINDOW w AS (PARTITION BY normal ORDER BY doc_id, par)
), marked AS (
  SELECT r.*, r.long AND r.again AS repeated, (r.long AND r.later) OR (r.normal <> '' AND coalesce(p.later, false)) AS gone
  FROM ranked r LEFT JOIN ranked_pars p USING (doc_id, par)
), par_counts AS (SELECT doc_id, count(*) FILTER (again) AS n FROM ranked_pars GROUP BY 1)
SELECT doc_id, count(*) AS n_units, count(*) FILTER (repeated) + coalesce(any_value(n), 0) AS n_repeated,
  coalesce(sum(length(unit)) FILTER (gone), 0)::BIGINT AS n_removed,
  coalesce(string_agg(start || '-' || (start + length(unit)), ',' ORDER BY nth) FILTER (gone), '') AS removed,
  sha256(coalesce(string_agg(unit, chr(10) ORDER BY nth) FILTER (NOT gone), '')) AS kept_sha256
FROM marked LEFT JOIN par_counts USING (doc_id) GROUP BY doc_id
"""


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))  # noqa: E731  (no id: not held out)
    learned = language_id.dictionaries(docs, ~fold())
    return language_id.predict(docs, learned).select("doc_id", fold().alias("held_out"), "lang_pred", "score", "accepted")


@query
def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))  # noqa: E731  (no id: not held out)
    field = quality_crf.train(docs, table(spark, sf_dir, "labels"), ~fold())
    scored = quality_crf.score(docs, field)
    return scored.select("doc_id", fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines", "bad_lines")


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def _repeating(docs: DataFrame) -> DataFrame:
    """``documents`` whose h = crc32(doc_id) is a multiple of ten repeat p of their words from
    word a on: a = g % n, p = 1 + (n - a) / (3 + g % 8), with g = h / 10 and n words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def built(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.concat_ws(" ", F.slice(w, F.lit(1), a), F.slice(tail, F.lit(1), n - a))

    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    text = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, built(w)))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(_repeating(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # The greatest of (length, -start, -period) is the longest run, the first of equal ones.
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    out = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), top.alias("top"), F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit(""))).alias("lines"), "collapsed")
    return out.select(
        "doc_id", "n_runs", (-F.col("top.s")).alias("start"), F.col("top.n").alias("length"), (-F.col("top.p")).alias("period"),
        F.floor(1000 * F.col("top.n") / -F.col("top.p")).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentence_pieces.encode(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _rebuilt(conversations: DataFrame) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % 20, h = crc32(c) % 4,
    and goes on with its own turns behind its first h."""
    own = cut(prefix_trie.sequences(conversations), "turns")
    heads = own.filter("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.array().cast(own.schema["turns"].dataType))
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return own.withColumn("base", F.expr("conv_id - conv_id % 20")).join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_rebuilt(table(spark, sf_dir, "conversations")))


STATEMENTS["op12_prefix_trie"] = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'id': sha256(strlen(role) || ':' || role || text), 'words': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))}
    ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM rows_ GROUP BY conv_id
), hashed AS (
  SELECT conv_id, turns, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda crc, b:
    list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295), 4294967295) % 4 AS h
  FROM own
), seqs AS (
  SELECT c.conv_id, list_concat(CASE WHEN b.turns IS NULL THEN [] ELSE b.turns[1:c.h] END, c.turns[c.h + 1:]) AS turns
  FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
), places AS (
  SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, turns FROM seqs
), named AS (
  SELECT conv_id, n, depth, array_to_string(list_transform(turns[1:depth], lambda t: t.id), '') AS name,
    array_to_string(list_transform(turns[1:depth - 1], lambda t: t.id), '') AS above, CASE WHEN depth = 0 THEN 0 ELSE turns[depth].words END AS words
  FROM places
), nodes AS (
  SELECT name, depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own_saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM named GROUP BY name, depth
), kids AS (SELECT above AS name, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (name, depth)),
sums AS (
  SELECT a.name, a.depth, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.own_saved) AS saved_tokens
  FROM full_ a JOIN full_ b ON b.depth >= a.depth AND starts_with(b.name, a.name) GROUP BY ALL
)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_ f JOIN sums s USING (name, depth) LEFT JOIN full_ p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.name = f.above
"""
