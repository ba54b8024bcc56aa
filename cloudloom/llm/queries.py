"""One query for each operator of this subpackage, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm import avi, decontam, langid, licenses, linededup, mixing, pii, ppm, simhash, substring


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(k: int) -> Column:
    """doc_id's fold of k."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % k


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"), keep=["doc_id"], curriculum=mixing.CURRICULUM)
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken", "position")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(_fold(4) == 2, F.lit(False))
    profiles = langid.profile_table(docs.where(~held_out))
    found = langid.identify(docs, profiles, keep=["doc_id"])
    return found.select("row.doc_id", "lang_pred", "score").withColumn("held_out", held_out)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def _path() -> Column:
    """A path for each document: its source, and the digits of doc_id as directories; each tenth one is the directory's licence file."""
    file = F.when(F.col("doc_id") % 10 == 0, F.lit("LICENSE")).otherwise(F.lit("file.txt"))
    part = lambda k: (F.col("doc_id") / k).cast("long").cast("string")
    return F.concat_ws("/", "source", part(1000), part(100), F.concat_ws("-", file, F.col("doc_id").cast("string")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "documents").select("doc_id", "text", _path().alias("path"))
    found = licenses.scan_licenses(files, keep=["doc_id", "path"])
    return found.select("row.*", "license", "how", "from_dir", "detected", F.round("cosine", 6).alias("cosine"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("row.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [k for k in pii.KINDS if k.base]
    of_base = F.filter("spans", lambda s: s["kind"].isin([k.name for k in base]))
    counts = [F.size(F.filter("spans", _is(k.name))).cast("long").alias(f"n_{k.name}") for k in base]
    return found.select("row.doc_id", *counts, F.sha2(pii.listed(of_base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), pii.scores(F.col("spans")).alias("scores"))


def op9_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.media_digest(_table(spark, sf_dir, "documents"))


def op10_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_table(spark, sf_dir, "documents"), F.coalesce(_fold(7) == 2, F.lit(False)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_language_id, op3_decontaminate, op4_line_dedup, op5_license_scan, op6_substring_dedup, op7_simhash, op8_pii, op9_avi_media, op10_ppm_score)
}


# The same in DuckDB SQL, where SQL can say it.  Not: op1 (the order within a source is by Spark's hash), op2, op5 (profiles and vectors), op7 (XXH64), op9 (AVI), op10 (PPM).

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(coalesce(" + _LOWER + r", ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP3 = f"""
WITH items AS (SELECT item_id::varchar AS item, {_ALNUM} AS w FROM benchmark),
sized AS (SELECT *, least(13, len(w))::bigint AS m FROM items WHERE len(w) > 0),
cut AS (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized),
wins AS (SELECT m, array_to_string(w[i : i + m - 1], ' ') AS win, list(DISTINCT item) AS items FROM cut GROUP BY 1, 2),
docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
spots AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM wins)),
hits AS (SELECT doc_id, i, m, items FROM (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS win FROM spots) JOIN wins USING (m, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY 1),
ids AS (SELECT doc_id, list(DISTINCT item) AS items FROM (SELECT doc_id, unnest(items) AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(list_sort(items), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN n USING (doc_id) LEFT JOIN ids USING (doc_id)"""

_OP4 = f"""
WITH l AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1),
seen AS (SELECT source, line, count(*) AS n FROM (SELECT source, unnest(list_distinct(list_transform(ls, lambda x: trim(x, ' ')))) AS line FROM l) WHERE line <> '' GROUP BY 1, 2),
bad AS (SELECT source, list(line) AS lines FROM seen JOIN pages ON seen.source IS NOT DISTINCT FROM pages.source WHERE n >= {linededup.LEAST_PAGES} AND n > {linededup.RATIO} * pages GROUP BY 1),
kept AS (SELECT doc_id, ls, CASE WHEN lines IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(lines, trim(x, ' '))) END AS ks FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(len(ls) - len(ks), 0) AS n_dropped, sha256(CASE WHEN len(ks) > 0 THEN array_to_string(ks, chr(10)) WHEN ks IS NOT NULL THEN '' END) AS kept_sha256 FROM kept""".replace("SELECT source, list(line) AS lines", "SELECT seen.source AS source, list(line) AS lines")

_OP6 = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
cut AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs)),
least_ AS (SELECT win, min(doc_id) AS first FROM cut GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM cut JOIN least_ USING (win) WHERE first < doc_id),
marks AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i)), lambda i: w[i]) END, ' '), '')) AS kept_sha256
FROM docs LEFT JOIN marks USING (doc_id)"""

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_SUM = "coalesce(list_sum(list_transform(range(1, length({d}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN substr(reverse({d}), j, 1)::int ELSE CASE WHEN substr(reverse({d}), j, 1)::int > 4 THEN 2 * substr(reverse({d}), j, 1)::int - 9 ELSE 2 * substr(reverse({d}), j, 1)::int END END)), 0)"
_CODES = "list_transform(range(1, length({s}) + 1), lambda j: CASE WHEN substr({s}, j, 1) BETWEEN '0' AND '9' THEN substr({s}, j, 1)::int ELSE ord(substr({s}, j, 1)) - 55 END)"


def _kind_sql(rank: int, name: str, pattern: str, valid: str, prior: int, context: str, least: int = 0) -> str:
    """The valid matches of a kind with their places: the pieces between matches and the matches before, summed; and their scores in hundredths."""
    return f"""
    SELECT doc_id, {rank} AS rank, '{name}' AS kind, s, s + length(m) AS e, score FROM (
      SELECT doc_id, m, s, {prior} + CASE WHEN regexp_matches(substr(text, greatest(1, s + 1 - 40), least(40, s)), '{context}') THEN 30 ELSE 0 END AS score FROM (
        SELECT doc_id, text, ms[i] AS m, (list_sum(list_transform(ps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda x: length(x))), 0))::bigint AS s
        FROM (SELECT doc_id, text, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM documents WHERE regexp_matches(text, '{pattern}')))
      ) WHERE {valid}) WHERE score >= {least}"""


_MOVED = "(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4))"
_OP8 = "WITH spans AS (" + " UNION ALL ".join(
    (
        _kind_sql(0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 70, "(?i)mail|contact|write"),
        _kind_sql(1, "ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda x: TRY_CAST(x AS hugeint))) <= 255", 50, r"(?i)\bip\b|address|server|host"),
        _kind_sql(2, "card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_SUM.format(d=_DIGITS)} % 10 = 0", 60, "(?i)card|visa|credit|payment"),
        _kind_sql(3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15", 50, "(?i)phone|tel|call|mobile|fax"),
        _kind_sql(4, "iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", f"list_reduce(list_prepend(0, {_CODES.format(s=_MOVED)}), lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) = 1", 70, "(?i)iban|account|bank"),
        _kind_sql(5, "secret", "[A-Za-z0-9_+/-]{20,}={0,2}", "regexp_matches(m, '[A-Za-z]') AND regexp_matches(m, '[0-9]') AND len(list_distinct(list_filter(string_split(m, ''), lambda x: x <> ''))) >= 10", 40, "(?i)token|secret|passw|api.?key|access.?key|private.?key|credential|bearer|auth", 60),
    )
) + """),
told AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, string_agg(score::varchar, ',' ORDER BY s, rank) AS scores FROM spans GROUP BY 1)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM documents LEFT JOIN told USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {"op3_decontaminate": _OP3, "op4_line_dedup": _OP4, "op6_substring_dedup": _OP6, "op8_pii": _OP8}
