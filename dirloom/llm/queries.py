"""The registered queries ``opN_<name>`` and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated_pairs

    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chatfmt import conversation_report, format_conversations

    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_report(format_conversations(turns.unionByName(more)))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(spark, table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_report

    return toxicity_report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def tokenizer(name: str) -> str:
    """A vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spm import encoding_report

    return encoding_report(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(spark, table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeat_report

    return repeat_report(spark, table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_signals

    return quality_signals(table(spark, sf_dir, "documents"))


def op10_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .idstore import read_ids, write_ids
    from .storage import Scratch

    path = Scratch(spark, "id-store").base
    write_ids(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), path)
    return read_ids(spark, path, digest=True)


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import url_report

    return url_report(spark, table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import run_report

    return run_report(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitening_report

    return whitening_report(spark, table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)


_SAID = "</s>[INST] ok [/INST]"
_ESCAPED = r"regexp_replace(regexp_replace(replace({t}, '\', '\\'), '(<)(\||/?s>|</?SYS>>)', '\1\\!\2', 'g'), '(\[)(/?INST\])', '\1\\!\2', 'g')"

ORACLE_SQL: dict[str, str] = {
    "op2_chat_formatting": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, r, '{_SAID}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
f AS (SELECT *, '<|turn|>' || {_ESCAPED.format(t="role")} || chr(10) || {_ESCAPED.format(t="text")} || '<|/turn|>' || chr(10) AS f FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(f)) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id""",
    # All pairs of documents that share a shingle: for small tables, as the check of results uses.
    "op3_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs JOIN n a ON u = a.doc_id JOIN n b ON v = b.doc_id WHERE 100 * c >= 90 * (a.n + b.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.v, reach.r FROM reach JOIN links l ON l.u = reach.doc_id)
SELECT doc_id, any_value(n.n) AS n_shingles, min(r) AS component_id FROM reach JOIN n USING (doc_id) GROUP BY doc_id""",
    # Mined rules by counting all token combinations of the labelled URLs.
    "op11_url_filters": r"""
WITH p AS (SELECT row_number() OVER () AS k, page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT *, string_split(host, '.') AS h, regexp_replace(path, '[0-9]+', '0', 'g') AS masked, regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1) AS q FROM p),
n AS (SELECT *, list_filter(string_split(masked, '/'), lambda x: x <> '') AS s, list_sort(list_distinct(list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''), lambda x: string_split(x, '=')[1]))) AS names FROM m),
t AS (SELECT k, page_id, CASE WHEN host = '' THEN [] ELSE list_sort(list_distinct(list_filter(['scheme:' || string_split(url, '://')[1], 'top:' || h[-1],
  CASE WHEN len(h) >= 2 THEN 'site:' || h[-2] || '.' || h[-1] END, CASE WHEN len(h) >= 3 THEN 'name:' || h[-3] END, 'host:' || host, CASE WHEN len(h) >= 3 THEN 'first:' || h[1] END,
  'path1:' || s[1], 'path2:' || s[2], 'depth:' || len(s), CASE WHEN regexp_matches(masked, '\.[A-Za-z0-9]+$') THEN 'ext:' || regexp_extract(masked, '\.([A-Za-z0-9]+)$', 1) END,
  CASE WHEN len(names) > 0 THEN 'query:' || array_to_string(names, '&') END, CASE WHEN contains(url, '#') THEN 'part:fragment' END], lambda x: x IS NOT NULL))) END AS t FROM n),
marks AS (SELECT doc_id AS page_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels GROUP BY 1),
l AS (SELECT t, bad FROM t JOIN marks USING (page_id) WHERE len(t) > 0 AND bad IS NOT NULL),
c AS (SELECT g, count(*) AS freq, count(*) FILTER (bad) AS bad FROM (SELECT bad, list_filter(t, lambda x, i: (b >> (i - 1)) & 1 = 1) AS g FROM (SELECT t, bad, unnest(range(1, CAST(1 << len(t) AS BIGINT))) AS b FROM l)) GROUP BY g),
rules AS (SELECT g, bad / freq AS confidence FROM c WHERE bad >= greatest(ceil(0.001 * (SELECT count(*) FROM l)), 10) AND bad / freq >= 0.5),
hits AS (SELECT k, max(confidence) AS confidence FROM t JOIN rules ON list_has_all(t.t, g) GROUP BY k),
fixed(fh, fp, fv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
ruled AS (SELECT k, arg_max(fh || fp, length(fh || fp)) AS rule, arg_max(fv, length(fh || fp)) AS v FROM p JOIN fixed ON (host = fh OR ends_with(host, '.' || fh)) AND starts_with(path, fp) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN confidence IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN rule IS NULL THEN confidence END AS confidence
FROM p LEFT JOIN ruled USING (k) LEFT JOIN hits USING (k)""",
}
