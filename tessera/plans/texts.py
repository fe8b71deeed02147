"""Text-function queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import parse
from tessera.operators import records as R
from tessera.plans.catalog import query
from tessera.sources import files
from tessera.store import table


@query(r"""WITH d AS (SELECT doc_id, text AS t FROM documents), k AS (SELECT doc_id, regexp_replace(t, '\bsk-[A-Za-z0-9_\-]{8,}', 'sk-[REDACTED]', 'g') AS t FROM d),
b AS (SELECT doc_id, regexp_replace(t, '(?i)\bbearer[\t\n\x0B\f\r ]+[A-Za-z0-9._~+/\-]+=*', 'Bearer [REDACTED]', 'g') AS t FROM k),
n AS (SELECT doc_id, regexp_replace(t, '(?i)\b(authorization|x-api-key|api[_-]?key|token|secret|password)\b(["'']?[\t\n\x0B\f\r ]*[:=][\t\n\x0B\f\r ]*["'']?)([^\t\n\x0B\f\r "'',;&)\]}]+)', '\1\2[REDACTED]', 'g') AS t FROM b)
SELECT doc_id, md5(t) AS digest, CAST((length(t) - length(replace(t, '[REDACTED]', ''))) / 10 AS INTEGER) AS n_redacted FROM n""")
def redact_secrets(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), T.occurrences(F.col("t"), F.lit("[REDACTED]")).alias("n_redacted"))


@query("""SELECT n_nationkey, 'see .../' || lower(n_name) || '.pdf and .../x.txt at https://h.example/a/b' AS scrubbed FROM nation""")
def scrub_paths(spark, sf_dir):
    raw = F.expr(r"concat('see /home/u/', lower(n_name), '.pdf and C:\\tmp\\d\\x.txt at https://h.example/a/b')")
    return table(spark, sf_dir, "nation").select("n_nationkey", T.scrub_paths(raw).alias("scrubbed"))


@query("""WITH t AS (SELECT page_id, regexp_replace(trim(url, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '[\\t-\\r ]+', ' ', 'g') AS t FROM pages) SELECT page_id, CASE WHEN length(t) > 25 THEN left(t, 25) || '... [+' || CAST(length(t) - 25 AS VARCHAR) || ' chars]' ELSE t END AS short, regexp_matches(t, '^https://[^ /?#]+') AS safe FROM t""")
def sanitize_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.sanitize(F.col("url"), 25).alias("short"), T.safe_url(F.col("url")).alias("safe"))


STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(f"""SELECT conv_id, turn, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x NOT IN ({STOP})))) AS n_tokens FROM conversations""")
def norm_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.token_set(F.col("text"))).cast("long").alias("n_tokens"))


SIG = "concat('VAV-', CAST(p_size AS {s}), ' SERVES M', CAST(p_partkey % 9 AS {s}), '.', CAST(p_size % 4 AS {s}), ' AT ', CAST(p_size * 10 AS {s}), ' GPM AND ', CAST(p_size AS {s}), ' inches', CASE WHEN p_partkey % 2 = 0 THEN ' NOT SHOWN' ELSE '' END)"


@query("""SELECT p_partkey, 'VAV' || CAST(p_size AS VARCHAR) || ',M' || CAST(p_partkey % 9 AS VARCHAR) || '.' || CAST(p_size % 4 AS VARCHAR) AS tags, CAST(p_size * 10 AS VARCHAR) || 'gpm,' || CAST(p_size AS VARCHAR) || 'in' AS measures, p_partkey % 2 = 0 AS absent FROM part""")
def critical_signatures(spark, sf_dir):
    s = F.expr(SIG.format(s="STRING"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.equipment_tags(s), ",").alias("tags"), F.array_join(T.measurements(s), ",").alias("measures"), T.says_absent(s).alias("absent"))


ID = "CASE c_custkey % 5 WHEN 0 THEN concat('PRJ1-M-', CAST(c_custkey AS {s})) WHEN 1 THEN concat('(e', CAST(c_custkey % 100 AS {s}), '.1)') WHEN 2 THEN concat('FP–', CAST(c_custkey % 90 AS {s})) WHEN 3 THEN 'NOTE' ELSE concat('2/A-', CAST(c_custkey % 7 AS {s})) END"


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'PRJ1-M-' || CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'E' || CAST(c_custkey % 100 AS VARCHAR) || '.1' WHEN 2 THEN 'FP-' || CAST(c_custkey % 90 AS VARCHAR) WHEN 3 THEN 'NOTE' ELSE '2/A-' || CAST(c_custkey % 7 AS VARCHAR) END AS norm,
 CASE c_custkey % 5 WHEN 0 THEN 'm' WHEN 1 THEN 'e' WHEN 2 THEN 'fp' WHEN 3 THEN 'not' ELSE '' END AS discipline, c_custkey % 5 IN (0, 1, 2) AS shaped, CASE WHEN c_custkey % 5 = 4 THEN 'A-' || CAST(c_custkey % 7 AS VARCHAR) END AS bubble, c_custkey % 5 = 4 AS non_sheet FROM customer""")
def sheet_ids(spark, sf_dir):
    raw = F.expr(ID.format(s="STRING"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.sheet_id(raw).alias("norm"), T.discipline(raw).alias("discipline"), T.looks_like_sheet_id(raw).alias("shaped"), T.bubble_target(raw).alias("bubble"), T.is_non_sheet(raw).alias("non_sheet"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'prose+json+critique×2' WHEN 1 THEN 'critique+auditor' WHEN 2 THEN 'cross+synthesis+extra' ELSE 'focus' END AS label FROM orders""")
def provenance_labels(spark, sf_dir):
    tags = F.expr("CASE o_orderkey % 4 WHEN 0 THEN array('critique_1', 'digest_json', 'critique_2', 'digest_prose_conflict') WHEN 1 THEN array('auditor_naming', 'critique_2') WHEN 2 THEN array('extra', 'synthesis_prose', 'cross_qc', 'extra') ELSE array('focus_prose') END")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.provenance(tags).alias("label"))


@query("""SELECT p_partkey, (p_partkey % 3) * 1000000 + (p_size % 10) * 1000 + p_size % 4 AS k, CASE WHEN p_partkey % 5 = 0 THEN p_size ELSE 1073741824 END AS candidate FROM part""")
def version_keys(spark, sf_dir):
    v = F.expr("concat('v', CAST(p_partkey % 3 AS STRING), '.', CAST(p_size % 10 AS STRING), '.', CAST(p_size % 4 AS STRING), CASE WHEN p_partkey % 5 = 0 THEN concat('rc', CAST(p_size AS STRING)) ELSE '' END)")
    k = table(spark, sf_dir, "part").select("p_partkey", T.version_key(v).alias("v"))
    return k.select("p_partkey", (F.col("v.major").cast("long") * 1000000 + F.col("v.minor") * 1000 + F.col("v.patch")).alias("k"), F.col("v.candidate").alias("candidate"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a_b' WHEN 1 THEN '_CON.txt' WHEN 2 THEN 'unnamed' ELSE 'p' || CAST(p_size AS VARCHAR) || '.pdf' END AS name FROM part""")
def artifact_names(spark, sf_dir):
    raw = F.expr(r"CASE p_partkey % 4 WHEN 0 THEN 'x/a:b. ' WHEN 1 THEN 'CON.txt' WHEN 2 THEN 'dir/' ELSE concat('/q/w/p', CAST(p_size AS STRING), '.pdf') END")
    return table(spark, sf_dir, "part").select("p_partkey", files.artifact_name(raw).alias("name"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_size BETWEEN 1 AND 4 THEN (p_size - 1) * 10 + p_partkey % 4 ELSE -1 END AS cell, CASE p_partkey % 3 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'REJECTED' ELSE 'UNCERTAIN' END AS verdict FROM part""")
def tile_labels(spark, sf_dir):
    label = F.expr("CASE WHEN p_partkey % 3 = 0 THEN concat('R', CAST(p_size AS STRING), 'C', CAST(p_partkey % 4 + 1 AS STRING)) ELSE 'nope' END")
    reply = F.expr("CASE p_partkey % 3 WHEN 0 THEN '{\"verdict\": \"confirmed\"}' WHEN 1 THEN '{\"verdict\": \"CONTRADICTED\"}' ELSE 'garbage' END")
    t = table(spark, sf_dir, "part").select("p_partkey", parse.tile_of(label, F.lit(4), F.lit(4)).alias("t"), parse.verdict(reply).alias("verdict"))
    return t.select("p_partkey", F.coalesce(F.col("t.row") * 10 + F.col("t.col"), F.lit(-1)).alias("cell"), "verdict")


@query("""SELECT c_custkey, sha256('{"p00":"' || c_name || '","p01":' || CASE WHEN c_nationkey = 3 THEN 'null' ELSE '"' || CAST(c_nationkey AS VARCHAR) || '"' END || '}') AS key FROM customer""")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", R.cache_key(F.col("c_name"), F.when(F.col("c_nationkey") != 3, F.col("c_nationkey"))).alias("key"))


@query("""SELECT doc_id, length(text) AS n, md5(CASE WHEN length(text) > 2000 THEN left(text, 2000) || chr(10) || '[truncated]' ELSE text END) AS digest FROM documents""")
def capped_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length("text").cast("long").alias("n"), F.md5(T.capped(F.col("text"), 2000).cast("binary")).alias("digest"))
