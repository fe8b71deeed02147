"""Ledger queries: similarity joins, clusters, merging, anchoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import anchoring, parse
from tessera.operators import ledger as L
from tessera.operators import records as R
from tessera.plans.catalog import query
from tessera.store import table

STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TOKENS = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9]+'), lambda x: x NOT IN ({STOP}))))"


@query(f"""WITH s AS (SELECT conv_id, turn, {TOKENS.format('text')} AS s FROM conversations), t AS (SELECT * FROM s WHERE len(s) > 0)
SELECT a.conv_id, a.turn AS a, b.turn AS b, round(CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / len(list_distinct(list_concat(a.s, b.s))), 9) AS score FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn
WHERE CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / len(list_distinct(list_concat(a.s, b.s))) >= 0.1""")
def token_jaccard_pairs(spark, sf_dir):
    return L.similar_pairs(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 0.1).withColumn("score", F.round("score", 9))


@query(f"""WITH d AS (SELECT doc_id, source, {TOKENS.format('text')} AS s FROM documents), x AS (SELECT doc_id, source, s, unnest(s) AS t FROM d),
c AS (SELECT a.source, a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.source = b.source AND a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT c.source, c.a, c.b, round(CAST(n AS DOUBLE) / (len(p.s) + len(q.s) - n), 9) AS score FROM c JOIN d p ON p.doc_id = c.a JOIN d q ON q.doc_id = c.b WHERE CAST(n AS DOUBLE) / (len(p.s) + len(q.s) - n) >= 0.7""")
def duplicate_pairs(spark, sf_dir):
    return L.similar_pairs(table(spark, sf_dir, "documents"), "source", "doc_id", "text", 0.7).withColumn("score", F.round("score", 9))


@query()
def complete_link_ledger(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), "text")
    return L.complete_link(rows, "conv_id", "ord", "text", 0.1)


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey AS VARCHAR) AS id, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS rank, CASE WHEN l_linenumber % 2 = 0 THEN 'critique_1' ELSE 'digest_json' END AS src, row_number() OVER (PARTITION BY l_orderkey ORDER BY length(CAST(l_partkey AS VARCHAR)) DESC, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END DESC, CAST(l_partkey AS VARCHAR) DESC) AS rn FROM lineitem)
SELECT l_orderkey, max(CASE WHEN rn = 1 THEN id END) AS id, CASE max(rank) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, count(DISTINCT src) >= 2 AS reproduced, count(*) AS members,
  CASE WHEN count(DISTINCT src) = 2 THEN 'json+critique' WHEN max(src) = 'digest_json' THEN 'json' ELSE 'critique' END AS provenance FROM f GROUP BY 1""")
def merged_findings(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("ord"), F.col("l_partkey").cast("string").alias("id"), F.lit("t").alias("text"), F.col("l_partkey").cast("string").alias("source_quote"), F.lit("code").alias("category"), F.expr("CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END").alias("severity"), F.array(F.when(F.col("l_linenumber") % 2 == 0, "critique_1").otherwise("digest_json")).alias("sources"))
    return L.merge_clusters(rows, ["l_orderkey"], "ord").select("l_orderkey", "id", "severity", "reproduced", "members", "provenance")


@query("""WITH q AS (SELECT item_id, regexp_replace(lower(trim(text)), '[\\x09-\\x0D\\x20]+', ' ', 'g') AS q FROM benchmark), d AS (SELECT doc_id, regexp_replace(lower(text), '[\\x09-\\x0D\\x20]+', ' ', 'g') AS t FROM documents)
SELECT d.doc_id, q.item_id, strpos(t, q) AS at FROM d JOIN q ON contains(t, q)""")
def quote_anchor_exact(spark, sf_dir):
    ws = r"[\x09-\x0D\x20]+"
    q = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(F.lower(F.btrim("text")), ws, " ").alias("q"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.lower("text"), ws, " ").alias("t"))
    return anchoring.containing(d, q, "t", "q").select("doc_id", "item_id", F.expr("locate(q, t)").alias("at"))


@query()
def quote_anchor_fuzzy(spark, sf_dir):
    """Each conversation turn is a page of words; quotes are its own words with one changed, or none of it."""
    turns = table(spark, sf_dir, "conversations").where("length(text) > 0").select(F.concat_ws("-", "conv_id", "turn").alias("page"), F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w"))
    words = turns.select("page", F.posexplode("w").alias("ordinal", "text"))
    words = words.select("page", "ordinal", "text", ((F.col("ordinal") % 10) * 60.0).alias("x0"), (F.floor(F.col("ordinal") / 10) * 14.0).alias("y0"), ((F.col("ordinal") % 10) * 60.0 + 55).alias("x1"), (F.floor(F.col("ordinal") / 10) * 14.0 + 12).alias("y1"))
    quote = F.concat_ws(" ", F.slice("w", 3, 6), F.lit("zzz"), F.slice("w", 10, 4))
    found = turns.select("page", F.col("page").alias("id"), quote.alias("quote"), F.lit(0).alias("tile_row"), F.lit(1).alias("tile_col"), F.lit(792.0).alias("page_w"), F.lit(612.0).alias("page_h"), F.lit(3).alias("rows"), F.lit(3).alias("cols"))
    return anchoring.anchor_quotes(found, words)


@query("""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, CAST((length(t) - length(replace(t, 'the', ''))) / 3 AS INTEGER) AS n_found FROM t""")
def find_text(spark, sf_dir):
    return anchoring.find_phrase(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", F.lit("THE")).select("doc_id", "n_found")


@query()
def first_fit_budget(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return R.first_fit(c, "conv_id", "turn", "n", 1500)


@query("""SELECT e.conv_id, e.turn FROM conversations e WHERE e.turn >= 3 AND NOT EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = e.conv_id AND s.turn = e.turn - 3 AND s.role = 'user')""")
def late_adds(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    sealed = c.where("role = 'user'").select("conv_id", (F.col("turn") + 3).alias("turn"))
    return L.late_rows(c.where("turn >= 3").select("conv_id", "turn"), sealed, ["conv_id", "turn"])


MARKDOWN = "concat('Lead-in for order ', CAST(o_orderkey AS {s}), '.\\n\\n## ', CASE o_orderkey % 5 WHEN 0 THEN 'Coordination / cross-discipline items' WHEN 1 THEN 'Conflicts' WHEN 2 THEN 'Equipment schedule' WHEN 3 THEN 'General notes' ELSE 'Remarks' END, '\\n- Item one of order ', CAST(o_orderkey AS {s}), ' is long enough\\n  and goes on\\n- None\\n\\n- Short\\n**Scope**\\nStatus ', o_orderstatus, ' only.')"
DUCK_MD = MARKDOWN.format(s="VARCHAR").replace("\\n", "' || chr(10) || '")
SPARK_MD = MARKDOWN.format(s="STRING")
HEADER = "CASE o_orderkey % 5 WHEN 0 THEN 'Coordination / cross-discipline items' WHEN 1 THEN 'Conflicts' WHEN 2 THEN 'Equipment schedule' WHEN 3 THEN 'General notes' ELSE 'Remarks' END"
CLASS = "CASE o_orderkey % 5 WHEN 0 THEN 'coordination' WHEN 1 THEN 'conflict' WHEN 2 THEN 'equipment' WHEN 3 THEN 'notes' ELSE 'other' END"
N = "chr(10)"


@query(f"""WITH o AS (SELECT o_orderkey, o_orderstatus, CAST(o_orderkey AS VARCHAR) AS k FROM orders)
SELECT o_orderkey, 0 AS section, NULL AS header, 'Lead-in for order ' || k || '.' AS body, 'other' AS category FROM o
UNION ALL SELECT o_orderkey, 1, {HEADER}, '- Item one of order ' || k || ' is long enough' || {N} || '  and goes on' || {N} || '- None' || {N} || {N} || '- Short', {CLASS} FROM o
UNION ALL SELECT o_orderkey, 2, 'Scope', 'Status ' || o_orderstatus || ' only.', 'scope' FROM o""")
def section_split(spark, sf_dir):
    return parse.sections(table(spark, sf_dir, "orders").select("o_orderkey", F.expr(SPARK_MD).alias("md")), "o_orderkey", "md")


@query("""SELECT o_orderkey, 1 AS section, 'Item one of order ' || CAST(o_orderkey AS VARCHAR) || ' is long enough and goes on' AS text FROM orders""")
def prose_items(spark, sf_dir):
    s = parse.sections(table(spark, sf_dir, "orders").select("o_orderkey", F.expr(SPARK_MD).alias("md")), "o_orderkey", "md")
    return parse.list_items(s, ["o_orderkey", "section"], "body").select("o_orderkey", "section", "text")


REPLY = "concat('Prose of ', CAST(p_partkey AS STRING), '\\n```json\\n', CASE p_partkey % 5 WHEN 0 THEN '{\"findings\": [{\"category\": \"code\", \"severity\": \"high\", \"text\": \"x, y\", \"refs\": [\"M-1\"],},]}\\n```' WHEN 1 THEN '{\"findings\": []}\\n```' WHEN 2 THEN '{\"findings\": [{\"category\": \"zzz\", \"severity\": \"low\", \"text\": \"t\"}, {\"category\": \"Question\", \"severity\": \"LOW\", \"text\": \" t \"}]}\\n```' WHEN 3 THEN '{\"findings\": [{\"category\": \"code\"' ELSE 'nothing here\\n```' END)"


@query("""SELECT p_partkey, 'Prose of ' || CAST(p_partkey AS VARCHAR) AS prose, CASE p_partkey % 5 WHEN 0 THEN 'OK' WHEN 1 THEN 'EMPTY' WHEN 2 THEN 'PARTIAL' WHEN 3 THEN 'TRUNCATED' ELSE 'MALFORMED' END AS status,
  CASE p_partkey % 5 WHEN 0 THEN 'code/high/x, y' WHEN 2 THEN 'question/low/t' ELSE '' END AS items, CASE WHEN p_partkey % 5 = 2 THEN 1 ELSE 0 END AS n_dropped FROM part""")
def parse_replies(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(REPLY).alias("reply"))
    out = parse.parse_findings(p, "p_partkey", "reply")
    return out.select("p_partkey", "prose", "status", F.array_join(F.transform("items", lambda x: F.concat_ws("/", x["category"], x["severity"], x["text"])), ";").alias("items"), "n_dropped")
