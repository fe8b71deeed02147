"""Audit queries over the driver's tables. Identifiers, tags and claims are derived by expressions that both engines share."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import text as T
from tessera.operators import audit as A
from tessera.plans.catalog import query
from tessera.store import table

TAG = "concat(CASE WHEN p_partkey % 97 = 0 THEN 'P-' ELSE 'P' END, replace(p_brand, 'Brand#', ''), 'S', CAST(p_size AS {s}))"
SHEET_ID = "concat('M-', CAST(100 + s_suppkey % 80 AS {s}))"
REF = "CASE o_orderkey % 7 WHEN 0 THEN 'NFPA-13' WHEN 1 THEN concat('RFI-', CAST(o_orderkey % 50 AS {s})) WHEN 2 THEN concat('M', CAST(100 + o_orderkey % 90 AS {s})) WHEN 3 THEN '480V' WHEN 4 THEN concat('E', CAST(o_orderkey % 9 AS {s}), '.1') ELSE concat('M-', CAST(90 + o_orderkey % 130 AS {s})) END"
S, V = {"s": "STRING"}, {"s": "VARCHAR"}


@query(f"""
WITH t AS (SELECT {TAG.format(**V)} AS tag, p_type AS sheet FROM part),
ok AS (SELECT upper(trim(tag)) AS tag, sheet FROM t WHERE length(trim(tag)) BETWEEN 2 AND 12 AND regexp_full_match(trim(tag), '[A-Za-z0-9]+(?:[-/][A-Za-z0-9]+)*') AND regexp_matches(tag, '[A-Za-z]') AND regexp_matches(tag, '[0-9]')),
s AS (SELECT tag, sheet, count(*) AS n_sheet FROM ok GROUP BY ALL),
p AS (SELECT tag, CAST(sum(n_sheet) AS BIGINT) AS n_total, upper(regexp_replace(tag, '[^A-Za-z]', '', 'g')) || '|' || regexp_replace(tag, '[^0-9]', '', 'g') AS key FROM s GROUP BY tag),
k AS (SELECT *, count(*) OVER w AS spellings, max(n_total) OVER w AS dominant, min(tag) OVER w AS first FROM p WINDOW w AS (PARTITION BY key)),
e AS (SELECT *, CASE WHEN dominant >= 2 THEN n_total >= 2 ELSE tag = first END AS settled FROM k WHERE spellings > 1),
d AS (SELECT * FROM e WHERE NOT settled AND (dominant < 2 OR (n_total < dominant AND n_total <= 2))),
b AS (SELECT d.tag, d.n_total, e.tag AS canonical, row_number() OVER (PARTITION BY d.tag ORDER BY levenshtein(d.tag, e.tag), -e.n_total, e.tag) AS rn FROM d JOIN e ON d.key = e.key AND e.settled)
SELECT s.sheet, b.tag, b.canonical, s.n_sheet, b.n_total FROM b JOIN s USING (tag) WHERE rn = 1""")
def naming_drift(spark, sf_dir):
    tags = table(spark, sf_dir, "part").select(F.expr(TAG.format(**S)).alias("tag"), F.col("p_type").alias("sheet"))
    return A.naming_drift(tags)


@query(f"""
WITH i AS (SELECT upper(trim({SHEET_ID.format(**V)})) AS id FROM supplier UNION ALL SELECT upper(trim({REF.format(**V)})) FROM orders),
r AS (SELECT id, regexp_extract_all(id, '[A-Za-z]+|[0-9]+|[-.]') AS runs FROM i),
g AS (SELECT CASE WHEN array_to_string(runs, '') = id AND regexp_matches(id, '[A-Za-z0-9]') AND NOT regexp_matches(id, '^[-.]|[-.]$|[-.][-.]') THEN
  array_to_string(list_transform(runs, lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN 'D' WHEN regexp_matches(x, '^[-.]') THEN x ELSE 'A' || CAST(length(x) AS VARCHAR) END), ' ') END AS signature FROM r)
SELECT signature, count(*) AS n FROM g GROUP BY signature""")
def id_grammar(spark, sf_dir):
    ids = table(spark, sf_dir, "supplier").select(F.expr(SHEET_ID.format(**S)).alias("id")).unionByName(table(spark, sf_dir, "orders").select(F.expr(REF.format(**S)).alias("id")))
    return ids.select(T.id_signature(F.col("id")).alias("signature")).groupBy("signature").agg(F.count("*").alias("n"))


SIG = "array_to_string(list_transform(regexp_extract_all({0}, '[A-Za-z]+|[0-9]+|[-.]'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN 'D' WHEN regexp_matches(x, '^[-.]') THEN x ELSE 'A' || CAST(length(x) AS VARCHAR) END), ' ')"


@query(f"""
WITH ids AS (SELECT DISTINCT {SHEET_ID.format(**V)} AS id FROM supplier), g AS (SELECT DISTINCT {SIG.format('id')} AS sig FROM ids),
r AS (SELECT o_orderkey, {REF.format(**V)} AS target FROM orders), one AS (SELECT DISTINCT target FROM r),
near AS (SELECT target, min(struct_pack(distance := levenshtein(target, id), closest := id)) AS m FROM one, ids GROUP BY target),
c AS (SELECT o.target, m.closest AS closest, m.distance AS distance, CASE WHEN o.target IN (SELECT id FROM ids) THEN 'RESOLVED_IN_SET'
    WHEN regexp_matches(o.target, '^(NFPA|RFI)') OR regexp_matches(o.target, '^[0-9]') THEN 'IGNORE'
    WHEN {SIG.format('o.target')} IN (SELECT sig FROM g) THEN 'MISSING_FROM_SET' WHEN (SELECT count(*) FROM ids) < 2 THEN 'IGNORE' WHEN m.distance <= 2 THEN 'MALFORMED' ELSE 'IGNORE' END AS status
  FROM one o JOIN near USING (target))
SELECT r.o_orderkey, r.target, r.target AS norm, c.status, CASE WHEN c.status IN ('MISSING_FROM_SET', 'MALFORMED') THEN closest END AS closest, CAST(CASE WHEN c.status IN ('MISSING_FROM_SET', 'MALFORMED') THEN distance ELSE -1 END AS INTEGER) AS distance FROM r JOIN c USING (target)""")
def reference_classify(spark, sf_dir):
    refs = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(REF.format(**S)).alias("target"))
    ids = table(spark, sf_dir, "supplier").select(F.expr(SHEET_ID.format(**S)).alias("id"))
    return A.classify_references(refs, ids).withColumn("distance", F.coalesce("distance", F.lit(-1)))


@query(f"""
WITH ids AS (SELECT DISTINCT {SHEET_ID.format(**V)} AS id FROM supplier), t AS (SELECT DISTINCT concat('M-', CAST(p_size + 95 AS VARCHAR)) AS target FROM part),
m AS (SELECT target, min(struct_pack(distance := levenshtein(target, id), closest := id)) AS m FROM t, ids GROUP BY target)
SELECT target, m.closest AS closest, CAST(m.distance AS INTEGER) AS distance FROM m""")
def nearest_id(spark, sf_dir):
    targets = table(spark, sf_dir, "part").select(F.expr("concat('M-', CAST(p_size + 95 AS STRING))").alias("target"))
    return A.nearest(targets, table(spark, sf_dir, "supplier").select(F.expr(SHEET_ID.format(**S)).alias("id")))


@query("""
WITH e AS (SELECT DISTINCT upper(p_name) AS norm, p_brand AS p FROM part), h AS (SELECT norm, count(*) AS n, min(p) AS v FROM e GROUP BY norm),
r AS (SELECT s_suppkey, concat('part ', CAST(s_suppkey AS VARCHAR)) AS id FROM supplier UNION ALL SELECT p_partkey, p_name FROM part)
SELECT r.s_suppkey, r.id, upper(r.id) AS norm, CASE WHEN n = 1 THEN v END AS value, CASE WHEN n IS NULL THEN 'UNBOUND' WHEN n = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status, coalesce(n, 0) AS candidates FROM r LEFT JOIN h ON upper(r.id) = h.norm""")
def ambiguous_resolve(spark, sf_dir):
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    reported = supplier.select("s_suppkey", F.concat(F.lit("part "), F.col("s_suppkey").cast("string")).alias("id")).unionByName(part.select(F.col("p_partkey").alias("s_suppkey"), F.col("p_name").alias("id")))
    return A.resolve_ids(reported, part.select(F.col("p_name").alias("id"), F.col("p_brand").alias("payload")))


@query("""
WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 11 <> 3 UNION SELECT DISTINCT l_orderkey + 100000000 FROM lineitem WHERE l_orderkey % 97 = 5)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'LISTED_NOT_PRESENT' ELSE 'PRESENT_NOT_LISTED' END AS status FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def index_diff(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    present = items.where("l_orderkey % 11 <> 3").select(F.col("l_orderkey").alias("k")).unionByName(items.where("l_orderkey % 97 = 5").select((F.col("l_orderkey") + 100000000).alias("k")))
    return A.index_diff(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), present, "k")


@query("""
WITH t AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2))) AS actual, list_sort(list(CAST(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2)) AS VARCHAR))) AS q FROM lineitem GROUP BY l_orderkey),
c AS (SELECT o_orderkey, CAST(actual AS DECIMAL(38,10)) AS actual, CAST(CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS DECIMAL(38,10)) AS expected FROM orders JOIN t ON o_orderkey = l_orderkey),
g AS (SELECT *, abs(CAST(actual AS DECIMAL(18,2)) - CAST(expected AS DECIMAL(18,2))) AS gap, greatest(abs(CAST(actual AS DECIMAL(18,2))), abs(CAST(expected AS DECIMAL(18,2)))) AS scale FROM c)
SELECT o_orderkey, CAST(actual AS DOUBLE) AS actual, CAST(expected AS DOUBLE) AS expected, CASE WHEN gap <= 0.01 OR gap <= scale * 0.01 THEN 'matched' ELSE 'mismatched' END AS outcome,
  CASE WHEN NOT (gap <= 0.01 OR gap <= scale * 0.01) THEN CASE WHEN gap >= scale * 0.10 THEN 'high' WHEN gap >= scale * 0.03 THEN 'medium' ELSE 'low' END END AS severity FROM g""")
def arithmetic_audit(spark, sf_dir):
    price = F.round("l_extendedprice", 2).cast("decimal(18,2)").cast(N.NUMBER)
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(price).alias("terms"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 2).cast("decimal(18,2)").cast(N.NUMBER).alias("expected"))
    claims = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("kind", F.lit("sum")).withColumn("quote", F.lit(""))
    return A.arithmetic(claims).select("o_orderkey", F.col("actual").cast("double").alias("actual"), F.col("expected").cast("double").alias("expected"), "outcome", "severity")


NUMBER_TEXT = "CASE p_partkey % 6 WHEN 0 THEN concat(CAST(p_size AS {s}), ',', lpad(CAST(p_partkey % 1000 AS {s}), 3, '0'), ' ft') WHEN 1 THEN concat(CAST(p_size AS {s}), ' 1/', CAST(p_partkey % 4 AS {s}), '\"') WHEN 2 THEN concat('-', CAST(p_size AS {s}), '/4') WHEN 3 THEN concat('.', CAST(p_size AS {s}), '%') WHEN 4 THEN concat('$', CAST(p_size AS {s})) ELSE concat(CAST(p_size AS {s}), '.25 gpm') END"


@query(f"""
WITH t AS (SELECT p_partkey, {NUMBER_TEXT.format(**V)} AS raw FROM part), s AS (SELECT p_partkey, raw, regexp_replace(raw, '^([0-9]+),([0-9]{{3}}) ', '\\1\\2 ') AS x FROM t)
SELECT p_partkey, raw, CASE
  WHEN regexp_matches(x, '^[0-9]+ [0-9]+/[0-9]+') THEN CASE WHEN regexp_extract(x, '/([0-9]+)', 1) = '0' THEN NULL ELSE CAST(regexp_extract(x, '^([0-9]+) ', 1) AS DOUBLE) + round(CAST(regexp_extract(x, ' ([0-9]+)/', 1) AS DOUBLE) / CAST(regexp_extract(x, '/([0-9]+)', 1) AS DOUBLE), 10) END
  WHEN regexp_matches(x, '^-[0-9]+/[0-9]+') THEN -CAST(regexp_extract(x, '^-([0-9]+)/', 1) AS DOUBLE) / 4
  WHEN regexp_matches(x, '^([0-9]|[.])') THEN CAST(regexp_extract(x, '^([0-9]+[.][0-9]+|[.][0-9]+|[0-9]+)', 1) AS DOUBLE) END AS value FROM s""")
def parse_numbers(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select("p_partkey", F.expr(NUMBER_TEXT.format(**S)).alias("raw"))
    return raw.withColumn("value", N.parse_number(F.col("raw")).cast("double"))


VALUE = "CASE WHEN c_custkey % 10 = 3 THEN concat('2024-', CAST(c_nationkey AS {s})) ELSE concat(c_mktsegment, '-2023') END"


@query(f"""
WITH r AS (SELECT c_custkey, c_mktsegment AS grp, {VALUE.format(**V)} AS v FROM customer), n AS (SELECT grp, v, count(*) AS c FROM r GROUP BY ALL),
m AS (SELECT grp, CAST(sum(c) AS BIGINT) AS n_rows, min(struct_pack(c := -c, v := v)) AS m FROM n GROUP BY grp)
SELECT r.grp, r.c_custkey, r.v, m.m.v AS consensus, -m.m.c AS n_consensus, m.n_rows FROM r JOIN m USING (grp) WHERE n_rows >= 3 AND -m.m.c >= greatest(2, round_even(n_rows * 0.8, 0)) AND r.v <> m.m.v""")
def field_consensus_drift(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("grp"), F.expr(VALUE.format(**S)).alias("v"))
    return A.consensus_drift(rows, "grp", "v")


VARIANT = "concat(replace(p_brand, 'Brand#', 'BR-'), CASE WHEN p_partkey % 211 = 0 THEN '1' ELSE '' END)"


@query(f"""
WITH t AS (SELECT DISTINCT p_size AS sheet, upper({VARIANT}) AS token FROM part), n AS (SELECT count(DISTINCT sheet) AS n FROM t),
p AS (SELECT token, count(*) AS c, regexp_replace(token, '[^A-Z]', '', 'g') AS shape FROM t GROUP BY token),
q AS (SELECT *, c >= greatest(2, round_even((SELECT n FROM n) * 0.8, 0)) AS shared FROM p),
v AS (SELECT a.token, min(b.token) AS norm FROM q a JOIN q b ON a.shape = b.shape AND NOT a.shared AND b.shared AND abs(length(a.token) - length(b.token)) <= 1 AND levenshtein(a.token, b.token) BETWEEN 1 AND 2 GROUP BY a.token)
SELECT sheet, token, norm FROM t JOIN v USING (token)""")
def recurrent_variant(spark, sf_dir):
    tokens = table(spark, sf_dir, "part").select(F.col("p_size").alias("sheet"), F.expr(VARIANT).alias("token"))
    return A.recurrent_variants(tokens)


TOKEN = "CASE WHEN event_id % 4 = 0 THEN 'X' ELSE lpad(CAST(event_id % 60 AS {s}), 2, '0') END"


@query(f"""
WITH t AS (SELECT user_id, event_id, {TOKEN.format(**V)} AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
h AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM t WHERE regexp_full_match(t, '[0-9]{{2}}')),
r AS (SELECT user_id, island, string_agg(t, ' ' ORDER BY rn) AS spec, min(rn) AS f, count(*) AS n FROM h GROUP BY ALL)
SELECT user_id, spec, CAST(min(f) AS INTEGER) AS first_at FROM r WHERE n = 3 AND CAST(left(spec, 2) AS INTEGER) <= 49 GROUP BY ALL""")
def spec_section_runs(spark, sf_dir):
    tokens = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(TOKEN.format(**S)).alias("t"))
    return A.exact_runs(tokens, "user_id", "event_id", "t")


EDITION_TEXT = "concat('SYSTEM PER NFPA ', CAST(p_size % 5 + 13 AS {s}), ', ', CAST(2010 + p_size % 13 AS {s}), ' EDITION AND ', CAST(2016 + p_partkey % 3 AS {s}), ' CBC; SEE IBC 20', CAST(15 + p_partkey % 2 AS {s}), '.')"


@query(f"""
WITH t AS (SELECT p_partkey, {EDITION_TEXT.format(**V)} AS t FROM part)
SELECT p_partkey, list_distinct_ordered AS claims FROM (SELECT p_partkey, concat('NFPA ', regexp_extract(t, 'NFPA ([0-9]+)', 1), ' ', regexp_extract(t, 'NFPA [0-9]+, ([0-9]{{4}})', 1), '; CBC ', regexp_extract(t, '([0-9]{{4}}) CBC', 1), '; IBC ', regexp_extract(t, 'IBC ([0-9]{{4}})', 1)) AS list_distinct_ordered FROM t)""")
def edition_harvest(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", F.expr(EDITION_TEXT.format(**S)).alias("t"))
    return t.select("p_partkey", F.array_join(T.editions(F.col("t")), "; ").alias("claims"))


@query(f"""
WITH t AS (SELECT p_partkey, {EDITION_TEXT.format(**V)} AS t FROM part), c AS (SELECT p_partkey, 'NFPA ' || regexp_extract(t, 'NFPA ([0-9]+)', 1) AS code, regexp_extract(t, 'NFPA [0-9]+, ([0-9]{{4}})', 1) AS year FROM t
  UNION ALL SELECT p_partkey, 'CBC', regexp_extract(t, '([0-9]{{4}}) CBC', 1) FROM t UNION ALL SELECT p_partkey, 'IBC', regexp_extract(t, 'IBC ([0-9]{{4}})', 1) FROM t)
SELECT p_partkey, code || ' ' || year AS claim, CASE code WHEN 'NFPA 13' THEN '2016' WHEN 'CBC' THEN '2016,2018' END AS adopted FROM c WHERE (code = 'NFPA 13' AND year <> '2016') OR (code = 'CBC' AND year NOT IN ('2016', '2018'))""")
def edition_mismatches(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", F.expr(EDITION_TEXT.format(**S)).alias("t"))
    cited = t.select("p_partkey", F.explode(T.editions(F.col("t"))).alias("claim"))
    adopted = spark.createDataFrame([("NFPA 13 2016",), ("CBC 2016",), ("CBC 2018",)], "claim string")
    return A.edition_mismatches(cited, adopted).select("p_partkey", "claim", F.array_join("adopted", ",").alias("adopted"))


PHRASE = "concat('SEE SHEET M-', CAST(o_orderkey % 90 AS {s}), ' AND 3/E', CAST(o_orderkey % 9 AS {s}), '.2 OR PER CODE; SEE DRAWING ', CASE WHEN o_orderkey % 2 = 0 THEN 'NOTE' ELSE 'A-7' END)"


@query("""
SELECT o_orderkey, 1 AS rule, concat('M-', CAST(o_orderkey % 90 AS VARCHAR)) AS target FROM orders UNION ALL
SELECT o_orderkey, 6, concat('E', CAST(o_orderkey % 9 AS VARCHAR), '.2') FROM orders UNION ALL SELECT o_orderkey, 0, 'A-7' FROM orders WHERE o_orderkey % 2 = 1""")
def phrase_references(spark, sf_dir):
    pages = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(PHRASE.format(**S)).alias("text"))
    return A.phrase_references(pages).drop("text")
