"""Queries of the review run's operators: limits, page joins, prose, placement, cells and accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import review as V
from tessera.plans.catalog import query
from tessera.store import table


@query("""WITH f AS (SELECT c_nationkey AS grp, count(*) AS files, CAST(sum(c_custkey % 61) AS BIGINT) AS sheets, bool_or(c_nationkey % 5 = 0) AS ok FROM customer GROUP BY 1)
SELECT grp, files, sheets, CASE WHEN ok THEN NULL WHEN files > 60 THEN 'FILES' WHEN sheets > 1700 THEN 'SHEETS' END AS blocked_by FROM f""")
def set_limits(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), (F.col("c_custkey") % 61).alias("pages"))
    return V.set_limits(c, "grp", "pages", F.col("grp") % 5 == 0, max_files=60, max_sheets=1700)


@query("""SELECT p_partkey, (p_retailprice * 12 > 0 AND p_retailprice * 12 <= 20000 AND p_size * 500.0 - 1000 > 0 AND p_size * 500.0 - 1000 <= 20000) AS fits, p_size * 1000 < p_partkey AS no_room FROM part""")
def page_limits(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", V.page_fits(F.col("p_retailprice") * 12, F.col("p_size") * F.lit(500.0) - 1000).alias("fits"), V.lacks_room(F.col("p_partkey"), F.col("p_size") * 1000).alias("no_room"))


@query("""SELECT p_partkey, CAST(unnest(generate_series(0, p_size % 7 - 1)) AS INTEGER) AS page_index FROM part WHERE p_size % 7 > 0""")
def page_listing(spark, sf_dir):
    return V.list_pages(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 7).alias("pages")), "pages")


@query("""SELECT l_suppkey, count(*) FILTER (WHERE l_quantity > 5 + l_suppkey % 20) AS kept, count(*) FILTER (WHERE NOT l_quantity > 5 + l_suppkey % 20) AS omitted FROM lineitem GROUP BY 1""")
def omitted_tiles(spark, sf_dir):
    return V.kept_and_omitted(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_quantity") > 5 + F.col("l_suppkey") % 20)


@query("""WITH pg AS (SELECT p_partkey AS part, p_size AS page, 'G' || p_partkey AS geom FROM part WHERE p_partkey % 3 <> 0)
SELECT l_orderkey, l_linenumber, l_partkey AS part, l_suppkey % 50 + 1 AS page, geom FROM lineitem LEFT JOIN pg ON l_partkey = part AND l_suppkey % 50 + 1 = page""")
def source_page_join(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), (F.col("l_suppkey") % 50 + 1).alias("page"))
    pages = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("part"), F.col("p_size").alias("page"), F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("geom"))
    return V.with_page(rows, pages, ["part", "page"]).select("l_orderkey", "l_linenumber", "part", "page", "geom")


@query("""WITH pg AS (SELECT p_partkey AS part, p_brand AS sheet, 'G' || p_partkey AS geom FROM part WHERE p_partkey % 3 = 0),
s AS (SELECT sheet, arg_min(geom, part) AS g FROM pg GROUP BY 1), c AS (SELECT l_orderkey, l_linenumber, l_partkey, 'Brand#' || (l_suppkey % 30) AS sheet FROM lineitem)
SELECT c.l_orderkey, c.l_linenumber, c.l_partkey AS part, c.sheet, coalesce(pg.geom, s.g) AS geom FROM c LEFT JOIN pg ON c.l_partkey = pg.part LEFT JOIN s ON c.sheet = s.sheet""")
def two_step_geometry(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 30).cast("string")).alias("sheet"))
    pages = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("sheet"), F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("geom"))
    return V.with_page_or_sheet(rows, pages, ["part"], "sheet", "part", "geom").select("l_orderkey", "l_linenumber", "part", "sheet", "geom")


@query("""WITH l AS (SELECT user_id AS k, arg_max(CASE WHEN event_id % 3 = 0 THEN event_id % 40 END, CASE WHEN event_id % 3 = 0 THEN event_id END) AS late FROM events GROUP BY 1)
SELECT c_custkey, coalesce(late, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 9 END) AS omitted FROM customer LEFT JOIN l ON k = c_custkey""")
def late_geometry(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 9 END").alias("omitted"))
    late = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.expr("CASE WHEN event_id % 3 = 0 THEN event_id % 40 END").alias("omitted"), "event_id")
    return V.late_facts(base, late, ["c_custkey"], "omitted", "event_id")


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_suppkey AS page, l_quantity * 20 AS x0, l_quantity * 20 + l_linenumber * 10 AS x1, upper(l_returnflag) || l_linenumber AS text FROM lineitem),
i AS (SELECT s_suppkey AS page, 500.0 + s_suppkey % 7 * 40 AS id_x0, CASE WHEN s_suppkey % 11 = 0 THEN 0.0 ELSE 1000.0 + s_suppkey END AS page_w, 'R' || (s_suppkey % 5) AS own_id FROM supplier)
SELECT l_orderkey, l_linenumber, w.page, text FROM w JOIN i ON w.page = i.page WHERE page_w > 0 AND (x0 + x1) / 2 >= id_x0 - 0.18 * page_w AND text <> own_id""")
def titleblock_band(spark, sf_dir):
    words = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("page"), (F.col("l_quantity") * 20).alias("x0"), (F.col("l_quantity") * 20 + F.col("l_linenumber") * 10).alias("x1"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"))
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), (F.lit(500.0) + F.col("s_suppkey") % 7 * 40).alias("id_x0"), F.expr("CASE WHEN s_suppkey % 11 = 0 THEN 0.0D ELSE 1000.0D + s_suppkey END").alias("page_w"), F.concat(F.lit("R"), (F.col("s_suppkey") % 5).cast("string")).alias("own_id"))
    return V.title_band(words, ids, ["page"]).select("l_orderkey", "l_linenumber", "page", "text")


@query("""WITH h AS (SELECT DISTINCT lower(substr(c_mktsegment, 1, 1)) AS d FROM customer),
p AS (SELECT p_partkey AS name, lower(substr(p_brand, 7, 1)) AS b, lower(left(p_name, 1)) AS a FROM part)
SELECT name FROM p WHERE a IN (SELECT d FROM h) OR b IN (SELECT d FROM h)""")
def profile_disciplines(spark, sf_dir):
    profiles = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.array(F.lower(F.substring("p_brand", 7, 1)), F.lower(F.left("p_name", F.lit(1)))).alias("disciplines"))
    sheets = table(spark, sf_dir, "customer").select(F.concat(F.left("c_mktsegment", F.lit(1)), F.lit("-"), F.col("c_custkey").cast("string")).alias("sheet"))
    return V.suggested_profiles(profiles, sheets, "sheet").select("name")


ITEM = "concat('Sheet ', chr(cast(65 + o_orderkey % 5 as int)), '-', o_orderkey % 23, CASE o_orderkey % 4 WHEN 0 THEN '.1' WHEN 1 THEN '.' ELSE '' END, CASE o_orderkey % 6 WHEN 0 THEN ' conflicts with ' WHEN 1 THEN ' matches ' WHEN 2 THEN ' differs from ' WHEN 3 THEN ' does not match ' ELSE ' follows ' END, o_custkey % 3, chr(cast(65 + o_custkey % 5 as int)), '-', o_custkey % 31, ' at ', lower(o_orderpriority), ' a-', o_custkey % 12)"
ITEM_SQL = f"items AS (SELECT o_orderkey, {ITEM.replace('cast(65', 'CAST(65').replace(' as int)', ' AS INTEGER)')} AS text FROM orders)"
IDS_SQL = "ids AS (SELECT DISTINCT chr(CAST(65 + c_custkey % 5 AS INTEGER)) || '-' || (c_custkey % 23) || CASE WHEN c_custkey % 9 = 0 THEN '.1' ELSE '' END AS id FROM customer)"
MENTION_SQL = f"""WITH {ITEM_SQL}, {IDS_SQL},
runs AS (SELECT o_orderkey, unnest(regexp_extract_all(upper(text), '[A-Z0-9]+(?:[.\\-][A-Z0-9]+)*')) AS id, generate_subscripts(regexp_extract_all(upper(text), '[A-Z0-9]+(?:[.\\-][A-Z0-9]+)*'), 1) AS pos FROM items),
first AS (SELECT o_orderkey, id, min(pos) AS pos FROM runs WHERE id IN (SELECT id FROM ids) GROUP BY ALL),
named AS (SELECT o_orderkey, string_agg(id, ',' ORDER BY pos) AS ids FROM first GROUP BY 1) """


def _items(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(ITEM).alias("text"))
    ids = table(spark, sf_dir, "customer").select(F.expr("concat(chr(cast(65 + c_custkey % 5 as int)), '-', c_custkey % 23, CASE WHEN c_custkey % 9 = 0 THEN '.1' ELSE '' END)").alias("id"))
    return items, ids


@query(MENTION_SQL + "SELECT o_orderkey, ids FROM named")
def id_mentions(spark, sf_dir):
    items, ids = _items(spark, sf_dir)
    return V.mentions(items, "o_orderkey", "text", ids, "id").withColumn("ids", F.array_join("ids", ","))


@query(MENTION_SQL + """SELECT i.o_orderkey, text, coalesce(ids, '') AS ids, CASE WHEN ids IS NULL THEN 'SET' ELSE 'SOURCE' END AS scope FROM items i LEFT JOIN named n ON i.o_orderkey = n.o_orderkey
WHERE regexp_matches(lower(text), 'conflict|contradic|disagree|mismatch|discrepan|inconsist|differs|diverg|does not match|doesn''t match|stale')""")
def synthesis_conflicts(spark, sf_dir):
    items, ids = _items(spark, sf_dir)
    return V.conflicts(items, "o_orderkey", "text", ids, "id").select("o_orderkey", "text", F.array_join("ids", ",").alias("ids"), "scope")


@query("""SELECT doc_id, 'PI-' || left(sha1('digest' || chr(0) || source || chr(0) || (doc_id % 17) || chr(0) || coalesce(lang, '') || chr(0) || (doc_id % 5) || chr(0) || coalesce(text, '')), 12) AS item_id FROM documents""")
def prose_item_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", V.prose_item_id(F.lit("digest"), F.col("source"), F.col("doc_id") % 17, F.col("lang"), F.col("doc_id") % 5, F.col("text")).alias("item_id"))


GROUND_SQL = r"""WITH d AS (SELECT doc_id, lower(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) AS t, substr(text, CAST(1 + doc_id % 40 AS INTEGER), CAST(doc_id % 50 AS INTEGER)) AS q FROM documents),
p AS (SELECT a.doc_id, a.t, lower(trim(regexp_replace(coalesce(b.q, a.q), '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) AS q FROM d a LEFT JOIN d b ON a.doc_id % 2 = 1 AND b.doc_id = a.doc_id - 1)
SELECT doc_id, (length(q) < 6 OR contains(t, q)) AS grounded FROM p"""


@query(GROUND_SQL)
def grounded_quotes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr("substr(text, cast(1 + doc_id % 40 as int), cast(doc_id % 50 as int))").alias("q"))
    other = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("q").alias("other")).where("doc_id % 2 = 1")
    both = d.join(other, "doc_id", "left").withColumn("q", F.replace(F.coalesce("other", "q"), F.lit(" "), F.lit(" \t ")))
    return both.select("doc_id", V.grounded(F.col("q"), F.col("text")).alias("grounded"))


@query("""WITH f AS (SELECT o_custkey AS request, o_orderkey AS ord, 'S' || (o_orderkey % 40) AS handle, CASE o_orderkey % 7 WHEN 0 THEN ' ' WHEN 1 THEN 'segment of nothing' ELSE c_mktsegment END AS quote FROM orders JOIN customer ON c_custkey = o_custkey),
s AS (SELECT 'S' || n_nationkey AS handle, string_agg(DISTINCT c_mktsegment, ' / ') AS text FROM nation JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 60 = n_nationkey % 60 GROUP BY 1),
r AS (SELECT f.*, row_number() OVER (PARTITION BY request ORDER BY ord) AS rn FROM f JOIN s USING (handle) WHERE trim(quote) <> '' AND contains(lower(s.text), lower(trim(quote))))
SELECT request, ord, handle, quote FROM r WHERE rn <= 3""")
def fact_handles(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    facts = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("ord"), F.concat(F.lit(" s"), (F.col("o_orderkey") % 40).cast("string")).alias("handle"), F.expr("CASE o_orderkey % 7 WHEN 0 THEN ' ' WHEN 1 THEN 'segment of nothing' ELSE c_mktsegment END").alias("quote"))
    n = table(spark, sf_dir, "nation").join(c, (F.col("c_nationkey") == F.col("n_nationkey")) & (F.col("c_custkey") % 60 == F.col("n_nationkey") % 60))
    sheets = n.groupBy(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("handle")).agg(F.array_join(F.collect_set("c_mktsegment"), " / ").alias("text"))
    return V.bound_facts(facts, sheets, "request", "ord", most=3)


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_quantity AS BIGINT) AS q, l_partkey FROM lineitem),
k AS (SELECT *, CASE l_partkey % 5 WHEN 0 THEN 'SUM' WHEN 1 THEN 'product' WHEN 2 THEN 'ratio' ELSE ' factor ' END AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, q, l_partkey) AS pos FROM c),
v AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS rn FROM k WHERE l_partkey % 5 <> 2 AND l_suppkey % 6 <> 0 AND l_suppkey % 7 <> 0)
SELECT l_orderkey, CASE WHEN l_suppkey % 4 = 0 THEN 'file-p' || (l_orderkey % 9) ELSE 'M-' || l_suppkey END AS sheet_id, lower(trim(kind)) AS kind, q || ',' || (q + 1) AS terms, CAST(q * 2 AS VARCHAR) AS expected FROM v WHERE rn <= 2""")
def numeric_claims(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("long").alias("q"), "l_partkey")
    kind = F.expr("CASE l_partkey % 5 WHEN 0 THEN 'SUM' WHEN 1 THEN 'product' WHEN 2 THEN 'ratio' ELSE ' factor ' END")
    terms = F.when(F.col("l_suppkey") % 6 == 0, F.lit("[]")).when(F.col("l_orderkey") % 2 == 0, F.format_string('["%d", "%d"]', "q", F.col("q") + 1)).otherwise(F.format_string("[%d,%d]", "q", F.col("q") + 1))
    expected = F.when(F.col("l_suppkey") % 7 == 0, F.lit("true")).otherwise((F.col("q") * 2).cast("string"))
    sheet = F.when(F.col("l_suppkey") % 4 == 0, F.lit(" ")).otherwise(F.concat(F.lit("M-"), F.col("l_suppkey").cast("string")))
    claim = F.concat(F.lit('{"sheet_id": "'), sheet, F.lit('", "kind": "'), kind, F.lit('", "terms": '), terms, F.lit(', "expected": '), expected, F.lit("}"))
    per = c.withColumn("claim", claim).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "q", "l_partkey", "claim"))).alias("c"))
    objects = per.select("l_orderkey", F.concat(F.lit('{"findings": [], "claims": ['), F.array_join(F.transform("c", lambda x: x["claim"]), ", "), F.lit("]}")).alias("json"))
    out = V.numeric_claims(objects, "l_orderkey", "json", F.concat(F.lit("file-p"), (F.col("l_orderkey") % 9).cast("string")), most=2)
    return out.select("l_orderkey", "sheet_id", "kind", F.array_join("terms", ",").alias("terms"), "expected")


@query("""WITH i AS (SELECT c_nationkey AS grp, c_custkey AS ord, 'NFPA ' || (c_custkey % 12) AS display, CASE WHEN c_custkey % 5 = 0 THEN 'amended' ELSE '' END AS note FROM customer WHERE c_custkey % 2 = 0),
h AS (SELECT c_nationkey AS grp, c_custkey AS ord, 'nfpa  ' || (c_custkey % 20) AS code FROM customer WHERE c_custkey % 2 = 1),
e AS (SELECT grp, 0 AS g, ord, display || CASE WHEN note <> '' THEN ' (' || note || ')' ELSE '' END AS t FROM i UNION ALL SELECT grp, 1, ord, code FROM h WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.grp = h.grp AND i.display = upper(replace(h.code, '  ', ' '))))
SELECT grp, string_agg(t, '; ' ORDER BY g, ord, t) AS editions FROM e GROUP BY 1""")
def merged_editions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    ident = c.where("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("ord"), F.concat(F.lit("NFPA "), (F.col("c_custkey") % 12).cast("string")).alias("display"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'amended' ELSE '' END").alias("note"))
    harvested = c.where("c_custkey % 2 = 1").select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("ord"), F.concat(F.lit("nfpa  "), (F.col("c_custkey") % 20).cast("string")).alias("code"))
    return V.merged_editions(ident, harvested, "grp")


STATUS = "CASE l_partkey % 5 WHEN 0 THEN 'REJECTED' WHEN 1 THEN 'VERIFIED' WHEN 2 THEN 'DETERMINISTIC' WHEN 3 THEN 'UNCERTAIN' END"


@query(f"""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {STATUS} AS status, l_quantity > 25 AS anchored, l_suppkey % 2 = 0 AS inc, l_suppkey % 3 = 0 AS ink FROM lineitem),
d AS (SELECT *, CASE WHEN status = 'REJECTED' THEN 'rejected' WHEN NOT (coalesce(status, '') IN ('VERIFIED', 'DETERMINISTIC') OR inc) THEN 'gated' WHEN anchored THEN 'cloud' ELSE 'margin' END AS disposition FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, disposition, CASE disposition WHEN 'cloud' THEN 'CLOUD' WHEN 'margin' THEN 'MARGIN' WHEN 'gated' THEN 'GATED_INDEX' ELSE CASE WHEN NOT ink THEN 'REJECTED_INDEX' WHEN anchored THEN 'CLOUD' ELSE 'MARGIN' END END AS kind,
 (coalesce(status, '') NOT IN ('VERIFIED', 'REJECTED', 'DETERMINISTIC') AND anchored AND NOT (l_suppkey % 3 = 0 OR l_linenumber > 4)) AS verifiable FROM d""")
def ink_disposition(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").withColumn("status", F.expr(STATUS)).withColumn("anchored", F.col("l_quantity") > 25)
    inc, ink, legs = F.col("l_suppkey") % 2 == 0, F.col("l_suppkey") % 3 == 0, F.array(F.col("l_suppkey") % 3 == 0, F.col("l_linenumber") > 4)
    return f.select("l_orderkey", "l_linenumber", "l_partkey", V.disposition(F.col("status"), F.col("anchored"), inc).alias("disposition"), V.placement_kind(F.col("status"), F.col("anchored"), inc, ink).alias("kind"), V.verifiable(F.col("status"), F.col("anchored"), legs).alias("verifiable"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('leg-%02d-', l_linenumber) || left(sha1('SRC-' || l_suppkey || chr(0) || 'f' || (l_partkey % 9) || '.pdf' || chr(0) || (l_partkey % 4) || chr(0) || l_returnflag || ' quote' || chr(0)), 8) AS leg FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, leg, 'run-1#F' || l_partkey || '#' || leg || '#' || lpad(CAST(l_orderkey % 100000 AS VARCHAR), 5, '0') AS placement FROM l""")
def placement_ids(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    leg = V.leg_id(F.concat(F.lit("SRC-"), s("l_suppkey")), F.concat(F.lit("f"), (F.col("l_partkey") % 9).cast("string"), F.lit(".pdf")), F.col("l_partkey") % 4, F.concat("l_returnflag", F.lit(" quote")), F.col("l_linenumber"))
    f = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", leg.alias("leg"))
    return f.withColumn("placement", V.placement_id(F.lit("run-1"), F.concat(F.lit("F"), s("l_partkey")), F.col("leg"), F.col("l_orderkey") % 100000))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 10.0 AS x0, l_linenumber * 50.0 AS y0, l_suppkey % 300 * 1.0 AS x1, l_partkey % 400 * 1.0 AS y1, 100.0 AS a, 80.0 AS b, 260.0 AS c, 220.0 AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, NOT ((x0 < a AND x1 < a) OR (x0 > c AND x1 > c) OR (y0 < b AND y1 < b) OR (y0 > d AND y1 > d)) AND len(list_filter([0.15::DOUBLE, 0.3::DOUBLE, 0.45::DOUBLE, 0.6::DOUBLE, 0.75::DOUBLE, 0.9::DOUBLE], lambda t: x0 + (x1 - x0) * t BETWEEN a AND c AND y0 + (y1 - y0) * t BETWEEN b AND d)) > 0 AS crosses FROM g""")
def leader_crossings(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem")
    num = lambda c: c.cast("double")
    hit = V.crosses(F.col("l_quantity") * 10.0, num(F.col("l_linenumber") * 50), num(F.col("l_suppkey") % 300), num(F.col("l_partkey") % 400), (F.lit(100.0), F.lit(80.0), F.lit(260.0), F.lit(220.0)))
    return f.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", hit.alias("crosses"))


@query("""WITH f AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part)
SELECT p_partkey, CASE WHEN p_size % 3 < 2 AND p_size % 4 = 0 THEN 'SET' ELSE 'SOURCE' END AS scope,
 CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand || CASE WHEN p_size % 2 = 0 THEN '' ELSE ': "' || p_name || '"' END || CASE WHEN p_size % 7 = 0 THEN '' ELSE '; ' || p_type END END AS legs,
 CASE WHEN p_size % 6 = 0 THEN '' ELSE (p_size % 6) || ',' || (p_size % 4) END AS tile,
 CASE WHEN p_size % 8 = 0 THEN '' ELSE printf('%.1f', p_retailprice + 0.0) || ', ' || printf('%.1f', p_size * 1.25) || ', ' || printf('%.1f', p_size * 2.5) || ', ' || printf('%.1f', p_size * 3.0) END AS rect FROM f""")
def finding_cells(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    leg = lambda s, q: F.struct(s.alias("sheet_id"), q.alias("source_quote"))
    none = F.array().cast("array<struct<sheet_id:string,source_quote:string>>")
    second = F.when(F.col("p_size") % 7 == 0, F.lit(" ")).otherwise(F.col("p_type"))
    legs = F.when(F.col("p_size") % 5 == 0, none).otherwise(F.array(leg(F.concat(F.lit(" "), "p_brand"), F.when(F.col("p_size") % 2 == 1, F.col("p_name"))), leg(second, F.lit(""))))
    hint = F.expr("CASE p_size % 3 WHEN 0 THEN 'set' WHEN 1 THEN 'SET_INDEX' ELSE 'SHEET' END")
    tile = F.when(F.col("p_size") % 6 != 0, F.struct((F.col("p_size") % 6).alias("row"), (F.col("p_size") % 4).alias("col")))
    rect = F.when(F.col("p_size") % 8 == 0, F.array(F.lit(1.0))).otherwise(F.array(F.col("p_retailprice"), F.col("p_size") * 1.25, F.col("p_size") * 2.5, F.col("p_size") * 3.0))
    cell = lambda c: F.coalesce(c, F.lit(""))
    return p.select("p_partkey", V.scope(hint, F.when(F.col("p_size") % 4 != 0, F.col("p_brand"))).alias("scope"), V.legs_cell(legs).alias("legs"), cell(V.tile_cell(tile)).alias("tile"), V.rect_cell(rect).alias("rect"))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS j, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE n_name END AS r, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE r_name END AS co, CASE WHEN c_custkey % 2 = 0 THEN 'en' END AS la, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'mm' END AS u
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), w AS (SELECT *, CASE WHEN j <> '' THEN j ELSE coalesce(r, '') || CASE WHEN coalesce(r, '') <> '' AND co <> '' THEN ', ' ELSE '' END || co END AS wh FROM c)
SELECT c_custkey, array_to_string(list_filter([nullif(wh, ''), 'language ' || la, 'units ' || nullif(u, '')], lambda x: x IS NOT NULL), '; ') AS line,
 'SET IDENTITY (model-detected):' || CASE WHEN c_custkey % 6 = 0 THEN '' ELSE chr(10) || '- Disciplines: ' || 'a, b' END || CASE WHEN j = '' AND la IS NULL THEN '' ELSE chr(10) || '- Project: ' || CASE WHEN j <> '' AND la IS NOT NULL THEN j || ' (' || la || ')' WHEN j <> '' THEN j ELSE la END END || CASE WHEN wh = '' THEN '' ELSE chr(10) || '- Jurisdiction: ' || wh END || CASE WHEN u = '' THEN '' ELSE chr(10) || '- Detection confidence: ' || u END AS block FROM w""")
def identity_context(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j, r, co = F.expr("CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END"), F.expr("CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE n_name END"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN '' ELSE r_name END")
    la, u = F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'en' END"), F.expr("CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'mm' END")
    where = V.identity_line(j, r, co, F.lit(None).cast("string"), F.lit(""))
    names = F.when(F.col("c_custkey") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b")))
    return c.select("c_custkey", V.identity_line(j, r, co, la, u).alias("line"), V.identity_block(names, j, la, where, u).alias("block"))


@query("""WITH s AS (SELECT c_nationkey AS grp, c_custkey, c_name AS label, CASE WHEN c_custkey % 9 = 0 THEN 'timeout ' || c_custkey ELSE '' END AS err, c_mktsegment AS text, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT grp, max(n) AS sheets, string_agg('## Sheet ' || i || '/' || n || ': ' || label || chr(10) || chr(10) || CASE WHEN err <> '' THEN '> [analysis failed for this sheet: ' || err || ']' ELSE text END || chr(10) || chr(10) || '---', chr(10) || chr(10) ORDER BY i) AS document FROM s GROUP BY 1""")
def combined_document(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), "c_custkey", F.col("c_name").alias("label"), F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")).alias("text"), F.expr("CASE WHEN c_custkey % 9 = 0 THEN concat('timeout ', c_custkey) END").alias("error"))
    return V.combined_document(s, "grp", "c_custkey")


@query("""WITH t AS (SELECT l_suppkey AS sheet, l_linenumber AS tile, l_partkey AS part, l_orderkey AS ord FROM lineitem)
SELECT sheet, tile, count(*) AS n, string_agg(part || ':' || ord, ',' ORDER BY part, ord) AS findings FROM t GROUP BY ALL""")
def tile_index(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sheet"), F.col("l_linenumber").alias("tile"), F.struct(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("ord")).alias("f"))
    per = t.groupBy("sheet", "tile").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("f")).alias("f"))
    return per.select("sheet", "tile", "n", F.array_join(F.transform("f", lambda x: F.concat(x["part"].cast("string"), F.lit(":"), x["ord"].cast("string"))), ",").alias("findings"))


@query("""WITH r AS (SELECT c_nationkey AS grp, c_custkey AS id, '<b>' || c_name || '</b>' AS text, c_mktsegment AS category FROM customer)
SELECT grp, replace('[' || string_agg(CAST(to_json({'id': id, 'text': text, 'category': category}) AS VARCHAR), ',' ORDER BY id) || ']', '<', '\\u003c') AS block FROM r GROUP BY 1""")
def report_data_blocks(spark, sf_dir):
    r = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), F.struct(F.col("c_custkey").alias("id"), F.concat(F.lit("<b>"), "c_name", F.lit("</b>")).alias("text"), F.col("c_mktsegment").alias("category")).alias("row"))
    return r.groupBy("grp").agg(F.array_sort(F.collect_list("row")).alias("rows")).select("grp", V.inert_json(F.col("rows")).alias("block"))


@query("""WITH p AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '../' WHEN 2 THEN './' WHEN 3 THEN '/' ELSE 'x/' END || event_type || '/' || CASE event_id % 7 WHEN 0 THEN '..' WHEN 1 THEN '../..' WHEN 2 THEN 'b/../c' ELSE 'd' END || '/' || CASE event_id % 3 WHEN 0 THEN '../e' ELSE 'f' END AS path FROM events),
s AS (SELECT event_id, path, unnest(string_split(path, '/')) AS step, generate_subscripts(string_split(path, '/'), 1) AS i FROM p),
d AS (SELECT event_id, path, sum(CASE WHEN step = '..' THEN -1 ELSE 1 END) OVER (PARTITION BY event_id ORDER BY i) AS depth FROM s WHERE step NOT IN ('', '.'))
SELECT event_id, path, NOT starts_with(path, '/') AND min(depth) >= 0 AS contained FROM d GROUP BY event_id, path""")
def path_containment(spark, sf_dir):
    path = F.expr("concat(CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '../' WHEN 2 THEN './' WHEN 3 THEN '/' ELSE 'x/' END, event_type, '/', CASE event_id % 7 WHEN 0 THEN '..' WHEN 1 THEN '../..' WHEN 2 THEN 'b/../c' ELSE 'd' END, '/', CASE event_id % 3 WHEN 0 THEN '../e' ELSE 'f' END)")
    return table(spark, sf_dir, "events").select("event_id", path.alias("path")).withColumn("contained", V.contained(F.col("path")))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'CACHE' WHEN event_id % 5 = 0 THEN 'REAL_TIME' WHEN user_id % 2 = 0 THEN 'BATCH' ELSE 'REAL_TIME' END AS transport,
 CAST(ceil(CAST(event_id * 7 AS DECIMAL(18,0)) * CASE event_type WHEN 'click' THEN 1.100 WHEN 'view' THEN 1.150 WHEN 'purchase' THEN 1.000 ELSE 1.200 END) AS BIGINT) AS estimate,
 CAST(ceil(CAST(event_id * 7 AS DECIMAL(18,0)) * CASE event_type WHEN 'click' THEN 1.100 WHEN 'view' THEN 1.150 WHEN 'purchase' THEN 1.000 ELSE 1.200 END) AS BIGINT) > 40000 AS exceeds,
 (event_id % 11 = 0 OR epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts) >= 3 * 86400000000) AS due FROM events""")
def transport_and_limits(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    factors = {"click": "1.10", "view": "1.15", "purchase": "0.90"}
    est = V.safe_estimate(F.col("event_id") * 7, F.col("event_type"), factors, "1.20")
    last = F.when(F.col("event_id") % 11 != 0, F.col("ts"))
    return e.select("event_id", V.transport(F.col("event_id") % 4 == 0, F.col("event_id") % 5 == 0, F.col("user_id") % 2 == 0).alias("transport"), est.alias("estimate"), (est > 40_000).alias("exceeds"), V.due(last, F.expr("TIMESTAMP '2024-01-20 00:00:00'"), 3).alias("due"))


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS payload FROM events WHERE event_id % 4 <> 0 AND event_id % 5 <> 0 AND event_id % 6 <> 0 AND event_id % 7 <> 0 AND event_id % 13 <> 0""")
def cache_admission(spark, sf_dir):
    kind = F.when(F.col("event_id") % 4 == 0, "other").otherwise("stage")
    schema = F.when(F.col("event_id") % 5 == 0, "1").otherwise("2")
    payload = F.when(F.col("event_id") % 6 == 0, F.lit("[1]")).otherwise(F.replace("props", F.lit(": "), F.lit(":")))
    entry = F.concat(F.lit('{"_kind":"'), kind, F.lit('","_schema":'), schema, F.lit(',"stage":"'), F.when(F.col("event_id") % 7 == 0, F.lit("x")).otherwise(F.col("event_type")), F.lit('","payload":'), payload, F.when(F.col("event_id") % 13 == 0, F.lit("")).otherwise(F.lit("}")))
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", entry.alias("entry"))
    return V.admitted(rows, "stage", 2, F.col("event_type")).select("event_id", "payload")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS value FROM events WHERE event_id % 6 <> 0 AND event_id % 5 <> 0""")
def cache_migration(spark, sf_dir):
    old = F.when(F.col("event_id") % 6 == 0, F.substring("props", 1, 4)).when(F.col("event_id") % 5 == 0, F.replace("props", F.lit("}"), F.lit(', "v": 1}'))).when(F.col("event_id") % 4 == 0, F.replace("props", F.lit("}"), F.lit(', "v": 2}'))).otherwise(F.col("props"))
    return V.migrated(table(spark, sf_dir, "events").select("event_id", old.alias("json")), "event_id", "json", 2)


@query("""WITH a AS (SELECT l_partkey AS id, l_suppkey AS s, 0 AS o FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS s, 1 AS o FROM part WHERE p_retailprice > 905), e AS (SELECT * FROM a UNION ALL SELECT * FROM b),
one AS (SELECT id, arg_min(s, (o, s)) AS s, min(o) AS o FROM e GROUP BY id), st AS (SELECT o, count(*) AS found FROM e GROUP BY o)
SELECT id, s, CASE one.o WHEN 0 THEN 'reference' ELSE 'naming' END AS part, found FROM one JOIN st ON one.o = st.o""")
def auditor_union(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("s"))
    b = table(spark, sf_dir, "part").where("p_retailprice > 905").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("s"))
    one, stats = V.combine({"reference": a, "naming": b}, "id", ["s"])
    return one.join(F.broadcast(stats), "part").select("id", "s", "part", "found")  # stats: a row a part


@query("""WITH x AS (SELECT l_orderkey AS k, max(l_linenumber) + 1 AS next_leg FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, next_leg, sha256('crop|' || printf('%.2f', l_quantity * 1.25) || '|' || printf('%.2f', l_quantity + 0.5) || '|' || printf('%.2f', l_quantity * 2.0) || '|' || printf('%.2f', l_quantity * 3.0)) AS digest FROM lineitem JOIN x ON k = l_orderkey""")
def evidence_legs(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem")
    n = V.next_leg(f.select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")
    q = F.col("l_quantity")
    digest = V.evidence_hash(F.lit("crop"), q * 1.25, q + 0.5, q * 2.0, q * 3.0)
    return f.join(n, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "next_leg", digest.alias("digest"))


@query("""WITH c AS (SELECT user_id, event_type || ' ' || CAST(floor(value) AS BIGINT) % 9 AS prompt, min(event_id % 13) AS priority FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority, prompt) AS place FROM c)
SELECT user_id, place, prompt FROM r WHERE place <= 5""")
def starter_prompts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.concat("event_type", F.lit(" "), (F.floor("value") % 9).cast("string")).alias("prompt"), (F.col("event_id") % 13).alias("priority"))
    return V.starter_prompts(e, "user_id")


@query("""SELECT l_suppkey, count(*) AS findings, count(*) FILTER (WHERE l_returnflag = 'R') AS rejected, count(*) FILTER (WHERE l_quantity > 25) AS anchored, count(DISTINCT l_partkey) AS sheets, CASE WHEN bool_or(l_linestatus = 'O') THEN 'OPEN' ELSE 'DONE' END AS status FROM lineitem GROUP BY 1""")
def evidence_summary(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("findings"), F.count_if(F.col("l_returnflag") == "R").alias("rejected"), F.count_if(F.col("l_quantity") > 25).alias("anchored"),
        F.count_distinct("l_partkey").alias("sheets"), F.when(F.bool_or(F.col("l_linestatus") == "O"), "OPEN").otherwise("DONE").alias("status"),
    )


@query("""WITH f AS (SELECT l_suppkey AS grp, l_partkey, l_orderkey, l_linenumber, 'M-' || l_partkey AS sheet FROM lineitem), p AS (SELECT 'M-' || p_partkey AS sheet, 'out/' || p_brand || '.pdf' AS path FROM part WHERE p_partkey % 4 <> 1)
SELECT l_orderkey, l_linenumber, l_partkey, f.sheet, CASE WHEN path IS NULL THEN '' ELSE path || '#page=' || (l_partkey % 9 + 1) END AS link FROM f LEFT JOIN p ON f.sheet = p.sheet""")
def report_links(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("M-"), F.col("l_partkey").cast("string")).alias("sheet"))
    p = table(spark, sf_dir, "part").where("p_partkey % 4 <> 1").select(F.concat(F.lit("M-"), F.col("p_partkey").cast("string")).alias("sheet"), F.concat(F.lit("out/"), "p_brand", F.lit(".pdf")).alias("path"))
    return V.with_page(f, p, ["sheet"]).select("l_orderkey", "l_linenumber", "l_partkey", "sheet", V.page_link(F.col("path"), F.col("l_partkey") % 9).alias("link"))


@query("""WITH f AS (SELECT o_custkey, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END AS severity, lower(trim(o_orderstatus)) AS status FROM orders)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY severity DESC, o_orderkey) AS by_severity, row_number() OVER (PARTITION BY o_custkey ORDER BY status, o_orderkey) AS by_status FROM f""")
def report_sort(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END").alias("severity"), "o_orderstatus")
    by = V.sorted_places(f, "o_custkey", "o_orderkey", {"by_severity": (F.col("severity"), -1), "by_status": (F.lower(F.btrim("o_orderstatus")), 1)})
    return by.select("o_custkey", "o_orderkey", *[F.col(c).cast("long").alias(c) for c in ("by_severity", "by_status")])


@query("""WITH a AS (SELECT 'digest_json' AS source, doc_id AS id, 'd' || lang AS text, NULL AS anchor FROM documents), b AS (SELECT 'critique_1', conv_id * 100 + turn, role, 'turn ' || turn FROM conversations), c AS (SELECT 'auditor_naming', item_id, NULL, 'item' FROM benchmark)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def channel_union(spark, sf_dir):
    digest = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("d"), "lang").alias("text"))
    critique = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("text"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("anchor"))
    naming = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("item").alias("anchor"))
    return V.channels({"digest_json": digest, "critique_1": critique, "auditor_naming": naming}).select("source", "id", "text", "anchor")


@query("""WITH s AS (SELECT user_id AS sheet, sum(event_id % 700) AS tokens, count(*) FILTER (WHERE event_type = 'error') AS failed, bool_and(event_id % 2 = 0) AS cached, count(*) AS calls FROM events GROUP BY 1)
SELECT sheet, CASE WHEN failed = calls THEN 'FAILED' WHEN failed > 0 THEN 'PARTIAL' ELSE 'OK' END AS status, CAST(tokens AS BIGINT) AS tokens, cached, calls FROM s""")
def sheet_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("sheet"), (F.col("event_id") % 700).alias("tokens"), (F.col("event_type") == "error").alias("failed"), (F.col("event_id") % 2 == 0).alias("cached"))
    return V.sheet_status(e, "sheet")


@query("""WITH r AS (SELECT c_nationkey AS run, count(*) AS sheets, CAST(sum(c_custkey % 5) AS BIGINT) AS findings, count(*) FILTER (WHERE c_acctbal < 0) AS failed, min(c_name) AS note FROM customer GROUP BY 1)
SELECT run, '{"run":' || run || ',"sheets":' || sheets || ',"findings":' || findings || ',"failed":' || failed || ',"note":"key sk-[REDACTED] of ' || note || '"}' AS manifest FROM r""")
def run_manifest(spark, sf_dir):
    r = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("run")).agg(F.count("*").alias("sheets"), F.sum(F.col("c_custkey") % 5).alias("findings"), F.count_if(F.col("c_acctbal") < 0).alias("failed"), F.concat(F.lit("key sk-test-" + "a1B2" * 8 + " of "), F.min("c_name")).alias("note"))
    return r.select("run", V.manifest(F.struct("run", "sheets", "findings", "failed", "note")).alias("manifest"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
s AS (SELECT *, 1000 + l_suppkey % 1000 AS t, q + l_partkey AS e, q + 1000 + l_suppkey % 1000 AS a FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN abs(a - e) <= greatest(abs(a), abs(e)) * 0.01 OR abs(a - e) <= 0.01 THEN 'matched' ELSE 'mismatched' END AS outcome,
 CASE WHEN abs(a - e) <= greatest(abs(a), abs(e)) * 0.01 OR abs(a - e) <= 0.01 THEN NULL WHEN l_suppkey % 3 = 0 AND e NOT IN (q, t) THEN 'MODEL_TRANSCRIBED' ELSE 'TEXT_EXTRACTED' END AS origin FROM s""")
def quoted_operands(spark, sf_dir):
    from tessera.functions import numeric as N
    from tessera.operators import audit as A

    q = F.col("l_quantity").cast("long")
    c = table(spark, sf_dir, "lineitem")
    shown = F.concat(F.lit("TOTAL "), q.cast("string"), F.lit(" + 1,"), F.lpad((F.col("l_suppkey") % 1000).cast("string"), 3, "0"), F.lit(" = "), F.when(F.col("l_suppkey") % 3 == 0, F.lit("?")).otherwise((q + F.col("l_partkey")).cast("string")))
    dec = lambda x: x.cast(N.NUMBER)
    claims = c.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("sum").alias("kind"), F.array(dec(q), dec(F.col("l_suppkey") % 1000 + 1000)).alias("terms"), dec(q + F.col("l_partkey")).alias("expected"), shown.alias("quote"))
    return A.arithmetic(claims).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "outcome", "origin")


@query("""WITH f AS (SELECT p_partkey, p_brand, 'M-' || (p_size % 4 + 1) AS tag, (p_size % 3 * 50 + 100) || ' gpm' AS size, p_size % 5 = 0 AS absent, CASE p_size % 6 WHEN 0 THEN 'question' WHEN 1 THEN 'clarity' ELSE 'code' END AS category, p_name, p_partkey // 20 AS page FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b, a.tag = b.tag AND a.size = b.size AND a.absent = b.absent AND (a.category = b.category OR 'question' IN (a.category, b.category))
 AND (a.p_name = b.p_name OR (split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2) OR split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1))) AS same
FROM f a JOIN f b ON a.page = b.page AND a.p_partkey < b.p_partkey""")
def duplicate_findings(spark, sf_dir):
    from tessera.operators import ledger as L

    p = table(spark, sf_dir, "part").withColumn("page", F.floor(F.col("p_partkey") / 20))
    # seven tokens, two of which (the part's name) may differ: one that differs leaves 6 of 8, two leave 5 of 9
    text = F.expr("concat('unit M-', p_size % 4 + 1, ' flow ', p_size % 3 * 50 + 100, ' gpm ', p_name, CASE WHEN p_size % 5 = 0 THEN ' missing' ELSE ' drawn' END)")
    f = p.select("p_partkey", "page", F.struct(text.alias("text"), F.lit("").alias("source_quote"), F.expr("CASE p_size % 6 WHEN 0 THEN 'question' WHEN 1 THEN 'clarity' ELSE 'code' END").alias("category")).alias("f"))
    a, b = (f.select("page", F.col("p_partkey").alias(f"{s}"), F.col("f").alias(f"f{s}")) for s in "ab")
    return a.join(b, "page").where("a < b").select("a", "b", L.is_duplicate("fa", "fb").alias("same"))


@query("""SELECT p_partkey, 'M-' || p_size || '.' || (p_partkey % 9) AS id FROM part""")
def fullwidth_ids(spark, sf_dir):
    """Identifiers in full-width characters, with a wide dash and a joiner, have the normal form of the plain ones."""
    from tessera.functions import text as T

    wide = F.translate(F.expr("concat('m-', p_size, '.', p_partkey % 9)"), "m0123456789.-", "ｍ０１２３４５６７８９．–")
    return table(spark, sf_dir, "part").select("p_partkey", T.sheet_id(F.concat(F.lit("("), wide, F.lit("​)")), True).alias("id"))
