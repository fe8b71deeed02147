"""Report, usage, log and reconciliation queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import text as T
from tessera.operators import ledger as L
from tessera.operators import records as R
from tessera.plans.catalog import query
from tessera.store import table


@query("""WITH f AS (SELECT source, min(doc_id) AS first_at FROM documents GROUP BY source)
SELECT source, first_at, format('SRC-{:04d}', row_number() OVER (ORDER BY first_at, source)) AS source_id FROM f""")
def source_ids(spark, sf_dir):
    return R.source_ids(table(spark, sf_dir, "documents"), "source", "doc_id")


@query("""WITH d AS (SELECT doc_id, md5(text) AS path, n_chars >= 200 AS ok FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY path, ok ORDER BY doc_id) AS rn, min(CASE WHEN ok THEN doc_id END) OVER (PARTITION BY path) AS seen FROM d)
SELECT doc_id, path, CASE WHEN ok AND rn = 1 THEN 'ACCEPTED' WHEN seen IS NOT NULL AND doc_id > seen THEN 'DUPLICATE' ELSE 'REJECTED' END AS status FROM r""")
def inventory_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("path"), "n_chars")
    return R.inventory(d, "path", "doc_id", F.col("n_chars") >= 200).drop("n_chars")


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderkey % 7 AS size, o_orderkey % 5 AS mtime, md5(CAST(o_orderkey AS VARCHAR)) AS sha FROM orders),
a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 1 THEN 99 ELSE o_orderkey % 7 END AS size, CASE WHEN o_orderkey % 6 = 1 THEN 77 ELSE o_orderkey % 5 END AS mtime, md5(CASE WHEN o_orderkey % 9 = 1 THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) END) AS sha FROM orders WHERE o_orderkey % 17 <> 4)
SELECT b.k, CASE WHEN a.k IS NULL THEN 'MISSING' WHEN a.size = b.size AND a.mtime = b.mtime THEN 'UNCHANGED' WHEN a.sha = b.sha THEN 'TOUCHED' ELSE 'CHANGED' END AS reason FROM b LEFT JOIN a ON a.k = b.k""")
def source_mutations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    before = o.select("k", (F.col("k") % 7).alias("size"), (F.col("k") % 5).alias("mtime"), F.md5(F.col("k").cast("string").cast("binary")).alias("sha"))
    after = o.where("k % 17 <> 4").select("k", F.expr("CASE WHEN k % 13 = 1 THEN 99 ELSE k % 7 END").alias("size"), F.expr("CASE WHEN k % 6 = 1 THEN 77 ELSE k % 5 END").alias("mtime"), F.expr("md5(cast(CASE WHEN k % 9 = 1 THEN 'x' ELSE CAST(k AS STRING) END as binary))").alias("sha"))
    return R.mutations(before, after, "k")


@query("""WITH r AS (SELECT l_orderkey AS k, count(*) AS n, bool_or(l_returnflag = 'R' AND l_quantity > 45) AS f FROM lineitem WHERE l_orderkey % 19 <> 2 GROUP BY 1), p AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 23 <> 7)
SELECT coalesce(p.k, r.k) AS k, coalesce(n, 0) AS n_receipts, CASE WHEN n IS NULL THEN 'MISSING' WHEN p.k IS NULL THEN 'UNEXPECTED' WHEN f THEN 'FAILED' WHEN n > 1 THEN 'DUPLICATE' ELSE 'OK' END AS status FROM p FULL JOIN r ON p.k = r.k""")
def plan_vs_receipts(spark, sf_dir):
    plan = table(spark, sf_dir, "orders").where("o_orderkey % 23 <> 7").select(F.col("o_orderkey").alias("k"))
    receipts = table(spark, sf_dir, "lineitem").where("l_orderkey % 19 <> 2").withColumnRenamed("l_orderkey", "k")
    return R.plan_vs_receipts(plan, receipts, "k", (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))


@query("""WITH l AS (SELECT user_id AS k, max(ts) AS checked_at FROM events WHERE event_type <> 'purchase' GROUP BY 1), w AS (SELECT DISTINCT CAST(c_custkey AS BIGINT) AS k FROM customer)
SELECT w.k, l.checked_at, CASE WHEN checked_at IS NULL THEN 'MISS' WHEN epoch_us(TIMESTAMP '2024-02-20 00:00:00') - epoch_us(checked_at) < 30 * 86400000000 THEN 'HIT' ELSE 'EXPIRED' END AS outcome FROM w LEFT JOIN l ON w.k = l.k""")
def cache_ttl_probe(spark, sf_dir):
    entries = table(spark, sf_dir, "events").where("event_type <> 'purchase'").withColumnRenamed("user_id", "k").select("k", F.col("ts").cast("timestamp").alias("ts"))
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return R.cache_probe(wanted, entries, "k", "ts", F.expr("TIMESTAMP '2024-02-20 00:00:00'"), 30)


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def expected_minus_accounted(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("""WITH e AS (SELECT user_id AS k, event_id AS seq, event_type AS v FROM events)
SELECT k, max(seq) AS seq, arg_max(v, seq) AS v FROM e GROUP BY k""")
def cache_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), F.col("event_type").alias("v"))
    return R.upsert(e.where("seq % 2 = 0"), e.where("seq % 2 = 1"), "k", "seq")


@query("""WITH p AS (SELECT c_nationkey AS grp, list_sort(list(CAST(c_custkey AS VARCHAR) || chr(31) || md5(c_name) || chr(31))) AS p, bool_or(c_nationkey = 3) AS unknown FROM customer GROUP BY 1)
SELECT grp, CASE WHEN unknown THEN '' ELSE sha256(array_to_string(p, '')) END AS fingerprint FROM p""")
def set_fingerprint(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), "c_custkey", F.when(F.col("c_nationkey") != 3, F.md5(F.col("c_name").cast("binary"))).alias("sha"))
    return R.set_fingerprint(rows, "c_custkey", "sha", "grp")


MODEL = "CASE event_type WHEN 'click' THEN 'large-2-20240101' WHEN 'view' THEN 'large-2-mini' WHEN 'purchase' THEN 'small' ELSE concat('other-', event_type) END"
PRICES = [("large-2", 5.0, 25.0), ("large-2-mini", 1.0, 5.0), ("small", 0.25, 1.25)]


def usage(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    u = e.select("event_id", "event_type", F.expr(MODEL).alias("model"), (F.col("event_id") % 5000).alias("input_tokens"), (F.col("event_id") % 700).alias("output_tokens"), (F.col("event_id") % 900).alias("cache_read_tokens"), (F.col("event_id") % 300).alias("cache_write_tokens"), F.when(F.col("event_id") % 50 == 0, 2).otherwise(0).alias("searches"), (F.col("event_id") % 2 == 0).alias("batch"), (F.col("event_id") % 5 != 0).alias("billable"))
    prices = spark.createDataFrame(PRICES, "name string, price_in double, price_out double")
    return R.with_cost(R.priced(u, prices))


COST_SQL = """WITH u AS (SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'large-2-20240101' WHEN 'view' THEN 'large-2-mini' WHEN 'purchase' THEN 'small' ELSE concat('other-', event_type) END AS model,
  event_id % 5000 AS i, event_id % 700 AS o, event_id % 900 AS r, event_id % 300 AS w, CASE WHEN event_id % 50 = 0 THEN 2 ELSE 0 END AS s, event_id % 2 = 0 AS batch, event_id % 5 <> 0 AS billable FROM events),
p AS (SELECT * FROM (VALUES ('large-2', 5.00, 25.00), ('large-2-mini', 1.00, 5.00), ('small', 0.25, 1.25)) AS t(name, pi, po)),
m AS (SELECT model, arg_max(pi, length(name)) AS pi, arg_max(po, length(name)) AS po FROM (SELECT DISTINCT model FROM u) JOIN p ON model = name OR starts_with(model, name || '-') GROUP BY model),
c AS (SELECT u.*, CASE WHEN pi IS NULL THEN CASE WHEN s > 0 THEN CAST(s * 0.01 AS DECIMAL(36,12)) END
   ELSE CAST((CAST(i * CAST(pi AS DECIMAL(6,2)) + o * CAST(po AS DECIMAL(6,2)) + r * CAST(pi AS DECIMAL(6,2)) * 0.1 + w * CAST(pi AS DECIMAL(6,2)) * 1.25 AS DECIMAL(18,4)) * 0.000001) * CASE WHEN batch THEN 0.5 ELSE 1.0 END + s * 0.01 AS DECIMAL(36,12)) END AS cost FROM u LEFT JOIN m USING (model))
"""


@query(COST_SQL + "SELECT event_id, model, CAST(cost AS VARCHAR) AS cost FROM c")
def usage_cost_decimal(spark, sf_dir):
    return usage(spark, sf_dir).select("event_id", "model", F.col("cost").cast("string").alias("cost"))


@query(COST_SQL + """SELECT event_type AS family, count(*) AS n, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, count(*) FILTER (WHERE cost IS NULL AND billable) AS n_unpriced,
  CASE WHEN bool_or(cost IS NULL AND billable) THEN NULL ELSE CAST(sum(cost) AS VARCHAR) END AS cost FROM c GROUP BY ROLLUP (event_type)""")
def usage_by_family(spark, sf_dir):
    return R.rollup_usage(usage(spark, sf_dir).withColumnRenamed("event_type", "family"), "family").withColumn("cost", F.col("cost").cast("string"))


@query("""WITH s AS (SELECT user_id, event_type AS stage, min(CASE WHEN event_id % 3 = 0 THEN ts END) AS s, max(CASE WHEN event_id % 3 = 1 THEN ts END) AS e FROM events GROUP BY ALL)
SELECT user_id, stage, greatest(0, epoch_us(e) - epoch_us(s)) AS micros FROM s WHERE s IS NOT NULL AND e IS NOT NULL""")
def stage_durations(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("event_type", "stage")
    return R.stage_durations(e, ["user_id"], "stage", "ts", F.col("event_id") % 3 == 0, F.col("event_id") % 3 == 1)


@query("""WITH p AS (SELECT user_id AS job, ts AS t, event_id AS seq, CAST(value AS BIGINT) AS done FROM events),
b AS (SELECT *, max(done) OVER (PARTITION BY job ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM p),
m AS (SELECT *, max(CASE WHEN best IS NULL OR done > best THEN t END) OVER (PARTITION BY job ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS moved FROM b)
SELECT job, min(t) AS stalled_at, count(*) AS n_stalled FROM m WHERE epoch_us(t) - epoch_us(moved) >= 432000000000 GROUP BY job""")
def poll_stall_detection(spark, sf_dir):
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.expr("cast(rint(value) as bigint)").alias("done"))
    return R.stalls(p, "job", "at", "done", 432_000)


@query("""SELECT user_id AS run, CASE WHEN bool_and(event_type IN ('click','view')) THEN 'FAILED' WHEN bool_or(event_type IN ('click','view','purchase')) THEN 'PARTIAL' ELSE 'COMPLETE' END AS outcome FROM events GROUP BY 1""")
def status_rollup(spark, sf_dir):
    s = F.expr("CASE WHEN event_type IN ('click', 'view') THEN 'FAILED' WHEN event_type = 'purchase' THEN 'PARTIAL' ELSE 'COMPLETE' END")
    return R.roll_up_status(table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), s.alias("status")), "run", "status")


@query("""SELECT 'all' AS facet, NULL AS value, count(*) AS n FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def facet_counts(spark, sf_dir):
    return R.facets(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("""WITH f AS (SELECT o_orderkey, o_orderpriority AS severity, o_totalprice, c_name, c_mktsegment AS category FROM orders JOIN customer ON o_custkey = c_custkey WHERE lower(c_mktsegment) = 'building' AND contains(lower(c_name), '7'))
SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY severity, o_totalprice DESC, o_orderkey LIMIT 50""")
def findings_filter_topk(spark, sf_dir):
    f = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("o_orderpriority").alias("severity"), "o_totalprice", "c_name", F.col("c_mktsegment").alias("category"))
    return R.query_findings(f, ["severity", F.desc("o_totalprice"), "o_orderkey"], category="BUILDING", contains="7", text="c_name")


@query("""SELECT conv_id, bool_or(role = 'assistant' AND length(text) > 200) AS visible, count(*) FILTER (WHERE role = 'assistant' AND length(text) > 200) AS n_hits, count(*) AS n_blocks FROM conversations GROUP BY 1""")
def high_only_cards(spark, sf_dir):
    hit = (F.col("role") == "assistant") & (F.length("text") > 200)
    return R.visible_cards(table(spark, sf_dir, "conversations"), "conv_id", F.coalesce(hit, F.lit(False)))


@query("""WITH g AS (SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN '?' ELSE c_mktsegment END AS shard_group FROM customer)
SELECT c_custkey, shard_group, CAST(floor((row_number() OVER (PARTITION BY shard_group ORDER BY c_custkey) - 1) / 40) AS BIGINT) AS shard FROM g""")
def discipline_shards(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return R.shards(c, F.when(F.col("c_nationkey") != 0, F.col("c_mktsegment")), ["c_custkey"]).select("c_custkey", "shard_group", "shard")


@query("SELECT p_partkey, p_brand, ntile(7) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS chunk FROM part")
def checklist_chunks(spark, sf_dir):
    return R.chunks(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", ["p_partkey"], 7)


@query("""WITH p AS (SELECT l_suppkey AS ref, l_partkey AS claim, min(l_orderkey) AS first_at, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY first_at, claim) - 1 AS i FROM p)
SELECT ref, claim, first_at, n, CAST(floor(i / 8) AS BIGINT) AS request, 'C' || CAST(i % 8 + 1 AS VARCHAR) AS handle FROM r""")
def citation_worklist(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ref"), F.col("l_partkey").alias("claim"), "l_orderkey")
    return R.worklist(items, "ref", "claim", "l_orderkey")


VERDICT = "CASE event_id % 4 WHEN 0 THEN 'CHECKED_SUPPORTS' WHEN 1 THEN 'UNRESOLVABLE' WHEN 2 THEN 'UNCHECKED' ELSE 'CHECKED_MISMATCH' END"


@query(f"""WITH a AS (SELECT user_id, event_type, {VERDICT} AS s FROM events)
SELECT user_id, event_type, CASE WHEN bool_or(s = 'CHECKED_MISMATCH') THEN 'CHECKED_MISMATCH' WHEN bool_or(s = 'CHECKED_SUPPORTS') THEN 'CHECKED_SUPPORTS' WHEN bool_or(s = 'UNRESOLVABLE') THEN 'UNRESOLVABLE' ELSE 'UNCHECKED' END AS status, count(*) AS n FROM a GROUP BY ALL""")
def citation_verdicts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.struct("user_id", "event_type").alias("k"), F.expr(VERDICT).alias("status"))
    return R.combined_verdict(e, "k", "status").select("k.user_id", "k.event_type", "status", "n")


@query("""WITH b AS (SELECT user_id AS page, greatest(CAST(event_id * 37 % 800 AS DOUBLE), 20.0) AS y0, least(CAST(event_id * 37 % 800 + 15 AS DOUBLE), 780.0) AS y1 FROM events), k AS (SELECT * FROM b WHERE y1 > y0),
a AS (SELECT * FROM k UNION ALL SELECT DISTINCT page, 780.0, 780.0 FROM k),
g AS (SELECT page, y0, coalesce(max(y1) OVER (PARTITION BY page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 20.0) AS free FROM a),
d AS (SELECT DISTINCT page, free AS band_y0, y0 AS band_y1 FROM g WHERE y0 - free >= 30)
SELECT *, row_number() OVER (PARTITION BY page ORDER BY band_y0 - band_y1, band_y0) AS rank FROM d""")
def clear_bands(spark, sf_dir):
    b = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), (F.col("event_id") * 37 % 800).cast("double").alias("a"), (F.col("event_id") * 37 % 800 + 15).cast("double").alias("b"))
    return R.clear_bands(b, "page", "a", "b", 20.0, 780.0, 30.0)


@query("""WITH l AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS legs FROM lineitem GROUP BY 1), f AS (SELECT o_orderkey, list_concat([CAST(o_custkey AS BIGINT)], coalesce(legs, [])) AS s FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)
SELECT o_orderkey, CAST(unnest(generate_series(0, len(s) - 1)) AS INTEGER) AS leg, unnest(s) AS sheet FROM f""")
def explode_legs(spark, sf_dir):
    legs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("legs"))
    f = table(spark, sf_dir, "orders").join(legs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return R.expand_legs(f, "o_orderkey", "o_custkey", "legs")


@query("""WITH p AS (SELECT l_partkey AS entity, l_linenumber AS attribute, list_sort(list(DISTINCT l_returnflag)) AS v, count(DISTINCT l_orderkey) AS n_sheets FROM lineitem GROUP BY ALL)
SELECT entity, attribute, array_to_string(v, ',') AS "values", n_sheets FROM p WHERE len(v) > 1 AND n_sheets > 1""")
def fact_conflicts(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_linenumber").alias("attribute"), "l_returnflag", "l_orderkey")
    return R.fact_conflicts(facts, "entity", "attribute", "l_returnflag", "l_orderkey").withColumn("values", F.array_join("values", ","))


@query("""WITH t AS (SELECT user_id AS page, arg_min('T' || CAST(event_id AS VARCHAR), event_id) AS t FROM events WHERE event_type = 'view' GROUP BY 1), c AS (SELECT user_id AS page, arg_max('C' || CAST(event_id AS VARCHAR), event_id) AS c FROM events WHERE event_type = 'click' AND user_id % 2 = 0 GROUP BY 1)
SELECT coalesce(t.page, c.page) AS page, coalesce(c, t) AS id FROM t FULL JOIN c ON t.page = c.page""")
def sheet_id_overlay(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("ord"), "event_type")
    ids = lambda x: F.concat(F.lit(x), F.col("ord").cast("string")).alias("id")
    return R.id_overlay(e.where("event_type = 'view'").select("page", "ord", ids("T")), e.where("event_type = 'click' AND page % 2 = 0").select("page", "ord", ids("C")), "page")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_partkey) AS l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1 GROUP BY 1, 2""")
def first_seen_distinct(spark, sf_dir):
    from tessera.operators.audit import first_seen

    one = first_seen(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    return one.select("l_orderkey", "l_linenumber", F.lit(1).cast("long").alias("n"), "l_partkey")


@query("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END, o_custkey, o_totalprice, o_orderkey) AS n FROM orders), t AS (SELECT greatest(3, length(CAST(count(*) AS VARCHAR))) AS w FROM orders)
SELECT o_orderkey, n, 'QC-' || lpad(CAST(n AS VARCHAR), CAST(w AS INTEGER), '0') AS qc_id FROM o, t""")
def positional_numbering(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("set_level"))
    n = L.number_rows(spark, o, ["set_level", "o_custkey", "o_totalprice", "o_orderkey"])
    return n.select("o_orderkey", "n", L.numbered_label(F.col("n"), o.count()).alias("qc_id"))


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY CASE left(o_orderpriority, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 ELSE 2 END, o_custkey, o_totalprice IS NULL, o_totalprice, o_orderkey) AS triage FROM orders""")
def severity_triage_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.expr("CASE left(o_orderpriority, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 ELSE 2 END").alias("sev"), F.col("o_totalprice").isNull().alias("unplaced"))
    return L.number_rows(spark, o, ["sev", "o_custkey", "unplaced", "o_totalprice", "o_orderkey"], "triage").select("o_orderkey", "triage")


@query("""WITH g AS (SELECT p_partkey, CAST(p_size * 40 + 100 AS DOUBLE) AS w, CAST(p_size * 30 + 80 AS DOUBLE) AS h FROM part), t AS (SELECT *, unnest(generate_series(0, 2)) AS r FROM g), u AS (SELECT *, unnest(generate_series(0, 3)) AS c FROM t)
SELECT p_partkey, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, round(greatest(0.0, c * (w / 4) - w / 4 * 0.08), 6) AS x0, round(greatest(0.0, r * (h / 3) - h / 3 * 0.08), 6) AS y0, round(least(w, (c + 1) * (w / 4) + w / 4 * 0.08), 6) AS x1, round(least(h, (r + 1) * (h / 3) + h / 3 * 0.08), 6) AS y1 FROM u""")
def tile_grid(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40 + 100).cast("double").alias("w"), (F.col("p_size") * 30 + 80).cast("double").alias("h"))
    g = p.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(3))))
    rect = N.tile(F.col("w"), F.col("h"), F.col("r"), F.col("c"), F.lit(3), F.lit(4))
    return g.select("p_partkey", "r", "c", *[F.round(v, 6).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), rect, strict=True)])


@query("""WITH r AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x0, CAST(p_partkey % 40 AS DOUBLE) AS y0, CAST(p_size + 30 AS DOUBLE) AS x1, CAST(p_partkey % 40 + 20 AS DOUBLE) AS y1 FROM part),
i AS (SELECT *, greatest(0.0, least(x1, 50.0) - greatest(x0, 10.0)) * greatest(0.0, least(y1, 40.0) - greatest(y0, 10.0)) AS inter FROM r)
SELECT p_partkey, CASE WHEN inter <= 0 THEN 0.0 ELSE round(inter / ((x1 - x0) * (y1 - y0) + 40.0 * 30.0 - inter), 9) END AS iou,
  round(greatest(0.0, (x0 + x1) / 2 - greatest((x1 - x0) * 1.75, 350.0) / 2), 6) AS cx0, round(least(792.0, (x0 + x1) / 2 + greatest((x1 - x0) * 1.75, 350.0) / 2), 6) AS cx1,
  CASE WHEN (y0 + y1) / 2 < 200.0 THEN 'upper' ELSE 'middle' END || '-' || CASE WHEN (x0 + x1) / 2 < 264.0 THEN 'left' ELSE 'center' END AS label FROM i""")
def rect_iou(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    d = lambda e: F.expr(f"CAST({e} AS DOUBLE)")
    a = (d("p_size"), d("p_partkey % 40"), d("p_size + 30"), d("p_partkey % 40 + 20"))
    b = tuple(F.lit(x) for x in (10.0, 10.0, 50.0, 40.0))
    ctx = N.context_rect(a, F.lit(792.0), F.lit(612.0))
    label = N.position_label((a[0] + a[2]) / 2, (a[1] + a[3]) / 2, F.lit(792.0), F.lit(600.0))
    return p.select("p_partkey", F.round(N.iou(a, b), 9).alias("iou"), F.round(ctx[0], 6).alias("cx0"), F.round(ctx[2], 6).alias("cx1"), label.alias("label"))


@query("""WITH d AS (SELECT p_partkey, p_size * 60 AS w, (p_partkey % 50) * 40 AS h FROM part), s AS (SELECT *, CASE WHEN greatest(w, h) > 1568 THEN 1568.0::DOUBLE / greatest(w, h) ELSE 1.0::DOUBLE END AS k FROM d)
SELECT p_partkey, CAST(CASE WHEN w <= 0 OR h <= 0 THEN 0 ELSE least(1600, ceil((w * k) * (h * k) / 750.0::DOUBLE)) END AS BIGINT) AS tokens, CASE WHEN p_partkey % 900 <= 300 THEN 15 ELSE greatest(15, least(120, CAST(floor(15 + 105 * least(1.0::DOUBLE, (p_partkey % 900 - 300) / 300.0::DOUBLE)) AS INTEGER))) END AS poll FROM s""")
def image_tokens(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", N.image_tokens(F.col("p_size") * 60, (F.col("p_partkey") % 50) * 40).alias("tokens"), N.poll_interval(F.col("p_partkey") % 900).alias("poll"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 1 THEN '''=' || n_name WHEN n_nationkey % 4 = 2 THEN ''' +' || n_name WHEN n_nationkey % 4 = 3 THEN n_name || '@' ELSE n_name END AS safe FROM nation""")
def csv_safe_export(spark, sf_dir):
    raw = F.expr("CASE n_nationkey % 4 WHEN 1 THEN concat('=', n_name) WHEN 2 THEN concat(' +', n_name) WHEN 3 THEN concat(n_name, '@') ELSE n_name END")
    return table(spark, sf_dir, "nation").select("n_nationkey", T.csv_safe(raw).alias("safe"))


@query("""WITH r AS (SELECT user_id AS item, count(DISTINCT event_type) AS spans, count(*) AS n FROM events GROUP BY 1)
SELECT item, spans, CASE WHEN item % 5 = 0 THEN 'NOT_APPLICABLE' WHEN item % 5 = 1 THEN 'NOT_ASSESSED_PARTIAL' WHEN spans >= 2 THEN 'REPRODUCED' ELSE 'SINGLETON' END AS confidence FROM r""")
def self_consistency(spark, sf_dir):
    r = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("item")).agg(F.countDistinct("event_type").alias("spans"))
    return r.withColumn("confidence", L.confidence(F.when(F.col("item") % 5 == 0, 1).otherwise(2), F.when(F.col("item") % 5 == 1, 1).otherwise(2), F.col("spans")))


@query("""SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'click') <= 0 THEN 'FAILED' WHEN count(*) FILTER (WHERE event_type = 'purchase') > 1 THEN 'PARTIAL' ELSE 'COMPLETE' END AS outcome FROM events GROUP BY 1""")
def run_outcomes(spark, sf_dir):
    r = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("ok"), F.count_if(F.col("event_type") == "purchase").alias("err"))
    return r.select("user_id", R.run_outcome(F.col("ok"), F.when(F.col("err") > 1, 1).otherwise(0), F.lit("COMPLETE"), F.lit("COMPLETE")).alias("outcome"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'REJECTED' WHEN l_returnflag = 'A' THEN 'VERIFIED' WHEN l_linestatus = 'O' THEN 'UNANCHORED' ELSE 'UNCERTAIN' END AS status FROM lineitem""")
def display_status(spark, sf_dir):
    v = F.expr("CASE l_returnflag WHEN 'R' THEN 'REJECTED' WHEN 'A' THEN 'VERIFIED' END")
    a = F.expr("CASE WHEN l_linestatus = 'O' THEN NULL ELSE 'EXACT' END")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", R.display_status(v, a).alias("status"))


@query("""SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter(['a' || CAST(c_nationkey % 3 AS VARCHAR), 'b', 'a1', 'c' || CAST(c_custkey % 4 AS VARCHAR)], lambda x: x NOT IN ('b', 'c2')))), ',') AS picked FROM customer""")
def profile_selection(spark, sf_dir):
    a = F.array(F.concat(F.lit("a"), (F.col("c_nationkey") % 3).cast("string")), F.lit("b"))
    b = F.array(F.lit("a1"), F.concat(F.lit("c"), (F.col("c_custkey") % 4).cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_sort(R.profile_selection(a, b, F.array(F.lit("b"), F.lit("c2")))), ",").alias("picked"))
