"""Reconciliation, caches, usage, run logs and report queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.operators.ledger import number_rows


def source_ids(rows: DataFrame, path: str, order: str, name: str = "source_id") -> DataFrame:
    """Distinct paths in order of first appearance, as SRC-0001 …; one row a path. Numbers are dealt out by range."""
    first = rows.groupBy(path).agg(F.min(order).alias("first_at"))
    numbered = number_rows(rows.sparkSession, first, [F.col("first_at"), F.col(path)], "__n")
    return numbered.withColumn(name, F.format_string("SRC-%04d", "__n")).drop("__n")


def inventory(rows: DataFrame, path: str, order: str, usable: Column) -> DataFrame:
    """ACCEPTED for the first usable row of a path, DUPLICATE for its later ones, REJECTED for the rest."""
    w = Window.partitionBy(path, "__ok").orderBy(order)
    df = rows.withColumn("__ok", usable).withColumn("__rn", F.row_number().over(w))
    seen = F.min(F.when(F.col("__ok"), F.col(order))).over(Window.partitionBy(path))
    status = F.when(F.col("__ok") & (F.col("__rn") == 1), "ACCEPTED").when(seen.isNotNull() & (F.col(order) > seen), "DUPLICATE").otherwise("REJECTED")
    return df.withColumn("status", status).drop("__ok", "__rn")


def mutations(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, size, mtime, sha) snapshots -> reason per source: UNCHANGED where size and time agree, else by content."""
    a = before.select(key, *[F.col(c).alias(f"b_{c}") for c in ("size", "mtime", "sha")])
    df = a.join(after.select(key, *[F.col(c).alias(f"a_{c}") for c in ("size", "mtime", "sha")]), key, "left")
    same = (F.col("a_size") == F.col("b_size")) & (F.col("a_mtime") == F.col("b_mtime"))
    reason = F.when(F.col("a_sha").isNull() & F.col("a_size").isNull(), "MISSING").when(same, "UNCHANGED").when(F.col("a_sha") == F.col("b_sha"), "TOUCHED").otherwise("CHANGED")
    return df.select(key, reason.alias("reason"))


def plan_vs_receipts(plan: DataFrame, receipts: DataFrame, key: str, failed: Column) -> DataFrame:
    """OK, MISSING, UNEXPECTED, DUPLICATE or FAILED for every planned or received id."""
    got = receipts.groupBy(key).agg(F.count("*").alias("n_receipts"), F.bool_or(failed).alias("any_failed"))
    both = plan.select(key).distinct().withColumn("planned", F.lit(True)).join(got, key, "full_outer")
    status = F.when(F.col("n_receipts").isNull(), "MISSING").when(F.col("planned").isNull(), "UNEXPECTED").when(F.col("any_failed"), "FAILED").when(F.col("n_receipts") > 1, "DUPLICATE").otherwise("OK")
    return both.select(key, F.coalesce("n_receipts", F.lit(0)).alias("n_receipts"), status.alias("status"))


def cache_probe(wanted: DataFrame, entries: DataFrame, key: str, at: str, now: Column, ttl_days: int) -> DataFrame:
    """HIT for keys whose latest entry is younger than the lifetime, EXPIRED or MISS else; a lifetime of 0 is off."""
    latest = entries.groupBy(key).agg(F.max(at).alias("checked_at"))
    age = F.unix_micros(now) - F.unix_micros(F.col("checked_at"))
    fresh = F.lit(ttl_days > 0) & (age < ttl_days * 86_400_000_000)
    out = wanted.select(key).distinct().join(latest, key, "left")
    return out.withColumn("outcome", F.when(F.col("checked_at").isNull(), "MISS").when(fresh, "HIT").otherwise("EXPIRED"))


def upsert(table: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """The latest row of each key."""
    both = table.unionByName(changes)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), F.col(seq)).alias("r")).select("r.*")


def cache_key(*parts: Column) -> Column:
    """A digest of every input that can change the output; nulls count."""
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{i:02d}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def set_fingerprint(rows: DataFrame, ident: str, sha: str, group: str, groups: DataFrame | None = None) -> DataFrame:
    """A digest of each group's sorted (id, content digest) pairs; empty where one is unknown, and for those of
    ``groups`` (a table of all groups) that have no rows."""
    each = F.concat(F.col(ident).cast("string"), F.lit("\x1f"), F.col(sha), F.lit("\x1f"))
    per = rows.groupBy(group).agg(F.array_sort(F.collect_list(each)).alias("p"), F.bool_or(F.col(sha).isNull()).alias("unknown"))
    out = per.select(group, F.when(F.col("unknown"), "").otherwise(F.sha2(F.array_join("p", ""), 256)).alias("fingerprint"))
    if groups is None:
        return out
    return groups.select(group).distinct().join(out, group, "left").select(group, F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds price_in and price_out of the exact model or else of its longest delimited prefix.

    ``prices``: (name, price_in, price_out), broadcast: a price list is small."""
    models = usage.select("model").distinct()
    fits = (F.col("model") == F.col("name")) | F.col("model").startswith(F.concat(F.col("name"), F.lit("-")))
    best = models.join(F.broadcast(prices), fits).groupBy("model").agg(F.max_by(F.struct("price_in", "price_out"), F.length("name")).alias("p"))
    return usage.join(best, "model", "left").withColumn("price_in", F.col("p.price_in")).withColumn("price_out", F.col("p.price_out")).drop("p")


def with_cost(usage: DataFrame) -> DataFrame:
    c = F.col
    return usage.withColumn("cost", N.usage_cost(c("input_tokens"), c("output_tokens"), c("cache_read_tokens"), c("cache_write_tokens"), c("searches"), c("price_in"), c("price_out"), c("batch")))


def rollup_usage(usage: DataFrame, family: str) -> DataFrame:
    """Sums per family and over all (family null); a cost is unknown if one of its billable records is."""
    poison = F.bool_or(F.col("cost").isNull() & F.col("billable"))
    return usage.rollup(family).agg(
        F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count_if(F.col("cost").isNull() & F.col("billable")).alias("n_unpriced"),
        F.when(poison, F.lit(None)).otherwise(F.sum("cost")).alias("cost"),
    )


def stage_durations(events: DataFrame, run: list[str], stage: str, at: str, is_start: Column, is_end: Column) -> DataFrame:
    """Microseconds from each stage's first start to its last end, at least 0; without a start no row."""
    per = events.groupBy(*run, stage).agg(F.min(F.when(is_start, F.col(at))).alias("s"), F.max(F.when(is_end, F.col(at))).alias("e")).where("s IS NOT NULL AND e IS NOT NULL")
    return per.select(*run, stage, F.greatest(F.lit(0), F.unix_micros("e") - F.unix_micros("s")).alias("micros"))


def stalls(polls: DataFrame, job: str, at: str, done: str, limit_seconds: int) -> DataFrame:
    """Polls without progress for ``limit_seconds`` or more since the done count last rose."""
    w = Window.partitionBy(job).orderBy(at, "seq").rowsBetween(Window.unboundedPreceding, -1)
    df = polls.withColumn("best", F.max(done).over(w))
    moved = F.when(F.col("best").isNull() | (F.col(done) > F.col("best")), F.col(at))
    df = df.withColumn("moved_at", F.max(moved).over(Window.partitionBy(job).orderBy(at, "seq").rowsBetween(Window.unboundedPreceding, 0)))
    idle = F.unix_micros(F.col(at)) - F.unix_micros("moved_at")
    return df.where(idle >= limit_seconds * 1_000_000).groupBy(job).agg(F.min(at).alias("stalled_at"), F.count("*").alias("n_stalled"))


def roll_up_status(stages: DataFrame, run: str, status: str) -> DataFrame:
    """FAILED if every stage failed, PARTIAL if some did or were partial, COMPLETE else."""
    per = stages.groupBy(run).agg(F.bool_and(F.col(status) == "FAILED").alias("all_failed"), F.bool_or(F.col(status).isin("FAILED", "PARTIAL")).alias("some"))
    return per.select(run, F.when(F.col("all_failed"), "FAILED").when(F.col("some"), "PARTIAL").otherwise("COMPLETE").alias("outcome"))


def run_outcome(ok: Column, errors: Column, qc: Column, coverage: Column) -> Column:
    return F.when(ok <= 0, "FAILED").when((errors > 0) | qc.isin("PARTIAL", "FAILED") | (coverage == "INCOMPLETE"), "PARTIAL").otherwise("COMPLETE")


def facets(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by each of two columns and over all: (facet, value, n)."""
    g = rows.groupingSets([[F.col(a)], [F.col(b)], []], F.col(a), F.col(b)).agg(F.count("*").alias("n"), F.grouping(F.col(a)).alias("ga"), F.grouping(F.col(b)).alias("gb"))
    facet = F.when((F.col("ga") == 1) & (F.col("gb") == 1), "all").when(F.col("gb") == 1, a).otherwise(b)
    return g.select(facet.alias("facet"), F.when(facet == a, F.col(a)).when(facet == b, F.col(b)).alias("value"), "n")


def display_status(verification: Column, anchor: Column) -> Column:
    v, a = F.coalesce(verification, F.lit("SKIPPED")), F.coalesce(anchor, F.lit("UNANCHORED"))
    return F.when(v.isin("REJECTED", "DETERMINISTIC", "VERIFIED"), v).when(a == "UNANCHORED", "UNANCHORED").otherwise("UNCERTAIN")


def query_findings(rows: DataFrame, order: list, limit: int = 50, category: str | None = None, severity: str | None = None, contains: str | None = None, text: str = "text") -> DataFrame:
    """The report's query: equality and substring filters, case-insensitive, the first ``limit`` (1 to 100) rows and the total."""
    df = rows
    for c, v in (("category", category), ("severity", severity)):
        if v is not None:
            df = df.where(F.lower(c) == v.lower())
    if contains is not None:
        df = df.where(F.lower(text).contains(contains.lower()))
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).limit(max(1, min(100, limit))).crossJoin(F.broadcast(total))


def visible_cards(blocks: DataFrame, card: str, hit: Column) -> DataFrame:
    """A card shows if one of its blocks does."""
    return blocks.groupBy(card).agg(F.bool_or(hit).alias("visible"), F.count_if(hit).alias("n_hits"), F.count("*").alias("n_blocks"))


def shards(rows: DataFrame, group: Column, order: list[str], size: int = 40) -> DataFrame:
    """Adds shard: groups ('?' without one) in chunks of ``size``."""
    df = rows.withColumn("shard_group", F.coalesce(group, F.lit("?")))
    return df.withColumn("shard", F.floor((F.row_number().over(Window.partitionBy("shard_group").orderBy(*order)) - 1) / size))


def chunks(rows: DataFrame, part: str, order: list[str], n: int) -> DataFrame:
    """n contiguous chunks per part, the remainder to the first ones."""
    return rows.withColumn("chunk", F.ntile(n).over(Window.partitionBy(part).orderBy(*order)))


def worklist(refs: DataFrame, ref: str, claim: str, order: str, size: int = 8) -> DataFrame:
    """Distinct claims of each reference in order of first appearance, in requests of ``size`` with handles C1 …"""
    per = refs.groupBy(ref, claim).agg(F.min(order).alias("first_at"), F.count("*").alias("n"))
    rn = F.row_number().over(Window.partitionBy(ref).orderBy("first_at", claim))
    return per.withColumn("request", F.floor((rn - 1) / size)).withColumn("handle", F.concat(F.lit("C"), ((rn - 1) % size + 1).cast("string")))


def combined_verdict(assessments: DataFrame, key: str, status: str) -> DataFrame:
    """The gravest status: MISMATCH, then SUPPORTS, UNRESOLVABLE, UNCHECKED."""
    order = F.when(F.col(status) == "CHECKED_MISMATCH", 0).when(F.col(status) == "CHECKED_SUPPORTS", 1).when(F.col(status) == "UNRESOLVABLE", 2).otherwise(3)
    return assessments.groupBy(key).agg(F.min_by(status, order).alias("status"), F.count("*").alias("n"))


def clear_bands(boxes: DataFrame, page: str, y0: str, y1: str, top: float, bottom: float, least: float) -> DataFrame:
    """Gaps of at least ``least`` between a page's merged vertical intervals, tallest first."""
    b = boxes.select(page, F.greatest(F.col(y0), F.lit(top)).alias("y0"), F.least(F.col(y1), F.lit(bottom)).alias("y1")).where("y1 > y0")
    ends = b.select(page).distinct()
    b = b.unionByName(ends.select(page, F.lit(bottom).alias("y0"), F.lit(bottom).alias("y1")))
    w = Window.partitionBy(page).orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    gap = b.withColumn("free_from", F.coalesce(F.max("y1").over(w), F.lit(top))).where(F.col("y0") - F.col("free_from") >= least)
    gap = gap.select(page, F.col("free_from").alias("band_y0"), F.col("y0").alias("band_y1")).distinct()
    return gap.withColumn("rank", F.row_number().over(Window.partitionBy(page).orderBy((F.col("band_y0") - F.col("band_y1")), "band_y0")))


def expand_legs(findings: DataFrame, key: str, primary: str, legs: str) -> DataFrame:
    """One row per sheet that a finding touches: the primary one first (leg 0)."""
    return findings.select(key, F.posexplode(F.concat(F.array(primary), F.coalesce(legs, F.array()))).alias("leg", "sheet"))


def fact_conflicts(facts: DataFrame, entity: str, attribute: str, value: str, sheet: str) -> DataFrame:
    """Attributes of an entity that sheets state differently: the values and how many sheets state any."""
    per = facts.groupBy(entity, attribute).agg(F.array_sort(F.collect_set(value)).alias("values"), F.countDistinct(sheet).alias("n_sheets"))
    return per.where((F.size("values") > 1) & (F.col("n_sheets") > 1))


def id_overlay(title_block: DataFrame, carried: DataFrame, page: str) -> DataFrame:
    """Identifier per page: the first of the title block, overlaid by the last that a finding carried. (page, id, ord)"""
    first = title_block.groupBy(page).agg(F.min_by("id", "ord").alias("t"))
    last = carried.groupBy(page).agg(F.max_by("id", "ord").alias("c"))
    return first.join(last, page, "full_outer").select(page, F.coalesce("c", "t").alias("id"))


def first_fit(rows: DataFrame, part: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows taken in order while they fit into what is left of the part's budget; others are skipped, not a stop."""

    def take(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        left, out = budget, []
        for n in pdf[size]:
            out.append(bool(n <= left))
            left -= n if n <= left else 0
        return pdf.assign(included=out)

    return rows.groupBy(part).applyInPandas(take, rows.schema.simpleString()[7:-1] + ",included:boolean")


def profile_selection(suggested: Column, chosen: Column, dropped: Column) -> Column:
    return F.array_except(F.array_union(suggested, chosen), dropped)
