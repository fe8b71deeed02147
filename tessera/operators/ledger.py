"""The findings ledger: similarity joins, the complete-link fold, merging, ordering and numbering."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.numeric import iou
from tessera.store import CLEAN_SETTING, Store, setting

# Thresholds of the duplicate test.
TEXT_DUP, MODERATE, IOU_DUP = 0.7, 0.4, 0.5
#: Tokens whose counts order the prefixes of ``similar_pairs``; the others come before them.
FREQUENT = 1 << 17
#: Two sets must share so much of the smaller one in their prefixes.
SLACK = 0.03
#: Meetings of equal tokens in one pass, estimated from one in ``SIZED`` hashes.
PASS_PAIRS, SIZED = 500_000_000, 64
SEVERITY = {"high": 3, "medium": 2, "low": 1}
FAMILIES = {
    "digest_json": "digest", "digest_prose_coordination": "digest", "digest_prose_conflict": "digest", "focus_prose": "digest", "critique_1": "critique",
    "critique_2": "critique", "cross_qc": "cross", "synthesis_prose": "synthesis", "auditor_reference": "auditor", "auditor_arithmetic": "auditor",
    "auditor_naming": "auditor", "auditor_titleblock": "auditor", "auditor_sheet_index": "auditor",
}


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).otherwise(1)


def _frequent(spark: SparkSession, hashes: DataFrame, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """(h) -> the hashes met most often, in order, and their counts: at most ``FREQUENT``, taken by classes of counts."""
    counts = store.stage(hashes.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    steps = counts.groupBy(F.floor(F.log2("c") * 4).alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect()
    least, room = None, FREQUENT
    for r in sorted(steps, key=lambda r: -r.step):
        if (room := room - r.n) < 0:
            break
        least = r.c
    top = counts.where(F.col("c") >= least).toPandas().sort_values("h") if least else pd.DataFrame({"h": [], "c": []})
    store.drop(counts)
    return top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64)


def _needed(n: Column) -> Column:
    """How many tokens two sets must share in their prefixes, ``n`` being the smaller one's size."""
    return F.floor(n * SLACK) + 1


def similar_pairs(rows: DataFrame, key: str, ident: str, text: str, threshold: float = TEXT_DUP, per_pass: int = PASS_PAIRS) -> DataFrame:
    """Pairs of one key whose token sets have Jaccard ``threshold`` or more: key, a, b, score.

    Equal sets of a key are one set until the end. Tokens stand in one order, rare ones first. Two sets of x and y
    tokens need r = threshold / (1 + threshold) * (x + y) in common, so at least l of these stand in the first x - r + l of
    the one and y - r + l of the other; only such meet in the join, and l (one, and 3 % of the smaller set) must be
    shared before the sets themselves are read. Tokens are known by 64-bit hashes until then. The join runs in as
    many passes over the smaller sets as keep it near ``per_pass`` meetings, so disk doesn't grow as their square."""
    spark, store = rows.sparkSession, Store(rows.sparkSession, "pairs")
    sets = rows.select(F.col(key).alias("k"), F.col(ident).alias("id"), T.token_set(F.col(text)).alias("s")).where("k IS NOT NULL AND id IS NOT NULL AND size(s) > 0")
    own = store.stage(sets.withColumn("rid", F.monotonically_increasing_id()), "sets", "zstd")
    same = own.select("k", "id", "rid", F.md5(F.array_join(F.array_sort("s"), " ").cast("binary")).alias("set"))
    same = store.stage(same.withColumn("rep", F.min("rid").over(Window.partitionBy("k", "set"))).select("k", "id", "rid", "rep"), "same")
    one = own.join(same.where("rid <> rep").select("rid"), "rid", "left_anti").select("rid", F.transform("s", lambda t: F.xxhash64("k", t)).alias("hs"))
    known, met = _frequent(spark, one.select(F.explode("hs").alias("h")), store)
    share, slack = threshold, SLACK

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ends = batch.column("hs").flatten().to_numpy(), np.cumsum(np.diff(batch.column("hs").offsets.to_numpy()))
            df = np.zeros(len(hs), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, hs), len(known) - 1)
                df = np.where(known[at] == hs, met[at], 0)
            out, start = [], 0
            for rid, end in zip(batch.column("rid").to_numpy(), ends, strict=True):
                n = int(end - start)
                most = min(n, n - math.ceil(share * n - 1e-6) + math.floor(n * slack) + 1)
                first = hs[start:end][np.lexsort((hs[start:end], df[start:end]))[:most]]
                out.append((first, np.full(most, rid), np.full(most, n, np.int32), np.arange(1, most + 1, dtype=np.int32)))
                start = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["h", "rid", "n", "at"])

    prefix = store.stage(one.mapInArrow(prefixes, "h long, rid long, n int, at int"), "prefixes")
    ratio = threshold / (1 + threshold)
    least = lambda x, y: F.ceil((x + y) * ratio - 1e-6)
    smaller = F.col("at") <= F.col("n") - least(F.col("n"), F.col("n")) + _needed(F.col("n"))
    share_of_hashes = prefix.where(F.pmod("h", F.lit(SIZED)) == 0).groupBy("h").agg(F.count("*").alias("n"), F.count_if(smaller).alias("m"))
    with setting(spark, CLEAN_SETTING, "true"):
        meetings = (share_of_hashes.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0) * SIZED
    passes = -(-meetings // per_pass) or 1
    found = None
    for i in range(passes):
        a = prefix.where(smaller & (F.pmod(F.xxhash64("rid"), F.lit(passes)) == i)).select("h", F.col("rid").alias("a"), F.col("n").alias("x"), F.col("at").alias("i"))
        b = prefix.select("h", F.col("rid").alias("b"), F.col("n").alias("y"), F.col("at").alias("j"))
        x, y, need = F.col("x"), F.col("y"), F.least(_needed(F.col("x")), least(F.col("x"), F.col("y")))
        within = (F.col("i") <= x - least(x, y) + need) & (F.col("j") <= y - least(x, y) + need)
        meet = a.join(b, "h").where(((x < y) | (x == y) & (F.col("a") < F.col("b"))) & (x >= y * threshold - 1e-6) & within)
        pairs = store.stage(meet.select("a", "b", need.cast("int").alias("need")).groupBy("a", "b", "need").agg(F.count("*").alias("c")).where("c >= need").select("a", "b"), "met")
        ids = store.stage(pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct(), "ids")
        few = own.join(ids, "rid", "left_semi")
        both = pairs.join(few.select(F.col("rid").alias("a"), F.col("s").alias("x")), "a").join(few.select(F.col("rid").alias("b"), F.col("s").alias("y")), "b")
        like = both.select("a", "b", T.jaccard(F.col("x"), F.col("y")).alias("score")).where(F.col("score") >= threshold)
        like = store.stage(like, "like")
        found = like if found is None else found.unionByName(like)
        store.drop(pairs)
        store.drop(ids)
    store.drop(prefix)
    # equal sets: each row of the one meets each row of the other
    left, right = same.select("k", F.col("rep").alias("a"), F.col("id").alias("p")), same.select(F.col("rep").alias("b"), F.col("id").alias("q"))
    across = found.join(left, "a").join(right, "b").select("k", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "score")
    within = left.join(right, F.col("a") == F.col("b")).where("p < q").select("k", F.col("p").alias("a"), F.col("q").alias("b"), F.lit(1.0).alias("score"))
    return across.where("a < b").unionByName(within.where(F.lit(threshold <= 1))).select(F.col("k").alias(key), "a", "b", "score")


def compatible(a: str, b: str) -> Column:
    """Whether two findings' (struct columns) tags, measurements, absence, legs and categories allow a merge."""
    sig = lambda s: F.concat_ws(" ", F.coalesce(f"{s}.text", F.lit("")), F.coalesce(f"{s}.source_quote", F.lit("")))
    clash = lambda f: (F.size(f(sig(a))) > 0) & (F.size(f(sig(b))) > 0) & ~F.arrays_overlap(f(sig(a)), f(sig(b)))
    same = F.lower(f"{a}.category") == F.lower(f"{b}.category")
    question = F.lower(f"{a}.category").eqNullSafe("question") | F.lower(f"{b}.category").eqNullSafe("question")
    return ~clash(T.equipment_tags) & ~clash(T.measurements) & (T.says_absent(sig(a)) == T.says_absent(sig(b))) & (same | question)


def is_duplicate(a: str, b: str, rects: bool = False) -> Column:
    """Compatible findings with like texts, or equal quotes and texts that share enough; with ``rects``
    also equal quotes in places (x0, y0, x1, y1) that overlap by more than half."""
    overlap = T.jaccard(T.token_set(F.col(f"{a}.text")), T.token_set(F.col(f"{b}.text")))
    quote = T.squash(F.col(f"{a}.source_quote"))
    equal = (quote != "") & (quote == T.squash(F.col(f"{b}.source_quote")))
    place = F.lit(False)
    if rects:
        box = lambda s: tuple(F.col(f"{s}.{c}") for c in ("x0", "y0", "x1", "y1"))
        place = F.coalesce(iou(box(a), box(b)) > IOU_DUP, F.lit(False))
    return compatible(a, b) & ((overlap >= TEXT_DUP) | (equal & (overlap >= MODERATE)) | (equal & place))


RECT = ("x0", "y0", "x1", "y1")


def _features(rows: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    """What the duplicate test reads, as columns: tokens, tags, measurements, absence, category, quote, rectangle.

    A column that ``rows`` lacks counts as empty; with no category at all, none stands in the way."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit("")
    sig = F.concat_ws(" ", F.coalesce(F.col(text), F.lit("")), F.coalesce(has("source_quote"), F.lit("")))
    rect = F.array(*[F.col(c).cast("double") for c in RECT]) if set(RECT) <= set(rows.columns) else F.lit(None).cast("array<double>")
    made = {
        "__tokens": F.array_sort(T.token_set(F.col(text))), "__tags": T.equipment_tags(sig), "__sizes": T.measurements(sig), "__absent": T.says_absent(sig),
        "__category": F.coalesce(F.lower(has("category")), F.lit("")), "__quote": T.squash(has("source_quote")), "__rect": rect,
    }
    return rows.withColumns(made), list(made)


def _overlap(a, b) -> float:
    if a is None or b is None or any(v is None or v != v for v in (*a, *b)):
        return 0.0
    both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    each = sum(max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1]) for r in (a, b))
    return both / (each - both) if both > 0 else 0.0


def _same_finding(a: tuple, b: tuple, threshold: float) -> bool:
    """``is_duplicate`` on two rows' features: (tokens, tags, sizes, absent, category, quote, rectangle)."""
    if any(x and y and not x & y for x, y in ((a[1], b[1]), (a[2], b[2]))) or a[3] != b[3]:
        return False
    if a[4] != b[4] and "question" not in (a[4], b[4]):
        return False
    shared = len(a[0] & b[0])
    like = shared / (len(a[0]) + len(b[0]) - shared) if a[0] and b[0] else 0.0
    equal = a[5] != "" and a[5] == b[5]
    return like >= threshold or equal and (like >= MODERATE or _overlap(a[6], b[6]) > IOU_DUP)


def complete_link(rows: DataFrame, key: str, order: str, text: str, threshold: float = TEXT_DUP) -> DataFrame:
    """Greedy complete-link clusters of each key, in order: a row joins the first cluster all of whose members
    the full duplicate test calls the same (compatible tags, measurements, absence and category; and like texts, or
    equal quotes with texts or rectangles that agree enough), else it starts one. Adds ``cluster``, the order value
    of the cluster's first row. Columns source_quote, category and x0, y0, x1, y1 are read where ``rows`` has them.

    Order decides, so a key's rows (a page's findings) meet in one task; candidates come from an index of tokens and quotes."""
    given, made = _features(rows, text)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        members: list[list[tuple]] = []
        index: dict[str, set[int]] = {}
        heads, out = [], []
        for o, tokens, tags, sizes, absent, category, quote, rect in zip(pdf[order], *[pdf[c] for c in made], strict=True):
            own = (frozenset(tokens), frozenset(tags), frozenset(sizes), absent, category, quote, rect)
            keys = [*own[0], *(["\0" + quote] if quote else [])]
            near = sorted({c for w in keys for c in index.get(w, ())})
            hit = next((c for c in near if all(_same_finding(m, own, threshold) for m in members[c])), None)
            if hit is None:
                hit = len(members)
                members.append([])
                heads.append(o)
            members[hit].append(own)
            for w in keys:
                index.setdefault(w, set()).add(hit)
            out.append(heads[hit])
        return pdf.drop(columns=made).assign(cluster=out)

    schema = rows.schema.simpleString()[7:-1]
    kind = dict(rows.dtypes)[order]
    return given.groupBy(key).applyInPandas(fold, f"{schema},cluster:{kind}")


def post_anchor_fold(rows: DataFrame, key: str, threshold: float = TEXT_DUP) -> DataFrame:
    """The second fold, of placed findings: as ``complete_link``, with rectangles where ``rows`` has x0, y0, x1, y1, the
    best grounded first (adds rank, cluster)."""
    quality = [F.length(F.btrim(F.coalesce("source_quote", F.lit("")))).desc(), severity_rank(F.col("severity")).desc(), F.col("id").desc(), F.col("text").desc()]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*quality)))
    return complete_link(ranked, key, "rank", "text", threshold)


def merge_clusters(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One finding per cluster: the best grounded member's text, quote, category and anchor as one
    bundle, the highest severity, the union of sources in order, other quotes as support, and whether
    two families of sources agree. ``rows``: order, id, text, source_quote, severity, category, sources."""
    quality = F.struct(F.length(F.btrim(F.coalesce("source_quote", F.lit("")))), severity_rank(F.col("severity")), F.col("id"), F.col("text"))
    family = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    per = rows.groupBy(*keys).agg(
        F.max_by(F.struct("id", "text", "source_quote", "category"), quality).alias("best"), F.max(severity_rank(F.col("severity"))).alias("rank"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "sources"))), lambda x: x["sources"]))).alias("sources"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, F.btrim("source_quote").alias("q")))), lambda x: x["q"])).alias("quotes"), F.count("*").alias("members"),
    )
    families = F.array_distinct(F.transform("sources", lambda s: F.coalesce(F.try_element_at(family, s), s)))
    support = F.filter("quotes", lambda q: q.isNotNull() & (q != "") & (T.squash(q) != T.squash(F.col("best.source_quote"))))
    return per.select(
        *keys, "best.id", "best.text", "best.source_quote", "best.category", F.when(F.col("rank") == 3, "high").when(F.col("rank") == 2, "medium").otherwise("low").alias("severity"),
        "sources", support.alias("supporting_quotes"), (F.size(families) >= 2).alias("reproduced"), "members", T.provenance(F.col("sources")).alias("provenance"),
    )


def confidence(requested: Column, successful: Column, spans: Column) -> Column:
    """How far repeated reads agree on a finding."""
    return F.when(requested < 2, "NOT_APPLICABLE").when(successful < 2, "NOT_ASSESSED_PARTIAL").when(spans >= 2, "REPRODUCED").otherwise("SINGLETON")


def number_rows(spark: SparkSession, df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """Dense global numbers from 1 in ``order``, without a single-task window: rows are dealt out by
    range and sorted, numbered within their range, and the ranges' sizes summed (one row a range)."""
    store = Store(spark, "number")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = store.stage(placed.withColumn("__part", F.shiftright("__id", 33)), "placed")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("c"))
    bases = sizes.select("__part", (F.sum("c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).alias("base"))
    return placed.join(F.broadcast(bases), "__part").withColumn(name, F.coalesce("base", F.lit(0)) + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__id", "__part", "base")


def numbered_label(n: Column, total: int, prefix: str = "QC-") -> Column:
    """``QC-001``: at least three digits, as many as the total has."""
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), max(3, len(str(total))), "0"))


def late_rows(arrivals: DataFrame, sealed: DataFrame, key: list[str]) -> DataFrame:
    """Rows that came after the seal: kept, and told apart."""
    return arrivals.join(sealed.select(*key), key, "left_anti")


def best_match(items: DataFrame, entries: DataFrame, key: str, threshold: float = TEXT_DUP) -> DataFrame:
    """Each item's (key, item_id, item) best entry (key, ord, text, quote) on its key, first of equals, at ``threshold`` or more."""
    i = items.withColumn("s", T.token_set(F.col("item")))
    e = entries.withColumn("x", T.token_set(F.col("text"))).withColumn("y", T.token_set(F.col("quote")))
    hits = i.select(key, "item_id", F.explode("s").alias("t")).join(e.select(key, "ord", F.explode(F.array_union("x", "y")).alias("t")), [key, "t"]).select(key, "item_id", "ord").distinct()
    full = hits.join(i.select(key, "item_id", "s"), [key, "item_id"]).join(e.select(key, "ord", "x", "y"), [key, "ord"])
    full = full.withColumn("score", F.greatest(T.jaccard(F.col("s"), F.col("x")), T.jaccard(F.col("s"), F.col("y")))).where(F.col("score") >= threshold)
    best = full.groupBy(key, "item_id").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"))).alias("m"))
    return items.join(best.select(key, "item_id", (-F.col("m.o")).alias("entry"), F.col("m.score").alias("score")), [key, "item_id"], "left")
