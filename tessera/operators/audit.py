"""Deterministic audits: naming drift, arithmetic, references, index, consensus, sections, editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import text as T

#: Ids are sent to the executors in blocks of so many (a few MB).
NEAREST_IDS = 100_000


def naming_drift(tags: DataFrame, tag: str = "tag", sheet: str = "sheet", known_ids: DataFrame | None = None, established_at: int = 2, drift_max: int = 2) -> DataFrame:
    """Rare spellings of a tag whose letters and digits equal those of an established one.

    Returns sheet, tag, canonical, n_sheet, n_total. Spellings meet by an equi-join on their key."""
    t = tags.where(T.is_tag(F.col(tag))).select(F.upper(F.btrim(F.col(tag))).alias("tag"), F.col(sheet).alias("sheet"))
    if known_ids is not None:
        t = t.join(known_ids.select(F.col(known_ids.columns[0]).alias("tag")).distinct(), "tag", "left_anti")
    on_sheet = t.groupBy("tag", "sheet").agg(F.count("*").alias("n_sheet"))
    per = on_sheet.groupBy("tag").agg(F.sum("n_sheet").alias("n_total")).withColumn("key", T.tag_key(F.col("tag")))
    w = Window.partitionBy("key")
    per = per.withColumn("spellings", F.count("*").over(w)).where("spellings > 1").withColumn("dominant", F.max("n_total").over(w)).withColumn("first", F.min("tag").over(w))
    settled = F.when(F.col("dominant") >= established_at, F.col("n_total") >= established_at).otherwise(F.col("tag") == F.col("first"))
    per = per.withColumn("settled", settled)
    drift = per.where(~F.col("settled") & ((F.col("dominant") < established_at) | ((F.col("n_total") < F.col("dominant")) & (F.col("n_total") <= drift_max))))
    best = drift.select("key", "tag", "n_total").join(per.where("settled").select("key", F.col("tag").alias("canonical"), F.col("n_total").alias("n_canonical")), "key")
    best = best.groupBy("tag", "n_total").agg(F.min_by("canonical", F.struct(F.levenshtein("tag", "canonical"), -F.col("n_canonical"), F.col("canonical"))).alias("canonical"))
    return on_sheet.join(best, "tag").select("sheet", "tag", "canonical", "n_sheet", "n_total")


def arithmetic(claims: DataFrame) -> DataFrame:
    """(kind, terms array<decimal>, expected decimal, quote) -> adds actual, outcome, severity, origin.

    outcome: unusable, matched or mismatched. origin says whether every operand stands in the quote."""
    kind = F.lower(F.btrim("kind"))
    usable = F.col("expected").isNotNull() & ~F.exists("terms", lambda t: t.isNull())
    df = claims.withColumn("actual", F.when(usable, N.computed(kind, F.col("terms"))))
    fine = N.agrees(F.col("actual"), F.col("expected"))
    df = df.withColumn("outcome", F.when(F.col("actual").isNull(), "unusable").when(fine, "matched").otherwise("mismatched"))
    bad = F.col("outcome") == "mismatched"
    df = df.withColumn("severity", F.when(bad, N.severity_of_gap(F.col("actual"), F.col("expected"))))
    return df.withColumn("origin", F.when(bad, F.when(N.operands_in_quote(F.col("terms"), F.col("expected"), F.col("quote")), "TEXT_EXTRACTED").otherwise("MODEL_TRANSCRIBED")))


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; all columns stay."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def grammar(ids: DataFrame, column: str = "id") -> DataFrame:
    return ids.select(T.id_signature(F.col(column)).alias("signature")).where("signature IS NOT NULL").distinct()


def nearest(targets: DataFrame, ids: DataFrame, target: str = "target", column: str = "id", within: int | None = None, block: int = NEAREST_IDS) -> DataFrame:
    """Each distinct target's closest id and distance; of equals the smallest id.

    The ids are counted and taken in blocks of about ``block``, each broadcast and reduced to one row a target, so
    neither what is sent nor what is kept grows with them; a target whose length differs by more than ``within``
    from an id never meets it."""
    d = F.levenshtein("t", "i") if within is None else F.levenshtein("t", "i", within)
    own = targets.select(F.col(target).alias("t")).distinct()
    few = ids.select(F.col(column).alias("i")).distinct()
    parts = max(1, -(-few.count() // block))
    meet = F.lit(True) if within is None else (F.abs(F.length("t") - F.length("i")) <= within) & (d >= 0)
    best = None
    for k in range(parts):
        some = few if parts == 1 else few.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == k)
        one = own.join(F.broadcast(some), meet).groupBy("t").agg(F.min(F.struct(d.alias("distance"), F.col("i").alias("closest"))).alias("m"))
        best = one if best is None else best.unionByName(one)
    if parts > 1:
        best = best.groupBy("t").agg(F.min("m").alias("m"))
    return best.select(F.col("t").alias(target), "m.closest", "m.distance")


def classify_references(refs: DataFrame, ids: DataFrame, target: str = "target", column: str = "id") -> DataFrame:
    """RESOLVED_IN_SET, IGNORE, MISSING_FROM_SET or MALFORMED for each reference; the order of tests decides.

    A set of fewer than two ids, or one without grammar, never calls a reference malformed."""
    known = ids.select(T.sheet_id(F.col(column)).alias("id")).where("id <> ''").distinct()
    r = refs.withColumn("norm", T.sheet_id(F.col(target))).withColumn("signature", T.id_signature(F.col(target)))
    one = r.select("norm", "signature").distinct()
    one = one.join(known.select(F.col("id").alias("norm"), F.lit(True).alias("in_set")), "norm", "left")
    one = one.join(grammar(known).withColumn("fits", F.lit(True)), "signature", "left")
    near = nearest(one.where(F.col("in_set").isNull() & ~T.is_non_sheet(F.col("norm"))), known, "norm", "id")
    size = known.agg((F.count("*") < 2).alias("unsure"))
    one = one.join(near, "norm", "left").join(F.broadcast(size))
    status = (
        F.when(F.col("in_set"), "RESOLVED_IN_SET").when(T.is_non_sheet(F.col("norm")), "IGNORE").when(F.col("fits"), "MISSING_FROM_SET")
        .when(F.col("unsure"), "IGNORE").when(F.col("distance") <= 2, "MALFORMED").otherwise("IGNORE")
    )
    shown = F.col("status").isin("MISSING_FROM_SET", "MALFORMED")
    one = one.withColumn("status", status).withColumn("closest", F.when(shown, F.col("closest"))).withColumn("distance", F.when(shown, F.col("distance")))
    return r.drop("signature").join(one.select("norm", "status", "closest", "distance"), "norm")


def resolve_ids(reported: DataFrame, entries: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """RESOLVED with the payload where an id has exactly one, UNBOUND without, AMBIGUOUS with several."""
    have = entries.where(T.sheet_id(F.col(key)) != "").select(T.sheet_id(F.col(key)).alias("norm"), F.col(payload).alias("p")).distinct().groupBy("norm").agg(F.count("*").alias("n"), F.min("p").alias("value"))
    out = reported.withColumn("norm", T.sheet_id(F.col(key))).join(have, "norm", "left")
    n = F.coalesce("n", F.lit(0))
    return out.withColumn("status", F.when(n == 0, "UNBOUND").when(n == 1, "RESOLVED").otherwise("AMBIGUOUS")).withColumn("candidates", n).withColumn("value", F.when(n == 1, F.col("value"))).drop("n")


def index_diff(listed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: LISTED_NOT_PRESENT or PRESENT_NOT_LISTED."""
    a = listed.select(key).distinct().withColumn("listed", F.lit(True))
    b = present.select(key).distinct().withColumn("present", F.lit(True))
    both = a.join(b, key, "full_outer").where("listed IS NULL OR present IS NULL")
    return both.select(key, F.when(F.col("present").isNull(), "LISTED_NOT_PRESENT").otherwise("PRESENT_NOT_LISTED").alias("status"))


def consensus_drift(rows: DataFrame, group: str, value: str, min_rows: int = 3, share: float = 0.8) -> DataFrame:
    """Rows that differ from a value on at least max(2, round(share * n)) of their group's n rows.

    Ties for the most frequent value go to the smallest; the share is rounded half to even."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("c"))
    mode = counts.groupBy(group).agg(F.sum("c").alias("n"), F.min(F.struct((-F.col("c")).alias("c"), F.col(value).alias("v"))).alias("m"))
    need = F.greatest(F.lit(2), F.bround(F.col("n") * share).cast("int"))
    mode = mode.where((F.col("n") >= min_rows) & (-F.col("m.c") >= need)).select(group, F.col("m.v").alias("consensus"), (-F.col("m.c")).alias("n_consensus"), F.col("n").alias("n_rows"))
    return rows.join(mode, group).where(F.col(value) != F.col("consensus"))


def recurrent_variants(tokens: DataFrame, sheet: str = "sheet", token: str = "token", share: float = 0.8) -> DataFrame:
    """Tokens that are a near spelling (same letters, one or two edits) of one on most sheets."""
    t = tokens.select(F.col(sheet).alias("sheet"), F.upper(F.col(token)).alias("token")).distinct()
    n = t.agg(F.countDistinct("sheet").alias("n"))
    letters = F.regexp_replace("token", r"[^\p{L}]", "")
    per = t.groupBy("token").agg(F.count("*").alias("c")).join(F.broadcast(n)).withColumn("shape", letters)
    per = per.withColumn("shared", F.col("c") >= F.greatest(F.lit(2), F.bround(F.col("n") * share).cast("int")))
    shared = per.where("shared").select("shape", F.col("token").alias("norm"))
    near = per.where(~F.col("shared")).select("shape", "token").join(shared, "shape")
    near = near.where((F.abs(F.length("token") - F.length("norm")) <= 1) & F.levenshtein("token", "norm").between(1, 2))
    return t.join(near.groupBy("token").agg(F.min("norm").alias("norm")), "token").select("sheet", "token", "norm")


def exact_runs(tokens: DataFrame, part: str, order: str, token: str, pattern: str = r"^[0-9]{2}$", length: int = 3, first_max: int = 49) -> DataFrame:
    """Maximal runs of tokens matching ``pattern`` that have exactly ``length`` and start at most at ``first_max``."""
    w = Window.partitionBy(part).orderBy(order)
    flag = F.coalesce(F.col(token).rlike(pattern), F.lit(False))
    df = tokens.withColumn("hit", flag).withColumn("rn", F.row_number().over(w)).where("hit")
    df = df.withColumn("island", F.col("rn") - F.row_number().over(w))
    runs = df.groupBy(part, "island").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rn", F.col(token).alias("t")))).alias("r"))
    runs = runs.where(F.col("n") == length).withColumn("spec", F.array_join(F.transform("r", lambda x: x["t"]), " "))
    return runs.where(F.left("spec", F.lit(2)).cast("int") <= first_max).groupBy(part, "spec").agg(F.min(F.col("r")[0]["rn"]).alias("first_at"))


def edition_mismatches(cited: DataFrame, adopted: DataFrame) -> DataFrame:
    """Cited (key, claim ``CODE YEAR``) whose code is adopted, but not in that year."""
    split = lambda df: df.withColumn("code", F.regexp_replace("claim", r" \d{4}$", "")).withColumn("year", F.right("claim", F.lit(4)))
    years = split(adopted).groupBy("code").agg(F.array_sort(F.collect_set("year")).alias("adopted"))
    return split(cited).join(years, "code").where(~F.array_contains("adopted", F.col("year")))


PHRASES = (
    # Trigger phrases around an identifier, and whether a small set may use them.
    (r"(?i)\bSEE\s+DRAWINGS?\s+({id})", True), (r"(?i)\bSEE\s+SHEETS?\s+({id})", True), (r"(?i)\bREFER\s+TO\s+({id})", True), (r"(?i)\bSEE\s+({id})\s+FOR\b", False),
    (r"(?i)\bON\s+DRAWINGS?\s+({id})", False), (r"(?i)\bPER\s+({id})", False), (r"(?<![A-Za-z0-9])\d{1,3}\s*/\s*({id})", True),
)
ID = r"[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*"


def phrase_references(pages: DataFrame, text: str = "text", strong_only: bool = False) -> DataFrame:
    """A row for each distinct reference phrase of a page: rule, target (shaped like an identifier)."""
    rules = [(i, p.replace("{id}", ID)) for i, (p, strong) in enumerate(PHRASES) if strong or not strong_only]
    tag = lambda i: lambda x: F.struct(F.lit(i).alias("rule"), x.alias("target"))
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)), tag(i)) for i, p in rules]))
    out = pages.withColumn("hit", F.explode(F.array_distinct(found))).select(*pages.columns, "hit.rule", "hit.target")
    return out.where(T.looks_like_sheet_id(F.col("target")))


def detect_sheet_ids(words: DataFrame, page: list[str], text: str = "text") -> DataFrame:
    """Each page's identifier: of its id-shaped words the one furthest to the lower right.

    ``words``: page columns, ordinal, x0, y0, x1, y1, text, page_w, page_h. Adjacent words of one line
    that only together look like an identifier count as one (up to three)."""
    w = Window.partitionBy(*page).orderBy("ordinal")
    shaped = lambda c: T.looks_like_sheet_id(c)
    df = words.select(*page, "ordinal", "page_w", "page_h", F.struct("x0", "y0", "x1", "y1", F.col(text).alias("t")).alias("w0"))
    for k in (1, 2):
        df = df.withColumn(f"w{k}", F.lead("w0", k).over(w))

    def follows(a: Column, b: Column) -> Column:
        h = F.greatest(F.lit(1.0), F.col("w0.y1") - F.col("w0.y0"))
        gap = b["x0"] - a["x1"]
        return (F.abs((b["y0"] + b["y1"]) / 2 - (a["y0"] + a["y1"]) / 2) <= 0.5 * h) & gap.between(F.lit(-1.0), 0.12 * h)

    def joined(*parts: Column) -> Column:
        box = lambda f, k: F.least(*[p[k] for p in parts]) if f == "least" else F.greatest(*[p[k] for p in parts])
        return F.struct(box("least", "x0").alias("x0"), box("least", "y0").alias("y0"), box("greatest", "x1").alias("x1"), box("greatest", "y1").alias("y1"), F.concat(*[p["t"] for p in parts]).alias("t"))

    a, b, c = (F.col(f"w{k}") for k in range(3))
    lone = ~shaped(a["t"]) & b.isNotNull() & ~shaped(b["t"]) & follows(a, b)
    two = F.when(lone, joined(a, b))
    three = F.when(lone & c.isNotNull() & ~shaped(c["t"]) & follows(b, c), joined(a, b, c))
    df = df.withColumn("cand", F.explode(F.array_compact(F.array(a, two, three)))).where(shaped(F.col("cand.t")))
    score = (F.col("cand.x0") + F.col("cand.x1")) / 2 / F.col("page_w") + (F.col("cand.y0") + F.col("cand.y1")) / 2 / F.col("page_h")
    best = df.groupBy(*page).agg(F.max_by("cand", F.struct(score, -F.length("cand.t"), -F.col("ordinal"))).alias("cand"))
    return best.select(*page, T.sheet_id(F.col("cand.t")).alias("sheet_id"), "cand")
