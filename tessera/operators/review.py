"""Review run operators: limits, listings, joins to page geometry, prose conflicts, placement, accounting texts and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# Limits, words and factors that decide results.
MAX_SHEETS, MAX_FILES, MAX_PAGE_PT = 2000, 500, 20_000.0
CONFLICT_WORDS = ("conflict", "contradic", "disagree", "mismatch", "discrepan", "inconsist", "differs", "diverg", "does not match", "doesn't match", "stale")
TRUSTED = ("VERIFIED", "DETERMINISTIC")
TERMINAL = ("VERIFIED", "REJECTED", "DETERMINISTIC")
LEADER_STOPS = (0.15, 0.3, 0.45, 0.6, 0.75, 0.9)
GROUNDED_MIN, MAX_FACTS, MAX_CLAIMS = 6, 40, 40
CLAIM_KINDS = ("sum", "product", "factor")
NUL = "\0"


# --- limits and listings


def page_fits(width: Column, height: Column, most: float = MAX_PAGE_PT) -> Column:
    """Both sides finite, positive and within the bound; null does not fit."""
    side = lambda c: ~F.isnan(c) & (c > 0) & (c <= most)
    return F.coalesce(side(width) & side(height), F.lit(False))


def set_limits(files: DataFrame, key: str, pages: str, confirmed: Column, max_files: int = MAX_FILES, max_sheets: int = MAX_SHEETS) -> DataFrame:
    """One row a set: files, sheets and what blocks it: FILES before SHEETS, null within bounds or once confirmed."""
    per = files.groupBy(key).agg(F.count("*").alias("files"), F.coalesce(F.sum(pages), F.lit(0)).cast("long").alias("sheets"), F.bool_or(confirmed).alias("confirmed"))
    why = F.when(F.col("confirmed"), None).when(F.col("files") > max_files, "FILES").when(F.col("sheets") > max_sheets, "SHEETS")
    return per.select(key, "files", "sheets", why.alias("blocked_by"))


def lacks_room(needed: Column, free: Column) -> Column:
    """Whether a run must not start; an unknown free space never blocks."""
    return F.coalesce(free < needed, F.lit(False))


def list_pages(files: DataFrame, pages: str) -> DataFrame:
    """A row for each page of each file, page_index from 0; a file without pages has none."""
    return files.where(F.col(pages) > 0).withColumn("page_index", F.explode(F.sequence(F.lit(0), (F.col(pages) - 1).cast("int")))).drop(pages)


def kept_and_omitted(rows: DataFrame, key: str, keep: Column) -> DataFrame:
    """What a filter keeps and leaves out, told per key; a null condition leaves out."""
    return rows.groupBy(key).agg(F.count_if(keep).alias("kept"), F.count_if(~F.coalesce(keep, F.lit(False))).alias("omitted"))


# --- joins to pages


def with_page(rows: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with its page's columns, null where the page is unknown. Keys of ``pages`` are unique."""
    return rows.join(pages, keys, "left")


def with_page_or_sheet(rows: DataFrame, pages: DataFrame, keys: list[str], sheet: str, order: str, carry: str) -> DataFrame:
    """The page by key, else the first page (by ``order``) that bears the row's sheet id."""
    by_key = pages.select(*keys, F.col(carry).alias("__by_key"))
    by_sheet = pages.where(F.col(sheet) != "").groupBy(sheet).agg(F.min_by(carry, order).alias("__by_sheet"))
    out = rows.join(by_key, keys, "left").join(by_sheet, sheet, "left")
    return out.withColumn(carry, F.coalesce("__by_key", "__by_sheet")).drop("__by_key", "__by_sheet")


def late_facts(base: DataFrame, arrivals: DataFrame, keys: list[str], fact: str, order: str) -> DataFrame:
    """``base`` with a fact that later rows state: the last stated one counts, null states nothing."""
    last = arrivals.where(F.col(fact).isNotNull()).groupBy(*keys).agg(F.max_by(fact, order).alias("__late"))
    return base.join(last, keys, "left").withColumn(fact, F.coalesce("__late", fact)).drop("__late")


def title_band(words: DataFrame, ids: DataFrame, keys: list[str], share: float = 0.18) -> DataFrame:
    """Words whose centre lies in the title-block band: right of the sheet id's left edge less a share of the page's width."""
    left = ids.where("page_w > 0").select(*keys, (F.col("id_x0") - share * F.col("page_w")).alias("__left"), "own_id")
    out = words.join(left, keys).where(((F.col("x0") + F.col("x1")) / 2 >= F.col("__left")) & (F.upper(F.btrim("text")) != F.col("own_id")))
    return out.drop("__left", "own_id")


def suggested_profiles(profiles: DataFrame, sheets: DataFrame, sheet: str) -> DataFrame:
    """Profiles that name a discipline of the set, by an equi join on the discipline."""
    hints = sheets.select(T.discipline(F.col(sheet)).alias("d")).where("d <> ''").distinct()
    named = profiles.select("name", F.explode("disciplines").alias("d")).join(hints, "d", "left_semi").select("name").distinct()
    return profiles.join(named, "name", "left_semi")


# --- prose and claims

ID_RUN = r"[A-Z0-9]+(?:[.\-][A-Z0-9]+)*"


def mentions(items: DataFrame, ident: str, text: str, ids: DataFrame, sheet: str) -> DataFrame:
    """Sheet ids that an item names as whole words: ident, ids in order of first mention.

    An id is a run of letters and digits joined by ``.`` or ``-``, so ``A-1`` is not met inside ``A-10`` or
    ``A-1.1``: the item's runs are joined to the ids instead of searching every id in every item."""
    runs = items.select(ident, F.posexplode(F.regexp_extract_all(F.upper(F.col(text)), F.lit(f"({ID_RUN})"), F.lit(1))).alias("at", "id"))
    first = runs.groupBy(ident, "id").agg(F.min("at").alias("at"))
    met = first.join(ids.select(F.upper(sheet).alias("id")).distinct(), "id", "left_semi")
    return met.groupBy(ident).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("ids"))


def conflicts(items: DataFrame, ident: str, text: str, ids: DataFrame, sheet: str) -> DataFrame:
    """Items with a word of conflict: scope SOURCE with the ids that they name, or SET if they name none."""
    hot = items.where(F.lower(text).rlike("|".join(CONFLICT_WORDS)))
    out = hot.join(mentions(hot, ident, text, ids, sheet), ident, "left")
    return out.withColumn("scope", F.when(F.col("ids").isNull(), "SET").otherwise("SOURCE")).withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))


def prose_item_id(channel: Column, source: Column, page: Column, section: Column, ordinal: Column, text: Column) -> Column:
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    payload = F.concat(*[x for c in (channel, source, page, section, ordinal) for x in (part(c), F.lit(NUL))], part(text))
    return F.concat(F.lit("PI-"), F.left(F.sha1(payload.cast("binary")), F.lit(12)))


def grounded(quote: Column, text: Column) -> Column:
    """Whether a quote stands in the text, folding dashes, case and white space; one under six characters always does."""
    plain = lambda c: T.squash(T.fold(c))
    return (F.length(plain(quote)) < GROUNDED_MIN) | F.contains(plain(text), plain(quote))


def bound_facts(facts: DataFrame, sheets: DataFrame, request: str, order: str, most: int = MAX_FACTS) -> DataFrame:
    """Facts of known handles whose quote is not blank and stands on that sheet: the first ``most`` of a request, in order.

    ``facts``: request, order, handle, quote; ``sheets``: handle, text."""
    on = facts.withColumn("handle", F.upper(F.btrim("handle"))).join(sheets.select("handle", F.col("text").alias("__text")), "handle")
    fine = on.where((F.btrim("quote") != "") & grounded(F.col("quote"), F.col("__text"))).drop("__text")
    kept = fine.groupBy(request).agg(F.slice(F.array_sort(F.collect_list(F.struct(order, "handle", "quote"))), 1, most).alias("f"))
    return kept.select(request, F.explode("f").alias("f")).select(request, "f.*")


def numeric_claims(objects: DataFrame, ident: str, json: str, fallback: Column, most: int = MAX_CLAIMS) -> DataFrame:
    """(ident, JSON object) -> its valid claims, ``most`` at most: known kind, a list of scalar terms, a scalar expected.

    Terms and expected stay raw text; true and false are no numbers; a claim without a sheet gets ``fallback``."""
    scalar = lambda raw: raw.rlike(r'^\s*(?:-?\d|")')
    own = objects.withColumn("__f", fallback).select(ident, "__f", F.posexplode(F.from_json(F.get_json_object(json, "$.claims"), "array<string>")).alias("pos", "c"))
    get = lambda f: F.get_json_object("c", f"$.{f}")
    own = own.select(ident, "pos", "__f", get("sheet_id").alias("sheet_id"), get("quote").alias("quote"), F.lower(F.btrim(get("kind"))).alias("kind"), F.from_json(get("terms"), "array<string>").alias("terms"), get("expected").alias("expected"), get("terms").alias("raw"), F.regexp_extract("c", r'"expected"\s*:\s*([^,}\]]+|"(?:[^"\\]|\\.)*")', 1).alias("raw_expected"))
    fine = own.where(F.col("kind").isin(*CLAIM_KINDS) & F.col("raw").startswith("[") & (F.size("terms") > 0) & ~F.col("raw").rlike(r"[\[,]\s*(?:true|false|null|\{|\[.)") & scalar(F.col("raw_expected")))
    sheet = F.when(F.btrim(F.coalesce("sheet_id", F.lit(""))) == "", F.col("__f")).otherwise(F.btrim("sheet_id"))
    kept = fine.groupBy(ident).agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", sheet.alias("sheet_id"), F.coalesce("quote", F.lit("")).alias("quote"), "kind", "terms", "expected"))), 1, most).alias("c"))
    return kept.select(ident, F.explode("c").alias("c")).select(ident, "c.*")


def merged_editions(identity: DataFrame, harvested: DataFrame, key: str) -> DataFrame:
    """The identity's codes in order, then harvested ones that it does not name, joined by ``"; "``.

    ``identity``: key, ord, display, note; ``harvested``: key, ord, code."""
    plain = lambda c: F.upper(F.btrim(F.regexp_replace(c, r"\s+", " ")))
    lead = identity.where("display <> ''")
    said = lead.select(key, F.lit(0).alias("g"), "ord", F.when(F.coalesce("note", F.lit("")) != "", F.concat("display", F.lit(" ("), "note", F.lit(")"))).otherwise(F.col("display")).alias("t"))
    extra = harvested.withColumn("p", plain(F.col("code"))).join(lead.select(key, plain(F.col("display")).alias("p")).distinct(), [key, "p"], "left_anti")
    every = said.unionByName(extra.select(key, F.lit(1).alias("g"), "ord", F.col("code").alias("t")))
    return every.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "ord", "t"))), lambda x: x["t"]), "; ").alias("editions"))


# --- placement


def trusted_enough(status: Column, include_unverified: Column) -> Column:
    return (F.coalesce(status, F.lit("")) != "REJECTED") & (F.coalesce(status, F.lit("")).isin(*TRUSTED) | include_unverified)


def disposition(status: Column, anchored: Column, include_unverified: Column) -> Column:
    """rejected, cloud (with a rectangle), margin (without) or gated."""
    rejected = F.coalesce(status, F.lit("")) == "REJECTED"
    return F.when(rejected, "rejected").when(~trusted_enough(status, include_unverified), "gated").when(anchored, "cloud").otherwise("margin")


def placement_kind(status: Column, anchored: Column, include_unverified: Column, ink_rejected: Column) -> Column:
    d = disposition(status, anchored, include_unverified)
    inked = F.when(anchored, "CLOUD").otherwise("MARGIN")
    return F.when(d.isin("cloud", "margin"), inked).when(d == "gated", "GATED_INDEX").when(ink_rejected, inked).otherwise("REJECTED_INDEX")


def leg_id(source_id: Column, source_name: Column, page: Column, quote: Column, index: Column) -> Column:
    payload = F.concat(*[x for c in (source_id, source_name, page.cast("string"), quote) for x in (c, F.lit(NUL))])
    return F.concat(F.format_string("leg-%02d-", index.cast("int")), F.left(F.sha1(payload.cast("binary")), F.lit(8)))


def placement_id(run: Column, finding: Column, leg: Column, ordinal: Column) -> Column:
    return F.concat(run, F.lit("#"), finding, F.lit("#"), leg, F.lit("#"), F.lpad(ordinal.cast("string"), 5, "0"))


def has_anchored_legs(anchored: Column, legs: Column) -> Column:
    """``legs``: array of booleans, whether each other leg has a rectangle."""
    return anchored & F.coalesce(F.exists(legs, lambda x: x), F.lit(False))


def verifiable(status: Column, anchored: Column, legs: Column) -> Column:
    """Anchored, not settled and not checked leg by leg."""
    return ~F.coalesce(status, F.lit("")).isin(*TERMINAL) & anchored & ~has_anchored_legs(anchored, legs)


def crosses(x0: Column, y0: Column, x1: Column, y1: Column, box: tuple[Column, ...]) -> Column:
    """Whether a leader passes through a box, at one of six places along it."""
    a, b, c, d = box
    aside = ((x0 < a) & (x1 < a)) | ((x0 > c) & (x1 > c)) | ((y0 < b) & (y1 < b)) | ((y0 > d) & (y1 > d))
    inside = lambda t: (x0 + (x1 - x0) * t).between(a, c) & (y0 + (y1 - y0) * t).between(b, d)
    return ~aside & F.exists(F.array(*[F.lit(t) for t in LEADER_STOPS]), inside)


# --- cells and texts


def scope(hint: Column, source_id: Column) -> Column:
    set_ = F.upper(F.coalesce(hint, F.lit(""))).isin("SET", "SET_INDEX") & (F.coalesce(source_id, F.lit("")) == "")
    return F.when(set_, "SET").otherwise("SOURCE")


def legs_cell(legs: Column) -> Column:
    """``sheet: "quote"`` for each leg (sheet_id, source_quote), joined by ``"; "``; empty legs go."""

    def cell(leg: Column) -> Column:
        sheet, quote = (F.btrim(F.coalesce(leg[c], F.lit(""))) for c in ("sheet_id", "source_quote"))
        return F.when(quote != "", F.concat(sheet, F.lit(': "'), quote, F.lit('"'))).otherwise(sheet)

    return F.array_join(F.filter(F.transform(legs, cell), lambda x: x != ""), "; ")


def tile_cell(tile: Column) -> Column:
    return F.when(tile["row"].isNotNull() & tile["col"].isNotNull(), F.concat_ws(",", tile["row"], tile["col"])).otherwise("")


def rect_cell(rect: Column) -> Column:
    """Four numbers to one place, ties to the even digit; anything else is empty."""
    return F.when(F.size(rect) == 4, F.array_join(F.transform(rect, lambda v: F.format_string("%.1f", F.bround(v, 1))), ", ")).otherwise("")


def identity_line(jurisdiction: Column, region: Column, country: Column, language: Column, units: Column) -> Column:
    """Where, language and units in one line; what is empty or null is left out."""
    full = lambda c: F.when(c != "", c)
    where = F.coalesce(full(jurisdiction), full(F.concat_ws(", ", full(region), full(country))))
    return F.concat_ws("; ", where, F.concat(F.lit("language "), full(language)), F.concat(F.lit("units "), full(units)))


def identity_block(disciplines: Column, project: Column, set_type: Column, where: Column, confidence: Column) -> Column:
    """The set's identity, a line for each known fact."""
    full = lambda c: F.when(c != "", c)
    what = F.when(full(project).isNotNull() & full(set_type).isNotNull(), F.concat(project, F.lit(" ("), set_type, F.lit(")"))).otherwise(F.coalesce(full(project), full(set_type)))
    named = F.when(F.size(disciplines) > 0, F.concat(F.lit("- Disciplines: "), F.array_join(disciplines, ", ")))
    line = lambda head, c: F.concat(F.lit(f"- {head}: "), c)
    return F.concat_ws("\n", F.lit("SET IDENTITY (model-detected):"), named, line("Project", what), line("Jurisdiction", full(where)), line("Detection confidence", full(confidence)))


def combined_document(sheets: DataFrame, key: str, order: str) -> DataFrame:
    """One text a set: a header for each sheet in order (label, text, error), and a failure told where a sheet has an error.

    A set's texts meet in one row, as one document is what is asked for."""
    n = F.struct(order, "label", "text", "error")
    per = sheets.groupBy(key).agg(F.array_sort(F.collect_list(n)).alias("s"))

    def part(x: Column, i: Column) -> Column:
        head = F.concat(F.lit("## Sheet "), (i + 1).cast("string"), F.lit("/"), F.size("s").cast("string"), F.lit(": "), x["label"])
        body = F.when(F.coalesce(x["error"], F.lit("")) != "", F.concat(F.lit("> [analysis failed for this sheet: "), x["error"], F.lit("]"))).otherwise(F.btrim(F.coalesce(x["text"], F.lit(""))))
        return F.concat(head, F.lit("\n\n"), body, F.lit("\n\n---"))

    return per.select(key, F.size("s").cast("long").alias("sheets"), F.array_join(F.transform("s", part), "\n\n").alias("document"))


def inert_json(value: Column) -> Column:
    """JSON that cannot close the element of a page that holds it."""
    return F.replace(F.to_json(value), F.lit("<"), F.lit("\\u003c"))


def contained(path: Column) -> Column:
    """Whether a relative path stays under its root at every step; an absolute one does not."""
    steps = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, x: F.struct(
        (a["d"] + F.when(x == "..", -1).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(x == "..", -1).otherwise(1)).alias("low")))
    return ~path.startswith("/") & (depth["low"] >= 0)


# --- accounting


def transport(cached: Column, rescued: Column, batch: Column) -> Column:
    return F.when(cached, "CACHE").when(rescued, "REAL_TIME").when(batch, "BATCH").otherwise("REAL_TIME")


def safe_estimate(tokens: Column, model: Column, factors: dict[str, str], default: str) -> Column:
    """Local token counts padded by the model's factor (decimal texts, 1 at least), rounded up."""
    table = F.create_map(*[F.lit(x) for m, f in factors.items() for x in (m, f)])
    factor = F.greatest(F.lit(1).cast("decimal(6,3)"), F.coalesce(F.try_element_at(table, model), F.lit(default)).cast("decimal(6,3)"))
    return F.ceil(tokens.cast("decimal(18,0)") * factor).cast("long")


def due(last: Column, now: Column, days: int) -> Column:
    """Whether a periodic check is due: never done, or ``days`` ago at least."""
    return last.isNull() | (F.unix_micros(now) - F.unix_micros(last) >= days * 86_400_000_000)


def admitted(rows: DataFrame, kind: str, schema: int, stage: Column) -> DataFrame:
    """Cache rows (entry: JSON text) fit to be read: whole JSON of this kind, schema and stage with an object as payload."""
    get = lambda f: F.get_json_object("entry", f"$.{f}")
    fine = (get("_kind") == kind) & (get("_schema") == str(schema)) & (get("stage") == stage) & get("payload").startswith("{")
    return rows.where(F.coalesce(fine, F.lit(False))).withColumn("payload", get("payload")).drop("entry")


def migrated(rows: DataFrame, key: str, json: str, version: int) -> DataFrame:
    """Old JSON entries that parse and are of this version, as (key, value); others go."""
    get = lambda f: F.get_json_object(json, f"$.{f}")
    return rows.where(get("k").isNotNull() & (get("v").isNull() | (get("v") == str(version)))).select(key, get("k").alias("value"))


def combine(parts: dict[str, DataFrame], ident: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """All parts' rows tagged by part, of equal ids the first part's (then the smallest row), and a count a part."""
    tagged = [df.select(ident, *columns).withColumn("part_no", F.lit(i)).withColumn("part", F.lit(name)) for i, (name, df) in enumerate(parts.items())]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    one = every.groupBy(ident).agg(F.min(F.struct("part_no", "part", *columns)).alias("x")).select(ident, "x.part", *[F.col(f"x.{c}") for c in columns])
    return one, every.groupBy("part").agg(F.count("*").alias("found"))


def next_leg(legs: DataFrame, key: str, leg: str) -> DataFrame:
    return legs.groupBy(key).agg((F.max(leg) + 1).alias("next_leg"))


def evidence_hash(kind: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A digest of a request for evidence; rectangles count to two places."""
    return F.sha2(F.concat_ws("|", kind, *[F.format_string("%.2f", F.bround(c, 2)) for c in (x0, y0, x1, y1)]), 256)


def starter_prompts(candidates: DataFrame, key: str, most: int = 5) -> DataFrame:
    """(key, priority, prompt) -> the first ``most`` distinct prompts of each key by priority, then text."""
    one = candidates.groupBy(key, "prompt").agg(F.min("priority").alias("priority"))
    top = one.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("priority", "prompt"))), 1, most).alias("p"))
    return top.select(key, F.posexplode("p").alias("pos", "p")).select(key, (F.col("pos") + 1).cast("long").alias("place"), "p.prompt")


# --- report tables


def page_link(path: Column, page_index: Column) -> Column:
    """A link to a page of a written file, counted from 1; empty without a file."""
    return F.when(path.isNull(), "").otherwise(F.concat(path, F.lit("#page="), (page_index + 1).cast("string")))


def sorted_places(rows: DataFrame, key: str, original: str, sorts: dict[str, tuple[Column, int]]) -> DataFrame:
    """Each row's place under several sorts of its key's table (value, 1 up or -1 down); equal values keep the original order."""
    place = lambda v, way: F.row_number().over(Window.partitionBy(key).orderBy(v.asc() if way > 0 else v.desc(), F.col(original)))
    return rows.select("*", *[place(v, way).alias(name) for name, (v, way) in sorts.items()])


def channels(parts: dict[str, DataFrame]) -> DataFrame:
    """All rows of all channels, tagged with their source; columns that a channel lacks are null."""
    out = None
    for name, df in parts.items():
        one = df.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def sheet_status(calls: DataFrame, key: str) -> DataFrame:
    """(key, tokens, failed, cached) a call -> a row a sheet: OK, PARTIAL or FAILED, tokens, whether all came from the cache, calls."""
    per = calls.groupBy(key).agg(F.sum("tokens").cast("long").alias("tokens"), F.count_if("failed").alias("bad"), F.bool_and("cached").alias("cached"), F.count("*").alias("calls"))
    status = F.when(F.col("bad") == F.col("calls"), "FAILED").when(F.col("bad") > 0, "PARTIAL").otherwise("OK")
    return per.select(key, status.alias("status"), "tokens", "cached", "calls")


def manifest(row: Column) -> Column:
    """A run's accounting as JSON, its texts without secrets."""
    return T.redact(F.to_json(row, {"ignoreNullFields": "false"}))
