"""Semi-structured text to rows: sections, items, fenced blocks, tolerant JSON, findings and claims."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

CATEGORIES = ("conflict", "coordination", "code", "question", "reference")
SEVERITIES = ("high", "medium", "low")
MAX_ITEMS, MAX_REFS, MAX_ACTION = 40, 20, 300
BLOCKS = "array<struct<begin:int,body:string,finish:int,lang:string,closed:boolean>>"


def sections(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, section, header, body): a header is a # heading or a line that is bold as a whole; text
    before the first has a null header. Lines are numbered, headers counted, and lines of one count joined."""
    clean = F.regexp_replace(F.col(text), "\r\n?", "\n")
    lines = docs.select(ident, F.posexplode(F.split(clean, "\n")).alias("pos", "line"))
    w = Window.partitionBy(ident).orderBy("pos")
    heading = F.regexp_extract("line", r"^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$", 1)
    bold = F.regexp_extract("line", r"^\s*\*\*(.+?)\*\*:?\s*$", 1)
    lines = lines.withColumn("head", F.when(heading != "", heading).when(bold != "", bold))
    lines = lines.withColumn("section", F.count("head").over(w))
    per = lines.groupBy(ident, "section").agg(
        F.max("head").alias("header"),
        F.btrim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n"), F.lit(" \t\n")).alias("body"),
    )
    return per.where("header IS NOT NULL OR body <> ''").withColumn("category", T.section_class(F.col("header")))


def list_items(docs: DataFrame, keys: list[str], body: str, least: int = 20) -> DataFrame:
    """Marked list items with their continuation lines; a blank line ends an item. Short and trivial items go."""
    lines = docs.select(*keys, F.posexplode(F.split(F.col(body), "\n")).alias("pos", "line"))
    marked = F.regexp_extract("line", r"^\s*(?:[-*•+]|\d+[.)])\s+(.*)$", 1)
    lines = lines.withColumn("mark", F.col("line").rlike(r"^\s*(?:[-*•+]|\d+[.)])\s+")).withColumn("blank", F.btrim("line") == "")
    w = Window.partitionBy(*keys).orderBy("pos")
    lines = lines.withColumn("item", F.sum(F.when(F.col("mark") | F.col("blank"), 1).otherwise(0)).over(w))
    text = F.when(F.col("mark"), F.btrim(marked)).otherwise(F.btrim("line"))
    per = lines.where("NOT blank").groupBy(*keys, "item").agg(F.max("mark").alias("marked"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))), lambda x: x["t"]), " ").alias("text"))
    per = per.where("marked").withColumn("text", F.btrim("text"))
    return per.where((F.length("text") >= least) & ~F.col("text").rlike(r"(?i)^\W*(none|n/?a|no (conflicts?|issues?|items?|discrepanc)|nothing)\b")).drop("marked")


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"\s+", " "), r"(?<=[.;])\s+(?=[A-Z0-9(])"), lambda x: F.length(x) > 0)


def scan_blocks(text: str) -> list[tuple[int, str, int, str, bool]]:
    """Fenced blocks, also a last one that never closes: (begin, body, finish, language, closed)."""
    out, at = [], 0
    for m in iter(lambda: re.compile(r"```([A-Za-z0-9_+-]*)[ \t]*(?:\r?\n|$)").search(text, at), None):
        close = text.find("```", m.end())
        finish = close + 3 if close >= 0 else len(text)
        out.append((m.start(), text[m.end() : close if close >= 0 else len(text)], finish, m.group(1).lower(), close >= 0))
        at = finish
        if close < 0:
            break
    return out


def _blocks(texts: pd.Series) -> pd.Series:
    names = ("begin", "body", "finish", "lang", "closed")
    return pd.Series([[dict(zip(names, b, strict=True)) for b in scan_blocks(t or "")] for t in texts], dtype=object)


def blocks(text: Column) -> Column:
    return F.pandas_udf(_blocks, BLOCKS)(text)


def repaired_json(body: str) -> str | None:
    """The outermost object as valid JSON, commas before a closing bracket dropped outside strings; else None."""
    a, b = body.find("{"), body.rfind("}")
    if a < 0 or b < a:
        return None
    raw = body[a : b + 1]
    for candidate in (raw, re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m.group(1) or "", raw)):
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        return json.dumps(value) if isinstance(value, dict) else None
    return None


def _tolerant_json(bodies: pd.Series) -> pd.Series:
    return bodies.map(repaired_json, na_action="ignore")


def tolerant_json(body: Column) -> Column:
    return F.pandas_udf(_tolerant_json, "string")(body)


FINDING = "struct<sheet_id:string,category:string,severity:string,text:string,source_quote:string,tile_label:string,refs:array<string>,anchor_hint:string,recommended_action:string>"


def parse_findings(replies: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, prose, status, items, n_dropped, n_capped): the last block that parses decides; the
    prose ends where the first block begins; invalid items are dropped and counted, never mended."""
    df = replies.withColumn("b", blocks(F.col(text)))
    jsons = df.withColumn("pos", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("b") - 1, F.lit(0))))).withColumn("blk", F.get("b", F.col("pos")))
    jsons = jsons.withColumn("j", tolerant_json(F.col("blk.body"))).withColumn("f", F.from_json(F.get_json_object("j", "$.findings"), f"array<{FINDING}>"))
    last = jsons.groupBy(ident).agg(F.max_by("f", F.when(F.col("f").isNotNull(), F.col("pos"))).alias("f"), F.bool_or(F.col("blk").isNotNull() & ~F.col("blk.closed")).alias("open"), F.max(F.size("b")).alias("n"), F.min("blk.begin").alias("cut"))
    out = replies.join(last, ident)
    fine = F.filter("f", lambda x: F.lower(F.btrim(x["category"])).isin(*CATEGORIES) & F.lower(F.btrim(x["severity"])).isin(*SEVERITIES) & (F.btrim(F.coalesce(x["text"], F.lit(""))) != ""))
    status = F.when(F.col("n") <= 0, "ABSENT").when(F.col("f").isNull() & F.col("open"), "TRUNCATED").when(F.col("f").isNull(), "MALFORMED").when(F.size("f") == 0, "EMPTY").when(F.size(fine) < F.size("f"), "PARTIAL").otherwise("OK")
    prose = F.when(F.col("cut").isNull(), F.col(text)).otherwise(F.regexp_replace(F.left(F.col(text), F.col("cut")), r"\s+$", ""))
    shaped = F.transform(F.slice(fine, 1, MAX_ITEMS), lambda x: F.struct(
        F.btrim(x["sheet_id"]).alias("sheet_id"), F.lower(F.btrim(x["category"])).alias("category"), F.lower(F.btrim(x["severity"])).alias("severity"), F.btrim(x["text"]).alias("text"),
        F.btrim(x["source_quote"]).alias("source_quote"), x["tile_label"].alias("tile_label"), F.slice(F.coalesce(x["refs"], F.array()), 1, MAX_REFS).alias("refs"), F.left(x["recommended_action"], F.lit(MAX_ACTION)).alias("recommended_action"),
    ))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return out.select(ident, prose.alias("prose"), status.alias("status"), F.coalesce(shaped, F.array()).alias("items"), F.greatest(n("f") - n(fine), F.lit(0)).alias("n_dropped"), F.greatest(n(fine) - MAX_ITEMS, F.lit(0)).alias("n_capped"))


def tile_of(label: Column, rows: Column, cols: Column) -> Column:
    """``r1c1`` counts from 1, the struct from 0; null outside the grid."""
    r, c = (F.expr("0") + F.try_to_number(F.regexp_extract(F.lower(F.btrim(label)), r"^r(\d{1,3})c(\d{1,3})$", i), F.lit("999")) - 1 for i in (1, 2))
    return F.when((r >= 0) & (r < rows) & (c >= 0) & (c < cols), F.struct(r.cast("int").alias("row"), c.cast("int").alias("col")))


def verdict(reply: Column) -> Column:
    """CONFIRMED, CONTRADICTED, NOT_VISIBLE to VERIFIED, REJECTED, UNCERTAIN; anything else is UNCERTAIN."""
    v = F.upper(F.get_json_object(reply, "$.verdict"))
    return F.when(v == "CONFIRMED", "VERIFIED").when(v == "CONTRADICTED", "REJECTED").otherwise("UNCERTAIN")


def bind_handles(reply_rows: DataFrame, manifest: DataFrame, handle: str = "handle") -> DataFrame:
    """Rows whose handle was in the request; unknown handles go."""
    norm = F.upper(F.btrim(F.col(handle)))
    return reply_rows.withColumn(handle, norm).join(manifest.withColumn(handle, norm), handle)
