"""Text functions over columns: folding, identifiers, tags, token sets, editions, redaction.

Everything is built from SQL functions; ``nfkc`` alone needs Python (Spark has no normalisation).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters, words and patterns whose exact set decides results.
DASHES = "‐‑‒–—―−﹘﹣－"
INVISIBLE = "\u00ad\u200b\u200c\u200d\ufeff"
EDGE_MARKS = " \t\r\n\"'`.,;:()[]{}<>#/\\|*"
STOP_WORDS = "a an and any are as at be been but by for found from has have in into is it its no not of on or shown so that the then there this to was were with".split()
STANDARD_BODIES = "NFPA IBC IFC IRC IPC IMC IECC IFGC ASHRAE ASME ASTM ANSI UL FM IEEE NEC NEMA SMACNA AWWA AISC ACI AWS OSHA ADA ICC CBC CFC CMC CPC T24 TITLE24".split()
TRANSMITTALS = "RFI ASI PR CO CCD SK SI PCO COR SUB ADD BUL".split()
ID_SHAPES = (
    r"^[A-Za-z]{1,6}[0-9]{0,3}(?:-[A-Za-z0-9]{1,6}){1,6}$",
    r"^[A-Za-z]{1,3}[0-9]{1,4}$",
    r"^[A-Za-z]{1,3}[0-9]{1,3}(?:\.[0-9]{1,3})+$",
)
CODE = r"(?:NFPA\s*\d+[A-Z]?|CBC|CFC|CMC|CPC|CEC|IBC|IFC|IMC|IPC|UPC|UMC|ASCE\s*\d+|ASME\s*[A-Z]?[\d.]+|UL\s*\d+|FM\s*\d+)"
YEAR = r"(?:19|20)\d{2}"
TAG = r"\b([A-Za-z]{1,4})-?(\d{1,4}(?:[.-]\d{1,3})?[A-Za-z]?)\b"
ABSENCE = r"(?i)\b(?:not\s+(?:shown|provided|indicated|dimensioned|specified|scheduled|noted|labell?ed|called|located|found|present)|should\s+be\s+(?:shown|provided|indicated|dimensioned|added|included|scheduled|noted)|(?:is\s+)?required\s+but|missing|omitted|absent|no\s+\w+(?:\s+\w+)?\s+(?:shown|provided|indicated|dimensioned))\b"
MEASURE = r"""(?i)(?<![A-Za-z0-9.\-])([-+]?\d+(?:\.\d+)?(?:[-\s]*\d+\s*/\s*\d+)?)\s*((?:gpm|gpd|gph|psig|psi|cfm|fpm|inch(?:es)?|in|ft|feet|mm|cm|kva|kw|hp|hz|amps?|volts?|kv|va|gal|deg)\b|(?:°[fc]?|%|"|'))"""
UNIT_SYNONYMS = {"inches": "in", "inch": "in", "feet": "ft", '"': "in", "'": "ft"}
SECTION_WORDS = (
    ("focus", "focus"),
    ("conflict", "conflict|inconsist|discrepan|mismatch|disagree|contradic|never drawn|never shown|but not|missing"),
    ("coordination", "coordinat|cross-discipline|cross discipline|cross-sheet|cross sheet|penetration|shared chase|another discipline|another trade|spanning sheets|tag cross"),
    ("equipment", "equipment|schedule|fixture"),
    ("dimensions", "dimension|elevation|clearance|slope|size|pipe|duct|capacity"),
    ("notes", "note|keynote|callout|legend|abbreviation"),
    ("scope", "scope|system|plan content|spaces|rooms|set-wide|set wide|discipline"),
)


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Unicode NFKC; null stays null."""
    return F.pandas_udf(_nfkc, "string")(text)


def fold(text: Column, compatibility: bool = False) -> Column:
    """Unicode dashes become '-', invisible characters go; with ``compatibility`` after NFKC."""
    t = nfkc(F.coalesce(text, F.lit(""))) if compatibility else F.coalesce(text, F.lit(""))
    return F.translate(t, DASHES + INVISIBLE, "-" * len(DASHES))


def sheet_id(text: Column, compatibility: bool = False) -> Column:
    """An identifier's normal form: folded, edge marks trimmed, upper case. O and 0 stay apart."""
    return F.upper(F.btrim(fold(text, compatibility), F.lit(EDGE_MARKS)))


def looks_like_sheet_id(text: Column) -> Column:
    t = sheet_id(text)
    shape = t.rlike(ID_SHAPES[0]) | t.rlike(ID_SHAPES[1]) | t.rlike(ID_SHAPES[2])
    return (t != "") & t.rlike("[0-9]") & shape


def bubble_target(text: Column) -> Column:
    """The identifier in a detail bubble ``NN/ID``, else null."""
    target = F.regexp_extract(F.btrim(text), r"^\d{1,3}\s*/\s*([A-Za-z0-9][A-Za-z0-9.\-]*)$", 1)
    return F.when((target != "") & looks_like_sheet_id(target), target)


def id_signature(text: Column) -> Column:
    """Structure of an identifier: ``A<n>`` for n letters, ``D`` for digits, separators kept; null if malformed."""
    t = sheet_id(text)
    runs = F.regexp_extract_all(t, F.lit("([A-Za-z]+|[0-9]+|[-.])"), F.lit(1))
    kinds = F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lit("D")).when(r.rlike("^[-.]"), r).otherwise(F.concat(F.lit("A"), F.length(r).cast("string"))))
    fine = (F.array_join(runs, "") == t) & t.rlike("[A-Za-z0-9]") & ~t.rlike(r"^[-.]|[-.]$|[-.][-.]")
    return F.when(fine, F.array_join(kinds, " "))


def discipline(text: Column) -> Column:
    """One to three leading letters of the first segment that is not a project prefix, lower case."""
    parts = F.filter(F.split(sheet_id(text), "[-.]"), lambda x: x != "")
    first = F.regexp_extract(F.coalesce(F.get(parts, F.lit(0)), F.lit("")), "^[A-Za-z]+", 0)
    second = F.regexp_extract(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "^[A-Za-z]+", 0)
    prefix = (F.length(first) >= 3) & F.coalesce(F.get(parts, F.lit(0)).rlike("[0-9]"), F.lit(False)) & (second != "")
    return F.lower(F.left(F.when(prefix, second).otherwise(first), F.lit(3)))


def is_non_sheet(text: Column) -> Column:
    """Standards bodies, transmittals, voltages and bare dimensions are no references to sheets."""
    t = sheet_id(text)
    lead = F.regexp_extract(t, "^[A-Za-z]+", 0)
    head = F.substring_index(F.substring_index(t, "-", 1), ".", 1)
    return (t == "") | lead.isin(STANDARD_BODIES) | head.isin(TRANSMITTALS + STANDARD_BODIES) | t.rlike(r"^\d{2,4}(?:/\d{2,4})?V$") | ((lead == "") & t.rlike(r"^\d"))


def is_tag(text: Column) -> Column:
    t = F.btrim(text)
    return F.length(t).between(2, 12) & t.rlike("^[A-Za-z0-9]+(?:[-/][A-Za-z0-9]+)*$") & t.rlike("[A-Za-z]") & t.rlike("[0-9]")


def tag_key(tag: Column) -> Column:
    """Letters in order and digits in order: spellings of one item share it."""
    return F.concat(F.upper(F.regexp_replace(tag, r"[^\p{L}]", "")), F.lit("|"), F.regexp_replace(tag, r"[^\p{Nd}]", ""))


def squash(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def token_set(text: Column) -> Column:
    """Distinct lower-case alphanumeric tokens without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOP_WORDS]))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets; 0 where either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def equipment_tags(text: Column) -> Column:
    a, b = (F.regexp_extract_all(text, F.lit(TAG), F.lit(i)) for i in (1, 2))
    return F.array_distinct(F.zip_with(a, b, lambda x, y: F.replace(F.upper(F.concat(x, y)), F.lit("-"), F.lit(""))))


def measurements(text: Column) -> Column:
    number, unit = (F.regexp_extract_all(text, F.lit(MEASURE), F.lit(i)) for i in (1, 2))
    synonym = F.create_map(*[F.lit(x) for kv in UNIT_SYNONYMS.items() for x in kv])
    plain = lambda x: F.replace(F.regexp_replace(x, r"(?<=\d)[-\s]+(?=\d)", ""), F.lit(" "), F.lit(""))
    return F.array_distinct(F.zip_with(number, unit, lambda n, u: F.concat(plain(n), F.coalesce(F.try_element_at(synonym, F.lower(u)), F.lower(u)))))


def says_absent(text: Column) -> Column:
    return text.rlike(ABSENCE)


def editions(text: Column, basis_only: bool = False) -> Column:
    """``CODE YEAR`` claims in order of appearance, distinct; ``basis_only`` leaves out section citations."""
    after = r"(?!\s*(?:§|sec(?:tion|\.)?\s*\d))" if basis_only else ""
    pattern = rf"(?i)(\b{CODE}[\s,()–-]{{0,4}}{YEAR}\b|\b{YEAR}[\s,()–-]{{0,4}}{CODE}\b)" + after
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    year = lambda x: F.regexp_extract(x, rf"(?:^({YEAR})|({YEAR})$)", 0)
    code = lambda x: F.btrim(F.regexp_replace(F.regexp_extract(F.upper(x), CODE, 0), r"\s+", " "))
    return F.array_distinct(F.transform(found, lambda x: F.concat(code(x), F.lit(" "), year(x))))


def section_class(header: Column) -> Column:
    """First class, in order of priority, one of whose words the header holds."""
    low = F.lower(F.coalesce(header, F.lit("")))
    out = F.when(low == "", F.lit("other"))
    for name, words in SECTION_WORDS:
        out = out.when(low.rlike(words), F.lit(name))
    return out.otherwise(F.lit("other"))


def redact(text: Column, fields: str = "authorization|x-api-key|api[_-]?key|token|secret|password") -> Column:
    """Key prefixes, bearer tokens and named secret fields become [REDACTED]."""
    t = F.regexp_replace(text, r"\bsk-[A-Za-z0-9_\-]{8,}", "sk-[REDACTED]")
    t = F.regexp_replace(t, r"(?i)\bbearer\s+[A-Za-z0-9._~+/\-]+=*", "Bearer [REDACTED]")
    return F.regexp_replace(t, r"(?i)\b(" + fields + r""")\b(["']?\s*[:=]\s*["']?)([^\s"',;&)\]}]+)""", r"$1$2[REDACTED]")


def scrub_paths(text: Column) -> Column:
    """Absolute paths shrink to their last part; web addresses stay."""
    t = F.regexp_replace(text, r"\b[A-Za-z]:\\(?:[^\\\s\"']+\\)*([^\\\s\"']+)", r".../$1")
    return F.regexp_replace(t, r"(?<![\w:/.])/(?:[^/\s\"'<>]+/)+([^/\s\"'<>]+)", r".../$1")


def sanitize(text: Column, limit: int = 300) -> Column:
    """One line, redacted before it is cut, so that no half of a secret survives."""
    one = F.btrim(F.regexp_replace(text, r"\s+", " "))
    bare = F.when(one.contains("</") | one.contains("/>"), F.btrim(F.regexp_replace(F.regexp_replace(one, "<[^>]*>", " "), r"\s+", " "))).otherwise(one)
    t = scrub_paths(redact(bare))
    return F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit("... [+"), (F.length(t) - limit).cast("string"), F.lit(" chars]"))).otherwise(t)


def capped(text: Column, limit: int = 15_000, marker: str = "\n[truncated]") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(marker))).otherwise(text)


def csv_safe(text: Column) -> Column:
    """A leading formula character is defused by a quote."""
    return F.when(text.rlike(r"^[\s\x00]*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def version_key(text: Column) -> Column:
    """``MAJOR.MINOR.PATCH[rcN]`` as a comparable struct; a final release is above its candidates."""
    part = lambda i: F.regexp_extract(text, r"^v?(\d+)\.(\d+)\.(\d+)(?:rc(\d+))?$", i)
    num = lambda i: F.when(part(i) != "", part(i).cast("int"))
    return F.struct(num(1).alias("major"), num(2).alias("minor"), num(3).alias("patch"), F.coalesce(num(4), F.lit(1 << 30)).alias("candidate"))


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping, case-insensitive occurrences."""
    t, n = F.lower(text), F.lower(needle)
    return F.when(F.length(n) == 0, F.lit(0)).otherwise(((F.length(t) - F.length(F.replace(t, n, F.lit("")))) / F.length(n)).cast("int"))


def safe_url(url: Column) -> Column:
    return url.rlike(r"^https://[^\s/?#]+")


CHIPS = ("prose", "json", "critique", "cross", "synthesis", "auditor", "focus")


def provenance(sources: Column) -> Column:
    """Ordered chips of a finding's sources, unknown ones behind; two critique reads show as one chip."""
    tags = F.array_distinct(sources)
    reads = F.size(F.filter(tags, lambda t: t.isin("critique_1", "critique_2")))
    has = lambda *names: F.arrays_overlap(tags, F.array(*[F.lit(n) for n in names]))
    chips = [
        F.when(has("digest_prose_coordination", "digest_prose_conflict"), F.lit("prose")), F.when(has("digest_json"), F.lit("json")),
        F.when(reads >= 2, F.lit("critique×2")).when(reads == 1, F.lit("critique")), F.when(has("cross_qc"), F.lit("cross")),
        F.when(has("synthesis_prose"), F.lit("synthesis")), F.when(F.exists(tags, lambda t: t.startswith("auditor_")), F.lit("auditor")),
        F.when(has("focus_prose"), F.lit("focus")),
    ]
    known = ("critique_1", "critique_2", "digest_json", "digest_prose_coordination", "digest_prose_conflict", "cross_qc", "synthesis_prose", "focus_prose")
    extra = F.filter(tags, lambda t: ~t.isin(*known) & ~t.startswith("auditor_"))
    return F.array_join(F.concat(F.array_compact(F.array(*chips)), extra), "+")
