"""Numbers, tolerances, rectangles, grids and costs over columns. No division decides a comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "decimal(30,10)"  # a sum of two keeps all ten places
# Tolerances and thresholds that decide results.
REL_TOL, ABS_FLOOR, HIGH_REL, MEDIUM_REL = "0.01", "0.01", "0.10", "0.03"


def _dec(x: str) -> Column:
    return F.lit(x).cast(NUMBER)


def parse_number(text: Column) -> Column:
    """Exact decimal from thousands commas, mixed and simple fractions, or a leading number; else null."""
    s = F.regexp_replace(F.btrim(text), r"(?<=\d),(?=\d{3}(?:\D|$))", "")
    part = lambda p, i: F.regexp_extract(s, p, i)
    num = lambda c: F.when(c != "", c.cast(NUMBER))
    mixed, simple, plain = r"^([-+]?)(\d+)[\s\-]+(\d+)\s*/\s*(\d+)", r"^([-+]?)(\d+)\s*/\s*(\d+)", r"^([-+]?(?:\d+(?:\.\d+)?|\.\d+))"
    signed = lambda p, v: F.when(part(p, 1) == "-", -v).otherwise(v)
    # the quotient's scale follows the divisor's precision, so whole numbers are divided as such
    whole = lambda c, p: F.when(c != "", c.cast(f"decimal({p},0)"))
    frac = lambda a, b: F.try_divide(whole(a, 18), whole(b, 12)).cast(NUMBER)
    return (
        F.when(s.rlike(mixed), signed(mixed, num(part(mixed, 2)) + frac(part(mixed, 3), part(mixed, 4))))
        .when(s.rlike(simple), signed(simple, frac(part(simple, 2), part(simple, 3))))
        .when(s.rlike(plain), num(part(plain, 1)))
        .cast(NUMBER)
    )


def numbers_in(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"([-+]?\d+[\s-]+\d+\s*/\s*\d+|[-+]?\d+\s*/\s*\d+|[-+]?\d[\d,]*(?:\.\d+)?)"), F.lit(1))
    return F.array_compact(F.transform(found, parse_number))


def computed(kind: Column, terms: Column) -> Column:
    """Sum of one or more terms, product of two or more; null for another kind or a null term."""
    total = F.aggregate(terms, _dec("0"), lambda a, x: (a + x).cast(NUMBER))
    # a product keeps six places of each factor, so that no digit is lost to the 38 of a decimal
    times = F.aggregate(terms, _dec("1"), lambda a, x: (a.cast("decimal(20,6)") * x.cast("decimal(16,6)")).cast(NUMBER))
    return F.when((kind == "sum") & (F.size(terms) >= 1), total).when(kind.isin("product", "factor") & (F.size(terms) >= 2), times)


def agrees(actual: Column, expected: Column, rel: str = REL_TOL) -> Column:
    gap, scale = F.abs(actual - expected), F.greatest(F.abs(actual), F.abs(expected))
    return (gap <= F.lit(ABS_FLOOR).cast("decimal(10,4)")) | (gap <= scale * F.lit(rel).cast("decimal(10,4)"))


def severity_of_gap(actual: Column, expected: Column) -> Column:
    gap, scale = F.abs(actual - expected), F.greatest(F.abs(actual), F.abs(expected))
    limit = lambda x: scale * F.lit(x).cast("decimal(10,4)")
    return F.when(gap >= limit(HIGH_REL), F.lit("high")).when(gap >= limit(MEDIUM_REL), F.lit("medium")).otherwise(F.lit("low"))


def operands_in_quote(terms: Column, expected: Column, quote: Column) -> Column:
    # the outer transform binds the quote's numbers, so they are read once a row, not once an operand
    held = F.transform(F.array(numbers_in(quote)), lambda present: F.forall(F.array_append(terms, expected), lambda t: F.array_contains(present, t)))
    return held[0]


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: F.greatest(zero, r[2] - r[0]) * F.greatest(zero, r[3] - r[1])
    return F.when(inter <= 0, zero).otherwise(inter / (area(a) + area(b) - inter))


def padded(r: tuple[Column, ...], w: Column, h: Column, pad: float = 8.0) -> tuple[Column, ...]:
    return F.greatest(F.lit(0.0), r[0] - pad), F.greatest(F.lit(0.0), r[1] - pad), F.least(w, r[2] + pad), F.least(h, r[3] + pad)


def to_view(x: Column, y: Column, m: tuple[Column, ...]) -> tuple[Column, Column]:
    """Affine transform with the matrix (a, b, c, d, e, f)."""
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f


def view_rect(r: tuple[Column, ...], m: tuple[Column, ...]) -> tuple[Column, ...]:
    """The four corners transformed and boxed; null where a corner is not finite."""
    corners = [to_view(x, y, m) for x in (r[0], r[2]) for y in (r[1], r[3])]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    bad = F.lit(False)
    for v in xs + ys:
        bad = bad | F.isnan(v) | (F.abs(v) == float("inf"))
    return tuple(F.when(~bad, v) for v in (F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)))


def base_cell(cx: Column, cy: Column, w: Column, h: Column, rows: Column, cols: Column) -> tuple[Column, Column]:
    cell = lambda v, size, n: F.least(n - 1, F.greatest(F.lit(0), (v / (size / n)).cast("int")))
    return cell(cy, h, rows), cell(cx, w, cols)


def tile(w: Column, h: Column, row: Column, col: Column, rows: Column, cols: Column, overlap: float = 0.08) -> tuple[Column, ...]:
    """Rectangle of one cell of an overlapping grid, clamped to the page."""
    cw, ch = w / cols, h / rows
    return (
        F.greatest(F.lit(0.0), col * cw - cw * overlap), F.greatest(F.lit(0.0), row * ch - ch * overlap),
        F.least(w, (col + 1) * cw + cw * overlap), F.least(h, (row + 1) * ch + ch * overlap),
    )


def position_label(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    across = F.when(cx < w / 3, F.lit("left")).when(cx > 2 * w / 3, F.lit("right")).otherwise(F.lit("center"))
    down = F.when(cy < h / 3, F.lit("upper")).when(cy > 2 * h / 3, F.lit("lower")).otherwise(F.lit("middle"))
    return F.when((across == "center") & (down == "middle"), F.lit("center")).otherwise(F.concat(down, F.lit("-"), across))


def context_rect(r: tuple[Column, ...], w: Column, h: Column, grow: float = 1.75, least_w: float = 350.0, least_h: float = 250.0) -> tuple[Column, ...]:
    cx, cy = (r[0] + r[2]) / 2, (r[1] + r[3]) / 2
    hw, hh = F.greatest((r[2] - r[0]) * grow, F.lit(least_w)) / 2, F.greatest((r[3] - r[1]) * grow, F.lit(least_h)) / 2
    return F.greatest(F.lit(0.0), cx - hw), F.greatest(F.lit(0.0), cy - hh), F.least(w, cx + hw), F.least(h, cy + hh)


def image_tokens(w: Column, h: Column, cap: int = 1600, edge: int = 1568, divisor: float = 750.0) -> Column:
    scale = F.when(F.greatest(w, h) > edge, F.lit(float(edge)) / F.greatest(w, h)).otherwise(F.lit(1.0))
    return F.when((w <= 0) | (h <= 0), F.lit(0)).otherwise(F.least(F.lit(cap), F.ceil((w * scale) * (h * scale) / divisor))).cast("long")


def poll_interval(elapsed: Column, base: int = 15, cap: int = 120, after: int = 300) -> Column:
    """Seconds between polls: ``base`` up to ``after``, then linear to ``cap`` at twice that."""
    progress = F.least(F.lit(1.0), (elapsed - after) / float(after))
    return F.when(elapsed <= after, F.lit(base)).otherwise(F.greatest(F.lit(base), F.least(F.lit(cap), (base + (cap - base) * progress).cast("int"))))


def usage_cost(inp: Column, out: Column, read: Column, write: Column, searches: Column, price_in: Column, price_out: Column, batch: Column) -> Column:
    """Exact cost: reads at a tenth, writes at five quarters of the input price, half in a batch;
    searches are never discounted. An unknown model costs its searches or, without any, null."""
    d = lambda c: c.cast("decimal(20,0)")
    m = lambda x: F.lit(x).cast("decimal(8,7)")
    p_in, p_out = price_in.cast("decimal(10,2)"), price_out.cast("decimal(10,2)")
    tokens = (d(inp) * p_in + d(out) * p_out).cast("decimal(32,4)") + (d(read) * p_in * F.lit("0.1").cast("decimal(2,1)") + d(write) * p_in * F.lit("1.25").cast("decimal(3,2)")).cast("decimal(32,4)")
    cost = (tokens.cast("decimal(30,4)") * m("0.0000010")).cast("decimal(36,12)")
    cost = F.when(batch, (cost * F.lit("0.5").cast("decimal(2,1)")).cast("decimal(36,12)")).otherwise(cost)
    tool = (d(searches) * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(36,12)")
    return F.when(price_in.isNull(), F.when(tool > 0, tool)).otherwise((cost + tool).cast("decimal(36,12)"))
