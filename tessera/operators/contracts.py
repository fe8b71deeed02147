"""External calls as row-to-row functions, their attempts, and small stateful helpers."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPLY = "reply string, input_tokens long, output_tokens long, attempts int, error string"


def call_rows(rows: DataFrame, ident: str, prompt: str, client: Callable[[str], tuple[str, int, int]], tries: int = 4, pause: float = 0.0, transient: tuple = (TimeoutError, ConnectionError)) -> DataFrame:
    """``client(prompt) -> (reply, input tokens, output tokens)`` for each row; one result row per input row.

    Transient errors are tried again with a doubling pause; any other error is the row's ``error`` and
    fails no other row. Digests, critiques, verdicts and citations are this call with another client."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text in zip(pdf[ident], pdf[prompt], strict=True):
                for n in range(1, tries + 1):
                    try:
                        out.append((key, *client(text), n, None))
                        break
                    except transient as e:
                        if n == tries:
                            out.append((key, None, 0, 0, n, str(e)))
                        else:
                            time.sleep(pause * 2 ** (n - 1))
                    except Exception as e:  # noqa: BLE001  the row's own error
                        out.append((key, None, 0, 0, n, str(e)))
                        break
            yield pd.DataFrame(out, columns=[ident, "reply", "input_tokens", "output_tokens", "attempts", "error"])

    return rows.select(ident, prompt).mapInPandas(run, f"{ident} {dict(rows.dtypes)[ident]}, {REPLY}")


def misses_only(rows: DataFrame, cached: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows served from the cache, and the rows a call is still needed for."""
    return rows.join(cached, key), rows.join(cached.select(key), key, "left_anti")


def latest_success(attempts: DataFrame, key: str, ok: Column) -> DataFrame:
    """The last successful attempt of each key; earlier ones stay in ``attempts`` for billing."""
    return attempts.where(ok).groupBy(key).agg(F.max_by(F.struct(*attempts.columns), F.col("attempt")).alias("r")).select("r.*")


def circuit_breaks(results: DataFrame, part: str, order: str, fatal: Column, error: str, limit: int = 3) -> DataFrame:
    """Where ``limit`` equal fatal errors stand in a row: part and the order of the last of the first such run."""
    w = Window.partitionBy(part).orderBy(order)
    same = fatal & F.lag(error).over(w).eqNullSafe(F.col(error))
    df = results.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(w)).withColumn("fatal", fatal)
    df = df.where("fatal").withColumn("n", F.row_number().over(Window.partitionBy(part, "run").orderBy(order)))
    return df.where(F.col("n") == limit).groupBy(part).agg(F.min(order).alias("broke_at"))


def block_pairs(rows: DataFrame, order: list[str], size: int = 200, part: str | None = None) -> DataFrame:
    """Adds ``block``, and gives each row once for every pair of blocks it belongs to (pair_a, pair_b)."""
    w = Window.partitionBy(*([part] if part else [])).orderBy(*order)
    df = rows.withColumn("block", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    last = df.groupBy(*([part] if part else [])).agg(F.max("block").alias("last_block"))
    df = df.join(F.broadcast(last), part) if part else df.join(F.broadcast(last))
    others = F.sequence(F.lit(0), F.col("last_block"))
    pairs = F.filter(F.transform(others, lambda o: F.struct(F.least("block", o).alias("a"), F.greatest("block", o).alias("b"))), lambda p: (p["a"] < p["b"]) | (F.col("last_block") == 0))
    return df.withColumn("pair", F.explode(pairs)).withColumn("pair_a", F.col("pair.a")).withColumn("pair_b", F.col("pair.b")).drop("pair", "last_block")


def group_lines(words: DataFrame, page: str) -> DataFrame:
    """Adds ``line_no``: words by vertical centre join the last line within 0.6 of their height of its mean."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(yc=(pdf["y0"] + pdf["y1"]) / 2).sort_values(["yc", "x0"], kind="stable")
        number, ys, out = -1, [], []
        for yc, y0, y1 in zip(pdf["yc"], pdf["y0"], pdf["y1"], strict=True):
            if not ys or abs(yc - sum(ys) / len(ys)) > 0.6 * max(1.0, y1 - y0):
                number, ys = number + 1, []
            ys.append(yc)
            out.append(number)
        return pdf.assign(line_no=out).drop(columns="yc")

    return words.groupBy(page).applyInPandas(run, words.schema.simpleString()[7:-1] + ",line_no:int")


def pack_boxes(boxes: DataFrame, page: str, order: str, page_w: float, page_h: float, step: float = 10.0) -> DataFrame:
    """Places each box (w, h) at the first free grid place of its page, in order; x and y are null for what is left over."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = [], []
        for w, h in pdf.sort_values(order, kind="stable")[["w", "h"]].itertuples(index=False):
            found = None
            y = 0.0
            while found is None and y + h <= page_h:
                x = 0.0
                while found is None and x + w <= page_w:
                    if all(x + w <= a or c <= x or y + h <= b or d <= y for a, b, c, d in taken):
                        found = (x, y)
                    x += step
                y += step
            if found:
                taken.append((found[0], found[1], found[0] + w, found[1] + h))
            out.append(found or (None, None))
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(x=[p[0] for p in out], y=[p[1] for p in out])

    return boxes.groupBy(page).applyInPandas(run, boxes.schema.simpleString()[7:-1] + ",x:double,y:double")


def edition_windows(text: str, pattern: str, around: int = 80, most: int = 8) -> list[str]:
    """Slices around matches; one that begins inside the last slice given is left out."""
    out, end = [], -1
    for m in re.finditer(pattern, text or ""):
        if m.start() < end:
            continue
        end = min(len(text), m.end() + around)
        out.append(text[max(0, m.start() - around) : end])
        if len(out) >= most:
            break
    return out


def calculate(expression: str) -> float | None:
    """+ - * / and brackets on numbers to 15 significant digits; None for anything else."""
    tokens = re.findall(r"\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+|[-+*/()]|\S", expression)
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def level(ops: str, below: Callable[[], float]) -> float:
        v = below()
        while peek() and peek() in ops:
            op, w = take(), below()
            v = v + w if op == "+" else v - w if op == "-" else v * w if op == "*" else v / w
        return v

    def atom() -> float:
        if peek() == "-":
            take()
            return -atom()
        if peek() == "+":
            take()
            return atom()
        if peek() == "(":
            take()
            v = total()
            if take() != ")":
                raise ValueError
            return v
        return float(take())

    def total() -> float:
        return level("+-", lambda: level("*/", atom))

    try:
        v = total()
        return float(f"{v:.15g}") if at == len(tokens) else None
    except (ValueError, IndexError, ZeroDivisionError, RecursionError):
        return None


def sanitized_plans(items: DataFrame, plan: str = "slug", order: str = "ord", text: str = "item", longest: int = 200, most: int = 60) -> tuple[DataFrame, DataFrame]:
    """Plan items that stand, and the count dropped: overlong ones go (none is cut), repeats by folded
    case go, and beyond ``most`` in all the tail goes, plans in order of their slug."""
    fine = items.where((F.length(F.btrim(text)) > 0) & (F.length(text) <= longest))
    once = F.row_number().over(Window.partitionBy(plan, F.lower(F.btrim(text))).orderBy(order))
    fine = fine.withColumn("__n", once).where("__n = 1").drop("__n")
    kept = fine.orderBy(plan, order).limit(most)
    dropped = items.agg(F.count("*").alias("n")).crossJoin(kept.agg(F.count("*").alias("k"))).select((F.col("n") - F.col("k")).alias("n_dropped"))
    return kept, dropped


def harvest_accounting(expected: DataFrame, accounted: DataFrame, key: str, outcome: str) -> DataFrame:
    """Counts by outcome, with MISSING for expected items that nothing accounts for."""
    return expected.select(key).distinct().join(accounted.select(key, outcome), key, "left").groupBy(F.coalesce(outcome, F.lit("MISSING")).alias("outcome")).agg(F.count("*").alias("n"))


def cost_band(components: DataFrame, scenario: str, low: float = 0.75, high: float = 1.35) -> DataFrame:
    """Total of a scenario's component costs with a band; unknown if one component is."""
    unknown = F.count("*") != F.count("cost")
    total = F.when(unknown, F.lit(None)).otherwise(F.sum("cost"))
    return components.groupBy(scenario).agg(total.alias("cost")).withColumn("low", F.col("cost") * low).withColumn("high", F.col("cost") * high)
