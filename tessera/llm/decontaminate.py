"""Benchmark decontamination by the q-gram lemma, verified by banded alignment.

Texts and benchmark items are lower-cased with white space collapsed, as UTF-8 bytes. An item of m
bytes may differ from a passage by k = floor(m * RATE) edits (fewer where the lemma would have nothing
to count). Each edit destroys at most q of the m - q + 1 q-grams, so a passage within k edits keeps at
least m - q + 1 - k*q of them, and all on diagonals (text position minus item position) that lie k
apart at most. Shared q-grams are counted in bands of 2(k+1) diagonals that overlap by half, so one
band holds them all; a band that reaches the bound is a region, and an alignment within the band's
diagonals decides. Items shorter than q are looked up as they are, at all places that do not overlap.

Phrases that many items open with would give a pair for each of their items. Any k*q + t q-grams of an
item keep at least t after k edits, so q-grams with over ``HOT`` postings are left out of an item while
k*q + ``SPARE`` others remain (its rarest stay); regions found by fewer than all q-grams are counted anew
with all of them. The search stays exact.

Every text is scanned whole without a shuffle. The index of q-grams is sent to the executors. Items
beyond ``BLOCK_BYTES`` are taken in blocks: a pass over the texts for each, whose hits are written before
the next block is collected and sent, so one block is alive at a time on the driver and on any worker.

Defined results: null and empty texts are clean; null or empty items match nothing; items that repeat
are each reported; repeated rows are judged alike; an empty table gives an empty result and an empty
benchmark leaves all texts clean. Other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.store import Store, ship, table, tidy

Q = 10
RATE = 0.06
BLOCK_BYTES = 8 << 20
#: Bytes of text that one numpy pass handles.
PASS_BYTES = 1 << 20
#: Postings of a q-gram from which items do without it where they can, and the q-grams an item keeps beyond k*q.
HOT, SPARE = 64, 8
#: Shared q-grams that are paired with their postings at once.
PAIRS = 1 << 21
HITS = "array<struct<item_id:long,start:int,end:int,edits:int>>"


def normal(text: str | None) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "surrogatepass") if text else b""


def codes(buf: bytes, q: int) -> np.ndarray:
    """A 64-bit code of the q bytes from every position; equal bytes have equal codes."""
    n = len(buf) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = buf + bytes(8)
    x = np.ndarray((n,), "<u8", padded, 0, (1,))
    if q < 8:
        return (x & np.uint64((1 << (8 * q)) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    if q == 8:
        return x * np.uint64(0x9E3779B97F4A7C15)
    out = x * np.uint64(0x9E3779B97F4A7C15)
    for at in [*range(8, q - 8, 8), q - 8]:
        out ^= np.ndarray((n,), "<u8", padded, at, (1,)) * np.uint64(0xC2B2AE3D27D4EB4F)
        out *= np.uint64(0x165667B19E3779F9)
    return out


def align(item: bytes, text: bytes, low: int, width: int, k: int) -> tuple[int, int, int] | None:
    """The best place of ``item`` in ``text``, start and end free, on the diagonals low..low+width.

    Returns (edits, start, end) or None beyond k edits. Row i holds columns i+low .. i+low+width."""
    big = k + 1
    n = np.arange(width + 1)
    t = np.full(width + 1 + len(item) + 1, 256, np.int16)  # text under the band, 256 outside it
    a, b = max(0, low), min(len(text), low + len(t))
    if a < b:
        t[a - low : b - low] = np.frombuffer(text[a:b], np.uint8)
    at = low + n
    cost = np.where((at >= 0) & (at <= len(text)), 0, big)
    start = at.copy()
    for i, c in enumerate(item):
        # columns move by one with the row, so a substitution stays in place and an insertion comes from the right
        sub = cost + (t[i : i + width + 1] != c)
        gap = np.append(cost[1:], big) + 1
        use = gap < sub
        cost, start = np.where(use, gap, sub), np.where(use, np.append(start[1:], 0), start)
        best = np.minimum.accumulate(cost - n)  # a deletion comes from the left, one each step
        if (best + n < cost).any():
            first = np.maximum.accumulate(np.where(cost - n == best, n, 0))
            start, cost = start[first], best + n
        ends = low + i + 1 + n
        cost = np.where((ends < 0) | (ends > len(text)), big, np.minimum(cost, big))
        if cost.min() > k:
            return None
    j = int(cost.argmin())
    return int(cost[j]), int(start[j]), low + len(item) + j


class Index:
    """q-gram postings of a block of items; items of one text share theirs."""

    def __init__(self, items: list[tuple[int, bytes]], q: int = Q, rate: float = RATE, hot: int = HOT, spare: int = SPARE):
        idents: dict[bytes, list[int]] = {}
        for ident, x in items:
            if x:
                idents.setdefault(x, []).append(ident)
        self.q, self.texts, self.idents = q, list(idents), list(idents.values())
        long_ = [i for i, x in enumerate(self.texts) if len(x) >= q]
        self.short = [i for i, x in enumerate(self.texts) if len(x) < q]
        m = np.array([len(x) for x in self.texts], np.int64)
        self.k = np.minimum(np.floor(m * rate), np.maximum(0, (m - q) // q)).astype(np.int64)
        self.least = m - q + 1 - self.k * q
        self.need = self.least.copy()  # of the q-grams an item is indexed by
        grams = [codes(self.texts[i], q) for i in long_]
        code = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        uniq, back, count = np.unique(code, return_inverse=True, return_counts=True)
        items_of, places, kept, at = [], [], [], 0
        for i, g in zip(long_, grams, strict=True):
            n = count[back[at : at + len(g)]]
            place = np.arange(len(g))
            if (n > hot).any():
                size = max(int((n <= hot).sum()), min(len(g), int(self.k[i]) * q + spare))
                place = np.sort(np.argsort(n, kind="stable")[:size])
                self.need[i] = size - self.k[i] * q
            items_of.append(np.full(len(place), i, np.int64))
            places.append(place)
            kept.append(g[place])
            at += len(g)
        code = np.concatenate(kept) if kept else code
        item = np.concatenate(items_of) if kept else np.zeros(0, np.int64)
        place = np.concatenate(places) if kept else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        self.item, self.place = item[order], place[order]
        self.flags = np.zeros(1 << 21, bool)
        self.flags[self.code >> np.uint64(43)] = True

    def _pairs(self, buf: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text position, item, item position) of every shared q-gram, about ``PAIRS`` at a time."""
        c = codes(buf, self.q)
        at = np.flatnonzero(self.flags[c >> np.uint64(43)])
        if not len(at) or not len(self.code):
            return
        got = np.minimum(np.searchsorted(self.code, c[at]), len(self.code) - 1)
        same = self.code[got] == c[at]
        at, got = at[same], got[same]
        turn = np.cumsum(self.count[got]) // PAIRS
        for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(turn)) + 1):
            n = self.count[got[own]]
            where = np.repeat(self.first[got[own]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            if len(where):
                yield np.repeat(at[own], n), self.item[where], self.place[where]

    def _in_band(self, item: int, text: bytes, low: int, width: int) -> int:
        """Shared q-grams of an item and a text on the diagonals low..low+width-1, by all q-grams of the item."""
        x = self.texts[item]
        a, b = max(0, low), min(len(text), low + width + len(x))
        theirs, own = codes(text[a:b], self.q), codes(x, self.q)
        order = np.argsort(own, kind="stable")
        left, right = np.searchsorted(own[order], theirs, "left"), np.searchsorted(own[order], theirs, "right")
        n = right - left
        at = np.repeat(np.arange(len(theirs)), n) + a
        place = order[np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        diagonal = at - place
        return int(((diagonal >= low) & (diagonal < low + width)).sum())

    def search(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """For each normalised text its (item id, start, end, edits)."""
        out: list[list] = [[] for _ in texts]
        for i in self.short:
            x = self.texts[i]
            for d, t in enumerate(texts):
                p = t.find(x)
                while p >= 0:
                    out[d] += [(ident, p, p + len(x), 0) for ident in self.idents[i]]
                    p = t.find(x, p + len(x))
        gap = bytes(self.q)
        starts = np.concatenate([[0], np.cumsum([len(t) + self.q for t in texts])])
        base = 1 << 31
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at, item, place in self._pairs(gap.join(texts) + gap):
            doc = np.searchsorted(starts, at, side="right") - 1
            low = np.floor_divide(at - starts[doc] - place, self.k[item] + 1)  # the bands that hold a diagonal start at half*low and half*(low-1)
            key = (doc * len(self.texts) + item) * np.int64(base) + (low + (base >> 1))
            more, n = np.unique(np.concatenate([key, key - 1]), return_counts=True)
            keys, back = np.unique(np.concatenate([keys, more]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        which = keys // base
        keep = counts >= self.need[which % len(self.texts)] if len(keys) else np.zeros(0, bool)
        which, band = which[keep], keys[keep] % base - (base >> 1)
        found = zip((which // len(self.texts)).tolist(), (which % len(self.texts)).tolist(), band.tolist(), strict=True) if len(which) else []
        done: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for d, i, b in sorted(found):
            k = int(self.k[i])
            first = b * (k + 1)
            if self.need[i] < self.least[i] and self._in_band(i, texts[d], first, 2 * (k + 1)) < self.least[i]:
                continue
            got = align(self.texts[i], texts[d], first - k, 2 * (k + 1) + 2 * k, k)
            if got and not any(s < got[2] and got[1] < e for s, e in done.setdefault((d, i), [])):
                done[d, i].append((got[1], got[2]))
                out[d] += [(ident, got[1], got[2], got[0]) for ident in self.idents[i]]
        return [sorted(x) for x in out]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(number of blocks, items) for blocks of a bounded size, each collected when it is asked for."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(size) // block_bytes))
    for part in range(parts):
        own = benchmark if parts == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield parts, sorted((r[0], normal(r[1])) for r in own.where("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator())


def _finder(spark: SparkSession, items: list[tuple[int, bytes]], q: int, rate: float):
    """(column function, broadcast) that finds a block's items in a text."""
    sent = spark.sparkContext.broadcast(items)

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(sent.value, q, rate)
        for texts in batches:
            out, own, size = [], [], 0
            for t in texts:
                own.append(normal(t))
                size += len(own[-1])
                if size >= PASS_BYTES:
                    out += index.search(own)
                    own, size = [], 0
            out += index.search(own)
            yield pd.Series([[dict(zip(("item_id", "start", "end", "edits"), x, strict=True)) for x in row] for row in out], dtype=object)
        tidy()

    return F.pandas_udf(find, HITS).asNondeterministic(), sent


def with_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, hits: str, q: int = Q, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` and the benchmark passages in ``text`` as a column ``hits``: an array of (item_id, start, end,
    edits), in bytes of the text's normal form. A benchmark of one block is searched as the result is read."""
    ship(spark)
    blocks = _blocks(benchmark.select(F.col("item_id").cast("long"), "text"), block_bytes)
    count, first = next(blocks)
    if count == 1:
        return docs.withColumn(hits, _finder(spark, first, q, rate)[0]("text"))
    store, name = Store(spark, "leaks"), "__tessera_name"
    kept = store.stage(docs.withColumn(name, F.expr("uuid()")), "docs")
    found = None
    while first is not None:
        find, sent = _finder(spark, first, q, rate)
        own = store.stage(kept.select(name, find("text").alias(hits)).where(F.size(hits) > 0), "hits")
        sent.destroy()
        found = own if found is None else found.unionByName(own)
        first = next(blocks, (0, None))[1]
    per = found.select(name, F.explode(hits).alias("h")).groupBy(name).agg(F.array_sort(F.collect_list("h")).alias(hits))
    return kept.join(per, name, "left").withColumn(hits, F.coalesce(hits, F.array().cast(HITS))).drop(name)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its benchmark passages; null ids and repeated rows are rows like others."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_leaks(spark, docs, table(spark, sf_dir, "benchmark"), "hits")
    items = F.array_sort(F.array_distinct(F.col("hits.item_id")))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").alias("n_passages"), items.alias("item_ids"), F.array_min("hits.edits").alias("least_edits"), "hits")


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark passage; all columns stay."""
    found = with_leaks(spark, docs, benchmark, "__tessera_hits").where(F.size("__tessera_hits") == 0)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
