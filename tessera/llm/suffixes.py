"""Exact removal of repeated byte strings by a distributed sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Sorting every
suffix of a corpus would move it many times over, so the suffixes that can matter are found first,
without losing any:

1. Every window of LENGTH bytes has an anchor, the leftmost smallest hash of its K-grams. Equal windows
   have equal anchors at the same place in them. A run is the stretch of windows of one anchor.
   Only (K-gram hash, digest of the run's bytes) is counted. A K-gram met once proves its windows
   unique, and runs with equal bytes prove one another's windows repeated.
2. What is left, one run for each distinct content of a K-gram with several, gives a suffix from its
   anchor. Tasks sort their suffixes and send them, front-coded, to ranges of the suffix order.
   Each range is merged by a loser tree that keeps the common prefix with the last winner for each
   run: the longer one wins without a comparison, and equal ones are compared only behind it. The
   merge gives the longest common prefixes of neighbours in the order as a by-product.
3. A window that begins o bytes before its anchor is repeated if another suffix shares LENGTH - o
   bytes (they stand in one stretch of the order whose common prefixes are that long) and the o bytes
   before it (whose hash, extended byte by byte, must agree).
4. Repeated windows go back to all runs of their content, are united by document and cut out.

Defined results: null and empty texts and those shorter than LENGTH keep all bytes; rows equal in id
and text are separate copies, which repeat one another; ids may be null or repeat; an empty table
gives an empty result. Other columns pass through ``without_repeated_bytes`` and are not read else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.store import Store, ship, table

LENGTH, K = 400, 32
#: Bytes of text in one numpy pass; positions within a pass take 24 bits.
PASS_BYTES = 4 << 20
SPLITTER_SAMPLE = 20_000
#: Bytes of suffixes that a range of the order is meant to hold, and that a task sorts and sends at once.
RANGE_BYTES, RUN_BYTES = 8 << 20, 32 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(data: bytes, k: int = K) -> np.ndarray:
    """A 64-bit hash of the k bytes (a multiple of 8) from every position."""
    n = len(data) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for at in range(0, k, 8) if n > 0 else ():
        out ^= np.ndarray((n,), "<u8", data, at, (1,))
        out *= _M1
        out ^= out >> np.uint64(29)
    out *= _M2
    out ^= out >> np.uint64(32)
    return out


def runs_of(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor, K-gram hash) of the runs of the texts in ``data``."""
    w = length - k + 1
    h = gram_hashes(data, k)
    n = len(h)
    none = np.zeros(0, np.int64)
    if n < w:
        return none, none, none, none, none.astype(np.uint64)
    packed = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
    x = np.concatenate([packed, np.full(-n % w + w, np.uint64(2**64 - 1))]).reshape(-1, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(starts)), ends - starts)[:n]
    p = np.flatnonzero(np.arange(n) + length <= ends[text])
    if not len(p):
        return none, none, none, none, none.astype(np.uint64)
    a, t = anchor[p], text[p]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (t[1:] != t[:-1])])
    first, last, a = p[new], p[np.r_[new[1:] - 1, len(p) - 1]], a[new]
    return t[new], first, last, a, h[a]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) with rid, a hash of id and text: rows that agree in both have equal results."""
    return docs.withColumn("rid", F.xxhash64("doc_id", "text"))


RUN = "rid long, first long, last long, anchor long, h long, c1 long, c2 long"


def run_table(spark: SparkSession, docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(rid, text) -> a row per run; ``c1, c2`` digest the run's bytes and its anchor's place in them."""
    ship(spark)

    def one(rids, parts, shifts) -> pd.DataFrame:
        import xxhash

        size = np.array([len(x) for x in parts], np.int64)
        ends = np.cumsum(size)
        starts = ends - size
        data = b"".join(parts)
        t, a, b, at, h = runs_of(data, starts, ends, length, k)
        digest = xxhash.xxh3_128_digest
        raw = b"".join([digest(data[x : y + length], z - x) for x, y, z in zip(a.tolist(), b.tolist(), at.tolist(), strict=True)])
        c = np.frombuffer(raw, ">i8").reshape(-1, 2).astype(np.int64)
        base = np.array(shifts, np.int64)[t] - starts[t]
        return pd.DataFrame({"rid": np.array(rids, np.int64)[t], "first": a + base, "last": b + base, "anchor": at + base, "h": h.astype(np.int64), "c1": c[:, 0], "c2": c[:, 1]})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rids, parts, shifts, total = [], [], [], 0
        for pdf in batches:
            for r, t in zip(pdf["rid"], pdf["text"], strict=True):
                data = t.encode("utf-8", "surrogatepass") if t else b""
                # a very long text is taken in stretches that overlap, so each window stands in one of them
                for s in range(0, max(0, len(data) - length) + 1, PASS_BYTES):
                    piece = data[s : s + PASS_BYTES + length - 1]
                    if len(piece) < length:
                        continue
                    rids.append(r)
                    parts.append(piece)
                    shifts.append(s)
                    total += len(piece)
                    if total >= PASS_BYTES:
                        yield one(rids, parts, shifts)
                        rids, parts, shifts, total = [], [], [], 0
        if rids:
            yield one(rids, parts, shifts)

    return docs.select("rid", "text").mapInPandas(scan, RUN)


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    most = min(len(a), len(b))
    step = 32
    while known < most:
        end = min(most, known + step)
        x, y = a[known:end], b[known:end]
        if x != y:
            differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return known + len(x) - (differ.bit_length() + 7) // 8
        known, step = end, step * 4
    return most


class LoserTree:
    """Merges sorted runs of byte strings with their common prefixes; no known prefix is compared again.

    A contender is (run, its common prefix with the last winner). Of two, the longer prefix is the smaller
    string; equal prefixes are compared behind it, and the loser keeps its common prefix with its conqueror."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.tree: list[tuple[int, int] | None] = [None] * self.size
        self.top = self._build(1)

    def _head(self, run: int, prefix: int) -> tuple[int, int] | None:
        return (run, prefix) if run < len(self.runs) and self.at[run] < len(self.runs[run][0]) else None

    def _build(self, node: int) -> tuple[int, int] | None:
        if node >= self.size:
            return self._head(node - self.size, 0)
        winner, self.tree[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def _play(self, x, y):
        if x is None or y is None:
            return (x, y) if y is None else (y, x)
        if x[1] != y[1]:
            return (x, y) if x[1] > y[1] else (y, x)
        a, b = self.runs[x[0]][0][self.at[x[0]]], self.runs[y[0]][0][self.at[y[0]]]
        n = common_prefix(a, b, x[1])
        first = n == len(a) and (n < len(b) or x[0] < y[0]) or n < len(a) and n < len(b) and a[n] < b[n]
        return (x, (y[0], n)) if first else (y, (x[0], n))

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(run, place in it, common prefix with the string before) in sorted order."""
        while self.top is not None:
            run, prefix = self.top
            yield run, self.at[run], prefix
            self.at[run] += 1
            now = self._head(run, self.runs[run][1][self.at[run]] if self.at[run] < len(self.runs[run][1]) else 0)
            node = (run + self.size) // 2
            while node:
                now, self.tree[node] = self._play(now, self.tree[node])
                node //= 2
            self.top = now


def repeated_windows(prefix: np.ndarray, left: list[bytes], low: np.ndarray, high: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For suffixes in order: which windows, by bytes before the anchor, another suffix shares.

    ``prefix``: common prefix with the suffix before; ``left``: bytes before the anchor, backwards;
    windows begin low..high bytes before it."""
    m, most = len(left), int(high.max(initial=-1))
    out = np.zeros((m, most + 1), bool)
    before = np.zeros((m, most + 1), np.uint8)
    for i, x in enumerate(left):
        before[i, : len(x)] = np.frombuffer(x, np.uint8)
    h = np.zeros(m, np.uint64)
    for o in range(most + 1):
        if o:
            h = (h ^ before[:, o - 1].astype(np.uint64)) * _M1
            h ^= h >> np.uint64(29)
        own = np.flatnonzero((low <= o) & (o <= high))
        if len(own) < 2:
            continue
        stretch = np.cumsum(prefix < length - o).astype(np.uint64)[own]
        key = (h[own] ^ (stretch * _M2)) * _M1
        key ^= key >> np.uint64(31)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        hit = np.zeros(len(own), bool)
        hit[1:] |= same
        hit[:-1] |= same
        out[own[order[hit]], o] = True
    return out


SENT = "target int, lcp binary, size binary, tail binary, left_size binary, left binary, key binary"
FOUND = "h long, c1 long, c2 long, windows array<struct<first:int,last:int>>"


def resolve(spark: SparkSession, contexts: DataFrame, store: Store, least: int, length: int = LENGTH, k: int = K, range_bytes: int = RANGE_BYTES, run_bytes: int = RUN_BYTES) -> DataFrame:
    """``contexts``: stored (h, c1, c2, before, after), one row per distinct run content: bytes from its
    first window to its anchor, and from there to its last window's end. Returns the repeated windows
    (relative to the first) of each content. The order has a range for each ``range_bytes``, ``least`` at
    least; a task sends a run for each ``run_bytes``."""
    total, size = contexts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("after")), F.lit(0))).first()
    parts = max(least, -(-size // range_bytes))
    wanted = max(SPLITTER_SAMPLE, 20 * parts)
    share = min(1.0, wanted / max(total, 1))
    sample = contexts.where(F.pmod(F.xxhash64("c1", "c2"), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.substring("after", 1, k).alias("s")).limit(2 * wanted)
    sample = sorted(bytes(r[0]) for r in sample.collect())
    # ranges part at K-grams, so suffixes that share one meet
    splitters = sorted({sample[i * len(sample) // parts] for i in range(1, parts)}) if sample else []

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for pdf in batches:
            for x in zip(map(bytes, pdf["after"]), map(bytes, pdf["before"]), pdf["h"], pdf["c1"], pdf["c2"], strict=True):
                rows.append(x)
                size += len(x[0]) + len(x[1])
                if size >= run_bytes:
                    yield from run(rows)
                    rows, size = [], 0
        yield from run(rows)

    def run(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        import bisect

        rows.sort(key=lambda r: r[0])
        ranges: dict[int, list] = {}
        for r in rows:
            ranges.setdefault(bisect.bisect_right(splitters, r[0][:k]), []).append(r)
        for target, own in ranges.items():
            lcp = [0] + [common_prefix(x[0], y[0], 0) for x, y in zip(own, own[1:], strict=False)]
            yield pd.DataFrame(
                {
                    "target": [target],
                    "lcp": [np.array(lcp, "<u4").tobytes()],
                    "size": [np.array([len(r[0]) - n for r, n in zip(own, lcp, strict=True)], "<u4").tobytes()],
                    "tail": [b"".join(r[0][n:] for r, n in zip(own, lcp, strict=True))],
                    "left_size": [np.array([len(r[1]) for r in own], "<u4").tobytes()],
                    "left": [b"".join(r[1][::-1] for r in own)],
                    "key": [np.array([r[2:] for r in own], "<i8").tobytes()],
                }
            )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        runs, lefts, keys = [], [], []
        for r in pdf.itertuples():
            lcp, size = np.frombuffer(r.lcp, "<u4").tolist(), np.frombuffer(r.size, "<u4").tolist()
            strings, at, last = [], 0, b""
            for n, more in zip(lcp, size, strict=True):
                last = last[:n] + r.tail[at : at + more]
                strings.append(last)
                at += more
            runs.append((strings, lcp))
            ends = np.cumsum(np.frombuffer(r.left_size, "<u4").astype(np.int64)).tolist()
            lefts.append([r.left[a:b] for a, b in zip([0, *ends], ends, strict=False)])
            keys.append(np.frombuffer(r.key, "<i8").reshape(-1, 3))
        order = list(LoserTree(runs))
        if not order:
            return pd.DataFrame({c: [] for c in ("h", "c1", "c2", "windows")})
        left = [lefts[r][i] for r, i, _ in order]
        after = np.array([len(runs[r][0][i]) for r, i, _ in order], np.int64)
        high = np.array([len(x) for x in left], np.int64)
        hit = repeated_windows(np.array([n for _, _, n in order], np.int64), left, length - after, high, length)
        key = np.array([keys[r][i] for r, i, _ in order], np.int64).reshape(-1, 3)
        out = []
        for i in np.flatnonzero(hit.any(axis=1)):
            first = high[i] - np.flatnonzero(hit[i])[::-1]  # windows by their place behind the run's first
            new = np.flatnonzero(np.r_[True, np.diff(first) > 1])
            out.append((*key[i].tolist(), [{"first": int(first[a]), "last": int(first[b - 1])} for a, b in zip(new, [*new[1:], len(first)], strict=True)]))
        return pd.DataFrame(out, columns=["h", "c1", "c2", "windows"])

    sent = contexts.mapInPandas(send, SENT)
    return sent.groupBy("target").applyInPandas(merge, FOUND)


def repeated_spans(spark: SparkSession, docs: DataFrame, store: Store, length: int = LENGTH, k: int = K) -> DataFrame:
    """``docs``: (rid, text). Returns rid and spans, the maximal stretches of bytes to remove, for texts that have any."""
    ship(spark)
    runs = store.stage(run_table(spark, docs, length, k), "runs")
    classes = runs.groupBy("h", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("rid", "first", "last", "anchor")).alias("one"))
    classes = store.stage(classes, "classes")
    several = classes.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    need = classes.join(several, "h", "left_semi").select("h", "c1", "c2", F.col("one.rid").alias("rid"), "one.first", "one.last", "one.anchor")
    per = need.groupBy("rid").agg(F.collect_list(F.struct("h", "c1", "c2", "first", "last", "anchor")).alias("own"))

    def context(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for text, own in zip(pdf["text"], pdf["own"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                rows += [(x["h"], x["c1"], x["c2"], data[x["first"] : x["anchor"]], data[x["anchor"] : x["last"] + length]) for x in own]
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=["h", "c1", "c2", "before", "after"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["h", "c1", "c2", "before", "after"])

    contexts = docs.select("rid", "text").join(per, "rid").mapInPandas(context, "h long, c1 long, c2 long, before binary, after binary")
    contexts = store.stage(contexts, "contexts")
    least = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = store.stage(resolve(spark, contexts, store, least, length, k), "found")
    store.drop(contexts)
    whole = classes.where("n > 1").select("h", "c1", "c2", F.array(F.struct(F.lit(0).alias("first"), (F.col("one.last") - F.col("one.first")).cast("int").alias("last"))).alias("windows"))
    some = found.join(classes.where("n = 1").select("h", "c1", "c2"), ["h", "c1", "c2"]).select("h", "c1", "c2", "windows")
    hits = runs.select("rid", "first", "h", "c1", "c2").join(whole.unionByName(some), ["h", "c1", "c2"])
    hits = hits.select("rid", F.transform("windows", lambda x: F.struct((F.col("first") + x["first"]).alias("start"), (F.col("first") + x["last"] + length).alias("end"))).alias("spans"))
    hits = store.stage(hits.groupBy("rid").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")), "spans")
    return hits


def united(spans) -> list[tuple[int, int]]:
    """Sorted stretches, those that overlap or touch made one."""
    out: list[list[int]] = []
    for s in spans if spans is not None else ():
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return [(a, b) for a, b in out]


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


CUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"


def cut_out(with_bytes: bool):
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(texts, spans, strict=True):
            data, own = t.encode("utf-8", "surrogatepass") if t else b"", united(s)
            kept = kept_bytes(data, own)
            rows.append((len(data), len(data) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in own], kept if with_bytes else None))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return F.pandas_udf(cut, CUT).asNondeterministic()


def without_repeated_bytes(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All columns of ``docs``, with ``cut``: the counts, spans and kept bytes of each text."""
    store = Store(spark, "suffixes")
    own = docs.withColumn("__tessera_rid", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(spark, own.select(F.col("__tessera_rid").alias("rid"), "text"), store, length).select(F.col("rid").alias("__tessera_rid"), F.col("spans").alias("__tessera_spans"))
    out = own.join(spans, "__tessera_rid", "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], cut_out(True)("text", "__tessera_spans").alias("cut"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "suffixes")
    docs = keyed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = repeated_spans(spark, docs.select("rid", "text"), store)
    out = docs.join(spans, "rid", "left").select("doc_id", cut_out(False)("text", "spans").alias("x"))
    return out.select("doc_id", "x.n_bytes", "x.n_removed", "x.n_spans", "x.kept_sha256")
