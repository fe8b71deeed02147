"""Substring deduplication by content-defined chunks.

A gear hash rolls over each text's bytes; its bit b depends on the last b + 1 bytes alone. A cut falls
where ``CUT_BITS`` bits below bit ``WINDOW`` are zero and no such place lies within the ``MIN_CHUNK`` bytes before, so
cuts depend on nearby content only and an insertion moves no cut beyond it; longer stretches are cut
every ``MAX_CHUNK`` bytes from the last cut. Chunks are known by a 128-bit digest, and of equal chunks
the first (by id, then offset) stays. Chunks that occur twice or more and follow one another form
runs; runs under ``MIN_RUN`` bytes are common turns of phrase, not passages, and stay.

Digests are counted with a combine before the shuffle; the join that brings the counts back is a
sort-merge join, whose hot digests adaptive execution splits; what is gathered by document is bounded
by its own length.

Defined results: null and empty texts have no chunks; equal rows are separate documents, the second
loses its text; ids that are null come last; an empty table gives an empty result. Other columns of
``docs`` are not read by ``shared_spans`` and pass through ``without_repeats`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.store import Store, ship, table

MIN_CHUNK, MAX_CHUNK = 16, 512
#: A cut is a place whose hash bits below bit WINDOW are zero: one in 2**CUT_BITS bytes, less what MIN_CHUNK forbids.
#: A cut depends on the last WINDOW + MIN_CHUNK bytes, so a repeat is cut alike from there on.
CUT_BITS, WINDOW = 4, 16
MIN_RUN = 120
PASS_BYTES = 4 << 20
GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + GEAR[data[i]] modulo 2**32, for all i at once by doubling."""
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):
        h[s:] += h[:-s] << np.uint32(s)
    return h


def cuts_of(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of the texts at [starts, ends) in ``data``: (text, begin, end), in order."""
    h = gear_hash(np.frombuffer(data, np.uint8))
    hit = np.flatnonzero(h >> np.uint32(WINDOW - CUT_BITS) & np.uint32((1 << CUT_BITS) - 1) == 0) + 1  # a cut stands behind its byte
    own = np.searchsorted(starts, hit - 1, side="right") - 1
    inside = (hit - starts[own] >= WINDOW) & (hit < ends[own])  # the first bytes' hashes see what stands before the text
    hit, own = hit[inside], own[inside]
    lonely = np.ones(len(hit), bool)
    lonely[1:] = (np.diff(hit) >= MIN_CHUNK) | (own[1:] != own[:-1])
    hit, own = hit[lonely], own[lonely]
    some = np.flatnonzero(ends > starts)
    begin = np.concatenate([starts[some], hit])
    text = np.concatenate([some, own])
    order = np.lexsort((begin, text))
    begin, text = begin[order], text[order]
    last = np.ones(len(text), bool)
    last[:-1] = text[1:] != text[:-1]
    end = np.append(begin[1:], 0)
    end[last] = ends[text[last]]
    pieces = -(-(end - begin) // MAX_CHUNK)
    if len(pieces) and pieces.max() > 1:
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        text, b, e = np.repeat(text, pieces), np.repeat(begin, pieces) + k * MAX_CHUNK, np.repeat(end, pieces)
        begin, end = b, np.minimum(b + MAX_CHUNK, e)
    return text, begin, end


def chunk_table(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text) -> a row per chunk, and before them one per text with off -1 and its length."""
    ship(spark)

    def chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        def flush(rids, ids, parts):
            size = np.array([len(x) for x in parts], np.int64)
            ends = np.cumsum(size)
            data = b"".join(parts)
            text, b, e = cuts_of(data, ends - size, ends)
            digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[x:y]) for x, y in zip(b.tolist(), e.tolist(), strict=True)]), ">i8").reshape(-1, 2).astype(np.int64)
            heads = pd.DataFrame({"rid": rids, "doc_id": ids, "off": np.int32(-1), "len": size.astype(np.int32), "hi": np.int64(0), "lo": np.int64(0)})
            rows = pd.DataFrame({"rid": np.array(rids)[text], "doc_id": pd.Series(ids, dtype="Int64").take(text).reset_index(drop=True), "off": (b - (ends - size)[text]).astype(np.int32), "len": (e - b).astype(np.int32), "hi": digest[:, 0], "lo": digest[:, 1]})
            return pd.concat([heads.astype({"doc_id": "Int64"}), rows], ignore_index=True)

        for pdf in batches:
            rids, ids, parts, total = [], [], [], 0
            for r, d, t in zip(pdf["rid"], pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                rids.append(r)
                ids.append(d)
                parts.append(t.encode("utf-8", "surrogatepass") if t else b"")
                total += len(parts[-1])
                if total >= PASS_BYTES:
                    yield flush(rids, ids, parts)
                    rids, ids, parts, total = [], [], [], 0
            if rids:
                yield flush(rids, ids, parts)

    return docs.mapInPandas(chunk, "rid long, doc_id long, off int, len int, hi long, lo long")


SPANS = "n_chunks int, n_shared int, shared_bytes long, removed_bytes long, spans array<struct<start:int,end:int>>, owners array<long>"


def _runs(own: pd.Series) -> pd.DataFrame:
    rows = []
    for pieces in own:
        pieces = sorted((p["off"], p["len"], p["first"], p["owner"]) for p in pieces)
        runs: list[list] = []
        for p in pieces:
            if runs and runs[-1][-1][0] + runs[-1][-1][1] == p[0]:
                runs[-1].append(p)
            else:
                runs.append([p])
        runs = [r for r in runs if sum(p[1] for p in r) >= MIN_RUN]
        spans: list[list[int]] = []
        for p in (p for r in runs for p in r if not p[2]):
            if spans and spans[-1][1] == p[0]:
                spans[-1][1] += p[1]
            else:
                spans.append([p[0], p[0] + p[1]])
        owners = sorted({int(p[3]) for r in runs for p in r if not p[2] and p[3] is not None and p[3] == p[3]})
        rows.append((len(pieces), sum(map(len, runs)), sum(p[1] for r in runs for p in r), sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], owners))
    return pd.DataFrame(rows, columns=["n_chunks", "n_shared", "shared_bytes", "removed_bytes", "spans", "owners"])


def shared_spans(spark: SparkSession, docs: DataFrame, store: Store) -> DataFrame:
    """(rid, doc_id, text) -> per row: n_bytes, n_shared chunks in runs, shared_bytes, removed_bytes,
    spans (bytes to remove) and owners (ids of the documents whose earlier copies stay)."""
    chunks = store.stage(chunk_table(spark, docs), "chunks")
    body = chunks.where("off >= 0")
    key = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid", "off")
    many = body.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")
    again = body.join(many, ["hi", "lo"]).select("rid", "off", "len", ((F.col("first.rid") == F.col("rid")) & (F.col("first.off") == F.col("off"))).alias("first"), F.col("first.doc_id").alias("owner"))
    heads = chunks.where("off < 0").select("rid", "doc_id", F.col("len").alias("n_bytes"))
    none = F.lit(None)
    rows = heads.select("rid", "doc_id", "n_bytes", none.cast("struct<off:int,len:int,first:boolean,owner:long>").alias("p")).unionByName(
        again.select("rid", none.cast("long").alias("doc_id"), none.cast("int").alias("n_bytes"), F.struct("off", "len", "first", "owner").alias("p"))
    )
    per = rows.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.collect_list("p").alias("p"))
    runs = F.pandas_udf(_runs, SPANS)
    return per.select("rid", "doc_id", "n_bytes", runs("p").alias("r")).select("rid", "doc_id", "n_bytes", F.col("r.n_shared"), F.col("r.shared_bytes"), F.col("r.removed_bytes"), F.col("r.spans"), F.col("r.owners"))


def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, own in zip(texts, spans, strict=True):
        if own is None or not len(own):
            out.append(t)
            continue
        data, at, kept = t.encode("utf-8", "surrogatepass"), 0, []
        for s in own:
            kept.append(data[at : s["start"]])
            at = s["end"]
        out.append(b"".join([*kept, data[at:]]).decode("utf-8", "ignore"))  # a character cut in two goes
    return pd.Series(out, dtype=object)


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; all columns stay."""
    store = Store(spark, "chunks")
    kept = store.stage(docs.withColumn("__tessera_rid", F.monotonically_increasing_id()), "docs")
    spans = shared_spans(spark, kept.select(F.col("__tessera_rid").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text"), store).select(F.col("rid").alias("__tessera_rid"), F.col("spans").alias("__tessera_spans"))
    out = kept.join(spans.where(F.size("__tessera_spans") > 0), "__tessera_rid", "left")
    text = F.pandas_udf(cut, "string")(F.col("text"), F.col("__tessera_spans"))
    return out.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return shared_spans(spark, docs, Store(spark, "chunks")).drop("rid")
