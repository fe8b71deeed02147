"""SimHash near-duplicates, exact within a Hamming radius, by a distributed vantage-point tree.

1. Each text's 64-bit fingerprint is the bitwise majority of the XXH64 of its word shingles.
2. Equal fingerprints collapse to one row (combined before the shuffle), so copies cost nothing.
3. A vantage-point tree is fitted on a bounded sample. Its leaves are shards of Hamming space. A
   fingerprint at distance d from a node's vantage point goes inside if d <= mu + r and outside if
   d > mu: by the triangle inequality two fingerprints within r of one another meet in some leaf.
4. A leaf compares its members in blocks, ordered by their distance to one vantage point, and skips
   what the triangle bound |d1 - d2| > r excludes. It emits links to one member of each connected
   group, never all pairs. A leaf of more than ``LEAF_ROWS`` is cut into chunks and each pair of
   chunks is a task of its own, so no task holds an unbounded leaf.
5. Components of those links give every fingerprint its group.

Defined results: null, empty and word-less texts have fingerprint zero and are linked like any other;
rows with equal texts share a component; a null id never is a component's name unless the component
has no other; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.store import Store, ship, table, tidy

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Sending a fingerprint to one more leaf (some microseconds) costs about so many comparisons (a nanosecond each);
#: a node is split where that pays.
ROW_COST = 8_000
#: The sample that the tree is fitted on: one in SAMPLE_SHARE, at most SAMPLE_MAX (8 MB).
SAMPLE_SHARE, SAMPLE_MAX, SAMPLE_MIN = 32, 1 << 20, 256
#: A leaf of more rows than this is compared in chunks of this size, one task for each pair of chunks.
LEAF_ROWS = 60_000


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The majority bits of a text's shingle hashes, as an unsigned number."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only A-Z change, only ASCII space splits
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[: n - shingle]]).tolist()
    hash_ = xxhash.xxh64_intdigest
    h = np.array([hash_(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(h)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprint(spark: SparkSession, text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""
    ship(spark)

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, shingle) for t in texts], np.uint64).astype(np.int64))

    return simhash.asNondeterministic()(text)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VPTree:
    """Nodes as arrays: vantage point, mu, children; a child below zero is leaf ``-child - 1``."""

    def __init__(self, sample: np.ndarray, n: int, radius: int = RADIUS, row_cost: int = ROW_COST, seed: int = 7):
        """``sample`` of ``n`` fingerprints. A node's cost is that of its rows and of its pairs, by the sample's estimate."""
        self.radius, self.leaves, self.scale, self.row_cost = radius, 0, n / max(1, len(sample)), row_cost
        self.points: list[int] = []
        self.mus: list[int] = []
        self.kids: list[list[int]] = []
        self.rng = np.random.default_rng(seed)
        self.root = self._grow(np.sort(sample.astype(np.uint64)))
        del self.rng

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _cost(self, rows: int) -> float:
        n = rows * self.scale
        return n * self.row_cost + n * n / 2

    def _grow(self, s: np.ndarray) -> int:
        if len(s) < 8:
            return self._leaf()
        best = None
        for v in self.rng.choice(s, min(6, len(s)), replace=False):
            counts = np.cumsum(np.bincount(_distance(s, v), minlength=65))
            for mu in range(64 - self.radius):
                inside, outside = int(counts[mu + self.radius]), len(s) - int(counts[mu])
                cost = self._cost(inside) + self._cost(outside)
                if counts[mu] and outside and (best is None or cost < best[0]):
                    best = (cost, int(v), mu)
        if best is None or best[0] >= 0.95 * self._cost(len(s)):
            return self._leaf()
        _, v, mu = best
        d = _distance(s, np.uint64(v))
        me = len(self.points)
        self.points.append(v)
        self.mus.append(mu)
        self.kids.append([0, 0])
        self.kids[me][0] = self._grow(s[d <= mu + self.radius])
        self.kids[me][1] = self._grow(s[d > mu])
        return me

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``fps`` and the leaves that each belongs to (several for one near a boundary)."""
        where, leaf = [], []
        todo = [(self.root, np.arange(len(fps)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                where.append(at)
                leaf.append(np.full(len(at), -node - 1, np.int64))
                continue
            d = _distance(fps[at], np.uint64(self.points[node]))
            todo.append((self.kids[node][0], at[d <= self.mus[node] + self.radius]))
            todo.append((self.kids[node][1], at[d > self.mus[node]]))
        if not where:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(where), np.concatenate(leaf)


def link_groups(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly what pairs within ``radius`` connect: among ``a``, or between ``a`` and ``b``.

    Rows are ordered by distance to one vantage point and compared in blocks; a block only sees the
    columns whose distance the triangle bound allows. Returns (member, representative) pairs."""
    both = np.unique(a if b is None else np.concatenate([a, b]))
    if len(both) < 2:
        return both[:0], both[:0]
    rows, cols = (np.searchsorted(both, a), np.searchsorted(both, a if b is None else b))
    v = both[0]
    rows = rows[np.argsort(_distance(both[rows], v), kind="stable")]
    cols = cols[np.argsort(_distance(both[cols], v), kind="stable")]
    dr, dc = _distance(both[rows], v).astype(np.int64), _distance(both[cols], v).astype(np.int64)
    parent = np.arange(len(both))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    step = 512
    label = parent.copy()
    for i in range(0, len(rows), step):
        r = rows[i : i + step]
        lo, hi = np.searchsorted(dc, dr[i] - radius), np.searchsorted(dc, dr[min(i + step, len(rows)) - 1] + radius, side="right")
        if b is None:
            lo = max(lo, i)  # earlier columns have seen these rows
        if lo >= hi:
            continue
        c = cols[lo:hi]
        near = _distance(both[r][:, None], both[c][None, :]) <= radius
        if b is None:
            near[np.arange(len(r)), np.arange(len(r)) + i - lo] = False
        for k in np.flatnonzero(near.any(axis=1)):
            mine, own = find(int(r[k])), c[near[k]]
            for other in np.unique(label[own]):
                other = find(int(other))
                if other != mine:
                    low, high = (mine, other) if mine < other else (other, mine)
                    parent[high] = low
                    mine = low
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
        label = parent.copy()
    moved = np.flatnonzero(label != np.arange(len(both)))
    return both[moved], both[label[moved]]


def _as_unsigned(s: pd.Series) -> np.ndarray:
    return s.to_numpy(np.int64).astype(np.uint64)


def near_links(spark: SparkSession, fps: DataFrame, store: Store, radius: int = RADIUS, row_cost: int = ROW_COST, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``fps``: stored distinct (fp). Returns links (a, b) that connect what lies within ``radius``."""
    ship(spark)
    n = fps.count()
    want = max(SAMPLE_MIN, min(SAMPLE_MAX, n // SAMPLE_SHARE))
    keep = min(1.0, want / max(n, 1))
    sample = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(keep * (1 << 30))).limit(2 * SAMPLE_MAX).toPandas()["fp"]
    tree = VPTree(_as_unsigned(sample), n, radius, row_cost)
    sent = spark.sparkContext.broadcast(tree)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = _as_unsigned(pdf["fp"])
            at, leaf = sent.value.route(fp)
            yield pd.DataFrame({"leaf": leaf, "fp": fp[at].astype(np.int64)})

    placed = store.stage(fps.select("fp").mapInPandas(route, "leaf long, fp long"), "leaves")
    sizes = placed.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / leaf_rows).cast("int").alias("parts"))
    placed = placed.join(F.broadcast(sizes), "leaf")  # a row a leaf: at most the sample's size, 16 MB
    part = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    # chunk k of a leaf goes to the tasks (leaf, i, j) with i <= j and k in {i, j}; a leaf of one chunk has the task (0, 0)
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(F.col("k"), o).alias("i"), F.greatest(F.col("k"), o).alias("j")))
    tasks = placed.withColumn("k", part).withColumn("cell", F.explode(cells)).select("leaf", "cell.i", "cell.j", "k", "fp")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, k, i, j = _as_unsigned(pdf["fp"]), pdf["k"].to_numpy(), pdf["i"].iloc[0], pdf["j"].iloc[0]
        a, b = link_groups(fp, None, radius) if i == j else link_groups(fp[k == i], fp[k == j], radius)
        return pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64)})

    return tasks.groupBy("leaf", "i", "j").applyInPandas(link, "a long, b long")


def group_fingerprints(spark: SparkSession, prints: DataFrame, store: Store, radius: int = RADIUS) -> DataFrame:
    """``prints``: stored (doc_id, fp). Returns one row per distinct fp: fp, component_id."""
    own = store.stage(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fps")
    roots = connected_components(spark, near_links(spark, own.select("fp"), store, radius), store)
    named = own.join(roots, own["fp"] == roots["node"], "left").select(own["fp"], "rep", F.coalesce("root", own["fp"]).alias("root"))
    named = store.stage(named, "named")
    low = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return named.join(low, "root").select("fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "simhash")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = store.stage(docs.select("doc_id", fingerprint(spark, F.col("text")).alias("fp")), "prints")
    return prints.join(group_fingerprints(spark, prints, store), "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


#: Near copies by word shingles: shingle length and Jaccard similarity.
NEAR_SHINGLE, SIMILARITY = 5, 0.8
#: MinHash bands and minima a band: a pair at the similarity 0.8 is met with probability 0.9998, at any length.
BANDS, ROWS = 16, 4
SALTS = np.random.Generator(np.random.PCG64(20240301)).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
#: A bucket of more texts, or of more shingles, than this is compared in chunks, one task for each pair of chunks.
CHUNK_ROWS, CHUNK_SHINGLES = 512, 1 << 21
#: Ids up to this count are sent to the executors (they are counted first); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def shingle_set(text: str | None, size: int = NEAR_SHINGLE) -> set[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def shingle_hashes(text: str | None, size: int = NEAR_SHINGLE) -> np.ndarray:
    """The 64-bit hashes of a text's distinct shingles, sorted."""
    import xxhash

    own = shingle_set(text, size)
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of a set's minima."""
    import xxhash

    least = np.full(len(SALTS), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 4096):  # bounds the matrix of a long text
        x = (hashes[at : at + 4096, None] ^ SALTS[None, :]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        np.minimum(least, x.min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(m.tobytes(), b) for b, m in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def link_alike(ids: np.ndarray, sets: list[np.ndarray], roots: np.ndarray, chunk: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Links that connect exactly what pairs at ``similarity`` or more connect, beside what ``roots`` connects already.

    A pair is left out only where both texts are of one component; with ``chunk``, pairs in one chunk are, too."""
    size = np.array([len(x) for x in sets], np.int64)
    starts = np.cumsum(size) - size
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark, label, out = np.zeros(len(known), bool), np.unique(roots, return_inverse=True)[1], []
    for i in range(len(ids) - 1):
        todo = label != label[i]
        todo[: i + 1] = False
        if chunk is not None:
            todo &= chunk != chunk[i]
        if not todo.any():
            continue
        own = flat[starts[i] : starts[i] + size[i]]
        mark[own] = True
        shared = np.add.reduceat(mark[flat], starts, dtype=np.int64)
        mark[own] = False
        met = np.flatnonzero(todo & (shared >= similarity * (size[i] + size - shared)))
        groups, one = np.unique(label[met], return_index=True)
        out += [(int(ids[i]), int(ids[j])) for j in met[one]]
        label[np.isin(label, groups)] = label[i]
    return out


def near_copies(spark: SparkSession, rows: DataFrame, names: DataFrame, store: Store, similarity: float = SIMILARITY, shingle: int = NEAR_SHINGLE, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``rows``: stored (u, text), u a row's own name. ``names``: stored (tid, u), a number for each different
    text and one row that holds it. Returns links (a, b) of tids that connect what pairs of texts sharing
    ``similarity`` of their word shingles connect.

    Texts with equal shingle sets collapse to one. Texts whose SimHash fingerprints (of the same shingles) are
    of one component of the vantage-point tree's links share a bucket. At five words and 0.8 two fingerprints
    differ in some ten bits, where no metric tree prunes any more, so texts that agree in a band of MinHash
    minima share a bucket, too. Every pair of a bucket is held against the exact Jaccard index of the shingles'
    64-bit hashes unless the two are of one component by then. A bucket cut into chunks compares each
    chunk by itself, then the first with all others, then those pairs of chunks that are not yet of one
    component."""
    ship(spark)

    @F.pandas_udf("hi long, lo long, size long, fp long, bands array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for texts in batches:
            own = [shingle_hashes(t, shingle) for t in texts]
            key = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h.tobytes()) for h in own), ">i8").reshape(-1, 2).astype(np.int64)
            fp = np.array([fingerprint_of(t, shingle) for t in texts], np.uint64).astype(np.int64)
            yield pd.DataFrame({"hi": key[:, 0], "lo": key[:, 1], "size": [len(h) for h in own], "fp": fp, "bands": [band_keys(h).astype(np.int64) for h in own]})
        tidy()

    @F.pandas_udf("array<long>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_hashes(t, shingle).astype(np.int64) for t in texts])
        tidy()

    some = store.stage(rows.join(names, "u").select("tid", "u", sketch.asNondeterministic()("text").alias("s")).select("tid", "u", "s.*"), "sketches")
    first = some.groupBy("hi", "lo").agg(F.min("tid").alias("rep"), F.count("*").alias("n"))
    same = store.stage(some.select("tid", "hi", "lo").join(first.where("n > 1"), ["hi", "lo"]).where("tid <> rep").select(F.col("tid").alias("a"), F.col("rep").alias("b")), "same")
    alone = store.stage(some.join(same.select(F.col("a").alias("tid")), "tid", "left_anti").select("tid", "size", "fp", "bands"), "alone")
    groups = store.stage(group_fingerprints(spark, alone.select(F.col("tid").alias("doc_id"), "fp"), store), "groups")
    each = alone.select("tid", "size", F.explode("bands").alias("bucket")).unionByName(alone.join(groups, "fp").select("tid", "size", F.xxhash64("component_id", F.lit(0)).alias("bucket")))
    of = lambda k: F.bit_xor(F.xxhash64("tid", F.lit(k)))
    shared = each.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("size"), of(1).alias("x"), of(2).alias("y")).where("n > 1")
    shared = shared.groupBy("n", "size", "x", "y").agg(F.min("bucket").alias("bucket"))  # buckets of the same texts once
    parts = F.greatest(F.ceil(F.col("n") / chunk_rows), F.ceil(F.col("size") / CHUNK_SHINGLES)).cast("int")
    members = each.select("tid", "bucket").join(shared.select("bucket", parts.alias("parts")), "bucket")
    members = store.stage(members.withColumn("k", F.pmod(F.xxhash64("tid", F.lit(3)), F.col("parts")).cast("int")), "members")
    need = store.stage(members.select("tid").distinct().join(some.select("tid", "u"), "tid"), "need")
    few = need.count() <= BROADCAST_IDS
    sets = store.stage(rows.select("u", "text").join(F.broadcast(need) if few else need, "u").select("tid", hashes.asNondeterministic()("text").alias("h")), "sets")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [np.asarray(h, np.int64) for h in pdf["h"]]
        chunk = None if pdf["i"].iloc[0] == pdf["j"].iloc[0] else pdf["k"].to_numpy()
        return pd.DataFrame(link_alike(pdf["tid"].to_numpy(), own, pdf["root"].to_numpy(), chunk, similarity), columns=["a", "b"]).astype(np.int64)

    def meet(tasks: DataFrame) -> DataFrame:
        return store.stage(tasks.join(sets, "tid").groupBy("bucket", "i", "j").applyInPandas(link, "a long, b long"), "links")

    links = same.unionByName(meet(members.select("bucket", F.col("k").alias("i"), F.col("k").alias("j"), "k", "tid", F.col("tid").alias("root"))))
    large = members.where("parts > 1")
    if large.isEmpty():
        return links
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(F.col("k"), o).alias("i"), F.greatest(F.col("k"), o).alias("j")))
    for which in ("i = 0 AND j > 0", "i > 0 AND j > i"):
        roots = store.stage(connected_components(spark, links, store), "roots")
        now = large.join(roots, large["tid"] == roots["node"], "left").select("bucket", "k", "tid", F.coalesce("root", "tid").alias("root"), F.explode(others).alias("c"))
        now = now.select("bucket", "c.i", "c.j", "k", "tid", "root").where(which)
        apart = now.groupBy("bucket", "i", "j").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket", "i", "j")
        links = links.unionByName(meet(now.join(apart, ["bucket", "i", "j"])))
    return links


def without_near_copies(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id; all columns stay.

    Of a group's rows with one id, the one with the smallest hash of its columns stays. The row is
    found by grouped minima, combined before the shuffle, and taken out by its own name, so no group
    meets in one task. Texts are told apart by 128 bits of hashes and numbered, so no two share a name.
    Null texts count as empty ones, null ids come last, and an empty table gives an empty result."""
    store = Store(spark, "simhash")
    rest = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), rest.alias("h"), F.expr("uuid()").alias("u"))
    text = F.coalesce("text", F.lit(""))
    known = F.struct(F.xxhash64(text).alias("hi"), F.xxhash64(F.lit(1), text).alias("lo"))
    kept = store.stage(docs.withColumn("__tessera_known", known).withColumn("__tessera_row", key), "rows")
    named = kept.groupBy("__tessera_known").agg(F.min("__tessera_row").alias("row"))
    named = store.stage(named.select(F.monotonically_increasing_id().alias("tid"), "row"), "names")
    links = near_copies(spark, kept.select(F.col("__tessera_row.u").alias("u"), "text"), named.select("tid", F.col("row.u").alias("u")), store, similarity, shingle)
    roots = store.stage(connected_components(spark, links, store), "roots")
    best = named.join(roots, named["tid"] == roots["node"], "left").groupBy(F.coalesce("root", "tid").alias("root")).agg(F.min("row").alias("row"))
    best = store.stage(best.select(F.col("row.u").alias("__tessera_u")), "best")
    return kept.join(best, kept["__tessera_row"]["u"] == best["__tessera_u"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
