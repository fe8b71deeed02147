"""Fuzzy line deduplication by MinHash (DataFrame operations only).

1. Lines with a word are normalised (lower case, single spaces) and equal lines collapse, combined
   before the shuffle, so a line that a third of the documents carry is one row.
2. A line's set holds the ``SHINGLE`` characters from every place in it. Each shingle is hashed once;
   a minimum is that of the hashes xor a constant, so all ``MINIMA`` come from one pass over the
   shingles in the stage that holds the line. Lines of ``THIN`` shingles or more take their minima over
   the quarter of their shingles whose hash ends in 00; those under ``THIN / SIMILARITY`` over both sets,
   so any two lines that may be alike have a kind in common.
3. Lines that agree in a band of ``ROWS`` minima share a bucket. ``BANDS`` bands reuse the minima.
4. A bucket's lines meet its smallest line; a pair counts once over all bands. Lines that are not of its
   component by then meet, block by block, all lines of other components in the bucket, so no pair across
   components is left unchecked; at most ``FEW`` pairs of a line and block are written out.
5. Pairs of which ``AGREE`` minima agree are verified by the exact Jaccard index of the shingle sets (within
   blocks, a bitmap of the sets first rules out pairs that cannot share enough).
6. Star rounds (large-star and small-star) join the links into components; of each component the
   first line by (doc_id, position) stays.

Lines and shingles are known by 64-bit hashes. Only pairs are probabilistic: ``recall`` in the tests
holds them against all pairs.

Defined results: null and empty texts have no lines; lines without a word are left alone; a line
shorter than a shingle is its own only shingle; rows that share an id are separate documents, ordered
by a row number within ties; null ids come last; an empty table gives an empty result. Other columns
are not read by ``fuzzy_lines`` and pass through ``without_repeated_lines`` untouched.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.store import Store, table

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at the similarity 0.8 is met with probability 0.95, at 0.85 with 0.99, at 0.9 with 0.999.
MINIMA, BANDS, ROWS = 32, 14, 6
#: Of the minima of a pair at the similarity 0.8, at least so many agree in all but 1 of 10,000 cases.
AGREE = 16
#: Lines with so many shingles take their minima from a quarter of them.
THIN = 256
#: Lines, and characters, of a block: a large bucket is compared block by block.
BLOCK_LINES, BLOCK_CHARS = 64, 1 << 15
#: Pairs that a line may write out for each block; more of them are verified within the block.
FEW = 32
#: Rows up to this count are sent to the executors (they are counted first, 16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_rng = np.random.Generator(np.random.PCG64(20240401))
#: Constants whose upper bits are spread evenly over the hash space.
MASKS = [int(x) for x in ((np.arange(MINIMA, dtype=np.uint64) << np.uint64(59)) ^ _rng.integers(0, 1 << 59, MINIMA, dtype=np.uint64)).astype(np.int64)]


WORDS = [f"w{i}" for i in range(MINIMA // 8)]
#: Words of the bitmap that bounds what two lines share.
BITS = [f"b{i}" for i in range(32)]


def bands(minima: int = MINIMA, count: int = BANDS, rows: int = ROWS) -> list[list[int]]:
    """Which minima form each band: every minimum serves about as often."""
    rng, out, pool = np.random.Generator(np.random.PCG64(7)), [], []
    while len(out) < count:
        if len(pool) < rows:
            pool += [int(x) for x in rng.permutation(minima)]
        band = list(dict.fromkeys(pool))[:rows]
        for x in band:
            pool.remove(x)
        out.append(sorted(band))
    return out


def normal(line: Column) -> Column:
    """Lower case, single spaces; empty for a line without a word. Bytes are looked for, as a pattern costs several times as much."""
    odd = reduce(lambda a, b: a | b, [F.contains(line, F.lit(x)) for x in ("  ", *"\t\n\v\f\r")])
    return F.lower(F.btrim(F.when(odd, F.regexp_replace(line, r"[ \t-\r]+", " ")).otherwise(line)))


def line_id(norm: Column) -> Column:
    return F.xxhash64(norm, F.lit(11))


def places(norm: Column, size: int = SHINGLE) -> Column:
    """Where the shingles of a line begin."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(norm) - size))


def shingle(wide: Column, at: Column, size: int = SHINGLE) -> Column:
    """The hash of the shingle at a place of a line in UTF-32, where any place is found at once."""
    return F.xxhash64(F.substring(wide, at * 4 + 1, F.lit(4 * size)))


def shingle_set(norm: Column, size: int = SHINGLE) -> Column:
    """The distinct shingle hashes of a line. The outer transform binds the UTF-32 form, so it is made once a line, not once a shingle."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(0), F.length(norm) - size) * 4 + 1, F.lit(4))  # bytes; equal to places()
    each = F.transform(F.array(F.encode(norm, "UTF-32")), lambda wide: F.transform(starts, lambda at: F.xxhash64(F.substring(wide, at, F.lit(4 * size)))))
    return F.array_distinct(each[0])


def signatures(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(text) -> a row for each distinct line and kind of minima: lid, norm, thin, bands, w0.. (8 bits of each
    minimum) and main, true once a line.

    The exchange that makes lines distinct serves the minima too."""
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).select(normal(F.col("line")).alias("norm"))
    # lines without a word go behind the grouping: a filter before it would normalise each line twice
    one = lines.select(line_id(F.col("norm")).alias("lid"), "norm").groupBy("lid").agg(F.min("norm").alias("norm")).where("norm <> ''")
    n, most = F.greatest(F.lit(1), F.length("norm") - size + 1), int(THIN / SIMILARITY)
    kinds = F.when(n < THIN, F.array(F.lit(False))).when(n <= most, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))
    each = one.select("lid", "norm", F.explode(kinds).alias("thin")).select("lid", "thin", F.encode("norm", "UTF-32").alias("wide"), places(F.col("norm"), size).alias("at"))
    each = each.select("lid", "thin", "wide", F.explode("at").alias("at")).select("lid", "thin", shingle(F.col("wide"), F.col("at"), size).alias("h"))
    each = each.where(~F.col("thin") | (F.col("h").bitwiseAND(F.lit(3)) == 0))
    least = each.groupBy("lid", "thin").agg(*[F.min(F.col("h").bitwiseXOR(F.lit(m))).alias(f"m{k}") for k, m in enumerate(MASKS)])
    keys = F.array(*[F.xxhash64(F.lit(b), "thin", *[f"m{k}" for k in own]) for b, own in enumerate(bands())])
    byte = lambda k: F.shiftleft(F.col(f"m{k}").bitwiseAND(F.lit(255)), 8 * (k % 8))
    words = [reduce(lambda x, y: x.bitwiseOR(y), [byte(k) for k in range(w, w + 8)]).alias(f"w{w // 8}") for w in range(0, MINIMA, 8)]
    # a line that repeats a few shingles may have none whose hash ends in 00: all such lines share a bucket
    none = [F.coalesce("thin", F.lit(True)).alias("thin"), F.coalesce("bands", F.array(F.lit(0).cast("long"))).alias("bands"), *[F.coalesce(w, F.lit(0).cast("long")).alias(w) for w in WORDS]]
    own = one.join(least.select("lid", "thin", keys.alias("bands"), *words), "lid", "left").select("lid", "norm", F.length("norm").alias("length"), *none)
    return own.withColumn("main", ~F.col("thin") | (F.col("length") - size + 1 > most))


def agreeing(x: Column, y: Column) -> Column:
    """How many of two lines' minima agree: the zero bytes of their sketches' xor."""

    def zero(w: str) -> Column:
        v = x[w].bitwiseXOR(y[w])
        for s in (4, 2, 1):
            v = v.bitwiseOR(F.shiftrightunsigned(v, s))
        return F.lit(8) - F.bit_count(v.bitwiseAND(F.lit(0x0101010101010101)))

    return reduce(lambda a, b: a + b, [zero(w) for w in WORDS])


def similar(pairs: DataFrame, lines: DataFrame, similarity: float, size: int) -> DataFrame:
    """The (a, b) whose exact Jaccard index reaches ``similarity``."""
    text = lambda c: lines.select(F.col("lid").alias(c), F.col("norm").alias(f"{c}_norm"))
    both = pairs.join(text("a"), "a").join(text("b"), "b")
    sets = both.select("a", "b", shingle_set(F.col("a_norm"), size).alias("x"), shingle_set(F.col("b_norm"), size).alias("y"))
    met = sets.select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    return met.where(F.col("both") >= similarity * (F.col("sum") - F.col("both"))).select("a", "b")


def bitmaps(lines: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(lid, norm) -> lid, m, b0..: the number of a line's distinct shingles, and the bits that their hashes set."""
    each = lines.select("lid", F.explode(shingle_set(F.col("norm"), size)).alias("h"))
    at, bit = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(len(BITS) - 1)), F.expr("shiftleft(1L, CAST(h & 63 AS INT))")
    return each.groupBy("lid").agg(F.count("*").alias("m"), *[F.bit_or(F.when(at == i, bit).otherwise(F.lit(0))).alias(b) for i, b in enumerate(BITS)])


def most_shared(x: Column, y: Column) -> Column:
    """A bound on the shingles that two lines share: each bit that only x sets stands for a shingle that y lacks."""
    return x["m"] - reduce(lambda a, b: a + b, [F.bit_count(x[i].bitwiseAND(F.bitwise_not(y[i]))) for i in BITS])


def small(df: DataFrame, stored: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if the stored table that it comes from is small enough."""
    return F.broadcast(df) if stored.count() <= BROADCAST_ROWS else df


def line_links(spark: SparkSession, lines: DataFrame, store: Store, similarity: float = SIMILARITY, size: int = SHINGLE, block_lines: int = BLOCK_LINES, few: int = FEW) -> DataFrame:
    """Links (a, b) that connect exactly what alike lines of shared buckets connect; ``lines``: stored ``signatures``.

    First each line meets the smallest of its bucket. A line that is not of that line's component then
    meets blocks of the bucket's lines. Up to ``few`` lines of a block that may be alike are written out as
    pairs; where there are more, a link is given once for each component that it joins, under the component's
    name, so no more than ``few`` pairs of a line and block are written."""
    sketch = F.struct(*WORDS).alias("s")
    each = lines.select(F.explode("bands").alias("bucket"), "lid", "thin", "length", sketch)
    shared = each.groupBy("bucket").agg(F.count("*").alias("n"), F.min("lid").alias("pivot"), F.sum("length").alias("length")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / block_lines), F.ceil(F.col("length") / BLOCK_CHARS)).cast("int").alias("blocks")
    shared = store.stage(shared.select("bucket", "n", "pivot", blocks), "buckets")
    members = store.stage(each.drop("length").join(small(shared, shared), "bucket"), "members")
    pairs = members.where("lid <> pivot").select("thin", "pivot", "lid", "s").distinct()
    pivots = store.stage(members.where("lid = pivot").select("thin", "pivot", F.col("s").alias("t")).distinct(), "pivots")
    met = pairs.join(small(pivots, pivots), ["thin", "pivot"]).where(agreeing(F.col("s"), F.col("t")) >= AGREE).select(F.col("pivot").alias("a"), F.col("lid").alias("b"))
    met = store.stage(met.distinct(), "met")
    links = store.stage(similar(met, lines_of(lines, met, store), similarity, size), "links")
    roots = store.stage(connected_components(spark, links, store), "roots")
    # a bucket's lines that are not of its smallest line's component meet the lines of other components there, block by block
    root = lambda c: small(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), roots)
    now = members.where("n > 2").join(root("lid"), "lid", "left").join(root("pivot"), "pivot", "left")
    root_of = lambda c: F.coalesce(f"{c}_root", c)
    now = now.select("bucket", "blocks", "lid", "s", root_of("lid").alias("root"), (root_of("lid") != root_of("pivot")).alias("apart"), F.pmod(F.xxhash64("lid", F.lit(5)), "blocks").cast("int").alias("k"))
    now = store.stage(now, "now")
    mine = now.where("apart").select("bucket", "lid", "root", "s", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    theirs = now.groupBy("bucket", "k").agg(F.collect_list(F.struct("root", "s", "lid", "apart")).alias("block"))
    # of two lines that are both apart, the smaller meets the larger
    once = lambda x: (x["root"] != F.col("root")) & (~x["apart"] | (x["lid"] > F.col("lid")))
    plausible = lambda x: once(x) & (agreeing(F.col("s"), x["s"]) >= AGREE)
    mine = store.stage(mine.join(theirs, ["bucket", "k"]).where(F.exists("block", plausible)).select("bucket", "k", "lid", "root", "s"), "mine")
    theirs_of = lambda df: store.stage(df.join(mine.select("bucket", "k").distinct(), ["bucket", "k"], "left_semi"), "theirs")
    blocks = theirs_of(now)
    ids = store.stage(mine.select("lid").unionByName(blocks.select("lid")).distinct(), "ids")
    active = store.stage(lines.where("main").select("lid", "norm").join(small(ids, ids), "lid", "left_semi"), "active")
    active = store.stage(active.join(bitmaps(active, size), "lid"), "bits")
    own = F.struct("m", *BITS)

    def possible(v: Column) -> Column:
        return plausible(v) & enough(v, most_shared(F.col("own"), v))

    def enough(v: Column, both: Column) -> Column:
        return both >= similarity * (F.col("own.m") + v["m"] - both)

    # what the bitmaps leave of a line's block is verified pair by pair, once over all buckets, where it is FEW lines; else within the block
    bits = active.drop("norm")
    theirs = blocks.join(bits, "lid").groupBy("bucket", "k").agg(F.collect_list(F.struct("root", "s", "lid", "apart", "m", *BITS)).alias("block"))
    near = mine.join(bits, "lid").select("bucket", "k", "lid", "root", "s", own.alias("own")).join(theirs, ["bucket", "k"])
    near = near.select("bucket", "k", "lid", "root", "s", F.transform(F.filter("block", possible), lambda v: v["lid"]).alias("of")).where(F.size("of") > 0)
    near = store.stage(near.withColumn("of", F.when(F.size("of") <= few, F.col("of"))), "near")
    pairs = near.select("lid", F.explode("of").alias("other")).select(F.least("lid", "other").alias("a"), F.greatest("lid", "other").alias("b"))
    pairs = store.stage(pairs.distinct(), "few")
    links = links.unionByName(store.stage(similar(pairs, lines_of(lines, pairs, store), similarity, size), "links"))
    mine = near.where("of IS NULL").drop("of")
    blocks = theirs_of(blocks)
    theirs = blocks.join(active, "lid").groupBy("bucket", "k").agg(F.collect_list(F.struct("root", "s", "lid", "apart", "m", *BITS, "norm")).alias("block"))
    theirs = theirs.select("bucket", "k", F.transform("block", lambda x: x.withField("x", shingle_set(x["norm"], size)).dropFields("norm")).alias("block"))
    mine = mine.join(active, "lid").repartition("bucket", "k").select("bucket", "k", "lid", "root", "s", own.alias("own"), shingle_set(F.col("norm"), size).alias("x"))
    alike = lambda v: possible(v) & enough(v, F.size(F.array_intersect(F.col("x"), v["x"])))
    found = mine.join(theirs, ["bucket", "k"]).select("lid", F.array_distinct(F.transform(F.filter("block", alike), lambda v: v["root"])).alias("roots"))
    more = found.where(F.size("roots") > 0).select(F.col("lid").alias("b"), F.explode("roots").alias("a"))
    return links.unionByName(store.stage(more.select("a", "b").distinct(), "more"))


def lines_of(lines: DataFrame, pairs: DataFrame, store: Store) -> DataFrame:
    """The lines that stand in stored (a, b) ``pairs``."""
    ids = store.stage(pairs.select(F.col("a").alias("lid")).unionByName(pairs.select(F.col("b").alias("lid"))).distinct(), "ids")
    return store.stage(lines.where("main").select("lid", "norm").join(small(ids, ids), "lid", "left_semi"), "active")


def fuzzy_lines(spark: SparkSession, docs: DataFrame, store: Store, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """(rid, doc_id, text) -> per row: doc_id, n_lines, n_dropped, dropped (positions), classes (a class id a line)."""
    links = line_links(spark, store.stage(signatures(docs.select("text"), size), "lines", "zstd"), store, similarity, size)
    roots = store.stage(connected_components(spark, links, store), "roots")
    lines = docs.select("rid", "doc_id", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    lid = F.when(F.col("norm") != "", line_id(F.col("norm")))
    # filtered once it is written, so each line is normalised once
    seen = store.stage(lines.select("rid", "doc_id", "pos", normal(F.col("line")).alias("norm")).select("rid", "doc_id", "pos", lid.alias("lid")), "seen")
    seen = seen.where("lid IS NOT NULL OR coalesce(pos, 0) = 0")
    named = seen.join(roots, seen["lid"] == roots["node"], "left").select("rid", "doc_id", "pos", F.coalesce("root", "lid").alias("class"))
    named = store.stage(named, "named")
    key = F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "rid", "pos")
    first = named.where("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")
    gone = named.join(first, "class").where("rid <> first.rid OR pos <> first.pos").select("rid", "pos")
    none = F.lit(None)
    rows = named.select("rid", "doc_id", "pos", "class", F.lit(False).alias("gone")).unionByName(
        gone.select("rid", none.cast(dict(named.dtypes)["doc_id"]).alias("doc_id"), "pos", none.cast("long").alias("class"), F.lit(True).alias("gone"))
    )
    line = ~F.col("gone") & F.col("class").isNotNull()
    per = rows.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.count_if(line).alias("n_lines"), F.count_if("gone").alias("n_dropped"),
        F.array_sort(F.collect_list(F.when(F.col("gone"), F.col("pos")))).alias("dropped"),
        F.array_sort(F.collect_list(F.when(line, F.struct("pos", "class")))).alias("of"),
    )
    return per.select("rid", "doc_id", "n_lines", "n_dropped", "dropped", F.transform("of", lambda x: x["class"]).alias("classes"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one line of each component left; all columns stay."""
    store = Store(spark, "lines")
    kept = store.stage(docs.withColumn("__tessera_rid", F.monotonically_increasing_id()), "docs")
    own = fuzzy_lines(spark, kept.select(F.col("__tessera_rid").alias("rid"), "doc_id", "text"), store, similarity)
    gone = own.where("n_dropped > 0").select(F.col("rid").alias("__tessera_rid"), F.col("dropped").alias("__tessera_gone"))
    out = kept.join(gone, "__tessera_rid", "left")
    text = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__tessera_gone", i)), "\n")
    return out.withColumn("text", F.when(F.col("__tessera_gone").isNull(), F.col("text")).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "lines")
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return fuzzy_lines(spark, docs, store).drop("rid")
