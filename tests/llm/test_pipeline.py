"""The pipeline's stages against brute force and each other."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, mixing, simhash, tokens, toxicity
from tests.llm.test_ops import components, empty, odd  # noqa: F401


def through(spark, sf_dir, root):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = out[name] = spark.read.parquet(f"{root}/{name}")
    return out


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    return through(spark, sf, tmp_path_factory.mktemp("stages"))


def test_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mix_sources", "token_output"]
    assert all(stages[n].columns == stages["input"].columns for n in names[:-1])


def test_toxicity_keeps_clean(spark, stages, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    gone = stages["input"].join(stages["toxicity"], "doc_id", "left_anti").join(labels, "doc_id")
    clean = labels.where("toxic = 0").count()
    assert gone.where("toxic = 1").count() > 0 and gone.where("toxic = 0").count() <= 0.02 * clean


def test_toxicity_stage_takes_what_the_operator_rejects(spark, stages, sf):
    rejected = toxicity.op1_toxicity(spark, sf).where("predicted = 1").select("doc_id")
    gone = stages["input"].join(stages["toxicity"], "doc_id", "left_anti").select("doc_id")
    assert {r.doc_id for r in gone.collect()} == {r.doc_id for r in rejected.collect()}
    toxic = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1")
    assert 3 * toxic.join(gone, "doc_id").count() >= 2 * toxic.count()  # what the operator itself reaches on so small a table


def test_near_dedup_brute_force(stages):
    rows = stages["toxicity"].select("doc_id", "text").collect()
    s = [simhash.shingle_set(r.text) for r in rows]
    inverted = collections.defaultdict(list)
    for i, x in enumerate(s):
        for g in x:
            inverted[g].append(i)
    pairs = [(i, j) for i, x in enumerate(s) for j, n in collections.Counter(j for g in x for j in inverted[g] if j < i).items() if n >= 0.8 * (len(x) + len(s[j]) - n)]
    first = {}
    for i, c in enumerate(components(len(rows), pairs)):
        first[c] = min(first.get(c, 1 << 60), rows[i].doc_id)
    want, got = set(first.values()), {r.doc_id for r in stages["simhash_near_dedup"].select("doc_id").collect()}
    assert not want - got and len(got - want) <= 0.05 * (len(rows) - len(want))


def test_decontamination_takes_effect(spark, stages, sf):
    bench = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = lambda t: any(b in decontaminate.normal(t) for b in bench)
    before = {r.doc_id for r in stages["simhash_near_dedup"].collect() if hit(r.text)}
    after = {r.doc_id for r in stages["benchmark_decontamination"].collect()}
    gone = {r.doc_id for r in stages["simhash_near_dedup"].collect()} - after
    assert before and gone == before


def test_mix_and_tokens(spark, stages):
    given, mixed = stages["benchmark_decontamination"], stages["mix_sources"]
    sizes = given.select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
    from tessera.store import Store

    want = {r.doc_id: r.copies for r in mixing.plan_mix(spark, Store(spark, "t").stage(sizes, "s")).collect() if r.copies}
    assert dict(collections.Counter(r.doc_id for r in mixed.collect())) == want
    rows = stages["token_output"].orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in mixed.collect())
    starts = np.cumsum([0] + [r.n_tokens for r in rows])
    assert [r.start for r in rows] == starts[:-1].tolist()
    enc = tokens.Encoder(tokens.default_tokenizer(), 2)
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert all(r.n_tokens == len(enc.encode(texts[r.doc_id])) // 2 for r in rows)


def test_odd_and_empty(spark, odd, empty, tmp_path):  # noqa: F811
    got = through(spark, odd, tmp_path / "odd")
    assert got["simhash_near_dedup"].count() <= 14
    assert through(spark, empty, tmp_path / "empty")["token_output"].count() == 0


def words(rng, n, name):
    return [f"{name}{x}" for x in rng.integers(1 << 40, size=n)]


@pytest.mark.parametrize("chunk_rows", [60, 512])
def test_near_copies_star(spark, chunk_rows):
    """Copies of one base that are not alike among themselves, and one set of words in many orders: one group each."""
    from tessera.store import Store

    rng = np.random.default_rng(3)
    base = words(rng, 1000, "b")
    texts = [" ".join(base)]
    for _ in range(300):
        copy = list(base)
        for at in np.arange(15) * 66 + rng.integers(0, 60):
            copy[at] = words(rng, 1, "c")[0]
        texts.append(" ".join(copy))
    sets = [simhash.shingle_set(t) for t in texts]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert all(alike(sets[0], x) for x in sets[1:]) and not any(alike(sets[1], x) for x in sets[2:12])
    blocks = [words(rng, 100, "o") for _ in range(8)]
    orders = [[blocks[i] for i in rng.permutation(8)] for _ in range(30)]
    texts += [" ".join(w for b in o for w in b) for o in orders]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = Store(spark, "test").stage(df.select(F.xxhash64("text").alias("tid"), "text", F.col("doc_id").cast("string").alias("u")), "rows")
    links = simhash.near_copies(spark, rows.select("u", "text"), rows.select("tid", "u"), Store(spark, "test"), chunk_rows=chunk_rows).collect()
    at = {r.tid: int(r.u) for r in rows.collect()}
    sets = [simhash.shingle_set(t) for t in texts]
    pairs = [(i, 0) for i in range(1, 301)] + [(i, j) for i in range(301, 331) for j in range(301, i) if alike(sets[i], sets[j])]
    want = components(len(texts), pairs)
    assert components(len(texts), [(at[r.a], at[r.b]) for r in links]) == want
    assert len(set(want[:301])) == 1


@pytest.mark.parametrize("n", [100, 500, 1000, 5000])
def test_near_copies_meet_at_any_length(n):
    """Nearly all pairs just at the similarity share a band."""
    rng = np.random.default_rng(n)
    pairs, met = 0, 0
    while pairs < 150:
        a = words(rng, n, "a")
        b = list(a)
        for at in rng.choice(n, max(1, round(n * 0.0212)), replace=False):
            b[at] = words(rng, 1, "b")[0]
        x, y = simhash.shingle_hashes(" ".join(a)), simhash.shingle_hashes(" ".join(b))
        both = len(np.intersect1d(x, y))
        if 0.8 <= both / (len(x) + len(y) - both) <= 0.84:
            pairs, met = pairs + 1, met + (simhash.band_keys(x) == simhash.band_keys(y)).any()
    assert met >= 0.99 * pairs
