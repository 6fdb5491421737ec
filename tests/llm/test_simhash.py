import random
from collections import defaultdict

from pyspark.sql import functions as F

from evispark.llm import simhash
from evispark.llm.queries import op7_simhash
from evispark.session import table
from tests.llm.brute import components, fingerprint, odd_docs

SF = "/root/testdata/sf0.001"


def test_query_equals_brute_force(spark):
    fps, of = defaultdict(list), {}
    for r in table(spark, SF, "documents").collect():
        of[r.doc_id] = fingerprint(r.text)
        fps[of[r.doc_id]].append(r.doc_id)
    roots = components(fps, simhash.RADIUS)
    rows = op7_simhash(spark, SF).collect()
    assert len(rows) == len(of)
    for r in rows:
        assert r.fingerprint == f"{of[r.doc_id]:016x}" and r.component_id == roots[of[r.doc_id]]


def test_every_pair_within_the_radius_meets_in_a_table():
    rng, masks = random.Random(2), simhash.tables(4)
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
        assert any(m & diff == 0 for m in masks)


def test_hubs_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 3)
    rng = random.Random(9)
    pairs = [(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(400, 460)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    pairs += [(-5, 299), (450, 299)]
    parent = list(range(1300))
    find = lambda x: x if x < 0 or parent[x] == x else find(parent[x])
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs for x in p if p[0] != p[1]}
    assert got == {x: find(x) for x in nodes}


def test_a_chain_of_any_length_is_one_component(spark):
    got = simhash.components(spark.createDataFrame([(k, k + 1) for k in range(700)], "a long, b long")).collect()
    assert len(got) == 701 and {r.root for r in got} == {0}


def test_one_fingerprint_of_most_rows(spark, monkeypatch):
    """Rows of a hot fingerprint stay in their partitions."""
    monkeypatch.setattr(simhash, "HOT_ROWS", 50)
    monkeypatch.setattr(simhash, "HOT_SHARE", 10)
    docs = spark.createDataFrame([(k, "the same text for all" if k % 3 else f"text {k} of its own here") for k in range(600)], "doc_id long, text string").repartition(6, "doc_id")
    out = simhash.near_duplicates(docs)
    assert len({r.component_id for r in out.where("doc_id % 3 <> 0").collect()}) == 1
    same = out.where("doc_id % 3 <> 0").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(same) > 1 and max(r["count"] for r in same) < 400


def test_crowded_runs_lose_no_link(spark, monkeypatch):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centres for _ in range(40)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = components({v: [k] for k, v in enumerate(signed)}, 4)
    for limit, few in ((50_000, 100_000), (7, 100_000), (7, 2)):
        monkeypatch.setattr(simhash, "FEW", few)
        edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), run_limit=limit)
        got = {r.node: r.root for r in simhash.components(edges).collect()}
        groups, wanted = defaultdict(set), defaultdict(set)
        for v in signed:
            groups[got.get(v, v)].add(v)
            wanted[want[v]].add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_odd_rows(spark):
    docs = odd_docs(spark, "fp string, component_id string")
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by_text = {r.fp: r.component_id for r in rows}
    assert by_text[0] == 0  # null, empty and blank texts share fingerprint zero
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_few_edges_take_few_tasks(spark, monkeypatch):
    """Rounds over few edges write few files, however many partitions an exchange has; what they find is the same."""
    kept, made = simhash.cut_lineage, []

    def cut(df):
        made.append(kept(df))
        return made[-1]

    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 300) if k % 10], "a long, b long")
    monkeypatch.setattr(simhash, "cut_lineage", cut)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r.node: r.root for r in simhash.components(edges).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {k: (k - 1) // 10 * 10 + 1 for k in range(1, 301)}
    assert len(made) > 4 and all(df.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism for df in made[1:])
