import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import codec, hashing
from tessera.functions.geometry import ceil_div, floor_div, with_positions
from tessera.operators import compaction, lookup, membership, statistics, workload
from tessera.plans.shared import new_path
from tessera.plans.store import Store
from tessera.sources import tables
from tessera.sources.config import StoreConfig
from tessera.streaming import ingest

LOG = "seq long, k long, v int, payload binary, epoch long"
BIG = (1 << 63) - 1
EDGE = [(0, -1, -1, None, 0), (1, BIG, 5, None, 0), (2, -BIG - 1, 6, None, 0), (3, 7, 1, None, 0), (4, 7, 2, None, 0), (5, 7, 3, None, 1), (6, 7, 4, None, 1), (7, 9, 8, None, 2)]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(EDGE, LOG)


def test_modes(log):
    newest = {r["k"]: r["v"] for r in lookup.latest(log).collect()}
    first = {r["k"]: r["v"] for r in lookup.latest(log, "reference").collect()}
    assert newest == {-1: -1, BIG: 5, -BIG - 1: 6, 7: 4, 9: 8}
    assert first == newest | {7: 3}
    with pytest.raises(ValueError):
        lookup.latest(log, "other")


def test_point_and_ranges(spark, log):
    view = lookup.latest(log)
    assert [r["v"] for r in lookup.point(view, -1).collect()] == [-1]
    assert lookup.point(view, 8).count() == 0
    asked = spark.createDataFrame([(7,), (8,), (7,)], "k long")
    assert rows_of(lookup.point_or_missing(view, asked)) == [(7, 4), (8, -1)]
    assert rows_of(lookup.absent(asked, view)) == [(8,)]
    assert rows_of(lookup.range_keys(view, 7, 9)) == [(7,), (9,)]
    assert rows_of(lookup.range_keys(view, 7, 7)) == [(7,)]
    assert rows_of(lookup.range_keys(view, 9, 7)) == []
    assert rows_of(lookup.range_bag(log, 0, 10)) == [(0, 7), (1, 7), (2, 9)]
    ranges = spark.createDataFrame([(-5, 7), (8, 9), (9, 8), (100, 200)], "low long, high long")
    for width in (1, 3, 1000):
        whole = spark.createDataFrame([(-BIG - 1, BIG), (-BIG - 1, -1), (BIG, BIG), (-(10**12), 10**15), (0, 1 << 40)], "low long, high long")
        assert rows_of(lookup.multi_range_counts(whole, view, width)) == sorted([(-BIG - 1, BIG, 5), (-BIG - 1, -1, 2), (BIG, BIG, 1), (-(10**12), 10**15, 3), (0, 1 << 40, 2)])
        assert lookup.multi_range(whole, view, width).count() == 13
        assert rows_of(lookup.multi_range_counts(ranges, view, width)) == [(-5, 7, 2), (8, 9, 1), (9, 8, 0), (100, 200, 0)]


def test_empty(spark):
    empty = spark.createDataFrame([], LOG)
    assert lookup.latest(empty).count() == 0
    assert lookup.as_of(empty, 3).count() == 0
    assert compaction.median_key(with_positions(empty)).count() == 0
    assert statistics.leaf_pages(with_positions(empty)).count() == 0


@pytest.mark.parametrize("mode", ["latest", "reference"])
def test_store_against_model(spark, mode):
    """Random inserts in epochs: reads equal a dict's before and after compaction, at any file skipping."""
    r = random.Random(3)
    store = Store(spark, new_path(spark, "test-store"), StoreConfig(fanout=2, use_bloom_filters=True), mode)
    assert store.latest().count() == 0 and store.runs() == [] and store.vacuum() == []
    model, snapshots, seq = {}, [], 0
    for epoch in range(4):
        batch = []
        mine = {}
        for _ in range(40):
            k, v = r.randint(-5, 30), r.randint(-2, 1000)
            batch.append((seq, k, v, None))
            if mode == "latest" or k not in mine:
                mine[k] = v
            seq += 1
        model |= mine
        snapshots.append(dict(model))
        assert store.ingest(spark.createDataFrame(batch, "seq long, k long, v int, payload binary")) == epoch
        store.maintain()
    pairs = lambda df: {x["k"]: x["v"] for x in df.collect()}
    for _ in range(2):
        assert pairs(store.latest()) == model
        assert pairs(store.get(7)) == {k: v for k, v in model.items() if k == 7}
        assert pairs(store.range(3, 9)) == {k: v for k, v in model.items() if 3 <= k <= 9}
        assert pairs(store.as_of(1)) == snapshots[1]
        assert pairs(store.multi_get(spark.createDataFrame([(1,), (99,)], "k long"))) == {k: v for k, v in model.items() if k == 1}
        store.compact()
    while store.compact(0):
        pass
    store.vacuum(0)
    assert pairs(store.pin()) == model
    store.unpin()
    assert pairs(store.latest()) == model and len(store.versions()) == 1
    with pytest.raises(ValueError):
        store.as_of(0)


def test_multi_range_random(spark):
    r = random.Random(6)
    keys = [r.randrange(-(10 ** r.randrange(1, 18)), 10 ** r.randrange(1, 18)) for _ in range(400)]
    view = spark.createDataFrame([(k, 0) for k in set(keys)], "k long, v int")
    asked = {tuple(sorted((r.choice(keys) + r.randrange(-3, 4), r.choice(keys)))) for _ in range(80)}
    got = rows_of(lookup.multi_range_counts(spark.createDataFrame(sorted(asked), "low long, high long"), view, 7))
    assert got == sorted((a, b, sum(a <= k <= b for k in set(keys))) for a, b in asked)


@pytest.mark.parametrize("policy", ["all", "largest", "drawn"])
def test_tree_of_nodes(spark, policy):
    """Small nodes: moves, resumed moves, splits at medians and over the fanout; reads equal a dict's all along."""
    r = random.Random(9)
    config = StoreConfig(fanout=2, only_largest=policy == "largest", probablistic_merge=policy == "drawn")
    store = Store(spark, new_path(spark, "tree"), config, node_rows=25)
    model, seq = {}, 0
    pairs = lambda df: {x["k"]: x["v"] for x in df.collect()}
    for step in range(6):
        batch = []
        for _ in range(60):
            batch.append((seq, r.randint(-100, 400) if step else seq * 3 - 100, r.randint(0, 1000), None))
            seq += 1
        model |= {k: v for _, k, v, _ in batch}
        store.ingest(spark.createDataFrame(batch, "seq long, k long, v int, payload binary"))
        store.maintain()
        runs = store.runs()
        for level in {x["level"] for x in runs} - {0}:
            nodes = store._nodes(runs, level)
            assert all(x["max_k"] < y["min_k"] for x, y in zip(nodes, nodes[1:], strict=False))
        assert pairs(store.latest()) == model
    assert pairs(store.range(3, 90)) == {k: v for k, v in model.items() if 3 <= k <= 90}
    assert pairs(store.get(50)) == {k: v for k, v in model.items() if k == 50}
    merges = store.merges().collect()
    assert len(merges) > 2 and all(m["seconds"] > 0 for m in merges)
    if policy == "all":
        assert store.height() >= 3
    assert store.merge_pages() > 0 and len(store.touched(3, 3)) < len(store.runs())
    while (before := sum(map(store._live, store._nodes(store.runs(), 1)))) and store.compact(1):
        assert before
    store.vacuum(0)
    assert pairs(store.latest()) == model


def test_push_down_resumes(spark):
    """A node far too large moves 2 * node_rows records at a time; the file stays, its moved records are passed over."""
    store = Store(spark, new_path(spark, "resume"), StoreConfig(fanout=1), node_rows=10)
    rows = spark.range(95).select(F.col("id").alias("seq"), F.col("id").alias("k"), F.col("id").cast("int").alias("v"), F.lit(None).cast("binary").alias("payload"))
    store.ingest(rows)
    store.compact()
    for moves in range(1, 5):
        node = store._nodes(store.runs(), 1)[0]
        store.push_down(node)
        assert store._nodes(store.runs(), 1)[0]["consumed_upto"] == 20 * moves - 1
        assert store.log().count() == 95 and store.latest().count() == 95
    assert [x["level"] for x in store.touched(5, 6)] == [2]
    store.push_down(store._nodes(store.runs(), 1)[0])
    assert store.height() == 1 and store.latest().count() == 95


def test_vacuum_leaves_what_is_being_written(spark):
    store = Store(spark, new_path(spark, "grace"))
    rows = spark.createDataFrame([(0, 1, 1, None)], "seq long, k long, v int, payload binary")
    store.ingest(rows)
    pending = f"{store.path}/runs/pending"
    rows.write.parquet(pending)
    assert store.vacuum() == []
    assert store.vacuum(0) == [pending]
    assert store.latest().count() == 1


def test_streams_share_a_store(spark, tmp_path):
    """A stream on a store with epochs, a second stream, and a repeated batch: nothing is lost, nothing comes twice."""
    make = lambda low: spark.range(low, low + 20).select(F.col("id").alias("seq"), F.col("id").alias("k"), F.col("id").cast("int").alias("v"), F.lit(None).cast("binary").alias("payload"))
    store = Store(spark, new_path(spark, "shared"), StoreConfig(fanout=2))
    for k in range(3):
        store.ingest(make(1000 + 100 * k))
    for name, low in (("one", 0), ("two", 100)):
        make(low).repartition(3).write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(make(0).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        ingest.start(stream, store, str(tmp_path / f"{name}-cp"), flush_by_size=name == "two", throttle=True).awaitTermination()
    assert store.latest().count() == 100 and len(store._state()["streams"]) == 2
    name, last = next(iter(store._state()["streams"].items()))
    versions = store.versions()
    store.ingest(make(5000), batch=(name, last))
    assert store.versions() == versions and store.latest().count() == 100


def test_epochs_by_size(spark):
    rows = spark.range(1000, 1250).select(F.col("id").alias("seq"), (F.col("id") % 7).alias("k"))
    counts = dict(rows_of(ingest.by_size(rows, 5, StoreConfig()).groupBy("epoch").count()))
    assert counts == {5: 93, 6: 93, 7: 64}


def test_exact_division(spark):
    values = [0, 1, -1, 92, 93, -93, -94, BIG, -BIG - 1, (1 << 53) + 1]
    rows = spark.createDataFrame([(v,) for v in values], "seq long")
    got = {r["seq"]: (r["a"], r["b"]) for r in rows.select("seq", floor_div(F.col("seq"), 93).alias("a"), ceil_div(F.col("seq"), 93).alias("b")).collect()}
    assert got == {v: (v // 93, -(-v // 93)) for v in values}


def test_concurrent_writers_are_seen(spark):
    store = Store(spark, new_path(spark, "race"))
    rows = spark.createDataFrame([(0, 1, 1, None)], "seq long, k long, v int, payload binary")
    store.ingest(rows)
    store.versions = lambda: []  # a writer that did not see the version above
    with pytest.raises(RuntimeError):
        store._publish([])


def test_merge_route_split(spark):
    parent = spark.createDataFrame([(1, 10), (3, 30)], "k long, v int")
    child = spark.createDataFrame([(1, 11), (2, 20), (-1, -1)], "k long, v int")
    assert rows_of(compaction.merge_override(parent, child)) == [(-1, -1), (1, 10), (2, 20), (3, 30)]
    routed = spark.createDataFrame([(k,) for k in (1, 5, 6, 9, 10)], "k long").select("k", compaction.route([5, 9]).alias("c"))
    assert rows_of(routed) == [(1, 0), (5, 0), (6, 1), (9, 1), (10, 2)]
    assert compaction.overlapping_children([5, 9], 5, 5) == [0]
    assert compaction.overlapping_children([5, 9], 6, 20) == [1, 2]
    assert compaction.overlapping_children([5, 9], 9, 3) == []
    assert compaction.split_pivots([1, 2, 3], 4) is None
    assert compaction.split_pivots([1, 2, 3, 4], 4) == ([1, 2], 3, [4])


def test_positions_are_ranks(spark):
    keys = random.Random(1).sample(range(-10_000, 10_000), 3000)
    run = spark.createDataFrame([(k, 0) for k in keys], "k long, v int")
    got = {r["k"]: (r["pos"], r["n"]) for r in with_positions(run).collect()}
    assert got == {k: (i, 3000) for i, k in enumerate(sorted(keys))}


def test_hash_vectors():
    """Published vectors, and a step-by-step version with Python's integers."""
    keys = np.array([0, 1, -1, 7, BIG, -BIG - 1, 123456789], np.int64)
    m64 = (1 << 64) - 1
    rot = lambda x, r, b=64: ((x << r) | (x >> (b - r))) & ((1 << b) - 1)

    def final(x):
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> 33)) * c & m64
        return x ^ (x >> 33)

    def plain(k, seed):
        k1 = rot((k & m64) * 0x87C37B91114253D5 & m64, 31) * 0x4CF5AD432745937F & m64
        a, b = seed ^ k1 ^ 8, seed ^ 8
        a = (a + b) & m64
        b = (a + b) & m64
        a, b = final(a), final(b)
        a = (a + b) & m64
        return a, (a + b) & m64

    for seed in (0, *hashing.SEEDS):
        one, two = hashing.murmur3_x64(keys, seed)
        assert list(zip(one.tolist(), two.tolist(), strict=True)) == [plain(int(k), seed) for k in keys]

    def plain32(k, seed):
        h = seed
        for part in ((k & m64) & 0xFFFFFFFF, (k & m64) >> 32):
            part = rot(part * 0xCC9E2D51 & 0xFFFFFFFF, 15, 32) * 0x1B873593 & 0xFFFFFFFF
            h = (rot(h ^ part, 13, 32) * 5 + 0xE6546B64) & 0xFFFFFFFF
        h ^= 8
        for s, c in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> s)) * c & 0xFFFFFFFF
        return h ^ (h >> 16)

    assert hashing.murmur3_x86_32(keys, 42).tolist() == [plain32(int(k), 42) for k in keys]
    assert len(hashing.murmur3_x86_128(keys, 1)) == 4
    assert len(set(hashing.murmur2(keys, 1).tolist())) == len(keys)


def test_murmur3_32_is_sparks(spark):
    """Spark's hash() of a long is the same function with seed 42."""
    df = spark.createDataFrame([(k,) for k in (0, 5, -9, 1 << 40)], "k long")
    got = df.select(hashing.murmur3_32(F.col("k"), 42).alias("a"), F.hash("k").alias("b")).collect()
    assert all(r["a"] == r["b"] % (1 << 32) for r in got)


def test_null_hash(spark):
    df = spark.createDataFrame([(None,), (1,)], "k long").select(hashing.murmur3_64(F.col("k"), 1).alias("h"))
    assert sorted(r["h"] is None for r in df.collect()) == [False, True]


def test_pages(spark, tmp_path):
    config = StoreConfig()
    payload = "2a000000" + "00" * 124
    rows = spark.createDataFrame([([(1, payload), (-5, payload)],)], "rows array<struct<k:long,payload:string>>")
    leaf = bytes.fromhex(rows.select(codec.encode_leaf(F.col("rows"))).first()[0])
    inner = (-1 & 0xFFFFFFFF).to_bytes(4, "little") + (9).to_bytes(8, "little") + bytes([1]) + (4096).to_bytes(5, "little") + (3).to_bytes(3, "little") + bytes([2]) + (8192).to_bytes(5, "little") + (4).to_bytes(3, "little")
    (tmp_path / "run").write_bytes(leaf.ljust(4096, b"\0") + inner.ljust(4096, b"\0") + b"\xff" * 16)
    pages = tables.pages(spark, str(tmp_path / "run"), config)
    got = {r["page_no"]: r for r in pages.select("page_no", codec.is_end(F.col("page")).alias("end"), codec.decode_leaf(F.col("page")).alias("leaf"), codec.decode_inner(F.col("page")).alias("inner")).collect()}
    assert [(c["k"], c["v"], len(c["payload"])) for c in got[0]["leaf"]] == [(1, 42, 128), (-5, 42, 128)]
    assert [(c["k"], tuple(c["pointer"])) for c in got[1]["inner"]] == [(9, (1, 4096, 3)), (None, (2, 8192, 4))]
    assert got[2]["end"] and not got[0]["end"]


def test_config(tmp_path):
    text = "# a comment\n\n fanout = 8\nUSE_BLOOM_FILTERS=true\nData_Prefix=/tmp/x\n"
    (tmp_path / "c").write_text(text)
    config = StoreConfig.load(str(tmp_path / "c"))
    assert (config.fanout, config.use_bloom_filters, config.data_prefix) == (8, True, "/tmp/x")
    with pytest.raises(ValueError):
        StoreConfig.parse("NOPE=1")
    c = StoreConfig()
    assert (c.epoch_rows, c.page_rows, c.page_children, c.bloom_bits, c.bloom_hashes) == (93, 30, 241, 840, 5)


def test_membership(spark):
    keys = spark.range(2000).select((F.col("id") * 7).alias("k"))
    bits, hashes = membership.sized(2000)
    built = membership.build(keys, bits, hashes)
    others = spark.range(4000).select((F.col("id") * 7 + 3).alias("k"))
    counted = statistics.lookup_counters(membership.probe(keys.unionByName(others), built, bits, hashes), keys).first()
    assert counted["false_negatives"] == 0
    assert counted["false_positives"] / 4000 < 2 * StoreConfig().bloom_error


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("seq"), (F.col("id") % 37).alias("k"), (F.col("id") * 3).cast("int").alias("v"), F.lit(None).cast("binary").alias("payload"))
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = Store(spark, new_path(spark, "streamed"), StoreConfig(fanout=2))
    for _ in range(2):  # a second start finds nothing new
        query = ingest.start(stream, store, str(tmp_path / "cp"))
        query.awaitTermination()
    told = statistics.progress(spark, query)
    assert told.columns == ["batch", "rows", "rows_per_second", "millis"]
    assert store.latest().count() == 37
    assert {r["epoch"] for r in store.log().select("epoch").distinct().collect()} <= set(range(5))
    q = ingest.running_latest(stream).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows_of(spark.table("running").select("k", "v")) == rows_of(lookup.latest(rows.withColumn("epoch", F.lit(0))).select("k", "v"))


def test_workload(spark):
    store = Store(spark, new_path(spark, "worked"), StoreConfig(fanout=2))
    small = workload.Workload(no_ops=90, insert_prop=0.6, max_key=40, measure_freq=30, insert_per_second=1000, total_queries=5, measure_insertion_rate=True, measure_insertion_time=True)
    done, model, want = workload.execute(store, small), {}, {}
    for low in (0, 30, 60):
        ops = workload.operations(spark, small).where((F.col("op_no") >= low) & (F.col("op_no") < low + 30)).collect()
        for o in ops:
            if o["is_query"]:
                want[o["op_no"]] = sum(o["key"] <= k <= (o["high"] if o["is_range"] else o["key"]) for k in model)
        model |= {o["key"]: o["val"] for o in ops if o["is_insertion"]}
    assert {x["op_no"]: x["n"] for x in done.answers.collect()} == want and want
    assert {x["k"]: x["v"] for x in store.latest().collect()} == model
    assert done.stats.columns == ["first_op", "inserts", "queries", "insert_seconds", "query_seconds", "inserts_per_second", "pages_read"] and done.stats.count() == 3
    assert len({o["key"] for o in workload.operations(spark, small).where("is_query").collect()}) <= 5
    work = workload.Workload(no_ops=3000, insert_prop=0.7, zipfian_query=True, max_key=1000)
    ops = workload.operations(spark, work).cache()
    assert abs(ops.where("is_insertion").count() / 3000 - 0.7) < 0.05
    keys = ops.where("is_query").select("key")
    assert keys.where("key < 0 or key >= 1000").count() == 0
    assert keys.where("key < 32").count() > keys.where("key >= 500").count()
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    answered = workload.answers(ops, rows)
    assert answered.count() == ops.where("is_query").count()
    assert workload.inserts(ops).count() == ops.where("is_insertion").count()


def test_pushdown(spark, sf_dir):
    """Key bounds and the needed columns reach the scan, through the newest-wins aggregation."""
    plan = lookup.range_keys(tables.order_run(spark, sf_dir), 1, 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,1)" in plan and "o_custkey" not in plan.split("ReadSchema")[1]
    plan = lookup.point(lookup.latest(tables.event_log(spark, sf_dir)), 3)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,3)" in plan
