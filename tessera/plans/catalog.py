"""Queries of the key/value engine over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, hashing
from ..functions.geometry import with_positions
from ..operators import compaction, lookup, membership, statistics, workload
from ..sources.config import StoreConfig
from ..sources.tables import event_log, order_run, table
from ..streaming import ingest
from .shared import new_path
from .store import Store

CONFIG = StoreConfig()
Query = Callable[[SparkSession, str], DataFrame]

#: The event log and the order run of event_log and order_run, as SQL.
LOG = "(select user_id k, event_id seq, cast(floor(event_id / 93.0) as bigint) epoch, cast(round(value * 100) as int) v from events)"
RUN = "(select o_orderkey k, cast(o_custkey as int) v, row_number() over (order by o_orderkey) - 1 pos, count(*) over () n from orders)"
KIDS = "(select cast(floor(l_orderkey / 1000.0) as bigint) child, count(*) n, cast(ceil(count(*) / 30.0) as bigint) pages from lineitem group by 1)"
REFERENCE = "(select k, v, epoch, seq from (select *, row_number() over (partition by k order by epoch desc, seq) rn from {log} l) t where rn = 1)"
NEWEST = "(select k, v, epoch, seq from (select *, row_number() over (partition by k order by epoch desc, seq desc) rn from {log} l) t where rn = 1)"

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- point and range reads


@query("select o_orderkey k, cast(o_custkey as int) v from orders where o_orderkey = 77")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.point(order_run(spark, sf_dir), 77)


@query("select k, coalesce(max(cast(o_custkey as int)), -1) v from (values (77), (99999999)) t(k) left join orders on o_orderkey = k group by k")
def point_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.point_or_missing(order_run(spark, sf_dir), spark.createDataFrame([(77,), (99999999,)], "k long"))


@query("select o_orderkey k from orders where o_orderkey between 100 and 250")
def range_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.range_keys(order_run(spark, sf_dir), 100, 250)


@query("select o_orderkey k from orders where o_orderkey between 250 and 100")
def range_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.range_keys(order_run(spark, sf_dir), 250, 100)


@query("select o_orderkey k, cast(o_custkey as int) v from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 49)")
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("k"))
    return lookup.multi_get(order_run(spark, sf_dir), keys)


@query("select distinct l_orderkey + 14000 k from lineitem l where not exists (select 1 from orders o where o.o_orderkey = l.l_orderkey + 14000)")
def miss_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.absent(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 14000).alias("k")), order_run(spark, sf_dir))


@query("select lo low, hi high, count(o_orderkey) n from (values (10, 20), (15, 400), (20000, 20010), (9, 3)) r(lo, hi) left join orders on o_orderkey between lo and hi group by lo, hi")
def multi_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame([(10, 20), (15, 400), (20000, 20010), (9, 3)], "low long, high long")
    return lookup.multi_range_counts(ranges, order_run(spark, sf_dir), 64)


@query("select lo low, lo + 9 high, count(o_orderkey) n from (select unnest(range(0, 15000, 1000)) lo) r left join orders on o_orderkey between lo and lo + 9 group by lo")
def range_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.range(0, 15000, 1000).select(F.col("id").alias("low"), (F.col("id") + 9).alias("high"))
    return lookup.multi_range_counts(ranges, order_run(spark, sf_dir), 16)


# -- newest-wins views of a log


@query(f"select k, v from {REFERENCE.format(log=LOG)} x")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.latest(event_log(spark, sf_dir), "reference").select("k", "v")


@query(f"select k, v, epoch, seq from {NEWEST.format(log=LOG)} x")
def latest_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.latest(event_log(spark, sf_dir))


@query(f"select epoch, k, v from (select *, row_number() over (partition by epoch, k order by seq) rn from {LOG} l) t where rn = 1")
def memtable_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.first_in_epoch(event_log(spark, sf_dir))


@query("select user_id k, max(event_id) seq from events where floor(event_id / 93.0) <= 40 group by user_id")
def asof_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.as_of(event_log(spark, sf_dir), 40).select("k", "seq")


@query(f"select k, max(epoch) answering_epoch, count(distinct epoch) tiers_with_key from {LOG} l group by k")
def tier_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.tier_of_key(event_log(spark, sf_dir))


@query(f"select distinct epoch, k from {LOG} l where k between 20 and 40")
def range_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.range_bag(event_log(spark, sf_dir), 20, 40)


@query(f"select k, v from {REFERENCE.format(log=LOG)} x where k between 20 and 40")
def range_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.range_latest(event_log(spark, sf_dir), 20, 40, "reference").select("k", "v")


@query(f"select coalesce(p.k, c.k) k, coalesce(p.v, c.v) v from (select k, v from {REFERENCE.format(log=LOG)} x) p full join (select o_orderkey k, cast(o_custkey as int) v from orders where o_orderkey < 500) c on p.k = c.k")
def merge_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = lookup.latest(event_log(spark, sf_dir), "reference").select("k", "v")
    return compaction.merge_override(parent, order_run(spark, sf_dir).where("k < 500"))


# -- layout


@query(f"select epoch, count(*) n_ops, count(distinct k) n_keys from {LOG} l group by epoch")
def flush_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.flush_sizes(event_log(spark, sf_dir))


@query(f"select epoch, count(distinct k) * 144 bytes from {LOG} l group by epoch")
def memtable_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.memory(event_log(spark, sf_dir))


@query(f"select cast(floor(pos / 30.0) as bigint) page_no, min(k) lo, max(k) hi, count(*) n from {RUN} r group by 1")
def leaf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.leaf_pages(with_positions(order_run(spark, sf_dir)))


@query("select cast(ceil(count(*) / 30.0) as bigint) leaves, cast(ceil(ceil(count(*) / 30.0) / 241.0) as bigint) l1 from orders")
def inner_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.inner_levels(order_run(spark, sf_dir))


@query("select cast(1 + (leaves > 1)::int + (l1 > 1)::int + (ceil(l1 / 241.0) > 1)::int as bigint) height from (select ceil(count(*) / 30.0) leaves, ceil(ceil(count(*) / 30.0) / 241.0) l1 from orders) t")
def tree_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.tree_height(order_run(spark, sf_dir))


@query(f"select cast(floor(pos / 120.0) as bigint) snode, cast(ceil(count(*) / 30.0) as bigint) pages from {RUN} r group by 1")
def snode_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.node_sizes(with_positions(order_run(spark, sf_dir)))


# -- compaction


def _kids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.children(table(spark, sf_dir, "lineitem"), 1000, "l_orderkey")


@query(f"select child, n, pages from {KIDS} c where pages > 4")
def oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.oversized(_kids(spark, sf_dir))


@query(f"select child, n, pages from {KIDS} c where pages > 4 order by pages desc, child limit 1")
def largest_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.largest_oversized(_kids(spark, sf_dir))


@query(f"select child, n, pages from {KIDS} c where pages > 4 and substr(md5('1:' || child), 1, 8) < '80000000'")
def sampled_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.sampled_oversized(_kids(spark, sf_dir), 0.5, 1)


@query("select cast(case when l_orderkey <= 4000 then 0 when l_orderkey <= 9000 then 1 when l_orderkey <= 12000 then 2 else 3 end as int) child, count(*) n from lineitem group by 1")
def route_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    return rows.groupBy(compaction.route([4000, 9000, 12000]).alias("child")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select k, v from {RUN} r where pos < 240")
def pushdown_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.push_down_prefix(with_positions(order_run(spark, sf_dir))).select("k", "v")


@query(f"select k split_key from {RUN} r where pos = cast(floor(n / 2.0) as bigint)")
def split_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.median_key(with_positions(order_run(spark, sf_dir)))


@query(f"select cast(2 * 4 + sum(2 * pages) as bigint) est_pages from {KIDS} c")
def merge_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.merge_pages(_kids(spark, sf_dir))


@query(f"select cast(floor(floor(est * 4096 / 115343360.0) * 1000000 / 93.0) + 5 as bigint) micros from (select 2 * 4 + sum(2 * pages) est from {KIDS} c) t")
def throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.merge_pages(_kids(spark, sf_dir)).select(compaction.insert_delay(F.col("est_pages"), CONFIG.epoch_rows).alias("micros"))


# -- hashes, codecs, membership


def _hex_sql(x: str, size: int) -> str:
    return " || ".join(f"lpad(lower(to_hex(({x} // {256**i}) % 256)), 2, '0')" for i in range(size))


@query(f"select o_orderkey k, {_hex_sql('(o_orderkey % 200)', 1)} || {_hex_sql('(o_orderkey * 4096)', 5)} || {_hex_sql('o_custkey', 3)} bytes from orders")
def pointer_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = order_run(spark, sf_dir)
    return run.select("k", codec.encode_pointer(F.col("k") % 200, F.col("k") * 4096, F.col("v")).alias("bytes"))


@query("select o_orderkey k, cast(o_orderkey % 100 as tinyint) disk, o_orderkey * 4096 location, cast(o_custkey as int) file_no from orders")
def pointer_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = order_run(spark, sf_dir)
    raw = F.unhex(codec.encode_pointer(F.col("k") % 100, F.col("k") * 4096, F.col("v")))
    return run.select("k", codec.decode_pointer(raw).alias("p")).select("k", "p.disk", "p.location", "p.file_no")


_M = "18446744073709551616"


def _murmur_sql(seed: int, keys: str = "select o_orderkey k from orders") -> str:
    """MurmurHash3 x64-128 of a non-negative 8-byte key in 128-bit arithmetic: k, h (the first half, unsigned)."""
    wide = lambda x, c: f"((({x}) % 4294967296 * {c % 2**32}::UHUGEINT + ((({x}) % 4294967296 * {c >> 32}::UHUGEINT + ({x}) // 4294967296 * {c % 2**32}::UHUGEINT) % 4294967296) * 4294967296::UHUGEINT) % {_M}::UHUGEINT)"
    mix = lambda x: f"xor({x}, {x} // 8589934592::UHUGEINT)"
    steps = [
        ("a", wide("k::UHUGEINT", 0x87C37B91114253D5)),
        ("b", f"((a * 2147483648::UHUGEINT) % {_M}::UHUGEINT + a // 8589934592::UHUGEINT)"),
        ("c", wide("b", 0x4CF5AD432745937F)),
        ("h1", f"xor(xor({seed}::UHUGEINT, c), 8::UHUGEINT)"),
        ("s1", f"((h1 + {seed ^ 8}::UHUGEINT) % {_M}::UHUGEINT)"),
        ("s2", f"(({seed ^ 8}::UHUGEINT + s1) % {_M}::UHUGEINT)"),
    ]
    for s in ("s1", "s2"):
        steps += [(f"{s}x", mix(s)), (f"{s}y", wide(f"{s}x", 0xFF51AFD7ED558CCD)), (f"{s}z", mix(f"{s}y")), (f"{s}u", wide(f"{s}z", 0xC4CEB9FE1A85EC53)), (f"{s}f", mix(f"{s}u"))]
    sql = keys
    for name, expression in steps:
        sql = f"select *, {expression} {name} from ({sql}) t"
    return f"select k, (s1f + s2f) % {_M}::UHUGEINT h from ({sql}) t"


def _staged(keys: str, steps: list[tuple[str, str]], result: str) -> str:
    """Steps of 32-bit arithmetic, one select each, from k and its halves lo and hi."""
    sql = f"select k, k % 4294967296 lo, k // 4294967296 hi from ({keys}) t"
    for name, expression in steps:
        sql = f"select *, {expression} {name} from ({sql}) t"
    return f"select k, {result} from ({sql}) t"


_times = lambda x, c: f"(({x})::hugeint * {c} % 4294967296)::bigint"
_turned = lambda x, by: f"((({x})::bigint * {1 << by}) % 4294967296 + ({x}) // {1 << (32 - by)})"


def _final32_sql(x: str, name: str) -> list[tuple[str, str]]:
    steps, at = [], x
    for k, (shift, factor) in enumerate(((16, 0x85EBCA6B), (13, 0xC2B2AE35))):
        steps += [(f"{name}{k}a", f"xor({at}, {at} // {1 << shift})"), (f"{name}{k}b", _times(f"{name}{k}a", factor))]
        at = f"{name}{k}b"
    return [*steps, (name, f"xor({at}, {at} // 65536)")]


def _murmur3_32_sql(seed: int, keys: str) -> str:
    steps, h = [], str(seed)
    for part in ("lo", "hi"):
        steps += [(f"{part}1", _times(part, 0xCC9E2D51)), (f"{part}2", _turned(f"{part}1", 15)), (f"{part}3", _times(f"{part}2", 0x1B873593)), (f"{part}4", f"xor({h}::bigint, {part}3)")]
        steps += [(f"{part}5", _turned(f"{part}4", 13)), (f"{part}6", f"(({part}5 * 5 + {0xE6546B64}) % 4294967296)")]
        h = f"{part}6"
    return _staged(keys, [*steps, ("g", f"xor({h}, 8)"), *_final32_sql("g", "f")], "f h")


def _murmur2_sql(seed: int, keys: str) -> str:
    m, steps, h = 0x5BD1E995, [], str(seed ^ 8)
    for part in ("lo", "hi"):
        steps += [(f"{part}1", _times(part, m)), (f"{part}2", f"xor({part}1, {part}1 // 16777216)"), (f"{part}3", _times(f"{part}2", m)), (f"{part}4", f"xor({_times(h, m)}, {part}3)")]
        h = f"{part}4"
    steps += [("x", f"xor({h}, {h} // 8192)"), ("y", _times("x", m)), ("z", "xor(y, y // 32768)")]
    return _staged(keys, steps, "z h")


def _murmur3_128_sql(seed: int, keys: str) -> str:
    """All four 32-bit words of x86-128; an 8-byte key has bytes for the first two."""
    factors = (0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93)
    steps = []
    for k, (part, turn) in enumerate((("lo", 15), ("hi", 16))):
        steps += [(f"m{k}", _times(part, factors[k])), (f"t{k}", _turned(f"m{k}", turn)), (f"a{k}", f"xor(xor({seed}::bigint, {_times(f't{k}', factors[k + 1])}), 8)")]
    steps += [(f"a{k}", f"xor({seed}::bigint, 8)") for k in (2, 3)]
    steps += [("b0", "((a0 + a1 + a2 + a3) % 4294967296)"), *((f"b{k}", f"((a{k} + b0) % 4294967296)") for k in (1, 2, 3))]
    for k in range(4):
        steps += _final32_sql(f"b{k}", f"c{k}")
    steps += [("d0", "((c0 + c1 + c2 + c3) % 4294967296)"), *((f"d{k}", f"((c{k} + d0) % 4294967296)") for k in (1, 2, 3))]
    return _staged(keys, steps, "d0 h1, d1 h2, d2 h3, d3 h4")


#: Order keys, and numbers beyond 32 bits made of them.
_KEYS = "select o_orderkey * 1000003 k from orders"


def _wide_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_run(spark, sf_dir).select((F.col("k") * 1000003).alias("k"))


@query(_murmur3_32_sql(hashing.SEEDS[0], _KEYS))
def murmur3_x86_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide_keys(spark, sf_dir).select("k", hashing.murmur3_32(F.col("k"), hashing.SEEDS[0]).alias("h"))


@query(_murmur2_sql(hashing.SEEDS[1], _KEYS))
def murmur2_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide_keys(spark, sf_dir).select("k", hashing.murmur2_32(F.col("k"), hashing.SEEDS[1]).alias("h"))


@query(_murmur3_128_sql(hashing.SEEDS[0], _KEYS))
def murmur3_x86_128(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide_keys(spark, sf_dir).select("k", *[h(F.col("k"), hashing.SEEDS[0]).alias(f"h{n + 1}") for n, h in enumerate(hashing.murmur3_128_words)])


def _maybe_sql(probes: str) -> str:
    """k, maybe: double hashing of the filter over all order keys, with 7 bits a key and 5 hashes."""
    size = "(select greatest(8, count(*) * 7) from orders)::UHUGEINT"
    both = lambda keys: f"select a.k, a.h % {size} one, b.h % {size} two from ({_murmur_sql(hashing.SEEDS[0], keys)}) a join ({_murmur_sql(hashing.SEEDS[1], keys)}) b on a.k = b.k"
    bits = lambda keys: f"select k, i, (one + i::UHUGEINT * two) % {size} bit from ({both(keys)}) t, unnest(range(0, 5)) u(i)"
    held = f"select distinct bit, 1 hit from ({bits('select o_orderkey k from orders')}) t"
    return f"select p.k, count(hit) = count(*) maybe from ({bits(probes)}) p left join ({held}) s on p.bit = s.bit group by p.k"


@query("select k, lower(lpad(to_hex(h::UBIGINT), 16, '0')) h from (" + _murmur_sql(hashing.SEEDS[0]) + ") t")
def murmur3_x64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_run(spark, sf_dir).select("k", F.lower(F.lpad(F.hex(hashing.murmur3_64(F.col("k"), hashing.SEEDS[0])), 16, "0")).alias("h"))


@query(f"select count(*) - count(case when maybe then 1 end) false_negatives from ({_maybe_sql('select o_orderkey k from orders')}) t")
def bloom_no_false_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = order_run(spark, sf_dir)
    bits, hashes = membership.sized(run.count())
    probed = membership.probe(run, membership.build(run, bits, hashes), bits, hashes)
    return statistics.lookup_counters(probed, run).select("false_negatives")


@query(f"select count(*) searches, count(case when maybe then 1 end) false_positives, cast(0 as bigint) false_negatives from ({_maybe_sql('select o_orderkey + 1099511627776 k from orders')}) t")
def bloom_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = order_run(spark, sf_dir)
    bits, hashes = membership.sized(run.count())
    asked = run.select((F.col("k") + F.lit(1 << 40)).alias("k"))
    return statistics.lookup_counters(membership.probe(asked, membership.build(run, bits, hashes), bits, hashes), run)


# -- stores, streams, workloads


def _stored(spark: SparkSession, sf_dir: str, mode: str, parts: int) -> Store:
    """The event log ingested in `parts` flushes, with their compactions."""
    store = Store(spark, new_path(spark, "store"), CONFIG, mode)
    log = event_log(spark, sf_dir)
    for part in range(parts):
        store.ingest(log.where((F.col("epoch") >= part * 40) & ((F.col("epoch") < (part + 1) * 40) | F.lit(part == parts - 1))))
        store.maintain()
    return store


@query(f"select k, v from {REFERENCE.format(log=LOG)} x")
def store_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored(spark, sf_dir, "reference", 3)
    store.compact()
    return store.latest().select("k", "v")


@query(f"select k, v from {NEWEST.format(log=LOG)} x where k between 20 and 40")
def store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "latest", 2).range(20, 40).select("k", "v")


@query("select user_id k, max(event_id) seq from events where floor(event_id / 93.0) <= 40 group by user_id")
def store_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored(spark, sf_dir, "latest", 2)
    store.compact()
    return store.as_of(40).select("k", "seq")


@query("select cast(1 as int) level, count(distinct user_id) n_rows, min(user_id) min_k, max(user_id) max_k, cast(ceil(count(distinct user_id) / 30.0) as bigint) n_pages from events")
def store_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored(spark, sf_dir, "latest", 2)
    store.compact()
    store.vacuum()
    return store.manifest().select("level", "n_rows", "min_k", "max_k", "n_pages")


@query(f"select k, v from {NEWEST.format(log='(select user_id k, event_id seq, 0 epoch, cast(round(value * 100) as int) v from events)')} x")
def stream_ingest_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, new_path(spark, "stream-store"), CONFIG)
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may name a file or a folder
    inserts = stream.select(F.col("event_id").alias("seq"), F.col("user_id").alias("k"), F.round(F.col("value") * 100).cast("int").alias("v"), F.col("props").cast("binary").alias("payload"))
    ingest.start(inserts, store, new_path(spark, "stream-checkpoint")).awaitTermination()
    return store.latest().select("k", "v")


@query(f"select k, v from {NEWEST.format(log='(select user_id k, event_id seq, 0 epoch, cast(round(value * 100) as int) v from events)')} x union all select o_orderkey + 1000000 k, cast(o_custkey as int) v from orders")
def stream_after_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream into a store that batches were written to before."""
    store = Store(spark, new_path(spark, "stream-after"), CONFIG)
    run = order_run(spark, sf_dir).select(F.col("k").alias("seq"), (F.col("k") + 1_000_000).alias("k"), "v", F.lit(None).cast("binary").alias("payload"))
    for part in range(2):
        store.ingest(run.where(F.col("seq") % 2 == part))
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    inserts = stream.select(F.col("event_id").alias("seq"), F.col("user_id").alias("k"), F.round(F.col("value") * 100).cast("int").alias("v"), F.col("props").cast("binary").alias("payload"))
    ingest.start(inserts, store, new_path(spark, "stream-checkpoint")).awaitTermination()
    return store.latest().select("k", "v")


def _order_store(spark: SparkSession, sf_dir: str, share: int, config: StoreConfig = CONFIG) -> Store:
    """All orders in one node of level 1; a node holds one in `share` of them."""
    run = order_run(spark, sf_dir).select(F.col("k").alias("seq"), "k", "v", F.lit(None).cast("binary").alias("payload"))
    store = Store(spark, new_path(spark, "order-store"), config, node_rows=run.count() // share)
    store.ingest(run)
    store.compact()
    return store


_NODES = ("level", "n_rows", "min_k", "max_k", "consumed_upto")
_HALVES = f"(select * from {RUN} r where pos <= n // 2) a", f"(select * from {RUN} r where pos > n // 2) b"


@query(
    f"select cast(1 as int) level, n n_rows, 0 + min(k) min_k, max(k) max_k, max(case when pos < 2 * (n // 10) then k end) consumed_upto from {RUN} r group by n "
    f"union all select cast(2 as int), count(*), min(k), max(k), cast(null as bigint) from {RUN} r where pos < 2 * (n // 10)"
)
def store_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node far too large moves its first records into a new level, and remembers how far."""
    store = _order_store(spark, sf_dir, 10)
    store.push_down(store.runs()[0])
    return store.manifest().select(*_NODES)


@query(f"select k, v from {RUN} r")
def store_pushdown_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads are the same while a node is partly moved down."""
    store = _order_store(spark, sf_dir, 10)
    store.push_down(store.runs()[0])
    store.push_down(next(r for r in store.runs() if r["level"] == 1))
    return store.latest().select("k", "v")


@query(" union all ".join(f"select cast(1 as int) level, count(*) n_rows, min(k) min_k, max(k) max_k, cast(null as bigint) consumed_upto from {half}" for half in _HALVES))
def store_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node that is too large is split at its median record."""
    store = _order_store(spark, sf_dir, 2, StoreConfig(fanout=2))
    store.maintain()
    return store.manifest().select(*_NODES)


@query(f"select count(*) n_rows, min(k) min_k, max(k) max_k from {_HALVES[0]}")
def store_policy_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two nodes that are too large, the policy takes the larger."""
    store = _order_store(spark, sf_dir, 4, StoreConfig(fanout=2, only_largest=True))
    store.split(store.runs()[0], store._median(store.runs()[0]))
    names = [r["run_id"] for r in store.oversized(1)]
    return store.manifest().where(F.col("run_id").isin(names)).select("n_rows", "min_k", "max_k")


@query("select lo low, hi high, count(o_orderkey) n from (values (-9223372036854775807, 9223372036854775807), (-1000000000000, 77), (100, 5000000000000000000)) r(lo, hi) left join orders on o_orderkey between lo and hi group by lo, hi")
def multi_range_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges far beyond the keys."""
    ranges = spark.createDataFrame([(-(2**63) + 1, 2**63 - 1), (-(10**12), 77), (100, 5 * 10**18)], "low long, high long")
    return lookup.multi_range_counts(ranges, order_run(spark, sf_dir), 64)


@query("select date_trunc('hour', ts) w, count(*) n from events group by 1")
def insert_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.insert_rate(table(spark, sf_dir, "events"))


@query(None)
def workload_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each query of a mixed workload finds in the order run."""
    ops = workload.operations(spark, workload.Workload(no_ops=2000, insert_prop=0.5, zipfian_query=True, max_key=15_000))
    return workload.answers(ops, order_run(spark, sf_dir), 16)


@query(
    "select * from (values ('DATA_PREFIX', ''), ('RNODE_SIZE', '4096'), ('SNODE_SIZE', '4'), ('FANOUT', '4'), ('MEM_USE', '-1'), ('ONLY_LARGEST', 'false'), ('PROBABLISTIC_MERGE', 'false'), ('BLOOM_BPE', '7'), ('USE_BLOOM_FILTERS', 'false'), ('MAX_VAL_SIZE', '128'), ('MERGE_IN_BACKGROUND', 'false'), ('BUFFER_SIZE', '0'), ('BYTES_PER_SECOND', '115343360')) t(name, value)"
)
def config_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CONFIG.frame(spark)
