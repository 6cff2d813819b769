"""Near-duplicate documents by SetSketch registers.

A document's set holds its 3-word shingles (hashed to 64 bits); the functions take rules, of which
CONTRACT has that of op6 alone and STAGE one on 5-word shingles too. With several rules a document
has a set and a sketch for each, and is linked to another where any rule links them: two rules keep
no pair apart that one of them finds. A sketch has M registers: the
least of M hash values over the set, read as a minimum of exponential variables with rate RATE
and kept as a truncated exponent to base BASE. Registers of a union are the larger of the two,
so sketches merge; equal registers are about as likely as the Jaccard similarity of the sets.

1. Documents with equal sets (by every rule) are one class; only one of each class goes on.
2. Bands of a rule's registers are hashed to keys; classes that share a key are candidates. A pair at
   85 per cent shares no key with a probability of (1 - 0.85 ** ROWS) ** BANDS = 2e-7, one at 80 per
   cent by STAGE's second rule with (1 - 0.8 ** 5) ** 38 = 3e-7.
3. In each group of a key, every class is compared with the leader, the class that shares most keys
   with others: by the joint maximum-likelihood estimate from both sketches and set sizes, and
   then, from a rule's prune on, on full sets. Links found so give components, which hold nearly all.
4. Where a leader's group still has members of different components, its members' differences
   from the leader (shingles that only one of the two sets has) are listed. Two members' symmetric
   difference is |A| + |B| - 2 |A & B| of these lists, so their similarity is exact. Members with
   no link to the leader are the only ones that can add links. They are dealt into blocks, and all members into pieces;
   in each cell of this grid a block is indexed by shingle and a piece streams past it, so no task grows with a group.
   A block has BLOCK members at most and a piece as many, or PIECE where the group has fewer without a link, so rows are
   copied about once each unless more than BLOCK members of one group have no link. A cell tells only links that join components.
5. Links are contracted to components; a component is named by its smallest doc_id.

A step's shuffle files go when it ends, and sketches, keys and differences when nothing reads them any more, so the
disk in use is that of one step.

So no pairs within a group are made into rows, and a link between different texts that share a key
is either found or lies within a component found without it.

Empty sets (null or blank text) are linked with nothing. Repeated rows and equal doc_ids: a row
each; equal sets share the component. Null doc_id counts as larger than all others. Extra
columns, whatever their names, are ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import Scratch, as_bytes, free_name, left_join, map_arrow, materialize, shuffles_freed
from .components import components

SHINGLE, PERCENT = 3, 85
ROWS, BANDS = 6, 32
M = ROWS * BANDS
BASE, RATE, LIMIT = 1.001, 20.0, 65534
#: Pairs estimated under this are not tested in step 3: over 5 standard errors (0.026 at 0.85) below a link.
PRUNE = 0.7


class Rule(NamedTuple):
    """Words of a shingle, least similarity in per cent, and how candidates are found for it."""

    shingle: int
    percent: int
    rows: int
    bands: int
    prune: float


CONTRACT = (Rule(SHINGLE, PERCENT, ROWS, BANDS, PRUNE),)
#: The pipeline's: copies that differ by one passage count from 80 per cent on. 0.65 is 5 standard errors (0.029) below.
STAGE = (*CONTRACT, Rule(5, 80, 5, 38, 0.65))
#: Members without a link to their leader that are held at once in step 4.
BLOCK = 4096
#: Members of a group that are compared in one piece.
PIECE = 256

_RANDOM = np.random.Generator(np.random.PCG64(6))
_FACTORS = _RANDOM.integers(0, 1 << 31, size=M, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, size=M, dtype=np.uint32)
_MIX = [np.uint64(int(k) * 2 + 1) for k in _RANDOM.integers(0, 1 << 63, size=max(r.shingle for r in STAGE), dtype=np.uint64)]

UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def shingle_sets(text: bytes | None, rules: tuple[Rule, ...] = CONTRACT) -> list[np.ndarray]:
    """For each rule, sorted distinct hashes of the shingles; of the whole sequence, if it has fewer words; empty without words."""
    words = text.translate(UPPER).split() if text else []
    if not words:
        return [np.empty(0, np.uint64)] * len(rules)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = []
    for rule in rules:
        n = len(words) - rule.shingle + 1
        if n < 1:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64))
            continue
        total = h[:n] * _MIX[0]
        for k in range(1, rule.shingle):
            total += h[k : n + k] * _MIX[k]
        out.append(np.unique(_mixed(total)))
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """M registers (uint16)."""
    least = np.full(M, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        part = _FACTORS[:, None] * short[None, at : at + 1024]
        part += _SHIFTS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def band_keys(raw: bytes, rules: tuple[Rule, ...] = CONTRACT) -> list[int]:
    """Of the rules' sketches, one after the other."""
    keys = []
    for at, rule in enumerate(rules):
        width, begin = 2 * rule.rows, 2 * M * at
        keys += [xxhash.xxh3_64_intdigest(raw[begin + k * width : begin + (k + 1) * width], seed=M * at + k) for k in range(rule.bands)]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def estimate(up: np.ndarray, down: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood similarity from the numbers of registers where a is larger and where b is."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    same = M - up - down

    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        return up * np.log(a) + down * np.log(b) + same * np.log(np.clip(1 - a - b, 1e-12, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one peak
        third = (high - low) / 3
        right = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(right, low + third, low), np.where(right, high, high - third)
    return (low + high) / 2


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def key_of(sets: list[np.ndarray]) -> bytes | None:
    """Names a document's sets; null for empty ones."""
    return xxhash.xxh3_128_digest(b"".join(s.tobytes() for s in sets)) if len(sets[0]) else None


def sketched(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, n (a size for each rule), set_key (16 bytes over the sets, null if empty), sketch (the rules' one after the other)."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, keys, registers = [], [], []
        for text in as_bytes(batch.column(1)):
            sets = shingle_sets(text, rules)
            n.append([len(s) for s in sets])
            keys.append(key_of(sets))
            registers.append(b"".join(sketch(s).tobytes() for s in sets) if n[-1][0] else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.list_(pa.int64())), pa.array(keys, pa.binary()), pa.array(registers, pa.binary())], names=["doc_id", "n", "set_key", "sketch"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), fn, "doc_id long, n array<long>, set_key binary, sketch binary")


def _keys(classes: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [k for r in batch.column(1).to_pylist() for k in band_keys(r, rules)]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sum(r.bands for r in rules))), pa.array(keys, pa.int64())], names=["node", "key"])

    return map_arrow(classes.select("node", "sketch"), fn, "node long, key long")


def _dealt(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of pairs' members, each with its leader's row before it in the same piece: leader, piece, node, own columns."""
    pieces = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    members = pairs.join(pieces, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int").alias("piece"), "node")
    leaders = pieces.select("leader", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("leader").alias("node"))
    return members.unionByName(leaders).join(rows.select("node", *columns), "node").repartition("leader", "piece").sortWithinPartitions("leader", "piece", F.col("node") != F.col("leader"))


_KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def _compared(dealt: DataFrame, load: Callable, compare: Callable, out: str) -> DataFrame:
    """compare([(leader, node, leader's value, node's value)]) over the pairs of each batch; load makes a row's value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, None
        for batch in (b.slice(k, PIECE) for b in batches for k in range(0, b.num_rows, PIECE)):
            pairs = []
            heads = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            values = zip(*(batch.column(k).to_pylist() for k in range(3, batch.num_columns)), strict=True)
            for (leader, piece, node), value in zip(heads, values, strict=True):
                if (leader, piece) != at:
                    at, first = (leader, piece), None
                if (own := load(*value)) is None:
                    continue
                if node == leader:
                    first = own
                else:
                    pairs.append((leader, node, first, own))
            rows = compare(pairs) if pairs else []
            names = [c.split() for c in out.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _KINDS[kind]) for k, (_, kind) in enumerate(names)], names=[n for n, _ in names])

    return dealt.select("leader", "piece", "node", *dealt.columns[3:]).mapInArrow(run, out)


def _estimated(pairs: DataFrame, classes: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """leader, node of the pairs that any rule estimates at its prune or more."""

    def compare(pairs: list) -> list:
        likely = np.zeros(len(pairs), bool)
        for at, rule in enumerate(rules):
            one, two = (np.stack([p[k][1][M * at : M * (at + 1)] for p in pairs]) for k in (2, 3))
            sizes = [np.array([p[k][0][at] for p in pairs], np.float64) for k in (2, 3)]
            likely |= estimate((one > two).sum(axis=1), (one < two).sum(axis=1), *sizes) >= rule.prune
        return [p[:2] for p, j in zip(pairs, likely.tolist(), strict=True) if j]

    return _compared(_dealt(pairs, classes, ["n", "sketch"]), lambda n, raw: (n, np.frombuffer(raw, np.uint16)), compare, "leader long, node long")


_TESTED = "leader long, node long, linked boolean, n array<long>, apart array<long>, differences array<long>"


def _verified(pairs: DataFrame, texts: DataFrame, with_differences: bool, rules: tuple[Rule, ...]) -> DataFrame:
    """leader, node, whether any rule links them, and (if asked for) for each rule the node's set's size, the number of
    shingles that only one of the two sets has, and these, the rules' one after the other."""

    def compare(pairs: list) -> list:
        out = []
        for leader, node, ones, twos in pairs:
            found = [similarity(one, two) for one, two in zip(ones, twos, strict=True)]
            linked = any(100 * both >= rule.percent * union for rule, (both, union) in zip(rules, found, strict=True))
            only = [np.setxor1d(one, two, assume_unique=True).view(np.int64) for one, two in zip(ones, twos, strict=True)] if with_differences else []
            out.append((leader, node, linked, [len(two) for two in twos], [len(x) for x in only], np.concatenate(only) if only else []))
        return out

    def load(text: str, set_key: bytes) -> list[np.ndarray] | None:
        """None for a text that shares its doc_id with the class's, but isn't it."""
        sets = shingle_sets(text.encode() if text is not None else None, rules)
        return sets if key_of(sets) == set_key else None

    return _compared(_dealt(pairs, texts, ["text", "set_key"]), load, compare, _TESTED)


_IN_CELLS = "leader", "block", "piece", "streams", "node", "root", "n", "apart", "differences"


def _joining(tested: DataFrame, roots: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """a, b: links within leaders' groups that join different components."""
    placed = tested.dropDuplicates(["leader", "node"]).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    scratch = Scratch()
    placed = scratch.write(placed, "differences")
    sizes = placed.groupBy("leader").agg(F.count(F.lit(1)).alias("members"), F.count_if(~F.col("linked")).alias("alone"))
    grid = sizes.where("alone > 0").select(
        "leader", "members", F.ceil(F.col("alone") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("members") / F.greatest(F.lit(PIECE), F.least("alone", F.lit(BLOCK)))).cast("int").alias("pieces")
    )
    grid = materialize(grid, "grid")
    rows = left_join(placed, grid.drop("members"), "leader", grid.select("leader", F.col("members").alias("n")), F.xxhash64("node")).where(F.col("blocks").isNotNull())
    dealt = lambda column, salt: F.pmod(F.xxhash64("node", F.lit(salt)), column).cast("int")
    every = lambda column: F.explode(F.sequence(F.lit(0), F.col(column) - 1))
    held = rows.where(~F.col("linked")).withColumns({"block": dealt("blocks", 0), "streams": F.lit(False)}).withColumn("piece", every("pieces"))
    streams = rows.withColumns({"piece": dealt("pieces", 1), "streams": F.lit(True)}).withColumn("block", every("blocks"))
    cells = held.select(*_IN_CELLS).unionByName(streams.select(*_IN_CELLS)).repartition("leader", "block", "piece").sortWithinPartitions("leader", "block", "piece", "streams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in batches:
            found = []
            differences = batch.column(8)
            values, offsets = differences.values.to_numpy(), differences.offsets.to_numpy()
            for k, (leader, number, piece, streaming, node, root, n, apart) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True)):
                if (leader, number, piece) != at:
                    at, block = (leader, number, piece), Block(rules)
                own = np.split(values[offsets[k] : offsets[k + 1]], np.cumsum(apart)[:-1])
                if streaming:
                    found += block.links(node, root, n, own)
                else:
                    block.add(node, root, n, own)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["a", "b"])

    found = materialize(cells.mapInArrow(run, "a long, b long"), "joining")
    scratch.drop(placed)
    return found


class Block:
    """Members of a group, indexed by their differences from its leader."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.rows: list[tuple[int, int]] = []
        self.sizes: list[list[tuple[int, int]]] = [[] for _ in rules]
        self.parts: list[list[np.ndarray]] = [[] for _ in rules]
        self.index: list[tuple] | None = None
        self.parent: dict[int, int] = {}

    def add(self, node: int, root: int, n: list[int], differences: list[np.ndarray]) -> None:
        self.rows.append((node, root))
        for at, own in enumerate(differences):
            self.sizes[at].append((n[at], len(own)))
            self.parts[at].append(own.copy())

    def _find(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = self.parent[up] if up in self.parent else up
            x = up
        return x

    def _indexed(self, at: int) -> tuple:
        parts = self.parts[at]
        values = np.concatenate(parts) if parts else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(values, kind="stable")
        return values[order], owner[order], np.array(self.sizes[at], np.int64).reshape(-1, 2)

    def links(self, node: int, root: int, n: list[int], differences: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links to held members whose component is another one so far."""
        if self.index is None:
            self.index = [self._indexed(at) for at in range(len(self.rules))]
            self.parts = []
        linked = np.zeros(len(self.rows), bool)
        for rule, (values, owner, sizes), size, own in zip(self.rules, self.index, n, differences, strict=True):
            low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            hit = high > low
            if not hit.any():
                continue
            shared = np.bincount(np.concatenate([owner[a:b] for a, b in zip(low[hit].tolist(), high[hit].tolist(), strict=True)]), minlength=len(sizes))
            apart = sizes[:, 1] + len(own) - 2 * shared
            # 100 |x & y| >= percent |x | y|, with both doubled
            total = sizes[:, 0] + size
            linked |= (shared > 0) & (100 * (total - apart) >= rule.percent * (total + apart))
        out = []
        for k in np.flatnonzero(linked).tolist():
            other, its = self.rows[k]
            one, two = self._find(root), self._find(its)
            if one != two:
                self.parent[one] = two
                out.append((node, other))
        return out


def _classes(sketches: DataFrame) -> DataFrame:
    """set_key, doc_id (smallest), n, sketch, node (a number)."""
    one = sketches.where(F.col("n")[0] > 0).groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "n", "sketch")).alias("x"))
    return one.select("set_key", "x.doc_id", "x.n", "x.sketch").withColumn("node", F.monotonically_increasing_id())


def _candidates(classes: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame]:
    """leader, node of all pairs within a key's group, and of those that any rule finds likely."""
    scratch = Scratch()
    keys = scratch.write(_keys(classes, rules), "keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    grouped = scratch.write(keys.join(sizes, "key"), "groups")
    scratch.drop(keys)
    crowds = grouped.groupBy("node").agg(F.sum("size").alias("crowd"))
    leaders = grouped.join(crowds, "node").groupBy("key").agg(F.max(F.struct("crowd", (-F.col("node")).alias("back"))).alias("x")).select("key", (-F.col("x.back")).alias("leader"))
    pairs = materialize(grouped.join(leaders, "key").where(F.col("node") != F.col("leader")).select("leader", "node").distinct(), "pairs")
    scratch.drop(grouped)
    return pairs, materialize(_estimated(pairs, classes, rules), "likely")


def links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, likely: DataFrame, rules: tuple[Rule, ...] = CONTRACT) -> DataFrame:
    """a, b: verified links between classes that connect all that are linked."""
    tested = _verified(likely, _texts(docs, classes, likely), False, rules).where("linked")
    near = materialize(tested.select(F.col("leader").alias("a"), F.col("node").alias("b")), "near")
    roots = components(near)

    placed = pairs.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("leader").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") != F.col("high")).select("leader")
    rest = materialize(pairs.join(mixed, "leader"), "mixed")
    listed = _verified(rest, _texts(docs, classes, rest), True, rules)
    return near.unionByName(_joining(listed, roots, rules))


def _texts(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, text, set_key of the classes in pairs, by the doc_id of the class."""
    wanted = pairs.select("node").union(pairs.select("leader")).distinct()
    names = classes.join(wanted, "node").select("node", F.col("doc_id").alias("of"), "set_key")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(names, F.col("doc_id").eqNullSafe(F.col("of"))).select("node", "text", "set_key")


def _named(docs: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame]:
    """doc_id, n (by the first rule), set_key of each row, and set_key, doc_id, root, component_id of each class."""
    scratch = Scratch()
    with shuffles_freed(docs.sparkSession):
        sketches = scratch.write(sketched(docs, rules), "sketches")
        whole = scratch.write(_classes(sketches), "classes")
        sets = materialize(sketches.select("doc_id", F.col("n")[0].alias("n"), "set_key"), "sets")
        scratch.drop(sketches)
        pairs, likely = _candidates(whole, rules)
        classes = materialize(whole.select("set_key", "doc_id", "node"), "names")
        scratch.drop(whole)
        roots = components(links(docs, classes, pairs, likely, rules))
    names = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = names.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return sets, names.join(least, "root").select("set_key", "doc_id", "root", "component_id")


def near_duplicates(docs: DataFrame, rules: tuple[Rule, ...] = CONTRACT) -> DataFrame:
    """doc_id, n_shingles (by the first rule), component_id, kept: one row per document row."""
    sets, classes = _named(docs, rules)
    joined = sets.join(classes.select("set_key", "component_id"), "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, rules: tuple[Rule, ...] = CONTRACT) -> DataFrame:
    """One document of each component, that with the smallest doc_id, and all documents with empty sets; all columns of docs."""
    sets, classes = _named(docs, rules)
    # where the smallest doc_id stands for several sets, the smallest key decides
    own, key, doc = (free_name(c, docs.columns) for c in ("__set", "__key", "__doc"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias(doc), F.col("set_key").alias(key)))
    chosen = classes.groupBy("root").agg(least.alias("x")).select(f"x.{doc}", f"x.{key}")
    text = docs.columns.index("text")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [key_of(shingle_sets(t, rules)) for t in as_bytes(batch.column(text))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, own])

    keyed = map_arrow(docs, fn, StructType([*docs.schema.fields, StructField(own, BinaryType())]))
    kept = keyed.join(chosen, (F.col(own) == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left")
    kept = kept.where(F.col(own).isNull() | F.col(key).isNotNull())
    with shuffles_freed(docs.sparkSession):
        repeated = not sets.where("n > 0").groupBy("doc_id", "set_key").count().where(F.col("count") > 1).isEmpty()
    if repeated:
        alone = kept.where(F.col(own).isNotNull()).dropDuplicates([own])  # equal rows: one of them
        kept = alone.unionByName(kept.where(F.col(own).isNull()))
    return kept.select(*docs.columns)
