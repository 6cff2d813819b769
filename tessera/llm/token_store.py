"""Content-addressed store of token ids.

Layout of a store (Parquet, written by Spark, so a lost executor or a retried task leaves no
partial file behind):

* ``staged``   key (16 bytes of BLAKE2b over the ids), ids (little-endian uint16): each different chunk once
* ``recipes``  segment, doc_id, start, n_tokens, chunks (the hashes in order, 16 bytes each), leaf; ascending doc_id
* ``manifest`` segment, n_docs, n_tokens, root: Merkle root over the leaves of the segment's documents
* ``root``     n_docs, n_tokens, root: Merkle root over the segments' roots, and the totals

A leaf is made where a text is encoded, over its doc_id, number of ids and chunk hashes, and roots are made of these leaves.
Verification makes leaves again from the recipes as they stand in the files, and holds roots and totals against the
manifest; so a recipe that was lost, changed or written twice raises. Reading holds every chunk against its hash and every
document's chunks against its number of ids: a chunk that was lost, cut or changed raises, and never makes a shorter text.

A rolling hash over the last WINDOW ids of one document cuts its stream where the hash has
MASK's bits set, so equal passages give equal chunks wherever they stand. Texts are encoded
once: one job emits chunks and recipes together, drops repeats inside each batch, and moves
every remaining chunk to the partition of its hash, where the first of equal ones is kept.
The read side never moves ids: chunk checksums are combined along the recipes, as CRC-32 of
a concatenation follows from the parts' checksums and lengths.

Null or empty text: only the end id. Repeated doc_ids: one recipe per row, ordered by
(doc_id, leaf). Null doc_id: before all others. Empty table: an empty store. Extra columns
are ignored. Repeated rows share their chunks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROWS, as_bytes, materialize, new_path, remove, salted_join
from .tokens import CACHE_WORDS, BulkLowerBpe, loaded, public_path

END_ID = 2
HASH_BYTES = 16
#: Ids that the rolling hash sees (a power of 2), the bits that make a cut (one id in 256 on average), and the limits of a chunk.
WINDOW, MASK, LEAST, MOST = 16, np.uint32(0xFF000000), 32, 2048
#: Bytes of texts that are encoded at once.
BUNDLE = 1 << 20

_GEAR = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 32, size=1 << 16, dtype=np.uint32)


def _candidates(ids: np.ndarray) -> np.ndarray:
    """Places after which the hash may cut. Of several documents one after another, a window that begins in another
    document doesn't matter, as a cut has LEAST ids of its own before it."""
    rolled = _GEAR[ids]
    width = 1
    while width < WINDOW:  # doubles the window: the hash of 2w ids from those of w
        longer = rolled.copy()
        longer[width:] += rolled[:-width] << np.uint32(width)
        rolled, width = longer, 2 * width
    return np.flatnonzero((rolled & MASK) == MASK) + 1


def _cut(candidates: list[int], begin: int, end: int) -> list[int]:
    """Ends of the chunks of the document that stands from begin to end."""
    ends = []
    for at in candidates:
        while at - begin > MOST:
            begin += MOST
            ends.append(begin)
        if at - begin >= LEAST and at < end:
            ends.append(at)
            begin = at
    while end - begin > MOST:
        begin += MOST
        ends.append(begin)
    return [*ends, end]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document's ids; the last is len(ids)."""
    return _cut(_candidates(ids).tolist(), 0, len(ids))


def address(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=HASH_BYTES).digest()


def leaf_of(doc_id: int | None, n_tokens: int, chunks: bytes) -> bytes:
    return address(b"doc:%s:%d:" % (str(doc_id).encode(), n_tokens) + chunks)


class Merkle:
    """Root over any number of leaves in logarithmic memory: equal-sized subtrees are joined as they fill."""

    def __init__(self) -> None:
        self.trees: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        size = 1
        while self.trees and self.trees[-1][0] == size:
            leaf = address(b"node:" + self.trees.pop()[1] + leaf)
            size *= 2
        self.trees.append((size, leaf))

    def root(self) -> bytes:
        out = b""
        for _, tree in reversed(self.trees):
            out = address(b"node:" + tree + out) if out else tree
        return out or address(b"empty")


_ROWS = "is_chunk boolean, key binary, ids binary, doc_id long, n_tokens long, chunks binary"


def _bundles(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    """The texts in order, BUNDLE bytes at once or a longer one alone."""
    out, size = [], 0
    for text in texts:
        size += len(text or b"")
        if out and size > BUNDLE:
            yield out
            out, size = [], len(text or b"")
        out.append(text)
    if out:
        yield out


def _encode(docs: DataFrame, path: str, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(BulkLowerBpe, path)
        encoder.most = words
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            seen: dict[bytes, bytes] = {}
            recipes = []
            doc_ids = iter(batch.column(0).to_pylist())
            for texts in _bundles(as_bytes(batch.column(1))):
                ids, ends = encoder.encode(texts)
                ids = np.insert(ids, ends, END_ID).astype("<u2", copy=False)
                ends = ends + np.arange(1, len(ends) + 1)
                found = _candidates(ids)
                upto = np.searchsorted(found, ends, "right").tolist()
                found, raw, begin, before = found.tolist(), ids.tobytes(), 0, 0
                for end, k in zip(ends.tolist(), upto, strict=True):
                    n, hashes = end - begin, []
                    for cut in _cut(found[before:k], begin, end):
                        chunk = raw[2 * begin : 2 * cut]
                        hashes.append(key := address(chunk))
                        seen.setdefault(key, chunk)
                        begin = cut
                    before, doc_id = k, next(doc_ids)
                    recipes.append((doc_id, n, joined := b"".join(hashes), leaf_of(doc_id, n, joined)))
            n, m = len(seen), len(recipes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([True] * n + [False] * m, pa.bool_()),
                    pa.array([*seen, *(r[3] for r in recipes)], pa.binary()),
                    pa.array([*seen.values(), *[None] * m], pa.binary()),
                    pa.array([None] * n + [r[0] for r in recipes], pa.int64()),
                    pa.array([None] * n + [r[1] for r in recipes], pa.int64()),
                    pa.array([None] * n + [r[2] for r in recipes], pa.binary()),
                ],
                names=[c.split()[0] for c in _ROWS.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ROWS)


def _first_of_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (is_chunk, key), every recipe and the first chunk of each key."""
    last = None
    for batch in batches:
        keep = []
        for is_chunk, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keep.append(not is_chunk or key != last)
            last = key if is_chunk else None
        yield batch.filter(pa.array(keep, pa.bool_()))


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, words: int = CACHE_WORDS) -> str:
    """Encode whole texts, append the end id, and write a store; returns its path. A worker remembers so many `words`."""
    spark = docs.sparkSession
    rows = _encode(docs, vocabulary or public_path("word_bpe_49k.json"), words)
    dealt = rows.repartition("key").sortWithinPartitions("is_chunk", "key").mapInArrow(_first_of_equal, _ROWS)
    dealt.write.option("compression", "zstd").partitionBy("is_chunk").parquet(f"{path}/staged")

    staged = spark.read.schema(_ROWS).parquet(f"{path}/staged")
    recipes = staged.where(~F.col("is_chunk")).select("doc_id", "n_tokens", "chunks", F.col("key").alias("leaf"))
    n = spark.sparkContext.defaultParallelism
    ordered = recipes.repartitionByRange(max(n, _shuffle_partitions(spark)), "doc_id", "leaf").withColumn("segment", F.spark_partition_id())
    ordered.write.parquet(f"{path}/ordered")

    ordered = spark.read.schema("doc_id long, n_tokens long, chunks binary, leaf binary, segment int").parquet(f"{path}/ordered")
    # one row per written range: as many as shuffle partitions
    sizes = ordered.groupBy("segment").agg(F.sum("n_tokens").alias("n")).collect()
    offsets, before = [], 0
    for row in sorted(sizes, key=lambda r: r["segment"]):
        offsets.append((row["segment"], before))
        before += row["n"]
    running = F.sum("n_tokens").over(Window.partitionBy("segment").orderBy("doc_id", "leaf").rowsBetween(Window.unboundedPreceding, -1))
    first = F.broadcast(spark.createDataFrame(offsets, "segment int, first long"))
    (
        ordered.join(first, "segment")
        .select("segment", "doc_id", (F.col("first") + F.coalesce(running, F.lit(0))).alias("start"), "n_tokens", "chunks", "leaf")
        .sortWithinPartitions("segment", "start")
        .write.parquet(f"{path}/recipes")
    )
    # of the leaves as they were encoded, not of the recipes' files
    _roots(ordered.select("segment", "doc_id", "n_tokens", "chunks", "leaf"), False).write.parquet(f"{path}/manifest")
    totals = recipes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    top = _top(spark.read.parquet(f"{path}/manifest"))
    if top[:2] != tuple(totals):
        raise ValueError(f"{tuple(totals)} documents and ids were encoded, but the manifest of {path} has {top[:2]}")
    spark.createDataFrame([top], "n_docs long, n_tokens long, root binary").coalesce(1).write.parquet(f"{path}/root")
    remove(spark, f"{path}/ordered")
    remove(spark, f"{path}/staged/is_chunk=false")
    return path


def _shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


RECIPES = "segment int, doc_id long, start long, n_tokens long, chunks binary, leaf binary"


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key binary, ids binary, is_chunk boolean").parquet(f"{path}/staged").where("is_chunk").select(F.col("key").alias("hash"), "ids")


def _roots(recipes: DataFrame, again: bool) -> DataFrame:
    """Merkle root of each segment, over the leaves as given, or made again from the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, docs, tokens, out = None, Merkle(), 0, 0, []
        for batch in batches:
            for segment, doc_id, n, chunks, leaf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != now and now is not None:
                    out.append((now, docs, tokens, tree.root()))
                    tree, docs, tokens = Merkle(), 0, 0
                now, docs, tokens = segment, docs + 1, tokens + n
                tree.add(leaf_of(doc_id, n, chunks) if again else leaf)
        if now is not None:
            out.append((now, docs, tokens, tree.root()))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                names=["segment", "n_docs", "n_tokens", "root"],
            )

    rows = recipes.repartition("segment").sortWithinPartitions("segment", "doc_id", "leaf")
    return rows.select("segment", "doc_id", "n_tokens", "chunks", "leaf").mapInArrow(run, "segment int, n_docs long, n_tokens long, root binary")


def _top(manifest: DataFrame) -> tuple[int, int, bytes]:
    """Totals and the root over all segments; there is a row for each written range."""
    tree, docs, tokens = Merkle(), 0, 0
    for row in sorted(manifest.collect(), key=lambda r: r["segment"]):
        tree.add(bytes(row["root"]))
        docs, tokens = docs + row["n_docs"], tokens + row["n_tokens"]
    return docs, tokens, tree.root()


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Raise unless the recipes still give every segment's root and these the store's."""
    manifest = spark.read.parquet(f"{path}/manifest")
    now = _roots(read_recipes(spark, path), True).select("segment", *[F.col(c).alias(f"{c}_now") for c in ("n_docs", "n_tokens", "root")])
    same = F.lit(True)
    for c in ("n_docs", "n_tokens", "root"):
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_now"))
    if (bad := manifest.join(now, "segment", "full").where(~same).count()) > 0:
        raise ValueError(f"{bad} segments of {path} don't match their manifest")
    told = [(r["n_docs"], r["n_tokens"], bytes(r["root"])) for r in spark.read.parquet(f"{path}/root").collect()]
    if told != [_top(manifest)]:
        raise ValueError(f"the manifest of {path} doesn't match its root")


def _shift_tables() -> np.ndarray:
    """[k, byte, value]: CRC-32 register after 2**k zero bytes, as the XOR over the register's four bytes."""
    table = np.array([_crc_byte(v) for v in range(256)], dtype=np.uint32)
    one = np.zeros((4, 256), dtype=np.uint32)  # a zero byte: crc = table[crc & 255] ^ (crc >> 8)
    values = np.arange(256, dtype=np.uint32)
    one[0] = table[values]
    for b in range(1, 4):
        one[b] = values << np.uint32(8 * (b - 1))
    out = [one]
    for _ in range(47):
        out.append(np.stack([_apply(out[-1], out[-1][b]) for b in range(4)]))
    return np.stack(out)


def _crc_byte(v: int) -> int:
    for _ in range(8):
        v = (v >> 1) ^ (0xEDB88320 if v & 1 else 0)
    return v


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


_SHIFTS: list[np.ndarray] = []


def crc_before(crcs: np.ndarray, following: np.ndarray) -> np.ndarray:
    """What each part's CRC-32 adds, by XOR, to that of a whole in which so many bytes follow the part."""
    if not _SHIFTS:
        _SHIFTS.append(_shift_tables())
    out = crcs.astype(np.uint32)
    for k in range(int(following.max(initial=0)).bit_length()):
        at = (following >> k) & 1 == 1
        out[at] = _apply(_SHIFTS[0][k], out[at])
    return out


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; a chunk that isn't what its address says raises."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, lengths, crcs = batch.column(0).to_pylist(), [], []
            for key, raw in zip(hashes, batch.column(1).to_pylist(), strict=True):
                if address(raw) != key:
                    raise ValueError(f"chunk {key.hex()} is damaged")
                lengths.append(len(raw) // 2)
                crcs.append(zlib.crc32(np.frombuffer(raw, "<u2").astype("<u4")))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["hash", "n", "crc"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [(start, i, c[i : i + HASH_BYTES]) for start, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i in range(0, len(c), HASH_BYTES)]
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hashes], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["start", "at", "hash"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column(2).null_count:
                raise ValueError(f"{batch.column(2).null_count} chunks of {path} are lost")
            crcs, lengths, following = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            added = crc_before(crcs.astype(np.uint32), following.astype(np.int64) * 4).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(added, pa.int64())], names=["start", "n", "added"])

    chunks = read_chunks(spark, path).mapInArrow(sums, "hash binary, n long, crc long")
    recipes = read_recipes(spark, path)
    # `start` names a document: every one has at least its end id
    links = materialize(recipes.select("start", "chunks").mapInArrow(spread, "start long, at long, hash binary"), "token-links")
    found = salted_join(links, chunks, "hash", links.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), F.xxhash64("start", "at"))
    rest = F.coalesce(F.sum("n").over(Window.partitionBy("start").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = found.select("start", "crc", "n", rest.alias("following")).mapInArrow(combine, "start long, n long, added long")
    whole = parts.groupBy("start").agg(F.bit_xor("added").alias("ids_crc32"), F.sum("n").alias("n"))
    checked = F.when(F.col("n") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.concat(F.lit("chunks don't add up to the document at "), F.col("start").cast("string"))))
    return recipes.select("doc_id", "start", "n_tokens").join(whole, "start", "left").select("doc_id", "start", "n_tokens", checked.alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, start, ids (little-endian uint16) of all documents, or of those whose doc_id is in `wanted`; a lost chunk raises."""
    recipes = read_recipes(spark, path)
    if wanted is not None:
        recipes = recipes.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    links = recipes.select("doc_id", "start", "n_tokens", F.posexplode(F.expr(f"transform(sequence(0, cast(length(chunks) / {HASH_BYTES} as int) - 1), i -> substring(chunks, i * {HASH_BYTES} + 1, {HASH_BYTES}))")).alias("at", "hash"))
    joined = salted_join(links, read_chunks(spark, path), "hash", links.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), F.xxhash64("start", "at"))
    # a null among the parts, which is what a lost chunk leaves, makes the whole null
    found = joined.groupBy("doc_id", "start", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    whole = found.withColumn("ids", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))"))
    good = F.when(F.length("ids") == 2 * F.col("n_tokens"), F.col("ids")).otherwise(F.raise_error(F.concat(F.lit("chunks are lost of the document at "), F.col("start").cast("string"))))
    return whole.select("doc_id", "start", good.alias("ids"))


def token_ids(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, words: int = CACHE_WORDS) -> DataFrame:
    """Write a store of all documents, check its manifest, and return the index read from its files."""
    spark = docs.sparkSession
    path = write_store(docs, path or new_path(spark, "token-store"), vocabulary, words)
    verify_manifest(spark, path)
    return document_index(spark, path)
