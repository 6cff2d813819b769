"""Substring dedup by fixed-block anchors.

A window of WINDOW words, however it lies, covers one of its document's non-overlapping blocks of
BLOCK words. So of two equal windows, each covers a place where a rolling BLOCK-word window of
one document equals a reference block of the other. That gives five steps, in one plan:

0. Rows whose text another row with a smaller doc_id has are copies: every window of theirs starts
   earlier there, so they are cut whole and take no part in what follows.
1. Index and probe: documents are read in chunks. Of every chunk, reference blocks and all other
   rolling windows go, as 32-bit hashes with places, to the bucket of their hash. Windows that a
   chunk has more than once are anchors at once, and go out once for all of their places.
2. Each bucket holds the references' hashes, streams the probes past them, and returns the
   places that hit: anchors. Nothing is paired, so frequent passages cost no more than rare ones.
3. Extension: around its anchors, a document's WINDOW-word windows are named by 96-bit hashes;
   a chunk keeps its first of equal ones, and their bucket finds the first of all, by
   (doc_id, start). Every other one starts earlier elsewhere.
4. Overlapping such windows join to maximal repeats, which are cut from the text.

Buckets are made so many that one holds about BUCKET_WORDS words, at any size of input. A bucket keeps one place of each
key: a place that repeats another's key goes out once HELD places have come together, so a passage that all documents share
takes no more room than any other. Chunks are made of rows in (doc_id, text hash) order, so a task that runs again after
an executor is lost numbers its chunks and places alike.

Equality rests on hashes: blocks of 10 words meet by 32 bits, which only adds candidates; windows by 96 bits, under which two
different ones of n windows are taken for equal with a probability of n ** 2 / 2 ** 97 (6e-5 for the 10 ** 12 windows of about 6 TB that
have an anchor). Words themselves are not compared.

Null or blank text: no words. Texts of fewer than WINDOW words lose nothing. A row is named by its
doc_id and a 64-bit hash of its text, so rows that share a doc_id are judged row by row, and equal places (doc_id, start) are not earlier than each
other. Null doc_id counts as larger than all others. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, plain_words, salted_join

WINDOW, BLOCK = 20, 10
#: Words of a chunk (a longer text is one of its own), and of a bucket on average.
CHUNK_WORDS, BUCKET_WORDS = 500_000, 2_000_000
#: Places of a bucket that wait until those with equal keys are sorted out.
HELD = 1_000_000
#: Bytes of text for a word, to set the number of buckets.
WORD_BYTES = 6
LAST = (1 << 63) - 1
#: A row's name: its doc_id and its text's hash, which tells rows of one doc_id apart but doesn't make one the earlier.
NAME = np.dtype([("id", np.int64), ("row", np.int64)])

_ODD = [np.uint64(int(k) * 2 + 1) for k in np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, size=12, dtype=np.uint64)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _blocks(h: np.ndarray, odd: list[np.uint64]) -> np.ndarray:
    """Hash of the 10 words from every place, by doubling; the last 9 places are no windows."""
    two = h[:-1] * odd[0] + h[1:]
    four = two[:-2] * odd[1] + two[2:]
    eight = four[:-4] * odd[2] + four[4:]
    return eight[:-2] * odd[3] + two[8:]


def block_hashes(h: np.ndarray) -> np.ndarray:
    return _mixed(_blocks(h, _ODD[:4]))


def window_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits for the 20 words from every place."""
    a, b = _blocks(h, _ODD[:4]), _blocks(h, _ODD[4:8])
    return _mixed(a[:-BLOCK] * _ODD[8] + a[BLOCK:]), (_mixed(b[:-BLOCK] * _ODD[9] + b[BLOCK:]) >> np.uint64(32)).astype(np.uint32)


class Chunk:
    """Documents in (doc_id) order, their word hashes one after the other."""

    def __init__(self, docs: list[tuple]):
        docs.sort(key=lambda d: d[:2])
        self.docs = docs
        lengths = np.array([len(d[2]) for d in docs], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        self.hashes = np.concatenate([d[2] for d in docs])
        self.ids = np.array([d[:2] for d in docs], NAME)

    def valid(self, size: int) -> np.ndarray:
        """Places where a window of `size` words lies in one document."""
        good = np.ones(max(0, len(self.hashes) - size + 1), bool)
        for end in self.starts[1:]:
            good[max(0, end - size + 1) : end] = False
        return np.flatnonzero(good)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    docs, n = [], 0
    for batch in batches:
        extra = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
        for doc_id, row, text, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), extra, strict=True):
            words = plain_words(text)
            if len(words) < WINDOW:
                continue
            docs.append((LAST if doc_id is None else doc_id, row, word_hashes(words), more))
            n += len(words)
            if n >= CHUNK_WORDS:
                yield Chunk(docs)
                docs, n = [], 0
    if docs:
        yield Chunk(docs)


def _first(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of each key's first occurrence, the number of occurrences, and for every place its key's number."""
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first, counts, inverse


def _split(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """Per bucket: its number and its part of each array, in the order they stand in."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    values, at = np.unique(bucket[order], return_index=True)
    for value, a, b in zip(values.tolist(), at, [*at[1:], len(order)], strict=True):
        yield (value, *(x[order[a:b]] for x in arrays))


def _gaps(places: np.ndarray) -> bytes:
    """Rising places as differences, in two bytes where they fit."""
    gaps = np.diff(places, prepend=0)
    return gaps.astype("<u2" if gaps.max(initial=0) < 1 << 16 else "<u4").tobytes()


def _places(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64))


#: Rows between steps 1 and 2: references, probes, a chunk's documents, and places that hit.
REFERENCE, PROBE, TABLE, HIT = range(4)
_ROWS = "part long, kind int, chunk long, a binary, b binary"
_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())


def _batch(rows: list[tuple], schema: str, types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[c.split()[0] for c in schema.split(", ")])


def _emit(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for k, chunk in enumerate(_chunks(batches)):
            name = base + k
            places = chunk.valid(BLOCK)
            keys = block_hashes(chunk.hashes)[places]
            aligned = (places - chunk.starts[chunk.document(places)]) % BLOCK == 0
            first, counts, inverse = _first(keys)
            reference = np.zeros(len(first), bool)
            reference[inverse[aligned]] = True
            twice = counts > 1
            rows = [(-1 - name, TABLE, name, chunk.ids.tobytes(), chunk.starts.tobytes()), (-1 - name, HIT, name, places[twice[inverse]].astype("<u4").tobytes(), b"")]
            for kind, own in ((REFERENCE, reference), (PROBE, ~reference & ~twice)):
                at = np.sort(first[own])
                for part, key, place in _split(((keys[at] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), keys[at].astype("<u4"), places[at]):
                    rows.append((part, kind, name, key.tobytes(), _gaps(place)))
            yield _batch(rows, _ROWS, _TYPES)

    return run


class References:
    """A bucket's reference keys, one entry (key, chunk, place) of each, and the places that repeat a key."""

    def __init__(self) -> None:
        self.keys, self.chunks, self.places, self.told = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.waiting: list[tuple] = []
        self.n = 0

    def add(self, chunk: int, raw: bytes, gaps: bytes) -> list[tuple]:
        keys = np.frombuffer(raw, "<u4")
        self.waiting.append((keys, np.full(len(keys), chunk, np.int64), _places(gaps, len(keys)), np.zeros(len(keys), bool)))
        self.n += len(keys)
        return self.settled() if self.n > max(HELD, len(self.keys)) else []

    def settled(self) -> list[tuple]:
        """Hits among the waiting entries; of each key the first entry stays, marked if it has gone out."""
        if not self.waiting:
            return []
        every = [np.concatenate(x) for x in zip((self.keys, self.chunks, self.places, self.told), *self.waiting, strict=True)]
        self.waiting, self.n = [], 0
        order = np.argsort(every[0], kind="stable")
        keys, chunks, places, told = (x[order] for x in every)
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        group = np.cumsum(fresh) - 1
        several = np.bincount(group)[group] > 1
        out = several & ~told
        self.keys, self.chunks, self.places, self.told = keys[fresh], chunks[fresh], places[fresh], (told | several)[fresh]
        return [(0, HIT, chunk, place.astype("<u4").tobytes(), b"") for chunk, place in _split(chunks[out], places[out])]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by (part, kind): tables and hits as they are, and the places of references and probes that hit."""
    now, held = None, References()
    for batch in batches:
        rows: list[tuple] = []
        for part, kind, chunk, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != now:
                rows += held.settled()
                now, held = part, References()
            if kind in (TABLE, HIT):
                rows.append((part, kind, chunk, a, b))
            elif kind == REFERENCE:
                rows += held.add(chunk, a, b)
            else:
                rows += held.settled()
                keys = np.frombuffer(a, "<u4")
                if len(held.keys):
                    at = np.minimum(np.searchsorted(held.keys, keys), len(held.keys) - 1)
                    if (hit := held.keys[at] == keys).any():
                        rows.append((part, HIT, chunk, _places(b, len(keys))[hit].astype("<u4").tobytes(), b""))
        yield _batch(rows, _ROWS, _TYPES)
    yield _batch(held.settled(), _ROWS, _TYPES)


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by (chunk, kind): the anchors of each document."""
    now, ids, starts, found = None, None, None, []

    def told() -> list[tuple]:
        places = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        if not len(places):
            return []
        docs = np.searchsorted(starts, places, side="right") - 1
        return [(*ids[d].item(), own.astype("<u4").tobytes()) for d, own in _split(docs, places - starts[docs])]

    for batch in batches:
        rows: list[tuple] = []
        for kind, chunk, a, b in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
            if chunk != now:
                rows += told()
                now, found = chunk, []
            if kind == TABLE:
                ids, starts = np.frombuffer(a, NAME), np.frombuffer(b, np.int64)
            else:
                found.append(np.frombuffer(a, "<u4").astype(np.int64))
        yield _batch(rows, _HITS, _HIT_TYPES)
    yield _batch(told(), _HITS, _HIT_TYPES)


_HITS, _HIT_TYPES = "id long, row long, places binary", (pa.int64(), pa.int64(), pa.binary())

#: Rows between steps 3 and 4: windows for a bucket (keys, marks), and places known to be repeats (part below 0).
_WINDOWS = "part long, keys binary, marks binary, ids binary, counts binary, starts binary"
_WINDOW_TYPES = (pa.int64(), *[pa.binary()] * 5)


def _extend(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            near = np.zeros(len(chunk.hashes) + 1, np.int64)
            for begin, end, (*_, more) in zip(chunk.starts[:-1], chunk.starts[1:], chunk.docs, strict=True):
                at = np.concatenate([np.frombuffer(m, "<u4") for m in more]).astype(np.int64) + begin
                at = at[at + BLOCK <= end]
                np.add.at(near, np.maximum(at - (WINDOW - BLOCK), begin), 1)
                np.add.at(near, at + 1, -1)
            wide = chunk.valid(WINDOW)
            places = wide[np.cumsum(near)[wide] > 0]
            if not len(places):
                continue
            keys, marks = (x[places] for x in window_hashes(chunk.hashes))
            first, _, inverse = _first(keys)
            docs = chunk.document(places)
            ids, starts = chunk.ids[docs], places - chunk.starts[docs]
            # chunks are in (doc_id, start) order, so the first place is the earliest
            lead = first[inverse]
            later = (ids["id"] != ids["id"][lead]) | (starts != starts[lead])
            rows = [(-1 - chunk.docs[0][0] % buckets, None, None, *_runs(ids[later]), starts[later].astype("<u4").tobytes())]
            at = np.sort(first)
            for part, key, mark, own, start in _split((marks[at] % np.uint32(buckets)).astype(np.int32), keys[at], marks[at], ids[at], starts[at]):
                rows.append((part, key.tobytes(), mark.tobytes(), *_runs(own), start.astype("<u4").tobytes()))
            yield _batch(rows, _WINDOWS, _WINDOW_TYPES)

    return run


#: Places by document on their way to the documents: one row per bucket and range of documents.
_PACKS = "part long, ids binary, counts binary, starts binary"
_PACK_TYPES = (pa.int64(), *[pa.binary()] * 3)


def _runs(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted ids as each different one and how often it stands."""
    edge = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.empty(0, np.int64)
    return ids[edge].tobytes(), np.diff(edge, append=len(ids)).astype("<u4").tobytes()


def _told(ids: np.ndarray, starts: np.ndarray, ranges: int) -> list[tuple]:
    part = (_mixed((ids["id"] ^ ids["row"]).astype(np.uint64)) % np.uint64(ranges)).astype(np.int32)
    return [(p, *_runs(own), at.astype("<u4").tobytes()) for p, own, at in _split(part, ids, starts)]


def _spread(ids: bytes, counts: bytes) -> np.ndarray:
    return np.repeat(np.frombuffer(ids, NAME), np.frombuffer(counts, "<u4"))


class Windows:
    """A bucket's windows: of each key the earliest places (equal ones stand in rows with one doc_id); all others go out as they are passed."""

    def __init__(self, ranges: int) -> None:
        self.ranges, self.kept = ranges, 0
        self.waiting: list[tuple] = []
        self.n = 0

    def add(self, keys: bytes, marks: bytes, ids: np.ndarray, starts: np.ndarray) -> list[tuple]:
        self.waiting.append((np.frombuffer(keys, np.uint64), np.frombuffer(marks, np.uint32), ids, starts))
        self.n += len(ids)
        return self.settled() if self.n > self.kept + max(HELD, self.kept) else []

    def settled(self) -> list[tuple]:
        if not self.waiting:
            return []
        keys, marks, ids, starts = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        order = np.lexsort((ids["row"], starts, ids["id"], marks, keys))
        keys, marks, ids, starts = keys[order], marks[order], ids[order], starts[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (marks[1:] != marks[:-1])
        lead = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))
        first = (ids["id"] == ids["id"][lead]) & (starts == starts[lead])
        self.waiting = [(keys[first], marks[first], ids[first], starts[first])]
        self.kept = self.n = int(first.sum())
        later = np.flatnonzero(~first)
        later = later[np.lexsort((ids["row"][later], ids["id"][later]))]
        return _told(ids[later], starts[later], self.ranges)


def _later(ranges: int):
    """Of rows by part: the starts of windows that start earlier elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Windows(ranges)
        for batch in batches:
            rows: list[tuple] = []
            for part, keys, marks, ids, counts, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, at = _spread(ids, counts), np.frombuffer(starts, "<u4").astype(np.int64)
                if part < 0:
                    rows += _told(own, at, ranges)
                    continue
                if part != now:
                    rows += held.settled()
                    now, held = part, Windows(ranges)
                rows += held.add(keys, marks, own, at)
            yield _batch(rows, _PACKS, _PACK_TYPES)
        yield _batch(held.settled(), _PACKS, _PACK_TYPES)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packs by part: a row per document."""
    now, held = None, []

    def told() -> list[tuple]:
        if not held:
            return []
        ids, starts = (np.concatenate([h[k] for h in held]) for k in range(2))
        order = np.lexsort((ids["row"], ids["id"]))
        ids, starts = ids[order], starts[order]
        edge = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.empty(0, np.int64)
        return [(*ids[a].item(), starts[a:b].astype("<u4").tobytes()) for a, b in zip(edge, [*edge[1:], len(ids)], strict=True)] if len(ids) else []

    for batch in batches:
        rows: list[tuple] = []
        for part, ids, counts, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != now:
                rows += told()
                now, held = part, []
            held.append((_spread(ids, counts), np.frombuffer(starts, "<u4").astype(np.int64)))
        yield _batch(rows, _HITS, _HIT_TYPES)
    yield _batch(told(), _HITS, _HIT_TYPES)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, repeats, copy in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = plain_words(text)
            if copy and len(words) >= WINDOW:
                rows.append((doc_id, len(words), len(words), "", [0, len(words)]))
                continue
            if not repeats:
                rows.append((doc_id, len(words), 0, b" ".join(words).decode("utf-8", "replace"), []))
                continue
            covered = np.zeros(len(words) + 1, np.int64)
            at = np.unique(np.concatenate([np.frombuffer(m, "<u4") for m in repeats])).astype(np.int64)
            at = at[at + WINDOW <= len(words)]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + WINDOW, -1)
            gone = np.cumsum(covered)[:-1] > 0
            edges = np.flatnonzero(np.diff(gone, prepend=False, append=False)).tolist()
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            rows.append((doc_id, len(words), int(gone.sum()), b" ".join(kept).decode("utf-8", "replace"), edges))
        yield _batch(rows, "doc_id, n_words, n_removed, kept, repeats", (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id", "row").agg(F.collect_list("places").alias("places"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space), repeats (begin and end of each
    maximal repeat that was cut, in words)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, total // (WORD_BYTES * BUCKET_WORDS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64("text").alias("row"))
    # every join by id and row below reads the same exchange of the texts
    texts = texts.join(_copies(texts), ["id", "row"], "left").select("doc_id", "text", "id", "row", F.coalesce("copy", F.lit(False)).alias("copy"))
    fresh = texts.where(~F.col("copy"))

    # in this order a row's chunk and place are the same when a task is run again; the join has it already, where it sorts
    ordered = fresh.select("doc_id", "row", "text", "id").sortWithinPartitions("id", "row").select("doc_id", "row", "text")
    emitted = ordered.mapInArrow(_emit(buckets), _ROWS)
    anchors = emitted.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_anchors, _ROWS)
    hits = anchors.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(_by_document, _HITS)

    windows = fresh.join(_merged(hits), ["id", "row"]).select("doc_id", "row", "text", "places").mapInArrow(_extend(buckets), _WINDOWS)
    later = windows.repartition("part").sortWithinPartitions("part").mapInArrow(_later(buckets), _PACKS)
    cut = later.repartition("part").sortWithinPartitions("part").mapInArrow(_unpacked, _HITS)
    joined = texts.join(_merged(cut), ["id", "row"], "left").select("doc_id", "text", "places", "copy")
    return joined.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string, repeats array<long>")


def _copies(texts: DataFrame) -> DataFrame:
    """id, row, copy: the rows whose text a row with a smaller id has too. A text that many rows have is dealt in pieces."""
    digests = texts.select("id", "row", F.md5("text").alias("digest"))
    first = digests.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
    first = materialize(first, "copied")  # only of texts that several ids have
    found = salted_join(digests.where(F.col("digest").isNotNull()), first.select("digest", "first"), "digest", first.select("digest", "n"), F.xxhash64("id", "row"))
    return found.where(F.col("id") > F.col("first")).select("id", "row").distinct().withColumn("copy", F.lit(True))
