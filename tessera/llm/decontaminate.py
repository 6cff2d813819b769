"""Benchmark decontamination with one Aho-Corasick automaton over words.

Words of the benchmark get numbers, and every item is one sequence of them. A window is WINDOW consecutive
words of an item (all its words, if fewer). The automaton's patterns are the items' non-overlapping pieces
of PIECE words, and items shorter than a window as they are: a window of 10 words holds a whole piece of 5,
however it lies, so a text has a window of an item just where a piece of it stands and the run of equal
words around that piece is WINDOW long or longer. A text's word numbers pass through the automaton once;
where a piece ends, the run is extended to both sides along the item. So the automaton has no more nodes
than the benchmark has words, instead of ten times as many. Word numbers of hits are mapped to
code-point offsets of the original text.

The benchmark's size is bound where it leaves the executors: items are dealt by their hash into parts of about
PART_BYTES of text (a whole public benchmark is one part), which the driver collects and broadcasts one by one as
word numbers. Every part has its automaton; a worker holds one at a time, passes its batch of texts through
one after the other, and joins the hits of a text in place. Texts are read and cut into words once, whatever the
number of parts.

Null or empty text (document or item): no words, no hit. Items with the same item_id count
once; repeated document rows are reported row by row. An item_id that is null is named
"null". Extra columns are ignored (``decontaminate`` keeps them). Empty tables: no hits.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, as_bytes, map_arrow

WINDOW, PIECE = 10, 5
#: Benchmark text of one part; its automaton takes about 20 times as many bytes of a worker's memory at most.
PART_BYTES = 8 << 20

#: Fixed by the word definition: letters and digits of ASCII, and all other characters.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_BUILT: dict[str, Benchmark] = {}


class Benchmark:
    """Items' words as numbers, one item after the other, and the automaton over their pieces."""

    def __init__(self, names: list[str], owners: np.ndarray, starts: np.ndarray, numbers: np.ndarray, vocabulary: list[bytes]):
        import ahocorasick

        self.names, self.owners, self.starts, self.numbers = names, owners, starts, numbers
        self.number = {w: k + 1 for k, w in enumerate(vocabulary)}  # 0: no word of the benchmark
        places: dict[tuple, list[int]] = {}
        whole: dict[tuple, list[int]] = {}
        ends = starts[1:]
        for k, (a, b) in enumerate(zip(starts[:-1].tolist(), ends.tolist(), strict=True)):
            if b - a < WINDOW:
                whole.setdefault(tuple(numbers[a:b].tolist()), []).append(k)
                continue
            for at in range(a, b - PIECE + 1, PIECE):
                places.setdefault(tuple(numbers[at : at + PIECE].tolist()), []).append(at)
        self.item_of = np.searchsorted(starts, np.arange(len(numbers)), side="right") - 1
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key in places.keys() | whole.keys():
            self.automaton.add_word(key, (len(key), np.array(places.get(key, ()), np.int64), sorted({int(owners[k]) for k in whole.get(key, ())})))
        self.empty = not (places or whole)
        if not self.empty:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word intervals [first, end) that windows cover, and the items (numbers of names) that have one."""
        if self.empty or not words:
            return [], set()
        get = self.number.get
        text = tuple([get(w, 0) for w in words])
        spans, items, known = [], set(), {}
        for last, (n, places, whole) in self.automaton.iter(text):
            if whole:
                spans.append((last - n + 1, last + 1))
                items.update(whole)
            if len(places):
                self._extend(text, last - n + 1, places, known, spans, items)
        return spans, items

    def _extend(self, text: tuple, first: int, places: np.ndarray, known: dict[int, int], spans: list, items: set) -> None:
        """Runs around the piece at word `first`, for all its places in items at once. `known`: the end of the last run on each diagonal."""
        offsets = (places - first).tolist()
        fresh = [k for k, d in enumerate(offsets) if known.get(d, -1) <= first]
        if not fresh:
            return
        places = places[fresh]
        item = self.item_of[places]
        low, high = self.starts[item], self.starts[item + 1]
        left = self._run(text, first, places, -1, low)
        right = self._run(text, first + PIECE, places + PIECE, 1, high)
        for at, x, y, owner in zip(places.tolist(), left.tolist(), right.tolist(), self.owners[item].tolist(), strict=True):
            known[at - first] = first + PIECE + y
            if x + y + PIECE >= WINDOW:
                spans.append((first - x, first + PIECE + y))
                items.add(owner)

    def _run(self, text: tuple, at: int, places: np.ndarray, step: int, bound: np.ndarray) -> np.ndarray:
        """How many words from `at` on (before it, for step -1) equal those of each place, within its item; the places left get fewer with every word."""
        length = np.zeros(len(places), np.int64)
        live = np.arange(len(places))
        done = 0
        while len(live):
            here = at + done if step > 0 else at - done - 1
            if not 0 <= here < len(text) or not text[here]:
                break
            there = places[live] + (done if step > 0 else -done - 1)
            inside = there < bound[live] if step > 0 else there >= bound[live]
            live, there = live[inside], there[inside]
            live = live[self.numbers[there] == text[here]]
            done += 1
            length[live] = done
        return length


def part_of(items: list[tuple]) -> tuple:
    """Names, each sequence's item, starts, word numbers and vocabulary of (item_id, text) rows."""
    names = sorted({"null" if i is None else str(i) for i, _ in items})
    number, vocabulary = {name: k for k, name in enumerate(names)}, {}
    owners, lengths, numbers = [], [0], []
    for item_id, text in items:
        words = alnum_words(text.encode() if text is not None else None)
        if words:
            owners.append(number["null" if item_id is None else str(item_id)])
            lengths.append(len(words))
            numbers += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
    return names, np.array(owners, np.int64), np.cumsum(lengths), np.array(numbers, np.int32), list(vocabulary)


def built(name: str, part: Callable[[], tuple]) -> Benchmark:
    """Of the last part that a Python worker has used."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Benchmark(*part())
    return _BUILT[name]


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals in order; those that meet are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the text itself of word intervals."""
    places = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    return [(places[a][0], places[b - 1][1]) for a, b in spans]


_LOWER = {c: c + 32 for c in range(65, 91)}


def parts(benchmark: DataFrame) -> list[tuple[str, Broadcast]]:
    """The benchmark's parts, each named; one at a time stands on the driver."""
    items = benchmark.select("item_id", "text")
    context = benchmark.sparkSession.sparkContext
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // PART_BYTES) or 1
    dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [(uuid.uuid4().hex, context.broadcast(part_of([tuple(r) for r in items.where(dealt == k).collect()]))) for k in range(n)]


def scanner(shared: list[tuple[str, Broadcast]]) -> Callable[[list[bytes | None]], list[tuple[int, list[tuple[int, int]], list[str]]]]:
    """Of the texts of a batch: number of words, joined intervals, and sorted names of items."""

    def scan(texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        if len(shared) == 1:  # words are made and forgotten text by text
            bench = built(shared[0][0], lambda: shared[0][1].value)
            return [(len(w), joined(s), sorted(bench.names[k] for k in i)) for w in map(alnum_words, texts) for s, i in [bench.scan(w)]]
        words = list(map(alnum_words, texts))
        found = [([], set()) for _ in words]
        for name, part in shared:
            bench = built(name, lambda part=part: part.value)
            for (spans, items), w in zip(found, words, strict=True):
                more, own = bench.scan(w)
                spans += more
                items.update(bench.names[k] for k in own)
            part._value = None  # of a worker's copy; the next batch reads it from the executor's disk again
        return [(len(w), joined(spans), sorted(items)) for w, (spans, items) in zip(words, found, strict=True)]

    return scan


_HITS = "doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_words, starts, ends (hit word intervals), items (sorted ids)."""
    scan = scanner(parts(benchmark))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = scan(as_bytes(batch.column(1)))
        places = [pa.array([[s[side] for s in spans] for _, spans, _ in rows], pa.list_(pa.int32())) for side in range(2)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), *places, pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=[c.split()[0] for c in _HITS.split(", ")]
        )

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fn, _HITS)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0), lambda n, s: n + s["ends"] - s["starts"]).cast("long")
    return hits(docs, benchmark).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated")
    )


def contaminated_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, start, end (code points of the original text), one row per maximal contaminated passage."""
    scan = scanner(parts(benchmark))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, rows = as_bytes(batch.column(1)), []
        for doc_id, text, (_, spans, _) in zip(batch.column(0).to_pylist(), texts, scan(texts), strict=True):
            rows += [(doc_id, *place) for place in original_spans(text.decode("utf-8", "replace"), spans)] if spans else []
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["doc_id", "start", "end"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), fn, "doc_id long, start long, end long")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit, with all their columns; texts stay where they are read."""
    at, scan = docs.columns.index("text"), scanner(parts(benchmark))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([not spans for _, spans, _ in scan(as_bytes(batch.column(at)))], pa.bool_()))

    return map_arrow(docs, fn, docs.schema)
