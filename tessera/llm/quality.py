"""Quality rules by tokeniser fertility.

Each whole text is measured under two public vocabularies. Under a subword one with byte fallback: characters per token,
the share of tokens that fall back to bytes, and the entropy of its tokens as a share of the most that
its number of tokens allows; under a lower-casing word-level BPE, whose merges come from other texts: characters per token.
Rejection bands are set per language: median -/+ SPREAD times
the distance from the median to the quartile beyond it, over every measured document of the
language, and wider by SHORT / sqrt(tokens), as short texts vary more. With n < MIN_DOCS documents of a language, its limits count by
n / MIN_DOCS, and those of the document's script (that of most of its letters) for the rest. A script's distances are
wider by sqrt(MIN_DOCS / n) where it has n < MIN_DOCS documents itself. So no document is held against bands that other
scripts set, and limits move by little from one document to the next. Bands are joined as tables, for any number of languages.

Quartiles are counted, over measures in steps of STEP, so they and all verdicts are the same however the rows are dealt.
Texts are encoded once: measures are written beside them (or beside their ids), and bands and verdicts follow from these.

Null or empty text: no words, all measures 0, base_failed. Null language: a language of its
own. Repeated rows are judged row by row. Extra columns, whatever their names, are ignored by ``measure`` and kept
by ``quality_filter``. An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import as_bytes, left_join, map_arrow, materialize, plain_words
from .tokens import CACHE_WORDS, LowerBpe, PieceBpe, Words, loaded, packed, public_path, release

SYMBOLS = b"#*$%&|<>"
#: A text needs this many words, and at most this percentage of them in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Width of a band in quartile distances, the least distance it is set from, the allowance for short texts, and the
#: documents that a language needs to be judged by its own limits alone, and a script by limits that are not widened.
SPREAD = 4.0
LEAST = {"chars_per_token": 0.025, "byte_share": 0.005, "entropy_share": 0.06, "chars_per_word_token": 0.05}
SHORT = {"chars_per_token": 3.0, "byte_share": 0.3, "entropy_share": 0.5, "chars_per_word_token": 4.0}
STEP = {"chars_per_token": 0.001, "byte_share": 0.0001, "entropy_share": 0.0001, "chars_per_word_token": 0.001}
VOCABULARIES = ("piece_bpe_32k.model", "word_bpe_49k.json")
MIN_DOCS = 200
ASCII = bytes(range(128))
LETTERS = bytes(b for b in ASCII if chr(b).isalpha())
#: First words of letters' names that are no scripts, that need a second word, and that stand for one script.
NO_SCRIPT = {"MODIFIER", "FEMININE", "MASCULINE", "MICRO", "FULLWIDTH", "HALFWIDTH", "MATHEMATICAL", "DOUBLE-STRUCK", "SCRIPT", "BLACK-LETTER"}
TWO_WORDS = {"OLD", "LINEAR", "NEW", "TAI"}
KANA = {"HIRAGANA", "KATAKANA"}

MEASURES = list(LEAST)
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
FEATURES = "n_tokens long, chars_per_token double, byte_share double, entropy_share double, chars_per_word_token double, script string"


def numbered(words: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Each word's number, which is where it first stands; the different words, and how often each stands."""
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, range(len(words))), dtype=np.int64, count=len(words))
    places = np.fromiter(first.values(), dtype=np.int64, count=len(first))
    return ids, list(first), np.bincount(ids, minlength=len(words))[places]


def repeated_words(ids: np.ndarray) -> int:
    """Words, given by number, that lie in a 3-word window which the text has twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    if n < 1 << 21:
        keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:  # too many words for one key: number the pairs first
        pairs = np.unique((ids[:-1] << 31) | ids[1:], return_inverse=True)[1].astype(np.int64)
        keys = (pairs[:-1] << 32) | ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


@cache
def script_of(char: str) -> str:
    """Script of a letter, by its Unicode name; empty for other characters."""
    name = unicodedata.name(char, "").split() if char.isalpha() else []
    if not name or name[0] in NO_SCRIPT:
        return ""
    return "KANA" if name[0] in KANA else " ".join(name[:2]) if name[0] in TWO_WORDS else name[0]


def script(text: bytes | None) -> str:
    """The script that most letters of a text have; empty without letters."""
    if not text:
        return ""
    latin, other = len(text) - len(text.translate(None, LETTERS)), text.translate(None, ASCII)
    if latin and len(other) // 2 <= latin:  # a letter beyond ASCII has two bytes or more
        return "LATIN"
    counts = Counter({"LATIN": latin})
    for char, n in Counter(other.decode("utf-8", "replace")).items():
        counts[script_of(char)] += n
    del counts[""]
    return max(counts, key=lambda s: (counts[s], s)) if any(counts.values()) else ""


class Fertility:
    """Both vocabularies' encoders of a worker, with one table of the words that it has seen."""

    def __init__(self, paths: tuple[str, str]):
        self.pieces = PieceBpe(paths[0])
        self.plain = LowerBpe(paths[1])
        self.plain.words.most = CACHE_WORDS // 8  # only marks and what stands before them
        self.words = Words(self._word)

    def forget(self) -> None:
        self.words.clear()
        self.plain.forget()

    def _word(self, word: bytes) -> bytes:
        """The number of plain ids, in two halves, and then the pieces' ids."""
        n = self.plain.count(word)
        return packed([n & 0xFFFF, n >> 16, *self.pieces.encode(word)])

    def measures(self, words: list[bytes], chars: int) -> tuple[int, float, float, float, float]:
        """n_tokens, and the measures in their order; `chars` are the words' code points."""
        return self.counted(*numbered(words)[1:], chars)

    def counted(self, words: list[bytes], times: np.ndarray, chars: int) -> tuple[int, float, float, float, float]:
        """The same from different words and how often each stands."""
        self.words.trim()
        self.plain.words.trim()
        known = list(map(self.words.__getitem__, words))
        sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 2
        ids = np.frombuffer(b"".join(known), dtype="<u2")
        heads = np.cumsum(sizes) - sizes
        m = int(((ids[heads] + (ids[heads + 1].astype(np.int64) << 16)) * times).sum())
        weights = np.repeat(times, sizes)
        weights[heads] = weights[heads + 1] = 0
        n = int(weights.sum())
        other = chars / m if m else 0.0
        if not n:
            return 0, 0.0, 0.0, 0.0, other
        counts = np.bincount(ids, weights=weights, minlength=len(self.pieces.bytes))
        fallback = int(counts[: len(self.pieces.bytes)][self.pieces.bytes].sum())
        counts = counts[counts > 0]
        entropy = np.log2(n) - float((counts * np.log2(counts)).sum()) / n
        return n, chars / n, fallback / n, entropy / np.log2(n) if n > 1 else 1.0, other


def measured(texts: pa.Array, paths: tuple[str, str]) -> dict[str, pa.Array]:
    """Base counts and fertility of every text of a batch."""
    encoders = loaded(Fertility, paths)
    rows = []
    for text, length in zip(as_bytes(texts), pc.utf8_length(texts).to_pylist(), strict=True):
        words = plain_words(text)
        symbols = len(text) - len(text.translate(None, SYMBOLS)) if text else 0
        if not words:
            rows.append((0, 0, symbols, 0, 0, True, 0, 0.0, 0.0, 0.0, 0.0, ""))
            continue
        chars = length - (len(text) - sum(map(len, words)))
        ids, different, times = numbered(words)
        repeat = repeated_words(ids) if len(different) < len(words) else 0
        rows.append((len(words), chars, symbols, duplicate_lines(text), repeat, base_failed(len(words), repeat), *encoders.counted(different, times, chars), script(text)))
    names = [c.split()[0] for c in f"{BASE}, {FEATURES}".split(", ")]
    return {name: pa.array([r[k] for r in rows], t) for k, (name, t) in enumerate(zip(names, TYPES, strict=True))}


def _fields() -> list[StructField]:
    return StructType.fromDDL(f"{BASE}, {FEATURES}").fields


TYPES = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), *[pa.float64()] * 4, pa.string()]


def _paths(vocabularies: tuple[str, str] | None) -> tuple[str, str]:
    return vocabularies or (public_path(VOCABULARIES[0]), public_path(VOCABULARIES[1]))


def measure(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, lang, the base counts and the fertility measures."""
    paths = _paths(vocabularies)
    kept = docs.select("doc_id", "lang", "text")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = measured(batch.column(2), paths)
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *found.values()], names=["doc_id", "lang", *found])

    return map_arrow(kept, fn, StructType([*kept.schema.fields[:2], *_fields()]), release)


def language() -> Column:
    """Names a language, null among them."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null"))


def bands(measures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """language, n, weight, own (lo and hi of every measure): a row per language; script, others: a row per script."""
    fit = measures.where(~F.col("base_failed"))
    steps = [F.struct(F.lit(c).alias("measure"), F.round(F.col(c) / step).cast("long").alias("at")) for c, step in STEP.items()]

    def limits(key: Column, widened: bool) -> DataFrame:
        counted = fit.select(key.alias("key"), F.explode(F.array(*steps)).alias("x")).groupBy("key", "x.measure", "x.at").agg(F.count(F.lit(1)).alias("rows"))
        below = F.sum("rows").over(Window.partitionBy("key", "measure").orderBy("at"))
        n = F.sum("rows").over(Window.partitionBy("key", "measure"))
        placed = counted.withColumns({"below": below, "n": n})
        quartile = lambda q: F.min(F.when(F.col("below") >= F.lit(q) * F.col("n"), F.col("at")))
        found = placed.groupBy("key", "measure").agg(F.max("n").alias("n"), *[quartile(q).alias(name) for q, name in ((0.25, "low"), (0.5, "mid"), (0.75, "high"))])
        spread = F.lit(SPREAD) * (F.sqrt(F.greatest(F.lit(1.0), F.lit(float(MIN_DOCS)) / F.col("n"))) if widened else F.lit(1.0))
        out = []
        for c, least in LEAST.items():
            low, mid, high = (F.col(x) * STEP[c] for x in ("low", "mid", "high"))
            both = F.struct((mid - spread * F.greatest(mid - low, F.lit(least))).alias("lo"), (mid + spread * F.greatest(high - mid, F.lit(least))).alias("hi"))
            out.append(F.max(F.when(F.col("measure") == c, both)).alias(c))
        return found.groupBy("key").agg(F.max("n").alias("n"), *out).select("key", "n", F.struct(*MEASURES).alias("limits"))

    weight = F.least(F.lit(1.0), F.col("n") / F.lit(float(MIN_DOCS)))
    own = limits(language(), False).select(F.col("key").alias("language"), "n", weight.alias("weight"), F.col("limits").alias("own"))
    others = limits(F.col("script"), True).select(F.col("key").alias("script"), F.col("limits").alias("others"))
    return materialize(own, "bands"), materialize(others, "script-bands")


def _judged(table: DataFrame, limits: tuple[DataFrame, DataFrame]) -> DataFrame:
    """table (lang, and the measures) with kept. There are as many rows of scripts as Unicode has at most."""
    own, others = limits
    known = left_join(table.withColumn("language", language()), own.drop("n"), "language", own.select("language", "n"), F.xxhash64("n_tokens", "word_chars"))
    known = known.join(F.broadcast(others), "script", "left")
    kept = ~F.col("base_failed")
    more = lambda c: F.lit(SHORT[c]) / F.sqrt(F.greatest("n_tokens", F.lit(1)).cast("double"))
    for c in MEASURES:
        lo, hi = (_mixed_limit(f"{c}.{side}") for side in ("lo", "hi"))
        kept = kept & F.col(c).between(lo - more(c), hi + more(c))
    return known.withColumn("kept", F.coalesce(kept, F.lit(False)))


def _mixed_limit(name: str) -> Column:
    return F.col("weight") * F.col(f"own.{name}") + (1 - F.col("weight")) * F.col(f"others.{name}")


def judge(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, lang, all counts and measures, kept. The small measures are written once, so texts are encoded once."""
    table = materialize(measure(docs, vocabularies), "quality-measures")
    return _judged(table, bands(table)).select(*[c for c in table.columns if c != "script"], "kept")


def quality_filter(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """The documents that are kept, with all their columns. They are written once, each whole beside its measures, from
    which bands and verdicts are read."""
    paths = _paths(vocabularies)
    text = docs.columns.index("text")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = measured(batch.column(text), paths)
        whole = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
        return pa.RecordBatch.from_arrays([whole, *found.values()], names=["doc", *found])

    table = materialize(map_arrow(docs, fn, StructType([StructField("doc", docs.schema), *_fields()]), release), "quality-measured")
    table = table.withColumn("lang", F.col("doc.lang"))
    return _judged(table, bands(table)).where("kept").select("doc.*")
