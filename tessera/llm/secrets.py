"""Secret scans with an incremental blob ledger, with DataFrame functions only.

A version of a file is an (id, text) row; its blob is the SHA-256 of the text. The ledger is a
table with a row for each scan of a blob: the rule versions it was scanned with, and the spans they found. A scan
takes the distinct blobs of the given versions, drops the (blob, rule version) pairs that the ledger has, scans one row of
each blob that is left with the rules it lacks, and appends the outcome. Findings are then joined from the ledger back to
every version. So content that is committed, copied or kept unchanged is scanned once per rule version, however
many versions hold it.

Positions come from splitting a text at a rule's matches: the running lengths of the pieces
and of the matches are the offsets (code points). They are summed in blocks of BLOCK, so
a text with very many matches stays cheap.

Null text is the empty blob: no spans. Repeated rows and equal ids give a row each. Extra
columns are ignored. An empty table gives an empty result; an empty or missing ledger has everything scanned.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exists, materialize, new_path, salted_join

BLOCK = 64


@dataclass(frozen=True)
class Rule:
    """`pattern` matches leftmost without overlaps; a match whose `group` is shorter than `least` is dropped.
    A text that has none of the `hints`, in any letter case, has no match."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hints: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


#: Fixed values of the base scan, in the order of their kinds.
BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    # greedy runs that end at another character: a run that is too short holds no later start that is long enough,
    # so the least length can stand in the pattern
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", hints=("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
#: Rules of the method's own: public token formats, with the least lengths that their issuers give and none at most.
MORE = (
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("google", 1, r"AIza[A-Za-z0-9_-]{35,}", hints=("aiza",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("private_key", 1, r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY(?: BLOCK)?-----", hints=("private key",)),
    Rule("bearer", 1, r"(?i:bearer) [A-Za-z0-9._~+/-]{20,}", hints=("bearer ",)),
)
RULES = BASE + MORE
LEDGER = "blob binary, scanned array<string>, found array<struct<kind:string,version:int,spans:array<struct<start:int,end:int>>>>"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once; an expression used inside a lambda would be computed at every place."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _before(lengths: Column) -> Column:
    """Sum of what stands before each place of an array variable: that before its block, and the block's own; n * BLOCK + (n / BLOCK) ** 2 steps."""
    # blocks are numbered from 0, places of slices from 1
    last = F.greatest(F.lit(0), ((F.size(lengths) - 1) / BLOCK).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: _total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    sums = _let(blocks, lambda sums: F.transform(sums, lambda _, b: _total(F.slice(sums, F.lit(1), b))))
    return _let(
        sums, lambda sums: F.transform(lengths, lambda _, i: F.get(sums, (i / BLOCK).cast("int")) + _total(F.slice(lengths, (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)))
    )


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans of a rule in a text, in order."""
    whole = F.transform(F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1)), lambda m: F.length(m))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    kept = F.transform(F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(rule.group + 1)), lambda m: F.length(m)) if rule.group else whole
    rows = F.arrays_zip(gaps.alias("gap"), whole.alias("n"), kept.alias("g"))

    def placed(rows: Column) -> Column:
        steps = F.transform(rows, lambda r: r["gap"] + F.coalesce(r["n"], F.lit(0)))
        starts = _let(steps, _before)
        return F.zip_with(rows, starts, lambda r, at: F.struct((at + r["gap"]).alias("start"), (at + r["gap"] + r["n"]).alias("end"), r["g"].alias("g")))

    good = F.filter(_let(rows, placed), lambda s: s["end"].isNotNull() & (s["g"] >= rule.least))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def _scanned(text: Column, rule: Rule) -> Column:
    """The cheap tests first: most texts have no match."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    test = text.rlike(rule.pattern)
    if rule.hints:
        test = reduce(or_, [F.contains(F.lower(text), F.lit(h)) for h in rule.hints]) & test
    return F.when(test, spans_of(text, rule)).otherwise(none)


def blobs(versions: DataFrame) -> DataFrame:
    """blob, first_id, n: each different text, its smallest id and its versions."""
    return materialize(versions.select(blob_of(F.col("text")).alias("blob"), "id").groupBy("blob").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")), "blobs")


def scan(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, known: DataFrame | None = None) -> DataFrame:
    """New ledger rows: every blob of `versions` (columns id, text) under every rule version that `ledger` lacks. `known` is blobs(versions)."""
    known = blobs(versions) if known is None else known
    done = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("done"))
    missing = F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.coalesce("done", F.array().cast("array<string>")))
    wanted = known.join(done, "blob", "left").select(F.col("blob").alias("first_blob"), "first_id", missing.alias("missing")).where(F.size("missing") > 0)
    # texts move once, by id, which is unique but for repeated rows; a blob's text is that of its smallest id
    texts = versions.select("id", "text", blob_of(F.col("text")).alias("blob"))
    rows = texts.join(wanted, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("blob") == F.col("first_blob")))
    text = F.coalesce("text", F.lit(""))
    found = [F.when(F.array_contains("missing", F.lit(r.key)), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _scanned(text, r).alias("spans"))) for r in rules]
    return rows.select("blob", F.col("missing").alias("scanned"), F.filter(F.array(*found), lambda x: x.isNotNull() & (F.size(x["spans"]) > 0)).alias("found"))


def _joined(found: Column, kinds: list[str]) -> Column:
    """kind:start:end of all spans, by start, then kind as listed, comma-joined."""
    order = {k: i for i, k in enumerate(kinds)}
    listed = F.flatten(F.transform(F.filter(found, lambda x: F.size(x["spans"]) > 0), lambda x: F.transform(x["spans"], lambda s: F.struct(s["start"].alias("start"), _rank(x["kind"], order).alias("rank"), s["end"].alias("end"), x["kind"].alias("kind")))))
    return F.array_join(F.transform(F.array_sort(listed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(found: Column, kind: str) -> Column:
    return F.aggregate(F.filter(found, lambda x: x["kind"] == kind), F.lit(0), lambda a, x: a + F.size(x["spans"])).cast("long")


def _rank(kind: Column, order: dict[str, int]) -> Column:
    out = F.lit(len(order))
    for name, k in order.items():
        out = F.when(kind == name, F.lit(k)).otherwise(out)
    return out


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, known: DataFrame | None = None) -> DataFrame:
    """id, n_<kind> of the base, base_sha256, spans: one row per version, from a ledger that has all of them.

    Digests are made once per blob with a finding; the other blobs have none by definition. A blob that many versions have is dealt in pieces.
    """
    known = blobs(versions) if known is None else known
    live = F.array(*[F.lit(r.key) for r in rules])
    one = ledger.select("blob", F.explode("found").alias("x")).where(F.array_contains(live, F.concat_ws(":", "x.kind", "x.version")))
    found = one.groupBy("blob").agg(F.collect_set("x").alias("found"))  # two scans at the same time found the same
    base, kinds = [r.kind for r in BASE], [r.kind for r in rules]
    only_base = F.filter("found", lambda x: x["kind"].isin(base))
    counts = {k: _count(F.col("found"), k) for k in base}
    result = found.select("blob", *[c.alias(f"n_{k}") for k, c in counts.items()], F.sha2(_joined(only_base, kinds), 256).alias("base_sha256"), _joined(F.col("found"), kinds).alias("spans"))
    paths = versions.select("id", blob_of(F.col("text")).alias("blob"))
    out = salted_join(paths, result, "blob", known.select("blob", "n"), F.xxhash64("id"))
    zero = F.lit(0).cast("long")
    return out.select("id", *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in base], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def update_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger table at `path` lacks, append it there, and return the findings of all given versions.

    A failed run appends nothing; a run that is repeated appends nothing new."""
    spark = versions.sparkSession
    known = blobs(versions)
    before = spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else spark.createDataFrame([], LEDGER)
    scan(versions, before, rules, known).write.mode("append").parquet(path)
    return findings(versions, spark.read.schema(LEDGER).parquet(path), rules, known)


def digest(versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The findings of versions under a ledger of their own."""
    return update_ledger(versions, new_path(versions.sparkSession, "ledger"), rules)
