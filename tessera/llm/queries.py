"""The queries opN_<name> over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, mixing, near_dup, pii, quality, secrets, substring_dedup, token_store, url_filter
from .common import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).drop("lang")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_ids(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table stands for a history: versions up to the middle id are scanned and put on the ledger, then all are,
    of which only blobs that the ledger lacks are scanned."""
    versions = _table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) id", "text")
    middle = versions.agg(((F.min("id") + F.max("id")) / 2).cast("long")).first()[0]
    ledger = new_path(spark, "ledger")
    secrets.update_ledger(versions.where(F.col("id") <= F.lit(middle)), ledger)
    return secrets.update_ledger(versions, ledger).withColumnRenamed("id", "doc_id")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents")).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_quality, op3_token_store, op4_decontaminate, op5_substring_dedup, op6_near_dup, op7_mixing, op8_secrets, op9_url_filter, op10_licenses)
}

_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _secrets_sql() -> str:
    """Spans of every rule: running lengths of what stands between matches and of the matches."""
    parts = []
    for rank, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"select doc_id, '{rule.kind}' kind, {rank} rank, i, len(g[i]) gap, len(m[i]) n, len(x[i]) own, {rule.least} least "
            f"from (select doc_id, string_split_regex(t, '{pattern}') g, regexp_extract_all(t, '{pattern}') m, regexp_extract_all(t, '{pattern}', {rule.group}) x from d) a, unnest(range(1, len(m) + 1)) u(i)"
        )
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
    counts = ", ".join(f"count(case when kind = '{r.kind}' then 1 end) n_{r.kind}" for r in secrets.BASE)
    listed = lambda where: f"coalesce(string_agg(case when {where} then kind || ':' || st || ':' || (st + n) end, ',' order by st, rank, n), '')"
    return (
        f"with d as (select doc_id, coalesce(text, '') t from documents), m as ({' union all '.join(parts)}), "
        "p as (select *, sum(gap + n) over (partition by doc_id, rank order by i) - n st from m), s as (select * from p where own >= least) "
        f"select d.doc_id, {counts}, sha256({listed(f'kind in ({base})')}) base_sha256, {listed('kind is not null')} spans from d left join s on d.doc_id = s.doc_id group by d.doc_id"
    )


ORACLE_SQL: dict[str, str] = {
    "op6_near_dup": rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\x20\x09-\x0D]+') ws from documents),
s as (select distinct doc_id, array_to_string(ws[i : i + 2], ' ') g from d, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) t(i) where len(ws) > 0),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id id, doc_id root from d union select e.b, r.root from r join e on r.id = e.a),
c as (select id, min(root) component_id from r group by id)
select d.doc_id, coalesce(n.n, 0) n_shingles, component_id, d.doc_id = component_id kept from d join c on d.doc_id = id left join n on d.doc_id = n.doc_id""",
    "op8_secrets": _secrets_sql(),
    "op4_decontaminate": rf"""
with d as (select doc_id, {_ALNUM} ws from documents),
i as (select item_id, {_ALNUM} ws from benchmark),
iw as (select distinct item_id, least(len(ws), 10) n, array_to_string(ws[s : s + 9], ' ') k from i, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(s) where len(ws) > 0),
dw as (select doc_id, n, s, array_to_string(ws[s : s + n - 1], ' ') k from d, (select distinct n from iw) l, unnest(range(1, len(ws) - n + 2)) t(s)),
h as (select doc_id, item_id, dw.n, s from dw join iw on dw.n = iw.n and dw.k = iw.k),
p as (select doc_id, count(distinct q) n_hit from h, unnest(range(s, s + n)) t(q) group by doc_id),
m as (select doc_id, count(*) n_items, string_agg(x, ',' order by x) l from (select distinct doc_id, cast(item_id as varchar) x from h) t group by doc_id)
select d.doc_id, cast(len(ws) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(l, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join p on d.doc_id = p.doc_id left join m on d.doc_id = m.doc_id""",
    "op5_substring_dedup": rf"""
with d as (select doc_id, {_WORDS} ws from documents),
w as (select doc_id, s, array_to_string(ws[s : s + 19], ' ') k from d, unnest(range(1, len(ws) - 18)) t(s)),
f as (select doc_id, s, min(doc_id * 1000000000 + s) over (partition by k) f from w),
g as (select distinct doc_id, q from f, unnest(range(s, s + 20)) t(q) where doc_id * 1000000000 + s > f),
u as (select doc_id, q, ws[q] x from d, unnest(range(1, len(ws) + 1)) t(q)),
kept as (select u.doc_id, string_agg(x, ' ' order by u.q) l, count(*) n from u anti join g on u.doc_id = g.doc_id and u.q = g.q group by u.doc_id)
select d.doc_id, cast(len(ws) as bigint) n_words, cast(len(ws) - coalesce(n, 0) as bigint) n_removed, sha256(coalesce(l, '')) kept_sha256 from d left join kept on d.doc_id = kept.doc_id""",
    "op7_mixing": rf"""
with d as (select doc_id, source, cast(len({_WORDS}) as bigint) size, md5('{mixing.SEED}:' || coalesce(cast(doc_id as varchar), '')) o from documents),
s as (select source, cast(sum(size) as bigint) size, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end w from d group by source),
r as (select *, coalesce(sum(2 * size) over b, 0) used, coalesce(sum(w) over b, 0) wused, row_number() over (order by 2 * size / w, w, size) k, sum(size) over () total, sum(w) over () ws
  from s window b as (order by 2 * size / w, w, size rows between unbounded preceding and 1 preceding)),
l as (select *, (cast(1.5 as double) * total - used) / (ws - wused) rate from r),
c as (select min(k) k, arg_min(rate, k) rate from l where rate * w <= 2 * size),
t as (select source, size source_size, case when l.k < c.k then cast(2 * size as double) else c.rate * w end target from l, c),
x as (select *, cast(floor(target + 0.5) as bigint) goal from t)
select doc_id, size, source_size, target, cast(case when source_size = 0 then 0 else goal // source_size * size + greatest(0, least(size, goal % source_size - coalesce(sum(size) over (partition by d.source order by o, size rows between unbounded preceding and 1 preceding), 0))) end as bigint) taken
from d join x on d.source is not distinct from x.source""",
    "op9_url_filter": rf"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') raw from u),
p as (select page_id, translate(raw, {_ABC}) host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') path from h),
r(rule_host, rule_path, verdict) as (values {", ".join(str(x) for x in url_filter.RULES)}),
m as (select page_id, host, path, rule_host || rule_path rule, verdict, row_number() over (partition by page_id, host, path order by length(rule_host || rule_path) desc, rule_host || rule_path) k
  from p left join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, coalesce(verdict, '{url_filter.DEFAULT}') verdict from m where k = 1""",
}
