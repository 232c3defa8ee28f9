"""Registered queries over the annotation operators, with their DuckDB SQL.

The lines of orders serve as a rater panel: the order is the unit, the line number the
rater, return flag (N as a blank) and line status the dimensions, and ship date,
part and supplier the row order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterlake.functions import answers, labels, typed
from raterlake.operators import agreement, calls, gate, panel, quality, ranks, release, sampling, tiling
from raterlake.session import scratch, ship
from raterlake.streaming.consensus import ConsensusTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


ORDER = ["l_shipdate", "l_partkey", "l_suppkey"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate", "l_partkey", "l_suppkey")
    return df.withColumns({"D1": F.expr("nullif(l_returnflag, 'N')"), "D2": F.col("l_linestatus")}).drop("l_returnflag", "l_linestatus")


def rated(spark: SparkSession, sf_dir: str, keep: str = "first") -> DataFrame:
    """The panel, deduplicated by unit and rater; clustered by unit, which everything after it reuses."""
    return panel.dedup(panel.clustered(lines(spark, sf_dir), "l_orderkey"), ["l_orderkey", "l_linenumber"], ORDER, keep)


_PANEL = """
with raw as (select l_orderkey, l_linenumber, nullif(l_returnflag, 'N') D1, l_linestatus D2, l_shipdate, l_partkey, l_suppkey from lineitem),
p as (select * exclude (n) from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey) n from raw) where n = 1),
long as (select l_orderkey, 'D1' dim, D1 label, l_shipdate, l_partkey, l_suppkey from p union all select l_orderkey, 'D2', D2, l_shipdate, l_partkey, l_suppkey from p),
ranked as (select *, row_number() over (partition by l_orderkey, dim order by l_shipdate, l_partkey, l_suppkey) pos from long),
tally as (select l_orderkey, dim, label, count(*) c, min(pos) first_pos from ranked group by all),
v as (select l_orderkey, dim, sum(c)::bigint raters, coalesce(sum(c) filter (label is not null), 0)::bigint total,
  coalesce(max(c) filter (label is not null), 0)::bigint agreement,
  coalesce(arg_max(label, c * 1000 - first_pos) filter (label is not null), '') winner from tally group by all),
cand as (select t.l_orderkey, t.dim, count(*) n, string_agg(t.label, '|' order by t.label) labels from tally t join v using (l_orderkey, dim) where t.label is not null and t.c = v.agreement group by all),
vv as (select v.*, coalesce(cand.n, 0) n_cand, coalesce(cand.labels, '') labels from v left join cand using (l_orderkey, dim))
"""


@query("""select l_orderkey, l_linenumber, l_shipdate, l_partkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey) n from lineitem) where n = 1""")
def panel_dedup_first(spark, sf_dir):
    return rated(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")


@query("""select l_orderkey, l_linenumber, l_shipdate, l_partkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc) n from lineitem) where n = 1""")
def panel_dedup_last(spark, sf_dir):
    return rated(spark, sf_dir, "last").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")


@query("""select l_orderkey, l_linenumber, l_shipdate, l_partkey, l_returnflag from (select *, row_number() over (partition by l_orderkey, l_linenumber order by case when l_returnflag <> 'N' then 0 else 1 end, l_shipdate, l_partkey, l_suppkey) n from lineitem) where n = 1""")
def panel_dedup_prefer_valid(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", *ORDER)
    return panel.dedup(df, ["l_orderkey", "l_linenumber"], ORDER, "valid", F.col("l_returnflag") != "N").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_returnflag")


@query(_PANEL + """select l_orderkey, raters n_engines, winner D2, agreement D2_agreement, total D2_total,
case when raters >= 4 and agreement = total and winner <> '' then 'high' when total > 0 and agreement / total >= 0.75 then 'medium' else 'review' end consensus
from vv where dim = 'D2' and raters >= 2""")
def consensus_vote(spark, sf_dir):
    return panel.consensus(rated(spark, sf_dir), "l_orderkey", ["D2"], ORDER).select("l_orderkey", "n_engines", "D2", "D2_agreement", "D2_total", "consensus")


_UNITS = _PANEL + """, u as (select l_orderkey, max(raters) n_engines, max(winner) filter (dim = 'D1') D1, max(agreement) filter (dim = 'D1') D1_agreement, max(total) filter (dim = 'D1') D1_total,
max(winner) filter (dim = 'D2') D2, max(agreement) filter (dim = 'D2') D2_agreement, max(total) filter (dim = 'D2') D2_total,
min(case when total > 0 then agreement / total end) min_ratio, bool_and(winner <> '' and agreement = total) unanimous, min(agreement) least,
count(*) filter (agreement >= 2) consensus_count, string_agg(dim, ',' order by dim) filter (n_cand > 1) ties from vv group by l_orderkey having max(raters) >= 2)
"""


@query(_UNITS + """select l_orderkey, n_engines, D1, D1_agreement, D1_total, D2, D2_agreement, D2_total,
case when n_engines >= 4 and unanimous then 'high' when coalesce(min_ratio, 0) >= 0.75 then 'medium' else 'review' end consensus from u""")
def consensus_multi_dim(spark, sf_dir):
    return panel.consensus(rated(spark, sf_dir), "l_orderkey", ["D1", "D2"], ORDER).select("l_orderkey", "n_engines", "D1", "D1_agreement", "D1_total", "D2", "D2_agreement", "D2_total", "consensus")


@query(_UNITS + """select l_orderkey, n_engines, D1, D1_agreement, D1_total, D2, D2_agreement, D2_total,
case when n_engines >= 4 and unanimous then 'high' when coalesce(min_ratio, 0) >= 0.75 then 'medium' else 'review' end consensus from u""")
def consensus_incremental(spark, sf_dir):
    """The same votes from a table that takes the panel in as three shards, one of them twice."""
    rows = lines(spark, sf_dir)
    held = ConsensusTable(spark, f"{scratch(spark)}/consensus-{uuid.uuid4().hex}", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "l_orderkey", "l_linenumber", ["D1", "D2"], ORDER)
    for batch, shard in ((0, 1), (1, 0), (1, 0), (2, 2)):
        held.merge(rows.where(F.pmod(F.col("l_suppkey"), F.lit(3)) == shard), batch)
    return held.votes().select(*consensus_multi_dim(spark, sf_dir).columns)


@query(_UNITS + """select l_orderkey, case when least >= 4 then 'high' when least >= 2 then 'medium' else 'low' end consensus_level, consensus_count::bigint consensus_count,
ties is not null any_tie_flag, coalesce(ties, '') tie_dimensions, case when ties is null then 'resolved_no_tie' else 'resolved_with_tie' end consensus_status from u""")
def consensus_level_doc(spark, sf_dir):
    return panel.consensus(rated(spark, sf_dir), "l_orderkey", ["D1", "D2"], ORDER).select("l_orderkey", "consensus_level", "consensus_count", "any_tie_flag", "tie_dimensions", "consensus_status")


@query(_PANEL + "select l_orderkey, dim, n_cand > 1 tie_flag, agreement top_vote_count, total num_valid_votes, labels candidate_values from vv")
def tie_metadata(spark, sf_dir):
    return panel.tie_metadata(rated(spark, sf_dir), "l_orderkey", ["D1", "D2"], ORDER)


_MATRIX = _PANEL + """, pairs as (select d.dim, a.l_linenumber || '_vs_' || b.l_linenumber pair, case d.dim when 'D1' then a.D1 else a.D2 end x, case d.dim when 'D1' then b.D1 else b.D2 end y
from p a join p b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber cross join (values ('D1'), ('D2')) d(dim)),
m as (select dim, pair, count(*) filter (x = y) agree, count(*) total, count(*) filter (x = y) / count(*) rate from pairs where x is not null and y is not null group by all)
"""


@query(_MATRIX + "select dim, pair, agree, total, rate from m")
def agreement_matrix(spark, sf_dir):
    return agreement.agreement_matrix(rated(spark, sf_dir), "l_orderkey", "l_linenumber", ["D1", "D2"])


@query(_MATRIX + "select dim, round(avg(round(rate, 4)), 10) mean_rate from m group by dim")
def agreement_avg(spark, sf_dir):
    m = agreement.mean_agreement(agreement.agreement_matrix(rated(spark, sf_dir), "l_orderkey", "l_linenumber", ["D1", "D2"]))
    return m.select("dim", F.round("mean_rate", 10).alias("mean_rate"))


_ALPHA = _PANEL + """, c as (select l_orderkey, dim, label, count(*)::bigint c from long where label is not null group by all),
um as (select l_orderkey, dim, sum(c)::bigint m, sum(c * c)::bigint s from c group by all),
pr as (select dim, sum(m * (m - 1) // 2)::bigint n_pairs, sum((m * m - s) // 2)::bigint disagreeing, sum((m * m - s) / (m - 1)) weighed from um where m > 1 group by dim),
cc as (select c.* from c {filter}),
n1 as (select dim, label, sum(c)::double n from cc group by all), vl as (select dim, sum(n) n_values, sum(n * n) squares from n1 group by dim),
e as (select *, (n_values * n_values - squares) / (n_values * (n_values - 1)) expected from vl join pr using (dim))
select dim, n_pairs, disagreeing, n_values::bigint n_values, round(1 - {observed} / expected, 10) alpha from e
"""


def _alpha(spark, sf_dir, variant):
    return agreement.alpha(rated(spark, sf_dir), "l_orderkey", ["D1", "D2"], variant).withColumn("alpha", F.round("alpha", 10))


@query(_ALPHA.format(filter="", observed="(disagreeing / n_pairs)"))
def alpha_pairwise(spark, sf_dir):
    return _alpha(spark, sf_dir, "pairwise")


_PAIRED = "join um on um.l_orderkey = c.l_orderkey and um.dim = c.dim and um.m > 1"


@query(_ALPHA.format(filter=_PAIRED, observed="(disagreeing / n_pairs)"))
def alpha_prefiltered(spark, sf_dir):
    return _alpha(spark, sf_dir, "prefiltered")


@query(_ALPHA.format(filter=_PAIRED, observed="(weighed / n_values)"))
def alpha_standard(spark, sf_dir):
    return _alpha(spark, sf_dir, "standard")


_PRIORITIES, _PRIORITY_ALIASES = ["URGENT", "HIGH", "MEDIUM", "LOW"], {"NOT SPECIFIED": "MEDIUM"}


@query("""select o_orderkey, case regexp_replace(o_orderpriority, '^[0-9]+\\s*-\\s*', '') when 'NOT SPECIFIED' then 'MEDIUM' else regexp_replace(o_orderpriority, '^[0-9]+\\s*-\\s*', '') end label from orders""")
def label_normalize(spark, sf_dir):
    df = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").withColumn("clean", labels.clean_value(F.col("o_orderpriority")))
    return df.select("o_orderkey", labels.normalize(F.col("o_orderpriority"), _PRIORITIES, _PRIORITY_ALIASES, "LOW", cleaned=F.col("clean")).alias("label"))


@query("""with v(o, raw) as (values ('F', '天尊'), ('O', '7'), ('P', '10')), r as (select o_orderkey, raw from orders join v on o = o_orderstatus)
select o_orderkey, case raw when '天尊' then '八主神' when '7' then '三官地府' else '背景留白' end label,
case raw when '天尊' then 'alias: ''天尊''→''八主神''' when '7' then 'mapped: ''7''→''三官地府''' else 'fallback: raw=''10'' not in vocab, defaulted to ''背景留白''' end reason from r""")
def label_normalize_reason(spark, sf_dir):
    raw = labels.lookup({"F": "天尊", "O": "7", "P": "10"}, F.col("o_orderstatus"))
    df = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").withColumn("raw", raw).where("raw is not null")
    return labels.with_labels(df, {"D1": F.col("raw")}).select("o_orderkey", F.col("D1").alias("label"), F.col("D1_reason").alias("reason"))


@query("""select count(*) filter (c_mktsegment <> '') + count(*) filter (c_name <> '') checked, count(*) filter (c_mktsegment not in ('BUILDING', 'MACHINERY')) violations,
round((2 * count(*) - count(*) filter (c_mktsegment not in ('BUILDING', 'MACHINERY'))) * 100.0::double / (2 * count(*)), 9) rate_pct,
case when (2 * count(*) - count(*) filter (c_mktsegment not in ('BUILDING', 'MACHINERY'))) * 100.0 / (2 * count(*)) >= 95 then 'PASS' else 'WARN' end status from customer""")
def vocab_violation_rate(spark, sf_dir):
    df = table(spark, sf_dir, "customer", "c_mktsegment").withColumn("ok", F.lit("yes"))
    return quality.vocabulary_rate(df, {"c_mktsegment": ["BUILDING", "MACHINERY"], "ok": ["yes"]}).withColumn("rate_pct", F.round("rate_pct", 9))


@query("""select event_id, case when props is null or props = '' then 'not_dict' else 'missing' end missing from events where json_extract(props, '$.confidence') is null""")
def schema_presence(spark, sf_dir):
    df = table(spark, sf_dir, "events", "event_id", "props").withColumn("missing", labels.schema_missing(answers.json_fields(F.col("props")), ["k", "confidence"]))
    return df.where(F.size("missing") > 0).select("event_id", F.when(F.array_contains("missing", "not_dict"), "not_dict").otherwise("missing").alias("missing"))


_CROSS = """with r as (select o_orderkey, o_orderstatus d1, split_part(o_orderpriority, '-', 2) d2, case when o_totalprice > 200000 then 'empty' when o_totalprice > 100000 then 'N/A' else 'held' end d3, substr(o_orderpriority, 1, 1) d4 from orders),
w as (select o_orderkey, list_filter([case when d1 = 'P' and d2 <> 'LOW' then 'background_crown' end, case when d1 = 'P' and d3 <> 'N/A' then 'background_object' end,
case when d4 = '5' and d1 = 'F' and d3 not in ('N/A', '') then 'severe_object' end, case when d4 = '5' and d2 not in ('LOW', 'MEDIUM', '') and d1 <> 'P' then 'severe_crown' end,
case when d4 <> '5' and d1 = 'F' and d3 = 'empty' then 'leading_empty_hand' end, case when d1 = 'O' and d2 = 'URGENT' then 'military_crown' end], lambda x: x is not null) ws from r)
"""


def _crossed(spark, sf_dir):
    df = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    d3 = F.when(F.col("o_totalprice") > 200000, "empty").when(F.col("o_totalprice") > 100000, "N/A").otherwise("held")
    d2, d4 = F.split_part("o_orderpriority", F.lit("-"), F.lit(2)), F.substring("o_orderpriority", 1, 1)
    # the crown rule's own "nothing" is LOW here, so it is given as a column of its own
    df = df.withColumns({"d1": F.col("o_orderstatus"), "d2": F.when(d2 == "LOW", "N/A").otherwise(d2), "d3": d3, "d4": d4})
    return df.withColumn("ws", labels.cross_dim_warnings(F.col("d1"), F.col("d2"), F.col("d3"), F.col("d4"), ["P"], ["F"], ["O"], ["URGENT"], severe="5", empty_hand="empty", no_crown="MEDIUM"))


@query(_CROSS + "select o_orderkey, array_to_string(ws, '; ') warnings from w where len(ws) > 0")
def cross_dim_rules(spark, sf_dir):
    return _crossed(spark, sf_dir).where(F.size("ws") > 0).select("o_orderkey", F.concat_ws("; ", "ws").alias("warnings"))


@query(_CROSS + """select o_orderkey, substr(o_orderpriority, 1, 1) <> '4' and o_orderstatus <> 'P' gate_pass, len(ws) = 0 normalized_valid, len(ws) > 0 or substr(o_orderpriority, 1, 1) = '4' review_required from w join orders using (o_orderkey)""")
def gate_flags(spark, sf_dir):
    df = _crossed(spark, sf_dir)
    return df.select("o_orderkey", *gate.gate_flags(F.col("d4") != "4", F.col("d1") != "P", F.col("ws"), F.when(F.col("d4") == "4", "fallback: 4")))


@query("""select event_id, json_extract_string(props, '$.k') k from events""")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id", "props").select("event_id", answers.json_fields(F.col("props"))["k"].alias("k"))


@query("""select event_id, case event_id % 8 when 2 then 'array' when 3 then 'scalar' when 5 then 'none' when 6 then 'none' when 7 then 'none' else 'object' end kind,
case when event_id % 8 in (0, 1, 4) then json_extract_string(props, '$.k') end k from events""")
def json_fence_extract(spark, sf_dir):
    """Fenced, bare and surrounded answers, arrays, numbers, two objects, single quotes, broken fences."""
    ship(spark)
    forms = ["concat('Answer:\n```json\n', props, '\n```\nDone {}')", "props", "concat('[', props, ']')", "'42'", "concat('So: ', props, ' it is')", "concat(props, ' and ', props)", "\"{'k': 1}\"", "'```\n[1, 2\n```'"]
    text = F.expr("case event_id % 8 " + " ".join(f"when {i} then {form}" for i, form in enumerate(forms)) + " end")
    df = table(spark, sf_dir, "events", "event_id", "props").withColumn("text", text)
    return df.select("event_id", answers.extract_json(F.col("text")).alias("j")).select("event_id", "j.kind", F.col("j.fields")["k"].alias("k"))


#: JSON texts, each with what stands before and after it in an answer; both engines read them. k is a value of the row.
_TYPED = [
    ("""'{"D1": ["' || k || '", "帝君"], "D2": null, "D4": 1}'""", "''", "''"),
    ("""'{"D1": "' || k || '", "D2": 3, "D4": "轻微损伤", "confidence": 0.5}'""", "'```json' || chr(10)", "chr(10) || '``` and {}'"),
    ("""'{"D1": [], "D2": [true, 2.5, "x", null], "D4": 0}'""", "'Answer: '", "' it is'"),
    ("""'{"D1": "神将", "D2": "it' || chr(39) || 's", "D4": "9"}'""", "''", "' trailing'"),
    ("""'["' || k || '"]'""", "''", "''"),
    ("""'{"D1": 4, "D2": false, "D4": 1.25}'""", "''", "''"),
    ("""'{"D1": "天尊"}'""", "'{' || chr(39) || 'D1' || chr(39) || ': 1} '", "''"),
]
_TYPED_TEXT = "case event_id % 7 " + " ".join(f"when {i} then {before} || {body} || {after}" for i, (body, before, after) in enumerate(_TYPED)) + " end"
_TYPED_BODY = "case event_id % 7 " + " ".join(f"when {i} then {body}" for i, (body, _, _) in enumerate(_TYPED[:-1])) + " end"  # of the last nothing is JSON
_PYTHON = "case json_type(x) when 'NULL' then 'None' when 'BOOLEAN' then case when x::varchar = 'true' then 'True' else 'False' end when 'VARCHAR' then case when contains(x::varchar, chr(39)) then x::varchar else replace(x::varchar, '\"', chr(39)) end else x::varchar end"


@query(f"""with b as (select event_id, ({_TYPED_BODY})::json j from (select event_id, json_extract_string(props, '$.k') k from events)),
v as (select event_id, j, json_extract(j, '$.D1') d1, json_extract(j, '$.D2') x, json_extract(j, '$.D4') d4 from b),
t as (select *, case json_type(d1) when 'ARRAY' then json_extract_string(d1, '$[0]') else json_extract_string(d1, '$') end a1, json_extract_string(d4, '$') a4 from v)
select event_id, case json_type(j) when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'none' end kind, coalesce(a1, '') d1,
coalesce(case json_type(x) when 'ARRAY' then '[' || array_to_string(list_transform(json_extract(x, '$[*]'), lambda x: {_PYTHON}), ', ') || ']' else {_PYTHON} end, '') d2,
case when a4 in ('1', '轻微损伤') then '轻微损伤' when a4 = '0' then '完好' else '严重损伤' end d4 from t""")
def json_typed(spark, sf_dir):
    """Lists, numbers, truth values and nulls as such, answers in fences and in other text, single quotes."""
    typed.last_of_equal_keys(spark)
    df = table(spark, sf_dir, "events", "event_id", "props").select("event_id", answers.json_fields(F.col("props"))["k"].alias("k")).withColumn("text", F.expr(_TYPED_TEXT))
    df = df.select("event_id", typed.typed_json(F.col("text")).alias("j"))
    d4 = labels.normalize_dim("D4", typed.answered(typed.field(F.col("j"), "D4")))
    return df.select("event_id", typed.kind(F.col("j")).alias("kind"), typed.answered(typed.field(F.col("j"), "D1")).alias("d1"), F.coalesce(typed.printed(typed.field(F.col("j"), "D2")), F.lit("")).alias("d2"), d4.alias("d4"))


def _damage(spark, sf_dir):
    df = table(spark, sf_dir, "part", "p_partkey", "p_type", "p_brand")
    severity = F.when(F.col("p_brand").endswith("5"), "extreme").otherwise("mild")
    layer = F.when(F.col("p_partkey") % 2 == 0, "P1")
    types = gate.resolve_damage(F.col("p_type"), layer, severity, ["PROMO", "ECONOMY"], {"STANDARD": "PROMO"}, ["SMALL"], ["LARGE"], ["PROMO"], ["mild", "severe"])
    return df.select("p_partkey", types.alias("r")).select("p_partkey", "r.normalized_label", "r.resolution", "r.review_required")


_DAMAGE = """with r as (select p_partkey, p_type t, p_brand like '%5' bad, p_partkey % 2 <> 0 nolayer from part),
d as (select p_partkey, case when t = 'LARGE' then '未知' when t in ('PROMO', 'ECONOMY') then t when t = 'STANDARD' then 'PROMO' else '未知' end normalized_label,
case when t = 'LARGE' then 'rejected' when t in ('PROMO', 'ECONOMY') then 'direct' when t = 'STANDARD' then 'alias' else 'review' end resolution, bad, nolayer from r),
f as (select p_partkey, normalized_label, resolution, resolution in ('rejected', 'review') or bad or (normalized_label = 'PROMO' and nolayer) review_required from d)
"""


@query(_DAMAGE + "select * from f")
def damage_label_resolution(spark, sf_dir):
    return _damage(spark, sf_dir)


@query(_DAMAGE + "select resolution, count(*) n from f group by 1 union all select 'total', count(*) from f")
def resolution_stats(spark, sf_dir):
    return gate.resolution_stats(_damage(spark, sf_dir))


@query(_DAMAGE + "select p_partkey, normalized_label from f where not review_required")
def export_gate_split(spark, sf_dir):
    return gate.export_gate(_damage(spark, sf_dir), "normalized_label", "review_required", ["PROMO", "ECONOMY", "未知"])[0].select("p_partkey", "normalized_label")


@query("""select count(distinct l.doc_id) unique_units, count(l.doc_id) total_rows, round(count(distinct l.doc_id) * 100.0::double / 7455, 9) pct,
case when count(distinct l.doc_id) * 100.0 / 7455 >= 90 then 'PASS' when count(distinct l.doc_id) * 100.0 / 7455 >= 50 then 'WARN' else 'INFO' end status from labels l""")
def coverage(spark, sf_dir):
    return quality.coverage(table(spark, sf_dir, "labels"), "doc_id", 7455).withColumn("pct", F.round("pct", 9))


def _checks(spark, sf_dir, required=("patch_id", "D1")):
    df = table(spark, sf_dir, "events", "event_id", "event_type", "value")
    rows = df.select(F.col("event_id").alias("patch_id"), F.col("event_type").alias("D1"), (F.col("value") > 5).cast("string").alias("gate_pass"), F.when(F.col("event_type") == "error", "fallback: error").otherwise("").alias("fallback_reason"), F.col("value").alias("latency_ms"))
    return quality.check_rater(rows, 10000, {"D1": ["view", "click", "purchase", "error"]}, required=required, latency="latency_ms")


_CHECKS = """with m as (select count(distinct event_id) * 100.0::double / 10000 coverage, count(*) filter (event_type in ('view', 'click', 'purchase', 'error')) * 100.0::double / count(*) vocab,
count(*) filter (value > 5) * 100.0::double / count(*) gate, 100.0 - count(*) filter (event_type = 'error') * 100.0::double / count(*) nofb, count(distinct event_type)::double d, (count(distinct event_id) - count(event_id))::double dup, avg(value) filter (value > 0) latency from events),
c as (select unnest([{{'check': 'coverage', 'observed': coverage, 'expected': 90.0::double, 'low': 'WARN'}}, {{'check': 'schema', 'observed': {schema}::double, 'expected': 0.0::double, 'low': 'FAIL'}}, {{'check': 'vocab', 'observed': vocab, 'expected': 95.0::double, 'low': 'WARN'}}, {{'check': 'gate_pass', 'observed': gate, 'expected': 95.0::double, 'low': 'WARN'}},
{{'check': 'fallback', 'observed': nofb, 'expected': 95.0000001::double, 'low': 'WARN'}}, {{'check': 'd1_dist', 'observed': d, 'expected': 3.0::double, 'low': 'WARN'}}, {{'check': 'duplicates', 'observed': dup, 'expected': 0.0::double, 'low': 'WARN'}}, {{'check': 'latency', 'observed': latency, 'expected': 0.0::double, 'low': 'WARN'}}], recursive := true) from m),
s as (select "check", observed, expected, case when observed >= expected then 'PASS' when "check" = 'coverage' and observed < 50 then 'INFO' else low end status from c)
"""


@query(_CHECKS.format(schema="0") + """select "check", round(observed, 9) observed, expected, status from s""")
def completion_checks(spark, sf_dir):
    return _checks(spark, sf_dir).withColumn("observed", F.round("observed", 9))


_VERDICT = """select count(*) total, count(*) filter (status = 'PASS') passed, count(*) filter (status = 'WARN') warned, count(*) filter (status = 'FAIL') failed, case when count(*) filter (status = 'FAIL') = 0 then 'PASS' else 'FAIL' end verdict"""


@query(_CHECKS.format(schema="-1") + f"""select 'a column is missing' panel, * from ({_VERDICT} from s) union all select 'failed checks aside', * from ({_VERDICT} from s where status <> 'FAIL')""")
def go_no_go(spark, sf_dir):
    """A table without one of the required columns fails; without the failed checks it passes."""
    checks = _checks(spark, sf_dir, ("patch_id", "D1", "D2"))
    told = lambda name, df: quality.verdict(df).select(F.lit(name).alias("panel"), "*")
    return told("a column is missing", checks).unionByName(told("failed checks aside", checks.where("status <> 'FAIL'")))


@query("""with r as (select event_type, value v, row_number() over (partition by event_type order by value) - 1 k, count(*) over (partition by event_type) n from events where value > 0)
select event_type, max(n) n, round(avg(v), 9) mean, max(v) filter (k = n // 2) median, max(v) filter (k = floor(n * 0.95::double)) p95 from r group by 1""")
def latency_summary(spark, sf_dir):
    return quality.latency_summary(table(spark, sf_dir, "events", "event_type", "value"), ["event_type"], "value").withColumn("mean", F.round("mean", 9))


_STRATA = """with q as (select quantile_cont(n_chars, 0.75) q75, quantile_cont(n_chars, 0.30) q30, quantile_cont(n_chars, 0.90) q90 from documents),
d as (select doc_id, n_chars from documents),
s1 as (select doc_id from d, q where n_chars > q75 order by doc_id limit 4),
s2 as (select doc_id from d, q where n_chars > q90 and doc_id not in (select doc_id from s1) order by doc_id limit 4),
s3 as (select doc_id from d, q where n_chars < q30 and doc_id not in (select doc_id from s1 union all select doc_id from s2) order by doc_id limit 4)
"""


@query("""select 0.3::double q, quantile_cont(n_chars, 0.30) value from documents union all select 0.75::double, quantile_cont(n_chars, 0.75) from documents union all select 0.9::double, quantile_cont(n_chars, 0.9) from documents""")
def quantile_strata(spark, sf_dir):
    return ranks.quantiles(table(spark, sf_dir, "documents", "n_chars"), [], "n_chars", [0.3, 0.75, 0.9])


@query(_STRATA + "select doc_id, 'long' stratum from s1 union all select doc_id, 'longest' from s2 union all select doc_id, 'short' from s3")
def stratified_pick(spark, sf_dir):
    df = sampling.with_quantiles(table(spark, sf_dir, "documents", "doc_id", "n_chars"), {"q75": ("n_chars", 0.75), "q30": ("n_chars", 0.3), "q90": ("n_chars", 0.9)})
    strata = [("long", F.expr("n_chars > q75")), ("longest", F.expr("n_chars > q90")), ("short", F.expr("n_chars < q30"))]
    return sampling.pick_strata(df, "doc_id", strata, 4).select("doc_id", "stratum")


@query("""with n as (select lang, count(*) n from documents group by 1), s as (select lang, n, unnest(range(1, ceil(n / 200.0)::bigint + 1)) shard_id from n)
select lang, shard_id, (shard_id - 1) * 200 as start, least(shard_id * 200, n) as "end", least(shard_id * 200, n) - (shard_id - 1) * 200 as "count" from s""")
def shard_plan(spark, sf_dir):
    return calls.shard_plan(table(spark, sf_dir, "documents", "lang"), "lang", 200)


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def resume_remaining(spark, sf_dir):
    return calls.remaining(table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels", "doc_id"), ["doc_id"])


@query("""select lang, count(*) total, count(*) filter (l.doc_id is null) remaining, count(*) filter (l.doc_id is null) * 4 calls from documents d left join (select distinct doc_id from labels) l using (doc_id) group by lang""")
def dryrun_estimate(spark, sf_dir):
    return calls.dry_run(table(spark, sf_dir, "documents", "doc_id", "lang"), table(spark, sf_dir, "labels", "doc_id"), ["doc_id"], "lang", 4)


_GRID = """with s as (select 's' || s_suppkey source_id, (512 + s_suppkey * 7919 % 3000)::int width, (512 + s_suppkey * 104729 % 2000)::int height, ['train', 'val', 'test'][1 + s_nationkey % 3] split from supplier),
yy as (select *, unnest(range(0, ceil((height - 512) / 358.0)::bigint + 1)) ty from s), xx as (select *, unnest(range(0, ceil((width - 512) / 358.0)::bigint + 1)) tx from yy),
g as (select source_id, split, tx::int tx, ty::int ty, least(tx * 358, width - 512)::int x, least(ty * 358, height - 512)::int y from xx), t as (select *, source_id || '_' || x || '_' || y tile_id from g)
"""


def _images(spark, sf_dir):
    """Suppliers as source images of different sizes."""
    return table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").select(
        F.concat(F.lit("s"), "s_suppkey").alias("source_id"), F.expr("cast(512 + s_suppkey * 7919 % 3000 as int)").alias("width"), F.expr("cast(512 + s_suppkey * 104729 % 2000 as int)").alias("height"),
        F.expr("element_at(array('train', 'val', 'test'), cast(1 + s_nationkey % 3 as int))").alias("split"),
    )


@query(_GRID + "select * from t")
def tile_grid(spark, sf_dir):
    return tiling.tile_grid(_images(spark, sf_dir))


@query(_GRID + "select 'split' kind, split as value, count(*) n from t group by 2 union all select 'source_id', source_id, count(*) from t group by 2 union all select 'all', '', count(*) from t")
def tile_split_counts(spark, sf_dir):
    return tiling.group_counts(tiling.tile_grid(_images(spark, sf_dir)), ["split", "source_id"])


@query("select source, count(distinct lang)::bigint n_splits from documents group by 1 having count(distinct lang) > 1")
def split_leak(spark, sf_dir):
    return tiling.split_leaks(table(spark, sf_dir, "documents", "source", "lang"), "source", "lang")


@query("select l_orderkey, l_linenumber, count(*) n from lineitem group by all having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return quality.duplicates(table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("select md5(text) digest, count(*) n from documents group by 1 having count(*) > 1")
def duplicate_text(spark, sf_dir):
    return quality.duplicates(table(spark, sf_dir, "documents", "text").select(F.md5("text").alias("digest")), ["digest"])


@query("""select 'expected_only' side, (select count(*) from orders where o_orderkey not in (select l_orderkey from lineitem)) n union all select 'found_only', (select count(distinct l_orderkey) from lineitem where l_orderkey not in (select o_orderkey from orders))""")
def manifest_reconcile(spark, sf_dir):
    return tiling.reconcile(table(spark, sf_dir, "orders", "o_orderkey").withColumnRenamed("o_orderkey", "k"), table(spark, sf_dir, "lineitem", "l_orderkey").withColumnRenamed("l_orderkey", "k"), "k")


@query("""with l as (select distinct doc_id from labels where quality = 1), t as (select distinct doc_id from labels where toxic = 1), d as (select distinct doc_id from documents), u as (select * from l union select * from t)
select 'size:good' measure, count(*) n from l union all select 'size:toxic', count(*) from t union all select 'intersect:good&toxic', count(*) from (select * from l intersect select * from t) union all select 'union', count(*) from u
union all select 'union_only', count(*) from (select * from u except select * from d) union all select 'whole_only', count(*) from (select * from d except select * from u)""")
def split_sets(spark, sf_dir):
    marks = table(spark, sf_dir, "labels")
    return release.set_report([("good", marks.where("quality = 1")), ("toxic", marks.where("toxic = 1"))], table(spark, sf_dir, "documents", "doc_id"), "doc_id")


@query(_UNITS + """, b as (select *, case when n_engines >= 4 and unanimous then 'high' when coalesce(min_ratio, 0) >= 0.75 then 'medium' else 'review' end consensus from u)
select 'D1' bucket_kind, D1 bucket, count(*) n from b group by 2 union all select 'D2', D2, count(*) from b group by 2 union all select 'consensus', consensus, count(*) from b group by 2 union all select 'D1', 'X', 0 union all select 'D2', 'Y', 0""")
def bucket_index(spark, sf_dir):
    votes = panel.consensus(rated(spark, sf_dir), "l_orderkey", ["D1", "D2"], ORDER)
    return panel.bucket_index(votes, ["D1", "D2", "consensus"], {"D1": ["A", "R", "X"], "D2": ["F", "O", "Y"]})


@query(_UNITS + """select 'D1/' || D1 bucket, l_orderkey from u where D1 <> '' union all select 'D2/' || D2, l_orderkey from u where D2 not in ('', 'O')""")
def bucket_members(spark, sf_dir):
    return panel.bucket_members(panel.consensus(rated(spark, sf_dir), "l_orderkey", ["D1", "D2"], ORDER), "l_orderkey", ["D1", "D2"], {"D2": ["O"]})


@query("select doc_id, sha256(text) sha256, md5(text) md5, substr(sha256(text), 1, 16) short from documents")
def checksum_list(spark, sf_dir):
    return release.checksums(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


@query("""with e as (select doc_id, doc_id % 10 = 3 changed from labels), a as (select doc_id from documents where doc_id % 10 <> 7)
select case when a.doc_id is null then 'missing' when e.doc_id is null then 'unlisted' when changed then 'mismatch' else 'ok' end status, count(*) n from e full join a using (doc_id) group by 1""")
def checksum_verify(spark, sf_dir):
    """The listed sums are those of the labelled documents, some of another text; some documents are gone."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    listed = docs.join(table(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_semi").withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return release.verify_checksums(release.checksums(listed, "doc_id", "text"), release.checksums(docs.where("doc_id % 10 <> 7"), "doc_id", "text"), "doc_id")


@query("""select c_custkey, case when c_custkey % 6 = 5 then null else regexp_extract(c_name, '^(.+)#(\\d+)$', 1) end kind, case when c_custkey % 6 = 5 then null else regexp_extract(c_name, '^(.+)#(\\d+)$', 2)::int end number,
'src' || c_custkey % 5 || '_a' source_id from customer""")
def id_parse(spark, sf_dir):
    """File names, one in six of another kind, and tile ids of five sources."""
    df = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    parsed = tiling.parse_tile_name(F.concat(F.regexp_replace("c_name", "#", "_"), F.when(F.col("c_custkey") % 6 == 5, "_7.jpg").otherwise("_7.png")))
    source = answers.source_of_tile(F.concat(F.lit("src"), (F.col("c_custkey") % 5).cast("string"), F.lit("_a_"), F.regexp_extract("c_name", r"(\d+)$", 1), F.lit("_7")))
    return df.select("c_custkey", parsed.alias("p"), source.alias("source_id")).select("c_custkey", F.col("p.source_id").alias("kind"), F.col("p.x").alias("number"), "source_id")


@query("""select page_id, case when rtrim(url, '/') like '%/v1' then rtrim(url, '/') else rtrim(url, '/') || '/v1' end base_url, case when url like '%casino%' then 'forbidden:casino; missing_v1' else 'missing_v1' end faults, substr(url, 1, 6) || '...' || right(url, 4) masked from pages""")
def url_normalize(spark, sf_dir):
    df = table(spark, sf_dir, "pages", "page_id", "url")
    return df.select("page_id", answers.normalize_base_url(F.col("url")).alias("base_url"), F.concat_ws("; ", answers.url_faults(F.col("url"), ["casino"])).alias("faults"), answers.mask_key(F.col("url")).alias("masked"))


@query("""with a as (select vec_id, list_transform(embedding, lambda x: x::double) v from embeddings), s as (select *, list_transform(range(1, len(v)), lambda i: v[i + 1] - v[i]) d from a)
select vec_id, round(list_avg(v), 6) mean, round(list_stddev_pop(v), 6) std, round(list_var_pop(d), 6) edge_var from s""")
def array_stats(spark, sf_dir):
    s = sampling.array_stats(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")
    return s.select("vec_id", *(F.round(c, 6).alias(c) for c in ("mean", "std", "edge_var")))


@query("""with a as (select vec_id, list_transform(embedding, lambda x: x::double) v from embeddings),
s as (select *, list_transform(list_filter(range(1, 64), lambda i: i % 8 <> 0), lambda i: v[i + 1] - v[i]) across, list_transform(range(1, 57), lambda i: v[i + 8] - v[i]) down from a)
select vec_id, round(list_avg(v), 6) mean, round(list_stddev_pop(v), 6) std, round((list_var_pop(across) + list_var_pop(down)) / 2, 6) edge_var from s""")
def matrix_stats(spark, sf_dir):
    """The vectors as matrices of 8 x 8."""
    s = sampling.matrix_stats(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 8, 8)
    return s.select("vec_id", *(F.round(c, 6).alias(c) for c in ("mean", "std", "edge_var")))


@query("select event_type as label, count(*) n from events group by 1 order by count(*) desc, min(event_id) limit 3")
def topk_frequency(spark, sf_dir):
    return quality.top_labels(table(spark, sf_dir, "events", "event_type", "event_id"), "event_type", "event_id", 3)


@query(_PANEL + "select sum(n)::bigint labels, count(*) units, round(avg(n), 10) mean_labels from (select l_orderkey, count(distinct D1) n from p where D1 is not null group by 1)")
def unique_per_unit(spark, sf_dir):
    return panel.unique_labels_per_unit(rated(spark, sf_dir), "l_orderkey", "D1").withColumn("mean_labels", F.round("mean_labels", 10))


@query("""select count(*) filter (l_returnflag = 'N') background, count(*) filter (l_returnflag = 'N' and l_linestatus = 'F') compliant, round(count(*) filter (l_returnflag = 'N' and l_linestatus = 'F') * 100.0::double / count(*) filter (l_returnflag = 'N'), 9) rate_pct from lineitem""")
def na_compliance(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus")
    return quality.na_compliance(df, F.col("l_returnflag") == "N", F.col("l_linestatus") == "F").withColumn("rate_pct", F.round("rate_pct", 9))


_VERSIONS = """with p as (select (o_custkey % 2 = 0)::int v, l.l_orderkey u, nullif(l_returnflag, 'N') D1, l_linestatus D2, l_discount from lineitem l join orders on o_orderkey = l_orderkey),
long as (select v, u, 'D1' dim, D1 label from p union all select v, u, 'D2', D2 from p),
c as (select v, u, dim, label, count(*)::bigint c from long where label is not null group by all), um as (select v, u, dim, sum(c)::bigint m, sum(c * c)::bigint s from c group by all),
pr as (select v, dim, sum(m * (m - 1) // 2)::bigint n_pairs, sum((m * m - s) // 2)::bigint dis from um where m > 1 group by all),
n1 as (select v, dim, label, sum(c)::double n from c group by all), vl as (select v, dim, sum(n) nv, sum(n * n) sq from n1 group by all),
alpha as (select v, dim, 1 - (dis / n_pairs) / ((nv * nv - sq) / (nv * (nv - 1))) alpha from vl join pr using (v, dim)),
r as (select v, avg((D1 is not null)::int) * 100 schema_rate, avg((l_discount <= 0.05)::int) * 100 cross_rate from p group by 1)
"""


@query(_VERSIONS + """select 'schema_valid_rate' measure, round(max(schema_rate) filter (v = 0), 9) a, round(max(schema_rate) filter (v = 1), 9) b, round(max(schema_rate) filter (v = 1) - max(schema_rate) filter (v = 0), 9) delta from r
union all select 'cross_dim_valid_rate', round(max(cross_rate) filter (v = 0), 9), round(max(cross_rate) filter (v = 1), 9), round(max(cross_rate) filter (v = 1) - max(cross_rate) filter (v = 0), 9) from r
union all select 'alpha_' || dim, round(max(alpha) filter (v = 0), 9), round(max(alpha) filter (v = 1), 9), round(max(alpha) filter (v = 1) - max(alpha) filter (v = 0), 9) from alpha group by dim""")
def ab_compare(spark, sf_dir):
    """Two versions (by customer): rates, and alpha of each dimension, with their differences."""
    rated_lines = panel.clustered(table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus", "l_discount"), "l_orderkey")
    df = rated_lines.join(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    df = df.select((F.col("o_custkey") % 2 == 0).cast("int").alias("v"), "l_orderkey", F.expr("nullif(l_returnflag, 'N')").alias("D1"), F.col("l_linestatus").alias("D2"), "l_discount")
    out = agreement.ab_compare(df, "v", (0, 1), "l_orderkey", ["D1", "D2"], F.col("D1").isNotNull(), F.col("l_discount") <= 0.05)
    return out.select("measure", *(F.round(c, 9).alias(c) for c in ("a", "b", "delta")))


def _failures(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value").withColumn("failed", F.col("event_type").isin("error", "click"))


@query("""with e as (select user_id, event_id, event_type in ('error', 'click') failed from events), r as (select *, sum((not failed)::int) over (partition by user_id order by event_id) run from e),
l as (select *, sum(failed::int) over (partition by user_id, run order by event_id) len from r) select user_id, min(event_id) tripped_at, max(len)::bigint run_length from l where failed and len >= 3 group by 1""")
def circuit_breaker(spark, sf_dir):
    return calls.breaker_trips(_failures(spark, sf_dir), "user_id", "event_id", "failed", 3)


@query("""with e as (select event_type, ts, epoch_us(ts) t from events), w as (select event_type, count(*) over (partition by event_type order by t range between 60000000 preceding and current row) n, t - lag(t) over (partition by event_type order by t) gap from e)
select event_type, max(n) most_in_window, min(gap) / 1e6 least_gap_s from w group by 1""")
def rate_limit_audit(spark, sf_dir):
    return calls.rate_audit(table(spark, sf_dir, "events", "event_type", "ts"), "event_type", "ts", 60)


_ERRORS = """case event_type when 'error' then 'HTTP 429 too many' when 'click' then 'could not generate' when 'view' then 'HTTP 401' when 'purchase' then 'status 503' else 'socket closed' end"""


@query(f"""with e as (select event_id, {_ERRORS} msg, (event_id % 5 + 1)::int attempt from events),
c as (select *, nullif(regexp_extract(msg, '\\b(401|402|404|429|500|502|503|504)\\b', 1), '')::int code from e)
select event_id, code, case when code in (401, 402, 404) then 'stop' when attempt <= 3 then 'retry' else 'give_up' end batch_action,
case when (msg like '%429%' or lower(msg) like '%rate%') and attempt <= 3 then 'retry' when msg like '%503%' and attempt <= 2 then 'retry' when lower(msg) like '%socket%' and attempt <= 1 then 'retry' else 'give_up' end shared_action,
case when (msg like '%429%' or lower(msg) like '%rate%') and attempt <= 3 then (2 ** attempt)::int when msg like '%503%' and attempt <= 2 then 2 when lower(msg) like '%socket%' and attempt <= 1 then 3 end shared_wait_s from c""")
def retry_class(spark, sf_dir):
    df = table(spark, sf_dir, "events", "event_id", "event_type").withColumns({"msg": F.expr(_ERRORS), "attempt": F.expr("cast(event_id % 5 + 1 as int)")})
    df = df.withColumn("code", answers.status_code(F.col("msg"), F.lit(None).cast("string")))
    df = df.withColumns({"b": answers.batch_retry(F.col("code"), F.col("attempt")), "s": answers.shared_retry(F.col("msg"), F.col("attempt"))})
    return df.select("event_id", "code", F.col("b.action").alias("batch_action"), F.col("s.action").alias("shared_action"), F.col("s.wait_s").alias("shared_wait_s"))


@query("""select event_type, event_id, n done from (select event_type, event_id, row_number() over (partition by event_type order by event_id) n from events) where n % 300 = 0""")
def progress_marks(spark, sf_dir):
    return calls.progress_marks(table(spark, sf_dir, "events", "event_type", "event_id"), "event_type", "event_id", 300).select("event_type", "event_id", F.col("done").cast("long").alias("done"))


@query("""with a as (select event_type, count(*) done, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 elapsed_s from events group by 1) select event_type, done, elapsed_s, round(done * 60.0::double / elapsed_s, 9) per_minute, greatest(7455 - done, 0) remaining, round(greatest(7455 - done, 0) * 60.0::double / (done * 60.0::double / elapsed_s), 3) eta_s from a""")
def throughput_eta(spark, sf_dir):
    t = calls.throughput(table(spark, sf_dir, "events", "event_type", "ts"), ["event_type"], "ts", 7455)
    return t.withColumns({"per_minute": F.round("per_minute", 9), "eta_s": F.round("eta_s", 3)})


@query("""with r as (select *, row_number() over (partition by user_id order by event_id) attempt, count(*) over (partition by user_id) attempts from events) select user_id, event_id, event_type, attempts from r where attempt = attempts""")
def final_attempts(spark, sf_dir):
    return calls.final_attempts(table(spark, sf_dir, "events", "user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("""select user_id, count(*) completed, count(*) filter (event_type = 'error') failed, count(*) total, count(*) - count(*) filter (event_type = 'error') succeeded, count(*) + count(*) filter (event_type = 'error') total_as_counted from events group by 1""")
def run_totals(spark, sf_dir):
    return calls.run_totals(table(spark, sf_dir, "events", "user_id", "event_type").withColumn("failed", F.col("event_type") == "error"), "user_id", "failed")


@query("""select doc_id from documents where contains(text, '[To be') or contains(text, '10.xxxx') or contains(text, 'token =')""")
def placeholder_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").where(release.has_placeholder(F.col("text"), ("[To be", "10.xxxx", "token ="))).select("doc_id")


@query("""select event_id, 'k' keys from events where json_extract(props, '$.k') is not null""")
def secret_scan(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id", "props").select("event_id", F.concat_ws(",", release.secret_keys(F.col("props"), ("k", "token"))).alias("keys")).where("keys <> ''")


@query("""with u as (select event_type g, value v from events union all select event_type, user_id::double from events where event_id % 3 = 0) select g event_type, count(*) n, round(avg(v), 9) mean from u group by 1""")
def pooled_means(spark, sf_dir):
    df = table(spark, sf_dir, "events", "event_id", "event_type", "value", "user_id")
    second = df.where("event_id % 3 = 0").select("event_type", F.col("user_id").alias("value"))
    return quality.pooled_mean([df, second], "event_type", "value").withColumn("mean", F.round("mean", 9))


@query("""select d.doc_id, e.engine, v.version from (select doc_id from documents where doc_id not in (select doc_id from labels)) d cross join (values ('a'), ('b')) e(engine) cross join (values (1), (2)) v(version)""")
def work_list(spark, sf_dir):
    todo = calls.remaining(table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels", "doc_id"), ["doc_id"])
    return todo.select("doc_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("engine")).select("doc_id", "engine", F.explode(F.array(F.lit(1), F.lit(2))).alias("version"))


from raterlake.plans import reports  # noqa: E402, F401  (registers its queries)
