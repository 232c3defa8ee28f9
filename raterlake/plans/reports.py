"""Registered queries of gates, runs, splits and release reports, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from raterlake.functions import labels
from raterlake.operators import calls, gate, panel, quality, release, sampling, tiling
from raterlake.plans.catalog import _UNITS, ORDER, query, rated, table
from raterlake.sources import readers


@query("""with u as (select doc_id, 0 s from labels where quality = 0 union all select doc_id, 1 from documents where lang = 'fr' union all select doc_id, 2 from documents),
f as (select doc_id, min(s) s from u group by 1) select doc_id from f order by s, doc_id limit 400""")
def patch_pool_union(spark, sf_dir):
    """Low-quality documents first, then French ones, others only to reach 400."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang")
    return readers.coalesced_pool([table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), docs.where("lang = 'fr'").select("doc_id"), docs.select("doc_id")], "doc_id", 400)


def _damage_answers(spark, sf_dir):
    k = F.col("p_partkey")
    fields = {"P1": F.when(k % 2 == 0, "起甲").otherwise("剥离"), "P2": F.lit("空鼓"), "P3": F.lit("裂隙"), "P4": F.lit("无"), "severity": F.when(k % 5 == 0, "extreme").otherwise("轻微"), "confidence": F.lit("0.9")}
    full = F.create_map(*(x for name, v in fields.items() for x in (F.lit(name), v)))
    with_area = F.when(k % 7 == 0, full).otherwise(F.map_concat(full, F.create_map(F.lit("area"), k.cast("string"))))
    df = table(spark, sf_dir, "part", "p_partkey")
    return df.select("p_partkey", F.when(k % 11 == 0, "none").otherwise("object").alias("kind"), F.when(k % 11 != 0, with_area).alias("fields"))


@query("""with r as (select p_partkey, p_partkey % 11 <> 0 parsed, p_partkey % 2 = 0 known, p_partkey % 5 <> 0 sev, p_partkey % 7 <> 0 area from part)
select p_partkey, case when parsed and known then '起甲' else '完好' end P1, case when parsed then case when sev then '轻微' else 'extreme' end else '' end severity, case when parsed and area then p_partkey::varchar else '' end area,
parsed and area raw_schema_ok, parsed and known and sev raw_vocab_ok, parsed and area and known and sev gate_pass, not (parsed and area and known and sev) review_required,
case when not parsed then 'not_dict; no_data' else array_to_string(list_filter([case when not area then 'area' end, case when not known then 'P1=''剥离''' end, case when not sev then 'severity=''extreme''' end], lambda x: x is not null), '; ') end raw_errors from r""")
def gate_step4(spark, sf_dir):
    rows = gate.assemble_damage_rows(_damage_answers(spark, sf_dir))
    return rows.select("p_partkey", "P1", "severity", "area", "raw_schema_ok", "raw_vocab_ok", "gate_pass", "review_required", "raw_errors")


def _pilot(spark, sf_dir):
    df = table(spark, sf_dir, "part", "p_partkey", "p_brand")
    semantic = df.select(F.col("p_partkey").alias("patch_id"), F.col("p_brand").alias("engine"), F.when(F.col("p_partkey") % 10 != 0, "神将").otherwise("x").alias("D1"))
    damage = df.where("p_partkey % 4 <> 3").select(F.col("p_partkey").alias("patch_id"), F.col("p_brand").alias("engine"), F.when(F.col("p_partkey") % 6 != 0, "起甲").otherwise("y").alias("P1"))
    return gate.both_steps(semantic, damage, ["patch_id", "engine"])


_PILOT = """with j as (select p_partkey patch_id, p_brand engine, p_partkey % 10 <> 0 step3_valid, p_partkey % 6 <> 0 step4_valid from part where p_partkey % 4 <> 3)
"""


@query(_PILOT + "select patch_id, engine, step3_valid, step4_valid from j")
def steps_joined(spark, sf_dir):
    return _pilot(spark, sf_dir).select("patch_id", "engine", "step3_valid", "step4_valid")


@query(_PILOT + """select count(*) total, count(*) filter (step3_valid) step3_pass, count(*) filter (step4_valid) step4_pass, round(avg(step3_valid::int), 9) step3_rate, round(avg(step4_valid::int), 9) step4_rate,
avg(step3_valid::int) >= 0.9 and avg(step4_valid::int) >= 0.9 exit_ok from j""")
def pilot_exit(spark, sf_dir):
    out = quality.pilot_exit(_pilot(spark, sf_dir), "step3_valid", "step4_valid")
    return out.withColumns({c: F.round(c, 9) for c in ("step3_rate", "step4_rate")})


def _smoke(spark, sf_dir):
    df = table(spark, sf_dir, "events", "event_id", "event_type", "value")
    engine = F.col("event_type").alias("engine")
    semantic = df.select(engine, (F.col("event_id") % 20 != 0).cast("string").alias("raw_schema_ok"), (F.col("value") > 1).cast("string").alias("gate_pass"), F.when(F.col("event_id") % 30 == 0, "rule").otherwise("").alias("cross_dim_warnings"))
    damage = df.where("event_id % 2 = 0").select(engine, (F.col("event_id") % 6 != 0).cast("string").alias("raw_schema_ok"), (F.col("value") > 3).cast("string").alias("gate_pass"))
    return quality.smoke_checks(semantic, damage)


_SMOKE = """with b as (select event_type e, 3 step, event_id % 20 <> 0 sch, value > 1 gate, event_id % 30 <> 0 crs from events union all select event_type, 4, event_id % 6 <> 0, value > 3, false from events where event_id % 2 = 0),
c as (select 'raw_schema_rate_s3' "check", avg(sch::int) filter (step = 3) observed, 0.9::double expected from b union all select 'raw_schema_rate_s4', avg(sch::int) filter (step = 4), 0.9 from b
union all select 'cross_dim_valid_rate', avg(crs::int) filter (step = 3), 0.95 from b union all select 'engine_' || e || '_gate_pass', avg(gate::int), 0.7 from b group by e),
s as (select "check", observed, expected, case when observed >= expected then 'PASS' else 'FAIL' end status from c)
"""


@query(_SMOKE + """select "check", round(observed, 9) observed, expected, status from s""")
def smoke_checks(spark, sf_dir):
    return _smoke(spark, sf_dir).withColumn("observed", F.round("observed", 9))


@query(_SMOKE + """select count(*) total, count(*) filter (status = 'FAIL') failed, case when count(*) filter (status = 'FAIL') = 0 then 'GO' else 'NO-GO' end verdict from s""")
def smoke_go_no_go(spark, sf_dir):
    return quality.go_no_go(_smoke(spark, sf_dir))


@query("""select event_type, count(*) calls, round(avg(value), 9) avg_latency_ms, round(count(*) * avg(value) / 1000, 9) total_s from events group by 1""")
def speed_report(spark, sf_dir):
    out = calls.speed_report(table(spark, sf_dir, "events", "event_type", "value"), "event_type", "value")
    return out.withColumns({c: F.round(c, 9) for c in ("avg_latency_ms", "total_s")})


@query("""with e as (select event_type, count(*) n from events group by 1), r as (select event_type from e where n > 10 and event_type <> 'error')
select count(*) ready_count, string_agg(event_type, ',' order by event_type) ready_engines, count(*) >= 2 consensus_ready from r""")
def consensus_ready(spark, sf_dir):
    engines = table(spark, sf_dir, "events", "event_type").groupBy("event_type").agg(F.count("*").alias("n"))
    return calls.ready(engines, "event_type", F.col("n") > 10, F.col("event_type") != "error")


@query("""with v(dim, position, label) as (values ('D4', 1, '完好'), ('D4', 2, '轻微损伤'), ('D4', 3, '中度损伤'), ('D4', 4, '严重损伤'), ('D4', 5, '古代补绘'), ('D5', 1, '前景'), ('D5', 2, '中景'), ('D5', 3, '背景'), ('D5', 4, '云气区')),
a as (select p_partkey, case when p_partkey % 2 = 0 then 'D4' else 'D5' end dim, case p_partkey % 5 when 0 then '完好' when 1 then '背景' when 2 then '古代补绘' when 3 then '云气区' else 'none' end label from part)
select p_partkey, dim, label, coalesce(position, 0) as position from a left join v using (dim, label)""")
def label_position(spark, sf_dir):
    """The place of each row's label in its dimension's vocabulary, 0 if it isn't there."""
    label = labels.lookup({str(i): x for i, x in enumerate(("完好", "背景", "古代补绘", "云气区", "none"))}, (F.col("p_partkey") % 5).cast("string"))
    df = table(spark, sf_dir, "part", "p_partkey").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "D4").otherwise("D5").alias("dim"), label.alias("label"))
    places = F.broadcast(labels.label_positions(spark, ["D4", "D5"]))  # nine rows
    return df.join(places, ["dim", "label"], "left").select("p_partkey", "dim", "label", F.coalesce("position", F.lit(0)).alias("position"))


@query("""select p_partkey, case p_partkey % 6 when 0 then '完好' when 1 then '轻微' when 2 then '中度' when 3 then '严重' when 4 then '濒危' end severity_label,
case p_partkey % 6 when 0 then 0.0::double when 1 then 0.2 when 2 then 0.5 when 3 then 0.8 when 4 then 1.0 end weight from part""")
def severity_weights(spark, sf_dir):
    """Codes, one label, and one unknown."""
    given = F.element_at(F.array(*map(F.lit, ["intact", "mild", "中度", "severe", "critical", "extreme"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part", "p_partkey").select("p_partkey", labels.severity(given).alias("s")).select("p_partkey", F.col("s.label").alias("severity_label"), F.col("s.weight").alias("weight"))


_HASH = "('0x' || substr(md5('42:' || doc_id), 1, 13))::bigint"


@query(f"""with h as (select doc_id, {_HASH} / 4503599627370496.0::double u from documents) select doc_id, case when u < 0.8 then 'train' when u < 0.9 then 'val' else 'test' end split from h""")
def hash_split(spark, sf_dir):
    return tiling.hash_split(table(spark, sf_dir, "documents", "doc_id"), "doc_id").select("doc_id", "split")


@query(f"""with h as (select doc_id, row_number() over (order by {_HASH}) r, count(*) over () n from documents) select doc_id, case when r <= floor(n * 0.8::double) then 'train' when r <= floor(n * 0.8::double) + floor(n * 0.1::double) then 'val' else 'test' end split from h""")
def rank_split(spark, sf_dir):
    return tiling.rank_split(table(spark, sf_dir, "documents", "doc_id"), "doc_id").select("doc_id", "split")


@query(f"select doc_id from documents order by {_HASH}, doc_id limit 10")
def hash_sample(spark, sf_dir):
    return sampling.hash_sample(table(spark, sf_dir, "documents", "doc_id"), "doc_id", 10)


_VALUES = "with r as (select o_orderkey, o_orderstatus d1, case when o_orderkey % 3 = 0 then '' else substr(o_orderpriority, 3) end d2 from orders)"
_ERRORS = "array_to_string(list_filter([case when d1 not in ('F', 'O') then 'D1=''' || d1 || '''' end, case when d2 not in ('URGENT', 'HIGH', 'LOW'){lenient} then 'D2=''' || d2 || '''' end], lambda x: x is not null), '; ')"


def _vocabulary(spark, sf_dir, blank_allowed):
    df = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    d2 = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.substring("o_orderpriority", 3, 100))
    errors = labels.vocabulary_errors({"D1": F.col("o_orderstatus"), "D2": d2}, {"D1": ["F", "O"], "D2": ["URGENT", "HIGH", "LOW"]}, blank_allowed)
    return df.select("o_orderkey", F.concat_ws("; ", errors).alias("errors"))


@query(f"{_VALUES} select o_orderkey, {_ERRORS.format(lenient='')} errors from r")
def vocab_errors_strict(spark, sf_dir):
    return _vocabulary(spark, sf_dir, ())


@query(f"{_VALUES} select o_orderkey, {_ERRORS.format(lenient=' and d2 <> ' + chr(39) * 2)} errors from r")
def vocab_errors_lenient(spark, sf_dir):
    return _vocabulary(spark, sf_dir, ("D2",))


@query("""with s(source_id, width, height, split) as (values ('yl_raw_001', 29400, 7511, 'train'), ('yl_raw_002', 19220, 7511, 'test'), ('yl_raw_003', 29127, 7511, 'train'), ('yl_raw_004', 20950, 7511, 'val'), ('yl_raw_005', 28223, 7511, 'train')),
c as (select c_custkey, 'yl_raw_00' || c_custkey % 8 source_id from customer) select c_custkey, source_id, coalesce(split, '') split, coalesce(width, 0) width, coalesce(height, 0) height from c left join s using (source_id)""")
def source_lookup(spark, sf_dir):
    df = table(spark, sf_dir, "customer", "c_custkey").withColumn("source_id", F.concat(F.lit("yl_raw_00"), (F.col("c_custkey") % 8).cast("string")))
    return tiling.with_source(df, tiling.sources(spark))


@query("""with r as (select lang, d.doc_id, l.doc_id is null todo, ceil(row_number() over (partition by lang order by d.doc_id) / 50.0)::bigint shard_id from documents d left join (select distinct doc_id from labels) l using (doc_id))
select lang, shard_id, (shard_id - 1) * 50 "start", (shard_id - 1) * 50 + count(*) "end", count(*) "count", count(*) filter (todo) remaining, count(*) filter (todo) * 4 calls from r group by lang, shard_id""")
def dryrun_shards(spark, sf_dir):
    """What a run that resumes would do, shard by shard."""
    return calls.dry_run_shards(table(spark, sf_dir, "documents", "lang", "doc_id"), table(spark, sf_dir, "labels", "doc_id"), ["doc_id"], "lang", "doc_id", 50, 4)


@query("""with r as (select lang, doc_id, ceil(row_number() over (partition by lang order by doc_id) / 50.0)::bigint shard_id from documents) select lang, doc_id, shard_id from r where shard_id = 2""")
def shard_filter(spark, sf_dir):
    return calls.shard_rows(table(spark, sf_dir, "documents", "lang", "doc_id"), "lang", "doc_id", 50, 2)


@query(_UNITS + """, m as (select 'D1/' || D1 bucket, l_orderkey from u where D1 <> '' union all select 'D2/' || D2, l_orderkey from u where D2 <> ''), k(bucket) as (values ('D1/A'), ('D1/R'), ('D1/X'), ('D2/F'), ('D2/O'))
select bucket, count(l_orderkey) n, min(l_orderkey) first_unit, max(l_orderkey) last_unit from k full join m using (bucket) group by 1""")
def bucket_manifest(spark, sf_dir):
    members = panel.bucket_members(panel.consensus(rated(spark, sf_dir), "l_orderkey", ["D1", "D2"], ORDER), "l_orderkey", ["D1", "D2"])
    return panel.bucket_manifest(members, "l_orderkey", {"D1": ["A", "R", "X"], "D2": ["F", "O"]})


@query(_UNITS + """select l_orderkey, D1, o_orderstatus split, o_totalprice size from u join orders on o_orderkey = l_orderkey where o_orderkey % 5 <> 0""")
def consensus_files(spark, sf_dir):
    """Units with the file that has their split and id; units without a file go."""
    votes = panel.consensus(rated(spark, sf_dir), "l_orderkey", ["D1", "D2"], ORDER).select("l_orderkey", "D1")
    files = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice").where("o_orderkey % 5 <> 0")
    return votes.join(files.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("split"), F.col("o_totalprice").alias("size")), "l_orderkey")


@query("""select 'orders and lines' manifest, (select count(*) from orders where o_orderkey not in (select l_orderkey from lineitem)) manifest_only, (select count(distinct l_orderkey) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey is not null)) disk_only,
(select count(*) from (select o_custkey from orders group by 1 having count(distinct o_orderstatus) > 1)) leaking, (select count(*) from (select o_orderkey from orders group by 1 having count(*) > 1)) duplicates, exists (select 1 from orders where o_orderkey is null) consistent
union all select 'nations and customers', (select count(*) from nation where n_nationkey not in (select c_nationkey from customer)), (select count(distinct c_nationkey) from customer where c_nationkey not in (select n_nationkey from nation)),
(select count(*) from (select n_nationkey from nation group by 1 having count(distinct n_regionkey) > 1)), (select count(*) from (select n_nationkey from nation group by 1 having count(*) > 1)),
not exists (select 1 from nation where n_nationkey not in (select c_nationkey from customer)) and not exists (select 1 from customer where c_nationkey not in (select n_nationkey from nation))""")
def manifest_verdict(spark, sf_dir):
    """One manifest that differs from what is there, and one that agrees with it."""
    manifest = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus").withColumnRenamed("o_orderkey", "k")
    one = tiling.rebuild_verdict(manifest, table(spark, sf_dir, "lineitem", "l_orderkey").withColumnRenamed("l_orderkey", "k"), "k", "o_custkey", "o_orderstatus")
    nations = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").alias("own"), "n_regionkey")
    other = tiling.rebuild_verdict(nations, table(spark, sf_dir, "customer", "c_nationkey").withColumnRenamed("c_nationkey", "k"), "k", "own", "n_regionkey")
    return one.select(F.lit("orders and lines").alias("manifest"), "*").unionByName(other.select(F.lit("nations and customers").alias("manifest"), "*"))


def _release(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "n_chars")
    path = F.col("doc_id").cast("string")
    files = docs.where("doc_id % 10 <> 7").select(path.alias("path"), F.sha2("text", 256).alias("sha256"))
    sums = docs.where("doc_id % 9 <> 0").select(path.alias("path"), F.sha2(F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    part = lambda rule: docs.where(rule).select(F.col("doc_id").alias("patch_id"))
    splits = [("train", part("lang = 'en' or doc_id % 50 = 0")), ("val", part("lang = 'de'")), ("test", part("lang in ('fr', 'es')"))]
    level = F.when(F.col("n_chars") > 5000, "high").when(F.col("n_chars") > 500, "medium").otherwise("odd")
    consensus = docs.where("doc_id % 5 <> 1").select(F.col("doc_id").alias("patch_id"), level.alias("consensus_level"))
    events = table(spark, sf_dir, "events", "event_type", "value", "props", "event_id")
    per_rater = events.select(F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("engine"), (F.col("value") > 5).alias("gate_pass"))
    return release.validate(
        files, ["1", "7", "no such file"], sums, splits, 7455, consensus, per_rater, {"click": 5, "gone": None, "view": None},
        docs.select(path.alias("name"), F.col("text").alias("content")), events.select(F.col("event_id").alias("name"), F.replace("props", F.lit('"k"'), F.lit('"key"')).alias("content")), labels.label_positions(spark, ["D4", "D5"]),
        optional=["2", "no such note"],
    )


_RELEASE = """with f as (select doc_id, sha256(text) s from documents where doc_id % 10 <> 7), e as (select doc_id, sha256(case when doc_id % 10 = 3 then text || 'x' else text end) s from documents where doc_id % 9 <> 0),
sp as (select doc_id, 'train' p from documents where lang = 'en' or doc_id % 50 = 0 union all select doc_id, 'val' from documents where lang = 'de' union all select doc_id, 'test' from documents where lang in ('fr', 'es')),
c as (select doc_id, case when n_chars > 5000 then 'high' when n_chars > 500 then 'medium' else 'odd' end lv from documents where doc_id % 5 <> 1),
g as (select case when event_type = 'error' then '' else event_type end e, value > 5 g from events),
r(section, "check", bad, n) as (select 'files', 'required: ' || v.x, 'FAIL', (v.x not in (select doc_id::varchar from f))::int::bigint from (values ('1'), ('7'), ('no such file')) v(x)
union all select 'files', 'optional: ' || v.x, 'WARN', (v.x not in (select doc_id::varchar from f))::int::bigint from (values ('2'), ('no such note')) v(x)
union all select 'checksums', 'files without a checksum', 'FAIL', count(*) from f where doc_id not in (select doc_id from e)
union all select 'checksums', 'checksums that differ', 'FAIL', count(*) from f join e using (doc_id) where f.s <> e.s
union all select 'splits', 'ids more or fewer than expected', 'FAIL', abs(count(*) - 7455) from sp
union all select 'splits', 'ids in two splits', 'FAIL', count(*) from (select doc_id from sp group by 1 having count(*) > 1)
union all select 'consensus', 'ids that consensus and splits lack of each other', 'FAIL', count(*) from (select distinct doc_id from sp) a full join c b using (doc_id) where a.doc_id is null or b.doc_id is null
union all select 'consensus', 'unknown levels', 'FAIL', count(*) from c where lv = 'odd'
union all select 'raters', 'rows of no rater', 'WARN', count(*) from g where e = ''
union all select 'secrets', 'documents with secret keys', 'FAIL', count(*) from events where json_extract(props, '$.k') is not null
union all select 'placeholders', 'texts with placeholders', 'WARN', count(*) from documents where contains(text, '[To be') or contains(text, '10.xxxx') or contains(text, 'XXXXXXX')),
s as (select section, "check", case when n = 0 then 'PASS' else bad end status, n from r
union all select 'raters', 'rows of ' || v.x, case when v.w is null and count(e) > 0 or count(e) = v.w then 'PASS' else 'FAIL' end, count(e) from (values ('click', 5), ('gone', null), ('view', null)) v(x, w) left join g on e = v.x group by v.x, v.w
union all select 'raters', 'rows that failed the gate', 'PASS', count(*) from g where not g union all select 'taxonomy', 'labels of D4', 'PASS', 5 union all select 'taxonomy', 'labels of D5', 'PASS', 4)
"""


@query(_RELEASE + """select section, "check", status, n from s""")
def release_validate(spark, sf_dir):
    return _release(spark, sf_dir)


_RELEASED = """select count(*) filter (status = 'PASS') passed, count(*) filter (status = 'WARN') warned, count(*) filter (status = 'FAIL') failed, case when count(*) filter (status = 'FAIL') > 0 then 'NOT READY' when count(*) filter (status = 'WARN') > 0 then 'PASS with warnings' else 'PASS' end verdict"""


@query(_RELEASE + f"""select 'all' checks, * from ({_RELEASED} from s) union all select 'without failures', * from ({_RELEASED} from s where status <> 'FAIL') union all select 'passed', * from ({_RELEASED} from s where status = 'PASS')""")
def release_verdict(spark, sf_dir):
    """All verdicts: of the whole report, of it without its failures, and of what passed."""
    report = _release(spark, sf_dir)
    told = lambda name, df: release.release_verdict(df).select(F.lit(name).alias("checks"), "*")
    return told("all", report).unionByName(told("without failures", report.where("status <> 'FAIL'"))).unionByName(told("passed", report.where("status = 'PASS'")))


@query("""with u as (select distinct doc_id from labels where quality = 1 or toxic = 1), v as (select distinct doc_id from documents where lang in ('en', 'de', 'fr') or lang not in ('en', 'de', 'fr') or lang is null),
b as (select 'labels' parts, count(*) filter (u.doc_id is null) missing, count(*) filter (d.doc_id is null) extra from documents d full join u using (doc_id)
  union all select 'languages', count(*) filter (v.doc_id is null), count(*) filter (d.doc_id is null) from documents d full join v using (doc_id))
select *, missing = 0 and extra = 0 equal from b""")
def sets_equal(spark, sf_dir):
    """Labelled rows, which are not all documents, and the documents by language, which are."""
    marks, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents", "doc_id", "lang")
    known = ["en", "de", "fr"]
    by = [docs.where(F.col("lang") == x) for x in known] + [docs.where(F.col("lang").isNull() | ~F.col("lang").isin(known))]
    one = release.sets_equal([marks.where("quality = 1"), marks.where("toxic = 1")], docs, "doc_id")
    return one.select(F.lit("labels").alias("parts"), "*").unionByName(release.sets_equal(by, docs, "doc_id").select(F.lit("languages").alias("parts"), "*"))


@query("""select item_id::varchar as name, substr(sha256(text), 1, 16) sha256_16, length(text)::int length from benchmark""")
def freeze_hashes(spark, sf_dir):
    return release.freeze(table(spark, sf_dir, "benchmark").withColumn("item_id", F.col("item_id").cast("string")), "item_id", "text")


@query("""select event_type, 'step3_full_' || strftime(min(ts), '%Y%m%d_%H%M%S') run_id, 'run_' || strftime(max(ts), '%Y%m%d_%H%M%S') || '_tile' tile_run_id from events group by 1""")
def run_ids(spark, sf_dir):
    df = table(spark, sf_dir, "events", "event_type", "ts").groupBy("event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return df.select("event_type", calls.run_id("step3_full", F.col("a")).alias("run_id"), calls.run_id("run", F.col("b"), "tile").alias("tile_run_id"))


@query("""select event_type, count(*) completed, count(*) filter (value > 50) failed, count(*) filter (value <= 50) succeeded, count(*) + count(*) filter (value > 50) total_as_counted, min(event_id) first_event, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 elapsed_s from events group by 1""")
def run_manifest(spark, sf_dir):
    df = table(spark, sf_dir, "events", "event_type", "value", "ts", "event_id").withColumn("failed", F.col("value") > 50)
    return calls.run_manifest(df, "event_type", "failed", "ts", F.min("event_id").alias("first_event")).select("event_type", "completed", "failed", "succeeded", "total_as_counted", "first_event", "elapsed_s")
