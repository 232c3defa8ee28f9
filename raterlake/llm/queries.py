"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from raterlake.llm.decontam import leaked_items

    return leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from raterlake.llm.repeats import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=50, unit="bytes")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from raterlake.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), window=2048)


def op4_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from raterlake.llm.pseudolm import pseudo_likelihood

    return pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from raterlake.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from raterlake.llm.html import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from raterlake.llm.quality import score_quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op8_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from raterlake.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from raterlake.llm.covertree import linked_vectors

    return linked_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op10_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from raterlake.llm.edits import redact

    return redact(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_tokens_before", "n_edits", "n_tokens", "n_chars_encoded")


def op10_edits_of_a_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from trees that are kept and edits that come as a table."""
    from raterlake.llm.edits import apply_edits, redactions, token_trees

    docs = _table(spark, sf_dir, "documents")
    return apply_edits(token_trees(docs), redactions(docs)).select(F.col("id").alias("doc_id"), "n_tokens_before", "n_edits", "n_tokens", "n_chars_encoded")


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from raterlake.llm.fingerprints import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from raterlake.llm.merkle import merkle_manifest

    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle_manifest(_table(spark, sf_dir, "documents"), held=tampered)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from raterlake.llm.phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_packing": op3_packing,
    "op4_masked_pseudo_likelihood": op4_masked_pseudo_likelihood,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_byte_cnn_language": op8_byte_cnn_language,
    "op9_cover_tree": op9_cover_tree,
    "op10_edit_aware_token_counts": op10_edit_aware_token_counts,
    "op10_edits_of_a_table": op10_edits_of_a_table,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_phrase_collocations": op13_phrase_collocations,
}

_ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_benchmark_decontamination": f"""
with w as (select false item, doc_id id, regexp_extract_all({_ASCII_LOWER}, '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') w from documents
  union all select true, item_id, regexp_extract_all({_ASCII_LOWER}, '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') from benchmark),
s as (select distinct item, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) s from w),
n as (select id item_id, count(*) n_item_shingles from s where item group by id),
shared as (select d.id doc_id, i.id item_id, count(*) n_shared from s d join s i on d.s = i.s and not d.item and i.item group by all)
select doc_id, item_id, n_item_shingles, n_shared, n_shared / n_item_shingles containment from shared join n using (item_id) where 100 * n_shared >= 80 * n_item_shingles""",
    "op2_suffix_array_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
block as (select doc_id, b, substr(h, 2 * b + 1, 610) h from (select doc_id, h, unnest(range(0, len(h) // 2, 256)) b from d)),
w as (select doc_id, b + p p, substr(h, 2 * p - 1, 100) s from (select doc_id, b, h, unnest(range(1, least(len(h) // 2 - 48, 257))) p from block)),
f as (select s, min(doc_id) m from w group by s),
hit as (select doc_id, p from w join f using (s) where m < doc_id),
island as (select *, sum(fresh) over (partition by doc_id order by p) k from (select *, case when p - lag(p) over (partition by doc_id order by p) <= 50 then 0 else 1 end fresh from hit)),
span as (select doc_id, k, min(p) a, max(p) + 49 b from island group by all),
gap as (select doc_id, a, coalesce(lag(b) over (partition by doc_id order by a), 0) + 1 c, a - 1 e from span
  union all select doc_id, 1000000000000, coalesce(max(b), 0) + 1, any_value(len(h) // 2) from d left join span using (doc_id) group by doc_id),
kept as (select doc_id, string_agg(substr(h, 2 * c - 1, 2 * (e - c + 1)), '' order by a) t from gap join d using (doc_id) group by doc_id),
n as (select doc_id, sum(b - a + 1)::bigint n_removed, count(*) n_spans from span group by doc_id)
select doc_id, (len(h) // 2)::bigint n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(t)) kept_sha256 from d join kept using (doc_id) left join n using (doc_id)""",
    "op5_minhash_near_dedup": f"""
with recursive w as (select doc_id, list_filter(string_split_regex({_ASCII_LOWER}, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) s from w),
n as (select doc_id, count(*) n from s group by 1),
shared as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (select x, y from shared join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 80 * (nx.n + ny.n - c)),
edge as (select x, y from link union select y, x from link),
reach(id, other) as (select x, y from edge union select r.id, e.y from reach r join edge e on r.other = e.x),
least as (select id, min(other) m from reach group by id)
select d.doc_id, coalesce(n, 0) n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) component_id, coalesce(m, d.doc_id) >= d.doc_id kept from documents d left join n using (doc_id) left join least on id = d.doc_id""",
    "op12_merkle_manifest": """
with recursive d as (select *, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: list_prepend(ascii(c)::bigint, list_transform(range(8), lambda b: -1::bigint))))),
  lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384::bigint) else a // 2 end) crc from documents),
e as (select doc_id, coalesce('=' || source, '-') g, text, case when crc % 2 = 1 then replace(text, chr(10), '') else text end held,
  coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') head from d),
l as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 i from (select doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) leaf, sha256(head || coalesce(strlen(held) || ':' || held, '-')) held from e)),
n(g, lv, i, h, c) as (select g, 0::bigint, i, leaf, count(*) over (partition by g) from l union all select g, lv + 1, i // 3, sha256(string_agg(h, '' order by i)), (max(c) + 2) // 3 from n where c > 1 group by g, lv, i // 3),
r as (select g, h subroot, row_number() over (order by g) - 1 i from n where c = 1),
m(lv, i, h, c) as (select 0::bigint, i, subroot, count(*) over () from r union all select lv + 1, i // 3, sha256(string_agg(h, '' order by i)), (max(c) + 2) // 3 from m where c > 1 group by lv, i // 3),
s as materialized (select a.g, a.lv, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') x, coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') y from n a join n b on a.g = b.g and a.lv = b.lv and a.i // 3 = b.i // 3 where a.c > 1 group by all),
t as materialized (select a.lv, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') x, coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') y from m a join m b on a.lv = b.lv and a.i // 3 = b.i // 3 where a.c > 1 group by all),
f(g, k, lv, i, h, p) as (select g, i, 0::bigint, i, held, '' from l union all select f.g, k, f.lv + 1, f.i // 3, sha256(x || h || y), p || x || y from f join s using (g, lv, i)),
o as (select f.g, k, h, p from f left join s using (g, lv, i) where s.g is null),
u(g, k, lv, i, h, p) as (select o.g, k, 0::bigint, r.i, o.h, p from o join r using (g) union all select g, k, u.lv + 1, u.i // 3, sha256(x || h || y), p || x || y from u join t using (lv, i))
select l.doc_id, leaf, subroot, z.h root, sha256(p) proof_sha256, u.h folded_root, u.h = z.h verified from u left join t using (lv, i) join l on l.g = u.g and l.i = u.k join r on r.g = u.g, (select h from m where c = 1) z where t.lv is null""",
    "op13_phrase_collocations": """
with p as (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) p from documents),
w as (select lang, list_filter(string_split_regex(p, '[ \\t]+'), lambda x: x <> '') w from p),
total as (select lang, sum(len(w))::bigint n from w group by lang),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) phrase from w, range(1, 5) r(k)),
f as materialized (select lang, k, phrase, count(*) f from g group by all having count(*) >= 30),
c as (select lang, k, phrase, f a, string_split(phrase, ' ') w from f where k > 1),
split as (select lang, phrase, a, j, array_to_string(w[1:j], ' ') x, array_to_string(w[j + 1:k], ' ') y from (select *, unnest(range(1, k)) j from c)),
cut as (select s.lang, s.phrase, a, j, x.f l, y.f r, (2000000::hugeint * a) // (x.f + y.f) score from split s join f x on x.lang = s.lang and x.phrase = s.x join f y on y.lang = s.lang and y.phrase = s.y),
best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inside as (select lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))))) phrase from c where k > 2),
m as (select lang, phrase, max(a) longer from inside group by all),
kept as (select b.* from best b left join m using (lang, phrase) where longer is null or 100::hugeint * longer < 80::hugeint * b.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) rank from kept)
select lang, rank, phrase, a, l, r, n, score::bigint score from ranked join total using (lang) where rank <= 2000""",
    "op9_cover_tree": """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings),
link as (select a.vec_id x, b.vec_id y from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
reach(id, other) as (select x, y from link union select r.id, l.y from reach r join link l on r.other = l.x),
least as (select id, min(other) m from reach group by id), n as (select x, count(*) n from link group by x)
select vec_id, coalesce(n, 0) n_links, least(vec_id, coalesce(m, vec_id)) component_id, coalesce(m, vec_id) >= vec_id kept from v left join n on x = vec_id left join least on id = vec_id""",
}
