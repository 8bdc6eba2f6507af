"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, tokenizer_path
from tessera.llm.decontaminate import contamination
from tessera.llm.fingerprints import fingerprint_documents
from tessera.llm.jaccard import similar_documents
from tessera.llm.neighbours import top_k
from tessera.llm.packing import pack_documents
from tessera.llm import lines, mixing, negatives, quality, resampling, warc
from tessera.llm.suffixes import remove_repeats
from tessera.llm.sharding import shard_documents

ORACLE_SQL: dict[str, str] = {}

#: The vocabulary file of the packing query.
TOKENIZER = "word_bpe_49k.json"
#: Word parts that a worker of that query keeps in each of two generations; the pipeline, with more in memory, keeps fewer.
WORDS_KEPT = 450_000


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLE_SQL["op1_warc"] = """
with p as (
  select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes,
         sha256(encode(coalesce(html, ''))) as payload_digest
  from pages),
f as (
  select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first
  from p)
select page_id, payload_bytes, payload_digest,
       case when page_id > first then 'revisit' else 'response' end as record_type,
       case when page_id > first then first end as refers_to
from f
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


ORACLE_SQL["op3_suffix_dedup"] = """
with d as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n from documents),
g as (select doc_id, unnest(range(1, n - 48)) as p, b from d where n >= 50),
w as (select doc_id, p, min(doc_id) over (partition by b[p:p + 49]) as first from g),
h as (select doc_id, p, lead(p) over o as later, lag(p) over o as earlier from w where doc_id > first window o as (partition by doc_id order by p)),
r as (
  select doc_id, sum(least(coalesce(later - p, 50), 50)) as gone, count(*) filter (where earlier is null or p - earlier > 50) as spans
  from h group by doc_id),
c as (  -- what stays before each run, and after the last
  select doc_id, p as upto, coalesce(earlier + 50, 1) as since from h where earlier is null or p - earlier > 50
  union all select doc_id, n + 1, coalesce(last + 50, 1) from d left join (select doc_id, max(p) as last from h group by doc_id) using (doc_id)),
k as (
  select doc_id, string_agg(case when upto > since then hex(b[since:upto - 1]) else '' end, '' order by since) as kept
  from c join d using (doc_id) group by doc_id)
select d.doc_id, d.n as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(kept)) as kept_sha256
from d join k using (doc_id) left join r using (doc_id)
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), keep=WORDS_KEPT)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


ORACLE_SQL["op5_jaccard_join"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as shingle
  from w where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
e as (select a, b from l union all select b, a from l),
r as (select a as node, b as other from e union select r.node, e.b from r join e on r.other = e.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(min(r.other), d.doc_id)) as component_id
from documents d left join n on n.doc_id = d.doc_id left join r on r.node = d.doc_id
group by d.doc_id, n.n
"""


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op9_top_k"] = """
with v as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (
  select q.n, q.vec_id as query_id, c.vec_id,
         cast(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda t: t[1] * t[2])), 0) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and c.n <> q.n),
r as (select *, cast(row_number() over (partition by n order by score desc, vec_id) as int) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 20
"""


#: Shares of tokens that the mixing query aims at.
MIX = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = mixing.language_labels(docs, table(spark, sf_dir, "labels"))
    mix = mixing.solve(docs, mixing.learn(docs, known), MIX, low=0.0, high=float("inf"))
    by_domain = lambda v: F.create_map(*[F.lit(x) for d, t in zip(mix.domains.names, v) for x in (d, float(t))])[F.col("domain")]
    found = mixing.rates(docs.select("doc_id", "text"), mix)
    totals = [by_domain(mix.targets).alias("target_tokens"), by_domain(mix.reached).alias("reached_tokens")]
    return found.select("doc_id", "n_tokens", "domain", "rate", "copies", *totals)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = lines.without_repeats(docs, digest=True)
    return cut.select("doc_id", "n_lines", "n_removed", "n_runs", F.col("text").alias("kept_sha256"))


ORACLE_SQL["op10_line_dedup"] = r"""
with d as (select doc_id, coalesce(text, '') as text from documents where doc_id is not null),
l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos from d),
h as (
  select doc_id, pos, line, row_number() over (partition by doc_id order by pos) as i, len(regexp_extract_all(line, '[^\t\n\x0B\f\r ]+')) as words
  from l where regexp_matches(line, '[^\t\n\x0B\f\r ]')),
r as (
  select *, lead(line, 1) over w as l1, lead(line, 2) over w as l2, lead(words, 1) over w as words1
  from h window w as (partition by doc_id order by i)),
s as (
  select doc_id, i, pos, line,
         words >= 5 and row_number() over (partition by line order by doc_id, i) > 1 as run1,
         l1 is not null and words + words1 >= 5 and row_number() over (partition by line, l1 order by doc_id, i) > 1 as run2,
         l2 is not null and row_number() over (partition by line, l1, l2 order by doc_id, i) > 1 as run3
  from r),
g as (
  select *, run1 or run2 or run3 or coalesce(lag(run2 or run3, 1) over w, false) or coalesce(lag(run3, 2) over w, false) as gone
  from s window w as (partition by doc_id order by i)),
e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as starts from g),
c as (
  select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed, count(*) filter (where starts) as n_runs
  from e group by doc_id),
t as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.pos) as text
  from l left join e on l.doc_id = e.doc_id and l.pos = e.pos
  where not coalesce(e.gone, false) group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(n_runs, 0) as n_runs,
       sha256(encode(coalesce(t.text, ''))) as kept_sha256
from d left join c on d.doc_id = c.doc_id left join t on d.doc_id = t.doc_id
"""


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op11_decontamination"] = r"""
with d0 as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select coalesce(cast(item_id as varchar), '') as item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
x as (  -- windows by length
  select distinct item, least(len(w), 10) as size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) as win
  from b where len(w) > 0),
sizes as (select distinct size from x),
dw as (
  select r, size, unnest(range(1, len(w) - size + 2)) as p, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) as win
  from d0, sizes where len(w) >= size),
o as (select r, p, x.size, item from dw join x on dw.win = x.win and dw.size = x.size),
h as (select r, count(*) as n_hit from (select distinct r, unnest(range(p, p + size)) as q from o) group by r),
i as (select r, count(distinct item) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from o) group by r),
t as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d0),
f as (select word, count(*) as n from t group by word),
k as (  -- the five rarest words of each text
  select distinct w, word from (
    select w, word, row_number() over (partition by w order by n, word) as nth from (select distinct w, unnest(w) as word from b) join f using (word))
  where nth <= 5),
ks as (select *, count(*) over (partition by w) as size from k),
g as (select k.w, k.size, t.r, t.p, t.word from ks k join t using (word)),
c as (  -- words of the text in the 20 words from each of them on
  select a.w, a.r, a.size, a.p from g a join g z on a.w = z.w and a.r = z.r and z.p between a.p and a.p + 19
  group by all having count(distinct z.word) = a.size),
n as (select r, count(distinct item) as n_near from c join b using (w) group by r)
select d0.doc_id, cast(len(d0.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0) as n_near
from d0 left join h using (r) left join i using (r) left join n using (r)
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLE_SQL["op12_hard_negatives"] = """
with v as (
  select row_number() over () as n, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (
  select a.n, a.vec_id as anchor_id, a.label as own, c.vec_id, c.label,
         cast(coalesce(list_sum(list_transform(list_zip(a.e, c.e), lambda t: t[1] * t[2])), 0) as bigint) as score
  from v a join v c on a.vec_id % 100 = 0 and c.n <> a.n),
s as (
  select n, anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by n order by score desc, vec_id nulls last) as nth
  from p where label = own),
r as (
  select s.n, nth, s.anchor_id, positive_id, positive_score, p.vec_id as negative_id, p.score as negative_score,
         cast(row_number() over (partition by s.n, nth order by p.score desc, p.vec_id nulls last) as int) as rank
  from s join p on s.n = p.n and p.label <> p.own and 30 * positive_score <= 100 * p.score and 100 * p.score <= 90 * positive_score
  where nth <= 5)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from r where rank <= 10
"""


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op13_resampling"] = r"""
with w as (
  select 'd' as kind, row_number() over () as r, doc_id, text from documents union all select 'b', row_number() over (), null, text from benchmark),
t as (
  select kind, r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from w),
f as (
  select kind, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as feature from t where len(w) > 0),
u as (select distinct feature, hex(encode(feature)) as x from f),
bits as (  -- of each byte the lower half first, of each half the lowest bit
  select feature, list_transform(range(0, 4 * len(x)), lambda j:
    ((instr('0123456789ABCDEF', x[(j // 4) + (case when (j // 4) % 2 = 0 then 2 else 0 end)]) - 1) >> (j % 4)) & 1) as bits
  from u),
c as (
  select feature, xor(list_reduce(list_concat([4294967295], bits), lambda c, b: xor(c >> 1, xor(c & 1, b) * 3988292384)), 4294967295) % 10000 as bucket
  from bits),
n as (select bucket, count(*) filter (where kind = 'd') as s, count(*) filter (where kind = 'b') as t from f join c using (feature) group by bucket),
g as (
  select bucket, floor(1000 * ln(cast((t + 1) * ((select sum(s) from n) + 10000) as double) / cast((s + 1) * ((select sum(t) from n) + 10000) as double))) as gain
  from n),
m as (select r, count(*) as n_features, cast(floor(sum(gain) / count(*)) as bigint) as weight from f join c using (feature) join g using (bucket) where kind = 'd' group by r),
h as (select r, doc_id, len(w) as n_words, cast('0x' || sha256('7:' || coalesce(cast(doc_id as varchar), ''))[1:8] as bigint) as h from t where kind = 'd'),
e as (
  select h.r, doc_id, n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) as bigint) as score
  from h left join m using (r)),
k as (select r, row_number() over (order by score desc, doc_id nulls last) as rank, count(*) over () as n from e where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= 25 * n // 100 then rank end as rank from e left join k using (r)
"""
