"""The numbered operators bound to the tables with production parameters, and SQL where it can say the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.llm import collocations, decontamination, edit_embedding, language_crf, minhash, mixing, quality_trees, resampling, ring_sharding, simhash, suffix_dedup, token_counts, url_filters
from tripweave.llm.common import crc32_of_id, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query()
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query(url_filters.sql())
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    shown = F.regexp_extract(url_filters.path_of(F.col("url")), "/([0-9]+)", 1)
    marks = table(spark, sf_dir, "labels").filter("quality is not null").select(F.col("doc_id").alias("_doc"), (F.col("quality") == 0).cast("int").alias("bad"))
    numbered = pages.select("page_id", shown.try_cast("bigint").alias("_n"))
    labels = numbered.join(marks, F.col("_n") == F.col("_doc")).select("page_id", "bad")
    return url_filters.judge(pages, labels)


@query()
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


@query()
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.tokens_by_section(table(spark, sf_dir, "documents"))


@query()
def op6_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = crc32_of_id(F.col("doc_id")) % 4
    model = language_crf.fit(docs, rest != 2)
    return language_crf.predict(docs, model, [F.coalesce(rest == 2, F.lit(False)).alias("held_out")])


MIX_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '')) as k from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from sized group by source),
w as (select source, source_size, place, case place % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 2 * source_size as lim from s),
l as (select *, coalesce(sum(lim) over o, 0) as lim0, coalesce(sum(weight) over o, 0) as w0, lim::double / weight::double as ratio, sum(weight) over () as wall, sum(source_size) over () * 1.5::double as words
  from w window o as (order by lim::double / weight::double, place rows between unbounded preceding and 1 preceding)),
v as (select *, (words - lim0::double) / (wall - w0)::double as level from l),
lv as (select arg_min(level, place_order) as level from (select level, row_number() over (order by ratio, place) as place_order from v where ratio >= level)),
t as (select source, source_size, least(lim::double, coalesce(lv.level * weight, lim::double)) as target from v cross join lv),
b as (select d.*, t.source_size, t.target, round(t.target)::bigint as budget,
  coalesce(sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from sized d join t on d.source is not distinct from t.source),
e as (select *, case when source_size > 0 then budget // greatest(source_size, 1) else 0 end as epochs from b)
select doc_id, source, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::bigint as taken from e"""


@query(MIX_SQL)
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query()
def op8_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring_sharding.assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def quality_model(spark: SparkSession, sf_dir: str) -> quality_trees.Trees:
    """Trees fitted on labels of documents whose CRC-32 of the id is not divisible by 5."""
    learn = crc32_of_id(F.col("doc_id")) % 5 != 0
    return quality_trees.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn)


@query()
def op9_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = quality_trees.scorer(quality_model(spark, sf_dir))
    held_out = F.coalesce(crc32_of_id(F.col("doc_id")) % 5 == 0, F.lit(False))
    scored = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality_trees.THRESHOLD).cast("int"))


@query()
def op10_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.edit_table(table(spark, sf_dir, "documents"))


PHRASE_SQL = r"""
with t as (select row_number() over () as d, coalesce(lang, 'und') as lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, d, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from t),
q as (select lang, row_number() over () as p, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
w as (select lang, p, unnest(w) as w1, unnest(range(1, len(w) + 1)) as i from q),
o as (select lang, w1, lead(w1) over (partition by p order by i) as w2, lead(w1, 2) over (partition by p order by i) as w3 from w),
f1 as (select lang, w1, count(*) as f from o group by lang, w1),
f2 as (select lang, w1, w2, count(*) as f from o where w2 is not null group by lang, w1, w2 having count(*) >= 10),
f3 as (select lang, w1, w2, w3, count(*) as f from o where w3 is not null group by lang, w1, w2, w3 having count(*) >= 10),
n as (select lang, sum(f)::bigint as n from f1 group by lang),
held as (select lang, w1, w2, max(f) as m from (select lang, w1, w2, f from f3 union all select lang, w2, w3, f from f3) group by lang, w1, w2),
c2 as (
  select f2.lang, f2.w1 || ' ' || f2.w2 as phrase, f2.f as a, 1 as cut, x.f as l, y.f as r
  from f2 join f1 x on x.lang = f2.lang and x.w1 = f2.w1 join f1 y on y.lang = f2.lang and y.w1 = f2.w2
  left join held on held.lang = f2.lang and held.w1 = f2.w1 and held.w2 = f2.w2 where m is null or 100 * m < 50 * f2.f),
c3 as (
  select f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 as phrase, f3.f as a, 1 as cut, x.f as l, y.f as r
  from f3 join f1 x on x.lang = f3.lang and x.w1 = f3.w1 join f2 y on y.lang = f3.lang and y.w1 = f3.w2 and y.w2 = f3.w3
  union all
  select f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 2, x.f, y.f
  from f3 join f2 x on x.lang = f3.lang and x.w1 = f3.w1 and x.w2 = f3.w2 join f1 y on y.lang = f3.lang and y.w1 = f3.w3),
cuts as (select *, (1000000::hugeint * a * a) // (l::hugeint * r) as score from (select * from c2 union all select * from c3)),
lowest as (select *, row_number() over (partition by lang, phrase order by score, cut) as nth from cuts),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest where nth = 1)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join n using (lang) where rank <= 2000"""


@query(PHRASE_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


#: CRC-32 byte by byte and bit by bit, as DuckDB has no function for it.
RESAMPLE_SQL = r"""
with w as (
  select doc_id, row_number() over () as d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark),
o as (select d, unnest(w) as word from w),
words as (select distinct word from (select word from o union all select word from b)),
h as (select word, hex(word) as hex from words),
c as (select word, (xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len(hex) // 2), lambda i: ('0x' || hex[2 * i + 1:2 * i + 2])::bigint)),
    lambda x, y: list_reduce(list_prepend(xor(x, y), range(0, 8)), lambda u, v: xor(u >> 1, 3988292384 * (u & 1))))) % 10000)::bigint as bucket from h),
s as (select bucket, count(*) as s from o join c using (word) group by bucket),
t as (select bucket, count(*) as t from b join c using (word) group by bucket),
z as (select (select count(*) from o) as ss, (select count(*) from b) as tt),
g as (select bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * (ss + 10000)::double) / ((coalesce(s, 0) + 1)::double * (tt + 10000)::double)))::bigint as gain
  from s full join t using (bucket) cross join z),
m as (select d, sum(gain) as total from o join c using (word) join g using (bucket) group by d),
x as (select w.doc_id, w.d, len(w.w)::bigint as n_features, coalesce(floor(total::double / len(w.w)::double), 0)::bigint as weight,
  ('0x' || sha256('2024:' || coalesce(w.doc_id::varchar, ''))[1:8])::bigint as h from w left join m using (d)),
y as (select *, weight + floor(-1000.0::double * ln(-ln((h + 0.5)::double / 4294967296.0::double)))::bigint as score from x),
r as (select d, row_number() over (order by score desc, doc_id nulls last, n_features, d) as rank from y where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= (select count(*) from r) * 10 // 100 then rank end as rank from y left join r using (d)"""


@query(RESAMPLE_SQL)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


NEAR_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as grams from d),
s as (select grams, min(doc_id) as node, len(grams) as n from g where len(grams) > 0 group by grams),
m as (select node, n, unnest(grams) as gram from s),
e as (select a.node as a, b.node as b from m a join m b on a.gram = b.gram and a.node < b.node
    group by a.node, b.node, a.n, b.n having 185 * count(*) >= 85 * (a.n + b.n)),
pairs as (select a, b from e union all select b, a from e),
r(node, seen) as (select node, node from s union select r.node, pairs.b from r join pairs on r.seen = pairs.a),
c as (select node, min(seen) as root from r group by node)
select g.doc_id, len(g.grams)::bigint as n_shingles, coalesce(c.root, g.doc_id) as component_id, g.doc_id = coalesce(c.root, g.doc_id) as kept
from g left join s on g.grams = s.grams left join c on s.node = c.node"""


@query(NEAR_SQL)
def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))
