"""URL verdicts: host and path rules first, then a tree of path templates judged by labelled purity.

DataFrame functions only: no Python on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import stored

#: (verdict, rule): a rule is a host and the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A branch of a path template stays apart if it has so many labelled pages, and its labelled share differs
#: from its siblings' by so many standard errors.
MIN_LABELS, MERGE_Z = 5, 3.0
#: Levels that the SQL writes out; the operator itself goes on until no path has a further segment.
SQL_LEVELS = 8
PRIOR_WEIGHT = 10.0
REJECT_AT = 0.5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits (host itself or a subdomain, path by its start), or null."""
    choice = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later, longer ones win
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + start))
        choice = F.when(fits, F.lit(rule)).otherwise(choice)
    return choice


def _tree(paths: DataFrame, min_labels: int, merge_z: float) -> DataFrame:
    """Add ``template`` to (host, segments, n, labelled, bad): one pass of sums and one join a level.

    A child stays a branch if it has ``min_labels`` labelled pages and its labelled share differs from its
    siblings' by ``merge_z`` standard errors or more; all children that do not differ merge into the
    wildcard ``*``. Paths leave the loop with their last segment, so deep levels cost what deep paths cost.
    """
    deepest = paths.agg(F.max(F.size("segments")).alias("d")).first()["d"] or 0
    work = paths.withColumn("template", F.lit(""))
    done = work.filter(F.size("segments") == 0)
    for level in range(deepest):
        segment = F.get("segments", F.lit(level))
        work = work.filter(F.size("segments") > level)
        children = work.groupBy("host", "template", segment.alias("segment")).agg(*[F.sum(c).alias(c) for c in ("labelled", "bad")])
        parents = children.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in ("labelled", "bad")])
        both = children.filter(F.col("labelled") >= min_labels).join(parents, ["host", "template"])
        rest_n, rest_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        pooled = F.try_divide("all_bad", "all_labelled")
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), "labelled") + F.try_divide(F.lit(1), rest_n)))
        gap = F.abs(F.try_divide("bad", "labelled") - F.try_divide(rest_bad, rest_n))
        kept = both.filter((rest_n > 0) & (error > 0) & (gap >= F.lit(merge_z) * error))
        kept = kept.select(F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("segment").alias("_s"))
        joined = work.withColumn("_seg", segment).join(
            kept, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & (F.col("_seg") == F.col("_s")), "left"
        )
        grown = joined.withColumn("template", F.concat("template", F.lit("/"), F.coalesce("_s", F.lit("*"))))
        work = stored(grown.drop("_seg", "_h", "_t", "_s"))
        done = done.unionByName(work.filter(F.size("segments") == level + 1))
    return done


def judge(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, min_labels: int = MIN_LABELS,
    merge_z: float = MERGE_Z, prior_weight: float = PRIOR_WEIGHT, reject_at: float = REJECT_AT,
) -> DataFrame:
    """(page_id, host, path, rule, template, verdict) of every page.

    ``pages`` has page_id and url, ``labels`` has page_id and bad (0 or 1). The longest rule that
    fits decides; elsewhere the page's path template does: block if the bad share of its
    labelled pages, smoothed by ``prior_weight`` pages of the overall share, reaches
    ``reject_at``. Templates are as deep as their paths. A null url, or one without
    ``://``, has empty host and path and the template of that empty host. A page with several
    labels is bad if any says so; null labels do not count; a label without a page does nothing.
    Repeated rows stay. Extra columns are ignored. Empty tables are fine: without labels nothing
    is blocked but by rules.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    marks = labels.filter("page_id is not null and bad is not null").groupBy(F.col("page_id").cast("long").alias("_page"))
    marks = marks.agg(F.max(F.col("bad").cast("long")).alias("_bad"))
    rows = rows.join(marks, F.col("page_id") == F.col("_page"), "left").drop("_page")
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = stored(rows.withColumn("segments", segments))
    paths = rows.groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("n"), F.count("_bad").alias("labelled"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad")
    )
    shaped = _tree(paths, min_labels, merge_z)
    totals = shaped.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    overall = totals.agg(F.try_divide(F.sum("bad"), F.sum("labelled")).alias("prior"))
    purity = (F.col("bad") + F.lit(prior_weight) * F.coalesce("prior", F.lit(0.0))) / (F.col("labelled") + F.lit(prior_weight))
    verdicts = totals.join(F.broadcast(overall)).select("host", "template", (purity >= F.lit(reject_at)).alias("_reject"))
    judged = shaped.select("host", "segments", "template").join(verdicts, ["host", "template"])
    out = rows.join(judged, ["host", "segments"]).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    by_rule = F.create_map(*[F.lit(x) for verdict, rule in rules for x in (rule, verdict)]) if rules else None
    own = F.when(F.col("_reject"), "block").otherwise("allow")
    verdict = F.coalesce(F.element_at(by_rule, F.col("rule")), own) if rules else own
    return out.select("page_id", "host", "path", "rule", "template", verdict.alias("verdict"))


def sql(
    rules: Sequence[tuple[str, str]] = RULES, levels: int = SQL_LEVELS, min_labels: int = MIN_LABELS, merge_z: float = MERGE_Z,
    prior_weight: float = PRIOR_WEIGHT, reject_at: float = REJECT_AT,
) -> str:
    """The same in SQL, over tables ``pages`` and ``labels`` (doc_id, quality): a page shows the
    document numbered in its path, and quality 0 is bad. Right for paths of at most ``levels`` segments."""
    cases = "\n".join(
        f"when (r.host = '{r.partition('/')[0]}' or r.host like '%.{r.partition('/')[0]}') and starts_with(path, '/{r.partition('/')[2]}') then '{r}'"
        for _, r in sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    )
    verdicts = "\n".join(f"when rule = '{r}' then '{v}'" for v, r in rules)
    steps = []
    for k in range(levels):
        steps.append(f"""
c{k} as (select host, template, segments[{k + 1}] seg, sum(labelled) labelled, sum(bad) bad from w{k} where len(segments) > {k} group by all),
p{k} as (select host, template, sum(labelled) all_labelled, sum(bad) all_bad from c{k} group by all),
k{k} as (select c.host, c.template, c.seg from c{k} c join p{k} p on c.host = p.host and c.template = p.template
  where c.labelled >= {min_labels} and p.all_labelled > c.labelled and p.all_bad > 0 and p.all_bad < p.all_labelled
  and abs(c.bad::double / c.labelled::double - (p.all_bad - c.bad)::double / (p.all_labelled - c.labelled)::double) >= {merge_z!r}::double * sqrt(
  (p.all_bad::double / p.all_labelled::double) * (1 - p.all_bad::double / p.all_labelled::double) * (1 / c.labelled::double + 1 / (p.all_labelled - c.labelled)::double))),
w{k + 1} as (select w.host, w.segments, w.n, w.labelled, w.bad,
  case when len(w.segments) > {k} then w.template || '/' || coalesce(k.seg, '*') else w.template end as template
  from w{k} w left join k{k} k on w.host = k.host and w.template = k.template and w.segments[{k + 1}] = k.seg)""")
    return f"""
with parts as (
  select page_id, case when url like '%://%' then translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') else '' end as host,
    case when url like '%://%' then regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) else '' end as path from pages),
marks as (select doc_id, max(case when quality = 0 then 1 else 0 end) bad from labels where quality is not null and doc_id is not null group by 1),
r as (select p.page_id, host, path, list_filter(string_split(path, '/'), lambda s: s <> '') segments, m.bad
  from parts p left join marks m on m.doc_id = try_cast(regexp_extract(path, '/([0-9]+)', 1) as bigint)),
w0 as (select host, segments, count(*) n, count(bad) labelled, coalesce(sum(bad), 0) bad, '' as template from r group by host, segments),
{",".join(steps)},
shaped as (select host, segments, labelled, bad, template from w{levels}),
totals as (select host, template, sum(labelled) labelled, sum(bad) bad from shaped group by all),
verdicts as (select host, template, (bad + {prior_weight!r}::double * coalesce((select sum(bad)::double / sum(labelled)::double from totals), 0)) / (labelled + {prior_weight!r}::double) >= {reject_at!r}::double reject from totals),
o as (select page_id, r.host as host, path, case {cases} end as rule, s.template, reject
  from r join shaped s on r.host = s.host and r.segments = s.segments join verdicts v on v.host = s.host and v.template = s.template)
select page_id, host, path, rule, template, case {verdicts} when reject then 'block' else 'allow' end as verdict from o"""
