"""The queries of this subpackage: each applies one operator to its whole table; and DuckDB SQL for some."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embedding_dedup, language_id, mixing, near_dedup, quality, quotations, substring_dedup, token_counts, toxicity
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op3_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link(table(spark, sf_dir, "conversations"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "block", F.array_join("shards", ",").alias("shards"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "contaminated", "item_ids", "spans", "equal")


def op8_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    found = (
        op1_toxicity, op2_token_counts, op3_quotations, op4_substring_dedup, op5_near_duplicates, op6_mixing,
        op7_decontamination, op8_embedding_duplicates, op9_language_id, op10_quality,
    )
    return {f.__name__: f for f in found}


#: Words are cut and windows grouped by DuckDB; sha256 gives lowercase hex.
OP4 = r"""
with d as (select doc_id, coalesce(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) as w from documents),
s as (select doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) as p from d),
h as (select doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) as h from s),
m as (select h, min(doc_id) as first from h group by h having min(doc_id) < max(doc_id)),
g as (select distinct h.doc_id, unnest(range(p, p + 50)) as pos from h join m using (h) where h.doc_id > m.first),
c as (select doc_id, list(pos) as gone from g group by doc_id),
k as (select d.doc_id, len(w) as n_words, coalesce(len(gone), 0) as n_removed,
        case when gone is null then w else list_filter(list_transform(range(1, len(w) + 1), lambda i: case when list_contains(gone, i) then null else w[i] end), lambda x: x is not null) end as kept
      from d left join c using (doc_id))
select doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k
"""


#: Targets by water filling; block quotas; the splitting tree level by level and source by source; the units that shards draw.
OP6 = r"""
with recursive d as (select doc_id, case when source is null then '1' else '0' || source end as k, md5('mix-2:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as h,
        len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as size from documents),
p as (select k, count(*) as n, sum(size)::bigint as source_size, row_number() over (order by k) - 1 as num from d group by k),
w as (select *, case num % 3 when 0 then 5 when 1 then 2 else 1 end as w, 3 * source_size as most from p),
l as (select *, (sum(source_size) over ())::bigint - coalesce(sum(most) over (order by most / w, num rows between unbounded preceding and 1 preceding), 0)::bigint as rest,
        (sum(w) over (order by most / w, num rows between current row and unbounded following))::bigint as open_w from w),
f as (select most / w as ratio, num, rest::double / open_w as level from l where rest * w <= most * open_w order by 1, 2 limit 1),
t as (select l.*, case when f.level is null or l.most / l.w < f.ratio or (l.most / l.w = f.ratio and l.num < f.num) then l.most::double else f.level * l.w end as target
      from l left join f on true),
u as (select k, num, source_size, target, case when source_size > 0 then floor(target + 0.5)::bigint // source_size else 0 end as passes,
        floor(target + 0.5)::bigint - (case when source_size > 0 then floor(target + 0.5)::bigint // source_size else 0 end) * source_size as extra,
        ceil(n / 512)::bigint as blocks from t),
e as (select doc_id, k, h, size, ('0x' || substr(h, 1, 12))::bigint % blocks as block from d join u using (k)),
b as (select k, block, coalesce(sum(sum(size)) over (partition by k order by block rows between unbounded preceding and 1 preceding), 0)::bigint as before from e group by k, block),
g as (select k, max(block) as edge, max_by(extra - before, block) as missing from b join u using (k) where before < extra group by k),
s as (select u.*, coalesce(edge, -1) as edge, coalesce(missing, 0) as missing from u left join g using (k)),
o as (select k, case when size * 32 > missing then size else 0 end as late, h, sum(size)::bigint as n, any_value(missing) as missing from e join s using (k) where block = edge group by 1, 2, 3),
c as (select k, late, h from o qualify 2 * coalesce(sum(n) over (partition by k order by late, h rows between unbounded preceding and 1 preceding), 0) + n <= 2 * missing),
x as (select k, max({'late': late, 'h': h}) as cut from c group by k),
q as (select array_agg(passes * blocks + edge + 1 order by num)::bigint[] as q, count(*) as sources from s),
z as (select greatest(4, case when sum(source_size) < 4000000 then 0 else floor(log2(sum(source_size) // 4000000))::int + 1 end) as levels from p),
tree(level, j, node, units, begins, rest, draws, got) as (
  select 0, 0, 0::bigint, q, list_transform(q, lambda a: 0::bigint), null::bigint, null::bigint, []::bigint[] from q where sources > 0
  union all
  select case when y.i = 2 then level else level + 1 end, case when y.i = 2 then j + 1 else 0 end, case when y.i = 2 then node else 2 * node + y.i end,
    case y.i when 2 then units when 0 then got else list_transform(list_zip(units, got), lambda a: a[1] - a[2]) end,
    case y.i when 1 then list_transform(list_zip(begins, got), lambda a: a[1] + a[2]) else begins end,
    case when y.i = 2 then r - m end, case when y.i = 2 then a - v end, case when y.i = 2 then list_append(got, v) else []::bigint[] end
  from (select *, case when m <= 0 or a <= 0 then 0 when a >= r then m else
            low + len(list_filter(list_transform(range(1, len(ps) + 1), lambda i: list_sum(ps[1:i])), lambda y: y < list_sum(ps) * uu)) end as v
    from (select *, list_transform(list_transform(range(low, high + 1), lambda y: -lgamma(y + 1) - lgamma(m - y + 1) - lgamma(a - y + 1) - lgamma(r - m - a + y + 1)), lambda y: exp(y - mid)) as ps
      from (select *, -lgamma(mode + 1) - lgamma(m - mode + 1) - lgamma(a - mode + 1) - lgamma(r - m - a + mode + 1) as mid
        from (select *, least(high, greatest(low, floor((a + 1.0::double) * (m + 1) / (r + 2))::bigint)) as mode
          from (select *, greatest(0, a - (r - m), floor(mean - 9 * sd - 9)::bigint) as low, least(m, a, ceil(mean + 9 * sd + 9)::bigint) as high
            from (select *, case when r > 0 then sqrt(greatest(0.0::double, mean * (1 - m::double / r) * (r - a)::double / greatest(r - 1, 1))) else 0 end as sd
              from (select *, case when r > 0 then a::double * m / r else 0 end as mean
                from (select tree.*, levels, sources, coalesce(tree.units[j + 1], 0) as m, coalesce(rest, list_sum(tree.units)::bigint) as r,
                        coalesce(draws, list_sum(tree.units)::bigint // 2 + case when list_sum(tree.units)::bigint % 2 = 1 and (('0x' || substr(md5('mix-2:' || level || ':' || node), 1, 12))::bigint::double + 0.5) / 281474976710656 < 0.5 then 1 else 0 end) as a,
                        (('0x' || substr(md5('mix-2:' || level || ':' || node || ':' || j), 1, 12))::bigint::double + 0.5) / 281474976710656 as uu
                      from tree, z, q where level < levels))))))))
    join (values (0), (1), (2)) y(i) on (y.i = 2) = (j < sources)),
v as (select node as shard, num, blocks, k, unnest(range(begins[num + 1], begins[num + 1] + tree.units[num + 1])) as unit from tree, z, s where level = levels),
n as (select k, unit % blocks as block, array_agg(shard order by unit) as shards from v group by k, unit % blocks),
m as (select e.*, source_size, target, case when block = edge and not coalesce({'late': case when size * 32 > missing then size else 0 end, 'h': h} <= cut, false) then 1 else 0 end as less, coalesce(shards, []) as shards
      from e join s using (k) left join x using (k) left join n using (k, block))
select doc_id, size, source_size, target, (size * (len(shards) - less))::bigint as taken, block, array_to_string(shards[1:len(shards) - less], ',') as shards from m
"""


def oracle_sql() -> dict:
    return {"op4_substring_dedup": OP4, "op6_mixing": OP6}
