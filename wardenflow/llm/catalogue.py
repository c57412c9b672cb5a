"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenflow.llm.common import documents
from wardenflow.llm.exact_dedup import exact_dedup
from wardenflow.llm.hard_negatives import hard_negatives
from wardenflow.llm.importance import STEP, importance
from wardenflow.llm.language_id import identify
from wardenflow.llm.line_dedup import dedup_lines
from wardenflow.llm.lm_score import score
from wardenflow.llm.mixing import mix
from wardenflow.llm.packing import packed
from wardenflow.llm.pii import find_personal_data
from wardenflow.llm.secrets import find_secrets
from wardenflow.llm.simhash_dedup import near_groups
from wardenflow.llm.token_files import written_tokens
from wardenflow.llm.winnowing import edited_fingerprints


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP1_SQL = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = min(doc_id) over g as kept, text_sha256
from t window g as (partition by text_sha256)
"""

def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), size=1024)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), fill=False).drop("row")  # three fillers, as its SQL says


OP8_SQL = r"""
with sizes as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents
), by_source as (
    select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as turn from sizes group by source
), weighed as (
    select source, source_size, cast(case turn % 3 when 0 then 5 when 1 then 2 else 1 end as double) as weight, cast(3 as double) * source_size as cap from by_source
), ordered as (
    select *, cast(sum(source_size) over () as double) as total,
        coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as capped_before,
        sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as weight_left
    from weighed
), flagged as (
    select *, (total - capped_before) * weight > cap * weight_left as capped from ordered
), goals as (
    select source, source_size, case when capped then cap else
        (total - coalesce(sum(case when capped then cap end) over (), 0)) * weight / sum(case when not capped then weight end) over () end as target
    from flagged
), rows_ as (
    select doc_id, size, g.source, source_size, target,
        case when source_size > 0 then target / source_size else 0 end as ratio,
        (cast(('0x' || substr(md5('7:' || coalesce(cast(doc_id as varchar), '')), 1, 13)) as bigint) + cast(0.5 as double)) / cast(4503599627370496 as double) as u
    from sizes s join goals g on s.source is not distinct from g.source
), ranked as (
    select *, floor(ratio) as whole, ratio - floor(ratio) as probability, target - floor(ratio) * source_size as wanted,
        case when ratio - floor(ratio) > 0 then (u / (1 - u)) / ((ratio - floor(ratio)) / (1 - (ratio - floor(ratio)))) end as q
    from rows_
), placed as (
    select *, coalesce(sum(size) over (partition by source order by q nulls last, doc_id nulls last rows between unbounded preceding and 1 preceding), 0) as ahead from ranked
), first_places as (
    select doc_id, source, size, source_size, target, whole, q, wanted, coalesce(q is not null and ahead + size <= wanted, false) as chosen from placed
), filled0 as (
    select * from first_places
){fillers}
select doc_id, size, source_size, target, cast(whole as bigint) + cast(chosen as bigint) as copies,
    (cast(whole as bigint) + cast(chosen as bigint)) * size as taken
from filled3
"""
FILLER_SQL = """, gaps{k} as (
    select *, wanted - sum(case when chosen then size else 0 end) over (partition by source) as gap from filled{j}
), may{k} as (
    select *, not chosen and q is not null and size > 0 and size <= gap as may from gaps{k}
), filled{k} as (
    select doc_id, source, size, source_size, target, whole, q, wanted,
        chosen or (may and row_number() over (partition by source, may order by size desc, q, doc_id nulls last) = 1) as chosen from may{k}
)"""
OP8_SQL = OP8_SQL.replace("{fillers}", "".join(FILLER_SQL.format(j=k - 1, k=k) for k in (1, 2, 3)))



def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=25).drop("digest")


# DuckDB has no crc32: it is reduced over the half bytes of each different feature, low half first.
OP11_SQL = r"""
with texts as (
    select text, count(*) as copies, 'd' as side from documents group by text union all select text, count(*), 't' from benchmark group by text
), worded as (
    select side, text, copies, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
    from texts
), runs as (
    select side, text, copies, len(words) as n_words, words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) as features from worded
), uses as (
    select side, text, copies, feature, count(*) as n from (select side, text, copies, unnest(features) as feature from runs) group by all
), hexed as (
    select feature, hex(encode(feature)) as h from (select distinct feature from uses)
), hashed as (
    select feature, xor(list_reduce(
        list_prepend(4294967295::bigint, list_transform(range(0, len(h)), lambda i: ('0x' || substr(h, (i + 1 - 2 * (i % 2) + 1)::int, 1))::bigint)),
        lambda c, x: xor(c >> 4, ([{half_bytes}]::bigint[])[((xor(c, x)) & 15) + 1])), 4294967295::bigint) % 10000 as bucket
    from hexed
), used as (
    select side, text, copies, n, bucket from uses join hashed using (feature)
), counts as (
    select bucket, coalesce(sum(case when side = 'd' then n * copies end), 0) as s, coalesce(sum(case when side = 't' then n * copies end), 0) as t from used group by bucket
), totals as (
    select sum(s)::double as big_s, sum(t)::double as big_t from counts
), gains as (
    select bucket, floor(1000 * ln((t::double + 1) * (big_s + 10000) / ((s::double + 1) * (big_t + 10000)))) as gain from counts, totals
), weighed as (
    select text, floor(sum(n * gain) / sum(n))::bigint as weight from used join gains using (bucket) where side = 'd' group by text
), scored as (
    select doc_id, greatest(0, 2 * n_words - 1)::bigint as n_features, coalesce(weight, 0) as weight, n_words,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
    from documents d join runs r on r.side = 'd' and d.text is not distinct from r.text left join weighed w on w.text is not distinct from d.text
), placed as (
    select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last) as place, count(*) over (partition by n_words >= 20) as eligible from scored
)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 25 * eligible // 100 then place end as rank from placed
""".replace("{half_bytes}", ", ".join(map(str, STEP[::16].tolist())))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0, label)


OP13_SQL = r"""
with kept as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
        list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::bigint as score
    from kept a join kept b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, positive_id, cast(row_number() over w as int) as rank, vec_id as negative_id, positive_score, score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
window w as (partition by p.anchor_id, positive_id order by score desc, vec_id)
qualify row_number() over w <= 3
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language_id": op2_language_id,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_pii": op4_pii,
    "op5_line_dedup": op5_line_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_lm_score": op7_lm_score,
    "op8_source_mixing": op8_source_mixing,
    "op9_secrets": op9_secrets,
    "op10_winnowing": op10_winnowing,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_token_files": op12_token_files,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op8_source_mixing": OP8_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op13_hard_negatives": OP13_SQL,
}
