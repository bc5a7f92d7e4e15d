"""The operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, cotraining, hard_negatives, masked_lm, mixing, ngram_join, packing, quality_rules, repeats, sharding, toxicity, vp_trees
from .common import documents, table


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(documents(spark, folder), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return masked_lm.score_all(documents(spark, folder))


def op4_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return cotraining.judge(documents(spark, folder), table(spark, folder, "labels"))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove(documents(spark, folder), length=20, digest=True)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judge(documents(spark, folder), table(spark, folder, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(documents(spark, folder), 24)


def op10_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return vp_trees.neighbours(table(spark, folder, "embeddings"), every=20, k=20)


def op11_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.mine(table(spark, folder, "embeddings"))


def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_ngram_jaccard_join, op3_lm_scoring, op4_bpe_round_trip, op5_quality_rules, op6_quality_classifier, op7_substring_dedup, op8_toxicity, op9_sharding, op10_nearest_neighbours,
                                   op11_source_mixing, op12_hard_negatives, op13_tokenizer_alignment)}

_WORDS = r"'[^\x20\x09-\x0D]+'"
_MEASURES = quality_rules.MEASURES

ORACLES = {"op2_ngram_jaccard_join": rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) as w
  from documents),
sh as (select distinct doc_id, s from (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                        else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from w)),
n as (select doc_id, count(*) as n from sh group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as i from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 90 * (x.n + y.n - i)),
sides as (select a, b from links union select b, a from links),
reach as (select doc_id, doc_id as root from n union select b, root from reach join sides on doc_id = a)
select d.doc_id, coalesce(any_value(n), 0) as n_shingles, coalesce(min(root), d.doc_id) as component_id
from documents d left join n on n.doc_id = d.doc_id left join reach r on r.doc_id = d.doc_id group by d.doc_id""",
           "op12_hard_negatives": """
with v as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: floor(256 * x::double)) as q
           from embeddings
           where vec_id is not null and label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label as own, b.vec_id, b.label, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
      from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
p as (select anchor_id, own, vec_id as positive_id, score as positive_score from s where label = own
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int as rank,
       vec_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and s.label <> p.own and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10""",
           "op7_substring_dedup": rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) as w from documents),
wins as (select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from w)),
later as (select doc_id, i from wins qualify row_number() over (partition by h order by doc_id, i) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from later),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from w),
kept as (select doc_id, string_agg(word, ' ' order by p) as t from words anti join gone using (doc_id, p) group by 1)
select w.doc_id, len(w)::bigint as n_words, (select count(*) from gone g where g.doc_id = w.doc_id) as n_removed,
       sha256(coalesce(t, '')) as kept_sha256
from w left join kept k on k.doc_id = w.doc_id""",
           "op5_quality_rules": rf"""
with d as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {_WORDS}) as w from documents),
lines as (select doc_id, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines
          from (select doc_id, unnest(string_split(text, chr(10))) as l from d) where len(regexp_extract_all(l, {_WORDS})) > 0 group by doc_id),
tri as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as t from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, t) as n from tri) where n > 1),
rep as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id),
counts as (
  select d.doc_id, lang, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(n_lines, 0) as n_lines,
         coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from d left join lines on d.doc_id = lines.doc_id left join rep on d.doc_id = rep.doc_id),
m as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
             case when word_chars > 0 then n_symbols * 1000 // word_chars else 0 end as symbol_rate,
             case when n_lines > 0 then n_dup_lines * 1000 // n_lines else 0 end as dup_line_rate,
             case when n_words > 0 then n_repeat_words * 1000 // n_words else 0 end as repeat_rate,
             case when n_words > 0 then word_chars * 100 // n_words else 0 end as word_length from counts),
laid as (select lang, source, rule, value from m unpivot (value for rule in ({', '.join(_MEASURES)})) where not base_failed),
b as (select lang, source, rule, (value >> greatest(0, length(bin(value)) - 5)) << greatest(0, length(bin(value)) - 5) as bucket from laid),
levels as (select 1 as level, lang, source, rule, bucket from b union all select 2, lang, null, rule, bucket from b
           union all select 3, null, null, rule, bucket from b),
c as (select level, lang, source, rule, bucket, count(*) as n from levels group by all),
r as (select *, sum(n) over (partition by level, lang, source, rule order by bucket) as upto,
             sum(n) over (partition by level, lang, source, rule) as total from c),
q as (select level, lang, source, rule, max(total) as total, min(case when 4 * upto >= total then bucket end) as q25,
             min(case when 2 * upto >= total then bucket end) as q50, min(case when 4 * upto >= 3 * total then bucket end) as q75,
             min(case when 20 * upto >= 19 * total then bucket end) as q95
      from r group by all),
wide as (select l.lang, l.rule, case when l.total >= 50 then l.q25 else a.q25 end as q25, case when l.total >= 50 then l.q50 else a.q50 end as q50,
                case when l.total >= 50 then l.q75 else a.q75 end as q75, case when l.total >= 50 then l.q95 else a.q95 end as q95
         from q l join q a on l.level = 2 and a.level = 3 and a.rule = l.rule),
pick as (select o.lang, o.source, o.rule, case when o.total >= 50 then o.q50 else w.q50 end as q50,
                least(case when o.total >= 50 then o.q75 - o.q25 else w.q75 - w.q25 end, w.q75 - w.q25) as spread,
                least(case when o.total >= 50 then o.q95 else w.q95 end, w.q95) as q95
         from q o join wide w on o.level = 1 and o.lang is not distinct from w.lang and o.rule = w.rule),
lim as (select lang, source, rule,
               case rule when 'symbol_rate' then q50 - 6 * greatest(spread, 8) when 'word_length' then q50 - 6 * greatest(spread, 25) else 0 end as low,
               case rule when 'symbol_rate' then q50 + 6 * greatest(spread, 8) when 'word_length' then q50 + 6 * greatest(spread, 25)
                         when 'dup_line_rate' then q95 + 340 else q95 + 300 end as high from pick),
bad as (select distinct m.doc_id from m join lim on m.lang is not distinct from lim.lang and m.source is not distinct from lim.source
        where case rule when 'symbol_rate' then symbol_rate when 'dup_line_rate' then dup_line_rate when 'repeat_rate' then repeat_rate else word_length end
              not between low and high)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and doc_id not in (select doc_id from bad) as kept
from m"""}
