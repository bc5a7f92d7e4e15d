"""SQL that computes the registered queries independently, by brute force where it can.

Common tables are named once in ``TABLES``; a query lists the ones it needs.
"""

from __future__ import annotations

import re

# The catalog's genre ids in column order, their names, and the numeric columns.
GENRE_IDS = [28, 12, 16, 35, 80, 99, 18, 10751, 14, 36, 27, 10402, 9648, 10749, 878, 10770,
             53, 10752, 37]
GENRE_NAMES = ["Action", "Adventure", "Animation", "Comedy", "Crime", "Documentary", "Drama",
               "Family", "Fantasy", "History", "Horror", "Music", "Mystery", "Romance",
               "Sci-Fi", "TV Movie", "Thriller", "War", "Western"]
NUMERIC = ["vote_average_bayesian", "vote_count_log", "runtime", "budget_log", "revenue_log",
           "release_year", "is_english"]
# End of fixed values.

TABLES: dict[str, str] = {
    "ratings": """
        select o_custkey as "userId", l_partkey as "movieId", avg(ceil(l_quantity / 5) / 2) as rating
        from lineitem join orders on l_orderkey = o_orderkey group by 1, 2""",
    "items": """
        select p_partkey as "movieId", p_name as name, cast(1980 + p_partkey % 41 as int) as year,
               case when p_partkey % 50 = 0 then p_name
                    else concat(p_name, ' (', cast(1980 + p_partkey % 41 as varchar), ')') end as title,
               concat_ws('|', p_type, p_brand) as genres from part""",
    "links": """
        select p_partkey as "movieId", case when p_partkey % 53 = 7 then null
               when p_partkey % 97 = 5 then (p_partkey - 1) * 10 else p_partkey * 10 end as "tmdbId"
        from part""",
    "one_item": """
        select "tmdbId", max("movieId") as "movieId" from links where "tmdbId" is not null group by 1""",
    "catalog": """
        select p_partkey * 10 as id, p_name as title, upper(p_name) as original_title,
               case when p_partkey % 29 = 0 then ''
                    else concat(cast(1980 + p_partkey % 41 as varchar), '-06-15') end as release_date,
               cast(-round(p_retailprice * 100) as bigint) as rnk from part""",
    "export": """
        select r."userId", i."movieId" as line_no, i.name as title,
               cast(case when i."movieId" % 13 = 0 then null
                    else i.year + i."movieId" % 4 - 1 end as int) as year, r.rating
        from ratings r join items i on r."movieId" = i."movieId" """,
    "profile_events": """
        select user_id as "userId", event_id as line_no, ts,
               cast(json_extract_string(props, '$.k') as bigint) as "movieId",
               greatest(0.5::double, least(5.0::double, ceil(value / 10) / 2)) as rating
        from events""",
    "profile": """
        select "userId", "movieId", rating from profile_events
        qualify row_number() over (partition by "userId", "movieId" order by line_no desc) = 1""",
    "valid": """select "movieId" from ratings group by 1 having count(*) >= 20""",
    "kept": """select r.* from ratings r semi join valid v on r."movieId" = v."movieId" """,
    "mu": """select avg(rating) as mu from kept""",
    "biases": """
        select "movieId", sum(rating - mu) / (count(*) + 10.0::double) as bias
        from kept, mu group by 1""",
    "f64": """
        select b."movieId", list_transform(embedding, lambda x: x::double) as vec, b.bias
        from embeddings join biases b on vec_id = b."movieId" """,
    "f2": """select "movieId", vec[1] as x1, vec[2] as x2, bias from f64""",
    "warm2": """
        select r."userId", r."movieId", r.rating, f.x1, f.x2, f.bias, r.rating - mu - f.bias as y
        from ratings r join f2 f on r."movieId" = f."movieId", mu""",
    "hits": """
        select distinct on (r.title, r.year) r.title, r.year, c.id, c.original_title, c.release_date
        from (select distinct title, year from export) r
        join catalog c on lower(trim(r.title)) = lower(trim(c.title))
        where r.year is null or abs(try_cast(substr(c.release_date, 1, 4) as int) - r.year) <= 1
        order by r.title, r.year,
                 coalesce(abs(try_cast(substr(c.release_date, 1, 4) as int) - r.year), 0), c.rnk, c.id""",
    "resolution": """
        select e."userId", e.line_no, e.title, e.year, e.rating, h.id as tmdb_id, h.original_title,
               nullif(substr(h.release_date, 1, 4), '') as release_year
        from export e left join hits h on e.title = h.title and e.year is not distinct from h.year""",
    "resolved": """
        select "userId", line_no, title as query_title, year as query_year, tmdb_id, original_title,
               release_year, rating from resolution where tmdb_id is not null""",
    "joined": """
        select r.*, l."movieId" from resolved r join links l on r.tmdb_id = l."tmdbId" """,
    "classified": """
        select * replace (case when ambiguous then null else "movieId" end as "movieId"),
               case when ambiguous then 'unmatched' else 'matched' end as kind
        from (select *, count(*) over (partition by "userId", tmdb_id) > 1 as ambiguous from joined)
        union all by name
        select *, null as "movieId", 'unmatched' as kind, false as ambiguous
        from resolved r where not exists (select 1 from links l where l."tmdbId" = r.tmdb_id)""",
    "title_hits": """
        select q.title, q.year, i."movieId", i.title as item_title, i.genres
        from (select distinct title, year from export where year is not null) q
        join items i on contains(lower(i.title), lower(q.title))
         and try_cast(nullif(regexp_extract(i.title, '\\((\\d{4})\\)\\s*$', 1), '') as int) = q.year""",
    "candidates": """
        select user_id as request,
               cast(case when user_id % 8 = 0 then null else 1978 + user_id % 45 end as int) as year,
               case when event_type in ('click', 'view') then 0 else 1 end as src_rank,
               event_id as pos, cast(json_extract_string(props, '$.k') as bigint) as id,
               case when cast(json_extract_string(props, '$.k') as bigint) % 9 = 0 then ''
                    else concat(cast(1980 + cast(json_extract_string(props, '$.k') as bigint) % 41
                                     as varchar), '-03-01') end as release_date
        from events""",
    "pool": """
        select * from candidates
        qualify row_number() over (partition by request, id order by src_rank, pos) = 1""",
    "genre_ids": "select unnest([" + ", ".join(map(str, GENRE_IDS)) + """]) as id,
               unnest(range(19)) as col""",
    "sales": """select l_partkey, sum(l_extendedprice) as revenue from lineitem group by 1""",
    "votes": """
        select "movieId", 2 * avg(rating) as vote_average, count(*) as vote_count
        from ratings group by 1""",
    "billed": """
        select l_partkey, l_suppkey, row_number() over (
                   partition by l_partkey order by sum(l_quantity) desc, l_suppkey) - 1 as ord
        from lineitem group by 1, 2 qualify ord < 5""",
    "linked": """
        select o."movieId", p.p_type, p.p_brand,
               case when p_partkey % 11 = 0 then 0 else p_size::double end as runtime,
               case when p_partkey % 29 = 0 then 0 else 1980 + p_partkey % 41 end::double as year,
               case when coalesce(lang, '') = 'en' then 1 else 0 end::double as is_english,
               coalesce(vote_average, 0) as vote_average, coalesce(vote_count, 0)::double as vote_count,
               case when p_partkey % 7 = 0 then 0 else p_retailprice end as budget,
               case when p_partkey % 5 = 0 then 0 else coalesce(revenue, 0) end as revenue,
               coalesce(text, '') as text, p_partkey
        from part p join one_item o on o."tmdbId" = p_partkey * 10
        left join sales s on s.l_partkey = p_partkey
        left join votes v on v."movieId" = p_partkey
        left join documents d on d.doc_id = p_partkey""",
    "corpus": "select * from linked",
    "encoded": "select * from linked",
    "levels": """
        select coalesce(avg(vote_average) filter (vote_count > 0), 6) as m,
               coalesce(avg(runtime) filter (runtime > 0), 90) as runtime_impute_value,
               coalesce(median(budget) filter (budget > 0), 1) as budget_impute_value,
               coalesce(median(revenue) filter (revenue > 0), 1) as revenue_impute_value,
               coalesce(avg(year) filter (year > 0), 1990) as year_mean,
               coalesce(stddev_pop(year) filter (year > 0), 20) as year_std from corpus""",
    "corpus_values": """
        select (vote_count * vote_average + 100 * m) / (vote_count + 100) as bayesian_vote,
               ln(1 + vote_count) as vote_count_log,
               case when runtime > 0 then runtime else runtime_impute_value end as runtime,
               ln(1 + case when budget > 0 then budget else budget_impute_value end) as budget_log,
               ln(1 + case when revenue > 0 then revenue else revenue_impute_value end) as revenue_log
        from corpus, levels""",
    "stats": """
        select any_value(levels) as lv, """ + ", ".join(
            f"avg({c}) as {c}_mean, case when stddev_pop({c}) > 1e-9 then stddev_pop({c}) else 1 end "
            f"as {c}_std" for c in ("bayesian_vote", "vote_count_log", "runtime", "budget_log",
                                    "revenue_log")) + " from corpus_values, levels",
    "numeric_rows": """
        select "movieId", unnest(range(19, 26)) as feature_id, unnest([
            ((vote_count * vote_average + 100 * lv.m) / (vote_count + 100) - bayesian_vote_mean)
                / bayesian_vote_std,
            (ln(1 + vote_count) - vote_count_log_mean) / vote_count_log_std,
            (case when runtime > 0 then runtime else lv.runtime_impute_value end - runtime_mean)
                / runtime_std,
            (ln(1 + case when budget > 0 then budget else lv.budget_impute_value end)
                - budget_log_mean) / budget_log_std,
            (ln(1 + case when revenue > 0 then revenue else lv.revenue_impute_value end)
                - revenue_log_mean) / revenue_log_std,
            case when year > 0 then (year - lv.year_mean) / (lv.year_std + 1e-9) else 0 end,
            is_english]) as value
        from encoded, stats""",
    "tokens": """
        select "movieId", term, count(*) as tf from (
            select "movieId", unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) as term
            from linked) group by 1, 2""",
    "corpus_tokens": """select t.* from tokens t semi join corpus c on t."movieId" = c."movieId" """,
    "term_df": """select term, count(*) as df, sum(tf) as total from corpus_tokens group by 1""",
    "terms": """
        select row_number() over (order by term) - 1 as pos, term,
               ln((1 + n) / (1.0 + df)) + 1 as idf
        from (select term, df, n from term_df, (select count(*) as n from corpus)
              where df >= case when (select max(df) from term_df) >= least(5, greatest(1, n // 200))
                               then least(5, greatest(1, n // 200)) else 1 end
              order by total desc, term limit 2000)""",
    "directors": """
        select l_suppkey as person, count(*) as films from billed
        join corpus c on c.p_partkey = l_partkey where ord = 0 group by 1 having count(*) >= 3""",
    "actors": """
        select l_suppkey as person, count(*) as films from billed
        join corpus c on c.p_partkey = l_partkey group by 1 having count(*) >= 5""",
    "vocab": """
        select col as feature_id, 'genre' as block, id::varchar as key, 'genre:' || ["""
        + ", ".join(f"'{g}'" for g in GENRE_NAMES) + """][col + 1] as name, null::double as idf
        from genre_ids
        union all select unnest(range(19, 26)), 'numeric', unnest(names), unnest(names), null
        from (select [""" + ", ".join(f"'{g}'" for g in NUMERIC) + """] as names)
        union all select 26 + pos, 'keyword', term, 'kw:' || term, idf from terms
        union all select 26 + (select count(*) from terms) + row_number() over (order by person) - 1,
               'director', person::varchar, 'director:' || person, null from directors
        union all select 26 + (select count(*) from terms) + (select count(*) from directors)
               + row_number() over (order by person) - 1,
               'cast', person::varchar, 'cast:' || person, null from actors""",
    "genre_rows": """
        select distinct "movieId", col as feature_id, 1.0::double as value from (
            select "movieId", unnest([
                list_extract((select list(id order by col) from genre_ids), length(p_type) + 1),
                list_extract((select list(id order by col) from genre_ids),
                             cast(split_part(p_brand, '#', 2) as int) % 20 + 1)]) as id
            from encoded) join genre_ids using (id)""",
    "keyword_rows": """
        select "movieId", pos, w / sqrt(sum(w * w) over (partition by "movieId")) as value from (
            select t."movieId", v.pos, (1 + ln(tf)) * idf as w
            from tokens t join terms v using (term) semi join encoded e on e."movieId" = t."movieId")""",
    "person_rows": """
        select e."movieId", v.feature_id, v.name,
               case when v.block = 'director' then 1.0 else 1.0 / (b.ord + 1) end::double as value
        from billed b join encoded e on e.p_partkey = b.l_partkey
        join vocab v on v.key = b.l_suppkey::varchar
         and ((v.block = 'director' and b.ord = 0) or v.block = 'cast')""",
    "feature_rows": """
        select * from genre_rows
        union all select * from numeric_rows where value <> 0
        union all select "movieId", 26 + pos, value from keyword_rows
        union all select "movieId", feature_id, value from person_rows""",
    "content2": """
        select "movieId", sum(value * ((31 * feature_id) % 101 - 50) / 500.0::double) as c1,
               sum(value * ((31 * feature_id + 17) % 101 - 50) / 500.0::double) as c2,
               sum(value * (feature_id % 13 - 6) / 100.0::double) as cb
        from feature_rows group by 1""",
    "split": """
        with m as (select *, ('0x' || substr(md5(concat_ws('-', '5', "userId", "movieId")), 1, 8))::bigint
                             / 4294967296.0::double < 0.3 as is_test from kept)
        select "userId", "movieId", rating,
               case when not is_test then 'train'
                    when bool_and(is_test) over (partition by "userId")
                      or bool_and(is_test) over (partition by "movieId") then 'dropped'
                    else 'test' end as part from m""",
    "draw_rows": """
        with sizes as (select "userId", count(*) as pool from warm2 group by 1),
        cells as (select "userId", n, pool, unnest(case when n = pool then [0] else [0, 1, 2] end) as draw
                  from sizes, (select unnest([5, 10, 15]) as n) where n <= pool)
        select "userId", n, draw, "movieId" from cells join warm2 using ("userId")
        qualify row_number() over (partition by "userId", n, draw order by
            ('0x' || substr(md5(concat_ws('-', '0', n, draw, "userId", "movieId")), 1, 8))::bigint,
            "movieId") <= n""",
}


def fold_sql(rows: str, alpha: str, keys: str = '"userId"', minimum: int = 2) -> str:
    """Closed form of the two-factor ridge per key, from centred sums."""
    return f"""
        select {keys}, a, n, my - m1 * w1 - m2 * w2 as b, w1, w2 from (
            select *, ((s22 + a) * c1 - s12 * c2) / det as w1, ((s11 + a) * c2 - s12 * c1) / det as w2
            from (select *, (s11 + a) * (s22 + a) - s12 * s12 as det from (
                select {keys}, a, count(*) as n, avg(x1) as m1, avg(x2) as m2, avg(y) as my,
                       sum(x1 * x1) - count(*) * avg(x1) * avg(x1) as s11,
                       sum(x2 * x2) - count(*) * avg(x2) * avg(x2) as s22,
                       sum(x1 * x2) - count(*) * avg(x1) * avg(x2) as s12,
                       sum(x1 * y) - count(*) * avg(x1) * avg(y) as c1,
                       sum(x2 * y) - count(*) * avg(x2) * avg(y) as c2
                from {rows}, (select unnest([{alpha}])::double as a)
                group by {keys}, a having count(*) >= {minimum})))"""


def loo_sql(rows: str, alpha: str, keys: str = '"userId"', clamp: bool = True) -> str:
    """Held-out errors by refitting on the key's sums without the row's own share."""
    score = "mu + b + bias + w1 * x1 + w2 * x2"
    if clamp:
        score = f"greatest(0.5::double, least(5.0::double, {score}))"
    return f"""
        select {keys}, a as alpha, rating, {score} - rating as error from (
            select *, (ty - t1 * w1 - t2 * w2) / n1 as b from (
                select *, ((g22 + a) * h1 - g12 * h2) / det as w1,
                          ((g11 + a) * h2 - g12 * h1) / det as w2
                from (select *, (g11 + a) * (g22 + a) - g12 * g12 as det from (
                    select *, q11 - t1 * t1 / n1 as g11, q22 - t2 * t2 / n1 as g22,
                           q12 - t1 * t2 / n1 as g12, q1 - t1 * ty / n1 as h1, q2 - t2 * ty / n1 as h2
                    from (select *, count(*) over k - 1 as n1, sum(x1) over k - x1 as t1,
                                 sum(x2) over k - x2 as t2, sum(y) over k - y as ty,
                                 sum(x1 * x1) over k - x1 * x1 as q11,
                                 sum(x2 * x2) over k - x2 * x2 as q22,
                                 sum(x1 * x2) over k - x1 * x2 as q12,
                                 sum(x1 * y) over k - x1 * y as q1, sum(x2 * y) over k - x2 * y as q2
                          from {rows} window k as (partition by {keys})) where n1 >= 2),
                      (select unnest([{alpha}])::double as a)))), mu"""


# All catalog records, encoded with the vocabulary of the linked ones.
TABLES["catalog_encoded"] = """
    select p_partkey * 10 as "movieId", """ + TABLES["linked"].split('o."movieId", ', 1)[1].replace(
        """join one_item o on o."tmdbId" = p_partkey * 10""", "")
for _name in ("tokens", "genre_rows", "numeric_rows", "keyword_rows", "person_rows", "feature_rows", "content2"):
    _body = TABLES[_name]
    for _old in ("genre_rows", "numeric_rows", "keyword_rows", "person_rows", "feature_rows", "encoded"):
        _body = re.sub(rf"\b{_old}\b", f"catalog_{_old}", _body)
    _body = re.sub(r"\bfrom tokens\b", "from catalog_tokens", _body)
    TABLES[f"catalog_{_name}"] = _body.replace("from linked)", "from catalog_encoded)")
TABLES["fold2"] = fold_sql("warm2", "100")
# Without a penalty: two rows leave a line of solutions, of which the shortest counts, a combination of the rows.
TABLES["least2"] = f"""
    select "userId", b, w1, w2 from ({fold_sql("warm2", "0", minimum=3)})
    union all
    select "userId", l1 + l2, l1 * p1 + l2 * q1, l1 * p2 + l2 * q2 from (
        select *, (k22 * yp - k12 * yq) / (k11 * k22 - k12 * k12) as l1,
               (k11 * yq - k12 * yp) / (k11 * k22 - k12 * k12) as l2
        from (select *, 1 + p1 * p1 + p2 * p2 as k11, 1 + q1 * q1 + q2 * q2 as k22, 1 + p1 * q1 + p2 * q2 as k12
              from (select "userId", min_by(x1, "movieId") as p1, min_by(x2, "movieId") as p2, min_by(y, "movieId") as yp,
                           max_by(x1, "movieId") as q1, max_by(x2, "movieId") as q2, max_by(y, "movieId") as yq
                    from warm2 group by 1 having count(*) = 2)))"""
TABLES["loo"] = loo_sql("warm2", "1, 10, 100")
TABLES["loo_free"] = loo_sql("warm2", "1, 10, 100", clamp=False)
# The full model. With n rows and k = 64 factors, K the products of the centred rows and Z = (K + aI)^-1, the
# solution is X'Z y, and leaving row i out changes its error to a (Zy)_i / (a Z_ii - 1/n). Z comes from
# Gauss-Jordan steps on [K + aI | I], one row of the matrix a row of the table.
TABLES["warm64"] = """
    select r."userId", r."movieId", r.rating, f.vec, f.bias, r.rating - mu - f.bias as y,
           row_number() over u as i, count(*) over (partition by r."userId") as n,
           avg(r.rating - mu - f.bias) over (partition by r."userId") as my
    from ratings r join f64 f on r."movieId" = f."movieId", mu window u as (partition by r."userId" order by r."movieId")"""
TABLES["means64"] = """
    select "userId", list(m order by d) as m from (
        select "userId", d, avg(x) as m from (select "userId", unnest(vec) as x, unnest(range(1, 65)) as d from warm64)
        group by 1, 2) group by 1"""
TABLES["centred64"] = """
    select w.*, m, list_transform(list_zip(vec, m), lambda z: z[1] - z[2]) as c
    from warm64 w join means64 using ("userId") where n >= 2"""
TABLES["inverse64"] = """
    select 0 as k, "userId", a, n, i, list(p + case when i = j then a else 0 end order by j)
           || list(case when i = j then 1.0::double else 0 end order by j) as row
    from (select x."userId", x.n, x.i, z.i as j, list_dot_product(x.c, z.c) as p
          from centred64 x join centred64 z on x."userId" = z."userId"),
         (select unnest([1, 10, 100])::double as a) group by all
    union all
    select x.k + 1, x."userId", x.a, x.n, x.i, case when x.i = x.k + 1
           then list_transform(x.row, lambda v: v / x.row[x.k + 1])
           else list_transform(list_zip(x.row, p.row), lambda z: z[1] - x.row[x.k + 1] / p.row[x.k + 1] * z[2]) end
    from inverse64 x join inverse64 p on x."userId" = p."userId" and x.a = p.a and p.i = x.k + 1 where x.k < x.n"""
TABLES["duals64"] = """
    select z."userId", z.a, z.i, z.n, z.row[z.n + z.i] as own, list_dot_product(z.row[z.n + 1:2 * z.n], t.t) as dual
    from inverse64 z join (select "userId", list(y - my order by i) as t from centred64 group by 1) t using ("userId")
    where z.k = z.n"""
TABLES["fold64"] = """
    select "userId", list(w order by d) as w from (
        select "userId", d, sum(x * dual) as w from (
            select c."userId", unnest(c.c) as x, unnest(range(1, 65)) as d, dual
            from centred64 c join duals64 q on q."userId" = c."userId" and q.i = c.i and q.a = 100)
        group by 1, 2) group by 1"""
TABLES["bias64"] = """
    select f."userId", w, any_value(my) - list_dot_product(w, any_value(m)) as b
    from fold64 f join centred64 c using ("userId") group by 1, 2"""
TABLES["loo64"] = """
    select c."userId", a as alpha,
           greatest(0.5::double, least(5.0::double, rating - a * dual / (a * own - 1.0::double / c.n))) - rating as error
    from centred64 c join duals64 q on q."userId" = c."userId" and q.i = c.i where c.n >= 3"""
TABLES["all_scores64"] = """
    select u."userId", f."movieId", mu + b + bias + list_dot_product(w, vec) as raw,
           greatest(0.5::double, least(5.0::double, mu + b + bias + list_dot_product(w, vec))) as score
    from bias64 u, f64 f semi join items i on i."movieId" = f."movieId", mu"""
TABLES["all_scores"] = """
    select u."userId", f."movieId", mu + b + bias + w1 * x1 + w2 * x2 as raw,
           greatest(0.5::double, least(5.0::double, mu + b + bias + w1 * x1 + w2 * x2)) as score
    from fold2 u, f2 f semi join items i on i."movieId" = f."movieId", mu"""

def dual_sql(name: str, rows: str, keys: str, alphas: str) -> dict[str, str]:
    """Held-out errors ``name`` of ridge models with any number of factors, from products of rows.

    With n rows, K the products of the centred rows and Z = (K + aI)^-1, leaving row i out changes
    its error to a (Zy)_i / (a Z_ii - 1/n). Z comes from Gauss-Jordan steps on [K + aI | I], one
    row of the matrix a row of the table. ``rows`` has the keys, ``"movieId", rating, vec, y``.
    """
    on = " and ".join(f"x.{k} = z.{k}" for k in keys.split(", "))
    own = ", ".join(f"x.{k}" for k in keys.split(", "))
    return {
        f"{name}_numbered": f"""
            select *, row_number() over (partition by {keys} order by "movieId") as i,
                   count(*) over (partition by {keys}) as size, avg(y) over (partition by {keys}) as my from ({rows})""",
        f"{name}_means": f"""
            select {keys}, list(m order by d) as m from (
                select {keys}, d, avg(v) as m from (
                    select {keys}, unnest(vec) as v, unnest(range(1, len(vec) + 1)) as d from {name}_numbered)
                group by {keys}, d) group by {keys}""",
        f"{name}_centred": f"""
            select x.*, list_transform(list_zip(vec, m), lambda e: e[1] - e[2]) as c
            from {name}_numbered x join {name}_means z on {on} where size >= 3""",
        f"{name}_inverse": f"""
            select 0 as step, {keys}, a, size, i, list(p + case when i = j then a else 0 end order by j)
                   || list(case when i = j then 1.0::double else 0 end order by j) as line
            from (select {own}, x.size, x.i, z.i as j, list_dot_product(x.c, z.c) as p
                  from {name}_centred x join {name}_centred z on {on}),
                 (select unnest([{alphas}])::double as a) group by all
            union all
            select x.step + 1, {own}, x.a, x.size, x.i, case when x.i = x.step + 1
                   then list_transform(x.line, lambda v: v / x.line[x.step + 1])
                   else list_transform(list_zip(x.line, z.line), lambda e: e[1] - x.line[x.step + 1] / z.line[x.step + 1] * e[2]) end
            from {name}_inverse x join {name}_inverse z on {on} and x.a = z.a and z.i = x.step + 1 where x.step < x.size""",
        name: f"""
            select {own}, x.a as alpha, r.rating, greatest(0.5::double, least(5.0::double, r.rating
                   - x.a * list_dot_product(x.line[x.size + 1:2 * x.size], z.t) / (x.a * x.line[x.size + x.i] - 1.0::double / x.size)))
                   - r.rating as error
            from {name}_inverse x join (select {keys}, list(y - my order by i) as t from {name}_centred group by {keys}) z on {on}
            join {name}_centred r on {on.replace("z.", "r.")} and x.i = r.i where x.step = x.size"""}


TABLES |= dual_sql("cascade_loo", """
    select d."userId", d.n, d.draw, k, w."movieId", w.rating, w.y, w.vec[1:k] as vec
    from draw_rows d join warm64 w using ("userId", "movieId"), (select unnest([1, 2, 64]) as k)""", '"userId", k, n, draw', "1, 10, 100")
TABLES["cascade"] = """
    select "userId", k, n, alpha, avg(rmse) as mean_rmse, stddev_pop(rmse) as std_rmse, count(*) as n_draws
    from (select "userId", k, n, draw, alpha, sqrt(avg(error * error)) as rmse from cascade_loo group by all) group by all"""
TABLES |= dual_sql("sanity_loo", """
    select "userId", k, "movieId", rating, y, vec[1:k] as vec from warm64, (select unnest([1, 2, 64]) as k)""", '"userId", k', "1, 10, 100")


def _needs(sql: str) -> set[str]:
    return {name for name in TABLES if re.search(rf"\b{name}\b", sql)}


def with_tables(sql: str, **replaced: str) -> str:
    """The query with the common tables it uses, in dependency order."""
    known = {**TABLES, **replaced}
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for other in sorted(_needs(known[name]) - {name}):
            add(other)
        ordered.append(name)

    for name in sorted(_needs(sql)):
        add(name)
    if not ordered:
        return sql
    body = ", ".join(f"{name} as ({known[name]})" for name in ordered)
    own = re.match(r"\s*with\b", sql)
    start = "with recursive" if any("inverse" in name for name in ordered) else "with"
    return f"{start} {body}, {sql[own.end():]}" if own else f"{start} {body} {sql}"


def train_sql(epochs: int, hybrid: bool) -> dict[str, str]:
    """Steps of a model of one factor as common tables ``users_e``, ``items_e`` and, with content, ``weights_e``.

    Vectors are stored and sent in single precision, as the model has them.
    """
    penalty = "5.0::double" if hybrid else "0.1::double * n"

    def solve(rows: str, key: str, prior: str = "") -> str:
        p, q = ("coalesce(px, 0)", "coalesce(pb, 0)") if prior else ("0", "0")
        join = f"left join {prior} using ({key})" if prior else ""
        return f"""
            select s.*, sum((r.y - s.x * r.x - s.bias) ** 2) as sse from (
                select {key}, n, a, ((n + a) * h1 - sx * h2) / det as x, ((sxx + a) * h2 - sx * h1) / det as bias
                from (select *, sxy + a * {p} as h1, sy + a * {q} as h2, (sxx + a) * (n + a) - sx * sx as det from (
                    select *, {penalty} as a from (
                        select {key}, count(*) as n, sum(x) as sx, sum(x * x) as sxx, sum(x * y) as sxy, sum(y) as sy
                        from {rows} group by 1)) {join})) s join {rows} r using ({key}) group by all"""

    out = {"total_0": """
        select "movieId", ('0x' || substr(md5(concat_ws('-', '0', "movieId", '0')), 1, 8))::bigint / 4294967296.0::double - 0.5 as x, bias
        from biases"""}
    if hybrid:
        out["trained_rows"] = """select f.* from feature_rows f semi join biases b on b."movieId" = f."movieId" """
        out["breadth"] = """select "movieId", sum(abs(value)) as l1 from trained_rows group by 1"""
        out["weights_0"] = "select distinct feature_id, 0.0::double as w, 0.0::double as wb from trained_rows"
    for e in range(1, epochs + 1):
        if hybrid:
            out[f"content_{e - 1}"] = f"""
                select "movieId", sum(value * w) as cx, sum(value * wb) as cb from trained_rows join weights_{e - 1} using (feature_id) group by 1"""
            out[f"prior_{e}"] = f"""select "movieId", cx::float::double as px, cb as pb from content_{e - 1}"""
        out[f"by_user_{e}"] = f"""
            select k."userId", t.x::float::double as x, rating - mu - t.bias as y
            from kept k join total_{e - 1} t using ("movieId"), mu"""
        out[f"users_{e}"] = solve(f"by_user_{e}", '"userId"')
        out[f"by_item_{e}"] = f"""
            select k."movieId", u.x::float::double as x, rating - mu - u.bias as y
            from kept k join users_{e} u using ("userId"), mu"""
        out[f"items_{e}"] = solve(f"by_item_{e}", '"movieId"', f"prior_{e}" if hybrid else "")
        if hybrid:
            out[f"pulls_{e}"] = f"""
                select feature_id, sum(5 * value * (x - coalesce(cx, 0))) as px, sum(5 * value * (bias - coalesce(cb, 0))) as pb,
                       sum(5 * abs(value) * l1) as curve
                from trained_rows join items_{e} using ("movieId") join breadth using ("movieId")
                left join content_{e - 1} using ("movieId") group by 1"""
            out[f"weights_{e}"] = f"""
                select feature_id, (w + (px - 1e-5 * w) / (curve + 1e-5))::float::double as w, wb + (pb - 1e-5 * wb) / (curve + 1e-5) as wb
                from weights_{e - 1} join pulls_{e} using (feature_id)"""
            out[f"content_after_{e}"] = f"""
                select "movieId", sum(value * w) as cx, sum(value * wb) as cb from trained_rows join weights_{e} using (feature_id) group by 1"""
            out[f"own_{e}"] = f"""
                select "movieId", (x - coalesce(cx, 0))::float::double as x, bias - coalesce(cb, 0) as bias, sse, a
                from items_{e} left join content_after_{e} using ("movieId")"""
            out[f"total_{e}"] = f"""
                select "movieId", x + coalesce(cx, 0) as x, bias + coalesce(cb, 0) as bias
                from own_{e} left join content_after_{e} using ("movieId")"""
        else:
            out[f"own_{e}"] = f"select * from items_{e}"
            out[f"total_{e}"] = f"select * from items_{e}"
        weight = f"+ 1e-5 * (select sum(w * w + wb * wb) from weights_{e})" if hybrid else ""
        out[f"progress_{e}"] = f"""
            select {e} as epoch, (select sum(sse) from own_{e}) as squares, (select count(*) from kept) as n_rows,
                   (select sum(a * (x * x + bias * bias)) from own_{e}) + (select sum(a * (x * x + bias * bias)) from users_{e}) {weight} as penalty"""
    return out


def _progress(epochs: int, done: str = f", epoch = 2 as done") -> str:
    rows = " union all ".join(f"select * from progress_{e}" for e in range(1, epochs + 1))
    return f"select epoch, round(squares / n_rows, 6) as mse_loss, round(squares + penalty, 3) as objective{done} from ({rows})"


R2 = "round(w1, 6) as w1, round(w2, 6) as w2"
ERRORS = """round(sqrt(avg(error * error)), 6) as rmse, round(avg(abs(error)), 6) as mae,
            round(avg(error), 6) as mean_error"""
CORPUS = {"corpus": """select l.* from linked l semi join f2 f on f."movieId" = l."movieId" """}
LATER = {"encoded": """select l.* from linked l anti join f2 f on f."movieId" = l."movieId" """}
TIERED_SCORES = """
    with u2 as (select *, greatest(sqrt(x1 * x1 + x2 * x2), 1e-9) as len from f2),
    counts as (select c_custkey as "userId", count(w."movieId") as n from customer
               left join warm2 w on w."userId" = c_custkey group by 1),
    prefs as (select "userId", sum((rating - mu) * u2.x1 / len) as p1, sum((rating - mu) * u2.x2 / len) as p2
              from warm2 join u2 using ("movieId"), mu group by 1),
    scored as (
        select c."userId", u."movieId", case when c.n >= 10 then 'item_cf' else 'popularity' end as tier,
               case when c.n >= 10 then (coalesce(p1, 0) * x1 + coalesce(p2, 0) * x2) / len
                    else mu + bias end as predicted_score
        from counts c left join prefs p using ("userId"), u2 u, mu
        where not exists (select 1 from warm2 w where w."userId" = c."userId"
                          and w."movieId" = u."movieId"))"""
# The same with the whole vectors; a user's sum of directions in long form, one row a number.
TIERED_SCORES64 = """
    with u64 as (select *, greatest(sqrt(list_sum([v * v for v in vec])), 1e-9) as len from f64),
    matched as (select "userId", "movieId", rating from ratings semi join f64 using ("movieId")),
    counts as (select c_custkey as "userId", count(w."movieId") as n from customer
               left join matched w on w."userId" = c_custkey group by 1),
    prefs as (select "userId", list(p order by dim) as w from (
                  select "userId", dim, sum((rating - mu) * x / len) as p
                  from matched join (select "movieId", len, unnest(vec) as x, unnest(range(64)) as dim from u64)
                  using ("movieId"), mu group by 1, 2) group by 1),
    scored as (
        select c."userId", u."movieId", case when c.n >= 10 then 'item_cf' else 'popularity' end as tier,
               case when c.n >= 10 then list_dot_product(w, vec) / len else mu + bias end as predicted_score
        from counts c left join prefs p using ("userId"), u64 u, mu
        where not exists (select 1 from matched w where w."userId" = c."userId"
                          and w."movieId" = u."movieId"))"""
TRAIN_FOLD = {"train2": """
    select s."userId", f.x1, f.x2, s.rating - mu - f.bias as y
    from split s join f2 f using ("movieId"), mu where part = 'train'"""}
TOP = """select "userId", "movieId", rank, round(raw, 6) as raw, round(score, 6) as score"""


def _top(where: str, n: int, extra: str = "", source: str = "all_scores") -> str:
    return f"""{TOP}{extra} from (
        select s.*, row_number() over (partition by s."userId" order by score desc, s."movieId") as rank
        from {source} s where {where} qualify rank <= {n}) t join items i using ("movieId")"""


UNRATED = """not exists (select 1 from ratings r where r."userId" = s."userId"
                         and r."movieId" = s."movieId")"""

_SQL: dict[str, str | tuple[str, dict[str, str]]] = {
    "scan_ratings": "select * from ratings",
    "scan_items": """select "movieId", title, genres from items""",
    "links_last_wins": "select * from one_item",
    "links_inverse": "select * from one_item",
    "export_clean": "select * from export",
    "profile_dedup": "select * from profile",
    "records_latest": """
        select "movieId", line_no, "userId", rating from profile_events
        qualify row_number() over (partition by "movieId" order by line_no desc) = 1""",
    "latest_snapshot": """
        select "userId" as user, strftime(date_trunc('week', ts), '%Y-%m-%d') as snapshot_date,
               line_no, "movieId", rating from profile_events
        qualify date_trunc('week', ts) = max(date_trunc('week', ts)) over (partition by "userId")""",
    "record_parse": """
        with w as (select *, [x for x in regexp_split_to_array(text, '\\s+') if x <> ''] as words
                   from documents where doc_id % 17 <> 3)
        select doc_id * 10 as tmdb_id, n_chars::varchar as genre_ids,
               case when doc_id % 11 <> 0 then n_chars::double else 0 end as runtime,
               '' as release_date, coalesce(lang, '') as original_language, 0::bigint as vote_count,
               case when doc_id % 3 <> 0 then doc_id::double else 0 end as budget,
               case when doc_id % 19 = 2 then 0 else len(words) end as n_keywords,
               case when doc_id % 19 = 2 then '' else array_to_string(words, ' ') end as keywords,
               case when doc_id % 19 = 2 then '' else
                   array_to_string([length(x)::varchar for x in words], ',') end as keyword_ids,
               array_to_string([length(x)::varchar for x in words
                                if length(x) % 3 = 0 and length(x) % 9 <> 4], ',') as director_ids,
               array_to_string([length(x) || ':' || length(x) for x in words[1:5]
                                if length(x) % 9 <> 4 and length(x) <> 7], ',') as "cast"
        from w""",
    "min_support": "select * from kept",
    "first_n_users": """
        select * from ratings where "userId" in (
            select distinct "userId" from ratings order by 1 limit 1000)""",
    "sample_users": """
        select * from kept where "userId" in (select "userId" from (
            select distinct "userId", ('0x' || substr(md5('7-' || "userId"), 1, 8))::bigint as h from kept)
            order by h, "userId" limit 500)""",
    "title_search": "select * from title_hits",
    "title_candidates": """
        select title, year, "movieId" from title_hits
        qualify row_number() over (partition by title, year order by "movieId") <= 20""",
    "genre_all": """
        select "movieId", genres from items
        where contains(lower(genres), 'promo') and contains(lower(genres), 'brand#1')""",
    "genre_one": """select "movieId", genres from items where contains(lower(genres), 'econ')""",
    "exclude_rated": """
        select distinct "userId", "movieId" from profile_events p anti join ratings r
        on p."userId" = r."userId" and p."movieId" = r."movieId" """,
    "min_ratings_floor": """
        select "movieId", title from items i
        where (select count(*) from ratings r where r."movieId" = i."movieId") >= 30""",
    "warm_only": """select "userId", "movieId", rating from warm2""",
    "pending_ids": """
        select "movieId" from items where "movieId" not in (select doc_id from documents)
        order by 1 limit 500""",
    "in_trainset": """
        select "movieId", "movieId" in (select "movieId" from f2) as in_trainset from items""",
    "title_any": """
        select "movieId", title from items
        where regexp_matches(lower(title), 'ring|wid.et|\\(199\\d\\)')""",
    "nearest_year": "select * from hits",
    "first_hit": """
        select distinct on (r.title, r.year) r.title, r.year, c.id, c.original_title, c.release_date
        from (select distinct title, year from export) r
        join catalog c on lower(trim(r.title)) = lower(trim(c.title))
        order by r.title, r.year,
            case when try_cast(substr(c.release_date, 1, 4) as int) = r.year then 0 else 1 end,
            c.rnk, c.id""",
    "resolve_export": "select * from resolution",
    "match_inner": "select * from joined",
    "match_unmatched": """
        select * from resolved where tmdb_id not in (
            select "tmdbId" from links where "tmdbId" is not null)""",
    "match_ambiguous": "select * from classified",
    "match_ambiguous_distinct": "select distinct * from classified",
    "match_report": """
        select count(*) as n_rows, count(*) filter (kind = 'matched') as n_matched,
               count(*) filter (kind = 'unmatched') as n_unmatched,
               count(*) filter (ambiguous) as n_ambiguous,
               count(distinct tmdb_id) filter (ambiguous) as n_ambiguous_ids,
               round(count(*) filter (kind = 'matched') / count(*)::double, 6) as match_rate
        from classified""",
    "match_lookup": """
        select r.*, o."movieId" from resolved r left join one_item o on o."tmdbId" = r.tmdb_id""",
    "match_outcome": """
        select case when r.tmdb_id is null then 'not_in_catalog'
                    when o."movieId" is null then 'no_item' else 'matched' end as outcome,
               count(*) as n
        from resolution r left join one_item o on o."tmdbId" = r.tmdb_id group by 1""",
    "candidate_pool": "select * from pool",
    "pick_nearest_year": """
        select * from pool where year is null
            or abs(try_cast(substr(release_date, 1, 4) as int) - year) <= 1
        qualify row_number() over (partition by request order by
            coalesce(abs(try_cast(substr(release_date, 1, 4) as int) - year), 0), src_rank, pos) = 1""",
    "pick_first_hit": """
        select * from candidates
        qualify row_number() over (partition by request order by src_rank, pos) = 1""",
    "warm_set_diff": """
        with a as (select "movieId" from f2), b as (select vec_id as "movieId" from embeddings
                                                    where label <> 3)
        select "movieId", 'left' as side from a where "movieId" not in (from b)
        union all select "movieId", 'right' from b where "movieId" not in (from a)""",
    "dense_index_users": """
        select "userId", row_number() over (order by "userId") - 1 as idx
        from (select distinct "userId" from ratings)""",
    "dense_index_items": """
        select "movieId", row_number() over (order by "movieId") - 1 as idx
        from (select distinct "movieId" from kept)""",
    "enrich_meta": """
        select "movieId", case when title like '%)' then title else 'Unknown' end as title,
               case when title like '%)' then genres else '(no genres listed)' end as genres
        from items""",
    "item_stats_join": """
        select f."movieId", round(mu + bias, 6) as score, s.mean_rating, s.num_ratings
        from f2 f left join (select "movieId", round(avg(rating), 3) as mean_rating,
                                    count(*) as num_ratings from ratings group by 1) s
        using ("movieId"), mu""",
    "inject_user": """
        select "userId", "movieId", rating from kept
        union all select -1, "movieId", max(rating) from profile p
        where "movieId" in (select "movieId" from valid) group by "movieId" """,
    "item_counts": """select "movieId", count(*) as n from ratings group by 1""",
    "global_mean": "select round(mu, 6) as global_mean from mu",
    "item_stats": """
        select "movieId", round(avg(rating), 3) as mean_rating, count(*) as num_ratings
        from ratings group by 1""",
    "rating_summary": """
        select count(*) as n_ratings, count(distinct "userId") as n_users,
               count(distinct "movieId") as n_items from kept""",
    "convergence": """
        with curve as (select event_type, dayofmonth(ts)::int as n_epochs, avg(value) as rmse
                       from events group by 1, 2),
        gains as (select *, lag(rmse) over (partition by event_type order by n_epochs) - rmse as gain
                  from curve)
        select event_type, min(n_epochs) as converged_at from gains where gain < 0.5 group by 1""",
    "norm_report": """
        select "userId", round(sqrt(w1 * w1 + w2 * w2), 6) as user_norm,
               round((select avg(sqrt(x1 * x1 + x2 * x2)) from f2), 6) as avg_item_norm from fold2""",
    "numeric_stats": """
        select 100.0::double as "bayesian_C", round(lv.m, 6) as bayesian_m,
               round(bayesian_vote_mean, 6) as bayesian_vote_mean,
               round(bayesian_vote_std, 6) as bayesian_vote_std,
               round(vote_count_log_mean, 6) as vote_count_log_mean,
               round(vote_count_log_std, 6) as vote_count_log_std,
               round(lv.runtime_impute_value, 6) as runtime_impute_value,
               round(runtime_mean, 6) as runtime_mean, round(runtime_std, 6) as runtime_std,
               round(lv.budget_impute_value, 6) as budget_impute_value,
               round(budget_log_mean, 6) as budget_log_mean, round(budget_log_std, 6) as budget_log_std,
               round(lv.revenue_impute_value, 6) as revenue_impute_value,
               round(revenue_log_mean, 6) as revenue_log_mean,
               round(revenue_log_std, 6) as revenue_log_std,
               round(lv.year_mean, 6) as year_mean, round(lv.year_std, 6) as year_std from stats""",
    "freq_people": """
        select person, films, 'director' as block from directors
        union all select person, films, 'cast' from actors""",
    "tfidf_vocab": "select pos, term, round(idf, 6) as idf from terms",
    "feature_vocab": """
        select feature_id::int as feature_id, block, key, name, round(idf, 6) as idf from vocab""",
    "features_genre": """select "movieId", feature_id::int as feature_id, value from genre_rows""",
    "features_numeric": """
        select "movieId", feature_id::int as feature_id, round(value, 6) as value
        from numeric_rows where value <> 0""",
    "features_tfidf": """
        select "movieId", pos::int as feature_id, round(value, 6) as value from keyword_rows""",
    "features_director": """
        select "movieId", name, value from person_rows where name like 'director:%'""",
    "features_cast": """
        select "movieId", name, round(value, 6) as value from person_rows where name like 'cast:%'""",
    "features_all": """
        select "movieId", feature_id::int as feature_id, round(value, 6) as value from feature_rows""",
    "features_serve": ("""
        select "movieId", feature_id::int as feature_id, round(value, 6) as value
        from feature_rows""", {**CORPUS, **LATER}),
    "content_row": ("""
        select "movieId", case when "movieId" in (select "movieId" from f2) then 'stored'
                               else 'fresh' end as source,
               count(*) as n_features, round(sum(value), 6) as total
        from feature_rows group by 1, 2""", CORPUS),
    "feature_density": """
        select block, count(distinct v.feature_id) as n_features, count(f."movieId") as nnz,
               round(count(f."movieId") / (count(distinct v.feature_id)
                     * (select count(distinct "movieId") from feature_rows))::double, 6) as density
        from vocab v left join feature_rows f on f.feature_id = v.feature_id group by 1""",
    "content_coverage": """
        with i as (select distinct "movieId" from kept)
        select count(*) as n_items, count(g."movieId") as n_covered,
               round(count(g."movieId") / count(*)::double, 6) as coverage
        from i left join (select distinct "movieId" from feature_rows) g using ("movieId")""",
    "item_repr": """
        select i."movieId", f."movieId" is null as is_cold,
               case when f."movieId" is not null then 'warm' when c."movieId" is not null then 'cold'
                    else 'unscorable' end as status,
               round(case when f."movieId" is not null then bias else cb end, 6) as bias,
               round(case when f."movieId" is not null then x1 else c1 end, 6) as x1,
               round(case when f."movieId" is not null then x2 else c2 end, 6) as x2
        from items i left join f2 f using ("movieId") left join content2 c using ("movieId")""",
    "item_repr_hybrid": """
        select i."movieId", f."movieId" is null as is_cold,
               case when f."movieId" is not null then 'warm' when c."movieId" is not null then 'cold'
                    else 'unscorable' end as status,
               round(case when f."movieId" is not null then bias + coalesce(cb, 0) else cb end, 6) as bias,
               round(case when f."movieId" is not null then x1 + coalesce(c1, 0) else c1 end, 6) as x1,
               round(case when f."movieId" is not null then x2 + coalesce(c2, 0) else c2 end, 6) as x2
        from items i left join f2 f using ("movieId") left join content2 c using ("movieId")""",
    "fold_in_k2": f"""
        select u."userId", 100.0::double as alpha, coalesce(w.n, 0) as n,
               case when f."userId" is null then 'too_few' else 'ok' end as status,
               round(b, 6) as bias, {R2}
        from (select distinct "userId" from ratings) u
        left join (select "userId", count(*) as n from warm2 group by 1) w using ("userId")
        left join (select "userId", b, w1, w2 from fold2) f using ("userId")""",
    "fold_in": """
        select u."userId", case when w is null then 'too_few' else 'ok' end as status,
               unnest(case when w is null then [null] else range(64) end)::int as dim,
               round(unnest(case when w is null then [null::double] else w end), 6) as value
        from (select distinct "userId" from ratings) u left join fold64 using ("userId")""",
    "loo_alpha_full": f"""
        select "userId", alpha, count(*) as n, {ERRORS} from loo64 group by 1, 2""",
    "fold_in_least_squares": """
        select u."userId", coalesce(w.n, 0) as n, round(b, 4) as bias, round(w1, 4) as w1, round(w2, 4) as w2
        from (select distinct "userId" from ratings) u
        left join (select "userId", count(*) as n from warm2 group by 1) w using ("userId")
        left join least2 using ("userId")""",
    "loo_alpha": f"""
        select "userId", alpha, count(*) as n, {ERRORS} from loo group by 1, 2""",
    "loo_alpha_unclamped": f"""
        select "userId", alpha, count(*) as n, {ERRORS} from loo_free group by 1, 2""",
    "best_alpha": """
        select "userId", alpha, round(sqrt(avg(error * error)), 6) as rmse from loo group by 1, 2
        qualify row_number() over (partition by "userId"
            order by sqrt(avg(error * error)), alpha) = 1""",
    "fold_in_tuned": f"""
        with best as (select "userId", alpha from loo group by 1, 2
                      qualify row_number() over (partition by "userId"
                          order by sqrt(avg(error * error)), alpha) = 1)
        select f."userId", f.a as alpha, f.n, round(f.b, 6) as bias, {R2}
        from ({fold_sql("warm2", "1, 10, 100")}) f
        join best on best."userId" = f."userId" and best.alpha = f.a""",
    "train_fit": f"""
        select w."userId", f.a as alpha, count(*) as n_test,
               round(sqrt(avg((mu + b + bias + w1 * x1 + w2 * x2 - rating) ** 2)), 6) as rmse,
               round(avg(abs(mu + b + bias + w1 * x1 + w2 * x2 - rating)), 6) as mae
        from warm2 w join ({fold_sql("warm2", "0.1, 100")}) f using ("userId"), mu group by 1, 2""",
    "worst_errors": """
        select w."userId", "movieId", rating, round(mu + b + bias + w1 * x1 + w2 * x2, 6) as predicted,
               round(mu + b + bias + w1 * x1 + w2 * x2 - rating, 6) as error
        from warm2 w join fold2 f using ("userId"), mu
        order by round(abs(mu + b + bias + w1 * x1 + w2 * x2 - rating), 9) desc, 1, 2 limit 25""",
    "solver_comparison": f"""
        with solved as (
            select "userId", case a when 0.1 then 'ridge_0.1' else 'ridge_100.0' end as solver, b, w1, w2
            from ({fold_sql("warm2", "0.1, 100")})
            union all select "userId", 'least_squares', b, w1, w2 from least2)
        select solver, count(*) as n_test, round(sqrt(avg((mu + b + bias + w1 * x1 + w2 * x2 - rating) ** 2)), 6) as rmse
        from warm2 join solved using ("userId"), mu group by 1""",
    "alpha_spread": f"""
        select f.a as alpha,
               round(stddev_pop(mu + b + bias + w1 * x1 + w2 * x2), 6) as pred_spread
        from warm2 w join ({fold_sql("warm2", "0.1, 100")}) f using ("userId"), mu group by 1""",
    "predict_pairs": """
        select p."userId", p."movieId", round(raw, 6) as raw, round(score, 6) as predicted
        from profile p join (
            select u."userId", f."movieId", mu + b + bias + w1 * x1 + w2 * x2 as raw,
                   greatest(0.5::double, least(5.0::double, mu + b + bias + w1 * x1 + w2 * x2)) as score
            from fold2 u, f2 f, mu) s using ("userId", "movieId")""",
    "recommend_topn": _top(UNRATED, 5, ", title, genres", source="all_scores64"),
    "recommend_full": _top(UNRATED, 5, ", title", source="all_scores64"),
    "recommend_filtered": _top(UNRATED + """ and s."movieId" in (
        select "movieId" from items where contains(lower(genres), 'brand#1')
        and contains(lower(genres), 'o')) and s."movieId" in (
        select "movieId" from ratings group by 1 having count(*) >= 25)""", 5, ", genres"),
    "support_filter": _top(UNRATED + " and support >= 0.999", 5,
                           ", round(support, 6) as support", source="supported"),
    "popularity": """select "movieId", round(mu + bias, 6) as score from f2, mu""",
    "item_cf": """
        select "userId", dim::int as dim, round(sum((rating - mu) * x / greatest(len, 1e-9)), 6) as value
        from ratings r join (
            select "movieId", unnest(vec) as x, unnest(range(64)) as dim,
                   sqrt(list_sum([v * v for v in vec])) as len from f64) f using ("movieId"), mu
        group by 1, 2""",
    "recommend_tiered": TIERED_SCORES64 + """
        select t."userId", t."movieId", title, genres, tier, rank,
               round(predicted_score, 6) as predicted_score
        from (select *, row_number() over (partition by "userId"
                  order by round(predicted_score, 9) desc, "movieId") as rank
              from scored qualify rank <= 25) t join items using ("movieId")""",
    "recommend_tiered_genre": TIERED_SCORES + """
        select "userId", "movieId", tier, rank, round(predicted_score, 6) as predicted_score
        from (select *, row_number() over (partition by "userId"
                  order by predicted_score desc, "movieId") as rank
              from scored where "movieId" in (select "movieId" from items
                                              where contains(lower(genres), 'small'))
              qualify rank <= 3)""",
    "score_components": """
        select "userId", round(min(bias), 6) as popularity_min, round(max(bias), 6) as popularity_max,
               round(stddev_pop(bias), 6) as popularity_std,
               round(min(w1 * x1 + w2 * x2), 6) as personal_min,
               round(max(w1 * x1 + w2 * x2), 6) as personal_max,
               round(stddev_pop(w1 * x1 + w2 * x2), 6) as personal_std,
               round(stddev_pop(w1 * x1 + w2 * x2) / stddev_pop(bias), 6) as std_ratio
        from fold2, f2 group by 1""",
    "predict_requests": """
        with found as (select title, year, count(*) as n, min("movieId") as "movieId"
                       from title_hits group by 1, 2),
        requests as (
            select 't' || e."userId" || '-' || e.line_no as request_id, e."userId",
                   case when n = 1 then "movieId" end as "movieId",
                   case when n is null then h.id end as tmdb_id,
                   case when n > 1 then 'ambiguous' when n is null and h.id is null then 'not_found'
                   end as problem
            from export e left join found f on f.title = e.title and f.year = e.year
            left join hits h on h.title = e.title and h.year is not distinct from e.year
            union all
            select 'e' || line_no, "userId", p."movieId" * 23, null,
                   case when i."movieId" is null then 'not_found' end
            from profile_events p left join items i on i."movieId" = p."movieId" * 23),
        reps as (
            select i."movieId", case when f."movieId" is not null then 'warm'
                       when c."movieId" is not null then 'cold' else 'unscorable' end as kind,
                   case when f."movieId" is not null then f.bias else cb end as ib,
                   case when f."movieId" is not null then x1 else c1 end as i1,
                   case when f."movieId" is not null then x2 else c2 end as i2
            from items i left join f2 f using ("movieId") left join content2 c using ("movieId")),
        answers as (
            select q.request_id, q."userId", q."movieId", q.tmdb_id, o.rating as own_rating,
                   coalesce(problem, case
                       when coalesce(i1, k.c1) is null then 'unscorable'
                       when u.b is null then 'too_few' else coalesce(kind, 'cold') end) as status,
                   mu + b + coalesce(ib, k.cb) + w1 * coalesce(i1, k.c1) + w2 * coalesce(i2, k.c2) as raw
            from requests q left join reps r on r."movieId" = q."movieId"
            left join catalog_content2 k on k."movieId" = q.tmdb_id
            left join fold2 u on u."userId" = q."userId"
            left join ratings o on o."userId" = q."userId" and o."movieId" = q."movieId", mu)
        select * replace (case when status in ('warm', 'cold') then round(raw, 6) end as raw),
               case when status in ('warm', 'cold') then
                   round(greatest(0.5::double, least(5.0::double, raw)), 6) end as predicted
        from answers""",
    "demo_profile": ("""
        select "userId", "movieId", rank, round(raw, 6) as raw, round(score, 6) as score from (
            select u."userId", f."movieId", mu + b + bias + w1 * x1 + w2 * x2 as raw,
                   greatest(0.5::double, least(5.0::double, mu + b + bias + w1 * x1 + w2 * x2)) as score,
                   row_number() over (partition by u."userId" order by
                       greatest(0.5::double, least(5.0::double, mu + b + bias + w1 * x1 + w2 * x2))
                       desc, f."movieId") as rank
            from demo_fold u, f2 f semi join items i on i."movieId" = f."movieId", mu
            where not exists (select 1 from demo_rows d where d."userId" = u."userId"
                              and d."movieId" = f."movieId")
            qualify rank <= 15)""", {
        "demo_rows": """
            select e."userId", e.rating, h."movieId"
            from export e join (select title, year, min("movieId") as "movieId" from title_hits
                                group by 1, 2) h on h.title = e.title and h.year = e.year
""",
        "demo_warm": """
            select d.*, x1, x2, d.rating - mu - bias as y
            from demo_rows d join f2 using ("movieId"), mu""",
        "demo_fold": fold_sql("demo_warm", "100")}),
    "holdout_split": "select * from split",
    "holdout_metrics": (f"""
        with users as ({fold_sql("train2", "100")}),
        scored as (
            select s.rating, mu + u.b as base, u.w1 * x1 + u.w2 * x2 + f.bias as identity,
                   coalesce(u.w1 * c1 + u.w2 * c2 + cb, 0) as extra
            from split s join f2 f on f."movieId" = s."movieId"
            left join content2 c on c."movieId" = s."movieId"
            join users u on u."userId" = s."userId", mu where part = 'test'),
        rows as (select rating, unnest(['hybrid', 'identity_only', 'content_only']) as variant,
                        unnest([base + identity + extra, base + identity, base + extra]) as p from scored)
        select variant, count(*) as n_test, round(sqrt(avg((p - rating) ** 2)), 6) as rmse,
               round(avg(abs(p - rating)), 6) as mae from rows group by 1""", TRAIN_FOLD),
    "draws": """
        select "userId", n::bigint as n, draw::bigint as draw, "movieId" from draw_rows""",
    "loo_cascade": """
        select "userId", k::bigint as k, n::bigint as n, alpha, n_draws,
               round(mean_rmse, 6) as mean_rmse, round(std_rmse, 6) as std_rmse from cascade""",
    "cascade_stored": """
        select "userId", k::bigint as k, n::bigint as n, alpha, n_draws,
               round(mean_rmse, 6) as mean_rmse, round(std_rmse, 6) as std_rmse from cascade""",
    "cascade_best": """
        select "userId", n::bigint as n, k::bigint as best_k, alpha as best_alpha,
               round(round(mean_rmse, 9), 6) as best_mean_rmse from cascade
        qualify row_number() over (partition by "userId", n
            order by round(mean_rmse, 9), k, alpha) = 1""",
    "sanity_check": """
        select "userId", k::bigint as k, alpha, count(*) as n,
               round(sqrt(avg(error * error)), 6) as rmse from sanity_loo group by 1, 2, 3""",
    "train_mf_one_factor": (_progress(2), train_sql(2, False)),
    "train_hybrid_one_factor": (_progress(2), train_sql(2, True)),
    "continued_training": (_progress(2, ""), train_sql(2, False)),
    "trained_factors": ("""
        select 'svd' as tag, "movieId", round(x, 6) as x, round(bias, 6) as bias from items_2""", train_sql(2, False)),
    "joint_user": ("""
        select "userId", n, round(bias, 6) as bias, round(x, 6) as w from users_1 where "userId" = -1""", {
        **train_sql(1, False),
        "joint_ratings": """
            select * from kept union all select -1, "movieId", rating from kept where "userId" = (select min("userId") from ratings)""",
        "joint_mu": "select avg(rating) as mu from joint_ratings",
        "total_0": train_sql(1, False)["total_0"].replace("from biases", """from (
            select "movieId", sum(rating - mu) / (count(*) + 10.0::double) as bias from joint_ratings, joint_mu group by 1)"""),
        "by_user_1": train_sql(1, False)["by_user_1"].replace("from kept", "from joint_ratings").replace(", mu", ", joint_mu")}),
    "training_fit": """
        select count(*) as n_test, round(sqrt(avg((mu + b + bias + w1 * x1 + w2 * x2 - rating) ** 2)), 6) as rmse,
               round(avg(abs(mu + b + bias + w1 * x1 + w2 * x2 - rating)), 6) as mae
        from warm2 w join fold2 f using ("userId"), mu""",
    "result_tables": "select * from classified",
    "record_lines": """
        select p_partkey * 10 as tmdb_id, coalesce(vote_count, 0) + case when p_partkey % 2 = 0 then 1 else 0 end as vote_count,
               case when p_partkey % 11 = 0 then 0 else p_size::double end as runtime,
               case when p_partkey % 7 = 0 then 0 else p_retailprice end as budget,
               case when p_partkey % 29 = 0 then '' else concat(cast(1980 + p_partkey % 41 as varchar), '-06-15') end as release_date,
               coalesce(lang, '') as original_language,
               len([x for x in regexp_split_to_array(coalesce(text, ''), '\\s+') if x <> '']) as n_keywords
        from part left join votes v on v."movieId" = p_partkey left join documents on doc_id = p_partkey""",
    "stream_features": """
        select "movieId", feature_id::int as feature_id, round(value, 6) as value from feature_rows""",
    "stream_record_keys": """select "movieId", 1::bigint as n from profile_events group by 1""",
    "stream_fold_in": (f"""
        select "userId", n, round(b, 6) as bias, {R2} from ({fold_sql("live2", "100")})""", {
        "live2": """
            select p."userId", x1, x2, p.rating - mu - bias as y
            from profile p join f2 using ("movieId"), mu"""}),
    "stream_fold_in_batches": (f"""
        select "userId", n, round(b, 6) as bias, {R2} from ({fold_sql("live2", "100")})""", {
        "live2": """
            select p."userId", x1, x2, p.rating - mu - bias as y
            from profile p join f2 using ("movieId"), mu"""}),
    "stream_records": """
        select "movieId", "userId", rating, line_no from profile_events
        qualify row_number() over (partition by "movieId" order by line_no desc) = 1""",
    "text_functions": """
        select doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) as n_tokens,
               md5(array_to_string(list_sort(list_distinct(
                   regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'))), ' ')) as tokens,
               contains(lower(text), 'the') and contains(lower(text), 'an') as has_both
        from documents""",
    "title_functions": """
        select "movieId", case when i."movieId" % 50 <> 0 then i.year end as title_year,
               case when "movieId" % 29 <> 0 then i.year end as year,
               case when "movieId" % 29 <> 0 then i.year else 0 end as year_or_zero,
               case when "movieId" % 29 <> 0 then name || ' (' || i.year || ')' else name end as display,
               case when genres like 'PROMO|%' then substr(genres, 7) else genres end as genres
        from items i""",
    "numeric_functions": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey,
               round(greatest(0.5::double, least(5.0::double, l_quantity / 7 - 1)), 6) as clamped,
               round(ln(1 + l_quantity), 6) as log,
               round((l_quantity * l_tax + 600) / (l_quantity + 100), 6) as bayes,
               round(1.0::double / (l_linenumber + 1), 6) as billing,
               round(1 + ln(l_quantity), 6) as tf,
               round(('0x' || substr(md5(concat_ws('-', '3', l_orderkey, l_linenumber)), 1, 8))::bigint
                     / 4294967296.0::double, 6) as unit
        from lineitem""",
    "vector_functions": """
        with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings)
        select a.vec_id, round(list_dot_product(a.e, b.e), 6) as dot,
               round(list_dot_product(a.e, b.e), 6) as dot_any,
               round(sqrt(list_dot_product(a.e, a.e)), 6) as norm,
               round(list_cosine_similarity(a.e, b.e), 6) as cosine
        from v a join v b on b.vec_id = a.vec_id + 1""",
}
TABLES["supported"] = """
    select s.*, (select max((f.x1 * g.x1 + f.x2 * g.x2) / (sqrt(f.x1 * f.x1 + f.x2 * f.x2)
                        * sqrt(g.x1 * g.x1 + g.x2 * g.x2)))
                 from warm2 g where g."userId" = s."userId") as support
    from all_scores s join f2 f on f."movieId" = s."movieId" """


def _complete(entry: str | tuple[str, dict[str, str]]) -> str:
    if isinstance(entry, str):
        return with_tables(entry)
    sql, local = entry
    extra = {name: body for name, body in local.items() if name not in TABLES}
    TABLES.update(extra)
    try:
        return with_tables(sql, **local)
    finally:
        for name in extra:
            del TABLES[name]


ORACLES: dict[str, str] = {name: _complete(entry) for name, entry in _SQL.items()}
