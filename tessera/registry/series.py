"""Queries for the wide daily-series pipeline (P) over ``foam_long``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import performance as P
from ..sources import views as V
from . import register

# DuckDB: X1 label cleaning
CLEAN_TEX = ("nullif(nullif(trim(regexp_replace(regexp_replace(replace(lower(trim(texture)), chr(160), ' '),"
             " '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')), ''), 'nan')")

# Shared oracle body: grid, validity, three fits, choice, fill, sequential label fill, scores.
FOAM_ORACLE = f"""
with recursive
tw as (select label, weight, row_number() over () as pos from texture_weights),
days as (select cast(range as integer) as d from range(0, 15)),
ids as (select distinct id from foam_long),
grid as (
  select i.id, days.d, f.y, {CLEAN_TEX} as tex
  from ids i cross join days left join foam_long f on f.id = i.id and f.d = days.d),
adj as (select id, d, y, lead(y) over (partition by id order by d) as y_next from grid),
valid as (
  select id,
    (max(case when d = 0 and y is not null then 1 else 0 end) = 1
     and max(case when d = 14 and y is not null then 1 else 0 end) = 1
     and sum(case when d < 14 and y is null and y_next is null then 1 else 0 end) = 0) as valid
  from adj group by id),
obs as (select g.id, cast(g.d as double) as t, g.y from grid g join valid v on g.id = v.id
        where v.valid and g.y is not null),
mean as (select id, avg(t) as mt, avg(y) as my, count(*) as n from obs group by id),
cen as (
  select o.id, m.n, m.mt, m.my,
    sum((o.t - m.mt) * (o.t - m.mt)) as s2, sum((o.t - m.mt) * (o.t - m.mt) * (o.t - m.mt)) as s3,
    sum((o.t - m.mt) * (o.t - m.mt) * (o.t - m.mt) * (o.t - m.mt)) as s4,
    sum((o.t - m.mt) * (o.y - m.my)) as z1, sum((o.t - m.mt) * (o.t - m.mt) * (o.y - m.my)) as z2
  from obs o join mean m on o.id = m.id group by o.id, m.n, m.mt, m.my),
lin as (select id, z1 / s2 as a, my - z1 / s2 * mt as b from cen where n >= 2 and s2 > 0),
quad0 as (
  select id, n, mt, my, s2,
    (z2 * s2 * n - s3 * z1 * n) / (s4 * s2 * n - s3 * s3 * n - s2 * s2 * s2) as qa,
    (s4 * z1 * n - z2 * s3 * n - s2 * s2 * z1) / (s4 * s2 * n - s3 * s3 * n - s2 * s2 * s2) as qb
  from cen where n >= 3 and (s4 * s2 * n - s3 * s3 * n - s2 * s2 * s2) != 0),
quad as (select id, qa as c2, qb - 2 * qa * mt as c1, qa * mt * mt - qb * mt + (my - s2 * qa / n) as c0
         from quad0),
pos as (select id, t, y, ln(y) as ly from obs where y > 0),
pmean as (select id, avg(t) as mt, avg(ly) as ml, count(*) as n from pos group by id),
expo as (
  select p.id, exp(m.ml - sum((p.t - m.mt) * (p.ly - m.ml)) / sum((p.t - m.mt) * (p.t - m.mt)) * m.mt) as A,
         sum((p.t - m.mt) * (p.ly - m.ml)) / sum((p.t - m.mt) * (p.t - m.mt)) as B
  from pos p join pmean m on p.id = m.id where m.n >= 2 group by p.id, m.mt, m.ml
  having sum((p.t - m.mt) * (p.t - m.mt)) > 0),
r2l as (
  select o.id, sum((o.y - m.my) * (o.y - m.my)) as sst,
         sum((o.y - (l.a * o.t + l.b)) * (o.y - (l.a * o.t + l.b))) as ssr
  from obs o join mean m on o.id = m.id join lin l on o.id = l.id group by o.id),
r2q as (
  select o.id, sum((o.y - m.my) * (o.y - m.my)) as sst,
         sum((o.y - (q.c2 * o.t * o.t + q.c1 * o.t + q.c0)) * (o.y - (q.c2 * o.t * o.t + q.c1 * o.t + q.c0))) as ssr
  from obs o join mean m on o.id = m.id join quad q on o.id = q.id group by o.id),
r2e as (
  select p.id, sum((p.y - pm.my) * (p.y - pm.my)) as sst,
         sum((p.y - e.A * exp(e.B * p.t)) * (p.y - e.A * exp(e.B * p.t))) as ssr
  from pos p join (select id, avg(y) as my from pos group by id) pm on p.id = pm.id
  join expo e on p.id = e.id group by p.id),
r2 as (
  select v.id,
    case when l.sst = 0 then case when l.ssr = 0 then 1.0 else 0.0 end else 1 - l.ssr / l.sst end as r2_linear,
    case when e.sst = 0 then case when e.ssr = 0 then 1.0 else 0.0 end else 1 - e.ssr / e.sst end as r2_exp,
    case when q.sst = 0 then case when q.ssr = 0 then 1.0 else 0.0 end else 1 - q.ssr / q.sst end as r2_poly
  from valid v left join r2l l on v.id = l.id left join r2e e on v.id = e.id left join r2q q on v.id = q.id
  where v.valid),
pick as (
  select id, r2_linear, r2_exp, r2_poly,
    case when r2_linear is not null and (r2_exp is null or r2_linear >= r2_exp)
              and (r2_poly is null or r2_linear >= r2_poly) then 'linear'
         when r2_exp is not null and (r2_poly is null or r2_exp >= r2_poly) then 'exp'
         when r2_poly is not null then 'poly' end as m0
  from r2),
best as (
  select id, r2_linear, r2_exp, r2_poly,
    case when (case m0 when 'linear' then r2_linear when 'exp' then r2_exp when 'poly' then r2_poly end) >= 0
         then m0 else 'none' end as best_model
  from pick),
filled as (
  select g.id, g.d, g.tex,
    coalesce(g.y, case b.best_model when 'linear' then l.a * g.d + l.b
                                    when 'exp' then e.A * exp(e.B * g.d)
                                    when 'poly' then q.c2 * g.d * g.d + q.c1 * g.d + q.c0 end) as y_filled
  from grid g join best b on g.id = b.id left join lin l on g.id = l.id left join expo e on g.id = e.id
  left join quad q on g.id = q.id),
known as (
  select f.id, f.d, f.tex, tw.weight as w,
    first_value(tw.weight ignore nulls) over (partition by f.id order by f.d
        rows between 1 following and unbounded following) as nxt
  from filled f left join tw on f.tex = tw.label),
fill(id, d, tex_f, prev) as (
  select id, d, tex, w from known where d = 0
  union all
  select k.id, k.d,
    case when k.w is not null then k.tex
         when f.prev is not null and k.nxt is not null then
           (select label from tw order by abs(weight - (f.prev + k.nxt) / 2), pos limit 1)
         else k.tex end,
    case when k.w is not null then k.w
         when f.prev is not null and k.nxt is not null then
           (select weight from tw order by abs(weight - (f.prev + k.nxt) / 2), pos limit 1)
         else f.prev end
  from fill f join known k on k.id = f.id and k.d = f.d + 1),
scored as (
  select fl.id, sum(coalesce(fi.y_filled, 0)) as score_volume, sum(coalesce(tw.weight, 0)) as score_texture
  from fill fl join filled fi on fl.id = fi.id and fl.d = fi.d left join tw on fl.tex_f = tw.label
  group by fl.id)
"""


@register("p13_performance_index", views=("foam_long", "texture_weights"),
          digits={"r2_linear": 6, "r2_exp": 6, "r2_poly": 6, "score_volume": 4,
                  "score_texture": 4, "performance_index": 4},
          ops="P1 P2 P3 P4 P5 P6 P7 P8 P10 P12 P13 J2 J3 X1",
          sql=FOAM_ORACLE + """
select v.id, v.valid, b.r2_linear, b.r2_exp, b.r2_poly, b.best_model,
       s.score_volume, s.score_texture, s.score_volume + s.score_texture as performance_index
from valid v left join best b on v.id = b.id left join scored s on v.id = s.id""")
def performance_index_q(spark, sf):
    out = P.performance_index(V.foam_long(spark, sf), V.texture_weights(spark))
    return out.select("id", "valid", "r2_linear", "r2_exp", "r2_poly", "best_model",
                      "score_volume", "score_texture", "performance_index")


@register("p8_p10_filled_days", views=("foam_long", "texture_weights"), digits={"y_filled": 4},
          ops="P8 P10 J8",
          sql=FOAM_ORACLE + """
select fl.id, fl.d, fi.y_filled, fl.tex_f as tex_filled
from fill fl join filled fi on fl.id = fi.id and fl.d = fi.d""")
def filled_days_q(spark, sf):
    out = P.performance_index(V.foam_long(spark, sf), V.texture_weights(spark))
    return (out.filter("valid")
            .select("id", F.posexplode(F.arrays_zip("y_filled", "tex_filled")).alias("d", "z"))
            .select("id", F.col("d").cast("int").alias("d"), "z.y_filled", "z.tex_filled"))


@register("p3_valid_samples", views=("foam_long",), ops="P3",
          sql="""
with days as (select cast(range as integer) as d from range(0, 15)),
ids as (select distinct id from foam_long),
grid as (select i.id, days.d, f.y from ids i cross join days
         left join foam_long f on f.id = i.id and f.d = days.d),
adj as (select id, d, y, lead(y) over (partition by id order by d) as y_next from grid)
select id,
  (max(case when d = 0 and y is not null then 1 else 0 end) = 1
   and max(case when d = 14 and y is not null then 1 else 0 end) = 1
   and sum(case when d < 14 and y is null and y_next is null then 1 else 0 end) = 0) as valid,
  cast(count(y) as bigint) as n_observed
from adj group by id""")
def valid_samples_q(spark, sf):
    df = P.day_arrays(V.foam_long(spark, sf), label_col=None)
    return df.select("id", F.expr(P.valid_sample_expr("y")).alias("valid"),
                     F.expr("cast(size(filter(y, x -> x is not null)) as bigint)").alias("n_observed"))


@register("p9_best_r2_summary", views=("foam_long", "texture_weights"), digits={"avg_best_r2": 6},
          ops="P9", sql=FOAM_ORACLE + """
select avg(greatest(r2_linear, r2_exp, r2_poly)) as avg_best_r2, count(*) as n_valid from best""")
def best_r2_q(spark, sf):
    out = P.performance_index(V.foam_long(spark, sf), V.texture_weights(spark))
    return P.average_best_r2(out)


@register("p9_model_distribution", views=("foam_long", "texture_weights"), ops="P9",
          sql=FOAM_ORACLE + "select best_model, count(*) as n from best group by best_model")
def model_dist_q(spark, sf):
    out = P.performance_index(V.foam_long(spark, sf), V.texture_weights(spark))
    return P.model_distribution(out)


@register("j4_missing_labels", views=("foam_long", "texture_weights"), ops="J4 P12",
          sql=FOAM_ORACLE + """
select distinct fl.tex_f as label from fill fl left join tw on fl.tex_f = tw.label
where fl.tex_f is not null and tw.label is null""")
def missing_labels_q(spark, sf):
    out = P.performance_index(V.foam_long(spark, sf), V.texture_weights(spark))
    return P.missing_labels(out)
