"""Queries for half-life (H1–H8), stability (H9) and observation text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import halflife as H
from ..operators import stability as S
from ..sources import views as V
from . import register


def fit_ctes(obs: str, min_pts: int) -> str:
    """DuckDB CTEs fitting linear / exp / quadratic per id over ``obs(id, t, y)``
    (long form, independent of the array code), ending in ``r2`` and the
    coefficient tables ``lin``, ``expo``, ``quad``."""
    return f"""
mean as (select id, avg(t) as mt, avg(y) as my, count(*) as n from {obs} group by id having count(*) >= {min_pts}),
cen as (
  select o.id, m.n, m.mt, m.my,
    sum((o.t - m.mt) * (o.t - m.mt)) as s2, sum((o.t - m.mt) * (o.t - m.mt) * (o.t - m.mt)) as s3,
    sum((o.t - m.mt) * (o.t - m.mt) * (o.t - m.mt) * (o.t - m.mt)) as s4,
    sum((o.t - m.mt) * (o.y - m.my)) as z1, sum((o.t - m.mt) * (o.t - m.mt) * (o.y - m.my)) as z2
  from {obs} o join mean m on o.id = m.id group by o.id, m.n, m.mt, m.my),
lin as (select id, z1 / s2 as a, my - z1 / s2 * mt as b from cen where n >= 2 and s2 > 0),
quad0 as (
  select id, n, mt, my, s2,
    (z2 * s2 * n - s3 * z1 * n) / (s4 * s2 * n - s3 * s3 * n - s2 * s2 * s2) as qa,
    (s4 * z1 * n - z2 * s3 * n - s2 * s2 * z1) / (s4 * s2 * n - s3 * s3 * n - s2 * s2 * s2) as qb
  from cen where n >= 3 and (s4 * s2 * n - s3 * s3 * n - s2 * s2 * s2) != 0),
quad as (select id, qa as c2, qb - 2 * qa * mt as c1, qa * mt * mt - qb * mt + (my - s2 * qa / n) as c0 from quad0),
pos as (select o.id, o.t, o.y, ln(o.y) as ly from {obs} o join mean m on o.id = m.id where o.y > 0),
pmean as (select id, avg(t) as mt, avg(ly) as ml, count(*) as n from pos group by id),
expo as (
  select p.id, exp(m.ml - sum((p.t - m.mt) * (p.ly - m.ml)) / sum((p.t - m.mt) * (p.t - m.mt)) * m.mt) as A,
         sum((p.t - m.mt) * (p.ly - m.ml)) / sum((p.t - m.mt) * (p.t - m.mt)) as B
  from pos p join pmean m on p.id = m.id where m.n >= 2 group by p.id, m.mt, m.ml
  having sum((p.t - m.mt) * (p.t - m.mt)) > 0),
r2l as (
  select o.id, sum((o.y - m.my) * (o.y - m.my)) as sst, sum((o.y - (l.a * o.t + l.b)) * (o.y - (l.a * o.t + l.b))) as ssr
  from {obs} o join mean m on o.id = m.id join lin l on o.id = l.id group by o.id),
r2q as (
  select o.id, sum((o.y - m.my) * (o.y - m.my)) as sst,
         sum((o.y - (q.c2 * o.t * o.t + q.c1 * o.t + q.c0)) * (o.y - (q.c2 * o.t * o.t + q.c1 * o.t + q.c0))) as ssr
  from {obs} o join mean m on o.id = m.id join quad q on o.id = q.id group by o.id),
r2e as (
  select p.id, sum((p.y - pm.my) * (p.y - pm.my)) as sst,
         sum((p.y - e.A * exp(e.B * p.t)) * (p.y - e.A * exp(e.B * p.t))) as ssr
  from pos p join (select id, avg(y) as my from pos group by id) pm on p.id = pm.id
  join expo e on p.id = e.id group by p.id),
r2 as (
  select m.id,
    case when l.sst = 0 then case when l.ssr = 0 then 1.0 else 0.0 end else 1 - l.ssr / l.sst end as r2_linear,
    case when e.sst = 0 then case when e.ssr = 0 then 1.0 else 0.0 end else 1 - e.ssr / e.sst end as r2_exp,
    case when q.sst = 0 then case when q.ssr = 0 then 1.0 else 0.0 end else 1 - q.ssr / q.sst end as r2_poly
  from mean m left join r2l l on m.id = l.id left join r2e e on m.id = e.id left join r2q q on m.id = q.id)"""


def _best(threshold: float) -> str:
    return f"""
pick as (
  select id, r2_linear, r2_exp, r2_poly,
    case when r2_linear is not null and (r2_exp is null or r2_linear >= r2_exp)
              and (r2_poly is null or r2_linear >= r2_poly) then 'linear'
         when r2_exp is not null and (r2_poly is null or r2_exp >= r2_poly) then 'exp'
         when r2_poly is not null then 'poly' end as m0 from r2),
best as (
  select id, r2_linear, r2_exp, r2_poly,
    case when (case m0 when 'linear' then r2_linear when 'exp' then r2_exp when 'poly' then r2_poly end) >= {threshold}
         then m0 else 'none' end as best_model from pick)"""


HL_SQL = ("with obs as (select id, cast(t as double) as t, y from decay_long where y is not null),"
          + fit_ctes("obs", 3) + "," + _best(0.8) + """,
ids as (select id, arg_min(y, t) as y0, count(*) as n from obs group by id),
hl as (
  select i.id, i.y0, coalesce(b.best_model, 'none') as method_used,
    case coalesce(b.best_model, 'none')
      when 'linear' then case when l.a != 0 then (0.5 * i.y0 - l.b) / l.a end
      when 'exp' then case when e.A > 0 and e.B != 0 and i.y0 > 0 then (ln(0.5 * i.y0) - ln(e.A)) / e.B end
      when 'poly' then case
          when q.c2 = 0 then case when q.c1 != 0 and -(q.c0 - 0.5 * i.y0) / q.c1 >= 0 then -(q.c0 - 0.5 * i.y0) / q.c1 end
          when q.c1 * q.c1 - 4 * q.c2 * (q.c0 - 0.5 * i.y0) < 0 then null
          else (select min(r) from (select unnest([(-q.c1 - sqrt(q.c1 * q.c1 - 4 * q.c2 * (q.c0 - 0.5 * i.y0))) / (2 * q.c2),
                                                   (-q.c1 + sqrt(q.c1 * q.c1 - 4 * q.c2 * (q.c0 - 0.5 * i.y0))) / (2 * q.c2)]) as r)
                where r >= 0) end
    end as tmin,
    b.r2_linear, b.r2_exp, b.r2_poly
  from ids i left join best b on i.id = b.id left join lin l on i.id = l.id left join expo e on i.id = e.id
  left join quad q on i.id = q.id)
""")


@register("h8_half_life_decay", views=("decay_long",),
          digits={"r2_linear": 6, "r2_exp": 6, "r2_poly": 6, "y0": 4},
          ops="H1 H2 H4 H5 H6 H7 H8 P4 P5 P6 P7",
          sql=HL_SQL + """select id, y0, method_used, r2_linear, r2_exp, r2_poly,
  round_even(case when tmin >= 0 then tmin / 60.0 end, 2) as half_life from hl""")
def h8_q(spark, sf):
    pts = H.points_from_long(V.decay_long(spark, sf))
    ev = H.evaluate(pts, 0.8)
    out = H.half_life(ev, "best")
    return out.select("id", "y0", "method_used", "r2_linear", "r2_exp", "r2_poly", "half_life")


@register("h2_model_counts_decay", views=("decay_long",), ops="H2 P9",
          sql=HL_SQL + "select method_used as best_model, count(*) as n from hl group by method_used")
def h2_q(spark, sf):
    ev = H.evaluate(H.points_from_long(V.decay_long(spark, sf)), 0.8)
    return ev.groupBy("best_model").agg(F.count("*").alias("n"))


def _forced(method):
    def fn(spark, sf):
        ev = H.evaluate(H.points_from_long(V.decay_long(spark, sf)), 0.8)
        return H.half_life(ev, method).select("id", "half_life")
    return fn


_FORCED_EXPR = {
    "linear": "case when l.a != 0 then (0.5 * i.y0 - l.b) / l.a end",
    "exp": "case when e.A > 0 and e.B != 0 and i.y0 > 0 then (ln(0.5 * i.y0) - ln(e.A)) / e.B end",
}
for _m, _e in _FORCED_EXPR.items():
    register(f"h_forced_{_m}_half_life_decay", views=("decay_long",), ops="H5" if _m == "linear" else "H6",
             sql=("with obs as (select id, cast(t as double) as t, y from decay_long where y is not null),"
                  + fit_ctes("obs", 3) + """,
ids as (select id, arg_min(y, t) as y0 from obs group by id)
select i.id, round_even(case when (""" + _e + ") >= 0 then (" + _e + """) / 60.0 end, 2) as half_life
from ids i left join lin l on i.id = l.id left join expo e on i.id = e.id"""))(_forced(_m))


# ---------------------------------------------------------------- H9 / X6 / X7 / X17

NORM_SQL = "nullif(nullif(lower(trim(regexp_replace(txt, '[._\\-\\s\\x{a0}]+', ' ', 'g'))), ''), 'nan')"
NORM_SQL = "nullif(nullif(lower(trim(regexp_replace(txt, '[._\\-\\s' || chr(160) || ']+', ' ', 'g'))), ''), 'nan')"
BAD_SQL = ("regexp_matches(regexp_replace({t}, '(?i)no\\s(precip\\w*|gel|unstable)\\b', '', 'g'), "
           "'(?i)\\b(precip\\w*|gel|unstable)\\b')")


@register("h9_stability_obs", views=("obs_long",), ops="H9 X6 X7",
          sql=f"""with o as (select id, d, {NORM_SQL} as t from obs_long),
b as (select id, d, t, t is not null and {BAD_SQL.format(t='t')} as bad from o),
g as (select id, min(case when bad then d end) as shelf_life_days,
             coalesce(max(case when t is not null then d end), 0) as max_day,
             bool_or(bad and d <= 14) as bad_14, bool_or(bad and d <= 30) as bad_30 from b group by id)
select id, shelf_life_days,
  case when bad_14 then false when max_day < 14 then null else true end as stable_14d,
  case when bad_30 then false when max_day < 30 then null else true end as stable_30d from g""")
def h9_q(spark, sf):
    return S.stability(V.obs_long(spark, sf))


@register("x17_observation_audit", views=("obs_long",), ops="X17 X6",
          sql=f"select distinct trim(txt) as original, {NORM_SQL} as normalised from obs_long where txt is not null")
def x17_q(spark, sf):
    return S.normalisation_audit(V.obs_long(spark, sf))
