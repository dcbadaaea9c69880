"""Per-row least-squares curve fits over a small array of points.

Every sample (row) carries its own short series ``array<struct<t,y>>`` of
observed points (≤ a few dozen: days or time columns of one sample), so the
fits are pure projections: ``aggregate`` folds over the array inside
whole-stage codegen, no shuffle, no Python. Three models, as in the
reference: linear, exponential (log-linear on y>0) and quadratic. R² follows
the usual convention: 1 − SSres/SStot, and for a constant series 1 when the
fit is exact, else 0.

All sums are centred (two passes over the tiny array) so R² keeps its
digits. The quadratic is solved by Cramer's rule on centred normal
equations, then de-centred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODELS = ("linear", "exp", "poly")


def _sum(arr: str, body: str) -> str:
    """Σ body over array ``arr`` (lambda variable ``p``)."""
    return f"aggregate({arr}, cast(0 as double), (acc, p) -> acc + ({body}))"


def _r2(arr: str, pred: str) -> str:
    """R² of prediction ``pred`` (in terms of p.t) over points ``arr``.

    Binds the mean once via a one-element transform so each pass is a fold.
    """
    n = f"size({arr})"
    return f"""transform(array({_sum(arr, 'p.y')} / {n}), my ->
        transform(array(struct({_sum(arr, '(p.y - my) * (p.y - my)')} as sst,
                               {_sum(arr, f'(p.y - ({pred})) * (p.y - ({pred}))')} as ssr)), s ->
            case when s.sst = 0 then case when s.ssr = 0 then 1.0D else 0.0D end
                 else 1.0D - s.ssr / s.sst end)[0])[0]"""


def _linear(arr: str) -> str:
    """struct(slope, intercept) of y on t (centred), NULL if < 2 points or t constant."""
    n = f"size({arr})"
    return f"""case when {n} >= 2 then
        transform(array(struct({_sum(arr, 'p.t')} / {n} as mt, {_sum(arr, 'p.y')} / {n} as my)), m ->
          transform(array(struct({_sum(arr, '(p.t - m.mt) * (p.t - m.mt)')} as sxx,
                                 {_sum(arr, '(p.t - m.mt) * (p.y - m.my)')} as sxy)), s ->
            case when s.sxx > 0 then named_struct('a', s.sxy / s.sxx,
                                                  'b', m.my - (s.sxy / s.sxx) * m.mt) end)[0])[0]
      end"""


def _quadratic(arr: str) -> str:
    """named_struct(c2, c1, c0) for y = c2 t² + c1 t + c0; NULL if < 3 points or singular."""
    n = f"size({arr})"
    u = "(p.t - m.mt)"
    v = "(p.y - m.my)"
    sums = ", ".join([
        f"{_sum(arr, f'{u}*{u}')} as s2", f"{_sum(arr, f'{u}*{u}*{u}')} as s3",
        f"{_sum(arr, f'{u}*{u}*{u}*{u}')} as s4", f"{_sum(arr, f'{u}*{v}')} as z1",
        f"{_sum(arr, f'{u}*{u}*{v}')} as z2"])
    # centred normal equations (Σu = Σv = 0):
    # [s4 s3 s2][a]   [z2]
    # [s3 s2 0 ][b] = [z1]
    # [s2 0  n ][c]   [0 ]
    det = f"(s.s4 * (s.s2 * {n}) - s.s3 * (s.s3 * {n}) - s.s2 * s.s2 * s.s2)"
    da = f"(s.z2 * s.s2 * {n} - s.s3 * s.z1 * {n})"
    db = f"(s.s4 * s.z1 * {n} - s.z2 * s.s3 * {n} - s.s2 * s.s2 * s.z1)"
    # c follows from the third equation: s2 a + n c = 0
    return f"""case when {n} >= 3 then
        transform(array(struct({_sum(arr, 'p.t')} / {n} as mt, {_sum(arr, 'p.y')} / {n} as my)), m ->
          transform(array(struct({sums})), s ->
            case when {det} != 0 then
              transform(array(struct({da} / {det} as a, {db} / {det} as b)), k ->
                named_struct('c2', k.a,
                             'c1', k.b - 2 * k.a * m.mt,
                             'c0', k.a * m.mt * m.mt - k.b * m.mt + (m.my - s.s2 * k.a / {n})))[0]
            end)[0])[0]
      end"""


def fit_columns(pts: str, min_points: int = 2) -> dict[str, Column]:
    """Fit all three models on the points column ``pts`` (array<struct<t,y>>).

    Returns Columns: ``lin`` (a, b), ``expo`` (A, B), ``quad`` (c2, c1, c0) and
    ``r2_linear``, ``r2_exp``, ``r2_poly``. A model needs ``min_points``
    points (the quadratic at least 3; the exponential 2 positive ones).
    """
    pos = f"filter({pts}, p -> p.y > 0)"
    lin = _linear(pts)
    loglin = _linear(f"transform({pos}, p -> named_struct('t', p.t, 'y', ln(p.y)))")
    quad = _quadratic(pts)
    enough = f"size({pts}) >= {min_points}"
    return {
        "lin": F.expr(f"case when {enough} then {lin} end"),
        "expo": F.expr(f"case when {enough} and size({pos}) >= 2 then "
                       f"transform(array({loglin}), k -> case when k is not null then "
                       f"named_struct('A', exp(k.b), 'B', k.a) end)[0] end"),
        "quad": F.expr(f"case when {enough} then {quad} end"),
    }


def add_fits(df: DataFrame, pts: str = "pts", min_points: int = 2) -> DataFrame:
    """Add fitted coefficients and R² of every model per row.

    Six folds over the (short) points array in total, each materialised as a
    struct column so later expressions reuse it instead of re-folding:
    means; centred moments (shared by the linear and quadratic fits and
    their SStot); residual sums of both; and the same three for the
    log-linear fit on the positive points.
    """
    n = f"size({pts})"
    df = df.withColumn("__m", F.expr(
        f"aggregate({pts}, named_struct('st', 0D, 'sy', 0D), (a, p) -> named_struct('st', a.st + p.t, 'sy', a.sy + p.y),"
        f" a -> named_struct('mt', a.st / {n}, 'my', a.sy / {n}))"))
    df = df.withColumn("__c", F.expr(
        f"""aggregate({pts}, named_struct('s2', 0D, 's3', 0D, 's4', 0D, 'z1', 0D, 'z2', 0D, 'syy', 0D), (a, p) ->
            named_struct('s2', a.s2 + (p.t - __m.mt) * (p.t - __m.mt),
                         's3', a.s3 + (p.t - __m.mt) * (p.t - __m.mt) * (p.t - __m.mt),
                         's4', a.s4 + (p.t - __m.mt) * (p.t - __m.mt) * (p.t - __m.mt) * (p.t - __m.mt),
                         'z1', a.z1 + (p.t - __m.mt) * (p.y - __m.my),
                         'z2', a.z2 + (p.t - __m.mt) * (p.t - __m.mt) * (p.y - __m.my),
                         'syy', a.syy + (p.y - __m.my) * (p.y - __m.my)))"""))
    det = f"(__c.s4 * (__c.s2 * {n}) - __c.s3 * (__c.s3 * {n}) - __c.s2 * __c.s2 * __c.s2)"
    qa = f"((__c.z2 * __c.s2 * {n} - __c.s3 * __c.z1 * {n}) / {det})"
    qb = f"((__c.s4 * __c.z1 * {n} - __c.z2 * __c.s3 * {n} - __c.s2 * __c.s2 * __c.z1) / {det})"
    df = df.withColumns({
        "lin": F.expr(f"case when {n} >= {max(min_points, 2)} and __c.s2 > 0 then named_struct("
                      f"'a', __c.z1 / __c.s2, 'b', __m.my - (__c.z1 / __c.s2) * __m.mt) end"),
        "quad": F.expr(f"case when {n} >= {max(min_points, 3)} and {det} != 0 then named_struct("
                       f"'c2', {qa}, 'c1', {qb} - 2 * {qa} * __m.mt,"
                       f" 'c0', {qa} * __m.mt * __m.mt - {qb} * __m.mt + (__m.my - __c.s2 * {qa} / {n})) end"),
        "__pos": F.expr(f"filter({pts}, p -> p.y > 0)"),
    })
    df = df.withColumn("__r", F.expr(
        f"""aggregate({pts}, named_struct('l', 0D, 'q', 0D), (a, p) -> named_struct(
            'l', a.l + coalesce((p.y - (lin.a * p.t + lin.b)) * (p.y - (lin.a * p.t + lin.b)), 0D),
            'q', a.q + coalesce((p.y - (quad.c2 * p.t * p.t + quad.c1 * p.t + quad.c0))
                              * (p.y - (quad.c2 * p.t * p.t + quad.c1 * p.t + quad.c0)), 0D)))"""))
    k = "size(__pos)"
    df = df.withColumn("__em", F.expr(
        f"aggregate(__pos, named_struct('st', 0D, 'sl', 0D, 'sy', 0D), (a, p) -> named_struct("
        f"'st', a.st + p.t, 'sl', a.sl + ln(p.y), 'sy', a.sy + p.y),"
        f" a -> named_struct('mt', a.st / {k}, 'ml', a.sl / {k}, 'my', a.sy / {k}))"))
    df = df.withColumn("__ec", F.expr(
        f"""aggregate(__pos, named_struct('sxx', 0D, 'sxy', 0D), (a, p) -> named_struct(
            'sxx', a.sxx + (p.t - __em.mt) * (p.t - __em.mt),
            'sxy', a.sxy + (p.t - __em.mt) * (ln(p.y) - __em.ml)))"""))
    df = df.withColumn("expo", F.expr(
        f"case when {n} >= {min_points} and {k} >= 2 and __ec.sxx > 0 then named_struct("
        f"'A', exp(__em.ml - (__ec.sxy / __ec.sxx) * __em.mt), 'B', __ec.sxy / __ec.sxx) end"))
    df = df.withColumn("__er", F.expr(
        f"""aggregate(__pos, named_struct('sst', 0D, 'ssr', 0D), (a, p) -> named_struct(
            'sst', a.sst + (p.y - __em.my) * (p.y - __em.my),
            'ssr', a.ssr + coalesce((p.y - expo.A * exp(expo.B * p.t)) * (p.y - expo.A * exp(expo.B * p.t)), 0D)))"""))

    def r2(sst, ssr):
        return f"case when {sst} = 0 then case when {ssr} = 0 then 1.0D else 0.0D end else 1.0D - {ssr} / {sst} end"
    df = df.withColumns({
        "r2_linear": F.expr(f"case when lin is not null then {r2('__c.syy', '__r.l')} end"),
        "r2_exp": F.expr(f"case when expo is not null then {r2('__er.sst', '__er.ssr')} end"),
        "r2_poly": F.expr(f"case when quad is not null then {r2('__c.syy', '__r.q')} end"),
    })
    return df.drop("__m", "__c", "__pos", "__r", "__em", "__ec", "__er")


def choose_model(model: str = "best", r2_threshold: float = 0.0) -> Column:
    """Highest R² (ties: linear, exp, poly order) or a forced model; 'none'
    when the chosen R² is missing or below the threshold."""
    if model == "best":
        l, e, p = F.col("r2_linear"), F.col("r2_exp"), F.col("r2_poly")
        best = (F.when(l.isNotNull() & (e.isNull() | (l >= e)) & (p.isNull() | (l >= p)), "linear")
                .when(e.isNotNull() & (p.isNull() | (e >= p)), "exp")
                .when(p.isNotNull(), "poly"))
    elif model in MODELS:
        best = F.lit(model)
    else:
        raise ValueError(f"unknown model {model!r}; choose best, linear, exp or poly")
    r2 = (F.when(best == "linear", F.col("r2_linear")).when(best == "exp", F.col("r2_exp"))
          .when(best == "poly", F.col("r2_poly")))
    return F.when(r2.isNotNull() & (r2 >= F.lit(r2_threshold)), best).otherwise(F.lit("none"))


def predict_expr(t: str, model_col: str = "best_model") -> str:
    """SQL expression of the chosen model's prediction at time ``t``."""
    return (f"case {model_col} when 'linear' then lin.a * ({t}) + lin.b "
            f"when 'exp' then expo.A * exp(expo.B * ({t})) "
            f"when 'poly' then quad.c2 * ({t}) * ({t}) + quad.c1 * ({t}) + quad.c0 end")
