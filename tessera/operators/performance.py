"""Wide daily-series pipeline: validity, curve fill, label fill, scoring.

Representation: one row per sample with ``y: array<double>`` and
``tex: array<string>`` indexed by day 0..N (N ≤ 14). The per-sample arrays
are bounded by the number of days, so every step after the single
``groupBy(id)`` is a projection — no shuffle, no Python, no driver loop. The
label-weight table is a small parameter: its size is checked before it is
inlined into the plan as a literal array.
"""

from __future__ import annotations

import re

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import col
from ..functions.text import clean_label
from . import curves

MAX_WEIGHT_LABELS = 10_000


@dataclass
class PipelineConfig:
    """Last day 0–14, model choice, minimum R², per-day weights (default 1)."""
    num_days: int = 14
    model: str = "best"
    r2_threshold: float = 0.0
    day_weights: dict = field(default_factory=dict)

    def __post_init__(self):
        if not 0 <= self.num_days <= 14:
            raise ValueError("num_days must lie in 0..14")
        if self.model not in ("best",) + curves.MODELS:
            raise ValueError(f"unknown model {self.model!r}")

    def weight_for(self, day: int) -> float:
        return float(self.day_weights.get(day, 1.0))


def weight_table(weights: DataFrame, label: str = "label", weight: str = "weight",
                 order: str | None = None) -> list[tuple[str, float]]:
    """J3 lookup as a small ordered list: labels cleaned (X1), blank labels
    dropped (K14), first position kept, last duplicate's weight wins."""
    w = weights.select(clean_label(label).alias("l"), col(weight).cast("double").alias("w"),
                       (col(order) if order else F.monotonically_increasing_id()).alias("pos"))
    w = w.filter(F.col("l").isNotNull())
    small = (w.groupBy("l").agg(F.min("pos").alias("first"), F.max_by("w", "pos").alias("w"))
             .orderBy("first").limit(MAX_WEIGHT_LABELS + 1).collect())
    if len(small) > MAX_WEIGHT_LABELS:
        raise ValueError("label weight table too large to inline; join it instead")
    return [(r["l"], r["w"]) for r in small]


def _weights_literal(table: list[tuple[str, float]]) -> str:
    items = ", ".join(
        "named_struct('l', '{}', 'w', cast({!r} as double))".format(l.replace("'", "\\'"), float(w))
        for l, w in table)
    return f"array({items})" if items else "cast(array() as array<struct<l:string,w:double>>)"


def day_arrays(long_df: DataFrame, id_col: str = "id", day_col: str = "d", y_col: str = "y",
               label_col: str | None = "texture", num_days: int = 14) -> DataFrame:
    """P1 in long form: (id, d, y, label) → one row per id with day-indexed arrays.

    Rows outside 0..num_days are filtered before the shuffle (pushed to the
    scan when possible); each group then holds at most num_days+1 entries.
    """
    lab = clean_label(label_col) if label_col else F.lit(None).cast("string")
    entries = F.struct(col(day_col).cast("int").alias("k"),
                       F.struct(col(y_col).cast("double").alias("y"), lab.alias("tex")).alias("v"))
    # The arrays are built inside the aggregation, from the sorted entries held once: as a projection above it they would be
    # written out again in every later use by a filter that is pushed down, a lambda's included.
    seq = F.sequence(F.lit(0), F.lit(num_days))

    def by_day(a):
        # of rows with one id and day the least stays
        least = F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["k"] != x["k"]))
        return F.transform(F.array(F.map_from_entries(least)), lambda m: F.struct(*[
            F.transform(seq, lambda i: F.try_element_at(m, i)[c]).alias(c) for c in ("y", "tex")]))[0]

    return (long_df.filter(col(day_col).between(0, num_days))
            .groupBy(col(id_col).alias("id"))
            .agg(F.transform(F.array(F.sort_array(F.collect_list(entries))), by_day)[0].alias("days"))
            .select("id", "days.y", "days.tex"))


# What the headers of volume and label columns contain.
DAY_KINDS = ("foam(cc)", "texture")


def header_slot(name: str) -> tuple[str, int] | None:
    """Kind and sort key of a day column's header; None for other columns.

    'Day d - …' sorts by 10·d; a bare header by its '.n' suffix (none: 0, '.n': n + 1, not a number: last).
    """
    flat = name.strip().lower().replace(" ", "")
    kind = next((k for k in DAY_KINDS if k in flat), None)
    if kind is None or "score" in flat:
        return None
    if day := re.match(r"day(\d+)-", flat):
        return kind, 10 * int(day[1])
    _, dot, suffix = flat.rpartition(".")
    return kind, 0 if not dot else int(suffix) + 1 if suffix.isdigit() else 9999


def map_day_columns(columns: list[str]) -> tuple[dict[int, str], dict[int, str]]:
    """Volume and label columns by day; days are numbered 0, 1, … in the order of the keys (quirk K9 kept)."""
    slots = [(slot, i) for i, name in enumerate(columns) if (slot := header_slot(name))]
    by_kind = ([columns[i] for (k, _), i in sorted(slots, key=lambda x: (x[0][1], x[1])) if k == kind] for kind in DAY_KINDS)
    return tuple(dict(enumerate(names)) for names in by_kind)


def day_arrays_from_wide(df: DataFrame, id_col: str, num_days: int = 14) -> DataFrame:
    """P1 + X2 + X1 on a wide table: one projection to (id, y[], tex[])."""
    from ..functions.text import to_volume
    foam, tex = map_day_columns(df.columns)
    n = min(num_days, max(foam) if foam else -1)
    ys = [to_volume(foam[d]) if d in foam else F.lit(None).cast("double") for d in range(n + 1)]
    ts = [clean_label(tex[d]) if d in tex else F.lit(None).cast("string") for d in range(n + 1)]
    return df.select(col(id_col).alias("id"), F.array(*ys).alias("y"), F.array(*ts).alias("tex"))


def valid_sample_expr(y: str = "y") -> str:
    """≥2 days, first and last present, no two adjacent missing days."""
    return (f"(size({y}) >= 2 and {y}[0] is not null and {y}[size({y}) - 1] is not null and "
            f"not exists(sequence(0, size({y}) - 2), i -> {y}[i] is null and {y}[i + 1] is null))")


def fill_curves(df: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Fit every model on observed days, choose one, fill missing days."""
    df = df.withColumn("pts", F.expr(
        "filter(transform(sequence(0, size(y) - 1), i -> named_struct('t', cast(i as double), 'y', y[i])),"
        " p -> p.y is not null)"))
    df = curves.add_fits(df, "pts", min_points=2)
    df = df.withColumn("best_model", curves.choose_model(cfg.model, cfg.r2_threshold))
    pred = curves.predict_expr("cast(i as double)")
    return df.withColumn("y_filled", F.expr(
        f"transform(sequence(0, size(y) - 1), i -> coalesce(y[i], {pred}))"))


def fill_labels(df: DataFrame, table: list[tuple[str, float]], tex: str = "tex",
                out: str = "tex_filled") -> DataFrame:
    """P10: sequential neighbour fill of unknown labels.

    A day whose label is not in the table takes the label whose weight is
    nearest the mean of the nearest known weights before (including earlier
    fills) and after (original values); ties go to the first label in the
    table; no extrapolation at the edges. Expressed as one ``aggregate`` fold.
    """
    W = _weights_literal(table)
    wt = f"filter({W}, e -> e.l = {tex}[i])"
    known = f"transform(sequence(0, size({tex}) - 1), i -> try_element_at({wt}, 1).w)"
    fold = f"""transform(array({known}), kw ->
      aggregate(sequence(0, size({tex}) - 1),
        named_struct('prev', cast(null as double), 'out', cast(array() as array<string>)),
        (acc, i) ->
          case when kw[i] is not null
                 then named_struct('prev', kw[i], 'out', concat(acc.out, array({tex}[i])))
               when acc.prev is not null and
                    try_element_at(filter(slice(kw, i + 2, size(kw)), x -> x is not null), 1) is not null
                 then transform(array(array_min(transform({W}, (e, j) -> named_struct(
                        'dist', abs(e.w - (acc.prev + try_element_at(filter(slice(kw, i + 2, size(kw)),
                                                                    x -> x is not null), 1)) / 2),
                        'pos', j, 'w', e.w, 'l', e.l)))),
                        b -> named_struct('prev', b.w, 'out', concat(acc.out, array(b.l))))[0]
               else named_struct('prev', acc.prev, 'out', concat(acc.out, array({tex}[i])))
          end,
        acc -> acc.out))[0]"""
    return df.withColumn(out, F.expr(fold))


def score(df: DataFrame, table: list[tuple[str, float]], cfg: PipelineConfig,
          y: str = "y_filled", tex: str = "tex_filled") -> DataFrame:
    """Σ w_d·volume, Σ w_d·label weight, index = sum; missing adds 0."""
    W = _weights_literal(table)
    dw = "array(" + ", ".join(f"cast({cfg.weight_for(d)!r} as double)" for d in range(cfg.num_days + 1)) + ")"
    vol = f"aggregate(sequence(0, size({y}) - 1), 0D, (a, i) -> a + coalesce({dw}[i] * {y}[i], 0D))"
    tx = (f"aggregate(sequence(0, size({tex}) - 1), 0D, (a, i) -> a + coalesce({dw}[i] * "
          f"try_element_at(filter({W}, e -> e.l = {tex}[i]), 1).w, 0D))")
    return (df.withColumn("score_volume", F.expr(vol))
              .withColumn("score_texture", F.expr(tx))
              .withColumn("performance_index", F.col("score_volume") + F.col("score_texture")))


def unmatched_labels_expr(table: list[tuple[str, float]], tex: str = "tex_filled") -> str:
    W = _weights_literal(table)
    return f"filter({tex}, x -> x is not null and not exists({W}, e -> e.l = x))"


def performance_index(long_df: DataFrame, weights: DataFrame, cfg: PipelineConfig | None = None,
                      id_col: str = "id", day_col: str = "d", y_col: str = "y",
                      label_col: str = "texture", weight_label: str = "label",
                      weight_col: str = "weight") -> DataFrame:
    """End-to-end performance index, one row per sample.

    Invalid samples stay in the output with NULL fits and scores (J2 without
    a join: the validity flag gates every derived column).
    """
    cfg = cfg or PipelineConfig()
    table = weight_table(weights, weight_label, weight_col)
    df = day_arrays(long_df, id_col, day_col, y_col, label_col, cfg.num_days)
    df = df.withColumn("valid", F.expr(valid_sample_expr("y")))
    df = fill_curves(df, cfg)
    df = fill_labels(df, table)
    df = score(df, table, cfg)
    gated = ["r2_linear", "r2_exp", "r2_poly", "best_model", "y_filled", "tex_filled",
             "score_volume", "score_texture", "performance_index"]
    df = df.withColumns({c: F.when(F.col("valid"), col(c)) for c in gated})
    df = df.withColumn("unmatched", F.when(F.col("valid"), F.expr(unmatched_labels_expr(table))))
    return df.drop("pts", "lin", "expo", "quad")


def average_best_r2(scored: DataFrame) -> DataFrame:
    """Mean over valid rows of the best R² (NULLs skipped), plus row count."""
    best = F.greatest("r2_linear", "r2_exp", "r2_poly")
    return scored.filter("valid").agg(F.avg(best).alias("avg_best_r2"), F.count("*").alias("n_valid"))


def model_distribution(scored: DataFrame) -> DataFrame:
    """How many valid rows chose each model."""
    return scored.filter("valid").groupBy("best_model").agg(F.count("*").alias("n"))


def missing_labels(scored: DataFrame) -> DataFrame:
    """Distinct labels not found in the weight table, sorted."""
    # outer: a plain explode would first filter on the size of the whole expression, and so evaluate it three times
    return scored.select(F.explode_outer("unmatched").alias("label")).where("label is not null").distinct().orderBy("label")


def day_columns(scored: DataFrame, num_days: int = 14, keep=("id",)) -> DataFrame:
    """Wide output with ``Day d - Foam (cc)`` / ``Day d - Foam Texture``."""
    cols = [F.col(k) for k in keep]
    for d in range(num_days + 1):
        cols.append(F.expr(f"try_element_at(y_filled, {d + 1})").alias(f"Day {d} - Foam (cc)"))
        cols.append(F.expr(f"try_element_at(tex_filled, {d + 1})").alias(f"Day {d} - Foam Texture"))
    return scored.select(*cols, "score_volume", "score_texture", "performance_index")
