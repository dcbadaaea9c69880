"""Derived analysis views over the driver's tables.

Each view exists twice: as a DataFrame builder (what the library runs) and as
DuckDB SQL text (what the oracle inlines as a CTE). They are written
independently so that the oracle is a real cross-check.

Scale notes: every builder is a projection or a grouped aggregate with a
map-side partial aggregation, so a hot key (one user holding a third of all
events) is combined before the shuffle; group sizes after aggregation are
bounded by the number of days / line numbers, never by raw row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .tables import table

# Label weights used by the performance-index views.
TEXTURE_WEIGHTS = [("click", 1.0), ("view", 2.0), ("signup", 3.0), ("purchase", 4.0)]


def foam_long(spark: SparkSession, sf: str) -> DataFrame:
    """(id, d, y, texture): one measurement per sample and day 0..14; a sample
    is a user within one of the 15-day periods that follow 2024-01-01."""
    e = table(spark, sf, "events")
    day = F.datediff("ts", F.lit("2024-01-01"))
    sample = F.col("user_id") * 100_000 + F.floor(day / 15)
    return (e.groupBy(sample.cast("bigint").alias("id"), F.pmod(day, F.lit(15)).cast("int").alias("d"))
            .agg(F.avg("value").alias("y"), F.max("event_type").alias("texture")))


def texture_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXTURE_WEIGHTS, "label string, weight double")


def decay_long(spark: SparkSession, sf: str) -> DataFrame:
    """(id, t, y): mean extended price per order and line number.

    Dealt by id after the aggregation: what collects an id's rows holds several
    groupings at once, and needs no exchange of its own."""
    li = table(spark, sf, "lineitem")
    return spread(li.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("t"))
                  .agg(F.avg("l_extendedprice").alias("y")), "id")


CHEM_COLS = [f"c{i}" for i in range(1, 8)]


def chem_wide(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: dose-like columns c1..c7 (gappy), method, target."""
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders")
    per_order = li.groupBy("l_orderkey").agg(*[
        F.sum(F.when(F.col("l_linenumber") == i, F.col("l_quantity"))).alias(f"c{i}")
        for i in range(1, 8)])
    return (o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("method"),
                     F.col("o_totalprice").alias("target"))
            .join(per_order, F.col("id") == F.col("l_orderkey"), "left")
            .select("id", "method", "target", *CHEM_COLS))


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                     F.nullif(F.col("l_discount"), F.lit(0.0)).alias("disc"),
                     F.nullif(F.col("l_tax"), F.lit(0.0)).alias("tax"),
                     F.nullif(F.col("l_returnflag"), F.lit("N")).alias("flag"))


GAPPY_NUM = ["l_quantity", "l_extendedprice", "disc", "tax"]


def obs_long(spark: SparkSession, sf: str) -> DataFrame:
    """(id, d, txt): one free-text observation per user and day since 2024-01-01."""
    e = table(spark, sf, "events")
    day = F.datediff("ts", F.lit("2024-01-01"))
    txt = (F.when(F.col("event_type") == "error", F.lit("Unstable-Gel.."))
           .when(F.col("event_type") == "signup", F.lit("No_gel"))
           .when(F.col("event_type") == "view", F.lit(""))
           .otherwise(F.lit(" clear ")))
    return (e.groupBy(F.col("user_id").alias("id"), day.alias("d"))
            .agg(F.max(txt).alias("txt")))


def clf_binary(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels")
    doc = table(spark, sf, "documents").select("doc_id", "n_chars")
    return (lab.join(doc, "doc_id")
            .select(F.col("doc_id").alias("id"), F.col("quality").alias("label"),
                    F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("pred"),
                    ((F.col("n_chars") % 97).cast("double") / 97).alias("score")))


def clf_multi(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    q_ = F.col("l_quantity")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
                     F.col("l_returnflag").alias("label"),
                     F.when(q_ < 15, "A").when(q_ < 35, "N").otherwise("R").alias("pred"),
                     (q_ / 50).alias("s_A"), (F.col("l_discount") * 10).alias("s_N"),
                     (F.col("l_tax") * 12.5).alias("s_R"))


def reg(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("y"),
                     (F.lit(2000.0) * F.col("l_quantity")).alias("yhat"))


def lab_log(spark: SparkSession, sf: str) -> DataFrame:
    """(file, line_no, c0..c4): a lab log written from orders and lineitem.

    Per order k: a formulation line (doses, id, a stability cell); for k not
    divisible by 10 a dilution line and a header line on the next line; one
    'Day n' line per (order, line number) with date, volume, texture and a
    baseline mark; a texture-only continuation line after 'Day 0' of orders
    whose first line has flag R. File = k div 100, so a file holds at most
    100 orders at any scale.
    """
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem")
    k = F.col("o_orderkey")
    null = F.lit(None).cast("string")
    form = o.select((k / 100).cast("long").alias("file"), (k * 100).alias("line_no"),
                    F.when(k % 7 == 0, F.concat((k % 50 + 1).cast("string"), F.lit("% APG, 20 ppm SDS - 5 ppm sds (S"),
                                                k.cast("string"), F.lit(")")))
                    .otherwise(F.concat((k % 50 + 1).cast("string"), F.lit("% APG, 20 ppm SDS (S"), k.cast("string"),
                                        F.lit(")"))).alias("c0"),
                    F.when(F.col("o_orderstatus") == "F", "Unstable concentrate 4C")
                    .when(F.col("o_orderstatus") == "O", "stable RT").otherwise("cloudy dilution").alias("c1"),
                    null.alias("c2"), null.alias("c3"), null.alias("c4"))
    od = o.where(k % 10 != 0)
    dil = od.select((k / 100).cast("long").alias("file"), (k * 100 + 1).alias("line_no"),
                    F.when(k % 3 == 0, "20X").when(k % 3 == 1, "10 X AFC").otherwise("5X sonicated").alias("c0"),
                    F.when(k % 2 == 0, "45C 5cc").otherwise("RT 5cc").alias("c1"),
                    F.lit("10 mL tube").alias("c2"), null.alias("c3"), null.alias("c4"))
    hdr = od.select((k / 100).cast("long").alias("file"), (k * 100 + 2).alias("line_no"),
                    F.lit("Day").alias("c0"), F.lit("Date").alias("c1"), F.lit("Foam (cc)").alias("c2"),
                    F.lit("Foam Texture").alias("c3"), F.lit("Notes").alias("c4"))
    per = li.groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_shipdate").alias("d"), F.sum("l_quantity").alias("q"),
        F.max("l_returnflag").alias("rf"), F.max("l_linestatus").alias("ls"))
    lk, ln = F.col("l_orderkey"), F.col("l_linenumber")
    day = per.select((lk / 100).cast("long").alias("file"), (lk * 100 + 10 + 2 * ln).alias("line_no"),
                     F.concat(F.lit("Day "), F.when(ln == 7, 9).otherwise(ln - 1).cast("string")).alias("c0"),
                     F.date_format("d", "yyyy-MM-dd").alias("c1"),
                     F.concat(F.col("q").cast("long").cast("string"), F.lit(" cc")).alias("c2"),
                     F.when(F.col("rf") == "A", "Fine").when(F.col("rf") == "N", "Coarse")
                     .otherwise("Creamy-Fine").alias("c3"),
                     F.when(F.col("ls") == "O", "*").alias("c4"))
    cont = per.where((F.col("rf") == "R") & (ln == 1)).select(
        (lk / 100).cast("long").alias("file"), (lk * 100 + 11 + 2 * ln).alias("line_no"),
        null.alias("c0"), null.alias("c1"), null.alias("c2"), F.lit("wet").alias("c3"), null.alias("c4"))
    return form.unionByName(dil).unionByName(hdr).unionByName(day).unionByName(cont)


# ---------------------------------------------------------------------------
# DuckDB text of the same views (for oracle CTEs)
# ---------------------------------------------------------------------------

VIEW_SQL = {
    "foam_long": """select user_id * 100000 + (datediff('day', date '2024-01-01', cast(ts as date)) // 15) as id,
        cast(datediff('day', date '2024-01-01', cast(ts as date)) % 15 as integer) as d, avg(value) as y,
        max(event_type) as texture from events group by all""",
    "texture_weights": """select * from (values ('click',1.0e0),('view',2.0e0),('signup',3.0e0),
        ('purchase',4.0e0)) as tw(label, weight)""",
    "decay_long": """select l_orderkey as id, l_linenumber as t, avg(l_extendedprice) as y
        from lineitem group by l_orderkey, l_linenumber""",
    "chem_wide": "select o_orderkey as id, o_orderpriority as method, o_totalprice as target, "
        + ", ".join(f"sum(case when l_linenumber={i} then l_quantity end) as c{i}" for i in range(1, 8))
        + " from orders left join lineitem on o_orderkey = l_orderkey"
          " group by o_orderkey, o_orderpriority, o_totalprice",
    "gappy": """select l_orderkey, l_linenumber, l_quantity, l_extendedprice,
        nullif(l_discount, 0.0e0) as disc, nullif(l_tax, 0.0e0) as tax,
        nullif(l_returnflag, 'N') as flag from lineitem""",
    "obs_long": """select user_id as id, cast(datediff('day', date '2024-01-01', cast(ts as date)) as integer) as d,
        max(case event_type when 'error' then 'Unstable-Gel..' when 'signup' then 'No_gel'
            when 'view' then '' else ' clear ' end) as txt
        from events group by all""",
    "clf_binary": """select l.doc_id as id, l.quality as label,
        case when d.n_chars > 1500 then 1 else 0 end as pred,
        cast(d.n_chars % 97 as double)/97 as score
        from labels l join documents d on l.doc_id = d.doc_id""",
    "clf_multi": """select l_orderkey*10+l_linenumber as id, l_returnflag as label,
        case when l_quantity < 15 then 'A' when l_quantity < 35 then 'N' else 'R' end as pred,
        l_quantity/50 as s_A, l_discount*10 as s_N, l_tax*12.5 as s_R from lineitem""",
    "reg": "select l_orderkey as id, l_extendedprice as y, 2000.0e0*l_quantity as yhat from lineitem",
    "lab_log": """
select o_orderkey // 100 as file, o_orderkey * 100 as line_no,
  case when o_orderkey % 7 = 0 then cast(o_orderkey % 50 + 1 as varchar) || '% APG, 20 ppm SDS - 5 ppm sds (S'
         || cast(o_orderkey as varchar) || ')'
       else cast(o_orderkey % 50 + 1 as varchar) || '% APG, 20 ppm SDS (S' || cast(o_orderkey as varchar) || ')' end as c0,
  case o_orderstatus when 'F' then 'Unstable concentrate 4C' when 'O' then 'stable RT' else 'cloudy dilution' end as c1,
  cast(null as varchar) as c2, cast(null as varchar) as c3, cast(null as varchar) as c4 from orders
union all
select o_orderkey // 100, o_orderkey * 100 + 1,
  case o_orderkey % 3 when 0 then '20X' when 1 then '10 X AFC' else '5X sonicated' end,
  case when o_orderkey % 2 = 0 then '45C 5cc' else 'RT 5cc' end, '10 mL tube', null, null
  from orders where o_orderkey % 10 != 0
union all
select o_orderkey // 100, o_orderkey * 100 + 2, 'Day', 'Date', 'Foam (cc)', 'Foam Texture', 'Notes'
  from orders where o_orderkey % 10 != 0
union all
select l_orderkey // 100, l_orderkey * 100 + 10 + 2 * l_linenumber, 'Day ' || cast(case when l_linenumber = 7 then 9 else l_linenumber - 1 end as varchar),
  strftime(max(l_shipdate), '%Y-%m-%d'), cast(cast(sum(l_quantity) as bigint) as varchar) || ' cc',
  case max(l_returnflag) when 'A' then 'Fine' when 'N' then 'Coarse' else 'Creamy-Fine' end,
  case when max(l_linestatus) = 'O' then '*' end
  from lineitem group by l_orderkey, l_linenumber
union all
select l_orderkey // 100, l_orderkey * 100 + 11 + 2 * l_linenumber, null, null, null, 'wet', null
  from lineitem group by l_orderkey, l_linenumber having max(l_returnflag) = 'R' and l_linenumber = 1""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with CTEs for the named views (in order)."""
    if not names:
        return sql
    ctes = ",\n".join(f"{n} as ({VIEW_SQL[n]})" for n in names)
    body = sql.strip()
    head = body[:15].lower().split()
    if head[:2] == ["with", "recursive"]:
        rest = body[body.lower().index("recursive") + len("recursive"):]
        return f"with recursive {ctes},\n{rest}"
    if head[:1] == ["with"]:
        rest = body[4:]
        return f"with {ctes},\n{rest}"
    return f"with {ctes}\n{body}"
