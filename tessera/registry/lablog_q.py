"""Queries for lab-log extraction (L, X8–X15, J1, J5–J7, J10) over the ``lab_log`` view.

The oracle re-derives the same state with plain window functions
(``max(...) over (partition by file order by line_no)``) instead of the
bucketed running-max + joins of the Spark plan.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lablog as L
from ..session import shared_path
from ..sources import views as V
from ..sources.lines import write_lines
from . import register

CELLS = [f"c{i}" for i in range(5)]
SIDE = CELLS[1:]


def _flag_sql():
    def cell(v):
        return {
            "unst": f"(contains({v}, 'unstable') or contains({v}, 'cloudy'))",
            "conc": f"contains({v}, 'concentrate')",
            "wu": f"regexp_matches({v}, '(?i)\\bunstable\\b')",
            "ws": f"regexp_matches({v}, '(?i)\\bstable\\b')",
            "c8": f"regexp_matches({v}, '(?i)8\\s*c\\b')",
            "c4": f"regexp_matches({v}, '(?i)4\\s*c\\b')",
            "rt": f"regexp_matches({v}, '(?i)\\brt\\b')",
            "v": v,
        }
    parts = {"s8f": [], "s8t": [], "s4f": [], "s4t": [], "rtf": [], "dsf": []}
    for c in SIDE:
        v = f"lower(trim({c}))"
        x = cell(v)
        nn = f"{c} is not null"
        parts["s8f"].append(f"({nn} and (({x['unst']} and {x['conc']} and regexp_matches({v}, '8\\s*[cC]')) "
                            f"or ({x['wu']} and {x['c8']})))")
        parts["s8t"].append(f"({nn} and not {x['wu']} and {x['ws']} and {x['c8']})")
        parts["s4f"].append(f"({nn} and (({x['unst']} and {x['conc']} and regexp_matches({v}, '4\\s*[cC]')) "
                            f"or ({x['wu']} and {x['c4']})))")
        parts["s4t"].append(f"({nn} and not {x['wu']} and {x['ws']} and {x['c4']})")
        parts["rtf"].append(f"({nn} and (({x['unst']} and {x['conc']} and not regexp_matches({v}, '(?i)\\b\\d{{1,2}}C\\b')) "
                            f"or ({x['wu']} and {x['rt']})))")
        parts["dsf"].append(f"({nn} and {x['unst']} and contains({v}, 'dilution'))")
    o = {k: "(" + " or ".join(v) + ")" for k, v in parts.items()}
    return f"""case when {o['s8f']} then false when {o['s8t']} then true end as "Concentrate Stability (8C)",
  case when {o['s4f']} then false when {o['s4t']} then true end as "Concentrate Stability (4C)",
  not (contains(lower(cell0), 'unstable concentrate') or {o['rtf']}) as "Concentrate Stability (RT)",
  cast(null as boolean) as "Concentrate Stability (HT)",
  not {o['dsf']} as "Dilution Stability" """


def _label_sql(v):
    return (f"case when contains({v}, 'foam amount') or (contains({v}, 'foam') and contains({v}, 'cc')) then 'Foam (cc)' "
            f"when contains({v}, 'foam texture') or contains({v}, 'texture') then 'Foam Texture' "
            f"when contains({v}, 'zeta') then 'Zeta' when contains({v}, 'pi') then 'PI' "
            f"when contains({v}, 'conductivity') then 'Conductivity' when contains({v}, 'size') then 'Size' "
            f"when contains({v}, 'water') and contains({v}, 'cc') then 'Water (cc)' "
            f"when contains({v}, 'date') then 'Date' end")


def _pos_sql(label):
    e = "cast(null as integer)"
    for i, c in enumerate(CELLS):
        e = f"case when {_label_sql(f'lower(trim({c}))')} = '{label}' then {i} else {e} end"
    return e


BASE_SQL = """
with k as (
  select *, lower(concat_ws(',', """ + ", ".join(f"coalesce({c}, '')" for c in CELLS) + """)) as txt,
    trim(coalesce(c0, 'nan')) as cell0,
    """ + " + ".join(f"cast({c} is not null as integer)" for c in CELLS) + """ as ncell,
    [""" + ", ".join(CELLS) + """] as cells
  from lab_log),
r as (select *, case when (contains(lower(cell0), '%') or contains(lower(cell0), 'ppm')) and contains(cell0, '(')
                     then 'formulation'
                     when regexp_matches(cell0, '^(?i)Day\\s*\\d+') then 'day'
                     when regexp_matches(txt, '(?i)\\d+\\s*x') then 'dilution' else 'other' end as raw from k),
n as (select *, lag(raw) over w as prev_raw, lag(txt) over w as prev_txt, lead(txt) over w as next_txt,
             lead(ncell) over w as next_n, lead(cells) over w as next_cells
      from r window w as (partition by file order by line_no)),
kk as (select *, case when prev_raw = 'dilution' and not contains(prev_txt, 'foam') and contains(txt, 'foam')
                      then 'header_line' else raw end as kind from n),
h as (select *, (kind = 'header_line' or (kind = 'dilution' and contains(txt, 'foam'))) as is_header from kk),
c as materialized (select *,
   max(case when kind = 'formulation' then line_no end) over w as F,
   max(case when kind = 'dilution' then line_no end) over w as D,
   max(case when is_header then line_no end) over w as H
  from h window w as (partition by file order by line_no rows between unbounded preceding and current row)),
form as materialized (select file, line_no, cell0,
   coalesce(case when regexp_matches(cell0, '\\((.*?)\\)') then trim(regexp_extract(cell0, '\\((.*?)\\)', 1)) end,
            'Sample_' || cast(row_number() over (partition by file order by line_no) as varchar)) as SampleID,
   """ + _flag_sql() + """
  from c where kind = 'formulation'),
dil as (select file, line_no as D,
   upper(replace(regexp_extract(txt, '(?i)(\\d+\\s*x)', 1), ' ', '')) as base,
   list_filter([""" + ", ".join(SIDE) + """], lambda v: v is not null and lower(v) != 'nan') as side
  from c where kind = 'dilution'),
dil2 as materialized (select file, D,
   case when len(list_filter(side, lambda v: not contains(lower(v), 'ml'))) > 0
        then base || ' ' || array_to_string(list_filter(side, lambda v: not contains(lower(v), 'ml')), ' ')
        else base end as "Dilution Ratio",
   coalesce(list_filter(side, lambda v: contains(lower(v), 'ml'))[-1], '') as "Tube Volume (mL)" from dil),
hdr as materialized (select file, line_no as H, """ + ", ".join(
    f"{_pos_sql(lbl)} as \"pos_{lbl}\"" for lbl in L.VALUE_LABELS) + """ from c where is_header),
day0 as materialized (select c.*, """ + ", ".join(f"hdr.\"pos_{lbl}\"" for lbl in L.VALUE_LABELS) + """
  from c left join hdr on c.file = hdr.file and c.H = hdr.H where c.kind = 'day'),
day1 as (select *, """ + ",\n    ".join(
    (f"case when trim(cells[coalesce(\"pos_{lbl}\", 1) + 1]) is not null and trim(cells[coalesce(\"pos_{lbl}\", 1) + 1]) != '' "
     f"and lower(trim(cells[coalesce(\"pos_{lbl}\", 1) + 1])) != 'nan' then trim(cells[coalesce(\"pos_{lbl}\", 1) + 1]) end as \"v_{lbl}\"")
    if lbl == "Date" else
    (f"case when trim(cells[\"pos_{lbl}\" + 1]) is not null and trim(cells[\"pos_{lbl}\" + 1]) != '' "
     f"and lower(trim(cells[\"pos_{lbl}\" + 1])) != 'nan' then trim(cells[\"pos_{lbl}\" + 1]) end as \"v_{lbl}\"")
    for lbl in L.VALUE_LABELS) + """ from day0),
days as (select file, line_no, F, D, trim(cell0) as "Day", "v_Date" as "Date",
  """ + ", ".join(f"cast(nullif(regexp_extract(\"v_{lbl}\", '[-+]?\\d+\\.?\\d*', 0), '') as double) as \"{lbl}\""
                  for lbl in L.NUMERIC_LABELS) + """,
  case when next_n = 1 and "pos_Foam Texture" is not null and next_cells["pos_Foam Texture" + 1] is not null
            and trim(next_cells["pos_Foam Texture" + 1]) != ''
       then regexp_replace(concat_ws(', ', coalesce("v_Foam Texture", ''), trim(next_cells["pos_Foam Texture" + 1])),
                           '^[, ]+|[, ]+$', '', 'g')
       else "v_Foam Texture" end as "Foam Texture",
  case when len(list_filter(cells[coalesce("pos_Foam Texture", 0) + 2:], lambda v: contains(v, '*'))) > 0
       then array_to_string(list_transform(list_filter(cells[coalesce("pos_Foam Texture", 0) + 2:],
                                                       lambda v: contains(v, '*')), lambda v: '*'), ', ') end as "Baseline"
  from day1),
samples as materialized (
  select d.file, d.line_no, d."Day", d."Date", d."Foam (cc)", d."Foam Texture", d."Water (cc)", d."Zeta",
    d."Conductivity", d."Size", d."PI", d."Baseline", f.SampleID, f."Concentrate Stability (8C)",
    f."Concentrate Stability (4C)", f."Concentrate Stability (RT)", f."Concentrate Stability (HT)",
    f."Dilution Stability", x."Dilution Ratio", case when d.D is not null then x."Tube Volume (mL)" end as "Tube Volume (mL)"
  from days d left join form f on d.file = f.file and d.F = f.line_no
  left join dil2 x on d.file = x.file and d.D = x.D)
"""

FLAGS = ["Concentrate Stability (8C)", "Concentrate Stability (4C)", "Concentrate Stability (RT)",
         "Concentrate Stability (HT)", "Dilution Stability"]
DAY_COLS = ["file", "line_no", "Day", "Date", "Foam (cc)", "Foam Texture", "Water (cc)", "Zeta", "Conductivity",
            "Size", "PI", "Baseline", "SampleID", *FLAGS, "Dilution Ratio", "Tube Volume (mL)"]


@register("s4_numbered_lines_lablog", views=("lab_log",), ops="S4",
          sql="select 'file=' || file as file, row_number() over (partition by file order by line_no) - 1 as line_no, c0, c1, c2, c3, c4 from lab_log")
def s4_q(spark, sf):
    """The lab log written as header-less files and read back in numbered splits."""
    log = V.lab_log(spark, sf)
    path = shared_path(spark, "lab-logs")
    text = F.to_csv(F.struct(*CELLS))
    write_lines(log.repartition("file").sortWithinPartitions("file", "line_no").select("file", text.alias("value")), path)
    return L.read_log(spark, path).withColumn("file", F.regexp_extract("file", r"/(file=\d+)/", 1))


@register("l7_day_records_lablog", views=("lab_log",), ops="L1 L2 L5 L6 L7 L8 X9 S4",
          sql=BASE_SQL + "select * from samples")
def l7_q(spark, sf):
    samples, _, _ = L.extract(V.lab_log(spark, sf), 5)
    return samples.where(F.col("Day").isNotNull()).select(*DAY_COLS)


@register("l4_placeholders_lablog", views=("lab_log",), ops="L3 L4",
          sql=BASE_SQL + """select f.file, f.line_no, f.SampleID, """ + ", ".join(f'f."{c}"' for c in FLAGS) + """
from form f join c on c.file = f.file and c.line_no = f.line_no
where not regexp_matches(coalesce(c.next_txt, ''), '(?i)\\d+\\s*x')""")
def l4_q(spark, sf):
    samples, _, _ = L.extract(V.lab_log(spark, sf), 5)
    return samples.where(F.col("Day").isNull()).select("file", "line_no", "SampleID", *FLAGS)


@register("x8_formulation_doses_lablog", views=("lab_log",), digits={"apg_pct": 6, "sds_ppm": 6}, ops="X8 L3",
          sql=BASE_SQL + """, parts as (
  select f.file, f.line_no, f.SampleID, trim(p.part) as part, p.pos from form f,
    lateral (select unnest(string_split_regex(f.cell0, '[,-]')) as part,
                    generate_subscripts(string_split_regex(f.cell0, '[,-]'), 1) as pos) p),
kv as (select file, line_no, SampleID, pos,
   case when regexp_matches(part, '^(?i)(\\d+\\.?\\d*)\\s*ppm\\s*(.*)$')
          then trim(regexp_replace(regexp_extract(part, '^(?i)(\\d+\\.?\\d*)\\s*ppm\\s*(.*)$', 2), '\\(.*?\\)', '', 'g')) || ' (ppm)'
        when regexp_matches(part, '^(\\d+\\.?\\d*)%\\s*(.*)$')
          then trim(regexp_replace(regexp_extract(part, '^(\\d+\\.?\\d*)%\\s*(.*)$', 2), '\\(.*?\\)', '', 'g')) || ' (%)' end as k,
   case when regexp_matches(part, '^(?i)(\\d+\\.?\\d*)\\s*ppm\\s*(.*)$')
          then cast(regexp_extract(part, '^(?i)(\\d+\\.?\\d*)\\s*ppm\\s*(.*)$', 1) as double)
        when regexp_matches(part, '^(\\d+\\.?\\d*)%\\s*(.*)$')
          then cast(regexp_extract(part, '^(\\d+\\.?\\d*)%\\s*(.*)$', 1) as double) end as v from parts),
firsts as (select file, line_no, SampleID, arg_min(k, pos) as k, arg_min(v, pos) as v from kv where k is not null
           group by file, line_no, SampleID, lower(k))
select file, line_no, SampleID, max(case when k = 'APG (%)' then v end) as apg_pct,
       max(case when k = 'SDS (ppm)' then v end) as sds_ppm, count(*) as n_doses
from firsts group by file, line_no, SampleID""")
def x8_q(spark, sf):
    _, form, _ = L.extract(V.lab_log(spark, sf), 5)
    return form.select("file", "line_no", "SampleID", F.col("doses")["APG (%)"].alias("apg_pct"),
                       F.col("doses")["SDS (ppm)"].alias("sds_ppm"), F.size("doses").cast("long").alias("n_doses"))


@register("x10_process_dilution_lablog", views=("lab_log",), ops="X10 X12",
          sql=BASE_SQL + """, t as (select distinct "Dilution Ratio" as txt from samples where "Dilution Ratio" is not null)
select txt, case when contains(txt, 'AFC') then 'AFC' end as "Pilot",
  case when regexp_matches(txt, '(?i)[-\\s]{0,10}(no|not)[-\\s]{0,10}\\w*sonic[\\w-]*') then false
       when regexp_matches(txt, '(?i)[-\\s]{0,10}sonic[\\w-]*') then true end as "Sonicated",
  case when regexp_matches(txt, '(?i)\\b(\\d+)\\s*stream\\b') then regexp_extract(txt, '(?i)\\b(\\d+)\\s*stream\\b', 1) || ' stream'
       when regexp_matches(txt, '(?i)\\(?(\\d):(\\d)\\)?\\s*ratio') then regexp_extract(txt, '(?i)\\(?(\\d):(\\d)\\)?\\s*ratio', 1)
            || '::' || regexp_extract(txt, '(?i)\\(?(\\d):(\\d)\\)?\\s*ratio', 2) end as "Concentrate manufacturing method (Ratio)",
  case when regexp_matches(txt, '(?i)(\\d+)\\s*cc') then regexp_extract(txt, '(?i)(\\d+)\\s*cc', 1) else '5cc' end
    as "Initial Foam Volume (cc)",
  case when regexp_matches(txt, '(?i)\\bRT\\b') then 'RT'
       when regexp_matches(txt, '(?i)(\\d+)\\s*c([^c]|$)') then cast(cast(regexp_extract(txt, '(?i)(\\d+)\\s*c([^c]|$)', 1) as integer) as varchar)
  end as "Initial Foam Temp (dilution Temp)",
  case when upper(txt) like '%AFC%' then 'AFC' end as pilot_tag
from t""")
def x10_q(spark, sf):
    samples, _, _ = L.extract(V.lab_log(spark, sf), 5)
    t = samples.where(F.col("Dilution Ratio").isNotNull()).select(F.col("Dilution Ratio").alias("txt")).distinct()
    p = L.process_dilution(F.col("txt"))
    from ..functions.text import pilot_tag
    return t.select("txt", *[p[k].alias(k) for k in ("Pilot", "Sonicated", "Concentrate manufacturing method (Ratio)",
                                                     "Initial Foam Volume (cc)", "Initial Foam Temp (dilution Temp)")],
                    pilot_tag("txt").alias("pilot_tag"))


@register("j10_trial_suffix_lablog", views=("lab_log",), ops="J10 J1",
          sql=BASE_SQL + """select file, line_no, SampleID || case when n <= 1 then '' else '-' || cast(n - 1 as varchar) end
  as SampleID from (select *, sum(case when lower(trim("Day")) = 'day 0' then 1 else 0 end) over (
    partition by file, SampleID, coalesce("Dilution Ratio", 'No Dilution Info') order by line_no
    rows between unbounded preceding and current row) as n from samples)""")
def j10_q(spark, sf):
    samples, _, _ = L.extract(V.lab_log(spark, sf), 5)
    d = samples.where(F.col("Day").isNotNull()).withColumn(
        "Dilution Ratio", F.coalesce("Dilution Ratio", F.lit(L.FALLBACK_DILUTION)))
    return L.trial_suffix(d).select("file", "line_no", "SampleID")


@register("l9_one_row_per_sample_lablog", views=("lab_log",), ops="L9 J6 J7 X11 X13 X14 L10",
          sql=BASE_SQL + """, m as (
  select *, coalesce("Dilution Ratio", 'No Dilution Info') as dr,
    cast(regexp_extract("Day", '(\\d+)', 1) as integer) as day_num,
    case when contains(coalesce("Baseline", ''), '*') then
      case when coalesce("Foam Texture", '') != '' then coalesce("Foam Texture", '') || ', *' else '*' end
      else coalesce("Foam Texture", '') end as tex
  from samples),
g as (select file, SampleID, dr,
   arg_min("Date", case when day_num = 0 then line_no end) as "Date",
   """ + ",\n   ".join(
    f"arg_min(\"Foam (cc)\", case when day_num = {d} then line_no end) as \"Day {d} - Foam (cc)\", "
    f"coalesce(arg_min(tex, case when day_num = {d} then line_no end), '') as \"Day {d} - Foam Texture\""
    for d in range(10)) + """
  from m group by file, SampleID, dr)
select file, case when regexp_matches(SampleID, '-1$') then trim(regexp_replace(SampleID, '-1$', '')) else SampleID end
  as SampleID, nullif(regexp_extract(dr, '^(\\d+[A-Z])\\s*(.*)$', 1), '') as "Dilution Ratio", "Date",
  """ + ", ".join(f'"Day {d} - Foam (cc)", "Day {d} - Foam Texture"' for d in range(10)) + """,
  case when regexp_matches(SampleID, '-1$') then trim(regexp_replace(trim(regexp_extract(dr, '^(\\d+[A-Z])\\s*(.*)$', 2)),
         '\\b\\d{2,3}X\\b', '', 'g')) || ' - New Trial'
       else trim(regexp_replace(trim(regexp_extract(dr, '^(\\d+[A-Z])\\s*(.*)$', 2)), '\\b\\d{2,3}X\\b', '', 'g')) end
    as "Sample Description"
from g""")
def l9_q(spark, sf):
    samples, _, _ = L.extract(V.lab_log(spark, sf), 5)
    m = samples.where(F.col("Day").isNotNull()).withColumn(
        "Dilution Ratio", F.coalesce("Dilution Ratio", F.lit(L.FALLBACK_DILUTION))).withColumn("Pilot", F.lit(None))
    single = L.one_row_per_sample(m, [])
    ratio, desc = L.split_ratio(F.col("Dilution Ratio"), F.lit(None).cast("string"))
    single = single.withColumns({"Dilution Ratio": ratio, "Sample Description": L.drop_ratio_codes(desc)})
    sid, desc2 = L.new_trial(F.col("SampleID"), F.col("Sample Description"))
    single = single.withColumns({"SampleID": sid, "Sample Description": desc2})
    return single.select("file", "SampleID", "Dilution Ratio", "Date",
                         *[c for d in range(10) for c in (f"Day {d} - Foam (cc)", f"Day {d} - Foam Texture")],
                         "Sample Description")


L10_SQL = BASE_SQL + """, m0 as (
  select s.*, coalesce("Dilution Ratio", 'No Dilution Info') as dr0, coalesce("Date", 'No Date') as date0,
    case when "Dilution Ratio" is not null and contains("Dilution Ratio", 'AFC') then 'AFC' end as pilot,
    trim(regexp_replace(coalesce("Tube Volume (mL)", 'None'), '(?i)mL\\s*tube', '', 'g')) as tube,
    cast(regexp_extract("Day", '(\\d+)', 1) as integer) as day_num,
    case when contains(coalesce("Baseline", ''), '*') then
      case when coalesce("Foam Texture", '') != '' then coalesce("Foam Texture", '') || ', *' else '*' end
      else coalesce("Foam Texture", '') end as tex
  from samples s where "Day" is not null),
m1 as (select *, SampleID || case when n <= 1 then '' else '-' || cast(n - 1 as varchar) end as sid
  from (select *, sum(case when lower(trim("Day")) = 'day 0' then 1 else 0 end) over (
          partition by file, SampleID, dr0 order by line_no rows between unbounded preceding and current row) as n
        from m0)),
g as (select file, sid, dr0,
   """ + ",\n   ".join(f'arg_min("{c}", line_no) filter (where "{c}" is not null) as "{c}"'
                       for c in ["Concentrate Stability (8C)", "Concentrate Stability (4C)",
                                 "Concentrate Stability (RT)", "Dilution Stability"]) + """,
   arg_min(tube, line_no) filter (where tube is not null) as "Tube Volume (mL)",
   arg_min(date0, case when day_num = 0 then line_no end) as "Date",
   coalesce(arg_min(pilot, line_no) filter (where pilot is not null), '') as "Pilot",
   """ + ",\n   ".join(
    f"arg_min(\"Foam (cc)\", case when day_num = {d} then line_no end) as \"Day {d} - Foam (cc)\", "
    f"coalesce(arg_min(tex, case when day_num = {d} then line_no end), '') as \"Day {d} - Foam Texture\""
    for d in range(10)) + """
  from m1 group by file, sid, dr0)
select file, trim(case when regexp_matches(sid, '-1$') then trim(regexp_replace(sid, '-1$', '')) else sid end) as SampleID,
  nullif(regexp_extract(dr0, '^(\\d+[A-Z])\\s*(.*)$', 1), '') as "Dilution Ratio", "Date", "Pilot",
  "Concentrate Stability (8C)", "Concentrate Stability (4C)", "Concentrate Stability (RT)", "Dilution Stability",
  "Tube Volume (mL)",
  """ + ", ".join(f'"Day {d} - Foam (cc)", "Day {d} - Foam Texture"' for d in range(10)) + """,
  case when regexp_matches(sid, '-1$') then trim(regexp_replace(trim(regexp_extract(dr0, '^(\\d+[A-Z])\\s*(.*)$', 2)),
         '\\b\\d{2,3}X\\b', '', 'g')) || ' - New Trial'
       else trim(regexp_replace(trim(regexp_extract(dr0, '^(\\d+[A-Z])\\s*(.*)$', 2)), '\\b\\d{2,3}X\\b', '', 'g')) end
    as "Sample Description"
from g"""


@register("l10_extraction_job_lablog", views=("lab_log",), sql=L10_SQL, ops="L10 J5 J14 X11 X12 X13 X14 X15 J10")
def l10_q(spark, sf):
    multi, single = L.extraction_job(V.lab_log(spark, sf), 5)
    return single.withColumn("SampleID", L.sonicated_id(F.col("SampleID"), F.lit(None).cast("boolean")))
