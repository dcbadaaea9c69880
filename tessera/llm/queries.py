"""Registered queries of the operators of this subpackage, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from . import chat, classifier, decontaminate, jaccard, licenses, linededup, negatives, packing, quality, secrets, spelling, suffixes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and cascade verdict of every document."""
    out = quality.cascade(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", *quality.MEASURES, failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


OP1_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, [x for x in string_split_regex(t, '[\x20\x09-\x0D]+') if x <> ''] as ws,
             [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as ls from d),
g as (select doc_id, i, ws[i:i+2] as tri from w, unnest(range(1, greatest(len(ws) - 1, 1))) as u(i) where len(ws) >= 3),
r as (select doc_id, i, count(*) over (partition by doc_id, tri) as n from g),
p as (select doc_id, count(distinct i + j) as n_repeat_words from r, (values (0), (1), (2)) as o(j) where n > 1 group by doc_id),
m as (select w.doc_id, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
             cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, len(ls) as n_lines,
             cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) as caps, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as letters,
             length(regexp_replace(t, '[^!]', '', 'g')) as ex
      from w left join p on w.doc_id = p.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > n_words or 10 * ex > 3 * n_words
            or 2 * n_dup_lines > n_lines or 2 * caps > letters or word_chars < 2 * n_words or word_chars > 15 * n_words) as kept
from m
"""

def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as seekable WARC bundles and read back through the record index."""
    path = c.fresh(spark, "warc")
    warc.write_bundles(warc.with_types(table(spark, sf_dir, "pages"), "page_id", "html"), path)
    return warc.read_bundles(spark, path).withColumnRenamed("id", "page_id").drop("bundle", "frame", "offset")


OP2_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, cast(octet_length(b) as bigint) as payload_bytes, sha256(b) as payload_digest from p),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first from d)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to from f
"""

def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and grammar-learnt secret spans of every document."""
    return secrets.find(table(spark, sf_dir, "documents")).drop("n_grammar")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds control strings, formatted, masked and read back."""
    hard = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return chat.read_back(chat.format_conversations(rows.unionByName(extra), tokenizer_file("byte_bpe_50k.json")))


OP4_SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
           union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
select conv_id, cast(count(*) as bigint) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_start|>') + length('<|im_end|>') + 2) as bigint) as formatted_chars
from t group by conv_id
"""

def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    pieces = packing.tokenise(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), with_ids=False)
    return packing.pack(pieces)

def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of 0.85 or more over 4-word shingles."""
    return jaccard.link(table(spark, sf_dir, "documents"), k=4, percent=85)


OP8_SQL = r"""
with recursive w as (select doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] as ws from documents),
s as (select distinct doc_id, sh from (select doc_id, unnest(case when len(ws) >= 4 then [ws[i:i+3] for i in range(1, len(ws) - 2)] when len(ws) > 0 then [ws] else [] end) as sh from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (select a.doc_id as a, b.doc_id as b from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
          group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r(doc_id, c) as (select doc_id, doc_id from w union select l.b, r.c from r join links l on l.a = r.doc_id)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, (select min(c) from r where r.doc_id = w.doc_id) as component_id from w left join n on n.doc_id = w.doc_id
"""

def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without its repeated 400-byte strings."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), length=400, with_kept=False)

def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, and how many of them repeat an earlier run of three or more, or a line of fifty words or more."""
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
with l as (select doc_id, no, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t
           from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as no from documents)),
f as (select doc_id, no, t, row_number() over (partition by doc_id order by no) as i from l where t <> ''),
w as (select doc_id, i, [t, lead(t, 1) over d, lead(t, 2) over d] as lines, lead(t, 2) over d is not null as whole from f window d as (partition by doc_id order by i)),
a as (select doc_id, i, lines from w where whole union all select doc_id, i, [t] from f where len(string_split_regex(t, '[\x20\x09-\x0D]+')) >= 50),
r as (select doc_id, i, len(lines) as size, row_number() over (partition by lines order by doc_id, i) as rank from a),
g as (select distinct doc_id, i + j as i from r, (values (0), (1), (2)) o(j) where rank > 1 and j < size),
k as (select l.doc_id, l.no, l.line, f.i, g.i is not null as gone from l left join f on f.doc_id = l.doc_id and f.no = l.no left join g on g.doc_id = f.doc_id and g.i = f.i)
select doc_id, count(i) as n_lines, count(*) filter (where gone) as n_removed, sha256(coalesce(string_agg(line, chr(10) order by no) filter (where not gone), '')) as kept_sha256
from k group by doc_id
"""


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a benchmark item in a document, within the edit budget."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document with their best scores."""
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    m = F.col("matches")  # sorted by licence and score: the last of a licence is its best
    best = F.filter(m, lambda x, i: (i == F.size(m) - 1) | (F.get(m, (i + 1).cast("int"))["licence"] != x["licence"]))
    out = out.select("doc_id", best.alias("matches"))
    return out.select("doc_id", F.size("matches").cast("bigint").alias("n_licences"),
                      F.array_join(F.transform("matches", lambda x: F.concat(x["licence"], F.lit(":"), x["permille"])), ",").alias("licences"))


def _op9_sql() -> str:
    quoted = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
    rows = ", ".join(f"({i}, '{name}', {quoted(grams)}, cast({quoted(marks)} as varchar[]))" for i, (name, grams, marks) in enumerate(licenses.template_bigrams()))
    parts = ", ".join(f"('{a}', '{b}')" for a, b in licenses.INCLUDES.items())
    return r"""
with t(tid, licence, tg, marks) as (values """ + rows + r"""),
u as (select distinct doc_id, unnest(list_distinct(string_split(coalesce(text, ''), chr(10)) || string_split_regex(coalesce(text, ''), '\n[\x20\x09-\x0D]*\n') || [coalesce(text, '')])) as unit from documents),
w as (select doc_id, [x for x in string_split_regex(lower(unit), '[^a-z0-9]+') if x <> ''] as ws from u),
b as (select distinct doc_id, list_sort(list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))])) as grams from w where len(ws) >= 2 and len(ws) <= 100000),
m as (select doc_id, licence, cast(floor(2000 * len(list_intersect(grams, tg)) / (len(grams) + len(tg))) as int) as permille from b, t
      where len(grams) * 3 between 2 * len(tg) and 4.5 * len(tg) and list_has_all(grams, marks)),
d as (select distinct doc_id, coalesce(text, '') as text from documents),
x as (select doc_id, text, [x for x in string_split_regex(lower(text), '[^a-z0-9]+') if x <> ''] as ws from d),
g as (select doc_id, text, [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))] as grams from x),
p as (select doc_id, text, grams, unnest(grams) as gram, unnest(range(1, len(grams) + 1)) as pos from g),
h as (select doc_id, text, tid, any_value(grams) as grams, list(p.gram order by pos) as own, list(pos order by pos) as places from p join (select tid, unnest(tg) as gram from t) k on k.gram = p.gram group by doc_id, text, tid),
o as (select h.*, t.licence, t.tg, t.marks, (2 * len(tg) + 2) // 3 as need, 3 * len(tg) // 2 as span from h join t on t.tid = h.tid where 3 * len(own) >= 2 * len(tg)),
s as (select *, unnest(range(1, len(own) + 1)) as i from o),
e as (select *, unnest(range(i + need - 1, least(len(own), i + span - 1) + 1)) as j from s),
f as (select doc_id, licence, cast(floor(2000 * len(list_distinct(own[i:j])) / (len(list_distinct(grams[places[i]:places[j]])) + len(tg))) as int) as permille from e
      where places[j] - places[i] < span and list_has_all(own[i:j], marks)),
best as (select doc_id, licence, max(permille) as permille from (select * from m union all select * from f) where permille >= 800 group by all),
r as (select * from best a where not exists (select 1 from best c, (values """ + parts + r""") v(whole, part) where c.doc_id = a.doc_id and c.licence = v.whole and a.licence = v.part))
select d.doc_id, count(r.doc_id) as n_licences, coalesce(string_agg(licence || ':' || permille, ',' order by licence), '') as licences
from documents d left join r on r.doc_id = d.doc_id group by d.doc_id
"""


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return classifier.classify(table(spark, sf_dir, "documents"), labels)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, for each of its positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


OP12_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
           from (select distinct vec_id, label, embedding from embeddings)
           where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
      from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, other_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
n as (select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id) as rank, other_id as negative_id, positive_score, score as negative_score
      from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, each with the more frequent near word that it is a variant of."""
    return spelling.group_variants(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with recursive bits as (select list(list_reduce(list_prepend(i, range(0, 8)), lambda a, j: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) as tab from range(0, 256) t(i)),
o as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
d as (select doc_id, run, count(*) as times from o where length(run) >= 6 group by doc_id, run),
b as (select *, flatten([case when unicode(x) < 128 then [cast(unicode(x) as bigint)] else [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] end
                         for x in string_split(doc_id || ':' || run, '')]) as bytes from d),
h as (select run, times, xor(list_reduce(list_prepend(cast(4294967295 as bigint), bytes), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) as h from b, bits),
c as (select case when h % 199 = 0 then left(run, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2) else run end as word, times from h),
w as materialized (select word, cast(sum(times) as bigint) as n from c where length(word) >= 6 group by word having sum(times) >= 5),
v as (select word, n, unnest(range(1, length(word) + 1)) as i from w),
s as (select word, n, left(word, i - 1) || '*' || substr(word, i + 1) as hole, left(word, i - 1) || substr(word, i + 1) as less from v),
p as (select distinct a.word, b.word as near, b.n as near_n from s a join s b on a.hole = b.hole and a.word <> b.word
      union select s.word, w.word, w.n from s join w on s.less = w.word union select w.word, s.word, s.n from s join w on s.less = w.word),
k as (select word, count(*) as n_near, max(near_n) as near_n, min({'o': -near_n, 'near': near}).near as near from p group by word),
f as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 5 * n then near end as form, case when near_n >= 5 * n then near_n end as form_n from w left join k on k.word = w.word),
r as (select word, word as root, form as next from f union all select r.word, f.word, f.form from r join f on f.word = r.next)
select f.word, form, r.root, n, n_near, form_n from f join r on r.word = f.word and r.next is null
"""


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_warc_bundles, op3_secret_scan, op4_chat_format, op5_best_fit_packing, op6_line_dedup,
                                   op7_benchmark_decontamination, op8_ngram_jaccard, op9_license_scan, op10_suffix_dedup, op11_quality_classifier, op12_hard_negatives, op13_spelling_variants)}
#: op3, op5, op7, op10 and op11 have none: SQL cannot express them, tests hold them against brute force, op11 also against held-out labels.
ORACLES = {"op1_quality_rules": OP1_SQL, "op2_warc_bundles": OP2_SQL, "op4_chat_format": OP4_SQL, "op6_line_dedup": OP6_SQL,
           "op8_ngram_jaccard": OP8_SQL, "op9_license_scan": _op9_sql(), "op12_hard_negatives": OP12_SQL, "op13_spelling_variants": OP13_SQL}
