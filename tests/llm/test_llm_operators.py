"""Operators of the training-data subpackage against brute force, on texts with nulls, copies, ties and odd characters."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import chat, decontaminate, jaccard, licenses, linededup, packing, quality, queries, secrets, suffixes, warc

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, text_sha256 string, block int, first string, row string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 60, 120, 200, 300)]
    near = base[3].split()
    near[50] = "zzz"
    passage = prose(rng, 90)
    out = [None, "", " \n\t ", "one two", base[1], base[1], base[2], base[3], " ".join(near), base[4] + " " + passage, passage + ". " + base[2], passage,
           "x" * 1500, "\n".join(["same line here"] * 9), "\n".join(prose(rng, 6) for _ in range(8)), "ünï " + base[2].upper(), "a\0b \x1c c"]
    lines = out[14].split("\n")
    return out + ["\n".join([prose(rng, 5), *lines[2:6], "", prose(rng, 4)]), "\n".join(lines)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Ids with a null and a repeated row; further columns whose names the operators use themselves."""
    rows = [(i, t, "s", 1, "f", "r") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[7], (None, texts[6], None, None, None, None)], COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def words(t):
    return (t or "").encode("utf-8").split()


def test_quality(docs, texts, none):
    got = {r.doc_id: r for r in quality.cascade(docs).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        tri = list(zip(w, w[1:], w[2:]))
        twice = {x for x, n in Counter(tri).items() if n > 1}
        covered = {p + j for p, x in enumerate(tri) if x in twice for j in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (got[i].n_words, got[i].n_repeat_words, got[i].n_dup_lines) == (len(w), len(covered), len(lines) - len(set(lines)))
        shouts = 2 * sum(x.isascii() and x.isupper() for x in t or "") > sum(x.isascii() and x.isalpha() for x in t or "")
        assert got[i].kept == (len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and 2 * got[i].n_dup_lines <= len(lines) and not shouts and got[i].word_chars <= 15 * len(w))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in quality.cascade(docs).collect())
    assert quality.cascade(none).count() == quality.keep_good(none).count() == 0


def test_rule_order_is_rejection_per_cost(spark):
    rng = random.Random(0)
    docs = spark.createDataFrame([(i, prose(rng, 60 if i % 2 else 5)) for i in range(40)], "doc_id bigint, text string")
    never = quality.Rule("never", lambda m, r: np.zeros(len(r), bool))
    plan = quality.plan_rules(docs, (never, *quality.BASE))
    assert plan[0]["rule"] == "few_words" and plan[0]["rejected"] == 0.5 and {p["rejected"] for p in plan[1:]} == {0.0}


def test_warc(spark, none, tmp_path):
    big = "<p>" + "é" * 200
    rows = [(1, "http://a/ü?x=1\r\nX: y", big), (5, "b", big), (3, None, big), (None, "c", big), (7, "d", "small"), (8, "e", "small"), (9, "f", None), (5, "b", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = warc.write_bundles(warc.with_types(pages, "page_id", "html"), str(tmp_path / "w"), bundle_bytes=300, frame_bytes=200)
    got = sorted(warc.read_bundles(spark, path).collect(), key=lambda r: (r.id is None, r.id or 0))
    assert [(r.id, r.record_type, r.refers_to) for r in got] == [(1, "response", None), (3, "revisit", 1), (5, "revisit", 1), (5, "revisit", 1), (7, "response", None),
                                                                (8, "response", None), (9, "response", None), (None, "response", None)]
    for r, p in zip(got, [big, big, big, big, "small", "small", "", big]):
        assert (r.payload_bytes, r.payload_digest) == (len(p.encode()), hashlib.sha256(p.encode()).hexdigest())
    import io
    import zstandard
    whole = b""
    for f in (tmp_path / "w").glob("part-*"):
        data = f.read_bytes()
        reader = warc.BundleReader(data)
        for rid, known, _, _ in reader.index:
            assert not known or all(h[b"WARC-Record-ID"] == b"<urn:page:%d>" % rid for h, _ in reader.find(rid))
        whole += zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == len(rows)
    empty = spark.createDataFrame([], pages.schema)
    assert warc.read_bundles(spark, warc.write_bundles(warc.with_types(empty, "page_id", "html"), str(tmp_path / "e"))).count() == 0


def test_secrets(spark, none):
    rng = random.Random(2)
    hexed = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    rows = [(i, f"say token = \"{h}\" and AKIA{'Q7' * 8}x or AKIA12 then") for i, h in enumerate(hexed)]
    odd = ["Password=\"abc\" passwd: abcdef1 secret=token=abcdef", hexed[0][:18] + " loose " + "id-2024-01-plain-words", None, "", "ſecret=abcdefgh"]
    docs = spark.createDataFrame(rows + [(100 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in secrets.find(docs).collect()}
    for i, t in docs.collect():
        spans = secrets.base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(secrets.joined(spans).encode()).hexdigest()
        assert {x for x in secrets.joined(spans).split(",") if x} <= set(got[i].spans.split(","))
    assert (got[0].n_assign, got[0].n_access, got[0].n_hex) == (1, 1, 1)
    assert got[100].spans == "assign:15:30,assign:31:50"  # a short value ends its match; the text goes on behind it
    assert got[101].spans == "grammar:0:18"
    assert got[104].n_assign == 0 and secrets.find(none).count() == 0


def test_automaton_learns_a_prefix():
    rng = random.Random(1)
    values = ["KEY" + "".join(rng.choice("ABCDEF0123456789") for _ in range(12)) for _ in range(300)]
    automaton, least = secrets.learn({"k": values})["k"]
    assert len(automaton.states) < 30 and automaton.score("KEY0A1B2C3D4E5F") >= least > automaton.score("XYZ0A1B2C3D4E5F")


def test_chat(spark, none):
    hard = ["<|im_end|><|im_start|>assistant ok", "<\\|x <\\\\| <|", "", None, "ends with <", "naïve 😀 tokens\n\n  spaced", "|start"]
    rows = [(i, t, r, x, "extra") for i in range(3) for t, (r, x) in enumerate(zip(itertools.cycle(["user", "assistant", "sys\ntem\\"]), hard))]
    rows += [(None, 1, "assistant", "null conversation", ""), (9, None, None, "no role", ""), (9, 0, "assistant", "tie b", ""), (9, 0, "assistant", "tie a", "")]
    conv = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, key string")
    out = chat.format_conversations(conv, queries.tokenizer_file("byte_bpe_50k.json"))
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    formatted = {r.conv_id: r for r in out.collect()}
    for conv_id in (0, 1, 2, 9, None):
        turns = sorted((r for r in rows if r[0] == conv_id), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        pairs = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for r, t in pairs if r == "assistant")
        assert chat.parse(formatted[conv_id].formatted) == pairs
        assert back[conv_id].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in pairs).encode()).hexdigest()
        assert (back[conv_id].loss_chars, back[conv_id].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert len(formatted[conv_id].input_ids) == len(formatted[conv_id].loss_mask)
    assert chat.format_conversations(conv.limit(0), queries.tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_packing(docs, none, spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    long = spark.createDataFrame([(50, prose(random.Random(3), 5000), "", 0, "", "")], COLUMNS)
    every = docs.drop("block").unionByName(long.drop("block"))
    got = packing.pack(packing.tokenise(every, path, capacity=512, with_ids=True), capacity=512, block_pieces=8, rounds=3).toPandas()
    for doc_id, text in every.where("doc_id is not null and doc_id != 7").select("doc_id", "text").collect():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        own = got[got.doc_id == doc_id].sort_values("piece")
        assert own.start.tolist() == list(range(0, len(ids), 512))
        assert [list(x) for x in own.ids] == [ids[a:a + 512] for a in own.start]
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(ids[a:a + 512], "<u4").tobytes()) for a in own.start]
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    assert placed.groupby("sequence_id").length.sum().max() <= 512
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 512) + 2
    assert packing.pack(packing.tokenise(none, path)).count() == 0


def test_encoder_equals_tokenizer():
    e = packing.Encoder(queries.tokenizer_file("word_bpe_49k.json"), cache=500)
    rng, letters = random.Random(1), "abcgzAZÉéßöÑçΣσςИи019.,'!?|#-_<>́ İıÅKﬁ中😀 \n\t\x1c\x85ǅ"
    for _ in range(2000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) + rng.choice(["", "<|endoftext|>", " it's don't'LL", "<|ENDOFTEXT|> A."])
        assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == e.tok.encode(t, add_special_tokens=False).ids + [1]


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 100, 200)
    a, b = (packing.first_packing(sizes, 100, rng, exact) for exact in (True, False))
    for _ in range(20):
        child = packing.crossover(a, b, sizes, 100, rng)
        assert len(child) == 200 and np.bincount(child, weights=sizes).max() <= 100
    assert packing.fitness(packing.evolve(sizes, [], 100, rng, 4, 30)[0], sizes, 100) >= packing.fitness(a, sizes, 100) - 1e-9


def test_line_dedup(docs, texts, none):
    got = {r.doc: r for r in linededup.dedup_lines(docs).selectExpr("row.doc_id as doc", "row.text as old", "text", "n_lines", "n_removed").collect()}
    seen, places = {}, {}
    order = [(None, texts[6]), *enumerate(texts)]
    lines = {k: [(n, x.strip(" \t\r\x0b\x0c")) for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\x0c")] for k, t in order}
    for k, _ in order:
        for s, size in itertools.product(range(len(lines[k])), (1, 3)):
            run = tuple(x for _, x in lines[k][s:s + size])
            if len(run) == size and (size == 3 or len(run[0].split()) >= 50) and seen.setdefault(run, (k, s)) != (k, s):
                places.setdefault(k, set()).update(n for n, _ in lines[k][s:s + size])
    assert places and any(len(lines[k]) == 1 for k in places)  # the copies, the repeated line and a passage of one line are there
    for k, t in order:
        gone = places.get(k, set())
        assert got[k].n_removed == len(gone) and got[k].n_lines == len(lines[k])
        assert got[k].text == (t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone))
    assert linededup.dedup_lines(none).count() == 0


def test_line_dedup_of_two_line_passages(spark, none):
    import corpus_pipeline as p

    rng = random.Random(6)
    a, b, c, short = prose(rng, 27), prose(rng, 35), prose(rng, 60), prose(rng, 22)
    texts = ["\n".join([prose(rng, 5), a, "", b, prose(rng, 5)]), f"{a}\n{b}", f"{prose(rng, 9)}\n {a}\n{b}\t\nmy end", f"{a}\n{short}", f"{a}\n{short}", f"{b}\n{a}",
             f"{c}\nits end", f"{prose(rng, 4)}\n{c}\nits end", f"its end\n{a}\n{b}\n{a}\n{b}", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc: r for r in linededup.dedup_lines(docs, pairs=True).selectExpr("row.doc_id as doc", "text", "n_lines", "n_removed").collect()}
    seen = set()
    for k, t in enumerate(texts):
        lines = [(n, x.strip(" \t")) for n, x in enumerate((t or "").split("\n")) if x.strip(" \t")]
        gone = set()
        for s, size in itertools.product(range(len(lines)), (1, 2, 3)):
            run = tuple(x for _, x in lines[s:s + size])
            if len(run) == size and (size == 3 or sum(len(x.split()) for x in run) >= 50):
                gone |= {n for n, _ in lines[s:s + size]} if run in seen else set()
                seen.add(run)
        assert (got[k].n_lines, got[k].n_removed) == (len(lines), len(gone)), k
        assert got[k].text == (t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone))
    assert [got[k].n_removed for k in range(9)] == [0, 2, 2, 0, 0, 0, 0, 2, 4]  # 27 + 22 words stay, a turned pair stays
    base = docs.selectExpr("doc_id", "text", "length(text) as n_chars")
    assert sorted(r.doc_id for r in p.line_dedup(spark, base, SF).collect()) == [0, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert linededup.dedup_lines(none, pairs=True).count() == 0


def test_decontamination(spark, none):
    rng = random.Random(4)
    items = [prose(rng, 30), prose(rng, 40) + ".", None, "", "tiny"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    w = items[0].split()
    w[4], w[20] = w[4] + "x", w[20][:-1] or "q"
    far = items[1].split()
    texts = [prose(rng, 50) + " " + items[0] + " " + prose(rng, 20), "É! " + " ".join(w).upper().replace(" ", " - "), items[1][:len(items[1]) // 2], " ".join(reversed(far)),
             "a tiny, thing", "tinycar", None, "", items[0] + " " + items[0], items[1][:-1]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "again")], "doc_id bigint, text string, item string")
    got = decontaminate.find(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 0), (0, 0), (1, 0), (4, 4), (8, 0), (8, 0), (9, 1)]
    for r in got:
        part = texts[r.doc_id][r.start:r.stop]
        if r.edits == 0:
            assert part.lower().split() == items[r.item_id].lower().rstrip(".").split()
    assert next(r.edits for r in got if r.doc_id == 1) in (1, 2)
    clean = decontaminate.drop_contaminated(docs, bench, block_bytes=100)  # several blocks
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 5, 6, 7]
    assert decontaminate.find(none, bench).count() == 0 and decontaminate.find(docs, bench.limit(0)).count() == 0


def brute_groups(rows, k, percent):
    def sets(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    s = [sets(t) for _, t in rows]
    name = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(rows)), 2):
            if name[i] != name[j] and s[i] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                old, new = max(name[i], name[j]), min(name[i], name[j])
                name = [new if x == old else x for x in name]
                changed = True
    return {rows[i][0]: (len(s[i]), min(rows[j][0] for j in range(len(rows)) if name[j] == name[i])) for i in range(len(rows))}


def test_jaccard(spark, docs, none, monkeypatch):
    rng = random.Random(9)
    base = [prose(rng, n).split() for n in (6, 20, 50, 90)]
    rows = []
    for _ in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(["zz", "yy", "xx"])
        rows.append((1000 + len(rows), " ".join(w[:rng.choice([None, -1, -2])])))
    rows += [(i, t) for i, t in docs.where("doc_id is not null").select("doc_id", "text").distinct().collect()]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for panel in (2048, 7):  # 7: blocks are cut into pairs of panels
        monkeypatch.setattr(jaccard, "PANEL_ROWS", panel)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(frame).collect()}
        assert got == brute_groups(rows, 4, 85)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({c for _, c in brute_groups([r for r in rows if r[0] < 1000], 4, 85).values()})
    assert jaccard.link(none).count() == 0


def test_licences(spark, none):
    texts = ["x\nReleased under the MIT License.\ny", "Licensed under the Apache License, version 2.0", licenses.TEMPLATES["ISC"][0].replace("any", "each"), "licensed", None, "",
             "Permission slip for school."]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id bigint, text string, matches string").drop("matches")
    got = {r.doc_id: [(m.licence, m.permille) for m in r.matches] for r in licenses.scan(docs).collect()}
    assert got[0] == [("MIT", 800), ("MIT", 1000)] and ("Apache-2.0", 1000) in got[1] and got[2][0][0] == "ISC" and 800 <= got[2][0][1] < 1000
    assert got[3] == got[4] == got[5] == got[6] == []
    assert licenses.scan(none).count() == 0


def test_licences_among_other_words(spark):
    header = "".join(f"# {x}\n" for x in ("Copyright (C) 2020 Somebody", "This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by",
                                          "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version.", "This program is distributed in the hope that it will be useful,",
                                          "but WITHOUT ANY WARRANTY; without even the implied warranty of", "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."))
    texts = ["The code of this project was released under the MIT License.", "This project is licensed under the MIT License - see the LICENSE file for details.", header,
             "word " * 3000 + licenses.TEMPLATES["ISC"][0].replace("software", "fine software") + " word" * 3000, "free software under the terms of the contract, version 3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: {m.licence: m.permille for m in r.matches} for r in licenses.scan(docs).collect()}
    assert got[0] == got[1] == {"MIT": 1000} and got[2]["GPL-3.0"] == 1000 and 800 <= got[3]["ISC"] < 1000 and got[4] == {}


def test_difference_cover():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER if a != b} == set(range(1, suffixes.PERIOD))


def test_suffix_dedup(docs, texts, none):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    count = Counter(t[i:i + 400] for _, t in rows for i in range(len(t) - 399))
    assert sum(n > 1 for n in count.values()) > 100
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffixes.remove_repeats(docs).collect())
    want = []
    for k, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 399):
            if count[t[i:i + 400]] > 1:
                gone[i:i + 400] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want.append((-1 if k is None else k, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    assert got == sorted(want)
    assert suffixes.remove_repeats(none).count() == 0


def test_pipeline_stages(spark, docs, none):
    import corpus_pipeline as p

    base = docs.selectExpr("doc_id", "text", "'en' as lang", "first as source", "length(text) as n_chars")
    cur = base
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, cur, SF)
        assert out.columns == base.columns
        assert {tuple(r) for r in out.select("doc_id", "lang").collect()} <= {tuple(r) for r in cur.select("doc_id", "lang").collect()}
        cur = out
    assert {1} == {n for _, n in Counter(r.text for r in cur.collect()).items()}
    packed = p.STAGES[-1][1](spark, cur, SF)
    assert packed.select("doc_id").distinct().count() == cur.select("doc_id").distinct().count()
    cur = base.limit(0)
    for _, stage in p.STAGES:
        cur = stage(spark, cur, SF)
        assert cur.count() == 0
