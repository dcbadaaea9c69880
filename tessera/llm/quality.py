"""Quality rules as a short-circuit cascade.

A rule is a cheap predicate over measures of one text. ``plan_rules`` runs all
rules over a bounded sample (the first ``sample_rows`` rows, a documented parameter) and
records, per rule, the seconds it takes and which texts it rejects; the order
is greedy: next comes the rule that rejects most of the still surviving sample
texts per second. ``cascade`` then runs the rules in that order, each only on
the texts that passed all before it. The order changes the cost, never the
verdict: a text is kept when no rule rejects it.

Defined cases: a null text has no words and counts as an empty one; empty
texts fail the base rule; repeated rows are judged one by one; other columns
pass through untouched, whatever their names.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Characters that count as symbols (fixed values of the base rule).
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Measures:
    """Measures of the texts of one slice, each computed once, when first asked for, and only where asked for."""

    def __init__(self, texts: list[str | None]):
        self.texts = [t or "" for t in texts]
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self._words = None

    def __len__(self) -> int:
        return len(self.texts)

    def get(self, name: str, rows: np.ndarray) -> np.ndarray:
        """Values of measure ``name`` at ``rows`` (positions in the slice)."""
        values, have = self.known.setdefault(name, (np.zeros(len(self), np.int64), np.zeros(len(self), bool)))
        todo = rows[~have[rows]]
        if len(todo):
            values[todo] = getattr(self, "_" + name)(todo)
            have[todo] = True
        return values[rows]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        if self._words is None:
            self._words = c.words([t.encode("utf-8", "surrogatepass") for t in self.texts])
        return self._words

    def _each(self, rows, fn) -> list[int]:
        return [fn(self.texts[i]) for i in rows]

    def _n_words(self, rows):
        return self.words()[1][rows]

    def _word_chars(self, rows):
        space = [chr(b) for b in c.SPACE]
        return self._each(rows, lambda t: len(t) - sum(map(t.count, space)))

    def _n_symbols(self, rows):
        return self._each(rows, lambda t: sum(map(t.count, SYMBOLS)))

    def _n_exclaims(self, rows):
        return self._each(rows, lambda t: t.count("!"))

    def _n_capitals(self, rows):
        return self._each(rows, _caps)

    def _n_letters(self, rows):
        return self._each(rows, _letters)

    def _lines(self, t: str) -> list[str]:
        space = c.SPACE.decode()
        return [x for x in t.split("\n") if x.strip(space)]

    def _n_lines(self, rows):
        return self._each(rows, lambda t: len(self._lines(t)))

    def _n_dup_lines(self, rows):
        return self._each(rows, lambda t: len(x := self._lines(t)) - len(set(x)))

    def _n_repeat_words(self, rows):
        h, n = self.words()
        if len(h) < 3:
            return np.zeros(len(rows), np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        p = c.powers(0xC2B2AE3D27D4EB4F, 3)
        key = c.mix(h[:-2] + h[1:-1] * p[1] + h[2:] * p[2]) + doc[:-2].astype(c.U64) * c.U64(0xD6E8FEB86659FD93)
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        order = inside[np.argsort(key[inside])]
        s = key[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(h) + 2, bool)
        for at in (order[1:][same], order[:-1][same]):
            for j in range(3):
                twice[at + j] = True
        return np.bincount(doc[twice[:len(h)]], minlength=len(n))[rows]


def _caps(t: str) -> int:
    """ASCII capitals of a text."""
    a = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
    return int(((a >= 65) & (a <= 90)).sum())


def _letters(t: str) -> int:
    """ASCII letters of a text."""
    a = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
    low = a | 0x20
    return int(((low >= 97) & (low <= 122) & (a < 128)).sum())


@dataclass(frozen=True)
class Rule:
    """``rejects(measures, rows)``: a boolean for each of ``rows``."""

    name: str
    rejects: Callable[[Measures, np.ndarray], np.ndarray]


BASE = (
    Rule("few_words", lambda m, r: m.get("n_words", r) < 50),
    Rule("repeated_words", lambda m, r: 100 * m.get("n_repeat_words", r) > 50 * m.get("n_words", r)),
)
#: The further rules: clear junk only, so that plain prose of any language stays.
MORE = (
    Rule("symbols", lambda m, r: 10 * m.get("n_symbols", r) > m.get("n_words", r)),
    Rule("exclamations", lambda m, r: 10 * m.get("n_exclaims", r) > 3 * m.get("n_words", r)),
    Rule("repeated_lines", lambda m, r: 2 * m.get("n_dup_lines", r) > m.get("n_lines", r)),
    Rule("capitals", lambda m, r: 2 * m.get("n_capitals", r) > m.get("n_letters", r)),
    Rule("word_length", lambda m, r: (m.get("word_chars", r) < 2 * m.get("n_words", r)) | (m.get("word_chars", r) > 15 * m.get("n_words", r))),
)
RULES = (*BASE, *MORE)


def _measure_rules(rules):
    def run(batches):
        for piece in c.slices(batches):
            texts = piece.column(0).to_pylist()
            every, out, cost = np.arange(len(texts)), [], []
            for rule in rules:
                m = Measures(texts)  # own measures: a rule pays for all it needs
                began = time.perf_counter()
                out.append(rule.rejects(m, every))
                cost.append(time.perf_counter() - began)
            for i in range(len(texts)):
                yield pa.RecordBatch.from_pydict({
                    "rejects": pa.array([json.dumps([int(x[i]) for x in out])]),
                    "cost": pa.array([json.dumps([x / len(texts) for x in cost])])})
    return run


def plan_rules(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = 1000) -> list[dict]:
    """Rules in the order to run them, with the sample's cost (seconds a text) and rejection rates."""
    col = F.col(f"`{text}`").alias("text")
    # the limit is above the measuring: Spark asks as many partitions as it needs for sample_rows rows, without a shuffle
    got = docs.select(col).mapInArrow(_measure_rules(rules), "rejects string, cost string").limit(sample_rows).collect()
    if not got:
        return [{"rule": r.name, "cost": 0.0, "rejected": 0.0} for r in rules]
    hit = np.array([json.loads(x["rejects"]) for x in got], bool)
    cost = np.maximum(np.array([json.loads(x["cost"]) for x in got]).mean(axis=0), 1e-9)
    alive, left, plan = np.ones(len(hit), bool), list(range(len(rules))), []
    while left:
        rate = [hit[alive, j].mean() if alive.any() else 0.0 for j in left]
        best = max(range(len(left)), key=lambda i: (rate[i] / cost[left[i]], -cost[left[i]]))
        j = left.pop(best)
        plan.append({"rule": rules[j].name, "cost": float(cost[j]), "rejected": float(rate[best])})
        alive &= ~hit[:, j]
    return plan


def judge(m: Measures, order: list[Rule]) -> tuple[np.ndarray, list[str | None], np.ndarray]:
    """Kept, the rule that rejected, and how many rules ran, for each text of a slice."""
    alive, by, ran = np.arange(len(m)), np.full(len(m), None, object), np.zeros(len(m), np.int32)
    for rule in order:
        if not len(alive):
            break
        ran[alive] += 1
        out = rule.rejects(m, alive)
        by[alive[out]] = rule.name
        alive = alive[~out]
    kept = np.zeros(len(m), bool)
    kept[alive] = True
    return kept, list(by), ran


def _ordered(docs, rules, text, sample_rows) -> list[Rule]:
    named = {r.name: r for r in rules}
    return [named[p["rule"]] for p in plan_rules(docs, rules, text, sample_rows)]


def cascade(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text", measures=MEASURES,
            sample_rows: int = 1000) -> DataFrame:
    """One row per row of ``docs``: key, ``measures`` (of every row), kept, rejected_by, rules_run."""
    order = _ordered(docs, rules, text, sample_rows)

    def run(batches):
        for piece in c.slices(batches):
            m = Measures(piece.column(0).to_pylist())
            every = np.arange(len(m))
            cols = {key: piece.column(1)} | {k: pa.array(m.get(k, every)) for k in measures}
            kept, by, ran = judge(m, order)
            yield pa.RecordBatch.from_pydict(cols | {"kept": pa.array(kept), "rejected_by": pa.array(by, pa.string()), "rules_run": pa.array(ran)})

    frame = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{key}`").alias("key"))
    kind = frame.schema["key"].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}", *(f"{k} bigint" for k in measures), "kept boolean, rejected_by string, rules_run int"])
    return frame.mapInArrow(run, schema)


def keep_good(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = 1000) -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects."""
    order, at = _ordered(docs, rules, text, sample_rows), docs.columns.index(text)

    def run(batches):
        for piece in c.slices(batches, at):
            kept, _, _ = judge(Measures(piece.column(at).to_pylist()), order)
            yield piece.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
