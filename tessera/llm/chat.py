"""Chat formatting with loss masks aligned to token offsets.

Every conversation is rendered whole (``<|im_start|>role\\ntext<|im_end|>\\n``
a turn) and encoded once, with offsets. The spans of the assistant texts and
the spans of the tokens are both sorted, so the tokens under a turn are found
by binary search; a token that reaches over the edge of a turn counts only
with the characters inside it.

Control strings inside texts and roles are escaped: of ``<``, any number of
backslashes and ``|``, one more backslash goes after the ``<``; ``unescape``
takes it out again, so the format is read back without loss.

A conversation is one row of output and so belongs to one task; its turns
stream through it in sorted order (a shuffle by conversation and a sort that
spills), none is gathered in a list beyond the conversation being rendered.

Defined cases: null role or text: empty; turns with equal numbers are ordered
by role, then text; a null turn number comes first; rows whose conversation is
null form one conversation; no rows, no result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

# Fixed values of the template.
START, STOP = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(STOP) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "<\\" + m[1] + "|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "<" + m[1] + "|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the sorted spans of its assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        at += len(head)
        if role == "assistant":
            spans.append((at, at + len(body)))
        at += len(body) + len(STOP) + 1
        parts += [head, body, STOP, "\n"]
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def align(spans: list[tuple[int, int]], offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Loss mask of the tokens, and the text under it as merged spans inside the turns."""
    mask, out = np.zeros(len(offsets), np.int8), []
    if not len(offsets):
        return mask, out
    begin, end = offsets[:, 0], np.maximum.accumulate(offsets[:, 1])
    for s, e in spans:
        first, last = np.searchsorted(end, s, "right"), np.searchsorted(begin, e, "left")
        mask[first:last] = 1
        at = None
        for a, b in zip(np.maximum(begin[first:last], s).tolist(), np.minimum(offsets[first:last, 1], e).tolist()):
            if at is not None and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            elif b > a:
                out.append((a, b))
                at = a
    return mask, out


def tokenizer(path: str):
    """Tokenizer with the two control strings as tokens and untrimmed offsets."""
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers, processors

    t = Tokenizer.from_file(path)
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, STOP)])
    return t


def format_conversations(rows: DataFrame, tokenizer_path: str, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: key, n_turns, formatted, input_ids, loss_mask, loss_spans (in code points of ``formatted``)."""
    def encode(tok, ready, keys, ids_type):
        rendered = [render(x) for x in ready]
        out = {"input_ids": [], "loss_mask": [], "loss_spans": []}
        for (_, spans), e in zip(rendered, tok.encode_batch([r[0] for r in rendered], add_special_tokens=False)):
            mask, merged = align(spans, np.array(e.offsets, np.int64).reshape(-1, 2))
            out["input_ids"].append(e.ids)
            out["loss_mask"].append(mask)
            out["loss_spans"].append([{"start": a, "stop": b} for a, b in merged])
        return pa.RecordBatch.from_arrays([
            pa.array(keys, ids_type), pa.array([len(x) for x in ready], pa.int64()), pa.array([r[0] for r in rendered], pa.string()),
            pa.array(out["input_ids"], pa.list_(pa.int32())), pa.array(out["loss_mask"], pa.list_(pa.int8())),
            pa.array(out["loss_spans"], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
            names=["key", "n_turns", "formatted", "input_ids", "loss_mask", "loss_spans"])

    def run(batches):
        tok, ready, keys, size, open_key, turns, kind, any_row = tokenizer(tokenizer_path), [], [], 0, None, [], None, False
        for batch in batches:
            kind = batch.column(0).type
            for k, r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if any_row and k != open_key:
                    ready.append(turns)
                    keys.append(open_key)
                    turns = []
                    if size >= 1 << 20:
                        yield encode(tok, ready, keys, kind)
                        ready, keys, size = [], [], 0
                open_key, any_row = k, True
                turns.append((r or "", t or ""))
                size += len(t or "")
        if any_row:
            yield encode(tok, [*ready, turns], [*keys, open_key], kind)

    q = [F.col(f"`{x}`") for x in (key, role, text, turn)]
    frame = rows.select(q[0].alias("key"), q[1].cast("string").alias("role"), q[2].cast("string").alias("text"), q[3].alias("turn"))
    frame = frame.repartition("key").sortWithinPartitions("key", "turn", "role", "text").select("key", "role", "text")
    kind = frame.schema["key"].dataType.simpleString()
    return frame.mapInArrow(run, f"key {kind}, n_turns bigint, formatted string, input_ids array<int>, loss_mask array<tinyint>, "
                            "loss_spans array<struct<start: bigint, stop: bigint>>").withColumnRenamed("key", key)


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Digests of what the formatted rows say: of all turns, and of the text under the loss mask."""
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows, out = batch.slice(i, 256), []
                for n, text, spans in zip(*(rows.column(j).to_pylist() for j in (1, 2, 3))):
                    turns = parse(text)
                    if len(turns) != n:
                        raise ValueError("a formatted conversation does not read back as its turns")
                    loss = "".join(unescape(text[s["start"]:s["stop"]]) for s in spans)
                    every = "".join(f"{r}\n{t}\n" for r, t in turns)
                    out.append((n, *(hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (every, loss)), len(loss), len(text)))
                cols = list(zip(*out)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[3], pa.int64()),
                                                  pa.array(cols[2], pa.string()), pa.array(cols[4], pa.int64())],
                                                 names=["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    kind = formatted.schema[key].dataType.simpleString()
    return (formatted.select(F.col(f"`{key}`").alias("key"), "n_turns", "formatted", "loss_spans")
            .mapInArrow(run, f"key {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").withColumnRenamed("key", key))
