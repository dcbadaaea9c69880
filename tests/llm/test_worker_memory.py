"""What workers keep between tasks is bounded and given up by other kinds of tasks."""

import gc
import random
import weakref

import numpy as np
import pyarrow as pa

from tessera.llm import common, packing, queries


def test_slices_release_what_other_tasks_held():
    common._held.clear()
    kept = common.hold("a", lambda: [1])
    assert common.hold("a", lambda: [2]) is kept
    batches = [pa.RecordBatch.from_pydict({"t": ["x" * 700_000, None, "y", "z" * 600_000]})]
    assert [p.num_rows for p in common.slices(batches, keep="a")] == [1, 2, 1]
    assert common._held == {"a": kept}
    common.powers(3, 10)
    assert sum(p.num_rows for p in common.slices(batches)) == 4
    assert not common._held and not common._powers


def test_encoder_cache_is_bounded_in_bytes():
    e = packing.Encoder(queries.tokenizer_file("word_bpe_49k.json"), cache_bytes=10_000)
    for i in range(40):
        texts = [f"word{i} another{i} " + "z" * 50 + str(i)]
        whole = np.frombuffer(e.encode(texts)[0], "<u4").tolist()
        assert whole == e.tok.encode(texts[0], add_special_tokens=False).ids + [packing.END_ID]
        assert e.size <= 10_000 + 1_500
    assert len(e.known) < 60


def test_strings_in_use_stay_in_the_encoder_cache():
    learnt = []

    class Counting(packing.Encoder):
        def _learn(self, w):
            learnt.extend([w] if isinstance(w, bytes) else w)
            return super()._learn(w)

    e = Counting(queries.tokenizer_file("word_bpe_49k.json"), cache=100)
    for i in range(200):  # about 1,000 strings in all
        e.encode(["always the same words, " + " ".join(f"{x}{i}" for x in ("one", "two", "three", "four", "five"))])
    assert learnt.count(b"always") == learnt.count(b"same") == 1
    assert len(learnt) < 1_020


def test_encoder_equals_the_tokenizer_on_odd_strings():
    e = packing.Encoder(queries.tokenizer_file("word_bpe_49k.json"), cache=300)
    rng = random.Random(6)
    parts = ["a", "b", "the", "Th", "É", "é", "ß", "Σ", "é", "İ", "1", "23", ".", ",", "..", "'s", "'", "<|", "|>", "<|endoftext|>", "###", "_", "-", "`", "~", "@", "<", ">", "…", "😀", " ", " ", " ", "\n", "\t", "\x1c", "\x0b"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3_000)]
    for at in range(0, len(texts), 100):
        for t, ids in zip(texts[at:at + 100], e.encode(texts[at:at + 100])):
            assert np.frombuffer(ids, "<u4").tolist() == e.tok.encode(t, add_special_tokens=False).ids + [packing.END_ID], t


def test_encoder_given_up_is_freed_at_once():
    e = packing.Encoder(queries.tokenizer_file("word_bpe_49k.json"), cache=10)
    for i in range(9):
        e.encode([f"word{i} another{i}"])
    known, gone = weakref.ref(e), gc.isenabled()
    gc.disable()
    try:
        del e
        assert known() is None
    finally:
        if gone:
            gc.enable()
