import hashlib
import random

import numpy as np
import pytest
import xxhash

from millrace.llm import suffix_dedup as op
from millrace.llm.rlindex import RunLengthIndex


def brute(rows):
    seen, out = set(), {}
    order = sorted({(i is None, i or 0, xxhash.xxh64_intdigest((t or "").encode(), seed=42) & op.TEXT_BITS, t or "") for i, t in rows})
    for none, i, _, t in order:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out[None if none else i, t] = (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return sorted(((i is None, i or 0), out[i, t or ""]) for i, t in rows)


def run(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), tuple(r)[1:5]) for r in op.remove_repeats(df).collect())


def test_odd_rows(odd, none):
    assert run(odd) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert run(none) == []


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_repeats_of_all_kinds(spark, monkeypatch, crowd):
    monkeypatch.setattr(op, "CROWD", crowd)
    rng = random.Random(2)
    base = "".join(rng.choice("abcde ") for _ in range(900))
    texts = ["a" * 3000, "ab" * 900, base, base]
    for _ in range(60):
        a, n = rng.randrange(800), rng.randrange(40, 400)
        text = list("".join(rng.choice("abcdé ") for _ in range(rng.randrange(150))) + base[a : a + n] + "".join(rng.choice("xyz") for _ in range(rng.randrange(120))))
        for _ in range(rng.choice([0, 0, 1, 3])):
            text[rng.randrange(len(text))] = "Q"
        texts.append("".join(text))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_a_long_text_folded_in_parts(spark, monkeypatch):
    def small(batches):  # sent by value: the limits are lowered where Python runs
        from millrace.llm import suffix_dedup as there

        held = there.SEGMENT, there.PASS_BYTES, there.FOLD_BYTES
        there.SEGMENT, there.PASS_BYTES, there.FOLD_BYTES = 400, 400, 800
        try:
            yield from there._cut(batches)
        finally:
            there.SEGMENT, there.PASS_BYTES, there.FOLD_BYTES = held

    monkeypatch.setattr(op, "_cut", small)
    rng = random.Random(7)
    other = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    again = other(300)
    rows = [(i, other(150) + again + other(1500) + again + other(1100) + again[:220] + other(90)) for i in range(3)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)) == brute(rows)


def test_index_statistics():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    index = RunLengthIndex(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]))
    text = b"".join(s + b"\0" for s in strings)
    length, before = index.statistics()
    assert index.runs < index.n
    for j in range(index.n):
        if before[j] >= 0 and length[j]:
            assert text[j : j + length[j]] == text[before[j] : before[j] + length[j]]
    with pytest.raises(ValueError):
        RunLengthIndex(np.zeros(300, np.uint8), np.array([300]))
