import random
import re
from collections import Counter

import numpy as np
import xxhash

from millrace.llm import decontaminate, simhash, wordgrams
from millrace.llm.common import Scratch
from millrace.llm.components import components


def plain_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(pairs_of):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs_of:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def test_fingerprint_and_masks(spark):
    for t in ("", " \n", "One", "one TWO", "A b\tc\x0bd É é  f", "x y z " * 50):
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)
    assert spark.sql("select xxhash64('a b c') as h").first()["h"] == int(np.uint64(xxhash.xxh64_intdigest(b"a b c", seed=42)).view(np.int64))
    held = simhash.masks()
    assert len(held) == 7 and all(any(not (m >> i & 1 or m >> j & 1) for m in held) for i in range(64) for j in range(i, 64))


def test_links_are_whole(spark, monkeypatch):
    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for x in list(fps)[:20]:
        for _ in range(30):
            for _ in range(rng.choice([1, 1, 2, 3])):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(int(np.uint64(x).view(np.int64)) for x in fps)
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    want = grouped(near)
    for most in (32, 3):
        monkeypatch.setattr(simhash, "PAIRED", most)
        scratch = Scratch(spark, "t")
        edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), scratch)
        assert {r["node"]: r["root"] for r in components(edges, scratch).collect()} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(120)] + [(500, 501), (501, 500), (7, 7), (501, 502)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {**dict.fromkeys(range(121), 0), 500: 500, 501: 500, 502: 500}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def test_simhash_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert sorted(r["fingerprint"] for r in rows) == sorted(f"{plain_fingerprint(r['text'] or ''):016x}" for r in odd.collect())
    by = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert by[2] == by[5] == 1 and by[4] == 3 and by[9] == 9
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in kept.collect())[6] == 1
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def shingled(t, n=5):
    w = re.findall(r"\w+", (t or "").lower())
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({" ".join(w)} if w else set())


def test_containment(spark):
    rng = random.Random(8)
    words = [f"W{i}" for i in range(200)] + ["été", "ÉCOLE", "naïve", "x_1"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 14, 40, 41])))) for i in range(60)] + [(100, ""), (101, None), (102, "?!"), (None, "a b c d e f"), (3, "another text of the same item id here")]
    docs = []
    for d in range(250):
        text = [rng.choice(words) for _ in range(rng.randrange(40))]
        w = (rng.choice(items)[1] or "").split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            if w:
                w[rng.randrange(len(w))] = "changed"
        docs.append((d, (" ".join(text + w + text[:3])).replace(" ", rng.choice([" ", ", ", "\n"]))))
    docs += [(900, None), (901, ""), (None, "a b c d e f"), (902, "a-b c. d e f g " * 20_000)]
    got = sorted((str(r["doc_id"]), str(r["item_id"]), r["n_shared"], r["n_shingles"]) for r in decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect())
    want = []
    for d, t in docs:
        w = re.findall(r"\w+", (t or "").lower())
        for i, x in items:
            s = shingled(x)
            n = min(5, len(re.findall(r"\w+", (x or "").lower())))
            if s:
                have = {" ".join(w[k : k + n]) for k in range(len(w) - n + 1)}
                if 5 * len(s & have) >= 4 * len(s):
                    want.append((str(d), str(i), len(s & have), len(s)))
    assert got == sorted(want) and len(want) > 50


def test_containment_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "lorem ipsum dolor lorem ipsum dolor"), (2, None)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contained(odd, items).collect()} == {3, 4}
    left = decontaminate.drop_contaminated(odd, items)
    assert left.columns == odd.columns and left.count() == 11
    assert decontaminate.contained(none, items).count() == 0 and decontaminate.contained(odd, items.where("false")).count() == 0


def test_kept_rows_of_repeated_ids(spark):
    t, u = "the same words stand here in both rows of the table " * 3, "wholly other words fill this row and nothing like them was seen " * 3
    df = spark.createDataFrame([(3, t), (7, t), (7, u), (7, u), (8, u), (None, t), (None, t)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(df).collect()), key=str) == sorted([(3, t), (7, u), (None, t)], key=str)
    plan = simhash.keep_one(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(cast(doc_id") + plan.count("hashpartitioning(doc_id") <= 4, plan

def test_pieces_hold_every_run_of_words():
    rng = random.Random(2)
    for _ in range(300):
        raw = "".join(rng.choice(["a", "b", "é", " ", "  ", ",", "long" * 4]) for _ in range(rng.randrange(60))).encode()
        runs = lambda x: {tuple(w[i : i + n]) for w in [re.findall(rb"[a-z0-9_\x80-\xff]+", x)] for n in range(1, 6) for i in range(len(w) - n + 1)}
        got = [runs(x) for x in wordgrams.pieces(raw, 4, rng.choice([1, 2, 5, 17]))]
        assert set().union(*got) == runs(raw)


def test_containment_in_long_texts(spark, monkeypatch):
    """A text of 20 MB, with an item across the edge of two pieces and one at its end."""
    item = "here stands the item that is looked for in a long text of many words"
    filler = "some other words of the text. " * 700_000
    at = decontaminate.PART - 30
    long_ = filler[:at] + " " + item + " " + filler[at:]
    docs = spark.createDataFrame([(1, long_), (2, filler), (3, "é" + filler + item.upper()), (4, "x" * 3_000_000 + " " + item)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(tuple(r)[:4] for r in decontaminate.contained(docs, items).collect()) == [(d, 1, 11, 11) for d in (1, 3, 4)]
