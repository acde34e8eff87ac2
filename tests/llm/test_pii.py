import hashlib
import random
import re

from pyspark.sql import functions as F

from millrace.llm import pii
from millrace.llm.common import Scratch

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good(k, m[0])]


def base(df):
    spans = F.transform("b", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return {r["i"]: r["s"] for r in df.select("i", pii.base_spans(F.coalesce("t", F.lit(""))).alias("b")).select("i", spans.alias("s")).collect()}


def test_against_the_plain_patterns(spark):
    rng = random.Random(4)
    bits = ["a@b.c", "a@b", "@", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (234) 555-0100", "+", "-", " ", "é", "🙂", "7", "12", "..", "_", "%", "x", "\n", "0000 0000 0000 0", "a@b.c-d.e", "00255.0.0.001"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(2500)]
    texts += [None, "", "1 " * 30_000, "1." * 30_000, "a" * 100_000, "a." * 30_000 + "@" + "b." * 30_000, "a@" * 20_000, "+1" + " " * 50_000, "1.2.3.4 " * 2_000]
    got = base(spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8))
    assert all(got[i] == brute(t) for i, t in enumerate(texts))


def test_terms_that_disclose(spark):
    rng = random.Random(1)
    common = ["the", "and", "said", "again", "people"]
    rows = [(i, " ".join(rng.choice(common) for _ in range(30))) for i in range(300)]
    for i in range(4):
        rows.append((1000 + i, f"{' '.join(rng.choice(common) for _ in range(9))} Zebulon Quark said jo@ex.org and the people {rng.choice(common)}"))
    df = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    found = {r["doc_id"]: r["added"] for r in pii.detect(df, Scratch(spark, "t")).collect()}
    texts = dict(rows)
    assert len(found) == 306
    for i, added in found.items():
        words = {texts[i][a["start"] : a["end"]] for a in added} if i in texts else set()
        assert words == ({"Zebulon", "Quark"} if 1000 <= i < 1004 else set())
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[5000] is None and clean[5001] == "" and all(clean[i] == t for i, t in rows if i < 1000)
    assert "[EMAIL]" in clean[1000] and "Zebulon" not in clean[1000] and "jo@" not in clean[1000] and "people" in clean[1000]


def test_terms_far_away_and_elsewhere(spark):
    rng = random.Random(4)
    fill = lambda: " ".join(rng.choice(["the", "and", "said", "again", "people"]) for _ in range(40))
    rows = [(i, fill()) for i in range(400)]
    rows += [(1000 + i, f"Zebulon {fill()} then jo@ex.org {fill()} zebulon") for i in range(9)]
    rows += [(2000, f"{fill()} ZEBULON {fill()}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["added"] for r in pii.detect(df, Scratch(spark, "t")).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    for i, t in rows:
        words = [t[a["start"] : a["end"]] for a in found[i]]
        assert [w.lower() for w in words if w != "then"] == ["zebulon"] * (2 if 1000 <= i < 1009 else i == 2000)
        assert "zebulon" not in clean[i].lower()


def test_overlaps_merge(spark):
    t = "call +4111111111111111 or 1.2.3.4 now"
    spans = "array(named_struct('start', 5, 'end', 22, 'label', '[A]'), named_struct('start', 6, 'end', 22, 'label', '[B]'), named_struct('start', 26, 'end', 33, 'label', '[C]'))"
    assert spark.range(1).select(pii.sanitised(F.lit(t), F.expr(spans)).alias("r")).first()["r"] == "call [A] or [C] now"


def test_odd_rows(spark, odd, none, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    rows = pii.op2(spark, str(tmp_path)).collect()
    assert len(rows) == 13 and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)
    out = pii.sanitise(odd)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.withColumn("n_chars", F.length("text").cast("long")).collect()))
    assert pii.sanitise(none).count() == 0
    plan = pii.sanitise(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_spans_against_plain_loops(spark):
    import random

    rng = random.Random(11)
    rows = []
    for i in range(120):
        n = rng.choice([0, 3, 30, 300])
        text = "".join(rng.choice("ab é🙂\n") for _ in range(n * 5 + rng.choice([0, 1, 9000])))
        places = [sorted((rng.randrange(len(text) + 1), rng.randrange(len(text) + 1))) for _ in range(n)] if text else []
        spans = sorted((a, min(b, a + 40), f"[{k}]") for k, (a, b) in enumerate(places) if a < b)
        words, at = [], 0
        while at < len(text):
            words.append((at, min(len(text), at + rng.randrange(1, 9))))
            at = words[-1][1] + rng.randrange(0, 30)
        rows.append((i, text, spans, words))
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:int,end:int,label:string>>, words array<struct<start:int,end:int>>")
    got = {r["i"]: r for r in df.select("i", pii.sanitised(F.col("text"), F.col("spans")).alias("clean"), pii._apart(F.col("words"), F.col("spans")).alias("apart")).collect()}
    for i, text, spans, words in rows:
        merged = []
        for a, b, label in spans:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b, label])
        out, at = "", 0
        for a, b, label in merged:
            out, at = out + text[at:a] + label, b
        assert got[i]["clean"] == out + text[at:]
        assert [tuple(w) for w in got[i]["apart"]] == [w for w in words if not any(w[0] < b and w[1] > a for a, b, _ in spans)]


def test_very_many_spans_cost_no_quadratic_time(spark):
    import time

    from millrace.llm.common import Scratch

    text = "".join(f"word{i} name{i}@mail.example and +49 30 {1000000 + i} " for i in range(50_000))  # 100,000 spans
    long = "plain words of a text. " * 900_000  # 20 MB
    docs = spark.createDataFrame([(1, text, len(text)), (2, long, len(long)), (3, "a@b.cc", 6)], "doc_id long, text string, n_chars long").repartition(3)
    began = time.time()
    rows = {r["doc_id"]: r for r in pii.detect(docs, Scratch(spark, "many")).select("doc_id", F.size("base").alias("n")).collect()}
    assert (rows[1]["n"], rows[2]["n"], rows[3]["n"]) == (100_000, 0, 1)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[1] == "".join(f"word{i} [EMAIL] and [PHONE] " for i in range(50_000)) and clean[2] == long and clean[3] == "[EMAIL]"
    assert time.time() - began < 240
