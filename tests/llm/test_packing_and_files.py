import hashlib
import io
import random
import struct
import wave
import zipfile
import zlib

import numpy as np
import pytest

from millrace.llm import license_scan, media, packing, warc


def fewest(items, room):
    """Bins that a few items need, by exhaustive search."""
    best = len(items)

    def go(left, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not left:
            best = len(bins)
            return
        x = left[0]
        for i in range(len(bins)):
            if bins[i] + x <= room and bins[i] not in bins[:i]:
                go(left[1:], [*bins[:i], bins[i] + x, *bins[i + 1 :]])
        go(left[1:], [*bins, x])

    go(sorted(items, reverse=True), [])
    return best


def test_reduction_loses_nothing():
    rng = random.Random(3)
    for _ in range(150):
        room = rng.choice([10, 20, 31])
        items = [rng.randrange(1, room + 1) for _ in range(rng.randrange(1, 10))]
        fixed, left = packing.reduce_by_dominance({x: items.count(x) for x in items}, room)
        used = [x for n, kinds in fixed for x, k in kinds for _ in range(n * k)]
        rest = [x for x, k in left.items() for _ in range(k)]
        assert sorted(used + rest) == sorted(items) and all(sum(x * k for x, k in kinds) <= room for _, kinds in fixed)
        assert sum(n for n, _ in fixed) + fewest(rest, room) == fewest(items, room)


def test_plan_fills_every_slot_once():
    rng = random.Random(5)
    for _ in range(60):
        counts = {rng.randrange(1, 65): rng.randrange(1, 40) for _ in range(rng.randrange(1, 30))}
        rows = packing.plan(counts, 64)
        slots = []
        for x, first, copies, base, offset in rows.tolist():
            end = next((r[1] for r in rows.tolist() if r[0] == x and r[1] > first), counts[x])
            slots += [(base + (r - first) // copies, offset + (r - first) % copies * x, x) for r in range(first, end)]
        assert len(slots) == sum(counts.values())
        for b in {s[0] for s in slots}:
            at = 0
            for _, offset, x in sorted(s for s in slots if s[0] == b):
                assert offset == at
                at += x
            assert at <= 64
    assert packing.plan({}).shape == (0, 5)


def test_pieces_against_the_tokenizer(spark, odd, none, monkeypatch):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    extra = spark.createDataFrame([(50, "<|endoftext|> it's  two  spaces\n\n \t x"), (51, "né " * 2047), (52, "a" * 30_000), (53, "<|endoftext|> a"), (54, " " * 1_500_000 + "a"), (55, "it's <|endoftext|> two  words é1\n" * 50_000)], "doc_id long, text string")
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 3)
    monkeypatch.setattr(packing, "PART", 1000)
    own = packing.encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert own("<|endoftext|> a").tolist() == [50256, 257, 0]
    assert list(packing.parts("ab  cd ef gh", 3)) == ["ab  cd", " ef", " gh"] and "".join(packing.parts("x y" * 999, 7)) == "x y" * 999
    docs = odd.select("doc_id", "text").union(extra)
    assert all(own(r["text"] or "").tolist() == [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect())
    rows = packing.pack(docs, with_ids=True).collect()
    want = []
    for r in docs.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        want += [(str(r["doc_id"]), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), ids[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"], r["ids"]) for r in rows) == sorted(want)
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert packing.pack(none).count() == 0


def test_ids_of_every_code_point():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own = packing.encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for a in range(0, 0x110000, 4096):
        text = "".join(f"a{c}a {c}{c} 1{c}1!{c}!  {c}\n{c}\n" for c in map(chr, range(a, a + 4096)) if not "\ud800" <= c <= "\udfff")
        assert own(text).tolist() == [*t.encode(text, add_special_tokens=False).ids, 0], a


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "x" * 200_000
    body = "<html>" + "b" * 120
    rows = [(1, "http://a/1", body), (2, "http://a/2", body), (3, None, body), (4, "http://a/4\r\nX: y", "short"), (5, "http://a/5", "short"), (6, "http://a/6", None), (7, "http://a/7", long + "\r\n\r\né"), (2, "http://a/2", body), (None, "http://n", body), (8, "a\x01", "s"), (9, "a\x02", "s"), (10, "a%01", "s"), (11, "", "s"), (12, None, "s")]
    df = spark.createDataFrame([(*r, "z", "q") for r in rows], "page_id long, url string, html string, digest string, payload string")
    warc.write_archive(df, str(tmp_path / "w"))
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archive(spark, str(tmp_path / "w")).collect()), key=str)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and i != 7 and i != 1
        want.append((i or 0, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=str)
    assert warc.read_payloads(spark, str(tmp_path / "w")).count() == 5
    assert {r["page_id"]: r["url"] for r in warc.read_archive(spark, str(tmp_path / "w")).collect() if (r["page_id"] or 0) > 7 or r["page_id"] == 4} == {4: "http://a/4\r\nX: y", 8: "a\x01", 9: "a\x02", 10: "a%01", 11: "", 12: None}
    records = {r["page_id"]: bytes(r["record"]) for r in warc.reconstruct(spark, str(tmp_path / "w")).collect()}
    head, _, rest = records[7].partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
    assert rest[length:] == b"\r\n\r\n" and rest[:length].endswith((long + "\r\n\r\né").encode())
    assert b"\r\nX: y" not in records[4] and b"WARC-Target-URI" not in records[3] and b"WARC-Type: revisit" in records[3]
    warc.export_files(spark, str(tmp_path / "w"), str(tmp_path / "files"))
    back = warc.read_files(spark, str(tmp_path / "files") + "/*.gz").collect()
    assert len(back) == 14 and (long + "\r\n\r\né").encode() in {bytes(r["payload"]) for r in back}
    warc.write_archive(df.where("false"), str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0


def test_dates(spark, tmp_path):
    df = spark.sql("select 1L as page_id, 'u' as url, 'x' as html, timestamp'2024-02-03 04:05:06' as t union all select 2L, 'v', 'y', null")
    warc.write_archive(df, str(tmp_path / "w"), date="t")
    got = {r["page_id"]: warc.parsed(bytes(r["record"]))[0]["WARC-Date"] for r in warc.reconstruct(spark, str(tmp_path / "w")).collect()}
    assert got == {1: "2024-02-03T04:05:06Z", 2: warc.DATE}


def test_a_changed_payload_is_noticed(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a" * 200)], "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "w"))
    p = spark.read.parquet(str(tmp_path / "w/payloads"))
    p = spark.createDataFrame([(r["digest"], bytearray(zlib.compress(b"b" * 200))) for r in p.collect()], p.schema)
    p.write.mode("overwrite").parquet(str(tmp_path / "w/payloads"))
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, str(tmp_path / "w")).collect()


def test_media_round_trip(spark, odd, tmp_path):
    texts = ["", "x", "BM RIFF GIF8 .snd PK\x03\x04 %PDF-", "é" * 64, "z" * 64, "a" * 100_000, *(f"text {i}" for i in range(40))]
    machine, seen = media.automaton(), set()
    for t in texts:
        payload = media.padded(t.encode())
        assert len(payload) % 64 == 0 and payload and payload.startswith(t.encode())
        for form in media.FORMS:
            blob = media.encode(payload, form)
            found = media.outermost(media.media_in(b"junk" + blob + b"tail", machine))
            assert found == [(4, 4 + len(blob), form)]
            assert media.samples(blob, 0, len(blob), form) == payload
            assert not media.media_in(blob[:-1], machine) or form == "none"
            seen.add(form)
    assert len(seen) == 4
    with wave.open(io.BytesIO(media.encode(media.padded(b"abc"), "audio/wav"))) as w:
        assert w.readframes(64) == media.padded(b"abc")
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    rows = media.op10(spark, str(tmp_path)).collect()
    assert len(rows) == 13 and all(r["payload_bytes"] % 64 == 0 and r["n_bytes"] <= r["payload_bytes"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["payload_sha256"], set()).add(tuple(r)[1:])
    assert all(len(v) == 1 for v in by.values())


def test_many_signatures_cost_one_pass():
    import time

    machine = media.automaton()
    for unit in (b"%PDF-1 ", b"PK\x03\x04 ", b"GIF89a" + bytes(7) + b"\x21\xfe\x05", b"\xff\xd8\xff\xe0\x00\x05ab", b"\0\0\0\x10ftypisomabcd"):
        began = time.time()
        assert not [x for x in media.media_in(unit * (4_000_000 // len(unit)), machine) if x[2] != "image/bmp"]
        assert time.time() - began < 30, unit


def test_the_query_values_against_values_computed_apart(spark, tmp_path):
    texts = ["", None, "x", "é" * 64, "z" * 64, "%PDF-1 " * 300_000, *(f"text {i} " * i for i in range(60))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in media.op10(spark, str(tmp_path)).collect()}
    readers = {"audio/wav": lambda b: wave.open(io.BytesIO(b)).readframes(1 << 30), "audio/basic": lambda b: b[24:], "image/bmp": lambda b: b[1078:], "image/png": None}
    seen = set()
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        form = r["feature"].split(" ")[0]
        stored = media.encode(payload, form)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        if readers[form]:
            assert readers[form](stored) == payload
        seen.add(form)
    assert len(seen) == 4


def test_other_formats_and_sniffing(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hi")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + bytes(9) + b"\x02\x02\x44\x01\x00\x3b"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02data\xff\xd9"
    pdf = b"%PDF-1.4\nstartxref\n0\n%%EOF"
    mp4 = b"\0\0\0\x10ftypisom\0\0\0\0" + b"\0\0\0\x08moov"
    machine = media.automaton()
    for kind, blob in (("application/zip", z.getvalue()), ("image/gif", gif), ("image/jpeg", jpeg), ("application/pdf", pdf), ("video/mp4", mp4)):
        assert (0, len(blob), kind) in media.media_in(blob + b"after", machine), kind
        assert not any(x[2] == kind for x in media.media_in(blob[:-1], machine)), kind
    df = spark.createDataFrame([("a", bytearray(gif + b"mid" + jpeg), "image/png"), ("b", None, "image/png"), ("c", bytearray(b"GIF8 no"), None)], "k string, b binary, t string")
    got = {r["key"]: r for r in media.sniff(df, "k", "b", "t").collect()}
    assert got["a"]["true_type"] == "image/gif" and not got["a"]["declared_right"] and [bytes(c["data"]) for c in got["a"]["carved"]] == [jpeg]
    assert got["b"]["true_type"] == "image/png" and got["c"]["true_type"] is None


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"


def test_licences(spark, odd, none):
    assert all(any(k in form for k in license_scan.KEYS) for forms in license_scan.SENTENCES.values() for form in forms)
    parts = MIT.split("\n\n")
    texts = {1: MIT, 2: "\n".join([parts[1], parts[0], parts[2]]), 3: "x. Licensed under the Apache License, Version 2.0. y", 4: "Not licensed under the Apache License, Version 2.0", 5: "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", 6: None, 7: parts[0] + "\nother words.\n" + parts[1] + " And more. " + parts[2]}
    got = {r["doc_id"]: (r["sentence_ids"], r["licences"]) for r in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1] == (["mit_grant", "mit_condition", "mit_asis"], ["MIT"]) and got[2][1] == [] and got[3] == (["apache2_notice"], ["Apache-2.0"]) and got[4] == ([], [])
    assert got[5][1] == ["CC-BY-NC-4.0", "MIT"] and got[6] == ([], []) and got[7][1] == ["MIT"]
    rows = license_scan.scan(odd)
    assert rows.count() == 13 and license_scan.scan(none).count() == 0 and "Python" not in rows._jdf.queryExecution().toString()


def test_wrapped_licences(spark):
    import textwrap

    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of FITNESS.\n\nYou should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>."
    wrap = lambda t, mark="", end="\n": end.join(mark + line for part in t.split("\n\n") for line in [*textwrap.wrap(part, 70), ""])
    texts = [wrap(MIT), wrap(MIT, " * "), wrap(MIT, "", "\r\n"), "MIT License\n" + wrap(MIT), gpl, wrap(gpl, "# "), wrap(gpl.replace("version 3", "version 2"), "// "), wrap("Licensed under the MIT License") + "\n" + wrap("All rights reserved")]
    got = {r["doc_id"]: r["licences"] for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [["MIT"]] * 4 + [["GPL-3.0-or-later"]] * 2 + [["GPL-2.0-or-later"], ["MIT", "Proprietary"]]


TEXTS = {
    "BSD-3-Clause": """Copyright (c) 2024, Someone. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
""",
    "GPL-2.0-or-later": """/* This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License
 * along with this program; if not, write to the Free Software. */""",
    "GPL-2.0-only": """# This program is free software; you can redistribute it and/or
# modify it under the terms of the GNU General Public License
# version 2 as published by the Free Software Foundation.
""",
    "LGPL-2.1-or-later": """   This library is free software; you can redistribute it and/or
   modify it under the terms of the GNU Lesser General Public
   License as published by the Free Software Foundation; either
   version 2.1 of the License, or (at your option) any later version.
""",
    "AGPL-3.0-or-later": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU Affero General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
""",
    "MPL-2.0": """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE""",
    "EPL-2.0": """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/

SPDX-License-Identifier: EPL-2.0""",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all\ncopyright and related and neighboring rights to this software to the\npublic domain worldwide. This software",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
""",
}


def test_whole_licence_texts_and_their_sql(spark, odd, tmp_path):
    import duckdb

    bsd2 = TEXTS["BSD-3-Clause"].split("3. Neither")[0]
    texts = [*TEXTS.items(), ("BSD-2-Clause", bsd2), *((n, t.replace("\n", "\r\n")) for n, t in TEXTS.items())]
    rows = [(i, t) for i, (_, t) in enumerate(texts)]
    got = {r["doc_id"]: r["licences"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(n, got[i]) for i, (n, _) in enumerate(texts)] == [(n, [n]) for n, _ in texts]
    more = [(1000 + i, f"{a}{x}{b}") for i, (a, b, x) in enumerate((a, b, x) for (_, a), (_, b) in zip(texts, texts[1:], strict=False) for x in ("", "\n", "\n\n", ". ", " \n \t\n"))]
    df = spark.createDataFrame([*rows, *more], "doc_id long, text string").union(odd.where("doc_id is not null").select("doc_id", "text").dropDuplicates(["doc_id"]).selectExpr("doc_id + 5000", "text"))
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(license_scan.OP3_SQL).fetchall())
    assert sorted(tuple(r) for r in license_scan.op3(spark, str(tmp_path)).collect()) == want and len(want) > 100
