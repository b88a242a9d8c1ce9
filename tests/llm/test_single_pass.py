"""Licences, pages, tokens and audio: operators on single rows."""

import hashlib
import os
import pathlib
import re
import time
import random
import struct
import zlib

import numpy as np
import pytest
from helpers import empty, messy, words
from pyspark.sql import functions as F

from corvane.llm import html_extract, license_scan, telephony, unigram

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and so on.
The above copyright notice and this permission notice shall be included in all copies or parts.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""


def test_licence_rules():
    found = lambda t: license_scan.licences(license_scan.sentence_ids(t))
    assert found(MIT) == (["MIT"], []) and found("Prose. Licensed under CC BY-NC 4.0. More.") == (["CC-BY-NC-4.0"], [])
    assert found("This work is licensed under the GNU General Public License, version 3.") == (["GPL-3.0"], [])
    assert found("Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.") == (["Apache-2.0", "MIT"], [])
    assert found("All rights reserved.") == ([], ["all-rights"]) and found("SPDX-License-Identifier: BSD-3-Clause") == (["BSD-3-Clause"], [])
    assert found("The driver needs a licence and a program.") == ([], []) and found("GNU Lesser General Public License is here") == (["LGPL"], [])
    assert found("Redistribution and use in source and binary forms, with or without modification, are permitted provided so. Redistributions of source code must retain the above copyright notice, this list. Redistributions in binary form must reproduce the above copyright notice too. This software is provided by the authors \"as is\" and any express or implied warranties are disclaimed.") == (["BSD-2-Clause"], [])


def test_licence_rows(spark):
    df = messy(spark)
    assert license_scan.scan(df).count() == df.count() and license_scan.scan(empty(spark)).count() == 0
    long = spark.createDataFrame([(1, words(1, 50_000) + ".\nReleased under the MIT License."), (2, None)], "doc_id long, text string")
    assert [r.licenses for r in license_scan.scan(long).orderBy("doc_id").collect()] == ["MIT", ""]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a="</p><p>no";</script></head><body>
<header><p>Site header with a long slogan that goes on</p></header><nav><ul><li><a href=/>Home</a><li><a href=/b>About us</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site better for you.</p></div>
<div id=content><h1>The   title</h1><p>First <b>paragraph &amp; text</b>, with
a line break.<br>And more.</p><!-- <p>hidden</p> --><div class="ad">Buy now!</div><p>Second paragraph &lt;here&gt; is long enough to count as text.<p>Third one is unclosed
<ul><li>item one<li>item two</ul><form><input><button>Send</button></form><aside>Related stories</aside></div>
<div class="comments"><p>Great article, thanks a lot for writing all of this down for us!</p></div><footer>&copy; Site</footer></body></html>"""


def test_article_of_a_page():
    assert html_extract.main_text(PAGE) == "The title\nFirst paragraph & text, with a line break. And more.\nSecond paragraph <here> is long enough to count as text.\nThird one is unclosed\nitem one\nitem two"


def test_articles_without_markers():
    body = "".join(f"<p>{words(i, 40)}</p>" for i in range(4))
    page = f"<div><div class=menu><a href=1>one</a><a href=2>two</a></div><div><div>{body}</div></div><table><tr><td><a href=3>x</a></table></div>"
    assert html_extract.main_text(page) == "\n".join(words(i, 40) for i in range(4))
    assert html_extract.main_text(f"<form><div class='page with-sidebar'><h1>A</h1>{body}</div></form>") == "A\n" + "\n".join(words(i, 40) for i in range(4))
    assert html_extract.main_text(f"<div class='content with-sidebar'>{body}</div>") == "\n".join(words(i, 40) for i in range(4))
    assert html_extract.main_text("<article><h1>A</h1>" + body + "</article><section class='comments'>" + body + "</section>").startswith("A\n")


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "</p></div>", "<script>x", "<!-- open", "plain text", "<div " * 50, "<b>" * 3000 + "deep" + "</b>" * 3000, "<p>a<p>b</div></p>c", "&bogus; &#0; &#x110000;", "<a href=x>only a link</a>", "a < b and c > d"])
def test_broken_pages_do_not_crash(page):
    assert isinstance(html_extract.main_text(page), str)


def test_random_markup_does_not_crash():
    rng = random.Random(0)
    bits = ["<div>", "</div>", "<p>", "</p>", "<a href='x'>", "</a>", "text here", "<br>", "<table><tr><td>", "</table>", "<li>", "<!--", "-->", "<script>", "</script>", "&amp;", "<", ">", '"']
    for _ in range(300):
        html_extract.main_text("".join(rng.choices(bits, k=rng.randint(0, 40))))


def test_page_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "v", PAGE), (2, None, ""), (3, "w", f"<p>{words(1, 40_000)}</p>")], "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("z"))
    got = html_extract.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 5 and all(r.n_chars == len(r.text) for r in got.collect())
    assert html_extract.extract(df.limit(0)).count() == 0


model = pytest.mark.skipif(not os.path.exists(unigram.MODEL), reason="no vocabulary file")


def brute_encode(text, pieces):
    """Viterbi over characters with a plain dictionary."""
    table = {p.decode().replace("▁", " "): (i, s) for i, (p, s, k) in enumerate(pieces) if k in (unigram.NORMAL, unigram.USER)}
    bytes_ = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == unigram.BYTE}
    low = min(s for _, s in table.values() if s > -1e8) - unigram.UNKNOWN_PENALTY
    s = " " + text.replace("▁", " ")
    best, back = [0.0] + [-1e300] * len(s), [None] * (len(s) + 1)
    for i in range(len(s)):
        covered = False
        for j in range(i + 1, min(len(s), i + 16) + 1):
            if s[i:j] in table:
                covered |= j == i + 1
                if best[i] + table[s[i:j]][1] > best[j]:
                    best[j], back[j] = best[i] + table[s[i:j]][1], (i, [table[s[i:j]][0]])
        if not covered and best[i] + low > best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + low, (i, [bytes_[b] for b in s[i].encode()])
    out, k = [], len(s)
    while k:
        out, k = back[k][1] + out, back[k][0]
    return out if text else []


@model
def test_encoding_matches_brute_force_and_comes_back():
    v, pieces = unigram.vocabulary(), unigram.read_model()
    rng = random.Random(1)
    texts = ["", " ", "Hello world", "  two  spaces ", "żółć €𓀀\x00\n\tend", "x" * 200, words(1, 40), "The quick brown fox's naïve café – 東京 Ω"] + ["".join(rng.choices("ab é€𓀀 the\n", k=30)) for _ in range(60)]
    for t, ids in zip(texts, v.encode_batch([t.encode() for t in texts])):
        assert ids.tolist() == [int(x) for x in brute_encode(t, pieces)] and v.decode(ids) == t.encode()
    assert v.encode_chunk(b" hello") == v.encode_chunks([b" hello"])[0].tolist()


@model
def test_token_rows(spark):
    df = messy(spark)
    out = unigram.decode(unigram.encode(df, check_col="back"))
    rows = out.collect()
    assert len(rows) == df.count() and out.columns == [*df.columns, "token_ids", "back", "decoded"]
    for r in rows:
        assert (r.token_ids is None) == (r.text is None) and (r.text is None or r.back == (r.decoded == r.text))
        assert r.text is None or "▁" in r.text or r.back
    d = unigram.token_digest(df)
    assert d.count() == df.count() and d.filter("not round_trip").count() == 1 and unigram.token_digest(empty(spark)).count() == 0 and unigram.encode(empty(spark)).count() == 0


def test_double_array_of_a_small_vocabulary():
    pieces = [(b"<unk>", 0.0, 2)] + [(f"<0x{i:02X}>".encode(), 0.0, 6) for i in range(256)] + [("▁a".encode(), -1.0, 1), (b"ab", -1.5, 1), (b"b", -2.0, 1), ("▁".encode(), -3.0, 1), (b"a", -2.5, 1)]
    v = unigram.Unigram(pieces)
    assert v.encode_chunk(b" ab") == [257, 259] and v.encode_chunk(b" aab") == [257, 258]
    assert v.decode(v.encode_batch([b"z ab"])[0]) == b"z ab"
    with pytest.raises(ValueError):
        unigram.Unigram(pieces + [("a▁".encode(), -1.0, 1)])


def test_g711_tables_by_the_standard():
    mu, a = telephony.mu_law_table(), telephony.a_law_table()
    assert mu[[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0] and a[[0x2A, 0xAA, 0x55, 0xD5]].tolist() == [-32256, 32256, -8, 8]
    assert len(set(a.tolist())) == 256 and len(set(mu.tolist())) == 255
    x = np.arange(-32768, 32768).astype(np.int16)
    for t in (mu, a):
        near = t[telephony.encode_law(x, t)].astype(int)
        best = np.abs(np.sort(t.astype(int))[None] - x[::257, None].astype(int)).min(axis=1)
        assert (np.abs(near - x)[::257] == best).all()


def test_ima_blocks_match_one_by_one():
    def plain(data, block):
        out = []
        for at in range(0, len(data), block):
            b = data[at : at + block]
            if len(b) < 4:
                break
            v, i = int.from_bytes(b[:2], "little", signed=True), min(b[2], 88)
            out.append(v)
            for byte in b[4:]:
                for c in (byte & 15, byte >> 4):
                    step = int(telephony.STEPS[i])
                    d = step >> 3
                    d += (step if c & 4 else 0) + (step >> 1 if c & 2 else 0) + (step >> 2 if c & 1 else 0)
                    v = max(-32768, min(32767, v - d if c & 8 else v + d))
                    i = max(0, min(88, i + (-1 if c & 7 < 4 else (c & 3) * 2 + 2)))
                    out.append(v)
        return out

    data = random.Random(2).randbytes(256 * 5 + 37)
    assert telephony.decode_ima(data, 256).tolist() == plain(data, 256)
    x = (9000 * np.sin(np.arange(3000) / 9)).astype(np.int16)
    back = telephony.decode(telephony.wave(telephony.encode_ima([x]), telephony.IMA_ADPCM))[1][: len(x)]
    assert np.abs(back.astype(int) - x).max() < 600


def test_containers_and_resampling(spark):
    for form, data in ((telephony.MU_LAW, b"\1\2\3"), (telephony.A_LAW, b""), (telephony.PCM, b"\0\1\2\3")):
        got = telephony.read_wave(telephony.wave(data, form))
        assert got[0] == form and got[5] == data
    x = np.array([0, 100, 50], np.int16)
    assert telephony.resample(x, 8000, 16000).tolist() == [0, 50, 100, 75, 50, 50] and len(telephony.resample(x, 8000, 4000)) == 2
    df = telephony.samples(telephony.store_text(messy(spark)).unionByName(spark.createDataFrame([(77, 0, b"junk"), (78, 0, None)], "id long, n_bytes long, media binary")))
    bad = {r.id: r.pcm for r in df.collect()}
    assert bad[77] is None and bad[78] is None and telephony.read_wave(bytes(bad[1]))[2] == 16000


def wave_of(form, channels, rate, block, bits, data, extensible=False):
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else form, channels, rate, rate * block, block, bits)
    fmt += struct.pack("<HHIH14x", 22, bits, 0, form) if extensible else b""
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_forms_of_wave_files(spark):
    pcm = [0, 1000, -1000, 32767, -32768, 17]
    good = {
        "stereo": wave_of(1, 2, 8000, 4, 16, np.array([[x, x // 2] for x in pcm], "<i2").tobytes()),
        "8 bits": wave_of(1, 1, 8000, 1, 8, bytes([128, 255, 0])),
        "24 bits": wave_of(1, 1, 8000, 3, 24, b"".join((x * 256 + 99).to_bytes(3, "little", signed=True) for x in pcm)),
        "32 bits": wave_of(1, 1, 8000, 4, 32, b"".join((x * 65536 + 9).to_bytes(4, "little", signed=True) for x in pcm), True),
    }
    assert telephony.decode(good["stereo"])[1].tolist() == [round((x + x // 2) / 2) for x in pcm]
    assert telephony.decode(good["8 bits"])[1].tolist() == [0, 127 * 256, -32768] and telephony.decode(good["24 bits"])[1].tolist() == pcm == telephony.decode(good["32 bits"])[1].tolist()
    bad = {
        "MS ADPCM": wave_of(2, 1, 8000, 256, 4, b"\0" * 512), "float": wave_of(3, 1, 8000, 4, 32, b"\0" * 8), "rate 0": wave_of(7, 1, 0, 1, 8, b"abc"), "no channel": wave_of(1, 0, 8000, 2, 16, b"ab"),
        "block 0": wave_of(0x11, 1, 8000, 0, 4, b"abcd"), "stereo ADPCM": wave_of(0x11, 2, 8000, 256, 4, b"\0" * 256), "cut": good["stereo"][:30], "no data": good["stereo"][:50], "12 bits": wave_of(1, 1, 8000, 2, 12, b"abcd"),
    }
    rows = [(k, v, "mine") for k, v in (good | bad).items()] + [("null", None, "mine")]
    out = {r.name: r for r in telephony.samples(spark.createDataFrame(rows, "name string, media binary, pcm string"), rate=8000).collect()}
    assert out["null"].pcm is None and out["null"].pcm_reason is None and len(out["null"]) == 4
    assert all(out[k].pcm_reason is None and telephony.decode(bytes(out[k].pcm))[0] == 8000 for k in good) and all(out[k].pcm is None and out[k].pcm_reason for k in bad)


def test_resampling_down_keeps_out_what_the_new_rate_cannot_hold():
    t = np.arange(8000)
    low, high = (9000 * np.sin(t * 2 * np.pi * hz / 16000) for hz in (440, 7000))
    down = telephony.resample((low + high).astype(np.int16), 16000, 8000)
    assert len(down) == 4000 and np.abs(down - low[::2])[100:-100].max() < 400


def test_feature_by_brute_force(spark):
    texts = ["", "a", "Telephony \u00e9 \U0001f600 " * 40, "x" * 1500]
    got = {r.id: r for r in telephony.describe(telephony.store_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for i, text in enumerate(texts):
        data = text.encode() + b"\0" * (-len(text.encode()) % 64 if text else 64)
        law = lambda u: (lambda v: -(((v & 15) << 3) + 132 << ((v & 112) >> 4)) + 132 if v & 128 else (((v & 15) << 3) + 132 << ((v & 112) >> 4)) - 132)(~u & 255)
        x = [law(u) for u in data]
        wide = [v for k, a in enumerate(x) for v in (a, (a + x[min(k + 1, len(x) - 1)]) >> 1)]
        back = []
        for at in range(0, len(x), 505):
            part = x[at : at + 505]
            full = part + [part[-1]] * (505 - len(part))
            back += telephony.decode_ima(telephony.encode_ima([np.array(full, np.int16)]), 256).tolist()[: len(part)]
        rms, zc = int(np.sqrt(sum(v * v for v in wide) / len(wide))), sum((a < 0) != (b < 0) for a, b in zip(wide, wide[1:]))
        assert got[i].feature == f"n={len(wide)};peak={max(map(abs, wide))};rms={rms};zc={zc};ima={sum(abs(a - b) for a, b in zip(x, back)) // len(x)}"
        assert got[i].pcm_bytes == 44 + 4 * len(data) and got[i].adpcm_bytes == 60 - 12 + 256 * -(-len(data) // 505)


def test_stored_texts_come_back(spark):
    df = messy(spark)
    stored = telephony.store_text(df)
    for r in stored.collect():
        assert len(telephony.read_wave(bytes(r.media))[5]) % 64 == 0
    texts = sorted((r.text or "").encode() for r in df.collect())
    got = telephony.describe(stored).collect()
    want = []
    for t in texts:
        p = t + b"\0" * (-len(t) % 64 if t else 64)
        want.append((len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault((r.payload_sha256, r.n_bytes), set()).add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in by.values()) and telephony.describe(telephony.store_text(empty(spark))).count() == 0


def test_hard_wrapped_licences():
    import textwrap

    mit = ["MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.']
    bsd = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING THOSE OF FITNESS, ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DAMAGES.']
    apache = ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "    http://www.apache.org/licenses/LICENSE-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS.']
    for want, paragraphs in (("MIT", mit), ("BSD-2-Clause", bsd), ("Apache-2.0", apache)):
        for width in (50, 72, 80, 500):
            for prefix in ("", "# ", " * "):
                lines = [line for p in paragraphs for line in [*textwrap.wrap(p, width), ""]]
                assert license_scan.licences(license_scan.sentence_ids("\n".join(prefix + x for x in lines))) == ([want], []), (want, width, prefix)


GNU = """This {it} is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.

This {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the {name} for more details.

You should have received a copy of the {name} along with this {it}; if not, see <https://www.gnu.org/licenses/>.
"""
ISC = """Copyright (c) 2020, Somebody

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER.
"""
BSD_3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT DAMAGES.
"""
NOTICES = [
    ("GPL-2.0", GNU.format(it="program", name="GNU General Public License", version=2)), ("GPL-3.0", GNU.format(it="program", name="GNU General Public License", version=3)),
    ("LGPL-2.1", GNU.format(it="library", name="GNU Lesser General Public License", version="2.1")), ("LGPL-3.0", GNU.format(it="library", name="GNU Lesser General Public License", version=3)),
    ("AGPL-3.0", GNU.format(it="program", name="GNU Affero General Public License", version=3)), ("ISC", ISC), ("BSD-3-Clause", BSD_3),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software.\n"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.\n"),
]


def test_notices_wrapped_in_any_way():
    import textwrap

    for want, text in NOTICES:
        for width in (40, 72, 2000):
            for prefix in ("", "# ", " * ", "// "):
                lines = [line for p in text.split("\n\n") for line in [*textwrap.wrap(p, width), ""]]
                found, rest = license_scan.licences(license_scan.sentence_ids("\n".join((prefix + x).rstrip() for x in lines)))
                assert found == [want] and not rest, (want, width, prefix, found, rest)


@pytest.mark.parametrize("name, want", [("Apache-2.0", "Apache-2.0"), ("BSD", "BSD-3-Clause"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("MPL-1.1", "MPL-1.1"), ("CC0-1.0", "CC0-1.0"), ("GFDL-1.3", "GFDL-1.3"), ("Artistic", "Artistic")])
def test_full_texts(name, want):
    path = pathlib.Path("/usr/share/common-licenses") / name
    if not path.exists():
        pytest.skip("no licence texts here")
    found, _ = license_scan.licences(license_scan.sentence_ids(path.read_text()))
    assert want in found


def test_every_sentence_has_a_trigger_and_long_lines_are_linear():
    assert all(re.search(license_scan.TRIGGER, " ".join(p) + " ") for _, _, p in license_scan.SENTENCES)
    assert {s for _, run in license_scan.RULES for s in run.split()} <= {s for s, _, _ in license_scan.SENTENCES}
    began = time.perf_counter()
    for line in ("released under the gpl gnu license ", "gnu general public license ", "neither the name cc by "):
        license_scan.sentence_ids(line * (1_000_000 // len(line)))
    assert time.perf_counter() - began < 3


def test_licence_sql_on_wrapped_texts(spark, tmp_path):
    import duckdb
    import textwrap

    texts = [*(t for _, t in NOTICES), *("\n".join(textwrap.wrap(t, 60)) for _, t in NOTICES), MIT, *("\n".join("# " + x for x in textwrap.wrap(t, 50)) for _, t in NOTICES), "Licensed under CC BY-SA 4.0. SPDX-License-Identifier: LGPL-2.1-only\nAll rights\nreserved.", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, license_scan.scan(df).collect()))
    c = duckdb.connect()
    frame = df.toPandas()
    c.register("documents", frame)
    assert got == sorted(c.execute(license_scan.LICENSE_SQL).fetchall())


def brute_densest(root):
    """The densest node by the definition, each node counted anew from its whole subtree."""
    import math

    def counts(x):
        if x.tag in html_extract.RAW or x.hidden:
            return 0, 0, 0, 0
        c = sum(len(k.replace(" ", "")) for k in x.kids if isinstance(k, str) and k.strip())
        below = [counts(k) for k in x.kids if not isinstance(k, str)]
        c, t = c + sum(b[0] for b in below), sum(b[1] + 1 for b in below)
        return (c, t, c, t + 1) if x.tag == "a" else (c, t, sum(b[2] for b in below), sum(b[3] for b in below))

    def density(x):
        c, t, lc, lt = counts(x)
        if c == lc:
            return 0.0
        t = max(t, 1)
        value = math.log(c / max(lc, 1) * t / max(lt, 1)) if c / max(lc, 1) * t / max(lt, 1) > 1 else 0.0
        return c / t * value / math.log(c / (c - lc) * lc + whole[2] / max(whole[0], 1) * c + math.e)

    nodes = list(html_extract._walk(root))
    body = next((x for x in nodes if x.tag == "body"), root)
    whole = counts(body)
    under = list(html_extract._walk(body))
    sums = [sum(density(k) for k in x.kids if not isinstance(k, str)) for x in under]
    best = max(sums)
    return [x for x, s in zip(under, sums) if s == best or best and abs(s - best) < 1e-9 * best], density


def test_density_matches_brute_force():
    import pyarrow.parquet as pq

    pages = [PAGE, "<p>x</p>", "plain", "<body><div><p>a<a href=x>b</a></div><div>cc</div></body>"]
    if os.path.isdir("/root/testdata/sf0.001"):
        pages += [p for p in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist() if p][:40]
    for page in pages:
        root = html_extract.parse(page)
        body = html_extract.measure(root)
        best, density = brute_densest(root)
        assert html_extract.densest(body) in best
        for x in html_extract._walk(body):
            assert abs(x.score - density(x)) <= 1e-9 * max(1.0, x.score)


def test_parts_of_the_article_stay():
    p = f"<p>{words(1, 60)}</p>"
    page = f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header><section class='related-work'>{p}</section><p class='search'>Search trees.</p><div class='related-posts'>Others</div><p>Yes.</p></article></body>"
    assert html_extract.main_text(page) == f"Title\n{words(1, 60)}\nSearch trees.\nYes."
    several = "".join(f"<article><h2>Part {i}</h2><p>{words(i, 50)}</p></article>" for i in range(3))
    assert html_extract.main_text(f"<body><nav><a href=/>Home</a></nav><div>{several}</div><footer>End of it</footer></body>").count("Part") == 3
    menu = "<div><ul>" + "".join(f"<li><a href=/{i}>Entry {i}</a></li>" for i in range(9)) + "</ul></div>"
    assert html_extract.main_text(f"<body><div><h1>T</h1>{p}{menu}{p}</div></body>") == f"T\n{words(1, 60)}\n{words(1, 60)}"


def test_nested_pages_take_linear_time():
    def seconds(n):
        began = time.perf_counter()
        for page in ("<div>" * n + "<dd></dd>" * n, "<b>" * n + "<p>x</p>" * n, "<dd><dl>" + "<div>" * n + "<dt></dt>" * n, "<p>" * n + "</div>" * n, "<li><ul>" + "<b>" * n + "<li>x" * n, "<div>" * n + "</b>" * n):
            html_extract.main_text(page)
        return time.perf_counter() - began

    seconds(500)
    assert seconds(32_000) < 12 * seconds(4_000) + 1
