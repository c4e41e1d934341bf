"""Toxicity, BPE, licence scan, decontamination, chats and HTML against brute force and their defined results."""

import math
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest

from textmill.llm import bpe, chat_format, common, decontaminate, html_style_tree, license_scan, toxicity

WORDS = [a + b for a in "ba ce di fo gu ha ki lo mu ne".split() for b in "ra se ti vo xu".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))


# toxicity


@pytest.fixture(scope="module")
def labelled():
    rng, rows, labels = random.Random(4), [], []
    for i in range(900):
        words = prose(rng, rng.randrange(5, 60)).split()
        toxic = i % 5 == 0
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Grobian", "schuft", "lump", "wicht"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out(spark, documents, labelled):
    rows, labels = labelled
    train = spark.createDataFrame(labels[:600], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(documents(rows), train).collect()}
    held = labels[600:]
    caught = sum(got[i].toxic for i, y in held if y) / sum(y for _, y in held)
    wrong = sum(got[i].toxic for i, y in held if not y) / sum(1 - y for _, y in held)
    assert caught >= 0.95 and wrong <= 0.01
    at, w, _ = np.load(__import__("io").BytesIO(toxicity.train(documents(rows), train))).values()
    assert len(at) == len(w) < 2000  # L1 leaves few weights


def test_toxicity_odd_rows(spark, documents, labelled):
    rows, labels = labelled
    odd = rows + [(2000, None), (2001, ""), (2002, "schuft lump " * 100_000), (None, "schuft lump wicht"), (2003, rows[0][1]), (2003, rows[0][1])]
    marks = spark.createDataFrame(labels + [(0, None), (7777, 1), (None, 1), (1, 0)], "doc_id bigint, toxic int")
    got = defaultdict(list)
    for r in toxicity.toxicity(documents(odd), marks).collect():
        got[r.doc_id].append((r.score, r.toxic))
    assert got[2000] == [(None, False)]
    assert got[2001][0][1] is False and got[2001][0][0] is not None
    assert got[2002][0][1] and got[None][0][1]
    assert got[2003] == got[0] * 2
    kept = toxicity.drop_toxic(documents(odd), marks)
    assert kept.columns == ["doc_id", "text", "n", "digest"]
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {2000, 2001} <= ids and not {0, 2002, None, 2003} & ids


def test_toxicity_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [tuple(r) for r in toxicity.toxicity(documents([(1, "a"), (2, None)]), none).orderBy("doc_id").collect()] == [(1, 0.0, False), (2, None, False)]
    assert toxicity.toxicity(documents([]), none).count() == 0


def test_ftrl_step():
    """One step by the published formulas."""
    s = toxicity.Settings(bits=4, l1=0.1, l2=0.5, alpha=0.5, beta=2.0)
    model = toxicity.Ftrl(s)
    model.learn(np.array([3]), 1.0)
    g = 0.5 - 1
    assert model.z[3] == pytest.approx(g) and model.n[3] == pytest.approx(g * g)
    assert model.weights(np.array([3]))[0] == pytest.approx((math.copysign(0.1, g) - g) / ((2 + 0.5) / 0.5 + 0.5))


def plain_features(text, bits):
    """Buckets of unigrams, bigrams and one-word skip-grams, from the words one by one."""
    words = re.findall(r"\w+", text.lower())
    raw = " ".join(words).encode()
    h = common.word_table(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hashes

    def bucket(x):
        return int(common.mix(np.array([x & (1 << 64) - 1], np.uint64))[0]) >> 64 - bits

    found = {bucket(int(x) + 0x51) for x in h}
    for gap, salt in ((1, 0xA5), (2, 0xC3)):
        for a, b in zip(h, h[gap:]):
            second = int(common.mix(np.array([b], np.uint64) + np.uint64(salt))[0])
            found.add(bucket(int(a) * 0x9DDFEA08EB382D69 + second))
    return sorted(found)


def plain_ftrl(rows, s):
    """FTRL-proximal with dictionaries, one coordinate after the other; returns the scores of all rows."""
    z, n = defaultdict(float), defaultdict(float)
    bias = -1

    def weight(i):
        l1 = 0.0 if i == bias else s.l1
        if abs(z[i]) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    def chance(x):
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(weight(i) for i in [*x, bias])))))

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for k in order.permutation(len(rows)):
            x, y = rows[k]
            old, g = {i: weight(i) for i in [*x, bias]}, chance(x) - y
            for i, w in old.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * w
                n[i] += g * g
    return [chance(x) for x, _ in rows]


def test_toxicity_against_plain_ftrl(spark, documents, labelled):
    """The whole query, training included, against FTRL with dictionaries over the same rows."""
    settings = toxicity.Settings(bits=12, l1=0.5, epochs=2)
    rows, labels = labelled[0][:250], labelled[1][:250]
    want = plain_ftrl([(plain_features(t, 12), y) for (_, t), (_, y) in zip(rows, labels)], settings)
    got = {r.doc_id: r for r in toxicity.toxicity(documents(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"), settings).collect()}
    assert [got[i].score for i, _ in rows] == pytest.approx(want, abs=1e-4)
    assert all(got[i].toxic == (got[i].score >= settings.threshold) for i, _ in rows)


def test_toxicity_sample(spark, documents, labelled):
    """Labels without a text take no place in the sample, the largest label counts, and repeated ids don't add rows."""
    rows, labels = labelled
    settings = toxicity.Settings(train_rows=600)
    bare = [(i, 1) for i in range(5000, 9000)]
    marks = spark.createDataFrame(labels + bare + [(i, 0) for i, y in labels if y], "doc_id bigint, toxic int")
    docs = documents(rows + rows[:50] * 3 + [(i, None) for i in range(5000, 6000)])
    model = toxicity.train(docs, marks, settings)
    assert model == toxicity.train(documents(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"), settings)


# byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(bpe.VOCABULARY)


def odd_texts():
    rng = random.Random(8)
    alphabet = "aaeinot  .,'\n\tÉß日本語🙂09-_"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 80))) for _ in range(150)]
    return [*texts, "", " ", "\n\n  x", "don't we'll", "a" * 3000, "<|endoftext|>", "é", prose(rng, 3000)]


def test_bpe_is_bpe_by_definition(ranks):
    rank = {t: i for i, t in enumerate(ranks)}
    encoder = bpe.Encoder(ranks)
    texts = odd_texts()
    values, counts = encoder.encode(texts)
    ends = np.cumsum(counts)
    split = encoder.split
    for text, a, b in zip(texts, ends - counts, ends):
        want = [rank[t] for piece in split(text) for t in bpe.merge(piece.encode(), rank)]
        assert values[a:b].tolist() == want, text[:50]


def test_bpe_agrees_with_tiktoken(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    texts = odd_texts()
    values, counts = bpe.Encoder(ranks).encode(texts)
    assert values.tolist() == [x for t in texts for x in other.encode_ordinary(t)]


def test_bpe_long_pieces(ranks):
    """Unbroken pieces of a million bytes take time in proportion, and give what tiktoken gives."""
    tiktoken = pytest.importorskip("tiktoken")
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdeinorst") for _ in range(n)) for n in (1023, 1024, 5000, 60_000)] + ["ab" * 30_000, "日本" * 3000, "!?" * 4000]
    values, counts = bpe.Encoder(ranks).encode(texts)
    assert values.tolist() == [x for t in texts for x in other.encode_ordinary(t)]
    vast = "".join(rng.choice("abcdeinorst") for _ in range(1_000_000))
    began = time.perf_counter()
    values, _ = bpe.Encoder(ranks).encode([vast])
    assert "".join(bpe.decode_stream(values.tolist(), ranks)) == vast and time.perf_counter() - began < 60


def test_bpe_tables_may_be_emptied(ranks, monkeypatch):
    texts = odd_texts()
    want = bpe.Encoder(ranks).encode(texts)[0].tolist()
    monkeypatch.setattr(bpe, "MAX_TRANSITIONS", 50)
    monkeypatch.setattr(bpe, "MAX_PIECES", 20)
    encoder = bpe.Encoder(ranks)
    assert [x for t in texts for x in encoder.encode([t])[0].tolist()] == want


def test_bpe_round_trip(documents):
    rows = list(enumerate(odd_texts())) + [(900, None), (None, "no id"), (3, "again"), (3, "again")]
    encoded = bpe.encode(documents(rows))
    assert encoded.columns == ["doc_id", "tokens", "n_tokens", "round_trip"]
    got = encoded.collect()
    assert all(r.round_trip and len(r.tokens) == r.n_tokens for r in got if r.tokens is not None)
    assert [tuple(r) for r in got if r.tokens is None] == [(900, None, None, None)]
    back = bpe.decode(encoded).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(rows, key=str)
    assert bpe.encode(documents([])).count() == 0


def test_utf8_stream():
    rng = random.Random(6)
    whole = "aé日🙂́z".encode() + b"\xff\xe6\x97" + "本".encode() + b"\xf0\x9f"
    for _ in range(200):
        stream, out, at = bpe.Utf8Stream(), "", 0
        while at < len(whole):
            step = rng.randrange(1, 4)
            out += stream.feed(whole[at : at + step])
            at += step
        assert out + stream.end() == whole.decode("utf-8", "replace")
    stream = bpe.Utf8Stream()
    assert stream.feed("日".encode()[:2]) == "" and stream.feed("日".encode()[2:]) == "日"


# licence scan

MIT = """Copyright (c) 2019 Somebody

 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software. The above copyright notice and this permission notice shall be
 * included in all copies. THE SOFTWARE IS PROVIDED "AS IS". IN NO EVENT SHALL WE PAY."""
BSD = """Redistribution and use in source and binary forms are permitted. 1. Redistributions of source code must retain the notice.
2. Redistributions in binary form must reproduce the notice. 3. Names may not be used, nor may be used to endorse or promote products."""


@pytest.mark.parametrize(
    ("text", "licenses"),
    [
        ("Some words.\nReleased under the MIT Licence.\nMore.", "MIT"),
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("under the terms of the GNU General Public License v2 or (at your option) any later version.", "GPL-2.0-or-later"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"),
        ("# SPDX-License-Identifier: BSD-3-Clause\nimport os", "BSD-3-Clause"),
        (MIT, "MIT"),
        (BSD, "BSD-3-Clause"),
        (BSD.rpartition(" 3.")[0].rpartition("\n")[0] + "\n2. Redistributions in binary form must reproduce it.", "BSD-2-Clause"),
        ("Released under the MIT License. Licensed under CC BY-SA 4.0.", "CC-BY-SA;MIT"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy.", "unknown"),
        ("x " * 200_000 + ". Released under the MIT License. " + "y " * 1000, "MIT"),
        ("A driving license is needed.", None),
        ("", None),
        (None, None),
    ],
)
def test_licenses(documents, text, licenses):
    got = license_scan.scan(documents([(1, text)])).collect()
    assert [r.licenses for r in got] == ([] if licenses is None else [licenses])


def test_license_rows(documents):
    line = "Released under the MIT License."
    got = license_scan.scan(documents([(1, line), (1, line), (None, line)]))
    assert got.columns == ["doc_id", "licenses", "sentence_ids", "n_sentences"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, "MIT", "Mit", 1)] * 2 + [(None, "MIT", "Mit", 1)], key=str)
    assert license_scan.scan(documents([])).count() == 0


def test_license_tables():
    named = {name for name, _ in license_scan.SENTENCES}
    assert len(named) == len(license_scan.SENTENCES)
    assert all(set(rule) <= named for _, rule in license_scan.RULES)


#: A text for every expression (for each form of it that has words of its own), with the identifier.
EACH = [
    ("SpdxMit", "SPDX-License-Identifier: MIT"),
    ("SpdxApache2", "SPDX-License-Identifier: Apache-2.0"),
    ("SpdxGpl3", "SPDX-License-Identifier: GPL-3.0-only"),
    ("SpdxGpl2", "SPDX-License-Identifier: GPL-2.0-only"),
    ("SpdxLgpl", "SPDX-License-Identifier: LGPL-2.1"),
    ("SpdxBsd3", "SPDX-License-Identifier: BSD-3-Clause"),
    ("SpdxBsd2", "SPDX-License-Identifier: BSD-2-Clause"),
    ("SpdxMpl2", "SPDX-License-Identifier: MPL-2.0"),
    ("SpdxOther", "SPDX-License-Identifier: Beerware"),
    ("CcZero", "CC0"),
    ("CcZero", "Creative Commons Zero"),
    ("CcZero", "We waive all copyright."),
    ("CcByNcSa", "CC BY-NC-SA 4.0"),
    ("CcByNcSa", "Attribution-NonCommercial-ShareAlike"),
    ("CcByNcNd", "CC-BY-NC-ND"),
    ("CcByNcNd", "Attribution-NonCommercial-NoDerivs"),
    ("CcByNc", "CC BY-NC"),
    ("CcByNc", "Attribution-NonCommercial"),
    ("CcBySa", "CC\n * BY-SA"),
    ("CcBySa", "Attribution-ShareAlike"),
    ("CcByNd", "CC BY-ND"),
    ("CcByNd", "Attribution-NoDerivs"),
    ("CcBy", "CC BY 4.0"),
    ("CcBy", "Creative Commons Attribution"),
    ("ApacheObtain", "You may obtain a copy of the License at"),
    ("ApacheUnless", "Unless required by applicable law or agreed to in writing"),
    ("ApacheGoverning", "See the License for the specific language governing permissions"),
    ("ApacheMayNotUse", "You may not use this file except in compliance with the License."),
    ("Apache2", "Apache License, Version 2.0"),
    ("LgplVersion", "Lesser General Public License"),
    ("LgplVersion", "LGPL"),
    ("AgplVersion", "Affero General Public Licence"),
    ("AgplVersion", "AGPL"),
    ("GplWarranty", "without even the implied warranty of MERCHANTABILITY"),
    ("GplReceived", "You should have received a copy of the GNU General Public License"),
    ("Gpl3OrLater", "GPL v3 or later"),
    ("Gpl2OrLater", "GPL v2 or later"),
    ("Gpl3", "Released under GPL v3."),
    ("Gpl2", "Released under G(P)L v2."),
    ("GplAny", "GNU GPL"),
    ("MitGrant", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MitNotice", "this notice and this permission notice shall be included in all copies"),
    ("IscGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose"),
    ("AsIs", "Provided as-is."),
    ("NoLiability", "In no event shall we pay."),
    ("NoLiability", "In no event will we pay."),
    ("BsdConditions", "Redistribution and use in source and binary forms"),
    ("BsdSource", "Redistributions of source code must retain it."),
    ("BsdBinary", "Redistributions in binary form must reproduce it."),
    ("BsdEndorse", "may be used to endorse or promote products"),
    ("BsdAdvertise", "All advertising materials mentioning features"),
    ("Mit", "MIT-licensed"),
    ("IscName", "ISC License"),
    ("Bsd3Name", "3-clause BSD"),
    ("Bsd2Name", "simplified BSD"),
    ("BsdName", "BSD-style licence"),
    ("Mpl2", "MPL-2.0"),
    ("Mpl2", "Mozilla Public License 2.0"),
    ("Epl", "Eclipse Public License"),
    ("Unlicense", "free and unencumbered software released into the public domain"),
    ("Unlicense", "The Unlicense"),
    ("PublicDomain", "in the public domain"),
    ("Wtfpl", "WTFPL"),
    ("Boost", "Boost Software License"),
    ("Zlib", "zlib License"),
    ("Zlib", "Altered source versions must be plainly marked."),
    ("AllRights", "All rights reserved."),
    ("CopyrightLine", "Copyright 2020 Somebody"),
    ("SeeFile", "See the file COPYING"),
]


def test_license_each_expression(documents):
    assert {name for name, _ in EACH} == {name for name, _ in license_scan.SENTENCES}
    got = {r.doc_id: r.sentence_ids for r in license_scan.scan(documents([(i, text) for i, (_, text) in enumerate(EACH)])).collect()}
    assert got == {i: name for i, (name, _) in enumerate(EACH)}


APACHE = """# Copyright 2020 Somebody
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
BSD3 = """Copyright (c) 2020, Somebody

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
  * Redistributions of source code must retain the above copyright
    notice, this list of conditions and the following disclaimer.
  * Redistributions in binary form must reproduce the above copyright
    notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution.
  * Neither the name of the copyright holder nor the names of its
    contributors may be used to endorse or promote products derived from
    this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER BE LIABLE FOR ANY DAMAGES.
"""
MIT_FULL = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT
SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version {v} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""


@pytest.mark.parametrize(
    ("text", "licenses", "ids"),
    [
        (APACHE, "Apache-2.0", "CopyrightLine,Apache2,ApacheMayNotUse,ApacheObtain,ApacheUnless,ApacheGoverning"),
        (BSD3, "BSD-3-Clause", "CopyrightLine,BsdConditions,BsdSource,BsdBinary,BsdEndorse,AsIs,NoLiability"),
        (MIT_FULL, "MIT", "Mit,CopyrightLine,MitGrant,MitNotice,AsIs,NoLiability"),
        (GPL.format(v=3), "GPL-3.0-or-later", "Gpl3OrLater,GplWarranty,GplAny,GplReceived"),
        (GPL.format(v=2), "GPL-2.0-or-later", "Gpl2OrLater,GplWarranty,GplAny,GplReceived"),
        ("Under the MIT License or the Apache License 2.0.", "Apache-2.0;MIT", "Mit,Apache2"),
        ("Under the GPL or LGPL version 3.", "GPL-3.0;LGPL", "Gpl3,LgplVersion"),
        ("Creative Commons Attribution-ShareAlike", "CC-BY-SA", "CcBySa"),
        ("Copyright: MIT License 2020", "MIT", "CopyrightLine,Mit"),
    ],
)
def test_license_headers(documents, text, licenses, ids):
    (got,) = license_scan.scan(documents([(1, text)])).collect()
    assert (got.licenses, got.sentence_ids) == (licenses, ids)


# benchmark decontamination


def norm(text):
    return re.findall("(?:[a-z0-9_]|[^\x00-\x7f\xa0-\xbf\u2000-\u206f\u3000-\u303f\uff01-\uff0f\uff1a-\uff20])+", (text or "").lower())


def brute_leaks(rows, items, n=13):
    out = {}
    for item, text in items:
        words = norm(text)
        size = min(n, len(words))
        for k in range(max(0, len(words) - size + 1) if words else 0):
            passage = tuple(words[k : k + size])
            for doc, body in rows:
                have = norm(body)
                if any(tuple(have[j : j + size]) == passage for j in range(len(have) - size + 1)):
                    out.setdefault((doc, item), set()).add(passage)
    return sorted(((d, i, len(p)) for (d, i), p in out.items()), key=str)


def leaks_corpus():
    rng = random.Random(11)
    items = [(k, prose(rng, rng.choice([3, 12, 13, 14, 40]))) for k in range(12)] + [(100, "short"), (101, None), (102, "..."), (103, "Ünï-cödé wörds"), (None, prose(rng, 15))]
    items.append((104, items[3][1]))
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            text = rng.choice(items)[1] or ""
            words = text.split()
            cut = words[rng.randrange(2) : len(words) - rng.randrange(2)]
            parts += [rng.choice([" ", ", ", "\n", "\u00a0", "\u201d \u2014 ", "\u3000", "\uff0c"]).join(w.upper() if rng.random() < 0.2 else w for w in cut), prose(rng, 2)]
        rows.append((i, rng.choice([" ", ".\n"]).join(parts)))
    return rows + [(200, None), (201, ""), (202, "unshort shortly"), (203, "a SHORT one"), (None, items[0][1]), (5, "x"), (204, "w " * 60_000 + items[4][1])], items


def test_leaks(spark, documents):
    rows, items = leaks_corpus()
    benchmark = spark.createDataFrame([(i, t, "more") for i, t in items], "item_id bigint, text string, doc_id string")
    got = decontaminate.contaminated(documents(rows), benchmark)
    assert got.columns == ["doc_id", "item_id", "n_passages"]
    want = brute_leaks(rows, items)
    assert len(want) > 30 and sorted((tuple(r) for r in got.collect()), key=str) == want
    kept = decontaminate.drop_contaminated(documents(rows), benchmark)
    assert kept.columns == ["doc_id", "text", "n", "digest"]
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {d for d, _, _ in want}


def test_leaks_in_parts(spark, documents, monkeypatch):
    rows, items = leaks_corpus()
    monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_BYTES", 500)
    got = decontaminate.contaminated(documents(rows), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_leaks(rows, items)


def test_leaks_with_short_and_long_patterns():
    rng = random.Random(3)
    patterns = [b" a ", b" short ", b" of " + b"x" * 40 + b" ", *(" {} ".format(prose(rng, 13)).encode() for _ in range(20))]
    tools = decontaminate.searchers(patterns)
    assert [t.m for t in tools] == [3, min(len(p) for p in patterns if len(p) >= decontaminate.SHORT)]
    text = b" a " + b" ".join(p.strip() for p in patterns) + b" a short a "
    found = {(p, t.patterns[i]) for t in tools for p, i in zip(*map(np.ndarray.tolist, t.find(np.frombuffer(text, np.uint8), np.array([0, len(text)]))))}
    assert found == {(k, p) for p in patterns for k in range(len(text)) if text.startswith(p, k)}


def test_leaks_empty(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(documents([(1, "a b")]), none).count() == 0
    assert decontaminate.contaminated(documents([]), spark.createDataFrame([(1, "a")], "item_id bigint, text string")).count() == 0
    assert decontaminate.drop_contaminated(documents([(1, "a b"), (2, None)]), none).count() == 2


# chats


def test_chats(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", None, "", "日"]), rng.choice([None, "", "hi", "é" * 50, "<|im_end|>\n"])) for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, None, "system", "first"), (None, 1, "user", "lost"), (99, 1, "user", "x" * 3_000_000)]
    rng.shuffle(rows)
    want = defaultdict(list)

    def low(x):
        return (x is not None, x if x is not None else "")

    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], (r[1] is not None, r[1] or 0), (r[2] is not None, (r[2] or "").encode()), (r[3] is not None, (r[3] or "").encode()))):
        want[c].append(f"<|im_start|>{r if r is not None else 'unknown'}\n{x or ''}<|im_end|>\n")
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id bigint, turn bigint, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    assert set(got) == set(want)
    for c, parts in want.items():
        assert got[c].text == "".join(parts) and got[c].n_turns == len(parts) and got[c].n_bytes == len("".join(parts).encode())
    assert chat_format.format_chats(df.limit(0)).count() == 0


# HTML


def brute_extract(pages, settings):
    """The style tree of each host in one dictionary, importance by recursion."""
    seen = defaultdict(lambda: defaultdict(int))
    info, below, host_of = {}, defaultdict(set), {}
    for page, url, html in pages:
        found = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\s:]*)", url or "")
        host_of[page] = found[1].lower() if found else ""
        if html is None:
            continue
        for _, key, parent, style, _, kids in html_style_tree.walk(host_of[page], html_style_tree.parse(html)):
            seen[key][style] += 1
            info[style] = kids
            below[parent].add(key)

    def importance(key):
        styles = seen[key]
        m = sum(styles.values())
        if m == 1:
            return 1.0
        if any(info[s] == -1 for s in styles):
            return 1 - sum(math.log(n) / math.log(m) for n in styles.values()) / len(styles)
        entropy = sum(-n / m * math.log(n / m) / math.log(m) for n in styles.values())
        inside = sum(n / m * (sum(importance(k) for k in below[s]) / info[s] if info[s] else 0.0) for s, n in styles.items())
        fade = settings.damping ** len(styles)
        return (1 - fade) * entropy + fade * inside

    noisy = {k for k in seen if sum(seen[k].values()) > 1 and importance(k) <= settings.threshold}
    return sorted((p, *((None, None) if h is None else html_style_tree.clean(host_of[p], h, noisy))) for p, _, h in pages)


def site():
    rng = random.Random(7)
    pages = []
    for i in range(24):
        host = f"site{i % 3}.example"
        menu = "".join(f"<li><a href='{k}'>Item {k}</a>" for k in range(4 + i % 3))
        body = "".join(f"<p>{prose(rng, rng.randrange(3, 20))}{'<br><b>x' if rng.random() < 0.3 else ''}</p>" for _ in range(rng.randrange(1, 4)))
        pages.append((i, f"http://{host}/p/{i}", f"<!DOCTYPE html><html><head><title>{prose(rng, 2)}</title><script>if (a < b) x('</p>')</script></head><body><nav><ul>{menu}</ul></nav><div class='main'><h1>{prose(rng, 3)}</h1>{body}</div><footer>All rights reserved &copy; 2020 <img src=logo.png></footer></body></html>"))
    return pages + [(100, None, "<p>no url</p>"), (101, "http://site0.example/", None), (102, "not a url", ""), (103, "//site1.example", "<div><p>open <b>bold <i>never closed"), (104, "http://deep.example", "<div>" * 5000 + "deep" + "</div>" * 10), (4, pages[4][1], pages[4][2])]


@pytest.mark.parametrize(("limit", "tree"), [(32_000_000, 2_000_000), (0, 40), (0, 0)])
def test_html(spark, limit, tree):
    """The tree by hosts, partly by levels, and wholly by levels."""
    settings = html_style_tree.Settings(max_broadcast_bytes=limit, max_tree=tree)
    pages = site()
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, host string")
    got = html_style_tree.extract(df, settings)
    assert got.columns == ["page_id", "text", "n_removed"]
    want = brute_extract(pages, settings)
    assert sorted(((r.page_id, r.text, r.n_removed) for r in got.collect()), key=str) == sorted(want, key=str)
    text = {p: t for p, t, _ in want}
    assert text[101] is None and text[102] == "" and "deep" in text[104] and "no url" in text[100]
    assert all("All rights reserved" not in text[i] and "Item 2" not in text[i] for i in range(24))


@pytest.mark.parametrize("limit", [32_000_000, 0])
def test_html_copies(spark, limit):
    """Copies of a page don't make its main text a shared part."""
    pages = site()[:24]
    odd = "<html><body><div class='main'>" + "".join(f"<p>{w}" for w in WORDS[:37]) + "</div></body></html>"
    once = pages + [(30, "http://lone.example/1", "<p>lone text"), (31, "http://site0.example/odd", odd)]
    copies = [(32, "http://lone.example/2", once[24][2]), (33, "http://site0.example/again", odd), (34, "http://site0.example/third", odd)]
    settings = html_style_tree.Settings(max_broadcast_bytes=limit)

    def texts(rows):
        return {r.page_id: (r.text, r.n_removed) for r in html_style_tree.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"), settings).collect()}

    alone, got = texts(once), texts(once + copies)
    assert {p: got[p] for p in alone} == alone
    assert got[32] == got[30] == ("lone text", 0) and got[33] == got[34] == got[31]
    assert got[31][0].split() == WORDS[:37]


def test_html_depth(spark):
    """Nesting of any depth keeps its shape: an end tag closes its own element."""
    deep = html_style_tree.parse("<div><p>" + "<b>" * 3000 + "x" + "</b>" * 3000 + "</p><i>y</i></div><u>z</u>")
    assert [c.name for c in deep.children] == ["div", "u"] and [c.name for c in deep.children[0].children] == ["p", "i"]
    assert html_style_tree.parse("<div></span></b></i><p>x").children[0].children[0].name == "p"
    long = "<div>" + "<p>word " * 200_000 + "</div>"
    pages = spark.createDataFrame([(1, "http://a.b/", long, 0), (2, "http://a.b/2", "<i>" * 20_000 + "end", 0)], "page_id bigint, url string, html string, style int")
    got = {r.page_id: (r.text, r.n_removed) for r in html_style_tree.extract(pages).collect()}
    assert got == {1: ("\n".join(["word"] * 200_000), 0), 2: ("end", 0)}


def test_html_keys():
    keys = html_style_tree.Keys(np.array([5, -3, 9, -(1 << 63), (1 << 63) - 1]))
    assert all(k in keys for k in (5, -3, 9, -(1 << 63), (1 << 63) - 1)) and not any(k in keys for k in (0, 4, 6, 10))
    assert 1 not in html_style_tree.Keys(np.zeros(0, np.int64))


def test_html_empty(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_style_tree.extract(df).count() == 0


