"""Classifiers, page extraction, licences, mixing, media: against plain versions, held-out accuracy or exact round trips."""

import html
import os
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest

from seriesframe.llm import htmlmain, licenses, mixing, ogg, quality, toxicity, training
from seriesframe.llm import textcols as tc

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
ODD = [None, "", " \n\t", "word", "a b", "é" * 3, "x " * 30000, "same text here", "same text here"]


def docs_of(spark, texts, extra=True):
    rows = [(k, t, "s", 1.5, 7) for k, t in enumerate(texts)] + [(None, "no id", None, 0.0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double, predicted int").repartition(3)


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_words_and_hashes():
    texts = ["", "a", " a  b\n", "é ü", "ab", "a b", "\x0b\x0c"]
    data, offsets = tc.raw(tc.column(pa.table({"t": texts}), "t"))
    starts, ends, first = tc.words(data, offsets)
    for k, t in enumerate(texts):
        own = [data[a:b].tobytes().decode() for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], strict=True)]
        assert own == re.findall(r"[^\x20\x09-\x0D]+", t)
    h = tc.span_hashes(data, starts, ends)
    words = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert len(set(h.tolist())) == len(set(words)) and all(h[i] == h[j] for i, x in enumerate(words) for j, y in enumerate(words) if x == y)


def test_work_areas_are_bounded():
    """A worker's memory for a batch of long and short texts, of which two work beside a JVM in 3000 MB; freed memory goes back at a task's end."""
    import tracemalloc

    rng = random.Random(0)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.choice([3, 400, 900]))) for _ in range(1700)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string()), pa.array([k % 2 for k in range(len(texts))], pa.int32())], ["_t", "_y"])
    assert batch.nbytes > 3 << 20
    tc._POWERS.clear()
    tracemalloc.start()
    try:
        whole = list(quality._moments([batch]))
        assert tracemalloc.get_traced_memory()[1] < 64e6
    finally:
        tracemalloc.stop()
    halves = list(tc.frugal(quality._moments)([batch.slice(0, 700), batch.slice(700)]))
    assert [b.to_pydict() for b in halves] == [b.to_pydict() for b in whole]


@needs_tables
def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(training.labelled(docs, labels, label="quality", per_class=5000, skip=(4, 2)))
    scored = {r.doc_id: r for r in quality.score(docs, model, keep=["doc_id"]).collect()}
    assert len(scored) == docs.count()
    held = [(scored[r.doc_id].score, r.quality, scored[r.doc_id].predicted) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    s, y, p = map(np.array, zip(*held, strict=True))
    assert auc(s, y) > 0.97 and p[y == 1].mean() > 0.95


def test_quality_scores_by_hand(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (200, 3)), rng.normal(1, 2, (100, 3))])
    y = np.array([0] * 200 + [1] * 100)
    count = np.array([200.0, 100.0])
    first = np.array([x[y == c].sum(0) for c in (0, 1)])
    second = np.array([x[y == c].T @ x[y == c] for c in (0, 1)])
    m = quality.from_moments(count, first, second, 0.2, 0.1, 0.01)
    covs = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = (200 * covs[0] + 100 * covs[1]) / 300
    want = []
    for c in (0, 1):
        s = 0.8 * covs[c] + 0.2 * pooled
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + 0.01 * np.eye(3)
        d = x - x[y == c].mean(0)
        want.append(np.log(count[c] / 300) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert np.allclose(m.log_odds(x), want[1] - want[0])


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_classifier_edges(spark, kind):
    docs = docs_of(spark, ODD)
    rows = spark.createDataFrame([(k, ("bad scum words here " if k % 2 else "plain text of words ") * 5 + str(k), k % 2) for k in range(30)], "doc_id long, text string, label int")
    model = kind.fit(rows)
    out = kind.score(docs, model).collect()
    assert len(out) == len(ODD) + 1 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
    assert len({r.score for r in out if r.text == "same text here"}) == 1
    none = kind.fit(rows.where("label = 1"))
    assert all(r.score == 0.5 for r in kind.score(docs, none).collect())
    assert kind.score(docs.limit(0), model).count() == 0


def slow_bins(text):
    """Hashed n-grams of a text, one by one."""
    out = set()
    low = text.lower()
    for n in toxicity.SIZES:
        for i in range(len(low) - n + 1):
            h = n
            for c in low[i : i + n]:
                h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
                h ^= h >> 15
            out.add((h * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - toxicity.BITS)
    return out


def test_toxicity_by_brute_force(spark):
    """Counts, ratios, chi-squared and the fitted weights from plain loops over n-grams; the fit's gradient vanishes."""
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "Gamma", "dört", "fünf", "sei", "hept", "octo"]
    texts = [(" ".join(rng.choice(words, rng.integers(3, 9))) + (" vile scum" if k % 3 == 0 and rng.random() < 0.8 else ""), int(k % 3 == 0)) for k in range(90)] + [("", 0), ("ab", 1)]
    model = toxicity.fit(spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(texts)], "doc_id long, text string, label int"), least=2, significance=3.0, penalty=0.01, steps=200)
    sets, y = [slow_bins(t) for t, _ in texts], np.array([y for _, y in texts])
    n = np.array([(y == 0).sum(), (y == 1).sum()], float)
    weights, want = np.zeros(1 << toxicity.BITS), {}
    for b in set().union(*sets):
        one, zero = (sum(b in s for s, label in zip(sets, y, strict=True) if label == c) for c in (1, 0))
        table = np.array([[zero, one], [n[0] - zero, n[1] - one]])
        expected = table.sum(0) * table.sum(1)[:, None] / table.sum()
        chi = ((table - expected) ** 2 / np.maximum(expected, 1e-12)).sum() if table.sum(1).all() else 0
        if zero + one >= 2 and chi > 3:
            want[b] = np.log((one + 1) / (n[1] + 2)) - np.log((zero + 1) / (n[0] + 2))
    assert set(np.flatnonzero(model.weights)) <= set(want) and 10 < len(want)
    bins = sorted(want)
    r = np.array([want[b] for b in bins])
    x = np.array([[b in s for b in bins] for s in sets]) * r
    w = model.weights[bins].astype(float) / r
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))
    g = np.where(y == 1, 0.5 / n[1], 0.5 / n[0]) * (p - y)
    assert np.abs(x.T @ g + 0.01 * w).max() < 1e-3 and abs(g.sum()) < 1e-3 and np.abs(w).max() > 0.1
    weights[bins] = w * r
    scored = toxicity.score(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string"), model).collect()
    for row in scored:
        z = sum(weights[b] for b in sets[row.doc_id]) + model.intercept
        assert abs(row.score - 1 / (1 + np.exp(-z))) < 1e-4 and row.predicted == (row.score >= 0.5)


def test_gradient_sums():
    rng = np.random.default_rng(2)
    dense = rng.random((12, 7)) < 0.4
    rows, cols = np.nonzero(dense)
    y, weight, scaled, b = rng.integers(0, 2, 12).astype(float), rng.random(12), rng.normal(size=7), 0.3
    loss = lambda s, c: sum(weight[i] * (np.log1p(np.exp(z := dense[i] @ s + c)) - y[i] * z) for i in range(12))
    got = toxicity.sums(rows, cols, y, scaled, b, weight)
    step = 1e-6
    slopes = [(loss(scaled, b + step) - loss(scaled, b - step)) / 2 / step] + [(loss(scaled + e, b) - loss(scaled - e, b)) / 2 / step for e in np.eye(7) * step]
    assert abs(got[0] - loss(scaled, b)) < 1e-9 and np.allclose(got[1:], slopes, atol=1e-6)


def test_long_texts_have_all_their_ngrams(monkeypatch):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdé f"), 500))
    array = pa.array([text], pa.large_string())
    whole = toxicity.distinct(array)
    monkeypatch.setattr(toxicity, "SLICE", 30)
    row, bins = toxicity.distinct(array)
    assert set(bins) == set(whole[1]) == slow_bins(text) and not row.any()


def test_labels_are_bounded(spark):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = docs.union(docs)  # repeated rows give one training row
    rows = training.labelled(docs, labels, label="toxic", per_class=10, skip=(5, 0)).collect()
    assert len(rows) == 20 and sum(r.label for r in rows) == 10 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)


@needs_tables
def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    model = toxicity.fit(training.labelled(docs, labels, label="toxic", per_class=5000, skip=(5, 0)))
    scored = {r.doc_id: r for r in toxicity.score(docs, model, keep=["doc_id"]).collect()}
    held = [(scored[r.doc_id].score, r.toxic, scored[r.doc_id].predicted) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    s, y, p = map(np.array, zip(*held, strict=True))
    assert auc(s, y) > 0.95 and p[y == 1].mean() > 0.8 and p[y == 0].mean() < 0.05


def test_pages():
    model = htmlmain.default_model()
    made = htmlmain.labelled_pages(120, 99)
    right = sum(model.extract(page) == " ".join(html.unescape(x) for x in texts) for page, texts in made)
    assert right >= 0.85 * len(made)
    page = "<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One  <b>two</b>three\n<br>four.<p>Five&nbsp;six<script>no()</script> seven.</article><div class='comments'><p>I disagree.</p></div><footer>&copy; me</footer></body></html>"
    assert model.extract(page) == "A & B One twothree four. Five six seven."
    for odd in ("", " ", "<", "<p", "<!-- x", "<script>", "</p></p>", "<b>" * 500, "<div>" * 5000 + "x"):
        model.extract(odd)


@pytest.mark.parametrize("inner", ["<ul>{}</ul>", "<div>{}</div>", "<dl>{}</dl>", "<table>{}</table>"])
@pytest.mark.parametrize("n", [3, 100, 5000])
def test_open_elements_at_any_depth(inner, n):
    """Omitted end tags leave nothing open behind the end of the element around them, however many there are."""
    item = {"<ul>{}</ul>": "<li><p>a", "<div>{}</div>": "<b>a<br>", "<dl>{}</dl>": "<dt><p>a<dd><p>b", "<table>{}</table>": "<tr><td><p>a<td><p>b"}[inner]
    got = htmlmain.blocks("<article>" + inner.format(item * n) + "<p>end</article><footer>foot</footer>")
    within = {"<ul>{}</ul>": {"in:article", "in:ul", "in:li", "in:p"}, "<div>{}</div>": {"in:article", "in:div"}, "<dl>{}</dl>": {"in:article", "in:dl", "in:p"}, "<table>{}</table>": {"in:article", "in:table", "in:tr", "in:td", "in:p"}}[inner]
    ours = [{f for f in b.features if f.startswith("in:")} for b in got]
    assert [b.text for b in got[-2:]] == ["end", "foot"] and ours[-2:] == [{"in:article", "in:p"}, {"in:footer"}]
    assert len(got) == n * item.count(">a") + n * item.count(">b") + 2 and all(within <= x <= within | {"in:dt", "in:dd"} for x in ours[:-2])
    deep = htmlmain.blocks("<div>" * n + "<aside class=comments>x</aside>" + "</div>" * n + "<p>y")
    assert {"in:aside", "key:comments", "in:div"} <= set(deep[0].features) and "in:div" not in deep[1].features


def test_nested_items():
    """Starts close items of their own list or table only."""
    nested = htmlmain.blocks("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul><table><tr><td>f<table><tr><td>g</table>h<td>i</table><p>j<span>k<div>l")
    ours = [(b.text, sorted(f for f in b.features if f.startswith("in:"))) for b in nested]
    items, cells = ["in:li", "in:ul"], ["in:table", "in:td", "in:tr"]
    assert ours == [*((t, items) for t in "abcde"), *((t, cells) for t in "fghi"), ("jk", ["in:p"]), ("l", ["in:div"])]


def test_viterbi_against_all_labellings():
    rng = random.Random(0)
    for _ in range(20):
        n = rng.randint(1, 7)
        w = {f"f{k}": rng.uniform(-2, 2) for k in range(5)}
        m = htmlmain.Model(w, 0.3, (rng.uniform(-1, 1), rng.uniform(-1, 1)), tuple(tuple(rng.uniform(-2, 2) for _ in (0, 1)) for _ in (0, 1)))
        chain = [htmlmain.Block("x", tuple(rng.sample(sorted(w), 2))) for _ in range(n)]

        def total(y, chain=chain, m=m):
            return m.start[y[0]] + sum(m.move[a][b] for a, b in zip(y, y[1:], strict=False)) + sum((m.bias + sum(m.weights[f] for f in b.features)) * k for b, k in zip(chain, y, strict=True))

        best = max(([k >> i & 1 for i in range(n)] for k in range(2**n)), key=total)
        assert abs(total([int(x) for x in m.decode(chain)]) - total(best)) < 1e-9


def test_page_rows(spark):
    model = htmlmain.default_model(60, 1)
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<article><p>Hello there, reader.</p></article>", "x"), (3, "u", "<article><p>Hello there, reader.</p></article>", "x")], "page_id long, url string, html string, text string")
    out = sorted(htmlmain.extract(pages, model).collect(), key=lambda r: r.page_id)
    assert [r.text for r in out[:2]] == ["", ""] and out[2] == out[3] and out[2].n_chars == len(out[2].text)
    assert htmlmain.extract(pages.limit(0), model).count() == 0


def test_licenses(spark):
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License."
    texts = [*ODD, "Some words.\nReleased under the MIT License.\nMore.", "This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0. Released under the MIT license!", "released under the mit licence", "x\n" * 5 + "Licensed under  the Apache License, Version 2.0."]
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, texts)).collect() if r.doc_id is not None}
    n = len(ODD)
    assert all(got[k].licenses == [] and got[k].n_matches == 0 for k in range(n))
    assert got[n].licenses == ["MIT"] and got[n + 1].licenses == ["CC-BY-NC-4.0", "GPL-3.0-only", "MIT"] and got[n + 1].n_matches == 3
    assert got[n + 2].licenses == [] and got[n + 3].licenses == ["Apache-2.0"]
    assert licenses.scan(docs_of(spark, [apache]).limit(0)).count() == 0
    full = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    r = licenses.scan(spark.createDataFrame([(1, full)], "doc_id long, text string")).first()
    assert r.licenses == ["BSD-2-Clause"] and r.n_matches == 1 and len(r.sentence_ids) == 3


MIT_0 = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."""
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.'
GPL = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
GPL_REST = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
#: Licence, paragraphs as published, identifiers.
PUBLISHED = [
    ("GPL-3.0-or-later", [GPL.format(":", ",", 3), GPL_REST], ["gpl-redistribute", "gpl-no-warranty", "gpl-see"]),
    ("GPL-2.0-or-later", [GPL.format(";", ";", 2), GPL_REST], ["gpl2-redistribute", "gpl-no-warranty", "gpl-see"]),
    ("GPL-3.0-or-later", [GPL.format(":", ",", 3)], ["gpl-redistribute"]),
    ("GPL-2.0-or-later", [GPL.format(";", ";", 2)], ["gpl2-redistribute"]),
    ("MIT", ["Copyright (c) 2020 Somebody", MIT_0[:-1] + ", subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", AS_IS], ["mit-permission", "mit-notice-kept", "mit-as-is"]),
    ("MIT-0", ["MIT No Attribution", MIT_0, AS_IS], ["mit-permission", "mit-as-is"]),
    ("Apache-2.0", ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "    http://www.apache.org/licenses/LICENSE-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'], ["apache2-header", "apache2-copy", "apache2-as-is", "apache2-see"]),
    ("Apache-2.0", ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'], ["apache2-header"]),
    ("BSD-3-Clause", [*BSD, "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."], ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", BSD, ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-only", ["This work is licensed under the GNU General Public License, version 3."], ["gpl3-notice"]),
    ("GPL-3.0-only", ["Licensed under the GNU General Public License, version 3"], ["gpl3-short"]),
    ("LGPL-3.0-only", ["This work is licensed under the GNU Lesser General Public License, version 3."], ["lgpl3-notice"]),
    ("AGPL-3.0-only", ["This work is licensed under the GNU Affero General Public License, version 3."], ["agpl3-notice"]),
    ("CC-BY-NC-4.0", ["Licensed under CC BY-NC 4.0."], ["ccbync4-notice"]),
    ("CC-BY-4.0", ["Licensed under CC BY 4.0."], ["ccby4-notice"]),
    ("CC-BY-SA-4.0", ["Licensed under CC BY-SA 4.0."], ["ccbysa4-notice"]),
    ("CC0-1.0", ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."], ["cc0-notice"]),
    ("MIT", ["Released under the MIT License"], ["mit-notice"]),
    ("MIT", ["Licensed under the MIT license."], ["mit-short"]),
    ("Apache-2.0", ["Licensed under the Apache License, Version 2.0"], ["apache2-notice"]),
    ("ISC", ['Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.', "THE SOFTWARE IS PROVIDED BY SOMEBODY"], ["isc-permission"]),
    ("MPL-2.0", ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."], ["mpl2-notice"]),
    ("Unlicense", ["This is free and unencumbered software released into the public domain."], ["unlicense-notice"]),
]


def test_published_licenses(spark):
    """Every known sentence and rule in its published wording: one line a paragraph, wrapped, and in comments of several kinds."""
    assert {i for _, _, x in PUBLISHED for i in x} == {name for name, _ in licenses.SENTENCES}
    assert {(name, tuple(x)) for name, _, x in PUBLISHED} == set(licenses.RULES)

    def wrapped(paragraphs, width, first, mark, last):
        lines = [x for p in paragraphs for x in (*(textwrap.wrap(p, width, break_long_words=False) if width else [p]), "")]
        return first + "".join(f"{mark}{x}\n" for x in lines) + last

    ways = [(0, "", "", ""), (72, "", "", ""), (40, "", "", ""), (76, "", "// ", ""), (76, "/*\n", " * ", " */\n"), (60, "", "# ", ""), (70, "<!--\n", "", "-->\n"), (50, "", "-- ", ""), (65, "", ";; ", ""), (65, "", "dnl ", ""), (60, "", "  > ", "")]
    cases = [(name, x, wrapped(p, *way)) for name, p, x in PUBLISHED for way in ways]
    cases += [(name, x, f"Some words here\n{t}\nint main() {{}}\n".replace("\n", "\r\n")) for name, x, t in cases]
    docs = spark.createDataFrame([(k, t) for k, (_, _, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for k, (name, x, t) in enumerate(cases):
        assert (got[k].licenses, got[k].sentence_ids, got[k].n_matches) == ([name], x, 1), t
    other = ["It was released under the MIT License.", "Released under the MIT\nLicense of old.", "Licensed under CC BY\n\nor so 4.0.", "-" * 100000 + " license " + "(*;" * 100000]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(other)], "doc_id long, text string")
    assert all(r.licenses == [] and r.sentence_ids == [] for r in licenses.scan(docs).collect())


def slow_schedule(weights):
    """Earliest deadline first, slot by slot."""
    used = [(s, a) for s, a in weights.items() if a > 0]
    d = sum(a for _, a in used)
    sent, out = [0] * len(used), []
    for t in range(d):
        due = [(-(-(sent[k] + 1) * d // a), k) for k, (_, a) in enumerate(used) if sent[k] * d // a <= t]
        k = min(due)[1]
        sent[k] += 1
        out.append(used[k][0])
    return out


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 2}, {"a": 1}, {None: 2, "x": 7, "y": 1, "z": 0}, {f"s{k}": 1 + k % 4 for k in range(9)}])
def test_schedule(spark, weights):
    rows = sorted(mixing.schedule(spark, weights).collect(), key=lambda r: r.slot)
    assert [r.source for r in rows] == slow_schedule(weights)
    d = sum(weights.values())
    sent = dict.fromkeys(weights, 0)
    for t, r in enumerate(rows, 1):
        sent[r.source] += 1
        assert r.release <= r.slot < r.deadline
        assert all(abs(sent[s] * d - a * t) < d for s, a in weights.items() if a)


def test_mix(spark):
    rows = [(k, f"t{k}", None if k % 10 == 9 else "big" if k % 10 < 6 else "small", "clash") for k in range(200)] + [(None, None, "big", "clash"), (5, "t5", "big", "clash"), (5, "t5", "big", "clash"), (700, "x", "other", "clash")]
    docs = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], "doc_id long, text string, source string, mix_slot string, _h int, _MIX_s int, _slot int").repartition(3)
    weights = {"big": 2, "small": 1, None: 1}
    out = mixing.mix(docs, weights, block_docs=4, rows_in_bucket=5)
    assert set(out.columns) == {"doc_id", "text", "source", "_h", "_MIX_s", "_slot", *mixing.OUT}
    got = out.collect()
    assert {(r["_h"], r["_MIX_s"], r["_slot"]) for r in got} == {(7, 8, 9)}
    assert len(got) == len(rows) and [r.mix_slot for r in got if r.source == "other"] == [None]
    placed = sorted((r for r in got if r.mix_position is not None), key=lambda r: r.mix_position)
    assert len({r.mix_position for r in placed}) == len(placed)
    assert [(r.doc_id, r.mix_position) for r in sorted(mixing.mix(docs, weights, block_docs=4, rows_in_bucket=10**6).collect(), key=str)] == [(r.doc_id, r.mix_position) for r in sorted(got, key=str)]
    for r in placed:
        assert r.mix_release <= r.mix_slot < r.mix_deadline
    ordered = mixing.arrange(out).select("doc_id", "mix_position").collect()
    assert [r.mix_position for r in ordered if r.mix_position is not None] == [r.mix_position for r in placed]
    assert mixing.mix(docs.limit(0), weights).count() == 0
    w = mixing.tempered_weights(docs, denominator=100)
    assert sum(w.values()) == 100 and w["big"] > w["small"] > w["other"] >= 1


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
    return c


def test_ogg(spark):
    rng = random.Random(2)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == slow_crc(data)
    for n in (0, 1, 63, 64, 65, 255, 16000, 16064, 65025, 300000):
        payload = ogg.payload_of(rng.randbytes(n))
        assert len(payload) % 64 == 0 and len(payload) >= 64
        media = ogg.store(payload)
        back, streams = ogg.load(media)
        assert back == payload and len(streams) == 2
        sound = next(s for s in streams.values() if s.packets[0].startswith(b"PCM"))
        assert sound.times(ogg.RATE)[-1] == len(payload) / ogg.RATE and sound.times(ogg.RATE) == sorted(sound.times(ogg.RATE))
        for at in (0, 5, 22, 40, len(media) // 2, len(media) - 1):
            bad = bytearray(media)
            bad[at] ^= 1
            with pytest.raises(ogg.OggError):
                ogg.load(bytes(bad))
        with pytest.raises(ogg.OggError):
            ogg.load(media[:-1])
    packets = [(b"head", 0), (b"x" * 255, 1), (b"", 2), (b"y" * 70000, 3), (b"z" * 510, 4)]
    stream = next(iter(ogg.demultiplex(ogg.multiplex([ogg.paginate(7, packets)], [1])).values()))
    assert stream.packets == [p for p, _ in packets] and stream.continued == 1
    out = {r.doc_id: r for r in ogg.digests(docs_of(spark, ODD)).collect()}
    assert out[0].n_bytes == 0 and out[0].payload_bytes == 64 and out[0].media_sha256 == out[1].media_sha256 and out[7][1:] == out[8][1:]
    frames = ogg.media_column(docs_of(spark, ["abc", None]))
    assert sorted(bytes(r.payload).rstrip(b"\0") for r in ogg.read_media(frames).collect()) == [b"", b"abc", b"no id"]
    broken = spark.createDataFrame([(1, bytearray(b"nonsense")), (2, None)], "doc_id long, media binary")
    assert [r.payload for r in ogg.read_media(broken, on_error="null").collect()] == [None, None]
    assert ogg.digests(docs_of(spark, ODD).limit(0)).count() == 0


HAND_PAGES = [  # pages written by hand, and their main text
    ("""<!doctype html><html lang=en><head><title>Tea</title><meta charset=utf-8></head><body class="home page"><header class="site-header"><a href="/">The Daily Leaf</a><nav><ul><li><a href="/a">News</a></li><li><a href="/b">Shop</a></li></ul></nav></header>
<main><article class="post"><h1>How to brew green tea</h1><p>Green tea should not be brewed with boiling water. Let the kettle cool for a few minutes.</p><p>Use about two grams of leaves for each cup &amp; steep for two minutes.</p><ul><li>Warm the pot first.</li><li>Pour slowly.</li></ul></article></main>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/x">Ten best mugs</a></li></ul></aside><footer><p>Copyright 2020 The Daily Leaf. All rights reserved.</p></footer></body></html>""",
     "How to brew green tea Green tea should not be brewed with boiling water. Let the kettle cool for a few minutes. Use about two grams of leaves for each cup & steep for two minutes. Warm the pot first. Pour slowly."),
    ("""<html><body><div id="nav"><a href="/">Start</a> | <a href="/map">Map</a> | <a href="/contact">Contact</a></div><div id="content"><h2>The old bridge</h2><p>The bridge was built in 1871 by two brothers. It fell in the flood of 1910 and was built again a year later.</p>
<blockquote>Nobody had seen such water before.</blockquote><p>Today, it carries the road to the mill, and its terms of use and privacy are a matter of the town, which says so on a sign at home and abroad.</p></div><div id="footer">&copy; Town archive</div></body></html>""",
     "The old bridge The bridge was built in 1871 by two brothers. It fell in the flood of 1910 and was built again a year later. Nobody had seen such water before. Today, it carries the road to the mill, and its terms of use and privacy are a matter of the town, which says so on a sign at home and abroad."),
    ("""<body><div class="cookie-banner"><p>We use cookies to make this site better. <a href="/c">Learn more</a></p></div><nav class="menu"><a href="/">Home</a></nav><article><h1>A short note on maps</h1><p>Maps lie, as every <em>map maker</em> knows.</p><div class="ad">Buy two maps, get one free!</div><p>The size of a country on paper says little about its size on the ground.</p>
<section class="comments"><h3>Comments</h3><div class="comment"><p>Great note, thanks!</p></div><div class="comment"><p>I disagree with the second sentence.</p></div></section></article><form action="/s"><label>Search</label><input name=q><button>Go</button></form></body>""",
     "A short note on maps Maps lie, as every map maker knows. The size of a country on paper says little about its size on the ground."),
    ("""<html><head><title>x</title><script>var a = "<p>not text</p>";</script></head><body><header><h1>Garden blog</h1></header><div class="entry-content"><p>Slugs eat young lettuce at night, so water in the morning.</p><p>A ring of sand keeps them away for some time.</p><table><tr><th>Week</th><th>Slugs</th></tr><tr><td>First</td><td>Forty</td></tr></table></div>
<div class="related-posts"><h3>Related</h3><ul><li><a href="/1">Snails</a></li><li><a href="/2">Worms</a></li></ul></div><div class="newsletter"><p>Subscribe to our letter.</p></div><footer>All rights reserved</footer></body></html>""",
     "Slugs eat young lettuce at night, so water in the morning. A ring of sand keeps them away for some time. Week Slugs First Forty"),
]


@pytest.fixture(scope="module")
def page_model():
    from seriesframe.llm import htmlmain

    return htmlmain.default_model()


def test_pages_by_hand(page_model):
    """Measured as words found and words that should be: both shares over all pages."""
    import collections

    common = got = want = 0
    for page, text in HAND_PAGES:
        a, b = collections.Counter(page_model.extract(page).split()), collections.Counter(text.split())
        common, got, want = common + (a & b).total(), got + a.total(), want + b.total()
    assert common / got > 0.97 and common / want > 0.97


@pytest.mark.parametrize("inner,want", [
    ("<head><title>T</title><article><p>All of this page is text.</p></article>", "All of this page is text."),  # an unclosed head
    ("<head><meta charset=utf-8><p>All of this page is text, all of it.</p>", "All of this page is text, all of it."),
    ("<article><p>First it plays.</p><video-player src=x></video-player><button-row>Then it ends well.</button-row><title-bar></title-bar><p>Last words here.</p></article>", "First it plays. Then it ends well. Last words here."),
    ("<article><p>A picture <svg/> of it.</p><svg viewBox='0 0 1 1' /><p>More words follow here.</p></article>", "A picture of it. More words follow here."),
    ("<article><p>The equation <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds for <object>all</object> of <canvas>us</canvas>, <button>really</button>.</p></article>", "The equation x=1 holds for all of us, really."),
    ("<article><p>One <script data-x='a>b'>var x = 1 > 0;</script > two and three.</p><style>p > a {}</style\n><p>Four words are here.</p></article>", "One two and three. Four words are here."),
    ("<div>" * 5000 + "<article><p>Deep down there is a text.</p></article>" + "</div>" * 5000 + "<footer>All rights reserved</footer>", "Deep down there is a text."),
    ("<article><p>Text before it.</p>" + "<ul><li><p>item of a list that is long enough" * 300 + "</ul></article><footer><p>All rights reserved</p></footer>", "Text before it." + " item of a list that is long enough" * 300),
])
def test_markup_loses_nothing(page_model, inner, want):
    assert page_model.extract(inner) == want


def test_blocks_speak_as_a_whole(page_model):
    from seriesframe.llm import htmlmain

    late = htmlmain.blocks("<p>" + "word " * 60 + "we use cookies</p>")[0].features
    assert "tells:we use cookies" in late and "says:we use cookies" in htmlmain.blocks("<p>Here we use cookies</p>")[0].features
