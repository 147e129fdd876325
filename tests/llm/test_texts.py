"""Operators on single texts against plain versions."""

import hashlib
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import decontaminate as dc
from lexloom.llm import language_id, license_scan, mixing, pii, quality, secret_scan, toxicity
from tests.llm.helpers import awkward, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_overlap(docs, items, width=10):
    out = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(UP))
        hit, found = set(), set()
        for item, text in items:
            v = WORD.findall((text or "").translate(UP))
            k = min(width, len(v))
            windows = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if k else set()
            for j in range(len(w) - k + 1) if k else ():
                if tuple(w[j : j + k]) in windows:
                    hit.update(range(j, j + k))
                    found.add(str(item))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("shard", [2_000_000, 60])
def test_overlap_against_windows(spark, shard):
    rng = random.Random(6)
    word = lambda: rng.choice("ab cd ef gh ij é1 zz".split())
    items = [(i, " ".join(word() for _ in range(rng.choice((0, 1, 3, 9, 10, 11, 25))))) for i in range(14)] + [(2, "Extra, Text Here."), (3, None)]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(60)] + [(100 + i, "x y " + t + " q") for i, t in items if t]
    docs = list(dict(docs).items())
    bench = spark.createDataFrame(items, "item_id long, text string")
    for subset in (bench, bench.where("item_id in (5, 7, 9)"), bench.where("length(text) > 25")):
        want = plain_overlap(docs, [tuple(r) for r in subset.collect()])
        got = dc.benchmark_overlap(frame(spark, docs), subset, shard_words=shard).collect()
        assert {r["doc_id"]: tuple(r)[1:6] for r in got} == want


def test_overlap_awkward(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j"), (None, "x y"), (2, ""), (3, None)], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"]) for r in dc.benchmark_overlap(awkward(spark), bench).collect())
    assert ("1", 0, 0) in got and ("5", 11, 10) in got and ("None", 11, 10) in got and ("4", 60000, 0) in got
    assert dc.benchmark_overlap(awkward(spark), bench.limit(0)).where("contaminated").count() == 0
    assert dc.benchmark_overlap(awkward(spark).limit(0), bench).count() == 0


def test_remove_overlap(spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    other = " ".join(f"k{i}" for i in range(30))
    docs = frame(spark, [(1, f"{other}. One, two three four five six seven eight nine ten eleven! tail"), (2, item), (3, None), (4, other), (5, "")])
    got = {r["doc_id"]: r["text"] for r in dc.remove_overlap(docs, bench).collect()}
    assert got == {1: f"{other}.  ! tail", 3: None, 4: other, 5: ""}
    assert dc.benchmark_overlap(dc.remove_overlap(docs, bench), bench).where("contaminated").count() == 0


def test_secrets(spark):
    key = "AKIA" + "ABCD1234" * 2
    text = f'Password = "hunter22" api-key token:abc key {key} AKIASHORT {"ab12" * 6} {"ab12" * 5} Zq8xK2vLp0Wm3RtY9bNc é'
    r = secret_scan.secret_scan(frame(spark, [(1, text), (2, None)])).orderBy("doc_id").collect()
    a, h = text.index("Password"), text.index("ab12")
    base = f'assign:{a}:{text.index("22") + 2},access:{text.index(key)}:{text.index(key) + 20},hex:{h}:{h + 24}'
    assert (r[0]["n_assign"], r[0]["n_access"], r[0]["n_hex"]) == (1, 1, 1)
    assert r[0]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    at = text.index("Zq8x")
    assert f"token:{at}:{at + 20}" in r[0]["spans"].split(",")
    assert (r[1]["n_assign"], r[1]["spans"], r[1]["base_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())


def test_known_digests_and_words_are_no_secrets():
    encode = secret_scan.load_encoding(open(secret_scan.VOCABULARY, "rb").read()).encode_ordinary
    for text in ("d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "internationalization2024edition", "2024-01-01T00:00:00Z", "1234567890123456"):
        assert not secret_scan.token_spans(text, encode, 2.0), text
    assert secret_scan.token_spans("x aG7kQ2mZx9TpLw4RsV1b y", encode, 2.0)


def test_letter_only_secrets():
    encode = secret_scan.load_encoding(open(secret_scan.VOCABULARY, "rb").read()).encode_ordinary
    for run in ("xQzvKjWpRtBnLmGh", "qzxjvkwpqgzxhjvkbq"):
        assert secret_scan.token_spans(f"x {run} y", encode, 2.0) == [(2, 2 + len(run), "token")]
    for text in ("internationalization", "----------------------", "====================", "src/main/resources/static"):
        assert not secret_scan.token_spans(text, encode, 2.0), text


def plain_pii(text):
    """The four patterns as they are written, one after another."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_pii_base_against_patterns():
    rng = random.Random(8)
    parts = ["a", "@", ".", "b.c", "x@y.z", "_", "1", "12", "255.1.1.1", "300", "4111 1111 1111 1111", "-", " ", "+", "+1 (425) 555-9684", "é", "4111111111111111", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(text) == plain_pii(text), text


def test_pii_disguises(spark):
    cases = {
        "mail john.doe (at) example (dot) com now": "email", "mail john at example dot com now": "email", "call plus one four two five five five five zero one nine nine ok": "phone",
        "іnfo@exаmple.com": "email", "jane[at]corp.example.org": "email", "card ４１１１１１１１１１１１１１１１ x": "card",
    }
    for text, kind in cases.items():
        base, more = pii.all_spans(text)
        assert kind in [k for k, _, _ in base + more], text
        for k, a, b in more:
            assert 0 <= a < b <= len(text)
    text = "mail john.doe (at) example (dot) com now"
    assert pii.all_spans(text)[1] == [("email", 5, len(text) - 4)]
    for clean in ("meet at the dot com boom", "one two three", "five of us at home. Then four", "look at example.com today"):
        assert pii.all_spans(clean) == ([], []), clean
    got = pii.redact(frame(spark, [(1, "to a@b.co now"), (2, None)])).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["to <email> now", None]


def test_pii_dot_disguises():
    cases = {
        "john@example[.]com": "email", "john@example dot com": "email", "john@example[dot]com": "email", "john [AT] example [DOT] com": "email",
        "John At Example Dot Com": "email", "john at mail (dot) example (dot) com": "email", "192[.]168[.]0[.]1": "ip", "192 dot 168 dot 0 dot 1": "ip",
        "one nine two dot one six eight dot zero dot one": "ip", "One-nine-two.168.zero.one": "ip",
    }
    for text, kind in cases.items():
        whole = f"see {text} now"
        assert pii.all_spans(whole) == ([], [(kind, 4, 4 + len(text))]), (text, pii.all_spans(whole))
    for clean in ("the point is a dot on the map", "one dot two dot three", "one point two. Three point four", "at home (point) and dot com"):
        assert pii.all_spans(clean) == ([], []), clean


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    hit, n = set(), len(words)
    grams = [tuple(words[i : i + 5]) for i in range(n - 4)]
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark):
    rng = random.Random(2)
    docs = [(i, "".join(rng.choice(["a ", "b ", "c ", "\n", "é# ", "\t", "x|y ", "\x1f", "　"]) for _ in range(rng.randrange(60)))) for i in range(200)] + [(999, None)]
    got = quality.statistics(frame(spark, docs)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in got} == {i: plain_quality(t) for i, t in docs}


def test_outliers_go_and_others_stay(spark):
    rng = random.Random(3)
    docs = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(40, 300))) + ".", "en", f"s{i % 2}") for i in range(500)]
    docs += [(1000 + i, " | ".join("$$$%%%" for _ in range(60)), "en", "s0") for i in range(20)]
    r = {x["doc_id"]: x for x in quality.quality_rules(frame(spark, docs)).collect()}
    assert sum(not r[i]["kept"] for i in range(500)) <= 2
    assert not any(r[1000 + i]["kept"] for i in range(20))


def test_repeated_lines_are_outliers_in_small_groups_too(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    line = lambda: " ".join(word() for _ in range(8)) + "."
    docs = [(i, "\n".join(line() for _ in range(rng.randrange(8, 40))), "en", f"s{i % 9}") for i in range(270)]
    docs += [(1000 + i, "\n".join(x for _ in range(30) for x in (line(), "Read more")), "en", f"s{i}") for i in range(4)]
    r = {x["doc_id"]: x for x in quality.quality_rules(frame(spark, docs)).collect()}
    assert not any(r[1000 + i]["base_failed"] or r[1000 + i]["kept"] for i in range(4))
    assert sum(not r[i]["kept"] for i in range(270)) <= 1


def test_estimates_against_plain_fast_mcd(spark):
    """The distributed search comes as low as exact concentration steps from sixty random starts, and flags the same rows."""
    rng = np.random.default_rng(8)
    p, n, h = len(quality.FEATURES), 900, 675
    mix = rng.normal(size=(p, p)) * 0.4
    x = rng.normal(size=(n, p)) @ mix
    x[:150] += 6 * rng.normal(size=p)
    floor = np.diag(np.square(quality.FLOORS))

    def fitted(rows):
        cov = np.cov(rows.T, bias=True) + floor
        d = x - rows.mean(0)
        return np.linalg.slogdet(cov)[1], np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

    best = (np.inf, None)
    for _ in range(60):
        logdet, d2 = fitted(x[rng.choice(n, p + 2, replace=False)])
        for _ in range(30):
            last = logdet
            logdet, d2 = fitted(x[np.argsort(d2)[:h]])
            if abs(last - logdet) < 1e-9:
                break
        best = min(best, (logdet, d2), key=lambda b: b[0])
    used = spark.createDataFrame([("g", "g", *map(float, r)) for r in x], "g_lang string, g_source string, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    m = quality.estimates(used, 0.75, 20, 0.0).where("g_lang = 'g'").first()
    factor = np.zeros((p, p))
    factor[np.triu_indices(p)] = m["factor"]
    d2 = np.square((x - np.array(m["centre"])) @ factor.T).sum(1)
    assert m["logdet"] <= best[0] + 0.1
    flagged = lambda d: d / max(1, np.median(d) / quality.chi_square_point(0.5, p)) > quality.chi_square_point(1 - 1e-6, p)
    assert (flagged(d2) == flagged(best[1])).mean() > 0.99 and flagged(d2)[:150].all() and not flagged(d2)[150:].any()


def test_chi_square_points():
    """Tabled points of eight degrees of freedom."""
    assert [round(quality.chi_square_point(q, 8), 2) for q in (0.5, 0.95, 0.999)] == [7.34, 15.51, 26.12]


def test_quality_awkward(spark):
    got = quality.quality_rules(awkward(spark)).collect()
    assert len(got) == 8
    assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 10)
    assert quality.quality_rules(awkward(spark).limit(0)).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)


def test_language_awkward(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(10001, None, None, "s", 0), (10002, "", "en", "s", 0), (10003, "123 !?", "en", "s", 0)], docs.schema)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs.limit(200).unionByName(odd)).where("doc_id > 10000").collect()}
    assert got == {10001: ("und", 0.0), 10002: ("und", 0.0), 10003: ("und", 0.0)}
    assert {r["lang_pred"] for r in language_id.identify(odd).collect()} == {"und"}


def test_phrases_against_plain_parsing():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 4, 300).astype(np.uint8)
    table = language_id.automaton(sample, 4)
    texts = [rng.integers(0, 4, n).astype(np.uint8) for n in (50, 30, 30, 7, 1)]
    blocks = np.zeros((5, 50), np.uint8)
    for i, t in enumerate(texts):
        blocks[i, : len(t)] = t
    got = language_id.phrases(blocks, np.array([len(t) for t in texts]), table)
    whole = sample.tobytes()
    for i, t in enumerate(texts):
        n, at, raw = 0, 0, t.tobytes()
        while at < len(raw):
            k = 1
            while at + k < len(raw) and raw[at : at + k + 1] in whole:
                k += 1
            n, at = n + 1, at + k
        assert got[i] == n


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    rank, p = got["score"].rank(), got["toxic"] == 1
    auc = (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())
    assert auc > 0.93
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()


def test_toxicity_awkward(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(awkward(spark), none).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.drop_toxic(awkward(spark), none).count() == 8
    assert toxicity.toxicity(awkward(spark).limit(0), none).count() == 0


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\").\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nThe software is provided \"as is\", without warranty of any kind, express or implied."
    texts = [(1, "x\nThis work is licensed under the GNU General Public License, version 3.\ny"), (2, "Licensed under the Apache License, Version 2.0. Released under the MIT License."), (3, mit), (4, "Licensed under CC BY-NC 4.0."), (5, None), (6, "a licence to drive"), (7, "")]
    got = {r["doc_id"]: (r["n_sentences"], r["licenses"]) for r in license_scan.license_scan(frame(spark, texts)).collect()}
    assert got == {1: (1, "GPL-3"), 2: (2, "Apache-2.0,MIT"), 3: (3, "MIT"), 4: (1, "CC-BY-NC-4.0"), 5: (0, ""), 6: (0, ""), 7: (0, "")}
    (a, b, name, _), *_ = license_scan.sentences(texts[0][1])
    assert texts[0][1][a:b] == "This work is licensed under the GNU General Public License, version 3." and name == "gpl_notice"


WRAPPED = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice in the documentation.\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "GPL-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of FITNESS.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see elsewhere.",
}


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// ", ";; "])
@pytest.mark.parametrize("width", [40, 72])
def test_wrapped_licenses(prefix, width):
    for name, text in WRAPPED.items():
        lines = ["Copyright (c) 2020 Someone", ""] + [y for x in text.split("\n") for y in (textwrap.wrap(x, width) or [""])] + ["", "int x;"]
        whole = "\n".join((prefix + x).rstrip() for x in lines)
        found = license_scan.sentences(whole)
        assert license_scan.licenses(found) == [name], (name, found)
        flat = license_scan.normalised(text)
        assert all(license_scan.normalised(whole[a:b]) in flat for a, b, _, _ in found)


def test_mixing_weights(spark):
    rng = random.Random(5)
    docs = frame(spark, [(i, "t", "en", "abc"[min(rng.randrange(10) // 4, 2)]) for i in range(6000)] + [(9001, None, "en", None)])
    out = mixing.mix(docs.where("source is not null"), {"a": 1.0, "b": 2.0, "c": 1.0}, total=4000)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] - 1000) < 130 and abs(n["b"] - 2000) < 180 and abs(n["c"] - 1000) < 130
    keys = [r["shuffle_key"] for r in out.collect()]
    assert keys == sorted(keys)
    assert mixing.mix(docs, {"null": 1.0}, total=1).where("source is not null").count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(awkward(spark)).columns == [*awkward(spark).columns, "copy_no", "shuffle_key"]


def test_mixing_of_a_rare_source(spark):
    docs = frame(spark, [(i, "t", "en", "a") for i in range(50_000)] + [(90_001, "t", "en", None)])
    got = mixing.mix(docs).where("source is null").agg({"copy_no": "max", "*": "count"}).first()
    rate = 50_001 / 2
    u, below, k = int(hashlib.md5(b"17:90001").hexdigest()[:13], 16) / 2**52, 0.0, 0
    while (below := below + math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))) <= u:
        k += 1
    assert tuple(got) == (k, k) and k > mixing.BLOCK


def test_mixing_passes_columns_of_any_name(spark):
    names = ["mix_source", "mix_row", "mix_id", "mix_copies", "mix_block", "cdf", "cdf_from", "rate", "copy_no", "shuffle_key", "weight", "rows"]
    docs = frame(spark, [(i, f"t{i}", "en", "ab"[i % 2]) for i in range(40)] + [(None, None, None, None), (3, "t3", "en", "b")])
    docs = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "copy_no_", "shuffle_key_"]
    rows = out.collect()
    assert rows and all(r[n] == i for r in rows for i, n in enumerate(names))
    assert [r["shuffle_key_"] for r in rows] == sorted(r["shuffle_key_"] for r in rows)
    plain = mixing.mix(docs.drop(*names)).collect()
    assert sorted((str(r["doc_id"]), r["copy_no"]) for r in plain) == sorted((str(r["doc_id"]), r["copy_no_"]) for r in rows)
