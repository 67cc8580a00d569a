"""Each operator on edge cases, and against brute force, an exact round trip or SQL."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations
from math import log, log10
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import license_scan, line_dedup, minhash_dedup, mixing, ppm_lm, quality_rules, registry, sentencepiece_codec, suffix_dedup, topk_search, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n string, key string, sid int, epoch int, score string, cut int, gone int, _lines int, _left int, _h int, _id int, _epoch int, term int, th int"


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en" if i % 2 else None, f"src{i % 3}", 0, "n", "k", 1, 2, "s", *range(9)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null id, null and empty text, repeated rows, a repeated id with another text, a very long text."""
    r = random.Random(1)
    long_ = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "x" * 50]) for _ in range(30000)) + "\nline\nline\nline"
    texts = [None, "", "one two three", "one two three", long_, "a\nb\nc\nd", "a\nb\nc\nd", "\n \n\t", "Licensed under the MIT License.", long_ + " end"]
    ids = [None, 1, 2, 2, 4, 5, 5, 7, 8, 2]
    return docs_of(spark, texts, ids), len(texts)


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if w]


RUNS = {
    "codec": lambda d: sentencepiece_codec.round_trip(d, sentencepiece_codec.load()),
    "license": license_scan.scan,
    "suffix": suffix_dedup.dedup,
    "lines": line_dedup.dedup_lines,
    "ppm": lambda d: ppm_lm.scores(d, F.col("doc_id") == 5),
    "quality": quality_rules.judge,
    "minhash": minhash_dedup.near_duplicates,
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_and_empty_tables(spark, odd, name):
    d, n = odd
    assert RUNS[name](d).count() == n
    if name == "ppm":
        assert ppm_lm.scores(d.limit(0), F.lit(False)).count() == 0
    else:
        assert RUNS[name](d.limit(0)).count() == 0


def test_odd_rows_mixing_search_toxicity(spark, odd):
    d, n = odd
    whole = mixing.mixed(d, mixing.Mix(budget=1.0, max_epochs=1), {"domain": F.lit("x")})
    assert whole.count() == n and mixing.mixed(d.limit(0), mixing.Mix(), {"domain": F.lit("x")}).count() == 0
    q = d.select(F.col("doc_id").alias("query_id"), "text")
    assert topk_search.search(d, q).count() > 0 and topk_search.search(d.limit(0), q).count() == 0
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (4, None)], "doc_id bigint, toxic int")
    assert toxicity.score(d, toxicity.train(d, labels)).count() == n


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, d).toPandas()
    cols = sorted(want.columns)
    norm = lambda x: sorted(map(str, x[cols].itertuples(index=False, name=None)))
    assert cols == sorted(got.columns) and norm(got) == norm(want)


def test_codec_against_library():
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(sentencepiece_codec.DEFAULT_MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1  # the same pieces and scores as a unigram model
    sp = spm.SentencePieceProcessor(model_proto=m.SerializeToString())
    c = sentencepiece_codec.load()
    texts = ["", " ", "  two  spaces ", "Hello world, how are you?", "naïve café 梦 ゼ", "don't", None, "\U0001f600 x", "a" * 300]
    ids, off = c.encode(pa.array(texts))
    assert [ids[a:z].tolist() for a, z in zip(off, off[1:])] == [sp.encode(t or "") for t in texts]
    assert c.decode(ids, off).to_pylist() == [t or "" for t in texts]
    assert c.decode(np.array([3 + 0xE2], np.int32), np.array([0, 1])).to_pylist() == ["�"]


def test_budgets_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("b", "en", "s3", 1000)], "domain string, lang string, source string, tokens bigint")
    w = (("domain", "a", 0.5), ("domain", "b", 0.5), ("source", "s1", 0.5), ("source", "s2", 0.5), ("source", "s3", 1.0), ("lang", "en", 1.0))
    got = {r.source: r.budget for r in mixing.budgets(leaves, mixing.Mix(budget=400 / 2010, max_epochs=1, weights=w)).collect()}
    assert got == {"s1": 10, "s2": 190, "s3": 200}


def test_licence_order(spark):
    t = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nReleased under CC0? Licensed under CC BY-SA 4.0."
    r = license_scan.scan(docs_of(spark, [t])).first()
    assert r.sentence_ids == ["mit_title", "mit_grant", "mit_notice", "cc_by_sa_ref"] and r.licences == ["MIT", "CC-BY-SA-4.0"]


GPL = """This program is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{mark2} either version {v} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
NOTICES = {
    "GPL-3.0-or-later": (GPL.format(mark=":", mark2=",", v=3), ["gpl_free", "gpl3_terms", "gpl_warranty", "gpl_implied", "gpl_see"]),
    "GPL-2.0-or-later": (GPL.format(mark=";", mark2=";", v=2), ["gpl_free", "gpl_terms", "gpl2_later", "gpl_warranty", "gpl_implied", "gpl_see"]),
    "LGPL-2.1-or-later": (
        """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.""",
        ["lgpl_free", "lgpl_terms", "lgpl21_later", "gpl_warranty", "gpl_implied", "gpl_see"],
    ),
    "MIT": (
        """MIT License

Copyright (c) 2024 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
        ["mit_title", "mit_grant", "mit_notice", "as_is", "no_liability"],
    ),
    "BSD-3-Clause": (
        """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
        ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"],
    ),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS.""",
        ["isc_grant", "isc_warranty"],
    ),
    "Apache-2.0": (
        """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
        ["apache_ref", "apache_comply", "apache_copy", "apache_unless", "apache_see"],
    ),
    "MPL-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        ["mpl2_ref", "mpl2_copy"],
    ),
}


def test_standard_notices_plain_and_commented(spark):
    texts, want = [], []
    for name, (t, ids) in NOTICES.items():
        for lead in ("", " * ", "// ", "# "):
            texts.append("\n".join((lead + x).rstrip() for x in t.split("\n")))
            want.append((ids, [name]))
    got = {x.doc_id: (x.sentence_ids, x.licences) for x in license_scan.scan(docs_of(spark, texts)).collect()}
    for i, w in enumerate(want):
        assert got[i] == w, texts[i]


def copies(r, base, n, rate):
    out = []
    for _ in range(n):
        w = base.split(" ")
        for i in range(len(w)):
            if r.random() < rate:
                w[i] = f"w{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_minhash_brute_force(spark):
    r = random.Random(3)
    new = lambda n: " ".join(f"t{r.randrange(10**6)}" for _ in range(n))
    texts = [new(120) for _ in range(30)] + copies(r, new(150), 60, 0.02) + copies(r, new(100), 20, 0.04) + ["x y", "x y", "", None, "X y"]
    texts += [x for rate in (0.005, 0.02, 0.03, 0.045) for x in copies(r, texts[0], 125, rate)]  # a large group about the limit
    texts += [x for t in copies(r, texts[0], 40, 0.045) for x in copies(r, t, 3, 0.01)]  # small ones at its border
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash_dedup.near_duplicates(docs_of(spark, texts), minhash_dedup.Setting(words=4)).collect()}
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()) for w in map(words, texts)]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    assert got == {i: (len(s), top(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_suffix_brute_force(spark, block):
    r = random.Random(5)
    s = suffix_dedup.Setting(length=40, k=20, block=block)
    new = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    p, q = new(90), new(45)
    texts = [new(50) + p + new(30), p, new(10) + q + p + q, "a" * 200, new(39), "", None, *[new(r.randrange(60)) + q + new(r.randrange(60)) for _ in range(12)], p[:60]]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.dedup(docs_of(spark, texts), s).collect()}
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 40] for b in raw for i in range(len(b) - 39))
    for n, b in enumerate(raw):
        cover = [False] * len(b)
        for i in range(len(b) - 39):
            if seen[b[i : i + 40]] > 1:
                cover[i : i + 40] = [True] * 40
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = sum(c and (i == 0 or not cover[i - 1]) for i, c in enumerate(cover))
        assert got[n] == (len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest())


def test_ppm_is_a_distribution_and_base_scores(spark):
    texts = ["the cat sat", "the dog sat on the mat", "", None, "The end", "cat cat"]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got = {x.doc_id: x for x in ppm_lm.scores(docs_of(spark, texts), held).collect()}
    out = {i: crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    c = Counter(w for i, t in enumerate(texts) if not out[i] for w in [*words(t), "\n"])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        w = [*words(t), "\n"]
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (out[i], len(w), sum(c[y] > 0 for y in w), n)
        assert x.base_score == pytest.approx(sum(log10((c[y] + 0.5) / (n + 0.5 * (v + 1))) for y in w)) and x.score < 0
    # all first symbols of a word, the end and every longer continuation add up to one
    vocab = spark.createDataFrame([(b"ab", 3), (b"ac", 1), (b"b", 2), (b"\n", 2)], "tok binary, c long")
    levels = ppm_lm.fit(vocab, 10, ppm_lm.Setting(order=3, contexts=1 << 12))
    one = pa.array([bytes([b]) for b in range(256) if b not in (10, 32)], pa.binary())
    p1 = (10 ** ppm_lm.code_length(one, levels, 3)).sum() + (10 ** ppm_lm.code_length(pa.array([b"\n"], pa.binary()), levels, 3)).sum()
    assert 0 < p1 <= 1.0001


def test_toxicity_held_out(spark):
    r = random.Random(9)
    bad, plain = ["vequana", "vequelo", "vequiri", "scum"], ["".join(r.choice("abcdefghijk") for _ in range(5)) for _ in range(300)]
    texts = [" ".join(r.choices(plain, k=40) + (r.choices(bad, k=3) if i % 5 == 0 else [])) for i in range(600)]
    d = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id bigint, toxic int")
    m = toxicity.train(d, labels)
    got = toxicity.score(d.drop("score"), m).filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).collect()
    assert got and all((x.score >= 0.7) == (x.doc_id % 5 == 0) for x in got)


def test_quality_drops_outliers_and_keeps_the_rest(spark):
    r = random.Random(2)
    good = [" ".join(f"w{r.randrange(5000)}" for _ in range(80)) for _ in range(120)]
    texts = [*good, " ".join(f"w{i}&&&" for i in range(80)), "short", "a b c " * 40]
    got = {x.doc_id: (x.base_failed, x.kept) for x in quality_rules.judge(docs_of(spark, texts)).collect()}
    assert all(got[i] == (False, True) for i in range(120)) and got[120] == (False, False) and got[121] == got[122] == (True, False)


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").select("doc_id").distinct().count()
    out = corpus_pipeline.run(spark, d).collect()
    assert 0 < len({x.doc_id for x in out}) <= n and all(x.round_trip and len(x.ids) == x.n_tokens for x in out)


def brute_ppm(train, texts, order):
    """Each byte from the bytes before it, by counting slices of the whole training streams."""
    stream = lambda t: b"\n" * order + b"".join(w.encode() + b" " for w in words(t)) + b"\n"
    seen = {}
    for t in train:
        s = stream(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen.setdefault(s[i - k : i], Counter())[s[i]] += 1

    def chance(ctx, b):
        p, out = 1.0, set()
        for k in range(order, -1, -1):
            c = {x: n for x, n in seen.get(ctx[order - k :], {}).items() if x not in out}
            if not c:
                continue
            whole = sum(c.values())
            if b in c:
                return p * (c[b] - 0.5) / whole
            p, out = p * len(c) / 2 / whole, out | set(c)
        return p / (256 - len(out))

    return [sum(log10(chance(s[i - order : i], s[i])) for i in range(order, len(s))) for s in map(stream, texts)]


@pytest.mark.parametrize("order", [1, 2, 4, 6])
def test_ppm_against_brute_force_across_words(spark, order):
    r = random.Random(4)
    vocab = ["the", "cat", "sat", "on", "mat", "Über", "naïve", *("w%d" % r.randrange(99) for _ in range(30))]
    texts = [" ".join(r.choices(vocab, k=r.randrange(25))) for _ in range(60)] + ["", None, "the cat sat on", "on sat cat the", "qqq ~ \x7f"]
    out = {60, 62, 63, 64, *range(0, 60, 5)}
    got = {x.doc_id: x.score for x in ppm_lm.scores(docs_of(spark, texts), F.col("doc_id").isin(list(out)), ppm_lm.Setting(order=order, block=400, words=7)).collect()}
    want = brute_ppm([t for i, t in enumerate(texts) if i not in out], texts, order)
    for i in range(len(texts)):
        assert got[i] == pytest.approx(want[i], rel=1e-5), i
    assert abs(got[62] - got[63]) > 0.1  # the order of words counts


def test_ppm_blocks_alike(spark):
    d = docs_of(spark, ["the cat sat", "a dog", "the mat"]).coalesce(1)
    got = [(x.doc_id, x.score) for x in ppm_lm.scores(d.union(d), F.col("doc_id") == 2).collect()]
    want = brute_ppm(["the cat sat", "a dog"] * 2, ["the cat sat", "a dog", "the mat"], 6)
    assert len(got) == 6 and all(s == pytest.approx(want[i], rel=1e-5) for i, s in got)


def test_ppm_keeps_contexts_seen_once(spark):
    r = random.Random(6)
    texts = ["".join(r.choices("abcdefghij", k=200)) for _ in range(2000)] + ["zyxwvut", "zyxwvut"]
    got = ppm_lm.scores(docs_of(spark, texts), F.col("doc_id") == 2001).filter("doc_id = 2001").first().score
    assert got == pytest.approx(brute_ppm(texts[:-1], texts[-1:], 6)[0], rel=1e-5)


def test_suffix_rows_without_an_id(spark):
    r = random.Random(8)
    new = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    p = new(90)
    texts = [new(50) + p + new(30), new(20) + p + new(45), new(130)]
    got = {x.n_bytes: x.n_removed for x in suffix_dedup.dedup(docs_of(spark, texts, [None, 1, None]), suffix_dedup.Setting(length=40, k=20)).collect()}
    assert got == {170: 90, 155: 90, 130: 0}


def test_op5_columns_and_passages_about_400_bytes(spark, tmp_path):
    r = random.Random(9)
    new = lambda n: "".join(r.choice("abcde fgh ") for _ in range(n))
    p, q = "p" + new(398) + "p", "q" + new(397) + "q"  # 400 bytes, and 399 that stay
    assert min(len(p.split()), len(q.split())) > 50
    texts = ["1" + p + "1", "2" + q + "2", "33" + p + "33" + q, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = registry.QUERIES["op5_suffix_dedup"](spark, f"file://{tmp_path}")
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted(tuple(x)[:5] for x in got.collect()) == [(0, 402, 400, 1, sha("11")), (1, 401, 0, 0, sha(texts[1])), (2, 803, 400, 1, sha("3333" + q)), (3, 0, 0, 0, sha(""))]


def brute_topk(docs, queries, k):
    """Scores of all documents in plain Python; ids in order."""
    words = [(i, (t or "").lower().split()) for i, t in docs]
    n, mean = len(words), max(sum(len(w) for _, w in words), 1) / len(words)
    df = {}
    for _, w in words:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = {}
    for q, text in queries:
        got = []
        for i, w in words:
            s = 0.0
            for x in set((text or "").lower().split()) & set(w):
                tf = w.count(x)
                s += log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
            if s > 0:
                got.append((-round(s, 6), i is not None, i or 0, i))
        out[q] = [g[3] for g in sorted(got, key=lambda g: g[:3])[:k]]
    return out


def test_topk_against_brute_force_with_ties_over_shards(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    docs = [(i, " ".join(r.choices(vocab, weights, k=r.choice([1, 5, 20, 200])))) for i in range(300)]
    docs += [(300 + i, "w3 w5 W7") for i in range(40)] + [(None, "w3 w5 w7"), (400, None), (401, ""), (402, "  "), (7, docs[7][1])]
    queries = [(i, docs[i][1]) for i in range(0, 345, 15)] + [(1000, "nothing known"), (1001, None)]
    s = topk_search.Setting(k=5, shard_chars=4000, block=4, first=1, group=7)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(queries, "query_id long, text string")
    rows = topk_search.search(d, q, s).collect()
    got = {}
    for x in sorted(rows, key=lambda x: (x.query_id, x.rank)):
        got.setdefault(x.query_id, []).append(x.doc_id)
    assert {x.rank for x in rows} == {1, 2, 3, 4, 5}
    assert got == {q: ids for q, ids in brute_topk(docs, queries, 5).items() if ids}


def test_topk_skips_blocks(spark):
    texts = [f"common {'alpha' if i < 50 else 'beta'} t{i}" for i in range(400)]
    s = topk_search.Setting(k=3, block=8, first=1)
    index = topk_search._index(docs_of(spark, texts).withColumn("shard", F.lit(0).cast("long")), s).toArrow()
    shard = topk_search.Shard(index, 3.0, s)
    words = pa.array(["common", "alpha", "t7"]).cast(pa.binary())
    buf, off = topk_search.flat(words)
    rows, score = shard.search(topk_search.hash_spans(buf, off[:-1], off[1:]), np.array([0.1, 2.0, 6.0]))
    assert [shard.ids[int(i)].as_py() for i in rows][0] == 7 and len(rows) == 3 and (np.diff(score) <= 0).all()
    assert shard.skipped > shard.read > 0


def test_topk_queries_together(spark):
    r = random.Random(8)
    vocab, weights = [f"w{i}" for i in range(400)], [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(r.choices(vocab, weights, k=r.choice([1, 8, 40, 400])))) for i in range(400)]
    docs += [(400 + i, docs[3][1]) for i in range(30)] + [(500, None), (501, "Ä ä")]
    queries = [(i, t) for i, t in docs if i % 3 == 0]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    want = {i: ids for i, ids in brute_topk(docs, queries, 4).items() if ids}
    for dense in (0.0, 0.01, 2.0):  # all terms in matrices, some, none
        found = topk_search.search(d, q, topk_search.Setting(k=4, shard_chars=30000, block=4, first=4, group=50, batch=16, dense=dense))
        got = {}
        for x in sorted(found.collect(), key=lambda x: (x.query_id, x.rank)):
            got.setdefault(x.query_id, []).append(x.doc_id)
        assert got == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CoGroup" not in plan and "rangepartitioning" not in plan and plan.count("hashpartitioning(shard") == 0  # no query is copied for each shard
