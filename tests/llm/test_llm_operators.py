"""The training-data operators against brute force, on small frames with nulls, ties, repeats, empty and long texts."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from oracle import DATA, duck_rows, spark_rows
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, fingerprint, licenses, mixing, queries, sharding, similarity, topk, toxicity, urls
from tessera.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sid int, label string, size long, shard int"


def frame(spark, rows):
    """Rows (doc_id, text, source) with columns whose names the operators also use."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, "x", 2, 3) for i, t, s in rows], DOCS)


def prose(rng, n, words=60):
    return " ".join(rng.choice(VOCABULARY[:words]) for _ in range(n))


VOCABULARY = [a + b for a in "bdfgklmnprst" for b in ("a", "ei", "o", "u", "ix", "am")]


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    rows = [(0, None, "a"), (1, "", None), (2, " \n\t ", "a"), (3, "one", "b"), (4, "ONE", "b"), (5, "a b c", "a"), (6, "a  b\nc", "c")]
    base = [prose(rng, n) for n in (8, 30, 90, 200, 400)]
    for i in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 1, 2, 6))):
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        rows.append((10 + i, " ".join(words), rng.choice(("a", "a", "a", "b", None))))
    rows += [(200, prose(rng, 30_000), "b"), (201, "é中🎉 naïve x" * 50, "c"), (10, rows[7][1], rows[7][2]), (None, rows[8][1], "a"), (None, "no id here at all", "a")]
    return rows


def brute_components(rows, k, num, den):
    sets = []
    for _, t, _ in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(ws[j : j + k]) for j in range(max(1, len(ws) - k + 1))) if ws else frozenset())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * len(sets[a] | sets[b]):
            up[root(b)] = root(a)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)].append(r[0])
    return sorted(((r[0], len(sets[i]), min(least[root(i)], default=None)) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100)])
def test_ngram_components(spark, odd_rows, k, num, den):
    found = similarity.ngram_components(frame(spark, odd_rows), k=k, num=num, den=den).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == brute_components(odd_rows, k, num, den)


@pytest.mark.parametrize("k,num,den", [(2, 60, 100), (4, 85, 100)])
def test_ngram_links(spark, odd_rows, k, num, den):
    """Every link between different texts, and each row's number of links."""
    sets = []
    for _, t, _ in odd_rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(ws[j : j + k]) for j in range(max(1, len(ws) - k + 1))) if ws else frozenset())
    linked = lambda a, b: bool(a and b) and den * len(a & b) >= num * len(a | b)
    pairs = sum(linked(a, b) for a, b in itertools.combinations(set(sets), 2))
    links, members = similarity.ngram_links(frame(spark, odd_rows), k=k, num=num, den=den)
    found = [(r.a, r.b) for r in links.collect()]
    known = {r.set_id for r in members.collect()} - {None}
    assert pairs and len(found) == len(set(found)) == pairs and all(a < b and {a, b} <= known for a, b in found)
    counts = similarity.link_counts(frame(spark, odd_rows), k=k, num=num, den=den).collect()
    want = [(r[0], len(s), sum(linked(s, o) for o in sets) - bool(s)) for r, s in zip(odd_rows, sets)]
    assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in counts), key=repr) == sorted(want, key=repr)


def test_ngram_components_of_nothing(spark):
    assert similarity.ngram_components(frame(spark, [])).count() == 0


def test_texts_of_few_words(spark):
    """A batch that holds fewer words than a shingle."""
    rows = [(1, "a b c", "a"), (2, "d e", "a"), (3, "A b  c", "b")]
    assert sorted(r.doc_id for r in similarity.near_duplicates_removed(frame(spark, rows), k=5).collect()) == [1, 2]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in similarity.ngram_components(frame(spark, rows), k=5).collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (2, 70, 100)])
def test_a_large_group_of_near_copies(spark, monkeypatch, k, num, den):
    """Blocks and passes of every kind: a tile of many sets, some linked and some not."""
    monkeypatch.setattr(similarity, "BLOCK", 16)
    rng = random.Random(8)
    rows, base = [], prose(rng, 60).split()
    for i in range(150):
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = rng.choice(VOCABULARY)
        rows.append((i, " ".join(own), "a"))
    found = similarity.ngram_components(frame(spark, rows), k=k, num=num, den=den).collect()
    want = brute_components(rows, k, num, den)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == want
    assert 1 < len({c for _, _, c in want}) < 150


def test_near_duplicates_removed_of_shared_ids(spark):
    """Rows of one id and different texts, rows without id, and columns of clashing names."""
    text, other = " ".join(VOCABULARY[:40]), " ".join(VOCABULARY[30:70])
    rows = [(1, text, "a"), (2, text + " x", "b"), (2, other, "c"), (None, other, "d"), (None, "no id", "e"), (None, "NO id", "f"), (7, "", "g"), (7, "", "h"), (7, None, "i")]
    docs = frame(spark, rows).withColumns({c: F.lit(1) for c in ("_kept", "_set", "_of", "label", "sid", "n")})
    kept = similarity.near_duplicates_removed(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, (r.text or "").lower()) for r in kept.collect()), key=repr) == sorted([(1, text), (2, other), (None, "no id"), (7, ""), (7, "")], key=repr)


def test_near_duplicates_removed(spark):
    text = " ".join(VOCABULARY[:40])
    rows = [(5, text, "a"), (3, text, "a"), (3, text, "a"), (9, text + " extra", "b"), (4, "another text", "a"), (None, None, None)]
    kept = similarity.near_duplicates_removed(frame(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(3, text), (4, "another text"), (None, None)], key=repr)
    assert kept.columns == frame(spark, rows).columns


@pytest.mark.parametrize("local", [0, 20, 1000])
def test_components_of_a_path(spark, local):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7), (None, 3)]
    labels = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), local=local).collect()}
    assert len({labels[i] for i in range(61)}) == 1 and len({labels[i] for i in (100, 101, 102)}) == 1 and labels[0] != labels[100]


def test_bpe_equals_the_rank_rule(spark, odd_rows):
    import public_tokenizers
    import tiktoken

    path, pattern = queries.multilingual_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t for _, t, _ in odd_rows] + ["=" * 5000, "anana " * 40, "<|endoftext|>", "a\u0000b", "\U00016ea7 x", "  \n\n  tab\t"]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    got = {r.doc_id: r.bpe for r in bpe.round_trip_digests(frame(spark, rows), path=path, pattern=pattern).collect()}
    for i, t, _ in rows:
        ids = plain.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    coded = bpe.encode(frame(spark, rows[-8:]), path=path, pattern=pattern)
    again = bpe.decode(coded.withColumn("ids", F.col("tokens.ids")), path=path, pattern=pattern).collect()
    for r in again:
        assert r.decoded == (r.text or "")
        assert all(0 <= a < b <= len(r.text) for a, b in zip(r.tokens.starts, r.tokens.ends))
    c = bpe.codec(path, pattern)
    assert c.decode(c.encode("🎉")[:1]).endswith("\ufffd")


def test_plain_characters_are_cut_alike():
    c = bpe.codec(*queries.multilingual_vocabulary())
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000 and bpe._PLAIN.search(chr(i)) is None:
            t = f"a{chr(i)}a {chr(i)} 1{chr(i)}1"
            assert c.pattern.findall(t) == [p for p, _ in c.cutter.pre_tokenize_str(t)]


def test_toxicity_learns_and_generalises(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        words = prose(rng, rng.randrange(20, 80)).split()
        if i % 5 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = "zwack" + rng.choice(("s", "ed", "ing", "ard", "el"))
        rows.append((i, " ".join(words), "a"))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(1000, None, "a"), (1001, "", "a"), (None, "zwacking zwacked", "a"), (0, rows[0][1], "a")]
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    out = toxicity.score(docs, toxicity.train(docs, given.filter(~queries.held_out())), out_col="score").collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((r.score >= 0.7) == bool(truth[r.doc_id]) for r in held) >= 0.97 * len(held)
    assert all(r.score < 0.5 for r in out if not r.text)


def test_toxicity_model_is_of_all_grams(spark, monkeypatch):
    """No bound on the grams counted or kept changes what a gram says: brute force over all of them."""
    for bound in ("GATHERED", "MODEL"):
        monkeypatch.setattr(toxicity, bound, 20, raising=False)
    rng = random.Random(8)
    rows = [(i, prose(rng, 40) + (" zwacking" * 3 if i % 4 == 0 else "") + (" é中" if i % 3 else ""), "a") for i in range(80)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.train(frame(spark, rows), labels)

    counts = collections.defaultdict(lambda: [0, 0])
    for i, t, _ in rows:
        read = b"    " + bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in t.encode())
        for j in range(4, len(read)):
            counts[read[j - 3 : j + 1]][i % 4 == 0] += 1
    levels = {4: {g: a + b for g, (a, b) in counts.items()}}
    for n in (3, 2, 1):
        levels[n] = collections.Counter(g[1:] for g in levels[n + 1])
    totals = {(n, g[:-1]): [0, 0] for n in levels for g in levels[n]}
    for n in levels:
        for g, c in levels[n].items():
            totals[n, g[:-1]][0] += c
            totals[n, g[:-1]][1] += 1

    def shared(g):
        if len(g) == 1:
            return 0.999 * levels[1][g] / sum(levels[1].values()) + 0.001 / 256
        total, kinds = totals[len(g), g[:-1]]
        return (max(levels[len(g)][g] - 0.75, 0) + 0.75 * kinds * shared(g[1:])) / total

    usual = sum(b for _, b in counts.values()) / sum(a + b for a, b in counts.values())
    want = {}
    for g, c in counts.items():
        near = [x for h, x in counts.items() if h[:-1] == g[:-1]]
        p, total = [], [sum(x[k] for x in near) for k in (0, 1)]
        for k in (0, 1):
            p.append((max(c[k] - 0.75, 0) + (0.75 * sum(x[k] > 0 for x in near) + toxicity.PRIOR) * shared(g)) / (total[k] + toxicity.PRIOR))
        share = (total[1] + toxicity.PRIOR * usual) / (sum(total) + toxicity.PRIOR)
        if abs(c[1] - sum(c) * share) > toxicity.Z * (sum(c) * share * (1 - share) + 0.25) ** 0.5:
            want[int.from_bytes(g)] = np.log(p[1] / p[0])
    assert len(counts) > 20 and sorted(want) == model.grams.tolist()
    assert np.allclose(model.says, [want[g] for g in sorted(want)], atol=1e-5)


def test_toxicity_table_of_many_grams():
    grams = np.unique(np.random.default_rng(1).integers(1 << 29, 1 << 32, 3_000_000, dtype=np.uint64).astype(np.uint32))
    keys, values, bits = toxicity.Model(grams, np.arange(len(grams), dtype=np.float32), np.zeros(3)).table()
    assert np.array_equal(np.sort(keys[keys > 0]), grams) and np.array_equal(values[keys > 0], np.searchsorted(grams, keys[keys > 0]).astype(np.float32))


def test_toxicity_without_both_classes(spark):
    docs = frame(spark, [(1, "a b", "x"), (2, None, "x")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.toxicity < 0.001 for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {True}
    one = spark.createDataFrame([(1, 1), (1, None), (2, 1)], "doc_id long, toxic int")
    assert {r.toxicity > 0.999 for r in toxicity.score(docs, toxicity.train(docs, one)).collect()} == {True}


def test_fingerprints(spark, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None and r[0] != 10]
    found = {r.doc_id: r for r in queries.fingerprint.edited_fingerprints(frame(spark, rows)).collect()}
    order = sorted(rows)
    for i, (k, t, _) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert found[k].edited == t[: len(t) - half] + after[:half] and found[k].n_chars == len(t)
    texts = {k: t or "" for k, t, _ in rows}
    for a, b in itertools.combinations(texts, 2):
        if texts[a] == texts[b]:
            assert found[a].fingerprint == found[b].fingerprint
    one = spark.createDataFrame([("x\ny. z", "z\nx", "y.", "z\nx\ny.", "x\ny")], "a string, b string, c string, d string, e string")
    f = {c: fingerprint.fingerprint(F.col(c)) for c in "abcde"}
    r = one.select((f["a"] == f["d"]).alias("order"), (fingerprint.inserted(f["b"], f["c"]) == f["d"]).alias("ins"), (fingerprint.deleted(f["d"], f["c"]) == f["b"]).alias("del"), (f["a"] == f["e"]).alias("differ"), fingerprint.likeness(f["a"], f["d"]).alias("same")).first()
    assert (r["order"], r["ins"], r["del"], r["differ"], r["same"]) == (True, True, True, False, 1.0)


def test_edge_cases_of_next(spark):
    rows = [(None, "n", "a"), (4, "b", "a"), (4, "a", "a"), (4, "a", "a"), (9, None, "a")]
    found = fingerprint.edited_fingerprints(frame(spark, rows))
    assert found.count() == 5
    assert fingerprint.edited_fingerprints(frame(spark, [])).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 16)).round(2)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, v[5].tolist()), (301, None), (302, [float("nan")] * 16), (303, [None] * 16), (304, []), (305, [1e6] * 16), (306, [0.5] * 3), (7, v[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.filter("vec_id % 50 = 0"), k=5).collect()
    whole = [(i, np.floor(256 * np.array(x))) for i, x in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    want = []
    for i, q in whole:
        if i % 50 == 0:
            scores = sorted((-int(sum(a * b for a, b in zip(q.tolist(), x.tolist()))), j) for j, x in whole if j != i)
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:5])]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.top_k(df.filter("vec_id < 0"), df.filter("vec_id < 0")).count() == 0


def water(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > 3 * sizes[s] + 1e-9]
        if not over:
            return target | {s: rest * weight[s] / total for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            free.discard(s)
        rest = sum(sizes.values()) - sum(target.values())


def test_mixing(spark, odd_rows):
    got = mixing.mix(frame(spark, odd_rows)).collect()
    assert len(got) == len(odd_rows)
    sizes = collections.Counter()
    for r in got:
        sizes[r.source] += r.size
    want = water(dict(sizes))
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    largest = max(r.size for r in got if r.source == "a")
    assert abs(taken["a"] - want["a"]) <= largest
    again = mixing.mix(frame(spark, odd_rows[::-1]).repartition(3)).collect()
    key = lambda r: repr((r.doc_id, r.source, r.size, r.copies))
    assert sorted(map(key, again)) == sorted(map(key, got))
    out = mixing.mixed(frame(spark, odd_rows))
    assert out.columns == frame(spark, odd_rows).columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mix(frame(spark, [(1, None, None)])).first().copies == 0


def test_sharding(spark, odd_rows):
    got = sharding.shard(frame(spark, odd_rows), shards=4).collect()
    assert len(got) == len(odd_rows)
    by, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        by[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(r.size for r in got) == sum(len((t or "").encode()) + 1 for _, t, _ in odd_rows)
    homes = collections.defaultdict(set)
    for r in got:
        homes[r.doc_id, r.text_crc32].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    assert sharding.shard(frame(spark, [])).count() == 0


def test_differencing_is_tight():
    rng = random.Random(2)
    weights = [rng.randrange(1, 10_000) for _ in range(800)]
    to = sharding.difference([[x, 0, 0, 0] for x in weights])
    sums = collections.Counter()
    for x, t in zip(weights, to):
        sums[t[0]] += x
        assert sorted(t) == [0, 1, 2, 3]
    assert max(sums.values()) - min(sums.values()) <= 2


def test_licenses(spark):
    rows = [(1, "intro text\nReleased under the MIT License.\nmore", "a"), (2, "He renewed his driver license last week.", "a"), (3, None, "a"), (4, "", "a"), (5, "All rights reserved.\nLicensed under the Apache License, Version 2.0.", "a"), (1, "intro text\nReleased under the MIT License.\nmore", "a"), (6, "permission " * 5000, "a"), (None, "All rights reserved.", "a")]
    got = sorted(((r.doc_id, r.n_paragraphs, r.families) for r in licenses.scan(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, 1, "mit"), (2, 0, ""), (3, 0, ""), (4, 0, ""), (5, 2, "apache-2.0,proprietary"), (1, 1, "mit"), (6, 0, ""), (None, 1, "proprietary")], key=repr)
    assert licenses.scan(frame(spark, [])).count() == 0


def test_wrapped_licenses(spark):
    mit = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
    rows = [(1, mit, "a"), (2, gpl, "a"), (3, mit.replace("\n", "\r\n") + "\r\n \t\r\n" + gpl, "a"), (4, "He renewed his driver\nlicense last week and\npaid the fee.", "a"), (None, gpl, "a")]
    got = {(r.doc_id, r.families) for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {(1, "mit"), (2, "gpl"), (3, "gpl,mit"), (4, ""), (None, "gpl")}
    found = licenses.findings(frame(spark, rows)).filter("confirmed").collect()
    assert {(r.doc_id, r.family, r.line) for r in found} == {(1, "mit", 4), (2, "gpl", 0), (3, "mit", 4), (3, "gpl", 10), (None, "gpl", 0)}


def test_license_templates_are_told():
    families, weights, bias, telling = licenses.trained()
    for family, lines in licenses.TEMPLATES.items():
        for line in lines:
            z = np.array(bias) + sum((np.array(weights[g]) for g in licenses._grams(licenses._words(line), frozenset(telling)) if g in weights), np.zeros(len(bias)))
            assert families[int(z.argmax())] == family


#: Notices as projects carry them, none of them a template.
NOTICES = {
    "isc": """Permission to use, copy, modify, and distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "mit": """ * Permission is hereby granted, free of charge, to any person
 * obtaining a copy of this software and associated documentation
 * files (the "Software"), to deal in the Software without
 * restriction, including without limitation the rights to use, copy,
 * modify, merge, publish, distribute, sublicense, and/or sell.
 *
 * THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.""",
    "apache-2.0": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0""",
    "bsd": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met: 1. Redistributions of source code must retain the notice.""",
    "unlicense": "This is free and unencumbered software released into the public domain, and anyone is free to use it.",
    "gpl": """Dieses Programm ist freie Software. Es steht unter den Bedingungen der
GNU General Public License, Version 3 oder später.""",
    "lgpl": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one.""",
    "zlib": """Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions""",
    "agpl": "This file is licensed under the GNU Affero General Public License version 3 or later.",
    "cc-by-sa": "The text is available under the Creative Commons Attribution-ShareAlike License; terms may apply.",
    "boost": """// Distributed under the Boost Software License, Version 1.0.
// (See accompanying file LICENSE_1_0.txt)""",
}

#: Prose that uses the same words.
PROSE = [
    "The library is free for students, and any person may obtain a card without charge.",
    "He was granted permission to use the hall for any purpose of the club.",
    "The terms of the treaty were published by the general of the foundation.",
    "Die Software der Bank steht den Kunden unter bestimmten Bedingungen frei zur Verfügung.",
    "The public license office is open from nine to five, version two of the form is needed.",
    "She works at the Apache reservation and writes software for the Mozilla browser.",
    "They released the dogs into the public park and all tickets were reserved.",
    "Distribution of the source of the river is subject to the weather.",
    "Commons and lords debated the creative use of attribution in the international work.",
    "The conditions are met when the copy of the file is obtained from the office.",
]


def test_licenses_beyond_the_templates(spark):
    """Held-out notices and prose: precision and recall."""
    rows = [(i, t, f) for i, (f, t) in enumerate(NOTICES.items())] + [(100 + i, t, "") for i, t in enumerate(PROSE)]
    got = {r.doc_id: r.families for r in licenses.scan(frame(spark, rows)).collect()}
    hits = sum(f in got[i].split(",") for i, _, f in rows if f)
    said = sum(len([x for x in f.split(",") if x]) for f in got.values())
    print(got)
    assert hits >= len(NOTICES) - 1 and hits / said >= 0.9, got


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r, _ in urls.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fit, key=len, default=None)


def test_urls(spark):
    rng = random.Random(4)
    given = [None, "", "nothing", "http://net/", "https://X.Example.NET/en/1#a/b", "ftp://a.b?x=/en/", "http://example.com/de/", "http://notexample.com/de/", "http://a.org/fr/x?u=://z/", "a://b://c/d", "http://x.net", "http://x.net/\n/y"]
    given += [f"http://{rng.choice('abc')}{rng.choice('xyz')}.example.{rng.choice(('com', 'net', 'org'))}/{rng.choice(('de', 'en', 'fr', 'es'))}/{rng.randrange(99)}" for _ in range(150)]
    rows = [(i, u, "v", "h") for i, u in enumerate(given)] + [(5, given[5], "v", "h")]
    got = urls.judged(spark.createDataFrame(rows, "page_id long, url string, verdict string, gram string")).collect()
    assert len(got) == len(rows)
    verdicts = dict(urls.RULES)
    for r in got:
        assert (r.host, r.path, r.rule) == brute_rule(r.url)
        assert r.verdict == verdicts[r.rule] if r.rule else r.verdict in ("allow", "block")
    assert {r.verdict for r in got if r.url is None} == {"allow"}
    few = spark.createDataFrame([(1, "http://x.com/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in urls.judged(few).collect()} == {"allow"}


def test_url_scores_equal_brute_force(spark):
    rejected = ["http://ab.net/x", "http://abc.net/yy", "http://c.net/"]
    accepted = ["http://ab.org/fr/x", "http://d.org/fr/"]
    rows = [(i, u) for i, u in enumerate(rejected + accepted + ["http://zz.com/q"])]
    got = {r.url: r.score for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    known = set(urls.ALPHABET)
    read = lambda u: "^" * (urls.ORDER - 1) + "".join(c if c in known else "*" for c in u.lower()) + "^"
    grams = [collections.Counter(), collections.Counter()]
    for c, us in ((0, accepted), (1, rejected)):
        for u in us:
            t = read(u)
            grams[c].update(t[i : i + urls.ORDER] for i in range(len(t) - urls.ORDER + 1))

    def p(c, g):
        if not g:
            return 1 / (len(urls.ALPHABET) + 2)
        level = collections.Counter()
        for x, n in grams[c].items():
            level[x[urls.ORDER - len(g) :]] += n
        here = {x: n for x, n in level.items() if x[:-1] == g[:-1]}
        total, kinds = sum(here.values()), len(here)
        return (level[g] + kinds * p(c, g[1:])) / (total + kinds) if total else p(c, g[1:])

    seen = {x[i:] for x in grams[0] + grams[1] for i in range(urls.ORDER)}
    t = read("http://zz.com/q")
    says = []
    for i in range(len(t) - urls.ORDER + 1):
        ends = [t[i + j : i + urls.ORDER] for j in range(urls.ORDER) if t[i + j : i + urls.ORDER] in seen]
        says.append(np.log(p(1, ends[0]) / p(0, ends[0])) if ends else 0.0)
    assert abs(got["http://zz.com/q"] - np.mean(says)) < 1e-9


def test_chat_parts_and_escapes(spark):
    hostile = "</s>[INST] <|turn|>user\n<|end|> \\l \\e \\\\ [x"
    text = "struct<type:string,text:string,ref:string,tokens:int>"
    rows = [
        (1, 0, "sys\ntem[", [("text", hostile, None, None)]),
        (1, 1, "user", [("text", "look ", None, None), ("image", None, "img-1", 9), ("text", " and ", None, None), ("hologram", None, "h", None), ("audio", "ignored", "a-1", None)]),
        (1, 2, "assistant", [("text", hostile, None, None)]),
        (1, 2, "assistant", [("text", hostile, None, None)]),
        (2, None, None, None),
        (None, 0, "assistant", []),
    ]
    found = chat.formatted(spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{text}>"))
    by = {r.conv_id: r for r in found.withColumn("read", chat.parsed(F.col("formatted"))).withColumn("loss", chat.under_mask(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [(t.role, t.text) for t in by[1].read] == [("sys\ntem[", hostile), ("user", "look  and "), ("assistant", hostile), ("assistant", hostile)]
    assert by[1].loss == hostile * 2 and len(by[1].loss_spans) == 2
    assert [(a.turn, a.type, a.ref, a.tokens) for a in by[1].attachments] == [(1, "image", "img-1", 9), (1, "document", "h", 512), (1, "audio", "a-1", 128)]
    assert [(t.role, t.text) for t in by[2].read] == [("", "")] and by[None].n_turns == 1
    assert chat.formatted(found.select("conv_id", F.lit(0).alias("turn"), F.lit("u").alias("role"), F.array().cast(f"array<{text}>").alias("parts")).filter("false")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, DATA)) == duck_rows(queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs_on_whole_tables(spark, name):
    rows = queries.QUERIES[name](spark, DATA).count()
    table_ = "pages" if name.startswith("op9") else "documents"
    assert rows == spark.read.parquet(f"{DATA}/{table_}.parquet").count()


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA).collect()
    assert out and all(r.decodes for r in out)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r.doc_id for r in out} <= set(docs)


CLASHING = ("_id", "_s", "_size", "_copies", "_kept", "_url", "score", "host", "rule", "verdict", "component_id", "n_shingles", "set_id", "toxicity", "tokens", "fingerprint", "next_text", "_range", "_end", "paragraph", "family", "h")


def clashing(df):
    """Columns whose names the operators use too, with values of their own."""
    return df.withColumns({c: F.lit("mine") for c in CLASHING if c not in df.columns})


def test_clashing_columns(spark, odd_rows):
    docs = clashing(frame(spark, odd_rows[:40]))
    own = lambda df, *but: all(set(df.select(c).distinct().collect()) <= {("mine",)} for c in CLASHING if c not in but)
    assert similarity.ngram_components(docs).count() == 40
    assert own(similarity.near_duplicates_removed(docs)) and own(mixing.mixed(docs))
    assert mixing.mix(docs).count() == sharding.shard(docs, shards=4).count() == licenses.scan(docs).count() == fingerprint.edited_fingerprints(docs).count() == 40
    path, pattern = queries.multilingual_vocabulary()
    assert own(bpe.encode(docs, path=path, pattern=pattern, out_col="coded"))
    labels = spark.createDataFrame([(10 + i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert own(toxicity.score(docs, toxicity.train(docs, labels), out_col="found"))
    pages = clashing(spark.createDataFrame([(1, "http://a.example.net/en/1"), (2, "http://x.com/"), (3, None)], "page_id long, url string"))
    judged = urls.judged(pages)
    assert own(judged, "host", "path", "rule", "score", "verdict") and judged.count() == 3 and len(judged.columns) == len(pages.columns) + 1
    vectors = clashing(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(100)], "vec_id long, embedding array<double>"))
    assert topk.top_k(vectors, vectors.filter("vec_id % 50 = 0")).count() == 10


def test_mixing_copies(spark):
    """One offset a source: copies are the floor of the expectation or one more, whole for large documents, and words near the target."""
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.1) * 5 + 1)), rng.choice("abcdefg")) for i in range(1500)]
    got = mixing.mix(frame(spark, rows)).collect()
    taken, target, sizes = collections.Counter(), {}, collections.Counter()
    for r in got:
        taken[r.source] += r.copies * r.size
        target[r.source], sizes[r.source] = r.target, r.source_size
    for s in target:
        assert abs(taken[s] - target[s]) <= 0.02 * sizes[s], (s, taken[s], target[s])
    small = collections.defaultdict(set)
    for r in got:
        if r.size * mixing.LARGE > r.source_size:
            assert int(r.target / r.source_size) <= r.copies <= int(r.target / r.source_size) + 1
        else:
            small[r.source].add(r.copies)
    assert all(max(c) - min(c) <= 1 for c in small.values())


def test_shards_are_balanced_and_keep_copies_together(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(1, 300)), "a") for i in range(300)] + [(1000 + i, "the same text", "b") for i in range(120)] + [(2000 + i, prose(rng, 900), "c") for i in range(3)]
    got = sharding.shard(frame(spark, rows), shards=8).collect()
    by, homes = collections.Counter(), collections.defaultdict(set)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        by[r.shard] += r.size
        homes[texts[r.doc_id]].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    largest = max(collections.Counter({t: sum(len(x.encode()) + 1 for x in texts.values() if x == t) for t in set(texts.values())}).values())
    assert len(by) == 8 and max(by.values()) - min(by.values()) <= largest
    # single texts of like sizes: much nearer than the largest group
    even = sharding.shard(frame(spark, rows[:300]), shards=8).collect()
    sums = collections.Counter()
    for r in even:
        sums[r.shard] += r.size
    assert max(sums.values()) - min(sums.values()) <= 0.01 * sum(sums.values()) / 8


def test_url_scores_and_threshold(spark):
    """The models, the scores and the verdicts against plain Python."""
    rng = random.Random(9)
    given = sorted({f"http://{rng.choice(('shop', 'news', 'blog'))}.example.{tld}/{lang}/{rng.choice(('a', 'buy', 'win'))}{rng.randrange(40)}" for tld in ("net", "com", "org") for lang in ("en", "de", "fr") for _ in range(15)})
    verdicts, known = dict(urls.RULES), {}
    for u in given:
        rule = brute_rule(u)[2]
        if rule:
            known[u] = verdicts[rule] == "block"
    read = lambda u: "^^" + re.sub("[^" + re.escape(urls.ALPHABET) + "]", "*", u.lower()) + "^"
    grams = lambda u: [read(u)[i : i + 3] for i in range(len(read(u)) - 2)]
    size = len(urls.ALPHABET) + 2
    counts = [{k: collections.Counter() for k in (1, 2, 3)} for _ in (0, 1)]
    for u, rejected in known.items():
        for g in grams(u):
            for k in (1, 2, 3):
                counts[rejected][k][g[3 - k :]] += 1
    seen = {k: set(counts[0][k]) | set(counts[1][k]) for k in (1, 2, 3)}

    def p(c, g):
        k = len(g)
        below = 1 / size if k == 1 else p(c, g[1:])
        near = {h: n for h, n in counts[c][k].items() if h[:-1] == g[:-1]}
        n, t = sum(near.values()), len(near)
        return (counts[c][k][g] + t * below) / (n + t) if n else below

    def score(u):
        out = []
        for g in grams(u):
            k = next((k for k in (3, 2, 1) if g[3 - k :] in seen[k]), 0)
            out.append(np.log(p(1, g[3 - k :])) - np.log(p(0, g[3 - k :])) if k else 0.0)
        return float(np.mean(out))

    of = {u: score(u) for u in given}
    low, high = ([of[u] for u in known if known[u] == r] for r in (False, True))
    bound = (np.mean(low) * np.std(high) + np.mean(high) * np.std(low)) / (np.std(low) + np.std(high))
    got = urls.judged(spark.createDataFrame(list(enumerate(given)), "page_id long, url string")).collect()
    for r in got:
        if r.url in known:
            assert r.score is None and r.verdict == ("block" if known[r.url] else "allow")
        else:
            assert r.score == pytest.approx(of[r.url], abs=1e-9) and (r.verdict == "block") == (of[r.url] >= bound)


def test_likeness_by_brute_force(spark):
    """Lanes, likeness and fingerprints of neighbours against sums over paragraphs."""
    texts = ["a b.\nc d\ne f", "c d\na b.", "x\ny\nz", "", "a b.\nc d\nq"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    hashed = {r.p: [r.h0, r.h1] for r in df.select(F.explode(fingerprint.paragraphs(F.col("text"))).alias("p")).select("p", F.xxhash64("p", F.lit(0)).alias("h0"), F.xxhash64("p", F.lit(1)).alias("h1")).collect()}
    parts = [[r for r in re.split(r"[\n]+|(?<=[.!?])\s+", t) if r.strip()] for t in texts]

    def signs(ps):
        """Of each lane the number of ones less that of zeros."""
        out = []
        for s in range(fingerprint.SEEDS):
            for shift in range(fingerprint.SHIFTS):
                for lane in range(fingerprint.PER_WORD):
                    bit = shift + fingerprint.WIDTH * lane
                    out.append(sum(2 * ((hashed[p][s] >> bit) & 1) - 1 for p in ps))
        return np.array(out, float)

    pairs = df.alias("a").join(df.alias("b"))
    got = pairs.select(F.col("a.doc_id").alias("i"), F.col("b.doc_id").alias("j"), fingerprint.likeness(fingerprint.fingerprint(F.col("a.text")), fingerprint.fingerprint(F.col("b.text"))).alias("x")).collect()
    for r in got:
        u, v = signs(parts[r.i]), signs(parts[r.j])
        size = np.sqrt((u @ u) * (v @ v))
        want = 1.0 if sorted(parts[r.i]) == sorted(parts[r.j]) else max(0.0, min(1.0, u @ v / size)) if size else 0.0
        assert r.x == pytest.approx(want), (r.i, r.j)


def test_large_components_and_elimination(spark):
    rows = [(i, [float(i % 7), 1e300 if i == 3 else 1.0]) for i in range(60)] + [(100, [-1e300, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), k=2).collect()}
    assert got[0, 1] == (3, (1 << 63) - 1) and got[50, 1] == (3, (1 << 63) - 1) and len(got) == 6
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8)) * 3
    near = [(i, (centres[i % 20] + rng.normal(size=8) * 0.05).tolist()) for i in range(6000)]
    df = spark.createDataFrame(near, "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 50 = 0")
    evaluated = spark.sparkContext.accumulator(0)
    topk.top_k(df, asked, k=5, evaluated=evaluated).count()
    share = evaluated.value / (asked.count() * 6000)
    print("evaluated", share)
    assert share < 0.9


def test_pipeline_stages_of_odd_rows(spark, tmp_path):
    """Null, empty, repeated and long texts, columns of clashing names, and no rows at all."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(3, 60)), "en", rng.choice(("a", "b", None)), 1) for i in range(40)]
    rows += [(50, None, None, "a", None), (51, "", "en", "b", 0), (52, "three words only", "en", "b", 16), (53, "three  words ONLY", "en", "b", 16), (54, prose(rng, 20_000), "en", "a", 9), (None, "no id", "en", "a", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    for name, given in (("some", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(given, schema).withColumn("_copies", F.lit(7)).write.parquet(str(folder / "documents.parquet"))
        (labels if given else labels.limit(0)).write.parquet(str(folder / "labels.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for step, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(folder))
            assert out.columns == docs.columns, step
            docs = out
        assert all(r.decodes for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(folder)).collect())
        if given:
            kept = {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, spark.read.parquet(str(folder / "documents.parquet")), str(folder)).collect()}
            assert 52 in kept and 53 not in kept and {50, 51, 54, None} <= kept
