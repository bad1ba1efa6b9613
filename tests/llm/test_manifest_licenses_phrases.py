"""Merkle manifest, licence rules and collocations against brute force, and on odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pitchflow.llm import op11_merkle, op12_licenses, op13_collocations
from pitchflow.llm.license_rules import DENIAL, rules

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _saved(df, folder):
    df.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


# --- manifest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, lowered=False):
    text = row.text.translate(LOWER) if lowered and row.text is not None else row.text
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)])


def _tree(nodes):
    """The root, and for each node what lies beside it and above, from below."""
    beside, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            run = nodes[place // 8 * 8 : place // 8 * 8 + 8]
            beside[k].append((run[: place % 8], run[place % 8 + 1 :]))
            at[k] = place // 8
        nodes = [_h(*nodes[a : a + 8]) for a in range(0, len(nodes), 8)]
    return nodes[0], beside


def _manifest(rows):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r.lang].append(r)
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        own = sorted(by_lang[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, _leaf(r)))
        trees[lang] = (own, *_tree([_leaf(r) for r in own]))
    root, above = _tree([trees[x][1] for x in order])
    for lang, up in zip(order, above):
        own, subroot, beside = trees[lang]
        for r, path in zip(own, beside):
            path = path + up
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            node = _leaf(r, tampered)
            for before, after in path:
                node = _h(*before, node, *after)
            yield r.doc_id, _leaf(r), subroot, root, _h(*[d for b, a in path for d in (*b, *a)]), node, node == root


def test_manifest_by_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, None if i % 17 == 0 else rng.choice("ab"), lang, i, rng.choice(["Some Text", "none", "", None])) for lang, n in (("en", 523), ("de", 64), (None, 9), ("é", 1), ("z", 8), *[(f"l{k:02}", 2) for k in range(9)]) for i in rng.sample(range(10_000), n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = Counter(map(tuple, op11_merkle.op11_merkle_manifest(spark, _saved(docs, tmp_path)).collect()))
    assert got == Counter(_manifest(docs.collect()))
    assert len({root for _, _, _, root, *_ in got}) == 1 and {v for *_, v in got} == {True, False}


def test_manifest_of_odd_rows(spark, odd, clashing, empty, tmp_path):
    expected = Counter(_manifest(odd.collect()))
    for name, docs in (("odd", odd), ("clashing", clashing)):
        assert Counter(map(tuple, op11_merkle.op11_merkle_manifest(spark, _saved(docs, tmp_path / name)).collect())) == expected
    assert op11_merkle.op11_merkle_manifest(spark, _saved(empty, tmp_path / "empty")).count() == 0
    one = spark.createDataFrame([(5, None, None, None, None)], odd.select("doc_id", "text", "lang", "source", "n_chars").schema)
    (row,) = op11_merkle.op11_merkle_manifest(spark, _saved(one, tmp_path / "one")).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == _h() and row.verified == (row.folded_root == row.leaf)


def test_some_requests_descend(spark):
    """Proofs of a few leaves alone, and a record for equal runs."""
    leaves = spark.range(600).select(F.lit("g").alias("grp"), F.col("id").alias("rank"), op11_merkle.height(F.lit(600)).alias("height"), F.sha2((F.col("id") % 8).cast("string"), 256).alias("digest"))
    tree = op11_merkle.grow(leaves)
    assert tree.records[0].count() == 1  # all runs of eight are equal
    starts = tree.roots.select("grp", "digest", "height", F.array().cast(op11_merkle._PATH).alias("path"))
    asked = leaves.filter("rank in (0, 77, 599)")
    root, beside = _tree([_h(str(k % 8)) for k in range(600)])
    for r in op11_merkle.descend(tree, starts, asked).withColumn("root", op11_merkle.folded(F.col("digest"), F.col("proof"))).collect():
        assert r.root == root and [(s.before, s.after) for s in r.proof] == [("".join(b), "".join(a)) for b, a in beside[r.rank]]


@pytest.mark.parametrize("n, levels", [(1, 0), (2, 1), (8, 1), (9, 2), (64, 2), (65, 3), (512, 3), (513, 4), (8**9, 9), (8**9 + 1, 10)])
def test_height(spark, n, levels):
    assert spark.range(1).select(op11_merkle.height(F.lit(n)).alias("h")).first().h == levels


# --- licences


def _normal(text):
    return " " + re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", (text or "").translate(LOWER)).strip(" ") + " "


def _detected(text, ordered, gated=True):
    norm, found = _normal(text), []
    for place, r in enumerate(ordered):
        if gated and f" {r.keyword} " not in norm:
            continue
        for m in re.finditer(rf"(?<= )(?:{r.pattern})(?= )", norm):
            first = norm[: m.start()].count(" ") - 1
            found.append((first, first + m.group().count(" "), r.tier, place, r.label, r.base))
    found.sort(key=lambda x: (x[0], -x[1], x[2], x[3]))
    inside = lambda i, x: any(y[1] >= x[1] and y[2] <= x[2] for y in found[:i])
    return [(*x, not inside(i, x)) for i, x in enumerate(found)]


def _texts():
    rng = random.Random(12)
    parts = ["MIT License", "the Apache License, Version 2.0", "GNU Lesser General Public License v2.1 or later", "GPL-3.0", "licensed under", "CC BY-NC 4.0", "not released under the", "SPDX-License-Identifier:", "BSD 3-Clause", "word", "unter mit", "Mozilla Public License 2.0", "Creative Commons Attribution-ShareAlike 3.0 Unported", "general public license", "the", "(", "\n", "licence", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"]
    return ["", None, " ..", "É" * 3] + [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(300)]


def test_licenses_by_brute_force(spark):
    ordered, texts = rules(), _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in op12_licenses.detect(docs).collect():
        assert [tuple(d) for d in r.detections] == _detected(texts[r.doc_id], ordered), texts[r.doc_id]
        # the gate saves work and loses nothing
        assert [(d.first, d.last, d.label) for d in r.detections if d.kept] == [(d[0], d[1], d[4]) for d in _detected(texts[r.doc_id], ordered, gated=False) if d[-1]]
        assert r.n_words == len(_normal(texts[r.doc_id]).split())


def test_license_query_by_hand(spark, tmp_path):
    rows = {
        1: ("Some words.\nLicensed under the Apache License, Version 2.0.", (10, 1, 5, 5, "apache", "apache,apache-2.0", 0.95)),
        2: ("This work is licensed under the GNU General Public License, version 3.", (12, 1, 7, 7, "gpl", "gpl,gpl-3.0", 0.95)),
        3: ("Licensed under CC BY-NC 4.0.", (7, 0, None, None, "", "cc-by-nc-4.0", 0.95)),
        4: ("It is not released under the MIT License at all", (10, 1, 6, 6, "mit", "mit", 0.0)),
        5: ("MIT License, mit/license. mit", (5, 2, 0, 2, "mit", "mit", 0.6)),
        6: ("Er kommt mit Lizenz und Apache, general public", (8, 0, None, None, "", "", 0.0)),
        7: (None, (0, 0, None, None, "", "", 0.0)),
        8: ("SPDX-License-Identifier: LGPL-2.1", (6, 0, None, None, "", "lgpl-2.1", 1.0)),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _) in rows.items()], "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in op12_licenses.op12_license_rules(spark, _saved(docs, tmp_path)).collect()}
    assert got == {k: v for k, (_, v) in rows.items()}


def test_every_rule_needs_its_keyword():
    """A rule finds the words that its own label or name is made of, and names its keyword in its pattern."""
    ordered = rules()
    assert len(ordered) > 300 and len({r.pattern + r.keyword for r in ordered}) == len(ordered)
    for r in ordered:
        plain = r.pattern.replace("licen[cs]e", "license licence")
        assert r.keyword in re.findall(r"[a-z0-9]+", plain), r
    assert [r.tier for r in ordered if r.label == ""] == [DENIAL]
    assert [(r.label, r.pattern) for r in ordered if r.base] == [("apache", "apache license"), ("mit", "mit license"), ("gpl", "general public license")]


def test_licenses_of_odd_rows(spark, odd, clashing, empty, tmp_path):
    expected = Counter(map(tuple, op12_licenses.op12_license_rules(spark, _saved(odd, tmp_path / "odd")).collect()))
    assert sum(expected.values()) == 11
    assert Counter(map(tuple, op12_licenses.op12_license_rules(spark, _saved(clashing, tmp_path / "clashing")).collect())) == expected
    assert op12_licenses.op12_license_rules(spark, _saved(empty, tmp_path / "empty")).count() == 0
    assert set(odd.columns) < set(op12_licenses.detect(odd).columns)
    many = spark.createDataFrame([(1, "the MIT License or so " * 20_000)], "doc_id long, text string").select("*").first()
    found = op12_licenses.detect(spark.createDataFrame([many])).first()
    assert sum(d.base for d in found.detections) == 20_000 and found.n_words == 100_000


# --- phrases


def _pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def _collocations(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for ws in _pieces(text):
            n[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = {(lang, ws[i : i + m]) for (lang, ws), a in cands.items() for m in range(2, len(ws)) for i in range(len(ws) - m + 1) if 100 * a >= 100 * f[lang, ws[i : i + m]]}
    out = defaultdict(list)
    for (lang, ws), a in cands.items():
        if (lang, ws) not in gone:
            score, k = min((1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws)))
            out[lang].append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return {(lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)}


def _corpus():
    rng = random.Random(13)
    vocabulary = [f"{'Wxé'[k % 3]}{k}" for k in range(30)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" "] * 12 + [". ", ", ", "\n", "\t ", "\x0b"]) for _ in range(n))
    shared = text(400)
    rows = [(rng.choice(["en", "en", "de", None, "und"]), shared + text(rng.randint(0, 300))) for _ in range(40)]
    return rows + [("en", None), ("en", ""), ("en", "\n. ,"), (None, "la " * 3_000), ("en", " ".join(rng.choice(["a", "b"]) for _ in range(5_000)))]


def test_collocations_by_brute_force(spark):
    rows = _corpus()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for least, top in ((3, 10_000), (30, 20)):
        got = {tuple(r) for r in op13_collocations.collocations(docs, top, least).collect()}
        assert got == _collocations(rows, least, top)


def _whole(ws):
    return "." not in ws


def test_chunks_hold_every_phrase_once():
    texts = [t for _, t in _corpus()]
    want = Counter(tuple(ws[i : i + k]) for t in texts for ws in _pieces(t) for k in range(1, 6) for i in range(len(ws) - k + 1))
    _, chunks, own, words = op13_collocations.parse(pa.array(texts))
    split = [c.split(" ") for c in chunks.to_pylist()]
    got = Counter(tuple(ws[i : i + k]) for ws, n in zip(split, own.tolist()) for k in range(1, 6) for i in range(min(n, len(ws) - k + 1)) if _whole(ws[i : i + k]))
    assert got == want
    assert words.tolist() == [sum(w != "." for w in ws[:n]) for ws, n in zip(split, own.tolist())]
    assert max(own) <= op13_collocations.FAR and max(map(len, split)) <= op13_collocations.FAR + 4
    # what follows a trigger is cut alike, whatever came before
    first, second = (op13_collocations.parse(pa.array([t]))[1].to_pylist() for t in (texts[0], "And else " + texts[0]))
    assert len(set(first) - set(second)) <= 1


def test_marks_lose_nothing(spark):
    frequent = spark.range(3_000).select(F.lit("en").alias("lang"), F.concat_ws(" ", F.lit("a"), F.col("id").cast("string")).alias("phrase"))
    marks = op13_collocations.marks(frequent, 2)
    phrases = [r.phrase for r in frequent.collect()]
    flat = pa.array([w for p in phrases for w in p.split(" ")])
    hashes = lambda lang: op13_collocations.phrase_hashes(flat, pa.RecordBatch.from_pydict({"lang": [lang] * len(phrases), "chunk": phrases}), 2)[-1][::2]
    assert marks.has(hashes("en")).all()
    assert marks.has(hashes("de")).mean() < 0.2 and len(marks.words) * 64 <= 2 * 16 * 3_000


def test_collocations_of_odd_rows(spark, odd, clashing, empty, tmp_path):
    expected = _collocations([(r.lang, r.text) for r in odd.collect()], 100, 2000)
    for name, docs in (("odd", odd), ("clashing", clashing)):
        assert {tuple(r) for r in op13_collocations.op13_phrase_collocations(spark, _saved(docs, tmp_path / name)).collect()} == expected
    assert op13_collocations.op13_phrase_collocations(spark, _saved(empty, tmp_path / "empty")).count() == 0
