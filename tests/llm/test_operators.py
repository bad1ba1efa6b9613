"""Each training-data operator against a brute-force version, and on odd and empty inputs."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

import corpus_pipeline
from pitchflow.llm import op1_kdtree, op2_toxicity, op3_language, op4_tokens, op5_simhash, op6_packing, op7_lines, op8_rans, op9_mixing, op10_quality, registry, shingles
from pitchflow.llm.common import table
from pitchflow.llm import tokens
from pitchflow.llm.tokens import BYTE_BPE, WORD_BPE, UnitTokenizer, unit_tokenizer, vocabulary

SMALL = "/root/testdata/sf0.001"
TRICKY = ["", " ", "  a  b \n\n c'll don't 'tis 're' <|endoftext|> x<|endoftext|>y <|startoftext|>", "x 　\xa0y \x85 z", "a" * 3000, "-" * 700, " " * 300, "12 345 6", "''s 'S It'S it's 'l 'r", "é́ Σ ΑΣ İ 漢字😀", "tail \n", "\n\n lead"]


def texts(name="documents"):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/{name}.parquet'").fetchall())


def ids_of(name, values):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(vocabulary(name)).encode_batch(values, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- top-k search


def brute_top(vectors, k, every):
    out = set()
    for q, a in vectors:
        if q % every == 0:
            scored = sorted(((-int(np.dot(a, b)), i) for i, b in vectors if i != q))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.integers(-3, 4, 6).tolist()) for i in range(500)]  # many ties
    df = spark.createDataFrame(vectors, "vec_id long, vector array<long>")
    for shard in (40, 10_000):
        found = op1_kdtree.top_k(df, df.filter("vec_id % 20 = 0"), k=5, shard=shard, group=10)
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()} == brute_top(vectors, 5, 20)


def test_top_k_odd(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.5], 1), (1, [0.001, 2.0], 1), (1, [0.001, 2.0], 1), (2, None, 1), (3, [], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (None, [1.0, 1.0], 1), (50, [1.0, 1.0], None), (100, [1.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {(r.query_id, r.rank, r.vec_id, r.score) for r in op1_kdtree.op1_kdtree_topk(spark, str(tmp_path)).collect()}
    v = {0: (256, -128), 1: (0, 512), 50: (256, 256)}
    want = set()
    for q in (0, 50):
        best = sorted((-(v[q][0] * b[0] + v[q][1] * b[1]), i) for i, b in v.items() if i != q)
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert found == want


# --- tokens


def test_token_counts(spark):
    values = TRICKY + list(texts().values())
    assert op4_tokens.count_tokens(values).tolist() == [len(x) for x in ids_of(BYTE_BPE, values)]


def test_token_windows(monkeypatch):
    values = [" ".join(texts().values()), "a b" * 900]
    monkeypatch.setattr(op4_tokens, "WINDOW", 500)
    assert op4_tokens.count_tokens(values).tolist() == [len(x) for x in ids_of(BYTE_BPE, values)]


def test_states_start_anew(monkeypatch):
    values = list(texts().values())
    monkeypatch.setattr(op4_tokens, "STATES", 500)
    monkeypatch.setattr(op4_tokens, "WINDOW", 5_000)
    assert op4_tokens.count_tokens(values).tolist() == [len(x) for x in ids_of(BYTE_BPE, values)]


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_units(name):
    values = TRICKY + list(texts().values())
    got = [x.tolist() for x in unit_tokenizer(name).encode(v.encode() for v in values)]
    assert got == ids_of(name, values)


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_units_share_a_table(name):
    """Random texts of characters that normalizers lengthen, shorten, drop and join, through one small table."""
    rng = np.random.default_rng(21)
    alphabet = [*"ab cD.,'!? \n\t\r\x0b\x0c", *"\u0130\x85\x1c\x1d\x1e\x1f\xa0\u0301\u00e9\u00c9\u00df\u00ff\u03a3\u03c2\u6f22\U0001f600\u3000\u2003\u200b\u180e\u2019\u201c\u00b5\u212a\u1e9e\ufb01\u00d7\u00f7\u00aa<>|", "'s", "'re", " the", "Hello", "12", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\n\n", "  ", "$$$", "foo\x85", "</w>", "/w"]
    values = ["\u0130\x85 \u0130", "\u0130\x85", *("".join(alphabet[i] for i in rng.integers(0, len(alphabet), int(rng.integers(0, 14)))) for _ in range(20_000))]
    got = [x.tolist() for x in UnitTokenizer(name, limit=3000).encode(v.encode() for v in values)]
    assert got == ids_of(name, values)


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_tokens_are_their_own_encoding(name):
    """The merges in both libraries agree where every token is what its own text encodes to."""
    model = UnitTokenizer(name)
    byte = tokens._bytes_of_characters()
    special = set(model.model.get_added_tokens_decoder())
    for token, i in model.model.get_vocab().items():
        end = token.endswith("</w>") and model.by_word
        raw = bytes(byte[c] for c in (token[:-4] if end else token)) + (b"\0" if end else b"")
        assert i in special or model.quick._core_bpe.encode_single_piece(raw) == [i]
    assert model.closes.sum() == sum(t.endswith("</w>") for t in model.model.get_vocab()) * model.by_word


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_short_characters(name):
    """Random texts of characters below U+0100 alone, by the quick way."""
    rng = np.random.default_rng(30)
    alphabet = [*map(chr, range(256)), *" \n'aeé" * 12]
    values = ["".join(alphabet[i] for i in rng.integers(0, len(alphabet), int(rng.integers(0, 20)))) for _ in range(20_000)]
    assert [x.tolist() for x in UnitTokenizer(name).encode(v.encode() for v in values)] == ids_of(name, values)


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_units_in_windows(name, monkeypatch):
    monkeypatch.setattr(tokens, "WINDOW", 700)
    monkeypatch.setattr(tokens, "JOINED", 5)
    values = [" ".join(texts().values()), "a  b" * 900, "a b\n" * 900, *TRICKY]
    assert [x.tolist() for x in UnitTokenizer(name).encode(v.encode() for v in values)] == ids_of(name, values)


def test_counts_odd(odd, empty):
    got = {r.doc_id: r for r in op4_tokens.with_token_counts(odd).collect()}
    assert (got[2].n_bytes, got[2].n_tokens, got[2].over_limit) == (0, 0, False)
    assert got[4].over_limit and got[5].n_bytes == 50_000
    assert op4_tokens.with_token_counts(odd).count() == odd.count()
    assert op4_tokens.with_token_counts(empty).count() == 0


# --- near duplicates


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, most=4):
    keys = sorted(fps)
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array([fps[k] for k in keys], dtype=np.uint64)
    for i, k in enumerate(keys):
        for j in np.nonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= most)[0]:
            a, b = find(k), find(keys[i + 1 + int(j)])
            parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_simhash(spark):
    docs = texts()
    fps = {k: brute_fingerprint(v) for k, v in docs.items()}
    roots = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash.op5_simhash_anchor(spark, SMALL).collect()}
    assert got == {k: (f"{fps[k]:016x}", roots[k]) for k in docs}


def test_links_lose_none(spark):
    """Chains and dense clusters of fingerprints, in blocks so small that every anchor is cut."""
    rng = np.random.default_rng(5)
    fps = {}
    for c in range(40):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(15):
            fps[len(fps)] = x
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(b)
    unique = {}
    for k, v in fps.items():
        unique.setdefault(v, k)
    own = {k: v for v, k in unique.items()}
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, k) for k, v in own.items()], "fp long, node long")
    roots = {r.node: r.root for r in op5_simhash.components(op5_simhash.links(nodes, side=3)).collect()}
    assert {k: roots.get(k, k) for k in own} == brute_components(own)


def test_every_value_has_an_anchor():
    lists, counts = op5_simhash._anchors()
    assert ((lists[:, 0] >= 0) & (np.bitwise_count(np.maximum(lists[:, 0], 0).astype(np.uint64)) <= 3)).all()
    assert counts.sum() == sum(math.comb(23, w) for w in range(5))


def test_keep_one(odd, empty):
    kept = op5_simhash.keep_one(odd)
    ids = [r.doc_id for r in kept.collect()]
    assert None in ids and kept.columns == odd.columns
    assert sorted(i for i in ids if i is not None) == [0, 2, 4, 5, 7, 8]  # 1 copies 0; 3 and 6 have no words, as 2
    again = kept.filter("doc_id in (0, 5)").union(kept.filter("doc_id = 5"))
    assert sorted(r.doc_id for r in op5_simhash.keep_one(again).collect()) == [0, 5]
    assert op5_simhash.keep_one(empty).count() == 0
    assert op5_simhash.near_duplicates(odd).count() == odd.count()


def brute_near_copies(docs, least=0.8):
    def own(text):
        words = (text or "").encode().lower().split()
        return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {k: own(v) for k, v in docs.items()}
    root = {k: k for k in docs}
    for a in docs:
        for b in docs:
            if a < b and root[a] != root[b] and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


def test_near_copies(spark):
    """Chains of edits around and below the limit, and one group so large that its blocks are cut."""
    rng = np.random.default_rng(11)
    docs = {}
    for c in range(25):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(3, 150)))]
        for _ in range(6):
            docs[len(docs)] = " ".join(words)
            for k in rng.choice(len(words), int(rng.integers(1, 4)), replace=False):
                words[k] = f"v{rng.integers(0, 5000)}"
    hub = [f"h{x}" for x in range(100)]
    for k in range(40):
        docs[len(docs)] = " ".join([*hub[:k], f"other{k}", *hub[k + 1 :]])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for side in (7, 1024):
        assert dict(shingles.near_copies(df, side).collect()) == brute_near_copies(docs)


def test_near_copies_by_anchors(spark):
    """Near copies that agree in no band are found by op5's anchors, and still held against the rule."""
    words = [f"w{k}" for k in range(2000)]
    texts = [" ".join(words), " ".join([*words[:900], "changed", *words[901:]]), " ".join(f"x{k}" for k in range(2000))]
    sets = [shingles.shingles(t.encode()) for t in texts]
    fps = [op5_simhash.simhash(t.encode()) for t in texts]
    assert 0 < (fps[0] ^ fps[1]).bit_count() <= 4
    fps[2] = fps[0] ^ 1  # near by its fingerprint only
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(shingles.set_key(s)), k, [k], signed(f)) for k, (s, f) in enumerate(zip(sets, fps))], "key long, node long, bands array<long>, fp long")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len({r.component for r in shingles.anchored(nodes).collect()}) == 1 and shingles.anchored(nodes).count() == 3
    assert [sorted(r) for r in shingles.links(docs, nodes).collect()] == [[0, 1]]


def test_stage_drops_near_copies(spark, odd, empty):
    words = [f"word{x}" for x in range(60)]
    docs = [(k, " ".join([*words[:at], "changed", *words[at + 1 :]])) for k, at in enumerate((0, 20, 30, 40))]  # 0.82 and more to the first
    docs += [(10, " ".join([*words[:10], "a", *words[11:25], "b", *words[26:45], "c", *words[46:]]))]  # below 0.8 to all
    docs += [(11, None), (12, " "), (None, " ".join(words))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SMALL).collect()} == {0, 10, 11, None}
    ids = [r.doc_id for r in shingles.keep_one(odd).collect()]
    assert None in ids and sorted(i for i in ids if i is not None) == [0, 2, 4, 5, 7, 8]
    assert shingles.keep_one(empty).count() == 0


# --- packing


def check_pieces(rows, ids):
    length, places = Counter(), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        assert crc(own[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] and r["doc_tokens"] == len(own) and r["length"] > 0
        length[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= op6_packing.LENGTH
    return length, len(places)


def test_packing(spark):
    docs = texts()
    ids = {k: [*x, 1] for k, x in zip(docs, ids_of(BYTE_BPE, list(docs.values())))}
    length, sequences = check_pieces(rows_of(op6_packing.op6_hilbert_packing(spark, SMALL)), ids)
    assert length == {k: len(v) for k, v in ids.items()}
    assert sum(length.values()) > 0.98 * (sequences - 1) * op6_packing.LENGTH


def test_piece_sums():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 16, 17, 2048, 5000, 15, 33])
    ids = rng.integers(0, 1 << 16, int(sizes.sum())).astype("<u2")
    sums, blocks = op6_packing.block_sums(ids, sizes)
    base, begin = np.cumsum(blocks) - blocks, np.cumsum(sizes) - sizes
    pieces = [(0, 0, 1), (1, 0, 16), (2, 0, 17), (2, 16, 1), (3, 0, 2048), (3, 32, 160), (4, 2048, 2048), (4, 4096, 904), (5, 0, 15), (6, 16, 17)]
    got = op6_packing.piece_sums(sums, np.array([base[d] + at // 16 for d, at, _ in pieces]), np.array([n for _, _, n in pieces]))
    assert got.tolist() == [crc(ids[begin[d] + at : begin[d] + at + n]) for d, at, n in pieces]
    assert op6_packing.piece_sums(sums, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)).tolist() == []


def test_packing_odd(odd, empty):
    rows = rows_of(op6_packing.pack(odd))
    own = {r.doc_id: r.text or "" for r in odd.collect()}
    ids = {k: [*x, 1] for k, x in zip(own, ids_of(BYTE_BPE, list(own.values())))}
    length, _ = check_pieces(rows, ids)
    assert length[2] == 1 and length[1] == 2 * len(ids[1]) and length[4] == len(ids[4])
    assert op6_packing.pack(empty).count() == 0


def test_hilbert_is_a_curve():
    side = 8
    points = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    keys = op6_packing.hilbert(points, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    ordered = points[np.argsort(keys)]
    assert (np.abs(np.diff(ordered, axis=0)).sum(axis=1) == 1).all()


# --- files of ids


def test_rans_round_trip():
    rng = np.random.default_rng(8)
    for n in (1, 63, 64, 65, op8_rans.BLOCK, op8_rans.BLOCK * 2 + 7):
        docs = np.array_split(rng.zipf(1.3, n) % 49_408, min(n, 5))
        docs = [d.astype(np.uint16) for d in docs]
        raw = op8_rans.pack_segment(list(range(len(docs))), docs)
        names, sizes, ids = op8_rans.unpack_segment(raw)
        assert ids.tolist() == np.concatenate(docs).tolist() and sizes.tolist() == [len(d) for d in docs] and names.tolist() == list(range(len(docs)))
    same = [np.full(5000, 7, dtype=np.uint16)]
    assert op8_rans.unpack_segment(op8_rans.pack_segment([3], same))[2].tolist() == [7] * 5000


def test_rans_checksum():
    raw = bytearray(op8_rans.pack_segment([1], [np.arange(1000, dtype=np.uint16)]))
    raw[-3] ^= 255
    with pytest.raises(ValueError):
        op8_rans.unpack_segment(bytes(raw))


def test_rans_table(spark, monkeypatch):
    docs = texts()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op8_rans.op8_rans_ids(spark, SMALL).collect()}
    at, want = 0, {}
    for k in sorted(docs):
        ids = [*ids_of(WORD_BPE, [docs[k]])[0], 2]
        want[k] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == want


def test_rans_odd(odd, empty):
    rows = rows_of(op8_rans.read_ids(op8_rans.write_ids(odd)))
    assert len(rows) == odd.count() and sum(r["doc_id"] is None for r in rows) == 1
    rows.sort(key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])[:-1]]).tolist()
    assert op8_rans.read_ids(op8_rans.write_ids(empty)).count() == 0


# --- lines


def test_boilerplate(spark):
    line = "these five words are boilerplate"
    rows = [(i, f"unique line number {i} of this document here\n{line}\nshort one", f"site{i % 6}") for i in range(12)]
    rows += [(20 + i, "a line on four sites only here\nyes", f"site{i % 4}") for i in range(12)]
    rows += [(40, None, "site1"), (41, "", None), (None, line, "site9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in op7_lines.remove_boilerplate(docs).collect()}
    assert line in out[0].text and all(line not in out[i].text and out[i].n_removed == 1 for i in range(1, 12))
    assert all(out[20 + i].n_removed == 0 for i in range(12)) and out[None].text == line
    assert out[40].text is None and out[41].text == "" and "short one" in out[5].text


def test_lines_odd(odd, empty):
    out = op7_lines.remove_boilerplate(odd)
    assert out.count() == odd.count() and out.columns == [*odd.columns, "n_lines", "n_removed"]
    assert op7_lines.remove_boilerplate(empty).count() == 0


def test_stage_removes_short_lines(spark):
    """Short lines on half of ten sites or more go, with scripts without spaces; those on fewer, and blank lines, stay."""
    rows = [(i, f"own line of document number {i}\nAll rights reserved.\n\n版权所有保留一切权利" + ("\nFour sites only." if i < 4 else ""), f"site{i % 10}") for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, SMALL).collect()}
    assert out[0] == rows[0][1] and len(out) == 20
    assert all(out[i] == f"own line of document number {i}\n" + ("\nFour sites only." if i < 4 else "") for i in range(1, 20))
    assert all(r.n_removed == 0 for r in op7_lines.remove_boilerplate(docs).collect())  # the query's own rule


# --- mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3.0 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def test_mix(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "w " * int(rng.integers(0, 60)), None if i % 11 == 0 else f"s{int(rng.integers(0, 3) * rng.integers(0, 4))}") for i in range(900)]
    rows += [(2000 + i, "many equal words here", "hot") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = rows_of(op9_mixing.mix(docs))
    sizes, source = {}, {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
        source[i] = s
    want, taken = brute_targets(sizes), Counter()
    for r in found:
        s = source[r["doc_id"]]
        assert math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-6) and r["source_size"] == sizes[s] and 0 <= r["copies"] <= 3
        taken[s] += r["size"] * r["copies"]
    assert all(abs(taken[s] - want[s]) <= 4 for s in sizes)
    assert sorted(map(str, found)) == sorted(map(str, rows_of(op9_mixing.mix(docs))))


def test_fit_budget():
    rng = np.random.default_rng(2)
    for _ in range(50):
        sizes = sorted(set(rng.integers(1, 40, 6).tolist()))
        counts = rng.integers(0, 5, len(sizes)).tolist()
        total = sum(s * n for s, n in zip(sizes, counts))
        budget = int(rng.integers(0, total + 5))
        take = op9_mixing.fit_budget(sizes, counts, budget)
        got = sum(s * k for s, k in zip(sizes, take))
        assert all(0 <= k <= n for k, n in zip(take, counts)) and got <= budget
        assert got >= min(budget, total) - max(sizes)


def test_mixed_rows(odd, empty):
    out = op9_mixing.mixed_rows(odd)
    copies = Counter()
    for r in rows_of(op9_mixing.mix(odd)):
        copies[r["doc_id"]] += r["copies"]
    assert Counter(r.doc_id for r in out.collect()) == +copies and out.columns == odd.columns
    assert op9_mixing.mixed_rows(empty).count() == 0 and op9_mixing.mix(empty).count() == 0


# --- quality


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in op10_quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, odd, empty):
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for docs in (odd, table(spark, SMALL, "documents")):
        want = sorted((str(r.doc_id), *brute_statistics(r.text)) for r in docs.select("doc_id", "text").collect())
        assert sorted((str(r[0]), *r[1:]) for r in op10_quality.judged(docs, []).select("doc_id", *own).collect()) == want
    assert op10_quality.judged(empty, []).count() == 0


def test_rules_follow_labels(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    rules = op10_quality.fit(docs, labels)
    known = dict(labels.select("doc_id", "quality").collect())
    kept = {r.doc_id: (r.base_failed, r.kept) for r in op10_quality.judged(docs, rules).collect()}
    own = [(known[k], kept[k][1]) for k in known if not kept[k][0]]
    assert all(not v for b, v in kept.values() if b)
    assert sum(bool(q) == v for q, v in own) >= 0.9 * len(own)
    assert op10_quality.fit(docs, labels.filter("doc_id < 0")) == []


# --- language


def test_language(spark, odd, empty):
    docs = table(spark, SMALL, "documents")
    truth = dict(docs.select("doc_id", "lang").collect())
    out = op3_language.identify(docs).collect()
    own = [r for r in out if r.held_out]
    assert len(out) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang_pred == truth[r.doc_id] for r in own) >= 0.95 * len(own) and all(0 <= r.score <= 1 for r in out)
    found = {r.doc_id: r.lang_pred for r in op3_language.identify(odd).collect()}
    assert found[2] == found[3] == found[6] == found[8] == "und" and found[4] != "und"
    assert op3_language.identify(empty).count() == 0
    kept = op3_language.keep_identified(odd)
    assert kept.columns == odd.columns and {2, 3, 6, 8}.isdisjoint(r.doc_id for r in kept.collect())


def brute_language(labelled, values, seen):
    """Every count by hand, and every text's score."""
    counts = defaultdict(lambda: defaultdict(Counter))
    for text, lang in labelled:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            counts[lang][0][w] += 1
            m = f"^{w}$"
            for k in (4, 3, 2, 1):
                for i in range(max(1, len(m) - k + 1)):
                    counts[lang][k][m[i : i + k]] += 1
    langs = sorted(x for x in counts if any(n >= seen for c in counts[x].values() for n in c.values()))
    known = {k: {x for lang in langs for x, n in counts[lang][k].items() if n >= seen} for k in range(5)}

    def value(k, item, lang):
        own = [n for n in counts[lang][k].values() if n >= seen]
        total = sum(counts[lang][k].values()) if own else 1.0
        n = counts[lang][k][item]
        return math.log((n if n >= seen else 0) + 0.5) - math.log(total + len(known[k]) * 0.5)

    def word(w, lang):
        if w in known[0]:
            return value(0, w, lang)
        m = f"^{w}$"
        for k in (4, 3, 2, 1):
            own = [value(k, g, lang) for i in range(len(m) - k + 1) if (g := m[i : i + k]) in known[k]]
            if own:
                return sum(own) / len(own)
        return 0.0

    out = []
    for text in values:
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not words or not langs:
            out.append(("und", 0.0))
            continue
        mean = [sum(word(w, lang) for w in words) / len(words) for lang in langs]
        best = max(range(len(langs)), key=lambda i: (mean[i], -i))
        out.append((langs[best], 1 / sum(math.exp(x - mean[best]) for x in mean)))
    return out


def test_language_by_brute_force(spark, odd):
    docs = table(spark, SMALL, "documents").filter("length(text) < 3000").limit(60).select("doc_id", "text", "lang").unionByName(odd.filter("doc_id <> 4").select("doc_id", "text", "lang"))
    rows = docs.collect()
    model = op3_language.fit(docs, seen=3)
    want = brute_language([(r.text, r.lang) for r in rows if r.text and r.lang], [r.text for r in rows], 3)
    got = [op3_language.Scorer(model).predict(r.text) for r in rows]
    assert [g[0] for g in got] == [w[0] for w in want] and all(math.isclose(g[1], w[1], rel_tol=1e-9) for g, w in zip(got, want))


def test_stage_drops_mixed_texts(spark):
    docs = table(spark, SMALL, "documents")
    en, de, fr, es = ([r.text for r in docs.filter(f"lang = '{x}' and length(text) between 400 and 5000").limit(3).collect()] for x in ("en", "de", "fr", "es"))
    parts = [" ".join(x.split()[:60]) for x in (en[0], de[0], fr[0], es[0])]
    mixed = spark.createDataFrame([(10_000_000, "\n".join(parts), "en", "a", 1), (10_000_001, en[1], "en", "a", 1)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(mixed), SMALL).collect()}
    assert 10_000_000 not in kept and 10_000_001 in kept


# --- toxicity


def brute_clauses(text, kinds):
    """The grammar by its rules, clause by clause, without any transducer. kinds: word -> symbol."""
    found = []
    for sentence in re.split(r"[.!?;\n]+", text.lower()):
        tokens = [t if t[0].isalpha() else "quote" for t in re.findall(r"[^\W\d_]+(?:'t\b)?|[:\"]", sentence)]
        kind = [t if t == "quote" else kinds.get(t) for t in tokens]
        kind = [k for k in kind if k]
        # reported speech: behind a verb of saying, or before one behind a quotation mark; where else a mark stands, a clause ends
        clauses, own, verb, quoted, negated = [], [], False, False, False
        for k in kind:
            if k == "negation":
                negated = True
            elif k == "report":
                if own and any(x[0] in op2_toxicity.SAID for x in own) and not verb:
                    own.append(("back", "reported"))
                    if quoted:
                        clauses.append(own)
                        own = []
                verb, quoted = True, False
            elif k == "quote":
                if verb:
                    continue
                if own and any(x[0] in op2_toxicity.SAID for x in own):
                    quoted = True
                elif not quoted:
                    clauses.append(own)
                    own = []
            elif k in op2_toxicity.SAID:
                if quoted:
                    clauses.append(own)
                    own, quoted = [], False
                own.append((k, *(["negated"] if negated else []), *(["reported"] if verb else [])))
            elif not quoted:
                own.append((k,))
        clauses.append(own)
        for own in clauses:
            aims = [i for i, x in enumerate(own) if x[0] == "target"]
            said, graver = [], False
            for i, x in enumerate(own):
                if x[0] in op2_toxicity.SAID:
                    before = any(a < i for a in aims)
                    # a target behind what was said means it if none stood before the first thing said
                    aimed = before
                    name = x[0]
                    if name in ("slight", "slur"):
                        name, graver = ("slur" if name == "slight" else "insult") if graver else name, True
                    said.append([i, name, aimed, set(x[1:])])
            if not said:
                continue
            yield_back = [i for i, x in enumerate(own) if x == ("back", "reported")]
            late = bool([a for a in aims if a > said[0][0]]) and not any(a < said[0][0] for a in aims)
            kept = []
            for i, name, aimed, how in said:
                if name == "threat" and not aimed and not (late and any(a > i for a in aims)):
                    continue
                kept.append((i, name, aimed, how))
            if kept:
                found.append((max((k[1] for k in kept), key=op2_toxicity.SAID.index), any(k[2] for k in kept) or late, kept, yield_back))
    return found


def test_composition():
    """A composed transducer writes what its parts write one after another, on random symbols."""
    rng = np.random.default_rng(6)
    alphabet = [*((s,) for s in op2_toxicity.SAID), *"abc"]
    one = op2_toxicity.Transducer(0, lambda s, x: ((s + 1) % 3, (x, "a") if s == 1 and x != "b" else (x,)), alphabet)
    two = op2_toxicity.Transducer("", lambda s, x: (x if x in ("a", "b") else s, () if x == s else (x, "c") if x == "a" else (x,)), sorted(one.writes(), key=str))
    both = op2_toxicity.compose(one, two)
    for _ in range(200):
        text = [alphabet[i] for i in rng.integers(0, len(alphabet), 12)]
        assert both.run(text)[1] == two.run(one.run(text)[1])[1]


def test_grammar():
    g = op2_toxicity.Grammar({"idiot": op2_toxicity.INSULT, "fool": op2_toxicity.SLIGHT, "nasty": op2_toxicity.SLUR})
    for text, want in {
        "You idiot.": [("insult", "aimed", "plain")],
        "That is not an idiot!": [("insult", "", "negated")],
        "She said he was an idiot.": [("insult", "aimed", "reported")],
        "He said: \"you idiot\".": [("insult", "aimed", "reported")],
        "\"You idiot\", he said.": [("insult", "aimed", "reported")],
        "A fool.": [("slight", "", "plain")],
        "fool, foolish fools": [("slur", "", "plain")],
        "nasty, nasty": [("insult", "", "plain")],
        "idiots, all of you": [("insult", "aimed", "plain")],
        "I will kill you": [("threat", "aimed", "plain")],
        "Ich töte dich. Je te tuerai. Voy a matarte, matará a ellos": [("threat", "aimed", "plain")] * 3,
        "They hurt him; don't hurt him": [("threat", "aimed", "plain"), ("threat", "aimed", "negated")],
        "Kill the process with this command": [],
        "You and they said not this.": [],
        "idiot. " * 9: [("insult", "", "plain")] * 9,
        "": [],
    }.items():
        assert g.patterns(text) == want, text
    assert g.patterns(None) == [] and g.counts("You idiot. Not a fool") == [1, 0, 1, 0, 1, 1, 0]


def test_grammar_by_brute_force():
    """What was said and whether it was aimed, in random clauses, by rules without transducers."""
    rng = np.random.default_rng(12)
    kinds = {"idiot": "insult", "fool": "slight", "nasty": "slur", "you": "target", "kill": "threat", "not": "negation", "said": "report"}
    g = op2_toxicity.Grammar({"idiot": op2_toxicity.INSULT, "fool": op2_toxicity.SLIGHT, "nasty": op2_toxicity.SLUR})
    words = [*kinds, "table", "table", ".", "."]
    for _ in range(3000):
        text = " ".join(words[i] for i in rng.integers(0, len(words), int(rng.integers(1, 14))))
        assert [(w, bool(a)) for w, a, _ in g.patterns(text)] == [(w, a) for w, a, _, _ in brute_clauses(text, kinds)], text


def test_weights_follow_labels():
    """Labels move every weight that they show, in all patterns; signs stay the grammar's."""
    none, insult, denied, aimed = (0,) * 7, (0, 0, 1, 0, 0, 0, 0), (0, 0, 1, 0, 0, 1, 0), (0, 0, 1, 0, 1, 0, 0)
    w = dict(zip(("base", *op2_toxicity.SHOWN), op2_toxicity.learn_weights([(none, 500, 5), (insult, 100, 90), (denied, 100, 2), (aimed, 50, 40)])))
    assert w["base"] < -3 and w["insult"] > 4 and w["negated"] < -4 and w["aimed"] == 0 and w["threat"] == 2.5
    assert op2_toxicity.learn_weights([]) == [-2.0, *op2_toxicity.PRIOR]


def test_toxicity(spark, odd, empty):
    words = "one two three four five six seven eight nine ten".split()
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(600):
        own = rng.choice(words, 12).tolist()
        bad = i % 4 == 0
        if bad:
            own[int(rng.integers(0, 12))] = f"grimbol{rng.choice(list('abcde'))}"
        rows.append((i, " ".join(own) + "."))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = op2_toxicity.fit(docs, marks)
    assert any("grimbol".startswith(s) or s.startswith("grimbol") for s in model[0]) and len(model[0]) <= 6
    out = {r.doc_id: r for r in op2_toxicity.score(docs, model).collect()}
    assert all(out[i].predicted == t for i, t in labels) and all(0 <= r.score <= 1 for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    scored = op2_toxicity.score(odd, model)
    assert scored.count() == odd.count() and scored.filter("doc_id in (2, 3) and predicted = 1").isEmpty()
    assert op2_toxicity.fit(docs, marks.filter("doc_id < 0"))[0] == {} and op2_toxicity.score(empty, model).count() == 0


def test_long_runs(spark):
    """A run of letters is learned and judged by all of it, across pieces; each n-gram counts once."""
    head = "x" * 300
    rows = [(k, head + tail * 200, lang) for k, (tail, lang) in enumerate([("ab", "a"), ("cd", "b")] * 3)]
    model = op3_language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), seen=1)
    want = Counter(f"^{rows[0][1]}$"[i : i + 4] for i in range(len(rows[0][1]) - 1))
    total, known = 3 * sum(want.values()), len(model["tables"][4])
    for item, n in want.items():
        assert math.isclose(model["tables"][4][item][0], math.log(3 * n + 0.5) - math.log(total + known * 0.5))
    scorer = op3_language.Scorer(model)
    assert [scorer.predict("x" * 290 + t * 199)[0] for t in ("ab", "cd")] == ["a", "b"]


def test_sample_splits_copies(spark):
    """Where one text is most of the rows, the sample still holds about as many rows as asked for."""
    rows = [(k, "same text" if k % 4 else f"text {k}", "en") for k in range(4000)]
    model = op3_language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=400)
    # 'text' stands once in every row: its log frequency gives the rows, as nothing else does
    base = {w: math.exp(v[0]) for w, v in model["tables"][0].items()}
    assert set(base) == {"same", "text"} and 0.65 < base["same"] / base["text"] < 0.85


# --- all


def test_stages_on_odd_and_empty(spark, odd, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "mixing", "packing"]
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == odd.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()


def test_pipeline_stages(spark):
    """Each stage's rows against its own input."""
    docs = table(spark, SMALL, "documents")
    one = corpus_pipeline.language(spark, docs, SMALL)
    assert one.count() >= 0.95 * docs.count()
    two = corpus_pipeline.line_dedup(spark, one, SMALL)
    assert two.count() == one.count() and two.schema == docs.schema
    three = corpus_pipeline.near_dedup(spark, two, SMALL)
    roots = brute_near_copies({r.doc_id: r.text for r in two.select("doc_id", "text").collect()})
    assert sorted(r.doc_id for r in three.select("doc_id").collect()) == sorted(k for k, v in roots.items() if k == v)
    four = corpus_pipeline.mixing(spark, three, SMALL)
    words = three.agg(F.sum(op9_mixing.n_words(F.col("text")))).first()[0]
    assert abs(four.agg(F.sum(op9_mixing.n_words(F.col("text")))).first()[0] - words) <= 0.01 * words


def test_clashing_names(spark, odd, clashing):
    """Columns by the names that operators use inside change nothing and come out as they went in."""
    same = lambda df: Counter(map(str, df.select(odd.columns).collect()))
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_dedup, corpus_pipeline.mixing):
        out = stage(spark, clashing, SMALL)
        assert out.columns == clashing.columns and same(out) == same(stage(spark, odd, SMALL))
        assert all(r["_doc"] == f"_doc {'none' if r.doc_id is None else r.doc_id}" for r in out.collect())
    assert corpus_pipeline.language(spark, clashing, SMALL).columns == clashing.columns
    assert op7_lines.remove_boilerplate(clashing).select("n_removed").dtypes == [("n_removed", "int")]
    for apply in (op4_tokens.with_token_counts, op3_language.identify, op5_simhash.near_duplicates, op6_packing.pack, op9_mixing.mix, lambda d: op10_quality.judged(d, []), lambda d: op2_toxicity.score(d, ({}, [0.0] * 8)), lambda d: op8_rans.read_ids(op8_rans.write_ids(d))):
        assert Counter(map(str, apply(clashing).collect())) == Counter(map(str, apply(odd).collect()))


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op2_toxicity.score(empty, op2_toxicity.fit(empty, labels)).count() == 0
    assert op10_quality.judged(empty, op10_quality.fit(empty, labels)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, vector array<long>")
    assert op1_kdtree.top_k(vectors, vectors).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = registry.queries()[name](spark, SMALL)
    result = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(result.fetchall())
