"""Operators over documents against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafscan.llm import bytebpe, packing, simhash, sketch, wavelet
from leafscan.llm.common import vocabulary

SCHEMA = "doc_id long, text string, piece string, start string, fp string, component_id long"


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", "y", "z", 9) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)


def odd_texts():
    rng = random.Random(5)
    words = ["the", "The", "naïve", "日本", "x1", "don't", "a", "thndti$$$", "\x1cq", "ok.", "İ", "<|endoftext|>"]
    texts = [None, "", " \t\n", "one", "one two three", "same text here now", "same text here now", "a\n\n b  c d"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(12)]
    return [*texts, " ".join(rng.choice(words) for _ in range(9000))]


def test_simhash_components_equal_all_pairs(spark):
    rng = random.Random(1)
    base = [" ".join(str(rng.randrange(500)) for _ in range(120)) for _ in range(12)]
    texts = odd_texts() + base
    for b in base[:6]:  # near copies
        for _ in range(4):
            w = b.split()
            w[rng.randrange(len(w))] = "edited"
            texts.append(" ".join(w))
    rows = simhash.near_duplicates(docs(spark, texts)).collect()
    fps = []
    for text in texts:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        import xxhash

        hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    component = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a in range(len(fps)):
            for b in range(a):
                if bin(fps[a] ^ fps[b]).count("1") <= 4 and component[a] != component[b]:
                    component[a] = component[b] = min(component[a], component[b])
                    changed = True
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {k: (f"{f:016x}", component[k]) for k, f in enumerate(fps)}


def test_ball_hashing_links_random_fingerprints_at_the_radius(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = np.array([b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, d, replace=False))) for d in (1, 3, 4, 5) for b in base[:20]], np.uint64)
    fps = np.unique(np.concatenate([base, near]))
    ids = list(range(len(fps)))
    table = spark.createDataFrame(list(zip(ids, fps.view(np.int64).tolist(), strict=True)), "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(table).collect()}
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    want = np.arange(len(fps))
    for _ in range(len(fps)):
        want = np.array([want[close[k]].min() for k in range(len(fps))])
    assert got == dict(zip(ids, want.tolist(), strict=True))


def test_split_groups_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_VARIANTS", 3000)
    table = spark.createDataFrame([(k, (1 << k) - 1) for k in range(0, 40, 3)] + [(99, 1 << 60)], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(table).collect()}
    assert got == {**{k: 0 for k in range(0, 40, 3)}, 99: 0}


def test_near_copies_leave_one_of_each_group(spark):
    rng = random.Random(2)
    base = [[str(rng.randrange(900)) for _ in range(150)] for _ in range(5)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:70], "new", *b[71:]]) for b in base[:3]] + [" ".join(base[0]), None, "", "alone"]
    ids = [*range(10, 10 + len(texts))]
    kept = simhash.without_near_copies(docs(spark, [*texts, texts[4], "no id"], [*ids, 14, None]))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == sorted([(False, k) for k in (10, 11, 12, 13, 14, 19, 21)] + [(True, None)])


def surviving(texts):
    """Places of the texts that stay, by brute force: the first of each group that chains of similar pairs connect."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    root = [*range(len(sets))]

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {a for a in range(len(root)) if root[a] == a}


def test_near_copies_of_a_large_star(spark):
    rng = random.Random(7)
    texts = []
    for copies in (300, 60, 5):
        base = [str(rng.randrange(5000)) for _ in range(300)]
        for _ in range(copies):  # similar to the original, hardly to each other
            w = [*base]
            for k in rng.sample(range(5, 295), rng.randrange(5, 12)):
                w[k] = f"edit{rng.randrange(10**9)}"
            texts.append(" ".join(w))
        texts.append(" ".join(base))
    rng.shuffle(texts)
    kept = simhash.without_near_copies(docs(spark, texts))
    assert {r["doc_id"] for r in kept.collect()} == surviving(texts)


def test_near_copies_by_whole_blocks(spark):
    rng = random.Random(8)
    edits = [
        lambda w, some, at: w + some,
        lambda w, some, at: some + w,
        lambda w, some, at: w[:at] + some + w[at + len(some) :],
        lambda w, some, at: w[:at] + w[at + len(some) :],
        lambda w, some, at: w[:at] + w[at + len(some) :] + w[at : at + len(some)],
    ]
    texts = []
    for n, share, edit in [(n, share, edit) for n in (200, 1000) for share in (0.05, 0.09, 0.15, 0.2) for edit in edits] * 3:
        base, some = ([str(rng.randrange(5000)) for _ in range(m)] for m in (n, int(n * share)))
        texts += [" ".join(base), " ".join(edit(base, some, rng.randrange(n - len(some))))]
    kept = simhash.without_near_copies(docs(spark, texts))
    assert {r["doc_id"] for r in kept.collect()} == surviving(texts)


def test_near_copies_beyond_the_broadcast_bound(spark, monkeypatch):
    """pipeline: where keys are too many to broadcast, texts that stay aren't shuffled, and texts of pairs go once to a bucket of them."""
    rng = random.Random(10)
    texts = []
    for copies in (40, 9, *[2] * 12, *[0] * 20):
        base = [str(rng.randrange(12)) for _ in range(rng.randrange(3, 160))]  # few words, so that others share shingles too
        for _ in range(copies):
            at = rng.randrange(len(base))
            texts.append(" ".join([*base[:at], *[f"edit{rng.randrange(10**6)}"] * rng.randrange(3), *base[at + rng.randrange(9) :]]))
        texts.append(" ".join(base))
    rng.shuffle(texts)
    bounds = {"BROADCAST_ROWS": 5, "FEW": 6, "BLOCK": 5, "TOGETHER": 4, "BUCKET_SHINGLES": 300, "SIEVE_KEYS": 20}
    shuffled = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(shuffled)
    for name, bound in bounds.items():
        monkeypatch.setattr(simhash, name, bound, raising=False)
    spark.conf.set(shuffled, -1)
    try:
        kept = simhash.without_near_copies(docs(spark, texts))
        assert {r["doc_id"] for r in kept.collect()} == surviving(texts)
        assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(shuffled, before)


def test_texts_without_enough_common_beginnings_are_not_paired(spark, monkeypatch):
    """pipeline: texts that share a rare shingle and little else aren't read again; their pairs grow with the square of the table."""
    rng = random.Random(11)
    shared = [[f"s{k}w{i}" for i in range(5)] for k in range(40)]
    texts = []
    for _ in range(120):
        w = [str(rng.randrange(10**6)) for _ in range(rng.randrange(100, 110))]
        texts.append(" ".join([*w[:50], *rng.choice(shared), *w[50:]]))
    compared, dealt = [], simhash._dealt
    monkeypatch.setattr(simhash, "_dealt", lambda pairs: compared.append(pairs.count()) or dealt(pairs))
    copy = texts[0].replace(texts[0].split()[7], "other")
    assert {r["doc_id"] for r in simhash.without_near_copies(docs(spark, [*texts, copy])).collect()} == {*range(120)}
    assert compared == [1]


def test_near_copies_with_shared_and_missing_ids(spark):
    rng = random.Random(9)
    a, b, c, d = ([str(rng.randrange(900)) for _ in range(100)] for _ in range(4))
    edited = lambda w: " ".join([*w[:50], "new", *w[51:]])
    a, b, c, d, a2, c2 = *map(" ".join, (a, b, c, d)), edited(a), edited(c)
    kept = simhash.without_near_copies(docs(spark, [a, b, a2, c, c, c2, d, a, d], [1, 1, 2, None, None, None, 3, None, 3]))
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(rows) == 4 and {*rows} in ({(1, a), (1, b), (3, d), (None, c)}, {(1, a), (1, b), (3, d), (None, c2)})


def test_empty_tables(spark):
    none = docs(spark, ["x"]).where("doc_id < 0")
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.without_near_copies(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert wavelet.write_and_read(none).count() == 0
    assert sketch.edited(none).count() == 0
    assert bytebpe.encode(none, decoded=True).count() == 0


def encoded(texts, end):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return [np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in texts]


def test_packing_places_every_piece_once(spark):
    texts = odd_texts()
    rows = packing.pack_documents(docs(spark, texts)).collect()
    want = sorted((d, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for d, ids in enumerate(encoded(texts, 1)) for k in range(0, len(ids), 4096))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert by.get(r["sequence_id"], 0) == r["offset"]
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 4096
    pieces = packing.tokenised_pieces(docs(spark, texts))
    placed = packing.pack_documents(docs(spark, texts))
    assert {r["n"] for r in packing.sequences(pieces, placed).selectExpr("octet_length(ids) / 4 AS n").collect()} == set(map(float, by.values()))


def test_bounded_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 8, 4, 2)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6), (2, 8)]
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 8, 3, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6), (3, 0)]
    assert bins.count == 2


def test_wavelet_matrix_answers():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 5), (513, 7), (3000, 49408)):
        ids = rng.integers(0, top, n).astype("<u4")
        matrix, _ = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.of(ids).to_bytes())
        assert (matrix.ids() == ids).all()
        at = rng.integers(0, n, 50) if n else np.empty(0, int)
        assert (matrix.access(at) == ids[at]).all()
        for value in {*ids[:5].tolist(), top, 70000}:
            places = np.flatnonzero(ids == value).tolist()
            assert matrix.locate(value) == places and matrix.select(value, len(places)) == -1
            assert matrix.rank(value, n // 2) == sum(p < n // 2 for p in places)


def test_point_lookups_unpack_single_chunks():
    ids = np.random.default_rng(4).integers(0, 49408, 1_200_000).astype("<u4")
    data = wavelet.WaveletMatrix.of(ids).to_bytes()
    matrix, end = wavelet.WaveletMatrix.from_bytes(data + b"more")
    chunks = sum(map(len, matrix.packed))
    assert end == len(data) and chunks == 16 * 5 and not matrix.unpacked
    assert matrix.access([777_777])[0] == ids[777_777] and len(matrix.unpacked) <= 2 * 16
    matrix.unpacked.clear()
    assert matrix.rank(int(ids[5]), 600_000) == (ids[:600_000] == ids[5]).sum() and len(matrix.unpacked) <= 2 * 16
    assert matrix.select(int(ids[5]), 0) == np.flatnonzero(ids == ids[5])[0]


def test_word_memo_forgets_and_gives_the_library_s_ids():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from leafscan.llm.wordbpe import WordEncoder

    path = vocabulary("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), WordEncoder(path, slots=64)
    texts = [*odd_texts(), "<|endoftext|> X", "<|ENDOFTEXT|>hi", "don't We'LL It'S \"'tis l'été", "É ẞ ß ǅ ŉ İstanbul ﬁ ſ K Å", "Σας ΣΑΣ", "½ ²3 x² ٣ Ⅳ", "..,'s 's' a's 'S x'Ll"]
    texts += ["\x00\x01b \x7f", "×÷ a×b ª1º µ", "éa É a\u0301 \xa0b\x85c", "a" * 3000 + " " + "é" * 3000]
    for _ in range(2):
        ids, sizes = own.encode(pa.array(texts), 7)
        assert [part.tolist() for part in np.split(ids, sizes.cumsum()[:-1])] == [[*library.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]


def test_shards_give_every_document_back(spark, tmp_path):
    texts, ids = [*odd_texts(), "again", "again"], None
    ids = [5 * k % 23 for k in range(len(texts) - 2)] + [100, 100]
    folder = str(tmp_path / "shards")
    wavelet.write(docs(spark, texts, ids), folder, shard_tokens=60)
    assert spark.read.parquet(folder).count() > 3
    rows = sorted(wavelet.read_documents(spark, folder).collect(), key=lambda r: r["start"])
    start = 0
    for row, (doc, text) in zip(rows, sorted(zip(ids, texts, strict=True), key=lambda p: p[0]), strict=True):
        (want,) = encoded([text], 2)
        assert (row["doc_id"], row["start"], bytes(row["ids"])) == (doc, start, want.tobytes())
        start += len(want)


def test_byte_bpe_equals_the_library(spark):
    import public_tokenizers
    import tiktoken

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.load_ranks(path), special_tokens={})
    texts = [*odd_texts(), "a" * 5000, "ab" * 3000 + "é" * 3000, "".join(chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000)]
    rows = {r["doc_id"]: r for r in bytebpe.encode(docs(spark, texts), decoded=True).collect()}
    for k, text in enumerate(texts):
        assert rows[k]["ids"] == library.encode_ordinary(text or "")
        assert rows[k]["text"] == (text or "")
    assert {r["doc_id"]: r["text"] for r in bytebpe.decode(bytebpe.encode(docs(spark, texts))).collect()} == {k: t or "" for k, t in enumerate(texts)}


def test_byte_bpe_with_another_pattern(spark):
    import tiktoken

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    for pattern in (r"\S+|\s+", r"\p{L}+|[^\p{L}]", r"(\w+)|(\W)"):
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bytebpe.load_ranks(path), special_tokens={})
        own = bytebpe.ByteBPE(path, pattern)
        for text in odd_texts()[:-1]:
            assert own.encode(text).tolist() == library.encode_ordinary(text or "")
    with pytest.raises(UnicodeDecodeError):
        "".join(own.decode(np.array([own.transducer.ranks[b"\xff"]]), "strict"))


def test_shingle_sets_equal_plain_ones():
    import pyarrow as pa

    from leafscan.llm.common import slices

    texts = [*odd_texts(), "A b\tc  d e F", "a B C d e f"]
    held, at = [], 0
    for some in slices(pa.array(texts), 300):  # runs begin anywhere in the array
        of, hashes = simhash.shingle_sets(some, 5)
        prints = simhash.set_fingerprints(of, hashes, len(some))
        for k in range(len(some)):
            mine = hashes[of == k]
            held.append(set(mine.tolist()))
            assert len(held[-1]) == len(mine) and int(prints[k]) == simhash.fingerprint(mine)
        at += len(some)
    assert at == len(texts)

    def plain(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    for a in range(len(texts)):
        for b in range(len(texts)):
            assert len(held[a] & held[b]) == len(plain(texts[a]) & plain(texts[b]))


def test_transducer_equals_the_definition():
    ranks = {bytes([b]): b for b in range(256)}
    for token in ("ab", "bc", "abc", "ca", "aa", "aaaa", "abca", "cab"):
        ranks[token.encode()] = len(ranks)
    machine, rng = bytebpe.Transducer(ranks, kept_steps=50), random.Random(4)
    for _ in range(3000):
        piece = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))).encode()
        want = [ranks[piece]] if piece in ranks else [ranks[t] for t in bytebpe.merged(piece, ranks)]
        assert machine.encode(piece) == want


def test_utf8_stream_holds_back_cut_characters():
    data = "aé日😀b".encode()
    for cut in range(len(data) + 1):
        stream = bytebpe.Utf8Stream()
        parts = [stream.feed(data[:cut]), stream.feed(data[cut:]), stream.feed(b"", last=True)]
        assert "".join(parts) == "aé日😀b" and "�" not in parts[0]


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_sketches_of_edited_texts(spark):
    rng = random.Random(6)
    long = [" ".join(str(rng.randrange(3000)) for _ in range(n)) for n in (3000, 6000)]
    texts = [*odd_texts(), *long, long[0]]
    ids = [-(1 << 63), (1 << 63) - 1, *[3 * k for k in range(len(texts) - 2)]]
    made = sketch.edited(docs(spark, texts, ids), range_docs=4, sorted_ids=10)
    values = made.select("*", sketch.likeness(F.col("sketch"), F.col("edited_sketch")).alias("a"), sketch.likeness(F.col("sketch"), F.col("next_sketch")).alias("b"), sketch.fingerprint(F.col("sketch")).alias("f"))
    rows = {r["doc_id"]: r for r in values.collect()}
    everything = [t or "" for t in texts] + [r["edited"] for r in rows.values()]
    whole = sketch.sketch(F.col("value"), scale=1)  # all hashes
    hashes = {r["value"]: set(r["s"]["hashes"]) for r in spark.createDataFrame([(t,) for t in everything], "value string").select("value", whole.alias("s")).collect()}
    kept = {t: {h for h in hs if h < -(1 << 63) + (1 << 62)} for t, hs in hashes.items()}
    assert all(len(hs) == len(shingles(t)) for t, hs in hashes.items())

    def alike(a, b):
        if kept[a] | kept[b]:
            return len(kept[a] & kept[b]) / len(kept[a] | kept[b])
        return float(min(hashes[a], default=None) == min(hashes[b], default=None))

    order = sorted(zip(ids, texts, strict=True), reverse=True)
    for k, (doc, text) in enumerate(order):
        text, nxt = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        changed = text[: len(text) - third] + nxt[:third]
        assert hashlib.sha256(rows[doc]["edited"].encode()).digest() == hashlib.sha256(changed.encode()).digest()
        assert (rows[doc]["a"], rows[doc]["b"]) == (pytest.approx(alike(text, changed)), pytest.approx(alike(text, nxt)))
        assert (rows[doc]["f"] == "") == (not shingles(text))
        if len(shingles(text)) > 1000:
            assert rows[doc]["a"] == pytest.approx(len(shingles(text) & shingles(changed)) / len(shingles(text) | shingles(changed)), abs=0.06)
    assert rows[ids[-1]]["f"] == rows[ids[-3]]["f"] != rows[ids[-2]]["f"]


def test_next_documents_with_missing_and_shared_ids(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(9), 4, 4]), f"{k} {rng.random()}") for k in range(120)] + [(4, "same")] * 3
    for range_docs in (1, 7, 1000):
        found = sketch.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), {}, range_docs, 40).collect()
        assert sorted(r["text"] for r in found) == sorted(r["next_text"] for r in found) == sorted(t for _, t in rows)
        ids = {t: i for i, t in rows}
        falls = [(ids[r["next_text"]], r["doc_id"]) for r in found]
        rank = lambda i: -1 if i is None else i
        assert sum(rank(n) > rank(i) for n, i in falls) == 1 and sorted({rank(i) - rank(n) for n, i in falls}) == [-9, 0, 1]


def test_sketches_merge_and_contain(spark):
    rng = random.Random(7)
    small, large = (" ".join(str(rng.randrange(10**6)) for _ in range(n)) for n in (400, 40_000))
    pair = spark.createDataFrame([(small, large, f"{small} {large}", "", "a b")], "a string, b string, whole string, none string, short string")
    a, b, whole, none, short = (sketch.sketch(F.col(c)) for c in ("a", "b", "whole", "none", "short"))
    row = pair.select(
        sketch.merged(a, b).alias("m"), whole.alias("w"), sketch.containment(a, whole).alias("in"), sketch.containment(whole, a).alias("out"),
        sketch.containment(none, a).alias("none"), sketch.likeness(none, none).alias("both"), sketch.likeness(none, short).alias("one"), sketch.likeness(short, short).alias("equal"),
    ).first()
    assert len(set(row["m"]["hashes"]) ^ set(row["w"]["hashes"])) <= 4  # but for the shingles across the seam
    assert row["m"]["hashes"] == sorted(row["m"]["hashes"])
    assert row["in"] == 1.0 and row["out"] == pytest.approx(0.01, abs=0.004)
    assert (row["none"], row["both"], row["one"], row["equal"]) == (1.0, 1.0, 0.0, 1.0)
