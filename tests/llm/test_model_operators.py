"""Learned and record operators: held-out accuracy, brute force, and the odd cases."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafscan.llm import chat, langid, pivots, quality, urlfilter
from leafscan.llm.common import drawn


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(300)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (350, rows[5][1][:3]), (400, None), (450, [1.0, None]), (500, [float("nan")]), (550, [float("inf")]), (None, [1.0]), (600, []), (50, rows[50][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    usable = table.where(pivots.usable(F.col("embedding"))).select("vec_id", pivots.quantised(F.col("embedding")).alias("v"))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in pivots.top_k(usable, F.col("vec_id") % 50 == 0).collect()]
    vectors = []
    for k, v in rows:
        if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors.append((k, [math.floor(256 * float(np.float32(x))) for x in v]))
    want = []
    for row, (q, own) in enumerate(vectors):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(own, v)), k) for other, (k, v) in enumerate(vectors) if other != row)[:5]
            want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(scored)]
    assert sorted(got) == sorted(want)
    assert pivots.top_k(usable.where("vec_id < 0"), F.lit(True)).count() == 0
    assert pivots.top_k(usable.where("vec_id = 0"), F.lit(True)).count() == 0


def test_top_k_keeps_rows_that_share_an_id(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [int(x) for x in rng.integers(-9, 9, 4)]) for i in [*range(40), *[7] * 6, *[9] * 6, *[0] * 2]]
    found = pivots.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") % 20 == 0).collect()
    want = []
    for n, (query, q) in enumerate(rows):
        if query % 20 == 0:  # three rows have id 0, and each is a candidate of the others
            scores = sorted((-sum(map(int.__mul__, q, v)), i) for m, (i, v) in enumerate(rows) if m != n)[:5]
            want += [(query, k + 1, i, -score) for k, (score, i) in enumerate(scores)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == sorted(want) and len(found) == 20


def test_url_rules_and_model(spark):
    urls = [None, "", "no scheme", "http://NET/a", "https://a.b.Example.NET/en/x?q", "https://badexample.net/en/x", "http://example.net/de", "http://x.example.com/de/1", "http://example.com/DE/1", "http://a.org/fr/#t", "http://a.org/frx", "ftp://q.org?x=/fr/"]
    rng = random.Random(2)
    urls += [f"http://{rng.choice(['shop', 'deal'])}{k}.net/buy/{k}" for k in range(60)] + [f"http://site{k}.org/fr/lire/{k}" for k in range(60)]
    urls += ["http://deal99.com/buy/7", "http://site7.com/fr/lire/9"]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, score string").repartition(3)
    rows = {r["page_id"]: r for r in urlfilter.judged(pages).collect()}
    assert len(rows) == len(urls)
    assert [(rows[k]["host"], rows[k]["path"], rows[k]["rule"]) for k in range(12)] == [
        ("", "", None), ("", "", None), ("", "", None), ("net", "/a", "net/"), ("a.b.example.net", "/en/x", "example.net/en/"), ("badexample.net", "/en/x", "net/"),
        ("example.net", "/de", "net/"), ("x.example.com", "/de/1", "example.com/de/"), ("example.com", "/DE/1", None), ("a.org", "/fr/", "org/fr/"), ("a.org", "/frx", None), ("q.org", "", None),
    ]
    assert [rows[k]["verdict"] for k in (0, 1, 2, 3, 4, 7, 9)] == ["allow", "allow", "allow", "block", "allow", "block", "allow"]
    assert (rows[len(urls) - 2]["verdict"], rows[len(urls) - 1]["verdict"]) == ("block", "allow")
    assert {r["verdict"] for r in urlfilter.judged(pages.where("page_id < 3")).collect()} == {"allow"}
    assert urlfilter.judged(pages.where("page_id < 0")).count() == 0


def test_url_scores_equal_the_models(spark):
    rng = random.Random(3)
    labelled = [("".join(rng.choice("ab./") for _ in range(rng.randrange(1, 30))), rng.random() < 0.5) for _ in range(80)]
    labelled = [*dict(labelled).items()]
    model = urlfilter.fit(spark.createDataFrame(labelled, "url string, allowed boolean"))
    tests = ["abab", "a.b/ca", "zz"]
    got = {r["url"]: r["score"] for r in urlfilter.scored(spark.createDataFrame([(u,) for u in tests], "url string"), model).collect()}
    counts = {}
    for url, allowed in labelled:
        s = "^^^" + url + "$"
        for end in range(4, len(s) + 1):
            for n in range(1, 5):
                gram = s[end - n : end]
                counts.setdefault(gram[:-1], {}).setdefault(gram, [0, 0])[0 if allowed else 1] += 1

    def logratio(context, symbol):
        p = [1 / (len(urlfilter.ALPHABET) + 1)] * 2
        for n in range(1, 5):
            own = context[len(context) - n + 1 :]
            seen = counts.get(own, {})
            total = [sum(c[k] for c in seen.values()) for k in (0, 1)]
            if n > 1 and sum(total) < urlfilter.MIN_CONTEXT:
                break
            mine = seen.get(own + symbol, [0, 0])
            p = [(mine[k] + urlfilter.PRIOR * p[k]) / (total[k] + urlfilter.PRIOR) for k in (0, 1)]
        return math.log(p[0] / p[1])

    flat = math.log((sum(c[1] for c in counts[""].values()) + urlfilter.PRIOR) / (sum(c[0] for c in counts[""].values()) + urlfilter.PRIOR))
    for url in tests:
        s = "^^^" + url + "$"
        terms = [logratio(s[: k - 1][-3:], s[k - 1]) - (flat if s[k - 1] not in "ab./$" else 0) for k in range(4, len(s) + 1)]
        assert got[url] == pytest.approx(sum(terms) / (len(url) + 1), abs=1e-6)


WORDS = {"en": "the of and to in is that for with on this was are be".split(), "fr": "le la les de des un une et est que pour dans sur avec".split()}


def language_docs(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(WORDS[lang]) for _ in range(30)), lang, "x") for k, lang in enumerate(["en", "fr"] * 60)]
    rows += [(500, None, "en", "x"), (501, "", "fr", "x"), (502, "123 !!", "en", "x"), (503, "的是不了人我在有他这 " * 30, None, "x"), (504, WORDS["fr"][0], None, "x"), (0, rows[0][1], "en", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, rejected string").repartition(3)


def test_language_id(spark):
    docs = language_docs(spark)
    model = langid.fit(docs.where(langid.fold(F.col("doc_id")) != 2))
    rows = langid.identified(docs, model, keep=("doc_id", "lang")).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["doc_id"] < 500]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    by = {r["doc_id"]: r for r in rows}
    assert [(by[k]["lang_pred"], by[k]["score"], by[k]["rejected"]) for k in (500, 501, 502)] == [("und", 0.0, True)] * 3
    assert by[503]["rejected"] and not by[504]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in rows)
    nothing = langid.identified(docs, langid.fit(docs.where("doc_id < 0")), keep=("doc_id",)).collect()
    assert {(r["lang_pred"], r["rejected"]) for r in nothing} == {("und", True)}


def test_quality(spark):
    rng = random.Random(5)
    words = "alpha beta gamma delta sun moon river stone house garden".split()
    clean = [" ".join(". ".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(6)).split()) + "." for _ in range(80)]
    junk = [" ".join(f"{rng.choice(words)}{rng.choice(['$$$', '&&&', '***'])}" for _ in range(50)) for _ in range(12)]
    junk += [" ".join(f"{rng.choice(words).upper()}!!" for _ in range(50)) for _ in range(12)]
    junk += [" ".join([w for _ in range(8) for w in [rng.choice(words)] * 7]) for _ in range(12)]
    texts = [*clean, *junk, None, "", "  ", "Short and clean.", clean[0]]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, votes string").repartition(3)
    weights, posterior = quality.fit(docs)
    rows = {r["doc_id"]: r for r in quality.classified(docs, weights, keep=("doc_id",)).collect()}
    assert all(rows[k]["accepted"] for k in range(80)) and rows[len(texts) - 2]["accepted"] and rows[len(texts) - 1]["accepted"]
    assert not any(rows[k]["accepted"] for k in range(80, 80 + len(junk) + 3))
    assert posterior["g" * len(quality.LABELLERS)] > 0.9
    weights, _ = quality.fit(docs.where("doc_id < 0"))
    assert quality.classified(docs.where("doc_id = 0"), weights).first()["score"] == 0.5


def test_quality_scores_equal_plain_ones(spark):
    import zlib

    rng = random.Random(9)
    texts = [" ".join(rng.choice(["Sun", "moon.", "RED!!", "a$b", "|", "x1y22", "Äpfel", "déjà", "日本"]) for _ in range(rng.randrange(1, 80))) for _ in range(60)] + ["A" * 50 + "b" * 70]
    weights = np.random.default_rng(1).normal(size=(1 << quality.DIMENSIONS_BITS) + 1)
    docs = spark.createDataFrame([(k, t, "x", 1.0, True, 2) for k, t in enumerate(texts)], "doc_id long, text string, votes string, score double, accepted boolean, kept_0 long").repartition(3)
    rows = {r[0]: r for r in quality.classified(docs, weights, keep=("doc_id",)).collect()}
    for k, text in enumerate(texts):
        words, features = text.split(), {}
        for word in words:
            shape = re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))
            facts = 1 * (len(word) > 1 and word.isupper()) + 2 * bool(re.search(r"[^\w.,;:?'\"()|!-]|!!$", word)) + 4 * word.endswith("!") + 8 * (word[-1] in ".?!:" and not word.endswith("!!")) + 16 * (word == "|")
            for name in (f"shape {shape}", f"facts {facts}"):
                features[name] = features.get(name, 0) + 1 / len(words)
        measures, n, _ = quality.measured(text, quality.Shapes())
        assert n == len(words) and measures["doubled"] == sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1)
        for name, bad, _, least in quality.LABELLERS:
            if n >= least:
                key = f"{name} {min(8, int(4 * measures[name] / bad))}"
                features[key] = features.get(key, 0) + 0.5
        dims = {}
        for name, value in features.items():
            at = zlib.crc32(name.encode()) >> (32 - quality.DIMENSIONS_BITS)
            dims[at] = dims.get(at, 0) + value
        norm = math.sqrt(sum(dims.values()))
        want = 1 / (1 + math.exp(-(sum(math.sqrt(v) / norm * weights[at] for at, v in dims.items()) + weights[-1])))
        assert rows[k]["score"] == pytest.approx(want, abs=1e-9) and rows[k]["accepted"] == (want >= 0.5)
    kept = quality.without_rejected(docs, weights)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in rows.items() if r["accepted"]}


def test_language_scores_equal_plain_ones(spark):
    rng = random.Random(10)
    texts = ["".join(rng.choice("abcé ñ日.1 ") for _ in range(rng.randrange(1, 90))) for _ in range(40)] + ["Ünï", "x" * 3000]
    idf = np.random.default_rng(2).uniform(0.1, 3, langid.DIMENSIONS).astype(np.float32)
    centroids = np.abs(np.random.default_rng(3).normal(size=(4, langid.DIMENSIONS))).astype(np.float32)
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    model = langid.Model(idf, ["p", "p", "q", "r"], centroids, np.full(4, 0.02))
    docs = spark.createDataFrame([(k, t, "x", "y", 0.5) for k, t in enumerate(texts)], "doc_id long, text string, rejected string, lang_pred string, score double").repartition(3)
    rows = {r[0]: r for r in langid.identified(docs, model, keep=("doc_id",)).collect()}
    for k, text in enumerate(texts):
        letters = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip()
        if not letters:
            assert (rows[k]["lang_pred"], rows[k]["score"]) == ("und", 0.0)
            continue
        first, last = not text.lower()[0].isalpha(), not text.lower()[-1].isalpha()
        padded = " " * (1 + first) + letters + " " * (1 + last)
        counts = {}
        for n in (1, 2, 3):
            for at in range(len(padded) - n + 1):
                code = 0
                for c in padded[at : at + n]:
                    code = code << 21 | ord(c)
                code |= (1 << 63) if n == 2 else 0
                dim = (code * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - langid.DIMENSIONS_BITS)
                counts[dim] = counts.get(dim, 0) + 1
        vector = {d: math.log1p(c) * float(idf[d]) for d, c in counts.items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        cosines = [sum(v * float(c[d]) for d, v in vector.items()) / norm for c in centroids]
        best = max(range(4), key=cosines.__getitem__)
        assert (rows[k]["lang_pred"], rows[k]["score"]) == (model.langs[best], pytest.approx(cosines[best], abs=1e-4)), text
        assert rows[k]["rejected"] == (rows[k]["score"] < 0.01 * min(1, sum(counts.values()) / langid.FULL_GRAMS))
    kept = langid.without_rejected(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in rows.items() if not r["rejected"]}


def test_accuracies_are_recovered():
    rng = random.Random(6)
    patterns = {}
    for _ in range(4000):
        good = rng.random() < 0.7
        cast = "".join("-" if rng.random() < 0.2 else "gb"[(rng.random() < 0.9) != good] for _ in quality.LABELLERS)
        patterns[cast] = patterns.get(cast, 0) + 1
    prior, chances, _ = quality.accuracies(patterns)
    assert prior == pytest.approx(0.7, abs=0.04)
    assert chances[:, 1, 0].mean() == pytest.approx(0.9, abs=0.03) and chances[:, 0, 1].mean() == pytest.approx(0.9, abs=0.03)


def test_preferences(spark):
    turns = [
        (0, 0, "user", "hi <|im_end|>"), (0, 1, "assistant", "yes"), (0, 2, "user", "more"), (1, 0, None, "hi"), (1, 1, "assistant", "no"), (1, 0, None, "hi"),
        (2, None, "user", None), (7, 0, "user", "alone"), (7, 1, "assistant", "x"),
    ]
    table = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, part string").repartition(3)
    segments = chat.formatted(chat.swapped_replies(table))
    got = {(r["pair_id"], r["part"], r["turn"]): r for r in segments.collect()}
    assert sorted(got) == [(0, "chosen", 1), (0, "chosen", 2), (0, "prompt", 0), (0, "rejected", 1), (0, "rejected", 2), (1, "chosen", 1), (1, "prompt", 0), (1, "rejected", 1), (2, "prompt", -1), (7, "prompt", 0), (7, "prompt", 1)]
    assert got[0, "prompt", 0]["rendered"] == "<|im_start|>user\nhi < |im_end|><|im_end|>\n"
    row = got[0, "rejected", 1]
    assert row["rendered"][row["learn_from"] : row["learn_to"]] == "no<|im_end|>"
    assert (got[0, "chosen", 2]["learn_to"], got[0, "prompt", 0]["learn_to"]) == (0, 0)
    whole = {r["pair_id"]: r for r in chat.assembled(segments).collect()}
    assert whole[0]["chosen"] == "<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    (span,) = whole[0]["rejected_spans"]
    assert whole[0]["rejected"][span["from"] : span["to"]] == "no<|im_end|>"
    assert whole[7]["chosen"] == "" and whole[2]["prompt"].startswith("<|im_start|>user")
    assert whole[1]["prompt"] == "<|im_start|>unknown\nhi<|im_end|>\n" * 2  # the repeated row is said twice
    assert chat.assembled(chat.formatted(chat.swapped_replies(table.where("turn > 5")))).count() == 0


def test_equal_rows_and_long_conversations(spark):
    rows = [(1, side, 5, "user", "again") for side in ["chosen"] * 3 + ["rejected"] * 2] + [(1, side, 4, "user", "x") for side in ("chosen", "rejected")]
    rows += [(2, side, k, "assistant", str(k)) for k in range(300) for side in ("chosen", "rejected")] + [(2, "chosen", 300, "user", "end")]
    rows += [(2, side, 301 + k, "assistant", f"{side} {k}") for k in range(40) for side in ("chosen", "rejected")]
    rows += [(3, side, k, "user", f"turn {k}") for k in (0, 1000) for side in ("chosen", "rejected")] + [(3, "rejected", 2000, "assistant", "late")]
    segments = chat.formatted(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string"))
    first, second, third = sorted(chat.assembled(segments).collect(), key=lambda r: r["pair_id"])
    turn = "<|im_start|>user\nagain<|im_end|>\n"
    assert (first["prompt"], first["chosen"], first["rejected"]) == ("<|im_start|>user\nx<|im_end|>\n", turn * 3, turn * 2)
    assert second["prompt"] == "".join(f"<|im_start|>assistant\n{k}<|im_end|>\n" for k in range(300))
    learned = [second["rejected"][s["from"] : s["to"]] for s in second["rejected_spans"]]
    assert learned == [f"rejected {k}<|im_end|>" for k in range(40)] and len(second["chosen_spans"]) == 40
    assert third["prompt"] == "<|im_start|>user\nturn 0<|im_end|>\n<|im_start|>user\nturn 1000<|im_end|>\n" and third["chosen"] == ""
    wholes = {r["pair_id"]: r for r in (first, second, third)}
    pieces = sorted(chat.assembled(segments, piece_chars=500).collect(), key=lambda r: (r["pair_id"], r["piece"]))
    assert len(pieces) > 10
    for pair_id, whole in wholes.items():
        own = [r for r in pieces if r["pair_id"] == pair_id]
        for part in ("prompt", "chosen", "rejected"):
            assert "".join(r[part] for r in own) == whole[part]
        for spans in ("chosen_spans", "rejected_spans"):
            assert [s for r in own for s in r[spans]] == whole[spans]


def test_rows_without_an_id_are_pairs_of_their_own(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "b"), (None, 1, "assistant", "b"), (None, 0, "user", "a"), (4, 0, "user", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    said = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    found = chat.assembled(chat.formatted(chat.swapped_replies(table))).collect()
    assert sorted((r["pair_id"] is None, r["prompt"]) for r in found) == sorted(
        [(True, said("user", "a") * 2), (True, said("user", "b")), (True, said("assistant", "b")), (False, said("user", "a"))]
    )
    assert {(r["chosen"], r["rejected"]) for r in found} == {("", "")}


def test_copies_are_unfolded_in_runs(spark, monkeypatch):
    monkeypatch.setattr(chat, "COPIES", 3)
    rows = [(1, side, 0, "user", "x") for side in ["chosen"] * 7 + ["rejected"] * 6]
    segments = chat.formatted(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string"))
    assert sorted((r["part"], r["copy"]) for r in segments.collect()) == [("chosen", k) for k in range(7)] + [("rejected", k) for k in range(6)]


def test_longest_common_prefix_with_ties(spark):
    rows = [(1, side, k, "user", str(k)) for side in ("chosen", "rejected") for k in range(3)] + [(1, "chosen", 1, "user", "extra"), (1, "rejected", 5, "assistant", "end")]
    parts = {(r["part"], r["turn"], r["rendered"].split("\n")[1][:5]) for r in chat.formatted(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")).collect()}
    assert {(p, t) for p, t, _ in parts} == {("prompt", 0), ("chosen", 1), ("chosen", 2), ("rejected", 1), ("rejected", 2), ("rejected", 5)}


def test_pipeline_runs_whole(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    text = lambda: ". ".join(" ".join(rng.choice(WORDS["en"]) + str(rng.randrange(40)) for _ in range(9)) for _ in range(8)) + "."
    rows = [(k, text(), "en", "s", 1) for k in range(40)]
    rows += [(100, rows[0][1], "en", "s", 1), (101, rows[1][1].replace(" ", "  ", 3), "en", "s", 1), (102, None, "en", "s", 1), (103, "!!", "en", "s", 1), (104, "X$$$ " * 60, "en", "s", 1)]
    clashing = [(*r, "a", "b", "c", 0.5, 7) for r in rows]
    spark.createDataFrame(clashing, "doc_id long, text string, lang string, source string, n_chars long, rejected string, accepted string, lang_pred string, score double, kept_0 long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r["doc_id"] for r in out}) == list(range(40))
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_duplicates", "packing"]


def test_samples_hold_their_share_and_bound_at_any_size(spark):
    rows = spark.range(200_000).withColumn("h", F.xxhash64("id", F.lit("train")))
    for share in (1.0, 0.25, 1e-4, 3e-6):
        got = rows.where(drawn(F.lit(share), F.col("id"), F.lit("train"))).count()
        assert abs(got - share * 200_000) <= 5 * (share * 200_000) ** 0.5 + 1
    least = rows.agg(F.min("h")).first()[0] / 2**64 + 0.5  # a share between nothing and the least digest is not nothing
    assert rows.where(drawn(F.lit(least * 1.001), F.col("id"), F.lit("train"))).count() == 1
    texts = spark.createDataFrame([(k, f"some plain words of a text number {k} " * 5, "en") for k in range(300)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="no document of 300"):
        quality.fit(texts, train_docs=1e-9)
    assert len(langid.fit(texts, clusters=2, sample=5).langs) <= 2
