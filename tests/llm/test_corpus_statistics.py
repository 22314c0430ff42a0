"""Divergence audit, source mix and spelling variants against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from leafscan.llm import divergence, mixing, spelling

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, value long, chunk long, key string"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "t", 1, 2, 3, "k") for r in rows], SCHEMA).repartition(parts)


def odd_rows():
    """Several languages, a hot source, nulls, repeats, texts without words, one very long text."""
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "γάμμα", "delta-x", "Éa", "zz9zz", "o'k", "\x00q", "ÀB", "naïve"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    said = lambda n: " ".join(rng.choice(vocabulary[: rng.randrange(3, len(vocabulary))]) for _ in range(n))
    rows = [(k, said(rng.randrange(1, 40)), rng.choice(["en", "de"]), rng.choice(["a", "a", "b", "c", "é", None])) for k in range(60)]
    rows += [(None, None, None, None), (None, "", "en", "a"), (70, "\t \n", "xx", "only"), (70, said(5), "xx", "only"), (71, "42 !!", "en", "empty"), (72, said(4000), "de", "b")]
    return rows + rows[:7] + [rows[3]] * 5


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def audited(rows, least_docs, top=50):
    told = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(t)), lang or "", source or "") for _, t, lang, source in rows]
    in_docs, counts, groups = defaultdict(Counter), defaultdict(Counter), sorted({r[1:] for r in told})
    for terms, lang, source in told:
        in_docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        counts[lang, None].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for t, n in in_docs[lang].items() if n >= least_docs]

        def price(group, t, lang=lang, kept=kept):
            total = sum(counts[lang, group][k] for k in kept)
            return 1 + 10**9 * (counts[lang, group][t] + 5) // (total + 5 * len(kept))

        pairs = [(s, sum(abs(price(source, t) - price(s, t)) for t in kept)) for g, s in groups if g == lang and s != source]
        terms = [(t, price(source, t) - price(None, t)) for t in kept if counts[lang, source][t]]
        for part, found, most in (("pair", pairs, None), ("term", [x for x in terms if x[1] > 0], top)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("block_terms,block_sources,least_docs", [(512, 16, 3), (4, 2, 2), (3, 1, 1), (512, 16, 10_000)])
def test_audit_equals_brute_force(spark, block_terms, block_sources, least_docs):
    rows = odd_rows()
    counts, groups = divergence.kept_counts(docs(spark, rows), least_docs)
    found = divergence.pair_rows(counts, groups, block_terms, block_sources).unionByName(divergence.term_rows(counts, groups))
    assert sorted(map(tuple, found.collect())) == audited(rows, least_docs)


def test_audit_hands_counts_on_and_prices_large_counts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "REMEMBERED", 5)
    rows = odd_rows()
    assert sorted(map(tuple, divergence.audit(docs(spark, rows), 3, 2).collect())) == audited(rows, 3, 2)
    priced = spark.range(1).select(divergence.price(F.lit(7 * 10**12), F.lit(9 * 10**13), F.lit(10**6)).alias("p")).first()["p"]
    assert priced == 1 + 10**9 * (7 * 10**12 + 5) // (9 * 10**13 + 5 * 10**6)


def test_reversed_bits(spark):
    found = spark.range(64).select(mixing.reversed_bits(F.col("id"), 6).alias("r")).collect()
    assert [r["r"] for r in found] == [int(f"{k:06b}"[::-1], 2) for k in range(64)]


def goals(sizes, weights=(1, 2, 3), epochs=3):
    """Targets by resharing the excess, in fractions."""
    from fractions import Fraction

    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(epochs * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        share = {s: Fraction(left * weight[s], open_) for s in names if s not in full}
        if not (more := {s for s in share if share[s] > epochs * sizes[s]}):
            return {s: share.get(s, Fraction(epochs * sizes[s])) for s in names}
        full |= more


def test_mix_meets_targets_and_fills_slots(spark):
    rows = odd_rows()
    given = docs(spark, rows)
    mix = mixing.mixed(given, block=16)
    found = mixing.taken(mix).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += size(text)
    want = goals(sizes)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in found) == sorted((k is None, k or 0, size(t)) for k, t, _, _ in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    of = {k: s for k, _, _, s in rows}
    took = Counter()
    for r in mix.where("slot IS NOT NULL").collect():
        took[r["source"]] += r["words"]
    assert all(took[s] == int(want[s]) for s in want)
    assert {(of[r["doc_id"]], r["source_size"], r["target"]) for r in found if r["doc_id"] is not None} == {(s, sizes[s], float(want[s])) for s in {of[k] for k, *_ in rows if k is not None}}
    again = mixing.taken(mixing.mixed(docs(spark, rows[::-1], 5), block=64)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))  # whatever the blocks and the order of rows


def test_slots_follow_the_points_and_hold_consecutive_blocks(spark):
    rows = [(k, "w " * 50, "en", s) for k, s in enumerate("aaaaaaaabbbc" * 4)]
    mix = mixing.mixed(docs(spark, rows), block=32)
    used = mix.where("slot IS NOT NULL").collect()
    blocks = defaultdict(dict)
    for r in used:
        blocks[r["source"]].setdefault(r["block"], set()).add(r["slot"])
    for source, found in blocks.items():
        order = [next(iter(found[k])) for k in sorted(found)]
        assert sorted(found) == list(range(len(found))) and all(len(s) == 1 for s in found.values())
        assert order == sorted(order), source  # earlier blocks in earlier slots
    words = Counter()
    for r in used:
        words[r["source"], r["block"]] += r["words"]
    assert all(n == 32 for (s, k), n in words.items() if k != max(blocks[s]))
    slots = sorted({r["slot"] for r in used if r["source"] == "a"})
    gaps = [b - a for a, b in zip(slots, slots[1:], strict=False)]
    assert max(gaps) <= 4 * sum(gaps) / len(gaps)  # spread evenly


def test_texts_of_slots_are_the_documents_words(spark):
    rows = [(k, " ".join(f"{s}{k}.{n}" for n in range(20)), "en", s) for k, s in enumerate("ab" * 5)]
    given = docs(spark, rows)
    mix = mixing.mixed(given, block=7)
    said = Counter(w for r in mixing.texts(given, mix).collect() for w in r["text"].split())
    per_doc = Counter()
    for r in mixing.taken(mix).collect():
        per_doc[r["doc_id"]] = r["taken"]
    assert sum(said.values()) == sum(per_doc.values())
    for k, text, _, _ in rows:
        assert sum(said[w] for w in text.split()) == per_doc[k] and max(said[w] for w in text.split()) <= 3


def spelled(rows, damage=97, least=3):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered(text)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % damage else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    out, forms = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = len(others)
    rows = []
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n[w], out[w], n.get(forms[w])))
    return sorted(rows)


def misspelt_rows(seed, letters, count):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 13))) for _ in range(count)]
    def edit(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
    words = base + [edit(w) for w in base for _ in range(2)]
    words += [edit(w) for w in words]
    rows = [(k, " ".join(rng.choice(words[: rng.randrange(2, len(words))]) for _ in range(80)), "en", "a") for k in range(60)]
    return rows + [(None, None, None, None), (None, "ÀÉîöü àÉîöü àéîöü×÷ ABCDE abcde", None, None), (5, "", "x", "y")] + rows[:4] + [(99, " ".join(words) * 3, "en", "b")]


@pytest.mark.parametrize("seed,letters,least_frequent", [(1, "abé", 32), (2, "ab", 2), (3, "aeinrst", 8), (4, "aeinrstÿ", 0)])
def test_variants_equal_brute_force(spark, monkeypatch, seed, letters, least_frequent):
    monkeypatch.setattr(spelling.gram_dictionary, "__defaults__", (least_frequent, 50_000))
    rows = misspelt_rows(seed, letters, 60)
    assert sorted(map(tuple, spelling.variants(docs(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr) == sorted(spelled(rows), key=repr)


def test_an_edit_leaves_as_many_grams_as_the_bound_says():
    rng = random.Random(8)
    for _ in range(400):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        frequent = {"".join(rng.choice("^$" + letters) for _ in range(rng.randrange(2, 7))): rng.randrange(40, 900) for _ in range(300)}
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(5, 14)))
        grams = spelling.decomposed(word, frequent)
        ask, need = spelling.asked(grams, frequent, len(word))
        assert need >= 1
        k = rng.randrange(len(word))
        for other, shifts in ((word[:k] + word[k + 1 :], (0, -1)), (word[:k] + "z" + word[k + 1 :], (0,)), (word[:k] + "z" + word[k:], (0, 1))):
            there = set(spelling.decomposed(other, frequent))
            assert sum(any((at + s, g) in there for s in shifts) for at, g in (grams[a] for a in ask)) >= need


def test_chains_of_forms_lead_to_their_last(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(13)] + [("x", "w5")], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(forms).collect()} == {**{f"w{k}": "w13" for k in range(13)}, "x": "w13"}


def test_no_rows(spark):
    none = docs(spark, [], 1)
    assert divergence.audit(none).count() == mixing.taken(mixing.mixed(none)).count() == spelling.variants(none).count() == 0
    blank = docs(spark, [(1, None, None, None), (2, " ", "en", "a")])
    assert {(r["taken"], r["target"]) for r in mixing.taken(mixing.mixed(blank)).collect()} == {(0, 0.0)}
    assert spelling.variants(blank).count() == divergence.audit(blank).count() == 0
    assert hashlib.md5(b"0:").hexdigest() == spark.range(1).select(F.md5(F.lit("0:"))).first()[0]
