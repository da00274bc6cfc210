"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from actmill.llm import bpe, decontam, langid, linededup, multiset, omh, quality, sufdedup, surrogate, toxicity
from actmill.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, letters: str = "abcdefghij") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def odd_rows() -> list[tuple]:
    rng = random.Random(3)
    base = words(rng, 120)
    lines = "\n".join(words(rng, 12) for _ in range(8))
    texts = [None, "", "   ", "\n\n", "one", "one two three", base, base, base + " tail", lines, "start\n" + lines + "\nend", words(rng, 30_000), "é ü 日本 👍", "x" * 5000, "a\x00b"]
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, (None, base, None, None, None), rows[6], (6, "another text of the same id", "de", "s", 3)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def sample(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# 1


def jaccard(a: str, b: str) -> float:
    def bag(t: str) -> Counter:
        w = t.lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])

    x, y = bag(a), bag(b)
    both = sum((x & y).values())
    return both / max(sum(x.values()) + sum(y.values()) - both, 1)


def test_near_duplicates_find_all_similar_pairs(spark, sample):
    got = {r.doc_id: r.class_id for r in QUERIES["op1_order_minhash"](spark, SF).collect()}
    assert sorted(got) == sorted(i for i, _ in sample)
    pairs = [(a, b) for k, (a, x) in enumerate(sample) for b, y in sample[:k] if 0.7 < (len(x) + 1) / (len(y) + 1) < 1.4 and jaccard(x, y) >= 0.8]
    assert pairs and all(got[a] == got[b] for a, b in pairs)
    linked = {x for p in pairs for x in p}
    assert all(got[i] == i for i, _ in sample if i not in linked)


def test_near_duplicates_of_a_crowd(spark):
    rng = random.Random(5)
    base = words(rng, 150).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        w[rng.randrange(150)] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, words(rng, 150)) for i in range(20)]
    got = {r.doc_id: (r.class_id, r.class_size) for r in omh.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (0, 60) for i in range(60)) and all(got[i][0] == i for i in range(100, 120))


def test_near_duplicates_alike_only_through_the_original(spark):
    """Each copy is 0.85 like the original, copies about 0.73 like each other."""
    rng = random.Random(5)
    base = words(rng, 304, "abcdefghijkl").split()
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        copy = list(base)
        for k in range(5):
            copy[rng.randrange(60 * k + 5, 60 * k + 55)] = words(rng, 1)
        rows.append((i, " ".join(copy)))
    got = omh.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.class_size) for r in got} == {(0, 60)}


def test_bins_bound_the_likeness():
    rng = np.random.default_rng(4)
    seqs = [rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (1, 30, 100, 100)]
    seqs += [np.concatenate([seqs[2][:k], rng.integers(0, 1 << 64, 100 - k, dtype=np.uint64)]) for k in (50, 88, 89, 95)]
    seqs.append(np.zeros(1 << 16, np.uint64))  # overflows its bin
    sizes, bins = np.array([len(x) for x in seqs]), [omh.binned((x >> np.uint64(32)).astype("<u4")) for x in seqs]
    kept = omh.bounds(sizes, bins, sizes, bins) > 0
    assert all(kept[i, j] for i, a in enumerate(seqs) for j, b in enumerate(seqs) if omh.alike(a, b) >= 0.8)
    assert not kept[2, 3] and not kept[2, 1] and kept[-1, -1] and bins[-1] == b""


def test_banded_alignment_equals_full(spark):
    rng = random.Random(2)
    for _ in range(200):
        a = np.array([rng.randrange(6) for _ in range(rng.randint(1, 30))])
        b = np.array([rng.randrange(6) for _ in range(rng.randint(1, 30))])
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        common = table[-1, -1]
        assert omh.banded_common(a, b, max(len(a), len(b))) == common
        want = common / (len(a) + len(b) - common)
        if want >= 0.8:
            assert omh.alike(a, b) == pytest.approx(want)
        else:
            assert omh.alike(a, b) < 0.8


def test_bound_of_pairs_loses_no_alike_texts_of_any_length():
    rng = np.random.default_rng(5)
    base, seqs = rng.integers(0, 1 << 32, 5000, dtype=np.uint32), [np.full(300, 7, np.uint32)]
    for n in (1, 5, 500, 520, 1000, 1100, 2047, 2300, 4900):
        for share in (0, 0.05, 0.1, 0.3):
            seq = base[:n].copy()
            seq[rng.choice(n, int(n * share), False)] = rng.integers(0, 1 << 32, int(n * share), dtype=np.uint32)
            seqs.append(seq)
    sizes, bins = np.array([len(x) for x in seqs]), [omh.binned(x) for x in seqs]
    kept = omh.bounds(sizes, bins, sizes, bins) > 0
    alike = np.array([[omh.alike(a, b) >= omh.LIKENESS for b in seqs] for a in seqs])
    assert not bins[0] and not (alike & ~kept).any()
    assert (kept & ~alike)[1:, 1:].mean() < 0.1


def test_pairs_of_a_bucket_in_blocks_of_any_size(spark, monkeypatch):
    """Whatever the blocks are, the classes are those of all pairs that share an entry."""
    rng = random.Random(11)
    base = words(rng, 120).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(i % 6):
            w[rng.randrange(120)] = words(rng, 1)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    told = []
    for block, shingles in ((256, 1 << 18), (7, 1 << 18), (256, 900)):
        monkeypatch.setattr(omh, "BLOCK", block)
        monkeypatch.setattr(omh, "BLOCK_SHINGLES", shingles)
        told.append(sorted((r.doc_id, r.class_id) for r in omh.near_duplicate_classes(df).collect()))
    assert told[0] == told[1] == told[2]
    pairs = [(i, j) for i, x in rows for j, y in rows[:i] if jaccard(x, y) >= 0.85]
    of = dict(told[0])
    assert len(pairs) > 100 and all(of[i] == of[j] for i, j in pairs)


def test_judged_pairs_join_each_two_classes_once():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 32, 200, dtype=np.uint32)
    x = []
    for _ in range(12):
        s = base.copy()
        s[rng.choice(200, 4, False)] = 0
        x.append(s)
    x.append(rng.integers(0, 1 << 32, 200, dtype=np.uint32))
    k, e = np.arange(13), np.tile(np.arange(16), (13, 1))
    links = list(omh.judged(0, (k, k, e, x), (k, k, e, x), True))
    assert len(links) == 11 and {y for a, b, _ in links for y in (a, b)} == set(range(12))
    # The pairs share entry 0, so no other bucket judges them.
    assert not list(omh.judged(5, (k, k, e, x), (k, k, e, x), True))
    assert not list(omh.judged(0, (k, k * 0, e, x), (k, k * 0, e, x), True))


def test_near_duplicates_odd_rows(spark, odd, empty):
    rows = omh.near_duplicate_classes(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.class_id)
    assert by[6] == {6} | by[6] and by[7] == {6} and by[8] == {6} and by[None] == {6} and by[0] == by[1] == {0}
    assert omh.near_duplicate_classes(empty).count() == 0


# 2


def test_fingerprints_of_edited_neighbours(spark, sample):
    got = {r.doc_id: r for r in QUERIES["op2_multiset_hash"](spark, SF).collect()}
    order = sorted(sample, reverse=True)
    prints = {}
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(r.fingerprint, sorted(t.split("\n"))) == sorted(t.split("\n"))
        assert r.edited_fingerprint == multiset.hexed(multiset.states([edited])[0])[0]
        assert (r.near_next == 1) == (r.fingerprint == got[order[(k + 1) % len(order)][0]].fingerprint)
    near, far = [r.near_edited for r in got.values()], [r.near_next for r in got.values()]
    assert np.mean(near) > np.mean(far) + 0.3


def test_fingerprints_are_homomorphic():
    a, b = ["one para", "two", ""], ["three", "two"]
    both = multiset.states(["\n".join(b + a)])
    one = multiset.states(["\n".join(a)])
    added = multiset.insert((one[0][0], one[1][0]), b)
    assert (added[0] == both[0][0]).all() and (added[1] == both[1][0]).all()
    back = multiset.delete(added, b)
    assert (back[0] == one[0][0]).all() and (back[1] == one[1][0]).all()


def test_fingerprints_odd_rows(spark, odd, empty):
    rows = multiset.edited_neighbours(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert multiset.edited_neighbours(empty).count() == 0
    assert multiset.edited_neighbours(odd.filter("doc_id = 4")).collect()[0].near_next == 1
    out = multiset.fingerprint_documents(odd.withColumn("other", F.lit(1)))
    assert out.count() == odd.count() and set(odd.columns) < set(out.columns)


# 3

PERSONAL = [
    (1, "Write to anna.b7@mail5.example.com or call +1 (743) 555-3824 now."),
    (2, "Card 4785380592391139, host 227.5.221.1. Again anna.b7@mail5.example.com!"),
    (3, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" Herr Klaus Meyer, Frau Meyer and Госпожа Иванова'),
    (4, "Nothing here, 12.5 or 2020."),
    (5, None),
    (6, ""),
    (None, "ssn 123-45-6789 iban DE89370400440532013000 visa 4111 1111 1111 1111"),
]


def luhn(s: str) -> int:
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10


def test_surrogates(spark):
    rows = spark.createDataFrame(PERSONAL, "doc_id long, text string").withColumn("kinds", F.lit("clash"))
    got = {r.doc_id: r for r in surrogate.pseudonymised(rows, "key").collect()}
    again = {r.doc_id: r.text for r in surrogate.pseudonymised(rows, "key").collect()}
    other = {r.doc_id: r.text for r in surrogate.pseudonymised(rows, "another").collect()}
    assert {i: r.text for i, r in got.items()} == again and other[1] != again[1]
    assert got[4].text == PERSONAL[3][1] and got[5].text is None and got[6].text == "" and got[5].n_entities == 0
    assert list(got[1].kinds) == ["email", "phone"] and list(got[3].kinds) == ["secret", "name", "name", "name"]
    for secret in ("anna.b7", "mail5", "555-3824", "4785380592391139", "227.5.221.1", "24be64439e3e", "Klaus", "Meyer", "Иванова", "123-45-6789", "DE89370400440532013000", "4111 1111"):
        assert not any(secret in (r.text or "") for r in got.values())
    mail = got[1].text.split()[2]
    assert mail in got[2].text and mail.count(".") == 3 and mail.endswith(".com")
    assert got[1].text.split("call ")[1][:3] == "+1 "
    card = got[2].text.split()[1].rstrip(",")
    assert len(card) == 16 and luhn(card) == luhn("4785380592391139") and card[0] == "4"
    host = got[2].text.split("host ")[1].split(" ")[0].rstrip(".")
    assert all(0 <= int(o) <= 255 for o in host.split("."))
    names = got[3].text.split('" ')[1]
    given = names.split()[1]
    assert names.startswith("Herr ") and given in surrogate.GIVEN["latin", "m"] and "Госпожа " in names
    assert all("а" <= c <= "я" for c in names.split("Госпожа ")[1].lower())
    assert not surrogate.pseudonymised(rows.filter("false"), "key").count()


def test_surrogates_stay_distinct(spark):
    for kind, made in (("phone", "+1 (100) 555-{:04d}"), ("family", "Smith{:d}"), ("domain", "host{:d}.com"), ("local", "a{:03d}")):
        given = [made.format(i) for i in range(1500)]
        out = surrogate.surrogates(spark.createDataFrame([(kind, x) for x in given], "kind string, part string"), "k").collect()
        assert len({r.surrogate for r in out}) == 1500 and not {r.surrogate for r in out} & set(given)


def rest_of_97(iban: str) -> int:
    x = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def test_parts_keep_coreference(spark):
    rows = [
        (1, "Herr Klaus Meyer met Frau Meyer and Herr. Meyer."),
        (2, "Mr Smith, Mr. Smith and Mr John Smith; Mrs Smith"),
        (3, "Господин Иванов и Господин Антон Иванов, Госпожа Иванова"),
        (4, "a.b@one.org c.d@one.org a.b@two.net"),
        (5, "DE89370400440532013000 and GB82 WEST 1234 5698 7654 32"),
    ]
    got = {r.doc_id: r.text for r in surrogate.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    w = got[1].replace(".", "").split()
    assert w[2] == w[5] == w[8] != "Meyer" and w[0] == "Herr" and w[1] in surrogate.GIVEN["latin", "m"]
    w = got[2].replace(";", "").replace(",", "").replace(".", "").split()
    assert w[1] == w[3] == w[7] == w[9] != "Smith" and w[6] in surrogate.GIVEN["latin", "m"]
    w = got[3].replace(",", "").split()
    assert w[1] == w[5] != "Иванов" and w[7].endswith("ва") and w[4] in surrogate.GIVEN["cyrillic", "m"]
    x, y, z = (m.split("@") for m in got[4].split())
    assert x[1] == y[1] != z[1] and x[0] == z[0] != y[0] and x[1].endswith(".org") and z[1].endswith(".net")
    one, two = got[5].split(" and ")
    assert rest_of_97(one) == rest_of_97(two) == 1 and one[:2] == "DE" and two[:2] == "GB" and len(two) == len(rows[4][1].split(" and ")[1])
    with pytest.raises(ValueError):
        surrogate.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "")


def test_names_of_many_forms(spark):
    given = "Adrian Bruno Cesar Dario Enzo Fabio Gino Heiko Igor Jan Kai Lars Marco Nils Omar Piet".split()
    rows = [(i, f"Mr {g} Smith") for i, g in enumerate(given)] + [(100 + i, f"Ms {g}a Smith") for i, g in enumerate(given)]
    rows += [
        (200, "Mr O'Brien, Mr. McDonald, Monsieur Jean-Luc Picard; Señor Juan García López."),
        (201, "Frau Hanna von der Leine met Dr Smith, Dr. Anna Meyer and Prof. Meyer"),
        (202, "call (212) 555-0123 or 212-555-0124, not 12-3456 or 2020-10-1234"),
    ]
    extra = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], "doc_id long, text string, put string, row_key string, found string")
    told = surrogate.pseudonymised(extra, "key").collect()
    got = {r.doc_id: r.text for r in told}
    assert {(r["put"], r.row_key, r.found) for r in told} == {("a", "b", "c")} and len(told) == len(rows)
    for first in (0, 100):
        names = {got[first + i] for i in range(16)}
        assert len(names) == 16 and len({n.split()[2] for n in names}) == 1
    assert got[0].split()[2] == got[100].split()[2] == got[201].split("Dr ")[1].split(",")[0]
    assert all(n.split()[1].endswith("a") for i, n in got.items() if 100 <= i < 116)
    assert not any(x in got[200] for x in ("Brien", "Donald", "Jean", "Luc", "Picard", "Juan", "García", "López"))
    assert " von der " in got[201] and not any(x in got[201] for x in ("Hanna", "Leine", "Smith", "Anna", "Meyer"))
    assert got[201].split("Prof. ")[1] == got[201].split("Dr. ")[1].split()[1]
    assert "555" not in got[202][:30] and got[202].endswith("not 12-3456 or 2020-10-1234") and got[202][5] == "(" and got[202][9:11] == ") "


def test_surrogates_over_the_table(spark, sample):
    """Independent of the operator's patterns: what surrounds plain addresses and long digit runs stays, they go."""
    import re

    mail, digits = re.compile(r"[\w.+-]+@[\w-]+\.[a-z]+"), re.compile(r"(?<!\d)\d{16}(?!\d)")
    got = {r.doc_id: r for r in QUERIES["op3_surrogates"](spark, SF).collect()}
    assert len(got) == len(sample)
    to, seen = {}, 0
    for i, t in sample:
        old, new = mail.findall(t), mail.findall(got[i].text)
        assert len(old) == len(new) and len(digits.findall(t)) == len(digits.findall(got[i].text))
        assert not set(old) & set(new) and not any(x in got[i].text for x in digits.findall(t))
        for a, b in zip(old, new, strict=True):
            assert to.setdefault(a.rstrip("."), b.rstrip(".")) == b.rstrip(".")
        seen += len(old)
        if not re.search(r"[@\d]", t) and "Mr" not in t and "Herr" not in t and "Frau" not in t:
            assert got[i].text == t or got[i].n_entities
    assert seen and len(set(to.values())) == len(to)


def test_surrogates_odd_rows(spark, odd, empty):
    text = "mail a@b.com " * 5_000
    docs = odd.unionByName(spark.createDataFrame([(90, text, None, None, 1), (90, text, None, None, 1)], SCHEMA)).withColumn("n_entities", F.lit("clash"))
    rows = surrogate.pseudonymised(docs, "k").collect()
    assert len(rows) == docs.count()
    long = [r for r in rows if r.doc_id == 90]
    assert long[0] == long[1] and long[0].n_entities == 5_000 and len(set(long[0].text.split())) == 2
    assert surrogate.pseudonymised(empty, "k").count() == 0


# 4 and 5


def held(i: int, n: int) -> int:
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize(("sf", "name", "label", "threshold", "caught"), [("0.01", "op4_boosted_trees", "quality", 0.5, 0.95), ("0.1", "op5_subword_softmax", "toxic", 0.7, 0.75)])
def test_classifiers_on_held_out_rows(spark, sf, name, label, threshold, caught):
    sf = f"/root/testdata/sf{sf}"
    rows = {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in rows and r[label] is not None}
    assert all(r.held_out == (held(i, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for i, r in rows.items())
    found = {x: [rows[i].predicted for i, y in truth.items() if y == x and rows[i].held_out] for x in (0, 1)}
    assert np.mean(found[1]) >= caught and np.mean(found[0]) <= 0.02 and len(found[0]) > 10


def test_misspellings_of_toxic_words():
    """Unseen misspellings share most n-grams with the words they are made from."""
    rng = random.Random(5)
    bad = ["grumblefoot", "snarkweasel", "blitherskunk"]
    texts = [words(rng, 60) + (f" {rng.choice(bad)} {rng.choice(bad)}" if i % 3 == 0 else "") for i in range(600)]
    y = np.array([i % 3 == 0 for i in range(600)], np.int64)
    bucket, share, row = toxicity.bags(texts)
    ends = np.searchsorted(row, np.arange(len(texts) + 1))
    model = toxicity.train([bucket[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], [share[a:b].astype(np.float32) for a, b in zip(ends[:-1], ends[1:], strict=True)], y)
    plain = [words(rng, 60) for _ in range(50)]
    wrong = [t + " grumblefooot snarkweasell" for t in plain]
    assert (model.scores(wrong) > model.scores(plain)).all() and np.mean(model.scores(wrong) > 0.7) > 0.9 and np.mean(model.scores(plain) > 0.7) < 0.05


def test_classifiers_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2 if i % 3 else None, i % 2) for i in range(16)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        rows = f(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert f(empty, labels).count() == 0
        assert {r.score for r in f(odd, labels.filter("false")).collect()} == {0.5}


def test_trees_by_plain_descent():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.FEATURES))).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    t = quality.grow(x, y, rounds=20)
    for k in range(20):
        total = t.base
        for f, th, leaf in zip(t.feature, t.threshold, t.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[k, f[node]] > th[node])
            total += leaf[node - len(f)]
        assert t.scores(x[k : k + 1])[0] == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((t.scores(x) > 0.5) == (y == 1)).mean() > 0.9


def test_statistics_by_plain_count():
    from actmill.llm.arrays import utf8
    import pyarrow as pa

    texts = ["Abc def. abc\nline two, x9 ##\nline two, x9 ##", "", "É é|b !"]
    got = quality.statistics(*utf8(pa.array(texts)))
    f = {n: got[0, i] for i, n in enumerate(quality.FEATURES)}
    n_words = len(texts[0].split())
    assert f["distinct_words"] == pytest.approx(len(set(texts[0].split())) / n_words)
    assert f["distinct_lines"] == pytest.approx(2 / 3) and f["symbols"] == pytest.approx(4 / n_words)
    assert f["upper"] == pytest.approx(1 / sum(c.isalpha() for c in texts[0]))
    assert np.isfinite(got).all() and got[1, 0] == 0


def test_subwords_by_plain_count():
    texts = ["ab, abc", "", "x", "abc ab", "жук\nжук"]
    bucket, of = toxicity.subwords(texts)
    n = [sum(max(len(w) + 2 - k + 1, 0) for w in t.replace(",", "").split() for k in (3, 4, 5, 6)) + len(t.split()) for t in texts]
    assert np.bincount(of, minlength=5).tolist() == n
    assert sorted(bucket[of == 0]) == sorted(bucket[of == 3])
    assert toxicity.subwords([])[0].size == 0


# 6


def test_languages_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op6_kneser_ney"](spark, sf).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.held_out == (held(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    right = [truth[r.doc_id] == r.lang_pred for r in rows if r.held_out]
    assert np.mean(right) > 0.98 and not any(r.rejected for r in rows)


def plain_kneser_ney(texts: list[str]):
    """Interpolated Kneser-Ney by dictionaries; p(context, character) for contexts of up to three characters."""
    cp, counts = langid.characters(texts)
    ends = np.cumsum(counts)
    level = {4: Counter(tuple(cp[i : i + 4].tolist()) for e, n in zip(ends, counts, strict=True) for i in range(e - n, e - 3))}
    for o in (3, 2, 1):
        level[o] = Counter(g[1:] for g in level[o + 1])
    symbols = len(level[1]) + 1

    def p(context: tuple, c: int) -> float:
        o = len(context) + 1
        n1, n2 = (sum(v == x for v in level[o].values()) for x in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        own = {g: v for g, v in level[o].items() if g[:-1] == context}
        low = p(context[1:], c) if context else 1 / symbols
        total = sum(own.values())
        return max(own.get((*context, c), 0) - d, 0) / total + d * len(own) / total * low if total else low

    return p, sorted(g[0] for g in level[1])


def test_kneser_ney_by_dictionaries(spark):
    rng = random.Random(4)
    texts = {x: [words(rng, 60, letters) for _ in range(5)] for x, letters in (("x", "abcd"), ("y", "cdefé"))}
    train = spark.createDataFrame([(t, x) for x, own in texts.items() for t in own], "text string, lang string")
    model = langid.fit(train)
    assert model.languages == ["x", "y"] and len(model.blocks) == 1
    probes = [*texts["x"][:2], "abab dede", "zzz a éé", "ab", "Ω"]
    h, n = model.entropies(probes)
    old, langid.BLOCK_ROWS = langid.BLOCK_ROWS, 150
    try:
        several = langid.fit(train)
    finally:
        langid.BLOCK_ROWS = old
    assert len(several.blocks) > 3 and np.allclose(several.entropies(probes)[0], h, atol=1e-4)
    docs = spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string")
    one, many = ({r.doc_id: (r.lang_pred, round(r.score, 4)) for r in langid.with_language(docs, m).collect()} for m in (model, several))
    assert one == many and [one[i][0] for i in range(3)] == ["x", "x", one[2][0]]
    for k, x in enumerate(model.languages):
        p, seen = plain_kneser_ney(texts[x])
        for head in ("abc", " cd", "dda", "éf "):
            total = sum(p(tuple(map(ord, head)), c) for c in seen)
            assert 0.97 < total <= 1.0001  # the rest is for unseen characters
        # The alphabet of all languages is one wider than that of one language.
        wide = len(set(plain_kneser_ney(texts["x"])[1]) | set(plain_kneser_ney(texts["y"])[1])) + 1
        for t, bits in zip(probes, h[:, k], strict=True):
            cp, _ = langid.characters([t])
            c = cp.tolist()
            spots = range(3, len(c)) if len(c) > 3 else range(len(c))
            logs = [np.log2(_wide(p, tuple(c[max(i - 3, 0) : i]) if len(c) > 3 else (), c[i], len(seen) + 1, wide)) for i in spots]
            assert abs(-sum(logs) / len(logs) - bits) < 1e-3


def _wide(p, context: tuple, c: int, own: int, wide: int) -> float:
    """p with the share of unseen characters spread over a wider alphabet."""
    unseen = p((), -1)
    for k in range(len(context)):
        unseen *= p(context[k:], -1) / p(context[k + 1 :], -1)
    return p(context, c) - unseen + unseen * own / wide


def test_language_limits(spark):
    """Texts of other scripts, and of letters drawn at random, are in none of the languages; the tables' texts are."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs.filter(langid.fold(4) != 2).select("text", "lang"))
    rng = random.Random(8)
    strange = ["Η γλώσσα των ανθρώπων είναι παλιά και πολύ όμορφη", "東京は日本の首都であり大きな都市です", words(rng, 30, "bcdfghjklmnpqrstvwxz"), words(rng, 30, "qxzjkvw")]
    got = {r.doc_id: r for r in langid.with_language(spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string"), model).collect()}
    assert all(r.rejected and r.score < 0.5 for r in got.values())


def test_languages_calibrated_on_all_texts(spark):
    """Means, spreads, limits and the temperature are those of all different training texts, however many there are."""
    rng = random.Random(12)
    rows = [(words(rng, rng.randrange(1, 9), letters), x) for x, letters in (("x", "abcd"), ("y", "cdefé"), ("z", "abcdefé")) for _ in range(2500)]
    rows += [(words(rng, 3, "qrstuvw"), "x") for _ in range(20)] + rows[:1000] + [("...", "y"), ("", "x")]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    different = sorted(set(rows))
    h, n = model.entropies([t for t, _ in different])
    langs = np.array([model.languages.index(x) for _, x in different])[n > 0]
    h, n = h[n > 0], n[n > 0]
    own, root = h[np.arange(len(h)), langs], np.sqrt(np.minimum(n, langid.LONG))
    assert len(h) > 5000
    for i in range(3):
        mine = langs == i
        ordered = lambda v, share: np.sort(v)[int(np.ceil(share * len(v))) - 1]
        assert abs(model.mean[i] - np.average(own[mine], weights=root[mine])) < 1e-6
        middle = ordered(np.abs(own[mine] - model.mean[i]) * root[mine], 0.5)
        assert abs(model.spread[i] - max(middle * 1.5, 0.5)) < 1e-4
        far = ordered(model.far(own[mine], langs[mine], n[mine]), 0.99)
        assert abs(model.limit[i] - np.clip(langid.MARGIN * far, langid.LEAST_LIMIT, 1)) < 1e-4
    losses = []
    for t in (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0):
        logit = -np.minimum(n, langid.LONG)[:, None] * t * np.log(2) * h
        logit -= logit.max(axis=1, keepdims=True)
        losses.append((np.mean(np.log(np.exp(logit).sum(axis=1)) - logit[np.arange(len(h)), langs]), t))
    assert model.temperature == min(losses)[1]


def test_language_quantiles(spark):
    rng = random.Random(13)
    values = {"x": [rng.gauss(-3, 1) for _ in range(999)] + [400.0], "y": [0.5] * 7, "z": [-1e-4, 2.0]}
    rows = spark.createDataFrame([(x, v) for x, own in values.items() for v in own], "lang string, v double")
    args = ({x: len(v) for x, v in values.items()}, {x: min(v) for x, v in values.items()}, {x: max(v) for x, v in values.items()})
    for share in (0.0, 0.5, 0.99, 1.0):
        got = langid._quantile(rows, F.col("v"), share, *args)
        for x, v in values.items():
            want = sorted(v)[max(int(np.ceil(share * len(v))), 1) - 1]
            assert 0 <= want - got[x] < 1 / langid.FINE


def test_languages_odd_rows(spark, odd, empty):
    rows = langid.predicted_languages(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (0, 1, 2, 3))
    assert by[4].lang_pred != "und"
    assert langid.predicted_languages(empty).count() == 0
    assert {r.lang_pred for r in langid.predicted_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 7


def test_containment_by_brute_force(spark):
    rng = random.Random(8)
    items = [(i, words(rng, n)) for i, n in enumerate((3, 5, 9, 14, 30, 70, 150, 150))] + [(90, ""), (91, None), (0, None)]
    items[7] = (7, items[6][1])
    docs = []
    for k in range(80):
        parts = [words(rng, rng.choice((0, 5, 60, 900)))]
        item = items[k % 8][1].split()
        if k % 5 == 1 and len(item) > 12:
            item[len(item) // 2] = "changed"
        parts.append(" ".join(item if k % 3 else item[: len(item) // 2]))
        parts.append(words(rng, rng.choice((0, 7, 300))))
        docs.append((k, " ".join(p for p in parts if p)))
    docs += [(200, None), (201, ""), (202, items[0][1].upper())]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    want = {i: sorted(j for j, q in items if shingles(q) and len(shingles(q) & shingles(t)) >= 0.8 * len(shingles(q)) - 1e-9) for i, t in docs}
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: list(r.item_ids) for r in decontam.contained_items(d, q).collect()} == want
    assert any(want.values())
    old = decontam.BLOCK_BYTES
    decontam.BLOCK_BYTES = 300
    try:
        assert {r.doc_id: list(r.item_ids) for r in decontam.contained_items(d, q).collect()} == want
    finally:
        decontam.BLOCK_BYTES = old


def test_tiny_items_inside_long_texts(spark):
    """Items of one to four shingles are found in every text that holds them."""
    rng = random.Random(12)
    items = [(i, " ".join(f"tiny{i}x{j}" for j in range(i + 4))) for i in range(1, 5)]
    docs = [(k, f"{words(rng, 40)} {items[k % 4][1]} {words(rng, 40)}") for k in range(1200)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert all(list(r.item_ids) == [items[r.doc_id % 4][0]] for r in decontam.contained_items(d, q).collect())


def test_containment_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, "one two three")], "item_id long, text string")
    out = decontam.with_items(odd.withColumn("item_ids", F.lit("clash")), items)
    assert out.count() == odd.count()
    assert [r.doc_id for r in out.filter(F.size("item_ids") > 0).collect()] == [5]
    assert decontam.contained_items(empty, items).count() == 0 and decontam.contained_items(odd, items.filter("false")).count() == odd.count()


# 8


def plain_windows(a: list[str]) -> list[tuple[int, int]]:
    """(start, lines) of the least runs that count."""
    n = [len(x.split()) for x in a]
    out = [(i, 3) for i in range(len(a) - 2)] + [(i, 1) for i in range(len(a)) if n[i] >= 50]
    return out + [(i, 2) for i in range(len(a) - 1) if max(n[i : i + 2]) < 50 <= n[i] + n[i + 1]]


def plain_lines(rows: list[tuple]) -> dict:
    """By (doc_id, text): what is left."""
    docs = sorted({(i is None, i or 0, t) for i, t in rows if t is not None})
    seen, out = {}, {}
    for d in docs:
        a = d[2].split("\n")
        for i, n in plain_windows(a):
            seen[tuple(a[i : i + n])] = min(seen.get(tuple(a[i : i + n]), (d, i)), (d, i))
    for d in docs:
        a = d[2].split("\n")
        gone = {i + k for i, n in plain_windows(a) if seen[tuple(a[i : i + n])] != (d, i) for k in range(n)}
        out[None if d[0] else d[1], d[2]] = "\n".join(x for i, x in enumerate(a) if i not in gone)
    return out


def test_long_passages_of_one_or_two_lines(spark):
    rng = random.Random(12)
    one, two = words(rng, 55), words(rng, 30) + "\n" + words(rng, 25)
    short = words(rng, 40)
    rows = [(1, one), (2, "head\n" + one + "\ntail"), (3, "x\n" + two), (4, two + "\ny"), (5, short), (6, "z\n" + short), (7, one)]
    got = {r.doc_id: r.text for r in linededup.lines_deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: one, 2: "head\ntail", 3: rows[2][1], 4: "y", 5: short, 6: rows[5][1], 7: ""}
    assert got == {i: t for (i, _), t in plain_lines(rows).items()}


def test_many_lines_take_seconds(spark):
    import time

    text = "\n".join(f"line {i % 9000} of a long text" for i in range(32_000))
    docs = spark.createDataFrame([(1, text), (2, "a\nb")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_deleted) for r in linededup.lines_deduplicated(docs).collect()}
    assert got == {1: (32_000, 23_000), 2: (2, 0)} and time.time() - began < 20


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice("abcde") for _ in range(rng.randint(0, 12)))) for i in range(120)] + [(500, None)]
    want = plain_lines(rows)
    got = linededup.lines_deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        t = dict(rows)[r.doc_id]
        assert r.text == (None if t is None else want[r.doc_id, t])


def test_line_dedup_odd_rows(spark, odd, empty):
    own = {c: F.lit(c) for c in ("deleted", "lines", "row_key", "_lines", "doc", "w")}
    kept = linededup.lines_deduplicated(odd.withColumns(own)).collect()
    assert len(kept) == odd.count() and {tuple(r[c] for c in own) for r in kept} == {tuple(own)}
    out = linededup.lines_deduplicated(odd.withColumn("n_lines", F.lit("clash")))
    assert out.count() == odd.count() and set(odd.columns) < set(out.columns)
    by = {r.doc_id: r for r in out.filter("doc_id is not null").collect()}
    assert by[10].text == "start\nend" and by[9].n_deleted == 0 and by[0].text is None and by[0].n_lines == 0
    assert linededup.lines_deduplicated(empty).count() == 0


# 9


def test_tokens_equal_the_library(spark, odd, sample):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    extra = ["Hello<|endoftext|>WORLD it's <|startoftext|>", "ΣΑΣ Σ", "½ ² ٣ x\x1cy z", "é ẛ̣ İ", "<| x 's 's", "a  b\x85c"]
    rows = [(i, t) for i, t in sample] + [(10_000 + i, t) for i, t in enumerate(extra)] + [(20_000 + k, t[1]) for k, t in enumerate(odd_rows())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.with_tokens(df, path).collect()}
    digest = {r.doc_id: r for r in bpe.with_tokens(df, path, digests=True).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert list(got[i].ids) == ids and got[i].decoded == decoded and got[i].n_tokens == len(ids)
        assert digest[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digest[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.with_tokens(df.filter("false"), path).count() == 0


def test_lexicon_is_minimal_and_exact():
    ws = {w.encode(): [i, i + 1] for i, w in enumerate(("walking", "talking", "walk", "talk", "talks", "é"))}
    compiled = bpe.compile_lexicon(ws)
    lex = bpe.Lexicon(compiled)
    assert all(lex.get(w) == ids for w, ids in ws.items()) and lex.get(b"tal") is None and lex.get(b"walks") is None
    suffix = bpe.compile_lexicon({a + b"ing": [1] for a in (b"walk", b"talk", b"balk")})
    assert np.frombuffer(suffix, "<u4")[0] == 8
    empty = bpe.Lexicon(bpe.compile_lexicon({}))
    assert empty.get(b"a") is None


def test_long_words_merge_as_short_ones():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        v = bpe.Vocabulary(f.read())
    rng = random.Random(1)
    for _ in range(50):
        w = "".join(rng.choice("abcdeinrst") for _ in range(60)).encode()
        ids = [*(v.inner[c] for c in w[:-1]), v.last[w[-1]]]
        assert v._merge_long(list(ids)) == v._merge_short(list(ids))


# 10


def plain_repeats(texts: list[bytes], n: int = sufdedup.LENGTH) -> list[tuple]:
    count = Counter(t[p : p + n] for t in texts for p in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if count[t[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_strings_by_brute_force(spark, sample):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op10_interval_expansion"](spark, SF).collect()}
    want = dict(zip([i for i, _ in sample], plain_repeats([t.encode() for _, t in sample]), strict=True))
    assert got == want and any(v[1] for v in want.values())


def test_repeated_strings_planted(spark):
    rng = random.Random(9)
    passage = words(rng, 90)
    texts = [words(rng, rng.randint(0, 80)) + " " + passage[rng.randint(0, 80) : rng.randint(250, len(passage))] + words(rng, rng.randint(0, 80)) for _ in range(40)]
    texts += ["ab" * 400, "ab" * 150 + "c", "x" * 199, "y" * 200, "y" * 200, "", "é" * 130 + passage, passage]
    rows = list(enumerate(texts))
    want = plain_repeats([t.encode() for t in texts])
    for crowd in (sufdedup.CROWD_BYTES, 500):
        old, sufdedup.CROWD_BYTES = sufdedup.CROWD_BYTES, crowd
        try:
            got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sufdedup.repeated_strings_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        finally:
            sufdedup.CROWD_BYTES = old
        assert [got[i] for i, _ in rows] == want


def test_long_texts_are_taken_in_pieces():
    from actmill.llm.arrays import utf8
    import pyarrow as pa

    rng = random.Random(2)
    text = words(rng, 4000)
    old, sufdedup.PIECE_BYTES = sufdedup.PIECE_BYTES, 1500
    try:
        cut = sufdedup.segments(*utf8(pa.array(["", text, text[:700]])))
    finally:
        sufdedup.PIECE_BYTES = old
    covered = sorted(s + k for d, s, w in zip(cut[0], cut[3], cut[4], strict=True) if d == 1 for k in range(w))
    assert covered == list(range(len(text) - sufdedup.LENGTH + 1))


def test_repeated_strings_odd_rows(spark, odd, empty):
    rows = sufdedup.repeated_strings_removed(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id != 6}
    assert by[0].n_bytes == 0 and by[7].n_removed == by[7].n_bytes and by[13].n_removed == 5000
    assert sufdedup.repeated_strings_removed(empty).count() == 0
