"""Alignment of two tokenizers against a plain version that walks token by token and uses the tokenizers library."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tables
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from actmill.llm import alignment as al
from conftest import SF

BYTES, PIECES = tables.path("byte_bpe_50k.json"), tables.path("piece_bpe_32k.model")
ODD = [
    (None, "ab c"), (1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "<|endoftext|> <s></s> <0x41>"), (6, "x\0y"), (7, "é́ 😀\n\n\t  z"), (7, "é́ 😀\n\n\t  z"), (8, "a" * 5000),
    (9, "🜁" * 300 + " 　 "), (10, "﻿bom\u0085\u001c"), (11, "漢字かな交じり文 ру́сский"), (12, "  lead and trail  "), (13, "can't WE'LL 12345 ½²"),
]


def library() -> Tokenizer:
    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    return t


def plain(rows: list[tuple]) -> list[tuple]:
    letters, enc, model = al.byte_letters(), library(), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocab = {i: bytes(letters[c] for c in s) for s, i in enc.get_vocab().items() if all(c in letters for c in s)}
    counts, docs = Counter(), []
    for key, text in rows:
        groups, links, n_a, n_b = [], [], 0, 0
        if text:
            a, b = enc.encode(f" {text}", add_special_tokens=False).ids, model.encode(text)
            raw_a = [vocab[x] for x in a]
            raw_b = [bytes([int(model.id_to_piece(x)[3:5], 16)]) if model.is_byte(x) else model.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if b"".join(raw_a) == b"".join(raw_b) == f" {text}".encode():
                n_a, n_b = len(a), len(b)
                at_a, at_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
                i = j = 0
                for end in sorted(set(at_a) & set(at_b)):
                    i2, j2 = at_a.index(end, i) + 1, at_b.index(end, j) + 1
                    groups.append((a[i:i2], b[j:j2]))
                    for x in range(i, i2):
                        for y in range(j, j2):
                            if at_a[x] - len(raw_a[x]) < at_b[y] and at_b[y] - len(raw_b[y]) < at_a[x]:
                                links.append((a[x], b[y]))
                    i, j = i2, j2
        counts.update(links)
        docs.append((key, n_a, n_b, groups, links))
    most: dict[int, int] = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    said = lambda groups: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return [
        (key, n_a, n_b, len(groups), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(said(groups).encode()).hexdigest() if groups else "")
        for key, n_a, n_b, groups, links in docs
    ]


def test_documents_in_blocks_of_any_size(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = sorted(plain(list(map(tuple, docs.collect()))))
    assert sorted(map(tuple, al.token_alignment(docs, BYTES, PIECES).collect())) == want
    assert sorted(map(tuple, al.token_alignment(docs.repartition(3), BYTES, PIECES, 5000).collect())) == want


def test_odd_texts_and_clashing_columns(spark):
    df = spark.createDataFrame([(i, t, "x", 2) for i, t in ODD], "doc_id long, text string, block string, pairs int")
    assert sorted(map(repr, map(tuple, al.token_alignment(df, BYTES, PIECES).collect()))) == sorted(map(repr, plain(ODD)))
    assert al.token_alignment(df.filter("false"), BYTES, PIECES).count() == 0


def test_ranks_say_what_the_library_says():
    enc, ours = library(), al.byte_level(BYTES)[0]
    letters = [chr(c) for c in [*range(0x3000), *range(0x3000, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    texts = [f" a{c}b {c}1{c}{c} {c}'s\n" for c in letters]
    for text, e in zip(texts, enc.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ours.encode_to_numpy(text).tolist() == e.ids, text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.randoms(use_true_random=False))
def test_links_and_components_of_random_divisions(sizes, rng):
    ends_a = np.cumsum(sizes)
    size = int(ends_a[-1])
    ends_b = np.array(sorted({size, *(rng.randint(1, size) for _ in range(rng.randint(0, size)))}))
    a, b = al.links_of(ends_a, ends_b)
    spans = [list(zip([0, *e[:-1]], e, strict=True)) for e in (ends_a.tolist(), ends_b.tolist())]
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(i, j) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]]
    root_a, root_b = al.components(a, b, len(ends_a))
    common = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    of = lambda ends: [next(k for k, c in enumerate(common) if e <= c) for e in ends.tolist()]
    ranks = {r: k for k, r in enumerate(np.unique(root_a).tolist())}
    assert [ranks[r] for r in root_a.tolist()] == of(ends_a)
    assert [ranks[r] for r in root_b.tolist()] == of(ends_b)


def test_a_long_chain_has_one_root():
    ends_a = np.append(np.arange(2, 20_001, 2), 20_001)
    ends_b = np.arange(1, 20_002, 2)
    a, b = al.links_of(ends_a, ends_b)
    root_a, root_b = al.components(a, b, len(ends_a))
    assert set(root_a.tolist()) == set(root_b.tolist()) == {0}
