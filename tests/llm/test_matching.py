"""Exact copies, ranked search and token alignment against brute force on small inputs, with odd rows in each."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logveil.llm import alignment, copies, search
from tests.llm.test_operators import docs_of, empty, odd


# --- exact copies ----------------------------------------------------------------

def copies_by_hand(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = sorted(ids, key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, known[0], len(ids), k == 0, sha) for k, i in enumerate(known)]
    return sorted(out, key=repr)


@pytest.fixture
def small_batches(spark):
    """Tasks see their rows in many Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_exact_copies(spark, small_batches):
    rows = odd(spark) + [(200, "a  b\tc"), (201, "a b c"), (202, "a b c "), (203, "a\x0b\nb\x85c"), (204, "a b\x85c"), (205, "x y"),
                         (206, "x y"), (207, None), (208, "\n"), (209, " "), (300, "long " * 60_000), (301, "long  " * 60_000)]
    rows += [(1000 + i, "one text in many copies") for i in range(700)] + [(5, "one text in many copies")] * 3
    random.Random(1).shuffle(rows)
    docs = docs_of(spark, rows).repartition(13)
    found = sorted((tuple(r) for r in copies.exact_copies(docs).collect()), key=repr)
    assert found == copies_by_hand(rows)
    kept = copies.drop_copies(docs)
    assert kept.columns == docs.columns
    assert set(kept.select("doc_id", "text").collect()) <= set(rows)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in copies_by_hand(rows) if r[3])
    assert copies.exact_copies(empty(spark)).count() == 0 and copies.drop_copies(empty(spark)).count() == 0


def test_runs_keep_texts_apart_whose_digests_agree(spark, small_batches):
    """Entries of one digest but another length or second hash stay two entries at every level."""
    rows = [(b"d" * 32, 1, 7, i, i, 1) for i in range(40)] + [(b"d" * 32, 2, 7, i, i, 1) for i in range(3)] \
        + [(b"d" * 32, 2, 8, None, i, 1) for i in range(5)] + [(b"e" * 32, 2, 7 + 1024 * i, i, i, 1) for i in range(9)]
    runs = spark.createDataFrame(rows, copies._RUN).repartition(11)
    merged = {(r["digest"][:1], r["length"], r["check"]): (r["owner"], r["place"], r["n"]) for r in copies.merged_runs(runs).collect()}
    assert merged == {(b"d", 1, 7): (0, 0, 40), (b"d", 2, 7): (0, 0, 3), (b"d", 2, 8): (None, 0, 5),
                      **{(b"e", 2, 7 + 1024 * i): (i, i, 1) for i in range(9)}}


# --- ranked search ---------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def search_by_hand(docs, items, top=10):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = defaultdict(list)
    for item, text in items:
        wanted[item] += terms_of(text)
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in terms if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


ITEMS = [(1, "An-the on. anthe reon, ANTHE"), (2, "word shared"), (3, ""), (4, None), (5, "shi-ing toé blek nowhere"), (6, "nowhere"), (None, "line of text"),
         (2, "shared again"), (7, "reon " * 40 + "é"), (8, "an")]


@pytest.mark.parametrize("block", [4_000_000, 20])
def test_search(spark, monkeypatch, small_batches, block):
    monkeypatch.setattr(search, "BLOCK_BYTES", block)
    monkeypatch.setattr(search, "CELLS", 50)
    rows = odd(spark) + [(400, "reanon reon\x85reon REÖN reön"), (401, "reon_reon reon1 1reon")]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = sorted((tuple(r) for r in search.search(docs_of(spark, rows).repartition(5), items).collect()), key=repr)
    assert found == search_by_hand(rows, ITEMS)


def test_search_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert search.search(empty(spark), items).count() == 0
    assert search.search(docs_of(spark, [(1, None), (2, "- .")]), items).count() == 0
    assert search.search(docs_of(spark, [(1, "word")]), items.limit(0)).count() == 0
    named = spark.createDataFrame([("q", "Word", 1)], "item_id string, text string, rank int")
    assert [tuple(r) for r in search.search(docs_of(spark, [(None, "word"), (3, "word of"), (3, "word of")]), named).collect()][0][:3] == ("q", 1, None)


# --- alignment -------------------------------------------------------------------

def both():
    return alignment.vocabularies("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")


def aligned_by_hand(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    v, out = both(), []
    for text in texts:
        groups = []
        if text:
            a = a_model.encode(" " + text, add_special_tokens=False).ids
            b = b_model.encode(text)
            if b"".join(v.bytes_a[i] for i in a) == b"".join(v.bytes_b[i] for i in b) == b" " + text.encode():
                ends = [set(np.cumsum([len(table[i]) for i in ids]).tolist()) for table, ids in ((v.bytes_a, a), (v.bytes_b, b))]
                common, parts = sorted(ends[0] & ends[1]), []
                for table, ids in ((v.bytes_a, a), (v.bytes_b, b)):
                    held, at = defaultdict(list), 0
                    for i in ids:
                        at += len(table[i])
                        held[next(k for k, c in enumerate(common) if at <= c) if len(common) < 400 else np.searchsorted(common, at)].append(i)
                    parts.append(held)
                groups = [(parts[0][k], parts[1][k]) for k in range(len(common))]
        out.append(groups)
    count = Counter(p for groups in out for p in {p for a, b in groups for p in product(a, b)})
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    rows = []
    for groups in out:
        links = [p for a, b in groups for p in product(a, b)]
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                     sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
                     hashlib.sha256(spelled.encode()).hexdigest() if groups else ""))
    return rows


TEXTS = ["Hello world, it's 12345 o'clock", "Der Bär lief über die Brücke — naïve façade", "数学は楽しい 🙂🙂 ‍ end", "  two  spaces\n\n\ttab ",
         "<s> and </s> <|endoftext|> <0x41> text", "a ▁ mark", "\u0000nul", "x" * 5000, " " * 3000, "ab " * 400 + "\n" * 50, "", None, "﻿bom",
         "ﬁ ligature ½ Ⅷ", "é é", "lorem ipsum dolor " * 60]


@pytest.mark.parametrize("frequent", [1 << 20, 40])
def test_alignment(spark, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    rows = odd(spark) + list(enumerate(TEXTS, 500))
    found = alignment.digest(alignment.align(docs_of(spark, rows).repartition(4))).collect()
    want = [(i, *r) for (i, _), r in zip(rows, aligned_by_hand([t for _, t in rows]))]
    assert sorted((tuple(r) for r in found), key=repr) == sorted(want, key=repr)
    assert alignment.align(empty(spark)).count() == 0


def test_large_groups_pair_distinct_ids_only(monkeypatch):
    a, b = np.array([5] * 90 + [6, 7, 5]), np.array([1] * 80 + [2] * 20 + [3])
    ends_a, ends_b = np.append(np.arange(92) * 2 + 1, 203), np.append(np.arange(100) * 2 + 2, 203)
    found = alignment.Alignment(a, b, ends_a, ends_b)
    want = alignment.united(*found.links(10)[1:])
    assert want[1].sum() == (found.n_a * found.n_b).sum() > 3 * len(a)
    monkeypatch.setattr(alignment, "LARGE", 3)
    for x, y in zip(alignment.united(*found.links(10)[1:]), want):
        assert x.tolist() == y.tolist()


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 120), max_size=60), st.sets(st.integers(1, 120), max_size=60))
def test_runs_of_equal_ends(a, b):
    a, b = sorted(a | {121}), sorted(b | {121})
    inner_a, inner_b = alignment.inner_tokens(a, b)
    common = set(a) & set(b)
    assert [a[i] for i in range(len(a)) if i not in set(inner_a)] == sorted(common)
    assert [b[i] for i in range(len(b)) if i not in set(inner_b)] == sorted(common)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text("ab \n\t.'9▁é\u00a0\u0085", max_size=40), min_size=1, max_size=6))
def test_alignment_of_any_text(texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    got = [(*r[:4], hashlib.sha256(r[4].encode()).hexdigest() if r[4] else "") for r in alignment.Parts(both()).aligned(texts)]
    assert got == [(*r[:4], r[6]) for r in aligned_by_hand(texts)]


def test_parts_are_forgotten(monkeypatch):
    """Whatever is remembered, a text has the same alignment."""
    want = [r[:5] for r in alignment.Parts(both()).aligned(TEXTS)]
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    parts = alignment.Parts(both())
    assert [next(parts.aligned([t]))[:5] for t in TEXTS] == want
