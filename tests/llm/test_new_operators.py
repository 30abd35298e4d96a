"""Divergence audit, spelling variants and fingerprints against plain Python versions of their definitions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sigloom.llm import fingerprints, source_divergence, spelling_variants
from tests.llm.conftest import SCHEMA


def plain(row):
    return row.doc_id, row.text or "", row.lang or "", row.source or ""


def expect_divergence(rows, min_docs, top=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        groups = {s: counts[lang, s] for x, s in counts if x == lang}

        def prices(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        p = {s: prices(c) for s, c in groups.items()}
        q = prices(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("min_docs,slice_terms", [(2, 5), (4, 1 << 16), (10**6, 3)])
def test_divergence(odd_docs, min_docs, slice_terms):
    found = source_divergence.source_divergence(odd_docs, source_divergence.Settings(min_docs, 10, slice_terms)).collect()
    want = expect_divergence([plain(r) for r in odd_docs.collect()], min_docs)
    assert len(found) == len(want) and set(map(tuple, found)) == want


def test_divergence_of_nothing(no_docs):
    assert source_divergence.source_divergence(no_docs).count() == 0


def test_gallop_and_long_division():
    rng = np.random.default_rng(5)
    for n, m in ((0, 9), (1, 5000), (700, 3000), (300, 300)):
        a, b = (np.sort(rng.choice(6000, k, replace=False)) for k in (n, m))
        x, y = source_divergence.gallop(a, b, 16)
        assert a[x].tolist() == b[y].tolist() == np.intersect1d(a, b).tolist()
    for count, total, terms in ((0, 0, 1), (10**13, 10**14, 10**8), (3, 10, 2), (2**40, 2**50, 7)):
        got = source_divergence._prices(np.array([count]), total, terms)[0]
        assert got == 1 + 10**9 * (count + 2) // (total + 2 * terms)


def misspelt(seed, n):
    """Texts over few long words, with many one-letter variants and some very long words."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÀz") for _ in range(rng.randint(6, 10))) for _ in range(25)] + ["q" * 70, "q" * 69 + "r", "straße" * 2]
    out = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 120)):
            w = rng.choices(base, [1 + 40 * (k % 9 == 0) for k in range(len(base))])[0]
            if rng.random() < 0.15:
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w = w[:at] + (rng.choice("abé") if kind else "") + w[at + (kind != 1) :]
            words.append(w.capitalize() if rng.random() < 0.2 else w)
        out.append((i, rng.choice([" ", ", ", "\n"]).join(words), "en", "s", 0))
    return [*out, (None, out[0][1], None, None, None), out[1], out[1], (n, None, "en", "s", 0)]


def expect_variants(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    letters = sorted(set("".join(n)))
    near = {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = [x for x in edits if x in n and x != w]
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("settings", [{}, {"round_bytes": 1024, "last_shard": 9}, {"bits": 1}])
def test_variants(spark, settings):
    rows = misspelt(3, 80)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = spelling_variants.spelling_variants(docs, spelling_variants.Settings(**settings)).collect()
    want = expect_variants(rows)
    assert len(found) == len(want) and set(map(tuple, found)) == want
    assert sum(r.form is not None for r in found) > 20 and max(len(r.word) for r in found) >= 69


def test_roots_follow_all_forms(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("a", "b")]
    found = {r.word: r.root for r in spelling_variants.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert found == {**{f"w{i}": "w13" for i in range(13)}, "a": "b"}


def test_variants_of_nothing(no_docs):
    assert spelling_variants.spelling_variants(no_docs).count() == 0


def paragraphs(text, words):
    return set(re.findall(rf"(?:[^ \t\n\x0b\f\r]+[ \t\x0b\f\r]*){{1,{words}}}", text))


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("words", [2, 32])
def test_fingerprints(odd_docs, words):
    rows = [plain(r) for r in odd_docs.collect()]
    last = 2**63
    ids = sorted({last if i is None else i for i, *_ in rows})
    after = dict(zip(ids, [*ids[1:], ids[0]]))
    text_of = {k: min((t for i, t, *_ in rows if (last if i is None else i) == k), key=lambda t: hashlib.sha256(t.encode()).hexdigest()) for k in ids}
    want = Counter()
    for i, text, *_ in rows:
        following = text_of[after[last if i is None else i]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        own = paragraphs(text, words)
        near = [round(alike(own, paragraphs(t, words)), 9) for t in (edited, following)]
        want[i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *near] += 1
    found = fingerprints.fingerprints(odd_docs, fingerprints.Settings(words, 2)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in found) == want
    texts = defaultdict(set)
    for r in found:
        texts[r.fingerprint].add(r.n_chars)
    assert len(texts) == len({t for _, t, *_ in rows}) and all(len(x) == 1 for x in texts.values())


def test_fingerprint_edges(spark, no_docs):
    assert fingerprints.fingerprints(no_docs).count() == 0
    alone = fingerprints.fingerprints(spark.createDataFrame([(5, "one two three four", "en", "s", 0)], SCHEMA)).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"one two three " + b"one ").hexdigest()


def test_peeling_recovers_both_sides(spark):
    """More differences than the smallest sketch can hold, and a difference that it can."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    common, mine, theirs = (rng.integers(-(2**62), 2**62, n).tolist() for n in (400, 150, 90))
    df = spark.createDataFrame([(common + mine, common + theirs), (common, common[:-2]), ([], [])], "a array<bigint>, b array<bigint>")
    found = df.select(fingerprints.difference(F.col("a"), F.col("b"), 8).alias("d")).collect()
    signs = [{s: {x.x for x in r.d if x.n == s} for s in (1, -1)} for r in found]
    assert signs == [{1: set(mine), -1: set(theirs)}, {1: set(common[-2:]), -1: set()}, {1: set(), -1: set()}]
