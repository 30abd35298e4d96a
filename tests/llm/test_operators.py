"""Every operator against a brute-force version on a small corpus."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigloom.llm import (
    exact_dedup, jaccard_join, language_model, license_scan, mixing, packing, quality_classifier, quality_rules, sketch, substring_dedup,
    suffix_dedup, textops,
)
from sigloom.llm.components import components
from sigloom.llm.sketch import Sketch, bit_table, count_bits

SMALL = Sketch(rows=2, bits=18)
JOIN = jaccard_join.Settings(corpus=Sketch(rows=1, bits=20), candidates=Sketch(rows=1, bits=18))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def table(df):
    return {r["doc_id"]: r for r in df.collect()}


def expect_exact(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id))
    out = {}
    for text, members in groups.items():
        keep = min(members)[1]
        for _, doc_id in members:
            out[doc_id] = (keep, len(members), doc_id == keep, hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.mark.parametrize("digest", [None, 1])
def test_exact_dedup(docs, rows, digest):
    """Also with a digest of one digit, under which most texts collide and only the byte check tells them apart."""
    options = {} if digest is None else {"digest": lambda sha: F.substring(sha, 1, digest), "files_per_batch": 1}
    found = table(exact_dedup.exact_dedup(docs, **options))
    want = expect_exact(rows)
    assert {k: (r.keep_id, r.group_size, r.kept, r.text_sha256) for k, r in found.items()} == want


def test_exact_dedup_goes_on_from_its_state(spark, rows, tmp_path):
    folder = str(tmp_path / "dedup")
    for part in (rows[:30], rows[30:]):
        exact_dedup.ingest(spark.createDataFrame(part, "doc_id bigint, text string, lang string, source string, n_chars bigint"), folder)
    state = {r.key: (r.n_rows, r.doc_id) for r in exact_dedup.retained(spark, folder).collect()}
    want = {sha: (size, keep) for keep, size, _, sha in expect_exact(rows).values()}
    assert state == want


def test_survivors(docs, rows):
    kept = sorted(r.doc_id for r in exact_dedup.survivors(docs).collect())
    assert kept == sorted(k for k, v in expect_exact(rows).items() if v[2])


def shingle_set(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expect_components(rows):
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    comp = {i: i for i in sets}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_jaccard_join(docs, rows):
    found = table(jaccard_join.jaccard_join(docs, JOIN))
    assert {k: (r.n_shingles, r.component_id) for k, r in found.items()} == expect_components(rows)


def test_prefix_tree_finds_all_links():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(1, 400, 60)).astype(np.uint64) for _ in range(5)]
    sets = []
    for i in range(80):
        own = base[i % 5]
        own = np.unique(np.concatenate([own[rng.random(len(own)) > 0.1], rng.integers(1, 400, 3).astype(np.uint64)]))
        sets.append(own)
    tree = jaccard_join.PrefixTree(sets)
    for probe in sets[:20]:
        want = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= 80 * len(np.union1d(s, probe))}
        for step in (1, 7, 64):
            assert set(tree.links(probe, 80, step)) == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(200, 200)]
    found = {r.node: r.comp for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{j: 100 for j in range(100, 160)}}


def test_sketch_never_underestimates(spark):
    keys = np.random.default_rng(5).integers(0, 3000, 5000).astype(np.uint64)
    frame = spark.createDataFrame([(" ".join(map(str, keys[i::7].tolist())),) for i in range(7)], "text string").repartition(4)

    def parsed(batch):
        return np.array([int(x) for t in batch.column("text").to_pylist() for x in t.split()], np.uint64)

    bits = count_bits(frame, parsed, Sketch(rows=3, bits=16), 2, 4)
    values, counts = np.unique(keys, return_counts=True)
    for level, table_ in zip((2, 4), bits):
        marked = Sketch(rows=3, bits=16).marked(values, table_)
        assert marked[counts >= level].all() and marked[counts < level].mean() < 0.2


def test_sketch_in_a_store_that_only_spark_opens(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([("1 2 2 3",), ("3 4",)], "text string")

    def parsed(batch):
        return np.array([int(x) for t in batch.column("text").to_pylist() for x in t.split()], np.uint64)

    near = bit_table(frame, parsed, Sketch(rows=2, bits=17), 1, 2)
    spark.conf.set("fs.viewfs.mounttable.sketch.link./bits", f"file://{tmp_path}")
    monkeypatch.setattr(sketch, "scratch", lambda spark, name: f"viewfs://sketch/bits/{name}")
    far = bit_table(frame, parsed, Sketch(rows=2, bits=17), 1, 2)
    assert near.sent is None and (far.all() == near.all()).all()

    def marks(batches):
        for batch in batches:
            found = far.sketch.marked(np.array([1, 2, 3, 4, 5], np.uint64), far.level(1).value)
            yield pa.RecordBatch.from_arrays([pa.array(found)], ["found"])

    assert [r[0] for r in frame.limit(1).mapInArrow(marks, "found boolean").collect()] == [False, True, True, False, False]


def expect_substring(rows, width):
    first = {}
    for doc_id, text, *_ in sorted(rows):
        w = words(text)
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), doc_id)
    out = {}
    for doc_id, text, *_ in rows:
        w = words(text)
        gone = {p for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < doc_id for p in range(i, i + width)}
        left = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[doc_id] = (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


@pytest.mark.parametrize("width, sketch", [(50, SMALL), (9, SMALL), (9, Sketch(rows=1, bits=16))])
def test_substring_dedup(docs, rows, width, sketch):
    found = table(substring_dedup.substring_dedup(docs, width, sketch))
    want = expect_substring(rows, width)
    assert {k: (r.n_words, r.n_removed, r.kept_sha256) for k, r in found.items()} == want
    assert sum(v[1] for v in want.values()) > 500


def expect_suffix(rows, width):
    places = defaultdict(list)
    raw = {r[0]: (r[1] or "").encode() for r in rows}
    for doc_id, b in raw.items():
        for p in range(len(b) - width + 1):
            places[b[p : p + width]].append((doc_id, p))
    mask = {i: bytearray(len(b)) for i, b in raw.items()}
    for found in places.values():
        if len(found) > 1:
            for i, p in found:
                mask[i][p : p + width] = b"\1" * width
    out = {}
    for i, b in raw.items():
        runs = len(re.findall(b"\1+", bytes(mask[i])))
        out[i] = (len(b), sum(mask[i]), runs, hashlib.sha256(bytes(x for x, y in zip(b, mask[i]) if not y)).hexdigest())
    return out


@pytest.mark.parametrize("width, gram, part", [(60, 12, 4096), (20, 8, 2)])
def test_suffix_dedup(docs, rows, width, gram, part):
    settings = suffix_dedup.Settings(width=width, gram=gram, part=part, sketch=SMALL)
    found = table(suffix_dedup.suffix_dedup(docs, settings))
    want = expect_suffix(rows, width)
    assert {k: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for k, r in found.items()} == want


def test_maximal_repeats_name_all_occurrences():
    left, right = [b"cba", b"cbx", b"zzz", b"cba"[:2]], [b"mnopq", b"mnoxx", b"mnopq", b"mnopq"]
    found = {(a, d): sorted(g.tolist()) for a, d, g in suffix_dedup.maximal_repeats(left, right, 4)}
    assert found == {(2, 5): [0, 3], (0, 5): [0, 2, 3], (2, 3): [0, 1, 3]}


def test_long_rows_are_cut_into_stretches_without_loss(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 400)
    rng = np.random.default_rng(8)
    text = "".join(rng.choice(list("abcd"), 3000)) + "xy" * 200 + "".join(rng.choice(list("abcd"), 500))
    s = suffix_dedup.Settings(width=20, gram=8)
    parts = [suffix_dedup.minimizers(p, s) + (p.before,) for p in suffix_dedup.pieces(pa.array([text]), s)]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 20)
    (whole,) = suffix_dedup.pieces(pa.array([text]), s)
    places, _, tied, _ = suffix_dedup.minimizers(whole, s)
    assert np.array_equal(np.concatenate([p[0] + p[4] for p in parts]), places)
    assert np.array_equal(np.concatenate([p[2] + p[4] for p in parts]), tied)


def test_words_do_not_depend_on_chunks(monkeypatch):
    texts = pa.array(["", None, " a  b", "c\x0bd\x1ce", "Ab" * 100 + " " + "z" * 300, "é à\nb", "end ", "  ", "x", "the end of it all " * 50])
    whole = textops.Words(texts, lower=True)
    monkeypatch.setattr(textops, "CHUNK", 64)
    textops._CACHE.clear()
    parts = textops.Words(texts, lower=True)
    textops._CACHE.clear()
    assert np.array_equal(whole.hashes, parts.hashes) and np.array_equal(whole.offsets, parts.offsets)
    spelled = [bytes(textops.lowered(whole.data[a:b])) for a, b in zip(whole.starts, whole.ends)]
    assert spelled == [w.encode() for t in texts.to_pylist() for w in words(lower(t))]
    assert len(set(whole.hashes.tolist())) == len(set(spelled))


def expect_language_scores(rows):
    tokens = {r[0]: [*words(lower(r[1])), None] for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    single, pairs = Counter(), Counter()
    for i, t in tokens.items():
        if not held[i]:
            single.update(t)
            pairs.update(zip(["<s>", *t], t))
    n, v = single.total(), len(single)
    follows, total, kinds = Counter(w for _, w in pairs), Counter(), defaultdict(lambda: [0, 0, 0])
    for (a, _), c in pairs.items():
        total[a] += c
        kinds[a][min(c, 3) - 1] += 1
    of = [language_model.discounts(*(Counter(x.values())[k] for k in (1, 2, 3, 4))) for x in (pairs, follows)]

    def minus(c, d):
        return c - (d[min(c, 3) - 1] if c else 0)

    rest = sum(of[1][min(c, 3) - 1] for c in follows.values()) / len(pairs)

    def low(w):
        return minus(follows.get(w, 0), of[1]) / len(pairs) + rest / (v + 1)

    def high(a, w):
        if not total.get(a):
            return low(w)
        return minus(pairs.get((a, w), 0), of[0]) / total[a] + sum(d * k for d, k in zip(of[0], kinds[a])) / total[a] * low(w)

    assert math.isclose(sum(high("again", w) for w in single) + high("again", "never seen"), 1)
    return {
        i: (held[i], len(t), sum(w in single for w in t), n, sum(math.log10((single.get(w, 0) + 1) / (n + v + 1)) for w in t),
            sum(math.log10(high(a, w)) for a, w in zip(["<s>", *t], t)))
        for i, t in tokens.items()
    }


def test_language_model(docs, rows):
    found, want = table(language_model.held_out_scores(docs)), expect_language_scores(rows)
    for i, expected in want.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == expected[:4]
        assert math.isclose(r.base_score, expected[4], rel_tol=1e-9) and math.isclose(r.score, expected[5], rel_tol=1e-9)


def test_license_scan(spark):
    notice = license_scan.TEMPLATES["Apache-2.0 notice"]
    rows = [(1, f"some text\n{notice}\nmore"), (2, notice.upper()), (3, "released under the mit  license\n" * 2), (4, "nothing here"), (5, None), (6, "")]
    found = table(license_scan.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert [(found[i].license, found[i].unit_no, found[i].dice) for i in (1, 2, 3)] == [
        ("Apache-2.0 notice", 2, 1.0), ("Apache-2.0 notice", 0, 1.0), ("MIT notice", 1, 1.0),
    ]
    assert found[3].n_matches == 2 and [found[i].n_matches for i in (4, 5, 6)] == [0, 0, 0]


def test_size_bounds_lose_no_match():
    for size in range(1, 60):
        low, high = license_scan.size_bounds(size, 0.8)
        can = [n for n in range(1, 200) if 2 * min(n, size) / (n + size) >= 0.8 - 1e-12]
        assert (low, high) == (can[0], can[-1])


def test_mixing_fills_siblings_first(spark):
    """A short source gives its share to its siblings; a short language to other languages only when all its sources are full."""
    leaves = [("web", "en", "a", 100), ("web", "en", "b", 10), ("web", "de", "c", 5), ("books", "en", "d", 1000)]
    weights = {"domain": {"web": 1, "books": 1}, "lang": {"en": 1, "de": 1}}
    found = mixing.leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint"), weights, 180 / 1115, 1)
    assert {r.source: r.budget for r in found.collect()} == {"a": 75, "b": 10, "c": 5, "d": 90}


def test_mixing_takes_prefixes_within_budgets(docs, rows):
    found = mixing.mix(docs, budget_share=0.8, max_epochs=2).collect()
    spent, budgets, whole = Counter(), {}, defaultdict(list)
    for r in found:
        leaf = (r.domain, r.lang, r.source)
        spent[leaf] += r.n_tokens * r.times
        budgets[leaf] = r.budget
        whole[leaf].append(r)
    assert all(r.n_tokens == len(words(rows[r.doc_id][1])) and r.times <= 2 for r in found)
    for leaf, members in whole.items():
        assert spent[leaf] <= budgets[leaf]
        once_more = max(r.times for r in members)
        order = sorted(members, key=lambda r: hashlib.md5(f"{mixing.SEED}:{once_more - 1}:{r.doc_id}".encode()).hexdigest())
        took = [r.times == once_more for r in order]
        assert took == sorted(took, reverse=True) or budgets[leaf] == 0


def test_mixed_repeats_rows(docs):
    times = {r.doc_id: r.times for r in mixing.mix(docs, budget_share=0.9).collect()}
    found = Counter(r.doc_id for r in mixing.mixed(docs, budget_share=0.9).collect())
    assert found == Counter({k: v for k, v in times.items() if v})


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    found = packing.pack(docs, capacity=256, group_pieces=40).collect()
    ids = {r[0]: np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows}
    places, used = defaultdict(list), defaultdict(list)
    for r in found:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        places[r.doc_id].append((r.start, r.length))
        used[r.sequence_id].append((r.offset, r.length))
    for i, own in ids.items():
        assert [s for s, _ in sorted(places[i])] == list(range(0, len(own), 256)) and sum(n for _, n in places[i]) == len(own)
    for spans in used.values():
        spans.sort()
        assert [a for a, _ in spans] == np.cumsum([0, *(n for _, n in spans[:-1])]).tolist() and sum(n for _, n in spans) <= 256


def test_tournament_tree_is_first_fit_decreasing():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 100, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    free = []
    for i in np.argsort(-lengths, kind="stable"):
        k = next((k for k, room in enumerate(free) if room >= lengths[i]), len(free))
        if k == len(free):
            free.append(100)
        assert (bins[i], offsets[i]) == (k, 100 - free[k])
        free[k] -= lengths[i]


def test_encoder_equals_whole_texts(monkeypatch):
    texts = ["", "It's <|endoftext|> they'll ａ́  x\x1cy İstanbul Σας ΑΣ 12,34!! <|startoftext|>x é é ́ z", "a\tb\r\n c", "你好 世界 ﬁ  ", "x" * 3000, "THE END. " * 400]
    monkeypatch.setattr(packing, "_CHUNK", 500)
    monkeypatch.setattr(packing, "_KEPT_WORDS", 5)
    encoder = packing.Encoder(packing.default_tokenizer())
    for _ in range(2):
        for text in texts:
            (ids,) = encoder.texts(pa.array([text]))
            assert ids.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2]


def expect_rules(text):
    w, windows = words(text), defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    repeated = {p for starts in windows.values() if len(starts) > 1 for i in starts for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_quality_rules(docs, rows, marks):
    found = table(quality_rules.quality_rules(docs, quality_rules.fit(docs, marks)))
    for doc_id, text, *_ in rows:
        r, want = found[doc_id], expect_rules(text)
        assert tuple(r[c] for c in quality_rules.BASE) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


def test_isolation_forest_sets_outliers_apart():
    rng = np.random.default_rng(4)
    rows = np.vstack([rng.normal(0, 1, (400, 3)), rng.normal(9, 0.2, (8, 3))])
    scores = quality_rules.IsolationForest(rows, quality_rules.Settings()).scores(rows)
    assert scores[400:].min() > np.quantile(scores[:400], 0.98)
    clean = np.arange(408) < 400
    limit = quality_rules.calibrated(scores, clean, 0.01)
    assert (scores[clean] < limit).mean() >= 0.99 and (scores[~clean] >= limit).all()


def test_classifiers_on_held_out_rows(spark):
    """Trained and judged on the given labels: held-out accuracy of both, clean rows kept."""
    folder = "/root/testdata/sf0.01"
    docs, marks = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.quality for r in marks.collect()}
    scores = [r for r in quality_classifier.quality_scores(docs, quality_classifier.fit(docs, marks)).collect() if r.held_out and r.doc_id in known]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scores)
    assert np.mean([r.predicted == known[r.doc_id] for r in scores]) > 0.95
    rules = [r for r in quality_rules.quality_rules(docs, quality_rules.fit(docs, marks)).collect() if r.doc_id in known]
    assert np.mean([r.kept for r in rules if known[r.doc_id] == 1 and not r.base_failed]) > 0.97
    assert np.mean([not r.kept for r in rules if known[r.doc_id] == 0]) > 0.9


def test_risk_never_rewards_negative_estimates():
    rng = np.random.default_rng(6)
    positive, negative = rng.normal(1.5, 1, (400, 2)), rng.normal(-1.5, 1, (400, 2))
    unlabelled = np.vstack([rng.normal(1.5, 1, (300, 2)), rng.normal(-1.5, 1, (300, 2))])
    model = quality_classifier.minimise(positive, unlabelled, 0.5, quality_classifier.Settings(steps=300))
    assert (model.scores(positive) > 0.5).mean() > 0.9 and (model.scores(negative) < 0.5).mean() > 0.9


def test_license_scan_finds_wrapped_licences(spark):
    header = (
        "# tool.py\n#\n# This program is free software: you can redistribute it and/or\n# modify it under the terms of the GNU General Public\n"
        "# License as published by the Free Software Foundation, either\n# version 3 of the License, or (at your option) any later version.\n\n"
        "import sys\n\ndef main():\n    print(sys.argv)\n"
    )
    prose = "\n".join(f"word{i} other{i} more{i}" for i in range(400))
    texts = [
        "MIT License\n\nCopyright (c) 2020 Some One\n\n" + license_scan.TEXTS["MIT"], header + prose, f"{prose}\n{prose}\n{license_scan.TEXTS['GPL-3.0']}\n{prose}\n{prose}",
        f"{prose}\n{license_scan.TEXTS['BSD-3-Clause']}", f"/*\n{license_scan.TEXTS['ISC']}*/\nint x;\n", prose + "\nall rights under the license\n",
    ]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id bigint, text string")
    found = {}
    for r in license_scan.license_matches(docs).collect():
        assert (r.doc_id, r.license, r.unit_no) not in found
        found[r.doc_id, r.license, r.unit_no] = r.dice
    names = {(i, name) for i, name, _ in found}
    assert {(0, "MIT"), (0, "MIT permission"), (1, "GPL-3.0 header"), (2, "GPL-3.0"), (3, "BSD-3-Clause"), (3, "BSD conditions"), (4, "ISC"), (4, "ISC permission")} <= names
    assert not any(i == 5 for i, _ in names)
    best = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert best[1].license == "GPL-3.0 header" and best[1].dice == 1.0 and best[2].license == "GPL-3.0" and best[2].dice == 1.0
    assert best[2].unit_no == -2401


def test_license_runs_lose_no_match(spark):
    """Runs of any start and length, by brute force, for texts near the threshold."""
    rng = random.Random(5)
    template = " ".join(rng.choice("abcdefghijkl") + rng.choice("xyz") for _ in range(60))
    texts = []
    for edits in range(24):
        words = template.split()
        for _ in range(edits // 3):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = ["zz"] * rng.randrange(4)
        texts.append("\n".join([f"left{edits}", " ".join(words[:20]), " ".join(words[20:]), "right"]))
    want = license_scan.template_bigrams(template)
    got = {r.doc_id for r in license_scan.license_matches(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), {"t": template}).collect()}
    expected = set()
    for i, text in enumerate(texts):
        words = text.split()
        for a in range(len(words)):
            for b in range(a + 2, len(words) + 1):
                bag = license_scan.template_bigrams(" ".join(words[a:b]))
                if 2 * (bag & want).total() / (bag.total() + want.total()) >= 0.8:
                    expected.add(i)
    assert got == expected and 0 < len(got) < len(texts)


def test_capitals_with_combining_marks():
    """Ids do not depend on when a word is lowered, nor on the other texts of a batch."""
    path = packing.default_tokenizer()
    whole = packing.Encoder(path).tokenizer
    texts = ["H\u0331at and T\u0308ea, W\u030aord", "Y\u030aes HAT J\u030cot", "Plain TEXT, here", "\u00dcBER Stra\u00dfe", "x <|endoftext|> A", ""]
    want = [[*whole.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in texts]
    together = [ids.tolist() for ids in packing.Encoder(path).texts(pa.array(texts))]
    apart = [next(packing.Encoder(path).texts(pa.array([t]))).tolist() for t in texts]
    assert together == want and apart == want


def test_long_alternating_words_have_hashes_of_their_own(spark):
    """Words of Thue-Morse letters, and words that differ in one byte or in the order of their parts."""
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    swap = str.maketrans("ab", "ba")
    many = [w[:n] for w in (morse, morse.translate(swap)) for n in (1, 7, 8, 9, 16, 17, 64, 512, 1024, 2048, 4096)]
    many += ["x" * n for n in range(1, 40)] + ["x" * 24 + "y" * 8, "y" * 8 + "x" * 24, "x" * 8 + "y" * 8 + "x" * 16, "a\x00", "\x00", "\x00\x00"]
    many = list(dict.fromkeys(many))
    found = textops.Words(pa.array(many)).hashes
    assert len(set(found.tolist())) == len(many)
    docs = spark.createDataFrame([(1, morse[:1024]), (2, morse[:1024].translate(swap)), (3, morse[:1024])], "doc_id bigint, text string")
    joined = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(docs, JOIN).collect()}
    assert joined == {1: 1, 2: 2, 3: 1}
    lined = " ".join([morse[:1024]] * 30 + [morse[:1024].translate(swap)] * 30)
    repeated = spark.createDataFrame([(1, lined), (2, " ".join([morse[:1024].translate(swap)] * 30 + [morse[:1024]] * 30))], "doc_id bigint, text string")
    removed = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(repeated).collect()}
    assert removed == {1: 0, 2: 0}


def test_parts_of_words_are_encoded_as_the_whole_text():
    rng = random.Random(17)
    alphabet = "aZxÀÿ×÷ßÉñªŸİ0019.,'!<|>-*\u0331\u0301”… \t\n" + "ab" * 6
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    whole = packing.Encoder(packing.default_tokenizer())
    want = [[*whole.tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in texts]
    assert [ids.tolist() for ids in whole.texts(pa.array(texts))] == want


def test_classifier_learns_where_every_row_is_labelled(spark):
    rng = random.Random(3)
    good = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)) for _ in range(300)]
    bad = [" ".join("".join(rng.choice("0123456789#%$") for _ in range(rng.randint(2, 7))) for _ in range(60)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate([*good, *bad])), "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, int(i < 300), 0) for i in range(450)], "doc_id bigint, quality int, toxic int")
    found = quality_classifier.quality_scores(docs, quality_classifier.fit(docs, marks)).collect()
    assert np.mean([r.predicted == int(r.doc_id < 300) for r in found if r.held_out]) > 0.95


def test_one_row_stays_of_classes_with_null_or_repeated_ids(spark):
    words = [f"w{i}" for i in range(80)]
    text, other = " ".join(words), " ".join(f"v{i}" for i in range(80))
    spaced = [(None, text), (None, text.replace(" ", "\t", 1)), (5, other), (5, other.replace(" ", "\n", 1))]
    edited = [(None, text), (None, text.replace("w79", "x")), (5, other), (5, other.replace("v79", "x"))]
    for rows, keep in ((spaced, exact_dedup.survivors), (edited, lambda d: jaccard_join.representatives(d, JOIN))):
        kept = keep(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        assert sorted(r.text[0] for r in kept) == ["v", "w"]
