import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import line_dedup, ngram_join, substring_dedup, suffix_dedup
from tests.llm.conftest import prose, rows

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return SPLIT.findall(lower(t))


def shingles(t, k):
    w = words(t)
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(data, k, num, den):
    sets = [(d, shingles(t, k)) for d, t, *_ in data]
    label = {d: d for d, _ in sets if d is not None}
    changed = True
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if a is not None and b is not None and x and y and den * len(x & y) >= num * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if (label[a], label[b]) != (m, m):
                label[a] = label[b] = m
                changed = True
    return sorted(((d, len(s), label.get(d)) for d, s in sets), key=repr)


@pytest.mark.parametrize("k, num, tile, block", [(4, 85, 4096, 512), (5, 80, 2, 2)])
def test_ngram_join(spark, docs, odd, monkeypatch, k, num, tile, block):
    # small tiles and blocks take the ways that split them
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    data = docs.collect()
    got = ngram_join.ngram_join(odd, k, num, 100).select("doc_id", "n_shingles", "component_id")
    assert rows(got) == brute_components(data, k, num, 100)


def test_ngram_join_keeps_one(docs, none):
    kept = {r.doc_id for r in ngram_join.one_of_each(docs).collect()}
    assert {3, 11, 60, 61, 62, 63, None} <= kept and not {20, 21, 22} & kept
    assert ngram_join.ngram_join(none).count() == 0


def test_many_near_copies(spark):
    from tests.llm.conftest import edited, prose

    base = prose(1, 300)
    data = [(i, edited(base, i, 0.01)) for i in range(60)] + [(100 + i, prose(1000 + i, 50)) for i in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = ngram_join.ngram_join(df, 4, 85, 100)
    assert rows(got) == brute_components(data, 4, 85, 100)


def test_a_common_line_makes_no_tile_of_all_its_documents(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 16)
    made, whole = [], ngram_join.tiles
    monkeypatch.setattr(ngram_join, "tiles", lambda *args: made.append(whole(*args)) or made[-1])
    line = prose(7, 22)
    data = [(i, f"{prose(8000 + i, 30 + i)} {line}") for i in range(300)]
    data += [(400 + i, f"{data[i][1]} more {i}") for i in range(20)]
    got = ngram_join.ngram_join(spark.createDataFrame(data, "doc_id long, text string"), 4, 85, 100)
    assert rows(got) == brute_components(data, 4, 85, 100)
    assert sum(t.count() for t in made) < len(data)


def test_long_texts_with_a_passage_in_common_are_no_candidates(spark):
    passage = prose(7, 800)
    data = [(i, f"{prose(100 + i, 4000)} {passage}") for i in range(12)]
    reps = ngram_join.sketches(spark.createDataFrame(data, "doc_id long, text string"), 4).withColumnRenamed("doc_id", "rep")
    assert ngram_join.candidate_edges(reps, 85, 100).count() == 0


def brute_suffix(data, n=50):
    first = {}
    for d, t, *_ in data:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - n + 1):
                s = b[i : i + n]
                first[s] = min(first.get(s, d), d)
    out = []
    for d, t, *_ in data:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        if d is not None:
            for i in range(len(b) - n + 1):
                if first[b[i : i + n]] < d:
                    gone[i : i + n] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [2000, 2])
def test_suffix_dedup(docs, odd, none, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    data = docs.collect()
    assert rows(suffix_dedup.suffix_dedup(odd).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == brute_suffix(data)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for data in (rng.integers(97, 100, 600).astype(np.uint8), np.full(300, 97, np.uint8), np.frombuffer(b"abcab" * 70, np.uint8)):
        order, new = suffix_dedup.suffix_array(data, 50)
        raw = data.tobytes()
        heads = [raw[i : i + 50] for i in order]
        assert heads == sorted(heads)
        shared = suffix_dedup.common_prefixes(data, order, new, 50)
        for a, b, n in zip(order[:-1], order[1:], shared[1:]):
            want = 0
            while want < 50 and max(a, b) + want < len(raw) and raw[a + want] == raw[b + want]:
                want += 1
            assert n == want


def test_line_dedup(docs, odd, none):
    data = {}
    for r in docs.collect():
        data.setdefault((r.doc_id, r.text), r)
    got = line_dedup.line_dedup(odd).collect()
    assert len(got) == docs.count()
    form = lambda line: tuple("#" if re.search("[0-9]", w) else w for w in words(line))
    holders = defaultdict(set)
    for d, t in data:
        for line in (t or "").split("\n"):
            if d is not None and form(line):
                holders[form(line)].add(d)
    for r in got:
        own = [x for x in (data[r.doc_id, [t for d, t in data if d == r.doc_id][0]].text or "").split("\n")] if r.doc_id is not None else []
        left = {form(x) for x in (r.text or "").split("\n")}
        for line in own:
            f = form(line)
            # boilerplate whose form is the same in five documents stays in the first only; other lines stay
            if f and len(holders[f]) >= 5 and r.doc_id != min(holders[f]):
                assert f not in left
            # near copies' lines are one template, which five documents have
            elif f and len(holders[f]) < 5 and len(f) > 12 and r.doc_id not in (30, 31, 32, 33):
                assert f in left
    assert sum(r.n_dropped for r in got) >= 5
    assert line_dedup.line_dedup(none).count() == 0
    kept = line_dedup.drop_lines(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def brute_lines(data, min_docs=5, num=80, den=100, leaf_lines=1024):
    """Per row the lines that are left, by the tree as the docstring tells it."""
    import pyarrow as pa

    from tallyspark.llm import textkernel as tk

    def form(line):
        return tuple("#" if re.search("[0-9]", w) else w for w in words(line))

    def hashed(line):
        raw = line.encode()
        return int(line_dedup.parsed(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[5][0].view(np.int64))

    holders, of, count = defaultdict(set), {}, defaultdict(int)
    for d, t in data:
        for f, line in {form(line): line for line in (t or "").split("\n") if d is not None and words(line)}.items():
            holders[f].add(d)
            of[f] = hashed(line)
            count[f] += 1
    leaves = defaultdict(list)
    for f in holders:
        leaves[len(f), f[:3]].append(f)
    leaves = {k: v for k, v in leaves.items() if len({d for f in v for d in holders[f]}) >= min_docs}
    found, depth = [], 3
    while leaves:
        split = defaultdict(list)
        widest = max((len(f) for own in leaves.values() if len(own) > leaf_lines for f in own), default=0)
        for key, own in leaves.items():
            if len(own) > leaf_lines and depth < widest:
                for f in own:
                    split[key, 0, f[: 2 * depth]].append(f)
                    split[key, 1, f[-2 * depth :]].append(f)
                continue
            grown = []
            for f in sorted(own, key=lambda f: (-count[f], of[f])):
                same = [sum(a == b for a, b in zip(g, f)) for g, _ in grown]
                best = same.index(max(same)) if same else 0
                if same and den * same[best] >= num * len(f):
                    grown[best] = (tuple(a if a == b else None for a, b in zip(grown[best][0], f)), [*grown[best][1], f])
                else:
                    grown.append((f, [f]))
            found += [members for _, members in grown]
        leaves, depth = split, 2 * depth
    lost = defaultdict(set)
    for members in found:
        docs_ = {d for f in members for d in holders[f]}
        if len(docs_) >= min_docs:
            for f in members:
                for d in holders[f] - {min(docs_)}:
                    lost[d].add(f)
    return sorted(((d, sum(bool(words(x)) for x in (t or "").split("\n")), sum(bool(words(x)) and form(x) in lost[d] for x in (t or "").split("\n")) if d is not None else 0) for d, t in data), key=repr)


def line_data(seed):
    """Templates with fields at the front, in the middle and at the end, and plain lines."""
    import random

    rng = random.Random(seed)
    pool = [prose(5000 + i, 1) for i in range(40)]
    base = [prose(6000 + i, n).replace("\n", " ").split() for i, n in enumerate((4, 7, 9, 12, 15, 20, 20, 30))]
    data = []
    for d in range(60):
        lines = []
        for b in rng.sample(base, 5):
            own = list(b)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(pool)
            if rng.random() < 0.3:
                own[rng.randrange(len(own))] = str(rng.randint(0, 99))
            lines.append(" ".join(own))
        lines.insert(2, "")
        data.append((d, "\n".join(lines + [prose(7000 + d, 10)])))
    return data + [(3, data[3][1]), (None, data[5][1]), (90, None), (91, "")]


@pytest.mark.parametrize("leaf_lines", [1024, 6, 1])
def test_line_dedup_matches_brute_force(spark, monkeypatch, leaf_lines):
    monkeypatch.setattr(line_dedup, "LEAF_LINES", leaf_lines)
    data = line_data(leaf_lines)
    got = line_dedup.line_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(3))
    want = brute_lines(data, leaf_lines=leaf_lines)
    assert rows(got.select("doc_id", "n_lines", "n_dropped")) == want
    assert sum(w[2] for w in want) > 40


@pytest.mark.parametrize("others", [0, 1500])
def test_templates_dont_depend_on_the_size_of_their_leaf(spark, others):
    """A template with a field at each end, in a leaf with many other lines."""
    names = "anna bert carl dora emil fred gina hans".split()
    data = [(i, f"this page was {n} last changed by some user on the main server this {n[::-1]}") for i, n in enumerate(names)]
    data += [(100 + i, f"this page was {prose(20_000 + i, 12)}".replace("\n", " ")) for i in range(others)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in line_dedup.line_dedup(df).collect() if r.n_dropped} == set(range(1, 8))
    kept = {r.doc_id: r.text for r in line_dedup.drop_lines(df).collect()}
    assert all((kept[i] == "") == (0 < i < 8) for i in kept)


@pytest.mark.parametrize("width", [4, 5, 9, 15])
def test_grow_compares_with_every_template(width):
    rng = np.random.default_rng(width)
    for _ in range(20):
        tokens = rng.integers(0, 3, (150, width)).astype(np.int32)
        tokens[:, :3] = 1
        first, wild, want = [], [], []
        for i, row in enumerate(tokens):
            same = [int(((tokens[t] == row) & ~w).sum()) for t, w in zip(first, wild)]
            if same and 100 * max(same) >= 80 * width:
                best = same.index(max(same))
                wild[best] |= tokens[first[best]] != row
                want.append(first[best])
            else:
                first.append(i)
                wild.append(np.zeros(width, dtype=bool))
                want.append(i)
        assert line_dedup.grow(tokens, 80, 100).tolist() == want


def test_drop_lines_with_clashing_names(spark):
    data = [(i, f"{prose(100 + i, 9)}\nall rights reserved by the owner of this page {i}", i) for i in range(8)]
    names = ("n_lines", "n_dropped", "lines", "of", "doc", "line", "leaf", "template", "tokens", "c0", "c1", "first", "salt", "docs")
    df = spark.createDataFrame(data, "doc_id long, text string, n_chars long").select("*", *[F.lit(n).alias(n) for n in names])
    got = line_dedup.drop_lines(df)
    assert got.columns == df.columns and got.schema.simpleString() == df.schema.simpleString()
    for r in got.collect():
        assert ("rights" in r.text) == (r.doc_id == 0) and r.n_chars == len(r.text) and all(r[n] == n for n in names)


def test_templates_with_a_varying_word(spark):
    names = "anna bert carl dora emil fred gina hans".split()
    data = [(i, f"first unlike line {chr(97 + i)} {chr(98 + i)}x\nthis page was last changed by user {n} on the main server today") for i, n in enumerate(names)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[0].n_dropped == 0 and all(got[i].n_dropped == 1 and "changed" not in got[i].text for i in range(1, 8))


def test_compact_windows_match_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n, t = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        v = np.concatenate([[0], rng.integers(1, 30, n), [0]]).astype(np.uint64)
        want = []
        for c in range(1, n + 1):
            a = b = c
            while v[a - 1] > v[c]:
                a -= 1
            while v[b + 1] >= v[c]:
                b += 1
            if b - a + 1 >= t:
                want.append((a, c, b))
        if n >= t:
            assert sorted(zip(*(x.tolist() for x in substring_dedup.compact_windows(v, t)))) == sorted(want)


def test_substring_dedup(docs, odd, none):
    got = defaultdict(list)
    for r in substring_dedup.substring_dedup(odd).collect():
        got[r.doc_id].append(r)
    first = {}
    for r in sorted((r for r in docs.collect() if r.doc_id is not None), key=lambda r: r.doc_id):
        w = words(r.text)
        own = got[r.doc_id][0]
        assert own.n_words == len(w)
        found = np.zeros(len(w), dtype=bool)
        for s in filter(None, own.spans.split(",")):
            a, b = map(int, s.split(":"))
            found[a:b] = True
        assert found.sum() == own.n_dup_words
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), r.doc_id) < r.doc_id:
                assert found[i : i + 50].all()
    for i in (41, 42, 43):
        assert 40 in got[i][0].partners and 70 <= got[i][0].n_dup_words <= 90
    for i in (*range(12), 40, 60, 61, 62, 63, None):
        assert got[i][0].n_dup_words == 0
    # near copies are found as passages of the text they come from
    assert all(got[30 + i][0].n_dup_words > 0.7 * got[30 + i][0].n_words for i in range(4))
    assert substring_dedup.substring_dedup(none).count() == 0
    pairs = {(r.doc_id, r.other_doc_id): r for r in substring_dedup.passage_pairs(docs).collect()}
    assert {(41, 40), (42, 40), (43, 40), (20, 3), (31, 11)} <= set(pairs)
    assert {d for d, _ in pairs} == {d for d, r in got.items() if r[0].n_dup_words} and all(a > b for a, b in pairs)
    assert 70 <= pairs[41, 40].n_words <= 90 and substring_dedup.passage_pairs(none).count() == 0


def test_passage_of_two_frequent_lines(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "WHOLE", 8)
    one, two = prose(1, 25).replace("\n", " "), prose(2, 25).replace("\n", " ")
    alone = lambda i, line: f"{prose(1000 + i, 60)} {line} {prose(5000 + i, 60)}"
    # the words where the lines meet are frequent, too
    lines = (one, two, " ".join(one.split()[-4:] + two.split()[:4]))
    data = [(i, alone(i, lines[i % 3])) for i in range(200) if i not in (80, 120)]
    data += [(i, alone(i, f"{one} {two}")) for i in (80, 120)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.other_doc_id): r for r in substring_dedup.passage_pairs(df).collect()}
    assert set(got) == {(120, 80)} and 50 <= got[120, 80].n_words <= 52


@pytest.mark.parametrize("turned", [False, True])
def test_neighbouring_passages_from_far_apart(spark, turned):
    one, two = prose(1, 60), prose(2, 60)
    early = f"{prose(3, 40)} {one} {prose(4, 1500)} {two} {prose(5, 40)}"
    late = f"{prose(6, 80)} {two} {one} {prose(7, 80)}" if turned else f"{prose(6, 80)} {one} {two} {prose(7, 80)}"
    df = spark.createDataFrame([(1, early), (2, late)], "doc_id long, text string")
    (got,) = [r for r in substring_dedup.substring_dedup(df).collect() if r.doc_id == 2]
    found = {i for s in got.spans.split(",") for i in range(*map(int, s.split(":")))}
    assert set(range(80, 200)) <= found and len(found) <= 140
    (pair,) = substring_dedup.passage_pairs(df).collect()
    assert (pair.doc_id, pair.other_doc_id, pair.n_words) == (2, 1, got.n_dup_words)


@pytest.mark.parametrize("between", [1, 4, 12])
def test_scattered_phrases_dont_hide_a_copy(spark, monkeypatch, between):
    """Documents that hold all of a passage's 5-word phrases, but scattered, stand before and between its two copies."""
    monkeypatch.setattr(substring_dedup, "WHOLE", 4)
    passage = prose(11, 60).replace("\n", " ").split()

    def scattered(i):
        return " ".join(f"{' '.join(passage[j : j + 5])} {prose(9000 + 100 * i + j, 6)}" for j in range(0, 56, 1))

    data = [(i, scattered(i)) for i in range(between)] + [(200 + i, scattered(50 + i)) for i in range(between)]
    data += [(i, f"{prose(20 + i, 50)} {' '.join(passage)} {prose(30 + i, 50)}") for i in (100, 300)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.other_doc_id): r for r in substring_dedup.passage_pairs(df).collect()}
    assert (300, 100) in got and 60 <= got[300, 100].n_words <= 64


def exact_repeats(data, n=50):
    """Of each document the words that n equal words in a row cover that an earlier document has, too."""
    first, out = {}, {}
    for d, t in sorted(data):
        w = words(t)
        found = set()
        for i in range(len(w) - n + 1):
            if first.setdefault(tuple(w[i : i + n]), d) < d:
                found.update(range(i, i + n))
        out[d] = found
    return out


@pytest.mark.parametrize("whole", [32, 2])
def test_passage_pairs_against_brute_force(spark, monkeypatch, whole):
    """Passages of 50 words and more among common lines: every exact repeat is found, at any size of a group, every pair that is
    returned shares a passage, and near copies are found, too."""
    import random

    monkeypatch.setattr(substring_dedup, "WHOLE", whole)
    rng = random.Random(whole)
    lines = [prose(i, 24).replace("\n", " ") for i in range(6)]
    planted = [prose(50 + i, rng.randint(50, 120)).replace("\n", " ") for i in range(12)]
    data, near = [], {}
    for d in range(120):
        parts = [prose(1000 + 10 * d + j, rng.randint(5, 60)).replace("\n", " ") for j in range(4)]
        parts[1:1] = rng.sample(lines, 3)
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts)), rng.choice(planted))
        elif rng.random() < 0.3:
            # a word in 60 differs, so that nothing is equal over 60 words, and the similarity of the shingles is 0.8 or more
            k = rng.randrange(len(planted))
            parts.insert(2, " ".join(w if i % 60 != 40 else f"x{d}" for i, w in enumerate(planted[k].split())))
            near[d] = k
        data.append((d, " ".join(parts)))
    data += [(500, data[10][1]), (501, data[10][1])]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    spans, partners = {}, {}
    for r in substring_dedup.passage_pairs(df).collect():
        own = {i for s in r.spans.split(",") for i in range(*map(int, s.split(":")))}
        assert r.other_doc_id < r.doc_id and r.n_words == len(own) and r.n_spans == len(r.spans.split(","))
        spans.setdefault(r.doc_id, set()).update(own)
        partners.setdefault(r.doc_id, set()).add(r.other_doc_id)
    want = exact_repeats(data)
    assert all(found <= spans.get(d, set()) for d, found in want.items())
    text = dict(data)
    for d, others in partners.items():
        for o in others:
            mine, theirs = shingles(text[d], 5), shingles(text[o], 5)
            assert len(mine & theirs) >= 0.8 * 46 * 0.8
    assert partners[500] >= {10} and partners[501] >= {10}
    # a near copy of a passage that an earlier document has
    known = {k: min((d for d, t in data if planted[k] in t), default=10_000) for k in range(len(planted))}
    able = [d for d, k in near.items() if known[k] < d]
    assert sum(d in spans for d in able) >= 0.9 * len(able)
