from __future__ import annotations

import os
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgermill.llm import itq, lines, simhash, substrings
from ledgermill.llm.gsaca import common_prefixes, suffix_array


def union_components(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


# ---- suffix arrays and substrings ----


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(letters):
    order = suffix_array(letters)
    assert order == sorted(range(len(letters)), key=lambda i: letters[i:])
    for at, h in enumerate(common_prefixes(letters, order)):
        if at:
            a, b = letters[order[at - 1] :], letters[order[at] :]
            assert h == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _texts(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    base = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(10)]
    texts = [None, "", "a" * 200, "ab" * 90, "a" * 39, "é" * 60, "a" * 40]
    for _ in range(60):
        t = " ".join(rng.choice(base) for _ in range(rng.randint(1, 3)))
        i = rng.randint(0, len(t))
        texts.append(t[:i] + rng.choice(["", "x", "zz"]) + t[i:])
    return texts + texts[:20]


@pytest.mark.parametrize("crowded", [1, 256])
def test_substrings_like_brute_force(spark, crowded, monkeypatch):
    if crowded == 1:
        monkeypatch.setattr("ledgermill.llm.common.join_hot.__defaults__", ("inner", 2))
    texts = _texts(random.Random(11))
    docs = spark.createDataFrame([(i if i % 9 else None, i, t) for i, t in enumerate(texts)], "doc_id long, n_bytes long, text string")
    got = substrings.substring_report(docs, length=40, anchor=8, crowded=crowded, hot_text=1 if crowded == 1 else 1000).collect()
    want = substrings.brute_force(texts, 40)
    ids = [i if i % 9 else None for i in range(len(texts))]
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *w)) for i, w in zip(ids, want, strict=True))


@pytest.mark.parametrize("hot", [100, 1000])
def test_many_equal_rows_take_linear_time(spark, hot):
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(4000))
    docs = spark.createDataFrame([(1, text)] * 600 + [(2, text[:9000] + "!"), (3, None), (1, "short")], "doc_id long, text string")
    got = substrings.substring_report(docs, hot_text=hot, keep=True).collect()
    assert len(got) == 603
    assert all((r.n_removed, r.n_spans, bytes(r.kept)) == (len(text), 1, b"") for r in got if r.doc_id == 1 and r.n_bytes > 5)
    (other,) = [r for r in got if r.doc_id == 2]
    assert (other.n_removed, other.n_spans, bytes(other.kept)) == (9000, 1, b"!")


def test_large_groups_narrow_alike(monkeypatch):
    rng = random.Random(3)
    groups = defaultdict(set)
    for t in _texts(rng):
        data = substrings._bytes(t)
        for at, n, off, h in zip(*[x.tolist() for x in substrings.segments(data, 40, 8)], strict=True):
            groups[h].add((data[at : at + n + 39], off, n))
    for group in groups.values():
        rows = sorted(group)
        plain = substrings._narrow(rows, 40, 40)
        monkeypatch.setattr(substrings, "LARGE", 10)
        narrow = substrings._narrow(rows, 40, 40)
        monkeypatch.undo()
        assert [sorted(set(x)) for x in narrow] == [sorted(set(x)) for x in plain]


def _groups(texts, length, anchor):
    groups = defaultdict(set)
    for t in texts:
        data = substrings._bytes(t)
        for at, n, off, h in zip(*[x.tolist() for x in substrings.segments(data, length, anchor)], strict=True):
            groups[h].add((data[at : at + n + length - 1], off, n))
    return [sorted(g) for g in groups.values()]


def test_suffix_sorting_sees_what_may_recur_and_no_more(monkeypatch):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [noise(n) for n in (399, 400, 401, 430, 700)]
    texts = _texts(rng) + [noise(600) + rng.choice(passages) + noise(600) for _ in range(40)]
    letters = []
    monkeypatch.setattr(substrings, "suffix_array", lambda text: letters.append(len(text)) or suffix_array(text))
    for length, anchor in ((40, 8), (400, 128)):
        letters.clear()
        contents = marks = 0
        for rows in _groups(texts, length, anchor):
            windows = [[content[i : i + length] for i in range(n)] for content, _, n in rows]
            times = defaultdict(int)
            for w in windows:
                for x in w:
                    times[x] += 1
            want = [[i for i, x in enumerate(w) if times[x] > 1] for w in windows]
            assert [sorted(set(x)) for x in substrings._matching(rows, length)] == want
            contents += sum(len(content) + 1 for content, _, _ in rows) if len(rows) > 1 else 0
            marks += sum(map(len, want))
        # A window that recurs costs a letter before and one behind the shared bytes; whole contents were sorted before.
        assert marks < sum(letters) < contents / 2


def test_substrings_of_an_empty_table(spark):
    assert substrings.substring_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- SimHash ----


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\x0b", "One", "one TWO", "a b c", "ÀÉ é x y z", "w " * 5000, " ".join(map(str, range(900)))])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("hot", [1, 32])
def test_near_links_connect_exactly(spark, hot):
    rng = random.Random(2)
    prints = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.add(f)
            for _ in range(rng.randint(1, 3)):
                f ^= 1 << rng.randrange(64)
    prints |= {0, 1, 3, 7, 2**63, 2**64 - 1}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    for distance in (0, 1, 2):
        edges = [(r.a, r.b) for r in simhash.near_links(frame, distance=distance, hot_bucket=hot).collect()]
        apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
        assert all(apart(a, b) <= distance for a, b in edges)
        want = union_components(signed, [(a, b) for a in signed for b in signed if a < b and apart(a, b) <= distance])
        assert union_components(signed, edges) == want


def test_simhash_components_of_odd_rows(spark):
    texts = [None, "", "  ", "Same text here now", "same TEXT here now", "other words entirely differ", "word " * 9000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 0)], "doc_id long, text string, fp int")
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(texts) + 1
    by = {r.doc_id: r.component_id for r in got}
    assert by[0] == by[1] == by[2] == 0
    assert by[3] == by[4] == 3
    kept = simhash.deduplicated(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(by.values()))
    assert kept.columns == docs.columns
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_one_row_of_each_component_stays_whatever_its_id(spark):
    apart = [" ".join(f"{k}{w}" for w in "abcdefgh") for k in ("red", "blue", "green", "grey", "pink")]
    rows = [(None, apart[0], 1), (None, apart[1], 2), (None, apart[2], 3), (7, apart[2], 3), (8, apart[3], 4), (8, apart[4], 5), (9, apart[3], 4), (8, apart[4], 5), (None, apart[0], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    for frame in (docs, docs.repartition(5)):
        got = simhash.deduplicated(frame).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, {rows[0], rows[1], rows[3], rows[4], rows[5]}))


# ---- vectors ----


@pytest.mark.parametrize(("cold", "part", "n", "groups"), [(32, 512, 300, 60), (8, 6, 40, 2)])
def test_itq_recall(spark, cold, part, n, groups):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((groups, 64))
    rows = [base[i % groups] + rng.standard_normal(64) * rng.choice([0.02, 0.1, 0.2]) for i in range(n)]
    rows += [rows[0], rows[0] * 3, -rows[0]]
    data = [(i, [float(x) for x in r], i % 3) for i, r in enumerate(rows)]
    bad = [(1000, None, 0), (1001, [0.0] * 64, 0), (1002, [float("nan")] * 64, 0), (1003, [None] + [1.0] * 63, 0), (1004, [], 0), (None, data[0][1], 0), (0, data[0][1], 0)]
    frame = spark.createDataFrame(data + bad, "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: r for r in itq.near_duplicates(frame, cold_bucket=cold, part=part).collect()}
    x = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= linked.sum(axis=1)).all()
    assert found.sum() >= 0.9 * linked.sum()
    want = union_components(range(len(rows)), np.argwhere(linked).tolist())
    assert sum(got[i].component_id == want[i] for i in range(len(rows))) >= 0.9 * len(rows)
    for i in (1000, 1001, 1002, 1003, 1004):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert len(got) == len(rows) + 6
    assert itq.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("folder", ["sf0.1", "check_s"])
def test_itq_recall_on_the_table(spark, folder):
    """Links of the rows with an id divisible by 100, and of all rows, against all rows of ``embeddings``; sf0.1 holds no pair."""
    path = f"/root/testdata/{folder}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    table = spark.read.parquet(path)
    rows = sorted((r.vec_id, r.embedding) for r in table.collect())
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    want = linked.sum(axis=1)
    got = {r.vec_id: r.n_links for r in itq.near_duplicates(table).collect()}
    found = np.array([got[i] for i in ids.tolist()])
    assert len(got) == len(rows)
    assert (found <= want).all()
    asked = ids % 100 == 0
    print("links found, all", found.sum(), want.sum(), "asked", found[asked].sum(), want[asked].sum())
    assert found.sum() >= 0.9 * want.sum()
    assert found[asked].sum() >= 0.9 * want[asked].sum()


def test_links_do_not_depend_on_full_buckets(spark):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((12, 32)) * np.linspace(3, 0.1, 32)
    rows = [base[i % 12] + rng.standard_normal(32) * rng.choice([0.0, 0.05, 0.3]) for i in range(200)]
    data = [(i, [float(x) for x in r]) for i, r in enumerate(rows)] + [(500 + i, [1.0] * n) for i, n in enumerate((3, 3, 4))]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = [sorted(map(tuple, itq.near_duplicates(frame, cold_bucket=cold, part=part).collect())) for cold, part in ((0, 5), (20, 8), (10_000, 512))]
    assert found[0] == found[1] == found[2]
    assert [r[:3] for r in found[0][-3:]] == [(500, 1, 500), (501, 1, 500), (502, 0, 502)]


def test_meeting_points_agree():
    rng = np.random.default_rng(0)
    a = rng.integers(-(2**63), 2**63, 50)
    b = np.array([x ^ (1 << int(rng.integers(62))) ^ (1 << int(rng.integers(62))) for x in a.tolist()])
    for x, y in zip(a, b, strict=True):
        points = 0
        for seg, (at, width) in enumerate(itq.SEGMENTS):
            p = (int(x) % 2**64 >> at) & ((1 << width) - 1)
            q = (int(y) % 2**64 >> at) & ((1 << width) - 1)
            shared = ({p} | {p ^ (1 << k) for k in range(width)}) & ({q} | {q ^ (1 << k) for k in range(width)})
            points += sum(bool(itq._met_here(np.array([x]), np.array([y]), seg, s)[0, 0]) for s in shared)
        assert points == 1


# ---- lines ----


def brute_lines(docs, min_sites, min_chars):
    sites = defaultdict(set)
    for _, text, site in docs:
        for line in (text or "").split("\n") if text is not None else []:
            sites[line.strip(" \t\r")].add(site)
    gone = {line for line, s in sites.items() if len(s) >= min_sites and len(line) >= min_chars}
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\r") not in gone) for i, t, _ in docs}


def test_lines_like_brute_force(spark):
    rng = random.Random(8)
    menu = [f"line number {k} of the menu" for k in range(30)] + ["short", ""]
    docs = [(i, "\n".join(rng.choice(menu) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(0, 6))), rng.choice([f"s{k}" for k in range(14)] + [None])) for i in range(150)]
    docs += [(900, None, "s1"), (901, "", None), (902, "\n\n", "s2"), (903, ("menu " * 20_000).strip(), "s3"), (904, menu[0], "s0"), (905, menu[0], "s0")]
    frame = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, source string, h int")
    for least in (3, 10):
        want = brute_lines(docs, least, 8)
        got = lines.without_boilerplate(frame, min_sites=least)
        assert got.columns == frame.columns
        assert {r.doc_id: r.text for r in got.collect()} == want
        report = {r.doc_id: r for r in lines.line_report(frame, min_sites=least).collect()}
        for i, text, _ in docs:
            before = 0 if text is None else text.count("\n") + 1
            after = 0 if not want[i] and report[i].n_removed == before else 0 if want[i] is None else want[i].count("\n") + 1
            assert report[i].n_lines == before
            assert report[i].n_removed == before - after
    assert lines.line_report(frame.limit(0)).count() == 0
