from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

pytest.importorskip("ahocorasick")

from ledgermill.llm import common, divergence, filters, pii  # noqa: E402

CLASHES = ["id", "part", "mask", "digest", "weight", "least", "times", "n", "term", "item", "p", "q", "key", "kept", "spans", "r", "value", "rank", "base", "cell"]
DOCS = "doc_id long, text string, lang string, source string"


def with_clashes(df):
    return df.selectExpr("*", *[f"{k} as `{c}`" for k, c in enumerate(CLASHES)])


def bag(rows):
    return Counter(map(tuple, rows))


# ---- filters ----


def brute_audit(rows, labels, min_words):
    """(part, order, step) -> counts, by applying each order to each row."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = defaultdict(list)
    for i, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < min_words, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and least[text] < i}
        parts[lang or ""].append((fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part, docs in parts.items():
        for order in map("".join, permutations("ABCDE")):
            gone = [False] * len(docs)
            for step, f in enumerate(order, 1):
                now = [d[0][f] and not g for d, g in zip(docs, gone, strict=True)]
                redundant = sum(d[0][f] and g for d, g in zip(docs, gone, strict=True))
                gone = [g or x for g, x in zip(gone, now, strict=True)]
                shapley[part, f] += sum(now)
                out[part, order, step] = [gone.count(False), sum(now), redundant, sum([*d[0].values()].count(True) == 1 and d[0][f] for d in docs), sum(x and d[1] for x, d in zip(now, docs, strict=True)), sum(x and d[2] for x, d in zip(now, docs, strict=True))]
    return Counter((part, order, step, *v, shapley[part, order[step - 1]]) for (part, order, step), v in out.items())


def filter_rows():
    rng = random.Random(4)
    words = ["a", "Bee", "ÇA", "d#", "e", "ffff", "GGG", "h", "ß", "i|j"]
    rows = [(k, rng.choice([" ", "\n", "\t\x0b"]).join(rng.choice(words) for _ in range(rng.randint(0, 9))), rng.choice(["en", "de", None]), "s") for k in range(150)]
    rows += [(k, "copy of one", "en", "s") for k in range(300, 330)] + [(None, "copy of one", "de", "s")] * 3 + [(None, None, None, None), (7, None, "en", "s"), (6, "", "", "s"), (900, "w " * 30_000, "long", "s")]
    rows += [(300, "copy of one", "fr", "s"), (300, "copy of one", "fr", "s"), (2, "copy of one", "x", "s"), (2, "copy of one", "x", "s"), (901, "\xa0 \xa0", "nbsp", "s")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 340, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (5000, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("hot", [1000, 3])
def test_filter_audit_like_brute_force(spark, monkeypatch, hot):
    rows, labels = filter_rows()
    monkeypatch.setattr(common.join_hot, "__defaults__", ("inner", hot))
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = bag(filters.filter_audit(with_clashes(docs), with_clashes(marks), min_words=5).collect())
    assert got == brute_audit(rows, labels, 5)
    assert filters.filter_audit(docs.limit(0), marks).count() == 0


def test_filter_audit_without_labels(spark):
    docs = spark.createDataFrame([(1, "x", "en", "s")], DOCS)
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filters.filter_audit(docs, marks).collect()
    assert len(got) == 600
    assert sum(r.removed for r in got) == 120
    assert {r.shapley for r in got} == {0, 120}


# ---- divergence ----


def brute_divergence(rows, min_docs, top):
    found = [(lang or "", source or "", [m.encode().lower() for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {f[0] for f in found}:
        spread, sums, groups = Counter(), Counter(), {}
        for own, source, terms in found:
            if own == lang:
                spread.update(set(terms))
                sums.update(terms)
                groups.setdefault(source, Counter()).update(terms)
        kept = [t for t, n in spread.items() if n >= min_docs]

        def weights(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, p = weights(sums), {s: weights(c) for s, c in groups.items()}
        for s, c in groups.items():
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            terms = sorted((q[t] - p[s][t], t) for t in kept if c[t] and p[s][t] > q[t])[:top]
            for part, ranked in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(ranked, 1)]
    return Counter(out)


def divergence_rows():
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("Stra", "él", "İx", "th", "漢", "𝒳", "ö") for b in ("ße", "an", "ZU", "k", "")]
    rows = []
    for k in range(300):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "ä", "z", None])
        own = words[: 12 + 5 * len(source or "")] if rng.random() < 0.6 else words
        rows.append((k % 250, rng.choice([" ", "_", "1"]).join(rng.choice(own) for _ in range(rng.randint(0, 30))), lang, source))
    rows += [(1, "alone here", "xx", "only"), (2, None, "yy", "p"), (3, "", "yy", "q"), (4, None, None, None), (5, "than " * 40_000 + "lang" * 5000, "en", "huge")] + [(6, "copy this text", "en", "copies")] * 40
    return rows


@pytest.mark.parametrize(("held", "chunk"), [(200_000, 1 << 20), (7, 9)])
def test_divergence_like_brute_force(spark, monkeypatch, held, chunk):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    rows = divergence_rows()
    docs = spark.createDataFrame(rows, DOCS)
    for min_docs, top in ((5, 7), (1, 50)) if held > 7 else ((5, 7),):
        got = bag(divergence.source_divergence(with_clashes(docs), min_docs=min_docs, top=top).collect())
        assert got == brute_divergence(rows, min_docs, top)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_pieces_cut_no_term(monkeypatch):
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("ab é漢_1 ") for _ in range(60)).encode()
        whole = re.findall(divergence.TERM, text)
        monkeypatch.setattr(divergence, "CHUNK", rng.randint(1, 20))
        assert [t for p in divergence._pieces(text) for t in re.findall(divergence.TERM, p)] == whole


def test_radix_select_breaks_ties_by_bytes(spark):
    rng = random.Random(5)
    rows = []
    for g in range(6):
        texts = {"".join(rng.choice("ab~é漢𝒳") for _ in range(rng.randint(0, 6))) for _ in range(120)} | {"same start " * 5 + str(k) for k in range(20)}
        rows += [(g, t, rng.choice([0, 1, 70_000, 2**32 - 1] if g % 2 else [9])) for t in texts]
    rows += [(7, "one", 1), (8, None, 5), (9, "x", 3), (9, "xx", 3), (9, "x\x00", 3)]
    df = spark.createDataFrame(rows, "g long, t string, v long").where("t is not null")
    for top in (1, 2, 30, 1000):
        got = {(r.g, r.t, r.v) for r in divergence.select_top(df, ["g"], value="v", text="t", top=top).collect()}
        want = set()
        for g in {r[0] for r in rows}:
            want |= set(sorted((r for r in rows if r[0] == g and r[1] is not None), key=lambda r: (-r[2], r[1].encode()))[:top])
        assert got == want


# ---- personal data ----

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        spans = []
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(sum(divmod(d * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            spans.append(m.span())
        out[kind] = spans
    return out


def with_luhn(rng, n):
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(body + d for d in "0123456789" if pii.luhn(body + d))


def odd_text(rng):
    pieces = ["@", "+", ".", "-", " ", "1", "25", "255", "256", "0001", "a", "B_", "%", "x.y", "é", "İ", "(", ")", "\n", "٣", "+49 (30) 1234567", "a@b.c", "1.2.3.4", "@b", "..", "--", "tel:", "[at]", " [dot] ", "https://", "u:p@h.org", "IBAN: ", "ssn ", "123-45-6789"]
    out = [rng.choice(pieces) for _ in range(rng.randint(0, 25))]
    if rng.random() < 0.4:
        card = with_luhn(rng, rng.randint(12, 20))
        out.insert(rng.randint(0, len(out)), rng.choice(["", " ", "-"]).join(card[k : k + 4] for k in range(0, len(card), 4)))
    return "".join(out)


def test_base_spans_like_the_patterns():
    rng, finder, seen = random.Random(8), pii.Finder(), Counter()
    for _ in range(30_000):
        text = odd_text(rng)
        got = finder.spans(text)
        want = brute_base(text)
        assert {k: got[k] for k in pii.BASE} == want, text
        seen.update({k: len(v) for k, v in got.items()})
    assert min(seen[k] for k in pii.KINDS) > 0, seen


@pytest.mark.parametrize(("text", "kind", "part"), [
    ("write to jane.doe [at] mail (dot) example [dot] org today", "mail", "jane.doe [at] mail (dot) example [dot] org"),
    ("jane(at)example.org.", "mail", "jane(at)example.org"),
    ("call <tel:030-1234567>", "address", "tel:030-1234567"),
    ("see https://bob:secret@host.example.org/x", "address", "https://bob:secret@host.example.org"),
    ("Sip:bob@pbx.org, or", "address", "Sip:bob@pbx.org"),
    ("IBAN: GB82 WEST 1234 5698 7654 32 is his", "account", "GB82 WEST 1234 5698 7654 32"),
    ("SSN 123-45-6789.", "account", "123-45-6789"),
    ("account number: 00-1234-567", "account", "00-1234-567"),
    ("İ passport no. X1234567", "account", "X1234567"),
])
def test_added_spans(text, kind, part):
    assert [text[a:b] for a, b in pii.Finder().spans(text)[kind]] == [part]


@pytest.mark.parametrize("text", ["look at the dot", "motel: 12345678", "https://example.org/path", "IBAN: GB82 WEST 1234 5698 7654 33", "ssn 000-12-3456", "account number: unknown", "accounts 12345678", "[at]", "name [at] home", "cassnumber ssn123456789"])
def test_clean_texts_have_no_spans(text):
    assert not any(pii.Finder().spans(text).values())


def test_very_long_texts_take_linear_time():
    finder = pii.Finder()
    for piece in ("x", "1", "1.", "tel:", "a.b-c", "@", "a@", "+1(", "[at] ", "iban ", "a://b:", "1 ", "acct:"):
        finder.spans(piece * 300_000)
    assert finder.spans("x" * 1_000_000 + " a@b.co")["email"] == [(1_000_001, 1_000_007)]


def test_personal_data_of_odd_rows(spark):
    rng = random.Random(2)
    texts = [None, "", "same a@b.co", "same a@b.co", "😀 1.2.3.4", "x" * 3000 + " a@b.co", "1" * 2000, "1." * 1000, "tel:" * 500, "a.b-c" * 500, "@" * 1000, "+1" + "(" * 1000] + [odd_text(rng) for _ in range(100)]
    docs = spark.createDataFrame([(None if k == 3 else k // 2, t, "en", "s") for k, t in enumerate(texts)], DOCS)
    got = pii.personal_data_report(with_clashes(docs)).collect()
    want = []
    finder = pii.Finder()
    for k, t in enumerate(texts):
        base = brute_base(t or "")
        told = ",".join(f"{kind}:{a}:{b}" for kind in PATTERNS for a, b in base[kind])
        spans = finder.spans(t)
        everything = ",".join([*([told] if told else []), *(f"{kind}:{a}:{b}" for kind in pii.KINDS[4:] for a, b in spans[kind])])
        want.append((None if k == 3 else k // 2, *(len(v) for v in base.values()), hashlib.sha256(told.encode()).hexdigest(), everything))
    assert bag(got) == bag(want)
    assert pii.personal_data_report(docs.limit(0)).count() == 0
    full = pii.personal_data(docs.where("doc_id = 1 or doc_id is null")).collect()
    assert [[tuple(x) for x in r.pii] for r in full] == [[("email", 5, 11)]] * 2
