"""License scan against a plain search over all stretches, and odd tables."""

import random
import re

from loamwork.llm import license_scan


def words_of(text):
    return [m for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", text or "")]


def plain(text, templates, least=0.8):
    """Names of templates of which a stretch as long as the template holds the part of its shingles."""
    w = [m[0].lower() for m in words_of(text)]
    out = set()
    for name, body in templates:
        t = [m[0].lower() for m in words_of(body)]
        size = min(license_scan.SHINGLE, len(t))
        want = {tuple(t[i : i + size]) for i in range(len(t) - size + 1)}
        have = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
        long = len(t) - size + 1
        if any(len(want & set(have[a : a + long])) >= least * len(want) for a in range(max(1, len(have) - long + 1))):
            out.add(name)
    return out


def test_finds_what_a_plain_search_finds(docs_of):
    random.seed(7)
    rows = []
    for i in range(160):
        name, body = random.choice(license_scan.TEMPLATES)
        words = body.split(" ")
        for _ in range(random.choice([0, 0, 1, 2, 4])):
            words[random.randrange(len(words))] = f"w{random.randint(0, 99)}"
        if i % 3 == 0:
            del words[random.randrange(len(words))]
        around = lambda: " ".join(f"w{random.randint(0, 500)}" for _ in range(random.randint(0, 300)))
        rows.append((i, f"{around()}\n// {' '.join(words).upper() if i % 5 == 0 else ' '.join(words)} é {around()}"))
    out = {r.doc_id: r for r in license_scan.scan(docs_of(rows)).collect()}
    for i, text in rows:
        found = set(out[i].licenses.split(",")) - {""}
        assert plain(text, license_scan.TEMPLATES) <= found, i
        for span in filter(None, out[i].spans.split(",")):
            name, a, b = span.split(":")
            body = dict(license_scan.TEMPLATES)[name]
            t = [m[0].lower() for m in words_of(body)]
            w = [m[0].lower() for m in words_of(text[int(a) : int(b)])]
            size = min(license_scan.SHINGLE, len(t))
            want = {tuple(t[k : k + size]) for k in range(len(t) - size + 1)}
            assert len(want & {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}) >= 0.8 * len(want) - 1e-9


def test_odd_tables(docs_of):
    text = license_scan.TEMPLATES[0][1]
    rows = [(None, text), (1, text), (1, text), (2, None), (3, ""), (4, "x" * 1_000_000), (5, "a b " * 300_000 + text)]
    docs = docs_of(rows)
    for name in ("n_matches", "licenses", "spans"):
        docs = docs.withColumn(name, docs.lang)
    assert sorted(((r.doc_id or 0), r.n_matches) for r in license_scan.scan(docs).collect()) == [(0, 1), (1, 1), (1, 1), (2, 0), (3, 0), (4, 0), (5, 1)]
    assert license_scan.scan(docs_of([])).count() == 0
