import re, random
from collections import defaultdict
from quillstack.llm import licenses
from .helpers import awkward, frame


def brute_cover(w, template):
    """Best share of a template's 3-grams in order inside a band of diagonals, by plain quadratic search."""
    t = template.split()
    grams = len(t) - 2
    width = max(2, int(grams * (licenses.STRETCH - 1)))
    at = defaultdict(list)
    for j in range(grams):
        at[tuple(t[j : j + 3])].append(j)
    bands = defaultdict(set)
    for p in range(len(w) - 2):
        for j in at.get(tuple(w[p : p + 3]), ()):
            bands[0, (p - j) // width].add((p, j))
            bands[1, (p - j + width // 2) // width].add((p, j))
    best = 0
    for own in bands.values():
        own = sorted(own)
        chain = []
        for p, j in own:
            chain.append(1 + max((c for (q, i), c in zip(own, chain) if q < p and i < j), default=0))
        best = max(best, *chain)
    return best / grams


def words_of(t):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def license_texts(n=80, seed=9):
    """Template texts edited at random: words put in, dropped, doubled, whole copies repeated, grams said again and again."""
    r = random.Random(seed)
    out = ["redistribution and use " * 13, "permission is hereby granted " * 30 + "without restriction", licenses.TEMPLATES["isc"] + " x " + licenses.TEMPLATES["isc"]]
    for _ in range(n):
        w = r.choice(list(licenses.TEMPLATES.values())).split()
        for _ in range(r.randint(0, 12)):
            k = r.randrange(len(w))
            kind = r.random()
            w[k : k + 1] = [] if kind < 0.3 else [w[k], "so"] if kind < 0.6 else w[max(0, k - 3) : k + 1] * 2 if kind < 0.8 else [w[k]] + ["pad"] * r.randint(1, 9)
            w = w or ["x"]
        out.append(" ".join(["lead"] * r.randint(0, 40) + w * r.choice([1, 1, 2]) + ["tail"]))
    return out


def test_template_labels(spark):
    rows = list(enumerate(license_texts()))
    rows += [(5000 + i, t) for i, t in awkward() if t != "one " * 3000]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        w = words_of(t)
        cover = {label: brute_cover(w, text) for label, text in licenses.TEMPLATES.items()}
        base = set(filter(None, got[i].base_labels.split(",")))
        assert set(filter(None, got[i].labels.split(","))) == base | {x for x, c in cover.items() if c >= licenses.COVER}, i
        assert abs(got[i].score - (1 if base else max(cover.values()))) < 1e-9
    assert got[0].labels == "" and got[1].labels == "" and got[2].labels == "isc"
    assert sum(bool(r.labels) for r in got.values()) > 30


def test_license_rows_repeat(spark):
    t = "Under the MIT license"
    got = licenses.scan(frame(spark, [(1, t), (1, t), (1, "other"), (None, t), (None, None), (2, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_base) for r in got) == [(0, 0, 0), (0, 4, 1), (1, 1, 0), (1, 4, 1), (1, 4, 1), (2, 0, 0)]
