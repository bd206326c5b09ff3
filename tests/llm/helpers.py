"""Small tables with the awkward cases: nulls, empty and long texts, ties, copies, clashing column names."""

import random

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, h long, n int, x int, rid long, sub int, rank long, spans string, block int, `order` int"


def awkward(seed=1, n=60):
    r = random.Random(seed)
    syl = ["the", "an", "er", "ou", "ble", "é", "ß", "tion", "re", "你", "x"]
    word = lambda: "".join(r.choice(syl) for _ in range(r.randint(1, 3)))
    para = lambda k: " ".join(word() for _ in range(k))
    shared = para(70)
    texts = [None, "", " ", "\n\n", "a", "ab cd", "é" * 300, "ab" * 400, shared, shared + "\n" + para(30), para(20) + " " + shared, "MIT", "Under the MIT License, ok. under the mit license", "Apache-License Version 2 x cc by/NC", "one " * 3000, "<|endoftext|> a 's don't ½ ﬁ İ", "▁ a  b ▁▁c", "\x00\x1f z"]
    while len(texts) < n:
        t = para(r.choice([3, 30, 120]))
        if r.random() < 0.3:
            cut = r.randint(0, len(t))
            t = t[:cut] + shared[r.randint(0, 50) :] + t[cut:]
        texts.append(t)
        if r.random() < 0.2:
            texts.append(t)
        if r.random() < 0.2:
            texts.append(t.replace("the", "re", 1))
    ids = r.sample(range(0, 5 * len(texts)), len(texts))
    return list(zip(ids, texts))


def frame(spark, rows, parts=3):
    """rows: (doc_id, text). Further columns carry names that the operators use inside."""
    full = [(i, t, ["en", "fr", None][k % 3], ["src0", "src1", None, "src0"][k % 4], len(t or ""), 1, 2, 3, 4, 5, 6, 7, "s", 8, 9) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)
