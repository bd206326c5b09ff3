"""Toxicity by weak supervision.

Voters are a seed lexicon, patterns (insults to a second person, spelled apart or disguised, shouted), and words and word
beginnings that labelled rows show to be telling; most vote `toxic` where they occur, some `clean`, and elsewhere they
abstain. A generative model (two latent classes) is fitted to the votes by expectation-maximisation, giving each voter's
accuracy; residual correlations of the voters within the classes are then estimated, and voters that echo each other share
one voice. The rows' own labels mine the voters, set the classes' shares, and are one more voter, whose errors are
estimated like any other's. The posteriors, not the labels, train a linear classifier over the presence of words and word
beginnings, which scores every text.

The fit looks at no more than max_train labelled documents (those of the smallest id hashes), one text of each id, and keeps
at most VOCABULARY features, whatever the size of the corpus; scoring reads every whole text and shuffles nothing.

Defined results: null and empty texts get the score of a text without features; without labelled rows the seed
lexicon alone decides; rows of a null id are not held out; of the texts of one id the smallest trains, each is scored.
Among labels, null counts as missing, and any 1 for an id outweighs 0. Repeated rows are scored apart; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted, slices

#: Labelled documents, features of the classifier, mined voters for toxic and clean, rows that a voter must stand in.
MAX_TRAIN, VOCABULARY, VOTERS, CLEAN_VOTERS, MIN_SUPPORT = 12_000, 2048, 64, 16, 4
#: An error on a toxic text counts as so many on clean ones, of which there are more.
TOXIC_WEIGHT = 3.0
PREFIXES = (4, 5, 6)
# Seed lexicon.
SEEDS = ("idiot", "moron", "stupid", "trash", "scum", "loser", "pathetic", "worthless", "disgusting", "clown")
_ANY = "|".join(SEEDS)
#: Pattern voters.
PATTERNS = {
    "~addressed": re.compile(rf"(?i)\b(?:you|your|you're|ur|thou)\b(?:\W+\w+){{0,4}}\W+(?:{_ANY})s?\b|\b(?:{_ANY})s?\b\W+(?:you|your)\b"),
    "~apart": re.compile("(?i)" + "|".join(rf"\b{'[ ._*-]'.join(x)}\b" for x in SEEDS)),
    "~disguised": re.compile("(?i)" + "|".join(rf"\b(?!{x}){''.join({'a': '[a@4]', 'e': '[e3]', 'i': '[i1!|]', 'o': '[o0]', 's': '[s$5]', 't': '[t7]', 'l': '[l1|]'}.get(c, c) for c in x)}" for x in SEEDS)),
    "~shouted": re.compile(rf"\b(?:{_ANY.upper()})S?\b"),
    "~again": re.compile(rf"(?i)\b({_ANY})\b(?=(?:\W+\w+){{0,8}}\W+\1\b)"),
}
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Lower-cased words, beginnings of longer words marked by a star, and names of patterns."""
    seen = set(_WORD.findall((text or "").lower()))
    return seen | {w[:k] + "*" for w in seen for k in PREFIXES if len(w) > k} | {name for name, p in PATTERNS.items() if p.search(text or "")}


@dataclass
class Model:
    """weights by feature; bias."""

    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        self.words = {f: w for f, w in self.weights.items() if not f.endswith("*")}
        self.starts = {f[:-1]: w for f, w in self.weights.items() if f.endswith("*")}
        self.sizes = sorted({len(f) for f in self.starts})

    def score(self, text: str | None) -> float:
        z, words, starts = self.bias, self.words, self.starts
        seen = set(_WORD.findall((text or "").lower()))
        for w in seen & words.keys():
            z += words[w]
        for k in self.sizes:
            for p in {w[:k] for w in seen if len(w) > k} & starts.keys():
                z += starts[p]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def label_model(votes: np.ndarray, prior: float, given: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of `toxic`, the voters' accuracies where they vote, and their voices after correlation.

    votes: 1 for toxic, -1 for clean, 0 where a voter abstains; abstaining says nothing, so that voters for one language
    don't speak against texts of another. given: labels 0/1, which count as one more voter that never abstains,
    and start the estimate.
    """
    v = votes.astype(np.float64)
    toxic, clean = v.clip(0), (-v).clip(0)
    base, voice = math.log(prior / (1 - prior)), np.ones(v.shape[1])
    odds = lambda right: np.log(np.clip(right, 1e-4, 1 - 1e-4) / (1 - np.clip(right, 1e-4, 1 - 1e-4)))
    p = np.clip(given.astype(np.float64), 0.02, 0.98)
    for i in range(rounds):
        # How often each voter is right where it says toxic, and where it says clean.
        told, cleared = (p @ toxic + prior) / (toxic.sum(0) + 1), ((1 - p) @ clean + 1 - prior) / (clean.sum(0) + 1)
        if i == rounds // 2:
            # Correlations left within the classes: a voter's voice is shared with those that echo it.
            r1, r0 = v - (p @ v) / (p.sum() + 1e-9), v - ((1 - p) @ v) / ((1 - p).sum() + 1e-9)
            cov = (r1 * p[:, None]).T @ r1 + (r0 * (1 - p)[:, None]).T @ r0
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            echo = cov / np.outer(sd, sd)
            voice = 1 / np.maximum(1.0, np.where(echo > 0.1, np.minimum(echo, 1), 0).sum(1))
        hit, slip = (p @ given + 1) / (p.sum() + 2), ((1 - p) @ given + 0.5) / ((1 - p).sum() + 5)
        # A vote speaks by how much rarer or more frequent it makes the class than it is by now.
        now = odds(p.mean())
        z = base + toxic @ (voice * (odds(told) - now)) - clean @ (voice * (odds(cleared) + now)) + np.where(given > 0, math.log(hit / slip), math.log((1 - hit) / (1 - slip)))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - p).max() < 1e-6 and i > rounds // 2:
            break
        p = new
    accuracy = (told * toxic.sum(0) + cleared * clean.sum(0)) / np.maximum(1, np.abs(v).sum(0))
    return p, accuracy, voice


def linear_fit(rows: list[np.ndarray], target: np.ndarray, size: int, rounds: int = 300, penalty: float = 1e-4, weight: float = TOXIC_WEIGHT) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets; rows list the features present in each text. weight: of target 1 against 0."""
    w, bias = np.zeros(size), 0.0
    if not rows:
        return w, bias
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
    g2, b2, heavy = np.full(size, 1e-6), 1e-6, 1 + (weight - 1) * target
    for _ in range(rounds):
        z = bias + np.bincount(doc, w[col], minlength=len(rows))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * heavy
        grad = np.bincount(col, err[doc], minlength=size) / len(rows) + penalty * w
        gb = err.mean()
        g2 += grad**2
        b2 += gb**2
        w -= 0.5 * grad / np.sqrt(g2)
        bias -= 0.5 * gb / math.sqrt(b2)
    return w, bias


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _seed_model() -> Model:
    return Model({s: 4.0 for s in SEEDS}, -2.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Fit on labelled rows that are not held out."""
    lab = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    lab = lab.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # The ids chosen are at most max_train, so that texts stay where they are; of each id one text stays.
    train = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    train = train.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(features(t.as_py())) for t in b.column(1)], pa.list_(pa.string())), b.column(2)], ["doc_id", "f", "y"])

    seen = cut(train.mapInArrow(extract, "doc_id long, f array<string>, y int"), "features")
    total, toxic = seen.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not toxic or toxic == total:
        return _seed_model()
    # How telling a feature is: signed log-likelihood ratio of its two rates.
    c = seen.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).filter(F.col("n") >= MIN_SUPPORT)
    n1, n0 = float(toxic), float(total - toxic)
    a, b = (F.col("pos") + 0.05) / (n1 + 0.1), (F.col("n") - F.col("pos") + 0.05) / (n0 + 0.1)
    pool = (F.col("n") + 0.1) / (n1 + n0 + 0.2)
    ratio = F.col("pos") * F.log(a / pool) + (F.col("n") - F.col("pos")) * F.log(b / pool)
    c = c.select("f", F.round(F.when(a > b, ratio).otherwise(-ratio), 6).alias("g"), (F.col("pos") / F.col("n")).alias("rate"))
    telling = [F.desc(F.abs("g")), "f"]
    top = c.filter(~F.col("f").startswith("~")).orderBy(*telling).limit(VOCABULARY).collect()
    vocabulary = [r["f"] for r in top]
    # The seeds, the patterns, and a bounded number of mined voters of either side.
    share = toxic / total
    patterns = [r["f"] for r in c.filter((F.col("f").startswith("~")) & (F.col("g") > 0)).collect()]
    mined = [r["f"] for r in top if r["g"] > 0 and r["rate"] > max(0.5, share)][:VOTERS]
    against = [r["f"] for r in top if r["g"] < 0 and r["rate"] < share / 2][:CLEAN_VOTERS]
    voters = list(dict.fromkeys([*[s for s in SEEDS if s in vocabulary], *patterns, *mined]))
    if not voters:
        return _seed_model()
    names = [*vocabulary, *patterns]
    at = {f: i for i, f in enumerate(names)}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array([at[f] for f in x.as_py() if f in at], np.int16).tobytes() for x in b.column(1)], pa.binary()), b.column(2)], ["doc_id", "cols", "y"])

    # At most max_train rows, one an id, of two-byte numbers of features.
    sample = sorted(seen.select("doc_id", "f", "y").mapInArrow(code, "doc_id long, cols binary, y int").collect(), key=lambda r: r["doc_id"])
    found = [np.frombuffer(r["cols"], np.int16) for r in sample]
    votes = votes_of(found, [at[v] for v in voters], [at[v] for v in against], len(names))
    posterior, _, _ = label_model(votes, share, np.array([r["y"] > 0 for r in sample], np.int64))
    w, bias = linear_fit([r[r < len(vocabulary)] for r in found], posterior, len(vocabulary))
    return Model({f: float(x) for f, x in zip(vocabulary, w) if abs(x) > 1e-4}, float(bias))


def votes_of(found: list[np.ndarray], toxic: list[int], clean: list[int], size: int) -> np.ndarray:
    """The votes (a row for each text) of features that vote toxic and of features that vote clean."""
    number = np.full(size, -1)
    number[toxic] = np.arange(len(toxic))
    number[clean] = len(toxic) + np.arange(len(clean))
    votes = np.zeros((len(found), len(toxic) + len(clean)), np.int8)
    for i, r in enumerate(found):
        own = number[r]
        votes[i, own[own >= 0]] = 1
    votes[:, len(toxic) :] *= -1
    return votes


def score_column(model: Model, text: Column) -> Column:
    """score as a column; one Arrow batch at a time."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return score(text)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row."""
    out = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.coalesce(held_out(F.col(quoted(id_col)).cast("long")), F.lit(False)).alias("held_out"), score_column(model, F.col(quoted(text_col))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
