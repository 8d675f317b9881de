"""Toxicity by weak supervision.

Voters are lexicon entries (whole words and word beginnings that are over-represented in
documents labelled toxic) and fixed patterns. A generative label model gives each voter the
chance to fire on a toxic and on a clean document, found by expectation-maximisation over a
sample of all documents; voters that fire together more than their accuracies explain are
taken as correlated and share their weight. Its posterior labels then train a linear
classifier on hashed words, beginnings and character n-grams, which scores whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewscope.llm.common import bounded_rows, labelled_rows
from renewscope.llm.hashtable import FrozenMap
from renewscope.llm.subword import LETTERED, WORDS, features
from renewscope.session import through_table

#: Labelled rows a class and bytes that voters are mined from; further rows for the label model and the
#: classifier, by bytes, where each row counts ROW_BYTES more.
MINE_ROWS, MINE_BYTES, SAMPLE_BYTES, ROW_BYTES = 5_000, 12_000_000, 12_000_000, 1_000
MAX_VOTERS, STEMS = 400, (4, 5, 6, 7)
#: A lexicon entry is in so many toxic documents at least, and so many times as often as in clean ones.
LEAST_DOCS, LEAST_LIFT = 5, 8.0
#: Patterns: insults addressed to a reader, shouting, masked letters. Any of them may turn out to be useless.
PATTERNS = (
    r"\byou(?:'re| are)? (?:an? )?\w+\b[!?]", r"\b(?:shut up|go away|get lost|drop dead)\b",
    r"\b[a-z]+\*{2,}[a-z]*\b", r"!{3,}", r"\b(?:hate|kill|hurt) (?:you|him|her|them)\b",
)
ROUNDS, CORRELATED = 25, 0.6
#: Accuracy of a label where one is known.
TRUST = 0.98
#: Share of a text's words from which an entry or feature is dense in it.
DENSE = 0.01
#: Hashed features: character n-grams and word beginnings, and how many of them the classifier keeps.
SIZES, PREFIXES, MAX_FEATURES = (5,), (4, 5, 6), 50_000
EPOCHS, RATE, DECAY, SEED = 15, 0.3, 1e-4, 11

#: Odd factors of four hash functions.
_SIGNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_WORD = re.compile(r"[^\W_]+")


def entries(text: str) -> set[str]:
    """Lexicon entries of a text: words, word beginnings ending in *, and either with a final @ if at
    least DENSE of all words are of that entry, as a single one in a long text may be chance."""
    words = Counter(_WORD.findall(text.lower()))
    counts = Counter(words)
    for w, n in words.items():
        for size in STEMS:
            if len(w) > size:
                counts[w[:size] + "*"] += n
    least = DENSE * words.total()
    return counts.keys() | {e + "@" for e, n in counts.items() if n >= least}


def distinct_texts(sample: DataFrame) -> DataFrame:
    """Rows of a bounded sample (doc_id, text, ...) without copies and near copies, by id order.

    A word that only one text and its copies hold would look like a lexicon entry. Four min-hashes
    of three-word shingles are compared; a row stays if it is the first with each of its four."""

    def signed(batches):
        for batch in batches:
            least = np.full((len(_SIGNS), batch.num_rows), np.iinfo(np.uint64).max, np.uint64)
            for _, rows, words in features(batch.column(1), LETTERED, ()):
                three = words[:-2] ^ _turned(words[1:-1], 17) ^ _turned(words[2:], 41) if len(words) > 2 else words[:0]
                at = rows[:-2][rows[:-2] == rows[2:]] if len(words) > 2 else rows[:0]
                three = three[rows[:-2] == rows[2:]] if len(words) > 2 else three
                for k, factor in enumerate(_SIGNS):
                    np.minimum.at(least[k], rows, words * factor | np.uint64(1 << 63))  # counts only if there is no shingle
                    np.minimum.at(least[k], at, three * factor >> np.uint64(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x.view(np.int64)) for x in least]], ["doc_id", *[f"s{k}" for k in range(len(_SIGNS))]])

    kind = sample.schema["doc_id"].dataType.simpleString()
    signs = sample.select("doc_id", "text").mapInArrow(signed, f"doc_id {kind}, " + ", ".join(f"s{k} long" for k in range(len(_SIGNS)))).toPandas()
    signs = signs.sort_values(list(signs.columns), ignore_index=True)
    first = np.ones(len(signs), bool)
    for k in range(len(_SIGNS)):
        first &= ~signs[f"s{k}"].duplicated().to_numpy()
    kept = sample.sparkSession.createDataFrame(signs.loc[first, ["doc_id"]].rename(columns={"doc_id": "kept"}), f"kept {kind}")
    return sample.join(F.broadcast(kept), F.col("doc_id") == F.col("kept"), "left_semi")


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def mine(labelled: DataFrame, max_voters: int = MAX_VOTERS) -> list[tuple[str, float, float]]:
    """(entry, share of toxic documents, share of clean ones), the most telling entries first.

    Counted in Spark by entry; only the best ones come to the driver."""

    def counted(batches):
        for part in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            n = {0: Counter(), 1: Counter()}
            for label, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                n[label].update(entries(text))
            keys = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([n[c][k] for k in keys], pa.int64()) for c in (0, 1)]], ["entry", "clean", "toxic"])

    totals = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return []
    per = labelled.select("label", "text").mapInArrow(counted, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    toxic, clean = F.col("toxic") / F.lit(totals[1]), (F.col("clean") + F.lit(2.0)) / F.lit(totals[0] + 4)
    telling = per.where((F.col("toxic") >= LEAST_DOCS) & (toxic / clean >= LEAST_LIFT))
    best = telling.orderBy((toxic * F.log(toxic / clean)).desc(), "entry").limit(max_voters).collect()
    return [(r["entry"], r["toxic"] / totals[1], (r["clean"] + 2.0) / (totals[0] + 4)) for r in best]


class Voters:
    """Which voters fire on a text."""

    def __init__(self, lexicon: list[str]):
        self.lexicon = {e: i for i, e in enumerate(lexicon)}
        self.patterns = PATTERNS

    def __len__(self) -> int:
        return len(self.lexicon) + len(self.patterns)

    def fire(self, text: str) -> list[int]:
        lower = text.lower()
        fired = {self.lexicon[e] for e in entries(lower) & self.lexicon.keys()}
        return sorted(fired | {len(self.lexicon) + i for i, p in enumerate(self.patterns) if re.search(p, lower)})


@dataclass
class LabelModel:
    """Chance of each voter to fire on clean and toxic documents, weights for correlation, prior."""

    fires: np.ndarray
    weights: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray, known: np.ndarray) -> np.ndarray:
        """A voter that doesn't fire abstains; that none fires at all is the last voter's vote; a known
        label is one more vote of accuracy TRUST."""
        clean, toxic = self.fires
        z = votes @ (self.weights * np.log(toxic / clean)) + np.log(self.prior / (1 - self.prior))
        z += np.where(known < 0, 0, 2 * known - 1) * np.log(TRUST / (1 - TRUST))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_label_model(votes: np.ndarray, known: np.ndarray, start: np.ndarray, prior: float, strength: float = 50.0) -> LabelModel:
    """Expectation-maximisation from the mined shares, which stay as pseudo-documents.

    `known`: 0 or 1 where a row has a label, which counts as one more voter of accuracy TRUST and
    keeps voters from confirming each other; -1 elsewhere. In each round voters whose firing is
    correlated given the class, by the posterior, form groups (chains of correlations above
    CORRELATED); a member's weight is one over the group's effective number of equal votes."""
    model = LabelModel(np.clip(start, 1e-4, 0.99), np.ones(votes.shape[1]), prior)
    for _ in range(ROUNDS):
        model.weights = _shared_weights(votes, model.posterior(votes, known))
        q = model.posterior(votes, known)
        fires = [(w @ votes + strength * s) / (w.sum() + strength) for w, s in ((1 - q, start[0]), (q, start[1]))]
        fires = np.clip(np.array(fires), 1e-4, 0.99)
        done = np.abs(fires - model.fires).max() < 1e-5
        model.fires = fires
        free = known < 0  # labelled rows are chosen by label, so they don't tell the prior
        model.prior = float(np.clip((q[free].sum() + strength * prior) / (free.sum() + strength), 1e-3, 0.5))
        if done:
            break
    return model


def _shared_weights(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    r = np.zeros((votes.shape[1],) * 2)
    for w in (q, 1 - q):
        if w.sum() < 2:
            continue
        mean = w @ votes / w.sum()
        joint = (votes * w[:, None]).T @ votes / w.sum()
        spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
        r = np.maximum(r, (joint - np.outer(mean, mean)) / np.outer(spread, spread))
    linked = r > CORRELATED
    np.fill_diagonal(linked, True)
    weights, left = np.ones(len(r)), set(range(len(r)))
    while left:
        group, reached = set(), {left.pop()}
        while reached:
            group |= reached
            reached = {int(j) for i in reached for j in np.flatnonzero(linked[i])} - group
        left -= group
        members = sorted(group)
        if len(members) > 1:
            inside = r[np.ix_(members, members)]
            mean = np.clip((inside.sum() - np.trace(inside)) / (len(members) * (len(members) - 1)), 0, 1)
            weights[members] = 1 / (1 + (len(members) - 1) * mean)
    return weights


def _present(texts: pa.Array, known: FrozenMap | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, dense) of each feature that a text has; features are hashes, or rows of a map if one is given."""
    words, keys = np.zeros(len(texts), np.int64), []
    for kind, rows, hashes in features(texts, LETTERED, SIZES, PREFIXES):
        if kind == WORDS:
            words += np.bincount(rows, minlength=len(texts))
        found = hashes if known is None else known.find(hashes)
        if known is not None:
            hit = found >= 0
            rows, found = rows[hit], found[hit]
        keys.append((rows, found.astype(np.uint64)))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    rows, found = (np.concatenate(x) for x in zip(*keys))
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])))) if len(rows) else np.zeros(0, int)
    n = np.diff(np.append(first, len(rows)))
    rows, found = rows[first], found[first]
    return rows, found, n >= DENSE * words[rows]


def cast_votes(sample: DataFrame, voters: Voters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, label, votes) of every sampled row (at, text, label), in order of number. The last voter
    fires where no other does."""

    def run(batches):
        for part in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            fired = [voters.fire(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(fired, pa.list_(pa.int32()))], ["at", "label", "fired"])

    rows = sample.select("at", "text", "label").mapInArrow(run, "at long, label int, fired array<int>").toArrow().sort_by("at")
    fired = rows.column("fired").combine_chunks()
    votes = np.zeros((rows.num_rows, len(voters) + 1), np.float32)
    votes[np.repeat(np.arange(rows.num_rows), np.diff(fired.offsets.to_numpy())), fired.flatten().to_numpy()] = 1
    votes[:, -1] = votes.sum(axis=1) == 0
    return rows.column("at").to_numpy(), rows.column("label").to_numpy(), votes


def telling_features(sample: DataFrame, at: np.ndarray, q: np.ndarray, max_features: int = MAX_FEATURES) -> list[tuple[int, int]]:
    """(hash, dense) of the features whose share of toxic documents, by posterior, tells most against the
    whole. Counted in Spark by feature; only the best ones come to the driver."""
    spark = sample.sparkSession
    known = spark.sparkContext.broadcast((at, q.astype(np.float32)))  # one number a sampled row

    def run(batches):
        numbers, q = known.value
        for part in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            own = q[np.searchsorted(numbers, part.column(0).to_numpy())]
            rows, found, dense = _present(part.column(1))
            rows, found, dense = np.concatenate((rows, rows[dense])), np.concatenate((found, found[dense])), np.repeat([0, 1], [len(rows), int(dense.sum())])
            for flag in (0, 1):
                keys, which, n = np.unique(found[dense == flag], return_inverse=True, return_counts=True)
                inside = np.bincount(which, own[rows[dense == flag]], len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), flag, np.int32)), pa.array(n), pa.array(inside)], ["feature", "dense", "n", "inside"])

    share = min(max(float(q.mean()) if len(q) else 0.0, 1e-6), 0.999)
    counted = sample.select("at", "text").mapInArrow(run, "feature long, dense int, n long, inside double").groupBy("feature", "dense").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"))
    p = (F.col("inside") + share) / (F.col("n") + 1.0)
    clean = F.greatest(1 - p, F.lit(1e-9))
    told = F.col("n") * (p * F.log(p / share) + clean * F.log(clean / (1 - share)))
    best = counted.where("n >= 3").select("feature", "dense", told.alias("told")).where("told > 6").orderBy(F.desc("told"), "feature", "dense").limit(max_features)
    return [(r["feature"], r["dense"]) for r in best.collect()]


@dataclass
class Classifier:
    """Weights of hashed features that a text has, and further ones of those that are dense in it."""

    features: FrozenMap
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        rows, at, dense = _present(texts, self.features)
        gain = self.weights[at.astype(np.int64)]
        z = self.bias + np.bincount(rows, gain[:, 0] + np.where(dense, gain[:, 1], 0.0), len(texts)) if len(rows) else np.full(len(texts), self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_classifier(sample: DataFrame, at: np.ndarray, q: np.ndarray, chosen: list[tuple[int, int]]) -> Classifier:
    """Logistic regression on posterior labels, by stochastic gradients over the sampled rows."""
    keys = np.unique(np.array([f for f, _ in chosen], np.int64).view(np.uint64))
    model = Classifier(FrozenMap(keys, np.zeros(0)), np.zeros((len(keys), 2)), 0.0)
    used = np.zeros(2 * len(keys), bool)
    used[[2 * int(np.searchsorted(keys, np.uint64(f % (1 << 64)))) + d for f, d in chosen]] = True
    shared = sample.sparkSession.sparkContext.broadcast((model.features, used))  # at most MAX_FEATURES keys

    def run(batches):
        features_, used = shared.value
        for part in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            rows, found, dense = _present(part.column(1), features_)
            found = 2 * found.astype(np.int64)
            rows, found = np.concatenate((rows, rows[dense])), np.concatenate((found, found[dense] + 1))
            rows, found = rows[used[found]], found[used[found]]
            order = np.lexsort((found, rows))
            cuts = np.searchsorted(rows[order], np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(found[order].astype(np.int32)))], ["at", "columns"])

    lists = sample.select("at", "text").mapInArrow(run, "at long, columns array<int>").toArrow().sort_by("at").column("columns").combine_chunks()
    cuts, columns, size = lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0), lists.flatten().to_numpy(), len(q)
    share = q.mean() if size else 0.0
    weights, bias = np.zeros(2 * len(keys)), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    rng = np.random.default_rng(SEED)
    seen = np.zeros(2 * len(keys))  # squared gradients, so that rare features learn as fast as common ones
    step = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(size):
            c = columns[cuts[i] : cuts[i + 1]]
            error = 1 / (1 + np.exp(-np.clip(weights[c].sum() + bias, -30, 30))) - q[i]
            if len(c):
                seen[c] += error * error
                weights[c] -= RATE * (error / np.sqrt(seen[c] + 1e-2) + DECAY * weights[c]) / max(1.0, len(c) ** 0.5)
            step += 1
            bias -= 0.05 * error / (1 + step / size)
    return Classifier(model.features, weights.reshape(-1, 2), bias)


def train(docs: DataFrame, labels: DataFrame, sample_bytes: int = SAMPLE_BYTES, **bounds) -> Classifier:
    """Voters from labelled rows, label model and classifier from a sample of all rows' texts.

    `docs` has doc_id and text; labels has doc_id and label. Without labels of both kinds there are
    no lexicon voters, and scores stay near the prior. Null texts and ids are not sampled."""
    labelled = through_table(labelled_rows(docs, labels, bounds.get("max_rows", MINE_ROWS), bounds.get("max_bytes", MINE_BYTES)), "toxic-labelled")
    labelled = through_table(distinct_texts(labelled), "toxic-distinct")
    lexicon = mine(labelled)
    counts = {r["label"]: r["n"] for r in labels.where("label IN (0, 1)").groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = float(np.clip((counts.get(1, 0) + 1) / (sum(counts.values()) + 10), 1e-3, 0.5))
    voters = Voters([e for e, _, _ in lexicon])
    # Labelled rows and further rows of any kind.
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    plain = bounded_rows(known, F.col("doc_id"), F.lit(0), F.octet_length("text") + ROW_BYTES, sample_bytes)
    plain = distinct_texts(through_table(plain, "toxic-sample")).join(labelled.select("doc_id"), "doc_id", "left_anti")
    sample = plain.select("doc_id", "text", F.lit(-1).alias("label")).unionByName(labelled.select("doc_id", "text", "label"))
    sample = through_table(sample.orderBy("doc_id", "label", "text").withColumn("at", F.monotonically_increasing_id()), "toxic-rows")
    at, given, votes = cast_votes(sample, voters)
    start = np.array([[c for _, _, c in lexicon] + [0.02] * len(PATTERNS) + [0.9], [t for _, t, _ in lexicon] + [0.03] * len(PATTERNS) + [0.2]])
    q = fit_label_model(votes, given, start, prior).posterior(votes, given)
    return fit_classifier(sample, at, q, telling_features(sample, at, q))


def toxicity(spark, model: Classifier, text: Column) -> Column:
    """Probability of being toxic of every whole text; a null or empty text has no features, so the bias alone."""
    shared = spark.sparkContext.broadcast(model)  # at most MAX_FEATURES weights

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(texts))

    return scored(F.coalesce(text, F.lit("")))
