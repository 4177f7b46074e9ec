"""Toxicity by weak supervision.

1. Lexicons: word beginnings that are far more frequent in toxic than in other documents, counted
   over all labelled training rows (near copies once).
2. Voters: the lexicon dealt over several voters, a seed lexicon, how many terms occur, and patterns
   (shouting, exclamation marks, masked or stretched words).  A voter says toxic, says clean, or abstains.
3. A generative label model over the vote patterns of all documents: expectation maximisation
   estimates every voter's accuracy; voters that still depend on each other given the label are
   found by conditional mutual information and modelled along a tree of such pairs.
4. A linear classifier over terms and pattern measures is trained on the posterior labels of the sample and
   scores every document.

Labels are read only where crc32 of the id as text leaves a remainder other than 0 modulo 5.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.llm.common import documents, ship_package, text_slices, utf8, window_hashes, word_hashes
from upkeep.session import Scratch

#: Labelled rows that the classifier is fitted to, at most about; terms of the lexicon at most, the
#: most frequent in toxic documents first; terms sent to the tasks at most (beyond, they are joined).
TRAIN_ROWS, TERMS, SENT_TERMS = 20_000, 20_000, 1 << 18
#: Bits of the filter over the ids of toxic rows (1 MB): up to a million ids few others pass.
FILTER_BITS = 1 << 23
#: A term occurs in so many toxic documents at least; those and its words in them (three of
#: a document at most) add up to so much at least; and it is so many times oftener there.
SUPPORT, EVIDENCE, LIFT = 3, 10, 20.0
SHORTEST, LONGEST = 4, 10
#: Seed lexicon: common English insults.
SEED = ("clown", "creep", "disgusting", "dumb", "idiot", "jerk", "loser", "moron", "pathetic",
        "scum", "stupid", "trash", "worthless")
LEXICON_VOTERS = 6
VOTERS = (*(f"lexicon{i}" for i in range(LEXICON_VOTERS)), "seed", "amount", "shouting", "marks",
          "masked", "stretched")
MEASURES = ("hits", "density", "seed", "shouting", "marks", "masked", "stretched")

_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_][*@$#]+[^\W\d_]")
_STRETCHED = re.compile(r"([^\W\d_])\1{3}")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text (null: the empty text) leaves 0 modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


# ---------------------------------------------------------------- lexicon

def terms_of(text: str) -> Counter:
    """Beginnings (SHORTEST to LONGEST letters) of the words of a text; each with its number of
    different words."""
    return Counter(w[:n] for w in set(_WORD.findall(text.lower()))
                   for n in range(SHORTEST, min(len(w), LONGEST) + 1))


def choose_terms(counts: dict[str, tuple[int, int, int]], n_toxic: int, n_clean: int) -> list[str]:
    """Terms of enough support and lift: for each family of beginnings the shortest that
    passes, lengthened while nearly all of its documents share the next letter."""
    def lift(t):
        a, b, _ = counts[t]
        return (a / max(1, n_toxic)) / ((b + 0.5) / max(1, n_clean))

    good = {t for t, (a, _, words) in counts.items()
            if a >= SUPPORT and a + words >= EVIDENCE and lift(t) >= LIFT}
    longer: dict[str, list[str]] = {}
    for t in sorted(counts):
        longer.setdefault(t[:-1], []).append(t)
    chosen = {}
    for t in sorted(good, key=lambda x: (len(x), x)):
        if any(t[:n] in good for n in range(SHORTEST, len(t))):
            continue
        best = t
        while True:
            more = max(longer.get(best, []), key=lambda x: (counts[x][0], x), default=None)
            if more is None or counts[more][0] < 0.95 * counts[t][0]:
                break
            best = more
        chosen[best] = counts[t][0]
    return sorted(sorted(chosen), key=lambda t: -chosen[t])[:TERMS]


class Reader:
    """Votes and features of texts, given the terms."""

    def __init__(self, terms: list[str]):
        self.terms, self.automaton = terms, ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self.automaton.add_word(t, (i, len(t)))
        if terms:
            self.automaton.make_automaton()
        self.seed = ahocorasick.Automaton()
        for t in SEED:
            self.seed.add_word(t, len(t))
        self.seed.make_automaton()

    def read(self, data: bytes) -> tuple[str, list[int], list[int], list[float]]:
        """(votes, term numbers, their counts, measures) of a UTF-8 text."""
        text = data.decode()
        low = text.lower()
        n = max(1, len(data.split()))
        hits: Counter = Counter()
        if self.terms:
            for end, (i, size) in self.automaton.iter(low):
                start = end - size + 1
                if not start or not low[start - 1].isalpha():
                    hits[i] += 1
        seed = sum(1 for end, size in self.seed.iter(low)
                   if (end < size or not low[end - size].isalpha())
                   and (end + 1 == len(low) or not low[end + 1].isalpha()))
        ascii_letters = len(data) - len(data.translate(None, bytes([*range(65, 91), *range(97, 123)])))
        upper = len(data) - len(data.translate(None, bytes(range(65, 91))))
        shouting = upper / ascii_letters if ascii_letters >= 20 else 0.0
        marks = data.count(b"!") / n
        masked = len(_MASKED.findall(text)) / n if b"*" in data or b"@" in data or b"$" in data or b"#" in data else 0.0
        stretched = 1.0 if _STRETCHED.search(low) else 0.0
        total = sum(hits.values())
        vote = ["-"] * LEXICON_VOTERS
        for i in hits:
            vote[i % LEXICON_VOTERS] = "1"
        vote += ["1" if seed else "-", "1" if total >= 2 else "-" if total else "0",
                 "1" if shouting > 0.5 else "-", "1" if marks > 0.1 else "-",
                 "1" if masked else "-", "1" if stretched else "-"]
        found = sorted(hits)
        return ("".join(vote), found, [hits[i] for i in found],
                [np.log1p(total), min(1.0, 10 * total / n), float(seed > 0), shouting,
                 min(1.0, marks), min(1.0, masked), stretched])


# ---------------------------------------------------------------- label model

@dataclass
class LabelModel:
    """P(toxic) and, per voter, P(vote | label, vote of its parent); votes: 0 clean, 1 toxic,
    2 abstains.  ``parent`` is -1 for voters that depend on the label only."""
    prior: float = 0.1
    parent: list[int] = field(default_factory=list)
    table: list[np.ndarray] = field(default_factory=list)
    accuracy: list[float] = field(default_factory=list)
    share: np.ndarray | None = None  # how much each voter counts while dependence is unknown
    dependence: np.ndarray | None = None

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) of each row of votes."""
        score = np.log([[1 - self.prior, self.prior]]).repeat(len(votes), axis=0)
        for k, (p, t) in enumerate(zip(self.parent, self.table)):
            above = votes[:, p] if p >= 0 else np.zeros(len(votes), np.int64)
            score += (1.0 if self.share is None else self.share[k]) * np.log(t[:, above, votes[:, k]]).T
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))


def _tables(votes, weight, toxic, parent):
    out = []
    for k, p in enumerate(parent):
        above = votes[:, p] if p >= 0 else np.zeros(len(votes), np.int64)
        t = np.zeros((2, 3 if p >= 0 else 1, 3))
        for y, w in ((0, weight * (1 - toxic)), (1, weight * toxic)):
            np.add.at(t[y], (above, votes[:, k]), w)
        base = t.sum(axis=1, keepdims=True) + 0.01
        t = t + 2.0 * base / base.sum(axis=2, keepdims=True)  # rare parents fall back on the label
        out.append(t / t.sum(axis=2, keepdims=True))
    return out


def _shares(votes, weight) -> np.ndarray:
    """One over the number of voters that nearly repeat each voter: their mutual information is
    nearly the voter's whole entropy."""
    shared = _dependence(votes, weight, np.zeros(len(votes)), own=True)
    entropy = np.maximum(np.diag(shared), 0)  # rounding may leave less than none
    most = np.sqrt(np.outer(entropy, entropy))
    return 1.0 / np.maximum(1, (shared >= 0.9 * np.maximum(most, 1e-9)).sum(axis=1))


def _dependence(votes, weight, toxic, own: bool = False) -> np.ndarray:
    """Mutual information of every two voters given the label (``own``: entropies on the diagonal)."""
    k = votes.shape[1]
    out = np.zeros((k, k))
    for y_weight in (weight * (1 - toxic), weight * toxic):
        total = y_weight.sum()
        if total <= 0:
            continue
        for i in range(k):
            for j in range(i + own):
                joint = np.zeros((3, 3))
                np.add.at(joint, (votes[:, i], votes[:, j]), y_weight / total)
                apart = joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True)
                seen = joint > 0
                out[i, j] += total / weight.sum() * (joint[seen] * np.log(joint[seen] / apart[seen])).sum()
    return np.maximum(out, out.T)


def _tree(dependence: np.ndarray, least: float = 1e-3) -> list[int]:
    """Parents along a maximum spanning forest of the dependent pairs."""
    k = len(dependence)
    parent = [-1] * k
    done: set[int] = set()
    while len(done) < k:
        best = max(((dependence[i, j], -i, j) for i in range(k) if i not in done for j in done),
                   default=(0.0, 0, 0))
        if best[0] >= least:
            parent[-best[1]] = best[2]
            done.add(-best[1])
        else:
            done.add(min(set(range(k)) - done))
    return parent


def fit_label_model(votes: np.ndarray, weight: np.ndarray, rounds: int = 50) -> LabelModel:
    """Fit to vote patterns (rows of votes) and how many documents show each."""
    k = votes.shape[1]
    model = LabelModel(parent=[-1] * k)
    if not len(votes):
        model.table = [np.full((2, 1, 3), 1 / 3) for _ in range(k)]
        model.accuracy = [0.5] * k
        return model
    model.share = _shares(votes, weight)
    said = ((votes == 1) - 1.0 * (votes == 0)) @ model.share
    toxic = 1 / (1 + np.exp(-2.0 * (said - 0.5)))
    for stage in range(2):
        for _ in range(rounds):
            model.prior = float(np.clip((weight * toxic).sum() / weight.sum(), 1e-4, 0.5))
            model.table = _tables(votes, weight, toxic, model.parent)
            toxic = model.posterior(votes)
        if stage == 0:
            model.share, model.dependence = None, _dependence(votes, weight, toxic)
            model.parent = _tree(model.dependence)
    right = np.where(votes == 1, toxic[:, None], 1 - toxic[:, None]) * (votes < 2) * weight[:, None]
    model.accuracy = (right.sum(axis=0) / np.maximum(1e-9, ((votes < 2) * weight[:, None]).sum(axis=0))).tolist()
    return model


def as_votes(patterns: list[str]) -> np.ndarray:
    code = {"0": 0, "1": 1, "-": 2}
    return np.array([[code[c] for c in p] for p in patterns], np.int64).reshape(-1, len(VOTERS))


# ---------------------------------------------------------------- linear classifier

def fit_linear(rows: list[tuple[list[int], list[int], list[float]]], target: np.ndarray,
               n_terms: int, rounds: int = 300, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft targets (Adam): weights of the terms, the measures, the bias."""
    size = n_terms + len(MEASURES) + 1
    if not rows:
        w = np.zeros(size)
        w[-1] = -3.0
        return w
    row, col, val = design(rows, n_terms)
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    w[-1] = np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    for t in range(1, rounds + 1):
        z = np.bincount(row, val * w[col], len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / len(rows)
        g = np.bincount(col, val * error[row], size) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
    return w


def design(rows, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse matrix (row, column, value) of features: log counts of terms, measures, one."""
    k = len(MEASURES) + 1
    sizes = np.array([len(r[0]) for r in rows], np.int64)
    row = np.concatenate([np.repeat(np.arange(len(rows)), sizes), np.repeat(np.arange(len(rows)), k)])
    col = np.concatenate([np.fromiter((i for r in rows for i in r[0]), np.int64, int(sizes.sum())),
                          np.tile(np.arange(k) + n_terms, len(rows))])
    dense = np.array([[*r[2], 1.0] for r in rows]).reshape(-1)
    val = np.concatenate([np.log1p(np.fromiter((c for r in rows for c in r[1]), float, int(sizes.sum()))), dense])
    return row, col, val


def predict(rows, weights: np.ndarray, n_terms: int) -> np.ndarray:
    row, col, val = design(rows, n_terms)
    return 1 / (1 + np.exp(-np.clip(np.bincount(row, val * weights[col], len(rows)), -50, 50)))


# ---------------------------------------------------------------- on Spark

def labelled_once(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, toxic) of every labelled training row; of near copies, rows whose smallest hash of
    three words is equal, the one with the smallest id stays.  No text is shuffled."""
    ship_package(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                sign = []
                for t in utf8(part, "text"):
                    h = window_hashes(word_hashes(t)[0], 3)
                    sign.append(int(h.min().view(np.int64)) if len(h) else len(t))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sign, pa.int64())],
                                                 ["doc_id", "signature"])

    signed = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id"))).mapInArrow(
        run, "doc_id long, signature long")
    first = signed.join(usable, "doc_id").groupBy("signature").agg(
        F.min("doc_id").alias("doc_id"), F.min_by("toxic", "doc_id").alias("toxic"))
    return scratch.write(first.select("doc_id", "toxic"))


def labelled_sample(docs: DataFrame, once: DataFrame, scratch: Scratch, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of about ``train_rows`` of the labelled rows at most, by a hash of the id."""
    share = min(1.0, train_rows / max(1, once.count()))
    picked = once.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return scratch.write(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))  # train_rows rows, about


def maybe_in(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id may be in ``ids``: their hashes meet in a bitmap of FILTER_BITS bits, whose
    parts of 4 KB go to all tasks, so that a join on the id need not shuffle the other rows' texts."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    part, bit = F.shiftright(slot, 15), slot.bitwiseAND(F.lit((1 << 15) - 1))
    bits = ids.groupBy(part.alias("_part")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    near = docs.withColumns({"_part": part, "_bit": bit}).join(F.broadcast(bits), "_part")
    return near.filter((byte / F.pow(F.lit(2), F.col("_bit") % 8)).cast("int") % 2 == 1).select(*docs.columns)


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, a, b, words) of rows of text and label: toxic and clean documents that hold the term and
    its words in the toxic ones (three of a document at most), summed per task before the shuffle."""
    def run(batches):
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for part in text_slices(batch, "text"):
                for t, y in zip(utf8(part, "text"), part.column("toxic").to_pylist()):
                    for term, words in terms_of(t.decode()).items():
                        c = counts.setdefault(term, [0, 0, 0])
                        c[1 - y] += 1
                        c[2] += min(words, 3) * y
                    if len(counts) > 100_000:
                        yield flush(counts)
                        counts = {}
        yield flush(counts)

    def flush(counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()),
             *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(3))],
            ["term", "a", "b", "words"])

    ship_package(rows.sparkSession)
    return (rows.select("text", "toxic").mapInArrow(run, "term string, a long, b long, words long")
            .groupBy("term").agg(*(F.sum(c).alias(c) for c in ("a", "b", "words"))))


def documents_with(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, terms): the numbers of those of ``terms`` that begin a word, for documents with any."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        number = {t: i for i, t in enumerate(sent.value)}
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, found = [], []
                for i, t in zip(part.column("doc_id").to_pylist(), utf8(part, "text")):
                    got: set[int] = set()
                    for w in set(_WORD.findall(t.decode().lower())):
                        begins = known.get(w)
                        if begins is None:
                            begins = known[w] = tuple(number[w[:n]] for n in range(SHORTEST, min(len(w), LONGEST) + 1)
                                                      if w[:n] in number)
                        got.update(begins)
                    if got:
                        ids.append(i)
                        found.append(list(got))
                    if len(known) > 50_000:
                        known.clear()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int32()))],
                                                 ["doc_id", "terms"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, terms array<int>")


def mine_terms(docs: DataFrame, once: DataFrame, sample: DataFrame, scratch: Scratch,
               sent_terms: int = SENT_TERMS) -> list[str]:
    """The lexicon, from counts over all labelled rows ``once``.

    Beginnings of words are counted in all toxic documents.  Clean documents of the sample already
    rule out the common ones: further documents only lower a term's lift.  What is left is rare, so
    all other clean documents are read for it alone; where it is more than ``sent_terms``, their
    beginnings are all counted and joined."""
    size = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    if not n_toxic:
        return []
    ratio = max(1, n_clean) / n_toxic

    def close(b):  # terms further from the lift cannot be chosen nor lengthen a chosen one
        return F.col("a") * ratio >= (b + 0.5) * LIFT / 2

    text = docs.select("doc_id", "text")
    bad = once.filter("toxic = 1")
    rows = maybe_in(text, bad).join(bad, "doc_id").select("text", "toxic").unionAll(
        sample.filter("toxic = 0").select("text", "toxic"))
    rare = scratch.write(term_counts(rows).filter((F.col("a") >= SUPPORT) & close(F.col("b"))).drop("b"))
    clean = once.filter("toxic = 0")
    if rare.count() <= sent_terms:
        rows = sorted(tuple(r) for r in rare.collect())
        held = documents_with(docs.filter(~held_out(F.col("doc_id"))), [r[0] for r in rows]).join(clean, "doc_id")
        b = {r["term"]: r["n"] for r in held.select(F.explode("terms").alias("term")).groupBy("term").agg(
            F.count(F.lit(1)).alias("n")).collect()}
        counts = {t: (a, b.get(i, 0), words) for i, (t, a, words) in enumerate(rows)}
    else:
        every = term_counts(text.join(clean, "doc_id")).select("term", "b")
        left = rare.join(every, "term", "left").withColumn("b", F.coalesce("b", F.lit(0))).filter(close(F.col("b")))
        counts = {r["term"]: (r["a"], r["b"], r["words"]) for r in left.collect()}
    return choose_terms({t: c for t, c in counts.items() if c[0] * ratio >= (c[1] + 0.5) * LIFT / 2}, n_toxic, n_clean)


FEATURES_SCHEMA = "doc_id long, votes string, terms array<int>, counts array<int>, measures array<double>"


def read_features(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Votes and features of every row's whole text."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        reader = Reader(sent.value)
        for batch in batches:
            for part in text_slices(batch, "text"):
                got = [reader.read(t) for t in utf8(part, "text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([g[0] for g in got], pa.string()),
                     pa.array([g[1] for g in got], pa.list_(pa.int32())),
                     pa.array([g[2] for g in got], pa.list_(pa.int32())),
                     pa.array([g[3] for g in got], pa.list_(pa.float64()))],
                    ["doc_id", "votes", "terms", "counts", "measures"])

    return docs.select("doc_id", "text").mapInArrow(run, FEATURES_SCHEMA)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", train_rows: int = TRAIN_ROWS,
                   scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted``.

    A null text counts as empty and gets the score of a text without terms; a null id is held
    out and never a training row; repeated rows get equal results; a document with several labels
    counts as toxic if one says so; without usable labels only seed and patterns vote.  Other
    columns are ignored whatever their names.  Runs Spark jobs and writes to the checkpoint folder; a
    ``scratch`` of the caller's lets it delete those tables once the result is stored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = scratch or Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    once = labelled_once(docs, labels, scratch)
    sample = labelled_sample(docs, once, scratch, train_rows)
    terms = mine_terms(docs, once, sample, scratch)
    rows = scratch.write(read_features(docs, terms))
    # every document votes; patterns are few (two or three answers of a dozen voters)
    patterns = rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    model = fit_label_model(as_votes([r["votes"] for r in patterns]),
                            np.array([r["n"] for r in patterns], float))
    train = sorted(tuple(r)[1:] for r in read_features(sample, terms).collect())
    target = model.posterior(as_votes([r[0] for r in train])) if train else np.empty(0)
    weights = fit_linear([(r[1], r[2], r[3]) for r in train], target, len(terms))
    sent, n_terms = spark.sparkContext.broadcast(weights), len(terms)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                got = predict(list(zip(*(batch.column(c).to_pylist() for c in ("terms", "counts", "measures")))),
                              sent.value, n_terms)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got)], ["doc_id", "score"])

    scored = rows.select("doc_id", "terms", "counts", "measures").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
