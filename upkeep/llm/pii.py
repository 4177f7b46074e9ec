"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans.  A conditional random field then labels every token that holds a
digit or an at sign (a site) of the document as one of the kinds or as nothing: unary potentials
over the token's shape and neighbours, chain potentials between adjacent sites, and skip
potentials among distant sites that are repeated or similar (equal letters and digits, equal
trailing digits, or an equal local part).  Loopy message passing makes labels of such sites
agree across the document; sites under base spans are clamped to their kind.  Sites that come
out as personal data with high probability give additional spans.

The similar sites of a group hang on one shared label node, so a group of m sites costs m edges,
not m squared.  Unary and pair weights are fitted to the base spans of a bounded sample.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.llm.common import documents, ship_package, text_slices, utf8

KINDS = ("email", "ip", "card", "phone")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_ANY = re.compile(r"[0-9@]")

#: Documents that the weights are fitted to, at most about; hashed features; message rounds.
TRAIN_DOCS, FEATURES, ROUNDS = 20_000, 4096, 12
#: Least posterior of a kind for an additional span.
CONFIDENT = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        if m:
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base findings by start, then kind; offsets in code points."""
    found = []
    if not _ANY.search(text):
        return found
    if "@" in text:
        found += [(a, b, "email") for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], _ORDER[s[2]]))


@dataclass
class Sites:
    """The sites of one text: spans, hashed features, clamped labels (0: none, -1: free), whether
    each adjoins the next one, and the group number of each similarity key."""
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    label: np.ndarray
    adjoins: np.ndarray
    member: np.ndarray
    group: np.ndarray


def _shape(token: str) -> str:
    s = re.sub(r"[A-Za-z]+", "a", re.sub(r"[^\x00-\x7f]+", "u", token))
    return re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 20)}", s)[:40]


def _keys(token: str) -> list[str]:
    """What makes two distant sites similar."""
    digits = re.sub(r"[^0-9]", "", token)
    core = token.strip(".,;:!?\"'()[]{}<>").lower()
    keys = [f"w{core}"] if core else []
    if len(digits) >= 7:
        keys.append(f"d{digits[-7:]}")
    if "@" in core:
        local = core.split("@")[0]
        if len(local) >= 5:
            keys.append(f"w{local}")
    return keys


def sites(text: str, base: list[tuple[int, int, str]]) -> Sites:
    spans = [m.span() for m in _TOKEN.finditer(text) if _ANY.search(m[0])]
    tokens = [text[a:b] for a, b in spans]
    shapes = ["^", *map(_shape, tokens), "$"]
    start = np.array([a for a, _ in spans], np.int64)
    end = np.array([b for _, b in spans], np.int64)
    gaps = [text[b:a].isspace() and a - b <= 2 for (_, b), (a, _) in zip(spans, spans[1:])]
    adjoins = np.array([*gaps, False], bool)[:len(spans)]
    label = np.full(len(spans), -1, np.int64)
    for a, b, kind in base:  # all sites that a base span touches
        lo, hi = np.searchsorted(end, a, "right"), np.searchsorted(start, b, "left")
        label[lo:hi] = 1 + _ORDER[kind]
    rows = []
    for i, t in enumerate(tokens):
        digits = re.sub(r"[^0-9]", "", t)
        left = shapes[i] if i and adjoins[i - 1] else "-"
        right = shapes[i + 2] if adjoins[i] and i + 1 < len(tokens) else "-"
        parts = [p for p in t.strip(".,").split(".")]
        octets = len(parts) == 4 and all(p.isdecimal() and p.isascii() and len(p) < 4 and int(p) < 256
                                         for p in parts)
        rows.append([zlib.crc32(f.encode()) % FEATURES for f in (
            "bias", f"s{shapes[i + 1]}", f"l{left}", f"r{right}", f"n{min(len(digits), 20)}",
            f"c{len(digits) >= 14 and luhn(digits)}{octets}", f"@{'@' in t}{t[:1]}",
            f"h{t[:1]}{t[-1:]}")])
    number: dict[str, int] = {}
    member, group = [], []
    for i, t in enumerate(tokens):
        for k in _keys(t):
            member.append(i)
            group.append(number.setdefault(k, len(number)))
    return Sites(start, end, np.array(rows, np.int64).reshape(-1, 8), label, adjoins,
                 np.array(member, np.int64), np.array(group, np.int64))


@dataclass
class Field:
    """Weights: unary (FEATURES x labels), chain and skip log potentials (labels x labels)."""
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, s: Sites) -> np.ndarray:
        """Loopy sum-product in log space; (sites, labels) posteriors."""
        n, k = len(s.start), len(KINDS) + 1
        own = self.unary[s.features].sum(axis=1)
        fixed = s.label >= 0
        own[fixed] = -30.0
        own[fixed, s.label[fixed]] = 30.0
        links = np.flatnonzero(s.adjoins)
        groups = int(s.group.max()) + 1 if len(s.group) else 0
        size = np.bincount(s.group, minlength=groups)
        keep = size[s.group] > 1 if groups else np.empty(0, bool)
        member, group = s.member[keep], s.group[keep]
        right, left = np.zeros((len(links), k)), np.zeros((len(links), k))  # along and against the text
        up, down = np.zeros((len(member), k)), np.zeros((len(member), k))  # to and from shared nodes

        def through(message, potential):
            out = np.logaddexp.reduce(message[:, :, None] + potential[None], axis=1)
            return out - out.max(axis=1, keepdims=True)

        belief = own
        for _ in range(ROUNDS):
            belief = own.copy()
            np.add.at(belief, links + 1, right)
            np.add.at(belief, links, left)
            np.add.at(belief, member, down)
            new_right = through(belief[links] - left, self.chain)
            new_left = through(belief[links + 1] - right, self.chain.T)
            new_up = through(belief[member] - down, self.skip)
            shared = np.zeros((groups, k))
            np.add.at(shared, group, new_up)
            new_down = through(shared[group] - new_up, self.skip.T)
            change = max((np.abs(a - b).max(initial=0) for a, b in (
                (right, new_right), (left, new_left), (down, new_down))), default=0)
            right, left, up, down = ((a + b) / 2 for a, b in (
                (right, new_right), (left, new_left), (up, new_up), (down, new_down)))
            if change < 1e-3:
                break
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True) if n else p


def _adjacency(pairs: np.ndarray) -> np.ndarray:
    """Chain log potentials from counts of (left, right) labels: how much oftener than by chance;
    pairs that chance would not show either stay near 0."""
    total = max(1.0, pairs.sum())
    chance = np.outer(pairs.sum(axis=1), pairs.sum(axis=0)) / total
    return np.clip(np.log((pairs + 1) / (chance + 1)), -3.0, 3.0)


def _agreement(pairs: np.ndarray) -> np.ndarray:
    """Skip log potentials from counts of label pairs of similar sites: how often a label meets
    itself (half the time if never seen), the rest shared by the other labels."""
    both = pairs + pairs.T
    same = (np.diag(both) + 1) / (both.sum(axis=1) + 2)
    k = len(same)
    out = np.log(np.repeat((1 - same)[:, None], k, axis=1) / (k - 1))
    out[np.arange(k), np.arange(k)] = np.log(same)
    return np.clip((out + out.T) / 2, -5.0, 0.0)


def fit(rows: list[Sites], rounds: int = 400, rate: float = 2.0, decay: float = 1e-4) -> Field:
    """Fit the weights to documents whose labels are their base spans (free sites: nothing)."""
    k = len(KINDS) + 1
    label = np.concatenate([np.maximum(s.label, 0) for s in rows]) if rows else np.empty(0, np.int64)
    features = np.concatenate([s.features for s in rows]) if rows else np.empty((0, 8), np.int64)
    unary = np.zeros((FEATURES, k))
    chain, skip = np.zeros((k, k)), np.zeros((k, k))
    for s in rows:
        y = np.maximum(s.label, 0)
        at = np.flatnonzero(s.adjoins)
        np.add.at(chain, (y[at], y[at + 1]), 1)
        if len(s.group):
            order = np.argsort(s.group, kind="stable")
            g, m = s.group[order], s.member[order]
            same = g[1:] == g[:-1]
            np.add.at(skip, (y[m[:-1][same]], y[m[1:][same]]), 1)
    if len(label):
        # equal rows are merged, so that frequent shapes cost nothing more
        packed, back = np.unique(np.column_stack([features, label]), axis=0, return_counts=True)
        features, label, weight = packed[:, :-1], packed[:, -1], back / back.sum()
        for _ in range(rounds):
            z = unary[features].sum(axis=1)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(label)), label] -= 1
            step = np.zeros_like(unary)
            np.add.at(step, features.ravel(), np.repeat(p * weight[:, None], 8, axis=0))
            unary -= rate * (step + decay * unary)
    return Field(unary, _adjacency(chain), _agreement(skip))


def _complete(token: str) -> bool:
    """Whether a token is a whole address or number rather than a part of one."""
    return "@" in token or token.count(".") == 3 or sum("0" <= c <= "9" for c in token) >= 10


def extra_spans(text: str, base: list[tuple[int, int, str]], field: Field,
                confident: float = CONFIDENT) -> list[tuple[int, int, str]]:
    """Spans of free sites that the field labels as personal data; adjoining parts of one
    number make one span; marks around a token are left out."""
    if not _ANY.search(text):
        return []
    s = sites(text, base)
    if not len(s.start):
        return []
    p = field.marginals(s)
    kind = p.argmax(axis=1)
    take = (s.label < 0) & (kind > 0) & (p.max(axis=1) >= confident)
    out = []
    for i in np.flatnonzero(take).tolist():
        a, b = int(s.start[i]), int(s.end[i])
        while a < b and text[a] in ".,;:!?\"'([{<":
            a += 1
        while b > a and text[b - 1] in ".,;:!?\"')]}>":
            b -= 1
        name = KINDS[kind[i] - 1]
        if a < b:
            joins = out and out[-1][2] == name and i and s.adjoins[i - 1] and take[i - 1]
            if joins and not (_complete(text[a:b]) or _complete(text[out[-1][0]:out[-1][1]])):
                out[-1] = out[-1][0], b, name
            else:
                out.append((a, b, name))
    return out


def train_field(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                train_docs: int = TRAIN_DOCS) -> Field:
    """Weights from about ``train_docs`` documents at most, chosen by a hash of id and text."""
    total = docs.count()
    share = min(1.0, train_docs / max(1, total))
    picked = docs.select(F.col(text_col).alias("text")).filter(
        F.pmod(F.xxhash64(F.col(id_col).cast("string"), text_col), F.lit(1 << 20)) < int(share * (1 << 20)))
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                got = []
                for t in utf8(part, "text"):
                    text = t.decode()
                    if _ANY.search(text):
                        s = sites(text, base_spans(text))
                        got.append((s.features.ravel(), s.label, s.adjoins, s.member, s.group))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([np.asarray(g[i], np.int64) for g in got], pa.list_(pa.int64()))
                     for i in range(5)], ["features", "label", "adjoins", "member", "grp"])

    rows = picked.mapInArrow(run, ", ".join(f"{c} array<long>" for c in (
        "features", "label", "adjoins", "member", "grp"))).collect()
    none = np.empty(0, np.int64)
    return fit([Sites(none, none, np.array(r[0], np.int64).reshape(-1, 8), np.array(r[1], np.int64),
                      np.array(r[2], bool), np.array(r[3], np.int64), np.array(r[4], np.int64))
                for r in sorted(rows)])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       field: Field | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``base`` and ``extra``, arrays of (start, end, kind).

    A null text counts as empty and gives no spans; repeated rows get equal results; base spans
    of several kinds may overlap; extra spans never touch a site under a base span; other
    columns are ignored whatever their names.  A field that is not given is fitted first, which
    runs two jobs.  No shuffle; a task holds one slice of an Arrow batch.
    """
    ship_package(docs.sparkSession)
    field = field or train_field(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(field)
    keep = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def as_rows(found):
        return [{"start": a, "end": b, "kind": k} for a, b, k in found]

    def run(batches):
        weights = sent.value
        for batch in batches:
            for part in text_slices(batch, "text"):
                base, extra = [], []
                for t in utf8(part, "text"):
                    text = t.decode()
                    found = base_spans(text)
                    base.append(as_rows(found))
                    extra.append(as_rows(extra_spans(text, found, weights)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(base, span), pa.array(extra, span)],
                    ["doc_id", "base", "extra"])

    kind = "array<struct<start:bigint,end:bigint,kind:string>>"
    return keep.mapInArrow(run, f"doc_id long, base {kind}, extra {kind}")


def written(spans) -> Column:
    """``kind:start:end`` of the spans by start, then kind as listed, joined by commas."""
    order = F.array(*[F.lit(k) for k in KINDS])
    rows = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(order, s["kind"]).alias("ord"),
        s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(documents(spark, sf_dir))
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                        written(F.concat("base", "extra")).alias("spans"))
