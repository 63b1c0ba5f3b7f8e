"""Personal data: exact base patterns, and a linear-chain CRF over word shapes.

The base finds e-mail addresses, IPv4 addresses, card numbers (Luhn) and
international phone numbers.  The CRF adds names, street addresses, secrets,
identity numbers and other contacts: a word's score for a label comes from its
own features (shape, length, cue words, affixes) and those of its neighbours;
labels of neighbouring words are linked by transition weights.  It is trained
on a small labelled table (``pii_training``, or any table of words and labels)
by gradient ascent on the log-likelihood, and decoded by Viterbi for many
lines at a time.  An address span holds a digit.  A CRF span that touches a base span is left out.

Defined cases: a null text is empty and has no spans; a null doc_id is
carried; repeated rows are reported each; lines of any length are decoded
whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import load, text_or_empty, trimmed
from tramline.llm.pii_training import KINDS, labelled_sentences

BASE = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate((*BASE, *KINDS[1:]))}
LOCAL = frozenset(map(ord, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"))
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match that begins within a run of digits would also begin with the run, so only those are tried.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")
MORE = ("name", "address", "secret", "id", "contact")
SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_sure long, " + ", ".join(f"n_{k} long" for k in MORE)
TEXTS = 256
#: Longer words are not kept as themselves.
LONG = 64
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches of local@domain; each '@' is looked at once, so long runs cost no more than their length."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and ord(text[start - 1]) in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            free = m.end()
        else:
            free = max(free, at)
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind."""
    out = emails(text) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# --- the CRF -----------------------------------------------------------------

CUES = frozenset("mr mrs ms dr prof herr frau madame señor name is my at by signed contact lives address street road avenue lane drive way token key api_key password secret ssn iban passport call phone tel [at] (at) [dot] com".split())
RUN = re.compile(r"(.)\1+")
EDGE = "\"'.,;:!?"
#: Letters up to U+024F and digits to their class; a word and its translation have the same features unless it is a cue.
CLASSES = str.maketrans({**{c: "x" if c.islower() else "X" for c in map(chr, range(65, 0x250)) if c.islower() or c.isupper()}, **dict.fromkeys("0123456789", "d")})


def word_features(word: str) -> list[str]:
    """Shape, with and without repeats, length class, cue word and closing punctuation."""
    bare = word.strip(EDGE)
    shape = bare.translate(CLASSES)
    shape = "".join("x" if c.islower() else "X" if c.isupper() else c for c in shape) if not shape.isascii() else shape
    out = [f"s={RUN.sub(lambda m: m[1], shape)}", f"l={min(len(bare), 12) if len(bare) < 30 else 30}", f"e={word[-1:] if word[-1:] in EDGE else ''}"]
    if len(shape) <= 12:
        out.append(f"S={shape}")
    if (low := bare.lower()) in CUES:
        out.append(f"w={low}")
    kinds = {("d" if c == "d" else "X" if c == "X" else "x" if c == "x" else ".") for c in shape}
    out.append(f"k={''.join(sorted(kinds))}")
    if len(bare) >= 14 and kinds >= {"d", "x"} and "." not in kinds:
        out.append("key")
    if len(bare) >= 16 and kinds == {"d", "X"}:
        out.append("upper key")
    return out


class Crf:
    """Weights and, per worker, the scores of words seen."""

    def __init__(self, features: dict[str, int], weights: np.ndarray, links: np.ndarray, begin: np.ndarray):
        self.features, self.weights, self.links, self.begin = features, weights, links, begin
        self.seen: dict[str, int] = {}
        self.by_class: dict[str, int] = {}
        self.table = np.zeros((1 << 12, 3, len(KINDS)), np.float32)

    def __getstate__(self):
        return self.features, self.weights, self.links, self.begin

    def __setstate__(self, state):
        self.__init__(*state)

    def rows(self, words: list[str]) -> np.ndarray:
        """Row of each word in the score table: as itself, as the one before, as the one after."""
        got = list(map(self.seen.get, words))
        if None in got:
            if len(self.seen) > 200_000:
                self.seen.clear()
                got = [None] * len(words)
            for i, g in enumerate(got):
                if g is None:
                    got[i] = self.seen.get(words[i])
                    if got[i] is None:
                        got[i] = self._row(words[i])
                        if len(words[i]) <= LONG:
                            self.seen[words[i]] = got[i]
        return np.array(got, np.int64)

    def _row(self, word: str) -> int:
        """Row of a new word; words of one class share it."""
        name = word if word.strip(EDGE).lower() in CUES else word.translate(CLASSES)
        if len(name) > LONG:  # what is kept of a long word is bounded
            name = f"{xxhash.xxh3_128_hexdigest(name)} {len(name)}"
        row = self.by_class.get(name)
        if row is None:
            if len(self.by_class) >= 1 << 17:
                self.by_class.clear()
                self.seen.clear()
            row = self.by_class[name] = len(self.by_class)
            if row >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            at = [self.features[f] for f in word_features(word) if f in self.features]
            self.table[row] = self.weights[:, at].sum(1)
        return row

    def emissions(self, lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores [words of all lines, labels] and the lines' lengths."""
        sizes = np.array([len(x) for x in lines])
        rows = self.rows([w for x in lines for w in x])
        t = self.table
        score = t[rows, 0]
        first = np.zeros(len(rows), bool)
        first[np.cumsum(sizes) - sizes] = True
        inner = np.flatnonzero(~first)
        score[inner] += t[rows[inner - 1], 1]
        score[inner - 1] += t[rows[inner], 2]
        return score, sizes

    def decode(self, lines: list[list[str]]) -> np.ndarray:
        """Best labels of the words of all lines (none empty), by Viterbi; lines of like length advance in step.

        A path that leaves label 0 for some words gains at most, for each of
        them, its score over label 0 and two links over the link from 0 to 0.
        Where that is negative for every word of a line the all-0 path is the
        best one and the line needs no search.
        """
        if not lines:
            return np.zeros(0, np.int8)
        score, sizes = self.emissions(lines)
        gain = 2 * max(0.0, float((self.links - self.links[0, 0]).max())) + max(0.0, float((self.begin - self.begin[0]).max()))
        open_ = (score[:, 1:].max(1) - score[:, 0] + gain >= 0).astype(np.int64)
        chosen = np.flatnonzero(np.add.reduceat(open_, np.cumsum(sizes) - sizes))
        everywhere = np.zeros(len(score), np.int8)
        if len(chosen):
            at = np.concatenate([np.arange(s, s + n) for s, n in zip((np.cumsum(sizes) - sizes)[chosen].tolist(), sizes[chosen].tolist(), strict=True)])
            everywhere[at] = self._viterbi(score[at], sizes[chosen])
        return everywhere

    def _viterbi(self, score: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        starts, out, k = np.cumsum(sizes) - sizes, np.zeros(len(score), np.int8), len(KINDS)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")  # lines that reach each step
        best = score[starts] + self.begin
        back = [np.zeros((0, k), np.int8)]
        final = np.zeros((len(sizes), k), np.float32)
        links = np.ascontiguousarray(self.links.T)  # [to, from]
        for t in range(1, int(sizes[0])):
            n = live[t]
            final[n : len(best)] = best[n:]
            total = best[:n, None, :] + links
            arg = total.argmax(2)
            best = np.take_along_axis(total, arg[:, :, None], 2)[:, :, 0] + score[starts[:n] + t]
            back.append(arg.astype(np.int8))
        final[: len(best)] = best
        label = final.argmax(1)
        for t in range(int(sizes[0]) - 1, -1, -1):
            n = live[t]
            out[starts[:n] + t] = label[:n]
            if t:
                label[:n] = back[t][np.arange(n), label[:n]]
        return out


def train_crf(rows: list[tuple[list[str], list[str]]], steps: int = 200, rate: float = 0.3, ridge: float = 0.002) -> Crf:
    """Fit on a small table of (words, labels) by Adam on the regularised log-likelihood."""
    k = len(KINDS)
    words = sorted({w for line, _ in rows for w in line})
    found = [word_features(w) for w in words]
    features = {f: i for i, f in enumerate(sorted({f for w in found for f in w}))}
    x = np.zeros((len(words) + 1, len(features)))  # the last row is no word
    for i, w in enumerate(found):
        x[i, [features[f] for f in w]] = 1
    number = {w: i for i, w in enumerate(words)}
    n, t = len(rows), max(len(w) for w, _ in rows)
    at, y, mask = np.full((n, t), len(words)), np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (line, labels) in enumerate(rows):
        at[i, : len(line)], mask[i, : len(line)] = [number[w] for w in line], True
        y[i, : len(line)] = [KINDS.index(label) for label in labels]
    before, after = np.full_like(at, len(words)), np.full_like(at, len(words))
    before[:, 1:], after[:, :-1] = at[:, :-1], at[:, 1:]
    places = [p.ravel() for p in (at, before, after)]
    params = [np.zeros((3, len(features), k)), np.zeros((k, k)), np.zeros(k)]
    moment = [np.zeros_like(p) for p in params]
    square = [np.zeros_like(p) for p in params]
    one = np.eye(k)
    gold, pair = one[y] * mask[..., None], mask[:, 1:] & mask[:, :-1]
    gold_links = np.einsum("ntj,ntk->jk", gold[:, :-1] * pair[..., None], gold[:, 1:])
    lse = lambda v, axis: np.log(np.exp(v - v.max(axis, keepdims=True)).sum(axis)) + v.max(axis)
    for step in range(1, steps + 1):
        w, links, begin = params
        e = sum((x @ w[c])[places[c]] for c in range(3)).reshape(n, t, k)
        alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
        alpha[:, 0] = e[:, 0] + begin
        for j in range(1, t):
            alpha[:, j] = np.where(mask[:, j, None], lse(alpha[:, j - 1, :, None] + links, 1) + e[:, j], alpha[:, j - 1])
        for j in range(t - 2, -1, -1):
            beta[:, j] = np.where(mask[:, j + 1, None], lse(links + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2), 0)
        z = lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        joint = np.exp(alpha[:, :-1, :, None] + links + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair[..., None, None]
        off = (gold - p).reshape(n * t, k)
        gathered = [np.stack([np.bincount(p, off[:, j], len(words) + 1) for j in range(k)], 1) for p in places]
        grads = [np.stack([x.T @ g for g in gathered]) / n - ridge * w / 10, (gold_links - joint.sum((0, 1))) / n - ridge * links / 10, (gold[:, 0] - p[:, 0]).sum(0) / n]
        for q, g, m, s in zip(params, grads, moment, square, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            q += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8) * 0.3
    w, links, begin = params
    return Crf(features, np.ascontiguousarray(w).astype(np.float32), links.astype(np.float32), begin.astype(np.float32))


WORD = re.compile(r"[^ \t\r\x0b\x0c]+")


def crf_spans(crf: Crf, texts: list[str]) -> list[list[Span]]:
    """CRF spans of each whole text; neighbouring words with one label make a span, outer punctuation left off."""
    lines, where = [], []
    for d, text in enumerate(texts):
        offset = 0
        for line in text.split("\n"):
            if words := line.split():
                lines.append(words)
                where.append((d, offset, line))
            offset += len(line) + 1
    labels = crf.decode(lines)
    out: list[list[Span]] = [[] for _ in texts]
    sizes = np.array([len(x) for x in lines], int)
    ends = np.cumsum(sizes)
    tagged = np.flatnonzero(labels)
    owner = np.searchsorted(ends, tagged, "right")
    at = 0
    while at < len(tagged):
        i = int(owner[at])
        words, base, (d, offset, line) = lines[i], int(ends[i] - sizes[i]), where[i]
        pos, places = 0, []
        for w in words:
            pos = line.index(w, pos)
            places.append(pos)
            pos += len(w)
        while at < len(tagged) and owner[at] == i:
            a = b = int(tagged[at]) - base
            kind = labels[base + a]
            while at + 1 < len(tagged) and owner[at + 1] == i and tagged[at + 1] == base + b + 1 and labels[base + b + 1] == kind and words[b][-1] not in ".,;:!?":
                at, b = at + 1, b + 1
            at += 1
            start, end = places[a], places[b] + len(words[b])
            lead = len(words[a]) - len(words[a].lstrip(EDGE))
            tail = len(words[b]) - len(words[b].rstrip(EDGE))
            if start + lead < end - tail and (KINDS[kind] != "address" or DIGIT.search(line[start:end])):
                out[d].append((offset + start + lead, offset + end - tail, KINDS[kind]))
    return out


def find_personal_data(docs: DataFrame, crf: Crf) -> DataFrame:
    """SPANS, a row for each document (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(crf)  # a few thousand weights
    names = [c.split()[0] for c in SPANS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                some, rows = batch.slice(a, TEXTS), []
                texts = some.column("text").to_pylist()
                for doc_id, text, more in zip(some.column("doc_id").to_pylist(), texts, crf_spans(model, texts), strict=True):
                    base = base_spans(text)
                    added = [s for s in more if all(s[1] <= b[0] or b[1] <= s[0] for b in base)] if base else more
                    counts = [sum(s[2] == k for s in base) for k in BASE]
                    both = sorted(base + added, key=lambda s: (s[0], ORDER[s[2]]))
                    tagged = [sum(s[2] == k for s in added) for k in MORE]
                    sure = len(both) - tagged[0]  # names without a list of names are the tagger's guess
                    rows.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(both), len(both), sure, *tagged))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * (2 + len(MORE))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(trimmed(run), SPANS)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: SPANS."""
    return find_personal_data(load(spark, sf_dir, "documents", "doc_id", "text"), train_crf(labelled_sentences()))
