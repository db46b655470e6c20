"""Secret scans: candidate strings, and a random forest that removes false positives.

A candidate is a run of key-like characters that mixes letters and digits. Its features are its length,
how its characters change from one to the next, how much of it dictionary words cover, the path around it
and the words beside it. The forest is trained from labelled findings: by default a seeded set of findings
made by rule (keys of many issuers, passwords and tokens against digests, ids, paths, versions, file names
and plain words); findings from a review can be passed in their place.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquery.llm.shared import documents, ready

TOKEN = re.compile(r"[A-Za-z0-9+/_.~-]{8,}={0,2}")
# Words that stand beside secrets, words that stand beside harmless strings, and issuers' prefixes.
KEYWORDS = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|bearer|credential|client[_-]?secret)", re.I)
HARMLESS = re.compile(r"(?:commit|sha\d*|md5|checksum|digest|hash|uuid|guid|etag|revision|version|build|serial|isbn|doi|order|invoice|ticket|sku|part|model|file|image|https?|www|mailto|path|dir|fig|id)\b", re.I)
PREFIX = re.compile(r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk[-_](?:live|test|proj)?|pk_live|rk_live|AIza|ya29|eyJ|SG\.|npm_|pypi-|dop_v1|hf_)")
LOOK = r"[0-9][A-Za-z+/_.~-]|[A-Za-z+/_.~-][0-9]|" + PREFIX.pattern.removeprefix("^")
ASSIGNED = re.compile(r"[=:]\s*[\"']?$|\s(?:is|bearer)\s+[\"']?$", re.I)
# The whole value after an assignment to a name that ends in a keyword: in quotes up to the closing one, else up to white space.
NAMED = rf"{KEYWORDS.pattern}[\"']?\s{{0,3}}[:=]\s{{0,3}}"
VALUE = re.compile(rf"{NAMED}(?:\"([^\"\n]{{8,}})\"|'([^'\n]{{8,}})'|([^\s\"'`<>]{{8,}}))", re.I)
DICTIONARY = frozenset(
    "the and for are but not you all any can had her was one our out day get has him his how man new now old see two way who boy did its let put say she too use about above access account action after again also another application archive article back base beta book build call case change check class client close code config connect content control core count create current data date default delete demo design detail device document down draft each east edit element email end error event example export feature field file final find first flag folder form format from full group guide handle header help home host html http icon image import index info input install item java json just keep key kind last level library light line link linux list load local lock login long main make manual map master member menu message mobile model module month more move music name need network next node none north note number object office open option order other output over package page paper part path phone photo picture plan play plugin point post power print product profile project public query read record release remove report request reset response result review right room root route rule sample save scan schema script search section select server service session set setting share show side sign simple site size small source south staff start state static step stop store string style summary support system table target task team temp test text theme then this time title tool top total trace track transfer tree type under unit update upload user value version video view week west when window with work world write year your".split()
)
FEATURES = 24
BEFORE, AFTER = 60, 24

Finding = tuple[str, int, int, int]  # text, start, end, label


def kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def covered(s: str) -> float:
    """The share of the string that dictionary words of three letters and more cover, the longest first."""
    s, at, n = s.lower(), 0, 0
    while at < len(s):
        for size in range(min(11, len(s) - at), 2, -1):
            if s[at : at + size] in DICTIONARY:
                n, at = n + size, at + size
                break
        else:
            at += 1
    return n / max(len(s), 1)


def describe(text: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    before, after = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    n = len(s)
    kinds = [kind(c) for c in s]
    counts = Counter(s)
    words = re.findall(r"[\w-]+", before)[-3:]
    letters = [c for c in s.lower() if c.isalpha()]
    vowels = sum(c in "aeiouy" for c in letters)
    runs = re.findall(r"[a-z]+|[A-Z]+|[0-9]+", s)
    vowel_change = sum((a in "aeiou") != (b in "aeiou") for a, b in zip(letters, letters[1:], strict=False))
    return [
        n,
        *(kinds.count(k) / n for k in range(4)),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        sum({a, b} == {1, 2} or {a, b} == {0, 2} for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        vowel_change / max(len(letters) - 1, 1),
        vowels / max(len(letters), 1),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        len(counts) / n,
        max(map(len, runs), default=0) / n,
        float(all(c in string.hexdigits for c in s)),
        float(all(c in string.hexdigits + "-" for c in s) and s.count("-") == 4),
        covered(s),
        s.count("/") + s.count("."),
        s.count("-") + s.count("_"),
        float(before[-1:] in ("/", "@", "#", "\\") or after[:1] in ("/", "@")),
        float(bool(re.search(r"\.[A-Za-z]{2,4}$", s)) or "://" in before[-30:]),
        float(any(KEYWORDS.search(w) for w in words)),
        float(any(HARMLESS.search(w) for w in words) or bool(HARMLESS.match(s))),
        float(bool(PREFIX.match(s))),
        float(bool(ASSIGNED.search(before))),
        float(before[-1:] in ("'", '"', "`")),
    ]


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key-like characters that have a letter and a digit or an issuer's prefix, without dots and dashes at their ends."""
    out = []
    for m in TOKEN.finditer(text):
        s, e = m.span()
        while s < e and text[s] in ".-~/":
            s += 1
        while s < e and text[e - 1] in ".-~/":
            e -= 1
        part = text[s:e]
        if e - s >= 8 and (PREFIX.match(part) or (any(c.isdigit() for c in part) and any(c.isalpha() for c in part))):
            out.append((s, e))
    return out


def values(text: str) -> list[tuple[int, int]]:
    """Whole values that are assigned to a keyword's name, without the punctuation that ends an unquoted one."""
    out = []
    for m in VALUE.finditer(text):
        s, e = m.span(m.lastindex)
        if m.lastindex == 3:
            e = s + len(m[3].rstrip(".,;:)]}"))
        if e - s >= 8:
            out.append((s, e))
    return out


def labelled_findings(n: int = 4000, seed: int = 20240229) -> list[Finding]:
    """Findings made by rule from a seed: half secrets (1), half strings that look like them (0)."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    alnum, hexa, upper = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + string.digits
    word = lambda: r.choice(sorted(DICTIONARY))
    syllables = "an be ci da en er fo ga ho in ja ki la me no on pa qu re st th ti un ver wh zu".split()
    invented = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    secrets = [
        lambda: r.choice(("AKIA", "ASIA")) + pick(string.ascii_uppercase + "234567", 16),
        lambda: "ghp_" + pick(alnum, 36),
        lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24),
        lambda: "sk-" + pick(alnum, r.choice((32, 48))),
        lambda: "AIza" + pick(alnum + "_-", 35),
        lambda: pick(alnum + "+/", 40),
        lambda: "eyJ" + pick(alnum, 20) + "." + pick(alnum, 40) + "." + pick(alnum, 30),
    ]
    values = [lambda: pick(hexa, r.choice((16, 18, 20, 24, 32, 40, 64))), lambda: pick(alnum, r.randint(10, 40)), lambda: pick(upper, r.randint(12, 24)), lambda: word() + pick(string.digits, 3) + pick(alnum, 6)]
    names = "password passwd pwd secret token api_key apikey access_key client_secret auth_token private-key bearer".split()
    harmless = [
        lambda: (r.choice(("commit ", "sha1 ", "revision ", "digest: ", "etag ")), pick(hexa, 40)),
        lambda: (r.choice(("md5 ", "checksum: ", "hash = ")), pick(hexa, 32)),
        lambda: (r.choice(("uuid ", "id=", "guid: ", "")), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))),
        lambda: (r.choice(("/usr/", "./", "path ")), "/".join((word(), word() + str(r.randint(1, 99)), word() + ".txt"))),
        lambda: ("https://www.", f"{word()}.com/{word()}/{r.randint(1000, 99999)}"),
        lambda: (r.choice(("version ", "build ", "")), f"{word()}-{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 99)}"),
        lambda: (r.choice(("order ", "invoice ", "part ", "model ", "")), pick(string.ascii_uppercase, 3) + "-" + pick(string.digits, r.randint(4, 8))),
        lambda: ("", f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}"),
        lambda: ("", f"{word()}{word()}{r.randint(1, 2000)}"),
        lambda: (r.choice(("image ", "file ", "")), f"{word()}_{word()}_{r.randint(1, 999)}.{r.choice(('png', 'jpg', 'csv', 'pdf'))}"),
        lambda: ("", f"{invented()}.{r.randint(1, 99)}"),
        lambda: ("", invented() + invented() + str(r.randint(1, 99))),
        lambda: ("", f"mail{r.randint(1, 9)}.{word()}.com"),
    ]
    out: list[Finding] = []
    while len(out) < n:
        left = " ".join(r.choice((word, invented))() for _ in range(r.randint(0, 6)))
        right = " ".join(r.choice((word, invented))() for _ in range(r.randint(0, 4)))
        label = len(out) % 2
        if label and r.random() < 0.5:
            lead, value = r.choice(("", "", "key ", "= ", '"')), r.choice(secrets)()
        elif label:
            name = r.choice(names)
            name = r.choice((name, name.upper(), name.title(), f"{word()}_{name}"))
            lead, value = name + r.choice(("=", " = ", ": ", '="', " = '", " is ")), r.choice(values + secrets)()
        else:
            lead, value = r.choice(harmless)()
        text = f"{left} {lead}"
        out.append((f"{text}{value} {right}", len(text), len(text) + len(value), label))
    return out


def assigned_findings(n: int = 600, seed: int = 20240301) -> list[Finding]:
    """Values beside a keyword, from a seed: half passphrases and values of mixed signs (1), half plain words (0)."""
    r = random.Random(seed)
    known = sorted(DICTIONARY)
    out: list[Finding] = []
    while len(out) < n:
        label = len(out) % 2
        name = r.choice("password passwd pwd secret token api_key client_secret auth".split())
        if label and r.random() < 0.5:
            value = "-".join(r.choice(known) for _ in range(r.randint(3, 4)))
        elif label:
            value = "".join(r.choice(string.ascii_letters + string.digits + "!@#$%&*") for _ in range(r.randint(8, 16)))
        else:
            value = r.choice(known) + r.choice(("", "", *known[:200])) + r.choice(("ing", "ed", "ation", "able", ""))
        if len(value) < 8:
            continue
        quote = r.choice(("", '"', "'")) if label else ""
        lead = f"{r.choice(known)} {name}{r.choice(('=', ' = ', ': ')) if label else ': '}{quote}"
        out.append((f"{lead}{value}{quote} {r.choice(known)}", len(lead), len(lead) + len(value), label))
    return out


class Forest:
    """Trees on bootstrap samples; each node takes the best cut (Gini) among a few random features and quantiles."""

    def __init__(self, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 7) -> None:
        self.trees, self.depth, self.least, self.rng = trees, depth, least, np.random.default_rng(seed)
        self.nodes: list[np.ndarray] = []  # rows: feature (-1: leaf), cut, left, right, share of label 1

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        for _ in range(self.trees if len(y) else 0):
            at = self.rng.integers(0, len(y), len(y))
            rows: list[list[float]] = []
            self.grow(x[at], y[at], 0, rows)
            self.nodes.append(np.array(rows))
        return self

    def grow(self, x: np.ndarray, y: np.ndarray, depth: int, rows: list) -> int:
        here = len(rows)
        rows.append([-1, 0, 0, 0, float(y.mean())])
        if depth == self.depth or len(y) < 2 * self.least or y.min() == y.max():
            return here
        best = (1e-9, -1, 0.0)
        whole = y.mean() * (1 - y.mean())
        for j in self.rng.choice(x.shape[1], int(math.sqrt(x.shape[1])) + 1, replace=False):
            values = np.unique(x[:, j])
            cuts = (values[1:] + values[:-1]) / 2
            if len(cuts) > 16:
                cuts = cuts[np.linspace(0, len(cuts) - 1, 16).astype(int)]
            for c in cuts:
                left = x[:, j] < c
                n = left.sum()
                if min(n, len(y) - n) < self.least:
                    continue
                p, q = y[left].mean(), y[~left].mean()
                gain = whole - (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) / len(y)
                if gain > best[0]:
                    best = (gain, int(j), float(c))
        if best[1] >= 0:
            left = x[:, best[1]] < best[2]
            a = self.grow(x[left], y[left], depth + 1, rows)
            b = self.grow(x[~left], y[~left], depth + 1, rows)
            rows[here][:4] = [best[1], best[2], a, b]
        return here

    def score(self, x: np.ndarray) -> np.ndarray:
        """The mean share of label 1 in the leaves that each row comes to; 1/2 without trees."""
        if not self.nodes:
            return np.full(len(x), 0.5)
        total = np.zeros(len(x))
        for t in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = t[at, 0].astype(np.int64)
                go = np.where(x[np.arange(len(x)), np.maximum(f, 0)] < t[at, 1], t[at, 2], t[at, 3]).astype(np.int64)
                at = np.where(f < 0, at, go)
            total += t[at, 4]
        return total / len(self.nodes)


def train(findings: list[Finding]) -> Forest:
    x = np.array([describe(t, s, e) for t, s, e, _ in findings], float).reshape(-1, FEATURES)
    return Forest().fit(x, np.array([f[3] for f in findings], float))


@lru_cache
def default_forest() -> Forest:
    return train(labelled_findings() + assigned_findings())


def column_findings(column: pa.Array, forest: Forest) -> list[list[tuple[int, int, float]]]:
    """Candidates (start, end, score) of each text, in code points."""
    column = pc.fill_null(column, "")
    out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(column))]
    found, rows = [], []
    look = pc.or_(pc.match_substring_regex(column, LOOK), pc.match_substring_regex(column, f"(?i){NAMED}"))
    for i in look.to_numpy(zero_copy_only=False).nonzero()[0].tolist():
        text = column[i].as_py()
        for s, e in sorted({*candidates(text), *values(text)}, key=lambda x: (x[0], -x[1])):
            found.append((i, s, e))
            rows.append(describe(text, s, e))
    if rows:
        for (i, s, e), p in zip(found, forest.score(np.array(rows, float)).tolist(), strict=True):
            if out[i] and s < out[i][-1][1]:  # runs that overlap are one candidate, with the highest score
                s, e, p = out[i][-1][0], max(e, out[i][-1][1]), max(p, out[i][-1][2])
                out[i].pop()
            out[i].append((s, e, p))
    return out


def scan(docs: DataFrame, least: float = 0.5, forest: Forest | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_candidates, n_secrets, spans, top_score) of each row: spans start:end of the candidates that score `least` or more.

    A null text has no candidates; top_score is 0 without any. Repeated rows come out repeated, null ids
    stay null, other columns play no part, an empty table gives an empty table.
    """
    ready(docs.sparkSession)
    forest = forest or default_forest()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind_of = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = column_findings(b.column(1), forest)
            kept = [[(s, e) for s, e, p in f if p >= least] for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([len(k) for k in kept], pa.int64()), pa.array([",".join(f"{s}:{e}" for s, e in k) for k in kept], pa.string()), pa.array([max((p for _, _, p in f), default=0.0) for f in found], pa.float64())],
                ["id", "n_candidates", "n_secrets", "spans", "top_score"],
            )

    return docs.mapInArrow(run, f"id {kind_of}, n_candidates bigint, n_secrets bigint, spans string, top_score double").withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, mark: str = "[secret]", least: float = 0.5, forest: Forest | None = None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with each secret in the text replaced by `mark`, and length_col, where there is one, counted again for changed texts."""
    ready(docs.sparkSession)
    forest = forest or default_forest()
    names = docs.columns
    at, size = names.index(text_col), names.index(length_col) if length_col in names else None

    def clean(text: str, found: list[tuple[int, int, float]]) -> str:
        for s, e, p in reversed(found):
            if p >= least:
                text = text[:s] + mark + text[e:]
        return text

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            found = column_findings(cols[at], forest)
            if any(p >= least for f in found for _, _, p in f):
                old = cols[at].to_pylist()
                new = [clean(t, f) if f else t for t, f in zip(old, found, strict=True)]
                cols[at] = pa.array(new, cols[at].type)
                if size is not None:
                    cols[size] = pa.array([n if a == c else len(c) for n, a, c in zip(cols[size].to_pylist(), old, new, strict=True)], cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
