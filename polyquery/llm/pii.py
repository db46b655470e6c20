"""Personal data in plain and in disguised form, with spans in the source text.

Plain identifiers are matched on the text as it is. Three transducers then rewrite a text while keeping,
for each character written, the source span that it came from: look-alike characters become the Latin
letters, digits and signs that they imitate; runs of number words become digits; "at" and "dot" in
brackets or between words become the signs. They run one after another, identifiers are detected in what
they leave, and the detected spans are mapped back through the kept spans to the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquery.llm.shared import documents, ready

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # from the start of a run of digits: elsewhere it can't match, and long runs stay linear
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """What the pattern finds from left to right, searched from each @ outwards."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def plain(text: str) -> list[Span]:
    """All identifiers of the text as written; a match that fails its check is dropped and not tried again in another way."""
    out: list[Span] = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0]) if m.end() - m.start() < 64 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


# Letters of other scripts that look like Latin ones.
ALIKE = dict(zip("АВЕКМНОРСТУХаеорсухіјѕԁԛԝһ", "ABEKMHOPCTYXaeopcyxijsdqwh", strict=True)) | dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαινρυ", "ABEZHIKMNOPTYXoaivpu", strict=True)) | {"\u2024": ".", "\u3002": ".", "\u00b7": ".", "\u2010": "-", "\u2011": "-", "\u2013": "-", "\u2212": "-", "\ufe6b": "@", "\u00a0": " ", "\u2009": " ", "\u202f": " ", "\u3000": " "}


def look_alikes() -> dict[str, str]:
    """ALIKE, and what a compatibility form reduces to one printable ASCII character (full width, mathematical, circled)."""
    out = dict(ALIKE)
    for a, b in ((0x2070, 0x209C), (0x2460, 0x24EA), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF)):
        for c in map(chr, range(a, b + 1)):
            to = unicodedata.normalize("NFKC", c)
            if len(to) == 1 and " " < to < "\x7f":
                out.setdefault(c, to)
    return out


HOMOGLYPHS = look_alikes()
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
# Number words in the languages of the corpus.
NUMBERS = {w: str(i) for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve") for i, w in enumerate(words.split())} | {"oh": "0"}
WORD = "|".join(sorted(NUMBERS, key=len, reverse=True))
SPELLED = re.compile(rf"(?<!\w)(?:{WORD}|[0-9]+)(?:[\s,-]+(?:{WORD}|[0-9]+))+(?!\w)", re.I)
ANY_WORD = re.compile(rf"(?<!\w)(?:{WORD})(?!\w)", re.I)
PART = re.compile(rf"{WORD}|[0-9]+", re.I)
PLUS = re.compile(r"(?<!\w)(?:plus)\s+(?=\+?[0-9])", re.I)
OPEN, CLOSE = r"[\[({<]\s*", r"\s*[\])}>]"
AT, DOT = r"(?:at|arroba|chez|klammeraffe)", r"(?:dot|punkt|punto|point)"
BRACKETED = re.compile(rf"(?P<at>{OPEN}(?:{AT}|@){CLOSE})|(?P<dot>{OPEN}(?:{DOT}|\.){CLOSE})", re.I)  # white space around it is taken by hand, which stays linear
SPOKEN = re.compile(rf"(?<![\w.%+-])([A-Za-z0-9_%+-]+(?:(?:\.|\s+{DOT}\s+)[A-Za-z0-9_%+-]+){{0,4}})(?:\s+{AT}\s+|\s*@\s*)([A-Za-z0-9-]+)((?:(?:\s+{DOT}\s+|\.)[A-Za-z0-9-]+){{1,4}})(?![\w-])", re.I)
HINT = re.compile(rf"{OPEN}(?:{AT}|{DOT}|@|\.){CLOSE}|(?<!\w){DOT}(?!\w)|\s@|@\s", re.I)
# Top-level names at which a spoken address may end.
TOP = frozenset("com org net edu gov mil int info biz name pro io ai app dev co me tv uk us ca au nz ie de at ch fr be es pt it nl se no dk fi pl cz ru ua jp cn kr in br mx ar cl eu example test".split())
# Between the parts of a joined run: a dot in words, in brackets or as a sign (not one that ends a sentence), or what stands between groups of digits.
DOTTED = rf"(?:\s*{OPEN}(?:{DOT}|\.){CLOSE}\s*|\s+(?:{DOT}|\.)\s+|\.)"
JOINED = re.compile(rf"(?<!\w)(?:{WORD}|[0-9]+)(?:(?:{DOTTED}|[\s,()-]+)(?:{WORD}|[0-9]+))+(?!\w)", re.I)
IS_DOT = re.compile(DOTTED, re.I)
NUMERIC_DOT = re.compile(rf"(?<=[0-9])\s+{DOT}\s+(?=[0-9])", re.I)


class Tape:
    """A text and, for each of its characters, the source span that it came from."""

    def __init__(self, text: str, starts: list[int], ends: list[int]) -> None:
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def of(cls, text: str) -> Tape:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Tape:
        """edits (start, end, new text), ascending and apart. New characters share the replaced span."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for s, e, new in edits:
            text += [self.text[at:s], new]
            starts += self.starts[at:s] + [self.starts[s]] * len(new)
            ends += self.ends[at:s] + [self.ends[e - 1]] * len(new)
            at = e
        text.append(self.text[at:])
        return Tape("".join(text), starts + self.starts[at:], ends + self.ends[at:])

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


def unmask_letters(tape: Tape) -> Tape:
    """Look-alikes to Latin, digits of other scripts to 0-9; invisible characters go."""
    edits = []
    for i, c in enumerate(tape.text):
        if c > "\x7f":
            to = HOMOGLYPHS.get(c)
            if to is None and c in INVISIBLE:
                to = ""
            if to is None and c.isdecimal():
                to = str(unicodedata.decimal(c))
            if to is not None:
                edits.append((i, i + 1, to))
    return tape.rewritten(edits)


def unspell_digits(tape: Tape, joined: bool = False) -> Tape:
    """Runs of at least four number words and digits, with at least two words, become digits, each in its word's span.

    Joined runs go on across dots and round brackets, which stay, and one number word is enough.
    """
    edits: list[tuple[int, int, str]] = []
    if ANY_WORD.search(tape.text):
        for m in (JOINED if joined else SPELLED).finditer(tape.text):
            parts = [(p.start(), p.end(), NUMBERS.get(p[0].lower(), p[0])) for p in PART.finditer(tape.text, m.start(), m.end())]
            words = sum(tape.text[s].isalpha() for s, _, _ in parts)
            if words < (1 if joined else 2) or sum(len(d) for _, _, d in parts) < 4:
                continue
            for (s, e, d), nxt in zip(parts, [*parts[1:], None], strict=True):
                if tape.text[s].isalpha():
                    edits.append((s, e, d))
                if nxt and nxt[0] > e:
                    between = tape.text[e : nxt[0]]
                    edits.append((e, nxt[0], "." if joined and IS_DOT.fullmatch(between) else re.sub(r"[^()]", "", between)))
    tape = tape.rewritten(edits)
    if edits:
        tape = tape.rewritten([(m.start(), m.end(), "+") for m in PLUS.finditer(tape.text) if tape.text[m.end()] != "+"])
        tape = tape.rewritten([(m.start(), m.end(), ".") for m in NUMERIC_DOT.finditer(tape.text)])
    return tape


def unmask_signs(tape: Tape) -> Tape:
    """Bracketed at and dot become signs; spoken ones do inside a whole spoken address (a name, at, names joined by dot)."""
    if not HINT.search(tape.text):
        return tape
    edits, done = [], 0
    for m in BRACKETED.finditer(tape.text):
        s, e = m.span()
        while s > done and tape.text[s - 1].isspace():
            s -= 1
        while e < len(tape.text) and tape.text[e].isspace():
            e += 1
        edits.append((s, e, "@" if m["at"] else "."))
        done = e
    tape, edits = tape.rewritten(edits), []
    for m in SPOKEN.finditer(tape.text):
        written = m[0]
        if not re.search(r"\s", written):
            continue
        last = re.split(rf"\s+{DOT}\s+|\.", m[3], flags=re.I)[-1]
        spoken_dots = re.search(rf"\s{DOT}\s", m[3], re.I)
        if last.lower() not in TOP or not (spoken_dots or "@" in written):
            continue
        for d in re.finditer(rf"\s+{DOT}\s+", m[1], re.I):
            edits.append((m.start(1) + d.start(), m.start(1) + d.end(), "."))
        edits.append((m.end(1), m.start(2), "@"))
        for d in re.finditer(rf"\s+{DOT}\s+", m[3], re.I):
            edits.append((m.start(3) + d.start(), m.start(3) + d.end(), "."))
    tape = tape.rewritten(edits)
    return tape.rewritten([(m.start(), m.end(), ".") for m in NUMERIC_DOT.finditer(tape.text)])


# What a text needs for any identifier, and for any disguise: a fast first look at whole columns.
PLAIN_LOOK = "[@0-9]"
ODD_LOOK = "[^\\x00-\\x{24F}]|[" + "".join(c for c in [*HOMOGLYPHS, *INVISIBLE] if c < "\u0250") + "]"
JOINED_LOOK = rf"(?i)(?:^|[^\pL\pN_])(?:(?:{WORD})(?:{DOTTED}|[\s,()-]+)(?:{WORD}|[0-9]+)|[0-9]+(?:{DOTTED}|[\s,()-]+)(?:{WORD}))(?:$|[^\pL\pN_])"
SPELLED_LOOK = rf"(?i)(?:^|[^\pL\pN_])(?:{WORD}|[0-9]+)(?:[\s,-]+(?:{WORD}|[0-9]+)){{2}}(?:$|[^\pL\pN_])"
MASK_LOOK = rf"(?i)[\[({{<]\s*(?:{AT}|{DOT}|@|\.)\s*[\])}}>]|\s{DOT}\s|\s@|@\s"


def disguised(text: str) -> list[Span]:
    """Identifiers that appear once the transducers have run, as source spans; none where these change nothing.

    Numbers are read run by run first. What only joined runs show is added where nothing of its kind was found without joining.
    """
    tape = Tape.of(text)
    if not text.isascii():
        tape = unmask_letters(tape)
    split, joined = (unmask_signs(unspell_digits(tape, j)) for j in (False, True))
    found = [(k, *split.source(s, e)) for k, s, e in plain(split.text)] if split.text != text else []
    if joined.text != split.text:
        held = found + plain(text)
        for k, s, e in plain(joined.text):
            s, e = joined.source(s, e)
            if k != "email" and not any(kind == k and a < e and s < b for kind, a, b in held):
                found.append((k, s, e))
    return found


def spans(text: str | None, masked: bool = True) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans): all plain ones, and the disguised ones that are not within or across a plain one of their kind."""
    text = text or ""
    base = plain(text)
    more: list[Span] = []
    if masked:
        for k, s, e in disguised(text):
            same = [(a, b) for kind, a, b in base if kind == k and a < e and b > s]
            if all(s <= a and b <= e and (s, e) != (a, b) for a, b in same):
                more.append((k, s, e))
    return ordered(base), ordered(base + more)


def column_spans(column: pa.Array) -> list[tuple[list[Span], list[Span]]]:
    """spans() of each text; only texts that a look at the column has marked are gone through."""
    column = pc.fill_null(column, "")
    look = lambda pattern: pc.match_substring_regex(column, pattern).to_numpy(zero_copy_only=False)
    masked = look(ODD_LOOK) | look(SPELLED_LOOK) | look(JOINED_LOOK) | look(MASK_LOOK)
    some = masked | look(PLAIN_LOOK)
    out: list[tuple[list[Span], list[Span]]] = [([], [])] * len(column)
    for i in some.nonzero()[0].tolist():
        out[i] = spans(column[i].as_py(), bool(masked[i]))
    return out


def ordered(found: list[Span]) -> list[Span]:
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def written(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def redact(text: str | None, marks: dict[str, str] | None = None) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, longest one."""
    if not text:
        return text
    out, at = [], 0
    for k, s, e in sorted(spans(text)[1], key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], (marks or {}).get(k, f"[{k}]")]
            at = e
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row: counts and digest of the plain spans, and all spans.

    Spans are code points, end exclusive. A null text is empty: no spans, the digest of an empty string.
    Repeated rows come out repeated, null ids stay null, other columns play no part, an empty table gives
    an empty table.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = column_spans(b.column(1))
            counts = [pa.array([sum(x[0] == k for x in base) for base, _ in found], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, pa.array([written(every) for _, every in found], pa.string())], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.mapInArrow(run, f"id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))
