"""Exact token counts and ids of whole texts from cached pre-tokens.

A pre-token is a stretch of text that no merge of the vocabulary can cross. Pre-tokens are found for
many texts at once with numpy, told apart by 64-bit hashes, and only those not met before go through
the tokenizer library; what they gave is kept in a bounded table.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa

from polyquery.llm.words import chunks, span_hashes, text_bytes

CHUNK = 4 << 20


class HashTable:
    """64-bit keys to values: a few sorted arrays, merged as they fill; it starts again beyond `most` keys."""

    def __init__(self, most: int = 1_000_000) -> None:
        self.most, self.runs, self.kept = most, [], None

    def keep(self) -> None:
        """What is in now stays for good."""
        self.kept, self.runs = self.runs, []

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there are none."""
        out = np.full(len(keys), -1, np.int64)
        for k, v in [*(self.kept or ()), *self.runs]:
            at = np.searchsorted(k, keys)
            at[at == len(k)] = 0
            hit = k[at] == keys
            out[hit] = v[at[hit]]
        return out

    def full(self, more: int) -> bool:
        return sum(len(k) for k, _ in self.runs) + more > self.most

    def clear(self) -> None:
        self.runs = []

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        if not len(keys):
            return
        order = np.argsort(keys)
        self.runs.append((keys[order], values[order]))
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            (k1, v1), (k2, v2) = self.runs.pop(), self.runs.pop()
            k, v = np.concatenate((k1, k2)), np.concatenate((v1, v2))
            order = np.argsort(k, kind="stable")
            self.runs.append((k[order], v[order]))


def firsts(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each element the number of its distinct value, the distinct values, and where each is first met."""
    codes, distinct = pd.factorize(hashes)
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, distinct, first


class TokenCounter:
    """Token counts as sentencepiece gives them, for a BPE model whose merges cross neither a space nor a line end.

    Offline part: every vocabulary string is encoded alone; those that come back as exactly one token
    are the whole tokens, whose pre-tokens count one without any merging. The same pass proves that no
    piece holds a space after another character, or a line end beside another character; where that
    fails, and for texts with the space symbol itself, whole texts go through the library.
    """

    MARK = "▁"

    def __init__(self, path: str, proof: tuple[bool, bytes] | None = None) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.line = sp.piece_to_id("<0x0A>")
        self.table = HashTable()
        self.cut, whole = proof or self.prove()
        self.proof = self.cut, whole
        if self.cut:
            hashes = np.frombuffer(whole, "<u8")
            self.table.put(hashes, np.ones(len(hashes), np.int64))
            self.table.keep()

    def prove(self) -> tuple[bool, bytes]:
        """Whether texts may be cut, and the hashes of the whole tokens; made once, on the driver, and sent along."""
        sp = self.sp
        pieces = [(i, sp.id_to_piece(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        alone = sp.encode(" a", num_threads=1) != sp.encode("a", num_threads=1)  # a leading space is kept
        if not (alone and sp.is_byte(self.line) and not any(self.MARK in p.lstrip(self.MARK) or "\n" in p for _, p in pieces)):
            return False, b""
        texts = [p.replace(self.MARK, " ") for _, p in pieces]
        data, offsets = text_bytes(pa.array([t for t, n in zip(texts, self.encode(texts), strict=True) if n == 1], pa.string()))
        return True, span_hashes(data, offsets[:-1], offsets[1:]).tobytes()

    def encode(self, parts: list) -> np.ndarray:
        """Counts of pre-tokens, each merged apart from the others: the library gets them a line each."""
        out, block, size = [], [], 0
        for i, p in enumerate(parts):
            block.append(p)
            size += len(p)
            if size > 16_000 or i == len(parts) - 1:
                joined = ("\n".join(["", *block]) if isinstance(p, str) else b"\n".join([b"", *block]).decode("utf-8", "replace")) + "\n"
                ids = np.array(self.sp.encode(joined, num_threads=1))
                out.append(np.diff(np.flatnonzero(ids == self.line)) - 1)
                block, size = [], 0
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def counts(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_bytes(column)
        out = np.zeros(len(offsets) - 1, np.int64)
        for a, b in chunks(offsets, CHUNK):
            out[a:b] = self.some(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        return out

    def some(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        whole = lambda i: data[offsets[i] : offsets[i + 1]].tobytes()
        if not self.cut:
            return np.array([len(self.sp.encode(whole(i).decode("utf-8", "replace"), num_threads=1)) for i in range(n)], np.int64)
        buf = np.insert(data, offsets[:-1], 0x20)  # the space that the library puts before each text
        at = offsets + np.arange(n + 1)
        space, line = buf == 0x20, buf == 0x0A
        fresh = np.zeros(len(buf) + 1, bool)
        fresh[at] = True
        fresh[1:-1] |= line[:-1] | line[1:] | (space[1:] & ~space[:-1])
        starts = np.flatnonzero(fresh[:-1])
        ends = np.append(starts[1:], len(buf))
        doc = np.searchsorted(at, starts, "right") - 1
        lines = line[starts]
        tokens = np.ones(len(starts), np.int64)
        starts, ends, some = starts[~lines], ends[~lines], np.flatnonzero(~lines)
        codes, distinct, first = firsts(span_hashes(buf, starts, ends))
        if self.table.full(len(distinct)):
            self.table.clear()
        known = self.table.get(distinct)
        if len(new := np.flatnonzero(known < 0)):
            raw = buf.tobytes()
            known[new] = self.encode([raw[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            self.table.put(distinct[new], known[new])
        tokens[some] = known[codes]
        out = np.bincount(doc, weights=tokens, minlength=n).astype(np.int64)
        out[np.diff(offsets) == 0] = 0
        odd = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81))
        for i in np.unique(np.searchsorted(at, odd, "right") - 1):
            out[i] = len(self.sp.encode(whole(i).decode("utf-8", "replace"), num_threads=1))
        return out


# Character classes below U+0250, as Unicode has them: 0 other, 1 letter, 2 number, 3 white space.
EASY = 0x250
KIND = np.array([1 if unicodedata.category(chr(c))[0] == "L" else 2 if unicodedata.category(chr(c))[0] == "N" else 3 if c in (0x20, 0x85, 0xA0, *range(9, 14)) else 0 for c in range(EASY)], np.uint8)
MORE = {"s": 1, "t": 1, "m": 1, "d": 1, "re": 2, "ve": 2, "ll": 2}  # fixed values: the endings after an apostrophe


class IdEncoder:
    """Token ids of a byte-level BPE tokenizer whose pre-tokens are runs of letters, numbers or other signs with
    one space before them, apostrophe endings, and white space.

    Texts with characters from U+0250 up, or with a special token's string, go through the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.merge = self.merger()
        self.table = HashTable()
        self.clear()

    def clear(self) -> None:
        self.table.clear()
        self.flat, self.at, self.size = np.zeros(1 << 20, np.uint32), [0], 0

    def merger(self):
        """A function from a pre-token's bytes to ids, faster than the library and with its ids: where the file's merges
        come in the order of the ids that they make, the pair to merge next is the one whose whole has the lowest id."""
        import json

        import tiktoken

        model = json.loads(self.lib.to_str())["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = np.array([model["vocab"][a + b] for a, b in merges])
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if t not in self.special}
        if (np.diff(made) <= 0).any() or not all(bytes([b]) in ranks for b in range(256)) or model.get("ignore_merges"):
            return None
        return tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch(texts, add_special_tokens=False)]

    def ids(self, texts: list[str | None]):
        """Yields the ids of each text, in order."""
        block: list[str] = []
        size = 0
        for t in texts:
            t = t or ""
            if block and size + len(t) > CHUNK // 4:
                yield from self.some(block)
                block, size = [], 0
            block.append(t)
            size += len(t)
        if block:
            yield from self.some(block)

    def some(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        hard = np.zeros(len(texts), bool)
        hard[np.unique(np.searchsorted(at, np.flatnonzero(cp >= EASY), "right") - 1)] = True
        for s in self.special:
            if s in joined:
                hard |= np.array([s in t for t in texts])
        starts, ends, doc = self.segments(np.minimum(cp, EASY - 1), at)
        if hard.any():
            easy = ~hard[doc]
            starts, ends, doc = starts[easy], ends[easy], doc[easy]
        codes, distinct, first = firsts(span_hashes(np.minimum(cp, EASY).astype("<u2").view(np.uint8), 2 * starts, 2 * ends))
        if self.table.full(len(distinct)):
            self.clear()
        known = self.table.get(distinct)
        if len(new := np.flatnonzero(known < 0)):
            parts = [joined[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            got = [self.merge(p.encode()) for p in parts] if self.merge else self.library(parts)
            sizes = np.array([len(x) for x in got])
            more = np.fromiter((i for x in got for i in x), np.uint32, int(sizes.sum()))
            while self.size + len(more) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), np.uint32)))
            self.flat[self.size : self.size + len(more)] = more
            where = self.size + np.concatenate(([0], np.cumsum(sizes)[:-1]))
            self.size += len(more)
            known[new] = where << 24 | sizes
            self.table.put(distinct[new], known[new])
        value = known[codes]
        size, where = value & 0xFFFFFF, value >> 24
        to = np.cumsum(size)
        total = int(to[-1]) if len(to) else 0
        out = self.flat[np.repeat(where - (to - size), size) + np.arange(total)]
        cuts = np.concatenate(([0], np.cumsum(np.bincount(doc, weights=size, minlength=len(texts)).astype(np.int64)))) if len(doc) else np.zeros(len(texts) + 1, np.int64)
        result = [out[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
        if hard.any():
            which = np.flatnonzero(hard)
            for i in which:
                result[i] = np.array(self.library([texts[i]])[0], np.uint32)
        return result

    @staticmethod
    def segments(cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the pre-tokens."""
        if not len(cp):
            return (np.zeros(0, np.int64),) * 3
        kind = KIND[cp]
        edge = np.zeros(len(cp) + 1, bool)  # a document begins here
        edge[at] = True
        white = kind == 3
        fresh = np.zeros(len(cp) + 1, bool)
        fresh[1:-1] = kind[1:] != kind[:-1]
        # of white space before something else the last sign stands apart, and a space there belongs to what follows
        last = np.flatnonzero(white[:-1] & ~white[1:] & ~edge[1:-1])
        fresh[last] = True
        fresh[last[cp[last] == 0x20] + 1] = False
        fresh |= edge
        # apostrophe endings: only where the apostrophe itself begins a pre-token
        quotes = np.flatnonzero(cp == 0x27)
        for q in quotes[fresh[quotes]].tolist():
            stop = int(at[np.searchsorted(at, q, "right")])
            for ending, n in MORE.items():
                if q + 1 + n <= stop and all(cp[q + 1 + j] == ord(ending[j]) for j in range(n)):
                    fresh[q + 1] = False
                    fresh[q + 1 + n] = True
                    break
        starts = np.flatnonzero(fresh[:-1])
        ends = np.append(starts[1:], len(cp))
        return starts, ends, np.searchsorted(at, starts, "right") - 1
