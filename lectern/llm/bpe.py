"""Byte-pair encoding by backtracking, and decoding by an offset table.

Aho-Corasick gives the longest token from each byte of a word. The encoder
takes it if it can stand beside the token before it, else a shorter prefix,
else it goes back; every position is given up at most once, so the work is
linear. Two tokens can stand side by side when, growing both from the bytes at
their border in the order of merges, no merge across the border comes first
(the pair table keeps the answers). That gives exactly the merges' result.

Decoding gathers the bytes of all ids through a table of offsets into one blob.

Defined results: null is the empty text, which has no ids; a special token's
string in a text becomes its id; texts are encoded whole, whatever their
length; repeated rows get equal results, and null ids stay null; an empty table
gives an empty result; only the id and the text column are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.tokens import _BYTE_LEVEL, _SAFE, CACHE_WORDS

_ANY = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """The byte behind each character in which byte-level vocabularies are written."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import ahocorasick
        import regex

        self.cache_words = cache_words
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        self.bytes: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.ids = {t: i for i, t in self.bytes.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        vocab = spec["model"]["vocab"]
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            whole = vocab[a + b]
            self.merges.setdefault((vocab[a], vocab[b]), (rank, whole))
            self.parts.setdefault(whole, (vocab[a], vocab[b], rank))
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.words, self.old, self.pairs, self.shorter = {}, {}, {}, {}
        self._any = regex.compile(_ANY)
        self._apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        top = max([*self.bytes, *self.special.values()]) + 1
        all_bytes = self.bytes | {i: s.encode() for s, i in self.special.items()}
        sizes = np.array([len(all_bytes.get(i, b"")) for i in range(top)], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.blob = np.frombuffer(b"".join(all_bytes.get(i, b"") for i in range(top)), np.uint8)

    def _edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The tokens at one edge of a token, from its byte up, each with the rank of the merge that ends it."""
        out, ends = [], float("inf")
        while True:
            out.append((token, ends))
            if token not in self.parts:
                return out[::-1]
            a, b, ends = self.parts[token]
            token = b if right else a

    def beside(self, left: int, right: int) -> bool:
        """Whether the merges of the joined bytes leave exactly these two tokens."""
        known = self.pairs.get((left, right))
        if known is None:
            ups, downs = self._edge(left, True), self._edge(right, False)
            i = j = 0
            known = True
            while True:
                (a, a_ends), (b, b_ends) = ups[i], downs[j]
                across = self.merges.get((a, b))
                # Equal ranks are one rule, which is applied from the left.
                if across and across[0] < a_ends and across[0] <= b_ends:
                    known = False
                    break
                if a_ends == b_ends == float("inf"):
                    break
                if a_ends <= b_ends:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) >= 4 * CACHE_WORDS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def _prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of a token, -1 where there is none."""
        if token not in self.shorter:
            t = self.bytes[token]
            self.shorter[token] = next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), -1)
        return self.shorter[token]

    def word(self, raw: bytes) -> list[int]:
        """The ids of one word."""
        if raw in self.ids and raw:
            return [self.ids[raw]]
        longest = [-1] * len(raw)
        for end, (size, token) in self.automaton.iter(raw.decode("latin-1")):
            longest[end - size + 1] = token  # later ends are longer
        out, at, dead = [], 0, set()
        token = longest[0]
        while at < len(raw):
            while token >= 0:
                end = at + len(self.bytes[token])
                if end not in dead and (not out or self.beside(out[-1], token)):
                    break
                token = self._prefix(token)
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < len(raw) else -1
            else:
                dead.add(at)
                last = out.pop()
                at -= len(self.bytes[last])
                token = self._prefix(last)
        return out

    def _encode_plain(self, text: str) -> bytes:
        found = _BYTE_LEVEL.findall(text) if _SAFE.fullmatch(text) else self._any.findall(text)
        known = self.words
        if missing := set(found).difference(known):
            if len(known) + len(missing) > self.cache_words:
                # A full generation becomes the old one, from which words that are met again move on.
                self.old, self.words = known, (known := {})
                missing = set(found)
            for w in missing:
                known[w] = self.old.get(w) or np.asarray(self.word(w.encode()), "<u4").tobytes()
        return b"".join([known[w] for w in found])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if self._apart is None or not any(s in text for s in self.special):
            return self._encode_plain(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._encode_plain(p) for p in self._apart.split(text))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids, by one gather through the offset table; a cut character becomes U+FFFD."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(i):
            return b""
        out, step = [], 1 << 18
        for at in range(0, len(i), step):
            part = i[at : at + step]
            sizes = self.offsets[part + 1] - self.offsets[part]
            ends = np.cumsum(sizes)
            where = np.arange(ends[-1]) + np.repeat(self.offsets[part] - (ends - sizes), sizes)
            out.append(self.blob[where].tobytes())
        raw = b"".join(out)
        return raw.decode("utf-8", "replace").encode()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This worker's codec for a vocabulary file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and the decoded text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = [tool.encode(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([tool.decode(x).decode() for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(f"`{doc_id}`", f"`{text}`").mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for b in batches:
            n, ids, texts = [], [], []
            for t in b.column(1):
                x = tool.encode(t.as_py())
                n.append(len(x) // 4)
                ids.append(hashlib.sha256(x).hexdigest())
                texts.append(hashlib.sha256(tool.decode(x)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
