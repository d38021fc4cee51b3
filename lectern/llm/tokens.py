"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once a worker.

Both public vocabularies split a text into words before merging, so the ids of
a text are those of its words in order. For texts of common Latin characters
(``_SAFE``) the split is done here by the same pattern, and the library encodes
only words that this worker has not met; any other text, and any text with a
special token's string, goes to the library whole. Results are the library's.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Collection

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of one generation. A full generation becomes the old one, from which words that are met again move on.
CACHE_WORDS = 250_000
#: Characters of the texts whose new words are encoded together.
TOGETHER = 1 << 22
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼½¾"
#: Characters that normalisation leaves alone and whose classes don't depend on a Unicode version; U+0130 grows in lower case.
_SAFE = re.compile("[\t\n\r -~\xa1-įı-ɏ‐-‧‰-⁞]*")
#: Safe characters whose lower case is in no class of the pattern but that for punctuation, though the library knows them as letters.
_LEAVES = "".join(c for c in map(chr, range(0x80, 0x250)) if _SAFE.fullmatch(c) and not _SAFE.fullmatch(c.lower()))
_SAFE_LOWERED = re.compile(f"[{''.join(re.escape(c) for c in map(chr, range(0x2100)) if _SAFE.fullmatch(c) and c not in _LEAVES)}]*")
#: The split patterns of the two vocabularies, with the classes written out for those characters.
_BYTE_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_WORD_ENDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
_SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def vocabulary_path(name: str) -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Whole texts to ids (little-endian unsigned 32-bit) with the vocabulary file at ``path``."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cache_words, self.known, self.old = cache_words, {}, {}
        self.pattern, self.lower = self._split(spec)
        # Words of letters are encoded many at a time: joined, they split the same way, and a token tells where a word begins or ends.
        self.plain = re.compile(f"{'' if self.lower else ' '}[{_L}]+").fullmatch
        self.joiner = self.tokenizer
        if self.lower:  # words are normalised and split already: a tokenizer that does neither again
            blanks = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
            self.joiner = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": blanks, "added_tokens": []}))
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.border = np.zeros(max(names.values()) + 1, bool)
        self.border[[i for t, i in names.items() if (t.endswith("</w>") if self.lower else t.startswith("Ġ"))]] = True

    @staticmethod
    def _split(spec: dict) -> tuple[re.Pattern | None, bool]:
        """The pattern that splits safe texts and whether they are lower-cased, or None where only the library knows."""
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and norm is None:
            return _BYTE_LEVEL, False
        parts = pre.get("pretokenizers", [{}])
        kinds = [n["type"] for n in (norm or {}).get("normalizers", [])]
        if parts[0].get("pattern") == {"Regex": _SPLIT_PATTERN} and parts[0]["behavior"] == "Removed" and kinds == ["NFC", "Replace", "Lowercase"]:
            return _WORD_ENDS, True
        return None, False

    def _learn(self, missing: list[str]) -> None:
        joined, rest, step = (missing, [], 256) if self.lower else ([], [], 2048)
        for w in () if self.lower else missing:
            (joined if self.plain(w) else rest).append(w)
        for at in range(0, len(joined), step):
            part = joined[at : at + step]
            ids = np.asarray(self.joiner.encode_batch_fast([(" " if self.lower else "").join(part)], add_special_tokens=False)[0].ids, "<u4")
            marks = 4 * np.flatnonzero(self.border[ids])
            cuts = [0, *(marks + 4).tolist()] if self.lower else [*marks.tolist(), 4 * len(ids)]
            if len(cuts) != len(part) + 1:
                rest += part
                continue
            raw = ids.tobytes()
            self.known.update(zip(part, (raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for word, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[word] = np.asarray(e.ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text. Words that are new to this worker are encoded together for about TOGETHER characters."""
        out, at = [], 0
        while at < len(texts):
            part, size = [], 0
            while at < len(texts) and (not part or size < TOGETHER):
                part.append(texts[at] or "")
                size += len(part[-1])
                at += 1
            out += self._encoded(part)
        return out

    def _encoded(self, texts: list[str]) -> list[bytes]:
        here = [self._splits_here(t) for t in texts]
        mine = [t for t, ok in zip(texts, here, strict=True) if ok]
        done = iter(self._between_blanks([t.lower() for t in mine]) if self.lower else self._by_pattern(mine))
        whole = self.tokenizer.encode
        return [next(done) if ok else np.asarray(whole(t, add_special_tokens=False).ids, "<u4").tobytes() for t, ok in zip(texts, here, strict=True)]

    def _splits_here(self, text: str) -> bool:
        """Whether a text's words are found here; else it goes to the library whole."""
        if self.pattern is None or not (_SAFE_LOWERED if self.lower else _SAFE).fullmatch(text):
            return False
        return not any(s in text for s in self.special)

    def _by_pattern(self, texts: list[str]) -> list[bytes]:
        found = [self.pattern.findall(t) for t in texts]
        words = set().union(*found)
        if missing := words.difference(self.known):
            self._meet(missing, words)
        look = self.known.__getitem__
        return [b"".join(map(look, f)) for f in found]

    def _between_blanks(self, texts: list[str]) -> list[bytes]:
        """As the pattern drops blanks, whole pieces between them are coded, each distinct one of these texts once."""
        pieces = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))  # blanks of safe texts are ASCII
        coded = pieces.flatten().dictionary_encode()
        ids, ends = _gathered(*self._of_pieces(coded.dictionary), coded.indices.to_numpy())
        cuts = (4 * ends[pieces.offsets.to_numpy()]).tolist()
        raw = ids.tobytes()
        return [raw[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]

    def _of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces end to end, and where each ends. Only their words are looked up, each distinct one once."""
        mixed = pc.invert(pc.utf8_is_alpha(pieces))  # letters of safe texts are those of the pattern
        apart = pc.replace_substring_regex(pieces.filter(mixed), self.pattern.pattern, r"\0 ")
        words = pc.ascii_split_whitespace(pc.replace_with_mask(pieces, mixed, apart))
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.known.setdefault("", b"")  # a blank at either end leaves an empty piece
        found = list(map(self.known.get, names))
        if missing := [i for i, ids in enumerate(found) if ids is None]:
            self._meet([names[i] for i in missing], names)
            for i in missing:
                found[i] = self.known[names[i]]
        ends = np.cumsum([0, *map(len, found)]) // 4
        ids, ends = _gathered(np.frombuffer(b"".join(found), "<u4"), ends, coded.indices.to_numpy())
        return ids, ends[words.offsets.to_numpy()]

    def _meet(self, missing: Collection[str], found: Collection[str]) -> None:
        """Put the missing of the found into the table."""
        if len(self.known) + len(missing) > self.cache_words:
            self.old, self.known = self.known, {}
            missing = found
        known, old, new = self.known, self.old, []
        for w in missing:
            ids = old.get(w)
            if ids is None:
                new.append(w)
            else:
                known[w] = ids
        self._learn(new)


def _gathered(ids: np.ndarray, ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ids at these places, end to end, and where each ends; both lists of ends begin with 0."""
    n = np.diff(ends)[places]
    to = np.concatenate([[0], np.cumsum(n)])
    return ids[np.repeat(ends[places] - to[:-1], n) + np.arange(to[-1])], to


def largest_id(path: str) -> int:
    """The largest id of a vocabulary file."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    key = (path, cache_words)
    if key not in _encoders:
        _encoders[key] = Encoder(path, cache_words)
    return _encoders[key]
