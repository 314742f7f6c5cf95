"""Token ids of texts with a public tokenizer file, with a bounded memory of words.

The tokenizer splits at white space before anything else, so the ids of a text
are the ids of its white-space parts, one after another. Parts seen before are
looked up; unseen ones are cut by the file's own word pattern and given to its
model word by word. Texts with characters outside the plain ranges below, or
with a special token's string, go to the tokenizer whole.
``Encoder`` gives exactly ``Tokenizer.encode(text, add_special_tokens=False).ids``.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import regex
from tokenizers import Tokenizer

#: Parts, and words, remembered by an encoder; when as many are held, it starts anew.
MEMORY = 300_000
#: Parts longer than this are encoded and forgotten.
LONG_PART = 48

#: ASCII with its common white space, and Latin letters and signs whose lower case and composed form are one character each.
_PLAIN = re.compile("[\\t\\n\\r -~¡-įı-ɏ]*")




def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level tokenizers write for each byte: itself if printable, else the next free code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    out |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in out)}
    return out


_BYTE_LETTERS = _byte_letters()


class Encoder:
    def __init__(self, path: str, end_id: int | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = np.array([] if end_id is None else [end_id], np.uint32).tobytes()
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.pattern = self._word_pattern()

    def _word_pattern(self) -> regex.Pattern | None:
        """The file's word pattern, if its steps are the ones that this class can take one part at a time; else every text goes whole."""
        steps = json.loads(self.tokenizer.to_str())
        normal = [x["type"] for x in (steps.get("normalizer") or {}).get("normalizers", [])]
        split = (steps.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if normal != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in split] != ["Split", "ByteLevel"] or not split[0]["invert"] or split[1]["add_prefix_space"] or split[1]["use_regex"]:
            return None
        return regex.compile(split[0]["pattern"]["Regex"])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() else "".join(_BYTE_LETTERS[b] for b in word.encode())
        ids = array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()
        if len(word) <= LONG_PART:
            if len(self.words) >= MEMORY:
                self.words.clear()
            self.words[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        words = self.words
        ids = b"".join([words.get(w) or self._word(w) for w in self.pattern.findall(part)])
        if len(part) <= LONG_PART:
            if len(self.parts) >= MEMORY:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def __call__(self, text: str | None) -> np.ndarray:
        """The text's ids as unsigned 32-bit numbers, then the end id, if one is set."""
        if not text:
            return np.frombuffer(self.end, np.uint32)
        if self.pattern is None or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.frombuffer(self._whole(text) + self.end, np.uint32)
        parts = text.lower().split()
        found = list(map(self.parts.get, parts))
        if None in found:
            found = [self._part(p) if ids is None else ids for p, ids in zip(parts, found, strict=True)]
        return np.frombuffer(b"".join(found) + self.end, np.uint32)
