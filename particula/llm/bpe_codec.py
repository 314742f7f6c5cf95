"""BPE encoding by speculation and verification, and decoding, with the file of a public tokenizer.

Method. A word's tokens are first guessed: the longest token that fits, again
and again from the left. The guess is right exactly if every two neighbours
are: cut their merge trees open from the top, latest merge first, and no merge
across the boundary may come before the merges that use its two sides up
(``Merges.clashing``, one numpy pass over all distinct neighbours of a batch).
That holds for tokens that the merges make of their own letters; others are
never guessed. Only words with a clashing pair go through the merges one by one
(``Merges.exact``).

The tokenizer's own steps come first: strings of special tokens are taken out,
then its normaliser and its pre-tokenizer give the words. Texts of plain Latin
characters are cut at white space, and parts seen before are looked up in a
memory of ``MEMORY`` bytes. Decoding writes the tokens' strings joined by a
blank, as the library does for a file without a decoder; files with one go
through the library.

Defined cases: a null text is empty and has no ids and the empty decoded text;
repeated rows give a row each; an empty table gives no rows; other columns are
ignored, whatever their names; texts are taken whole at any length, and output
is handed on in batches of about ``OUT_BYTES``. Null ids decode to null, ids
that the file does not have are left out, as the library does. Letters that a
vocabulary lacks are left out too. Models other than plain BPE (dropout, an
unknown token, byte fallback, prefixes of continued words) raise ValueError.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .tokens import _BYTE_LETTERS, _PLAIN

#: Bytes of white-space parts and their ids that a codec remembers; when they are used up, it starts anew.
MEMORY = 96 << 20
#: Longer parts are encoded and forgotten.
LONG_PART = 64
#: What an entry of the memory takes beside its letters and ids.
ENTRY_BYTES = 140
OUT_BYTES = 8 << 20
#: Words of more letters are merged with a heap.
SHORT = 48

_NEVER = np.iinfo(np.int64).max


class Merges:
    """The vocabulary and the merges of a BPE file as arrays: for a token that a merge makes, its rank and its two sides."""

    def __init__(self, model: dict):
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "continuing_subword_prefix", "ignore_merges")):
            raise ValueError("only plain BPE models are supported")
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        size = self.size = max(vocab.values(), default=-1) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        parts = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        key = parts[:, 0] * size + parts[:, 1]
        order = np.argsort(key, kind="stable")
        order = order[np.concatenate([key[order][1:] != key[order][:-1], [True]])] if len(order) else order
        self.key, self.key_rank = key[order], order.astype(np.int64)
        self.pair_rank = {(a, b): (r, c) for r, (a, b, c) in enumerate(parts.tolist())}
        self.rank, self.left, self.right = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        made = np.arange(len(parts))
        self.rank[parts[:, 2]], self.left[parts[:, 2]], self.right[parts[:, 2]] = made, parts[:, 0], parts[:, 1]
        self._sound(parts)
        self._letters(vocab)

    def _sound(self, parts: np.ndarray) -> None:
        """Tokens that the merges make of their own letters. If two merges make one token, or a merge comes before one that it needs, none counts."""
        self.sound = np.ones(self.size, bool)
        ranks = np.arange(len(parts))
        if (self.rank[parts[:, 2]] != ranks).any() or (self.rank[parts[:, :2]].max(axis=1, initial=-1) >= ranks).any():
            self.sound[parts[:, 2]] = False
            return
        self.sound[parts[:, 2]] = ~self.clashing(parts[:, 0], parts[:, 1], whole=False)
        for a, b, c in parts.tolist():
            if not (self.sound[a] and self.sound[b]):
                self.sound[c] = False

    def _letters(self, vocab: dict[str, int]) -> None:
        """Dictionaries by letters: tokens inside a word, tokens that end one; single letters apart, for the exact way."""
        end = len(self.suffix)
        first: dict[str, int] = {}
        last: dict[str, int] = {}
        for text, i in vocab.items():
            if end and text.endswith(self.suffix) and len(text) > end:
                last[text[:-end]] = i
            else:
                first[text] = i
        if not end:
            last = first
        self.one_first = {t: i for t, i in first.items() if len(t) == 1}
        self.one_last = {t: i for t, i in last.items() if len(t) == 1}
        self.first = {t: i for t, i in first.items() if self.sound[i]}
        self.last = {t: i for t, i in last.items() if self.sound[i]}
        self.longest = max(map(len, last), default=0)
        #: Every beginning of a token inside a word, with the token that it is, or -1.
        self.begin = {t[:k]: -1 for t in self.first for k in range(1, len(t))} | self.first

    def clashing(self, a: np.ndarray, b: np.ndarray, whole: bool = True) -> np.ndarray:
        """For each pair of neighbours, whether a merge across the boundary comes before the merges that use its sides up.

        ``whole=False`` leaves out the merge of the two tokens themselves.
        """
        bad = np.zeros(len(a), bool)
        live, used_a, used_b = np.arange(len(a)), np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        while len(live):
            if whole and len(self.key):
                key = a * self.size + b
                at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                rank = np.where(self.key[at] == key, self.key_rank[at], _NEVER)
                # of equal merges the one further left is made first
                bad[live] = (rank < used_a) & (rank <= used_b) & (rank < _NEVER)
            whole = True
            rank_a, rank_b = self.rank[a], self.rank[b]
            open_a = rank_a > rank_b
            used_a, used_b = np.where(open_a, rank_a, used_a), np.where(open_a, used_b, rank_b)
            a, b = np.where(open_a, self.right[a], a), np.where(open_a, b, self.left[b])
            go = ~bad[live] & (np.maximum(rank_a, rank_b) >= 0)
            live, a, b, used_a, used_b = live[go], a[go], b[go], used_a[go], used_b[go]
        return bad

    def guess(self, word: str) -> list[int] | None:
        """The longest token that fits, again and again; None where none fits."""
        n, i, out, begin, last = len(word), 0, [], self.begin.get, self.last.get
        while i < n:
            if n - i <= self.longest and (t := last(word[i:])) is not None:
                out.append(t)
                return out
            found, end, j = -1, i, i + 1
            while j < n and (t := begin(word[i:j])) is not None:
                if t >= 0:
                    found, end = t, j
                j += 1
            if found < 0:
                return None
            out.append(found)
            i = end
        return out

    def exact(self, word: str) -> list[int]:
        """The merges one by one: lowest rank first, of equal ones the leftmost."""
        ids = [self.one_first.get(c) for c in word[:-1]] + [self.one_last.get(word[-1])]
        ids = [i for i in ids if i is not None]
        if len(ids) > SHORT:
            return self._exact_long(ids)
        rank, none = self.pair_rank.get, (_NEVER, -1)
        pairs = [rank(p, none) for p in zip(ids, ids[1:], strict=False)]
        while pairs:
            low = min(pairs)
            if low is none:
                break
            i = pairs.index(low)
            ids[i : i + 2] = [low[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = rank((ids[i], ids[i + 1]), none)
        return ids

    def _exact_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of merges over a linked list."""
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(*m, i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if (m := self.pair_rank.get(pair))]
        heapq.heapify(heap)
        while heap:
            _, made, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or self.pair_rank.get((ids[i], ids[j]), (0, -1))[1] != made:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                if m := self.pair_rank.get((made, ids[k])):
                    heapq.heappush(heap, (*m, i))
            if (k := before[i]) >= 0 and (m := self.pair_rank.get((ids[k], made))):
                heapq.heappush(heap, (*m, k))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word: all guessed, all neighbours checked at once, only words that fail merged."""
        found = list(map(self.guess, words))
        sizes = np.array([len(f) if f else 0 for f in found], np.int64)
        flat = np.fromiter(itertools.chain.from_iterable(f for f in found if f), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(words)), sizes)
        inner = word[1:] == word[:-1]
        pairs, which = np.unique(flat[:-1][inner] * self.size + flat[1:][inner], return_inverse=True)
        clash = self.clashing(pairs // max(self.size, 1), pairs % max(self.size, 1))
        again = set(word[1:][inner][clash[which]].tolist()) | {i for i, f in enumerate(found) if f is None}
        for i in again:
            found[i] = self.exact(words[i])
        self.failed = len(again)
        return found


def _word_pattern(steps: dict) -> regex.Pattern | None:
    """The file's word pattern, if a text of plain characters may be taken one white-space part at a time."""
    normal = [x["type"] for x in (steps.get("normalizer") or {}).get("normalizers", [])]
    split = (steps.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if normal != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in split] != ["Split", "ByteLevel"]:
        return None
    if not split[0]["invert"] or split[1]["add_prefix_space"] or split[1]["use_regex"]:
        return None
    return regex.compile(split[0]["pattern"]["Regex"])


class Codec:
    """Texts to ids and back; ``Tokenizer.encode(text, add_special_tokens=False).ids`` and ``decode(ids, skip_special_tokens=False)``."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        steps = json.loads(self.library.to_str())
        self.merges = Merges(steps["model"])
        self.pattern = _word_pattern(steps)
        added = self.library.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens must stand as they are")
        by_length = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.strings = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.joined = steps.get("decoder") is None
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    def _library_words(self, text: str) -> list[str]:
        """The words of a text by the library's own first steps."""
        normal, split = self.library.normalizer, self.library.pre_tokenizer
        text = normal.normalize_str(text) if normal else text
        return [w for w, _ in split.pre_tokenize_str(text) if w] if split else [text] if text else []

    def _runs(self, text: str) -> Iterable[tuple[bool, str]]:
        """(whether a special token, text) one after another."""
        if self.cut is None or not any(s in text for s in self.special):
            yield False, text
            return
        for k, run in enumerate(self.cut.split(text)):
            if run:
                yield k % 2 == 1, run

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        plans, fresh, words = [], {}, {}
        for text in texts:
            plan = []
            for special, run in self._runs(text or ""):
                if special:
                    plan.append(np.array([self.special[run]], "<u4").tobytes())
                elif self.pattern is not None and _PLAIN.fullmatch(run):
                    parts = run.lower().split()
                    ids = list(map(self.known.get, parts))
                    if None in ids:
                        fresh.update((p, None) for p, x in zip(parts, ids, strict=True) if x is None)
                        plan.append((parts, ids))
                    else:
                        plan.append(b"".join(ids))
                else:
                    letters = ["\0" + w for w in self._library_words(run)]
                    words.update(dict.fromkeys(letters))
                    plan.append(letters)
            plans.append(plan)
        inner = {p: self.pattern.findall(p) for p in fresh}
        words.update(dict.fromkeys(itertools.chain.from_iterable(inner.values())))
        self._encode_new(words)
        for p, found in inner.items():
            fresh[p] = b"".join([words[w] for w in found])
        out = [b"".join(map(functools.partial(self._spelled, words, fresh), plan)) for plan in plans]
        self._remember(fresh)
        return out

    @staticmethod
    def _spelled(words: dict[str, bytes], fresh: dict[str, bytes], step) -> bytes:
        if isinstance(step, bytes):
            return step
        if isinstance(step, list):
            return b"".join([words[w] for w in step])
        return b"".join([fresh[p] if x is None else x for p, x in zip(*step, strict=True)])

    def _encode_new(self, words: dict[str, bytes | None]) -> None:
        """Fill in the ids of the words; those after a zero are letters of the library's pre-tokenizer already."""
        letters = [w if w.isascii() and w[0] != "\0" else w[1:] if w[0] == "\0" else "".join([_BYTE_LETTERS[b] for b in w.encode()]) for w in words]
        found = self.merges.encode_words(letters)
        flat, at = np.fromiter(itertools.chain.from_iterable(found), "<u4").tobytes(), 0
        for w, ids in zip(words, found, strict=True):
            words[w] = flat[at : (at := at + 4 * len(ids))]

    def _remember(self, fresh: dict[str, bytes]) -> None:
        for p, ids in fresh.items():
            if len(p) <= LONG_PART:
                size = len(p) + len(ids) + ENTRY_BYTES
                if self.known_bytes + size > MEMORY:
                    self.known, self.known_bytes = {}, 0
                self.known[p] = ids
                self.known_bytes += size

    def decode(self, ids: bytes) -> str:
        found = np.frombuffer(ids, "<u4").tolist()
        if not self.joined:
            return self.library.decode(found, skip_special_tokens=False)
        try:
            return " ".join(map(self.strings.__getitem__, found))
        except KeyError:
            return " ".join([self.strings[i] for i in found if i in self.strings])


def _slices(batches: Iterable[pa.RecordBatch], size: int):
    """(keys, values) of rows in slices of about ``size`` bytes of values."""
    for batch in batches:
        values = batch.column(1)
        ends, a = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)), 0
        while a < len(values):
            b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")), a + 1)
            yield batch.column(0).slice(a, b - a), values.slice(a, b - a).to_pylist()
            a = b


def _applied(df: DataFrame, id_col: str, col: str, made: dict[str, T.DataType], step) -> DataFrame:
    """(id, what ``step`` makes of slices of the column) in one pass without a shuffle."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(c, t) for c, t in made.items())])

    def run(batches):
        work = step()
        for keys, values in _slices(batches, OUT_BYTES // 4):
            yield pa.RecordBatch.from_arrays([keys, *work(values)], names=schema.names)

    return df.select(F.col(id_col), F.col(col).alias(f"{col}_in")).mapInArrow(run, schema)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): each text's ids as little-endian unsigned 32-bit integers."""

    def step():
        codec = Codec(tokenizer)
        return lambda texts: [pa.array(codec.encode_batch(texts), pa.binary())]

    return _applied(docs, id_col, text_col, {"ids": T.BinaryType()}, step)


def decode(tokens: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the text of each row's ids."""

    def step():
        codec = Codec(tokenizer)
        return lambda rows: [pa.array([None if x is None else codec.decode(x) for x in rows], pa.string())]

    return _applied(tokens, id_col, ids_col, {"decoded": T.StringType()}, step)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) in one pass: ``encode``, then ``decode`` of its ids."""

    def step():
        codec = Codec(tokenizer)

        def work(texts):
            ids = codec.encode_batch(texts)
            return [pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.string())]

        return work

    return _applied(docs, id_col, text_col, {"ids": T.BinaryType(), "decoded": T.StringType()}, step)
