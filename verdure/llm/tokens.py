"""Token ids of whole texts by a tokenizer file, each distinct word encoded once per worker."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from operator import attrgetter
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct words, and distinct pieces of them, kept by a worker, and ids of either; then it starts afresh.
MEMO_WORDS, MEMO_IDS = 1 << 19, 1 << 22
_CUT_IN_SPACE = re.compile(r"\s \s|  ")
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: visible ones for themselves, the others numbered from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in seen} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in seen)}


_LETTERS = byte_letters()
#: A normaliser that does to words in a row what it does to each, and makes any white space between them one space.
_BY_WORD = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_ID = attrgetter("id")


class _Memo:
    """Lists of ids by code."""

    def __init__(self, dtype):
        self.next, self.new = 0, []
        self.start, self.length, self.ids, self.n_ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, dtype), 0

    def full(self) -> bool:
        return self.next > MEMO_WORDS or self.n_ids > MEMO_IDS

    def store(self, code: int, lens: list[int] | np.ndarray, ids: list[int] | np.ndarray) -> None:
        n, total = len(lens), len(ids)
        if code + n > len(self.start):
            more = max(len(self.start), n)
            self.start, self.length = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.start, self.length))
        if self.n_ids + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), self.ids.dtype)])
        sizes = np.asarray(lens, np.int64)
        self.length[code : code + n] = sizes
        self.start[code : code + n] = self.n_ids + np.cumsum(sizes) - sizes
        self.ids[self.n_ids : self.n_ids + total] = ids
        self.n_ids += total

    def fill(self, encode: Callable[[list[str]], tuple]) -> None:
        """Store the lists of the words that wait; encode gives (number of ids of each, the ids of all)."""
        if self.new:
            self.store(self.next - len(self.new), *encode(self.new))
            self.new = []

    def joined(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of these lists one after the other, the number of ids in each group of so many lists)."""
        lens = self.length[codes]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[codes] - (ends - lens), lens) + np.arange(total)
        return self.ids[at], np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])


class _Codes(dict):
    """word -> code; a new word gets the memo's next code and waits in its `new`, with what stands before it, to be encoded."""

    def __init__(self, memo: _Memo, before: str = ""):
        self.memo, self.before = memo, before

    def __missing__(self, word):
        code = self[word] = self.memo.next
        self.memo.next += 1
        self.memo.new.append(self.before + word)
        return code


class WordTokenizer:
    """Encodes as the tokenizers library's encode does with add_special_tokens=False.

    Both kinds of tokenizer here never join what stands on the two sides of a space, so a text's ids are
    those of its words one after the other. `lead`: the space belongs to the next word (byte-level BPE); a
    text where that isn't sure (a space beside other white space) is encoded whole. `word`: white space is
    dropped. Any other tokenizer, and a text that holds a special token's string, is encoded whole. A new
    word is normalised and merged by the library's own normaliser and model; the cut between them is the file's pattern.
    Where white space is dropped, new words are normalised and cut together, and a piece that stands in many words (with
    capitals, commas) is merged once.
    """

    def __init__(self, path: str, plain: bool = False):
        """plain: a special token's string in a text is plain text."""
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.kind = "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            import public_tokenizers

            self.kind, pattern = "lead", public_tokenizers.PATTERN
        elif pre.get("type") == "Sequence" and model.get("end_of_word_suffix") and pre["pretokenizers"][0].get("behavior") == "Removed" and spec.get("normalizer") == _BY_WORD:
            self.kind, pattern = "word", pre["pretokenizers"][0]["pattern"]["Regex"] + "|\n"
        self.pattern = regex.compile(pattern) if self.kind != "whole" else None
        self.special = [] if plain else [a["content"] for a in spec.get("added_tokens") or []]
        self.tok.encode_special_tokens = plain
        self.normal, self.model = self.tok.normalizer, self.tok.model
        self.vocab_size = self.tok.get_vocab_size()
        self.dtype = np.uint16 if self.vocab_size <= 1 << 16 else np.uint32
        self.clear()
        self.clear_pieces()

    def clear(self) -> None:
        self.words = _Memo(self.dtype)
        self.first, self.rest = _Codes(self.words), _Codes(self.words, " " if self.kind == "lead" else "")

    def clear_pieces(self) -> None:
        self.pieces = _Memo(self.dtype)
        self.piece = _Codes(self.pieces)

    def _whole(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """(number of ids of each text, the ids of all), by the library's plain call."""
        each = [x.ids for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return [len(x) for x in each], [i for x in each for i in x]

    def _merged(self, words: list[str]) -> tuple[list[int], list[int]]:
        """The same of words (with the space before, if they have one), each cut by itself, or of pieces."""
        lens, ids, merge = [], [], self.model.tokenize
        cut = self.pattern.findall if self.kind == "lead" else lambda w: [w] if w else []
        for w in words:
            plain = w.isascii() and w.isprintable()
            before = len(ids)
            for x in cut(w):
                ids.extend(map(_ID, merge(x.replace(" ", "\u0120") if plain else x.encode().decode("latin-1").translate(_LETTERS))))
            lens.append(len(ids) - before)
        return lens, ids

    def _pieced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words without white space, cut all at once between line ends."""
        if self.pieces.full():
            self.clear_pieces()
        plain = [w.isascii() and w.isprintable() for w in words]
        others = iter(self.normal.normalize_str("\n".join([w for w, p in zip(words, plain, strict=True) if not p])).split(" "))
        end = self.piece["\n"]
        parts = self.pattern.findall("".join([(w.lower() if p else next(others)) + "\n" for w, p in zip(words, plain, strict=True)]))
        codes = np.fromiter(map(self.piece.__getitem__, parts), np.int64, len(parts))
        self.pieces.fill(self._merged)
        ends = np.flatnonzero(codes == end)
        ids, lens = self.pieces.joined(np.delete(codes, ends), np.diff(ends, prepend=-1) - 1)
        return lens, ids

    def _words(self, words: list[str]) -> tuple[list[int] | np.ndarray, list[int] | np.ndarray]:
        """The same of words. Of characters that Python's tables don't have, the pattern's letters may be others than the library's: it encodes such words itself."""
        unsure = [k for k, w in enumerate(words) if not w.isprintable() and any(category(c) == "Cn" for c in w)]
        near = self._pieced if self.kind == "word" else self._merged
        if not unsure:
            return near(words)
        apart = set(unsure)
        lens, ids = near([w if k not in apart else "" for k, w in enumerate(words)])
        each = np.split(np.asarray(ids, self.dtype), np.cumsum(lens)[:-1])
        for k in unsure:
            each[k] = np.array(self._whole([words[k]])[1], self.dtype)
        return list(map(len, each)), np.concatenate(each)

    def _cut_by_space(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the codes of the words of all texts, the number of each text's words). Words that occur again in these texts are told by Arrow,
        so that each is looked up once; an empty text is one empty word."""
        lists = pc.utf8_split_whitespace(pa.array([t.lower() if t.isascii() else t for t in texts], pa.large_string()))
        words = lists.flatten().dictionary_encode()
        codes = np.fromiter(map(self.rest.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(words.dictionary))
        return codes[words.indices.to_numpy()], lists.value_lengths().to_numpy()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, the number of each text's ids)."""
        if self.words.full():
            self.clear()
        memo = self.words
        odd = _CUT_IN_SPACE if self.kind == "lead" else _ODD_SPACE
        whole = [k for k, t in enumerate(texts) if self.kind == "whole" or any(x in t for x in self.special) or odd.search(t)]
        apart = set(whole)
        rest = [t if k not in apart else "" for k, t in enumerate(texts)]
        if self.kind == "word":
            codes, counts = self._cut_by_space(rest)
            heads = np.cumsum(counts) - counts
        else:
            parts = [t.split(" ") for t in rest]
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
            heads = np.cumsum(counts) - counts
            words = [w for p in parts for w in p]
            codes = np.fromiter(map(self.rest.__getitem__, words), np.int64, len(words))
            codes[heads] = [self.first[p[0]] for p in parts]
        memo.fill(self._words)
        if whole:
            base = memo.next
            memo.next += len(whole)
            memo.store(base, *self._whole([texts[k] for k in whole]))
            codes[heads[whole]] = np.arange(base, base + len(whole))
        return memo.joined(codes, counts)


_LOADED: dict[tuple, WordTokenizer] = {}


def tokenizer(path: str, plain: bool = False) -> WordTokenizer:
    """One of a kind a worker process."""
    if (path, plain) not in _LOADED:
        _LOADED[path, plain] = WordTokenizer(path, plain)
    return _LOADED[path, plain]


def public_path(name: str) -> str:
    """Where this machine keeps a public tokenizer file (executors resolve it by themselves)."""
    import public_tokenizers

    return public_tokenizers.path(name)
