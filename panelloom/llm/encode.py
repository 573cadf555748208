"""Ids of a byte-level BPE tokenizer, for many texts at once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Distinct words that a process remembers, and how many stay when they are too many: those met in most batches.
MOST_WORDS, WORDS_STAY = 200_000, 100_000
#: Ids that a process remembers; with many long words these are too many before the words are.
MOST_IDS = 8_000_000
#: Bytes of text and texts that are cut into words at once.
AT_ONCE_BYTES, AT_ONCE_TEXTS = 2 << 20, 8192
#: Before the first word of a text, which no space precedes, and before one that begins a line. Texts that hold them are encoded whole.
FIRST, LINE = "\0", "\1"
#: How a byte-level vocabulary writes a space and a line break.
SPACE, BREAK = "Ġ", "Ċ"
#: Words of Latin letters that ASCII marks may follow, without an apostrophe: one or two pieces, wherever the library cuts.
LETTERS = "[A-Za-zÀ-ÖØ-öø-ʯ]+"
PLAIN, PLAIN_LINE = f"^{LETTERS}[!-&(-/:-@\\[-`{{-~]*$", f"^\x01{LETTERS}[!-&(-/:-@\\[-`{{-~]*$"
#: New words that go through the library as one text.
TOGETHER = 512

_encoders: dict[str, Encoder] = {}


def _kind(c: str) -> str:
    return "letter" if c.isascii() and c.isalpha() else "digit" if c.isascii() and c.isdigit() else "mark" if "!" <= c <= "~" else "other"


def _independent(tokens: list[str]) -> bool:
    """Whether no token but contractions lies across the pieces of a plain word, a space before it or a line break."""
    for token in tokens:
        own = token.removeprefix(SPACE)
        kinds = {_kind(c) for c in own}
        if SPACE in own and kinds & {"letter", "mark"}:
            return False
        if any(BREAK in (a, b) and (_kind(a) != "other" or _begins_latin(b)) for a, b in zip(own, own[1:], strict=False)):
            return False
        if "mark" in kinds and len(kinds) > 1 and "'" not in own:
            # Marks may only follow other bytes where these do not end a Latin letter, as in tokens of symbols and marks.
            if "letter" in kinds or any(_kind(a) == "other" and _kind(b) == "mark" and _ends_latin(own[: i + 1]) for i, (a, b) in enumerate(zip(own, own[1:], strict=False))):
                return False
    return True


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


_BYTES = _bytes_of()


def _ends_latin(token: str) -> bool:
    """Whether a letter of a plain word may end as the token does; a lone byte may end anything."""
    raw = bytes(_BYTES.get(c, 0) for c in token)
    if len(raw) == 1:
        return True
    try:
        return re.fullmatch(LETTERS, raw[-2:].decode()) is not None
    except UnicodeDecodeError:
        return False


def _begins_latin(c: str) -> bool:
    """Whether a byte may begin a plain word: an ASCII letter, or one of the bytes that lead letters from À to ʯ."""
    return _kind(c) in ("letter", "mark") or 0xC3 <= _BYTES.get(c, 0) <= 0xCA


class _Slots(dict):
    """Numbers words as they come and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Encodes with the tokenizers library, each distinct word once while it is remembered.

    Byte-level BPE cuts a text into pieces before it merges, and merges within pieces. A single space between
    two other characters always begins a piece, and a single line break is one, so there the text can be cut and the
    ids of the parts joined. Plain words go through the library without its own cutting, which gives the same ids, as the
    vocabulary has no token across their pieces (checked when it is loaded). Texts with other white space or a special
    token, and tokenizers of another kind, go through the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.by_word = (
            spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        )
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        n = max(vocabulary.values()) + 1
        self.begins = {mark: np.zeros(n, bool) for mark in (SPACE, BREAK)}
        for mark, begins in self.begins.items():
            begins[[i for token, i in vocabulary.items() if token.startswith(mark)]] = True
        self.uncut = None
        if self.by_word and _independent([t for t in vocabulary if t not in self.special]):
            self.uncut = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": pre | {"use_regex": False}}))
        self.learnt = 0
        self._clear()

    def _clear(self):
        self.slots, self.used = _Slots(), 0
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts, self.lens, self.met = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.whole = np.empty(0, bool)

    def _forget(self):
        """Keeps the words met in most batches, the first of equals."""
        stay = np.sort(np.argsort(-self.met, kind="stable")[:WORDS_STAY])
        while len(stay) > 1 and self.lens[stay].sum() > MOST_IDS // 2:
            stay = stay[: len(stay) // 2]
        marked = np.zeros(len(self.met), bool)
        marked[stay] = True
        slots = _Slots()
        slots.update(zip((w for w, m in zip(self.slots, marked.tolist(), strict=True) if m), range(len(stay)), strict=True))
        lens = self.lens[stay]
        flat = self._gather(self.starts[stay], lens)
        self.slots, self.flat, self.used = slots, flat, len(flat)
        self.lens, self.starts = lens, np.cumsum(lens) - lens
        self.met, self.whole = self.met[stay] // 2, self.whole[stay]

    def _gather(self, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        ends = np.cumsum(lens)
        if not len(ends) or not ends[-1]:
            return np.empty(0, np.uint32)
        return self.flat[np.repeat(starts - ends + lens, lens) + np.arange(ends[-1])]

    def _together(self, tokenizer: Tokenizer, words: list[str], mark: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and lengths of words, many in one text, cut where a token begins with the mark, as only the first of a word does."""
        before = " " if mark == SPACE else "\n"
        texts = [before + before.join(words[low : low + TOGETHER]) for low in range(0, len(words), TOGETHER)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        starts = np.flatnonzero(self.begins[mark][ids])
        if len(starts) != len(words):
            return None
        return ids, np.diff(np.append(starts, len(ids)))

    def _learn(self):
        new, n = self.slots.new, len(self.slots.new)
        self.learnt += n
        whole = np.zeros(n, bool)
        lens, begin = np.zeros(n, np.int64), np.zeros(n, np.int64)
        parts, total = [], 0
        words = pa.array(new, pa.large_string())
        is_plain, is_line = (
            (pc.match_substring_regex(words, p).to_numpy(zero_copy_only=False) if self.uncut is not None else np.zeros(n, bool)) for p in (PLAIN, PLAIN_LINE)
        )
        others = np.flatnonzero(~(is_plain | is_line)).tolist()
        groups = []
        for which, mark in ((is_plain, SPACE), (is_line, BREAK)):
            at = np.flatnonzero(which)
            own = words.take(pa.array(at)) if mark == SPACE else pc.utf8_slice_codeunits(words.take(pa.array(at)), 1)
            groups.append((at, mark, own.to_numpy(zero_copy_only=False).tolist()))
        for at, mark, own_words in groups:
            if not len(at):
                continue
            got = self._together(self.uncut, own_words, mark)
            if got is None:
                others += at.tolist()
                continue
            ids, own = got
            lens[at], begin[at] = own, total + np.cumsum(own) - own
            parts.append(ids)
            total += len(ids)
        texts, at = [], []
        for i in others:
            w = new[i]
            first, body = w[:1] == FIRST, w.lstrip(FIRST + LINE)
            # White space beside a space, a line break beside white space or at an end: the library may cut otherwise.
            lone = w in (FIRST, FIRST + LINE, LINE) or not body
            if lone or body[0].isspace() or body[-1].isspace() or w.rfind(LINE) > (1 if first else 0):
                whole[i] = True
                continue
            texts.append((" " if w[0] != FIRST and w[0] != LINE else "\n" if LINE in w[:2] else "") + body)
            at.append(i)
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        for i, e in zip(at, encoded, strict=True):
            ids = np.array(e.ids, np.uint32)
            lens[i], begin[i] = len(ids), total
            parts.append(ids)
            total += len(ids)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(self.used, total) + total, np.uint32)])
        if total:
            self.flat[self.used : self.used + total] = np.concatenate(parts)
        self.starts = np.concatenate([self.starts, self.used + begin])
        self.lens = np.concatenate([self.lens, lens])
        self.met = np.concatenate([self.met, np.zeros(n, np.int32)])
        self.whole = np.concatenate([self.whole, whole])
        self.used += total
        self.slots.new = []

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, without special tokens, and where each text's begin (one more entry than texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not self.by_word:
            own = [self._whole(t) for t in texts.to_pylist()]
            return np.concatenate([np.empty(0, np.uint32), *own]), np.cumsum([0, *map(len, own)])
        if len(self.slots) > MOST_WORDS or self.used > MOST_IDS:
            self._forget()
        odd = pc.match_substring(texts, FIRST)
        for part in (LINE, *self.special):
            odd = pc.or_(odd, pc.match_substring(texts, part))
        odd = odd.to_numpy(zero_copy_only=False) if n else np.zeros(0, bool)
        cut = pc.replace_substring(texts, "\n", " " + LINE)
        cut = pc.binary_join_element_wise(pa.scalar(FIRST, pa.large_string()), cut, pa.scalar("", pa.large_string()))
        words = pc.split_pattern(cut, " ")
        bounds = words.offsets.to_numpy().astype(np.int64)
        coded = words.values.slice(int(bounds[0]), int(bounds[-1] - bounds[0])).dictionary_encode() if n else None
        bounds -= bounds[0] if n else 0
        if n:
            slots = np.fromiter(map(self.slots.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(coded.dictionary))
            if self.slots.new:
                self._learn()
            self.met[slots] += 1
            slots = slots[coded.indices.to_numpy()]
        else:
            slots = np.empty(0, np.int64)
        lens = self.lens[slots]
        ends = np.append(0, np.cumsum(lens))[bounds]
        flat = self._gather(self.starts[slots], lens)
        # An empty text is the mark alone, and has no ids.
        odd |= np.append(0, np.cumsum(self.whole[slots]))[bounds[1:]] > np.append(0, np.cumsum(self.whole[slots]))[bounds[:-1]] if n else odd
        redo = np.flatnonzero(odd)
        if not len(redo):
            return flat, ends
        parts, at, counts = [], 0, np.diff(ends)
        for i in redo.tolist():
            parts += [flat[at : ends[i]], own := self._whole(texts[i].as_py())]
            counts[i], at = len(own), ends[i + 1]
        return np.concatenate([*parts, flat[at:]]), np.append(0, np.cumsum(counts))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text without special tokens, as unsigned 32-bit integers; null counts as empty."""
        out: list[np.ndarray] = []
        for some in slices(pa.array([t or "" for t in texts], pa.large_string())):
            flat, ends = self.encode_flat(some)
            out += np.split(flat, ends[1:-1])
        return out


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """A column of texts in runs of bounded bytes and length; a very long text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, low = np.cumsum(sizes), 0
    while low < len(texts):
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + AT_ONCE_BYTES, side="right")))
        high = min(high, low + AT_ONCE_TEXTS)
        yield texts.slice(low, high - low)
        pa.default_memory_pool().release_unused()  # what cutting a run took goes back before the next
        low = high


def encoder(path: str) -> Encoder:
    """One for each process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
