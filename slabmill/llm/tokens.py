"""Encoding whole texts with a public tokenizer, remembering the ids of words already seen."""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np

BYTE_LEVEL = "byte_level"
WHITESPACE = "whitespace"

_CHUNK = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
# White space, format and control characters outside ASCII white space: near them a cut may fall inside a token.
_UNUSUAL = re.compile(
    rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf"
)
_UNUSUAL_BEGINS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe1\xa0", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80", b"\xef\xbb")
_NOT_PLAIN = (b"  ", b"\n\n", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c")
_MARK = "\x00"
# What may stand before a word, a word of letters that no normaliser changes but for their case, and the signs after it, which are a token's border.
_PARTS = re.compile(rb"([\n\x00]?)((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")
#: Text bytes cut into chunks at once where memory is short: the short strings of 4 MB take about 45 MB more.
CUT_BYTES = 1 << 20
#: Bytes of remembered chunks in each of two generations.
REMEMBERED_BYTES = 48 << 20
_ENTRY_BYTES = 200  # of a dictionary entry with two short strings


def _byte_alphabet() -> dict[int, int]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in shown)}


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without Python's cycle collector, which would go through the millions of short strings again and again; none of them is in a cycle."""
    running = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if running:
            gc.enable()


class ChunkEncoder:
    """Encodes texts chunk by chunk, each distinct chunk once.

    ``byte_level``: a chunk is a run of white space with the word after it. A byte-level pre-tokenizer always starts a
    token at white space that follows a word and never looks back, so joining the chunks' ids gives the ids of the
    whole text. Texts with unusual white space are encoded whole.
    ``whitespace``: for tokenizers that drop white space, a chunk is a word.
    Signs after a chunk's letters or its last digit (a full stop, say) never share a token with what is before them, in both kinds.
    Strings that look like special tokens are ordinary text. Ids come as little-endian unsigned integers.

    A new chunk that is one word of Latin letters goes straight to the tokenizer's model, where a trial shows that this
    gives what the whole tokenizer gives; other new chunks are encoded in long joined texts. Ids are remembered in two
    generations of at most ``REMEMBERED_BYTES`` each: a chunk lives on while it is met again within a generation.
    """

    def __init__(self, path: str, kind: str, dtype: str = "<u4", remember: int = REMEMBERED_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._kind, self._dtype, self._remember = kind, np.dtype(dtype), remember
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}
        self._held = 0
        self._mark = self._ids(_MARK)[-1]
        # The mark parts chunks in one long text where no longer token holds its character.
        shown = self._tokenizer.id_to_token(self._mark).removesuffix("</w>")
        self._parted = self._ids(f"a {_MARK} b").count(self._mark) == 1 and not any(
            shown in t and t.removesuffix("</w>") != shown for t in self._tokenizer.get_vocab()
        )
        self._lower = kind == WHITESPACE and self._ids("A") == self._ids("a")
        self._model, self._code, self._alphabet = self._tokenizer.model, {2: "H", 4: "I"}[self._dtype.itemsize], _byte_alphabet() | {10: 10}
        trial = ["a", "Word", "schönes", "ÀÉÿ", "informationally", "xqzjkvwpy"]
        self._direct = self._words([w.encode() for w in trial]) == [self._packed(self._ids(self._chunk(w.encode()).decode())) for w in trial]

    def _ids(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self._dtype).tobytes()

    def _encode_each(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk; many chunks are encoded as one text, with marks between them."""
        if not self._parted:
            return [self._packed(e.ids) for e in self._tokenizer.encode_batch([c.decode() for c in chunks], add_special_tokens=False)]
        between = f" {_MARK} " if self._kind == WHITESPACE else _MARK
        out = []
        for start in range(0, len(chunks), 512):
            some = chunks[start : start + 512]
            found = np.array(self._ids(between.join(c.decode() for c in some)), self._dtype)
            ids, cuts, width = found.tobytes(), np.flatnonzero(found == self._mark) * self._dtype.itemsize, self._dtype.itemsize
            out += [ids[a:b] for a, b in zip([0, *(cuts + width).tolist()], [*cuts.tolist(), len(ids)], strict=True)]
        return out

    def _words(self, words: list[bytes], spaced: bool = True) -> list[bytes]:
        """Ids of words of letters from the model alone, which works on the byte alphabet's characters; ``spaced``: after a space, at byte level."""
        if not words:
            return []
        text = b"\n".join(words)
        if not text.isascii():
            text = (text.decode().lower().encode() if self._lower else text).decode("latin-1").translate(self._alphabet)
        else:
            text = text.decode()
        shown, code, tokenize = text.split("\n"), self._code, self._model.tokenize
        if spaced and self._kind == BYTE_LEVEL:
            shown = ["Ġ" + x for x in shown]
        return [array(code, [t.id for t in tokenize(x)]).tobytes() for x in shown]

    def _chunk(self, key: bytes) -> bytes:
        """The chunk that a key stands for: after the mark the chunk itself, else a word with its line feed or space."""
        if key[:1] == b"\x00":
            return key[1:]
        return key if self._kind == WHITESPACE or key[:1] == b"\n" else b" " + key

    def _learn(self, keys: set[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that are not known yet."""
        ids, known = {}, self._known
        if self._direct:
            words = [k for k in keys if k.isalpha()]
            ids |= zip(words, self._words(words), strict=True)
            parts = {k: m.groups() for k in keys.difference(words) if (m := _PARTS.fullmatch(k)) and (self._kind == BYTE_LEVEL or not m[1])}
            spaced = list({core for head, core, _ in parts.values() if not head}.difference(known, ids))
            ids |= zip(spaced, self._words(spaced), strict=True)
            bare = list({core for head, core, _ in parts.values() if head})
            begun = dict(zip(bare, self._words(bare, spaced=False), strict=True))
            around = {x: self._packed(self._ids(x.decode())) if x != b"\x00" else b"" for x in {x for head, _, tail in parts.values() for x in (head, tail)}}
            for k, (head, core, tail) in parts.items():
                ids[k] = around[head] + (begun[core] if head else ids[core] if core in ids else known[core]) + around[tail]
            keys = keys.difference(ids)
        ends = {k: k[-1:] for k in keys if k[-1:] in b".,;:!?" and k[-2:-1].isalnum()}
        cores = {k[:-1] if k in ends else k for k in keys}.difference(known, ids)
        chunks = {k: self._chunk(k) for k in cores}
        whole = [k for k, c in chunks.items() if b"\x00" in c or c[-1:].isspace() or (not c.isascii() and _UNUSUAL.search(c))]
        plain = list(chunks.keys() - set(whole))
        ids |= zip(plain, self._encode_each([chunks[k] for k in plain]), strict=True)
        ids |= {k: self._packed(self._ids(chunks[k].decode())) for k in whole}
        stops = {e: self._packed(self._ids(e.decode())) for e in set(ends.values())}
        for k, end in ends.items():
            core = k[:-1]
            ids[k] = (known[core] if core in known else ids[core]) + stops[end]
        return ids

    def _keys(self, text: bytes) -> list[bytes]:
        if self._kind == WHITESPACE:
            keys = (text.lower() if self._lower else text).split()
            return [b"\x00" + k if k[:1] == b"\x00" else k for k in keys] if b"\x00" in text else keys
        if any(x in text for x in _UNUSUAL_BEGINS) and _UNUSUAL.search(text):
            return [b"\x00" + text]
        if b"\x00" in text or any(x in text for x in _NOT_PLAIN) or text[:1] in b" \n" or text[-1:] in b" \n":
            return [b"\x00" + c for c in _CHUNK.findall(text)]
        keys = text.replace(b"\n", b" \n").split(b" ")
        keys[0] = b"\x00" + keys[0]
        return keys

    def _found(self, texts: list[bytes]) -> Iterator[Iterator[bytes]]:
        """The ids of each text's chunks, one text after another."""
        parts = [self._keys(t) for t in texts]
        known, older = self._known, self._older
        new = set().union(*parts).difference(known)
        if again := older.keys() & new:  # goes through the new ones, not all that is remembered
            known |= {k: older[k] for k in again}
            self._held += sum(len(k) + len(known[k]) + _ENTRY_BYTES for k in again)
            new -= again
        if new:
            ids = self._learn(new)
            known |= ids
            self._held += sum(map(len, ids)) + sum(map(len, ids.values())) + _ENTRY_BYTES * len(ids)
        find = known.__getitem__
        for part in parts:
            yield map(find, part)
        if self._held > self._remember:
            self._older, self._known, self._held = known, {}, 0

    def encode(self, texts: list[bytes]) -> list[bytes]:
        with _uncollected():
            return [b"".join(ids) for ids in self._found(texts)]

    def count(self, texts: list[bytes]) -> list[int]:
        """Numbers of ids of the texts."""
        width = self._dtype.itemsize
        with _uncollected():
            return [sum(map(len, ids)) // width for ids in self._found(texts)]


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, kind: str, dtype: str = "<u4", remember: int = REMEMBERED_BYTES) -> ChunkEncoder:
    """One encoder a Python worker; later tasks of the worker go on with its memory."""
    key = (path, kind, dtype, remember)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(*key)
    return _ENCODERS[key]


def forget_encoders() -> None:
    """Free what earlier tasks of this Python worker remember, for operators that need the room for a model of their own."""
    _ENCODERS.clear()


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
