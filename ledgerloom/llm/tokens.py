"""Token ids of whole texts by a public tokenizer, each distinct piece encoded once per worker while it is in use."""

from __future__ import annotations

import os
import re
from array import array

WORD_BPE, BYTE_BPE, PIECE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"
END_ID = 1
MAX_CACHED = 250_000  # pieces of either generation

#: Blanks where this tokenizer family ends a piece, as in Unicode's White_Space.
_BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters whose run surely ends where an ASCII sign or blank follows, so that a word is one piece with or without its comma.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]++(?=[\t-\r -/:-@\\[-`{-~]|\\Z)"
_SPACED = re.compile(f" ?{_LETTERS}| ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
_UNSPACED = re.compile(f"{_LETTERS}|[^\t\n\x0b\x0c\r ]+")
_WIDE = re.compile("[^\x00-\xff]")


class Encoder:
    """Ids as little-endian 32-bit integers. Both vocabularies split a text at blanks before they merge bytes, so a text's
    ids are those of its blank-separated pieces in order; a piece keeps the blank before it where the vocabulary does.
    With ``added`` the vocabulary's added tokens ('<|endoftext|>') get their own ids where a text holds them, as by the
    library's default; else they are text like any other."""

    def __init__(self, path: str, cached: int = MAX_CACHED, added: bool = False):
        self.path, self.cached = path, cached
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        ids = [x.ids for x in self.tokenizer.encode_batch(["a b", "a", "b"], add_special_tokens=False)]
        drops_blanks = ids[0] == ids[1] + ids[2]
        lowers = self.tokenizer.encode("\u00c9A", add_special_tokens=False).ids == self.tokenizer.encode("\u00e9a", add_special_tokens=False).ids
        self.pieces, self.lowers = (_UNSPACED if drops_blanks else _SPACED).findall, lowers
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        tokens = self.tokenizer.get_added_tokens_decoder() if added else {}
        if odd := [t.content for t in tokens.values() if t.lstrip or t.rstrip or t.single_word or t.normalized]:
            raise ValueError(f"added tokens that take in more than their own text: {odd}")
        self.added = {t.content: array("I", [i]).tobytes() for i, t in tokens.items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None

    def parts(self, text: str) -> list[str]:
        """The pieces whose ids in order are those of the text; an added token is a piece of its own."""
        if self.marks and self.marks.search(text):
            return [x for k, p in enumerate(self.marks.split(text)) for x in ([p] if k % 2 else self.pieces(p))]
        return self.pieces(text)

    def untouched(self):
        """The library's tokenizer as its file has it, without truncation and padding."""
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def __call__(self, text: str) -> bytes:
        if self.marks and self.marks.search(text):
            return b"".join(self.added[p] if k % 2 else self.plain(p) for k, p in enumerate(self.marks.split(text)))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if self.lowers and not _WIDE.search(text):  # as the vocabulary does; beyond these letters it is left to it
            text = text.lower()
        parts = self.pieces(text)
        try:
            return b"".join(map(self.known.__getitem__, parts))
        except KeyError:
            self._learn(parts)
            return b"".join(map(self.known.__getitem__, parts))

    def _learn(self, parts: list[str]) -> None:
        """Puts pieces that are not known among those that are."""
        known, fresh = self.known, set(parts).difference(self.known)
        if len(known) + len(fresh) > self.cached:
            self.older, self.known = known, {}
            known, fresh = self.known, set(parts)
        older, new = self.older, []
        for piece in fresh:
            if (ids := older.get(piece)) is None:
                new.append(piece)
            else:
                known[piece] = ids
        for piece, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            known[piece] = array("I", found.ids).tobytes()


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, cached: int = MAX_CACHED, added: bool = False) -> Encoder:
    """One encoder per worker process, file and treatment of added tokens, kept from task to task."""
    if (path, added) not in _ENCODERS:
        _ENCODERS[path, added] = Encoder(path, cached, added)
    return _ENCODERS[path, added]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
