"""Byte-level BPE ids of whole texts, from a public vocabulary file.

The vocabulary's own pattern always cuts before a blank that stands between two
other characters than white space. So each such part of a text can be encoded by
itself, and looked up if it was seen before. A text with other white space
around a blank is encoded as a whole.
"""

from __future__ import annotations

import json
from array import array

_loaded: dict[tuple[str, bool], "ByteBPE"] = {}


def byte_of_symbol() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteBPE:
    """``encode`` returns the ids as packed little-endian 32-bit integers.

    With ``special`` the file's special strings inside a text become their ids,
    as the tokenizer library does by default; without, they are ordinary text.
    At most ``cache`` parts are remembered.
    """

    def __init__(self, path: str, special: bool = True, cache: int = 400_000):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_byte = byte_of_symbol()
        ranks = {bytes(to_byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in added}
        self._coder = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.n_vocab = 1 + max(max(ranks.values()), max(added.values(), default=0))
        self.special_ids = added
        self._special = tuple(added) if special else ()
        self._seen: dict[str, bytes] = {}
        self._most = cache

    def _new(self, part: str) -> bytes | None:
        """Ids of a part and the blank before it; None if it can't stand alone."""
        if not part or part[0].isspace() or part[-1].isspace():
            return None
        ids = array("I", self._coder.encode_ordinary(" " + part)).tobytes()
        if len(part) <= 64:
            if len(self._seen) >= self._most:
                self._seen.clear()
            self._seen[part] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self._special):
            return array("I", self._coder.encode(text, allowed_special="all")).tobytes()
        first, *parts = text.split(" ")
        if first and not first[-1].isspace():
            get, new = self._seen.get, self._new
            ids = [get(p) or new(p) for p in parts]
            if None not in ids:
                return array("I", self._coder.encode_ordinary(first)).tobytes() + b"".join(ids)
        return array("I", self._coder.encode_ordinary(text)).tobytes()


def load(path: str, special: bool = True) -> ByteBPE:
    """One per worker process and file."""
    if (path, special) not in _loaded:
        _loaded[path, special] = ByteBPE(path, special)
    return _loaded[path, special]
