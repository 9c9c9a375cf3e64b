"""Token ids of whole texts by a public byte-level BPE vocabulary (a `tokenizers` JSON file).

Texts are cut at single spaces and line ends between characters that are no white space; byte-level BPE
never joins across such a cut, so encoding the pieces and joining them gives the ids of the whole. Pieces
recur, so their ids are kept in a bounded cache. A piece that isn't there is encoded by `tiktoken` with
the ranks taken from the same file, which is several times faster for short strings; a file whose ids
aren't ranks of merges, and every text with other white space or special tokens, goes through `tokenizers`
in one go. `tests/llm` compares both ways.
"""

from __future__ import annotations

import json
import zlib

import numpy as np

#: Added after each document.
END_ID = 1

#: Unicode white space other than the space and the line end.
_OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
#: Fixed pattern of byte-level BPE pre-tokens.
_PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CACHE_PIECES = 200_000
_encoders: dict[str, Encoder] = {}


def default_vocabulary() -> str:
    """Where the public vocabulary lies; callers may pass another path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The visible characters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _fast(path: str):
    """A piece encoder with the file's own ranks, or None if its ids aren't in the order of its merges."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        return None
    special = {x["content"] for x in spec.get("added_tokens", [])}
    chars, vocab = _byte_of_char(), model["vocab"]
    order = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if order != sorted(order):
        return None
    ranks = {bytes(chars[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("pieces", pat_str=_PRETOKEN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids. One per Python worker and vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        fast = _fast(path)
        self.piece = (lambda x: fast.encode_ordinary(x)) if fast else (lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids)
        self.cache: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """Ids of a text that is encoded in one go."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _odd(self, text: str) -> bool:
        return (
            text[0].isspace()
            or text[-1].isspace()
            or "\0" in text
            or any(x in text for x in ("  ", " \n", "\n ", "\n\n", *self.special))
            or any(x in text for x in (_OTHER_SPACE[:8] if text.isascii() else _OTHER_SPACE))
        )

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text; null counts as empty."""
        if not text:
            return b""
        if self._odd(text):
            return self.whole(text)
        pieces = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        cache = self.cache
        try:
            return b"".join([cache[p] for p in pieces])
        except KeyError:
            wanted = set(pieces)
            if len(cache) + len(wanted) > _CACHE_PIECES:
                cache.clear()
            for p in wanted:
                if p not in cache:
                    ids = self.piece(p)
                    cache[p] = b"".join([x.to_bytes(4, "little") for x in ids])
            return b"".join([cache[p] for p in pieces])


def encoder(path: str) -> Encoder:
    """The encoder of this Python process for a vocabulary file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
