"""Token ids of whole texts by a public tokenizer, with a memo of chunks for each worker.

A tokenizer's pieces never cross white space, so a text's ids are the ids of
its space-separated chunks, joined; each worker encodes a distinct chunk once
and keeps it in a bounded memo. A text with anything that the cut does not
cover exactly (other white space, runs of it, a token of the vocabulary's
added list) is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space besides space and newline, and characters that some classes count as such.
ODD = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]")
#: Chunks that a worker's memo holds at most before it starts afresh (about 200 bytes each).
MEMO = 1_200_000


class Encoder:
    """``encode(texts)`` gives one little-endian unsigned 16-bit (32-bit for large vocabularies) id string a text."""

    def __init__(self, path: str, most: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens", ())]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65536 else 4
        pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        spaced = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not normal
        dropped = pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in pre["pretokenizers"][0]["pattern"].get("Regex", "")
        self.kind = "spaced" if spaced else "dropped" if dropped else "whole"
        self.memo: dict[str, bytes | None] = {}
        self.most = most

    def _ids(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.width == 2 else "I"
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, missing: list[str]) -> None:
        if len(self.memo) + len(missing) > self.most:
            self.memo.clear()
        if self.kind == "dropped":
            self.memo.update(zip(missing, self._ids(missing), strict=True))
            return
        # "\0" marks a text's first chunk, which no space precedes; "\n" starts its own piece.
        sound = [c for c in missing if c not in ("", "\0", "\n") and not ODD.search(c)]
        self.memo.update(dict.fromkeys(missing))
        self.memo.update(zip(sound, self._ids([c[1:] if c[0] == "\0" else c if c[0] == "\n" else " " + c for c in sound]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.kind == "whole":
            return self._ids(texts)
        first = "\0" if self.kind == "spaced" else ""
        cut = [(first + t).replace("\n", " \n").split(" ") if t and "\0" not in t and not self.added.search(t) else [] for t in texts]
        missing = list(set().union(*cut).difference(self.memo))
        if len(self.memo) + len(missing) > self.most:
            missing = list(set().union(*cut))
        if missing:
            self._learn(missing)
        out: list[bytes | None] = []
        for text, chunks in zip(texts, cut, strict=True):
            try:
                out.append(b"".join(map(self.memo.__getitem__, chunks)) if chunks or not text else None)
            except TypeError:  # a chunk that has to be seen in its text
                out.append(None)
        if rest := [k for k, x in enumerate(out) if x is None]:
            for k, x in zip(rest, self._ids([texts[k] for k in rest]), strict=True):
                out[k] = x
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, most: int = MEMO) -> Encoder:
    """This worker's encoder for a vocabulary file, with a memo of at most ``most`` chunks."""
    if path not in _ENCODERS or _ENCODERS[path].most != most:
        _ENCODERS[path] = Encoder(path, most)
    return _ENCODERS[path]
