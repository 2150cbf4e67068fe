"""Public tokenizer files, loaded once in each Python process."""

from __future__ import annotations

import json
import os
from array import array
from functools import cache

import numpy as np


@cache
def load_bpe(path: str):
    """A tokenizer of the `tokenizers` library; one thread, for the task owns one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Characters that end a word and make one pre-token together; no letter, digit, white space or apostrophe.
PUNCT = '.,;:!?|*$#%&()"-'


@cache
def _pieces(path: str):
    """The merges of a tokenizer file as a function from one pre-token's bytes to ids; None where ids aren't ranks."""
    import tiktoken

    model = json.loads(load_bpe(path).to_str())["model"]
    vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if any(vocab["".join(m)] != 256 + i for i, m in enumerate(merges)):
        return None
    # the byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("own", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class CachedIds:
    """Ids of whole texts by a byte-level BPE tokenizer, through a bounded memory of what stands between single spaces.

    The byte-level pre-tokenizer always begins a new token at a single space or line feed between two characters that
    aren't white space, so the parts between them are encoded apart. A part that is a word, or a word and `PUNCT`, is
    one or two pre-tokens, to which the file's merges are applied at once; other parts go through the tokenizer in
    batches. A text with any other white space beside a space is encoded as a whole.
    """

    def __init__(self, path: str, most: int = 400_000):
        self.tok, self.most, self.piece = load_bpe(path), most, _pieces(path)
        self.known: dict[str, bytes | None] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        piece, known, other = self.piece, self.known, []
        for x in new:
            line = x[:1] == "\n"
            body = x[1:] if line else x
            word = body.rstrip(PUNCT)
            if piece and word.isalpha():
                ids = [*piece(b"\n"), *piece(word.encode())] if line else piece(b" " + word.encode())
                if len(word) < len(body):
                    ids += piece(body[len(word) :].encode())
                known[x] = array("I", ids).tobytes()
            elif body and not body[0].isspace() and not body[-1].isspace():
                other.append(x)
            else:
                known[x] = None
        known.update(zip(other, self._encode([x if x[0] == "\n" else " " + x for x in other]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts = [t.replace("\n", " \n").split(" ") for t in texts]
        firsts = self._encode([p[0] for p in parts])
        if len(self.known) > self.most:
            self.known.clear()
        self._learn(set().union(*(p[1:] for p in parts)).difference(self.known))
        out = []
        for t, p, first in zip(texts, parts, firsts, strict=True):
            try:
                if p[0] and (p[0][0].isspace() or p[0][-1].isspace()):
                    raise TypeError
                out.append(first + b"".join(map(self.known.__getitem__, p[1:])))
            except TypeError:  # a part without ids
                out.append(self._encode([t])[0])
        return out


@cache
def cached_ids(path: str, most: int = 400_000) -> CachedIds:
    """One memory in each Python process, of `most` entries (some 200 bytes each)."""
    return CachedIds(path, most)


def release() -> None:
    """Drops the tokenizers and memories of this process; the next task loads its own again (a quarter of a second)."""
    for f in (cached_ids, _pieces, load_bpe):
        f.cache_clear()


def public_path(name: str) -> str:
    """Where the installed vocabulary file of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
