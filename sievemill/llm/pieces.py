"""SentencePiece encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import heapq
import re
from array import array
from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import pick

SPACE = "▁"
_APART = re.compile(f"({SPACE})")
#: Draws of an occurrence that are made at once; further ones are made one by one. Characters of a run in the batch.
DRAWS, SHORT = 32, 24
#: Occurrences that are merged in one batch; the rank of a pair that doesn't merge.
BATCH, NONE = 16384, np.iinfo("i4").max
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Draws:
    """The draws of one occurrence in order; `mask` has bit d set where draw d skips its merge."""

    __slots__ = ("at", "drop", "key", "mask", "used")

    def __init__(self, mask: int, key: int, at: int, drop: int):
        self.mask, self.key, self.at, self.drop, self.used = mask, key, at, drop, 0

    def __call__(self) -> int:
        d = self.used
        self.used = d + 1
        if d < DRAWS:
            return self.mask >> d & 1
        return xxhash.xxh32_intdigest(self.at.to_bytes(8, "little") + d.to_bytes(8, "little"), self.key & 0xFFFFFFFF) < self.drop


class Pairs:
    """The pairs of symbols that merge, as a hash table in arrays: rank (equal scores are one rank) and merged symbol."""

    def __init__(self, scores: dict[str, float], symbol: dict[str, int]):
        rank = {s: i for i, s in enumerate(sorted(set(scores.values())))}
        rows = [(symbol[w[:i]], symbol[w[i:]], rank[s], symbol[w]) for w, s in scores.items() for i in range(1, len(w)) if w[:i] in symbol and w[i:] in symbol]
        a, b, r, w = np.array(rows, dtype="i8").T
        self.bits = max(4, (4 * len(rows)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype="i8")
        self.rank, self.merged = np.full(1 << self.bits, NONE, dtype="i4"), np.zeros(1 << self.bits, dtype="i4")
        key, todo = a << 32 | b, np.arange(len(rows))
        at = self._place(key)
        while len(todo):
            free = todo[self.keys[at[todo]] == -1]
            self.keys[at[free]] = key[free]  # of several, one stays
            todo = todo[self.keys[at[todo]] != key[todo]]
            at[todo] = at[todo] + 1 & (1 << self.bits) - 1
        self.rank[at], self.merged[at] = r, w

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key.view("u8") * _ODD >> np.uint64(64 - self.bits)).view("i8")

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places in the table of pairs of symbols; that of an empty place where a pair doesn't merge."""
        key = a.astype("i8") << 32 | b.astype("i8")
        at = self._place(key)
        far = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != -1))
        while len(far):
            at[far] = at[far] + 1 & (1 << self.bits) - 1
            far = far[(self.keys[at[far]] != key[far]) & (self.keys[at[far]] != -1)]
        return at


class Pieces:
    """A merge-type (BPE) model: pieces with scores, the highest of which are merged first, and byte pieces.

    A candidate merge that comes off the agenda is skipped with the chance `dropout`. The draws are those of the seed,
    the text's number and the place of the occurrence in the text, so each occurrence of a word is segmented on its own,
    and equal seeds give equal results on any machine. What stands between spaces is remembered without dropout, up to
    `most` words, with the number of its merges: an occurrence whose draws skip none of these has the same ids. All
    others of a batch run through their agendas side by side, one candidate of each at a time.
    """

    def __init__(self, path: str, dropout: float = 0.0, seed: int = 0, most: int = 400_000):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dropout, self.seed, self.most = int(dropout * 2**32), seed, most
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.scores = {sp.id_to_piece(i): -sp.get_score(i) for i in normal}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.raw = [b""] * n
        for p, i in self.ids.items():
            self.raw[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        # a symbol is its id; a character of one byte that is no piece has the id of its byte
        self.symbol = {chr(b): i for b, i in self.bytes.items() if b < 128} | self.ids
        self.of_char = np.full(0x110000, -1, dtype="i4")
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        self.pairs = Pairs(self.scores, self.symbol) if dropout else None
        self.known: dict[str, int] = {}
        self.plain: list[bytes] = []
        self.took = array("I")

    def merge(self, word: str, skip: Draws | None = None) -> list[int]:
        """Ids of a run that holds no space but at its start, by an agenda of its own."""
        sym, n = list(word), len(word)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        scores = self.scores
        agenda = [(s, i, w) for i in range(n - 1) if (s := scores.get(w := sym[i] + sym[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, w = heapq.heappop(agenda)
            j = right[i]
            if not sym[i] or j >= n or sym[i] + sym[j] != w:
                continue
            if skip is not None and skip():
                continue
            sym[i], sym[j] = w, ""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (s := scores.get(x := w + sym[k])) is not None:
                    heapq.heappush(agenda, (s, i, x))
            if (k := left[i]) >= 0 and (s := scores.get(x := sym[k] + w)) is not None:
                heapq.heappush(agenda, (s, k, x))
        return [x for s in sym if s for x in self._out(s)]

    def _out(self, s: str) -> list[int]:
        i = self.ids.get(s)
        return [self.bytes[b] for b in s.encode("utf-8", "surrogatepass")] if i is None else [i]

    def _word(self, head: str, word: str, skip: Draws | None = None) -> list[int]:
        """Ids of `head`, a run of space marks, with what follows up to the next space.

        A literal mark is part of no merge and goes as bytes, or it would decode as a space.
        """
        if SPACE not in word:
            return self.merge(head + word, skip) if head or word else []
        out: list[int] = []
        for part in _APART.split(word):
            if part == SPACE:
                out += self.merge(head, skip) if head else []
                out += [self.bytes[b] for b in part.encode()]
            elif head or part:
                out += self.merge(head + part, skip)
            head = ""
        return out

    def encode(self, text: str | None, number: int = 0) -> array:
        """Ids of a whole text; `number` (of the text) takes part in the draws."""
        return self.encode_all([text], [number])[0]

    def encode_all(self, texts: list[str | None], numbers: list[int]) -> list[array]:
        """Ids of each whole text."""
        words, ends, masks, keys, odd = [], [], [], [], []
        for t, number in zip(texts, numbers, strict=True):
            mine = t.split(" ") if t else []
            if "" in mine:
                heads, mine = self._spaced(mine)
                odd += [(len(words) + i, h) for i, h in enumerate(heads) if h != SPACE]
            words += mine
            ends.append(len(words))
            if self.dropout:
                keys.append(key := xxhash.xxh64_intdigest(number.to_bytes(8, "little", signed=True), self.seed & 0xFFFFFFFFFFFFFFFF))
                masks += self._masks(key, len(mine))
        got: list = [None] * len(words)
        given = np.concatenate(masks) if masks else None
        for lo in range(0, len(words), BATCH):
            self._batch(words, lo, min(len(words), lo + BATCH), given, got)
        start = [0, *ends]

        def draws(i: int) -> Draws | None:
            if given is None:
                return None
            d = bisect_right(start, i) - 1
            while i >= ends[d]:  # texts without words
                d += 1
            return Draws(int(given[i]), keys[d], i - start[d], self.dropout)

        for i, h in odd:
            got[i] = array("I", self._word(h, words[i], draws(i))).tobytes()
        if None in got:
            for i in [i for i, x in enumerate(got) if x is None]:
                got[i] = array("I", self._word(SPACE, words[i], draws(i))).tobytes()
        out = []
        for lo, hi in zip(start, ends, strict=False):
            out.append(array("I"))
            out[-1].frombytes(b"".join(got[lo:hi]))
        return out

    def _masks(self, key: int, n: int) -> list[np.ndarray]:
        """A word of `DRAWS` draws for each of n occurrences."""
        bits, out = np.random.Philox(key=key), []
        for lo in range(0, n, 4096):
            raw = bits.random_raw(min(4096, n - lo) * DRAWS // 2).astype("<u8", copy=False).view("<u4").reshape(-1, DRAWS)
            out.append(np.packbits(raw < self.dropout, axis=1, bitorder="little").view("<u4").ravel())
        return out

    def _learn(self, new: list[str]) -> None:
        """Undropped ids of words by the library, and how many merges they take; its own agenda where bytes stand in."""
        plain, took, ordinary = self.plain, self.took, set(self.bytes.values())
        for w, ids in zip(new, self.sp.encode(new), strict=True):
            if not w or SPACE in w or not ordinary.isdisjoint(ids):
                d = Draws(0, 0, 0, 0)
                ids = self._word(SPACE, w, d)
                merges = d.used
            else:
                merges = len(w) + 1 - len(ids)
            self.known[w] = len(plain)
            plain.append(array("I", ids).tobytes())
            # all draws where there may be more than the mask holds: such an occurrence is merged on its own
            took.append((1 << merges) - 1 if merges < DRAWS else (1 << DRAWS) - 1)

    def _batch(self, words: list[str], lo: int, hi: int, masks: np.ndarray | None, got: list) -> None:
        """Fills `got` from lo to hi; what the batch can't do stays None."""
        if len(self.plain) > self.most:
            # new objects, for an array that is viewed can't be resized
            self.known, self.plain, self.took = {}, [], array("I")
        some = words[lo:hi]
        if new := list(set(some).difference(self.known)):
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, some), dtype="i8", count=len(some))
        got[lo:hi] = list(map(self.plain.__getitem__, at.tolist()))
        if masks is None:
            return
        took = np.frombuffer(self.took, dtype="<u4")[at]
        mine = masks[lo:hi]
        go = np.flatnonzero((mine & took) | (took == 0xFFFFFFFF))
        texts = [SPACE + some[i] for i in go.tolist()]
        for i in go.tolist():
            got[lo + i] = None
        n = np.fromiter(map(len, texts), dtype="i8", count=len(texts))
        chars = self.of_char[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        first = np.append(0, n.cumsum())
        bad = np.zeros(len(texts), dtype=bool)
        bad[np.searchsorted(first, np.flatnonzero(chars < 0), "right") - 1] = True
        # a literal mark isn't merged
        own = np.flatnonzero(chars == self.symbol[SPACE])
        bad[np.searchsorted(first, own[~np.isin(own, first)], "right") - 1] = True
        rows = np.flatnonzero((n <= SHORT) & ~bad)
        if not len(rows):
            return
        col = np.arange(SHORT)
        real = col < n[rows, None]
        sym = np.where(real, chars[np.minimum(first[rows, None] + col, len(chars) - 1)], -1)
        whole = self._dropped(sym, n[rows], mine[go[rows]])
        keep = sym >= 0
        flat, upto = sym[keep].astype("<u4").tobytes(), np.append(0, keep.sum(1).cumsum() * 4).tolist()
        for r, i in enumerate((go[rows] + lo).tolist()):
            if whole[r]:
                got[i] = flat[upto[r] : upto[r + 1]]

    def _dropped(self, sym: np.ndarray, n: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Merges rows of symbols in place (-1: none), each under its own draws; False for rows that need more draws."""
        pairs, width = self.pairs, sym.shape[1]
        right = np.tile(np.arange(1, width + 1, dtype="i4"), (len(sym), 1))
        left = right - 2
        rank = np.full(sym.shape, NONE, dtype="i4")
        to = np.zeros(sym.shape, dtype="i4")
        r, c = np.nonzero(np.arange(1, width + 1) < n[:, None])
        p = pairs(sym[r, c], sym[r, c + 1])
        rank[r, c], to[r, c] = pairs.rank[p], pairs.merged[p]
        live = np.arange(len(sym))
        for d in range(DRAWS + 1):
            i = rank[live].argmin(1)
            on = rank[live, i] != NONE
            live, i = live[on], i[on]
            if d == DRAWS or not len(live):
                break
            skip = (mask[live] >> np.uint32(d) & np.uint32(1)).astype(bool)
            rank[live[skip], i[skip]] = NONE
            r, i = live[~skip], i[~skip]
            j = right[r, i]
            w = to[r, i]
            sym[r, i], sym[r, j] = w, -1
            rank[r, i] = rank[r, j] = NONE
            right[r, i] = k = right[r, j]
            has = k < n[r]
            x, y, z = r[has], i[has], k[has]
            left[x, z] = y
            p = pairs(w[has], sym[x, z])
            rank[x, y], to[x, y] = pairs.rank[p], pairs.merged[p]
            k = left[r, i]
            has = k >= 0
            x, z = r[has], k[has]
            p = pairs(sym[x, z], w[has])
            rank[x, z], to[x, z] = pairs.rank[p], pairs.merged[p]
        out = np.ones(len(sym), dtype=bool)
        out[live] = False
        return out

    @staticmethod
    def _spaced(words: list[str]) -> tuple[list[str], list[str]]:
        """Runs of spaces, which merge with each other, and the words behind them."""
        heads, rest, run = [], [], ""
        for w in words:
            run += SPACE
            if w:
                heads.append(run)
                rest.append(w)
                run = ""
        if run:
            heads.append(run)
            rest.append("")
        return heads, rest

    def decode(self, ids) -> str:
        """The text of ids from `encode`, less the space that encoding puts before it."""
        s = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return s[1:] if s[:1] == " " else s


@cache
def load(path: str, dropout: float, seed: int) -> Pieces:
    """One in each Python process."""
    return Pieces(path, dropout, seed)


def encode(docs: DataFrame, model: str, *, dropout: float = 0.1, seed: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text; map only.

    With dropout 0 the ids are those of the sentencepiece library (but for texts that hold its space mark, U+2581, which
    go through byte pieces so that they decode losslessly). Null and empty texts: no ids. Null ids count as 0 in the
    draws and come back null. Repeated rows are each encoded. An empty table gives no rows. Other columns
    are not read.
    """
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(it):
        p = load(model, dropout, seed)
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                c = batch.slice(at, 256).to_pydict()
                ids = p.encode_all(c["text"], [i or 0 for i in c["id"]])
                ends = array("i", [0])
                flat = array("I")
                for x in ids:
                    flat.extend(x)
                    ends.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat.tobytes())]))
                yield pa.RecordBatch.from_arrays([pa.array(c["id"], pa.int64()), lists], schema=out)

    return pick(docs, id=doc_id, text=text).select(F.col("id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str, *, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of lists of ids; null lists give null texts. Map only."""

    def run(it):
        p = load(model, 0.0, 0)
        for batch in it:
            c = batch.to_pydict()
            yield pa.RecordBatch.from_pydict({"doc_id": c["id"], "text": [None if x is None else p.decode(x) for x in c["ids"]]}, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))

    return pick(encoded, id=doc_id, ids=ids).select(F.col("id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def summary(docs: DataFrame, model: str, *, dropout: float = 0.1, seed: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What encoding makes of each text: doc_id, n_pieces, ids_crc32, lossless (decoding gives the text back).

    For nulls, ties and empty tables see `encode`; a null text counts as empty.
    """
    import zlib

    out = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("lossless", pa.bool_())])

    def run(it):
        p = load(model, dropout, seed)
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                c = batch.slice(at, 256).to_pydict()
                ids = p.encode_all(c["text"], [i or 0 for i in c["id"]])
                yield pa.RecordBatch.from_pydict({"doc_id": c["id"], "n_pieces": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids], "lossless": [p.decode(x) == (t or "") for x, t in zip(ids, c["text"], strict=True)]}, schema=out)

    return pick(docs, id=doc_id, text=text).select(F.col("id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")
