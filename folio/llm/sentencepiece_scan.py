"""SentencePiece encoding and decoding, with a parallel max-plus scan over giant documents.

The vocabulary is a public BPE one. A sequence of pieces is the BPE encoding of a text exactly if every two
neighbours are the encoding of their own concatenation, so encoding is a best-path search in which a step weighs 0
if its neighbours agree and minus infinity if not; from a given piece, one path at most reaches each position.

A text of at most CHUNK characters is searched in one go. A longer one is cut into chunks at fixed places. The
state at a cut is the piece that ends at or after it; a chunk's transfer matrix says which states at its end each
state at its start can reach (the entries of weight 0). Matrices are combined over blocks of chunks and then over a
document's blocks, which fixes the one state at each cut that lies on the whole path, and each chunk is then
traced back by itself.

No piece holds a word mark after another character, so between the first and last such place of a chunk the search
falls apart into words, whose encodings are remembered. New words are searched together, place by place: a trie of the
pieces gives the steps, and a table says which neighbours agree.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import cut, held, read, whole

MARK = "▁"
#: Characters of a chunk, and chunks of a block.
CHUNK = 1 << 15
BLOCK = 256
#: Remembered words; beyond them those not in use go.
REMEMBERED = 200_000
#: Places of words that are searched together, and the longest run of places that joins them.
TOGETHER, WIDE = 1 << 17, 64
#: Remembered pairs, as a power of two; a pair's place is a hash of it, and what stood there goes.
PAIR_BITS = 20
#: A state is (characters by which its piece passes the cut) * 256 + (characters of the piece); at a text's start 0.
STATE = 256
ENCODED = "doc_id long, text_crc32 long, ids array<int>"
DECODED = f"{ENCODED}, ids_crc32 long, text string"
PIECE_MODEL = "piece_bpe_32k.model"
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


class Steps:
    """The search over many words at once, on arrays: pieces by a trie, agreement of neighbours by a table."""

    def __init__(self, ids: dict[str, int], rank: dict[str, float], byte_id: list[int]) -> None:
        self.byte_id = np.array(byte_id, "<i4")
        # The trie: (node, character) -> node, and each node's piece.
        node, nodes, ends = {"": 0}, [], [-1]
        for piece, i in ids.items():
            for k in range(1, len(piece) + 1):
                if piece[:k] not in node:
                    node[piece[:k]] = len(ends)
                    nodes.append((node[piece[: k - 1]] << 21 | ord(piece[k - 1]), len(ends)))
                    ends.append(-1)
            ends[node[piece]] = i
        nodes.sort()
        self.edge, self.child = (np.array(x, np.int64) for x in zip(*nodes, strict=True))
        self.ends = np.array(ends, np.int64)
        self.beside = np.unique(np.array([ord(x[k]) << 21 | ord(x[k + 1]) for x in ids for k in range(len(x) - 1)], np.int64))
        # Merges: (symbol, symbol) -> rank and symbol. A symbol is a piece, by its id, or one of their other characters.
        number = dict(ids)
        for c in sorted({c for x in ids for c in x}):
            number.setdefault(c, len(byte_id) + 256 + len(number))
        self.characters = {i: [number[c] for c in x] for x, i in ids.items()}
        merges = sorted((number[x[:k]] << 32 | number[x[k:]], rank[x], i) for x, i in ids.items() for k in range(1, len(x)) if x[:k] in number and x[k:] in number)
        self.pair, self.pair_rank, self.merged = np.array([m[0] for m in merges], np.int64), np.array([m[1] for m in merges]), np.array([m[2] for m in merges], np.int64)
        self.known, self.agreed = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)

    def _rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at, key = self._merge(x, y)
        return np.where(self.pair[at] == key, self.pair_rank[at], np.inf)

    def _merge(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = x << 32 | y
        return np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1), key

    def _merging(self, pairs: np.ndarray) -> np.ndarray:
        """For each pair (a << 32 | b), whether merging a + b by rank gives back a and b."""
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        parts = [self.characters[x] + self.characters[y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        width, out = max(map(len, parts)), np.zeros(len(pairs), bool)
        symbols = np.full((len(parts), width + 1), -1, np.int64)
        for k, x in enumerate(parts):
            symbols[k, : len(x)] = x
        rank = np.where(symbols[:, 1:] >= 0, self._rank(symbols[:, :-1], symbols[:, 1:]), np.inf)
        of, places = np.arange(len(parts)), np.arange(width)
        while len(of):
            at = rank.argmin(1)
            going = rank[np.arange(len(of)), at] < np.inf
            done = ~going
            out[of[done]] = (symbols[done, 0] == a[of[done]]) & (symbols[done, 1] == b[of[done]]) & (symbols[done, 2] < 0 if width > 1 else True)
            of, symbols, rank, at = of[going], symbols[going], rank[going], at[going]
            row = np.arange(len(of))
            found, _ = self._merge(symbols[row, at], symbols[row, at + 1])
            symbols[:, :-1] = np.where(places > at[:, None], symbols[:, 1:], symbols[:, :-1])
            symbols[:, -1] = -1
            symbols[row, at] = self.merged[found]
            rank[:, :-1] = np.where(places[:-1] > at[:, None], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = np.inf
            rank[row, at] = np.where(symbols[row, at + 1] >= 0, self._rank(symbols[row, at], symbols[row, at + 1]), np.inf)
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self._rank(symbols[before, at[before] - 1], symbols[before, at[before]])
        return out

    def agree(self, pairs: np.ndarray) -> np.ndarray:
        at = (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        out, new = self.agreed[at], self.known[at] != pairs
        if new.any():
            fresh, inverse = np.unique(pairs[new], return_inverse=True)
            found = np.concatenate([self._merging(fresh[k : k + 65536]) for k in range(0, len(fresh), 65536)])
            out[new] = found[inverse]
            to = (fresh.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
            self.known[to], self.agreed[to] = fresh, found
        return out

    def encode(self, words: list[str], alone) -> list[bytes]:
        """The ids of each word (little-endian int32); runs of more than WIDE places go to alone(text, 0, 0, length)."""
        text = "".join(words)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        n, ends = len(code), np.cumsum([len(w) for w in words])
        # Runs: words, cut where no piece holds the two characters side by side, so none runs over the place between.
        key = code[:-1] << 21 | code[1:]
        starts = np.zeros(n + 1, bool)
        starts[1:-1] = self.beside[np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)] != key
        starts[0] = starts[ends] = True
        first = np.flatnonzero(starts[:-1])
        stop = np.append(first[1:], n)
        run = np.repeat(np.arange(len(first)), stop - first)
        begin, wide = first[run], (stop - first > WIDE)[run]
        # Steps (start, end, piece) by walking the trie from all places at once. A place is a character's left side.
        place, at = np.flatnonzero(~wide), np.zeros(int((~wide).sum()), np.int64)
        steps, length = [], 0
        while len(place):
            key = at << 21 | code[place + length]
            to = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            there = self.edge[to] == key
            place, at = place[there], self.child[to[there]]
            length += 1
            piece = self.ends[at]
            whole_ = piece >= 0
            steps.append((place[whole_], np.full(int(whole_.sum()), length), piece[whole_]))
            more = place + length < stop[run[place]]
            place, at = place[more], at[more]
        start, size, piece = (np.concatenate(x) for x in zip(*steps, strict=True)) if steps else (np.empty(0, np.int64),) * 3
        single = np.zeros(n, bool)
        single[start[size == 1]] = True
        alone_ = ~single & ~wide  # characters that are no piece, beside which all agrees
        start, size, piece = np.concatenate([start, np.flatnonzero(alone_)]), np.concatenate([size, np.ones(int(alone_.sum()), np.int64)]), np.concatenate([piece, np.full(int(alone_.sum()), -1)])
        # The step by which each end is reached: its length (0: not yet), and its piece. Places within a run go in turn.
        by, last = np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int64)
        inner = start - begin[start] + size
        order = np.argsort(inner, kind="stable")
        start, size, piece, inner = start[order], size[order], piece[order], inner[order]
        bounds = np.searchsorted(inner, np.arange(1, (int(inner[-1]) if len(inner) else 0) + 2))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            s, z, p = start[low:high], size[low:high], piece[low:high]
            opens = s == begin[s]
            prior = np.where(opens, -1, last[s - 1])  # what ends at place s is held by its last character
            fine = opens | (by[s - 1] > 0)
            ask = np.flatnonzero(fine & (prior >= 0) & (p >= 0))
            if len(ask):
                fine[ask] = self.agree(prior[ask] << 32 | p[ask])
            to = s[fine] + z[fine] - 1
            by[to], last[to] = z[fine], p[fine]
        # Back from each run's end.
        on, walk = np.zeros(n, bool), stop[~wide[first]] - 1
        low = first[~wide[first]]
        while len(walk):
            if not by[walk].all():
                raise ValueError("no path of weight 0")
            on[walk] = True
            walk = walk - by[walk]
            more = walk >= low
            walk, low = walk[more], low[more]
        at = np.flatnonzero(on)
        ids = last[at]
        code_ = code[at]
        counts = np.where(ids >= 0, 1, 1 + (code_ > 0x7F) + (code_ > 0x7FF) + (code_ > 0xFFFF))
        out = np.repeat(ids, counts).astype("<i4")
        if (ids < 0).any():
            out[out < 0] = self.byte_id[np.frombuffer("".join(map(chr, code_[ids < 0].tolist())).encode(), np.uint8)]
        upto = np.concatenate([[0], np.cumsum(counts)])
        data, ends_ = out.tobytes(), (4 * upto[np.searchsorted(at, ends)]).tolist()
        found = [data[a:b] for a, b in zip([0, *ends_[:-1]], ends_, strict=True)]
        if wide.any():
            word_of = np.searchsorted(ends, np.flatnonzero(wide), side="right")
            for k in np.unique(word_of).tolist():
                low, high = int(ends[k]) - len(words[k]), int(ends[k])
                parts = []
                for a, b in zip(first[(first >= low) & (first < high)].tolist(), stop[(first >= low) & (first < high)].tolist(), strict=True):
                    if wide[a]:
                        parts.append(np.array(alone(text[a:b], 0, 0, b - a), "<i4").tobytes())
                    else:
                        parts.append(data[4 * int(upto[np.searchsorted(at, a)]) : 4 * int(upto[np.searchsorted(at, b)])])
                found[k] = b"".join(parts)
        return found


class Pieces(dict):
    """Encodings of words (little-endian int32 ids), found when first asked for."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.ids, self.rank, self.bytes_of, self.byte_id = {}, {}, [b""] * n, [0] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)], self.bytes_of[i] = i, bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.ids[piece], self.rank[piece], self.bytes_of[i] = i, -model.get_score(i), piece.replace(MARK, " ").encode()
        if any(re.search(f"[^{MARK}]{MARK}", x) for x in self.ids):
            raise ValueError("this vocabulary has pieces that run over word marks")
        self.longest = max(map(len, self.ids))
        self.tails = {x[k:] for x in self.ids for k in range(len(x))}
        self.texts = {i: x for x, i in self.ids.items()}
        self.steps = Steps(self.ids, self.rank, self.byte_id)
        self.agreed: dict[int, bool] = {}
        self.older: dict[str, bytes] = {}

    def agree(self, a: str, b: str) -> bool:
        """Whether merging a + b by rank gives back a and b."""
        parts = list(a + b)
        while True:
            least = min(((r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None), default=None)
            if least is None:
                return parts == [a, b]
            i = least[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def search(self, text: str, start: int, before: int, end: int) -> tuple[list[int], list[int]]:
        """For each place from start to end, the length and id of the piece by which the path reaches it.

        Length 0: no path does. Id -1: a character that is no piece, beside which all agrees. before: the length of
        the piece that ends at start; 0 if any may.
        """
        by, last, get, tails, agreed = [0] * (end - start + 1), [-1] * (end - start + 1), self.ids.get, self.tails, self.agreed
        by[0], last[0] = 1, get(text[start - before : start], -1) if before else -1
        for i in range(start + 1, end + 1):
            for s in range(i - 1, start - 1, -1):
                prior = last[s - start]
                if (piece := get(text[s:i])) is None:
                    if s == i - 1 and by[s - start]:
                        by[i - start] = 1
                        break
                    if text[s:i] in tails:
                        continue
                    if s == i - 1:
                        continue
                    break
                if not by[s - start]:
                    continue
                if prior >= 0:
                    if (yes := agreed.get(pair := prior << 32 | piece)) is None:
                        yes = agreed[pair] = self.agree(self.texts[prior], self.texts[piece])
                    if not yes:
                        continue
                by[i - start], last[i - start] = i - s, piece
                break
        by[0] = 0
        return by, last

    def trace(self, text: str, start: int, before: int, end: int) -> list[int]:
        (by, last), out, at = self.search(text, start, before, end), [], end
        while at > start:
            i = at - start
            out += [last[i]] if last[i] >= 0 else [self.byte_id[x] for x in reversed(text[at - 1].encode())]
            at -= by[i]
        return out[::-1]

    def __missing__(self, word: str) -> bytes:
        self.learn([word])
        return self[word]

    def words(self, text: str) -> bytes:
        return self.all_words([text])[0]

    def all_words(self, texts: list[str]) -> list[bytes]:
        """The encodings of texts that fall apart into words."""
        found = list(map(WORDS.findall, texts))
        self.learn(list(set().union(*found).difference(self.keys())))
        return [b"".join(map(self.__getitem__, x)) for x in found]

    def learn(self, words: list[str]) -> None:
        """Remembers the encodings of words."""
        new, size = [], 0
        for word in words:
            if (known := self.older.pop(word, None)) is not None:
                self[word] = known
                continue
            new.append(word)
            size += len(word)
            if size > TOGETHER:
                self.update(zip(new, self.steps.encode(new, self.trace), strict=True))
                new, size = [], 0
        if new:
            self.update(zip(new, self.steps.encode(new, self.trace), strict=True))

    def tidy(self) -> None:
        if len(self) > REMEMBERED:  # what is still in use comes back from there
            self.older = dict(self)
            self.clear()
        if len(self.agreed) > REMEMBERED:
            self.agreed.clear()

    def states(self, text: str, at: int) -> list[int]:
        """The states that the text allows at a cut."""
        return [(e - at) * STATE + e - s for s in range(max(0, at - self.longest), at) for e in range(at, min(len(text), s + self.longest) + 1) if e - s == 1 or text[s:e] in self.ids]

    def ends(self, text: str, start: int, before: int, at: int) -> list[int]:
        """The states at a cut that a path from start reaches."""
        by, _ = self.search(text, start, before, min(len(text), at + self.longest - 1))
        return [(i - at) * STATE + n for i in range(at, start + len(by)) if (n := by[i - start]) and i - n < at]

    def transfer(self, text: str, first: int, last: int) -> list[tuple[int, int]]:
        """The (state at first, state at last) pairs of weight 0 of the chunk text[first:last]."""
        entries = self.states(text, first) if first else [0]
        inner = breaks(text, first + self.longest, last) if first else breaks(text, first, last)
        if not inner:
            return [(e, x) for e in entries for x in self.ends(text, first + e // STATE, e % STATE, last)]
        alive = [e for e in entries if self.search(text, first + e // STATE, e % STATE, inner[0])[0][-1] or first + e // STATE == inner[0]]
        return [(e, x) for e in alive for x in self.ends(text, inner[1], 0, last)]

    def between(self, text: str, first: int, last: int, entry: int, leave: int) -> bytes:
        """The ids of the pieces after the entry piece, up to and with the piece of the state in which it is left."""
        start, end = first + entry // STATE, last + leave // STATE
        inner = breaks(text, first + self.longest, last) if first else breaks(text, first, last)
        if not inner:
            return np.array(self.trace(text, start, entry % STATE, end), "<i4").tobytes()
        head, tail = self.trace(text, start, entry % STATE, inner[0]), self.trace(text, inner[1], 0, end)
        return np.array(head, "<i4").tobytes() + self.words(text[inner[0] : inner[1]]) + np.array(tail, "<i4").tobytes()


def breaks(text: str, first: int, last: int) -> tuple[int, int] | None:
    """The first and last place in [first, last) at which a word mark follows another character."""
    low = next((m.start() + 1 for m in re.compile(f"[^{MARK}]{MARK}").finditer(text, max(0, first - 1), last)), None)
    if low is None:
        return None
    at = last - 1
    while not (text[at] == MARK and text[at - 1] != MARK):
        at -= 1
    return low, at


def load(path: str) -> Pieces:
    return held(("pieces", path), lambda: Pieces(path))


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def _encode_short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 512):
                batch = whole_batch.slice(at, 512)
                pieces.tidy()
                ids = _lists(pieces.all_words([marked(x) for x in batch.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_crc32"), ids], ["doc_id", "text_crc32", "ids"])

    return run


def _chunks(size: int, longest: int):
    names = ["row", "doc_id", "text_crc32", "chunk", "first", "last", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, crc, text in zip(*(batch.column(x).to_pylist() for x in ("row", "doc_id", "text_crc32", "text")), strict=True):
                text = marked(text)
                for k, at in enumerate(range(0, len(text), size)):
                    low, high = max(0, at - longest), min(len(text), at + size)
                    part = [[row], [doc_id], [crc], [k], [at - low], [high - low], [text[low : high + longest]]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names)

    return run


def _transfers(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = load(path)
        for x in frames:
            pieces.tidy()
            found = [pieces.transfer(*of) for of in zip(x.text, x["first"], x["last"], strict=True)]
            yield pd.DataFrame({"row": x.row, "block": x.chunk // BLOCK, "chunk": x.chunk, "entry": [[e for e, _ in f] for f in found], "leave": [[e for _, e in f] for f in found]})

    return run


def combine(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The max-plus product of two matrices, given by their entries of weight 0."""
    to: dict[int, list[int]] = {}
    for x, y in b:
        to.setdefault(x, []).append(y)
    return sorted({(x, z) for x, y in a for z in to.get(y, ())})


def along(steps: list[list[tuple[int, int]]], entry: int, leaves: set[int]) -> list[tuple[int, int]]:
    """The states at both ends of each step on the one path from entry to one of leaves."""
    seen = [{entry}]
    for step in steps:
        seen.append({y for x, y in step if x in seen[-1]})
    out, ends = [], seen[-1] & leaves
    for step, starts in zip(reversed(steps), reversed(seen[:-1]), strict=True):
        (x, y), *more = [(x, y) for x, y in step if x in starts and y in ends]
        if more and len({y for _, y in [(x, y), *more]}) > 1:
            raise ValueError("two paths of weight 0")
        ends = {x}
        out.append((x, y))
    return out[::-1]


def _lists_of(batch: pa.RecordBatch) -> list[list[list[tuple[int, int]]]]:
    """For each row, the matrices of its steps in order."""
    return [[list(zip(x["entry"], x["leave"], strict=True)) for x in steps] for steps in batch.column("steps").to_pylist()]


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The product of each block's chunks."""
    of = pa.list_(pa.int32())
    for batch in batches:
        products = [reduce(combine, steps) for steps in _lists_of(batch)]
        ends = [pa.array([[x[k] for x in p] for p in products], of) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("block"), *ends], ["row", "block", "entry", "leave"])


def _resolve(step: str):
    """The states at both ends of each step (block or chunk) of a row, from its start to its end; no end: that of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            numbers = [[x[step] for x in steps] for steps in batch.column("steps").to_pylist()]
            for row, start, end, number, steps in zip(*(batch.column(c).to_pylist() for c in ("row", "start", "end")), numbers, _lists_of(batch), strict=True):
                ends = {y for _, y in steps[-1] if y < STATE} if end is None else {end}
                rows += [(row, n, x, y) for n, (x, y) in zip(number, along(steps, start, ends), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[1:])], ["row", step, "start", "end"])

    return run


def _in_order(step: str):
    return F.array_sort(F.collect_list(F.struct(step, "entry", "leave"))).alias("steps")


def _backtrace(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = load(path)
        for x in frames:
            pieces.tidy()
            ids = [np.frombuffer(pieces.between(*of), "<i4") for of in zip(x.text, x["first"], x["last"], x.start, x.end, strict=True)]
            yield pd.DataFrame({"row": x.row, "doc_id": x.doc_id, "text_crc32": x.text_crc32, "chunk": x.chunk, "ids": ids})

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.crc32(whole("text")).alias("text_crc32"), whole("text").alias("text"))


def encode(docs: DataFrame, model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text_crc32, ids (array<int>) of each row of docs, as the model's own library encodes its text.

    Null and empty texts have no ids. Repeated rows are encoded each. An empty table gives no rows. Other columns
    of docs are not read. model: the path of a SentencePiece BPE model with byte fallback and no normalisation,
    which every executor must have. Texts of more than `chunk` characters take the scan.
    """
    path, texts = model or default_model(), _texts(docs)
    short = texts.where(F.length("text") < chunk).mapInArrow(_encode_short(path), ENCODED)
    return short.union(_scanned(texts, path, chunk))


def _scanned(texts: DataFrame, path: str, chunk: int) -> DataFrame:
    """The texts of `chunk` characters and more, encoded by the scan."""
    giant = texts.where(F.length("text") >= chunk).withColumn("row", F.monotonically_increasing_id())
    # Chunks cost much time for their bytes, so the number of their tasks is set.
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = cut(giant.mapInArrow(_chunks(chunk, load(path).longest), "row long, doc_id long, text_crc32 long, chunk int, first int, last int, text string").repartition(tasks, "row", "chunk"))
    steps = chunks.mapInPandas(_transfers(path), "row long, block int, chunk int, entry array<int>, leave array<int>")
    blocks = cut(steps.groupBy("row", "block").agg(_in_order("chunk")))
    products = blocks.mapInArrow(_compose, "row long, block int, entry array<int>, leave array<int>").groupBy("row").agg(_in_order("block"))
    ends = products.select("row", F.lit(0).alias("start"), F.lit(None).cast("int").alias("end"), "steps").mapInArrow(_resolve("block"), "row long, block int, start int, end int")
    states = blocks.join(ends.hint("merge"), ["row", "block"]).mapInArrow(_resolve("chunk"), "row long, chunk int, start int, end int")
    traced = chunks.repartition(tasks, "row", "chunk").join(states.hint("merge"), ["row", "chunk"]).mapInPandas(_backtrace(path), "row long, doc_id long, text_crc32 long, chunk int, ids array<int>")
    # A group is one document, whose text was one row before.
    rows = traced.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_crc32").alias("text_crc32"), F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    return rows.select("doc_id", "text_crc32", F.flatten("parts.ids").alias("ids"))


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = load(path).bytes_of.__getitem__
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 512):
                batch = whole_batch.slice(at, 512)
                texts, crcs = [], []
                for ids in batch.column("ids"):
                    ids = ids.values.to_numpy() if ids.values is not None else np.empty(0, np.int32)
                    texts.append(b"".join(map(get, ids.tolist())).removeprefix(b" ").decode("utf-8", "replace"))
                    crcs.append(zlib.crc32(ids.astype("<i4", copy=False)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_crc32"), batch.column("ids"), pa.array(crcs, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text_crc32", "ids", "ids_crc32", "text"])

    return run


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """encoded with ids_crc32 (of the ids as little-endian int32) and text, the ids' text.

    A text that held U+2581 comes back with spaces there, as from the library; byte pieces that are no UTF-8 become
    U+FFFD.
    """
    path = model or default_model()
    return encoded.select("doc_id", "text_crc32", "ids").mapInArrow(_decode(path), DECODED)


def round_trip(docs: DataFrame, model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Each document with its ids, their number, checksums, and whether decoding gives its text back.

    Texts of fewer than `chunk` characters are encoded and decoded by one Python process of a task, as two would hold the pieces twice.
    """
    path, texts = model or default_model(), _texts(docs)
    there, back = _encode_short(path), _decode(path)
    short = texts.where(F.length("text") < chunk).mapInArrow(lambda batches: back(there(batches)), DECODED)
    both = short.union(decode(_scanned(texts, path, chunk), model))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32", F.crc32("text").alias("decoded_crc32"), (F.crc32("text") == F.col("text_crc32")).alias("round_trip"), "ids")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents")).drop("ids")
