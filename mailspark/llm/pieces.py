"""Token ids of many texts at once: texts are cut where a tokenizer never joins, and each distinct piece is encoded once.

A Python worker keeps its coders, so what one task of a job has learnt serves the job's next tasks in that worker. Pieces are found by a 64-bit
hash of their bytes in a table of numpy arrays; when it holds as many pieces as it may, it is emptied and filled anew.
"""

from __future__ import annotations

import functools

import numpy as np

from mailspark.llm.common import BLOCK_BYTES, POWERS, SPREAD, mixed

#: Pieces, and ids of pieces, that a worker remembers at most.
REMEMBERED, REMEMBERED_IDS = 1 << 21, 1 << 24
MARK = "▁"


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, never 0; equal bytes have equal hashes."""
    lead = np.zeros(len(data) + 1, dtype=np.uint64)
    up, down = POWERS.upto(len(data) + 1)
    np.cumsum(SPREAD[data] * up[: len(data)], dtype=np.uint64, out=lead[1:])
    found = mixed((lead[end] - lead[start]) * down[start] + (end - start).astype(np.uint64))
    return np.where(found == 0, np.uint64(1), found)


class Memory:
    """Ids of pieces by hash, by open addressing in a table at least twice as large as the pieces it holds."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        slots = 1 << (2 * capacity - 1).bit_length()
        self.mask = slots - 1
        self.keys, self.place = np.zeros(slots, dtype=np.uint64), np.zeros(slots, dtype=np.int32)
        self.count = self.filled = 0
        self.start, self.size = np.zeros(capacity, dtype=np.int64), np.zeros(capacity, dtype=np.int32)
        self.whole = np.zeros(capacity, dtype=bool)
        self.flat = np.zeros(1 << 16, dtype=np.uint32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash's piece, -1 if it is not known."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        slot = (hashes & np.uint64(self.mask)).astype(np.int64)
        held = self.keys[slot]
        hit = held == hashes
        out[hit] = self.place[slot[hit]]
        left = np.flatnonzero(~hit & (held != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            held = self.keys[slot[left]]
            hit = held == hashes[left]
            out[left[hit]] = self.place[slot[left[hit]]]
            left = left[~hit & (held != 0)]
        return out

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, whole: np.ndarray) -> None:
        """Remember distinct new hashes; ``ids`` holds the ids of all of them in order."""
        n, needed = len(hashes), self.filled + len(ids)
        if needed > len(self.flat):
            grown = np.zeros(max(needed, 2 * len(self.flat)), dtype=np.uint32)
            grown[: self.filled] = self.flat[: self.filled]
            self.flat = grown
        self.flat[self.filled : needed] = ids
        numbers = np.arange(self.count, self.count + n, dtype=np.int32)
        self.start[numbers], self.size[numbers], self.whole[numbers] = self.filled + np.cumsum(sizes) - sizes, sizes, whole
        self.count, self.filled = self.count + n, needed
        slot, left = (hashes & np.uint64(self.mask)).astype(np.int64), np.arange(n)
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = hashes[free]
            # of several that want a slot, the one whose hash stands there has it
            placed = self.keys[slot[left]] == hashes[left]
            self.place[slot[left[placed]]] = numbers[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & self.mask


class Coder:
    """Texts to ids by distinct pieces. Subclasses say where pieces begin (``cut``) and what their ids are (``ids_of_pieces``)."""

    def __init__(self) -> None:
        self.memory, self.job, self.temporary = Memory(REMEMBERED), None, False

    def cut(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(first byte of every piece, a mark of each piece that ``ids_of_pieces`` wants or None)."""
        raise NotImplementedError

    def ids_of_pieces(self, pieces: list[bytes], marks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each, whether each one's tokens spell its bytes)."""
        raise NotImplementedError

    def encode_whole(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each, whether each one's tokens spell its bytes); about BLOCK_BYTES are worked on at a time."""
        parts, first = [], 0
        while first < len(bounds) - 1:
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + BLOCK_BYTES, side="right")) - 1)
            parts.append(self._encode_block(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]))
            first = last
        if not parts:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        return parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts)))

    def _encode_block(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = len(bounds) - 1
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(rows, dtype=np.int64), np.ones(rows, dtype=bool)
        start, marks = self.cut(data, bounds)
        end = np.append(start[1:], len(data))
        hashes = span_hashes(data, start, end)
        number = self.memory.find(hashes)
        if (number < 0).any():
            number = self._learnt(data, start, end, hashes, number, marks)
        each = self.memory.size[number].astype(np.int64)
        ahead = np.concatenate([[0], np.cumsum(each)])
        ids = self.memory.flat[np.repeat(self.memory.start[number] - ahead[:-1], each) + np.arange(ahead[-1])]
        edges = np.searchsorted(start, bounds)
        broken = np.concatenate([[0], np.cumsum(~self.memory.whole[number])])
        if self.temporary:
            self.memory = Memory(REMEMBERED)
            self.temporary = False
        return ids, np.diff(ahead[edges]), np.diff(broken[edges]) == 0

    def _learnt(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, number: np.ndarray, marks: np.ndarray | None) -> np.ndarray:
        """Numbers of all pieces, after the unknown ones have been encoded."""
        unknown = np.flatnonzero(number < 0)
        fresh, at = np.unique(hashes[unknown], return_index=True)
        at = unknown[at]
        if self.memory.count + len(fresh) > self.memory.capacity or self.memory.filled > REMEMBERED_IDS:
            # forget all; this block's pieces are learnt anew, in a larger table for this block if they are too many
            fresh, at = np.unique(hashes, return_index=True)
            self.memory = Memory(max(REMEMBERED, len(fresh)))
            self.temporary = len(fresh) > REMEMBERED
        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
        self.memory.add(fresh, *self.ids_of_pieces(pieces, None if marks is None else marks[at]))
        return self.memory.find(hashes)


class SentenceCoder(Coder):
    """Ids of a sentencepiece model for texts that each begin with the blank the model adds by itself.

    Needs a model that changes no characters and whose pieces hold blanks only at their beginning: texts are cut before each run of
    blanks. Unknown characters come as byte pieces.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for k in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(k)
            if MARK in piece.lstrip(MARK):
                raise ValueError("the model has pieces with a blank inside")
            special = self.model.is_control(k) or self.model.is_unknown(k)
            self.bytes.append(b"" if special else bytes([int(piece[3:5], 16)]) if self.model.is_byte(k) else piece.replace(MARK, " ").encode())
        self.blank = self.model.piece_to_id(MARK)

    def cut(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, None]:
        blank = data == 32
        starts = blank.copy()
        starts[1:] &= ~blank[:-1]
        starts[bounds[:-1][bounds[:-1] < len(data)]] = True
        return np.flatnonzero(starts), None

    def ids_of_pieces(self, pieces: list[bytes], marks: None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        each = self.model.encode([p[1:].decode() for p in pieces], num_threads=1)
        each = [ids or [self.blank] for ids in each]
        spelt = np.fromiter((b"".join([self.bytes[k] for k in ids]) == p for ids, p in zip(each, pieces)), dtype=bool, count=len(pieces))
        sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        return np.array([k for ids in each for k in ids], dtype=np.uint32), sizes, spelt


@functools.lru_cache(maxsize=4)
def _coder(kind: type, *options: object) -> Coder:
    return kind(*options)


def kept(job: str, kind: type, *options: object) -> Coder:
    """The worker's coder of a kind. It is loaded once, but remembers pieces only for one job, whose name the driver has made."""
    coder = _coder(kind, *options)
    if coder.job != job:
        coder.memory, coder.job = Memory(REMEMBERED), job
    return coder
