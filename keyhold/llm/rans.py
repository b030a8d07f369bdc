"""A static range asymmetric numeral system for token ids.

All blocks share one table of frequencies. A block holds up to BLOCK ids, which LANES interleaved states code in turn, and
can be decoded by itself; so can each part of it between two checkpoints. Blocks of equal length are coded side by side.

Where more ids occur than the table has room for, the rarest share its last entry, the escape; a block that has such ids
carries them whole behind its words, in order.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20  # bits: frequencies sum up to 2 ** SCALE
BLOCK = 1 << 16
LANES = 32
EVERY = 512  # steps between two checkpoints; a step codes one id a lane
LOW = np.uint64(1 << 31)  # states lie from here to 2 ** 32 times this
MAGIC, MAGIC_RARE = b"KHT1", b"KHT2"  # without and with ids behind the words
HEAD = struct.Struct("<4sIII")  # magic, ids, checkpoints, words
U = np.uint64


def table(counts: np.ndarray) -> np.ndarray:
    """Frequencies for these counts: each id that occurs has at least 1, all sum up to 2 ** SCALE (or 0 without any)."""
    counts = np.asarray(counts, dtype=np.int64)
    total, room = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), dtype=np.int64)
    seen = counts > 0
    if int(seen.sum()) > room:
        raise ValueError("more different ids than the scale has room for")
    freq = np.where(seen, np.maximum(1, (counts.astype(np.float64) / total * room).astype(np.int64)), 0)
    over = int(freq.sum()) - room
    for i in np.lexsort((np.arange(len(freq)), -freq)):  # the most frequent ids bear the rounding
        if not over:
            break
        step = min(over, int(freq[i]) - 1) if over > 0 else over
        freq[i] -= step
        over -= step
    return freq


class Coder:
    """escapes: the last entry of ``freq`` is for all ids that have none of their own."""

    def __init__(self, freq: np.ndarray, escapes: bool = False) -> None:
        self.freq = freq.astype(U)
        self.escape = len(freq) - 1 if escapes else None
        self.below = (np.cumsum(freq) - freq).astype(U)
        self.of_slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        """Each of these arrays of 1 to BLOCK ids as a block; those of BLOCK ids are coded side by side."""
        out: list[bytes] = [b""] * len(blocks)
        for ids in blocks:
            if not 0 < len(ids) <= BLOCK:
                raise ValueError(f"a block of {len(ids)} ids; 1 to {BLOCK} can be coded")
        blocks, rare = self._known(blocks)
        for ids in blocks:
            if int(ids.max()) >= len(self.freq) or not self.freq[ids].all():
                raise ValueError("an id that the table hasn't")
        full = [i for i, ids in enumerate(blocks) if len(ids) == BLOCK]
        if full:
            for i, data in zip(full, self._blocks(np.stack([blocks[i] for i in full]).astype(np.int64).reshape(len(full), -1, LANES), BLOCK, [rare[i] for i in full])):
                out[i] = data
        for i, ids in enumerate(blocks):
            if len(ids) < BLOCK:
                fill = np.full(-len(ids) % LANES, ids[0])  # the last step's idle lanes code an id that costs little
                out[i] = self._blocks(np.concatenate((ids, fill)).astype(np.int64).reshape(1, -1, LANES), len(ids), [rare[i]])[0]
        return out

    def _known(self, blocks: list[np.ndarray]) -> tuple[list[np.ndarray], list[bytes]]:
        """The blocks with the escape for each id without an entry, and these ids as bytes."""
        if self.escape is None:
            return blocks, [b""] * len(blocks)
        out, rare = [], []
        for ids in blocks:
            own = ids < self.escape
            own &= self.freq[np.where(own, ids, self.escape)] > 0
            out.append(np.where(own, ids, self.escape))
            rare.append(ids[~own].astype("<u4").tobytes())
        return out, rare

    def _blocks(self, ids: np.ndarray, size: int, rare: list[bytes]) -> list[bytes]:
        blocks, steps, _ = ids.shape
        x = np.full((blocks, LANES), LOW)
        out = np.zeros((blocks, steps, LANES), dtype=np.uint32)
        sent = np.zeros((blocks, steps, LANES), dtype=bool)
        states = [x]  # when decoding has come to steps, and then to each checkpoint
        bits = U(63 - SCALE)
        for k in range(steps - 1, -1, -1):
            now = ids[:, k]
            f = self.freq[now]
            full = x >= f << bits
            sent[:, k] = full
            out[:, k] = x  # the lower half
            x = x >> (full.astype(U) << U(5))
            q = x // f
            x = x + q * (U(1 << SCALE) - f) + self.below[now]
            if k % EVERY == 0:
                states.append(x)
        states = np.stack(states[:0:-1], axis=1)
        done = []
        for i in range(blocks):
            at = np.concatenate(([0], np.cumsum(sent[i].sum(axis=1))))[np.arange(0, steps, EVERY)]
            words = out[i][sent[i]]
            body = at.astype("<u4").tobytes() + states[i].astype("<u8").tobytes() + words.astype("<u4").tobytes()
            body += rare[i]
            head = HEAD.pack(MAGIC_RARE if rare[i] else MAGIC, size, len(at), len(words))
            done.append(head + body + struct.pack("<I", zlib.crc32(head + body)))
        return done

    def decode(self, blocks: list[bytes]) -> list[np.ndarray]:
        """The ids of each block; parts between checkpoints are decoded side by side. A block that was changed: ValueError."""
        states, words, starts, sizes, steps, offset, rare = [], [], [], [], [], 0, []
        for raw in blocks:
            if len(raw) < HEAD.size + 4 or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
                raise ValueError("a block's checksum doesn't fit")
            magic, size, points, n = HEAD.unpack_from(raw)
            if magic not in (MAGIC, MAGIC_RARE):
                raise ValueError("not a block of token ids")
            at = HEAD.size
            starts.append(np.frombuffer(raw, "<u4", points, at).astype(np.int64) + offset)
            states.append(np.frombuffer(raw, "<u8", points * LANES, at + 4 * points).reshape(points, LANES))
            words.append(np.frombuffer(raw, "<u4", n, at + points * (4 + 8 * LANES)))
            rare.append(np.frombuffer(raw[:-4], "<u4", -1, at + points * (4 + 8 * LANES) + 4 * n) if magic == MAGIC_RARE else None)
            offset += n
            total = -(-size // LANES)
            steps.append(np.minimum(EVERY, total - np.arange(points) * EVERY))
            sizes.append(size)
        if not blocks:
            return []
        steps = np.concatenate(steps)
        order = np.argsort(-steps, kind="stable")  # parts that still run come first
        x, at = np.concatenate(states).astype(U)[order], np.concatenate(starts)[order]
        words = np.concatenate([*words, np.zeros(LANES, dtype=np.uint32)]).astype(U)
        out = np.zeros((len(order), EVERY, LANES), dtype=np.uint32)
        running = steps[order]
        live, mask = len(order), U((1 << SCALE) - 1)
        for k in range(int(steps.max())):
            while live and running[live - 1] <= k:
                live -= 1
            y = x[:live]
            slot = y & mask
            s = self.of_slot[slot.view(np.int64)]
            out[:live, k] = s
            y = self.freq[s] * (y >> U(SCALE)) + slot - self.below[s]
            need = y < LOW
            number = np.count_nonzero(need, axis=1)
            lanes = np.flatnonzero(need)  # by part, and then by lane, as the words are
            flat, end = y.ravel(), np.cumsum(number)
            flat[lanes] = flat[lanes] << U(32) | words[np.repeat(at[:live] - end + number, number) + np.arange(len(lanes))]
            at[:live] += number
            x[:live] = y
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        found, first = [], 0
        for size, whole in zip(sizes, rare):
            points = -(-(-(-size // LANES)) // EVERY)
            ids = out[back[first : first + points]].reshape(-1, LANES)
            ids = ids.reshape(-1)[:size]
            if whole is not None:
                escaped = np.flatnonzero(ids == self.escape) if self.escape is not None else whole[:0]
                if len(escaped) != len(whole):
                    raise ValueError("a block's rare ids don't fit its table")
                ids[escaped] = whole
            found.append(ids)
            first += points
        return found


_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32; the highest bit stands for 1."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def _squares() -> list[int]:
    """The powers of x that 1, 2, 4 and so on zero bytes are worth."""
    out = [1 << 23]
    for _ in range(63):
        out.append(_times(out[-1], out[-1]))
    return out


_SQUARES = _squares()


def crc32_joined(a: int, b: int, size: int) -> int:
    """crc32 of two byte strings in a row from that of each; size: bytes of the second."""
    for i in range(size.bit_length()):
        if size >> i & 1:
            a = _times(a, _SQUARES[i])
    return a ^ b
