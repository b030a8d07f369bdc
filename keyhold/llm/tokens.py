"""Token ids of whole texts by a public tokenizer file, through the tokenizers library.

Both supported kinds cut a text into words before they merge, so a word's ids don't depend on its neighbours: of all the
texts at hand, the library encodes each different word once, and texts are put together from that.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

HELD = 150_000  # entries of a young generation; see Held
HELD_BYTES = 1 << 25  # characters and bytes of them
KNOWN = 500_000  # the same for the encoder; see Known
SLICE = 1 << 23  # bytes of texts that are encoded at a time; a longer text is a slice of its own
#: Fixed value: how the byte-level kind cuts a text into words.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters alone are cut here; they are their own NFC, and lower-case one by one. Others go whole to the library.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7E\xA1-\u012F\u0131-\u02FF\u0390-\u03A1\u03A4-\u03FF\u0400-\u0482\u048A-\u052F\u2010-\u2027\u2030-\u205E\u3001-\u3003\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3]*+")
#: The same for RE2: a character of another kind; and white space at which a byte-level text can't be cut.
_ODD = r"[^\t\n\r\x20-\x7E\xA1-\x{012F}\x{0131}-\x{02FF}\x{0390}-\x{03A1}\x{03A4}-\x{03FF}\x{0400}-\x{0482}\x{048A}-\x{052F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{3001}-\x{3003}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]"
_LOOSE = r"  | \n|\n |[\t\r]|\A | \z"


class Held:
    """A memory of bounded size for what words come to: entries move on to an old generation once it is full, in number or
    in bytes, and what hasn't been used again when the next one is full is forgotten."""

    def __init__(self, make: Callable[[list[str]], Iterable[bytes]], most: int = HELD, most_bytes: int = HELD_BYTES) -> None:
        self.make, self.most, self.most_bytes = make, most, most_bytes
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bytes = 0  # of the young

    def all(self, words: list[str]) -> list[bytes]:
        """What each word comes to; ``make`` gives it for those that aren't held."""
        missing = set(words).difference(self.young)
        if missing:
            if len(self.young) + len(missing) > self.most:
                self._age()
                missing = set(words)
            self._find(missing)
        out = list(map(self.young.__getitem__, words))
        if self.bytes > self.most_bytes:
            self._age()
            if self.bytes > 2 * self.most_bytes:  # these words alone are more than may be held
                self.old = {}
            self.bytes = 0
        return out

    def _age(self) -> None:
        self.young, self.old = {}, self.young

    def _find(self, missing: set[str]) -> None:
        if not self.young:
            self.bytes = 0
        found = {w: self.old[w] for w in missing if w in self.old} if self.old else {}
        new = [w for w in missing if w not in found] if found else list(missing)
        self.young.update(found)
        for i in range(0, len(new), 10_000):
            found.update(zip(new[i : i + 10_000], self.make(new[i : i + 10_000])))
        self.young.update(found)
        self.bytes += sum(map(len, found)) + sum(map(len, found.values()))


class Known:
    """As :class:`Held`, for the encoder: strings and their ids lie in Arrow and numpy, a fifth of the memory that a dict takes."""

    def __init__(self, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], most: int = KNOWN, most_bytes: int = HELD_BYTES) -> None:
        self.make, self.most, self.most_bytes = make, most, most_bytes
        self.young = self.old = _NOTHING  # strings, their ids in a row, how many each has

    def all(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each string begin and how many they are; ``make`` gives (ids, sizes) of what isn't held."""
        pool, start, size = [], np.zeros(len(found), dtype=np.int64), np.zeros(len(found), dtype=np.int64)
        left, fresh = np.arange(len(found)), np.arange(len(found))  # places not yet found; those not found among the young
        at = 0
        for held in (self.young, self.old, None):
            if held is None:
                own = found if len(left) == len(found) else found.take(pa.array(left))
                held = (own, *(self.make(own) if len(own) else _NOTHING[1:]))
                which, hit = np.arange(len(left)), np.ones(len(left), dtype=bool)
            else:
                own = found if len(left) == len(found) else found.take(pa.array(left))
                which = pc.index_in(own, value_set=held[0]).fill_null(-1).to_numpy()
                hit = which >= 0
            _, ids, sizes = held
            begin = np.cumsum(sizes) - sizes
            start[left[hit]], size[left[hit]] = begin[which[hit]] + at, sizes[which[hit]]
            pool.append(ids)
            at += len(ids)
            left = left[~hit]
            if len(pool) == 1:
                fresh = left
        ids = np.concatenate(pool)
        self._keep(found, fresh, ids, start, size)
        return ids, start, size

    def _keep(self, found: pa.Array, fresh: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        words, known, sizes = self.young
        if len(words) + len(fresh) > self.most or words.nbytes + known.nbytes > self.most_bytes:
            self.young, self.old = _NOTHING, self.young
            words, known, sizes = _NOTHING
            fresh = np.arange(len(found))
        if len(fresh):
            more, own = found.take(pa.array(fresh)), taken(ids, start, size, fresh)[0]
            if more.nbytes + own.nbytes <= self.most_bytes:
                self.young = pa.concat_arrays([words, more]), np.concatenate((known, own)), np.concatenate((sizes, size[fresh]))


_NOTHING = pa.array([], pa.large_string()), np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)


def _matches(texts: pa.Array, pattern: str) -> np.ndarray:
    """Which texts the pattern is found in; an empty one is found nowhere."""
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False) if pattern else np.zeros(len(texts), dtype=bool)


def spaced(text: str) -> bool:
    """Whether a plain byte-level text can be cut at its spaces so that no word lies in two runs: a space beside other white
    space belongs to it or to the next word by what follows."""
    return not ("  " in text or " \n" in text or "\n " in text or "\t" in text or "\r" in text or text[:1] == " " or text[-1:] == " ")


def runs(text: str, byte_level: bool) -> list[str] | None:
    """A plain text cut at its spaces, so that no word lies in two runs; None where that can't be done."""
    if not byte_level:
        return text.split()
    return text.split(" ") if spaced(text) else None


class Encoder:
    """Ids as the library's encode(text, add_special_tokens=False) gives them."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        self.special = "|".join(re.escape(t["content"]) for t in spec["added_tokens"])
        kind, self.cut = _words(spec)
        self.lower = kind == "lower"
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        most = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.size, self.closes = np.zeros(most, dtype=np.int64), np.zeros(most, dtype=bool)  # bytes of a token; whether it ends a word
        for t, i in vocab.items():
            self.size[i], self.closes[i] = len(t), bool(suffix) and t.endswith(suffix)
        self.words, self.runs = Known(self._of_words), Known(self._of_runs)

    def _of_words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has; some thousands are encoded at a time."""
        parts = [self._of_some(column.slice(i, 10_000)) for i in range(0, len(column), 10_000)]
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([size for _, size in parts])

    def _of_some(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words in one text cost the library far less than words by themselves; those that such a text would cut
        otherwise, or whose ids don't end where the word does, are encoded by themselves."""
        joint = np.ones(len(column), dtype=bool) if self.lower else _apart(column)
        together = column if joint.all() else column.filter(pa.array(joint))
        found = self._together(together) if len(together) else None
        if found is None:
            joint, found = np.zeros(len(column), dtype=bool), _NOTHING[1:]
        if joint.all():
            return found
        each = [e.ids for e in self.library.encode_batch_fast(column.filter(pa.array(~joint)).to_pylist(), add_special_tokens=False)]
        size = np.zeros(len(column), dtype=np.int64)
        size[joint], size[~joint] = found[1], [len(x) for x in each]
        ids = np.concatenate((found[0], np.fromiter((i for x in each for i in x), np.uint32)))
        order = np.concatenate((np.flatnonzero(joint), np.flatnonzero(~joint)))
        start = np.empty(len(column), dtype=np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        return taken(ids, start, size, np.arange(len(column)))[0], size

    def _together(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        text = _content(_around("", words, " ") if self.lower else words)
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
        if self.lower:
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(words) or ends[-1] != len(ids):
                return None
        else:
            size, want = np.cumsum(self.size[ids]), _bytes(words)[1][1:]
            ends = np.searchsorted(size, want)
            if size[-1] != want[-1] or (size[ends] != want).any():
                return None
            ends += 1
        return ids, np.diff(ends, prepend=0)

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words in a row, and where those of each end."""
        each = pa.array(words, pa.large_string()).dictionary_encode()
        return taken(*self.words.all(each.dictionary), each.indices.to_numpy())

    def _of_runs(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs, and how many each has."""
        words, first, end = self._cut(found)
        ids, stop = self._joined(words)
        at = np.concatenate(([0], stop))
        size = at[end] - at[first]
        return taken(ids, at[first], size, np.arange(len(found)))[0], size

    def _cut(self, found: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words, and which of them are each run's: from first to end. Runs are cut together where that can't join words of
        two: if a space is between, or if each begins with its own one, and no other white space is at either end."""
        if self.lower:  # a space after each
            joint, safe = _around("", found, " "), np.ones(len(found), dtype=bool)
        else:
            safe = _apart(found)
            joint = found if safe.all() else found.filter(pa.array(safe))
        words = self.cut.findall(_content(joint))
        length = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))
        number = np.zeros(len(found), dtype=np.int64)
        size = pc.utf8_length(joint).to_numpy() - (1 if self.lower else 0)
        number[safe] = np.diff(np.searchsorted(length, np.cumsum(size)), prepend=0)
        for i in np.flatnonzero(~safe).tolist():
            own = self.cut.findall(found[i].as_py())
            words += own
            number[i] = len(own)
        end = np.empty(len(found), dtype=np.int64)
        order = np.concatenate((np.flatnonzero(safe), np.flatnonzero(~safe)))
        end[order] = np.cumsum(number[order])
        return words, end - number, end

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids (uint32) of all texts in a row, and where those of each end; a null text counts as empty."""
        column = pa.array(["" if t is None else t for t in texts], pa.large_string())
        # whole texts of other characters, or of an unknown kind, go to the library
        odd = np.ones(len(texts), dtype=bool) if self.cut is None else _matches(column, _ODD) | _matches(column, self.special)
        loose = np.zeros(len(texts), dtype=bool) if self.lower else _matches(column, _LOOSE) & ~odd
        alone: dict[int, bytes] = {i: np.array(self.library.encode(texts[i] or "", add_special_tokens=False).ids, dtype=np.uint32).tobytes() for i in np.flatnonzero(odd).tolist()}
        cut = [self.cut.findall(texts[i]) for i in np.flatnonzero(loose).tolist()]
        if cut:
            own, stop = self._joined([w for words in cut for w in words])
            at = np.concatenate(([0], stop))[np.cumsum([0, *map(len, cut)])].tolist()
            alone |= {i: own[lo:hi].tobytes() for i, lo, hi in zip(np.flatnonzero(loose).tolist(), at, at[1:])}
        rest = ~(odd | loose)
        plain = np.flatnonzero(rest).tolist()
        ids, ends = self._plain(column if rest.all() else column.filter(pa.array(rest)))
        if not alone:
            return ids, ends
        # put the others between them
        own = dict(zip(plain, np.split(ids, ends[:-1])))
        parts = [own[i] if i in own else np.frombuffer(alone[i], dtype=np.uint32) for i in range(len(texts))]
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

    def _plain(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As batch, of plain texts that can be cut at their spaces: each different run between spaces is encoded once."""
        if not len(col):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        cut = pc.ascii_split_whitespace(col) if self.lower else pc.split_pattern(col, " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        each = cut.flatten().dictionary_encode()
        run, found = each.indices.to_numpy().astype(np.int64), each.dictionary
        if self.lower:
            found = pa.array([x.lower() for x in found.to_pylist()], pa.large_string())
        else:  # a run has the space before it, but for a text's first one
            first, back = np.unique(run[bounds[:-1]], return_inverse=True)
            run[bounds[:-1]] = len(found) + back
            found = pa.concat_arrays([_around(" ", found, ""), found.take(pa.array(first))])
        ids, end = taken(*self.runs.all(found), run)
        return ids, np.concatenate(([0], end))[bounds[1:]]

    def __call__(self, text: str | None) -> np.ndarray:
        """uint32 ids; a null text counts as empty."""
        return self.batch([text])[0]


def _around(before: str, runs: pa.Array, after: str) -> pa.Array:
    kind = pa.large_string()
    return pc.binary_join_element_wise(pa.scalar(before, kind), runs, pa.scalar(after, kind), pa.scalar("", kind))


def _bytes(runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all runs in a row, and where each ends (with a 0 in front)."""
    ends = np.frombuffer(runs.buffers()[1], dtype=np.int64)[runs.offset : runs.offset + len(runs) + 1]
    data = runs.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, dtype=np.uint8), ends - ends[0]


def _content(runs: pa.Array) -> str:
    return _bytes(runs)[0].tobytes().decode()


def _apart(runs: pa.Array) -> np.ndarray:
    """Which runs are a space and more, with no white space behind it or at the end. Plain texts have but that of ASCII."""
    data, ends = _bytes(runs)
    white = np.zeros(256, dtype=bool)
    white[[9, 10, 13, 32]] = True
    ok = np.diff(ends) > 1
    first = ends[:-1][ok]
    ok[ok] = (data[first] == 32) & ~white[data[first + 1]] & ~white[data[ends[1:][ok] - 1]]
    return ok


def taken(ids: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of these parts, one after the other, and where those of each end."""
    n = size[which]
    end = np.cumsum(n)
    return ids[np.repeat(start[which] - end + n, n) + np.arange(int(n.sum()))], end


def closed(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and ends of a batch with the end id after each text."""
    return np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, end) of the rows that are encoded at a time."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > first and held + n > SLICE:
            yield first, i
            first, held = i, 0
        held += n
    if len(size):
        yield first, len(size)


def _words(spec: dict) -> tuple[str, regex.Pattern | None]:
    """How a tokenizer cuts; None for one that isn't known to keep words apart, which then gets whole texts."""
    norm, pre = spec["normalizer"], spec["pre_tokenizer"]
    if norm is None and pre["type"] == "ByteLevel" and pre.get("use_regex") and not pre["add_prefix_space"]:
        return "byte", regex.compile(BYTE_LEVEL)
    steps = [n["type"] for n in (norm or {}).get("normalizers", [])]
    if steps == ["NFC", "Replace", "Lowercase"] and pre["type"] == "Sequence" and pre["pretokenizers"][0]["type"] == "Split":
        return "lower", regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"])
    return "", None


_made: dict[str, Callable[[str | None], np.ndarray]] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
