"""BPE encoding as a streaming transducer, and decoding as a byte-to-text state machine.

A cut of a word into tokens is the merge list's own exactly if every two neighbours, joined and merged anew, come out as
these two tokens again. So each prefix of a word has one possible last token, which is found by looking back; and as no
token is longer than the merge list's longest, only the last few prefixes can still be built upon. That is the lookahead:
what all their chains of tokens have in common is stable, is emitted at once, and is forgotten.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyhold.llm.tokens import _PLAIN, BYTE_LEVEL, Held, runs

PORTION = 4096  # ids that go through the decoder at a time
HELD_PAIRS = 500_000  # pairs of tokens that a task remembers before it starts anew
HELD_STEPS = 200_000  # the same for steps along the starts of tokens


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class Transducer:
    """Tokens of words. A word's symbols are its characters; the last one carries ``suffix``."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.vocab, self.suffix = vocab, suffix
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.size = {}  # in symbols
        for a, b in merges:
            self.size[a + b] = self.size.get(a, 1) + self.size.get(b, 1)
        self.made = {a + b: (i, (a, b)) for i, (a, b) in enumerate(merges)}
        self.twofold = len(self.made) < len(merges)
        self.lookahead = max(self.size.values(), default=1)
        self._names = {t: t for t in vocab}  # one string a token
        bodies = {t[: len(t) - len(suffix)] if suffix and t.endswith(suffix) and len(t) > len(suffix) else t for t in vocab}
        self._begins = {body[:n] for body in bodies for n in range(1, len(body) + 1)}
        self._steps: dict[str, tuple[str, list[tuple[int, str]], list[tuple[int, str]]]] = {}
        self._fits: dict[tuple[str, str], bool] = {}
        self._own: dict[str, bool] = {}

    def _symbols(self, token: str) -> list[str]:
        s = self.suffix
        return [*token[: -len(s) - 1], token[-len(s) - 1 :]] if s and token.endswith(s) and len(token) > len(s) else list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """The merge list applied to a short run of symbols: the first rule that fits anywhere, leftmost, again and again."""
        rank, out = self.rank, list(symbols)
        while len(out) > 1:
            ranks = [rank.get(p, 1 << 30) for p in zip(out, out[1:])]
            least = min(ranks)
            if least == 1 << 30:
                break
            i, new = 0, []
            a, b = out[ranks.index(least)], out[ranks.index(least) + 1]
            while i < len(out):
                if i + 1 < len(out) and out[i] == a and out[i + 1] == b:
                    new.append(a + b)
                    i += 2
                else:
                    new.append(out[i])
                    i += 1
            out = new
        return out

    def own(self, token: str) -> bool:
        """Whether the merge list makes this token of its symbols."""
        known = self._own.get(token)
        if known is None:
            known = self._own[token] = token in self.vocab and self.merged(self._symbols(token)) == [token]
        return known

    def step(self, start: str) -> tuple[str, list[tuple[int, str]], list[tuple[int, str]]]:
        """Of what was read, the longest end that some token begins with: start (of it and the next symbol) cut down to one;
        and the tokens that end there, the longest first, with their symbols: within a word, and at its end."""
        known = self._steps.get(start)
        if known is None:
            if len(self._steps) > HELD_STEPS:
                self._steps.clear()
            at = start
            while at and at not in self._begins:
                at = at[1:]
            ends: list[list[tuple[int, str]]] = []
            for end in ("", self.suffix):
                tokens = ((n, at[len(at) - n :] + end) for n in range(len(at), 0, -1))
                ends.append([(n, self._names[t]) for n, t in tokens if t in self.vocab and (end or self._width(t) == n) and self.own(t)])
            known = self._steps[start] = (at, *ends)
        return known

    def fits(self, left: str, right: str) -> bool:
        """Whether the two stay apart when their symbols are merged together.

        Their last merges are undone one by one, the later one first, to see whether a rule across the boundary would
        have come before. Where a token can be made in two ways, the merge list itself is asked.
        """
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) > HELD_PAIRS:
                self._fits.clear()
            if self.twofold:
                known = self.merged(self._symbols(left) + self._symbols(right)) == [left, right]
            else:
                known = self._apart(left, right)
            self._fits[left, right] = known
        return known

    def _apart(self, left: str, right: str) -> bool:
        before = len(self.rank)
        while True:
            if self.rank.get((left, right), before) < before:
                return False
            (a, cut_a), (b, cut_b) = self.made.get(left, (-1, None)), self.made.get(right, (-1, None))
            if a == b == -1:
                return True
            if a > b:
                before, left = a, cut_a[1]
            else:  # of one rule's places, the left one comes first
                before, right = b + 1, cut_b[0]

    def tokens(self, chars: Iterable[str]) -> Iterator[str]:
        """The tokens of one word that comes in character by character; what is held doesn't grow with the word."""
        held, last, ahead = "", [""], iter(chars)  # last[i]: last token of the first i held symbols
        left = ""  # what was emitted before them
        steps, fits, at_start, many = self._steps, self._fits, "", 4 * self.lookahead
        now = next(ahead, None)
        while now is not None:
            nxt = next(ahead, None)
            held += now
            i, start = len(held), at_start + now
            at_start, inside, at_end = steps.get(start) or self.step(start)
            for n, t in at_end if nxt is None else inside:
                if n > i or (before := last[i - n]) is None:
                    continue
                before = before or left
                if before and (apart := fits.get((before, t))) is None:
                    apart = self.fits(before, t)
                if not before or apart:
                    last.append(t)
                    break
            else:
                last.append(None)  # no token ends here; it can't be the end of the word either
            now = nxt
            if i > many:
                at = self._shared(last)
                done = self._chain(last, at)
                if done:
                    yield from done
                    left, held, last = done[-1], held[at:], ["", *last[at + 1 :]]
        if held:
            if last[-1] is None:
                raise ValueError("a symbol that the vocabulary hasn't")
            yield from self._chain(last, len(held))

    def _width(self, token: str) -> int:
        return len(token) - (len(self.suffix) if self.suffix and token.endswith(self.suffix) else 0)

    def _shared(self, last: list[str | None]) -> int:
        """The last place that all chains from the final ``lookahead`` prefixes go through."""
        open_ = {i for i in range(len(last) - self.lookahead, len(last)) if last[i]}
        while len(open_) > 1:
            i = max(open_)
            open_.discard(i)
            open_.add(i - len(last[i]))
        return open_.pop()

    def _chain(self, last: list[str | None], at: int) -> list[str]:
        out = []
        while at:
            out.append(last[at])
            at -= self._width(last[at])
        return out[::-1]


class Codec:
    """encode and decode of a tokenizer file, as the library's with add_special_tokens=False and skip_special_tokens=False."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.transducer = Transducer(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lower = spec["normalizer"] is not None
        pre = spec["pre_tokenizer"]
        self.cut = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"] if pre["type"] == "Sequence" else BYTE_LEVEL)
        self.bytes = spec["decoder"] is not None
        self.chars = byte_chars()
        byte_of, special = {c: b for b, c in enumerate(self.chars)}, set(self.special.values())
        self.raw = {i: bytes(byte_of[c] for c in s) if i not in special and all(c in byte_of for c in s) else s.encode() for i, s in self.strings.items()} if self.bytes else {}
        self.words, self.runs = Held(lambda ws: map(self._word, ws)), Held(self._of_runs)

    def _plain(self, text: str) -> str:
        if not self.lower:
            return text
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # one by one: a final sigma is like any other

    def _word(self, word: str) -> bytes:
        symbols = word if word.isascii() and word.isprintable() and " " not in word else (self.chars[b] for b in word.encode("utf-8", "surrogatepass"))
        return array("I", map(self.transducer.vocab.__getitem__, self.transducer.tokens(symbols))).tobytes()

    def _of_runs(self, found: list[str]) -> Iterator[bytes]:
        space = "" if self.lower else " "
        cut = [[space + r] if r.isalpha() else self.cut.findall(space + r) for r in found]
        each = iter(self.words.all([w for ws in cut for w in ws]))
        return (b"".join(islice(each, len(ws))) for ws in cut)

    def _parts(self, text: str) -> Iterator[bytes]:
        for i, part in enumerate(self.at_special.split(text) if self.at_special else [text]):
            if i % 2:
                yield np.array([self.special[part]], dtype="<u4").tobytes()
            elif part:
                plain = _PLAIN.fullmatch(part)
                part = self._plain(part)
                found = runs(part, not self.lower) if plain else None
                if found is None:
                    yield from self.words.all(self.cut.findall(part))
                elif self.lower:
                    yield from self.runs.all(found)
                else:
                    yield from self.words.all(self.cut.findall(found[0]))
                    yield from self.runs.all(found[1:])

    def encode(self, text: str | None) -> np.ndarray:
        """Ids (uint32); a null text counts as empty."""
        return np.frombuffer(b"".join(self._parts(text or "")), dtype="<u4")

    def decode(self, ids: Iterable[int]) -> str:
        """What the state machine gives for these ids, fed to it in portions."""
        return "".join(self.texts(ids))

    def texts(self, ids: Iterable[int]) -> Iterator[str]:
        """The decoded text in portions, as the state machine gives it out; what is held doesn't grow with the ids."""
        machine, ahead = Decoder(self), iter(ids)
        while portion := list(islice(ahead, PORTION)):
            yield machine.feed(*portion)
        yield machine.end()


class Decoder:
    """Ids to text, one at a time or some. Byte-level files: bytes that don't yet make a character wait; what can't make one
    becomes U+FFFD. Files without a decoder: token strings with a space between, as the library does; the state is whether
    one has come before."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.first = codec, True
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, *ids: int) -> str:
        """The text that is certain once these ids have come; ids that the vocabulary hasn't give nothing."""
        if self.codec.bytes:
            raw = self.codec.raw
            return self.state.decode(b"".join([raw.get(i, b"") for i in ids]))
        strings = self.codec.strings
        found = list(map(strings.get, ids))
        if None in found:
            found = [s for s in found if s is not None]
        if not found:
            return ""
        out, self.first = " ".join(found) if self.first else " " + " ".join(found), False
        return out

    def end(self) -> str:
        return self.state.decode(b"", True)


_made: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a worker and file."""
    if path not in _made:
        _made[path] = Codec(path)
    return _made[path]


def _rows(docs: DataFrame, fields: list[str], of: Callable[[str | None], tuple], kinds: list[tuple[str, pa.DataType]], text_col: str) -> DataFrame:
    names = [k.split()[0] for k in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [of(t) for t in b["text"].to_pylist()]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *cols], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(fields))


def encoded(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of long) of every row's whole text; a null text has none. Other columns are not looked at."""
    return _rows(docs, ["ids array<bigint>"], lambda t: (codec(path).encode(t).astype(np.int64),), [pa.list_(pa.int64())], text_col)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give an empty text, ids that the vocabulary hasn't nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([c.decode(x or []) for x in b["ids"].to_pylist()], pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: digests of the ids and of what they decode to.

    A null text counts as empty; null and repeated ids stay as they are. Other columns are not looked at. An empty table
    gives no rows.
    """

    def of(text: str | None) -> tuple[int, str, str]:
        c = codec(path)
        ids, back = c.encode(text), hashlib.sha256()
        for part in c.texts(ids.tolist()):
            back.update(part.encode("utf-8", "surrogatepass"))
        return len(ids), hashlib.sha256(ids).hexdigest(), back.hexdigest()

    return _rows(docs, ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"], of, [pa.int64(), pa.string(), pa.string()], text_col)
