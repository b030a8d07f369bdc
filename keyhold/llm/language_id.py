"""Language identification by rank-order n-gram profiles.

A profile is a language's most frequent character n-grams, in order. A document's most frequent n-grams are compared with
each profile by out-of-place distance: how far each n-gram's rank is from its rank in the profile, and the length of a
profile for one that isn't there. The nearest language wins.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keyhold.llm.shared import released, texts

RANKS = 300  # n-grams of a profile, and at most of a document
MAX_N = 3  # characters of the longest n-gram; three code points fit a 63-bit code
UNKNOWN = "und"
LEAST = 0.2  # score below which the pipeline takes no language for known
WORDS = 20_000  # words whose n-grams are counted at a time
PARTS = 32  # counts of that many are summed up at once
_WORD = regex.compile(r"\p{L}+")


def grams(words: list[str]) -> np.ndarray:
    """Codes of the n-grams of all words; a space opens and closes each, and the lone space isn't one."""
    p = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    two = p[:-1] << 21 | p[1:]
    three = (two[:-1] << 21 | p[2:])[p[1:-1] != 32]
    return np.concatenate((p[p != 32], two, three))


def counted(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The different n-gram codes of the words, in order, and how often each occurs."""
    parts = [np.unique(grams(words[i : i + WORDS]), return_counts=True) for i in range(0, len(words), WORDS)]
    return summed(parts) if len(parts) != 1 else parts[0]


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(codes)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Positions of the most frequent codes; the smaller code goes first among equals."""
    if len(codes) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        at = np.flatnonzero(counts >= least)
    else:
        at = np.arange(len(codes))
    return at[np.lexsort((codes[at], -counts[at]))][:most]


@dataclass(frozen=True)
class Profiles:
    """langs in order; entries: a row (n-gram code, position of its language, rank there) for each n-gram of each profile."""

    langs: list[str]
    entries: np.ndarray


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of every row with a text and a label. N-grams are counted over all of them, in each task and then overall.

    What comes to the driver is RANKS n-grams a language. Rows with a null text or label, and texts without letters, don't
    count; repeated rows count each time. An empty table gives profiles of no language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words: dict[str, list[str]] = defaultdict(list)
            parts: dict[str, list] = defaultdict(list)
            for lang, text in zip(b["lang"].to_pylist(), texts(b["text"])):
                words[lang] += _WORD.findall(text.lower())
                if len(words[lang]) > WORDS:
                    parts[lang].append(counted(words.pop(lang)))
                    if len(parts[lang]) > PARTS:
                        parts[lang] = [summed(parts[lang])]
            for lang, rest in words.items():
                if rest:
                    parts[lang].append(counted(rest))
            for lang, some in parts.items():
                codes, n = summed(some)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), lang, dtype=object), pa.string()), pa.array(codes), pa.array(n)], ["lang", "gram", "n"])

        released()

    rows = labelled.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")).dropna()
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("place") <= RANKS)
    found = top.select("lang", "gram", (F.col("place") - 1).alias("rank")).collect()  # RANKS rows a language
    langs = sorted({r.lang for r in found})
    place = {x: i for i, x in enumerate(langs)}
    return Profiles(langs, np.array([(r.gram, place[r.lang], r.rank) for r in found], dtype=np.int64).reshape(-1, 3))


class Judge:
    """Judges texts."""

    def __init__(self, profiles: Profiles) -> None:
        self.langs = profiles.langs
        code, self.lang, self.rank = profiles.entries[np.lexsort((profiles.entries[:, 1], profiles.entries[:, 0]))].T
        self.codes, self.first = np.unique(code, return_index=True)
        self.number = np.diff(np.append(self.first, len(code)))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The language, and 1 less the distance as a share of the greatest there can be."""
        words = _WORD.findall((text or "").lower())
        if not words or not self.langs:
            return UNKNOWN, 0.0
        codes, counts = counted(words)
        top = codes[ranked(codes, counts, RANKS)]
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        own = np.flatnonzero(self.codes[at] == top)  # ranks of n-grams that any profile has
        n = self.number[at[own]]
        entry = np.repeat(self.first[at[own]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        nearer = RANKS - np.abs(self.rank[entry] - np.repeat(own, n))
        total = RANKS * len(top) - np.bincount(self.lang[entry], weights=nearer, minlength=len(self.langs)).astype(np.int64)
        best = int(np.argmin(total))
        return self.langs[best], float(1 - total[best] / (RANKS * len(top)))


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (default: all but lang_pred and score, which are replaced), lang_pred and score (0 to 1).

    Whole texts are read. A null text, one without letters, or no profiles at all: ``und`` and 0. Equal distances: the
    language that sorts first.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")] if keep is None else keep
    fields, judged = [docs.schema[c] for c in keep], "judged"
    while judged in keep:
        judged += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles)
        for b in batches:
            found = [judge(t) for t in texts(b[judged])]
            cols = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], *cols], [*keep, "lang_pred", "score"])
        released()

    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(judged)).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a row is kept from training: crc32 of its id as text, in fives; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def keep_known(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known; profiles from the rows with a label that aren't held out.

    Rejected are texts that are null or have no letters, and those whose score is below ``least``: too far from every
    profile, as texts of a language that has none. Repeated rows are kept or go together. Without any label all go. An
    empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if len(own) < len(docs.columns):
        kept = identify(docs.select(*[F.col(f"`{c}`").alias(f"own {c}") for c in docs.columns], "text"), train(docs.filter(~held_out())))
        return kept.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*[F.col(f"`own {c}`").alias(c) for c in docs.columns])
    found = identify(docs, train(docs.filter(~held_out())))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(docs.columns)
