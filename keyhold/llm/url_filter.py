"""URL filters: a trie over reversed host labels and path segments, with the longest rule deciding."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyhold.llm.shared import free

BLOCK = 500_000  # rules of a trie; more rules go into further tries, which each URL passes in turn
_LOWER = {i: i + 32 for i in range(65, 91)}


def parts(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty for null or a URL without ``://``."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest, end = url[at + 3 :], len(url)
    for c in "?#":
        end = len(rest) if (i := rest.find(c)) < 0 else i
        rest = rest[:end]
    slash = rest.find("/")
    return (rest, "") if slash < 0 else (rest[:slash], rest[slash:])


class Trie:
    """Rules by reversed host labels, then by the path's whole segments; a path's last segment may be a beginning."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        """rules: (verdict, host, path). Of two verdicts for one host and path, block holds."""
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})  # the paths of this host
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, {})
            if ends.get(last, ("", ""))[0] != "block":
                ends[last] = (verdict, host.translate(_LOWER) + path)

    def find(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """(host labels, path characters, rule, verdict) of the longest rule that fits: most labels, then most path."""
        best, node, depth = None, self.root, 0
        if not host:
            return None
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node, depth = node.get(label), depth + 1
            if node is None:
                break
            if None in node and (found := self._path(node[None], segments)):
                best = (depth, *found)
        return best

    @staticmethod
    def _path(node: dict, segments: list[str]) -> tuple[int, str, str] | None:
        best, before = None, 0
        for s in segments:
            if ends := node.get(None):
                for n in range(len(s), -1, -1) if len(ends) > 8 else sorted({len(e) for e in ends}, reverse=True):
                    if n <= len(s) and (hit := ends.get(s[:n])):
                        best = before + n, hit[1], hit[0]
                        break
            node, before = node.get(s), before + len(s) + 1
            if node is None:
                break
        return best


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], otherwise: str = "allow", url_col: str = "url", block: int = BLOCK) -> DataFrame:
    """The rows of ``pages`` with host, path, rule and verdict; columns of these names are replaced.

    rules: (verdict, host, path), host without scheme; a rule fits its host and all subdomains, if the path starts with
    the rule's. The longest decides: the one whose host has most labels, then the longest path. No rule fits: rule null,
    verdict ``otherwise``; so too for null or odd URLs, whose host and path are empty. An empty table gives no rows.
    """
    spark = pages.sparkSession
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    at, hit = free(pages, "url"), free(pages, "found")
    url = F.col(f"`{url_col}`").cast("string").alias(at)
    out = pages.select(*[F.col(f"`{c}`") for c in own], url)
    state = T.StructType([T.StructField(n, k) for n, k in (("labels", T.IntegerType()), ("chars", T.IntegerType()), ("rule", T.StringType()), ("verdict", T.StringType()))])
    last = T.StructType([*[pages.schema[c] for c in own], T.StructField(at, T.StringType()), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField(hit, state)])
    kind = pa.struct([("labels", pa.int32()), ("chars", pa.int32()), ("rule", pa.string()), ("verdict", pa.string())])
    for i in range(0, max(1, len(rules)), block):
        trie = spark.sparkContext.broadcast(Trie(rules[i : i + block]))
        first = i == 0

        def run(batches: Iterator[pa.RecordBatch], trie=trie, first=first) -> Iterator[pa.RecordBatch]:
            find = trie.value.find
            for b in batches:
                where = [parts(u) for u in b[at].to_pylist()]
                where = [(h.translate(_LOWER), p) for h, p in where]
                found = [find(h, p) for h, p in where]
                if not first:
                    old = [f and tuple(f.values()) for f in b[hit].to_pylist()]
                    found = [max((x for x in (f, o) if x), key=lambda x: (*x[:2], x[3] == "block"), default=None) for f, o in zip(found, old)]
                rows = pa.array([f and dict(zip(("labels", "chars", "rule", "verdict"), f)) for f in found], kind)
                hosts, paths = (pa.array([w[k] for w in where], pa.string()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*[b[c] for c in own], b[at], hosts, paths, rows], [*own, at, "host", "path", hit])

        out = out.mapInArrow(run, last)
    return out.select(*own, "host", "path", F.col(f"{hit}.rule").alias("rule"), F.coalesce(f"{hit}.verdict", F.lit(otherwise)).alias("verdict"))
