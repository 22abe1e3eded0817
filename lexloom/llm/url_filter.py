"""URL filters: a broadcast trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import bounded_broadcast

#: (verdict, rule); a rule is ``host/path``, its path begins at the first slash.
Rule = tuple[str, str]
MAX_TRIE_BYTES = 256 << 20

_HEAD = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _HEAD, 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _HEAD, 2)


class Trie:
    """Rules under their reversed host labels, then under their path segments.

    A node is ``[children by label, path node]``; a path node is ``[children by
    segment, {partial last segment: rule index}, their lengths from the
    longest]``, so that of a url's segment only those lengths are looked at.  A segment ends with its
    slash; what follows the last slash of a rule's path is partial and fits any
    text that begins with it.  The rule of most host labels wins, then that of
    the longest path, then a block entry before an allow entry.
    """

    def __init__(self, rules: Sequence[Rule]):
        self.rules: list[Rule] = []
        self.root: list = [{}, None]
        best: dict[tuple[str, str], str] = {}
        for verdict, rule in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            host, slash, path = rule.partition("/")
            key = (host.lower(), slash + path)
            if best.get(key) != "block":
                best[key] = verdict
        for (host, path), verdict in sorted(best.items()):
            self._add(host, path, len(self.rules))
            self.rules.append((verdict, host + path))

    def _add(self, host: str, path: str, index: int) -> None:
        node = self.root
        for label in reversed(host.split(".")) if host else ():
            node = node[0].setdefault(label, [{}, None])
        if node[1] is None:
            node[1] = [{}, {}, []]
        at = node[1]
        *whole, rest = path.split("/")
        for segment in whole:
            at = at[0].setdefault(segment, [{}, {}, []])
        at[1][rest] = index
        at[2] = sorted({*at[2], len(rest)}, reverse=True)

    def size(self) -> int:
        return sum(200 + 4 * len(r) for _, r in self.rules)

    @staticmethod
    def _longest(at: list, path: str) -> int | None:
        found = None
        parts = path.split("/")
        for i, segment in enumerate(parts):
            for k in at[2]:
                if k <= len(segment) and segment[:k] in at[1]:
                    found = at[1][segment[:k]]
                    break
            if i == len(parts) - 1 or segment not in at[0]:
                break
            at = at[0][segment]
        return found

    def match(self, host: str, path: str) -> int | None:
        """Index of the winning rule, or None."""
        node, ends = self.root, []
        if node[1] is not None:
            ends.append(node[1])
        for label in reversed(host.split(".")) if host else ():
            node = node[0].get(label)
            if node is None:
                break
            if node[1] is not None:
                ends.append(node[1])
        for at in reversed(ends):
            if (found := self._longest(at, path)) is not None:
                return found
        return None


def judge_urls(df: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow", keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns with host, path, rule and verdict of every row.

    A null url, or one without ``://``, has an empty host and path and gets
    ``default``, as does any url that no rule fits.  Rows are judged one by
    one: repeated rows and ties need no care, an empty table gives no rows, and
    further columns of ``df`` are ignored unless kept.  No shuffle.
    """
    clash = {"host", "path", "rule", "verdict"} & set(keep)
    if clash:
        raise ValueError(f"kept columns would clash: {sorted(clash)}")
    trie = Trie(rules)
    shared = bounded_broadcast(df.sparkSession, trie, trie.size(), MAX_TRIE_BYTES)
    base = df.select(*[F.col(f"`{k}`") for k in keep], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))

    def run(batches):
        t = shared.value
        for b in batches:
            hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
            found = [t.match(h, p) for h, p in zip(hosts, paths)]
            rule = pa.array([None if i is None else t.rules[i][1] for i in found], pa.string())
            verdict = pa.array([default if i is None else t.rules[i][0] for i in found], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, rule, verdict], names=[*b.schema.names, "rule", "verdict"])

    schema = T.StructType([*base.schema.fields]).add("rule", "string").add("verdict", "string")
    return base.mapInArrow(run, schema)
