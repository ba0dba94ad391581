"""URL filter rules as a sort-merge range join.

A host is turned into a canonical key of its reversed labels (``www.example.com`` -> ``com.example.www.``). All hosts
under a rule's host are then the keys that begin with the rule's key: one interval of the sorted keys, and intervals of
two rules are nested or apart. Rows and rules are dealt out by key ranges, sorted, and swept once; the sweep keeps a
stack of the rules whose interval is open, and the longest of them whose path begins the url's path decides.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict)
Rule = tuple[str, str, str]

_RULE, _ROW = 0, 1
#: Characters of a path that borders of ranges are made of.
PATH_CHARS = 64


def url_host(url: Column) -> Column:
    """Host of a url: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """Path of a url: after the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit("."))


def _bounds(keys: DataFrame, parts: int) -> list[tuple[str, str]]:
    """Range borders from a bounded sample of (key, path), as a range partitioner takes them: at most 40 short keys a range reach the driver."""
    want = 20 * parts
    rows = keys.count()
    if rows <= parts:
        return []
    fraction = min(1.0, 1.5 * want / rows)
    got = sorted((r[0], r[1]) for r in keys.sample(fraction, 17).limit(2 * want).collect())
    return [got[i * len(got) // parts] for i in range(1, parts)] if got else []


@dataclass
class _Open:
    """Rules of one host whose interval is open, by the lengths of their paths, the longest first."""

    key: str
    lengths: list[int]
    rules: dict[str, tuple[str, str]]

    def fitting(self, path: str) -> tuple[str, str] | None:
        """The rule of the longest path that begins this one; a look-up for each length."""
        return next((self.rules[path[:n]] for n in self.lengths if path[:n] in self.rules and n <= len(path)), None)

    def add(self, path: str, rule: tuple[str, str]) -> None:
        self.rules[path] = rule
        if len(path) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(path)], reverse=True)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of (part, key, kind, ...): rules open before the rows of their interval."""
    part, stack = None, []
    for batch in batches:
        out = []
        cols = [batch.column(c).to_pylist() for c in ("part", "key", "kind", "path", "rule", "verdict")]
        for p, key, kind, path, rule, verdict in zip(*cols, strict=True):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if kind == _RULE:
                if not stack or stack[-1].key != key:
                    stack.append(_Open(key, [], {}))
                stack[-1].add(path, (rule, verdict))
                continue
            # Of rules of one length that of the longer host wins, which is higher on the stack.
            found = [x for x in (s.fitting(path) for s in stack) if x]
            out.append(max(reversed(found), key=lambda x: len(x[0]), default=(None, None)))
        keep = batch.filter(pc.equal(batch.column("kind"), _ROW))
        yield pa.RecordBatch.from_arrays(
            [keep.column("id"), keep.column("host"), keep.column("path"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())],
            ["id", "host", "path", "rule", "verdict"],
        )


def url_filter(pages: DataFrame, rules: Iterable[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", parts: int | None = None) -> DataFrame:
    """Judge every url by the longest fitting rule: (id, host, path, rule, verdict).

    A rule (host, path, verdict) fits its host and all subdomains if the url's path begins with the rule's path. The
    longest rule string (host + path) wins, of equally long ones the one with the longer host. Without a fitting rule
    ``rule`` is null and the verdict is ``default``. Null and malformed urls have an empty host and path and take the
    default. Repeated rows are judged each. Rows of one host may lie in several ranges: the sort key ends in the path,
    and rows are dealt by their own hash within a range border's ties, so a hot host or url doesn't fill one task.
    Rules may be a DataFrame of (host, path, verdict); repeated rules count once, the smallest verdict winning.
    """
    spark: SparkSession = pages.sparkSession
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    rules = (
        rules.where("host is not null and host <> ''")
        .select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
        .select(host_key(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict")
    )
    judged = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")).withColumn("key", host_key(F.col("host")))
    head = F.substring("path", 1, PATH_CHARS)
    borders = _bounds(judged.select("key", head.alias("path")), n)

    @F.pandas_udf("array<int>")
    def ranges(key, path, salt):
        """The ranges that a (key, path) may lie in; one of them by the salt where a hot value spans several."""
        out = []
        for k, p, s in zip(key, path, salt, strict=True):
            last = bisect_right(borders, (k, p))
            first = last
            while first and borders[first - 1] == (k, p):
                first -= 1
            out.append([first + s % (last - first + 1)])
        return _series(out)

    @F.pandas_udf("array<int>")
    def spans(key):
        """All ranges that a rule's interval of keys meets."""
        return _series([list(range(bisect_right(borders, (k,)), bisect_right(borders, (k + "\U0010ffff",)) + 1)) for k in key])

    rows = judged.select(
        ranges("key", head, F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)))[0].alias("part"), "key", F.lit(_ROW).alias("kind"), "path",
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), "id", "host",
    )
    opened = rules.select(F.explode(spans("key")).alias("part"), "key", F.lit(_RULE).alias("kind"), "path", "rule", "verdict", F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("host"))
    kind = rows.schema["id"].dataType.simpleString()
    return (
        rows.unionByName(opened)
        .repartitionById(n, F.col("part"))
        .sortWithinPartitions("part", "key", "kind")
        .mapInArrow(_sweep, f"id {kind}, host string, path string, rule string, verdict string")
        .select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    )


def _series(values: list[list[int]]):
    import pandas as pd

    return pd.Series(values)
