"""URL filters: allow and block rules on hosts and paths, found by a sort-merge range join.

A host's labels are written in reverse (``www.example.com`` as ``com.example.www.``), followed by the path. In the order
of these keys every host rule is an interval: all keys that its own key begins. Keys and rules are dealt to ranges of the
order, a rule to every range that its interval meets, and each range is swept once in order. The sweep keeps the rules
whose intervals hold the current key on a stack; a key takes them off that it has passed. The paths of one rule host are
nested intervals again: sorted, each with a link to the rule around it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import LOWER, UPPER, named

JUDGED = ("host", "path", "rule", "verdict")
LAST = "\U0010ffff"  # above every key that a rule's key begins


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels in reverse, each with a dot after it. A host's key begins those of its subdomains and no others."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class Level:
    """The rules of one host on the stack: their paths in order, each with the rule around it."""

    def __init__(self, key: str):
        self.key, self.found, self.paths, self.around = key, {}, [], None
        self.host = ".".join(key[:-1].split(".")[::-1])

    def add(self, path: str, verdict: str) -> None:
        """Of rules for the same host and path that disagree, block wins."""
        self.found[path] = min(verdict, self.found.get(path, verdict), key=lambda v: v != "block")
        self.around = None

    def longest(self, path: str) -> str | None:
        """The longest rule path that begins ``path``."""
        if self.around is None:
            self.paths, self.around, nest = sorted(self.found), [], []
            for k, p in enumerate(self.paths):
                while nest and not p.startswith(self.paths[nest[-1]]):
                    nest.pop()
                self.around.append(nest[-1] if nest else -1)
                nest.append(k)
        k = bisect_right(self.paths, path) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.around[k]
        return self.paths[k] if k >= 0 else None


def _swept(batches: Iterable[pa.RecordBatch], keep: int, default: str) -> Iterator[pa.RecordBatch]:
    """One range in order: rules go on the stack, keys get the longest rule there. Only the stack is held."""
    stack: list[Level] = []
    last, answer = None, ("", "", None, default)
    for batch in batches:
        out, rows = [], []
        for k, (key, path, verdict) in enumerate(zip(*(batch.column(keep + i).to_pylist() for i in range(3)))):
            if verdict is None and key == last:
                rows.append(k)
                out.append(answer)
                continue
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if verdict is not None:
                if not stack or stack[-1].key != key:
                    stack.append(Level(key))
                stack[-1].add(path, verdict)
                last = None
                continue
            # A host has no slash and its key ends with a dot; the path starts with a slash or is empty.
            cut = key.find("/")
            labels, path = (key, "") if cut < 0 else (key[:cut], key[cut:])
            best: tuple = (-1, 0, None, default)
            for level in stack:
                if (p := level.longest(path)) is not None:
                    best = max(best, (len(level.host) + len(p), len(level.host), level.host + p, level.found[p]), key=lambda b: b[:2])
            last, answer = key, (".".join(labels[:-1].split(".")[::-1]), path, *best[2:])
            rows.append(k)
            out.append(answer)
        if rows:
            taken = batch.take(pa.array(rows))
            columns = [taken.column(i) for i in range(keep)] + [pa.array(c, pa.string()) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:keep], *JUDGED])


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow", ranges: int | None = None, sample: int = 64) -> DataFrame:
    """The ``keep`` columns of each row of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules (host, path, verdict)`` hold verdicts ``allow`` or ``block``. A rule fits its host and all subdomains where the
    url's path starts with the rule's. The longest rule (host and path, in code points) wins, of equals the one with the
    longer host; without one ``rule`` is null and ``verdict`` is ``default``. Null urls and urls without ``://`` have an
    empty host and path. Rules with a null host or verdict fit nothing; a null path is empty. Repeated rows are judged each, columns of
    ``keep`` that clash with the four give way, and an empty table stays empty.

    The order is cut into ``ranges`` (by default as many as shuffle partitions) at keys of a sample of about ``sample``
    rows a range, picked by hash; it decides the balance only. A key that fills several ranges is dealt to all of them,
    so neither a hot host nor a hot url is a task of its own. A rule travels once for each range that it meets.
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in keep if c.lower() not in JUDGED]
    salt = F.xxhash64(*(named(c) for c in kept), F.monotonically_increasing_id())
    text = named(url).cast("string")
    own = [named(c).alias(f"__{i}") for i, c in enumerate(kept)]  # any name may stand between here and there
    keyed = pages.select(*own, F.concat(host_key(host_of(text)), path_of(text)).alias("__key"), salt.alias("__salt"))
    share = min(1.0, ranges * sample / max(1, pages.count()))
    unit = F.pmod(F.xxhash64("__salt"), F.lit(1 << 30)) / (1 << 30)
    keys = sorted(r["__key"] for r in keyed.filter(unit < share).select("__key").collect())
    cuts = [keys[k * len(keys) // ranges] for k in range(1, ranges)] if keys else []

    @F.pandas_udf("int")
    def dealt(key: pd.Series, salt: pd.Series) -> pd.Series:
        """The range of a key; one that several cuts fall on has all ranges between them."""
        lo = np.array([bisect_left(cuts, k) for k in key], np.int64)
        hi = np.array([bisect_right(cuts, k) for k in key], np.int64)
        return pd.Series(lo + salt.to_numpy(np.int64) % (hi - lo + 1), dtype="int32")

    @F.pandas_udf("array<int>")
    def met(key: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_left(cuts, k), bisect_right(cuts, k + LAST) + 1)) for k in key], dtype=object)

    rows = keyed.select(*(f"__{i}" for i in range(len(kept))), "__key", F.lit("").alias("__path"), F.lit(None).cast("string").alias("__verdict"), dealt("__key", "__salt").alias("__range"))
    told = rules.filter("host is not null and verdict is not null")
    told = told.select(host_key(F.translate("host", UPPER, LOWER)).alias("__key"), F.coalesce("path", F.lit("")).alias("__path"), F.col("verdict").cast("string").alias("__verdict"))
    told = told.select("*", F.explode(met("__key")).alias("__range"))
    both = rows.unionByName(told, allowMissingColumns=True)
    placed = both.repartitionById(ranges, F.col("__range")).sortWithinPartitions("__range", "__key", F.col("__verdict").isNull(), "__path")
    fields = rows.schema.fields[: len(kept)]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), *(f"{c} string" for c in JUDGED)])
    judged = placed.drop("__range").mapInArrow(lambda batches: _swept(batches, len(kept), default), schema)
    return judged.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(kept)), *JUDGED)
