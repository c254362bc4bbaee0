"""URL rules by Bloom filter cascades (native).

Every url has a few candidate keys: a host suffix joined to a path prefix. One cascade for the block list and one for the allow list tell which
candidates are listed. Level 0 of a cascade encodes the listed keys, level 1 those keys of the corpus that level 0 takes for listed, level 2 the
listed keys that level 1 takes for false, and so on, until a level makes no mistake over the whole key universe of the corpus. However few its keys, a level is a Bloom filter, of 64 bits at least. So membership is exact and the main path has no join: the levels are literals in the plan, read inside functions over an array of a url's candidates, so the
plan is as large for many path lengths as for one. Level 0 gets a false-positive rate of about sqrt(1/2) * listed / universe and the later ones 1/2, so the literals follow the lists, which the
caller holds on the driver, by a few bytes a rule, and not the corpus. Lists have no cap.

Defined cases: a null url, or one without ``://``, has an empty host and path, and no rule fits it. A url without a path fits no rule, since every
rule's path starts with ``/``. Very long urls are judged whole. The longest fitting rule wins; of two equally long ones the greater by code point; a key on both lists is blocked.
Repeated rows are judged each for itself. An empty table gives no rows. Columns other than the id and url aren't read, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshfront.llm.common import ascii_lower
from meshfront.plans.storage import materialize, release

#: A cascade of so many filters is ended by a level of the keys that are left. Each filter leaves half of them or fewer on average, so only lists beyond any size get here.
DEEPEST = 60


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``words`` holds ``bits`` bits. The level that ends a cascade of DEEPEST filters has its keys instead."""

    words: tuple[int, ...] = ()
    bits: int = 0
    hashes: int = 0
    salt: int = 0
    keys: tuple[str, ...] | None = None

    def may_hold(self, key: Column) -> Column:
        if self.keys is not None:
            return key.isin(*self.keys)
        table = F.lit(np.array(self.words, dtype=np.int64))
        bit = lambda p: F.getbit(F.get(table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1
        return F.forall(F.sequence(F.lit(0), F.lit(self.hashes - 1)), lambda i: bit(self.position(key, i)))

    def position(self, key: Column, i: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.salt * 64) + i), F.lit(self.bits))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """True exactly for the listed keys, among the keys that the cascade was built over."""
        found = F.lit(False)
        for level in reversed(self.levels):
            found = level.may_hold(key) & ~found
        return found


def _level(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """Built by a partial aggregate per 64-bit word; the driver gets the words of the filter, and keys only from DEEPEST on."""
    if salt % 1000 >= DEEPEST:
        return Level(keys=tuple(sorted(r.key for r in keys.select("key").distinct().collect())))
    rate = min(0.5, max(rate, 2.0**-40))
    bits = max(64, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2))
    hashes = min(max(1, round(bits / n * math.log(2))) if bits > 64 else 2, 40)
    empty = Level((), bits, hashes, salt)
    at = keys.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: empty.position(F.col("key"), i))).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(63).cast("int"))
    words = [0] * -(-bits // 64)
    for r in at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("v")).collect():
        words[r.w] = r.v
    return Level(tuple(words), bits, hashes, salt)


def rule_table(spark: SparkSession, rules: list[str]) -> DataFrame:
    """The rules as a column key: one literal, parted by a character that no rule has."""
    whole = "".join(rules)
    mark = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in whole)
    return spark.range(1, numPartitions=1).select(F.explode(F.split(F.lit(mark.join(rules)), mark)).alias("key")) if rules else spark.range(0).select(F.lit("").alias("key"))


def build_cascade(listed: DataFrame, universe: DataFrame, salt: int = 1) -> Cascade:
    """``listed`` and ``universe`` have a column key. Two passes over the universe: one estimates its size, one finds the false positives of level 0."""
    n = listed.count()
    if not n:
        return Cascade(())
    others = universe.agg(F.approx_count_distinct("key").alias("n")).first().n
    levels = [_level(listed, n, math.sqrt(0.5) * n / max(others, 1), salt * 1000)]
    # Levels in turn hold some of the keys of one side; what the newest wrongly takes is on the other side.
    inside, outside = listed, materialize(universe.where(levels[0].may_hold(F.col("key"))).distinct().join(listed, "key", "left_anti"), "cascade")
    while m := outside.count():
        levels.append(_level(outside, m, 0.5, salt * 1000 + len(levels)))
        wrong = materialize(inside.where(levels[-1].may_hold(F.col("key"))), "cascade")
        release(inside)
        inside, outside = outside, wrong
    release(inside)
    release(outside)
    return Cascade(tuple(levels))


def url_parts(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    if not host or not slash:
        raise ValueError(f"a rule is host/path: {rule!r}")
    return host, slash + path


def candidate_keys(host: Column, path: Column, rules: list[str]) -> Column:
    """An array with a key for each count of host labels and each path length that the rules have and the url reaches. Other keys can't be listed."""
    parts = [_split(r) for r in rules]
    labels, lengths = (F.array(*map(F.lit, sorted(x))) for x in ({h.count(".") + 1 for h, _ in parts}, {len(p) for _, p in parts}))
    hosts = F.array_distinct(F.transform(labels, lambda n: F.call_function("substring_index", host, F.lit("."), -n)))
    paths = F.transform(F.filter(lengths, lambda k: F.length(path) >= k), lambda k: F.substring(path, F.lit(1), k))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def judge_urls(pages: DataFrame, block: list[str], allow: list[str], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row of ``pages``."""
    spark, rules = pages.sparkSession, sorted({*block, *allow})
    host, path = url_parts(F.col(f"`{url_col}`"))
    parts = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    if not rules:
        return parts.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = parts.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), rules))
    universe = keyed.select(F.explode("keys").alias("key"))
    blocked, allowed = (build_cascade(rule_table(spark, sorted(set(listed))), universe, salt) for salt, listed in enumerate((block, allow), 1))
    verdict = lambda k: F.when(blocked.holds(k), "block").when(allowed.holds(k), "allow")
    found = F.transform("keys", lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"), verdict(k).alias("verdict")))
    best = F.array_max(F.filter(found, lambda x: x["verdict"].isNotNull()))
    judged = keyed.select("id", "host", "path", best.alias("best"))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
