"""URL filtering by rules and by an exact Bloom filter cascade.

`judge` splits a url into host and path, applies longest-match rules, and asks a blocklist of hosts about the urls
that no rule fits.  The blocklist is a cascade of Bloom filters: level 0 encodes the listed keys, level 1 those keys of
the corpus's universe that level 0 takes for listed by mistake, level 2 the listed keys that level 1 takes for
such, and so on until a level makes no mistake.  Over that complete universe the first level that denies a
key settles the question, so membership is exact and needs no join of the corpus.

A level's size follows from a count of its keys.  A list of more than SHARD_KEYS keys is cut by a hash into as many
shards as it needs, with a cascade for each over the shard's part of the universe, and each row of the corpus is judged by the
cascade of its own shard alone: a list of any size is answered exactly, without a join, and no task holds more than one
shard's bits (SHARD_KEYS keys at up to 40 bits are 1 MB).  Levels are built as (word, bits) aggregates and used as
literal arrays inside the query: built-in functions only.

Defined results: a null url, or one without ://, has an empty host and path and fits no rule and no list
(allow); a null page_id is kept as null; very long urls are judged whole; of rules that fit the longest wins, of equal ones (ties)
the first; an empty table gives an empty result; repeated pages are judged each; extra columns of pages are not read, whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common as c

#: (verdict, host, path): the query's own rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: The query's blocklist holds these hosts, with each prefix and each ending.
LISTED = ("spam-farm", "cheap-pills", "casino-win", "adult-x", "free-bets", "ads-track")
PREFIXES, ENDINGS = ("", "www.", "m.", "blog."), (".example.com", ".example.net", ".example.org")
MISTAKES = 0.01  #: most of the other keys that a level may take for its own; level 0 aims at half as many mistakes as it has keys
SHARD_KEYS = 200_000  #: listed keys to a cascade
MOST_PROBES = 28


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), c.UPPER, c.LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits with the longest host and path, and its verdict; null where none fits."""
    rule = verdict = None
    for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = rule.when(fits, h + p) if rule is not None else F.when(fits, h + p)
        verdict = verdict.when(fits, what) if verdict is not None else F.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _positions(key: Column, level: int, probes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(j), key), F.lit(bits)) for j in range(probes)]


def _holds(key: Column, level: int, probes: int, bits: int, words: Column) -> Column:
    out = F.lit(True)
    for at in _positions(key, level, probes, bits):
        out = out & (F.getbit(F.element_at(words, (F.floor(at / 64) + 1).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)
    return out


def _build(keys: DataFrame, level: int, probes: int, bits: int) -> Column:
    """The level's bits as a literal array of longs."""
    at = F.explode(F.array(*_positions(F.col("key"), level, probes, bits)))
    rows = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).collect()
    words = [0] * ((bits + 63) // 64)
    for r in rows:
        words[r["word"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def cascade(listed: DataFrame, universe: DataFrame) -> list:
    """Levels (probes, bits, words) that tell the keys of `listed` from all other keys of `universe` (column key, both
    without repeats)."""
    inside, outside = listed, universe.join(listed, "key", "left_anti").cache()
    n_in, n_out = inside.count(), outside.count()
    levels: list = []
    kept = [outside]
    try:
        while n_in:
            rate = min(MISTAKES, 0.5 * n_in / n_out) if n_out and not levels else MISTAKES
            probes = min(MOST_PROBES, max(1, math.ceil(math.log2(1 / rate))))
            bits = max(64, math.ceil(n_in * probes / math.log(2)))
            words = _build(inside, len(levels), probes, bits)
            mistaken = outside.where(_holds(F.col("key"), len(levels), probes, bits, words)).cache()
            kept.append(mistaken)
            levels.append((probes, bits, words))
            inside, outside, n_in = mistaken, inside, mistaken.count()
            n_out = 0
        return levels
    finally:
        for df in kept:
            df.unpersist()


def is_listed(key: Column, levels: list) -> Column:
    """Exact membership, for keys of the universe that the cascade was built over."""
    out = F.lit(len(levels) % 2 == 1)
    for n in reversed(range(len(levels))):
        out = F.when(_holds(key, n, *levels[n]), out).otherwise(F.lit(n % 2 == 1))
    return out


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages (page_id, url); listed (key) holds blocked hosts."""
    scratch = c.Scratch(pages.sparkSession)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = scratch.save(rows.select(F.col("host").alias("key")).distinct(), "universe")
    listed = scratch.save(listed.where(F.col("key").isNotNull() & (F.col("key") != "")).select("key").distinct(), "listed")
    shards = max(1, -(-listed.count() // shard_keys))
    own = _shard(F.col("key"), shards)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    out = None
    for k in range(shards):
        hit = is_listed(F.col("host"), cascade(listed.where(own == k), universe.where(own == k)))
        part = rows if shards == 1 else rows.where(_shard(F.col("host"), shards) == k)
        part = part.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(hit, "block").otherwise("allow")).alias("verdict"))
        out = part if out is None else out.unionByName(part)
    scratch.drop(universe, listed)
    return out


def blocklist(spark: SparkSession) -> DataFrame:
    """The query's listed hosts (key), whether or not a page has them."""
    parts = [F.explode(F.array(*map(F.lit, x))) for x in (PREFIXES, LISTED, ENDINGS)]
    rows = spark.range(1).select(parts[0].alias("a")).select("a", parts[1].alias("b")).select("a", "b", parts[2].alias("c"))
    return rows.select(F.concat("a", "b", "c").alias("key"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(c.table(spark, sf_dir, "pages").select("page_id", "url"), blocklist(spark))


def _sql_case(what: str) -> str:
    return " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p) if what == 'rule' else v}'"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )


OP5_SQL = f"""
WITH cut AS (SELECT page_id, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', ['host', 'path']), {{'host': '', 'path': ''}}) AS p FROM pages),
parts AS (SELECT page_id, translate(p.host, '{c.UPPER}', '{c.LOWER}') AS host, p.path AS path FROM cut)
SELECT page_id, host, path, CASE {_sql_case("rule")} END AS rule,
  CASE {_sql_case("verdict")} WHEN host IN {tuple(a + b + e for a in PREFIXES for b in LISTED for e in ENDINGS)} THEN 'block' ELSE 'allow' END AS verdict
FROM parts
"""
