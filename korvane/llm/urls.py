"""URL filters: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

  rules   A rule has a host and the beginning of a path. It fits its host and all subdomains, if the path begins so; of the
          rules that fit, the longest decides. A few rules are one CASE expression inside the scan.
  list    Other URLs are judged by a list, by their canonical form (see canonical()): block if listed, else allow.
          The list becomes a Bloom filter of 512-bit blocks: a hash names the block, eight numbers of six bits name one bit
          in each of its eight words. A block is one row, made by bit_or, so the filter is a table like any other. Pages
          meet it by an equi-join on the block; it is sent to all tasks only up to a checked size. What passes, the listed
          and a few in a thousand others, meets the list itself in an exact hash join. The rest is allowed without a shuffle.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule and is never listed; a null
page_id is kept; rows that repeat a page or a url are judged one by one; very long urls count in full; of rules that fit
and are equally long the one with the longer host counts, then the first; a url that is listed many times counts once;
empty tables give no rows, and an empty list blocks nothing; columns but page_id and url are not read, so their names
cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korvane.llm.common import materialize, table

# Host, beginning of the path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

# Hosts with one of these labels are known for spam; their pages are what the query's list holds.
SPAM = ("cheap-pills", "spam-farm")

#: Parameters that say where a visitor came from, and not what the page is.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"

WORDS = 8
#: Bits of the filter for each listed URL: some 1 in 1,000 others pass.
BITS = 16
#: Bytes of the filter up to which it is sent to all tasks.
SENT = 64 << 20

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> dict[str, Column]:
    """host, path and query of a url; empty without `://`."""
    some = F.coalesce(url, F.lit(""))
    got = lambda pattern: F.regexp_extract(some, pattern, 1)
    return {
        "host": F.translate(got(r"(?s)^.*?://([^/?#]*)"), *LOWER),
        "path": got(r"(?s)^.*?://[^/?#]*([^?#]*)"),
        "query": got(r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)"),
    }


def canonical(url: Column) -> Column:
    """What stays of a url where two lead to one page: no scheme, `www.`, port 80 or 443, last slashes, tracking parameters or fragment; the other parameters in order. Null without `://`."""
    p = parts(url)
    host = F.regexp_replace(F.regexp_replace(p["host"], r"^www\.", ""), r":(80|443)$", "")
    kept = F.array_sort(F.filter(F.split(p["query"], "&", -1), lambda x: (x != "") & ~x.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.contains(url, F.lit("://")), F.concat(host, F.regexp_replace(p["path"], r"/+$", ""), query))


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """rule and verdict of the longest rule that fits, or a null struct."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(reversed(rules), key=lambda r: (len(r[0] + r[1]), len(r[0]))):  # the longest ends up outermost
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _place(blocks: int) -> Column:
    return F.pmod(F.xxhash64("canonical"), F.lit(blocks))


def _bit(word: int) -> Column:
    """The one bit of a word: six bits of a second hash."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64("canonical", F.lit(1)), 6 * word).bitwiseAND(63).cast("int"))


def bloom(listed: DataFrame, bits: int = BITS) -> tuple[DataFrame, int]:
    """The filter of listed(canonical), distinct rows: a written table of block and words w0 to w7, and the number of blocks."""
    blocks = max(1, -(-listed.count() * bits // (64 * WORDS)))
    words = listed.select(_place(blocks).alias("block"), *(_bit(i).alias(f"w{i}") for i in range(WORDS)))
    return materialize(words.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS))), "bloom"), blocks


def possible(urls: DataFrame, listed: DataFrame, bits: int = BITS, sent: int = SENT) -> DataFrame:
    """urls(canonical, ...) with `maybe`: false is certain, true is not. The filter's words meet only their own block's urls."""
    words, blocks = bloom(listed, bits)
    size = 8 * (WORDS + 1) * min(blocks, words.count())
    met = urls.withColumn("block", _place(blocks)).join(F.broadcast(words) if size <= sent else words, "block", "left")
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(_bit(i)) != 0)
    return met.withColumn("maybe", F.coalesce(hit & F.col("canonical").isNotNull(), F.lit(False))).drop("block", *(f"w{i}" for i in range(WORDS)))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, bits: int = BITS, sent: int = SENT) -> DataFrame:
    """page_id, host, path, rule, verdict and listed of every page. listed: a table with a column url, each listed once or more often."""
    p = parts(F.col("url"))
    found = pages.select("page_id", p["host"].alias("host"), p["path"].alias("path"), canonical(F.col("url")).alias("canonical"))
    found = found.withColumn("by", rule(F.col("host"), F.col("path"), rules))
    keys = materialize(listed.select(canonical(F.col("url")).alias("canonical")).where("canonical IS NOT NULL").distinct(), "listed")
    # where a rule has decided, the list is not asked
    met = possible(found.withColumn("canonical", F.when(F.col("by").isNull(), F.col("canonical"))), keys, bits, sent)
    surely = met.where(~F.col("maybe")).withColumn("listed", F.lit(False))
    exact = met.where("maybe").join(keys.hint("shuffle_hash").withColumn("hit", F.lit(True)), "canonical", "left").withColumn("listed", F.coalesce("hit", F.lit(False))).drop("hit")
    every = surely.unionByName(exact)
    return every.select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.coalesce("by.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def spam(pages: DataFrame) -> DataFrame:
    """The urls of pages on hosts with a label of SPAM."""
    return pages.where(F.arrays_overlap(F.split(parts(F.col("url"))["host"], r"\."), F.array(*map(F.lit, SPAM)))).select("url")


def op12_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, spam(pages)).drop("listed")


OP12_SQL = """
WITH p AS (
  SELECT page_id, url, contains(url, '://') AS good,
    translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, regexp_extract(url, '^.*?://[^/?#]*[^?#]*[?]([^#]*)', 1, 's') AS query
  FROM pages
),
kept AS (
  SELECT *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS parameters FROM p
),
c AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
    CASE WHEN good THEN concat(regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', ''), regexp_replace(path, '/+$', ''), CASE WHEN len(parameters) > 0 THEN concat('?', array_to_string(parameters, '&')) ELSE '' END) END AS canonical
  FROM kept
),
listed AS (SELECT DISTINCT canonical FROM c WHERE list_has_any(string_split(host, '.'), ['cheap-pills', 'spam-farm'])),
rules(rule_host, rule_path, rule_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
marked AS (SELECT row_number() OVER () AS id, c.*, l.canonical IS NOT NULL AS hit FROM c LEFT JOIN listed l USING (canonical)),
fits AS (
  SELECT id, arg_max(concat(rule_host, rule_path), length(rule_host) + length(rule_path)) AS rule, arg_max(rule_verdict, length(rule_host) + length(rule_path)) AS rule_verdict
  FROM marked JOIN rules ON (host = rule_host OR ends_with(host, concat('.', rule_host))) AND starts_with(path, rule_path) GROUP BY id
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN hit THEN 'block' ELSE 'allow' END) AS verdict FROM marked LEFT JOIN fits USING (id)
"""
