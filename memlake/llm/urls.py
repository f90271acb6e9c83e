"""URL filters: short rules by host and path, then a blocked Bloom filter of listed canonical URLs and an exact hash join behind it.

The list may be far longer than what fits a broadcast. The filter does fit: it is one array of at most MOST_BLOCKS blocks of four longs,
read as a scalar subquery, and an entry sets one bit in each long of its block. A URL that misses every one of its forms is decided where
it was read; only possible hits are exploded into their forms and joined with the list itself, so a false positive of the filter costs a
join row and nothing else. All of it is DataFrame functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_table

# fixed values: the rules of the contract, as (verdict, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
# fixed values: words that mark a site for the list, as a part of one of its host labels
JUNK_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")
# fixed values: query parameters that do not change the page
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 4  # longs in a block
BITS_PER_ENTRY = 16
#: The filter is never larger than so many blocks (2 MB), whatever the list; a longer list makes it pass more, which the join then removes.
MOST_BLOCKS = 1 << 16
#: Host suffixes probed in the row. A host of more labels goes to the join with all its suffixes, unprobed.
PROBED_LABELS = 8
#: A longer host is no host name (RFC 1035); only its whole form is looked up.
HOST_CHARS = 253


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty for a null or where there is no `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty for a null or where there is no `://`."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent domain and begins the path; nulls where none does. The rules are
    a short configured list; the first listed wins among equally long ones."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def site_host(host: Column) -> Column:
    """The host without user, port, final dot and leading `www.`."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$|\.$|^(?:[^@]*@)?www\.", "")


def canonical_page(url: Column, host: Column, path: Column) -> Column:
    """`host/path?query` without scheme, fragment, tracking parameters and a final slash."""
    query = F.coalesce(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), F.lit(""))
    query = F.regexp_replace(F.regexp_replace(query, rf"(^|&)(?:{TRACKING})=[^&]*", ""), "^&", "")
    return F.concat(site_host(host), F.regexp_replace(path, "/+$", ""), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def _suffix(site: Column, labels: int) -> Column:
    return F.concat(F.substring_index(site, ".", -labels), F.lit("/"))


def forms(site: Column, page: Column) -> Column:
    """Every canonical form a list may hold for a URL: the page, and `suffix/` for each suffix of its host of two or more labels."""
    labels = F.size(F.split(site, r"\."))
    most = F.when(F.length(site) > HOST_CHARS, F.lit(0)).otherwise(labels)
    suffixes = F.transform(F.sequence(F.lit(2), F.greatest(most, F.lit(2))), lambda k: F.concat(F.array_join(F.slice(F.split(site, r"\."), F.greatest(labels - k + 1, F.lit(1)), labels), "."), F.lit("/")))
    return F.array_distinct(F.concat(F.array(page, F.concat(site, F.lit("/"))), F.when(most >= 2, suffixes).otherwise(F.array().cast("array<string>"))))


def junk_sites(pages: DataFrame, url_col: str = "url", words: Sequence[str] = JUNK_WORDS) -> DataFrame:
    """(canonical): `site/` for the hosts of `pages` with one of `words` as a hyphenated part of a label, from the leftmost such label on."""
    hosts = pages.select(site_host(host_of(F.col(url_col))).alias("site")).where((F.col("site") != "") & (F.length("site") <= HOST_CHARS)).distinct()
    labels = F.split("site", r"\.")
    marked = F.transform(labels, lambda x: F.arrays_overlap(F.split(x, "-"), F.array(*map(F.lit, words))))
    first = F.array_position(marked, True).cast("int")
    return hosts.where(first > 0).select(F.concat(F.array_join(F.slice(labels, first, F.size(labels)), "."), F.lit("/")).alias("canonical")).distinct()


def _block(form: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(form), F.lit(blocks)).cast("int")


def _seed(form: Column) -> Column:
    return F.xxhash64(form, F.lit(1))


def _bit(seed: Column, word: int) -> Column:
    """The single bit that a form sets in the word of its block."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(seed, 6 * word).bitwiseAND(F.lit(63).cast("long")).cast("int"))


def blocked_bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(bits): the filter as one row with an array of `blocks` * WORDS longs. The gathered rows are bounded by `blocks`, not by the list."""
    form = F.col("canonical")
    words = listed.groupBy(_block(form, blocks).alias("block")).agg(*[F.bit_or(_bit(_seed(form), w)).alias(f"w{w}") for w in range(WORDS)])
    every = listed.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block")).join(words, "block", "left")
    row = F.struct("block", F.array(*[F.coalesce(f"w{w}", F.lit(0).cast("long")) for w in range(WORDS)]).alias("words"))
    return every.agg(F.flatten(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["words"])).alias("bits"))


def _possible(block: Column, seed: Column, bits: Column) -> Column:
    tests = [F.get(bits, block * WORDS + w).bitwiseAND(_bit(seed, w)) != 0 for w in range(WORDS)]
    return tests[0] & tests[1] & tests[2] & tests[3]


def probed(rows: DataFrame, probes: Sequence[Column], bits: Column, blocks: int) -> DataFrame:
    """`rows` with `maybe`: whether the filter passes one of `probes`. Hashes are columns of their own, so that each is taken once."""
    own = [F.col(c) for c in rows.columns]
    hashes = [h for k, form in enumerate(probes) for h in (_block(form, blocks).alias(f"block_{k}"), _seed(form).alias(f"seed_{k}"))]
    maybe = F.lit(False)
    for k in range(len(probes)):
        maybe = maybe | _possible(F.col(f"block_{k}"), F.col(f"seed_{k}"), bits)
    return rows.select(*own, *hashes).select(*own, maybe.alias("maybe"))


def judged(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", listed_col: str = "canonical", most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of `pages`.

    A rule decides where one fits. Else a URL is blocked if one of its canonical forms (its page, or its host or a parent domain of two or
    more labels as `host/`) is in `listed`, and allowed if none is. A null URL, or one without `://`, has an empty host and path, no rule,
    and is allowed. Repeated rows and null ids keep their rows; null and repeated entries of the list count once; an empty list allows all
    and empty pages give no rows. Hosts of over 253 characters are looked up whole only. Other columns are left behind.

    Each URL is parsed once, and its parts written; nothing of the list but the filter is broadcast.
    """
    listed = cut_table(listed.select(F.col(listed_col).cast("string").alias("canonical")).where("canonical IS NOT NULL").distinct())
    blocks = min(most_blocks, max(1, math.ceil(listed.count() * BITS_PER_ENTRY / (64 * WORDS))))
    bits = cut_table(blocked_bloom(listed, blocks)).scalar()

    url = F.col("url")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"), site_host(F.col("host")).alias("site"), canonical_page(url, F.col("host"), F.col("path")).alias("page"))

    site, page = F.col("site"), F.col("page")
    many = F.length(site) - F.length(F.replace(site, F.lit("."), F.lit(""))) >= PROBED_LABELS
    rows = probed(rows, [page, F.concat(site, F.lit("/")), *[_suffix(site, k) for k in range(2, PROBED_LABELS + 1)]], bits, blocks)
    open_ = F.col("said").isNull() & (site != "") & (many | F.col("maybe"))
    rows = cut_table(rows.withColumn("open", open_).select("page_id", "host", "path", "rule", "said", "open", F.when(F.col("open"), site).alias("site"), F.when(F.col("open"), page).alias("page")))

    decided = rows.where(~F.col("open")).select("page_id", "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict"))
    hits = rows.where("open").select("page_id", "host", "path", "site", "page", F.monotonically_increasing_id().alias("row"))
    looked = hits.select("row", "page_id", "host", "path", F.explode(forms(site, page)).alias("canonical"))
    found = looked.join(listed.withColumn("hit", F.lit(1)), "canonical", "left").groupBy("row", "page_id", "host", "path").agg(F.max("hit").alias("hit"))
    verified = found.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("hit") == 1, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
    return decided.unionByName(verified)


#: The same verdicts with the list joined as it is; the filter is a matter of the plan.
ORACLE = r"""
WITH parts AS (
    SELECT page_id, url,
        translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
        row_number() OVER () AS nr
    FROM pages),
sites AS (
    SELECT *, regexp_replace(host, '^.*@|:[0-9]*$|\.$|^(?:[^@]*@)?www\.', '', 'g') AS site,
        regexp_replace(regexp_replace(coalesce(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), ''), '(^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') AS query
    FROM parts),
labels AS (SELECT DISTINCT site, string_split(site, '.') AS l FROM sites WHERE site != '' AND length(site) <= 253),
listed AS (
    SELECT DISTINCT array_to_string(l[k:], '.') || '/' AS canonical
    FROM (SELECT l, list_min(list_filter(range(1, len(l) + 1), lambda k: list_has_any(string_split(l[k], '-'), ['ads', 'adult', 'bets', 'casino', 'pills', 'spam']))) AS k FROM labels)
    WHERE k IS NOT NULL),
forms AS (
    SELECT nr, site || regexp_replace(path, '/+$', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END AS form FROM sites
    UNION ALL SELECT nr, site || '/' FROM sites
    UNION ALL SELECT nr, array_to_string(l[k:], '.') || '/' FROM (SELECT nr, string_split(site, '.') AS l, unnest(range(1, len(string_split(site, '.')))) AS k FROM sites WHERE length(site) <= 253)),
hits AS (SELECT DISTINCT nr FROM forms WHERE form IN (SELECT canonical FROM listed)),
ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM sites)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN nr IN (SELECT nr FROM hits) AND site != '' THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
