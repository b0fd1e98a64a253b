"""URL rules indexed by their rarest literal token: a URL's tokens fetch candidates, and only those run regular expressions."""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Rules in one index; more of them make further indexes, each passed to the executors on its own.
RULES_PER_INDEX = 20_000
FOUND = "length int, block boolean, rule string"


class Rule(NamedTuple):
    """`action` is allow or block. A host also fits its subdomains; a path fits as a prefix; `*` stands for any run."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def regex(self) -> re.Pattern:
        wild = lambda s: ".*".join(map(re.escape, s.split("*")))
        return re.compile(rf"(?:[^\0]*\.)?{wild(self.host)}\0{wild(self.path)}", re.DOTALL)

    def tokens(self) -> set[str]:
        """Literal pieces that a fitting URL holds too: whole labels of its host, and whole runs of letters and digits of its
        path, which something else ends on either side."""
        labels = {f".{x}" for x in self.host.split(".") if x and "*" not in x}
        return labels | {f"/{x}" for part in self.path.split("*") for x in re.findall(r"(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", part)}


@functools.lru_cache(maxsize=100_000)
def _compiled(rule: Rule) -> re.Pattern:
    """A rule's expression, compiled when a URL first fetches the rule and kept as long as the worker lives."""
    return rule.regex()


#: Where none of the caller's rules fits, these decide; what fits none of them is allowed.
FALLBACK = tuple(
    Rule("block", host, path)
    for host, path in [
        ("spam-farm.*", ""), ("casino.*", ""), ("porn.*", ""), ("phishing.*", ""), ("malware.*", ""),
        ("*", "*/wp-login.php"), ("*", "*/ads/"), ("*", "*/tracker/"),
    ]
)


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: str, path: str) -> set[str]:
    return {f".{x}" for x in host.split(".")} | {f"/{x}" for x in re.findall("[A-Za-z0-9]+", path)}


def token_counts(urls: DataFrame, rules: Iterable[Rule]) -> dict[str, int]:
    """How many of all URLs hold each token of the rules (others are not counted, so the result is as small as the rules)."""
    spark = urls.sparkSession
    wanted = sorted(set().union(*[r.tokens() for r in rules]))
    if not wanted:
        return {}
    labels = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("."), x))
    runs = F.transform(F.split("path", "[^A-Za-z0-9]+"), lambda x: F.concat(F.lit("/"), x))
    held = urls.select(F.explode(F.array_distinct(F.concat(labels, runs))).alias("token")).groupBy("token").count()
    rows = held.join(spark.createDataFrame([(t,) for t in wanted], "token string"), "token").collect()
    return {r["token"]: r["count"] for r in rows}


def _matcher(rules: list[Rule], counts: dict[str, int]):
    index: dict[str, list[Rule]] = defaultdict(list)
    for r in rules:
        index[min(r.tokens(), key=lambda t: (counts.get(t, 0), t), default="")].append(r)

    def match(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        known: dict[tuple[str, str], tuple] = {}
        out = []
        for host, path in zip(hosts, paths, strict=True):
            if (key := (host, path)) not in known:
                best = None
                if host:
                    for token in ("", *_tokens(host, path)):
                        for r in index.get(token, ()):
                            x = (len(r.name), r.action == "block", r.name)
                            if (best is None or x > best) and _compiled(r).match(f"{host}\0{path}"):
                                best = x
                if len(known) > 100_000:
                    known.clear()
                known[key] = best or (None, None, None)
            out.append(known[key])
        return pd.DataFrame(out, columns=["length", "block", "rule"]).astype({"length": "Int32", "block": "boolean", "rule": "object"})

    return F.pandas_udf(match, FOUND)


def _best(rows: DataFrame, rules: list[Rule], counts: dict[str, int]) -> Column:
    """The longest fitting rule (of equal ones a block, then the greater name) over all indexes; null if none fits."""
    found = [_matcher(rules[i : i + RULES_PER_INDEX], counts)("host", "path") for i in range(0, len(rules), RULES_PER_INDEX)]
    found = [F.when(x["length"].isNotNull(), x) for x in found]
    return F.greatest(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast(f"struct<{FOUND.replace(' ', ':').replace(',:', ',')}>")


def filter_urls(pages: DataFrame, rules: list[Rule], fallback: Iterable[Rule] = FALLBACK) -> DataFrame:
    """Judge every url: page_id, url, host, path, rule, verdict.

    Each rule is filed under the one of its literal tokens that the fewest URLs of the whole table hold (rules without any
    are tried on every URL). Of `rules` that fit, the longest gives `rule` and `verdict`; where none fits, `rule` is null and
    `fallback` decides in the same way, else the URL is allowed. Null URLs and those without `://` have an empty host and
    path, fit no rule and are allowed. Repeated rows are judged alike; columns of other names are ignored; rows never move
    between tasks. Rule lists of any length are split into indexes of RULES_PER_INDEX. Very long URLs
    are read whole; of rules of one length a block wins, then the greater name; an empty table gives no rows.
    """
    url = F.col("url")
    rows = pages.select("page_id", "url", url_host(url).alias("host"), url_path(url).alias("path"))
    rules, fallback = list(rules), list(fallback)
    counts = token_counts(rows.select("host", "path"), [*rules, *fallback])
    rows = rows.withColumn("own", _best(rows, rules, counts)).withColumn("other", _best(rows, fallback, counts))
    block = F.coalesce(F.col("own.block"), F.col("other.block"), F.lit(False))
    return rows.select("page_id", "url", "host", "path", F.col("own.rule").alias("rule"), F.when(block, "block").otherwise("allow").alias("verdict"))


OP9_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def op9_url_rules(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), OP9_RULES).drop("url")


OP9_SQL = r"""
WITH urls AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (
  SELECT *, '.' || host AS h, CASE
    WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM urls)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
    WHEN rule IS NOT NULL OR host = '' THEN 'allow'
    WHEN regexp_matches(h, '\.(spam-farm|casino|porn|phishing|malware)\.') OR contains(path, '/wp-login.php') OR contains(path, '/ads/') OR contains(path, '/tracker/') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""
