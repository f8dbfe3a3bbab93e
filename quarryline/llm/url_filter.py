"""Filtering URLs by stated rules and by association rules mined from them.

A stated rule is a host and a path.  It fits its host and all subdomains where
the URL's path starts with the rule's; the longest fitting rule decides.

URLs that no rule fits are decided by association rules.  The URLs that some
rule fits are labelled by it; each becomes a set of tokens plus its label,
and Spark's FP-growth finds the token combinations that occur together.  A
combination becomes a rule for a label if enough of its URLs have the label
(confidence) and enough URLs hold it (support); a rule that a shorter one
with the same label and no lower confidence covers is pruned.  Mining reads all
labelled URLs.  Tokens that occur in the same URLs, as those of one template do, are
mined as one, since a rule with two of them says no more than the rule with either; each
found rule is then stated for every choice among them, which gives the rules that mining
them apart would leave after pruning.  A combination needs a fixed share of the URLs, but
FP-growth lists every part of a frequent combination: k tokens that often, though not
always, come together still give 2^k of them.  Frequent tokens and rules come to the driver before rules are pruned, and the index of those left is broadcast.

A URL is matched by inverted index: each rule is listed under its rarest token,
so a URL looks up its own tokens only.  Among the rules that hold, the one
with the highest confidence decides, then support, then length, then its text;
without one, a URL is allowed.

Defined results: a null URL and one without ``://`` have an empty host and path,
no rule and no tokens, and are allowed; a null id is an id like any other;
repeated rows are judged alike; an empty table gives no rows; other columns are
not read; URLs of any length are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8
LABEL = "label="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end; A-Z lower-cased."""
    after = F.substring_index(_after_scheme(url), "/", 1)
    return F.translate(F.substring_index(F.substring_index(after, "?", 1), "#", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    plain = F.substring_index(F.substring_index(_after_scheme(url), "?", 1), "#", 1)
    at = F.instr(plain, "/")
    return F.when(at > 0, F.substr(plain, at)).otherwise("")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: domain endings, host labels, path parts by place, query keys, scheme.

    Digits become one sign, so numbered pages share tokens.
    """
    shape = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.when(F.instr(url, "?") > 0, F.substring_index(F.substring_index(url, "?", -1), "#", 1)).otherwise("")
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    groups = [
        F.array(F.concat(F.lit("end="), F.element_at(labels, -1)), F.concat(F.lit("end2="), F.substring_index(host, ".", -2))),
        F.transform(labels, lambda x: F.concat(F.lit("host="), shape(x))),
        F.transform(parts, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), shape(x))),
        F.transform(keys, lambda x: F.concat(F.lit("key="), shape(x))),
        F.array(F.concat(F.lit("scheme="), F.substring_index(url, "://", 1))),
    ]
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(*groups)))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[tuple[tuple[str, ...], str, float, float]]:
    """(tokens, verdict, confidence, support), pruned; from columns tokens and verdict."""
    from pyspark.ml.fpm import FPGrowth

    same = inseparable(labelled, min_support)
    others = [t for group in same.values() for t in group[1:]]
    tokens = F.array_except("tokens", F.array(*map(F.lit, others))) if others else F.col("tokens")
    items = labelled.select(F.array_append(tokens, F.concat(F.lit(LABEL), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.element_at("consequent", 1).startswith(LABEL)).where(~F.exists("antecedent", lambda x: x.startswith(LABEL)))
    rules = [(tuple(sorted(r["antecedent"])), r["consequent"][0].removeprefix(LABEL), r["confidence"], r["support"]) for r in found.select("antecedent", "consequent", "confidence", "support").collect()]
    return prune_rules([(tuple(sorted(c)), *r[1:]) for r in rules for c in product(*(same.get(t, [t]) for t in r[0]))])


def inseparable(labelled: DataFrame, min_support: float) -> dict[str, list[str]]:
    """Frequent tokens that occur in the same rows, by the first of them; only groups of several.

    Rows are the same if their number and the sums of two 64-bit hashes of their tokens agree.
    At most (mean number of tokens / support) tokens are frequent, so few come to the driver.
    """
    rows = labelled.agg(F.count("*")).first()[0]
    token = labelled.select(F.explode("tokens").alias("token"), *[F.xxhash64("tokens", F.lit(k)).cast("decimal(20,0)").alias(f"h{k}") for k in (0, 1)])
    seen = token.groupBy("token").agg(F.count("*").alias("n"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1")).where(F.col("n") >= min_support * rows)
    groups: dict[tuple, list[str]] = {}
    for r in sorted(seen.collect()):
        groups.setdefault((r["n"], r["h0"], r["h1"]), []).append(r["token"])
    return {g[0]: g for g in groups.values() if len(g) > 1}


def prune_rules(rules):
    """Without the rules that a shorter one for the same verdict, at least as sure, covers."""
    kept: list[tuple] = []
    by_token: dict[tuple[str, str], list[tuple]] = {}
    for r in sorted(rules, key=lambda r: (len(r[0]), r[0], r[1])):
        tokens = set(r[0])
        general = (g for t in r[0] for g in by_token.get((t, r[1]), ()))
        if not any(g[2] >= r[2] and tokens.issuperset(g[0]) for g in general):
            kept.append(r)
            for t in r[0]:
                by_token.setdefault((t, r[1]), []).append(r)
    return kept


class RuleIndex:
    """Rules listed under their rarest token."""

    def __init__(self, rules) -> None:
        count = Counter(t for r in rules for t in r[0])
        self.lists: dict[str, list[tuple]] = {}
        for r in sorted(rules, key=lambda r: (-r[2], -r[3], -len(r[0]), r[0], r[1])):
            self.lists.setdefault(min(r[0], key=lambda t: (count[t], t)), []).append(r)

    def verdict(self, tokens: list[str]) -> str | None:
        held = set(tokens)
        fits = [next((r for r in self.lists[t] if held.issuperset(r[0])), None) for t in tokens if t in self.lists]
        best = min((r for r in fits if r), key=lambda r: (-r[2], -r[3], -len(r[0]), r[0], r[1]), default=None)
        return best and best[1]


def url_filter(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """A row for each page: id, host, path, rule, verdict, and whether a mined rule gave it."""
    url = F.coalesce(F.col("_url"), F.lit(""))
    rows = pages.select(F.col(id_column).alias(id_column), F.col(url_column).alias("_url"))
    rows = rows.select(id_column, "_url", host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select(id_column, "host", "path", name.alias("rule"), verdict.alias("verdict"), tokens_of(url, F.col("host"), F.col("path")).alias("tokens"))
    mined = mine_rules(rows.where("verdict is not null").select("tokens", "verdict"), min_support, min_confidence)
    shared = pages.sparkSession.sparkContext.broadcast(RuleIndex(mined))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stated, tokens = b.column(4).to_pylist(), b.column(5).to_pylist()
            own = [None if v else shared.value.verdict(t) for v, t in zip(stated, tokens, strict=True)]
            verdict = [v or m or "allow" for v, m in zip(stated, own, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(verdict, pa.string()), pa.array([m is not None for m in own], pa.bool_())], names=[*b.schema.names[:4], "verdict", "mined"])

    schema = rows.select(id_column, "host", "path", "rule").schema.add("verdict", "string").add("mined", "boolean")
    return rows.mapInArrow(judge, schema)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
