"""URL filters: host/path lists plus pattern rules that are looked up by their rarest literal token.

Row-local and native: no Python on the executors and no shuffle but a count of the rules' own tokens.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ListRule:
    """``host`` and its subdomains, where the path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """``pattern``: literal text, ``*`` for anything, ``^`` for a separator or an end of the URL."""

    action: str
    pattern: str

    def regex(self) -> str:
        """A form that Java's and RE2's engines read alike; to be searched in the lower-cased URL."""
        part = {"*": ".*", "^": "(?:[^a-z0-9]|^|$)"}
        return "(?s)" + "".join(part.get(c) or re.sub(r"([^a-z0-9])", r"\\\1", c) for c in self.pattern)

    def literals(self) -> list[str]:
        """The tokens that any URL it fits must hold whole: bounded by literal separators or ``^`` on both sides."""
        return sorted({m[1] for m in re.finditer(r"(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])", self.pattern)})


LIST_RULES = (ListRule("block", "net", "/"), ListRule("allow", "example.net", "/en/"), ListRule("block", "example.com", "/de/"), ListRule("allow", "org", "/fr/"))

PATTERN_RULES = tuple(PatternRule(a, p) for a, p in (
    ("block", "^spam-farm^"), ("block", "^cheap-pills^"), ("block", "^casino^"), ("block", "^online-casino^"), ("block", "^free-money^"), ("block", "^click-bait^"),
    ("block", "^adult^"), ("block", "^xxx^"), ("block", "^porn^"), ("block", "^malware^"), ("block", "^phishing^"), ("block", "^torrent^*^download^"),
    ("block", "^replica-watches^"), ("block", "^payday-loan^"), ("block", "^viagra^"), ("block", "^adserver^"), ("block", "^banner^*^click^"),
    ("allow", "^spam-farm^*^abuse-report^"), ("allow", "^wiki^*^malware^"), ("allow", "^wiki^*^phishing^"),
))

#: Up to so many pattern rules are written into one expression; beyond, the index is a table that tokens are joined to.
MAX_INLINED_RULES = 2000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(lower_ascii(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"))


def list_rule(host: Column, path: Column, rules=LIST_RULES) -> Column:
    """The longest rule that fits, as struct(name, action); null if none does."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.name).alias("name"), F.lit(r.action).alias("action"))) for r in ranked]
    return F.coalesce(*fits)


def rarest_literals(urls: DataFrame, url: str, rules=PATTERN_RULES) -> dict[str, list[int]]:
    """Rule numbers by the literal token of each that the fewest URLs hold (ties: the first by name).

    What comes to the driver is one count per token of the rules, however many URLs there are.
    """
    vocabulary = sorted({t for r in rules for t in r.literals()})
    if not vocabulary:
        return {}
    tokens = url_tokens(F.col(f"`{url}`"))
    if len(rules) <= MAX_INLINED_RULES:
        held = urls.select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, vocabulary)))).alias("token"))
    else:
        known = urls.sparkSession.createDataFrame([(t,) for t in vocabulary], "token string")
        held = urls.select(F.explode(tokens).alias("token")).join(known, "token", "left_semi")
    seen = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    index: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        if found := rule.literals():
            index.setdefault(min(found, key=lambda t: (seen.get(t, 0), t)), []).append(k)
    return index


def _first(hits: Column, action: str) -> Column:
    return F.get(F.filter(hits, lambda h: h["action"] == action), F.lit(0))


def _inlined_hits(rules, index: dict[str, list[int]], url: Column) -> Column:
    """The pattern rules that fit, as structs (k, action, pattern) by number: candidates are looked up in literals."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r.action).alias("action"), F.lit(r.pattern).alias("pattern"), F.lit(r.regex()).alias("regex")) for k, r in enumerate(rules)])
    always = F.array(*[F.lit(k) for k, r in enumerate(rules) if not r.literals()]).cast("array<int>")
    if index:
        rules_of = F.create_map(*[x for t, ks in sorted(index.items()) for x in (F.lit(t), F.array(*map(F.lit, ks)))])
        known = F.array_intersect(url_tokens(url), F.array(*map(F.lit, sorted(index))))
        always = F.concat(always, F.flatten(F.transform(known, lambda t: F.element_at(rules_of, t))))
    low = lower_ascii(F.coalesce(url, F.lit("")))
    hits = F.filter(F.transform(F.array_sort(always), lambda k: F.get(table, k)), lambda r: F.regexp_like(low, r["regex"]))
    return F.transform(hits, lambda r: F.struct(r["k"].alias("k"), r["action"].alias("action"), r["pattern"].alias("pattern")))


def _joined_hits(pages: DataFrame, rules, index: dict[str, list[int]], url: str) -> DataFrame:
    """``__url, __found``: the same by a join of the distinct URLs' tokens to the index; URLs that no rule fits are not in it.

    Rules without a literal token are candidates of every URL and stay in the expression; of the hits only the first of
    each action is kept, so a row holds two at most.
    """
    spark = pages.sparkSession
    rows = [(t, k, rules[k].action, rules[k].pattern, rules[k].regex()) for t, ks in index.items() for k in ks]
    table = spark.createDataFrame(rows, "token string, k int, action string, pattern string, regex string")
    urls = pages.select(F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("__url")).distinct()
    met = urls.select("__url", F.explode(url_tokens(F.col("__url"))).alias("token")).join(table, "token").where(F.regexp_like(lower_ascii(F.col("__url")), F.col("regex")))
    hit = F.struct("k", "action", "pattern")
    first = met.groupBy("__url", "action").agg(F.min(hit).alias("hit"))
    return first.groupBy("__url").agg(F.array_sort(F.collect_list("hit")).alias("__found"))


def filter_urls(pages: DataFrame, url: str = "url", list_rules=LIST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """Every row of ``pages`` with ``host, path, rule, verdict, matched_rule``.

    ``rule`` names the list rule that decides, else null; then ``matched_rule`` holds the pattern rule that does
    (an allow pattern beats a block pattern, the earlier beats the later), else null: allow.
    Null and malformed URLs have empty host and path and fit no list rule; repeated rows each get their verdict;
    columns of ``pages`` with the names of ours are replaced.  Any number of pattern rules will do.
    """
    index = rarest_literals(pages, url, pattern_rules)
    kept = pages.select(*[c for c in (pages[f"`{c}`"] for c in pages.columns if c not in {"host", "path", "rule", "verdict", "matched_rule"})])
    u = F.col(f"`{url}`")
    out = kept.withColumns({"host": host_of(u), "path": path_of(u)})
    if len(pattern_rules) <= MAX_INLINED_RULES:
        none = F.array().cast("array<struct<k: int, action: string, pattern: string>>")
        hits = _inlined_hits(pattern_rules, index, u) if pattern_rules else none
    else:
        out = out.withColumn("__url", F.coalesce(u, F.lit(""))).join(_joined_hits(pages, pattern_rules, index, url), "__url", "left").drop("__url")
        everywhere = [r for r in pattern_rules if not r.literals()]
        number = {r.pattern: k for k, r in reversed(list(enumerate(pattern_rules)))}
        low = lower_ascii(F.coalesce(u, F.lit("")))
        loose = [F.when(F.regexp_like(low, F.lit(r.regex())), F.struct(F.lit(number[r.pattern]).alias("k"), F.lit(r.action).alias("action"), F.lit(r.pattern).alias("pattern"))) for r in everywhere]
        hits = F.array_sort(F.array_compact(F.concat(F.coalesce("__found", F.array().cast("array<struct<k: int, action: string, pattern: string>>")), F.array(*loose) if loose else F.array().cast("array<struct<k: int, action: string, pattern: string>>"))))
    out = out.withColumns({"__listed": list_rule(F.col("host"), F.col("path"), list_rules), "__hits": hits})
    allowed, blocked = _first(F.col("__hits"), "allow"), _first(F.col("__hits"), "block")
    matched = F.when(F.col("__listed").isNull(), F.coalesce(allowed, blocked)["pattern"])
    verdict = F.coalesce(F.col("__listed.action"), F.when(allowed.isNotNull(), "allow"), F.when(blocked.isNotNull(), "block"), F.lit("allow"))
    return out.withColumns({"rule": F.col("__listed.name"), "verdict": verdict, "matched_rule": matched}).drop("__listed", "__hits", "__found")


def oracle(list_rules=LIST_RULES, pattern_rules=PATTERN_RULES) -> str:
    """The same over all rules by brute force, for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    listed = sorted(list_rules, key=lambda r: (-len(r.name), r.name))
    case = lambda give: "CASE " + " ".join(f"WHEN (host = {quote(r.host)} OR ends_with(host, {quote('.' + r.host)})) AND starts_with(path, {quote(r.path)}) THEN {quote(give(r))}" for r in listed) + " END"
    ordered = sorted(pattern_rules, key=lambda r: r.action != "allow")
    hit = lambda give: "CASE " + " ".join(f"WHEN regexp_matches(low, {quote(r.regex())}) THEN {quote(give(r))}" for r in ordered) + " END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH parts AS (
      SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
             translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{upper}', '{lower}') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages),
    judged AS (SELECT *, {case(lambda r: r.name)} AS rule, {case(lambda r: r.action)} AS listed, {hit(lambda r: r.pattern)} AS hit, {hit(lambda r: r.action)} AS hit_action FROM parts)
    SELECT page_id, host, path, rule, coalesce(listed, hit_action, 'allow') AS verdict, CASE WHEN rule IS NULL THEN hit END AS matched_rule FROM judged"""
