"""URL filters: host rules by longest match, and pattern rules indexed by their rarest literal token.

All in DataFrame functions: a URL's tokens fetch candidate rules from the index, and only
those run their regular expressions. The tokens are derived from the patterns: a token is a run of lower-case letters and
digits that every match has between other characters, so that it is a token of the whole URL; a
choice between branches asks for a token of each.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its path.
HOST_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: (name, pattern): regular expressions that Java, RE2 and Python read alike, of literals, classes, groups, choices and repetitions.
PATTERN_RULES = (
    ("feed-tracking", r"[?&]utm_source=feed(&|#|$)"),
    ("mail-tracking", r"[?&]utm_medium=email(&|#|$)"),
    ("advert-path", r"/(ads|adserver)/"),
    ("login-page", r"/login(/|\.|\?|$)"),
    ("casino-host", r"://([^/?#]*[.-])?casino[.-]"),
    ("paged-referral", r"[?&]page=[0-9]+&ref="),
)
#: Rules of which the plan holds an expression each; more are applied in several passes.
AT_ONCE = 500
_WORD = frozenset(LOWER + "0123456789")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null and without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), "[^a-z0-9]+"), lambda t: t != ""))


def literal_tokens(pattern: str) -> list[list[str]]:
    """Sets of tokens that a match needs: of each set every matching URL has one token at least. Empty where none is certain.

    The pattern is read as a sequence of what it must have: literal characters, edges (something that is no letter or digit, or
    the end), and gaps (anything). A run of letters and digits between two edges is a token; a choice whose branches are all such runs gives the set of them.
    """
    gap, edge, most = "gap", "edge", 64

    def read(items: list) -> list:
        """Edges, gaps, sets of strings of letters and digits one of which stands there, and ("maybe", whether it ends in an edge)."""
        out: list = []
        for op, value in items:
            kind = str(op)
            if kind in ("LITERAL", "IN"):
                given = [(str(k), v) for k, v in value] if kind == "IN" else [(kind, value)]
                chars = {chr(v).lower() for k, v in given if k == "LITERAL"}
                plain = all(k == "LITERAL" for k, _ in given)
                out.append(chars if plain and chars <= _WORD else edge if plain and not chars & _WORD else gap)
            elif kind == "AT":
                out.append(edge if str(value) in ("AT_END", "AT_END_STRING", "AT_BEGINNING", "AT_BEGINNING_STRING") else gap)
            elif kind == "SUBPATTERN":
                out += read(list(value[3]))
            elif kind == "BRANCH":
                branches = [read(list(b)) for b in value[1]]
                if all(isinstance(x, set) for b in branches for x in b):
                    out.append({s for b in branches for s in reduce(lambda p, q: {x + y for x in p for y in q}, b, {""})})
                else:
                    out.append(edge if all(b == [edge] for b in branches) else gap)
            elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
                inner = read(list(value[2]))
                # once at least: an edge is certain; what may be missing leaves the edge before it, or its own last one
                out.append((edge if inner == [edge] else gap) if value[0] else ("maybe", bool(inner) and inner[-1] == edge))
            else:
                out.append(gap)
        return out

    found: list[list[str]] = []
    before, run = gap, None
    for x in [*read(list(re._parser.parse(pattern))), gap]:
        if isinstance(x, set):
            if run is not None:
                run = {r + s for r in run for s in x}
            elif before == edge:
                run = x
            run, before = (run, edge) if run is not None and len(run) <= most else (None, gap)
        elif x == edge:
            if run is not None and "" not in run:
                found.append(sorted(run))
            before, run = edge, None
        elif not (isinstance(x, tuple) and x[1] and before == edge and run is None):
            before, run = gap, None
    return found


def index(pages: DataFrame, rules: tuple = PATTERN_RULES) -> list[tuple[str, str, list[str]]]:
    """(name, pattern, tokens): a rule is fetched by any of its tokens, the set of the pattern that is rarest in pages; without a token, by every URL.

    The count of each asked token is what reaches the driver. Ties go to the first set in order.
    """
    sets = {name: literal_tokens(pattern) for name, pattern in rules}
    asked = sorted({t for own in sets.values() for s in own for t in s})
    seen = pages.select(F.explode(F.filter(tokens(F.col("url")), lambda t: t.isin(asked))).alias("t")).groupBy("t").count() if asked else None
    count = {r.t: r["count"] for r in seen.collect()} if seen is not None else {}
    rarest = lambda own: min(own, key=lambda s: (sum(count.get(t, 0) for t in s), s)) if own else []
    return [(name, pattern, rarest(sets[name])) for name, pattern in rules]


def matching(df: DataFrame, indexed: list[tuple[str, str, list[str]]]) -> DataFrame:
    """df with hits, the names of the matching rules: a rule's expression is guarded by its tokens and compiled once."""
    asked = sorted({t for *_, own in indexed for t in own})
    df = df.select("*", F.explode(F.array(F.filter(tokens(F.col("url")), lambda t: t.isin(asked)) if asked else F.array().cast("array<string>"))).alias("_t"))
    hit = lambda pattern, own: F.coalesce((F.arrays_overlap("_t", F.array(*map(F.lit, own))) if own else F.lit(True)) & F.col("url").rlike(pattern), F.lit(False))
    names = [F.when(hit(pattern, own), F.lit(name)) for name, pattern, own in indexed]
    return df.withColumn("hits", F.concat("hits", F.filter(F.array(*names), lambda n: n.isNotNull()))).drop("_t") if names else df.drop("_t")


def judge(pages: DataFrame, host_rules: tuple = HOST_RULES, rules: tuple = PATTERN_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, patterns), a row for each row of pages.

    rule is the longest host rule that fits (as text, like ``net/``), else null; its verdict
    wins. Without one a URL is blocked if a pattern rule matches it, else allowed. patterns
    are the names of the matching pattern rules, in order. A null URL has an empty host and path, no rule
    and is allowed. Repeated rows stay; other columns are not read.
    """
    indexed = index(pages, rules)
    df = pages.select("page_id", F.col("url").cast("string").alias("url"), F.array().cast("array<string>").alias("hits"))
    for k in range(0, len(indexed), AT_ONCE):
        df = matching(df, indexed[k : k + AT_ONCE])
    host, path = parts(F.col("url"))
    df = df.select("page_id", host.alias("host"), path.alias("path"), F.array_join(F.array_sort("hits"), ",").alias("patterns"))
    fits = lambda h, p: ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
    ranked = sorted(host_rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)
    first = lambda value: reduce(lambda c, r: c.when(fits(r[1], r[2]), value(r)), ranked[1:], F.when(fits(ranked[0][1], ranked[0][2]), value(ranked[0]))) if ranked else F.lit(None).cast("string")
    verdict = F.coalesce(first(lambda r: r[0]), F.when(F.col("patterns") != "", "block").otherwise("allow"))
    return df.select("page_id", "host", "path", first(lambda r: r[1] + r[2]).alias("rule"), verdict.alias("verdict"), "patterns")


def _sql() -> str:
    fits = [(h + p, a, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for a, h, p in sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))]
    names = ", ".join(f"CASE WHEN regexp_matches(url, '{p}') THEN '{n}' END" for n, p in sorted(PATTERN_RULES))
    return f"""
WITH h AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {' '.join(f"WHEN {w} THEN '{r}'" for r, _, w in fits)} END AS rule, CASE {' '.join(f"WHEN {w} THEN '{a}'" for _, a, w in fits)} END AS v, concat_ws(',', {names}) AS patterns FROM h)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN patterns <> '' THEN 'block' ELSE 'allow' END) AS verdict, patterns FROM r
"""


SQL = _sql()
