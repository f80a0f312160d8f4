"""URL rules as one bit-parallel automaton.

All glob rules are packed one after the other into the bits of several 64-bit words. For every character there is a
mask of the positions that accept it; a step shifts all words by one bit with carry, lets each rule start at the first
character only, and masks. A position that is followed by a wildcard keeps itself alive over every character the
wildcard may eat. After the last character the final bits say which rules fit. One pass over the characters
simulates all rules, for all URLs of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters above this are one class: no rule names them, wildcards eat them.
OTHER = 128
ONE = np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """``pattern`` over host and path: ``*`` any characters but ``/``, ``**`` any, ``?`` one but ``/``."""

    pattern: str
    verdict: str
    name: str | None = None
    rank: int = 0


def site_rules(rules: list[tuple[str, str, str]]) -> list[Rule]:
    """(verdict, host, path) as patterns: the host itself and all its subdomains, paths that start so.

    The rank is the length, so that the longest rule wins.
    """
    out = []
    for verdict, host, path in rules:
        name = host + path
        out += [Rule(f"{name}**", verdict, name, len(name)), Rule(f"*.{name}**", verdict, name, len(name))]
    return out


# The rules of the contract.
SITES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
# What decides where no site rule does; everything else is allowed.
LISTS = [Rule(p, "block") for p in (
    "*casino*", "*casino*/**", "*poker*", "*poker*/**", "*-bet.*", "*-bet.*/**", "*viagra*", "*viagra*/**", "*xxx*", "*xxx*/**",
    "ads.*", "ads.*/**", "*.ads.*", "*.ads.*/**", "**/ads/**", "**/adserver/**", "**/banner/**", "**.exe", "**.zip", "**.apk",
    "**/login", "**/login/**", "**/signup", "**/signup/**", "**/cart", "**/cart/**", "**/wp-admin/**",
)]


class Automaton:
    """The rules in bits; ``run`` gives for each text and rule whether it fits."""

    def __init__(self, rules: list[Rule]):
        items: list[tuple[str, str]] = []  # what a position accepts, and what it may eat afterwards
        starts, self.ends, eats_first = [], [], []
        for rule in rules:
            starts.append(len(items))
            # A position in front of the first character that only carries the leading wildcard.
            items.append(("", ""))
            p, i = rule.pattern, 0
            while i < len(p):
                if p[i] == "*":
                    deep = p[i:i + 2] == "**"
                    accept, eat = items[-1]
                    items[-1] = (accept, "**" if deep or eat == "**" else "*")
                    i += 2 if deep else 1
                else:
                    items.append((p[i], ""))
                    i += 1
            self.ends.append(len(items) - 1)
        self.words = max(1, -(-len(items) // 64))
        self.accept = np.zeros((OTHER + 1, self.words), np.uint64)
        self.keep = np.zeros((OTHER + 1, self.words), np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        not_first = np.full(self.words, ~np.uint64(0))
        for s in starts:
            self.first[s // 64] |= ONE << np.uint64(s % 64)
            not_first[s // 64] &= ~(ONE << np.uint64(s % 64))
        slash = ord("/")
        for at, (char, eat) in enumerate(items):
            w, bit = at // 64, ONE << np.uint64(at % 64)
            if char == "?":
                self.accept[:, w] |= bit
                self.accept[slash, w] &= ~bit
            elif char:
                if ord(char) >= OTHER:
                    raise ValueError("rules are ASCII; write other characters as ?")
                self.accept[ord(char), w] |= bit
            if eat:
                self.keep[:, w] |= bit
                if eat == "*":
                    self.keep[slash, w] &= ~bit
        # Nothing shifts from one rule's last bit into the next rule's first.
        self.accept &= not_first

    def run(self, texts: list[str]) -> np.ndarray:
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        codes = np.minimum(codes, OTHER).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])[order] if len(texts) else np.zeros(0, np.int64)
        left = sizes[order]
        state = np.tile(self.first, (len(texts), 1))
        live = len(texts)
        for i in range(int(left[0]) if len(texts) else 0):
            while live and left[live - 1] <= i:  # the shorter ones have ended
                live -= 1
            c = codes[begin[:live] + i]
            now = state[:live]
            moved = now << ONE
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.accept[c]) | (now & self.keep[c])
        fits = np.zeros((len(texts), len(self.ends)), bool)
        for k, e in enumerate(self.ends):
            fits[order, k] = (state[:, e // 64] >> np.uint64(e % 64)) & ONE != 0
        return fits


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (ASCII only) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    known = url.isNotNull() & (at > 0)
    return F.when(known, F.translate(host, upper, lower)).otherwise(""), F.when(known, path).otherwise("")


def judge(pages: DataFrame, sites: list[Rule], lists: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, the longest site rule that fits, and the verdict.

    Where no site rule fits, ``lists`` decide (any fit gives its verdict), else ``default``. Of equally long site
    rules the first wins. A null url or one without ``://`` has an empty host and path, which only a rule of wildcards
    fits. Other columns pass through; columns with the names of the results are replaced.
    """
    rules = [*sites, *lists]
    by_rank = sorted(range(len(sites)), key=lambda k: (sites[k].rank, -k))

    @F.arrow_udf("struct<rule:string,verdict:string>")
    def fit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = Automaton(rules)
        names = np.array([r.name for r in sites] + [None] * (len(lists) + 1), object)
        verdicts = np.array([r.verdict for r in rules] + [default], object)
        for batch in batches:
            fits = automaton.run([x or "" for x in batch.to_pylist()])
            pick = np.full(len(fits), len(rules))
            for k in range(len(rules) - 1, len(sites) - 1, -1):
                pick[fits[:, k]] = k
            for k in by_rank:
                pick[fits[:, k]] = k
            yield pa.StructArray.from_arrays([pa.array(names[pick], pa.string()), pa.array(verdicts[pick], pa.string())], ["rule", "verdict"])

    host, path = host_and_path(F.col(url))
    out = pages.withColumns({"host": host, "path": path}).withColumn("verdict", fit(F.concat("host", "path")))
    return out.withColumns({"rule": F.col("verdict.rule"), "verdict": F.col("verdict.verdict")})


def verdicts(pages: DataFrame) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return judge(pages.select("page_id", "url"), site_rules(SITES), LISTS).select("page_id", "host", "path", "rule", "verdict")


def _like(pattern: str) -> str:
    """The same glob as a regular expression, for the comparison in SQL."""
    out, i = "", 0
    while i < len(pattern):
        if pattern[i:i + 2] == "**":
            out, i = out + "(.|\\n)*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + ("[^/]" if pattern[i] == "?" else "\\" + pattern[i] if not pattern[i].isalnum() else pattern[i]), i + 1
    return f"^{out}$"


def _sql() -> str:
    sites = " ".join(
        f"WHEN regexp_full_match(host || path, '{_like(r.pattern)[1:-1]}') THEN '{r.name}'"
        for r in sorted(site_rules(SITES), key=lambda r: -r.rank))
    verdict = " ".join(f"WHEN '{h + p}' THEN '{v}'" for v, h, p in SITES)
    lists = " OR ".join(f"regexp_full_match(host || path, '{_like(r.pattern)[1:-1]}')" for r in LISTS)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {sites} ELSE NULL END AS rule FROM named)
SELECT page_id, host, path, rule, CASE rule {verdict} ELSE CASE WHEN {lists} THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled"""


SQL = _sql()
