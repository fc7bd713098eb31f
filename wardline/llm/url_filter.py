"""Operator 9, URL filters: a bit-parallel wildcard automaton.

Every glob rule becomes a run of bits in one multiword Shift-And state. Many canonical URLs of like length advance together, one
character at a time, so that all rules are simulated on all of them by a few word operations a character. The matrix of characters
holds at most `CELLS` of them; a longer URL advances alone, over the same masks as one wide integer, in constant memory.

Canonical URL: "." + host + path, with the host in lower case (A-Z), both empty without "://". In a glob, "*" stands for any run
of characters other than "/", "**" for any run, and every other character for itself; a rule fits whole URLs. The rule of the
greatest length (of its label) that fits decides; ties go to the earlier rule. URLs that no listed rule fits get the verdict of the
method's own globs: block if one fits, else allow.

Cases: a null or empty url, or one without "://", has an empty host and path and fits no listed rule, and is allowed unless a glob
fits the empty string. Ids pass through untouched, null ones too. Repeated rows each get their row. URLs are whole, however long. Rules may be any number of characters long in all; the state has as many
64-bit words as they need. Columns of the input other than the two named are not read, and clash with nothing."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that are advanced together; a URL of more than LONG goes alone.
CELLS, LONG = 1 << 22, 2048
#: (verdict, host, path) of listed rules; a rule fits the host and its subdomains where the path starts with "/" + path.
LISTED = [("block", "com", "en/"), ("allow", "example.com", "en/7"), ("allow", "net", "de/"), ("block", "example.net", "de/8"), ("block", "org", "es/")]
#: Globs of the method itself, over the canonical URL; they block.
GLOBS = [
    "**adult**", "**casino**", "**porn**", "**xxx**", "*free-bets*/**", "*.bet/**", "*gambl*/**", "*viagra*/**", "*torrent*/**", "*warez*/**", "**malware**", "**phish**",
    "**/wp-admin/**", "**/login**", "**/cart/**", "**.exe", "**.zip", "**.apk",
]


def listed_glob(host: str, path: str) -> str:
    return f"*.{host}/{path}**"


class ShiftAnd:
    """All globs at once. State bit i of a glob: its first i characters are matched; stars keep their bit alive."""

    def __init__(self, globs: list[str]):
        steps = []
        for g in globs:
            chars, stars, i = [], {}, 0
            while i < len(g):
                if g[i] == "*":
                    wide = g[i : i + 2] == "**"
                    stars[len(chars)] = stars.get(len(chars), False) or wide
                    i += 1 + wide
                else:
                    chars.append(g[i])
                    i += 1
            steps.append((chars, stars))
        bits = sum(len(c) + 1 for c, _ in steps)
        self.words = max(1, -(-bits // 64))
        code = {c: k + 1 for k, c in enumerate(sorted({c for cs, _ in steps for c in cs} | {"/"}))}
        self.code = code  # 0: any character that no glob names
        self.move = np.zeros((len(code) + 1, self.words), np.uint64)
        self.stay = np.zeros((len(code) + 1, self.words), np.uint64)
        self.begin = np.zeros(self.words, np.uint64)
        self.last: list[tuple[int, int]] = []
        at = 0
        for chars, stars in steps:
            self.begin[at // 64] |= np.uint64(1) << np.uint64(at % 64)
            for i, c in enumerate(chars):
                self.move[code[c], (at + i + 1) // 64] |= np.uint64(1) << np.uint64((at + i + 1) % 64)
            for i, wide in stars.items():
                for k in range(len(code) + 1):
                    if wide or k != code["/"]:
                        self.stay[k, (at + i) // 64] |= np.uint64(1) << np.uint64((at + i) % 64)
            self.last.append(divmod(at + len(chars), 64))
            at += len(chars) + 1

    def match(self, urls: list[str]) -> np.ndarray:
        """A row for each URL and a column for each glob: whether it fits the whole URL."""
        out = np.zeros((len(urls), len(self.last)), bool)
        size = np.array([len(u) for u in urls], np.int64)
        for i in np.flatnonzero(size > LONG):
            out[i] = self._alone(urls[i])
        order = np.argsort(size, kind="stable")[: int((size <= LONG).sum())]
        a = 0
        while a < len(order):  # URLs of like length together
            b = min(len(order), a + max(1, CELLS // LONG))
            self._together([urls[i] for i in order[a:b]], size[order[a:b]], order[a:b], out)
            a = b
        return out

    def _together(self, part: list[str], size: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        codes = np.zeros((len(part), max(1, int(size[-1]))), np.int32)
        for i, u in enumerate(part):
            codes[i, : len(u)] = [self.code.get(c, 0) for c in u]
        state = np.tile(self.begin, (len(part), 1))
        for t in range(int(size[-1])):
            live = int(np.searchsorted(size, t, "right"))
            c, s = codes[live:, t], state[live:]
            shifted = s << np.uint64(1)
            shifted[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[live:] = (shifted & self.move[c]) | (s & self.stay[c])
        for k, (word, bit) in enumerate(self.last):
            out[rows, k] = (state[:, word] >> np.uint64(bit)) & np.uint64(1) == 1

    def _alone(self, url: str) -> list[bool]:
        wide = lambda words: sum(int(x) << (64 * i) for i, x in enumerate(words))
        move, stay, state = [wide(x) for x in self.move], [wide(x) for x in self.stay], wide(self.begin)
        for ch in url:
            c = self.code.get(ch, 0)
            state = ((state << 1) & move[c]) | (state & stay[c])
        return [bool(state >> (64 * word + bit) & 1) for word, bit in self.last]


def url_parts(url):
    """(host, path) columns of a url column."""
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)") if isinstance(url, str) else url.substr(cut + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", listed=LISTED, globs=GLOBS) -> DataFrame:
    """id, host, path, rule, verdict and method_glob (the method's glob that fits first, where no listed rule does)."""
    host, path = url_parts(F.col(url_col))
    rows = df.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rules, method = [(v, h + "/" + p) for v, h, p in listed], list(globs)
    patterns = [listed_glob(h, p) for _, h, p in listed] + method

    def judge(batches):
        automaton = ShiftAnd(patterns)
        best = sorted(range(len(rules)), key=lambda k: (-len(rules[k][1]), k))
        for batch in batches:
            urls = ["." + h + p if h or p else "" for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            fits = automaton.match(urls)
            rule, verdict, glob = [], [], []
            for row in fits:
                k = next((k for k in best if row[k]), None)
                g = next((g for g, hit in zip(method, row[len(rules) :]) if hit), None) if k is None else None
                rule.append(None if k is None else rules[k][1])
                verdict.append(rules[k][0] if k is not None else "block" if g else "allow")
                glob.append(g)
            found = [pa.array(x, pa.string()) for x in (rule, verdict, glob)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("page_id", "host", "path")] + found, names=["page_id", "host", "path", "rule", "verdict", "method_glob"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string, method_glob string")


def query(spark, sf_dir):
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _like(g: str) -> str:
    return "^" + "".join("(?s:.*)" if x == "**" else "[^/]*" if x == "*" else re.escape(x) for x in re.split(r"(\*\*|\*)", g) if x) + "$"


def _sql() -> str:
    ranked = sorted(LISTED, key=lambda r: -len(r[1] + r[2]))
    fits = [(v, h + "/" + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')") for v, h, p in ranked]
    glob = " ".join(f"WHEN regexp_matches(canon, '{_like(g)}') THEN '{g}'" for g in GLOBS)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
part AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {" ".join(f"WHEN {c} THEN '{r}'" for _, r, c in fits)} END AS rule,
                 CASE WHEN host = '' AND path = '' THEN '' ELSE '.' || host || path END AS canon FROM part),
globbed AS (SELECT *, CASE WHEN rule IS NULL THEN CASE {glob} END END AS method_glob FROM ruled)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r, _ in fits)} WHEN method_glob IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, method_glob
FROM globbed"""


QUERIES = {"op9_url_filters": query}
ORACLE = {"op9_url_filters": _sql()}
