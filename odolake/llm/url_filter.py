"""URL rules as wildcard patterns, all simulated at once by a bit-parallel Shift-And automaton.

Every pattern has a start bit and a bit for each of its characters, packed into as many 64-bit words as needed. Reading a
byte shifts all words by one, with carries between them, and masks the result with the bits that accept this byte; a wildcard
is a bit that stays set. The words of a whole batch of URLs advance together, byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import column

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[str, str]:
        """The host itself and its subdomains, with any path that starts as the rule's."""
        return f"{self.name}**", f"*.{self.name}**"


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
         Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
DEFAULT_VERDICT = "allow"


class Automaton:
    """Patterns of literal bytes, `?` (one byte but `/`), `*` (any run without `/`) and `**` (any run)."""

    def __init__(self, globs: Sequence[str]) -> None:
        starts, accept, loops, finals = [], [], [], []  # bit numbers; (bit, bytes)
        bit = 0
        slash, anything = {ord("/")}, set(range(256))
        for glob in globs:
            starts.append(bit)
            code, at = glob.encode(), 0
            while at < len(code):
                if code[at:at + 2] == b"**":
                    loops.append((bit, anything))
                    at += 2
                elif code[at:at + 1] == b"*":
                    loops.append((bit, anything - slash))
                    at += 1
                else:
                    bit += 1
                    accept.append((bit, anything - slash if code[at:at + 1] == b"?" else {code[at]}))
                    at += 1
            finals.append(bit)
            bit += 1
        self.words = -(-bit // 64)
        self.start = self._mask(starts)
        self.finals = finals
        self.step, self.stay = np.zeros((self.words, 256), np.uint64), np.zeros((self.words, 256), np.uint64)
        for table, pairs in ((self.step, accept), (self.stay, loops)):
            for b, codes in pairs:
                table[b // 64, list(codes)] |= np.uint64(1 << (b % 64))
        settled = self._mask([b for b, codes in loops if codes == anything and b in finals])
        self.open = ~settled

    def _mask(self, bits: Sequence[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        """(texts, patterns) of booleans: which patterns match each whole text."""
        count = len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, count)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        begins = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        state = np.repeat(self.start[:, None], count, axis=1)
        for t in range(int(lengths[0]) if count else 0):
            active = int(np.searchsorted(-lengths, -t, side="left"))  # texts longer than t
            now = state[:, :active]
            if t % 64 == 63 and not np.any(now & self.open[:, None]):
                break  # what has matched goes on matching, the rest cannot
            codes = data[begins[:active] + t]
            shifted = now << np.uint64(1)
            shifted[1:] |= now[:-1] >> np.uint64(63)
            state[:, :active] = shifted & self.step[:, codes] | now & self.stay[:, codes]
        out = np.empty((count, len(self.finals)), bool)
        for k, b in enumerate(self.finals):
            out[order, k] = (state[b // 64] >> np.uint64(b % 64)) & np.uint64(1) != 0
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path; both empty for a null url or one without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(canonical: Column, rules: Sequence[Rule]) -> Column:
    """Name of the longest rule that fits host + path, the earlier one of equal length; null where none does."""
    ranked = sorted(rules, key=lambda r: -len(r.name))
    automaton = Automaton([g for r in ranked for g in r.globs()])
    names = np.array([*[r.name for r in ranked], None], dtype=object)

    @F.pandas_udf("string")
    def rule(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = automaton.matches([x.encode("utf-8", "surrogatepass") for x in batch])
            either = found[:, 0::2] | found[:, 1::2]
            first = np.where(either.any(axis=1), either.argmax(axis=1), len(names) - 1)
            yield pd.Series(names[first], dtype=object)

    return rule(canonical)


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = DEFAULT_VERDICT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; a url that no rule fits gets `default`.

    A null url, or one without `://`, has an empty host and path, and no rule. A rule fits its host and all its subdomains if the
    path starts with the rule's. Repeated rows give repeated rows; other columns are not read. Non-ASCII bytes are ordinary ones.
    """
    if not rules:
        raise ValueError("at least one rule is needed")
    host, path = host_and_path(column(pages, "url"))
    rows = pages.select(column(pages, "page_id").alias("page_id"), host.alias("host"), path.alias("path"))
    judged = rows.withColumn("rule", fitting_rule(F.concat("host", "path"), rules))
    verdict = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.verdict)])
    return judged.withColumn("verdict", F.coalesce(F.try_element_at(verdict, F.col("rule")), F.lit(default)))
