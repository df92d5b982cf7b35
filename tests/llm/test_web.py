"""WARC archives and URL rules."""

from __future__ import annotations

import base64
import fnmatch
import gzip
import hashlib
import itertools
import re

import pandas as pd
import pytest

from odolake.llm import warc
from odolake.llm.url_filter import RULES, Automaton, Rule, judge_urls
from odolake.session import shared_dir

PAGES = "page_id bigint, url string, html string, payload int"


def test_archives_give_back_every_payload(spark):
    long = "WARC/1.1\r\n\r\nno record\r\n\r\n" + "é" * 30_000
    rows = [(1, "http://x/", "a b"), (2, "http://x/\r\nHost: y", "a b"), (3, None, None), (4, "u", ""), (2, "http://x/", "a b"),
            (None, "u", "a b"), (None, "u", "only"), (5, "u", long), (6, "u", long + "!"), (7, "u", long)]
    folder = f"{shared_dir(spark)}/warc-test-{id(rows)}"
    warc.write_archives(spark.createDataFrame([(*r, 0) for r in rows], PAGES), folder)
    read = warc.read_archives(spark, folder).toPandas()
    assert read["valid"].all() and len(read) == len(rows)
    assert {bytes(x).decode() for x in read["payload"] if x is not None} == {html or "" for _, _, html in rows}
    got = sorted((tuple(None if pd.isna(v) else v for v in r) for r in warc.page_digests(spark, folder).toPandas().itertuples(index=False)), key=str)

    def expected(page, html):
        data = (html or "").encode()
        last = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        kind = "response" if page == last else "revisit"
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        return page, len(data), digest, kind, last if kind == "revisit" else None

    assert got == sorted((expected(p, h) for p, _, h in rows), key=str)


def test_an_empty_table_gives_no_records(spark):
    folder = f"{shared_dir(spark)}/warc-empty-{id(spark)}"
    warc.write_archives(spark.createDataFrame([], PAGES), folder)
    assert warc.read_archives(spark, folder).count() == warc.page_digests(spark, folder).count() == 0


def test_framing_and_segments():
    payload = bytes(range(256)) * 40
    assert warc.unchunk(warc.chunk_frames(payload, 1000)) == payload and warc.unchunk(warc.chunk_frames(b"")) == b""
    assert warc.unchunk(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"
    for broken in (b"4\r\nabc\r\n0\r\n\r\n", b"3\r\nabc", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unchunk(broken)
    records = list(warc.page_records("7", "http://x/", payload, None, False, 2_000))
    parsed = list(warc.parse_records(gzip.compress(b"\r\n\r\n".join(records) + b"\r\n\r\n")))
    assert len(parsed) == len(records) > 5
    assert parsed[0][0]["warc-segment-number"] == "1" and "warc-segment-total-length" in parsed[-1][0]
    table = pd.DataFrame([(h["warc-record-id"].strip("<>"), h["warc-type"], h["warc-target-uri"], None, h["warc-payload-digest"][5:],
                           h.get("warc-segment-origin-id"), int(h["warc-segment-number"]),
                           int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, b) for h, b in parsed],
                         columns=[f.split()[0] for f in warc._PARSED.split(", ")])
    shuffled = warc._assemble(table.sample(frac=1, random_state=1))
    assert bool(shuffled["valid"][0]) and shuffled["payload"][0] == payload
    for bad in (table.drop(index=2), table.drop(index=len(table) - 1), pd.concat([table, table.iloc[[3]]])):
        assert not warc._assemble(bad)["valid"][0]


def test_automaton_matches_plain_globs():
    globs = ["*.a.b/x**", "a?b", "**c", "*", "aa*b**", "a.b/x" * 20 + "**"]
    patterns = [re.compile("".join({"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|.", g))) for g in globs]
    texts = ["".join(t) for n in range(5) for t in itertools.product("ab/c", repeat=n)] + ["z.a.b/xq", "/z.a.b/x", "a.b/x" * 20, "a.b/x" * 300, "q" * 200 + ".a.b/x"]
    got = Automaton(globs).matches([t.encode() for t in texts])
    for text, row in zip(texts, got):
        assert row.tolist() == [bool(p.fullmatch(text)) for p in patterns], text
    assert Automaton(["a*"]).matches([]).shape == (0, 1) and fnmatch.fnmatch("a.b", "a*")


def test_url_verdicts(spark):
    urls = {1: "HTTP://WWW.Example.com/en/x?y#z", 2: "https://example.com/en/", 3: "http://my.example.com/en/a", 4: "http://notexample.com/en/a",
            5: "http://a.net/es/1", 6: "http://net/fr/", 7: "http://a.net/de/", 8: "example.com/en/", 9: None, 10: "http://x.com?/en/",
            11: "http://com/", 12: "x://http://com/", 13: "", 14: "http://ÜX.COM/en", 15: "http://net.evil.org/x.com/", 16: "http://b.com/" + "a" * 20_000}
    rows = judge_urls(spark.createDataFrame([(k, v, "x") for k, v in [*urls.items(), (1, urls[1]), (None, urls[5])]], "page_id bigint, url string, rule string")).collect()
    assert len(rows) == 18
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2] == ("example.com", "/en/", "example.com/en/", "block") and got[3][2:] == ("example.com/en/", "block")
    assert got[4][2:] == ("com/", "allow") and got[5][2:] == ("net/es/", "block") == got[None][2:] and got[6][2:] == ("net/fr/", "block")
    assert got[7][2:] == (None, "allow") and got[8] == ("", "", None, "allow") == got[9] == got[13]
    assert got[10] == ("x.com", "", None, "allow") and got[11][2] == "com/" and got[12] == ("http:", "//com/", None, "allow")
    assert got[14] == ("Üx.com", "/en", "com/", "allow") and got[15][2] is None and got[16][2] == "com/"
    assert judge_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
    assert {r["verdict"] for r in judge_urls(spark.createDataFrame([(1, "http://a/")], "page_id int, url string"), [Rule("allow", "b", "/")], "block").collect()} == {"block"}
    assert len({r.name for r in RULES}) == 5
