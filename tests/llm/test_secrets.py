import re

from loomtext.llm import secrets

PLAIN = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
PLAIN += [(r.name, r.pattern, r.group, r.least) for r in secrets.EXTRA]
TEXTS = [
    None,
    "",
    "token=abcdef",
    "PassWord : 'longenough1' and secret:token:abcdef12",
    "token = x token=abcdefgh",
    "AKIA" + "B" * 15 + " AKIA" + "B" * 16 + "AKIA",
    "é" * 50 + "api_key: \"0123456789abcdef01234567\"",
    "deadbeef" * 3 + "g" + "0" * 23,
    "apikey=a.b_c/d+e=-f APIKEY=1234567",
    "token=abcdefg " * 300,
    "😀 secret=abcdef😀",
    "-----BEGIN RSA PRIVATE KEY-----\nx -----BEGIN PRIVATE KEY----- -----BEGIN KEY-----",
    "GHP_ ghp_" + "aB3" * 12 + " gho_short xoxb-12345-abcdefgh",
    "AIza" + "x_-" * 11 + "yz sk_live_" + "0a" * 9 + " eyJhbGciOiJI.eyJzdWIiOiIx.sig-_ eyJhbGciOiJI.x",
    "password=" + "x" * 300_000 + " " + "0f" * 100_000,
]


def brute(t):
    found = [(m.start(), k, m.end(), n) for k, (n, p, g, least) in enumerate(PLAIN) for m in re.finditer(p, t or "") if len(m.group(g)) >= least]
    return [(n, a, b) for a, k, b, n in sorted(found)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, _id int, _rules string")


def test_spans_against_plain_search(spark):
    rows = [(i, t, "own", 1, "r") for i, t in enumerate(TEXTS)] + [(None, "token=abcdef", "own", 1, "r"), (2, "nothing", "own", 1, "r")]
    got = secrets.scan_secrets(frame(spark, rows))
    assert sorted(got.columns) == sorted(["doc_id", "text", "spans", "_id", "_rules"])
    assert got.count() == len(rows)
    for r in got.collect():
        assert [(s.kind, s.start, s.end) for s in r.spans] == brute(r.text)
        assert r["_id"] == 1


def test_trigram_queries_lose_no_match():
    for r in secrets.RULES:
        q = secrets.trigram_query(r.pattern)
        for t in TEXTS:
            if t and re.search(r.pattern, t):
                low = t.lower()
                assert any(all(g in low for g in conj) for conj in q)
    assert frozenset() in secrets.trigram_query("[0-9a-f]{24,}")
    assert secrets.trigram_query("a(bc|d)e?f") == frozenset({frozenset({"abc", "bce", "cef"}), frozenset({"abc", "bcf"}), frozenset({"ade", "def"}), frozenset({"adf"})})


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(i, t, "own", 1, "r") for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in secrets.redact(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(TEXTS):
        spans, out, at = brute(t), "", 0
        for _, a, b in spans:
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        assert got[i].text == (out + t[at:] if spans else t)
        assert got[i].spans == "own"


def test_rules_that_are_found():
    seen = {n for t in TEXTS for n, *_ in brute(t)}
    assert seen == {r.name for r in secrets.RULES}
    assert all(frozenset() not in secrets.trigram_query(r.pattern) for r in secrets.EXTRA)


def test_empty_and_only_full_scans(spark):
    assert secrets.scan_secrets(frame(spark, [])).count() == 0
    only = secrets.scan_secrets(frame(spark, [(1, "a" * 30, None, None, None)]), (secrets.RULES[2],))
    assert len(only.first().spans) == 1


def test_long_text_full_of_secrets(spark):
    t = "".join(f"é token=abc{i:06d} {'0f' * 12 if i % 7 == 0 else ''} AKIA{'B' * (14 + i % 4)}\n" for i in range(8_000))
    d = frame(spark, [(1, t, "own", 1, "r")])
    got = secrets.scan_secrets(d).first()
    assert [(s.kind, s.start, s.end) for s in got.spans] == brute(t)
    out, at = "", 0
    for _, a, b in brute(t):
        if a >= at:
            out += t[at:a] + "[SECRET]"
        at = max(at, b)
    assert secrets.redact(d).first().text == out + t[at:]
