"""Secret scans: base spans against the contract's own expressions, tests of randomness against simulation, planted secrets, false discoveries."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest

from calltrace.llm import secret_scan
from calltrace.llm.secret_scan import ENCODINGS, battery, encoding

KEYS = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    out = [("assign", *m.span()) for m in KEYS.finditer(text) if len(m.group(2)) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def told(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


PIECES = ['token = "', "PassWd:", "api_key", "APIKEY=", "secret", "'", '"', " ", "  ", "=", ":", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "é", "K", "ſecret=", "\n", "x", ".", "a1b2c3", "password"]


def test_base_spans_on_random_strings():
    rnd = random.Random(4)
    for _ in range(4000):
        t = "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(14)))
        assert [(secret_scan.KINDS[k], s, e) for s, k, e in secret_scan.base_spans(t)] == brute(t), t


def test_base_is_linear():
    for t in ("token" + " " * 400_000, "password " * 60_000, "AKIA" * 100_000, "abcdef" * 100_000, "0123456789abcdefg" * 30_000):
        secret_scan.base_spans(t)


@pytest.mark.parametrize("name", list(ENCODINGS))
def test_battery_keeps_random_tokens(name):
    """Random strings are rejected about as often as the level says, at every length."""
    rng = np.random.default_rng(2)
    size = len(ENCODINGS[name])
    for length in (16, 24, 40, 200):
        p = [battery(rng.integers(0, size, length), size) for _ in range(1500)]
        assert np.mean(np.array(p) < 0.01) < 0.03 and np.mean(np.array(p) < 0.001) < 0.012


def test_battery_rejects_patterns():
    for t in ("a" * 40, "abcdefghijklmnopqrstuvwxyz", "0123456789" * 4, "abababababababababababab", "----------------________", "AAAABBBBCCCCDDDDEEEEFFFF"):
        _, size, codes = encoding(t)
        assert battery(codes, size) < 0.001, t
    assert encoding("0123456789012345")[0] == "decimal" and encoding("a+b-c") is None and encoding("Zz0_")[0] == "base64url"


WORDS = [f"{a}{b}" for a in "the of and to in is that re con per st ble ing tion er an".split() for b in "o a en it us ard ix um eth al".split()]


def make(seed=9, n=400):
    rnd = random.Random(seed)
    planted, rows = {}, []
    for i in range(n):
        w = [rnd.choice(WORDS) for _ in range(rnd.randrange(4, 120))]
        w += ["".join(rnd.choice(WORDS) for _ in range(6)) for _ in range(3)]  # long ordinary words
        w += [str(rnd.randrange(10**15, 10**16)), "2026-11-28", "user_name_field_2", "-" * 30, f"{rnd.choice(WORDS).title()}{rnd.choice(WORDS).title()}Handler", "0123456789" * 3]
        w += [str(rnd.randrange(1000)) for _ in range(4)]
        rnd.shuffle(w)
        if i % 8 == 3:
            key = {
                0: base64.b64encode(rnd.randbytes(30)).decode(), 1: base64.urlsafe_b64encode(rnd.randbytes(33)).decode(), 2: hashlib.sha1(str(i).encode()).hexdigest().upper(),
                3: "".join(rnd.choice(ENCODINGS["base62"]) for _ in range(36)), 4: base64.b32encode(rnd.randbytes(35)).decode(),
            }[i // 8 % 5]
            w.insert(rnd.randrange(len(w)), key)
            planted[i] = key
        if i % 10 == 7:
            w.insert(3, 'token = "' + rnd.randbytes(20).hex() + '"')
        rows.append((i, "é " + " ".join(w), "clash", [1]))
    rows += [(1000, None, None, None), (1001, "", None, None), (None, rows[7][1], None, None), rows[7], (1002, "x" * 300_000, None, None), (1003, " \n\t", None, None)]
    return rows, planted


SCHEMA = "doc_id long, text string, base string, found array<int>"


def test_secrets(spark, tmp_path):
    rows, planted = make()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = secret_scan.op12_secret_scan(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[7]) == 2
    texts = {d: t or "" for d, t, *_ in rows}
    false = missed = 0
    for d, rs in by.items():
        base = brute(texts[d])
        for r in rs:
            assert r.base_sha256 == hashlib.sha256(told(base).encode()).hexdigest()
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
            spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
            added = [s for s in spans if s[0] == "random"]
            assert [s for s in spans if s[0] != "random"] == base and spans == sorted(spans, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))
            values = {texts[d][s:e] for _, s, e in added}
            missed += d in planted and planted[d] not in values
            false += len(values - {planted.get(d)})
    assert missed <= 1 and false == 0, (missed, false)


def test_thresholds_follow_their_definition(spark):
    """Against the plain e-BH rule on the stepped values, band by band."""
    rng = np.random.default_rng(8)
    rows = [(int(b), int(s), i) for b in (5, 6, 7) for i, s in enumerate(np.concatenate([rng.integers(-80, 10, 300), rng.integers(20, 200, {5: 4, 6: 0, 7: 60}[b])]))]
    got = secret_scan.thresholds(spark.createDataFrame(rows + rows[:50], "band int, step int, token long"), 0.01)
    for b in (5, 6, 7):
        e = sorted((np.exp(s / secret_scan.STEPS) for k, s, _ in rows if k == b), reverse=True)
        ks = [k for k in range(1, len(e) + 1) if e[k - 1] >= len(e) / (0.01 * k) * (1 - 1e-12)]
        want = {s for k, s, _ in rows if k == b and np.exp(s / secret_scan.STEPS) >= e[max(ks) - 1] * (1 - 1e-12)} if ks else set()
        assert {s for k, s, _ in rows if k == b and b in got and s >= got[b]} == want


def test_chains_are_distributions():
    for counts in (np.zeros((67, 66)), np.random.default_rng(1).integers(0, 90, (67, 66)).astype(float)):
        assert np.allclose(np.exp(secret_scan.chains(counts)).sum(axis=2), 1)


def test_nothing_to_scan(spark):
    out = secret_scan.find_secrets(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["doc_id", "base", "spans"]
