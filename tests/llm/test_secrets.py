"""The secret scan against a plain version over (character, start, end) lists, and data that once was missed or slow."""

import base64
import bz2
import gzip
import random
import re
import time
import zlib
from urllib.parse import quote

import pytest

from spanveil.llm import secret_scan

SECRET = b"a password: hunter2hunter2 b"


def _scan(chars):
    text = "".join(c for c, _, _ in chars)
    return {(chars[s][1], chars[e - 1][2], kind) for s, e, kind in secret_scan.scan_layer(text)}


def _decoded(chars, pattern, read):
    """Each match of a pattern replaced by what ``read`` makes of it, which stands for all of the match."""
    text, out, at = "".join(c for c, _, _ in chars), [], 0
    for m in re.finditer(pattern, text):
        out += [*chars[at : m.start()], *((c, chars[m.start()][1], chars[m.end() - 1][2]) for c in read(m))]
        at = m.end()
    return out + chars[at:]


def _layers(chars):
    text = "".join(c for c, _, _ in chars)
    yield _decoded(chars, "%[0-9A-Fa-f]{2}", lambda m: chr(int(m[0][1:], 16)))
    yield _decoded(chars, r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}", lambda m: chr(int(m[0][2:], 16)))
    for alphabet in ("A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9+/_-"):
        for m in re.finditer(f"[{alphabet}]{{16,}}={{0,2}}", text):
            run = m[0].rstrip("=").translate(str.maketrans("-_", "+/"))
            run = run[: len(run) - (len(run) % 4 == 1)]
            raw = base64.b64decode(run + "=" * (-len(run) % 4))
            if raw[:2] == b"\x1f\x8b" or raw[:1] == b"x":
                tool, held = zlib.decompressobj(47), b""
                try:
                    for b in raw:  # up to the byte that breaks it
                        held += tool.decompress(bytes([b]))
                except zlib.error:
                    pass
                yield [(c, chars[m.start()][1], chars[m.end() - 1][2]) for c in held.decode("utf-8", "replace")]
            out, at = [], 0
            for c in raw.decode("utf-8", "surrogateescape"):  # a byte that is part of no character is one by itself
                end = at + len(c.encode("utf-8", "surrogateescape"))
                out.append((c, chars[m.start() + at * 8 // 6][1], chars[m.start() + ((end - 1) * 8 + 7) // 6][2]))
                at = end
            yield out


def plain_spans(text):
    """All spans, by decoding every layer of every layer."""
    work, seen, found = [[(c, i, i + 1) for i, c in enumerate(text)]], set(), set()
    while work:
        chars = work.pop()
        key = tuple(chars)
        if key not in seen:
            seen.add(key)
            found |= _scan(chars)
            work += _layers(chars)
    return found


WRAPS = {
    "url": lambda b, r: "".join(f"%{c:02x}" if r.random() < 0.7 or not chr(c).isalnum() else chr(c) for c in b).encode(),
    "unicode": lambda b, r: "".join(f"\\u{c:04x}" for c in b).encode(),
    "hex": lambda b, r: "".join(f"\\x{c:02X}" for c in b).encode(),
    "base64": lambda b, r: base64.b64encode(b),
    "urlsafe": lambda b, r: base64.urlsafe_b64encode(b).rstrip(b"="),
    "gzip": lambda b, r: base64.b64encode(gzip.compress(b, mtime=0)),
    "zlib": lambda b, r: base64.b64encode(zlib.compress(b)),
}


@pytest.mark.parametrize("seed", range(60))
def test_spans_equal_plain_ones(seed):
    r = random.Random(seed)
    body = r.choice([b"password: hunter2hunter2", b"AKIA" + b"Q7" * 9, b"token=zz.yy-xx1234", b"0123456789abcdef" * 2, b"nothing of note in here"])
    for _ in range(r.randrange(4)):
        body = WRAPS[r.choice(list(WRAPS))](r.choice([b"", b"to say: ", b"% "]) + body + r.choice([b"", b" ok", b" %41"]), r)
    text = f"word {body.decode()} end, secret = abcdef1"
    base, more = secret_scan.secret_spans(text)
    assert set(base) | set(more) == plain_spans(text)


@pytest.mark.parametrize("pack", [lambda b: gzip.compress(b, mtime=0), zlib.compress, bz2.compress])
@pytest.mark.parametrize("spell", [quote, lambda b: "".join(f"%{c:02x}" for c in b), lambda b: "".join(f"\\x{c:02x}" for c in b), lambda b: "".join(f"\\u{c:04x}" for c in b), repr])
def test_compressed_bytes_under_any_escape(pack, spell):
    text = f"data={spell(pack(SECRET * 5))} end"
    spans = secret_scan.secret_spans(text)[1]
    assert any(kind == "assign" and 5 <= s < e <= len(text) - 4 for s, e, kind in spans)


@pytest.mark.parametrize("depth", [1, 8, 9, 10, 12, 20, 300])
def test_every_layer_is_scanned(depth):
    text = "é %" + "25" * (depth - 1) + "deadbeef" * 3
    base, more = secret_scan.secret_spans(text)
    assert {(s, e) for s, e, _ in base + more} == {(3 + 2 * k, len(text)) for k in range(depth)}
    assert set(base + more) == plain_spans(text) or depth > 20  # what takes the plain version long


@pytest.mark.parametrize("depth", [9, 13, 20])
def test_deep_mixed_escapes_equal_plain_ones(depth):
    for seed in range(20):
        r = random.Random(seed * 100 + depth)
        text = r.choice(["password: hunter2hunter2", "AKIA" + "Q7" * 10, "0123456789abcdef" * 2])
        for _ in range(depth):
            at = r.randrange(len(text))
            text = text[:at] + r.choice([f"%{ord(text[at]):02x}", f"\\u{ord(text[at]):04x}", f"\\x{ord(text[at]):02x}"]) + text[at + 1 :]
        text = f"x {text} y"
        base, more = secret_scan.secret_spans(text)
        assert set(base) | set(more) == plain_spans(text)


def test_deep_escapes_take_linear_time():
    deep = ["%" + "25" * 60_000 + "61 ", "\\u005c" + "u005c" * 30_000 + "u0061 ", "%5c" + "u00255c" * 20_000 + "u0061 ", "%" * 50_000 + "25" * 50_000 + " "]
    start = time.process_time()
    for text in deep:
        found = secret_scan.secret_spans(text + "p%2561ssword: hunter2hunter2")[1]
        assert [s for s in found if s[2] == "assign"]
    assert time.process_time() - start < 30


@pytest.mark.parametrize("seed", range(40))
def test_spans_do_not_depend_on_the_work_of_layers(seed, monkeypatch):
    r = random.Random(seed)
    more = {
        "wide": lambda b, r: b"".join(bytes([c, 0]) for c in b),
        "mime": lambda b, r: base64.encodebytes(b),
        "escaped": lambda b, r: b.replace(b"e", b"%65").replace(b"%", b"%25"),
        "gzip bytes": lambda b, r: "".join(f"%{c:02x}" for c in gzip.compress(b, mtime=0)).encode(),
        "zlib bytes": lambda b, r: "".join(f"\\x{c:02x}" for c in zlib.compress(b)).encode(),
    }
    body = r.choice([b"password: hunter2hunter2", b"AKIA" + b"Q7" * 9, b"0123456789abcdef" * 2, "\u00e9 secret=\u0436abcdef77".encode()])
    for _ in range(r.randrange(1, 5)):
        body = r.choice([*WRAPS.values(), *more.values()])(r.choice([b"", b"% ", b"a, b;%%32", b"x" * 20 + b"\n"]) + body + r.choice([b"", b" %41", b"\nabc", b", %2525"]), r)
    text = f"word {body.decode('utf-8', 'replace')} %252525u0041,  %5c%78%34%31"
    spans = secret_scan.secret_spans(text)
    for name in ("LEAST_WORK", "WORK"):
        monkeypatch.setattr(secret_scan, name, 0)
    assert secret_scan.secret_spans(text) == spans


def test_wide_characters_in_opened_data_do_not_depend_on_the_work_of_layers(monkeypatch):
    inner = "%2525,;".encode() + "token,: (secret: hunter2hunter2)".encode("utf-16-le") + b"%2541,"
    text = base64.b64encode(gzip.compress(inner, mtime=0)).decode()
    spans = secret_scan.secret_spans(text)
    assert spans[1] == [(0, len(text), "assign")]
    for name in ("LEAST_WORK", "WORK"):
        monkeypatch.setattr(secret_scan, name, 0)
    assert secret_scan.secret_spans(text) == spans


@pytest.mark.parametrize("head", ["", "%252561%2561, ", "%" + "25" * 40 + "61 "])
def test_layers_of_deep_escapes_are_all_scanned(head):
    depth = 5000  # more characters in all layers than are made one by one
    text = head + "%" + "25" * (depth - 1) + "deadbeef" * 3
    found = {(s, e) for spans in secret_scan.secret_spans(text) for s, e, _ in spans}
    assert found >= {(len(head) + 1 + 2 * k, len(text)) for k in range(depth)}


@pytest.mark.parametrize("text", ["{0}{0}61 end", "{0}61 {0}61 {0}61 {0}61", "QQQQQQQQ{0}61", "{0}61, and {0}61, and {0}61"])
def test_several_deep_escapes_take_linear_time(text):
    start = time.process_time()
    secret_scan.secret_spans(text.format("%" + "25" * 10_000).replace("Q", "Q" * 2500))
    assert time.process_time() - start < 30


def test_secret_table_edges(spark):
    docs = spark.createDataFrame([(1, None, "r"), (2, "", "r"), (3, "token=abcdefg", "r"), (3, "token=abcdefg", "r")], "doc_id int, text string, row string")
    got = secret_scan.find_secrets(docs).collect()
    assert sorted((r.row.doc_id, r.got.n_assign, r.got.spans) for r in got) == [(1, 0, ""), (2, 0, ""), (3, 1, "assign:0:13"), (3, 1, "assign:0:13")]
    assert secret_scan.find_secrets(spark.createDataFrame([], "doc_id int, text string")).count() == 0
