"""Secret scans against a plain scan of the text, and planted nested encodings."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import pytest
import zstandard

from medoidlab.llm import secret_scan
from medoidlab.llm.secret_scan import KINDS, scan

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def listed(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def layered(text):
    spans, _, complete = scan(text.encode())
    assert complete
    return [(KINDS[k], text[a:b], path) for a, k, b, path in spans if path]


SECRET = "token = abcDEF123"
B64 = lambda b: base64.b64encode(b).decode()


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_of_random_texts(seed):
    rng = random.Random(seed)
    bits = ["Password", "token", "api_key", "APIKEY", ":", "=", " ", '"', "abc", "0123456789abcdef" * 2, "AKIA", "ZZ99" * 4]
    bits += ["é", "\n", "%41", "&#65;", "ſecret", "Kelvin: K", ".", "passwd='x-y_z/1'"]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        assert [(a, k, b) for a, k, b, path in scan(text.encode())[0] if not path] == base_spans(text)


PACK = [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress]


@pytest.mark.parametrize("pack", PACK)
def test_compressed_layers_stand_for_their_container(pack):
    inner = B64(pack(f"é {SECRET}\nnext".encode() * 20))
    text = f"Größe {inner} end"
    # Some formats keep the first copy readable, so the base64 layer may show it too.
    assert ("assign", inner.rstrip("="), "base64>compressed") in layered(text)


def test_nested_layers_until_fixpoint():
    text = "x " + B64(B64(gzip.compress(urllib.parse.quote(SECRET).encode())).encode()) + " y"
    (found,) = layered(text)
    assert found[0] == "assign" and found[2] == "base64>base64>compressed>url"
    assert layered("%2574oken=abcdefg") == [("assign", "%2574oken=abcdefg", "url>url")]


def test_spans_map_to_the_encoded_signs_only():
    pad = "some other words here, "
    text = "ö " + B64(f"{pad}{SECRET} and more".encode())
    (found,) = layered(text)
    start = 2 + len(pad) * 8 // 6
    end = 2 + -(-(len(pad) + len(SECRET)) * 8 // 6)
    assert found[1] == text[start:end]
    assert layered(r"a token=abcdefg &#x70;assword:xx12345 z") == [("assign", "&#x70;assword:xx12345", "unicode")]


@pytest.mark.parametrize("glue", ["", "k", "ab", "abc/", "path/to-"])
def test_runs_glued_to_other_letters_and_wrapped_lines(glue):
    assert [x[0] for x in layered(glue + B64(SECRET.encode()))] == ["assign"]
    wrapped = "\n".join(re.findall(".{1,64}", B64(b"x" * 44 + b" AKIA" + b"Q1" * 10 + b" " * 30)))
    assert ("access", "base64") in {(k, p) for k, _, p in layered(f"-- \n{wrapped}\n")}


def test_cycles_and_bombs_end():
    bomb = B64(gzip.compress(b"a" * (1 << 22)))
    spans, layers, complete = scan(f"{bomb} {SECRET}".encode(), most=1 << 20)
    assert not complete and [s[1] for s in spans] == [0]
    deep = "%" + "25" * 300 + "41"
    assert scan(deep.encode())[2]


def test_rows_of_documents(spark, tmp_path):
    texts = [None, "", "nothing", SECRET, SECRET, "q " * 60_000 + SECRET, "ü" * 9 + B64(SECRET.encode()), "deadbeef" * 4]
    rows = [(i % 6, t, "x", "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string, path string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = secret_scan.op13_secret_scan(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    want = sorted((i, base_spans(t or "")) for i, t, *_ in rows)
    got = sorted((r.doc_id, [(r.n_assign, r.n_access, r.n_hex), r.base_sha256]) for r in out)
    assert got == sorted(
        (i, [tuple(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(listed(spans).encode()).hexdigest()])
        for i, spans in want
    )
    assert {r.spans for r in out if r.doc_id == 0} == {"", "assign:9:32"}
    assert secret_scan.secrets(df.limit(0)).count() == 0
