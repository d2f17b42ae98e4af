import base64
import gzip
import hashlib
import io
import random
import re
import zipfile

import numpy as np
import pyarrow as pa
import pytest

from keyloom.llm import _text, archive, token_counts, url_filter


def test_round_trip(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, "http://c/ x\r\n", "other\r\n\r\nlines"), (4, None, None), (5, "u", ""), (5, "u", ""), (None, "n", "null id"), (None, "n", "<p>é</p>"), (9, "long", "z" * 300_000)]
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, digest string")
    out = archive.round_trip(pages).collect()
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        top = max((j for j, _, g in rows if (g or "") == (h or "") and j is not None), default=None)
        again = top is not None and i != top
        want.append((str(i), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", str(top) if again else "None"))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in out) == sorted(want)
    assert {bytes(r["payload"]) for r in out if r["payload"] is not None} == {(h or "").encode() for _, _, h in rows}
    assert archive.round_trip(pages.limit(0)).count() == 0


def test_zip64_and_other_writers(tmp_path, monkeypatch):
    """Directories of another writer, with and without ZIP64 records, a comment and a compressed member."""
    for name, limit in (("plain", None), ("wide", 3)):
        if limit:
            monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
            monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
        path = tmp_path / f"{name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("first", b"0123456789")
            z.writestr(archive.WARC, gzip.compress(b"record"))
            z.writestr("packed", b"x" * 1000, zipfile.ZIP_DEFLATED)
            z.comment = b"a comment"
        reader = archive.Reader(f"file://{path}")
        members = reader.members()
        assert list(members) == ["first", archive.WARC, "packed"]
        m = reader.stored(archive.WARC)
        assert gzip.decompress(reader.range(m.start, m.size)) == b"record"
        with pytest.raises(ValueError, match="compressed"):
            reader.stored("packed")
    (tmp_path / "no.zip").write_bytes(b"nothing")
    with pytest.raises(ValueError, match="end record"):
        archive.Reader(f"file://{tmp_path}/no.zip").members()


def test_records_parse_back():
    raw = archive.record("3", "http://x", b"body\r\n\r\nmore", None, False)
    head, block = archive.parse_record(raw)
    assert head["warc-type"] == "response" and block.endswith(b"body\r\n\r\nmore") and raw.endswith(b"\r\n\r\n")
    assert gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(raw))).read() == raw


def test_token_counts(spark):
    of = token_counts.Tokenizer(token_counts.TOKENIZER)
    texts = ["Hello world", "", None, "a" * 3000, "é ü ẞ \n\n x", "<|endoftext|>", "word " * 2000]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(0, texts[0], 5), (None, "x", 5)], "doc_id long, text string, n_tokens int").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.token_counts(docs, block=7).collect())
    want = sorted([(str(i), len(of.encode(t))) for i, t in enumerate(texts)] + [("0", len(of.encode(texts[0]))), ("None", 1)])
    assert got == want
    assert token_counts.token_counts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 3, 64])
@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_scan_stitches_blocks(spark, tmp_path, block, dtype):
    rng = random.Random(block)
    files = []
    for k, docs in enumerate([[5, 0, 0, 17, 1], [40], [0], [], [3, 9]]):
        ids = []
        for n in docs:
            ids += [rng.randrange(9) for _ in range(n)] + [9]
        if k == 4:
            ids.pop()  # the last document is open
        (tmp_path / str(k)).write_bytes(np.array(ids, dtype).tobytes())
        files.append((f"file://{tmp_path}/{k}", len(ids), docs))
    out = token_counts.scan(spark.createDataFrame([f[:2] for f in files], "file string, tokens long"), 9, dtype, block).collect()
    assert sorted((r["file"], r["place"], r["n_tokens"]) for r in out) == sorted((f, i, n) for f, _, docs in files for i, n in enumerate(docs))


RULES = [url_filter.Rule("block", "com", "/en/"), url_filter.Rule("allow", "example.com", "/en/7"), url_filter.Rule("block", "org", "/es/")]


def parts(url):
    """Host and path by their definition."""
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
    cut = rest.find("/") if "/" in rest else len(rest)
    return re.sub("[A-Z]", lambda m: m[0].lower(), rest[:cut]), rest[cut:]


def fits(rule, host, path):
    return (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)


def test_rules(spark):
    urls = [None, "", "no scheme", "http://example.com/en/7x", "HTTP://A.EXAMPLE.Com/en/8", "http://com/en/", "http://xcom/en/", "http://a.org/x.com/en/", "http://x.com?/en/", "http://x.com#/en/", "http://x.com/EN/", "http://é.com/en/é?q", "x://b.org/es/?a://c.com/en/", "a\nb://É.Com/\nen/", "İ://I.ORG/es/7", "http://", "http://" + "a." * 3000 + "com/en/z"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    for r in url_filter.judge(pages, RULES).collect():
        host, path = parts(urls[r["page_id"]])
        best = max((x for x in RULES if fits(x, host, path)), key=lambda x: len(x.name), default=None)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best and best.name, best.verdict if best else "allow")
    assert url_filter.judge(pages.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, [], default="block").collect()} == {"block"}


def test_automaton_is_a_glob_matcher():
    rng = random.Random(0)
    globs = ["**", "*", "?", "", "a*b", "**a", "a**/b?"] + ["".join(rng.choice("ab/*?") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = ["", "a", "ab", "/", "a/b"] + ["".join(rng.choice("ab/") for _ in range(rng.randint(1, 10))) for _ in range(80)]
    data, offsets = _text.column_bytes(pa.array(texts))
    got = url_filter.Automaton(globs).match(data, offsets[:-1], np.diff(offsets))
    assert url_filter.Automaton(globs).words > 1

    def model(g, t):
        if not g:
            return not t
        if g.startswith("**"):
            return any(model(g[2:], t[k:]) for k in range(len(t) + 1))
        if g[0] == "*":
            end = t.find("/") if "/" in t else len(t)
            return any(model(g[1:], t[k:]) for k in range(end + 1))
        return bool(t) and g[0] in ("?", t[0]) and model(g[1:], t[1:])

    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert got[i, j] == model(g, t), (g, t)


def test_text_keys_and_odd_columns(spark):
    """Keys that are texts, null among them and a text that says so, and columns called as the operators' own."""
    keys = ["a", None, "null", "", "ü / ?>", "b"]
    rows = [(k, "http://x.com/en/1", "same" if k in ("a", "b") else f"t{i}", "w", 1, 2) for i, k in enumerate(keys)]
    frame = spark.createDataFrame(rows, "id string, url string, text string, `Host` string, c0 int, `a.b` int")
    back = archive.round_trip(frame, "id", "url", "text").collect()
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in back) == sorted((str(k), "revisit" if k == "a" else "response", "b" if k == "a" else None) for k in keys)
    assert sorted(str(r["id"]) for r in token_counts.token_counts(frame, "id").collect()) == sorted(map(str, keys))
    judged = url_filter.judge(frame, RULES)
    assert judged.columns == ["id", "url", "text", "c0", "a.b", "host", "path", "rule", "verdict"]
    assert {(r["host"], r["verdict"], r["c0"], r["a.b"]) for r in judged.unionByName(judged).collect()} == {("x.com", "block", 1, 2)}
