"""URL split: the URL Standard cases, and agreement of the fast and general paths."""

import pytest

from proxyscope.functions.url import url_parts_of

NULLS = (None, None, None, None, None)

CASES = [
    ("https://WWW.Site.org:443/stable/1", ("https", "www.site.org", None, "/stable/1", None)),
    ("http://a", ("http", "a", None, "/", None)),
    ("http://a/?", ("http", "a", None, "/", "")),
    ("http://u:p@h:8080/p;x?q#f", ("http", "h", 8080, "/p;x", "q")),
    ("http://a/b/../c", ("http", "a", None, "/c", None)),
    ("http://[::1]:80/x", ("http", "[::1]", None, "/x", None)),
    ("www.site.org:443", ("www.site.org", None, None, "443", None)),
    ("10.0.0.1:443", NULLS),
    ("/login?url=http://x", NULLS),
    ("http://a:99999/", NULLS),
    ("http://a:999999/", NULLS),
    ("http://a:1000000000/x", NULLS),
    ("foo://h:999999/p", NULLS),
    ("http://a:00000000081/", ("http", "a", 81, "/", None)),
    ("http://%ff.com/", NULLS),
    ("http://a/b/c/..", ("http", "a", None, "/b/", None)),
    ("http://a/b/%2e%2E/c", ("http", "a", None, "/c", None)),
    ("http://a/./b/.", ("http", "a", None, "/b/", None)),
    ("http://a\\b\\c", ("http", "a", None, "/b/c", None)),
    ("http://0x7f.1/", ("http", "127.0.0.1", None, "/", None)),
    ("http://0300.0250.1.1/", ("http", "192.168.1.1", None, "/", None)),
    ("http://3232235777/", ("http", "192.168.1.1", None, "/", None)),
    ("http://1.2.3.999/", NULLS),
    ("http://a/\u00e9?\u00fc=1", ("http", "a", None, "/%C3%A9", "%C3%BC=1")),
    ("http://a/x{y}", ("http", "a", None, "/x%7By%7D", None)),
    ("HTTP:a.com/x", ("http", "a.com", None, "/x", None)),
    ("http:///a.com", ("http", "a.com", None, "/", None)),
    ("http://@a", ("http", "a", None, "/", None)),
    ("http://u@", NULLS),
    ("http://:80/", NULLS),
    ("http://a:/x", ("http", "a", None, "/x", None)),
    ("http://a:0080/", ("http", "a", None, "/", None)),
    ("foo://Host:99/x/./y?q'#f", ("foo", "Host", 99, "/x/y", "q'")),
    ("http://a/?q'", ("http", "a", None, "/", "q%27")),
    ("mailto:x@y", ("mailto", None, None, "x@y", None)),
    ("file:///tmp/x", ("file", None, None, "/tmp/x", None)),
    ("file://localhost/tmp", ("file", None, None, "/tmp", None)),
    ("http://a%41.com/", ("http", "aa.com", None, "/", None)),
    ("http://a b/", NULLS),
    ("http://a<b/", NULLS),
    ("https://a.com:443", ("https", "a.com", None, "/", None)),
    ("ftp://a:21/", ("ftp", "a", None, "/", None)),
    ("ws://a:81/", ("ws", "a", 81, "/", None)),
    ("foo:/a/../b", ("foo", None, None, "/b", None)),
    ("foo://", ("foo", None, None, "", None)),
    ("https://Root.Example.org", ("https", "root.example.org", None, "/", None)),
    ("http://x.EXAMPLE.com:8080/en/1?page=2#top", ("http", "x.example.com", 8080, "/en/1", "page=2")),
    # Windows drive letters in file URLs
    ("file:c:\\foo\\bar.html", ("file", None, None, "/c:/foo/bar.html", None)),
    ("file:///C|/x", ("file", None, None, "/C:/x", None)),
    ("file://C|/x", ("file", None, None, "/C:/x", None)),
    ("file://c:", ("file", None, None, "/c:", None)),
    ("file:/C|/x?q", ("file", None, None, "/C:/x", "q")),
    ("file:///C:/..", ("file", None, None, "/C:/", None)),
    ("file:///C:/a/../../x", ("file", None, None, "/C:/x", None)),
    ("file:///a/../C|/x", ("file", None, None, "/C:/x", None)),
    ("file:///C|x", ("file", None, None, "/C|x", None)),
    ("file://localhost/D:/y", ("file", None, None, "/D:/y", None)),
    ("http://a/C|/x", ("http", "a", None, "/C|/x", None)),
]


@pytest.fixture(scope="module")
def urls(spark):
    return spark.createDataFrame([(u,) for u, _ in CASES], "url string")


@pytest.mark.parametrize("fast", [True, False])
def test_cases(spark, urls, fast):
    rows = url_parts_of(urls, "url", fast_path=fast).collect()
    for (url, want), r in zip(CASES, rows):
        assert r.url == url
        assert (r.scheme, r.host, r.port, r.path, r.query) == want, url


def test_fast_path_agrees_on_generated_urls(spark):
    df = spark.range(0, 2000).selectExpr(
        "concat(CASE id % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'HTTPS' WHEN 2 THEN 'ws' ELSE 'ftp' END, '://',"
        " CASE WHEN id % 3 = 0 THEN 'Blog.' ELSE '' END, 'h', cast(id % 17 as string), '.Example.com',"
        " CASE WHEN id % 5 = 0 THEN ':443' WHEN id % 5 = 1 THEN ':8080' ELSE '' END,"
        " CASE WHEN id % 7 = 0 THEN '' ELSE concat('/p/', cast(id as string)) END,"
        " CASE WHEN id % 6 = 0 THEN '?a=1&b=2' WHEN id % 6 = 1 THEN '?' ELSE '' END,"
        " CASE WHEN id % 8 = 0 THEN '#frag' ELSE '' END) AS url"
    )
    fast = sorted(tuple(r) for r in url_parts_of(df, "url", fast_path=True).collect())
    slow = sorted(tuple(r) for r in url_parts_of(df, "url", fast_path=False).collect())
    assert fast == slow


def test_fast_shapes_agree_with_general_path(spark):
    # CONNECT targets, origin-form and other scheme-less text, opaque URLs.
    urls = [
        "www.example.org:443", "Mail.Example.ORG:465", "10.0.0.1:443", "[::1]:443", "/login?url=http://x",
        "/", "*", "?x", "#y", "mailto:x@y", "foo:", 'a:"q"%41', "a:b#c", "a:b?c", "a:/x", "a:b:c",
        "http:a.com", "HTTPS:host:1", "file:x", "ws:y", "ftp:z", "x+y.z-w:80", "a:\u00e9", "\x01a:b",
        " a:b", "a:b\x7f", "1a:b", "-", "a:~!$&'()*+,;=@[]^_`{|}",
    ]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    fast = [tuple(r) for r in url_parts_of(df, "url", fast_path=True).orderBy("url").collect()]
    slow = [tuple(r) for r in url_parts_of(df, "url", fast_path=False).orderBy("url").collect()]
    assert fast == slow


def test_percent_encode_sets_match_python_quote(spark):
    from urllib.parse import quote

    from proxyscope.functions.url import ENCODE_SETS, percent_encode_sql

    printable = "".join(chr(c) for c in range(0x20, 0x7F))
    texts = [printable, "\x00\x01\x1f\x7f", "aéb中c\U0001F600", "%41%zz%", "plain", "", "a+b c"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for name, (with_space, extra) in ENCODE_SETS.items():
        encoded = set(extra) | {chr(c) for c in range(0x20)} | {"\x7f"} | ({" "} if with_space else set())
        safe = "".join(ch for ch in printable if ch not in encoded)
        got = [r[0] for r in df.selectExpr(percent_encode_sql("s", name)).collect()]
        want = [quote(t, safe=safe, encoding="utf-8") for t in texts]
        assert got == want, name


def _whatwg_ipv6(text: str):
    """The URL Standard's IPv6 parser and serializer, step by step (reference for the test)."""
    address, piece, compress, i, n = [0] * 8, 0, None, 0, len(text)
    hexdigits = "0123456789abcdefABCDEF"
    if text[:1] == ":":
        if text[1:2] != ":":
            return None
        i, piece = 2, 1
        compress = piece
    while i < n:
        if piece == 8:
            return None
        if text[i] == ":":
            if compress is not None:
                return None
            i, piece = i + 1, piece + 1
            compress = piece
            continue
        value = length = 0
        while length < 4 and i < n and text[i] in hexdigits:
            value, i, length = value * 16 + int(text[i], 16), i + 1, length + 1
        if i < n and text[i] == ".":
            if length == 0 or piece > 6:
                return None
            i -= length
            seen = 0
            while i < n:
                v4 = None
                if seen > 0:
                    if text[i] == "." and seen < 4:
                        i += 1
                    else:
                        return None
                if i >= n or not text[i].isdigit() or not text[i].isascii():
                    return None
                while i < n and text[i].isascii() and text[i].isdigit():
                    d = int(text[i])
                    if v4 is None:
                        v4 = d
                    elif v4 == 0:
                        return None
                    else:
                        v4 = v4 * 10 + d
                    if v4 > 255:
                        return None
                    i += 1
                address[piece] = address[piece] * 256 + v4
                seen += 1
                if seen in (2, 4):
                    piece += 1
            if seen != 4:
                return None
            break
        elif i < n and text[i] == ":":
            i += 1
            if i >= n:
                return None
        elif i < n:
            return None
        address[piece] = value
        piece += 1
    if compress is not None:
        swaps, piece = piece - compress, 7
        while piece != 0 and swaps > 0:
            address[piece], address[compress + swaps - 1] = address[compress + swaps - 1], address[piece]
            piece, swaps = piece - 1, swaps - 1
    elif piece != 8:
        return None
    best, best_len, k = None, 1, 0
    while k < 8:
        if address[k] == 0:
            j = k
            while j < 8 and address[j] == 0:
                j += 1
            if j - k > best_len:
                best, best_len = k, j - k
            k = j
        else:
            k += 1
    out, k = "", 0
    while k < 8:
        if k == best:
            out += "::" if k == 0 else ":"
            k += best_len
            continue
        out += format(address[k], "x") + (":" if k < 7 else "")
        k += 1
    return "[" + out + "]"


IPV6_CASES = [
    "::1", "0:0:0:0:0:0:0:1", "2001:DB8::1", "::ffff:192.168.0.1", "1:0:0:2:0:0:0:3", "1:0:0:2:0:0:3:4",
    "0001:0db8::", "::", "1:2:3:4:5:6:7::", "1:2:3:4::5:6:7:8", "1:2:3", "::1.2.3", "::01.2.3.4", "12345::",
    "1::2::3", "::ffff:1.2.3.256", "1:2:3:4:5:6:1.2.3.4", "", ":1::", "1:::2", "::1:2:3:4:5:6:7",
    "1:2:3:4:5:6:7:8", "0:0:1:0:0:0:0:0", "a:b:c:d:e:f:0:0", "::0.0.0.0", "1.2.3.4", "::1.2.3.4.5",
]


def test_ipv6_hosts_match_url_standard(spark):
    import random

    rnd = random.Random(7)
    cases = list(IPV6_CASES)
    for _ in range(300):
        parts = [rnd.choice(["0", "00", "1", "ab", "FFFF", "0000", "10", "fe80"]) for _ in range(rnd.randint(1, 9))]
        text = ":".join(parts)
        if rnd.random() < 0.5:
            k = rnd.randint(0, len(parts))
            text = ":".join(parts[:k]) + "::" + ":".join(parts[k:])
        if rnd.random() < 0.2:
            text += ":" + ".".join(str(rnd.choice([0, 1, 9, 10, 255, 256])) for _ in range(4))
        cases.append(text)
    df = spark.createDataFrame([(f"http://[{c}]/",) for c in cases], "url string")
    got = {r.url: r.host for r in url_parts_of(df, "url").collect()}
    for c in cases:
        assert got[f"http://[{c}]/"] == _whatwg_ipv6(c), c


def test_non_ascii_hosts_are_only_lower_cased(spark):
    """IDNA is not built: no made-up punycode, and bytes that are not UTF-8 fail."""
    cases = {
        "http://Bücher.example/": "bücher.example",
        "http://%C3%BC.example/": "ü.example",
        "http://xn--bcher-kva.example/": "xn--bcher-kva.example",
        "http://%ff.com/": None,
        "http://\ufffd.com/": None,
        "foo://Bücher/x": "B%C3%BCcher",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: r.host for r in url_parts_of(df, "url").collect()} == cases


def _whatwg_path(tokens, is_file):
    """The URL Standard's path state for dot segments and file drive letters (reference for the test)."""
    import re

    path = []
    for k, tok in enumerate(tokens):
        last = k == len(tokens) - 1
        low = tok.lower()
        if low in ("..", ".%2e", "%2e.", "%2e%2e"):
            if not (is_file and len(path) == 1 and re.fullmatch("[A-Za-z]:", path[0])) and path:
                path.pop()
            if last:
                path.append("")
        elif low in (".", "%2e"):
            if last:
                path.append("")
        else:
            if is_file and not path and re.fullmatch("[A-Za-z][:|]", tok):
                tok = tok[0] + ":"
            path.append(tok)
    return "/" + "/".join(path)


def test_dot_segments_match_url_standard(spark):
    import random

    rnd = random.Random(11)
    tokens = ["a", "bc", "", ".", "..", "%2e", ".%2E", "%2E%2e", "C:", "c|", "D|", "x:", "ab:"]
    cases = {}
    for _ in range(400):
        toks = [rnd.choice(tokens) for _ in range(rnd.randint(1, 12))]
        for scheme in ("http://h", "file://"):
            cases[f"{scheme}/{'/'.join(toks)}"] = _whatwg_path(toks, scheme == "file://")
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    got = {r.url: r.path for r in url_parts_of(df, "url").collect()}
    bad = {u: (got[u], want) for u, want in cases.items() if got[u] != want}
    assert not bad, list(bad.items())[:5]


def test_hostile_urls_stay_cheap(spark):
    import time

    urls = [
        "http://a.example" + "/a" * 50000,
        "http://" + "a." * 20000 + "example/",
        "http://a.example" + "/a" * 50000 + "/..",
        "http://a.example/" + "x/../" * 20000,
    ]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    t0 = time.time()
    rows = url_parts_of(df, "url").collect()
    assert time.time() - t0 < 60
    assert [len(r.path) for r in rows] == [100000, 1, 99999, 1]


def test_fast_and_general_paths_agree_on_random_urls(spark):
    import random

    rnd = random.Random(17)
    schemes = ["http://", "HTTPS://", "ws://", "ftp://", "wss://", "foo://", "file://", "http:", "mailto:", "", "/", "x+y:"]
    labels = ["a", "Ab", "b-c", "_x", "9", "0x1f", "www", "ü", "EXAMPLE", "", "1"]
    ports = ["", ":80", ":443", ":8080", ":", ":99999", ":0021", ":x"]
    segments = ["a", "B", ".", "..", "%2e", ".x", "a.b", "~u", "a;b", "a,b", "%41", "é", "a b", "{}", "|", "@", ":", "\\"]
    queries = ["", "?", "?a=1", "?a=1&b=2", "?q'", "?x y", "?é", "?#", "?a?b"]
    frags = ["", "#", "#top", "#a b"]
    urls = set()
    for _ in range(3000):
        host = ".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 4)))
        path = "".join("/" + rnd.choice(segments) for _ in range(rnd.randint(0, 5)))
        urls.add(rnd.choice(schemes) + host + rnd.choice(ports) + path + rnd.choice(queries) + rnd.choice(frags))
    df = spark.createDataFrame([(u,) for u in sorted(urls)], "url string")
    fast = {r.url: tuple(r) for r in url_parts_of(df, "url", fast_path=True).collect()}
    slow = {r.url: tuple(r) for r in url_parts_of(df, "url", fast_path=False).collect()}
    diff = [(u, fast[u], slow[u]) for u in fast if fast[u] != slow[u]]
    assert not diff, diff[:5]
