"""Split a URL into scheme, host, port, path and query, WHATWG style.

Built from native Spark SQL expressions only (regex extraction, ``CASE``,
string functions): no shuffle, no Python. Three common shapes (plain special
URLs, scheme-less text, CONNECT targets) are decided by fast paths, written as
SQL text in one ``selectExpr`` whose later expressions refer to earlier aliases
(lateral column aliases). Every other URL goes through the general split, a
chain of small stages: every intermediate value (the text after the scheme, the
authority, the raw host...) is computed once and referenced by later stages,
instead of being re-derived inside every branch. The chain is one ``CASE``
branch, so rows of a common shape do not pay for it; as it uses higher-order
functions, the projection that holds it ends a whole-stage-codegen span.
Patterns are written so that Java's backtracking engine stays
linear and never recurses per repetition on hostile input.

Semantics (the URL Standard, as implemented by common URL libraries):

* No scheme (``/login?x``, ``10.0.0.1:443``): not a URL, every part NULL.
* Special schemes (http, https, ws, wss, ftp): any run of ``/`` or ``\\``
  before the authority, user info dropped, host percent-decoded and
  lowercased, IPv4 number forms normalised, port checked to 0-65535 and NULL
  when it is the scheme's default, path at least ``/`` with ``\\`` as a
  separator and dot segments removed, query without the fragment.
* ``file``: host NULL when empty or ``localhost``, special path rules,
  Windows drive letters (``file://C|/x`` gives path ``/C:/x``; ``..`` stops
  at a drive letter).
* Other schemes: ``scheme:rest`` without ``/`` is an opaque path
  (``www.site.org:443`` gives path ``443``); ``scheme://h/p`` has an opaque
  host that keeps its case.
* Any failure (bad port, forbidden host character, empty host) makes all five
  parts NULL.

IPv6 hosts are validated and serialised in canonical form (``[0:0::1]`` gives
``[::1]``). A non-ASCII domain is only lower-cased: IDNA (mapping, NFC, punycode
and the check of ``xn--`` labels) is not built, as it needs Unicode data that
Spark has no functions for, and a half-way form would name hosts that do not
exist. A host whose percent-decoded bytes are not UTF-8 fails.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

URL_PARTS_TYPE = T.StructType(
    [
        T.StructField("scheme", T.StringType(), True),
        T.StructField("host", T.StringType(), True),
        T.StructField("port", T.IntegerType(), True),
        T.StructField("path", T.StringType(), True),
        T.StructField("query", T.StringType(), True),
    ]
)

# Special schemes and their default ports.
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}

# The percent-encode sets. Each holds the C0 controls, DEL and
# every non-ASCII code point, plus (with_space) U+0020 and the listed ASCII.
ENCODE_SETS = {
    "c0": (False, ""),
    "path": (True, '"#<>?`{}'),
    "query": (True, '"#<>'),
    "special_query": (True, '"#<>\''),
}


def encode_set_class(name: str) -> str:
    """Java regex class matching one code point of the named percent-encode set."""
    with_space, extra = ENCODE_SETS[name]
    listed = "".join("\\" + c if c in "\\[]^-" else c for c in extra)
    return f"[\\x00-{'\\x20' if with_space else '\\x1F'}{listed}]|[^\\x00-\\x7E]"


MAX_PORT = 65_535
PORT_DIGITS = len(str(MAX_PORT)) + 1  # enough to tell that a number is too large

# Host code points that make parsing fail.
FORBIDDEN_HOST = r"[\x00\t\n\r #/:<>?@\[\\\]^|]"
FORBIDDEN_DOMAIN = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7F]"
# IPv4 in dotted decimal (no leading zeros, 0-255 each), as an IPv6 tail.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4_DOTTED = rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z"
# IPv6 in hex pieces: eight, or at most seven around one "::".
_PIECES = r"[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*+"
IPV6_PIECES = rf"^(?:[0-9a-f]{{1,4}}(?::[0-9a-f]{{1,4}}){{7}}|(?:{_PIECES})?::(?:{_PIECES})?)\z"
HAS_DOT_SEGMENT = r"(?:^|/)(?:\.|%2[eE]){1,2}(?:/|\z)"


def q(text: str) -> str:
    """``text`` as a Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Printable ASCII that ``url_encode`` (java.net.URLEncoder) escapes, apart
# from "%" itself: it keeps only letters, digits and ".-*_".
_URLENCODED_ASCII = [
    chr(c) for c in range(0x21, 0x7F) if not (chr(c).isalnum() or chr(c) in ".-*_%")
]


def percent_encode_sql(col: str, set_name: str) -> str:
    """SQL: UTF-8 percent-encode the code points of column ``col`` in the named encode set.

    ``url_encode`` escapes every byte of every code point except letters,
    digits and ``.-*_`` (space becomes ``+``), with upper-case hex as the URL
    Standard writes it. The ASCII characters outside the set are then put
    back, ``%25`` last so no restored ``%`` can start a new escape. Plain
    string functions only, so the projection stays in generated code; it
    runs only for values that hold a character of the set.
    """
    with_space, extra = ENCODE_SETS[set_name]
    expr = f"replace(url_encode({col}), '+', {q('%20' if with_space else ' ')})"
    for ch in _URLENCODED_ASCII:
        if ch not in extra:
            expr = f"replace({expr}, '%{ord(ch):02X}', {q(ch)})"
    expr = f"replace({expr}, '%25', '%')"
    return f"CASE WHEN {col} RLIKE {q(encode_set_class(set_name))} THEN {expr} ELSE {col} END"


_SPECIAL = ", ".join(q(s) for s in DEFAULT_PORTS)
_DEFAULT_PORT = "CASE __scheme " + " ".join(f"WHEN {q(s)} THEN {p}" for s, p in DEFAULT_PORTS.items()) + " END"
_EMPTY = "CAST(array() AS array<string>)"

# Dot segments. With +1 for a segment, -1 for ".." (also written with %2e)
# and 0 for ".", and S the prefix sums, a segment survives iff no later prefix
# sum is lower than its own (a ".." at the root pops nothing and does not
# change this). The prefix sums and suffix minima are computed with doubling
# scans (log2(n) rounds of one ``transform`` each), so a path of n segments
# costs O(n log n), not the O(n^2) of a stack kept in an immutable array; a
# hostile URL with a million segments stays cheap. A final "." or ".." leaves
# a trailing slash. In file URLs the first drive letter (C: or C|) met on an
# empty stack is written with ":" and is never popped. Values are bound once
# with ``transform(array(value), name -> ...)[0]``, so the whole step is one
# expression and Spark keeps it in one projection.
def _scan(arr: str, op: str, rounds: str) -> str:
    """SQL: inclusive prefix scan of int array ``arr`` with ``op`` ('+' or 'least')."""
    step = "x + acc[i - shiftleft(1, r)]" if op == "+" else "least(x, acc[i - shiftleft(1, r)])"
    return (
        f"aggregate(sequence(0, {rounds}), {arr}, (acc, r) -> "
        f"transform(acc, (x, i) -> IF(i >= shiftleft(1, r), {step}, x)))"
    )


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


_DOT2 = "('..', '.%2e', '%2e.', '%2e%2e')"
_DOT1 = "('.', '%2e')"
_ROUNDS = "CAST(ceil(log2(greatest(size(__segs), 2))) AS INT)"
_EMPTY_BEFORE = "(i = 0 OR ds[i - 1] = least(dp[i - 1], 0))"
_IS_DRIVE = f"(__kind = 'file' AND dv[i] = 1 AND __segs[i] RLIKE {q(r'^[A-Za-z][:|]\z')})"
_KEEP = (
    "dv[i] = 1 AND (i = df OR (i > df AND (i = size(__segs) - 1 OR ds[i] <= dm[i + 1])))"
)
_OUT = (
    "concat('/', array_join(concat(transform(filter(sequence(0, size(__segs) - 1), i -> "
    f"{_KEEP}), i -> IF(i = df, concat(substr(__segs[i], 1, 1), ':'), __segs[i])), "
    f"IF(element_at(dv, -1) <= 0, array(''), {_EMPTY})), '/'))"
)
_RESOLVE_PATH = _let(
    f"transform(__segs, x -> CASE WHEN lower(x) IN {_DOT2} THEN -1 WHEN lower(x) IN {_DOT1} THEN 0 ELSE 1 END)",
    "dv",
    _let(
        _scan("dv", "+", _ROUNDS),
        "ds",
        _let(
            f"reverse({_scan('reverse(ds)', 'least', _ROUNDS)})",
            "dm",
            _let(
                _scan("ds", "least", _ROUNDS),
                "dp",
                _let(
                    "coalesce(array_position(transform(sequence(0, size(__segs) - 1), i -> "
                    f"{_IS_DRIVE} AND {_EMPTY_BEFORE}), true) - 1, -1)",
                    "df",
                    _OUT,
                ),
            ),
        ),
    ),
)

# One IPv4 number: hex (0x), octal (leading 0) or decimal; NULL if invalid or too large.
_HEX_NUM = q(r"^0[xX][0-9A-Fa-f]*\z")
_OCT_NUM = q(r"^0[0-7]+\z")
_DEC_NUM = q(r"^(0|[1-9][0-9]{0,11})\z")


def ipv4_number_sql(p: str) -> str:
    """SQL: the value of one IPv4 part ``p``, or NULL when it is not a number."""
    return (
        "CASE "
        f"WHEN {p} RLIKE {_HEX_NUM} THEN CASE "
        f"WHEN length(regexp_replace(substr({p}, 3), '^0+', '')) = 0 THEN 0L "
        f"WHEN length(regexp_replace(substr({p}, 3), '^0+', '')) <= 9 THEN CAST(conv(substr({p}, 3), 16, 10) AS BIGINT) END "
        f"WHEN {p} RLIKE {_OCT_NUM} THEN CASE "
        f"WHEN length(regexp_replace(substr({p}, 2), '^0+', '')) = 0 THEN 0L "
        f"WHEN length(regexp_replace(substr({p}, 2), '^0+', '')) <= 12 THEN CAST(conv(substr({p}, 2), 8, 10) AS BIGINT) END "
        f"WHEN {p} RLIKE {_DEC_NUM} THEN CAST({p} AS BIGINT) END"
    )


_RX = {
    # The lookbehind keeps the search linear: a long inner run of C0 characters
    # is scanned once, not from every position in it.
    "trim": q(r"^[\x00-\x20]++|(?<![\x00-\x20])[\x00-\x20]++\z|[\t\n\r]"),
    "scheme": q(r"^([A-Za-z][A-Za-z0-9+.\-]*):"),
    "two_slashes": q(r"^[/\\]{2}"),
    "slashes": q(r"^[/\\]+"),
    "auth_special": q(r"^([^/\\?#]*)"),
    "auth_other": q(r"^([^/?#]*)"),
    "hostport": q(r"(?s)^(?:.*@)?([^@]*)\z"),
    "host": q(r"^(\[[^\]]*\]|[^:\[\]]*)"),
    "after_host": q(r"(?s)^(?:\[[^\]]*\]|[^:\[\]]*)(.*)\z"),
    "path": q(r"^([^?#]*)"),
    "has_query": q(r"^[^#]*\?"),
    "query": q(r"(?s)^[^?#]*\?([^#]*)"),
    "port": q(r"^:([0-9]*)\z"),
    "port_ok": q(r"^:[0-9]*\z"),
    "lead_zeros": q(r"^0+(?=.)"),
    "last_label": q(r"(?:^|\.)([^.]*)\.?\z"),
    "number_label": q(r"^([0-9]+|0[xX][0-9A-Fa-f]*)\z"),
    "final_dot": q(r"\.\z"),
    "dot": q(r"\."),
    "backslash": q("\\\\"),
    "drive": q(r"^[A-Za-z][:|]\z"),
    "drive_first": q(r"^/([A-Za-z])\|(?=/|\z)"),
    "no_lead_slash": q(r"^(?![/\\])"),
}

_STAGES: list[dict[str, str]] = [
    {"__u": f"regexp_replace(__url, {_RX['trim']}, '')"},
    {"__scheme_raw": f"regexp_extract(__u, {_RX['scheme']}, 1)"},
    {
        "__scheme": "lower(__scheme_raw)",
        "__rest": "substr(__u, length(__scheme_raw) + 2)",
        "__kind": (
            "CASE WHEN __scheme_raw = '' THEN 'none' "
            f"WHEN lower(__scheme_raw) IN ({_SPECIAL}) THEN 'special' "
            "WHEN lower(__scheme_raw) = 'file' THEN 'file' ELSE 'other' END"
        ),
    },
    {
        "__has_auth": (
            "CASE WHEN __kind = 'special' THEN true "
            f"WHEN __kind = 'file' THEN __rest RLIKE {_RX['two_slashes']} "
            "ELSE startswith(__rest, '//') END"
        ),
    },
    # The text after the slashes that introduce an authority.
    {
        "__r": (
            f"CASE WHEN __kind = 'special' THEN regexp_replace(__rest, {_RX['slashes']}, '') "
            "WHEN __has_auth THEN substr(__rest, 3) ELSE __rest END"
        ),
    },
    {
        # A file "host" that is a Windows drive letter (C: or C|) starts the path instead.
        "__auth": (
            f"CASE WHEN __has_auth AND __kind = 'file' AND regexp_extract(__r, {_RX['auth_special']}, 1) "
            f"RLIKE {_RX['drive']} THEN NULL "
            "WHEN __has_auth AND __kind IN ('special', 'file') "
            f"THEN regexp_extract(__r, {_RX['auth_special']}, 1) "
            f"WHEN __has_auth THEN regexp_extract(__r, {_RX['auth_other']}, 1) END"
        ),
    },
    {
        "__tail": "CASE WHEN __auth IS NULL THEN __r ELSE substr(__r, length(__auth) + 1) END",
        "__hostport": f"regexp_extract(__auth, {_RX['hostport']}, 1)",
    },
    {
        "__host_raw": f"regexp_extract(__hostport, {_RX['host']}, 1)",
        "__port_txt": f"regexp_extract(__hostport, {_RX['after_host']}, 1)",
        "__path_raw": f"regexp_extract(__tail, {_RX['path']}, 1)",
        "__query_raw": f"CASE WHEN __tail RLIKE {_RX['has_query']} THEN regexp_extract(__tail, {_RX['query']}, 1) END",
        "__at_fail": "coalesce(contains(__auth, '@') AND __hostport = '', false)",
    },
    {
        "__port_digits": f"regexp_replace(regexp_extract(__port_txt, {_RX['port']}, 1), {_RX['lead_zeros']}, '')",
        "__port_ok": (
            f"(__port_txt = '' OR __port_txt RLIKE {_RX['port_ok']}) AND NOT (__host_raw = '' AND __port_txt <> '')"
        ),
        "__ipv6": "startswith(__host_raw, '[')",
        # Domain: percent-decoded and lower-cased; a non-ASCII one is not mapped further.
        "__dom": (
            "CASE WHEN __kind IN ('special', 'file') AND NOT startswith(__host_raw, '[') THEN lower("
            "CASE WHEN contains(__host_raw, '%') THEN try_url_decode(replace(__host_raw, '+', '%2B')) "
            "ELSE __host_raw END) END"
        ),
    },
    {
        # Six digits or more are above any port, whatever they are.
        "__port": f"CASE WHEN __port_digits <> '' THEN CAST(left(__port_digits, {PORT_DIGITS}) AS INT) END",
        # U+FFFD stands for bytes that are not UTF-8; it is no host character itself either.
        "__dom_ok": f"__dom <> '' AND NOT __dom RLIKE {q(FORBIDDEN_DOMAIN)} AND NOT contains(__dom, {q(chr(0xFFFD))})",
        # An IPv4 address has at most four parts, so they are taken one by one
        # (no higher-order function, which would end the generated-code span).
        "__v4": (
            f"CASE WHEN regexp_extract(__dom, {_RX['last_label']}, 1) RLIKE {_RX['number_label']} "
            f"THEN split(regexp_replace(__dom, {_RX['final_dot']}, ''), {_RX['dot']}, -1) END"
        ),
    },
    {
        "__v4n": "size(__v4)",
        **{f"__v4x{i}": ipv4_number_sql(f"try_element_at(__v4, {i})") for i in range(1, 5)},
    },
    {
        "__v4_ok": (
            "__v4n BETWEEN 1 AND 4 "
            + "".join(f"AND (__v4n < {i} OR __v4x{i} IS NOT NULL) " for i in range(1, 5))
            + "".join(f"AND (__v4n <= {i} OR __v4x{i} <= 255) " for i in range(1, 4))
            + "AND CASE __v4n " + " ".join(f"WHEN {i} THEN __v4x{i}" for i in range(1, 5))
            + " END < shiftleft(1L, 8 * (5 - __v4n))"
        ),
    },
    {
        "__v4_num": (
            "CASE WHEN __v4_ok THEN CASE __v4n "
            + " ".join(
                f"WHEN {n} THEN "
                + " + ".join([f"__v4x{i} * {1 << (8 * (4 - i))}" for i in range(1, n)] + [f"__v4x{n}"])
                for n in range(1, 5)
            )
            + " END END"
        ),
    },
    # IPv6 host: pieces checked, "::" expanded, an IPv4 tail turned into two
    # pieces, then serialised: lower-case hex without leading zeros and the
    # first longest run of two or more zero pieces written as "::".
    {
        "__v6in": (
            "CASE WHEN __ipv6 AND endswith(__host_raw, ']') AND length(__host_raw) >= 2 "
            "THEN lower(substr(__host_raw, 2, length(__host_raw) - 2)) END"
        ),
    },
    {"__v6tail": "substring_index(__v6in, ':', -1)"},
    {
        "__v6q": (
            "CASE WHEN NOT contains(__v6in, '.') THEN __v6in "
            f"WHEN __v6tail RLIKE {q(IPV4_DOTTED)} THEN concat("
            "substr(__v6in, 1, length(__v6in) - length(__v6tail)), "
            "lower(hex(CAST(try_element_at(split(__v6tail, '[.]'), 1) AS INT) * 256 "
            "+ CAST(try_element_at(split(__v6tail, '[.]'), 2) AS INT))), ':', "
            "lower(hex(CAST(try_element_at(split(__v6tail, '[.]'), 3) AS INT) * 256 "
            "+ CAST(try_element_at(split(__v6tail, '[.]'), 4) AS INT)))) END"
        ),
    },
    {"__v6n": "size(regexp_extract_all(__v6q, '[0-9a-f]+', 0))"},
    {
        "__v6full": (
            f"CASE WHEN __v6q RLIKE {q(IPV6_PIECES)} AND (NOT contains(__v6q, '::') OR __v6n <= 7) THEN "
            "CASE WHEN contains(__v6q, '::') THEN concat_ws(':', nullif(substring_index(__v6q, '::', 1), ''), "
            "array_join(array_repeat('0', 8 - __v6n), ':'), nullif(substring_index(__v6q, '::', -1), '')) "
            "ELSE __v6q END END"
        ),
    },
    {"__v6s": "concat(':', regexp_replace(__v6full, '(^|:)0+(?=[0-9a-f])', '$1'), ':')"},
    {
        "__v6run": (
            "CASE "
            + " ".join(f"WHEN instr(__v6s, {q(':0' * n + ':')}) > 0 THEN {q(':0' * n + ':')}" for n in range(8, 1, -1))
            + " END"
        ),
    },
    {
        "__v6host": (
            "CASE WHEN __v6s IS NULL THEN NULL WHEN __v6run IS NULL THEN "
            "concat('[', substr(__v6s, 2, length(__v6s) - 2), ']') ELSE concat('[', "
            "substr(__v6s, 2, greatest(instr(__v6s, __v6run) - 2, 0)), '::', "
            "substr(__v6s, instr(__v6s, __v6run) + length(__v6run), "
            "length(__v6s) - instr(__v6s, __v6run) - length(__v6run)), ']') END"
        ),
    },
    {
        "__host": (
            "CASE WHEN __ipv6 THEN __v6host "
            "WHEN __kind IN ('special', 'file') THEN CASE WHEN __dom_ok THEN "
            "CASE WHEN __v4 IS NULL THEN __dom WHEN __v4_num IS NOT NULL THEN concat_ws('.', "
            + ", ".join(f"CAST(shiftrightunsigned(__v4_num, {s}) & 255 AS STRING)" for s in (24, 16, 8, 0))
            + ") END END "
            f"WHEN NOT __host_raw RLIKE {q(FORBIDDEN_HOST)} THEN __host_raw END"
        ),
    },
    {
        "__ok": (
            "__kind <> 'none' AND NOT __at_fail "
            "AND (__auth IS NULL OR (__port_ok AND coalesce(__port, 0) <= 65535)) AND "
            "CASE WHEN __kind = 'special' THEN coalesce(__host <> '', false) "
            "WHEN __kind = 'file' THEN __auth IS NULL OR __host_raw = '' OR (__host IS NOT NULL AND __port_txt = '') "
            "WHEN __auth IS NOT NULL THEN __host IS NOT NULL OR __host_raw = '' ELSE true END"
        ),
        "__opaque": "__kind = 'other' AND __auth IS NULL AND NOT startswith(__path_raw, '/')",
        "__path2": (
            f"CASE WHEN __kind = 'special' THEN coalesce(nullif(regexp_replace(__path_raw, {_RX['backslash']}, '/'), ''), '/') "
            f"WHEN __kind = 'file' THEN regexp_replace(regexp_replace(regexp_replace(__path_raw, "
            f"{_RX['no_lead_slash']}, '/'), {_RX['backslash']}, '/'), {_RX['drive_first']}, '/$1:') "
            "ELSE __path_raw END"
        ),
        "__host_out": "CASE WHEN __kind = 'file' AND __host = 'localhost' THEN NULL ELSE nullif(__host, '') END",
        "__port_out": f"CASE WHEN {_DEFAULT_PORT} IS NULL OR __port <> {_DEFAULT_PORT} THEN __port END",
    },
    {
        "__segs": (
            f"CASE WHEN NOT __opaque AND __path2 RLIKE {q(HAS_DOT_SEGMENT)} "
            "THEN split(substr(__path2, 2), '/', -1) END"
        ),
    },
    {"__path3": f"CASE WHEN __segs IS NOT NULL THEN {_RESOLVE_PATH} ELSE __path2 END"},
    {
        "__path": (
            f"CASE WHEN __opaque THEN {percent_encode_sql('__path3', 'c0')} "
            f"ELSE {percent_encode_sql('__path3', 'path')} END"
        ),
        "__query": (
            f"CASE WHEN __kind IN ('special', 'file') THEN {percent_encode_sql('__query_raw', 'special_query')} "
            f"ELSE {percent_encode_sql('__query_raw', 'query')} END"
        ),
        "__host_enc": (
            f"CASE WHEN __kind = 'other' AND NOT __ipv6 THEN {percent_encode_sql('__host_out', 'c0')} "
            "ELSE __host_out END"
        ),
    },
]

_RESULT = (
    "CASE WHEN __ok THEN named_struct('scheme', __scheme, 'host', __host_enc, 'port', __port_out, "
    "'path', __path, 'query', __query) ELSE "
    "CAST(NULL AS struct<scheme:string, host:string, port:int, path:string, query:string>) END"
)

# Patterns that see untrusted text use possessive quantifiers on repeated
# groups: Java runs those iteratively, while a plain ``(...)*`` recurses once
# per repetition and a URL with tens of thousands of segments would overflow
# the task's stack. Each possessive loop is followed by text it cannot match,
# so the matches are the same.
#
# Fast path. Most URLs in a proxy log are plain: a special scheme, "//", a
# host of letter/digit labels whose last label starts with a letter (so it
# cannot be an IPv4 number), an optional port, a path and query made only of
# characters that need no percent-encoding and no dot segment, and an
# optional fragment. One anchored regex recognises that shape and captures
# the five parts in a single pass; every other URL goes through the staged
# path above, which handles the general case.
_PATH_SAFE = r"[!$%&'()*+,\-.0-9:;=@A-Z\[\]^_a-z|~]"
_QUERY_SAFE = r"[!$%&()*+,\-./0-9:;=?@A-Z\[\\\]^_`a-z{|}~]"
FAST_URL = (
    r"^((?i:https?|wss?|ftp))://((?:[A-Za-z0-9_-]++\.)*+[A-Za-z][A-Za-z0-9_-]*+)(?::([0-9]{1,5}))?"
    r"((?:/(?:(?![.]|%2[eE])" + _PATH_SAFE + r"++)?)*+)(\?" + _QUERY_SAFE + r"*+)?(?:#.*)?\z"
)
_FAST_GROUPS = "\n".join(f"${i}" for i in range(1, 6))
# Two more shapes are common in proxy logs and decided without the general
# stages: text that cannot start with a scheme (origin-form targets such as
# ``/login?x``, or ``10.0.0.1:443``) is not a URL, and a CONNECT target
# ``host:port`` is a non-special scheme with an opaque path, here restricted
# to printable ASCII that needs no percent-encoding.
NO_SCHEME = r"^[^A-Za-z\x00-\x20]"
# (printable ASCII except # / : ? \ and space)
OPAQUE_FAST = r"^[A-Za-z][A-Za-z0-9+.\-]*:[\x21\x22\x24-\x2E\x30-\x39\x3B-\x3E\x40-\x5B\x5D-\x7E]*\z"
_NOT_OPAQUE = ", ".join(q(s) for s in (*DEFAULT_PORTS, "file"))
_FAST_STAGES: list[dict[str, str]] = [
    {
        "__fastv": (
            f"CASE WHEN instr(__url0, '\\n') = 0 THEN "
            f"split(regexp_replace(__url0, {q(FAST_URL)}, {q(_FAST_GROUPS)}), '\\n', -1) END"
        ),
    },
    {"__fast": "CASE WHEN size(__fastv) = 5 THEN __fastv END"},
    {
        "__shape": (
            "CASE WHEN __fast IS NOT NULL THEN 'special' "
            f"WHEN __url0 RLIKE {q(NO_SCHEME)} THEN 'none' "
            f"WHEN __url0 RLIKE {q(OPAQUE_FAST)} "
            f"AND lower(substring_index(__url0, ':', 1)) NOT IN ({_NOT_OPAQUE}) THEN 'opaque' END"
        ),
    },
    {
        "__fast_port": "CAST(nullif(__fast[2], '') AS INT)",
        "__fast_scheme": "lower(__fast[0])",
    },
]
_FAST_DEFAULT = _DEFAULT_PORT.replace("CASE __scheme ", "CASE __fast_scheme ")
_FAST_RESULT = (
    "CASE WHEN coalesce(__fast_port, 0) <= 65535 THEN named_struct('scheme', __fast_scheme, "
    "'host', lower(__fast[1]), "
    f"'port', CASE WHEN __fast_port <> {_FAST_DEFAULT} THEN __fast_port END, "
    "'path', CASE WHEN __fast[3] = '' THEN '/' ELSE __fast[3] END, "
    "'query', CASE WHEN __fast[4] = '' THEN NULL ELSE substr(__fast[4], 2) END) "
    "ELSE CAST(NULL AS struct<scheme:string, host:string, port:int, path:string, query:string>) END"
)

_NULL_PARTS = "CAST(NULL AS struct<scheme:string, host:string, port:int, path:string, query:string>)"
_OPAQUE_RESULT = (
    "named_struct('scheme', lower(substring_index(__url0, ':', 1)), 'host', CAST(NULL AS STRING), "
    "'port', CAST(NULL AS INT), 'path', substr(__url0, instr(__url0, ':') + 1), 'query', CAST(NULL AS STRING))"
)


_NAME = re.compile(r"\b(__[A-Za-z0-9_]+)\b")


def _general_sql(url: str) -> str:
    """The general split of the text ``url`` as one expression.

    An array of one struct goes through a chain of ``transform`` steps, one a stage; each step
    adds the stage's values to the struct and keeps those that later stages name. As a value,
    not a list of columns, it can stand in a ``CASE`` branch, so that only rows without a common
    shape pay for it. (The steps follow each other; nested lambdas do not plan in useful time.)
    """

    def scoped(expr: str) -> str:
        return _NAME.sub(lambda m: f"__s.{m.group(1)}" if m.group(1) in known else m.group(1), expr)

    later = [{n for s in _STAGES[i + 1 :] for e in s.values() for n in _NAME.findall(e)} for i in range(len(_STAGES))]
    final = set(_NAME.findall(_RESULT))
    known = {"__url": None}
    chain = f"array(named_struct('__url', {url}))"
    for stage, needed in zip(_STAGES, later, strict=True):
        fields = [f"'{n}', __s.{n}" for n in known if n in needed | final]
        fields += [f"'{n}', {scoped(e)}" for n, e in stage.items()]
        known = {n: None for n in (*(k for k in known if k in needed | final), *stage)}
        chain = f"transform({chain}, __s -> named_struct({', '.join(fields)}))"
    return f"transform({chain}, __s -> {scoped(_RESULT)})[0]"


def with_url_parts(df: DataFrame, url_col: str, out_col: str = "url_parts", fast_path: bool = True) -> DataFrame:
    """Add ``out_col`` = struct<scheme, host, port, path, query> of ``url_col``.

    All fields are NULL when the text is not a URL. Runs as a chain of narrow
    projections: no shuffle, no Python. ``fast_path=False`` sends every URL
    through the general stages (used by tests to check both paths agree).
    """
    keep = [f"`{c}`" for c in df.columns]
    if not fast_path:
        return df.selectExpr("*", f"`{url_col}` AS __url0").selectExpr(*keep, f"{_general_sql('__url0')} AS `{out_col}`")
    # One projection list; later expressions refer to earlier aliases (lateral
    # column aliases), which Spark resolves into the chain of projections.
    exprs = [f"{expr} AS {name}" for stage in _FAST_STAGES for name, expr in stage.items()]
    result = (
        f"CASE __shape WHEN 'special' THEN {_FAST_RESULT} WHEN 'none' THEN {_NULL_PARTS} "
        f"WHEN 'opaque' THEN {_OPAQUE_RESULT} ELSE {_general_sql('__url0')} END"
    )
    return df.selectExpr("*", f"`{url_col}` AS __url0", *exprs).selectExpr(*keep, f"{result} AS `{out_col}`")


def url_parts_of(df: DataFrame, url_col: str = "url", fast_path: bool = True) -> DataFrame:
    """``url_col`` with its five parts as top-level columns."""
    out = with_url_parts(df.select(url_col), url_col, "__parts", fast_path)
    return out.select(url_col, "__parts.scheme", "__parts.host", "__parts.port", "__parts.path", "__parts.query")
