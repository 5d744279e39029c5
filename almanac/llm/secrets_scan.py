"""Operator 9: secret scans with structural confirmation.

Base patterns report assignments, access keys and long hex runs. Beyond them,
base64 and hex candidates are decoded and reported only if their bytes have the
structure of a secret: a signed token whose header names its algorithm, a key
in ASN.1 DER whose nested lengths fill it exactly, or length-prefixed OpenSSH
fields.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shipped, text_of, text_slices

_ANY = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
ASSIGN = re.compile("(" + "|".join(map(_ANY, ("password", "passwd", "secret", "token"))) + "|" + _ANY("api") + "_?" + _ANY("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Three dotted parts; the first begins as base64 of a brace or of white space does.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[eICD][A-Za-z0-9_-]{7,}+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
#: The body ends at the next five dashes, so no text is read twice.
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*?PRIVATE KEY)-----((?:[^-]|-(?!----))*+)-----END \1-----")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}")
#: What stands between the lines of wrapped base64, and its last line.
_WRAP, _TAIL = re.compile(r"\r?\n[\x20\t]*"), re.compile(r"\r?\n[\x20\t]*([A-Za-z0-9+/_-]+={0,2})")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{48,}+")
#: The order of kinds that start together.
KINDS = ("assign", "access", "hex", "token", "pem", "der", "ssh", "hexkey")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), leftmost without overlap for each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def _unbase64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    """Whether the three parts of a token decode: header and payload are JSON objects, the header names an algorithm, and one other than none has a signature."""
    head, body, sign = text.split(".")
    try:
        head_, body_ = (json.loads(_unbase64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):  # no JSON, or nested deeper than any token's
        return False
    alg = head_.get("alg") if isinstance(head_, dict) else None
    return isinstance(body_, dict) and isinstance(alg, str) and bool(alg) and (alg.lower() == "none" or len(_unbase64(sign) or b"") >= 16)


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, begin and end of the ASN.1 element at `at`, if its length stays within end."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
        if n < 128:
            return None
    return (tag, at, at + n) if at + n <= end else None


def is_der_key(data: bytes) -> bool:
    """Whether data is one DER sequence, filled exactly by its elements at every depth, in the shape of a key.

    Private keys begin with a small version integer; public keys and encrypted
    private keys with a sequence that begins with an object identifier.
    """
    top = _element(data, 0, len(data))
    if len(data) < 24 or top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    inside, stack = [], [(top[1], top[2], True)]
    while stack:
        at, end, outer = stack.pop()
        while at < end:
            own = _element(data, at, end)
            if own is None:
                return False
            if outer:
                inside.append(own)
            if own[0] & 0x20:
                stack.append((own[1], own[2], False))
            at = own[2]
    if len(inside) < 2:
        return False
    tag, a, b = inside[0]
    if tag == 0x02:  # version, then the key: an octet string, an algorithm or integers
        return b - a == 1 and data[a] <= 3 and inside[1][0] in (0x02, 0x04, 0x30) and (inside[1][0] != 0x02 or len(inside) >= 5)
    return tag == 0x30 and b > a and data[a] == 0x06 and inside[1][0] in (0x03, 0x04)


def is_ssh_key(data: bytes) -> bool:
    """Whether data is an OpenSSH private key file or length-prefixed public key fields that fill it exactly."""
    private = data.startswith(b"openssh-key-v1\0")
    at, fields = (15 if private else 0), []
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
        if private and len(fields) == 3:
            return at + 4 <= len(data)  # the number of keys follows
    return not private and at == len(data) and len(fields) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", fields[0]) is not None


def is_armoured_key(body: str) -> bool:
    """Whether the text between a private key's armour lines is one: base64 of a key, or of a cipher's blocks under header lines that name the cipher.

    Line ends may be written out as backslash n, as JSON strings have them.
    """
    lines = body.replace("\\r", "").replace("\\n", "\n").split("\n")
    headers = {k.strip(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep}
    data = _unbase64("".join("".join(x.split()) for x in lines if ":" not in x))
    if not data:
        return False
    if "ENCRYPTED" in headers.get("Proc-Type", ""):
        cipher, _, start = headers.get("DEK-Info", "").partition(",")
        return bool(cipher) and len(start) >= 16 and re.fullmatch("[0-9A-Fa-f]+", start) is not None and len(data) % 8 == 0
    return is_der_key(data) or is_ssh_key(data)


def _base64_key(text: str) -> int | None:
    data = _unbase64(text)
    if data and data[0] == 0x30 and is_der_key(data):
        return 5
    return 6 if data and data[:1] in (b"\0", b"o") and is_ssh_key(data) else None


def _base64_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Keys in base64 outside of what is taken: lines that follow one another are tried as one candidate, then each by itself."""
    runs, k = [], 0
    for m in BASE64.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or m.start() < taken[k][0]:
            runs.append(m.span())
    found, i = [], 0
    while i < len(runs):
        j = i
        while j + 1 < len(runs) and _WRAP.fullmatch(text, runs[j][1], runs[j + 1][0]):
            j += 1
        tail = _TAIL.match(text, runs[j][1])
        begin, end = runs[i][0], tail.end() if tail else runs[j][1]
        kind = _base64_key("".join(text[begin:end].split())) if j > i or tail else None
        if kind:
            found.append((begin, kind, end))
        else:
            found += [(a, own, b) for a, b in runs[i : j + 1] if (own := _base64_key(text[a:b]))]
        i = j + 1
    return found


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the candidates whose decoded bytes have the structure of a secret."""
    found = [(m.start(), 3, m.end()) for m in TOKEN.finditer(text) if is_signed_token(m[0])]
    if "-----BEGIN" in text:
        found += [(m.start(), 4, m.end()) for m in ARMOUR.finditer(text) if is_armoured_key(m[2])]
    found += _base64_spans(text, [(a, b) for a, k, b in found if k == 4])
    for m in HEX_KEY.finditer(text):
        if m[0].lower().startswith(("30", "0000", "6f70656e")) and len(m[0]) % 2 == 0:
            data = bytes.fromhex(m[0])
            if is_der_key(data) or is_ssh_key(data):
                found.append((m.start(), 7, m.end()))
    return found


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, kinds, starts, ends): for each row its spans by start, then kind; base tells the base patterns' spans.

    Places are code points, ends exclusive. A null text is empty and has no
    spans; repeated rows are reported as often; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            spans = []
            for _, _, texts in text_slices(batch):
                spans += [sorted(base_spans(x) + confirmed_spans(x)) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([[k < 3 for _, k, _ in x] for x in spans], pa.list_(pa.bool_())), pa.array([[KINDS[k] for _, k, _ in x] for x in spans], pa.list_(pa.string())), pa.array([[a for a, _, _ in x] for x in spans], pa.list_(pa.int64())), pa.array([[b for _, _, b in x] for x in spans], pa.list_(pa.int64()))],
                names=["doc_id", "base", "kinds", "starts", "ends"],
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return shipped(rows).mapInArrow(run, "doc_id long, base array<boolean>, kinds array<string>, starts array<long>, ends array<long>")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    spans = F.transform(F.arrays_zip("base", "kinds", "starts", "ends"), lambda x: F.struct(x["base"].alias("base"), x["kinds"].alias("kind"), F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string")).alias("said")))
    found = found.select("doc_id", spans.alias("s"))
    base = F.filter("s", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("s", lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    said = lambda s: F.array_join(F.transform(s, lambda x: x["said"]), ",")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(said(base), 256).alias("base_sha256"), said(F.col("s")).alias("spans"),
    )
