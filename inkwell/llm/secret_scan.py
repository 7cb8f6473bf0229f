"""Secret scans: Aho-Corasick keywords, anchored expressions near hits, checksums.

One automaton over all keywords passes each text once; an expression is tried
only where its keyword was hit, anchored there, and what it matches must pass
the rule's own validation (checksums of tokens that embed one, the Luhn and
mod-97 digits of account numbers, decodable JWT headers, the entropy of
assigned values). One pass, no shuffle, whole texts.

Defined cases: null text is empty and gives nothing; matches of one document do
not overlap (the earlier, then the more specific rule, then the longer one
stands, and a private key before all); secrets have no greatest length, and a private
key goes to its END line, or without one, to the end of its headers and base64; the
entropy of a value is that of its first 256 characters; repeated rows and repeated secrets are reported each; rows without
doc_id, or with one that is no whole number, are reported with a null id. Other
columns, whatever their names, are ignored, or passed through by ``redact``,
whose n_chars, if there is one, is made to fit the new text.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
import zlib
from collections import Counter
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, mapped, place

_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _crc_token(token: str) -> bool:
    """Six base-62 digits at the end are the CRC-32 of what follows the prefix."""
    body = token.split("_", 1)[1]
    value, digits = zlib.crc32(body[:-6].encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = _B62[d] + digits
    return digits == body[-6:]


def _luhn(text: str) -> bool:
    d = [int(c) for c in text if c.isdigit()]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 * (x > 4)) for i, x in enumerate(reversed(d))) % 10 == 0


def _iban(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _jwt(token: str) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(token.split(".")[0] + "=="))
    except (ValueError, binascii.Error, TypeError):
        return False


def _entropy(value: str) -> bool:
    """At least 3 bits a character, letters and digits both, no placeholder."""
    value = value[:256]
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return bits >= 3 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and not re.search(r"(?i)example|changeme|placeholder|xxxx|your[_-]", value)


_BEGIN, _END = (rf"-----{x} (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----" for x in ("BEGIN", "END"))
_BREAK = r"(?:\s|\\+[nrt])"
_PRIVATE = rf"{_BEGIN}(?:(?:[^-]|-(?!----BEGIN ))*?{_END}|{_BREAK}*(?:[A-Z][A-Za-z-]*: [^\n\\]*{_BREAK}+)*(?:[0-9A-Za-z+/=]|{_BREAK})*)"

#: name, keywords, expression anchored at the hit (group 1, or all, is the secret), validation, checksum?
RULES = [
    ("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])", _crc_token, True),
    ("npm_token", ("npm_",), r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])", _crc_token, True),
    ("aws_access_key", ("akia", "asia"), r"A[KS]IA[A-Z2-7]{16}(?![0-9A-Za-z])", None, False),
    ("gitlab_token", ("glpat-",), r"glpat-[0-9A-Za-z_-]{20}(?![0-9A-Za-z_-])", None, False),
    ("google_api_key", ("aiza",), r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])", None, False),
    ("slack_token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-"), r"xox[bpar]-[0-9A-Za-z-]{20,}", None, False),
    ("stripe_key", ("sk_live_", "rk_live_"), r"[sr]k_live_[0-9A-Za-z]{16,}", None, False),
    ("json_web_token", ("eyj",), r"eyJ[0-9A-Za-z_-]{5,}\.[0-9A-Za-z_-]{5,}\.[0-9A-Za-z_-]{10,}", _jwt, True),
    ("private_key", ("-----begin",), _PRIVATE, None, False),
    ("payment_card", ("card",), r"(?i:card)(?:[ _-]?(?:no|nr|number|num))?\.?\s{0,3}[:=#]?\s{0,3}((?:\d[ -]?){12,18}\d)(?!\d)", _luhn, True),
    ("iban", ("iban",), r"(?i:iban)\s{0,3}[:=#]?\s{0,3}([A-Z]{2}\d{2}(?: ?[0-9A-Z]{1,4}){3,8})(?![0-9A-Za-z])", _iban, True),
    ("assigned_secret", ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "auth_key", "private_key"), r"""(?i:token|secret|password|passwd|api[_-]?key|access_key|auth_key|private_key)[\w.-]{0,24}["']?\s{0,4}(?:=>|:=|=|:)\s{0,4}["']?([^\s"'`,;<>]{8,})""", _entropy, False),
]


#: The rules whose hits may follow a letter or digit, as of an escaped line end.
_ANYWHERE = {i for i, r in enumerate(RULES) if r[0] in ("private_key", "assigned_secret")}
_KEY = next(i for i, r in enumerate(RULES) if r[0] == "private_key")


@cache
def _machine():
    a, by = ahocorasick.Automaton(), {}
    for i, (_, words, *_rest) in enumerate(RULES):
        for w in words:
            by.setdefault(w, []).append(i)
    for w, rules in by.items():
        a.add_word(w, (len(w), tuple(rules)))
    a.make_automaton()
    return a, [re.compile(r[2]) for r in RULES]


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, end, rule) of the secrets of a text, in order, without overlaps."""
    machine, compiled = _machine()
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_ASCII_LOWER)
    found = []
    for last, (size, rules) in machine.iter(low):
        at = last - size + 1
        if at and text[at - 1].isalnum() and not _ANYWHERE.issuperset(rules):
            continue
        for r in rules:
            m = compiled[r].match(text, at)
            if m:
                g = 1 if compiled[r].groups else 0
                check = RULES[r][3]
                if check is None or check(m.group(g)):
                    found.append((m.start(g), m.end(g), r))
    found.sort(key=lambda x: (x[2] != _KEY, x[2], x[0], -x[1]))
    kept: list[tuple[int, int, int]] = []
    for s, e, r in found:
        if all(e <= a or b <= s for a, b, _ in kept):
            kept.append((s, e, r))
    return sorted(kept)


_SCHEMA = "doc_id long, rule string, start_char long, n_chars long, secret_sha256 string, preview string, checksum string"


def scan(docs: DataFrame) -> DataFrame:
    """One row for each secret; the secret itself only as a digest and its first four characters."""

    def run(batches):
        for x in batches:
            rows = []
            for i, t in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                t = t.as_py()
                for s, e, r in find(t) if t else ():
                    rows.append((i, RULES[r][0], s, e - s, hashlib.sha256(t[s:e].encode()).hexdigest(), t[s : s + 4] + "*" * 4, "valid" if RULES[r][4] else "none"))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in _SCHEMA.split(", ")])

    return docs.select(doc_key().alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns; each secret in text gives way to [REDACTED:rule]."""
    at, n = place(docs, "text"), place(docs, "n_chars")

    def change(read, x):
        texts, changed = read[0].to_pylist(), np.zeros(len(read[0]), dtype=bool)
        for k, t in enumerate(texts):
            spots = find(t) if t else ()
            if spots:
                changed[k], out, done = True, [], 0
                for s, e, r in spots:
                    out += [t[done:s], f"[REDACTED:{RULES[r][0]}]"]
                    done = e
                texts[k] = "".join([*out, t[done:]])
        if changed.any():
            new = pa.array(texts, pa.string())
            x = x.set_column(at, x.schema.field(at), new.cast(x.column(at).type))
            if n is not None:
                x = x.set_column(n, x.schema.field(n), pc.if_else(pa.array(changed), pc.utf8_length(new).cast(x.column(n).type), x.column(n)))
        return x

    return mapped(docs, ["text"], change)
