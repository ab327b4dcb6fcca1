"""Personal data by anchor expansion.

Method: an Aho-Corasick automaton finds anchors (at-signs, schemes, digits, plus signs and identifier
cues) in one pass over the whole text.  Deterministic local parsers then expand each anchor to the
left and right and validate what they find: addresses, numbers, links and account identifiers.  Texts
without anchors cost one pass and nothing else.

Kinds, in their order: email, ip, card, phone (the base kinds, each leftmost and non-overlapping within
its kind), then url (a scheme's link that carries user data), secret (values behind credential cues and
key identifiers) and account (numbers behind account cues, and valid IBANs).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tesselon.llm.store import by_slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "secret", "account")

# The grammar of the base kinds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_SCHEMES = ("http://", "https://", "ftp://", "mailto:", "ssh://")
_SECRET_CUES = ("password", "passwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth_key")
_KEY_CUES = ("AKIA", "ASIA", "ghp_", "xoxb-", "xoxp-", "sk_live_")
_ACCOUNT_CUES = ("iban", "account no", "account number", "acct", "ssn", "passport")
_KEY_BODY = re.compile(r"[A-Za-z0-9_-]{12,}")
_VALUE = re.compile(r"[\"']?[\x20]?[:=][\x20]?[\"']?([^\s\"'<>,;]{6,})")
_ACCOUNT = re.compile(r"[\s.:#=-]{1,4}([A-Z]{0,2}[0-9](?:[\x20-]?[0-9]){5,33})(?![A-Za-z0-9])")
_IBAN_CUE = re.compile(r"[\s.:#=-]{0,4}([A-Z]{2}[0-9]{2})")
_URL = re.compile(r"[^\s\"'<>]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}")

_AT, _PLUS, _DIGIT, _SCHEME, _SECRET, _KEY, _ACCOUNT_CUE = range(7)


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", (_AT, 1))
    a.add_word("+", (_PLUS, 1))
    for d in "0123456789":
        a.add_word(d, (_DIGIT, 1))
    for words, kind in ((_SCHEMES, _SCHEME), (_SECRET_CUES, _SECRET), (_KEY_CUES, _KEY), (_ACCOUNT_CUES, _ACCOUNT_CUE)):
        for w in words:
            for form in {w, w.lower(), w.upper(), w.capitalize()} if kind != _KEY else {w}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


_machine: ahocorasick.Automaton | None = None


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c)
        if i % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban_end(text: str, start: int) -> int:
    """The end of the longest valid IBAN from ``start``, 0 if there is none."""
    m = _IBAN.match(text, start)
    end = m.end() if m else start
    while end - start >= 15:
        if not text[end : end + 1].isalnum() and iban(text[start:end]):
            return end
        end -= 1
    return 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def find(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every span in code points, ends exclusive, by start and kind."""
    global _machine
    if _machine is None:
        _machine = automaton()
    out: list[tuple[int, str, int]] = []
    # where each kind's last match ended, whether or not it was valid: matches do not overlap
    email = ip = card = phone = account = 0
    # how far links, credentials and key identifiers have been read: no anchor in there is read again
    url = secret = named = 0
    for last, (kind, size) in _machine.iter(text):
        i = last - size + 1
        if kind == _DIGIT:
            # a number begins where no digit stands before it, or where the last match ended inside it
            if i >= ip and (i == ip or not "0" <= text[i - 1] <= "9" or not i):
                m = _IP.match(text, i)
                if m:
                    ip = m.end()
                    if all(int(p) <= 255 for p in m.group().split(".") if len(p) < 6) and all(len(p.lstrip("0")) <= 3 for p in m.group().split(".")):
                        out.append((i, "ip", ip))
            if i >= card:
                m = _CARD.match(text, i)
                if m:
                    card = m.end()
                    d = _digits(m.group())
                    if 12 <= len(d) <= 19 and luhn(d):
                        out.append((i, "card", card))
        elif kind == _AT:
            if i >= email:
                a = i
                while a > email and text[a - 1] in _LOCAL:
                    a -= 1
                if a < i:
                    m = _DOMAIN.match(text, i + 1)
                    if m:
                        email = m.end()
                        out.append((a, "email", email))
        elif kind == _PLUS:
            if i >= phone:
                m = _PHONE.match(text, i)
                if m:
                    phone = m.end()
                    if 9 <= len(_digits(m.group())) <= 15:
                        out.append((i, "phone", phone))
        elif kind == _SCHEME:
            if i >= url:
                m = _URL.match(text, last + 1)
                if m:
                    url = b = m.end()
                    while b > last + 1 and text[b - 1] in ".,;:!?)]}":
                        b -= 1
                    body = text[last + 1 : b]
                    if "@" in body or "token=" in body or "user" in body.lower():
                        out.append((i, "url", b))
        elif kind == _SECRET:
            if i >= secret:
                m = _VALUE.match(text, last + 1)
                if m:
                    secret = m.end(1)
                    out.append((m.start(1), "secret", secret))
        elif kind == _KEY:
            if i >= named and (not i or not text[i - 1].isalnum()):
                m = _KEY_BODY.match(text, last + 1)
                if m:
                    named = m.end()
                    out.append((i, "secret", named))
        elif i >= account and (not i or not text[i - 1].isalnum()):
            if size == 4 and text[i : last + 1].lower() == "iban":
                m = _IBAN_CUE.match(text, last + 1)
                account = max(account, _iban_end(text, m.start(1)) if m else 0)
            else:
                m = _ACCOUNT.match(text, last + 1)
                account = m.end(1) if m else account
            if m and account > m.start(1):
                out.append((m.start(1), "account", account))
    order = {k: n for n, k in enumerate(KINDS)}
    return sorted(set(out), key=lambda x: (x[0], order[x[1]], x[2]))


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span, or each run of overlapping spans, replaced by its first kind's mark."""
    out, at = [], 0
    i = 0
    while i < len(spans):
        a, kind, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][2])
            i += 1
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join(out) + text[at:]


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    ``spans`` lists all spans as kind:start:end; ``base_sha256`` is the digest of the base kinds' list.
    A null text counts as empty and has none; repeated rows give repeated rows; other columns are
    ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, lists = {k: [] for k in BASE}, [], []
            for t in batch.column(1).to_pylist():
                spans = find(t) if t else []
                for k in BASE:
                    counts[k].append(sum(x[1] == k for x in spans) if spans else 0)
                digests.append(hashlib.sha256(joined([x for x in spans if x[1] in BASE]).encode()).hexdigest())
                lists.append(joined(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()), pa.array(lists, pa.string())], names=list("abcdefg"))

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in BASE), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return docs.select(F.col(key), F.col(text)).mapInArrow(by_slices(run), schema)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by a mark of its kind (null stays null)."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [t if not t else redacted(t, find(t)) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))

    return docs.mapInArrow(by_slices(run), docs.schema)
