"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text: at-signs, plus signs,
digits, schemes and identifier cues.  From each anchor a deterministic local
parser expands to the left and right and validates what it found.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.shared import table

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("url", "iban", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PARTS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_URL_REST = re.compile(r"[^\s<>\"'|]+")
_IBAN = re.compile(r"[ :]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8})")
_SECRET = re.compile(r"[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_/+=.-]{16,})")
#: Identifier cues; each opens the parser of its kind.
_CUES = {"iban": ("IBAN", "iban"), "secret": ("token", "Token", "TOKEN", "api_key", "API_KEY", "apikey", "secret", "SECRET", "password", "Password")}

_automaton = None


def _anchors():
    """The automaton, built once in each Python worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        built = ahocorasick.Automaton()
        for sign, kind in [("@", "email"), ("+", "phone"), ("://", "url"), *[(d, "digit") for d in "0123456789"]]:
            built.add_word(sign, (kind, len(sign)))
        for kind, cues in _CUES.items():
            for cue in cues:
                built.add_word(cue, (kind, len(cue)))
        built.make_automaton()
        _automaton = built
    return _automaton


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _iban_ok(code: str) -> bool:
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (code points, end exclusive) of each kind, in order of their start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS + MORE_KINDS}
    past_email = past_ip = past_card = past_url = past_secret = 0
    for at, (kind, width) in _anchors().iter(text):
        if kind == "digit":
            if at >= past_card:
                if m := _CARD.match(text, at):
                    past_card = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and _luhn(digits):
                        out["card"].append(m.span())
                else:
                    past_card = at + 1
            if at >= past_ip:
                m = _PARTS.match(text, at)
                past_ip, start = m.end(), at
                parts = m[0].split(".")
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    end = start + sum(map(len, four)) + 3
                    if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in four):
                        out["ip"].append((start, end))
                    start = end + 1
        elif kind == "email":
            start = at
            while start > past_email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                past_email = m.end()
                out["email"].append((start, past_email))
        elif kind == "phone":
            if (m := _PHONE.match(text, at)) and 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out["phone"].append(m.span())
        elif kind == "url":
            start = scheme = at - width + 1
            while start > past_url and text[start - 1] in _SCHEME:
                start -= 1
            while start < scheme and not text[start].isalpha():
                start += 1
            if start < scheme and (m := _URL_REST.match(text, at + 1)) and (body := m[0].rstrip(".,;:!?)]}")):
                past_url = at + 1 + len(body)
                out["url"].append((start, past_url))
        elif kind == "iban":
            if m := _IBAN.match(text, at + 1):
                code = m[1]
                while len(code) > 14 and not _iban_ok(code.replace(" ", "")):
                    code = code[:-1].rstrip()
                if len(code) > 14 and (not out["iban"] or out["iban"][-1][1] <= m.start(1)):
                    out["iban"].append((m.start(1), m.start(1) + len(code)))
        elif at >= past_secret and (m := _SECRET.match(text, at + 1)) and any(c.isdigit() for c in m[1]):
            past_secret = m.end(1)
            out["secret"].append(m.span(1))
    return out


def _join(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in each whole text.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans, one row for
    each input row.  Null text counts as empty; an empty text has no spans and the digest
    of the empty string.  Other columns are ignored, repeated rows are answered each, texts of
    any length are searched whole, and an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, joined = [], []
            for text in batch.column(1):
                spans = find_spans(text.as_py() or "")
                for c, k in zip(counts, BASE_KINDS):
                    c.append(len(spans[k]))
                digests.append(hashlib.sha256(_join(spans, BASE_KINDS).encode()).hexdigest())
                joined.append(_join(spans, BASE_KINDS + MORE_KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(joined, pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(scan, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op4_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(table(spark, sf_dir, "documents"))
