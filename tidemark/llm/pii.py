"""Personal data by anchor expansion: one automaton finds anchors, and local parsers expand and validate around each.

Anchors are at-signs, schemes, identifier cues, plus signs and figures; an Aho-Corasick automaton (``functions.automaton``) finds
all of them in one pass over the bytes of many texts. Parsers then walk from an anchor to the boundaries of what it may stand in:

* ``email`` from an at-sign to the left over a local part and to the right over labels,
* ``ip`` four numbers of at most 255 that single dots join, ``card`` 16 to 19 figures (single spaces or hyphens between) that pass
  the Luhn test, both from runs of figures; ``phone`` from a plus sign, 8 to 15 figures,
* ``mailbox`` addresses with letters beyond ASCII, ``address`` a scheme with a user before its host, ``account`` what follows an
  identifier cue and is valid for it (check digits of IBANs, area numbers of SSNs, five figures or more elsewhere). These three are added to the rest.

The first four kinds are exactly the leftmost non-overlapping matches of their patterns, of which the invalid ones are dropped.
Positions count code points, ends are exclusive. Null texts count as empty and have no findings; ids are passed through, nulls
and repeats included; whole texts are searched, however long, in time that follows their length; further columns are left out
(or kept by ``redact``), whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.automaton import automaton, code_points, slices
from .common import replaced, text_of, with_row

#: The first BASE kinds are the fixed patterns.
KINDS, BASE = ("email", "ip", "card", "phone", "mailbox", "address", "account"), 4
#: What stands before identifiers, in lower case, and the parser of what follows.
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn"} | dict.fromkeys(("account", "acct", "passport", "customer", "member", "policy", "tax id", "user id", "patient", "tel:"), "number")
FIGURES = tuple("0123456789")
ANCHORS = (*FIGURES, "@", "+", "://", *CUES)
AT, PLUS, SCHEME = 10, 11, 12

_LEAD = rb"(?: ?(?:number|num|no|id|nr)\b\.?)?[ \t]?[:=#]?[ \t]{0,2}#?"
FOLLOWS = {
    "iban": re.compile(_LEAD + rb"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])", re.I),
    "ssn": re.compile(_LEAD + rb"((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9])", re.I),
    "number": re.compile(_LEAD + rb"([A-Z0-9](?:-?[A-Z0-9]){5,23})(?![A-Za-z0-9])", re.I),
}
_SCHEME = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]{0,30}\Z")
_AUTHORITY = re.compile(rb"([^\x00-\x20/?#@<>\"'\\]+)@([A-Za-z0-9.-]+|\[[0-9A-Fa-f:.]+\])(:[0-9]{1,5})?")
#: Longest local part and domain of a valid address (fixed values).
LOCAL, DOMAIN = 64, 255
_LEFT, _RIGHT = re.compile(r"[\w.%+-]+\Z"), re.compile(r"[\w-]+(?:\.[\w-]+)+")


def _marks(chars: bytes) -> bytes:
    """A translation table: 1 for these bytes, 0 for others."""
    return bytes(int(b in chars) for b in range(256))


_ALNUM = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
IN_LOCAL, IN_LABEL, IN_PHONE, IN_FIGURES = _marks(_ALNUM + b"._%+-"), _marks(_ALNUM + b"-"), _marks(b" ().0123456789-"), _marks(b"0123456789")
LOWER = bytes(range(256)).lower()


def luhn(figures: bytes) -> bool:
    total = 0
    for k, b in enumerate(reversed(figures)):
        d = (b - 48) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def run_end(marks: bytes, start: int, stop: int) -> int:
    """Where the run of marked bytes that begins at ``start`` ends."""
    end = marks.find(b"\x00", start, stop)
    return stop if end < 0 else end


def numbers(raw: bytes, text: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, kind, start, end) of ip addresses and card numbers, from the places of all figures."""
    if not len(at):
        return
    data, same, gap = np.frombuffer(raw, np.uint8), text[1:] == text[:-1], np.diff(at)
    between = data[at[1:] - 1]
    # chains of figures with at most one space or hyphen between two of them
    first = np.flatnonzero(np.concatenate([[True], ~(same & ((gap == 1) | (gap == 2) & ((between == 32) | (between == 45))))]))
    size = np.diff(np.append(first, len(at)))
    for k in np.flatnonzero((size >= 16) & (size <= 19)).tolist():
        own = at[first[k] : first[k] + size[k]]
        if luhn(data[own].tobytes()):
            yield int(text[first[k]]), 2, int(own[0]), int(own[-1]) + 1
    # runs of figures, and chains of runs that single dots join; every four runs of a chain are a match
    first = np.flatnonzero(np.concatenate([[True], ~(same & (gap == 1))]))
    begin, end, owner = at[first], at[np.append(first[1:], len(at)) - 1] + 1, text[first]
    joined = (owner[1:] == owner[:-1]) & (begin[1:] - end[:-1] == 1) & (data[begin[1:] - 1] == 46)
    head = np.flatnonzero(np.concatenate([[True], ~joined]))
    rank = np.arange(len(first)) - np.repeat(head, np.diff(np.append(head, len(first))))
    for k in np.flatnonzero(rank % 4 == 3).tolist():
        parts = (raw[begin[j] : end[j]].lstrip(b"0") or b"0" for j in range(k - 3, k + 1))
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            yield int(owner[k]), 1, int(begin[k - 3]), int(end[k])


def email(local: bytes, label: bytes, raw: bytes, at: int, lo: int, hi: int) -> tuple[int, int] | None:
    """The address around an at-sign; its local part begins at ``lo``, the end of the match before, or later."""
    begin = max(local.rfind(b"\x00", lo, at) + 1, lo)
    end = run_end(label, at + 1, hi)
    if begin == at or end == at + 1:
        return None
    dots = 0
    while end < hi and raw[end] == 46 and (more := run_end(label, end + 1, hi)) > end + 1:
        end, dots = more, dots + 1
    return (begin, end) if dots else None


def mailbox(raw: bytes, at: int, lo: int, hi: int) -> tuple[int, int] | None:
    """The address around an at-sign if it holds letters beyond ASCII."""
    left = _LEFT.search(raw[max(lo, at - 4 * LOCAL - 4) : at].decode(errors="ignore"))
    right = _RIGHT.match(raw[at + 1 : min(hi, at + 5 + 4 * DOMAIN)].decode(errors="ignore"))
    if not left or not right or len(left[0]) > LOCAL or len(right[0]) > DOMAIN or (left[0] + right[0]).isascii():
        return None
    return at - len(left[0].encode()), at + 1 + len(right[0].encode())


def phone(chars: bytes, figures: bytes, at: int, hi: int) -> tuple[int, int] | None:
    """From a plus sign and a figure to the last figure of the run; 8 to 15 figures."""
    if at + 1 >= hi or not figures[at + 1]:
        return None
    last = figures.rfind(b"\x01", at + 3, run_end(chars, at + 2, hi))
    return (at, last + 1) if last >= 0 and 8 <= figures.count(b"\x01", at, last + 1) <= 15 else None


def address(raw: bytes, at: int, lo: int, hi: int) -> tuple[int, int] | None:
    """From a scheme's first letter to the end of its host, if a user stands before the host."""
    scheme = _SCHEME.search(raw, max(lo, at - 31), at)
    rest = _AUTHORITY.match(raw, at + 3, hi)
    return (scheme.start(), rest.end()) if scheme and rest else None


def account(raw: bytes, kind: str, at: int, end: int, lo: int, hi: int) -> tuple[int, int] | None:
    """What follows an identifier cue that is a word of its own, if it is valid."""
    if at > lo and raw[at - 1] in _ALNUM:
        return None
    found = FOLLOWS[kind].match(raw, end, hi)
    if not found:
        return None
    value = found[1].replace(b" ", b"").replace(b"-", b"").upper()
    if kind == "iban":
        turned = value[4:] + value[:4]
        ok = len(value) <= 34 and int("".join(str(int(chr(c), 36)) for c in turned)) % 97 == 1
    else:
        ok = sum(48 <= c < 58 for c in value) >= 5
    return found.span(1) if ok else None


def findings(offsets: np.ndarray, data: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, kind, start, end), in bytes of the buffer, of all findings of a slice of texts, by text, kind and start."""
    raw = data.tobytes()
    text, term, start = automaton(ANCHORS).search(offsets, np.frombuffer(raw.translate(LOWER), np.uint8))
    figure = term < AT
    found = list(numbers(raw, text[figure], start[figure]))
    rest = np.flatnonzero(~figure)
    if len(rest):
        marks = {t: raw.translate(t) for t in (IN_LOCAL, IN_LABEL, IN_PHONE, IN_FIGURES)}
        parsers, free = [CUES.get(a, "") for a in ANCHORS], {}
        for i, k, at in zip(text[rest].tolist(), term[rest].tolist(), start[rest].tolist()):
            lo, hi = int(offsets[i]), int(offsets[i + 1])
            if k == AT:
                got = email(marks[IN_LOCAL], marks[IN_LABEL], raw, at, max(lo, free.get(i, lo)), hi)
                if got:
                    free[i] = got[1]
                    found.append((i, 0, *got))
                if (wide := mailbox(raw, at, lo, hi)) and wide != got:
                    found.append((i, 4, *wide))
            elif k == PLUS:
                got = phone(marks[IN_PHONE], marks[IN_FIGURES], at, hi)
                if got:
                    found.append((i, 3, *got))
            elif k == SCHEME:
                got = address(raw, at, lo, hi)
                if got:
                    found.append((i, 5, *got))
            else:
                got = account(raw, parsers[k], at, at + len(ANCHORS[k]), lo, hi)
                if got:
                    found.append((i, 6, *got))
    return sorted(set(found))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and findings (array of kind, start, end; by kind as in KINDS, then start) of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo, offsets, data in slices(batch.column(1)):
                found = np.array(findings(offsets, data), np.int64).reshape(-1, 4)
                ends = np.searchsorted(found[:, 0], np.arange(len(offsets)))
                points = code_points(data) if len(found) else np.zeros(1, np.int64)
                base = points[offsets[found[:, 0]]] if len(found) else np.zeros(0, np.int64)
                kinds = pa.array(KINDS).take(pa.array(found[:, 1]))
                items = pa.StructArray.from_arrays([kinds, *(pa.array((points[found[:, c]] - base).astype(np.int64)) for c in (2, 3))], ["kind", "start", "end"])
                spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(offsets) - 1), spans], ["doc_id", "findings"])

    kind = docs.schema[id_col].dataType
    finding = T.StructType().add("kind", T.StringType()).add("start", T.LongType()).add("end", T.LongType())
    return text_of(docs, id_col, text_col).mapInArrow(run, T.StructType().add("doc_id", kind).add("findings", T.ArrayType(finding)))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the fixed patterns, a checksum of their spans, and all spans as text."""
    said = "array_join(transform({}, f -> concat(f.kind, ':', f.start, ':', f.end)), ',')"
    base = f"filter(findings, f -> f.kind in ({', '.join(repr(k) for k in KINDS[:BASE])}))"
    count = [F.expr(f"cast(size(filter(findings, f -> f.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS[:BASE]]
    return found.select("doc_id", *count, F.sha2(F.expr(said.format(base)), 256).alias("base_sha256"), F.expr(said.format("findings")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with every finding replaced by its kind in brackets; findings that overlap are replaced together, by the kind of
    the first. Texts without findings, nulls included, stay as they are, and so do all other columns but ``n_chars``."""
    rows = with_row(docs, id_col, text_col).select("row", F.col(f"row.`{text_col}`").alias("text"))

    def clean(raw: bytes, lo: int, spans: list[tuple[int, int, int]]) -> bytes:
        pieces, at, upto = [], lo, -1
        for a, b, kind in spans:
            if a >= upto:
                pieces += [raw[at:a], b"[" + KINDS[kind].upper().encode() + b"]"]
            at = upto = max(upto, b)
        return b"".join([*pieces, raw[at:]])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo, offsets, data in slices(batch.column(1)):
                own: dict[int, list] = {}
                for i, kind, a, b in findings(offsets, data):
                    own.setdefault(i, []).append((a, b, kind))
                part = batch.slice(lo, len(offsets) - 1)
                texts = part.column(1).to_pylist()
                for i, spans in own.items():
                    first = int(offsets[i])
                    texts[i] = clean(data[first : offsets[i + 1]].tobytes(), 0, sorted((a - first, b - first, kind) for a, b, kind in spans)).decode()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["row", "clean"])

    out = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("clean", T.StringType())]))
    return replaced(docs, out, "clean")
