"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over each whole text and reports anchors:
at-signs, plus signs, digits, URL schemes and identifier cues. Deterministic
local parsers then expand each anchor to the left and right and validate the
span. Every parser moves forward only, so the work is linear in the text.

Kinds, in the order used for ties: ``email``, ``ip``, ``card``, ``phone`` (base
kinds), then those the cues add: ``url`` (scheme or ``www.`` and an authority),
``iban`` (mod-97 checked), ``account`` (an identifier cue in any case, its words joined
by a space, ``_``, ``-`` or nothing, up to four filler words such as "number", "no." or
"is", an optional separator and a value that holds a digit).

Cases: null or empty text has no spans; repeated rows give repeated results;
an empty table an empty result; text length is not limited; columns other
than doc_id and text are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "url", "iban", "account")
BASE = KINDS[:4]
# fixed values: cues and schemes
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "www.")
CUES = ("iban", "account", "acct", "ssn", "passport", "tax id", "user id", "token", "api key", "password")
JOINTS = (" ", "_", "-", "")            # between the words of a cue
FILLERS = ("no", "nr", "num", "number", "id", "code", "key", "is", "was")
MOST_FILLERS = 4
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, " \
         "spans string, n_spans long"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AUTHORITY = re.compile(r"[A-Za-z0-9](?:[^\s<>\"'`{}|\\^]*[A-Za-z0-9/_=-])?")
_IBAN = re.compile(r"[\s:=#\"']{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
# lengths by country (ISO 13616 registry)
IBAN_LENGTHS = {c: int(n) for n, cs in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,CR,HR,LI,LV 22:BG,BH,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
    "28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split())
    for c in cs.split(",")}
_FILLER = re.compile(rf"[\s:=#._-]{{0,3}}(?:{'|'.join(FILLERS)})(?![A-Za-z0-9])\.?", re.I)
_VALUE = re.compile(r"[\s:=#]{0,3}[\"']?([A-Za-z0-9][A-Za-z0-9_-]{3,})")
_FOLD = {c: c + 32 for c in range(65, 91)}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "@+":
        a.add_word(c, (c, 1))
    for c in "0123456789":
        a.add_word(c, ("0", 1))
    for w in SCHEMES:
        a.add_word(w, ("s", len(w)))
    for w in CUES:
        for joint in JOINTS:
            form = w.replace(" ", joint)
            a.add_word(form, ("c", len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        v = int(ch) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str, ats: list[int]) -> list[tuple[int, int]]:
    out, done = [], 0
    for at in ats:
        if at < done:
            continue
        left = at
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        if left < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((left, done))
    return out


def digit_runs(digits: list[int]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    start = last = None
    for p in digits:
        if last is None or p != last + 1:
            if last is not None:
                runs.append((start, last + 1))
            start = p
        last = p
    if last is not None:
        runs.append((start, last + 1))
    return runs


def chains(text: str, runs: list[tuple[int, int]], joints: str):
    """Runs joined by exactly one character of ``joints``."""
    group: list[tuple[int, int]] = []
    for r in runs:
        if group and not (r[0] == group[-1][1] + 1 and text[r[0] - 1] in joints):
            yield group
            group = []
        group.append(r)
    if group:
        yield group


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def ips(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for group in chains(text, runs, "."):
        for i in range(0, len(group) - 3, 4):
            four = group[i:i + 4]
            if all(_octet(text[a:b]) for a, b in four):
                out.append((four[0][0], four[3][1]))
    return out


def cards(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for group in chains(text, runs, " -"):
        if 14 <= sum(b - a for a, b in group) <= 19 and luhn("".join(text[a:b] for a, b in group)):
            out.append((group[0][0], group[-1][1]))
    return out


def phones(text: str, pluses: list[int]) -> list[tuple[int, int]]:
    out, done = [], 0
    for p in pluses:
        if p >= done and (m := _PHONE.match(text, p)):
            done = m.end()
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((p, done))
    return out


def urls(text: str, heads: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Heads are (start, end) of schemes; one span per URL."""
    out, done = [], 0
    for start, end in heads:
        if start >= done and (start == 0 or not text[start - 1].isalnum()):
            if (m := _AUTHORITY.match(text, end)) and ("." in m[0] or ":" in m[0] or "@" in m[0]):
                done = m.end()
                out.append((start, done))
    return out


def iban_end(text: str, start: int, end: int) -> int | None:
    """End of the IBAN at the head of ``text[start:end]``: its country's length or
    all of it, without a country the longest for which mod 97 holds; an end between
    words wins over one inside."""
    places = [p for p in range(start, end) if text[p] != " "]
    country = IBAN_LENGTHS.get(text[start:start + 2])
    sizes = [country, len(places)] if country else range(len(places), 14, -1)
    fits = []
    for n in sizes:
        if n <= len(places):
            value = "".join(text[p] for p in places[:n])
            if int("".join(str(int(x, 36)) for x in value[4:] + value[:4])) % 97 == 1:
                fits.append(places[n - 1] + 1)
    return next((e for e in fits if not text[e:e + 1].isalnum()), fits[0] if fits else None)


def accounts(text: str, cues: list[tuple[int, int]]) -> tuple[list, list]:
    """IBANs and other account values right after an identifier cue; a span
    covers the value only."""
    iban, other, done = [], [], 0
    for start, end in cues:
        if start < done or (start and (text[start - 1].isalnum())):
            continue
        at = end
        for _ in range(MOST_FILLERS):       # "Account Number:", "Acct. No.", "passport number is"
            if not (m := _FILLER.match(text, at)):
                break
            at = m.end()
        if m := _IBAN.match(text, at):
            if last := iban_end(text, *m.span(1)):
                iban.append((m.start(1), last))
                done = last
                continue
        if (m := _VALUE.match(text, at)) and any("0" <= c <= "9" for c in m[1]) and m.start(1) > end:
            other.append(m.span(1))
            done = m.end()
    return iban, other


def find(text: str, machine) -> dict[str, list[tuple[int, int]]]:
    """Spans of a whole text by kind."""
    ats, pluses, digits, heads, cues = [], [], [], [], []
    for last, (tag, size) in machine.iter(text.translate(_FOLD)):      # A-Z only: places stay
        if tag == "0":
            digits.append(last)
        elif tag == "@":
            ats.append(last)
        elif tag == "+":
            pluses.append(last)
        else:
            (heads if tag == "s" else cues).append((last + 1 - size, last + 1))
    runs = digit_runs(digits)
    iban, other = accounts(text, sorted(cues)) if cues else ([], [])
    return {"email": emails(text, ats), "ip": ips(text, runs), "card": cards(text, runs),
            "phone": phones(text, pluses), "url": urls(text, sorted(heads)), "iban": iban, "account": other}


def joined(found: dict[str, list[tuple[int, int]]], kinds) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    spans = sorted((a, order[k], b, k) for k in kinds for a, b in found[k])
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """``SCHEMA`` per document; a map over the scan, no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa

        machine = automaton()
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in b.column(1):
                found = find(text.as_py(), machine)
                base, spans = joined(found, BASE), joined(found, KINDS)
                for col, v in zip(out, (*(len(found[k]) for k in BASE),
                                        hashlib.sha256(base.encode()).hexdigest(), spans,
                                        sum(map(len, found.values())))):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), *[pa.array(x, pa.int64()) for x in out[:4]],
                 pa.array(out[4], pa.string()), pa.array(out[5], pa.string()), pa.array(out[6], pa.int64())],
                names=[f.split()[0] for f in SCHEMA.split(", ")])
    return rows.mapInArrow(run, SCHEMA)


def redact(text: str, spans: str) -> str:
    """Replace the spans of a text by ``[KIND]`` (overlaps: the first wins)."""
    out, at = [], 0
    for s in filter(None, spans.split(",")):
        kind, a, b = s.split(":")
        if int(a) >= at:
            out += [text[at:int(a)], f"[{kind.upper()}]"]
            at = int(b)
    return "".join([*out, text[at:]])
