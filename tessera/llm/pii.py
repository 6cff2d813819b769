"""Personal data by candidate gradient boosting.

Generators with high recall propose spans of several kinds, which may overlap: of the method's own kinds, and near misses of
the base kinds (addresses and mail spelled out, card numbers with other separators or a wrong check digit, international
phone numbers that the base pattern doesn't take). Boosted trees
score each from its format (length, digits, separators, check digits, neighbours) and its
context (cue words before it); Platt-calibrated probabilities are compared with one threshold
per kind, the least at which rows kept apart for it are right in PRECISION of the cases. Accepted spans are placed by probability where no
span placed before overlaps. Base spans (exact patterns) are placed first and always stay.

The trees are trained here, on TRAIN_ROWS synthetic lines of a seeded generator: proper spans with and without cues,
look-alikes such as order numbers, versions, times and sums, and both with cue words that mislead. As many other lines calibrate
the probabilities, and THRESHOLD_ROWS again set the thresholds. A kind that no threshold makes precise enough is an error, not left out.

Null or empty text: no span. Texts are searched whole; patterns that could rescan a long run are
anchored, so the time stays linear. Repeated rows are searched one by one; extra columns are
ignored by ``find_pii`` and kept by ``redact``. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, fit
from .common import map_arrow

#: Kinds in their order: those of the base first.
KINDS = ("email", "ip", "card", "phone", "email_spelled", "phone_local", "ssn", "iban", "ipv6", "birth_date", "ip_spelled", "card_loose", "phone_intl")
BASE = KINDS[:4]
#: Synthetic rows for training and again for calibration, for the thresholds, and the precision each of these must reach.
TRAIN_ROWS, THRESHOLD_ROWS, PRECISION = 4000, 8000, 0.95

# Fixed patterns of the base, rewritten only so that no run is scanned again from inside.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Generators of the method's own kinds.
_WIDE = {
    "email_spelled": re.compile(r"\b[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]|\{at\}| at )\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.)\s?[A-Za-z0-9-]{1,63}){1,4}"),
    "phone_local": re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[ .-]?[0-9]{2,4}[ .-][0-9]{2,5}(?:[ .-][0-9]{2,4})?(?![0-9A-Za-z.-])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "ipv6": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:{1,2}){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "ip_spelled": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot )\s?[0-9]{1,3}){3}(?![0-9])"),
    "card_loose": re.compile(r"(?<![0-9])(?:[0-9]{4}(?:[ ._/-]{1,3}[0-9]{4,6}){2}(?:[ ._/-]{1,3}[0-9]{1,7})?|[0-9]{14,16})(?![0-9])"),
    "phone_intl": re.compile(r"(?<![0-9+])(?:00|\+)[1-9][0-9]{0,2}[ ./()-]{0,2}[0-9]{1,5}(?:[ ./()-]{1,2}[0-9]{2,5}){1,4}(?![0-9])"),
    "birth_date": re.compile(r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:[0-9]{4}|[0-9]{2}))(?![0-9./-])"),
}
#: Kinds that need a digit (or, spelled mail, the word or mark for "at"): texts without them are skipped.
_DIGIT = re.compile(r"[0-9]")
_AT = re.compile(r"(?:\(at\)|\[at\]|\{at\}| at )")

#: Cue words by kind, in the four languages of the corpus.
_CUES = {
    "email_spelled": ("mail", "contact", "write", "reach", "kontakt", "correo", "courriel"),
    "phone_local": ("phone", "tel", "call", "mobile", "fax", "telefon", "handy", "llame", "appel"),
    "ssn": ("ssn", "social security", "taxpayer"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ipv6": ("ip", "address", "host", "server", "adresse"),
    "ip_spelled": ("ip", "address", "host", "server", "adresse", "ping"),
    "card_loose": ("card", "visa", "credit", "karte", "tarjeta", "carte", "payment"),
    "phone_intl": ("phone", "tel", "call", "mobile", "fax", "telefon", "handy", "llame", "appel"),
    "birth_date": ("born", "birth", "dob", "geboren", "geburt", "nacid", "nacimiento", "naissance"),
}
_OTHER = ("order", "invoice", "version", "ref", "part", "total", "price", "page", "released", "updated", "time", "score", "serial", "ticket")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping local@domain, found from each @ backwards."""
    out, free = [], 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        low = max(free, text.rfind("@", free, at) + 1)
        start = low + len(text[low:at].rstrip(_LOCAL))
        if start < at:
            out.append((start, m.end()))
            free = m.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the exact patterns."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((*m.span(), "phone"))
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    out = []
    if _AT.search(text):
        out += [(*m.span(), "email_spelled") for m in _WIDE["email_spelled"].finditer(text)]
    if _DIGIT.search(text):
        for kind in KINDS[5:]:
            out += [(*m.span(), kind) for m in _WIDE[kind].finditer(text)]
    return out


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of a candidate."""
    span, before, after = text[start:end], text[max(0, start - 40) : start].lower(), text[end : end + 20].lower()
    digits = [c for c in span if c.isdigit()]
    groups = re.findall(r"[0-9]+", span)
    near = before[-16:]
    return [
        KINDS.index(kind),
        len(span),
        len(digits),
        len(digits) / len(span),
        len(groups),
        len(set(re.sub(r"[0-9A-Za-z]", "", span))),
        len(set(digits)),
        max((len(g) for g in groups), default=0),
        float(any(c in before for c in _CUES[kind])),
        float(any(c in near for c in _CUES[kind])),
        float(any(c in before for k, cues in _CUES.items() if k != kind for c in cues)),
        float(any(c in before for c in _OTHER)),
        float(any(c in after for c in ("usd", "eur", "%", "kg", "pages", "units"))),
        float(bool(before) and before[-1:] in "#$€=/"),
        float(kind == "iban" and iban_ok(span)),
        float(kind == "ssn" and groups[0] not in ("000", "666") and groups[0] < "900" and groups[1] != "00" and groups[2] != "0000"),
        float(kind == "birth_date" and _year(groups) in range(1900, 2016)),
        float("(" in span or "[" in span or "{" in span),
        float(" dot " in span or "dot)" in span or "dot]" in span or bool(re.search(r"\.[a-z]{2,4}$", span))),
        float("::" in span or span.count(":") == 7),
        float(luhn("".join(digits))),
        max((int(g) for g in groups if len(g) < 4), default=0),
        min((len(g) for g in groups), default=0),
    ]


def _year(groups: list[str]) -> int:
    y = int(groups[0] if len(groups[0]) == 4 else groups[-1])
    return y if y > 99 else 1900 + y


def synthetic(rows: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features, labels and kinds of the candidates in `rows` seeded lines."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(("ta", "ner", "os", "ich", "el", "ra", "in", "mo", "that", "und")) for _ in range(r.randint(1, 3)))

    def iban(valid: bool) -> str:
        body, land = d(18), r.choice(("DE", "FR", "ES", "NL"))
        check = 98 - int(body + "".join(str(int(c, 36)) for c in land) + "00") % 97
        return f"{land}{check if valid else (check + r.randint(1, 60)) % 97:02d}{body}"

    def card(valid: bool) -> str:
        body = f"{r.choice('345')}{d(14)}"
        right = next(c for c in "0123456789" if luhn(body + c))
        digits = body + (right if valid else str((int(right) + r.randint(1, 9)) % 10))
        return r.choice((".", "_", "  ", " - ", "/") if valid else (" ", "-", "", ".")).join(digits[k : k + 4] for k in range(0, 16, 4))

    octets = lambda: [str(r.randrange(256)) for _ in range(4)]
    proper = {
        "email_spelled": lambda: f"{word()}{r.choice((' at ', ' (at) ', '(at)', ' [at] '))}{word()}{r.choice((' dot ', ' (dot) ', '[dot]'))}{r.choice(('com', 'org', 'net', 'de'))}",
        "phone_local": lambda: r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(2)}.{d(3)}.{d(4)}")),
        "ssn": lambda: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}",
        "iban": lambda: iban(True),
        "ipv6": lambda: ":".join(f"{r.randrange(65536):x}" for _ in range(8)) if r.random() < 0.6 else f"{r.randrange(4096, 65536):x}:{r.randrange(65536):x}::{r.randrange(1, 65536):x}",
        "birth_date": lambda: r.choice((f"{r.randint(1930, 2010)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1930, 2010)}")),
        "ip_spelled": lambda: r.choice(("[.]", "(.)", "[dot]", " dot ", " (dot) ")).join(octets()),
        "card_loose": lambda: card(r.random() < 0.6),
        "phone_intl": lambda: r.choice((f"00{r.randint(1, 99)} {d(2)} {d(3)} {d(4)}", f"+{r.randint(1, 99)}/{d(3)}/{d(5)}", f"+{r.randint(1, 99)} {d(3)}/{d(6)[:5]}", f"00{r.randint(10, 99)}-{d(3)}-{d(4)}")),
    }
    #: Kinds whose format alone tells too little: without a cue they are no personal data.
    weak = ("birth_date", "phone_local", "card_loose")
    looks = [
        lambda: f"{r.choice(('order', 'invoice', 'ref', 'serial', 'ticket'))} {d(3)}-{d(3)}-{d(4)}",
        lambda: f"{r.choice(('part', 'order', 'serial'))} {d(3)}-{d(2)}-{d(4)}",
        lambda: f"version {r.randint(1, 20)}.{r.randint(1, 20)}.{r.randint(10, 99)}",
        lambda: f"{r.choice(('released', 'updated', 'page', 'on'))} {r.randint(2000, 2026)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
        lambda: f"{r.choice(('time', 'at', 'score'))} {r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}",
        lambda: f"total {d(2)} {d(3)} {d(3)} {r.choice(('usd', 'eur', 'units'))}",
        lambda: iban(False),
        lambda: f"{word()} at {word()}.{word()} {word()}",
        lambda: f"{word()} at {word()} dot {word()}s and",
        lambda: f"{d(3)} {d(3)} {d(4)} {word()}",
        lambda: f"{d(2)}.{d(2)}.{d(4)}",
        lambda: f"{r.choice(('9' + d(2), '000'))}-{d(2)}-{d(4)}",
        lambda: f"{r.choice(('serial', 'ticket', 'part', 'ref'))} {d(4)}-{d(4)}-{d(4)}-{d(4)}",
        lambda: f"{r.choice(('order', 'invoice', ''))} {d(16)}",
        lambda: f"{r.randint(256, 999)} dot {r.randint(256, 999)} dot {d(3)} dot {d(2)}",
        lambda: f"part 00{r.randint(1, 9)}-{d(3)}-{d(2)}-{d(3)}",
    ]
    rows_x, rows_y, kinds = [], [], []
    for _ in range(rows):
        left = " ".join(word() for _ in range(r.randint(2, 8)))
        right = " ".join(word() for _ in range(r.randint(1, 5)))
        if r.random() < 0.5:
            kind = r.choice(KINDS[4:])
            cue = r.choice(_CUES[kind]) if r.random() < 0.8 else ""
            if r.random() < 0.1:  # a word that misleads
                left += f" {r.choice(_OTHER)} {word()}"
            span, truth = proper[kind](), None if kind in weak and not cue else kind
            text = f"{left} {cue}{r.choice((' ', ': ', ' is '))}{span} {right}"
            place = (text.index(span), text.index(span) + len(span))
        else:
            if r.random() < 0.1:
                left += f" {r.choice(_CUES[r.choice(KINDS[4:])])} {word()} {word()}"
            text, truth, place = f"{left} {r.choice(looks)()} {right}", None, (0, 0)
        for a, b, kind in candidates(text):
            rows_x.append(features(text, a, b, kind))
            rows_y.append(float(truth == kind and a == place[0] and b >= place[1]))
            kinds.append(kind)
    return np.array(rows_x), np.array(rows_y), kinds


def threshold(scores: np.ndarray, labels: np.ndarray, precision: float = PRECISION) -> float:
    """The least score from which on labels are right in `precision` of the cases; raises if there is none."""
    order = np.argsort(-scores, kind="stable")
    ranked, right = scores[order], labels[order].cumsum() / np.arange(1, len(order) + 1)
    last = np.append(ranked[1:] != ranked[:-1], True)  # equal scores are accepted together
    good = np.flatnonzero((right >= precision) & last)
    if not len(good):
        raise ValueError(f"no threshold is right in {precision} of the cases")
    return float(ranked[good[-1]])


@lru_cache(maxsize=1)
def trained() -> tuple[Boosted, dict[str, float]]:
    """The trees, and per kind the threshold from rows that neither trained nor calibrated them."""
    model = fit(*synthetic(TRAIN_ROWS, 1)[:2], *synthetic(TRAIN_ROWS, 2)[:2])
    x, y, kinds = synthetic(THRESHOLD_ROWS, 3)
    p, of = model.probability(x), np.array(kinds)
    return model, {kind: threshold(p[of == kind], y[of == kind]) for kind in KINDS[4:]}


def all_spans(texts: list[str | None], model: Boosted, thresholds: dict[str, float]) -> list[tuple[list, list]]:
    """Per text: base spans and accepted spans, each (start, end, kind)."""
    base = [base_spans(t) if t else [] for t in texts]
    taken = [Taken(spans) for spans in base]
    proposed, rows = [], []
    for k, text in enumerate(texts):
        for a, b, kind in candidates(text) if text else []:
            if not taken[k].free(a, b):
                continue  # a base span stays, so nothing may overlap it
            proposed.append((k, a, b, kind))
            rows.append(features(text, a, b, kind))
    more: list[list] = [[] for _ in texts]
    if rows:
        p = model.probability(np.array(rows))
        order = sorted((i for i in range(len(rows)) if p[i] >= thresholds[proposed[i][3]]), key=lambda i: (-p[i], proposed[i]))
        for i in order:
            k, a, b, kind = proposed[i]
            if taken[k].free(a, b):
                taken[k].add(a, b)
                more[k].append((a, b, kind))
    return list(zip(base, more, strict=True))


class Taken:
    """Places of a text that spans hold, by cells of 64 characters."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.cells: dict[int, list[tuple[int, int]]] = {}
        for a, b, _ in spans:
            self.add(a, b)

    def add(self, a: int, b: int) -> None:
        for c in range(a // 64, (b - 1) // 64 + 1):
            self.cells.setdefault(c, []).append((a, b))

    def free(self, a: int, b: int) -> bool:
        return not any(x < b and a < y for c in range(a // 64, (b - 1) // 64 + 1) for x, y in self.cells.get(c, ()))


def joined(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document row: counts and digest of the base spans, and all spans."""
    model, thresholds = trained()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for base, more in all_spans(batch.column(1).to_pylist(), model, thresholds):
            counts = [sum(s[2] == kind for s in base) for kind in BASE]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=[c.split()[0] for c in _OUT.split(", ")]
        )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), fn, _OUT)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every found span replaced by its kind in angle brackets."""
    model, thresholds = trained()
    at = docs.columns.index("text")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        clean = []
        for text, (base, more) in zip(texts, all_spans(texts, model, thresholds), strict=True):
            parts, upto = [], 0
            for a, b, kind in sorted(base + more):
                if a >= upto:
                    parts += [text[upto:a], f"<{kind}>"]
                upto = max(upto, b)
            clean.append(None if text is None else "".join(parts) + text[upto:])
        return batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return map_arrow(docs, fn, docs.schema)
