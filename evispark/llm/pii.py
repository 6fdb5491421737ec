"""Personal data by candidate generation and boosted trees.

Base rules find e-mail addresses, IP addresses, card numbers and international phone numbers; their spans are
always reported. Beyond them, high-recall generators propose overlapping spans (written-out e-mail addresses,
national phone numbers, social security numbers, account numbers with a country code); boosted trees judge each
from its format and from the words around it, and a span is reported where its probability reaches the threshold
calibrated for its kind and no base span or better proposal overlaps it.

The trees are fitted here on ``EXAMPLES`` generated sentences (a fixed seed; half of them calibrate), which
write such data in the formats people use, and look-alikes: order numbers, versions, dates, sums, serial numbers. The
words that stand by either are English, German, French and Spanish.
A kind's threshold is the lowest one at which ``PRECISION`` of its calibration proposals above are personal.
``calibrated`` then raises the thresholds by what the corpus itself holds: formats and words confirm or refute most
proposals of its texts (``verdict``; the others count on neither side), and a kind's threshold rises to the lowest
one, no lower than before, at which ``PRECISION`` of the judged proposals above are confirmed. All texts are counted,
by kind and step of the score, so what meets the driver doesn't grow with them.

Defined results: a null or empty text holds nothing; positions are code points; a base match that fails its
check uses up its text but isn't reported; repeated rows give equal results; a column with the name of the result
is replaced; an empty table gives an empty table. Each row is scanned whole where it lies.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.llm import boosting

BASE = ("email", "ip", "card", "phone")
EXTRA = ("email_text", "national_phone", "ssn", "iban")
KINDS = BASE + EXTRA
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
EXAMPLES, PRECISION = 6_000, 0.99
CONTEXT = 40
#: Scores are counted in steps of 1 / STEPS, and beyond REACH on either side as REACH.
STEPS, REACH = 20, 20

# The base rules (the parts of e-mail and IP addresses), and the proposals' patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9.]+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY_DIGIT = re.compile(r"[0-9]")
DIGIT_RUN = re.compile(r"[+0-9][0-9 ().+-]*")
AT, DOT, NAME, LABEL = r" ?(?:[\[(]at[\])]| at ) ?", r" ?(?:[\[(]dot[\])]| dot ) ?", "[A-Za-z0-9._%+-]{1,64}", "[A-Za-z0-9-]{1,63}"
EMAIL_TEXT = re.compile(rf"(?<![A-Za-z0-9._%+-])(?=((?:{NAME}{DOT}){{0,3}}{NAME}{AT}{LABEL}(?:{DOT}{LABEL}){{1,8}}))", re.I)
JOINED_BEFORE, JOINED_AFTER = re.compile(rf"(?:{AT}|{DOT})\Z", re.I), re.compile(AT, re.I)
NATIONAL = re.compile(r"\(?[0-9]{2,5}\)?[ .-][0-9]{2,4}(?:[ .-][0-9]{2,5}){1,3}|\(?0[0-9]{2,5}\)?[ ./-][0-9]{5,8}|[0-9]{10,11}")
SSN = re.compile(r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")

# Words that stand by personal data, by kind, and by look-alikes, in English, German, French and Spanish; and the
# last labels of most addresses.
NEAR = {
    "email_text": ("mail", "write", "contact", "reach", "address", "inbox", "schreib", "kontakt", "erreich", "adresse", "écri", "joindre", "courriel", "correo", "escrib", "direcci"),
    "national_phone": (
        "call", "phone", "tel", "mobile", "cell", "fax", "dial", "ring", "whatsapp", "sms", "hotline", "contact", "reach", "number", "ruf", "anruf", "handy", "mobil", "nummer", "erreich",
        "appel", "téléphon", "portable", "numéro", "joindre", "llam", "teléfono", "móvil", "número", "marque",
    ),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "iban": ("iban", "account", "transfer", "bank", "payment", "konto", "überweis", "compte", "virement", "cuenta", "transferencia"),
}
FAR = (
    "order", "invoice", "version", "serial", "part", "item", "isbn", "model", "page", "section", "tracking", "ticket", "build", "score", "total", "price", "year", "date", "id", "ref", "no.",
    "bestellung", "rechnung", "artikel", "seite", "modell", "preis", "jahr", "datum", "commande", "facture", "article", "modèle", "prix", "année", "pedido", "factura", "artículo", "página", "modelo", "precio", "fecha",
)
PLAIN = (
    "the", "a", "we", "for", "and", "it", "was", "please", "today", "with", "about", "now", "then", "on", "our", "to", "see", "her", "his", "my", "is", "me", "us", "uns", "an", "bitte", "und", "oder",
    "mich", "ist", "le", "la", "de", "est", "et", "moi", "nous", "el", "es", "mi", "su", "por", "favor",
)
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "eu", "us", "uk", "de", "fr", "es", "it", "nl", "ch", "at")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int, str]]:
    """Leftmost addresses, each found from its @ in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            done = m.end()
        at = text.find("@", max(at + 1, done))


def addresses(run: str, at: int) -> Iterator[tuple[int, int, str]]:
    """IP addresses in a run of digits and dots that begins at ``at``: four numbers in a row, then the next four."""
    parts, k = run.split("."), 0
    while k + 4 <= len(parts):
        four = parts[k : k + 4]
        if not all(four):
            at += len(parts[k]) + 1
            k += 1
            continue
        size = sum(map(len, four)) + 3
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
            yield at, at + size, "ip"
        at += size + 1
        k += 4


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The base rules' spans: (start, end, kind). Matches lie within runs of the characters that they may hold."""
    found = list(emails(text))
    for run in DIGIT_RUN.finditer(text):
        part, at = run[0], run.start()
        if len(part) < 7:
            continue
        for m in DOTTED.finditer(part):
            found += addresses(m[0], at + m.start())
        for m in CARD.finditer(part):
            digits = digits_of(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((at + m.start(), at + m.end(), "card"))
        for m in PHONE.finditer(part):
            if 10 <= len(digits_of(m[0])) <= 15:
                found.append((at + m.start(), at + m.end(), "phone"))
    return found


def proposals(text: str, low: str) -> list[tuple[int, int, str]]:
    """Spans that could be personal data beyond the base rules; they may overlap."""
    found = []
    if " dot " in low or "[dot]" in low or "(dot)" in low:
        found += [(m.start(1), m.end(1), "email_text") for m in EMAIL_TEXT.finditer(text)]
    for run in DIGIT_RUN.finditer(text):
        at = run.start() - (run.start() > 0 and text[run.start() - 1] == "(")
        part = text[at : run.end()]
        if len(part) < 9:
            continue
        found += [(at + m.start(), at + m.end(), "national_phone") for m in NATIONAL.finditer(part)]
        found += [(at + m.start(), at + m.end(), "ssn") for m in SSN.finditer(part)]
    if ANY_DIGIT.search(text):
        found += [(m.start(), m.end(), "iban") for m in IBAN.finditer(text)]
    return found


def mod97(value: str) -> bool:
    moved = value.replace(" ", "")
    moved = moved[4:] + moved[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def features(text: str, span: tuple[int, int, str]) -> list[float]:
    """Format and context of a proposal."""
    start, end, kind = span
    body, before, after = text[start:end], text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    digits, groups = digits_of(body), re.findall(r"[0-9]+", body)
    near, last = NEAR[kind], before.split()[-3:]
    area = int(digits[:3] or 0) if kind == "ssn" else 0
    return [
        EXTRA.index(kind),
        len(body),
        len(digits),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        len(groups[-1]) if groups else 0,
        len(set(digits)),
        sum(body.count(c) for c in "-"),
        body.count("."),
        body.count(" "),
        body.count("(") == body.count(")") == 1,
        body.startswith("0") or body.startswith("(0"),
        kind == "iban" and mod97(body),
        kind == "ssn" and 0 < area < 900 and area != 666 and digits[3:5] != "00" and digits[5:] != "0000",
        start > 0 and (text[start - 1].isalnum() or text[start - 1] in "/#$€£=_.-"),
        end < len(text) and (text[end : end + 1].isalnum() or text[end : end + 1] in "%€$/_=" or re.match(r"[.-][0-9]", text[end : end + 2]) is not None),
        sum(w in before for w in near),
        any(w in x for x in last for w in near),
        sum(w in after for w in near),
        sum(w in before.split() or w in before[-12:] for w in FAR),
        any(x.strip(":#") in FAR for x in last),
        "at" in body.lower() and any(c in body for c in "[("),
        any(1900 <= int(g) <= 2100 for g in groups if len(g) == 4),
        kind == "email_text" and JOINED_BEFORE.search(before) is not None,
        kind == "email_text" and JOINED_AFTER.match(after) is not None,
        kind == "email_text" and re.split(r"[^a-z0-9]+", body.lower())[-1] in ENDINGS,
    ]


def verdict(text: str, span: tuple[int, int, str]) -> int:
    """1 where format and words confirm a proposal, -1 where they refute it, 0 where they leave it open."""
    start, end, kind = span
    body, digits = text[start:end], digits_of(text[start:end])
    joined = (start > 0 and (text[start - 1].isalnum() or text[start - 1] in "#$€£=_")) or (end < len(text) and (text[end].isalnum() or text[end] in "%€$_="))
    last = [w.strip(":#.,(").lower() for w in text[max(0, start - CONTEXT) : start].split()[-2:]]
    named, other = any(w in x for x in last for w in NEAR[kind]), any(x in FAR for x in last)
    if joined or (other and not named):
        return -1
    if kind == "iban":
        return 1 if mod97(body) else -1
    if kind == "ssn" and (digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000"):
        return -1
    if kind == "email_text" and any(c in body for c in "[("):
        return 1
    return int(named)


def iban_of(rng: random.Random) -> str:
    head, body = rng.choice(["DE", "FR", "ES", "NL", "GB", "IT"]), "".join(rng.choice("0123456789") for _ in range(rng.choice([14, 18, 20])))
    check = 98 - int("".join(str(int(c, 36)) for c in body + head + "00")) % 97
    plain = f"{head}{check:02d}{body}"
    return plain if rng.random() < 0.4 else " ".join(plain[k : k + 4] for k in range(0, len(plain), 4))


def written(rng: random.Random, kind: str, personal: bool) -> tuple[str, str]:
    """(word before, body) of one generated example."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdefghiklmnorstu") for _ in range(rng.randrange(3, 9)))
    near, far = rng.choice(NEAR[kind]), rng.choice(FAR)
    lead = near if rng.random() < 0.8 else rng.choice(PLAIN)
    if not personal:
        lead = far + rng.choice(["", "", " number"]) if rng.random() < 0.8 else rng.choice(PLAIN)
    if kind == "email_text":
        at, dot = rng.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", " dot ")])
        if personal:
            return lead, f"{name()}{rng.choice(['', '.' + name(), n(2), dot + name()])}{at}{name()}{dot}{rng.choice(ENDINGS)}"
        return rng.choice(PLAIN), f"{rng.choice(PLAIN)} at {rng.choice(PLAIN)} dot {rng.choice(PLAIN)}"
    if kind == "national_phone":
        sep = rng.choice("- .")
        if personal:
            return lead, rng.choice([f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}{sep}{n(3)}{sep}{n(4)}", f"0{n(3)} {n(7)}", f"0{n(2)} {n(7)}", f"0{n(3)} {n(8)}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"0{n(10)}"])
        return lead, rng.choice([f"{n(3)}{sep}{n(3)}{sep}{n(4)}", f"{n(10)}", f"{n(4)}-{n(2)}-{n(2)}", f"{n(2)}.{n(2)}.{n(4)}", f"{n(3)} {n(3)} {n(3)} {n(3)}", f"{n(3)}-{n(1)}-{n(5)}-{n(2)}", f"{n(4)} {n(4)} {n(4)}", f"{n(11)}"])
    if kind == "ssn":
        body = f"{n(3)}-{n(2)}-{n(4)}"
        return (lead, body) if personal else (lead, rng.choice([body, f"{n(3)} {n(2)} {n(4)}", f"000-{n(2)}-{n(4)}", f"{n(3)}-00-{n(4)}"]))
    body = iban_of(rng)
    if not personal:
        head = rng.choice(["XX", "AB", "DE", "QZ"])
        body = head + n(2) + rng.choice([n(12), "".join(rng.choice("ABCDEF0123456789") for _ in range(16))])
    return lead, body


def examples(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the proposals that generated sentences hold."""
    rng, rows, labels = random.Random(seed), [], []
    for _ in range(count):
        kind, personal = rng.choice(EXTRA), rng.random() < 0.45
        lead, body = written(rng, kind, personal)
        fill = lambda: " ".join(rng.choice(PLAIN) for _ in range(rng.randrange(8)))
        head = f"{fill()} {lead.title() if rng.random() < 0.3 else lead}{rng.choice(['', ':', ' at', ' is', ' #' if not personal else ''])} "
        text = head + body + rng.choice([" ", ". ", ", ", "\n"]) + fill()
        start = len(head)
        for span in proposals(text, text.lower()):
            if span[2] in EXTRA:
                rows.append(features(text, span))
                whole = start <= span[0] <= start + 1 and span[1] == start + len(body)
                labels.append(personal and span[2] == kind and whole)
    return np.array(rows, float), np.array(labels, float)


@dataclass
class Model:
    trees: boosting.Trees
    thresholds: dict[str, float]


@lru_cache(maxsize=2)
def learned(count: int = EXAMPLES, precision: float = PRECISION) -> Model:
    """The trees and the thresholds by kind; a kind that never reaches the precision is not reported."""
    x, y = examples(count // 2, 1)
    trees = boosting.fit(x, y)
    x, y = examples(count // 2, 2)
    margin, thresholds = trees.margin(x), {}
    for k, kind in enumerate(EXTRA):
        mine = x[:, 0] == k
        order = np.argsort(-margin[mine])
        sorted_margin, right = margin[mine][order], y[mine][order]
        good = np.flatnonzero(np.cumsum(right) >= precision * np.arange(1, len(right) + 1))
        thresholds[kind] = float(max(0.0, sorted_margin[good[-1]])) if len(good) else float("inf")
    return Model(trees, thresholds)


def open_proposals(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The proposals of a text that no base span overlaps."""
    held = sorted((a, b) for a, b, _ in base)
    starts, ends = [a for a, _ in held], list(accumulate((b for _, b in held), max))
    free = lambda s: not (k := bisect_left(starts, s[1])) or ends[k - 1] <= s[0]
    return [s for s in proposals(text, text.lower()) if free(s)]


def raised(model: Model, judged: list[tuple[str, int, int, int]], precision: float) -> Model:
    """The model with thresholds raised by judged proposals: (kind, step, confirmed, refuted). A kind for which they
    never reach the precision is reported above all that they refute."""
    thresholds = dict(model.thresholds)
    for kind, least in model.thresholds.items():
        right = wrong = 0
        fits = above = None
        for _, step, yes, no in sorted((row for row in judged if row[0] == kind and row[1] / STEPS >= least), key=lambda row: -row[1]):
            above = step + 1 if no and above is None else above
            right, wrong = right + yes, wrong + no
            fits = step if right and right >= precision * (right + wrong) else fits
        if wrong and right < precision * (right + wrong):
            thresholds[kind] = (above if fits is None else fits) / STEPS
    return Model(model.trees, thresholds)


def calibrated(docs: DataFrame, text: str = "text", model: Model | None = None, precision: float = PRECISION) -> Model:
    """The model with its thresholds raised by the proposals of all texts: one pass, one count by kind and step."""
    known = model or learned()
    share = docs.sparkSession.sparkContext.broadcast(known)  # trees of a fixed number and depth

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                spans = open_proposals(t, base_spans(t)) if t else []
                said = [(s, v) for s in spans if (v := verdict(t, s))]
                if not said:
                    continue
                margin = share.value.trees.margin(np.array([features(t, s) for s, _ in said], float))
                steps = np.floor(np.clip(margin, -REACH, REACH) * STEPS).astype(int).tolist()
                for (span, v), step in zip(said, steps):
                    counts.setdefault((span[2], step), [0, 0])[v < 0] += 1
        rows = [(kind, step, yes, no) for (kind, step), (yes, no) in counts.items()]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["kind", "step", "yes", "no"])

    found = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(judge, "kind string, step bigint, yes bigint, no bigint")
    judged = found.groupBy("kind", "step").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    return raised(known, [tuple(r) for r in judged.collect()], precision)  # kinds times steps at most


def extra_spans(texts: list[str], base: list[list[tuple[int, int, str]]], model: Model) -> list[list[tuple[int, int, str]]]:
    """The proposals that the trees select, by text."""
    spans, owner, rows = [], [], []
    for k, text in enumerate(texts):
        for span in open_proposals(text, base[k]):
            spans.append(span)
            owner.append(k)
            rows.append(features(text, span))
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not rows:
        return out
    margin = model.trees.margin(np.array(rows, float))
    taken: list[list[tuple[int, int]]] = [[] for _ in texts]  # by start; they don't overlap
    for i in np.argsort(-margin, kind="stable").tolist():
        (a, b, kind), mine = spans[i], taken[owner[i]]
        k = bisect_left(mine, (b, b))
        if margin[i] >= model.thresholds[kind] and (not k or mine[k - 1][1] <= a):
            mine.insert(k, (a, b))
            out[owner[i]].append(spans[i])
    return out


def personal_spans(text: Column, model: Model) -> Column:
    """All personal data of a text: kind, start and end in code points, by start and then by the order of the kinds."""

    @F.arrow_udf(SPANS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            base = [base_spans(t) for t in texts]
            rows = [sorted(b + e, key=lambda s: (s[0], KINDS.index(s[2]))) for b, e in zip(base, extra_spans(texts, base, model))]
            kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
            yield pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in row] for row in rows], pa.list_(kind))

    return scan(text)


def find_personal_data(docs: DataFrame, text: str = "text", model: Model | None = None, into: str = "personal") -> DataFrame:
    """Adds the array of personal data found in each row's text."""
    return docs.withColumn(into, personal_spans(F.col(text), model or learned()))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by its kind in brackets; null stays null."""

    @F.arrow_udf("string")
    def redact(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, row in zip(texts.to_pylist(), found.to_pylist()):
            if t is not None and row:
                parts, done = [], 0
                for s in row:
                    if s["start"] >= done:
                        parts += [t[done : s["start"]], f"[{s['kind'].upper()}]"]
                    done = max(done, s["end"])
                t = "".join([*parts, t[done:]])
            out.append(t)
        return pa.array(out, pa.string())

    return redact(text, spans)
