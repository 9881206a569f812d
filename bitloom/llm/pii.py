"""Personal data: generators propose overlapping spans, boosted trees score them, calibrated thresholds choose.

Base kinds (email, ip, card, phone) are fixed by their patterns and always stay; the trees decide on the further kinds
(secret, iban, national_id, mac, ipv6, phone_local, card_loose, email_spelled). No labelled spans exist, so the trees
are fitted on TRAINING_ROWS made-up contexts of true and false spans from a fixed seed. Either stands beside cues of its
kind, beside other cues, or beside none, so that form and check digits weigh by themselves; where form decides nothing (a
bare hash, say), labels disagree and scores stay low. A quarter of the contexts is held out, to calibrate the output and
to set for each kind the least threshold from which on at least PRECISION of its held-out spans are true.

Defined results: a null text is empty and has no spans. Spans are in code points, the end exclusive. Every row is judged
by itself, so ties, repeated rows and empty tables are no matter; a text of any length is searched whole, in linear time.
All columns pass through, whatever their names; the new one is renamed where it clashes.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.llm.common import ship, table
from bitloom.llm.gradient_boosting import Boosted

BASE_KINDS = ("email", "ip", "card", "phone")
TRAINING_ROWS, PRECISION, SEED, CONTEXT = 6000, 0.97, 11, 40

# Each pattern finds what the plain one of the contract finds, in linear time: a run of digits that fails at its first
# digit fails at every other one.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_AT, _DOT = re.compile(r" at |[(\[]at[)\]]"), re.compile(r" dot |[(\[]dot[)\]]")

#: Generators of the further kinds: wide nets, which may overlap each other and the base spans.
GENERATORS = {
    "secret": re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8}\b"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"),
    "mac": re.compile(r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])"),
    "ipv6": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "phone_local": re.compile(r"(?<![0-9+().-])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}(?![0-9.-])"),
    "card_loose": re.compile(r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{1,7}(?![0-9])"),
    "email_spelled": re.compile(r"\b[a-z0-9._-]{2,30}+ ?(?:\(at\)|\[at\]| at ) ?[a-z0-9-]{2,30} ?(?:\(dot\)|\[dot\]| dot ) ?[a-z]{2,10}\b"),
}
#: Kinds that may hold neither a digit nor an at sign: they are looked for in every text.
_LETTERS_DO = frozenset(("secret", "mac", "ipv6"))
CUES = {
    "secret": ("token", "secret", "key", "password", "passwd", "pwd", "bearer", "credential"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "handy", "móvil"),
    "card": ("card", "visa", "mastercard", "karte", "carte", "tarjeta", "payment"),
    "bank": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "person": ("ssn", "social", "security", "passport", "id ", "born"),
    "host": ("mac", "host", "address", "ip", "device"),
    "mail": ("mail", "contact", "write"),
    "number": ("order", "invoice", "version", "isbn", "part", "serial", "sku", "ref", "page", "sha", "commit", "checksum", "md5", "doi", "price"),
}
#: A cue begins a word.
_CUES = {kind: re.compile("(?<![^\\W_])(?:" + "|".join(map(re.escape, words)) + ")") for kind, words in CUES.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start, then kind as listed."""
    out = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 and not p[:-3].strip("0") for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda x: (x[0], BASE_KINDS.index(x[2])))


def candidates(text: str) -> list[tuple[int, int, str]]:
    spelled, written = _AT.search(text) and _DOT.search(text), _ANY.search(text)
    found = []
    for kind, pattern in GENERATORS.items():
        if kind not in _LETTERS_DO and not (spelled if kind == "email_spelled" else written):
            continue
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    return found


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return len(s) > 8 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


_GROUP, _WORDY = re.compile("[0-9]+"), re.compile("[A-Za-z]{4,}")
_TURN = re.compile("[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z]")


def _day(groups: list[str]) -> bool:
    """Whether the first three groups of digits read as a date."""
    if len(groups) < 3:
        return False
    x, y, z = (int(g) for g in groups[:3])
    year = lambda g, n: len(g) in (2, 4) and (len(g) == 2 or 1500 <= n <= 2100)
    return 1 <= y <= 31 and (year(groups[0], x) and 1 <= z <= 31 or year(groups[2], z) and 1 <= x <= 31) and min(x, y, z) <= 12


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT // 2]
    digits = "".join(c for c in span if "0" <= c <= "9")
    letters, n, close, near = [c for c in span if c.isalpha()], end - start, before.lower(), after.lower()
    counts, groups = np.unique(list(span), return_counts=True)[1] / n, _GROUP.findall(span)
    sizes = [len(g) for g in groups]
    out = [
        n, len(digits) / n, len(letters) / n, len(set(span)) / min(n, 40), float(-(counts * np.log2(counts)).sum()),
        sum(c in " .-:()" for c in span), sum(c.isupper() for c in letters) / max(1, len(letters)),
        float(all(c in "0123456789abcdefABCDEF" for c in span)), float(all(c.isalpha() for c in span)), len(digits),
        float(len(digits) >= 12 and luhn(digits)), float(kind == "iban" and _mod97(span)), float(digits[:1] in ("3", "4", "5", "6")),
        float(kind == "national_id" and len(groups) == 3 and groups[0] not in ("000", "666") and groups[0][0] != "9" and groups[1] != "00" and groups[2] != "0000"),
        float(_day(groups)), float(len(groups)), float(max(sizes, default=0)), float(sizes[-1] if sizes else 0), float(sizes[:2] == [3, 3]), float(len(set(sizes)) == 1),
        float(len({c for c in span if not c.isalnum()}) > 1), float("(" in span), float(span.islower()), float(len(_TURN.findall(span))),
        float(before[-1:] in ('"', "'", "=", ":")), float("=" in before[-4:] or ":" in before[-3:]), float(before[-1:].isalnum()),
        float(before[-1:] in "$€£#v" and before != ""), float(after[:1].isalnum()), float("/" in span), float(len(_WORDY.findall(span))),
        sum("0" <= c <= "9" for c in before), sum("0" <= c <= "9" for c in after),
    ]
    out += [float(bool(c.search(close))) for c in _CUES.values()] + [float(bool(c.search(near))) for c in _CUES.values()]
    return out + [float(kind == k) for k in GENERATORS]


#: The cue of each kind, and how a true span's form alone reads: 1 says that form decides, 0.5 that it says nothing.
_OWN_CUE = {"secret": "secret", "iban": "bank", "national_id": "person", "mac": "host", "ipv6": "host", "phone_local": "phone", "card_loose": "card", "email_spelled": "mail"}
_BARE = {"secret": 1.0, "iban": 1.0, "national_id": 1.0, "mac": 1.0, "ipv6": 1.0, "phone_local": 1.0, "card_loose": 1.0, "email_spelled": 1.0}


def _true_span(kind: str, r: random.Random, digits, word, mixed, hexa) -> str:
    split = lambda x, sep: sep.join(x[i : i + 4] for i in range(0, len(x), 4))
    if kind == "secret":
        return r.choice((hexa(40), hexa(32), hexa(64), mixed(r.randint(24, 60)), mixed(r.randint(30, 44)), r.choice(("sk", "ghp", "AKIA", "xoxb")) + r.choice("_-") + mixed(r.randint(20, 40))))
    if kind == "iban":
        body, country = digits(r.choice((16, 18, 20))), r.choice(("DE", "FR", "ES", "GB", "IT"))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return r.choice((str, lambda x: split(x, " ")))(f"{country}{check:02d}{body}")
    if kind == "national_id":
        return f"{r.choice([n for n in range(1, 900) if n != 666]):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
    if kind == "mac":
        return r.choice(":-").join(hexa(2) for _ in range(6))
    if kind == "ipv6":
        return r.choice((":".join(hexa(4) for _ in range(8)), ":".join(hexa(r.randint(1, 4)) for _ in range(8)), ":".join(hexa(4) for _ in range(5)) + "::" + hexa(2)))
    if kind == "phone_local":
        return r.choice((f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(3)} {digits(3)} {digits(4)}", f"0{r.randint(1, 9)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}"))
    if kind == "card_loose":
        body = r.choice("3456") + digits(14)
        number = body + next(c for c in "0123456789" if luhn(body + c))
        return r.choice((str, str, lambda x: split(x, r.choice(" .-"))))(number)
    at, dot = r.choice((("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot ")))
    return f"{word()}{r.choice('._') if r.random() < 0.5 else ''}{word()}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr', 'es'))}"


def _false_span(kind: str, r: random.Random, digits, word, mixed, hexa) -> str:
    many = lambda sep, k: sep.join(word() for _ in range(k))
    if kind == "secret":
        joined = r.choice("-_/").join(r.choice((word(), word(), digits(r.randint(1, 4)), word().title())) for _ in range(r.randint(6, 12)))
        camel = "".join(word().title() for _ in range(8)) + digits(1)
        path = "/".join(many("-", r.randint(1, 4)) for _ in range(r.randint(3, 6)))
        return r.choice((joined, joined, path, path, camel, "-" * r.randint(20, 60), "=" * r.randint(20, 60), many("_", 8), many("", 9), many("/", 8), many("-", 7), mixed(1) * 30, digits(24)))
    if kind == "iban":
        body, country = digits(r.choice((16, 18, 20))), r.choice(("DE", "FR", "ES", "GB", "IT"))
        check = (98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97 + r.randint(1, 95)) % 97
        return f"{country}{check:02d}{body}"
    if kind == "national_id":
        return r.choice((f"{r.choice(('000', '666', '9' + digits(2)))}-{digits(2)}-{digits(4)}", f"{digits(3)}-00-{digits(4)}", f"{digits(3)}-{digits(2)}-0000"))
    if kind == "mac":
        return r.choice(":-").join(f"{r.randint(0, 59):02d}" for _ in range(6))
    if kind == "ipv6":
        return ":".join(f"{r.randint(0, 59):02d}" for _ in range(r.randint(5, 8)))
    if kind == "phone_local":
        year = str(r.randint(1900, 2040))
        day = (f"{r.randint(1, 28):02d}", f"{r.randint(1, 12):02d}", year)
        groups = r.choice(" .-").join(digits(r.randint(2, 4)) for _ in range(r.randint(3, 5)))
        hour = r.choice(("", " " + digits(2), f" {digits(2)} {digits(2)}"))
        return r.choice((r.choice(".-").join(day) + hour, r.choice("-. ").join(day[::-1]) + hour, f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(2)} {digits(2)} {digits(2)}", groups))
    if kind == "card_loose":
        body = digits(r.choice((12, 13, 14, 15, 15, 15, 16)))
        number = body + next(c for c in r.sample("0123456789", 10) if not luhn(body + c))
        return r.choice((number, number, " ".join(number[i : i + 4] for i in range(0, len(number), 4))))
    return f"{word()} at {word()} dot {word()}"


def _example(r: random.Random) -> tuple[str, int, int, str, int]:
    """A made-up text, a span in it, its kind and whether it is personal."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(("th", "er", "in", "on", "re", "an", "ou", "sch", "te", "la", "mo")) for _ in range(r.randint(1, 4)))
    mixed = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    kind, form = r.choice(list(GENERATORS)), r.random() < 0.55
    span = (_true_span if form else _false_span)(kind, r, digits, word, mixed, hexa)
    cue = r.choices(("own", "number", "other", "none"), (0.35, 0.2, 0.1, 0.35))[0]
    true = form and (cue == "own" or r.random() < _BARE[kind])
    if form and cue == "number":  # "order 4111 ...": what a number belongs to says more than its form
        true = kind in ("mac", "ipv6", "email_spelled", "iban", "card_loose") or r.random() < 0.05
    lead = {"own": _OWN_CUE[kind], "number": "number", "other": r.choice([c for c in CUES if c not in (_OWN_CUE[kind], "number")])}.get(cue)
    said = r.choice(CUES[lead]) + r.choice((" ", ": ", " = ", '="', " is ", ' "')) if lead else ""
    own = f"{word()} {word()} "
    if lead and r.random() < 0.15:  # the cue after the span
        text, tail = own, f" ({r.choice(CUES[lead])})"
    else:
        text, tail = own + said, ""
    start = len(text)
    text += span + tail + r.choice(('"', " ", ".", ",", "")) + f" {word()} {word()}"
    if r.random() < 0.2:  # something of its like beside it
        text = text[: start + len(span)] + " " + span + text[start + len(span) :]
    return text, start, start + len(span), kind, int(true)


@lru_cache(maxsize=1)
def fitted() -> tuple[Boosted, dict[str, float]]:
    """The trees and each kind's threshold; the same on every machine and run."""
    r = random.Random(SEED)
    made = [_example(r) for _ in range(TRAINING_ROWS)]
    x = np.array([features(t, s, e, k) for t, s, e, k, _ in made])
    y = np.array([m[-1] for m in made], float)
    held = np.arange(len(y)) % 4 == 0
    model = Boosted(depth=4, rounds=90).fit(x[~held], y[~held]).calibrate(x[held], y[held])
    p, kinds = model.probability(x[held]), np.array([m[3] for m in made])[held]
    limits = {}
    for kind in GENERATORS:
        q, t = p[kinds == kind], y[held][kinds == kind]
        good = [c for c in np.arange(0.3, 1, 0.01) if (q >= c).any() and t[q >= c].mean() >= PRECISION]
        limits[kind] = float(good[0]) if good else 1.01
    return model, limits


def spans(text: str | None, model: Boosted, limits: dict[str, float]) -> list[dict]:
    """The base spans, and of the other candidates those that pass; of overlapping ones the likeliest, none over a base span."""
    if not text:
        return []
    base = base_spans(text) if _ANY.search(text) else []
    out = [{"kind": k, "start": s, "end": e, "score": 1.0, "base": True} for s, e, k in base]
    proposed = candidates(text)
    if proposed:
        scores = model.probability(np.array([features(text, *c) for c in proposed]))
        taken = [(s, e) for s, e, _ in base]
        for p, (s, e, k) in sorted(zip(scores, proposed), key=lambda x: (-x[0], x[1])):
            if p >= limits[k] and all(e <= a or b <= s for a, b in taken):
                taken.append((s, e))
                out.append({"kind": k, "start": s, "end": e, "score": float(p), "base": False})
    order = {k: i for i, k in enumerate((*BASE_KINDS, *GENERATORS))}
    return sorted(out, key=lambda x: (x["start"], order[x["kind"]]))


def redacted(text: str | None, found: list[dict]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans go as one, named by the first."""
    out, at = [], 0
    for x in found:
        if x["start"] >= at:
            out += [text[at : x["start"]], f"[{x['kind'].upper()}]"]
        at = max(at, x["end"])
    return "".join(out) + text[at:] if found else text


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])
_SPARK_SPAN = T.ArrayType(
    T.StructType([T.StructField(n, t) for n, t in (("kind", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("score", T.DoubleType()), ("base", T.BooleanType()))])
)


def _finder(at: int, model: Boosted, limits: dict, name: str, redact: bool):
    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [spans(t, model, limits) for t in texts]
            if redact:
                new = pa.array([redacted(t, f) for t, f in zip(texts, found)], batch.column(at).type)
                yield batch.set_column(at, batch.schema.field(at).name, new)
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(_SPAN))], [*batch.schema.names, name])

    return run


def find(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """docs with one more column: the spans of the whole text (underscores are added to a name that docs has)."""
    ship(docs.sparkSession)
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    schema = T.StructType([*docs.schema.fields, T.StructField(name, _SPARK_SPAN)])
    return docs.mapInArrow(_finder(docs.columns.index(text), *fitted(), name, False), schema)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets."""
    ship(docs.sparkSession)
    return docs.mapInArrow(_finder(docs.columns.index(text), *fitted(), "", True), docs.schema)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda xs: F.concat_ws(",", F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
