"""Personal data: base patterns, and candidates that boosted trees choose from.

Base spans (email, ip, card, phone) follow fixed patterns and are always kept. High-recall generators
then propose further, overlapping spans: spelled-out addresses, national phone numbers, IPv6, IBANs and
secrets. Boosted trees see each candidate's format and the words around it; probabilities are calibrated,
and each kind has the lowest threshold that reached TARGET_PRECISION on examples kept apart. Of chosen
candidates that overlap each other the likeliest stays; none may overlap a base span.

The trees are fitted on the driver on examples that a seeded generator writes (EXAMPLES of them, a fixed
number); no text of the corpus is needed for it. Scans are linear in the text: every pattern either
begins only where a run begins or has bounded repeats. Texts without a digit, "@" or a spelled-out "at"
are passed over by one look at the bytes. One pass, no shuffle.

Null and empty texts have no spans. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandweave.llm.boosting import Boosted
from strandweave.llm.common import byte_buffer, documents, slices

KINDS = ["email", "ip", "card", "phone", "iban", "secret"]
EXAMPLES, TARGET_PRECISION = 3000, 0.99

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns: leftmost, not overlapping within a kind, failing matches dropped."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


GENERATORS = [
    ("email", re.compile(r"(?<![\w.])[\w.%+-]{1,64}\x20?[(\[]\x20?at\x20?[)\]]\x20?[\w-]{1,64}(?:\x20?(?:\.|[(\[]\x20?dot\x20?[)\]])\x20?[\w-]{1,64}){1,4}", re.I)),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}(?![0-9A-Fa-f:])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9A-Za-z])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
    ("secret", re.compile(r"(?<![0-9A-Za-z_/+-])[0-9A-Za-z_/+-]{16,512}(?![0-9A-Za-z_/+-])")),
]
CONTEXT = ["token", "key", "secret", "passw", "auth", "tel", "phone", "call", "fax", "mail", "contact", "ip", "host", "addr", "iban", "account", "isbn", "order", "version", "date", "page", "sha", "commit"]


def candidates(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), kind) for kind, pattern in GENERATORS for m in pattern.finditer(text) if kind == "email" or any(c.isdigit() for c in m[0])]


def iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 if s.isalnum() and s.isascii() else False


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    s = text[start:end]
    before, after = text[max(0, start - 24) : start].lower(), text[end : end + 8]
    digits, letters = sum(c.isdigit() for c in s), sum(c.isalpha() for c in s)
    counts = Counter(s)
    groups = re.findall(r"[0-9]+", s)
    plain = s.replace(" ", "").replace("-", "")
    return [
        *[float(kind == k) for k in KINDS],
        len(s), digits, letters, sum(c.isupper() for c in s), digits / len(s),
        -sum(n / len(s) * math.log2(n / len(s)) for n in counts.values()),
        float(all(c in "0123456789abcdefABCDEF" for c in s)), sum(not c.isalnum() for c in s), counts["."], counts["-"], counts[" "], counts["("], counts[":"], counts["/"],
        len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        float(plain.isdigit() and plain.isascii() and 12 <= len(plain) <= 19 and luhn(plain)), float(kind == "iban" and iban_valid(s)),
        float(len(re.findall(r"[a-z](?=[0-9])|[0-9](?=[a-z])", s)) / len(s)),
        float(before.endswith(("=", "= ", ": ", ":", '"', "'"))), float(after[:1] in ('"', "'") if after else 0), float(before[-1:].isalnum()), float(after[:1].isalnum()),
        *[float(w in before) for w in CONTEXT],
    ]


def examples(n: int = EXAMPLES, seed: int = 5) -> list[tuple[str, int]]:
    """Written-out texts and whether the candidate that covers their marked part is personal; marked by two low lines of 0x01."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["an", "er", "in", "the", "on", "lo", "ma", "ti", "re", "su"]) for _ in range(r.randint(1, 4)))
    chars = lambda k, of: "".join(r.choice(of) for _ in range(k))

    def iban() -> str:
        country, body = r.choice(["DE", "FR", "ES", "GB", "NL"]), digits(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return f"{country}{check:02d}{body}"

    def day() -> str:
        return r.choice([f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1900, 2030)}", f"{r.randint(1, 12):02d}/{r.randint(1, 28):02d}/{r.randint(1900, 2030)}", f"{r.randint(1900, 1999)}-{r.randint(2000, 2030)}"])

    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    yes = [
        lambda: ("", f"{word()}.{word()} {r.choice(['(at)', '[at]'])} {word()}{r.choice(['.', ' (dot) ', ' [dot] '])}{r.choice(['com', 'org', 'net', 'de'])}", ""),
        lambda: ("", f"({digits(3)}) {digits(3)}-{digits(4)}", ""), lambda: (r.choice(["call ", "tel: ", "phone ", "fax "]), f"{digits(3)}-{digits(3)}-{digits(4)}", ""),
        lambda: (r.choice(["tel. ", "phone: ", ""]), f"0{digits(2)} {digits(4)} {digits(4)}", ""),
        lambda: ("", ":".join(chars(4, "0123456789abcdef") for _ in range(8)), ""), lambda: (r.choice(["host ", "ip "]), f"fe80::{chars(4, '0123456789abcdef')}:{chars(4, '0123456789abcdef')}:{chars(3, '0123456789abcdef')}", ""),
        lambda: (r.choice(["iban ", "account: ", ""]), iban(), ""),
        lambda: (f"{r.choice(['token', 'api_key', 'secret', 'password', 'auth'])}{r.choice([' = ', '=', ': '])}\"", chars(r.randint(20, 48), r.choice(["0123456789abcdef", b62])), '"'),
        lambda: (f"{r.choice(['token', 'key', 'secret', 'passwd'])}{r.choice([' ', '=', ': '])}", chars(r.randint(20, 48), r.choice(["0123456789abcdef", b62])), ""),
    ]
    no = [
        lambda: (r.choice(["on ", "date ", ""]), day(), ""), lambda: ("version ", f"{r.randint(0, 30)}.{digits(2)}.{digits(2)}", ""),
        lambda: (r.choice(["order ", "page ", "isbn "]), f"{digits(3)}-{digits(2)}-{digits(5)}-{digits(3)}-{digits(2)}", ""), lambda: ("", f"{digits(2)} {digits(2)}", ""), lambda: ("", f"{digits(3)} {digits(3)} {digits(3)}", ""),
        lambda: ("", f"{digits(2)}:{digits(2)}:{digits(2)}", ""), lambda: ("commit ", chars(40, "0123456789abcdef"), ""), lambda: ("sha ", chars(32, "0123456789abcdef"), ""),
        lambda: ("", f"{word()}{word()}{word()}{word()}{digits(1)}{word()}{word()}{word()}", ""), lambda: ("", digits(r.randint(16, 20)), ""), lambda: ("", f"{word()}-{word()}-{word()}-{word()}-{digits(2)}", ""),
        lambda: ("", f"{chars(2, 'ABCDEFG')}{digits(2)} {chars(4, 'ABCDEFG0123')} {chars(4, 'ABCDEFG0123')}", ""), lambda: ("", f"{word()}/{word()}/{word()}/{word()}{digits(3)}", ""), lambda: ("", f"{digits(4)}-{digits(4)}", ""),
    ]
    out = []
    for i in range(n):
        label = i % 2
        pre, body, post = r.choice(yes if label else no)()
        out.append((f"{word()} {word()} {pre}\1{body}\1{post} {word()}, {word()}", label))
    return out


class Taken:
    """Places of a text that spans cover, as sorted disjoint intervals: tests and additions by bisection."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self.ends, start)
        return i == len(self.starts) or self.starts[i] >= end

    def add(self, start: int, end: int) -> None:
        i = bisect.bisect_left(self.ends, start)
        j = bisect.bisect_right(self.starts, end)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]


class Detector:
    def __init__(self):
        x, y, kinds = [], [], []
        for marked, label in examples():
            a = marked.index("\1")
            b = marked.index("\1", a + 1) - 1
            text = marked.replace("\1", "")
            for s, e, kind in candidates(text):
                if s < b and e > a:
                    x.append(features(text, s, e, kind))
                    y.append(label if (s, e) == (a, b) else 0)
                    kinds.append(kind)
        x, y, kinds = np.array(x), np.array(y, float), np.array(kinds)
        apart = np.arange(len(y)) % 3 == 2
        self.model = Boosted(x[~apart], y[~apart])
        self.model.calibrate(x[apart], y[apart])
        p = self.model.probability(x[apart])
        self.threshold = {}
        for kind in dict.fromkeys(k for k, _ in GENERATORS):
            on = kinds[apart] == kind
            order = np.argsort(-p[on], kind="stable")
            right = np.cumsum(y[apart][on][order]) / (np.arange(on.sum()) + 1)
            good = np.flatnonzero(right >= TARGET_PRECISION)
            self.threshold[kind] = max(0.5, float(p[on][order][good[-1]])) if len(good) else 2.0

    def spans(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Base spans, and base and chosen spans together."""
        base = base_spans(text)
        taken = Taken()
        for s, e, _ in base:
            taken.add(s, e)
        found = [c for c in candidates(text) if taken.free(c[0], c[1])]
        if not found:
            return base, base
        p = self.model.probability(np.array([features(text, *c) for c in found]))
        chosen: list[tuple[int, int, str]] = []
        for i in np.argsort(-p, kind="stable"):
            s, e, kind = found[i]
            if p[i] >= self.threshold[kind] and taken.free(s, e):
                chosen.append(found[i])
                taken.add(s, e)
        return base, sorted(base + chosen, key=lambda s: (s[0], KINDS.index(s[2])))


@lru_cache(maxsize=1)
def detector() -> Detector:
    return Detector()


SIGN = np.zeros(256, np.int64)
SIGN[[*range(0x30, 0x3A), ord("@"), ord("("), ord("[")]] = 1


def found_in(column, d: Detector) -> Iterator[tuple[str, list, list]]:
    data, off = byte_buffer(column)
    seen = np.concatenate([[0], np.cumsum(SIGN[data])])
    for text, n in zip(column.to_pylist(), (seen[off[1:]] - seen[off[:-1]]).tolist(), strict=True):
        yield (text or "", *(d.spans(text) if n else ([], [])))


def written_out(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and all spans."""
    d = detector()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = [([sum(k == kind for _, _, k in base) for kind in KINDS[:4]], hashlib.sha256(written_out(base).encode()).hexdigest(), written_out(every)) for _, base, every in found_in(b.column("text"), d)]
            counts = [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with every span replaced by its kind in brackets."""
    d = detector()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = [redacted(t, spans) if spans else t for t, _, spans in found_in(b.column("text"), d)]
            new = pa.array([None if not v else t for t, v in zip(texts, b.column("text").is_valid().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if n == "text" else c for n, c in zip(b.schema.names, b.columns, strict=True)], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op4_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir))
