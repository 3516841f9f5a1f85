"""Personal data by weak supervision.

Strict patterns give base spans. They and looser candidates are voted on by labelers: the pattern's own check, gazetteers
(mail domains, dialling and issuer prefixes) and the words before. Expectation-maximisation over the histogram of votes
estimates how reliable each labeler is and how likely each vote pattern means personal data. These soft labels
train a logistic span classifier per kind on the span's features, which decides on the looser candidates; base spans stay.

Votes and features take few values, so their histogram (not the spans) meets on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9][0-9.]*")
_MAIL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-@")
#: Looser candidates.
_HIDDEN_MAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._+-]{0,63} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?|\.)[A-Za-z]{2,24}", re.I)
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SIX = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
#: Fixed values of the gazetteers: mail domains end so, dialling codes and card issuers begin so.
DOMAINS = (".com", ".org", ".net", ".edu", ".gov", ".de", ".fr", ".es", ".io", ".uk", ".eu")
DIALLING = ("+1", "+33", "+34", "+44", "+49", "+39", "+7", "+86", "+91")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35")
#: Fixed values of the context labeler: words that announce a kind.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "servidor", "serveur", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
}
_BEFORE = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
LABELERS, FEATURES = 3, 6


def luhn(digits: str) -> bool:
    double = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(double)) % 10 == 0


def _mail_runs(text: str) -> Iterator[tuple[int, str]]:
    """Longest runs of mail characters around each @, so that the pattern is never tried elsewhere."""
    at, end = text.find("@"), 0
    while at >= 0:
        lo, hi = at, at + 1
        while lo > end and text[lo - 1] in _MAIL_CHARS:
            lo -= 1
        while hi < len(text) and text[hi] in _MAIL_CHARS:
            hi += 1
        yield lo, text[lo:hi]
        end = hi
        at = text.find("@", hi)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict patterns, leftmost and without overlap per kind, in code points."""
    out = []
    for lo, run in _mail_runs(text):
        out += [(0, lo + m.start(), lo + m.end()) for m in EMAIL.finditer(run)]
    for run in _RUN.finditer(text):
        if run.group().count(".") >= 3:
            out += [(1, run.start() + m.start(), run.start() + m.end()) for m in IP.finditer(run.group())
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates beside the base spans, none overlapping one."""
    out = []
    if "at]" in text or "at)" in text or "AT]" in text or "AT)" in text:
        out += [(0, m.start(), m.end()) for m in _HIDDEN_MAIL.finditer(text)]
    if text.count(":") >= 7:
        out += [(1, m.start(), m.end()) for m in _SIX.finditer(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= sum(c.isdigit() for c in m.group()) <= 19:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    free = []
    for k, s, e in out:
        i = int(np.searchsorted(starts, e)) if starts else 0
        if not any(b > s for _, b in taken[max(0, i - 3):i]):
            free.append((k, s, e))
    return free


def _code(text: str, span: tuple[int, int, int], strict: bool) -> int:
    """Votes (0 against, 1 none, 2 for; by pattern, gazetteer, context) and feature bits of a span, as one number."""
    kind, start, end = span
    body = text[start:end]
    digits = "".join(c for c in body if c.isdigit())
    name = KINDS[kind]
    before = [w.lower() for w in _BEFORE.findall(text[max(0, start - 40):start])[-3:]]
    context = any(w in CONTEXT[name] for w in before)
    known = (body.lower().endswith(DOMAINS), True, digits.startswith(ISSUERS), body.startswith(DIALLING) or body.startswith("("))[kind]
    others = any(w in words for k, words in CONTEXT.items() if k != name for w in before)
    votes = (2 if strict else (0 if kind == 2 else 1), 2 if known else 0, 2 if context else (0 if others else 1))
    edges = (text[start - 1:start].isspace() or start == 0) and (end == len(text) or not text[end].isalnum())
    features = (strict, known, context, edges, any(c in " -()." for c in body), len(set(digits)) > 3 or kind == 0)
    number = 0
    for v in votes:
        number = number * 3 + v
    for f in features:
        number = number * 2 + bool(f)
    return number


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): base spans and all candidates as (kind, start, end, code, strict), written once."""
    shape = "array<struct<kind:int,start:int,end:int,code:int,strict:boolean>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                text = text or ""
                base = base_spans(text)
                spans = [(*s, _code(text, s, True), True) for s in base] + [(*s, _code(text, s, False), False) for s in loose_spans(text, base)]
                rows.append(sorted(spans))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "spans": [[dict(zip(("kind", "start", "end", "code", "strict"), s, strict=True)) for s in r] for r in rows]})

    return cut_lineage(docs.select("doc_id", "text").mapInPandas(run, f"doc_id long, spans {shape}"))


def _split(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = np.stack([(code >> (FEATURES - 1 - i)) & 1 for i in range(FEATURES)], 1)
    votes = code >> FEATURES
    return np.stack([votes // 3 ** (LABELERS - 1 - i) % 3 for i in range(LABELERS)], 1), bits


def reliabilities(votes: np.ndarray, n: np.ndarray, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns with counts: P(real) per pattern, P(vote | real or not) per labeler."""
    p = np.array([[[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]]] * votes.shape[1])  # labeler, truth, vote
    prior = 0.5
    real = np.full(len(n), 0.5)
    for _ in range(steps):
        like = np.stack([np.prod([p[j, z, votes[:, j]] for j in range(votes.shape[1])], axis=0) for z in (0, 1)], 1) * [1 - prior, prior]
        real = like[:, 1] / like.sum(1)
        prior = ((real * n).sum() + 1) / (n.sum() + 2)
        for j in range(votes.shape[1]):
            for z, weight in ((0, 1 - real), (1, real)):
                share = np.bincount(votes[:, j], weights=weight * n, minlength=3) + (0.6, 0.3, 0.1) if z == 0 else np.bincount(votes[:, j], weights=weight * n, minlength=3) + (0.1, 0.3, 0.6)
                p[j, z] = share / share.sum()
    return real, p


def classifier(bits: np.ndarray, real: np.ndarray, n: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression on feature bits with soft labels; returns P(real) per row."""
    x = np.hstack([bits, np.ones((len(bits), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (n * np.maximum(s * (1 - s), 1e-6))[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (s - real)) + w)
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def accepted(found: DataFrame) -> list[int]:
    """kind * 2^16 + code of the candidates that the trained classifiers accept."""
    seen = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.code").count().collect()  # at most kinds * 3^3 * 2^6 rows
    out = []
    for kind in range(len(KINDS)):
        rows = sorted((r["code"], r["count"]) for r in seen if r["kind"] == kind)
        if rows:
            code, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
            votes, bits = _split(code)
            real, _ = reliabilities(votes, n)
            out += [kind * 65536 + int(c) for c, p in zip(code, classifier(bits, real, n), strict=True) if p >= 0.5]
    return out


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans per kind, base_sha256 and all spans as kind:start:end.

    A null text counts as empty: no spans, the hash of the empty string. Repeated rows give equal rows; an empty table gives
    none; other columns are ignored.
    """
    found = candidates(docs)
    allowed = F.array(*[F.lit(c) for c in accepted(found)]).cast("array<int>")
    kept = F.filter("spans", lambda s: s["strict"] | F.array_contains(allowed, s["kind"] * 65536 + s["code"]))
    base = F.filter("spans", lambda s: s["strict"])
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda i: F.size(F.filter("spans", lambda s: s["strict"] & (s["kind"] == i))).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(text(base), 256).alias("base_sha256"), text(kept).alias("spans"))
