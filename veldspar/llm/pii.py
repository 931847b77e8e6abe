"""Personal data by weak supervision.

Fixed patterns give the base spans (email, ip, card, phone), which always stay. Looser patterns give further candidates
(also national numbers, bank accounts, names). Every candidate of every document is voted on by labelers: the strict
pattern, gazetteers, the words before it, its checksum, and its edges. Expectation-maximisation over the counts of
vote patterns of the whole corpus estimates each labeler's reliability for each kind, without labels, and gives every
pattern a probability; on these a final logistic span classifier is trained from shape features and votes. Candidates
that it accepts, and that overlap no base span, are added to the spans.

Texts are scanned once; the candidates go to a table, of which everything after is made. Vote patterns and shapes are small
discrete codes, so what is gathered from the corpus is a table of at most a few thousand counts, however many candidates there are.

Edge cases: null and empty text gives a row with counts of 0 and no spans; ids may be null or repeat, each row is judged
by its text alone; an empty table gives an empty result. Positions are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm.store import cut, short_batches, table

KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "name"]
BASE = KINDS[:4]

# The quantifiers are possessive where giving back can't lead to a match, so that long runs take linear time.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_EMAIL_AT_EDGE = re.compile(r"(?<![A-Za-z0-9._%+-])" + _EMAIL.pattern)
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_IP_AFTER = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Common given names of the four languages, and titles.
NAMES = "James Mary John Linda Robert Susan Michael Sarah David Karen Anna Peter Thomas Julia Hans Ursula Klaus Petra Jürgen Monika Pierre Marie Jean Claire Luc Camille Antoine Sophie Carlos Carmen Antonio Maria Manuel Isabel Javier Lucia".split()
TITLES = "Mr Mrs Ms Dr Herr Frau Señor Señora Madame Monsieur".split()
#: Country codes of phones and top-level domains that gazetteers know.
COUNTRY_CODES = ("1", "33", "34", "39", "41", "43", "44", "49", "52", "61", "81", "86", "91")
TOP_LEVEL = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "eu", "ch", "at"}

_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{1,63})+"),
    "phone": re.compile(r"(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "name": re.compile(rf"\b(?:(?:{'|'.join(TITLES)})\.? [A-ZÀ-Þ][a-zß-ÿ]+|(?:{'|'.join(NAMES)}) [A-ZÀ-Þ][a-zß-ÿ]+)"),
}
_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9]{4})")
_IBAN_GROUP = re.compile(r" ?[A-Z0-9]{4}")
_IBAN_LAST = re.compile(r" ?[A-Z0-9]{1,4}(?![A-Z0-9])")
_IBAN_MORE = re.compile(r"[A-Z0-9]")
_CONTEXT = {
    "email": re.compile(r"mail|contact|write", re.I),
    "ip": re.compile(r"\bip\b|host|server|address", re.I),
    "card": re.compile(r"card|visa|credit|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|tel|call|mobil|fax|ruf", re.I),
    "ssn": re.compile(r"ssn|social|security", re.I),
    "iban": re.compile(r"iban|account|konto|compte|cuenta", re.I),
    "name": re.compile(r"dear|name|signed|hello|sincerely", re.I),
}
_AGAINST = re.compile(r"version|isbn|order|serial|page|chapter|no\.|nr\.|§", re.I)
VOTERS = ["pattern", "gazetteer", "context", "checksum", "edges"]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _byte(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    value = digits.lstrip("0")
    return len(value) <= 3 and int(value or 0) <= 255


def _chained(text: str, first: re.Pattern, after: re.Pattern):
    """Leftmost non-overlapping matches: `after` right where the last match ended, else `first`, which looks behind."""
    at = 0
    while m := (after.match(text, at) if at else None) or first.search(text, at):
        yield m
        at = m.end()


def base_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, valid) of the base patterns; only valid ones count."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end(), True) for m in _chained(text, _EMAIL_AT_EDGE, _EMAIL)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end(), all(_byte(p) for p in m[0].split("."))) for m in _chained(text, _IP, _IP_AFTER)]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) >= 12:
                out.append((m.start(), 2, m.end(), len(digits) <= 19 and luhn(digits)))
        if "+" in text:
            out += [(m.start(), 3, m.end(), 9 <= sum(map(str.isdigit, m[0])) <= 15) for m in _PHONE.finditer(text)]
    return out


def _mod97(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _iban_ends(text: str, start: int) -> list[int]:
    """Where an account number of 15 to 34 characters that starts here may end, last first: after some groups of four, or
    one more group of one to four."""
    ends, at = set(), start + 4
    for length in range(4, 36, 4):
        if 15 <= length <= 34 and not _IBAN_MORE.match(text, at):
            ends.add(at)
        if (last := _IBAN_LAST.match(text, at)) and 15 <= length + len(last[0].strip()) <= 34:
            ends.add(last.end())
        if not (group := _IBAN_GROUP.match(text, at)):
            break
        at = group.end()
    return sorted(ends, reverse=True)


def iban_matches(text: str) -> list[tuple[int, int]]:
    """(start, end) of account numbers. Words in capitals may follow one, so the checksum decides where it ends; where it
    holds nowhere, the last end counts, as long as that overlaps no number for which it holds."""
    found = [(m.start(), _iban_ends(text, m.start())) for m in _IBAN.finditer(text)]
    out: list[tuple[int, int]] = []
    for s, ends in found:
        if not out or s >= out[-1][1]:
            out += [(s, e) for e in ends if _mod97(text[s:e])][:1]
    valid, at = list(out), 0
    begins = [s for s, _ in valid]
    for s, ends in found:
        before = bisect_left(begins, ends[0]) if ends else 0
        if ends and s >= at and not (before and s < valid[before - 1][1]):  # valid ones lie apart, so the last one before it reaches farthest
            out.append((s, ends[0]))
            at = ends[0]
    return sorted(out)


def _votes(text: str, kind: str, start: int, end: int, strict: int) -> tuple[int, ...]:
    """A vote of -1, 0 or 1 from each labeler."""
    value, before = text[start:end], text[max(0, start - 40) : start]
    gazetteer = checksum = 0
    if kind == "email":
        gazetteer = 1 if re.split(r"[.\])]\s?", value)[-1].lower().strip() in TOP_LEVEL else -1
    elif kind == "phone":
        gazetteer = (1 if value[1:].startswith(COUNTRY_CODES) else -1) if value.startswith("+") else 0
        checksum = 1 if len(set(filter(str.isdigit, value))) > 2 else -1
    elif kind == "card":
        digits = re.sub("[^0-9]", "", value)
        gazetteer = 1 if digits[0] in "3456" else -1
        checksum = 1 if luhn(digits) else -1
    elif kind == "ip":
        gazetteer = -1 if value.startswith(("0.", "127.", "255.")) else 0
        checksum = 1 if strict > 0 else -1
    elif kind == "iban":
        checksum = 1 if _mod97(value) else -1
    elif kind == "ssn":
        checksum = -1 if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value[7:] == "0000" else 1
    elif kind == "name":
        gazetteer = 1 if any(w in NAMES for w in value.split()) else 0
    context = 1 if _CONTEXT[kind].search(before) else -1 if _AGAINST.search(before[-15:]) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    edges = -1 if left.isalnum() or right.isalnum() or (left and left in "/=#_") else 1
    return strict, gazetteer, context, checksum, edges


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, tuple[int, ...], bool]]]:
    """(base spans, all candidates as (start, kind, end, code, is_base)); code is kind, votes and shape."""
    matches = base_matches(text)
    base = sorted((s, k, e) for s, k, e, ok in matches if ok)
    found = [(s, k, e, 1 if ok else -1, ok) for s, k, e, ok in matches]
    if len(text) > 8:
        for kind, pattern in _LOOSE.items():
            if kind == "name" or _DIGIT.search(text) or kind == "email" and ("[" in text or "(" in text):
                found += [(m.start(), KINDS.index(kind), m.end(), 0, False) for m in pattern.finditer(text)]
        if _DIGIT.search(text):
            found += [(s, KINDS.index("iban"), e, 0, False) for s, e in iban_matches(text)]
    out = []
    for s, k, e, strict, ok in found:
        shape = (min(e - s, 40) // 8, sum(map(str.isdigit, text[s:e])) * 4 // (e - s))
        out.append((s, k, e, (k, *_votes(text, KINDS[k], s, e, strict), *shape), ok))
    return base, out


def estimate(counts: dict[tuple[int, ...], int], rounds: int = 200) -> dict[tuple[int, ...], float]:
    """EM for each kind: probabilities that a code is personal data, with a prior towards labelers that are mostly right."""
    out: dict[tuple[int, ...], float] = {}
    for kind in range(len(KINDS)):
        codes = [c for c in counts if c[0] == kind]
        if not codes:
            continue
        votes = np.array([c[1 : 1 + len(VOTERS)] for c in codes]) + 1
        n = np.array([counts[c] for c in codes], float)
        p = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(axis=1)))
        for _ in range(rounds):
            prior = ((n * p).sum() + 1) / (n.sum() + 2)
            logit = np.full(len(codes), np.log(prior / (1 - prior)))
            for j in range(len(VOTERS)):
                # pseudo-counts: a labeler says yes to personal data, and no to the rest, more often than not
                yes, no = np.array([1.0, 2.0, 4.0]), np.array([4.0, 2.0, 1.0])
                np.add.at(yes, votes[:, j], n * p)
                np.add.at(no, votes[:, j], n * (1 - p))
                logit += np.log(yes / yes.sum())[votes[:, j]] - np.log(no / no.sum())[votes[:, j]]
            new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            done = np.abs(new - p).max() < 1e-6
            p = new
            if done:
                break
        out |= dict(zip(codes, p.tolist()))
    return out


def _features(code: tuple[int, ...]) -> np.ndarray:
    x = np.zeros(len(KINDS) + len(VOTERS) + 3)
    x[code[0]] = 1
    x[len(KINDS) : len(KINDS) + len(VOTERS)] = code[1 : 1 + len(VOTERS)]
    x[-3:] = code[-2] / 5, code[-1] / 4, (code[-1] / 4) ** 2
    return x


def train(counts: dict[tuple[int, ...], int]) -> np.ndarray:
    """Weights of the final span classifier: ridge logistic regression on the probabilities that EM gave."""
    soft = estimate(counts)
    if not soft:
        return np.zeros(len(KINDS) + len(VOTERS) + 3)
    x = np.array([_features(c) for c in soft])
    y, n = np.array(list(soft.values())), np.sqrt(np.array([counts[c] for c in soft], float))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (y - p)) - w)
    return w


_FOUND = ["s", "k", "e", "code", "base"]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The candidates of each document as parallel arrays: doc_id, s, k, e, code, base. Texts go to Python once, here."""
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]

    def batches(it):
        for b in it:
            columns: list[list] = [[] for _ in kinds]
            for t in b.column(1).to_pylist():
                found = sorted(candidates(t or "")[1])
                for j, column in enumerate(columns):
                    column.append([",".join(map(str, x[3])) if j == 3 else x[j] for x in found])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.list_(t)) for c, t in zip(columns, kinds)]], ["doc_id", *_FOUND])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(batches, "doc_id long, s array<int>, k array<int>, e array<int>, code array<string>, base array<boolean>")


def count_codes(scanned: DataFrame) -> dict[tuple[int, ...], int]:
    """How often each code (votes and shape) occurs among all candidates of all documents."""
    rows = scanned.select(F.explode("code").alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect()
    return {tuple(map(int, r["code"].split(","))): r["n"] for r in sorted(rows)}


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def judge(found: list[tuple[int, int, int, str, bool]], accepted: dict[str, bool], w: np.ndarray) -> tuple[list, list]:
    """(base spans, added spans) of a document's candidates (start, kind, end, code, is_base), in order."""
    base = [(s, k, e) for s, k, e, _, is_base in found if is_base]
    begins, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))  # reach: where the spans up to here end
    added: list[tuple[int, int, int]] = []
    for s, k, e, code, is_base in found:
        before = bisect_left(begins, e)  # base spans that begin before this one ends
        if is_base or before and s < reach[before - 1] or added and s < added[-1][2]:
            continue
        if code not in accepted:
            accepted[code] = bool(_features(tuple(map(int, code.split(",")))) @ w >= 0)
        if accepted[code]:
            added.append((s, k, e))
    return base, added


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, a count for each base kind, base_sha256, spans, n_added."""
    with short_batches(docs.sparkSession):
        scanned = cut(scan(docs, id_col, text_col), "pii-candidates", keep=True)
    w = docs.sparkSession.sparkContext.broadcast(train(count_codes(scanned)))
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, n_added long"
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added"]

    def batches(it):
        accepted: dict[str, bool] = {}
        for b in it:
            out = []
            for i, *arrays in zip(*[b.column(j).to_pylist() for j in range(len(_FOUND) + 1)]):
                base, added = judge(list(zip(*arrays)), accepted, w.value)
                kinds = [k for _, k, _ in base]
                out.append((i, *[kinds.count(k) for k in range(4)], hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(sorted(base + added)), len(added)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names)

    return scanned.select("doc_id", *_FOUND).mapInArrow(batches, schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts of base spans, their digest, and all spans."""
    return find_pii(table(spark, sf_dir, "documents"))
