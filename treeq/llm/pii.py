"""Personal data: base patterns that always count, and candidates that boosted trees choose from.

Generators with high recall propose spans that may overlap: written-out addresses ("ann (at) mail dot com"), and of runs of
digits every part of whole groups that has as many digits as a number of some kind, so that of numbers side by side each is proposed.
Boosted trees score each by its format and its context; a threshold per kind, calibrated for precision on documents that were not
fitted, selects; of selected spans that overlap, the best-scored stays. A base span is never dropped, and no added span overlaps one.

What is fitted on comes from the documents themselves, from a bounded number of them: base spans (as they stand, and rewritten
in the formats that the base patterns don't know, alone and side by side) and look-alikes (numbers that fail the base tests, as they stand and
rewritten likewise), all in places where documents have such spans. A third of these documents is held out for the thresholds.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import Boost
from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the base pattern, from each @ outwards: linear in the text, however long its words are."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping per kind; those that fail a test are dropped."""
    found = [("email", *s) for s in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


AT = re.compile(r"(?i)\s?[(\[{<]\s?at\s?[)\]}>]\s?|\s(?:at|@)\s|\s?\(@\)\s?|\s@|@\s")
DOT = re.compile(r"(?i)\s?[(\[{<]\s?(?:dot|\.)\s?[)\]}>]\s?|\sdot\s|\.")
LABEL = re.compile(r"[A-Za-z0-9-]+")
RUN = re.compile(r"(?<![0-9A-Za-z])[+(\[]?[0-9](?:[\x20().\-/\[\] ‐-–]{0,3}[0-9])+")
GROUP = re.compile("[0-9]+")
#: Characters of a domain name at most (RFC 1035), and those of a span, from its end, that its format is read from: so many labels, written out, and more.
NAME, FORMAT = 253, 2048
#: Groups of digits that a span of digits leaves outside, right beside it.
LEFT_OF, RIGHT_OF = re.compile(r"([0-9]+)([\x20().\-/\[\] ‐-–]{1,3})\Z"), re.compile(r"([\x20().\-/\[\] ‐-–]{1,3})([0-9]+)")
MARK = re.compile(r"(?i)[(\[{<]\s?dot|\sdot\s|[(\[{<]\s?at\s?[)\]}>]|@")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans of every kind; they may overlap, and most are nothing."""
    out = []
    if MARK.search(text):
        last = 0
        for m in AT.finditer(text):
            left = m.start()
            while left > last and text[left - 1] in LOCAL:
                left -= 1
            last = m.end()  # what is left of the next mark begins behind this one
            right, end, labels, name = LABEL.match(text, m.end()), 0, 0, -1
            while right and left < m.start():
                end, labels, name = right.end(), labels + 1, name + 1 + right.end() - right.start()
                if name > NAME:  # no name goes on so far
                    break
                d = DOT.match(text, end)
                right = LABEL.match(text, d.end()) if d else None
                if labels >= 2:
                    out.append(("email", left, end))
    if DIGIT.search(text):
        for m in RUN.finditer(text):
            groups = [g.span() for g in GROUP.finditer(text, *m.span())]
            for i, (start, _) in enumerate(groups):
                start -= start > m.start() and text[start - 1] in "+(["
                n = 0
                for j in range(i, len(groups)):  # 20 at most: a number has 19 digits
                    n += groups[j][1] - groups[j][0]
                    if n > 19:
                        break
                    end = groups[j][1]
                    if 4 <= n <= 12 and j - i == 3:
                        out.append(("ip", start, end))
                    if 15 <= n <= 19:
                        out.append(("card", start, end))
                    if 7 <= n <= 15:
                        out.append(("phone", start, end))
    return out


#: Top-level names that a last label is compared with; a feature, no rule.
TLDS = frozenset("com org net edu gov io de fr es uk info biz eu co us".split())


def _near(text: str, start: int, end: int) -> list[str]:
    """Words beside a span: the last four before it and the first two behind it."""
    before, after = text[max(0, start - 32) : start].lower(), text[end : end + 24].lower()
    return re.findall(r"[^\W\d_]+", before)[-4:] + re.findall(r"[^\W\d_]+", after)[:2]


def features(text: str, kind: str, start: int, end: int, cues: dict[str, dict[str, float]]) -> list[float]:
    """Format and context of a span; `cues` holds how much a word speaks for a kind."""
    span, before, after = text[max(start, end - FORMAT) : end], text[max(0, start - 32) : start].lower(), text[end : end + 24].lower()
    digits, groups = _digits(span), re.findall("[0-9]+", span)
    tail = re.findall("[A-Za-z0-9-]+", span)[-1:] or [""]
    inner = re.findall(r"(?<=[0-9])[^0-9A-Za-z]+(?=[0-9])", span) if kind != "email" else []
    left, right = (LEFT_OF.search(text[max(0, start - 24) : start]), RIGHT_OF.match(text, end)) if kind != "email" else (None, None)
    gaps = [m[k] if m else "" for m, k in ((left, 2), (right, 1))]
    lens = [*map(len, groups[:4]), 0, 0, 0, 0][:4]
    own = cues.get(kind, {})
    said = [own.get(w, 0.0) for w in _near(text, start, end)]
    return [
        float(bool(left) and "+" in text[max(0, start - 6) : start]), float(len(set(map(len, groups))) == 1),
        # beside it: digits, a gap as within it, a blank, how long; within it: unlike gaps, lengths of groups
        *(x for m, gap, k in ((left, gaps[0], 1), (right, gaps[1], 2)) for x in (float(len(m[k]) if m else 0), float(bool(gap) and gap in inner), float(" " in gap), float(len(gap)))),
        float(len(set(inner))), float(sum(" " in g for g in inner)), float(max(map(len, inner), default=0)), *map(float, lens), float(len(groups[-1]) if groups else 0),
        float(lens[:3] == [3, 3, 4] and len(groups) == 3), float(len(groups) == 3 and lens[0] == 4 and lens[1] <= 2 and lens[2] <= 2),
        *(float(kind == k) for k in KINDS), float(end - start), float(len(digits)), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(sum(map(span.count, ".[]"))), float(span.count("-")), float(sum(map(span.count, "  "))), float(span.count("/")), float(span[:1] in "+("), float(sum(map(span.count, "()"))),
        float(len(digits) > 14 and luhn(digits)), float(len(groups) == 4 and all(_byte(g) for g in groups)), float(tail[0].lower() in TLDS), float(bool(re.search(r"[(\[{<]\s?(at|@)", span, re.I))), float(bool(re.search(r"[(\[{<]\s?dot|\sdot\s", span, re.I))),
        max(said, default=0.0), min(said, default=0.0), float(before[-1:].isalnum() or before[-1:] in (".", ",") and before[-2:-1].isdigit()), float(after[:1].isalnum() or after[:1] == "%"), float(digits.startswith(("19", "20"))), float(digits.startswith("00")),
        float(bool(re.match(r"\.[0-9A-Za-z]", after))), float(bool(re.match(r"\s?[(\[{<]\s?dot|\sdot\s", after))),
    ]


#: Documents that are fitted on, at most; spans and look-alikes of one of them, and their length; characters beside a span; lines made of them. The first three bound
#: the labelled rows of a fit and are parameters of it.
FIT_DOCS, PER_DOC, LONGEST, BESIDE, LINES = 3000, 8, 192, 48, 6000


def pieces(text: str, per_doc: int = PER_DOC, longest: int = LONGEST) -> list[tuple[str, bool, str, str, str]]:
    """(kind, whether it is a base span, text before it, it, text behind it) of some spans of a document: base spans, and
    numbers that a base pattern takes as a whole and whose test fails, or that fit none. At most `per_doc` of either, evenly spaced, of `longest` characters at most."""
    base = base_spans(text)
    fails = [("card", *m.span()) for m in CARD.finditer(text)] + [("ip", *m.span()) for m in IP.finditer(text)]
    fails = _outside([x for x in fails if len(_digits(text[x[1] : x[2]])) > 3], [x[1:] for x in base])
    out = []
    for real, some in ((True, base), (False, fails)):
        some = sorted(some, key=lambda x: x[1])
        some = [some[i * len(some) // per_doc] for i in range(per_doc)] if len(some) > per_doc else some
        out += [(k, real, text[max(0, s - BESIDE) : s], text[s:e], text[e : e + BESIDE]) for k, s, e in some if e - s <= longest]
    return out


class Pool:
    """Spans of documents by kind, look-alikes and places to put them, to make lines of."""

    def __init__(self, rows: list[tuple[str, bool, str, str, str]], seed: int):
        self.rng = np.random.default_rng(seed)
        self.real = {k: [r[3] for r in rows if r[1] and r[0] == k] for k in KINDS}
        self.kinds = [k for k in KINDS if self.real[k]]
        self.digits = "".join(_digits(r[3]) for r in rows if not r[1]) or "0123456789"
        self.places = [(r[2], r[4]) for r in rows]
        self.words = [w for r in rows for w in re.findall("[A-Za-z]{2,}", r[2] + " " + r[4])] or ["a"]

    def pick(self, *x):
        return x[self.rng.integers(len(x))]

    def number(self, k: int) -> str:
        """Digits of look-alikes, from any place of them on."""
        at = int(self.rng.integers(len(self.digits)))
        return (self.digits[at:] + self.digits * (k // len(self.digits) + 1))[:k]

    def rewritten(self, kind: str) -> str:
        """A base span of the kind in a format that the base patterns don't know, or know in part."""
        pick, span = self.pick, self.pick(*self.real[kind])
        if kind == "email":
            at, dot = pick((" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", "[dot]"), ("[at]", "."), (" at ", " dot "), (" (at) ", "."), (" @ ", " dot "), (" @ ", "."))
            name, _, host = span.partition("@")
            labels = host.split(".")
            if self.rng.random() < 0.6:  # of other names than those of the documents, which may be few
                name = pick(name, pick(*self.words) + pick("", ".", "_") + pick(*self.words), pick(*self.words))
                labels = [pick(*self.words), labels[-1]]
            return name + at + dot.join(labels)
        if kind == "ip":
            return pick("[.]", " . ", "(.)", ". ").join(span.split("."))
        d = _digits(span)
        if kind == "card":
            return pick(".", " ", "  ", "/", " - ").join(d[i : i + 4] for i in range(0, len(d), 4)) if self.rng.random() < 0.7 else d
        a, b, c, front = d[-10:-7] or "1", d[-7:-4], d[-4:], d[:-10] or "1"
        return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{front} {a} {b}{c}", f"0{a[:2]}/{b}{c}", f"0{a[:2]} {b} {c}", f"{a} {b} {c}", f"+{front} ({a}) {b}-{c}", f"+{front} {a} {b}{c}")

    def lookalike(self, kind: str) -> str:
        """Digits of look-alikes, or words, in formats that have something of the kind's."""
        pick, num = self.pick, self.number
        if kind == "email":
            last = pick(*self.words)
            return f"{pick(*self.words)}{pick(' at ', ' @ ', ' at ')}{pick(*self.words)}{pick('.', ' dot ', '.')}{last if last.lower() not in TLDS else last + last}"
        if kind == "ip":
            return pick(" ", "-", "/", ".").join(pick([num(2) for _ in range(4)], ["1", "0", "2", num(1)], [num(4), num(2), num(2), num(3)], [num(3), num(4), num(1), num(2)]))
        if kind == "card":
            d = num(pick(15, 16, 16, 17, 18))
            d = d[:-1] + next(c for c in d[-1] + "01" if not luhn(d[:-1] + c))
            return pick(".", " ", "  ", "/", " - ").join(d[i : i + 4] for i in range(0, len(d), 4)) if self.rng.random() < 0.5 else d
        return pick(f"20{num(2)}-{num(2)}-{num(2)}", num(8), f"{num(2)}/{num(2)}/20{num(2)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(1)}.{num(3)}.{num(3)}", num(10), f"{num(4)}-{num(4)}", num(16))

    def lines(self, n: int) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
        """(text, spans): two lines in five have several numbers or addresses side by side, of one kind or of any."""
        pick, rng = self.pick, self.rng
        for _ in range(n if self.kinds else 0):
            kind, real, several = pick(*self.kinds), rng.random() < 0.5, rng.random() < 0.4
            (before, _), (_, after) = pick(*self.places), pick(*self.places)
            text, found = re.sub(r"[0-9@+(\[]+\S*", "", before) if rng.random() < 0.8 else "", []
            text += " " if text[-1:] in LOCAL and text else ""
            gap, same = pick(" ", " ", " / ", "/", " - ", ", ", "; "), rng.random() < 0.6
            for i in range(rng.integers(2, 8) if several else 1):
                k, r = (kind, real ^ bool(i and rng.random() < 0.25)) if not i or same else (pick(*self.kinds), rng.random() < 0.5)
                span = self.rewritten(k) if r else self.lookalike(k)
                text += gap if i else ""
                if r:
                    found.append((k, len(text), len(text) + len(span)))
                text += span
            yield text + (re.sub(r"\A\S+|[0-9@+(\[]+\S*", "", after) if rng.random() < 0.8 else ""), found


def _matches(text: str, found: list[tuple[str, int, int]], kind: str, s: int, e: int) -> bool:
    """Whether a candidate is one of the spans: of an address nearly all of it, of a number all its digits."""
    for k, start, end in found:
        if k == kind and s < end and e > start:
            if kind == "email":
                return min(e, end) - max(s, start) >= 0.95 * (max(e, end) - min(s, start))
            if _digits(text[s:e]) == _digits(text[start:end]):
                return True
    return False


class Model:
    """Trees, what words say, and a threshold per kind. Without examples it selects nothing."""

    def __init__(self, boost: Boost | None = None, cues: dict[str, dict[str, float]] | None = None, cut: tuple[float, ...] = (2.0,) * len(KINDS)):
        self.boost, self.cues, self.cut = boost, cues or {}, cut

    def score(self, text: str, some: list[tuple[str, int, int]]) -> np.ndarray:
        if self.boost is None:
            return np.zeros(len(some))
        return self.boost.predict(np.array([features(text, *c, self.cues) for c in some]))


def _cues(examples: list[tuple[str, str, int, int, bool]]) -> dict[str, dict[str, float]]:
    """For each kind the log-odds of a word beside its spans against beside other candidates of the kind, of words seen ten times."""
    out = {}
    for kind in KINDS:
        yes, no = Counter(), Counter()
        for text, k, s, e, y in examples:
            if k == kind:
                (yes if y else no).update(set(_near(text, s, e)))
        a, b = sum(yes.values()) + 20, sum(no.values()) + 20
        odds = {w: math.log((yes[w] + 1) / a) - math.log((no[w] + 1) / b) for w in {*yes, *no} if yes[w] + no[w] >= 10}
        out[kind] = {w: round(x, 3) for w, x in odds.items() if abs(x) > 1}
    return out


def fit_rows(rows: list[tuple[bool, str, bool, str, str, str]], lines: int = LINES, precision: float = 0.99, seed: int = 5) -> Model:
    """A model from (held out, *piece) of `pieces`: fitted on what isn't held out; per kind the lowest threshold that reaches the precision
    on what is held out (two more wrong ones are counted, so few examples give none)."""
    sets: list[list[tuple[str, str, int, int, bool]]] = []
    for held in (False, True):
        mine, out = [r[1:] for r in rows if r[0] == held], []
        for kind, real, before, span, after in mine:  # as they stand: what touches the span
            text, at = before + span + after, len(before)
            found = [(kind, at, at + len(span))] if real else []
            out += [(text, *c, _matches(text, found, *c)) for c in candidates(text) if c[1] < at + len(span) and c[2] > at and (real or c[1] <= at + 1 and c[2] == at + len(span))]
        for text, found in Pool(mine, seed + held).lines(lines // 2):
            out += [(text, *c, _matches(text, found, *c)) for c in candidates(text)]
        sets.append(out)
    fitted, held = sets
    if min(len({x[4] for x in s}) for s in sets) < 2:
        return Model()
    cues = _cues(fitted)
    x, h = (np.array([features(*e[:4], cues) for e in s]) for s in sets)
    boost = Boost().fit(x, np.array([float(e[4]) for e in fitted]))
    p, y, kind, cut = boost.predict(h), np.array([float(e[4]) for e in held]), np.array([KINDS.index(e[1]) for e in held]), []
    for k in range(len(KINDS)):
        order = np.argsort(-p[kind == k], kind="stable")
        ranked = p[kind == k][order]
        good = np.cumsum(y[kind == k][order]) / (np.arange(1, len(order) + 1) + 2)
        ok = np.flatnonzero((good >= precision) & np.append(ranked[1:] < ranked[:-1], True)[: len(order)])  # equal scores go together
        # half way to the next score, since no example lies between
        cut.append(float(ranked[ok[-1] : ok[-1] + 2].mean()) if len(ok) else 2.0)
    return Model(boost, cues, tuple(cut))


def sample(docs: DataFrame, limit: int = FIT_DOCS, per_doc: int = PER_DOC, longest: int = LONGEST) -> DataFrame:
    """(held, kind, real, before, span, after): `pieces` of at most `limit` different texts that may have some, by a hash of the text."""
    docs = docs.select("text").where(F.col("text").rlike(r"@[A-Za-z0-9-]+\.|[0-9][0-9\x20().-]{5,}[0-9]"))
    keyed = docs.select("text", F.xxhash64("text").alias("key"))
    keys = keyed.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(limit)
    kept = keyed.join(F.broadcast(keys), "key")  # `limit` rows at most
    small_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(int(key), *p) for text, key in zip(pdf.text, pdf.key, strict=True) for p in pieces(text, per_doc, longest)]
            yield pd.DataFrame(rows, columns=["key", "kind", "real", "before", "span", "after"])

    found = kept.mapInPandas(run, "key long, kind string, real boolean, before string, span string, after string")
    return found.distinct().select((F.pmod("key", F.lit(3)) == 0).alias("held"), "kind", "real", "before", "span", "after")


def fit(docs: DataFrame, limit: int = FIT_DOCS, per_doc: int = PER_DOC, longest: int = LONGEST) -> Model:
    """A model fitted on the driver on at most `limit` texts of docs with `per_doc` spans and look-alikes each, of `longest` characters at most; the same for the
    same texts, however they are stored. Texts are searched whole, whatever was fitted on."""
    return fit_rows(sorted(map(tuple, sample(docs, limit, per_doc, longest).collect())))


def _outside(some: list[tuple[str, int, int]], base: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Those that touch no base span (which may overlap one another: of those that begin before a place, the last end counts)."""
    base = sorted(base)
    starts, ends = [s for s, _ in base], list(accumulate((e for _, e in base), max))
    return [c for c in some if not (at := bisect_left(starts, c[2])) or ends[at - 1] <= c[1]]


def spans(text: str | None, model: Model) -> list[tuple[str, int, int, float, bool]]:
    """All spans of a text: (kind, start, end, score, is base), by kind as in KINDS, then by place.

    Of candidates that reach their threshold the best-scored comes first (of equal scores the one further left, then the longer), and each that overlaps none taken is taken."""
    text = text or ""
    found = [(*s, 1.0, True) for s in base_spans(text)]
    if min(model.cut) <= 1 and (more := _outside(candidates(text), [s[1:3] for s in found])):
        good = []
        for lo in range(0, len(more), 4096):
            some = more[lo : lo + 4096]
            good += [(score, c) for score, c in zip(model.score(text, some), some, strict=True) if score >= model.cut[KINDS.index(c[0])]]
        taken: list[tuple[int, int]] = []  # in order and apart, so only neighbours can overlap
        for score, c in sorted(good, key=lambda x: (-x[0], x[1][1], -x[1][2], x[1][0])):
            at = bisect_left(taken, c[1:])
            if not any(c[1] < e and c[2] > s for s, e in taken[max(0, at - 1) : at + 1]):
                taken.insert(at, c[1:])
                found.append((*c, float(score), False))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"


def detect(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with `spans`: an array of kind, start, end (code points, end exclusive), score and base. Without a model, one is fitted on docs.

    A null or empty text has none, of a very long one the whole is searched; overlaps are resolved as in `spans`. Nulls in other columns, repeated rows
    (treated alike), an empty table and extra columns are fine; a column of the name `spans` is replaced.
    """
    model = model or fit(docs)
    small_batches(docs.sparkSession)

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "start", "end", "score", "base"), s, strict=True)) for s in spans(t, model)] for t in texts])

    return docs.withColumn("spans", find("text"))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs whose texts have <KIND> instead of each span (overlapping ones: one mark, of the first); n_chars, if there is one, follows.
    Without a model, one is fitted on docs.

    Null, empty and very long texts, repeated rows, nulls elsewhere and an empty table as in `detect`; all other columns stay as they are.
    """
    model = model or fit(docs)
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def cover(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = sorted(spans(t, model), key=lambda s: (s[1], -s[2]))
            if found:
                parts, at = [], 0
                for kind, start, end, *_ in found:
                    if start >= at:
                        parts += [t[at:start], f"<{kind.upper()}>"]
                    at = max(at, end)
                t = "".join(parts) + t[at:]
            out.append(t)
        return pd.Series(out, dtype=object)

    out = docs.withColumn("text", cover("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
