"""Personal data: rules, and a semi-Markov conditional random field that adds what the rules do not reach.

The rules (`base_spans`) find e-mail addresses, IPv4 addresses, card numbers and phone numbers in linear time.  The
model looks at zones: runs of words that hold a digit or an @ outside the rules' spans, or a written-out "at"
("[at]", "(at)" or " at ") before a host with dots.  A zone is cut into atoms (runs of letters, of digits, of blanks; any other character alone); a segmentation gives
each atom to an entity of at most MAX_ATOMS atoms and MAX_CHARS code points, or to none.  A candidate entity is scored by
features of the whole span (its shape, digit and group counts, separators, check digit, octets, domain) and its borders;
dynamic programming over all segmentations chooses boundaries and types together.  Spans that touch one of the
rules are not added.

Weights maximise the conditional likelihood of segmentations (forward-backward sums, adaptive steps) on a bounded
sample: FIT_TEXTS texts, at most FIT_ZONES zones, with the rules' spans as labels, and copies of zones in which an entity is
rewritten in a way the rules miss (no plus sign or country, other marks between groups, "[at]" or " at " for @).

Defined results: a null or empty text has no spans; offsets are code points, ends exclusive; repeated rows are scanned
each (ties in starts go by kind); a very long text is read whole, a null doc_id is kept as null; an empty table gives an
empty result; without any training zone the model adds nothing; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common as c

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS, MAX_CHARS = 16, 64
FIT_TEXTS, FIT_ZONES, EPOCHS = 3000, 1200, 3
MEMORY = 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_OPENER = re.compile(r"[0-9@]|(?:\[at\]|\(at\)|(?<=\x20)at(?=\x20))(?=\x20?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2})", re.I)
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|[\x20\x09-\x0D]+|.", re.S)
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AT_WORDS = frozenset(("at", "[at]", "(at)"))

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The rules' spans, by start and then kind."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _word(text: str, at: int, whole: bool = True) -> tuple[int, int]:
    """The word that holds a place, as far as MAX_CHARS to either side; if whole, as far as that after its last trigger
    that is less than two MAX_CHARS from the one before, so that no entity crosses the end."""
    start, end, last = at, at + 1, at
    while start > 0 and at - start < MAX_CHARS and text[start - 1] not in c.BLANK:
        start -= 1
    reach = 2 * MAX_CHARS if whole else MAX_CHARS
    while end < len(text) and end - last < reach and text[end] not in c.BLANK:
        if whole and _OPENER.match(text, end):
            last = end
        end += 1
    return start, end if end == len(text) or text[end] in c.BLANK else last + MAX_CHARS


def zones(text: str, spans: list[Span], everything: bool = False) -> Iterator[tuple[int, int]]:
    """Runs of words with a trigger or a written-out "at" outside the spans (with `everything`, which is for training,
    triggers alone, inside them too)."""
    done, k = 0, 0
    opener = _TRIGGER if everything else _OPENER
    by_end = sorted((e, s) for s, _, e in spans)
    at = 0
    while m := opener.search(text, at):
        p = m.start()
        while k < len(by_end) and by_end[k][0] <= p:
            k += 1
        if not everything and (inside := [e for e, s in by_end[k : k + 4] if s <= p]):
            at = max(inside)
            continue
        start, end = _word(text, p, not everything)
        start = max(start, done)
        # words before and after that belong to it: "name [at] host", "(359) 555-3724"
        before = start
        for _ in range(2):
            if before - 1 > done and text[before - 1] == " ":
                s, e = _word(text, before - 2, not everything)
                if e == before - 1 and (text[s:e].lower() in _AT_WORDS or text[before : before + 4].lower().startswith(("[at]", "(at)", "at ")) or before == start and _TRIGGER.search(text, s, e)):
                    before = max(s, done)
                    continue
            break
        start = before
        while end + 1 < len(text) and text[end] == " " and text[end + 1] not in c.BLANK:
            s, e = _word(text, end + 1, not everything)
            word = text[s:e].lower()
            if not (_TRIGGER.search(word) or word in _AT_WORDS or text[max(start, end - 4) : end].lower().endswith((" at", "[at]", "(at)"))):
                break
            end = e
        yield start, end
        at = done = max(end, p + 1)


def shape(atom: str) -> str:
    ch = atom[0]
    if ch.isascii() and ch.isdigit():
        return f"d{min(len(atom), 20)}"
    if ch.isascii() and ch.isalpha():
        return "at" if atom.lower() == "at" else "a" if len(atom) > 1 else "i"
    return "_" if ch in c.BLANK else ch if ch in "@.+-()[]%:=/,#" else "p"


def _border(ch: str) -> str:
    if not ch or ch in c.BLANK:
        return "s"
    return "d" if ch.isdigit() else "a" if ch.isalpha() else ch if ch in "@.+-=/#:" else "p"


def features(shapes: list[str], flags: str) -> list[str]:
    """Features of a candidate from its atoms' shapes and its flags (borders, check digit, octets)."""
    digits = [int(s[1:]) for s in shapes if s[0] == "d"]
    n, kinds = sum(digits), "".join(sorted({s[0] if s[0] in "dai" else s for s in shapes}))
    marks = "".join(sorted({s for s in shapes if s[0] not in "dai" or s == "at"}))
    dots = shapes.count(".")
    at = "@" if shapes.count("@") == 1 else "at" if "at" in shapes else "-"
    letters = any(s[0] in "ai" and s != "at" for s in shapes)
    n_digits = n if n < 20 else 20
    out = ["bias", "S" + "".join(shapes), f"n{n_digits}l{int(letters)}", f"g{min(len(digits), 6)}", f"k{kinds[:12]}", f"m{marks[:12]}", "c" + flags[2:], f"c{flags[2:]}n{n_digits}l{int(letters)}"]
    out += ["<" + flags[0], ">" + flags[1], f"b{flags[:2]}", f"@{at}.{min(dots, 4)}", f"f{shapes[0][0]}e{shapes[-1][0]}", f"@{at}e{shapes[-1][0]}l{int(letters)}", f"p{shapes[0]}n{n_digits}l{int(letters)}"]
    if not letters and at == "-":
        out.append("D" + ".".join(map(str, digits)))
    return out


class Model:
    """Scores of the four kinds for candidate spans; `weights` maps a feature to four numbers."""

    def __init__(self, weights: dict[str, tuple[float, ...]]) -> None:
        self.weights, self.memory = weights, {}

    def score(self, shapes: list[str], flags: str) -> tuple[float, ...]:
        key = ("".join(shapes), flags)
        got = self.memory.get(key)
        if got is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            rows = [w for f in features(shapes, flags) if (w := self.weights.get(f))]
            got = self.memory[key] = tuple(map(sum, zip(*rows, strict=True))) if rows else (0.0,) * 4
        return got


Candidate = tuple[int, int, list[str], str]  # first atom, end atom, shapes, flags


def atoms_of(text: str, start: int, end: int) -> tuple[list[int], list[str]]:
    """Atom boundaries and shapes of a zone."""
    places = [m.start() for m in _ATOM.finditer(text, start, end)] + [end]
    return places, [shape(text[a:b]) for a, b in zip(places, places[1:], strict=False)]


def starting(text: str, places: list[int], shapes: list[str], i: int) -> Iterator[Candidate]:
    """Candidate entities whose first atom is i."""
    first = shapes[i]
    if first[0] not in "dai+(" or first == "_":
        return
    left, digits, trigger = _border(text[places[i] - 1 : places[i]] if places[i] else ""), "", False
    for j in range(i + 1, min(len(shapes), i + MAX_ATOMS) + 1):
        last = shapes[j - 1]
        if places[j] - places[i] > MAX_CHARS:
            break
        if last[0] == "d":
            digits += text[places[j - 1] : places[j]]
            trigger = True
        trigger = trigger or last in ("@", "at")
        if not trigger or last[0] not in "dai" or j - i == 1 and last[0] != "d":
            continue
        check = "L" if 12 <= len(digits) <= 19 and luhn(digits) else "-"
        atoms = [text[places[k] : places[k + 1]] for k in range(i, j, 2)] if j - i == 7 else []
        octets = "O" if atoms and all(s == "." for s in shapes[i + 1 : j : 2]) and all(a.isdigit() and len(a) <= 3 and int(a) <= 255 for a in atoms) else "-"
        yield i, j, shapes[i:j], left + _border(text[places[j] : places[j] + 1]) + check + octets


def candidates(text: str, start: int, end: int) -> tuple[list[int], list[Candidate]]:
    """Atom boundaries of a zone, and all its candidate entities."""
    places, shapes = atoms_of(text, start, end)
    return places, [x for i in range(len(shapes)) for x in starting(text, places, shapes, i)]


def decode(model: Model, text: str, start: int, end: int) -> list[Span]:
    """The best segmentation's entities in a zone of any length; candidates are made as the programme gets to them."""
    places, shapes = atoms_of(text, start, end)
    n = len(shapes)
    best, back = [-math.inf] * (n + 1), [None] * (n + 1)
    best[0] = 0.0
    for i in range(n + 1):
        if i and best[i] <= best[i - 1]:
            best[i], back[i] = best[i - 1], None
        if i == n:
            break
        for _, j, own, flags in starting(text, places, shapes, i):
            scores = model.score(own, flags)
            top = max(scores)
            if best[i] + top > best[j]:
                best[j], back[j] = best[i] + top, (i, scores.index(top))
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((places[i], kind, places[j]))
            j = i
    return out[::-1]


def all_spans(model: Model, text: str) -> tuple[list[Span], list[Span]]:
    """The rules' spans, and those with the model's, both in order."""
    if not _OPENER.search(text):
        return [], []
    base = base_spans(text)
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    added = []
    for start, end in zones(text, base):
        for x in decode(model, text, start, end):
            before = bisect_left(starts, x[2])  # rules' spans that start before its end
            if not before or ends[before - 1] <= x[0]:
                added.append(x)
    return base, sorted(base + added)


def _rewritten(rng: random.Random, kind: int, entity: str) -> str | None:
    """An entity as the rules miss it: a written-out at (some hosts one label longer), a phone without its country, groups with
    other marks between them."""
    if kind == 0:
        host = rng.choice(("", "", "mail.", "x1."))
        return entity.replace("@", rng.choice((" at ", " [at] ", "[at]", " (at) ")) + host)
    if kind == 3:
        bare = entity.lstrip("+")
        cut = bare.split(" ", 1)[-1] if rng.random() < 0.7 else bare
        groups = _NOT_DIGIT.split(cut.strip("()"))
        return rng.choice((cut, cut.replace(" ", "-"), cut.replace("-", ".").replace(") ", ")."), "-".join(groups), ".".join(groups), " ".join(groups)))
    if kind == 2 and entity.isdigit() and len(entity) == 16:
        return rng.choice((".", "/", "  ")).join(entity[k : k + 4] for k in range(0, 16, 4))
    return None


def training_zones(texts: Iterator[str]) -> list[tuple[list, dict]]:
    """(candidates, labels by (first atom, end atom)) of at most FIT_ZONES zones, rewritten ones included."""
    rng, out = random.Random(6), []
    for text in texts:
        base = base_spans(text)
        for start, end in zones(text, base, everything=True):
            if len(out) >= FIT_ZONES or end - start > 120:
                continue
            inside = [x for x in base if x[0] >= start and x[2] <= end]
            versions = [(text[max(0, start - 1) : end + 1], [(s - max(0, start - 1), k, e - max(0, start - 1)) for s, k, e in inside], start - max(0, start - 1))]
            if len(inside) == 1:
                (s, k, e), other = inside[0], _rewritten(rng, inside[0][1], text[inside[0][0] : inside[0][2]])
                if other:
                    before = text[max(0, start - 1) : s]
                    versions.append((before + other + text[e : end + 1], [(len(before), k, len(before) + len(other))], start - max(0, start - 1)))
            for piece, spans, first in versions:
                places, found = candidates(piece, first, len(piece) - (end < len(text)))
                number = {p: i for i, p in enumerate(places)}
                gold = {(number[s], number[e]): k for s, k, e in spans if s in number and e in number}
                if all(x in {(i, j) for i, j, *_ in found} for x in gold):
                    out.append(([(i, j, features(sh, fl)) for i, j, sh, fl in found], gold, len(places) - 1))
    return out


def marginals(first: np.ndarray, last: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """How likely each candidate (from atom first to atom last, of n) is an entity of each kind, over all segmentations, and the
    logarithm of the sum of all segmentations' weights."""
    entity = np.logaddexp.reduce(scores, axis=1)
    ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
    ends, starts = {}, {}
    for k, (i, j) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        ends.setdefault(j, []).append(k)
        starts.setdefault(i, []).append(k)
    for j in range(1, n + 1):
        ahead[j] = ahead[j - 1]
        for k in ends.get(j, ()):
            ahead[j] = np.logaddexp(ahead[j], ahead[first[k]] + entity[k])
    for i in range(n - 1, -1, -1):
        behind[i] = behind[i + 1]
        for k in starts.get(i, ()):
            behind[i] = np.logaddexp(behind[i], entity[k] + behind[last[k]])
    return np.exp(ahead[first, None] + scores + behind[last, None] - ahead[n]), float(ahead[n])


def learn(examples: list, epochs: int = EPOCHS, step: float = 0.3, l2: float = 1e-3) -> dict[str, list[float]]:
    """Weights that maximise the likelihood of the labelled segmentations."""
    names = {f: i for i, f in enumerate(sorted({f for found, *_ in examples for _, _, fs in found for f in fs}))}
    w, g2 = np.zeros((len(names), 4)), np.full((len(names), 4), 1e-6)
    ready = []
    for found, gold, n in examples:
        if found:
            rows = [np.array([names[f] for f in fs]) for *_, fs in found]
            label = np.array([gold.get((i, j), -1) for i, j, _ in found])
            ready.append((np.array([i for i, *_ in found]), np.array([j for _, j, _ in found]), rows, label, n))
    rng = np.random.default_rng(6)
    for _ in range(epochs):
        for at in rng.permutation(len(ready)):
            first, last, rows, label, n = ready[at]
            slope = -marginals(first, last, np.array([w[r].sum(0) for r in rows]), n)[0]
            on = label >= 0
            slope[np.flatnonzero(on), label[on]] += 1
            for k in np.flatnonzero(np.abs(slope).max(1) > 1e-3):
                d = slope[k] - l2 * w[rows[k]]
                g2[rows[k]] += d * d
                w[rows[k]] += step * d / np.sqrt(g2[rows[k]])
    return {f: w[i].tolist() for f, i in names.items() if np.abs(w[i]).max() > 1e-3}


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = (t or "" for batch in batches for t in batch.column(0).to_pylist())
    got = learn(training_zones(texts))
    yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.list_(pa.float64()))], names=["feature", "weights"])


def train(docs: DataFrame) -> dict[str, tuple[float, ...]]:
    hot = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]"))
    n = hot.count()
    part = min(1.0, FIT_TEXTS / n) if n else 0.0
    chosen = hot.where(F.pmod(F.xxhash64("doc_id", F.lit("pii")), F.lit(1 << 30)) < int(part * (1 << 30)))
    order = F.xxhash64("doc_id", F.lit("order"))
    rows = chosen.select("text", order.alias("_o")).repartition(1).sortWithinPartitions("_o", "text").select("text")
    return {r["feature"]: tuple(r["weights"]) for r in rows.mapInArrow(c.lean(_fit), "feature string, weights array<double>").collect()}


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"


def _find(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(weights.value)
        names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"]
        for batch in batches:
            counts, joined = np.zeros((4, batch.num_rows), np.int64), ([], [])
            for i, text in enumerate(batch.column(1).to_pylist()):
                both = all_spans(model, text or "")
                for _, kind, _ in both[0]:
                    counts[kind, i] += 1
                for out, spans in zip(joined, both, strict=True):
                    out.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(joined[0], pa.string()), pa.array(joined[1], pa.string())], names=names)

    return run


def find(spark: SparkSession, docs: DataFrame, weights: dict) -> DataFrame:
    """doc_id, counts of the rules' spans by kind, these spans and all spans (kind:start:end, joined by commas)."""
    shared = spark.sparkContext.broadcast(weights)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(c.lean(_find(shared)), _OUT)


def redact(text: str, model: Model) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first stays."""
    out, end = [], 0
    for s, k, e in all_spans(model, text)[1]:
        if s >= end:
            out += [text[end:s], f"<{KINDS[k]}>"]
            end = e
    return "".join([*out, text[end:]])


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(spark, docs, train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
