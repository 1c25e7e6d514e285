"""Personal data: base patterns, and spans added by a semi-Markov conditional random field.

Base spans are what the four patterns find, leftmost and without overlap in each kind, less those that fail the kind's
test (no part of a failing match is tried again). The field works on stretches around digits and at signs: a stretch's
tokens are cut into segments, each either outside or an entity of one of the kinds, at most MOST_TOKENS tokens long.
Features of a whole candidate segment (its shape, its check sums, its neighbours) and of two kinds that follow each other
are weighed, and a dynamic program over the bounded segments chooses all boundaries and kinds of a stretch together.
Weights maximise the conditional likelihood of labelled cuts, whose gradient comes from forward and backward sums over all
cuts. Labels are the base spans of a bounded sample of stretches, see ``fit``. A decoded entity is added where it overlaps no
base span; base spans always stay. Entities of more than MOST_TOKENS tokens or REACH characters are never added.

Defined cases: a null text is empty and has no spans; offsets are code points, end exclusive; repeated rows are judged
each on its own; a null doc_id is returned as it is; long texts are decoded window by window; columns that clash with
``pii`` in any case of letters keep their names, and the new one gets underscores; an empty table gives an empty result and
trains nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
#: Documents and stretches that the field is trained on, at most, characters of a stretch in one piece, and rounds.
FIT_DOCUMENTS, FIT_STRETCHES, LEARNT, EPOCHS = 2_000, 1_500, 512, 5
PENALTY, STEP = 1e-4, 0.5
#: Tokens and characters of an entity, at most; characters decoded together.
MOST_TOKENS, REACH, WINDOW = 16, 64, 2048

#: The base patterns. Their quantifiers are possessive where giving back can't lead to a match.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\x20\x09-\x0D]")
HIT = re.compile(r"[0-9@]")
SPACE = re.compile(r"[\x20\x09-\x0D]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order of start and kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(map(_byte, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(DIGIT.findall(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Runs of words that hold a digit or an at sign, whole words up to REACH characters to the left."""
    m = HIT.search(text)
    while m:
        at = m.start()
        start = at
        while start > 0 and at - start < REACH and not SPACE.match(text, start - 1):
            start -= 1
        end = at
        while True:
            gap = SPACE.search(text, end)
            end = gap.start() if gap else len(text)
            if not gap:
                break
            # the next word goes on with it if it holds a digit soon, or opens a bracket of one
            soon = HIT.search(text, end + 1, min(len(text), end + 1 + 8))
            if gap[0] != " " or not soon or SPACE.search(text, end + 1, soon.start()):
                break
            end = soon.start()
        yield start, end
        m = HIT.search(text, end)


#: Characters that are looked at by themselves; others by class.
_MARKS = "@.+-( "
N_FEATURES = 140


def _bucket(n: np.ndarray, edges: tuple[int, ...]) -> np.ndarray:
    return np.searchsorted(np.array(edges), n, side="right")


def candidates(text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of text[start:end]; first and last tokens and feature ids of the candidate segments, by last token.

    A candidate begins and ends with whole words, is at most MOST_TOKENS tokens and REACH characters long, and holds an at
    sign, nine digits, or four digits and three full stops.
    """
    spans = np.array([m.span() for m in TOKEN.finditer(text, start, end)], np.int64).reshape(-1, 2)
    a, b = spans[:, 0], spans[:, 1]
    none = np.empty(0, np.int64)
    lo, hi = max(start - 1, 0), min(end + 1, len(text))
    around = text[lo:hi]
    cp = np.frombuffer(around.encode("utf-32-le", "surrogatepass"), np.uint32)
    known, inverse = np.unique(cp, return_inverse=True)
    chars = [chr(c) for c in known.tolist()]
    letter, alnum, space = (np.array([f(c) for c in chars], bool)[inverse] for f in (str.isalpha, str.isalnum, str.isspace))
    digit = (cp >= 48) & (cp <= 57)
    total = lambda x: np.concatenate(([0], np.cumsum(x)))
    sums = {c: total(cp == ord(c)) for c in _MARKS}
    digits, letters = total(digit), total(letter)
    # the class of each character, and of what lies before and behind the text
    side = np.full(len(cp) + 1, 0)
    side[:-1] = np.select([space, digit, letter, np.isin(cp, [ord(c) for c in "@.+-"])], [0, 1, 2, 3], 4)
    first_ok = (alnum | np.isin(cp, [ord("+"), ord("(")]))[a - lo]
    inside = np.concatenate(([False], alnum[:-1] & alnum[1:], [False]))  # between characters of one word
    first_ok &= ~inside[a - lo]
    last_ok = alnum[b - lo - 1] & ~inside[b - lo]
    j, i = (x.ravel() for x in np.meshgrid(np.nonzero(last_ok)[0], np.arange(MOST_TOKENS), indexing="ij"))
    i = j - i
    keep = i >= 0
    i, j = i[keep], j[keep]
    x, y = a[i] - lo, b[j] - lo
    count = lambda of: of[y] - of[x]
    n, dots, ats = count(digits), count(sums["."]), count(sums["@"])
    keep = first_ok[i] & (y - x <= REACH) & (y - x >= 6) & ((ats > 0) | (n >= 9) | ((n >= 4) & (dots >= 3)))
    i, j, x, y, n, dots, ats = (v[keep] for v in (i, j, x, y, n, dots, ats))
    if not len(i):
        return a, b, none, none, np.empty((0, 14), np.int64)
    some = count(letters) > 0
    only = ~some & (n + count(sums[" "]) + count(sums["-"]) == y - x)
    plus = cp[x] == ord("+")
    spaces = count(sums[" "])
    card, ip, mail = only & (n >= 12) & (n <= 19), ~some & (dots == 3), (ats == 1) & (spaces == 0)
    for flag, fine in ((card, lambda s: luhn(s.replace(" ", "").replace("-", ""))), (ip, lambda s: all(p.isascii() and p.isdigit() and _byte(p) for p in s.split("."))), (mail, lambda s: next(emails(s), None) == (0, len(s)))):
        for k in np.nonzero(flag)[0]:
            flag[k] = fine(around[x[k] : y[k]])
    of = [
        _bucket(n, (1, 4, 9, 12, 16, 20)),
        10 + np.minimum(dots, 4),
        20 + _bucket(y - x, (4, 8, 12, 16, 24, 40)),
        30 + 2 * some + (ats > 0),
        40 + plus + 2 * digit[x] + 3 * letter[x],
        50 + digit[y - 1] + 2 * letter[y - 1],
        60 + 2 * only + card,
        70 + ip,
        80 + mail,
        90 + (plus & (n >= 9) & (n <= 15) & ~some),
        100 + np.where(x > 0, side[x - 1], 0),
        110 + side[y],
        120 + np.minimum(j - i + 1, 9),
        130 + 2 * (spaces > 0) + (count(sums["("]) > 0),
    ]
    return a, b, i, j, np.stack([np.asarray(v, np.int64) for v in of], 1)


def decode(n: int, i: np.ndarray, j: np.ndarray, own: np.ndarray, t: np.ndarray) -> list[tuple[int, int, int]]:
    """(first token, kind, last token) of the likeliest cut of n tokens; own: a candidate's weight by kind, t: kind before by kind."""
    k = len(KINDS)
    if not len(i):
        return []
    best = np.full((n + 1, k + 1), -np.inf)
    best[0, k] = 0.0  # state k: outside
    back = np.zeros((n + 1, k + 1, 2), np.int64)
    ends = np.searchsorted(j, np.arange(n + 1))
    kinds = np.arange(k)
    for e in range(n):
        s = int(best[e].argmax())
        best[e + 1, k], back[e + 1, k] = best[e, s], (e, s)
        if ends[e] < ends[e + 1]:
            c = slice(ends[e], ends[e + 1])
            came = best[i[c]][:, :, None] + t
            before = came.argmax(1)
            total = came.max(1) + own[c]
            which = total.argmax(0)
            best[e + 1, :k] = total[which, kinds]
            back[e + 1, :k, 0], back[e + 1, :k, 1] = i[c][which], before[which, kinds]
    out, e, s = [], n, int(best[n].argmax())
    while e:
        first, before = back[e, s]
        if s < k:
            out.append((int(first), s, e - 1))
        e, s = int(first), int(before)
    return out[::-1]


def likelihood(n: int, i: np.ndarray, j: np.ndarray, own: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log of the sum over all cuts of n tokens, and the probabilities of (candidate, kind) and of (kind before, kind), the latter summed.

    Forward and backward sums over the candidates of at most MOST_TOKENS tokens; a token outside of them weighs nothing.
    """
    k = len(KINDS)
    ahead, behind = np.full((n + 1, k + 1), -np.inf), np.zeros((n + 1, k + 1))
    ahead[0, k] = 0.0
    ends = np.searchsorted(j, np.arange(n + 1))
    into = np.empty((len(i), k + 1, k))
    for e in range(n):
        ahead[e + 1, k] = np.logaddexp.reduce(ahead[e])
        if ends[e] < ends[e + 1]:
            c = slice(ends[e], ends[e + 1])
            into[c] = ahead[i[c]][:, :, None] + t + own[c][:, None, :]
            ahead[e + 1, :k] = np.logaddexp.reduce(into[c].reshape(-1, k), axis=0)
    order = np.argsort(i, kind="stable")
    begins = np.searchsorted(i[order], np.arange(n + 1))
    for e in range(n - 1, -1, -1):
        behind[e] = behind[e + 1, k]
        c = order[begins[e] : begins[e + 1]]
        if len(c):
            more = (own[c] + behind[j[c] + 1, :k])[:, None, :] + t
            behind[e] = np.logaddexp(behind[e], np.logaddexp.reduce(more.transpose(1, 0, 2).reshape(k + 1, -1), axis=1))
    whole = float(np.logaddexp.reduce(ahead[n]))
    p = np.exp(into + behind[j + 1, :k][:, None, :] - whole)
    return whole, p.sum(1), p.sum(0)


def train(examples: list[tuple[str, list[tuple[int, int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights from (stretch, its base spans): the conditional likelihood of the labelled cuts, by gradient steps of adaptive size."""
    k = len(KINDS)
    w, t = np.zeros((N_FEATURES, k)), np.zeros((k + 1, k))
    sw, st = np.full_like(w, 1e-8), np.full_like(t, 1e-8)
    ready = []
    for text, spans in examples:
        a, b, i, j, ids = candidates(text, 0, len(text))
        if not len(i):
            continue
        at = {(x, y): n for n, (x, y) in enumerate(zip(a[i].tolist(), b[j].tolist(), strict=True))}
        gold, gone = [], -1
        for x, kind, y in spans:
            c = at.get((x, y))
            if c is not None and i[c] > gone:
                gold.append((c, kind))
                gone = int(j[c])
        ready.append((len(a), i, j, ids, gold))
    for _ in range(EPOCHS):
        for n, i, j, ids, gold in ready:
            _, p, moves = likelihood(n, i, j, w[ids].sum(1), t)
            for c, y in gold:
                p[c, y] -= 1.0
            before, gone = k, -1
            for c, y in gold:
                if i[c] != gone + 1:
                    before = k
                moves[before, y] -= 1.0
                before, gone = y, int(j[c])
            g = PENALTY * w
            np.add.at(g, ids.ravel(), np.repeat(p, ids.shape[1], axis=0))
            sw += g * g
            w -= STEP * g / np.sqrt(sw)
            g = moves + PENALTY * t
            st += g * g
            t -= STEP * g / np.sqrt(st)
    return w, t


def entities(text: str, start: int, end: int, w: np.ndarray, t: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the likeliest entities of a stretch. Long stretches are cut in windows; what ends within REACH of a
    window's edge is judged anew in the next one, so that memory is bounded."""
    while start < end:
        stop = min(end, start + WINDOW)
        a, b, i, j, ids = candidates(text, start, stop)
        found = [(int(a[x]), y, int(b[z])) for x, y, z in decode(len(a), i, j, w[ids].sum(1), t)]
        if stop == end:
            yield from found
            return
        safe = stop - REACH
        yield from (x for x in found if x[2] <= safe)
        start = min([safe, *(x[0] for x in found if x[2] > safe)])


def added(text: str, base: list[tuple[int, int, int]], w: np.ndarray, t: np.ndarray) -> list[tuple[int, int, int]]:
    """Decoded entities that overlap no base span."""
    out = []
    if not w.any():
        return out
    spans = sorted((a, b) for a, _, b in base)
    p = 0
    for start, end in stretches(text):
        while p < len(spans) and spans[p][1] <= start:
            p += 1
        if p < len(spans) and spans[p][0] <= start and end <= spans[p][1]:
            continue  # a base span is all of it
        q = p
        for a, y, b in entities(text, start, end, w, t):
            while q < len(spans) and spans[q][1] <= a:
                q += 1
            # spans of different kinds may overlap, so a later one may begin sooner
            r, free = q, True
            while free and r < len(spans) and spans[r][0] < b:
                free = spans[r][1] <= a
                r += 1
            if free:
                out.append((a, y, b))
    return out


PII = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def fit(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights from a bounded sample: of the documents whose hash is a multiple of about a FIT_DOCUMENTS-th of their number, the
    FIT_STRETCHES first stretches by hash; long stretches in pieces of LEARNT characters."""
    step = max(1, docs.count() // FIT_DOCUMENTS)
    few = docs.where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).select(F.col("text").cast("string").alias("text"))
    schema = pa.schema([("stretch", pa.string()), ("spans", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                text, rows, p = x.as_py() or "", [], 0
                spans = base_spans(text)
                for a, end in stretches(text):
                    for start in range(a, end, LEARNT):
                        stop = min(end, start + LEARNT)
                        while p < len(spans) and spans[p][0] < start:
                            p += 1
                        q, own = p, []
                        while q < len(spans) and spans[q][0] < stop:
                            if spans[q][2] <= stop:
                                own += [spans[q][0] - start, spans[q][1], spans[q][2] - start]
                            q += 1
                        rows.append({"stretch": text[start:stop], "spans": own})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    got = few.mapInArrow(run, "stretch string, spans array<int>").distinct().orderBy(F.xxhash64("stretch"), "stretch").limit(FIT_STRETCHES).collect()
    return train([(r["stretch"], sorted(zip(r["spans"][::3], r["spans"][1::3], r["spans"][2::3], strict=True))) for r in got])


def annotate(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, redact: bool = False) -> DataFrame:
    """All columns of ``docs`` and ``pii``, its spans in order of start and kind; with redact the text has [KIND] for each span."""
    w, t = model if model is not None else fit(docs)
    names = docs.columns
    k = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, found, texts = list(b.columns), [], []
            for x in cols[k]:
                text = x.as_py() or ""
                base = base_spans(text)
                more = added(text, base, w, t)
                spans = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
                found.append([{"kind": KINDS[y], "start": a, "end": z, "base": own} for a, y, z, own in spans])
                if redact:
                    texts.append(_redacted(text, spans) if spans else x.as_py())
            if redact:
                cols[k] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, _ARROW)], names=[*names, out])

    out = "pii"
    while out in {n.lower() for n in names}:
        out += "_"
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, PII)]))


def _redacted(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each maximal run of overlapping spans as the tag of its first."""
    out, at, end = [], 0, -1
    for a, y, z, _ in spans:
        if a < end:
            end = max(end, z)
            continue
        if end >= 0:
            at = end
        out += [text[at:a], f"[{KINDS[y].upper()}]"]
        at, end = a, z
    out.append(text[max(end, 0) :])
    return "".join(out)


def listed(pii: Column) -> Column:
    return F.array_join(F.transform(pii, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of each document's spans."""
    found = annotate(docs.select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda x: x["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
