"""Personal data by a semi-Markov conditional random field over whole candidate spans.

Exact base patterns (e-mail, IP address, payment card, phone) always count.  Between them a semi-Markov random field
labels further spans, such as spelled-out addresses, phones without a country code and mistyped card numbers.
A segment is a whole candidate span with a type; its features look at the span as one piece (digit groups, separators,
check digit, neighbours, whether it fills its run).  Text outside entities scores 0.  Dynamic programming over candidate
boundaries chooses boundaries and types together; an entity has at most `MAX_GROUPS` digit groups or `MAX_CHARS` characters,
so decoding is linear in the text.

The weights are trained here: base spans in a bounded sample of passages (`train_passages`, the smallest by hash) are the gold
spans, together with fixed rewritings of them and of look-alikes (dates, prices, versions, plain numbers).

Defined results: a null or empty text has no spans; offsets are code points, end exclusive; repeated rows each get their
own result; other columns pass through; without any base span in the corpus the field adds nothing.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import computed, text_or_empty

KINDS = ("email", "ip", "card", "phone")
MAX_GROUPS = 8
MAX_CHARS = 96
CONTEXT = 48
TRAIN_PASSAGES = 600
EPOCHS = 12
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,base:boolean>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")
SIGNAL = re.compile(r"[0-9@]|[\[( ][Dd][Oo][Tt][\]) ]")
RUN = re.compile(r"[+(]?[0-9][0-9\x20()+./-]*[0-9]")
GROUP = re.compile("[0-9]+")
AT, DOT = r"(?: ?@ ?| ?[\[(] ?[Aa][Tt] ?[\])] ?| at )", r"(?: ?\. ?| ?[\[(] ?[Dd][Oo][Tt] ?[\])] ?| dot )"
SPELLED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{AT}[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}")
#: What an address has behind its local part, up to its first dot.
ADDRESS = re.compile(rf"{AT}(?=[A-Za-z0-9-]{{1,63}}{DOT})")
#: Words just before a span that tell its type.
CUES = {"email": {"email", "mail", "contact", "write"}, "ip": {"ip", "host", "server", "address"},
        "card": {"card", "visa", "credit", "debit", "mastercard"}, "phone": {"tel", "phone", "call", "fax", "mobile", "cell"}}
CUE_OF = {w: k for k, ws in CUES.items() for w in ws}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns, by kind and start; linear in the text."""
    out = []
    free = 0
    at = text.find("@")
    while at >= 0:
        if domain := DOMAIN.match(text, at + 1):
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((0, start, domain.end()))
                free = domain.end()
        at = text.find("@", max(at + 1, free))
    if not DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def passages(text: str) -> list[tuple[int, int]]:
    """Stretches of the text around digits, at signs, spelled-out dots and addresses, of whole words; no candidate crosses a border of one."""
    spans = [m.span() for m in SIGNAL.finditer(text)]
    for m in ADDRESS.finditer(text):
        start = m.start()
        while start > max(0, m.start() - 65) and text[start - 1] in LOCAL:
            start -= 1
        if found := SPELLED.match(text, start):
            spans.append(found.span())
    near: list[list[int]] = []
    for x, y in sorted(spans):
        a, b = max(0, x - CONTEXT), min(len(text), y + CONTEXT)
        if near and a <= near[-1][1]:
            near[-1][1] = max(b, near[-1][1])
        else:
            near.append([a, b])
    out: list[list[int]] = []
    for i, (a, b) in enumerate(near):
        free, until = out[-1][1] if out else 0, near[i + 1][0] if i + 1 < len(near) else len(text)
        while a > free and text[a] in LOCAL and text[a - 1] in LOCAL:
            a -= 1
        while b < until and text[b] in LOCAL and text[b - 1] in LOCAL:
            b += 1
        if out and a <= free:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def char_class(text: str, i: int) -> str:
    if not 0 <= i < len(text):
        return "edge"
    c = text[i]
    return "space" if c.isspace() else "alpha" if c.isalpha() else "digit" if c.isdigit() else "money" if c in "$€£%" else "stop" if c in ".,;:!?" else "mark"


def cue_before(text: str, start: int) -> str:
    before = re.findall("[A-Za-z]+", text[max(0, start - 20) : start])
    return next((CUE_OF[w.lower()] for w in before[-2:] if w.lower() in CUE_OF), "none")


def number_features(text: str, run: tuple[int, int], start: int, end: int) -> list[tuple[int, list[str]]]:
    span = text[start:end]
    groups = GROUP.findall(span)
    digits = "".join(groups)
    n = len(digits)
    if not 7 <= n <= 19:
        return []
    gaps = NOT_DIGIT.findall(span.lstrip("+("))
    sort = "none" if not gaps else "dots" if set(gaps) == {"."} else "dashes" if set(gaps) == {"-"} else "spaces" if set(gaps) == {" "} else "slashes" if "/" in span else "mixed"
    shape = "-".join(str(len(g)) for g in groups) if len(groups) <= 5 else "many"
    common = [f"n={n}", f"sort={sort}", f"shape={shape}", f"lead={span[0] if span[0] in '+(' else '0'}", f"before={char_class(text, start - 1)}",
              f"after={char_class(text, end)}", f"whole={(start, end) == run}", f"cue={cue_before(text, start)}"]
    out = []
    if len(groups) == 4 and sort == "dots" and n <= 12:
        out.append((1, [*common, f"bytes={all(len(g) < 4 and int(g) < 256 for g in groups)}"]))
    if n >= 13 and span[0] not in "+(" and sort in ("none", "spaces", "dashes", "dots"):
        out.append((2, [*common, f"check={luhn(digits)}", f"even={len({len(g) for g in groups}) == 1}"]))
    if n <= 15 and sort != "slashes":
        out.append((3, [*common, f"paren={'(' in span and ')' in span}", f"groups={min(len(groups), 5)}"]))
    return out


def candidates(text: str, blocked: list[tuple[int, int]]) -> list[tuple[int, int, int, list[str]]]:
    """(start, end, kind number, features) of candidate segments of a passage that touch no blocked span; features of all kinds are conjoined with the kind."""
    starts, ends = [x for x, _ in blocked], list(accumulate((y for _, y in blocked), max))

    def free(a: int, b: int) -> bool:
        before = bisect_left(starts, b)  # the blocked spans that start before b; they are in order
        return before == 0 or ends[before - 1] <= a

    out = []
    for m in SPELLED.finditer(text):
        span = m[0]
        at = "sign" if "@" in span else "bracket" if re.search(r"[\[(] ?at", span, re.I) else "word"
        tail = re.split(DOT, span)[-1]
        dot = "bracket" if re.search(r"[\[(] ?dot", span, re.I) else "word" if " dot " in span else "spaced" if re.search(r" \.|\. ", span) else "sign"
        features = [f"at={at}", f"dot={dot}", f"at+dot={at}+{dot}", f"tail={len(tail) if len(tail) < 5 else 5}", f"tailalpha={tail.isalpha()}", f"labels={len(re.split(DOT, span))}",
                    f"before={char_class(text, m.start() - 1)}", f"after={char_class(text, m.end())}", f"cue={cue_before(text, m.start())}"]
        if len(span) <= MAX_CHARS and free(*m.span()):
            out.append((*m.span(), 0, features))
    for run in RUN.finditer(text):
        groups = [g.span() for g in GROUP.finditer(text, *run.span())]
        for i, (a, _) in enumerate(groups):
            firsts = [a, a - 1] if a > run.start() and text[a - 1] in "+(" else [a]
            for j in range(i, min(len(groups), i + MAX_GROUPS)):
                b = groups[j][1]
                if b - a > MAX_CHARS or sum(y - x for x, y in groups[i : j + 1]) > 19:
                    break
                for s in firsts:
                    if free(s, b):
                        out += [(s, b, kind, f) for kind, f in number_features(text, run.span(), s, b)]
    return [(a, b, k, [f"{KINDS[k]}:{f}" for f in (*fs, "bias")]) for a, b, k, fs in out]


def best_segments(segments: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Segments (start, end, kind, score) of the best segmentation; what lies outside scores 0."""
    best, chosen = {0: 0.0}, {0: ()}
    spots = sorted({0} | {x for a, b, *_ in segments for x in (a, b)})
    ends = defaultdict(list)
    for s in segments:
        ends[s[1]].append(s)
    last = 0
    for p in spots[1:] if spots[0] == 0 else spots:
        best[p], chosen[p] = best[last], chosen[last]
        for a, _, kind, score in ends[p]:
            if best[a] + score > best[p]:
                best[p], chosen[p] = best[a] + score, (a, p, kind, chosen[a])
        last = p
    out, link = [], chosen[last]
    while link:
        out.append(link[:3])
        link = link[3]
    return out[::-1]


def marginals(segments: list[tuple[int, int, int, float]]) -> tuple[float, list[float]]:
    """Log of the sum over all segmentations, and each segment's probability (forward and backward sums over boundaries)."""
    spots = sorted({x for a, b, *_ in segments for x in (a, b)})
    place = {x: i for i, x in enumerate(spots)}
    forward, backward = [0.0] * len(spots), [0.0] * len(spots)
    ends, starts = defaultdict(list), defaultdict(list)
    for a, b, _, s in segments:
        ends[place[b]].append((place[a], s))
        starts[place[a]].append((place[b], s))
    for i in range(1, len(spots)):
        forward[i] = log_sum([forward[i - 1], *(forward[a] + s for a, s in ends[i])])
    for i in range(len(spots) - 2, -1, -1):
        backward[i] = log_sum([backward[i + 1], *(backward[b] + s for b, s in starts[i])])
    total = forward[-1]
    return total, [math.exp(forward[place[a]] + s + backward[place[b]] - total) for a, b, _, s in segments]


def log_sum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def rewritings(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Training passages made from a passage with one base span: the span as it stands and in other spellings, and look-alikes."""
    if len(spans) != 1:
        return []
    kind, a, b = spans[0]
    span, digits = text[a:b], NOT_DIGIT.sub("", text[a:b])
    new: list[str] = [span]
    if kind == 0:
        user, _, host = span.partition("@")
        new += [f"{user} at {host.replace('.', ' dot ')}", f"{user} (at) {host.replace('.', ' (dot) ')}", f"{user}[at]{host.replace('.', '[dot]')}", f"{user} @ {host}",
                f"{user} [at] {host}", f"{user}(at){host}", f"{user} (at) {host}", f"{user}[at]{host}"]
    elif kind == 2:
        flipped = digits[:-1] + str((int(digits[-1]) + 3) % 10)
        new += [" ".join(digits[i : i + 4] for i in range(0, len(digits), 4)), "-".join(digits[i : i + 4] for i in range(0, len(digits), 4)), flipped, " ".join(flipped[i : i + 4] for i in range(0, len(flipped), 4))]
    elif kind == 3:
        d = digits[-10:].rjust(10, "5")
        new += [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"{d[:3]} {d[3:6]} {d[6:]}"]
    d = digits.rjust(12, "7")
    plain = [f"20{d[:2]}-0{int(d[2]) % 9 + 1}-1{d[3]}", f"1{d[4]}.0{int(d[2]) % 9 + 1}.20{d[:2]}", f"{d[:3]},{d[3:6]}.00", d[:8], d[:10], f"{d[0]}.{d[1:9]}", f"{d[0]}.{d}{d[:3]}", f"20{d[:2]}-20{d[2:4]}",
             f"{d[0]}.{d[1:3]}.{d[3:5]}", f"{d[:3]} {d[3:6]} {d[6:9]}", f"{d[:4]} {d[4:8]}", f"{d[:2]}:{d[2:4]}", "look at the. Then"]
    made = [(text[:a] + x + text[b:], [(kind, a, a + len(x))]) for x in new]
    if kind == 0:  # a plain "at" before a host is an address only where a word before says so
        made += [(text[:a] + f"{cue} {user} at {host}" + text[b:], [(kind, a + len(cue) + 1, a + len(f"{cue} {user} at {host}"))]) for cue in ("mail", "write to")]
        plain += [f"found at {host}", f"read more at www.{host}"]
    return made + [(text[:a] + x + text[b:], []) for x in plain]


def train(examples: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-3) -> dict[str, float]:
    """Feature weights by stochastic gradient ascent on the conditional log-likelihood of the gold segmentations."""
    index: dict[str, int] = {}
    data = []
    for text, gold in examples:
        found = candidates(text, [])
        held = {(a, b, k) for k, a, b in gold}
        if not found or not held <= {s[:3] for s in found}:
            continue
        data.append([(a, b, k, np.array([index.setdefault(f, len(index)) for f in fs]), (a, b, k) in held) for a, b, k, fs in found])
    w, seen = np.zeros(len(index)), np.full(len(index), 1e-6)
    for _ in range(epochs):
        for segments in data:
            scored = [(a, b, k, float(w[x].sum())) for a, b, k, x, _ in segments]
            _, probability = marginals(scored)
            for (_, _, _, x, gold), p in zip(segments, probability):
                g = (gold - p) - decay * w[x]
                seen[x] += g * g
                w[x] += rate * g / np.sqrt(seen[x])
    return {f: float(w[i]) for f, i in index.items()}


def find(text: str, weights: dict[str, float], threshold: float = 0.0) -> list[tuple[str, int, int, bool]]:
    """All spans of a text by kind and start: base ones, and what the field adds with a score above the threshold beside them."""
    base = base_spans(text)
    found = [(*s, True) for s in base]
    if weights:
        by_place = sorted((x, y) for _, x, y in base)
        starts, ends = [x for x, _ in by_place], list(accumulate((y for _, y in by_place), max))
        for a, b in passages(text):
            # Spans that start before b and reach beyond a: in order of their starts, with the furthest end so far, they are neighbours.
            near = by_place[bisect_right(ends, a) : bisect_left(starts, b)]
            blocked = [(x - a, y - a) for x, y in near if y > a]
            segments = [(s, e, k, sum(weights.get(f, 0.0) for f in fs) - threshold) for s, e, k, fs in candidates(text[a:b], blocked)]
            found += [(k, a + s, a + e, False) for s, e, k in best_segments([s for s in segments if s[3] > 0])]
    return [(KINDS[k], a, b, is_base) for k, a, b, is_base in sorted(found)]


def fit(docs: DataFrame, text_col: str = "text", train_passages: int = TRAIN_PASSAGES) -> dict[str, float]:
    """Weights from the train_passages passages with one base span that have the smallest hashes, whatever the size of docs."""

    def gold(batches):
        for batch in batches:
            rows = []
            for value in batch["passage_text"]:
                text = text_or_empty(value)
                base = base_spans(text)
                for a, b in passages(text) if base else ():
                    held = [(k, x - a, y - a) for k, x, y in base if a <= x and y <= b]
                    if len(held) == 1 and b - a <= 4 * CONTEXT:
                        rows.append((text[a:b], *held[0]))
            yield pd.DataFrame(rows, columns=["passage", "kind", "a", "b"])

    texts = docs.select(F.col(text_col).alias("passage_text")).where(F.col("passage_text").rlike("[0-9@]"))
    found = texts.mapInPandas(gold, "passage string, kind int, a int, b int")
    sample = found.distinct().orderBy(F.xxhash64("passage"), "passage").limit(train_passages).collect()
    return train([e for r in sample for e in rewritings(r.passage, [(r.kind, r.a, r.b)])])


def find_spans(docs: DataFrame, weights: dict[str, float], text_col: str = "text", into: str = "spans") -> DataFrame:
    """docs with one more column `into` of all spans by kind and start (a column of that name is replaced)."""
    held = docs.sparkSession.sparkContext.broadcast(weights)
    search = lambda: lambda texts: [find(text_or_empty(t), held.value) for t in texts]
    return computed(docs.drop(into), text_col, into, SPAN_TYPE, search)


def mask(docs: DataFrame, weights: dict[str, float], text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; a null text stays null."""
    held = docs.sparkSession.sparkContext.broadcast(weights)
    rewrite = lambda: lambda texts: [None if t is None else masked(t, held.value) for t in texts]
    return computed(docs, text_col, text_col, docs.schema[text_col].dataType, rewrite)


def masked(text: str, weights: dict[str, float]) -> str:
    out, at = [], 0
    for kind, a, b, _ in sorted(find(text, weights), key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
