"""Personal data in texts: base patterns, and whole spans by a semi-Markov
conditional random field."""

from __future__ import annotations

import hashlib
import pickle
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.textscan import hash_sums, sums_hash

#: Kinds in the order in which spans are listed; the last one has no base pattern.
KINDS = ("email", "ip", "card", "phone", "secret")

#: The base patterns.  Possessive repeats and the look-behind change no
#: match (what follows a repeat is never in its class) and keep the search linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the base patterns (kind, start, end) in order of kind and start."""
    out: list[tuple[str, int, int]] = []
    # An address starts after the last character that cannot be in its local part,
    # or where the match before it ends.
    ended = before = 0
    at = text.find("@")
    while at >= 0:
        run = text[max(ended, before) : at]
        local = len(run) - len(run.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at) if local else None
        before = at + 1
        if found:
            out.append(("email", at - local, found.end()))
            ended = found.end()
        at = text.find("@", before)
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_byte, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


@dataclass(frozen=True)
class PersonalSpec:
    """tokens, chars: of the longest span the field can find; margin: characters
    around a digit or an at sign that are looked at; sample: stretches with such a
    character, and as many without, that are learned from at most; epochs, rate and
    penalty: of the training."""

    tokens: int = 20
    chars: int = 80
    margin: int = 64
    sample: int = 600
    epochs: int = 20
    rate: float = 0.5
    penalty: float = 1e-3
    seed: int = 7


# -- tokens --------------------------------------------------------------------
_TOKEN = re.compile(r"[^\W_]+|\s+|.", re.S)
_TRIGGER = re.compile(r"[0-9@]+|[\[({] ?at ?[\])}]", re.I)
(_BORDER, _BLANK, _DIGITS3, _DIGITS4, _DIGITS, _LETTERS, _MIXED, _RANDOM, _AT, _DOT, _PLUS, _OPEN, _CLOSE, _DASH,
 _QUOTE, _EQUALS, _SLASH, _AT_WORD, _DOT_WORD, _OTHER) = range(20)
_CLASSES = 20
_MARKS = {
    "@": _AT, ".": _DOT, "+": _PLUS, "(": _OPEN, "[": _OPEN, "{": _OPEN, ")": _CLOSE, "]": _CLOSE, "}": _CLOSE,
    "-": _DASH, '"': _QUOTE, "'": _QUOTE, "=": _EQUALS, ":": _EQUALS, "/": _SLASH,
}


def _class(token: str) -> int:
    c = token[0]
    if c in _MARKS:
        return _MARKS[c]
    if c.isspace():
        return _BLANK
    if not c.isalnum():
        return _OTHER
    if token.isascii() and token.isdigit():
        return _DIGITS3 if len(token) < 4 else _DIGITS4 if len(token) == 4 else _DIGITS
    if not any("0" <= x <= "9" for x in token):
        low = token.lower()
        return _AT_WORD if low == "at" else _DOT_WORD if low == "dot" else _LETTERS
    return _RANDOM if len(token) >= 16 else _MIXED


def regions(text: str, spec: PersonalSpec) -> list[tuple[int, int]]:
    """Stretches around digits and at signs; no span lies outside, none crosses two."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - spec.margin), min(len(text), m.end() + spec.margin)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


class Lattice:
    """Tokens of many stretches in a row, a border between them, and the segments
    that may be spans: they start and end with a token that is not blank, hold a
    digit or an at sign, cross no border and keep within the spec's lengths."""

    def __init__(self, stretches: list[str], spec: PersonalSpec):
        kinds, starts, ends, text_of, tokens = [_BORDER], [0], [0], [-1], [""]
        for i, text in enumerate(stretches):
            for m in _TOKEN.finditer(text):
                token = m.group()
                kinds.append(_class(token))
                starts.append(m.start())
                ends.append(m.end())
                text_of.append(i)
                tokens.append(token if len(token) <= spec.chars else token[: spec.chars])
            kinds.append(_BORDER)
            starts.append(len(text))
            ends.append(len(text))
            text_of.append(-1)
            tokens.append("")
        self.kinds = np.array(kinds, np.uint8)
        self.starts, self.ends, self.text_of = np.array(starts), np.array(ends), np.array(text_of)
        n = len(kinds)
        digit = np.array([sum("0" <= c <= "9" for c in t) for t in tokens])
        letter = np.array([sum(c.isalpha() for c in t) for t in tokens])
        self._digits, self._letters = np.r_[0, np.cumsum(digit)], np.r_[0, np.cumsum(letter)]
        trigger = (digit > 0) | (self.kinds == _AT)
        trigger[1:] |= (self.kinds[1:] == _AT_WORD) & (self.kinds[:-1] == _OPEN)
        triggers = np.r_[0, np.cumsum(trigger)]
        borders = np.r_[0, np.cumsum(self.kinds == _BORDER)]
        first, last = [], []
        solid = (self.kinds != _BLANK) & (self.kinds != _BORDER)
        for size in range(1, spec.tokens + 1):
            a = np.arange(max(n - size + 1, 0))
            b = a + size
            ok = solid[a] & solid[b - 1] & (triggers[b] > triggers[a]) & (borders[b] == borders[a])
            ok &= self.ends[b - 1] - self.starts[a] <= spec.chars
            first.append(a[ok])
            last.append(b[ok])
        a, b = np.concatenate(first), np.concatenate(last)
        order = np.lexsort((a, b))
        self.first, self.last = a[order], b[order]
        self.features = self._features(tokens)

    #: Sizes of the tables of weights, one per feature of a segment.
    SIZES = (1, 32, 96, 48, 40, 24, 36, _CLASSES**2, _CLASSES**2, 1024, 4096, 3, 3, 3)

    def _features(self, tokens: list[str]) -> np.ndarray:
        """Row per segment: its place in each of the tables, told by the whole span."""
        a, b, kinds = self.first, self.last, self.kinds
        n_digits, n_letters = self._digits[b] - self._digits[a], self._letters[b] - self._letters[a]

        def number(kind: int) -> np.ndarray:
            sums = np.r_[0, np.cumsum(kinds == kind)]
            return sums[b] - sums[a]

        chars = self.ends[b - 1] - self.starts[a]
        words = np.array([crc32(t.lower().encode()) % 1023 + 1 if t[:1].isalpha() else 0 for t in tokens])
        before = np.maximum.accumulate(np.where(words > 0, np.arange(len(words)), 0))
        edge = np.maximum.accumulate(np.where(kinds == _BORDER, np.arange(len(kinds)), 0))
        word = before[a - 1]
        word = np.where((word > edge[a - 1]) & (a - word <= 6), words[word], 0)
        shape = sums_hash(hash_sums(kinds), a, b) % np.uint64(4096)
        check, address = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        for k in np.flatnonzero((n_digits >= 13) & (n_digits <= 19) & (n_letters == 0)).tolist():
            digits = "".join(t for t in tokens[a[k] : b[k]] if t.isdigit() and t.isascii())
            check[k] = 1 if digits and luhn(digits) else 2
        for k in np.flatnonzero((b - a == 7) & (number(_DOT) == 3) & (n_letters == 0)).tolist():
            parts = tokens[a[k] : b[k] : 2]
            if all(p.isdigit() and p.isascii() for p in parts):
                address[k] = 1 if all(map(_byte, parts)) else 2
        columns = (
            np.zeros(len(a), np.int64),
            b - a,
            np.minimum(chars, 95),
            np.minimum(n_digits, 47),
            np.minimum(n_letters, 79) // 2,
            np.minimum(number(_AT), 3) * 6 + np.minimum(number(_DOT), 5),
            np.minimum(number(_BLANK), 5) * 6 + np.minimum(number(_DASH), 5),
            kinds[a].astype(np.int64) * _CLASSES + kinds[b - 1],
            kinds[a - 1].astype(np.int64) * _CLASSES + kinds[b],
            word,
            shape.astype(np.int64),
            check,
            address,
            np.minimum(number(_RANDOM), 2),
        )
        offsets = np.cumsum((0, *self.SIZES[:-1]))
        return np.stack([np.asarray(c, np.int64) for c in columns], axis=1) + offsets


@dataclass
class PersonalModel:
    """spans: weight per feature and kind; plain: per class of a token outside
    spans; moves: from a label to the next (0: outside, then the kinds)."""

    spans: np.ndarray
    plain: np.ndarray
    moves: np.ndarray

    @classmethod
    def start(cls) -> PersonalModel:
        labels = len(KINDS) + 1
        return cls(np.zeros((sum(Lattice.SIZES), len(KINDS))), np.zeros(_CLASSES), np.zeros((labels, labels)))


def _scores(model: PersonalModel, lattice: Lattice) -> np.ndarray:
    out = np.zeros((len(lattice.first), len(KINDS)))
    for k in range(lattice.features.shape[1]):
        out += model.spans[lattice.features[:, k]]
    return out


def best_segments(model: PersonalModel, lattice: Lattice) -> list[tuple[int, int, int]]:
    """First token, end and kind of the spans of the best segmentation of all tokens.

    Spans are bounded, so a token's best score needs the scores of the ``tokens``
    before it only: one pass, whatever a text's length."""
    n = len(lattice.kinds)
    labels = len(KINDS) + 1
    scores = _scores(model, lattice)
    plain = model.plain[lattice.kinds]
    cut = np.searchsorted(lattice.last, np.arange(n + 2))
    reach = np.full((n + 1, labels), -np.inf)  # best score before a segment of each label
    came = np.zeros((n + 1, labels), np.int8)
    from_segment = np.full((n + 1, labels), -1, np.int64)
    best = np.full(labels, -np.inf)
    best[0] = 0.0
    empty = np.full(labels, -np.inf)
    moves = model.moves
    for t in range(n + 1):
        if t:
            best = empty.copy()
            best[0] = reach[t - 1, 0] + plain[t - 1]
            low, high = cut[t], cut[t + 1]
            if low < high:
                found = reach[lattice.first[low:high], 1:] + scores[low:high]
                k = found.argmax(axis=0)
                best[1:] = found[k, np.arange(labels - 1)]
                from_segment[t, 1:] = low + k
        step = best[:, None] + moves
        came[t] = step.argmax(axis=0)
        reach[t] = step[came[t], np.arange(labels)]
    out, t, label = [], n, int(best.argmax())
    while t > 0:
        if label:
            k = int(from_segment[t, label])
            out.append((int(lattice.first[k]), t, label - 1))
            t = int(lattice.first[k])
        else:
            t -= 1
        label = int(came[t, label])
    return out[::-1]


# -- training ------------------------------------------------------------------
def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class _Batch:
    """Stretches of a lattice as rows of equal length, for all their sums at once."""

    def __init__(self, lattice: Lattice, gold: set[tuple[int, int, int]], spec: PersonalSpec):
        self.lattice, self.spec = lattice, spec
        borders = np.flatnonzero(lattice.kinds == _BORDER)
        self.begin = borders[:-1] + 1
        sizes = np.diff(borders) - 1
        self.rows, self.length = len(sizes), int(sizes.max()) + 1
        # Places after a row's end count as plain tokens without weight.
        place = np.arange(self.length)
        self.inside = place < sizes[:, None]
        self.kinds = lattice.kinds[np.minimum(self.begin[:, None] + place, len(lattice.kinds) - 1)]
        self.row = np.searchsorted(self.begin, lattice.first, side="right") - 1
        self.end = lattice.last - self.begin[self.row]
        self.size = lattice.last - lattice.first
        self.gold = np.zeros((len(lattice.first), len(KINDS)))
        numbers = {(int(a), int(b)): k for k, (a, b) in enumerate(zip(lattice.first, lattice.last, strict=True))}
        self.path = np.zeros((self.rows, self.length + 1), np.int64)  # label that ends here; -1: within a span
        for a, b, kind in gold:
            k = numbers.get((a, b))
            if k is not None:
                self.gold[k, kind] = 1
                r = self.row[k]
                self.path[r, self.end[k] - self.size[k] + 1 : self.end[k]] = -1
                self.path[r, self.end[k]] = kind + 1

    def gradient(self, model: PersonalModel) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Mean log-likelihood and its slopes, by forward and backward sums."""
        kinds, wide = len(KINDS), self.spec.tokens
        scores = _scores(model, self.lattice)
        table = np.full((self.rows, self.length + 1, wide + 1, kinds), -np.inf, np.float32)
        table[self.row, self.end, self.size] = scores
        plain = np.where(self.inside, model.plain[self.kinds], 0.0)
        labels = kinds + 1
        ahead = np.full((self.rows, self.length + 1, labels), -np.inf)
        reach = np.full((self.rows, self.length + 1, labels), -np.inf)
        ahead[:, 0, 0] = 0.0
        for t in range(self.length + 1):
            if t:
                ahead[:, t, 0] = reach[:, t - 1, 0] + plain[:, t - 1]
                d = np.arange(1, min(wide, t) + 1)
                ahead[:, t, 1:] = _log_sum(reach[:, t - d, 1:] + table[:, t, d], 1)
            reach[:, t] = _log_sum(ahead[:, t, :, None] + model.moves, 1)
        whole = _log_sum(ahead[:, -1], 1)
        behind = np.zeros((self.rows, self.length + 1, labels))
        follow = np.full((self.rows, self.length + 1, labels), -np.inf)
        for t in range(self.length - 1, -1, -1):
            follow[:, t, 0] = plain[:, t] + behind[:, t + 1, 0]
            d = np.arange(1, min(wide, self.length - t) + 1)
            follow[:, t, 1:] = _log_sum(table[:, t + d, d] + behind[:, t + d, 1:], 1)
            behind[:, t] = _log_sum(model.moves + follow[:, t, None, :], 2)
        r, e, s = self.row, self.end, self.size
        chance = np.exp(reach[r, e - s, 1:] + scores + behind[r, e, 1:] - whole[r, None])
        outside = np.exp(reach[:, :-1, 0] + plain + behind[:, 1:, 0] - whole[:, None])
        moved = np.exp(
            ahead[:, :-1, :, None] + model.moves + follow[:, :-1, None, :] - whole[:, None, None, None]
        ).sum(axis=(0, 1))
        truly = np.zeros_like(model.moves)
        gold_plain = np.zeros(_CLASSES)
        score = (self.gold * scores).sum()
        for row in range(self.rows):
            path = self.path[row][self.path[row] >= 0]
            np.add.at(truly, (path[:-1], path[1:]), 1)
        out_gold = (self.path[:, 1:] == 0) & self.inside
        np.add.at(gold_plain, self.kinds[out_gold], 1)
        score += (truly * model.moves).sum() + (gold_plain * model.plain).sum()
        by_span = np.zeros_like(model.spans)
        rest = self.gold - chance
        for k in range(self.lattice.features.shape[1]):
            for y in range(kinds):
                by_span[:, y] += np.bincount(self.lattice.features[:, k], rest[:, y], len(by_span))
        by_plain = gold_plain - np.bincount(self.kinds[self.inside], outside[self.inside], _CLASSES)
        n = max(self.rows, 1)
        return (score - whole.sum()) / n, by_span / n, by_plain / n, (truly - moved) / n


#: What a secret is called; used to label what is learned from.
_CALLED = ("token", "api_key", "apikey", "secret", "password", "auth", "access key", "private key", "client_secret")
_SECRET = re.compile(
    r"(?:token|key|secret|password|auth)\w*\s{0,2}[=:]\s{0,2}[\"']?([A-Za-z0-9]{16,64})(?![A-Za-z0-9])", re.I
)


def _planted(made: random.Random, words: list[str]) -> tuple[str, str | None, str]:
    """A stretch (before, after) and in between a span of a kind, or of none."""

    def digits(n: int) -> str:
        return "".join(made.choices("0123456789", k=n))

    def letters(n: int, of: str = "abcdefghijklmnopqrstuvwxyz0123456789") -> str:
        return "".join(made.choices(of, k=n))

    def card() -> str:
        body = made.choice("3456") + digits(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    word = lambda: re.sub(r"\W", "", made.choice(words)) or "name"
    tld = made.choice(("com", "org", "net", "de", "fr", "co.uk", "io", "example.com"))
    kind = made.choice((*KINDS, None, None, None))
    if kind == "email":
        name = made.choice((word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}.{digits(2)}", f"{word()}_{word()}"))
        form = made.choice(("{a}@{b}.{c}", "{a}@{b}{n}.{c}", "{a} (at) {b} (dot) {c}", "{a}[at]{b}.{c}", "{a} [at] {b} [dot] {c}",
                            "{a} @ {b}.{c}", "{a}@{b} . {c}", "{a} at {b}{n} dot {c}"))
        span = form.format(a=name, b=word(), c=tld.replace(".", " (dot) ") if "(dot)" in form else tld, n=digits(1))
    elif kind == "ip":
        span = ".".join(str(made.randint(0, 255)) for _ in range(4))
    elif kind == "card":
        c = card()
        gap = made.choice(("", "", " ", "-", ".", "/", "_"))
        span = gap.join((c[:4], c[4:8], c[8:12], c[12:]))
    elif kind == "phone":
        a, b, c = digits(3), digits(3), digits(4)
        span = made.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+44 20 {c} {digits(4)}", f"{a}.{b}.{c}",
                            f"00{digits(2)} {a} {digits(7)}", f"+{digits(2)}-{a}-{b}{c}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}"))
    elif kind == "secret":
        span = made.choice((letters(40, "0123456789abcdef"), letters(32, "0123456789abcdef"), letters(24), letters(20).upper(),
                            letters(36, "ABCDEFGHJKLMNPQRSTUVabcdefghijklmnop0123456789")))
    else:
        span = made.choice((
            f"20{digits(2)}-0{made.randint(1, 9)}-{made.randint(10, 28)}", f"{made.randint(10, 28)}.0{made.randint(1, 9)}.19{digits(2)}",
            f"{made.randint(10, 12)}:{made.randint(10, 59)}:{made.randint(10, 59)}", f"${digits(1)},{digits(3)}.{digits(2)}",
            f"v{digits(1)}.{digits(2)}.{digits(1)}", digits(made.randint(1, 8)), f"{digits(2)}.{digits(1)}%", f"{digits(2)}-{digits(2)}",
            f"{digits(2)}.{digits(4)}, {digits(1)}.{digits(4)}", f"@{word()}", f"@{word()}{digits(2)}", f"A-{digits(5)}-{digits(2)}",
            f"{digits(4)}x{digits(4)}", f"No. {digits(12)}", f"{word()}{digits(3)}", f"{digits(3)} {digits(3)} {digits(3)}",
            f"{digits(3)}.{digits(3)}.{digits(1)}", f"({digits(4)})", f"{digits(2)}/{digits(2)}/{digits(4)}", f"1{digits(3)}.{digits(3)},{digits(2)}",
            f"{letters(8, '0123456789abcdef')}", f"#{letters(6, '0123456789abcdef')}",
        ))
        bad = card()
        if made.random() < 0.15:
            span = bad[:-1] + str((int(bad[-1]) + 1) % 10)
    lead = made.choice(("", "", "", "(", '"', ": ", "*** "))
    if kind == "secret":
        lead = made.choice(_CALLED) + made.choice((' = "', ": ", "=", " = '"))
    tail = made.choice(("", "", "", ")", '"', ",", ".", " ***", "###", ";", "!!"))
    return lead, kind, span + "\0" + tail


def labelled_stretch(text: str, plant: bool, spec: PersonalSpec) -> tuple[str, list[tuple[int, int, int]]]:
    """A stretch with its spans (start, end, kind): those of the base patterns and of
    named secrets, or one that is planted between its words by a rule."""
    if not plant:
        spans = [(a, b, KINDS.index(k)) for k, a, b in base_spans(text)]
        spans += [(m.start(1), m.end(1), KINDS.index("secret")) for m in _SECRET.finditer(text)]
        free: list[tuple[int, int, int]] = []
        for a, b, k in sorted(spans):
            if not free or a >= free[-1][1]:
                free.append((a, b, k))
        return text, free
    made = random.Random(crc32(text.encode()) ^ spec.seed)
    words = text.split() or ["a"]
    lead, kind, rest = _planted(made, words)
    span, tail = rest.split("\0")
    cut = made.randint(0, len(words))
    before, after = " ".join(words[:cut][-6:]), " ".join(words[cut:][:5])
    head = (before + " " if before else "") + lead
    whole = head + span + tail + (" " + after if after else "")
    return whole, [] if kind is None else [(len(head), len(head) + len(span), KINDS.index(kind))]


def fit(stretches: list[tuple[str, bool]], spec: PersonalSpec) -> PersonalModel:
    """Weights of greatest penalised likelihood, by Adagrad over all stretches."""
    model = PersonalModel.start()
    labelled = [labelled_stretch(t, plant, spec) for t, plant in stretches]
    if not labelled:
        return model
    lattice = Lattice([t for t, _ in labelled], spec)
    token_from = {(int(i), int(a)): k for k, (i, a) in enumerate(zip(lattice.text_of, lattice.starts, strict=True)) if i >= 0}
    token_to = {(int(i), int(b)): k + 1 for k, (i, b) in enumerate(zip(lattice.text_of, lattice.ends, strict=True)) if i >= 0}
    gold = {
        (token_from[i, a], token_to[i, b], kind)
        for i, (_, spans) in enumerate(labelled) for a, b, kind in spans
        if (i, a) in token_from and (i, b) in token_to
    }
    batch = _Batch(lattice, gold, spec)
    parts = (model.spans, model.plain, model.moves)
    sums = [np.full_like(p, 1e-6) for p in parts]
    for _ in range(spec.epochs):
        _, *slopes = batch.gradient(model)
        for part, slope, total in zip(parts, slopes, sums, strict=True):
            slope -= spec.penalty * part
            total += slope**2
            part += spec.rate * slope / np.sqrt(total)
    return model


def _stretches(spec: PersonalSpec):
    """Up to two stretches of a text with digits or at signs, and one without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = 3 * spec.margin
        for batch in batches:
            rows: list[tuple[str, bool]] = []
            for text in batch.column("text").to_pylist():
                if not text:
                    continue
                met = regions(text, spec) if _TRIGGER.search(text) else []
                rows += [(text[a : min(b, a + limit)], False) for a, b in met[:2]]
                rows.append((" ".join(text[: 4 * spec.margin].split()[:24]), True))
            rows = [r for r in rows if r[1] is False or not _TRIGGER.search(r[0])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())],
                names=["stretch", "plant"],
            )

    return run


def train(docs: DataFrame, spec: PersonalSpec = PersonalSpec()) -> PersonalModel:
    """Learn the field's weights from a bounded sample of ``docs`` (text).

    At most ``sample`` stretches of text around digits or at signs, labelled by the
    base patterns and by what secrets are called, and as many plain ones, into
    which spans (and look-alikes: dates, prices, versions, failing card numbers)
    are planted in written forms that the patterns don't know.  Stretches are
    chosen by hash, so the sample is the same however the rows are dealt.  One task
    fits the weights; a few hundred kilobytes come to the driver.
    """
    met = docs.select("text").mapInArrow(_stretches(spec), "stretch string, plant boolean")
    chosen = [
        met.where(F.col("plant") == plant).distinct().orderBy(F.xxhash64("stretch"), "stretch").limit(spec.sample)
        for plant in (False, True)
    ]

    def fitted(groups: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(groups["stretch"], groups["plant"], strict=True))
        return pd.DataFrame({"model": [pickle.dumps(fit(rows, spec))]})

    sample = chosen[0].unionByName(chosen[1]).withColumn("task", F.lit(0))
    rows = sample.groupBy("task").applyInPandas(fitted, "model binary").collect()
    return pickle.loads(bytes(rows[0]["model"])) if rows else PersonalModel.start()


# -- search --------------------------------------------------------------------
_RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
_NAMES = [part.split()[0] for part in _RESULT.split(", ")]


def _written(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def _finder(model: PersonalModel, spec: PersonalSpec):
    def added(places: list[tuple[int, int]], texts: list[str]) -> list[tuple[int, str, int, int]]:
        lattice = Lattice(texts, spec)
        out = []
        for a, b, kind in best_segments(model, lattice):
            row, offset = places[lattice.text_of[a]]
            out.append((row, KINDS[kind], offset + int(lattice.starts[a]), offset + int(lattice.ends[b - 1])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base: dict[int, list[tuple[str, int, int]]] = {}
            more: dict[int, list[tuple[str, int, int]]] = {}
            places: list[tuple[int, int]] = []
            texts: list[str] = []
            size = 0

            def decode() -> None:
                for row, kind, a, b in added(places, texts):
                    more.setdefault(row, []).append((kind, a, b))
                places.clear()
                texts.clear()

            column = batch.column("text")
            for i in range(batch.num_rows):
                text = column[i].as_py()
                if not text or not _TRIGGER.search(text):
                    continue
                base[i] = base_spans(text)
                for a, b in regions(text, spec):
                    places.append((i, a))
                    texts.append(text[a:b])
                    size += b - a
                if size > 1 << 18:
                    decode()
                    size = 0
            if texts:
                decode()
            columns: list[list] = [[] for _ in _NAMES[1:]]
            for i in range(batch.num_rows):
                sure = base.get(i, [])
                extra = more.get(i, [])
                if sure and extra:
                    taken = np.array(sorted((a, b) for _, a, b in sure))
                    furthest = np.r_[-1, np.maximum.accumulate(taken[:, 1])]
                    before = np.searchsorted(taken[:, 0], [b for _, _, b in extra])
                    extra = [s for s, end in zip(extra, furthest[before].tolist(), strict=True) if end <= s[1]]
                counts = [sum(k == kind for k, _, _ in sure) for kind in KINDS[:4]]
                digest = hashlib.sha256(_written(sure).encode()).hexdigest()
                row = (*counts, digest, _written(sure + extra), len(extra))
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=_NAMES)

    return run


def find_personal_data(docs: DataFrame, model: PersonalModel, spec: PersonalSpec = PersonalSpec()) -> DataFrame:
    """Row per document: how often each base pattern matches, a digest of these
    matches, all spans, and how many of them the field added.

    Spans are ``kind:start:end`` in code points, the end excluded, by kind and start.
    Around digits and at signs the field scores every segment of up to ``tokens``
    tokens as a whole (its length, digits, shape, checksum, neighbours) and takes the
    best segmentation of the text into spans and plain tokens.  Its spans are added
    where no base span overlaps them; base spans stay.

    Null or empty text: no spans, the digest of an empty string.  Repeated rows and
    a null doc_id come back as they are; extra columns are ignored; an empty table
    gives an empty one.  Long texts are decoded in stretches, so memory is bounded.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_finder(model, spec), _RESULT)
