"""Personal data (operator 3): fixed patterns, and a character BiLSTM with CRF transitions that adds what they don't catch.

The tagger. Characters fall into about 60 classes; a bidirectional LSTM reads windows of WINDOW characters and gives each character a score
for each tag (outside; begin and inside of each kind), and a CRF adds transition scores, with inside tags only after their own kind. It is
trained in numpy, by backpropagation through time and the CRF's forward-backward sums, from labelled spans that `examples` makes; nothing of
a corpus is in them. Its trained parameters lie beside this module (``python -m quietframe.llm.pii`` trains and writes them anew). It adds
what no pattern of the base can have: addresses with gaps or brackets, local phone numbers, card numbers with a wrong digit (Luhn fails) or
with dots, and secrets: keys, tokens and passwords that text assigns (kind `secret`, listed after the base's kinds).

Windows overlap by half, so any span of up to half a window lies whole in one. Each window is decoded by Viterbi. Its spans, with their score
over "outside", are candidates; a span that runs to a window's edge inside the text joins the neighbour's span of its kind that it touches.
A candidate must have the shape of its kind (number of digits, an "@", dots) and must not overlap a span of the base, and what fails is
put aside at once. Of the rest of a document the set without overlaps that has the largest total score is taken (weighted interval
scheduling), so no span that fails can displace one that fits. Base spans all stay.

Every shape has a digit or an "@", and so must every candidate or part of one. So a window without either can't change the result, and only
windows with one are run; a test holds that against running all windows.

Scale: a narrow pass; the model is 70 kB of parameters in the tasks' closure, and windows are run 2,048 at a time.

Defined results. Null and empty texts have no spans. Repeated rows have the same spans. Places are code points, ends exclusive. An empty
table gives no rows. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietframe.llm.common import slices, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: The kinds that the tagger knows.
EVERY = (*KINDS, "secret")
PARAMETERS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_tagger.npz")
Span = tuple[str, int, int]

# The contract's patterns. Guards that change no match keep the search linear: a run of digits that fails from its start fails from any
# later place, and a run of local characters belongs to the "@" that ends it.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and start."""
    out: list[Span] = []
    if "@" in text:
        free = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > free and _LOCAL.match(text[start - 1]):
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                free = m.end()
    if not _TRIGGER.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group()) if m.end() - m.start() <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---- the tagger

WINDOW, STRIDE, HIDDEN = 128, 64, 24
TAGS = 1 + 2 * len(EVERY)
_MARKS = "@.-+ ()_%,:;/\n\t[]{}<>\"'=#*!?&|$"
CLASSES = 26 + 1 + len(_MARKS) + 3
_TABLE = np.full(128, CLASSES - 1, np.int64)
for _c in "abcdefghijklmnopqrstuvwxyz":
    _TABLE[ord(_c)] = _TABLE[ord(_c.upper())] = ord(_c) - 97
_TABLE[48:58] = 26
for _i, _c in enumerate(_MARKS):
    _TABLE[ord(_c)] = 27 + _i
OTHER, PAD = CLASSES - 2, CLASSES - 3
BAD = np.zeros((TAGS, TAGS), bool)
for _k in range(len(EVERY)):
    BAD[:, 2 + 2 * _k] = True
    BAD[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = False
_NEVER = -1e4


def classes_of(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(x < 128, _TABLE[np.minimum(x, 127)], OTHER)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(x: np.ndarray, E: np.ndarray, U: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """An LSTM over x (time, batch) of classes; its outputs (time, batch, HIDDEN) and what backward needs."""
    n, h_size = x.shape[1], U.shape[0]
    h, c = np.zeros((n, h_size), np.float32), np.zeros((n, h_size), np.float32)
    out, saved = np.empty((len(x), n, h_size), np.float32), []
    for t in range(len(x)):
        z = E[x[t]] + h @ U
        s = _sigmoid(z[:, : 3 * h_size])
        i, f, o, g = s[:, :h_size], s[:, h_size : 2 * h_size], s[:, 2 * h_size :], np.tanh(z[:, 3 * h_size :])
        before, last = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            saved.append((i, f, o, g, before, tc, last))
    return out, saved


def _back(x: np.ndarray, d_out: np.ndarray, U: np.ndarray, saved: list, E_shape: tuple) -> tuple[np.ndarray, np.ndarray]:
    dE, dU = np.zeros(E_shape, np.float32), np.zeros_like(U)
    dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g, before, tc, last = saved[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        np.add.at(dE, x[t], dz)
        dU += last.T @ dz
        dh, dc = dz @ U.T, dc * f
    return dE, dU


class Tagger:
    """Parameters: input and recurrent weights of both directions, output weights and bias, transitions, start scores."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        w = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
        self.p = {"Ef": w(CLASSES, 4 * HIDDEN), "Uf": w(HIDDEN, 4 * HIDDEN), "Eb": w(CLASSES, 4 * HIDDEN), "Ub": w(HIDDEN, 4 * HIDDEN), "W": w(2 * HIDDEN, TAGS), "b": w(TAGS), "T": w(TAGS, TAGS), "s": w(TAGS)}
        for k in ("Ef", "Eb"):
            self.p[k][:, HIDDEN : 2 * HIDDEN] += 1  # remember at first

    def emissions(self, x: np.ndarray, keep: bool = False):
        """Scores (time, batch, tag) of windows x (batch, time)."""
        xt = np.ascontiguousarray(x.T)
        f, sf = _run(xt, self.p["Ef"], self.p["Uf"], keep)
        b, sb = _run(xt[::-1], self.p["Eb"], self.p["Ub"], keep)
        h = np.concatenate([f, b[::-1]], axis=2)
        return h @ self.p["W"] + self.p["b"], (xt, h, sf, sb)

    def transitions(self) -> tuple[np.ndarray, np.ndarray]:
        start = self.p["s"].copy()
        start[2::2] = _NEVER
        return np.where(BAD, _NEVER, self.p["T"]).astype(np.float32), start

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of windows x with tags y, both (batch, time)."""
        e, (xt, h, sf, sb) = self.emissions(x, True)
        T, start = self.transitions()
        n, steps, yt = len(x), x.shape[1], y.T
        lse = lambda a, axis: (m := a.max(axis)) + np.log(np.exp(a - np.expand_dims(m, axis)).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = start + e[0]
        for t in range(1, steps):
            alpha[t] = e[t] + lse(alpha[t - 1][:, :, None] + T, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(T + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        d = np.exp(alpha + beta - z[None, :, None])
        rows = np.arange(n)
        gold = start[yt[0]] + sum(e[t][rows, yt[t]] for t in range(steps)) + sum(T[yt[t - 1], yt[t]] for t in range(1, steps))
        g: dict[str, np.ndarray] = {"T": np.zeros_like(T)}
        for t in range(1, steps):
            g["T"] += np.exp(alpha[t - 1][:, :, None] + T + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
            np.add.at(g["T"], (yt[t - 1], yt[t]), -1)
        for t in range(steps):
            d[t][rows, yt[t]] -= 1
        g["s"], g["b"] = d[0].sum(0), d.sum((0, 1))
        g["W"] = np.tensordot(h, d, ((0, 1), (0, 1)))
        dh = d @ self.p["W"].T
        g["Ef"], g["Uf"] = _back(xt, dh[:, :, :HIDDEN], self.p["Uf"], sf, self.p["Ef"].shape)
        g["Eb"], g["Ub"] = _back(xt[::-1], dh[::-1, :, HIDDEN:], self.p["Ub"], sb, self.p["Eb"].shape)
        return float((z - gold).mean()), {k: np.where(BAD, 0, v) / n if k == "T" else v / n for k, v in g.items()}

    def fit(self, examples: list[tuple[str, list[Span]]], epochs: int = 10, batch: int = 64, rate: float = 0.02, seed: int = 5) -> list[float]:
        """Adam over windows that start anywhere in the examples; the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        x = np.full((len(examples), WINDOW), PAD, np.int64)
        y = np.zeros((len(examples), WINDOW), np.int64)
        for r, (text, spans) in enumerate(examples):
            c = classes_of(text)[:WINDOW]
            x[r, : len(c)] = c
            for kind, a, b in spans:
                k = 1 + 2 * EVERY.index(kind)
                y[r, a] = k
                y[r, a + 1 : b] = k + 1
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        losses, t = [], 0
        for epoch in range(epochs):
            order, total = rng.permutation(len(x)), []
            for i in range(0, len(x), batch):
                loss, g = self.step(x[order[i : i + batch]], y[order[i : i + batch]])
                total.append(loss)
                t += 1
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                for k, a in g.items():
                    a = a * min(1, 5 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.99 * v[k] + 0.01 * a * a
                    self.p[k] -= (rate * 0.5 ** (epoch * 4 // epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
            losses.append(float(np.mean(total)))
        return losses

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags (batch, time) and each character's score over "outside"."""
        e, _ = self.emissions(x)
        T, start = self.transitions()
        score, back = start + e[0], []
        for t in range(1, len(e)):
            all_ = score[:, :, None] + T
            back.append(all_.argmax(1))
            score = all_.max(1) + e[t]
        tags = np.empty(x.shape, np.int64)
        tags[:, -1] = score.argmax(1)
        rows = np.arange(len(x))
        for t in range(len(e) - 2, -1, -1):
            tags[:, t] = back[t][rows, tags[:, t + 1]]
        gain = e[np.arange(len(e))[:, None], rows[None, :], tags.T] - e[:, :, 0]
        return tags, gain.T


_SHAPE = {"ip": re.compile(r"[0-9. ]+"), "card": re.compile(r"[0-9 .-]+"), "phone": re.compile(r"[0-9 .()+-]+"), "secret": re.compile(r"[A-Za-z0-9_+/=.-]{12,}")}


def fits(kind: str, text: str, a: int, b: int) -> bool:
    """Whether text[a:b] has the shape that a model span of this kind must have: marks and numbers of digits, and no letter or digit beside it."""
    found = text[a:b]
    digits = sum("0" <= c <= "9" for c in found)
    if kind == "email":
        return "@" in found and "." in found.partition("@")[2] and found[0] != "@"
    if not _SHAPE[kind].fullmatch(found) or text[max(0, a - 1) : a].isalnum() or text[b : b + 1].isalnum():
        return False
    if kind == "ip":
        return found.count(".") == 3 and 4 <= digits <= 12
    if kind == "card":
        return 13 <= digits <= 19
    if kind == "secret":
        return 0 < digits < len(found)
    return 7 <= digits <= 15


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without white space at its ends."""
    found = text[a:b]
    return a + len(found) - len(found.lstrip()), b - len(found) + len(found.rstrip())


def window_starts(text: str) -> np.ndarray:
    """Starts of the windows that hold a digit or an "@"; all others can't add a span."""
    at = np.array([m.start() for m in _TRIGGER.finditer(text)], np.int64) // STRIDE
    return np.unique(np.concatenate([at, at - 1])[np.concatenate([at, at - 1]) >= 0]) * STRIDE


def reconcile(spans: list[tuple[str, int, int, float]], edges: set[tuple[int, int]], final=lambda kind, a, b: (a, b)) -> list[tuple[str, int, int, float]]:
    """Joins spans that windows cut, then takes the set without overlaps that has the largest score. final: the place of a joined span, or
    None if it is to be put aside."""
    spans = sorted(set(spans), key=lambda s: (EVERY.index(s[0]), s[1], s[2]))
    joined: list[tuple[str, int, int, float]] = []
    for s in spans:
        last = joined[-1] if joined else None
        if last and last[0] == s[0] and s[1] < last[2] and s[2] > last[2] and ((last[1], last[2]) in edges or (s[1], s[2]) in edges):
            edges.add((last[1], s[2]))
            joined[-1] = (s[0], last[1], s[2], max(last[3], s[3]) + 1)
        else:
            joined.append(s)
    placed = [(s, final(*s[:3])) for s in joined]
    joined = sorted({(s[0], *at, s[3]) for s, at in placed if at}, key=lambda s: (s[2], s[1], s[0], s[3]))
    ends = [s[2] for s in joined]
    best = [(0.0, -1, -1)]  # total, span taken, state before
    for i, (_, a, _, score) in enumerate(joined):
        before = int(np.searchsorted(ends[:i], a, "right"))
        taken = best[before][0] + max(score, 1e-6)
        best.append((taken, i, before) if taken > best[-1][0] else (best[-1][0], -1, i))
    out, k = [], len(joined)
    while k > 0:
        _, i, before = best[k]
        if i >= 0:
            out.append(joined[i])
        k = before
    return out[::-1]


def model_spans(texts: list[str], tagger: Tagger, starts: list[np.ndarray] | None = None, batch: int = 2048, taken: list[list[Span]] | None = None) -> list[list[Span]]:
    """The reconciled spans of the tagger in every text. starts: the windows to run, those with a digit or "@" if not given. taken: spans
    of each text that none may overlap."""
    starts = [window_starts(t) if _TRIGGER.search(t) else np.zeros(0, np.int64) for t in texts] if starts is None else starts
    coded = [classes_of(t) if len(s) else None for t, s in zip(texts, starts, strict=True)]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    begin = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    found: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    edges: list[set] = [set() for _ in texts]
    for i in range(0, len(owner), batch):
        x = np.full((min(batch, len(owner) - i), WINDOW), PAD, np.int64)
        for r in range(len(x)):
            c = coded[owner[i + r]][begin[i + r] : begin[i + r] + WINDOW]
            x[r, : len(c)] = c
        tags, gain = tagger.decode(x)
        head = (tags % 2 == 1) & (tags > 0)
        for r, a in zip(*np.nonzero(head), strict=True):
            k, b = tags[r, a], a + 1
            while b < WINDOW and tags[r, b] == k + 1:
                b += 1
            doc, at = owner[i + r], int(begin[i + r])
            size = len(texts[doc])
            if at + b > size or not _TRIGGER.search(texts[doc], at + int(a), at + int(b)):
                continue
            found[doc].append((EVERY[(k - 1) // 2], at + int(a), at + int(b), float(gain[r, a:b].sum())))
            if a == 0 and at or b == WINDOW and at + b < size:
                edges[doc].add((at + int(a), at + int(b)))
    out: list[list[Span]] = []
    for i, (text, f, e) in enumerate(zip(texts, found, edges, strict=True)):
        held = taken[i] if taken else []

        def final(kind: str, a: int, b: int, text=text, held=held):
            a, b = trimmed(text, a, b)
            return (a, b) if a < b and fits(kind, text, a, b) and not any(a < y and x < b for _, x, y in held) else None

        out.append([s[:3] for s in reconcile(f, e, final)] if f else [])
    return out


# ---- labelled spans

_SYLLABLES = ["the", "an", "er", "on", "tion", "in", "re", "es", "la", "de", "ou", "ment", "sch", "ung", "ción", "é", "ñ", "ti", "wh", "sh", "ea", "ble"]


def _word(rng: np.random.Generator) -> str:
    w = "".join(rng.choice(_SYLLABLES, rng.integers(1, 4)))
    return w.capitalize() if rng.random() < 0.1 else w.upper() if rng.random() < 0.03 else w


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _letters(rng: np.random.Generator, n: int) -> str:
    return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))


def _key(rng: np.random.Generator) -> str:
    """A random key of one of the common makes."""
    kind = rng.integers(0, 5)
    if kind < 2:
        return rng.bytes(int(rng.choice([16, 20, 20, 32]))).hex()
    chars = list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" if kind == 2 else "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    return str(rng.choice(["", "sk-", "key_", "pk-"])) + "".join(rng.choice(chars, int(rng.integers(16, 44)))) + str(rng.integers(0, 10))


def _entity(rng: np.random.Generator, kind: str) -> tuple[str, str, str]:
    """What stands before the entity, the entity, and what stands after it."""
    name = lambda: _letters(rng, rng.integers(2, 8))
    if kind == "email":
        host = rng.choice(["example", "mail", name()]) + (_digits(rng, 1) if rng.random() < 0.5 else "")
        return "", f"{name()}{rng.choice(['.', '_', '-', '', '+'])}{_digits(rng, rng.integers(0, 3))}{rng.choice(['@', '@', '@', ' @ ', '@ ', '[@]'])}{host}.{rng.choice(['com', 'net', 'example.com', 'org', 'co.uk'])}", ""
    if kind == "ip":
        return "", rng.choice([".", ".", ".", " . "]).join(str(rng.integers(0, 256)) for _ in range(4)), ""
    if kind == "card":
        if rng.random() < 0.1:
            return "", " ".join([_digits(rng, 4), _digits(rng, 6), _digits(rng, 5)]), ""
        four = [_digits(rng, 4) for _ in range(4)]
        return "", rng.choice(["", "", "", " ", "-", "."]).join(four), ""
    if kind == "secret":
        what, sign = rng.choice(["token", "api_key", "secret", "password", "key", "access_token", "auth", "client_secret"]), rng.choice([" = ", "=", ": ", " := "])
        quote = rng.choice(['"', '"', "'", ""])
        what = str(what).upper() if rng.random() < 0.3 else str(what)
        return f"{what}{sign}{quote}", _key(rng).upper() if rng.random() < 0.1 else _key(rng), str(quote)
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return "", str(rng.choice([f"+{_digits(rng, 1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{_digits(rng, 2)} {a} {b} {c}", f"{a}.{b}.{c}", f"00{_digits(rng, 2)} {a} {b}{c}"])), ""


def _decoy(rng: np.random.Generator) -> str:
    """Digits and marks that are no personal data."""
    n = rng.integers
    return str(rng.choice([str(n(1900, 2100)), f"{n(1, 99)}.{n(0, 9)}", f"{n(1, 28):02d}.{n(1, 12):02d}.{n(1990, 2030)}", f"{n(1990, 2030)}-{n(1, 12):02d}-{n(1, 28):02d}", f"{n(1, 24)}:{n(0, 59):02d}", f"$ {n(1, 9999)}", f"{n(1, 999)},{n(0, 999):03d}", f"version {n(1, 9)}.{n(0, 9)}", f"v{n(1, 9)}.{n(0, 9)}.{n(0, 9)}", f"no. {n(1, 99999)}", f"@{_word(rng)}", f"{n(1, 100)} %", f"({n(1, 30)})", f"CC BY-NC {n(1, 5)}.0", f"version {n(1, 9)}.", f"ISBN 978{_digits(rng, 10)}", f"at 17{_digits(rng, 11)} ms", f"commit {rng.bytes(20).hex()}", f"{n(1, 99999)} x {n(1, 999)}", f"key {n(1, 99)}", f"token {n(1, 99)} of {n(1, 999)}", f"{_digits(rng, int(n(5, 8)))}"]))


def examples(n: int = 5_000, seed: int = 3) -> list[tuple[str, list[Span]]]:
    """Labelled texts of about a window: words, at times entities and at times a decoy, cut anywhere. Of a span that the cut parts, what is
    left is a span if it has eight characters."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        parts, spans, at = [], [], 0
        what = [(str(k), *_entity(rng, k)) for k in rng.choice(EVERY, rng.choice([0, 1, 1, 2]), replace=False)] + [("", "", _decoy(rng), "") for _ in range(rng.integers(0, 2))]
        rng.shuffle(what)
        sep = " | " if rng.random() < 0.05 else " "
        plain = lambda k: [("", "", _word(rng), "") for _ in range(k)]
        upper = rng.random() < 0.05
        for kind, before, token, after in [*plain(rng.integers(0, 12)), *[y for x in what for y in (tuple(x), *plain(rng.integers(1, 6)))]]:
            token, before = (token.upper(), before.upper()) if upper else (token, before)
            if kind:
                spans.append((str(kind), at + len(before), at + len(before) + len(token)))
            token = before + token + after + (str(rng.choice(["", "", "", ",", ".", "!!", "%%%", "###", "$$$", "***"])) if rng.random() < 0.5 else "")
            parts.append(token)
            at += len(token) + len(sep)
        text = sep.join(parts)
        cut = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
        inside = [(k, max(a - cut, 0), min(b - cut, WINDOW)) for k, a, b in spans if b > cut and a < cut + WINDOW]
        if all(b - a >= 8 or (k, a + cut, b + cut) in spans for k, a, b in inside):
            out.append((text[cut : cut + WINDOW], inside))
    return out


@lru_cache(maxsize=1)
def trained() -> Tagger:
    """The tagger with the parameters that lie beside this module."""
    tagger = Tagger()
    with np.load(PARAMETERS) as kept:
        tagger.p = {k: kept[k] for k in tagger.p}
    return tagger


def train_and_write(n: int = 5_000, epochs: int = 8, seed: int = 3) -> list[float]:
    """Fits a tagger on generated examples and writes its parameters; the same each time."""
    tagger = Tagger()
    losses = tagger.fit(examples(n, seed), epochs)
    np.savez(PARAMETERS, **tagger.p)
    return losses


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and all spans, of every text, by kind and start."""
    base = [base_spans(t) for t in texts]
    return [(b, sorted([*b, *new], key=lambda s: (EVERY.index(s[0]), s[1], s[2]))) for b, new in zip(base, model_spans(texts, tagger, taken=base), strict=True)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans of each kind), base_sha256, spans, n_added (the tagger's), n_spans of every row."""
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("n_spans", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc_id, (base, every) in zip(part.column(0).to_pylist(), all_spans(part.column(1).to_pylist(), tagger), strict=True):
                    rows.append((doc_id, *[sum(s[0] == k for s in base) for k in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base), len(every)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    kinds = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    return docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text")).mapInArrow(run, kinds)


if __name__ == "__main__":
    print(train_and_write())
