"""Personal data in whole texts: fixed patterns, and spans a linear-chain CRF adds.

Patterns find the plain forms.  The conditional random field tags tokens by
their shape and their neighbours' and finds the written-out and spaced forms
the patterns miss.  Its labelled table is small and stated by rule below.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# --- fixed patterns -------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin at the first digit of a run: later ones would end at the same place
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) * (1 + place % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Each @ with the longest local part before it that no earlier match holds; linear in the text."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((start, free))
            at = text.find("@", free)
        else:
            free = max(free, at + 1)
            at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of the fixed patterns by kind; leftmost, non-overlapping within a kind."""
    out: dict[str, list[Span]] = {"email": _emails(text), "ip": [], "card": [], "phone": []}
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out["phone"].append(m.span())
        at = text.find("+", m.end() if m else at + 1)
    return out


# --- tokens and their shapes ---------------------------------------------

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_AT = frozenset({"at", "arroba"})
_DOT = frozenset({"dot", "punkt", "punto", "point"})
_CALL = frozenset({"call", "phone", "tel", "telephone", "mobile", "fax", "cell"})
_PAY = frozenset({"card", "visa", "mastercard", "amex", "credit"})
_NET = frozenset({"ip", "host", "server", "address"})
_MAIL = frozenset({"mail", "email", "contact", "write"})
_TOP = frozenset({"com", "org", "net", "edu", "gov", "io", "info", "biz"})
_WORDS = (("AT", _AT), ("DOT", _DOT), ("CALL", _CALL), ("PAY", _PAY), ("NET", _NET), ("MAIL", _MAIL), ("TOP", _TOP))

PLAIN = "word"
TAGS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))


def shape(token: str) -> str:
    """Shape class of a token: a key word, digits by length, mixed, or a mark by itself."""
    if token.isalpha():
        lower = token.lower()
        for name, words in _WORDS:
            if lower in words:
                return name
        return PLAIN
    if token.isascii() and token.isdigit():
        return "octet" if len(token) <= 3 and int(token) < 256 else f"{min(len(token), 9)}d"
    return "mixed" if token.isalnum() else token


# --- the labelled table ----------------------------------------------------


def labelled_table(seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, [(kind, start, end)]): about 640 short labelled texts made by rule.

    Each template has one value, drawn with a fixed seed; the last templates
    have none and show what numbers, codes and versions look like.
    """
    rng = np.random.default_rng(seed)

    def digits(n: int) -> str:
        return "".join(rng.choice(list("0123456789"), n))

    def word() -> str:
        return "".join(rng.choice(list("aeinorst"), rng.integers(3, 9)))

    def octets(between: str) -> str:
        return between.join(str(rng.integers(1, 255)) for _ in range(4))

    def card(between: str) -> str:
        return between.join(digits(4) for _ in range(4))

    top = lambda: str(rng.choice(["com", "org", "net"]))
    land = lambda: str(rng.choice(["de", "fr", "it", "nl", "es", "uk"]))
    values = {
        "email": [
            lambda: f"{word()} at {word()} dot {top()}", lambda: f"{word()}(at){word()}(dot){top()}",
            lambda: f"{word()} [at] {word()} [dot] {top()}", lambda: f"{word()} @ {word()} . {top()}",
            lambda: f"{word()}.{digits(2)} at {word()} dot {top()}", lambda: f"{word()}.{word()}@{word()}.{top()}",
            lambda: f"{word()} (at) {word()} (dot) {top()}", lambda: f"{word()}.{digits(2)}@{word()}{digits(1)}.{word()}.{top()}",
            lambda: f"{word()} (at) {word()}.{top()}", lambda: f"{word()} [at] {word()}.{top()}",
            lambda: f"{word()} (at) {word()}.{land()}", lambda: f"{word()} at {word()} dot {land()}",
            lambda: f"{word()} (at) {word()} (dot) {land()}",
        ],
        "ip": [lambda: octets("."), lambda: octets(" . "), lambda: octets("[.]"), lambda: octets(" dot ")],
        "card": [lambda: card(" "), lambda: card("-"), lambda: card("."), lambda: card("/")],
        "phone": [
            lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
            lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}",
            lambda: f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}",
        ],
    }
    lead = {"email": "mail", "ip": "server", "card": "card", "phone": "call"}
    table = []
    for kind, makers in values.items():
        for make in makers:
            for k in range(14):
                before = f"{word()} {lead[kind]} " if k % 3 == 0 else f"{word()} {word()} "
                value, after = make(), rng.choice([f" {word()} {word()}.", f". {word()}", f", {word()}", "", f"\n{word()} {word()}"])
                table.append((before + value + str(after), [(kind, len(before), len(before) + len(value))]))
    clean = [
        lambda: f"{word()} version {digits(1)}.{digits(1)}. {word()}", lambda: f"CC BY-NC {digits(1)}.0.\n{word()}",
        lambda: f"{word()} in {digits(4)} and {digits(4)}", lambda: f"{word()} {digits(4)}-{digits(2)}-{digits(2)} {word()}",
        lambda: f"{word()} at {digits(2)}:{digits(2)} {word()}", lambda: f"{word()} {digits(2)}.{digits(2)} and {digits(3)}",
        lambda: f"password={word()}{digits(4)}{word()} {word()}", lambda: f"AK{digits(2)}{word().upper()}{digits(3)} {word()}",
        lambda: f"{word()} {digits(10)} {word()}", lambda: f"{word()} dot {word()} at {word()}",
        lambda: f'key="{digits(3)}{word()}{digits(5)}" {word()}', lambda: f"{digits(1)} {digits(2)} {digits(3)} {word()}",
        lambda: f"{word()} @ {word()} {word()}", lambda: f"v{digits(1)}.{digits(2)}.{digits(1)} {word()}",
        lambda: f"{word()} at {word()} {digits(2)}", lambda: f"{word()} at {word()}. dot {word()} at {digits(1)}", lambda: f"{digits(4)} {digits(4)} {word()}",
        lambda: f"{word()} at {word()}. {word()} {word()}", lambda: f"{word()} (at {word()}) {word()}. {word()}",
        lambda: f"{word()} {word()} {word()}, {word()} at {word()} {word()}",
    ]
    table += [(f"{word()} {make()} {word()}", []) for make in clean for _ in range(14)]
    return [(text, spans) for text, spans in table]


# --- the field ---------------------------------------------------------------


@dataclass
class ShapeField:
    """Weights of shape features at places -2 to 2, and of tag pairs."""

    shapes: dict[str, int]
    emit: np.ndarray  # place x shape x tag
    move: np.ndarray  # tag x tag
    first: np.ndarray  # tag

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Tag scores of chains of shape numbers (n x length, -1 beyond the end)."""
        padded = np.pad(rows, ((0, 0), (2, 2)), constant_values=-1)
        blank = np.concatenate([self.emit, np.zeros((5, 1, len(TAGS)))], axis=1)  # shape -1
        return sum(blank[k][padded[:, k : k + rows.shape[1]]] for k in range(5))


def _allowed() -> np.ndarray:
    """A tag I-x follows only B-x or I-x."""
    ok = np.zeros((len(TAGS), len(TAGS)))
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            for i, before in enumerate(TAGS):
                if before[2:] != tag[2:]:
                    ok[i, j] = -np.inf
    return ok


_RULES = _allowed()
_STARTS = np.array([-np.inf if t[0] == "I" else 0.0 for t in TAGS])


def _tagged(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[str], list[int]]:
    names, tags = [], []
    for m in _TOKEN.finditer(text):
        names.append(shape(m.group()))
        tag = "O"
        for kind, start, end in spans:
            if start <= m.start() < end:
                tag = f"{'B' if m.start() == start else 'I'}-{kind}"
        tags.append(TAGS.index(tag))
    return names, tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.maximum(x.max(axis=axis, keepdims=True), -1e30)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def train(table: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 150, decay: float = 1e-3) -> ShapeField:
    """Maximise the likelihood of the labelled tags by gradient steps on the whole table."""
    chains = [_tagged(text, spans) for text, spans in table]
    seen = sorted({s for names, _ in chains for s in names})
    numbers = {s: i for i, s in enumerate(seen)}
    length = max(len(n) for n, _ in chains)
    x = np.full((len(chains), length), -1)
    y = np.zeros((len(chains), length), dtype=int)
    for i, (names, tags) in enumerate(chains):
        x[i, : len(names)] = [numbers[s] for s in names]
        y[i, : len(tags)] = tags
    real = x >= 0
    t = len(TAGS)
    field = ShapeField(numbers, np.zeros((5, len(seen), t)), np.zeros((t, t)), np.zeros(t))
    padded = np.pad(x, ((0, 0), (2, 2)), constant_values=-1)
    gold = np.eye(t)[y] * real[:, :, None]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (field.emit, field.move, field.first)]
    for epoch in range(1, epochs + 1):
        emit, move, start = field.scores(x), field.move + _RULES, field.first + _STARTS
        fwd = np.full((*x.shape, t), -np.inf)
        bwd = np.zeros((*x.shape, t))
        fwd[:, 0] = start + emit[:, 0]
        for i in range(1, length):
            step = _log_sum(fwd[:, i - 1, :, None] + move, 1) + emit[:, i]
            fwd[:, i] = np.where(real[:, i, None], step, fwd[:, i - 1])
        for i in range(length - 2, -1, -1):
            step = _log_sum(move + (emit[:, i + 1] + bwd[:, i + 1])[:, None, :], 2)
            bwd[:, i] = np.where(real[:, i + 1, None], step, 0.0)
        whole = _log_sum(fwd[:, -1], 1)
        ends = real & ~np.pad(real[:, 1:], ((0, 0), (0, 1)))
        log_p = np.where(ends[:, :, None], fwd, fwd + bwd) - whole[:, None, None]
        unit = np.exp(log_p) * real[:, :, None]
        pair = np.zeros((t, t))
        pair_gold = np.zeros((t, t))
        for i in range(1, length):
            rows = real[:, i]
            p = fwd[rows, i - 1, :, None] + move + (emit[rows, i] + np.where(ends[rows, i, None], 0.0, bwd[rows, i]))[:, None, :]
            pair += np.exp(p - whole[rows, None, None]).sum(axis=0)
            np.add.at(pair_gold, (y[rows, i - 1], y[rows, i]), 1)
        gap = gold - unit
        g_emit = np.zeros_like(field.emit)
        for k in range(5):
            place = padded[:, k : k + length]
            use = real & (place >= 0)
            np.add.at(g_emit[k], place[use], gap[use])
        grads = [g_emit, pair_gold - pair, gap[:, 0].sum(axis=0)]
        for p, g, (m, s) in zip((field.emit, field.move, field.first), grads, state):
            g = g / len(chains) - decay * p
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p += 0.1 * (m / (1 - 0.9**epoch)) / (np.sqrt(s / (1 - 0.99**epoch)) + 1e-8)
    return field


def viterbi(field: ShapeField, rows: np.ndarray) -> np.ndarray:
    """Best tags of chains of equal padded length; what stands beyond a chain's end means nothing."""
    emit = field.scores(rows)
    n, length, t = emit.shape
    move = field.move + _RULES
    back = np.zeros((n, length, t), dtype=np.int8)
    best = field.first + _STARTS + emit[:, 0]
    for i in range(1, length):
        ways = best[:, :, None] + move
        on = (rows[:, i] != BEYOND)[:, None]  # a chain that has ended waits in its last tag
        back[:, i] = np.where(on, ways.argmax(axis=1), np.arange(t))
        best = np.where(on, ways.max(axis=1) + emit[:, i], best)
    tags = np.zeros((n, length), dtype=np.int8)
    tags[:, -1] = best.argmax(axis=1)
    for i in range(length - 1, 0, -1):
        tags[:, i - 1] = np.take_along_axis(back[:, i], tags[:, i, None].astype(np.int64), axis=1)[:, 0]
    return tags


#: A chain of more tokens is cut into blocks that are stepped through side by side.
LONG = 4096
BLOCK = 512
#: Tokens before a block in which its scores settle.
WARM = 64


def _steps(v: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores after one token, best tag before it) of chains with scores ``v``, relative to the best."""
    ways = v[:, :, None] + move
    after = ways.max(axis=1) + emit
    return after - after.max(axis=1, keepdims=True), ways.argmax(axis=1)


def long_path(field: ShapeField, row: np.ndarray, block: int = BLOCK, warm: int = WARM) -> np.ndarray:
    """``viterbi`` of one long chain, block by block at the same time.

    The scores before a token depend on what lies far back only by a constant for
    all tags.  Each block starts some tokens early from level scores; where they
    have not settled to those the block before ends with, the block is stepped
    again from these.  So the path is the best one over the whole chain.
    """
    size, t = len(row), len(TAGS)
    emit, move = field.scores(row[None])[0], field.move + _RULES
    starts = np.arange(0, size, block)
    n = len(starts)
    opening = field.first + _STARTS + emit[0]
    v, begin = np.zeros((n, t)), np.zeros((n, t))
    back = np.broadcast_to(np.arange(t, dtype=np.int8), (n, block, t)).copy()
    for k in range(-warm, block):
        at = starts + k
        if k == 0:
            begin = v.copy()
        on = (at >= 0) & (at < size)
        after, best = _steps(v, move, emit[np.clip(at, 0, size - 1)])
        first = (at == 0)[:, None]
        v = np.where(first, opening - opening.max(), np.where(on[:, None], after, v))
        if k >= 0:
            back[:, k] = np.where(on[:, None] & ~first, best, np.arange(t))
    end = v
    for b in range(1, n):
        if not np.allclose(begin[b], end[b - 1], rtol=0, atol=1e-9):
            again = end[b - 1][None]
            for k in range(min(block, size - starts[b])):
                again, best = _steps(again, move, emit[starts[b] + k][None])
                back[b, k] = best[0]
            end[b] = again[0]
    # where each last tag of a block comes from, then the last tags from the end, then all of them
    rows, entry = np.arange(n)[:, None], np.tile(np.arange(t), (n, 1))
    for k in range(block - 1, -1, -1):
        entry = back[rows, k, entry].astype(np.int64)
    last = np.zeros(n, dtype=np.int64)
    last[-1] = end[-1].argmax()
    for b in range(n - 1, 0, -1):
        last[b - 1] = entry[b, last[b]]
    tags = np.zeros((n, block), dtype=np.int8)
    here = last
    for k in range(block - 1, -1, -1):
        tags[:, k] = here
        here = back[np.arange(n), k, here].astype(np.int64)
    return tags.ravel()[:size]


#: Shape number of what lies beyond a chain's end.
BEYOND = -1
_CELLS = 1 << 18


class _Numbers(dict):
    """Shape number of a token; the first of them are remembered."""

    def __init__(self, shapes: dict[str, int]):
        super().__init__()
        self._shapes = shapes

    def __missing__(self, token: str) -> int:
        number = self._shapes.get(shape(token), len(self._shapes))
        if len(self) < 1 << 17 and len(token) < 32:
            self[token] = number
        return number


def field_spans(texts: list[str], field: ShapeField) -> list[list[tuple[str, int, int]]]:
    """Spans the field finds in each whole text, in order: the best path over all its tokens."""
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    numbers = _Numbers(field.shapes)
    wide = ShapeField(field.shapes, np.pad(field.emit, ((0, 0), (0, 1), (0, 0))), field.move, field.first)
    chains = [(row, np.array([numbers[t] for t in _TOKEN.findall(text)], dtype=np.int16)) for row, text in enumerate(texts)]
    for row, kinds in chains:
        if len(kinds) > LONG:
            tags = long_path(wide, kinds)
            if tags.any():
                found[row] = _spans_of([m.span() for m in _TOKEN.finditer(texts[row])], tags)
    chains = sorted((c for c in chains if 0 < len(c[1]) <= LONG), key=lambda c: (len(c[1]), c[0]))
    at = 0
    while at < len(chains):
        to = at
        while to < len(chains) and (to == at or (to - at + 1) * len(chains[to][1]) <= _CELLS):
            to += 1
        rows = np.full((to - at, len(chains[to - 1][1])), BEYOND)
        for i, (_, kinds) in enumerate(chains[at:to]):
            rows[i, : len(kinds)] = kinds
        for (row, kinds), tags in zip(chains[at:to], viterbi(wide, rows)):
            if tags[: len(kinds)].any():
                found[row] = _spans_of([m.span() for m in _TOKEN.finditer(texts[row])], tags)
        at = to
    return found


def _spans_of(tokens: list[tuple[int, int]], tags: np.ndarray) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    for (start, end), tag in zip(tokens, tags.tolist()):
        name = TAGS[tag]
        if name[0] == "B":
            out.append((name[2:], start, end))
        elif name[0] == "I":
            out[-1] = (out[-1][0], out[-1][1], end)
    return out


def _plausible(kind: str, value: str) -> bool:
    """Whether a span of the field has what its kind needs at least."""
    digits = "".join(c for c in value if c in "0123456789")
    if kind == "email":
        words = [w.lower() for w in re.findall(r"[^\W_]+", value)]
        if len(words) < 3 or not ("@" in value or not _AT.isdisjoint(words[1:-1])):
            return False
        dotted = "." in value or not _DOT.isdisjoint(words[1:-1])
        return words[-1] in _TOP or (dotted and len(words[-1]) >= 2 and words[-1].isalpha())
    if kind == "ip":
        parts = re.findall("[0-9]+", value)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


#: What every plausible span has: a digit, an @ or a word for it.
_NEEDED = re.compile(r"[0-9@]|(?<![^\W_])(?:at|arroba)(?![^\W_])", re.IGNORECASE)


def all_spans(texts: list[str], field: ShapeField | None) -> list[tuple[dict[str, list[Span]], dict[str, list[Span]]]]:
    """(base spans, all spans) of each text; the field's spans touch no base span and each other nowhere."""
    out = []
    rows = [i for i, t in enumerate(texts) if _NEEDED.search(t)] if field else []
    added = dict(zip(rows, field_spans([texts[i] for i in rows], field))) if field else {}
    for row, text in enumerate(texts):
        extra = added.get(row, [])
        base = base_spans(text)
        every = {k: list(v) for k, v in base.items()}
        if extra:
            held = sorted(s for v in base.values() for s in v)
            for kind, start, end in extra:
                if _plausible(kind, text[start:end]) and not any(a < end and start < b for a, b in held):
                    every[kind].append((start, end))
            every = {k: sorted(v) for k, v in every.items()}
        out.append((base, every))
    return out


def written(spans: dict[str, list[Span]]) -> str:
    """kind:start:end of all spans, by kind and start."""
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


_GROUP_CHARS = 4 << 20


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= _GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def find(df: DataFrame, id_col: str, text_col: str, field: ShapeField | None) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    The counts and the hash are of the pattern spans, ``spans`` of all.  A null
    text counts as empty.  Offsets count code points.  Spans of one kind that
    overlap keep the pattern's; equal paths of the field take the tag first in
    order.  Repeated rows come back as often as given, an empty table gives
    none.  A very long text is one chain all the same, stepped through in blocks.
    Only the two columns are read.
    """
    plain = df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in _groups(batch.column("_text").to_pylist()):
                found = all_spans(group, field)
                base = [written(b) for b, _ in found]
                counts = [pa.array([len(b[k]) for b, _ in found], pa.int64()) for k in KINDS]
                sha = pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string())
                spans = pa.array([written(e) for _, e in found], pa.string())
                ids = batch.column(0).slice(at, len(group))
                at += len(group)
                yield pa.RecordBatch.from_arrays([ids, *counts, sha, spans], [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = plain.schema[id_col].dataType.simpleString()
    return plain.mapInArrow(run, f"`{id_col}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact_text(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans go as one."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str, field: ShapeField | None) -> DataFrame:
    """``df`` with personal data in ``text_col`` replaced; null stays null, other columns as they are."""
    names, at = df.columns, df.columns.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str | None] = []
            for group in _groups([t or "" for t in batch.column(at).to_pylist()]):
                out += [redact_text(t, every) for t, (_, every) in zip(group, all_spans(group, field))]
            column = batch.column(at)
            texts = pa.array(out, pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names)

    return df.mapInArrow(run, fields)
