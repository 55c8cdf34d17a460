"""Secret scans: fixed patterns, and a character convolutional network beside them.

The patterns find assignments, access keys and long hexadecimal runs; their
spans always stay.  The network looks at every other candidate - a run of the
characters secrets are made of, at least eight long - with the text around it, and
adds those it takes for a secret.  Long runs are shown in overlapping windows, and
count as their worst one.

It is trained in numpy on labelled findings of all documents: what the patterns find
is positive, the other candidates are negative, those with a digit and those without
one weighing the same.  It starts from a short fit to a bounded draw; then every finding
of the documents not held back adds its gradient to one of ``STEPS`` steps, a fold of the
documents each, whose sums come from the tasks.  A third of the findings are shown without
their surroundings, so that the value's own form counts, and a third within a longer run
of harmless ones, as a window may show them.  All findings of the documents held back
calibrate the scores and set the threshold: the highest that still finds ``RECALL`` of
the positives held back.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.llm.common import id_and_text, map_rows

# Fixed patterns and least lengths.  Letters of the first go in either case, ASCII only.
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "model")

_KEYS = ("passw", "secret", "token", "api")
CANDIDATE_LEAST = 8
_RUNS = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % CANDIDATE_LEAST)
_DIGIT = re.compile(r"[0-9]")

#: Bounds of the draw that the first weights come from: documents, and windows of positives,
#: of negatives with a digit, and of negatives without one.
SAMPLE_ROWS = 8000
SAMPLE_FINDINGS = 2000
#: Steps over all findings, with their rate; one document in ``HELD`` is held back.
STEPS, RATE, HELD = 6, 0.002, 4
#: Cells that scores held back are counted in, from -REACH to REACH.
CELLS, REACH = 4096, 30.0
#: Unit of the sums that tasks send, whole numbers so that their order does not matter.
UNIT = 2.0**32
RECALL = 0.98
#: Number of a space.
BLANK = 1
#: Characters shown before a candidate, of it, and in all.
BEFORE, SHOWN, WIDTH = 20, 44, 72
#: From one window of a long candidate to the next: any 29 characters lie whole in one.
STRIDE = 16
#: Windows scored together.
AT_ONCE = 20_000


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) that the patterns find, in code points, by start and then kind."""
    out = []
    lowered = text.lower()
    if any(k in lowered for k in _KEYS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs that no pattern has taken, without punctuation at their ends."""
    out = []
    # where what is taken so far ends, by the start of each span
    starts = [s for s, _, _ in taken]
    ends = list(accumulate((e for _, e, _ in taken), max))
    for m in _RUNS.finditer(text):
        start = m.start()
        end = start + len(m[0].rstrip(".=-"))
        before = bisect_left(starts, end)  # spans that begin before the candidate ends
        if end - start >= CANDIDATE_LEAST and not (before and ends[before - 1] > start):
            out.append((start, end))
    return out


def window(text: str, start: int, end: int) -> str:
    """A candidate's beginning between the text before and behind it, at fixed places."""
    left = text[max(0, start - BEFORE) : start].rjust(BEFORE)
    return left + text[start : min(end, start + SHOWN)].ljust(SHOWN) + text[end : end + WIDTH - BEFORE - SHOWN].ljust(WIDTH - BEFORE - SHOWN)


def places(start: int, end: int) -> Iterator[tuple[int, int]]:
    """The parts of a candidate that its windows show: together all of it."""
    at = start
    while end - at > SHOWN:
        yield at, at + SHOWN
        at = min(at + STRIDE, end - SHOWN)
    yield at, end


def encode(windows: list[str]) -> np.ndarray:
    """Rows of character numbers: printable ASCII from 1, others 0."""
    flat = np.frombuffer("".join(windows).encode("utf-32-le"), "<u4").reshape(-1, WIDTH)
    codes = flat - np.uint32(31)  # what is below wraps round to large numbers
    codes[codes > 95] = 0
    return codes.astype(np.int64)


def by_length(codes: np.ndarray) -> np.ndarray:
    """Windows in the order of their candidates' lengths, so that those judged together end alike."""
    space = codes[:, BEFORE : BEFORE + SHOWN] == BLANK
    return np.argsort(np.where(space[:, -1], SHOWN - space[:, ::-1].argmin(axis=1), SHOWN), kind="stable")


def told_apart(c: np.ndarray) -> list[int]:
    """Places to look at, of windows that lie in columns.

    Where all of them are blank for longer, a filter gives one value for all of that run:
    its last place stands for it, within the candidate and behind it.
    """
    blank = (c == BLANK).all(axis=1)
    last = WIDTH - Network.TAPS
    same = [blank[k : k + Network.TAPS].all() for k in range(last + 1)]
    border = (BEFORE - 3, BEFORE + SHOWN - 3)  # where the candidate's own places begin and end
    return [k for k in range(last + 1) if not (same[k] and k < last and same[k + 1] and k not in border)]


def _raw(two: list, last: np.ndarray, pair: np.ndarray, c: np.ndarray, place: int, out: np.ndarray, part: np.ndarray) -> None:
    """What the filters give at a place; ``part`` is room to work in."""
    np.take(two[0], pair[place], axis=0, out=out, mode="clip")
    np.take(two[1], pair[place + 2], axis=0, out=part, mode="clip")
    out += part
    np.take(last, c[place + 4], axis=0, out=part, mode="clip")
    out += part


@dataclass
class Network:
    """Embedding, one convolution, maxima over the text, one layer; and its calibration."""

    table: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 1.1

    TAPS = 5

    @classmethod
    def fresh(cls, rng, depth: int = 12, filters: int = 32) -> Network:
        return cls(rng.normal(0, 0.3, (96, depth)), rng.normal(0, 0.15, (cls.TAPS * depth, filters)),
                   np.zeros(filters), rng.normal(0, 0.2, 2 * filters), 0.0)

    def _hidden(self, codes: np.ndarray):
        seen = self.table[codes]
        places = WIDTH - self.TAPS + 1
        columns = np.concatenate([seen[:, k : k + places] for k in range(self.TAPS)], axis=2)
        raw = columns @ self.kernel + self.bias
        inside = slice(BEFORE - 2, BEFORE + SHOWN - 2)  # the candidate itself, and all of it
        first, second = raw.argmax(axis=1), raw[:, inside].argmax(axis=1) + BEFORE - 2
        return columns, raw, first, second

    def logits(self, codes: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(0)
        # what each character, and each pair of them, adds to the filters at its tap
        depth, n = self.table.shape[1], len(self.table)
        one = [(self.table @ self.kernel[k * depth : (k + 1) * depth]).astype(np.float32) for k in range(self.TAPS)]
        two = [(one[k][:, None] + one[k + 1]).reshape(n * n, -1) for k in (0, 2)]
        last = one[4] + self.bias.astype(np.float32)
        out, order = np.empty(len(codes)), by_length(codes)
        for at in range(0, len(codes), 1000):
            rows = order[at : at + 1000]
            c = np.ascontiguousarray(codes[rows].T)
            pair = c[:-1] * n + c[1:]
            around = np.full((c.shape[1], len(self.bias)), -np.inf, np.float32)
            second = around.copy()
            raw, part = np.empty_like(second), np.empty_like(second)
            for place in told_apart(c):
                _raw(two, last, pair, c, place, raw, part)
                best = second if BEFORE - 2 <= place < BEFORE + SHOWN - 2 else around
                np.maximum(best, raw, out=best)
            first = np.maximum(around, second)
            out[rows] = np.maximum(np.concatenate([first, second], axis=1), 0).astype(float) @ self.out + self.offset
        return out

    def sums(self, codes: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Flat sum of the gradients of the logistic loss, as ``gradients`` lists them times the rows."""
        depth, n, filters = self.table.shape[1], len(self.table), len(self.bias)
        taps = self.kernel.reshape(self.TAPS, depth, filters)
        one = [(self.table @ k).astype(np.float32) for k in taps]
        two = [(one[k][:, None] + one[k + 1]).reshape(n * n, -1) for k in (0, 2)]
        last = one[4] + self.bias.astype(np.float32)
        met = np.zeros(self.TAPS * n * filters)  # what comes back to a filter, by tap and character
        d_out, d_bias, d_offset = np.zeros(2 * filters), np.zeros(filters), 0.0
        order = by_length(codes)
        for at in range(0, len(codes), 1000):
            c = np.ascontiguousarray(codes[order[at : at + 1000]].T)
            pair = c[:-1] * n + c[1:]
            # the place stands in the last bits of the value, so that the highest brings it along
            top = np.full((2, c.shape[1], filters), -np.inf, np.float32)
            raw, part = np.empty_like(top[0]), np.empty_like(top[0])
            bits = raw.view(np.int32)
            for place in told_apart(c):
                _raw(two, last, pair, c, place, raw, part)
                bits &= ~127
                bits |= place
                best = top[1 if BEFORE - 2 <= place < BEFORE + SHOWN - 2 else 0]
                np.maximum(best, raw, out=best)
            np.maximum(top[0], top[1], out=top[0])
            where = top.view(np.int32) & 127
            active = np.maximum(np.concatenate([*top], axis=1).astype(float), 0)
            error = 1 / (1 + np.exp(-np.clip(active @ self.out + self.offset, -30, 30))) - y[order[at : at + 1000]]
            d_out += error @ active
            d_offset += error.sum()
            back = np.stack([error[:, None] * self.out[i * filters : (i + 1) * filters] * (top[i] > 0) for i in (0, 1)])
            d_bias += back.sum(axis=(0, 1))
            live = np.nonzero(back)
            where, back, (_, row, own) = where[live], back[live], live
            for k in range(self.TAPS):
                met += np.bincount((k * n + c[where + k, row]) * filters + own, back, len(met))
        met = met.reshape(self.TAPS, n, filters)
        d_table = sum(m @ k.T for m, k in zip(met, taps, strict=True))
        d_kernel = np.concatenate([self.table.T @ m for m in met])
        return np.concatenate([d_table.ravel(), d_kernel.ravel(), d_bias, d_out, [d_offset]])

    def shaped(self, flat: np.ndarray) -> list[np.ndarray]:
        """A flat gradient as ``gradients`` lists it."""
        parts = np.split(flat, np.cumsum([self.table.size, self.kernel.size, self.bias.size, self.out.size]))
        return [parts[0].reshape(self.table.shape), parts[1].reshape(self.kernel.shape), *parts[2:4], parts[4][0]]

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(codes) + self.shift, -30, 30)))

    def gradients(self, codes: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss, in the order of ``parameters``."""
        n, filters = len(codes), len(self.bias)
        columns, raw, first, second = self._hidden(codes)
        top = np.concatenate([np.take_along_axis(raw, i[:, None], 1)[:, 0] for i in (first, second)], axis=1)
        active = np.maximum(top, 0)
        error = (1 / (1 + np.exp(-np.clip(active @ self.out + self.offset, -30, 30))) - y) / n
        back = error[:, None] * self.out * (top > 0)
        d_raw = np.zeros_like(raw)
        rows = np.arange(n)[:, None]
        for i, part in ((first, back[:, :filters]), (second, back[:, filters:])):
            np.add.at(d_raw, (rows, i, np.arange(filters)), part)
        flat = d_raw.reshape(-1, filters)
        d_columns = (flat @ self.kernel.T).reshape(columns.shape)
        d_table = np.zeros_like(self.table)
        depth, places = self.table.shape[1], raw.shape[1]
        for k in range(self.TAPS):
            np.add.at(d_table, codes[:, k : k + places], d_columns[:, :, k * depth : (k + 1) * depth])
        return [d_table, columns.reshape(-1, columns.shape[2]).T @ flat, flat.sum(axis=0),
                active.T @ error, error.sum()]

    def step(self, grads, state, rate: float) -> None:
        """One Adam update."""
        state["t"] = t = state.get("t", 0) + 1
        for name, g in zip(("table", "kernel", "bias", "out", "offset"), grads, strict=True):
            m = state[name, 0] = 0.9 * state.get((name, 0), 0) + 0.1 * g
            v = state[name, 1] = 0.999 * state.get((name, 1), 0) + 0.001 * g * g
            change = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            setattr(self, name, getattr(self, name) - change - (rate * 0.01 * getattr(self, name) if name != "offset" else 0))


def fit(found: list[tuple[str, int]], steps: int = 400, seed: int = 11) -> Network:
    """Train on (window, label); without findings of both labels nothing is ever added."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    y = np.array([label for _, label in found], float)
    if (y == 1).sum() < 4 or (y == 0).sum() < 4:
        return net
    shown = [w for w, _ in found]
    bare = [" " * BEFORE + w[BEFORE : BEFORE + SHOWN] + " " * (WIDTH - BEFORE - SHOWN) for w in shown]
    harmless = [w[BEFORE : BEFORE + SHOWN].strip() for w, label in found if label == 0]
    within = [_within(w[BEFORE : BEFORE + SHOWN].strip(), harmless, rng) for w in shown]
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 4], order[len(y) // 4 :]
    if len({*y[held]}) < 2 or len({*y[used]}) < 2:
        held = used = order
    codes = np.stack([encode(shown), encode(bare), encode(within)])
    by = [used[y[used] == label] for label in (0, 1)]
    state: dict = {}
    for t in range(steps):
        pick = np.concatenate([rng.choice(own, 32) for own in by])
        net.step(net.gradients(codes[rng.integers(0, 3, 64), pick], y[pick]), state, 0.01 if t < steps // 2 else 0.003)
    logit, label = np.concatenate([net.logits(c[held]) for c in codes]), np.tile(y[held], len(codes))
    net.slope, net.shift = _calibrate(logit, label)
    p = np.sort(net.probabilities(codes[0][held[y[held] == 1]]))
    net.threshold = float(max(0.5, p[int((1 - RECALL) * len(p))]))
    return net


def _within(value: str, harmless: list[str], rng) -> str:
    """The window of a long run that holds the value, or what one is sure to hold of it, at its end or beginning."""
    value, run = value[: SHOWN - STRIDE + 1], ""
    while len(run) < WIDTH:
        run += harmless[int(rng.random() * len(harmless))] + "/"
    if rng.random() < 0.5:
        run = run[-WIDTH:] + value
        return window(run, len(run) - SHOWN, len(run))
    run = value + "/" + run
    return window(run, 0, SHOWN)


def _calibrate(logit: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> tuple[float, float]:
    """Platt scaling with its smoothed targets; a score may stand for several."""
    times = np.ones(len(y)) if times is None else times
    up, down = times[y == 1].sum(), times[y == 0].sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x, w = np.c_[logit, np.ones(len(y))], np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (times * (p * (1 - p) + 1e-9))) @ x + 1e-3 * np.eye(2), x.T @ (times * (p - target)))
        w = w - np.clip(step, -1, 1)
    return float(w[0]), float(w[1])


def _findings(text: str) -> Iterator[tuple[int, str, int, bool]]:
    """Place, window, label and whether it counts as one with a digit, of all a text's findings."""
    spans = base_spans(text)
    # of an assignment, the value is what the network sees
    own = [(e - len(ASSIGN.fullmatch(text, s, e)[2]) if k == "assign" else s, e) for s, e, k in spans]
    for label, some in ((1, own), (0, candidates(text, spans))):
        for s, e in some:
            digit = bool(label or _DIGIT.search(text, s, e))
            for x, y in places(s, e):
                yield x, window(text, x, y), label, digit


def _fold(docs: DataFrame) -> Column:
    """Fold of a document: below 0 it is held back, else the step it belongs to."""
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(HELD)) == 0
    return F.when(held, -1).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(STEPS)))


def train(docs: DataFrame) -> Network:
    """Fit on the findings of all documents; see the module's text."""
    texts = id_and_text(docs)
    net, harmless = _first_fit(texts)
    if net.threshold > 1:
        return net
    state: dict = {}
    for step in range(STEPS):
        found = _summed(texts.where(_fold(texts) == step), net, harmless, _add_gradients, 3 * (1 + _size(net)))
        parts = found.reshape(3, -1) / UNIT
        shares = [(0.5, 0.25, 0.25)[k] * (n > 0) for k, n in enumerate(parts[:, 0])]
        flat = sum(share * part[1:] / max(part[0], 1) for share, part in zip(shares, parts, strict=True))
        net.step(net.shaped(flat), state, RATE)
    counts = _summed(texts.where(_fold(texts) < 0), net, harmless, _count_scores, 3 * CELLS).reshape(3, CELLS)
    # the first row counts positives as they stand, which set the threshold; the others all, by label
    if counts.any(axis=1).all():
        low = (np.arange(CELLS) / CELLS * 2 - 1) * REACH
        middle = low + REACH / CELLS
        net.slope, net.shift = _calibrate(np.tile(middle, 2), np.repeat([1.0, 0.0], CELLS), counts[1:].ravel().astype(float))
        cell = np.searchsorted(np.cumsum(counts[0]), int((1 - RECALL) * counts[0].sum()), "right")
        least = 1 / (1 + np.exp(-np.clip(net.slope * low[cell] + net.shift, -30, 30)))
        net.threshold = float(max(0.5, least))
    return net


def _size(net: Network) -> int:
    return net.table.size + net.kernel.size + net.bias.size + net.out.size + 1


def _first_fit(texts: DataFrame) -> tuple[Network, list[str]]:
    """First weights, from a draw of the ``SAMPLE_ROWS`` documents not held back whose ids hash
    lowest, and harmless runs of it."""
    ids = (texts.where("doc_id is not null").where(_fold(texts) >= 0).select("doc_id")
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS))
    sample = texts.join(F.broadcast(ids.distinct()), "doc_id", "left_semi")

    def run(parts):
        for part in parts:
            rows = [(i, *f) for i, text in zip(part["doc_id"], part["text"], strict=True) for f in _findings(text)]
            yield [*map(list, zip(*rows, strict=True))] if rows else [[]] * 5

    found = map_rows(sample, run, "doc_id long, place int, shown string, label int, digit boolean", 500)
    rows = [r for label, digit in ((0, True), (0, False), (1, True))
            for r in found.filter((F.col("label") == label) & (F.col("digit") == digit))
            .orderBy(F.xxhash64("shown", "doc_id"), "doc_id", "place").limit(SAMPLE_FINDINGS).collect()]
    return fit([(r["shown"], r["label"]) for r in rows]), [_value(r["shown"]) for r in rows if r["label"] == 0]


def _value(shown: str) -> str:
    return shown[BEFORE : BEFORE + SHOWN].strip()


def _view(shown: str, harmless: list[str]) -> str:
    """A window as it stands, without its surroundings or within a longer run, by its hash."""
    kind = zlib.crc32(shown.encode())
    if kind % 3 == 0:
        return shown
    if kind % 3 == 1:
        return " " * BEFORE + shown[BEFORE : BEFORE + SHOWN] + " " * (WIDTH - BEFORE - SHOWN)
    return _within(_value(shown), harmless, random.Random(kind))


def _summed(texts: DataFrame, net: Network, harmless: list[str], add, size: int) -> np.ndarray:
    """What ``add`` makes of all findings of the texts, summed over the tasks."""
    shared = texts.sparkSession.sparkContext.broadcast((net, harmless))  # fixed size

    def run(parts):
        own, runs = shared.value
        total, found = np.zeros(size, np.int64), []
        for part in parts:
            for text in part["text"]:
                for _, shown, label, digit in _findings(text):
                    found.append((shown, _view(shown, runs), 0 if label else 2 - digit))
                    if len(found) >= AT_ONCE:
                        add(own, found, total)
                        found.clear()
        if found:
            add(own, found, total)
        at = np.flatnonzero(total)
        yield [at, total[at]]

    out = np.zeros(size, np.int64)
    for r in map_rows(texts, run, "place int, total long", 500).groupBy("place").agg(F.sum("total").alias("total")).collect():
        out[r["place"]] = r["total"]
    return out


def _add_gradients(net: Network, found: list, total: np.ndarray) -> None:
    """Number and gradient of the positives, the negatives with a digit and those without."""
    codes, kinds = encode([v for _, v, _ in found]), np.array([k for _, _, k in found])
    rows = total.reshape(3, -1)
    for k in range(3):
        own = codes[kinds == k]
        if len(own):
            rows[k] += np.rint(np.r_[len(own), net.sums(own, np.full(len(own), float(k == 0)))] * UNIT).astype(np.int64)


def _count_scores(net: Network, found: list, total: np.ndarray) -> None:
    """Positives as they stand, and positives and negatives by their views, by cell of their score."""
    def cells(windows):
        place = (net.logits(encode(windows)) / REACH + 1) / 2 * CELLS if windows else np.zeros(0)
        return np.bincount(np.clip(place, 0, CELLS - 1).astype(int), minlength=CELLS)

    rows = total.reshape(3, -1)
    rows[0] += cells([s for s, _, k in found if k == 0])
    rows[1] += cells([v for _, v, k in found if k == 0])
    rows[2] += cells([v for _, v, k in found if k])


def scan(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """``doc_id, spans`` per row: kind, start and end (code points) of all findings.

    Null and empty texts have none.  Spans go by start, then kind as listed in
    ``KINDS``; patterns of different kinds may overlap, the network's spans lie
    beside all others.
    """
    network = network or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(network)  # fixed size

    def run(parts):
        net = shared.value
        for part in parts:
            every, hits, shown, where = [], set(), [], []

            def judge():
                hits.update(where[k] for k in np.flatnonzero(net.probabilities(encode(shown)) >= net.threshold))
                shown.clear()
                where.clear()

            for row, text in enumerate(part["text"]):
                spans = base_spans(text)
                every.append(spans)
                for s, e in candidates(text, spans):
                    for x, y in places(s, e):
                        shown.append(window(text, x, y))
                        where.append((row, s, e))
                        if len(shown) >= AT_ONCE:
                            judge()
            judge()
            for row, s, e in hits:
                every[row] = [*every[row], (s, e, "model")]
            yield [part["doc_id"], [
                [{"kind": k, "start": s, "end": e} for s, e, k in sorted(x, key=lambda y: (y[0], KINDS.index(y[2])))]
                for x in every]]

    return map_rows(id_and_text(docs), run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>", 500)


def digests(found: DataFrame) -> DataFrame:
    """Counts of the pattern's spans, their digest, and all spans as text."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select("doc_id", *map(count, KINDS),
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
