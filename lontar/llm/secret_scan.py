"""Secret scans: a character convolutional network over every candidate and its context.

Three base patterns (kinds `assign`, `access`, `hex`) find spans that always stay. Candidates are these spans and all runs
of the token alphabet of 10 or more characters with a letter and a digit, or of 20 or more of any. The network reads each of them with the
characters around it. Runs above its threshold that reach beyond the base spans are added as kind `token`; base spans
above it are counted as confirmed. A candidate longer than INNER is read by its head
and tail and by overlapping windows over all of it; its highest score counts, and the whole run is the span.

The network is numpy only: embedded characters, one convolution, ReLU, the maximum and mean over places,
a logistic unit. It is trained on labelled findings: `labelled` makes them from a seed, secrets
of many shapes against the harmless strings that look like them (versions, paths, dates, e-mail and web
addresses, long words, identifiers), each in a context of its own. Two further parts are kept from the fit: on one the
scores are calibrated (a slope and an offset), on the other the threshold is set, the highest that keeps
`least_recall`; a network whose precision there is below `least_precision` is refused.

Null text is an empty text and has no spans. Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lontar.llm import textscan

KINDS = ("assign", "access", "hex", "token")
#: Fixed patterns of the base; a match that is too short is dropped after it has been passed over.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{10,}")
_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")
_QUICK = re.compile(r"(?ai)pass|secret|token|api")

INNER, OUTER = 48, 16
WIDTH = INNER + 2 * OUTER
CLASSES = 24


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = []
    if _QUICK.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs that the network is to judge."""
    return [m.span() for m in CANDIDATE.finditer(text) if m.end() - m.start() >= 20 or (_DIGIT.search(text, *m.span()) and _LETTER.search(text, *m.span()))]


def _alphabet() -> np.ndarray:
    """Code of each byte: single codes for marks that matter, shared ones for letters and digits."""
    code = np.full(256, 1, np.int64)
    for group, chars in enumerate(["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "aeiou", "AEIOU"], start=2):
        code[[ord(c) for c in chars]] = group
    for i, c in enumerate("+/=_-.:@ \"'\n,;"):
        code[ord(c)] = 9 + i
    return code


_CODE = _alphabet()


def windows(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Character codes around each span; a long span is seen by its head and tail (`views` has the rest)."""
    rows = np.zeros((len(spans), WIDTH), np.int64)
    for i, (a, b) in enumerate(spans):
        inner = text[a:b] if b - a <= INNER else text[a : a + INNER // 2] + text[b - INNER // 2 : b]
        parts = text[max(0, a - OUTER) : a].rjust(OUTER, "\0") + inner.ljust(INNER, "\0") + text[b : b + OUTER].ljust(OUTER, "\0")
        raw = np.frombuffer(parts.encode("latin-1", "replace"), np.uint8)
        rows[i] = np.where(raw == 0, 0, _CODE[raw])
    return rows


@dataclass
class CharCNN:
    """embed: CLASSES x e; kernel: width*e x filters; out: 2*filters; then the calibrated logistic."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    span: int = 5

    def _forward(self, codes: np.ndarray):
        e = self.embed[codes]
        places = codes.shape[1] - self.span + 1
        cols = np.concatenate([e[:, k : k + places] for k in range(self.span)], axis=2)
        pre = cols @ self.kernel + self.bias
        act = np.maximum(pre, 0)
        top = act.argmax(1)
        pooled = np.concatenate([np.take_along_axis(act, top[:, None], 1)[:, 0], act.mean(1)], axis=1)
        return cols, act, top, pooled, pooled @ self.out + self.offset

    def logits(self, codes: np.ndarray) -> np.ndarray:
        """Before calibration; a few megabytes at a time."""
        return np.concatenate([np.empty(0), *(self._forward(codes[i : i + 128])[-1] for i in range(0, len(codes), 128))])

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(codes) + self.shift, -40, 40)))


def labelled(seed: int, n: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, 1 for a secret) of `n` findings, made from a seed."""
    r = random.Random(seed)
    syllables = "an be co da en fi ge ho in jo ka lu me no or pe qui ra sti to un ver wa xe yo zu tion ment able ing".split()
    word = lambda k=3: "".join(r.choice(syllables) for _ in range(r.randint(1, k)))
    chars = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    letters, digits, hexes = string.ascii_letters, string.digits, "0123456789abcdef"
    secret = [
        lambda: chars(letters + digits, r.randint(20, 64)),
        lambda: chars(letters + digits + "+/", r.choice([24, 32, 40, 44, 64, 86])) + r.choice(["", "=", "=="]),
        lambda: chars(hexes, r.choice([24, 32, 40, 64])),
        lambda: chars(hexes.upper(), r.choice([32, 40, 64])),
        lambda: r.choice(["ghp_", "gho_", "xoxb-", "sk_live_", "pk_live_", "glpat-", "npm_", "AIza", "SG_"]) + chars(letters + digits, r.randint(20, 40)),
        lambda: "AKIA" + chars(string.ascii_uppercase + digits, 16),
        lambda: "eyJ" + chars(letters + digits + "_-", r.randint(30, 90)),
        lambda: chars(letters + digits + "_-", r.randint(22, 48)),
        lambda: chars(letters + digits, r.randint(12, 20)),
        lambda: chars(letters, r.randint(24, 48)),
        lambda: chars(string.ascii_uppercase + "234567", r.choice([16, 24, 26, 32, 52])),
        lambda: chars(string.ascii_lowercase + digits, r.randint(16, 40)),
    ]
    plain = [
        lambda: "-".join(word() for _ in range(r.randint(3, 6))) + "-" + chars(digits, r.randint(1, 4)),
        lambda: "_".join(word().capitalize() for _ in range(r.randint(2, 5))) + chars(digits, r.randint(1, 3)),
        lambda: "".join(word().capitalize() for _ in range(r.randint(4, 7))) + chars(digits, r.randint(1, 2)),
        lambda: "/".join(word() for _ in range(r.randint(3, 7))) + "/" + chars(digits, r.randint(1, 4)),
        lambda: f"20{r.randint(10, 29)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}-{r.randint(0, 59):02}Z",
        lambda: "".join(word(5) for _ in range(r.randint(3, 6))) + chars(digits, r.randint(1, 2)),
        lambda: "v" + "-".join(chars(digits, r.randint(1, 2)) for _ in range(4)) + "-" + word() + word() + word(),
        lambda: "=" * r.randint(8, 30) + word(4) + chars(digits, 1) + "=" * r.randint(8, 12),
        lambda: "ISBN" + "-".join(chars(digits, k) for k in (3, 1, 4, 4, 1)),
        lambda: word(2).upper() + "-" + chars(digits, 4) + "-" + chars(digits, 6) + "-" + word(2).upper(),
        lambda: chars(digits, r.randint(12, 16)) + r.choice(["px", "th", "km", "EUR", "USD"]) + "-" + word(),
        lambda: word(4) + word(4) + word(4) + chars(digits, r.randint(1, 4)),
        lambda: "-".join(word(4) for _ in range(r.randint(3, 6))),
        lambda: "_".join(word(4) for _ in range(r.randint(3, 6))).upper() + r.choice(["", "_1", "_64"]),
        lambda: "".join(word(5) for _ in range(r.randint(4, 7))),
        lambda: "".join(word(3).capitalize() for _ in range(r.randint(4, 7))),
        lambda: "/".join(word().upper() if r.random() < 0.2 else word() for _ in range(r.randint(3, 7))),
        lambda: r.choice("=-_") * r.randint(20, 60),
        lambda: word(3).capitalize() + "-" + chars(digits, r.randint(2, 6)) + r.choice(["", "a", "-" + word(2)]),
        lambda: chars(digits, 4) + "-" + chars(digits, 2) + "-" + chars(digits, 2) + r.choice(["T", "_"]) + chars(digits, 4) + r.choice(["", "Z", "h"]),
        lambda: word(2).upper() + chars(digits, r.randint(5, 9)),
    ]
    out = []
    for _ in range(n):
        good = r.random() < 0.5
        body = r.choice(secret if good else plain)()
        body = body if len(body) >= 10 else body + chars(letters + digits, 20) if good else body + "_" + word(6) + word(6) + word(6)
        telling, neutral = ["key: ", "auth=", "Bearer ", "= '", ": ", '"'], ["", "", "see ", "file ", "id ", "(", "at ", "page ", "the ", '"', "\n"]
        lead = r.choice(telling if r.random() < (0.4 if good else 0.2) else neutral)  # a context may tell, but not alone
        before, after = " ".join(word() for _ in range(4)) + " " + lead, r.choice([" ", ".", '"', ", ", "\n", ")"]) + " ".join(word() for _ in range(4))
        out.append((before + body + after, len(before), len(before) + len(body), int(good)))
    return out


def train(findings: list[tuple[str, int, int, int]], aside: list[tuple[str, int, int, int]], held: list[tuple[str, int, int, int]], least_recall: float = 0.97, least_precision: float = 0.9, filters: int = 24, width: int = 6, steps: int = 600, batch: int = 128, seed: int = 7) -> CharCNN:
    """Adam on the findings, calibration on those set aside, the threshold on the held-out ones."""
    g = np.random.default_rng(seed)
    pack = lambda rows: (np.concatenate([windows(t, [(a, b)]) for t, a, b, _ in rows]), np.array([y for *_, y in rows], float))
    codes, y = pack(findings)
    net = CharCNN(g.normal(0, 0.5, (CLASSES, width)), g.normal(0, 0.2, (5 * width, filters)), np.zeros(filters), g.normal(0, 0.2, 2 * filters), 0.0)
    state = {k: (0.0, 0.0) for k in ("embed", "kernel", "bias", "out", "offset")}
    for step in range(1, steps + 1):
        pick = g.integers(0, len(y), batch)
        x = codes[pick]
        cols, act, top, pooled, logit = net._forward(x)
        d = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[pick]) / batch
        d_pool = d[:, None] * net.out[None, :]
        d_act = np.repeat(d_pool[:, None, filters:] / act.shape[1], act.shape[1], axis=1)
        rows, cells = np.arange(batch)[:, None], np.arange(filters)[None, :]
        d_act[rows, top, cells] += d_pool[:, :filters]
        d_pre = d_act * (act > 0)
        d_cols = d_pre @ net.kernel.T
        d_embed = np.zeros_like(net.embed)
        for k in range(net.span):
            np.add.at(d_embed, x[:, k : k + act.shape[1]], d_cols[:, :, k * width : (k + 1) * width])
        grads = {"embed": d_embed, "kernel": np.tensordot(cols, d_pre, ([0, 1], [0, 1])), "bias": d_pre.sum((0, 1)), "out": pooled.T @ d, "offset": d.sum()}
        for name, grad in grads.items():
            m, v = state[name]
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            state[name] = m, v
            setattr(net, name, getattr(net, name) - 0.02 * (1 - 0.8 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8))
    codes, y = pack(aside)
    logit = net.logits(codes)
    a, b = 1.0, 0.0
    for _ in range(300):  # Platt's calibration
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -40, 40)))
        a, b = a - 0.05 * ((p - y) * logit).mean(), b - 0.2 * (p - y).mean()
    net.slope, net.shift = float(a), float(b)
    codes, y = pack(held)
    p = net.probability(codes)
    net.threshold = float(np.quantile(p[y == 1], 1 - least_recall))
    precision = y[p >= net.threshold].mean()
    if precision < least_precision:
        raise ValueError(f"at recall {least_recall} the precision on held-out findings is {precision:.3f}, below {least_precision}")
    return net


@lru_cache(maxsize=2)
def default_network(seed: int = 11, n_train: int = 6000, n_aside: int = 1500, n_held: int = 2000) -> CharCNN:
    return train(labelled(seed, n_train), labelled(seed + 1, n_aside), labelled(seed + 2, n_held))


def views(a: int, b: int) -> list[tuple[int, int]]:
    """What the network reads of a candidate: the span and, of a long one, windows that overlap by half, up to its end."""
    return [(a, b)] + ([(x, x + INNER) for x in [*range(a, b - INNER, INNER // 2), b - INNER]] if b - a > INNER else [])


def scores(text: str, spans: list[tuple[int, int]], net: CharCNN) -> np.ndarray:
    """The highest probability among the views of each span."""
    seen = [(i, v) for i, (a, b) in enumerate(spans) for v in views(a, b)]
    out = np.zeros(len(spans))
    for at in range(0, len(seen), 4096):
        some = seen[at : at + 4096]
        np.maximum.at(out, [i for i, _ in some], net.probability(windows(text, [v for _, v in some])))
    return out


def _beyond(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Those of the ascending spans that have a character outside all base spans, by one sweep over both."""
    merged: list[list[int]] = []
    for a, _, b in base:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, i = [], 0
    for a, b in spans:
        while i < len(merged) and merged[i][1] < b:
            i += 1
        if i == len(merged) or a < merged[i][0]:
            out.append((a, b))
    return out


def judged(text: str, net: CharCNN) -> tuple[list[tuple[int, int, int]], int]:
    """All spans of one text, the base ones and runs that the network takes for secrets; and how many base spans it confirms."""
    base = base_spans(text)
    runs = _beyond(candidates(text), base)
    if not base and not runs:
        return [], 0
    p = scores(text, [(a, b) for a, _, b in base] + runs, net) >= net.threshold
    tokens = [(a, 3, b) for (a, b), x in zip(runs, p[len(base) :]) if x]
    return (sorted(base + tokens) if tokens else base), int(p[: len(base)].sum())


def scan(text: str, net: CharCNN) -> list[tuple[int, int, int]]:
    """All spans of one text."""
    return judged(text, net)[0]


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


MADE = "n_assign long, n_access long, n_hex long, n_token long, n_confirmed long, base_sha256 string, spans string"


def find(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, net: CharCNN | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with the counts of each kind, the digest of the base spans and all spans; one narrow pass."""
    names = [f.split()[0] for f in MADE.split(", ")]
    own = [c for c in (docs.columns if keep is None else keep) if c not in names]
    source = docs.select(*[f"`{c}`" for c in dict.fromkeys([*own, text_col])])
    net = net or default_network()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textscan.pieces(whole, text_col):
                rows = []
                for text in batch.column(text_col).to_pylist():
                    spans, confirmed = judged(text or "", net)
                    count = [*(sum(k == kind for _, k, _ in spans) for kind in range(4)), confirmed]
                    digest = hashlib.sha256(named([s for s in spans if s[1] < 3]).encode()).hexdigest()
                    rows.append((*count, digest, named(spans)))
                made = [pa.array([r[i] for r in rows], pa.int64() if i < 5 else pa.string()) for i in range(7)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *made], names=[*own, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in own]).schema]
    return source.mapInArrow(run, ", ".join([*fields, MADE]))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None, mark: str = "[SECRET]", net: CharCNN | None = None) -> DataFrame:
    """`docs` with each found span of the text replaced by `mark`; `length_col`, if given, gets the new number of code points.

    Null text stays null. Overlapping spans are replaced together. Columns and rows stay as they are.
    """
    net = net or default_network()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textscan.pieces(whole, text_col):
                texts = batch.column(text_col).to_pylist()
                out = []
                for text in texts:
                    parts, at = [], 0
                    for a, _, b in scan(text, net) if text else []:
                        if a >= at:
                            parts += [text[at:a], mark]
                        at = max(at, b)
                    out.append(text if not parts else "".join(parts) + text[at:])
                columns = {name: batch.column(name) for name in batch.schema.names}
                columns[text_col] = pa.array(out, batch.column(text_col).type)
                if length_col:
                    new = [len(o) if o is not None and o != t else n for o, t, n in zip(out, texts, batch.column(length_col).to_pylist())]
                    columns[length_col] = pa.array(new, batch.column(length_col).type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, docs.schema)
