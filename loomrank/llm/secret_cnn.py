"""A small character convolutional network for secrets, in numpy."""

from __future__ import annotations

import base64
import random
import string
from itertools import islice

import numpy as np

BEFORE, INSIDE, AFTER = 28, 48, 12
LENGTH = BEFORE + INSIDE + AFTER
DIM, WIDTH, FILTERS = 8, 5, 24
EPOCHS = 12
#: characters of a candidate at least, and from one window of a long one to the next
SHORTEST, STEP = 16, 8

_CLASS = np.zeros(128, np.int64)
for _i, _c in enumerate(string.ascii_lowercase):
    _CLASS[ord(_c)] = 2 + _i
    _CLASS[ord(_c.upper())] = 28 + _i
for _c in string.digits:
    _CLASS[ord(_c)] = 54 + int(_c) // 4
for _i, _c in enumerate("=:\"'_-+/.@ \n,#<>()"):
    _CLASS[ord(_c)] = 57 + _i
_CLASS[_CLASS == 0] = 75
N_CLASSES = 77  # 0: no character, 76: beyond ASCII


def encode(text: str, start: int, end: int, at: int | None = None) -> np.ndarray:
    """Character classes of a candidate (INSIDE characters from ``at``, or its first) and of what stands around it."""
    at = start if at is None else at
    parts = (text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0"), text[at : min(end, at + INSIDE)].ljust(INSIDE, "\0"), text[end : end + AFTER].ljust(AFTER, "\0"))
    code = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)[:LENGTH].astype(np.int64)
    out = np.where(code < 128, _CLASS[np.minimum(code, 127)], 76)
    out[code == 0] = 0
    return out


def windows(text: str, start: int, end: int) -> list[int]:
    """Where windows of a candidate begin: its start and, if it is longer than INSIDE, every STEP characters and behind each separator."""
    if end - start <= INSIDE:
        return [start]
    return [at for at in range(start, end - SHORTEST + 1) if (at - start) % STEP == 0 or not text[at - 1].isalnum() or at == end - SHORTEST]


class Network:
    """Embedding, one convolution, maxima over candidate and context, a logistic unit."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "e": rng.normal(0, 0.3, (N_CLASSES, DIM)),
            "w": rng.normal(0, 0.2, (WIDTH * DIM, FILTERS)),
            "b": np.zeros(FILTERS),
            "v": rng.normal(0, 0.2, 3 * FILTERS),
            "c": np.zeros(1),
        }
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}  # moments of gradients, and steps made
        self.s = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.steps = 0.0
        self.scale, self.shift = 1.0, 0.0  # calibration
        self.threshold = 0.5

    def state(self) -> np.ndarray:
        """All that :meth:`fit` changes, as one vector; means of such vectors are states too."""
        return np.concatenate([v.ravel() for part in (self.p, self.m, self.s) for v in part.values()] + [[self.steps]])

    def restore(self, state: np.ndarray) -> Network:
        at = 0
        for part in (self.p, self.m, self.s):
            for k, v in part.items():
                part[k] = state[at : at + v.size].reshape(v.shape).copy()
                at += v.size
        self.steps = float(state[at])
        return self

    def _forward(self, x: np.ndarray):
        e = self.p["e"][x]  # n, L, D
        n, length = x.shape
        cols = np.concatenate([e[:, i : length - WIDTH + 1 + i] for i in range(WIDTH)], 2)
        z = cols @ self.p["w"] + self.p["b"]
        a = np.maximum(z, 0)
        zones = [(0, BEFORE - 2), (BEFORE - 2, BEFORE + INSIDE - 2), (BEFORE + INSIDE - 2, a.shape[1])]
        tops = [a[:, s:t].argmax(1) + s for s, t in zones]
        h = np.concatenate([np.take_along_axis(a, t[:, None], 1)[:, 0] for t in tops], 1)
        return cols, a, tops, h, h @ self.p["v"] + self.p["c"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 2048])[-1] for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -40, 40)))

    def accepts(self, texts: list[str | None], spans: list[tuple[int, int, int]]) -> list[bool]:
        """Whether any window of each candidate ``(text number, start, end)`` reaches the threshold; a bounded number of windows is held at once."""
        out = [False] * len(spans)
        todo = ((k, i, s, e, at) for k, (i, s, e) in enumerate(spans) for at in windows(texts[i], s, e))
        while some := list(islice(todo, 2048)):
            p = self.probability(np.stack([encode(texts[i], s, e, at) for _, i, s, e, at in some]))
            for (k, *_), q in zip(some, p, strict=True):
                out[k] = out[k] or bool(q >= self.threshold)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int | tuple[int, ...] = 4) -> Network:
        """Adam over mini-batches; goes on from where an earlier call ended."""
        rng = np.random.default_rng(seed)
        m, s = self.m, self.s
        weight = np.ones(len(x)) if weight is None else weight
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                g = self._gradients(x[rows], y[rows], weight[rows])
                self.steps += 1
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.999 * s[k] + 0.001 * v * v
                    self.p[k] -= rate * (m[k] / (1 - 0.9**self.steps)) / (np.sqrt(s[k] / (1 - 0.999**self.steps)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        cols, a, tops, h, out = self._forward(x)
        n = len(x)
        d = weight * (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y) / n
        g = {"v": h.T @ d + 1e-4 * self.p["v"], "c": np.array([d.sum()])}
        dh = d[:, None] * self.p["v"]
        dw, db, de = np.zeros_like(self.p["w"]), np.zeros(FILTERS), np.zeros_like(self.p["e"])
        for zone, top in enumerate(tops):
            dz = dh[:, zone * FILTERS : (zone + 1) * FILTERS] * (np.take_along_axis(a, top[:, None], 1)[:, 0] > 0)
            db += dz.sum(0)
            patch = cols[np.arange(n)[:, None], top]  # n, F, W*D
            dw += np.einsum("nfk,nf->kf", patch, dz)
            dp = np.einsum("kf,nf->nfk", self.p["w"], dz).reshape(n, FILTERS, WIDTH, DIM)
            chars = x[np.arange(n)[:, None, None], top[:, :, None] + np.arange(WIDTH)]
            np.add.at(de, chars, dp)
        return g | {"w": dw + 1e-4 * self.p["w"], "b": db, "e": de}

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = 0.95, *more: np.ndarray) -> Network:
        """Platt scaling, then the highest threshold that keeps ``recall`` of the held-out secrets, and of each of ``more`` groups of secrets by itself."""
        z = self.logits(x)
        a, b = 1.0, 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
            a -= 0.05 * ((p - y) * z).mean()
            b -= 0.05 * (p - y).mean()
        self.scale, self.shift = a, b
        kept = [np.sort(self.probability(g)) for g in (x[y == 1], *more) if len(g)]
        self.threshold = min((float(p[int((1 - recall) * len(p))]) for p in kept), default=1.0)
        return self


_ALNUM, _UPPER, _HEX = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef"


def _some(rng: random.Random, chars: str, k: int) -> str:
    return "".join(rng.choice(chars) for _ in range(k))


def _prefixed(rng: random.Random) -> str:
    """A made-up issuer's mark, a joint, and a random body of one of several alphabets."""
    mark = _some(rng, rng.choice([string.ascii_lowercase, string.ascii_letters, string.ascii_uppercase]), rng.randint(2, 6))
    return mark + rng.choice(["_", "-", "_live_", "_v1_", ""]) + _some(rng, rng.choice([_ALNUM, _UPPER, _HEX, _HEX.upper(), _ALNUM + "_-"]), rng.choice([20, 24, 32, 36, 40]))


#: key formats that the network is trained on
TRAINED = {
    "hex": lambda r: _some(r, _HEX, r.choice([24, 32, 40, 64])),
    "access": lambda r: "AKIA" + _some(r, _UPPER, 16),
    "ghp_": lambda r: "ghp_" + _some(r, _ALNUM, 36),
    "sk_live_": lambda r: "sk_live_" + _some(r, _ALNUM, 24),
    "xoxb-": lambda r: f"xoxb-{_some(r, string.digits, 11)}-{_some(r, _ALNUM, 24)}",
    "AIza": lambda r: "AIza" + _some(r, _ALNUM + "_-", 35),
    "eyJ": lambda r: "eyJ" + _some(r, _ALNUM, 33) + "." + _some(r, _ALNUM + "_-", 40),
    "base64": lambda r: base64.b64encode(r.randbytes(r.choice([24, 30, 48]))).decode(),
    "letters and digits": lambda r: _some(r, _ALNUM, r.choice([20, 24, 32, 40])),
    "letters": lambda r: _some(r, string.ascii_letters, r.choice([20, 24, 32])),
    "prefixed": _prefixed,
}
#: key formats held out whole: never trained on, the threshold must keep the asked recall of each of them too
UNSEEN = {
    "glpat-": lambda r: "glpat-" + _some(r, _ALNUM + "_-", 20),
    "npm_": lambda r: "npm_" + _some(r, _ALNUM, 36),
    "upper-case hex": lambda r: _some(r, _HEX.upper(), r.choice([32, 40])),
    "SK hex": lambda r: "SK" + _some(r, _HEX, 32),
    "dop_v1_": lambda r: "dop_v1_" + _some(r, _HEX, 64),
}


def labelled_findings(n: int, words: list[str], seed: int = 11, formats=None) -> list[tuple[str, int, int, int]]:
    """``(text, start, end, label)``: keys of the formats (those to train on, unless given) among words of the corpus, and look-alikes that are none."""
    rng = random.Random(seed)
    secrets = list((TRAINED if formats is None else formats).values())

    def some(chars: str, k: int) -> str:
        return _some(rng, chars, k)

    lead = ["key = ", "bearer ", "Authorization: ", "auth=", "pwd: ", "credential: \"", "private_key='", "token ", "access ", "client=", ""]
    plain = [
        lambda: some(string.digits, rng.randint(16, 24)),
        lambda: "-".join(rng.choice(words) for _ in range(4)) + str(rng.randint(1, 2030)),
        lambda: "/" + "/".join(rng.choice(words) for _ in range(4)) + f"/{rng.randint(1, 9999)}",
        lambda: "_".join(rng.choice(words) for _ in range(3)) + f"_{rng.randint(1, 99)}",
        lambda: "".join(rng.choice(words) for _ in range(4)) + str(rng.randint(0, 99)),
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}_{rng.choice(words)}_{rng.choice(words)}",
        lambda: rng.choice("-=_+") * rng.randint(16, 40) + str(rng.randint(0, 9)),
        lambda: f"{rng.choice(words)}{rng.randint(1, 99)}+{rng.choice(words)}{rng.randint(1, 99)}+{rng.choice(words)}",
        lambda: rng.choice(words).lower() + "".join(rng.choice(words).title() for _ in range(rng.randint(3, 5))),
        lambda: rng.choice("-_/+").join(rng.choice(words).title() for _ in range(rng.randint(3, 5))),
        lambda: "/" + "/".join(rng.choice([str.lower, str.title])(rng.choice(words)) for _ in range(4)) + "/" + rng.choice(["README", "Makefile", "INDEX"]),
        lambda: f"+{some(string.digits, 2)}-{some(string.digits, 3)}-{some(string.digits, 4)}-{some(string.digits, 4)}",
    ]
    out = []
    for i in range(n):
        label = i % 2
        body = rng.choice(secrets)(rng) if label else rng.choice(plain)()
        before = " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))
        before = before + (" " if before else "") + (rng.choice(lead) if rng.random() < (0.75 if label else 0.15) else "")
        after = rng.choice(["", "\"", " ", "\n", ". "]) + " ".join(rng.choice(words) for _ in range(2))
        out.append((before + body + after, len(before), len(before) + len(body), label))
    return out


def recall_by_format(net: Network, words: list[str], n: int = 200, seed: int = 13) -> dict[str, float]:
    """Share of ``n`` fresh keys of each format that ``net`` accepts, and of look-alikes under ``"none"``."""
    out = {}
    for name, form in (TRAINED | UNSEEN).items():
        found = labelled_findings(2 * n, words, seed, {name: form})
        for label, key in ((1, name), (0, "none")):
            some = [(t, s, e) for t, s, e, y in found if y == label]
            out[key] = float(np.mean(net.accepts([t for t, *_ in some], [(i, s, e) for i, (_, s, e) in enumerate(some)])))
    return out
