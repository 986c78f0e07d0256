"""A small character convolutional network in numpy that tells secrets from other long tokens.

Input: 24 bytes before, 48 of the candidate, 8 after; a byte's code also tells whether it belongs to the candidate.
Layers: an embedding, one convolution, ReLU, maximum and mean over the places, one linear unit. At inference, embedding
and convolution fold into one table, so that a convolution is a few gathers and sums.

There is no table of labelled secrets, so the labelled findings are made by rule, from a fixed seed: keys of usual
shapes, bare or assigned, against words, compounds, identifiers, numbers, paths, hosts and rulers. A part is held out: a
temperature and shift fitted to it calibrate the scores, and the threshold is the highest at which at least ``RECALL`` of
its secrets score as much.
"""

from __future__ import annotations

import base64
import functools
from dataclasses import dataclass

import numpy as np

BEFORE, BODY, AFTER = 24, 48, 8
WIDTH = BEFORE + BODY + AFTER
KERNEL, EMBED, FILTERS = 5, 8, 24
RECALL = 0.99
SEED, FINDINGS, EPOCHS = 20, 8000, 8


def codes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Codes of windows over bytes start..end of texts lo..hi: 0 outside the text, 256 more inside the candidate."""
    at = start[:, None] + np.arange(-BEFORE, BODY + AFTER)[None, :]
    inside = (at >= start[:, None]) & (at < np.minimum(end, start + BODY)[:, None])
    valid = (at >= lo[:, None]) & (at < hi[:, None]) & (at < (np.minimum(end, start + BODY) + AFTER)[:, None])
    if not len(data):
        return np.zeros(at.shape, np.int64)
    byte = np.minimum(data[np.clip(at, 0, len(data) - 1)], 128).astype(np.int64)
    return np.where(valid, byte + 256 * inside, 0)


@dataclass
class Network:
    embed: np.ndarray
    kernel: np.ndarray  # KERNEL, EMBED, FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    shift: float
    scale: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    def hidden(self, x: np.ndarray) -> np.ndarray:
        table = np.einsum("ce,kef->kcf", self.embed, self.kernel).astype(np.float32)
        places = x.shape[1] - KERNEL + 1
        h = np.broadcast_to(self.bias.astype(np.float32), (len(x), places, FILTERS)).copy()
        for k in range(KERNEL):
            h += table[k][x[:, k : k + places]]
        return np.maximum(h, 0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(x), 2048):
            h = self.hidden(x[i : i + 2048])
            parts.append(np.concatenate([h.max(axis=1), h.mean(axis=1)], axis=1) @ self.out + self.shift)
        return np.concatenate(parts) if parts else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability that the candidate is a secret."""
        return 1 / (1 + np.exp(-np.clip(self.logits(x) * self.scale + self.offset, -60, 60)))


def findings(rng: np.random.Generator, n: int) -> tuple[list[tuple[bytes, int, int]], np.ndarray]:
    """(text, start, end) of candidates, and their labels."""
    syllables = "al an ber che der en ei er fa ga heit ing is ja keit la lich men na on or pre que ra sch st te tion un ver wo zu chaft ff gen hr lung schl ción mente aux eau pf tz".split()
    hexa, alnum, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

    def draw(chars: str, k: int) -> str:
        return "".join(chars[i] for i in rng.integers(0, len(chars), k))

    def word(least: int) -> str:
        w = ""
        while len(w) < least:
            w += syllables[rng.integers(len(syllables))]
        return w

    def pick(xs):
        return xs[rng.integers(len(xs))]

    def prose(k: int) -> str:
        return " ".join(word(int(rng.integers(1, 9))) for _ in range(k))

    out, labels = [], []
    for _ in range(n):
        secret = rng.random() < 0.5
        if secret:
            kind = rng.integers(7)
            k = int(rng.integers(16, 65))
            token = (
                draw(hexa, pick([32, 40, 64, k])) if kind == 0
                else draw(hexa, pick([32, 40, 64, k])).upper() if kind == 1
                else draw(alnum, k) if kind == 2
                else base64.b64encode(rng.bytes(k)).decode() if kind == 3
                else "AKIA" + draw(alnum[:26] + alnum[-10:], 16) if kind == 4
                else pick(["sk-", "ghp_", "xoxb-", "pk_live_", "glpat-", "hf_"]) + draw(alnum, k) if kind == 5
                else "eyJ" + draw(b64, k) + "." + draw(b64, k)
            )
            before = pick(["token = \"", "key: ", "secret=", "password: ", "Authorization: Bearer ", "", "", "id ", " ", "\n"])
        else:
            kind, least = rng.integers(11), int(rng.integers(16, 36))
            token = (
                word(least) + pick(["", "", "."]) if kind < 3
                else word(least).upper() + pick(["", "."]) if kind == 3
                else word(least).capitalize() if kind == 4
                else pick("-_.").join(word(4) for _ in range(int(rng.integers(3, 7)))) if kind == 5
                else draw("0123456789", int(rng.integers(16, 22))) if kind == 6
                else "/".join(word(3) for _ in range(int(rng.integers(4, 8)))) + pick([".html", "", ".py", "/"]) if kind == 7
                else pick("-=._") * int(rng.integers(16, 60)) if kind == 8
                else pick(["www.", "mail.", ""]) + word(9) + pick([".example.com", ".example.org", ".com.net"]) if kind == 9
                else word(8) + pick(["", "_", "-"]) + word(8) + pick(["1", "2024", "v2", "", "."])
            )
            while len(token) < 16:
                token += word(3)
            before = pick(["", "", "", "", "id ", "(", "\n", "see: ", "http:", "key "])
        token = token.encode("ascii", "ignore").decode()
        left, right = (prose(3) + " " + before).encode(), (pick(["", "\"", ".", ",", ")"]) + pick([" ", "\n", ""]) + pick(["", prose(2)])).encode()
        if right[:1].isalnum():
            right = b" " + right
        text = left + token.encode() + right
        out.append((text, len(left), len(left) + len(token)))
        labels.append(secret)
    return out, np.asarray(labels, float)


def encode(found: list[tuple[bytes, int, int]]) -> np.ndarray:
    data = np.frombuffer(b"".join(t for t, _, _ in found), np.uint8)
    ends = np.cumsum([len(t) for t, _, _ in found])
    base = ends - np.asarray([len(t) for t, _, _ in found])
    s, e = np.asarray([x[1] for x in found]), np.asarray([x[2] for x in found])
    return codes(data, base + s, base + e, base, ends)


def train(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = EPOCHS) -> Network:
    net = Network(rng.normal(0, 0.3, (512, EMBED)), rng.normal(0, 0.2, (KERNEL, EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), 0.0)
    names = ("embed", "kernel", "bias", "out")
    state = {n: (np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))) for n in names}
    step, places = 0, x.shape[1] - KERNEL + 1
    for epoch in range(epochs):
        rate = 0.006 * (1 - epoch / epochs)
        order = rng.permutation(len(x))
        for i in range(0, len(order), 128):
            b = order[i : i + 128]
            e = net.embed[x[b]]
            cols = np.concatenate([e[:, k : k + places] for k in range(KERNEL)], axis=2)
            flat = net.kernel.reshape(KERNEL * EMBED, FILTERS)
            h = np.maximum(cols @ flat + net.bias, 0)
            top = h.argmax(axis=1)
            pooled = np.concatenate([h.max(axis=1), h.mean(axis=1)], axis=1)
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.shift, -30, 30)))
            g = (p - y[b]) / len(b)
            gp = g[:, None] * net.out[None, :]
            gh = np.repeat(gp[:, None, FILTERS:] / places, places, axis=1)
            np.add.at(gh, (np.arange(len(b))[:, None], top, np.arange(FILTERS)[None, :]), gp[:, :FILTERS])
            gh *= h > 0
            gcols = gh @ flat.T
            ge = np.zeros_like(e)
            for k in range(KERNEL):
                ge[:, k : k + places] += gcols[:, :, k * EMBED : (k + 1) * EMBED]
            gembed = np.zeros_like(net.embed)
            np.add.at(gembed, x[b].reshape(-1), ge.reshape(-1, EMBED))
            grads = {"embed": gembed, "kernel": (cols.reshape(-1, KERNEL * EMBED).T @ gh.reshape(-1, FILTERS)).reshape(net.kernel.shape), "bias": gh.sum(axis=(0, 1)), "out": pooled.T @ g}
            net.shift -= 0.05 * float(g.sum())
            step += 1
            for n in names:
                m, v = state[n]
                m += 0.1 * (grads[n] - m)
                v += 0.001 * (grads[n] ** 2 - v)
                getattr(net, n)[...] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def calibrate(net: Network, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> Network:
    """Logistic calibration by Newton steps, then the highest threshold that keeps the recall."""
    z = net.logits(x)
    design = np.column_stack([z, np.ones(len(z))])
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        beta -= np.linalg.solve(hessian, design.T @ (p - y) + 1e-3 * (beta - [1.0, 0.0]))
    net.scale, net.offset = max(float(beta[0]), 1e-3), float(beta[1])
    own = np.sort(net.score(x[y == 1]))
    net.threshold = float(own[int(np.floor((1 - recall) * len(own)))])
    return net


@functools.cache
def model() -> Network:
    rng = np.random.default_rng(SEED)
    found, y = findings(rng, FINDINGS)
    x = encode(found)
    cut = len(x) * 3 // 4
    return calibrate(train(x[:cut], y[:cut], rng), x[cut:], y[cut:])
