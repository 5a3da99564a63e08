"""Training of the tagger in numpy: python -m leadloom.llm.pii_train DOCUMENTS LEADS OUT [MINUTES].

``MAX_DOCS`` documents at most are labelled (``pii_labels``) and cut into windows; the loss is the CRF's likelihood, the optimiser Adam.
"""

from __future__ import annotations

import sys
import time

import numpy as np
import pyarrow.dataset as ds

from leadloom.llm import pii, pii_labels

MAX_DOCS = 20_000
STEPS = 160
BATCH = 96
HIDDEN = 40
HALF = 20


def start_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    w = {"base": rng.normal(0, 0.5, (pii.BASES, HALF)).astype(np.float32), "cls": rng.normal(0, 0.5, (pii.CLASSES, HALF)).astype(np.float32)}
    for d in "fb":
        w |= {f"x_{d}": draw(2 * HALF, 4 * HIDDEN), f"h_{d}": draw(HIDDEN, 4 * HIDDEN), f"bias_{d}": np.zeros(4 * HIDDEN, np.float32)}
        w[f"bias_{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
    return w | {"out": draw(2 * HIDDEN, pii.TAGS), "out_bias": np.zeros(pii.TAGS, np.float32), "moves": np.zeros((pii.TAGS, pii.TAGS), np.float32), "start": np.zeros(pii.TAGS, np.float32)}


def run(x, wh):
    """Hidden states of inputs (steps, n, 4 hidden), and what the way back needs."""
    steps, n, four = x.shape
    size = four // 4
    h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    kept = np.empty((steps, n, four), np.float32)
    hs, cs, th = (np.empty((steps, n, size), np.float32) for _ in range(3))
    for t in range(steps):
        z = x[t] + h @ wh
        z[:, : 3 * size] *= 0.5
        z = np.tanh(z)
        z[:, : 3 * size] = 0.5 * (z[:, : 3 * size] + 1)
        c = z[:, size : 2 * size] * c + z[:, :size] * z[:, 3 * size :]
        tc = np.tanh(c)
        h = z[:, 2 * size : 3 * size] * tc
        kept[t], hs[t], cs[t], th[t] = z, h, c, tc
    return hs, (kept, hs, cs, th)


def back(grad, kept, wh):
    """Gradients of the inputs and the state's weights, from those of the hidden states."""
    z, hs, cs, th = kept
    steps, n, size = grad.shape
    dz_all = np.empty((steps, n, 4 * size), np.float32)
    dh, dc = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g = (z[t][:, k * size : (k + 1) * size] for k in range(4))
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - th[t] ** 2)
        before = cs[t - 1] if t else 0.0
        dz = dz_all[t]
        dz[:, :size] = dc * g * i * (1 - i)
        dz[:, size : 2 * size] = dc * before * f * (1 - f)
        dz[:, 2 * size : 3 * size] = dh * th[t] * o * (1 - o)
        dz[:, 3 * size :] = dc * i * (1 - g**2)
        dc = dc * f
        dh = dz @ wh.T
    dwh = np.einsum("tnh,tnk->hk", hs[:-1], dz_all[1:], optimize=True)
    return dz_all, dwh


def crf(e, tags, moves, start):
    """Negative log likelihood a window, and its gradients."""
    steps, n, k = e.shape
    alpha, beta = np.empty_like(e), np.empty_like(e)
    scale = np.exp(moves - moves.max())
    top = moves.max()
    alpha[0] = start + e[0]
    for t in range(1, steps):
        m = alpha[t - 1].max(1, keepdims=True)
        alpha[t] = e[t] + np.log(np.exp(alpha[t - 1] - m) @ scale + 1e-30) + m + top
    beta[-1] = 0
    for t in range(steps - 2, -1, -1):
        y = beta[t + 1] + e[t + 1]
        m = y.max(1, keepdims=True)
        beta[t] = np.log(np.exp(y - m) @ scale.T + 1e-30) + m + top
    m = alpha[-1].max(1, keepdims=True)
    z = (np.log(np.exp(alpha[-1] - m).sum(1, keepdims=True)) + m)[:, 0]
    rows = np.arange(n)
    gold = start[tags[0]] + e[0, rows, tags[0]]
    for t in range(1, steps):
        gold = gold + moves[tags[t - 1], tags[t]] + e[t, rows, tags[t]]
    p = np.exp(alpha + beta - z[None, :, None])
    de = p.copy()
    de[np.arange(steps)[:, None], rows[None], tags] -= 1
    dmoves = np.zeros_like(moves)
    for t in range(1, steps):
        a = alpha[t - 1] - z[:, None]
        y = beta[t] + e[t]
        ma, my = a.max(1, keepdims=True), y.max(1, keepdims=True)
        w = np.exp(np.minimum(ma + my, 50))
        dmoves += (np.exp(a - ma) * w).T @ np.exp(y - my) * np.exp(moves)
        np.subtract.at(dmoves, (tags[t - 1], tags[t]), 1)
    dstart = de[0].sum(0)
    return float((z - gold).mean()), de / n, dmoves / n, dstart / n


def loss(w, base, cls, tags):
    x = np.concatenate([w["base"][base], w["cls"][cls]], axis=2)
    hf, kf = run(x @ w["x_f"] + w["bias_f"], w["h_f"])
    hb, kb = run(x[::-1] @ w["x_b"] + w["bias_b"], w["h_b"])
    h = np.concatenate([hf, hb[::-1]], axis=2)
    e = h @ w["out"] + w["out_bias"]
    value, de, dmoves, dstart = crf(e, tags, w["moves"], w["start"])
    g = {"out": np.einsum("tnh,tnk->hk", h, de, optimize=True), "out_bias": de.sum((0, 1)), "moves": dmoves, "start": dstart}
    dh = de @ w["out"].T
    size = hf.shape[2]
    dx = 0
    for d, part, kept, turn in (("f", dh[:, :, :size], kf, 1), ("b", dh[::-1, :, size:], kb, -1)):
        dz, g[f"h_{d}"] = back(np.ascontiguousarray(part), kept, w[f"h_{d}"])
        g[f"x_{d}"] = np.einsum("tnd,tnk->dk", x[::turn], dz, optimize=True)
        g[f"bias_{d}"] = dz.sum((0, 1))
        dx = dx + (dz @ w[f"x_{d}"].T)[::turn]
    g["base"], g["cls"] = np.zeros_like(w["base"]), np.zeros_like(w["cls"])
    np.add.at(g["base"], base, dx[:, :, :HALF])
    np.add.at(g["cls"], cls, dx[:, :, HALF:])
    return value, g


def labelled(texts: list[str], given: frozenset[str], common: frozenset[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t in texts:
        tags = np.zeros(len(t), dtype=np.int8)
        for a, b, kind in pii_labels.spans(t, given, common):
            k = pii.KINDS.index(kind)
            tags[a], tags[a + 1 : b] = 1 + 2 * k, 2 + 2 * k
        out.append((pii.encode(t), tags))
    return out


def train(texts: list[str], given: frozenset[str], common: frozenset[str], minutes: float, seed: int = 7, held: list[str] | None = None, save=None) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    data = labelled(texts, given, common)
    # Windows around mentions and windows anywhere, half and half.
    hits = [(i, int(p)) for i, (_, tags) in enumerate(data) for p in np.flatnonzero(tags % 2 == 1)]
    weights = np.array([len(t) for _, t in data], dtype=float)
    weights /= weights.sum()
    w = start_weights(rng)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    began, step, mean = time.time(), 0, None
    while (spent := (time.time() - began) / 60 / minutes) < 1:
        base, cls, tags = (np.zeros((STEPS, BATCH), dtype=np.int64) for _ in range(3))
        for j in range(BATCH):
            if j % 2 and hits:
                i, p = hits[rng.integers(len(hits))]
                a = p - int(rng.integers(STEPS))
            else:
                i = int(rng.choice(len(data), p=weights))
                a = int(rng.integers(-STEPS // 4, max(1, len(data[i][1]) - STEPS // 2)))
            ids, t = data[i]
            lo, hi = max(0, a), min(len(t), a + STEPS)
            off = 0 if a >= 0 else (-a if rng.random() < 0.3 else 0)
            n = min(hi - lo, STEPS - off)
            base[off : off + n, j], cls[off : off + n, j], tags[off : off + n, j] = ids[0, lo : lo + n], ids[1, lo : lo + n], t[lo : lo + n]
        value, g = loss(w, base, cls, tags)
        norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
        step += 1
        rate = 6e-3 * min(1, step / 100) * (1 - spent) ** 0.7 + 2e-5
        for k in w:
            x = g[k] * min(1, 8 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * x
            second[k] = 0.995 * second[k] + 0.005 * x * x
            w[k] = (w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
        mean = value if mean is None else 0.98 * mean + 0.02 * value
        if step % 200 == 0:
            print(f"{step} steps, {spent * minutes:.1f} min, loss {mean:.3f}" + (f", held out {score(w, held, given, common)}" if held and step % 1000 == 0 else ""), flush=True)
            if save:
                save(w)
    return w


def score(w: dict[str, np.ndarray], texts: list[str], given: frozenset[str], common: frozenset[str]) -> dict[str, str]:
    """Precision and recall by kind of the starts found, against the labels."""
    net = pii.Network(w)
    hit, got, want = ({k: 0 for k in pii.KINDS} for _ in range(3))
    for t, tags in zip(texts, net.tag(texts)):
        a = {(x, k) for x, _, k in pii.mentions(t, tags)}
        b = {(x, k) for x, _, k in pii_labels.spans(t, given, common)}
        for s, to in ((a & b, hit), (a, got), (b, want)):
            for _, k in s:
                to[k] += 1
    return {k: f"{hit[k] / max(1, got[k]):.3f}/{hit[k] / max(1, want[k]):.3f}" for k in pii.KINDS}


def read(path: str, *columns: str):
    return ds.dataset(path, format="parquet").to_table(columns=list(columns))


def main(documents: str, leads: str, out: str, minutes: str = "10") -> None:
    texts = [t for t in read(documents, "text")["text"].to_pylist()[:MAX_DOCS] if t and not t.isspace()]
    given = pii_labels.given_names(read(leads, "first_name")["first_name"].to_pylist())
    common = pii_labels.common_words(texts)
    n = len(texts) // 50
    save = lambda w: np.savez_compressed(out, **{k: v.astype(np.float16) for k, v in w.items()})
    w = train(texts[n:], given, common, float(minutes), held=texts[:n], save=save)
    save(w)
    print("held out, precision/recall:", score({k: v.astype(np.float16) for k, v in w.items()}, texts[:n], given, common))


if __name__ == "__main__":
    main(*sys.argv[1:])
