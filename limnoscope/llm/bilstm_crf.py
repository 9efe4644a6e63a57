"""A small character-level bidirectional LSTM with CRF transitions in numpy: training, emissions and best paths."""

from __future__ import annotations

import numpy as np

#: Characters the model tells apart: printable ASCII, line ends, other white space, letters and signs beyond ASCII, padding.
PAD, LETTER, SIGN, BLANK, LINE = 0, 96, 97, 98, 99
VOCABULARY = 100


def char_codes(text: str) -> np.ndarray:
    points = np.array([ord(c) for c in text], dtype=np.int64)
    out = np.where((points >= 32) & (points < 127), points - 31, SIGN)
    for k in np.flatnonzero(points >= 127):
        out[k] = LETTER if text[k].isalpha() else BLANK if text[k].isspace() else SIGN
    out[points == 10] = LINE
    out[(points == 9) | (points == 13) | (points == 11) | (points == 12)] = BLANK
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def fresh(tags: int, embed: int = 12, hidden: int = 16, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    wide = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape)
    bias = np.zeros((2, 1, 4 * hidden))
    bias[:, :, hidden : 2 * hidden] = 1.0
    return {
        "embed": rng.normal(0, 0.5, (VOCABULARY, embed)), "inward": wide(2, embed, 4 * hidden), "inner": wide(2, hidden, 4 * hidden),
        "bias": bias, "out": wide(2 * hidden, tags), "out_bias": np.zeros(tags), "moves": np.zeros((tags, tags)), "start": np.zeros(tags),
    }


def _run(p: dict, codes: np.ndarray, keep: bool):
    """Hidden states of both directions; direction 1 reads the window backwards."""
    x = p["embed"][codes]
    both = np.stack([x, x[:, ::-1]])
    pre = both @ p["inward"][:, None] + p["bias"][:, None]
    n, steps, h_size = codes.shape[0], codes.shape[1], p["inner"].shape[1]
    h, c = np.zeros((2, n, h_size)), np.zeros((2, n, h_size))
    states, tape = np.zeros((2, n, steps, h_size)), []
    for t in range(steps):
        z = pre[:, :, t] + h @ p["inner"]
        i, f, o = (_sigmoid(z[..., k * h_size : (k + 1) * h_size]) for k in range(3))
        g = np.tanh(z[..., 3 * h_size :])
        before_c, before_h = c, h
        c = f * c + i * g
        shown = np.tanh(c)
        h = o * shown
        states[:, :, t] = h
        if keep:
            tape.append((i, f, o, g, before_c, before_h, shown))
    merged = np.concatenate([states[0], states[1][:, ::-1]], axis=-1)
    return both, merged, tape


def emissions(p: dict, codes: np.ndarray) -> np.ndarray:
    """Tag scores of every character of equally long windows."""
    return _run(p, codes, False)[1] @ p["out"] + p["out_bias"]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _crf_gradient(p: dict, scores: np.ndarray, tags: np.ndarray):
    """Loss and its gradients for scores, transitions and start, by forward and backward sums."""
    n, steps, k = scores.shape
    moves, rows = p["moves"], np.arange(n)
    a = np.zeros((n, steps, k))
    b = np.zeros((n, steps, k))
    a[:, 0] = scores[:, 0] + p["start"]
    for t in range(1, steps):
        a[:, t] = scores[:, t] + _lse(a[:, t - 1][:, :, None] + moves[None], 1)
    for t in range(steps - 2, -1, -1):
        b[:, t] = _lse(moves[None] + (scores[:, t + 1] + b[:, t + 1])[:, None, :], 2)
    whole = _lse(a[:, -1], 1)
    d_scores = np.exp(a + b - whole[:, None, None])
    d_moves = np.zeros((k, k))
    for t in range(1, steps):
        d_moves += np.exp(a[:, t - 1][:, :, None] + moves[None] + (scores[:, t] + b[:, t])[:, None, :] - whole[:, None, None]).sum(0)
    d_start = d_scores[:, 0].sum(0)
    gold = p["start"][tags[:, 0]] + np.take_along_axis(scores, tags[:, :, None], 2)[:, :, 0].sum(1) + moves[tags[:, :-1], tags[:, 1:]].sum(1)
    for t in range(steps):
        d_scores[rows, t, tags[:, t]] -= 1
    np.add.at(d_moves, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
    np.add.at(d_start, tags[:, 0], -1)
    return float((whole - gold).mean()), d_scores / n, d_moves / n, d_start / n


def gradients(p: dict, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Mean loss of equally long windows and the gradient of every parameter."""
    both, merged, tape = _run(p, codes, True)
    loss, d_scores, d_moves, d_start = _crf_gradient(p, merged @ p["out"] + p["out_bias"], tags)
    h_size, steps = p["inner"].shape[1], codes.shape[1]
    g = {"moves": d_moves, "start": d_start, "out_bias": d_scores.sum((0, 1)), "out": np.tensordot(merged, d_scores, ([0, 1], [0, 1]))}
    d_merged = d_scores @ p["out"].T
    d_states = np.stack([d_merged[..., :h_size], d_merged[:, ::-1, h_size:]])
    d_pre = np.zeros((*both.shape[:3], 4 * h_size))
    g["inner"] = np.zeros_like(p["inner"])
    d_h, d_c = np.zeros_like(d_states[:, :, 0]), np.zeros_like(d_states[:, :, 0])
    turned = np.swapaxes(p["inner"], 1, 2)
    for t in range(steps - 1, -1, -1):
        i, f, o, new, before_c, before_h, shown = tape[t]
        d_h = d_h + d_states[:, :, t]
        d_c = d_c + d_h * o * (1 - shown * shown)
        z = np.concatenate([d_c * new * i * (1 - i), d_c * before_c * f * (1 - f), d_h * shown * o * (1 - o), d_c * i * (1 - new * new)], axis=-1)
        d_pre[:, :, t] = z
        g["inner"] += np.swapaxes(before_h, 1, 2) @ z
        d_h, d_c = z @ turned, d_c * f
    g["bias"] = d_pre.sum((1, 2))[:, None]
    g["inward"] = np.einsum("dnte,dntz->dez", both, d_pre)
    d_both = d_pre @ np.swapaxes(p["inward"], 1, 2)[:, None]
    d_x = d_both[0] + d_both[1][:, ::-1]
    g["embed"] = np.zeros_like(p["embed"])
    np.add.at(g["embed"], codes.ravel(), d_x.reshape(-1, d_x.shape[-1]))
    return loss, g


def train(codes: np.ndarray, tags: np.ndarray, classes: int, steps: int = 260, batch: int = 48, rate: float = 0.02, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam over shuffled batches of labelled windows, all of one length."""
    p = fresh(classes, seed=seed)
    rng = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        at = rng.integers(0, len(codes), batch)
        _, g = gradients(p, codes[at], tags[at])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        now = rate * min(1.0, 5.0 / (norm + 1e-9)) * (1 - 0.9 * step / steps)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] = p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return p


def best_paths(p: dict, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Viterbi tags of padded score sequences; steps beyond a length keep the state. One byte a tag for the way back."""
    n, steps, k = scores.shape
    best = scores[:, 0] + p["start"]
    back = np.zeros((n, steps, k), dtype=np.uint8)
    for t in range(1, steps):
        total = best[:, :, None] + p["moves"][None]
        back[:, t] = total.argmax(1)
        moved = total.max(1) + scores[:, t]
        live = t < lengths
        back[~live, t] = np.arange(k)
        best = np.where(live[:, None], moved, best)
    tags = np.zeros((n, steps), dtype=np.uint8)
    tags[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
    return tags
