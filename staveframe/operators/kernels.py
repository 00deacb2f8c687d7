"""Order-dependent algorithms on one track's arrays; NumPy only, so that they are tested without Spark."""

from __future__ import annotations

import numpy as np


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """States (rows: frames, columns: states) of the best path, where changing the state costs ``penalty``. The first
    state wins ties, and staying wins against changing."""
    n, states = scores.shape
    if not n:
        return np.zeros(0, dtype=np.int64)
    best, back = scores[0].astype(np.float64).copy(), np.zeros((n, states), dtype=np.int64)
    for t in range(1, n):
        top = int(np.argmax(best))
        change = best[top] - penalty
        stay = best >= change
        back[t] = np.where(stay, np.arange(states), top)
        best = np.where(stay, best, change) + scores[t]
    path = np.empty(n, dtype=np.int64)
    path[-1] = int(np.argmax(best))
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def chord_scores(roots: np.ndarray, qualities: np.ndarray, silent: np.ndarray) -> np.ndarray:
    """Log scores of the 12 x qualities + 1 states of each frame from the shares of roots, qualities and no chord."""
    pitched = roots[:, :, None] * qualities[:, None, :] * (1 - silent)[:, None, None]
    return np.log(np.maximum(1e-9, np.concatenate([pitched.reshape(len(roots), -1), silent[:, None]], axis=1)))


def greedy_match(left: np.ndarray, right: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """One-to-one pairs of times in order: for each on the left, the nearest unused one on the right within the tolerance,
    the first among equals. Only the times within the tolerance are looked at."""
    used, pairs = [False] * len(right), []
    reach = np.searchsorted(right, left - tolerance, "left"), np.searchsorted(right, left + tolerance, "right")
    low, high, times = (x.tolist() for x in (*reach, right))
    for i, t in enumerate(left.tolist()):
        near = [(abs(times[j] - t), j) for j in range(max(0, low[i] - 1), min(len(times), high[i] + 1)) if not used[j] and abs(times[j] - t) <= tolerance]
        if near:
            j = min(near)[1]
            used[j] = True
            pairs.append((i, j))
    return pairs


def hysteresis(observed: list[str], decoded: list[str], needed: int = 2) -> list[str]:
    """Labels that change only after ``needed`` windows in a row support the new one, and then from the first of these."""
    out: list[str] = []
    current, waiting, since = None, None, 0
    for k, (seen, want) in enumerate(zip(observed, decoded, strict=True)):
        if current is None or want == current:
            current, waiting = want, None
        elif want != waiting:
            waiting, since = want, k
        out.append(current)
        if waiting is not None and sum(x == waiting for x in (*observed[since:k], seen)) >= needed and k - since + 1 >= needed:
            current, waiting = waiting, None
            out[since:] = [current] * (k + 1 - since)
    return out


def absorb_short(regions: list[tuple[float, float, str]], least: float) -> list[tuple[float, float, str]]:
    """Regions shorter than ``least`` join the region before, as merged so far; equal neighbours become one."""
    out: list[list] = []
    for start, end, label in regions:
        if out and (end - start < least or out[-1][2] == label):
            out[-1][1] = end
        else:
            out.append([start, end, label])
    return [tuple(x) for x in out]


def settle_short(labels: list[str], lengths: list[float], least: float) -> list[str]:
    """Gives the first run that is shorter than ``least`` the label of its longer neighbour (the earlier of equals), and
    starts again, until none is left or one label remains."""
    runs = [[label, length] for label, length in zip(labels, lengths, strict=True)]
    owner = [[k] for k in range(len(runs))]

    def joined() -> None:
        k = 1
        while k < len(runs):
            if runs[k][0] == runs[k - 1][0]:
                runs[k - 1][1] += runs.pop(k)[1]
                owner[k - 1] += owner.pop(k)
            else:
                k += 1

    joined()
    while len(runs) > 1:
        short = next((k for k, r in enumerate(runs) if r[1] < least), None)
        if short is None:
            break
        beside = [k for k in (short - 1, short + 1) if 0 <= k < len(runs)]
        runs[short][0] = runs[max(beside, key=lambda k: (runs[k][1], -k))][0]
        joined()
    out = list(labels)
    for run, own in zip(runs, owner, strict=True):
        for k in own:
            out[k] = run[0]
    return out


def confirmed_changes(scores: list[dict[str, float]], decay: float = 0.6, lead: float = 0.15, needed: int = 2) -> list[str]:
    """Labels decided as windows come: evidence of each label decays; another label is taken up once it has led by
    ``lead`` for ``needed`` windows, from the first of these on."""
    held: dict[str, float] = {}
    out: list[str] = []
    current, rival, since = None, None, 0
    for k, seen in enumerate(scores):
        held = {label: decay * held.get(label, 0.0) + (1 - decay) * seen.get(label, 0.0) for label in sorted({*held, *seen})}
        top = max(held, key=lambda x: (held[x], x)) if held else None
        if current is None:
            current = top
        elif top != current and held[top] - held.get(current, 0.0) >= lead:
            if rival != top:
                rival, since = top, k
            if k - since + 1 >= needed:
                current, rival = top, None
                out[since:] = [current] * (len(out) - since)
        else:
            rival = None
        out.append(current)
    return out


def row_packing(widths: list[float], room: float) -> list[int]:
    """The row of each item, where a new row begins when the next would overflow."""
    row, used, out = 0, 0.0, []
    for w in widths:
        if used and used + w > room:
            row, used = row + 1, 0.0
        used += w
        out.append(row)
    return out


def mulberry32(seed: int, n: int) -> np.ndarray:
    """The first ``n`` numbers from 0 to 1 of the 32-bit generator of this name."""
    with np.errstate(over="ignore"):
        a = (np.uint32(seed & 0xFFFFFFFF) + np.arange(1, n + 1, dtype=np.uint32) * np.uint32(0x6D2B79F5)).astype(np.uint32)
        t = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
        t ^= t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))
        return (t ^ (t >> np.uint32(14))).astype(np.float64) / 4294967296.0


def bootstrap_interval(values: np.ndarray, seed: int, rounds: int) -> tuple[float, float] | None:
    """2.5 and 97.5 per cent points of the means of ``rounds`` samples with replacement; None without values."""
    values = np.asarray(values, dtype=np.float64)
    values = values[np.isfinite(values)]
    if not len(values):
        return None
    pick = (mulberry32(seed, rounds * len(values)) * len(values)).astype(np.int64).reshape(rounds, len(values))
    low, high = np.quantile(values[pick].mean(axis=1), [0.025, 0.975])
    return float(np.floor(low * 1e6 + 0.5) / 1e6), float(np.floor(high * 1e6 + 0.5) / 1e6)


def tcn_forward(x: np.ndarray, weights: dict) -> dict[str, np.ndarray]:
    """Temporal convolution network over frames (rows): a projection, residual blocks of dilated width-3 convolutions
    with rectifiers, and linear heads; softmax for ``root`` and ``quality``, a logistic curve for the others."""
    h = x @ np.asarray(weights["projection"]["w"]).T + np.asarray(weights["projection"]["b"])
    for block in weights["blocks"]:
        w, d = np.asarray(block["w"]), int(block["dilation"])  # out x in x 3
        padded = np.pad(h, ((d, d), (0, 0)))
        y = sum(padded[k * d : k * d + len(h)] @ w[:, :, k].T for k in range(3)) + np.asarray(block["b"])
        h = h + np.maximum(0.0, y)
    out = {}
    for name, head in weights["heads"].items():
        z = h @ np.asarray(head["w"]).T + np.asarray(head["b"])
        e = np.exp(z - z.max(axis=1, keepdims=True))
        out[name] = e / e.sum(axis=1, keepdims=True) if name in ("root", "quality") else 1 / (1 + np.exp(-z))
    return out
