"""Decoders with the constants of the production rules, on one track's arrays; NumPy only. ``tracks`` applies them to
every track. Labels are the twelve roots with their qualities, and ``N`` for no chord."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np

# The costs and bounds of the decoders, in scores, seconds, semitones and frets.
LEAST_SECONDS, NEEDED, MARGIN, FALLBACK_WINDOW = 1.5, 2, 0.04, 1.0
CHANGE, OFF_BEAT, WEAK, SHORT, NO_CHORD, COMMON = 0.09, 0.08, 0.1, 0.12, 0.18, 0.035
LEAST_CONFIDENCE, LEAST_MARGIN, MOST_ADJUSTMENT = 0.16, 0.01, 0.08
COMMON_STEPS = {"major": ((0, 7), (7, 0), (0, 5), (9, 5), (2, 7), (7, 9), (5, 7)), "minor": ((0, 7), (7, 0), (0, 5), (10, 0), (5, 7), (7, 8), (0, 10))}
GAP_COST, SAME_FAMILY, SAME_ROOT, RELATIVE, FIFTH, ONE_SILENT = 0.72, 0.18, 0.34, 0.48, 0.65, 0.9
HOP, SLOWEST, FASTEST, PRIOR, PRIOR_TEMPO, PRIOR_WIDTH, DOUBLED_UP_TO, DOUBLED_SHARE = 1024, 60, 190, 0.08, 120, 130, 95, 0.72
LOWEST, HIGHEST, SKIP, RESET, REST, LEAP, WIDE_LEAP, WIDE_FROM = 40, 88, 0.18, 1.6, 1.25, 0.035, 0.12, 12
FRET, STRING, HIGH_FRET, HIGH_FROM, OPEN, FIRST_FRET, LONG_GAP, LONG_GAP_WEIGHT = 0.7, 0.45, 0.08, 12, 0.35, 0.06, 1.0, 0.55
#: Open-string chords as strings and frets, from the highest string: E, Em, C, A, Am, G, D, Dm.
VOICINGS = frozenset(
    {
        ((1, 0), (2, 0), (3, 1), (4, 2), (5, 2), (6, 0)), ((1, 0), (2, 0), (3, 0), (4, 2), (5, 2), (6, 0)), ((1, 0), (2, 1), (3, 0), (4, 2), (5, 3)), ((1, 0), (2, 2), (3, 2), (4, 2), (5, 0)),
        ((1, 0), (2, 1), (3, 2), (4, 2), (5, 0)), ((1, 3), (2, 0), (3, 0), (4, 0), (5, 2), (6, 3)), ((1, 2), (2, 3), (3, 2), (4, 0)), ((1, 1), (2, 3), (3, 2), (4, 0)),
    }
)


@dataclass
class Windows:
    """Observations of a track's windows in order; arrays of one length, ``scores`` with a column for each label."""

    start: np.ndarray
    end: np.ndarray
    scores: np.ndarray
    strength: np.ndarray  # of the window's start as a boundary, 0 to 1
    uncertain: np.ndarray
    confidence: np.ndarray
    margin: np.ndarray  # of the best score over the second
    bass: np.ndarray  # confidence that a bass or a root is heard: (bass, root)
    key: list  # (tonic, mode, confidence) or None
    adjustment: np.ndarray


def plausible(roots: np.ndarray, key: tuple | None) -> np.ndarray:
    """How usual it is to go from each label to each other, 0 to 1; -1 among ``roots`` is no chord."""
    step = (roots[None, :] - roots[:, None]) % 12
    out = np.where((step == 5) | (step == 7), 0.7, 0.0)
    if key:
        tonic, mode, confidence = key
        degree = (roots - tonic) % 12
        for a, b in COMMON_STEPS[mode]:
            out[(degree[:, None] == a) & (degree[None, :] == b)] = 1.0
        out *= 0.6 + 0.4 * confidence
    silent = roots < 0
    return np.where(silent[:, None] | silent[None, :], 0.0, out)


def change_costs(w: Windows, t, roots: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Cost of going from each label (rows) to each other at window ``t``; at many windows at once if that is an array."""
    s = w.scores[t]
    at = lambda x: np.asarray(x)[..., None, None]
    gain = s[..., None, :] - s[..., :, None]
    cost = at(CHANGE + OFF_BEAT * (1 - w.strength[t])) + np.where(gain < MARGIN, WEAK * np.minimum(3.0, 1 + (MARGIN - gain) / MARGIN), 0.0)
    pitched = roots >= 0
    cost = cost + np.where(at(w.uncertain[t]) & pitched, WEAK, 0.0)
    cost = cost + np.where(at((w.bass[t, 0] >= 0.18) | (w.bass[t, 1] >= 0.2)) & ~pitched, NO_CHORD, 0.0)
    return np.maximum(0.0, cost - COMMON * usual - at(np.clip(w.adjustment[t], 0, MOST_ADJUSTMENT)))


def lasting_path(w: Windows, roots: np.ndarray) -> np.ndarray:
    """Label of each window along the best path, where a state is a label and for how many windows it has lasted (up to
    the number that the least duration takes). Leaving early and changing cost; the first state wins ties."""
    return lasting_paths(w, np.array([0, len(w.scores)]), roots)


def lasting_paths(w: Windows, cuts: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """:func:`lasting_path` of many tracks, which begin and end at ``cuts``: their windows of one number are worked out
    at once, so that the steps are as many as the longest has windows."""
    path = np.zeros(len(w.scores), dtype=np.int64)
    begins, sizes = cuts[:-1], np.diff(cuts)
    every_length, lasts = w.end - w.start, np.zeros(len(begins), dtype=np.int64)
    for k, (a, n) in enumerate(zip(begins.tolist(), sizes.tolist(), strict=True)):
        length = every_length[a : a + n]
        typical = float(np.median(length[length > 0])) if (length > 0).any() else FALLBACK_WINDOW
        lasts[k] = max(NEEDED, int(np.ceil(LEAST_SECONDS / typical)))
    number: dict = {}
    keys = np.array([number.setdefault(k, len(number)) for k in w.key], dtype=np.int64)
    usual = np.stack([plausible(roots, k) for k in number]) if number else None
    for ages in np.unique(lasts).tolist():
        of = np.flatnonzero((lasts == ages) & (sizes > 0))
        if len(of):
            of = of[np.argsort(-sizes[of], kind="stable")]
            _lasting(w, begins[of], sizes[of], ages, roots, keys, usual, path)
    return path


def _lasting(w: Windows, begins: np.ndarray, sizes: np.ndarray, ages: int, roots: np.ndarray, keys: np.ndarray, usual: np.ndarray, path: np.ndarray) -> None:
    """Fills in the paths of tracks, the longest first, whose states last up to ``ages`` windows."""
    labels, n = w.scores.shape[1], int(sizes[0])
    every, diagonal = np.arange(labels), np.eye(labels, dtype=bool)
    best = np.full((len(begins), labels, ages), -np.inf)
    best[:, :, 0] = w.scores[begins]
    early = SHORT * np.maximum(0, ages - np.arange(1, ages + 1)) / ages
    going = (len(sizes) - np.searchsorted(sizes[::-1], np.arange(n), side="right")).tolist()  # tracks that have a window t
    backs: list = [None] * n
    for t in range(1, n):
        rows = begins[: going[t]] + t
        old = best[: len(rows)]
        new, back = np.full_like(old, -np.inf), np.empty(old.shape, dtype=np.int32)
        new[:, :, 1:] = old[:, :, :-1]
        back[:, :, 1:] = every[:, None] * ages + np.arange(ages - 1)
        older = old[:, :, -1] > new[:, :, -1]  # the last age holds all longer ones too
        new[:, :, -1] = np.where(older, old[:, :, -1], new[:, :, -1])
        back[:, :, -1] = np.where(older, every * ages + ages - 1, back[:, :, -1])
        leave = old - early
        age = np.argmax(leave, axis=2)
        gain = np.take_along_axis(leave, age[:, :, None], 2) - change_costs(w, rows, roots, usual[keys[rows]])
        gain[:, diagonal] = -np.inf
        source = np.argmax(gain, axis=1)
        new[:, :, 0] = np.take_along_axis(gain, source[:, None, :], 1)[:, 0]
        back[:, :, 0] = source * ages + np.take_along_axis(age, source, 1)
        best[: len(rows)] = new + w.scores[rows][:, :, None]
        backs[t] = back.reshape(len(rows), -1)
    state = np.argmax(best.reshape(len(begins), -1), axis=1)
    for t in range(n - 1, -1, -1):
        m = going[t]
        path[begins[:m] + t] = state[:m] // ages
        if t:
            state[:m] = backs[t][np.arange(m), state[:m]]


def supported_changes(w: Windows, path: np.ndarray, none: int) -> np.ndarray:
    """The path with changes only where ``NEEDED`` windows in a row support one by score, confidence and margin, and then
    from the first of these on."""
    out = path.tolist()
    scores, confidence, margin = w.scores.tolist(), w.confidence.tolist(), w.margin.tolist()
    current, rival, since = out[0] if out else 0, -1, 0
    for k, want in enumerate(out[1:], 1):
        out[k] = current
        if want == current or scores[k][want] - scores[k][current] < MARGIN or not (want == none or (confidence[k] >= LEAST_CONFIDENCE and margin[k] >= LEAST_MARGIN)):
            rival = -1
            continue
        if want != rival:
            rival, since = want, k
        if k - since + 1 >= NEEDED:
            current, rival = want, -1
            out[since : k + 1] = [current] * (k + 1 - since)
    return np.array(out, dtype=path.dtype)


def label_costs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cost of taking each label on the left for each on the right; rows ``(root or -1, minor, number of the symbol)``."""
    a, b = left[:, None, :], right[None, :, :]
    apart = (b[..., 0] - a[..., 0]) % 12
    minor_a, minor_b = a[..., 1] == 1, b[..., 1] == 1
    relative = (minor_a & ~minor_b & (apart == 3)) | (~minor_a & minor_b & (apart == 9))
    return np.select(
        [a[..., 2] == b[..., 2], (a[..., 0] == b[..., 0]) & (minor_a == minor_b), a[..., 0] == b[..., 0], (a[..., 0] < 0) | (b[..., 0] < 0), relative, (apart == 5) | (apart == 7)],
        [0.0, SAME_FAMILY, SAME_ROOT, ONE_SILENT, RELATIVE, FIFTH], 1.0,
    )


def align(costs: np.ndarray, gap: float = GAP_COST) -> list[tuple[int | None, int | None]]:
    """Pairs of places of two sequences at least cost, from the costs of each pair; among equals a match comes before a
    missing and that before an extra label. Row by row; only the moves are kept, a byte for each pair."""
    n, m = costs.shape
    steps = np.arange(m + 1) * gap
    row, moves, near = steps.copy(), np.full((n + 1, m + 1), 2, dtype=np.uint8), 1e-9
    moves[1:, 0] = 1
    for i in range(1, n + 1):
        match, missing = row[:-1] + costs[i - 1], row[1:] + gap
        without = np.r_[i * gap, np.minimum(match, missing)]
        row = np.minimum.accumulate(without - steps) + steps  # extra labels as a running minimum
        moves[i, 1:] = np.where(match <= row[1:] + near, 0, np.where(missing <= row[1:] + near, 1, 2))
    out, i, j = [], n, m
    while i or j:
        move = moves[i, j]
        i, j = i - (move != 2), j - (move != 1)
        out.append((int(i) if move != 2 else None, int(j) if move != 1 else None))
    return out[::-1]


def beat_grid(levels: np.ndarray, rate: float) -> tuple[float, float] | None:
    """Beats a minute and phase in seconds of ``rate`` levels a second, by autocorrelation of their rises at each whole
    tempo, with a light preference for a middle one; a slow tempo is doubled where twice as fast is nearly as good."""
    rises = np.maximum(0.0, np.diff(levels, prepend=0.0))
    if len(rises) < 16:
        return None
    tempo = np.arange(SLOWEST, FASTEST + 1)
    lags = np.floor(60 * rate / tempo + 0.5).astype(np.int64)
    of_lag = {int(k): float((rises[k:] * rises[: len(rises) - k]).sum()) if k < len(rises) else 0.0 for k in np.unique(lags)}
    raw = np.array([of_lag[int(k)] for k in lags])
    weighted = raw * (1 + PRIOR * (1 - np.abs(tempo - PRIOR_TEMPO) / PRIOR_WIDTH))
    at = int(np.argmax(weighted))
    score = weighted[at]
    if tempo[at] <= DOUBLED_UP_TO:
        near = np.flatnonzero(np.abs(tempo - 2 * tempo[at]) <= 1)
        twice = near[np.argmax(raw[near])] if len(near) else None
        if twice is not None and raw[twice] >= DOUBLED_SHARE * raw[at]:
            at, score = int(twice), raw[twice]
    lag = int(lags[at])
    if score <= 1e-10 or lag < 1:
        return None
    phase = int(np.argmax([rises[p::lag].sum() for p in range(lag)]))
    return float(tempo[at]), phase / rate


def lead_voice(groups: list[list[tuple[float, float, int, float]]], least: float, high: float, companions: bool) -> list[tuple[int, int]]:
    """Places ``(group, note)`` of the lead voice through onset groups of notes ``(start, end, midi, confidence)``.

    A state is the level last played, or none. A group may be skipped, or the level given up, at a cost; leaps cost by
    their width; a long rest gives the level up for nothing. With ``companions``, the surest other note within an octave
    goes along where it is about as sure as the lead.
    """
    levels = np.arange(LOWEST, HIGHEST + 1)
    free, places = len(levels), np.arange(len(levels) + 1)
    leaps: dict[int, np.ndarray] = {}
    prior = np.full(free + 1, -np.inf)
    prior[free] = 0.0
    back, played = np.full((len(groups), free + 1), -1), np.full((len(groups), free + 1), -1)
    for g, group in enumerate(groups):
        if g and group[0][0] - groups[g - 1][0][1] > REST:
            prior[free] = prior.max()
        new = prior - SKIP
        back[g] = np.where(np.isfinite(prior), places, -1)
        top = int(np.argmax(prior))
        if prior[top] - RESET > new[free]:
            new[free], back[g, free] = prior[top] - RESET, top
        for k, (start, end, midi, confidence) in enumerate(group):
            if LOWEST <= midi <= HIGHEST:
                if midi not in leaps:
                    leap = np.abs(np.r_[levels, midi] - midi)
                    leaps[midi] = leap * LEAP + np.maximum(0, leap - WIDE_FROM) * WIDE_LEAP
                gain = prior + max(-0.2, (confidence - least) * 2.2) + min(0.35, max(0.0, end - start)) - leaps[midi]
                source, state = int(np.argmax(gain)), midi - LOWEST
                if gain[source] > new[state]:
                    new[state], back[g, state], played[g, state] = gain[source], source, k
        prior = new
    out, state = [], int(np.argmax(prior))
    for g in range(len(groups) - 1, -1, -1):
        if played[g, state] >= 0:
            out.append((g, int(played[g, state])))
        state = int(back[g, state]) if back[g, state] >= 0 else free
    both = []
    for g, k in reversed(out):
        both.append((g, k))
        _, _, midi, confidence = groups[g][k]
        rivals = [(-c, j) for j, (_, _, m, c) in enumerate(groups[g]) if j != k and abs(m - midi) <= WIDE_FROM and c >= max(high, 0.9 * confidence)]
        if companions and rivals:
            both.append((g, min(rivals)[1]))
    return both


def fret_path(start: np.ndarray, end: np.ndarray, choices: list[np.ndarray]) -> list[tuple[int, int]]:
    """A (string, fret) for each note, from its positions, with the least movement; notes without positions are left out
    by the caller. After a long gap, moving costs less."""
    if not choices:
        return []
    cost, back = FIRST_FRET * choices[0][:, 1], []
    for i in range(1, len(choices)):
        a, b = choices[i - 1][:, None, :], choices[i][None, :, :]
        move = FRET * np.abs(a[..., 1] - b[..., 1]) + STRING * np.abs(a[..., 0] - b[..., 0]) + HIGH_FRET * np.maximum(0, b[..., 1] - HIGH_FROM) - OPEN * (b[..., 1] == 0)
        total = cost[:, None] + move * (LONG_GAP_WEIGHT if start[i] - end[i - 1] > LONG_GAP else 1.0)
        back.append(np.argmin(total, axis=0))
        cost = total.min(axis=0)
    at = [int(np.argmin(cost))]
    for source in reversed(back):
        at.append(int(source[at[-1]]))
    return [tuple(c[k].tolist()) for c, k in zip(choices, reversed(at), strict=True)]


@dataclass(frozen=True)
class Hand:
    """What a hand can reach and what it avoids; fixed values of the shapes."""

    voices: int = 6
    stretch: int = 4
    preferred: tuple = (0, 15)
    frets: int = 20
    large_shift: float = 1.8
    open_bonus: float = 0.35
    string_cost: float = 0.35
    shapes: int = 48


def shapes_of(options: list[list[tuple[int, int]]], hand: Hand) -> list[tuple[float, float, float, tuple]]:
    """``(cost, centre of the frets, of the strings, positions)`` of the playable shapes of notes from low to high, each on
    a higher string than the one before; the cheapest first, the earlier among equals."""
    out = []
    for shape in product(*options):
        if any(b[0] >= a[0] for a, b in zip(shape, shape[1:], strict=False)):
            continue
        pressed = [f for _, f in shape if f > 0]
        spread = max(pressed) - min(pressed) if pressed else 0
        if spread > hand.stretch:
            continue
        centre = sum(pressed) / len(pressed) if pressed else 0.0
        outside = sum(max(0, hand.preferred[0] - f) + max(0, f - hand.preferred[1]) for f in pressed)
        known = 3.5 if tuple(sorted(shape)) in VOICINGS else 0.0
        cost = 1.5 * spread + 2 * outside + 0.15 * max(0.0, centre - 12) - hand.open_bonus * (len(shape) - len(pressed)) - known
        out.append((cost, centre, sum(s for s, _ in shape) / len(shape), shape))
    return sorted(out, key=lambda x: x[0])[: hand.shapes]


def chord_shapes(groups: list[list[tuple[float, float, int, float, int]]], positions, hand: Hand | None = None) -> list[tuple[int, int, int]]:
    """``(id, string, fret)`` of the notes ``(start, end, midi, confidence, id)`` of onset groups, each group one shape of
    the hand; the least sure notes go until a group is playable. ``positions(midi)`` lists where a note can be played."""
    hand = hand or Hand()
    planned, known = [], {}

    def playable(notes: list) -> list:
        levels = tuple(x[2] for x in notes)
        if levels not in known:
            known[levels] = shapes_of([positions(m) for m in levels], hand)
        return known[levels]

    for group in groups:
        notes = sorted(sorted((x for x in group if positions(x[2])), key=lambda x: -x[3])[: hand.voices], key=lambda x: x[2])
        shapes = playable(notes) if notes else []
        while not shapes and len(notes) > 1:
            notes.remove(min(notes, key=lambda x: x[3]))
            shapes = playable(notes)
        if shapes:
            planned.append((notes, shapes))
    if not planned:
        return []
    local, centre, strings = zip(*[(np.array([s[k] for s in shapes]) for k in range(3)) for _, shapes in planned], strict=True)
    cost, back = local[0], []
    for i in range(1, len(planned)):
        shift = np.abs(centre[i][None, :] - centre[i - 1][:, None])
        move = 0.75 * shift + hand.large_shift * np.maximum(0, shift - 4) + hand.string_cost * np.abs(strings[i][None, :] - strings[i - 1][:, None])
        gap = planned[i][0][0][0] - planned[i - 1][0][0][1]
        total = cost[:, None] + local[i][None, :] + move * (0.45 if gap > LONG_GAP else 1.0)
        back.append(np.argmin(total, axis=0))
        cost = total.min(axis=0)
    at = [int(np.argmin(cost))]
    for source in reversed(back):
        at.append(int(source[at[-1]]))
    return [(note[4], *spot) for (notes, shapes), k in zip(planned, reversed(at), strict=True) for note, spot in zip(notes, shapes[k][3], strict=True)]
