"""Plain restatements of what the operators compute, for small tables."""

from collections import Counter, defaultdict


def words(text):
    return (text or "").encode().split()


def shingles(text, n=5):
    w = words(text)
    if not w:
        return Counter()
    if len(w) < n:
        return Counter([tuple(w)])
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def near_classes(rows, threshold=0.8):
    """{id: least id of its class} by comparing every pair that shares a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for i, s in sets.items():
        for shingle in s:
            held[shingle].append(i)
    for a, b in {(a, b) for ids in held.values() for k, a in enumerate(ids) for b in ids[k + 1:]}:
        if jaccard(sets[a], sets[b]) >= threshold:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def without_repeats(rows, n=13):
    """[(words, removed, kept text)] of (key, text) rows, in their order; a null key is the least."""
    low = lambda key: -(1 << 63) if key is None else key
    first = {}
    for key, text in rows:
        w = words(text)
        for i in range(len(w) - n + 1):
            window = tuple(w[i:i + n])
            first[window] = min(first.get(window, low(key)), low(key))
    out = []
    for key, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i:i + n])] < low(key):
                gone[i:i + n] = [True] * n
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def base_measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if x.encode().strip()]
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return (len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


def raked(cells, targets, rounds=500):
    """Weights of {(margin values): tokens} raked to [{value: share}] in plain loops."""
    weights = {c: float(t) for c, t in cells.items()}
    for _ in range(rounds):
        for m, target in enumerate(targets):
            sums = Counter()
            for c, w in weights.items():
                sums[c[m]] += w
            weights = {c: w * target.get(c[m], 0.0) / sums[c[m]] if sums[c[m]] else 0.0 for c, w in weights.items()}
    return weights


def capped(cells, targets, share, rounds=60):
    """Tokens taken of {(margin values): tokens}, ``share`` of all: raked to amounts, no cell beyond its tokens.

    A value's amount goes by its target among those that can still give; a value's factor is found by bisection.
    """
    budget = share * sum(cells.values())
    wanted = []
    for m, target in enumerate(targets):
        supply = Counter()
        for c, t in cells.items():
            supply[c[m]] += t
        low, high = 0.0, max(supply[v] / s for v, s in target.items() if s)
        for _ in range(200):
            level = (low + high) / 2
            given = sum(min(supply[v], level * s) for v, s in target.items())
            low, high = (level, high) if given < budget else (low, level)
        wanted.append({v: min(supply[v], high * s) for v, s in target.items()})
    weight = {c: share * t for c, t in cells.items()}
    for _ in range(rounds):
        for m, amounts in enumerate(wanted):
            groups = defaultdict(list)
            for c in cells:
                groups[c[m]].append(c)
            for value, own in groups.items():
                low, high = 0.0, 1e6
                for _ in range(60):
                    factor = (low + high) / 2
                    given = sum(min(weight[c] * factor, cells[c]) for c in own)
                    low, high = (factor, high) if given < amounts.get(value, 0.0) else (low, factor)
                for c in own:
                    weight[c] = min(weight[c] * high, cells[c] * 1e12)
    return {c: min(weight[c], cells[c]) for c in cells}
