"""Plain versions of operators, for comparison."""


def shingles(t, k=5):
    w = t.split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes_of(rows):
    """Classes by all pairs: equal texts are linked, so are texts of Jaccard 0.8 or more."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    s = {i: shingles(t or "") for i, t in rows}
    for i, a in rows:
        for j, b in rows:
            if i < j and ((a or "") == (b or "") or (s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]))):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in rows}


def without_spread_lines(text, spread, rows, sites=5):
    """The text that line dedup leaves of one of ``rows`` (text, site): of those that are spread lines mostly, copies keep them."""
    texts = [t for t, _ in rows]

    def split(t):
        lines = [x.strip(" ") for x in (t or "").split("\n") if x.strip(" ")]
        return [x for x in lines if x in spread], [x for x in lines if x not in spread]

    def size(lines):
        return sum(len(x.split()) for x in lines)

    def mostly(t):
        menu, own = split(t)
        return size(menu) > size(own)

    def order(t):
        menu = split(t)[0]
        return set(zip(menu, menu[1:]))

    def runs(lines):
        return {tuple(w[i : i + 3]) for w in (x.split() for x in lines) for i in range(len(w) - 2)}

    def own_runs(t):
        return runs(split(t)[1])

    def all_runs(t):
        return runs(sum(split(t), []))

    def half(of, t, of_others=None):
        mine = of(t)
        there = set().union(*[(of_others or of)(o) for o in set(texts) if o and o != t and mostly(o)])
        return bool(mine) and 2 * len(mine & there) >= len(mine)

    if text is None or not split(text)[0]:
        return text
    menu, own = split(text)
    if mostly(text) and len({s for t, s in rows if t == text and s is not None}) >= sites:
        return text
    if mostly(text) and (texts.count(text) > 1 or half(order, text)) and (size(menu) >= 8 * size(own) or half(own_runs, text, all_runs)):
        return text
    return "\n".join(x for x in text.split("\n") if x.strip(" ") not in spread)


def fill(sizes, weights, total, most):
    """Targets by sharing what is over again and again."""
    target, open_, left = {}, set(sizes), total
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > most * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target
