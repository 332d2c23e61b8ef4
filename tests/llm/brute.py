"""Plain versions of the operators, for small tables."""

from collections import Counter

WORD_SPACES = b" \t\n\x0b\x0c\r"


def shingles(text, size=5):
    w = text.encode().lower().split() if text else []
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def components(rows, num=3, den=4):
    """{doc_id: (set size, smallest linked id)} of (doc_id, text) rows, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def without_spans(rows, p):
    """{doc_id: (words left, removed)} of (doc_id, text) rows: the shortest run from each edge on and the shortest back from
    each edge, removed where an earlier place has it.  A sentence begins at the start and after a word that ends in . ! or ?;
    capitals are edges, too, but begin no sentence.  Texts without blank lines and of scripts with spaces only."""
    first, found, out = {}, [], {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w, low = (t or "").split(), (t or "").lower().split()
        begins = lambda k: k == 0 or w[k - 1][-1] in ".!?"  # noqa: B023, E731
        edges = [k for k in range(len(w)) if begins(k) or w[k][0].isupper()] + [len(w)]

        def fits(a, b):
            n, sentences = edges[b] - edges[a], 1 + sum(begins(k) for k in range(edges[a] + 1, edges[b]))  # noqa: B023
            return (sentences >= p.min_sentences and n >= p.min_words) or n >= p.enough_words

        m = len(edges)
        pairs = {(a, next((b for b in range(a + 1, m) if fits(a, b)), None)) for a in range(m)}
        pairs |= {(next((a for a in range(b - 1, -1, -1) if fits(a, b)), None), b) for b in range(m)}
        for a, b in pairs:
            if a is not None and b is not None:
                run = tuple(low[edges[a] : edges[b]])
                first[run] = min(first.get(run, (i, edges[a])), (i, edges[a]))
                found.append((run, i, edges[a]))
        out[i] = w
    gone = {i: set() for i in out}
    for run, i, s in found:
        if first[run] != (i, s):
            gone[i] |= set(range(s, s + len(run)))
    return {i: ([x for k, x in enumerate(w) if k not in gone[i]], len(gone[i])) for i, w in out.items()}


def leaks(docs, items, size=5, similarity=0.75):
    """{(doc_id, item_id): similarity} over all windows of the item's length."""
    import regex

    words = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    bag = lambda w: Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = {}
    for i, t in docs:
        w = words(t)
        for j, u in items:
            v = words(u)
            if len(v) < size:
                continue
            want = bag(v)
            for s in range(max(1, len(w) - len(v) + 1)):
                have = bag(w[s : s + len(v)])
                x = sum((have & want).values()) / max(1, sum((have | want).values()))
                if x >= similarity and x > out.get((i, j), 0):
                    out[i, j] = x
    return out
