"""Plain versions of the operators over small tables, without Spark."""

import re


def jaccard_components(rows, size, percent=80):
    """rows: (doc_id, text) with distinct ids. doc_id -> (n_shingles, component)."""
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(size, len(words))
        sets[doc_id] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    for d, s in sets.items():
        common = {}
        for x in s:
            for e in holders[x]:
                if e < d:
                    common[e] = common.get(e, 0) + 1
        for e, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[e]) - k):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def base_secrets(text):
    """[(start, rank, end, kind)] of the fixed shapes."""
    text = text or ""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def dropped_lines(rows, min_words=9):
    """doc_id -> numbers of the lines with an earlier copy. rows: (doc_id, text), ids distinct."""
    lines = [(d, k, line.encode().split()) for d, text in sorted(rows) for k, line in enumerate((text or "").split("\n"))]

    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < min_words or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    out = {d: [] for d, _ in rows}
    for i, (d, k, words) in enumerate(lines):
        if words and any(near(words, other) for _, _, other in lines[:i]):
            out[d].append(k)
    return out


def contaminated(docs, items, size=13):
    """Ids of the documents with a twentieth or more of their words inside benchmark windows. docs, items: (id, text)."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for _, text in items:
        w = words(text)
        n = min(size, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = sorted({len(w) for w in windows})
    out = set()
    for doc_id, text in docs:
        w = words(text)
        hit = {k for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(i, i + n)}
        if hit and 20 * len(hit) >= len(w):
            out.add(doc_id)
    return out
