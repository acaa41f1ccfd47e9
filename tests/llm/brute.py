"""Plain Python counterparts of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

WORDS6 = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WORDS10 = re.compile("[^\x20\x09-\x0d]+")
SECRETS = [
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact(rows, pick=max):
    groups = defaultdict(list)
    for i, text in rows:
        groups[low(text)].append(i)
    out = []
    for i, text in rows:
        ids = groups[low(text)]
        keep = pick((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, sha(low(text))))
    return out


def contamination(rows, items, window=13):
    windows = defaultdict(set)
    for i, text in items:
        words = WORDS6.findall(low(text))
        size = min(window, len(words))
        for k in range(len(words) - size + 1) if size else ():
            windows[tuple(words[k : k + size])].add(str(i) if i is not None else "null")
    sizes = {len(w) for w in windows}
    out = []
    for i, text in rows:
        words = WORDS6.findall(low(text))
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if names := windows.get(tuple(words[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= names
        bad = len(hit) > 0 and 20 * len(hit) >= len(words)
        out.append((i, len(words), len(hit), len(found), sha(",".join(sorted(found))), bad))
    return out


def secrets(text):
    found = []
    for order, (kind, pattern, group, least) in enumerate(SECRETS):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[group]) >= least:
                found.append((m.start(), order, kind, m.end()))
    return sorted(found)


def shingles(text):
    words = WORDS10.findall(low(text))
    if len(words) >= 5:
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def components(rows):
    """Component of each id by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                shared[j] += j < i
        for j, n in shared.items():
            if n and 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def units(text):
    """``(start, end, words)`` of every sentence and line that has words."""
    cuts = sorted({0, len(text), *(m.end() for m in re.finditer(r"\n|[.!?](?=[ \t])", text))})
    found = [(a, b, tuple(WORDS6.findall(low(text[a:b])))) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [u for u in found if u[2]]


def passages(rows, least_words=20):
    """``(doc_id, start, end, n_units, n_words, first_doc_ids, first_unit)`` for unique ids.

    All stretches of units with enough words are looked up, and only least ones are reported: those
    that have too few words without their first or without their last unit.
    """
    texts = {i: units(t or "") for i, t in rows}
    first, out = {}, []
    for i in sorted(texts):
        found = texts[i]
        sources = defaultdict(list)
        for a in range(len(found)):
            for b in range(a, len(found)):
                sizes = [len(u[2]) for u in found[a : b + 1]]
                if sum(sizes) < least_words:
                    continue
                if min(sum(sizes[1:]), sum(sizes[:-1])) >= least_words:
                    break
                doc, unit = first.setdefault(tuple(u[2] for u in found[a : b + 1]), (i, a))
                if (doc, unit) != (i, a):
                    sources[doc, unit - a].append((a, b))
        for (doc, shift), spans in sources.items():
            joined = []
            for a, b in sorted(spans):
                if joined and a <= joined[-1][1] + 1:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            for a, b in joined:
                n = sum(len(u[2]) for u in found[a : b + 1])
                out.append((i, found[a][0], found[b][1], b - a + 1, n, [doc], a + shift))
    return out
