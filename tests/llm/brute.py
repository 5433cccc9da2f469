"""Plain restatements of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import combinations

LOWER = {c: c + 32 for c in range(65, 91)}


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {n: find(n) for n in nodes}


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def near_duplicates(rows, size, percent=80):
    sets = {}
    by_set = defaultdict(list)
    for d, t in rows:
        sets[d] = shingles(t, size)
        if sets[d]:
            by_set[sets[d]].append(d)
    links = [(v[0], x) for v in by_set.values() for x in v[1:]]
    at = defaultdict(set)
    for s, v in by_set.items():
        for x in s:
            at[x].add(v[0])
    pairs = set()
    for v in at.values():
        pairs.update(combinations(sorted(v), 2))
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links.append((a, b))
    named = components([d for d, _ in rows], links)
    return {d: (len(sets[d]), named[d], named[d] == d) for d, _ in rows}


def line_dedup(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    split = {d: (t or "").split("\n") for d, t in rows}
    holders = defaultdict(set)
    for d, lines in split.items():
        for x in lines:
            if len(key(x)) >= min_chars:
                holders[key(x)].add(d)
    common = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = {}
    for d, lines in split.items():
        rest = [x for x in lines if common.get(key(x), d) == d]
        out[d] = (len(lines), len(lines) - len(rest), hashlib.sha256("\n".join(rest).encode()).hexdigest())
    return out


def contamination(rows, items, length=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        if w:
            n = min(length, len(w))
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(str(i))
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in rows:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))
    return out


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(re.sub("[^0-9]", "", s))):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(s):
    return len(re.sub("[^0-9]", "", s))


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= digits(m) <= 19 and luhn(m)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= digits(m) <= 15),
]


def pii(text):
    found = []
    for rank, (kind, pattern, ok) in enumerate(BASE):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if ok(m.group())]
    counts = tuple(sum(f[2] == b[0] for f in found) for b in BASE)
    spans = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))
    return (*counts, hashlib.sha256(spans.encode()).hexdigest()), spans


def language_posteriors(rows, model, suffixes, trust=0.9, suffix_trust=0.6, strength=20.0, unknown=0.05):
    """The fusion of (text, host, declared) rows, one by one: [(language, probability, text_language, any text)]."""
    import math

    langs = model.languages
    n = len(langs)

    def page(text):
        return re.sub("<[^>]*>", " ", text) if re.search(r"<html\b", text, re.I) else text

    def likelihood(text):
        data = [b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in page(text or "").encode()]
        data += [32] * (3 - len(data))
        code = lambda a, b, c: (a * 0x1E35A7BD + b * 0x85EBCA6B + c * 0xC2B2AE35) % (1 << 32) >> 16
        at = [code(*data[i : i + 3]) for i in range(len(data) - 2)] if text else []
        at = [x for x in at if x != code(32, 32, 32)]
        if not at:
            return [0.0] * (n + 1)
        mean = [sum(model.table[x][k] for x in at) / len(at) for k in range(n + 1)]
        return [m * min(len(at) / 2, 128.0) for m in mean]

    def normal(logs):
        top = max(logs)
        e = [math.exp(x - top) for x in logs]
        return [x / sum(e) for x in e]

    def says(tag, trust):
        if tag not in langs:
            return [0.0] * (n + 1)
        miss = math.log((1 - trust) / (n - 1)) if n > 1 else 0.0
        return [math.log(trust) if x == tag else miss for x in langs] + [miss]

    def levels(host):
        if host is None or "." not in host:
            return None, None
        return ".".join(host.split(".")[-2:]), host.split(".")[-1]

    logs = [likelihood(t) for t, _, _ in rows]
    posts = [normal(x)[:n] for x in logs]
    hosts = [None if h is None else h.lower() for _, h, _ in rows]
    add = lambda x, y: [a + b for a, b in zip(x, y, strict=True)]
    zero, every = [0.0] * n, [1.0] * n
    own, domain, suffix = defaultdict(lambda: zero), defaultdict(lambda: zero), defaultdict(lambda: zero)
    for x, p, h in zip(logs, posts, hosts, strict=True):
        if any(x):
            every, own[h] = add(every, p), add(own[h], p)
            domain[levels(h)[0]], suffix[levels(h)[1]] = add(domain[levels(h)[0]], p), add(suffix[levels(h)[1]], p)
    every = [x / sum(every) for x in every]
    smooth = lambda s, p: [(a + strength * b) / (sum(s) + strength) for a, b in zip(s, p, strict=True)]
    out = []
    for (text, _, declared), x, p, h in zip(rows, logs, posts, hosts, strict=True):
        d, s = levels(h)
        above = every if d is None else smooth(domain[d], smooth(suffix[s], every))
        mine = [max(a - (b if any(x) else 0.0), 0.0) for a, b in zip(own[h], p, strict=True)]
        prior = every if h is None else smooth(mine, above)
        tag = declared.split("-")[0].lower() if declared is not None else None
        if tag is None and (root := re.search(r"<html\b[^>]*", text or "", re.I)):
            m = re.search(r"\blang\s*=\s*[\"']?([a-z]{2,3})", root.group(), re.I)
            tag = m and m.group(1).lower()
        parts = [x, [math.log(q * (1 - unknown)) for q in prior] + [math.log(unknown)], says(tag, trust), says(suffixes.get(s), suffix_trust)]
        final = normal([sum(v) for v in zip(*parts, strict=True)])[:n]
        best = max(range(n), key=lambda k: (final[k], -k))
        k = max(range(n + 1), key=lambda k: (x[k], -k))
        out.append((langs[best], final[best], langs[k] if any(x) and k < n else None, any(x)))
    return out


def crc(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())
