"""Plain versions of the operators, for comparison on small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

SMALL = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def metrics(text):
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def base_failed(text):
    n, *_, repeat = metrics(text)
    return n < 50 or 100 * repeat > 50 * n


def host_verdicts(rows, odds=4.0, least=0.25, most=1000.0):
    """host to (rates by rule, rejected) for (host, text): failure rates under a beta prior fitted by moments."""
    tried = defaultdict(list)
    for host, text in rows:
        if host is not None:
            n, _, symbols, lines, repeat = metrics(text)
            tried[host].append((n < 50, 100 * repeat > 50 * n, symbols > n, 10 * lines > n))
    out = {h: ([], False) for h in tried}
    total = sum(map(len, tried.values()))
    for rule in range(4):
        failed = {h: sum(x[rule] for x in xs) for h, xs in tried.items()}
        mean = sum(failed.values()) / total
        spread = sum(len(tried[h]) * (failed[h] / len(tried[h]) - mean) ** 2 for h in tried)
        rho = (spread / (mean * (1 - mean)) - len(tried)) / (total - len(tried)) if 0 < mean < 1 and total > len(tried) else 0
        strength = max(1.0, min(most, 1 / rho - 1)) if rho > 0 else most
        for h in tried:
            rate = (failed[h] + mean * strength) / (len(tried[h]) + strength)
            bad = rate > least and mean not in (0, 1) and rate / (1 - rate) > odds * mean / (1 - mean)
            out[h] = ([*out[h][0], rate], out[h][1] or bad)
    return out


def fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(rows):
    """doc_id to (fingerprint, component) for (doc_id, text)."""
    prints = {d: fingerprint(t) for d, t in rows}
    ids = sorted(prints)
    roots = components(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    return {d: (prints[d], roots[d]) for d in ids}


def cosine_links(rows, least=0.98):
    """vec_id to (links, component) for (vec_id, vector, label)."""

    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = defaultdict(int)
    pairs = []
    for i, (a, va, la) in enumerate(rows):
        for b, vb, lb in rows[:i]:
            if la == lb and usable(va, la) and usable(vb, lb) and len(va) == len(vb):
                x, y = np.array(va, float), np.array(vb, float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    links[a] += 1
                    links[b] += 1
                    pairs.append((a, b))
    roots = components([r[0] for r in rows], pairs)
    return {r[0]: (links[r[0]], roots[r[0]]) for r in rows}


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """source to target, excess shared again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    fixed, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total >= cap * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in free}
        for s in over:
            fixed[s] = cap * sizes[s]
        left = share * sum(sizes.values()) - sum(fixed.values())


def mix(rows, seed=7):
    """Copies of each of (doc_id, source, text), in the order given."""
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(words(t))
    aims = targets(sizes)
    copies = {}
    for s in sizes:
        own = sorted((k for k in range(len(rows)) if rows[k][1] == s), key=lambda k: (len(words(rows[k][2])), rows[k][0] is not None, rows[k][0] or 0))
        expected = aims[s] / sizes[s] if sizes[s] else 0.0
        start = int(hashlib.md5(f"{seed}:{chr(0) + 'null' if s is None else s}".encode()).hexdigest()[:8], 16) / 2**32
        for r, k in enumerate(own):
            copies[k] = min(2, math.floor((r + 1) * expected + start) - math.floor(r * expected + start))
    return copies, sizes, aims


def densities(tree, page=None):
    """[(density, sum of the children's densities)] in page order of a tree of (name, parts): composite text density, by recursion."""

    def count(node):
        name, parts = node
        chars = tags = link_chars = link_tags = 0
        for x in parts:
            if isinstance(x, str):
                chars += len(x.replace(" ", ""))
            else:
                c, t, lc, lt = count(x)
                chars, tags, link_chars, link_tags = chars + c, tags + t + 1, link_chars + lc, link_tags + lt + (x[0] == "a")
        return chars, tags, chars if name == "a" else link_chars, link_tags

    page = page or count(tree)

    def density(node):
        c, t, lc, lt = count(node)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + page[2] / max(page[0], 1) * c + math.e)
        return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)) / math.log(max(base, 2))

    inner = [x for x in tree[1] if not isinstance(x, str)]
    out = [(density(tree), sum(map(density, inner)) or density(tree))]
    for x in inner:
        out += densities(x, page)
    return out
