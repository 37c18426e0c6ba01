"""Plain versions of the operators, for small tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from quillsearch.llm import kernels, packing, quality, simhash, toxicity


def split(texts):
    return kernels.buffers(kernels.as_large(pa.array(texts, pa.string())))


def roots(n, edges):
    parent = list(range(n))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(v) for v in range(n)]


M64 = (1 << 64) - 1


def mix(x):
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ x >> shift) * times & M64
    return x


def run_hash(run, fold):
    """The hash of a byte run, byte by byte."""
    total = 0
    for k, b in enumerate(run):
        factor = int(kernels._POWERS[k % 4096]) * (mix(k >> 12) | 1)
        total += ((b + 32 if fold and 65 <= b <= 90 else b) + 1) * factor
    return mix((total & M64) ^ len(run))


def bits_of(features):
    """The signs of weighted sums of bits, one at a time."""
    return sum(1 << b for b in range(64) if sum(w if h >> b & 1 else -w for h, w in features) > 0)


def fingerprint(text):
    """A text's word SimHash and both bigram SimHashes, in plain Python."""
    raw = (text or "").encode()
    found = re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)
    if not found:
        lone = mix((run_hash(raw, False) if raw else 0) + 0xABCDEF & M64)
        check = mix(lone)
        return lone & (1 << 46) - 1, check, mix(check)
    known = {}
    h = [known.setdefault(w, None) or known.update({w: run_hash(w, True)}) or known[w] for w in found]
    count = Counter(h)
    words = bits_of([(x, int(math.log2(c)) + 1) for x, c in count.items()])
    pairs = [mix(a * 0x9E3779B97F4A7C15 + b & M64) for a, b in zip([1, *h], h)]
    return words & (1 << 46) - 1, bits_of([(p, 1) for p in pairs]), bits_of([(mix(p ^ 0x5BD1E995), 1) for p in pairs])


def near_groups(rows):
    """rows (id, text): the least id of each group, comparing all pairs bit by bit."""
    fp, check, more = (x.tolist() for x in simhash.signatures(*split([t for _, t in rows])))

    def far(values, i, j):
        return (values[i] ^ values[j]).bit_count()

    edges = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if rows[i][1] is not None and rows[j][1] is not None and far(fp, i, j) <= 6 and far(check, i, j) <= simhash.CHECK_BITS and far(check, i, j) + far(more, i, j) <= simhash.BOTH_BITS
    ]
    member = defaultdict(list)
    for k, r in enumerate(roots(len(rows), edges)):
        member[r].append(rows[k][0])
    return {i: min(ids) for ids in member.values() for i in ids}


def hash_of(ids):
    return kernels.mix(np.array(ids, dtype=np.int64).view(np.uint64))


def keep_good(rows, labels, order):
    """order: labelled ids as the sample takes them."""
    texts = dict(rows)
    known = defaultdict(list)
    for i, q in labels:
        if i is not None and q is not None and texts.get(i) is not None:
            known[i].append(q)
    ids = sorted(i for i in order if i in known)
    if not ids:
        return rows
    model_x = quality.terms(*split([texts[i] for i in ids]))
    label = [sum(known[i]) / len(known[i]) for i in ids]
    idf = np.array([math.log((1 + len(ids)) / (1 + sum(1 for r in model_x if r[c] > 0))) + 1 for c in range(model_x.shape[1])], dtype=np.float32)
    w = quality.weigh(model_x, idf)
    basis = quality.decompose(w, quality.RANK)
    v = quality.project(w, basis)
    out = []
    for i, t in rows:
        x = quality.project(quality.weigh(quality.terms(*split([t])), idf), basis)[0]
        cosine = [(c, y) for c, _, y in sorted(((round(float(x @ u), 6), -k, y) for k, (u, y) in enumerate(zip(v, label))), reverse=True)[: quality.NEIGHBOURS]]
        weight = [max(c, 0) ** quality.POWER for c, _ in cosine]
        score = sum(a * y for a, (_, y) in zip(weight, cosine)) / sum(weight) if sum(weight) else sum(label) / len(label)
        if score >= quality.THRESHOLD:
            out.append((i, t))
    return out


def features(text):
    raw, at = split([text])
    return sorted(set(toxicity.slots(raw, at)[0].tolist()))


def keep_clean(rows, labels):
    """FTRL one coordinate at a time."""
    texts = dict(rows)
    known = {}
    for i, y in labels:
        if i is not None and y is not None and texts.get(i) is not None:
            known[i] = max(y, known.get(i, 0))
    if not known:
        return rows
    ids = np.array(sorted(known))
    ids = ids[np.argsort(hash_of(ids), kind="stable")].tolist()
    z, n, zb, nb = defaultdict(float), defaultdict(float), 0.0, 0.0
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((b + math.sqrt(n[k])) / a + l2)

    def score(x):
        return 1 / (1 + math.exp(-sum(map(weight, x)) + zb / ((b + math.sqrt(nb)) / a)))

    found = {i: features(texts[i]) for i in ids}
    for _ in range(toxicity.EPOCHS):
        for i in ids:
            g = score(found[i]) - known[i]
            bias = -zb / ((b + math.sqrt(nb)) / a)
            for k in found[i]:
                w = weight(k)
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / a * w
                n[k] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / a * bias
            nb += g * g
    return [(i, t) for i, t in rows if score(features(t)) < toxicity.THRESHOLD]


def length(text):
    return len([w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\f", " ").split(" ") if w])


def least_bounds(lengths, k):
    """Bounds of least padding, by the plain quadratic program; leftmost of equals."""
    sizes = sorted(set(lengths))
    m, k = len(sizes), min(k, len(sizes))
    count = [sum(1 for x in lengths if x == s) for s in sizes]

    def cost(i, j):
        return sum(c * (sizes[j - 1] - s) for s, c in zip(sizes[i:j], count[i:j]))

    best = [[math.inf] * (m + 1) for _ in range(k + 1)]
    best[0][0] = 0
    back = {}
    for layer in range(1, k + 1):
        for j in range(1, m + 1):
            for i in range(j):
                if (c := best[layer - 1][i] + cost(i, j)) < best[layer][j]:
                    best[layer][j], back[layer, j] = c, i
    out, j = [], m
    for layer in range(k, 0, -1):
        out.append(sizes[j - 1])
        j = back[layer, j]
    return out[::-1]


def packed(rows, buckets=packing.BUCKETS, budget=packing.TOKEN_BUDGET):
    sized = [(length(t), 0 if i is None else i % packing.SHARDS, i is None, i or 0, i) for i, t in rows]
    bounds = least_bounds([s[0] for s in sized], buckets)
    member = defaultdict(list)
    for s in sorted(sized):
        member[min(b for b in bounds if b >= s[0])].append(s)
    return sorted((s[4] if s[4] is not None else -1, s[0], b, k // max(1, budget // max(b, 1))) for b, inside in member.items() for k, s in enumerate(inside))
