"""Plain single-process versions of the operators' contracts."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def similar(sets, num, den):
    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * min(len(x), len(y)) >= num * max(len(x), len(y)):
                both = len(x & y)
                if den * both >= num * (len(x) + len(y) - both):
                    yield a, b


def substring_dedup(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def base_counts(text):
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def kneser_ney(docs):
    """Mean negative log probability of each (text, lang), modified Kneser-Ney over character 4-grams; a 4-gram that only this text holds is unseen."""
    units = []
    for text, lang in docs:
        raw = (text or "").lower().replace("\0", " ").encode("utf-16-le")
        units.append((lang or "und", [0, 0, 0] + [int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)]))
    prob, fours = {}, {}
    for lang in {u[0] for u in units}:
        c4 = Counter(tuple(u[i - 3 : i + 1]) for name, u in units if name == lang for i in range(3, len(u)))
        counts = {4: c4}
        for n in (3, 2, 1):
            counts[n] = Counter(g[1:] for g in counts[n + 1])
        p = None
        for n in (1, 2, 3, 4):
            c = counts[n]
            m = [sum(v == k for v in c.values()) for k in range(5)]
            y = m[1] / (m[1] + 2 * m[2]) if m[1] + 2 * m[2] else 0.5
            d = [0.0] + [min(max(k - (k + 1) * y * m[k + 1] / m[k] if m[k] else k * 0.5, 0.05), k * 0.95) for k in (1, 2, 3)]
            total, kinds = Counter(), defaultdict(lambda: [0, 0, 0, 0])
            for g, v in c.items():
                total[g[:-1]] += v
                kinds[g[:-1]][min(v, 3)] += 1
            low = {g: sum(d[k] * kinds[g[:-1]][k] for k in (1, 2, 3)) / total[g[:-1]] * (p[g[1:]] if n > 1 else 1 / 65536) for g in c}
            p = {g: (v - d[min(v, 3)]) / total[g[:-1]] + low[g] for g, v in c.items()}
        prob[lang], fours[lang] = (p, low), c4
    out = []
    for lang, u in units:
        own = Counter(tuple(u[i - 3 : i + 1]) for i in range(3, len(u)))
        p, low = prob[lang]
        out.append(-sum(n * math.log(p[g] if n < fours[lang][g] else low[g]) for g, n in own.items()) / (len(u) - 3) if len(u) > 3 else None)
    return out


def line_components(docs, k=8, num=80, den=100):
    """Dropped (doc_id, line) of documents with distinct ids."""
    first, sets = {}, {}
    every = []
    for doc, text in sorted(docs):
        for i, line in enumerate((text or "").split("\n")):
            s = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(LOWER)
            if s:
                every.append((doc, i, s))
                first.setdefault(s, (doc, i))
                sets[s] = {s[j : j + k] for j in range(len(s) - k + 1)} or {s}
    of = components(sets, similar(sets, num, den))
    least = {}
    for s, at in first.items():
        least[of[s]] = min(least.get(of[s], at), at)
    return sorted((d, i) for d, i, s in every if least[of[s]] != (d, i))


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path, rules):
    fits = []
    for action, rule in rules:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), rule, action))
    return max(fits)[1:] if fits else (None, None)


def best_path(word, pieces, byte_ids, unknown):
    """Highest-weight segmentation; on a tie the longer last piece."""
    best = [(0.0, None, None)]
    for j in range(1, len(word) + 1):
        top = None
        for i in range(j):
            hit = pieces.get(word[i:j])
            if hit is None and j - i > 1:
                continue
            w = best[i][0] + (hit[1] if hit else unknown)
            if top is None or w > top[0]:
                top = (w, i, hit[0] if hit else None)
        best.append(top)
    out, j = [], len(word)
    while j:
        _, i, piece = best[j]
        out = ([piece] if piece is not None else [byte_ids[b] for b in word[i:j].encode()]) + out
        j = i
    return out
