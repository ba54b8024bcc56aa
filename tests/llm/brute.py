"""Plain Python versions of the contracts, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

import xxhash

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
ALNUM = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def low(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def fold(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % k


def targets(sizes):
    """sizes: {source: words}."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > 2 * sizes[s] + 1e-9}
        if not above:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(2 * sizes[s] for s in above)
        open_ -= above
    return out


def language_grams(text):
    """The 1- to 3-grams of the letters of a text, runs of anything else being one space."""
    import regex

    s = " " + " ".join(regex.findall(r"\p{L}+", text.lower())) + " "
    return Counter([c for c in s if c != " "] + [s[i : i + n] for n in (2, 3) for i in range(len(s) - n + 1)])


def _in_order(grams, k):
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], sum(ord(c) << 21 * i for i, c in enumerate(reversed(x[0])))))][:k]


def languages(docs, profile=400, document=300):
    """docs: [(id, text, lang, learned from)] -> {id: (language, score)} by out-of-place distance to rank-order profiles."""
    import regex

    counts = {}
    for _, t, lang, train in docs:
        if train and t is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(language_grams(t))
    ranks = {lang: {g: i for i, g in enumerate(_in_order(c, profile))} for lang, c in counts.items()}
    out, missing = {}, max([document, *map(len, ranks.values())])
    for d, t, *_ in docs:
        if not t or not regex.search(r"\p{L}", t):
            out[d] = "und", 0.0
            continue
        top = _in_order(language_grams(t), document)
        far = {lang: sum(abs(r[g] - i) if g in r else missing for i, g in enumerate(top)) for lang, r in ranks.items()}
        best = min(far, key=lambda k: (far[k], k))
        out[d] = best, 1 - far[best] / (missing * len(top))
    return out


def contamination(docs, items):
    """docs, items: [(id, text)] -> rows as op3's."""
    windows = {}
    for item, text in items:
        w = ALNUM.findall(low(text))
        m = min(13, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = ALNUM.findall(low(text))
        hit, own = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit.update(range(i, i + m))
                    own |= windows[tuple(w[i : i + m])]
        out.append((doc, len(w), len(hit), len(own), sha(",".join(sorted(own))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def lines(docs, ratio=0.1, least=3):
    """docs: [(id, text, source)] -> (id, n_lines, n_dropped, sha of kept)."""
    pages, seen = Counter(s for _, _, s in docs), Counter()
    for _, text, s in docs:
        seen.update({(s, x.strip(" ")) for x in (text or "").split("\n") if x.strip(" ")})
    bad = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for d, text, s in docs:
        if text is None:
            out.append((d, 0, 0, None))
            continue
        all_ = text.split("\n")
        kept = [x for x in all_ if (s, x.strip(" ")) not in bad]
        out.append((d, len(all_), len(all_) - len(kept), sha("\n".join(kept))))
    return out


def substrings(docs, n=50):
    """docs: [(id, text)] -> (id, n_words, n_removed, sha of kept)."""
    first, split = {}, [(d, WORD.findall(t or "")) for d, t in docs]
    key = lambda d: (d is None, d or 0)
    for d, w in split:
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, d), d, key=key)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - n + 1):
            if key(first[tuple(w[i : i + n])]) < key(d):
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def simhash(text):
    w = WORD.findall(low(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(docs):
    """docs: [(id, text)] -> (id, fingerprint, component)."""
    fps = [(d, simhash(t)) for d, t in docs]
    label = {f: min(d for d, g in fps if g == f) for _, f in fps}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return [(d, f"{f:016x}", label[f]) for d, f in fps]


def similar(docs, n=5, least=0.8):
    """docs: [(id, text)] -> {id: least id of its component of texts whose sets of n-word shingles have this Jaccard similarity}."""
    sets = {}
    for d, t in docs:
        w = WORD.findall(low(t))
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: root(d) for d in ids}


def luhn(d):
    s = [int(x) for x in reversed(d)]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    out = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m.group())]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)], Counter(k for _, _, k, _ in out)


def unigram(docs):
    """docs: [(id, text)] -> (id, held_out, n_tokens, n_known, N, base score)."""
    tokens = [(d, WORD.findall(low(t)) + [""]) for d, t in docs]
    c = Counter(w for d, ws in tokens if fold(d, 7) != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, fold(d, 7) == 2, len(ws), sum(c[w] > 0 for w in ws), n, sum(log10((c[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in tokens]
