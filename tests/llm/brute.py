"""Plain Python versions of the contracts, for small inputs."""

import hashlib
import re
from collections import defaultdict


def lower_az(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def near_duplicates(rows):
    """rows: (doc_id, text). (doc_id, n_shingles, component_id, kept), sorted."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower_az(t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(set)
    for i, s in enumerate(sets):
        if rows[i][0] is not None:
            for x in s:
                by[x].add(i)
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        for j in {j for x in s for j in by[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * len(s | sets[j]):
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
    out = [(d, len(s), None if d is None else find(d), d is None or find(d) == d) for (d, _), s in zip(rows, sets)]
    return sorted(out, key=str)


def repeated_bytes(rows, width=100):
    """rows: (doc_id, text), distinct doc_ids. (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for i in range(len(b) - width + 1):
            w = b[i:i + width]
            if w in seen:
                hit[i:i + width] = b"\1" * width
            else:
                seen.add(w)
        spans = len(re.findall(rb"\x01+", bytes(hit)))
        out.append((d, len(b), sum(hit), spans, hashlib.sha256(bytes(x for x, h in zip(b, hit) if not h)).hexdigest()))
    return out


def contamination(docs, items, width=10):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    owner = defaultdict(set)
    for i, t in items:
        w = re.findall(word, lower_az(t or ""))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            owner[tuple(w[k:k + width])].add(str(i))
    sizes = sorted({len(k) for k in owner})
    out = []
    for d, t in docs:
        w = re.findall(word, lower_az(t or ""))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k:k + n])) in owner:
                    hit[k:k + n] = [True] * n
                    found |= owner[x]
        out.append((d, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return out


def luhn(digits):
    t = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        t += v - 9 * (v > 9)
    return t % 10 == 0


def personal(text):
    """Base spans (kind, start, end) in the order of the contract."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
