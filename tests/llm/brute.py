"""Plain single-process versions of the operators, written from their contracts alone."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    """doc_id -> (fingerprint, smallest doc_id reachable)."""
    fp = {d: fingerprint(t) for d, t in rows}
    distinct = sorted(set(fp.values()))
    up = {f: f for f in distinct}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                up[find(a)] = find(b)
    least = {}
    for d, f in fp.items():
        least[find(f)] = min(d, least.get(find(f), d))
    return {d: (f"{f:016x}", least[find(f)]) for d, f in fp.items()}


def substring(rows, k=13):
    """doc_id -> (n_words, n_removed, sha of what is kept)."""
    own = {d: words(t) for d, t in rows}
    first = {}
    for d, w in own.items():
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(d, first.get(key, d))
    out = {}
    for d, w in own.items():
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


def rule_counts(text):
    w = words(text)
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    inside = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def warc(rows):
    """Rows (page_id, html) -> page_id -> (bytes, digest, type, refers_to)."""
    groups = defaultdict(list)
    for p, html in rows:
        groups[(html or "").encode()].append(p)
    return {p: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if p == max(ids) else "revisit", None if p == max(ids) else max(ids)) for b, ids in groups.items() for p in ids}


def top_k(rows, k=5):
    long = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    good = [(i, [long(int(np.floor(256 * float(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, v in good:
        if q % 50 == 0:
            scores = sorted((-long(sum(a * b for a, b in zip(v, w))), i) for i, w in good if i != q and len(w) == len(v))[:k]
            for r, (s, i) in enumerate(scores, 1):
                out[q, r] = (i, -s)
    return out


def chat(rows):
    """Rows (conv_id, turn, role, text) -> conv_id -> (turns, sha, loss chars, loss sha)."""
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        both = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(both.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def ids(tokenizer, text, end):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def crc(a):
    return zlib.crc32(np.asarray(a, "<u4").tobytes())
