"""Plain versions of the operators: everything against everything."""

import hashlib
import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(docs, n, percent):
    """{doc_id: smallest doc_id reachable} for distinct ids."""
    sets = {i: shingles(t, n) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def repeats(docs, length):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}."""
    bodies = {i: (t or "").encode() for i, t in docs}
    seen = Counter(b[s : s + length] for b in bodies.values() for s in range(len(b) - length + 1))
    out = {}
    for i, b in bodies.items():
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def lines_left(docs, min_lines, min_words):
    """{doc_id: text less later copies of repeated runs} for distinct ids, None last."""
    runs = {}
    split = {i: t.split("\n") for i, t in docs if t is not None}
    order = sorted(split, key=lambda i: (i is None, i or 0))
    found = []
    for i in order:
        for at, line in enumerate(split[i]):
            if len(WORD.findall(line)) >= min_words:
                found.append((i, at, 1, (line,)))
            run = tuple(split[i][at : at + min_lines])
            if len(run) == min_lines and any(x.strip(" ") for x in run):
                found.append((i, at, min_lines, run))
    gone = {i: set() for i in split}
    for i, at, span, run in found:
        if runs.setdefault((span, run), (i, at)) != (i, at):
            gone[i] |= set(range(at, at + span))
    return {i: "\n".join(x for k, x in enumerate(split[i]) if k not in gone[i]) if i in split else None for i, _ in docs}


def align(item, text):
    """Best local alignment score: match 2, anything else -1."""
    best, row = 0, [0] * (len(text) + 1)
    for w in item:
        new = [0]
        for j, v in enumerate(text):
            new.append(max(0, row[j] + (2 if v == w else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best


def letters(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def private(text):
    """Base spans of personal data."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            n = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda n=n: 16 <= len(n) <= 19 and luhn(n), "phone": lambda n=n: 8 <= len(n) <= 15}[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def mix(docs, weights=(3, 1, 2), budget=1.5, most=2, seed="mix"):
    """{doc_id: (size, target, taken)} of (doc_id, source, text) rows with distinct ids."""
    size = {i: len(WORD.findall(t or "")) for i, _, t in docs}
    sources = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, x, _ in docs if x == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    left, open_, target = sum(total.values()) * budget, set(sources), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= most * total[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            target[s] = float(most * total[s])
            left -= target[s]
        open_ -= full
    queue = []
    for k, s in enumerate(sources):
        upto = 0
        own = sorted((hashlib.md5(f"{seed}{'' if i is None else i}".encode()).hexdigest(), i is None, i or 0, i) for i, x, _ in docs if x == s)
        for _, _, _, i in own:
            upto += size[i]
            queue += [((e * total[s] + upto) / target[s] if target[s] else 0.0, k, e, upto, i) for e in range(most)]
    taken, mixed = Counter(), 0
    for _, _, _, _, i in sorted(queue, key=lambda q: q[:4]):
        mixed += size[i]
        if mixed <= sum(total.values()) * budget:
            taken[i] += size[i]
    return {i: (size[i], target[s], taken[i]) for i, s, _ in docs}
