"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1 if w else 0))}


def near_classes(docs, width, percent=80):
    """{doc_id: (set sizes, component)} over (doc_id, text) rows."""
    sets = [(i, shingle_set(t, width)) for i, t in docs]
    parent = {i: i for i, _ in docs if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if None not in (i, j) and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in parent}


def cut_repeats(docs, length=100):
    """{doc_id: (kept pieces, removed)} for distinct doc_ids."""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda r: (r[0] is None, r[0])):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        pieces, last = [], True
        for c, g in zip(raw, gone):
            if not g:
                if last:
                    pieces.append(bytearray())
                pieces[-1].append(c)
            last = bool(g)
        out[i] = ([bytes(x) for x in pieces], sum(gone), sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1])))
    return out


def quality_counts(text):
    text = text or ""
    w = WORD.findall(text)
    n = len(w)
    often = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    mark = [False] * n
    for i in range(n - 2):
        if often[tuple(w[i : i + 3])] > 1:
            mark[i : i + 3] = [True] * 3
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    r = sum(mark)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, r, n < 50 or 100 * r > 50 * n


def base_scores(docs, held_out):
    """{doc_id: (n_tokens, n_known, train tokens, log10 score)}; the end of a text is one more token."""
    tokens = {i: [*words(t), "\n"] for i, t in docs}
    c = Counter(w for i, x in tokens.items() if not held_out(i) for w in x)
    n, v = sum(c.values()), len(c)
    return {i: (len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)) for i, x in tokens.items()}


def local_alignment(a, b, match=2, mismatch=-1, gap=-1):
    best = 0
    above = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, above[j - 1] + (match if x == y else mismatch), above[j] + gap, row[j - 1] + gap))
        best = max(best, *row)
        above = row
    return best


def cut_passages(docs, width):
    """{doc_id: (kept words, removed, spans)} for distinct doc_ids."""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda r: (r[0] is None, r[0])):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            x = tuple(w[p : p + width])
            if x in seen:
                gone[p : p + width] = [True] * width
            seen.add(x)
        starts = [k for k in range(len(w)) if gone[k] and (k == 0 or not gone[k - 1])]
        ends = [k + 1 for k in range(len(w)) if gone[k] and (k + 1 == len(w) or not gone[k + 1])]
        out[i] = (" ".join(x for x, g in zip(w, gone) if not g), sum(gone), list(zip(starts, ends)))
    return out


def hard_negatives(rows, every=10, scale=256, positives=5, negatives=10, low=30, high=90):
    """Sorted result rows over (vec_id, label, vector) with distinct ids and clean vectors."""
    rows = [(i, lab, [math.floor(scale * float(x)) for x in v]) for i, lab, v in rows]
    out = []
    for a, lab, v in rows:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, m) for i, m, w in rows if i != a)
        for p, i, _ in [x for x in scored if x[2] == lab][:positives]:
            found = [(-n, j) for n, j, m in scored if m != lab and low * -p <= 100 * -n <= high * -p][:negatives]
            out += [(a, i, k, j, -p, n) for k, (n, j) in enumerate(found, 1)]
    return sorted(out)


def aligned(a, b, byte_b, text):
    """(groups, linked id pairs) of a text, by comparing all tokens."""
    if not text:
        return [], []
    whole = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False), b.encode(text)
    back = {}
    for x in range(256):
        printable = 0x21 <= x < 0x7F or 0xA1 <= x < 0xAD or 0xAE <= x
        back[chr(x) if printable else chr(256 + len([c for c in back.values() if not (0x21 <= c < 0x7F or 0xA1 <= c < 0xAD or 0xAE <= c)]))] = x
    spelled = [[bytes(back[c] for c in t) for t in ids_a.tokens], [byte_b(i) for i in ids_b]]
    if any(b"".join(s) != whole for s in spelled):
        return [], []
    spans = []
    for ids, s in zip((ids_a.ids, ids_b), spelled):
        ends = [sum(map(len, s[: k + 1])) for k in range(len(s))] if len(s) < 4000 else None
        if ends is None:
            ends, n = [], 0
            for x in s:
                n += len(x)
                ends.append(n)
        spans.append([(i, e - len(x), e) for i, x, e in zip(ids, s, ends)])
    cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
    groups = [tuple([i for i, s, e in side if lo <= s and e <= hi] for side in spans) for lo, hi in zip([0, *cuts], cuts)]
    links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if max(s, t) < min(e, f)]
    return groups, links


def network_score(w, bounds, text):
    """Natural log probability of a text under the recurrent network, one word at a time."""
    h = len(w["turn"])
    outer = len(w["class_bias"]) - (len(bounds) - 1)
    kind = [k for k in range(len(bounds) - 1) for _ in range(bounds[k], bounds[k + 1])] + [len(bounds) - 1 + k for k in range(outer)]
    state, score = [0.0] * h, 0.0

    def share(logits, k):
        return logits[k] - math.log(sum(math.exp(x) for x in logits))

    for y in text:
        score += share([sum(state[i] * float(w["to_class"][i][k]) for i in range(h)) + float(w["class_bias"][k]) for k in range(len(w["class_bias"]))], kind[y])
        if y < bounds[-1]:
            lo, hi = bounds[kind[y]], bounds[kind[y] + 1]
            score += share([sum(state[i] * float(w["to_word"][j][i]) for i in range(h)) + float(w["word_bias"][j]) for j in range(lo, hi)], y - lo)
        back = [sum(state[i] * float(w["turn"][i][j]) for i in range(h)) for j in range(3 * h)]
        enter = [float(x) for x in w["enter"][y]]
        z = [1 / (1 + math.exp(-(enter[i] + back[i]))) for i in range(h)]
        r = [1 / (1 + math.exp(-(enter[h + i] + back[h + i]))) for i in range(h)]
        c = [math.tanh(enter[2 * h + i] + r[i] * back[2 * h + i]) for i in range(h)]
        state = [c[i] + z[i] * (state[i] - c[i]) for i in range(h)]
    return score
