"""Plain single-process versions of the operators' contracts."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def op1(rows):
    fps = []
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = words(w)
        grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0))
    parent = {f: f for _, f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fs = sorted(parent)
    for k, a in enumerate(fs):
        for b in fs[:k]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for i, f in fps:
        if i is not None:
            r = find(f)
            least[r] = min(least.get(r, i), i)
    return [(i, f"{f:016x}", least.get(find(f))) for i, f in fps]


def op3(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, sha(t or "")))
    return out


def op4(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, ts in conv.items():
        ts.sort()
        loss = "".join(t for _, _, r, t in ts if r == "assistant")
        out.append((c, len(ts), sha("".join(f"{r}\n{t}\n" for _, _, r, t in ts)), len(loss), sha(loss)))
    return out


def op7(rows):
    out = []
    for i, t in rows:
        t = t or ""
        w = words(t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if words(x)]
        bad = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), bad))
    return out


ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def op9(rows):
    out = []
    for i, t in rows:
        t = t or ""
        spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        n = Counter(s[2] for s in spans)
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        out.append((i, n["assign"], n["access"], n["hex"], sha(text)))
    return out
