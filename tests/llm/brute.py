"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def base_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    t = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


def wide_spans(text: str) -> list[tuple[int, str, int]]:
    """All spans of the secret scan by one search a kind and a comparison of every two parts."""
    import regex

    from quaylight.llm.secrets import SCOPE, WIDE

    parts = []
    for k, (kind, (role, strong, pattern, least, group)) in enumerate(WIDE.items()):
        for m in regex.finditer(pattern, text, regex.ASCII):
            own = len(m[group]) >= least
            if kind == "weak_secret":
                base = ASSIGN.search(m[0])
                own = own and (len(m[group]) < 12 or not base)
            if own:
                parts.append((m.start(), k, kind, m.end(), role, strong))

    def near(p, role) -> bool:
        return any(q[4] == role and (p[0] - q[3] <= SCOPE if q[0] <= p[0] else q[0] - p[3] <= SCOPE) for q in parts)

    def told(p) -> bool:
        s, i, e = (near(p, r) for r in ("secret", "identifier", "endpoint"))
        return p[5] or {"secret": i or e, "identifier": s, "endpoint": s and i}[p[4]]

    return [(p[0], p[2], p[3]) for p in sorted(parts) if told(p)]


def removed(texts: list[str | None], span: int = 200) -> list[tuple[int, int, int, str]]:
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + span] for b in raw for i in range(len(b) - span + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = [True] * span
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def components(docs: list[tuple[int | None, str | None]], words: int, percent: int) -> list[tuple[int, int]]:
    sets = []
    for _, t in docs:
        w = tokens(t)
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    own = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b) and own[i] != own[j]:
                x, y = own[i], own[j]
                own = [y if o == x else o for o in own]
    least = {o: min((d for (d, _), p in zip(docs, own, strict=True) if p == o and d is not None), default=None) for o in own}
    return [(len(s), least[o]) for s, o in zip(sets, own, strict=True)]


def katz(docs: list[tuple[int, str | None]]) -> dict[int, tuple]:
    texts = {i: [*tokens(t), None] for i, t in docs}
    fold = {i: zlib.crc32(str(i).encode()) % 7 for i in texts}
    train = [i for i in texts if fold[i] != 2]
    one = Counter(w for i in train for w in texts[i])
    two = Counter(p for i in train for p in zip(["<s>", *texts[i]], texts[i]))
    n, v = sum(one.values()), len(one)
    of = Counter(two.values())
    d = [1.0] * 6
    if of[1] and 6 * of[6] / of[1] < 1:
        tail = 6 * of[6] / of[1]
        for r in range(1, 6):
            if of[r]:
                x = ((r + 1) * of[r + 1] / (r * of[r]) - tail) / (1 - tail)
                d[r] = x if 0 < x < 1 else 1.0
    count, kept, low = Counter(), Counter(), Counter()
    for (h, w), c in two.items():
        count[h] += c
        kept[h] += c * (d[c] if c <= 5 else 1)
        low[h] += one[w] + 1
    whole = n + v + 1

    def p(h, w) -> float:
        below = count[h] if kept[h] < count[h] * (1 - 1e-12) else count[h] + 1
        c = two.get((h, w), 0)
        if c:
            return c * (d[c] if c <= 5 else 1) / below
        alpha = (1 - kept[h] / below) / (1 - low[h] / whole) if count[h] else 1
        return alpha * (one.get(w, 0) + 1) / whole

    for h in list(count)[:20]:  # each context sums to one over the known words and one unknown
        assert abs(sum(p(h, w) for w in [*one, b"\0"]) - 1) < 1e-9
    return {i: (fold[i] == 2, len(t), sum(w in one for w in t), n, sum(math.log10((one.get(w, 0) + 1) / whole) for w in t), sum(math.log10(p(h, w)) for h, w in zip(["<s>", *t], t))) for i, t in texts.items()}


def decodings(steps: list, model: list) -> list[tuple[float, str]]:
    """Every path of a lattice with its cost, best first."""
    paths = [(0.0, "", 0, 0)]
    for arcs in steps:
        paths = [
            (c + cost - (model[a][b][ord(x) - 96] if x else 0), w + x, b if x else a, ord(x) - 96 if x else b)
            for c, w, a, b in paths
            for x, cost in arcs
        ]
    return sorted((c - model[a][b][0], w) for c, w, a, b in paths if w)


def viterbi(steps: list, model: list) -> tuple[float, str]:
    """The best path of a lattice over all pairs of letters."""
    best = {(0, 0): (0.0, "")}
    for arcs in steps:
        nxt: dict = {}
        for (a, b), (c, w) in best.items():
            for x, cost in arcs:
                key, made = ((b, ord(x) - 96), c + cost - model[a][b][ord(x) - 96]) if x else ((a, b), c + cost)
                if key not in nxt or (made, w + x) < nxt[key]:
                    nxt[key] = (made, w + x)
        best = nxt
    return min((c - model[a][b][0], w) for (a, b), (c, w) in best.items() if w)


def retrieved(texts: list[str], items: list[tuple[int, str]], share: float) -> list[dict[int, float]]:
    """For each text the places of all items that BM25 scores at `share` of their floor or more in a passage, with the best score; no index, blocks or bounds."""
    from quaylight.llm.decontaminate import B, K1, PASSAGE, parts, specific, words

    df = Counter(w for _, t in items for w in set(words(t)))
    mean = sum(len(words(t)) for _, t in items) / max(1, len(items))
    weights = []
    for _, item in items:
        own, run = words(item), PASSAGE // 2
        norm = K1 * (1 - B + B * len(own) / mean)
        weight = {t: math.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in Counter(own).items()}
        floor = share * min(sum(weight[t] for t in set(p[i : i + run])) for p in (own, *specific(*parts(item))) for i in range(max(1, len(p) - run + 1)))
        weights.append({t: x / floor for t, x in weight.items()})
    out = []
    for text in texts:
        w = words(text)
        passages = [set(w[s : s + PASSAGE]) for s in range(0, max(1, len(w) - PASSAGE // 2), PASSAGE // 2)]
        best = [max(sum(own.get(t, 0.0) for t in p) for p in passages) for own in weights]
        out.append({n: x for n, x in enumerate(best) if x >= 1})
    return out


def decontamination(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], share: float, least: float) -> list[tuple]:
    """BM25 of every passage against every item, then the overlaps."""
    from quaylight.llm.decontaminate import SHINGLE, parts, specific, words

    kept = [(i, t) for i, t in items if t and words(t)]
    runs_of = lambda w, n: [w[i : i + n] for i in range(max(1, len(w) - n + 1))]
    out = []
    for (d, text), found in zip(docs, retrieved([t or "" for _, t in docs], kept, share), strict=True):
        w = words(text or "")
        for n, score in found.items():
            (i, item), (question, answer) = kept[n], parts(kept[n][1])
            overlap = lambda p: sum(r in runs_of(w, min(SHINGLE, len(p))) for r in runs_of(p, min(SHINGLE, len(p)))) / len(runs_of(p, min(SHINGLE, len(p)))) if p else None  # noqa: B023, E731
            if max(overlap(p) for p in (words(item), *specific(question, answer))) >= least:
                out.append((d, i, round(score, 4), overlap(question), overlap(answer)))
    return sorted(out)


def trie(turns: list[tuple]) -> list[tuple]:
    """Every node of the trie of rebuilt conversations, from whole sequences; no hashes, bands or blocks."""
    own: dict = {}
    for c, turn, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(rows)] for c, rows in own.items()}
    made = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple([*own.get(c - int(math.fmod(c, 100)), [])[:h], *rows[h:]])
    members: dict = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for node, inside in members.items():
        under = [k for k in members if k[: len(node)] == node]
        children = [k for k in under if len(k) == len(node) + 1]
        leaves = sum(not any(len(j) == len(k) + 1 and j[:-1] == k for j in under) for k in under)
        saved = sum((len(members[k]) - 1) * len(k[-1][1]) for k in under if k)
        done = sorted(c for c in inside if made[c] == node)
        out.append((min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), len(children), leaves, saved, sha(",".join(map(str, done)).encode())))
    return sorted(out, key=repr)
