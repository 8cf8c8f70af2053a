"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None, k: int = 5) -> set[tuple[str, ...]]:
    w = words(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard_components(rows: list[tuple[int, str | None]], percent: int = 80) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common: Counter = Counter()
    for ids in holders.values():
        ids.sort()
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common[a, b] += 1
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def kept_words(rows: list[tuple[int, str | None]], width: int = 35) -> dict[int, tuple[int, int, str]]:
    lists = {i: words(t) for i, t in rows}
    seen: Counter = Counter()
    for w in lists.values():
        seen.update(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    out = {}
    for i, w in lists.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def kept_bytes(rows: list[tuple[int, str | None]], window: int = 50) -> dict[int, tuple[int, int, int, bytes]]:
    texts = {i: (t or "").encode() for i, t in rows}
    least: dict[bytes, int] = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - window + 1):
            least.setdefault(texts[i][k : k + window], i)
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if least[t[k : k + window]] < i:
                gone[k : k + window] = b"\x01" * window
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g))
    return out


class Ppm:
    """Prediction by partial matching with dictionaries, one symbol at a time."""

    END, BLANK = 10, 32

    def __init__(self, texts: list[str | None], order: int, share: int):
        self.order, self.counts = order, defaultdict(Counter)
        total = 0
        for t in texts:
            stream = self.stream(t)
            for i in range(1, len(stream)):
                total += 1
                for context in self.contexts(stream, i):
                    self.counts[context][stream[i]] += 1
        self.counts = {c: t for c, t in self.counts.items() if sum(t.values()) * share >= total}

    def stream(self, text: str | None) -> list[int]:
        body = " ".join(words(lower(text or ""))).encode()
        return [self.END, *body, self.END]

    def contexts(self, stream: list[int], i: int):
        for k in range(min(self.order, i) + 1):
            yield tuple(stream[i - k : i])

    def log10(self, text: str | None) -> float:
        from math import log10

        stream, out = self.stream(text), 0.0
        for i in range(1, len(stream)):
            left = set(range(256))
            nodes = [c for c in self.contexts(stream, i) if c in self.counts]
            for context in reversed(nodes):
                seen = {s: n for s, n in self.counts[context].items() if s in left}
                n, d = sum(seen.values()), len(seen)
                if stream[i] in seen:
                    out += log10((2 * seen[stream[i]] - 1) / (2 * n))
                    break
                if d:
                    out += log10(d / (2 * n))
                left -= seen.keys()
            else:
                out += log10(1 / len(left))
        return out


def damaged(rows: list[tuple]) -> list[tuple]:
    """(conv, turn, role, text) after damage; dropped rows have None for turn, role and text and a mark."""
    import zlib

    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        told = [" " if x is None else str(x) for x in (conv, turn)]
        fate = zlib.crc32(":".join(told).encode()) % 20
        if fate == 0:
            out.append((conv, None, None, None, False))
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text, True)] * (2 if fate == 3 else 1)
    return out


def repaired(rows: list[tuple]) -> dict:
    """conv -> (gaps, blank, duplicate, truncated, illegal, cost, audit, lines) of damaged rows."""
    groups: dict = defaultdict(list)
    for conv, turn, role, text, present in rows:
        groups[conv] += [(turn is not None, turn or 0, role.encode(), text.encode(), role, text)] if present else []
    out = {}
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    for conv, turns in groups.items():
        turns.sort(key=lambda r: r[:4])
        seen, faults = set(), []
        for *_, role, text in turns:
            w = text.strip(" \t\n\x0b\f\r")
            faults.append("b" if not w else "d" if (role, text) in seen else "" if w[-1] in ".!?" else "t")
            seen.add((role, text))
        # All least (cost, audit) per state, row by row; a state is the last role's initial.
        best = {"": (0, "", ())}

        def spread(b):
            for _ in range(4):
                for q, (c, a, l) in list(b.items()):
                    r = "assistant" if q == "u" else "user"
                    new = (c + 3, a + "I", (*l, r + ":"))
                    if r[0] not in b or new[:2] < b[r[0]][:2]:
                        b[r[0]] = new
            return b

        best = spread(best)
        for (*_, role, text), fault in zip(turns, faults):
            nxt: dict = {}
            for q, (c, a, l) in best.items():
                more = 3 if fault == "t" else 0
                ways = [(q, c + 4, "D", ())]
                if fault in ("", "t"):
                    r = "assistant" if q == "u" else "user"
                    ways.append((r[0], c + 3 + more, "R", (f"{r}:{text}",)))
                    if role[:1] and role[:1] in step[q]:
                        ways.append((role[:1], c + more, "K", (f"{role}:{text}",)))
                for to, cost, letter, line in ways:
                    new = (cost, a + letter, l + line)
                    if to not in nxt or new[:2] < nxt[to][:2]:
                        nxt[to] = new
            best = spread(nxt)
        cost, audit, lines = min(best[q] for q in ("", "a") if q in best)
        known = [t for k, t, *_ in turns if k]
        pairs = [(a[4][:1], b[4][:1]) for a, b in zip(turns, turns[1:])]
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count("b"), faults.count("d"),
                     faults.count("t"), sum(x + y not in ("su", "ua", "au") or len(x) != 1 for x, y in pairs), cost, audit, "\n".join(lines))
    return out


def merkle(rows: list[tuple]) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text) rows."""
    import zlib
    from hashlib import sha256

    h = lambda s: sha256(s.encode()).hexdigest()
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h("".join(map(told, r)))
    order = lambda v: (v is not None, v if isinstance(v, int) else (v or "").encode())

    def climb(nodes):
        levels = [nodes]
        while len(nodes) > 1:
            nodes = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
            levels.append(nodes)
        return levels

    def up(levels, i):
        for nodes in levels[:-1]:
            first = i // 8 * 8
            yield nodes[first : first + 8], i - first
            i //= 8

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=order)
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = climb([leaf(r) for r in groups[g]])
    top = climb([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            runs = [*up(trees[g], i), *up(top, k)]
            proof = "".join("".join(run[:p] + run[p + 1 :]) for run, p in runs)
            now = trees[g][0][i]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                now = leaf((*r[:4], None if r[4] is None else lower(r[4])))
            for run, p in runs:
                now = h("".join([*run[:p], now, *run[p + 1 :]]))
            out.append((r[0], trees[g][0][i], trees[g][-1][0], top[-1][0], h(proof), now, now == top[-1][0]))
    return out


def simhash(text: str | None, width: int = 4) -> int:
    import xxhash

    w = words(lower(text or ""))
    grams = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def hamming_components(prints: dict[int, int], radius: int = 4) -> dict[int, int]:
    root = {i: i for i in prints}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def leaks(docs: list[tuple], items: list[tuple], percent: int = 80) -> dict[tuple, tuple]:
    """(doc_id, item_id) -> (windows, first word, best similarity) by comparing every placed window."""
    from math import floor, log

    def normal(text):
        return words(re.sub(r"[^\w \t\n\x0b\f\r]|_", "", (text or "").lower()))

    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    lists = {i: normal(t) for i, t in items}
    lists = {i: w for i, w in lists.items() if len(w) >= 5}
    df = Counter(s for w in lists.values() for s in set(grams(w)))
    weight = lambda s: floor(1000 * log(1 + len(lists) / df.get(s, 1)) + 0.5)
    out: dict = {}
    for d, t in docs:
        w = normal(t)
        at = defaultdict(list)
        for i, s in enumerate(grams(w)):
            at[s].append(i)
        for k, iw in lists.items():
            mine = set(grams(iw))
            spans = {(max(i - o, 0), min(i - o + len(iw), len(w))) for o, s in enumerate(grams(iw)) for i in at[s]}
            for a, b in spans:
                has = set(grams(w[a:b]))
                common = sum(map(weight, has & mine))
                union = sum(map(weight, has | mine))
                if 100 * common >= percent * union:
                    n, first, best = out.get((d, k), (0, a, 0.0))
                    out[d, k] = (n + 1, min(first, a), max(best, common / union))
    return out
