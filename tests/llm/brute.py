"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import math
import re
import struct
from collections import Counter, defaultdict

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
ITEM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def pii(text):
    found, n = [], [0] * 4
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = [True, k != 1 or all(int(x) <= 255 for x in m.group().split(".")), 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15][k]
            if ok:
                n[k] += 1
                found.append((m.start(), k, m.end()))
    return *n, sha(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found)))


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_duplicates(docs, similar=85):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(list)
    for i in sorted(sets):
        met = Counter(j for s in sets[i] for j in index[s])
        for j, n in met.items():
            if 100 * n >= similar * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            index[s].append(i)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def substrings(docs, k=13):
    words = {i: WORD.findall(t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][p : p + k]), i)
    out = {}
    for i, w in words.items():
        gone = {q for p in range(len(w) - k + 1) if first[tuple(w[p : p + k])] < i for q in range(p, p + k)}
        out[i] = (len(w), len(gone), sha(" ".join(x for q, x in enumerate(w) if q not in gone)))
    return out


def quality(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(grams)
    rep = len({q for p, g in enumerate(grams) if c[g] > 1 for q in range(p, p + 3)})
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)


def contaminated(text, items, n=10):
    w, hit, ids = ITEM.findall((text or "").translate(LOWER)), set(), set()
    for item, t in items:
        x = ITEM.findall((t or "").translate(LOWER))
        size = min(n, len(x))
        windows = {tuple(x[i : i + size]) for i in range(len(x) - size + 1)} if size else set()
        for p in range(len(w) - size + 1) if size else ():
            if tuple(w[p : p + size]) in windows:
                hit |= set(range(p, p + size))
                ids.add(str(item))
    return len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)


def clauses(symbols, g):
    """Patterns of the clauses of a run of symbols of the toxicity grammar `g`, each transducer run on its own."""
    out, found, ends = Counter(), [], (g.SOFT, g.END, g.BREAK)
    negation, reported, intent, quoted = 0, False, 0, False
    for x in symbols:
        if x in ends:
            insults, hints = (sum(y == k and not e for y, e, _ in found) for k in (g.INSULT, g.HINT))
            threats = [will for y, e, will in found if y == g.THREAT and not e]
            aimed = any(y == g.TARGET for y, _, _ in found)
            names = []
            if insults + hints:
                # Two hints are an insult; anything after an insult piles up.
                level = 0
                for y, e, _ in found:
                    if y in (g.INSULT, g.HINT) and not e:
                        level = {0: 2 if y == g.INSULT else 1, 1: 3 if y == g.INSULT else 2}.get(level, 3)
                names.append(["hint", "insult", "piled"][level - 1] + ("_aimed" if aimed else ""))
            if threats:
                names.append("threat_aimed" if any(threats) or aimed else "threat")
            if not names and any(y in (g.INSULT, g.HINT, g.THREAT) for y, _, _ in found):
                names.append("excused")
            out.update(names)
            found, negation, intent = [], 0, 0
            if x == g.BREAK:
                quoted = reported = False
            if x == g.END and not quoted:
                reported = False
            continue
        found.append((x, negation > 0 or reported or quoted, intent > 0))
        if x == g.QUOTE:
            quoted, reported = not quoted, False
        elif x == g.REPORT and not quoted:
            reported = True
        negation = g.SCOPE if x == g.NEGATION else max(0, negation - 1)
        intent = 2 if x == g.INTENT else max(0, intent - 1)
    return out


SECRET = re.compile("(?<![A-Za-z0-9_+-])[A-Za-z0-9_+-]{20,}")


def spans_and_entities(text):
    spans, names = [], set()
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            parts = v.split(".")
            if [True, k != 1 or all(int(x) <= 255 for x in parts), 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15][k]:
                spans.append((m.start(), m.end()))
                value = v.lower() if k == 0 else ".".join(str(int(x)) for x in parts) if k == 1 else d
                level = value.split("@")[-1] if k == 0 else ".".join(value.split(".")[:2]) if k == 1 else d[: 6 if k == 2 else 4]
                names |= {f"{KINDS[k]}:{value}", f"{KINDS[k]}/{level}", KINDS[k]}
    for m in SECRET.finditer(text or ""):
        if len(re.findall("[A-Za-z][0-9]", m.group())) >= 3:
            spans.append((m.start(), m.end()))
            names |= {f"secret:{m.group()}", "secret"}
    return spans, names


def core(word):
    return re.sub(r"^[\W_]+|[\W_]+$", "", word.lower())


def disclosures(texts, least, chance):
    """(entity, term) to the disclosure ratio, over distinct texts, a null text being one of its own."""
    texts = list(dict.fromkeys(texts))
    n, df_e, df_t, both = len(texts), Counter(), Counter(), Counter()
    for t in texts:
        spans, names = spans_and_entities(t)
        whole = {core(w) for w in WORD.findall(t or "")} - {""}
        apart = {core(m.group()) for m in WORD.finditer(t or "") if not any(m.start() < e and m.end() > s for s, e in spans)} - {""}
        df_e.update(names)
        df_t.update(whole)
        both.update((e, w) for e in names for w in apart)
    live = {k: v for k, v in both.items() if df_e[k[0]] > 1}
    near = Counter()
    for t in texts:
        spans, names = spans_and_entities(t)
        if any(df_e[e] > 1 for e in names):
            near.update({core(m.group()) for m in WORD.finditer(t or "") if not any(m.start() < e and m.end() > s for s, e in spans)} - {""})
    top = max((v for v in df_e.values() if v > 1), default=0)
    most = 1.000001 * top**least * n ** (1 - least)
    tested = max(1, sum(1 for (_, t) in live if 1 < near[t] <= most))
    out = {}
    for (e, t), k in live.items():
        m, q = df_e[e], df_t[t] / n
        if k < 2 or m >= n or k <= m * q:
            continue
        bound = -k * math.log(k / (m * q)) - ((m - k) * math.log((m - k) / (m * (1 - q))) if m > k else 0)
        ratio = math.log(n * k / (m * df_t[t])) / math.log(n / m)
        if ratio >= least and bound + math.log(tested) <= math.log(chance):
            out[e, t] = ratio
    return out


def rendezvous(doc_id, weights):
    """The shard with the least -ln(u) / weight; u comes from the 64-bit hash of the id and then of the shard's number."""
    key = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    u = [((xxhash.xxh64_intdigest(struct.pack("<i", s), key) >> 11) + 0.5) / (1 << 53) for s in range(len(weights))]
    return min((-math.log(x) / w, s) for s, (x, w) in enumerate(zip(u, weights)))[1]
